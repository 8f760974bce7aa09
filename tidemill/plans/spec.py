"""Query specifications and their two texts: ``m`` expressions of a GET, and POST bodies."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from urllib.parse import parse_qs, unquote

from ..functions import timeparse
from ..functions.registry import AGGREGATORS, DOWNSAMPLERS, UNSUPPORTED, extreme, quantile

MAX_COUNTER = float(2**64 - 1)


class QueryError(ValueError):
    """A query that cannot be run; ``status`` is the HTTP status that it stands for."""

    def __init__(self, message: str, status: int = 400):
        super().__init__(message)
        self.status = status


@dataclass(frozen=True)
class TagFilter:
    key: str
    kind: str
    value: str


@dataclass(frozen=True)
class Downsample:
    """``interval`` in milliseconds; 0 stands for the whole range (``all``)."""

    interval: int
    function: str
    fill: str = "none"

    @property
    def all(self) -> bool:
        return self.interval == 0


@dataclass(frozen=True)
class Rate:
    counter: bool = False
    counter_max: float = MAX_COUNTER
    reset_value: float = 0.0
    drop_resets: bool = False


@dataclass(frozen=True)
class SubQuery:
    metric: str
    aggregator: str = "none"
    downsample: Downsample | None = None
    tags: tuple[TagFilter, ...] = ()
    filters: tuple[TagFilter, ...] = ()
    rate: Rate | None = None
    explicit_tags: bool = False
    rollup: str = "ROLLUP_FALLBACK_RAW"


@dataclass(frozen=True)
class Query:
    """Bounds in milliseconds, both inclusive."""

    start: int
    end: int
    queries: tuple[SubQuery, ...] = field(default_factory=tuple)
    ms: bool = False


_KINDS = ("literal_or", "iliteral_or", "not_literal_or", "not_iliteral_or", "wildcard", "iwildcard", "regexp")


def parse_filter(key: str, text: str) -> TagFilter:
    """``v``, ``*``, ``pre*``, ``a|b`` or ``kind(argument)``."""
    m = re.fullmatch(r"(\w+)\((.*)\)", text, re.S)
    if m and m[1] in _KINDS:
        return TagFilter(key, m[1], m[2])
    if text.endswith("*"):
        return TagFilter(key, "wildcard", text)
    return TagFilter(key, "literal_or", text) if "|" in text else TagFilter(key, "literal", text)


def parse_tags(text: str) -> tuple[TagFilter, ...]:
    """``k=v,k2=v2`` as it stands between braces; keys and values may be quoted."""
    out = []
    for part in _split(text, ","):
        key, sep, value = part.partition("=")
        if not sep:
            raise QueryError(f"cannot read the tag {part!r}")
        out.append(parse_filter(key.strip().strip('"'), value.strip().strip('"')))
    return tuple(out)


def _split(text: str, mark: str) -> list[str]:
    """Parts between marks that stand outside of braces, brackets and parentheses."""
    out, depth, now = [], 0, ""
    for c in text:
        depth += (c in "{([") - (c in "})]")
        if c == mark and depth == 0:
            out.append(now)
            now = ""
        else:
            now += c
    return [x for x in [*out, now] if x]


def parse_downsample(text: str) -> Downsample | None:
    """``interval-function[-fill]``; a text of one token is ignored, and ``none`` means no downsampling."""
    parts = text.split("-")
    if len(parts) < 2:
        return None
    m = re.fullmatch(r"(\d+)(ms|s|m|h|d|w|all)", parts[0])
    if not m:
        raise QueryError(f"cannot read the interval {parts[0]!r}")
    function = parts[1]
    if function == "none":
        return None
    if function not in DOWNSAMPLERS and quantile(function) is None:
        raise QueryError(f"unknown downsampler {function!r}")
    fill = parts[2] if len(parts) > 2 else "none"
    if fill not in ("none", "nan", "null", "zero"):
        raise QueryError(f"unknown fill policy {fill!r}")
    interval = 0 if m[2] == "all" else max(1, int(m[1])) * timeparse.UNITS[m[2]]
    return Downsample(interval, function, fill)


def parse_rate(text: str) -> Rate | None:
    """``rate`` or ``rate{counter,max,reset,drop}``; None for another token."""
    m = re.fullmatch(r"rate(?:\{(.*)\})?", text)
    if not m:
        return None
    slots = [x.strip() for x in (m[1] or "").split(",")] + [""] * 4
    true = lambda x: x.lower() in ("t", "true", "counter", "dropresets", "drop")
    return Rate(true(slots[0]), float(slots[1] or MAX_COUNTER), float(slots[2] or 0), true(slots[3]))


def check_aggregator(name: str) -> str:
    if name in UNSUPPORTED:
        raise QueryError(f"the aggregator {name!r} is listed but not supported")
    if name != "none" and name not in AGGREGATORS and quantile(name) is None and extreme(name) is None:
        raise QueryError(f"unknown aggregator {name!r}")
    return name


def parse_m(text: str) -> SubQuery:
    """``agg[:rate][:downsample][:explicit_tags]:metric[{grouping}[{filters}]]``."""
    *options, target = _split(text, ":")
    if not options:
        raise QueryError(f"no aggregator in {text!r}")
    m = re.fullmatch(r"([^{}]+)(?:\{(.*?)\})?(?:\{(.*?)\})?", target, re.S)
    if not m:
        raise QueryError(f"cannot read {target!r}")
    rate, down, explicit = None, None, False
    for o in options[1:]:
        if o == "explicit_tags":
            explicit = True
        elif o.startswith("percentiles["):
            continue
        elif (r := parse_rate(o)) is not None:
            rate = r
        else:
            down = parse_downsample(o)
    tags = parse_tags(m[2] or "")
    return SubQuery(m[1].strip(), check_aggregator(options[0]), down, tags, parse_tags(m[3] or ""), rate, explicit and bool(tags))


def parse_get(query: str, now_ms: int | None = None) -> Query:
    """The query string of a GET, with any number of ``m``."""
    p = parse_qs(query.lstrip("?"), keep_blank_values=True)
    if "start" not in p:
        raise QueryError("start is missing")
    tz = p.get("tz", [None])[-1]
    now_ms = timeparse.instant("now") if now_ms is None else now_ms
    try:
        start, end = (timeparse.instant(p[k][-1], now_ms, tz) if k in p else now_ms for k in ("start", "end"))
    except timeparse.TimeError as e:
        raise QueryError(str(e)) from None
    return Query(start, end, tuple(parse_m(unquote(m)) for m in p.get("m", [])), p.get("msResolution", ["false"])[-1] != "false")


def parse_body(body: str | dict, now_ms: int | None = None) -> Query:
    """The JSON body of a POST; ``filters`` of a sub-query are read as well as ``tags``."""
    if isinstance(body, str):
        try:
            body = json.loads(body)
        except ValueError as e:
            raise QueryError(f"cannot read the body: {e}") from None
    if not body or "start" not in body:
        raise QueryError("start is missing")
    if not body.get("queries"):
        raise QueryError("queries are missing")
    now_ms = timeparse.instant("now") if now_ms is None else now_ms
    try:
        start, end = (timeparse.instant(body[k], now_ms, body.get("timezone")) if body.get(k) is not None else now_ms for k in ("start", "end"))
    except timeparse.TimeError as e:
        raise QueryError(str(e)) from None
    out = []
    for q in body["queries"]:
        if "metric" not in q:
            raise QueryError("metric is missing")
        tags = tuple(parse_filter(k, str(v)) for k, v in (q.get("tags") or {}).items())
        named = [(parse_filter(f["tagk"], f"{f['type']}({f['filter']})"), f.get("groupBy", False)) for f in q.get("filters") or []]
        o = q.get("rateOptions") or {}
        rate = Rate(bool(o.get("counter")), float(o.get("counterMax", MAX_COUNTER)), float(o.get("resetValue", 0)), bool(o.get("dropResets"))) if q.get("rate") else None
        down = parse_downsample(q["downsample"]) if q.get("downsample") else None
        tags += tuple(f for f, group in named if group)
        usage = q.get("rollupUsage", "ROLLUP_FALLBACK_RAW")
        out.append(SubQuery(q["metric"], check_aggregator(q.get("aggregator", "none")), down, tags, tuple(f for f, group in named if not group), rate, bool(q.get("explicitTags")) and bool(tags), usage))
    return Query(start, end, tuple(out), bool(body.get("msResolution", False)))


def parse_loose_map(text: str) -> dict[str, str]:
    """An unquoted map such as ``{a=b,c=*}``, or JSON."""
    text = text.strip()
    if text.startswith("{") and re.match(r'\{\s*"', text):
        return {str(k): str(v) for k, v in json.loads(text).items()}
    return dict(p.split("=", 1) for p in _split(text.strip("{}"), ",") if "=" in p)

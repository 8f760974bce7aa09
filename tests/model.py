"""A row-at-a-time model of queries, to compare random data with."""

import math
import re
from collections import defaultdict

from tidemill.functions.percentiles import of_list
from tidemill.functions.registry import extreme, quantile


def match(f, v):
    if v is None:
        return False
    options = f.value.split("|")
    low = [o.lower() for o in options]
    pattern = ".*".join(map(re.escape, f.value.split("*")))
    return {
        "literal": v == f.value,
        "literal_or": v in options,
        "iliteral_or": v.lower() in low,
        "not_literal_or": v not in options,
        "not_iliteral_or": v.lower() not in low,
        "wildcard": re.fullmatch(pattern, v) is not None,
        "iwildcard": re.fullmatch(pattern, v, re.I) is not None,
        "regexp": f.kind == "regexp" and re.fullmatch(f.value, v) is not None,
    }[f.kind]


def fold(name, pairs, across):
    v = [x for _, x in sorted(pairs)]
    fin = [x for x in v if math.isfinite(x)]
    num = [x for x in v if not math.isnan(x)]
    if quantile(name) is not None:
        return of_list(fin if across else v, quantile(name))
    if name == "dev":
        w = fin if across else v
        return math.sqrt(sum((x - sum(w) / len(w)) ** 2 for x in w) / len(w)) if w else math.nan
    return {"avg": lambda: sum(v) / len(v), "sum": lambda: sum(v), "count": lambda: float(len(v)), "min": lambda: min(num, default=math.nan), "max": lambda: max(num, default=math.nan), "first": lambda: v[0], "last": lambda: v[-1]}[name]()


def run(points, query, sub):
    """{result: {ts: value}} for points (metric, ts, value, tags, seq) in seconds."""
    series, last = {}, {}
    for metric, ts, value, tags, seq in sorted(points, key=lambda p: p[4]):
        filters = sub.tags + sub.filters
        if metric != sub.metric or not all(match(f, tags.get(f.key)) for f in filters):
            continue
        name = ",".join(f"{k}={tags[k]}" for k in sorted(tags))
        series[name] = tags
        last[name, ts] = value
    d, start, end = sub.downsample, query.start // 1000, query.end // 1000
    step = 0 if d is None or d.all else d.interval // 1000
    values = defaultdict(list)
    first = -(-start // step) * step if step else start
    final = end // step * step if step else end
    for (name, ts), v in last.items():
        bucket = ts if d is None else start if d.all else ts - ts % step
        if (start <= ts <= end) if not step else first <= bucket <= final:
            values[name, bucket].append((ts, v))
    values = {k: fold(d.function, p, False) if d else p[0][1] for k, p in values.items()}
    if d and d.fill != "none":
        for name in series:
            for b in range(first, final + 1, step) if step else [start]:
                values.setdefault((name, b), 0.0 if d.fill == "zero" else math.nan)
    out = defaultdict(lambda: defaultdict(list))
    side = extreme(sub.aggregator)
    keys = sorted({f.key for f in sub.tags})
    by_series = defaultdict(dict)
    for (name, ts), v in values.items():
        by_series[name][ts] = v
    if side:
        pick = max if side[0] == "top" else min
        best = {n: pick(x[t] for t in sorted(x)[-3:]) for n, x in by_series.items()}
        chosen = sorted(best, key=lambda n: (-best[n] if side[0] == "top" else best[n], n))[: side[1]]
        by_series = {n: by_series[n] for n in chosen}
    alone = side or sub.aggregator == "none"
    for name, x in by_series.items():
        result = name if alone else ",".join(f"{k}={series[name][k]}" for k in keys)
        for ts, v in x.items():
            out[result][ts].append((name, v))
    out = {r: {ts: p[0][1] if alone else fold(sub.aggregator, p, True) for ts, p in x.items()} for r, x in out.items()}
    if sub.rate:
        for r, x in out.items():
            rates, before = {}, None
            for ts in sorted(x):
                if before is not None:
                    diff = x[ts] - x[before]
                    rate = diff / (ts - before)
                    if sub.rate.counter and diff < 0:
                        rate = None if sub.rate.drop_resets else (sub.rate.counter_max - x[before] + x[ts]) / (ts - before)
                        if rate is not None and sub.rate.reset_value and rate > sub.rate.reset_value:
                            rate = 0.0
                    if rate is not None:
                        rates[ts] = rate
                before = ts
            out[r] = rates
    return {(r, ts): v for r, x in out.items() for ts, v in x.items()}

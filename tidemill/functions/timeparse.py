"""Timestamps, durations and units, in plain Python: bounds come from the query text alone."""

from __future__ import annotations

import datetime as dt
import re
import time
from zoneinfo import ZoneInfo

# Milliseconds in each unit of a relative time.
UNITS = {"ms": 1, "s": 1000, "m": 60_000, "min": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "n": 2_592_000_000, "mo": 2_592_000_000, "month": 2_592_000_000, "y": 31_536_000_000}
# Bytes in each unit of a size.
SIZES = {"": 1, "b": 1, "kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30, "tb": 1 << 40}
# Nanoseconds in each time unit that can be converted.
NANOS = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "min": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9, "w": 7 * 86400 * 10**9}


class TimeError(ValueError):
    """A time, duration or unit that cannot be read."""


def convert(value: int, source: str, target: str) -> int:
    """A count of one time unit as whole units of another."""
    try:
        return value * NANOS[source] // NANOS[target]
    except KeyError as e:
        raise TimeError(f"unknown time unit {e}") from None


def duration(text: str) -> int:
    """Milliseconds of ``90s``, ``2h``, ``500ms``."""
    m = re.fullmatch(r"(\d+)([a-z]+)", text.strip())
    if not m or m[2] not in UNITS:
        raise TimeError(f"cannot read the duration {text!r}")
    return int(m[1]) * UNITS[m[2]]


def size(text: str) -> int:
    """Bytes of ``10``, ``4kb``, ``1gb``."""
    m = re.fullmatch(r"(\d+)\s*([a-z]*)", text.strip().lower())
    if not m or m[2] not in SIZES:
        raise TimeError(f"cannot read the size {text!r}")
    return int(m[1]) * SIZES[m[2]]


def zone(name: str | None) -> dt.tzinfo:
    """``UTC``, ``UTC+h`` (hours east) or an IANA name."""
    if not name:
        return dt.timezone.utc
    m = re.fullmatch(r"(?:UTC|GMT)(?:([+-])(\d{1,2})(?::?(\d\d))?)?", name)
    if m:
        offset = dt.timedelta(hours=int(m[2] or 0), minutes=int(m[3] or 0))
        return dt.timezone(-offset if m[1] == "-" else offset)
    try:
        return ZoneInfo(name)
    except Exception:
        raise TimeError(f"unknown time zone {name!r}") from None


def to_ms(ts: int) -> int:
    """Milliseconds of an integer timestamp, its unit told by its size."""
    if ts < 10**10:
        return ts * 1000
    if ts < 10**13:
        return ts
    return ts // 1000 if ts < 10**16 else ts // 10**6


def instant(text: str | int, now_ms: int | None = None, tz: str | None = None) -> int:
    """Milliseconds since the epoch of an absolute, relative (``2h-ago``) or numeric time."""
    if isinstance(text, int | float):
        return to_ms(int(text))
    text = text.strip()
    if re.fullmatch(r"\d+(\.\d+)?", text):
        return to_ms(int(float(text))) if "." in text else to_ms(int(text))
    now_ms = int(time.time() * 1000) if now_ms is None else now_ms
    if text == "now":
        return now_ms
    if text.endswith("-ago"):
        return now_ms - duration(text[:-4])
    m = re.fullmatch(r"(\d{4})/(\d{1,2})/(\d{1,2})(?:[ -](\d{1,2}):(\d{2})(?::(\d{2}))?)?", text)
    if not m:
        raise TimeError(f"cannot read the time {text!r}")
    parts = [int(x or 0) for x in m.groups()]
    return int(dt.datetime(*parts, tzinfo=zone(tz)).timestamp() * 1000)


def month_bounds(ms: int) -> tuple[int, int]:
    """First millisecond of the UTC month of an instant and of the next month."""
    t = dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc).replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    following = t.replace(year=t.year + t.month // 12, month=t.month % 12 + 1)
    return int(t.timestamp() * 1000), int(following.timestamp() * 1000)

"""Tag filters as Spark conditions.  A series without the key matches none of them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.spec import TagFilter

# The named filters and what they do.
CATALOGUE = {
    "literal_or": "the value is one of a|b, case counts",
    "iliteral_or": "the value is one of a|b, case does not count",
    "not_literal_or": "the value is none of a|b, case counts",
    "not_iliteral_or": "the value is none of a|b, case does not count",
    "wildcard": "* stands for any characters, case counts",
    "iwildcard": "* stands for any characters, case does not count",
    "regexp": "the whole value matches the expression",
}


def glob(text: str) -> str:
    """A glob as an anchored regular expression; only ``*`` is special."""
    return "^(?:" + ".*".join(map(_quote, text.split("*"))) + ")$"


def _quote(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def condition(f: TagFilter, value: Column) -> Column:
    """The filter on one tag's value; plain comparisons where they say the same as a pattern."""
    options = f.value.split("|")
    if f.kind == "literal":
        return value == f.value
    if f.kind == "literal_or":
        return value.isin(options)
    if f.kind == "iliteral_or":
        return F.lower(value).isin([o.lower() for o in options])
    if f.kind == "not_literal_or":
        return value.isNotNull() & ~value.isin(options)
    if f.kind == "not_iliteral_or":
        return value.isNotNull() & ~F.lower(value).isin([o.lower() for o in options])
    if f.kind in ("wildcard", "iwildcard"):
        text, v = (f.value, value) if f.kind == "wildcard" else (f.value.lower(), F.lower(value))
        if set(text) == {"*"}:
            return value.isNotNull()
        if text.count("*") == 1 and text.endswith("*"):
            return v.startswith(text[:-1])
        return v.rlike("(?s)" + glob(text))
    if f.kind == "regexp":
        return value.rlike(f"^(?:{f.value})$")
    raise ValueError(f"unknown filter {f.kind!r}")


def matching(filters: tuple[TagFilter, ...], tags: Column | None = None) -> Column:
    """All filters at once."""
    tags = F.col("tags") if tags is None else tags
    return reduce(lambda a, b: a & b, [condition(f, tags[f.key]) for f in filters], F.lit(True))


def listing(spark: SparkSession) -> DataFrame:
    """``name, description`` of the filters that clients may use."""
    return spark.createDataFrame(sorted(CATALOGUE.items()), "name string, description string")

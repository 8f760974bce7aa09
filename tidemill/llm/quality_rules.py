"""Quality rules: a threshold table compiled into one projection of built-in functions.

Each rule bounds one metric of a text.  ``compile_rules`` turns the whole table into
a single boolean expression (and ``rules_sql`` into the same expression as SQL text),
so a scan evaluates all rules in one pass without user functions and without a shuffle.

Defined results: a null text has no words, so every count is 0 and it fails the base
rule; an empty table gives an empty result; repeated rows are judged one by one; extra
columns are carried through, whatever their names: ``judge`` adds two struct columns, with
underscores after their names where the table has those already; ``keep_good`` adds none.
Long texts are handled by hashing and sorting word windows, never by comparing all pairs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, words

# Frequent function words of English, French, German and Spanish without accents.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the they this "
    "to was were which with you "
    "au aux ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas pour qu que qui "
    "sa se ses son sur un une vous "
    "aber als am auch auf aus bei bin das dass dem den der des die du ein eine einem einen einer er es hat ich ihr im ist "
    "mit nach nicht noch nur oder sich sie sind so um und uns von vor war wie wir zu zum zur "
    "al como con del el ella ellos era esta este esto fue ha hay las lo los me mi muy nos para pero por si sin su sus te tu "
    "y ya"
).split()

#: The same in lower case, capitalised and in capitals.
STOP_FORMS = sorted({f for w in STOP_WORDS for f in (w, w.capitalize(), w.upper())})


@dataclass(frozen=True)
class Rule:
    """Reject when ``metric`` is below ``low`` or above ``high``; a bound may be absent."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The contract's base rules, as exact integer conditions.
BASE_SQL = "(n_words < 50 or 100 * n_repeat_words > 50 * n_words)"

#: Thresholds beyond the base rules.  Metrics are ratios, so long and short texts are judged alike.
RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("exclamations_per_word", None, 0.3),
    Rule("capital_share", None, 0.5),
    Rule("stop_word_share", 0.01, None),
    Rule("dup_line_share", None, 0.5),
    Rule("bullet_line_share", None, 0.9),
    Rule("ellipsis_line_share", None, 0.3),
)

#: What ``measure`` counts.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_exclamations", "n_capitals", "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines")

#: Each ratio as SQL over the counts; both Spark and DuckDB read it.
RATIOS = {
    "mean_word_chars": "cast(word_chars as double) / greatest(n_words, 1)",
    "symbols_per_word": "cast(n_symbols as double) / greatest(n_words, 1)",
    "exclamations_per_word": "cast(n_exclamations as double) / greatest(n_words, 1)",
    "capital_share": "cast(n_capitals as double) / greatest(word_chars, 1)",
    "stop_word_share": "cast(n_stop_words as double) / greatest(n_words, 1)",
    "dup_line_share": "cast(n_dup_lines as double) / greatest(n_lines, 1)",
    "bullet_line_share": "cast(n_bullet_lines as double) / greatest(n_lines, 1)",
    "ellipsis_line_share": "cast(n_ellipsis_lines as double) / greatest(n_lines, 1)",
}


def rules_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The table as one SQL condition that holds for a kept text."""
    terms = [f"not {BASE_SQL}"]
    for r in rules:
        if r.low is not None:
            terms.append(f"{RATIOS[r.metric]} >= {r.low!r}")
        if r.high is not None:
            terms.append(f"{RATIOS[r.metric]} <= {r.high!r}")
    return " and ".join(terms)


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean Spark expression over the counts."""
    return F.expr(rules_sql(rules))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """``_row`` (the caller's row as one struct) and ``_m``, the struct of every count that the rules use.

    The steps are separate projections so that each array is made once; Spark keeps
    them apart because later steps refer to them repeatedly.  A row's counts come out of
    a generator over one element: a filter on them stays above it, where the optimiser
    would else write the whole chain out again inside a filter at the scan.
    """
    has_word = r"[^\x20\x09-\x0D]"
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    x = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), t.alias("_t"))
    x = x.select("_row", "_t", words(F.col("_t")).alias("_w"), F.filter(F.split("_t", "\n", -1), lambda s: s.rlike(has_word)).alias("_l"))
    # 64-bit hashes of the three-word windows; two different windows of one text share one with odds of n * n / 2**65.
    grams = "arrays_zip(slice(_w, 1, size(_w) - 2), slice(_w, 2, size(_w) - 2), slice(_w, 3, size(_w) - 2))"
    x = x.select("*", F.expr(f"case when size(_w) >= 3 then transform({grams}, g -> xxhash64(g)) else cast(array() as array<bigint>) end").alias("_g"))
    # Only a text with a repeated window goes on: its hashes in order, then those that stand beside an equal one.
    x = x.select("*", F.expr("case when size(array_distinct(_g)) < size(_g) then sort_array(_g) end").alias("_s"))
    x = x.select("*", F.expr("array_distinct(zip_with(slice(_s, 1, size(_s) - 1), slice(_s, 2, size(_s) - 1), (a, b) -> case when a = b then a end))").alias("_d"))
    # Places of repeated windows: a search in a short list, or else one sort of (hash, place), so that the work stays near-linear.
    searched = "filter(sequence(0, size(_g) - 1), i -> array_contains(_d, get(_g, i)))"
    x = x.select("*", F.expr("case when size(_d) > 16 then sequence(0, size(_g) - 1) end").alias("_i"))
    x = x.select("*", F.expr("sort_array(arrays_zip(_g, _i))").alias("_o"))
    sorted_ = "sort_array(array_compact(transform(_o, (s, k) -> case when s._g = get(_o, k - 1)._g or s._g = get(_o, k + 1)._g then s._i end)))"
    x = x.select("*", F.expr(f"case when _d is null then null when size(_d) <= 16 then {searched} else {sorted_} end").alias("_p"))
    covered = "aggregate(transform(_p, (p, k) -> least(3, coalesce(get(_p, k + 1) - p, 3))), 0L, (a, v) -> a + v)"
    stops = ", ".join(f"'{w}'" for w in STOP_FORMS)

    def count(chars: str) -> Column:
        rest = F.col("_t")
        for c in chars:
            rest = F.replace(rest, F.lit(c), F.lit(""))
        return (F.length("_t") - F.length(rest)).cast("long")

    metrics = F.struct(
        F.size("_w").cast("long").alias("n_words"),
        (F.length("_t") - count(" \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        count("#*$%&|<>").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.expr(covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        count("!").alias("n_exclamations"),
        F.length(F.regexp_replace("_t", r"[^A-Z]+", "")).cast("long").alias("n_capitals"),
        F.expr(f"cast(size(filter(_w, w -> w in ({stops}))) as long)").alias("n_stop_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.filter("_l", lambda s: s.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("_l", lambda s: s.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
    )
    return x.select("_row", F.explode(F.array(metrics)).alias("_m"))


def _on_struct(sql: str) -> Column:
    """Rules over the fields of ``_m``."""
    return F.expr(re.sub(r"\b(" + "|".join(COUNTS) + r")\b", r"_m.\1", sql))


def _judged(df: DataFrame, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    return measure(df, text).select("_row", "_m", _on_struct(BASE_SQL).alias("_base"), _on_struct(rules_sql(rules)).alias("_kept"))


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with the structs ``quality_metrics`` and ``quality_verdict`` (``base_failed``, ``kept``) as last columns."""
    x = _judged(df, text, rules)
    verdict = F.struct(F.col("_base").alias("base_failed"), F.col("_kept").alias("kept"))
    return x.select("_row.*", F.col("_m").alias(free_name(df, "quality_metrics")), verdict.alias(free_name(df, "quality_verdict")))


def keep_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``df`` that pass every rule, with the columns of ``df``, whatever their names."""
    return _judged(df, text, rules).where("_kept").select("_row.*")


def query(docs: DataFrame) -> DataFrame:
    x = judge(docs.select("doc_id", "text"))
    m = [F.col(f"quality_metrics.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return x.select("doc_id", *m, "quality_verdict.base_failed", "quality_verdict.kept")


def oracle(rules: tuple[Rule, ...] = RULES, source: str = "documents", out: str = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept") -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_FORMS)
    count = lambda chars: f"cast(length(regexp_replace(t, '[^{chars}]+', '', 'g')) as bigint)"
    return f"""
with qa as (select *, coalesce(text, '') as t from {source}),
qb as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w,
              list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) as l from qa),
qc as (select *, case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) else [] end as g from qb),
qe as (select doc_id, unnest(g) as gram, generate_subscripts(g, 1) as i from qc),
qf as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) as n from qe) where n > 1),
qg as (select doc_id, sum(least(3, coalesce(nxt - i, 3))) as covered from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from qf) group by doc_id),
qm as (select qc.*, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, {count('#*$%&|<>')} as n_symbols,
   cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, cast(coalesce(covered, 0) as bigint) as n_repeat_words,
   {count('!')} as n_exclamations, {count('A-Z')} as n_capitals,
   cast(len(list_filter(w, lambda s: s in ({stops}))) as bigint) as n_stop_words, cast(len(l) as bigint) as n_lines,
   cast(len(list_filter(l, lambda s: regexp_matches(s, '^[\\x20\\x09-\\x0D]*[-*•]'))) as bigint) as n_bullet_lines,
   cast(len(list_filter(l, lambda s: regexp_matches(s, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) as bigint) as n_ellipsis_lines
  from qc left join qg using (doc_id)),
qv as (select *, {BASE_SQL} as base_failed, ({rules_sql(rules)}) as kept from qm)
select {out} from qv"""

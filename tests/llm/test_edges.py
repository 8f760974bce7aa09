"""Every operator and stage on the same hard table: clashing names, nulls everywhere, equal rows, odd ids, no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tidemill.llm import bpe, exact_dedup, jaccard_join, line_dedup, lm_scoring, packing, quality_knn, quality_rules, sharding, suffix_dedup

#: Names that operators use for columns of their own.
NAMES = ["_id", "_mark", "_kept", "_row", "_m", "quality_metrics", "quality_verdict", "cut", "row", "spans", "shard", "block", "times", "key", "n", "id", "rep", "label", "bytes", "piece", "row_number"]
GOOD = " ".join(f"word{i} and the" for i in range(40))
ROWS = [(1, GOOD), (2, GOOD + " more"), (2, GOOD + " more"), (2, "another text"), (None, GOOD), (None, None), (3, None), (4, ""), (5, "\n\n"), (6, "a\nb\na\nb"), (7, "x" * 5000)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), *[F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in NAMES])


def ids(rows):
    return sorted(str(r.doc_id) for r in rows)


ALL = sorted(str(i) for i, _ in ROWS)


def whole(rows, columns):
    """Each row still has what it came with."""
    assert all(r[n] == f"{n} of {'-' if r.doc_id is None else r.doc_id}" for r in rows for n in NAMES)
    return [c for c in rows[0].__fields__ if c not in columns]


@pytest.mark.parametrize(
    ("run", "added"),
    [
        (quality_rules.judge, ["quality_metrics_", "quality_verdict_"]),
        (line_dedup.dedup_lines, ["cut_"]),
        (suffix_dedup.remove_repeats, ["cut_"]),
    ],
)
def test_rows_are_carried_through(docs, run, added):
    rows = run(docs).collect()
    assert ids(rows) == ALL and whole(rows, docs.columns) == added
    assert run(docs.limit(0)).collect() == []


@pytest.mark.parametrize("run", [quality_rules.keep_good, line_dedup.keep_unseen, jaccard_join.keep_one, suffix_dedup.keep_unrepeated])
def test_filters_keep_columns(docs, run):
    rows = run(docs).collect()
    assert rows and whole(rows, docs.columns) == [] and list(rows[0].__fields__) == docs.columns
    assert run(docs.limit(0)).collect() == []


@pytest.mark.parametrize("run", [quality_rules.query, jaccard_join.query, exact_dedup.query, bpe.query, sharding.query, lm_scoring.query, suffix_dedup.query, packing.query, line_dedup.query])
def test_queries_take_the_table(docs, run):
    assert ids(run(docs).collect()) == (ALL if run is not packing.query else sorted(ALL))
    assert run(docs.limit(0)).collect() == []


def test_classifier_takes_the_table(docs, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None), (99, 0), (7, 0), (7, 0)], "doc_id long, quality int")
    assert ids(quality_knn.query(docs, labels).collect()) == ALL
    assert ids(quality_knn.query(docs, labels.limit(0)).collect()) == ALL
    assert quality_knn.query(docs.limit(0), labels).collect() == []


def test_shards_keep_the_column(docs, tmp_path, spark):
    sharding.write_shards(docs, f"{tmp_path}/shards", limit=3000)
    rows = spark.read.parquet(f"{tmp_path}/shards").collect()
    assert ids(rows) == ALL and whole(rows, docs.columns) == ["shard_"]


def test_ids_of_other_types(docs, spark):
    named = docs.withColumn("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    want = sorted("None" if i is None else f"doc-{i}" for i, _ in ROWS)
    for run in (quality_rules.query, exact_dedup.query, bpe.query, sharding.query, lm_scoring.query, suffix_dedup.query, line_dedup.query, packing.query):
        assert ids(run(named).collect()) == want
    with pytest.raises(TypeError):
        jaccard_join.query(named)


def test_rows_without_ids_are_compared(spark, monkeypatch):
    """Equal fingerprints of different texts whose ids are null."""
    original = exact_dedup.materialize
    weak = lambda frame, tag: original(frame.selectExpr("id", "size", "0L as fp1", "0L as fp2", "sha", "row") if tag == "exact-prints" else frame, tag)
    monkeypatch.setattr(exact_dedup, "materialize", weak)
    got = exact_dedup.query(spark.createDataFrame([(None, "same size a"), (None, "same size b"), (1, "same size b")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == [("1", "1", 2), ("None", "1", 2), ("None", "None", 1)]


def test_stages_take_the_table_and_none(docs, spark, tmp_path):
    base = docs.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, base, "")
        assert out.columns == base.columns and out.count() > 0
        assert stage(spark, base.limit(0), "").count() == 0
    base.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0

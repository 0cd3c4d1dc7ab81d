"""The pipeline's stages on the smallest tables, and each query's SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMOKE
from tests.test_queries import TABLES, rows
from veilframe.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMOKE}/{t}.parquet'")
    got, rel = queries.QUERIES[name](spark, SMOKE), con.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(rel.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(rel.columns, rel.fetchall())


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    seen = {r["doc_id"] for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SMOKE).collect()
        assert {r["doc_id"] for r in out} <= seen and out and sorted(out[0].asDict()) == sorted(docs.columns), name
        docs = spark.createDataFrame(out, docs.schema)
        seen = {r["doc_id"] for r in out}
    last = P.STAGES[-1][1](spark, docs, SMOKE)
    assert last.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == docs.count()
    assert sorted(P.run(spark, SMOKE).collect()) == sorted(last.collect())


def odd_docs(spark):
    rows = [(1, "one two three four five six", "a"), (1, "one two three four five six", "a"), (None, "no id at all here", "a"), (2, None, None), (3, "", "a"), (4, " \n\t ", "b"), (5, "long text of words " * 20_000, "b"), (6, "mail a.b@c.example.com now", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("size", F.lit("own")).withColumn("kept", F.lit(1)).withColumn("digest", F.lit("d")).withColumn("taken", F.lit(2.5)).withColumn("ids", F.lit("x"))


#: How many of the odd rows each stage leaves: the classifier decides by score; one of the two repeated rows is a copy; three rows have no words.
LEFT = {"MinHash near-dedup": (7, 7), "PII": (8, 8), "mixing sources to target weights": (1, 15), "byte-level BPE": (8, 8), "quality classifier": (0, 8)}


@pytest.mark.parametrize("at", range(5))
def test_stages_bear_odd_rows_and_empty_tables(spark, at):
    import corpus_pipeline as P

    name, stage = P.STAGES[at]
    docs = odd_docs(spark)
    own = {(r["doc_id"], r["text"]) for r in docs.collect()}
    for rows in (docs, docs.repartition(3), docs.limit(0)):
        out = stage(spark, rows, SMOKE)
        got = out.collect()
        low, high = LEFT[name] if rows is not docs and rows.count() or rows is docs else (0, 0)
        assert low <= len(got) <= high
        if at == 4:
            assert out.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            assert {r["n_tokens"] for r in got if r["doc_id"] in (2, 3)} <= {0}
            continue
        assert out.columns == docs.columns and all(r["size"] == "own" and r["digest"] == "d" and r["ids"] == "x" for r in got)
        if name == "PII":
            assert {r["doc_id"]: r["text"] for r in got}.get(6, "mail [EMAIL] now") == "mail [EMAIL] now" and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
        else:
            assert {(r["doc_id"], r["text"]) for r in got} <= own
        if name.startswith("mixing"):
            assert not {r["doc_id"] for r in got} & {2, 3, 4}
    if name == "quality classifier":
        assert len({r["doc_id"] for r in stage(spark, docs, SMOKE).collect() if r["doc_id"] == 1}) <= 1


def test_pipeline_frees_its_scratch(spark):
    import corpus_pipeline as P
    from veilframe.llm.common import scratch_dir

    folder = scratch_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    out = P.run(spark, SMOKE)
    left = {x for x in os.listdir(folder) if x not in before}
    assert len(left) == 1 and out.count() > 0


def test_no_local_scratch_off_a_local_master():
    from types import SimpleNamespace

    from veilframe.llm import common

    context = SimpleNamespace(getConf=lambda: {}, master="spark://host:7077", applicationId="x")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.scratch_dir(SimpleNamespace(conf={}, sparkContext=context))

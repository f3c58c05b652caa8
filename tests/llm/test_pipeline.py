"""The pipeline's stages against plain rules on their own inputs, and the SQL of the queries that have one."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.test_llm_operators import brute_components, brute_contamination
from tidewait.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("extra", F.lit("x"))
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        rows = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SMALL)
        got = [r.doc_id for r in out.collect()]
        if name == "language":
            assert set(got) == {i for i, t in rows.items() if t is not None and any(c.isalpha() for c in t)}
        elif name == "near_duplicates":
            assert sorted(got) == sorted({c for _, n, c in brute_components(list(rows.items()))})
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
            assert set(got) == {i for i, _, hit, _ in brute_contamination(list(rows.items()), items) if not hit}
        elif name == "mixture":
            assert set(got) <= set(rows) and max(map(got.count, set(got))) <= 2
        else:
            assert len(got) == docs.count()
        if name != "shards":
            assert out.columns == columns
        docs = out


def test_repeated_and_missing_ids(spark):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau"
    rows = [(1, "one two three", "en", "a", 13), (1, "one two three", "en", "a", 13), (None, "no id at all", None, None, 12), (2, None, "en", "a", 0), (3, long, "en", "a", 90), (4, long + " x", "en", "a", 92)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.known_language(spark, docs, SMALL)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 1, 3, 4, None]
    single = pipeline.one_of_each(spark, kept, SMALL)
    assert sorted((r.doc_id for r in single.collect()), key=str) == [1, 1, 3, None]
    clean = pipeline.without_benchmarks(spark, single, SMALL)
    assert clean.count() == 4
    assert clean.groupBy("doc_id").count().join(pipeline.mixed(spark, clean, SMALL).groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").filter("n > 2 * count").isEmpty()


def test_empty_corpus(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    got = QUERIES[name](spark, SMALL)
    cur = con.execute(ORACLES[name])
    order = [d[0] for d in cur.description]
    assert sorted(order) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*order).collect()))) == sorted(map(repr, cur.fetchall()))

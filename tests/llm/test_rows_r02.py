"""Rows of repeated or missing ids in the pipeline, one by one."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as pipeline
from tests.llm.test_llm_operators import sentence
from tidewait.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_one_bad_row_takes_no_other(spark, tmp_path):
    """Several different rows of no id, and of id 7: one of each without a letter, contaminated, or a near copy."""
    item, base = sentence(1, 12), sentence(2, 60)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = []
    for doc_id in (None, 7):
        rows += [(doc_id, sentence(10 + k + (doc_id or 0), 40), "en", "a", k) for k in range(3)]
        rows += [(doc_id, "123 ... 456", "en", "a", 11), (doc_id, f"{sentence(30 + (doc_id or 0), 40)} {item}", "en", "a", 12)]
        rows += [(doc_id, base + tail, "en", "a", 13) for tail in ("", " tail", " other")]
    rows += [(9, "987", None, "en", 1), (9, "letters here", "en", None, 1), (9, "letters here", None, "en", 1)]
    docs = table(spark, rows)
    lettered = pipeline.known_language(spark, docs, str(tmp_path))
    assert Counter(map(tuple, lettered.collect())) == Counter(r for r in rows if any(c.isalpha() for c in r[1]))
    single = [tuple(r) for r in pipeline.one_of_each(spark, docs, str(tmp_path)).collect()]
    near = [r for r in single if r[1].startswith(base)]
    assert len(near) == 1 and near[0][0] == 7  # the smallest id, none last
    assert len([r for r in single if r[1] == "letters here"]) == 1  # equal texts whose nulls are elsewhere are two rows
    assert len(single) == len({r[1] for r in rows if not r[1].startswith(base)}) + 1
    clean = pipeline.without_benchmarks(spark, docs, str(tmp_path))
    assert Counter(map(tuple, clean.collect())) == Counter(r for r in rows if item not in r[1])


def test_copies_of_the_mixture_by_row(spark):
    rows = [(None if k % 3 else k % 2, sentence(k, 5 + k % 40), "en", "abc"[k % 3], k) for k in range(240)] + [(5, "equal row here", "en", "a", 1)] * 7
    docs = table(spark, rows)
    got = Counter(tuple(r) for r in pipeline.mixed(spark, docs, "").collect())
    targets = {r.source: r.target for r in mixing.pareto_mix(docs).collect()}
    for source, target in targets.items():
        taken = sum(n * len(r[1].split()) for r, n in got.items() if r[3] == source)
        assert abs(taken - target) <= max(len(r[1].split()) for r in rows if r[3] == source) / 2 + 1e-6
    assert set(got) <= set(rows) and all(n <= 2 * rows.count(r) for r, n in got.items())

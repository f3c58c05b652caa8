"""The Jaccard join checks few pairs a set, each of them once, however many fragments there are."""

from __future__ import annotations

import numpy as np
import pytest

from tests.llm.test_llm_operators import brute_components, sentence
from tidewait.llm import jaccard


@pytest.mark.parametrize("fragment", [1 << 20, 200])
def test_pairs_checked_do_not_grow_with_the_fragments(spark, monkeypatch, fragment):
    monkeypatch.setattr(jaccard, "FRAGMENT", fragment)
    tables, written = {}, jaccard.written

    def kept(df, label):
        tables.setdefault(label, []).append(written(df, label))
        return tables[label][-1]

    monkeypatch.setattr(jaccard, "written", kept)
    rng = np.random.default_rng(12)
    base, rows = [sentence(40 + k, 90).split() for k in range(2)], []
    for k in range(120):
        text = list(base[k % 2])
        for at in rng.choice(90, int(rng.integers(0, 4)), replace=False):
            text[at] = f"e{rng.integers(1000)}"
        rows.append((k * 7 % 120, " ".join(text[: int(rng.integers(76, 91))])))
    rows += rows[:3]  # equal rows are one set
    out = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    sets = tables["jaccard-survivors"][0].count()
    assert sets > 100
    assert tables["jaccard-pairs"][0].count() <= jaccard.PARTNERS * sets
    assert sorted(r.sig for r in tables["jaccard-sets"][0].collect()) == sorted(r.sig for r in tables["jaccard-survivors"][0].collect())
    want = brute_components(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in out} == set(want) and len(out) == sum(want.values())


def test_a_pair_is_checked_by_its_whole_sets(spark):
    sets = spark.createDataFrame([(1, [*range(10)]), (2, [*range(1, 10)]), (3, [*range(3, 12)]), (4, [*range(2, 10)])], "sig long, grams array<long>")
    pairs = spark.createDataFrame([(2, 1), (2, 1), (3, 1), (4, 1), (4, 2)], "a long, b long")
    # 9 of 10, 7 of 12, 8 of 10, 8 of 9
    assert sorted((r.a, r.b) for r in jaccard._links(pairs, sets).collect()) == [(2, 1), (4, 1), (4, 2)]

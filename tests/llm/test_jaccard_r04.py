"""A large family of edited copies: most pairs of it that do not link are told by their sketches and never checked."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_llm_operators import brute_components, sentence
from tidewait.llm import jaccard


def family(copies: int, words: int, most: int, seed: int) -> list[str]:
    rng = np.random.default_rng(seed)
    base, out = sentence(seed, words).split(), []
    for _ in range(copies):
        text = list(base)
        for at in rng.choice(words, int(rng.integers(0, most)), replace=False):
            text[at] = f"e{rng.integers(1000)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("fragment", [1 << 20, 500])
def test_pairs_checked_grow_with_the_sets(spark, monkeypatch, fragment):
    monkeypatch.setattr(jaccard, "FRAGMENT", fragment)
    tables, written = {}, jaccard.written

    def kept(df, label):
        tables.setdefault(label, []).append(written(df, label))
        return tables[label][-1]

    monkeypatch.setattr(jaccard, "written", kept)
    rows = list(enumerate(family(220, 120, 9, 31) + family(60, 90, 9, 32) + family(2, 70, 2, 33)))
    out = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = brute_components(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in out} == set(want) and len(out) == sum(want.values())
    sets = tables["jaccard-survivors"][0].count()
    assert sets > 100
    assert sum(t.count() for t in tables["jaccard-pairs"]) <= 2 * jaccard.PARTNERS * sets


def cut(sets: list[np.ndarray], roots: list[int], bits: int = 0) -> pa.Table:
    columns = [
        pa.array(range(len(sets)), pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(roots, pa.int64()),
        pa.array([len(s) for s in sets], pa.int64()), pa.array([[s.tobytes()] for s in sets], pa.list_(pa.binary())),
    ]
    return pa.Table.from_batches(jaccard._cut_open(bits)(iter([pa.record_batch(columns, ["sig", "n", "root", "have", "grams"])])))


def alike(x: np.ndarray, y: np.ndarray) -> float:
    common = len(np.intersect1d(x, y))
    return common / (len(x) + len(y) - common)


def test_sketches_never_tell_too_little():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(np.concatenate([base[: n - k], rng.integers(0, 2**63, k, dtype=np.uint64)])) for n in (1, 14, 60, 65, 900, 1100, 3000) for k in (0, n // 9, n // 3)]
    f = jaccard._Fragment(cut(sets, [*range(len(sets))]))
    a, b = np.triu_indices(len(sets), 1)
    told = f.alike(a, b)
    true = np.array([alike(sets[f.sig[x]], sets[f.sig[y]]) for x, y in zip(a, b, strict=True)])
    assert (told >= true - 1e-12).all() and (told[true == 1] == 1).all()
    near = (true > 0.65) & (f.size[a] > 500)
    assert near.sum() > 5 and (told - true)[near].max() < 0.1


@pytest.mark.parametrize("expand", [1 << 20, 64])
def test_last_round_finds_all_pairs_across_components(monkeypatch, expand):
    monkeypatch.setattr(jaccard, "EXPAND", expand)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 100, dtype=np.uint64) * np.uint64(2)
    sets, roots = [], []
    for k in range(40):
        gone = rng.choice(100, int(rng.integers(0, 16)), replace=False)
        sets.append(np.unique(np.concatenate([np.delete(base, gone), rng.integers(0, 2**63, len(gone) // 2, dtype=np.uint64)])))
        roots.append(k % 3 if k % 4 else k)
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if roots[a] != roots[b] and alike(sets[a], sets[b]) >= 0.8}
    found = set()
    segments = cut(sets, roots, bits=2)
    for k in range(4):
        part = segments.filter(pa.compute.equal(segments.column("fragment"), k))
        found |= {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in jaccard._across(None)(part).to_pylist()}
        few = jaccard._across(2)(part)
        assert len(few) <= 2 * 40 and all(roots[r["a"]] != roots[r["b"]] for r in few.to_pylist())
    assert len(want) > 50 and want <= found
    assert all(roots[a] != roots[b] for a, b in found)


def test_only_ngrams_of_several_components_are_left():
    of = lambda *x: np.array(x, np.uint64)
    sets = [of(1, 2, 3), of(2, 3, 4), of(3, 4, 9), of(8)]
    rows, _ = jaccard._cut_grams(np.arange(4), np.array([3, 3, 3, 1]), np.array([3, 3, 3, 1]), np.concatenate(sets), 0)
    known = pa.table({"known": pa.array([0, 1, 2, 3], pa.int64()), "root": pa.array([0, 0, 2, 3], pa.int64())})
    out = {r["sig"]: (r["n"], r["root"], np.frombuffer(r["grams"], np.uint64).tolist()) for r in jaccard._outside(pa.Table.from_batches([rows]), known).to_pylist()}
    assert out == {0: (3, 0, [3]), 1: (3, 0, [3, 4]), 2: (3, 2, [3, 4])}

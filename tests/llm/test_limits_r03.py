"""Many labels, small pools, crowded blocks and position resets: nothing is left out by a size."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from tests.llm.test_llm_operators import sentence, vocabulary
from tidewait.llm import language, oracles, packing, quality, queries

LABELS = 300


def spelled(k: int, words: int, seed: int) -> str:
    """Words over four letters of their own for every label."""
    letters = np.random.default_rng(k).permutation(list("abcdefghijklmnopqrstuvwxyzäöüßéèàñçøåæœłşğ"))[:4]
    rng = np.random.default_rng(100_000 + seed)
    return " ".join("".join(rng.choice(letters, 5)) for _ in range(words))


def test_every_label_is_learnt(spark):
    rows = [(k * 10 + j, spelled(k, 50, k * 10 + j), f"l{k:03}") for k in range(LABELS) for j in range(2)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = language.learn(table, total_chars=60_000)
    assert len(samples) == LABELS and sum(map(len, samples.values())) <= 60_000 + 2 * LABELS
    letters, tables, _ = language._automata(tuple(sorted(samples.items())))
    assert sum(t.base.nbytes + t.entry.nbytes + t.root.nbytes for t in tables) < 80 * 60_000
    ask = spark.createDataFrame([(k, spelled(k, 30, 5000 + k)) for k in range(0, LABELS, 7)], "doc_id long, text string")
    found = {r.doc_id: r.lang_pred for r in language.identify(ask, samples).collect()}
    right = sum(lang == f"l{k:03}" for k, lang in found.items())
    assert right >= 0.9 * len(found)


def test_shares():
    assert language.shares(4, 32, 1024, 1 << 22) == (32, 1024)
    for labels in (100, 128, 129, 300, 5000, 100_000):
        docs, chars = language.shares(labels, 32, 1024, 1 << 22)
        assert 1 <= docs <= 32 and 1 <= chars <= 1024 and labels * docs * chars <= 1 << 22


def _estimates(x: np.ndarray, core: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum covariance determinant by concentration steps from two starts, in matrices."""
    floor = np.diag(np.square(quality.FLOORS))

    def rank(values, p):
        return np.sort(values)[max(0, int(np.ceil(p * len(values))) - 1)]

    def d2(m, c):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    q = np.array([[rank(x[:, i], p) for p in (0.25, 0.5, 0.75)] for i in range(5)])
    best = None
    for m, c in ((q[:, 1], np.diag(((q[:, 2] - q[:, 0]) / 1.349) ** 2) + floor), (x.mean(axis=0), np.cov(x.T, bias=True) + floor)):
        for _ in range(steps):
            d = d2(m, c)
            inner = x[d <= rank(d, core) + 1e-12]
            m, c = inner.mean(axis=0), np.cov(inner.T, bias=True) + floor
        if best is None or np.linalg.slogdet(c)[1] < best[0] - 1e-9:
            best = np.linalg.slogdet(c)[1], m, c
    return best[1], best[2]


@pytest.mark.parametrize("n", [50, 230])
def test_verdict_by_matrices(spark, n):
    """Small and large tables against an estimate in numpy: distance and verdict of every document that passes the base rule."""
    rows = [(k, sentence(7000 + k, 60 + 3 * (k % 40)), "en", "a") for k in range(n)]
    rows += [(1000 + k, sentence(8000 + k, 90).translate(str.maketrans("abcd", "#$%#")), "en", "b") for k in range(4)] + [(2000, "few words", "xx", None)]
    out = quality.robust_outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    good = [r for r in out if not r.base_failed]
    assert len(good) == n + 4 and all(r.distance is not None for r in good)
    vectors = {
        r.doc_id: np.array([
            np.log1p(r.n_words), np.log(r.word_chars / r.n_words), np.log1p(100 * r.n_symbols / r.word_chars),
            np.log1p(r.n_dup_lines), np.log1p(100 * r.n_repeat_words / r.n_words),
        ])
        for r in good
    }
    every = np.array(list(vectors.values()))
    own = np.array([v for k, v in vectors.items() if k < 1000])

    def distances(of: np.ndarray) -> dict[int, float]:
        m, c = _estimates(of, 0.75, 3)
        inverse = np.linalg.inv(c)
        middle = np.sort([v @ inverse @ v for v in of - m])[int(np.ceil(len(of) / 2)) - 1]
        return {k: (v - m) @ inverse @ (v - m) * quality.CHI2_MEDIAN / max(middle, quality.CHI2_MEDIAN) for k, v in vectors.items()}

    pooled = distances(every)
    apart = distances(own) if n >= 100 else pooled
    for r in good:
        want = (apart if r.doc_id < 1000 else pooled)[r.doc_id]
        assert r.distance == pytest.approx(want, rel=1e-6) and r.kept == (want <= 20.515)
    assert not any(r.kept for r in good if r.doc_id >= 1000) and all(r.kept for r in good if r.doc_id < 1000)


def test_crowded_block_equals_sql(spark, tmp_path):
    """3,000 turns of three numbers in one block: the query's rows, parts and texts are those of its SQL."""
    rows = [(1, k % 3, "abc"[k % 3] if k % 7 else None, f"turn {k} <|im_end|>") for k in range(3000)]
    rows += [(2, k, "ab"[k % 2], f"t{k}") for k in range(130)] + [(None, None, "a", None)] * 1100
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op2_perspective_rotation(spark, str(tmp_path))
    base = duckdb.connect()
    base.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = base.execute(oracles.CHAT)
    names = [c[0] for c in want.description]
    assert set(names) == set(got.columns)
    have = sorted(map(str, (tuple(r[c] for c in names) for r in got.collect())))
    assert have == sorted(map(str, want.fetchall())) and any(r.part == 2 for r in got.collect())


def test_position_resets(spark):
    path, pattern = vocabulary()
    rows = [(k, None if k % 9 == 8 else sentence(k, 5 + 11 * (k % 8)), "x") for k in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, resets string")
    for r in packing.pack_tokens(table, path, pattern, length=64).collect():
        positions = packing.position_ids(r.cu_seqlens, 64)
        assert r.resets == [k for k in range(64) if positions[k] == 0]
    with pytest.raises(ValueError, match="do not fit"):
        packing.pack_tokens(table, path, pattern, dtype="u1")

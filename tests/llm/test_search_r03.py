"""Top-k, hard negatives and the source audit against plain Python, with hostile rows and small blocks."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidewait.llm import divergence, negatives, topk, vectors
from tidewait.llm.transducer import LOWERED, Transducer, build, ordinals, term_spans

VECTORS = "vec_id long, embedding array<double>, label int, v string, class int, row int, score string, tie double, best string, query int, id int, asks int"
MOST = 2**63 - 1


def hostile_vectors(seed: int, n: int = 240) -> list[tuple]:
    rng = np.random.default_rng(seed)
    hot = [0.5, -0.25, 0.125, 1.0]
    out = []
    for i in range(n):
        kind = i % 6
        x = hot if kind < 2 else (np.array(hot) + rng.normal(0, 0.02, 4)).tolist() if kind == 2 else rng.normal(0, 1, 4).tolist()
        out.append((i, x, int(rng.integers(0, 3))))
    out += [
        (300, None, 1), (301, [1.0, None, 0.0, 0.0], 1), (302, [math.nan, 0.0, 0.0, 0.0], 1), (303, [math.inf, 0.0, 0.0, 0.0], 2), (304, [], 1), (305, [0.25], 1),
        (306, [1.0, 2.0, 3.0, 4.0], None), (307, [0.0, 0.0, 0.0, 0.0], 0), (350, [0.0, 0.0, 0.0, 0.0], 0), (None, [0.5, 0.5, 0.5, 0.5], 1), (None, hot, 1),
        (100, [1.0, 1.0, 1.0, 1.0], 1), (100, [1.0, 1.0, 1.0, 1.0], 1), (100, [-1.0, 0.5, 0.0, 0.0], 2), (400, [1e15, -1e15, 1e12, 3.0], 1), (401, [1e18, 1e18, 0.0, 0.0], 2),
        (-50, [0.1, 0.2, 0.3, 0.4], 1),
    ]
    return [(*r, "x", 1, 2, "s", 0.5, "b", 3, 4, 5) for r in out]


def usable(rows, labelled: bool = False):
    found = []
    for at, (i, x, label, *_) in enumerate(rows):
        if x is None or any(c is None or not math.isfinite(c) for c in x) or (labelled and label is None):
            continue
        found.append((at, i, [max(-MOST - 1, min(MOST, math.floor(256 * c))) for c in x], label))
    return found


def product(a, b) -> int:
    return max(-MOST - 1, min(MOST, sum(p * q for p, q in zip(a, b, strict=False))))


def by_score(x):
    return (-x[0], x[1] is None, x[1] or 0)


def top_k(rows, step: int, k: int):
    """Ranked (score, id) lists per query; rows of one id and score are the same answer."""
    found = usable(rows)
    out = []
    for at, i, x, _ in found:
        if i is not None and i % step == 0:
            others = sorted(((product(x, y), j) for b, j, y, _ in found if b != at), key=by_score)[:k]
            out += [(i, r + 1, j, s) for r, (s, j) in enumerate(others)]
    return Counter(out)


@pytest.mark.parametrize("blocks", [(1 << 14, 1 << 12), (16, 4)])
@pytest.mark.parametrize("slices", [2, 3])
def test_top_k_is_brute_force(spark, monkeypatch, blocks, slices):
    monkeypatch.setattr(topk, "ROWS", blocks[0])
    monkeypatch.setattr(topk, "QUERIES", blocks[1])
    rows = hostile_vectors(slices)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = topk.exact_top_k(df, F.col("vec_id") % 10 == 0, slices=slices)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert Counter(tuple(r) for r in got.collect()) == top_k(rows, 10, 5)


def test_top_k_of_few_and_of_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    got = topk.exact_top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 256 * 512), (0, 2, 2, 256 * 512)]
    assert topk.exact_top_k(df.filter("false"), F.col("vec_id") == 0).count() == 0
    assert topk.exact_top_k(df, F.col("vec_id") == 9).count() == 0


def test_cutoff_spares_most_entries(spark, monkeypatch):
    """Phase two sends only entries that reach the even share of the threshold, and copies count as one class."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.125, 32).tolist()) for i in range(2000)] + [(2000 + i, [0.1] * 32) for i in range(1000)]
    sent = []
    keep = topk.written

    def watch(df, name):
        out = keep(df, name)
        if name == "topk-entries":
            sent.append(out.agg(F.sum(F.size("classes"))).first()[0])
        return out

    monkeypatch.setattr(topk, "written", watch)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    n = topk.exact_top_k(df, F.col("vec_id") % 100 == 0).count()
    assert n == 30 * 5
    assert sent[0] < 0.1 * 2 * 21 * 2001


def mined(rows, step: int, n_pos: int = 5, n_neg: int = 3):
    found = usable(rows, labelled=True)
    out = []
    for at, i, x, label in found:
        if i is None or i % step:
            continue
        scores = [(product(x, y), j, other) for b, j, y, other in found if b != at]
        mates = sorted((s for s in scores if s[2] == label), key=by_score)[:n_pos]
        for ps, p, _ in mates:
            near = sorted((s for s in scores if s[2] != label and 50 * ps <= 100 * s[0] <= 95 * ps), key=by_score)[:n_neg]
            out += [(i, p, r + 1, j, ps, s) for r, (s, j, _) in enumerate(near)]
    return Counter(out)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_are_brute_force(spark, monkeypatch, small):
    if small:
        for name, n in (("SAMPLE", 60), ("WAYS", 3), ("LEAF", 4), ("ROWS", 8), ("QUERIES", 4)):
            monkeypatch.setattr(negatives, name, n)
        monkeypatch.setattr(negatives, "planted", lambda sample, f=negatives.planted: f(sample, 3, 4))
    rows = hostile_vectors(7)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label"))
    assert Counter(tuple(r) for r in got.collect()) == mined(rows, 10)


def test_hard_negatives_of_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.5], 1)], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(df.filter("false"), F.col("vec_id") == 0, F.col("label")).count() == 0
    assert negatives.hard_negatives(df, F.col("vec_id") == 0, F.col("label")).count() == 0


def test_tree_leaves_out_siblings_and_loses_no_row():
    """On clustered rows most leaves are eliminated, and every row within a window is in one that is kept."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 40, (12, 8))
    rows = np.rint(centres[rng.integers(0, 12, 3000)] + rng.normal(0, 1, (3000, 8))).astype(np.int64)
    reach = float((rows.astype(float) ** 2).sum(axis=1).max())
    x = negatives.lifted(rows, reach)
    nodes, n = negatives.planted(x[:400], 4, 20)
    tree = negatives.Tree(8, reach, nodes, n, [], [])
    for node in nodes:
        tree.low.append(np.full((len(node.points),) * 2, np.inf))
        tree.high.append(np.full((len(node.points),) * 2, -np.inf))

    def visit(node, far, owner):
        for j in np.unique(owner):
            tree.low[node][:, j] = np.minimum(tree.low[node][:, j], far[owner == j].min(axis=0))
            tree.high[node][:, j] = np.maximum(tree.high[node][:, j], far[owner == j].max(axis=0))

    leaf = negatives.descended(tree, x, visit)
    anchors = np.column_stack([rows[:50].astype(float), np.zeros(50)])
    scores = rows[:50] @ rows.T
    top = np.sort(scores, axis=1)[:, -5]
    squares = (anchors**2).sum(axis=1) + reach
    far = np.sqrt(squares - 2 * top)[:, None]
    kept = negatives.surviving(tree, anchors, np.zeros_like(far), far)
    hit, row = np.nonzero(scores >= top[:, None])
    assert kept[hit, leaf[row]].all()
    assert kept.mean() < 0.5


def test_products_are_exact_at_every_size():
    rng = np.random.default_rng(1)
    for scale in (2**8, 2**26, 2**29, 2**40):
        a, b = rng.integers(-scale, scale, (5, 7)), rng.integers(-scale, scale, (6, 7))
        want = np.clip(a.astype(object) @ b.astype(object).T, -MOST - 1, MOST)
        assert (vectors.products(a, b).astype(object) == want).all()


# -- The transducer and the audit


def minimal_states(words: list[bytes]) -> int:
    """States of the minimal automaton: different sets of endings over all beginnings that lead to a word."""
    ends: dict[bytes, set[bytes]] = defaultdict(set)
    for w in words:
        for k in range(len(w) + 1):
            ends[w[:k]].add(w[k:])
    return len({frozenset(e) for e in ends.values()})


def test_transducer_is_minimal_and_numbers_in_order():
    rng = np.random.default_rng(4)
    words = {"".join(rng.choice(list("abé"), int(rng.integers(1, 7)))) for _ in range(300)} | {"running", "walking", "talking", "x" * 500}
    terms = sorted(w.encode() for w in words)
    machine = Transducer.unpacked(build(terms).packed())
    assert len(machine.final) == minimal_states(terms)
    probe = [*terms, b"zz", b"runnin", b"runningg", b"x" * 499, "é".encode()[:1]]
    ends = np.cumsum([len(p) for p in probe])
    got = ordinals(machine, np.frombuffer(b"".join(probe), np.uint8), np.concatenate([[0], ends[:-1]]), ends)
    order = {t: k for k, t in enumerate(terms)}
    assert got.tolist() == [order.get(p, -1) for p in probe]
    assert ordinals(build([]), np.zeros(3, np.uint8), np.array([0]), np.array([3])).tolist() == [-1]


def test_terms_never_cross_texts():
    texts = ["", "Ab", "cd", " x-Y ", "", "é9ñ", "z"]
    data = [t.encode() for t in texts]
    ends = np.cumsum([len(d) for d in data])
    flat = LOWERED[np.frombuffer(b"".join(data), np.uint8)]
    starts, stops, per = term_spans(flat, ends)
    assert [bytes(flat[a:b]).decode() for a, b in zip(starts, stops, strict=True)] == ["ab", "cd", "x", "y", "é", "ñ", "z"]
    assert per.tolist() == [0, 1, 1, 2, 0, 2, 1]


TEXTS = "doc_id long, text string, lang string, source string, term string, n int, ordinal int, total int, v int, block int, item string, value int, rank int"
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audited(rows, min_docs: int, first: int):
    split = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(A_TO_Z))) for _, text, lang, source, *_ in rows]
    df = defaultdict(Counter)
    for lang, _, ts in split:
        df[lang].update(set(ts))
    kept = {lang: sorted((t for t, n in c.items() if n >= min_docs), key=str.encode) for lang, c in df.items()}
    groups, langs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, ts in split:
        fit = [t for t in ts if t in set(kept.get(lang, []))]
        groups[lang, source].update(fit)
        langs[lang].update(fit)

    def share(c, lang, t):
        return 1 + (10**9 * (c[t] + 5)) // (sum(c.values()) + 5 * len(kept[lang]))

    out = []
    for (lang, source), c in groups.items():
        terms = kept.get(lang, [])
        pairs = [(sum(abs(share(c, lang, t) - share(o, lang, t)) for t in terms), s) for (other, s), o in groups.items() if other == lang and s != source]
        over = [(share(c, lang, t) - share(langs[lang], lang, t), t) for t in terms if c[t]]
        for part, items in (("pair", pairs), ("term", [x for x in over if x[0] > 0])):
            ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, r + 1) for r, (value, item) in enumerate(ranked) if part == "pair" or r < first]
    return Counter(out)


@pytest.mark.parametrize("small", [False, True])
def test_audit_is_brute_force(spark, monkeypatch, small):
    if small:
        for name, n in (("PACK", 1), ("HELD", 3), ("BLOCK", 4)):
            monkeypatch.setattr(divergence, name, n)
        monkeypatch.setattr(divergence, "transducers", lambda terms, f=divergence.transducers: f(terms, 5))
    rng = np.random.default_rng(9)
    stock = ["".join(rng.choice(list("abcÉé中"), int(rng.integers(1, 4)))) for _ in range(40)] + ["y" * 3000]
    rows = []
    for i in range(150):
        source = "hot" if i % 3 == 0 else ["a", "b", None, "É"][i % 4]
        words = rng.choice(stock, int(rng.integers(0, 25))).tolist()
        rows.append((i, rng.choice([" ", "-1-", "\n"]).join(words), ["en", "de", None][i % 3 if i % 2 else 0], source))
    rows += [(0, "a b a B", "en", "a"), (0, "a b a B", "en", "a"), (None, None, None, None), (200, "", "xx", "one"), (201, "only few", "xx", "two"), (202, "same " * 20000, "en", "a"), (203, "999 !!", "fr", "a")]
    rows = [(*r, "t", 1, 2, 3, 4, 5, "i", 6, 7) for r in rows]
    df = spark.createDataFrame(rows, TEXTS).repartition(3)
    got = divergence.source_divergence(df, min_docs=6, first=5)
    assert Counter(tuple(r) for r in got.collect()) == audited(rows, 6, 5)
    assert divergence.source_divergence(df.filter("false")).count() == 0

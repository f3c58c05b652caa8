"""Each operator against plain Python on small tables with hostile rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidewait.llm import chat, components, decontaminate, jaccard, language, lines, mixing, packing, quality, sharding, suffixes

BLANK = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, at long, key string, k1 string, size string, found string"
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sentence(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), 4)) for _ in range(n))


def hostile() -> list[tuple]:
    """Nulls in every column, blanks, ties, repeated rows, copies, near copies, a long text, odd characters."""
    long = sentence(1, 3000)
    near = long.split()
    near[700] = "CHANGED"
    shared = sentence(2, 40)
    rows = [
        (0, long, "en", "a"), (1, " ".join(near), "en", "a"), (2, long, "en", None), (3, None, "en", "a"), (4, "", None, "b"),
        (5, " \t\n ", "en", "b"), (6, "\n\n", "de", "b"), (7, "one two", "en", "b"), (8, "ONE\ttwo", "en", "c"), (9, "one", "en", "c"),
        (10, f"Start {shared}\nmid\n{sentence(3, 30)}", "fr", "c"), (11, f"{sentence(4, 9)} {shared}", "fr", "a"),
        (12, "é" * 400, "fr", "a"), (13, "é" * 130 + "x", "fr", "a"), (14, "ÀÉ îö 中文 Ω", "zh", "a"), (14, "another text of one id", "en", "a"),
        (15, "same row", "en", "a"), (15, "same row", "en", "a"), (None, "no id here\nmid", "en", None), (None, None, None, None), (16, "1234 5678 !!", "en", "c"),
    ]
    rows += [(20 + k, f"Common line\n  COMMON LINE \r\n{sentence(50 + k, 60)}\ncommon line", "en", "hot") for k in range(12)]
    return [(*r, 1, 2, "clash", "clash", "clash", "clash") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(hostile(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def key(line: str) -> str:
    return line.strip(BLANK).translate(A_TO_Z)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# -- Line dedup


def test_lines(docs, none):
    rows = hostile()
    seen = Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")} if k)
    want = Counter()
    for r in rows:
        parts = (r[1] or "").split("\n")
        kept = [x for x in parts if not (key(x) and seen[key(x)] >= 10)]
        want[(r[0], len(parts), len(parts) - len(kept), "\n".join(kept))] += 1
    got = Counter(tuple(r) for r in lines.drop_common_lines(docs).collect())
    assert got == want
    assert sum(n for *_, n, _ in got) > 0
    assert lines.drop_common_lines(none).count() == 0


def test_line_of_one_document_counts_once(spark):
    one = spark.createDataFrame([(1, "\n".join(["again"] * 50))], "doc_id long, text string")
    assert lines.drop_common_lines(one).first().n_dropped == 0


# -- Chat


TURNS = "conv_id long, turn long, role string, text string, speaker string, block string"


def test_perspectives(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 2, "ann", "again"), (1, 2, "ann", "again"),
        (1, None, "bob", "early"), (1, 130, None, "late"), (2, 0, "system", "alone"), (None, 0, "x", "lost"), (None, None, None, None),
    ]
    got = chat.rotate_perspectives(spark.createDataFrame([(*r, "s", "b") for r in rows], TURNS)).collect()
    want = {}
    for conv in {r[0] for r in rows}:
        turns = sorted({(-1 if t is None else t, role or "unknown", text or "") for c, t, role, text in rows if c == conv})
        for speaker in {r for _, r, _ in turns} - {"system"}:
            for block in {t // 64 for t, *_ in turns}:
                out, mask = "", []
                for t, role, text in turns:
                    if t // 64 != block:
                        continue
                    head = "assistant" if role == speaker else "system" if role == "system" else f"user name={role}"
                    out += f"<|im_start|>{head}\n"
                    start = len(out)
                    out += text.replace("<|", "<\\|") + "<|im_end|>\n"
                    if role == speaker:
                        mask.append((start, len(out) - 1))
                want[(conv, speaker, block)] = (out, mask)
    assert {(r.conv_id, r.speaker, r.block): (r.text, [tuple(m) for m in r.mask]) for r in got} == want
    assert len(got) == len(want)
    for r in got:
        assert all(r.text[a:b].endswith("<|im_end|>") for a, b in r.mask)
    assert chat.rotate_perspectives(spark.createDataFrame([], TURNS)).count() == 0


# -- Jaccard


def grams(text: str | None) -> set[tuple[str, ...]]:
    w = [x.translate(A_TO_Z) for x in words(text)]
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def brute_components(rows: list[tuple]) -> Counter:
    sets = [grams(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in set(group)}
    return Counter((r[0], len(s), least[g] if s else r[0]) for r, s, g in zip(rows, sets, group, strict=True))


def test_near_duplicates(docs, none):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect())
    assert got == brute_components(hostile())
    assert jaccard.near_duplicates(none).count() == 0


@pytest.mark.parametrize("fragment", [1 << 20, 300])
def test_near_duplicate_groups(spark, monkeypatch, fragment):
    """Many copies with edits around the limit, and a passage that unlike texts share; also in many fragments."""
    monkeypatch.setattr(jaccard, "FRAGMENT", fragment)
    rng = np.random.default_rng(11)
    base, rows = [sentence(90 + k, 80).split() for k in range(3)], []
    for k in range(90):
        text = list(base[k % 3])
        for at in rng.choice(80, int(rng.integers(0, 5)), replace=False):
            text[at] = f"e{rng.integers(1000)}"
        rows.append((k * 7 % 90, " ".join(text[: int(rng.integers(70, 81))])))
    rows += [(100 + k, " ".join(base[0]) + " " + sentence(500 + k, int(rng.integers(5, 90)))) for k in range(30)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert got == brute_components(rows)


def test_components_of_a_long_chain(spark):
    ids = np.random.default_rng(3).permutation(400).tolist()
    links = list(zip(ids[:300], ids[1:300], strict=False)) + [(ids[310], ids[311]), (ids[311], ids[310]), (ids[320], ids[320])]
    found = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert len({found[x] for x in ids[:300]}) == 1
    assert found[ids[310]] == found[ids[311]] != found[ids[0]]
    assert len(found) == 302


# -- Decontamination


def item_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_TO_Z))


def brute_contamination(rows, items):
    out = Counter()
    for doc_id, text in rows:
        w, hit, found = item_words(text), set(), set()
        for item_id, item in items:
            x = item_words(item)
            n = min(10, len(x))
            for s in range(len(x) - n + 1) if x else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[s : s + n]:
                        hit |= set(range(p, p + n))
                        found |= {str(item_id)} - {"None"}
        out[(doc_id, len(w), len(hit), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())] += 1
    return out


def test_contamination(spark, docs, none):
    shared = sentence(2, 40)
    items = [
        (10, shared), (9, shared.upper()), (1, "ONE, two!"), (2, "the the the the the the the the the the the the"), (3, None), (4, "..."), (5, "one"),
        (None, "no id here"), (10, shared), (11, sentence(1, 25)), (12, "中文"),
    ]
    table = spark.createDataFrame([(*i, "x", "y") for i in items], "item_id int, text string, item string, terms string")
    rows = [(r[0], r[1]) for r in hostile()]
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.items_sha256) for r in decontaminate.contamination(docs, table).collect())
    assert got == brute_contamination(rows, items)
    assert decontaminate.contamination(none, table).count() == 0
    assert decontaminate.contamination(docs, table.limit(0)).filter("n_hit > 0").count() == 0


def test_repeated_common_words(spark):
    """Windows of one word over and over, where every term is as frequent as any."""
    rows = [(1, "the " * 30), (2, "a " + "the " * 9 + "b"), (3, "the " * 10)]
    items = [(1, "the " * 12), (2, "x " * 12)]
    got = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.items_sha256) for r in got.collect()) == brute_contamination(rows, items)


def test_proximity(spark):
    item = "alpha " + sentence(5, 8) + " omega"
    loose = "alpha filler filler " + sentence(5, 8) + " filler omega"
    got = decontaminate.contamination(
        spark.createDataFrame([(1, loose), (2, item), (3, "alpha"), (4, sentence(9, 50))], "doc_id long, text string"),
        spark.createDataFrame([(1, item)], "item_id long, text string"),
    )
    assert {r.doc_id: (r.n_hit > 0, r.n_near) for r in got.collect()} == {1: (False, 1), 2: (True, 1), 3: (False, 0), 4: (False, 0)}


# -- Mixing


def test_mix(docs, none):
    rows = mixing.pareto_mix(docs).collect()
    sizes = defaultdict(int)
    for r in hostile():
        sizes[r[3]] += len(words(r[1]))
    goal, by = 1.5 * sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(by)}
    target, free = {}, set(by)
    while True:
        left = goal - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 2 * sizes[s]}
        if not over:
            break
        target |= {s: 2 * sizes[s] for s in over}
        free -= over
    target |= share
    taken = defaultdict(int)
    for r in rows:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        assert r.copies * r.size == r.taken and abs(r.copies - r.expected) < 1 + 1e-9
        taken[r.source] += r.taken
    longest = defaultdict(int)
    for r in rows:
        longest[r.source] = max(longest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1e-6 for s in by)
    assert len(rows) == len(hostile()) and sorted(map(str, rows)) == sorted(map(str, mixing.pareto_mix(docs.repartition(5)).collect()))
    assert mixing.pareto_mix(none).count() == 0


def test_pareto_inclusion(spark):
    """Over many seeds, documents are taken as often as expected."""
    table = spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int") * 3).alias("text"), F.lit("s").alias("source"))
    table = table.unionByName(spark.createDataFrame([(1000 + k, "w " * 400, "t") for k in range(2)], "doc_id long, text string, source string"))
    total, want = defaultdict(int), {}
    for seed in range(12):
        for r in mixing.pareto_mix(table, weights=(1, 3), share=0.8, seed=seed).filter("source = 's'").collect():
            total[r.size] += r.copies
            want[r.size] = want.get(r.size, 0) + r.expected
    assert all(abs(total[s] - want[s]) < 0.25 * want[s] for s in want)
    assert total[3] / want[3] == pytest.approx(1, abs=0.25)


# -- Quality


def test_statistics(docs):
    def stats(text):
        w = words(text)
        c, cover, seen, twice = Counter(zip(w, w[1:], w[2:], strict=False)), set(), set(), 0
        for k in range(len(w) - 2):
            if c[tuple(w[k : k + 3])] > 1:
                cover |= {k, k + 1, k + 2}
        for line in (text or "").split("\n"):
            if words(line):
                twice += line in seen
                seen.add(line)
        return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text or ""), twice, len(cover)

    extra = "a b c a b c x # <|> a b c\n\nline\nline\n line"
    more = docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(99).cast("long"), "text": F.lit(extra)}))
    got = Counter(tuple(r) for r in quality.text_statistics(more).collect())
    assert got == Counter((i, *stats(t)) for i, t in [(r[0], r[1]) for r in hostile()] + [(99, extra)])


def test_outliers(spark, docs, none):
    rows = [(k, sentence(1000 + k, 60 + k % 90), "en", "a") for k in range(260)] + [(900, ("#$%& word " * 100), None, None)]
    rows += [(1000 + k, " ".join(f"{x}###$$$" for x in sentence(3000 + k, 80).split()), "en", "a") for k in range(6)] + [(2000, "few words", "en", "a"), (2001, None, "en", "a")]
    got = {r.doc_id: r for r in quality.robust_outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == len(rows)
    assert all(not got[1000 + k].kept and not got[1000 + k].base_failed for k in range(6))
    assert all(got[k].kept for k in range(260))
    assert all(got[k].base_failed and not got[k].kept for k in (900, 2000, 2001))
    assert quality.robust_outliers(docs).count() == len(hostile())
    assert quality.robust_outliers(none).count() == 0


def test_distance_is_mahalanobis(spark):
    """Cell-by-cell factor and substitution against a matrix inverse, with one start and all rows in the core."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5))
    table = spark.createDataFrame([("g", 1, *map(float, r)) for r in x], "grp string, start int, f0 double, f1 double, f2 double, f3 double, f4 double")
    got = quality._measured(table, quality._factored(quality._moments(table), quality.FLOORS), ["grp", "start"]).select("f0", "d2").collect()
    cov = np.cov(x.T, bias=True) + np.diag(np.square(quality.FLOORS))
    d = x - x.mean(axis=0)
    want = dict(zip(x[:, 0].tolist(), np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d).tolist(), strict=True))
    assert all(r.d2 == pytest.approx(want[r.f0]) for r in got)


# -- Repeated strings


def brute_repeats(rows, match=100):
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, gone = set(), {}
    for r in order:
        data = (r[1] or "").encode()
        mask = [False] * len(data)
        for k in range(len(data) - match + 1):
            if (s := data[k : k + match]) in seen:
                mask[k : k + match] = [True] * match
            seen.add(s)
        gone[r] = mask
    out = Counter()
    for r in rows:
        data, mask = (r[1] or "").encode(), gone[r]
        runs = sum(m and not (k and mask[k - 1]) for k, m in enumerate(mask))
        out[(r[0], len(data), sum(mask), runs, bytes(b for b, m in zip(data, mask, strict=True) if not m))] += 1
    return out


def test_repeats(docs, none):
    got = Counter(tuple(r) for r in suffixes.drop_repeats(docs).collect())
    assert {k: v for k, v in got.items() if k[0] != 14} == {k: v for k, v in brute_repeats([(r[0], r[1]) for r in hostile()]).items() if k[0] != 14}
    assert suffixes.drop_repeats(none).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_repeats_everywhere(spark, monkeypatch, small):
    """Periodic texts, passages at many places and near copies; also over many buckets, shards and fragments."""
    if small:
        monkeypatch.setattr(suffixes, "BUCKET", 3000)
        monkeypatch.setattr(suffixes, "FRAGMENT", 20)
    rng = np.random.default_rng(8)
    passage, rows = sentence(70, 60), []
    for k in range(60):
        own = sentence(200 + k, int(rng.integers(5, 60)))
        cut = int(rng.integers(0, 150))
        text = [own, own + passage[cut:], passage[: 299 - cut] + own, "ab" * int(rng.integers(40, 200)), passage[:120] * 3, own + own][int(rng.integers(6))]
        rows.append((int(k * 37 % 60), text))
    got = Counter(tuple(r) for r in suffixes.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == brute_repeats(rows)


def test_merged_transforms_are_sorted():
    """After the merge, suffixes stand in the order of their first symbols and intervals are equal strings."""
    rng = np.random.default_rng(4)
    data = rng.choice(np.frombuffer(b"ab", np.uint8), 600)
    data[300:420] = data[100:220]
    sizes = np.array([260, 340])
    got = suffixes.repeated_strings(data, sizes, 100)
    seen, want = set(), []
    for a, b in ((0, 260), (260, 600)):
        for k in range(a, b - 99):
            want.append(data[k : k + 100].tobytes() in seen)
            seen.add(data[k : k + 100].tobytes())
    assert got.tolist() == want and any(want)


# -- Sharding


def test_shards(docs, none, spark):
    rows = sharding.assign_shards(docs, 4000).collect()
    size, count = defaultdict(int), defaultdict(int)
    for r in rows:
        size[r.shard] += r.n_bytes
        count[r.shard] += 1
    assert len(rows) == len(hostile())
    for r in rows:
        assert r.shard_bytes == size[r.shard] and r.shard_docs == count[r.shard] and len(r.shard) == r.depth + 1
        assert r.over_limit == (size[r.shard] > 4000) and (not r.over_limit or count[r.shard] == 1)
    names = sorted(size)
    assert not any(b.startswith(a) and a != b for a in names for b in names)
    assert sharding.assign_shards(none, 4000).count() == 0
    same = spark.createDataFrame([(1, "x" * 100)] * 5 + [(2, "y" * 30)], "doc_id long, text string")
    found = {r.doc_id: (r.shard_bytes, r.over_limit) for r in sharding.assign_shards(same, 200).collect()}
    assert found == {1: (500, True), 2: (30, False)}


def test_deep_split(spark):
    """More levels than one pass looks ahead."""
    table = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("z" * 10).alias("text"))
    rows = sharding.assign_shards(table, 10).collect()
    assert len({r.shard for r in rows}) == 3000 and max(r.depth for r in rows) > 20


def test_write_shards(spark, tmp_path):
    table = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("z" * 10).alias("text"))
    shards = sharding.assign_shards(table, 100)
    sharding.write_shards(table, shards, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").agg(F.sum(F.length("text")).alias("n")).filter("n > 100").count() == 0


# -- Packing


def vocabulary():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN


@pytest.mark.parametrize("block", [1 << 21, 500])
def test_packing_round_trip(spark, docs, none, tmp_path, monkeypatch, block):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", block)
    path, pattern = vocabulary()
    packing.write_packed(packing.pack_tokens(docs, path, pattern, length=64), str(tmp_path / "ids"))
    decode, parts = packing.decoder(path, pattern), defaultdict(list)
    rows = spark.read.parquet(str(tmp_path / "ids")).orderBy("task", "block", "row").collect()
    for r in rows:
        assert len(r.ids) == 128 and r.cu_seqlens[-1] == r.n_tokens <= 64 and len(r.cu_seqlens) == len(r.doc_ids) + 1
        positions = packing.position_ids(r.cu_seqlens, 64)
        for k, segment in enumerate(packing.segments(r.ids, r.cu_seqlens)):
            parts[r.doc_ids[k]].append((r.parts[k], decode(segment)))
            assert positions[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist() == list(range(len(segment)))
    single = {r[0]: r[1] for r in hostile() if r[0] not in (None, 14, 15)}
    for doc_id, text in single.items():
        assert b"".join(piece for _, piece in sorted(parts[doc_id])) == (text or "").encode()
    assert sum(part == 0 for found in parts.values() for part, _ in found) == len(hostile())
    assert packing.pack_tokens(none, path, pattern).count() == 0


def test_best_fit_decreasing():
    rng = np.random.default_rng(6)
    for _ in range(20):
        lengths = rng.integers(0, 33, int(rng.integers(0, 200)))
        bins = packing.best_fit_decreasing(lengths, 32)
        rooms, want = [], []
        for k in np.argsort(-lengths, kind="stable"):
            fits = [(room, b) for b, room in enumerate(rooms) if room >= lengths[k]]
            if fits:
                least = min(fits)[0]
                want.append(least)
                rooms[next(b for room, b in fits if room == least)] -= lengths[k]
            else:
                want.append(32)
                rooms.append(32 - lengths[k])
        assert sorted(sum(bins, [])) == list(range(len(lengths)))
        assert sorted(32 - int(lengths[b].sum()) for b in bins) == sorted(int(r) for r in rooms)


# -- Language


def test_language(spark, docs, none):
    train = [(k, sentence(k, 120), "low") for k in range(20)] + [(100 + k, sentence(k, 120).translate(str.maketrans("abcdefghij", "klmnopqrst")), "high") for k in range(20)]
    table = spark.createDataFrame(train + [(900, None, "low"), (901, "x", None)], "doc_id long, text string, lang string")
    samples = language.learn(table)
    assert set(samples) == {"low", "high"}
    ask = [(1, sentence(777, 30)), (2, sentence(778, 30).translate(str.maketrans("abcdefghij", "klmnopqrst"))), (3, None), (4, ""), (5, "12 ... 中?"), (6, "12 !"), (None, "klm nop")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(spark.createDataFrame(ask, "doc_id long, text string"), samples).collect()}
    assert got[1][0] == "low" and got[2][0] == "high" and got[None][0] == "high" and got[3] == got[4] == got[6] == ("und", 0.0) and got[5][0] != "und"
    assert all(0 <= s <= 1 for _, s in got.values())
    assert language.identify(docs, samples).count() == len(hostile()) and language.identify(none, samples).count() == 0
    assert {r.lang_pred for r in language.identify(docs, {}).collect()} == {"und"}


def test_phrases_are_longest_matches():
    sample = sentence(1, 60)
    letters, (table,), _ = language._automata((("x", sample),))
    known = language._collapsed(letters[np.frombuffer(sample.encode(), np.uint8)]).tobytes()
    texts = [sentence(2, 30), sample[:200], "zzz", "a"]
    symbols = [language._collapsed(letters[np.frombuffer(t.encode(), np.uint8)]) for t in texts]
    got = language.phrase_counts(np.concatenate(symbols), np.cumsum([len(s) for s in symbols]), [table])[0]
    for text, n in zip(symbols, got.tolist(), strict=True):
        phrases, at = 0, 0
        while at < len(text):
            width = 1
            while at + width < len(text) and text[at : at + width + 1].tobytes() in known and text[at : at + 1].tobytes() in known:
                width += 1
            phrases, at = phrases + 1, at + width
        assert n == phrases


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs, language.learn(docs.filter(~language.held_out(F.col("doc_id")))))
    judged = found.filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert judged.filter("lang = lang_pred").count() >= 0.97 * judged.count()

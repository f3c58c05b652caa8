"""A gram that many different pieces share."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa

from tests.llm.test_llm_operators import brute_repeats, sentence
from tidewait.llm import suffixes


def test_hot_gram_is_spread(spark, monkeypatch, tmp_path):
    """A passage in every text, with other context on both sides: no bucket gathers all pieces, and the result is exact."""
    monkeypatch.setattr(suffixes, "BUCKET", 20000)
    passage, merged = sentence(70, 30), suffixes._merged

    def watched(*args):
        merge = merged(*args)

        def counted(table: pa.Table) -> pa.Table:
            if table.column("bucket")[0].as_py() >= 0:
                name = f"{table.column('bucket')[0].as_py()}-{len(table)}-{table.column('piece').nbytes}"
                (tmp_path / name).touch()
            return merge(table)

        return counted

    monkeypatch.setattr(suffixes, "_merged", watched)
    rows = [(k * 37 % 700, sentence(100 + k, 12 + k % 7) + passage[k % 3 :] + sentence(5000 + k, 10)) for k in range(700)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(tuple(r) for r in suffixes.drop_repeats(table).collect())
    assert got == brute_repeats(rows)
    sizes = [int(p.name.split("-")[2]) for p in tmp_path.iterdir()]
    assert sizes and max(sizes) < 3 * 20000

"""Texts are brought to their keys once, whatever is joined to them."""

from __future__ import annotations

import hashlib

from tidewait.llm.suffixes import drop_repeats


def test_texts_are_shuffled_once(spark):
    shared = " ".join(f"word{k}" for k in range(40))
    texts = [(1, "head one " + shared), (2, shared + " tail two"), (2, "other text of one id " + shared[:150]), (None, shared), (5, shared), (6, None), (7, "short")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = drop_repeats(docs)
        plan = out._jdf.queryExecution().executedPlan().toString()
        rows = out.collect()
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)
    # The shuffle of whole texts that the last join reads is the one their runs were joined to.
    assert "ReusedExchange [doc_id" in plan, plan
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows), key=repr)
    # Brute force: null comes first, the two texts of one id follow an order of their own and repeat what others hold anyway (from the blank before, which the first text has too).
    n = len(shared)
    kept = {(None, shared): shared, (1, texts[0][1]): "head one ", (2, texts[1][1]): " tail two", (2, texts[2][1]): "other text of one id", (5, shared): "", (6, ""): "", (7, "short"): "short"}
    want = sorted(
        ((i, len(t), len(t) - len(k), int(len(k) < len(t)), hashlib.sha256(k.encode()).hexdigest()) for (i, t), k in kept.items()), key=repr
    )
    assert n > 200 and got == want

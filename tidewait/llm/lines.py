"""Line dedup: lines that many documents share are dropped from all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewait.llm.common import BLANKS, ascii_lower, row_key, written


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def drop_common_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept (the text without its common lines).

    Texts split at newlines. A line's key is the line without blanks at its ends, A-Z lowered; keys of
    at least min_chars code points in at least min_docs rows lose all their lines everywhere.

    Null or empty text: one empty line, kept as an empty text. Every row counts as a document, repeated
    rows and rows of one or no id too. A line that repeats inside one document counts once. Other columns
    are not read, whatever their names. An empty table gives an empty result.

    Plan: keys are made distinct inside each row and counted by 128-bit hash with partial sums, so a line
    in a third of all documents reaches the counting tasks once per map task. The frequent hashes are written;
    both sides of the join that marks lines are then plain exchanges, which Spark broadcasts if small and
    splits if one key is crowded. Only line positions travel back; each text moves once, by its row's key.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keys = F.transform(F.split(ascii_lower(F.col("text")), "\n"), lambda line: F.btrim(line, F.lit(BLANKS)))
    frequent = (
        rows.select(F.explode(F.array_distinct(keys)).alias("key"))
        .filter(F.length("key") >= min_chars)
        .select(*_hashes(F.col("key")))
        .groupBy("h1", "h2").count()
        .filter(F.col("count") >= min_docs)
        .select("h1", "h2")
    )
    frequent = written(frequent, "frequent-lines")
    key = F.btrim(F.col("line"), F.lit(BLANKS))
    marked = (
        rows.select(*row_key(F.col("doc_id"), F.col("text")), F.posexplode(F.split(ascii_lower(F.col("text")), "\n")).alias("at", "line"))
        .filter(F.length(key) >= min_chars)
        .select("k1", "k2", "at", *_hashes(key))
        .join(frequent, ["h1", "h2"])
        .groupBy("k1", "k2").agg(F.collect_set("at").alias("dropped"))
    )
    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.array_join(F.transform(stay, lambda at: F.get("lines", at)), "\n")
    return (
        rows.select("*", *row_key(F.col("doc_id"), F.col("text")))
        .join(marked, ["k1", "k2"], "left")
        .select("doc_id", "text", "dropped", lines.alias("lines"))
        .select(
            "doc_id", F.size("lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
            F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept).alias("kept"),
        )
    )

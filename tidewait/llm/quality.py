"""Quality rules: base limits, then robust multivariate outliers by minimum covariance determinant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewait.llm.common import BLANKS, word_array, written

SYMBOLS = "#*$%&|<>"
FEATURES = ("f0", "f1", "f2", "f3", "f4")
#: Standard deviation whose square is added to each feature's variance, so that a statistic most documents share is no yardstick of width 0.
FLOORS = (0.5, 0.1, 0.7, 0.7, 0.7)
CHI2_MEDIAN = 4.3515  # of five degrees of freedom


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every row, by column functions alone.

    Repeated three-word windows are found in the row: window hashes are compared with their distinct
    set first; only texts that repeat one sort (hash, place) pairs and look at their neighbours.
    Null text counts as empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, text.alias("text")).withColumn("words", word_array(F.col("text")))
    window = F.transform("words", lambda w, k: F.xxhash64(w, F.get("words", k + 1), F.get("words", k + 2)))
    lines = F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    rows = rows.select(
        "doc_id", *keep, F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(F.size("words") >= 3, F.slice(window, F.lit(1), F.size("words") - 2)).alias("windows"),
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.select(
        "*", F.when(repeats, F.sort_array(F.transform("windows", lambda h, k: F.struct(h.alias("h"), k.alias("k"))))).alias("sorted")
    )
    twins = F.filter("sorted", lambda x, k: (
        ((k > 0) & (F.get("sorted", k - 1)["h"] == x["h"])) | F.coalesce(F.get("sorted", k + 1)["h"] == x["h"], F.lit(False))
    ))
    rows = rows.withColumn("found", F.sort_array(F.transform(twins, lambda x: x["k"])))
    reach = F.transform("found", lambda at, k: F.least(F.lit(3), F.coalesce(F.get("found", k + 1) - at, F.lit(3))))
    covered = F.aggregate(reach, F.lit(0), lambda total, n: total + n)
    return rows.select(
        "doc_id", *keep, "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _transformed() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "f0": F.log1p(F.col("n_words").cast("double")),
        "f1": F.log(chars / words),
        "f2": F.log1p(F.lit(100.0) * F.col("n_symbols") / chars),
        "f3": F.log1p(F.col("n_dup_lines").cast("double")),
        "f4": F.log1p(F.lit(100.0) * F.col("n_repeat_words") / words),
    }


def _cells() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]


def _factored(estimates: DataFrame, floors: tuple[float, ...]) -> DataFrame:
    """Cholesky factor l_ij and log determinant of the covariances c_ij, cell by cell as columns."""
    for i, j in _cells():
        cell = F.col(f"c{i}{j}") + (floors[i] ** 2 if i == j else 0.0)
        for k in range(j):
            cell = cell - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        estimates = estimates.withColumn(f"l{i}{j}", F.sqrt(cell) if i == j else cell / F.col(f"l{j}{j}"))
    logdet = sum((F.log(f"l{i}{i}") for i in range(len(FEATURES))), F.lit(0.0))
    return estimates.select(
        "grp", "start", *[f"m{i}" for i in range(len(FEATURES))], *[f"l{i}{j}" for i, j in _cells()], logdet.alias("logdet")
    )


def _distance() -> dict[str, Column]:
    """Forward substitution: the squared Mahalanobis distance is the sum of the squares of y0..y4."""
    steps = {}
    for i in range(len(FEATURES)):
        rest = F.col(FEATURES[i]) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"y{j}")
        steps[f"y{i}"] = rest / F.col(f"l{i}{i}")
    return steps


def _measured(vectors: DataFrame, factors: DataFrame, on: list[str]) -> DataFrame:
    out = vectors.join(factors, on)
    for name, step in _distance().items():
        out = out.withColumn(name, step)
    square = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(len(FEATURES))), F.lit(0.0))
    return out.withColumn("d2", square)


def _moments(rows: DataFrame) -> DataFrame:
    return rows.groupBy("grp", "start").agg(
        *[F.avg(FEATURES[i]).alias(f"m{i}") for i in range(len(FEATURES))],
        *[F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}{j}") for i, j in _cells()],
    )


def robust_outliers(
    docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, core: float = 0.75, steps: int = 3, cutoff: float = 20.515,
    min_group: int = 100, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    floors: tuple[float, ...] = FLOORS,
) -> DataFrame:
    """One row per input row: doc_id, the five statistics, base_failed, distance, kept.

    base_failed: under min_words words, or more than max_repeat_percent of them in repeated three-word windows.
    The others become vectors of logarithms (length, mean word length, symbols per 100 characters, repeated
    lines, repeated words per 100). Per language and source, the `core` share of vectors with the least
    covariance determinant is sought by concentration steps from two starts (median and quartiles; mean and
    covariance); the better start of each group gives centre and scatter. distance is the squared Mahalanobis distance, reduced
    where needed so that its median is at most that of five normal variables; above cutoff the document is rejected (kept false). The
    default cutoff is the 0.999 quantile of chi-square with five degrees of freedom. It is held against distances that floors and the
    reduction have made smaller, so the rule in force is milder than that quantile: the squares of floors are added to the variances
    (a feature that hardly varies in its group then rejects from some 4.5 floors on: without symbols elsewhere, 22 of 100
    characters), and a group whose median is above that of five normal variables is measured in its own median.

    Null text has no words and fails the base rule. Null language or source is a value like others. Groups with
    fewer than min_group vectors are pooled by language; documents whose pool is still smaller are held against an estimate from all vectors
    of the table, so every document that passes the base rule is judged, in a table of any size. Rows of equal id
    are judged each by itself. Other columns are not read. An empty table gives an empty result.

    Plan: texts are read once; the narrow rows are written. Each step is two aggregations with partial sums (a
    percentile sketch, then moments), so a source of a third of all rows reaches no task as a whole; the
    estimates, a row per group and start, are written and joined back.
    """
    stats = text_statistics(docs.withColumns({"_lang": F.col(lang_col), "_source": F.col(source_col)}), id_col, text_col, ("_lang", "_source"))
    failed = (F.col("n_words") < min_words) | (F.lit(100) * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    lang = F.coalesce(F.concat(F.lit("="), F.col("_lang").cast("string")), F.lit("-"))
    both = F.concat(lang, F.lit("\n"), F.coalesce(F.concat(F.lit("="), F.col("_source").cast("string")), F.lit("-")))
    stats = written(stats.withColumns({"base_failed": failed, "lang_key": lang, "both_key": both}).drop("_lang", "_source"), "quality-rows")
    sizes = written(stats.filter("not base_failed").groupBy("lang_key", "both_key").count(), "quality-groups")
    small = sizes.filter(F.col("count") < min_group)
    pooled = small.groupBy("lang_key").agg(F.sum("count").alias("pool"))
    named = (
        sizes.join(pooled, "lang_key", "left")
        .select("both_key", F.when(F.col("count") >= min_group, F.col("both_key")).when(F.col("pool") >= min_group, F.col("lang_key")).otherwise("all").alias("grp"))
    )
    named = written(named, "quality-names")
    vectors = stats.filter("not base_failed").join(named, "both_key").select("grp", *[c.alias(n) for n, c in _transformed().items()])
    if not named.filter("grp = 'all'").isEmpty():
        vectors = vectors.filter("grp <> 'all'").unionByName(vectors.withColumn("grp", F.lit("all")))
    vectors = written(vectors, "quality-vectors")
    started = vectors.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))

    quartiles = vectors.groupBy("grp").agg(*[F.percentile_approx(f, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, f in enumerate(FEATURES)])
    spread = [((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349) ** 2 for i in range(len(FEATURES))]
    first = quartiles.select(
        "grp", F.lit(0).alias("start"), *[F.col(f"q{i}")[1].alias(f"m{i}") for i in range(len(FEATURES))],
        *[(spread[i] if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _cells()],
    )
    second = _moments(vectors.withColumn("start", F.lit(1)))
    factors = written(_factored(first.unionByName(second), floors), "mcd-start")
    for _ in range(steps):
        seen = _measured(started, factors, ["grp", "start"])
        limits = written(seen.groupBy("grp", "start").agg(F.percentile_approx("d2", core, 1000).alias("limit")), "mcd-limits")
        inner = _measured(started, factors.join(limits, ["grp", "start"]), ["grp", "start"]).filter("d2 <= limit")
        factors = written(_factored(_moments(inner), floors), "mcd-step")
    best = factors.groupBy("grp").agg(F.min_by(F.struct(*factors.columns[1:]), F.struct("logdet", "start")).alias("b")).select("grp", "b.*")
    best = written(best, "mcd-best")
    medians = _measured(vectors, best, ["grp"]).groupBy("grp").agg(F.percentile_approx("d2", 0.5, 1000).alias("middle"))
    judges = written(named.join(best.join(medians, "grp"), "grp"), "mcd-judges")
    judged = _measured(stats.withColumns(_transformed()), judges.withColumnRenamed("both_key", "_key"), F.col("both_key") == F.col("_key"))
    distance = F.when(
        ~F.col("base_failed"), F.col("d2") * CHI2_MEDIAN / F.greatest(F.col("middle"), F.lit(CHI2_MEDIAN))
    )
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    verdict = judged.select(*out, distance.alias("distance"))
    # Groups in which every document failed have no estimates.
    rest = stats.join(judges.select("both_key"), "both_key", "left_anti").select(*out, F.lit(None).cast("double").alias("distance"))
    return verdict.unionByName(rest).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True)))

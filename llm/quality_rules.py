"""Quality rules whose cutoffs limit false rejection, with DataFrame functions alone.

Labelled rows (quality 1 means good) are the holdout. Each rule is a number per document that grows
as the document gets worse; a cutoff on a grid rejects what lies above it. For each stratum and cutoff
the exact binomial test asks whether the true share of good documents above it can still exceed
``risk / rules``: the cutoff is certified if P(Binomial(n, risk / rules) <= rejected) is at most
``error / (strata * rules * cutoffs)`` (Bonferroni). So with probability ``1 - error`` no stratum loses
more than ``risk`` of its good documents to all rules together. Of the certified cutoffs of a rule the one
applies that rejects most bad rows less good rows; a stratum with too few labels certifies none and
then rejects nothing beyond the base rule.

NULL text counts as empty, a NULL stratum is a stratum of its own, labels that are NULL or without
a document are ignored, several labels of one document count once (good if any says so), and repeated
rows of a document are each judged alike. Empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.texts import BLANKS, written

SYMBOLS = "#*$%&|<>"
RISK = 0.05
ERROR = 0.05
GRID = 20
MOST = 10_000
RULES = ("symbols", "dup_lines", "repeats", "short_words", "long_words")


def base_signals(docs: DataFrame, key: str = "doc_id", stratum: str | None = "lang") -> DataFrame:
    """Per row: key, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Repeated windows are found per text by sorting (hash, position) of its 5-word windows: a window
    counts if a neighbour has its hash. The words covered are then the gaps between such positions, up to 5 each.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    level = F.col(stratum).cast("string") if stratum else F.lit(None).cast("string")
    trimmed = F.btrim(text, F.lit(BLANKS))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")
    first = docs.select(
        F.col(key).alias("doc_id"),
        level.alias("stratum"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1)).alias("words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    windows = F.transform(
        F.sequence(F.lit(1), F.size("words") - 4),
        lambda i: F.struct(F.xxhash64(*(F.get("words", i + j) for j in range(-1, 4))).alias("h"), i.alias("i")),
    )
    second = first.select(
        "doc_id", "stratum", "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= 5, F.array_sort(windows)).alias("sorted"),
    )
    same = lambda x, j: F.coalesce(F.get("sorted", j)["h"] == x["h"], F.lit(False))
    third = second.withColumn(
        "at",
        F.array_sort(F.transform(F.filter("sorted", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])),
    ).drop("sorted")
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(5), i - acc["last"])).cast("long").alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    fourth = third.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("at")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return fourth.withColumn("base_failed", failed)


def measures() -> dict[str, Column]:
    """Rule values in whole grid steps, so that equal cutoffs compare exactly."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbols": F.floor(1000 * F.col("n_symbols") / chars),
        "dup_lines": F.floor(1000 * F.col("n_dup_lines") / words),
        "repeats": F.floor(1000 * F.col("n_repeat_words") / words),
        "short_words": F.floor(1000 * words / chars),
        "long_words": F.floor(100 * chars / words),
    }


def log_factorial(k: Column) -> Column:
    """ln k! by Stirling's series, shifted by 8 steps; the error is below 1e-12 of the value."""
    z = k + 9.0
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    shift = F.log(k + 1.0)
    for j in range(2, 9):
        shift = shift + F.log(k + float(j))
    return series - shift


def binomial_tail(n: Column, x: Column, p: float) -> Column:
    """P(Binomial(n, p) <= x), summed downwards from x relative to its first term.

    Used where x < n p: terms then shrink at every step, and those further than 40 standard
    deviations plus 200 below x are far under the precision of a double.
    """
    n, x = n.cast("double"), x.cast("double")
    top = log_factorial(n) - log_factorial(x) - log_factorial(n - x) + x * math.log(p) + (n - x) * math.log1p(-p)
    reach = F.least(x, F.ceil(40 * F.sqrt(n * p * (1 - p))) + 200).cast("int")
    total = F.aggregate(
        F.when(reach >= 1, F.sequence(F.lit(1), reach)).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda acc, j: F.struct(
            (acc["term"] * (x - j + 1) * (1 - p) / ((n - x + j) * p)).alias("term"),
            (acc["sum"] + acc["term"] * (x - j + 1) * (1 - p) / ((n - x + j) * p)).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    return F.when(x >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * total))


def certified_cutoffs(labelled: DataFrame, risk: float = RISK, error: float = ERROR, grid: int = GRID) -> DataFrame:
    """Per stratum and rule the certified cutoff in force: (stratum, rule, cutoff, n, rejected, bound).

    ``labelled`` has stratum, the rule values, ``good`` and ``proposes``. A third of the labels proposes
    cutoffs, the lowest value for each of ``grid`` shares of rejected good rows (halving every two
    steps), and ranks them; the others certify them, so the test never sees the rows that chose its cutoff.
    Rows collapse to counts per stratum, rule and value before any window sees them; values are whole
    steps up to 10 000, so their number does not grow with the rows.
    """
    kinds = F.stack(F.lit(len(RULES)), *(x for r in RULES for x in (F.lit(r), F.col(r).cast("long")))).alias("rule", "value")
    tally = lambda side: F.sum(F.when(side, F.col("good").cast("long")).otherwise(F.lit(0).cast("long")))
    counts = (
        labelled.select("stratum", "good", "proposes", kinds)
        .groupBy("stratum", "rule", F.least("value", F.lit(MOST)).alias("value"))
        .agg(
            tally(F.col("proposes")).alias("p"),
            tally(~F.col("proposes")).alias("c"),
            F.count_if(F.col("proposes") & ~F.col("good")).alias("b"),
        )
    )
    whole = Window.partitionBy("stratum", "rule")
    above = whole.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    share = F.try_divide(F.coalesce(F.sum("p").over(above), none), F.sum("p").over(whole))
    step = F.when(share > 0, F.least(F.floor(-2 * F.log2(share)), F.lit(grid - 1))).otherwise(F.lit(grid - 1))
    values = counts.select(
        "stratum", "rule", "value", step.alias("step"),
        F.sum("c").over(whole).alias("n"), F.coalesce(F.sum("c").over(above), none).alias("rejected"),
        F.coalesce(F.sum(F.col("b") - F.col("p")).over(above), none).alias("net"),
    )
    tried = values.groupBy("stratum", "rule", "step").agg(F.min_by(F.struct("value", "n", "rejected", "net"), "value").alias("t"))
    tests = grid * max(1, values.select("stratum", "rule").distinct().count())
    bound = binomial_tail(F.col("n"), F.col("rejected"), risk / len(RULES))
    tested = tried.select("stratum", "rule", "t.*").where("n > 0").withColumn("bound", bound)
    best = tested.where(F.col("bound") <= error / tests).groupBy("stratum", "rule")
    pick = F.max_by(F.struct(F.col("value").alias("cutoff"), "n", "rejected", "bound"), F.struct("net", "value"))
    return best.agg(pick.alias("b")).select("stratum", "rule", "b.*")


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR, stratum: str = "lang") -> DataFrame:
    """Per row of ``docs`` its signals and whether it is kept.

    The signals are stored once; learning and judging both read them. The verdict joins one row of cutoffs per stratum. Strata are few by nature (languages); they join by
    key, and Spark broadcasts them only under its own size limit.
    """
    signals = written(base_signals(docs, stratum=stratum).withColumns(measures()), "signals")
    judged = (
        labels.select("doc_id", F.col("quality").cast("int").alias("q")).where("doc_id is not null and q is not null")
        .groupBy("doc_id").agg((F.max("q") == 1).alias("good"))
    )
    proposes = F.crc32(F.concat(F.lit("part "), F.col("doc_id")).cast("binary")) % 3 == 0
    labelled = signals.where(~F.col("base_failed")).join(judged, "doc_id").dropDuplicates(["doc_id"]).withColumn("proposes", proposes)
    cutoffs = certified_cutoffs(labelled, risk, error)
    wide = cutoffs.groupBy(F.col("stratum").alias("__s")).agg(*(F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"__{r}") for r in RULES))
    joined = signals.join(wide, F.col("stratum").eqNullSafe(F.col("__s")), "left")
    bad = F.lit(False)
    for r in RULES:
        bad = bad | F.coalesce(F.least(F.col(r), F.lit(MOST)) > F.col(f"__{r}"), F.lit(False))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~bad).alias("kept"),
    )

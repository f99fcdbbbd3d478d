"""Predictive power of features: preparation, mutual information, stability and score.

Mutual information is the plug-in estimate over a contingency table; continuous features
(and a continuous target) are cut into equal-frequency bins at exact quantiles first.
Stability over five 80 % subsamples needs no extra passes: every contingency cell carries
one count per subsample, so rows are expanded once per feature and collapse to cells
before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framevitals.functions import columns as C
from framevitals.functions import histogram as H
from framevitals.functions.moments import pearson
from framevitals.functions.quantiles import bin_number, exact_quantiles
from framevitals.operators.neighbours import NEIGHBOURS, neighbour_information
from framevitals.operators.plane import plane_information
from framevitals.operators.profile import column_report

# Limits and weights that results must agree on.
RUNS = 5
KEEP_BELOW = "cccd"  # first four hex digits of a hash: 80 % of all rows
MISSING_LABEL = "missing"
CHUNK = 20
MI_WEIGHT, CORR_WEIGHT = 0.6, 0.4
EPSILON = 1e-6
RISK_MI, RISK_STABILITY = 0.95, 0.9
BINS = 16


@dataclass(frozen=True)
class Feature:
    name: str
    value: Column  # never NULL
    discrete: bool
    numeric: bool
    edges: tuple[float, ...] = ()


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    name = C.check_target(df, target)
    return C.nan_to_null(df).where(C.ref(name).isNotNull())


def _facts(df: DataFrame) -> dict[str, dict]:
    return {r["column"]: r.asDict() for r in column_report(df).collect()}  # one row per column


def classifies(family: str, unique: int, rows: int) -> bool:
    """Whether a target of this family with so many values calls for classification."""
    if family in (C.STRING, C.BOOLEAN):
        return True
    return family == C.INTEGER and unique < min(20, rows * 0.1)


def task_type(df: DataFrame, target: str) -> DataFrame:
    """One row: target, family, n_unique, rows, task ('classification' or 'regression')."""
    name = C.check_target(df, target)
    known = drop_missing_target(df.select(C.ref(name)), name)
    family = C.families(df)[name]
    fact = _facts(known).get(name, {"n_unique": 0, "rows": 0})
    task = "classification" if classifies(family, fact["n_unique"] or 0, fact["rows"]) else "regression"
    return C.small_frame(
        df.sparkSession,
        "target string, family string, n_unique bigint, rows bigint, task string",
        [(name, family, fact["n_unique"], fact["rows"], task)],
    )


def features_of(
    known: DataFrame, target: str, bins: int = BINS, facts: dict[str, dict] | None = None
) -> tuple[list[Feature], bool, tuple[float, ...]]:
    """Prepared features in column order, whether the task is classification, target bin edges."""
    facts = _facts(known) if facts is None else facts
    families = C.families(known)
    if not facts:
        return [], True, ()
    rows = facts[target]["rows"]
    classify = classifies(families[target], facts[target]["n_unique"] or 0, rows)
    numeric = [
        c for c in C.numeric_columns(known, exclude=[target]) if (facts[c]["n_unique"] or 0) > 1
    ]
    cuts = tuple(i / bins for i in range(1, bins))
    wanted = {c: C.as_double(c) for c in numeric}
    if not classify and families[target] in (C.INTEGER, C.FRACTIONAL):
        wanted[target] = C.as_double(target)
    elif not classify:
        wanted[target] = C.micros(C.ref(target)).cast("double")
    quantiles = exact_quantiles(known, wanted, (*cuts, 0.5))

    out: list[Feature] = []
    for c in known.columns:
        if c == target or families[c] == C.NESTED or (facts[c]["n_unique"] or 0) <= 1:
            continue
        v = C.ref(c)
        if c in numeric:
            if facts[c]["missing"] > 0:
                out.append(Feature(f"{c}_missing", v.isNull().cast("bigint"), True, True))
            small = families[c] == C.INTEGER and facts[c]["n_unique"] < min(50, rows * 0.2)
            filled = F.coalesce(C.as_double(c), F.lit(quantiles[c][-1]), F.lit(0.0))
            out.append(Feature(c, filled, small, True, () if small else tuple(quantiles[c][:-1])))
        elif families[c] == C.DATETIME:
            for part, pick in (("year", F.year), ("month", F.month), ("day", F.dayofmonth)):
                out.append(Feature(f"{c}_{part}", F.coalesce(pick(v), F.lit(0)).cast("bigint"), True, True))
        else:
            out.append(Feature(c, F.coalesce(v.cast("string"), F.lit(MISSING_LABEL)), True, False))
    return out, classify, tuple(quantiles[target][:-1]) if target in quantiles else ()


def feature_list(df: DataFrame, target: str) -> DataFrame:
    """position, feature, discrete: what ``prepare_features`` produces."""
    made, _, _ = features_of(drop_missing_target(df, target), target.strip())
    rows = [(i, f.name, f.discrete) for i, f in enumerate(made)]
    return C.small_frame(df.sparkSession, "position int, feature string, discrete boolean", rows)


def prepare_features(df: DataFrame, target: str, keep: Sequence[str] = ()) -> DataFrame:
    """The prepared features as columns, plus the target and the ``keep`` columns as they are."""
    name = C.check_target(df, target)
    known = drop_missing_target(df, name)
    made, _, _ = features_of(known, name)
    plain = [C.ref(c).alias(c) for c in dict.fromkeys([*keep, name])]
    return known.select(*plain, *[f.value.alias(f.name) for f in made if f.name not in keep])


def _subsamples(keys: Sequence[Column], runs: int) -> list[Column]:
    """1 when a row is in subsample r: a portable hash of the row key, the same on every retry."""
    digits = F.md5(F.concat_ws("|", *keys).cast("binary"))
    out = []
    for r in range(runs):
        block, spot = divmod(r, 8)
        text = digits if block == 0 else F.md5(F.concat(digits, F.lit(f"|{block}")).cast("binary"))
        out.append((F.substring(text, 1 + 4 * spot, 4) < KEEP_BELOW).cast("bigint"))
    return out


def _n_ln_n(n: Column) -> Column:
    return F.when(n > 0, n * F.ln(n.cast("double"))).otherwise(0.0)


def _information(known: DataFrame, made: list[Feature], y: Column, members: list[Column]) -> DataFrame:
    """(position, mi_0 .. mi_k): mutual information of each feature with y in each subsample."""
    none_i, none_s = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    values, flat, cells = [], [F.col("y")], []
    for i, f in enumerate(made):
        values.append((f.value if f.numeric else H.text_key(f.value)).alias(f"v{i}"))
        v = F.col(f"v{i}")
        if not f.numeric:
            flat.append(v.alias(f"x{i}"))
            cells += [F.lit(i), none_i, F.col(f"x{i}")]
        else:
            flat.append((v.cast("bigint") if f.discrete else bin_number(v, f.edges)).alias(f"x{i}"))
            cells += [F.lit(i), F.col(f"x{i}"), none_s]
    label = len(made)  # a constant pseudo feature: its cells are the distribution of y itself
    cells += [F.lit(label), F.lit(0).cast("bigint"), none_s]
    members = [m.alias(f"m{r}") for r, m in enumerate(members)]
    runs = range(len(members))
    prepared = known.select(y.alias("y"), *values, *members)
    long = prepared.select(*flat, *[f"m{r}" for r in runs]).select(
        "y", *[f"m{r}" for r in runs], F.stack(F.lit(label + 1), *cells).alias("position", "xi", "xs")
    )
    table = long.groupBy("position", "xi", "xs", "y").agg(*[F.sum(f"m{r}").alias(f"n{r}") for r in runs])
    by_value = table.groupBy("position", "xi", "xs").agg(
        *[F.sum(f"n{r}").alias(f"n{r}") for r in runs], *[F.sum(_n_ln_n(F.col(f"n{r}"))).alias(f"xy{r}") for r in runs]
    )
    sums = by_value.groupBy("position").agg(
        *[F.sum(f"n{r}").cast("double").alias(f"n{r}") for r in runs],
        *[F.sum(f"xy{r}").alias(f"xy{r}") for r in runs],
        *[F.sum(_n_ln_n(F.col(f"n{r}"))).alias(f"x{r}") for r in runs],
    )
    everything = Window.partitionBy()  # one row per feature
    y_sums = [F.max(F.when(F.col("position") == label, F.col(f"xy{r}"))).over(everything).alias(f"y{r}") for r in runs]

    def mi(r: int) -> Column:
        n = F.nullif(F.col(f"n{r}"), F.lit(0.0))
        value = F.ln(n) + (F.col(f"xy{r}") - F.col(f"x{r}") - F.col(f"y{r}")) / n
        return F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0)).alias(f"mi_{r}")

    return sums.select("*", *y_sums).where(F.col("position") < label).select("position", *[mi(r) for r in runs])


def _target_key(name: str, family: str, classify: bool, edges: Sequence[float]) -> Column:
    if classify:
        return H.text_key(C.ref(name).cast("string"))
    value = C.micros(C.ref(name)).cast("double") if family == C.DATETIME else C.as_double(name)
    return bin_number(value, edges)


def mutual_information(df: DataFrame, target: str, bins: int = BINS) -> DataFrame:
    """position, feature, discrete, mi (nats) over all rows with a target."""
    name = C.check_target(df, target)
    known = drop_missing_target(df, name)
    made, classify, edges = features_of(known, name, bins)
    schema = "position int, feature string, discrete boolean, mi double"
    if not made:
        return C.small_frame(df.sparkSession, schema, [])
    y = _target_key(name, C.families(df)[name], classify, edges)
    found = _information(known, made, y, [F.lit(1).cast("bigint")])
    return found.select(
        "position",
        F.get(F.array(*[F.lit(f.name) for f in made]), F.col("position")).alias("feature"),
        F.get(F.array(*[F.lit(f.discrete) for f in made]), F.col("position")).alias("discrete"),
        F.col("mi_0").alias("mi"),
    )


def mutual_information_knn(df: DataFrame, target: str, k: int = NEIGHBOURS) -> DataFrame:
    """position, feature, discrete, method, mi (nats) over all rows with a target.

    A continuous feature with a classification target, and a discrete feature with a continuous target, are estimated from
    their ``k`` nearest neighbours (method ``neighbours``), two continuous sides from those in the plane (``plane``), both without
    bins. Two discrete sides are counted (``table``). A feature with no label of two rows has 0.
    """
    name = C.check_target(df, target)
    known = drop_missing_target(df, name)
    made, classify, edges = features_of(known, name)
    spark = df.sparkSession
    if not made:
        return C.small_frame(spark, "position int, feature string, discrete boolean, method string, mi double", [])
    family = C.families(df)[name]
    near = [(i, f) for i, f in enumerate(made) if f.discrete != classify]
    other = [(i, f) for i, f in enumerate(made) if f.discrete and classify]
    plane = [(i, f) for i, f in enumerate(made) if not f.discrete and not classify]
    number = C.micros(C.ref(name)).cast("double") if family == C.DATETIME else C.as_double(name) if not classify else None
    found = []
    if near:
        if classify:
            label = H.text_key(C.ref(name).cast("string"))
            cells = [F.struct(F.lit(i).alias("f"), label.alias("c"), f.value.cast("double").alias("x")) for i, f in near]
        else:
            cells = [F.struct(F.lit(i).alias("f"), H.text_key(f.value.cast("string")).alias("c"), number.alias("x")) for i, f in near]
        rows = known.select(F.inline(F.array(*cells)))
        found.append(neighbour_information(rows, k).select(F.col("f").alias("position"), "mi"))
    if plane:
        cells = [F.struct(F.lit(i).alias("f"), f.value.cast("double").alias("x"), number.alias("y")) for i, f in plane]
        found.append(plane_information(known.select(F.inline(F.array(*cells))), k).select(F.col("f").alias("position"), "mi"))
    if other:
        places = F.array(*[F.lit(i) for i, _ in other])
        counted = _information(known, [f for _, f in other], _target_key(name, family, classify, edges), [F.lit(1).cast("bigint")])
        found.append(counted.select(F.get(places, F.col("position")).alias("position"), F.col("mi_0").alias("mi")))

    def method(f: Feature) -> str:
        return ("table" if f.discrete else "neighbours") if classify else ("neighbours" if f.discrete else "plane")

    listed = [(i, f.name, f.discrete, method(f)) for i, f in enumerate(made)]
    frame = C.small_frame(spark, "position int, feature string, discrete boolean, method string", listed)
    values = reduce(DataFrame.unionByName, found)
    return frame.join(values, "position", "left").fillna(0.0, ["mi"])


def predictive_power(
    df: DataFrame,
    target: str,
    row_key: Sequence[str] | None = None,
    bins: int = BINS,
    chunk_size: int | None = CHUNK,
    runs: int = RUNS,
    facts: dict[str, dict] | None = None,
) -> DataFrame:
    """position, feature, score, mi, corr, stability, leakage_risk per prepared feature.

    ``row_key`` names the columns whose hash decides subsample membership (default: all).
    MI is scaled by the best feature of each run of ``chunk_size`` features (None: of all).
    Text has no numeric order, so its correlation part is 0. ``facts`` are column report rows
    by name, if they are known already and no target is missing.
    """
    name = C.check_target(df, target)
    known = drop_missing_target(df, name)
    made, classify, edges = features_of(known, name, bins, facts)
    spark = df.sparkSession
    if not made:
        schema = (
            "position int, feature string, score double, mi double, corr double, stability double, leakage_risk boolean"
        )
        return C.small_frame(spark, schema, [])
    family = C.families(df)[name]
    y = _target_key(name, family, classify, edges)
    if row_key:
        keys = [C.ref(c).cast("string") for c in row_key]
    else:
        plain = [C.ref(f.name) for f in known.schema.fields if "map<" not in f.dataType.simpleString()]
        keys = [F.xxhash64(*plain).cast("string")]
    found = _information(known, made, y, _subsamples(keys, runs))

    corr = [0.0] * len(made)
    if not classify:
        number = C.micros(C.ref(name)).cast("double") if family == C.DATETIME else C.as_double(name)
        for start in range(0, len(made), CHUNK):
            batch = [(i, f) for i, f in enumerate(made) if f.numeric][start : start + CHUNK]
            if batch:
                row = known.agg(*[pearson(f.value.cast("double"), number).alias(f"r{i}") for i, f in batch]).first()
                for i, _ in batch:
                    corr[i] = abs(row[f"r{i}"] or 0.0)

    per_run = [F.col(f"mi_{r}") for r in range(runs)]
    mean = sum(per_run[1:], per_run[0]) / runs
    scored = found.withColumn("mean", mean)
    spread = sum(((m - F.col("mean")) * (m - F.col("mean")) for m in per_run), F.lit(0.0)) / runs
    group = F.lit(0) if chunk_size is None else F.floor(F.col("position") / chunk_size)
    best = F.max("mean").over(Window.partitionBy(group))
    confidence = F.when(F.col("mean") <= EPSILON, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), 1.0 - F.sqrt(spread) / (F.col("mean") + EPSILON))
    )
    scored = (
        scored.withColumn("stability", confidence)
        .withColumn("norm", F.col("mean") / (best + EPSILON))
        .withColumn("corr", F.get(F.array(*[F.lit(v) for v in corr]), F.col("position")))
    )
    score = (MI_WEIGHT * F.col("norm") + CORR_WEIGHT * F.col("corr")) * F.col("stability")
    return scored.select(
        "position",
        F.get(F.array(*[F.lit(f.name) for f in made]), F.col("position")).alias("feature"),
        F.round(score, 4).alias("score"),
        F.round("mean", 4).alias("mi"),
        F.round("corr", 4).alias("corr"),
        F.round("stability", 4).alias("stability"),
        ((F.col("norm") > RISK_MI) & (F.col("stability") > RISK_STABILITY)).alias("leakage_risk"),
    )

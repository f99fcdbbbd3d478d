"""Comparing two versions of a data set: distribution drift, schema and profile differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framevitals.functions import columns as C
from framevitals.functions import histogram as H
from framevitals.functions.quantiles import bin_number, exact_quantiles
from framevitals.operators.profile import column_report

PSI_FLOOR = 1e-4
PSI_STABLE, PSI_SHIFTED = 0.1, 0.25
BINS = 10


def drift_psi(old: DataFrame, new: DataFrame, columns: Sequence[str] | None = None, bins: int = BINS) -> DataFrame:
    """column, psi, band: population stability index between two frames.

    Numbers are cut at the exact quantiles of ``old``; text and booleans use their values,
    and missing is a group of its own. Both sides shrink to one row per (column, group) first. Where a column's type
    has changed family, ``new`` is read as the old type where its values allow (the others are a group), and the band is 'type changed'.
    """
    old, new = C.nan_to_null(old), C.nan_to_null(new)
    shared = [c for c in old.columns if c in new.columns] if columns is None else list(columns)
    families = C.families(old)
    shared = [c for c in shared if families[c] != C.NESTED]
    numeric = [c for c in shared if families[c] in (C.INTEGER, C.FRACTIONAL)]
    cuts = exact_quantiles(old, numeric, [i / bins for i in range(1, bins)])

    def grouped(df: DataFrame, name: str) -> DataFrame:
        cells, own = [], C.families(df)
        for i, c in enumerate(shared):
            v = C.ref(c)
            if c in numeric:
                x = v.cast("double") if own[c] in (C.INTEGER, C.FRACTIONAL) else v.cast("string").try_cast("double")
                number = bin_number(x, [e for e in cuts[c] if e is not None])
                group = F.when(x.isNotNull(), number.cast("string")).when(v.isNotNull(), "no number")
            elif families[c] == C.DATETIME:
                at = v if own[c] == C.DATETIME else v.cast("string").try_cast("timestamp")
                group = F.when(v.isNotNull(), F.coalesce(F.date_format(at, "yyyy-MM"), F.lit("no date")))
            else:
                group = H.text_key(v.cast("string"))
            cells += [F.lit(i), group]
        long = df.select(F.stack(F.lit(len(shared)), *cells).alias("cid", "grp"))
        return long.groupBy("cid", "grp").agg(F.count(F.lit(1)).alias(name))

    if not shared:
        return C.small_frame(old.sparkSession, "column string, psi double, band string", [])
    now, numbers = C.families(new), (C.INTEGER, C.FRACTIONAL)
    changed = [i for i, c in enumerate(shared) if now[c] != families[c] and not (now[c] in numbers and families[c] in numbers)]
    sides = [
        grouped(df, "n").select("cid", "grp", *[F.when(F.lit(i == j), F.col("n")).alias(f"n{j}") for j in (0, 1)])
        for i, df in enumerate((old, new))
    ]
    both = sides[0].unionByName(sides[1]).groupBy("cid", "grp").agg(
        F.coalesce(F.sum("n0"), F.lit(0)).alias("a"), F.coalesce(F.sum("n1"), F.lit(0)).alias("b")
    )
    rows = both.where("cid = 0").agg(F.sum("a"), F.sum("b")).first()
    totals = [float(max(x or 0, 1)) for x in rows]
    p = F.greatest(F.col("a") / F.lit(totals[0]), F.lit(PSI_FLOOR))
    q = F.greatest(F.col("b") / F.lit(totals[1]), F.lit(PSI_FLOOR))
    psi = both.groupBy("cid").agg(F.sum((q - p) * F.ln(q / p)).alias("psi"))
    return psi.select(
        F.get(F.array(*[F.lit(c) for c in shared]), F.col("cid")).alias("column"),
        F.round("psi", 4).alias("psi"),
        F.when(F.col("cid").isin(changed), "type changed")
        .when(F.col("psi") < PSI_STABLE, "stable")
        .when(F.col("psi") < PSI_SHIFTED, "shifted")
        .otherwise("drifted")
        .alias("band"),
    )


def version_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """column, status, old/new type, rows, missing_pct and n_unique of two versions, joined by name."""
    keep = ("type", "rows", "missing_pct", "n_unique")
    left = column_report(old).select("column", *[F.col(k).alias(f"old_{k}") for k in keep])
    right = column_report(new).select("column", *[F.col(k).alias(f"new_{k}") for k in keep])
    changed = (F.col("old_type") != F.col("new_type")) | ~F.col("old_rows").eqNullSafe(F.col("new_rows"))
    for k in ("missing_pct", "n_unique"):
        changed = changed | ~F.col(f"old_{k}").eqNullSafe(F.col(f"new_{k}"))
    status = (
        F.when(F.col("old_type").isNull(), "added")
        .when(F.col("new_type").isNull(), "removed")
        .when(changed, "changed")
        .otherwise("same")
    )
    return left.join(right, "column", "full").select(
        "column", status.alias("status"), *[f"{v}_{k}" for k in keep for v in ("old", "new")]
    )


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """column, old, new: columns whose type differs or that only one side has; no data is read."""
    a, b = dict(old.dtypes), dict(new.dtypes)
    rows = [(c, a.get(c), b.get(c)) for c in dict.fromkeys([*a, *b]) if a.get(c) != b.get(c)]
    return C.small_frame(old.sparkSession, "column string, old string, new string", rows)



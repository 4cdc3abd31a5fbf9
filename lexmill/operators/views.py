"""Cuts of results as pages and reports show them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distance_table(pairs: DataFrame, contributors: DataFrame, limit: int | None = 8, features: int = 4) -> DataFrame:
    """The nearest pairs by delta with the features that set them most apart: left_id, right_id, delta, cosine, features."""
    rows = pairs.orderBy("delta", "left_id", "right_id")
    rows = rows.limit(limit) if limit else rows
    each = contributors.where(F.col("rank") <= features).groupBy("left_id", "right_id").agg(F.sort_array(F.collect_list(F.struct("rank", "feature")))["feature"].alias("features"))
    return rows.join(each, ["left_id", "right_id"], "left").orderBy("delta", "left_id", "right_id")


def affinity_table(pairs: DataFrame, limit: int = 8) -> DataFrame:
    """The closest pairs by cosine distance, with a similarity in percent."""
    similarity = F.floor(1000 * F.greatest(F.lit(0.0), 1 - F.col("cosine")) + 0.5) / 10
    return pairs.orderBy("cosine", "left_id", "right_id").limit(limit).select("left_id", "right_id", "cosine", similarity.alias("similarity"))


def close_pairs(pairs: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Pairs within a cosine distance."""
    return pairs.where(F.col("cosine") <= threshold)


def plane_variance(loadings: DataFrame) -> DataFrame:
    """(variance): percent of the variance that the first two axes explain."""
    return loadings.where("axis < 2").select("axis", "variance").distinct().agg(F.coalesce(F.round(F.sum("variance"), 1), F.lit(0.0)).alias("variance"))


def top_loadings(loadings: DataFrame, k: int = 8, axes: int = 3) -> DataFrame:
    return loadings.where((F.col("rank") <= k) & (F.col("axis") < axes)).orderBy("axis", "rank")


def top_profiles(profiles: DataFrame, k: int = 8) -> DataFrame:
    return profiles.where(F.col("rank") <= k).orderBy("id", "rank")


def variant_total(diffs: DataFrame) -> DataFrame:
    """Adds ``variants``: how many operations change something."""
    return diffs.withColumn("variants", F.col("replace") + F.col("delete") + F.col("insert"))


def bounds(points: DataFrame) -> DataFrame:
    """(axis, low, high): the range of each axis with zero in it, wider by 0.12 at both ends; -1 to 1 if it has no width."""
    each = points.groupBy("axis").agg(F.least(F.min("coordinate"), F.lit(0.0)).alias("a"), F.greatest(F.max("coordinate"), F.lit(0.0)).alias("b"))
    none, pad = F.col("b") - F.col("a") < 1e-9, (F.col("b") - F.col("a")) * 0.12
    return each.select("axis", F.when(none, -1.0).otherwise(F.col("a") - pad).alias("low"), F.when(none, 1.0).otherwise(F.col("b") + pad).alias("high"))


def scaled(points: DataFrame, start: float, end: float) -> DataFrame:
    """Adds ``place``: the coordinate between ``start`` and ``end`` of a plot. An axis is a row of ``bounds``."""
    rows = points.join(F.broadcast(bounds(points)), "axis")
    return rows.withColumn("place", start + (F.col("coordinate") - F.col("low")) / (F.col("high") - F.col("low")) * (end - start)).drop("low", "high")


#: Rows that a summary shows of each table of a module: column to rank by, and how many of each document or in all.
SUMMARY_ROWS = {"top": ("id", 6), "counts": (None, 8), "pairs": (None, 8), "merges": (None, 8), "features": (None, 12), "profiles": (None, 8)}


def summarise(results: dict[str, dict]) -> dict[str, dict]:
    """Each module's status, message and the first rows of its tables, as lists on the driver; see SUMMARY_ROWS."""
    out: dict[str, dict] = {}
    for name, result in results.items():
        own = {"status": result["status"], "message": result.get("message", "")}
        for key, table in result.get("tables", {}).items():
            by, k = SUMMARY_ROWS.get(key, (None, 8))
            if by and "rank" in table.columns:
                table, k = table.where(F.col("rank") <= k).orderBy(by, "rank"), 8 * k
            own[key] = [r.asDict(recursive=True) for r in table.limit(k).collect()]
        out[name] = own
    return out

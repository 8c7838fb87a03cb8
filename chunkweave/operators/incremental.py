"""Change detection between snapshots, versions and dirty flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, mark: str = "fingerprint") -> DataFrame:
    """key, change: added, removed or modified rows between two snapshots (key, fingerprint)."""
    b, a = before.select(F.col(key), F.col(mark).alias("_b"), F.lit(True).alias("_in_b")), after.select(F.col(key), F.col(mark).alias("_a"), F.lit(True).alias("_in_a"))
    change = F.when(F.col("_in_b").isNull(), "added").when(F.col("_in_a").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return b.join(a, key, "full").select(key, change.alias("change")).filter("change is not null")


def merge_versions(old: DataFrame, new: DataFrame, key: str, mark: str = "fingerprint") -> DataFrame:
    """The new snapshot with versions: a changed row is the old version plus one and dirty, a new one version 1 and dirty."""
    o = old.select(F.col(key), F.col(mark).alias("_old"), F.col("version").alias("_version"))
    same = F.col("_old").eqNullSafe(F.col(mark)) & F.col("_version").isNotNull()
    return new.join(o, key, "left").select(
        key, mark, F.when(F.col("_version").isNull(), 1).when(same, F.col("_version")).otherwise(F.col("_version") + 1).cast("int").alias("version"), (~same).alias("is_dirty")
    )


def affected(changed: DataFrame, links: DataFrame) -> DataFrame:
    """id of everything changed or linked to it (links: src, dst), once."""
    near = links.join(changed.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id"))
    return changed.select("id").union(near).distinct()


def efficiency(n_changed: int, n_affected: int) -> float:
    """Changed per affected row; 1 if nothing was affected."""
    return n_changed / n_affected if n_affected else 1.0

"""Defects of chunk rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkweave.functions.text import is_blank


def defects(chunks: DataFrame) -> DataFrame:
    """chunk_id, defect: a row per broken rule (chunk_id, content, start_line, end_line, importance are read)."""
    rules = (
        (F.coalesce("chunk_id", F.lit("")) == "", "missing id"),
        (is_blank(F.coalesce("content", F.lit(""))), "empty content"),
        (F.col("start_line") > F.col("end_line"), "line order"),
        (F.col("start_line") < 1, "line number"),
        ((F.col("importance") < 0) | (F.col("importance") > 1), "importance range"),
    )
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))
    return chunks.select("chunk_id", F.explode(found).alias("defect"))


def node_defects(nodes: DataFrame) -> DataFrame:
    """node_id, defect of hierarchy nodes (node_id, level, content, summary, child_ids)."""
    none = F.coalesce(F.size("child_ids"), F.lit(0)) == 0
    rules = (
        (F.col("level") < 0, "negative level"),
        (is_blank(F.coalesce("content", F.lit(""))) & is_blank(F.coalesce("summary", F.lit(""))), "no content or summary"),
        ((F.col("level") > 0) & none, "inner node without children"),
        ((F.col("level") == 0) & ~none, "leaf with children"),
    )
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))
    return nodes.select("node_id", F.explode(found).alias("defect"))

"""One query per operator of the inventory, gathered from the plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chunkweave.plans import chunks, formats, graphs, insights, streams, tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**chunks.QUERIES, **graphs.QUERIES, **tree.QUERIES, **formats.QUERIES, **streams.QUERIES, **insights.QUERIES}

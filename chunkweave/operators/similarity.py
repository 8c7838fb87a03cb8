"""Similarity search of a stated query set against all rows, in blocks; class-wise edges.

Queries go to the executors in blocks of a fixed number of rows.  With more than
one block, what each finds is written before the next is gathered, so the driver
holds one block whatever the number of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.session import Scratch

BLOCK_ROWS = 4096


def _blocks(queries: DataFrame, key: str, block_rows: int) -> Iterator[tuple[list, bool]]:
    """The queries in runs of about block_rows, and whether there are several."""
    n = queries.count()
    parts = max(1, -(-n // block_rows))
    for b in range(parts):
        rows = queries.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == b).collect()
        if rows:
            yield rows, parts > 1


def _union(spark: SparkSession, parts: list[DataFrame], schema: str) -> DataFrame:
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.union(p)
    return out


def cosine_search(spark: SparkSession, queries: DataFrame, data: DataFrame, threshold: float, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, id, similarity of all rows that reach the threshold, but the query itself.

    Exact: every query meets every row.  Queries go to the executors in blocks
    of a fixed size; a zero or null vector is similar to nothing.
    """
    schema, parts, scratch = "query_id long, id long, similarity double", [], Scratch(spark, "search")
    for rows, several in _blocks(queries.filter(F.col(vector_col).isNotNull()).select(id_col, vector_col), id_col, block_rows):
        ids = np.array([r[0] for r in rows], np.int64)
        q = np.array([r[1] for r in rows], np.float64)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(0).to_numpy()
                for a in range(0, len(own), 2048):
                    part = batch.slice(a, 2048)
                    x = np.array(part.column(1).to_pylist(), np.float64).reshape(part.num_rows, -1)
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                    s = q @ x.T
                    i, j = np.nonzero(s >= threshold)
                    keep = ids[i] != own[a + j]
                    i, j = i[keep], j[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(own[a + j]), pa.array(s[i, j])], names=["query_id", "id", "similarity"])

        found = data.filter(F.col(vector_col).isNotNull()).select(id_col, vector_col).mapInArrow(run, schema)
        parts.append(scratch.save(found, str(len(parts))) if several else found)
    return _union(spark, parts, schema)


def word_search(spark: SparkSession, queries: DataFrame, data: DataFrame, threshold: float, top: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, id, similarity, place: for each query (id, words) the `top` rows of data (id, words) by Jaccard.

    Each row's words are looked up in an index of the block's words, so a pair
    without a common word costs nothing.  Ties go to the smaller id.
    """
    schema, parts, scratch = "query_id long, id long, similarity double", [], Scratch(spark, "search")
    for rows, several in _blocks(queries.select("id", "words"), "id", block_rows):
        ids = [r[0] for r in rows]
        size = np.array([len(r[1]) for r in rows])
        index: dict[str, list[int]] = {}
        for k, r in enumerate(rows):
            for w in r[1]:
                index.setdefault(w, []).append(k)

        def run(batches: Iterator[pa.RecordBatch], ids: list = ids, size: np.ndarray = size, index: dict = index) -> Iterator[pa.RecordBatch]:
            own = np.array(ids, np.int64)
            for batch in batches:
                out: list[tuple] = []
                for i, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    met: list[int] = []
                    for w in words:
                        met += index.get(w, ())
                    common = np.bincount(met, minlength=len(own)) if met else np.zeros(len(own), int)
                    s = common / np.maximum(size + len(words) - common, 1)
                    out += [(int(own[k]), i, float(s[k])) for k in np.flatnonzero((s >= threshold) & (common > 0))]
                cols = list(zip(*out)) if out else [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "id", "similarity"])

        met = data.select("id", "words").mapInArrow(run, schema)
        parts.append(scratch.save(met, str(len(parts))) if several else met)
    found = _union(spark, parts, schema)
    ranked = found.withColumn("place", F.row_number().over(_by_score()))
    return ranked.filter(F.col("place") <= top)


def _by_score():
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")


def class_links(members: DataFrame, key: str, id_col: str) -> DataFrame:
    """id, class_id, n_links where all members of a class are linked: the pairs are never made."""
    members = Scratch(members.sparkSession, "classes").save(members, "members")  # read twice
    classes = members.groupBy(key).agg(F.min(id_col).alias("class_id"), (F.count(F.lit(1)) - 1).alias("n_links"))
    return members.join(classes, key)


def pattern_links(patterns: DataFrame, least: float = 0.75) -> DataFrame:
    """id, pattern, n_links: partners of the same pattern whose mean confidence reaches `least`.

    Counted on a histogram of confidences (in hundredths), so the work per
    pattern is bounded however many rows share it.
    """
    p = patterns.select("id", "pattern", F.rint(F.col("confidence") * 100).cast("int").alias("step"))
    p = Scratch(patterns.sparkSession, "patterns").save(p, "steps")  # read twice
    h = p.groupBy("pattern", "step").agg(F.count(F.lit(1)).alias("n"))
    two = int(round(least * 200))
    other = h.select(F.col("pattern").alias("p2"), F.col("step").alias("s2"), F.col("n").alias("n2"))
    per = h.join(other, (F.col("pattern") == F.col("p2")) & (F.col("step") + F.col("s2") >= two)).groupBy("pattern", "step").agg(F.sum("n2").alias("n"))
    own = F.when(2 * F.col("step") >= two, 1).otherwise(0)
    return p.join(per, ["pattern", "step"], "left").select("id", "pattern", (F.coalesce("n", F.lit(0)) - F.when(F.col("n").isNotNull(), own).otherwise(0)).cast("long").alias("n_links"))

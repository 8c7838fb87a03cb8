"""Shards on a consistent-hash ring with virtual nodes and bounded loads (operator 9).

Every shard owns `virtual_nodes` points on a ring of 64-bit positions; a key
belongs to the next point clockwise.  Each shard has a capacity; keys that find
their shard full continue clockwise to the next shard with room.  All keys of
an arc meet the shards in the same order, so the overflow is decided from the
number of keys per arc (shards x virtual nodes numbers, whatever the input's
size); a key then only needs its rank within its arc.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkweave.session import Scratch

VIRTUAL_NODES = 128
ROW_OVERHEAD = 16


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions (signed 64-bit) of all points and their shards."""
    points = sorted(
        (int.from_bytes(hashlib.sha256(f"shard {s} point {v}".encode()).digest()[:8], "little", signed=True), s)
        for s in range(shards)
        for v in range(virtual_nodes)
    )
    return np.array([p for p, _ in points], np.int64), np.array([s for _, s in points], np.int64)


def arc_of(positions: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Index of the next point clockwise."""
    return np.searchsorted(points, positions, side="left") % len(points)


def capacities(total: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows that each shard may hold: without slack, counts at most one apart."""
    if slack:
        return [int(-(-total * (1 + slack) // shards))] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def overflow(counts: dict[int, int], owner: np.ndarray, room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, count, shard, first slot): where each arc's keys go.

    In pass p every arc offers what it still has to the p-th different shard
    clockwise from it, so all keys whose own shard has room stay there.
    """
    room, filled = list(room), [0] * len(room)
    left = {a: c for a, c in sorted(counts.items()) if c}
    done = dict.fromkeys(left, 0)
    walk = {a: [] for a in left}
    out = []
    for p in range(len(room)):
        if not left:
            break
        for a in list(left):
            seen = walk[a]
            k = a if not seen else seen[-1][0]
            tried = {s for _, s in seen}
            while owner[k] in tried:
                k = (k + 1) % len(owner)
            s = int(owner[k])
            seen.append((k, s))
            use = min(left[a], room[s])
            if use:
                out.append((a, done[a], use, s, filled[s]))
                done[a] += use
                filled[s] += use
                room[s] -= use
                left[a] -= use
            if not left[a]:
                del left[a]
    return out


def _split(rows: DataFrame, counts: dict[int, int], limit: int) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """Rows with their part of the arc, and how many rows of the arc stand before each part."""
    wide = {a: -(-c // limit) for a, c in counts.items() if c > limit}
    if not wide:
        return rows.withColumn("part", F.lit(0).cast("long")), {}
    pick = lambda table, key: F.coalesce(F.create_map(*[F.lit(v).cast("long") for k in table.items() for v in k])[key.cast("long")], F.lit(1))
    parted = rows.withColumn("part", F.pmod(F.xxhash64("position", "doc_id", "text_crc32", "size"), pick(wide, F.col("arc"))))
    some = F.col("arc").isin(list(wide))
    large = {r["arc"] << 32 | r["part"]: -(-r["count"] // limit) for r in parted.filter(some).groupBy("arc", "part").count().collect() if r["count"] > 2 * limit}
    if large:
        parted = parted.withColumn("part", F.col("part") + F.shiftleft(F.pmod(F.xxhash64("row"), pick(large, F.shiftleft(F.col("arc").cast("long"), 32).bitwiseOR(F.col("part")))), 32))
    base: dict[tuple[int, int], int] = {}
    seen: dict[int, int] = {}
    for r in sorted(parted.filter(some).groupBy("arc", "part").count().collect()):
        base[r["arc"], r["part"]] = seen.get(r["arc"], 0)
        seen[r["arc"]] = seen.get(r["arc"], 0) + r["count"]
    return parted, base


def ring_shards(spark: SparkSession, docs: DataFrame, shards: int, virtual_nodes: int = VIRTUAL_NODES, slack: float = 0.0, rows_per_rank: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per input row.

    Size is the text's UTF-8 bytes (a null text has none) plus 16.  With no
    slack the law is `rows`: shard counts differ by at most one.  A null id has
    a place on the ring as any other; rows with equal ids stand next to each
    other and are told apart by text and size only.  An empty table gives no row.
    An arc of more than `rows_per_rank` rows is split by a hash of its keys, and
    a part whose keys are still too many (repeated rows) by the number of the
    written row, so no task ranks an unbounded share; the parts stand one after
    another on the arc.
    """
    scratch = Scratch(spark, "sharding")
    points, owner = ring(shards, virtual_nodes)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(id_col).cast("long")).alias("position"),
    )

    def find_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arcs = arc_of(b.column("position").to_numpy(), points)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(arcs, pa.int32())], names=[*b.schema.names, "arc"])

    schema = "doc_id long, size long, text_crc32 long, position long, arc int"
    rows = scratch.save(keyed.mapInArrow(find_arc, schema).withColumn("row", F.monotonically_increasing_id()), "rows")
    counts = {r["arc"]: r["count"] for r in rows.groupBy("arc").count().collect()}  # shards x virtual nodes rows at most
    runs: dict[int, list] = {}
    for r in overflow(counts, owner, capacities(sum(counts.values()), shards, slack)):
        runs.setdefault(r[0], []).append(r)
    at = {a: tuple(np.array([r[k] for r in g]) for k in (1, 3, 4)) for a, g in runs.items()}
    parted, base = _split(rows, counts, rows_per_rank)
    ranked = parted.withColumn("rank", F.row_number().over(Window.partitionBy("arc", "part").orderBy("position", "doc_id", "text_crc32", "size", "row")) - 1)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arcs, rank = b.column("arc").to_numpy(), b.column("rank").to_numpy().astype(np.int64)
            if base:
                rank = rank + np.array([base.get(k, 0) for k in zip(arcs.tolist(), b.column("part").to_pylist())], np.int64)
            shard, slot = np.empty(len(arcs), np.int32), np.empty(len(arcs), np.int64)
            order = np.argsort(arcs, kind="stable")
            edges = np.flatnonzero(np.diff(arcs[order], prepend=-1, append=-1))
            for x, y in zip(edges[:-1], edges[1:]):
                own = order[x:y]
                first, to, begin = at[int(arcs[own[0]])]
                k = np.searchsorted(first, rank[own], side="right") - 1
                shard[own], slot[own] = to[k], begin[k] + rank[own] - first[k]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("size"), b.column("text_crc32"), pa.array(shard), pa.array(slot)], names=["doc_id", "size", "text_crc32", "shard", "slot"])

    placed = ranked.mapInArrow(settle, "doc_id long, size long, text_crc32 long, shard int, slot long")
    law = F.lit("rows") if not slack else F.lit(None).cast("string")
    return placed.select("doc_id", "size", "text_crc32", law.alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

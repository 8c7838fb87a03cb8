"""Best-fit packing of token sequences by linear grouping (operator 1).

Lengths are integers up to the capacity, so the whole corpus is summarised by
one count per length: at most `capacity` numbers, whatever the input's size.
The driver plans on that summary alone:

1. pieces longer than `small` are sorted and split into groups of equal
   cardinality; every length is rounded up to the longest of its group;
2. the few rounded sizes give a configuration problem (how many sequences of
   which mix), whose linear relaxation is solved by column generation with a
   knapsack as pricing step, then rounded down;
3. the slots of the configurations receive real pieces of their group;
4. what rounding down left over, and all small pieces, go longest first into
   the open sequence with the least room that still suffices (best fit).

All four work on runs (so many equal pieces in so many equal sequences), so the
plan's size depends on the capacity too, not on the corpus.  The executors then
rank the pieces of each length and look their place up in the plan.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkweave.llm import tokens
from chunkweave.session import Scratch

CAPACITY = 2048
GROUPS = 40
#: Pieces over capacity / share are large; the share that needs fewest sequences is used.
SMALL_SHARES = (4, 3, 2)
PIECES_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


# --- planning on the histogram -------------------------------------------------


def _price(sizes: list[int], gain: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best-valued multiset of sizes that fits: its value and its counts."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for k, s in enumerate(sizes):
        if gain[k] <= 1e-12:
            continue
        for a in range(s, capacity + 1, s):
            b = min(a + s, capacity + 1)
            cand = best[a - s : b - s] + gain[k]
            better = cand > best[a:b] + 1e-12
            best[a:b][better] = cand[better]
            last[a:b][better] = k
    counts, room = np.zeros(len(sizes)), int(np.argmax(best))
    value = float(best[room])
    while room > 0:
        if last[room] < 0:
            room -= 1
            continue
        k = last[room]
        counts[k] += 1
        room -= sizes[k]
    return value, counts


def configurations(sizes: list[int], need: list[int], capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Mixes of sizes and how often to use each; what they don't cover is left over.

    Revised simplex on min sum(x), A x = need, whose columns are found by `_price`.
    """
    m = len(sizes)
    columns = np.diag([float(capacity // s) for s in sizes])
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    x = np.array(need, float) / np.diag(columns)
    for step in range(rounds):
        duals = inverse.sum(axis=0)
        value, column = _price(sizes, duals, capacity)
        if value <= 1 + 1e-7:
            break
        direction = inverse @ column
        ok = direction > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, x / np.where(ok, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        theta = ratio[out]
        x = x - theta * direction
        x[out] = theta
        columns[:, out] = column
        pivot = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, pivot)
        inverse[out] = pivot
        if step % 50 == 49:
            inverse = np.linalg.inv(columns)
            x = np.maximum(inverse @ np.array(need, float), 0)
    result, left = [], np.array(need, float)
    for k in np.argsort(-x, kind="stable"):
        times = int(x[k] + 1e-6)
        use = columns[:, k]
        if use.any():
            times = min(times, int((left[use > 0] / use[use > 0]).min()))
        if times > 0 and use.any():
            result.append((use.astype(int), times))
            left = left - use * times
    return result


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small_share: int = 3) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset) runs that place every piece.

    Piece number r (from 0) among those of its length, inside a run, goes to
    sequence first_sequence + (r - first_rank) at that offset.
    """
    left = {int(n): int(c) for n, c in histogram.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("a piece is empty or longer than the capacity")
    taken = dict.fromkeys(left, 0)
    placed: list[tuple[int, int, int, int, int]] = []
    next_sequence = 0
    #: open sequences: room -> runs (first sequence, count, offset of the room)
    rooms: dict[int, list[tuple[int, int, int]]] = {}
    sorted_rooms: list[int] = []

    def open_run(room: int, first: int, count: int) -> None:
        if room > 0 and count > 0:
            if room not in rooms:
                rooms[room] = []
                bisect.insort(sorted_rooms, room)
            heapq.heappush(rooms[room], (first, count, capacity - room))

    def take(length: int, count: int, first: int, offset: int) -> None:
        placed.append((length, taken[length], count, first, offset))
        taken[length] += count
        left[length] -= count

    if left.get(capacity):
        count = left[capacity]
        take(capacity, count, next_sequence, 0)
        next_sequence += count
    large = sorted((n for n in left if left[n] and n > capacity // small_share), reverse=True)
    total = sum(left[n] for n in large)
    if total:
        per = -(-total // groups)
        members: list[list[list[int]]] = [[]]  # per group: [length, count], longest first
        room = per
        for n in large:
            c = left[n]
            while c:
                if not room:
                    members.append([])
                    room = per
                use = min(c, room)
                members[-1].append([n, use])
                room -= use
                c -= use
        sizes = [g[0][0] for g in members]
        merged: dict[int, list[list[int]]] = {}
        for s, g in zip(sizes, members):  # equal rounded sizes are one size
            merged.setdefault(s, []).extend(g)
        sizes = list(merged)
        stock = [merged[s] for s in sizes]
        need = [sum(c for _, c in g) for g in stock]
        for mix, times in configurations(sizes, need, capacity):
            slots = [k for k, c in enumerate(mix) for _ in range(c)]
            runs = [(next_sequence, times, 0)]  # equal so far: first, count, filled
            next_sequence += times
            for k in slots:
                after = []
                for first, count, filled in runs:
                    while count:
                        item = stock[k][0]
                        use = min(count, item[1])
                        take(item[0], use, first, filled)
                        after.append((first, use, filled + item[0]))
                        item[1] -= use
                        if not item[1]:
                            stock[k].pop(0)
                        first, count = first + use, count - use
                runs = after
            for first, count, filled in runs:
                open_run(capacity - filled, first, count)
    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            k = bisect.bisect_left(sorted_rooms, n)
            if k == len(sorted_rooms):  # nothing has room: new sequences, as full as can be
                fit = capacity // n
                full, over = divmod(left[n], fit)
                for count, deep in ((full, fit), (1 if over else 0, over)):
                    if count:
                        for j in range(deep):
                            take(n, count, next_sequence, j * n)
                        open_run(capacity - deep * n, next_sequence, count)
                        next_sequence += count
                continue
            room = sorted_rooms[k]
            first, count, offset = heapq.heappop(rooms[room])
            if not rooms[room]:
                del rooms[room]
                sorted_rooms.pop(k)
            use = min(count, left[n])
            take(n, use, first, offset)
            open_run(room - n, first, use)
            open_run(room, first + use, count - use)
    return placed


def sequences(placed: list[tuple[int, int, int, int, int]]) -> int:
    """How many sequences a plan fills."""
    return max((first + count for _, _, count, first, _ in placed), default=0)


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small_shares: tuple[int, ...] = SMALL_SHARES) -> list[tuple[int, int, int, int, int]]:
    """The plan with the fewest sequences over the cut-offs between large and small."""
    return min((plan(histogram, capacity, groups, s) for s in small_shares), key=sequences)


# --- executors ------------------------------------------------------------------


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be short."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    out = [(0, head)] if head else []
    return out + [(a, capacity) for a in range(head, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, special_as_text: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokens.json_pieces(tokenizer, special_as_text)
        end = np.array([end_id], "<u4")
        for batch in batches:
            ids = batch.column(0)
            index, piece, start, length, crc = [], [], [], [], []
            for k, found in table.rows(batch.column(1)):
                packed = np.concatenate((found, end)).astype("<u4").tobytes()
                for p, (s, n) in enumerate(cut(len(packed) // 4, capacity)):
                    index.append(k)
                    piece.append(p)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(packed[4 * s : 4 * (s + n)]))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(index, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES_SCHEMA)


def place(pieces: DataFrame, placed: list[tuple[int, int, int, int, int]], counts: dict[int, int], rows_per_rank: int = 500_000) -> DataFrame:
    """Adds sequence_id and offset: ranks the pieces of each length, then reads the plan.

    `row` numbers the written pieces.  A frequent length (the full one above
    all) is split by it over as many ranking groups as its count asks for, so no
    task ranks more than a bounded share, however alike the pieces are.
    """
    spread = {n: -(-c // rows_per_rank) for n, c in counts.items()}
    widest = max(spread.values(), default=1)
    part = F.lit(0)
    if widest > 1:
        per = F.create_map(*[F.lit(v) for n, k in spread.items() if k > 1 for v in (n, k)])
        part = F.pmod(F.xxhash64("row"), F.coalesce(per[F.col("length").cast("int")], F.lit(1))).cast("int")
    keyed = pieces.withColumn("_part", part)
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_part").orderBy("row")) - 1)
    base: dict[tuple[int, int], int] = {}
    if widest > 1:
        seen: dict[int, int] = {}
        for r in sorted(keyed.filter(F.col("length").isin([n for n, k in spread.items() if k > 1])).groupBy("length", "_part").count().collect()):
            base[r["length"], r["_part"]] = seen.get(r["length"], 0)
            seen[r["length"]] = seen.get(r["length"], 0) + r["count"]
    runs = sorted(placed)
    at = {n: (np.array([r[1] for r in g]), np.array([r[3] for r in g]), np.array([r[4] for r in g])) for n, g in _by_length(runs).items()}

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            if base:
                parts = batch.column("_part").to_numpy()
                rank = rank + np.array([base.get(k, 0) for k in zip(length.tolist(), parts.tolist())])
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:]):
                own = order[a:b]
                first, start, place_at = at[int(length[own[0]])]
                k = np.searchsorted(first, rank[own], side="right") - 1
                sequence[own] = start[k] + rank[own] - first[k]
                offset[own] = place_at[k]
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(look_up, PIECES_SCHEMA + ", sequence_id long, offset long")


def _by_length(runs: list[tuple[int, int, int, int, int]]) -> dict[int, list]:
    out: dict[int, list] = {}
    for r in runs:
        out.setdefault(r[0], []).append(r)
    return out


def best_fit_packing(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, groups: int = GROUPS, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, rows_per_rank: int = 500_000, special_as_text: bool = False) -> DataFrame:
    """Packs whole documents into as few sequences of at most `capacity` tokens as it can.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset; one row
    per piece.  A null or empty text is the end id alone (one piece of length 1);
    longer documents than the capacity are cut, only their first piece being
    short.  Repeated rows are packed as often as they occur; a null id stays
    null; other columns are not read.  No document at all gives no row.  The
    string of a special token in a text gives that token, as the tokenizers
    library has it, unless `special_as_text`.
    """
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(token_pieces(docs, tokenizer, capacity, id_col, text_col, end_id, special_as_text).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    return place(pieces, best_plan(counts, capacity, groups), counts, rows_per_rank)

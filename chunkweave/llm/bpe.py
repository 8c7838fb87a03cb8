"""Byte-level BPE encoding and decoding on segment trees (operator 4).

A piece is a row of byte positions; leaf i of its segment tree holds the rank
of the pair that starts at live position i, with the position as tie-break, so
the root is the leftmost pair of minimum rank.  A merge removes one position
and changes the pairs of its two live neighbours: three point updates of
logarithmic cost.  Pieces of one batch are merged in step, each in its own
tree, on arrays that hold the trees of all pieces of one size class; a few
pieces, as a single very long one, are merged one by one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkweave.llm.tokens import SPLIT, PieceIds, token_lengths
from chunkweave.session import small_batches

NONE = np.int64(1 << 62)
BATCH_CELLS = 1 << 21
CACHE_WORDS = 200_000
FEW = 32


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class SegmentTreeBpe:
    """Merges by rank, whole pieces that are tokens first."""

    exact = True

    def __init__(self, ranks: dict[bytes, int], pattern: str = SPLIT):
        import regex

        self.ranks = ranks
        self.words = {i: w for w, i in ranks.items()}
        self.lengths = token_lengths(ranks)
        self._split = regex.compile(pattern).findall
        self._byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # every way to cut a token in two tokens: (left, right) -> rank
        pairs = {}
        for w, i in ranks.items():
            for k in range(1, len(w)):
                a, b = ranks.get(w[:k]), ranks.get(w[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        keys = np.array(sorted(pairs), np.int64)
        bits = max(16, int(len(keys)).bit_length() + 2)
        self._shift = np.uint64(64 - bits)
        self._slots = np.full(1 << bits, -1, np.int64)
        self._ranks = np.full(1 << bits, NONE, np.int64)
        mask = (1 << bits) - 1
        self._probes = 1
        slot = self._slot(keys).tolist()
        for k, s in zip(keys.tolist(), slot):
            tries = 1
            while self._slots[s] >= 0:
                s = (s + 1) & mask
                tries += 1
            self._slots[s], self._ranks[s] = k, pairs[k]
            self._probes = max(self._probes, tries)
        self._cache: dict[str, np.ndarray] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self._shift).astype(np.int64)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, or NONE."""
        key = left << 32 | right
        slot = self._slot(key)
        out = np.full(len(key), NONE)
        todo = np.arange(len(key))
        for _ in range(self._probes):
            seen = self._slots[slot[todo]]
            hit = seen == key[todo]
            out[todo[hit]] = self._ranks[slot[todo[hit]]]
            todo = todo[~hit & (seen >= 0)]
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & (len(self._slots) - 1)
        return out

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece (of one byte or more, none a token as a whole)."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        classes: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            classes.setdefault(max(1, (len(p) - 1).bit_length()), []).append(k)
        for bits, members in classes.items():
            if len(members) < FEW:
                for k in members:
                    out[k] = self._merge_one(pieces[k], 1 << bits)
                continue
            step = max(1, BATCH_CELLS >> bits)
            for a in range(0, len(members), step):
                some = members[a : a + step]
                for k, ids in zip(some, self._merge_class([pieces[k] for k in some], 1 << bits)):
                    out[k] = ids
        return out

    def _merge_one(self, piece: bytes, width: int) -> np.ndarray:
        """The same on plain lists: an array call costs more than a merge of one piece."""
        none, rank_of, words = int(NONE), self.ranks.get, self.words
        n = len(piece)
        token = [int(t) for t in self._byte[np.frombuffer(piece, np.uint8)]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        held = [words[t] for t in token]
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = rank_of(held[i] + held[i + 1])
            if r is not None:
                tree[width + i] = r * width + i
        for k in range(width - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

        def put(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a < b else b
                if tree[k] == low:
                    return
                tree[k] = low
                k >>= 1

        while tree[1] < none:
            rank, i = divmod(tree[1], width)
            j = after[i]
            k = after[j]
            token[i], token[j], held[i] = rank, -1, words[rank]
            after[i] = k
            put(j, none)
            r = None
            if k < n:
                before[k] = i
                r = rank_of(held[i] + held[k])
            put(i, none if r is None else r * width + i)
            h = before[i]
            if h >= 0:
                r = rank_of(held[h] + held[i])
                put(h, none if r is None else r * width + h)
        return np.array([t for t in token if t >= 0], np.uint32)

    def _merge_class(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        n = len(pieces)
        size = np.array([len(p) for p in pieces])
        row = np.repeat(np.arange(n), size)
        col = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        token = np.full((n, width), -1, np.int64)
        token[row, col] = self._byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()
        before = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()
        tree = np.full((n, 2 * width), NONE)
        start = col + 1 < np.repeat(size, size)
        r, c = row[start], col[start]
        rank = self._pair(token[r, c], token[r, c + 1])
        tree[r, width + c] = np.where(rank < NONE, rank * width + c, NONE)
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            best = tree[live, 1]
            i = best % width
            j = after[live, i]
            k = after[live, j]
            token[live, i] = best // width
            token[live, j] = -1
            after[live, i] = k
            inside = k < size[live]
            before[live[inside], k[inside]] = i[inside]
            value = np.full(len(live), NONE)
            rank = self._pair(token[live[inside], i[inside]], token[live[inside], k[inside]])
            value[inside] = np.where(rank < NONE, rank * width + i[inside], NONE)
            tree[live, width + i] = value
            tree[live, width + j] = NONE
            h = before[live, i]
            led = h >= 0
            rank = self._pair(token[live[led], h[led]], token[live[led], i[led]])
            tree[live[led], width + h[led]] = np.where(rank < NONE, rank * width + h[led], NONE)
            for rows, leaf in ((live, width + i), (live, width + j), (live[led], width + h[led])):
                node = leaf >> 1
                while len(node) and node[0] >= 1:
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node = node >> 1
            live = live[tree[live, 1] < NONE]
        kept = token >= 0
        flat = token[kept].astype(np.uint32)
        cuts = np.cumsum(kept.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *cuts], cuts)]

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text: each match of the pattern separately."""
        matches = self._split(text)
        cache = self._cache
        new = [m for m in set(matches) if m not in cache]
        if len(cache) + len(new) > CACHE_WORDS:
            cache.clear()
            new = list(set(matches))
        packed = [m.encode() for m in new]
        rest = []
        for m, p in zip(new, packed):
            whole = self.ranks.get(p)
            if whole is None:
                rest.append((m, p))
            else:
                cache[m] = np.array([whole], np.uint32)
        for (m, _), ids in zip(rest, self.merge([p for _, p in rest])):
            cache[m] = ids
        found = [cache[m] for m in matches]
        for m in [m for m in new if len(m) > 256]:
            del cache[m]
        return np.concatenate(found) if found else np.zeros(0, np.uint32)


_OPEN: dict[str, tuple] = {}


def coder(path: str) -> tuple:
    """(pieces, words, decimals) of one rank file, once per Python worker."""
    if path not in _OPEN:
        bpe = SegmentTreeBpe(read_ranks(path))
        top = max(bpe.words)
        words = [bpe.words.get(i, b"") for i in range(top + 1)]
        _OPEN[path] = (PieceIds(bpe), words, [str(i) for i in range(top + 1)])
    return _OPEN[path]


def round_trip(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids): one row per input row.

    Encodes every whole text and decodes the ids again.  A null or empty text
    has no token; its hashes are those of nothing.  Ids are carried as they are.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, words, decimals = coder(ranks_path)
        for batch in batches:
            count, coded, decoded, kept = [], [], [], []
            for _, ids in pieces.rows(batch.column(1)):
                own = ids.tolist()
                count.append(len(own))
                coded.append(hashlib.sha256(",".join([decimals[i] for i in own]).encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join([words[i] for i in own])).hexdigest())
                if keep_ids:
                    kept.append(own)
            columns = [batch.column(0), pa.array(count, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)

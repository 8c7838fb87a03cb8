"""Ids of whole texts, encoded piece by piece on the raw bytes of a batch.

A space between two non-space characters always starts a new pre-token, so a
text may be cut there and each piece (with its leading space) encoded by
itself.  Pieces of up to 16 bytes are looked up, vectorised, in a direct-mapped
table that holds their bytes and length (so a hit is exact); all others of a batch go to
the encoder in one call, and their ids are told apart by byte length.  Texts
with other white-space next to a space, where a cut would not be a pre-token
boundary, go to the encoder whole.
"""

from __future__ import annotations

import json
import re
from typing import Protocol

import numpy as np
import pyarrow as pa

from chunkweave.llm import textops

U64 = np.uint64
SLOT_BITS = 19
POOL_IDS = 1 << 21
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ODD = np.zeros(256, bool)  # white-space other than the space
_ODD[[*range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=U64)


class Backend(Protocol):
    #: Bytes of each token id.
    lengths: np.ndarray

    def ids(self, text: str) -> np.ndarray:
        """Ids (unsigned 32-bit) of one text."""


class RankBackend:
    """Ranks of a `tokenizers` JSON file, run by the rank-based encoder.

    That is the same function as the tokenizers library's as long as merge i
    makes token 256 + i, which is checked here; where it does not hold, the
    library itself is used on every text.  The strings of added tokens, in a
    text, give their ids as with the library's own call; with `special_as_text`
    they are ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = byte_letters()
        added = model.get("added_tokens", [])
        special = {t["content"] for t in added}
        words = {w: i for w, i in model["model"]["vocab"].items() if w not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        simple = not any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word", "normalized")) and not any(c.isspace() for t in special for c in t)
        self.exact = simple and len(words) == 256 + len(merges) and all(words.get(a + b) == 256 + k for k, (a, b) in enumerate(merges))
        self.special = {} if special_as_text else {t["content"]: t["id"] for t in added}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        if self.exact:
            ranks = {bytes(letters[c] for c in w): i for w, i in words.items()}
            self._run = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.lengths = token_lengths(ranks)
        else:
            from tokenizers import Tokenizer

            self._run = Tokenizer.from_file(path)
            self._run.encode_special_tokens = special_as_text

    def ids(self, text: str) -> np.ndarray:
        if not self.exact:
            return np.array(self._run.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        if not any(t in text for t in self.special):
            return np.array(self._run.encode_ordinary(text), dtype=np.uint32)
        out: list[int] = []
        for part in self._cut.split(text):
            out += [self.special[part]] if part in self.special else self._run.encode_ordinary(part)
        return np.array(out, dtype=np.uint32)


def byte_letters() -> dict[str, int]:
    """The public byte-level alphabet: printable stand-in of each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def token_lengths(ranks: dict[bytes, int]) -> np.ndarray:
    out = np.zeros(max(ranks.values()) + 1, np.int64)
    for w, i in ranks.items():
        out[i] = len(w)
    return out


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... of each run, one after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


class PieceIds:
    """The table of pieces of one worker, in front of a backend."""

    def __init__(self, backend: Backend):
        self.backend = backend
        self.k0 = np.zeros(1 << SLOT_BITS, U64)
        self.k1 = np.zeros(1 << SLOT_BITS, U64)
        self.size = np.zeros(1 << SLOT_BITS, np.int8)  # the bytes are padded with zeros, which a piece may end in
        self.at = np.zeros(1 << SLOT_BITS, np.int64)
        self.n = np.zeros(1 << SLOT_BITS, np.int64)
        self.pool = np.zeros(POOL_IDS, np.uint32)
        self.used = 0
        self.first: dict[bytes, np.ndarray] = {}

    def rows(self, column: pa.Array):
        """(row, ids) of each text in order; a null text counts as empty."""
        for a, b, body, offsets in textops.chunks(column, 1 << 19):
            ids, bounds = self.chunk(body, offsets)
            for k in range(b - a):
                yield a + k, ids[bounds[k] : bounds[k + 1]]

    def chunk(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of texts, and each text's bounds among them."""
        n_rows = len(offsets) - 1
        if not len(body):
            return np.zeros(0, np.uint32), np.zeros(n_rows + 1, np.int64)
        plain = self._plain(body, offsets) if getattr(self.backend, "exact", True) else np.zeros(n_rows, bool)
        plain &= ~self._special(body, offsets)
        space = body == 0x20
        if not plain.all():
            space &= np.repeat(plain, np.diff(offsets))
        gaps = np.flatnonzero(space)
        some = np.flatnonzero(np.diff(offsets) > 0)  # rows with text have a first piece
        start = np.concatenate((offsets[some], gaps + 1))
        order = np.argsort(start, kind="stable")
        start = start[order]
        is_first = order < len(some)
        end = np.empty_like(start)
        end[:-1] = start[1:] - ~is_first[1:]
        end[-1] = len(body)
        size = end - start
        bounds = np.concatenate((np.searchsorted(start, offsets[:-1]), [len(start)]))
        at, n, extra = self._look_up(body, start, size, is_first)
        pool = np.concatenate((self.pool[: self.used], extra)) if len(extra) else self.pool
        ids = pool[_spread(at, n)]
        ends = np.concatenate(([0], np.cumsum(n)))
        return ids, ends[bounds]

    def _special(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows that hold the string of an added token."""
        out = np.zeros(len(offsets) - 1, bool)
        for t in getattr(self.backend, "special", ()):
            raw, want = body.tobytes(), t.encode()
            at = raw.find(want)
            while at >= 0:
                out[np.searchsorted(offsets, at, side="right") - 1] = True
                at = raw.find(want, at + 1)
        return out

    def _plain(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows that may be cut at every space."""
        space, odd = body == 0x20, _ODD[body]
        bad = odd & (body < 0x20) & (body >= 0x1C)
        white = space | odd
        pair = np.zeros(len(body), bool)
        pair[1:] = (space[1:] & white[:-1]) | (white[1:] & space[:-1])
        bad |= pair
        edge = np.zeros(len(body), bool)  # a space at either end of a row
        firsts = offsets[:-1][np.diff(offsets) > 0]
        lasts = offsets[1:][np.diff(offsets) > 0] - 1
        edge[firsts] = space[firsts]
        edge[lasts] |= space[lasts]
        bad |= edge
        lead = np.flatnonzero((body == 0xC2) | ((body >= 0xE1) & (body <= 0xE3)))
        if len(lead):  # longer white-space characters
            pad = np.concatenate((body, np.zeros(2, np.uint8)))
            x, y, z = body[lead], pad[lead + 1], pad[lead + 2]
            wide = ((x == 0xC2) & ((y == 0x85) | (y == 0xA0))) | ((x == 0xE1) & (y == 0x9A) & (z == 0x80)) | ((x == 0xE3) & (y == 0x80) & (z == 0x80))
            wide |= (x == 0xE2) & (((y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))) | ((y == 0x81) & (z == 0x9F)))
            bad[lead[wide]] = True
        sums = np.concatenate(([0], np.cumsum(bad)))
        return sums[offsets[1:]] == sums[offsets[:-1]]

    def _look_up(self, body, start, size, is_first):
        pad = np.concatenate((body, np.zeros(16, np.uint8)))
        view = np.lib.stride_tricks.as_strided(pad[:8].view(U64), shape=(len(pad) - 7,), strides=(1,))
        k0 = view[start] & _KEEP[np.minimum(size, 8)]
        k1 = view[np.minimum(start + 8, len(body) + 8)] & _KEEP[np.clip(size - 8, 0, 8)]
        slot = ((k0 * U64(0x9E3779B97F4A7C15) ^ (k1 + U64(0x632BE59BD9B4E019)) * U64(0xC2B2AE3D27D4EB4F)) * U64(0xD6E8FEB86659FD93) >> U64(64 - SLOT_BITS)).astype(np.int64)
        n = self.n[slot]
        hit = (n > 0) & (self.k0[slot] == k0) & (self.k1[slot] == k1) & (self.size[slot] == size) & (size <= 16) & ~is_first & (size > 0)
        at = self.at[slot]
        rest = np.flatnonzero(~hit & ~is_first)
        parts, base = [], self.used
        if len(rest):
            # " " + piece of each, as they stand in the texts
            text = body[_spread(start[rest] - 1, size[rest] + 1)].tobytes().decode()
            ids = self.backend.ids(text)
            cuts = np.searchsorted(np.cumsum(self.backend.lengths[ids]), np.cumsum(size[rest] + 1)) + 1
            begun = np.concatenate(([0], cuts[:-1]))
            at[rest], n[rest] = base + begun, cuts - begun
            parts.append(ids)
            base += len(ids)
        for k in np.flatnonzero(is_first).tolist():
            key = body[start[k] : start[k] + size[k]].tobytes()
            ids = self.first.get(key)
            if ids is None:
                ids = self.backend.ids(key.decode())
                if len(key) <= 32 and len(self.first) < 50_000:
                    self.first[key] = ids
            at[k], n[k] = base, len(ids)
            parts.append(ids)
            base += len(ids)
        extra = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        used = self.used
        if len(rest):
            self._remember(rest, slot, k0, k1, size, at, n, extra, used)
            shift = self.used - used
            if shift:
                fresh = ~hit
                at[fresh] += shift
        return at, n, extra

    def _remember(self, rest, slot, k0, k1, size, at, n, extra, used) -> None:
        """Fills empty slots with what was just encoded; frequent pieces come early."""
        good = rest[(size[rest] <= 16) & (self.n[slot[rest]] == 0)]
        _, one = np.unique(slot[good], return_index=True)
        good = good[one]
        total = np.cumsum(n[good])
        good = good[: np.searchsorted(total, len(self.pool) - self.used, side="right")]
        if not len(good):
            return
        ids = extra[_spread(at[good] - used, n[good])]
        s = slot[good]
        self.k0[s], self.k1[s], self.size[s], self.n[s] = k0[good], k1[good], size[good], n[good]
        self.at[s] = self.used + np.concatenate(([0], np.cumsum(n[good])[:-1]))
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)


_OPEN: dict[tuple[str, bool], PieceIds] = {}


def json_pieces(path: str, special_as_text: bool = False) -> PieceIds:
    """One per Python worker and vocabulary file."""
    key = path, special_as_text
    if key not in _OPEN:
        _OPEN[key] = PieceIds(RankBackend(path, special_as_text))
    return _OPEN[key]

"""What chunkers share: the chunk, its id, its importance."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    """Chunk sizes in characters, and the switches that chunkers read."""

    min_size: int = 50
    target_size: int = 800
    max_size: int = 2000
    group_imports: bool = True
    wanted: frozenset[str] | None = None  # columns of chunks that are asked for; all without

    def wants(self, *columns: str) -> bool:
        return self.wanted is None or not self.wanted.isdisjoint(columns)

    @property
    def details(self) -> bool:
        """Whether more than a chunk's kind, place and text is asked for."""
        return self.wants("importance", "tags", "dependencies", "metadata")


@dataclass
class Chunk:
    kind: str
    content: str
    start: int
    end: int
    name: str | None = None
    importance: float = 0.5
    tags: list[str] = field(default_factory=list)
    deps: list[str] = field(default_factory=list)
    meta: dict[str, str] = field(default_factory=dict)
    always: bool = False  # kept whatever its size

    @property
    def size(self) -> int:
        return len(self.content)


class Span(Chunk):
    """A chunk that is a part of a text, cut out when it is read: nested ones don't hold copies of each other."""

    def __init__(self, kind: str, text: str, a: int, b: int, start: int, end: int, name: str | None = None, always: bool = False):
        self.kind, self.text, self.a, self.b, self.start, self.end, self.name, self.always = kind, text, a, b, start, end, name, always
        self.importance, self.tags, self.deps, self.meta = 0.5, [], [], {}

    @property
    def content(self) -> str:
        return self.text[self.a : self.b]

    @property
    def size(self) -> int:
        return self.b - self.a


_UNCLEAN = re.compile(r"[^\w-]")


def clean(name: str | None) -> str:
    return _UNCLEAN.sub("", name or "") or "chunk"


def stem(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0] if "." in name[1:] else name


def chunk_id(path: str, c: Chunk) -> str:
    return f"{stem(path)}:{c.kind}:{clean(c.name)}:{c.start}"


class Lines:
    """Line numbers of offsets, by bisection."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def at(self, offset: int) -> int:
        return bisect.bisect_right(self.starts, offset)


class Coverage:
    """Which lines (from 1) are used."""

    def __init__(self, lines: int):
        self.used = bytearray(lines + 2)
        self.lines = lines

    def meets(self, first: int, last: int) -> bool:
        return self.used.find(1, first, last + 1) >= 0

    def add(self, first: int, last: int) -> None:
        self.used[first : last + 1] = b"\1" * (last + 1 - first)

    def next_used(self, first: int) -> int:
        """The first used line from `first` on, or the one after the last."""
        k = self.used.find(1, first, self.lines + 1)
        return k if k >= 0 else self.lines + 1

    def gaps(self) -> list[tuple[int, int]]:
        out, k = [], 1
        while k <= self.lines:
            end = self.next_used(k)
            if end > k:
                out.append((k, end - 1))
            free = self.used.find(0, end, self.lines + 1)
            k = free if free >= 0 else self.lines + 1
        return out


def succeeded(chunks: list[Chunk], text: str, cfg: Config) -> bool:
    """Whether a split is worth keeping: three chunks or more, none nearly the whole, their mean not over twice the target."""
    if len(chunks) < 3:
        return False
    sizes = [len(c.content) for c in chunks]
    return max(sizes) <= 0.9 * len(text) and sum(sizes) / len(sizes) <= 2 * cfg.target_size


def node_importance(kind_score: float, text: str, children: int) -> float:
    """Seven tenths by kind, the rest by size and number of children."""
    return min(1.0, 0.7 * kind_score + 0.15 * min(1.0, len(text.encode()) / 1000) + 0.15 * min(1.0, children / 10))


def size_tags(c: Chunk) -> None:
    if c.importance > 0.8:
        c.tags.append("high_importance")
    n = len(c.content)
    if n > 1000:
        c.tags.append("large")
    elif n < 100:
        c.tags.append("small")


def keep(chunks: list[Chunk], cfg: Config) -> list[Chunk]:
    """Chunks of the least size, small imports, comments and headings, in order of their lines."""
    return sorted((c for c in chunks if c.always or c.size >= cfg.min_size or c.kind in ("import", "comment")), key=lambda c: c.start)

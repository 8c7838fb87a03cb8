"""XML by its tags alone: for text that is not well-formed, or that its tree splits badly.

One scan of the tags gives every element's span from a stack, so the cost is
linear; the phases (structural elements, repeated elements in batches, elements
of much text, what is left) then choose among the spans, and no line is used
twice.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from chunkweave.operators.chunkers.base import Chunk, Config, Coverage, Lines

_TAG = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[?!][^>]*>|<(/?)([^/\s>?!<]+)([^<>]*?)(/?)>", re.S)
_MARKUP = re.compile(r"<[^>]*>")
_NAMESPACE = re.compile(r"""xmlns(?::(\w+))?=["']([^"']*)["']""")
_ATTRIBUTE = re.compile(r"""([\w:.-]+)=["']([^"']*)["']""")
CATEGORIES = {
    "structure": frozenset("article aside body chapter container content div footer head header main nav part section".split()),
    "metadata": frozenset("author category creator date description id keywords link meta publisher subject summary title".split()),
    "text": frozenset("blockquote code em p para paragraph pre strong text".split()),
    "collection": frozenset("dl entry items list ol record row table ul".split()),
    "data": frozenset("data field item key param property record setting value".split()),
    "media": frozenset("audio figure image img media video".split()),
}
STRUCTURAL = CATEGORIES["structure"]
CONTENT = frozenset("blockquote data description dl entry item ol p pre record table text ul".split())
SMALL = frozenset("entry item link meta title".split())
IMPORTANT = frozenset("article body chapter content data entry head item record section title".split())
BY_DOCUMENT = {
    "feed": frozenset("channel entry item".split()), "config": frozenset("configuration property setting".split()),
    "build": frozenset("dependency module plugin".split()), "svg": frozenset("circle g path rect text".split()),
}
ROOTS = {"html": "html", "xhtml": "html", "svg": "svg", "rss": "feed", "feed": "feed", "configuration": "config", "config": "config", "project": "build", "pom": "build"}
LEAST_TEXT, CONTENT_TEXT = 10, 20


def local(name: str) -> str:
    return name.rsplit(":", 1)[-1].lower()


def category(name: str) -> str:
    return next((c for c, names in CATEGORIES.items() if local(name) in names), "custom")


def structure(text: str) -> dict:
    """root, document_type, namespaces (prefix -> uri), counts of elements, depth, and every element's span."""
    stack: list[tuple[str, int]] = []
    at: dict[str, list[int]] = {}  # name -> places on the stack
    spans: list[tuple[int, int, str]] = []
    counts: Counter = Counter()
    root, depth = None, 0
    for m in _TAG.finditer(text):
        name = m.group(2)
        if name is None:
            continue
        if m.group(1):
            if at.get(name):
                k = at[name][-1]
                spans.append((stack[k][1], m.end(), name))
                while len(stack) > k:  # what is open inside is never closed
                    at[stack.pop()[0]].pop()
            continue
        root = root or name
        counts[name.rsplit(":", 1)[-1]] += 1
        if m.group(4):
            spans.append((m.start(), m.end(), name))
        else:
            at.setdefault(name, []).append(len(stack))
            stack.append((name, m.start()))
            depth = max(depth, len(stack))
    kind = ROOTS.get((root or "").lower(), "data") if root else "unknown"
    return {"root": root, "document_type": kind, "namespaces": {p or "default": u for p, u in _NAMESPACE.findall(text)}, "counts": counts, "depth": depth, "spans": sorted(spans, key=lambda s: (s[0], -s[1]))}


def significant(name: str, document: dict) -> bool:
    """Structural and content elements, those its kind of document is made of, and repeated ones."""
    low = local(name)
    return low in STRUCTURAL or low in CONTENT or low in BY_DOCUMENT.get(document["document_type"], ()) or document["counts"].get(name.rsplit(":", 1)[-1], 0) > 1


def importance(name: str, kind: str, body: str) -> float:
    low = local(name)
    score = 0.5 + 0.2 * (kind in ("element", "content_element")) + 0.2 * (low in IMPORTANT) + 0.1 * (len(body) > 1000) - 0.1 * (len(body) < 100)
    return min(1.0, max(0.1, score))


def analyse(c: Chunk) -> None:
    """Tags and metadata of the markup: attributes, CDATA, namespaces, share of text, nested elements."""
    attributes = _ATTRIBUTE.findall(c.content)
    cdata = c.content.count("<![CDATA[")
    spaces = {p or "default": u for p, u in _NAMESPACE.findall(c.content)}
    share = len(_MARKUP.sub("", c.content).strip()) / max(1, len(c.content))
    nested = re.findall(r"<([^/\s>?!]+)", c.content)
    flags = (("has_attributes", attributes), ("has_cdata", cdata), ("has_namespaces", spaces), ("text_heavy", share > 0.7), ("markup_heavy", share < 0.3))
    c.tags += [n for n, on in flags if on and n not in c.tags]
    c.meta |= {"attribute_count": str(len(attributes)), "cdata_sections": str(cdata), "namespaces": ",".join(sorted(spaces)), "text_ratio": f"{share:.4f}", "nested": str(len(nested)), "unique_nested": str(len({local(n) for n in nested}))}
    c.deps = list(dict.fromkeys([*c.deps, *[v for k, v in attributes if local(k) in ("href", "src", "ref")], *[f"namespace:{u}" for u in spaces.values()]]))


def by_tags(text: str, cfg: Config) -> list[Chunk]:
    """The chunks of all phases, in order of their lines."""
    document, lines = structure(text), Lines(text)
    used, out = Coverage(len(lines.starts)), []

    def make(kind: str, name: str, a: int, b: int) -> Chunk | None:
        first, last = lines.at(a), lines.at(max(a, b - 1))
        if used.meets(first, last):
            return None
        used.add(first, last)
        body = text[a:b]
        c = Chunk("xml_element", body, first, last, name)
        if cfg.details:
            c.importance, c.tags, c.meta = importance(name, kind, body), ["xml", name, kind, category(name)], {"xml_type": kind, "category": category(name)}
            analyse(c)
        return c

    def fits(name: str, a: int, b: int) -> bool:
        if b - a < cfg.min_size and local(name) not in SMALL or b - a > cfg.max_size:
            return False
        return len(_MARKUP.sub("", text[a:b]).strip()) >= LEAST_TEXT

    for a, b, name in document["spans"]:
        if local(name) in STRUCTURAL | BY_DOCUMENT.get(document["document_type"], frozenset()) and fits(name, a, b):
            out.append(make("element", name, a, b))
    repeated: dict[str, list[Chunk]] = {}
    for a, b, name in document["spans"]:
        if document["counts"][name.rsplit(":", 1)[-1]] > 2 and cfg.min_size // 2 <= b - a <= cfg.max_size:
            c = make("repeated_element", name, a, b)
            if c:
                repeated.setdefault(name, []).append(c)
    for name, own in repeated.items():
        out += batches(own, cfg) if len(own) > 3 else own
    for a, b, name in document["spans"]:
        if significant(name, document) and fits(name, a, b):
            out.append(make("element", name, a, b))
    for m in re.finditer(r"<([^/\s>?!<]+)(?:\s[^<>]*)?>([^<]{%d,})</\1>" % max(CONTENT_TEXT, cfg.min_size), text):
        out.append(make("content_element", m.group(1), m.start(), m.end()))
    for first, last in used.gaps():
        a, b = lines.starts[first - 1], lines.starts[last] if last < len(lines.starts) else len(text)
        body = text[a:b].strip()
        if len(body) >= cfg.min_size:
            c = Chunk("xml_element", body, first, last, "mixed_content", importance("", "remaining_content", body), ["xml", "remaining_content", "mixed"])
            if cfg.details:
                analyse(c)
            out.append(c)
    return sorted((c for c in out if c), key=lambda c: c.start)


def batches(own: list[Chunk], cfg: Config) -> Iterator[Chunk]:
    """Like elements in runs of two to five, by the target size: mean importance, all their tags."""
    size = min(5, max(2, cfg.target_size // 200))
    for k in range(0, len(own), size):
        some = own[k : k + size]
        if len(some) == 1:
            yield some[0]
            continue
        name = some[0].name
        tags = list(dict.fromkeys([*(t for c in some for t in c.tags), "batch", f"grouped_{name}"]))
        yield Chunk("xml_element", "\n\n".join(c.content for c in some), some[0].start, some[-1].end, name, sum(c.importance for c in some) / len(some), tags, list(dict.fromkeys(d for c in some for d in c.deps)), {"grouped": str(len(some)), "xml_type": "grouped_elements"})

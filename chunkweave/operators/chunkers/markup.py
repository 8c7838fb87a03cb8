"""Chunkers of documents: HTML, XML, feeds, JSON, Markdown, LaTeX and plain text."""

from __future__ import annotations

import bisect
import json as jsonlib
import re
from collections import Counter
from collections.abc import Iterator
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

from chunkweave.functions.tags import EMAIL, FILE_PATH, TECHNICAL
from chunkweave.operators.chunkers import xmltext
from chunkweave.operators.chunkers.base import Chunk, Config, Coverage, Lines, Span, node_importance, succeeded
from chunkweave.operators.segment import KEY_VALUE, LOG_LINE, NUMBERED, SECTION

SEMANTIC = frozenset("article section header footer main nav aside h1 h2 h3 h4 h5 h6 p div ul ol dl table form figure blockquote pre code script style details".split())
_MARK = re.compile(r"<[^<>]+>")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Elements(HTMLParser):
    """Semantic elements with their source text; unclosed ones end where their parent does."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=False)
        self.text, self.found, self.open = text, [], []
        self.counts: dict[str, int] = {}  # open elements by tag, so that a stray end tag searches nothing
        self.starts = Lines(text).starts
        self.feed(text)
        self.close()
        self._shut(0, len(text))

    def _at(self) -> int:
        line, col = self.getpos()
        return self.starts[line - 1] + col

    def _shut(self, depth: int, end: int) -> None:
        while len(self.open) > depth:
            tag, attrs, start = self.open.pop()
            self.counts[tag] -= 1
            if tag in SEMANTIC:
                self.found.append((start, end, tag, attrs))

    def handle_starttag(self, tag, attrs):
        if tag == "p" and self.open and self.open[-1][0] == "p":
            self._shut(len(self.open) - 1, self._at())
        if tag not in VOID:
            self.open.append((tag, dict(attrs), self._at()))
            self.counts[tag] = self.counts.get(tag, 0) + 1

    def handle_endtag(self, tag):
        if not self.counts.get(tag):
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                here = self._at()
                self._shut(k + 1, here)
                close = self.text.find(">", here)
                self._shut(k, close + 1 if close >= 0 else here)
                return


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TARGET = re.compile(r"""(?:href|src)=["']([^"']+)""")


def html(text: str, cfg: Config) -> Iterator[Chunk]:
    """Every semantic element, nested ones too, however deep; headings pass whatever their size.

    Elements are spans of the text, so that deep nesting costs no copies.
    """
    found = _Elements(text)
    lines = Lines(text)
    marks = [m.start() for m in re.finditer("<", text)] if cfg.wants("importance") else []
    ends: dict[int, int] = {}  # where an element's text ends -> the same without white-space
    for start, end, tag, attrs in sorted(found.found, key=lambda f: (f[0], -f[1])):
        stop = ends.get(end)
        if stop is None:
            stop = end
            while stop and text[stop - 1].isspace():
                stop -= 1
            ends[end] = stop
        heading = tag in _HEADINGS
        if stop <= start or (stop - start < cfg.min_size and not heading):
            continue
        name = attrs.get("id") or (attrs.get("class") or "").split(" ")[0] or tag
        c = Span("html_element", text, start, stop, lines.at(start), lines.at(stop - 1), name, heading)
        if cfg.wants("importance"):
            own = bisect.bisect_left(marks, stop) - bisect.bisect_left(marks, start)
            c.importance = node_importance(0.9 if heading or tag in ("article", "main") else 0.7, text[start : min(stop, start + 1000)], own)  # 1000 characters weigh in full
        if cfg.wants("tags"):
            c.tags = ["html", tag] + ([f"level_{tag[1]}"] if heading else []) + [f"class_{k}" for k in (attrs.get("class") or "").split()] + ([f"id_{attrs['id']}"] if attrs.get("id") else [])
        if cfg.wants("dependencies"):
            c.deps = list(dict.fromkeys(_TARGET.findall(text, start, stop)))
        yield c


def json(text: str, cfg: Config) -> Iterator[Chunk]:
    """The top value as one chunk; JSON lines as one chunk per line."""
    lines = [(k + 1, x) for k, x in enumerate(text.split("\n")) if x.strip()]
    first = text[: len(text) - len(text.lstrip())].count("\n") + 1
    values = [(first, first + text.strip().count("\n"), text.strip())]
    try:
        jsonlib.loads(text)
    except ValueError:
        if len(lines) < 2:
            return
        values = [(k, k, x.strip()) for k, x in lines]
    for a, b, body in values:
        try:
            v = jsonlib.loads(body)
        except ValueError:
            continue
        kind = "json_object" if isinstance(v, dict) else "json_array" if isinstance(v, list) else "json_value"
        c = Chunk(kind, body, a, b, None, node_importance(0.8, body, len(v) if isinstance(v, (dict, list)) else 0), ["json"])
        if isinstance(v, dict):
            c.meta = {"properties": ",".join(v)}
            c.tags += [t for t, ks in (("has_identifier", ("id", "_id", "uuid")), ("has_name", ("name", "title")), ("timestamped", ("created_at", "updated_at", "timestamp", "date"))) if any(k in v for k in ks)]
        elif isinstance(v, list):
            kinds = {type(x).__name__ for x in v}
            c.meta = {"item_types": ",".join(sorted(kinds)), "items": str(len(v))}
            c.tags.append("homogeneous" if len(kinds) <= 1 else "heterogeneous")
        c.deps = list(dict.fromkeys(re.findall(r'"\$ref"\s*:\s*"([^"]+)"', body)))
        yield c


# --- xml and feeds -------------------------------------------------------------------


_SPACES = re.compile(r' xmlns(:\w+)?="[^"]*"')


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _text(node: ET.Element | None) -> str:
    return "".join(node.itertext()).strip() if node is not None else ""


def strip_html(text: str, cap: int = 2000) -> str:
    flat = " ".join(_MARK.sub(" ", text).split())
    return flat[:cap] + "..." if len(flat) > cap else flat


def parse_date(text: str) -> datetime | None:
    """ISO or RFC 2822, in UTC; None for anything else."""
    text = text.strip()
    try:
        d = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        try:
            d = parsedate_to_datetime(text)
        except (ValueError, TypeError):
            return None
    return d.astimezone(timezone.utc) if d.tzinfo else d.replace(tzinfo=timezone.utc)


def _parsed(text: str) -> ET.Element | None:
    """The root element, or None where the text isn't well-formed."""
    try:
        return ET.fromstring(text)
    except ET.ParseError:
        return None


def feed_kind(text: str) -> str:
    """rss2, rss1, atom or unknown; the root element decides where it can be read."""
    return _kind_of(text, _parsed(text))


def _kind_of(text: str, root: ET.Element | None) -> str:
    if root is not None:
        return {"rss": "rss2", "rdf": "rss1", "feed": "atom"}.get(_local(root.tag).lower(), "unknown")
    low = text.lower()
    return "rss1" if "<rdf:rdf" in low else "rss2" if re.search(r"<rss[ >]", low) else "atom" if re.search(r"<feed[ >]", low) else "unknown"


_FEEDS = {"rss2": ("channel", "item", 200, 30, 20), "atom": (None, "entry", 200, 25, 25), "rss1": ("channel", "item", 100, 20, 15)}


def _item_text(node: ET.Element) -> tuple[str, list[str], list[str], str, bool]:
    parts, tags, links, title, media = [], [], [], "", False
    for x in node:
        name, value = _local(x.tag), _text(x)
        if name == "title":
            title = value
            parts.insert(0, f"Title: {value}")
        elif name in ("description", "summary", "subtitle"):
            parts.append(f"Description: {strip_html(value)}")
        elif name in ("encoded", "content"):
            parts.append(f"Content: {strip_html(value or ET.tostring(x, encoding='unicode'), 2500)}")
        elif name in ("author", "creator", "contributor"):
            parts.append(f"Author: {_text(x.find('{*}name')) or value}")
            tags.append("has_author")
        elif name in ("pubDate", "date", "updated", "published"):
            d = parse_date(value)
            parts.append(f"Date: {d.isoformat() if d else value}")
        elif name in ("category", "subject"):
            label = x.get("term") or value
            if label:
                parts.append(f"Category: {label}")
                tags.append("category:" + label)
        elif name == "link":
            target = x.get("href") or value
            if target:
                links.append(target)
        elif name in ("enclosure", "thumbnail") or "media" in x.tag:
            media = True
            if x.get("url"):
                links.append(x.get("url"))
    return "\n".join(parts), tags, links, title, media


def feed(text: str, cfg: Config) -> Iterator[Chunk]:
    """One chunk for the feed itself and one per item, rendered as labelled text.

    A feed that can't be read gives one summary chunk of low importance.
    """
    root = _parsed(text)
    kind = _kind_of(text, root)
    if root is None or kind == "unknown":
        title = re.search(r"<title[^>]*>(.*?)</title>", text, re.S)
        n = max(len(re.findall(r"<item[ >]", text)), len(re.findall(r"<entry[ >]", text)))
        yield Chunk("feed", f"Feed: {strip_html(title.group(1)) if title else 'unknown'}\nItems: {n}", 1, text.count("\n") + 1, "feed", 0.3, ["feed", "fallback"])
        return
    head_name, item_name, most, least, step = _FEEDS[kind]
    head = root.find(f"{{*}}{head_name}") if head_name else root
    if head is None:
        head = root.find(head_name) if head_name else root
    head = root if head is None else head
    plain = [x for x in head if _local(x.tag) not in ("item", "entry", "items")]
    shell = ET.Element("head")
    shell.extend(plain)
    body, tags, links, title, _ = _item_text(shell)
    yield Chunk("feed", f"Feed: {title}\n{body}", 1, 10, "feed_metadata", 0.95, ["feed", kind, *tags], links)
    items = [x for x in root.iter() if _local(x.tag) == item_name][:most]
    for i, x in enumerate(items):
        body, tags, links, title, media = _item_text(x)
        if len(body) >= least:
            start = step * i + 1
            c = Chunk("feed_item", body, start, start + body.count("\n"), title[:50], 0.7 + 0.1 * media + 0.1 * (len(body) > 500), ["feed", kind, "item", *tags, *(["media"] if media else [])], links)
            yield c


def xml(text: str, cfg: Config) -> Iterator[Chunk]:
    """Elements near the target size, repeated small ones in batches; where the tree can't be read or splits badly, by tags."""
    root = _parsed(text)
    if _kind_of(text, root) != "unknown":
        yield from feed(text, cfg)
        return
    found = list(_by_tree(text, root, cfg)) if root is not None else []
    if not succeeded(found, text, cfg):
        other = xmltext.by_tags(text, cfg)
        found = other if len(other) > len(found) else found
    yield from found or [Chunk("xml_element", text.strip(), 1, text.count("\n") + 1, "document", 0.5, ["xml", "fallback"])]


def _by_tree(text: str, root: ET.Element, cfg: Config) -> Iterator[Chunk]:
    lines = Lines(text)
    cursor = 0

    def place(node: ET.Element) -> tuple[int, str]:
        nonlocal cursor
        m = re.compile(rf"<([\w.-]+:)?{re.escape(_local(node.tag))}\b").search(text, cursor)
        if m:
            cursor = m.start() + 1
        return lines.at(m.start()) if m else 1, ET.tostring(node, encoding="unicode").strip()

    def emit(nodes: list[ET.Element]) -> Chunk:
        spots = [place(x) for x in nodes]
        body = "\n".join(_SPACES.sub("", s[1]) for s in spots)
        name = _local(nodes[0].tag)
        c = Chunk("xml_element", body, spots[0][0], spots[0][0] + body.count("\n"), name)
        if not cfg.details:
            return c
        c.importance = node_importance(0.7, body, sum(len(x) for x in nodes))
        words = len(_MARK.sub("", body).strip())
        c.tags = ["xml", name] + (["has_attributes"] if any(x.attrib for n in nodes for x in n.iter()) else []) + (["text_heavy"] if words > 0.7 * len(body) else []) + (["batch"] if len(nodes) > 1 else [])
        c.deps = list(dict.fromkeys(v for n in nodes for x in n.iter() for k, v in x.attrib.items() if _local(k) in ("href", "src", "ref")))
        return c

    def walk(node: ET.Element, depth: int) -> Iterator[Chunk]:
        size = len(ET.tostring(node, encoding="unicode"))
        if depth > 30 or size <= cfg.max_size or not len(node):
            yield emit([node])
            return
        groups: list[list[ET.Element]] = []
        for x in node:
            if groups and groups[-1][0].tag == x.tag:
                groups[-1].append(x)
            else:
                groups.append([x])
        batch = min(5, max(2, cfg.target_size // 200))
        for g in groups:
            mean = sum(len(ET.tostring(x, encoding="unicode")) for x in g) / len(g)
            if len(g) > 2 and mean < cfg.target_size:
                for a in range(0, len(g), batch):
                    yield emit(g[a : a + batch])
            else:
                for x in g:
                    yield from walk(x, depth + 1)

    yield from walk(root, 0)


# --- markdown and latex -----------------------------------------------------------------


def markdown(text: str, cfg: Config) -> Iterator[Chunk]:
    """Heading sections and what is in and before them; sections by underlined or numbered headings where those split better."""
    found = list(_by_blocks(text, cfg))
    if not succeeded(found, text, cfg):
        other = [Chunk("section", body, a, b, f"section_{a}", 0.6, ["markdown", "section"]) for _, a, b, body in _sections(text, cfg) if len(body) >= cfg.min_size]
        found = other if len(other) > len(found) else found
    yield from found


def _by_blocks(text: str, cfg: Config) -> Iterator[Chunk]:
    """Heading sections, and inside and before them fenced code, tables, lists, quotes and paragraphs."""
    lines = text.split("\n")
    fence = None
    kinds = []
    for line in lines:
        s = line.strip()
        if fence:
            kinds.append("code")
            fence = None if s.startswith(fence) and s == fence else fence
        elif s.startswith("```") or s.startswith("~~~"):
            fence = s[:3]
            kinds.append("code")
        elif re.match(r"#{1,6}\s+\S", line):
            kinds.append("heading")
        elif not s:
            kinds.append("blank")
        elif s.count("|") >= 2:
            kinds.append("table")
        elif re.match(r"\s*([-*+]|\d+[.)])\s+", line) or (line.startswith("  ") and kinds and kinds[-1] == "list"):
            kinds.append("list")
        elif s.startswith(">"):
            kinds.append("quote")
        else:
            kinds.append("paragraph")
    heads = [(k, len(re.match(r"#+", lines[k]).group())) for k, kind in enumerate(kinds) if kind == "heading"]
    for n, (k, level) in enumerate(heads):
        end = next((j for j, deeper in heads[n + 1 :] if deeper <= level), len(lines))
        body = "\n".join(lines[k:end]).rstrip()
        c = Chunk("heading", body, k + 1, k + 1 + body.count("\n"), lines[k].lstrip("# ").strip()[:50], 1.0 - 0.1 * level, ["markdown", "heading", f"level_{level}"], always=True)
        if cfg.details:
            _markdown_tags(c)
        yield c
    k = 0
    while k < len(lines):
        kind = kinds[k]
        end = k
        while end < len(lines) and kinds[end] == kind:
            end += 1
        if kind in ("code", "table", "list", "quote", "paragraph"):
            body = "\n".join(lines[k:end]).strip("\n")
            if kind == "table" and end - k < 2:
                kind = "paragraph"
            if len(body) >= cfg.min_size or kind != "paragraph":
                c = Chunk(kind if kind != "code" else "code_block", body, k + 1, end, f"{kind}_{k + 1}", 0.6 if kind == "code" else 0.5, ["markdown", kind])
                if not cfg.details:
                    yield c
                    k = end
                    continue
                if kind == "table":
                    rows = [x for x in lines[k:end] if not re.fullmatch(r"[\s|:-]+", x)]
                    c.meta = {"rows": str(len(rows)), "columns": str(max(x.strip().strip("|").count("|") + 1 for x in rows) if rows else 0)}
                _markdown_tags(c)
                yield c
        k = end


def _markdown_tags(c: Chunk) -> None:
    rules = (("links", r"\[[^\]]+\]\([^)]+\)"), ("images", r"!\[[^\]]*\]\([^)]+\)"), ("code", r"```|`[^`]+`"), ("emphasis", r"\*{2}[^*]+\*{2}"), ("todo", r"[-*] \[[ xX]\]"))
    c.tags += [n for n, p in rules if re.search(p, c.content) and n not in c.tags]
    c.deps = list(dict.fromkeys(re.findall(r"\]\(([^)\s]+)", c.content)))


LATEX_FAMILIES = {
    "math": r"equation|align|gather|multline|eqnarray|displaymath", "float": r"figure|table|wrapfigure", "theorem": r"theorem|lemma|proof|definition|corollary|proposition|remark|example",
    "code": r"lstlisting|verbatim|minted", "list": r"itemize|enumerate|description", "tabular": r"tabular|tabularx|longtable", "abstract": r"abstract", "bibliography": r"thebibliography", "tikz": r"tikzpicture",
}
_LEVELS = ("part", "chapter", "section", "subsection", "subsubsection", "paragraph")


_ENDS = re.compile(r"\\(begin|end)\{(\w+\*?)\}")
_DISPLAY = re.compile(r"\$\$.+?\$\$|\\\[.+?\\\]", re.S)
_HEAD = re.compile(rf"\\({'|'.join(_LEVELS)})\*?\{{([^}}]*)\}}")
_LATEX_DEPS = re.compile(r"\\(cite[tp]?|ref|eqref|input|include|usepackage)(?:\[[^\]]*\])?\{([^}]*)\}")
_LATEX_TAGS = tuple((n, re.compile(p)) for n, p in (("citation", r"\\cite"), ("reference", r"\\(eq)?ref\{"), ("label", r"\\label\{"), ("graphics", r"\\includegraphics")))
ACADEMIC = (("introduction", "introduction|motivation"), ("related_work", "related work|background|literature"), ("methods", "method|approach|model"), ("results", "result|evaluation|experiment"), ("discussion", "discussion"), ("conclusion", "conclusion|summary|future work"))


def environments(text: str) -> list[tuple[int, int, str]]:
    """(start, end, name) of every environment: each ends at the first end of its name after it."""
    ends: dict[str, list[int]] = {}
    begins = []
    for m in _ENDS.finditer(text):
        if m.group(1) == "begin":
            begins.append((m.start(), m.group(2)))
        else:
            ends.setdefault(m.group(2), []).append(m.end())
    out = []
    for a, name in begins:
        own = ends.get(name, [])
        k = bisect.bisect_right(own, a)
        if k < len(own):
            out.append((a, own[k], name))
    return out


def latex(text: str, cfg: Config) -> Iterator[Chunk]:
    """Preamble, environments, displayed math, then sections and what is left between them; no line is used twice.

    Each chunk names the one before it, and the section it is in: the nearest
    earlier one, of a section the nearest of a lower level.
    """
    lines = Lines(text)
    used = Coverage(len(lines.starts))
    out: list[Chunk] = []

    def add(kind: str, a: int, b: int, name: str, importance: float, tags: list[str]) -> None:
        piece = text[a:b]
        body = piece.strip()
        if not body:
            return
        start = lines.at(a + len(piece) - len(piece.lstrip()))
        end = start + body.count("\n")
        if used.meets(start, end):
            return
        used.add(start, end)
        c = Chunk(kind, body, start, end, name, importance, ["latex", *tags])
        if cfg.details:
            c.deps = list(dict.fromkeys(f"{k}:{v}" for k, v in _LATEX_DEPS.findall(body)))
            _latex_analysis(c)
        out.append(c)

    begin = text.find("\\begin{document}")
    if begin > 0:
        add("preamble", 0, begin, "preamble", 0.7, ["preamble"])
    spans = [s for s in environments(text) if s[2] != "document"]
    for family, names in LATEX_FAMILIES.items():
        at = 0
        for a, b, name in spans:
            if a >= at and re.fullmatch(names, name.rstrip("*")):
                add("environment", a, b, name.rstrip("*"), 0.8 if family in ("theorem", "math", "abstract") else 0.6, [family, name.rstrip("*")])
                at = b
    at = 0
    for a, b, name in spans:
        if a >= at:
            add("environment", a, b, name.rstrip("*"), 0.5, ["environment", name.rstrip("*")])
            at = b
    for m in _DISPLAY.finditer(text):
        add("math", m.start(), m.end(), "display", 0.7, ["math"])
    heads = list(_HEAD.finditer(text))
    for k, m in enumerate(heads):
        end = heads[k + 1].start() if k + 1 < len(heads) else len(text)
        # the section's own text ends where the first taken line begins
        taken = used.next_used(lines.at(m.start()))
        stop = min(end, lines.starts[taken - 1] if taken <= len(lines.starts) else len(text))
        low = m.group(2).lower()
        academic = [n for n, p in ACADEMIC if re.search(p, low)]
        add("section", m.start(), max(stop, m.start() + 1) if stop > m.start() else m.end(), m.group(2)[:50], 1.0 - 0.1 * _LEVELS.index(m.group(1)), ["section", m.group(1), *academic])
    head_line = lines.at(begin) + 1 if begin >= 0 else 1
    for a, b in used.gaps():
        a = max(a, head_line)
        if b < a:
            continue
        last = lines.starts[b] if b < len(lines.starts) else len(text)
        flat = text[lines.starts[a - 1] : last].replace("\\end{document}", "").strip()
        if len(flat) >= cfg.min_size:
            out.append(Chunk("text_block", flat, a, b, f"text_{a}", 0.4, ["latex", "gap"]))
    previous, parents = None, {}
    for c in sorted(out, key=lambda c: c.start):
        if not cfg.details:
            yield c
            continue
        if previous:
            c.deps.append(f"follows:{previous}")
        previous = f"{c.kind}_{c.start}"
        level = _LEVELS.index(c.tags[2]) if c.kind == "section" else len(_LEVELS)
        above = [parents[k] for k in parents if k < level]
        if above:
            c.meta["parent"] = max(above)[1]
        if c.kind == "section":
            parents = {k: v for k, v in parents.items() if k < level} | {level: (c.start, c.name)}
        yield c


def _latex_analysis(c: Chunk) -> None:
    """Counts of math, citations, references, labels, graphics, and the ten commonest commands."""
    c.tags += [n for n, p in _LATEX_TAGS if p.search(c.content)]
    commands = Counter(re.findall(r"\\([A-Za-z]+)", c.content))
    c.meta |= {
        "math": str(len(re.findall(r"(?<!\\)\$[^$]+\$", c.content))),
        "citations": str(sum(n for k, n in commands.items() if k.startswith("cite"))),
        "labels": str(commands["label"]),
        "references": str(commands["ref"] + commands["eqref"]),
        "graphics": str(commands["includegraphics"]),
        "commands": ",".join(f"{k}:{n}" for k, n in sorted(commands.items(), key=lambda x: (-x[1], x[0]))[:10]),
    }
    if c.kind == "preamble":
        c.meta |= {"packages": ",".join(p.strip() for x in re.findall(r"\\usepackage(?:\[[^\]]*\])?\{([^}]*)\}", c.content) for p in x.split(",")), "document_class": (re.findall(r"\\documentclass(?:\[[^\]]*\])?\{([^}]*)\}", c.content) or [""])[0]}


# --- plain text -----------------------------------------------------------------------


_LOG = re.compile(LOG_LINE)
_PAIR = re.compile(KEY_VALUE)
_SECTION = re.compile(SECTION)
_NUMBER = re.compile(NUMBERED)


def text_kind(text: str) -> str:
    lines = text.split("\n")
    n = len(lines)
    if sum(bool(_LOG.search(x)) for x in lines) > 0.3 * n:
        return "log"
    if sum(bool(_PAIR.search(x)) for x in lines) > 0.4 * n:
        return "config"
    return "structured" if sum(bool(_SECTION.search(x)) + bool(_NUMBER.search(x)) for x in lines) > 0.1 * n else "plain"


def plain(text: str, cfg: Config) -> Iterator[Chunk]:
    """By the kind of text: sections, log entries, config blocks or paragraphs."""
    kind = text_kind(text)
    split = {"structured": _sections, "log": _logs, "config": _blocks, "plain": _paragraphs}[kind]
    for what, a, b, body in split(text, cfg):
        c = Chunk("text_block", body, a, b, f"{what}_{a}")
        if cfg.details:
            c.importance = heuristic_importance(body)
            c.tags = ["text_content", f"text_{what}", *text_features(body)]
        yield c


def heuristic_importance(body: str) -> float:
    words, lines = len(body.split()), body.count("\n") + 1
    score = 0.5 + 0.1 * (50 <= words <= 200) + 0.1 * (5 <= lines <= 50) + 0.1 * bool(re.search(r"def |class |function |const ", body))
    return min(1.0, max(0.1, score))


def text_features(body: str) -> list[str]:
    parts = re.split(r"[.!?]+", body)
    average = len(body.split()) / len(parts)
    rules = (
        ("contains_email", bool(re.search(EMAIL, body))),
        ("contains_url", bool(re.search(r"https?://\S+", body))),
        ("contains_filepath", bool(re.search(FILE_PATH, body))),
        ("complex_text", average > 20),
        ("simple_text", average < 5),
        ("technical_content", bool(re.search(TECHNICAL, body.lower()))),
    )
    return [n for n, ok in rules if ok]


def _sections(text: str, cfg: Config) -> Iterator[tuple[str, int, int, str]]:
    lines, start = text.split("\n"), 0
    for k, x in enumerate(lines):
        if (_SECTION.search(x) or _NUMBER.search(x)) and k > start:
            yield "section", start + 1, k, "\n".join(lines[start:k])
            start = k
    yield "section", start + 1, len(lines), "\n".join(lines[start:])


def _logs(text: str, cfg: Config) -> Iterator[tuple[str, int, int, str]]:
    """A new entry at every dated line; entries under the least size are dropped, over the most they are flushed."""
    lines, held, start = text.split("\n"), [], 1
    for k, x in enumerate(lines, 1):
        if _LOG.search(x) and held:
            body = "\n".join(held)
            if len(body) >= cfg.min_size:
                yield "log_entry", start, k - 1, body
            held, start = [x], k
        else:
            held.append(x)
        body = "\n".join(held)
        if len(body) > cfg.max_size:
            yield "log_entry", start, k, body
            held, start = [], k + 1
    body = "\n".join(held)
    if held and len(body) >= cfg.min_size:
        yield "log_entry", start, len(lines), body


def _blocks(text: str, cfg: Config) -> Iterator[tuple[str, int, int, str]]:
    lines, held, start = text.split("\n"), [], 1
    for k, x in enumerate(lines, 1):
        comment = x.startswith(("#", ";"))
        if x.strip() and not comment:
            held.append(x)
            continue
        if held:
            body = "\n".join(held)
            if len(body) >= cfg.min_size:
                yield "config_section", start, k - 1, body
            held, start = [], k + 1
        if comment:
            held.append(x)
    body = "\n".join(held)
    if held and len(body) >= cfg.min_size:
        yield "config_section", start, len(lines), body


def _paragraphs(text: str, cfg: Config) -> Iterator[tuple[str, int, int, str]]:
    line, any_found = 1, False
    for p in re.split(r"\n\s*\n", text):
        p = p.strip()
        if not p:
            continue
        n = p.count("\n") + 1
        if len(p) >= cfg.min_size:
            any_found = True
            yield "paragraph", line, line + n - 1, p
        line += n + 1
    if any_found:
        return
    lines, held, start = text.split("\n"), [], 1
    for k, x in enumerate(lines, 1):
        held.append(x)
        body = "\n".join(held)
        if len(body) >= cfg.target_size:
            yield "text_block", start, k, body
            held, start = [], k + 1
    body = "\n".join(held)
    if held and len(body) >= cfg.min_size:
        yield "text_block", start, len(lines), body

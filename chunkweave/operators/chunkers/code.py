"""Chunkers of programming languages: Python by its syntax tree, others by scanning braces."""

from __future__ import annotations

import ast
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

from chunkweave.operators.chunkers.base import Chunk, Config, Lines, node_importance, size_tags

ROLES = (("controller", "controller|handler|endpoint|route"), ("service", "service|manager|provider"), ("repository", "repository|dao|store"), ("model", "model|entity|schema"), ("utility", "util|helper|tool"), ("test", "test|mock|fixture"))


def docstring_quality(doc: str) -> float:
    n = len(doc.strip())
    score = 0.4 if n >= 200 else 0.3 if n >= 100 else 0.2 if n >= 50 else 0.1 if n else 0.0
    score += 0.3 if re.search(r"args:|returns:|raises:|example|param", doc.lower()) else 0.0
    ends = len(re.findall(r"[.!?]", doc))
    return min(1.0, score + (0.3 if ends >= 3 else 0.2 if ends else 0.0))


_DECISIONS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.Assert, ast.comprehension, ast.match_case)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
#: Node type -> the fields that hold nodes.
_BRANCHES: dict[type, tuple[str, ...]] = {}
_LEAVES = frozenset("ctx op ops id attr name names module level n s kind lineno type_comment type_ignores arg asname rest simple is_async conversion tag type_params".split())


@dataclass
class Facts:
    """What one walk over a definition tells."""

    cyclomatic: int = 1
    slots: int = 0
    annotated: int = 0
    caught: bool = False
    yields: bool = False
    abstract: bool = False
    calls: dict[str, None] = field(default_factory=dict)

    @property
    def type_coverage(self) -> float:
        """Share of parameters and returns of the functions inside that are annotated."""
        return self.annotated / self.slots if self.slots else 0.0


def facts(node: ast.AST) -> Facts:
    """Decision points, annotations, calls and flags, in one walk, level by level."""
    f = Facts()
    queue: list[ast.AST] = [node]
    for x in queue:  # grows while it is read
        kind = type(x)
        if kind is ast.Call:
            target = x.func
            called = target.id if type(target) is ast.Name else target.attr if type(target) is ast.Attribute else None
            if called:
                f.calls[f"calls:{called}"] = None
        elif kind in _FUNCTIONS:
            args = [a for a in [*x.args.posonlyargs, *x.args.args, *x.args.kwonlyargs] if a.arg not in ("self", "cls")]
            f.slots += len(args) + 1
            f.annotated += sum(a.annotation is not None for a in args) + (x.returns is not None)
        elif kind in _DECISIONS:
            f.cyclomatic += 1
        elif kind is ast.BoolOp:
            f.cyclomatic += len(x.values) - 1
        elif kind is ast.Try:
            f.caught = True
        elif kind is ast.Yield or kind is ast.YieldFrom:
            f.yields = True
        if not f.abstract and getattr(x, "decorator_list", None):
            f.abstract = any("abstract" in ast.dump(d) for d in x.decorator_list)
        names = _BRANCHES.get(kind)
        if names is None:
            names = _BRANCHES[kind] = tuple(n for n in x._fields if n not in _LEAVES and not (kind is ast.Constant and n == "value"))
        for n in names:
            v = getattr(x, n, None)
            if v.__class__ is list:
                queue += [y for y in v if isinstance(y, ast.AST)]
            elif isinstance(v, ast.AST):
                queue.append(v)
    return f


def cyclomatic(node: ast.AST) -> int:
    """One and every decision point."""
    return facts(node).cyclomatic


def role(name: str) -> str:
    low = name.lower()
    return next((r for r, p in ROLES if re.search(p, low)), "component")


_CHUNKS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Import, ast.ImportFrom, ast.Assign, ast.AnnAssign)


def _first_hits(nodes: list[ast.stmt], depth: int = 0) -> Iterator[ast.stmt]:
    """Chunk nodes; other statements are searched inside, down to 30 levels, and a hit isn't."""
    for x in nodes:
        if isinstance(x, _CHUNKS):
            yield x
        elif depth < 30:
            for branch in ("body", "handlers", "orelse", "finalbody", "cases"):
                yield from _first_hits(getattr(x, branch, []), depth + 1)


def python(text: str, cfg: Config) -> Iterator[Chunk]:
    """Outermost functions, classes, imports and assignments, also inside other statements; a file that doesn't parse gives none."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return
    lines = text.split("\n")
    imports: list[tuple[Chunk, str]] = []
    for node in _first_hits(tree.body):
        first = min([node.lineno, *[d.lineno for d in getattr(node, "decorator_list", [])]])
        body = "\n".join(lines[first - 1 : node.end_lineno])
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            is_class = isinstance(node, ast.ClassDef)
            c = Chunk("class" if is_class else "function", body, first, node.end_lineno, node.name)
            if not cfg.details:
                yield c
                continue
            c.importance = node_importance(0.9, body, len(node.body))
            doc, f = ast.get_docstring(node) or "", facts(node)
            c.tags.append(c.kind)
            flags = {
                "async": isinstance(node, ast.AsyncFunctionDef),
                "decorated": bool(node.decorator_list),
                "generator": not is_class and f.yields,
                "inherits": is_class and bool(node.bases),
                "abstract": f.abstract,
                "error_handling": f.caught,
            }
            c.tags += [k for k, v in flags.items() if v]
            c.deps = [*f.calls, f"declares:{node.name}"]
            c.meta = {"docstring_quality": f"{docstring_quality(doc):.2f}", "type_coverage": f"{f.type_coverage:.4f}", "cyclomatic": str(f.cyclomatic), "role": role(node.name)}
            size_tags(c)
            yield c
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else ["." * node.level + (node.module or "")]
            head = names[0].split(".")[0]
            kind = "local" if not head or head in ("src", "app", "lib") else "stdlib" if head in sys.stdlib_module_names else "third_party"
            c = Chunk("import", body, node.lineno, node.end_lineno, names[0].replace(".", "_"), 0.6, ["import", kind], [f"imports:{n}" for n in names])
            imports.append((c, kind))
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            target = node.targets[0] if isinstance(node, ast.Assign) else node.target
            c = Chunk("variable", body, node.lineno, node.end_lineno, target.id if isinstance(target, ast.Name) else None, node_importance(0.4, body, 1), ["variable"])
            size_tags(c)
            yield c
    yield from _group_imports(imports) if cfg.group_imports else (c for c, _ in imports)


def _group_imports(imports: list[tuple[Chunk, str]]) -> Iterator[Chunk]:
    """More than three standard imports, and more than two of others, become one chunk each; local ones stay."""
    for kind, over in (("stdlib", 3), ("third_party", 2), ("local", None)):
        own = [c for c, k in imports if k == kind]
        if over is None or len(own) <= over:
            yield from own
        else:
            deps = [d for c in own for d in c.deps]
            yield Chunk("import", "\n".join(c.content for c in own), own[0].start, own[-1].end, f"{kind}_imports", 0.6, ["import", kind, "grouped"], deps)


# --- brace languages ---------------------------------------------------------------


def _skip(text: str, i: int, marks: str) -> int:
    """The index after a string or comment that starts at i, or i."""
    c = text[i]
    if c == "/":
        if text.startswith("//", i):
            end = text.find("\n", i)
            return len(text) if end < 0 else end
        if text.startswith("/*", i):
            end = text.find("*/", i + 2)
            return len(text) if end < 0 else end + 2
        return i
    if c in marks:
        m = _STRING[c].match(text, i + 1)
        j = m.end()
        return j if text.startswith("\n", j) else min(j + 1, len(text))
    return i


#: What a string holds: up to its mark, or to the line's end where it can't go on.
_STRING = {c: re.compile(rf"(?:[^{c}\\{'' if c == '`' else chr(10)}]|\\.)*", re.S) for c in "\"'`"}
_GOES_ON = re.compile(r"\s*([.?:+*/%&|=,{(\[)<-]|(where|extends|implements|throws|from|else|catch|finally)\b)")
_TURN = re.compile(r"[\"'`/{}()\[\];\n]")
_CLOSED = re.compile(r"[ \t]*[;,)]*")


def statement_end(text: str, i: int, marks: str = "\"'`") -> int:
    """End of the statement that starts at i: its closing brace, or its semicolon or line outside brackets.

    A line ends a statement unless its last or the next line's first character joins them.
    """
    depth, opened = 0, False
    begun = i
    while True:
        m = _TURN.search(text, i)
        if not m:
            return len(text)
        i, c = m.start(), m.group()
        if c in "{([":
            depth += 1
            opened |= c == "{"
        elif c in "})]":
            depth -= 1
            if depth <= 0 and c == "}" and opened:
                rest = _CLOSED.match(text, i + 1)
                return rest.end() if ";" in rest.group() else i + 1
        elif c in ";\n":
            if depth == 0 and (c == ";" or opened):
                return i + 1
            if depth == 0:
                k = i - 1
                while k >= begun and text[k].isspace():
                    k -= 1
                if not (k >= begun and text[k] in "=+*/%&|?:,(<>.]-") and not _GOES_ON.match(text, i):
                    return i + 1
        else:
            j = _skip(text, i, marks)
            if j > i:
                i = j
                continue
        i += 1


_SPACES = re.compile(r"[ \t\r\n]*")
_NO_CALL = frozenset("fn for function if match return switch while".split())


_CALLED = re.compile(r"\b([A-Za-z_]\w*)\s*\(")


def _compiled(heads: list[tuple[str, str, float]]) -> list[tuple[re.Pattern, str, float]]:
    return [(re.compile(p), k, s) for p, k, s in heads]


def _scan(text: str, patterns: list[tuple[re.Pattern, str, float]], marks: str, tags, details: bool = True) -> Iterator[Chunk]:
    """Chunks that begin with one of the heads (pattern with a group `name`, kind, score) outside other chunks."""
    i, lines = 0, Lines(text)
    while True:
        i = _SPACES.match(text, i).end()
        if i >= len(text):
            return
        j = _skip(text, i, marks)
        if j > i:
            i = j
            continue
        for p, kind, score in patterns:
            m = p.match(text, i)
            if m:
                end = statement_end(text, i, marks)
                body = text[i:end].rstrip()
                start = lines.at(i)
                c = Chunk(kind, body, start, start + body.count("\n"), m.groupdict().get("name"))
                if details:
                    c.importance = node_importance(score, body, body.count("\n") + 1)
                    c.tags = [kind, *tags(body)]
                    c.deps = list(dict.fromkeys(f"calls:{x}" for x in _CALLED.findall(body) if x not in _NO_CALL))
                    size_tags(c)
                yield c
                i = max(end, i + 1)
                break
        else:
            end = statement_end(text, i, marks)
            i = max(end, i + 1)


JS_HEADS = [
    (r"import\b", "import", 0.6),
    (r"export\s+default\s+(async\s+)?function\s*\*?\s*(?P<name>\w*)", "function", 0.9),
    (r"(export\s+)?(async\s+)?function\s*\*?\s*(?P<name>\w+)", "function", 0.9),
    (r"(export\s+(default\s+)?)?(abstract\s+)?class\s+(?P<name>\w+)", "class", 0.9),
    (r"(export\s+)?interface\s+(?P<name>\w+)", "interface", 0.8),
    (r"(export\s+)?(type|enum)\s+(?P<name>\w+)", "type", 0.7),
    (r"(export\s+)?(const|let|var)\s+(?P<name>\w+)\s*(:[^=]+)?=\s*(async\s*)?(\([^)]*\)|\w+)\s*(:[^=]+)?=>", "function", 0.9),
    (r"(export\s+)?(const|let|var)\s+(?P<name>\w+)", "variable", 0.5),
    (r"export\b", "export", 0.6),
]
JS_TAGS = (("async", r"\basync\b"), ("arrow", r"=>"), ("generator", r"function\s*\*"), ("static", r"\bstatic\b"), ("accessor", r"\b(get|set)\s+\w+\s*\("), ("const", r"^(export\s+)?const\b"), ("export", r"^export\b"), ("hooks", r"\buse(State|Effect|Memo|Ref|Callback|Context)\b"), ("jsx", r"<[A-Z]\w*[^>]*/?>"))
RUST_HEADS = [
    (r"use\b", "import", 0.6),
    (r"(?:#\[[^\]]*\]\s*)*(pub(\([^)]*\))?\s+)?(const\s+|async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*fn\s+(?P<name>\w+)", "function", 0.9),
    (r"(?:#\[[^\]]*\]\s*)*(pub(\([^)]*\))?\s+)?struct\s+(?P<name>\w+)", "struct", 0.9),
    (r"(?:#\[[^\]]*\]\s*)*(pub(\([^)]*\))?\s+)?enum\s+(?P<name>\w+)", "enum", 0.8),
    (r"(?:#\[[^\]]*\]\s*)*(pub(\([^)]*\))?\s+)?(unsafe\s+)?trait\s+(?P<name>\w+)", "trait", 0.9),
    (r"(?:#\[[^\]]*\]\s*)*(unsafe\s+)?impl\b(<[^{]*?>)?\s*(?P<name>\w+)", "impl", 0.8),
    (r"(?:#\[[^\]]*\]\s*)*(pub(\([^)]*\))?\s+)?mod\s+(?P<name>\w+)", "module", 0.7),
    (r"(pub(\([^)]*\))?\s+)?(const|static)\s+(?P<name>\w+)", "constant", 0.5),
    (r"(pub(\([^)]*\))?\s+)?type\s+(?P<name>\w+)", "type", 0.6),
    (r"macro_rules!\s*(?P<name>\w+)", "macro", 0.7),
]
RUST_TAGS = (("public", r"\bpub\b"), ("unsafe", r"\bunsafe\b"), ("extern", r"\bextern\b"), ("async", r"\basync\b"), ("derive", r"#\[derive\("), ("trait_impl", r"\bimpl\b[^{]*\bfor\b"), ("mutable", r"\bmut\b"), ("glob_import", r"::\*"))


def _tagger(rules: tuple[tuple[str, str], ...]):
    compiled = [(n, re.compile(p)) for n, p in rules]
    return lambda body: [n for n, p in compiled if p.search(body)]


_JS, _JS_TAGGER = _compiled(JS_HEADS), _tagger(JS_TAGS)
_RUST, _RUST_TAGGER = _compiled(RUST_HEADS), _tagger(RUST_TAGS)


def javascript(text: str, cfg: Config) -> Iterator[Chunk]:
    return _scan(text, _JS, "\"'`", _JS_TAGGER, cfg.details)


def rust(text: str, cfg: Config) -> Iterator[Chunk]:
    return _scan(text, _RUST, '"', _RUST_TAGGER, cfg.details)


CSS_IMPORTANT = {"media": 0.8, "keyframes": 0.7, "import": 0.6, "rule": 0.7, "at_rule": 0.6}


_CSS_COMMENT, _NO_BREAK = re.compile(r"/\*.*?\*/", re.S), re.compile(r"[^\n]")
_CSS_TURN = re.compile(r"[{};\"']")
_CSS_AT = re.compile(r"@(-\w+-)?(\w+)")
_SELECTORS = tuple((n, re.compile(p)) for n, p in (("class_selector", r"\.[A-Za-z_-]"), ("id_selector", r"#[A-Za-z_-]"), ("pseudo_selector", r":\w"), ("attribute_selector", r"\[")))
_CSS_BODY = tuple((n, re.compile(p)) for n, p in (("layout", r"display\s*:\s*(flex|grid)"), ("animation", r"animation")))
_CSS_URL = re.compile(r"""url\(["']?([^"')]+)""")
_CSS_IMPORT = re.compile(r"""@import\s+["']([^"']+)""")
_PROPERTY = re.compile(r"([a-z-]+)\s*:[^;{}]+[;}]")


def _css_end(text: str, i: int) -> int:
    """End of the rule or at-rule that starts at i."""
    depth = 0
    while True:
        m = _CSS_TURN.search(text, i)
        if not m:
            return len(text)
        i, c = m.end(), m.group()
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return i
        elif c == ";":
            if depth == 0:
                return i
        else:
            i = _skip(text, m.start(), c)


def css(text: str, cfg: Config) -> Iterator[Chunk]:
    """Rules and at-rules of the top level, comments left out."""
    bare = _CSS_COMMENT.sub(lambda m: _NO_BREAK.sub(" ", m.group()), text)
    i, lines = 0, Lines(text)
    while True:
        i = _SPACES.match(bare, i).end()
        if i >= len(bare):
            return
        end = _css_end(bare, i)
        body = text[i:end].strip()
        head = bare[i:end].split("{", 1)[0].strip()
        at = _CSS_AT.match(head)
        kind = ("at_rule" if at.group(2) not in ("media", "keyframes", "import") else at.group(2)) if at else "rule"
        if body and body != "}":
            start = lines.at(i)
            c = Chunk("css_" + kind, body, start, start + body.count("\n"), head[:50])
            if cfg.details:
                c.importance = node_importance(CSS_IMPORTANT[kind], body, body.count(";"))
                c.tags = [kind, *[n for n, p in _SELECTORS if not at and p.search(head)], *[n for n, p in _CSS_BODY if p.search(body)]]
                c.deps = _CSS_URL.findall(body) + _CSS_IMPORT.findall(body)
                c.meta = {"properties": ",".join(dict.fromkeys(_PROPERTY.findall(body)))}
                if at:
                    c.meta["at_rule"] = at.group(2)
                else:
                    c.meta["selectors"] = ",".join(x.strip() for x in head.split(","))
            yield c
        i = max(end, i + 1)


# simple maps: (language) -> heads, for brace languages without a chunker of their own
GO_HEADS = [(r"import\b", "import", 0.6), (r"func\s+(\([^)]*\)\s*)?(?P<name>\w+)", "function", 0.9), (r"type\s+(?P<name>\w+)", "class", 0.8), (r"(var|const)\b\s*(?P<name>\w*)", "variable", 0.5)]
JAVA_HEADS = [(r"import\b", "import", 0.6), (r"((public|private|protected|abstract|final|static)\s+)*(class|interface|enum|record)\s+(?P<name>\w+)", "class", 0.9)]
C_HEADS = [(r"#include\b[^\n]*", "import", 0.6), (r"(typedef\s+)?(struct|class|enum|union|namespace)\s+(?P<name>\w+)", "class", 0.8), (r"[\w:*&<>,\s]+?\b(?P<name>[\w:~]+)\s*\([^;{]*\)\s*(const\s*)?\{", "function", 0.9)]


def simple(heads: list[tuple[str, str, float]]):
    patterns = _compiled(heads)
    return lambda text, cfg: _scan(text, patterns, "\"'", lambda body: [], cfg.details)


# --- maps of lines: YAML and TOML --------------------------------------------------------


def _line_map(head: re.Pattern, kind: str, tag: str):
    """A chunker whose chunks begin at each line that the head matches and go on to the next."""

    def run(text: str, cfg: Config) -> Iterator[Chunk]:
        lines = text.split("\n")
        begins = [(k, m) for k, x in enumerate(lines) if (m := head.match(x))]
        for n, (k, m) in enumerate(begins):
            end = begins[n + 1][0] if n + 1 < len(begins) else len(lines)
            body = "\n".join(lines[k:end]).rstrip()
            c = Chunk(kind, body, k + 1, k + 1 + body.count("\n"), m.group("name").strip(), node_importance(0.7, body, body.count("\n")), [tag, kind])
            size_tags(c)
            yield c

    return run


yaml = _line_map(re.compile(r"(?P<name>[^\s#:-][^:]*):(\s|$)"), "yaml_pair", "yaml")
toml = _line_map(re.compile(r"\[{1,2}(?P<name>[^\[\]]+)\]{1,2}"), "toml_table", "toml")

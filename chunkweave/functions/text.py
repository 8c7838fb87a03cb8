"""Scalar functions over chunk text: hashes, counts, ids, previews, complexity, readability.

All are Column -> Column, so they stay in the JVM.  White-space is the ASCII
class throughout (space, \\t, \\n, \\r, \\f, \\v).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[ \t\n\r\f\x0b]"
NON_WS = r"[^ \t\n\r\f\x0b]+"


def occurrences(text: Column, part: str) -> Column:
    """How often a literal occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NON_WS))


def line_count(text: Column) -> Column:
    return occurrences(text, "\n") + 1


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(NON_WS)


def content_hash(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def content_fingerprint(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def json_string(text: Column) -> Column:
    """A JSON string literal (quotes and backslashes escaped)."""
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def dependency_fingerprint(deps: Column) -> Column:
    """Of the sorted JSON list of dependencies."""
    return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(deps), json_string), ", "), F.lit("]")), 256)


def combined_fingerprint(content: Column, deps: Column, chunk_type: Column) -> Column:
    return F.sha2(F.concat_ws(":", content_fingerprint(content), dependency_fingerprint(deps), chunk_type), 256)


def node_hash(content: Column, summary: Column) -> Column:
    return F.md5(F.concat_ws("\n", content, summary))


def hierarchy_hash(children: Column, content: Column, summary_hashes: Column) -> Column:
    """Merkle hash of a hierarchy node: children and summary hashes in sorted order."""
    return F.sha2(F.concat_ws("|", F.array_join(F.array_sort(children), ","), content_fingerprint(content), F.array_join(F.array_sort(summary_hashes), ",")), 256)


def deep_lines(text: Column, deeper_than: int = 8) -> Column:
    """Lines indented by more than so many characters (of spaces and tabs)."""
    lead = lambda l: F.length(l) - F.length(F.regexp_replace(l, f"^{WS}+", ""))
    return F.size(F.filter(F.split(text, "\n"), lambda l: lead(l) > deeper_than))


def complexity_score(text: Column, lines: Column) -> Column:
    size = F.when(lines > 50, 2).when(lines > 20, 1).otherwise(0)
    return size + occurrences(text, "{") + occurrences(text, "(") + deep_lines(text)


def complexity_level(score: Column) -> Column:
    return F.when(score <= 2, "simple").when(score <= 5, "moderate").when(score <= 10, "complex").otherwise("very_complex")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    name = file_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def extension(path: Column) -> Column:
    """Lower-cased suffix with its dot, or empty."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def clean_identifier(identifier: Column) -> Column:
    kept = F.regexp_replace(F.coalesce(identifier, F.lit("")), r"[^\p{L}\p{N}_-]", "")
    return F.when(kept == "", "chunk").otherwise(kept)


def chunk_id(path: Column, chunk_type: Column, identifier: Column, start_line: Column) -> Column:
    return F.concat_ws(":", file_stem(path), chunk_type, clean_identifier(identifier), start_line.cast("string"))


def level_id(level: int, identifier: Column, path: Column | None = None) -> Column:
    parts = [F.lit(f"L{level}")] + ([file_stem(path)] if path is not None else []) + [identifier]
    return F.concat_ws(":", *parts)


def edge_id(source: Column, target: Column, edge_type: Column) -> Column:
    return F.concat(source, F.lit("->"), target, F.lit(":"), edge_type)


def module_path(path: Column) -> Column:
    """Parts after `src` (else after `lib`), the last by its stem, joined by dots."""
    parts = F.split(path, "/")
    at = F.when(F.array_position(parts, "src") > 0, F.array_position(parts, "src")).otherwise(F.array_position(parts, "lib")).cast("int")
    rest = F.slice(parts, at + 1, F.greatest(F.size(parts) - at, F.lit(0)))
    head = F.slice(rest, F.lit(1), F.greatest(F.size(rest) - 1, F.lit(0)))
    return F.when(F.size(rest) == 0, "").otherwise(F.array_join(F.concat(head, F.array(file_stem(path))), "."))


def _last_index(text: Column, part: str) -> Column:
    """0-based place of the last occurrence of one character, or -1."""
    return F.when(F.instr(text, part) == 0, -1).otherwise(F.length(text) - F.instr(F.reverse(text), part))


def preview(text: Column) -> Column:
    head = F.substring(text, 1, 197)
    newline = _last_index(head, "\n")
    sentence = F.greatest(*[_last_index(head, c) for c in ".!?"])
    cut = F.when(newline > 150, F.substring(head, F.lit(1), newline)).when(sentence > 150, F.substring(head, F.lit(1), sentence + 1)).otherwise(head)
    return F.when(F.length(text) <= 200, text).otherwise(F.concat(cut, F.lit("...")))


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


# --- documents ---------------------------------------------------------------------


def sentence_count(text: Column) -> Column:
    return F.greatest(reduce(lambda a, b: a + b, [occurrences(text, c) for c in ".!?"]), F.lit(1))


def average_sentence(text: Column, words: Column | None = None, sentences: Column | None = None) -> Column:
    """Words a sentence; counts that are there already are taken."""
    return (word_count(text) if words is None else words) / (sentence_count(text) if sentences is None else sentences)


def readability(text: Column, words: Column | None = None, sentences: Column | None = None) -> Column:
    a = average_sentence(text, words, sentences)
    return F.when((word_count(text) if words is None else words) == 0, 0.0).when(a <= 15, 0.9).when(a <= 25, 0.7).when(a <= 35, 0.5).otherwise(0.3)


def section_type(text: Column) -> Column:
    clean = strip(text)
    lines = F.filter(F.split(text, "\n"), lambda l: l.rlike(NON_WS))
    indented = (F.size(lines) > 0) & F.forall(lines, lambda l: l.startswith("    "))
    is_list = F.exists(F.transform(F.split(clean, "\n"), strip), lambda l: l.rlike(r"^([-*+]|\d+\.)"))
    return (
        F.when(clean.startswith("#"), "heading")
        .when(clean.contains("```") | indented, "code_block")
        .when(is_list, "list")
        .when(occurrences(clean, "|") >= 3, "table")
        .otherwise("paragraph")
    )


def heading_level(text: Column) -> Column:
    clean = strip(text)
    marks = F.regexp_extract(clean, r"^(#{1,6})[ \t\n]+", 1)
    return F.when(~clean.startswith("#"), 0).when(marks == "", 1).otherwise(F.length(marks))


def structure_consistency(text: Column) -> Column:
    kind, clean = section_type(text), strip(text)
    n = F.length(clean)
    heading = F.when((n >= 3) & (n <= 80), 1.0).otherwise(0.6)
    low = F.lower(text)
    hints = low.rlike("def |function|class |import|return")
    code = F.when(text.contains("```") | hints | text.rlike(r"(?m)^    "), 0.9).otherwise(0.5)
    words, ends = word_count(text) > 0, text.rlike(r"[.!?]")
    other = F.when(words & ends, 0.7).when(words, 0.5).otherwise(0.1)
    return F.when(kind == "heading", heading).when(kind == "code_block", code).otherwise(other)


def completeness(text: Column, words: Column | None = None, sentences: Column | None = None) -> Column:
    base = F.least((sentence_count(text) if sentences is None else sentences) / 5.0, F.lit(1.0))
    a = average_sentence(text, words, sentences)
    return F.when((a >= 5) & (a <= 30), F.least(base + 0.2, F.lit(1.0))).otherwise(base)


def density(items: Column, text: Column) -> Column:
    """Keywords or entities per word, one at most."""
    return F.least(F.size(items) / F.greatest(word_count(text), F.lit(1)), F.lit(1.0))


# --- code ----------------------------------------------------------------------------


def maintainability(cyclomatic: Column, doc: Column, types: Column, lines: Column) -> Column:
    m = F.lit(1.0) - F.when(cyclomatic > 10, 0.3).when(cyclomatic > 5, 0.1).otherwise(0.0) + doc * 0.2 + types * 0.1
    return clamp(m - F.when(lines > 100, 0.2).when(lines > 50, 0.1).otherwise(0.0))


def coupling(deps: Column, dependents: Column) -> Column:
    return F.least((deps + dependents) / 20.0, F.lit(1.0))


def reusability(complete: Column, doc: Column, types: Column, coupled: Column) -> Column:
    return F.greatest(F.lit(0.0), complete * 0.3 + doc * 0.3 + types * 0.2 + (F.lit(1.0) - coupled) * 0.2)


def complexity_quality(cyclomatic: Column) -> Column:
    return F.when(cyclomatic <= 5, 1.0).when(cyclomatic <= 10, 0.7).when(cyclomatic <= 15, 0.5).otherwise(0.3)


def test_indicator(error_handling: Column, tags: Column, deps: Column) -> Column:
    tested = F.exists(tags, lambda t: F.lower(t).contains("test"))
    checks = F.exists(deps, lambda d: F.lower(d).rlike("validate|verify|check|assert"))
    return (error_handling.cast("int") + tested.cast("int") + checks.cast("int")) / 3.0


def overall_quality(metrics: dict[str, Column], importance: Column) -> Column:
    """Mean of the five weighted metrics that are present, else the importance."""
    keys = ("documentation_quality", "complexity", "readability", "maintainability", "completeness")
    given = [metrics[k] for k in keys if k in metrics]
    if not given:
        return importance
    total = reduce(lambda a, b: a + b, [F.coalesce(m, F.lit(0.0)) for m in given])
    count = reduce(lambda a, b: a + b, [m.isNotNull().cast("int") for m in given])
    return F.when(count > 0, total / count).otherwise(importance)


def base_importance(text: Column, chunk_type: Column, deps: Column, target: int = 800) -> Column:
    ratio = F.length(text) / float(target)
    size = F.when((ratio >= 0.5) & (ratio <= 1.5), 0.2).when((ratio >= 0.2) & (ratio <= 2.0), 0.1).otherwise(0.0)
    unit = F.when(chunk_type.isin("function", "class", "method"), 0.3).otherwise(0.0)
    return F.least(F.lit(0.5) + size + unit + F.least(deps * 0.05, F.lit(0.2)), F.lit(1.0))


def heuristic_importance(text: Column, chunk_type: Column, words: Column | None = None) -> Column:
    base = F.when(chunk_type.isin("function", "class"), 0.9).when(chunk_type == "method", 0.8).when(chunk_type == "import", 0.6).otherwise(0.5)
    words, lines = word_count(text) if words is None else words, line_count(text)
    bonus = F.when((words >= 50) & (words <= 200), 0.1).otherwise(0.0) + F.when((lines >= 5) & (lines <= 50), 0.1).otherwise(0.0)
    bonus = bonus + F.when(text.rlike("def |class |function |const "), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.1), base + bonus))


def embedding_text(chunk_type: Column, tags: Column, patterns: Column, content: Column, deps: Column) -> Column:
    """The text that is embedded: type, five tags, patterns, content, three dependencies."""
    part = lambda label, items: F.when(F.size(items) > 0, F.concat(F.lit(label + ": "), F.array_join(items, ", ")))
    return F.concat_ws(
        "\n", F.concat(F.lit("["), F.upper(chunk_type), F.lit("]")), part("Tags", F.slice(tags, 1, 5)), part("Patterns", patterns), content, part("Dependencies", F.slice(deps, 1, 3))
    )


def search_text(title: Column, summary: Column, content: Column, keywords: Column) -> Column:
    head = F.when(F.length(content) > 500, F.concat(F.substring(content, 1, 500), F.lit("..."))).otherwise(content)
    words = F.when(F.size(keywords) > 0, F.concat(F.lit("Keywords: "), F.array_join(keywords, ", ")))
    return F.concat_ws("\n", title, F.coalesce(summary, head), words)


# --- html and feeds --------------------------------------------------------------------


def clean_html(html: Column, cap: int = 2000) -> Column:
    text = strip(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), f"{WS}+", " "))
    return F.when(F.length(text) > cap, F.concat(F.substring(text, 1, cap), F.lit("..."))).otherwise(text)


def selector_specificity(selector: Column) -> Column:
    """100 per id, 10 per class or attribute, 1 per element, pseudo parts left out."""
    bare = F.regexp_replace(selector, r"::?[A-Za-z-]+(\([^)]*\))?", "")
    ids, classes = F.regexp_count(bare, F.lit(r"#[A-Za-z0-9_-]+")), F.regexp_count(bare, F.lit(r"\.[A-Za-z0-9_-]+|\[[^\]]*\]"))
    elements = F.regexp_count(F.regexp_replace(bare, r"[#.][A-Za-z0-9_-]+|\[[^\]]*\]", ""), F.lit(r"[A-Za-z][A-Za-z0-9]*"))
    return ids * 100 + classes * 10 + elements


def docstring_quality(doc: Column) -> Column:
    """Length, keywords and sentences of a docstring, one at most."""
    n = F.length(strip(doc))
    size = F.when(n >= 200, 0.4).when(n >= 100, 0.3).when(n >= 50, 0.2).when(n > 0, 0.1).otherwise(0.0)
    words = F.when(F.lower(doc).rlike("args:|returns:|raises:|example|param"), 0.3).otherwise(0.0)
    ends = F.regexp_count(doc, F.lit(r"[.!?]"))
    return F.least(size + words + F.when(ends >= 3, 0.3).when(ends >= 1, 0.2).otherwise(0.0), F.lit(1.0))

"""Tags and dependencies from chunk text, as array Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkweave.functions.text import NON_WS, word_count

#: The plain form, for engines without look-behind; the other finds the same texts in linear time.
EMAIL_PLAIN = r"[._%+0-9A-Za-z-]+@[.0-9A-Za-z-]+\.[A-Za-z]{2,}"
EMAIL = r"(?<![._%+0-9A-Za-z-])[._%+0-9A-Za-z-]++@[.0-9A-Za-z-]+\.[A-Za-z]{2,}"
URL = r"https?://[^ \t\n\r]+"
FILE_PATH = r"[0-9A-Za-z_.-]\.[0-9A-Za-z]"  # a name with a suffix; folders before it change nothing
TECHNICAL = "error|warning|debug|info|exception|stack trace"


def tag_list(*rules: tuple[Column, str]) -> Column:
    """The names whose condition holds."""
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(cond, F.array(F.lit(name))).otherwise(none) for cond, name in rules])


def sentence_words(text: Column, words: Column | None = None) -> Column:
    """Words per part between sentence ends (parts may be empty, as after a last full stop)."""
    return (word_count(text) if words is None else words) / (F.regexp_count(text, F.lit(r"[.!?]+")) + 1)


def text_tags(text: Column, average: Column | None = None, low: Column | None = None) -> Column:
    """Tags of plain text; `average` and `low` are its sentence_words and itself in lower case, where they are there already."""
    average = sentence_words(text) if average is None else average
    low = F.lower(text) if low is None else low
    technical = reduce(lambda a, b: a | b, [low.contains(w) for w in TECHNICAL.split("|")])  # plain words: no pattern is needed
    return tag_list(
        (F.lit(True), "text_content"),
        (text.contains("@") & text.rlike(EMAIL), "contains_email"),
        (text.contains("://") & text.rlike(URL), "contains_url"),
        (text.rlike(FILE_PATH), "contains_filepath"),
        (average > 20, "complex_text"),
        (average < 5, "simple_text"),
        (technical, "technical_content"),
    )


def markdown_tags(text: Column) -> Column:
    low = F.lower(text)
    return tag_list(
        (text.rlike(r"(?m)^#{1,6} "), "heading"),
        (text.rlike(r"\[[^\]]+\]\([^)]+\)"), "links"),
        (text.rlike(r"!\[[^\]]*\]\([^)]+\)"), "images"),
        (text.contains("```"), "code"),
        (text.rlike(r"\*{2}[^*]+\*{2}|_{2}[^_]+_{2}"), "emphasis"),
        (text.rlike(r"(?m)^[ \t]*[-*] \[[ xX]\]"), "todo"),
        (text.rlike(r"(?m)^> "), "callout"),
        (low.rlike("install|setup"), "installation"),
        (low.rlike("example|usage"), "usage"),
        (low.rlike("api|endpoint"), "api"),
    )


def javascript_tags(text: Column) -> Column:
    return tag_list(
        (text.rlike(r"\basync\b"), "async"),
        (text.contains("=>"), "arrow"),
        (text.rlike(r"function\s*\*"), "generator"),
        (text.rlike(r"\bstatic\b"), "static"),
        (text.rlike(r"\b(get|set)\s+\w+\s*\("), "accessor"),
        (text.rlike(r"\bconst\b"), "const"),
        (text.rlike(r"\bexport\b"), "export"),
        (text.rlike(r"\buse(State|Effect|Memo|Ref|Callback|Context)\b"), "hooks"),
        (text.rlike(r"<[A-Z]\w*[^>]*/?>"), "jsx"),
    )


def rust_tags(text: Column) -> Column:
    return tag_list(
        (text.rlike(r"\bpub\b"), "public"),
        (text.rlike(r"\bunsafe\b"), "unsafe"),
        (text.rlike(r"\bextern\b"), "extern"),
        (text.rlike(r"\basync\b"), "async"),
        (text.contains("#[derive("), "derive"),
        (text.rlike(r"\bimpl\b[^{]*\bfor\b"), "trait_impl"),
        (text.rlike(r"\bimpl\b"), "impl"),
        (text.rlike(r"\bmacro_rules!"), "macro"),
        (text.rlike(r"\bmut\b"), "mutable"),
        (text.rlike(r"::\*"), "glob_import"),
    )


def css_tags(text: Column) -> Column:
    return tag_list(
        (text.rlike(r"\.[A-Za-z_-][\w-]*"), "class_selector"),
        (text.rlike(r"#[A-Za-z_-][\w-]*"), "id_selector"),
        (text.rlike(r":(hover|focus|active|before|after)"), "pseudo_selector"),
        (text.rlike(r"display\s*:\s*(flex|grid)"), "layout"),
        (text.rlike(r"@media"), "media"),
        (text.rlike(r"@keyframes|animation"), "animation"),
        (text.rlike(r"@import"), "import"),
    )


def latex_tags(text: Column) -> Column:
    return tag_list(
        (text.rlike(r"\\begin\{(align|equation|gather|multline)\*?\}|\$\$"), "math"),
        (text.rlike(r"\\begin\{(figure|table)\*?\}"), "float"),
        (text.rlike(r"\\begin\{(corollary|definition|lemma|proof|theorem)\}"), "theorem"),
        (text.rlike(r"\\begin\{(lstlisting|verbatim|minted)\}"), "code"),
        (text.rlike(r"\\cite[tp]?\{"), "citation"),
        (text.rlike(r"\\(ref|eqref|autoref)\{"), "reference"),
        (text.rlike(r"\\label\{"), "label"),
        (text.rlike(r"\\includegraphics"), "graphics"),
    )


def math_complexity(text: Column) -> Column:
    """simple, moderate, complex or very_complex by counted constructs."""
    patterns = (r"\\frac", r"\\sum", r"\\int", r"\\prod", r"\\lim", r"\\sqrt", r"\\partial", r"[_^]\{", r"\\begin\{[bpv]?matrix\}", r"\\left")
    n = sum((F.regexp_count(text, F.lit(p)) for p in patterns), F.lit(0))
    return F.when(n >= 20, "very_complex").when(n >= 10, "complex").when(n >= 5, "moderate").otherwise("simple")


def links(text: Column) -> Column:
    """Targets of href attributes and Markdown links, in order, once each."""
    html = F.regexp_extract_all(text, F.lit(r'href="([^"]*)"'), F.lit(1))
    md = F.regexp_extract_all(text, F.lit(r"\[[^\]]+\]\(([^)]+)\)"), F.lit(1))
    return F.array_distinct(F.concat(html, md))


def python_imports(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:from|import)\s+([A-Za-z_.][\w.]*)"), F.lit(1)))


def calls(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1)))


def word_set(text: Column) -> Column:
    """Distinct lower-cased words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(NON_WS), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)

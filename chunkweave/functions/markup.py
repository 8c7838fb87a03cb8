"""Facts of raw markup text as Columns: XML, HTML, feeds, CSS and LaTeX, without parsing.

Patterns are linear in the text; text that is no markup gives zeros and empty lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkweave.functions.text import strip

_OPEN = r"<([A-Za-z_][^\s/>?!<]*)"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _none_if_blank(text: Column) -> Column:
    flat = strip(text)
    return F.when(flat != "", flat)


# --- xml ---------------------------------------------------------------------------


def local_name(name: Column) -> Column:
    """Without its namespace prefix, lower-cased."""
    return F.lower(F.regexp_replace(name, r"^.*:", ""))


def xml_elements(text: Column) -> Column:
    """Names of all opened elements, in order."""
    return _all(text, _OPEN)


def text_ratio(text: Column) -> Column:
    """Characters outside tags per character; 0 of an empty text."""
    flat = strip(F.regexp_replace(text, r"<[^>]*>", ""))
    return F.when(F.length(text) > 0, F.length(flat) / F.length(text)).otherwise(0.0)


def attributes(text: Column) -> Column:
    """Distinct attribute names, in order of appearance."""
    return F.array_distinct(_all(text, r"""[\s]([\w:.-]+)=["']"""))


def namespaces(text: Column) -> Column:
    """Distinct namespace uris, in order of appearance."""
    return F.array_distinct(_all(text, r"""xmlns(?::\w+)?=["']([^"']*)["']"""))


def xml_facts(text: Column) -> Column:
    """elements, unique_elements, attributes, namespaces, cdata, text_ratio of a piece of XML."""
    names = xml_elements(text)
    return F.struct(
        F.size(names).alias("elements"), F.size(F.array_distinct(F.transform(names, local_name))).alias("unique_elements"), F.size(attributes(text)).alias("attributes"),
        F.size(namespaces(text)).alias("namespaces"), F.regexp_count(text, F.lit(r"<!\[CDATA\[")).alias("cdata"), text_ratio(text).alias("text_ratio"),
    )


def xml_tags(text: Column, name: Column, category: Column) -> Column:
    """xml, the name, its category, and what the markup has."""
    f = xml_facts(text)
    flags = (("has_attributes", f["attributes"] > 0), ("has_cdata", f["cdata"] > 0), ("has_namespaces", f["namespaces"] > 0), ("text_heavy", f["text_ratio"] > 0.7), ("markup_heavy", f["text_ratio"] < 0.3))
    return F.array_compact(F.array(F.lit("xml"), name, category, *[F.when(c, F.lit(n)) for n, c in flags]))


def element_counts(pages: DataFrame, text_col: str) -> DataFrame:
    """element, n over all rows, without namespace prefixes; counted before it is shuffled."""
    return pages.select(F.explode(F.transform(xml_elements(F.col(text_col)), local_name)).alias("element")).groupBy("element").agg(F.count(F.lit(1)).alias("n"))


# --- html ---------------------------------------------------------------------------


def html_identifier(tag: Column) -> Column:
    """Of a start tag: its id, else its first class, else its name."""
    own = F.regexp_extract(tag, r"""\sid=["']([^"']+)""", 1)
    first = F.regexp_extract(tag, r"""\sclass=["']\s*([^\s"']+)""", 1)
    return F.coalesce(F.when(own != "", own), F.when(first != "", first), F.lower(F.regexp_extract(tag, _OPEN, 1)))


def html_links(text: Column) -> Column:
    """Distinct targets of href and src attributes, in order."""
    return F.array_distinct(_all(text, r"""(?:href|src)=["']([^"']+)"""))


_HTML_KINDS = (
    ("structure", "article|aside|div|footer|header|main|nav|section"), ("heading", "h[1-6]"), ("list", "dl|ol|ul"), ("table", "table"), ("form", "button|form|input|select|textarea"), ("code", "code|pre"), ("media", "audio|figure|img|video")
)


def html_tags(text: Column) -> Column:
    """html, what kinds of elements there are, class_ and id_ of the first element."""
    low = F.lower(text)
    start = F.regexp_extract(low, r"<[a-z][^>]*>", 0)
    classes = F.filter(F.split(F.regexp_extract(start, r"""\sclass=["']([^"']*)""", 1), r"\s+"), lambda c: c != "")
    own = F.regexp_extract(start, r"""\sid=["']([^"']+)""", 1)
    kinds = F.array(F.lit("html"), *[F.when(low.rlike(rf"<({p})[\s>/]"), F.lit(n)) for n, p in _HTML_KINDS])
    return F.concat(F.array_compact(kinds), F.transform(classes, lambda c: F.concat(F.lit("class_"), c)), F.array_compact(F.array(F.when(own != "", F.concat(F.lit("id_"), own)))))


def always_kept(language: Column, chunk_type: Column, content: Column) -> Column:
    """Whether a chunk stays however small it is: imports, comments, headings, semantic HTML elements."""
    semantic = F.lower(content).rlike(r"^<(article|aside|footer|h[1-6]|header|main|nav|section)[\s>]")
    return chunk_type.isin("import", "comment", "heading") | ((language == "html") & semantic)


# --- feeds ----------------------------------------------------------------------------


def feed_basics(text: Column) -> Column:
    """title, description (null where there is none) and number of items or entries of a raw feed."""
    plain = lambda x: _none_if_blank(F.regexp_replace(F.regexp_replace(x, r"<!\[CDATA\[|\]\]>", ""), r"<[^>]*>", ""))
    title = plain(F.regexp_extract(text, r"(?s)<title[^>]*>(.*?)</title>", 1))
    about = plain(F.regexp_extract(text, r"(?s)<(description|subtitle)[^>]*>(.*?)</\1>", 2))
    return F.struct(title.alias("title"), about.alias("description"), F.greatest(F.regexp_count(text, F.lit(r"<item[\s>]")), F.regexp_count(text, F.lit(r"<entry[\s>]"))).alias("items"))


def feed_topics(text: Column) -> Column:
    """Topics that the words of a feed or item tell of."""
    low = F.lower(text)
    rules = (("technology", "software|computer|internet|digital"), ("business", "market|company|economy|finance"), ("science", "research|study|scientist"), ("health", "health|medical|disease"), ("sports", "match|league|championship"), ("politics", "government|election|parliament"))
    return F.array_compact(F.array(*[F.when(low.rlike(rf"\b({p})"), F.lit(n)) for n, p in rules]))


# --- css and latex ----------------------------------------------------------------------


def css_properties(text: Column) -> Column:
    """Distinct property names, in order."""
    return F.array_distinct(_all(text, r"([a-z-]+)[ \t]*:[^;{}]+[;}]"))


def css_selectors(rule: Column) -> Column:
    """Selectors of a rule, trimmed; none of an at-rule."""
    head = F.regexp_extract(rule, r"^[^{]*", 0)
    return F.when(strip(head).startswith("@"), F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.split(head, ","), strip), lambda s: s != ""))


def css_at_rule(rule: Column) -> Column:
    """media, keyframes, import, ... or null of a plain rule."""
    kind = F.regexp_extract(rule, r"^\s*@(?:-\w+-)?(\w+)", 1)
    return F.when(kind != "", kind)


def latex_facts(text: Column) -> Column:
    """Counts of inline math, citations, references, labels, graphics, and the ten commonest commands as name:count."""
    names = _all(text, r"\\([A-Za-z]+)")
    ranked = F.transform(F.array_distinct(names), lambda n: F.struct((-F.size(F.filter(names, lambda x: x == n))).alias("rank"), n.alias("name")))
    top = F.transform(F.slice(F.array_sort(ranked), 1, 10), lambda r: F.concat_ws(":", r["name"], (-r["rank"]).cast("string")))
    count = lambda p: F.regexp_count(text, F.lit(p))
    return F.struct(
        count(r"(?<!\\)\$[^$]+\$").alias("math"), count(r"\\cite[a-z]*[\[{]").alias("citations"), count(r"\\(ref|eqref|autoref)\{").alias("references"), count(r"\\label\{").alias("labels"), count(r"\\includegraphics").alias("graphics"), top.alias("commands")
    )


def latex_section(title: Column) -> Column:
    """Which part of a paper a section title names, or `other`."""
    low = F.lower(title)
    rules = (("introduction", "introduction|motivation"), ("related_work", "related work|background|literature"), ("methods", "method|approach|model"), ("results", "result|evaluation|experiment"), ("discussion", "discussion"), ("conclusion", "conclusion|summary|future work"))
    out = F.lit("other")
    for name, p in reversed(rules):
        out = F.when(low.rlike(p), name).otherwise(out)
    return out


def rust_dependencies(text: Column) -> Column:
    """uses:, calls:, invokes: (macros), types: of Rust text, once each."""
    named = lambda label, p: F.transform(_all(text, p), lambda x: F.concat(F.lit(label + ":"), x))
    calls = F.filter(_all(text, r"\b([a-z_]\w*)\s*\("), lambda x: ~x.isin("fn", "if", "while", "match", "return", "for"))
    return F.array_distinct(F.concat(named("uses", r"\buse\s+([\w:]+)"), F.transform(calls, lambda x: F.concat(F.lit("calls:"), x)), named("invokes", r"\b(\w+)!\s*[(\[{]"), named("types", r":\s*&?(?:mut\s+)?([A-Z]\w*)")))


def text_statistics(text: Column) -> Column:
    """words, sentences, and mean lengths of both."""
    from chunkweave.functions.text import average_sentence, sentence_count, word_count

    words = word_count(text)
    letters = F.length(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", ""))
    return F.struct(words.alias("words"), sentence_count(text).alias("sentences"), average_sentence(text).alias("sentence_words"), F.when(words > 0, letters / words).otherwise(0.0).alias("word_chars"))

"""Routing, classification and bucketing predicates as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: parser -> (languages, extensions), in order of registration; later ones win an extension.
_PARSERS = {
    "python": ("python py", "py pyx pyi pyw"),
    "javascript": ("javascript js typescript ts", "js jsx ts tsx mjs cjs"),
    "html": ("html", "html htm"),
    "css": ("css", "css scss sass less"),
    "markdown": ("markdown md", "md markdown mdown mkd"),
    "json": ("json", "json jsonl ndjson"),
    "xml": ("xml", "xml xhtml svg sitemap xsd wsdl pom"),
    "feed": ("rss atom feed syndication", "rss atom feed"),
    "rust": ("rust rs", "rs"),
    "latex": ("latex tex", "tex latex ltx sty cls bib"),
    "text": ("text plaintext unknown", "txt log cfg ini conf properties env"),
}
PARSERS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {p: (tuple(names.split()), tuple("." + e for e in ends.split())) for p, (names, ends) in _PARSERS.items()}
EXTENSIONS = {e: p for p, (_, es) in PARSERS.items() for e in es}
LANGUAGES = {name: p for p, (ls, _) in PARSERS.items() for name in ls}
CONTENT_TYPES = {k: k for k in "markdown html xml json yaml css".split()} | dict.fromkeys("python javascript typescript rust go java cpp c".split(), "code")
QUERY_GROUPS = tuple(
    (name, tuple(words.split("|")))
    for name, words in (
        ("architectural", "architecture|overview|structure|design|how does|explain"),
        ("relationship", "calls|uses|depends|imports|references"),
        ("implementation", "implementation|code|function|method|show me|exact"),
        ("api", "api|interface|endpoint|method|parameter"),
        ("quality", "quality|refactor|improve|issue|problem"),
    )
)
QUERY_LEVEL = {"architectural": 2, "relationship": 1, "implementation": 0, "api": 1, "quality": 2, "general": 1}
#: relationship -> (edge type, graph)
RELATIONSHIPS = {
    "calls": ("calls", "call_graph"), "called_by": ("called_by", "call_graph"), "depends_on": ("depends_on", "import_graph"), "imports": ("imports", "import_graph"),
    "imported_by": ("imported_by", "import_graph"), "uses": ("uses", "data_flow"), "defines": ("defines", "data_flow"), "data_flow": ("data_flow", "data_flow"),
    "contains": ("contains", "hierarchy_graph"), "part_of": ("part_of", "hierarchy_graph"), "similar_to": ("similar_to", "semantic_graph"), "related_to": ("related_to", "semantic_graph"),
    "implements": ("implements", "semantic_graph"), "overrides": ("overrides", "semantic_graph"), "quality_similar": ("quality_similar", "quality_graph"),
    "refactor_candidate": ("refactor_candidate", "quality_graph"), "pattern_similar": ("pattern_similar", "quality_graph"),
}
LAYERS = (("presentation", ("/api/", "/controllers/")), ("business", ("/services/", "/business/")), ("data", ("/db/", "/data/", "/models/")), ("utility", ("/utils/", "/helpers/")))


def lookup(key: Column, table: dict[str, str], default: str | None = None) -> Column:
    """A small literal map, with a default."""
    found = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]
    return F.coalesce(found, F.lit(default)) if default is not None else found


def language_of(ext: Column) -> Column:
    """First language of the extension's parser, else `unknown`."""
    return lookup(ext, {e: PARSERS[p][0][0] for e, p in EXTENSIONS.items()}, "unknown")


def content_type_of(language: Column) -> Column:
    primary = lookup(language, {name: PARSERS[p][0][0] for name, p in LANGUAGES.items()})
    return lookup(F.coalesce(primary, language), CONTENT_TYPES, "text")


def parser_of(language: Column, ext: Column) -> Column:
    """By language (aliases are languages too), then by extension."""
    return F.coalesce(lookup(language, LANGUAGES), lookup(ext, EXTENSIONS))


def parser_priority(language: Column, ext: Column, parser: str) -> Column:
    languages, extensions = PARSERS[parser]
    return F.when(language.isin(*languages), 100).when(ext.isin(*extensions), 50).otherwise(0)


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def query_type(query: Column) -> Column:
    low = F.lower(query)
    out = F.lit("general")
    for name, words in reversed(QUERY_GROUPS):
        out = F.when(any_of(low, words), name).otherwise(out)
    return out


def query_level(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in QUERY_LEVEL.items() for x in kv])[kind]


def layer(path: Column) -> Column:
    out = F.lit("other")
    for name, parts in reversed(LAYERS):
        out = F.when(any_of(path, parts), name).otherwise(out)
    return out


def edge_type(relationship: Column) -> Column:
    return lookup(relationship, {k: v[0] for k, v in RELATIONSHIPS.items()}, "related_to")


def graph_type(relationship: Column) -> Column:
    return lookup(relationship, {k: v[1] for k, v in RELATIONSHIPS.items()}, "semantic_graph")


def size_bucket(n: Column) -> Column:
    return F.when(n < 100, "small").when(n < 500, "medium").when(n < 2000, "large").otherwise("very_large")


def relevance_bucket(score: Column) -> Column:
    return F.when(score >= 0.9, "excellent").when(score >= 0.7, "good").when(score >= 0.5, "fair").otherwise("poor")


def importance_band(pagerank: Column) -> Column:
    return F.when(pagerank > 0.1, "critical").when(pagerank > 0.05, "high").when(pagerank > 0.01, "medium").otherwise("low")


def impact_severity(affected: Column, importance: Column) -> Column:
    return F.when((affected > 20) | (importance > 0.1), "high").when((affected > 10) | (importance > 0.05), "medium").otherwise("low")


def keeps_size(n: Column, chunk_type: Column, least: int = 50, most: int = 2000, keep_atomic: bool = True) -> Column:
    """Size filter of chunks: small imports and comments stay; large ones go only without `keep_atomic`."""
    small_ok = (n >= least) | chunk_type.isin("import", "comment")
    return small_ok if keep_atomic else small_ok & (n <= most)


def xml_kind(xml: Column) -> Column:
    """Document type by its first tell-tale, in order."""
    low = F.lower(xml)
    tests = (("rss", ("<rss", "<feed")), ("svg", ("<svg",)), ("html", ("<html",)), ("soap", ("<soap:", "<wsdl")), ("pom", ("<project",)), ("sitemap", ("<urlset", "<sitemapindex")), ("config", ("<config", "<settings")))
    out = F.lit("generic")
    for name, parts in reversed(tests):
        out = F.when(any_of(low, parts), name).otherwise(out)
    return out


def feed_kind(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(low.contains("<rdf:rdf") | low.contains("http://purl.org/rss/1.0"), "rss1")
        .when(low.rlike(r"<rss[ >]"), "rss2")
        .when(low.rlike(r"<feed[ >]") | low.contains("http://www.w3.org/2005/atom"), "atom")
        .otherwise("unknown")
    )


def import_kind(module: Column, local_prefixes: tuple[str, ...] = ("src", "app", "lib")) -> Column:
    """stdlib, local or third_party, by the first part of a module's name."""
    import sys

    first = F.element_at(F.split(module, r"\."), 1)
    return F.when(first.isin(*sorted(sys.stdlib_module_names)), "stdlib").when(module.startswith(".") | first.isin(*local_prefixes), "local").otherwise("third_party")


def role_of(identifier: Column) -> Column:
    """Architectural role by keyword, in order."""
    low = F.lower(identifier)
    tests = (("controller", "controller|handler|endpoint|route"), ("service", "service|manager|provider"), ("repository", "repository|dao|store"), ("model", "model|entity|schema"), ("utility", "util|helper|tool"), ("test", "test|mock|fixture"))
    out = F.lit("component")
    for name, pattern in reversed(tests):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out

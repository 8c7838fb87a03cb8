"""Queries of the format chunkers, on pages and on sources made from table rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.operators import segment as S
from chunkweave.operators.chunkers import chunk_files
from chunkweave.operators.chunkers.base import Config
from chunkweave.operators.chunkers.markup import SEMANTIC
from chunkweave.session import spread, table

PYTHON = '''import os
import sys


class Part@@(Base):
    """A part with its price, kept in memory for later use."""

    def price(self, n: int) -> float:
        if n > 10 and self.cheap:
            return 0.9 * n
        return n


def load_part_@@(path):
    try:
        return open(path).read()
    except OSError:
        return None
'''
RUST = """use std::fmt;

#[derive(Debug, Clone)]
pub struct Part@@ {
    pub name: String,
    pub size: u32,
}

impl Part@@ {
    pub fn area(&self) -> u32 {
        self.size * self.size // not { a brace }
    }
}
"""
JAVASCRIPT = """import { api } from './api';

export const fetchPart@@ = async (id) => {
  const r = await api.get(`/parts/${id}`);
  return r.data;
};

class Shelf@@ extends Base {
  static count() { return "}" + 1; }
}
"""
CSS = """@import url("base.css");
/* a rule { in a comment } */
.part-@@ > a:hover, #main {
  display: flex;
  color: red;
}
@media (max-width: 600px) {
  .part-@@ { display: none; padding: 0; }
}
"""
MARKDOWN = """# Part @@

The part is described in this paragraph, which is long enough to be kept.

## Use

- first step of the use
- second step of the use, a little longer

| a | b |
|---|---|
| 1 | 2 |
"""
LATEX = r"""\documentclass{article}
\usepackage{amsmath}
\begin{document}
\section{Part @@}
We describe the part at some length here, as in \cite{ref@@}.
\begin{equation}
a = b + c \label{eq@@}
\end{equation}
\end{document}
"""
XML = """<catalog><part id="@"><name>Part number @@</name><note>kept in the second store of the house</note></part></catalog>
"""
LOG = """2024-01-01 10:00:00 part @@ was taken from the shelf by a user
  and it was given to the next one
2024-01-01 10:05:00 part @@ was put back on the shelf by the user
"""
HTML = """<html><body>
<h1 id="top@@">Part @@</h1>
<div class="card wide"><p>The part is described in this paragraph, which is long enough.</p>
<ul><li>one of the uses of the part</li><li>another <a href="/p/@@">use</a> of it</li></ul></div>
</body></html>
"""
JSON = """{"id": @@, "name": "part @@", "uses": ["shelf", "store"], "note": "kept in the second store of the house"}
"""
SOURCES = {"html": HTML, "json": JSON, "py": PYTHON, "rs": RUST, "js": JAVASCRIPT, "css": CSS, "md": MARKDOWN, "tex": LATEX, "xml": XML, "log": LOG}


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small source file of each format for every part."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("suffix"), F.lit(v).alias("template")) for k, v in SOURCES.items()]))
    part = table(spark, sf_dir, "part")
    p = spread(part.select("p_partkey"), part).select("p_partkey", kinds.alias("s"))  # keys are spread, not the texts made of them
    key = F.col("p_partkey").cast("string")
    return p.select(F.concat(F.lit("part_"), key, F.lit("."), F.col("s.suffix")).alias("file_path"), F.replace(F.col("s.template"), F.lit("@@"), key).alias("content"))


def q_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_files(sources(spark, sf_dir), columns=("file_path", "language", "chunk_type", "identifier", "start_line", "end_line"))


def q_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("file_path"), F.col("html").alias("content"))
    found = chunk_files(pages, columns=("chunk_id", "file_path", "chunk_type", "identifier", "start_line", "end_line", "importance", "tags"))
    return found.select("chunk_id", "file_path", "chunk_type", "identifier", "start_line", "end_line", "importance", F.size("tags").alias("n_tags"))


def q_html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many elements of each kind each page gives, of any size."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("file_path"), F.col("html").alias("content"))
    found = chunk_files(pages, Config(min_size=0), columns=("file_path", "chunk_type", "start_line", "tags")).filter("chunk_type = 'html_element'")
    return found.groupBy("file_path", F.col("tags")[1].alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.min("start_line").alias("first_line"))


def _rss(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z ]", "")
    d = table(spark, sf_dir, "documents")
    xml = F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>'), "source", F.lit("</title><item><title>Document "), F.col("doc_id").cast("string"), F.lit("</title><description>"), plain,
        F.lit("</description><category>"), "lang", F.lit("</category></item></channel></rss>"),
    )
    return d.select(F.concat(F.lit("feed_"), F.col("doc_id").cast("string"), F.lit(".rss")).alias("file_path"), xml.alias("content"))


def q_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunk_files(_rss(spark, sf_dir)).filter("chunk_type = 'feed_item'")
    return found.select("file_path", "identifier", F.md5(F.col("content").cast("binary")).alias("content_hash"))


def q_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("e_"), F.col("event_id").cast("string"), F.lit(".jsonl")).alias("file_path"), F.concat("props", F.lit("\n\n"), "props").alias("content"))
    return S.json_lines(e).select("file_path", "start_line", "content")


def q_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("talk_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit(".md")).alias("file_path"),
        F.concat(F.lit("# Turn of "), "role", F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n## End\nof the turn")).alias("content"),
    )
    return S.headings(talk).select("file_path", "start_line", "end_line", F.md5(F.col("content").cast("binary")).alias("content_hash"))


QUERIES = {"chunk_formats": q_formats, "html_chunks": q_html, "html_elements": q_html_elements, "feed_items": q_feed, "chunk_jsonl": q_jsonl, "chunk_headings": q_headings}

#: suffix, language, chunk type, identifier, first and last line: written down from the templates.
EXPECTED = (
    ("py", "python", "import", "os", 1, 1), ("py", "python", "import", "sys", 2, 2), ("py", "python", "class", "Part@@", 5, 11), ("py", "python", "function", "load_part_@@", 14, 18),
    ("rs", "rust", "import", None, 1, 1), ("rs", "rust", "struct", "Part@@", 3, 7), ("rs", "rust", "impl", "Part@@", 9, 13),
    ("js", "javascript", "import", None, 1, 1), ("js", "javascript", "function", "fetchPart@@", 3, 6), ("js", "javascript", "class", "Shelf@@", 8, 10),
    ("css", "css", "css_rule", ".part-@@ > a:hover, #main", 3, 6), ("css", "css", "css_media", "@media (max-width: 600px)", 7, 9),
    ("md", "markdown", "heading", "Part @@", 1, 12), ("md", "markdown", "paragraph", "paragraph_3", 3, 3), ("md", "markdown", "heading", "Use", 5, 12), ("md", "markdown", "list", "list_7", 7, 8),
    ("tex", "latex", "section", "Part @@", 4, 5), ("tex", "latex", "environment", "equation", 6, 8),
    ("xml", "xml", "xml_element", "catalog", 1, 1),
    ("html", "html", "html_element", "top@@", 2, 2), ("html", "html", "html_element", "card", 3, 4), ("html", "html", "html_element", "p", 3, 3), ("html", "html", "html_element", "ul", 4, 4),
    ("json", "json", "json_object", None, 1, 1),
    ("log", "text", "text_block", "log_entry_1", 1, 2), ("log", "text", "text_block", "log_entry_3", 3, 4),
)
_VALUES = ", ".join("(" + ", ".join("null" if x is None else str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in EXPECTED)
ORACLE_SQL = {
    "chunk_formats": f"""with x(suffix, language, chunk_type, name, a, b) as (values {_VALUES})
select 'part_' || p_partkey || '.' || suffix as file_path, language, chunk_type, replace(name, '@@', cast(p_partkey as varchar)) as identifier, cast(a as integer) as start_line, cast(b as integer) as end_line from part cross join x""",
    "feed_items": """with w as (select doc_id, lang, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^A-Za-z ]', '', 'g'), ' +', ' ', 'g')) as flat from documents),
d as (select doc_id, lang, case when length(flat) > 2000 then substr(flat, 1, 2000) || '...' else flat end as t from w)
select 'feed_' || doc_id || '.rss' as file_path, 'Document ' || doc_id as identifier, md5('Title: Document ' || doc_id || chr(10) || 'Description: ' || t || chr(10) || 'Category: ' || lang) as content_hash from d
where length('Title: Document ' || doc_id || chr(10) || 'Description: ' || t || chr(10) || 'Category: ' || lang) >= 50""",
    "html_elements": f"""with t as (select page_id, html, unnest([{', '.join(repr(x) for x in sorted(SEMANTIC))}]) as tag from pages where html is not null),
m as (select page_id, html, tag, regexp_extract_all(html, '<' || tag || '[ >]') as hits, regexp_extract(html, '^((?s:.*?))<' || tag || '[ >]', 1) as head from t)
select 'page_' || page_id || '.html' as file_path, tag, cast(len(hits) as bigint) as n, cast(length(head) - length(replace(head, chr(10), '')) + 1 as integer) as first_line from m where len(hits) > 0""",
    "chunk_jsonl": "select 'e_' || event_id || '.jsonl' as file_path, cast(k as integer) as start_line, props as content from events cross join (values (1), (3)) v(k)",
    "chunk_headings": """select 'talk_' || conv_id || '_' || turn || '.md' as file_path, cast(1 as integer) as start_line, cast(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 2 as integer) as end_line, md5('# Turn of ' || role || chr(10) || coalesce(text, '')) as content_hash from conversations
union all select 'talk_' || conv_id || '_' || turn || '.md', cast(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 3 as integer), cast(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 4 as integer), md5('## End' || chr(10) || 'of the turn') from conversations""",
}

"""Chunking, text analytics and tagging queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.functions import classify as C
from chunkweave.functions import tags as G
from chunkweave.functions import text as T
from chunkweave.operators import segment as S
from chunkweave.session import table

NON = "[^ \\t\\n\\r\\f\\x0b]+"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a repository: one module per source."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("src/"), F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"),
        F.col("doc_id"),
        F.col("source").alias("module"),
        F.col("lang").alias("language"),
        F.coalesce(F.col("text"), F.lit("")).alias("content"),
    )


FILES_SQL = """files as (select 'src/' || source || '/doc_' || cast(doc_id as varchar) || '.txt' as file_path, doc_id, source as module, lang as language, coalesce(text, '') as content from documents)"""
LINES = 10


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that the graph, hierarchy and search queries work on."""
    return as_chunks(files(spark, sf_dir))


def as_chunks(f: DataFrame) -> DataFrame:
    c = S.fixed_lines(f, LINES)
    return c.select(
        "file_path", "doc_id", "module", "language", "chunk_no", "start_line", "end_line", "content",
        T.chunk_id(F.col("file_path"), F.lit("text_block"), F.concat(F.lit("b"), F.col("chunk_no").cast("string")), F.col("start_line")).alias("chunk_id"),
    )


CHUNKS_SQL = (
    FILES_SQL
    + f""", chunks as (
  select file_path, doc_id, module, language, k as chunk_no, cast(k * {LINES} + 1 as integer) as start_line, cast(least((k + 1) * {LINES}, len(ls)) as integer) as end_line,
    array_to_string(ls[k * {LINES} + 1 : (k + 1) * {LINES}], chr(10)) as content,
    'doc_' || cast(doc_id as varchar) || ':text_block:b' || cast(k as varchar) || ':' || cast(k * {LINES} + 1 as varchar) as chunk_id
  from (select *, string_split(content, chr(10)) as ls, unnest(range(0, cast((len(string_split(content, chr(10))) + {LINES - 1}) // {LINES} as bigint))) as k from files where regexp_matches(content, '{NON}')))"""
)


def q_fixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_table(spark, sf_dir).select("chunk_id", "file_path", "start_line", "end_line", T.content_hash(F.col("content")).alias("content_hash"))


def q_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = files(spark, sf_dir).withColumn("content", F.regexp_replace("content", r"\.\n", ".\n\n"))
    return S.paragraphs(broken).select("file_path", "start_line", "end_line", T.content_hash(F.col("content")).alias("content_hash"))


def q_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.by_size(files(spark, sf_dir)).select("file_path", "start_line", "end_line", F.length("content").alias("n_chars"), T.content_hash(F.col("content")).alias("content_hash"))


def q_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("talk_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("file_path"),
        F.concat(F.upper("role"), F.lit(" TURN:\n"), F.coalesce("text", F.lit("")), F.lit("\n1. end of turn")).alias("content"),
    )
    return S.sections(talk).select("file_path", "start_line", "end_line", T.content_hash(F.col("content")).alias("content_hash"))


def q_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(
        F.concat(F.lit("part_"), F.col("p_partkey").cast("string"), F.lit(".ini")).alias("file_path"),
        F.concat(
            F.lit("; part\nname="), "p_name", F.lit("\nbrand="), "p_brand", F.lit("\ntype="), "p_type", F.lit("\n\n# size of the part and how it is measured\nsize="), F.col("p_size").cast("string"), F.lit("\nunit=centimetre by default\n\nshort=1")
        ).alias("content"),
    )
    return S.config_blocks(parts).select("file_path", "start_line", "end_line", "content")


def q_text_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = files(spark, sf_dir).select("file_path", "content")
    logs = table(spark, sf_dir, "events").select(
        F.concat(F.lit("log_"), F.col("event_id").cast("string")).alias("file_path"),
        F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(" "), F.col("event_type")).alias("content"),
    )
    return docs.union(logs).select("file_path", S.text_type(F.col("content")).alias("text_type"))


def q_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = F.array(F.col("language"), F.col("module"))
    c = F.col("content")
    return files(spark, sf_dir).select(
        "doc_id", T.content_hash(c).alias("content_hash"), T.content_fingerprint(c).alias("content_fingerprint"), T.dependency_fingerprint(deps).alias("dependency_fingerprint"),
        T.combined_fingerprint(c, deps, F.lit("text_block")).alias("combined_fingerprint"), T.node_hash(c, F.col("module")).alias("node_hash"),
    )


def q_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    score = T.complexity_score(c, F.col("end_line") - F.col("start_line") + 1)
    return chunk_table(spark, sf_dir).select(
        "chunk_id", F.length(c).alias("n_chars"), T.word_count(c).alias("n_words"), (F.col("end_line") - F.col("start_line") + 1).alias("n_lines"), score.cast("int").alias("complexity"), T.complexity_level(score).alias("level")
    )


def q_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", T.preview(F.col("content")).alias("preview"))


def q_readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    return files(spark, sf_dir).select("doc_id", T.sentence_count(c).alias("sentences"), F.round(T.average_sentence(c), 6).alias("avg_sentence"), T.readability(c).alias("readability"))


def q_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    return files(spark, sf_dir).select("doc_id", T.section_type(c).alias("section_type"), T.heading_level(c).alias("heading_level"), T.structure_consistency(c).alias("consistency"))


def q_doc_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    metrics = {"readability": T.readability(c), "completeness": T.completeness(c)}
    return files(spark, sf_dir).select(
        "doc_id", F.round(T.completeness(c), 6).alias("completeness"), F.round(T.overall_quality(metrics, T.heuristic_importance(c, F.lit("text_block"))), 6).alias("quality"),
        F.round(T.heuristic_importance(c, F.lit("text_block")), 6).alias("heuristic_importance"), F.round(T.base_importance(c, F.lit("text_block"), F.lit(2)), 6).alias("base_importance"),
    )


def q_code_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code metrics with their inputs taken from table columns."""
    p = table(spark, sf_dir, "part")
    cyc, doc, types, lines = F.col("p_size") % 20, (F.col("p_partkey") % 11) / 10.0, (F.col("p_partkey") % 7) / 6.0, F.col("p_size") * 3
    coupled = T.coupling(F.col("p_partkey") % 13, F.col("p_partkey") % 17)
    return p.select(
        "p_partkey", F.round(T.maintainability(cyc, doc, types, lines), 6).alias("maintainability"), F.round(coupled, 6).alias("coupling"),
        F.round(T.reusability(F.lit(0.5), doc, types, coupled), 6).alias("reusability"), T.complexity_quality(cyc).alias("complexity_quality"),
        F.round(T.test_indicator(F.col("p_size") > 25, F.array("p_name"), F.array("p_type")), 6).alias("test_indicator"),
    )


def q_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    question = F.concat(F.element_at(F.array(F.lit("explain "), F.lit("what calls "), F.lit("show me "), F.lit("the api of "), F.lit("refactor "), F.lit("about ")), (F.col("item_id") % 6 + 1).cast("int")), F.coalesce("text", F.lit("")))
    kind = C.query_type(question)
    return b.select("item_id", C.size_bucket(F.length("text")).alias("size_bucket"), C.relevance_bucket((F.col("item_id") % 10) / 10.0).alias("relevance"), kind.alias("query_type"), C.query_level(kind).alias("level"))


def q_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, parser and content type of page urls, extended by every known suffix."""
    suffixes = ["", ".py", ".JS", ".tsx", ".html", ".css", ".md", ".jsonl", ".xml", ".rss", ".rs", ".tex", ".log", ".bin"]
    path = F.concat(F.lit("p"), F.col("page_id").cast("string"), F.element_at(F.array(*map(F.lit, suffixes)), (F.col("page_id") % len(suffixes) + 1).cast("int")))
    ext = T.extension(F.col("path"))
    language = C.language_of(ext)
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).select("page_id", language.alias("language"), C.content_type_of(language).alias("content_type"), C.parser_of(language, ext).alias("parser"), C.parser_priority(language, ext, "python").alias("python_priority"))


def q_min_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 5 == 0, "comment").otherwise("text_block")
    f = files(spark, sf_dir).withColumn("chunk_type", kind)
    return f.filter(C.keeps_size(F.length("content"), F.col("chunk_type"))).select("doc_id", "chunk_type", C.keeps_size(F.length("content"), F.col("chunk_type"), keep_atomic=False).alias("within_max"))


def q_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", F.explode(G.text_tags(F.col("content"))).alias("tag"))


def q_tag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("language", F.explode(G.text_tags(F.col("content"))).alias("tag")).groupBy("language", "tag").agg(F.count(F.lit(1)).alias("n"))


def q_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(G.links(F.coalesce("html", F.lit("")))).alias("link"))


def q_html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.clean_html(F.coalesce("html", F.lit(""))).alias("clean"))


def q_html_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit("<([a-z][a-z0-9]*)"), F.lit(1))
    return table(spark, sf_dir, "pages").select(F.explode(found).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def q_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.json_object_keys("props")
    return table(spark, sf_dir, "events").select(F.explode(keys).alias("property"), "props").groupBy("property").agg(F.count(F.lit(1)).alias("n"))


def q_module_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("file_path")
    return files(spark, sf_dir).select("doc_id", T.module_path(p).alias("module_path"), T.file_stem(p).alias("stem"), T.level_id(1, T.file_stem(p), p).alias("node_id"), C.layer(F.concat(F.lit("/"), F.element_at(F.array(F.lit("api/"), F.lit("services/"), F.lit("db/"), F.lit("utils/"), F.lit("misc/")), (F.col("doc_id") % 5 + 1).cast("int")), p)).alias("layer"))


def q_embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    text = T.embedding_text(F.lit("text_block"), G.text_tags(c), F.array().cast("array<string>"), c, F.array("language", "module"))
    return files(spark, sf_dir).select("doc_id", F.md5(text.cast("binary")).alias("text_hash"))


QUERIES = {
    "chunk_fixed_lines": q_fixed_lines, "chunk_paragraphs": q_paragraphs, "chunk_by_size": q_by_size, "chunk_sections": q_sections, "chunk_config": q_config, "text_type": q_text_type,
    "chunk_hashes": q_hashes, "chunk_stats": q_stats, "chunk_preview": q_preview, "doc_readability": q_readability, "doc_structure": q_structure, "doc_quality": q_doc_quality,
    "code_quality_scores": q_code_quality, "buckets": q_buckets, "lang_routing": q_routing, "filter_min_size": q_min_size, "tags_text": q_tags, "tag_histogram": q_tag_histogram,
    "deps_links": q_links, "html_clean": q_html_clean, "html_tag_counts": q_html_tags, "json_props": q_json_props, "module_paths": q_module_paths, "embedding_text": q_embedding_text,
}

_WORDS = f"len(regexp_extract_all({{c}}, '{NON}'))"


def _words(c: str = "content") -> str:
    return f"len(regexp_extract_all({c}, '{NON}'))"


def _count(part: str, c: str = "content") -> str:
    return f"(length({c}) - length(replace({c}, '{part}', '')))"


_SENT = f"greatest({_count('.')} + {_count('!')} + {_count('?')}, 1)"
_AVG = f"({_words()} / cast({_SENT} as double))"
_READ = f"case when {_words()} = 0 then 0.0 when {_AVG} <= 15 then 0.9 when {_AVG} <= 25 then 0.7 when {_AVG} <= 35 then 0.5 else 0.3 end"
_COMPLETE = f"case when {_AVG} between 5 and 30 then least(least({_SENT} / 5.0, 1.0) + 0.2, 1.0) else least({_SENT} / 5.0, 1.0) end"
_LINES_OF = f"(length(content) - length(replace(content, chr(10), '')) + 1)"
_HEUR = f"least(1.0, 0.5 + case when {_words()} between 50 and 200 then 0.1 else 0.0 end + case when {_LINES_OF} between 5 and 50 then 0.1 else 0.0 end + case when regexp_matches(content, 'def |class |function |const ') then 0.1 else 0.0 end)"
_SPLIT_AVG = f"({_words()} / cast(len(regexp_extract_all(content, '[.!?]+')) + 1 as double))"
_TAGS = f"""[case when true then 'text_content' end, case when regexp_matches(content, '{G.EMAIL_PLAIN}') then 'contains_email' end, case when regexp_matches(content, 'https?://[^ \\t\\n\\r]+') then 'contains_url' end,
  case when regexp_matches(content, '{G.FILE_PATH}') then 'contains_filepath' end, case when {_SPLIT_AVG} > 20 then 'complex_text' end, case when {_SPLIT_AVG} < 5 then 'simple_text' end,
  case when regexp_matches(lower(content), '{G.TECHNICAL}') then 'technical_content' end]"""
_CLEAN = "regexp_replace(content, '^[ \\t\\n\\r\\f\\x0b]+|[ \\t\\n\\r\\f\\x0b]+$', '', 'g')"


def _case_map(key: str, m: dict[str, str], default: str) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then '{v}'" for k, v in m.items()) + f" else {default} end"


_EXT_LANG = {e: C.PARSERS[p][0][0] for e, p in C.EXTENSIONS.items()}
_KIND = "case " + " ".join("when " + " or ".join(f"contains(q, '{w}')" for w in ws) + f" then '{n}'" for n, ws in C.QUERY_GROUPS) + " else 'general' end"

ORACLE_SQL = {
    "chunk_fixed_lines": f"with {CHUNKS_SQL} select chunk_id, file_path, start_line, end_line, md5(content) as content_hash from chunks",
    "chunk_paragraphs": f"""with recursive {FILES_SQL},
p as (select file_path, list_filter(list_transform(string_split_regex(replace(content, '.' || chr(10), '.' || chr(10) || chr(10)), '\\n[ \\t\\n\\r\\f\\x0b]*\\n'), lambda x: regexp_replace(x, '^[ \\t\\n\\r\\f\\x0b]+|[ \\t\\n\\r\\f\\x0b]+$', '', 'g')), lambda x: x <> '') as ps from files),
e as (select file_path, unnest(ps) as part, generate_subscripts(ps, 1) as k from p),
n as (select *, length(part) - length(replace(part, chr(10), '')) + 1 as h from e),
r as (select *, coalesce(sum(h + 1) over (partition by file_path order by k rows between unbounded preceding and 1 preceding), 0) + 1 as a from n)
select file_path, cast(a as integer) as start_line, cast(a + h - 1 as integer) as end_line, md5(part) as content_hash from r where length(part) >= 50""",
    "chunk_by_size": f"""with recursive {FILES_SQL},
l as (select file_path, string_split(content, chr(10)) as ls from files where regexp_matches(content, '{NON}')),
w as (select file_path, i, length(ls[i]) as w, ls, len(ls) as total from (select file_path, ls, unnest(range(1, len(ls) + 1)) as i from l)),
step as (
  select file_path, cast(1 as bigint) as i, cast(1 as bigint) as a, w as size, w >= 800 as full_now, total from w where i = 1
  union all
  select s.file_path, s.i + 1, case when s.full_now then s.i + 1 else s.a end, case when s.full_now then w.w else s.size + 1 + w.w end, (case when s.full_now then w.w else s.size + 1 + w.w end) >= 800, s.total
  from step s join w on w.file_path = s.file_path and w.i = s.i + 1)
select file_path, cast(a as integer) as start_line, cast(i as integer) as end_line, cast(length(t) as integer) as n_chars, md5(t) as content_hash
from (select s.*, array_to_string(l.ls[s.a : s.i], chr(10)) as t from step s join l using (file_path) where full_now or (s.i = s.total and s.size >= 50))""",
    "chunk_sections": f"""with t as (select 'talk_' || conv_id || '_' || turn as file_path, string_split(upper(role) || ' TURN:' || chr(10) || coalesce(text, '') || chr(10) || '1. end of turn', chr(10)) as ls from conversations),
e as (select file_path, unnest(ls) as l, generate_subscripts(ls, 1) as n from t),
g as (select *, sum(case when n = 1 or regexp_matches(l, '{S.SECTION}') or regexp_matches(l, '{S.NUMBERED}') then 1 else 0 end) over (partition by file_path order by n) as s from e)
select file_path, cast(min(n) as integer) as start_line, cast(max(n) as integer) as end_line, md5(string_agg(l, chr(10) order by n)) as content_hash from g group by file_path, s""",
    "chunk_config": """with t as (select 'part_' || p_partkey || '.ini' as file_path, '; part' || chr(10) || 'name=' || p_name || chr(10) || 'brand=' || p_brand || chr(10) || 'type=' || p_type as first,
  '# size of the part and how it is measured' || chr(10) || 'size=' || p_size || chr(10) || 'unit=centimetre by default' as second from part),
u as (select file_path, 1 as start_line, 4 as end_line, first as content from t union all select file_path, case when true then 6 end, 8, second from t)
select file_path, cast(case when end_line = 8 then 6 else 1 end as integer) as start_line, cast(end_line as integer) as end_line, content from u where length(content) >= 50""",
    "text_type": f"""with {FILES_SQL}, a as (select file_path, content from files union all select 'log_' || event_id, strftime(ts, '%Y-%m-%d') || ' ' || event_type from events),
l as (select file_path, string_split(content, chr(10)) as ls from a),
s as (select file_path, len(list_filter(ls, lambda x: regexp_matches(x, '{S.LOG_LINE}'))) / len(ls) as log, len(list_filter(ls, lambda x: regexp_matches(x, '{S.KEY_VALUE}'))) / len(ls) as cfg,
  (len(list_filter(ls, lambda x: regexp_matches(x, '{S.SECTION}'))) + len(list_filter(ls, lambda x: regexp_matches(x, '{S.NUMBERED}')))) / len(ls) as head from l)
select file_path, case when log > 0.3 then 'log' when cfg > 0.4 then 'config' when head > 0.1 then 'structured' else 'plain' end as text_type from s""",
    "chunk_hashes": f"""with {FILES_SQL}, f as (select *, sha256('["' || least(language, module) || '", "' || greatest(language, module) || '"]') as dep from files)
select doc_id, md5(content) as content_hash, sha256(content) as content_fingerprint, dep as dependency_fingerprint, sha256(sha256(content) || ':' || dep || ':text_block') as combined_fingerprint, md5(content || chr(10) || module) as node_hash from f""",
    "chunk_stats": f"""with {CHUNKS_SQL}, s as (select chunk_id, content, end_line - start_line + 1 as n, case when end_line - start_line + 1 > 50 then 2 when end_line - start_line + 1 > 20 then 1 else 0 end + {_count('{')} + {_count('(')}
  + len(list_filter(string_split(content, chr(10)), lambda x: length(x) - length(regexp_replace(x, '^[ \\t\\n\\r\\f\\x0b]+', '')) > 8)) as k from chunks)
select chunk_id, length(content) as n_chars, {_words()} as n_words, n as n_lines, cast(k as integer) as complexity, case when k <= 2 then 'simple' when k <= 5 then 'moderate' when k <= 10 then 'complex' else 'very_complex' end as level from s""",
    "chunk_preview": f"""with {FILES_SQL}, h as (select doc_id, content, substr(content, 1, 197) as p from files),
x as (select *, case when contains(p, chr(10)) then length(p) - strpos(reverse(p), chr(10)) else -1 end as nl, greatest({', '.join(f"case when contains(p, '{c}') then length(p) - strpos(reverse(p), '{c}') else -1 end" for c in '.!?')}) as se from h)
select doc_id, case when length(content) <= 200 then content else case when nl > 150 then substr(p, 1, nl) when se > 150 then substr(p, 1, se + 1) else p end || '...' end as preview from x""",
    "doc_readability": f"with {FILES_SQL} select doc_id, cast({_SENT} as integer) as sentences, round({_AVG}, 6) as avg_sentence, cast({_READ} as double) as readability from files",
    "doc_structure": f"""with {FILES_SQL}, c as (select doc_id, content, {_CLEAN} as clean, list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '{NON}')) as ls from files),
k as (select *, case when starts_with(clean, '#') then 'heading' when contains(clean, '```') or (len(ls) > 0 and len(list_filter(ls, lambda x: not starts_with(x, '    '))) = 0) then 'code_block'
  when len(list_filter(string_split(clean, chr(10)), lambda x: regexp_matches(regexp_replace(x, '^[ \\t\\n\\r\\f\\x0b]+', ''), '^([-*+]|\\d+\\.)'))) > 0 then 'list' when {_count('|', 'clean')} >= 3 then 'table' else 'paragraph' end as kind from c)
select doc_id, kind as section_type, cast(case when not starts_with(clean, '#') then 0 when regexp_extract(clean, '^(#{{1,6}})[ \\t\\n]+', 1) = '' then 1 else length(regexp_extract(clean, '^(#{{1,6}})[ \\t\\n]+', 1)) end as integer) as heading_level,
  cast(case when kind = 'heading' then case when length(clean) between 3 and 80 then 1.0 else 0.6 end
    when kind = 'code_block' then case when contains(content, '```') or regexp_matches(lower(content), 'def |function|class |import|return') or regexp_matches(content, '(?m)^    ') then 0.9 else 0.5 end
    when {_words()} > 0 and regexp_matches(content, '[.!?]') then 0.7 when {_words()} > 0 then 0.5 else 0.1 end as double) as consistency from k""",
    "doc_quality": f"""with {FILES_SQL}, m as (select doc_id, content, cast({_COMPLETE} as double) as comp, cast({_READ} as double) as rd, cast({_HEUR} as double) as imp, length(content) / 800.0 as ratio from files)
select doc_id, round(comp, 6) as completeness, round((comp + rd) / 2, 6) as quality, round(imp, 6) as heuristic_importance,
  round(cast(least(0.5 + case when ratio between 0.5 and 1.5 then 0.2 when ratio between 0.2 and 2.0 then 0.1 else 0.0 end + 0.1, 1.0) as double), 6) as base_importance from m""",
    "code_quality_scores": """with p as (select p_partkey, p_size, p_name, p_type, p_size % 20 as cyc, (p_partkey % 11) / 10.0::double as doc, (p_partkey % 7) / 6.0::double as types, p_size * 3 as lines, least((p_partkey % 13 + p_partkey % 17) / 20.0::double, 1.0) as cpl from part)
select p_partkey, round(greatest(0.0, least(1.0, 1.0 - case when cyc > 10 then 0.3 when cyc > 5 then 0.1 else 0.0 end + doc * 0.2 + types * 0.1 - case when lines > 100 then 0.2 when lines > 50 then 0.1 else 0.0 end)), 6) as maintainability,
  round(cpl, 6) as coupling, round(greatest(0.0, 0.5 * 0.3 + doc * 0.3 + types * 0.2 + (1.0 - cpl) * 0.2), 6) as reusability, cast(case when cyc <= 5 then 1.0 when cyc <= 10 then 0.7 when cyc <= 15 then 0.5 else 0.3 end as double) as complexity_quality,
  round((cast(p_size > 25 as int) + cast(contains(lower(p_name), 'test') as int) + cast(regexp_matches(lower(p_type), 'validate|verify|check|assert') as int)) / 3.0::double, 6) as test_indicator from p""",
    "buckets": f"""with q as (select item_id, text, lower(['explain ', 'what calls ', 'show me ', 'the api of ', 'refactor ', 'about '][item_id % 6 + 1] || coalesce(text, '')) as q from benchmark), k as (select *, {_KIND} as kind from q)
select item_id, case when length(text) < 100 then 'small' when length(text) < 500 then 'medium' when length(text) < 2000 then 'large' else 'very_large' end as size_bucket,
  case when (item_id % 10) / 10.0 >= 0.9 then 'excellent' when (item_id % 10) / 10.0 >= 0.7 then 'good' when (item_id % 10) / 10.0 >= 0.5 then 'fair' else 'poor' end as relevance, kind as query_type,
  cast(case kind when 'architectural' then 2 when 'quality' then 2 when 'implementation' then 0 else 1 end as integer) as level from k""",
    "lang_routing": f"""with p as (select page_id, ['', '.py', '.js', '.tsx', '.html', '.css', '.md', '.jsonl', '.xml', '.rss', '.rs', '.tex', '.log', '.bin'][page_id % 14 + 1] as ext from pages),
l as (select *, {_case_map('ext', _EXT_LANG, "'unknown'")} as language from p)
select page_id, language, {_case_map('language', C.CONTENT_TYPES, "'text'")} as content_type, {_case_map('language', C.LANGUAGES, "null")} as parser, cast(case when language in ('python', 'py') then 100 when ext in ('.py', '.pyx', '.pyi', '.pyw') then 50 else 0 end as integer) as python_priority from l""",
    "filter_min_size": f"""with {FILES_SQL} select doc_id, case when doc_id % 5 = 0 then 'comment' else 'text_block' end as chunk_type, length(content) <= 2000 as within_max from files where length(content) >= 50 or doc_id % 5 = 0""",
    "tags_text": f"with {FILES_SQL}, t as (select doc_id, unnest({_TAGS}) as tag from files) select * from t where tag is not null",
    "tag_histogram": f"with {FILES_SQL}, t as (select language, unnest({_TAGS}) as tag from files) select language, tag, count(*) as n from t where tag is not null group by all",
    "deps_links": """with l as (select page_id, unnest(list_distinct(list_concat(regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1), regexp_extract_all(coalesce(html, ''), '\\[[^\\]]+\\]\\(([^)]+)\\)', 1)))) as link from pages) select * from l""",
    "html_clean": """with c as (select page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'), '^ +| +$', '', 'g') as t from pages) select page_id, case when length(t) > 2000 then substr(t, 1, 2000) || '...' else t end as clean from c""",
    "html_tag_counts": "with t as (select unnest(regexp_extract_all(coalesce(html, ''), '<([a-z][a-z0-9]*)', 1)) as tag from pages) select tag, count(*) as n from t group by tag",
    "json_props": "with k as (select unnest(json_keys(props)) as property from events) select property, count(*) as n from k group by property",
    "module_paths": f"""with {FILES_SQL} select doc_id, module || '.doc_' || doc_id as module_path, 'doc_' || doc_id as stem, 'L1:doc_' || doc_id || ':doc_' || doc_id as node_id, ['presentation', 'business', 'data', 'utility', 'other'][doc_id % 5 + 1] as layer from files""",
    "embedding_text": f"""with {FILES_SQL}, t as (select doc_id, content, language, module, list_filter({_TAGS}, lambda x: x is not null)[1:5] as tags from files)
select doc_id, md5('[TEXT_BLOCK]' || chr(10) || 'Tags: ' || array_to_string(tags, ', ') || chr(10) || content || chr(10) || 'Dependencies: ' || language || ', ' || module) as text_hash from t""",
}

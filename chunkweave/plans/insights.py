"""Queries of the graph builder, of properties of chunks and nodes, and of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.functions import classify as C
from chunkweave.functions import markup as M
from chunkweave.functions import properties as P
from chunkweave.functions import text as T
from chunkweave.operators import builder as B
from chunkweave.operators import graph as J
from chunkweave.operators import hierarchy as H
from chunkweave.operators import search as L
from chunkweave.operators import validate as V
from chunkweave.operators.chunkers import chunk_files
from chunkweave.operators.chunkers.engine import chunk_errors, processing_stats
from chunkweave.plans import formats
from chunkweave.plans.chunks import FILES_SQL, _COMPLETE, _READ, _words, chunk_table, files
from chunkweave.plans.graphs import MOVES_SQL, _NEAR_SQL, moves
from chunkweave.plans.tree import _TREE
from chunkweave.session import Scratch, table

KINDS = ("calls", "imports", "uses", "data_flow", "similar_to", "depends_on", "quality_similar")


def parts(spark: SparkSession, sf_dir: str, edited: bool = False) -> DataFrame:
    """Parts as chunks: twenty a file, each over as many lines as its size."""
    p = table(spark, sf_dir, "part")
    name = F.when(F.lit(edited) & (F.col("p_partkey") % 10 == 3), F.concat("p_name", F.lit(" x"))).otherwise(F.col("p_name"))
    start = (F.col("p_partkey") % 20 * 3 + 1).cast("int")
    return p.select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.md5(name.cast("binary")).alias("fingerprint"),
        F.concat(F.lit("src/m"), (F.floor(F.col("p_partkey") / 20) % 7).cast("string"), F.lit("/f"), F.floor(F.col("p_partkey") / 20).cast("string")).alias("file_path"),
        start.alias("start_line"), (start + F.col("p_size")).cast("int").alias("end_line"), (F.col("p_size") / 50.0).alias("quality"), "p_partkey",
    )


def relations(spark: SparkSession, sf_dir: str, step: int = 7) -> DataFrame:
    """One relationship of each part, to the part `step` times its key plus one further on."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    top = p.agg(F.max("p_partkey").alias("top"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("p_partkey") % len(KINDS) + 1).cast("int"))
    key = lambda c: F.concat(F.lit("p"), c.cast("string"))
    joined = p.join(F.broadcast(top))  # one row is broadcast
    return joined.select(key(F.col("p_partkey")).alias("src"), key(F.col("p_partkey") * step % F.col("top") + 1).alias("dst"), kind.alias("relationship"), F.lit(1.0).alias("strength"))


def graph(spark: SparkSession, sf_dir: str) -> B.Graph:
    return B.build(parts(spark, sf_dir), relations(spark, sf_dir))


def q_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.summary(graph(spark, sf_dir))


def q_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the parts changed, and with them where their relationships lead."""
    g = B.update(graph(spark, sf_dir), parts(spark, sf_dir, edited=True), relations(spark, sf_dir, 11))
    nodes = g.nodes.filter("version > 1").select(F.col("id").alias("src"), F.lit("").alias("dst"), F.lit("changed node").alias("edge_type"))
    return nodes.union(g.edges.filter("graph_type <> 'hierarchy_graph'").select("src", "dst", "edge_type"))


def q_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    left = B.remove(g, parts(spark, sf_dir).filter("p_partkey % 10 = 4").select("id"))
    return B.summary(left).union(left.nodes.agg(F.lit("nodes").alias("edge_type"), F.lit("").alias("graph_type"), F.count(F.lit(1)).alias("n")))


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("id", (F.col("p_partkey") % 97 / 10_000.0).alias("rank"))


def q_change_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a change of every fiftieth part reaches in two steps, how severe that is and what to do."""
    starts = parts(spark, sf_dir).filter("p_partkey % 50 = 0").select("id")
    found = B.change_impact(spark, graph(spark, sf_dir), starts, _ranks(spark, sf_dir), 2)
    return found.select("start", "direct", "transitive", F.round("quality_weight", 6).alias("quality_weight"), F.round("rank_weight", 6).alias("rank_weight"), "severity", F.array_join("advice", "; ").alias("advice"))


def q_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty worst hotspots."""
    return B.hotspots(parts(spark, sf_dir), _ranks(spark, sf_dir)).select("id", F.round("score", 9).alias("score"))


def q_central(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest ranked parts of each graph."""
    kind = F.element_at(F.array(*[F.lit(C.RELATIONSHIPS[k][1]) for k in KINDS]), (F.col("p_partkey") % len(KINDS) + 1).cast("int"))
    r = parts(spark, sf_dir).select("id", kind.alias("graph_type"), (F.col("p_partkey") % 97 / 10_000.0).alias("rank"))
    return B.central(r).select("graph_type", "id", "place")


def q_quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = B.quality_metrics(parts(spark, sf_dir))
    return m.select("n_nodes", *[F.round(c, 6).alias(c) for c in ("average_quality", "quality_variance", "high_quality_percentage")])


def q_duplicate_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types as patterns, the retail price's last digits as confidence."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("pattern"), (F.col("p_partkey") * 37 % 101 / 100.0).alias("confidence"))
    return B.duplicate_patterns(p)


def q_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.cycles(moves(spark, sf_dir), 5)


def q_diameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.diameter(moves(spark, sf_dir))


def q_louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the links between vectors; the gate on their number is tried before any link is written."""
    from chunkweave.plans.graphs import _near, near_links

    links = near_links(spark, sf_dir)
    if links and links.linked(J.GATE) >= J.GATE:
        return spark.createDataFrame([], "id long, community long")
    return J.communities(spark, Scratch(spark, "communities").save(_near(spark, sf_dir), "links"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with made-up scores, as the code metrics would give them."""
    k = F.col("p_partkey")
    tags = F.array(*[F.struct(F.lit(n).alias("name"), (k * m % 11 / 10.0).alias("confidence")) for n, m in (("api", 3), ("io", 7), ("math", 5))])
    return parts(spark, sf_dir).select(
        "id", "p_partkey", "quality", (k % 10 / 10.0).alias("coupling"), (k % 7 / 7.0).alias("reusability"), (k % 4 / 4.0).alias("tested"), (k % 21).cast("int").alias("cyclomatic"), (k % 3).cast("int").alias("smells"),
        F.element_at(F.array(*map(F.lit, ("simple", "moderate", "complex", "very_complex"))), (k % 4 + 1).cast("int")).alias("complexity"), F.when(k % 5 > 0, F.array(F.lit(0.5))).alias("vector"),
        F.when(k % 6 > 0, F.concat(F.lit("m"), (k % 2).cast("string"))).alias("model"), (k % 3).cast("int").alias("version"), tags.alias("tags"), F.element_at(F.array(F.lit("heading"), F.lit("code_block"), F.lit("text")), (k % 3 + 1).cast("int")).alias("section"),
    )


def q_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    c = F.col
    return s.select(
        "id", P.is_complex(c("complexity")).alias("complex"), P.has_embedding(c("vector")).alias("embedded"), P.is_highly_coupled(c("coupling")).alias("coupled"), P.is_reusable(c("reusability")).alias("reusable"),
        P.is_well_tested(c("tested")).alias("tested"), P.is_highly_readable(c("quality")).alias("readable"), P.is_section(c("section"), "heading").alias("heading"), P.is_section(c("section"), "code_block").alias("code_block"),
        P.is_high_quality(c("quality"), c("coupling"), c("cyclomatic"), c("smells")).alias("high_quality"), P.needs_embedding(c("vector"), c("model"), c("version"), "m1", 2).alias("stale"),
        F.array_join(P.confident_tags(c("tags")), ",").alias("confident"), F.array_join(P.tag_names(c("tags")), ",").alias("names"),
    )


def q_metric_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight code metrics of each part, in long form, and the overall quality."""
    s = _scored(spark, sf_dir)
    c = F.col
    m = P.quality_metrics(c("coupling"), c("reusability"), c("quality"), c("tested"), c("coupling"), c("reusability"), c("cyclomatic"), c("smells") == 0)
    return s.select("id", P.overall_quality(m, F.lit(0.5)).alias("overall"), F.explode(m).alias("metric", "value")).select("id", "metric", F.round("value", 6).alias("value"), F.round("overall", 6).alias("overall"))


def q_summary_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = files(spark, sf_dir)
    c = F.col("content")
    quality = (T.readability(c) + T.completeness(c)) / 2
    tags = F.array(F.struct(F.col("language").alias("name"), (F.col("doc_id") % 10 / 10.0).alias("confidence")))
    s = d.select(P.summary_info(F.col("doc_id"), F.lit("text_block"), F.lit("simple"), quality, F.lit(0.5), c, T.content_fingerprint(c), tags, F.lit(0), F.lit(1)).alias("s"))
    return s.select("s.id", F.round("s.quality_score", 6).alias("quality"), "s.size.characters", "s.size.lines", "s.size.words", F.array_join("s.high_confidence_tags", ",").alias("tags"))


def q_node_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children added and removed, and the summary that a kind of question gets."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("children"), F.min("n_name").alias("low"))
    summaries = F.create_map(F.lit("functional"), F.concat(F.lit("about "), "low"))
    api = P.with_summary(summaries, "api", F.concat(F.lit("api of "), "low"))
    kids = P.without_child(P.with_child(F.col("children"), F.lit("NOWHERE")), F.col("low"))
    return n.select(
        "n_regionkey", F.array_join(kids, ",").alias("children"), P.summary_for(api, "api", F.lit("none")).alias("api"), P.summary_for(api, "quality", F.lit("none")).alias("quality"), P.summary_for(api, "other", F.lit("none")).alias("other"),
        P.is_leaf(kids).alias("leaf"), P.node_text(F.lit("Region"), F.lit(""), F.lit("text"), api, F.slice("children", 1, 2)).alias("search_text"),
    )


def q_node_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    n = table(spark, sf_dir, "part").select(
        F.concat(F.lit("n"), k.cast("string")).alias("node_id"), (k % 4 - 1).cast("int").alias("level"), F.when(k % 3 > 0, F.col("p_name")).alias("content"), F.when(k % 5 == 0, F.lit(" ")).otherwise(F.when(k % 7 == 0, F.lit("s"))).alias("summary"), F.when(k % 2 == 0, F.array(F.lit("x"))).alias("child_ids")
    )
    return V.node_defects(n).groupBy("defect").agg(F.count(F.lit(1)).alias("n"))


def q_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = H.export_summary(H.tree(chunk_table(spark, sf_dir)))
    return e.select("level", "nodes", F.round("quality", 6).alias("quality"), "sample.title", "sample.summary", F.array_join("sample.keywords", ",").alias("keywords"))


def q_scalability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.scalability(H.level_stats(H.tree(chunk_table(spark, sf_dir)))).select(F.round("scalability", 6).alias("scalability"))


def q_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent keywords of files."""
    return H.common_keywords(H.files_level(H.leaves(chunk_table(spark, sf_dir))))


def q_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf's path, its file's neighbouring chunks and what it reaches."""
    c = chunk_table(spark, sf_dir)
    tree = H.tree(c)
    leaf = F.concat(F.lit("L0:"), "chunk_id")
    scratch = Scratch(spark, "context")
    own = scratch.save(c.select("file_path", "chunk_no", leaf.alias("start")), "own")
    wanted = own.select("start", "file_path", F.explode(F.array(*[F.struct((F.col("chunk_no") + d).alias("k"), F.lit(abs(d)).alias("distance")) for d in (-2, -1, 1, 2)])).alias("w")).select("start", "file_path", F.col("w.k").alias("chunk_no"), "w.distance")
    near = scratch.save(wanted.join(own.withColumnRenamed("start", "id"), ["file_path", "chunk_no"]).select("start", "id", "distance"), "near")
    reach = near.groupBy("start").agg(F.sum((F.col("distance") == 1).cast("long")).alias("direct"), F.sum((F.col("distance") == 2).cast("long")).alias("transitive")).withColumn("rank", F.lit(0.02))
    found = H.context(tree, tree.filter("level = 0"), near, reach)
    return found.select("node_id", F.array_join(F.transform("path", lambda p: p["title"]), " < ").alias("titles"), F.array_join("related", ",").alias("related"), "n_direct", "n_reached", "importance")


def q_of_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which leaf holds each of the chunks asked for."""
    c = chunk_table(spark, sf_dir)
    leaves = H.leaves(c).select("node_id", F.array(F.expr("substr(node_id, 4)")).alias("source_chunk_ids"))
    return H.of_chunks(leaves, c.filter("chunk_no = 1").select("chunk_id"))


def q_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per extension: files, mean quality and the share of complex ones."""
    s = formats.sources(spark, sf_dir)
    return s.groupBy(T.extension(F.col("file_path")).alias("extension")).agg(F.count(F.lit(1)).alias("files"), F.round(F.avg((F.length("content") > 300).cast("double")), 6).alias("long_share"))


def q_processing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What chunking every part's sources, one broken file and one unknown one did."""
    s = formats.sources(spark, sf_dir)
    deep = spark.createDataFrame([("deep.json", "[" * 100_000), ("odd.zz", "nobody knows this language, but it is text " * 3)], "file_path string, content string")
    p = processing_stats(chunk_files(s.union(deep), columns=("file_path", "language", "chunk_type")))
    return p.select("files", "failed", "chunks", F.array_join(F.transform(F.map_entries("chunk_types"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("types"))


def q_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    deep = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.element_at(F.array(F.lit(".json"), F.lit(".xml"), F.lit(".py"), F.lit(".html")), (F.col("n_nationkey") % 4 + 1).cast("int"))).alias("file_path"),
        F.concat(F.repeat(F.element_at(F.array(F.lit("["), F.lit("<a>"), F.lit("-"), F.lit("<p>")), (F.col("n_nationkey") % 4 + 1).cast("int")), 100_000), F.when(F.col("n_nationkey") % 4 == 1, F.repeat(F.lit("</a>"), 100_000)).otherwise(F.lit("1"))).alias("content"),
    )
    return chunk_errors(chunk_files(deep)).select("file_path", "language", "error_class")


def q_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that depends, however far, on a part whose key ends in 7 and is divisible by 3; a part depends on that of a third of its key."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    key = lambda c: F.concat(F.lit("p"), c.cast("string"))
    up = p.filter("p_partkey >= 3").select(key(F.floor(F.col("p_partkey") / 3)).alias("src"), key(F.col("p_partkey")).alias("dst"))
    starts = p.filter("p_partkey % 10 = 7 and p_partkey % 3 = 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    return J.reachable(spark, up, starts)


def q_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by their confident tags, and how good they are."""
    t = _scored(spark, sf_dir).select("id", "quality", F.explode(P.confident_tags(F.col("tags"), 0.7)).alias("topic"))
    return t.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 6).alias("mean"), F.min("quality").alias("least"), F.max("quality").alias("most"))


def q_xml_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.coalesce("html", F.lit(""))
    f = table(spark, sf_dir, "pages").select("page_id", M.xml_facts(h).alias("f"))
    return f.select("page_id", "f.elements", "f.unique_elements", "f.attributes", "f.cdata", F.round("f.text_ratio", 6).alias("text_ratio"))


def q_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.element_counts(table(spark, sf_dir, "pages"), "html")


def q_feed_basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = formats._rss(spark, sf_dir).select("file_path", M.feed_basics(F.col("content")).alias("f"))
    return f.select("file_path", "f.title", F.md5(F.col("f.description").cast("binary")).alias("description"), "f.items")


def q_html_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.coalesce("html", F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.filter(M.html_tags(h), lambda t: ~t.startswith("class_") & ~t.startswith("id_")), ",").alias("tags"), F.size(M.html_links(h)).alias("n_links"))


def q_text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = files(spark, sf_dir).select("doc_id", M.text_statistics(F.col("content")).alias("s"))
    return s.select("doc_id", "s.words", "s.sentences", F.round("s.sentence_words", 6).alias("sentence_words"), F.round("s.word_chars", 6).alias("word_chars"))


def q_style_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors, properties and commands of each part's CSS and LaTeX source."""
    s = formats.sources(spark, sf_dir)
    c = F.col("content")
    css = s.filter(F.col("file_path").endswith(".css")).select("file_path", F.array_join(M.css_properties(c), ",").alias("names"), F.size(M.css_selectors(F.regexp_extract(c, r"(?s)\.part.*?\}", 0))).alias("n"))
    tex = s.filter(F.col("file_path").endswith(".tex")).select("file_path", M.latex_facts(c).alias("f")).select("file_path", F.array_join("f.commands", ",").alias("names"), (F.col("f.citations") + F.col("f.labels")).alias("n"))
    rust = s.filter(F.col("file_path").endswith(".rs")).select("file_path", F.array_join(M.rust_dependencies(c), ",").alias("names"), F.lit(0).alias("n"))
    return css.union(tex).union(rust)


def q_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best parts by similarity and quality."""
    c = parts(spark, sf_dir).select("id", (F.col("p_partkey") % 101 / 100.0).alias("similarity"), "quality")
    return L.hybrid_rank(c, 10).select("id", F.round("score", 6).alias("score"))


QUERIES = {
    "graph_build": q_build, "graph_update": q_update, "graph_remove": q_remove, "change_impact": q_change_impact, "hotspots": q_hotspots, "central_components": q_central, "quality_metrics": q_quality_metrics,
    "duplicate_patterns": q_duplicate_patterns, "cycles_5": q_cycles, "graph_diameter": q_diameter, "louvain": q_louvain, "chunk_flags": q_flags, "metric_map": q_metric_map, "summary_info": q_summary_info,
    "node_edits": q_node_edits, "node_defects": q_node_defects, "hierarchy_export": q_export, "hierarchy_scalability": q_scalability, "common_keywords": q_keywords, "hierarchy_context": q_context, "leaf_of_chunk": q_of_chunks,
    "extension_rollup": q_rollup, "processing_stats": q_processing, "chunk_errors": q_errors, "hybrid_rank": q_hybrid,
    "stale_closure": q_stale, "topic_clusters": q_topics, "xml_facts": q_xml_facts, "element_counts": q_elements, "feed_basics": q_feed_basics, "html_tags": q_html_tags, "text_statistics": q_text_statistics, "style_facts": q_style_facts,
}

_PARTS = """p as (select 'p' || p_partkey as id, p_partkey as k, p_name, 'src/f' || (p_partkey // 20) as file_path, p_partkey % 20 * 3 + 1 as a, p_partkey % 20 * 3 + 1 + p_size as b, p_size / cast(50 as double) as quality from part)"""
_KINDS = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
_TYPES = "[" + ", ".join(f"'{C.RELATIONSHIPS[k][0]}'" for k in KINDS) + "]"
_GRAPHS = "[" + ", ".join(f"'{C.RELATIONSHIPS[k][1]}'" for k in KINDS) + "]"
_REL = lambda step: f"select 'p' || p_partkey as src, 'p' || (p_partkey * {step} % (select max(p_partkey) from part) + 1) as dst, {_TYPES}[p_partkey % {len(KINDS)} + 1] as edge_type, {_GRAPHS}[p_partkey % {len(KINDS)} + 1] as graph_type from part"
_GRAPH = f"""{_PARTS}, e as ({_REL(7)} union all select x.id, y.id, 'contains', 'hierarchy_graph' from p x join p y on x.file_path = y.file_path and y.a < x.a and y.b >= x.b)"""
_TEMPLATE_COUNTS = ", ".join(f"('{kind}', {sum(r[2] == kind for r in formats.EXPECTED)})" for kind in sorted({r[2] for r in formats.EXPECTED}))
_PLAIN = "(select count(*) from part)"

_NAMES = "regexp_extract_all(coalesce(html, ''), '<([A-Za-z_][^\\s/>?!<]*)', 1)"
_KIND_OF = ", ".join(f"case when regexp_matches(low, '<({p})[\\s>/]') then '{n}' end" for n, p in M._HTML_KINDS)

ORACLE_SQL = {
    "stale_closure": f"with recursive {_PARTS}, r as (select id, k from p where k % 10 = 7 and k % 3 = 0 union select p.id, p.k from r join p on p.k // 3 = r.k and p.k >= 3) select id from r",
    "topic_clusters": f"with {_PARTS}, t as (select quality, unnest([case when k * 3 % 11 > 7 then 'api' end, case when k * 7 % 11 > 7 then 'io' end, case when k * 5 % 11 > 7 then 'math' end]) as topic from p) select topic, count(*) as n, round(avg(quality), 6) as mean, min(quality) as least, max(quality) as most from t where topic is not null group by 1",
    "xml_facts": f"""with x as (select page_id, coalesce(html, '') as h, {_NAMES} as names from pages)
select page_id, cast(len(names) as integer) as elements, cast(len(list_distinct(list_transform(names, lambda n: lower(regexp_replace(n, '^.*:', ''))))) as integer) as unique_elements,
  cast(len(list_distinct(regexp_extract_all(h, '\\s([\\w:.-]+)=["'']', 1))) as integer) as attributes, cast(len(regexp_extract_all(h, '<!\\[CDATA\\[')) as integer) as cdata,
  round(case when length(h) > 0 then length(regexp_replace(regexp_replace(h, '<[^>]*>', '', 'g'), '^[ \\t\\n\\r\\f\\x0b]+|[ \\t\\n\\r\\f\\x0b]+$', '', 'g')) / cast(length(h) as double) else 0 end, 6) as text_ratio from x""",
    "element_counts": f"with x as (select unnest({_NAMES}) as name from pages) select lower(regexp_replace(name, '^.*:', '')) as element, count(*) as n from x group by 1",
    "feed_basics": """with w as (select doc_id, source, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z ]', '', 'g')) as t from documents) select 'feed_' || doc_id || '.rss' as file_path, source as title, md5(nullif(t, '')) as description, cast(1 as integer) as items from w""",
    "html_tags": f"""with x as (select page_id, coalesce(html, '') as h, lower(coalesce(html, '')) as low from pages) select page_id, array_to_string(list_filter(['html', {_KIND_OF}], lambda t: t is not null), ',') as tags, cast(len(list_distinct(regexp_extract_all(h, '(?:href|src)=["'']([^"'']+)', 1))) as integer) as n_links from x""",
    "text_statistics": f"""with {FILES_SQL}, s as (select doc_id, cast({_words()} as integer) as words, cast(greatest(length(content) - length(replace(replace(replace(content, '.', ''), '!', ''), '?', '')), 1) as integer) as sentences, length(regexp_replace(content, '[ \\t\\n\\r\\f\\x0b]+', '', 'g')) as letters from files)
select doc_id, words, sentences, round(words / cast(sentences as double), 6) as sentence_words, round(case when words > 0 then letters / cast(words as double) else 0 end, 6) as word_chars from s""",
    "style_facts": """select 'part_' || p_partkey || '.css' as file_path, 'display,color,padding' as names, cast(2 as integer) as n from part
union all select 'part_' || p_partkey || '.tex', 'begin:2,end:2,cite:1,documentclass:1,label:1,section:1,usepackage:1', 2 from part
union all select 'part_' || p_partkey || '.rs', 'uses:std::fmt,calls:derive,calls:area,types:String', 0 from part""",
    "graph_build": f"with {_GRAPH} select edge_type, graph_type, count(*) as n from e group by all",
    "graph_update": f"""with {_GRAPH}, c as (select id from p where k % 10 = 3), hit as (select dst as id from e where graph_type in ('call_graph', 'data_flow', 'import_graph') and src in (select id from c) union select id from c),
kept as (select src, dst, edge_type from e where graph_type <> 'hierarchy_graph' and src not in (select id from c) and dst not in (select id from c) and (graph_type not in ('semantic_graph', 'quality_graph') or (src not in (select id from hit) and dst not in (select id from hit)))),
fresh as (select src, dst, edge_type from ({_REL(11)}) where src in (select id from c))
select id as src, '' as dst, 'changed node' as edge_type from c union all select * from (select * from kept union select * from fresh)""",
    "graph_remove": f"""with {_GRAPH}, g as (select id from p where k % 10 = 4) select edge_type, graph_type, count(*) as n from e where src not in (select id from g) and dst not in (select id from g) group by all
union all select 'nodes', '', (select count(*) from p where k % 10 <> 4)""",
    "change_impact": f"""with {_GRAPH}, i as (select distinct src, dst from e where graph_type in ('call_graph', 'data_flow', 'import_graph')), s as (select id as start from p where k % 50 = 0),
h1 as (select distinct start, dst as id from s join i on src = start where dst <> start), h2 as (select distinct h1.start, dst as id from h1 join i on src = h1.id where dst <> h1.start and not exists (select 1 from h1 x where x.start = h1.start and x.id = dst)),
r as (select start, id, 1 as d from h1 union all select start, id, 2 from h2),
g as (select s.start, coalesce(sum(case when d = 1 then 1 else 0 end), 0) as direct, coalesce(sum(case when d = 2 then 1 else 0 end), 0) as transitive, coalesce(sum(1 - quality), 0) as qw, coalesce(sum(k % 97 / cast(10000 as double)), 0) as rw from s left join r on r.start = s.start left join p on p.id = r.id group by s.start),
v as (select *, case when direct + transitive > 20 or rw > 0.1 then 'high' when direct + transitive > 10 or rw > 0.05 then 'medium' else 'low' end as severity from g)
select start, cast(direct as bigint) as direct, cast(transitive as bigint) as transitive, round(qw, 6) as quality_weight, round(rw, 6) as rank_weight, severity,
  coalesce(nullif(concat_ws('; ', case when severity = 'high' then 'Split the change into smaller steps; Test every affected component; Roll out behind a feature flag' end, case when direct > 15 then 'Many direct dependents: reduce the coupling' end, case when transitive > 30 then 'Wide transitive reach: review the boundaries between layers' end), ''), 'Standard tests suffice') as advice from v""",
    "hotspots": f"with {_PARTS}, s as (select id, k % 97 / cast(10000 as double) / (quality + 0.1) as score from p where quality < 0.6) select id, round(score, 9) as score from s order by s.score desc, id limit 20",
    "central_components": f"with {_PARTS}, r as (select {_GRAPHS}[k % {len(KINDS)} + 1] as graph_type, id, k % 97 as rank from p), w as (select *, row_number() over (partition by graph_type order by rank desc, id) as place from r) select graph_type, id, cast(place as integer) as place from w where place <= 10",
    "quality_metrics": f"with {_PARTS} select count(*) as n_nodes, round(avg(quality), 6) as average_quality, round(var_pop(quality), 6) as quality_variance, round(avg(case when quality > 0.8 then 1.0 else 0.0 end) * 100, 6) as high_quality_percentage from p",
    "duplicate_patterns": "with c as (select p_type as pattern, count(*) as n, cast(count(*) filter (where p_partkey * 37 % 101 > 80) as bigint) as n_confident from part group by 1) select *, case when n_confident > 3 then 'high' else 'medium' end as potential from c where n > 2 and n_confident > 1",
    "cycles_5": f"""with recursive {MOVES_SQL}, d as (select distinct src, dst from e where src <> dst),
w as (select src as s, dst as l, [src, dst] as p from d where dst > src union all select s, dst, list_append(p, dst) from w join d on src = l where dst > s and not list_contains(p, dst) and len(p) < 5)
select array_to_string(p, '>') as cycle, cast(len(p) as integer) as length, case when len(p) <= 3 then 'high' else 'medium' end as severity from w join d on d.src = l and d.dst = s""",
    "graph_diameter": f"""with recursive {MOVES_SQL}, u as (select distinct src as a, dst as b from e where src <> dst union select distinct dst, src from e where src <> dst),
r as (select a as s, a as id, 0 as d from u union select s, b, d + 1 from r join u on a = id where d < 10), far as (select s, id, min(d) as d from r group by all) select cast(max(d) as integer) as diameter from far""",
    "closeness": f"""with recursive {MOVES_SQL}, ids as (select src as id from e union select dst from e), n as (select count(*) as n from ids),
r as (select id as s, id, 0 as d from ids union select s, e.src, d + 1 from r join e on e.dst = r.id where d < 10), far as (select s, id, min(d) as d from r group by all),
c as (select s, sum(d) as total, count(*) - 1 as k from far group by s) select s as id, round(case when total > 0 then k / cast(total as double) * (k / cast(n - 1 as double)) else 0.0 end, 6) as closeness from c, n""",
    "betweenness": f"""with recursive {MOVES_SQL}, d as (select distinct src, dst from e where src <> dst), ids as (select src as id from e union select dst from e), n as (select count(*) as n from ids),
w as (select src as s, dst as t, [src, dst] as p from d union all select s, d.dst, list_append(p, d.dst) from w join d on d.src = w.t where not list_contains(p, d.dst)),
b as (select s, t, min(len(p)) as least from w group by all), q as (select w.s, w.t, p, count(*) over (partition by w.s, w.t) as paths from w join b on b.s = w.s and b.t = w.t and len(p) = least),
v as (select unnest(p[2:-2]) as id, 1.0 / paths as share from q) select ids.id, round(case when n > 2 then coalesce(sum(share), 0) / ((n - 1) * (n - 2)) else 0.0 end, 6) as betweenness from ids cross join n left join v on v.id = ids.id group by ids.id, n""",
    "label_prop": f"with {_NEAR_SQL}, u as (select distinct src as a, dst as b from e union select dst, src from e), l0 as (select distinct a as id, a as label from u), "
    + ", ".join(
        f"v{k} as (select a as id, label, count(*) as n from u join l{k - 1} on l{k - 1}.id = b group by all), l{k} as (select id, arg_min(label, (-n) * cast(1000000000000 as hugeint) + label) as label from v{k} group by id)" for k in range(1, 5)
    )
    + " select id, label from l4",
    "chunk_flags": f"""with {_PARTS}, c as (select *, [{{'n': 'api', 'c': k * 3 % 11}}, {{'n': 'io', 'c': k * 7 % 11}}, {{'n': 'math', 'c': k * 5 % 11}}] as tags from p)
select id, k % 4 >= 2 as complex, k % 5 > 0 as embedded, k % 10 > 7 as coupled, k % 7 > 4.2 as reusable, k % 4 > 2 as tested, quality > 0.7 as readable, k % 3 = 0 as heading, k % 3 = 1 as code_block,
  cast(quality > 0.7 as int) + cast(k % 10 > 6 as int) + cast(k % 21 <= 10 as int) + cast(k % 3 = 0 as int) >= 3 as high_quality, k % 5 = 0 or k % 6 = 0 or k % 2 = 0 or k % 3 < 2 as stale,
  array_to_string(list_transform(list_filter(tags, lambda t: t.c > 8), lambda t: t.n), ',') as confident, 'api,io,math' as names from c""",
    "metric_map": f"""with {_PARTS}, m as (select id, case when k % 21 <= 5 then 1.0 when k % 21 <= 10 then 0.7 when k % 21 <= 15 then 0.5 else 0.3 end::double as cx, k, quality from p),
o as (select *, (k % 10 / cast(10 as double) + cx + quality) / 3 as overall from m)
select id, metric, round(value, 6) as value, round(overall, 6) as overall from (select id, overall, unnest(['complexity', 'error_handling', 'type_safety', 'documentation_quality', 'coupling', 'test_coverage_indicator', 'reusability', 'maintainability']) as metric,
  unnest([cx, case when k % 3 = 0 then 1.0 else 0.0 end, k % 7 / cast(7 as double), k % 10 / cast(10 as double), k % 10 / cast(10 as double), k % 4 / cast(4 as double), k % 7 / cast(7 as double), quality]) as value from o)""",
    "summary_info": f"with {FILES_SQL} select doc_id as id, round((cast(({_READ}) as double) + cast(({_COMPLETE}) as double)) / 2, 6) as quality, cast(length(content) as integer) as characters, cast(length(content) - length(replace(content, chr(10), '')) + 1 as integer) as lines, cast({_words()} as integer) as words, case when doc_id % 10 > 8 then language else '' end as tags from files",
    "node_edits": """with n as (select n_regionkey, list_sort(list(n_name)) as c, min(n_name) as low from nation group by 1)
select n_regionkey, array_to_string(list_append(c[2:], 'NOWHERE'), ',') as children, 'api of ' || low as api, 'none' as quality, 'about ' || low as other, false as leaf,
  'Region' || chr(10) || 'text' || chr(10) || '[FUNCTIONAL] about ' || low || chr(10) || '[API] api of ' || low || chr(10) || 'Keywords: ' || array_to_string(c[1:2], ', ') as search_text from n""",
    "node_defects": """with n as (select p_partkey % 4 - 1 as level, p_partkey % 3 = 0 and (p_partkey % 5 = 0 or p_partkey % 7 <> 0) as blank, p_partkey % 2 = 1 as alone from part),
d as (select unnest([case when level < 0 then 'negative level' end, case when blank then 'no content or summary' end, case when level > 0 and alone then 'inner node without children' end, case when level = 0 and not alone then 'leaf with children' end]) as defect from n)
select defect, count(*) as n from d where defect is not null group by 1""",
    "hierarchy_export": f"""with {_TREE}, x as (select 0 as level, node_id, title, null as summary, keywords, quality from l0 union all select 1, node_id, title, summary, keywords, quality from l1 union all select 2, node_id, title, summary, keywords, quality from l2 union all select 3, node_id, title, summary, keywords, quality from l3s),
g as (select level, count(*) as nodes, avg(quality) as quality, arg_min(title, node_id) as title, min(node_id) as low from x group by level)
select g.level, nodes, round(g.quality, 6) as quality, g.title, case when length(summary) > 200 then substr(summary, 1, 200) || '...' else coalesce(summary, '') end as summary, array_to_string(keywords[1:5], ',') as keywords from g join x on x.level = g.level and x.node_id = low""",
    "hierarchy_scalability": f"with {_TREE} select round(avg(case when a.nodes / cast(b.nodes as double) between 5 and 20 then 1.0 else 0.0 end), 6) as scalability from stats a join stats b on b.level = a.level + 1",
    "common_keywords": f"with {_TREE}, k as (select unnest(keywords) as keyword from l1) select keyword, count(*) as n from k group by 1 order by n desc, keyword limit 10",
    "hierarchy_context": f"""with {_TREE}, r as (select a.node_id, string_agg(b.node_id, ',' order by b.node_id) as related, count(*) filter (where abs(a.chunk_no - b.chunk_no) = 1) as n_direct, count(*) as n_reached from l0 a join l0 b on b.file_path = a.file_path and b.chunk_no <> a.chunk_no and abs(b.chunk_no - a.chunk_no) <= 2 group by 1)
select l0.node_id, l0.title || ' < ' || l1.title || ' < ' || l2.title || ' < Repository Overview' as titles, coalesce(related, '') as related, coalesce(n_direct, 0) as n_direct, coalesce(n_reached, 0) as n_reached, case when r.node_id is null then 'low' else 'medium' end as importance from l0 join l1 on l1.node_id = l0.parent_id join l2 on l2.node_id = l1.parent_id left join r on r.node_id = l0.node_id""",
    "leaf_of_chunk": f"with {_TREE} select substr(node_id, 4) as chunk_id, node_id from l0 where chunk_no = 1",
    "extension_rollup": "with t(extension, text) as (values "
    + ", ".join(f"('.{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in formats.SOURCES.items())
    + "), f as (select extension, replace(text, '@@', cast(p_partkey as varchar)) as content from part cross join t) select extension, count(*) as files, round(avg(case when length(content) > 300 then 1.0 else 0.0 end), 6) as long_share from f group by 1",
    "processing_stats": f"""with t(kind, times) as (values {_TEMPLATE_COUNTS}), c as (select kind, times * {_PLAIN} + case when kind = 'text_block' then 2 else 0 end as n from t)
select {len(formats.SOURCES)} * {_PLAIN} + 2 as files, cast(1 as bigint) as failed, cast(sum(n) as bigint) as chunks, string_agg(kind || ':' || n, ',' order by kind) as types from c""",
    "chunk_errors": """select 'n' || n_nationkey || ['.json', '.xml', '.py'][n_nationkey % 4 + 1] as file_path, ['json', 'xml', 'python'][n_nationkey % 4 + 1] as language, 'ParserFailure' as error_class from nation where n_nationkey % 4 < 3""",
    "hybrid_rank": f"with {_PARTS}, s as (select id, k % 101 / cast(100 as double) * 0.7 + quality * 0.3 as score from p) select id, round(score, 6) as score from s order by s.score desc, id limit 10",
}

"""Hierarchy, search, incremental and validation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.functions import classify as C
from chunkweave.functions import text as T
from chunkweave.operators import hierarchy as H
from chunkweave.operators import incremental as I
from chunkweave.operators import search as L
from chunkweave.operators import validate as V
from chunkweave.plans.chunks import CHUNKS_SQL, FILES_SQL, _COMPLETE, _READ, _TAGS, _words, as_chunks, chunk_table, files
from chunkweave.session import Scratch, table


def q_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = H.files_level(H.leaves(chunk_table(spark, sf_dir)))
    return f.select("node_id", "parent_id", "title", "language", "members", F.md5(F.col("content").cast("binary")).alias("content_hash"), "summary", F.array_join("keywords", ",").alias("keywords"), F.round("quality", 6).alias("quality"))


def q_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = H.modules_level(H.files_level(H.leaves(chunk_table(spark, sf_dir))))
    return m.select("node_id", "parent_id", "title", "language", "members", "summary", F.array_join("keywords", ",").alias("keywords"), F.round("quality", 6).alias("quality"))


def q_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = H.repository_level(H.modules_level(H.files_level(H.leaves(chunk_table(spark, sf_dir)))))
    return r.select("node_id", "title", "language", "members", "summary", F.array_join("keywords", ",").alias("keywords"), F.round("quality", 6).alias("quality"))


def q_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = H.level_stats(H.tree(chunk_table(spark, sf_dir)))
    return s.select("level", "nodes", F.round("quality", 6).alias("quality"), "content_size", "summary_size")


def q_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = H.balance(H.level_stats(H.tree(chunk_table(spark, sf_dir))))
    return b.select("level", F.round("ratio", 6).alias("ratio"), "balanced")


def q_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = H.tree(chunk_table(spark, sf_dir))
    return H.paths_to_root(t, t.filter("level = 0"))


def q_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = H.tree(chunk_table(spark, sf_dir))
    return H.subtree(t, t.filter("level = 2"), 2).groupBy("root", "distance").agg(F.count(F.lit(1)).alias("n"))


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks to be searched, with as much of their text as searches look at or give (500 characters) and one more, which tells that there is more."""
    return H.leaves(chunk_table(spark, sf_dir), 501)


def _levels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, files and modules to be searched; chunks and files are written once."""
    scratch = Scratch(spark, "levels")
    l0 = scratch.save(_leaves(spark, sf_dir), "chunks")
    l1 = scratch.save(H.files_level(l0).withColumn("content", F.substring("content", 1, 501)), "files")
    l2 = H.modules_level(l1).withColumn("content", F.lit(""))
    return l0.withColumn("summary", F.lit(None).cast("string")), l1, l2


def q_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks for a phrase."""
    return L.substring_search(chunk_table(spark, sf_dir), "the and", 10).select("chunk_id", F.round("score", 6).alias("score"))


def q_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best files for a question."""
    return L.level_search(_levels(spark, sf_dir)[1], "technical text of the error", 10).select("node_id", F.round("score", 6).alias("score"), F.md5(F.col("content").cast("binary")).alias("content_hash"))


def q_drill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A routed question: too few hits on its level, so it drills down."""
    query = "module src3 structure"
    assert C.QUERY_LEVEL["architectural"] == 2
    _, l1, l2 = _levels(spark, sf_dir)
    return L.drill_down(l2, l1, query, 40).select("level", "node_id", F.round("score", 6).alias("score"))


def q_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks for a question under a budget of 200 tokens."""
    l0 = Scratch(spark, "budget").save(_leaves(spark, sf_dir), "chunks").withColumn("summary", F.lit(None).cast("string"))  # scored to filter and to sort
    found = L.level_search(l0, "text_block the", 20, 200)
    return L.within_budget(found, 200)


def q_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, then modules while the budget is over 500, then chunks while it is over 300."""
    return L.general_search(dict(enumerate(_levels(spark, sf_dir))), "text content of modules", 10, 900)


def q_architectural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question that no module answers: the repository does."""
    l0, l1, l2 = _levels(spark, sf_dir)
    top = H.repository_level(H.modules_level(l1)).withColumn("content", F.lit(""))
    kind, found = L.intelligent_search({0: l0, 1: l1, 2: l2, 3: top}, chunk_table(spark, sf_dir), _links(spark, sf_dir), "repository overview", 5)
    return found.select(F.lit(kind).alias("kind"), "level", "node_id", F.round("score", 6).alias("score"))


def q_implementation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files for a question, drilled down to chunks, and the best chunks that fit the budget."""
    levels = dict(enumerate(_levels(spark, sf_dir)))
    return L.implementation_search(levels, "show the text of doc_1", 8, 300).select("node_id", F.round("score", 6).alias("score"))


def q_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree after documents were added, removed and edited, brought up to date from the tree before."""
    before, after = _mutated(spark, sf_dir)
    old1 = Scratch(spark, "before").save(H.files_level(H.measured(H.leaves(as_chunks(before)))), "files")
    l1, l2, l3 = H.update_tree(old1, H.modules_level(old1), as_chunks(after))
    part = lambda d: d.select("level", "node_id", "members", "summary", F.round("quality", 6).alias("quality"))
    return part(l1).union(part(l2)).union(part(l3))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a file within two steps of each other."""
    c = chunk_table(spark, sf_dir).select("file_path", "chunk_no", "chunk_id")
    wanted = c.select("chunk_id", "file_path", F.explode(F.array(*[F.col("chunk_no") + d for d in (-2, -1, 1, 2)])).alias("k"))
    return wanted.join(c.select("file_path", F.col("chunk_no").alias("k"), F.col("chunk_id").alias("near")), ["file_path", "k"]).select("chunk_id", "near")


def q_relationship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of chunks that name the question's entities."""
    return L.relationship_search(chunk_table(spark, sf_dir), _links(spark, sf_dir), "what uses thing or that", 12).select("entity", "chunk_id", "node_id", "score")


def _mutated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The documents, and a later state with additions, removals and edits."""
    before = files(spark, sf_dir)
    edit = F.when(F.col("doc_id") % 10 == 3, F.concat("content", F.lit("\nedited"))).otherwise(F.col("content"))
    after = before.filter("doc_id % 10 <> 4").withColumn("content", edit)
    new = before.filter("doc_id % 10 = 5").withColumn("doc_id", F.col("doc_id") + 1_000_000_000).withColumn("file_path", F.concat(F.lit("src/"), "module", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return before, after.union(new.select(after.columns))


def q_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _mutated(spark, sf_dir)
    print_of = lambda d: d.select("file_path", T.content_fingerprint(F.col("content")).alias("fingerprint"))
    return I.snapshot_diff(print_of(before), print_of(after), "file_path").select("file_path", "change")


def q_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules touched by changed files, and the share of their files that changed."""
    before, after = _mutated(spark, sf_dir)
    print_of = lambda d: d.select("file_path", T.content_fingerprint(F.col("content")).alias("fingerprint"))
    diff = I.snapshot_diff(print_of(before), print_of(after), "file_path")
    module = F.regexp_extract("file_path", r"^src/([^/]+)/", 1)
    changed = diff.withColumn("module", module).groupBy("module").agg(F.count(F.lit(1)).alias("changed"))
    total = after.groupBy("module").agg(F.count(F.lit(1)).alias("files"))
    return changed.join(total, "module", "left").select("module", "changed", F.coalesce("files", F.lit(0)).alias("files"), F.round(F.col("changed") / F.col("files"), 6).alias("share"))


def q_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _mutated(spark, sf_dir)
    old = before.select("file_path", T.content_fingerprint(F.col("content")).alias("fingerprint"), F.lit(1).alias("version"))
    new = after.select("file_path", T.content_fingerprint(F.col("content")).alias("fingerprint"))
    return I.merge_versions(old, new, "file_path").select("file_path", "version", "is_dirty")


def q_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects put into chunks on purpose, and how often each is found."""
    c = files(spark, sf_dir)
    bad = c.select(
        F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("c"), F.col("doc_id").cast("string"))).alias("chunk_id"),
        F.when(F.col("doc_id") % 11 == 0, F.lit("  ")).otherwise(F.col("content")).alias("content"),
        F.when(F.col("doc_id") % 13 == 0, F.lit(9)).otherwise(F.lit(1)).alias("start_line"), F.lit(5).alias("end_line"), (F.col("doc_id") % 17 / 10.0).alias("importance"),
    )
    return V.defects(bad).groupBy("defect").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "hierarchy_files": q_files, "hierarchy_modules": q_modules, "hierarchy_repo": q_repo, "hierarchy_stats": q_stats, "hierarchy_balance": q_balance, "hierarchy_path": q_path, "hierarchy_subtree": q_subtree,
    "search_substring": q_substring, "search_level": q_level, "search_drilldown": q_drill, "search_budget": q_budget, "search_general": q_general, "search_relationship": q_relationship, "search_architectural": q_architectural, "search_implementation": q_implementation, "hierarchy_update": q_update,
    "snapshot_diff": q_diff, "change_propagation": q_propagation, "snapshot_versions": q_versions, "validate_chunks": q_validate,
}

_TREE = f"""{CHUNKS_SQL},
l0 as (select 'L0:' || chunk_id as node_id, 'L1:doc_' || doc_id as parent_id, 'text_block: ' || chunk_id as title, file_path, doc_id, module, language, chunk_no, content, list_filter({_TAGS}, lambda x: x is not null) as keywords, (cast(({_READ}) as double) + cast(({_COMPLETE}) as double)) / 2 as quality from chunks),
l1x as (select file_path, any_value(doc_id) as doc_id, any_value(module) as module, any_value(language) as language, count(*) as members, avg(quality) as quality, list_sort(list_distinct(flatten(list(keywords))))[1:10] as keywords,
  string_agg('## ' || title || chr(10) || case when length(content) > 500 then substr(content, 1, 500) || '...' else content end, chr(10) || chr(10) order by chunk_no) as joined, any_value(content) as only_one from l0 group by file_path),
l1 as (select 'L1:doc_' || doc_id as node_id, 'L2:' || module as parent_id, 'File: doc_' || doc_id || '.txt' as title, file_path, module, language, members, case when members = 1 then only_one else joined end as content,
  case when members > 1 then 'File doc_' || doc_id || '.txt contains ' || members || ' components: text_block. Primary functionality includes: ' || array_to_string(keywords[1:3], ', ') || '.' end as summary, keywords, quality from l1x),
l2x as (select module, count(*) as members, arg_min(language, file_path) as language, avg(quality) as quality, list_sort(list_distinct(flatten(list(keywords))))[1:15] as keywords from l1 group by module),
l2 as (select 'L2:' || module as node_id, 'L3:overview' as parent_id, 'Module: ' || module as title, module, language, members, 'Module ' || module || ' consists of ' || members || ' files. Core functionality: ' || array_to_string(keywords[1:5], ', ') || '.' as summary, keywords, quality from l2x),
top as (select language from l2 group by language order by count(*) desc, language limit 1),
l3 as (select 'L3:overview' as node_id, 'Repository Overview' as title, (select language from top) as language, count(*) as members, list_sort(list_distinct(flatten(list(keywords))))[1:20] as keywords, avg(quality) as quality from l2),
l3s as (select *, 'Repository contains ' || members || ' modules in ' || language || '. Main domains: ' || array_to_string(keywords[1:7], ', ') || '.' as summary from l3),
stats as (select 0 as level, count(*) as nodes, avg(quality) as quality, cast(sum(length(content)) as bigint) as content_size, 0 as summary_size from l0 union all select 1, count(*), avg(quality), cast(sum(length(content)) as bigint), cast(coalesce(sum(length(summary)), 0) as bigint) from l1
  union all select 2, count(*), avg(quality), 0, cast(sum(length(summary)) as bigint) from l2 union all select 3, count(*), avg(quality), 0, cast(sum(length(summary)) as bigint) from l3s)"""


def _score(text: str, query: str) -> str:
    words = query.lower().split()
    return "((" + " + ".join(f"cast(contains(lower({text}), '{w}') as int)" for w in words) + f") / cast({len(words)} as double))"


_TEXT1 = "concat_ws(chr(10), title, coalesce(summary, substr(content, 1, 500)), array_to_string(keywords, ', '))"
_TEXT0 = "concat_ws(chr(10), title, substr(content, 1, 500), array_to_string(keywords, ', '))"
_HEAD = "case when length(content) > {n} then substr(content, 1, {n}) || '...' else content end"
_AFTER = f"""{FILES_SQL}, after as (select file_path, module, case when doc_id % 10 = 3 then content || chr(10) || 'edited' else content end as content from files where doc_id % 10 <> 4
  union all select 'src/' || module || '/doc_' || (doc_id + 1000000000) || '.txt', module, content from files where doc_id % 10 = 5),
diff as (select coalesce(b.file_path, a.file_path) as file_path, case when b.file_path is null then 'added' when a.file_path is null then 'removed' when a.content <> b.content then 'modified' end as change from files b full join after a on a.file_path = b.file_path)"""

_AFTER_FILES = FILES_SQL.replace("files as", "old as", 1) + """, files as (select file_path, doc_id, module, language, case when doc_id % 10 = 3 then content || chr(10) || 'edited' else content end as content from old where doc_id % 10 <> 4
  union all select 'src/' || module || '/doc_' || (doc_id + 1000000000) || '.txt', doc_id + 1000000000, module, language, content from old where doc_id % 10 = 5)"""
_QUESTION = "text content of modules"
_SHOW = "show the text of doc_1"
_TEXT2 = "concat_ws(chr(10), title, summary, array_to_string(keywords, ', '))"

ORACLE_SQL = {
    "search_general": f"""with recursive {_TREE}, q1 as (select node_id, {_HEAD.format(n=500)} as content, row_number() over (order by score desc, node_id) as k from (select node_id, content, {_score(_TEXT1, _QUESTION)} as score from l1) where score > 0),
q2 as (select node_id, '' as content, row_number() over (order by score desc, node_id) as k from (select node_id, {_score(_TEXT2, _QUESTION)} as score from l2) where score > 0),
q0 as (select node_id, {_HEAD.format(n=500)} as content, row_number() over (order by score desc, node_id) as k from (select node_id, content, {_score(_TEXT0, _QUESTION)} as score from l0) where score > 0),
u as (select 1 as stage, 0 as least, node_id, content, k from q1 where k <= 5 union all select 2, 500, node_id, content, k from q2 where k <= 3 union all select 3, 300, node_id, content, k from q0 where k <= 5),
t as (select stage, least, node_id, {_words()} as tokens, row_number() over (order by stage, k) as n from u),
f as (select cast(0 as bigint) as n, 0 as stage, cast(null as varchar) as node_id, cast(0 as bigint) as tokens, cast(900 as bigint) as rest, true as gate, false as took
  union all select n, stage, node_id, tokens, case when gate and tokens <= rest then rest - tokens else rest end, gate, gate and tokens <= rest from (select t.n, t.stage, t.node_id, t.tokens, f.rest, case when t.stage = f.stage then f.gate else f.rest > t.least end as gate from f join t on t.n = f.n + 1))
select node_id, cast(tokens as integer) as tokens from f where took""",
    "search_architectural": f"with {_TREE} select 'architectural' as kind, 3 as level, node_id, cast(1 as double) as score from l3s where not exists (select 1 from l2 where {_score(_TEXT2, 'repository overview')} > 0)",
    "search_implementation": f"""with recursive {_TREE}, t as (select node_id, {_score(_TEXT1, _SHOW)} as score from l1), a as (select * from t where score > 0 order by score desc, node_id limit 4), b as (select node_id from a order by score desc, node_id limit 3),
k as (select node_id, {_score(_TEXT0, _SHOW)} * 0.8 as score, parent_id from l0 where parent_id in (select node_id from b)), d as (select *, row_number() over (partition by parent_id order by score desc, node_id) as place from k where score > 0),
files_ as (select * from (select * from a union all select node_id, score from d where place <= 2 and (select count(*) from a) < 4) order by score desc, node_id limit 4),
s as (select node_id, {_HEAD.format(n=500)} as content, score, row_number() over (order by score desc, node_id) as n from (select node_id, content, {_score(_TEXT0, _SHOW)} as score from l0) where score > 0), w as (select node_id, score, {_words()} as tokens, n from s where n <= 3),
f as (select cast(0 as bigint) as n, cast(null as varchar) as node_id, cast(0 as double) as score, cast(300 as bigint) as rest, false as took union all select w.n, w.node_id, w.score, case when w.tokens <= f.rest then f.rest - w.tokens else f.rest end, w.tokens <= f.rest from f join w on w.n = f.n + 1),
o as (select node_id, score from files_ union select node_id, score from f where took) select node_id, round(score, 6) as score from o order by o.score desc, node_id limit 8""",
    "hierarchy_update": f"with {_TREE.replace(FILES_SQL, _AFTER_FILES)} select 1 as level, node_id, members, summary, round(quality, 6) as quality from l1 union all select 2, node_id, members, summary, round(quality, 6) from l2 union all select 3, node_id, members, summary, round(quality, 6) from l3s",
    "hierarchy_files": f"with {_TREE} select node_id, parent_id, title, language, members, md5(content) as content_hash, summary, array_to_string(keywords, ',') as keywords, round(quality, 6) as quality from l1",
    "hierarchy_modules": f"with {_TREE} select node_id, parent_id, title, language, members, summary, array_to_string(keywords, ',') as keywords, round(quality, 6) as quality from l2",
    "hierarchy_repo": f"with {_TREE} select node_id, title, language, members, summary, array_to_string(keywords, ',') as keywords, round(quality, 6) as quality from l3s",
    "hierarchy_stats": f"with {_TREE} select level, nodes, round(quality, 6) as quality, content_size, summary_size from stats",
    "hierarchy_balance": f"with {_TREE} select a.level, round(a.nodes / cast(b.nodes as double), 6) as ratio, a.nodes / cast(b.nodes as double) between 5 and 20 as balanced from stats a join stats b on b.level = a.level + 1",
    "hierarchy_path": f"with {_TREE} select node_id as start, 0 as step, node_id from l0 union all select node_id, 1, parent_id from l0 union all select l0.node_id, 2, l1.parent_id from l0 join l1 on l1.node_id = l0.parent_id union all select node_id, 3, 'L3:overview' from l0",
    "hierarchy_subtree": f"with {_TREE} select node_id as root, 0 as distance, 1 as n from l2 union all select parent_id, 1, count(*) from l1 group by 1 union all select l1.parent_id, 2, count(*) from l0 join l1 on l1.node_id = l0.parent_id group by 1",
    "search_substring": f"with {CHUNKS_SQL}, s as (select chunk_id, ((length(content) - length(replace(lower(content), 'the and', ''))) // 7) / cast(greatest({_words()}, 1) as double) as score from chunks where contains(lower(content), 'the and')) select chunk_id, round(score, 6) as score from s order by s.score desc, chunk_id limit 10",
    "search_level": f"with {_TREE}, s as (select node_id, content, {_score(_TEXT1, 'technical text of the error')} as score from l1) select node_id, round(score, 6) as score, md5({_HEAD.format(n=500)}) as content_hash from s where score > 0 order by s.score desc, node_id limit 10",
    "search_drilldown": f"""with {_TREE}, t as (select 2 as level, node_id, {_score("concat_ws(chr(10), title, summary, array_to_string(keywords, ', '))", 'module src3 structure')} as score from l2), u as (select * from t where score > 0 order by score desc, node_id limit 40), b as (select node_id from u order by score desc, node_id limit 3),
k as (select 1 as level, node_id, {_score(_TEXT1, 'module src3 structure')} * 0.8 as score, parent_id from l1 where parent_id in (select node_id from b)), d as (select *, row_number() over (partition by parent_id order by score desc, node_id) as place from k where score > 0),
a as (select * from u union all select level, node_id, score from d where place <= 2 and (select count(*) from u) < 40) select level, node_id, round(score, 6) as score from a order by a.score desc, node_id limit 40""",
    "search_budget": f"""with recursive {_TREE}, s as (select node_id, content, {_score(_TEXT0, 'text_block the')} as score from l0), r as (select node_id, {_HEAD.format(n=200)} as content, row_number() over (order by score desc, node_id) as k from s where score > 0), t as (select node_id, {_words()} as tokens, k from r where k <= 20),
f as (select 0 as k, cast(null as varchar) as node_id, cast(0 as bigint) as tokens, cast(200 as bigint) as rest, false as took union all select t.k, t.node_id, t.tokens, case when t.tokens <= f.rest then f.rest - t.tokens else f.rest end, t.tokens <= f.rest from f join t on t.k = f.k + 1)
select node_id, cast(tokens as integer) as tokens from f where took""",
    "search_relationship": f"""with {CHUNKS_SQL}, ent as (select * from (values (0, 'what'), (1, 'uses'), (2, 'thing')) v(entity, w)), f as (select entity, chunk_id, file_path, chunk_no, row_number() over (partition by entity order by chunk_id) as k from chunks join ent on contains(lower(content), w)),
p as (select entity, f.chunk_id, c.chunk_id as node_id, row_number() over (partition by entity, f.chunk_id order by c.chunk_id) as place from f join chunks c on c.file_path = f.file_path and c.chunk_no <> f.chunk_no and abs(c.chunk_no - f.chunk_no) <= 2 where k <= 2)
select entity, chunk_id, node_id, cast(0.8 as double) as score from p where place <= 3 order by entity, chunk_id, node_id limit 12""",
    "snapshot_diff": f"with {_AFTER} select file_path, change from diff where change is not null",
    "change_propagation": f"with {_AFTER}, c as (select regexp_extract(file_path, '^src/([^/]+)/', 1) as module, count(*) as changed from diff where change is not null group by 1), t as (select module, count(*) as files from after group by module) select module, changed, coalesce(files, 0) as files, round(changed / cast(files as double), 6) as share from c left join t using (module)",
    "snapshot_versions": f"with {_AFTER} select file_path, cast(case when change = 'modified' then 2 else 1 end as integer) as version, change is not null as is_dirty from diff where change is distinct from 'removed'",
    "validate_chunks": f"""with {FILES_SQL}, d as (select unnest([case when doc_id % 7 = 0 then 'missing id' end, case when doc_id % 11 = 0 or not regexp_matches(content, '[^ \\t\\n\\r\\f\\x0b]') then 'empty content' end, case when doc_id % 13 = 0 then 'line order' end, case when (doc_id % 17) / 10.0 > 1 then 'importance range' end]) as defect from files)
select defect, count(*) as n from d where defect is not null group by defect""",
}

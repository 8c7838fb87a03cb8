"""The summary hierarchy: chunk, file, module, repository; navigation and update.

A node is a row (level, node_id, parent_id, title, ...).  Children are found by
parent_id, never gathered: a module may hold a third of all files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkweave.functions import tags as G
from chunkweave.functions import text as T
from chunkweave.session import Scratch

KEYWORDS = {1: 10, 2: 15, 3: 20}


#: What several columns of a text are made of.
_COUNTS = {"words": T.word_count, "sentences": T.sentence_count, "low": F.lower}


def counted(chunks: DataFrame) -> DataFrame:
    """chunks with their content in lower case, its words, sentences and mean sentence, each made once."""
    c = F.col("content")
    return chunks.withColumns({k: f(c) for k, f in _COUNTS.items()}).withColumn("average", G.sentence_words(c, F.col("words")))


def leaves(chunks: DataFrame, most: int | None = None) -> DataFrame:
    """Level 0 from chunks (chunk_id, file_path, module, language, chunk_no, content); of the content `most` characters are kept, where that is given."""
    c, counts = F.col("content"), (F.col("words"), F.col("sentences"))
    quality = (T.readability(c, *counts) + T.completeness(c, *counts)) / 2
    return counted(chunks).select(
        F.lit(0).alias("level"), F.concat(F.lit("L0:"), "chunk_id").alias("node_id"), F.concat(F.lit("L1:"), T.file_stem(F.col("file_path"))).alias("parent_id"),
        F.concat(F.lit("text_block: "), "chunk_id").alias("title"), "file_path", "module", "language", "chunk_no", (c if most is None else F.substring(c, 1, most)).alias("content"), G.text_tags(c, F.col("average"), F.col("low")).alias("keywords"), quality.alias("quality"),
        F.sha2(c.cast("binary"), 256).alias("hash"),
    )


def measured(level0: DataFrame) -> DataFrame:
    """Level 0 with the sizes of its texts (content_size, and part_size in a file of several chunks) in place of the texts."""
    n = F.length("content")
    part = F.length("title") + 4 + F.when(n > 500, 503).otherwise(n)
    return level0.withColumns({"content_size": n, "part_size": part}).drop("content")


def _merge_keywords(level: int) -> Column:
    return F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set("keywords")))), 1, KEYWORDS[level])


def _merkle() -> Column:
    """Of all children, in any order: sums of their hashes' halves (no child list is gathered)."""
    half = lambda a: F.conv(F.substring("hash", a, 15), 16, 10).cast("decimal(38,0)")
    return F.sha2(F.concat_ws(":", F.sum(half(1)).cast("string"), F.sum(half(17)).cast("string"), F.count(F.lit(1)).cast("string")).cast("binary"), 256)


def files_level(level0: DataFrame) -> DataFrame:
    """Level 1: one chunk is promoted as it is, several are summarised; of `measured` leaves with content_size in place of content."""
    if "content" not in level0.columns:
        return _files(level0, (F.sum("part_size") + 2 * (F.count(F.lit(1)) - 1)).cast("int").alias("joined"), "content_size")
    head = F.when(F.length("content") > 500, F.concat(F.substring("content", 1, 500), F.lit("..."))).otherwise(F.col("content"))
    part = F.struct("chunk_no", F.concat(F.lit("## "), "title", F.lit("\n"), head).alias("text"))
    return _files(level0, F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), "\n\n").alias("joined"), "content")


def _files(level0: DataFrame, joined: Column, text: str) -> DataFrame:
    g = level0.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("members"), F.first("module").alias("module"), F.first("language").alias("language"), F.avg("quality").alias("quality"), _merge_keywords(1).alias("keywords"),
        joined, F.first(text).alias("only"), _merkle().alias("hash"),
    )
    name = T.file_name(F.col("file_path"))
    summary = F.concat(F.lit("File "), name, F.lit(" contains "), F.col("members").cast("string"), F.lit(" components: text_block. Primary functionality includes: "), F.array_join(F.slice("keywords", 1, 3), ", "), F.lit("."))
    return g.select(
        F.lit(1).alias("level"), F.concat(F.lit("L1:"), T.file_stem(F.col("file_path"))).alias("node_id"), F.concat(F.lit("L2:"), "module").alias("parent_id"), F.concat(F.lit("File: "), name).alias("title"),
        "file_path", "module", "language", "members", F.when(F.col("members") == 1, F.col("only")).otherwise(F.col("joined")).alias(text), F.when(F.col("members") > 1, summary).alias("summary"), "keywords", "quality", "hash",
    )


def modules_level(level1: DataFrame) -> DataFrame:
    """Level 2: by module; the language is that of the first file."""
    g = level1.groupBy("module").agg(F.count(F.lit(1)).alias("members"), F.min_by("language", "file_path").alias("language"), F.avg("quality").alias("quality"), _merge_keywords(2).alias("keywords"), _merkle().alias("hash"))
    summary = F.concat(F.lit("Module "), "module", F.lit(" consists of "), F.col("members").cast("string"), F.lit(" files. Core functionality: "), F.array_join(F.slice("keywords", 1, 5), ", "), F.lit("."))
    return g.select(
        F.lit(2).alias("level"), F.concat(F.lit("L2:"), "module").alias("node_id"), F.lit("L3:overview").alias("parent_id"), F.concat(F.lit("Module: "), "module").alias("title"), "module", "language", "members", summary.alias("summary"), "keywords", "quality", "hash"
    )


def repository_level(level2: DataFrame) -> DataFrame:
    """Level 3: one row; the language most modules have, the smallest on a tie."""
    votes = level2.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    top = votes.agg(F.min(F.struct((-F.col("n")).alias("n"), "language")).alias("top"))
    g = level2.agg(F.count(F.lit(1)).alias("members"), F.avg("quality").alias("quality"), _merge_keywords(3).alias("keywords"), _merkle().alias("hash")).filter("members > 0")
    summary = F.concat(F.lit("Repository contains "), F.col("members").cast("string"), F.lit(" modules in "), F.col("top.language"), F.lit(". Main domains: "), F.array_join(F.slice("keywords", 1, 7), ", "), F.lit("."))
    return g.join(top).select(
        F.lit(3).alias("level"), F.lit("L3:overview").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("Repository Overview").alias("title"), F.col("top.language").alias("language"), "members", summary.alias("summary"), "keywords", "quality", "hash"
    )


def architecture_layers(level2: DataFrame) -> DataFrame:
    """Layers that module names tell of."""
    low = F.lower("module")
    tests = (("presentation", "api|web|ui|controller|endpoint"), ("business", "service|business|logic|domain|core"), ("data", "data|db|database|repository|dao|model"))
    return level2.select(F.explode(F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(n)) for n, p in tests]))).alias("layer")).distinct()


def tree(chunks: DataFrame) -> DataFrame:
    """All levels with the columns they share; each is written once, and so is the whole. No text but titles and summaries is moved."""
    scratch = Scratch(chunks.sparkSession, "tree")
    l0 = scratch.save(measured(leaves(chunks)), "leaves")
    l1 = scratch.save(files_level(l0), "files")
    l2 = scratch.save(modules_level(l1), "modules")
    cols = ["level", "node_id", "parent_id", "title", "language", "keywords", "quality", "hash"]
    size = {0: F.col("content_size"), 1: F.col("content_size"), 2: F.lit(0), 3: F.lit(0)}
    out = None
    for k, d in enumerate((l0, l1, l2, repository_level(l2))):
        text = F.col("summary") if k else F.lit(None).cast("string")
        part = d.select(*cols, text.alias("summary"), size[k].alias("content_size"), (F.col("members") if k else F.lit(0)).cast("long").alias("members"))
        out = part if out is None else out.union(part)
    out = scratch.save(out, "all")
    scratch.drop("leaves")
    scratch.drop("files")
    scratch.drop("modules")
    return out


def paths_to_root(nodes: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """(start, step, node_id): each start and its ancestors."""
    link = nodes.select("node_id", "parent_id")
    now = starts.select(F.col("node_id").alias("start"), F.lit(0).alias("step"), "node_id")
    out = now
    for k in range(1, depth + 1):
        now = now.join(link, "node_id").filter("parent_id is not null").select("start", F.lit(k).alias("step"), F.col("parent_id").alias("node_id"))
        out = out.union(now)
    return out


def subtree(nodes: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, distance, node_id): everything below each root, down to a depth."""
    link = nodes.select(F.col("node_id").alias("child"), F.col("parent_id").alias("node_id"))
    now = roots.select(F.col("node_id").alias("root"), F.lit(0).alias("distance"), "node_id")
    out = now
    for k in range(1, depth + 1):
        now = now.join(link, "node_id").select("root", F.lit(k).alias("distance"), F.col("child").alias("node_id"))
        out = out.union(now)
    return out


def level_stats(nodes: DataFrame) -> DataFrame:
    """Per level: nodes, average quality, characters of content and of summaries."""
    return nodes.groupBy("level").agg(
        F.count(F.lit(1)).alias("nodes"), F.avg("quality").alias("quality"), F.sum("content_size").alias("content_size"), F.coalesce(F.sum(F.length("summary")), F.lit(0)).alias("summary_size")
    )


def balance(stats: DataFrame) -> DataFrame:
    """Nodes of a level per node of the one above, and whether that lies in 5 to 20."""
    up = stats.select((F.col("level") - 1).alias("level"), F.col("nodes").alias("above"))
    return stats.join(up, "level").select("level", (F.col("nodes") / F.col("above")).alias("ratio"), ((F.col("nodes") / F.col("above")).between(5, 20)).alias("balanced"))


def changed_nodes(before: DataFrame, after: DataFrame) -> DataFrame:
    """node_id, level, change (added, removed, modified) between two trees."""
    b, a = before.select("node_id", F.col("level").alias("lb"), F.col("hash").alias("hb")), after.select("node_id", F.col("level").alias("la"), F.col("hash").alias("ha"))
    j = b.join(a, "node_id", "full")
    change = F.when(F.col("hb").isNull(), "added").when(F.col("ha").isNull(), "removed").when(F.col("ha") != F.col("hb"), "modified")
    return j.select("node_id", F.coalesce("la", "lb").alias("level"), change.alias("change")).filter("change is not null")


def update_levels(before: DataFrame, chunks: DataFrame) -> DataFrame:
    """Level-1 nodes after a change: only files with a changed chunk are built anew.

    before: level-1 nodes of the old tree; chunks: all chunks now.  Where the nodes have content_size in place of content,
    so has the result.  What is used several times is written once.
    """
    scratch = Scratch(chunks.sparkSession, "update")
    before = scratch.save(before, "before")
    now = scratch.save(leaves(chunks) if "content" in before.columns else measured(leaves(chunks)), "leaves")
    digest = now.groupBy("file_path").agg(_merkle().alias("new_hash"))
    dirty = digest.join(before.select("file_path", "hash"), "file_path", "left").filter(~F.col("new_hash").eqNullSafe(F.col("hash"))).select("file_path")
    rebuilt = files_level(now.join(dirty, "file_path", "left_semi"))
    kept = before.join(digest.select("file_path"), "file_path", "left_semi").join(dirty, "file_path", "left_anti").select(rebuilt.columns)
    return kept.union(rebuilt)


def update_tree(before1: DataFrame, before2: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Levels 1 to 3 after a change, bottom up: only files with changed chunks, and modules with changed files, are built anew.

    before1, before2: the file and module nodes of the old tree; chunks: all now.
    """
    scratch = Scratch(chunks.sparkSession, "update")
    level1, before2 = scratch.save(update_levels(before1, chunks), "files"), scratch.save(before2, "modules")
    digest = level1.groupBy("module").agg(_merkle().alias("new_hash"))
    dirty = digest.join(before2.select("module", "hash"), "module", "left").filter(~F.col("new_hash").eqNullSafe(F.col("hash"))).select("module")
    rebuilt = modules_level(level1.join(dirty, "module", "left_semi"))
    kept = before2.join(digest.select("module"), "module", "left_semi").join(dirty, "module", "left_anti").select(rebuilt.columns)
    level2 = scratch.save(kept.union(rebuilt), "modules-now")
    return level1, level2, repository_level(level2)


def of_chunks(leaf_nodes: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """chunk_id, node_id: the leaf whose source chunks hold each chunk (node_id, source_chunk_ids)."""
    held = leaf_nodes.select("node_id", F.explode("source_chunk_ids").alias("chunk_id"))
    return chunk_ids.select("chunk_id").distinct().join(held, "chunk_id").groupBy("chunk_id").agg(F.min("node_id").alias("node_id"))


def context(nodes: DataFrame, starts: DataFrame, near: DataFrame, reach: DataFrame, most: int = 10) -> DataFrame:
    """node_id, path, related, n_direct, n_reached, importance: what surrounds each start.

    path: level, title, summary and five keywords of the node and its ancestors,
    upwards; related: its first neighbours within two steps (near: start, id,
    distance), `most` of them; reach: start, direct, transitive, rank.
    """
    from pyspark.sql import Window

    from chunkweave.functions.classify import importance_band

    about = nodes.select("node_id", F.struct("level", "title", "summary", F.slice("keywords", 1, 5).alias("keywords")).alias("about"))
    up = paths_to_root(nodes, starts).join(about, "node_id").groupBy("start").agg(F.array_sort(F.collect_list(F.struct("step", "about"))).alias("steps"))  # four rows a start
    first = near.withColumn("place", F.row_number().over(Window.partitionBy("start").orderBy("distance", "id"))).filter(F.col("place") <= most)
    related = first.groupBy("start").agg(F.array_sort(F.collect_list("id")).alias("related"))
    joined = up.join(related, "start", "left").join(reach.select("start", "direct", "transitive", "rank"), "start", "left")
    return joined.select(
        F.col("start").alias("node_id"), F.transform("steps", lambda s: s["about"]).alias("path"), F.coalesce("related", F.array().cast("array<string>")).alias("related"),
        F.coalesce("direct", F.lit(0)).alias("n_direct"), F.coalesce(F.col("direct") + F.col("transitive"), F.lit(0)).alias("n_reached"), importance_band(F.coalesce("rank", F.lit(0.0))).alias("importance"),
    )


def export_summary(nodes: DataFrame) -> DataFrame:
    """Per level: nodes, mean quality, and title, shortened summary and five keywords of its first node."""
    short = F.when(F.length("summary") > 200, F.concat(F.substring("summary", 1, 200), F.lit("..."))).otherwise(F.coalesce("summary", F.lit("")))
    sample = F.struct("title", short.alias("summary"), F.slice("keywords", 1, 5).alias("keywords"))
    return nodes.groupBy("level").agg(F.count(F.lit(1)).alias("nodes"), F.avg("quality").alias("quality"), F.min_by(sample, "node_id").alias("sample"))


def scalability(stats: DataFrame) -> DataFrame:
    """One row: the share of level ratios that lie in 5 to 20 (1 where there is one level)."""
    b = balance(stats)
    return b.agg(F.coalesce(F.avg(F.col("balanced").cast("double")), F.lit(1.0)).alias("scalability"))


def part_of_edges(nodes: DataFrame) -> DataFrame:
    """src, dst: each leaf and the node above it, as edges for the property graph."""
    return nodes.filter("level = 0 and parent_id is not null").select(F.col("node_id").alias("src"), F.col("parent_id").alias("dst"))


def common_keywords(nodes: DataFrame, limit: int = 10) -> DataFrame:
    """keyword, n: the most frequent keywords of nodes, the smaller first on a tie."""
    k = nodes.select(F.explode("keywords").alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))
    return k.orderBy(F.desc("n"), "keyword").limit(limit)

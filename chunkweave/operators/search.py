"""Keyword search over hierarchy levels, with drill-down and token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkweave.functions.text import NON_WS, occurrences, word_count


def words_of(query: str) -> list[str]:
    return query.lower().split()


def keyword_score(text: Column, query: str) -> Column:
    """Share of the query's words that the text contains; a query without words scores 0."""
    words = words_of(query)
    if not words:
        return F.lit(0.0)
    low = F.lower(text)
    return sum((low.contains(w).cast("int") for w in words), F.lit(0)) / len(words)


def substring_search(chunks: DataFrame, query: str, limit: int) -> DataFrame:
    """Chunks that contain the query, by occurrences per word of the chunk."""
    low = F.lower("content")
    score = occurrences(low, query.lower()) / F.greatest(word_count(F.col("content")), F.lit(1))
    found = chunks.filter(low.contains(query.lower())).withColumn("score", score)
    return found.orderBy(F.desc("score"), "chunk_id").limit(limit)


def level_search(nodes: DataFrame, query: str, limit: int, cap: int = 500) -> DataFrame:
    """node_id, parent_id, content, score of the best nodes of a level."""
    text = F.concat_ws("\n", "title", F.coalesce("summary", F.substring("content", 1, 500)), F.array_join("keywords", ", "))
    head = F.when(F.length("content") > cap, F.concat(F.substring("content", 1, cap), F.lit("..."))).otherwise(F.col("content"))
    found = nodes.withColumn("score", keyword_score(text, query)).filter("score > 0")
    return found.orderBy(F.desc("score"), "node_id").limit(limit).select("level", "node_id", "parent_id", head.alias("content"), "score")


def drill_down(above: DataFrame, below: DataFrame, query: str, limit: int) -> DataFrame:
    """Results of a level, and while there is room the two best children of the three best of them, at 0.8 of their score."""
    top = level_search(above, query, limit)
    best = top.orderBy(F.desc("score"), "node_id").limit(3).select(F.col("node_id").alias("parent_id"))
    text = F.concat_ws("\n", "title", F.coalesce("summary", F.substring("content", 1, 500)), F.array_join("keywords", ", "))
    kids = below.join(best, "parent_id", "left_semi").withColumn("score", keyword_score(text, query) * 0.8).filter("score > 0")
    w = Window.partitionBy("parent_id").orderBy(F.desc("score"), "node_id")
    head = F.when(F.length("content") > 300, F.concat(F.substring("content", 1, 300), F.lit("..."))).otherwise(F.col("content"))
    detail = kids.withColumn("place", F.row_number().over(w)).filter("place <= 2").select("level", "node_id", "parent_id", head.alias("content"), "score")
    short = top.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < limit)
    return top.union(detail.join(short).drop("n")).orderBy(F.desc("score"), "node_id").limit(limit)


def within_budget(results: DataFrame, budget: int) -> DataFrame:
    """The results taken in order of score while they fit what is left of a token budget; others are passed over.

    The input is a top-k result, so the fold's array is bounded by k.
    """
    item = F.struct((-F.col("score")).alias("rank"), "node_id", word_count(F.col("content")).alias("tokens"))
    ordered = results.agg(F.array_sort(F.collect_list(item)).alias("items"))
    state = "struct<left:int,out:array<struct<node_id:string,tokens:int>>>"
    start = F.struct(F.lit(budget).alias("left"), F.array().cast("array<struct<node_id:string,tokens:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fits = x["tokens"] <= acc["left"]
        took = F.struct(x["node_id"].alias("node_id"), x["tokens"].alias("tokens"))
        return F.struct(F.when(fits, acc["left"] - x["tokens"]).otherwise(acc["left"]).alias("left"), F.when(fits, F.array_append(acc["out"], took)).otherwise(acc["out"]).alias("out")).cast(state)

    return ordered.select(F.explode(F.aggregate("items", start, step, lambda acc: acc["out"])).alias("r")).select("r.node_id", "r.tokens")


def relationship_search(chunks: DataFrame, links: DataFrame, query: str, limit: int) -> DataFrame:
    """For up to three words of more than three letters, two matching chunks each and three neighbours of each, at 0.8.

    links: (chunk_id, near) pairs within two steps.
    """
    out = None
    for k, entity in enumerate([w for w in query.split() if len(w) > 3][:3]):
        found = chunks.filter(F.lower("content").contains(entity.lower())).orderBy("chunk_id").limit(2).select("chunk_id")
        w = Window.partitionBy("chunk_id").orderBy("near")
        near = links.join(F.broadcast(found), "chunk_id").withColumn("place", F.row_number().over(w)).filter("place <= 3")  # two rows are broadcast
        part = near.select(F.lit(k).alias("entity"), "chunk_id", F.col("near").alias("node_id"), F.lit(0.8).alias("score"))
        out = part if out is None else out.union(part)
    if out is None:
        return chunks.sparkSession.createDataFrame([], "entity int, chunk_id string, node_id string, score double")
    return out.orderBy("entity", "chunk_id", "node_id").limit(limit)


def hybrid_rank(candidates: DataFrame, limit: int) -> DataFrame:
    """Seven tenths of similarity and three of quality."""
    return candidates.withColumn("score", F.col("similarity") * 0.7 + F.col("quality") * 0.3).orderBy(F.desc("score"), "id").limit(limit)


def has_words(query: str) -> bool:
    import re

    return bool(re.search(NON_WS, query))


def kind_of(query: str) -> str:
    """The class of one question, on the driver."""
    from chunkweave.functions.classify import QUERY_GROUPS

    low = query.lower()
    return next((name for name, words in QUERY_GROUPS if any(w in low for w in words)), "general")


def general_search(levels: dict[int, DataFrame], query: str, limit: int, budget: int) -> DataFrame:
    """Files, then modules while the budget is over 500, then chunks while it is over 300: node_id, tokens."""
    out = None
    for level, most, least in ((1, max(limit // 2, 1), 0), (2, 3, 500), (0, 5, 300)):
        if budget <= least:
            continue
        took = within_budget(level_search(levels[level], query, most), budget).cache()  # a top-k result
        budget -= took.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
        out = took if out is None else out.union(took)
    return out if out is not None else levels[1].select("node_id", F.lit(0).alias("tokens")).limit(0)


def implementation_search(levels: dict[int, DataFrame], query: str, limit: int, budget: int, dedupe: bool = True) -> DataFrame:
    """Files by drill-down, and the three best chunks that fit the budget; without `dedupe` once per file hit, up to three times."""
    files = drill_down(levels[1], levels[0], query, max(limit // 2, 1)).select("node_id", "score")
    best = level_search(levels[0], query, 3)
    fits = best.join(within_budget(best, budget).select("node_id"), "node_id", "left_semi").select("node_id", "score")
    hits = 1 if dedupe else min(3, files.count())
    out = files
    for _ in range(hits):
        out = out.union(fits)
    out = out.distinct() if dedupe else out
    return out.orderBy(F.desc("score"), "node_id").limit(limit)


def intelligent_search(levels: dict[int, DataFrame], chunks: DataFrame, links: DataFrame, query: str, limit: int = 10, budget: int = 8000) -> tuple[str, DataFrame]:
    """The class of a question and its results, by the search that class calls for.

    levels: level -> nodes with content and summary (3 may be absent).
    """
    kind = kind_of(query)
    if kind == "relationship":
        return kind, relationship_search(chunks, links, query, limit)
    if kind == "architectural":
        found = drill_down(levels[2], levels[1], query, limit)
        return kind, level_search(levels[3], query, limit) if 3 in levels and found.isEmpty() else found
    if kind == "implementation":
        return kind, implementation_search(levels, query, limit, budget)
    return kind, general_search(levels, query, limit, budget)

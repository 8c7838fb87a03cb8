"""A property graph kept as two tables, built from chunks and updated with what changed.

nodes: id, fingerprint, file_path, start_line, end_line, quality, version, is_dirty
edges: src, dst, edge_type, graph_type, weight, context, edge_id
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkweave.functions import classify as C
from chunkweave.functions import properties as P
from chunkweave.operators import graph as J

EDGE_COLUMNS = ("src", "dst", "edge_type", "graph_type", "weight", "context", "edge_id")
NODE_COLUMNS = ("id", "fingerprint", "file_path", "start_line", "end_line", "quality", "version", "is_dirty")
#: Graphs whose edges are derived, and made anew when their ends change.
DERIVED = ("semantic_graph", "quality_graph")
IMPACT_GRAPHS = ("call_graph", "data_flow", "import_graph")


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def of(self, graph_type: str) -> DataFrame:
        """The edges of one graph, as (src, dst, weight)."""
        return self.edges.filter(F.col("graph_type") == graph_type).select("src", "dst", "weight")


def edges_of(pairs: DataFrame, edge_type: str | Column, graph_type: str | Column, weight: float | Column = 1.0, context: str = "") -> DataFrame:
    """Edge rows from (src, dst): the writer that every kind of edge uses."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    kind = lit(edge_type)
    return pairs.select("src", "dst", kind.alias("edge_type"), lit(graph_type).alias("graph_type"), lit(weight).cast("double").alias("weight"), F.lit(context).alias("context")).withColumn(
        "edge_id", F.concat(F.col("src").cast("string"), F.lit("->"), F.col("dst").cast("string"), F.lit(":"), F.col("edge_type"))
    )


def relationship_edges(relations: DataFrame) -> DataFrame:
    """Edges of stated relationships (src, dst, relationship, strength)."""
    return edges_of(relations, C.edge_type(F.col("relationship")), C.graph_type(F.col("relationship")), F.coalesce("strength", F.lit(1.0)), "relationship")


def containment_edges(chunks: DataFrame, span: int = 64) -> DataFrame:
    """Edges from each chunk to the chunks of its file that hold its lines.

    A chunk is listed under every `span` lines it covers, so two chunks meet only
    where they share a stretch of the file, not with all others of it.
    """
    held = chunks.select("file_path", F.col("id").alias("src"), F.col("start_line").alias("a"), F.col("end_line").alias("b"), F.floor(F.col("start_line") / span).alias("cell"))
    holds = chunks.select("file_path", F.col("id").alias("dst"), F.col("start_line").alias("x"), F.col("end_line").alias("y"), F.explode(F.sequence(F.floor(F.col("start_line") / span), F.floor(F.col("end_line") / span))).alias("cell"))
    return edges_of(held.join(holds, ["file_path", "cell"]).filter("x < a and y >= b"), "contains", "hierarchy_graph", 1.0, "file_containment")


def sibling_classes(chunks: DataFrame) -> DataFrame:
    """id, class_id, n_links: chunks of other files of the same directory, as classes instead of pairs."""
    own = chunks.select("id", "file_path", F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1).alias("directory"))
    per_file = own.groupBy("directory", "file_path").agg(F.count(F.lit(1)).alias("here"))
    per_dir = per_file.groupBy("directory").agg(F.sum("here").alias("all"), F.min("file_path").alias("class_id"))
    return own.join(per_file, ["directory", "file_path"]).join(per_dir, "directory").select("id", "class_id", (F.col("all") - F.col("here")).alias("n_links"))


def build(chunks: DataFrame, relations: DataFrame, derived: DataFrame | None = None) -> Graph:
    """The graph of chunks (id, fingerprint, file_path, start_line, end_line, quality) and their relationships.

    derived: edge rows of similarity, made by the caller.  Relationships to
    unknown chunks stay (an import of something outside).  Repeated ids: the row
    with the greatest fingerprint stands.
    """
    nodes = _one_each(chunks).withColumn("version", F.lit(1)).withColumn("is_dirty", F.lit(True)).select(*NODE_COLUMNS)
    edges = relationship_edges(relations).union(containment_edges(nodes))
    if derived is not None:
        edges = edges.union(derived.select(*EDGE_COLUMNS))
    return Graph(nodes, edges.dropDuplicates(["edge_id", "graph_type"]))


def _one_each(chunks: DataFrame) -> DataFrame:
    cols = [c for c in NODE_COLUMNS if c not in ("version", "is_dirty")]
    rest = [c for c in cols if c != "id"]
    return chunks.select(*cols).groupBy("id").agg(F.max(F.struct(*rest)).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in rest])


def changed_ids(graph: Graph, changed: DataFrame) -> DataFrame:
    """id of the changed chunks whose fingerprint differs from the graph's, or is new to it."""
    old = graph.nodes.select("id", F.col("fingerprint").alias("_old"), F.lit(True).alias("_known"))
    return changed.join(old, "id", "left").filter(F.col("_known").isNull() | ~F.col("fingerprint").eqNullSafe(F.col("_old"))).select("id").distinct()


def update(graph: Graph, changed: DataFrame, relations: DataFrame, derived: DataFrame | None = None) -> Graph:
    """The graph after chunks changed: equal fingerprints change nothing, others get one version more.

    A changed chunk loses all edges it is an end of and gets those of its new
    relationships; of the nodes that it reached or is, similarity edges go too
    and `derived` replaces them.
    """
    new = _one_each(changed)
    ids = changed_ids(graph, new)
    reach = affected(graph, ids)
    fresh = new.join(ids, "id", "left_semi").join(graph.nodes.select("id", F.col("version").alias("_v")), "id", "left")
    fresh = fresh.withColumn("version", F.coalesce(F.col("_v") + 1, F.lit(1))).withColumn("is_dirty", F.lit(True)).select(*NODE_COLUMNS)
    nodes = graph.nodes.join(ids, "id", "left_anti").select(*NODE_COLUMNS).union(fresh)
    stays = _without_ends(graph.edges, ids)
    stale = stays.filter(F.col("graph_type").isin(*DERIVED))
    kept = stays.filter(~F.col("graph_type").isin(*DERIVED)).union(_without_ends(stale, reach))
    own = relations.join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    inner = containment_edges(nodes.join(fresh.select("file_path").distinct(), "file_path", "left_semi"))
    edges = kept.select(*EDGE_COLUMNS).union(relationship_edges(own)).union(inner)
    if derived is not None:
        edges = edges.union(derived.select(*EDGE_COLUMNS))
    return Graph(nodes, edges.dropDuplicates(["edge_id", "graph_type"]))


def affected(graph: Graph, ids: DataFrame) -> DataFrame:
    """id of the given nodes and of what they reach in one step by calls, data flow or imports."""
    out = graph.edges.filter(F.col("graph_type").isin(*IMPACT_GRAPHS)).select(F.col("src").alias("id"), "dst")
    return ids.select("id").union(out.join(ids, "id", "left_semi").select(F.col("dst").alias("id"))).distinct()


def _without_ends(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti").select(*EDGE_COLUMNS)


def remove(graph: Graph, ids: DataFrame) -> Graph:
    """The graph without some nodes and every edge they are an end of; unknown ids change nothing."""
    gone = ids.select("id").distinct().join(graph.nodes.select("id"), "id", "left_semi")
    return Graph(graph.nodes.join(gone, "id", "left_anti"), _without_ends(graph.edges, gone))


def summary(graph: Graph) -> DataFrame:
    """edge_type, graph_type, n: what the build made."""
    return graph.edges.groupBy("edge_type", "graph_type").agg(F.count(F.lit(1)).alias("n"))


def quality_metrics(nodes: DataFrame) -> DataFrame:
    """One row: nodes, their mean quality, its population variance, the percentage over 0.8."""
    q = F.col("quality")
    return nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.avg(q).alias("average_quality"), F.var_pop(q).alias("quality_variance"), (F.avg((q > 0.8).cast("double")) * 100).alias("high_quality_percentage"))


def hotspots(nodes: DataFrame, ranks: DataFrame, below: float = 0.6, limit: int = 20) -> DataFrame:
    """The nodes of low quality with the most influence: rank / (quality + 0.1), best first."""
    low = nodes.filter(F.col("quality") < below).select("id", "quality").join(ranks.select("id", "rank"), "id", "left").fillna(0.0, ["rank"])
    return low.withColumn("score", F.col("rank") / (F.col("quality") + 0.1)).orderBy(F.desc("score"), "id").limit(limit)


def central(ranks: DataFrame, limit: int = 10) -> DataFrame:
    """The highest ranked nodes of each graph (graph_type, id, rank)."""
    w = Window.partitionBy("graph_type").orderBy(F.desc("rank"), "id")
    return ranks.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def duplicate_patterns(patterns: DataFrame, over: float = 0.8) -> DataFrame:
    """pattern, n, n_confident, potential: patterns with over two instances of which over one is confident (id, pattern, confidence)."""
    g = patterns.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("confidence") > over).cast("long")).alias("n_confident"))
    return g.filter("n > 2 and n_confident > 1").withColumn("potential", F.when(F.col("n_confident") > 3, "high").otherwise("medium"))


def change_impact(spark: SparkSession, graph: Graph, starts: DataFrame, ranks: DataFrame, hops: int = 3) -> DataFrame:
    """start, direct, transitive, quality_weight, rank_weight, severity, advice: what a change of each start reaches.

    By calls, data flow and imports; the weights are the sums of 1 - quality and
    of rank over everything reached.
    """
    e = graph.edges.filter(F.col("graph_type").isin(*IMPACT_GRAPHS)).select("src", "dst", "weight")
    reached = J.neighbours(spark, e, starts, hops, "out")
    known = reached.join(graph.nodes.select("id", "quality"), "id", "left").join(ranks.select("id", "rank"), "id", "left")
    g = known.groupBy("start").agg(
        F.sum((F.col("distance") == 1).cast("long")).alias("direct"), F.sum((F.col("distance") > 1).cast("long")).alias("transitive"),
        F.coalesce(F.sum(1 - F.col("quality")), F.lit(0.0)).alias("quality_weight"), F.coalesce(F.sum("rank"), F.lit(0.0)).alias("rank_weight"),
    )
    all_ = starts.select(F.col("id").alias("start")).join(g, "start", "left").fillna(0, ["direct", "transitive"]).fillna(0.0, ["quality_weight", "rank_weight"])
    severity = C.impact_severity(F.col("direct") + F.col("transitive"), F.col("rank_weight"))
    return all_.withColumn("severity", severity).withColumn("advice", P.impact_advice(F.col("severity"), F.col("direct"), F.col("transitive")))


def report(spark: SparkSession, graph: Graph, patterns: DataFrame | None = None) -> dict[str, DataFrame]:
    """The parts of the analysis of a graph, by name, each lazy."""
    calls = graph.of("call_graph")
    ranks = J.page_rank(spark, calls)
    fan = J.fan(graph.nodes, calls)
    parts = {
        "edges": summary(graph),
        "quality": quality_metrics(graph.nodes),
        "coupling": fan,
        "most_coupled": fan.orderBy(F.desc("coupling"), "id").limit(10),
        "hotspots": hotspots(graph.nodes, ranks),
        "central": central(ranks.withColumn("graph_type", F.lit("call_graph"))),
        "cycles": J.cycles(calls.union(graph.of("import_graph"))),
        "fan_out": fan.filter("fan_out > 10").select("id", "fan_out", F.when(F.col("fan_out") > 20, "high").otherwise("medium").alias("severity")),
    }
    return parts | ({"duplicates": duplicate_patterns(patterns)} if patterns is not None else {})


class Cache:
    """Results of an analysis, kept while the graph's version stays the same.

    What it keeps is persisted; a new version, or `clear`, lets go of it.
    """

    def __init__(self) -> None:
        self.version: object = None
        self.held: dict[str, DataFrame] = {}

    def get(self, version: object, name: str, make) -> DataFrame:
        if version != self.version:
            self.clear()
            self.version = version
        if name not in self.held:
            self.held[name] = make().persist()
        return self.held[name]

    def clear(self) -> None:
        for d in self.held.values():
            d.unpersist()
        self.held = {}

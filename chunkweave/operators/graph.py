"""Property-graph operators over an edge table (src, dst, weight).

Loops run a fixed or data-bound number of rounds over DataFrames; each round is
written to the shared folder, so lineage stays short and a lost executor costs
nothing.  Hot nodes are skewed join keys, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.session import Scratch


def simple(edges: DataFrame) -> DataFrame:
    """Parallel edges as one, weights summed."""
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def endpoints(edges: DataFrame) -> DataFrame:
    """Every node that an edge touches, once."""
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree, and both divided by their maximum (0 where it is 0)."""
    outgoing = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    incoming = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    d = nodes.select("id").join(outgoing, "id", "left").join(incoming, "id", "left").fillna(0, ["out_degree", "in_degree"])
    top = d.agg(F.max("in_degree").alias("top_in"), F.max("out_degree").alias("top_out"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return d.join(F.broadcast(top)).select("id", "in_degree", "out_degree", share("in_degree", "top_in").alias("in_share"), share("out_degree", "top_out").alias("out_share"))  # one row is broadcast


def fan(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, fan_in, fan_out, coupling: distinct neighbours but oneself."""
    other = edges.filter("src <> dst").select("src", "dst").distinct()
    outgoing = other.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("fan_out"))
    incoming = other.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    d = nodes.select("id").join(incoming, "id", "left").join(outgoing, "id", "left").fillna(0, ["fan_in", "fan_out"])
    return d.withColumn("coupling", F.col("fan_in") + F.col("fan_out"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(endpoints(edges), "id", "left_anti").select("id")


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """(src, dst) followed along `out`, against `in`, or `both`."""
    out, back = edges.select("src", "dst"), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {"out": out, "in": back, "both": out.union(back)}[direction].distinct()


def neighbours(spark: SparkSession, edges: DataFrame, starts: DataFrame, hops: int, direction: str = "out") -> DataFrame:
    """(start, id, distance): what each start reaches in 1 to `hops` steps, without itself."""
    scratch = Scratch(spark, "neighbours")
    step = scratch.save(directed(edges, direction), "steps")
    seen = starts.select(F.col("id").alias("start"), F.col("id"), F.lit(0).alias("distance"))
    front = seen
    for k in range(1, hops + 1):
        reached = front.join(step, front["id"] == step["src"]).select("start", F.col("dst").alias("id")).distinct()
        front = scratch.save(reached.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("distance", F.lit(k)), f"hop-{k}")
        seen = seen.union(front)
    return seen.filter("distance > 0")


def reachable(spark: SparkSession, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """id of the starts and of everything that edges lead to from them, however far.

    With edges turned around (src the dependency, dst what depends on it) this
    is what becomes stale when the starts change.
    """
    scratch = Scratch(spark, "reach")
    step = scratch.save(directed(edges, "out"), "steps")
    front = scratch.save(starts.select("id").distinct(), "hop-0")
    seen, k = front, 0
    while not front.isEmpty():
        k += 1
        met = front.select(F.col("id").alias("src")).join(step, "src").select(F.col("dst").alias("id")).distinct()
        front = scratch.save(met.join(seen, "id", "left_anti"), f"hop-{k}")
        seen = seen.union(front)
    return seen


def shortest_path(spark: SparkSession, edges: DataFrame, source: object, target: object, most: int | None = None) -> DataFrame:
    """step, id: nodes of one shortest directed path (the smallest predecessor at each step); empty if there is none.

    Goes on until the target is met or nothing new is; `most` steps where that is given.
    """
    scratch = Scratch(spark, "path")
    step = scratch.save(directed(edges, "out"), "steps")
    empty = spark.createDataFrame([], "step int, id string")
    seen = scratch.save(spark.createDataFrame([(source, None, 0)], "id string, parent string, step int"), "hop-0")
    front, found, k = seen, source == target, 0
    while not found and (most is None or k < most):
        k += 1
        reached = front.select(F.col("id").alias("src")).join(step, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        front = scratch.save(reached.join(seen.select("id"), "id", "left_anti").withColumn("step", F.lit(k)).select("id", "parent", "step"), f"hop-{k}")
        if front.isEmpty():
            return empty
        seen = seen.union(front)
        found = not front.filter(F.col("id") == target).isEmpty()
    if not found:
        return empty
    rows, at = [], target
    while at is not None:  # one row per step of the path
        r = seen.filter(F.col("id") == at).first()
        rows.append((r["step"], r["id"]))
        at = r["parent"]
    return spark.createDataFrame(sorted(rows), "step int, id string")


def page_rank(spark: SparkSession, edges: DataFrame, rounds: int = 100, damping: float = 0.85, nodes: DataFrame | None = None, tolerance: float | None = 1e-6) -> DataFrame:
    """id, rank; weights of parallel edges add up, dangling mass is spread evenly.

    Ends when the ranks of a round differ from those before by less than
    tolerance * nodes in total, or after `rounds`; without a tolerance after
    exactly as many.
    """
    scratch = Scratch(spark, "rank")
    e = simple(edges)
    out = e.groupBy("src").agg(F.sum("weight").alias("total"))
    share = scratch.save(e.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "shares")
    ids = scratch.save(nodes.select("id").distinct() if nodes is not None else endpoints(edges), "nodes")
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(0.0).alias("rank"))
    dangling = scratch.save(ids.join(share.select(F.col("src").alias("id")).distinct(), "id", "left_anti"), "dangling")
    now = scratch.save(ids.withColumn("rank", F.lit(1.0 / n)), "round-0")
    for k in range(1, rounds + 1):
        lost = now.join(dangling, "id", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        sent = now.join(share, now["id"] == share["src"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("sent"))
        got = now.withColumnRenamed("rank", "was").join(sent, "id", "left").join(F.broadcast(lost))  # one row is broadcast
        after = scratch.save(got.select("id", (F.lit((1 - damping) / n) + damping * (F.coalesce("sent", F.lit(0.0)) + F.col("lost") / n)).alias("rank"), "was"), f"round-{k}")
        scratch.drop(f"round-{k - 1}")
        now = after.select("id", "rank")
        if tolerance is not None and after.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] < tolerance * n:
            break
    return now


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """id, component: weak components, named by their smallest id.

    Each round, every node takes the smallest of its neighbours, chains of
    these are followed to their ends, and the ends are the nodes of the next
    round's graph.  A node that nobody takes takes another at the latest in the
    next round, so nodes at least halve in two; the edges are mapped, without loops.
    """
    scratch = Scratch(spark, "components")
    now = scratch.save(edges.filter("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct(), "edges-0")
    home = scratch.save(endpoints(edges).select("id", F.col("id").alias("component")), "home-0")
    k = 0
    while not now.isEmpty():
        k += 1
        low = now.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("up"))  # a node's smaller neighbours; without any it is an end
        up, j, tall = scratch.save(low, f"up-{k}"), 0, True
        while tall:  # twice as far each time
            j += 1
            further = up.select(F.col("id").alias("up"), F.col("up").alias("far"))
            step = scratch.save(up.join(further, "up", "left").select("id", F.coalesce("far", "up").alias("up"), F.col("far").isNotNull().alias("moved")), f"up-{k}-{j}")
            tall = not step.filter("moved").isEmpty()
            up = step.select("id", "up")
        to = lambda c: up.select(F.col("id").alias(c), F.col("up").alias(f"{c}_up"))
        moved = now.join(to("u"), "u", "left").select("v", F.coalesce("u_up", "u").alias("u")).join(to("v"), "v").select("u", F.col("v_up").alias("v")).filter("u <> v")
        after = scratch.save(moved.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"edges-{k}")
        home = scratch.save(home.join(to("component"), "component", "left").select("id", F.coalesce("component_up", "component").alias("component")), f"home-{k}")
        for old in (f"edges-{k - 1}", f"home-{k - 1}", f"up-{k}", *(f"up-{k}-{i}" for i in range(1, j + 1))):
            scratch.drop(old)
        now = after
    return home


def label_propagation(spark: SparkSession, edges: DataFrame, rounds: int = 5) -> DataFrame:
    """id, label: each node takes its neighbours' most frequent label, the smallest on a tie."""
    scratch = Scratch(spark, "labels")
    step = scratch.save(directed(edges.filter("src <> dst"), "both"), "steps")
    now = endpoints(edges).withColumn("label", F.col("id"))
    for k in range(rounds):
        votes = step.join(now, step["dst"] == now["id"]).groupBy(step["src"].alias("id"), "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("best"))
        now = scratch.save(now.select("id", F.col("label").alias("own")).join(best, "id", "left").select("id", F.coalesce("best.label", "own").alias("label")), f"round-{k}")
    return now


def _ranked(edges: DataFrame) -> DataFrame:
    """src, dst, rs, rd: simple edges with the rank of both ends, by degree and then id."""
    e = edges.filter("src <> dst").select("src", "dst").distinct()
    ends = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id")))
    rank = ends.groupBy("id").agg(F.count(F.lit(1)).alias("n")).select("id", F.struct("n", "id").alias("r"))
    led = e.join(rank.select(F.col("id").alias("src"), F.col("r").alias("rs")), "src")
    return led.join(rank.select(F.col("id").alias("dst"), F.col("r").alias("rd")), "dst").select("src", "dst", "rs", "rd")


def _named(paths: DataFrame) -> DataFrame:
    """cycle, length, severity of closed paths: turned so that the smallest node comes first."""
    low = F.array_position("path", F.array_min("path")).cast("int")
    turned = F.concat(F.slice("path", low, F.size("path")), F.slice("path", F.lit(1), low - 1))
    return paths.select(F.array_join(turned, ">").alias("cycle"), F.size("path").alias("length")).withColumn("severity", F.when(F.col("length") <= 3, "high").otherwise("medium"))


def short_cycles(edges: DataFrame) -> DataFrame:
    """cycle, length, severity: directed cycles of two and three nodes, each once (its smallest node first).

    A cycle is found from its node of least degree, so a hub's neighbours are
    never paired with each other.
    """
    return cycles(edges, 3)


def cycles(edges: DataFrame, longest: int = 5) -> DataFrame:
    """cycle, length, severity: simple directed cycles of two to `longest` nodes, each once (its smallest node first).

    Cycles of up to three are of high severity, longer ones of medium.  Paths
    grow from the node of least degree of their cycle.  How many there are can
    grow exponentially with the length, which is why it is bounded.
    """
    e = _ranked(edges)
    up = e.filter("rs < rd")
    back = e.filter("rd < rs").select(F.col("src").alias("last"), F.col("dst").alias("start"))  # edges that close
    now = up.select(F.col("src").alias("start"), F.col("rs").alias("low"), F.array("src", "dst").alias("path"), F.col("dst").alias("last"))
    step = e.select(F.col("src").alias("last"), F.col("dst").alias("next"), F.col("rd").alias("rank"))
    found = None
    for k in range(2, longest + 1):
        part = _named(now.join(back, ["last", "start"]))
        found = part if found is None else found.union(part)
        if k < longest:
            grown = now.join(step, "last").filter("rank > low and not array_contains(path, next)")
            now = grown.select("start", "low", F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("last"))
            if k == longest - 1:  # the last step only asks for what closes
                now = now.join(back, ["last", "start"], "left_semi")
    return found


def clustering(edges: DataFrame) -> DataFrame:
    """id, degree, triangles, coefficient on the simple undirected projection.

    Arcs lead from the node of lower degree to the other, so no node has more
    than about the root of twice the edges.  A triangle is a path of two arcs whose ends are
    an arc: paths are made from the arcs whose target has arcs itself, so what
    has none in common costs nothing.
    """
    scratch = Scratch(edges.sparkSession, "clustering")
    e = scratch.save(edges.filter("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct(), "edges")
    ends = e.select(F.col("u").alias("id")).union(e.select(F.col("v").alias("id")))
    degree = scratch.save(ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    rank = lambda c: degree.select(F.col("id").alias(c), F.struct("degree", "id").alias(f"r{c}"))
    led = e.join(rank("u"), "u").join(rank("v"), "v")
    up = F.col("ru") < F.col("rv")
    arcs = scratch.save(led.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("b")), "arcs")
    begun, ended = arcs.select(F.col("a").alias("b")).distinct(), arcs.select(F.col("b").alias("a")).distinct()
    first = scratch.save(arcs.join(begun, "b", "left_semi").select("a", "b"), "first")  # arcs that go on
    second = arcs.join(ended, "a", "left_semi").select(F.col("a").alias("b"), F.col("b").alias("c"))
    path = first.join(second, "b")
    closed = path.join(arcs.join(first.select("a").distinct(), "a", "left_semi").select("a", F.col("b").alias("c")), ["a", "c"]).select(F.explode(F.array("a", "b", "c")).alias("id"))
    tri = closed.groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))
    d = degree.join(tri, "id", "left").fillna(0, ["triangles"])
    k = F.col("degree")
    return d.withColumn("coefficient", F.when(k > 1, 2.0 * F.col("triangles") / (k * (k - 1))).otherwise(0.0))


def gated(edges: DataFrame, measure: Callable[[list, list], dict], name: str, most: int = 1000) -> DataFrame:
    """id, <name>: a measure of small graphs, computed in one task; no rows from `most` nodes on.

    This is the feature as it is defined (it is left out on larger graphs), so
    what the task gathers is bounded: the gate is applied before the gathering.
    """
    import pandas as pd

    size = endpoints(edges).agg(F.count(F.lit(1)).alias("nodes"))
    small = simple(edges).join(F.broadcast(size)).filter(F.col("nodes") < most).drop("nodes")  # one row is broadcast
    kind = dict(edges.dtypes)["src"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted({*pdf["src"], *pdf["dst"]})
        found = measure(ids, list(zip(pdf["src"], pdf["dst"], pdf["weight"])))
        return pd.DataFrame({"id": ids, name: [float(found[i]) for i in ids]})

    return small.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, f"id {kind}, {name} double")


def betweenness(ids: list, edges: list) -> dict:
    """Brandes' accumulation over unweighted shortest paths, normalised."""
    out: dict = {i: [] for i in ids}
    for a, b, _ in edges:
        if a != b:
            out[a].append(b)
    score = dict.fromkeys(ids, 0.0)
    for s in ids:
        order, before, paths, far = [], {i: [] for i in ids}, dict.fromkeys(ids, 0), {s: 0}
        paths[s], queue = 1, [s]
        for v in queue:
            order.append(v)
            for w in out[v]:
                if w not in far:
                    far[w] = far[v] + 1
                    queue.append(w)
                if far[w] == far[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = dict.fromkeys(ids, 0.0)
        for w in reversed(order):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                score[w] += share[w]
    n = len(ids)
    return {i: v / ((n - 1) * (n - 2)) if n > 2 else 0.0 for i, v in score.items()}


def closeness(ids: list, edges: list) -> dict:
    """Of incoming distances, scaled by the share of nodes that reach the node."""
    back: dict = {i: [] for i in ids}
    for a, b, _ in edges:
        back[b].append(a)
    out = {}
    for s in ids:
        far, queue = {s: 0}, [s]
        for v in queue:
            for w in back[v]:
                if w not in far:
                    far[w] = far[v] + 1
                    queue.append(w)
        total, n = sum(far.values()), len(far) - 1
        out[s] = (n / total) * (n / (len(ids) - 1)) if total and len(ids) > 1 else 0.0
    return out


def eigenvector(ids: list, edges: list, rounds: int = 100) -> dict:
    """Power iteration on in-edges by weight."""
    x = dict.fromkeys(ids, 1.0 / max(len(ids), 1))
    for _ in range(rounds):
        y = dict(x)
        for a, b, w in edges:
            y[b] += x[a] * w
        norm = sum(v * v for v in y.values()) ** 0.5 or 1.0
        x = {i: v / norm for i, v in y.items()}
    return x


def eccentricity(ids: list, edges: list) -> dict:
    """The greatest distance from each node, edges taken both ways; infinite where some node isn't reached."""
    near: dict = {i: set() for i in ids}
    for a, b, _ in edges:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for s in ids:
        far, queue = {s: 0}, [s]
        for v in queue:
            for w in near[v]:
                if w not in far:
                    far[w] = far[v] + 1
                    queue.append(w)
        out[s] = float(max(far.values())) if len(far) == len(ids) else float("inf")
    return out


def diameter(edges: DataFrame, most: int = 1000) -> DataFrame:
    """One row: the diameter of a small connected graph; null if it isn't connected or has `most` nodes or more."""
    far = gated(edges, eccentricity, "far", most).agg(F.max("far").alias("far"))
    return far.select(F.when(F.col("far") < float("inf"), F.col("far").cast("int")).alias("diameter"))


def _undirected(ids: list, edges: list) -> list[dict]:
    """Neighbours with their weights, by the node's place in ids; loops and directions are left out."""
    at = {i: k for k, i in enumerate(ids)}
    near: list[dict] = [{} for _ in ids]
    for a, b, w in edges:
        if a != b:
            x, y = at[a], at[b]
            near[x][y] = near[x].get(y, 0.0) + w
            near[y][x] = near[y].get(x, 0.0) + w
    return near


def louvain(ids: list, edges: list) -> dict:
    """Communities by local moves and aggregation while modularity grows; named by their order of first node."""
    near = _undirected(ids, edges)
    loops = [0.0] * len(ids)
    member = list(range(len(ids)))  # of the first graph's nodes, in the current graph
    total = sum(map(lambda d: sum(d.values()), near)) or 1.0
    while True:
        degree = [sum(d.values()) + loops[k] for k, d in enumerate(near)]
        home, weight, moved_any = list(range(len(near))), list(degree), False
        while True:
            moved = False
            for k, d in enumerate(near):
                to: dict[int, float] = {}
                for j, w in d.items():
                    to[home[j]] = to.get(home[j], 0.0) + w
                own = home[k]
                weight[own] -= degree[k]
                best, gain = own, to.get(own, 0.0) - weight[own] * degree[k] / total
                for c in sorted(to):
                    g = to[c] - weight[c] * degree[k] / total
                    if g > gain + 1e-12:
                        best, gain = c, g
                weight[best] += degree[k]
                home[k] = best
                moved |= best != own
            if not moved:
                break
            moved_any = True
        if not moved_any:
            break
        names = {c: n for n, c in enumerate(dict.fromkeys(home))}
        home = [names[c] for c in home]
        merged: list[dict] = [{} for _ in names]
        inside = [0.0] * len(names)
        for k, d in enumerate(near):
            inside[home[k]] += loops[k]
            for j, w in d.items():
                if home[j] == home[k]:
                    inside[home[k]] += w
                else:
                    merged[home[k]][home[j]] = merged[home[k]].get(home[j], 0.0) + w
        near, loops = merged, inside
        member = [home[m] for m in member]
    order = {c: n for n, c in enumerate(dict.fromkeys(member))}
    return {i: order[m] for i, m in zip(ids, member)}


def greedy_modularity(ids: list, edges: list) -> dict:
    """Communities by merging, again and again, the pair that raises modularity most; named by their order of first node."""
    near = _undirected(ids, edges)
    total = sum(sum(d.values()) for d in near) or 1.0
    share = {k: sum(d.values()) / total for k, d in enumerate(near)}
    between = {k: {j: w / total for j, w in d.items()} for k, d in enumerate(near)}
    member = {k: k for k in share}
    while True:
        best = max(((2 * (w - share[a] * share[b]), -a, -b) for a, d in between.items() for b, w in d.items() if a < b), default=None)
        if best is None or best[0] <= 1e-12:
            break
        a, b = -best[1], -best[2]
        for j, w in between.pop(b).items():
            between[j].pop(b)
            if j != a:
                between[a][j] = between[j][a] = between[a].get(j, 0.0) + w
        share[a] += share.pop(b)
        member = {k: a if m == b else m for k, m in member.items()}
    order = {c: n for n, c in enumerate(dict.fromkeys(member[k] for k in range(len(ids))))}
    return {i: order[member[k]] for k, i in enumerate(ids)}


#: Nodes from which Louvain's and greedy communities are left out.
GATE = 10_000


def communities(spark: SparkSession, edges: DataFrame, algorithm: str = "louvain", most: int = GATE) -> DataFrame:
    """id, community: by `louvain`, `greedy_modularity` (both in one task, no rows from `most` nodes on) or `label_propagation`."""
    if algorithm == "label_propagation":
        return label_propagation(spark, edges).withColumnRenamed("label", "community")
    measure = {"louvain": louvain, "greedy_modularity": greedy_modularity}[algorithm]
    return gated(edges, measure, "community", most).withColumn("community", F.col("community").cast("long"))


def centralities(spark: SparkSession, edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """id, measure, value: degrees, rank, and on small graphs betweenness, closeness and eigenvector centrality."""
    own = nodes if nodes is not None else endpoints(edges)
    d = degrees(own, edges)
    long = lambda df, c: df.select("id", F.lit(c).alias("measure"), F.col(c).cast("double").alias("value"))
    out = long(d, "in_share").union(long(d, "out_share")).union(long(page_rank(spark, edges), "rank"))
    for name, f, most in (("betweenness", betweenness, 1000), ("closeness", closeness, 500), ("eigenvector", eigenvector, 1000)):
        out = out.union(long(gated(edges, f, name, most), name))
    return out


def metrics(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, components, average clustering."""
    edges = Scratch(spark, "metrics").save(edges, "edges")  # read by all that follows
    n = nodes.agg(F.countDistinct("id").alias("n_nodes"))
    e = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    c = components(spark, edges).agg(F.countDistinct("component").alias("parts"), F.count(F.lit(1)).alias("touched"))
    k = clustering(edges).agg(F.coalesce(F.sum("coefficient"), F.lit(0.0)).alias("sum_coefficient"))
    one = n.join(e).join(c).join(k)  # one row each
    return one.select(
        "n_nodes", "n_edges",
        F.when(F.col("n_nodes") > 1, F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(0.0).alias("density"),
        (F.col("parts") + F.col("n_nodes") - F.col("touched")).alias("n_components"),
        F.when(F.col("n_nodes") > 0, F.col("sum_coefficient") / F.col("n_nodes")).otherwise(0.0).alias("average_clustering"),
    )

"""Graph builder, chunkers under hard input, registry and catalogue."""

import itertools
import random
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from chunkweave import catalogue, cli, session
from chunkweave.functions import properties as P
from chunkweave.operators import builder as B
from chunkweave.operators import graph as J
from chunkweave.operators.chunkers import base, code, engine, markup, xmltext
from chunkweave.registry import Registry
from chunkweave.sources import files as S

CHUNKS = "id string, fingerprint string, file_path string, start_line int, end_line int, quality double"
RELATIONS = "src string, dst string, relationship string, strength double"


def small(spark, extra=()):
    rows = [("a", "1", "f/x", 1, 50, 0.9), ("b", "2", "f/x", 3, 9, 0.5), ("c", "3", "f/x", 3, 9, 0.2), ("d", "4", "f/y", 1, 200, 0.1), *extra]
    rel = [("a", "d", "calls", 1.0), ("b", "a", "imports", 1.0), ("d", "b", "similar_to", 0.8), ("c", "zz", "uses", None)]
    return B.build(spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(rel, RELATIONS))


def ids(df):
    return sorted(r["edge_id"] for r in df.collect())


def test_build_update_and_remove(spark):
    g = small(spark, [("a", "0", "old", 7, 8, 0.0)])  # a repeated id: the greatest fingerprint stands
    assert {r["id"]: r["file_path"] for r in g.nodes.collect()} == {"a": "f/x", "b": "f/x", "c": "f/x", "d": "f/y"}
    assert ids(g.edges) == ["a->d:calls", "b->a:contains", "b->a:imports", "c->a:contains", "c->zz:uses", "d->b:similar_to"]
    same = B.update(g, spark.createDataFrame([("a", "1", "f/x", 1, 50, 0.9)], CHUNKS), spark.createDataFrame([("a", "c", "calls", 1.0)], RELATIONS))
    assert ids(same.edges) == ids(g.edges) and {r["version"] for r in same.nodes.collect()} == {1}
    new = B.update(g, spark.createDataFrame([("a", "9", "f/x", 4, 50, 0.9), ("e", "5", "f/y", 5, 6, 0.3)], CHUNKS), spark.createDataFrame([("a", "e", "calls", 1.0)], RELATIONS))
    assert {r["id"]: r["version"] for r in new.nodes.collect()} == {"a": 2, "b": 1, "c": 1, "d": 1, "e": 1}
    assert ids(new.edges) == ["a->e:calls", "c->zz:uses", "e->d:contains"]  # d was reached from a: its similarity edge went
    left = B.remove(g, spark.createDataFrame([("a",), ("nobody",)], "id string"))
    assert sorted(r["id"] for r in left.nodes.collect()) == ["b", "c", "d"] and ids(left.edges) == ["c->zz:uses", "d->b:similar_to"]
    empty = B.build(spark.createDataFrame([], CHUNKS), spark.createDataFrame([], RELATIONS))
    assert empty.nodes.count() == 0 and empty.edges.count() == 0


def test_containment_equals_all_pairs(spark):
    rng = random.Random(1)
    rows = [(f"c{k}", "x", f"f{k % 3}", a := rng.randint(1, 300), a + rng.choice([0, 3, 70, 500]), 0.5) for k in range(120)]
    got = {(r["src"], r["dst"]) for r in B.containment_edges(spark.createDataFrame(rows, CHUNKS)).collect()}
    want = {(x[0], y[0]) for x in rows for y in rows if x[2] == y[2] and y[3] < x[3] and y[4] >= x[4]}
    assert got == want and len(want) > 100
    siblings = {r["id"]: r["n_links"] for r in B.sibling_classes(spark.createDataFrame([(r[0], "x", f"d/{r[2]}", 1, 1, 0.0) for r in rows], CHUNKS)).collect()}
    assert all(n == sum(y[2] != x[2] for y in rows) for x in rows for n in [siblings[x[0]]])


def test_report_and_cache(spark):
    parts = B.report(spark, small(spark))
    assert {r["edge_type"]: r["n"] for r in parts["edges"].collect()}["contains"] == 2
    assert [r["id"] for r in parts["hotspots"].collect()][0] == "d"
    assert parts["cycles"].count() == 0 and parts["quality"].first()["n_nodes"] == 4
    cache, made = B.Cache(), []
    make = lambda: made.append(1) or spark.range(3)
    assert cache.get(1, "x", make).count() == cache.get(1, "x", make).count() == 3 and len(made) == 1
    cache.get(2, "x", make)
    assert len(made) == 2 and list(cache.held) == ["x"]
    cache.clear()


def test_cycles_equal_brute_force(spark):
    rng = random.Random(4)
    pairs = {(f"n{rng.randint(0, 8)}", f"n{rng.randint(0, 8)}") for _ in range(26)}
    have = {(a, b) for a, b in pairs if a != b}
    want = set()
    for k in range(2, 6):
        for path in itertools.permutations(sorted({x for p in have for x in p}), k):
            if path[0] == min(path) and all((path[i], path[(i + 1) % k]) in have for i in range(k)):
                want.add((">".join(path), k, "high" if k <= 3 else "medium"))
    got = J.cycles(spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double"), 5).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want


def modularity(member, edges):
    total = sum(w for *_, w in edges) * 2
    degree = {}
    for a, b, w in edges:
        degree[a], degree[b] = degree.get(a, 0) + w, degree.get(b, 0) + w
    inner = sum(2 * w for a, b, w in edges if member[a] == member[b]) / total
    sums = {}
    for i, d in degree.items():
        sums[member[i]] = sums.get(member[i], 0) + d
    return inner - sum((s / total) ** 2 for s in sums.values())


def test_communities(spark):
    rng = random.Random(2)
    edges = [(a, b, 1.0) for a in range(30) for b in range(a) if rng.random() < (0.6 if a % 3 == b % 3 else 0.04)]
    planted = modularity({i: i % 3 for i in range(30)}, edges)
    for f in (J.louvain, J.greedy_modularity):
        assert modularity(f(list(range(30)), edges), edges) > 0.95 * planted
    assert J.louvain([1, 2], [(1, 1, 1.0)]) == {1: 0, 2: 1}
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    for name in ("louvain", "greedy_modularity", "label_propagation"):
        assert J.communities(spark, df, name).count() == 30
    assert J.diameter(df).first()["diameter"] >= 2
    assert J.diameter(spark.createDataFrame([(1, 2, 1.0), (3, 4, 1.0)], "src long, dst long, weight double")).first()["diameter"] is None
    assert J.centralities(spark, df).groupBy("measure").count().count() == 6


def test_long_paths_and_rank_to_tolerance(spark):
    chain = spark.createDataFrame([(f"{k:03d}", f"{k + 1:03d}", 1.0) for k in range(24)], "src string, dst string, weight double")
    assert J.shortest_path(spark, chain, "000", "024").count() == 25
    assert J.shortest_path(spark, chain, "024", "000").count() == 0
    assert J.shortest_path(spark, chain, "000", "024", most=5).count() == 0
    ring = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0)], "src string, dst string, weight double")
    assert {round(r["rank"], 6) for r in J.page_rank(spark, ring).collect()} == {round(1 / 3, 6)}


# --- chunkers -----------------------------------------------------------------------------


HARD = [("json", "[" * 100_000), ("xml", "<a>" * 20_000 + "</a>" * 20_000), ("python", "x = " + "-" * 50_000 + "1"), ("css", "{" * 20_000), ("javascript", "`" * 20_001), ("rust", "/*" * 20_000), ("html", "<div>" * 10_000), ("latex", "\\begin{x}" * 10_000), ("markdown", "#" * 20_000)]


def test_no_file_ends_the_job(spark):
    rows = [(f"f{k}.x", lang, text) for k, (lang, text) in enumerate(HARD)] + [("good.py", None, "def f():\n    return 'a value long enough for the chunk to be kept'\n" * 5), ("odd.zz", "klingon", "some words of text that nobody can parse at all " * 3), ("none.py", None, None)]
    files = spark.createDataFrame(rows, "file_path string, language string, content string")
    out = engine.chunk_files(files)
    errors = {r["file_path"]: (r["error_class"], r["error"]) for r in engine.chunk_errors(out).collect()}
    assert errors["f0.x"][0] == "ParserFailure" and errors["odd.zz"][0] == "UnsupportedLanguage" and "good.py" not in errors and "none.py" not in errors
    found = {r["file_path"] for r in engine.without_errors(out).select("file_path").distinct().collect()}
    assert {"good.py", "odd.zz", "f0.x"} <= found
    s = engine.processing_stats(out).first()
    assert s["failed"] == len(errors) and s["files"] >= len(errors) + 1 and s["chunk_types"]["function"] == 5
    assert engine.chunk_errors(engine.chunk_files(files, errors=False)).count() == 0
    with pytest.raises(engine.UnsupportedLanguage):
        engine.chunk_text("x", "klingon")


@pytest.mark.parametrize("lang,unit", [("html", "<p>some text in a paragraph of the page</p></div>\n"), ("xml", "<a b='1'>text of the element\n"), ("latex", "\\begin{x} text\n$$a$$\n"), ("text", "a.b-c@d"), ("css", "a{b:c}\n"), ("python", "def f(a):\n    return g(a)\n")])
def test_chunkers_take_linear_time(lang, unit):
    took = []
    for n in (1000, 8000):
        text = unit * n
        begun = time.perf_counter()
        try:
            engine.chunk_text(text, lang)
        except engine.ChunkingError:
            pass
        took.append(time.perf_counter() - begun)
    assert took[1] < 30 * took[0] + 0.5


def test_python_chunks_inside_other_statements():
    text = "if True:\n    def f(a: int) -> int:\n        return g(a)\ntry:\n    import os\nexcept ImportError:\n    class A:\n        def m(self): yield 1\n"
    found = {(c.kind, c.name) for c in engine.chunk_text(text, "python", cfg=base.Config(min_size=0))}
    assert found == {("function", "f"), ("import", "os"), ("class", "A")}
    f = next(c for c in code.python(text, base.Config()) if c.name == "f")
    assert f.deps == ["calls:g", "declares:f"] and f.meta["type_coverage"] == "1.0000" and f.meta["cyclomatic"] == "1"


def test_yaml_and_toml_maps():
    assert [c.name for c in code.yaml("a: 1\nb:\n  c: 2\n# x\nd: e\n", base.Config())] == ["a", "b", "d"]
    assert [(c.name, c.start, c.end) for c in code.toml("x=1\n[a]\ny=2\n\n[b.c]\nz=3", base.Config())] == [("a", 2, 3), ("b.c", 5, 6)]


def test_xml_by_tags():
    items = "".join(f"<item id='{k}'><title>Title of item {k}</title><text>{'words ' * 12}</text></item>\n" for k in range(9))
    text = f"<?xml version='1.0'?>\n<list xmlns:m='urn:m'>\n{items}<note>unclosed & broken\n</list>"
    d = xmltext.structure(text)
    assert d["root"] == "list" and d["counts"]["item"] == 9 and d["depth"] >= 3 and d["namespaces"] == {"m": "urn:m"} and d["document_type"] == "data"
    found = xmltext.by_tags(text, base.Config())
    grouped = [c for c in found if "batch" in c.tags]
    assert grouped and sum(int(c.meta["grouped"]) for c in grouped) >= 8 and all("grouped_item" in c.tags for c in grouped)
    lines = sorted(x for c in found for x in range(c.start, c.end + 1))
    assert len(lines) == len(set(lines))  # no line twice
    assert engine.chunk_text(text, "xml")


def test_latex_parents_and_preamble():
    text = "\\documentclass{article}\n\\usepackage{amsmath, graphicx}\n\\begin{document}\n\\section{Introduction}\nWords of the introduction that are long enough to stay.\n\\subsection{Detail}\nMore words about the detail.\n\\begin{theorem}\nx\n\\end{theorem}\n\\section{Results}\nThe results in many words.\n\\end{document}\n"
    found = {c.name: c for c in engine.chunk_text(text, "latex", cfg=base.Config(min_size=0))}
    assert found["preamble"].meta["packages"] == "amsmath,graphicx" and found["preamble"].meta["document_class"] == "article"
    assert found["Detail"].meta["parent"] == "Introduction" and found["theorem"].meta["parent"] == "Detail" and "parent" not in found["Results"].meta
    assert "introduction" in found["Introduction"].tags and "results" in found["Results"].tags


def test_coverage_of_lines():
    c = base.Coverage(10)
    c.add(3, 4)
    c.add(10, 10)
    assert c.gaps() == [(1, 2), (5, 9)] and c.meets(4, 6) and not c.meets(5, 9) and c.next_used(5) == 10
    assert base.Coverage(0).gaps() == []


# --- properties, registry, catalogue --------------------------------------------------------


def test_list_and_map_edits(spark):
    r = spark.range(1).select(
        P.without_child(F.array(F.lit("a"), F.lit("b"), F.lit("a")), F.lit("a")).alias("less"), P.without_child(F.array(F.lit("a")), F.lit("z")).alias("same"), P.with_child(F.array(F.lit("a")), F.lit("a")).alias("kept"),
        P.with_quality(F.create_map(F.lit("x"), F.lit(0.5)), "x", F.lit(7.0)).alias("scores"), P.quality_of(F.create_map(F.lit("x"), F.lit(0.5)), "y").alias("none"),
        P.node_hash(F.lit("c"), F.create_map(F.lit("a"), F.lit("b")), F.array(F.lit("x"), F.lit("y"))).alias("h1"), P.node_hash(F.lit("c"), F.create_map(F.lit("a"), F.lit("b")), F.array(F.lit("y"), F.lit("x"))).alias("h2"),
        P.bumped(F.lit(2), F.lit(True)).alias("version"),
    ).first()
    assert (r["less"], r["same"], r["kept"], r["scores"], r["none"], r["version"]) == (["b", "a"], ["a"], ["a"], {"x": 1.0}, 0.0, 3) and r["h1"] == r["h2"]


def test_registry(spark):
    r = Registry()
    assert r.chunker_of("py") == "python" and r.chunker_of(None, ".css") == "css" and r.help() == {}
    r.reload("chunkers:\n  python:\n    languages: [python, snake]\n    extensions: [.py]\n    settings: {min_size: 7}\n  css:\n    needs: [no_such_package]\n  odd:\n    languages: [odd]\n")
    assert r.available() == ["python"] and "no_such_package" in r.help()["css"] and "odd" in r.help()
    assert r.config_of("python").min_size == 7 and r.setting("python", "nothing", 3) == 3 and r.languages() == ["python", "snake"]
    r.set("python", "min_size", 9)
    assert r.config_of("python").min_size == 9
    r.reload(": : broken [")
    assert "json" in r.available()
    assert {x["kind"] for x in r.statistics(spark).collect()} == {"tree", "scanner"}


def test_index_search_and_status(spark, tmp_path, capsys):
    repo = tmp_path / "thing"
    (repo / "sub").mkdir(parents=True)
    (repo / "a.py").write_text("def parse_config(path):\n    '''Reads the configuration of the service.'''\n    return open(path).read()\n")
    (repo / "sub" / "deep.json").write_text("[" * 50_000)
    (repo / "sub" / "b.md").write_text("# Title\n\nA paragraph about the weather and other things, long enough to be kept.\n")
    store = f"file://{tmp_path}/store"
    assert catalogue.search(spark, store, "x") is None and catalogue.status(spark, store) is None
    assert catalogue.index(spark, str(repo), store) == "thing"
    hit = catalogue.search(spark, store, "parse configuration", limit=1).first()
    assert hit["file_path"] == "a.py" and hit["identifier"] == "parse_config"
    s = catalogue.status(spark, store).first()
    assert (s["files"], s["errors"]) == (3, 1) and s["chunks"] >= 2
    (repo / "c.py").write_text("x = 1\n")
    catalogue.index(spark, str(repo), store)
    assert catalogue.status(spark, store).first()["files"] == 3  # there already
    catalogue.index(spark, str(repo), store, force=True)
    assert catalogue.status(spark, store).first()["files"] == 4
    assert {r["extension"]: r["files"] for r in catalogue.extensions(spark, store).collect()}[".py"] == 2
    assert "parse_config" in cli.rendered(catalogue.search(spark, store, "parse configuration"))


def test_index_a_git_repository(spark, tmp_path):
    repo = tmp_path / "origin.git"
    work = tmp_path / "work"
    subprocess.run(["git", "init", "-q", str(work)], check=True)
    (work / "m.py").write_text("def only_function_here():\n    return 'a value that is long enough to be kept'\n")
    git = ["git", "-C", str(work), "-c", "user.name=t", "-c", "user.email=t@t"]
    subprocess.run([*git, "add", "."], check=True)
    subprocess.run([*git, "commit", "-q", "-m", "one"], check=True)
    subprocess.run(["git", "clone", "-q", "--bare", str(work), str(repo)], check=True)
    store = f"file://{tmp_path}/store"
    assert catalogue.index(spark, str(repo), store) == "origin"
    assert catalogue.search(spark, store, "only_function_here").first()["file_path"] == "m.py"


def test_export_forms(spark):
    nodes, edges = spark.createDataFrame([("a<",), ("b",)], "id string"), spark.createDataFrame([("a<", "b", 0.5)], "src string, dst string, weight double")
    text = "\n".join(r["value"] for r in S.gexf(nodes, edges).orderBy("part").collect())
    import xml.etree.ElementTree as ET

    root = ET.fromstring(text)
    assert [e.get("weight") for e in root.iter() if e.tag.endswith("edge")] == ["0.5"]
    assert sorted(r["kind"] for r in S.graph_rows(nodes, edges).collect()) == ["edge", "node", "node"]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId = "spark://somewhere:7077", "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_short_ways_in(spark, tmp_path):
    from chunkweave import api

    (tmp_path / "a.py").write_text("def read_table(path):\n    '''Reads the table of a file and gives its rows.'''\n    return parse_rows(path)\n\n\ndef parse_rows(path):\n    '''Splits a file into rows, one for each line.'''\n    return open(path).read().split()\n")
    (tmp_path / "b.md").write_text("# Use\n\nThe tables are read by a function that is described in this paragraph.\n")
    chunks = api.chunk_directory(spark, str(tmp_path)).cache()
    assert api.chunk_file(spark, str(tmp_path / "a.py")).count() == 2
    one = spark.createDataFrame([(str(tmp_path / "a.py"), "python")], "file_path string, language string")
    text = spark.createDataFrame([(str(tmp_path / "a.py"), (tmp_path / "a.py").read_text()), ("z", "x")], "file_path string, content string")
    assert api.chunk_catalogue(one, text).count() == 2
    g = api.build_graph(chunks)
    assert any(r["edge_type"] == "calls" and "parse_rows" in r["dst"] and "read_table" in r["src"] for r in g.edges.collect())
    levels = {r["level"]: r["count"] for r in api.build_hierarchy(chunks).groupBy("level").count().collect()}
    assert levels[3] == 1 and levels[0] == chunks.count()
    assert "parse_rows" in api.search(chunks, "parse_rows split", 1).first()["content"]
    code_, documents = api.typed(chunks)
    assert {r["cyclomatic"] for r in code_.collect()} == {1} and documents.filter("section_type = 'heading'").count() >= 1
    assert {r["importance"] for r in api.rescored(chunks, F.lit(7.0)).collect()} == {1.0}
    old = spark.createDataFrame([("i", "f", "text", 1, 2, "python", "function", ["k"], [0.5])], "id string, file_path string, content string, start_line int, end_line int, language string, chunk_type string, keywords array<string>, embedding array<double>")
    assert api.from_legacy(old).first()["tags"] == ["k"]
    assert api.PRESETS["fine"].target_size < api.PRESETS["coarse"].target_size

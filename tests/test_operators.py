"""Segmenters, chunkers, graph, hierarchy, search, incremental, streaming, sources."""

import datetime
import time
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chunkweave.operators import graph as J
from chunkweave.operators import hierarchy as H
from chunkweave.operators import incremental as I
from chunkweave.operators import search as L
from chunkweave.operators import segment as S
from chunkweave.operators import similarity as M
from chunkweave.operators import validate as V
from chunkweave.operators.chunkers import chunk_files, chunk_text, register_chunker
from chunkweave.operators.chunkers import code, markup
from chunkweave.operators.chunkers.base import Chunk, Config
from chunkweave.operators.chunkers.engine import engine_stats, register_udtf
from chunkweave.sources import files as X
from chunkweave.streaming import events as E


def files(spark, *texts):
    return spark.createDataFrame([(f"f{k}.txt", t) for k, t in enumerate(texts)], "file_path string, content string")


def spans(df):
    return [(r["start_line"], r["end_line"], r["content"]) for r in df.orderBy("file_path", "chunk_no").collect()]


LONG = "x" * 60


def test_segmenters_agree_with_the_row_chunkers(spark):
    rng = random.Random(3)
    bits = [LONG, "", "short", "key=value " + LONG, "# note " + LONG, "; c", "HEADER ONE", "1. numbered line", "2024-01-01 " + LONG]
    texts = ["\n".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(60)]
    cfg = Config()
    for pure, plain in ((S.config_blocks, markup._blocks), (S.sections, markup._sections)):
        got = {}
        for r in pure(files(spark, *texts)).collect():
            got.setdefault(r["file_path"], []).append((r["chunk_no"], r["start_line"], r["end_line"], r["content"]))
        for k, t in enumerate(texts):
            want = [(a, b, body) for _, a, b, body in plain(t, cfg)] if t.strip() else []
            assert [x[1:] for x in sorted(got.get(f"f{k}.txt", []))] == want
    kinds = {r["file_path"]: r["k"] for r in files(spark, *texts).select("file_path", S.text_type(F.col("content")).alias("k")).collect()}
    assert kinds == {f"f{k}.txt": markup.text_kind(t) for k, t in enumerate(texts)}


def test_paragraphs_and_sizes(spark):
    text = f"{LONG}\n\nshort\n \n{LONG}\nsecond line"
    assert [(a, b) for a, b, _ in spans(S.paragraphs(files(spark, text)))] == [(1, 1), (5, 6)]
    text = "\n".join([LONG] * 40)
    got = spans(S.by_size(files(spark, text)))
    assert [(a, b) for a, b, _ in got] == [(a, b) for _, a, b, _ in markup._paragraphs("\n".join([LONG] * 40).replace("\n", "\n"), Config(min_size=10**9, target_size=800))] or got[0][:2] == (1, 14)
    assert "\n".join(c for _, _, c in got) == text
    assert spans(S.fixed_lines(files(spark, "a\nb\nc"), 2)) == [(1, 2, "a\nb"), (3, 3, "c")]
    assert spans(S.paragraphs(files(spark, "", " \n"))) == []


def test_log_entries():
    cfg = Config(min_size=20, max_size=100)
    text = "2024-01-01 first entry of all\n  more\n2024-01-02 b\n2024-01-03 third entry here " + "y" * 90
    assert [(a, b) for _, a, b, _ in markup._logs(text, cfg)] == [(1, 2), (4, 4)]


PY = '''import os
import sys
import re
import json
import numpy


@decorator
async def fetch(url: str) -> str:
    """Fetch one thing. Args: url."""
    if url and ok(url):
        return await get(url)
    return ""


class Service(Base):
    def run(self):
        try:
            yield 1
        except ValueError:
            pass


LIMIT = 10
'''


def test_python_chunks():
    got = {c.name: c for c in chunk_text(PY, "python", cfg=Config(min_size=5))}
    assert got["stdlib_imports"].content.count("import") == 4 and got["numpy"].kind == "import"
    f = got["fetch"]
    assert (f.kind, f.start, f.end) == ("function", 8, 13) and {"async", "decorated"} <= set(f.tags)
    assert f.meta["cyclomatic"] == "3" and f.meta["type_coverage"] == "1.0000" and "calls:get" in f.deps
    s = got["Service"]
    assert s.meta["role"] == "service" and {"inherits", "error_handling"} <= set(s.tags)
    assert got["LIMIT"].kind == "variable"
    assert chunk_text("def broken(:", "python") == []


def test_other_languages():
    js = chunk_text("// c {\nexport default function Main() { return `}${1}`; }\nconst a = 1;\nclass B { get x() { return '}'; } }\n", "ts", cfg=Config(min_size=5))
    assert [(c.kind, c.name) for c in js] == [("function", "Main"), ("variable", "a"), ("class", "B")]
    rs = chunk_text('pub trait T { fn f(&self); }\nimpl T for X { fn f(&self) { println!("}"); } }\nmacro_rules! m { () => {} }\n', "rust", cfg=Config(min_size=5))
    assert [(c.kind, c.name) for c in rs] == [("trait", "T"), ("impl", "T"), ("macro", "m")] and "trait_impl" in rs[1].tags
    css = chunk_text("a { color: red; }\n@keyframes k { from { top: 0 } to { top: 1px } }\n", "css", cfg=Config(min_size=5))
    assert [c.kind for c in css] == ["css_rule", "css_keyframes"] and css[0].meta["properties"] == "color"
    go = chunk_text("import \"fmt\"\nfunc Add(a int) int {\n  return a\n}\n", "go", cfg=Config(min_size=5))
    assert [c.kind for c in go] == ["import", "function"]


def test_markup():
    page = "<html><body><h1>T</h1><p>one<p>two <b>b</b><div class='ad x' id='k'><a href='u'>l</a></div></body></html>"
    got = chunk_text(page, "html", cfg=Config(min_size=3))
    assert [c.tags[1] for c in got] == ["h1", "p", "p", "div"] or {"h1", "p", "div"} <= {c.tags[1] for c in got}
    div = next(c for c in got if c.tags[1] == "div")
    assert div.deps == ["u"] and {"class_ad", "id_k"} <= set(div.tags)
    obj = chunk_text('{"id": 1, "name": "x", "r": {"$ref": "#/d"}}', "json", cfg=Config(min_size=3))[0]
    assert obj.kind == "json_object" and obj.deps == ["#/d"] and "has_identifier" in obj.tags
    assert len(chunk_text('{"a": 1}\n\n{"b": 2}\n{bad\n', "json", cfg=Config(min_size=3))) == 2
    assert chunk_text('{"open": ', "json") == []
    md = chunk_text("# A\n\ntext of a\n\n## B\n```py\n# no heading\n```\n> quote\n", "md", cfg=Config(min_size=3))
    assert [c.name for c in md if c.kind == "heading"] == ["A", "B"] and [c.kind for c in md if c.kind in ("code_block", "quote")] == ["code_block", "quote"]
    tex = chunk_text("\\begin{document}\n\\section{One}\ntext\n\\begin{figure}\n\\includegraphics{x}\n\\end{figure}\n\\end{document}", "latex", cfg=Config(min_size=3))
    assert ("environment", "figure") in [(c.kind, c.name) for c in tex]


RSS = "<rss version='2.0'><channel><title>News</title><description>d</description><item><title>One</title><description>&lt;b&gt;bold&lt;/b&gt; text of the item</description><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><category>c</category><link>u</link></item></channel></rss>"
ATOM = "<feed xmlns='http://www.w3.org/2005/Atom'><title>A</title><entry><title>E</title><summary>summary of the entry</summary><author><name>N</name></author><link href='v'/><updated>2024-01-01T00:00:00Z</updated></entry></feed>"
RDF = "<rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#' xmlns='http://purl.org/rss/1.0/'><channel><title>R</title></channel><item><title>I</title><description>of the item, long enough</description></item></rdf:RDF>"


def test_feeds():
    assert [markup.feed_kind(x) for x in (RSS, ATOM, RDF, "<a/>", "<rss broken")] == ["rss2", "atom", "rss1", "unknown", "rss2"]
    for text, title in ((RSS, "One"), (ATOM, "E"), (RDF, "I")):
        got = list(markup.feed(text, Config()))
        assert got[0].name == "feed_metadata" and got[0].importance == 0.95
        assert [c.name for c in got[1:]] == [title]
    item = list(markup.feed(RSS, Config()))[1]
    assert "Description: bold text of the item" in item.content and "2024-01-01T10:00:00+00:00" in item.content and item.deps == ["u"]
    assert next(markup.feed("<rss><broken", Config())).importance == 0.3
    assert chunk_text(RSS, "xml")[0].tags[0] == "feed"


def test_engine(spark):
    register_chunker("shout", lambda text, cfg: [Chunk("shout", text.upper(), 1, 1)], ("shout",), (".shout",))
    df = spark.createDataFrame([("a.py", PY), ("b.unknown", LONG), ("c.txt", None), ("d.txt", " "), ("e.shout", "x" * 60), ("f.py", "def broken(:" + LONG)], "file_path string, content string")
    got = chunk_files(df)
    by = Counter((r["file_path"], r["chunk_type"]) for r in got.collect())
    assert by["a.py", "function"] == 1 and by["b.unknown", "text_block"] == 1 and by["e.shout", "shout"] == 1 and by["f.py", "text_block"] == 1
    assert not any(p in ("c.txt", "d.txt") for p, _ in by)
    assert chunk_files(df, fallback=False).filter("file_path = 'f.py'").count() == 0
    assert engine_stats(got).filter("language = 'python'").first()["files"] == 2
    with pytest.raises(ValueError, match="did you mean"):
        chunk_text("x", "pyth")
    register_udtf(spark)
    rows = spark.sql("select chunk_type from chunk_text('# Title\n\nsome text that is long enough to be kept as a paragraph', 'markdown')").collect()
    assert {r[0] for r in rows} == {"heading", "paragraph"}


# --- graph ----------------------------------------------------------------------------------


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double")


def test_traversal(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("x", "a"), ("d", "a"))
    start = spark.createDataFrame([("a",)], "id string")
    near = {r["id"]: r["distance"] for r in J.neighbours(spark, e, start, 2, "out").collect()}
    assert near == {"b": 1, "d": 1, "c": 2}
    assert {r["id"] for r in J.neighbours(spark, e, start, 1, "in").collect()} == {"x", "d"}
    assert [r["id"] for r in J.shortest_path(spark, e, "x", "c").orderBy("step").collect()] == ["x", "a", "b", "c"]
    assert J.shortest_path(spark, e, "b", "x").count() == 0


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    pairs = [(f"n{rng.randint(0, 60)}", f"n{rng.randint(0, 60)}") for _ in range(45)] + [(f"c{k}", f"c{k + 1}") for k in range(20)] + [("self", "self")]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {r["id"]: r["component"] for r in J.components(spark, edges(spark, *pairs)).collect()} == {x: find(x) for x in root}


def test_rank_and_centralities(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"))
    r = {x["id"]: x["rank"] for x in J.page_rank(spark, e, 60).collect()}
    assert sum(r.values()) == pytest.approx(1) and r["a"] > r["d"] == pytest.approx(0.0375)
    line = edges(spark, ("a", "b"), ("b", "c"))
    assert {x["id"]: x["b"] for x in J.gated(line, J.betweenness, "b").collect()} == {"a": 0.0, "b": 0.5, "c": 0.0}
    assert {x["id"]: x["c"] for x in J.gated(line, J.closeness, "c").collect()}["c"] == pytest.approx(2 / 3)
    assert J.gated(line, J.betweenness, "b", most=3).count() == 0
    top = {x["id"]: x["v"] for x in J.gated(e, J.eigenvector, "v").collect()}
    assert max(top, key=top.get) in ("a", "b", "c")
    tri = {x["id"]: (x["triangles"], x["coefficient"]) for x in J.clustering(e).collect()}
    assert tri["b"] == (1, 1.0) and tri["a"] == (1, pytest.approx(1 / 3)) and tri["d"] == (0, 0.0)
    assert {x["cycle"] for x in J.short_cycles(edges(spark, ("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"))).collect()} == {"a>b", "a>b>c"}
    nodes = spark.createDataFrame([("a",), ("z",)], "id string")
    assert {r["id"]: (r["in_degree"], r["in_share"]) for r in J.degrees(nodes, edges(spark).limit(0)).collect()} == {"a": (0, 0.0), "z": (0, 0.0)}
    assert [r["id"] for r in J.isolated(nodes, e).collect()] == ["z"]
    assert {r["label"] for r in J.label_propagation(spark, edges(spark, ("a", "b"), ("b", "c"), ("c", "a")), 3).collect()} == {"a"}


def test_similarity(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["id"]) for r in M.cosine_search(spark, v.filter("vec_id in (0, 2)"), v, 0.9, block_rows=1).collect()] == [(0, 1)]
    w = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"]), (3, ["z"]), (4, ["a", "b"])], "id long, words array<string>")
    got = M.word_search(spark, w.filter("id = 1"), w, 0.3, 2).collect()
    assert [(r["id"], r["place"]) for r in sorted(got, key=lambda r: r["place"])] == [(1, 1), (4, 2)]
    p = spark.createDataFrame([(1, "x", 0.9), (2, "x", 0.6), (3, "x", 0.5), (4, "y", 1.0)], "id long, pattern string, confidence double")
    assert {r["id"]: r["n_links"] for r in M.pattern_links(p).collect()} == {1: 1, 2: 1, 3: 0, 4: 0}


# --- hierarchy, search, incremental -----------------------------------------------------------------


def chunks(spark, rows):
    return spark.createDataFrame([(f"{f}:{n}", f"src/{m}/{f}.txt", m, lang, n, t) for f, m, lang, n, t in rows], "chunk_id string, file_path string, module string, language string, chunk_no int, content string")


ROWS = [("a", "m1", "en", 0, "First text. It has two ends."), ("a", "m1", "en", 1, "Second part of a, with an error."), ("b", "m1", "de", 0, "Only part of b."), ("c", "m2", "en", 0, "Part of c, see http://x.y/z.")]


def test_tree_navigation_and_update(spark):
    c = chunks(spark, ROWS)
    t = H.tree(c).cache()
    assert Counter(r["level"] for r in t.collect()) == {0: 4, 1: 3, 2: 2, 3: 1}
    path = H.paths_to_root(t, t.filter("node_id = 'L0:a:1'")).orderBy("step")
    assert [r["node_id"] for r in path.collect()] == ["L0:a:1", "L1:a", "L2:m1", "L3:overview"]
    below = H.subtree(t, t.filter("node_id = 'L2:m1'"), 2)
    assert Counter(r["distance"] for r in below.collect()) == {0: 1, 1: 2, 2: 3}
    edited = chunks(spark, [*ROWS[:1], ("a", "m1", "en", 1, "Second part, now edited."), ROWS[2], ("d", "m2", "en", 0, "New file.")])
    changed = {r["node_id"]: r["change"] for r in H.changed_nodes(t, H.tree(edited)).collect()}
    assert changed["L1:a"] == "modified" and changed["L1:c"] == "removed" and changed["L1:d"] == "added" and changed["L3:overview"] == "modified" and "L1:b" not in changed
    old = H.files_level(H.leaves(c))
    new = {r["node_id"]: r["content"] for r in H.update_levels(old, edited).collect()}
    assert new == {r["node_id"]: r["content"] for r in H.files_level(H.leaves(edited)).collect()}
    assert H.repository_level(H.modules_level(H.files_level(H.leaves(c)))).first()["language"] == "en"
    assert H.tree(c.limit(0)).count() == 0


def test_search(spark):
    c = chunks(spark, ROWS)
    l1 = H.files_level(H.leaves(c))
    assert [r["node_id"] for r in L.level_search(l1, "error part", 5).collect()][0] == "L1:b"
    assert L.level_search(l1, "   ", 5).count() == 0
    found = spark.createDataFrame([("a", 5.0, "w " * 5), ("b", 4.0, "w " * 4), ("c", 3.0, "w " * 3), ("d", 1.0, "w")], "node_id string, score double, content string")
    assert [r["node_id"] for r in L.within_budget(found, 8).collect()] == ["a", "c"]
    assert L.substring_search(c, "PART OF", 2).count() == 2
    l2 = H.modules_level(l1).withColumn("content", F.lit(""))
    got = L.drill_down(l2, l1, "m2 file", 10).collect()
    assert [r["level"] for r in got][0] == 2 and "L1:c" in {r["node_id"] for r in got}
    h = spark.createDataFrame([(1, 0.5, 1.0), (2, 0.9, 0.1)], "id long, similarity double, quality double")
    assert [r["id"] for r in L.hybrid_rank(h, 2).collect()] == [2, 1]


def test_dispatch(spark):
    c = chunks(spark, ROWS)
    l0 = H.leaves(c).withColumn("summary", F.lit(None).cast("string"))
    l1 = H.files_level(l0.drop("summary"))
    levels = {0: l0, 1: l1, 2: H.modules_level(l1).withColumn("content", F.lit(""))}
    links = c.select("chunk_id", F.lit("b:0").alias("near"))
    ask = lambda q, **k: L.intelligent_search(levels, c, links, q, **k)
    kind, got = ask("overview of m2")
    assert kind == "architectural" and "L2:m2" in {r["node_id"] for r in got.collect()}
    kind, got = ask("what uses part of c")
    assert kind == "relationship" and {r["node_id"] for r in got.collect()} <= {"b:0"}
    kind, got = ask("show me the only part")
    assert kind == "implementation" and "L0:b:0" in {r["node_id"] for r in got.collect()}
    kind, got = ask("only part of b", budget=4)
    assert kind == "general" and sum(r["tokens"] for r in got.collect()) <= 4


def test_incremental(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", None)], "k string, fingerprint string")
    b = spark.createDataFrame([("x", "2"), ("z", None), ("w", "1")], "k string, fingerprint string")
    assert {(r["k"], r["change"]) for r in I.snapshot_diff(a, b, "k").collect()} == {("x", "modified"), ("y", "removed"), ("w", "added")}
    old = a.withColumn("version", F.lit(3))
    assert {r["k"]: (r["version"], r["is_dirty"]) for r in I.merge_versions(old, b, "k").collect()} == {"x": (4, True), "z": (3, False), "w": (1, True)}
    links = spark.createDataFrame([("x", "q")], "src string, dst string")
    assert {r["id"] for r in I.affected(b.select(F.col("k").alias("id")).filter("id = 'x'"), links).collect()} == {"x", "q"}


def test_defects(spark):
    df = spark.createDataFrame([("a", "text", 1, 2, 0.5), (None, " ", 5, 2, 1.5)], "chunk_id string, content string, start_line int, end_line int, importance double")
    assert {r["defect"] for r in V.defects(df).collect()} == {"missing id", "empty content", "line order", "importance range"}


# --- sources and streams -----------------------------------------------------------------------------


def test_scan_decode_and_sinks(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "build").mkdir()
    (tmp_path / "src" / "a.py").write_text("import os\n")
    (tmp_path / "src" / "builder.py").write_bytes("é".encode("latin-1"))
    (tmp_path / "build" / "c.py").write_text("x")
    (tmp_path / "src" / "d.bin").write_text("x")
    found = X.decode(X.scan(spark, str(tmp_path)))
    assert {r["file_path"].rsplit("/", 1)[1]: r["encoding"] for r in found.collect()} == {"a.py": "utf-8", "builder.py": "latin-1"}
    info = {r["name"]: r for r in X.file_info(found).collect()}
    assert info["a.py"]["language"] == "python" and info["a.py"]["lines"] == 2
    c = chunk_files(found.withColumn("content", F.concat("content", F.lit(LONG))))
    X.save_chunks(c, str(tmp_path / "out"), by="language")
    assert X.load_chunks(spark, str(tmp_path / "out")).count() == c.count()
    j = X.to_json(c, drop=("importance",))
    assert X.from_json(j, "chunk_id string").count() == c.count()
    nodes, e = spark.createDataFrame([("a<",)], "id string"), edges(spark, ("a<", "b"))
    lines = [r["value"] for r in X.graphml(nodes, e).orderBy("part").collect()]
    assert lines[1] == '<node id="a&lt;"/>' and lines[-1].endswith("</graphml>")
    assert X.adjacency(e).first()["targets"] == {"b": 1.0}


def test_configs():
    base = {"min_chunk_size": 50, "target_chunk_size": 800, "max_chunk_size": 2000, "ignore": ["a"], "deep": {"x": 1}}
    text = "min_chunk_size: 10  # note\nignore:\n  - b\n  - a\ndeep:\n  y: yes it is\nlist: [1, 2]\n"
    got = X.load_config(text, base)
    assert got["min_chunk_size"] == 10 and got["ignore"] == ["a", "b"] and got["deep"] == {"x": 1, "y": "yes it is"} and got["list"] == [1, 2]
    assert X.config_errors(got) == [] and X.config_errors(got | {"max_chunk_size": 5})
    assert X.load_config('{"a": 1}', {"b": 2}) == {"a": 1, "b": 2}


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", 7, "a", 1.0), (2, "2024-01-01 00:20:00", 7, "a", 2.0), (3, "2024-01-01 02:00:00", 7, "b", 4.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "events.parquet"))
    s = lambda: E.source(spark, str(tmp_path / "events.parquet"))
    assert Counter(r["n"] for r in E.run_complete(spark, E.tumbling(s(), "1 hour"), "t").collect()) == {2: 1, 1: 1}
    assert {(r["user_id"], r["n"]) for r in E.run_complete(spark, E.sessions(s(), "30 minutes"), "s").collect()} == {(7, 2), (7, 1)}
    assert E.run_append(spark, E.first_seen(s(), ["event_type"]).select("event_type"), "d").count() == 2
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("hello\nworld")
    seen = []
    E.watch_folder(spark, str(tmp_path / "in"), lambda b, n: seen.extend(r["content"] for r in b.collect()), str(tmp_path / "state")).awaitTermination()
    assert seen == ["hello\nworld"]


def test_late_rows_are_dropped_in_append_mode(spark, tmp_path):
    """A watermark with a short delay: a window is given once it is passed, and a row behind it counts no more."""
    from chunkweave.streaming import events as E

    schema = "event_id long, user_id long, event_type string, ts timestamp, value double"
    folder = str(tmp_path / "in")
    for k, minutes in enumerate(([0, 5, 50], [300], [302], [1, 301], [900], [901])):
        rows = [(10 * k + j, 1, "x", datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m), 1.0) for j, m in enumerate(minutes)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = {r["start"].hour: r["n"] for r in E.run_append(spark, E.tumbling(stream, "1 hour", late="10 minutes"), "late").collect()}
    assert got == {0: 3, 5: 3}  # the row of minute 1 came after the watermark; the last window is still open

"""What must hold on larger tables: work is done once, nothing is left out, rounds are few."""

import pyarrow as pa
from pyspark.sql import functions as F

from chunkweave.operators.chunkers import chunk_files
from chunkweave.operators.chunkers.base import Config
from chunkweave.operators.chunkers.engine import CHUNK_SCHEMA, processing_stats
from chunkweave.plans.formats import SOURCES


def counted(spark, df):
    """df, and an accumulator of how many of its rows were made."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), made


def test_statistics_read_the_chunks_once(spark):
    rows = [(f"f{k}.py", "python", kind, "x" * k) for k in range(40) for kind in ("function", "error" if k % 10 == 0 else "class")]
    chunks, made = counted(spark, spark.createDataFrame(rows, "file_path string, language string, chunk_type string, content string").repartition(3))
    s = processing_stats(chunks).first()
    assert (s["files"], s["failed"], s["chunks"], s["chunk_types"]) == (40, 4, 76, {"class": 36, "function": 40})
    assert s["characters"] == sum(len(r[3]) for r in rows if r[2] != "error") and abs(s["mean_size"] - s["characters"] / 76) < 1e-9
    assert made.value == len(rows)
    assert processing_stats(chunks.limit(0)).first()["chunks"] == 0


def test_columns_of_chunks_don_t_depend_on_which_are_asked_for(spark):
    files = spark.createDataFrame([(f"a.{k}", v.replace("@@", "7")) for k, v in SOURCES.items()] + [("b.json", "[" * 100_000)], "file_path string, content string")
    names = [p.split()[0] for p in CHUNK_SCHEMA.replace("map<string,string>", "map").split(", ")]
    whole = sorted(map(tuple, chunk_files(files).collect()), key=lambda r: (r[0], r[5], r[2]))
    for some in (("file_path", "chunk_type", "start_line", "chunk_id"), ("file_path", "chunk_id", "content", "end_line", "identifier", "start_line", "language"), ("file_path", "start_line", "chunk_id", "tags"), ("file_path", "start_line", "chunk_id", "importance", "dependencies")):
        got = chunk_files(files, columns=some)
        kept = [n for n in names if n in some]
        assert got.columns == kept
        at = [names.index(n) for n in kept]
        rows = sorted(map(tuple, got.collect()), key=lambda r: tuple(str(r[kept.index(n)]).zfill(9) if n == "start_line" else r[kept.index(n)] for n in ("file_path", "start_line", "chunk_id")))
        assert rows == [tuple(r[k] for k in at) for r in whole]


def test_html_elements_of_any_depth(spark):
    deep = "<html><body>" + "".join(f'<div class="d{k}">' for k in range(3000)) + "<p>inside of all of them" + "</div>" * 3000 + "</body></html>"
    found = chunk_files(spark.createDataFrame([("a.html", deep)], "file_path string, content string"), Config(min_size=0), columns=("chunk_type", "start_line", "tags"))
    assert {r["tag"]: r["n"] for r in found.groupBy(F.col("tags")[1].alias("tag")).agg(F.count(F.lit(1)).alias("n")).collect()} == {"div": 3000, "p": 1}
    mixed = "<html>\n" + "<section>\n" * 40 + "<p>one of the paragraphs \n </p> \n" + "</section>\n" * 40
    rows = chunk_files(spark.createDataFrame([("a.html", mixed)], "file_path string, content string"), Config(min_size=0)).filter("chunk_type = 'html_element'").collect()
    assert len(rows) == 41
    for r in rows:
        assert r["content"] == r["content"].strip() and r["end_line"] - r["start_line"] == r["content"].count("\n") and r["content"] in mixed


def test_links_of_vectors_without_a_table_of_them(spark, monkeypatch):
    import numpy as np

    from chunkweave.operators import graph as J
    from chunkweave.operators import links as K
    from chunkweave.operators.similarity import cosine_search

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 8))
    points = [(int(7 * k + 3), [float(v) for v in centres[k % 9] + rng.normal(size=8) * (0.2 + k % 3)]) for k in range(700)] + [(-5, None), (-6, [0.0] * 8), (-7, points_of(centres[0])), (-8, points_of(centres[0]))]
    df = spark.createDataFrame(points, "vec_id long, embedding array<double>")
    monkeypatch.setattr(K, "BLOCK_ROWS", 150)
    for least in (0.3, 0.97):
        e = cosine_search(spark, df, df, least).select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.col("similarity").alias("weight")).cache()
        links = K.Links(spark, df, least)
        assert links.unique and len(links.blocks) > 1
        same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))
        assert same(links.components(), J.components(spark, e))
        assert same(links.labels(4), J.label_propagation(spark, e, 4))
        assert same(links.clustering(), J.clustering(e))
        n = J.endpoints(e).count()
        assert links.linked(10_000) == n and links.linked(20) >= 20
    assert not K.Links(spark, df.union(df.filter("vec_id = 3")), 0.3).unique
    assert K.Links(spark, df.limit(0), 0.3).components().count() == 0 and K.Links(spark, df.limit(0), 0.3).clustering().count() == 0 and K.Links(spark, df.limit(0), 0.3).labels(2).count() == 0
    gaps = np.array([0, 65_534, 65_535, 65_536, 200_000, 1])
    assert list(K._unpacked(K._packed(gaps))) == list(np.cumsum(gaps))


def points_of(v):
    return [float(x) for x in v]


def test_hubs_and_long_chains(spark):
    """A bipartite graph has no path of two arcs to look at, a chain takes few rounds, and both are counted right."""
    from chunkweave.operators import graph as J

    star = [(f"h{h}", f"p{p}", 1.0) for h in range(3) for p in range(400)]
    e = spark.createDataFrame(star, "src string, dst string, weight double")
    d = {r["id"]: (r["degree"], r["triangles"]) for r in J.clustering(e).collect()}
    assert d["h0"] == (400, 0) and d["p7"] == (3, 0) and len(d) == 403
    before = {p.name for p in _folders(spark)}
    chain = [(k, k + 1, 1.0) for k in range(0, 300)] + [(1000 + k * 7919 % 301, 1000 + (k + 1) * 7919 % 301, 1.0) for k in range(300)] + [(5000, 5000, 1.0)]
    got = {r["id"]: r["component"] for r in J.components(spark, spark.createDataFrame(chain, "src long, dst long, weight double")).collect()}
    assert got == {k: 0 for k in range(301)} | {1000 + k: 1000 for k in range(301)} | {5000: 5000}
    kept = [x.name for p in _folders(spark) if p.name not in before and p.name.startswith("components") for x in p.iterdir()]
    assert len(kept) == 2  # the last round's edges and the result: those before are let go


def _chunks(spark, texts, edit=""):
    rows = [(f"c{d}-{k}", f"src/m{d % 3}/doc_{d}.txt", f"m{d % 3}", "en", k, t + (edit if d % 4 == 1 else "")) for d, parts in enumerate(texts) for k, t in enumerate(parts)]
    return spark.createDataFrame(rows, "chunk_id string, file_path string, module string, language string, chunk_no int, content string")


TEXTS = [[("Some words of it. " * (d * 7 % 60 + 1)).strip() + f"\nerror {d}-{k} ü" for k in range(d % 4 + 1)] for d in range(24)]


def test_the_tree_reads_its_chunks_once(spark):
    from chunkweave.operators import hierarchy as H

    chunks, made = counted(spark, _chunks(spark, TEXTS))
    n = sum(map(len, TEXTS))
    t = H.tree(chunks)
    assert made.value == n
    whole = H.files_level(H.leaves(_chunks(spark, TEXTS)))
    assert {r["node_id"]: r["content_size"] for r in t.filter("level = 1").collect()} == {r["node_id"]: len(r["content"]) for r in whole.collect()}
    before, made_before = counted(spark, _chunks(spark, TEXTS))
    after, made_after = counted(spark, _chunks(spark, TEXTS[:20], " edited"))
    old = H.files_level(H.measured(H.leaves(before)))
    from chunkweave.session import Scratch

    old = Scratch(spark, "before").save(old, "files")
    levels = H.update_tree(old, H.modules_level(old), after)
    want = H.tree(_chunks(spark, TEXTS[:20], " edited"))
    for k, level in enumerate(levels, 1):
        assert {r["node_id"]: r["hash"] for r in level.collect()} == {r["node_id"]: r["hash"] for r in want.filter(F.col("level") == k).collect()}
    assert made_before.value == n and made_after.value == sum(map(len, TEXTS[:20]))


def test_searches_of_cut_texts_equal_those_of_whole_ones(spark):
    from chunkweave.operators import hierarchy as H
    from chunkweave.operators import search as L

    whole, cut = H.leaves(_chunks(spark, TEXTS)), H.leaves(_chunks(spark, TEXTS), 501)
    assert cut.agg(F.max(F.length("content"))).first()[0] == 501 < whole.agg(F.max(F.length("content"))).first()[0]
    rows = lambda d: sorted(map(tuple, d.collect()))
    blank = F.lit(None).cast("string")
    files = H.files_level(cut).withColumn("content", F.substring("content", 1, 501))
    for cap in (200, 500):
        assert rows(L.level_search(whole.withColumn("summary", blank), "error technical words", 50, cap)) == rows(L.level_search(cut.withColumn("summary", blank), "error technical words", 50, cap))
        assert rows(L.level_search(H.files_level(whole), "error technical words", 50, cap)) == rows(L.level_search(files, "error technical words", 50, cap))


def test_links_of_classes_and_patterns_read_their_rows_once(spark):
    from chunkweave.operators import similarity as M

    rows, made = counted(spark, spark.createDataFrame([(k, k % 5) for k in range(50)], "id long, kind int"))
    assert {r["n_links"] for r in M.class_links(rows, "kind", "id").collect()} == {9} and made.value == 50
    rows, made = counted(spark, spark.createDataFrame([(k, f"p{k % 2}", (k % 10) / 10) for k in range(40)], "id long, pattern string, confidence double"))
    assert M.pattern_links(rows).count() == 40 and made.value == 40


def _folders(spark):
    import pathlib

    from chunkweave.session import shared_dir

    return list(pathlib.Path(shared_dir(spark).removeprefix("file://")).iterdir())

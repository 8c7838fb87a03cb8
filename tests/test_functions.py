"""Scalar functions, tags and classifiers on literals with known results."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from chunkweave.functions import classify as C
from chunkweave.functions import tags as G
from chunkweave.functions import text as T


def value(spark, column, **cols):
    names = list(cols) or ["x"]
    row = [cols[n] for n in names] if cols else [1]
    kinds = {str: "string", int: "int", float: "double", list: "array<string>", type(None): "string"}
    schema = ", ".join(f"{n} {kinds[type(v)]}" for n, v in zip(names, row))
    return spark.createDataFrame([tuple(row)], schema).select(column).first()[0]


def test_fingerprints(spark):
    deps = ["b", 'a"q']
    assert value(spark, T.content_hash(F.col("c")), c="é x") == hashlib.md5("é x".encode()).hexdigest()
    assert value(spark, T.dependency_fingerprint(F.col("d")), d=deps) == hashlib.sha256(json.dumps(sorted(deps)).encode()).hexdigest()
    assert value(spark, T.dependency_fingerprint(F.array().cast("array<string>"))) == hashlib.sha256(b"[]").hexdigest()


@pytest.mark.parametrize(
    ("text", "expected"),
    [("", 0), ("one", 1), ("  one two\n three ", 3), ("\t\n", 0)],
)
def test_word_count(spark, text, expected):
    assert value(spark, T.word_count(F.col("t")), t=text) == expected


def test_complexity(spark):
    text = "f(x) {\n" + " " * 10 + "g(y)\n}"
    score = T.complexity_score(F.col("t"), F.lit(3))
    assert value(spark, score, t=text) == 4
    assert value(spark, T.complexity_level(score), t=text) == "moderate"


def test_ids_and_paths(spark):
    p = F.lit("src/pkg/mod.one.py")
    assert value(spark, T.chunk_id(p, F.lit("function"), F.lit("do it!"), F.lit(7))) == "mod.one:function:doit:7"
    assert value(spark, T.chunk_id(p, F.lit("function"), F.lit("!!"), F.lit(7))) == "mod.one:function:chunk:7"
    assert value(spark, T.module_path(p)) == "pkg.mod.one"
    assert value(spark, T.module_path(F.lit("lib/a.py"))) == "a"
    assert value(spark, T.module_path(F.lit("x/y.py"))) == "x.y"
    assert value(spark, T.extension(F.lit("a/B.PY"))) == ".py" and value(spark, T.extension(F.lit(".env"))) == ""
    assert value(spark, T.edge_id(F.lit("a"), F.lit("b"), F.lit("calls"))) == "a->b:calls"


def test_preview(spark):
    show = lambda t: value(spark, T.preview(F.col("t")), t=t)
    assert show("x" * 200) == "x" * 200
    assert show("x" * 201) == "x" * 197 + "..."
    assert show("x" * 160 + "\n" + "y" * 90) == "x" * 160 + "..."
    assert show("x" * 160 + "." + "y" * 90) == "x" * 160 + "...."


def test_document_structure(spark):
    kind = lambda t: value(spark, T.section_type(F.col("t")), t=t)
    assert [kind(t) for t in ("# A", "```\nx\n```", "    a\n    b", "- a\n- b", "1. a", "|a|b|c|", "plain")] == ["heading", "code_block", "code_block", "list", "list", "table", "paragraph"]
    assert value(spark, T.heading_level(F.col("t")), t="### x") == 3 and value(spark, T.heading_level(F.col("t")), t="#x") == 1
    assert value(spark, T.readability(F.col("t")), t="") == 0.0 and value(spark, T.readability(F.col("t")), t="a b. c d.") == 0.9
    assert value(spark, T.structure_consistency(F.col("t")), t="# Good heading") == 1.0


def test_code_scores(spark):
    assert value(spark, T.maintainability(F.lit(12), F.lit(0.5), F.lit(1.0), F.lit(60))) == pytest.approx(0.8)
    assert value(spark, T.coupling(F.lit(30), F.lit(1))) == 1.0
    assert value(spark, T.test_indicator(F.lit(True), F.col("t"), F.col("d")), t=["unit_test"], d=["assert_ok"]) == 1.0
    assert value(spark, T.selector_specificity(F.lit("div#a.b[c]:hover > p"))) == 122
    assert value(spark, T.overall_quality({}, F.lit(0.4))) == 0.4


def test_routing(spark):
    low = lambda e: value(spark, C.language_of(F.lit(e)))
    assert [low(e) for e in (".py", ".tsx", ".xhtml", ".rss", ".none")] == ["python", "javascript", "xml", "rss", "unknown"]
    assert value(spark, C.parser_of(F.lit("ts"), F.lit(".py"))) == "javascript"
    assert value(spark, C.parser_of(F.lit("nope"), F.lit(".py"))) == "python"
    kinds = {"explain the design": "architectural", "what calls x": "relationship", "show me the method": "implementation", "the endpoint": "api", "an issue": "quality", "hi": "general"}
    for q, k in kinds.items():
        assert value(spark, C.query_type(F.lit(q))) == k
    assert value(spark, C.layer(F.lit("a/services/b.py"))) == "business"
    assert value(spark, C.edge_type(F.lit("zzz"))) == "related_to" and value(spark, C.graph_type(F.lit("calls"))) == "call_graph"
    assert value(spark, C.feed_kind(F.lit("<rss version='2.0'>"))) == "rss2" and value(spark, C.xml_kind(F.lit("<svg/>"))) == "svg"
    assert value(spark, C.import_kind(F.lit("os.path"))) == "stdlib" and value(spark, C.import_kind(F.lit(".x"))) == "local"


def test_tags(spark):
    assert value(spark, G.text_tags(F.col("t")), t="mail a.b@c.org or see https://x.y error") == ["text_content", "contains_email", "contains_url", "contains_filepath", "simple_text", "technical_content"]
    assert value(spark, G.links(F.col("t")), t='<a href="u">x</a> [l](v) [m](v)') == ["u", "v"]
    assert value(spark, G.jaccard(G.word_set(F.col("a")), G.word_set(F.col("b"))), a="A b c", b="b C d") == 0.5
    assert value(spark, G.python_imports(F.col("t")), t="import os\nfrom a.b import c\n") == ["os", "a.b"]
    assert "hooks" in value(spark, G.javascript_tags(F.col("t")), t="const [a, b] = useState(1)")
    assert value(spark, G.math_complexity(F.col("t")), t=r"\frac{a}{b} \sum \int \sqrt{x} _{i}") == "moderate"

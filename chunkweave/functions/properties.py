"""Properties of chunks and hierarchy nodes that follow from their columns, as Columns.

Missing scores count as 0, missing lists as empty, unless a docstring says so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkweave.functions import text as T

COMPLEX = ("complex", "very_complex")
#: The metrics that make the overall quality, each of the same weight.
METRICS = ("documentation_quality", "complexity", "readability", "maintainability", "completeness")
SUMMARY_KINDS = ("functional", "architectural", "api", "quality", "dependencies")


def _number(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.cast("double"), F.lit(default))


# --- chunks ------------------------------------------------------------------------


def is_complex(level: Column) -> Column:
    return F.coalesce(level.isin(*COMPLEX), F.lit(False))


def has_embedding(vector: Column) -> Column:
    return F.coalesce(F.size(vector) > 0, F.lit(False))


def is_highly_coupled(coupling: Column) -> Column:
    return _number(coupling) > 0.7


def is_reusable(reusability: Column) -> Column:
    return _number(reusability) > 0.6


def is_well_tested(indicator: Column) -> Column:
    return _number(indicator) > 0.5


def is_highly_readable(readability: Column) -> Column:
    return _number(readability) > 0.7


def is_section(kind: Column, which: str) -> Column:
    """Whether a document chunk is a `heading` or a `code_block`."""
    return F.coalesce(kind == which, F.lit(False))


def is_high_quality(importance: Column, docstring: Column, cyclomatic: Column, n_smells: Column) -> Column:
    """Three of four: important, documented, of at most ten paths, without smells."""
    checks = (_number(importance) > 0.7, _number(docstring) > 0.6, _number(cyclomatic, 1.0) <= 10, _number(n_smells) == 0)
    return reduce(lambda a, b: a + b, [c.cast("int") for c in checks]) >= 3


def needs_embedding(vector: Column, model: Column, version: Column, current_model: str, current_version: int) -> Column:
    """No vector, another model's, or one of an older version."""
    return vector.isNull() | ~model.eqNullSafe(F.lit(current_model)) | (F.coalesce(version, F.lit(-1)) < current_version)


def tag_names(tags: Column) -> Column:
    """Names of tags (name, confidence)."""
    return F.transform(F.coalesce(tags, F.array().cast("array<struct<name:string,confidence:double>>")), lambda t: t["name"])


def confident_tags(tags: Column, over: float = 0.8) -> Column:
    """Names of the tags (name, confidence) whose confidence is over the limit."""
    return F.transform(F.filter(F.coalesce(tags, F.array().cast("array<struct<name:string,confidence:double>>")), lambda t: t["confidence"] > over), lambda t: t["name"])


def quality_metrics(coupling: Column, reusability: Column, maintainability: Column, tested: Column, docstring: Column, types: Column, cyclomatic: Column, handles_errors: Column) -> Column:
    """The eight code metrics as a map."""
    values = (
        ("coupling", coupling), ("reusability", reusability), ("maintainability", maintainability), ("test_coverage_indicator", tested), ("documentation_quality", docstring),
        ("type_safety", types), ("complexity", T.complexity_quality(cyclomatic)), ("error_handling", F.when(handles_errors, 1.0).otherwise(0.0)),
    )
    return F.create_map(*[x for k, v in values for x in (F.lit(k), v.cast("double"))])


def quality_of(scores: Column, metric: str) -> Column:
    """One score of a map; 0 where it is missing."""
    return F.coalesce(scores[metric], F.lit(0.0))


def with_quality(scores: Column, metric: str, score: Column) -> Column:
    """The map with one score set, clamped to 0 to 1."""
    rest = F.map_filter(scores, lambda k, _: k != metric)
    return F.map_concat(rest, F.create_map(F.lit(metric), T.clamp(score.cast("double"))))


def overall_quality(scores: Column, importance: Column) -> Column:
    """The mean of those of METRICS that are there; the importance where none is."""
    there = [scores[m] for m in METRICS]
    n = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in there])
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in there])
    return F.when(n > 0, total / n).otherwise(importance)


def summary_info(id_: Column, kind: Column, complexity: Column, quality: Column, importance: Column, content: Column, fingerprint: Column, tags: Column, n_dependencies: Column, version: Column) -> Column:
    """Headline fields of a chunk, nested."""
    return F.struct(
        id_.alias("id"), kind.alias("type"), complexity.alias("complexity"), quality.alias("quality_score"), importance.alias("importance"),
        F.struct(F.length(content).alias("characters"), T.line_count(content).alias("lines"), T.word_count(content).alias("words")).alias("size"),
        F.substring(fingerprint, 1, 8).alias("fingerprint"), confident_tags(tags).alias("high_confidence_tags"), n_dependencies.alias("dependencies_count"), version.alias("version"),
    )


def bumped(version: Column, changed: Column) -> Column:
    """One more where the row changed."""
    return F.when(changed, version + 1).otherwise(version)


# --- hierarchy nodes -----------------------------------------------------------------


def is_leaf(children: Column) -> Column:
    return F.coalesce(F.size(children) == 0, F.lit(True))


def is_root(parent: Column) -> Column:
    return parent.isNull()


def summary_for(summaries: Column, kind: str, primary: Column) -> Column:
    """The summary of a kind (functional where the kind is unknown), else the primary one."""
    return F.coalesce(summaries[kind if kind in SUMMARY_KINDS else "functional"], primary)


def with_summary(summaries: Column, kind: str, text: Column) -> Column:
    """The summaries with one set; callers take a functional one as the primary."""
    return F.map_concat(F.map_filter(summaries, lambda k, _: k != kind), F.create_map(F.lit(kind), text))


def with_child(children: Column, child: Column) -> Column:
    """The list with the child at its end, unless it is in it."""
    return F.when(F.array_contains(children, child), children).otherwise(F.array_append(children, child))


def without_child(children: Column, child: Column) -> Column:
    """The list without the first occurrence of the child."""
    at = F.array_position(children, child).cast("int")
    return F.when(at > 0, F.concat(F.slice(children, F.lit(1), at - 1), F.slice(children, at + 1, F.size(children)))).otherwise(children)


def node_hash(content: Column, summaries: Column, children: Column) -> Column:
    """Of the content, the summaries by name and the children in order of name."""
    named = F.transform(F.array_sort(F.map_entries(summaries)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.sha2(F.concat_ws("\x01", F.coalesce(content, F.lit("")), F.array_join(named, "\x02"), F.array_join(F.array_sort(children), "\x02")).cast("binary"), 256)


def node_text(title: Column, primary: Column, content: Column, summaries: Column, keywords: Column) -> Column:
    """Title, summary (else the first 500 characters), labelled summaries and keywords, a line each."""
    head = F.when(F.length(content) > 500, F.concat(F.substring(content, 1, 500), F.lit("..."))).otherwise(content)
    labelled = [F.concat(F.lit(f"[{k.upper()}] "), summaries[k]) for k in SUMMARY_KINDS[:3]]
    words = F.when(F.size(keywords) > 0, F.concat(F.lit("Keywords: "), F.array_join(keywords, ", ")))
    return F.concat_ws("\n", F.when(title != "", title), F.coalesce(F.when(primary != "", primary), F.when(content != "", head)), *labelled, words)


# --- impact ------------------------------------------------------------------------


def impact_advice(severity: Column, direct: Column, transitive: Column) -> Column:
    """What to do about a change of that severity and reach; never empty."""
    rules = (
        (severity == "high", "Split the change into smaller steps"),
        (severity == "high", "Test every affected component"),
        (severity == "high", "Roll out behind a feature flag"),
        (direct > 15, "Many direct dependents: reduce the coupling"),
        (transitive > 30, "Wide transitive reach: review the boundaries between layers"),
    )
    found = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Standard tests suffice")))

"""Quality rules with risk-controlled thresholds (operator 7).

A rule rejects a document whose signal passes a cutoff.  Cutoffs are not given
but certified: for each stratum (language) and rule, the labelled good
documents tell how many of them a cutoff would reject, and the exact binomial
(Clopper-Pearson) bound of that rate must stay under the rule's share of the
allowed false rejection.  Cutoffs are tried from the safest on and the testing
of a rule stops at the first that fails (fixed-sequence testing, which needs no
correction along the cutoffs); the confidence is divided by the number of
stratum-rule pairs (Bonferroni).  Of the certified cutoffs the one that rejects
most labelled bad documents for the fewest good ones is taken; a rule that can
reject none safely is off in that stratum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.llm import textops
from chunkweave.session import Scratch

MIN_WORDS = 50
REPEAT_PERCENT = 50
ALPHA = 0.02
DELTA = 0.05
COST_OF_GOOD = 20.0
GRID = 1001
MANY_STRATA = 10_000
#: rule -> direction in which its signal is bad; all signals are integers from 0 to GRID - 1
RULES = {"symbol_permille": ">", "repeat_permille": ">", "dup_line_permille": ">", "upper_permille": ">", "word_chars_deci_high": ">", "word_chars_deci_low": "<"}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER_START = np.ones(256, bool)
_LETTER_START[0x80:0xC0] = False
FEATURES_SCHEMA = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"


def _row_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _within(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Keys that are equal only inside a row."""
    row = np.repeat(np.arange(1, len(bounds), dtype=np.uint64), np.diff(bounds))
    return textops.mix(hashes ^ textops.mix(row * np.uint64(0x9E3779B97F4A7C15)))


def features(body: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each text of a run of texts."""
    words = textops.Words(body, offsets)
    n = len(offsets) - 1
    out = {"n_words": words.count.astype(np.int64), "n_symbols": _row_sums(_SYMBOL[body], offsets), "n_upper": _row_sums(_UPPER[body], offsets)}
    out["word_chars"] = _row_sums(_LETTER_START[body] & ~textops._SPACE[body], offsets)
    # repeated three-word windows
    found, bounds = textops.windows(words.hashes(fold=False), words.bounds, 3, whole=False)
    marked = np.zeros(len(words.start), bool)
    if len(found):
        keys = _within(found, bounds)
        order = np.argsort(keys)
        near = keys[order]
        same = near[1:] == near[:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = np.flatnonzero(twice)
        row = np.searchsorted(bounds, hit, side="right") - 1
        at = hit - bounds[row] + words.bounds[row]
        for k in range(3):
            marked[at + k] = True
    out["n_repeat_words"] = _row_sums(marked, words.bounds)
    # lines: runs between \n inside a row, that hold a word
    newline = np.flatnonzero(body == 0x0A)
    begins = np.unique(np.concatenate((offsets[:-1], newline + 1))) if n else np.zeros(0, np.int64)
    begins = begins[begins < len(body)]
    row = np.searchsorted(offsets, begins, side="right") - 1
    next_newline = np.concatenate((newline, [len(body)]))[np.searchsorted(newline, begins)]
    ends = np.minimum(next_newline, offsets[row + 1]) if len(begins) else begins
    solid = np.concatenate(([0], np.cumsum(~textops._SPACE[body], dtype=np.int64)))
    worded = solid[ends] > solid[begins] if len(begins) else np.zeros(0, bool)
    begins, ends, row = begins[worded], ends[worded], row[worded]
    line_bounds = np.searchsorted(row, np.arange(n + 1))
    out["n_lines"] = np.diff(line_bounds).astype(np.int64)
    lines = textops.span_hashes(body, begins, ends)
    keys = _within(lines, line_bounds)
    first = np.zeros(len(keys), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    out["n_dup_lines"] = _row_sums(~first, line_bounds)
    return out


def document_features(docs: DataFrame) -> DataFrame:
    """The counts of every row of docs (doc_id, stratum, text)."""
    names = [p.split()[0] for p in FEATURES_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, body, offsets in textops.chunks(batch.column(2)):
                f = features(body, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *[pa.array(f[k]) for k in names[2:]]], names=names)

    return docs.mapInArrow(run, FEATURES_SCHEMA)


def signals() -> dict:
    """Rule -> integer column from 0 to GRID - 1."""
    w = F.greatest(F.col("n_words"), F.lit(1))
    c = F.greatest(F.col("word_chars"), F.lit(1))
    per = lambda a, b, k: F.least(F.floor(F.col(a) * k / b), F.lit(GRID - 1)).cast("int")
    return {
        "symbol_permille": per("n_symbols", w, 1000),
        "repeat_permille": per("n_repeat_words", w, 1000),
        "dup_line_permille": per("n_dup_lines", F.greatest(F.col("n_lines"), F.lit(1)), 1000),
        "upper_permille": per("n_upper", c, 1000),
        "word_chars_deci_high": per("word_chars", w, 10),
        "word_chars_deci_low": per("word_chars", w, 10),
    }


def upper_bound_ok(k: int, n: int, rate: float, delta: float) -> bool:
    """Whether k rejections of n good prove a rate under `rate` with confidence 1 - delta.

    Equal to Clopper-Pearson's upper bound being at most `rate`:
    P(Binomial(n, rate) <= k) <= delta.
    """
    if n == 0 or k >= n:
        return False
    log = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(rate) + (n - j) * math.log1p(-rate) for j in range(k + 1)]
    top = max(log)
    return top + math.log(sum(math.exp(x - top) for x in log)) <= math.log(delta)


def certify(good: np.ndarray, bad: np.ndarray, direction: str, rate: float, delta: float) -> int | None:
    """The cutoff for one stratum and rule from histograms over the signal, or None.

    A document is rejected when its signal is beyond the cutoff (over it for
    `>`, under it for `<`).
    """
    if direction == "<":
        cut = certify(good[::-1], bad[::-1], ">", rate, delta)
        return None if cut is None else len(good) - 1 - cut
    n_good, n_bad = int(good.sum()), int(bad.sum())
    if not n_good or not n_bad:
        return None
    over_good = n_good - np.cumsum(good)
    over_bad = n_bad - np.cumsum(bad)
    best, choice, known = 0.0, None, {}
    for cut in range(len(good) - 1, -1, -1):
        k = int(over_good[cut])
        if k not in known:
            known[k] = upper_bound_ok(k, n_good, rate, delta)
        if not known[k]:
            break
        gain = over_bad[cut] / n_bad - COST_OF_GOOD * k / n_good
        if gain > best:  # on a tie the safest, met first
            best, choice = gain, cut
    return choice


def thresholds(scratch: Scratch, labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff of what is certified, from rows of signals, stratum and quality (1 good, 0 bad).

    All labelled rows count, as histograms: a stratum and rule is certified in a
    task of its own from at most 2 * GRID counts, however many strata there are.
    """
    stacked = labelled.select("stratum", "quality", F.explode(F.create_map(*[x for r in RULES for x in (F.lit(r), F.col(r))])).alias("rule", "value"))
    counts = scratch.save(stacked.groupBy("stratum", "rule", "quality", "value").agg(F.count(F.lit(1)).alias("n")), "histograms")
    tests = max(counts.select("stratum", "rule").distinct().count(), 1)

    def run(key: tuple[str, str], rows: pd.DataFrame) -> pd.DataFrame:
        tables = np.zeros((2, GRID), np.int64)
        np.add.at(tables, (rows["quality"].to_numpy(), rows["value"].to_numpy()), rows["n"].to_numpy())
        cut = certify(tables[1], tables[0], RULES[key[1]], alpha / len(RULES), delta / tests)
        found = [(*key, cut)] if cut is not None else []
        return pd.DataFrame(found, columns=["stratum", "rule", "cutoff"]).astype({"stratum": str, "rule": str, "cutoff": "int32"})

    return scratch.save(counts.groupBy("stratum", "rule").applyInPandas(run, "stratum string, rule string, cutoff int"), "cutoffs")


def by_stratum(cutoffs: DataFrame) -> DataFrame:
    """A row a stratum: its cutoffs, null where a rule is off.  Broadcast up to MANY_STRATA of them, else joined."""
    wide = cutoffs.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])
    return F.broadcast(wide) if cutoffs.select("stratum").distinct().count() <= MANY_STRATA else wide


def beyond(rule: str) -> Column:
    """Whether a row's signal is beyond its stratum's cutoff."""
    cut = F.col(f"cut_{rule}")
    return F.coalesce(F.col(rule) > cut if RULES[rule] == ">" else F.col(rule) < cut, F.lit(False))


def apply_rules(spark: SparkSession, docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, n_words, the four counts, base_failed, kept, rules: one row per document.

    rules names the certified rules that reject the row, comma-joined.  A null
    or empty text has no words and fails the base.  Labels with a null id or
    quality are left out; an id labelled both ways counts as bad; labels for ids
    that do not occur count for nothing.  Null strata are one stratum.  Repeated
    ids are judged row by row.
    """
    marked, cutoffs = certified(spark, docs, labels, alpha, delta, id_col, text_col, stratum_col)
    marked = marked.join(by_stratum(cutoffs), "stratum", "left")
    rules = F.concat_ws(",", *[F.when(beyond(r), F.lit(r)) for r in RULES])
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    judged = marked.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), rules.alias("rules"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rules") == "")).alias("kept"), "rules")


def certified(spark: SparkSession, docs: DataFrame, labels: DataFrame, alpha: float, delta: float, id_col: str, text_col: str, stratum_col: str) -> tuple[DataFrame, DataFrame]:
    """The signals of every row, and the cutoffs that the labelled rows certify."""
    scratch = Scratch(spark, "quality")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.col(text_col).cast("string").alias("text"))
    found = scratch.save(document_features(own), "features")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marked = found.withColumns(signals())
    return marked, thresholds(scratch, marked.join(known, "doc_id"), alpha, delta)


def keep_passing(spark: SparkSession, docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows that pass base and rules, with all their columns.

    The counts are taken again in the filtering pass: cheaper than a shuffle of
    the texts, and right for repeated and null ids.
    """
    _, cutoffs = certified(spark, docs, labels, alpha, delta, id_col, text_col, stratum_col)
    cut = [f"cut_{r}" for r in RULES]
    names = docs.columns
    stratum = next(n for n in (f"_stratum{k}" for k in range(len(names) + 1)) if n not in names)
    own = [next(n for n in (f"{c}{'_' * k}" for k in range(len(names) + 1)) if n not in names) for c in cut]
    wide = by_stratum(cutoffs).withColumnsRenamed(dict(zip(["stratum", *cut], [stratum, *own])))
    joined = docs.join(wide, F.coalesce(docs[stratum_col].cast("string"), F.lit("")) == wide[stratum], "left").select(*[docs[n] for n in names], *[wide[c] for c in own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keep = len(names), np.zeros(batch.num_rows, bool)
            for a, b, body, offsets in textops.chunks(batch.column(names.index(text_col))):
                part = batch.slice(a, b - a)
                off = {r: GRID if d == ">" else -1 for r, d in RULES.items()}
                keep[a:b] = passes(features(body, offsets), {r: part.column(at + k).fill_null(off[r]).to_numpy() for k, r in enumerate(RULES)})
            yield pa.RecordBatch.from_arrays(batch.columns[:at], names=names).filter(pa.array(keep))

    return joined.mapInArrow(run, docs.schema)


def passes(f: dict[str, np.ndarray], cuts: dict[str, np.ndarray]) -> np.ndarray:
    """What `apply_rules` calls kept, for one run of texts."""
    w, c = np.maximum(f["n_words"], 1), np.maximum(f["word_chars"], 1)
    value = {
        "symbol_permille": f["n_symbols"] * 1000 // w,
        "repeat_permille": f["n_repeat_words"] * 1000 // w,
        "dup_line_permille": f["n_dup_lines"] * 1000 // np.maximum(f["n_lines"], 1),
        "upper_permille": f["n_upper"] * 1000 // c,
        "word_chars_deci_high": f["word_chars"] * 10 // w,
        "word_chars_deci_low": f["word_chars"] * 10 // w,
    }
    ok = (f["n_words"] >= MIN_WORDS) & (100 * f["n_repeat_words"] <= REPEAT_PERCENT * f["n_words"])
    for rule, direction in RULES.items():
        v = np.minimum(value[rule], GRID - 1)
        ok &= v <= cuts[rule] if direction == ">" else v >= cuts[rule]
    return ok

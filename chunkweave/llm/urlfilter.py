"""URL filter by a weighted vocabulary and host/path rules (operator 5).

An Aho-Corasick automaton finds all terms of the vocabulary in one pass over a
url; a hit counts only between characters other than a-z and 0-9.  One strict
term rejects the url, and so do several different soft ones whose weights reach
the limit together.  Rules by host and path come first where one fits.  The
vocabulary is a file: a line per term with its class and weight.
"""

from __future__ import annotations

import os
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: term, class (strict or soft), weight; tab-separated, with a header.
TERMS_FILE = os.path.join(os.path.dirname(__file__), "url_terms.tsv")
MIN_SOFT, LIMIT = 2, 1.0
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_INNER = frozenset(string.ascii_lowercase + string.digits)


def fold(c: Column) -> Column:
    """A-Z as a-z, all else as it is."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url and one without `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return fold(host), path


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own_host, slash, rest = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def read_terms(path: str = TERMS_FILE) -> dict[str, float | None]:
    """Term -> its weight, None for a strict one.  Terms are of a-z and 0-9; a strict line wins over a soft one."""
    out: dict[str, float | None] = {}
    with open(path, encoding="utf-8") as f:
        for line in list(f)[1:]:
            if not line.strip():
                continue
            term, kind, weight = line.rstrip("\n").split("\t")
            if not term or set(term) - _INNER or kind not in ("strict", "soft"):
                raise ValueError(f"not a term: {line!r}")
            if kind == "strict" or out.get(term, 0.0) is not None:
                out[term] = None if kind == "strict" else float(weight)
    return out


def automaton(terms: dict[str, float | None]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for term in terms:
        a.add_word(term, term)
    a.make_automaton()
    return a


def hits(a, url: str) -> set[str]:
    """Different terms of a url, between boundaries."""
    text = url.translate(_LOWER)
    return {
        term
        for end, term in a.iter(text)
        if (end + 1 == len(text) or text[end + 1] not in _INNER) and (end < len(term) or text[end - len(term)] not in _INNER)
    }


def filter_urls(pages: DataFrame, terms: dict[str, float | None] | None = None, min_soft: int = MIN_SOFT, limit: float = LIMIT, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft, weight: one row per input row.

    Without a fitting rule, a url with a strict term is blocked, and one with
    min_soft different soft terms whose weights add up to `limit`.  Rules and
    vocabulary are parameters of the plan, not tables: keep them to thousands.
    A null or empty url has empty host and path, no hits and the verdict allow.
    Ids are carried as they are, repeated or null.
    """
    known = read_terms() if terms is None else terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not known:
            empty = frozenset()
        else:
            a = automaton(known)
        for b in batches:
            found = [hits(a, u or "") if known else empty for u in b.column(1).to_pylist()]
            soft = [sorted(known[t] for t in f if known[t] is not None) for f in found]
            columns = [pa.array([len(f) - len(s) for f, s in zip(found, soft)], pa.int64()), pa.array([len(s) for s in soft], pa.int64()), pa.array([round(sum(s), 6) for s in soft], pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["page_id", "url", "n_strict", "n_soft", "weight"])

    counted = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).mapInArrow(run, "page_id long, url string, n_strict long, n_soft long, weight double")
    host, path = host_and_path(F.col("url"))
    split = counted.select("page_id", host.alias("host"), path.alias("path"), "n_strict", "n_soft", "weight")
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("n_strict") > 0) | ((F.col("n_soft") >= min_soft) & (F.col("weight") >= limit)), "block").otherwise("allow")
    return split.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "n_strict", "n_soft", "weight")


def oracle_sql(terms: dict[str, float | None] | None = None, min_soft: int = MIN_SOFT, limit: float = LIMIT, rules: tuple[tuple[str, str], ...] = RULES) -> str:
    """The same over the table pages: the words between boundaries, joined with the vocabulary."""
    known = read_terms() if terms is None else terms
    values = ", ".join(f"('{t}', {1 if w is None else 0}, {0.0 if w is None else w})" for t, w in sorted(known.items()))
    fits = lambda r: f"((host = '{r.partition('/')[0]}' or ends_with(host, '.{r.partition('/')[0]}')) and starts_with(path, '/{r.partition('/')[2]}'))"
    longest = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    return f"""
with v(term, strict, weight) as (values {values}),
a as (select row_number() over () as n, page_id, coalesce(url, '') as u, translate(coalesce(url, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') as low from pages),
w as (select n, unnest(list_distinct(regexp_extract_all(low, '[a-z0-9]+'))) as term from a),
h as (select n, sum(strict) as s, sum(1 - strict) as f, sum(weight) as weight from w join v using (term) group by n),
b as (select *, case when strpos(u, '://') > 0 then substr(u, strpos(u, '://') + 3) else '' end as rest from a),
c as (select *, regexp_extract(rest, '^[^/?#]*') as raw from b),
d as (select n, page_id, translate(raw, '{string.ascii_uppercase}', '{string.ascii_lowercase}') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from c),
e as (select page_id, host, path, coalesce(s, 0) as s, coalesce(f, 0) as f, round(coalesce(weight, 0)::double, 6) as weight from d left join h using (n))
select page_id, host, path,
  case {' '.join(f"when {fits(r)} then '{r}'" for _, r in longest)} end as rule,
  case {' '.join(f"when {fits(r)} then '{w}'" for w, r in longest)} when s > 0 or f >= {min_soft} and weight >= {limit} then 'block' else 'allow' end as verdict,
  cast(s as bigint) as n_strict, cast(f as bigint) as n_soft, weight
from e"""

"""Routing of files to chunkers, and the table function that runs them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.functions import classify as C
from chunkweave.functions import text as T
from chunkweave.operators.chunkers import code, markup
from chunkweave.operators.chunkers.base import Chunk, Config, chunk_id, keep
from chunkweave.session import Scratch, small_batches

CHUNK_SCHEMA = (
    "file_path string, language string, chunk_id string, chunk_type string, identifier string, start_line int, end_line int, content string, importance double, "
    "tags array<string>, dependencies array<string>, metadata map<string,string>"
)
#: Characters of files after which what they gave is handed on.
FLUSH_CHARS = 1 << 21
Chunker = Callable[[str, Config], Iterable[Chunk]]
CHUNKERS: dict[str, Chunker] = {
    "python": code.python, "javascript": code.javascript, "rust": code.rust, "css": code.css, "html": markup.html, "json": markup.json, "xml": markup.xml, "feed": markup.feed,
    "markdown": markup.markdown, "latex": markup.latex, "text": markup.plain, "go": code.simple(code.GO_HEADS), "java": code.simple(code.JAVA_HEADS), "c": code.simple(code.C_HEADS), "cpp": code.simple(code.C_HEADS),
    "yaml": code.yaml, "toml": code.toml,
}
ROUTES = dict(C.LANGUAGES) | {k: k for k in ("go", "java", "c", "cpp", "yaml", "toml")}


class ChunkingError(Exception):
    """A file that could not be chunked."""


class UnsupportedLanguage(ChunkingError, ValueError):
    """No chunker takes the language."""


class InvalidContent(ChunkingError, ValueError):
    """The content can't be read as text."""


class ParserFailure(ChunkingError):
    """The chunker itself failed on the content."""


def register_chunker(name: str, chunker: Chunker, languages: tuple[str, ...] = (), extensions: tuple[str, ...] = ()) -> None:
    """Adds a chunker at run time, or replaces one; later registrations win a language or extension."""
    CHUNKERS[name] = chunker
    ROUTES.update({language: name for language in languages})
    C.EXTENSIONS.update({e: name for e in extensions})
    C.PARSERS[name] = (languages or (name,), extensions)


def supported() -> dict[str, list[str]]:
    """Chunker -> languages routed to it."""
    return {n: sorted(k for k, v in ROUTES.items() if v == n) for n in sorted(CHUNKERS)}


def suggestions(language: str) -> list[str]:
    """Known languages that contain the name or are contained in it, ten at most."""
    low = language.lower()
    return [k for k in sorted(ROUTES) if low in k or k in low][:10]


def chunk_text(text: str, language: str, path: str = "memory", cfg: Config = Config()) -> list[Chunk]:
    """Chunks of one text in this process; blank text gives none, an unknown language raises."""
    name = ROUTES.get(language)
    if name is None:
        hint = suggestions(language)
        raise UnsupportedLanguage(f"unsupported language {language!r}" + (f"; did you mean {', '.join(hint)}?" if hint else ""))
    return run_chunker(CHUNKERS[name], text, cfg) if text.strip() else []


def run_chunker(chunker: Chunker, text: str, cfg: Config) -> list[Chunk]:
    """What a chunker keeps of a text; whatever it raises (nesting beyond the stack, memory, bad values) is a ParserFailure."""
    try:
        return keep(list(chunker(text, cfg)), cfg)
    except (RecursionError, MemoryError, ValueError, TypeError, KeyError, IndexError, AttributeError, AssertionError, SystemError) as e:
        raise ParserFailure(f"{type(e).__name__}: {e}"[:500]) from None


def can_chunk(language: str) -> bool:
    """Whether a chunker takes the language."""
    return language in ROUTES


def can_parse(files: DataFrame) -> DataFrame:
    """The files (file_path, language optional) that a chunker takes, by language or else by extension."""
    language = F.col("language") if "language" in files.columns else F.lit(None).cast("string")
    found = F.coalesce(language, C.language_of(T.extension(F.col("file_path"))))
    return files.filter(found.isin(*sorted(set(ROUTES) - {"unknown"})))


#: Column of chunks -> its value of a path, language and chunk.
_VALUES: dict[str, Callable[[str, str | None, Chunk], object]] = {
    "file_path": lambda path, lang, c: path, "language": lambda path, lang, c: lang, "chunk_id": lambda path, lang, c: chunk_id(path, c), "chunk_type": lambda path, lang, c: c.kind, "identifier": lambda path, lang, c: c.name,
    "start_line": lambda path, lang, c: c.start, "end_line": lambda path, lang, c: c.end, "content": lambda path, lang, c: c.content, "importance": lambda path, lang, c: float(c.importance), "tags": lambda path, lang, c: c.tags,
    "dependencies": lambda path, lang, c: c.deps, "metadata": lambda path, lang, c: list(c.meta.items()),
}
_KINDS = dict(zip(_VALUES, [pa.string()] * 5 + [pa.int32()] * 2 + [pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.map_(pa.string(), pa.string())]))


def chunk_files(files: DataFrame, cfg: Config = Config(), fallback: bool = True, errors: bool = True, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Chunks of files (file_path, content, language optional), one pass, no shuffle.

    `columns` names those of CHUNK_SCHEMA that are asked for (all without): others
    are neither worked out nor sent from Python, which expressions can't tell it.

    The language column decides, then the extension.  With `fallback`, a file
    that no chunker takes, or whose chunker finds nothing or fails, is chunked
    as plain text; without, it gives no chunk.  Null content gives no row.  No
    file ends the job: with `errors`, one that its chunker fails on, or that
    none takes, gives a row of the type `error` besides, with `error_class` and
    `error` in its metadata.
    """
    small_batches(files.sparkSession)
    language = F.col("language") if "language" in files.columns else F.lit(None).cast("string")
    routed = files.filter(F.col("content").isNotNull()).select(
        F.col("file_path").cast("string"), F.coalesce(language, C.language_of(T.extension(F.col("file_path")))).alias("language"), F.col("content").cast("string")
    )
    chunkers, routes = dict(CHUNKERS), dict(ROUTES)
    schema = {p.split()[0]: p for p in CHUNK_SCHEMA.split(", ")}
    names = [n for n in schema if columns is None or n in columns]
    cfg = replace(cfg, wanted=None if columns is None else frozenset(columns))
    kinds, values = [_KINDS[n] for n in names], [_VALUES[n] for n in names]

    def of_one(path: str, lang: str | None, text: str) -> Iterator[tuple]:
        found: list[Chunk] = []
        wrong: ChunkingError | None = None
        try:
            if (lang or "unknown") not in routes:
                raise UnsupportedLanguage(f"unsupported language {lang!r}")
            found = run_chunker(chunkers[routes[lang or "unknown"]], text, cfg)
        except ChunkingError as e:
            wrong = e
        if not found and fallback:
            try:
                found = run_chunker(markup.plain, text, cfg)
            except ChunkingError as e:
                wrong = wrong or e
        for c in found:
            yield tuple([v(path, lang, c) for v in values])
        if wrong and errors:
            row = dict(zip(_VALUES, (path, lang, f"{path}:error", "error", None, 1, text.count("\n") + 1, "", 0.0, [], [], [("error_class", type(wrong).__name__), ("error", str(wrong))])))
            yield tuple(row[n] for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_at = names.index("content") if "content" in names else None
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for path, lang, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if not text or not text.strip():
                    continue
                size += len(text)
                for row in of_one(path, lang, text):
                    rows.append(row)
                    size += len(row[text_at]) if text_at is not None else 0
                    if size > FLUSH_CHARS:  # chunks may be nested: what a batch gives is larger than the batch
                        yield _as_batch(rows, names, kinds)
                        rows, size = [], 0
            yield _as_batch(rows, names, kinds)

    return routed.mapInArrow(run, ", ".join(schema[n] for n in names))


def _as_batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def chunk_errors(chunks: DataFrame) -> DataFrame:
    """file_path, language, error_class, error of the files that failed."""
    return chunks.filter("chunk_type = 'error'").select("file_path", "language", F.col("metadata")["error_class"].alias("error_class"), F.col("metadata")["error"].alias("error"))


def without_errors(chunks: DataFrame) -> DataFrame:
    return chunks.filter("chunk_type <> 'error'")


def processing_stats(chunks: DataFrame) -> DataFrame:
    """One row: files, failed files, success rate, chunks, characters, and how many chunks each language and type has.

    The chunks are made once: counts by file, language and type are written and all else is read from them.
    Without the chunks' content characters and mean size are null.
    """
    scratch = Scratch(chunks.sparkSession, "stats")
    short = chunks.groupBy("file_path", "language", "chunk_type").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.length("content")) if "content" in chunks.columns else F.lit(None).cast("long")).alias("characters"))
    short = scratch.save(short, "counts")
    per = short.groupBy("file_path").agg(F.max((F.col("chunk_type") == "error").cast("int")).alias("failed"))
    files = per.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"))
    own = without_errors(short)
    count = lambda c: own.groupBy(c).agg(F.sum("n").alias("count")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(c), F.lit("unknown")), "count")))).alias(c + "s"))
    total, chars = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("characters"), F.lit(0)) if "content" in chunks.columns else F.sum("characters")
    sizes = own.agg(total.alias("chunks"), chars.alias("characters"), F.when(total > 0, chars / total).alias("mean_size"))
    rate = F.when(F.col("files") > 0, 1 - F.col("failed") / F.col("files")).otherwise(F.lit(0.0))
    return files.withColumn("success_rate", rate).crossJoin(sizes).crossJoin(count("language")).crossJoin(count("chunk_type"))  # one row each


def engine_stats(chunks: DataFrame) -> DataFrame:
    """Per language: files, chunks, mean chunks a file, mean size."""
    per = without_errors(chunks).groupBy("language").agg(F.countDistinct("file_path").alias("files"), F.count(F.lit(1)).alias("chunks"), F.avg(F.length("content")).alias("mean_size"))
    return per.withColumn("per_file", F.col("chunks") / F.col("files"))


def register_udtf(spark: SparkSession, name: str = "chunk_text") -> None:
    """`SELECT * FROM name(content, language)` for SQL users."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="chunk_type string, identifier string, start_line int, end_line int, content string")
    class ChunkText:
        def eval(self, text: str, language: str):
            for c in chunk_text(text or "", language):
                yield c.kind, c.name, c.start, c.end, c.content

    spark.udtf.register(name, ChunkText)

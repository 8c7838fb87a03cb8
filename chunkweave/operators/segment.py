"""Segmenters that are pure expressions: one file row to many chunk rows, no shuffle.

Each takes a DataFrame with file_path and content, keeps its other columns and
adds chunk_no (from 0), start_line, end_line (from 1) and content of the chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkweave.functions.text import NON_WS, WS, strip

MIN_CHUNK, TARGET_CHUNK, MAX_CHUNK = 50, 800, 2000
LOG_LINE = r"^[0-9]{4}(-[0-9]{2}){2}|[0-9]{2}(/[0-9]{2}/|-[0-9]{2}-)[0-9]{4}"
KEY_VALUE = r"^[^:=]+[:=]."
SECTION = r"^[A-Z][ \tA-Z]{3,}(:[ \t]*)?$"
NUMBERED = r"^[0-9]+[).][ \t]+."


def lines_of(content: Column) -> Column:
    return F.split(content, "\n")


def _share(content: Column, pattern: str) -> Column:
    lines = lines_of(content)
    return F.size(F.filter(lines, lambda l: l.rlike(pattern))) / F.size(lines)


def text_type(content: Column) -> Column:
    """log, config, structured or plain, in this order."""
    headed = _share(content, SECTION) + _share(content, NUMBERED)
    return F.when(_share(content, LOG_LINE) > 0.3, "log").when(_share(content, KEY_VALUE) > 0.4, "config").when(headed > 0.1, "structured").otherwise("plain")


def _emit(files: DataFrame, chunks: Column) -> DataFrame:
    """Explodes an array of (start_line, end_line, content) structs."""
    keep = [c for c in files.columns if c != "content"]
    return files.select(*keep, F.posexplode(chunks).alias("chunk_no", "c")).select(
        *keep, "chunk_no", F.col("c.start_line").alias("start_line"), F.col("c.end_line").alias("end_line"), F.col("c.content").alias("content")
    )


def _chunk(start: Column, end: Column, content: Column) -> Column:
    return F.struct(start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), content.alias("content"))


def fixed_lines(files: DataFrame, per_chunk: int = 50) -> DataFrame:
    """Chunks of a fixed number of lines; blank content gives none."""
    lines = lines_of(F.col("content"))
    starts = F.sequence(F.lit(1), F.size(lines), F.lit(per_chunk))
    chunks = F.transform(starts, lambda s: _chunk(s, F.least(s + per_chunk - 1, F.size(lines)), F.array_join(F.slice(lines, s, F.lit(per_chunk)), "\n")))
    return _emit(files.filter(F.col("content").rlike(NON_WS)), chunks)


def paragraphs(files: DataFrame, least: int = MIN_CHUNK) -> DataFrame:
    """Paragraphs between blank lines, of `least` characters and more.

    The line number advances by a paragraph's lines plus one, as if every break
    were a single blank line.
    """
    parts = F.filter(F.transform(F.split(F.col("content"), rf"\n{WS}*\n"), strip), lambda p: p != "")
    count = lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit(""))) + 1
    start = F.struct(F.lit(1).alias("line"), F.array().cast("array<struct<start_line:int,end_line:int,content:string>>").alias("out"))
    folded = F.aggregate(
        parts,
        start,
        lambda acc, p: F.struct(
            (acc["line"] + count(p) + 1).cast("int").alias("line"),
            F.when(F.length(p) >= least, F.array_append(acc["out"], _chunk(acc["line"], acc["line"] + count(p) - 1, p))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return _emit(files.filter(F.col("content").rlike(NON_WS)), folded)


def _grouped(files: DataFrame, begins, keep_line=None) -> DataFrame:
    """Runs of lines, a new one at every line for which begins(line) holds."""
    lines = F.transform(lines_of(F.col("content")), lambda l, i: F.struct((i + 1).alias("n"), l.alias("l")))
    heads = F.transform(F.filter(lines, lambda x: (x["n"] == 1) | begins(x["l"])), lambda x: x["n"])
    size = F.size(lines)
    chunks = F.transform(
        heads,
        lambda h, i: _chunk(
            h,
            F.coalesce(F.get(heads, i + 1) - 1, size),
            F.array_join(F.transform(F.slice(lines, h, F.coalesce(F.get(heads, i + 1), size + 1) - h), lambda x: x["l"]), "\n"),
        ),
    )
    return _emit(files, chunks)


def sections(files: DataFrame) -> DataFrame:
    """A section per header or numbered line; what stands before the first is one too."""
    return _grouped(files.filter(F.col("content").rlike(NON_WS)), lambda l: l.rlike(SECTION) | l.rlike(NUMBERED))


def headings(files: DataFrame) -> DataFrame:
    """A section per Markdown heading."""
    return _grouped(files.filter(F.col("content").rlike(NON_WS)), lambda l: l.rlike(r"^#{1,6}[ \t]+[^ \t]"))


def config_blocks(files: DataFrame, least: int = MIN_CHUNK) -> DataFrame:
    """Blocks of entries between blank and comment lines; a comment line starts the next block."""
    comment = lambda l: l.startswith("#") | l.startswith(";")
    blank = lambda l: ~l.rlike(NON_WS)
    lines = F.transform(lines_of(F.col("content")), lambda l, i: F.struct((i + 1).alias("n"), l.alias("l")))
    state = "struct<start:int,buf:array<string>,out:array<struct<start_line:int,end_line:int,content:string>>>"
    empty = F.struct(F.lit(1).alias("start"), F.array().cast("array<string>").alias("buf"), F.array().cast("array<struct<start_line:int,end_line:int,content:string>>").alias("out"))

    def flush(acc: Column, end: Column) -> Column:
        text = F.array_join(acc["buf"], "\n")
        return F.when((F.size(acc["buf"]) > 0) & (F.length(text) >= least), F.array_append(acc["out"], _chunk(acc["start"], end, text))).otherwise(acc["out"])

    def step(acc: Column, x: Column) -> Column:
        breaks = comment(x["l"]) | blank(x["l"])
        fresh = F.when(comment(x["l"]), F.array(x["l"])).otherwise(F.array().cast("array<string>"))
        start = F.when(breaks & (F.size(acc["buf"]) > 0), x["n"] + 1).otherwise(acc["start"])
        return F.struct(
            start.cast("int").alias("start"),
            F.when(breaks, fresh).otherwise(F.array_append(acc["buf"], x["l"])).alias("buf"),
            F.when(breaks, flush(acc, x["n"] - 1)).otherwise(acc["out"]).alias("out"),
        ).cast(state)

    folded = F.aggregate(lines, empty, step, lambda acc: flush(acc, F.size(lines)))
    return _emit(files.filter(F.col("content").rlike(NON_WS)), folded)


def by_size(files: DataFrame, target: int = TARGET_CHUNK, least: int = MIN_CHUNK) -> DataFrame:
    """Lines gathered until `target` characters are reached; a tail of `least` and more is kept."""
    lines = F.transform(lines_of(F.col("content")), lambda l, i: F.struct((i + 1).cast("int").alias("n"), F.length(l).alias("w")))
    state = "struct<start:int,size:int,out:array<struct<a:int,b:int>>>"
    empty = F.struct(F.lit(1).alias("start"), F.lit(-1).alias("size"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        size = acc["size"] + 1 + x["w"]
        full = size >= target
        return F.struct(
            F.when(full, x["n"] + 1).otherwise(acc["start"]).cast("int").alias("start"),
            F.when(full, -1).otherwise(size).cast("int").alias("size"),
            F.when(full, F.array_append(acc["out"], F.struct(acc["start"].alias("a"), x["n"].alias("b")))).otherwise(acc["out"]).alias("out"),
        ).cast(state)

    cuts = F.aggregate(lines, empty, step, lambda acc: F.when(acc["size"] >= least, F.array_append(acc["out"], F.struct(acc["start"].alias("a"), F.size(lines).alias("b")))).otherwise(acc["out"]))
    text = lines_of(F.col("content"))
    chunks = F.transform(cuts, lambda c: _chunk(c["a"], c["b"], F.array_join(F.slice(text, c["a"], c["b"] - c["a"] + 1), "\n")))
    return _emit(files.filter(F.col("content").rlike(NON_WS)), chunks)


def json_lines(files: DataFrame) -> DataFrame:
    """One chunk per line that holds something."""
    lines = F.transform(lines_of(F.col("content")), lambda l, i: _chunk(i + 1, i + 1, strip(l)))
    return _emit(files, F.filter(lines, lambda c: c["content"] != ""))


def matching_lines(files: DataFrame, pattern: str) -> DataFrame:
    """One chunk per line that has the pattern."""
    lines = F.transform(lines_of(F.col("content")), lambda l, i: _chunk(i + 1, i + 1, l))
    return _emit(files, F.filter(lines, lambda c: c["content"].rlike(pattern)))


def fragments(files: DataFrame, tag: str) -> DataFrame:
    """Every element of one name in text that need not be well-formed."""
    found = F.regexp_extract_all(F.col("content"), F.lit(rf"(?s)<{tag}\b[^>]*>.*?</{tag}>"), F.lit(0))
    return _emit(files, F.transform(found, lambda x: _chunk(F.lit(1), F.lit(1), x)))

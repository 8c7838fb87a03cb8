"""The short ways in: one call for what a user most often wants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.functions import text as T
from chunkweave.operators import builder as B
from chunkweave.operators import hierarchy as H
from chunkweave.operators import search as L
from chunkweave.operators.chunkers import chunk_files, chunk_text
from chunkweave.operators.chunkers.base import Chunk, Config
from chunkweave.operators.chunkers.engine import can_chunk, suggestions, supported, without_errors
from chunkweave.sources import files as S

#: Named chunk sizes.
PRESETS = {
    "default": Config(), "fine": Config(30, 400, 1000), "coarse": Config(100, 1600, 6000), "balanced": Config(50, 800, 2000), "latex_paper": Config(80, 1200, 4000), "latex_book": Config(120, 2400, 8000), "xml_data": Config(30, 600, 3000),
}

__all__ = ["PRESETS", "Chunk", "Config", "build_graph", "build_hierarchy", "can_chunk", "chunk_catalogue", "chunk_directory", "chunk_file", "chunk_text", "from_legacy", "rescored", "search", "suggestions", "supported", "typed"]


def chunk_directory(spark: SparkSession, root: str, cfg: Config = Config()) -> DataFrame:
    """Chunks (and error rows) of all supported files below a folder."""
    return chunk_files(S.decode(S.scan(spark, root)).select("file_path", "content"), cfg)


def chunk_file(spark: SparkSession, path: str, cfg: Config = Config()) -> DataFrame:
    """Chunks of one file."""
    raw = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", r"^file:/+", "/").alias("file_path"), "content")
    return chunk_files(S.decode(raw).select("file_path", "content"), cfg)


def chunk_catalogue(catalogue: DataFrame, contents: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Chunks of the files that a catalogue lists (file_path, language), from their contents (file_path, content)."""
    return chunk_files(contents.join(catalogue.select("file_path", "language"), "file_path"), cfg)


def rescored(chunks: DataFrame, importance: Column | None = None, identifier: Column | None = None) -> DataFrame:
    """Chunks with an importance or identifier of the caller's own: expressions over the chunk's columns."""
    out = chunks
    if importance is not None:
        out = out.withColumn("importance", F.least(F.greatest(importance.cast("double"), F.lit(0.0)), F.lit(1.0)))
    return out.withColumn("identifier", identifier) if identifier is not None else out


def typed(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Code chunks with their code metadata, and document chunks with theirs."""
    code = F.col("language").isin("python", "javascript", "rust", "go", "java", "c", "cpp")
    meta = lambda k, kind: F.col("metadata")[k].try_cast(kind).alias(k)
    own = without_errors(chunks)
    c = own.filter(code).select("*", meta("cyclomatic", "int"), meta("docstring_quality", "double"), meta("type_coverage", "double"), F.col("metadata")["role"].alias("role"))
    d = own.filter(~code).select("*", T.section_type(F.col("content")).alias("section_type"), T.heading_level(F.col("content")).alias("heading_level"), T.readability(F.col("content")).alias("readability"))
    return c, d


def from_legacy(chunks: DataFrame) -> DataFrame:
    """Rows of the older layout (id, file_path, content, start_line, end_line, language, chunk_type, keywords, embedding) in the present one."""
    return chunks.select(
        "file_path", "language", F.col("id").alias("chunk_id"), "chunk_type", F.lit(None).cast("string").alias("identifier"), F.col("start_line").cast("int"), F.col("end_line").cast("int"), "content",
        F.lit(0.5).alias("importance"), F.coalesce("keywords", F.array().cast("array<string>")).alias("tags"), F.array().cast("array<string>").alias("dependencies"), F.create_map().cast("map<string,string>").alias("metadata"), "embedding",
    )


def build_graph(chunks: DataFrame) -> B.Graph:
    """The property graph of chunks: containment, and a relationship for each dependency (`calls:x`, `imports:x`) to the chunk of that name, else to the name."""
    own = without_errors(chunks)
    nodes = own.select(
        F.col("chunk_id").alias("id"), T.combined_fingerprint(F.col("content"), F.col("dependencies"), F.col("chunk_type")).alias("fingerprint"), "file_path", "start_line", "end_line", ((T.readability(F.col("content")) + F.col("importance")) / 2).alias("quality")
    )
    named = own.filter("identifier is not null and chunk_type in ('function', 'class', 'struct', 'trait')").groupBy("identifier").agg(F.min("chunk_id").alias("target"))
    wanted = own.select(F.col("chunk_id").alias("src"), F.explode("dependencies").alias("d")).select("src", F.substring_index("d", ":", 1).alias("relationship"), F.expr("substr(d, instr(d, ':') + 1)").alias("identifier")).filter("relationship in ('calls', 'imports', 'uses')")
    linked = wanted.join(named, "identifier", "left").select("src", F.coalesce("target", "identifier").alias("dst"), "relationship", F.lit(1.0).alias("strength")).filter("src <> dst")
    return B.build(nodes, linked.distinct())


def build_hierarchy(chunks: DataFrame) -> DataFrame:
    """All levels of the summary hierarchy of chunks."""
    return H.tree(_numbered(chunks))


def _numbered(chunks: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    own = without_errors(chunks)
    order = Window.partitionBy("file_path").orderBy("start_line", "chunk_id")
    return own.select("chunk_id", "file_path", T.module_path(F.col("file_path")).alias("module"), "language", (F.row_number().over(order) - 1).alias("chunk_no"), "content")


def search(chunks: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The best leaves for a question."""
    return L.level_search(H.leaves(_numbered(chunks)).withColumn("summary", F.lit(None).cast("string")), query, limit)

"""Files and catalogues in, tables and graph formats out."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.functions import classify as C
from chunkweave.functions import text as T

IGNORED = (".git", "node_modules", "__pycache__", ".venv", "venv", "build", "dist", "target", ".pytest_cache")


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = tuple(C.EXTENSIONS), ignored: tuple[str, ...] = IGNORED, most_bytes: int | None = None) -> DataFrame:
    """file_path, size, modified, content (bytes) of supported files below a folder.

    A file is left out when a part of its path is an ignored name, or when it is
    larger than `most_bytes`.
    """
    glob = "*{" + ",".join(extensions) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    f = raw.select(F.regexp_replace("path", r"^file:/+", "/").alias("file_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    f = f.filter(~path_ignored(F.col("file_path"), ignored))
    return f.filter(F.col("size") <= most_bytes) if most_bytes is not None else f


def path_ignored(path: Column, ignored: tuple[str, ...], substring: bool = False) -> Column:
    """Whether a part of a path (or with `substring`, any stretch of it) is an ignored name."""
    if not ignored:
        return F.lit(False)
    if substring:
        return C.any_of(path, ignored)
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, ignored)))


def decode(files: DataFrame) -> DataFrame:
    """content as text: UTF-8 where it is valid, else Latin-1; with the encoding found."""
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(valid, F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return files.withColumn("encoding", F.when(valid, "utf-8").otherwise("latin-1")).withColumn("content", text)


def file_info(files: DataFrame) -> DataFrame:
    """The catalogue of files: language, hash, size, lines."""
    p, c = F.col("file_path"), F.col("content")
    return files.select(
        "file_path", T.file_name(p).alias("name"), T.extension(p).alias("extension"), C.language_of(T.extension(p)).alias("language"), T.content_hash(c).alias("content_hash"),
        F.octet_length(c).alias("size"), F.when(c == "", 0).otherwise(T.line_count(c)).alias("lines"), C.content_type_of(C.language_of(T.extension(p))).alias("content_type"),
    )


def from_rows(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """In-memory contents as files: (file_path, language, content)."""
    return spark.createDataFrame(rows, "file_path string, language string, content string")


def save_chunks(chunks: DataFrame, path: str, fmt: str = "parquet", by: str | None = None) -> None:
    """Writes chunks as Parquet or JSON, partitioned by a column if one is given."""
    w = chunks.write.mode("overwrite").format(fmt)
    (w.partitionBy(by) if by else w).save(path)


def load_chunks(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    r = spark.read.format(fmt)
    return (r.schema(schema) if schema else r).load(path)


def to_json(rows: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """Each row as one JSON text; embeddings and the like can be dropped."""
    return rows.drop(*drop).select(F.to_json(F.struct("*")).alias("json"))


def from_json(rows: DataFrame, schema: str) -> DataFrame:
    return rows.select(F.from_json("json", schema).alias("r")).select("r.*")


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a GraphML document (value, in order of `part`), for the text sink."""
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    spark = nodes.sparkSession
    head = spark.createDataFrame([(0, '<?xml version="1.0"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">')], "part int, value string")
    tail = spark.createDataFrame([(3, "</graph></graphml>")], "part int, value string")
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), esc("id"), F.lit('"/>')).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), esc("src"), F.lit('" target="'), esc("dst"), F.lit('"/>')).alias("value"))
    return head.union(n).union(e).union(tail)


def gexf(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a GEXF document (value, in order of `part`), for the text sink; edges carry their weight."""
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    rows = [(0, '<?xml version="1.0"?><gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed"><nodes>'), (2, "</nodes><edges>"), (4, "</edges></graph></gexf>")]
    frame = nodes.sparkSession.createDataFrame(rows, "part int, value string")
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), esc("id"), F.lit('" label="'), esc("id"), F.lit('"/>')).alias("value"))
    key = F.concat(esc("src"), F.lit("-"), esc("dst"))
    e = edges.select(F.lit(3).alias("part"), F.concat(F.lit('<edge id="'), key, F.lit('" source="'), esc("src"), F.lit('" target="'), esc("dst"), F.lit('" weight="'), F.col("weight").cast("string"), F.lit('"/>')).alias("value"))
    return frame.union(n).union(e)


def graph_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The dict form: a JSON text per node and per edge, with its kind."""
    return nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("*")).alias("json")).union(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct("*")).alias("json")))


def adjacency(edges: DataFrame) -> DataFrame:
    """src and a map of its targets to weights (dict-of-dicts form; a row per source)."""
    return edges.groupBy("src").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("dst", "weight")))).alias("targets"))


def load_config(text: str, defaults: dict) -> dict:
    """A flat or nested `key: value` configuration (JSON, or simple YAML with indented lists) over defaults."""
    try:
        return merge_configs(defaults, json.loads(text))
    except ValueError:
        pass
    try:
        import yaml

        found = yaml.safe_load(text)
        return merge_configs(defaults, found if isinstance(found, dict) else {})
    except ImportError:
        pass  # the simple reader below
    except yaml.YAMLError:
        return dict(defaults)
    root: dict = {}
    stack: list[tuple[int, object]] = [(-1, root)]
    lines = text.splitlines()
    for k, raw in enumerate(lines):
        line = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
        if not line.strip():
            continue
        depth = len(line) - len(line.lstrip())
        item = line.strip()
        while stack[-1][0] >= depth and not (item.startswith("- ") and isinstance(stack[-1][1], list)):
            stack.pop()
        holder = stack[-1][1]
        if item.startswith("- "):
            if isinstance(holder, list):
                holder.append(_scalar(item[2:]))
            continue
        key, _, value = item.partition(":")
        if value.strip():
            holder[key.strip()] = _scalar(value.strip())
            continue
        following = lines[k + 1 :]
        nxt = next((x.strip() for x in following if x.strip() and not x.strip().startswith("#")), "")
        holder[key.strip()] = [] if nxt.startswith("- ") else {}
        stack.append((depth, holder[key.strip()]))
    return merge_configs(defaults, root)


def _scalar(value: str) -> object:
    if value.startswith("[") and value.endswith("]"):
        return [_scalar(v.strip()) for v in value[1:-1].split(",") if v.strip()]
    plain = value.strip("'\"")
    if plain != value:
        return plain
    low = value.lower()
    if low in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[low]
    try:
        return int(value)
    except ValueError:
        try:
            return float(value)
        except ValueError:
            return value


def merge_configs(base: dict, over: dict) -> dict:
    """Nested maps merge, lists are united in order, other values are replaced."""
    out = dict(base)
    for k, v in over.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merge_configs(out[k], v)
        elif isinstance(v, list) and isinstance(out.get(k), list):
            out[k] = out[k] + [x for x in v if x not in out[k]]
        else:
            out[k] = v
    return out


def config_errors(config: dict) -> list[str]:
    """What is wrong with chunk sizes; empty if nothing is."""
    least, target, most = (config.get(k) for k in ("min_chunk_size", "target_chunk_size", "max_chunk_size"))
    if any(not isinstance(v, int) or v <= 0 for v in (least, target, most)):
        return ["sizes must be positive whole numbers"]
    return [] if least <= target <= most else ["sizes must not decrease from min to target to max"]

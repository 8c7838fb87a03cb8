"""Which chunker takes what: read from a configuration, probed, and open to change at run time.

A configuration maps a chunker's name to its languages and extensions, and may
name packages it needs and settings of its own:

    chunkers:
      python: {languages: [python, py], extensions: [.py], needs: [ast], settings: {min_size: 40}}

Without one, the built-in tables count.
"""

from __future__ import annotations

import importlib.util
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from chunkweave.functions import classify as C
from chunkweave.operators.chunkers import engine
from chunkweave.operators.chunkers.base import Config
from chunkweave.sources.files import load_config

#: Kind of each built-in chunker.
KINDS = {"python": "tree", "json": "tree", "html": "tree", "xml": "tree", "feed": "tree"}


@dataclass
class Entry:
    languages: tuple[str, ...]
    extensions: tuple[str, ...]
    needs: tuple[str, ...] = ()
    kind: str = "scanner"
    settings: dict = field(default_factory=dict)

    def missing(self) -> list[str]:
        """Packages it needs that aren't installed."""
        return [n for n in self.needs if importlib.util.find_spec(n) is None]


def built_in() -> dict[str, Entry]:
    return {n: Entry(ls, es, (), KINDS.get(n, "scanner")) for n, (ls, es) in C.PARSERS.items()}


class Registry:
    def __init__(self, text: str | None = None):
        self.text = text
        self.entries: dict[str, Entry] = {}
        self.reload()

    def reload(self, text: str | None = None) -> None:
        """Reads the configuration again; a broken or empty one gives the built-in tables."""
        self.text = text if text is not None else self.text
        found = load_config(self.text, {}).get("chunkers") if self.text else None
        if not isinstance(found, dict) or not found:
            self.entries = built_in()
            return
        listed = lambda v: tuple(v) if isinstance(v, (list, tuple)) else (v,) if v else ()
        self.entries = {
            str(n): Entry(listed(e.get("languages")) or (str(n),), listed(e.get("extensions")), listed(e.get("needs")), str(e.get("kind", KINDS.get(n, "scanner"))), dict(e.get("settings") or {}))
            for n, e in found.items()
            if isinstance(e, dict) and e.get("enabled", True)
        }

    def available(self) -> list[str]:
        """Chunkers whose packages are there and whose code is known."""
        return sorted(n for n, e in self.entries.items() if n in engine.CHUNKERS and not e.missing())

    def help(self) -> dict[str, str]:
        """What to install for each chunker that isn't available."""
        return {n: f"{n} needs " + ", ".join(e.missing()) if e.missing() else f"{n} has no code: see register_chunker" for n, e in sorted(self.entries.items()) if n not in self.available()}

    def chunker_of(self, language: str | None = None, extension: str | None = None) -> str | None:
        """By language first, then by extension; later entries win."""
        names = self.available()
        by = lambda hit: next((n for n, e in reversed(self.entries.items()) if n in names and hit(e)), None)
        return by(lambda e: language in e.languages) or by(lambda e: extension in e.extensions)

    def languages(self) -> list[str]:
        return sorted({x for n in self.available() for x in self.entries[n].languages})

    def extensions(self) -> list[str]:
        return sorted({x for n in self.available() for x in self.entries[n].extensions})

    def setting(self, name: str, key: str, default: object = None) -> object:
        e = self.entries.get(name)
        return default if e is None else e.settings.get(key, default)

    def set(self, name: str, key: str, value: object) -> None:
        self.entries[name].settings[key] = value

    def config_of(self, name: str, base: Config = Config()) -> Config:
        """The chunk sizes of one chunker: its settings over the given ones."""
        e = self.entries.get(name)
        own = {k: v for k, v in (e.settings if e else {}).items() if k in Config.__dataclass_fields__}
        return replace(base, **own)

    def apply(self) -> None:
        """Makes the engine route as this registry says."""
        for n in self.available():
            engine.register_chunker(n, engine.CHUNKERS[n], self.entries[n].languages, self.entries[n].extensions)

    def table(self, spark: SparkSession) -> DataFrame:
        """chunker, kind, language, extension, available: a row each, for joins."""
        names = set(self.available())
        rows = [(n, e.kind, lang, ext, n in names) for n, e in self.entries.items() for lang in e.languages or (None,) for ext in e.extensions or (None,)]
        return spark.createDataFrame(rows, "chunker string, kind string, language string, extension string, available boolean")

    def statistics(self, spark: SparkSession) -> DataFrame:
        """kind, chunkers, available, languages, extensions: counts by kind of chunker."""
        from pyspark.sql import functions as F

        t = self.table(spark)
        return t.groupBy("kind").agg(
            F.countDistinct("chunker").alias("chunkers"), F.countDistinct(F.when(F.col("available"), F.col("chunker"))).alias("available"), F.countDistinct("language").alias("languages"), F.countDistinct("extension").alias("extensions")
        )

"""SQL of each query, for an independent engine."""

from chunkweave.plans import chunks, formats, graphs, insights, streams, tree

ORACLE_SQL: dict[str, str] = {**chunks.ORACLE_SQL, **graphs.ORACLE_SQL, **tree.ORACLE_SQL, **formats.ORACLE_SQL, **streams.ORACLE_SQL, **insights.ORACLE_SQL}

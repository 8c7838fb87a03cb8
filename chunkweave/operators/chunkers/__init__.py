"""Chunkers by format, run as Arrow table functions over files."""

from chunkweave.operators.chunkers.engine import CHUNK_SCHEMA, chunk_files, chunk_text, register_chunker, supported

__all__ = ["CHUNK_SCHEMA", "chunk_files", "chunk_text", "register_chunker", "supported"]

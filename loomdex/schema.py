"""Table schemas of the index, the session memory and the change log."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


SOURCES = _table(("path", _S), ("content", _S))
FILES = _table(("id", _L), ("path", _S), ("language", _S), ("content_hash", _S), ("line_count", _L), ("byte_size", _L), ("indexed_at", _L))
SYMBOLS = _table(("id", _L), ("file_id", _L), ("name", _S), ("kind", _S), ("fqn", _S), ("signature", _S), ("docstring", _S), ("start_line", _L), ("end_line", _L), ("is_exported", _B), ("body_hash", _S))
CENTRALITY = _table(("id", _L), ("centrality", _D))
EDGES = _table(("src", _L), ("dst", _L), ("kind", _S))
RAW_EDGES = _table(("path", _S), ("from_fqn", _S), ("to_name", _S), ("kind", _S))
TERM_FREQUENCIES = _table(("term", _S), ("symbol_id", _L), ("tf", _D))
#: The full-text index: a term's weighted frequency in a symbol's texts, and these texts' length.
POSTINGS = _table(("term", _S), ("id", _L), ("f", _D), ("dl", _D))
#: A row per symbol: that length, and the number of different terms of its term frequencies.
TEXT_LENGTHS = _table(("id", _L), ("dl", _D), ("terms", _L))
SESSIONS = _table(("id", _S), ("started_at", _L), ("last_active", _L), ("is_compressed", _B), ("summary", _S), ("key_terms", _S), ("key_files", _S))
OBSERVATIONS = _table(("id", _L), ("session_id", _S), ("kind", _S), ("content", _S), ("headline", _S), ("detail_level", _I), ("is_stale", _B), ("created_at", _L), ("score", _D))
OBSERVATION_LINKS = _table(("observation_id", _L), ("symbol_fqn", _S))
SYMBOL_CHANGES = _table(("id", _L), ("symbol_fqn", _S), ("file_path", _S), ("change_kind", _S), ("old_value", _S), ("new_value", _S), ("session_id", _S), ("correlated_observation_id", _L), ("detected_at", _L))
SYMBOL_EMBEDDINGS = _table(("symbol_id", _L), ("embedding", T.ArrayType(T.FloatType())), ("model_name", _S), ("created_at", _L))

TABLES = {
    "files": FILES, "symbols": SYMBOLS, "centrality": CENTRALITY, "edges": EDGES, "raw_edges": RAW_EDGES,
    "term_frequencies": TERM_FREQUENCIES, "postings": POSTINGS, "text_lengths": TEXT_LENGTHS, "sessions": SESSIONS, "observations": OBSERVATIONS,
    "observation_links": OBSERVATION_LINKS, "symbol_changes": SYMBOL_CHANGES, "symbol_embeddings": SYMBOL_EMBEDDINGS,
}

#: Tables that a rebuild of the code index replaces; the others are session memory.
CODE_TABLES = ("files", "symbols", "centrality", "edges", "raw_edges", "term_frequencies", "postings", "text_lengths", "symbol_embeddings")
SCHEMA_VERSION = 4

"""Schemas of the tables."""

from __future__ import annotations

from pyspark.sql import types as T

LISTING = "path string, size long, mtime double"
BLOCKS = "path string, block_no int, text string, page int"
CHUNKS = "chunk_id long, file_path string, file_hash string, display_name string, page int, chunk_index int, text string, indexed_at timestamp"
VECTORS = "chunk_id long, grp int, far double, embedding array<float>"
GROUPS = "grp int, radius double, n long"
CENTRES = "grp int, centre array<double>"
POSTINGS = "chunk_id long, block int, term string, tf int, positions array<int>, dl int"
LENGTHS = "chunk_id long, dl int"
FILES = "path string, sha1 string, mtime double, chunk_count int, display_name string, first_chunk long, indexed_at timestamp"
TERMS = "term string, block int, df long, max_tf int, min_dl int"
TOMBSTONES = "path string"
PROJECTS = "name string, source_paths array<string>, source_path string, indexed_at string, doc_count long, chunk_count long, size_mb double, error string"
JOBS = "id string, kind string, project string, status string, progress long, total long, message string, result map<string,string>, error string, started_at string, updated_at string, completed_at string"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)

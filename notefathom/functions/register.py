"""The column functions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import markdown as M

#: Functions written in Python, by name; the others of ``text`` are expressions of built-in SQL functions already.
FUNCTIONS = {
    "chunk_markdown": M.chunks, "scan_tasks": M.tasks, "extract_links": M.maintenance_links, "scan_headings": M.headings, "scan_blocks": M.block_ids, "scan_sections": M.section_list,
    "porter_tokens": M.stemmed_tokens, "embed_text": M.embed_text, "mask_code": M.masked_text, "file_links": M.file_links,
}


def register(spark: SparkSession) -> list[str]:
    """Make them callable from ``spark.sql``; returns their names."""
    for name, fn in FUNCTIONS.items():
        spark.udf.register(name, fn)
    return list(FUNCTIONS)

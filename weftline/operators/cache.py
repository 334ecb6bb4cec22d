"""A content-addressed cache of calls, and digests of files.

A key names the call (version, source, task and inputs); an entry counts only while the digests of its parts agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ledger import latest_by

#: Bytes at a file's beginning that the middling digest reads.
PREFIX_BYTES = 10 * 2**20


def digest(*parts: Column) -> Column:
    """SHA-256 over the parts as JSON; nulls count, so that (null, x) and (x, null) differ."""
    return F.sha2(F.to_json(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts))), {"ignoreNullFields": "false"}).cast("binary"), 256)


def cache_key(source: Column, task: Column, inputs: Column, version: str = "1") -> Column:
    return digest(F.lit(version), source, task, inputs)


def hits(calls: DataFrame, entries: DataFrame, key: str = "key", parts: tuple[str, ...] = ()) -> DataFrame:
    """Calls with the entry of their key, where all parts' digests agree."""
    return calls.join(entries, [key, *parts])


def misses(calls: DataFrame, entries: DataFrame, key: str = "key", parts: tuple[str, ...] = ()) -> DataFrame:
    return calls.join(entries, [key, *parts], "left_anti")


def put(entries: DataFrame, made: DataFrame, key: str = "key", order: list[str] | None = None) -> DataFrame:
    """entries with new ones; a new entry takes the place of an old one of its key, and of new entries with one key the one of
    the greatest `order` (all other columns, if not given) stays."""
    one = latest_by(made, [key], order or [c for c in made.columns if c != key]) if len(made.columns) > 1 else made.distinct()
    return entries.join(one, key, "left_anti").unionByName(one)


def content_digest(files: DataFrame, strength: str = "weak") -> DataFrame:
    """(path, digest) of files as the binaryFile reader gives them: strong reads all, strongish the first 10 MiB, weak none."""
    how = {
        "strong": lambda: F.sha2("content", 256),
        "strongish": lambda: F.sha2(F.concat(F.substring("content", 1, PREFIX_BYTES), F.col("length").cast("string").cast("binary")), 256),
        "weak": lambda: F.sha2(F.concat_ws(":", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")).cast("binary"), 256),
    }[strength]
    return files.select("path", how().alias("digest"))

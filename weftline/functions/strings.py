"""Strings, paths and regular expressions (in Java's dialect)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import STRING, Type, rendered, require


def _lit(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def find(text: Column, pattern: Column | str) -> Column:
    """The first match, or null."""
    return F.regexp_substr(text, _lit(pattern))


def matches(text: Column, pattern: Column | str) -> Column:
    """Whether the pattern matches anywhere."""
    return F.rlike(text, _lit(pattern))


def _replacement(text: str) -> str:
    r"""`\1` to `\9` name groups and `$` is itself; Java wants `$1` and `\$`."""
    return re.sub(r"\\([1-9])|[\\$]", lambda m: f"${m[1]}" if m[1] else "\\" + m[0], text)


def sub(text: Column, pattern: Column | str, replacement: Column | str) -> Column:
    r"""Every match replaced; `\1` to `\9` in the replacement are groups."""
    if isinstance(replacement, str):
        new = F.lit(_replacement(replacement))
    else:
        escaped = F.regexp_replace(replacement, F.lit(r"\$|\\(?![1-9])"), F.lit(r"\\$0"))
        new = F.regexp_replace(escaped, F.lit(r"(?<!\\)\\([1-9])"), F.lit(r"\$$1"))
    return F.regexp_replace(text, _lit(pattern), new)


def split(text: Column, pattern: Column | str) -> Column:
    """Parts between matches; empty parts at the end stay. An empty pattern matches between all characters and at both ends."""
    p, none = _lit(pattern), F.lit("")
    every = F.when(text == "", F.array(none, none)).otherwise(F.concat(F.array(none), F.split(text, F.lit(""), -1), F.array(none)))
    if isinstance(pattern, str):
        return F.when(text.isNotNull(), every) if pattern == "" else F.split(text, p, -1)
    return F.when(p == "", F.when(text.isNotNull(), every)).otherwise(F.split(text, p, -1))


def basename(path: Column, ending: Column | str | None = None) -> Column:
    """The last segment of a path or URL (without query and fragment), less a literal ending."""
    bare = F.when(F.rlike(path, F.lit("^[A-Za-z][A-Za-z0-9+.-]*://")), F.regexp_replace(path, F.lit("[?#].*$"), F.lit(""))).otherwise(path)
    last = F.substring_index(F.regexp_replace(bare, F.lit("/+$"), F.lit("")), "/", -1)
    if ending is None:
        return last
    ending = _lit(ending)
    return F.when(F.endswith(last, ending), F.substring(last, F.lit(1), F.length(last) - F.length(ending))).otherwise(last)


def join_paths(first: Column, *rest: Column) -> Column:
    """Parts joined by `/`; parts after the first must be relative."""
    out = first
    for part in rest:
        out = require(~F.startswith(part, F.lit("/")), F.when(F.endswith(out, F.lit("/")), F.concat(out, part)).otherwise(F.concat(out, F.lit("/"), part)), "a path joined to another must be relative")
    return out


def join_path_array(parts: Column) -> Column:
    """The same over an array that isn't empty."""
    tails = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    joined = F.aggregate(tails, F.get(parts, F.lit(0)), lambda a, p: F.when(F.endswith(a, F.lit("/")), F.concat(a, p)).otherwise(F.concat(a, F.lit("/"), p)))
    return require((F.size(parts) > 0) & ~F.exists(tails, lambda p: F.startswith(p, F.lit("/"))), joined, "paths to join must be relative after the first")


def _each(items: Column, of: Type, f) -> Column:
    return F.transform(items, lambda x: f(F.coalesce(rendered(x, of.opt()), F.lit(""))))


def prefix(before: Column | str, items: Column, of: Type = STRING) -> Column:
    """Each item with the prefix; a null item gives the prefix alone."""
    return _each(items, of, lambda x: F.concat(_lit(before), x))


def suffix(after: Column | str, items: Column, of: Type = STRING) -> Column:
    return _each(items, of, lambda x: F.concat(x, _lit(after)))


def quote(items: Column, of: Type = STRING) -> Column:
    return _each(items, of, lambda x: F.concat(F.lit('"'), x, F.lit('"')))


def squote(items: Column, of: Type = STRING) -> Column:
    return _each(items, of, lambda x: F.concat(F.lit("'"), x, F.lit("'")))


def sep(between: Column | str, items: Column, of: Type = STRING) -> Column:
    """Items joined; null items are empty, their separators stay."""
    texts = _each(items, of, lambda x: x)
    joined = F.aggregate(F.slice(texts, 2, F.greatest(F.size(texts) - 1, F.lit(0))), F.coalesce(F.get(texts, F.lit(0)), F.lit("")), lambda a, x: F.concat(a, _lit(between), x)) if isinstance(between, Column) else F.array_join(texts, between)
    return F.when(items.isNotNull(), joined)

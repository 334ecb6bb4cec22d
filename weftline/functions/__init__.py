"""The standard library, column to column. Every function guards what Spark would let pass or render differently."""

from .arrays import chunk, contains, cross, defined, flatten, length, range_, select_all, select_first, transpose, unzip, zip_
from .maps import as_map, as_pairs, collect_by_key, contains_key, enum_value, keys, lookup, values
from .maths import ceil, divide, floor, int_power, max_, min_, remainder, round_
from .strings import basename, find, join_paths, matches, prefix, quote, sep, split, squote, sub, suffix
from .texts import (
    UNITS, file_content, format_json, format_lines, format_map, format_object, format_objects, format_tsv, parse_boolean, parse_float, parse_int, parse_json,
    glob_pattern, held, is_held, parse_lines, parse_map, parse_object, parse_objects, parse_string, parse_tsv, sized,
)

__all__ = [
    "UNITS", "as_map", "as_pairs", "basename", "ceil", "chunk", "collect_by_key", "contains", "contains_key", "cross", "defined", "divide", "enum_value", "file_content", "find", "flatten",
    "floor", "format_json", "format_lines", "format_map", "format_object", "format_objects", "format_tsv", "glob_pattern", "held", "int_power", "is_held", "join_paths", "keys", "length", "lookup", "matches",
    "max_", "min_", "parse_boolean", "parse_float", "parse_int", "parse_json", "parse_lines", "parse_map", "parse_object", "parse_objects", "parse_string", "parse_tsv", "prefix",
    "quote", "range_", "remainder", "round_", "select_all", "select_first", "sep", "sized", "split", "squote", "sub", "suffix", "transpose", "unzip", "values", "zip_",
]

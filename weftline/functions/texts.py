"""Contents of text, tab-separated and JSON files, to values and back; Files that carry their content. See `sources` for paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import MARK, file_name, once, require

#: Bytes of a unit of size (decimal, then binary units).
UNITS = {"B": 1} | {x: 1000**k for k, u in enumerate("KMGT", 1) for x in (u, f"{u}B")} | {x: 1024**k for k, u in enumerate("KMGT", 1) for x in (f"{u}i", f"{u}iB")}
_NAME = r"^[A-Za-z][A-Za-z0-9_]*$"


def held(name: Column, content: Column) -> Column:
    """A File that carries its content."""
    return F.concat(name, F.lit(MARK), content)


def is_held(file: Column) -> Column:
    return F.contains(file, F.lit(MARK))


def file_content(file: Column) -> Column:
    """What a File holds; null for null. A path whose content isn't at hand fails."""

    def held_by(f: Column) -> Column:
        fault = F.concat(F.lit("no content is at hand for the file "), f, F.lit(": read it with sources.held_files"))
        return F.when(f.isNotNull(), require(is_held(f), F.substring(f, F.length(file_name(f)) + 2, F.length(f)), fault))

    return once(file, held_by)


def glob_pattern(glob: Column) -> Column:
    """A glob as a regular expression over relative paths: `*` and `?` stay within a segment, `**/` crosses segments."""
    plain = F.regexp_replace(glob, F.lit(r"([.^$+{}()|\\])"), F.lit(r"\\$1"))
    out = F.regexp_replace(plain, F.lit(r"\[!"), F.lit("[^"))
    out = F.regexp_replace(F.regexp_replace(out, F.lit(r"\*\*/"), F.lit("\1")), F.lit(r"\*+"), F.lit("[^/]*"))
    out = F.regexp_replace(F.regexp_replace(out, F.lit(r"\?"), F.lit("[^/]")), F.lit("\1"), F.lit("(?:[^/]+/)*"))
    return F.concat(F.lit("^"), out, F.lit("$"))


def sized(n: Column, unit: str = "B") -> Column:
    """Bytes as a Float in the unit; null counts as 0."""
    if unit not in UNITS:
        raise ValueError(f"no unit {unit}")
    return F.coalesce(n, F.lit(0)).cast("double") / F.lit(float(UNITS[unit]))


def parse_string(content: Column) -> Column:
    """The content without line ends at its end."""
    return F.regexp_replace(content, F.lit(r"[\r\n]+\z"), F.lit(""))


def parse_lines(content: Column) -> Column:
    """Lines without their ends; a last line that isn't ended counts if it has any character."""
    lines = F.split(content, "\r?\n", -1)
    return F.when(F.get(lines, F.size(lines) - 1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def _one_line(content: Column) -> Column:
    lines = parse_lines(content)
    return require(F.size(lines) == 1, F.trim(F.regexp_replace(F.get(lines, F.lit(0)), F.lit(r"^\s+|\s+$"), F.lit(""))), "a file of one line is wanted")


def parse_int(content: Column) -> Column:
    x = _one_line(content)
    return require(F.rlike(x, F.lit(r"^[+-]?[0-9]+$")), x.cast("long"), "not an integer")


def parse_float(content: Column) -> Column:
    x = _one_line(content)
    return require(F.rlike(x, F.lit(r"(?i)^[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$")), x.cast("double"), "not a number")


def parse_boolean(content: Column) -> Column:
    x = F.lower(_one_line(content))
    return require(x.isin("true", "false"), x == "true", "neither true nor false")


def parse_tsv(content: Column) -> Column:
    """Rows of cells; plain tabs, no quotes."""
    return F.transform(parse_lines(content), lambda line: F.split(line, "\t", -1))


def _table(names: Column, rows: Column) -> Column:
    ok = F.forall(names, lambda n: F.rlike(n, F.lit(_NAME))) & (F.size(F.array_distinct(names)) == F.size(names)) & F.forall(rows, lambda r: F.size(r) == F.size(names))
    return require(ok, F.transform(rows, lambda r: F.map_from_arrays(names, r)), "names must be distinct identifiers and rows as long as they")


def parse_objects(content: Column, names: Column | None = None) -> Column:
    """Rows as maps from the names to cells; the first row names the columns unless names are given."""
    rows = parse_tsv(content)
    if names is not None:
        return _table(names, rows)
    return F.when(F.size(rows) == 0, F.array().cast("array<map<string,string>>")).otherwise(_table(F.get(rows, F.lit(0)), F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))))


def parse_object(content: Column) -> Column:
    """The one object of a file of two rows."""
    return require(F.size(parse_lines(content)) == 2, F.get(parse_objects(content), F.lit(0)), "an object has a row of names and one of values")


def parse_map(content: Column) -> Column:
    """Keys and values of two columns; a key that comes twice fails."""
    rows = parse_tsv(content)
    names = F.transform(rows, lambda r: F.get(r, F.lit(0)))
    ok = F.forall(rows, lambda r: F.size(r) == 2) & (F.size(F.array_distinct(names)) == F.size(names))
    return require(ok, F.map_from_arrays(names, F.transform(rows, lambda r: F.get(r, F.lit(1)))), "two columns with distinct keys are wanted")


def parse_json(content: Column, schema: str | None = None) -> Column:
    """JSON as a variant, or as the named schema; what isn't JSON fails."""
    if schema is None:
        return F.parse_json(content)
    return F.from_json(content, schema, {"mode": "FAILFAST"})


def format_lines(lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.when(lines.isNotNull(), F.lit("")))


def _cells(rows: Column) -> Column:
    return require(~F.exists(rows, lambda r: F.exists(r, lambda c: F.rlike(c, F.lit("[\t\n\r]")))), F.transform(rows, lambda r: F.array_join(r, "\t")), "a cell holds a tab or a line end")


def format_tsv(rows: Column, header: Column | None = None) -> Column:
    """Rows of cells; with a header, rows must be as long as it."""
    if header is None:
        return format_lines(_cells(rows))
    return require(F.forall(rows, lambda r: F.size(r) == F.size(header)), format_lines(_cells(F.concat(F.array(header), rows))), "rows differ in length from the header")


def format_map(m: Column) -> Column:
    return format_lines(_cells(F.transform(F.map_entries(m), lambda e: F.array(e["key"].cast("string"), e["value"].cast("string")))))


def format_objects(objects: Column) -> Column:
    """Objects (maps of strings) under the first one's names; all must have the same names."""
    names = F.map_keys(F.get(objects, F.lit(0)))
    same = F.forall(objects, lambda o: F.sort_array(F.map_keys(o)) == F.sort_array(names))
    rows = F.transform(objects, lambda o: F.transform(names, lambda n: F.element_at(o, n)))
    return F.when(F.size(objects) == 0, F.lit("")).otherwise(require(same, format_lines(_cells(F.concat(F.array(names), rows))), "objects differ in their names"))


def format_object(o: Column) -> Column:
    return format_objects(F.array(o))


def format_json(value: Column) -> Column:
    """JSON text of a value of any kind; members that are null are written."""
    listed = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substring(listed, F.lit(2), F.length(listed) - 2)

"""Sources and sinks by Spark's readers and writers, so that any file system Spark knows will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts
from ..types import require


def globbed(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path) of files under the root whose name matches, in order of path; folders are walked, contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return found.select("path").orderBy("path")


def file_sizes(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of a file, or of all files under a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")


def size_of(spark: SparkSession, root: str, unit: str = "B") -> DataFrame:
    """(size): the sum of the sizes in the unit."""
    return file_sizes(spark, root).agg(texts.sized(F.sum("length"), unit).alias("size"))


def read_contents(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, content): each file as one string; parse it with the functions of `functions.texts`."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def held_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, file) of the files under the root whose name matches: `file` is a File of the workflow language that carries its
    content. Join it to the rows whose inputs name these paths."""
    found = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(root, wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("path"), texts.held(F.col("_metadata.file_path"), F.col("value")).alias("file"))


def write_contents(rows: DataFrame, path: str, content: str = "content") -> None:
    """Text files of the contents, one after the other; each ends in one line end, its own or one that is added."""
    rows.select(F.regexp_replace(content, r"\n\z", "").alias("value")).write.text(path)


def read_line_table(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, line): `at` rises within a file, so lines can be put in order without a count over all of them."""
    lines = spark.read.text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), (F.col("_metadata.file_block_start") + F.monotonically_increasing_id()).alias("at"), F.regexp_replace("value", r"\r\z", "").alias("line"))


def read_tsv_table(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Rows of a large tab-separated file without a header; plain tabs, no quotes. Ragged rows fail."""
    cells = F.split("value", "\t", -1)
    rows = spark.read.text(path).select(require(F.size(cells) == len(names), cells, f"a row hasn't {len(names)} cells").alias("c"))
    return rows.select(*(F.col("c")[i].alias(n) for i, n in enumerate(names)))


def read_object_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a file whose first line names the columns. Splits of the file are read in parallel; the line that begins a
    file is its header (files of one table must agree)."""
    head = spark.read.text(path).where(F.col("_metadata.file_block_start") == 0).first()
    if head is None:
        raise ValueError(f"{path} has no header")
    names = head[0].split("\t")
    if len(set(names)) < len(names) or not all(n.isidentifier() for n in names):
        raise ValueError(f"{path}: names must be distinct identifiers")
    return read_tsv_table(spark, path, names).where(~(F.struct(*names) == F.struct(*map(F.lit, names))))


def _cell(c: Column) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    return require(~F.rlike(text, F.lit("[\t\n\r]")), text, "a cell holds a tab or a line end")


def write_tsv_table(rows: DataFrame, path: str) -> None:
    """Rows as tab-separated text, a file a partition and no header; a tab or line end in a cell fails."""
    rows.select(F.concat_ws("\t", *(_cell(F.col(c)) for c in rows.columns)).alias("value")).write.text(path)

"""Scatter, gather, conditionals, calls and input matrices over tables.

Bodies that are pure expressions need no shuffle: use `F.transform` (as compiled workflows do). These operators are for
bodies that work on tables: a scatter gives each element a row, a gather puts the results back in element order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scatter(parents: DataFrame, items: Column | str, item: str = "item", pos: str = "pos", keep: list[str] | None = None) -> DataFrame:
    """A row for each element of `items`: the columns of the parent that are kept (all by default), the place and the element."""
    return parents.select(*(keep if keep is not None else parents.columns), F.posexplode(items).alias(pos, item))


def _member(rows: str, name: str) -> Column:
    return F.transform(rows, lambda s: s[name])


def gather(children: DataFrame, keys: list[str], pos: str, values: list[str]) -> DataFrame:
    """One row a parent with an array for each value, in the order of `pos`; nulls keep their places. A nested scatter is
    gathered from the inside out, the outer place being one of the keys."""
    packed = children.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(pos, *values))).alias("_p"))
    return packed.select(*keys, *(_member("_p", v).alias(v) for v in values))


def gather_onto(parents: DataFrame, children: DataFrame, keys: list[str], pos: str, values: list[str]) -> DataFrame:
    """Parents with the gathered values; a parent without elements gets empty arrays."""
    got = gather(children, keys, pos, values)
    kinds = {f.name: f.dataType for f in got.schema}
    out = parents.join(got, keys, "left")
    return out.withColumns({v: F.coalesce(v, F.array().cast(kinds[v])) for v in values})


def conditional(rows: DataFrame, clauses: list[tuple[Column | None, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Each row goes to the first clause whose condition holds (None: else); names that only other clauses define become
    null. Rows for which no clause holds stay, with nulls. The rows are read once a clause: give it a table that is cheap to read."""
    left = F.lit(True)
    out = None
    for cond, body in [*clauses, (None, lambda d: d)]:
        here = left if cond is None else left & F.coalesce(cond, F.lit(False))
        part = body(rows.where(here))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        if cond is None:
            break
        left = left & ~F.coalesce(cond, F.lit(False))
    return out


def conditional_columns(rows: DataFrame, clauses: list[tuple[Column | None, dict[str, Column]]]) -> DataFrame:
    """The same for clauses that only compute columns: one projection, and the rows are read once."""
    names = list(dict.fromkeys(n for _, made in clauses for n in made))

    def chosen(name: str) -> Column:
        out = None
        for cond, made in clauses:
            value = made.get(name, F.lit(None))
            if cond is None:
                return value if out is None else out.otherwise(value)
            out = F.when(cond, value) if out is None else out.when(cond, value)
        return out

    return rows.withColumns({n: chosen(n) for n in names})


def call(rows: DataFrame, body: Callable[[DataFrame], DataFrame], inputs: dict[str, Column], name: str) -> DataFrame:
    """rows with the column `name`: the struct of what body makes of the inputs. body must keep the rows as they are (a
    projection), so no join is needed."""
    held = F.struct(*rows.columns).alias("_caller")
    made = body(rows.select(held, *(c.alias(k) for k, c in inputs.items())))
    outputs = [c for c in made.columns if c != "_caller"]
    return made.select("_caller.*", F.struct(*outputs).alias(name))


def input_matrix(spark: SparkSession, groups: list[dict[str, list]]) -> DataFrame:
    """All combinations of groups of inputs; within a group, inputs of equal length go together by position.

    The sides are what a caller wrote out, so each is broadcast.
    """
    out = None
    for group in groups:
        rows = list(zip(*group.values(), strict=True))
        side = spark.createDataFrame(rows, list(group)) if rows else spark.createDataFrame([], ", ".join(f"{k} string" for k in group))
        out = side if out is None else out.crossJoin(F.broadcast(side))
    return out

"""Queries over the test tables, one an operator, with the SQL that gives the same rows."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as L
from .. import types as T
from ..operators import assertions, cache, dataflow, ledger, tasks
from ..sources import file_sizes, globbed, held_files, read_line_table, read_tsv_table, write_tsv_table
from ..streaming import StateTable, fold_states, liveness, monitor, reconcile, stale_sessions
from . import compiler, inputs
from .parser import parse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query, with its SQL where there is one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(**names: T.Type) -> dict:
    return {k: (F.col(k), t) for k, t in names.items()}


_scratch: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder of the session (a temporary one of this process only where none is set and the
    master is local, as in tests). What is in it goes when the process ends."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not named:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="weftline-")
        _scratch[app] = f"{named.rstrip('/')}/weftline-{uuid.uuid4().hex}"
        atexit.register(_sweep, spark, _scratch[app])
    return f"{_scratch[app]}/{uuid.uuid4().hex}"


def _sweep(spark: SparkSession, root: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        return


# --- expressions


@query("SELECT l_orderkey, l_linenumber, l_orderkey + l_partkey AS added, l_orderkey - l_partkey AS taken, l_orderkey * l_partkey AS times, (l_partkey - l_orderkey) // (l_suppkey + 1) AS quotient, (l_partkey - l_orderkey) % (l_suppkey + 1) AS rest, CAST(CAST(l_linenumber AS BIGINT) * l_linenumber * l_linenumber AS BIGINT) AS cubed FROM lineitem")
def op_arith_int(spark, sf_dir):
    at = {"o": (F.col("l_orderkey"), T.INT), "p": (F.col("l_partkey"), T.INT), "s": (F.col("l_suppkey"), T.INT), "n": (F.col("l_linenumber").cast("long"), T.INT)}
    made = {"added": "o + p", "taken": "o - p", "times": "o * p", "quotient": "(p - o) / (s + 1)", "rest": "(p - o) % (s + 1)", "cubed": "n ** 3"}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(compiler.column(e, at).alias(k) for k, e in made.items()))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_extendedprice / l_quantity AS unit, -(l_discount + 1) AS less FROM lineitem")
def op_arith_float(spark, sf_dir):
    at = {"p": (F.col("l_extendedprice"), T.FLOAT), "d": (F.col("l_discount"), T.FLOAT), "t": (F.col("l_tax"), T.FLOAT), "q": (F.col("l_quantity"), T.FLOAT)}
    made = {"charge": "p * (1 - d) * (1 + t)", "unit": "p / q", "less": "-(d + 1)"}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(compiler.column(e, at).alias(k) for k, e in made.items()))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'inf' ELSE 'finite' END AS kind, CASE WHEN event_id % 4 = 0 THEN NULL ELSE round((value + 1) / (event_id % 4), 4) END AS ratio FROM events")
def op_div_zero(spark, sf_dir):
    at = {"v": (F.col("value"), T.FLOAT), "n": (F.col("event_id"), T.INT)}
    ratio = compiler.column("(v + 1) / (n % 4)", at)
    rows = table(spark, sf_dir, "events").select("event_id", ratio.alias("r"))
    infinite = F.col("r") == float("inf")
    return rows.select("event_id", F.when(infinite, "inf").otherwise("finite").alias("kind"), F.when(~infinite, F.round("r", 4)).alias("ratio"))


@query("SELECT event_id, nullif(event_type, 'view') IS NULL AS none_same, nullif(event_type, 'view') IS NOT DISTINCT FROM nullif(event_type, 'click') AS alike, event_type < 'error' AS before FROM events")
def op_compare_null(spark, sf_dir):
    t = F.col("event_type")
    at = {"a": (F.nullif(t, F.lit("view")), T.STRING.opt()), "b": (F.nullif(t, F.lit("click")), T.STRING.opt()), "e": (t, T.STRING)}
    return table(spark, sf_dir, "events").select("event_id", *(compiler.column(e, at).alias(k) for k, e in {"none_same": "a == None", "alike": "a == b", "before": 'e < "error"'}.items()))


@query("SELECT o_orderkey, (o_orderstatus = 'F' AND o_totalprice > 100000) OR NOT (o_orderpriority <> '1-URGENT') AS flagged, CASE WHEN o_totalprice >= 200000 THEN 'large' WHEN o_totalprice >= 50000 THEN 'middle' ELSE 'small' END AS band FROM orders")
def op_logic_if(spark, sf_dir):
    at = {"s": (F.col("o_orderstatus"), T.STRING), "p": (F.col("o_totalprice"), T.FLOAT), "u": (F.col("o_orderpriority"), T.STRING)}
    made = {"flagged": '(s == "F" && p > 100000) || !(u != "1-URGENT")', "band": 'if p >= 200000 then "large" else if p >= 50000 then "middle" else "small"'}
    return table(spark, sf_dir, "orders").select("o_orderkey", *(compiler.column(e, at).alias(k) for k, e in made.items()))


@query("SELECT c_custkey, concat('customer ', c_custkey, ' in ', coalesce(nullif(c_mktsegment, 'BUILDING'), ''), '/', coalesce(nullif(c_mktsegment, 'BUILDING'), 'none'), CASE WHEN c_acctbal > 0 THEN ' +' ELSE ' -' END) AS said FROM customer")
def op_placeholder(spark, sf_dir):
    at = {"k": (F.col("c_custkey"), T.INT), "m": (F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), T.STRING.opt()), "b": (F.col("c_acctbal"), T.FLOAT)}
    return table(spark, sf_dir, "customer").select("c_custkey", compiler.column('"customer ~{k} in ~{m}/~{default="none" m}~{true=" +" false=" -" b > 0}"', at).alias("said"))


@query("SELECT c_custkey, c_name || '@' || c_custkey AS name_key, coalesce('<' || nullif(c_mktsegment, 'MACHINERY') || '>', '') AS segment FROM customer")
def op_concat(spark, sf_dir):
    at = {"n": (F.col("c_name"), T.STRING), "k": (F.col("c_custkey"), T.INT), "m": (F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")), T.STRING.opt())}
    return table(spark, sf_dir, "customer").select("c_custkey", compiler.column('n + "@" + k', at).alias("name_key"), compiler.column('"~{"<" + m + ">"}"', at).alias("segment"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag AS first_flag, l_quantity AS second_qty, 'n=' || l_linenumber AS label, CAST(l_linenumber AS BIGINT) AS looked_up FROM lineitem")
def op_literals_access(spark, sf_dir):
    at = {"f": (F.col("l_returnflag"), T.STRING), "q": (F.col("l_quantity"), T.FLOAT), "n": (F.col("l_linenumber").cast("long"), T.INT)}
    made = {"first_flag": "(f, q).left", "second_qty": "object { a: f, b: q }.b", "label": '["x", "n=~{n}"][1]', "looked_up": '{ f: n, "none": 0 }[f]'}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(compiler.column(e, at).alias(k) for k, e in made.items()))


# --- standard library


@query("SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) AS low, CAST(ceil(l_extendedprice) AS BIGINT) AS high, CAST(round(l_extendedprice) AS BIGINT) AS near FROM lineitem")
def fn_floor_ceil_round(spark, sf_dir):
    p = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", L.floor(p).alias("low"), L.ceil(p).alias("high"), L.round_(p).alias("near"))


@query("SELECT p_partkey, least(p_size, 25) AS least_size, greatest(p_retailprice, 1500.0) AS top_price FROM part")
def fn_min_max(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", L.min_(F.col("p_size"), F.lit(25)).alias("least_size"), L.max_(F.col("p_retailprice"), F.lit(1500.0), floats=True).alias("top_price"))


@query("SELECT doc_id, nullif(regexp_extract(text, '[A-Z][a-z]+ [a-z]+'), '') AS found FROM documents")
def fn_find(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", L.find(F.col("text"), "[A-Z][a-z]+ [a-z]+").alias("found"))


@query("SELECT doc_id, regexp_matches(text, '[0-9]{3}') AS digits FROM documents")
def fn_matches(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", L.matches(F.col("text"), "[0-9]{3}").alias("digits"))


@query(r"SELECT p_partkey, regexp_replace(p_name, '([a-z]+)', '<\1$>', 'g') AS name FROM part")
def fn_sub(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", L.sub(F.col("p_name"), "([a-z]+)", r"<\1$>").alias("name"))


@query("SELECT p_partkey, array_to_string(regexp_split_to_array(p_type, '[AEIOU]'), '|') AS parts, CAST(len(regexp_split_to_array(p_type, '[AEIOU]')) AS BIGINT) AS n FROM part")
def fn_split(spark, sf_dir):
    parts = L.split(F.col("p_type"), "[AEIOU]")
    return table(spark, sf_dir, "part").select("p_partkey", L.sep("|", parts).alias("parts"), L.length(parts).alias("n"))


@query("SELECT page_id, regexp_replace(list_last(string_split(rtrim(regexp_replace(url, '[?#].*$', ''), '/'), '/')), '\\.html$', '') AS base FROM pages")
def fn_basename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", L.basename(F.col("url"), ".html").alias("base"))


@query("SELECT n_nationkey, 'data/' || n_regionkey || '/' || n_name AS path FROM nation")
def fn_join_paths(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", L.join_paths(F.lit("data/"), F.col("n_regionkey").cast("string"), F.col("n_name")).alias("path"))


_BY_REGION = "SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey"


def _by_region(spark, sf_dir) -> DataFrame:
    return dataflow.gather(table(spark, sf_dir, "nation"), ["n_regionkey"], "n_nationkey", ["n_name"]).withColumnRenamed("n_name", "names")


@query("SELECT p_partkey, '|' || array_to_string(string_split(p_brand, ''), '|') || '|' AS parts FROM part")
def fn_split_empty(spark, sf_dir):
    parts = L.split(F.col("p_brand"), "")
    return table(spark, sf_dir, "part").select("p_partkey", L.sep("|", parts).alias("parts"))


@query("SELECT n_nationkey, n_name < 'J' AS there, n_name < 'J' AND n_regionkey = 1 AS deep, false AS beyond FROM nation")
def fn_contains_key_path(spark, sf_dir):
    rows = table(spark, sf_dir, "nation")
    inner = F.create_map(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.col("n_nationkey").cast("long"))
    m = F.when(F.col("n_name") < "J", F.create_map(F.lit("a"), inner)).otherwise(F.create_map(F.lit("b"), inner))
    at = {"m": (m, T.map_of(T.STRING, T.map_of(T.STRING, T.INT)))}
    made = {"there": 'contains_key(m, ["a"])', "deep": 'contains_key(m, ["a", "r1"])', "beyond": 'contains_key(m, ["a", "r1", "x"])'}
    return rows.select("n_nationkey", *(compiler.column(e, at).alias(k) for k, e in made.items()))


@query(f"SELECT n_regionkey, array_to_string(list_transform(names, lambda x: 'n-' || x), ' ') AS before, array_to_string(list_transform(names, lambda x: x || '.txt'), ' ') AS after FROM ({_BY_REGION})")
def fn_prefix_suffix(spark, sf_dir):
    return _by_region(spark, sf_dir).select("n_regionkey", L.sep(" ", L.prefix("n-", F.col("names"))).alias("before"), L.sep(" ", L.suffix(".txt", F.col("names"))).alias("after"))


@query(f"SELECT n_regionkey, array_to_string(list_transform(names, lambda x: '\"' || x || '\"'), ',') AS twice, array_to_string(list_transform(names, lambda x: '''' || x || ''''), ',') AS once FROM ({_BY_REGION})")
def fn_quote_squote(spark, sf_dir):
    return _by_region(spark, sf_dir).select("n_regionkey", L.sep(",", L.quote(F.col("names"))).alias("twice"), L.sep(",", L.squote(F.col("names"))).alias("once"))


@query("SELECT n_regionkey, array_to_string(list(coalesce(nullif(n_name, 'FRANCE'), '') ORDER BY n_nationkey), ', ') AS names FROM nation GROUP BY n_regionkey")
def fn_sep(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").withColumn("name", F.nullif(F.col("n_name"), F.lit("FRANCE")))
    return dataflow.gather(rows, ["n_regionkey"], "n_nationkey", ["name"]).select("n_regionkey", L.sep(", ", F.col("name")).alias("names"))


@query("SELECT o_orderkey, array_to_string(range(o_orderkey % 5), ',') AS upto FROM orders")
def fn_range(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", L.sep(",", L.range_(F.col("o_orderkey") % 5), T.INT).alias("upto"))


@query("SELECT l_orderkey, array_to_string(list_transform(range(CAST(ceil(len(lines) / 3.0) AS BIGINT)), lambda i: array_to_string(lines[i * 3 + 1:i * 3 + 3], '-')), '|') AS chunks FROM (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber, l_partkey, l_suppkey) AS lines FROM lineitem GROUP BY l_orderkey)")
def fn_chunk(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("lines"))
    return rows.select("l_orderkey", F.array_join(F.transform(L.chunk(F.col("lines"), 3), lambda c: F.array_join(c.cast("array<string>"), "-")), "|").alias("chunks"))


@query("SELECT r_regionkey, CAST(len(flat) AS BIGINT) AS n, array_to_string(flat, ',') AS names FROM (SELECT r_regionkey, flatten([names, [r_name], names]) AS flat FROM region JOIN (" + _BY_REGION + ") ON r_regionkey = n_regionkey)")
def fn_flatten(spark, sf_dir):
    rows = table(spark, sf_dir, "region").join(_by_region(spark, sf_dir), F.col("r_regionkey") == F.col("n_regionkey"))
    flat = L.flatten(F.array("names", F.array("r_name"), "names"))
    return rows.select("r_regionkey", L.length(flat).alias("n"), L.sep(",", flat).alias("names"))


@query("SELECT p_partkey, array_to_string([p_size, p_partkey], ',') AS first_row, array_to_string([p_size + 1, p_partkey + 1], ',') AS second_row FROM part")
def fn_transpose(spark, sf_dir):
    s, k = F.col("p_size").cast("long"), F.col("p_partkey")
    t = L.transpose(F.array(F.array(s, s + 1), F.array(k, k + 1)))
    return table(spark, sf_dir, "part").select("p_partkey", L.sep(",", t[0], T.INT).alias("first_row"), L.sep(",", t[1], T.INT).alias("second_row"))


@query(f"SELECT n_regionkey, a AS left_name, b AS right_name FROM ({_BY_REGION}), unnest(names) x(a), unnest(names) y(b)")
def fn_cross(spark, sf_dir):
    pairs = _by_region(spark, sf_dir).select("n_regionkey", F.explode(L.cross(F.col("names"), F.col("names"))).alias("p"))
    return pairs.select("n_regionkey", F.col("p.left").alias("left_name"), F.col("p.right").alias("right_name"))


@query("SELECT n_regionkey, n_nationkey, n_name FROM nation")
def fn_zip(spark, sf_dir):
    rows = dataflow.gather(table(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey")), ["n_regionkey"], "n_nationkey", ["k", "n_name"])
    pairs = rows.select("n_regionkey", F.explode(L.zip_(F.col("k"), F.col("n_name"))).alias("p"))
    return pairs.select("n_regionkey", F.col("p.left").alias("n_nationkey"), F.col("p.right").alias("n_name"))


@query("SELECT n_regionkey, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) AS keys, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def fn_unzip(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("left"), F.col("n_name").alias("right")))).alias("p"))
    both = L.unzip(F.col("p"))
    return rows.select("n_regionkey", L.sep(",", both["left"], T.INT).alias("keys"), L.sep(",", both["right"]).alias("names"))


@query("SELECT event_id, nullif(event_type, 'view') IS NULL OR event_type = 'click' AS held FROM events")
def fn_contains(spark, sf_dir):
    kind = F.nullif(F.col("event_type"), F.lit("view"))
    return table(spark, sf_dir, "events").select("event_id", L.contains(F.array(F.lit("click"), F.lit(None)), kind).alias("held"))


@query("SELECT event_id, coalesce(nullif(event_type, 'view'), nullif(event_type, 'click'), 'none') AS first_kind FROM events")
def fn_select_first(spark, sf_dir):
    t = F.col("event_type")
    return table(spark, sf_dir, "events").select("event_id", L.select_first(F.array(F.nullif(t, F.lit("view")), F.nullif(t, F.lit("click"))), F.lit("none")).alias("first_kind"))


@query("SELECT user_id, coalesce(string_agg(nullif(event_type, 'view'), ',' ORDER BY event_id), '') AS kinds FROM events GROUP BY user_id")
def fn_select_all(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("kind", F.nullif(F.col("event_type"), F.lit("view")))
    return dataflow.gather(rows, ["user_id"], "event_id", ["kind"]).select("user_id", F.array_join(L.select_all(F.col("kind")), ",").alias("kinds"))


@query("SELECT event_id, nullif(event_type, 'view') IS NOT NULL AS there, nullif(event_type, 'error') IS NULL AS gone FROM events")
def fn_defined(spark, sf_dir):
    t = F.col("event_type")
    return table(spark, sf_dir, "events").select("event_id", L.defined(F.nullif(t, F.lit("view"))).alias("there"), (~L.defined(F.nullif(t, F.lit("error")))).alias("gone"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS points, CAST(len(string_split(text, ' ')) AS BIGINT) AS pieces FROM documents")
def fn_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", L.length(F.col("text"), text=True).alias("points"), L.length(F.split("text", " ", -1)).alias("pieces"))


_EVENT_PAIRS = "SELECT user_id, event_type, event_id FROM events"


def _user_pairs(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("e"))
    return rows.select("user_id", F.transform("e", lambda x: F.struct(x["event_type"].alias("left"), x["event_id"].alias("right"))).alias("pairs"))


@query(f"SELECT user_id, event_type, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM ({_EVENT_PAIRS}) GROUP BY ALL")
def fn_collect_by_key(spark, sf_dir):
    rows = _user_pairs(spark, sf_dir).select("user_id", F.explode(L.collect_by_key(F.col("pairs"))).alias("event_type", "v"))
    return rows.select("user_id", "event_type", L.sep(",", F.col("v"), T.INT).alias("ids"))


def _nation_map(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("e"))
    return rows.select("n_regionkey", L.as_map(F.transform("e", lambda x: F.struct(x["n_name"].alias("left"), x["n_nationkey"].alias("right")))).alias("m"))


@query("SELECT n_regionkey, n_name AS name, n_nationkey AS nation FROM nation")
def fn_as_map(spark, sf_dir):
    return _nation_map(spark, sf_dir).select("n_regionkey", F.explode("m").alias("name", "nation"))


@query("SELECT n_regionkey, string_agg(n_name || '=' || n_nationkey, ';' ORDER BY n_nationkey) AS pairs FROM nation GROUP BY n_regionkey")
def fn_as_pairs(spark, sf_dir):
    return _nation_map(spark, sf_dir).select("n_regionkey", F.array_join(F.transform(L.as_pairs(F.col("m")), lambda p: F.concat(p["left"], F.lit("="), p["right"].cast("string"))), ";").alias("pairs"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def fn_keys(spark, sf_dir):
    return _nation_map(spark, sf_dir).select("n_regionkey", L.sep(",", L.keys(F.col("m"))).alias("names"))


@query("SELECT n_regionkey, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) AS numbers FROM nation GROUP BY n_regionkey")
def fn_values(spark, sf_dir):
    return _nation_map(spark, sf_dir).select("n_regionkey", L.sep(",", L.values(F.col("m")), T.INT).alias("numbers"))


@query("SELECT n_regionkey, bool_or(n_name = (SELECT min(n_name) FROM nation)) AS has_first FROM nation GROUP BY n_regionkey")
def fn_contains_key(spark, sf_dir):
    first = table(spark, sf_dir, "nation").agg(F.min("n_name").alias("f"))  # one row
    return _nation_map(spark, sf_dir).crossJoin(F.broadcast(first)).select("n_regionkey", L.contains_key(F.col("m"), F.col("f")).alias("has_first"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END::BIGINT AS level FROM orders")
def fn_enum_value(spark, sf_dir):
    level = T.enum("Status", {"F": 3, "O": 1, "P": 2})
    return table(spark, sf_dir, "orders").select("o_orderkey", L.enum_value(T.coerce(F.col("o_orderstatus"), T.STRING, level), level).alias("level"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def fn_read_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.variant_get(L.parse_json(F.col("props")), "$.k", "bigint").alias("k"))


@query("SELECT n_nationkey, '{\"name\":\"' || n_name || '\",\"none\":null,\"region\":' || n_regionkey || '}' AS json FROM nation")
def fn_write_json(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", L.format_json(F.struct(F.col("n_name").alias("name"), F.lit(None).cast("string").alias("none"), F.col("n_regionkey").alias("region"))).alias("json"))


@query("SELECT n_nationkey::VARCHAR AS key, n_name AS name, n_regionkey::VARCHAR AS region FROM nation")
def fn_read_tsv(spark, sf_dir):
    path = scratch(spark)
    write_tsv_table(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return read_tsv_table(spark, path, ["key", "name", "region"])


@query("SELECT p_name AS line, count(*) AS n FROM part GROUP BY p_name")
def fn_read_lines(spark, sf_dir):
    path = scratch(spark)
    table(spark, sf_dir, "part").select(F.col("p_name").alias("value")).write.text(path)
    return read_line_table(spark, path).groupBy("line").agg(F.count("*").alias("n"))


@query("SELECT n_regionkey, n_name AS name, n_nationkey::VARCHAR AS nation FROM nation")
def fn_read_map(spark, sf_dir):
    content = L.format_map(F.col("m"))
    return _nation_map(spark, sf_dir).select("n_regionkey", F.explode(L.parse_map(content)).alias("name", "nation"))


@query("SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer")
def fn_read_objects(spark, sf_dir):
    objects = F.array(F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment")))
    # each step is a projection of its own, so that what it uses several times is computed once
    rows = table(spark, sf_dir, "customer").select("c_custkey", objects.alias("o")).select("c_custkey", L.format_objects(F.col("o")).alias("content"))
    rows = rows.select("c_custkey", F.get(L.parse_objects(F.col("content")), F.lit(0)).alias("o"))
    return rows.select("c_custkey", F.col("o")["name"].alias("name"), F.col("o")["segment"].alias("segment"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS whole, CAST(p_size AS DOUBLE) / 2 AS half, p_size > 25 AS large FROM part")
def fn_read_scalars(spark, sf_dir):
    s = F.col("p_size")
    line = lambda c: F.concat(F.lit(" "), c.cast("string"), F.lit(" \n"))
    return table(spark, sf_dir, "part").select("p_partkey", L.parse_int(line(s)).alias("whole"), L.parse_float(line(s / 2)).alias("half"), L.parse_boolean(line(s > 25)).alias("large"))


@query("SELECT source, round(sum(n_chars) / 1000.0, 3) AS kb, round(sum(n_chars) / 1024.0, 3) AS kib FROM documents GROUP BY source")
def fn_size_units(spark, sf_dir):
    n = F.sum("n_chars")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.round(L.sized(n, "KB"), 3).alias("kb"), F.round(L.sized(n, "KiB"), 3).alias("kib"))


# --- dataflow


@query("SELECT c_custkey, string_agg(CAST(floor(o_totalprice * 2) AS BIGINT)::VARCHAR, ',' ORDER BY o_orderkey) AS doubled, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def fl_scatter_gather(spark, sf_dir):
    rows = dataflow.gather(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", ["o_totalprice"])
    flow = "workflow w { input { Array[Float] prices } scatter (p in prices) { Int d = floor(p * 2) } output { Array[Int] doubled = d Int n = length(prices) } }"
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey")).join(rows, F.col("c_custkey") == F.col("o_custkey")).withColumnRenamed("o_totalprice", "prices")
    return compiler.run(rows, flow, keep=["c_custkey"]).select("c_custkey", L.sep(",", F.col("doubled"), T.INT).alias("doubled"), "n")


@query("SELECT o_custkey, string_agg(lines, '|' ORDER BY l_orderkey) AS quantities FROM (SELECT l_orderkey, string_agg(CAST(round(l_quantity) AS BIGINT)::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS lines FROM lineitem GROUP BY l_orderkey) JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey")
def fl_nested_scatter(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("at"), L.round_(F.col("l_quantity")).alias("q"))
    lines = dataflow.gather(items, ["l_orderkey"], "at", ["q"]).select("l_orderkey", L.sep(",", F.col("q"), T.INT).alias("lines"))
    by_order = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    return dataflow.gather(by_order, ["o_custkey"], "o_orderkey", ["lines"]).select("o_custkey", L.sep("|", F.col("lines")).alias("quantities"))


@query("SELECT c_custkey, count(o_orderkey) AS n, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS orders FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 250000) ON o_custkey = c_custkey GROUP BY c_custkey")
def fl_empty_scatter(spark, sf_dir):
    few = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderkey").alias("order"))
    rows = dataflow.gather_onto(table(spark, sf_dir, "customer").select("c_custkey"), few, ["c_custkey"], "o_orderkey", ["order"])
    return rows.select("c_custkey", L.length(F.col("order")).alias("n"), L.sep(",", F.col("order"), T.INT).alias("orders"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS paid, CASE WHEN o_orderstatus <> 'F' THEN o_orderkey + 1 END AS next_key, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS said FROM orders")
def fl_conditional(spark, sf_dir):
    flow = """workflow w {
      input { String s  Float p  Int k }
      if (s == "F") { Float paid = p  String said = "done" } else if (s == "O") { String said = "open"  Int next_key = k + 1 } else { String said = "part"  Int next_key = k + 1 }
      output { Float? paid_ = paid  Int? next_key_ = next_key  String said_ = said }
    }"""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"), F.col("o_orderkey").alias("k"))
    return compiler.run(rows, flow, keep=["o_orderkey"]).select("o_orderkey", F.col("paid_").alias("paid"), F.col("next_key_").alias("next_key"), F.col("said_").alias("said"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN round(value * 2, 4) WHEN 'purchase' THEN round(value + 1, 4) END AS changed FROM events")
def fl_conditional_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    kind = F.col("event_type")
    out = dataflow.conditional_columns(rows, [(kind == "click", {"changed": F.round(F.col("value") * 2, 4)}), (kind == "purchase", {"changed": F.round(F.col("value") + 1, 4)})])
    return out.select("event_id", "changed")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN round(value * 2, 4) WHEN 'purchase' THEN round(value + 1, 4) END AS changed FROM events")
def fl_conditional_tables(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    out = dataflow.conditional(rows, [(F.col("event_type") == "click", lambda d: d.withColumn("changed", F.round(F.col("value") * 2, 4))), (F.col("event_type") == "purchase", lambda d: d.withColumn("changed", F.round(F.col("value") + 1, 4)))])
    return out.select("event_id", "changed")


@query("SELECT c_custkey, upper(substr(c_mktsegment, 1, 0)) || 'Hello, ' || c_name || '! #' || (c_custkey + 1) AS greeting, 2 * (c_custkey + 1) AS twice FROM customer")
def fl_call_chain(spark, sf_dir):
    flow = """
    workflow add { input { Int x  Int by = 1 } output { Int y = x + by } }
    workflow greet { input { String name  Int n } call add { input: x = n } output { String said = "Hello, ~{name}! #~{add.y}"  Int y = add.y } }
    workflow main { input { String name  Int n } call greet as g { name, n } call add as more { input: x = g.y, by = g.y } output { String greeting = g.said  Int twice = more.y } }"""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_custkey").alias("n"))
    return compiler.run(rows, flow, "main", keep=["c_custkey"])


@query("SELECT r_regionkey, r_name, level, factor FROM region, (VALUES ('low', 1), ('high', 2)) v(level, factor)")
def fl_input_matrix(spark, sf_dir):
    sides = dataflow.input_matrix(spark, [{"level": ["low", "high"], "factor": [1, 2]}]).withColumn("factor", F.col("factor").cast("int"))
    return table(spark, sf_dir, "region").select("r_regionkey", "r_name").crossJoin(F.broadcast(sides))


@query("SELECT r_regionkey, 'region ' || r_name AS said, 0 AS status FROM region")
def fl_task_command(spark, sf_dir):
    rows = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    got = tasks.run_tasks(rows, F.concat(F.lit("printf 'region %s\\n' '"), "r_name", F.lit("'")), max_retries=1)
    return got.select("r_regionkey", L.parse_string(F.col("task.stdout")).alias("said"), F.col("task.exit_status").alias("status"))


@query("SELECT o_orderkey, o_orderkey * 2 AS twice, 'order ' || o_orderkey AS label, o_orderkey % 2 = 0 AS even FROM orders")
def fl_workflow_text(spark, sf_dir):
    flow = """
    version 1.2
    struct Row { Int key  String label  Boolean even }
    workflow w {
      input { Int key  Int factor = 2 }
      Row r = Row { key: twice, label: "order ~{key}", even: key % 2 == 0 }
      Int twice = key * factor
      output { Int twice_ = r.key  String label = r.label  Boolean even = r.even }
    }"""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("key"))
    return compiler.run(rows, flow, keep=["o_orderkey"]).withColumnRenamed("twice_", "twice")


@query("SELECT * FROM (VALUES (0, 'ann', 3::BIGINT, 'ann,ann,ann'), (1, 'bob', 1::BIGINT, 'bob')) t(run, name, n, said)")
def fl_inputs_json(spark, sf_dir):
    doc = parse('workflow w { input { String name  Int n = 1 } scatter (i in range(n)) { String s = name } output { String name_ = name  Int n_ = n  String said = sep(",", s) } }')
    runs = [inputs.loaded('{"w.name": "ann", "w.n": 3}'), inputs.overridden({"w.name": "x"}, {"w.name": "bob"})]
    rows = inputs.table(spark, runs, doc.units["w"])
    out = compiler.run(rows, doc)
    return out.select((F.row_number().over(Window.orderBy("name_")) - 1).alias("run"), F.col("name_").alias("name"), F.col("n_").alias("n"), "said")  # as many rows as runs were written out


@query("SELECT c_custkey, c_acctbal > 0 AND c_mktsegment = 'BUILDING' AS passed, CAST((c_acctbal <= 0)::INT + (c_mktsegment <> 'BUILDING')::INT AS BIGINT) AS n_failed FROM customer")
def fl_assertions(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("positive"), F.col("c_mktsegment").alias("segment"))
    got = assertions.checked(rows, {"positive": [("Equals", True)], "segment": [("Equals", "BUILDING"), ("Defined", True)]})
    return got.select("c_custkey", "passed", L.length(F.col("failed")).alias("n_failed"))


@query("SELECT n_nationkey, 'nation ' || n_name || ' of ' || r_name AS said, CAST(len(n_name) + len(r_name) + 11 AS DOUBLE) AS bytes, 'said.txt' AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def fl_task_files(spark, sf_dir):
    flow = """
    task tell {
      input { env String region  File nation }
      command <<< mkdir -p out; printf 'nation %s of %s' "$(cat ~{nation})" "$region" > out/said.txt >>>
      output { File made = "out/said.txt"  Float bytes = size("out/said.txt")  Array[File] all = glob("**/*.txt") }
    }
    workflow w { input { File nation  String region } call tell { nation, region } output { File said = tell.all[0]  Float bytes = tell.bytes  String name = basename(tell.made) } }"""
    rows = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    return compiler.run(rows.select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region")), flow, keep=["n_nationkey"])


@query(f"SELECT n_regionkey, list_transform(names, lambda x: upper(x) || '!') AS said, CAST(len(names) AS BIGINT) AS n FROM ({_BY_REGION})")
def fl_task_scatter(spark, sf_dir):
    flow = """
    import "steps" as steps
    workflow w {
      input { Array[String] names }
      scatter (name in names) { call steps.shout { word = name }  String said = shout.out + "!" }
      output { Array[String] said_ = said  Int n = length(shout.out) }
    }"""
    steps = "task shout { input { String word } command <<< printf '%s' '~{word}' | tr a-z A-Z >>> output { String out = read_string(stdout()) } }"
    return compiler.run(_by_region(spark, sf_dir), flow, keep=["n_regionkey"], imports={"steps": steps}).withColumnRenamed("said_", "said")


@query("SELECT r_regionkey, CAST(2 AS BIGINT) AS attempt, CAST(4294967296 AS BIGINT) AS memory, CAST(3 AS BIGINT) AS code FROM region")
def fl_task_retry(spark, sf_dir):
    flow = """
    task t {
      input { Int last = 2 }
      command <<< if [ ~{task.attempt} -lt ~{last} ]; then exit 1; fi; exit 3 >>>
      output { Int attempt = task.attempt  Int memory = task.memory  Int code = task.return_code }
      requirements { max_retries: last + 1  return_codes: [0, 3]  memory: if task.attempt == 0 then "1 GiB" else "~{select_first([task.previous.memory]) * 2}" }
    }
    workflow w { call t output { Int attempt = t.attempt  Int memory = t.memory  Int code = t.code } }"""
    return compiler.run(table(spark, sf_dir, "region"), flow, keep=["r_regionkey"])


@query("SELECT n_nationkey, n_nationkey % 2 = 0 AS even, CAST(n_nationkey % 2 AS INTEGER) AS status FROM nation")
def fl_success_codes(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey")
    got = tasks.run_tasks(rows, F.concat(F.lit("exit "), (F.col("n_nationkey") % 2).cast("string")), fail=False, return_codes=[0, 2])
    return got.select("n_nationkey", F.col("task.ok").alias("even"), F.col("task.exit_status").alias("status"))


@query("SELECT c_custkey, c_custkey + 1 AS first_, c_custkey * 2 AS second_ FROM customer")
def fl_after(spark, sf_dir):
    flow = """
    workflow one { input { Int x } output { Int y = x + 1 } }
    workflow two { input { Int x } output { Int y = x * 2 } }
    workflow w { input { Int x } call two as b after a { x } call one as a { x } output { Int first_ = a.y  Int second_ = b.y } }"""
    return compiler.run(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("x")), flow, "w", keep=["c_custkey"])


@query("SELECT r_regionkey, chr(10) || '  region ' || r_name || chr(10) || 'end' AS said FROM region")
def op_multiline(spark, sf_dir):
    text = """<<<

      region ~{name}
    end
    >>>"""
    return table(spark, sf_dir, "region").select("r_regionkey", compiler.column(text, {"name": (F.col("r_name"), T.STRING)}).alias("said"))


# --- ledger: orders stand for runs, customers for sessions, lines for tasks


@query("SELECT * EXCLUDE rn FROM (SELECT event_id, user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def lg_latest_index(spark, sf_dir):
    return ledger.latest_by(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


def _runs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("run-"), "o_orderkey").alias("uuid"), F.col("o_custkey").alias("session_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))


def _sessions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("uuid"), F.col("c_mktsegment").alias("subcommand"))


@query("SELECT o_orderkey AS id, c_name AS session_uuid, c_mktsegment AS subcommand, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey WHERE concat('run-', o_orderkey) = 'run-7'")
def lg_get_run(spark, sf_dir):
    return ledger.with_session(_runs(spark, sf_dir), _sessions(spark, sf_dir), "run-7").select("id", "session_uuid", "subcommand", "status")


@query("SELECT o_orderkey AS id, c_name AS session_uuid, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 50")
def lg_list_runs(spark, sf_dir):
    rows = ledger.with_session(_runs(spark, sf_dir).where("status = 'P'"), _sessions(spark, sf_dir))
    return ledger.page(rows, [F.desc("created_at"), F.asc("id")], 100, 50).select("id", "session_uuid", "status")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
def lg_count_by_status(spark, sf_dir):
    return ledger.counts(_runs(spark, sf_dir))


@query("SELECT c_mktsegment AS subcommand, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\", count(*) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def lg_pivot_counts(spark, sf_dir):
    return ledger.pivoted_counts(ledger.with_session(_runs(spark, sf_dir), _sessions(spark, sf_dir)), ("F", "O", "P"), keys=("subcommand",))


@query("SELECT id, CASE WHEN 20 + 10 < total THEN 30 END AS next_token FROM (SELECT o_orderkey AS id, (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS total FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 10 OFFSET 20)")
def lg_paging(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))
    token = ledger.next_token(rows.count(), 10, 20)
    return ledger.page(rows, [F.asc("id")], 10, 20).withColumn("next_token", F.lit(token).cast("int"))


_BEATS = "(SELECT user_id, max(ts) AS seen FROM events GROUP BY user_id)"


@query(f"SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view') AND user_id IN (SELECT user_id FROM {_BEATS} WHERE seen < TIMESTAMP '2024-01-29 00:00:00')")
def lg_orphan_sweep(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    sessions = events.groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("heartbeat_at"), F.min("ts").alias("created_at"))
    state = F.when(F.col("event_type").isin("click", "view"), "running").otherwise("completed")
    runs = events.select("event_id", "event_type", F.col("user_id").alias("session_id"), state.alias("status"))
    return ledger.orphaned(runs, sessions, F.lit("2024-01-29 00:00:00").cast("timestamp_ntz")).select("event_id", "event_type")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def lg_upsert(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    early = F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    old = ledger.latest_by(events.where(early), ["user_id"], ["ts", "event_id"])
    return ledger.upsert(old, events.where(~early), "user_id", ["ts", "event_id"]).drop("ts")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus IN ('O', 'P') AND o_totalprice < 100000 THEN 'canceling' ELSE o_orderstatus END AS status FROM orders")
def lg_guarded_update(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), "o_totalprice")
    return ledger.transition(rows, "canceling", ("O", "P"), F.col("o_totalprice") < 100000).select("id", "status")


@query("SELECT event_id AS id, event_type AS source FROM events WHERE user_id = 3 AND event_type = 'click' ORDER BY ts, event_id LIMIT 100")
def lg_logs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("task_name"), F.col("event_type").alias("source"), F.col("ts").alias("created_at"))
    return ledger.logs(rows, "3", "click").select("id", "source")


@query("SELECT o_orderkey AS id, c_custkey AS session_id FROM orders JOIN customer ON o_custkey = c_custkey")
def lg_insert_select(spark, sf_dir):
    named = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("uuid"))
    sessions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("Customer#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("uuid"))
    return ledger.inserted(named, sessions, "session_id", "uuid").select(F.col("run").alias("id"), "session_id")


_FOLD = """SELECT user_id AS task, coalesce(arg_min(CASE WHEN event_type IN ('purchase', 'error') THEN event_type END, CASE WHEN event_type IN ('purchase', 'error') THEN (ts, event_id) END),
  arg_max(event_type, CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE -1 END)) AS status, count(*) AS n_events FROM events GROUP BY user_id"""
_STATES = {"progress": ("signup", "view", "click"), "final": ("purchase", "error")}


@query("SELECT user_id AS session, event_type AS link_path, e.event_id AS id, c_name AS run_uuid FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) e JOIN customer ON user_id = c_custkey WHERE rn = 1")
def lg_latest_with_run(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("run_id"), F.col("event_type").alias("link_path"), F.col("ts").alias("created_at"))
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("uuid"))
    return ledger.latest_index_entries(log, runs).select(F.col("run_id").alias("session"), "link_path", "id", "run_uuid")


@query("SELECT o_orderkey AS id, concat('run-', o_orderkey) AS uuid FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate, o_orderkey LIMIT 100")
def lg_runs_of_session(spark, sf_dir):
    return ledger.runs_of_session(_runs(spark, sf_dir), 7).select("id", "uuid")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey > 150 ORDER BY o_orderkey LIMIT 25")
def lg_page_after(spark, sf_dir):
    return ledger.page_after(_runs(spark, sf_dir), ["id"], [150], 25).select("id")


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 <> 0 THEN o_orderstatus WHEN o_orderstatus = 'O' THEN 'canceled' WHEN o_orderstatus = 'P' THEN 'canceling' ELSE o_orderstatus END AS status FROM orders")
def lg_cancel(spark, sf_dir):
    named = F.when(F.col("status") == "O", "queued").when(F.col("status") == "P", "running").otherwise(F.col("status"))
    runs = _runs(spark, sf_dir)
    got = ledger.cancel_requested(runs.withColumn("was", F.col("status")).withColumn("status", named), runs.where("session_id % 3 = 0"))
    return got.select("id", F.when(F.col("status").isin("canceled", "canceling"), F.col("status")).otherwise(F.col("was")).alias("status"))


@query(_FOLD)
def lg_state_fold(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("task", F.col("user_id"))
    return fold_states(events, state="event_type", **_STATES).select("task", "status", "n_events")


# --- cache


@query("SELECT doc_id, sha256('{\"p0\":\"1\",\"p1\":\"corpus\",\"p2\":\"' || lang || '\",\"p3\":' || n_chars || '}') AS key FROM documents")
def ca_cache_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", cache.cache_key(F.lit("corpus"), F.col("lang"), F.col("n_chars")).alias("key"))


def _cached(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    calls = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("key"))
    entries = table(spark, sf_dir, "documents").where("source = 'src0'").select(F.sha2(F.col("text"), 256).alias("key")).distinct()
    return calls, entries


@query("SELECT doc_id, sha256(text) AS key FROM documents WHERE text IN (SELECT text FROM documents WHERE source = 'src0')")
def ca_hits(spark, sf_dir):
    return cache.hits(*_cached(spark, sf_dir)).select("doc_id", "key")


@query("SELECT d.doc_id, sha256(d.text) AS key FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.source = 'src0' AND e.text = d.text)")
def ca_misses(spark, sf_dir):
    return cache.misses(*_cached(spark, sf_dir)).select("doc_id", "key")


@query("SELECT n_nationkey, sha256(n_name || chr(10)) AS digest, CAST(len(n_name) + 1 AS BIGINT) AS length FROM nation")
def ca_content_digest(spark, sf_dir):
    at = _nation_files(spark, sf_dir)
    digests = cache.content_digest(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(at), "strong")
    key = F.regexp_extract("path", "key=([0-9]+)", 1).cast("int").alias("n_nationkey")
    return digests.select(key, "digest").join(file_sizes(spark, at).where("path like '%.txt'").select(key, "length"), "n_nationkey")


def _nation_files(spark, sf_dir) -> str:
    """A folder with a text file for each nation, that holds its name and a line end."""
    at = scratch(spark)
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    rows.repartition("key").write.partitionBy("key").text(at)
    return at


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(n_name) + 1) AS BIGINT) AS chars FROM nation")
def fn_glob(spark, sf_dir):
    at = _nation_files(spark, sf_dir)
    held = held_files(spark, at, "*.txt").select("path", compiler.column("size(f)", {"f": (F.col("file"), T.FILE)}).alias("bytes"))
    return globbed(spark, at, "*.txt").join(held, "path").agg(F.count("*").alias("n"), F.sum("bytes").cast("long").alias("chars"))


# --- streams


@query(_FOLD)
def st_monitor(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    source = spark.read.parquet(path)
    # a stream reads folders: the table's folder, narrowed to its file where the table is one
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").parquet(_folder_of(spark, path)).withColumn("task", F.col("user_id"))
    at = scratch(spark)
    states = StateTable(f"{at}/states")
    monitor(stream, "", f"{at}/checkpoint", foreach_batch=states, state="event_type", **_STATES).awaitTermination()
    return states.read(spark).select("task", "status", "n_events")


def _folder_of(spark: SparkSession, path: str) -> str:
    """A table that is one file is taken by a pattern that only it matches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    one = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    return path.removesuffix("events.parquet") + "event[s].parquet" if one else path


@query("SELECT user_id AS session_id, last_at FROM (SELECT user_id, max(ts) AS last_at FROM events GROUP BY user_id) WHERE last_at < TIMESTAMP '2024-01-29 12:00:00'")
def st_stale_sessions(spark, sf_dir):
    beats = table(spark, sf_dir, "events").withColumnRenamed("user_id", "session_id")
    return stale_sessions(beats, F.lit("2024-01-29 12:00:00").cast("timestamp_ntz"))


@query("SELECT task, CASE WHEN status IN ('purchase', 'error') THEN status ELSE 'canceled' END AS status FROM (SELECT user_id AS task, coalesce(arg_min(event_type, (ts, event_id)) FILTER (event_type IN ('purchase', 'error')), 'none') AS status FROM events GROUP BY user_id)")
def st_reconcile(spark, sf_dir):
    final = ("purchase", "error")
    states = fold_states(table(spark, sf_dir, "events").withColumn("task", F.col("user_id")), state="event_type", progress=("signup", "view", "click"), final=final)
    return reconcile(states, final).select("task", "status")


@query("""SELECT user_id AS session_id, CAST(count(*) AS BIGINT) AS beats, min(ts) AS since FROM (
  SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS part FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 5 HOUR THEN 0 ELSE 1 END AS gap FROM events)) GROUP BY user_id, part""")
def st_liveness(spark, sf_dir):
    beats = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"))
    return liveness(beats, gap="5 hours").select("session_id", "beats", F.col("since").cast("timestamp_ntz").alias("since"))

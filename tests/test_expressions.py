"""Tables of (expression, value or fault); all good ones run in one query."""

import math

import pytest

from weftline.plans.compiler import column
from weftline.plans.parser import SyntaxFault
from weftline.types import TypeMismatch

GOOD = [
    ("1 + 2 * 3 ** 2", 19), ("2 ** 3 ** 2", 64), ("-7 / 2", -3), ("-7 % 2", -1), ("7.0 / 0.0", math.inf), ("-7.0 / 0", -math.inf), ("1 + 2.5", 3.5), ("0x1F + 017", 46),
    ("-9223372036854775808", -(2**63)), ("2 ** 62", 2**62), ("(0 - 1) ** 63", -1), ("0 ** 0", 1), ("2.0 ** 3", 8.0),
    ('"a" + 1', "a1"), ('1.5 + "x"', "1.500000x"), ('"~{1.5}|~{None}|~{true}"', "1.500000||true"), ('"~{sep=", " [1, 2]}"', "1, 2"), ('"~{true="y" false="n" false}"', "n"),
    ('"~{default="d" None}"', "d"), (r'"\t\x41B"', "\tAB"), ('"$x ${1 + 1}"', "$x 2"), ('"~{"a" + None}"', ""),
    ("true || false && false", True), ("!true", False), ("None == None", True), ("1 == 1.0", True), ("[1, 2] == [1, 2]", True), ('{"a": 1} == {"a": 1}', True), ('{"a": 1, "b": 2} == {"b": 2, "a": 1}', False),
    ('"a" < "b"', True), ("false < true", True), ("if 1 < 2 then 1 else 2.5", 1.0), ("if true then None else 1", None),
    ("[1, 2.5][0]", 1.0), ('{"a": 1, "b": 2}["b"]', 2), ('{"a": 1, "a": 2}', {"a": 2}), ("(1, 2).right", 2), ("object { a: 1 }.a", 1), ("[[1], []][1]", []),
    ("floor(-1.5)", -2), ("ceil(-1.5)", -1), ("round(-2.5)", -3), ("round(-0.5)", -1), ("round(0.49999999999999994)", 0), ("floor(0.0 / 0.0)", 0), ("round(1e300)", 2**63 - 1), ("min(1, 2)", 1), ("max(1, 2.5)", 2.5), ("max(1.0, 0.0 / 0.0)", 1.0), ("min(0.0 / 0.0, 1)", 1.0),
    ('find("abc", "b.")', "bc"), ('find("abc", "x")', None), ('matches("abc", "^b")', False), (r'sub("a1b2", "([a-z])([0-9])", "\\2\\1$")', "1a$2b$"), ('split("a,b,,", ",")', ["a", "b", "", ""]),
    ('basename("/x/y.txt", ".txt")', "y"), ('basename("https://h/a/b.c?d=/e#f")', "b.c"), ('basename("/x/y/")', "y"), ('join_paths("a/", "b")', "a/b"), ('join_paths(["a", "b", "c"])', "a/b/c"), ('join_paths("a", ["b", "c"])', "a/b/c"),
    ('prefix("p", [1, 2])', ["p1", "p2"]), ('prefix("p", [None, "x"])', ["p", "px"]), ('suffix("s", [1.0])', ["1.000000s"]), ('quote(["a"])', ['"a"']), ('squote([true])', ["'true'"]), ('sep(",", ["a", None, "b"])', "a,,b"), ('sep(",", [])', ""),
    ("range(3)", [0, 1, 2]), ("range(0)", []), ("transpose([[1, 2], [3, 4]])", [[1, 3], [2, 4]]), ("transpose([])", []), ("length(cross([1, 2], [3]))", 2), ("cross([1], [2])[0].right", 2), ("zip([1], [2])[0].left", 1), ("unzip(zip([1, 2], [3, 4])).right", [3, 4]),
    ("contains([1, None], None)", True), ("contains([1], 2)", False), ("contains([1], None)", False), ("chunk([1, 2, 3], 2)", [[1, 2], [3]]), ("chunk([], 2)", []), ("flatten([[1], [2, 3]])", [1, 2, 3]), ("select_first([None, 2])", 2), ("select_first([None], 5)", 5), ("select_all([None, 2, None, 3])", [2, 3]),
    ('length("héé")', 3), ("length([])", 0), ('length({"a": 1})', 1), ("defined(None)", False), ("as_map(as_pairs({1: 2}))", {1: 2}), ('keys({"a": 1, "b": 2})', ["a", "b"]), ("keys(object { x: 1, y: 2 })", ["x", "y"]), ('values({"a": 1})', [1]), ('contains_key({"a": 1}, "b")', False), ('contains_key(object { a: 1 }, "a")', True),
    ('collect_by_key([("a", 1), ("b", 2), ("a", 3)])', {"a": [1, 3], "b": [2]}),
    ('read_lines(write_lines(["a", ""]))', ["a", ""]), ('read_string(write_lines(["a"]))', "a"), ('read_tsv(write_tsv([["a", ""], ["c", "d"]]))', [["a", ""], ["c", "d"]]), ('read_map(write_map({"a": "b"}))', {"a": "b"}), ('read_int(write_lines([" 12 "]))', 12), ('read_float(write_lines(["1e2"]))', 100.0), ('read_boolean(write_lines(["TRUE"]))', True),
    ("read_objects(write_objects([object { a: 1, b: 2 }]))", [{"a": "1", "b": "2"}]), ("read_object(write_object(object { a: 1 })).a", "1"), ("write_json(object { a: 1, b: None })", '{"a":1,"b":null}'), ('size(write_lines(["abc"]), "KiB")', 4 / 1024), ("size(None)", 0.0), ("write_lines([])", ""),
]
FAULTS = [
    "1 / 0", "1 % 0", "9223372036854775807 + 1", "2 ** 63", "2 ** (0 - 1)", "[1][1]", "[1][-1]", '{"a": 1}["b"]', "range(-1)", "transpose([[1], [2, 3]])", "zip([1], [2, 3])", "chunk([1], 0)", "select_first([None])", 'as_map([("a", 1), ("a", 2)])',
    'join_paths("a", "/b")', 'read_int(write_lines(["x"]))', 'read_boolean(write_lines(["yes"]))', 'read_int(write_lines(["1", "2"]))', 'write_tsv([["a\\tb"]])', 'read_map(write_lines(["a\\tb", "a\\tc"]))', "-(-9223372036854775808)",
]
MISTYPED = ['1 + true', '"a" + true', '1 < "a"', "!1", "1 && true", "[1, true]", "unknown", "f(1)", "floor()", 'if 1 then 2 else 3', "None + 1", "None < 1", "object { a: 1 }.b", '{[1]: 2}', '"1" * 2', 'floor("1")', "stdout()"]


def test_values(spark):
    got = spark.range(1).select(*(column(e).alias(f"c{i}") for i, (e, _) in enumerate(GOOD))).first()

    def plain(v):
        return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v

    wrong = [(e, w, g) for (e, w), g in zip(GOOD, got) if plain(g) != w and not (isinstance(w, float) and isinstance(g, float) and math.isclose(g, w))]
    assert not wrong


@pytest.mark.parametrize("text", FAULTS)
def test_faults_when_run(spark, text):
    with pytest.raises(Exception, match=r"(?i)USER_RAISED|overflow|INVALID_ARRAY_INDEX|out of"):
        spark.range(1).select(column(text).alias("v")).collect()


@pytest.mark.parametrize("text", MISTYPED)
def test_mistyped(spark, text):
    with pytest.raises(TypeMismatch):
        column(text)


@pytest.mark.parametrize("text", ["1 +", '"a', "[1,", "99999999999999999999", "(1", "1 2", "~"])
def test_syntax(spark, text):
    with pytest.raises(SyntaxFault):
        column(text)


def test_one_branch_only(spark):
    assert spark.range(1).select(column("if true then 1 else 1 / 0").alias("v")).first().v == 1
    assert spark.range(1).select(column("false && 1 / 0 == 1").alias("v")).first().v is False

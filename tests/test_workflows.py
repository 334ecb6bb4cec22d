"""Whole workflows: inputs in, outputs out."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import tasks
from weftline.plans import inputs
from weftline.plans.compiler import run, task_options
from weftline.plans.parser import SyntaxFault, parse
from weftline.types import TypeMismatch

SOURCE = """
version 1.2  # a remark
struct P { String name  Int? n }
enum Level { Low = 1, High = 2 }
task greet {
  meta { note: "no part of the plan { \\" }" }
  input { String who }
  command <<< printf 'hi %s\\n' "~{who}" >>>
  output { String out = read_string(stdout())  Array[String] lines = read_lines(stdout()) }
  runtime { max_retries: 1 }
}
workflow sub { input { Int x } output { Int y = x + 1  Array[Int] r = range(x) } }
workflow main {
  input { Array[Int] xs  String who = "you"  Boolean flag  Int? maybe }
  scatter (x in xs) {
    Int d = x * two
    call sub { input: x = x }
    if (x > 1) { Int big = sub.y }
    scatter (z in range(x)) { Int q = z + x }
  }
  Int two = 2
  if (flag) { String said = "yes" } else { String said = "no" }
  if (flag) { Int only = 1  call sub as cond { x = 5 } }
  call greet { input: who = who }
  P p = P { name: said }
  output {
    Array[Int] ds = d  Array[Int?] bigs = big  String s = said  Int? o = only  Array[Array[Int]] qs = q  Array[Int] ys = sub.y  Int? cy = cond.y
    String g = greet.out  P pp = p  Level l = Level.High  Int lv = value(Level.High)  Boolean m = defined(maybe)
  }
}"""


def test_scatter_conditional_call_task(spark):
    rows = spark.createDataFrame([(1, [1, 2, 3], True), (2, [], False)], "id int, xs array<bigint>, flag boolean")
    a, b = run(rows, SOURCE, "main", keep=["id"]).orderBy("id").collect()
    assert (a.ds, a.bigs, a.s, a.o, a.qs, a.ys, a.cy) == ([2, 4, 6], [None, 3, 4], "yes", 1, [[1], [2, 3], [3, 4, 5]], [2, 3, 4], 6)
    assert (a.g, tuple(a.pp), a.l, a.lv, a.m) == ("hi you", ("yes", None), "High", 2, False)
    assert (b.ds, b.bigs, b.s, b.o, b.qs, b.ys, b.cy) == ([], [], "no", None, [], [], None)


def test_a_scatter_needs_no_shuffle(spark):
    rows = spark.createDataFrame([(1, [1])], "id int, xs array<bigint>")
    out = run(rows, "workflow w { input { Array[Int] xs } scatter (x in xs) { Int y = x + 1 } output { Array[Int] ys = y } }", keep=["id"])
    assert "Exchange" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize(
    "source",
    [
        "workflow w { Int a = b  Int b = a }", "workflow w { Int a = 1  Int a = 2 }", "workflow w { call w }", "workflow w { call other }", "workflow w { Int a = \"x\" }", "workflow w { scatter (x in 1) { Int y = x } }",
        "workflow w { input { Int x } output { Int y = x } }", "workflow w { if (true) { Int a = 1 } output { Int b = a } }", "task t { command <<< >>> } workflow v { call t } workflow w { scatter (x in [1]) { call v } }",
    ],
)
def test_refused(spark, source):
    with pytest.raises(TypeMismatch):
        run(spark.range(1), source, "w")


def test_null_inputs(spark):
    rows = spark.createDataFrame([(None,), (3,)], "x bigint")
    assert [r.y for r in run(rows, "workflow w { input { Int x = 7 } output { Int y = x } }").collect()] == [7, 3]
    assert [r.y for r in run(rows, "workflow w { input { Int? x } output { Int? y = x } }").collect()] == [None, 3]
    with pytest.raises(Exception, match="the input x is null"):
        run(rows, "workflow w { input { Int x } output { Int y = x } }").collect()


def test_no_runs(spark):
    rows = spark.createDataFrame([], "x bigint")
    assert run(rows, "workflow w { input { Int x } output { Int y = x } }").collect() == []


def test_inputs(spark):
    doc = parse("struct S { Int a  String? b } workflow w { input { Array[Int] xs  Map[String, Float] m = {}  Pair[Int, String]? p  S s  Int n = 1 } output { Int k = s.a } }")
    w = doc.units["w"]
    good = {"w.xs": 5, "w.m": {"a": 1}, "w.p": {"left": 1, "right": "r"}, "w.s": {"a": 4}}
    assert inputs.checked(good, w) == {"xs": [5], "m": {"a": 1.0}, "p": (1, "r"), "s": (4, None)}
    assert run(inputs.table(spark, [good], w), doc).first().k == 4
    for bad in ({"w.xs": ["a"]}, {"w.xs": [1], "w.s": {"a": 1, "c": 2}}, {"w.zzz": 1}, {"w.s": {"a": 1}}, {"w.xs": [2**63], "w.s": {"a": 1}}, {"v.xs": 1}):
        with pytest.raises(TypeMismatch):
            inputs.checked(bad, w)
    assert inputs.overridden({"a": 1}, {"a": "[1]", "b": "x"}) == {"a": [1], "b": "x"}
    assert inputs.template(doc, w)["w.n"] == "Int (has a default)"
    with pytest.raises(SyntaxFault):
        parse("workflow w { input { Int } }")


def test_retry_and_codes(spark):
    rows = spark.createDataFrame([("exit $((1 - TASK_ATTEMPT))",), ("echo out; echo err >&2; exit 3",)], "s string")
    got = rows.select(tasks.command(F.col("s"), max_retries=1).alias("t"), tasks.command(F.col("s"), return_codes=[1, 3]).alias("u")).collect()
    assert [(r.t.exit_status, r.t.attempt) for r in got] == [(0, 1), (3, 1)]
    assert [(r.u.exit_status, r.u.attempt, r.u.stdout) for r in got] == [(1, 0, ""), (3, 0, "out\n")]
    assert spark.range(1).select(tasks.succeeded(F.lit(9), "*").alias("a"), tasks.succeeded(F.lit(0), "x").alias("b"), tasks.succeeded(F.lit(2), [1, 2]).alias("c")).first() == (True, False, True)
    with pytest.raises(Exception, match="task failed"):
        tasks.run_tasks(rows, F.col("s")).collect()
    with pytest.raises(ValueError):
        tasks.command(F.col("s"), max_retries=101)


FILES = """
version 1.3
import "lib/steps.wdl" as steps alias Named as Item
task make {
  input { env String who  Int n = 2  File? given }
  Array[File] parts = [write_lines(["x", who])]
  command <<<
    for i in $(seq 1 ~{n}); do printf "$who $i" > part_$i.txt; done
    mkdir -p sub; printf '%s' "~{task.name} ~{task.attempt} ~{task.memory}" > sub/about.txt
    ~{if defined(given) then "cat ~{given} > copied" else ""}
    cat ~{sep=" " parts} ~{write_map({"a": "b"})} > lines
  >>>
  output {
    Array[File] parts_made = glob("part_*.txt")
    String about = read_string("sub/about.txt")
    File? missing = "nothing.txt"
    File? copied = "copied"
    Float bytes = size("part_1.txt")
    Array[String] names = [basename(parts_made[0]), basename("sub/about.txt")]
    Array[String] lines = read_lines("lines")
    Int code = task.return_code
  }
  requirements { memory: "1 GiB"  return_codes: [0, 3] }
  hints { max_cpu: 4  inputs: input { who: hints { short: true } } }
}
workflow main {
  input { Array[String] names  File? given }
  scatter (name in names) {
    String loud = name + "!"
    call make { who = loud, given }
    call steps.count as counted { files = make.parts_made }
    Int twice = counted.n * 2
    Item item = Item { label: "~{make.about}" }
  }
  if (length(names) > 5) { call make as never { who = "never", n = 0 } }
  output {
    Array[Array[File]] parts = make.parts_made  Array[String] abouts = make.about  Array[File?] missing = make.missing  Array[Float] bytes = make.bytes
    Array[Array[String]] bases = make.names  Array[Int] ns = counted.n  Array[Int] doubled = twice  Array[Item] items = item  Array[File?] copies = make.copied
    Array[Array[String]] lines = make.lines  String? none = never.about  Array[Int] codes = make.code
  }
}"""
STEPS = """
version 1.3
struct Named { String label }
task count { input { Array[File] files } command <<< cat ~{sep=" " files} | wc -w >>> output { Int n = read_int(stdout()) } }
"""


def test_files_and_tasks_in_a_scatter(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], "the text"), (2, [], None)], "id int, names array<string>, given string")
    a, b = run(rows, FILES, "main", keep=["id"], imports={"lib/steps.wdl": STEPS}).orderBy("id").collect()
    assert a.parts == [["a! 1", "a! 2"], ["b! 1", "b! 2"]] and a.abouts == [f"make 0 {2**30}"] * 2 and a.missing == [None, None] and a.bytes == [4.0, 4.0]
    assert a.bases == [["part_1.txt", "about.txt"]] * 2 and a.ns == [3, 3] and a.doubled == [6, 6] and [x.label for x in a["items"]] == a.abouts
    assert a.copies == ["the text"] * 2 and a.lines == [["x", "a!", "a\tb"], ["x", "b!", "a\tb"]] and a.none is None and a.codes == [0, 0]
    assert b.parts == [] and b.ns == [] and b.none is None
    doc = parse(FILES, {"lib/steps.wdl": STEPS})
    needs, hints = task_options(doc.units["make"])
    assert needs["memory"] == "1 GiB" and needs["cpu"] == 1.0 and needs["return_codes"] == [0, 3] and hints["max_cpu"] == 4 and hints["inputs"] == {"who": {"short": True}} and hints["preemptible"] == 0


def test_retries_see_the_attempt_and_what_came_before(spark):
    source = """
    task t {
      input { Int most }
      command <<<
        echo "~{task.attempt} ~{task.memory} ~{task.previous.memory}"
        exit $((2 - ~{task.attempt}))
      >>>
      output { String said = read_string(stdout())  Int attempt = task.attempt }
      requirements { max_retries: most + 1  memory: if task.attempt == 0 then "1 GiB" else "~{select_first([task.previous.memory]) * 2}" }
    }
    workflow w { input { Int most } call t { most } output { String said = t.said  Int attempt = t.attempt } }"""
    rows = spark.createDataFrame([(1,), (5,)], "most bigint")
    assert [tuple(r) for r in run(rows, source, "w").collect()] == [(f"2 {4 * 2**30} {2 * 2**30}", 2)] * 2
    with pytest.raises(Exception, match="task t failed"):
        run(spark.createDataFrame([(0,)], "most bigint"), source, "w").collect()


def test_a_task_behind_a_false_condition_is_not_run(spark, tmp_path):
    mark = tmp_path / "ran"
    source = f"""
    task t {{ input {{ String s }} command <<< echo ~{{s}} >> {mark} >>> output {{ String o = "~{{s}}!" }} }}
    workflow w {{ input {{ Boolean go }} if (go) {{ call t {{ s = "yes" }} }} else {{ call t as u {{ s = "no" }} }} output {{ String? a = t.o  String? b = u.o }} }}"""
    rows = spark.createDataFrame([(True,), (True,)], "go boolean")
    assert [tuple(r) for r in run(rows, source, "w").collect()] == [("yes!", None)] * 2
    assert set(mark.read_text().split()) == {"yes"}


def test_paths_without_content_are_refused(spark):
    with pytest.raises(Exception, match="no content is at hand for the file f.txt"):
        run(spark.range(1), 'workflow w { output { String s = read_string("f.txt") } }', "w").collect()
    with pytest.raises(Exception, match="the task made no file f.txt"):
        run(spark.range(1), 'task t { command <<< true >>> output { File f = "f.txt" } } workflow w { call t output { File f = t.f } }', "w").collect()
    with pytest.raises(TypeMismatch):
        run(spark.range(1), 'workflow w { output { Array[File] f = glob("*") } }', "w")


def test_texts_of_several_lines(spark):
    source = '''workflow w { input { String x } output { String a = <<<

    this is ~{x}

      more \\
         joined \\t|\\>\\>\\>
    >>>  String b = <<< one >>> } }'''
    assert tuple(run(spark.createDataFrame([("it",)], "x string"), source).first()) == ("\nthis is it\n\n  more joined \t|>>>", "one")


@pytest.mark.parametrize("source", ['import "no.wdl" workflow w { }', 'import "me.wdl" workflow w { }'])
def test_imports_that_fail(source):
    with pytest.raises(SyntaxFault):
        parse(source, {"me.wdl": source})


def test_memory_amounts(spark):
    got = spark.createDataFrame([("1",), ("4 GiB",), ("0.5K",), ("2MB",)], "m string").select(tasks.memory_bytes(F.col("m")).alias("b")).collect()
    assert [r.b for r in got] == [1, 4 * 2**30, 500, 2_000_000]
    with pytest.raises(Exception, match="no amount of memory"):
        spark.range(1).select(tasks.memory_bytes(F.lit("4 parrots"))).collect()


def test_files_of_inputs_are_paths_until_they_are_read(spark, tmp_path):
    from weftline.sources import held_files

    (tmp_path / "a.txt").write_text("one\ntwo\n")
    doc = parse("workflow w { input { File f  Array[File] more = [] } output { Array[String] lines = read_lines(f)  String name = basename(f)  Float n = size(more) } }")
    rows = inputs.table(spark, [{"w.f": str(tmp_path / "a.txt")}], doc.units["w"])
    with pytest.raises(Exception, match="no content is at hand"):
        run(rows, doc, contents=False).collect()
    held = held_files(spark, str(tmp_path), "*.txt").select(F.regexp_replace("path", "^file:/*", "/").alias("p"), "file")
    got = run(rows.join(held, F.col("f") == F.col("p")).select(F.col("file").alias("f")), doc, contents=False).first()
    assert (got.lines, got["name"], got.n) == (["one", "two"], "a.txt", 0.0)


def test_tasks_in_a_scatter_within_a_scatter(spark):
    source = """
    task add { input { Int x  Int y } command <<< echo $((~{x} + ~{y})) >>> output { Int sum = read_int(stdout()) } }
    workflow w {
      input { Array[Int] xs }
      scatter (x in xs) {
        call add as ten { x = x, y = 10 }
        scatter (y in range(x)) { call add { x = ten.sum, y }  Int more = add.sum + x }
      }
      output { Array[Int] tens = ten.sum  Array[Array[Int]] sums = add.sum  Array[Array[Int]] mores = more }
    }"""
    rows = spark.createDataFrame([([2, 0, 3],), ([],)], "xs array<bigint>")
    a, b = run(rows, source).collect()
    assert (a.tens, a.sums, a.mores) == ([12, 10, 13], [[12, 13], [], [13, 14, 15]], [[14, 15], [], [16, 17, 18]]) and (b.tens, b.sums) == ([], [])


def test_objects_maps_of_files_and_empty_placeholders(spark):
    source = """workflow w {
      Object o = object { a: 10, b: "x" }
      String? none = None
      output { Int a = o.a  Boolean same = as_map([("k", ("f", "g"))]) == files  String s = "is ~{select_first([none])}" }
      Map[String, Pair[File, File]] files = {"k": ("f", "g")}
    }"""
    assert tuple(run(spark.range(1), source).first()) == (10, True, "is ")

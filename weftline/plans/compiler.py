"""Compiles the workflow language to columns: one row of a table is one run of a workflow.

Top-level names become columns in the order that they need each other; scatters become `F.transform` over the elements (no
shuffle), conditionals `F.when`, calls of workflows are compiled in place and calls of tasks run their command in an Arrow
UDF. A scatter that calls tasks is compiled in layers: the scripts of all elements become one array, a UDF runs them, and the
results are zipped back to the elements. Its elements stay in their row's task, a few running at a time: for a large scatter of
tasks scatter the table (`operators.dataflow`). Types are checked while compiling. Files are paths that may carry their content
(`sources.held_files`); what a task leaves in its folder comes back with it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as L
from .. import types as T
from ..operators import tasks
from ..types import BOOLEAN, FILE, FLOAT, INT, NONE, OBJECT, STRING, TypeMismatch, coerce, common_type, file_name, has_files, once, over_files, rendered
from .parser import Call, Conditional, Decl, Document, Scatter, Unit, parse


@dataclass
class Value:
    col: Column
    type: T.Type

    def to(self, t: T.Type) -> Column:
        return coerce(self.col, self.type, t)


class Env:
    """Names in scope. `keep` holds a value back as a column of the table so that it is computed once; `hold` does so for what
    must not be computed twice, also within conditionals (none within a scatter's elements). `guard` says whether the
    conditionals around hold. `task`: what the task gave, in its outputs; `staged`: Files of its command, in its command."""

    def __init__(self, doc: Document, names: dict[str, Value] | None = None, keep=None, task: Value | None = None, active: tuple[str, ...] = (), hold=None, guard: Column | None = None, staged: list | None = None):
        self.doc, self.names, self.keep, self.task, self.active = doc, dict(names or {}), keep, task, active
        self.hold, self.guard, self.staged = hold, guard, staged

    def child(self, **names: Value) -> Env:
        return Env(self.doc, self.names | names, None, self.task, self.active, self.hold, self.guard, self.staged)

    def element(self, names: dict[str, Value]) -> Env:
        """The scope of a scatter's elements, where nothing can be held back."""
        return Env(self.doc, self.names | names, None, None, self.active)

    def bind(self, name: str, v: Value) -> None:
        if name in self.names:
            raise TypeMismatch(f"{name} is there already")
        self.names[name] = self.keep(name, v) if self.keep else v


def _expect(v: Value, *kinds: str) -> Value:
    if v.type.kind not in kinds or v.type.optional:
        raise TypeMismatch(f"{v.type} where {' or '.join(kinds)} is wanted")
    return v


def _unified(values: list[Value]) -> tuple[list[Column], T.Type]:
    t = reduce(common_type, (v.type for v in values))
    return [v.to(t) for v in values], t


def _none(t: T.Type) -> Value:
    return Value(F.lit(None).cast(T.spark_type(t)), t.opt())


def expression(e: tuple, env: Env, inside: bool = False) -> Value:
    """The value of an expression; `inside` a placeholder a null makes the whole of it empty."""
    return _FORMS[e[0]](e, env, inside)


def _name(e, env, inside):
    if e[1] not in env.names:
        raise TypeMismatch(f"no name {e[1]}")
    return env.names[e[1]]


def _string(e, env, inside):
    parts = [F.lit(p) if isinstance(p, str) else _placeholder(p, env) for p in e[1]]
    return Value(F.concat(*parts) if len(parts) > 1 else parts[0] if parts else F.lit(""), STRING)


def _placeholder(p: tuple, env: Env) -> Column:
    _, options, e = p
    v = expression(e, env, inside=True)
    if env.staged is not None and has_files(v.type):
        env.staged.append(_held_files(v))
    if "sep" in options:
        return L.sep(expression(options["sep"], env).col, _expect(v, "Array").col, v.type.args[0])
    if "true" in options or "false" in options:
        said = [expression(options[k], env).col if k in options else F.lit("") for k in ("true", "false")]
        return F.coalesce(F.when(v.col, said[0]).when(~v.col, said[1]), F.lit(""))
    text = F.lit(None).cast("string") if v.type.kind == "Union" else rendered(v.col, v.type)
    return F.coalesce(text, *([rendered(d.col, d.type)] if "default" in options and (d := expression(options["default"], env)) else []), F.lit(""))


def _held_files(v: Value) -> Column:
    """The Files within a value that carry their content, as one array."""
    if v.type.kind == "File":
        return F.array(v.col)
    if v.type.kind == "Array":
        return F.coalesce(F.flatten(F.transform(v.col, lambda x: _held_files(Value(x, v.type.args[0])))), F.array().cast("array<string>"))
    if v.type.kind == "Map":
        return _held_files(Value(F.map_values(v.col), T.array(v.type.args[1])))
    parts = [*zip(("left", "right"), v.type.args)] if v.type.kind == "Pair" else v.type.members
    return F.concat(*(_held_files(Value(v.col[n], t)) for n, t in parts if has_files(t)))


def _array(e, env, inside):
    if not e[1]:
        return Value(F.array(), T.array(T.Type("Union")))
    cols, t = _unified([expression(x, env) for x in e[1]])
    return Value(F.array(*cols), T.array(t, nonempty=True))


def _map(e, env, inside):
    if not e[1]:
        return Value(F.create_map(), T.map_of(T.Type("Union"), T.Type("Union")))
    keys, kt = _unified([expression(k, env) for k, _ in e[1]])
    values, vt = _unified([expression(v, env) for _, v in e[1]])
    if not kt.primitive:
        raise TypeMismatch(f"a key of type {kt}")
    literal = [k[1:] for k, _ in e[1] if k[0] in ("int", "boolean") or k[0] == "string" and all(isinstance(p, str) for p in k[1])]
    if len(set(map(repr, literal))) == len(e[1]):
        return Value(F.create_map(*(c for kv in zip(keys, values) for c in kv)), T.map_of(kt, vt))
    # of equal keys the last value counts, at the place of the first
    pairs = F.array(*(F.struct(k.alias("left"), v.alias("right")) for k, v in zip(keys, values)))
    names = F.array_distinct(F.array(*keys))
    return Value(F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(pairs, lambda p: p["left"] == k), -1)["right"])), T.map_of(kt, vt))


def _pair(e, env, inside):
    a, b = expression(e[1], env), expression(e[2], env)
    return Value(F.struct(a.col.alias("left"), b.col.alias("right")), T.pair(a.type, b.type))


def _object(e, env, inside):
    made = {k: expression(x, env) for k, x in e[1]}
    return Value(F.struct(*(v.col.alias(k) for k, v in made.items())), T.struct("", {k: v.type for k, v in made.items()}, "Object"))


def _struct(e, env, inside):
    t = env.doc.structs[e[1]]
    made = {k: expression(x, env) for k, x in e[2]}
    if unknown := set(made) - {k for k, _ in t.members}:
        raise TypeMismatch(f"{e[1]} has no {', '.join(sorted(unknown))}")
    have = T.struct(e[1], {k: v.type for k, v in made.items()})
    return Value(coerce(F.struct(*(v.col.alias(k) for k, v in made.items())), have, t), t)


def _if(e, env, inside):
    c = _expect(expression(e[1], env), "Boolean")
    (a, b), t = _unified([expression(x, env, inside) for x in e[2:]])
    return Value(F.when(c.col, a).otherwise(b), t)


def _index(e, env, inside):
    v, i = expression(e[1], env), expression(e[2], env)
    if v.type.kind == "Array":
        return Value(_expect(v, "Array").col[_expect(i, "Int").col.cast("int")], v.type.args[0])
    if v.type == OBJECT:
        return Value(L.lookup(v.col, i.to(STRING)), STRING)
    return Value(L.lookup(_expect(v, "Map").col, i.to(v.type.args[0])), v.type.args[1])


def _member(e, env, inside):
    if e[1][0] == "name" and e[1][1] in env.doc.enums and e[1][1] not in env.names:
        t = env.doc.enums[e[1][1]]
        if e[2] not in dict(t.choices):
            raise TypeMismatch(f"{t.name} has no choice {e[2]}")
        return Value(F.lit(e[2]), t)
    v = expression(e[1], env)
    if _promoted(v.type):
        return _of_calls(v, e[2])
    if v.type.optional:
        raise TypeMismatch(f"a member of {v.type}, which may be null")
    if v.type.kind == "Pair" and e[2] in ("left", "right"):
        return Value(v.col[e[2]], v.type.args[e[2] == "right"])
    if v.type == OBJECT:
        return Value(L.lookup(v.col, F.lit(e[2])), STRING)
    if e[2] not in dict(v.type.members):
        raise TypeMismatch(f"{v.type} has no member {e[2]}")
    return Value(v.col[e[2]], dict(v.type.members)[e[2]])


def _promoted(t: T.Type) -> bool:
    """Whether t is a call's value as seen from outside the scatters and conditionals around it."""
    return t.kind == "Call" or t.kind == "Array" and _promoted(t.args[0])


def _of_calls(v: Value, name: str) -> Value:
    """An output of a call, of each call of a scatter, or of a call that may not have been made."""
    t = v.type
    if t.kind == "Array":
        types = []

        def each(x: Column) -> Column:
            got = _of_calls(Value(x, t.args[0]), name)
            types.append(got.type)
            return got.col

        col = F.transform(v.col, each)
        out = T.array(types[0], t.nonempty)
        return Value(col, out.opt() if t.optional else out)
    if name not in dict(t.members):
        raise TypeMismatch(f"the call has no output {name}")
    out = dict(t.members)[name]
    return Value(v.col[name], out.opt() if t.optional else out)


def _not(e, env, inside):
    return Value(~_expect(expression(e[1], env), "Boolean").col, BOOLEAN)


def _negative(e, env, inside):
    v = _expect(expression(e[1], env), "Int", "Float")
    return Value(-v.col, v.type)


def _comparable(t: T.Type) -> bool:
    return t.kind != "Map" and all(map(_comparable, t.args)) and all(_comparable(m) for _, m in t.members)


def _infix(e, env, inside):
    op = e[1]
    a, b = expression(e[2], env, inside), expression(e[3], env, inside)
    if op in ("&&", "||"):
        _expect(a, "Boolean"), _expect(b, "Boolean")
        return Value(F.when(a.col, b.col).otherwise(F.lit(False)) if op == "&&" else F.when(a.col, F.lit(True)).otherwise(b.col), BOOLEAN)
    if op in ("==", "!="):
        (x, y), t = _unified([a, b])
        if t.kind == "Map":
            x, y = L.as_pairs(x), L.as_pairs(y)
            t = T.array(T.pair(*t.args))
        if not _comparable(t):
            raise TypeMismatch(f"{t} can't be compared: it holds maps")
        if has_files(t):
            x, y = (over_files(c, t, lambda f, _: file_name(f)) for c in (x, y))
        same = F.lit(True) if t.kind == "Union" else x.eqNullSafe(y)
        return Value(same if op == "==" else ~same, BOOLEAN)
    if op in ("<", "<=", ">", ">="):
        (x, y), t = _unified([a, b])
        if not t.primitive or t.optional:
            raise TypeMismatch(f"{a.type} {op} {b.type}")
        return Value({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], BOOLEAN)
    if op == "+" and "String" in (a.type.kind, b.type.kind) or op == "+" and {a.type.kind, b.type.kind} <= {"String", "File", "Directory", "Union"}:
        for v in (a, b):
            if v.type.kind == "Boolean" or not (v.type.primitive or v.type.kind == "Union") or v.type.optional and not inside:
                raise TypeMismatch(f"{a.type} + {b.type}")
        either = a.type.optional or b.type.optional
        return Value(F.concat(*(rendered(v.col, v.type).cast("string") for v in (a, b))), STRING.opt() if either else STRING)
    optional = inside and (a.type.optional or b.type.optional)
    for v in (a, b):
        if v.type.kind not in ("Int", "Float") or v.type.optional and not inside:
            raise TypeMismatch(f"{a.type} {op} {b.type}")
    floats = "Float" in (a.type.kind, b.type.kind)
    t = FLOAT if floats else INT
    x, y = (v.col.cast("double") if floats else v.col for v in (a, b))
    if op == "**":
        out = F.power(x, y) if floats else L.int_power(x, y)
    else:
        out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: L.divide(x, y, floats), "%": lambda: L.remainder(x, y, floats)}[op]()
    if optional:
        out = F.when(x.isNotNull() & y.isNotNull(), out)
    return Value(out, t.opt() if optional else t)


# --- the standard library: names to typed functions of values


def _of(n: int, *more: int):
    def check(name: str, args: list[Value]) -> None:
        if len(args) not in (n, *more):
            raise TypeMismatch(f"{name} has other parameters")

    return check


def _call(e, env, inside):
    name, args = e[1], [expression(x, env) for x in e[2]]
    if name in ("stdout", "stderr", "glob"):
        if env.task is None:
            raise TypeMismatch(f"{name} is for tasks' outputs")
        if name == "glob":
            _of(1)(name, args)
            pattern = args[0].to(STRING)
            found = F.filter(F.array_sort(F.map_keys(env.task.col["files"])), lambda k: F.rlike(k, L.glob_pattern(pattern)))
            return Value(F.transform(found, lambda k: L.held(k, env.task.col["files"][k])), T.array(FILE))
        return Value(L.held(F.lit(name), env.task.col[name]), FILE)
    if env.task is not None and args and (name.startswith("read_") or name == "size") and args[0].type.kind in ("String", "File"):
        args[0] = Value(_made(args[0].to(args[0].type if args[0].type.kind == "File" else FILE.opt() if args[0].type.optional else FILE), FILE, env), replace(args[0].type, kind="File"))
    if name not in LIBRARY:
        raise TypeMismatch(f"no function {name}")
    if name == "select_first" and inside and len(args) == 1:  # in a placeholder what fails is empty
        return Value(F.get(F.array_compact(args[0].col), F.lit(0)), _items(args[0]).opt())
    arity, f = LIBRARY[name]
    arity(name, args)
    return f(*args)


def _made(col: Column, t: T.Type, env: Env) -> Column:
    """Paths of a task's outputs as Files that carry what the task left there; without it an optional File is null."""

    def one(f: Column, t: T.Type) -> Column:
        path = F.regexp_replace(f, F.lit(r"^(\./)+"), F.lit(""))
        none = F.lit(None).cast("string") if t.optional else F.raise_error(F.concat(F.lit("the task made no file "), path))
        files = env.task.col["files"]
        return F.when(f.isNull() | L.is_held(f), f).when(F.map_contains_key(files, path), L.held(path, files[path])).otherwise(none)

    return over_files(col, t, one)


def _items(v: Value) -> T.Type:
    return _expect(v, "Array").type.args[0]


def _number(f):
    return lambda x: Value(f(x.to(FLOAT)), INT)


def _extreme(f):
    def run(a, b):
        _expect(a, "Int", "Float"), _expect(b, "Int", "Float")
        (x, y), t = _unified([a, b])
        return Value(f(x, y, t.kind == "Float"), t)

    return run


def _affix(f):
    return lambda p, a: Value(f(p.to(STRING), a.col, _items(a)), T.array(STRING, a.type.nonempty))


def _quoted(f):
    return lambda a: Value(f(a.col, _items(a)), T.array(STRING, a.type.nonempty))


def _basename(p, s=None):
    return Value(L.basename(p.to(STRING), None if s is None else s.to(STRING)), STRING)


def _join_paths(a, b=None):
    from ..functions.strings import join_path_array

    if a.type.kind == "Array":
        return Value(join_path_array(a.to(T.array(STRING))), STRING)
    if b.type.kind == "Array":
        return Value(join_path_array(F.concat(F.array(a.to(STRING)), b.to(T.array(STRING)))), STRING)
    return Value(L.join_paths(a.to(STRING), b.to(STRING)), STRING)


def _cross(a, b):
    return Value(L.cross(a.col, b.col), T.array(T.pair(_items(a), _items(b)), a.type.nonempty and b.type.nonempty))


def _zip(a, b):
    return Value(L.zip_(a.col, b.col), T.array(T.pair(_items(a), _items(b)), a.type.nonempty and b.type.nonempty))


def _unzip(a):
    x, y = _items(a).args
    return Value(L.unzip(a.col), T.pair(T.array(x), T.array(y)))


def _contains(a, v):
    t = common_type(_items(a), v.type)
    return Value(L.contains(a.to(T.array(t)), v.to(t)), BOOLEAN)


def _select_first(a, d=None):
    t = _items(a).required()
    return Value(L.select_first(a.col, None if d is None else d.to(t)), t)


def _length(v):
    if v.type.kind not in ("Array", "Map", "String", "Object") or v.type.optional:
        raise TypeMismatch(f"length of {v.type}")
    if v.type.members:
        return Value(F.lit(len(v.type.members)).cast("long"), INT)
    return Value(L.length(v.col, v.type.kind == "String"), INT)


def _keys(v):
    if v.type.members:
        return Value(F.array(*[F.lit(n) for n, _ in v.type.members]), T.array(STRING))
    return Value(L.keys(v.col), T.array(v.type.args[0] if v.type.args else STRING))


def _contains_key(v, k):
    if k.type.kind != "Array":
        return Value(_has_key(v, k.to(v.type.args[0] if v.type.kind == "Map" else STRING), None), BOOLEAN)
    keys = k.to(T.array(STRING))

    def walk(x: Value, i: int) -> Column:
        more = lambda m: F.when(F.size(keys) == i + 1, F.lit(True)).otherwise(walk(m, i + 1))
        return _has_key(x, F.get(keys, F.lit(i)), more) if x.type.kind in ("Map", "Object") or x.type.members else F.lit(False)

    return Value(F.when(F.size(keys) > 0, walk(v, 0)).otherwise(F.lit(False)), BOOLEAN)


def _has_key(v: Value, key: Column, more) -> Column:
    """Whether the key is in a map or names a member, and `more` holds for what it leads to."""
    none = F.lit(False)
    if v.type.members:
        each = ((key == n) & (v.col[n].isNotNull() if t.optional else F.lit(True)) & (more(Value(v.col[n], t)) if more else F.lit(True)) for n, t in v.type.members)
        return F.coalesce(reduce(lambda a, b: a | b, each, none), none)
    if v.type.kind == "Map" and v.type.args[0].kind != "String" and more:
        return none
    there = L.contains_key(v.col, key)
    return F.when(there, more(Value(v.col[key], v.type.args[1] if v.type.args else STRING))).otherwise(none) if more else there


def _as_map(a):
    return Value(L.as_map(a.col), T.map_of(*_items(a).args))


def _as_pairs(m):
    return Value(L.as_pairs(_expect(m, "Map").col), T.array(T.pair(*m.type.args)))


def _collect(a):
    k, v = _items(a).args
    return Value(L.collect_by_key(a.col), T.map_of(k, T.array(v, nonempty=True)))


def _value(v):
    _expect(v, "Enum")
    return Value(L.enum_value(v.col, v.type), T.type_of_literal(v.type.choices[0][1]))


def _bytes(v: Value) -> Column:
    """Bytes of the Files within a value; a String is a path."""
    t, zero = v.type, F.lit(0).cast("long")
    if t.kind in ("File", "String"):
        return F.coalesce(F.octet_length(L.file_content(v.col)).cast("long"), zero)
    if t.kind == "Array":
        return F.aggregate(F.coalesce(F.transform(v.col, lambda x: _bytes(Value(x, t.args[0]))), F.array().cast("array<bigint>")), zero, lambda a, x: a + x)
    if t.kind == "Map":
        return sum((_bytes(Value(f(v.col), T.array(x))) for f, x in zip((F.map_keys, F.map_values), t.args) if has_files(x)), zero)
    parts = [*zip(("left", "right"), t.args)] if t.kind == "Pair" else t.members
    return sum((_bytes(Value(v.col[n], m)) for n, m in parts if has_files(m)), zero)


def _size(v, u=None):
    n = F.lit(None) if v.type.kind == "Union" else _bytes(v)
    if u is None:
        return Value(L.sized(n), FLOAT)
    per = L.lookup(F.create_map(*[F.lit(x) for k, b in L.UNITS.items() for x in (k, float(b))]), u.to(STRING))
    return Value(L.sized(n) / per, FLOAT)


def _read(f, t):
    return lambda x: Value(once(L.file_content(x.to(FILE)), f), t)


def _written(content: Column) -> Value:
    """A File of content that an expression made; its name follows from the content."""
    return Value(once(content, lambda c: L.held(F.concat(F.lit("tmp/"), F.substring(F.md5(c.cast("binary")), 1, 16)), c)), FILE)


def _read_tsv(x, header=None, names=None):
    content = L.file_content(x.to(FILE))
    if header is None:
        return Value(once(content, L.parse_tsv), T.array(T.array(STRING)))
    if names is None:
        return Value(once(content, L.parse_objects), T.array(OBJECT))

    def rows(c: Column) -> Column:
        skipped = L.parse_objects(F.regexp_replace(c, F.lit(r"^[^\n]*\n?"), F.lit("")), names.col)
        return F.when(header.col, skipped).otherwise(L.parse_objects(c, names.col))

    return Value(once(content, rows), T.array(OBJECT))


def _write_tsv(a, header=None, names=None):
    return _written(L.format_tsv(a.to(T.array(T.array(STRING))), None if names is None else names.col))


def _strings_of(v: Value) -> Column:
    if v.type.members:
        return F.create_map(*(c for n, t in v.type.members for c in (F.lit(n), rendered(v.col[n], t))))
    return v.col


def _write_objects(a):
    t = _items(a)
    rows = F.transform(a.col, lambda o: _strings_of(Value(o, t)))
    return _written(L.format_objects(rows))


LIBRARY = {
    "floor": (_of(1), _number(L.floor)),
    "ceil": (_of(1), _number(L.ceil)),
    "round": (_of(1), _number(L.round_)),
    "min": (_of(2), _extreme(lambda a, b, f: L.min_(a, b))),
    "max": (_of(2), _extreme(L.max_)),
    "find": (_of(2), lambda s, p: Value(L.find(s.to(STRING), p.to(STRING)), STRING.opt())),
    "matches": (_of(2), lambda s, p: Value(L.matches(s.to(STRING), p.to(STRING)), BOOLEAN)),
    "sub": (_of(3), lambda s, p, r: Value(L.sub(s.to(STRING), p.to(STRING), r.to(STRING)), STRING)),
    "split": (_of(2), lambda s, p: Value(L.split(s.to(STRING), p.to(STRING)), T.array(STRING))),
    "basename": (_of(1, 2), _basename),
    "join_paths": (_of(1, 2), _join_paths),
    "prefix": (_of(2), _affix(L.prefix)),
    "suffix": (_of(2), _affix(L.suffix)),
    "quote": (_of(1), _quoted(L.quote)),
    "squote": (_of(1), _quoted(L.squote)),
    "sep": (_of(2), lambda s, a: Value(L.sep(s.to(STRING), a.col, _items(a)), STRING)),
    "range": (_of(1), lambda n: Value(L.range_(n.to(INT)), T.array(INT))),
    "transpose": (_of(1), lambda a: Value(L.transpose(a.col) if _items(a).args else a.col, a.type)),
    "cross": (_of(2), _cross),
    "zip": (_of(2), _zip),
    "unzip": (_of(1), _unzip),
    "contains": (_of(2), _contains),
    "chunk": (_of(2), lambda a, n: Value(L.chunk(a.col, n.to(INT)), T.array(T.array(_items(a))))),
    "flatten": (_of(1), lambda a: Value(L.flatten(a.col), T.array(_items(a).args[0]))),
    "select_first": (_of(1, 2), _select_first),
    "select_all": (_of(1), lambda a: Value(L.select_all(a.col), T.array(_items(a).required()))),
    "length": (_of(1), _length),
    "defined": (_of(1), lambda v: Value(L.defined(v.col), BOOLEAN)),
    "as_pairs": (_of(1), _as_pairs),
    "as_map": (_of(1), _as_map),
    "keys": (_of(1), _keys),
    "values": (_of(1), lambda m: Value(L.values(_expect(m, "Map").col), T.array(m.type.args[1]))),
    "contains_key": (_of(2), _contains_key),
    "collect_by_key": (_of(1), _collect),
    "value": (_of(1), _value),
    "size": (_of(1, 2), _size),
    "read_string": (_of(1), _read(L.parse_string, STRING)),
    "read_int": (_of(1), _read(L.parse_int, INT)),
    "read_float": (_of(1), _read(L.parse_float, FLOAT)),
    "read_boolean": (_of(1), _read(L.parse_boolean, BOOLEAN)),
    "read_lines": (_of(1), _read(L.parse_lines, T.array(STRING))),
    "read_tsv": (_of(1, 2, 3), _read_tsv),
    "read_map": (_of(1), _read(L.parse_map, T.map_of(STRING, STRING))),
    "read_object": (_of(1), _read(L.parse_object, OBJECT)),
    "read_objects": (_of(1), _read(L.parse_objects, T.array(OBJECT))),
    "read_json": (_of(1), _read(L.parse_json, T.Type("Union"))),
    "write_lines": (_of(1), lambda a: _written(L.format_lines(a.to(T.array(STRING))))),
    "write_tsv": (_of(1, 2, 3), _write_tsv),
    "write_map": (_of(1), lambda m: _written(L.format_map(m.to(T.map_of(STRING, STRING))))),
    "write_object": (_of(1), lambda o: _written(L.format_object(_strings_of(o)))),
    "write_objects": (_of(1), _write_objects),
    "write_json": (_of(1), lambda v: _written(L.format_json(over_files(v.col, v.type, lambda f, _: file_name(f))))),
}

_FORMS = {
    "int": lambda e, env, inside: Value(F.lit(e[1]).cast("long"), INT),
    "float": lambda e, env, inside: Value(F.lit(e[1]), FLOAT),
    "boolean": lambda e, env, inside: Value(F.lit(e[1]), BOOLEAN),
    "none": lambda e, env, inside: Value(F.lit(None), NONE),
    "name": _name, "string": _string, "array": _array, "map": _map, "pair": _pair, "object": _object, "struct": _struct, "if": _if,
    "index": _index, "member": _member, "not": _not, "negative": _negative, "infix": _infix, "call": _call,
}


def _each_member(rows: Column, name: str) -> Column:
    return F.transform(rows, lambda r: r[name])


# --- statements


def used(x) -> set[str]:
    """Names that an expression or statement takes from around it."""
    if isinstance(x, Decl):
        return used(x.expr) if x.expr else set()
    if isinstance(x, Scatter):
        return used(x.over) | (_body_used(x.body) - {x.var})
    if isinstance(x, Conditional):
        return set().union(*((used(c) if c else set()) | _body_used(b) for c, b in x.clauses))
    if isinstance(x, Call):
        return set(x.after).union(*map(used, x.inputs.values()))
    if isinstance(x, dict):
        return set().union(*map(used, x.values()))
    if isinstance(x, (list, tuple)):
        if len(x) == 2 and x[0] == "name" and isinstance(x[1], str):
            return {x[1]}
        return set().union(*map(used, x))
    return set()


def made(x) -> set[str]:
    if isinstance(x, Decl):
        return {x.name}
    if isinstance(x, Call):
        return {x.alias}
    if isinstance(x, Scatter):
        return set().union(*map(made, x.body))
    return set().union(*(made(s) for _, b in x.clauses for s in b))


def _body_used(body: list) -> set[str]:
    return set().union(*map(used, body)) - set().union(*map(made, body))


def ordered(body: list) -> list:
    """Statements in an order in which each comes after those it needs."""
    left, out = list(body), []
    while left:
        pending = set().union(*map(made, left))
        now = next((s for s in left if not used(s) & pending), None)
        if now is None:
            raise TypeMismatch(f"names need each other: {', '.join(sorted(pending))}")
        left.remove(now)
        out.append(now)
    return out


def statement(s, env: Env) -> None:
    if isinstance(s, Decl):
        v = expression(s.expr, env)
        # a record written out as an Object keeps its members' types
        t = replace(v.type, optional=s.type.optional) if s.type.kind == "Object" and v.type.members and not v.type.optional else s.type
        col = v.to(t)
        env.bind(s.name, Value(_made(col, t, env) if env.task is not None else col, t))
    elif isinstance(s, Scatter):
        over = _expect(expression(s.over, env), "Array")
        if any(_tasks_in(t, env.doc) for t in s.body):
            return layered(s, over, env)
        types: dict[str, T.Type] = {}

        def body(x: Column) -> Column:
            inner = env.element({s.var: Value(x, over.type.args[0])})
            for t in ordered(s.body):
                statement(t, inner)
            got = {n: inner.names[n] for t in s.body for n in sorted(made(t))}
            types.update({n: v.type for n, v in got.items()})
            return F.struct(*(v.col.alias(n) for n, v in got.items())) if got else F.struct(F.lit(0).alias("_"))

        gathered = F.transform(over.col, body)
        if env.keep and types:
            gathered = env.keep(f"scatter_{s.var}_{len(env.names)}", Value(gathered, NONE)).col
        for n, t in types.items():
            env.bind(n, Value(_each_member(gathered, n), T.array(t, over.type.nonempty)))
    elif isinstance(s, Conditional):
        tests, scopes, before = [], [], env.guard
        for c, b in s.clauses:
            tests.append(None if c is None else _expect(expression(c, env), "Boolean").col)
            inner = env.child()
            # a clause runs where its condition holds and none before it did
            here = F.lit(True) if c is None else F.coalesce(tests[-1], F.lit(False))
            inner.guard = here if before is None else before & here
            before = ~here if before is None else before & ~here
            for t in ordered(b):
                statement(t, inner)
            scopes.append({n: inner.names[n] for t in b for n in made(t)})
        for n in sorted(set().union(*scopes)):
            have = [sc[n] for sc in scopes if n in sc]
            t = reduce(common_type, (v.type for v in have))
            if len(have) < len(scopes) or s.clauses[-1][0] is not None:
                t = t.opt()
            out, left = None, None
            for c, sc in zip(tests, scopes):
                x = sc[n].to(t) if n in sc else _none(t).col
                if c is None:
                    left = x
                else:
                    out = F.when(c, x) if out is None else out.when(c, x)
            env.bind(n, Value(out.otherwise(left if left is not None else _none(t).col), t))
    elif isinstance(s, Call):
        env.bind(s.alias, called(s, env))
    else:
        raise TypeMismatch(f"no statement {s!r}")


def _unit(s: Call, doc: Document) -> Unit:
    if s.target not in doc.units:
        raise TypeMismatch(f"no task or workflow {s.target}")
    return doc.units[s.target]


def _tasks_in(s, doc: Document, above: tuple[str, ...] = ()) -> bool:
    """Whether a statement runs a task."""
    if isinstance(s, Call):
        u = doc.units.get(s.target)
        return u is not None and s.target not in above and (u.command is not None or any(_tasks_in(x, u.doc or doc, (*above, s.target)) for x in u.body))
    parts = s.body if isinstance(s, Scatter) else [x for _, b in s.clauses for x in b] if isinstance(s, Conditional) else []
    return any(_tasks_in(x, doc, above) for x in parts)


def _outputs(made: dict[str, Value]) -> Value:
    t = T.struct("", {k: v.type for k, v in made.items()}, "Call")
    return Value(F.struct(*(v.col.alias(k) for k, v in made.items())) if made else F.struct(F.lit(0).alias("_")), t)


def called(s: Call, env: Env) -> Value:
    unit = _unit(s, env.doc)
    if s.target in env.active:
        raise TypeMismatch(f"{s.target} calls itself")
    given = {k: expression(x, env) for k, x in s.inputs.items()}
    return _outputs(evaluated(unit, given, Env(unit.doc or env.doc, {}, None, None, (*env.active, s.target), env.hold, env.guard)))


def layered(s: Scatter, over: Value, env: Env) -> None:
    """A scatter whose body calls tasks, layer by layer: elements are structs that grow by what each statement makes."""
    if env.hold is None:
        raise TypeMismatch("a scatter that calls tasks stands in a workflow that a scatter calls: scatter the table (operators.dataflow.scatter) and call it there")
    base = F.transform(over.col, lambda x: F.struct(x.alias(s.var)))
    acc = env.hold(f"scatter_{s.var}", Value(base if env.guard is None else F.when(env.guard, base), NONE)).col
    acc, types = _layers(s.body, acc, {s.var: over.type.args[0]}, env)
    for n, t in types.items():
        if n != s.var:
            env.bind(n, Value(_each_member(acc, n), T.array(t, over.type.nonempty)))


def _layers(body: list, acc: Column, types: dict[str, T.Type], env: Env) -> tuple[Column, dict[str, T.Type]]:
    """The elements after the statements of a scatter's body, and the types of their members. Elements of a scatter within it
    are laid end to end for their own layers and put back by their outer element's place."""
    for t in ordered(body):
        types, got = dict(types), {}
        names = lambda e, types=types: {n: Value(e[n], k) for n, k in types.items()}
        kept = lambda e, types=types: [e[n].alias(n) for n in types]
        grown = lambda e, more, kept=kept: F.struct(*kept(e), *(v.col.alias(n) for n, v in more.items()))
        if isinstance(t, Call) and _unit(t, env.doc).command is not None:
            acc = _task_layer(t, acc, env, names, grown, got)
        elif isinstance(t, Scatter) and _tasks_in(t, env.doc):
            kinds: list[T.Type] = []

            def spread(e: Column, i: Column) -> Column:
                inner = _expect(expression(t.over, env.element(names(e))), "Array")
                kinds[:] = [inner.type]
                return F.transform(inner.col, lambda x: F.struct(i.alias("_at"), *(e[n].alias(n) for n in types if n != t.var), x.alias(t.var)))

            flat = env.hold(f"scatter_{t.var}", Value(F.flatten(F.transform(acc, spread)), NONE)).col
            inner_types = {n: k for n, k in types.items() if n != t.var} | {t.var: kinds[0].args[0], "_at": INT}
            flat, inner_types = _layers(t.body, flat, inner_types, env)
            new = {n: inner_types[n] for n in sorted(made(t))}

            def gathered(e: Column, i: Column) -> Column:
                mine = F.filter(flat, lambda r: r["_at"] == i)
                more = {n: Value(_each_member(mine, n), T.array(k, kinds[0].nonempty)) for n, k in new.items()}
                got.update({n: v.type for n, v in more.items()})
                return grown(e, more)

            acc = F.transform(acc, gathered)
        else:

            def step(e: Column) -> Column:
                inner = env.element(names(e))
                statement(t, inner)
                new = {n: inner.names[n] for n in sorted(made(t))}
                got.update({n: v.type for n, v in new.items()})
                return grown(e, new)

            acc = F.transform(acc, step)
        acc = env.hold(f"layer_{len(types)}", Value(acc, NONE)).col
        types |= got
    return acc, types


def _task_layer(t: Call, acc: Column, env: Env, names, grown, got: dict[str, T.Type]) -> Column:
    """Elements with the outputs of a task that each of them calls; `got` is told their type."""
    unit, scope = _unit(t, env.doc), {}

    def before(e: Column) -> Column:
        outer, inner = env.element(names(e)), Env(unit.doc or env.doc)
        bound(unit, {k: expression(x, outer) for k, x in t.inputs.items()}, inner)
        scope.update({n: v.type for n, v in inner.names.items()})
        return F.struct(task_call(unit, inner).alias("call"), _outputs(inner.names).col.alias("names"))

    ready = env.hold(f"calls_{t.alias}", Value(F.transform(acc, before), NONE)).col
    ran = env.hold(f"ran_{t.alias}", Value(tasks.commands(_each_member(ready, "call")), NONE), unit).col

    def after(e: Column, x: Column) -> Column:
        inner = Env(unit.doc or env.doc, {n: Value(x["p"]["names"][n], k) for n, k in scope.items()})
        out = _outputs(finished(unit, inner, x["r"]))
        got[t.alias] = out.type
        return grown(e, {t.alias: out})

    return F.zip_with(acc, F.zip_with(ready, ran, lambda p, r: F.struct(p.alias("p"), r.alias("r"))), after)


def bound(unit: Unit, given: dict[str, Value], env: Env) -> None:
    """Binds a unit's inputs and runs its statements."""
    if unknown := set(given) - {d.name for d in unit.inputs}:
        raise TypeMismatch(f"{unit.name} has no input {', '.join(sorted(unknown))}")
    defaults = []
    for d in unit.inputs:
        if d.name in given:
            v = given[d.name]
            if d.expr is not None and v.type.optional and not d.type.optional:
                defaults.append(Decl(d.type, d.name, ("given", v, d)))
            else:
                env.bind(d.name, Value(v.to(d.type), d.type))
        elif d.expr is not None:
            defaults.append(d)
        elif d.type.optional:
            env.bind(d.name, _none(d.type))
        else:
            raise TypeMismatch(f"{unit.name} needs the input {d.name}")
    for s in ordered([*defaults, *unit.body]):
        if isinstance(s, Decl) and s.expr[0] == "given":
            _, v, d = s.expr
            env.bind(d.name, Value(F.coalesce(v.to(d.type.opt()), expression(d.expr, env).to(d.type)), d.type))
        else:
            statement(s, env)


def evaluated(unit: Unit, given: dict[str, Value], env: Env) -> dict[str, Value]:
    """Outputs of a workflow or task for the given inputs, in the order in which they are declared."""
    bound(unit, given, env)
    if unit.command is None:
        for d in ordered(unit.outputs):
            statement(d, env)
        return {d.name: env.names[d.name] for d in unit.outputs}
    if env.hold is None:
        raise TypeMismatch(f"the task {unit.name} is called in a scatter within a scatter or by a workflow there: scatter the table (operators.dataflow.scatter) and call it there")
    call = task_call(unit, env)
    ran = F.get(tasks.commands(F.array(call if env.guard is None else F.when(env.guard, call))), F.lit(0))
    return finished(unit, env, env.hold(f"task_{unit.name}", Value(F.array(ran), NONE), unit).col[0])


def _settings(unit: Unit) -> dict[str, tuple]:
    return {tasks.RENAMED.get(k, k): e for k, e in unit.settings.items()}


def _uses_task(e) -> bool:
    return "task" in used(e)


def _resources(unit: Unit, env: Env, attempt: Column) -> Column:
    """cpu and memory (bytes) of an attempt; where they follow from the attempt before, of all attempts up to it."""
    asked, kinds = _settings(unit), {"cpu": FLOAT.opt(), "memory": INT.opt()}

    def at(i: Column, previous: Column) -> Column:
        inner = env.child(task=Value(F.struct(i.cast("long").alias("attempt"), previous.alias("previous")), T.struct("", {"attempt": INT, "previous": T.struct("", kinds)})))
        cpu, memory = F.lit(tasks.CPU), F.lit(tasks.MEMORY).cast("long")
        if "cpu" in asked:
            cpu = expression(asked["cpu"], inner).to(FLOAT)
        if "memory" in asked:
            v = expression(asked["memory"], inner)
            memory = v.to(INT) if v.type.kind == "Int" else tasks.memory_bytes(v.to(STRING))
        return F.struct(cpu.cast("double").alias("cpu"), memory.cast("long").alias("memory"))

    none = F.struct(F.lit(None).cast("double").alias("cpu"), F.lit(None).cast("long").alias("memory"))
    if not any(_uses_task(asked[k]) for k in kinds if k in asked):
        return at(attempt, none)
    return F.aggregate(F.sequence(F.lit(0), attempt.cast("int")), none, lambda before, i: at(i, before))


def _constant(x: object) -> Value | None:
    """A value of a meta section; lists have no place in the record."""
    if isinstance(x, dict):
        inner = {k: v for k, y in x.items() if (v := _constant(y)) is not None}
        return Value(F.struct(*(v.col.alias(k) for k, v in inner.items())), T.struct("", {k: v.type for k, v in inner.items()}, "Object")) if inner else None
    if x is None or isinstance(x, list):
        return None
    return Value(F.lit(x).cast("long") if type(x) is int else F.lit(x), T.type_of_literal(x))


def _task_record(unit: Unit, env: Env, attempt: Column, return_code: Column | None) -> Value:
    """`task` as a command and the outputs see it."""
    asked = _settings(unit)
    needs = _resources(unit, env, attempt)
    none = F.struct(F.lit(None).cast("double").alias("cpu"), F.lit(None).cast("long").alias("memory"))
    previous = F.when(attempt > 0, _resources(unit, env, F.greatest(attempt - 1, F.lit(0)))).otherwise(none)
    container = expression(asked["container"], env) if "container" in asked else None
    texts = F.array().cast("array<string>")
    made_ = {
        "name": Value(F.lit(unit.name), STRING), "id": Value(F.lit(unit.name), STRING), "attempt": Value(attempt.cast("long"), INT), "cpu": Value(needs["cpu"], FLOAT), "memory": Value(needs["memory"], INT),
        "container": Value(F.lit(None).cast("string"), STRING.opt()) if container is None else Value(container.col if container.type.kind != "Array" else F.get(container.col, F.lit(0)), STRING.opt()),
        "gpu": Value(texts, T.array(STRING)), "fpga": Value(texts, T.array(STRING)), "disks": Value(F.create_map().cast("map<string,bigint>"), T.map_of(STRING, INT)),
        "end_time": Value(F.lit(None).cast("long"), INT.opt()), "return_code": Value((F.lit(None) if return_code is None else return_code).cast("long"), INT.opt() if return_code is None else INT),
        "max_retries": Value((expression(asked["max_retries"], env).to(INT) if "max_retries" in asked and not _uses_task(asked["max_retries"]) else F.lit(0)).cast("long"), INT),
        "previous": Value(previous, T.struct("", {"cpu": FLOAT.opt(), "memory": INT.opt()})),
    }
    if (meta := _constant(unit.meta)) is not None:
        made_["meta"] = meta
    return Value(F.struct(*(v.col.alias(k) for k, v in made_.items())), T.struct("", {k: v.type for k, v in made_.items()}, "Object"))


def _localised(f: Column, _: T.Type) -> Column:
    """A File as the task's folder has it: under a name of its own, with its own last segment."""

    def local(x: Column) -> Column:
        name = file_name(x)
        place = F.concat(F.lit("inputs/"), F.substring(F.md5(name.cast("binary")), 1, 8), F.lit("/"), L.basename(name))
        return F.when(L.is_held(x), L.held(place, L.file_content(x))).otherwise(x)

    return once(f, local)


def task_call(unit: Unit, env: Env) -> Column:
    """The call of a task whose inputs and declarations are bound in env: scripts, Files, variables, retries and codes."""
    asked, staged = _settings(unit), []
    first = env.child(task=_task_record(unit, env, F.lit(0), None)) if any(map(_uses_task, asked.values())) else env
    retries = expression(asked["max_retries"], first).to(INT) if "max_retries" in asked else F.lit(0)
    codes = F.lit("0")
    if "return_codes" in asked:
        v = expression(asked["return_codes"], first)
        codes = F.when(v.col == "*", "*").otherwise("") if v.type.kind == "String" else F.array_join(v.col.cast("array<string>"), ",") if v.type.kind == "Array" else v.to(INT).cast("string")
    local = {n: Value(over_files(v.col, v.type, _localised), v.type) for n, v in env.names.items()}
    staged = [_held_files(v) for v in local.values() if has_files(v.type)]

    def script(attempt: Column) -> Column:
        inner = Env(env.doc, local, None, None, env.active, staged=staged)
        if _uses_task(unit.command):
            inner.names["task"] = _task_record(unit, env, attempt, None)
        return _string(unit.command, inner, False).col

    scripts = F.transform(F.sequence(F.lit(0), F.greatest(retries.cast("int"), F.lit(0))), lambda a: script(a)) if _uses_task(unit.command) else F.array(script(F.lit(0)))
    names = {d.name for d in [*unit.inputs, *unit.body] if isinstance(d, Decl) and d.env}
    pairs = [x for n in sorted(names) for x in (F.lit(n), rendered(local[n].col, local[n].type))]
    files = F.array_compact(F.concat(*staged)) if staged else None
    return tasks.call_of(scripts, files, F.create_map(*pairs) if pairs else None, retries, codes)


def _failed(unit: Unit, ran: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"task {unit.name} failed: "), ran["stderr"]))


def _all_fine(unit: Unit, runs: Column) -> Column:
    return F.forall(F.coalesce(runs, F.array()), lambda r: F.when(r.isNull() | r["ok"], True).otherwise(_failed(unit, r).cast("boolean")))


def finished(unit: Unit, env: Env, ran: Column) -> dict[str, Value]:
    """A task's outputs, from what its command gave."""
    env.task = Value(F.when(ran.isNull() | ran["ok"], ran).otherwise(_failed(unit, ran)), NONE)
    if any(map(_uses_task, unit.outputs)):
        env.names["task"] = _task_record(unit, env.child(), ran["attempt"], ran["exit_status"])
    for d in ordered(unit.outputs):
        statement(d, env)
    return {d.name: env.names[d.name] for d in unit.outputs}


def plain(e: tuple) -> object:
    """A literal expression's value: numbers, truths, texts, arrays, pairs, maps and records of them."""
    kind = e[0]
    if kind in ("int", "float", "boolean"):
        return e[1]
    if kind == "none":
        return None
    if kind == "negative":
        return -plain(e[1])
    if kind == "string" and all(isinstance(p, str) for p in e[1]):
        return "".join(e[1])
    if kind == "array":
        return [plain(x) for x in e[1]]
    if kind == "map":
        return {plain(k): plain(x) for k, x in e[1]}
    if kind == "object":
        return {k: plain(x) for k, x in e[1]}
    raise TypeMismatch("a literal is wanted")


def task_options(unit: Unit) -> tuple[dict[str, object], dict[str, object]]:
    """A task's requirements and hints as plain values, with what holds where it says nothing; for whoever sizes executors.
    Expressions that aren't literals are left out: they are known only where the task runs."""

    def known(asked: dict[str, tuple]) -> dict[str, object]:
        out = {}
        for k, e in asked.items():
            try:
                out[k] = plain(e)
            except TypeMismatch:
                continue
        return out

    needs = {"cpu": tasks.CPU, "memory": tasks.MEMORY, "gpu": False, "fpga": False, "disks": "1 GiB", "container": None, "max_retries": 0, "return_codes": 0}
    return needs | known(_settings(unit)), {"preemptible": 0, "cacheable": True} | known(unit.hints)


def _contents(t: T.Type, name: str):
    """Table columns of type File: a path with its content stays, other text is a content without a path."""
    return lambda f, _: once(f, lambda x: F.when(L.is_held(x), x).otherwise(L.held(F.lit(name), x)))


def _released(f: Column, _: T.Type) -> Column:
    """A File as a table shows it: its content, or its path where the content isn't at hand."""
    return once(f, lambda x: F.when(L.is_held(x), L.file_content(x)).otherwise(x))


def run(rows: DataFrame, source: str | Document, workflow: str | None = None, keep: list[str] | None = None, imports: dict[str, str] | None = None, contents: bool = True) -> DataFrame:
    """One run of the workflow a row: its inputs are the columns of their names (or their defaults), its outputs become
    columns. Columns named in `keep` go along. Columns of Files hold contents, or paths with contents as
    `sources.held_files` gives them; without `contents` plain text is a path (as in inputs read from JSON). Files among the
    outputs come as contents, or as paths where those aren't at hand. `imports`: texts of imported documents."""
    doc = parse(source, imports) if isinstance(source, str) else source
    flows = [u for n, u in doc.units.items() if u.command is None and "." not in n]
    unit = doc.units[workflow] if workflow else flows[-1] if flows else next(iter(doc.units.values()))
    state = {"df": rows}

    def hold(name: str, v: Value, of: Unit | None = None) -> Value:
        """`of`: the task whose runs these are; they are made whether or not an output is asked for."""
        at = f"_w_{len(state)}_{name}"
        state[at] = of
        state["df"] = state["df"].withColumn(at, v.col)
        return Value(F.col(at), v.type)

    kinds = {f.name: T.of_spark(f.dataType, f.nullable) for f in rows.schema if f.name in {d.name for d in unit.inputs}}
    given = {}
    for d in unit.inputs:
        if d.name in kinds:
            t = kinds[d.name]
            # a table's columns are often nullable without holding nulls: a null where none may be fails when its row is computed
            sure = t.optional and not d.type.optional and d.expr is None
            col = T.require(F.col(d.name).isNotNull(), F.col(d.name), f"the input {d.name} is null") if sure else F.col(d.name)
            have = _loosened(t, d.type).required() if sure else _loosened(t, d.type)
            given[d.name] = Value(over_files(col, have, _contents(have, d.name)) if contents else col, have)
    outputs = evaluated(unit, given, Env(doc, {}, hold, None, (unit.name,), hold))
    out = state.pop("df")
    for at, unit in state.items():
        if unit is not None:
            out = out.where(_all_fine(unit, F.col(at)))
    return out.select(*(keep or []), *(over_files(v.col, v.type, _released).alias(n) for n, v in outputs.items()))


def _loosened(have: T.Type, want: T.Type) -> T.Type:
    """The column's type with inner nullability as wanted (tables rarely say that elements aren't null)."""
    if have.kind == "String" and want.kind == "File":
        return replace(have, kind="File")
    if have.kind == want.kind and have.args:
        return replace(have, args=tuple(replace(_loosened(a, b), optional=b.optional) for a, b in zip(have.args, want.args)))
    if have.kind == want.kind and have.kind in ("Array", "Pair", "Map"):
        return have
    if have.members and want.members:
        w = dict(want.members)
        return replace(have, members=tuple((n, replace(_loosened(t, w[n]), optional=w[n].optional) if n in w else t) for n, t in have.members))
    return have


def column(text: str, env: dict[str, tuple[Column, T.Type]] | None = None, document: Document | None = None) -> Column:
    """The column of one expression over named columns; columns of type File hold contents, and a File comes as its content."""
    from .parser import parse_expression

    doc = document or Document()
    names = {k: Value(over_files(c, t, _contents(t, k)), t) for k, (c, t) in (env or {}).items()}
    v = expression(parse_expression(text, doc), Env(doc, names))
    return over_files(v.col, v.type, _released)


__all__ = ["LIBRARY", "Env", "Value", "column", "expression", "ordered", "run"]

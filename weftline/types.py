"""The value model and how it lies in Spark: primitives, arrays, pairs, maps, structs, objects, enums and optionals."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

PRIMITIVES = ("Boolean", "Int", "Float", "String", "File", "Directory")


class TypeMismatch(ValueError):
    """An expression or input whose type doesn't fit; found before anything runs."""


@dataclass(frozen=True)
class Type:
    """kind: a primitive, Array, Pair, Map, Struct, Object, Enum, Call or Union (the type of None and of untyped JSON)."""

    kind: str
    args: tuple[Type, ...] = ()
    optional: bool = False
    nonempty: bool = False
    name: str = ""
    members: tuple[tuple[str, Type], ...] = ()
    choices: tuple[tuple[str, object], ...] = ()

    @property
    def primitive(self) -> bool:
        return self.kind in PRIMITIVES or self.kind == "Enum"

    def required(self) -> Type:
        return replace(self, optional=False)

    def opt(self) -> Type:
        return replace(self, optional=True)

    def __str__(self) -> str:
        inner = f"[{', '.join(map(str, self.args))}]" if self.args else ""
        return (self.name or self.kind) + inner + "+" * self.nonempty + "?" * self.optional


BOOLEAN, INT, FLOAT, STRING, FILE, DIRECTORY = map(Type, PRIMITIVES)
NONE = Type("Union", optional=True)
#: A map of strings, as readers of tab-separated objects give; its members are looked up by name at run time.
OBJECT = Type("Object")


def array(of: Type, nonempty: bool = False) -> Type:
    return Type("Array", (of,), nonempty=nonempty)


def pair(left: Type, right: Type) -> Type:
    return Type("Pair", (left, right))


def map_of(key: Type, value: Type) -> Type:
    return Type("Map", (key, value))


def struct(name: str, members: dict[str, Type], kind: str = "Struct") -> Type:
    return Type(kind, name=name, members=tuple(members.items()))


def enum(name: str, choices: dict[str, object]) -> Type:
    """Choices' values share a common type; the Spark value of an enum is the choice's name."""
    inner = [type_of_literal(v) for v in choices.values()]
    for t in inner[1:]:
        common_type(inner[0], t)
    return Type("Enum", name=name, choices=tuple(choices.items()))


def type_of_literal(v: object) -> Type:
    for kind, t in ((bool, BOOLEAN), (int, INT), (float, FLOAT), (str, STRING)):
        if isinstance(v, kind):
            return t
    raise TypeMismatch(f"no type for {v!r}")


def spark_type(t: Type) -> S.DataType:
    if t.primitive:
        return {"Boolean": S.BooleanType(), "Int": S.LongType(), "Float": S.DoubleType()}.get(t.kind, S.StringType())
    if t.kind == "Array":
        return S.ArrayType(spark_type(t.args[0]), t.args[0].optional)
    if t.kind == "Pair":
        return S.StructType([S.StructField(n, spark_type(x), True) for n, x in zip(("left", "right"), t.args)])
    if t.kind == "Map":
        return S.MapType(spark_type(t.args[0]), spark_type(t.args[1]), t.args[1].optional)
    if t.members or t.kind in ("Struct", "Call"):
        return S.StructType([S.StructField(n, spark_type(x), True) for n, x in t.members])
    return S.MapType(S.StringType(), S.StringType()) if t.kind == "Object" else S.NullType()


def of_spark(t: S.DataType, nullable: bool = False) -> Type:
    """The model's type of a column; decimals, dates and times have none and raise."""
    if isinstance(t, S.ArrayType):
        out = array(of_spark(t.elementType, t.containsNull))
    elif isinstance(t, S.MapType):
        out = map_of(of_spark(t.keyType), of_spark(t.valueType, t.valueContainsNull))
    elif isinstance(t, S.StructType):
        members = {f.name: of_spark(f.dataType, f.nullable) for f in t}
        out = pair(*members.values()) if [*members] == ["left", "right"] else struct("", members, "Object")
    else:
        known = ((S.BooleanType, BOOLEAN), (S.IntegralType, INT), (S.FractionalType, FLOAT), (S.StringType, STRING), (S.NullType, NONE))
        out = next((x for k, x in known if isinstance(t, k) and not isinstance(t, S.DecimalType)), None)
        if out is None:
            raise TypeMismatch(f"{t.simpleString()} has no counterpart in the value model")
    return out.opt() if nullable else out


def coercible(a: Type, b: Type) -> bool:
    """Whether a value of type a may stand where b is wanted. Optional never becomes required; strings never become numbers."""
    if a.kind == "Union":
        return not a.optional or b.optional or b.kind == "Union"
    if b.kind == "Union":
        return True
    if a.optional and not b.optional:
        return False
    pairs = {("Int", "Float"), ("String", "File"), ("File", "String"), ("String", "Directory"), ("Directory", "String"), ("String", "Enum"), ("Enum", "String")}
    if (a.kind, b.kind) in pairs:
        return True
    if a.kind == b.kind and a.kind in PRIMITIVES:
        return True
    if a.kind == b.kind == "Enum":
        return a.choices == b.choices
    if a.kind == b.kind and a.kind in ("Array", "Pair", "Map"):
        return all(map(coercible, a.args, b.args))
    if a.members and b.kind in ("Struct", "Call", "Object"):
        if not b.members:
            return True
        have, want = dict(a.members), dict(b.members)
        return set(have) <= set(want) and all(coercible(have[k], t) if k in have else t.optional for k, t in want.items())
    if a.kind == "Object" and not a.members:
        return b.kind in ("Object", "Map", "Struct")
    if a.members and b.kind == "Map":
        return coercible(STRING, b.args[0]) and all(coercible(t, b.args[1]) for _, t in a.members)
    if a.kind == "Map" and b.kind == "Struct":
        return coercible(a.args[0], STRING) and all(coercible(a.args[1], t) for _, t in b.members)
    return a.kind == "Map" and b.kind == "Object" and coercible(a.args[0], STRING)


def common_type(a: Type, b: Type) -> Type:
    """The type of array elements, of both branches of an `if` and the like."""
    if a.kind == "Union":
        return b.opt() if a.optional else b
    if b.kind == "Union":
        return a.opt() if b.optional else a
    either = a.optional or b.optional
    for x, y in ((a, b), (b, a)):
        if coercible(x.required(), y.required()):
            return y.opt() if either else y.required()
    if a.kind == b.kind and a.kind in ("Array", "Pair", "Map"):
        return replace(a, args=tuple(map(common_type, a.args, b.args)), optional=either, nonempty=a.nonempty and b.nonempty)
    raise TypeMismatch(f"{a} and {b} have no type in common")


#: A File is its path; one whose content is at hand has it behind this mark.
MARK = "\0"


def file_name(col: Column) -> Column:
    """The path of a File."""
    return F.substring_index(col, MARK, 1)


def once(value: Column, f) -> Column:
    """f(value), with the value worked out once however often f names it."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))  # a lambda of one parameter, whatever f's defaults


def has_files(t: Type) -> bool:
    return t.kind == "File" or any(map(has_files, t.args)) or any(has_files(m) for _, m in t.members)


def over_files(col: Column, t: Type, f) -> Column:
    """A value with f(file, its type) in place of each File within it (keys of maps are left alone)."""
    if not has_files(t):
        return col
    if t.kind == "File":
        return f(col, t)
    if t.kind == "Array":
        return F.transform(col, lambda x: over_files(x, t.args[0], f))
    if t.kind == "Map":
        return F.transform_values(col, lambda _, v: over_files(v, t.args[1], f))
    parts = zip(("left", "right"), t.args) if t.kind == "Pair" else t.members
    return F.when(col.isNotNull(), F.struct(*(over_files(col[n], x, f).alias(n) for n, x in parts)))


def require(ok: Column, value: Column, message: str | Column) -> Column:
    """value where ok holds; else (and where ok is null) the query fails with the message when the row is computed."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message) if isinstance(message, str) else message))


def coerce(col: Column, a: Type, b: Type) -> Column:
    """A column of type a as one of type b; raises TypeMismatch if a can't be b."""
    if not coercible(a, b):
        raise TypeMismatch(f"{a} where {b} is wanted")
    if a.kind == "Union" and b.kind != "Union":
        return col.cast(spark_type(b))  # a null, or a variant
    if a.kind == "Int" and b.kind == "Float":
        return col.cast("double")
    if a.kind == "File" and b.kind != "File":
        return file_name(col)
    if a.kind == "String" and b.kind == "Enum":
        known = col.isin([c for c, _ in b.choices])
        return require(known | col.isNull() if b.optional else known, col, f"not a choice of {b.name}")
    if a.kind == "Array" and b.kind == "Array":
        (x,), (y,) = a.args, b.args
        out = col if same_layout(x, y) else F.transform(col, lambda v: coerce(v, x, y))
        return require((F.size(out) > 0) | (out.isNull() if b.optional else F.lit(False)), out, "empty array where one element at least is wanted") if b.nonempty and not a.nonempty else out
    if a.kind == "Pair" and not same_layout(a, b):
        return F.when(col.isNotNull(), F.struct(*(coerce(col[n], x, y).alias(n) for n, x, y in zip(("left", "right"), a.args, b.args))))
    if a.kind == "Map" and b.kind == "Map" and not same_layout(a, b):
        entry = lambda e: F.struct(coerce(e["key"], a.args[0], b.args[0]).alias("key"), coerce(e["value"], a.args[1], b.args[1]).alias("value"))
        return F.map_from_entries(F.transform(F.map_entries(col), entry))
    if a.members and b.members and not same_layout(a, b):
        have = dict(a.members)
        return F.when(col.isNotNull(), F.struct(*((coerce(col[n], have[n], t) if n in have else F.lit(None).cast(spark_type(t))).alias(n) for n, t in b.members)))
    if a.members and b.kind == "Map":
        return F.when(col.isNotNull(), F.create_map(*(x for n, t in a.members for x in (F.lit(n), coerce(col[n], t, b.args[1])))))
    if a.kind in ("Map", "Object") and not a.members and b.kind == "Struct":
        value = a.args[1] if a.args else STRING
        part = lambda n, t: F.when(F.map_contains_key(col, n), coerce(col[n], value, t)).otherwise(F.lit(None) if t.optional else F.raise_error(F.lit(f"no member {n} for {b.name}")))
        return require(F.size(F.array_except(F.map_keys(col), F.array(*[F.lit(n) for n, _ in b.members]))) == 0, F.struct(*(part(n, t).alias(n) for n, t in b.members)), f"members that {b.name} doesn't have")
    return col


def same_layout(a: Type, b: Type) -> bool:
    """Whether a's Spark value is b's without any change or check."""
    if b.kind == "Enum" and a.kind != "Enum" or a.kind == "File" and b.kind != "File" or b.nonempty and not a.nonempty:
        return False
    if a.kind == "Union" or b.kind == "Union":
        return a.kind == b.kind
    x, y = spark_type(a).simpleString(), spark_type(b).simpleString()
    return x == y and all(map(same_layout, a.args, b.args)) and all(same_layout(m, n) for (_, m), (_, n) in zip(a.members, b.members))


def rendered(col: Column, t: Type) -> Column:
    """A primitive as the text that string interpolation gives; floats with six decimals. Null stays null."""
    if t.kind == "Float":
        return F.when(F.isnan(col), "NaN").when(F.abs(col) == F.lit(float("inf")), F.when(col > 0, "inf").otherwise("-inf")).otherwise(F.format_string("%.6f", col)) if not t.optional else F.when(col.isNotNull(), rendered(col, t.required()))
    if t.kind == "File":
        return file_name(col)
    if t.primitive or t.kind == "Union":
        return col.cast("string")
    raise TypeMismatch(f"{t} can't be put into a string")

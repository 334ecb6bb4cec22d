"""Inputs of a run as JSON or YAML: dotted names, checked against the declared types, as one-row tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from .. import types as T
from ..types import TypeMismatch
from .parser import Document, Unit


def loaded(text: str) -> dict:
    """A JSON object; YAML where the yaml library is installed."""
    try:
        out = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError:
            raise ValueError("not JSON, and no YAML library is here") from None
        out = yaml.safe_load(text)
    if not isinstance(out, dict):
        raise ValueError("inputs are an object")
    return out


def value(x: object, t: T.Type, where: str) -> object:
    """A JSON value as a Python value of the type; what doesn't fit raises."""
    fault = TypeMismatch(f"{where}: {json.dumps(x)} where {t} is wanted")
    if x is None:
        if t.optional:
            return None
        raise fault
    if t.kind == "Array":
        items = x if isinstance(x, list) else [x]  # one value stands for an array of it
        if t.nonempty and not items:
            raise fault
        return [value(v, t.args[0], f"{where}[{i}]") for i, v in enumerate(items)]
    if t.kind == "Pair":
        parts = (x.get("left"), x.get("right")) if isinstance(x, dict) and set(x) == {"left", "right"} else None
        if parts is None:
            raise fault
        return tuple(value(v, a, f"{where}.{n}") for v, a, n in zip(parts, t.args, ("left", "right")))
    if t.kind == "Map":
        if not isinstance(x, dict):
            raise fault
        return {value(_key(k, t.args[0]), t.args[0], where): value(v, t.args[1], f"{where}.{k}") for k, v in x.items()}
    if t.kind in ("Struct", "Call"):
        names = dict(t.members)
        if not isinstance(x, dict) or set(x) - set(names):
            raise fault
        return tuple(value(x.get(n), m, f"{where}.{n}") for n, m in names.items())
    if t.kind == "Object":
        if not isinstance(x, dict):
            raise fault
        return {k: v if isinstance(v, str) else json.dumps(v) for k, v in x.items()}
    if t.kind == "Enum" and x in dict(t.choices):
        return x
    if t.kind == "Boolean" and isinstance(x, bool):
        return x
    if t.kind == "Int" and isinstance(x, int) and not isinstance(x, bool) and -(2**63) <= x < 2**63:
        return x
    if t.kind == "Float" and isinstance(x, (int, float)) and not isinstance(x, bool):
        return float(x)
    if t.kind in ("String", "File", "Directory") and isinstance(x, str):
        return x
    raise fault


def _key(k: str, t: T.Type) -> object:
    return {"Int": int, "Float": float, "Boolean": lambda s: {"true": True, "false": False}[s]}.get(t.kind, str)(k)


def overridden(inputs: dict, pairs: dict[str, str]) -> dict:
    """inputs with values given as text: read as JSON where they are, else as strings."""
    out = dict(inputs)
    for k, v in pairs.items():
        try:
            out[k] = json.loads(v)
        except ValueError:
            out[k] = v
    return out


def checked(inputs: dict, unit: Unit) -> dict[str, object]:
    """Values by input name. Names are `target.input`; unknown names and missing required inputs raise."""
    types = {d.name: d.type for d in unit.inputs}
    out = {}
    for k, v in inputs.items():
        target, _, name = k.rpartition(".")
        if target not in ("", unit.name) or name not in types:
            raise TypeMismatch(f"{unit.name} has no input {k}")
        out[name] = value(v, types[name], k)
    for d in unit.inputs:
        if d.name not in out and d.expr is None and not d.type.optional:
            raise TypeMismatch(f"{unit.name} needs the input {d.name}")
    return out


def table(spark: SparkSession, runs: list[dict], unit: Unit) -> DataFrame:
    """A row for each run's inputs (inputs that no run gives are left to their defaults)."""
    rows = [checked(r, unit) for r in runs]
    names = [d for d in unit.inputs if any(d.name in r for r in rows)]
    from pyspark.sql.types import StructField, StructType

    if not names:
        return spark.range(len(rows)).drop("id") if not rows else spark.range(len(rows)).withColumnRenamed("id", "_run")
    schema = StructType([StructField(d.name, T.spark_type(d.type), True) for d in names])
    return spark.createDataFrame([tuple(r.get(d.name) for d in names) for r in rows], schema)


def template(document: Document, unit: Unit) -> dict[str, str]:
    """Inputs by dotted name with their types, as a form to fill in."""
    return {f"{unit.name}.{d.name}": f"{d.type}" + (" (has a default)" if d.expr is not None else "") for d in unit.inputs}

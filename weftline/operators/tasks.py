"""Task commands: a script a row, run by the executors, with retries and a test of success; requirements and hints."""

from __future__ import annotations

import os
import subprocess
import sys
import tempfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.texts import UNITS
from ..types import MARK, require

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

MAX_RETRIES = 100
RESULT = "struct<stdout: string, stderr: string, exit_status: int, attempt: int, ok: boolean, files: map<string, string>>"
#: Commands of one row (a scatter within a workflow) that run at a time.
AT_ONCE = 4
#: What a task has if it doesn't say.
CPU, MEMORY = 1.0, 2 * 2**30
#: Older names of requirements.
RENAMED = {"docker": "container", "maxRetries": "max_retries", "returnCodes": "return_codes"}
_MEMORY = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)\s*$"


def succeeded(exit_status: Column, return_codes: str | int | list[int] = 0) -> Column:
    """`*`: any status is a success; another string is none; else the status, or one of them."""
    if isinstance(return_codes, str):
        return F.lit(return_codes == "*")
    return exit_status.isin(*(return_codes if isinstance(return_codes, list) else [return_codes]))


def codes_text(return_codes: str | int | list[int]) -> str:
    """Return codes as `commands` wants them: `*`, or numbers between commas."""
    if isinstance(return_codes, str):
        return "*" if return_codes == "*" else ""
    return ",".join(map(str, return_codes if isinstance(return_codes, list) else [return_codes]))


def memory_bytes(text: Column) -> Column:
    """Bytes of `4 GiB`, `500M` or a plain number; another text fails."""
    unit = F.regexp_extract(text, _MEMORY, 2)
    per = F.element_at(F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, float(v))]), F.when(unit == "", "B").otherwise(unit))
    known = F.rlike(text, F.lit(_MEMORY)) & unit.isin("", *UNITS)
    return require(known, F.ceil(F.regexp_extract(text, _MEMORY, 1).cast("double") * per).cast("long"), F.concat(F.lit("no amount of memory: "), text))


def _files_under(work: str, given: set[str]) -> list[tuple[str, str]]:
    out = []
    for root, _, names in os.walk(work):
        for n in names:
            full = os.path.join(root, n)
            name = os.path.relpath(full, work)
            if name not in given and os.path.isfile(full):
                with open(full, "rb") as f:
                    out.append((name, f.read().decode("utf-8", "replace")))
    return sorted(out)


def _ran(call: dict | None, shell: str, seconds: float | None) -> dict | None:
    """The last attempt at a call: its script of that attempt, its files laid down in a new folder."""
    if call is None or not call["scripts"] or call["scripts"][0] is None:
        return None
    codes, most = call["codes"], call["max_retries"] or 0
    if not 0 <= most <= MAX_RETRIES:
        raise ValueError(f"max_retries is 0 to {MAX_RETRIES}")
    good = None if codes == "*" else {int(x) for x in (codes or "").split(",") if x}
    files = dict(x.split(MARK, 1) for x in call["files"] or () if x is not None and MARK in x)
    for attempt in range(most + 1):
        with tempfile.TemporaryDirectory() as work:  # scratch of one attempt on its own machine
            for name, content in files.items():
                at = os.path.normpath(os.path.join(work, name))
                if os.path.isabs(name) or not at.startswith(work + os.sep):
                    raise ValueError(f"{name} is outside the task's folder")
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(at, "w", encoding="utf-8", newline="") as f:
                    f.write(content)
            env = {"PATH": "/usr/local/bin:/usr/bin:/bin", "TASK_ATTEMPT": str(attempt)} | {k: v for k, v in call["env"] or () if v is not None}
            try:
                script = call["scripts"][min(attempt, len(call["scripts"]) - 1)]
                got = subprocess.run([shell, "-c", script], cwd=work, capture_output=True, timeout=seconds, env=env)
                out, err, code = got.stdout, got.stderr, got.returncode
            except subprocess.TimeoutExpired as e:
                out, err, code = e.stdout or b"", e.stderr or b"", 124
            made = _files_under(work, {os.path.normpath(x) for x in files})
        ok = good is None or code in good
        if ok:
            break
    return {"stdout": out.decode("utf-8", "replace"), "stderr": err.decode("utf-8", "replace"), "exit_status": code, "attempt": attempt, "ok": ok, "files": made}


_ARROW = pa.list_(pa.struct([("stdout", pa.string()), ("stderr", pa.string()), ("exit_status", pa.int32()), ("attempt", pa.int32()), ("ok", pa.bool_()), ("files", pa.map_(pa.string(), pa.string()))]))


def call_of(scripts: Column, files: Column | None = None, env: Column | None = None, max_retries: Column | None = None, codes: Column | None = None) -> Column:
    """One call for `commands`: scripts by attempt (the last stands for those beyond), Files that carry their content and are
    laid down in the task's folder, variables, retries and the return codes of a success."""
    return F.struct(
        scripts.alias("scripts"), (F.array().cast("array<string>") if files is None else files).alias("files"), (F.create_map().cast("map<string,string>") if env is None else env).alias("env"),
        (F.lit(0) if max_retries is None else max_retries).cast("int").alias("max_retries"), (F.lit("0") if codes is None else codes).alias("codes"),
    )


def commands(calls: Column, shell: str = "bash", seconds: float | None = None) -> Column:
    """What running each call of an array gave in its last attempt, AT_ONCE at a time; null for a null call. `files` holds
    what the task left in its folder, as text: let a task write large outputs to storage of its own. Executors may run a
    script again after a loss: let it write nothing but what belongs to it. TASK_ATTEMPT is the attempt's number (from 0)."""

    @F.arrow_udf(f"array<{RESULT}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with ThreadPoolExecutor(AT_ONCE) as pool:
            for batch in batches:
                yield pa.array([None if row is None else list(pool.map(lambda c: _ran(c, shell, seconds), row)) for row in batch.to_pylist()], _ARROW)

    return run.asNondeterministic()(calls)


def command(script: Column, max_retries: int = 0, return_codes: str | int | list[int] = 0, shell: str = "bash", seconds: float | None = None) -> Column:
    """What running the script gave in the last attempt (see `commands`); null for a null script."""
    if not 0 <= max_retries <= MAX_RETRIES:
        raise ValueError(f"max_retries is 0 to {MAX_RETRIES}")
    return F.get(commands(F.array(call_of(F.array(script), max_retries=F.lit(max_retries), codes=F.lit(codes_text(return_codes)))), shell, seconds), F.lit(0))


def run_tasks(rows: DataFrame, script: Column, out: str = "task", fail: bool = True, **options) -> DataFrame:
    """rows with `out` (stdout, stderr, exit_status, attempt, ok, files); with fail, a row that isn't a success ends the query.
    A null script isn't run and gives null."""
    got = rows.withColumn(out, command(script, **options))
    if fail:
        failed = F.raise_error(F.concat(F.lit("task failed: "), F.col(f"{out}.stderr")))
        got = got.withColumn(out, F.when(F.col(out).isNull() | F.col(f"{out}.ok"), F.col(out)).otherwise(failed))
    return got

"""Plans of analyses whose parts may fail: each part ends as tables or as a status row.

All guards of a plan (columns that must exist, rows that must be complete) are judged by one
aggregate. Parts that pass run side by side, each under a scheduler pool of its own name, and write
their tables, so an error shows in the part that caused it and leaves the others alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.schema import stage

OK, MISSING, TOO_FEW, SKIPPED, FAILED = "ok", "missing column", "too few rows", "skipped", "failed"
STATUS = "part string, status string, rows bigint, needed int, message string"


@dataclass(frozen=True)
class Part:
    """One step of a plan.

    ``build(df, got)`` returns tables by name, and whatever else later parts take from ``got``
    under names that begin with ``_``. It runs if ``columns`` exist and ``least`` rows hold all of
    them; ``present`` names further columns, which may hold nulls. Parts named in ``after`` come first:
    they must be ok unless ``tolerant``.
    """

    name: str
    build: Callable[[DataFrame, dict], dict]
    columns: tuple[str, ...] = ()
    least: int = 0
    after: tuple[str, ...] = ()
    tolerant: bool = False
    present: tuple[str, ...] = ()

    def lacking(self, df: DataFrame) -> list[str]:
        return [c for c in (*self.columns, *self.present) if c not in df.columns]


def complete(df: DataFrame, columns: Sequence[str]) -> Column:
    """Whether a row holds a value, not NaN, in all ``columns``."""
    types, out = dict(df.dtypes), F.lit(True)
    for c in columns:
        out = out & F.col(f"`{c}`").isNotNull()
        if types[c] in ("double", "float"):
            out = out & ~F.isnan(f"`{c}`")
    return out


def guard_status(df: DataFrame, parts: Sequence[Part], *by: str) -> DataFrame:
    """``by..., part, status, rows, needed``: one row per part, for every group of ``by`` if given.

    ``rows`` counts the complete rows, null where a column is missing. One aggregate serves all
    parts; counts are combined before the shuffle. Without ``by`` an empty table has its rows too.
    """
    have = [not p.lacking(df) for p in parts]
    counts = [
        (F.count_if(complete(df, p.columns)) if have[i] else F.lit(None).cast("bigint")).alias(f"n{i}")
        for i, p in enumerate(parts)
    ]
    verdicts = [
        F.struct(
            F.lit(p.name).alias("part"),
            (F.when(F.col(f"n{i}") >= p.least, OK).otherwise(TOO_FEW) if have[i] else F.lit(MISSING)).alias("status"),
            F.col(f"n{i}").alias("rows"), F.lit(p.least).alias("needed"),
        )
        for i, p in enumerate(parts)
    ]
    return df.groupBy(*by).agg(*counts).select(*by, F.inline(F.array(*verdicts)))


def run_plan(df: DataFrame, parts: Sequence[Part], workers: int = 4) -> dict[str, DataFrame]:
    """Tables of all parts that could run, and ``status``: ``part, status, rows, needed, message``.

    ``df`` is written once and read by every part. Parts are listed in an order in which each comes
    behind those it names in ``after``; up to ``workers`` run at a time.
    """
    seen: set[str] = set()
    for p in parts:
        if p.name in seen or not seen.issuperset(p.after):
            raise ValueError(f"part {p.name} is named twice or stands before one that it needs")
        seen.add(p.name)
    df = stage(df)
    context = df.sparkSession.sparkContext
    guards = {r["part"]: r for r in guard_status(df, parts).collect()}
    got: dict = {}
    ends: dict[str, Future] = {}

    def run(part: Part) -> tuple[str, str | None]:
        # earlier parts were begun earlier, so waiting for them cannot block all workers
        before = {name: ends[name].result()[0] for name in part.after}
        bad = [name for name, end in before.items() if end != OK]
        if guards[part.name]["status"] != OK:
            return guards[part.name]["status"], ", ".join(part.lacking(df)) or None
        if bad and not part.tolerant:
            return SKIPPED, f"needs {', '.join(bad)}"
        context.setLocalProperty("spark.scheduler.pool", part.name)
        try:
            out = part.build(df, got)
            out = {k: stage(v) if isinstance(v, DataFrame) and not k.startswith("_") else v for k, v in out.items()}
        except Exception as error:  # whatever a part meets becomes its status
            return FAILED, f"{type(error).__name__}: {error}".splitlines()[0][:300]
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)
        got.update(out)
        return OK, None

    with ThreadPoolExecutor(workers) as pool:
        for p in parts:
            ends[p.name] = pool.submit(inheritable_thread_target(df.sparkSession)(run), p)
    rows = []
    for p in parts:
        end, message = ends[p.name].result()
        rows.append((p.name, end, guards[p.name]["rows"], p.least, message))
    # in the order of the plan, whichever part ended first
    tables = {k: v for k, v in got.items() if not k.startswith("_")}
    return {**tables, "status": df.sparkSession.createDataFrame(rows, STATUS)}

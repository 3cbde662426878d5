"""A registry of queries: name, plan over a data folder, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

Plan = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.plans: dict[str, Plan] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
        """Register the decorated plan; `sql` None says that SQL can't express it."""

        def keep(plan: Plan) -> Plan:
            self.plans[name] = plan
            if sql is not None:
                self.sql[name] = sql
            return plan

        return keep


class Inline:
    """A small table for operators that the data folder has no rows for; the same rows in Spark and in SQL."""

    def __init__(self, schema: str, rows: Iterable[tuple]):
        self.schema, self.rows = schema, list(rows)
        self.names = [f.strip().split(" ")[0] for f in schema.split(",") if f.strip()]

    def df(self, spark: SparkSession) -> DataFrame:
        """The rows as part of the plan, so that their size is known where a join is chosen."""
        rows = [dict(zip(self.names, r, strict=True)) for r in self.rows]
        try:
            packed = json.dumps(rows, allow_nan=False)
        except ValueError:  # JSON has no NaN
            return spark.createDataFrame(self.rows, self.schema)
        typed = F.from_json(F.lit(packed), f"array<struct<{self.schema}>>")
        return spark.range(1).select(F.explode(typed).alias("row")).select("row.*")

    @property
    def values(self) -> str:
        """A VALUES list with column names, for a FROM clause."""
        rows = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)
        return f"(VALUES {rows}) AS t({', '.join(self.names)})"


class Templates:
    """Rows made from every row of `documents`, the same in Spark and in SQL.

    `rows` are templates (case, value, ...): document d gives those of case d % n + 1, n being the number of cases; several templates
    of a case are several rows. @id@, @source@ and @text@ in a string stand for the document's own; a string of another type is cast.
    """

    FIELDS = {"@id@": ("doc_id", "CAST(doc_id AS VARCHAR)"), "@source@": ("source", "source"), "@text@": ("text", "text")}
    KINDS = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}

    def __init__(self, schema: str, rows: Iterable[tuple], n: int | None = None):
        self.key, *own = (f.strip().split(" ", 1) for f in schema.split(","))
        self.names, self.kinds, self.rows = [f for f, _ in own], [k for _, k in own], list(rows)
        self.n = n or max(r[0] for r in self.rows)

    def _parts(self, value: str) -> list[str]:
        return [x for x in re.split("(@id@|@source@|@text@)", value) if x]

    def _column(self, value: object, kind: str) -> Column:
        if isinstance(value, list):
            return F.array(*[self._column(v, "string") for v in value]).cast(kind)
        if isinstance(value, str):
            value = F.concat(*[F.col(self.FIELDS[x][0]).cast("string") if x in self.FIELDS else F.lit(x) for x in self._parts(value)]) if self._parts(value) else F.lit("")
            return value.cast(kind)
        return F.lit(value).cast(kind)

    def _sql(self, value: object, kind: str) -> str:
        if isinstance(value, list):
            return "[" + ", ".join(self._sql(v, "string") for v in value) + "]::VARCHAR[]"
        if isinstance(value, str):
            value = " || ".join(self.FIELDS[x][1] if x in self.FIELDS else literal(x) for x in self._parts(value)) or "''"
            return f"CAST({value} AS {self.KINDS[kind]})"
        return f"CAST({literal(value)} AS {self.KINDS[kind]})"

    def df(self, spark: SparkSession, sf: str) -> DataFrame:
        case, made = F.pmod("doc_id", F.lit(self.n)) + 1, F.when(F.lit(False), None)
        for k in range(1, self.n + 1):
            each = [F.struct(*[self._column(v, t).alias(c) for c, t, v in zip(self.names, self.kinds, r[1:], strict=True)]) for r in self.rows if r[0] == k]
            made = made.when(case == k, F.array(*each)) if each else made
        return table(spark, sf, "documents").select(F.col("doc_id").alias(self.key[0]), F.explode(made).alias("row")).select(self.key[0], "row.*")

    @property
    def values(self) -> str:
        """A subquery for a FROM clause."""
        parts = [f"SELECT doc_id AS {self.key[0]}, {', '.join(f'{self._sql(v, t)} AS {c}' for c, t, v in zip(self.names, self.kinds, r[1:], strict=True))} FROM documents WHERE doc_id % {self.n} = {r[0] - 1}" for r in self.rows]
        return f"({' UNION ALL '.join(parts)}) AS t"


def literal(value: object) -> str:
    """A DuckDB literal."""
    match value:
        case None:
            return "NULL"
        case bool():
            return str(value).upper()
        case int():
            return str(value)
        case float():
            return f"CAST({value!r} AS DOUBLE)"
        case list() | tuple():
            return "[" + ", ".join(map(literal, value)) + "]" + ("::VARCHAR[]" if not value else "")
        case _:
            return "'" + str(value).replace("'", "''") + "'"

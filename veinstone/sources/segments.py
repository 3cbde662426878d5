"""Tables of an index in immutable segments, with tombstones, snapshots, merges and vacuum.

A change writes its rows as a segment of their own, and the (segment, key) of the rows that it replaces or removes as
tombstones. Nothing that was written before is touched. A snapshot lists the live segments and tombstones; the
pointer CURRENT names it, and is switched in one step at the end of a change. A change that ends anywhere before
leaves the old snapshot as it was, and files that vacuum() removes.

    root/CURRENT
    root/snapshots/<version>.json
    root/<table>/segment=<version>/...     rows of a change
    root/dead/segment=<version>/...        (in_segment, key) of rows that it ended
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import SCHEMA_VERSION, Store

DEAD = "in_segment string, key string"


class Conflict(RuntimeError):
    """Another change was committed meanwhile."""


@dataclass(frozen=True)
class Snapshot:
    """A state of the tables: live segments with their rows, tombstone files, and the segments of whole tables."""

    version: str
    parent: str | None = None
    segments: tuple[tuple[str, int], ...] = ()
    dead: tuple[str, ...] = ()
    whole: tuple[tuple[str, str], ...] = ()

    @property
    def names(self) -> list[str]:
        return [s for s, _ in self.segments]


class Segments(Store):
    """`key` is the column that rows are replaced and removed by; `tables` are the segmented ones, the first of which counts rows."""

    def __init__(self, spark: SparkSession, root: str, tables: tuple[str, ...], key: str = "source_key"):
        super().__init__(spark, root)
        self.tables, self.key = tables, key

    def snapshot(self, version: str | None = None) -> Snapshot | None:
        """The snapshot in force, or that of a version; None without one."""
        version = version or self.current()
        at = f"{self.root}/snapshots/{version}.json"
        if version is None or not self._fs.exists(self._path(at)):
            return None
        found = json.loads("\n".join(r.value for r in self.spark.read.text(at).collect()))
        made = {k: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v for k, v in found.items() if k != "schema"}
        return Snapshot(**made) if found.get("schema") == SCHEMA_VERSION else None

    def path(self, name: str, segment: str) -> str:
        return f"{self.root}/{name}/segment={segment}"

    def _rows(self, name: str, schema: str, segments: Iterable[str]) -> DataFrame:
        """The rows of segments, with their segment; a segment may lack a table."""
        paths = [self.path(name, s) for s in segments if self.holds(name, s)]
        full = f"{schema}, segment string"
        if not paths:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", f"{self.root}/{name}").parquet(*paths)

    def holds(self, name: str, segment: str) -> bool:
        return self._fs.exists(self._path(self.path(name, segment)))

    def dead(self, at: Snapshot | None = None) -> DataFrame | None:
        """(in_segment, key) of all tombstones; None if there are none."""
        at = at or self.snapshot()
        return self._rows("dead", DEAD, at.dead).drop("segment") if at and at.dead else None

    def read(self, name: str, schema: str) -> DataFrame:
        """The live rows of a table."""
        at = self.snapshot()
        if at is None:
            return self.spark.createDataFrame([], schema)
        if name in dict(at.whole):
            return self._rows(name, schema, [dict(at.whole)[name]]).drop("segment")
        return self._live(name, schema, at).drop("segment")

    def _live(self, name: str, schema: str, at: Snapshot, segments: Iterable[str] | None = None) -> DataFrame:
        rows, dead = self._rows(name, schema, at.names if segments is None else segments), self.dead(at)
        if dead is None:
            return rows
        return rows.join(dead, (F.col("segment") == F.col("in_segment")) & (F.col(self.key) == F.col("key")), "left_anti")

    def change(self) -> Change:
        """A change on top of the snapshot in force."""
        return Change(self, self.begin(), self.snapshot())

    def merge(self, schemas: dict[str, str], least: int, most_dead: float = 0.3, rewrite: Callable[[Change, str, DataFrame], None] | None = None) -> str | None:
        """Write segments of fewer than `least` rows, and those of which more than `most_dead` are gone, as one; the version, or None if there is nothing to do.

        `rewrite` writes tables that are made from a segmented one, and gets the change, the table's name and its rows.
        """
        at = self.snapshot()
        if at is None:
            return None
        live = {r.segment: r["n"] for r in self._live(self.tables[0], schemas[self.tables[0]], at).groupBy("segment").agg(F.count("*").alias("n")).collect()}
        poor = [s for s, n in at.segments if live.get(s, 0) < least or live.get(s, 0) < (1 - most_dead) * n]
        if not poor or (len(poor) == 1 and live.get(poor[0], 0) == dict(at.segments)[poor[0]]):
            return None
        change = self.change()
        for name in self.tables:
            rows = self.write(change.version, name, self._live(name, schemas[name], at, poor).drop("segment"))
            if rewrite:
                rewrite(change, name, rows)
        # Tombstones of the segments that stay as they are.
        kept, dead = [s for s in at.names if s not in poor], self.dead(at)
        if dead is not None and kept:
            self.write(change.version, "dead", dead.where(F.col("in_segment").isin(kept)))
        rows = self.size(change.version)
        new = ((change.version, rows),) if rows else ()
        change.publish(Snapshot(change.version, at.version, tuple((s, n) for s, n in at.segments if s in kept) + new, (change.version,) if dead is not None and kept else (), at.whole))
        return change.version

    def write(self, version: str, name: str, rows: DataFrame) -> DataFrame:
        """Write the rows of a table as a segment, and read them back."""
        rows.write.parquet(self.path(name, version))
        return self.spark.read.schema(rows.schema).parquet(self.path(name, version))

    def size(self, segment: str) -> int:
        """Rows of the largest table of a segment."""
        return max((self.spark.read.parquet(self.path(t, segment)).count() for t in self.tables if self.holds(t, segment)), default=0)

    def history(self) -> list[Snapshot]:
        """Snapshots from the one in force back, as far as they are still there."""
        out, at = [], self.snapshot()
        while at is not None:
            out.append(at)
            at = self.snapshot(at.parent) if at.parent else None
        return out

    def vacuum(self, keep: int = 1) -> int:
        """Remove every file that none of the last `keep` snapshots needs, of failed changes too; how many folders went. Not while a change is under way."""
        kept = self.history()[: max(1, keep)]
        needed = {x for s in kept for x in (s.version, *s.names, *s.dead, *dict(s.whole).values())}
        gone, versions = 0, {s.version for s in kept}
        for table in self._fs.listStatus(self._path(self.root)) if kept else ():
            if not table.isDirectory():
                continue
            for f in self._fs.listStatus(table.getPath()):
                name = f.getPath().getName().removeprefix("segment=").removesuffix(".json")
                if name not in (versions if table.getPath().getName() == "snapshots" else needed):
                    gone += bool(self._fs.delete(f.getPath(), True))
        return gone

    def put(self, path: str, text: str) -> None:
        stream = self._fs.create(self._path(path), True)
        stream.write(bytearray(text.encode()))
        stream.close()


class Change:
    """Rows to add and keys to end; nothing of it is seen before commit()."""

    def __init__(self, store: Segments, version: str, before: Snapshot | None):
        self.store, self.version, self.before = store, version, before
        self.ends, self.whole = False, dict(before.whole) if before else {}

    def add(self, name: str, rows: DataFrame) -> DataFrame:
        return self.store.write(self.version, name, rows)

    def replace(self, name: str, rows: DataFrame) -> DataFrame:
        """A small table that each change writes anew."""
        self.whole[name] = self.version
        return self.store.write(self.version, name, rows)

    def work(self, name: str, rows: DataFrame) -> DataFrame:
        """A table that only this change needs, removed when it is committed."""
        path = f"{self.store.root}/work/segment={self.version}/{name}"
        rows.write.parquet(path)
        return self.store.spark.read.schema(rows.schema).parquet(path)

    def end(self, keys: DataFrame | None, own: DataFrame | None = None) -> None:
        """End the live rows with these keys (a column named like the store's key), and those of this change with the keys `own`."""
        key, parts = F.col(self.store.key).cast("string").alias("key"), []
        if keys is not None and self.before is not None:
            # A tombstone for each segment: which of them has the key is not looked up.
            live = F.explode(F.array(*[F.lit(s) for s in self.before.names])) if self.before.names else None
            parts += [keys.distinct().select(live.alias("in_segment"), key)] if live is not None else []
        if own is not None:
            parts.append(own.distinct().select(F.lit(self.version).alias("in_segment"), key))
        for part in parts[1:]:
            parts[0] = parts[0].unionByName(part)
        if parts:
            self.ends = bool(self.store.write(self.version, "dead", parts[0]).limit(1).count())

    def commit(self, fresh: bool = False) -> Snapshot:
        """Make the change the state in force; `fresh` leaves everything before it out."""
        n = self.store.size(self.version)
        old = self.before if self.before is not None and not fresh else Snapshot(self.version)
        parent = self.before.version if self.before else None
        made = Snapshot(self.version, parent, old.segments + (((self.version, n),) if n else ()), old.dead + ((self.version,) if self.ends else ()), tuple(sorted(self.whole.items())))
        return self.publish(made)

    def publish(self, made: Snapshot) -> Snapshot:
        self.store.put(f"{self.store.root}/snapshots/{made.version}.json", json.dumps({"schema": SCHEMA_VERSION, **asdict(made)}))
        if self.store.current() != (self.before.version if self.before else None):
            raise Conflict(f"{made.version} is not on top of the version in force")
        self.store.commit(made.version)
        self.store._fs.delete(self.store._path(f"{self.store.root}/work/segment={self.version}"), True)
        return made

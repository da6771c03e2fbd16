"""Tables that change together: copy-on-write by parts, one manifest a commit.

Rows are dealt to parts by a hash of their key.  A change writes new files for the parts it touches
and leaves the others alone; what is in force is listed by a manifest, a small file with a number of
its own.  It is created only if nobody has created it, so of two writers that start from the same
version one fails, and until it exists nothing that a dying job wrote is seen.  All tables of a commit
change at once, under the number of the batch that made it, and a batch that was committed is known.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has committed meanwhile."""


@dataclass(frozen=True)
class Manifest:
    """Which versions each part of each table consists of, and the first id each table has left."""

    version: int = 0
    batch: int = -1
    parts: dict[str, dict[int, list[str]]] = field(default_factory=dict)
    next_id: dict[str, int] = field(default_factory=dict)

    def dumps(self) -> str:
        return json.dumps({"version": self.version, "batch": self.batch, "parts": self.parts, "next_id": self.next_id})

    @staticmethod
    def loads(text: str) -> Manifest:
        m = json.loads(text)
        return Manifest(m["version"], m["batch"], {t: {int(p): v for p, v in parts.items()} for t, parts in m["parts"].items()}, m["next_id"])


@dataclass(frozen=True)
class Change:
    """New rows of a table: they replace the rows of ``parts``, or are added where there are none."""

    rows: DataFrame
    parts: frozenset[int] | None = None  # None: rows are only added


class TableSet:
    """``root/<table>/v=n-x/part=p`` and ``root/_manifests/n.json``; all access by Hadoop's file system.

    ``tables`` has the schema and the key of each."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, tuple[str, str]], parts: int = 16):
        self.spark, self.root, self.tables, self.n = spark, root.rstrip("/"), tables, parts

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def manifest(self) -> Manifest:
        fs, path = self._path("_manifests")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        last = max((int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)
        if not last:
            return Manifest()
        text = self.spark.read.text(f"{self.root}/_manifests/{last}.json", wholetext=True).first()[0]
        return Manifest.loads(text)

    def part_of(self, key: str | Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.n)).cast("int")

    def touched(self, rows: DataFrame, table: str) -> frozenset[int]:
        """The parts that the keys of some rows lie in: at most as many as there are parts."""
        return frozenset(r[0] for r in rows.select(self.part_of(self.tables[table][1])).distinct().collect())

    def read(self, table: str, parts: frozenset[int] | None = None, manifest: Manifest | None = None) -> DataFrame:
        """A table, or some of its parts; files of other parts are not listed."""
        m = manifest or self.manifest()
        schema = self.tables[table][0]
        paths = [f"{self.root}/{table}/v={v}/part={p}" for p, vs in sorted(m.parts.get(table, {}).items()) if parts is None or p in parts for v in vs]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, base: Manifest, changes: dict[str, Change], *, batch: int | None = None, used_ids: dict[str, int] | None = None) -> Manifest:
        """Writes the changes and makes them all visible at once, on top of the version ``base``."""
        n = base.version + 1
        parts = {t: dict(p) for t, p in base.parts.items()}
        for table, change in changes.items():
            key = self.tables[table][1]
            v = f"{n}-{uuid.uuid4().hex[:8]}"  # of two writers of one version neither touches the other's files
            change.rows.withColumn("part", self.part_of(key)).hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/{table}/v={v}")
            fs, path = self._path(f"{table}/v={v}")
            written = {int(f.getPath().getName()[5:]) for f in fs.listStatus(path) if f.getPath().getName().startswith("part=")}
            own = parts.setdefault(table, {})
            for p in change.parts or ():
                own.pop(p, None)
            for p in written:
                own[p] = [*own.get(p, []), v]
        made = replace(base, version=n, batch=base.batch if batch is None else batch, parts=parts, next_id={**base.next_id, **(used_ids or {})})
        self._publish(made)
        return made

    def _publish(self, m: Manifest) -> None:
        fs, path = self._path(f"_manifests/{m.version}.json")
        _, scratch = self._path(f"_manifests/.{m.version}-{id(m)}")
        out = fs.create(scratch, True)
        out.write(bytearray(m.dumps().encode()))
        out.close()
        # a rename onto a name that exists fails, and no reader sees half a manifest
        if fs.exists(path) or not fs.rename(scratch, path):
            fs.delete(scratch, False)
            raise Conflict(f"version {m.version} of {self.root} was committed by another writer")

    def upsert(self, table: str, incoming: DataFrame, merge) -> Manifest:
        """``merge(old, incoming)`` over the parts that incoming keys touch; other parts stay as they are."""
        base = self.manifest()
        parts = self.touched(incoming, table)
        return self.commit(base, {table: Change(merge(self.read(table, parts, base), incoming), parts)})

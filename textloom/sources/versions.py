"""Tables in versions: immutable data files and one small numbered file for each commit.

A commit first writes its rows to a folder of their own, then a snapshot that names every folder of the table; the snapshot
appears whole and only if no other has its number. Readers take the newest snapshot, so they see all of a commit or nothing
of it, and a writer that fails leaves the table as it was. A snapshot also keeps the number of the last batch of each writer,
so a batch that is repeated after a failure is known by it. Spark lists no folders to read a version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.places import create_once, delete, names_in, read_text


#: A bucket in so many folders is written into one by the next upsert.
MOST_FOLDERS = 16


class CommitConflict(RuntimeError):
    """Another writer made the version that this one was about to make."""


@dataclass(frozen=True)
class Snapshot:
    """One version: for each bucket the folders that hold its rows, and each writer's last batch."""

    version: int = 0
    schema: str | None = None
    folders: dict[str, list[str]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def done(self, writer: str, batch: int) -> bool:
        return self.batches.get(writer, -1) >= batch


class VersionedTable:
    """A table of unique rows in a folder. ``unique``: groups of columns, each unique by itself; the first is never null.

    A row put in replaces every row that has the same values in any of these groups; nulls are equal to nothing. Rows lie in
    ``buckets`` by the first group. An upsert adds a folder to the buckets of its rows and writes again those buckets only in
    which it replaces a row or that lie in many folders; a table keeps the number of buckets that it was begun with. Each commit has a folder of its own, so nothing written is ever changed.
    """

    def __init__(self, spark: SparkSession, path: str, unique: Sequence[Sequence[str]], buckets: int = 64):
        self.spark, self.path, self.unique, self.buckets = spark, path.rstrip("/"), [list(u) for u in unique], buckets

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in names_in(self.spark, f"{self.path}/snapshots") if n.endswith(".json"))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """A version, the newest if none is named; version 0 is the empty table."""
        if version is None:
            version = max(self.versions(), default=0)
        return Snapshot(**json.loads(read_text(self.spark, f"{self.path}/snapshots/{version:020d}.json"))) if version else Snapshot()

    def read(self, snapshot: Snapshot | None = None, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """The rows of a version, the newest if none is given, of some buckets if these are named; None of an empty table."""
        now = self.snapshot() if snapshot is None else snapshot
        if now.schema is None:
            return None
        schema = StructType.fromJson(json.loads(now.schema))
        paths = [f"{self.path}/data/{folder}/_bucket={b}" for b, folders in now.folders.items() if buckets is None or int(b) in buckets for folder in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.unique[0]), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        """Rows in a new folder: its name and the buckets in it, which the driver gets, ``buckets`` numbers at most."""
        folder = uuid.uuid4().hex
        rows.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        return folder, [int(n.split("=")[1]) for n in names_in(self.spark, f"{self.path}/data/{folder}") if n.startswith("_bucket=")]

    def _commit(self, base: Snapshot, schema: StructType, folders: dict[str, list[str]], batch: tuple[str, int] | None) -> Snapshot:
        after = Snapshot(base.version + 1, schema.json(), {b: f for b, f in folders.items() if f}, base.batches | ({batch[0]: batch[1]} if batch else {}))
        if not create_once(self.spark, f"{self.path}/snapshots/{after.version:020d}.json", json.dumps(after.__dict__)):
            raise CommitConflict(f"version {after.version} of {self.path} was made by another writer")
        return after

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None, base: Snapshot | None = None) -> Snapshot:
        """Adds rows whose unique values the table doesn't have; nothing old is read or written again."""
        base = base or self.snapshot()
        if batch and base.done(*batch):
            return base
        folder, held = self._write(rows)
        folders = {b: list(f) for b, f in base.folders.items()}
        for b in held:
            folders.setdefault(str(b), []).append(folder)
        return self._commit(base, rows.schema, folders, batch)

    def upsert(self, changes: DataFrame, order: str, batch: tuple[str, int] | None = None, attempts: int = 5) -> Snapshot:
        """Puts ``changes`` in, in the order of ``order``, after what is there. A lost race is run again on the new version.

        Changes are read several times, so what they are made of runs once, into a folder that is gone afterwards.
        """
        if batch and (base := self.snapshot()).done(*batch):
            return base
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        try:
            changes.write.parquet(staged)
            stored = self.spark.read.schema(changes.schema).parquet(staged)
            for attempt in range(attempts):
                base = self.snapshot()
                if batch and base.done(*batch):
                    return base
                try:
                    return self._upsert(base, stored, order, batch)
                except CommitConflict:
                    if attempt + 1 == attempts:
                        raise
        finally:
            delete(self.spark, staged)
        raise AssertionError

    def _upsert(self, base: Snapshot, changes: DataFrame, order: str, batch: tuple[str, int] | None) -> Snapshot:
        rows, folders = latest_unique(changes, self.unique, [order]), {b: list(f) for b, f in base.folders.items()}
        again = {int(b) for b, f in folders.items() if len(f) >= MOST_FOLDERS}
        old = self.read(base)
        if old is not None:
            for columns in self.unique:  # buckets with a row that a change replaces: only the keys are read
                again |= {r[0] for r in old.join(changes.select(*columns), columns, "left_semi").select(self._bucket()).distinct().collect()}
            if again:
                kept = self.read(base, sorted(again))
                for columns in self.unique:
                    kept = kept.join(changes.select(*columns), columns, "left_anti")
                rows = rows.unionByName(kept.select(*rows.columns))
        folder, held = self._write(rows)
        folders |= {str(b): [] for b in again}
        for b in held:
            folders.setdefault(str(b), []).append(folder)
        return self._commit(base, changes.schema, folders, batch)

    def forget(self, keep: int = 10) -> list[str]:
        """Deletes the snapshots before the last ``keep``, then folders that no snapshot left names; returns these folders.

        Not while a writer is at work: what it has written isn't named yet.
        """
        versions = self.versions()
        for version in versions[:-keep]:
            delete(self.spark, f"{self.path}/snapshots/{version:020d}.json")
        used = {f for v in versions[-keep:] for folders in self.snapshot(v).folders.values() for f in folders}
        unused = [n for n in names_in(self.spark, f"{self.path}/data") if n not in used]
        for name in unused:
            delete(self.spark, f"{self.path}/data/{name}")
        return unused


def latest_unique(rows: DataFrame, unique: Sequence[Sequence[str]], order: Sequence[str]) -> DataFrame:
    """Rows after putting them in one by one in ``order``, each replacing those that share one of the ``unique`` groups.

    A row stays if none comes later in any of its groups; one that itself was replaced has replaced as well. Rows of equal
    order count as put in in any order, those of equal content once.
    """
    marked = rows.withColumn("_place", F.struct(*order, F.xxhash64(*rows.columns).alias("_tie")))
    stays = F.lit(True)
    for k, columns in enumerate(unique):
        whole = F.lit(True)
        for c in columns:
            whole = whole & F.col(c).isNotNull()
        last = marked.filter(whole).groupBy(*columns).agg(F.max("_place").alias(f"_last{k}"))
        # Rows with a null are replaced by none and would all meet in one task.
        marked = marked.filter(whole).join(last, columns).unionByName(marked.filter(~whole), allowMissingColumns=True)
        stays = stays & F.coalesce(F.col("_place").eqNullSafe(F.col(f"_last{k}")) | F.col(f"_last{k}").isNull(), F.lit(True))
    return marked.filter(stays).dropDuplicates([*unique[0], "_place"]).select(*rows.columns)

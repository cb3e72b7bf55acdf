"""A sharded document store with size-tiered compaction.

``ShardStore`` is a folder of immutable Parquet shards and a chain of manifests.

* ``append`` writes an arrival as small shards (one for each task) and commits.
* ``compact`` sorts the shards into tiers by size, each tier ``fanin`` times the
  size of the one below.  A tier with ``fanin`` shards or more is merged into
  files of ``target_bytes``; one task merges neighbouring files, so nothing is
  shuffled.  It repeats until no tier has enough shards, then commits once.
* A commit writes ``manifest-<version>.json`` under a temporary name and renames
  it without overwriting: either a whole version is there or none.  A writer
  that loses the race retries on the newer version.  A commit makes sure that
  the shards it adds are still there.
* ``vacuum`` removes shards that no retained version names, once they are older
  than any writer may take from writing a shard to committing it, and the
  manifests of versions that aren't retained.

Only the manifest (one entry for each file, never for each document) is held by
the driver.  Defined results: an empty arrival adds no shard; null values,
repeated rows and columns of any name are stored as they are, except that an
arrival must have the columns of the store.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.llm import scratch


#: A table of shards is broadcast up to this many (about 20 MB), and joined by shuffling beyond.
BROADCAST_SHARDS = 100_000


@dataclass(frozen=True)
class Shard:
    path: str  # below the store's root
    n_bytes: int
    n_rows: int
    level: int  # merges that it has been through


class ConflictError(RuntimeError):
    """Another writer committed this version first, or shards to be committed are gone."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fanin: int = 4, small_bytes: int = 1 << 20):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fanin, self.small_bytes = target_bytes, fanin, small_bytes

    # manifests

    def version(self) -> int:
        fs, p = scratch.filesystem(self.spark, f"{self.root}/manifests")
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max([int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")], default=0)

    def manifest(self, version: int | None = None) -> tuple[int, dict]:
        version = self.version() if version is None else version
        if version == 0:
            return 0, {"schema": None, "shards": []}
        fs, p = scratch.filesystem(self.spark, f"{self.root}/manifests/manifest-{version:08d}.json")
        stream = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return version, json.loads(text)

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**s) for s in self.manifest(version)[1]["shards"]]

    def _files(self, folder: str) -> dict[str, tuple[int, int]]:
        """(bytes, time of writing in ms) of the shards in a folder below the root."""
        fs, p = scratch.filesystem(self.spark, f"{self.root}/{folder}")
        listed = fs.listStatus(p) if fs.exists(p) else []
        return {s.getPath().getName(): (s.getLen(), s.getModificationTime()) for s in listed if s.getPath().getName().endswith(".parquet")}

    def _commit(self, version: int, schema: str, kept: list[Shard], added: list[Shard]) -> int:
        """Makes ``version + 1`` of the given shards, or raises ConflictError."""
        shards = kept + added
        there = {f"{folder}/{name}" for folder in {s.path.rsplit("/", 1)[0] for s in added} for name in self._files(folder)}
        if lost := [s.path for s in added if s.path not in there]:
            raise ConflictError(f"{len(lost)} shards were removed before they were committed, the first {lost[0]}")
        name = f"{self.root}/manifests/manifest-{version + 1:08d}.json"
        fs, final = scratch.filesystem(self.spark, name)
        _, draft = scratch.filesystem(self.spark, f"{self.root}/manifests/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"schema": schema, "shards": [asdict(s) for s in shards]}).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(draft, final, none)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(final):
                raise FileExistsError(name) from e
            raise
        return version + 1

    # files

    def _write(self, df: DataFrame, level: int) -> list[Shard]:
        """Writes ``df`` as one shard for each non-empty task."""
        folder = f"shards/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        sizes = {f: n for f, (n, _) in self._files(folder).items()}
        stored = self.spark.read.schema(df.schema).parquet(f"{self.root}/{folder}")
        rows = {r["f"]: r["n"] for r in stored.groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count("*").alias("n")).collect()}
        return [Shard(f"{folder}/{f}", n, rows[f], level) for f, n in sorted(sizes.items()) if rows.get(f)]

    def append(self, df: DataFrame) -> int:
        """Adds an arrival; the new version."""
        made = self._write(df, 0)
        while True:
            version, now = self.manifest()
            if now["schema"] not in (None, df.schema.json()):
                raise ValueError("the arrival's columns are not the store's")
            try:
                return self._commit(version, df.schema.json(), [Shard(**s) for s in now["shards"]], made)
            except FileExistsError:
                continue

    def tier(self, n_bytes: int) -> int:
        """0 up to ``small_bytes``, then one more for each factor ``fanin``; whole files are in tier -1."""
        if n_bytes * 2 > self.target_bytes:
            return -1
        tier, top = 0, self.small_bytes
        while n_bytes > top:
            tier, top = tier + 1, top * self.fanin
        return tier

    def _merge(self, runs: list[Shard]) -> list[Shard]:
        _, now = self.manifest()
        from pyspark.sql.types import StructType

        files = max(1, round(sum(s.n_bytes for s in runs) / self.target_bytes))
        df = self.spark.read.schema(StructType.fromJson(json.loads(now["schema"]))).parquet(*[f"{self.root}/{s.path}" for s in runs])
        return self._write(df.coalesce(files), 1 + max(s.level for s in runs))

    def compact(self) -> int:
        """Merges until each tier has fewer than ``fanin`` shards; the version that holds then."""
        version, now = self.manifest()
        start = [Shard(**s) for s in now["shards"]]
        shards = list(start)
        while True:
            tiers: dict[int, list[Shard]] = {}
            for s in shards:
                tiers.setdefault(self.tier(s.n_bytes), []).append(s)
            full = [t for t, runs in sorted(tiers.items()) if t >= 0 and len(runs) >= self.fanin]
            merged = self._merge(tiers[full[0]]) if full else []
            if not full or len(merged) >= len(tiers[full[0]]):  # settled, or nothing to gain
                break
            gone = set(tiers[full[0]])
            shards = [s for s in shards if s not in gone] + merged
        if shards == start:
            return version
        while True:
            version, now = self.manifest()
            current = [Shard(**s) for s in now["shards"]]
            lost = set(start) - set(current)
            if lost:
                raise ConflictError("shards were compacted by another writer")
            before = set(start)
            kept = [s for s in shards if s in before] + [s for s in current if s not in before]
            try:
                return self._commit(version, now["schema"], kept, [s for s in shards if s not in before])
            except FileExistsError:
                continue

    def vacuum(self, keep_versions: int = 10, min_age_seconds: float = 7 * 86400) -> int:
        """Removes what no longer counts; the number of shards removed.

        The newest ``keep_versions`` versions stay readable.  A shard that none
        of them names goes when it is older than ``min_age_seconds``, which must
        exceed the longest time from a shard's writing to its commit.
        """
        newest = self.version()
        oldest = max(1, newest - keep_versions + 1)
        named = {s.path for v in range(oldest, newest + 1) for s in self.shards(v)}
        fs, manifests = scratch.filesystem(self.spark, f"{self.root}/manifests")
        for s in fs.listStatus(manifests) if fs.exists(manifests) else []:
            name = s.getPath().getName()
            if name.startswith("manifest-") and int(name[9:-5]) < oldest:
                fs.delete(s.getPath(), False)
        _, p = scratch.filesystem(self.spark, f"{self.root}/shards")
        now, gone = time.time() * 1000, 0
        for folder in fs.listStatus(p) if fs.exists(p) else []:
            at = f"shards/{folder.getPath().getName()}"
            for name, (_, written) in self._files(at).items():
                if f"{at}/{name}" not in named and now - written >= 1000 * min_age_seconds:
                    gone += bool(fs.delete(scratch.filesystem(self.spark, f"{self.root}/{at}/{name}")[1], False))
        return gone

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with ``shard`` (the file's name)."""
        from pyspark.sql.types import StructType

        _, now = self.manifest(version)
        if now["schema"] is None:
            raise ValueError("the store is empty")
        schema = StructType.fromJson(json.loads(now["schema"]))
        if not now["shards"]:
            return self.spark.createDataFrame([], schema).withColumn("shard", F.lit(""))
        df = self.spark.read.schema(schema).parquet(*[f"{self.root}/{s['path']}" for s in now["shards"]])
        return df.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_metadata.file_name").alias("shard"))


def shard(docs: DataFrame, key: str = "doc_id", arrivals: int = 3, target_bytes: int = 64 << 20, fanin: int = 4) -> tuple[ShardStore, DataFrame]:
    """Stores ``docs`` in a new store in the shared folder: the store, and its rows with shard columns.

    The rows come in ``arrivals`` parts, dealt by a hash of ``key`` (nulls
    together); the store is compacted after each.  As nobody else writes to this
    store, what a compaction has replaced is removed at once.  A column named as
    one of the added ones (``shard``, ``shard_version``, ``shard_level``,
    ``shard_rows``, ``shard_bytes``) is replaced.
    """
    spark = docs.sparkSession
    own = ["shard", "shard_version", "shard_level", "shard_rows", "shard_bytes"]
    store = ShardStore(spark, scratch.fresh(spark, "store"), target_bytes, fanin)
    kept = docs.select([c for c in docs.columns if c not in own])
    for n in range(arrivals):
        store.append(kept.where(F.pmod(F.xxhash64(F.col(key)), F.lit(arrivals)) == n))
        version = store.compact()
        store.vacuum(keep_versions=1, min_age_seconds=0)
    table = [(s.path.rsplit("/", 1)[1], s.level, s.n_rows, s.n_bytes) for s in store.shards(version)]
    info = spark.createDataFrame(table, "shard string, shard_level int, shard_rows long, shard_bytes long")
    # one row for each file, so about 200 bytes for each target_bytes of data
    info = F.broadcast(info) if len(table) <= BROADCAST_SHARDS else info
    rows = store.read(version).join(info, "shard", "left").withColumn("shard_version", F.lit(version))
    return store, rows.select([c for c in rows.columns if c not in own] + own)

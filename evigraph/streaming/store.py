"""A store of memories that survives: snapshots in Parquet, named by commits, written once for each batch.

The store is cut into buckets by scope. A write merges only the buckets it touches into new files
and then commits: the commit names the files of every bucket, the batch and the writer. A reader
sees the last commit only, so files of a write that was lost before its commit are never read. A
batch whose number the last commit of its writer has reached already changes nothing, so a stream
that starts again after it was stopped anywhere writes each batch once.

Layout: ``data/<bucket>-<name>/`` Parquet, ``commits/<number>.json``. A commit is made by renaming
a finished file to its number, which fails if that number is taken: of two writers at once one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.operators import memory as M

BUCKETS = 64
SCOPE = ("namespace", "user_id", "project_id", "session_id")
SCHEMA = (
    "memory_id string, namespace string, user_id string, project_id string, session_id string, memory_type string, key string, content string, source string, "
    "confidence double, status string, created_at timestamp, updated_at timestamp, expires_at string, metadata map<string,string>"
)
_KEY = (*SCOPE, "memory_type", "key")


def _same(a: str, b: str) -> Column:
    """Rows of one key, blank scopes being equal to null ones."""
    test = F.lit(True)
    for c in _KEY:
        test = test & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return test


def keyed(candidates: DataFrame, at: Column) -> DataFrame:
    """Candidates as rows of the store: scopes stripped, content stripped, confidence in [0, 1], ids from scope, type and key.

    The key is the content in lower case with single blanks. Candidates need namespace, user_id,
    project_id, session_id, memory_type, content, ord; source, confidence, expires_at and metadata
    where they have them. Those without a namespace or content are left out.
    """
    have = lambda c, kind, other: (F.col(c).cast(kind) if c in candidates.columns else F.lit(None).cast(kind)) if other is None else F.coalesce(F.col(c).cast(kind) if c in candidates.columns else F.lit(None).cast(kind), other)
    d = candidates.select(
        *(T.strip(F.col(c).cast("string")).alias(c) for c in SCOPE), F.coalesce(F.col("memory_type"), F.lit("note")).alias("memory_type"), T.strip(F.col("content")).alias("content"),
        F.coalesce(F.nullif(T.strip(have("source", "string", None)), F.lit("")), F.lit("agent")).alias("source"), T.clip(have("confidence", "double", F.lit(1.0))).alias("confidence"),
        F.nullif(have("expires_at", "string", None), F.lit("")).alias("expires_at"), have("metadata", "map<string,string>", F.create_map().cast("map<string,string>")).alias("metadata"), F.col("ord").cast("long").alias("ord"),
    ).filter("namespace <> '' and content <> ''")
    d = d.withColumn("key", T.plain(F.col("content")))
    name = F.concat(F.lit("mem_"), F.md5(F.concat_ws("\u0001", *_KEY)))
    return d.withColumn("memory_id", name).withColumn("status", F.lit("active")).withColumn("created_at", at).withColumn("updated_at", at)


def merge(held: DataFrame, new: DataFrame, at: Column, as_of: str | None = None) -> DataFrame:
    """held with the rows of keyed(): an active row of the same scope, type and key takes them up, other keys are added.

    Taken up are the best confidence, the last source, the last expiry that is given and all
    metadata, later pairs winning; updated_at becomes at. Of several new rows of one key the first
    by ord gives the content. A row that is not active stays as it is, and the key begins anew. No
    row of a key is ever brought into one list: a key may hold a third of all candidates.
    """
    first = F.struct("ord", "content", "source")
    given = F.col("expires_at").isNotNull()
    sums = new.groupBy(*_KEY, "memory_id").agg(
        F.min_by("content", first).alias("content"), F.max_by("source", F.struct("ord", "source")).alias("source"), F.max("confidence").alias("confidence"),
        F.max_by(F.when(given, F.col("expires_at")), F.when(given, F.struct("ord", "expires_at"))).alias("expires_at"),
    )
    pairs = new.select("memory_id", "ord", F.explode("metadata").alias("k", "v")).groupBy("memory_id", "k").agg(F.max_by("v", F.struct("ord", F.coalesce("v", F.lit("")))).alias("v"))
    told = pairs.groupBy("memory_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("told"))
    none = F.create_map().cast("map<string,string>")
    incoming = sums.join(told, "memory_id", "left").withColumn("told", F.coalesce("told", none))
    live = M.active(held, as_of) if as_of else held.filter("status = 'active'")
    rest = held.join(live.select("memory_id"), "memory_id", "left_anti")
    both = live.alias("h").join(incoming.alias("n"), _same("h", "n"), "full")
    h, n = (lambda c: F.col(f"h.{c}")), (lambda c: F.col(f"n.{c}"))
    hit, old = n("memory_id").isNotNull(), h("memory_id").isNotNull()
    own = F.coalesce(h("metadata"), none)
    kept = F.map_filter(own, lambda k, _: ~F.coalesce(F.map_contains_key(n("told"), k), F.lit(False)))
    # a key that was given up before keeps its old row, so that its new one needs another id
    again = rest.select(F.col("memory_id").alias("_gone")).distinct()
    out = both.select(
        F.coalesce(h("memory_id"), n("memory_id")).alias("memory_id"), *(F.coalesce(h(c), n(c)).alias(c) for c in _KEY), F.coalesce(h("content"), n("content")).alias("content"), F.coalesce(n("source"), h("source")).alias("source"),
        F.greatest(h("confidence"), n("confidence")).alias("confidence"), F.coalesce(h("status"), F.lit("active")).alias("status"), F.coalesce(h("created_at"), at).alias("created_at"),
        F.when(hit, at).otherwise(h("updated_at")).alias("updated_at"), F.coalesce(n("expires_at"), h("expires_at")).alias("expires_at"), F.when(hit & old, F.map_concat(kept, n("told"))).when(old, own).otherwise(n("told")).alias("metadata"), (~old).alias("_new"),
    )
    fresh = out.join(again, F.col("memory_id") == F.col("_gone"), "left")
    named = F.when(F.col("_new") & F.col("_gone").isNotNull(), F.concat(F.lit("mem_"), F.md5(F.concat_ws("\u0001", "memory_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))))).otherwise(F.col("memory_id"))
    cols = [c.split()[0] for c in SCHEMA.split(", ")]
    return rest.select(cols).unionByName(fresh.withColumn("memory_id", named).select(cols))


class MemoryStore:
    """Memories under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at("commits"))
        held = self._last()
        if held and held["buckets"] != buckets:
            raise ValueError(f"the store has {held['buckets']} buckets")

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _last(self) -> dict | None:
        """The last commit; one small file whatever the store holds."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("commits"))]
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]
        if not numbers:
            return None
        stream = self._fs.open(self._at(f"commits/{max(numbers):010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def version(self) -> int:
        held = self._last()
        return held["version"] if held else 0

    def read(self) -> DataFrame:
        """All memories of the last commit."""
        held = self._last()
        return self._files(held["files"].values() if held else [])

    def _files(self, names) -> DataFrame:
        names = sorted(set(names))
        return self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/data/{n}" for n in names)) if names else self.spark.createDataFrame([], SCHEMA)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*SCOPE), F.lit(self.buckets)).cast("int")

    def _commit(self, files: dict[str, str], writer: str, batch: int) -> int:
        held = self._last() or {"version": 0, "files": {}, "writers": {}}
        told = {"version": held["version"] + 1, "buckets": self.buckets, "files": held["files"] | files, "writers": held["writers"] | {writer: batch}}
        draft = self._at(f"commits/draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(told).encode()))
        finally:
            stream.close()
        target = self._at(f"commits/{told['version']:010d}.json")
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            raise RuntimeError("another writer has committed meanwhile")
        return told["version"]

    def done(self, writer: str, batch: int) -> bool:
        held = self._last()
        return bool(held) and held["writers"].get(writer, -1) >= batch

    def _rewrite(self, touched: DataFrame, change, writer: str, batch: int) -> bool:
        """Change the buckets that touched (column b) names, and commit. At most ``buckets`` numbers come to the driver."""
        if self.done(writer, batch):
            return False
        names = [r["b"] for r in touched.select("b").distinct().collect()]
        held = self._last() or {"files": {}}
        old = self._files(held["files"][str(b)] for b in names if str(b) in held["files"])
        name = uuid.uuid4().hex
        change(old).withColumn("bucket", self._bucket()).repartition("bucket", F.pmod(F.xxhash64("memory_id"), F.lit(4))).write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")
        found = {int(s.getPath().getName().split("=")[1]) for s in self._fs.listStatus(self._at(f"data/{name}")) if "=" in s.getPath().getName()}
        files = {str(b): f"{name}/bucket={b}" for b in found}
        gone = {b for b in names if b not in found and str(b) in held["files"]}
        if gone:  # every row of these was forgotten
            self.spark.createDataFrame([], SCHEMA).write.parquet(f"{self.path}/data/{name}-empty")
            files |= {str(b): f"{name}-empty" for b in gone}
        self._before_commit()
        self._commit(files, writer, batch)
        return True

    def _before_commit(self) -> None:
        """Where a test stops a write."""

    def write(self, candidates: DataFrame, at: str, writer: str = "batch", batch: int = 0) -> bool:
        """Merge candidates (see keyed) at a time; False if this batch of this writer was written before.

        Candidates that memory.screen() gives a reason for should be left out before.
        """
        when = F.lit(at).cast("timestamp")
        new = keyed(candidates, when)
        return self._rewrite(new.select(self._bucket().alias("b")), lambda old: merge(old, new, when), writer, batch)

    def set_status(self, ids: DataFrame, status: str, at: str, writer: str = "status", batch: int = 0) -> bool:
        """Give the memories named in ids (memory_id) a status; they are looked for in all buckets."""
        named = ids.select("memory_id").distinct()
        touched = self.read().join(named, "memory_id", "left_semi").select(self._bucket().alias("b"))

        def change(old: DataFrame) -> DataFrame:
            hit = old.join(named.withColumn("_hit", F.lit(True)), "memory_id", "left")
            return hit.withColumn("status", F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("status"))).withColumn("updated_at", F.when(F.col("_hit"), F.lit(at).cast("timestamp")).otherwise(F.col("updated_at"))).select(old.columns)

        return self._rewrite(touched, change, writer, batch)

    def forget(self, ids: DataFrame, writer: str = "forget", batch: int = 0) -> bool:
        """Take the memories named in ids (memory_id) out."""
        named = ids.select("memory_id").distinct()
        touched = self.read().join(named, "memory_id", "left_semi").select(self._bucket().alias("b"))
        return self._rewrite(touched, lambda old: M.forget(old, named), writer, batch)

    def clean(self) -> int:
        """Delete files that the last commit does not name; run it while nobody writes. Returns how many folders went."""
        held = self._last()
        used = {f.split("/")[0] for f in (held["files"].values() if held else [])}
        gone = [s.getPath() for s in self._fs.listStatus(self._at("data")) if s.getPath().getName() not in used] if self._fs.exists(self._at("data")) else []
        for path in gone:
            self._fs.delete(path, True)
        return len(gone)


def write_stream(candidates: DataFrame, store: MemoryStore, checkpoint: str, writer: str, at: str, **options):
    """A stream of candidates (with the columns that memory.screen needs) into a store; each batch is written once.

    ``at`` stamps the rows, so that a batch that is run again gives the same rows. Returns the writer of the stream, not started.
    """

    def put(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            scope = F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SCOPE))
            clean = M.screen(held.withColumn("scope", scope), **options).filter("reason is null")
            store.write(clean, at, writer, number)
        finally:
            held.unpersist()

    return candidates.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append")


__all__: Sequence[str] = ("MemoryStore", "keyed", "merge", "write_stream")

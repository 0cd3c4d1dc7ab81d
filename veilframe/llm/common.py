"""Shared pieces: scratch tables in the cluster's checkpoint folder, labelled samples and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The scratch tables of the scope that is open, if one is.
_OPEN: ContextVar[list[str] | None] = ContextVar("veilframe_scratch", default=None)
_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only where none is named and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = _LOCAL.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="veilframe-"))
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below scratch_dir(); it goes with the scope that is open, and at the latest when the driver's JVM ends."""
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    held = _OPEN.get()
    if held is not None:
        held.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving all scratch made within; what is to stay has to be written before, to a path made outside."""
    mark = _OPEN.set([])
    try:
        yield
    finally:
        held = _OPEN.get() or []
        _OPEN.reset(mark)
        for path in held:
            _delete(spark, path)


def materialize(df: DataFrame, tag: str, *, path: str | None = None, codec: str | None = None) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it back, so that lost executors cost no recomputation."""
    path = path or scratch_path(df.sparkSession, tag)
    writer = df.write if codec is None else df.write.option("compression", codec)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table written by materialize() that nothing reads any more."""
    path = getattr(df, "_scratch", None)
    if path:
        _delete(df.sparkSession, path)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let no Arrow batch hold more rows than this, so that a worker's memory is that of some texts, not of ten thousand."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def fold_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids have fold null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(fold_of(doc_id, modulus) == F.lit(remainder), F.lit(False))


def labelled_ids(labels: DataFrame, label: str, *, modulus: int = 0, remainder: int = 0, per_class: int | tuple[int, int] | None) -> DataFrame:
    """At most per_class ids of each class (doc_id, y), lowest hash first; rows of the held-out fold never enter.

    per_class may be two numbers, for y = 0 and for y = 1, or None for all ids. Of an id with several labels the largest counts; null ids and null
    labels are left out.
    """
    rows = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    if modulus:
        rows = rows.where(fold_of(F.col("doc_id"), modulus) != F.lit(remainder))
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    if per_class is None:
        return rows
    none, some = (per_class, per_class) if isinstance(per_class, int) else per_class
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return rows.where("y = 1").orderBy(*order).limit(some).unionByName(rows.where("y = 0").orderBy(*order).limit(none))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, *, per_class: int | tuple[int, int], max_chars: int, modulus: int = 0, remainder: int = 0) -> DataFrame:
    """(doc_id, y, text): the bounded sample that a model is fitted on, one row a labelled id, whole texts.

    The ids are those of labelled_ids(); of rows that share an id the one whose text has the greatest hash stands for it. In the order
    of the ids' hashes a row enters if its code points still fit into max_chars, so both rows and characters are bounded
    and what is chosen does not depend on how the table is split.
    """
    ids = labelled_ids(labels, label, modulus=modulus, remainder=remainder, per_class=per_class)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(ids), "doc_id").withColumn("h", F.xxhash64("text"))
    sizes = rows.groupBy("doc_id").agg(F.max(F.struct("h", F.char_length("text").alias("n"), "y")).alias("m")).select("doc_id", "m.*")
    chosen, room = [], max_chars
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_class if isinstance(per_class, int) else sum(per_class)).collect():
        if r["n"] <= room:
            chosen.append((r["doc_id"], r["h"]))
            room -= r["n"]
    pick = docs.sparkSession.createDataFrame(chosen, "doc_id long, h long")
    return rows.join(F.broadcast(pick), ["doc_id", "h"]).groupBy("doc_id").agg(F.max("y").alias("y"), F.first("text").alias("text"))


def connected_components(edges: DataFrame, tag: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reachable.

    edges has columns a, b (long). Alternating large-star and small-star steps: every step is a grouped
    minimum (combined before the shuffle) and a join back, so a hot node is split by the adaptive skew join, and
    nothing is gathered in one task or on the driver. Each round is written to the shared folder.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), tag)
    seen = None
    for _ in range(max_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        step = materialize(small, tag)
        mark = step.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        discard(now)
        now = step
        if seen == (mark["n"], mark["h"]) or not mark["n"]:
            break
        seen = (mark["n"], mark["h"])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    out._scratch = now._scratch
    return out

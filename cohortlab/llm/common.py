"""What the operators of this subpackage share: table access, intermediate tables, word rules and bounded caches."""

from __future__ import annotations


import tempfile
import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word rule is exactly these six bytes; everything else belongs to words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


class Memo(dict):
    """What a worker has worked out for short keys; ``trim`` forgets it all once it takes about ``limit`` bytes. A worker
    process serves one stage after the other, and holds the memo of one operator only: see ``claim``."""

    holder: Memo | None = None

    def __init__(self, limit: int = 128 << 20):
        super().__init__()
        self.limit, self.held = limit, 0

    @staticmethod
    def claim(own: Memo | None) -> None:
        """Empties the memo that another operator left in this process."""
        if Memo.holder is not None and Memo.holder is not own:
            Memo.holder.clear()
            Memo.holder.held = 0
        Memo.holder = own

    def keep(self, key, value, size: int) -> bool:
        """Whether the key is short enough to be kept. ``size`` is the value's."""
        short = len(key) <= 64
        if short:
            self.held += 200 + len(key) + size
            self[key] = value
        return short

    def trim(self) -> None:
        if self.held > self.limit:
            self.clear()
            self.held = 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file lies. The package that ships them is optional."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where none is configured and Spark runs inside
    one JVM, a temporary folder serves."""
    jsc = spark.sparkContext._jsc.sc()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and jsc.getCheckpointDir().isDefined():
        configured = jsc.getCheckpointDir().get()
    if not configured:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="cohortlab-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def small_batches(spark: SparkSession) -> None:
    """Rows are whole texts, so Spark's usual 10,000 to an Arrow batch would be far more than a task works on at once; a
    session that sets the number itself keeps it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "2000")


class Scratch:
    """Intermediate Parquet tables in the shared folder: written once, so that their lineage ends there."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more, and lets Spark clean the shuffles that fed them."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        jvm.System.gc()


def unused_name(df: DataFrame, base: str) -> str:
    """A column name that the frame lacks, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while base in taken:
        base = f"_{base}"
    return base


def partition_names(parts: int) -> np.ndarray:
    """For each of so many partitions an int that Spark's hash partitioning sends there, so that rows dealt by hand into
    as many buckets fill them evenly. It is murmur3 of 32 bits, seed 42."""
    names, at = np.full(parts, -1, np.int32), 0
    while (names < 0).any():
        some = np.arange(at, at + 4 * parts, dtype=np.uint32)
        h = some * np.uint32(0xCC9E2D51)
        h = ((h << np.uint32(15)) | (h >> np.uint32(17))) * np.uint32(0x1B873593) ^ np.uint32(42)
        h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
        place = h.view(np.int32) % np.int32(parts)
        fresh = names[place] < 0
        names[place[fresh]] = some[fresh].view(np.int32)
        at += 4 * parts
    return names


def let(value: Column, body) -> Column:
    """``body`` applied to ``value``, which is computed once per row whatever ``body`` does with it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def fold(key: Column) -> Column:
    """The fold of a document: crc32 of its id written in decimal, modulo 4."""
    return F.crc32(key.cast("string").cast("binary")) % 4


def batches_of(arrow_batches, names: list[str], limit: int = 8 << 20, memo: Memo | None = None):
    """Lists of rows (tuples of the named columns), cut so that one list holds about ``limit`` characters.
    A row longer than that comes alone; it is never split. ``memo`` is the one that the task will use, if any."""
    Memo.claim(memo)
    for batch in arrow_batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        rows, size = [], 0
        for start in range(0, batch.num_rows, 256):
            part = [c.slice(start, 256).to_pylist() for c in columns]
            for row in zip(*part):
                rows.append(row)
                size += 64 + sum(len(v) for v in row if isinstance(v, (str, bytes)))
                if size >= limit:
                    yield rows
                    rows, size = [], 0
        if rows:
            yield rows




def slices_of(arrow_batches, name: str, limit: int = 8 << 20, memo: Memo | None = None):
    """Slices of the batches, all columns, that hold about ``limit`` bytes of the named text column each. A row longer than
    that comes alone."""
    Memo.claim(memo)
    for batch in arrow_batches:
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(name))).fill_null(0).to_numpy(zero_copy_only=False)
        total, at = np.cumsum(sizes.astype(np.int64)), 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


def restrict(df: DataFrame, keys: list[str], ids: DataFrame, limit: int, how: str = "left_semi") -> DataFrame:
    """The rows whose keys are (or, by left_anti, are not) among the rows of ``ids``, which names as many columns. Up to
    ``limit`` of them are broadcast; beyond, both sides are shuffled."""
    names = [unused_name(df, f"wanted{i}") for i in range(len(keys))]
    ids = ids.toDF(*names).distinct()
    if ids.count() <= limit:
        ids = F.broadcast(ids)
    match = F.lit(True)
    for key, name in zip(keys, names):
        match = match & (F.col(key) == F.col(name))
    return df.join(ids, match, how)

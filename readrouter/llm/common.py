"""What the text operators share: the shared folder, staged tables, calls into Python workers."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

_own_folder: dict[str, str] = {}
_marked: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session has one of its own; a cluster is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="readrouter-")
        spark.sparkContext.setCheckpointDir(_own_folder[app])
    return _own_folder[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors. The folder of an application goes when its driver ends."""
    spark = df.sparkSession
    own = f"{shared_dir(spark)}/readrouter-{spark.sparkContext.applicationId}"
    if own not in _marked:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _marked.add(own)
    path = f"{own}/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package where the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


#: Bytes of a batch that goes to a Python worker, and the rest of its last row. An executor holds a batch and what comes back several times over
#: outside its heap, for each core, and a worker holds it as objects; 10,000 rows of whole texts were some 35 MB.
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the bytes of an Arrow batch to BATCH_BYTES, where it is higher. Rows are the same, in more batches."""
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_KEY)) > BATCH_BYTES:
        spark.conf.set(_BATCH_KEY, f"{BATCH_BYTES}b")


def give_back() -> None:
    """Return freed memory to the system; the allocators would keep it."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def _tidy(batches, function):
    """What function makes of the batches. A worker outlives its task and waits for others, so what the task freed goes back at its end."""
    yield from function(batches)
    give_back()


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    importable(df.sparkSession)
    bounded_batches(df.sparkSession)
    return df.mapInArrow(partial(_tidy, function=function), schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves no remainder by 5: rows no model may learn from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """The schema of df and, after it, the fields of ddl."""
    return StructType([*(StructField(f.name, f.dataType, True) for f in df.schema), *_parse_datatype_string(ddl)])


#: Id sets up to this size are broadcast (8 bytes each); larger ones are joined by a shuffle.
BROADCAST_IDS = 500_000


def sized(ids: DataFrame) -> DataFrame:
    """A staged table of a few bytes for each id, to be broadcast where it is small and else dealt by a shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_merge")


def keep_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key stands in ids, a staged table of that one column."""
    return rows.join(sized(ids), key, "left_semi")


def drop_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key doesn't stand in ids; null keys stay."""
    return rows.join(sized(ids), key, "left_anti")


def slices(batch, text_at: int, size: int = 1_000_000):
    """The batch in parts of about `size` bytes of text, so that what is made of it stays small."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
    parts = (lengths.cumsum() - lengths) // size
    edges = [0, *((parts[1:] != parts[:-1]).nonzero()[0] + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)

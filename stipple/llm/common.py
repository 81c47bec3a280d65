"""What the operators of this subpackage share: tables, checkpoints, Arrow batches and word splitting."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

#: Bytes of one Arrow batch, about.  Texts can be long, so a batch must stay small enough for a Python worker, while
#: batches of numbers may hold as many rows as the session says.
BATCH_BYTES = 1 << 20
_BATCH_CONF, _DEFAULT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

MULT = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Arrow batches limited by their bytes (unless the session chose a size) and a checkpoint folder (unless it has one).

    On a cluster the folder must be one that all machines share: only a session whose tasks run on the driver's own
    machine gets a temporary folder.
    """
    if spark.conf.get(_BATCH_CONF, _DEFAULT_BATCH) == _DEFAULT_BATCH:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="stipple-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder and reread.

    A written table is computed once (checkpoint() runs the plan twice), is compressed, and outlives its executors.
    It goes when the session ends, or with drop().
    """
    spark = df.sparkSession
    prepare(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stipple-{uuid.uuid4().hex}"
    df.write.parquet(path)
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    file.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(file)
    out = spark.read.schema(df.schema).parquet(path)
    out._stipple_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote and that no plan needs any more."""
    for df in tables:
        spark = df.sparkSession
        file = spark._jvm.org.apache.hadoop.fs.Path(df._stipple_path)
        file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, True)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done.

    They go when the driver's garbage is collected, which a driver with room to spare does not do for half an hour.
    """
    gc.collect()
    spark._jvm.System.gc()


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; null counts as empty.  bytes.split() cuts at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """As words(), with A-Z lower-cased first; bytes.lower() touches ASCII letters only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def gathered(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until their column holds about `size` bytes."""
    own, held = [], 0
    for b in batches:
        own.append(b)
        held += b.column(column).nbytes
        if held >= size:
            yield pa.concat_batches(own)
            own, held = [], 0
    if own:
        yield pa.concat_batches(own)


def finish(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (three xor-shifts and two odd multipliers), so that sums of word hashes spread over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n word hashes (uint64), by doubling: O(log n) passes."""
    if len(w) < n:
        return np.empty(0, np.uint64)
    out, done, power, size, mult = None, 0, w, 1, np.uint64(MULT)
    todo = n
    with np.errstate(over="ignore"):
        while todo:
            if todo & 1:
                if out is None:
                    out, done = power, size
                else:  # the run so far, then the next `size` words
                    keep = len(power) - done
                    out, done = out[:keep] * mult + power[done : done + keep], done + size
            todo >>= 1
            if todo:
                power = power[:-size] * mult + power[size:]
                size *= 2
                mult = mult * mult
        return finish(out[: len(w) - n + 1])


def kind_of(kind: DataType) -> str:
    """A type as DDL, with the names of its fields quoted, so that they may hold any character."""
    if isinstance(kind, StructType):
        return "struct<" + ",".join(f"`{f.name.replace('`', '``')}`:{kind_of(f.dataType)}" for f in kind.fields) + ">"
    if isinstance(kind, ArrayType):
        return f"array<{kind_of(kind.elementType)}>"
    if isinstance(kind, MapType):
        return f"map<{kind_of(kind.keyType)},{kind_of(kind.valueType)}>"
    return kind.simpleString()


def column(df: DataFrame, name: str, kind: str) -> F.Column:
    """A column by its exact name, cast; quoted, so that dots in a name do no harm."""
    return F.col(f"`{name}`").cast(kind)

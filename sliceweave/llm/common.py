"""Helpers shared by the operators: row keys, batch functions, words as bytes, per-process tables."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import pickle
import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from sliceweave.session import scratch_path

_A, _Z = ord("A"), ord("Z")
#: Bytes that separate alphanumeric words: 00-2F, 3A-60 and 7B-7F once A-Z are lower case.
WORD_BYTES = bytes(
    b + 32 if _A <= b <= _Z else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
#: Rows handed to a function at once; bounds what a worker holds beside its Arrow batch.
ROWS = 1024
#: Spark's setting for the bytes of an Arrow batch, and the most that is left there: a batch stands in the worker and, outside the
#: heap, in the JVM, on the way in and out. Only memory depends on it.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
_PROCESS: dict = {}
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of ASCII letters, digits and non-ASCII characters, as UTF-8."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class Shared:
    """A broadcast value of bounded size, and what each worker process builds from it and keeps for later tasks."""

    def __init__(self, spark: SparkSession, kind: str, value):
        self.name = (kind, hashlib.md5(pickle.dumps(value)).hexdigest())
        self.sent = spark.sparkContext.broadcast(value)

    def get(self, build: Callable):
        """``build(value)`` of this process. A worker keeps one table: the next operator's replaces it."""
        if self.name not in _PROCESS:
            release()
            _PROCESS[self.name] = build(self.sent.value)
        return _PROCESS[self.name]


def release(but: Shared | None = None) -> None:
    """Give back the table that an earlier operator left in this worker process, unless it is that of ``but``."""
    if _PROCESS and not (but and but.name in _PROCESS):
        _PROCESS.clear()
        gc.collect()
        trim()


def trim() -> None:
    """Give freed memory back to the system: allocators keep it, and a worker lives as long as its executor."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def bound_batches(spark: SparkSession) -> None:
    """Batches of ``BATCH_BYTES`` from now on in this session, as Spark reads the setting when a job begins; a smaller one stays."""
    held = re.fullmatch(r"(\d+)([kmg]?)b?", str(spark.conf.get(BATCH_CONF)).strip().lower())
    if not held or not 0 < int(held[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[held[2]] <= BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def map_rows(df: DataFrame, inputs: Sequence[str], fields: str, function: Callable[..., Mapping], keep: Sequence[str] = (),
             shared: Shared | None = None) -> DataFrame:
    """Columns ``keep`` as they are, and those that ``function(*inputs)`` makes of each Arrow batch (a dict by field name).

    ``fields`` is a DDL string. Only ``keep`` and ``inputs`` are sent to Python, so extra columns of any name do no harm.
    ``shared`` is what ``function`` reads; a worker gives back every other table before it reads rows.
    """
    bound_batches(df.sparkSession)
    made = StructType.fromDDL(fields)
    keep_types = {f.name: f for f in df.schema.fields}
    sent = df.select(*[F.col(f"`{k}`") for k in keep], *[F.col(f"`{name}`").alias(f"__in{i}") for i, name in enumerate(inputs)])
    kept, types = len(keep), [to_arrow_type(f.dataType) for f in made.fields]
    names = [*keep, *made.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(shared)
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            columns = function(*batch.columns[kept:])
            new = [columns[n] if isinstance(columns[n], pa.Array) else pa.array(columns[n], t) for n, t in zip(made.names, types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *new], names=names)
        trim()

    return sent.mapInArrow(run, StructType([*[keep_types[k] for k in keep], *made.fields]))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, fixes row positions, keeps column pruning."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

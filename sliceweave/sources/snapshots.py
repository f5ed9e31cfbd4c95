"""Versioned outputs: a reader sees one whole version, and a writer that fails or comes second changes nothing.

Every version is a folder of its own below ``root``. A small pointer file names the current one; it is written beside and
renamed into place last, which a file system does at once. Old versions stay until ``remove_old``, so that readers end.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from sliceweave.operators.guards import ContractError

POINTER = "_current"


def files(spark: SparkSession, path: str):
    """File system of a path, and the path with its scheme."""
    jvm = spark.sparkContext._jvm
    plain = jvm.org.apache.hadoop.fs.Path(path)
    system = plain.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system, system.makeQualified(plain)


def _point(spark: SparkSession, root: str, version: str, replace: bool) -> bool:
    """Make ``version`` the current one; without ``replace`` only where there is none. Whether it was made so."""
    context = spark.sparkContext
    fs = context._jvm.org.apache.hadoop.fs
    system, pointer = files(spark, f"{root}/{POINTER}")
    beside = fs.Path(pointer.getParent(), f"_pointer-{uuid.uuid4().hex}")
    out = system.create(beside, False)
    out.write(bytearray(version.encode()))
    out.close()
    kind = getattr(fs, "Options$Rename")
    options = context._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE if replace else kind.NONE
    try:
        fs.FileContext.getFileContext(pointer.toUri(), context._jsc.hadoopConfiguration()).rename(beside, pointer, options)
    except Py4JJavaError as error:
        system.delete(beside, False)
        if not replace and system.exists(pointer):
            return False
        raise error
    return True


def current(spark: SparkSession, root: str) -> str | None:
    """Folder of the current version, None before the first."""
    system, pointer = files(spark, f"{root}/{POINTER}")
    if not system.exists(pointer):
        return None
    stream = system.open(pointer)
    try:
        return f"{root}/{spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8')}"
    finally:
        stream.close()


def publish(spark: SparkSession, root: str, write: Callable[[str], None], replace: bool = True) -> bool:
    """``write`` fills a new folder; then it becomes the current version. Whether it did (``replace`` False: only the first).

    If ``write`` fails, the version before it stays the current one and the unfinished folder goes.
    """
    version = f"v-{uuid.uuid4().hex}"
    try:
        write(f"{root}/{version}")
        made = _point(spark, root, version, replace)
    except BaseException:
        _drop(spark, f"{root}/{version}")
        raise
    if not made:
        _drop(spark, f"{root}/{version}")
    return made


def _drop(spark: SparkSession, path: str) -> None:
    system, folder = files(spark, path)
    system.delete(folder, True)


def remove_old(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete all versions but the current one and the newest up to ``keep`` in all; how many went. No other writer may be at work."""
    held = current(spark, root)
    system, folder = files(spark, root)
    old = [s for s in system.listStatus(folder) if s.isDirectory() and s.getPath().getName().startswith("v-")]
    old = [s for s in old if held is None or s.getPath().getName() != held.rsplit("/", 1)[-1]]
    old = sorted(old, key=lambda s: -s.getModificationTime())[max(0, keep - (held is not None)):]
    for status in old:
        system.delete(status.getPath(), True)
    return len(old)


#: Outputs of a split, the manifest last.
SPLIT = ("folds", "targets", "distribution", "manifest")


def export_split(root: str, folds: DataFrame, targets: DataFrame, distribution: DataFrame, manifest: DataFrame) -> None:
    """All outputs of a split, once: the first writer's stay, an equal manifest (one row) changes nothing, another is refused.

    Rivals may write at the same time; only one becomes current, and the others compare their manifest with its.
    """
    spark = folds.sparkSession
    manifest = manifest.coalesce(1)
    row = manifest.collect()

    def write(folder: str) -> None:
        for name, df in zip(SPLIT, (folds, targets, distribution, spark.createDataFrame(row, manifest.schema))):
            writer = df.write.partitionBy("fold") if name == "folds" else df.write
            writer.parquet(f"{folder}/{name}")

    if current(spark, root) is None and publish(spark, root, write, replace=False):
        return
    held = read_split(spark, root)["manifest"]
    if sorted(held.columns) != sorted(manifest.columns) or held.select(*manifest.columns).collect() != row:
        raise ContractError(f"a different split manifest exists in {root}")


def read_split(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    folder = current(spark, root)
    if folder is None:
        raise ContractError(f"no split in {root}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in SPLIT}

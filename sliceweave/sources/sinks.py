"""Writers. ``replace_csv`` and ``replace_json`` publish a new version as a whole or not at all; the plain ones write one folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from sliceweave.operators import guards
from sliceweave.operators.ensemble import prediction_report
from sliceweave.sources import snapshots


def append_jsonl(df: DataFrame, path: str) -> None:
    """Adds rows to an append-only log; NULL fields stay in the text."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


#: Texts of any kind come back as they are: outer white space is kept, and a zero byte before a quote is no escape.
CSV = {"header": "true", "quote": '"', "escape": '"', "charToEscapeQuoteEscaping": '"', "encoding": "UTF-8", "nullValue": "", "emptyValue": '""',
       "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
#: Rows in a file of long texts at most, as a file with line breaks inside quotes is read by one task.
TEXT_ROWS = 20_000


def write_csv(df: DataFrame, path: str, per_file: int = 0) -> None:
    """One folder of CSV, with at most ``per_file`` rows in a file (0: one file for each task)."""
    df.write.mode("overwrite").options(**CSV, maxRecordsPerFile=str(per_file)).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def replace_csv(df: DataFrame, root: str) -> None:
    """New version of a CSV output; a job that fails leaves the old one current."""
    snapshots.publish(df.sparkSession, root, lambda folder: write_csv(df, folder))


def replace_json(df: DataFrame, root: str) -> None:
    """New version of a JSON output; a job that fails leaves the old one current."""
    snapshots.publish(df.sparkSession, root, lambda folder: write_json(df, folder))


def write_exports(wide: DataFrame, detail: DataFrame, usage: DataFrame, root: str) -> None:
    """Label, detail and usage exports side by side."""
    for name, df in (("labels", wide), ("labels_detail", detail), ("usage", usage)):
        write_csv(df, f"{root}/{name}")


def write_submission(ordered: DataFrame, path: str, key: str, targets: Sequence[str], ordinal: str) -> None:
    """Writes after checking values and keys; rows keep the sample order across part files."""
    guards.enforce(prediction_report(ordered, key, targets))
    write_csv(ordered.orderBy(ordinal).select(key, *[f"`{t}`" for t in targets]), path)


def write_split(members: DataFrame, manifest: DataFrame, root: str) -> None:
    """Folds by partition, then their manifest; another manifest (one row) in place is refused before anything is written.

    Without a manifest the folds are the rest of a run that did not end, and are written anew.
    """
    spark = members.sparkSession
    try:
        stored = spark.read.parquet(f"{root}/manifest")
    except AnalysisException:
        stored = None
    manifest = manifest.coalesce(1)
    if stored is not None:
        if stored.collect() != manifest.select(*stored.columns).collect():
            raise guards.ContractError(f"a different split manifest exists in {root}")
        return
    members.write.mode("overwrite").partitionBy("fold").parquet(f"{root}/folds")
    manifest.write.mode("overwrite").parquet(f"{root}/manifest")

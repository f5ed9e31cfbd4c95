import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sliceweave.operators import guards, scoring, splits
from sliceweave.schemas import ATTEMPT, TARGETS, study_schema
from sliceweave.sources import readers, sinks
from sliceweave.streaming import attempts as stream

HEAD = '"StudyInstanceUID","Report",' + ",".join(f'"{t}"' for t in TARGETS)


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_study_csv_with_breaks_quotes_and_bom(spark, tmp_path):
    path = write(tmp_path / "train.csv", "﻿" + HEAD, '"a","first line\nsecond ""quoted"" line",' + ",".join(["1"] * 12), '"b","short",' + "," * 11)
    rows = {r["StudyInstanceUID"]: r for r in readers.read_studies(spark, path).collect()}
    assert rows["a"]["Report"] == 'first line\nsecond "quoted" line' and rows["a"]["Baker's"] == "1" and rows["b"]["ACL"] is None


def test_written_studies_come_back_as_they_are(spark, tmp_path):
    """White space around a report, zero bytes before quotes; many files, as each is read by one task."""
    reports = [" a ", "\ta\n", "\na\r", ' "a" ', 'a" ', 'a\0"b', 'a\0",b', "\x01\x02", "a\r\nb", '"', "\\", "a\0"]
    rows = [(str(i), report, "1", None) for i, report in enumerate(reports)]
    df = spark.createDataFrame(rows, study_schema(["x", "y"])).coalesce(1)
    sinks.write_csv(df, str(tmp_path / "studies"), per_file=5)
    assert sorted(map(tuple, readers.read_studies(spark, str(tmp_path / "studies"), ["x", "y"]).collect())) == sorted(rows)
    assert len(list((tmp_path / "studies").glob("part-*"))) == 3


@pytest.mark.parametrize("lines", [
    ['"a","x",' + "," * 11, '"a","y",' + "," * 11], ['"","x",' + "," * 11], ['"a"," ",' + "," * 11]])
def test_study_contract(spark, tmp_path, lines):
    with pytest.raises(guards.ContractError):
        readers.read_studies(spark, write(tmp_path / "bad.csv", HEAD, *lines))


def test_wrong_header_fails(spark, tmp_path):
    path = write(tmp_path / "h.csv", '"uid","Report"', '"a","x"')
    with pytest.raises((PySparkException, Py4JJavaError)):
        readers.read_studies(spark, path).collect()


def test_catalogue_and_listing(spark, tmp_path):
    labels = ",".join(f'"{t}"' for t in TARGETS)
    write(tmp_path / "train.csv", HEAD, '"a","x",' + "," * 11)
    for name in ("train_series", "test_series"):
        write(tmp_path / f"{name}.csv", "StudyInstanceUID,SeriesInstanceUID,Fluid_Sensitive,Fat_Suppression,Anatomical_Plane", "a,s2,1,1,Axial", "a,s1,,0,Coronal")
    write(tmp_path / "test.csv", "StudyInstanceUID", "a")
    write(tmp_path / "sample_submission.csv", f'"StudyInstanceUID",{labels}', "a," + ",".join(["0.5"] * 12))
    tables = readers.read_catalogue(spark, str(tmp_path))
    assert [r["SeriesInstanceUID"] for r in tables["train_series"].orderBy("ordinal").collect()] == ["s2", "s1"]
    assert tables["sample_submission"].first()["Fracture"] == 0.5 and tables["train_series"].where("Fluid_Sensitive IS NULL").count() == 1
    for name in ("s1/1.dcm", "s1/2.dcm", "s2/1.dcm", "s2/note.txt"):
        (tmp_path / "dcm" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "dcm" / name).write_bytes(b"x")
    from sliceweave.operators.catalog import attach_slice_counts, slice_counts

    counts = slice_counts(readers.read_listing(spark, str(tmp_path / "dcm")), r"/([^/]+)/[^/]+$").withColumnRenamed("folder", "SeriesInstanceUID")
    assert {(r["SeriesInstanceUID"], r["num_slices"]) for r in attach_slice_counts(tables["train_series"], counts, "SeriesInstanceUID").collect()} == {("s1", 2), ("s2", 1)}


def test_broken_json_line_stops_and_is_named(spark, tmp_path):
    path = write(tmp_path / "log.jsonl", json.dumps({"uid": "a", "attempt": 1}), '{"uid": "b", ', json.dumps({"uid": "c", "attempt": 2}))
    with pytest.raises((PySparkException, Py4JJavaError)):
        readers.read_jsonl(spark, path, ATTEMPT).collect()
    bad = readers.bad_json_lines(spark, path, ATTEMPT).collect()
    assert [r["_bad"] for r in bad] == ['{"uid": "b", '] and bad[0]["file"].endswith("log.jsonl") and bad[0]["line"] == 2


@pytest.mark.parametrize("block", [64, 1000, 10**8])
def test_line_numbers_of_files_in_many_parts(spark, tmp_path, block):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        expected = set()
        for name in ("a", "b", "c"):
            lines = [json.dumps({"uid": f"{name}{i}" * (1 + i % 7), "attempt": i}) if (i * 7) % 5 else f'{{"uid": "{name}{i}' for i in range(120)]
            lines[50] = ""
            (tmp_path / "logs").mkdir(exist_ok=True)
            write(tmp_path / "logs" / f"{name}.jsonl", *lines)
            expected |= {(name, i, line) for i, line in enumerate(lines, 1) if line and not line.endswith("}")}
        bad = readers.bad_json_lines(spark, str(tmp_path / "logs"), ATTEMPT).collect()
        assert {(r["file"].rsplit("/", 1)[1][0], r["line"], r["_bad"]) for r in bad} == expected and len(bad) == len(expected)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_predictions_contract(spark, tmp_path):
    head = "StudyInstanceUID,fold,x,y"
    expected = spark.createDataFrame([("a",), ("b",)], "StudyInstanceUID string")
    good = write(tmp_path / "p.csv", head, "a,1,0.5,1", "b,1,0,0.25")
    assert readers.read_predictions(spark, good, expected, 1, ["x", "y"]).count() == 2
    for name, lines in {"dup": ["a,1,0,0", "a,1,0,0"], "fold": ["a,0,0,0", "b,1,0,0"], "range": ["a,1,1.5,0", "b,1,0,0"], "nan": ["a,1,NaN,0", "b,1,0,0"],
                        "missing": ["a,1,0,0"], "foreign": ["a,1,0,0", "b,1,0,0", "c,1,0,0"]}.items():
        with pytest.raises(guards.ContractError):
            readers.read_predictions(spark, write(tmp_path / f"{name}.csv", head, *lines), expected, 1, ["x", "y"])


def test_submission_keeps_sample_order(spark, tmp_path):
    rows = spark.createDataFrame([(f"u{i * 7 % 10}", i, i / 10) for i in range(10)], "uid string, ordinal int, x double")
    sinks.write_submission(rows.repartition(4), str(tmp_path / "out"), "uid", ["x"], "ordinal")
    lines = [line for part in sorted((tmp_path / "out").glob("part-*")) for line in part.read_text().splitlines() if not line.startswith("uid")]
    assert [line.split(",")[0] for line in lines] == [f"u{i * 7 % 10}" for i in range(10)]
    with pytest.raises(guards.ContractError):
        sinks.write_submission(rows.withColumn("x", F.when(F.col("ordinal") > 3, F.col("x"))), str(tmp_path / "bad"), "uid", ["x"], "ordinal")


def test_another_manifest_is_refused(spark, tmp_path):
    members = spark.createDataFrame([("a", 0, "weak"), ("b", 1, "weak")], "uid string, fold int, split string")
    manifest = splits.manifest(members, members, "uid", [], "m", 1, 2)
    sinks.write_split(members, manifest, str(tmp_path / "s"))
    sinks.write_split(members, manifest, str(tmp_path / "s"))
    with pytest.raises(guards.ContractError):
        sinks.write_split(members, splits.manifest(members, members, "uid", [], "m", 2, 2), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/folds")).count() == 2


@pytest.mark.parametrize("files", [1, 2, 1000])
def test_stream_equals_batch(spark, tmp_path, files):
    """However the files fall into triggers, and whatever the order of their times, no row is lost."""
    schema = "uid string, attempt bigint, started_at timestamp, status string, input_tokens bigint, output_tokens bigint, total_tokens bigint"
    rows = [(f"u{i % 3}", i, f"2024-01-0{1 + (i * 7) % 4} 0{i % 10}:00:00", "ERROR" if i % 4 == 0 else "SUCCESS", *([None] * 3 if i % 5 == 0 else [i, 1, i + 1])) for i in range(40)]
    df = spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("started_at", F.col("started_at").cast("timestamp"))
    root = str(tmp_path)
    for part in (df.where("attempt < 25"), df.where("attempt >= 25")):
        sinks.append_jsonl(part.repartition(4), f"{root}/in")
        source = lambda: stream.read_attempts(spark, f"{root}/in", df.schema, files)
        stream.start_usage(source(), f"{root}/usage", f"{root}/c1").awaitTermination()
        stream.start_latest(source(), f"{root}/latest", f"{root}/c2").awaitTermination()
    both = ["window_start", "window_end", "attempts", "failures", *stream.TOKENS, "attempts_without_usage"]
    assert sorted(map(tuple, stream.usage(spark, f"{root}/usage").select(both).collect())) == sorted(map(tuple, stream.usage_by_window(df, "1 day").select(both).collect()))
    assert sorted(map(tuple, stream.latest(spark, f"{root}/latest").collect())) == sorted(map(tuple, stream.latest_state(df).collect()))


def test_compaction_keeps_the_batch_result_and_bounds_the_files(spark, tmp_path):
    """Late rows, repeated triggers (also of merged tables) and a failure between publication and the next trigger."""
    schema = "uid string, attempt bigint, started_at string, status string, input_tokens bigint, output_tokens bigint, total_tokens bigint"
    rows = [(f"u{i % 4}", i, f"2024-01-0{1 + (i * 7) % 4} 0{i % 10}:00:00", "ERROR" if i % 4 == 0 else "SUCCESS", i, 1, i + 1) for i in range(23)]
    df = spark.createDataFrame(rows, schema).withColumn("started_at", F.col("started_at").cast("timestamp"))
    usage, latest = str(tmp_path / "usage"), str(tmp_path / "latest")
    write = stream.writer(lambda batch: stream.usage_by_window(batch, "1 day"), stream._summed, usage, 4)
    write_latest = stream.writer(stream.latest_state, stream._newest, latest, 4)
    both = ["window_start", "window_end", "attempts", "failures", *stream.TOKENS, "attempts_without_usage"]
    for i in range(23):
        write(df.where(F.col("attempt") == i), i)
        if i in (3, 11, 14):
            write(df.where(F.col("attempt") == i), i)  # the trigger comes again after a restart
        write_latest(df.where(F.col("attempt") == i), i)
        if i in (2, 3, 9, 22):
            done = df.where(F.col("attempt") <= i)
            assert sorted(map(tuple, stream.usage(spark, usage).select(both).collect())) == sorted(map(tuple, stream.usage_by_window(done, "1 day").select(both).collect()))
            assert sorted(map(tuple, stream.latest(spark, latest).collect())) == sorted(map(tuple, stream.latest_state(done).collect()))
        assert len(list((tmp_path / "usage").glob("version=*"))) <= 8 and len(list((tmp_path / "usage" / "_compacted").glob("v-*"))) <= 2


def test_linear_heads_learn_and_ignore_missing(spark):
    rows = [(i, [float(i % 2), float(i % 5)], 0.9 if i % 2 else 0.1, None if i % 3 else 0.5) for i in range(60)]
    df = spark.createDataFrame(rows, "uid int, features array<double>, a double, b double")
    scores = scoring.score_heads(df, scoring.fit_heads(df, ["a"]), "uid").collect()
    assert all((r["a"] > 0.5) == bool(r["uid"] % 2) for r in scores)

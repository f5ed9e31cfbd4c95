"""The given tables read as studies, series, slices, label sources and logs.

Each model exists twice: as a DataFrame and as the SQL common table expression
of the same name, so that a query and its check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sliceweave.operators import catalog
from sliceweave.operators.ordering import hot_groups
from sliceweave.operators.reshape import to_long
from sliceweave.sources.tables import table

TARGETS = ["discount", "tax", "quantity", "returned"]
CROP_MM, IMAGE_SIZE = 60.0, 336
#: Slices, about, that one task orders.
SERIES_ROWS = 250_000

_SQL = {
    # documents as studies with a report; labels as their partial gold columns
    "studies": ((), """
        SELECT d.doc_id AS uid, d.text AS report, d.lang, d.source,
               CAST(l.quality AS DOUBLE) AS quality, CAST(l.toxic AS DOUBLE) AS toxic
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""),
    # lines of an order as slices of a series
    "slices": ((), """
        SELECT l_orderkey AS series, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp,
               l_extendedprice / 100 AS position, l_quantity * 2 AS te,
               CAST(400 + (l_partkey * 37) % 4000 AS DOUBLE) AS tr FROM lineitem"""),
    # slice headers: some unreadable, some degenerate, some without spacing
    "headers": (("slices",), """
        SELECT series, line, part, supp, part % 97 = 0 AS unreadable, te, tr,
               CASE WHEN supp % 41 = 0 THEN [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]::DOUBLE[]
                    WHEN (series + CASE WHEN supp % 43 = 0 THEN 1 ELSE 0 END) % 3 = 0 THEN [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]::DOUBLE[]
                    WHEN (series + CASE WHEN supp % 43 = 0 THEN 1 ELSE 0 END) % 3 = 1 THEN [0.0, 1.0, 0.0, 0.0, 0.0, 1.0]::DOUBLE[]
                    ELSE [0.0, 0.6, 0.8, 1.0, 0.0, 0.0]::DOUBLE[] END AS orientation,
               CASE series % 3 WHEN 0 THEN [0.0, 0.0, position]::DOUBLE[]
                               WHEN 1 THEN [position, 0.0, 0.0]::DOUBLE[]
                               ELSE [0.0, position * 0.8, position * -0.6]::DOUBLE[] END AS location,
               CASE WHEN line % 5 <> 0 THEN [0.2 + (part % 9) / 20, 0.2 + (supp % 11) / 25]::DOUBLE[] END AS pixel_spacing,
               CAST(200 + part % 300 AS INTEGER) AS rows, CAST(200 + supp % 300 AS INTEGER) AS columns
        FROM slices"""),
    # customers as studies, orders as their series
    "series": ((), """
        SELECT o_custkey AS study, o_orderkey AS series,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Sagittal'
                    WHEN o_orderpriority = '5-LOW' THEN 'Axial' ELSE 'Coronal' END AS plane,
               CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS fluid,
               CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INTEGER) AS fat,
               coalesce(num_slices, 0) AS num_slices, o_orderkey AS ordinal, o_orderdate
        FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS num_slices FROM lineitem GROUP BY 1)
             ON o_orderkey = l_orderkey"""),
    # label sources per order: old and new soft labels, gold, three predictors
    "order_sums": ((), """
        SELECT l_orderkey AS uid, count(*) AS n,
               CAST(sum(CAST(round(l_discount * 100) AS INTEGER)) AS BIGINT) AS sd,
               CAST(sum(CAST(round(l_tax * 100) AS INTEGER)) AS BIGINT) AS st,
               CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS sq,
               min(CAST(round(l_discount * 100) AS INTEGER)) AS d0, max(CAST(round(l_discount * 100) AS INTEGER)) AS d1,
               min(CAST(round(l_tax * 100) AS INTEGER)) AS t0, max(CAST(round(l_tax * 100) AS INTEGER)) AS t1,
               min(CAST(l_quantity AS INTEGER)) AS q0, max(CAST(l_quantity AS INTEGER)) AS q1,
               count(*) FILTER (l_returnflag = 'R') AS nr, count(*) FILTER (l_returnflag = 'A') AS na,
               count(*) FILTER (l_linestatus = 'F') AS nf
        FROM lineitem GROUP BY 1"""),
    "cells": (("order_sums",), """
        SELECT uid, target, old, new, p0, p1, p2, CAST(uid % 5 AS INTEGER) AS fold,
               CASE WHEN uid % 17 = 0 THEN CASE WHEN p0 + p2 >= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS gold
        FROM (
            SELECT uid, 'discount' AS target, sd / (10 * n) AS old, CASE WHEN uid % 7 <> 0 THEN d1 / 10 END AS new,
                   d0 / 10 AS p0, sd / (10 * n) AS p1, d1 / 10 AS p2 FROM order_sums
            UNION ALL
            SELECT uid, 'tax', st / (8 * n), CASE WHEN uid % 11 <> 0 THEN t1 / 8 END,
                   t0 / 8, st / (8 * n), t1 / 8 FROM order_sums
            UNION ALL
            SELECT uid, 'quantity', sq / (50 * n), q1 / 50, q0 / 50, sq / (50 * n), q1 / 50 FROM order_sums
            UNION ALL
            SELECT uid, 'returned', nr / n, nf / n, nr / n, na / n, nf / n FROM order_sums)"""),
    # events as an append-only attempt log; some attempts carry no usage
    "attempts": ((), """
        SELECT user_id AS uid, event_id AS attempt, ts AS started_at, value AS elapsed,
               CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'SUCCESS' END AS status,
               CASE WHEN event_type = 'error' THEN CAST(CASE event_id % 4 WHEN 0 THEN 429 WHEN 1 THEN 400 WHEN 2 THEN 503 END AS INTEGER) END AS http_status,
               CASE WHEN event_id % 9 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) * 3 END AS input_tokens,
               CASE WHEN event_id % 9 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS output_tokens,
               CASE WHEN event_id % 9 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) * 4 END AS total_tokens
        FROM events"""),
    # structured answers about each document, with faults of every kind
    "answers": ((), """
        SELECT doc_id AS uid, text AS report, target,
               CASE WHEN doc_id % 23 = 0 THEN 'OTHER' ELSE 'KNEE' END AS scope,
               CASE (doc_id + k) % 4 WHEN 0 THEN 'PRESENT' WHEN 1 THEN 'ABSENT' WHEN 2 THEN 'UNCERTAIN' ELSE 'NOT_MENTIONED' END AS report_status,
               CASE WHEN (doc_id + 2 * k) % 5 <> 0 THEN (n_chars * (k + 1) % 900 + 50) / 1000 END AS label,
               CASE (doc_id * 3 + k) % 4 WHEN 0 THEN 'DIRECT' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'CONFLICTING' ELSE 'INSUFFICIENT' END AS evidence_strength,
               CASE WHEN (doc_id + k) % 4 = 3 AND doc_id % 3 <> 0 THEN []::VARCHAR[]
                    WHEN (doc_id + k) % 7 = 0 THEN []::VARCHAR[]
                    WHEN (doc_id + k) % 11 = 0 THEN [substring(text, early, 12), '~' || substring(text, early, 9) || '~']
                    ELSE [substring(text, early, 15), substring(text, late, 8)] END AS evidence,
               CASE WHEN doc_id % 2 = 0 THEN 'stated' ELSE '' END AS score_reason,
               CASE WHEN doc_id % 3 = 0 THEN 'unclear wording' ELSE '' END AS uncertainty_reason
        FROM (SELECT *, 1 + k + (doc_id * 7919 + k * 104729) % greatest(length(text) - 20, 1) AS early, greatest(length(text) - 8, 1) AS late
              FROM documents, (VALUES ('quality', 0), ('toxic', 1)) AS targets(target, k))"""),
}

_SQL["quality"] = (("headers",), """
        SELECT h.series, h.header_errors, h.geometry_errors + CASE WHEN h.valid > 0 AND fov IS NULL THEN 1 ELSE 0 END AS geometry_errors,
               coalesce(unique_slices, 0) AS unique_slices, coverage_mm, slice_spacing_mm, pixel_spacing_mm, fov_mm,
               CAST(CASE WHEN coalesce(unique_slices, 0) >= 2 AND aligned AND h.header_errors = 0 AND h.geometry_errors = 0
                         AND fov IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS usable
        FROM (SELECT series, count(*) FILTER (unreadable) AS header_errors,
                     count(*) FILTER (NOT unreadable AND supp % 41 = 0) AS geometry_errors,
                     count(*) FILTER (NOT unreadable AND supp % 41 <> 0) AS valid
              FROM headers GROUP BY 1) h
        LEFT JOIN (
            SELECT series, count(DISTINCT pos) AS unique_slices, round(max(pos) - min(pos), 6) AS coverage_mm,
                   min(abs(nx * fx + ny * fy + nz * fz)) >= 0.999 AS aligned
            FROM placed GROUP BY 1) g ON h.series = g.series
        LEFT JOIN (
            SELECT series, round(median(gap), 6) AS slice_spacing_mm
            FROM (SELECT series, pos - lag(pos) OVER (PARTITION BY series ORDER BY pos) AS gap
                  FROM (SELECT DISTINCT series, pos FROM placed)) GROUP BY 1) s ON h.series = s.series
        LEFT JOIN (
            SELECT m.series, round(CAST(greatest(spacing[1], spacing[2]) AS DOUBLE), 6) AS pixel_spacing_mm,
                   1 AS fov, round(CAST(least(m.rows * spacing[1], m.columns * spacing[2]) AS DOUBLE), 3) AS fov_mm
            FROM (SELECT series, CAST(rows AS FLOAT) AS rows, CAST(columns AS FLOAT) AS columns FROM numbered WHERE rn - 1 = n // 2) m
            JOIN (SELECT series, arg_min(CAST(pixel_spacing AS FLOAT[]), abs(rn - 1 - n // 2) * 1000000 + rn) AS spacing
                  FROM numbered WHERE pixel_spacing IS NOT NULL GROUP BY 1) c ON m.series = c.series) f ON h.series = f.series""")

_SQL["oriented"] = (("headers",), """
        SELECT *, (orientation[2] * orientation[6] - orientation[3] * orientation[5]) AS nx,
               (orientation[3] * orientation[4] - orientation[1] * orientation[6]) AS ny,
               (orientation[1] * orientation[5] - orientation[2] * orientation[4]) AS nz
        FROM headers WHERE NOT unreadable AND supp % 41 <> 0""")
_SQL["placed"] = (("oriented",), """
        SELECT *, round_even(location[1] * fx + location[2] * fy + location[3] * fz, 4) AS pos
        FROM (SELECT *, first_value(nx) OVER w AS fx, first_value(ny) OVER w AS fy, first_value(nz) OVER w AS fz
              FROM oriented WINDOW w AS (PARTITION BY series ORDER BY line, part, supp))""")
_SQL["numbered"] = (("placed",), """
        SELECT *, row_number() OVER (PARTITION BY series ORDER BY pos, line, part, supp) AS rn,
               count(*) OVER (PARTITION BY series) AS n FROM placed""")
_SQL["quality"] = (("placed", "numbered"), _SQL["quality"][1])
_SQL["candidates"] = (("series", "quality"), """
        SELECT s.*, q.usable, q.unique_slices, q.coverage_mm, q.slice_spacing_mm, q.pixel_spacing_mm, q.fov_mm
        FROM series s LEFT JOIN quality q ON s.series = q.series""")
_SQL["thresholds"] = (("candidates",), """
        SELECT p.plane, coalesce(q, 0.0) AS threshold
        FROM (VALUES ('Sagittal'), ('Coronal'), ('Axial')) p(plane)
        LEFT JOIN (SELECT plane, round(quantile_cont(coverage_mm, 0.2), 4) AS q FROM candidates
                   WHERE usable = 1 AND coverage_mm > 0 AND study % 5 <> 0 GROUP BY 1) t ON p.plane = t.plane""")
_SQL["ordered_slices"] = (("slices",), """
        SELECT *, row_number() OVER (PARTITION BY series ORDER BY position, line, part, supp) - 1 AS idx,
               count(*) OVER (PARTITION BY series) AS n FROM slices""")
_SQL["windows"] = (("ordered_slices", "series"), """
        SELECT s.study, CASE plane WHEN 'Sagittal' THEN CASE WHEN fluid = 1 THEN 0 ELSE 1 END WHEN 'Coronal' THEN CASE WHEN fluid = 1 THEN 2 ELSE 3 END ELSE 4 END AS slot,
               o.series, o.idx, o.position FROM ordered_slices o JOIN series s ON o.series = s.series""")
for _source in ("old", "new", "gold"):
    _SQL[f"wide_{_source}"] = (("cells",), "SELECT uid, " + ", ".join(
        f"max({_source}) FILTER (target = '{t}') AS {t}" for t in TARGETS) + " FROM cells GROUP BY uid")
_SQL["members"] = (("cells",), """
        SELECT DISTINCT uid, CAST(CASE WHEN uid % 17 = 0 THEN -1 ELSE fold END AS INTEGER) AS fold,
               CASE WHEN uid % 17 = 0 THEN 'gold_holdout' ELSE 'weak' END AS split FROM cells""")


def sql(body: str, *names: str) -> str:
    """The body with the named models, and what they need, put in front as common table expressions."""
    needed: list[str] = []

    def visit(name: str) -> None:
        for parent in _SQL[name][0]:
            visit(parent)
        if name not in needed:
            needed.append(name)

    for name in names:
        visit(name)
    if not needed:
        return body
    parts = ",\n".join(f"{name} AS ({_SQL[name][1]})" for name in needed)
    return f"WITH {parts}\n{body.strip()}" if not body.strip().upper().startswith("WITH ") else f"WITH {parts},\n{body.strip()[5:]}"


def studies(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select(F.col("doc_id").alias("uid"), F.col("text").alias("report"), "lang", "source")
    gold = table(spark, d, "labels").select(
        F.col("doc_id").alias("uid"), F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))
    return documents.join(gold, "uid", "left")


def slices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("series"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"), (F.col("l_extendedprice") / 100).alias("position"),
        (F.col("l_quantity") * 2).alias("te"), (400 + (F.col("l_partkey") * 37) % 4000).cast("double").alias("tr"))


FILE_ORDER = ["line", "part", "supp"]


# Header directions by kind: orientation, and the axis along which positions lie.
_DIRECTIONS = [(0, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 1.0]), (1, [0.0, 1.0, 0.0, 0.0, 0.0, 1.0], [1.0, 0.0, 0.0]),
               (2, [0.0, 0.6, 0.8, 1.0, 0.0, 0.0], [0.0, 0.8, -0.6]), (3, [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 0.0])]


def headers(spark: SparkSession, d: str, found: DataFrame | None = None) -> DataFrame:
    """Headers of all slices, or of ``found``, whose partitions and order stay."""
    directions = spark.createDataFrame(_DIRECTIONS, "kind int, orientation array<double>, axis array<double>")
    turned = (F.col("series") + F.when(F.col("supp") % 43 == 0, 1).otherwise(0)) % 3
    rows = (slices(spark, d) if found is None else found).withColumn("kind", F.when(F.col("supp") % 41 == 0, 3).otherwise(turned).cast("int"))
    rows = rows.withColumn("lane", (F.col("series") % 3).cast("int"))
    rows = rows.join(F.broadcast(directions.select("kind", "orientation")), "kind")
    rows = rows.join(F.broadcast(directions.select(F.col("kind").alias("lane"), "axis")), "lane")
    return rows.select(
        "series", *FILE_ORDER, (F.col("part") % 97 == 0).alias("unreadable"), "te", "tr", "orientation",
        F.array(*[F.col("position") * F.col("axis")[i] for i in range(3)]).alias("location"),
        F.when(F.col("line") % 5 != 0, F.array(0.2 + (F.col("part") % 9) / 20, 0.2 + (F.col("supp") % 11) / 25)).alias("pixel_spacing"),
        (200 + F.col("part") % 300).cast("int").alias("rows"), (200 + F.col("supp") % 300).cast("int").alias("columns"))


def series(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("series")).agg(F.count(F.lit(1)).alias("num_slices"))
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    orders = table(spark, d, "orders").select(
        F.col("o_custkey").alias("study"), F.col("o_orderkey").alias("series"),
        F.when(priority.isin("1-URGENT", "2-HIGH"), "Sagittal").when(priority == "5-LOW", "Axial").otherwise("Coronal").alias("plane"),
        F.when(status == "F", 1).when(status == "O", 0).alias("fluid"),
        F.when(status == "F", 1).otherwise(0).alias("fat"), F.col("o_orderkey").alias("ordinal"), "o_orderdate")
    return orders.join(counts, "series", "left").withColumn("num_slices", F.coalesce("num_slices", F.lit(0)))


def _by_series(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Slices, the frame that counts them and the large series. Without such, slices lie in partitions of whole series
    and of ``SERIES_ROWS`` on average, however many there are, so that a task sorts them in memory."""
    check = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("series"))
    hot, rows = hot_groups(check, ["series"]), slices(spark, d)
    if hot is None:
        least = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        rows = rows.repartition(max(1, least, -(-check.count() // SERIES_ROWS)), "series")
    return rows, check, hot


def quality(spark: SparkSession, d: str) -> DataFrame:
    """Measured quality, rounded so that both engines rank equal series equally."""
    rows, check, hot = _by_series(spark, d)
    if hot is None:  # plain columns are shuffled and sorted, the arrays of a header are made after it
        rows = rows.sortWithinPartitions("series", *FILE_ORDER)
    found = catalog.series_quality(headers(spark, d, rows), "series", FILE_ORDER, F.col("unreadable"), check=check, hot=hot)
    digits = {"coverage_mm": 6, "slice_spacing_mm": 6, "pixel_spacing_mm": 6, "fov_mm": 3}
    return found.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in found.columns])


def candidates(spark: SparkSession, d: str) -> DataFrame:
    found = quality(spark, d).drop("header_errors", "geometry_errors")
    return series(spark, d).join(found, "series", "left")


def train_thresholds(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """Coverage thresholds fitted on training studies only."""
    fitted = catalog.coverage_thresholds(rows.where(F.col("study") % 5 != 0), 0.2, check=table(spark, d, "orders").select("o_orderkey"))
    return fitted.select("plane", F.round("threshold", 4).alias("threshold"))


def ordered_slices(spark: SparkSession, d: str) -> DataFrame:
    rows, check, hot = _by_series(spark, d)
    return catalog.order_slices(rows, ["series"], "position", FILE_ORDER, check=check, hot=hot)


def windows(spark: SparkSession, d: str) -> DataFrame:
    """Every ordered slice as a window of its study and slot."""
    lit = F.col("fluid") == 1
    slot = (F.when(F.col("plane") == "Sagittal", F.when(lit, 0).otherwise(1)).when(F.col("plane") == "Coronal", F.when(lit, 2).otherwise(3)).otherwise(4))
    owner = series(spark, d).select("series", "study", slot.alias("slot"))
    return ordered_slices(spark, d).join(owner, "series").select("study", "slot", "series", "idx", "position")


def label_sources(spark: SparkSession, d: str) -> DataFrame:
    """One row per order with every label source as ``source__target`` columns."""
    cents = lambda name: F.round(F.col(name) * 100).cast("int")
    discount, tax, quantity = cents("l_discount"), cents("l_tax"), F.col("l_quantity").cast("int")
    sums = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("uid")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(discount).alias("sd"), F.sum(tax).alias("st"), F.sum(quantity).alias("sq"),
        F.min(discount).alias("d0"), F.max(discount).alias("d1"), F.min(tax).alias("t0"), F.max(tax).alias("t1"),
        F.min(quantity).alias("q0"), F.max(quantity).alias("q1"),
        F.count_if(F.col("l_returnflag") == "R").alias("nr"), F.count_if(F.col("l_returnflag") == "A").alias("na"),
        F.count_if(F.col("l_linestatus") == "F").alias("nf"))
    c = F.col
    sources = {
        "discount": (c("sd") / (10 * c("n")), F.when(c("uid") % 7 != 0, c("d1") / 10), c("d0") / 10, c("sd") / (10 * c("n")), c("d1") / 10),
        "tax": (c("st") / (8 * c("n")), F.when(c("uid") % 11 != 0, c("t1") / 8), c("t0") / 8, c("st") / (8 * c("n")), c("t1") / 8),
        "quantity": (c("sq") / (50 * c("n")), c("q1") / 50, c("q0") / 50, c("sq") / (50 * c("n")), c("q1") / 50),
        "returned": (c("nr") / c("n"), c("nf") / c("n"), c("nr") / c("n"), c("na") / c("n"), c("nf") / c("n")),
    }
    columns = [c("uid"), (c("uid") % 5).cast("int").alias("fold")]
    for target, values in sources.items():
        columns += [value.alias(f"{name}__{target}") for name, value in zip(["old", "new", "p0", "p1", "p2"], values)]
        gold = F.when(values[2] + values[4] >= 1, 1.0).otherwise(0.0)
        columns.append(F.when(c("uid") % 17 == 0, gold).alias(f"gold__{target}"))
    return sums.select(*columns)


def wide(spark: SparkSession, d: str, source: str) -> DataFrame:
    """One row per order with the labels of one source as plain target columns."""
    rows = label_sources(spark, d)
    return rows.select("uid", *[F.col(f"{source}__{t}").alias(t) for t in TARGETS])


def wide_with_gold(spark: SparkSession, d: str) -> DataFrame:
    rows = label_sources(spark, d)
    return rows.select("uid", *[F.col(f"new__{t}").alias(t) for t in TARGETS], *[f"gold__{t}" for t in TARGETS])


def members(spark: SparkSession, d: str) -> DataFrame:
    """A given membership: gold orders apart, the others in five folds by key."""
    gold = F.col("uid") % 17 == 0
    orders = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("uid")).distinct()
    return orders.select("uid", F.when(gold, -1).otherwise(F.col("uid") % 5).cast("int").alias("fold"),
                         F.when(gold, "gold_holdout").otherwise("weak").alias("split"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    """One row per order and target with every label source."""
    return to_long(label_sources(spark, d), TARGETS, ["old", "new", "p0", "p1", "p2", "gold"], keep=["uid", "fold"])


def attempts(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.when(F.col("event_id") % 9 != 0, F.get_json_object("props", "$.k").cast("long"))
    code = F.when(F.col("event_id") % 4 == 0, 429).when(F.col("event_id") % 4 == 1, 400).when(F.col("event_id") % 4 == 2, 503)
    failed = F.col("event_type") == "error"
    started = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts").cast("timestamp_ntz")).cast("timestamp")
    return table(spark, d, "events").select(
        F.col("user_id").alias("uid"), F.col("event_id").alias("attempt"), started.alias("started_at"), F.col("value").alias("elapsed"),
        F.when(failed, "ERROR").otherwise("SUCCESS").alias("status"), F.when(failed, code).alias("http_status"),
        (tokens * 3).alias("input_tokens"), tokens.alias("output_tokens"), (tokens * 4).alias("total_tokens"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    """One row per document: its report and the answer as JSON text."""
    doc, text, size = F.col("doc_id"), F.col("text"), F.length("text").cast("long")

    def finding(k: int) -> Column:
        status = F.element_at(F.array(*map(F.lit, ["PRESENT", "ABSENT", "UNCERTAIN", "NOT_MENTIONED"])), ((doc + k) % 4 + 1).cast("int"))
        strength = F.element_at(F.array(*map(F.lit, ["DIRECT", "PARTIAL", "CONFLICTING", "INSUFFICIENT"])), ((doc * 3 + k) % 4 + 1).cast("int"))
        none = F.array().cast("array<string>")
        at = (1 + k + (doc * 7919 + k * 104_729) % F.greatest(size - 20, F.lit(1))).cast("int")  # quotes from all over the text
        evidence = (
            F.when(((doc + k) % 4 == 3) & (doc % 3 != 0), none).when((doc + k) % 7 == 0, none)
            .when((doc + k) % 11 == 0, F.array(F.substr(text, at, F.lit(12)), F.concat(F.lit("~"), F.substr(text, at, F.lit(9)), F.lit("~"))))
            .otherwise(F.array(F.substr(text, at, F.lit(15)), F.substr(text, F.greatest(size - 8, F.lit(1)).cast("int"), F.lit(8)))))
        return F.struct(
            status.alias("report_status"),
            F.when((doc + 2 * k) % 5 != 0, ((F.col("n_chars") * (k + 1)) % 900 + 50) / 1000).alias("label"),
            strength.alias("evidence_strength"), evidence.alias("evidence"),
            F.when(doc % 2 == 0, "stated").otherwise("").alias("score_reason"),
            F.when(doc % 3 == 0, "unclear wording").otherwise("").alias("uncertainty_reason"))

    answer = F.struct(doc.cast("string").alias("uid"), F.when(doc % 23 == 0, "OTHER").otherwise("KNEE").alias("report_scope"),
                      F.create_map(F.lit("quality"), finding(0), F.lit("toxic"), finding(1)).alias("labels"))
    return table(spark, d, "documents").select(doc.cast("string").alias("uid"), text.alias("report"),
                                               F.to_json(answer, {"ignoreNullFields": "false"}).alias("response"))

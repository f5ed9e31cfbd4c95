"""Near-duplicate reports, flagged for review and never merged."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceweave.functions.text import digest, normalise, report_group
from sliceweave.session import materialize

PRIME = 2_147_483_647
#: Shingles that are hashed at once.
CHUNK = 512


def coefficients(i: int) -> tuple[int, int]:
    """Factor and addend of the i-th reproducible hash ``(value * a + b) % PRIME`` of a number below 2^28."""
    return (i * 1_000_003 + 7_919) % PRIME, (i * 15_485_863 + 104_729) % PRIME


def text_minima(text: bytes, words: int, factors: np.ndarray, addends: np.ndarray) -> np.ndarray:
    """Smallest value of every hash over the word shingles of a normalised text; a shorter text is one shingle."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 32).tolist()
    starts, ends = [0, *(i + 1 for i in ends)], [*ends, len(text)]
    found = b"".join([md5(text[a:b]).digest() for a, b in zip(starts, ends[words - 1:] or ends[-1:])])
    numbers = (np.frombuffer(found, ">u4")[::4] >> 4).astype(np.uint64)  # the first seven hexadecimal digits
    prime, least = np.uint64(PRIME), np.full(len(factors), PRIME, np.uint64)
    values, upper = np.empty((2, len(factors), min(CHUNK, len(numbers))), np.uint64)
    for at in range(0, len(numbers), CHUNK):
        part = numbers[at:at + CHUNK]
        value, high = values[:, :len(part)], upper[:, :len(part)]
        np.multiply(factors[:, None], part, out=value)
        np.add(value, addends[:, None], out=value)
        for _ in range(2):  # the remainder by 2^31 - 1: its upper bits are added to the lower ones
            np.right_shift(value, np.uint64(31), out=high)
            np.bitwise_and(value, prime, out=value)
            np.add(value, high, out=value)
        np.copyto(value, np.uint64(0), where=value == prime)
        least = np.minimum(least, value.min(axis=1))
    return least


def minima(plain: Column, words: int, size: int) -> Column:
    """The ``size`` MinHash values of every normalised text, null for null."""
    pairs = np.array([coefficients(i) for i in range(size)], np.uint64)

    @F.arrow_udf("array<long>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else text_minima(t, words, pairs[:, 0], pairs[:, 1]).astype(np.int64) for t in texts.to_pylist()], pa.list_(pa.int64()))

    return run(plain.cast("binary"))


def _texts(rows: DataFrame, uid: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the group of their text, and one text of each group."""
    keyed = rows.select(F.col(f"`{uid}`").alias("_uid"), report_group(F.col(f"`{text}`")).alias("report_group"), F.col(f"`{text}`").alias("_text"))
    return keyed, keyed.groupBy("report_group").agg(F.min_by("_text", "_uid").alias("_text"))


def _shingles(texts: DataFrame, words: int) -> DataFrame:
    """The text's columns but ``_text``, and ``_all``: its word shingles, repeats included; a shorter text is one shingle."""
    split = F.split(normalise(F.col("_text")), " ")
    last = F.greatest(F.size("_w") - (words - 1), F.lit(1))
    shingles = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(F.col("_w"), i, words), " "))
    kept = [c for c in texts.columns if c != "_text"]
    return texts.select(*kept, split.alias("_w")).select(*kept, shingles.alias("_all"))


def _banded(signed: DataFrame, bands: int, per_band: int) -> DataFrame:
    """One row per text and MinHash band, from the minima of each text."""
    keys = F.array(*[F.concat_ws(":", F.lit(b), *[F.col("_minima")[b * per_band + i] for i in range(per_band)]) for b in range(bands)])
    return signed.where(F.col("_minima").isNotNull()).select("report_group", F.explode(keys).alias("band"))


def near_duplicates(rows: DataFrame, uid: str = "uid", text: str = "report", words: int = 3, bands: int = 10, per_band: int = 5) -> DataFrame:
    """Texts whose MinHash agrees with another text in at least one band.

    Each text gives its minima where it is read, so neither texts nor shingles are
    shuffled; minima of exact copies collapse to one, and are stored. Bands are counted, not paired, so a
    large family of near copies costs one row per text and band.
    """
    plain = rows.select(F.col(f"`{uid}`").alias("_uid"), normalise(F.col(f"`{text}`")).alias("_plain"))
    keyed = plain.select("_uid", digest(F.col("_plain")).alias("report_group"), "_plain")
    signed = keyed.where(F.col("_uid").isNotNull() & F.col("_plain").isNotNull()).select("report_group", minima(F.col("_plain"), words, bands * per_band).alias("_minima"))
    banded = _banded(materialize(signed.dropDuplicates(["report_group"])), bands, per_band)
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    flags = banded.join(shared, "band").groupBy("report_group").agg(F.count(F.lit(1)).alias("shared_bands"))
    return keyed.drop("_plain").join(flags, "report_group", "left").select(
        F.col("_uid").alias(uid), "report_group", F.coalesce("shared_bands", F.lit(0)).alias("shared_bands"),
        (F.coalesce("shared_bands", F.lit(0)) > 0).cast("int").alias("near_duplicate"))


def verified_near_duplicates(rows: DataFrame, uid: str = "uid", text: str = "report", words: int = 3, bands: int = 10, per_band: int = 5,
                             similarity: float = 0.8) -> DataFrame:
    """``near_duplicates`` with its evidence: the nearest partner found, their similarity, and the representative.

    In each band the smallest group stands for all; every other text there is compared with it by the exact Jaccard of
    their distinct shingles, so a text has at most ``bands`` comparisons and a large family is never paired. Both ends
    of a pair at or above ``similarity`` are flagged, so no flag is wrong; a near text is missed when no band brings
    both together under one representative. ``partner`` is the most similar of those (ties: the smallest),
    ``representative`` the smallest group among a text and its partners. Null texts have no group and are not flagged;
    exact copies share one group and are not near duplicates of each other. One row per input row, other columns are left out.
    """
    keyed, texts = _texts(rows, uid, text)
    texts = texts.where(F.col("report_group").isNotNull())
    shingles = materialize(_shingles(texts.withColumn("_minima", minima(normalise(F.col("_text")), words, bands * per_band)), words))
    sets = shingles.select("report_group", F.array_distinct("_all").alias("set"))
    banded = _banded(shingles, bands, per_band)
    firsts = banded.groupBy("band").agg(F.min("report_group").alias("a"), F.count(F.lit(1)).alias("texts")).where("texts > 1").drop("texts")
    pairs = banded.join(firsts, "band").select("a", F.col("report_group").alias("b")).where("a <> b").distinct()
    left, right = (sets.select(F.col("report_group").alias(side), F.col("set").alias(f"_{side}")) for side in ("a", "b"))
    common = F.size(F.array_intersect("_a", "_b"))
    small, large = F.least(F.size("_a"), F.size("_b")), F.greatest(F.size("_a"), F.size("_b"))
    likely = pairs.join(left, "a").join(right, "b").where(small / large >= similarity)  # sizes alone exclude the rest
    found = likely.select("a", "b", (common / (F.size("_a") + F.size("_b") - common)).alias("similarity")).where(F.col("similarity") >= similarity)
    ends = found.select(F.explode(F.array(F.struct(F.col("a").alias("of"), F.col("b").alias("to")), F.struct(F.col("b").alias("of"), F.col("a").alias("to")))).alias("e"), "similarity")
    best = ends.groupBy("e.of").agg(F.min(F.struct((-F.col("similarity")).alias("far"), F.col("e.to").alias("to"))).alias("near"), F.min("e.to").alias("_least"))
    return keyed.drop("_text").join(best, F.col("report_group") == F.col("of"), "left").select(
        F.col("_uid").alias(uid), "report_group", F.col("near.to").alias("partner"), (-F.col("near.far")).alias("similarity"),
        F.least("report_group", "_least").alias("representative"), F.col("of").isNotNull().cast("int").alias("near_duplicate"))

"""Report text keys and hashes that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(text: Column) -> Column:
    """Lower case with every run of Unicode white space as one blank.

    ``lower`` is used for case folding; the two differ for a few letters such as sharp s.
    """
    return F.trim(F.lower(F.regexp_replace(text, r"(?U)\s+", " ")))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def report_group(text: Column) -> Column:
    return digest(normalise(text))


def seeded(seed, *keys: Column) -> Column:
    """Reproducible random order: a digest of the seed and the row's own keys."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[key.cast("string") for key in keys]), 256)


def clock(seconds: Column) -> Column:
    """Whole seconds as HH:MM:SS."""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)

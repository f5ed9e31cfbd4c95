"""Column expressions over soft labels. NULL means missing and is never a negative."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sliceweave.schemas import EVIDENCE_WEIGHTS, LABEL_WORDS


def col(name: str) -> Column:
    """Column by its literal name; label names hold spaces and quotes."""
    return F.col("`" + name.replace("`", "``") + "`")


def finite(value: Column) -> Column:
    """The value, or NULL when it is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def lookup(words: Mapping[str, float], key: Column) -> Column:
    pairs = [F.lit(part) for item in words.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), key)


def parse_label(text: Column) -> Column:
    """Tri-state words or a number in [0, 1] as FLOAT; anything else is NULL."""
    clean = F.upper(F.regexp_replace(text.cast("string"), r"(?U)^\s+|\s+$", ""))
    number = F.when(clean.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(E[+-]?\d+)?$"), clean.try_cast("double"))
    value = F.coalesce(lookup(LABEL_WORDS, clean), number)
    return F.when(value.between(0.0, 1.0), value).cast("float")


def is_gold(values: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, [value.isNotNull() for value in values])


def is_partial_gold(values: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, [value.isNotNull() for value in values]) & ~is_gold(values)


def strict_gold(texts: Sequence[Column]) -> Column:
    """Array of 0/1 when every text is one of the accepted binary forms, else NULL."""
    accepted = F.array(*[F.trim(text.cast("string")) for text in texts])
    binary = F.forall(accepted, lambda text: F.coalesce(text.isin("0", "1", "0.0", "1.0"), F.lit(False)))
    return F.when(binary, F.transform(accepted, lambda text: text.cast("double").cast("int")))


def binary_flag(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(number.isin(0.0, 1.0), number.cast("int"))


def usable(value: Column) -> Column:
    """Label carries a direction: present, finite and not neutral."""
    return F.coalesce(finite(value) != 0.5, F.lit(False))


def positive(value: Column) -> Column:
    return F.coalesce(finite(value) > 0.5, F.lit(False))


def negative(value: Column) -> Column:
    return F.coalesce(finite(value) < 0.5, F.lit(False))


def excluded(value: Column) -> Column:
    return ~usable(value)


def confidence(value: Column) -> Column:
    return F.coalesce(2 * F.abs(finite(value) - 0.5), F.lit(0.0))


def label_mask(value: Column) -> Column:
    return finite(value).isNotNull().cast("int")


def band(value: Column) -> Column:
    """Polarity and confidence band, such as positive_high; NULL when excluded."""
    level = (F.when(confidence(value) < 0.4, "low").when(confidence(value) < 0.8, "medium").otherwise("high"))
    return F.when(positive(value), F.concat(F.lit("positive_"), level)).when(
        negative(value), F.concat(F.lit("negative_"), level))


def total(values: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, values)


def positives(values: Sequence[Column]) -> Column:
    return total([positive(value).cast("int") for value in values])


def case_mix(values: Sequence[Column]) -> Column:
    """Bucket by the number of positive labels: 0, 1, 2, 3-4 or 5+."""
    count = positives(values)
    return (F.when(count <= 2, count.cast("string")).when(count <= 4, "3-4").otherwise("5+"))


def row_quality(values: Sequence[Column]) -> Column:
    """Mean confidence times the usable share."""
    size = float(len(values))
    return (total([confidence(v) for v in values]) / size) * (total([usable(v).cast("double") for v in values]) / size)


def tri_state(value: Column) -> Column:
    """p, n or x for positive, negative and excluded."""
    return F.when(positive(value), "p").when(negative(value), "n").otherwise("x")


def word(value: Column) -> Column:
    """YES, NO or UNK."""
    return F.when(positive(value), "YES").when(negative(value), "NO").otherwise("UNK")


def blend(soft: Column, old: Column, share: float = 0.8) -> Column:
    return share * soft + (1 - share) * old


def unblend(blended: Column, old: Column, share: float = 0.8) -> Column:
    return (blended - (1 - share) * old) / share


def any_positive(values: Sequence[Column]) -> Column:
    """1 when a label of the group is positive, 0 when none is, NULL when all are excluded."""
    flags = [F.when(usable(value), positive(value).cast("int")) for value in values]
    return F.greatest(*flags) if len(flags) > 1 else flags[0]


def evidence_weight(strength: Column, label: Column) -> Column:
    return F.when(label.isNotNull(), lookup(EVIDENCE_WEIGHTS, strength)).otherwise(0.0)


def first_version_mapping(status: Column, soft: Column) -> Column:
    """Status of a finding to (target, weight, mask).

    Clear findings get fixed targets, insufficient evidence keeps its soft
    score at a low weight, and everything else is masked.
    """
    def row(target: Column, weight: Column, mask: Column) -> Column:
        return F.struct(target.cast("double").alias("target"), weight.cast("double").alias("weight"),
                        mask.cast("int").alias("mask"))
    absent = F.lit(None)
    return (
        F.when(status == "PRESENT", row(F.lit(0.95), F.lit(1.0), F.lit(1)))
        .when(status == "ABSENT", row(F.lit(0.05), F.lit(1.0), F.lit(1)))
        .when((status == "UNCERTAIN") & soft.isNotNull(), row(soft, F.lit(0.25), F.lit(1)))
        .when(status == "UNCERTAIN", row(absent, F.lit(0.25), F.lit(0)))
        .otherwise(row(absent, F.lit(0.0), F.lit(0))))

"""Multilabel folds by remaining need: the rarest evidence is dealt first, each carrier to the fold that lacks it most.

The order of the rounds depends on counts alone, and which fold takes the i-th carrier of a round depends on the needs
at its start alone. So carriers are numbered once, by digest inside their round; the driver holds one matrix of folds
and features and turns it into a few stretches of repeated turns; each round is one filtered aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceweave.functions.text import seeded
from sliceweave.operators.guards import ContractError
from sliceweave.operators.ordering import Sequence
from sliceweave.operators.splits import evidence, require_keys
from sliceweave.session import materialize, scratch_path


def turns(need: Seq[int], room: Seq[int], unit: int, total: int) -> list[tuple[int, list[int]]]:
    """Stretches (carriers before it, folds in turn) in which ``total`` carriers are dealt one by one.

    Each goes to the fold with the largest need that has room, of those to the one with most room, then the first; it
    lowers that need by ``unit``. All folds within one unit of the largest need take turns until one is full or another
    fold comes within a unit, so there are at most two stretches for each fold, however many carriers.
    """
    need, room, out, start = list(need), list(room), [], 0
    while start < total:
        waiting = [f for f in range(len(room)) if room[f]]
        floor = max(need[f] for f in waiting) - unit
        leaders = sorted((f for f in waiting if need[f] > floor), key=lambda f: (-need[f], -room[f], f))
        cycles = min([room[f] for f in leaders] + [(floor - need[f]) // unit + 1 for f in waiting if need[f] <= floor])
        out.append((start, leaders))
        for f in leaders:
            need[f] -= cycles * unit
            room[f] -= cycles
        start += cycles * len(leaders)
    return out


def _rounds(flags: DataFrame, names: Seq[str]) -> tuple[list[tuple[str | None, int]], dict]:
    """Features in the order they are dealt, the rarest among the studies still left first, with their carriers there;
    and the counts of all studies (``_n``) and of each feature.

    Studies without any feature come last, under None. Counted on distinct patterns, one small aggregate a round.
    """
    patterns = materialize(flags.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))) if names else flags.agg(F.count(F.lit(1)).alias("_n"))
    out: list[tuple[str | None, int]] = []
    left, totals = patterns, {}
    while True:
        sums = left.agg(F.sum("_n").alias("_n"), *[F.sum(F.when(F.col(name), F.col("_n"))).alias(name) for name in names]).first().asDict()
        totals = totals or {**sums, "_n": sums["_n"] or 0}
        carried = [name for name in names if sums[name]]
        if not carried:
            return ([*out, (None, sums["_n"])] if sums["_n"] else out), totals
        rarest = min(carried, key=lambda name: (sums[name], names.index(name)))
        out.append((rarest, sums[rarest]))
        left = left.where(~F.col(rarest))


def _fold(number: Column, stretches: Seq[tuple[int, list[int]]]) -> Column:
    """Fold of the carrier with this number (from 1) in a round."""
    fold = F.lit(None).cast("int")
    for start, leaders in stretches:
        turn = F.pmod(number - 1 - start, F.lit(len(leaders))).cast("int")
        fold = F.when(number > start, F.array(*[F.lit(f) for f in leaders])[turn]).otherwise(fold)
    return fold


def iterative_folds(rows: DataFrame, key: str, targets: Seq[str], folds: int, seed) -> DataFrame:
    """``key`` and ``fold`` (from 0) of every study, sizes within one.

    Features are positive, negative and missing evidence of each label. Round by round the feature with fewest carriers
    among the studies left is dealt (of equal ones the first) in the order of a digest. Null, repeated and too few keys
    are refused; the result does not depend on the order or the partitions of the rows. ``turns`` gives the rule.
    """
    features = evidence(targets)
    names = list(features)
    flags = materialize(rows.select(F.col(f"`{key}`").alias("_key"), *[flag.alias(name) for name, flag in features.items()]))
    require_keys(flags, "_key")
    rounds, totals = _rounds(flags, names)
    count = totals["_n"]
    if count < folds:
        raise ContractError(f"{folds} folds need as many studies")
    known = [(name, i) for i, (name, _) in enumerate(rounds) if name is not None]
    first = F.coalesce(*[F.when(F.col(name), F.lit(i)) for name, i in known], F.lit(len(known)))
    keyed = flags.withColumn("_round", first).withColumn("_h", seeded(seed, F.col("_key")))
    path = scratch_path(rows.sparkSession, "rounds")
    Sequence(keyed, ["_round"], [F.col("_h"), F.col("_key")]).row_number("_rn").df.drop("_h").write.partitionBy("_round").parquet(path)
    dealt = rows.sparkSession.read.parquet(path)

    room = [count // folds + (f < count % folds) for f in range(folds)]
    need = {name: [size * (totals[name] or 0) for size in room] for name in names}  # times ``count``, so that all stays whole
    plans = []
    for i, (name, carriers) in enumerate(rounds):
        stretches = turns(need[name] if name else [size * count for size in room], room, count, carriers)
        plans.append((i, [start for start, _ in stretches], [leaders for _, leaders in stretches]))
        mine = dealt.where(F.col("_round") == i).withColumn("fold", _fold(F.col("_rn"), stretches))
        for got in mine.groupBy("fold").agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(name)).alias(name) for name in names]).collect():
            room[got["fold"]] -= got["_n"]
            for other in names:
                need[other][got["fold"]] -= count * got[other]
    schema = "_round int, starts array<long>, leaders array<array<int>>"
    table = F.broadcast(rows.sparkSession.createDataFrame(plans, schema))  # one row a round
    at = F.size(F.filter("starts", lambda start: start < F.col("_rn"))) - 1
    placed = dealt.select("_key", "_round", "_rn").join(table, "_round").withColumn("_at", at)
    now = F.col("leaders")[F.col("_at")]
    turn = F.pmod(F.col("_rn") - 1 - F.col("starts")[F.col("_at")], F.size(now)).cast("int")
    return placed.select(F.col("_key").alias(key), now[turn].alias("fold"))

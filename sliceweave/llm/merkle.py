"""Merkle manifest of a dataset: a tree of digests per language, a tree over the languages, and a proof for every row.

Rows are ranked in their language; the octal digits of the rank are the places at which a row's path goes up. Inside a
block of 8 ** ``LEVELS`` neighbours the digit columns are grouped away one after the other, the lowest first, and the
structs of the children are nested in that of their parent. A block is dealt once, by its number, so all its digits are
grouped where it lies. At the end its nested struct is unfolded and every row takes its siblings out of the structs around
it, without a join. What remains of a block is one digest; blocks are rolled up in blocks of blocks by the same functions,
and each gets the path above it from there, one row per block. So no struct, row or group holds more than one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceweave.llm.common import stored
from sliceweave.llm.sharding import numbered

#: Bits of a digit (children of a node: 8), and digits that are grouped away inside a block.
BITS, LEVELS = 3, 3
#: One row in so many is tampered with in the check.
TAMPER = 3
_UPPER, _LOWER = (bytes(range(first, first + 26)).decode() for first in (ord("A"), ord("a")))


def joined_digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its length, ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return joined_digest(*[field(v) for v in values])


def _digest_of(children: Column) -> Column:
    return F.sha2(F.array_join(F.transform(children, lambda c: c["digest"]), "").cast("binary"), 256)


def _sides(children: Column, at: Column) -> Column:
    """Digests before and after place ``at`` among ``children``."""
    text = lambda part: F.array_join(F.transform(part, lambda c: c["digest"]), "")
    return F.struct(text(F.filter(children, lambda c: c["digit"] < at)).alias("before"), text(F.filter(children, lambda c: c["digit"] > at)).alias("after"))


def _goes_on(level: int, size: str = "size") -> Column:
    """Whether a group of ``size`` nodes has several nodes at ``level`` (0: the nodes themselves)."""
    return F.col(size) > (1 << (BITS * level))


def _no_path() -> Column:
    return F.array().cast("array<struct<before:string,after:string>>")


def roll_up(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One block of levels over ``nodes`` (``group``, ``rank`` from 0 without gaps, ``size`` of the group, ``digest``, ``own``).

    Returns ``group``, ``block`` (rank of the block), ``size`` (of the group, in blocks), ``nodes`` (its size before), the
    ``digest`` of the block and its nested ``children``. A group is rolled up while it has several nodes.
    """
    digits = [F.shiftright("rank", BITS * k).bitwiseAND((1 << BITS) - 1).cast("int").alias(f"d{k}") for k in range(levels)]
    dealt = nodes.select("group", F.shiftright("rank", BITS * levels).alias("block"), "size", *digits, "digest", "own").repartition("group", "block")
    child = F.struct(F.col("d0").alias("digit"), "digest", "own")
    for k in range(levels):
        above = [f"d{i}" for i in range(k + 1, levels)]
        dealt = dealt.groupBy("group", "block", "size", *above).agg(F.array_sort(F.collect_list(child)).alias("children"))
        # A group of one node has ended below: its only child goes up as it is.
        dealt = dealt.withColumn("digest", F.when(_goes_on(k), _digest_of(F.col("children"))).otherwise(F.col("children")[0]["digest"]))
        if above:
            child = F.struct(F.col(above[0]).alias("digit"), "digest", "children")
    blocks = F.expr(f"(size + {(1 << (BITS * levels)) - 1}L) div {1 << (BITS * levels)}L")
    return dealt.select("group", "block", blocks.alias("size"), F.col("size").alias("nodes"), "digest", "children")


def unfolded(blocks: DataFrame, above: Column | None = None, levels: int = LEVELS) -> Column:
    """Array of the nodes of a block, ``digest``, ``own`` and ``path``: their siblings, from below, and then those ``above``."""
    def unfold(children: Column, k: int, path: list[Column]) -> Column:
        def one(c: Column) -> Column:
            here = F.when(_goes_on(k, "nodes"), F.array(_sides(children, c["digit"]))).otherwise(_no_path())
            whole = [here, *path]
            return unfold(c["children"], k - 1, whole) if k else F.array(F.struct(c["digest"].alias("digest"), c["own"].alias("own"), F.concat(*whole).alias("path")))
        return F.flatten(F.transform(children, one))

    return unfold(F.col("children"), levels - 1, [] if above is None else [above])


def forest(nodes: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """The ``group`` and ``digest`` that remain of each group, and ``group``, ``digest``, ``own`` and ``path`` (from the
    node to what remains of its group) of all ``nodes`` (see ``roll_up``).

    Blocks are rolled up until every group is one block; then the paths come down again, one row per block.
    """
    rolled = []
    while True:
        rolled.append(stored(roll_up(nodes, levels), "blocks"))
        blocks = rolled[-1]
        if blocks.where("size > 1").isEmpty():
            break
        nodes = blocks.select("group", F.col("block").alias("rank"), "size", "digest", F.col("block").alias("own"))
    tops, met = blocks.select("group", "digest"), blocks.withColumn("_above", _no_path())
    for blocks in reversed(rolled[:-1]):  # numbers of blocks are unique on both sides, so this moves one row per block
        ends = met.select(F.col("group").alias("_group"), F.inline(unfolded(met, F.col("_above"), levels)))
        ends = ends.select("_group", F.col("own").alias("_block"), F.col("path").alias("_above"))
        met = blocks.join(ends, F.col("group").eqNullSafe(F.col("_group")) & (F.col("block") == F.col("_block"))).drop("_group", "_block")
    return tops, met.select("group", F.inline(unfolded(met, F.col("_above"), levels)))


def ranked(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rank`` from 0 and ``size`` for the rows of each value of ``group`` (null is one), by range partitions."""
    placed = stored(numbered(df, [F.col(group), *order], "_position"), "ranks")
    sizes = placed.groupBy(group).agg(F.min("_position").alias("_first"), F.count(F.lit(1)).alias("size")).withColumnRenamed(group, "_of")
    met = placed.join(sizes, F.col(group).eqNullSafe(F.col("_of")))
    return met.withColumn("rank", F.col("_position") - F.col("_first")).drop("_of", "_first", "_position")


def fold(path: Column, start: Column) -> Column:
    """Root that ``start`` gives with the siblings of ``path``."""
    return F.aggregate(path, start, lambda cur, p: joined_digest(p["before"], cur, p["after"]))


def siblings(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), "")


def manifest(df: DataFrame, id_column: str = "doc_id", group_column: str = "lang", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
             text_column: str = "text", levels: int = LEVELS) -> DataFrame:
    """``id_column``, ``leaf``, ``subroot``, ``root``, ``path`` (siblings from the leaf to the root) and ``tampered`` (the
    leaf of the row after tampering, null where it is not tampered with) of every row.

    A leaf is the digest of ``columns``, each ``-`` if null. Leaves ascend by id in their group (null id first, equal ids
    by their digest, so repeated rows are leaves of their own); groups ascend bytewise, null first. A group of one leaf is that
    leaf. A row whose id is null is not tampered with. An empty table has no rows and no root. Other columns do not count.
    """
    col = lambda name: F.col(f"`{name}`")
    low = F.translate(col(text_column), _UPPER, _LOWER)
    chosen = F.crc32(col(id_column).cast("string").cast("binary")) % TAMPER == 0
    other = leaf_digest([low if c == text_column else col(c) for c in columns])
    leaves = df.select(col(id_column).alias("id"), col(group_column).cast("string").alias("group"), leaf_digest([col(c) for c in columns]).alias("digest"),
                       F.when(chosen, other).alias("tampered"))
    leaves = stored(leaves, "leaves")  # else texts are digested twice, once for the borders of the ranges
    rows = ranked(leaves, "group", [F.col("id"), F.col("digest")]).select("group", "rank", "size", "digest", F.struct("id", "tampered").alias("own"))
    subroots, inside = forest(rows, levels)
    tops = ranked(subroots.withColumn("all", F.lit("")), "all", [F.col("group")])
    _, over = forest(tops.select(F.col("all").alias("group"), "rank", "size", "digest", F.struct("group").alias("own")), levels)
    over = over.select(F.col("own.group").alias("_group"), F.col("digest").alias("subroot"), F.col("path").alias("_path"))
    met = inside.join(over, F.col("group").eqNullSafe(F.col("_group")))
    return met.select(F.col("own.id").alias(id_column), F.col("digest").alias("leaf"), "subroot", fold(F.col("_path"), F.col("subroot")).alias("root"),
                      F.concat("path", "_path").alias("path"), F.col("own.tampered").alias("tampered"))


def verified(rows: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Digest of each row's proof, the root that it gives with the tampered or else the original leaf, and whether it is the root."""
    folded = fold(F.col("path"), F.coalesce("tampered", "leaf"))
    rows = rows.select(F.col(f"`{id_column}`"), "leaf", "subroot", "root", joined_digest(siblings(F.col("path"))).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))

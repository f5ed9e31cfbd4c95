"""SimHash near duplicates by a Gray-order hierarchical index.

Two fingerprints that differ in at most four of 64 bits agree on at least one of five bands. Each distinct fingerprint
is therefore placed five times, rotated so that one band leads, and sorted by the Gray rank of the rotated bits: rows
of a band value stand together, and neighbours differ in few bits. In each range of that order a hierarchy is built:
an upper node keeps the bits that all fingerprints below share (a masked pattern). Pairs of nodes are pruned as a whole
when their patterns already differ too much, taken as a whole when they can not differ too much, and skipped when all
below is connected already; only the rest is opened.

Ranges are cut by size, not by band value, so a crowded band value is shared by many tasks. Band values that a border
cuts are compared again, piece by piece, with the same pruning between pieces. Each task hands on at most one link per
fingerprint (to the smallest of its group); groups are then joined by contraction in Spark.

Four of 64 bits is a strict rule: texts that share four fifths of their shingles differ in about ten. Where a similarity
is asked for, texts meet under the first shingles of their sets in one order of all shingles, frequent ones last: so
many that two sets with the similarity share one of them. The exact Jaccard of the two sets decides. Texts that are
connected already are not compared again; of the rest, those whose sizes or parity bits exclude the similarity are not. Each set has as many parity bits as shingles or more.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sliceweave.llm.common import Shared, fresh, map_rows, release, stored
from sliceweave.llm.sharding import numbered
from sliceweave.operators.ordering import broadcast_checked

#: Words in a shingle, seed of its hash, most differing bits of a link.
WORDS, SEED, DISTANCE = 4, 42, 4
#: Width of the bands, one more than the distance.
BANDS = (13, 13, 13, 13, 12)
#: Children of a node, and fingerprints in a piece of a cut band value.
FAN, PIECE = 16, 20_000
#: 64-bit words of a wide fingerprint, and of the parity bits that each set of shingles has at least.
WIDE, PARITY = 16, 8
#: Texts of one meeting that are compared in one task.
MEETING = 4096
#: Texts, about, in which frequent shingles are counted, texts of them that make one frequent, and most that are kept.
#: They only set the order of shingles; any order finds all pairs.
COUNTED, OFTEN, FREQUENT = 20_000, 8, 200_000
#: Most texts whose digests are broadcast to fetch them; for more, texts and digests are shuffled.
WANTED = 200_000
#: Odd multipliers that spread the bits of a 64-bit key.
_MIX = tuple(np.uint64(n) for n in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of every word shingle of a whole text (A-Z in lower case), repeats included; none without words."""
    parts = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    n = min(words, len(parts))
    starts = (ends - sizes)[:len(parts) - n + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[n - 1:].tolist())], "<u8")


def longer_shingles(hashes: np.ndarray) -> np.ndarray:
    """Keys of the shingles one word longer, from the hashes of a text in order: two that overlap in all but one word
    make each. A single shingle, which may be the whole of a short text, stays as it is."""
    if len(hashes) < 2:
        return hashes
    mixed = hashes[:-1] * _MIX[0] + (hashes[1:] ^ hashes[1:] >> np.uint64(29)) * _MIX[1]
    mixed = (mixed ^ mixed >> np.uint64(32)) * _MIX[2]
    return mixed ^ mixed >> np.uint64(29)


def shingle_set(text: str | None, words: int, seed: int, hashes: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct keys of the shingles of ``words`` words; ``hashes`` are those of one word less, if at hand."""
    if words < 2:
        return np.unique(shingle_hashes(text, words, seed))
    return np.unique(longer_shingles(shingle_hashes(text, words - 1, seed) if hashes is None else hashes))


def majority(hashes: np.ndarray, rows: int = 1) -> np.ndarray:
    """Bits that are set in over half the hashes, as one 64-bit word for each of ``rows`` arrays of hashes."""
    n = hashes.shape[-1]
    if not n:
        return np.zeros(rows, np.uint64)
    # Each bit has a byte of its own in eight numbers, so up to 255 hashes add up without a carry.
    lanes = np.add.reduceat(_LANES[hashes.reshape(rows, n, 1).view(np.uint8)], np.arange(0, n, 255), axis=1)
    ones = lanes.view(np.uint8).reshape(rows, -1, 64).sum(axis=1, dtype=np.int64)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<u8")[:, 0]


def parity_words(distinct: np.ndarray, words: int = PARITY) -> np.ndarray:
    """Parity of the number of shingles in each of 64 * ``words`` parts, a power of two. Two sets differ in as many
    shingles at least as these bits differ."""
    odd = np.bincount((distinct >> np.uint64(20) & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def long_parity(distinct: np.ndarray) -> bytes | None:
    """At least one parity bit for each shingle, as a fixed number tells nothing of large sets; None if ``PARITY`` words do."""
    words = 1 << max(0, (len(distinct) - 1).bit_length() - 6)
    return parity_words(distinct, words).tobytes() if words > PARITY else None


def parity_distance(one: bytes, other: bytes) -> int:
    """Differing parity bits of two sets. The longer words are folded to the length of the shorter, as parities of parts
    add up to that of their union."""
    x, y = np.frombuffer(one, "<u8"), np.frombuffer(other, "<u8")
    width = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(side.reshape(-1, width), axis=0) for side in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def wide_distance(similarity: float) -> int:
    """Most differing bits of the wide fingerprint for a share ``similarity`` of common shingles, two deviations added."""
    bits = 64 * WIDE
    part = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * part + 2 * math.sqrt(bits * part * (1 - part)))


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of a whole text: the majority of each bit over all shingle hashes; 0 without words."""
    return int(majority(shingle_hashes(text, words, seed))[0])


def fingerprints(df: DataFrame, keep: list[str], text_column: str = "text", words: int = WORDS, seed: int = SEED, name: str = "fp") -> DataFrame:
    """Columns ``keep`` and the fingerprint, as a signed long, of every whole text; null and empty texts have 0."""
    def run(texts: pa.Array) -> dict:
        return {name: np.array([fingerprint(t, words, seed) for t in texts.to_pylist()], np.uint64).astype(np.int64)}

    return map_rows(df, [text_column], f"`{name}` long", run, keep)


def gray_rank(code: Column) -> Column:
    """Place of a 64-bit word in the Gray sequence, with the sign bit turned so that signed order is that of places."""
    for step in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, step))
    return code.bitwiseXOR(F.lit(-(2**63)))


def rotations(distinct: DataFrame) -> DataFrame:
    """Five rows of each fingerprint: ``bucket`` (band and its value), ``rank`` (Gray rank of the bits from that band
    on), ``code`` and ``node`` (the fingerprint)."""
    rows, at = [], 0
    for band, width in enumerate(BANDS):
        turned = F.shiftleft("fp", at).bitwiseOR(F.shiftrightunsigned("fp", 64 - at)) if at else F.col("fp")
        value = F.shiftrightunsigned(turned, 64 - width)
        rows.append(F.struct((value + (band << 32)).alias("bucket"), gray_rank(turned).alias("rank")))
        at += width
    return distinct.select("fp", F.explode(F.array(*rows)).alias("r")).select("r.bucket", "r.rank", F.col("fp").alias("code"), F.col("fp").alias("node"))


class Groups:
    """Connected groups of positions 0..n-1; each has its smallest position as label."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.version = 0

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up
            self.version += 1


def _bits(words: np.ndarray) -> np.ndarray:
    """Set bits of each row of 64-bit words."""
    counts = np.bitwise_count(words)
    return counts[:, 0] if words.shape[1] == 1 else counts.sum(axis=1, dtype=np.int32)


class GrayIndex:
    """Hierarchy over fingerprints, rows of 64-bit words, in Gray order."""

    def __init__(self, codes: np.ndarray, fan: int = FAN):
        self.fan, self.width = fan, 64 * codes.shape[1]
        self.ones, self.zeros = [codes], [~codes]  # level 0 are the fingerprints: every bit is shared
        while len(self.ones[-1]) > 1:
            cuts = np.arange(0, len(self.ones[-1]), fan)
            self.ones.append(np.bitwise_and.reduceat(self.ones[-1], cuts))
            self.zeros.append(np.bitwise_and.reduceat(self.zeros[-1], cuts))

    def connect(self, groups: Groups, offset: int, distance: int, chunk: int = 1024) -> None:
        """Join the groups of all pairs within ``distance``; position i of the index is ``offset + i`` there."""
        n, top = len(self.ones[0]), len(self.ones) - 1
        spans = [self.fan**level for level in range(top + 1)]
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        pure: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        child = np.arange(self.fan)
        while stack:
            level, a, b = stack.pop()
            if len(a) > chunk:
                stack.append((level, a[chunk:], b[chunk:]))
                a, b = a[:chunk], b[:chunk]
            if pure.get(level, (-1,))[0] != groups.version:
                cuts, part = np.arange(0, n, spans[level]), groups.label[offset:offset + n]
                pure[level] = (groups.version, np.minimum.reduceat(part, cuts), np.maximum.reduceat(part, cuts))
            _, low, high = pure[level]
            apart = ~((low[a] == high[b]) & (low[b] == high[a]))
            a, b = a[apart], b[apart]
            ones, zeros = self.ones[level], self.zeros[level]
            near = _bits((ones[a] & zeros[b]) | (zeros[a] & ones[b])) <= distance
            a, b = a[near], b[near]
            if level == 0:
                groups.join(offset + a, offset + b)
                continue
            whole = self.width - _bits((ones[a] & ones[b]) | (zeros[a] & zeros[b])) <= distance
            if whole.any():
                for side in (a[whole], b[whole]):  # the patterns leave too few bits open: all below are near each other
                    rows = side[:, None] * spans[level] + np.arange(spans[level])
                    first = np.broadcast_to((a[whole] * spans[level])[:, None], rows.shape)
                    groups.join(offset + first[rows < n], offset + rows[rows < n])
                a, b = a[~whole], b[~whole]
            if len(a):
                size = len(self.ones[level - 1])
                left = np.repeat(a[:, None] * self.fan + child, self.fan, axis=1).ravel()
                right = np.tile(b[:, None] * self.fan + child, (1, self.fan)).ravel()
                fits = (left < size) & (right < size) & ((left < right) | (left == right) & (level > 1))
                left, right = left[fits], right[fits]
                same = left == right
                # What lies nearest is opened first: it connects most, and what is connected is skipped later.
                stack.append((level - 1, left[~same], right[~same]))
                stack.append((level - 1, left[same], right[same]))


def connect_sorted(codes: np.ndarray, borders: np.ndarray, distance: int) -> np.ndarray:
    """Group labels of fingerprints in Gray order; only those between the same two borders are compared."""
    groups = Groups(len(codes))
    ends = np.append(borders[1:], len(codes))
    size = ends - borders
    # Small buckets are single nodes: all are compared at once, step by step along the order.
    value = np.repeat(np.arange(len(borders)), size)
    small = np.flatnonzero(np.repeat(size <= 2 * FAN, size))
    for step in range(1, 2 * FAN):
        a = small[small + step < len(codes)]
        a = a[value[a] == value[a + step]]
        if not len(a):
            break
        for at in range(0, len(a), 1 << 16):
            part = a[at:at + (1 << 16)]
            part = part[_bits(codes[part] ^ codes[part + step]) <= distance]
            groups.join(part, part + step)
    for i in np.flatnonzero(size > 2 * FAN):
        GrayIndex(codes[borders[i]:ends[i]]).connect(groups, int(borders[i]), distance)
    return groups.label


def _codes(column) -> np.ndarray:
    """Fingerprints as rows of 64-bit words, from longs or from binary values of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)[:, None]
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), -1)


def _linked(table: pa.Table, codes: np.ndarray, borders: np.ndarray, distance: int) -> tuple[pa.Array, pa.Array]:
    label = connect_sorted(codes, borders, distance)
    moved = np.flatnonzero(label != np.arange(len(label)))
    node = table["node"].combine_chunks()
    return node.take(pa.array(moved)), node.take(pa.array(label[moved]))


def links(placed: DataFrame, distance: int = DISTANCE, piece: int = PIECE) -> DataFrame:
    """Links ``a``-``b`` of nodes that connect, directly or through others, every two rows of ``placed`` that share a
    ``bucket`` and whose ``code`` differs in at most ``distance`` bits. At most one link per row and task."""
    kind = dict(placed.dtypes)["node"]
    narrow = pa.int64() if kind == "bigint" else pa.binary()

    def in_range(batches):
        """Links inside one range, and the buckets at its two ends."""
        release()
        batches = [b for b in batches if b.num_rows]
        if batches:
            table = pa.Table.from_batches(batches)
            bucket = table["bucket"].to_numpy()
            borders = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            a, b = _linked(table, _codes(table["code"]), borders, distance)
            none, part = pa.nulls(2, narrow), TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([-1] * len(a) + [part] * 2, pa.int32()), "bucket": pa.array([0] * len(a) + [bucket[0], bucket[-1]], pa.int64()),
                "a": pa.concat_arrays([a.cast(narrow), none]), "b": pa.concat_arrays([b.cast(narrow), none])})

    def in_pieces(table: pa.Table) -> pa.Table:
        """Links inside two pieces of one bucket."""
        table = table.take(pa.array(np.argsort(table["rank"].to_numpy(), kind="stable")))
        a, b = _linked(table, _codes(table["code"]), np.zeros(1, np.int64), distance)
        return pa.table({"a": a.cast(narrow), "b": b.cast(narrow)})

    parts = max(1, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = placed.repartitionByRange(parts, "bucket", "rank").sortWithinPartitions("bucket", "rank")
    found = stored(ranged.mapInArrow(in_range, f"part int, bucket long, a {kind}, b {kind}"), "ranges")
    cut = found.where("part >= 0").select("bucket", "part").distinct().groupBy("bucket").count().where("count > 1").select("bucket")
    again = numbered(placed.join(cut, "bucket", "left_semi"), [F.col("bucket"), F.col("rank"), F.col("node")], "position")
    again = stored(again.withColumn("piece", F.expr(f"position div {piece}L")), "cut")
    if dict(again.dtypes)["code"] == "bigint":  # upper nodes over the pieces: the bits that all of a piece share
        nodes = again.groupBy("bucket", "piece").agg(F.bit_and("code").alias("ones"), F.bit_and(F.bitwise_not("code")).alias("zeros"))
    else:
        nodes = again.select("bucket", "piece").distinct().select("*", F.lit(0).alias("ones"), F.lit(0).alias("zeros"))
    left = nodes.withColumnsRenamed({"piece": "p", "ones": "p1", "zeros": "p0"})
    right = nodes.withColumnsRenamed({"piece": "q", "ones": "q1", "zeros": "q0"})
    differ = F.bit_count(F.col("p1").bitwiseAND(F.col("q0")).bitwiseOR(F.col("p0").bitwiseAND(F.col("q1"))))
    pairs = left.join(right, "bucket").where((F.col("p") <= F.col("q")) & (differ <= distance)).select("bucket", "p", "q")
    sides = pairs.select("*", F.explode(F.array_distinct(F.array("p", "q"))).alias("piece"))
    compared = again.join(sides, ["bucket", "piece"]).select("bucket", "p", "q", "rank", "code", "node")
    across = compared.groupBy("bucket", "p", "q").applyInArrow(in_pieces, f"a {kind}, b {kind}")
    return found.where("part < 0").select("a", "b").union(across).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (one node of its connected group) of every node of ``edges`` (``a``, ``b``).

    Contraction: each node points to the smallest of itself and its neighbours, the ends of every edge move to what they
    point to, and edges inside a node go. At least every other node of a group goes in a round, and all rounds are
    written to the shared folder.
    """
    edges = stored(edges.where("a <> b"), "edges")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")).select(F.col("a").alias("node"), "to"), "step")
        ends = step.select(F.col("node").alias("_n"), F.col("to").alias("_to"))
        for side in ("a", "b"):
            edges = edges.join(ends, F.col(side) == F.col("_n")).withColumn(side, F.col("_to")).drop("_n", "_to")
        edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        steps.append(step)
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = steps[0].withColumnRenamed("to", "root")
    for step in steps[1:]:
        later = step.select(F.col("node").alias("_n"), "to")
        roots = roots.join(later, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("to", "root").alias("root"))
    return roots


def fingerprint_roots(rows: DataFrame) -> DataFrame:
    """``fp`` and ``root`` of every distinct fingerprint of ``rows``; a fingerprint without links is its own root."""
    distinct = stored(rows.select("fp").distinct(), "distinct")
    roots = components(links(rotations(distinct))).withColumnRenamed("node", "_fp")
    return distinct.join(roots, F.col("fp") == F.col("_fp"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``id_column``, ``fp`` and ``component_id`` (smallest id of the group) of every input row.

    Null, empty and blank texts have fingerprint 0 and are linked like others. Rows with a null id belong to their
    group but never name it; a group of such rows alone has a null name. Equal rows stay. An empty table gives an empty
    result. Other columns are left out.
    """
    rows = stored(fingerprints(df, [id_column], text_column, words, seed).withColumnRenamed(id_column, "id"), "fingerprints")
    roots = stored(fingerprint_roots(rows), "roots")
    firsts = rows.groupBy("fp").agg(F.min("id").alias("first"))
    named = roots.join(firsts, "fp")
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = roots.join(names, "root").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(of, F.col("fp") == F.col("_fp")).select(F.col("id").alias(id_column), "fp", "component_id")


def first_tokens(distinct: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles of a sorted set, frequent ones last: two sets with the similarity share one of theirs.

    Of n shingles such sets share at least ``similarity`` * n, so one that is shared is among the first of the others + 1.
    """
    n = len(distinct)
    if not n:
        return distinct
    take = n - math.ceil(similarity * n - 1e-9) + 1 if similarity > 0 else n
    tokens, counts = frequent
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, distinct), len(tokens) - 1)
        often = np.where(tokens[at] == distinct, counts[at], 0)
        if often.any():
            distinct = distinct[np.argsort(often, kind="stable")]
    return distinct[:take]


def frequent_shingles(df: DataFrame, text_column: str, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, in order, that are frequent among about ``COUNTED`` texts drawn by a digest, and in how many they are."""
    every = max(1, df.count() // COUNTED)
    drawn = df.where(F.pmod(F.xxhash64(F.col(f"`{text_column}`").cast("binary"), F.lit("frequent")), F.lit(every)) == 0)
    sets = map_rows(drawn, [text_column], "set array<long>", lambda texts: {"set": [shingle_set(t, words, seed).view(np.int64) for t in texts.to_pylist()]})
    counts = sets.select(F.explode("set").alias("token")).groupBy("token").count().where(F.col("count") >= OFTEN)
    found = counts.orderBy(F.col("count").desc(), "token").limit(FREQUENT).toArrow()
    tokens, often = found["token"].to_numpy().astype(np.int64).view(np.uint64), found["count"].to_numpy().astype(np.int64)
    order = np.argsort(tokens)
    return tokens[order], often[order]


def _meetings(rows: DataFrame) -> DataFrame:
    """``token`` and ``node``, once each, of the tokens that several nodes of ``rows`` have; some others stay in too."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    each = rows.select(F.explode("tokens").alias("token"), "node").repartitionByRange(parts, "token", "node").sortWithinPartitions("token", "node")

    def shared(batches):
        """A row is held back until the next is known. The first and the last stay, as their token may go on elsewhere."""
        held, begun = None, True  # the row held back, and whether it stays whatever follows
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch])
            token = table["token"].to_numpy()
            node = np.frombuffer(b"".join(table["node"].to_pylist()), "S16")  # of one length
            words = node.view("<u8").reshape(-1, 2)
            same = token[1:] == token[:-1]
            copy = np.concatenate([[False], same & (words[1:] == words[:-1]).all(axis=1)])
            stays = np.concatenate([[begun], same]) | np.concatenate([same, [False]])
            last = len(token) - 1
            begun = bool(stays[last])
            stays &= ~copy
            if copy[last]:  # the copy goes on as the row before it
                stays[np.flatnonzero(~copy)[-1]] = False
            stays[last] = False
            held = table.slice(last).combine_chunks().to_batches()[0]
            yield from table.filter(pa.array(stays)).combine_chunks().to_batches()
        if held is not None:
            yield held

    return stored(each.mapInArrow(shared, "token long, node binary"), "meetings")


def _possible(similarity: float):
    """Whether sets of sizes ``n`` and ``m`` with parity bits ``x`` and ``y`` can have the similarity."""
    differ = sum((F.bit_count(F.col("x")[i].bitwiseXOR(F.col("y")[i])) for i in range(1, PARITY)), F.bit_count(F.col("x")[0].bitwiseXOR(F.col("y")[0])))
    near = differ <= (F.col("n") + F.col("m")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    return (F.least("n", "m") >= F.greatest("n", "m") * similarity - 1e-6) & near


def _likely(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs`` (``a``, ``b``) whose ``parity`` in ``classes`` allows the similarity. Those of small sets stay."""
    for side, size, bits in (("a", "n", "x"), ("b", "m", "y")):
        pairs = pairs.join(classes.select(F.col("node").alias(side), F.col("n").alias(size), F.col("parity").alias(bits)), side)
    share = (1 - similarity) / (1 + similarity)

    def run(*columns: pa.Array) -> dict:
        rows = zip(*(c.to_pylist() for c in columns))
        return {"likely": [x is None or y is None or parity_distance(x, y) <= (n + m) * share + 1e-6 for n, m, x, y in rows]}

    return map_rows(pairs, ["n", "m", "x", "y"], "likely boolean", run, ["a", "b"]).where("likely").select("a", "b")


def _confirmed(pairs: DataFrame, classes: DataFrame, sets_of, similarity: float) -> DataFrame:
    """The rows of ``pairs`` (``a``, ``b``) whose sets have the similarity. Only the sets of pairs that parity allows are
    built and stored."""
    pairs = stored(_likely(pairs, classes, similarity), "pairs")
    sets = stored(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "sets")
    left, right = (sets.select(F.col("node").alias(side), F.col("set").alias(f"_{side}")) for side in ("a", "b"))
    both = F.size(F.array_intersect("_a", "_b"))
    whole = F.size("_a") + F.size("_b") - both
    return pairs.join(left, "a").join(right, "b").where(both + 1e-6 >= similarity * whole).select("a", "b")


def similar_roots(rows: DataFrame, sets_of, similarity: float) -> DataFrame:
    """``node`` and ``root`` of the linked classes of ``rows`` (``node``, ``fp``, ``n``, ``bits``, ``parity``, ``tokens``), one row
    per class: linked by four bits of ``fp``, or by the exact similarity of the sets. All sets with the similarity share a token.

    ``sets_of`` gives the sets (``node``, ``set``) of the nodes of a table. Each meeting first compares all with its
    smallest and its largest node, so that a crowd of copies is connected without pairs; then those that are still apart.
    """
    classes = stored(rows.groupBy("node").agg(*[F.min(c).alias(c) for c in ("fp", "n", "bits", "parity")]), "classes")
    by_fp = stored(classes.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")), "by_fp")
    again = by_fp.where("n > 1").select(F.col("fp").alias("_fp"), "first")
    edges = classes.join(again, F.col("fp") == F.col("_fp")).select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = links(rotations(by_fp.select("fp")))
    for side in ("a", "b"):
        ends = by_fp.select(F.col("fp").alias("_fp"), "first")
        near = near.join(ends, F.col(side) == F.col("_fp")).withColumn(side, F.col("first")).drop("_fp", "first")
    meetings = _meetings(rows.select("node", "tokens").dropDuplicates(["node"]))  # copies are one class, however many
    ends = meetings.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    star = meetings.join(ends, "token").select("node", F.explode(F.array("low", "high")).alias("b")).where("node <> b")
    star = star.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    for side, size, bits in (("a", "n", "x"), ("b", "m", "y")):
        star = star.join(classes.select(F.col("node").alias(side), F.col("n").alias(size), F.col("bits").alias(bits)), side)
    star = _confirmed(star.where(_possible(similarity)).select("a", "b"), classes, sets_of, similarity)
    edges = stored(edges.union(near.select("a", "b")).union(star), "links")
    roots = components(edges).withColumnRenamed("node", "_node")
    labelled = stored(classes.join(roots, F.col("node") == F.col("_node"), "left").select("node", F.coalesce("root", "node").alias("label"), "n", "bits"), "labels")
    mixed = meetings.join(labelled.select("node", "label"), "node").groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("count"))
    mixed = mixed.where("low <> high").select("token", F.expr(f"1 + count div {MEETING}L").alias("pieces"))
    apart = meetings.join(mixed, "token").join(labelled, "node").withColumn("piece", F.pmod(F.xxhash64("node"), "pieces"))
    left = apart.select("token", F.col("piece").alias("p"), F.explode(F.expr("sequence(piece, pieces - 1)")).alias("q"), F.col("node").alias("a"), F.col("label").alias("c"), "n", F.col("bits").alias("x"))
    right = apart.select("token", F.explode(F.expr("sequence(0L, piece)")).alias("p"), F.col("piece").alias("q"), F.col("node").alias("b"), F.col("label").alias("d"), F.col("n").alias("m"), F.col("bits").alias("y"))
    rest = left.join(right.hint("merge"), ["token", "p", "q"]).where((F.col("c") != F.col("d")) & ((F.col("p") < F.col("q")) | (F.col("a") < F.col("b"))) & _possible(similarity))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return components(edges.union(_confirmed(rest, classes, sets_of, similarity)))


def keep_one(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, seed: int = SEED,
             similarity: float = 0.8, similar_words: int = 5) -> DataFrame:
    """All columns of one row of each group: the one with the smallest id (null last; of equal ids the smallest digest).

    Rows are linked if their fingerprints (shingles of ``words`` words) differ in at most four bits, or if their sets of
    ``similar_words``-word shingles have at least ``similarity`` in common (exact Jaccard, all such pairs). Texts without
    words are copies of each other. Of rows equal in every column one stays.
    """
    digest = fresh(df, "digest")
    others = [F.col(f"`{c}`") for c in df.columns if c != text_column]
    marked = df.withColumn(digest, F.md5(F.to_json(F.struct(*others, F.md5(F.col(f"`{text_column}`").cast("binary")).alias(digest))).cast("binary")))

    shared = Shared(df.sparkSession, "frequent", frequent_shingles(df, text_column, similar_words, seed))

    def run(texts: pa.Array) -> dict:
        frequent = shared.get(lambda value: value)
        out: dict[str, list] = {"fp": [], "node": [], "n": [], "bits": [], "parity": [], "tokens": []}
        for text in texts.to_pylist():
            hashes = shingle_hashes(text, words, seed)
            distinct = shingle_set(text, similar_words, seed, hashes if similar_words == words + 1 else None)
            fp = majority(hashes)
            out["fp"].append(int(fp.view(np.int64)[0]))
            out["node"].append(hashlib.md5(fp.tobytes() + distinct.tobytes()).digest())
            out["n"].append(len(distinct))
            out["bits"].append(parity_words(distinct))
            out["parity"].append(long_parity(distinct))
            out["tokens"].append(first_tokens(distinct, frequent, similarity).view(np.int64))
        return out

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = stored(rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("digest").alias("_digest")), "wanted")
        wanted = broadcast_checked(wanted, WANTED)  # where few texts are wanted, the others are not shuffled
        own = marked.select(F.col(digest).alias("_own"), F.col(f"`{text_column}`").alias("_text"))  # no other column of the input meets ours
        texts = own.join(wanted, F.col("_own") == F.col("_digest")).dropDuplicates(["_digest"])
        return map_rows(texts, ["_text"], "set array<long>", lambda ts: {"set": [shingle_set(t, similar_words, seed).view(np.int64) for t in ts.to_pylist()]}, ["node"])

    rows = map_rows(marked, [text_column], "fp long, node binary, n int, bits array<long>, parity binary, tokens array<long>", run, [id_column, digest], shared)
    rows = stored(rows.toDF("id", "digest", "fp", "node", "n", "bits", "parity", "tokens"), "fingerprints")
    roots = similar_roots(rows, sets_of, similarity).withColumnRenamed("node", "_node")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    # One row per class first, so that copies are combined before they meet in their group.
    best = rows.groupBy("node").agg(F.min(order).alias("best")).join(roots, F.col("node") == F.col("_node"), "left")
    name = fresh(marked, "kept")
    kept = best.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best")).select(F.col("best.digest").alias(name))
    return (marked.join(kept, F.col(digest) == F.col(name), "left_semi").dropDuplicates([digest])
            .select(*[F.col(f"`{c}`") for c in df.columns]))

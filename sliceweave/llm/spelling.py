"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

An edit changes the counts of a word's letters little: their squared distance is at most two, and the lengths differ by at
most one. Words are cut into blocks of equal length, ordered by their counts of frequent letters, so that a block is narrow
in many of them. Spark pairs the blocks of equal and adjacent lengths whose ranges of counts allow a distance of two; a task
gets one pair. Inside, tiles of both blocks are screened by their ranges in the same way, and a product of the count
matrices gives all squared distances of two tiles at once. Pairs at most two apart are verified letter by letter.

Per pair of blocks a word hands on how many near words it found and the best of them; no pairs are handed on.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceweave.llm.common import map_rows, stored

#: Shortest word, fewest occurrences of one, times that a form must be as frequent, and one run in so many loses a letter.
LETTERS, OFTEN, TIMES, DROP = 7, 2, 10, 31
#: Words of a block, most bytes of its letters, words of a tile, and distinct words a task holds while it counts.
BLOCK, BLOCK_BYTES, TILE, HELD = 32_768, 4_000_000, 256, 200_000
#: Letters of words: a to z and U+00C0 to U+00FF, a column of the count matrix each.
ALPHABET = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
#: Frequent letters of European languages first; only the order of words depends on it.
FREQUENT = "etanirsodhlucgmf"
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_RUN = re.compile(f"[a-zÀ-ÿ]{{{LETTERS},}}")
_COLUMN = np.full(256, len(ALPHABET), np.int64)
_COLUMN[ALPHABET] = np.arange(len(ALPHABET))


def words_in(text: str | None, doc_id) -> Counter:
    """Words of a text with their occurrences. A run whose checksum with the id divides by ``DROP`` loses a letter."""
    found: Counter = Counter()
    if not text:
        return found
    low = text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
    base = zlib.crc32(("" if doc_id is None else str(doc_id)).encode() + b":")
    for run, n in Counter(_RUN.findall(low)).items():
        h = zlib.crc32(run.encode(), base)
        if h % DROP == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < LETTERS:
                continue
        found[run] += n
    return found


def count_words(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``word`` and ``n`` of the words that occur often enough in all texts."""
    sent = df.select(F.col(f"`{id_column}`").cast("string").alias("id"), F.col(f"`{text_column}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                for word, n in words_in(text, doc_id).items():
                    held[word] += n
                if len(held) > HELD:
                    yield flush()
        yield flush()

    return sent.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """Counts of each letter in words given as rows of Latin-1 bytes."""
    n, length = codes.shape
    flat = (np.arange(n)[:, None] * len(ALPHABET) + _COLUMN[codes]).ravel()
    kind = np.uint8 if length < 256 else np.int32
    return np.bincount(flat, minlength=n * len(ALPHABET)).reshape(n, -1).astype(kind)


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(-1, length)


def _sort_keys(words: list[str]) -> list[bytes]:
    order = [ALPHABET.index(ord(c)) for c in FREQUENT]
    keys: list[bytes] = [b""] * len(words)
    by_length: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        by_length.setdefault(len(word), []).append(i)
    for length, places in by_length.items():
        step = max(1, BLOCK_BYTES // length)
        for at in range(0, len(places), step):
            part = places[at:at + step]
            counts = np.minimum(letter_counts(_codes([words[i] for i in part], length))[:, order], 255).astype(np.uint8)
            for i, row in zip(part, counts):
                keys[i] = row.tobytes()
    return keys


def make_blocks(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of words of one length: ``block`` (its number), ``length``, ``codes`` and ``counts`` of its words, and the least
    and greatest count of each letter, ``low`` and ``high``."""
    parts = max(1, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = map_rows(words, ["word"], "key binary", lambda ws: {"key": _sort_keys(ws.to_pylist())}, ["word", "n"]).withColumn("length", F.char_length("word"))
    ranged = keyed.repartitionByRange(parts, "length", "key", "word").sortWithinPartitions("length", "key", "word").select("length", "word", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = TaskContext.get().partitionId() << 32, 0
        length, held, often = 0, [], []

        def flush() -> pa.RecordBatch:
            nonlocal number
            codes = _codes(held, length)
            counts = letter_counts(codes)
            number += 1
            out = {"block": [first + number], "length": [length], "codes": [codes.tobytes()], "counts": [np.array(often, np.int64).tobytes()],
                   "low": [counts.min(axis=0).tolist()], "high": [counts.max(axis=0).tolist()]}
            held.clear(), often.clear()
            return pa.RecordBatch.from_pydict(out, schema=pa.schema([("block", pa.int64()), ("length", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary()),
                                                                     ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32()))]))

        for batch in batches:
            for size, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (size != length or len(held) >= block or len(held) * length >= BLOCK_BYTES):
                    yield flush()
                length = size
                held.append(word)
                often.append(n)
        if held:
            yield flush()

    return ranged.mapInArrow(run, "block long, length int, codes binary, counts binary, low array<int>, high array<int>")


def _squared_gap() -> Column:
    """Least squared distance of counts in ranges ``low``-``high`` and ``low2``-``high2``."""
    gaps = F.zip_with(F.arrays_zip("low", "high"), F.arrays_zip("low2", "high2"), lambda a, b: F.greatest(a["low"] - b["low2"] * 0 - b["high2"], b["low2"] - a["high"], F.lit(0)))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, g: total + g.cast("long") * g)


def block_pairs(blocks: DataFrame) -> DataFrame:
    """``a`` and ``b``: blocks of equal or adjacent lengths (``b`` the longer) that can hold words at a distance of two."""
    ranges = blocks.select("block", "length", "low", "high")
    left = ranges.select(F.col("block").alias("a"), "length", "low", "high", F.explode(F.array("length", F.col("length") + 1)).alias("other"))
    right = ranges.select(F.col("block").alias("b"), F.col("length").alias("length2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    met = left.join(right, (F.col("other") == F.col("length2")) & ((F.col("length2") > F.col("length")) | (F.col("a") <= F.col("b"))) & (_squared_gap() <= 2))
    return met.select("a", "b")


class Side:
    """The words of one block: letters, counts and their ranges in each tile, and the rank of a word as a form."""

    def __init__(self, codes: bytes, counts: bytes, length: int):
        self.codes = np.frombuffer(codes, np.uint8).reshape(-1, length)
        self.often = np.frombuffer(counts, np.int64)
        self.letters = letter_counts(self.codes)
        cuts = np.arange(0, len(self.codes), TILE)
        self.low = np.minimum.reduceat(self.letters, cuts, axis=0).astype(np.int32)
        self.high = np.maximum.reduceat(self.letters, cuts, axis=0).astype(np.int32)
        order = np.lexsort((self.codes.view(f"S{length}")[:, 0], -self.often))  # letters are never zero bytes
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.order = order
        self.near = np.zeros(len(order), np.int64)
        self.kind = np.float32 if length < 1000 else np.float64
        self.half = (self.letters.astype(np.float64) ** 2).sum(axis=1) / 2

    def words(self, places: np.ndarray) -> list[str]:
        return [row.tobytes().decode("latin-1") for row in self.codes[places]]


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by one replaced letter (equal lengths) or one that ``b`` has more."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    start, end = a != b[:, :-1], a != b[:, 1:]
    length = a.shape[1]
    first = np.where(start.any(axis=1), start.argmax(axis=1), length)  # letters that agree from the left
    last = np.where(end.any(axis=1), length - end[:, ::-1].argmax(axis=1), 0)  # from here on they agree with those one further
    return first >= last


def near_in(a: Side, b: Side | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of near words, tile by tile; with ``b`` None, those inside ``a``."""
    other = a if b is None else b
    kind = np.float64 if np.float64 in (a.kind, other.kind) else np.float32
    tiles = len(other.low)
    right = np.concatenate([other.letters.astype(kind), np.ones((len(other.half), 1), kind), -other.half[:, None].astype(kind)], axis=1)
    for t in range(len(a.low)):
        gap = np.maximum(np.maximum(a.low[t] - other.high, other.low - a.high[t]), 0)
        fits = np.flatnonzero((gap.astype(np.int64) ** 2).sum(axis=1) <= 2)
        if b is None:
            fits = fits[fits >= t]
        here = slice(t * TILE, (t + 1) * TILE)
        left = np.concatenate([a.letters[here].astype(kind), -a.half[here, None].astype(kind), np.ones((len(a.half[here]), 1), kind)], axis=1)
        for u in fits:
            # The product less half of both squared norms is minus half of the squared distance.
            near = left @ right[u * TILE:(u + 1) * TILE].T >= -1.25
            x, y = np.divmod(np.flatnonzero(near), near.shape[1])  # several times faster than over two axes
            x, y = x + t * TILE, y + u * TILE
            if b is None and u == t:
                x, y = x[x < y], y[x < y]
            if len(x):
                step = max(1, BLOCK_BYTES // a.codes.shape[1])
                for at in range(0, len(x), step):
                    p, q = x[at:at + step], y[at:at + step]
                    right_ones = _one_edit(a.codes[p], other.codes[q])
                    yield p[right_ones], q[right_ones]
        assert tiles


def compare(a: Side, b: Side | None) -> list[tuple[str, int, str, int]]:
    """``word``, near words found, the best form among them and its occurrences, for each word of either side with any."""
    sides = [a] if b is None else [a, b]
    best = {id(s): np.full(len(s.often), np.iinfo(np.int64).max) for s in sides}
    other = a if b is None else b
    a.near[:] = 0
    other.near[:] = 0
    for p, q in near_in(a, b):
        np.add.at(a.near, p, 1)
        np.add.at(other.near, q, 1)
        np.minimum.at(best[id(a)], p, other.rank[q])
        np.minimum.at(best[id(other)], q, a.rank[p])
    out = []
    for own, far in {id(a): (a, other), id(other): (other, a)}.values():
        places = np.flatnonzero(own.near)
        forms = far.order[best[id(own)][places]]
        out += zip(own.words(places), own.near[places].tolist(), far.words(forms), far.often[forms].tolist())
    return out


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word``, ``n_near`` and ``best`` (occurrences negated, form) of the words that have near words."""
    blocks = stored(make_blocks(words, block), "blocks")
    pairs = stored(block_pairs(blocks), "pairs")
    side = lambda at: blocks.select(F.col("block").alias(at), F.struct("length", "codes", "counts").alias(f"_{at}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "_a", "_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y, p, q = (batch.column(k)[i].as_py() for k in range(4))
                left = Side(p["codes"], p["counts"], p["length"])
                rows = compare(left, None if x == y else Side(q["codes"], q["counts"], q["length"]))
                for at in range(0, len(rows), 8192):
                    word, near, form, n = map(list, zip(*rows[at:at + 8192]))
                    yield pa.RecordBatch.from_pydict({"word": word, "near": pa.array(near, pa.int64()), "form": form, "form_n": pa.array(n, pa.int64())})

    found = met.mapInArrow(run, "word string, near long, form string, form_n long")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """``word`` and ``root`` of every row of ``links`` (``word``, ``form``), whose forms lead to no circle: each word jumps to
    the root of its root until none moves, so a chain takes the logarithm of its length in rounds."""
    now = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        step = now.join(ahead, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved"))
        step = stored(step, "roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", block: int = BLOCK) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every word of all texts.

    A word's form is the near word with the most occurrences (ties: the smallest in code-point order) if it has at least
    ``TIMES`` as many; then ``form_n`` is its number, else both are null. ``root`` is where forms lead to, the word itself
    without one. Null and empty texts have no words; a null id counts as the empty text in the checksum, and repeated rows
    count each. Without words the result is empty. Other columns are left out.
    """
    words = stored(count_words(df, id_column, text_column), "words")
    found = near_words(words, block).withColumnRenamed("word", "_word")
    rows = words.join(found, F.col("word") == F.col("_word"), "left")
    far = -F.col("best.less") >= TIMES * F.col("n")
    rows = stored(rows.select("word", F.when(far, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                              F.when(far, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(rows.where("form is not null")).withColumnRenamed("word", "_word")
    return rows.join(ends, F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

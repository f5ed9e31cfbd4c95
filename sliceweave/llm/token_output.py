"""Training-order materialisation of token ids in fixed-stride binary shards.

The tokens of all documents, each closed by an end token, make one stream that is cut into sequences of equal length.
A keyed Feistel permutation with cycle walking gives every sequence its slot in the training order, without a shuffle of
its own and without a table: any slot or sequence number is computed from the other. Ranges of slots are gathered and
written as files of fixed stride, so slot s stands at byte ``(s mod per_shard) * stride`` of shard ``s div per_shard``:
training reads files from front to back, and may resume at any slot.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sliceweave.llm.bpe import BpeEncoder, ByteBpe
from sliceweave.llm.common import Shared
from sliceweave.session import scratch_path

#: Tokens in a sequence, and sequences in a shard (16 MB of 16-bit ids).
LENGTH, PER_SHARD = 2048, 4096
#: Tokens in a block of the stored stream, blocks cut into sequences at once, and the level at which ids are compressed.
BLOCK, TOGETHER, LEVEL = 1 << 20, 8, 3
#: Texts encoded at once.
TEXTS = 128
#: Rounds of the permutation.
ROUNDS = 6
_MASK = (1 << 64) - 1


class Feistel:
    """Keyed permutation of 0..n-1 and its inverse, on arrays."""

    def __init__(self, n: int, key: int, rounds: int = ROUNDS):
        self.n, self.half = n, max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
        state = key & _MASK
        self.keys = []
        for _ in range(rounds):  # one key per round by a 64-bit mixer
            state = (state + 0x9E3779B97F4A7C15) & _MASK
            z = ((state ^ state >> 30) * 0xBF58476D1CE4E5B9) & _MASK
            self.keys.append(np.uint64(((z ^ z >> 27) * 0x94D049BB133111EB) & _MASK))

    def _round(self, half: np.ndarray, key: np.uint64) -> np.ndarray:
        z = (half + key) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
        return (z ^ z >> np.uint64(32)) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, keys: list) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & np.uint64((1 << self.half) - 1)
        for key in keys:
            left, right = right, left ^ self._round(right, key)
        return (right << np.uint64(self.half)) | left  # halves swapped, so that the same steps undo it

    def _walk(self, x: np.ndarray, keys: list) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), keys)
        while (outside := np.flatnonzero(out >= self.n)).size:  # walk the cycle until it is back inside
            out[outside] = self._once(out[outside], keys)
        return out.astype(np.int64)

    def slot(self, sequence: np.ndarray) -> np.ndarray:
        return self._walk(sequence, self.keys)

    def sequence(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1])


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that driver and executors share."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _write(folder: str, name: str, content: bytes) -> None:
    """A whole file or none: written beside and renamed, so a task that runs twice does no harm."""
    system, path = _place(folder)
    beside = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(beside) as out:
        out.write(content)
    system.move(beside, f"{path}/{name}")


def encoded(df: DataFrame, tokenizer: str, text_column: str = "text") -> DataFrame:
    """Token stream in the order of the table's partitions, in blocks: ``part``, ``start`` (in the part), ``n``, ``ids``.

    Ids are 16-bit, compressed; each text is closed by the first special token of the vocabulary.
    """
    bpe = ByteBpe.load(tokenizer)
    if len(bpe.tokens) > 1 << 16:
        raise ValueError("ids of this vocabulary do not fit in 16 bits")
    end = np.array([min(bpe.special.values())], "<u4").tobytes()
    shared = Shared(df.sparkSession, "bpe", bpe)

    def run(batches):
        encoder, part, start, pending = shared.get(BpeEncoder), TaskContext.get().partitionId(), 0, np.zeros(0, "<u2")

        def blocks(tokens, size):
            nonlocal start
            for at in range(0, len(tokens), size):
                block = tokens[at:at + size]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part], pa.int32()), "start": pa.array([start], pa.int64()), "n": pa.array([len(block)], pa.int64()),
                    "ids": pa.array([zstandard.compress(block.tobytes(), LEVEL)], pa.binary())})
                start += len(block)

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                texts = batch.column(0).slice(at, TEXTS).to_pylist()
                new = np.frombuffer(b"".join(encoder.encode(text) + end for text in texts), "<u4").astype("<u2")
                pending = np.concatenate([pending, new])
                whole = len(pending) // BLOCK * BLOCK
                yield from blocks(pending[:whole], BLOCK)
                pending = pending[whole:].copy()
        yield from blocks(pending, BLOCK)

    return df.select(F.col(f"`{text_column}`").alias("text")).mapInArrow(run, "part int, start long, n long, ids binary")


def materialise(df: DataFrame, tokenizer: str, key: int, folder: str | None = None, text_column: str = "text", length: int = LENGTH,
                per_shard: int = PER_SHARD) -> tuple[DataFrame, str]:
    """Write all sequences as shards into ``folder`` (default: a new one in the shared folder); returns one row per
    sequence and the folder: ``slot``, ``sequence``, ``shard``, ``offset`` (byte in the shard's file), ``n_tokens``
    (without padding) and ``sha256`` of the record.

    Every text of the table is in the stream once, equal rows as often as they occur; a null or empty text is its end
    token alone. The last sequence is filled with end tokens. An empty table writes a manifest and no shard. Columns
    other than the text are not looked at. The encoded stream is written first, in the order of the table's partitions;
    all later steps read that copy, so a lost executor changes nothing. Running the same key over the same copy gives
    the same bytes.
    """
    spark = df.sparkSession
    folder = folder or scratch_path(spark, "sequences")
    system, path = _place(folder)
    system.create_dir(path, recursive=True)
    stream_path, end = scratch_path(spark, "stream"), min(ByteBpe.load(tokenizer).special.values())
    stream = encoded(df, tokenizer, text_column)
    stream.write.option("compression", "none").parquet(stream_path)  # the ids are compressed already
    stream = spark.read.schema(stream.schema).parquet(stream_path)
    # One row per partition of the table: where its tokens begin in the whole stream.
    bases = stream.groupBy("part").agg(F.sum("n").alias("tokens"))
    bases = bases.select("part", "tokens", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    total = bases.agg(F.sum("tokens")).first()[0] or 0
    sequences = -(-total // length)
    order, stride = Feistel(sequences, key), 2 * length

    def cut(batches):
        """The pieces of sequences that each few blocks hold, together for each shard."""
        for batch in batches:
            starts, blocks = batch.column("at").to_pylist(), batch.column("ids")
            for first in range(0, len(starts), TOGETHER):
                numbers, places, pieces = [], [], []
                for i in range(first, min(len(starts), first + TOGETHER)):
                    at, tokens = starts[i], np.frombuffer(zstandard.decompress(blocks[i].as_py()), "<u2")
                    edges = [0, *range(length - at % length, len(tokens), length), len(tokens)]
                    for a, b in zip(edges, edges[1:]):
                        numbers.append((at + a) // length)
                        places.append((at + a) % length)
                        pieces.append(tokens[a:b])
                slots = order.slot(np.array(numbers, np.int64))
                shard = slots // per_shard
                for of in np.unique(shard).tolist():
                    own = np.flatnonzero(shard == of).tolist()
                    yield pa.RecordBatch.from_pydict({
                        "shard": pa.array([of], pa.int64()), "slots": pa.array([slots[own].tolist()], pa.list_(pa.int64())),
                        "numbers": pa.array([[numbers[i] for i in own]], pa.list_(pa.int64())), "places": pa.array([[places[i] for i in own]], pa.list_(pa.int32())),
                        "sizes": pa.array([[len(pieces[i]) for i in own]], pa.list_(pa.int32())),
                        "ids": pa.array([zstandard.compress(np.concatenate([pieces[i] for i in own]).tobytes(), LEVEL)], pa.binary())})

    pieces = (stream.join(F.broadcast(bases.select(F.col("part").alias("_part"), "base")), F.col("part") == F.col("_part"))
              .select((F.col("base") + F.col("start")).alias("at"), "ids")
              .mapInArrow(cut, "shard long, slots array<long>, numbers array<long>, places array<int>, sizes array<int>, ids binary"))

    def write_shard(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        first = shard * per_shard
        rows = np.full((min(per_shard, sequences - first), length), end, "<u2")
        number = np.zeros(len(rows), np.int64)
        for slots, numbers, places, sizes, ids in zip(*(table[c].to_pylist() for c in ("slots", "numbers", "places", "sizes", "ids"))):
            tokens, at = np.frombuffer(zstandard.decompress(ids), "<u2"), 0
            for slot, place, size in zip(slots, places, sizes):
                rows[slot - first, place:place + size] = tokens[at:at + size]
                at += size
            number[np.array(slots) - first] = numbers
        _write(folder, f"shard-{shard:08d}.bin", rows.tobytes())
        return pa.table({
            "slot": first + np.arange(len(rows)), "sequence": number, "shard": np.full(len(rows), shard), "offset": np.arange(len(rows)) * stride,
            "n_tokens": np.minimum(length, total - number * length), "sha256": [hashlib.sha256(r.tobytes()).hexdigest() for r in rows]})

    schema = "slot long, sequence long, shard long, offset long, n_tokens long, sha256 string"
    index_path = scratch_path(spark, "index")
    if sequences:
        pieces.groupBy("shard").applyInArrow(write_shard, schema).write.parquet(index_path)
    else:
        spark.createDataFrame([], StructType.fromDDL(schema)).write.parquet(index_path)
    _write(folder, "manifest.json", json.dumps({
        "sequences": sequences, "tokens": int(total), "length": length, "per_shard": per_shard, "stride": stride, "end": end, "key": key,
        "rounds": ROUNDS, "dtype": "uint16, little-endian"}).encode())
    return spark.read.schema(StructType.fromDDL(schema)).parquet(index_path), folder


def read_slots(folder: str, start: int = 0, count: int | None = None):
    """Sequences in training order from slot ``start`` on, read file by file from front to back."""
    system, path = _place(folder)
    with system.open_input_stream(f"{path}/manifest.json") as file:
        facts = json.loads(file.read())
    stop = facts["sequences"] if count is None else min(facts["sequences"], start + count)
    while start < stop:
        shard, first = divmod(start, facts["per_shard"])
        until = min(stop, (shard + 1) * facts["per_shard"])
        with system.open_input_file(f"{path}/shard-{shard:08d}.bin") as file:
            file.seek(first * facts["stride"])
            for _ in range(until - start):
                yield np.frombuffer(file.read(facts["stride"]), "<u2")
        start = until


def restore(spark: SparkSession, index: DataFrame, folder: str) -> DataFrame:
    """``sequence`` and ``ids`` (16-bit, without padding) of every written sequence, read back by its place in the shards."""
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("offset", "sequence", "n_tokens"))))
        system, path = _place(folder)
        with system.open_input_file(f"{path}/shard-{table['shard'][0].as_py():08d}.bin") as file:
            data = file.read()
        return pa.table({"sequence": pa.array([s for _, s, _ in rows], pa.int64()), "ids": pa.array([data[o:o + 2 * n] for o, _, n in rows], pa.binary())})

    return index.groupBy("shard").applyInArrow(run, "sequence long, ids binary")

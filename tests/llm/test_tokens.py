"""Token counts, BPE and training order beside the public libraries, on the edge cases and on random texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import DATA
from tokenizers import Tokenizer

from sliceweave.llm import bpe, queries, token_counts, token_output

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
EDGE = [None, "", " ", "\n", "  two  spaces ", "a" * 4000, "ab" * 3000, "x<|endoftext|>y", "<|endoftext|>", "don't I'll WE'RE", "漢字" * 500,
        "▁mark", "tab\tand\r\nline", "\x00\x1c\x85 　end", "é́🙂", "same", "same"]


@pytest.fixture(scope="module")
def fuzz():
    rnd = random.Random(4)
    signs = "abst  \n\t'SEé漢🙂▁\x1c　\x85١2.,<|endoftext|>"
    return ["".join(rnd.choice(signs) for _ in range(rnd.randrange(50))) for _ in range(1500)]


def frame(spark, texts):
    """Ids with nulls and repeats, and columns whose names clash with those made."""
    rows = [(None if i % 5 == 4 else i // 2, t, "n", "i", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids string, __in0 int")


def test_counts_as_the_library(spark, fuzz):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = EDGE + fuzz
    got = token_counts.count_tokens(frame(spark, texts), PIECE).collect()
    assert [r.n_tokens for r in got] == [len(model.encode(t or "")) for t in texts]
    assert [r.n_bytes for r in got] == [len((t or "").encode()) for t in texts]
    assert [r.doc_id for r in got] == [None if i % 5 == 4 else i // 2 for i in range(len(texts))]


def test_whole_pieces_are_proved():
    pieces, model = token_counts.Pieces(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    spaced = [p for p in sorted(pieces.whole) if p.startswith("▁") and not p.startswith("▁▁") and len(p) > 1]
    assert len(spaced) > 10_000 and all(len(ids) == 1 for ids in model.encode([p[1:] for p in spaced]))


@pytest.mark.parametrize("size", [3, 39, 40, 41, 42, 500])
def test_short_and_long_merges_agree(size):
    score = token_counts.Pieces(PIECE).score
    rnd = random.Random(size)
    for _ in range(20):
        part = "".join(rnd.choice("aabtheinrs▁") for _ in range(size))
        assert token_counts._merge_short(part, score) == token_counts._merge_long(part, score)


def test_encoding_as_the_library(spark, fuzz):
    library, texts = Tokenizer.from_file(BYTE), EDGE + fuzz
    got = bpe.encode(frame(spark, texts), BYTE, decode=True).collect()
    for text, row in zip(texts, got):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(row.ids, "<u4").tolist() == ids and row.n_tokens == len(ids)
        assert row.decoded == library.decode(ids, skip_special_tokens=False) == (text or "")


def test_decoding_alone(spark):
    library = Tokenizer.from_file(BYTE)
    rows = [[], [50256], [0, 255, 300], [188, 188], None]  # 188 is a byte that is no text alone
    packed = [(i, None if r is None else np.array(r, "<u4").tobytes()) for i, r in enumerate(rows)]
    got = bpe.decode(spark.createDataFrame(packed, "doc_id int, ids binary"), BYTE).collect()
    assert [r.decoded for r in got] == [library.decode(r or [], skip_special_tokens=False) for r in rows]


def test_compatible_pairs_are_those_that_merges_keep():
    coder, library = bpe.BpeEncoder(bpe.ByteBpe.load(BYTE)), Tokenizer.from_file(BYTE)
    rnd, words = random.Random(2), [i for i, t in enumerate(coder.bpe.tokens) if t.isalpha()]
    for _ in range(3000):
        a, b = rnd.choice(words), rnd.choice(words)
        both = (coder.bpe.tokens[a] + coder.bpe.tokens[b]).decode("ascii", "ignore")
        assert coder.compatible(a, b) == (library.encode(both, add_special_tokens=False).ids == [a, b])


def test_empty_tables(spark):
    none = frame(spark, ["x"]).where("false")
    assert token_counts.count_tokens(none, PIECE).count() == 0 and bpe.encode(none, BYTE, decode=True).count() == 0
    index, folder = token_output.materialise(none, BYTE, 1)
    assert index.count() == 0 and list(token_output.read_slots(folder)) == []


def test_queries_cover_the_table(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.QUERIES["op1_token_counts"](spark, DATA).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {
        d: (len(t.encode()), n := len(model.encode(t)), n > 4096) for d, t in texts.items()}
    assert queries.QUERIES["op10_bpe_round_trip"](spark, DATA).count() == len(texts)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    order = token_output.Feistel(n, key=99)
    slots = order.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert np.array_equal(order.sequence(slots), np.arange(n))
    if n == 1000:
        assert not np.array_equal(slots, token_output.Feistel(n, key=100).slot(np.arange(n)))


def test_training_order_round_trip(spark):
    texts = EDGE + [f"document {i} " * (i % 90) for i in range(300)]
    library = Tokenizer.from_file(BYTE)
    index, folder = token_output.materialise(frame(spark, texts), BYTE, 7, length=64, per_shard=32)
    rows = index.orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(len(rows)))
    order = token_output.Feistel(len(rows), 7)
    assert [r.sequence for r in rows] == order.sequence(np.arange(len(rows))).tolist()
    assert all((r.shard, r.offset) == (r.slot // 32, r.slot % 32 * 128) for r in rows)
    records = list(token_output.read_slots(folder))
    assert len(records) == len(rows) and [r.tolist() for r in token_output.read_slots(folder, 40, 5)] == [r.tolist() for r in records[40:45]]
    # In sequence order the records are the stream of all texts, each closed by the end token, in the table's order.
    stream = np.concatenate([records[s] for s in order.slot(np.arange(len(rows)))])[:sum(r.n_tokens for r in rows)]
    cuts = np.flatnonzero(stream == 50256)
    closed = sorted(tuple(p) for p in np.split(stream.tolist(), cuts + 1)[:-1])
    wanted = []
    for t in texts:  # a special string inside a text closes a part as well
        ids, part = library.encode(t or "", add_special_tokens=False).ids + [50256], []
        for i in ids:
            part.append(i)
            if i == 50256:
                wanted.append(tuple(part))
                part = []
    assert closed == sorted(wanted)
    back = {r.sequence: r.ids for r in token_output.restore(spark, index, folder).collect()}
    assert b"".join(back[s] for s in range(len(rows))) == stream.astype("<u2").tobytes()
    assert zlib.crc32(records[0].tobytes()) == zlib.crc32(next(token_output.read_slots(folder)).tobytes())

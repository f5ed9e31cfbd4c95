"""What a worker process holds: one operator's table, and no memory that is free."""

import subprocess
import sys

import public_tokenizers
from conftest import ROOT

from sliceweave.llm import bpe, common

HELD = """
import re
import pyarrow as pa, public_tokenizers
from sliceweave.llm import bpe, common

def held():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

encoder = common._PROCESS["table"] = bpe.BpeEncoder(bpe.ByteBpe.load(public_tokenizers.path("byte_bpe_50k.json")))
common.trim()
first = held()
for at in range(0, 300_000, 1000):
    texts = pa.array([f"{i:x}q{i * 7:x}z " for i in range(at, at + 1000)])
    pa.array([encoder.decode(encoder.encode(text)).decode() for text in texts.to_pylist()])
    del texts
full = held()
del encoder
common.release()
print(first, full, held())
"""


def test_release_gives_memory_back_to_the_system():
    out = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True, cwd=ROOT).stdout
    first, full, after = map(float, out.split())
    assert full > first + 30
    assert after < first + 0.5 * (full - first), out


def test_stage_without_a_table_gives_back_that_of_the_stage_before(spark):
    def tables(texts):
        return {"kinds": [",".join(kind for kind, _ in common._PROCESS)] * len(texts)}

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string").coalesce(1)
    assert bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 40
    shared = common.Shared(spark, "own", 1)
    with_table = common.map_rows(docs, ["text"], "kinds string", lambda texts: (shared.get(str), tables(texts))[1], shared=shared)
    for df, wanted in ((common.map_rows(docs, ["text"], "kinds string", tables), ""), (with_table, "own"), (with_table, "own")):
        assert {r.kinds for r in df.collect()} == {wanted}


def test_arrow_batches_of_texts_are_bounded_by_bytes(spark):
    docs = spark.range(3000, numPartitions=1).selectExpr("id", "repeat('text ', 2000) text")
    before = spark.conf.get(common.BATCH_CONF)
    try:
        common.bound_batches(spark)
        sizes = docs.mapInArrow(lambda batches: (type(b).from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
        assert len(sizes) > 5 and max(r.n for r in sizes) < 2 * common.BATCH_BYTES
        for held, wanted in (("1m", "1m"), ("4096kb", "4096kb"), ("64m", str(common.BATCH_BYTES)), (str(1 << 20), str(1 << 20)), ("5000000", str(common.BATCH_BYTES))):
            spark.conf.set(common.BATCH_CONF, held)
            common.bound_batches(spark)
            assert spark.conf.get(common.BATCH_CONF) == wanted
    finally:
        spark.conf.set(common.BATCH_CONF, before)


def test_pieces_met_once_are_not_kept():
    encoder = bpe.BpeEncoder(bpe.ByteBpe.load(public_tokenizers.path("byte_bpe_50k.json")), bpe.MARKS)
    text = " ".join(f"{a}q{b}xz{c}" for a in "abcdefgh" for b in "bdfhjkmp" for c in "abcdefgh")
    first = encoder.encode(text)
    assert len(encoder.memo) < 50  # 512 pieces, met once
    assert encoder.encode(text) == first and len(encoder.memo) > 450

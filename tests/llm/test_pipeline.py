"""The pipeline: every stage on the rows that the stage before kept, with odd rows and extra columns."""

import hashlib

import numpy as np
import public_tokenizers
from conftest import DATA
from tokenizers import Tokenizer

import corpus_pipeline
from sliceweave.llm import toxicity
from test_near_duplicates import brute_groups, plain_fingerprint
from test_scans import brute_hits


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = [(None, None, None, None, None), (900_001, "", "en", "s", 0), (900_002, " ", "en", "s", 1), (900_003, "word " * 30_000, "en", "s", 1), (900_003, "word " * 30_000, "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "bpe"]

    clean = stages["toxicity"](spark, docs, DATA)
    model = toxicity.fit(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    scorer, before = toxicity.Scorer(model), docs.collect()
    wanted = [r for r, s in zip(before, scorer.scores([r.text for r in before])) if s < toxicity.TOXIC]
    assert clean.columns == columns and sorted(map(str, clean.collect())) == sorted(map(str, wanted))

    kept = stages["near_duplicates"](spark, clean, DATA)
    rows = kept.collect()
    assert kept.columns == columns and set(map(str, rows)) <= set(map(str, wanted))
    label = brute_groups([plain_fingerprint(r.text) for r in wanted])
    groups: dict = {}
    for r, g in zip(wanted, label):
        groups.setdefault(g, []).append(str(r))
    stay = {str(r) for r in rows}
    assert len(stay) == len(rows)
    sets = [frozenset(zip(*[(r.text or "").lower().split()[i:] for i in range(5)])) for r in wanted]
    for members in groups.values():  # at most one of a group stays; none only if a similar text stays for it
        assert len(stay & set(members)) <= 1
    lost = [i for i, r in enumerate(wanted) if not stay & set(groups[label[i]])]
    for i in lost:
        assert any(len(sets[i] & s) >= 0.6 * len(sets[i] | s) for j, s in enumerate(sets) if label[j] != label[i])

    pure = stages["decontamination"](spark, kept, DATA)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    hits = brute_hits([r.text for r in rows], items)
    assert pure.columns == columns
    assert sorted(map(str, pure.collect())) == sorted(str(r) for r, (n, hit, _) in zip(rows, hits) if not (hit and 20 * hit >= n))

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = sorted((r.doc_id or -1, r.text or "") for r in pure.collect())
    coded = sorted((r.doc_id or -1, r.ids_sha256, r.decoded_sha256) for r in stages["bpe"](spark, pure, DATA).collect())
    ids = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for _, t in texts]
    assert coded == sorted((d, hashlib.sha256(i).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for (d, t), i in zip(texts, ids))


def test_run_and_empty_documents(spark):
    assert 0 < corpus_pipeline.run(spark, DATA).count() < spark.read.parquet(f"{DATA}/documents.parquet").count()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0


def test_clashing_columns_stay(spark):
    rows = [(1, "first text of all", 7, "d"), (2, "another text", 8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, digest string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == ["doc_id", "text", "score", "digest"], name
    assert sorted(map(tuple, docs.collect())) == rows

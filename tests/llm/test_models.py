"""Toxicity and nearest neighbours: gradients, held-out accuracy, exact distances and recall."""

import random
import zlib

import numpy as np
import pytest
from conftest import DATA

from sliceweave.llm import ann, queries, toxicity


def test_gradients():
    rng = np.random.default_rng(0)
    network = toxicity.Network(5)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    gates, mask = rng.standard_normal((6, 3, 6 * toxicity.STATE)), np.ones((6, 3))
    mask[4:, 1] = 0
    weights = rng.standard_normal(3)
    loss = lambda: float(network.forward(gates.__getitem__, mask) @ weights)
    keep: dict = {}
    network.forward(gates.__getitem__, mask, keep)
    g, d_gates = network.gradients(keep, weights)
    for array, gradient in [(network.p[k], g[k]) for k in ("att", "out", "out_b")] + [(gates, d_gates)]:
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in array.shape)
            old = array[at]
            array[at] = old + 1e-2
            up = loss()
            array[at] = old - 1e-2
            down = loss()
            array[at] = old
            assert abs((up - down) / 2e-2 - gradient[at]) < 2e-3


def labelled(n, seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 7)))
    rows = []
    for i in range(n):
        text, toxic = [word() for _ in range(rnd.randrange(5, 200))], rnd.random() < 0.25
        if toxic:
            for _ in range(3):
                text[rnd.randrange(len(text))] = rnd.choice(["qqvile", "zzfoul", "xxbad"])
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_learns_and_scores_held_out(spark):
    rows = labelled(1200)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scored = {r.doc_id: r.score for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    held = [(scored[i], t) for i, _, t in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    good = sum((s >= toxicity.TOXIC) == bool(t) for s, t in held)
    assert len(held) > 200 and good >= 0.95 * len(held)
    # Far behind in a very long text one window is enough.
    long = spark.createDataFrame([(1, "abc " * 20_000 + "qqvile zzfoul xxbad qqvile"), (2, "abc " * 20_000)], "doc_id long, text string")
    first, second = (r.score for r in toxicity.score(long, model, ["doc_id"]).orderBy("doc_id").collect())
    assert first >= toxicity.TOXIC > second
    edge = spark.createDataFrame([(None, None, 1, "a"), (1, "", 1, "a"), (1, "...", 1, "a"), (1, "abc", 1, "a"), (1, "abc", 1, "a")], "doc_id long, text string, score int, label string")
    got = [r.made for r in toxicity.score(edge, model, edge.columns, name="made").collect()]
    assert len(got) == 5 and got[0] == got[1] == got[2] and got[3] == got[4] and all(0 <= s <= 1 for s in got)
    kept = toxicity.clean_documents(edge, model)
    assert kept.columns == edge.columns and kept.count() == 5


def test_held_out_labels_teach_nothing(spark):
    rows = [r for r in labelled(600) if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels) is None
    assert {r.score for r in toxicity.score(docs, None, ["doc_id"]).collect()} == {0.0}
    nulls = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    assert toxicity.fit(docs, nulls) is None and toxicity.fit(docs.where("false"), labels) is None


def test_repeated_ids_are_learnt_once(spark, monkeypatch):
    """An id that repeats in many documents brings one row to the driver."""
    rows = [(i, f"some words {i}") for i in range(40)] + [(1, f"again {i % 7}") for i in range(500)] + [(1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda documents: seen.append(len(documents)))
    toxicity.fit(docs, labels)
    assert seen == [sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(40))] and zlib.crc32(b"1") % 4 != 2


def test_windows_cover_every_word():
    for n in (0, 1, 47, 48, 49, 86, 87, 500, 4001):
        covered = {i for s in toxicity.window_starts(n) for i in range(s, min(n, s + toxicity.WINDOW))}
        assert covered == set(range(n))


def test_every_window_is_scored():
    """The score is that of the most toxic of all windows, so words put in front of a text can not lower it."""
    rnd = random.Random(5)
    vocabulary = {f"w{i}".encode(): i + 1 for i in range(60)}
    network = toxicity.Network(len(vocabulary), seed=3)
    texts = [[f"w{rnd.randrange(80)}" for _ in range(n)] for n in (1, 20, 47, 48, 49, 70, 130, 300)]
    scorer = toxicity.Scorer((vocabulary, network))
    got = scorer.scores([" ".join(t) for t in texts], block=64)
    for text, score in zip(texts, got):
        each = scorer.scores([" ".join(text[s:s + toxicity.WINDOW]) for s in range(max(1, len(text) - toxicity.WINDOW + 1))])
        assert abs(max(each) - score) < 1e-5
    for k in range(1, 40):
        assert scorer.scores([" ".join(["w1"] * k + texts[-1])])[0] >= got[-1] - 1e-5


def test_character_grams(monkeypatch):
    """Words are read by all n-grams with their borders, the same alone, among others and in small pieces."""
    words = ["ab", "abc", "größe", "a", "日本語", "x" * 50]
    words = [w.encode() for w in words] + [b"\xed\xa0\x80"]
    flat, sizes = toxicity.char_grams(words)
    want = [sum(max(0, len(w.decode("utf-8", "replace")) + 2 - n + 1) for n in toxicity.GRAMS) for w in words]
    assert sizes.tolist() == want and flat.max() < toxicity.BUCKETS
    ends = np.cumsum(sizes)
    for word, a, b in zip(words, ends - sizes, ends):
        assert sorted(toxicity.char_grams([word])[0]) == sorted(flat[a:b])
    long = ["y" * 5000 + " z " + "w" * 30, "ab abc", None, "q" * 700]
    model = ({b"ab": 1}, toxicity.Network(1, seed=2))
    whole = toxicity.Scorer(model).scores(long)
    monkeypatch.setattr(toxicity, "READ_BYTES", 16)
    monkeypatch.setattr(toxicity, "KEEP_WORDS", 1)
    assert np.allclose(toxicity.Scorer(model).scores(long), whole, atol=1e-6)


def test_toxicity_query(spark):
    got = queries.QUERIES["op2_toxicity"](spark, DATA).collect()
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def brute_nearest(rows, asked, k):
    out = set()
    valid = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    for q, v in valid:
        if asked(q):
            near = sorted((float(np.sqrt(((np.float32(v).astype(float) - np.float32(w).astype(float)) ** 2).sum())), i) for i, w in valid if i != q)[:k]
            out |= {(q, rank + 1, i, round(d, 9)) for rank, (d, i) in enumerate(near)}
    return out


def test_nearest_with_ties_and_invalid_vectors(spark):
    rnd = random.Random(3)
    rows = [(i, [float(rnd.randrange(3)) for _ in range(3)]) for i in range(300)]
    rows += [(400, None), (401, []), (402, [0.0, 0.0, 0.0]), (403, [1.0, None, 1.0]), (404, [1.0, float("nan"), 0.0]), (405, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]),
             (10, rows[10][1]), (23, [5.0, 5.0, 5.0])]
    df = spark.createDataFrame([(i, v, "q", 1) for i, v in rows], "vec_id long, embedding array<float>, query_id string, score int")
    got = ann.nearest(df, df.where("vec_id % 10 = 0"), 10)
    found = {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got.collect()}
    assert found == brute_nearest(rows, lambda q: q % 10 == 0, 10)
    assert ann.nearest(df.where("false"), df.where("false")).count() == 0
    two = df.where("vec_id in (0, 1)")
    assert sorted((r.query_id, r.vec_id) for r in ann.nearest(two, two, 10).collect()) == [(0, 1), (1, 0)]


def test_one_part_is_exact(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = queries.QUERIES["op8_learned_partitions"](spark, DATA).collect()
    found = {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got}
    assert found == brute_nearest(rows, lambda q: q % 100 == 0, 10)


def test_learned_partitions_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 16)) * 4
    x = (centres[rng.integers(0, 60, 6000)] + rng.standard_normal((6000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got: dict = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), 10).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    recall = []
    for q in range(0, 6000, 50):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1)
        d[q] = np.inf
        recall.append(len(set(np.argsort(d)[:10].tolist()) & set(got[q])) / 10)
    assert len(got) == 120 and np.mean(recall) >= 0.9


def test_partitions_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((200, 8)) + 8 * rng.standard_normal(8) for _ in range(8)]).astype(np.float32)
    graph = ann.neighbour_graph(x)
    part = ann.balanced_parts(graph, 8)
    assert np.bincount(part).tolist() == [200] * 8
    assert (part[:, None] == part[graph]).mean() > 0.8


def test_lengths_must_agree(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec_id long, embedding array<float>")
    with pytest.raises(ValueError, match="length"):
        ann.nearest(df, df)


def test_small_parts_are_filled_up(spark, monkeypatch):
    """A query whose probable part holds three vectors still gets ten rows."""
    router = ann.Router(3, 2)
    for w in router.w:
        w[:] = 0
    router.w[0][0, 0], router.w[2][0, 0], router.w[3][1] = 1, 100, 5  # a positive first value is part 0
    monkeypatch.setattr(ann, "learn", lambda sample, parts: router)
    rng = np.random.default_rng(1)
    rows = [(i, [10.0 if i < 3 else -10.0, *map(float, rng.standard_normal(2))]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(df, df.where("vec_id in (0, 5)"), 10)
    assert sorted((r.query_id, r["rank"]) for r in got.collect()) == [(q, k) for q in (0, 5) for k in range(1, 11)]

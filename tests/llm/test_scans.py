"""Decontamination, license scans and shards beside brute force, and their SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from conftest import DATA
from oracle import compare, connect

from sliceweave.llm import decontaminate, license_scan, queries, sharding


def words(text):
    low = re.sub(r"[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(docs, items, size=13):
    """Words, hit words and items of each document by comparing every window."""
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    lengths, out = {len(w) for w in windows}, []
    for text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= {str(x) for x in windows[tuple(w[i:i + n])] if x is not None}
        out.append((len(w), len(hit), sorted(found)))
    return out


def random_case(seed):
    rnd = random.Random(seed)
    pool = ["a", "b", "c", "É", "x1", "d", "ß"]
    text = lambda low, high: " ".join(rnd.choice(pool) for _ in range(rnd.randrange(low, high)))
    items = [(i, text(0, 30)) for i in range(12)] + [(12, None), (13, ""), (14, "a B"), (14, "a B"), (None, "only null id here"), (15, "!!!")]
    docs = [text(0, 60) for _ in range(40)] + [items[3][1].upper(), None, "", "-- only null ID here --", "a" * 5000, "a " * 3000]
    return docs, items


@pytest.mark.parametrize("seed, block", [(1, 400_000), (2, 400_000), (3, 20)])
def test_windows_as_brute_force(spark, seed, block):
    docs, items = random_case(seed)
    df = spark.createDataFrame([(None if i % 7 == 0 else i // 2, t, i, "x", "y") for i, t in enumerate(docs)], "doc_id long, text string, at int, n_words string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows, made = decontaminate.scan(df, bench, ["at"], block=block)
    got = rows.select("at", made["n_words"], decontaminate.hit_words(made).alias("n"), made["items"]).orderBy("at").collect()
    assert [tuple(r)[1:] for r in got] == brute_hits(docs, items)
    kept = decontaminate.clean_documents(df, bench, block=block)
    assert kept.columns == df.columns
    assert sorted(r["at"] for r in kept.collect()) == [i for i, (n, hit, _) in enumerate(brute_hits(docs, items)) if not (hit and 20 * hit >= n)]


def test_empty_benchmark_and_documents(spark):
    df, bench = spark.createDataFrame([(1, "some words")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean_documents(df, bench).count() == 1
    assert decontaminate.clean_documents(df.where("false"), spark.createDataFrame([(1, "some words")], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("name", ["op7_proportional_shards", "op9_decontamination"])
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(DATA), queries.QUERIES[name], queries.ORACLES[name], DATA) is None


def brute_base(text):
    w, places = words(text), []
    for label, phrase in license_scan.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), sorted({label for _, label in places})


LICENSES = [
    None, "", "none here", "Licensed under the MIT License.", "under the mit license " * 3, "Apache License, Version 2.0; CC-BY-NC; under the MIT-license",
    "cc by nc cc by nc by nc", "under the mit licens", "Under The KMIT License", "x " * 30_000 + "cc by nc",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "permission is hereby granted free of charge to every person obtaining one copy of this new software and associated documentation files",
    "redistribution and use in source", "İ under the mit license", "under the mit license",
]


def test_license_places_and_spans(spark):
    rows = [(None if i == 3 else i // 2, t, 5, "clash", i) for i, t in enumerate(LICENSES)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, labels string, id int")
    got = license_scan.scan(df).collect()
    assert len(got) == len(rows)
    found = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str)
    assert found == sorted(((row[0], *brute_base(row[1])) for row in rows), key=str)
    by_words = {r.n_words: r for r in got}
    whole, changed = by_words[len(words(LICENSES[10]))], by_words[len(words(LICENSES[11]))]
    assert (whole.labels, whole.score) == (["mit"], 1.0)
    assert all(0 <= r.score <= 1 and set(r.base_labels) <= set(r.labels) for r in got)
    assert changed.labels == [] or changed.score >= license_scan.COVERAGE
    assert license_scan.scan(df.where("false")).count() == 0


def test_changed_licenses_merge_their_diagonals(spark):
    sentence = license_scan.SENTENCES["bsd"].split()
    text = " ".join(["intro"] * 20 + sentence[:8] + ["added"] + sentence[8:] + ["end"])
    spans = license_scan.occurrences(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(s.label, s.first_word, s.last_word) for s in spans] == [("bsd", 20, 20 + len(sentence))]
    assert spans[0].share == (len(sentence) - 4) / (len(sentence) - 2)


def test_license_query_beside_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.QUERIES["op6_license_scan"](spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        n, places, first, last, labels = brute_base(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, places, first, last, ",".join(labels))


@pytest.mark.parametrize("n, shards", [(0, 8), (3, 8), (1000, 8), (997, 7)])
def test_shards_hold_the_mixture(spark, n, shards):
    rnd = random.Random(n)
    rows = [(None if i % 50 == 7 else i // 2, rnd.choice([None, "", f"text {i // 4} é"]), rnd.choice(["hot"] * 5 + ["b", "c", None]), i, "k") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, shard string")
    got = sharding.interleave(df, shards, 3).collect()
    assert len(got) == n
    sizes = Counter(r.shard for r in got)
    assert n < shards or (set(sizes) == set(range(shards)) and max(sizes.values()) - min(sizes.values()) <= 1)
    for shard in sizes:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sizes[shard]))
    for source, count in Counter(r.source for r in got).items():
        assert all(abs(sum(r.source == source for r in got if r.shard == s) - count / shards) <= 3 for s in sizes if n >= shards)
    wanted = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == wanted
    again = sharding.interleave(df.repartition(5), shards, 3).collect()
    key = lambda r: (str(r.doc_id), r.size, r.text_crc32, str(r.source), r.shard, r.slot)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_items_digest(spark):
    got = queries.QUERIES["op9_decontamination"](spark, DATA).where("n_items = 0").first()
    assert got.items_sha256 == hashlib.sha256(b"").hexdigest()

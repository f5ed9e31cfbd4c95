"""Spelling variants beside a comparison of all pairs of words, and their SQL."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import DATA
from oracle import compare, connect

from sliceweave.llm import queries, spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 7:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items())


def some_rows(seed):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice("aeinrstÀéß") for _ in range(rnd.randrange(6, 13))) for _ in range(12)] + ["Àbcdefgh", "x" * 900]
    rows = []
    for i in range(500):
        words = []
        for _ in range(rnd.randrange(0, 25)):
            word = list(stems[min(rnd.randrange(40), rnd.randrange(len(stems)))])
            for _ in range(rnd.choice([0, 0, 0, 0, 0, 1, 1, 2])):
                at = rnd.randrange(len(word))
                word[at:at + rnd.choice([0, 1])] = rnd.choice(["", "e", "a", "À", "zz"])
            words.append("".join(word).upper() if rnd.random() < 0.1 else "".join(word))
        rows.append((rnd.choice([None, i, i % 7]), rnd.choice([" ", "-", "×1 "]).join(words)))
    return rows + [(1, None), (2, ""), (3, "123 !"), rows[5], rows[5], (4, "ab " * 2000 + "longword" * 3)]


def got(spark, rows, block):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    return sorted(map(tuple, spelling.variants(df, block=block).collect()))


@pytest.mark.parametrize("seed, block", [(1, 32_768), (2, 40), (3, 7)])
def test_as_all_pairs(spark, seed, block, monkeypatch):
    monkeypatch.setattr(spelling, "TILE", 16)
    rows = some_rows(seed)
    assert got(spark, rows, block) == brute(rows)


def test_edges(spark):
    assert got(spark, [], 10) == [] and got(spark, [(1, None), (2, "short words only")], 10) == []
    chain = ["abcdefgh"] * 3 + ["abcdefgi"] * 40 + ["abcdefii"] * 500
    rows = [(10_000 + i, w) for i, w in enumerate(chain)]
    assert got(spark, rows, 10) == brute(rows)


def test_edits_of_two_blocks():
    rnd = np.random.default_rng(4)
    for shorter, longer in ((8, 8), (8, 9), (1, 1), (1, 2)):
        a, b = rnd.choice([97, 98, 0xE9], (300, shorter)).astype(np.uint8), rnd.choice([97, 98, 0xE9], (300, longer)).astype(np.uint8)
        text = lambda row: row.tobytes().decode("latin-1")
        assert spelling._one_edit(a, b).tolist() == [one_edit(text(x), text(y)) for x, y in zip(a, b)]


def test_query_matches_sql(spark):
    assert compare(spark, connect(DATA), queries.op12_spelling_variants, queries.ORACLES["op12_spelling_variants"], DATA) is None

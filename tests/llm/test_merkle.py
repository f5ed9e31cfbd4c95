"""The Merkle manifest beside a tree built plainly, and its SQL."""

import random
import re
import zlib
from hashlib import sha256

import pytest
from conftest import DATA
from oracle import compare, connect

from sliceweave.llm import merkle, queries


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes):
    """The root, and for each node its (before, after) digests on the way."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            first = place // 8 * 8
            run = nodes[first:first + 8]
            paths[i].append(("".join(run[:place - first]), "".join(run[place - first + 1:])))
        nodes, at = [h(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)], [p // 8 for p in at]
    return nodes[0], paths


def brute(rows):
    """Rows (doc_id, text, lang, source, n_chars) to the query's columns."""
    order = lambda d: (d[0] is not None, d[0] or 0, leaf((d[0], d[3], d[2], d[4], d[1])))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=order)
        trees.append((own, *climb([leaf((d, s, lg, n, t)) for d, t, lg, s, n in own])))
    root, high = climb([t[1] for t in trees])
    out = []
    for (own, subroot, paths), above in zip(trees, high):
        for (d, t, lg, s, n), path in zip(own, paths):
            digest = cur = leaf((d, s, lg, n, t))
            if d is not None and zlib.crc32(str(d).encode()) % 3 == 0:
                cur = leaf((d, s, lg, n, t and re.sub("[A-Z]", lambda m: m.group().lower(), t)))
            for before, after in path + above:
                cur = h(before, cur, after)
            out.append((d, digest, subroot, root, h(*[b + a for b, a in path + above]), cur, cur == root))
    return sorted(out, key=str)


def got(spark, rows, levels):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, digest string, rank int")
    return sorted(map(tuple, merkle.verified(merkle.manifest(df, levels=levels)).collect()), key=str)


def some_rows(seed, n):
    rnd = random.Random(seed)
    langs = [None, "", "en", "En", "é", *(f"l{i}" for i in range(rnd.choice([0, 1, 20])))]
    rows = [(rnd.choice([None, i, i // 3]), rnd.choice([None, "", "Text A", "abc É", f"T{i}"]), rnd.choice(["en", rnd.choice(langs)]), rnd.choice([None, "s"]), rnd.choice([None, 3])) for i in range(n)]
    return rows + rows[:5]


@pytest.mark.parametrize("seed, n, levels", [(1, 700, 1), (2, 700, 2), (3, 90, 3), (4, 1, 3), (5, 8, 1), (6, 9, 1), (7, 64, 1), (8, 65, 2)])
def test_as_plain_tree(spark, seed, n, levels):
    rows = some_rows(seed, n)
    assert got(spark, rows, levels) == brute(rows)


def test_lone_leaf_and_empty_table(spark):
    rows = [(3, "A" * 200_000, "en", None, None)]
    assert got(spark, rows, 3) == brute(rows)
    assert got(spark, rows, 3)[0][1] == got(spark, rows, 3)[0][3]
    assert got(spark, [], 3) == []


def test_query_matches_sql(spark):
    assert compare(spark, connect(DATA), queries.op13_merkle_manifest, queries.ORACLES["op13_merkle_manifest"], DATA) is None

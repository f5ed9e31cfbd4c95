"""Personal data beside plain regular expressions and a plain version of the pattern graph."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from conftest import DATA

from sliceweave.llm import identifiers, queries

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
         "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}
OUTER = "\"'`()[]{}<>,;:!?.|=*#_/\\~^&%$-"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, form in PLAIN.items():
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")),
                    "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if fits:
                out.append((m.start(), list(PLAIN).index(kind) + 1, m.end()))
    return sorted(out)


def token_rows(texts):
    """(text, start, end, seed, core, patterns) of every token that looks like an identifier."""
    out = []
    for number, text in enumerate(texts):
        text = text or ""
        spans = base_spans(text)
        words = [(m.start(), m.end(), m.group()) for m in re.finditer(r"\S+", text, re.A)]
        like = [bool(re.search("[0-9@]", w)) for _, _, w in words]
        for i, (a, b, word) in enumerate(words):
            if not like[i]:
                continue
            cover = max(((e, k) for s, k, e in ((s, list(PLAIN)[k - 1], e) for s, k, e in spans) if s < b), default=None)
            core = word.lstrip(OUTER)
            start = a + len(word) - len(core)
            core = core.rstrip(OUTER)
            digits = len(re.sub("[^0-9]", "", core))
            if "@" not in core and digits < identifiers.DIGITS:
                continue
            form = ("mail" if "@" in core else "mixed" if re.search("[A-Za-z]", core) else "dotted" if "." in core else
                    "short" if digits < 10 else "number" if digits < 14 else "long")
            left, right = [], []
            for k in range(i - 1, max(-1, i - 3), -1):
                if like[k]:
                    break
                left.insert(0, words[k][2].lower())
            for k in range(i + 1, min(len(words), i + 3)):
                if like[k]:
                    break
                right.append(words[k][2].lower())
            found = [("before", form, *left)] if left else []
            found += [("around", form, left[-1], right[0])] if left and right else []
            found += [("after", form, *right)] if right else []
            out.append((number, start, start + len(core), cover[1] if cover and cover[0] > a else None, core, found))
    return out


def all_spans(texts):
    rows = token_rows(texts)
    of, known = defaultdict(set), {}
    for *_, seed, core, found in rows:
        for p in found:
            of[p].add(core)
        if seed:
            known[core] = min(known.get(core, seed), seed)
    score = {(core, kind): 1000 for core, kind in known.items()}
    for _ in range(identifiers.ROUNDS):
        sure = defaultdict(int)
        for p, cores in of.items():
            for kind in PLAIN:
                value = sum(score.get((c, kind), 0) for c in cores) // (len(cores) + 1)
                if value >= identifiers.LENDS:
                    sure[p, kind] = value
        doubt = defaultdict(int)
        for (p, kind), value in sure.items():
            for c in of[p] - known.keys():
                doubt[c, kind] += math.floor(-math.log(1 - value / 1000) * 1_000_000)
        score = {(core, kind): 1000 for core, kind in known.items()}
        score |= {key: min(999, math.floor(1000 * (1 - math.exp(-d / 1_000_000)))) for key, d in doubt.items()}
    out = [base_spans(t) for t in texts]
    for number, start, end, seed, _, found in rows:
        marks = [(-sure[p, kind], kind) for p in found for kind in PLAIN if sure[p, kind] >= identifiers.MARKS]
        if marks and not seed:
            out[number].append((start, list(PLAIN).index(min(marks)[1]) + 1, end))
    return [sorted(x) for x in out]


def some_texts(seed):
    rnd = random.Random(seed)
    pieces = ["mail", "card", "ip", "phone:", "É", "\U0001F600", ".", "-", "+", "@", " ", "  ", "\n", "1", "22", "255", "256.1.2.3", "10.0.0.1", "1.2.3.4.5.6.7.8.9", "a@b.c_d@e.f", "x.y@z-1.co..uk",
              "a@b.", "4111111111111111", "4111 1111-1111 1111", "+1 (017) 555-7713", "+1--2", "00000000000000", "0000255.1.1.0", "%@a.b", "12345 -", "ref", "no", "x", " "]
    return ["".join(rnd.choice(pieces) + rnd.choice(["", " ", " ", "x"]) for _ in range(rnd.randrange(0, 40))) for _ in range(120)]


def scan(spark, texts, at=None):
    df = spark.createDataFrame([(i if at is None else at[i], t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, base string, row int")
    rows, made = identifiers.find(df, ["doc_id", "base", "row"])
    assert rows.columns == ["doc_id", "base", "row", made["base"], made["all"]]
    return [tuple([tuple(s) for s in r[k]] for k in (made["base"], made["all"])) for r in rows.orderBy("doc_id").collect()]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_forms_as_plain_expressions(spark, seed):
    texts = some_texts(seed)
    got = scan(spark, texts)
    assert [g[0] for g in got] == [base_spans(t) for t in texts]
    assert [g[1] for g in got] == all_spans(texts)


def card(number):
    return next(f"{number}{c}" for c in range(10) if luhn(f"{number}{c}"))


def contexts():
    rnd = random.Random(5)
    cards = [card(rnd.randrange(10**14, 10**15)) for _ in range(9)]
    broken = card(411111111111111)[:-1] + str((int(card(411111111111111)[-1]) + 1) % 10)
    texts = [f"Paid with card {c} on monday {i}" for i, c in enumerate(cards)] + [f"PAID with  card {broken} on friday", f"He said {broken} then", f"order number {broken} shipped"]
    texts += [f"write to user{i}@mail.example.com today" for i in range(6)] + ["write to admin@localhost today", "some admin@localhost here"]
    return texts + [f"order number {rnd.randrange(10**15, 2 * 10**15)} shipped" for _ in range(9)], broken


def test_contexts_find_unseen_identifiers(spark):
    texts, broken = contexts()
    got = scan(spark, texts)
    assert [g[1] for g in got] == all_spans(texts)
    added = {(i, s) for i, g in enumerate(got) for s in set(g[1]) - set(g[0])}
    assert added == {(9, (16, 3, 32)), (texts.index("write to admin@localhost today"), (9, 1, 24))}  # in the seeds' contexts, and nowhere else
    assert texts[9][16:32] == broken


def test_nulls_long_texts_repeats_and_empty_tables(spark):
    long = ["1 " * 40_000, "a" * 300_000 + "@b.c", "1.1." * 60_000, "a@b" + ".c" * 50_000, "-" * 200_000 + "5" + "-" * 200_000 + "x", "+1" + " " * 100_000, None, "", " \n", "10.0.0.1", "10.0.0.1"]
    got = scan(spark, long)
    mail = lambda t: [(0, 1, len(t))]  # noqa: E731  the plain mail expression takes the square of a run without a mail sign
    known = {1: mail(long[1]), 2: [(4 * i * 2, 2, 4 * i * 2 + 7) for i in range(30_000)], 3: mail(long[3]), 4: []}
    assert [g[0] for g in got] == [known[i] if i in known else base_spans(t) for i, t in enumerate(long)]
    assert scan(spark, ["a@b.c", "a@b.c"], [None, None]) == [([(0, 1, 5)], [(0, 1, 5)])] * 2
    assert scan(spark, []) == []


def test_query_as_plain_version(spark):
    rows = {r["doc_id"]: r for r in queries.op11_personal_data(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    spans = all_spans([d["text"] for d in docs])
    text = lambda s: ",".join(f"{list(PLAIN)[k - 1]}:{a}:{b}" for a, k, b in s)
    assert len(rows) == len(docs)
    for doc, every in zip(docs, spans):
        base, row = base_spans(doc["text"]), rows[doc["doc_id"]]
        assert row["base_sha256"] == hashlib.sha256(text(base).encode()).hexdigest() and row["spans"] == text(every)
        assert [row[f"n_{kind}"] for kind in PLAIN] == [sum(k == i + 1 for _, k, _ in base) for i in range(4)]

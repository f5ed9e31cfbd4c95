import random
from collections import Counter
from hashlib import md5

from sliceweave.operators import neardup


def shingles(text, words=3):
    parts = " ".join(text.lower().split()).split(" ")
    return {" ".join(parts[i:i + words]) for i in range(max(len(parts) - words + 1, 1))}




def test_flags_are_true_and_most_near_texts_are_found(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(90)]
        for edits in (0, 1, 2, 3, 4, 6, 9, 14):
            copy = list(base)
            for at in rng.sample(range(90), edits):
                copy[at] = rng.choice(words)
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "uid int, report string").repartition(6)
    rows = {r["uid"]: r for r in neardup.verified_near_duplicates(df).collect()}
    group = {r["report_group"]: texts[u] for u, r in rows.items()}
    sets = [shingles(t) for t in texts]
    near = {i for at in range(0, len(texts), 8) for i in range(at, at + 8) for j in range(at, at + 8)
            if i != j and texts[i] != texts[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    flagged = {u for u, r in rows.items() if r["near_duplicate"]}
    assert len(rows) == len(texts) and flagged <= near and len(flagged) >= 0.9 * len(near), (len(flagged), len(near))
    print("recall", len(flagged) / len(near))
    for u in flagged:
        a, b = shingles(texts[u]), shingles(group[rows[u]["partner"]])
        assert abs(rows[u]["similarity"] - len(a & b) / len(a | b)) < 1e-12 and rows[u]["similarity"] >= 0.8
        assert rows[u]["representative"] <= rows[u]["report_group"]
    assert all(rows[u]["partner"] is None and rows[u]["representative"] == rows[u]["report_group"] for u in set(rows) - flagged)


def test_odd_texts(spark):
    long = " ".join(f"t{i % 977}" for i in range(20_000))
    near = long.replace("t500 ", "changed ", 1)
    rows = [(1, None, 0), (2, None, 0), (3, "", 0), (4, " ", 0), (5, "Same  text here", 1), (6, "same text\nhere", 1), (7, long, 2), (8, near, 2), (8, near, 3), (None, "alone", 1)]
    df = spark.createDataFrame(rows, "uid int, report string, band int").withColumnRenamed("band", "report_group")
    got = neardup.verified_near_duplicates(df).collect()
    flags = sorted((str(r["uid"]), r["near_duplicate"]) for r in got)
    assert flags == sorted([("1", 0), ("2", 0), ("3", 0), ("4", 0), ("5", 0), ("6", 0), ("7", 1), ("8", 1), ("8", 1), ("None", 0)])
    assert neardup.verified_near_duplicates(df.limit(0)).count() == 0


def test_a_family_is_never_paired(spark):
    """One common text and many near copies: at most one comparison per text and band."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(50)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(i, " ".join([*base[:i % 120], f"x{i}", *base[i % 120 + 1:]])) for i in range(400)]
    got = neardup.verified_near_duplicates(spark.createDataFrame(rows, "uid int, report string")).collect()
    assert sum(r["near_duplicate"] for r in got) >= 396


def test_minima_are_made_once_a_text_and_equal_the_plain_hashes(spark, monkeypatch):
    """The band test stores one row of minima per distinct text; they are those of the formula, shingle by shingle."""
    rng, rows, kept = random.Random(5), [], []
    stored = neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df: kept.append(stored(df)) or kept[-1])
    for i in range(12):
        base = [rng.choice("abcdefgh") * rng.randrange(1, 9) + str(rng.randrange(90)) for _ in range(40 * i + 20)]
        rows += [(len(rows) + k, " ".join(w if at else f"{w}é{k // 2}" for at, w in enumerate(base))) for k in range(3)]  # two copies, one edit
    rows += [(None, "no uid here"), (100, None), (101, ""), (102, " \n"), (103, "two words"), (104, "Two\twords ")]
    got = {r["uid"]: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "uid int, report string")).collect()}
    plain = {u: " ".join((t or "").lower().split()) for u, t in rows if u is not None and t is not None}

    def minima(text):
        numbers = [int(md5(s.encode()).hexdigest()[:7], 16) for s in shingles(text)]
        return [min((n * ((i * 1_000_003 + 7_919) % neardup.PRIME) + (i * 15_485_863 + 104_729) % neardup.PRIME) % neardup.PRIME for n in numbers) for i in range(50)]

    signs = {t: minima(t) for t in set(plain.values())}
    assert len(kept) == 1 and sorted(map(tuple, signs.values())) == sorted(tuple(r["_minima"]) for r in kept[0].collect())
    bands = {t: [(b, *s[5 * b:5 * b + 5]) for b in range(10)] for t, s in signs.items()}
    many = Counter(b for each in bands.values() for b in each)
    assert {u: got[u]["shared_bands"] for u in plain} == {u: sum(many[b] > 1 for b in bands[t]) for u, t in plain.items()}
    assert len(got) == len(rows) and got[100]["shared_bands"] == got[None]["shared_bands"] == 0

"""SimHash groups beside brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from conftest import DATA

from sliceweave.llm import queries, simhash


def plain_fingerprint(text, words=4):
    parts = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    if not parts:
        return 0
    n = min(words, len(parts))
    hashes = [xxhash.xxh64(b" ".join(parts[i:i + n]), seed=42).intdigest() for i in range(len(parts) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(codes, distance=4):
    """Smallest position that each one reaches."""
    codes = np.array(codes, np.uint64)
    near = [np.flatnonzero(np.bitwise_count(codes ^ c) <= distance) for c in codes]
    label = np.arange(len(codes))
    while True:
        new = np.array([label[n].min() for n in near])
        if np.array_equal(new, label):
            return label.tolist()
        label = new


def crowd(seed, n, centres, flips):
    """Fingerprints around a few centres, some far apart and some chained."""
    rnd = random.Random(seed)
    middle = [rnd.getrandbits(64) for _ in range(centres)]
    out = []
    for _ in range(n):
        code = rnd.choice(middle)
        for _ in range(rnd.randrange(flips)):
            code ^= 1 << rnd.randrange(64)
        out.append(code)
    return out


@pytest.mark.parametrize("n, centres, flips, parts", [(300, 40, 6, 3), (2000, 3, 9, 5), (2500, 1, 4, 40), (1500, 700, 3, 2)])
def test_links_reach_what_brute_force_reaches(spark, n, centres, flips, parts):
    codes = sorted(set(crowd(n, n, centres, flips)) | {0, 2**64 - 1})
    rows = spark.createDataFrame([(int(np.uint64(c).astype(np.int64)),) for c in codes], "fp long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        roots = {r.fp % 2**64: r.root for r in simhash.fingerprint_roots(rows).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    groups: dict = {}
    for code, label in zip(codes, brute_groups(codes)):
        groups.setdefault(label, []).append(roots[code])
    assert all(len(set(g)) == 1 for g in groups.values()) and len({g[0] for g in groups.values()}) == len(groups)


@pytest.mark.parametrize("piece", [5, 64])
def test_small_pieces_give_the_same_links(spark, piece):
    codes = sorted(set(crowd(8, 400, 2, 7)))
    rows = spark.createDataFrame([(int(np.uint64(c).astype(np.int64)),) for c in codes], "fp long")
    edges = simhash.links(simhash.rotations(rows), piece=piece)
    roots = {r.node % 2**64: r.root for r in simhash.components(edges).collect()}
    label = brute_groups(codes)
    for i, code in enumerate(codes):
        for j in range(i):
            assert (roots.get(code, code) == roots.get(codes[j], codes[j])) == (label[i] == label[j])


def test_index_skips_and_takes_whole_nodes():
    codes = np.array(sorted(set(crowd(5, 3000, 1, 3))), np.uint64)[:, None]
    label = simhash.connect_sorted(codes, np.zeros(1, np.int64), 4)
    assert len(set(label.tolist())) == len(set(brute_groups(codes[:, 0])))


def test_query_beside_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    codes = [plain_fingerprint(r.text) for r in docs]
    wanted = {r.doc_id: (f"{c:016x}", docs[g].doc_id) for r, c, g in zip(docs, codes, brute_groups(codes))}
    got = queries.QUERIES["op4_simhash_near_duplicates"](spark, DATA).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == wanted


def test_edge_cases(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(5, None), (3, ""), (None, " \t\n"), (7, text), (7, text), (2, text.upper()), (None, "lonely words here"), (9, "é É"), (8, "x " * 50_000)]
    df = spark.createDataFrame([(i, t, 1, 2, "fp") for i, t in rows], "doc_id long, text string, component_id int, fp int, id string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by_fp: dict = {}
    for r in got:
        by_fp.setdefault(r.fp, []).append((r.doc_id, r.component_id))
    assert sorted(by_fp[0], key=str) == sorted([(5, 3), (3, 3), (None, 3)], key=str)
    assert sorted(by_fp[np.uint64(plain_fingerprint(text)).astype(np.int64)]) == [(2, 2), (7, 2), (7, 2)]
    assert [v for v in by_fp.values() if v == [(None, None)]]
    assert simhash.near_duplicates(df.where("false")).count() == 0 and simhash.keep_one(df.where("false")).count() == 0
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in kept.collect()) == [(0, "lonel"), (2, "WORD0"), (3, ""), (8, "x x x"), (9, "é É")]


def test_similar_texts_meet(spark):
    """Texts that share four fifths of their shingles leave one; unlike texts stay."""
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(60)]  # stands in every text
    rows, families = [], []
    for family in range(60):
        base = [word() for _ in range(rnd.randrange(80, 400))]
        base[10:10] = passage if len(base) > 250 else []
        members = [base]
        for _ in range(3):
            changed = list(base)
            for _ in range(max(1, len(base) // 60)):
                changed[rnd.randrange(len(base))] = word()
            members.append(changed)
        families.append(members)
        rows += [(family * 10 + i, " ".join(m)) for i, m in enumerate(members)]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shingles = lambda m: {tuple(m[i:i + 5]) for i in range(len(m) - 4)}
    missed = linked = 0
    for family, members in enumerate(families):
        assert family * 10 in kept
        sets = [shingles(m) for m in members]
        for i in range(1, 4):
            if len(sets[0] & sets[i]) >= 0.8 * len(sets[0] | sets[i]):
                linked += 1
                missed += family * 10 + i in kept
    assert linked > 60 and missed <= 0.03 * linked


def test_keys_of_longer_shingles_stand_for_the_shingles():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 4, 5, 6, 40, 900):
        for _ in range(5):
            words = [f"w{i}" for i in rng.integers(0, 12, n)]
            plain = {" ".join(words[i:i + 5]) for i in range(max(n - 4, 1))} if n else set()
            got = simhash.shingle_set(" ".join(words), 5, 42)
            assert len(got) == len(plain) and (np.diff(got.astype(object)) > 0).all()
            cut = words[n // 3:]
            other = {" ".join(cut[i:i + 5]) for i in range(max(len(cut) - 4, 1))} if cut else set()
            assert len(np.intersect1d(got, simhash.shingle_set(" ".join(cut), 5, 42))) == len(plain & other)


def test_wide_distance_stands_for_the_similarity():
    assert simhash.wide_distance(1.0) == 0 and simhash.wide_distance(0.9) < simhash.wide_distance(0.8) < 200


def kept_ids(spark, texts):
    return {r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


def test_sets_of_shingles_decide_not_repeats(spark):
    """A frequent line makes no near duplicates of unlike texts; repeats of a passage do not part copies."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    line, passage = " ".join(word() for _ in range(10)), " ".join(word() for _ in range(34))
    unlike: list[str] = []
    while len(unlike) < 12:  # the rule of four bits links none of them
        text = " ".join([line] * 40 + [word() for _ in range(100)])
        if all((simhash.fingerprint(text) ^ simhash.fingerprint(other)).bit_count() > 4 for other in unlike):
            unlike.append(text)
    base = " ".join([*(word() for _ in range(100)), passage, *(word() for _ in range(66))])
    kept = kept_ids(spark, [*unlike, base, base + f" {passage}" * 11])
    assert kept == set(range(13))


def test_all_pairs_of_the_similarity_and_no_others(spark):
    """Brute force over short and long texts whose pairs lie on both sides of 0.8."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    texts = []
    for family in range(120):
        base = [word() for _ in range(rnd.choice([8, 8, 9, 12, 40, 90, 150]))]
        texts.append(base)
        texts.append([*base, word()])  # 8 against 9 words: 4 of 5 shingles
        share = rnd.uniform(0.7, 0.86)  # a tail of other words brings the similarity to about this
        texts.append(base + [word() for _ in range(round((len(base) - 4) * (1 / share - 1)))])
    sets = [{tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in texts]
    codes = [simhash.fingerprint(" ".join(t)) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i // 3 * 3, i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) or (codes[i] ^ codes[j]).bit_count() <= 4:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert 60 < len(set(root)) < 300
    assert kept_ids(spark, [" ".join(t) for t in texts]) == set(root)


@pytest.mark.parametrize("meeting", [4096, 3])
def test_meetings_of_crowds_are_whole(spark, monkeypatch, meeting):
    """Chains inside one meeting are found when neither its smallest nor its largest node is near, also piece by piece."""
    monkeypatch.setattr(simhash, "MEETING", meeting)
    rnd = random.Random(6)
    line = "one line that is in all of these short texts and has quite some words".split()
    texts = [[*line, *(f"w{rnd.randrange(10**6)}" for _ in range(2 + i % 5))] for i in range(60)]
    texts += [[*t, "more"] for t in texts[:30]]
    sets = [{tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in texts]
    codes = [simhash.fingerprint(" ".join(t)) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) or (codes[i] ^ codes[j]).bit_count() <= 4:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert kept_ids(spark, [" ".join(t) for t in texts]) == set(root)


def test_own_columns_of_any_name_stay(spark):
    names = ["node", "digest", "_digest", "_text", "_node", "fp", "_own", "id", "tokens", "kept"]
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, *["x"] * len(names)), (2, long + " end", *["y"] * len(names)), (3, "another text of few words", *["z"] * len(names))]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_sets_are_stored_for_possible_pairs_only(spark, monkeypatch):
    """Unlike texts that share one phrase meet, but sizes and parity exclude their pairs, so their sets are not built."""
    rnd, stored, sets = random.Random(12), simhash.stored, []

    def counted(df, name):
        out = stored(df, name)
        if name == "sets":
            sets.append(out.count())
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(9))
    unlike = [" ".join([word() for _ in range(40)] + ["one phrase that all of these texts have in common here"] + [word() for _ in range(40)]) for _ in range(60)]
    likes = [" ".join(word() for _ in range(80)) for _ in range(2)]
    texts = unlike + likes + [likes[0] + " end", likes[1] + " end"]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == set(range(62)) and sets == [4, 0]


def test_long_unlike_texts_are_excluded_by_parity(spark, monkeypatch):
    """512 parity bits exclude no pair of sets of 2,500 shingles; as many bits as shingles do, and folded ones too."""
    rnd, stored, sets = random.Random(13), simhash.stored, []

    def counted(df, name):
        out = stored(df, name)
        if name == "sets":
            sets.append(out.count())
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(9))
    long = lambda n: " ".join([word() for _ in range(n)] + ["one phrase that all of these texts have in common here"])
    unlike = [long(n) for n in (1900, 2000, 2100, 2200, 2300, 2400, 4200, 4300)]  # sizes on both sides of 2,048 and 4,096
    like = unlike[2].split()
    for at in rnd.sample(range(2000), 30):
        like[at] = "other"
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(enumerate([*unlike, " ".join(like)])), "doc_id long, text string")).collect()}
    assert kept == set(range(8)) and sets[0] <= 2 and sum(sets) == 2


def test_folded_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(600, 9000))
        one = np.unique(rng.integers(0, 2**64, n, np.uint64))
        other = np.unique(np.concatenate([one[rng.random(len(one)) < rng.random()], rng.integers(0, 2**64, int(rng.integers(600, 9000)), np.uint64)]))
        assert simhash.parity_distance(simhash.long_parity(one), simhash.long_parity(other)) <= len(np.setxor1d(one, other))
    assert simhash.long_parity(one[:512]) is None and len(simhash.long_parity(one[:513])) == 128

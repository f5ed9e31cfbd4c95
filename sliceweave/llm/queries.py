"""The registered queries of the operators, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sliceweave.llm import ann, bpe, decontaminate, html_extract, identifiers, license_scan, merkle, sharding, simhash, spelling, token_counts, token_output, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Longest context, in tokens, that a document may fill.
TOKEN_LIMIT = 4096


@query
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query
def op10_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.encode(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), decode=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    rows, made = decontaminate.scan(table(spark, folder, "documents"), table(spark, folder, "benchmark"), ["doc_id"])
    n_words, items = F.col(made["n_words"]), F.col(made["items"])
    return rows.select(
        "doc_id", n_words.alias("n_words"), decontaminate.hit_words(made).alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.is_contaminated(decontaminate.hit_words(made), n_words).alias("contaminated"))


#: Words by the rule of the window operators: A-Z in lower case, runs of ASCII letters, digits and other characters.
SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op9_decontamination"] = rf"""
WITH items AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {SQL_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {SQL_WORDS} AS w FROM documents),
places AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
found AS (
  SELECT p.r, p.i, p.n, v.item FROM (SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM places) p
  JOIN windows v ON p.win = v.win AND p.n = v.n),
hits AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM found) GROUP BY r),
lists AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS all_items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(all_items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN lists USING (r)"""


@query
def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan.scan(table(spark, folder, "documents"))
    return found.withColumns({name: F.array_join(name, ",") for name in ("base_labels", "labels")})


#: Shards of the registered query, and its seed.
SHARDS, SHARD_SEED = 8, 20


@query
def op7_proportional_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.interleave(table(spark, folder, "documents"), SHARDS, SHARD_SEED)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _sql_crc32() -> str:
    """CRC-32 of a text's bytes in SQL: one step per byte through a table that the rule (polynomial EDB88320) makes."""
    table_ = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table_.append(value)
    steps = f"lambda c, b: xor(c >> 8, ({table_}::BIGINT[])[1 + (xor(c, b) & 255)])"
    codes = "list_transform(regexp_extract_all(hex(x), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce({codes}, {steps}, 4294967295::BIGINT), 4294967295::BIGINT)"


ORACLES["op7_proportional_shards"] = f"""
WITH d AS (
  SELECT doc_id, source, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, encode(coalesce(text, '')) AS x,
    md5('{SHARD_SEED}:' || CAST(doc_id AS VARCHAR)) AS draw FROM documents),
r AS (SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY draw) - 1) / (2 * count(*) OVER (PARTITION BY source)) AS fraction FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, source, draw) - 1 AS position, count(*) OVER () AS total FROM r),
s AS (SELECT *, CAST(position * {SHARDS} // total AS BIGINT) AS shard FROM p)
SELECT doc_id, size, CAST({_sql_crc32()} AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(position - (shard * total + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s"""




@query
def op4_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, folder, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op5_wrapper_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract(table(spark, folder, "pages"))


@query
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = toxicity.fit(documents, table(spark, folder, "labels"))
    scored = toxicity.score(documents, model, ["doc_id"])
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score",
                         F.when(F.col("score") >= toxicity.TOXIC, 1).otherwise(0).alias("predicted"))


#: Key of the training order.
ORDER_KEY = 2025


@query
def op3_training_order(spark: SparkSession, folder: str) -> DataFrame:
    index, _ = token_output.materialise(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ORDER_KEY)
    return index


@query
def op8_learned_partitions(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"), 10)


@query
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verified(merkle.manifest(table(spark, folder, "documents")))


def _sql_field(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


def _sql_leaf(text: str) -> str:
    return f"sha256({' || '.join(_sql_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


#: Trees by recursion, level by level: the languages' own, then that of the subroots. ``side`` has the digests before and after a node.
ORACLES["op13_merkle_manifest"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang AS grp, {_sql_leaf('text')} AS leaf,
    CASE WHEN CAST({_sql_crc32().replace('hex(x)', "hex(encode(CAST(doc_id AS VARCHAR)))")} AS BIGINT) % 3 = 0 THEN {_sql_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d),
up AS (
  SELECT grp, 0 AS level, place, leaf AS digest, count(*) OVER (PARTITION BY grp) AS n FROM r
  UNION ALL
  SELECT grp, level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (any_value(n) + 7) // 8 FROM up WHERE n > 1 GROUP BY grp, level, place // 8),
sub AS (SELECT grp, digest AS subroot, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM up WHERE n = 1),
high AS (
  SELECT 0 AS level, place, subroot AS digest, n FROM sub
  UNION ALL
  SELECT level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (any_value(n) + 7) // 8 FROM high WHERE n > 1 GROUP BY level, place // 8),
root AS (SELECT digest AS root FROM high WHERE n = 1),
nodes AS (SELECT 1 AS tree, grp, level, place, digest, n FROM up UNION ALL SELECT 2, NULL, level, place, digest, n FROM high),
side AS (
  SELECT tree, grp, level, place, coalesce(string_agg(digest, '' ORDER BY place) OVER (PARTITION BY tree, grp, level, place // 8 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '' ORDER BY place) OVER (PARTITION BY tree, grp, level, place // 8 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM nodes WHERE n > 1),
steps AS (
  SELECT r.doc_id, r.leaf, r.grp, r.place AS spot, 1 AS tree, s.level, s.before, s.after FROM r JOIN side s ON s.tree = 1 AND s.grp IS NOT DISTINCT FROM r.grp AND s.place = r.place // CAST(pow(8, s.level) AS BIGINT)
  UNION ALL
  SELECT r.doc_id, r.leaf, r.grp, r.place, 2, s.level, s.before, s.after FROM r JOIN sub ON sub.grp IS NOT DISTINCT FROM r.grp JOIN side s ON s.tree = 2 AND s.place = sub.place // CAST(pow(8, s.level) AS BIGINT)),
paths AS (
  SELECT grp, spot, list([before, after] ORDER BY tree, level) AS path, sha256(string_agg(before || after, '' ORDER BY tree, level)) AS proof FROM steps GROUP BY grp, spot)
SELECT r.doc_id, r.leaf, sub.subroot, root.root, coalesce(p.proof, sha256('')) AS proof_sha256,
  list_reduce(list_prepend(coalesce(r.other, r.leaf), list_transform(coalesce(p.path, []), lambda s: s[1] || '|' || s[2])), lambda c, s: sha256(split_part(s, '|', 1) || c || split_part(s, '|', 2))) AS folded_root,
  folded_root = root.root AS verified
FROM r JOIN sub ON sub.grp IS NOT DISTINCT FROM r.grp CROSS JOIN root LEFT JOIN paths p ON p.grp IS NOT DISTINCT FROM r.grp AND p.spot = r.place"""


@query
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


#: Near words meet under what is left after one letter is taken away: at the same place (replaced), or of the longer word (inserted).
ORACLES["op12_spelling_variants"] = rf'''
WITH RECURSIVE runs AS (
  SELECT run, count(*) AS n, CAST(doc_id AS VARCHAR) AS id FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, n, CAST({_sql_crc32().replace('hex(x)', "hex(encode(coalesce(id, '') || ':' || run))")} AS BIGINT) AS h FROM runs),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT l.word, w.word FROM less l JOIN words w ON w.word = l.rest
  UNION SELECT w.word, l.word FROM less l JOIN words w ON w.word = l.rest),
best AS (
  SELECT near.word, count(*) AS n_near, first(other ORDER BY w.n DESC, other) AS best, max(w.n) AS best_n
  FROM near JOIN words w ON w.word = near.other GROUP BY near.word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best END AS form, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL'''


@query
def op11_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    rows, made = identifiers.find(table(spark, folder, "documents"), ["doc_id"])
    base = F.col(made["base"])
    return rows.select("doc_id", *[identifiers.count(base, kind).alias(f"n_{kind}") for kind in identifiers.KINDS],
                       F.sha2(identifiers.as_text(base).cast("binary"), 256).alias("base_sha256"), identifiers.as_text(F.col(made["all"])).alias("spans"))

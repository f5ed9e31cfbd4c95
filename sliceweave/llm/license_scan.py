"""License scans by diagonal voting.

Every k-gram of a document's words is joined by its hash with the places where it stands in license templates. A hit
votes for the diagonal ``document position - template position``: the words of one occurrence share a diagonal.
Neighbouring diagonals (words added or left out) are merged, and each merged span is verified by the share of the
template's k-grams that it really holds, in words and not only in hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words in a k-gram; no template may be shorter.
K = 3
#: Diagonals this near to each other are one occurrence with words added or left out.
NEAR = 3
#: Share of a template's k-grams that a span must hold.
COVERAGE = 0.6
# Phrases that count as places, by label.
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}
# Well-known sentences of public licenses, by label, lower case without signs.
SENTENCES = {
    "agpl-3": "you should have received a copy of the gnu affero general public license along with this program",
    "apache-2": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "gpl": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl": "under the terms of the gnu lesser general public license as published by the free software foundation",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "reserved": "all rights reserved no part of this publication may be reproduced",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text: A-Z in lower case, cut at ASCII characters other than letters and digits.

    ``lower`` changes other letters as well. That neither adds nor removes words, and only the Kelvin sign turns into an
    ASCII letter; it is put aside first, so ASCII words come out exactly.
    """
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Å")))
    return F.array_remove(F.split(plain, _NOT_WORD), "")


def template_grams(spark, phrases: dict[str, str] = PHRASES, sentences: dict[str, str] = SENTENCES, k: int = K) -> DataFrame:
    """One row per place in a template; a few hundred in all, bounded by the two tables."""
    rows = []
    for base, table in ((True, phrases), (False, sentences)):
        for number, (label, sentence) in enumerate(sorted(table.items())):
            parts = sentence.split()
            if len(parts) < k:
                raise ValueError(f"a template needs {k} words: {sentence!r}")
            name = f"{'base' if base else 'text'}{number}"
            rows += [(name, label, base, i, len(parts) - k + 1, parts[i:i + k]) for i in range(len(parts) - k + 1)]
    return spark.createDataFrame(rows, "template string, label string, base boolean, place int, places int, gram array<string>")


def grams(df: DataFrame, k: int = K) -> DataFrame:
    """Every k-gram of ``words`` with its position; k columns ``w0``, ``w1``, ..."""
    n = F.size("words")
    parts = [F.slice("words", i + 1, F.greatest(n - (k - 1), F.lit(0))).alias(f"w{i}") for i in range(k)]
    zipped = df.withColumn("_grams", F.arrays_zip(*parts)).drop("words")
    return zipped.select(*[F.col(c) for c in zipped.columns if c != "_grams"], F.posexplode("_grams").alias("at", "_gram")).select(
        *[F.col(c) for c in zipped.columns if c != "_grams"], F.col("at"), *[F.col(f"_gram.w{i}").alias(f"w{i}") for i in range(k)])


def occurrences(df: DataFrame, k: int = K, near: int = NEAR, coverage: float = COVERAGE, phrases: dict[str, str] = PHRASES,
                sentences: dict[str, str] = SENTENCES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Verified spans: ``id``, ``digest`` (of the text), ``template``, ``label``, ``base``, ``first_word``, ``last_word``
    (of the span, from 0) and ``share`` (of the template that it holds).

    Null and empty texts have none. Equal rows give their spans once; rows that share an id but not the text are kept
    apart by the digest. Phrases (``base``) must stand whole on one diagonal; sentences may hold changes.
    """
    template = template_grams(df.sparkSession, phrases, sentences, k)
    for i in range(k):
        template = template.withColumn(f"t{i}", F.col("gram")[i])
    template = F.broadcast(template.withColumn("hash", F.xxhash64(*[f"t{i}" for i in range(k)])).drop("gram"))
    docs = df.select(F.col(f"`{id_column}`").alias("id"), F.md5(F.col(f"`{text_column}`").cast("binary")).alias("digest"),
                     words(F.col(f"`{text_column}`")).alias("words"))
    same = F.lit(True)
    for i in range(k):
        same = same & (F.col(f"w{i}") == F.col(f"t{i}"))
    hits = grams(docs, k).join(template, (F.xxhash64(*[f"w{i}" for i in range(k)]) == F.col("hash")) & same)
    group = ["id", "digest", "template", "label", "base", "places"]
    votes = hits.groupBy(*group, (F.col("at") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("held"))
    # Phrases keep their diagonals apart: each is one exact place.
    over = Window.partitionBy("id", "digest", "template").orderBy("diagonal")
    gap = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(over), F.lit(0))
    votes = votes.withColumn("_new", F.when(F.col("base") | (gap > near), 1).otherwise(0))
    votes = votes.withColumn("_span", F.sum("_new").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    first, last = F.col("diagonal") + F.array_min("held"), F.col("diagonal") + F.array_max("held") + (k - 1)
    spans = votes.groupBy(*group, "_span").agg(
        F.array_distinct(F.flatten(F.collect_set("held"))).alias("held"), F.min(first).alias("first_word"), F.max(last).alias("last_word"))
    spans = spans.withColumn("share", F.size("held") / F.col("places"))
    kept = F.when(F.col("base"), F.size("held") == F.col("places")).otherwise(F.col("share") >= coverage)
    return spans.where(kept).select("id", "digest", "template", "label", "base", F.col("first_word").cast("long"), F.col("last_word").cast("long"), "share")


def scan(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """Per input row: ``id_column``, ``n_words``, ``n_base`` (places of whole phrases), ``first_word`` and ``last_word``
    (smallest and largest start of these), ``base_labels``, ``labels`` (arrays, sorted) and ``score`` (largest share).

    Rows without a span have counts and score 0, empty arrays and null positions; so have null and empty texts.
    Null and repeated ids keep their rows. An empty table gives an empty result.
    """
    spans = occurrences(df, id_column=id_column, text_column=text_column, **options)
    base = F.col("base")
    found = spans.groupBy("id", "digest").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        F.sort_array(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        F.sort_array(F.collect_set("label")).alias("labels"), F.max("share").alias("score"),
    ).withColumnsRenamed({"id": "_id", "digest": "_digest"})
    rows = df.select(F.col(f"`{id_column}`").alias("id"), F.md5(F.col(f"`{text_column}`").cast("binary")).alias("digest"),
                     F.size(words(F.col(f"`{text_column}`"))).cast("long").alias("n_words"))
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("_id")) & F.col("digest").eqNullSafe(F.col("_digest")), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        F.col("id").alias(id_column), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))

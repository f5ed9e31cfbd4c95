"""Benchmark decontamination by broadcast sets of normalised n-grams.

Every window of ``size`` consecutive words of a benchmark item (or the whole of a shorter one) is a key. Documents are
scanned in place: their words become numbers of the benchmark's vocabulary, the hash of every window is looked up, each
hit is verified word by word, and all words inside an occurrence are marked. No document is shuffled.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceweave.llm.common import Shared, fresh, map_rows, words_of

#: Words in a window.
SIZE = 13
#: Windows broadcast at once (below 60 MB). A larger benchmark is scanned in several blocks of this size.
BLOCK = 400_000


def item_windows(items: DataFrame, size: int = SIZE, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """Distinct (``window``, ``item``) of all items: words joined by a space. Items without words have none."""
    def run(texts: pa.Array) -> dict:
        out = []
        for text in texts.to_pylist():
            words = words_of(text)
            n = min(size, len(words))
            out.append(list({b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)}) if n else [])
        return {"windows": out}

    made = map_rows(items.where(F.col(f"`{text_column}`").isNotNull()), [text_column], "windows array<binary>", run, [id_column])
    return made.select(F.explode("windows").alias("window"), F.col(f"`{id_column}`").cast("string").alias("item")).distinct()


class WindowSet:
    """Windows as numbers of their words, found by hash and verified exactly."""

    def __init__(self, pairs: list[tuple[bytes, str | None]]):
        by_window: dict[bytes, list[str]] = {}
        for window, item in pairs:
            by_window.setdefault(window, []).extend([item] if item is not None else [])
        split = [w.split(b" ") for w in by_window]
        self.number = {word: i for i, word in enumerate(sorted({w for words in split for w in words}))}
        items = list(by_window.values())
        self.lengths: list[tuple[int, np.ndarray, np.ndarray, list[list[str]], int]] = []
        for length in sorted({len(words) for words in split}):
            at = [i for i, words in enumerate(split) if len(words) == length]
            rows = np.array([[self.number[w] for w in split[i]] for i in at], np.int64)
            factor = 0x9E3779B97F4A7C15
            while len(np.unique(hashes := window_hashes(rows.T, factor))) < len(rows):
                factor += 2  # another factor until no two windows share a hash
            order = np.argsort(hashes)
            self.lengths.append((length, hashes[order], rows[order], [items[at[i]] for i in order], factor))

    def scan(self, texts: list[str | None]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
        """Words, spans of hit words (merged, end exclusive) and hit items of each text."""
        get, numbers, counts = self.number.get, [], []
        for text in texts:
            words = words_of(text)
            counts.append(len(words))
            numbers.append(np.fromiter(map(get, words, repeat(-1)), np.int64, len(words)))
            numbers.append(np.array([-1]))  # no window crosses two texts
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        found: list[set[str]] = [set() for _ in texts]
        ids = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        begins = np.cumsum([0, *[n + 1 for n in counts]])
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        marks = np.zeros(len(ids) + 1, np.int64)
        for length, hashes, rows, items, factor in self.lengths:
            if len(ids) < length:
                continue
            at = np.flatnonzero(unknown[length:] == unknown[:-length])
            got = window_hashes([ids[at + k] for k in range(length)], factor)
            where = np.minimum(np.searchsorted(hashes, got), len(hashes) - 1)
            same = hashes[where] == got
            at, where = at[same], where[same]
            exact = np.all(ids[at[:, None] + np.arange(length)] == rows[where], axis=1)
            at, where = at[exact], where[exact]
            np.add.at(marks, at, 1)
            np.add.at(marks, at + length, -1)
            for doc, window in set(zip((np.searchsorted(begins, at, "right") - 1).tolist(), where.tolist())):
                found[doc].update(items[window])
        inside = np.concatenate([[0], np.cumsum(marks)[:-1] > 0, [0]]).astype(np.int8)
        edges = np.diff(inside)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        for doc, a, b in zip((np.searchsorted(begins, starts, "right") - 1).tolist(), starts.tolist(), ends.tolist()):
            spans[doc].append((a - int(begins[doc]), b - int(begins[doc])))
        return counts, spans, found


def window_hashes(columns, factor: int) -> np.ndarray:
    """Polynomial hash, modulo 2^64, of the numbers in each place of equally long columns."""
    total = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        total = total * np.uint64(factor & (2**64 - 1)) + column.astype(np.uint64) + np.uint64(1)
    return total


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(df: DataFrame, items: DataFrame, keep: list[str], size: int = SIZE, text_column: str = "text", item_column: str = "item_id",
         item_text_column: str = "text", block: int = BLOCK) -> tuple[DataFrame, dict[str, str]]:
    """Columns ``keep`` of ``df`` and, under names that the result gives, what was found in every whole text:

    ``n_words``, ``starts`` and ``ends`` (spans of hit words, ends exclusive, merged), ``n_hit`` (words in them) and
    ``items`` (ids of the items with an occurring window, as text, sorted).

    One row per input row, ids are not looked at. A null or empty text has no words. Items without words and an empty
    benchmark hit nothing; an item whose id is null marks words but is not listed; repeated items count once.
    The windows are counted first; beyond ``block`` of them the rows pass through several scans, one block each.
    """
    windows = item_windows(items, size, item_column, item_text_column).persist()
    blocks = max(1, -(-windows.count() // block))
    made = {name: fresh(df, name) for name in ("n_words", "starts", "ends", "items")}
    rows = df.select(*[F.col(f"`{k}`") for k in dict.fromkeys([*keep, text_column])])
    empty = {"n_words": F.lit(0).cast("long"), "starts": F.array().cast("array<long>"), "ends": F.array().cast("array<long>"), "items": F.array().cast("array<string>")}
    rows = rows.select("*", *[column.alias(made[name]) for name, column in empty.items()])
    for i in range(blocks):
        part = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == i)
        shared = Shared(df.sparkSession, "windows", WindowSet([(bytes(r["window"]), r["item"]) for r in part.collect()]))

        def run(texts, starts, ends, old, shared=shared) -> dict:
            counts, spans, found = shared.get(lambda value: value).scan(texts.to_pylist())
            spans = [merged([*s, *zip(a, b)]) for s, a, b in zip(spans, starts.to_pylist(), ends.to_pylist())]
            return {made["n_words"]: counts, made["starts"]: [[a for a, _ in s] for s in spans], made["ends"]: [[b for _, b in s] for s in spans],
                    made["items"]: [sorted(f.union(o)) for f, o in zip(found, old.to_pylist())]}

        last = i == blocks - 1
        rows = map_rows(rows, [text_column, made["starts"], made["ends"], made["items"]],
                        f"`{made['n_words']}` long, `{made['starts']}` array<long>, `{made['ends']}` array<long>, `{made['items']}` array<string>",
                        run, keep if last else list(dict.fromkeys([*keep, text_column])), shared)
    windows.unpersist()
    return rows, made


def hit_words(made: dict[str, str]) -> Column:
    """Words inside the spans of ``scan``."""
    total = lambda name: F.aggregate(F.col(made[name]), F.lit(0).cast("long"), lambda a, x: a + x)
    return total("ends") - total("starts")


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """Hit words are at least a twentieth of all."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def clean_documents(df: DataFrame, items: DataFrame, text_column: str = "text", **options) -> DataFrame:
    """All columns of the documents that are not contaminated; their texts stay as they are."""
    rows, made = scan(df, items, df.columns, text_column=text_column, **options)
    return rows.where(~is_contaminated(hit_words(made), F.col(made["n_words"]))).select(*[F.col(f"`{c}`") for c in df.columns])

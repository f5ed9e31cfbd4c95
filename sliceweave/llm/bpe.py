"""Exact byte-level BPE by backtracking over longest token matches, and decoding by an offset table.

The token ids of the vocabulary are in merge order. A sequence of tokens is the BPE encoding of its bytes
exactly when every pair of neighbours is *compatible*: the two tokens' bytes together encode as these two
tokens. The encoder takes the longest vocabulary match at each position (one Aho-Corasick pass finds them),
falls back to shorter prefixes while a pair is not compatible, and marks dead ends so that no position is
tried twice; so the work is linear in the length of a pre-token.
"""

from __future__ import annotations

import json
import re
import struct
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sliceweave.llm.common import Shared, map_rows

# The public pre-token pattern of this vocabulary, for any text and for texts of ASCII alone.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Pre-tokens a worker keeps with their ids, and the longest kept; only memory depends on them.
KEEP_PIECES, KEEP_LENGTH = 800_000, 64
#: Marks, by hash, of pre-tokens that were met once: with marks only those met again are kept, as most never are.
MARKS = 1 << 22


def byte_letters() -> dict[str, int]:
    """Letter that stands for each byte in a byte-level vocabulary: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Vocabulary, merges and special strings of a byte-level BPE tokenizer file. Small and picklable."""

    def __init__(self, text: str):
        parsed = json.loads(text)
        letters = byte_letters()
        vocab = parsed["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.tokens[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.parts: dict[int, tuple[int, int]] = {}
        last = -1
        for merge in parsed["model"]["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            made = vocab[left + right]
            if made <= last:
                raise ValueError("token ids must follow the order of merges")
            self.parts[made] = (vocab[left], vocab[right])
            last = made
        base = [i for i, t in enumerate(self.tokens) if len(t) == 1 and i not in self.parts]
        if any(max(parts) >= made for made, parts in self.parts.items()) or len(base) != 256:
            raise ValueError("every merge must join older tokens, over all 256 bytes")

    @classmethod
    def load(cls, path: str) -> "ByteBpe":
        with open(path, encoding="utf-8") as file:
            return cls(file.read())


class BpeEncoder:
    """Encoder and decoder of one process."""

    def __init__(self, bpe: ByteBpe, marks: int = 0):
        self.bpe, tokens = bpe, bpe.tokens
        self.merged = {pair: made for made, pair in bpe.parts.items()}
        self._right, self._left = {}, {}
        self._compatible: dict[int, bool] = {}
        special = set(bpe.special.values())
        self.reachable = {i for i, t in enumerate(tokens) if t and i not in special and (i not in bpe.parts or self.compatible(*bpe.parts[i], join=True))}
        self.ids = {tokens[i]: i for i in self.reachable}
        self.length = [len(t) for t in tokens]
        self.shorter = [-1] * len(tokens)
        for i in self.reachable:
            cut = len(tokens[i]) - 1
            while cut and tokens[i][:cut] not in self.ids:
                cut -= 1
            if cut:
                self.shorter[i] = self.ids[tokens[i][:cut]]
        self.matches = ahocorasick.Automaton()
        for i in self.reachable:
            self.matches.add_word(tokens[i].decode("latin-1"), i)
        self.matches.make_automaton()
        self._find = regex.compile(PATTERN).findall
        self._find_ascii = re.compile(ASCII_PATTERN, re.ASCII).findall
        self._cut = re.compile("|".join(re.escape(s) for s in sorted(bpe.special, key=len, reverse=True)) or r"(?!)")
        self.memo = _Memo(self, marks)

    def _spine(self, token: int, side: int, kept: dict) -> list[tuple[int, int]]:
        """Tokens that stand at one edge while ``token`` is merged, each with the id that ends it."""
        if token not in kept:
            spine, ends = [], len(self.bpe.tokens)
            while True:
                spine.append((token_ := token if not spine else inner, ends))
                if token_ not in self.bpe.parts:
                    break
                inner, ends = self.bpe.parts[token_][side], token_
            kept[token] = spine
        return kept[token]

    def compatible(self, a: int, b: int, join: bool = False) -> bool:
        """True if no merge crosses the border of the two tokens. ``join`` leaves out the merge of the whole two.

        A merge of ``x`` (at the right edge of ``a``) and ``y`` (at the left edge of ``b``) happens if it comes before
        both are merged inside their own token. Equal merges are done from the left, hence ``<`` and ``<=``.
        """
        key = a << 20 | b
        known = None if join else self._compatible.get(key)
        if known is None:
            known, find = True, self.merged.get
            for x, x_ends in self._spine(a, 1, self._right):
                for y, y_ends in self._spine(b, 0, self._left):
                    made = find((x, y))
                    if made is not None and made < x_ends and made <= y_ends and not (join and x == a and y == b):
                        known = False
            if not join:
                if len(self._compatible) > 2_000_000:
                    self._compatible.clear()
                self._compatible[key] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        n, length, shorter, known = len(piece), self.length, self.shorter, self._compatible.get
        longest = [-1] * n
        for end, token in self.matches.iter(piece.decode("latin-1")):
            longest[end + 1 - length[token]] = token  # matches come by their end, so the longest of a start comes last
        dead, out, at, token, last = set(), [], 0, longest[0], -1
        while at < n:
            while token >= 0:
                if at + length[token] not in dead:
                    fits = last < 0 or known(last << 20 | token)
                    if fits or fits is None and self.compatible(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                last, token = token, longest[at] if at < n else -1
            else:  # nothing fits here: this position is dead, go back and shorten the token before
                dead.add(at)
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
        return out

    def pieces(self, text: str) -> list[str]:
        return self._find_ascii(text) if text.isascii() else self._find(text)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        one = self.memo.__getitem__
        if not self.bpe.special or not any(s in text for s in self.bpe.special):
            return b"".join(map(one, self.pieces(text)))
        out, at = [], 0
        for hit in self._cut.finditer(text):
            out += map(one, self.pieces(text[at:hit.start()]))
            out.append(self.bpe.special[hit.group()].to_bytes(4, "little"))
            at = hit.end()
        out += map(one, self.pieces(text[at:]))
        return b"".join(out)

    @cached_property
    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array(self.length, dtype=np.int64)
        return np.frombuffer(b"".join(self.bpe.tokens), np.uint8), np.cumsum(sizes) - sizes, sizes

    def decode(self, ids: bytes) -> bytes:
        """Bytes of ids, gathered from one blob of all tokens by their offsets."""
        blob, starts, sizes = self._table
        token = np.frombuffer(ids, "<u4")
        size = sizes[token]
        ends = np.cumsum(size)
        shift = np.repeat(starts[token] - (ends - size), size)
        return blob[np.arange(len(shift)) + shift].tobytes()


class _Memo(dict):
    def __init__(self, encoder: BpeEncoder, marks: int):
        super().__init__()
        self.encoder, self.met = encoder, bytearray(marks)

    def __missing__(self, piece: str) -> bytes:
        found = self.encoder.encode_piece(piece.encode("utf-8", "surrogatepass"))
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= KEEP_LENGTH:
            if self.met and not self.met[mark := hash(piece) % len(self.met)]:
                self.met[mark] = 1
            else:
                if len(self) >= KEEP_PIECES:
                    self.clear()
                    self.met = bytearray(len(self.met))
                self[piece] = ids
        return ids


def encode(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", decode: bool = False) -> DataFrame:
    """Token ids of every whole text: ``id_column``, ``n_tokens``, ``ids`` (binary, little-endian unsigned 32 bit)
    and, with ``decode``, ``decoded``: the text that these ids decode to.

    One row per input row, in a narrow stage without a shuffle. A null or empty text has no ids and decodes to the
    empty text; null and repeated ids stay as they are; other columns of the input are left out. ``path`` is read on
    the driver, and the tables (about 1 MB, bounded by the vocabulary) are broadcast. Special strings inside a text
    become their own id, as the library does by default.
    """
    shared = Shared(df.sparkSession, "bpe", ByteBpe.load(path))

    def run(texts: pa.Array) -> dict:
        encoder = shared.get(lambda value: BpeEncoder(value, MARKS))
        ids = [encoder.encode(text) for text in texts.to_pylist()]
        out = {"n_tokens": [len(x) // 4 for x in ids], "ids": ids}
        if decode:
            out["decoded"] = [encoder.decode(x).decode("utf-8", "replace") for x in ids]
        return out

    return map_rows(df, [text_column], "n_tokens long, ids binary" + ", decoded string" * decode, run, [id_column], shared)


def decode(df: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """Text of every row of token ids (null: empty text). Bytes that are not UTF-8 become the replacement sign."""
    shared = Shared(df.sparkSession, "bpe", ByteBpe.load(path))

    def run(ids: pa.Array) -> dict:
        encoder = shared.get(BpeEncoder)
        return {"decoded": [encoder.decode(x or b"").decode("utf-8", "replace") for x in ids.to_pylist()]}

    return map_rows(df, [ids_column], "decoded string", run, [id_column], shared)

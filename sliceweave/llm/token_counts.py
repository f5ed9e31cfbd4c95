"""Token counts of a piece (BPE with byte fallback) vocabulary by the whole-token shortcut.

The driver proves from the vocabulary alone where merges can never happen and which strings are one token:

* *Borders.* No piece has the space mark after another character, and a character that no longer piece contains
  merges with nothing. So a text falls apart at spaces and at such characters (line breaks among them), and the
  parts can be counted one by one.
* *Whole tokens.* A piece that its own merges rebuild is one token wherever it is a whole part.

Matching parts count 1 directly; only the rest is merged.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from sliceweave.llm.common import Shared, map_rows

SPACE = "▁"
#: Parts a worker keeps with their counts, and the longest kept; only memory depends on them.
KEEP_PARTS, KEEP_LENGTH = 800_000, 64


class Pieces:
    """Pieces and merge order of a model file, with the two proofs. Small and picklable."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in normal}
        if any(SPACE in piece.lstrip(SPACE) for piece in self.score):
            raise ValueError("a piece crosses a word border; its texts do not fall apart at spaces")
        if "".join(model.encode(" a  b ", out_type=str)) != SPACE * 2 + "a" + SPACE * 2 + "b" + SPACE:
            raise ValueError("a vocabulary with a leading space mark, plain spaces and byte fallback is needed")
        inside = {c for piece in self.score if len(piece) > 1 for c in piece}
        #: ASCII characters that no longer piece contains: always tokens of their own.
        self.alone = "".join(sorted(c for c in map(chr, range(128)) if c not in inside and c != " "))
        self.whole = {piece for piece in self.score if len(piece) == 1 or merge(piece, self.score) == [piece]}


def merge(part: str, score: dict[str, float]) -> list[str]:
    """Merges of one part: the best scored pair first, the left one of equals."""
    return _merge_short(part, score) if len(part) <= 40 else _merge_long(part, score)


def _merge_short(part: str, score: dict[str, float]) -> list[str]:
    symbols, none = list(part), float("-inf")
    scores = [score.get(a + b, none) for a, b in zip(symbols, symbols[1:])]
    while scores and (best := max(scores)) > none:
        at = scores.index(best)
        symbols[at] += symbols.pop(at + 1)
        del scores[at]
        if at < len(scores):
            scores[at] = score.get(symbols[at] + symbols[at + 1], none)
        if at:
            scores[at - 1] = score.get(symbols[at - 1] + symbols[at], none)
    return symbols


def _merge_long(part: str, score: dict[str, float]) -> list[str]:
    """As the short form, in n log n."""
    symbols: list[str | None] = list(part)
    after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
    queue: list[tuple[float, int, str]] = []

    def offer(left: int) -> None:
        right = after[left]
        if right < len(symbols):
            pair = symbols[left] + symbols[right]
            if pair in score:
                heapq.heappush(queue, (-score[pair], left, pair))

    for i in range(len(part) - 1):
        offer(i)
    while queue:
        _, left, pair = heapq.heappop(queue)
        right = after[left]
        if symbols[left] is None or right >= len(symbols) or symbols[left] + symbols[right] != pair:
            continue  # one of the two has gone into another merge
        symbols[left], symbols[right] = pair, None
        after[left] = after[right]
        if after[left] < len(symbols):
            before[after[left]] = left
        if before[left] >= 0:
            offer(before[left])
        offer(left)
    return [s for s in symbols if s is not None]


class _Counts(dict):
    """Count of each part seen. ``mark`` stands before every part."""

    def __init__(self, pieces: Pieces, mark: str):
        super().__init__()
        self.pieces, self.mark = pieces, mark

    def __missing__(self, part: str) -> int:
        whole = self.mark + part.replace(" ", SPACE)
        if whole in self.pieces.whole:
            count = 1
        else:
            score = self.pieces.score
            count = sum(1 if s in score else len(s.encode("utf-8", "surrogatepass")) for s in merge(whole, score))
        if len(part) <= KEEP_LENGTH:
            if len(self) >= KEEP_PARTS:
                self.clear()
            self[part] = count
        return count


class Counter:
    """Counts tokens of whole texts in one process."""

    def __init__(self, pieces: Pieces):
        self.spaced, self.bare = _Counts(pieces, SPACE), _Counts(pieces, "")
        self._alone = re.compile("[" + re.escape(pieces.alone) + "]") if pieces.alone else None
        self._runs = re.compile(r" *[^ ]+| +")

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(SPACE, " ")
        total, first = 0, True
        if self._alone is None:
            lines = [text]
        else:
            lines = self._alone.split(text)
            total += len(lines) - 1
        spaced, bare = self.spaced.__getitem__, self.bare.__getitem__
        for line in lines:
            if first:  # the vocabulary puts one space before a text
                line, first = " " + line, False
            if not line:
                continue
            parts = line.split(" ")
            if "" in parts[1:]:  # several spaces in a row belong together
                for run in self._runs.findall(line):
                    total += spaced(run[1:]) if run[0] == " " else bare(run)
            else:
                total += sum(map(spaced, parts[1:]))
                if parts[0]:
                    total += bare(parts[0])
        return total


def count_tokens(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every whole text, as the model at ``path`` encodes it.

    One row per input row, without a shuffle. Null and empty texts count 0 bytes and 0 tokens; null or repeated ids
    stay; other columns are left out. The model is read on the driver and its pieces (bounded by the vocabulary,
    about 1 MB) are broadcast.
    """
    shared = Shared(df.sparkSession, "pieces", Pieces(path))

    def run(texts: pa.Array) -> dict:
        counter = shared.get(Counter)
        return {"n_bytes": pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), "n_tokens": [counter.count(t) for t in texts.to_pylist()]}

    return map_rows(df, [text_column], "n_bytes long, n_tokens long", run, [id_column], shared)

"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters as a word vector beside the mean of vectors of its character n-grams (so that unknown and misspelt
words are read by their letters). A forward and a backward gated unit run over a window of words, attention weighs
their states, and a logistic unit scores the window. A document's score is that of its most toxic window, over all
overlapping windows of its whole text.

The gates read the word alone (as in minimal recurrent units whose gates do not read the state): what a word does to a
state, its move, is computed once per distinct word, and a step of a window is one multiplication and one addition.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceweave.llm.common import Shared, fresh, map_rows, words_of

#: Words in a window, from one window's start to the next, and the same between the windows that are learnt from.
WINDOW, STEP, TRAIN_STEP = 48, 1, 38
#: Bound of the training sample: labelled documents, and windows of each (evenly spread over longer ones).
TRAIN_DOCUMENTS, TRAIN_WINDOWS = 4000, 48
#: Words with a vector of their own, sizes of character n-grams, and buckets for them.
VOCABULARY, GRAMS, BUCKETS = 20_000, (3, 4, 5), 16_384
#: Sizes of the word vector, the character vector and each recurrent state.
WORD_SIZE, CHAR_SIZE, STATE = 12, 12, 8
#: Words a worker keeps with their inputs; only memory depends on it.
KEEP_WORDS = 120_000
#: Bytes of new words, or n-grams, that are read at once (a longer word alone); only memory depends on it.
READ_BYTES = 1 << 19
#: Score from which a document counts as toxic.
TOXIC = 0.3


def char_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of words with their borders, one word after the other, and how many each has."""
    marked = ("^" + "$^".join(word.decode("utf-8", "replace") for word in words) + "$").encode("utf-32-le", "surrogatepass")
    letters = np.frombuffer(marked, np.uint32)
    owner = np.cumsum(letters == ord("^"), dtype=np.int32) - 1
    buckets, owners, code = [], [], letters.copy()
    for n in range(2, max(GRAMS) + 1):
        code = code[:-1] * np.uint32(0x01000193) + letters[n - 1:]  # wraps around
        if n in GRAMS:
            inside = owner[:len(code)] == owner[n - 1:]
            mixed = (code[inside] ^ (code[inside] >> np.uint32(15))) * np.uint32(0x9E3779B1)
            buckets.append((mixed >> np.uint32(16)).astype(np.uint16) % np.uint16(BUCKETS))
            owners.append(owner[:len(code)][inside])
    flat, of = np.concatenate(buckets), np.concatenate(owners)
    return flat if len(words) == 1 else flat[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))


def window_starts(n: int, step: int = STEP) -> range:
    """Starts of overlapping windows that cover n words."""
    return range(0, max(1, n - WINDOW + step), step) if n else range(0)


class Lexicon(dict):
    """Numbers of words, given when first looked up; their word vector (0: unknown) and character n-grams, one after the other."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary = vocabulary
        self.vector, self.grams, self.ends = array("i"), array("H"), array("q", [0])

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found

    def settle(self) -> None:
        """Read the words that are new since the last call, about ``READ_BYTES`` at a time."""
        new = list(islice(self, len(self.vector), None))
        self.vector.extend(self.vocabulary.get(word, 0) for word in new)
        piece = np.cumsum([len(word) for word in new]) // READ_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(new)]
        for words in (new[a:b] for a, b in zip(cuts, cuts[1:]) if b > a):
            grams, sizes = char_grams(words)
            self.grams.frombytes(grams.tobytes())
            self.ends.frombytes((np.cumsum(sizes) + self.ends[-1]).astype(np.int64).tobytes())

    def grams_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of words given by number, one after the other, and how many each has."""
        ends = np.frombuffer(self.ends, np.int64)
        starts, sizes = ends[words], ends[words + 1] - ends[words]
        shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        return np.frombuffer(self.grams, np.uint16)[np.arange(len(shift)) + shift], sizes


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


def _char_means(table: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    if len(sizes) == 1:  # one word may be a whole long text
        return (np.bincount(flat, minlength=len(table)).astype(np.float32) @ table / np.float32(len(flat)))[None]
    return np.add.reduceat(table[flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None].astype(np.float32)


def _split(gates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What is kept of the state, what passes of the new value, and that value; (..., 2 * state): both directions."""
    of = gates.reshape(*gates.shape[:-1], 2, 3, STATE)
    keep, pass_, new = (np.ascontiguousarray(of[..., i, :]).reshape(*gates.shape[:-1], 2 * STATE) for i in range(3))
    return _sigmoid(keep), _sigmoid(pass_), np.tanh(new)


def _run(keep: np.ndarray, add: np.ndarray) -> np.ndarray:
    """States of both directions, from arrays (time, batch, 2 * state)."""
    h, states = STATE, np.empty_like(add)
    forth = back = np.zeros((add.shape[1], h), add.dtype)
    for t in range(len(add)):
        states[t, :, :h] = forth = keep[t, :, :h] * forth + add[t, :, :h]
    for t in range(len(add) - 1, -1, -1):
        states[t, :, h:] = back = keep[t, :, h:] * back + add[t, :, h:]
    return states


class Network:
    """Parameters, forward pass and gradients. Arrays are float32; ``p`` holds them by name."""

    def __init__(self, vocabulary: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        size, h = WORD_SIZE + CHAR_SIZE, STATE
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "word": draw(vocabulary + 1, WORD_SIZE, scale=0.1), "char": draw(BUCKETS, CHAR_SIZE, scale=0.3),
            "in": draw(size, 6 * h, scale=size**-0.5), "in_b": np.zeros(6 * h, np.float32),
            "att": draw(2 * h, scale=0.3), "out": draw(2 * h, scale=0.3), "out_b": np.full(1, -1.0, np.float32),
        }

    def gates(self, vector: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Gate inputs of both directions for words given by vector number and character mean."""
        return np.concatenate([self.p["word"][vector], chars], axis=1) @ self.p["in"] + self.p["in_b"]

    def moves_of(self, lexicon: Lexicon, first: int = 0, block: int = READ_BYTES) -> np.ndarray:
        """Moves of the words of ``lexicon`` from number ``first`` on (4 * state each), read by about ``block`` n-grams."""
        lexicon.settle()
        out = np.empty((len(lexicon) - first, 4 * STATE), np.float32)
        piece = np.array(lexicon.ends[first + 1:], np.int64) // block
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(piece)]
        for words in (np.arange(first + a, first + b) for a, b in zip(cuts, cuts[1:]) if b > a):
            gates = self.gates(np.frombuffer(lexicon.vector, np.int32)[words], _char_means(self.p["char"], *lexicon.grams_of(words)))
            keep, pass_, new = _split(gates)
            out[words - first] = np.concatenate([keep, (1 - keep) * pass_ * new], axis=1)
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logit, attention weights and pooled state of each window from its states (time, batch, 2 * state)."""
        score = np.where(mask > 0, states @ self.p["att"], np.float32(-1e9))
        weight = np.exp(score - score.max(axis=0)) * (mask > 0)
        weight /= np.maximum(weight.sum(axis=0), np.float32(1e-9))
        pooled = np.einsum("tb,tbh->bh", weight, states)
        return pooled @ self.p["out"] + self.p["out_b"], weight, pooled

    def forward(self, gates: Callable[[int], np.ndarray], mask: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """Logit of each window. ``gates(t)`` is (batch, 6 * state), ``mask`` (time, batch) is 1 on words."""
        m = mask[:, :, None]
        keep, pass_, new = _split(np.stack([gates(t) for t in range(len(mask))]))
        hold = 1 - m * (1 - keep)
        states = _run(hold, (1 - hold) * pass_ * new)
        logit, weight, pooled = self.pool(states, mask)
        if trace is not None:
            trace.update(moves=(keep, pass_, new, hold), states=states, weight=weight, pooled=pooled, mask=mask)
        return logit

    def gradients(self, trace: dict, d_logit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters behind the gates, and of the gates, for ``d_logit`` of each window."""
        p, h = self.p, STATE
        states, weight, m = trace["states"], trace["weight"], trace["mask"][:, :, None]
        keep, pass_, new, hold = trace["moves"]
        g = {"out": trace["pooled"].T @ d_logit, "out_b": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"]
        d_weight = np.einsum("bh,tbh->tb", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["att"] = np.einsum("tb,tbh->h", d_score, states)
        d_states = weight[:, :, None] * d_pooled + d_score[:, :, None] * p["att"]
        before = np.zeros_like(states)
        before[1:, :, :h], before[:-1, :, h:] = states[:-1, :, :h], states[1:, :, h:]
        for t in range(len(states) - 2, -1, -1):
            d_states[t, :, :h] += hold[t + 1, :, :h] * d_states[t + 1, :, :h]
        for t in range(1, len(states)):
            d_states[t, :, h:] += hold[t - 1, :, h:] * d_states[t - 1, :, h:]
        added = d_states * m * (1 - keep)
        parts = [added * keep * (before - pass_ * new), added * new * pass_ * (1 - pass_), added * pass_ * (1 - new**2)]
        return g, np.concatenate([part[:, :, at:at + h] for at in (0, h) for part in parts], axis=2)


class Adam:
    def __init__(self, parameters: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = parameters, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in parameters.items()}
        self.v = {k: np.zeros_like(v) for k, v in parameters.items()}

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, d in g.items():
            self.m[k] += 0.1 * (d - self.m[k])
            self.v[k] += 0.01 * (d * d - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-6)


def _pack(windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers (time, batch), 0 where there is no word, and the mask."""
    ids, mask = np.zeros((WINDOW, len(windows)), np.int64), np.zeros((WINDOW, len(windows)), np.float32)
    for i, window in enumerate(windows):
        ids[:len(window), i] = window
        mask[:len(window), i] = 1
    return ids, mask


def train(documents: list[tuple[list[bytes], int]], epochs: int = 10, batch: int = 64, rate: float = 0.01, seed: int = 7,
          steps: int = 600) -> tuple[dict, Network]:
    """Fit on (windows, their words joined by a space; label 0 or 1) of each document; returns vocabulary and network.

    A document is learnt through one window an epoch: a random one at first, later its most toxic one. Few documents
    are gone through more often, until about ``steps`` batches are learnt.
    """
    counts: dict[bytes, int] = {}
    for windows, _ in documents:
        for word in set(b" ".join(windows).split(b" ")):
            counts[word] = counts.get(word, 0) + 1
    common = sorted((w for w, c in counts.items() if c > 2 and w), key=lambda w: (-counts[w], w))[:VOCABULARY]
    vocabulary = {w: i + 1 for i, w in enumerate(common)}
    counts.clear()
    network, lexicon, rng = Network(len(vocabulary), seed), Lexicon(vocabulary), np.random.default_rng(seed)
    flat, labels_of, first = [], [], [0]
    for windows, label in documents:
        if windows:
            flat += [np.fromiter(map(lexicon.__getitem__, window.split(b" ")), np.int32) for window in windows]
            labels_of.append(label)
            first.append(len(flat))
    if not flat:
        return vocabulary, network
    first, labels_of = np.array(first), np.array(labels_of, np.float32)
    lexicon.settle()
    vector = np.frombuffer(lexicon.vector, np.int32)
    optimizer = Adam(network.p, rate)
    epochs = max(epochs, min(4 * epochs, steps * batch // len(labels_of)))
    for epoch in range(epochs):
        optimizer.rate = rate * (1 - 0.8 * epoch / epochs)
        if epoch < 0.3 * epochs:
            chosen = first[:-1] + (rng.random(len(labels_of)) * np.diff(first)).astype(np.int64)
        else:
            logits = window_logits(network, network.moves_of(lexicon), flat)
            chosen = np.array([a + int(np.argmax(logits[a:b])) for a, b in zip(first[:-1], first[1:])])
        order = rng.permutation(len(labels_of))
        for at in range(0, len(order), batch):
            part = order[at:at + batch]
            ids, mask = _pack([flat[chosen[i]] for i in part])
            own, inverse = np.unique(ids, return_inverse=True)
            inverse = inverse.reshape(ids.shape)
            grams, sizes = lexicon.grams_of(own)
            chars = _char_means(network.p["char"], grams, sizes)
            words = np.where(rng.random(ids.shape) < 0.15, 0, vector[ids])  # some words are read by their letters only
            joined = np.concatenate([network.p["word"][words], chars[inverse]], axis=2)
            trace: dict = {}
            logit = network.forward((joined @ network.p["in"] + network.p["in_b"]).__getitem__, mask, trace)
            g, d_gates = network.gradients(trace, ((_sigmoid(logit) - labels_of[part]) / len(part)).astype(np.float32))
            g["in"] = np.einsum("tbx,tbg->xg", joined, d_gates)
            g["in_b"] = d_gates.sum(axis=(0, 1))
            d_joined = d_gates @ network.p["in"].T
            g["word"] = np.zeros_like(network.p["word"])
            np.add.at(g["word"], words, d_joined[:, :, :WORD_SIZE])
            d_chars = np.zeros_like(chars)
            np.add.at(d_chars, inverse, d_joined[:, :, WORD_SIZE:])
            spread = np.repeat(d_chars / sizes[:, None].astype(np.float32), sizes, axis=0)
            g["char"] = np.stack([np.bincount(grams, column, BUCKETS) for column in spread.T], axis=1).astype(np.float32)
            optimizer.step(g)
    return vocabulary, network


def window_logits(network: Network, moves: np.ndarray, windows: list[np.ndarray], batch: int = 512) -> np.ndarray:
    """Logits of windows of word numbers; ``moves`` has those of each word number."""
    h, out = STATE, np.empty(len(windows), np.float32)
    order = np.argsort([len(w) for w in windows], kind="stable")
    for at in range(0, len(order), batch):
        part = order[at:at + batch]
        ids, mask = _pack([windows[i] for i in part])
        ids, mask = ids[:len(windows[part[-1]])], mask[:len(windows[part[-1]])]
        move, m = moves[ids], mask[:, :, None]
        states = _run(np.where(m > 0, move[:, :, :2 * h], np.float32(1)), move[:, :, 2 * h:] * m)
        out[part] = network.pool(states, mask)[0]
    return out


def stream_logits(network: Network, moves: np.ndarray, numbers: np.ndarray, batch: int = 2048) -> np.ndarray:
    """Logits of every whole window (step 1) of a stream of word numbers.

    All windows of a batch take their t-th step together, on a slice of the stream that is shifted by t. Of a state
    only its share of the attention score and of the output is kept.
    """
    h, p = STATE, network.p
    out = np.empty(max(0, len(numbers) - WINDOW + 1), np.float32)
    heads = [np.ascontiguousarray(np.stack([p["att"][at:at + h], p["out"][at:at + h]])) for at in (0, h)]
    for at in range(0, len(out), batch):
        size = min(batch, len(out) - at)
        move = np.ascontiguousarray(moves[numbers[at:at + size + WINDOW - 1]].T)
        shares, product = np.zeros((WINDOW, 2, size), np.float32), np.empty((2, size), np.float32)
        for side in range(2):
            keep, add = move[h * side:h * (side + 1)], move[h * (side + 2):h * (side + 3)]
            state = np.zeros((h, size), np.float32)
            for t in range(WINDOW - 1, -1, -1) if side else range(WINDOW):
                state *= keep[:, t:t + size]
                state += add[:, t:t + size]
                shares[t] += np.matmul(heads[side], state, out=product)
        score, value = shares[:, 0], shares[:, 1]
        weight = np.exp(score - score.max(axis=0))
        out[at:at + size] = (weight * value).sum(axis=0) / weight.sum(axis=0) + p["out_b"]
    return out


class Scorer:
    """Scores whole texts in one process."""

    def __init__(self, model: tuple[dict, Network] | None):
        self.vocabulary, self.network = model or ({}, None)
        self._reset()

    def _reset(self) -> None:
        self.lexicon, self.known, self.moves = Lexicon(self.vocabulary), 0, np.empty((4096, 4 * STATE), np.float32)

    def _grow(self) -> None:
        """Moves of the words that are new since the last call."""
        size = len(self.lexicon)
        if size > len(self.moves):
            self.moves = np.concatenate([self.moves, np.empty((size, 4 * STATE), np.float32)])
        self.moves[self.known:size] = self.network.moves_of(self.lexicon, self.known)
        self.known = size

    def scores(self, texts: list[str | None], block: int = 16_384) -> list[float]:
        if self.network is None:
            return [0.0] * len(texts)
        none = float(_sigmoid(self.network.p["out_b"])[0])
        best, short, stream, whole = np.full(len(texts), -np.inf), [], [], []
        held = length = 0  # windows that wait, and words of the stream

        def flush() -> None:
            nonlocal held, length
            self._grow()
            if short:
                np.maximum.at(best, [i for i, _ in short], window_logits(self.network, self.moves, [window for _, window in short]))
            if whole:
                # Windows across two texts of the stream are left out here.
                logits = stream_logits(self.network, self.moves, np.concatenate(stream))[np.concatenate([starts for _, starts in whole])]
                np.maximum.at(best, np.repeat([i for i, _ in whole], [len(starts) for _, starts in whole]), logits)
            short.clear(), stream.clear(), whole.clear()
            held = length = 0
            if len(self.lexicon) > KEEP_WORDS:
                self._reset()

        for i, text in enumerate(texts):
            words = words_of(text)
            starts = window_starts(len(words))
            for a in range(0, len(starts), block):
                part = np.asarray(starts[a:a + block])
                begin = part[0]
                numbers = np.fromiter(map(self.lexicon.__getitem__, words[begin:part[-1] + WINDOW]), np.int64)
                if len(words) < WINDOW:
                    short.append((i, numbers))
                else:
                    stream.append(numbers)
                    whole.append((i, part - begin + length))
                    length += len(numbers)
                held += len(part)
                if held >= block:
                    flush()
        flush()
        return [none if logit == -np.inf else float(1 / (1 + np.exp(-logit))) for logit in best]


def held_out(id_column: str):
    """Rows that nothing is learnt from: the checksum of the id leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_column}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
        sample: int = TRAIN_DOCUMENTS) -> tuple[dict, Network] | None:
    """Model from at most ``sample`` labelled documents that are not held out, drawn by a digest of their id.

    Of rows that repeat an id, the text with the smallest digest is learnt from. Rows with a null id, label or text teach nothing. None if there are no rows to learn from.
    """
    known = labels.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{label_column}`").cast("int").alias("label")).where("id is not null and label is not null")
    known = known.where(~held_out("id")).withColumn("draw", F.xxhash64("id", F.lit("toxicity"))).orderBy("draw", "id", "label").limit(sample)
    texts = documents.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text_column}`").alias("text"))
    drawn = texts.where("text is not null").join(F.broadcast(known), F.col("_id") == F.col("id"))
    digest = F.struct(F.xxhash64("text").alias("digest"), "text")
    drawn = drawn.groupBy("id", "label").agg(F.min(digest).alias("first")).select("id", "label", "first.text")  # ``sample`` rows at most

    def cut(column: pa.Array) -> dict:
        out = []
        for text in column.to_pylist():
            words = words_of(text)
            starts = window_starts(len(words), TRAIN_STEP)
            if len(starts) > TRAIN_WINDOWS:
                starts = [starts[i * len(starts) // TRAIN_WINDOWS] for i in range(TRAIN_WINDOWS)]
            out.append([b" ".join(words[s:s + WINDOW]) for s in starts])
        return {"windows": out}

    rows = map_rows(drawn, ["text"], "windows array<binary>", cut, ["id", "label"]).orderBy("id", "label").toArrow()
    texts_, labels_ = rows.column("windows").to_pylist(), rows.column("label").to_pylist()
    documents_ = [(windows, int(label > 0)) for windows, label in zip(texts_, labels_) if windows]
    return train(documents_) if documents_ else None


def score(df: DataFrame, model: tuple[dict, Network] | None, keep: list[str], text_column: str = "text", name: str = "score") -> DataFrame:
    """Columns ``keep`` and the score, from 0 to 1, of every whole text.

    One row per input row, in a narrow stage; only the text is looked at. Null and empty texts, and texts without words,
    get the score of no evidence (the network's bias). Without a model all scores are 0.
    """
    shared = Shared(df.sparkSession, "toxicity", model)
    return map_rows(df, [text_column], f"`{name}` double", lambda texts: {name: shared.get(Scorer).scores(texts.to_pylist())}, keep, shared)


def clean_documents(df: DataFrame, model: tuple[dict, Network] | None, text_column: str = "text", limit: float = TOXIC) -> DataFrame:
    """All columns of the rows whose score is below ``limit``."""
    name = fresh(df, "score")
    return score(df, model, df.columns, text_column, name).where(F.col(name) < limit).select(*[F.col(f"`{c}`") for c in df.columns])

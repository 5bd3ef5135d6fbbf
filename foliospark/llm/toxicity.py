"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's characters go through one such network; its pooled state, with an embedding of the word, is the input of a
second one over a window of words, whose pooled state gives the window's logit.  Every window of `WINDOW` words is
scored, one word apart, and a text's score is its highest window.  The gates and states of both use
x / (1 + |x|) in place of the logistic and tangent curves, which costs a fifth.

Words are runs of letters and digits in lower case; a longer one than `PIECE` characters is read as overlapping pieces of
that length, half of it apart, so all its characters count wherever they stand.

Training, on the driver: at most `MOST_TOXIC` toxic and `MOST_CLEAN` clean labelled texts of at most `LONGEST` characters
(documented bounds; they are the rows with the smallest hash of doc_id, so any run on the same labels draws the
same).  First the character network learns words: those that many toxic and no clean texts hold against words of clean
texts, of which it looks through at most `LOOK` at a time for hard ones.  Then the word network learns windows:
of each toxic text one with its most suspicious word, of each clean text ones with its most suspicious and
random words, and half-way the windows that look worst so far.  Last, two numbers make the highest
window's logit a probability of the text.  The number of steps is fixed, so training costs the same
at any size.

Only the text is read for a score.  Nulls: a null text is the empty text, scored as one window of padding.  Rows
without label, doc_id or text take no part in training; with only one label present, the score is its share.  Repeated rows
are scored one by one, alike; of several labels of one doc_id any one is taken; ids pass as they are, of any type; extra columns
are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import table, through_python

WINDOW, PIECE = 8, 32
HIDDEN, WORD_HIDDEN, SYMBOLS, CHAR_DIM, BUCKETS, WORD_DIM = 8, 4, 96, 8, 4096, 4
MOST_TOXIC, MOST_CLEAN, LONGEST, LOOK = 1500, 4500, 16_384, 20_000
STEPS, BATCH = 250, 128
THRESHOLD = 0.3
F32 = np.float32
_WORD = re.compile(r"[^\W_]+")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return F32(0.5) * np.tanh(F32(0.5) * x) + F32(0.5)


def soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place."""
    x /= np.abs(x) + F32(1)
    return x


class Pooled:
    """A bidirectional gated recurrent layer with attention pooling.  Features come first, samples last, in all arrays."""

    def __init__(self, rng, inputs: int, hidden: int):
        w = lambda a, b: (rng.standard_normal((b, a)) / np.sqrt(a)).astype(F32)
        self.h = hidden
        self.p = {"x": w(inputs, 6 * hidden), "b": np.zeros((6 * hidden, 1), F32), "u0": w(hidden, 3 * hidden), "u1": w(hidden, 3 * hidden), "v": w(2 * hidden, 1)[0]}

    def project(self, x: np.ndarray) -> np.ndarray:
        """(inputs, n) to (6h, n): what both directions get of an input."""
        return self.p["x"] @ x + self.p["b"]

    def forward(self, steps: int, n: int, at, mask, keep: bool = False):
        """at(t, d): projections (3h, n) of step t for direction d; mask(t): (n,) of 0 and 1.  Returns (2h, n)."""
        h = self.h
        out, memo = np.empty((steps, 2 * h, n), F32), []
        for d in (0, 1):
            u, s = self.p[f"u{d}"], np.zeros((h, n), F32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                a, g = at(t, d), u @ s
                zr = soft(a[: 2 * h] + g[: 2 * h])
                zr *= F32(0.5)
                zr += F32(0.5)
                z, r = zr[:h], zr[h:]
                c = soft(a[2 * h :] + r * g[2 * h :])
                if keep:
                    memo.append((d, t, s, z, r, c, g[2 * h :]))
                s = s + (mask(t) * (F32(1) - z)) * (c - s)
                out[t, d * h : (d + 1) * h] = s
        e = np.stack([self.p["v"] @ out[t] + (mask(t) - F32(1)) * F32(30) for t in range(steps)])
        e = np.exp(e - e.max(0))
        e /= e.sum(0)
        pooled = np.zeros((2 * h, n), F32)
        for t in range(steps):
            pooled += e[t] * out[t]
        return (pooled, (steps, n, mask, out, e, memo)) if keep else pooled

    def backward(self, grad: np.ndarray, memo) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Gradient of the projections, (steps, 6h, n), and of the layer's own parameters."""
        steps, n, mask, out, e, trace = memo
        h, own = self.h, {k: np.zeros_like(v) for k, v in self.p.items()}
        d_e = (out * grad).sum(1)
        d_e = e * (d_e - (e * d_e).sum(0))
        own["v"] = np.einsum("tkn,tn->k", out, d_e)
        d_out = e[:, None] * grad + d_e[:, None] * self.p["v"][:, None]
        d_proj = np.zeros((steps, 6 * h, n), F32)
        slope = lambda y: (1 - np.abs(y)) ** 2  # noqa: E731  of soft, from its value
        for d in (0, 1):
            u, carry = self.p[f"u{d}"], np.zeros((h, n), F32)
            for k, t, s, z, r, c, g in reversed(trace):
                if k != d:
                    continue
                ds, m = carry + d_out[t, d * h : (d + 1) * h], mask(t)
                dz = -m * ds * (c - s) * slope(2 * z - 1) / 2
                dc = m * ds * (1 - z) * slope(c)
                dr = dc * g * slope(2 * r - 1) / 2
                d_proj[t, 3 * h * d : 3 * h * (d + 1)] = np.concatenate([dz, dr, dc])
                dg = np.concatenate([dz, dr, dc * r])
                own[f"u{d}"] += dg @ s.T
                carry = ds * (1 - m * (1 - z)) + u.T @ dg
        return d_proj, own


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def __call__(self, pairs: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.t += 1
        for k, (w, g) in pairs.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            v = self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * g * g
            w -= (self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)).astype(F32)


def words_in(text: str) -> list[str]:
    """The words of a text in lower case, long ones as overlapping pieces."""
    words = _WORD.findall(text.lower())
    if max(map(len, words), default=0) <= PIECE:
        return words
    half = PIECE // 2
    return [w[i : i + PIECE] for w in words for i in range(0, max(1, len(w) - half), half)]


def symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character numbers (0: none) of words, (longest, n), and how many each has."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    code = np.where((code >= 32) & (code < 31 + SYMBOLS), code - 31, 1 + code % (SYMBOLS - 1))
    out = np.zeros((max(1, int(size.max(initial=0))), len(words)), np.int64)
    ends = np.cumsum(size)
    out[np.arange(len(code)) - np.repeat(ends - size, size), np.repeat(np.arange(len(words)), size)] = code
    return out, size


class Network:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.char = Pooled(rng, CHAR_DIM, HIDDEN)
        self.word = Pooled(rng, 2 * HIDDEN + 1 + WORD_DIM, WORD_HIDDEN)
        self.letters = (rng.standard_normal((CHAR_DIM, SYMBOLS)) * 0.5).astype(F32)
        self.buckets = np.zeros((WORD_DIM, BUCKETS), F32)
        self.out = {"cw": np.zeros(2 * HIDDEN, F32), "cb": np.zeros(1, F32), "ww": np.zeros(2 * WORD_HIDDEN, F32), "wb": np.zeros(1, F32)}
        self.scale = 1.0, 0.0
        self.share: float | None = None  # of toxic texts, if there was nothing to tell apart
        self.clear()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("memo", "rows")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.clear()

    def clear(self):
        self.memo: dict[str, int] = {"": 0}
        self.rows = np.zeros((1 << 12, 6 * WORD_HIDDEN), F32)

    def _spell(self, words: list[str], keep: bool = False):
        """The character network over words."""
        at, size = symbols(words)
        halves = [np.ascontiguousarray(x) for x in np.split(self.char.project(self.letters), 2)]
        got = self.char.forward(len(at), len(words), lambda t, d: halves[d][:, at[t]], lambda t: (t < size).astype(F32), keep)
        return (*got, at) if keep else got

    def char_states(self, words: list[str]) -> np.ndarray:
        """(2h + 1, n): pooled states and suspicion of words."""
        out = np.zeros((2 * HIDDEN + 1, len(words)), F32)
        order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
        for i in range(0, len(words), 4096):  # words of like length together, so padding is short
            part = order[i : i + 4096]
            s = self._spell([words[k] for k in part])
            out[:-1, part], out[-1, part] = s, sigmoid(self.out["cw"] @ s + self.out["cb"])
        return out

    def inputs(self, words: list[str], states: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        bucket = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in words), np.int64, len(words))
        states = self.char_states(words) if states is None else states
        return np.concatenate([states, self.buckets[:, bucket]]), bucket

    # training

    def train(self, texts: list[str], toxic: list[int], steps: int = STEPS, seed: int = 4) -> Network:
        if len(set(toxic)) < 2:
            self.share = float(np.mean(toxic)) if toxic else 0.0
            return self
        rng = np.random.default_rng(seed)
        words = [words_in(t) for t in texts]
        held = [Counter(), Counter()]
        for ws, y in zip(words, toxic, strict=True):
            held[y].update(set(ws))
        n_toxic = sum(toxic)
        bad = sorted(w for w, n in held[1].items() if w and n >= max(3, n_toxic // 50) and not held[0][w])
        good = sorted(w for w in held[0] if w)
        if not bad:  # nothing is told by words alone: the words most over-represented
            odds = {w: (n + 0.5) / n_toxic / ((held[0][w] + 0.5) / (len(texts) - n_toxic)) for w, n in held[1].items() if w}
            bad = sorted(odds, key=lambda w: (-odds[w], w))[:20]
        if bad and good:
            self._train_words(bad, good, steps, rng)
        vocabulary = sorted({w for ws in words for w in ws})
        states, number = self.char_states(vocabulary), {w: k for k, w in enumerate(vocabulary)}
        ids = [np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)) for ws in words]
        windows: tuple[list, list] = ([], [])
        for own, y in zip(ids, toxic, strict=True):
            if len(own):
                suspects = np.argsort(-states[-1, own], kind="stable")[: 1 if y else 3]
                starts = [max(0, int(k) - int(rng.integers(0, WINDOW))) for k in suspects] + ([] if y else [int(rng.integers(0, len(own)))])
                windows[y].extend(own[s : s + WINDOW] for s in starts)
        windows[0].extend([np.zeros(0, np.int64)] * (1 + len(windows[0]) // 20))  # the window of a text without words is clean
        tune = Adam(0.01)
        self._train_windows(windows, vocabulary, states, steps, rng, tune)
        rows = self.word.project(self.inputs(vocabulary, states)[0])
        clean = [own for own, y in zip(ids, toxic, strict=True) if len(own) and not y]
        for own in clean:  # the clean windows that look worst so far, each once more
            k = int(self._windows([own], rows)[1].argmax())
            windows[0].append(own[k : k + WINDOW])
        self._train_windows(windows, vocabulary, states, steps, rng, tune)
        rows = self.word.project(self.inputs(vocabulary, states)[0])
        self._calibrate(np.array([self._windows([own], rows)[1].max() for own in ids], np.float64), np.array(toxic, np.float64))
        self.clear()
        return self

    def _calibrate(self, highest: np.ndarray, toxic: np.ndarray, rounds: int = 50) -> None:
        """Logistic regression of the label on a text's highest window: a maximum over many windows is high by itself."""
        x = np.stack([highest, np.ones_like(highest)])
        w = np.array([1.0, 0.0])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            w -= np.linalg.solve((x * (p * (1 - p) + 1e-6)) @ x.T + 0.01 * np.eye(2), x @ (p - toxic) + 0.01 * (w - [1, 0]))
        self.scale = max(float(w[0]), 1e-3), float(w[1])

    def _train_words(self, bad: list[str], good: list[str], steps: int, rng) -> None:
        tune, hard = Adam(0.01), good
        for step in range(3 * steps):
            if step and step % (steps // 2) == 0:  # the clean words that look worst so far
                look = [good[k] for k in rng.permutation(len(good))[:LOOK]]
                hard = [look[k] for k in np.argsort(-self.char_states(look)[-1], kind="stable")[:1000]]
            pick = [w[k] for w in (bad, good, hard) for k in rng.integers(0, len(w), BATCH // 2)]
            y = np.array([1] * (BATCH // 2) + [0] * BATCH, F32)
            s, memo, at = self._spell(pick, True)
            d = (sigmoid(self.out["cw"] @ s + self.out["cb"]) - y) / F32(len(y))
            d_proj, own = self.char.backward(self.out["cw"][:, None] * d, memo)
            by_symbol = np.zeros((SYMBOLS, 6 * HIDDEN), F32)
            np.add.at(by_symbol, at.ravel(), d_proj.transpose(0, 2, 1).reshape(-1, 6 * HIDDEN))
            own["x"], own["b"] = by_symbol.T @ self.letters.T, by_symbol.sum(0)[:, None]
            tune({k: (self.char.p[k], g) for k, g in own.items()} | {"cw": (self.out["cw"], s @ d), "cb": (self.out["cb"], d.sum(keepdims=True)), "letters": (self.letters, (by_symbol @ self.char.p["x"]).T)})

    def _train_windows(self, windows, vocabulary: list[str], states: np.ndarray, steps: int, rng, tune: Adam) -> None:
        if not (windows[0] and windows[1]):
            return
        for _ in range(steps):
            pick = [windows[y][k] for y, n in ((1, BATCH // 2), (0, BATCH)) for k in rng.integers(0, len(windows[y]), n)]
            y = np.array([1] * (BATCH // 2) + [0] * BATCH, F32)
            at = np.zeros((WINDOW, len(pick)), np.int64)
            mask = np.zeros((WINDOW, len(pick)), F32)
            for i, own in enumerate(pick):
                at[: len(own), i], mask[: len(own), i] = own, 1
            used, back = np.unique(at, return_inverse=True)
            back = back.reshape(at.shape)
            x, bucket = self.inputs([vocabulary[k] for k in used], states[:, used])
            halves = np.split(self.word.project(x), 2)
            s, memo = self.word.forward(WINDOW, len(pick), lambda t, d: halves[d][:, back[t]], lambda t: mask[t], True)  # noqa: B023
            d = (sigmoid(self.out["ww"] @ s + self.out["wb"]) - y) / F32(len(y))
            d_proj, own = self.word.backward(self.out["ww"][:, None] * d, memo)
            by_word = np.zeros((len(used), 6 * WORD_HIDDEN), F32)
            np.add.at(by_word, back.ravel(), d_proj.transpose(0, 2, 1).reshape(-1, 6 * WORD_HIDDEN))
            d_bucket = np.zeros_like(self.buckets.T)
            np.add.at(d_bucket, bucket, (by_word @ self.word.p["x"])[:, -WORD_DIM:])
            own["x"], own["b"] = by_word.T @ x.T, by_word.sum(0)[:, None]
            tune({k: (self.word.p[k], g) for k, g in own.items()} | {"ww": (self.out["ww"], s @ d), "wb": (self.out["wb"], d.sum(keepdims=True)), "buckets": (self.buckets, d_bucket.T)})

    # scoring

    def numbers(self, split: list[list[str]], most: int = 250_000) -> list[np.ndarray]:
        """Rows of self.rows for the words of each text; what is new is computed, many words at once."""
        if len(self.memo) > most:
            self.clear()
        if len(self.memo) == 1:
            self.rows[0] = self.word.project(self.inputs([""])[0])[:, 0]
        new = sorted({w for ws in split for w in ws}.difference(self.memo))
        if new:
            n = len(self.memo)
            while len(self.rows) < n + len(new):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[n : n + len(new)] = self.word.project(self.inputs(new)[0]).T
            self.memo.update(zip(new, range(n, n + len(new)), strict=True))
        return [np.fromiter(map(self.memo.__getitem__, ws), np.int64, len(ws)) for ws in split]

    def _windows(self, ids: list[np.ndarray], rows: np.ndarray, block: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """(text, logit) of every window of every text; rows: (6h, words), the projections."""
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        room = np.maximum(size, WINDOW)
        owner = np.repeat(np.arange(len(ids)), room)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(room) - room, room)
        real = inside < size[owner]
        flat = np.zeros(len(owner), np.int64)
        flat[real] = np.concatenate([np.zeros(0, np.int64), *ids])
        starts = np.flatnonzero(inside <= (room - WINDOW)[owner])
        logit = np.empty(max(0, len(owner) - WINDOW + 1), F32)
        h3 = 3 * WORD_HIDDEN
        for i in range(0, len(logit), block):  # a window's step t is the next one's step t - 1, so slices serve all
            n = min(block, len(logit) - i)
            proj, mask = np.take(rows, flat[i : i + n + WINDOW - 1], axis=1), real[i : i + n + WINDOW - 1].astype(F32)
            s = self.word.forward(WINDOW, n, lambda t, d: proj[h3 * d : h3 * (d + 1), t : t + n], lambda t: mask[t : t + n])  # noqa: B023
            logit[i : i + n] = self.out["ww"] @ s + self.out["wb"]
        return owner[starts], logit[starts]

    def scores(self, texts: list[str]) -> np.ndarray:
        """The score of each whole text: that of its highest window."""
        if self.share is not None:
            return np.full(len(texts), self.share)
        owner, logit = self._windows(self.numbers([words_in(t) for t in texts]), np.ascontiguousarray(self.rows[: len(self.memo)].T))
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, logit)
        return sigmoid(self.scale[0] * best + self.scale[1])


def sample(documents: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, longest: int = LONGEST) -> pd.DataFrame:
    """(doc_id, text, toxic) of a bounded sample of the labelled rows that are not held out."""
    own = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL AND crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 <> 2").select("doc_id", "toxic").dropDuplicates(["doc_id"])
    order = F.xxhash64("doc_id")
    ids = own.filter("toxic = 1").orderBy(order, "doc_id").limit(most_toxic).union(own.filter("toxic = 0").orderBy(order, "doc_id").limit(most_clean))
    got = documents.select("doc_id", "text").filter(F.length("text") <= longest).join(F.broadcast(ids), "doc_id")  # at most most_toxic + most_clean ids
    return got.toPandas().sort_values(["doc_id", "text"], ignore_index=True).drop_duplicates("doc_id").reset_index(drop=True)


_HERE: dict[str, Network] = {}


def network_of(key: str, network: Network) -> Network:
    """One network a Python worker, so that tasks find the words that earlier ones met."""
    if key not in _HERE:
        _HERE.clear()
        _HERE[key] = network
    return _HERE[key]


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, steps: int = STEPS) -> DataFrame:
    """(doc_id, held_out, score, predicted)"""
    import uuid

    rows = sample(documents, labels, most_toxic, most_clean)
    key = uuid.uuid4().hex
    given = documents.sparkSession.sparkContext.broadcast(Network().train(rows["text"].tolist(), rows["toxic"].astype(int).tolist(), steps))  # a fixed number of weights
    del rows

    def run(batches):
        net = network_of(key, given.value)
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            score, i = np.zeros(len(texts)), 0
            while i < len(texts):
                j, chars = i, 0
                while j < len(texts) and chars < 1_000_000:
                    chars += len(texts[j])
                    j += 1
                score[i:j] = net.scores(texts[i:j])
                i = j
            yield b[["doc_id", "held_out"]].assign(score=score, predicted=(score >= threshold).astype(np.int32))

    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2).alias("held_out")
    return through_python(documents.select("doc_id", held, "text"), ("doc_id",), run, "held_out boolean, score double, predicted int")


def op1(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

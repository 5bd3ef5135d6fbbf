"""Best-fit packing of tokenized documents after a dominance reduction.

1. `cut_pieces` tokenizes whole texts (mapInPandas) and writes one row per piece to the shared folder.  Every piece
   carries its task and its place among the task's pieces of the same length.
2. The instance is the histogram of lengths, at most `capacity` rows whatever the corpus, and only that goes to
   the driver.  `plan` fixes the sets that Martello and Toth's criterion proves to dominate all other sets with the
   same item (alone, an exact partner, or the largest partner when no pair does better), then packs the remainder
   by best fit, decreasing, whole runs of equal pieces at once.
3. A piece's rank among those of its length (offset of its task plus its place in it) looks up sequence and offset in
   the plan: no piece meets another, and a length that a third of all pieces share is no group anywhere.

Nulls: a null text is the empty text, which is one piece that holds the end token alone; a null doc_id stays null.
Rows of one doc_id are documents of their own.  Extra columns are ignored.  An empty table gives no pieces.
"""
from __future__ import annotations

import re
import zlib
from collections import defaultdict
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.llm.common import stash, table, through_python
from foliospark.llm.token_counts import byte_letters

CAPACITY = 4096
END = 1


class ChunkEncoder:
    """Token ids by memo of white-space chunks: this vocabulary's tokens never span white space.

    What is not in the memo goes to the library, many chunks in a call; a text with special strings or characters beyond
    U+024F (or U+0130) goes to the library whole.  The memo starts anew when it holds `most` chunks."""

    ODD = re.compile("[^\\x00-\\x1b\\x20-\\x84\\x86-\\x9f\\xa1-\\u012f\\u0131-\\u024f]|<\\|")
    TOUCH = re.compile(r"[^\w\s][^\w\s]|_")

    def __init__(self, path: str, most: int = 800_000):
        from tokenizers import Tokenizer

        self.lib, self.most = Tokenizer.from_file(path), most
        self.model, self.letters = self.lib.model, {b: ord(c) for c, b in byte_letters().items()}
        self._clear()

    def _clear(self):
        self.memo: dict[str, int] = {}
        self.flat, self.begin, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used = 0

    def _learn(self, chunks: list[str]):
        """Plain words are one piece each and go to the library's merges at once; the others, joined, through all of it."""
        plain = [c for c in chunks if c.isalpha()]
        ids = [[t.id for t in self.model.tokenize(c if c.isascii() else c.encode().decode("latin-1").translate(self.letters))] for c in plain]
        self._add(plain, np.array([i for own in ids for i in own], np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))
        mixed = [c for c in chunks if not c.isalpha()]
        got = self.lib.encode(" ".join(mixed), add_special_tokens=False)
        at = np.array([a for a, _ in got.offsets], np.int64)
        ends = np.cumsum(np.fromiter(map(len, mixed), np.int64, len(mixed)) + 1)
        self._add(mixed, np.array(got.ids, np.uint32), np.diff(np.searchsorted(at, ends, side="left"), prepend=0))

    def _add(self, chunks: list[str], ids: np.ndarray, size: np.ndarray):
        n = len(self.memo)
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.begin) < n + len(chunks):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[n : n + len(chunks)] = self.used + np.cumsum(size) - size
        self.size[n : n + len(chunks)] = size
        self.used += len(ids)
        self.memo.update(zip(chunks, range(n, n + len(chunks)), strict=True))

    def _split(self, text: str) -> list[str] | None:
        """Chunks of a text, with lower case and full stops and commas by themselves where no two signs touch; None: odd."""
        if self.ODD.search(text):
            return None
        text = text.lower()
        if not self.TOUCH.search(text):
            text = text.replace(".", " . ").replace(",", " , ")
        return text.split()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.memo) > self.most:
            self._clear()
        split = [self._split(t) for t in texts]
        flat = list(chain.from_iterable(ws for ws in split if ws))
        k = np.fromiter(map(self.memo.get, flat, repeat(-1)), np.int64, len(flat))
        new = np.flatnonzero(k < 0)
        if len(new):
            words = [flat[i] for i in new]
            self._learn(list(set(words)))
            k[new] = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        size, begin = self.size[k], self.begin[k]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(begin - ends + size, size)]
        ends = np.concatenate([[0], ends])
        out, at = [], 0
        for t, ws in zip(texts, split, strict=True):
            if ws is None:
                out.append(np.array(self.lib.encode(t, add_special_tokens=False).ids, np.uint32))
            else:
                out.append(ids[ends[at] : ends[at + len(ws)]])
                at += len(ws)
        return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder_of(path: str) -> ChunkEncoder:
    """One encoder a Python worker, so that tasks find the chunks that earlier ones met."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut_pieces(df: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth)"""

    def run(batches):
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), defaultdict(int)
        encode = encoder_of(path or vocabulary())
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            rows, docs = [], b["doc_id"].tolist()
            i = 0
            while i < len(texts):
                j, chars = i, 0
                while j < len(texts) and chars < 1_000_000:
                    chars += len(texts[j])
                    j += 1
                for doc, ids in zip(docs[i:j], encode(texts[i:j]), strict=True):
                    ids = np.append(ids, np.uint32(END)).astype("<u4")
                    for p, s in enumerate(range(0, len(ids), capacity)):
                        own = ids[s : s + capacity]
                        rows.append((doc, p, s, len(own), zlib.crc32(own.tobytes()), part, nth[len(own)]))
                        nth[len(own)] += 1
                i = j
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return through_python(df.select("doc_id", "text"), ("doc_id",), run, "piece int, start long, length long, ids_crc32 long, part int, nth long")


def dominant(count: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sets fixed by dominance, (lengths, how many times); what is left stays in count."""
    fixed = []
    for j in sorted(count, reverse=True):
        while count.get(j):
            sizes = np.array(sorted(x for x, n in count.items() if n > (x == j)))
            room = capacity - j
            fit = sizes[sizes <= room]
            if not len(fit):  # nothing fits beside it
                fixed.append(((j,), count.pop(j) if j * 2 > capacity else 1))
                if j in count:
                    count[j] -= 1
                    if not count[j]:
                        del count[j]
                continue
            k = int(fit[-1])
            if k < room and 2 * fit[0] <= room:  # a pair or more might do better than the best partner
                partner = np.searchsorted(fit, room - fit, side="right") - 1
                best = int((fit + fit[np.maximum(partner, 0)])[partner >= 0].max(initial=0))
                if best > k or 3 * int(fit[0]) <= room:
                    break
            n = count[j] // 2 if j == k else min(count[j], count[k])
            fixed.append(((j, k), n))
            for x in (j, k):
                count[x] -= n
            for x in {j, k}:
                if not count[x]:
                    del count[x]
    return fixed


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[pd.DataFrame, int]:
    """Rows (length, rank, per, sequence, offset, upto): ranks [rank, upto) of the length go to sequences from `sequence` on, `per`
    a sequence, from `offset` on; and the number of sequences."""
    left, used, rows, made = dict(histogram), defaultdict(int), [], 0

    def place(length, n, per, seq, offset):
        rows.append((length, used[length], per, seq, offset, used[length] + n))
        used[length] += n

    for lengths, n in dominant(left, capacity):
        offset = 0
        for x in lengths:
            place(x, n, 1, made, offset)
            offset += x
        made += n
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: runs of (first sequence, how many)
    for length in sorted(left, reverse=True):
        n = left[length]
        rooms = sorted(r for r in open_ if r >= length and open_[r])
        while n:
            while rooms and not open_[rooms[0]]:
                rooms.pop(0)
            if rooms:
                room = rooms[0]
                seq, bins = open_[room].pop()
            else:
                room, seq, bins = capacity, made, -(-n // (capacity // length))
                made += bins
            per = room // length
            full = min(bins, n // per)
            if full:
                place(length, full * per, per, seq, capacity - room)
                n -= full * per
                open_[room - per * length].append((seq, full))
                seq, bins = seq + full, bins - full
            if bins and n and n < per:
                place(length, n, n, seq, capacity - room)
                open_[room - n * length].append((seq, 1))
                seq, bins, n = seq + 1, bins - 1, 0
            if bins:
                open_[room].append((seq, bins))
    return pd.DataFrame(rows, columns=["length", "rank", "per", "sequence", "offset", "upto"]).sort_values(["length", "rank"]), made


def pack(df: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset)"""
    pieces = stash(cut_pieces(df, capacity, path), "pieces")
    tasks = stash(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    steps, _ = plan(histogram, capacity)
    key = (steps["length"].to_numpy(np.int64) << 40) + steps["rank"].to_numpy(np.int64)
    cols = [steps[c].to_numpy(np.int64) for c in ("rank", "per", "sequence", "offset")]
    given = df.sparkSession.sparkContext.broadcast((key, cols))

    def look_up(batches):
        key, (rank0, per, seq, off) = given.value
        for b in batches:
            length, rank = b["length"].to_numpy(np.int64), b["rank"].to_numpy(np.int64)
            k = np.searchsorted(key, (length << 40) + rank, side="right") - 1
            q, r = np.divmod(rank - rank0[k], per[k])
            yield b.drop(columns="rank").assign(sequence_id=seq[k] + q, offset=off[k] + r * length)

    before = tasks.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).select("part", "length", "before")
    ranked = pieces.join(before.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return through_python(ranked, ("doc_id",), look_up, "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))

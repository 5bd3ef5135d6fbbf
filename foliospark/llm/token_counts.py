"""Token counts by a compiled transducer.

Two deterministic machines are compiled from the vocabulary file.  The cutter reads character classes and ends a
piece where the vocabulary's pattern does.  The counter reads a piece's bytes; after each byte its state tells the last
token of the encoding of what it has read, which is the one token that ends there and may follow the last token where
it begins, and the transition emits by how many tokens the encoding got longer.  (A token sequence is an encoding
if and only if each two neighbours are the encoding of their bytes, so the state is unique and the machine is
deterministic.)  Whole units, white space and what follows it, are compiled into single transitions on first sight:
they bring the machine from its reset state back to it, and the transition carries the emitted count.

A chunk of a text is a state map: from the pending unit before it to the pending unit after it and the tokens emitted
in between.  If a unit begins in the chunk, the map forgets its argument but for the unit that it ends; maps compose
associatively.  Every text goes through the one path: its chunks' maps, of which there may be one, then a prefix scan over a tree,
whose rounds are independent inside; a count needs the scan's last entry, so only the rounds up.  Chunks are cut anywhere.

Memory: the compiled transitions start anew when they hold `most` entries or `MOST_BYTES` bytes of units, and units of more
than `LONG_UNIT` characters are run through the counter each time.  The counter holds the last tokens of as many positions as
the longest token has bytes (and a block); a text without white space is pending as a whole, once or twice.  The pairs of tokens that may follow each other start
anew at `most` pairs.

Special tokens inside texts count as one token, the library's default.  Nulls: a null text is the empty text, no
tokens.  Repeated rows are counted one by one; extra columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import json
import re
from dataclasses import dataclass
from unicodedata import category

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import table, through_python

LIMIT = 512
CHUNK = 1 << 12
LONG_UNIT, MOST_BYTES, BLOCK = 256, 1 << 28, 1 << 14
# Fixed value: the characters with the Unicode property White_Space.
SPACES = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed value: endings that the pattern cuts off.
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
UNIT = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


@dataclass(frozen=True)
class ChunkMap:
    """head: text that ends the pending unit; inner: tokens of whole units; tail: the new pending unit, None if no unit begins here."""

    head: str
    inner: int = 0
    tail: str | None = None


class CountingTransducer:
    def __init__(self, path: str, most: int = 1_500_000):
        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        spell = lambda s: bytes(letters[c] for c in s)
        self.ids = {spell(s): i for s, i in spec["model"]["vocab"].items()}
        self.text = {i: b for b, i in self.ids.items()}
        self.rank = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[self.ids[spell(a)], self.ids[spell(b)]] = r, self.ids[spell(a) + spell(b)]
        ends: dict[int, set[int]] = {}
        for b in self.ids:
            ends.setdefault(b[-1], set()).add(len(b))
        self.lengths = {k: sorted(v, reverse=True) for k, v in ends.items()}
        self.reach = max(map(len, self.ids), default=1)
        special = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.most, self.units, self.follow, self.held = most, {}, {}, 0

    def merged(self, data: bytes) -> list[int]:
        """The encoding by its definition; used to compile which token may follow which."""
        ids = [self.ids[data[i : i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            best = min((self.rank[p] for p in zip(ids, ids[1:], strict=False) if p in self.rank), default=None)
            if best is None:
                break
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and self.rank.get((ids[i], ids[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def follows(self, a: int, b: int) -> bool:
        """a: -1 at the beginning."""
        if (ok := self.follow.get((a, b))) is None:
            if len(self.follow) >= self.most:
                self.follow.clear()
            ok = self.follow[a, b] = self.merged((self.text[a] if a >= 0 else b"") + self.text[b]) == ([a, b] if a >= 0 else [b])
        return ok

    def piece(self, piece: str) -> int:
        """Runs the counter over a piece."""
        if (n := self.units.get(piece)) is not None:  # every piece is a unit too
            return n
        data = piece.encode("utf-8", "surrogatepass")
        last, count, base = [-1], [0], 0  # of the positions from base on; a token reaches back `reach` bytes at most
        ids, follow, keep = self.ids, self.follow, self.reach + 1
        for start in range(0, len(data), BLOCK):
            if len(last) > keep:
                base += len(last) - keep
                del last[:-keep], count[:-keep]
            for n in range(start + 1, min(start + BLOCK, len(data)) + 1):
                for k in self.lengths[data[n - 1]]:
                    if k <= n and (t := ids.get(data[n - k : n])) is not None:
                        before = last[n - k - base]
                        ok = follow.get((before, t))
                        if ok is None:
                            ok = self.follows(before, t)
                        if ok:
                            last.append(t)
                            count.append(count[n - k - base] + 1)
                            break
        return self._keep(piece, count[-1])

    def _keep(self, unit: str, n: int) -> int:
        """Adds a compiled transition."""
        if len(unit) <= LONG_UNIT:
            if len(self.units) >= self.most or self.held >= MOST_BYTES:
                self.units.clear()
                self.held = 0
            self.units[unit] = n
            self.held += len(unit)
        return n

    @staticmethod
    def cut(unit: str) -> list[str]:
        """Runs the cutter over a unit."""
        body = unit.lstrip(SPACES)
        space = unit[: len(unit) - len(body)]
        if not body:
            return [space] if space else []
        out, lead = [], ""
        if len(space) > 1:
            out.append(space[:-1])
        if space[-1:] == " ":
            lead = " "
        elif space:
            out.append(space[-1])
        if body.isalpha():  # letters only: the one run there is
            return [*out, lead + body]
        i = 0
        while i < len(body):
            if body[i] == "'" and not lead:
                end = next((e for e in ENDINGS if body.startswith(e, i)), None)
                if end:
                    out.append(end)
                    i += len(end)
                    continue
            kind, j = _kind(body[i]), i + 1
            while j < len(body) and _kind(body[j]) == kind:
                j += 1
            out.append(lead + body[i:j])
            lead, i = "", j
        return out

    def unit(self, unit: str) -> int:
        """The compiled transition of a unit."""
        if (n := self.units.get(unit)) is None:
            n = self._keep(unit, sum(map(self.piece, self.cut(unit))))
        return n

    def run(self, text: str) -> int:
        """Tokens of whole units."""
        return self._emit(UNIT.findall(text))

    def _emit(self, units: list[str]) -> int:
        try:
            return sum(map(self.units.__getitem__, units))
        except KeyError:
            return sum(map(self.unit, units))

    def chunk(self, chunk: str) -> ChunkMap:
        units = UNIT.findall(chunk)  # the second one and those after it begin here for sure
        if len(units) < 2:
            return ChunkMap(chunk)
        return ChunkMap(units[0], self._emit(units[1:-1]), units[-1])

    @staticmethod
    def parted(a: str, b: str) -> bool:
        """Whether a unit begins where the pending units of two chunks meet."""
        return a[-1] not in SPACES and b[0] in SPACES

    def then(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of two neighbouring chunks."""
        open_ = a.head if a.tail is None else a.tail
        if a.tail is not None and b.tail is not None:
            return ChunkMap(a.head, a.inner + self.run(open_ + b.head) + b.inner, b.tail)
        if not self.parted(open_, b.head):
            joint = open_ + b.head
            return ChunkMap(joint, b.inner, b.tail) if a.tail is None else ChunkMap(a.head, a.inner, joint)
        if a.tail is None:
            return ChunkMap(a.head, 0, b.head) if b.tail is None else ChunkMap(a.head, self.run(b.head) + b.inner, b.tail)
        return ChunkMap(a.head, a.inner + self.run(open_), b.head)

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """Inclusive prefix scan: neighbours are joined, their scan gives every second prefix, and one step down the others."""
        if len(maps) < 2:
            return maps
        odd = self.scan([self.then(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)])
        even = [maps[0], *(self.then(a, b) for a, b in zip(odd, maps[2::2], strict=False))]
        return [odd[i // 2] if i % 2 else even[i // 2] for i in range(len(maps))]

    def total(self, maps: list[ChunkMap]) -> ChunkMap:
        """The scan's last entry: its rounds up alone, each of which keeps only its results, so what is pending is held once or twice."""
        while len(maps) > 1:
            maps = [self.then(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a whole text."""
        n, at = 0, 0
        for m in self.special.finditer(text):
            n += self._segment(text[at : m.start()], chunk) + 1
            at = m.end()
        return n + self._segment(text[at:] if at else text, chunk)

    def _segment(self, text: str, chunk: int) -> int:
        if not text:
            return 0
        whole = self.total([self.chunk(text[i : i + chunk]) for i in range(0, len(text), chunk)])
        return self._emit([u for u in (whole.head, whole.tail) if u]) + whole.inner


def _kind(c: str) -> str:
    k = category(c)[0]
    return k if k in "LN" else "O"


_MACHINES: dict[str, CountingTransducer] = {}


def machine_of(path: str) -> CountingTransducer:
    """One machine a Python worker, so that tasks find the transitions that earlier ones compiled."""
    if path not in _MACHINES:
        _MACHINES[path] = CountingTransducer(path)
    return _MACHINES[path]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(df: DataFrame, path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit)"""

    def run(batches):
        machine = machine_of(path or vocabulary())
        for b in batches:
            n = np.fromiter((machine.count(t, chunk) if isinstance(t, str) else 0 for t in b["text"]), np.int64, len(b))
            yield b[["doc_id", "n_bytes"]].assign(n_tokens=n, over_limit=n > limit)

    rows = df.select(F.col("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return through_python(rows, ("doc_id",), run, "n_bytes long, n_tokens long, over_limit boolean")


def op3(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))

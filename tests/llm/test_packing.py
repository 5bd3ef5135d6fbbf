import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T

from foliospark.llm import packing

SCHEMA = "doc_id long, text string, length int, part string"


def fits(rows, steps, made, capacity):
    """Every rank of every length has one place, without overlap or overflow."""
    places = {}
    for length, rank, per, seq, off, upto in steps.itertuples(index=False):
        for r in range(rank, upto):
            q, k = divmod(r - rank, per)
            assert (length, r) not in places
            places[length, r] = (seq + q, off + k * length)
    assert len(places) == sum(rows.values())
    bins = {}
    for (length, _), (seq, off) in places.items():
        bins.setdefault(seq, []).append((off, length))
    assert len(bins) == made
    for own in bins.values():
        at = 0
        for off, length in sorted(own):
            assert off == at
            at += length
        assert at <= capacity
    return made


@pytest.mark.parametrize("seed", range(40))
def test_plan_places_all(seed):
    r = random.Random(seed)
    cap = r.choice([10, 37, 100, 4096])
    rows = Counter(r.randint(1, cap) for _ in range(r.choice([1, 5, 60, 400])))
    steps, made = packing.plan(dict(rows), cap)
    fits(rows, steps, made, cap)
    assert made >= -(-sum(k * n for k, n in rows.items()) // cap)


def best(items, cap):
    """Fewest bins by search."""
    items = sorted(items, reverse=True)
    found = [len(items)]

    def go(i, bins):
        if len(bins) >= found[0]:
            return
        if i == len(items):
            found[0] = len(bins)
            return
        for k in sorted(set(bins)):
            if k >= items[i]:
                rest = list(bins)
                rest.remove(k)
                go(i + 1, [*rest, k - items[i]])
        go(i + 1, [*bins, cap - items[i]])

    go(0, [])
    return found[0]


@pytest.mark.parametrize("seed", range(60))
def test_dominance_keeps_the_optimum(seed):
    r = random.Random(seed)
    cap = r.choice([10, 20, 31])
    rows = Counter(r.randint(1, cap) for _ in range(r.randint(1, 9)))
    left = dict(rows)
    fixed = packing.dominant(left, cap)
    rest = [k for k, n in left.items() for _ in range(n)]
    back = Counter(left)
    for s, n in fixed:
        assert sum(s) <= cap
        for x in s:
            back[x] += n
    assert +back == rows
    assert sum(n for _, n in fixed) + best(rest, cap) == best(list(rows.elements()), cap)


def test_encoder_is_the_library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["", " ", "Don't stop I'LL we've!!", "ΣΑΣ Σ", "a<|endoftext|>b", "été ÉTÉ", "x y\x1cz\x85w", "½ ² 12 a_b", "日本語 テスト", "\t\n a  b \r\n", "İstanbul", "ß ẞ", "word " * 3000, "Ǆ ǅ ŉ"]
    r = random.Random(3)
    odd += ["".join(chr(r.choice([*range(0x20, 0x250), 0x20, 0x27])) for _ in range(200)) for _ in range(300)]
    encode = packing.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"), most=500)
    for i in range(0, len(odd), 10):
        for t, ids in zip(odd[i : i + 10], encode(odd[i : i + 10]), strict=True):
            assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_pack(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {1: "one two three", 2: None, 3: "", 4: "many words here " * 3000, 5: "tie a b", 6: "tie a b"}
    rows = [(k, v, 9, "x") for k, v in texts.items()] + [(6, "tie a b", 9, "x"), (None, "no id", 9, "x")]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), capacity=256).toPandas()
    assert got["sequence_id"].groupby(got["sequence_id"]).size().sum() == len(got)
    for _, own in got.groupby("sequence_id"):
        at = 0
        for off, length in sorted(zip(own["offset"], own["length"], strict=True)):
            assert off == at
            at += length
        assert at <= 256
    for k, v in texts.items():
        own = got[got["doc_id"] == k]
        n = len(lib.encode(v or "", add_special_tokens=False).ids) + 1
        assert own["length"].sum() == n * (2 if k == 6 else 1)
    import zlib

    ids = np.array([*lib.encode(texts[1], add_special_tokens=False).ids, 1], "<u4")
    assert got[got["doc_id"] == 1]["ids_crc32"].tolist() == [zlib.crc32(ids.tobytes())]
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
    assert got["doc_id"].isna().sum() == 1
    assert isinstance(packing.pack(spark.createDataFrame(rows, SCHEMA)).schema["sequence_id"].dataType, T.LongType)

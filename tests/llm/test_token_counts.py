import random

import public_tokenizers
import pytest

from foliospark.llm import token_counts

ODD = ["", " ", "  ", "\n", "a", "Don't we'll 'tis ''s !'s  've", "x<|endoftext|>y  <|endoftext|>", "été  ÉTÉ\n\n ß", "½²3 12a_b-c", "日本語 テスト　x", "a\x1cb \x85 c\xa0d", " lead", "trail  ", "\t\t x", "w" * 400, "!?" * 200, "🙂 é 🙂🙂", "a\r\n b"]


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def texts():
    r = random.Random(5)
    pools = ["ab'st rel vd\n ", "etaoin shrdlu THE and .,!\n\t  '", "éüß ñ日本  ½9 a", "".join(map(chr, range(1, 0x180)))]
    return ODD + ["".join(r.choice(p) for _ in range(r.randint(1, 120))) for p in pools for _ in range(150)]


def test_counts_are_the_librarys(lib):
    machine = token_counts.CountingTransducer(public_tokenizers.path("byte_bpe_50k.json"), most=300)
    for t in texts():
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert machine.count(t) == n, t
        for chunk in (1, 2, 7):
            assert machine.count(t, chunk) == n, (chunk, t)


def test_maps_compose_associatively():
    machine = token_counts.CountingTransducer(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(6)
    for t in texts()[::5]:
        maps = [machine.chunk(t[i : i + 3]) for i in range(0, len(t), 3)]
        if len(maps) < 3:
            continue
        k = r.randrange(1, len(maps) - 1)
        left = machine.then(machine.then(maps[k - 1], maps[k]), maps[k + 1])
        assert left == machine.then(maps[k - 1], machine.then(maps[k], maps[k + 1]))


def test_table(spark, lib):
    rows = [(1, "one two", "x"), (2, None, None), (3, "", "x"), (1, "one two", "x"), (None, "w " * 2000, "x"), (9, "many words here\n" * 20000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r["doc_id"], r["n_bytes"]): (r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(df).collect()}
    for i, t, _ in rows:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert got[i, len((t or "").encode())] == (n, n > 512)
    assert token_counts.token_counts(df.limit(0)).count() == 0


def test_scan_gives_every_prefix():
    machine = token_counts.CountingTransducer(public_tokenizers.path("byte_bpe_50k.json"))
    for t in texts()[::7]:
        maps = [machine.chunk(t[i : i + 5]) for i in range(0, len(t), 5)]
        one = maps[:1]
        for m in maps[1:]:
            one.append(machine.then(one[-1], m))
        assert machine.scan(maps) == one


def test_memory_is_bounded(monkeypatch, lib):
    monkeypatch.setattr(token_counts, "MOST_BYTES", 100)
    machine = token_counts.CountingTransducer(public_tokenizers.path("byte_bpe_50k.json"), most=50)
    for t in [*texts()[::9], "x1" * 5000]:
        assert machine.count(t) == len(lib.encode(t, add_special_tokens=False).ids)
        assert len(machine.units) <= 50 and len(machine.follow) <= 50 and sum(map(len, machine.units)) <= 100 + token_counts.LONG_UNIT


@pytest.mark.parametrize("text", ["日本語の長い文章" * 150_000, "ab1-" * 200_000, "x" * 500_000 + " \n" * 3 + "y" * 300_000, "é" * 400_000 + "'s"])
def test_long_text_without_white_space(text, lib):
    """Over a million characters, in memory that grows with the text and no faster."""
    import resource
    import time

    machine = token_counts.CountingTransducer(public_tokenizers.path("byte_bpe_50k.json"))
    before, t = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    n = machine.count(text)
    grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024
    assert grown < 150 and time.time() - t < 60
    assert n == len(lib.encode(text, add_special_tokens=False).ids)


def test_blocks_of_the_counter(monkeypatch, lib):
    monkeypatch.setattr(token_counts, "BLOCK", 3)
    machine = token_counts.CountingTransducer(public_tokenizers.path("byte_bpe_50k.json"))
    for t in [*texts()[::4], "abcdefgh" * 100]:
        assert machine.count(t, 7) == len(lib.encode(t, add_special_tokens=False).ids)

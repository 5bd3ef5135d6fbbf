"""The near-dedup stage of the pipeline against brute force on planted near copies."""
import random

import pytest

from foliospark.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def stage(spark, rows):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, t, "en", "src0", 1) for i, t in rows], SCHEMA)
    return sorted(((x["doc_id"], x["text"]) for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()), key=str)


def grams(t):
    words = (t or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def prose(r, n):
    return [r.choice("abcdefghijkl") + str(r.randrange(300)) for _ in range(n)]


@pytest.mark.parametrize("block", [near_copies.BLOCK, 2])
def test_planted_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    r = random.Random(6)
    rows = []
    for k in range(60):
        words = prose(r, r.randint(40, 300))
        rows.append((k, " ".join(words)))
        other = list(words)
        for _ in range(1 + k % 6):
            other[r.randrange(len(other))] = "edit"
        rows.append((100 + k, " ".join(other)))
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = {i: grams(t) for i, t in rows}
    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    want = {i for i in root if find(i) == i}
    assert 60 < len(want) < 110  # some of the edited texts are below 0.8
    assert {i for i, _ in stage(spark, rows)} == want


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 900])
def test_recall_of_the_keys(n):
    r = random.Random(n)
    own = near_copies.shingles(" ".join(prose(r, n)))
    assert len(near_copies.band_keys(own)) == (near_copies.BANDS if n else 0)
    if n == 900:
        missed = 0
        for _ in range(200):
            keep = sorted(r.sample(range(len(own)), int(0.8 * len(own)) + 1))
            missed += not (near_copies.band_keys(own) == near_copies.band_keys(own[keep])).any()
        assert missed == 0


def test_null_and_repeated_ids(spark):
    r = random.Random(8)
    t = [" ".join(prose(r, 40)) for _ in range(6)]
    rows = [(None, t[0]), (None, t[1]), (None, t[2]), (5, t[2]), (7, t[3]), (7, t[4]), (3, t[4]), (9, t[5]), (9, t[5])]
    assert stage(spark, rows) == sorted([(None, t[0]), (None, t[1]), (5, t[2]), (7, t[3]), (3, t[4]), (9, t[5])], key=str)


def test_blocks_lose_no_link(spark, monkeypatch):
    """One bucket of chains: many sets are linked to some, not to the first one."""
    monkeypatch.setattr(near_copies, "BLOCK", 5)
    r = random.Random(3)
    base = prose(r, 60)
    rows, words = [], list(base)
    for k in range(40):
        if k % 8 == 0:
            words = base[: 45 - k // 4] + prose(r, 15 + k // 4)
        words = list(words)
        words[r.randrange(len(words))] = f"edit{k}"
        rows.append((k, " ".join(words)))
    monkeypatch.setattr(near_copies, "band_keys", lambda own: near_copies.np.array([7], "int64"))  # all in one bucket
    sets = {i: grams(t) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    want = {i for i in root if find(i) == i}
    assert 1 < len(want) < 40
    assert {i for i, _ in stage(spark, rows)} == want


def test_empty_table_and_long_text(spark):
    assert stage(spark, []) == []
    long = " ".join(prose(random.Random(1), 30000))
    assert [i for i, _ in stage(spark, [(2, long), (1, long + " end"), (3, ""), (4, None)])] == [1, 3]

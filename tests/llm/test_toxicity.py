"""Operator 1: gradients, every window one by one, and the query's cases."""
import random

import numpy as np
import pandas as pd
import pytest

from foliospark.llm import toxicity

SCHEMA = "doc_id long, text string, score string, predicted string, held_out string"


def toxic_rows(n, seed=9):
    r = random.Random(seed)
    syllable = ["ta", "ren", "o", "mi", "lus", "ka", "ver"]
    rows = []
    for i in range(n):
        words = ["".join(r.choice(syllable) for _ in range(r.randint(1, 4))) for _ in range(r.randint(5, 120))]
        y = i % 4 == 0
        if y:
            words[r.randrange(len(words))] = r.choice(["zzvile", "qqfoul", "grrbad"]) + r.choice(["", "s", "er"])
        rows.append((i, " ".join(words), int(y)))
    return rows


@pytest.fixture(scope="module")
def network():
    rows = toxic_rows(400)
    return toxicity.Network().train([t for _, t, _ in rows], [y for *_, y in rows], steps=120)


def curve(x):
    return x / (1 + abs(x))


def one_by_one(layer, xs):
    """The layer over one sequence of input vectors, step by step."""
    h, p = layer.h, layer.p
    outs = []
    for d in (0, 1):
        s, got = np.zeros(h), []
        for x in xs if d == 0 else xs[::-1]:
            a = (p["x"] @ x + p["b"][:, 0])[3 * h * d : 3 * h * (d + 1)]
            g = p[f"u{d}"] @ s
            z, r = 0.5 + 0.5 * curve(a[:h] + g[:h]), 0.5 + 0.5 * curve(a[h : 2 * h] + g[h : 2 * h])
            s = s + (1 - z) * (curve(a[2 * h :] + r * g[2 * h :]) - s)
            got.append(s)
        outs.append(got if d == 0 else got[::-1])
    both = np.array([np.concatenate(o) for o in zip(*outs)])
    e = np.exp(both @ p["v"])
    return (e / e.sum()) @ both


def test_every_window_one_by_one(network):
    texts = ["ta ren omi", "", "grrbad", " ".join(w for _, t, _ in toxic_rows(3, 5) for w in t.split()), "x" * 100 + " lus"]
    for text, got in zip(texts, network.scores(texts), strict=True):
        words = toxicity.words_in(text)
        states = network.inputs(words)[0] if words else network.inputs([""])[0]
        best = -np.inf
        for i in range(max(1, len(words) - toxicity.WINDOW + 1)):
            own = words[i : i + toxicity.WINDOW]
            xs = [states[:, i + k] for k in range(len(own))]
            pooled = one_by_one(network.word, xs) if xs else np.zeros(2 * toxicity.WORD_HIDDEN)
            best = max(best, float(network.out["ww"] @ pooled + network.out["wb"][0]))
        assert got == pytest.approx(1 / (1 + np.exp(-(network.scale[0] * best + network.scale[1]))), abs=1e-4)
    for w in ("omi", "renlusver", "grrbad"):
        spelled = [network.letters[:, toxicity.symbols([c])[0][0, 0]] for c in w]
        assert network.char_states([w])[:-1, 0] == pytest.approx(one_by_one(network.char, spelled), abs=1e-4)


def test_whole_long_words():
    word = "".join(random.Random(1).choice("abcdef") for _ in range(1001))
    pieces = toxicity.words_in(f"a {word} b")
    assert pieces[0] == "a" and pieces[-1] == "b" and max(map(len, pieces)) == toxicity.PIECE
    for i in range(len(word) - toxicity.PIECE // 2):
        assert any(word[i : i + toxicity.PIECE // 2] in p for p in pieces[1:-1])


def test_word_glued_into_others(network):
    clean = "ta,ren," * 40
    assert network.scores([clean + "grrbad, omi"])[0] > 0.5 > network.scores([clean])[0]


def test_query(spark):
    rows = toxic_rows(600)
    given = [(i, t) for i, t, _ in rows] + [(None, "x"), (7000, None), (7001, ""), (7002, "grrbad " * 5000), (7003, "ta ren"), (7003, "ta ren")]
    docs = spark.createDataFrame([(*x, "s", "p", "h") for x in given], SCHEMA)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (7002, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).toPandas()
    assert len(got) == len(given) and got["score"].between(0, 1).all()
    assert ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    own = got[got["held_out"]].merge(pd.DataFrame(rows, columns=["doc_id", "t", "y"]), on="doc_id")
    assert len(own) > 100 and (own["predicted"] == own["y"]).mean() > 0.95
    by = got.set_index("doc_id")["score"]
    assert by[7000] == by[7001] < 0.3 <= by[7002] and len(set(by[7003])) == 1
    assert toxicity.toxicity(docs.limit(0), labels.limit(0)).count() == 0
    one = toxicity.toxicity(docs, labels.filter("toxic = 1")).toPandas()
    assert (one["score"] == 1).all()


def test_gradients():
    rng = np.random.default_rng(1)
    layer = toxicity.Pooled(rng, 5, 3)
    layer.p = {k: v.astype(np.float64) for k, v in layer.p.items()}
    x, mask, g = rng.standard_normal((6, 5, 4)), (rng.random((6, 4)) < 0.8).astype(np.float64), rng.standard_normal((6, 4))
    mask[0] = 1
    toxicity.F32, f32 = np.float64, toxicity.F32
    try:
        def run(keep=False):
            proj = np.stack([layer.project(v) for v in x])
            return layer.forward(6, 4, lambda t, d: proj[t, 9 * d : 9 * (d + 1)], lambda t: mask[t], keep)

        loss = lambda: float((run() * g).sum())
        d_proj, own = layer.backward(g, run(True)[1])
        own["x"], own["b"] = np.einsum("tkn,tjn->kj", d_proj, x), d_proj.sum((0, 2))[:, None]
        for name in ("x", "b", "u0", "u1", "v"):
            w = layer.p[name]
            at = tuple(int(rng.integers(0, s)) for s in w.shape)
            keep, eps = w[at], 1e-5
            w[at] = keep + eps
            up = loss()
            w[at] = keep - eps
            down = loss()
            w[at] = keep
            assert own[name][at] == pytest.approx((up - down) / (2 * eps), rel=1e-3, abs=1e-5)
    finally:
        toxicity.F32 = f32

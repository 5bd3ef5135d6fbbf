"""Edge cases and brute force for the operators on documents, pages and embeddings."""
import random
import re
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from foliospark.llm import hamming, html, line_dedup, mixing, quality, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, pos int, h1 string, fp string, score string"
WS = "[^\\x20\\x09-\\x0D]+"
LONG = "Long line of words that goes on and on\n" * 3000
SAMPLE = [
    (1, "A shared line of text\nonly here one two three", "en", "src0"),
    (2, "  a SHARED line of text \nshort\nshort", "en", "src1"),
    (2, "  a SHARED line of text \nshort\nshort", "en", "src1"),
    (3, None, None, None),
    (4, "", "de", "src0"),
    (5, LONG, "en", "src0"),
    (6, LONG + "tail end of it", "en", "src2"),
    (None, "A shared line of text", "en", "src0"),
    (7, " \n\t\n", "", ""),
    (8, "w1 w2 w3 w4 w5 w6 w7 w8 " * 9, "fr", "x"),
    (9, "MIT license, Apache  License and CC-BY 4.0; gnu GENERAL public license", "fr", "src3"),
]


def frame(spark, rows=SAMPLE):
    return spark.createDataFrame([(a, b, c, d, 1, "x", 7, "x", "x", "x") for a, b, c, d in rows], SCHEMA)


def test_quality(spark):
    got = quality.quality_rules(frame(spark)).select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(got) == len(SAMPLE)
    for r in got:
        t = r["text"] or ""
        words = re.findall(WS, t)
        grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        n = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(8)}
        lines = [x for x in t.split("\n") if re.search(WS, x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(covered))
        assert (r["n_symbols"], r["n_dup_lines"]) == (len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
        assert not (r["base_failed"] and r["kept"])
    assert quality.quality_rules(frame(spark, [])).count() == 0


def test_rule_order(spark):
    rows = [(i, "* " * 50, "en", "s") for i in range(5)] + [(i, "plain words " * 20, "en", "s") for i in range(5, 40)]
    order = quality.order_rules(frame(spark, rows))
    assert order[0].name in ("symbols", "dup_lines") and {r.name for r in order} == {r.name for r in quality.RULES}
    # what the first rule rejects counts for no other, however cheap that is
    two = (quality.Rule("a", "n_symbols > 10"), quality.Rule("b", "n_symbols > 20"), quality.Rule("c", "n_words = 40"))
    assert [r.name for r in quality.order_rules(frame(spark, rows), two)][0] == "c"
    assert [r.name for r in quality.order_rules(frame(spark, []))] == sorted(r.name for r in quality.RULES)


def test_line_dedup(spark):
    low = lambda s: s.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    first = {}
    rank = lambda i: -(2**63) if i is None else i
    holders = {}
    for i, t, *_ in SAMPLE:
        for x in (t or "").split("\n"):
            if len(low(x)) >= 10:
                holders.setdefault(low(x), set()).add(rank(i))
    first = {k: min(v) for k, v in holders.items() if len(v) > 1}
    want = Counter()
    for i, t, *_ in SAMPLE:
        lines = (t or "").split("\n")
        kept = [x for x in lines if low(x) not in first or first[low(x)] == rank(i)]
        want[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.dedup_lines(frame(spark)).collect())
    assert got == want
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0
    # hashes that count as hot give the same, and so do names that the operator uses, and ids of text
    hot = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.dedup_lines(frame(spark), salts=3, often=1).collect())
    clash = frame(spark).selectExpr("doc_id", "text", "1 AS keep", "2 AS tail", "3 AS n_dropped", "4 AS n_lines", "'x' AS kept_text", "5 AS h", "6 AS row", "7 AS text_key", "8 AS lines", "9 AS first", "10 AS _doc")
    out = line_dedup.dedup_lines(clash)
    assert hot == want and out.columns == ["doc_id", "text", "keep", "tail", "h", "row", "text_key", "lines", "first", "_doc", "n_lines", "n_dropped", "kept_text"]
    got = out.collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got) == want and {(r["keep"], r["tail"], r["_doc"]) for r in got} == {(1, 2, 10)}
    named = line_dedup.dedup_lines(spark.createDataFrame([("b", "the same old line\nx"), ("a", "the same old line")], "doc_id string, text string")).collect()
    assert {(r["doc_id"], r["kept_text"]) for r in named} == {("a", "the same old line"), ("b", "x")}


def test_line_dedup_streams_ranges(spark, tmp_path, capsys):
    rows = [(i, f"every one has this line\nonly {i} has this line", "en", "s") for i in range(2000)]
    out = line_dedup.line_bitmaps(frame(spark, rows), salts=4, often=3)
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(1, 2000))
    assert {(tuple(r["keep"]), r["tail"]) for r in out.collect()} == {((), 1)}
    out.explain()
    plan = capsys.readouterr().out
    assert "rangepartitioning" in plan and "Window" in plan and plan.count("hashpartitioning(h") == 0  # the ranges are not dealt anew


def brute_fingerprint(t):
    words = re.findall(WS, (t or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(spark):
    r = random.Random(1)
    base = [" ".join(r.choice("abcdefgh") * 3 for _ in range(r.randint(1, 60))) for _ in range(40)]
    rows = [(i, t, "en", "s") for i, t in enumerate(base + base[:9] + [b + " end" for b in base[:20]])] + [(900, None, None, None), (901, "", "", ""), (None, "x y z", "", "")]
    got = simhash.near_dedup(frame(spark, rows)).collect()
    fp = {i: brute_fingerprint(t) for i, t, *_ in rows}
    root = {i: i for i in fp}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = [i for i in fp if i is not None]
    for a in ids:
        for b in ids:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 2 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert len(got) == len(rows)
    for x in got:
        assert x["fp"] % 2**64 == fp[x["doc_id"]]
        if x["doc_id"] is not None:
            assert x["component_id"] == find(x["doc_id"])
    assert simhash.near_dedup(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_simhash_forest(spark, seed):
    r = np.random.default_rng(seed)
    at = r.integers(0, 2**64, 6, dtype=np.uint64)
    fps = {int(a) for a in at}
    for _ in range(300):
        fps.add(int(r.choice(list(fps))) ^ (1 << int(r.integers(0, 64))) ^ (1 << int(r.integers(0, 64))))
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    roots = {x["node"] % 2**64: x["root"] % 2**64 for x in simhash.components(simhash.links(df)).collect()}
    seen, groups = set(), 0
    for f in fps:
        if f in seen:
            continue
        todo, own = [f], {f}
        while todo:
            x = todo.pop()
            new = {y for y in fps if y not in own and (x ^ y).bit_count() <= 2}
            own |= new
            todo += new
        seen |= own
        groups += 1
        assert len({roots.get(x, x) for x in own}) == 1
    assert len({roots.get(x, x) for x in fps}) == groups


def test_mixing(spark):
    r = random.Random(2)
    rows = [(i, "w " * r.randint(0, 30), r.choice(["en", "de", "fr"]), f"src{r.randint(0, 5)}") for i in range(400)] + [(1000, None, "en", "src0"), (1001, "one two", None, None), (None, "a b c", "en", "src1")]
    got = mixing.draw(frame(spark, rows)).collect()
    total = sum(len((t or "").split()) for _, t, *_ in rows)
    drawn = sum(x["copies"] * x["n_tokens"] for x in got)
    leaves = len({(x["lang"], x["source"]) for x in got})
    assert total * 80 // 100 - leaves <= drawn <= total * 80 // 100 + 31 * leaves
    assert all(1 <= x["copies"] <= mixing.EPOCHS for x in got)
    assert {x["doc_id"] for x in got}.isdisjoint({1000})
    assert sorted(map(str, got)) == sorted(map(str, mixing.draw(frame(spark, rows[::-1])).collect()))
    assert mixing.draw(frame(spark, [])).count() == 0


def test_shortage_stays_among_siblings(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d1", "en", "c", 1000)], "domain string, lang string, source string, supply long")
    got = {x["source"]: x["tokens"] for x in mixing.grants(leaves, weights={"domain": {"d0": 1, "d1": 1}}, epochs=1, percent=50).collect()}
    assert got == {"a": 10, "b": 492, "c": 502}


def test_mixing_of_large_supplies(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 10**14), ("d0", "en", "b", 3 * 10**14), ("d1", None, "c", 10**13)], "domain string, lang string, source string, supply long")
    got = {x["source"]: x["tokens"] for x in mixing.grants(leaves, weights={"domain": {"d0": 1, "d1": 1}}, epochs=3, percent=80).collect()}
    assert got["c"] == 3 * 10**13 and got["a"] == got["b"] == (41 * 10**13 * 80 // 100 - 3 * 10**13) // 2


def test_mixing_buckets_and_clashes(spark, monkeypatch):
    r = random.Random(6)
    rows = [(i, "w " * r.randint(1, 30), "en", f"src{r.randint(0, 1)}") for i in range(500)] + [(7, "two words", "en", "src0")]
    df = frame(spark, rows).selectExpr("*", "'mine' AS domain", "1 AS o", "2 AS bucket", "3 AS cap", "4 AS digits")
    one = sorted(map(str, mixing.draw(df).collect()))
    monkeypatch.setattr(mixing, "BUCKET", 2)
    assert one == sorted(map(str, mixing.draw(df).collect()))
    assert {x["domain"] for x in mixing.draw(df).collect()} <= {"d0", "d1", "d2", "d3"}


def test_hamming(spark):
    r = np.random.default_rng(5)
    code = np.concatenate([r.integers(-(2**63), 2**63, 3000), r.integers(0, 4, 200), np.zeros(50, np.int64)])
    index = hamming.MultiIndex(np.arange(len(code)), code)
    for q in [*code[:20], *code[-20:], 12345]:
        ids, dist = index.search(int(q), 10)
        d = np.bitwise_count((code ^ q).view(np.uint64)).astype(int)
        best = np.lexsort((np.arange(len(code)), d))[:10]
        assert ids.tolist() == best.tolist() and dist.tolist() == d[best].tolist()
    rows = [(i, [float(x) for x in r.standard_normal(64)]) for i in range(120)] + [(200, None), (250, [1.0]), (None, [1.0] * 64), (300, [None] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = hamming.top_k(df, k=5, block=50).collect()
    assert {x["query_id"] for x in got} == {0, 50, 100, 300} and len(got) == 20
    good = {i: np.array([x is not None and x > 0 for x in e]) for i, e in rows if i is not None and e and len(e) == 64}
    for q in (0, 50, 100, 300):
        want = sorted((int((good[q] != e).sum()), i) for i, e in good.items())[:5]
        assert [(x["distance"], x["vec_id"]) for x in sorted(got, key=lambda x: x["rank"]) if x["query_id"] == q] == want
    assert hamming.top_k(df.limit(0)).count() == 0


def test_html(spark):
    model = html.trained()
    r = random.Random(77)
    right = total = 0
    for _ in range(150):
        nodes = html.labelled(html.labelled_page(r))
        for n, p in zip(nodes, model.marginals(nodes)[0], strict=True):
            if n.parts:
                right, total = right + ((p >= 0.5) == bool(n.y)), total + 1
    assert right >= 0.97 * total
    page = '<nav><a href="/">Home</a></nav><article><h1>T &amp; t</h1><p>one\n two<p>three<div class="ad">buy</div><script>var x="</p>";</script><ul><li>four<li>five</ul></article><footer>f'
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", page), (None, "u", "<p>alone"), (5, "u", "<div>" * 12 + "deep words in a block")]
    got = html.extract(spark.createDataFrame([(*x, "x") for x in rows], "page_id long, url string, html string, text string")).collect()
    text = {x["page_id"]: (x["text"], x["n_chars"]) for x in got}
    assert len(got) == 6 and text[1] == ("T & t\n\none two\n\nthree\n\nfour\n\nfive", 33)
    assert text[2] == text[3] == ("", 0) and text[None][0] == "alone" and text[5][0] == "deep words in a block"


def test_tree_marginals_by_enumeration():
    from itertools import product
    from math import exp

    r = random.Random(8)
    model = html.TreeModel()
    model.edge = [[r.gauss(0, 1) for _ in "ab"] for _ in "ab"]
    nodes, _ = html.parse("<div><p>a<p>b<section><p>c</p></section></div><p>d")
    feats = [[f"f{i}"] for i in range(len(nodes))]
    model.weights = {f"f{i}": r.gauss(0, 2) for i in range(len(nodes))}
    place = {id(n): i for i, n in enumerate(nodes)}
    total, one = 0.0, [0.0] * len(nodes)
    for y in product((0, 1), repeat=len(nodes)):
        w = exp(sum(model.weights[f"f{i}"] * v for i, v in enumerate(y)) + sum(model.edge[y[place[id(n.parent)]]][y[i]] for i, n in enumerate(nodes) if i))
        total += w
        one = [o + w * v for o, v in zip(one, y, strict=True)]
    assert model.marginals(nodes, feats)[0] == pytest.approx([o / total for o in one])

"""Span candidates against a literal loop over random pages."""
import random
import re

from pyspark.sql import functions as F

from foliospark.operators import spans

COLUMNS = "doc_id long, page int, page_id string, element_id string, ordinal int, text string, box array<double>"
WORDS = ["TOTAL DUE", "Total:", "Amount: 12.50", "$1,234.50", "12345.67", "call 555-010-1234", "me@x.org", "due: 3/4/2024 or Jan 5, 2024", "ZIP 12345-6789", "REF-0012/77", "Ünit price : 5", "a: b: c", "BETRAG", "(45.00)", "x", "  ", "Name:\tJo\nAge: 7", "LABEL 5", "straße", "STRASSE", "one two three four five six seven: 8"]


def page_of(seed):
    r = random.Random(seed)
    out = []
    for k in range(r.randrange(3, 26)):
        left, top = r.randrange(0, 500, 20), r.randrange(0, 200, 6)
        box = None if r.random() < 0.1 else [float(left), float(top), float(left + r.choice((30, 60))), float(top + r.choice((6, 12)))]
        out.append((seed, 1, "p", f"e{k}", k, " ".join(r.choice(WORDS) for _ in range(r.choice((1, 1, 2)))) if r.random() < 0.95 else None, box))
    return out


def label_like(text):
    flat = " ".join(text.split())
    if not flat or len(flat) > 60 or len(flat.split()) > 6:
        return False
    letters = [c for c in flat if c.isalpha()]
    return flat.endswith(":") or (bool(letters) and sum(map(str.isupper, letters)) / len(letters) >= 0.7 and not any(map(str.isdigit, flat)))


def kind_of(text):
    return next((t for _, t, p in spans.TYPED if re.fullmatch(p, text.strip())), "text")


def loop(elements, limit):
    full = [e for e in elements if e[5] and e[5].strip()]
    labelled, typed = [], []
    for e in full:
        at = 0
        for line in e[5].split("\n"):
            for m in re.finditer(spans.COLON, line):
                if m[2].strip() and len(m[1].split()) <= 6:
                    start = at + m.start(2)
                    labelled.append((e, m[2].strip()[:80], " ".join(m[1].split())[:60], "label_colon", kind_of(m[2]), start, start + len(m[2].rstrip())))
            at += len(line) + 1
    for a in full:
        for b in full:
            if a is b or a[6] is None or b[6] is None or not label_like(a[5]) or label_like(b[5]):
                continue
            (al, at, ar, ab), (bl, bt, br, bb) = a[6], b[6]
            if min(ab, bb) > max(at, bt) and 0 <= bl - ar <= 220:
                kind = "label_right_of"
            elif min(ar, br) > max(al, bl) and 0 <= bt - ab <= 30:
                kind = "label_below_of"
            else:
                continue
            flat = " ".join(b[5].split())
            labelled.append((b, flat[:80], " ".join(a[5].split())[:60], kind, kind_of(flat), 0, min(len(b[5]), 80)))
    for e in full:
        for kind, value, pattern in spans.TYPED:
            typed += [(e, m[0].strip()[:80], None, kind, value, m.start(), m.end()) for m in re.finditer(pattern, e[5]) if m[0].strip()]
    out, ids = [], set()
    for part in (labelled, typed):
        seen = set()
        for c in part:
            key, sid = (c[0][3], c[1].casefold()), f"s{c[0][1]}_{c[0][4]}_{c[5]}_{c[6]}"
            if key in seen:
                continue
            seen.add(key)
            if sid not in ids:
                ids.add(sid)
                out.append((sid, c[3], c[4], c[1], c[2]))
    return out[:limit]


def test_random_pages(spark):
    pages = {seed: page_of(seed) for seed in range(80)}
    df = spark.createDataFrame([e for p in pages.values() for e in p], COLUMNS).repartition(3)
    kinds = set()
    for limit in (spans.PAGE_LIMIT, 7):
        got = {}
        for r in spans.candidates(df, limit).orderBy("doc_id", "place").collect():
            got.setdefault(r.doc_id, []).append((r.span_id, r.kind, r.value_type, r.value_text, r.label_text))
            kinds.add(r.kind)
        for seed, p in pages.items():
            assert got.get(seed, []) == loop(p, limit)
    assert len(kinds) == 9


def test_boxes(spark):
    df = spark.sql("SELECT array(1D, 90D, 5D, 80D) AS a, array(1D, 2D, 3D) AS b")
    r = df.select(spans.reading_box(df.a, df.a.isNull().cast("string")).alias("top"), spans.reading_box(df.a, F.lit("bottomleft")).alias("low"), spans.reading_box(df.b, df.b.isNull().cast("string")).alias("none")).first()
    assert (r.top, r.low, r.none) == ([1.0, 80.0, 5.0, 90.0], [1.0, -90.0, 5.0, -80.0], None)

"""Operator 8: cases, and brute force of the query: words one by one, all templates with all blocks, SQL for the base."""
import itertools
import random
import textwrap

import duckdb
import pandas as pd
import pytest

from foliospark.llm import licenses

SCHEMA = "doc_id long, text string, score string, labels string"
UPPER = {c: c + 32 for c in range(65, 91)}


def word_list(text):
    words, word = [], ""
    for c in (text or "").translate(UPPER) + " ":
        o = ord(c)
        if o <= 0x2F or 0x3A <= o <= 0x60 or 0x7B <= o <= 0x7F:
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    return words


def stands(template, block, names):
    """Whether the threshold's share of a short template's words stands in order in as many neighbouring words as it has."""
    least = -(-len(template) * 4 // 5)
    for i in range(len(block)):
        own = block[i : i + len(template)]
        for chosen in itertools.combinations(template, least):
            rest = iter(own)
            if names <= set(own) and all(w in rest for w in chosen):
                return True
    return False


def brute(text):
    words = word_list(text)
    places = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    found = {}
    for join in licenses.template_joins(licenses.TEMPLATES, {}):
        half = join.size // 2
        for part in [text or "", *(text or "").split("\n")]:
            own = word_list(part)
            for s in range(0, max(1, len(own) - half), half):
                window = own[s : s + join.size]
                block = set(window)
                for name in join.sets:
                    template = set(word_list(licenses.TEMPLATES[name])) - licenses.FUNCTION_WORDS
                    share = len(template & block) / len(template)
                    every, names = word_list(licenses.TEMPLATES[name]), set(licenses.NAMES.get(name, ()))
                    if share >= licenses.THRESHOLD - 1e-9 and names <= block and (len(every) >= licenses.IN_ORDER or stands(every, window, names)):
                        found[name] = max(share, found.get(name, 0))
    base = {x for _, x in places}
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(base | set(found))), max([1.0 if base else 0.0, *found.values()])


def texts():
    r = random.Random(4)
    pool = [w for t in licenses.TEMPLATES.values() for w in word_list(t)]
    pieces = [*licenses.TEMPLATES.values(), "MIT license", "Apache\n License", "cc-by", "CC BY", "gnu general public license", "mit licenses", "é mit", "plain words here"]
    out = [None, "", "MIT", "word " * 4000 + licenses.TEMPLATES["isc-text"], "mit license " * 900, "a b MIT\tLicense"]
    for _ in range(250):
        parts = []
        for _ in range(r.randint(1, 5)):
            kind = r.random()
            if kind < 0.3:
                parts.append(" ".join(r.choice(pool) for _ in range(r.randint(1, 60))))
            elif kind < 0.7:
                words = r.choice(pieces).split(" ")
                parts.append(" ".join(w if r.random() > 0.08 else "x" for w in words))
            else:
                parts.append("\n".join(textwrap.wrap(r.choice(pieces), r.randint(20, 90))))
        out.append(r.choice(["\n", " ", ". "]).join(parts))
    return out


def test_query_by_brute_force(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts())]
    rows += [(3, rows[20][1], "x", "y"), (None, "MIT license", "x", "y")]
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    want = sorted(((i, *brute(t)) for i, t, *_ in rows), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_base_by_sql(spark):
    docs = pd.DataFrame({"doc_id": range(len(texts())), "text": texts()})
    db = duckdb.connect()
    db.register("documents", docs)
    phrases = " UNION ALL ".join(f"SELECT {p.split()!r} AS p, '{label}' AS label" for p, label in licenses.PHRASES.items())
    want = db.sql(f"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
        i AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM w),
        f AS (SELECT doc_id, k - 1 AS k, label FROM i, ({phrases}) WHERE list_slice(ws, k, k + len(p) - 1) = p)
        SELECT w.doc_id, len(ws) AS n_words, count(k) AS n_base, min(k) AS first_word, max(k) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
        FROM w LEFT JOIN f USING (doc_id) GROUP BY ALL ORDER BY 1""").fetchall()
    got = licenses.scan(spark.createDataFrame(list(docs.itertuples(index=False, name=None)), "doc_id long, text string"))
    assert [tuple(r) for r in got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").orderBy("doc_id").collect()] == want


@pytest.mark.parametrize("text", ["software released under the license by them", "Licensed under the license version 2 0", "all of it is free", "Permission to go is granted to the person", "all participants have equal rights and a table was reserved", "MIT students released birds near a license office", "licensed plumber paid 4 cc of nc and 0 other", "rights of all are reserved", "the license of MIT was released under protest"])
def test_function_words_give_no_label(text):
    assert not any(join.search(text.lower()) for join in licenses.template_joins(licenses.TEMPLATES, {}))


@pytest.mark.parametrize("text,name", [("x\nReleased under\nthe MIT License. y", "mit-notice"), ("(c) 2020. ALL RIGHTS RESERVED", "all-rights"), ("Licensed under the Apache License 2.0", "apache-notice"), ("Licensed under CC BY-NC 4.0", "cc-by-nc")])
def test_short_notices(text, name):
    assert any(name in join.search(text.lower()) for join in licenses.template_joins(licenses.TEMPLATES, {}))


@pytest.mark.parametrize("name", ["mit-grant", "mit-text", "bsd-text", "apache-header", "gpl-header"])
@pytest.mark.parametrize("width", [30, 72, 80])
@pytest.mark.parametrize("before", [0, 31, 500])
def test_wrapped_notice(name, width, before):
    notice = "\n".join(textwrap.wrap(licenses.TEMPLATES[name], width))
    text = licenses.lower("some line of it\n" * before + notice + "\nand more")
    assert any(name in join.search(text) for join in licenses.template_joins(licenses.TEMPLATES, {}))


def test_ids_of_text(spark):
    got = licenses.scan(spark.createDataFrame([("a", "MIT License"), (None, None)], "doc_id string, text string")).collect()
    assert {(r["doc_id"], r["n_base"]) for r in got} == {("a", 1), (None, 0)}

"""Literal cases for operators and functions."""
import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import facts, ledger, search
from foliospark.operators.filters import Filters


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_fusion_counts_every_hit(spark):
    lexical = spark.createDataFrame([("a", 0, 1), ("b", 0, 2)], "id string, chunk int, rank int")
    semantic = spark.createDataFrame([("b", 7, 1)], "id string, chunk int, rank int")
    got = search.fuse({"lexical": lexical, "semantic": semantic}, 10).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["b", "a"]
    assert (got[0]["lexical_rank"], got[0]["semantic_rank"], got[0]["chunk"]) == (2, 1, 0)


def test_evaluation(spark):
    cases = spark.createDataFrame([("1", ["a"], ["x", "a", "z"]), ("2", ["b"], ["b"]), ("3", ["c"], [])], "case string, expected array<string>, returned array<string>")
    got = {r["case"]: (r["hit"], r["reciprocal_rank"]) for r in search.evaluate(cases, 3).collect()}
    assert got == {"1": (1.0, 0.5), "2": (1.0, 1.0), "3": (0.0, 0.0)}


def test_hash_embedding_is_nearer_for_related_texts(spark):
    df = spark.createDataFrame([(1, "utility bill power"), (2, "power bill for the utility"), (3, "holiday beach photo")], "id long, text string")
    v = {r["id"]: r["vector"] for r in search.hash_embedding(df, 128).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(v[a], v[b], strict=True))
    assert dot(1, 2) > dot(1, 3)


@pytest.mark.parametrize(("text", "want"), [("(1)", -1), ("1-", -1), ("-$1", -1), ("1.234,56", 1234.56), ("1,234.56", 1234.56), ("1,234", 1234), ("1,23", 1.23), ("1.234.567", 1234567), ("x", None)])
def test_amounts(spark, text, want):
    got = value(spark, T.parse_amount(F.lit(text)))
    assert (None if got is None else float(got)) == want


@pytest.mark.parametrize(("days", "confidence", "evidence", "want"), [(-1, 0.9, 1, "overdue"), (10, 0.9, 1, "due_soon"), (45, 0.9, 1, "open"), (10, 0.2, 1, "needs_review"), (10, 0.9, 0, "needs_review")])
def test_deadlines(spark, days, confidence, evidence, want):
    today = F.lit("2024-06-01").cast("date")
    assert value(spark, T.deadline_status(F.date_add(today, days), F.lit(confidence), F.lit(evidence), today)) == want


def test_snippet(spark):
    assert value(spark, search.snippet(F.lit("a <b>bold</b> word"))) == "a bold word"
    assert value(spark, search.snippet(F.lit(None).cast("string"))) is None


def test_filters():
    with pytest.raises(ValueError):
        Filters(date_from="2024-02-01", date_to="2024-01-01")
    assert Filters(families=("a",)).intersect(Filters(families=("b",))) is None
    assert Filters(chars_min=5).intersect(Filters(chars_max=3)) is None
    assert Filters(has_relationships=True).intersect(Filters(has_relationships=False)) is None
    with pytest.raises(ValueError):
        Filters(text="a").intersect(Filters(text="b"))
    assert Filters(families=("a", "b"), chars_min=5).intersect(Filters(families=("b",), chars_min=7)) == Filters(families=("b",), chars_min=7)


def test_duplicates_need_an_admissible_first(spark):
    df = spark.createDataFrame([(1, "x", 0), (2, "x", 1), (3, "x", 1), (4, "y", 0)], "pos int, fp string, ok int")
    got = {r["pos"]: r["reason"] for r in facts.admit(df, [("bad", F.col("ok") == 0)], F.col("fp"), "pos").collect()}
    assert got == {1: "bad", 2: None, 3: "duplicate", 4: "bad"}


def test_rules(spark):
    df = spark.createDataFrame([(1, "Utility ", "12", ["a"], "x"), (2, None, "abc", [], ""), (3, "utility", "9", None, None)], "id int, document_family string, amount_total string, tags array<string>, counterparty string")
    one = lambda name, field, op, value=None: {"name": name, "conditions": [{"field": field, "op": op, "value": value}], "actions": [{"type": "add_tag", "tag": "t"}]}
    rules = [one("eq", "document_family", "eq", "utility"), one("gte", "amount_total", "gte", "10"), one("lte", "amount_total", "lte", 10), one("text", "amount_total", "lte", "ab"), one("neq", "document_family", "neq", "x"), one("tags", "tags", "exists"), one("party", "counterparty", "exists"), one("any", "tags", "contains", "A"), one("re", "document_family", "regex", "^UTIL")]
    got = {}
    for i, r in facts.match_rules(df, rules, lists=("tags",)).collect():
        got.setdefault(r, set()).add(i)
    assert got == {"eq": {1, 3}, "gte": {1, 2}, "lte": {2, 3}, "text": {2}, "neq": {1, 2, 3}, "tags": {1}, "party": {1}, "any": {1}, "re": {1, 3}}


@pytest.mark.parametrize("change", [{"name": " "}, {"priority": 101}, {"conditions": []}, {"actions": []}, {"conditions": [{"field": "color", "op": "eq", "value": 1}]}, {"conditions": [{"field": "tags", "op": "like", "value": 1}]}, {"conditions": [{"field": "tags", "op": "eq"}]},
    {"conditions": [{"field": "tags", "op": "regex", "value": "(a+)+$"}]}, {"conditions": [{"field": "tags", "op": "regex", "value": "x" * 129}]}, {"conditions": [{"field": "tags", "op": "regex", "value": "("}]}, {"actions": [{"type": "add_folder"}]}, {"actions": [{"type": "set_sensitivity", "value": "secret"}]}, {"actions": [{"type": "burn"}]}])
def test_bad_rules(change):
    good = {"name": "n", "conditions": [{"field": "canonical.total", "op": "exists"}], "actions": [{"type": "create_review_task"}]}
    assert facts.checked_rule(good)["actions"][0]["value"] == "Review suggested filing."
    with pytest.raises(ValueError):
        facts.checked_rule(good | change)


@pytest.mark.parametrize(("text", "want"), [("2024-3-5", "2024-03-05"), ("3/5/24", "2024-03-05"), ("3/5/70", "1970-03-05"), ("5-Mar-2024", "2024-03-05"), ("due March 5, 2024.", "2024-03-05"), ("on 1-Jan-2020 or 2024-03-05", "2024-03-05"), ("13/45/2024", None), ("", None), (None, None)])
def test_days(spark, text, want):
    got = value(spark, T.parse_day(F.lit(text).cast("string")))
    assert (None if got is None else str(got)) == want


@pytest.mark.parametrize(("attempt", "want"), [(0, 30), (1, 30), (2, 60), (7, 1920), (8, 3600), (28, 3600), (4000, 3600)])
def test_back_off(spark, attempt, want):
    assert value(spark, T.retry_delay(F.lit(attempt))) == want


@pytest.mark.parametrize(("name", "want"), [("Jörg  Müller", "jörg müller"), ("A-B & Co.", "a b co"), (" .. ", None), ("x" * 241, None), ("Straße", "strasse")])
def test_contact_names(spark, name, want):
    assert value(spark, T.contact_name(F.lit(name))) == want


def test_zero_vectors(spark):
    df = spark.createDataFrame([(1, 0, [0.0, 0.0]), (2, 0, [0.0, 2.0]), (3, 0, [1.0, 0.0])], "id int, chunk int, embedding array<double>")
    got = search.semantic(search.unit_vectors(df), [0.0, 5.0], 10).collect()
    assert [(r["id"], r["score"]) for r in got] == [(2, 1.0), (3, 0.0)]
    with pytest.raises(ValueError):
        search.semantic(df, [0.0, 0.0], 10)


def test_gates_fail_on_what_is_not_finite(spark):
    m = spark.createDataFrame([("a", float("inf")), ("b", float("nan")), ("c", 1.0)], "metric string, value double")
    t = spark.createDataFrame([(x, "min", 0.5) for x in "abcd"], "metric string, direction string, threshold double")
    assert {r["metric"] for r in ledger.gate(m, t).filter("passed").collect()} == {"c"}


def test_index_and_access(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 0, "idiot words here"), (2, 0, "idiot idiot"), (2, 1, "nothing"), (3, 0, None)], "id long, chunk int, text string")
    search.build_index(chunks, str(tmp_path / "x"))
    index = search.open_index(spark, str(tmp_path / "x"))
    assert index.chunks == 4
    assert [r["id"] for r in search.bm25(index, ["idiot", "absent"], 5).collect()] == [2, 1]
    assert [r["id"] for r in search.bm25(index, ["idiot"], 5, spark.createDataFrame([(1,)], "id long")).collect()] == [1]


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([("g", 1, "x"), ("g", 2, None)], "g string, a int, b string")
    one = ledger.fingerprint(a, "g", "a", "b").first()["fingerprint"]
    assert one == ledger.fingerprint(a.orderBy(F.desc("a")), "g", "a", "b").first()["fingerprint"]

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from quillon.functions import encoding, nested, text


def test_hash_value():
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert encoding.hash_value("a") == sha("a")
    assert encoding.hash_value(1) == sha("<int>1") and encoding.hash_value(True) == sha("<int>True")
    assert encoding.hash_value(1.0) == sha("<float>1.0") and encoding.hash_value(None) == sha("<NoneType>None")
    assert encoding.hash_value([1, 2]) == encoding.hash_value((1, 2)) != encoding.hash_value([2, 1])
    assert encoding.hash_value({"a": 1, "b": 2}) == encoding.hash_value({"b": 2, "a": 1})


@pytest.mark.parametrize(
    ("url", "masked"),
    [
        ("mongodb://testuser:testpass@host:1/db", "mongodb://te******er:te******ss@host:1/db"),
        ("x://:secretpw@h", "x://:se******pw@h"),
        ("plain://host/db", "plain://host/db"),
        ("", ""),
        (None, None),
    ],
)
def test_anonymize(spark, url, masked):
    assert encoding.anonymize_url(url) == masked
    if url and "testuser" in url:
        rows = spark.createDataFrame([(url,)], "u string")
        assert rows.select(encoding.anonymize_url_column(F.col("u"))).first()[0] == masked


def test_nested_values():
    left, right = {"a": {"b": 1, "c": 2}, "d": [1]}, {"a": {"b": 1, "c": 3}, "e": 5}
    assert nested.dict_diff(left, right) == {"a.c": (2, 3), "d": ([1], None), "e": (None, 5)}
    assert nested.deep_update(left, {"a": {"c": 9}}) == {"a": {"b": 1, "c": 9}, "d": [1]} and left["a"]["c"] == 2
    assert nested.deep_items(left) == {"a.b": 1, "a.c": 2, "d": [1]}
    assert nested.deep_get(left, "a.c") == 2
    assert nested.document_diff({"x": 1, "y": "a"}, {"x": 2, "y": "a"}) == {"x": 2}
    assert nested.map_leaves({"a": [1, "x"], "b": (2,)}, lambda v: v + 1, lambda v: isinstance(v, int)) == {"a": [2, "x"], "b": (3,)}
    assert nested.find_leaves({"a": [1, {"b": 5}], "c": "s"}, lambda v: isinstance(v, int)) == [1, 5]


def test_references_and_variables():
    class Thing:
        size = 4

    known = {"m": Thing(), "d": {"k": [1]}}
    assert nested.fill_references({"a": "?(m.size)", "b": "size ?(m.size)!", "c": "?(d.k)", "e": "?(no.way)"}, known) == {"a": 4, "b": "size 4!", "c": [1], "e": "?(no.way)"}
    value = {"<var:k>": ["<var:n>", "n is <var:n>", ("<var:other>",)]}
    assert nested.variables_in(value) == {"k", "n", "other"}
    assert nested.set_variables(value, k="key", n=3) == {"key": [3, "n is 3", ("<var:other>",)]}


def test_prompts():
    assert text.format_prompt("hi", "Say {input}") == "Say hi"
    assert text.format_prompt("hi{}", "Say: ") == "Say: hi{}"
    assert text.format_prompt("q", "{context}? {input}", ["a", "b"]) == "a\nb? q"
    with pytest.raises(ValueError):
        text.format_prompt("q", "{context} {input}")


def test_text_columns(spark):
    rows = spark.createDataFrame([("  a b\tc\nd e ", ["x", "y"]), ("", ["z"]), (None, None)], "t string, c array<string>")
    got = [r[0] for r in rows.select(text.chunks(F.col("t"), 2)).collect()]
    assert got[:2] == [["a b", "c d", "e"], []]
    assert rows.filter("c[0] = 'x'").select(text.prompt_column(F.col("t"), "{context}|", F.col("c"))).first()[0] == "x\ny|  a b\tc\nd e "
    with pytest.raises(Exception, match="needs a context"):
        rows.select(text.prompt_column(F.col("t"), "{context}", F.col("c"))).collect()
    prompt = rows.filter("c[0] = 'x'").select(text.retrieval_prompt(F.lit("Q"), F.col("c"))).first()[0]
    assert prompt == "\n---\n".join([text.EXPLANATION, "x", "y", text.INTRODUCTION, "Q"])


def test_rows_as_json(spark):
    rows = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.5)], "i int, x double")
    assert [r["x"] for r in encoding.for_json(rows).orderBy("i").collect()] == [None, None, 1.5]
    assert rows.select(encoding.json_decode(F.lit("{bad"), None).alias("v")).first()["v"] is None

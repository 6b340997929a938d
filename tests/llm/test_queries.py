"""The registered queries over whole test tables: columns, types, and results by plainer means."""

from __future__ import annotations

import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

from quillon.llm import queries
from tests.llm.test_classifiers import auc
from tests.llm.test_html import extract
from tests.llm.test_simhash import brute_components, brute_print
from tests.llm.test_tokens import BYTES, check_packing, library

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the test tables aren't here")

COLUMNS = {
    "op1": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op2": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op3": "doc_id bigint, fingerprint string, component_id bigint",
    "op4": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5": "page_id bigint, url string, text string, n_chars bigint",
    "op6": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op7": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op8": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9": "page_id bigint, host string, path string, rule string, verdict string",
    "op10": "doc_id bigint, held_out boolean, lang_pred string, score double",
}


@pytest.fixture(scope="module")
def results(spark):
    return {name.split("_")[0]: f(spark, SF) for name, f in queries.queries().items()}


@pytest.fixture(scope="module")
def tables():
    return {t: duckdb.sql(f"SELECT * FROM '{SF}/{t}.parquet'").fetchall() for t in ("documents", "labels", "pages")}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(results, name):
    assert ", ".join(f"{c} {t}" for c, t in results[name].dtypes) == COLUMNS[name]


def test_sql_gives_the_same(results):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        rows = results[name.split("_")[0]]
        got = sorted(tuple(r) for r in rows.collect())
        found = db.execute(sql)
        order = [[c[0] for c in found.description].index(c) for c in rows.columns]
        assert got == sorted(tuple(r[i] for i in order) for r in found.fetchall())


def test_tokens(results, tables):
    rows = {r["doc_id"]: r for r in results["op7"].collect()}
    start = 0
    for name, text, *_ in sorted(tables["documents"]):
        ids = [*library(BYTES, text), 2]
        assert tuple(rows[name]) == (name, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    check_packing(results["op2"].collect(), {r[0]: r[1] for r in tables["documents"]}, 2048, 1)


def test_fingerprints(results, tables):
    prints = {r[0]: brute_print(r[1], 3) for r in tables["documents"]}
    ids = list(prints)
    label = brute_components(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2])
    assert {tuple(r) for r in results["op3"].collect()} == {(i, f"{prints[i]:016x}", label[i]) for i in ids}


def test_pages(results, tables):
    want = {p: (u, extract(h)) for p, u, h in tables["pages"]}
    assert {r["page_id"]: (r["url"], r["text"]) for r in results["op5"].collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in results["op5"].collect())


def test_hosts_paths_and_rules(results, tables):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    rows = {r["page_id"]: r for r in results["op9"].collect()}
    assert len(rows) == len(tables["pages"])
    for name, url, _ in tables["pages"]:
        rest = (url or "").partition("://")[2]
        given = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(given) :], maxsplit=1)[0]
        host = "".join(c.lower() if c.isascii() else c for c in given)
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, None))
        assert tuple(rows[name])[:4] == (name, host, path, rule)
        assert rows[name]["verdict"] == verdict if rule else rows[name]["verdict"] in ("allow", "block")


@pytest.mark.parametrize(("name", "column", "mod", "rest", "least"), [("op8", 1, 3, 1, 0.9), ("op4", 2, 4, 2, 0.5)])
def test_classifiers(results, tables, name, column, mod, rest, least):
    labels = {r[0]: r[column] for r in tables["labels"]}
    rows = {r["doc_id"]: r for r in results[name].collect()}
    assert set(rows) == {r[0] for r in tables["documents"]}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % mod == rest) for i, r in rows.items())
    threshold = 0.5 if name == "op8" else 0.3
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= threshold) for r in rows.values())
    held = [i for i in labels if rows[i]["held_out"]]
    assert auc([labels[i] for i in held], [rows[i]["score"] for i in held]) >= least


def test_languages(results, tables):
    rows = {r["doc_id"]: r for r in results["op10"].collect()}
    held = [(r[0], r[2]) for r in tables["documents"] if rows[r[0]]["held_out"]]
    assert np.mean([rows[i]["lang_pred"] == lang for i, lang in held]) > 0.95

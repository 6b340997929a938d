from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import langid, quality, toxicity
from quillon.llm.linear import lasso_logistic, ridge_logistic


def remainder(i, mod):
    return zlib.crc32(str(i).encode()) % mod


def auc(y, s):
    y, s = np.array(y), np.array(s)
    return np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])


def clean_text(rng, n=60):
    return " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(n)).capitalize() + "."


def junk_text(rng):
    word = clean_text(rng, 1)
    return rng.choice([" ".join([word] * 40), " | ".join(clean_text(rng, 30).split()), " ".join(w + "$$$" for w in clean_text(rng, 30).split())])


def table(spark, rows, labels, column):
    docs = spark.createDataFrame([(i, t, "en", "s", 1.0, "x") for i, t in rows], "doc_id long, text string, lang string, source string, score double, predicted string")
    own = spark.createDataFrame([(i, y, 0) for i, y in labels], f"doc_id long, {column} int, other int")
    return docs, own


def test_quality(spark):
    rng = random.Random(1)
    rows = [(i, clean_text(rng) if i % 3 else junk_text(rng)) for i in range(300)]
    docs, labels = table(spark, [*rows, (300, None), (301, ""), (302, "x" * 100_000), (None, "a b")], [(i, int(i % 3 > 0)) for i in range(300)] + [(None, 1), (5, None)], "quality")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r["s"] for r in quality.scored(docs, model, "s").collect()}
    held = [i for i in range(300) if remainder(i, 3) == 1]
    assert auc([i % 3 > 0 for i in held], [got[i] for i in held]) > 0.98
    assert len(got) == 304 and all(0 <= s <= 1 for s in got.values())
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 100 < kept.count() < 304
    assert 0 < len(model.rules) < 200


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0)]])
def test_one_class(spark, labels):
    docs, own = table(spark, [(1, "a"), (2, None)], labels, "quality")
    scores = {r["s"] for r in quality.scored(docs, quality.fit(docs, own, held_out=9), "s").collect()}
    assert len(scores) == 1 and 0 < scores.pop() < 1
    docs, own = table(spark, [(1, "a"), (2, None)], labels, "toxic")
    scores = {r["s"] for r in toxicity.scored(docs, toxicity.fit(docs, own, held_out=9), "s").collect()}
    assert len(scores) == 1 and 0 < scores.pop() < 1


def test_rule_column_equals_rules(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 2] <= 0.6)).astype(float)
    model = quality.fit_rules(x, y)
    z = model.intercept + sum(w * quality.holds(r, x) for r, w in model.rules)
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], ["i", *quality.STATISTICS]).select("i", F.struct(*quality.STATISTICS).alias("st"))
    got = {r["i"]: r["s"] for r in frame.select("i", model.column("st").alias("s")).collect()}
    assert np.allclose([got[i] for i in range(400)], 1 / (1 + np.exp(-z)))
    assert ((z > 0) == (y > 0)).mean() > 0.97


def test_toxicity(spark):
    rng = random.Random(2)
    bad = ["dreadful", "horridly", "bloomin"]
    stem = "zzgrot"

    def toxic(i):
        words = clean_text(rng).split()
        for _ in range(3):
            words.insert(rng.randrange(len(words)), rng.choice([*bad, stem + rng.choice(["ab", "cde", "fgh", "xi"])]))
        return " ".join(words)

    rows = [(i, toxic(i) if i % 4 == 0 else clean_text(rng)) for i in range(600)]
    rows += [(600, "so Dreadfull and horidly bloomin " + clean_text(rng)), (601, None), (602, ""), (603, clean_text(rng, 5000))]
    docs, labels = table(spark, rows, [(i, int(i % 4 == 0)) for i in range(600)], "toxic")
    model = toxicity.fit(docs, labels)
    assert set(bad) <= set(model.lexicon.words) and any(stem.startswith(s) or s.startswith(stem) for s in model.lexicon.stems)
    got = {r["doc_id"]: r["s"] for r in toxicity.scored(docs, model, "s").collect()}
    held = [i for i in range(600) if remainder(i, 4) == 2]
    assert auc([i % 4 == 0 for i in held], [got[i] for i in held]) > 0.98
    assert got[600] >= 0.3 > max(got[601], got[602], got[603])


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        below = [i]
        for j, y in enumerate(b, 1):
            below.append(min(row[j] + 1, below[-1] + 1, row[j - 1] + (x != y)))
        row = below
    return row[-1]


def test_automaton_is_levenshtein():
    from quillon.llm.common import Words, text_buffers
    import pyarrow as pa

    rng = random.Random(3)
    terms = ["idiots", "clown", "worthlessness", "bad", "worth"]
    words = ["".join(rng.choice("abdhilnorstw") for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    for t in terms:
        for _ in range(60):
            w = list(t)
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randrange(2)] = rng.choice(["", "a", "s"])
            words.append("".join(w) or "a")
    raw, offsets = text_buffers(pa.array(words))
    found = Words(raw, offsets)
    auto = toxicity.Automaton(terms, ["stem"])
    grades = auto.run(found.text, found.starts, found.ends)
    for w, g in zip(words, grades):
        near = any(edits(w, t) <= toxicity.edits_allowed(t) for t in terms)
        want = toxicity.Automaton.EXACT if w in terms else toxicity.Automaton.STEMMED if w.startswith("stem") else toxicity.Automaton.FUZZY if near else 0
        assert g == want, w


def test_quotation_is_told_from_abuse():
    from quillon.llm.common import text_buffers
    import pyarrow as pa

    raw, offsets = text_buffers(pa.array(['He said "you clown" today', "you clown today", 'open " clown', "“clown” x\n clown", "he called: clown"]))
    x = toxicity.features(raw, offsets, toxicity.Lexicon(("clown",)))
    quoted = x[:, toxicity.FEATURES.index("quoted")] > 0
    abuse = x[:, toxicity.FEATURES.index("abuse")] > 0
    assert quoted.tolist() == [True, False, False, True, True]
    assert abuse.tolist() == [False, True, True, True, False]


def test_near_misses_of_clean_texts_are_no_misspellings(spark):
    rng = random.Random(6)
    rows = [("trashy talk", 0), ("thrash it", 0), ("trasho", 0), ("dreadfull", 0)] + [(clean_text(rng, 20), 0) for _ in range(20)]
    sample = spark.createDataFrame(rows, "text string, label int")
    lexicon = toxicity.with_misspellings(sample, ["dreadful", "trash", "worthless"], [])
    assert lexicon.exact >= {"trash"} and "worthless" not in lexicon.exact and "dreadful" not in lexicon.exact and "dreadfull" in lexicon.known

    from quillon.llm.common import text_buffers
    import pyarrow as pa

    raw, offsets = text_buffers(pa.array(["trashi", "dreadfull", "dreadfu1", "w0rthless", "trash"]))
    assert toxicity.features(raw, offsets, lexicon)[:, 0].tolist() == [0, 0, 0.7, 0.7, 1]


LANGUAGES = {"en": "the and of tion with that this", "de": "der die und schen ung nicht über", "fr": "les des une tion que être où", "es": "los las una ción que señor más", "xx": "qqa zzo kkw vvu"}


def test_language(spark):
    rng = random.Random(4)
    text = lambda lang, n: " ".join(rng.choice(LANGUAGES[lang].split()) for _ in range(n)) + "."
    rows = [(i, text(lang, rng.choice([3, 20, 80])), lang) for i, lang in enumerate(rng.choice(list(LANGUAGES)) for _ in range(500))]
    rows += [(900, None, "en"), (901, "", "en"), (902, "123 ... !", "de"), (903, "the and", None), (904, "the and", ""), (None, "der und die nicht", "de")]
    docs = spark.createDataFrame([(i, t, lang, 1, "p") for i, t, lang in rows], "doc_id long, text string, lang string, n_chars long, _language string")
    model = langid.fit(docs)
    assert sorted(sum(model.families, [])) == sorted(LANGUAGES) and ["de", "en"] in model.families
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predicted(docs.drop("lang"), model).collect()}
    held = [(i, lang) for i, _, lang in rows[:500] if remainder(i, 3) == 1]
    assert np.mean([got[i][0] == lang for i, lang in held]) > 0.97
    assert [got[i] for i in (900, 901, 902)] == [("und", 0.0)] * 3 and got[None][0] == "de"
    assert all(0 <= s <= 1 for _, s in got.values())
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id in (900, 901, 902)").count() == 0
    nothing = langid.predicted(docs, langid.fit(docs.limit(0)))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    assert langid.predicted(docs.limit(0), model).collect() == []


def test_a_much_repeated_id_is_learned_once(spark):
    from quillon.llm.common import labelled_rows

    rng = random.Random(7)
    few = [(i, clean_text(rng, 60) if i % 2 else junk_text(rng)) for i in range(60)]
    docs = spark.createDataFrame(few, "doc_id long, text string").unionByName(spark.range(100_000).selectExpr("cast(3 as long) as doc_id", "concat('text ', id % 7) as text"))
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(60)] + [(3, 0, 0)] * 5, "doc_id long, quality int, toxic int")
    rows = labelled_rows(docs, labels, "quality", 3, 1, 30)
    got = rows.collect()
    assert len(got) == 30 and len({r["doc_id"] for r in got}) == 30
    assert sorted(map(tuple, got)) == sorted(map(tuple, rows.collect()))
    assert quality.fit(docs, labels).rules is not None
    assert quality.scored(docs.limit(0), quality.fit(docs, labels)).collect() == []
    assert toxicity.scored(docs.limit(0), toxicity.fit(docs, labels)).collect() == []


def test_a_language_of_one_document_is_learned(spark):
    rng = random.Random(4)
    text = lambda lang: " ".join(rng.choice(LANGUAGES[lang].split()) for _ in range(40))
    german = text("de")
    one = next(i for i in range(1, 50) if remainder(i, 3) != 1)
    rows = spark.createDataFrame([(i, text("en"), "en") for i in range(100, 1100)], "doc_id long, text string, lang string")
    again = spark.range(100_000).select(F.lit(one).cast("long").alias("doc_id"), F.lit(german).alias("text"), F.lit("de").alias("lang"))
    model = langid.fit(rows.unionByName(again))
    assert sorted(sum(model.families, [])) == ["de", "en"]
    assert {r["lang_pred"] for r in langid.predicted(again.limit(3).drop("lang"), model).collect()} == {"de"}


def test_accents_are_one_edit():
    from quillon.llm.common import text_buffers
    import pyarrow as pa

    raw, offsets = text_buffers(pa.array(["pendéjo", "pendejo", "péndéjo", "crétin", "cretin", "日本"]))
    x = toxicity.features(raw, offsets, toxicity.Lexicon(("pendejo", "crétin")))
    assert x[:, 0].tolist() == [0.7, 1, 0, 1, 0.7, 0]


def test_linear_fits():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 6))
    y = (x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=500) > 0).astype(float)
    w, b = lasso_logistic(x, y, 0.02)
    assert w[0] > 0.5 > -0.5 > w[1] and np.abs(w[2:]).max() < 0.2
    w, b = ridge_logistic(x, y, 1e-3)
    assert (((x @ w + b) > 0) == (y > 0)).mean() > 0.97

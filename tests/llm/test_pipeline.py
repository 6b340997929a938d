from __future__ import annotations

import random

import corpus_pipeline
from quillon.llm import langid, quality
from tests.llm.test_classifiers import clean_text, junk_text
from tests.llm.test_decontam import brute
from tests.llm.test_simhash import brute_components, jaccard
from tests.llm.test_tokens import check_packing


def corpus(spark, folder):
    rng = random.Random(8)
    item = clean_text(rng, 30)
    texts = [clean_text(rng, rng.choice([30, 200])) for _ in range(120)]
    for t in texts[:20]:
        w = t.split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += texts[:10] + [clean_text(rng, 20) + " " + item + " " + clean_text(rng, 20) for _ in range(5)]
    texts += [junk_text(rng) for _ in range(40)] + ["12345 67890 " * 10, None, ""]
    rows = [(i, t, "en" if i % 2 else "de", "src0", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    good = len(texts) - 43
    spark.createDataFrame([(i, int(i < good), 0) for i in range(0, good + 40) if i % 5], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {r[0]: r[1] for r in rows}, item, good


def test_every_stage_against_brute_force(spark, tmp_path):
    texts, item, good = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()} if "text" in docs.columns else {}
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            check_packing(after.collect(), before, 2048, 1)
            break
        assert after.columns == docs.columns
        kept[name] = {r["doc_id"] for r in after.collect()}
        if name == "quality":
            scores = quality.scored(docs, quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")), "s").collect()
            assert kept[name] == {r["doc_id"] for r in scores if r["s"] >= 0.5}
            assert len(kept[name] & set(range(good))) > 0.97 * good and len([i for i in range(good, good + 40) if i in kept[name]]) <= 2
        elif name == "language":
            found = langid.predicted(docs, langid.fit(docs)).collect()
            assert kept[name] == {r["doc_id"] for r in found if r["lang_pred"] != "und" and r["score"] >= 0.5}
        elif name == "near_dedup":
            pairs = [(a, b) for a in before for b in before if a < b and jaccard(before[a], before[b]) >= 0.8]
            label = brute_components(before, pairs)
            assert kept[name] == set(label.values())
        else:
            assert kept[name] == {i for i, t in before.items() if not brute(t, [(1, item)])[4]}
            assert len(kept[name]) < len(before)
        docs = after
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == after.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_dedup", "decontaminate", "packing"]


def test_edges_of_the_stages(spark, tmp_path):
    rng = random.Random(2)
    corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = docs.withColumnRenamed("source", "_statistics").withColumnRenamed("n_chars", "_quality")
    own = clean_text(rng, 60)
    odd = spark.createDataFrame([(None, own, "en", "s", 1), (None, None, None, None, None), (3, own, "en", "s", 1), (3, own, "en", "s", 1), (2, own + " more words", None, "s", 1)], kept.schema)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.collect() == []
        out = stage(spark, kept.unionByName(odd), str(tmp_path))
        if name != "packing":
            assert out.columns == kept.columns and empty.columns == docs.columns
        assert all(f.__doc__ for _, f in corpus_pipeline.STAGES)
        found = [r["doc_id"] for r in out.filter("doc_id is null or doc_id = 3").collect()]
        # Whether a null text is good follows from the labels; it has no language.
        assert found.count(None) in {"quality": (1, 2), "language": (1,)}.get(name, (2,))
        if name == "near_dedup":
            assert out.filter("doc_id = 3").count() == 2  # the corpus' own text of that id, and the repeated one

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillon.operators import models, training
from quillon.operators.retries import reconnecting, retried


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, float(i), f"t{i}") for i in range(6)], "x long, y double, s string")


def test_signatures():
    assert models.signature(lambda x: x) == "singleton"
    assert models.signature(lambda x, y: x) == "*args"
    assert models.signature(lambda x=1, y=2: x) == "**kwargs"
    assert models.signature(lambda x, y=2: x) == "*args,**kwargs"
    assert [models.key_shape(k) for k in ("x", ("x", "y"), {"a": "x"}, (("x",), {"b": "y"}), None)] == ["singleton", "*args", "**kwargs", "*args,**kwargs", "singleton"]


@pytest.mark.parametrize(
    ("function", "key"),
    [
        (lambda a: a * 2 + a, "x"),
        (lambda a, b: a * 2 + int(b), ("x", "y")),
        (lambda a=0, b=0: a * 2 + int(b), {"a": "x", "b": "y"}),
        (lambda a, b=0: a * 2 + int(b), (("x",), {"b": "y"})),
        (lambda row: row["x"] * 2 + int(row["y"]), None),
    ],
)
def test_keys(rows, function, key):
    out = models.Model("m", function, "int").predict_in(rows, key, "p")
    assert [r["p"] for r in out.orderBy("x").collect()] == [3 * i for i in range(6)]


def test_key_that_does_not_fit(rows):
    with pytest.raises(ValueError, match="doesn't fit"):
        models.Model("m", lambda a, b: a, "int").predict_in(rows, "x")
    with pytest.raises(ValueError, match="doesn't fit"):
        models.Model("m", lambda a=1: a, "int").predict_in(rows, {"zz": "x"})


def test_types_and_flatten(rows):
    vec = models.Model("v", lambda a: [a, a + 1], "vector[float:2]").predict_in(rows, "y", "v").orderBy("x").first()["v"]
    assert vec == [0.0, 1.0]
    doc = models.Model("j", lambda a: {"k": a}, "json").predict_in(rows, "x", "j").orderBy("x").first()["j"]
    assert doc == '{"k": 0}'

    def typed(a) -> int:
        return a

    assert models.Model("t", typed).output == "int" and models.Model("t", lambda a: a).output == "str"
    flat = models.Model("f", lambda a: [a] * a, "int").predict_flat(rows, "x", "p")
    assert flat.count() == 15 and flat.filter("x = 5").agg(F.max("position")).first()[0] == 4

    class Thing:
        def score(self, a):
            return a + 0.5

    assert models.Model("o", Thing(), "float", method="score").predict(1) == 1.5


def test_sequential_and_validate(rows):
    chain = models.Sequential("c", [models.Model("a", lambda x: x + 1, "int"), models.Model("b", lambda x: x + 2, "int")])
    assert chain.predict(1) == 4 and chain.output == "int"
    assert [r["p"] for r in chain.predict_in(rows, "x", "p").orderBy("x").collect()] == [3, 4, 5, 6, 7, 8]
    model = models.Model("m", lambda x: 1 if x != 1 else 2, "int")
    truth = rows.filter("x < 4").withColumn("target", F.lit(1).cast("long"))
    python = models.Metric("p", function=lambda p, y: sum(a == b for a, b in zip(p, y)) / len(p))
    assert model.validate(truth, "x", "target", [models.ACCURACY, python]) == {"accuracy": 0.75, "p": 0.75}
    model.append_metrics({"loss": 0.5})
    model.append_metrics({"loss": 0.4})
    assert model.metrics == {"loss": [0.5, 0.4]}


def test_services(rows, monkeypatch):
    monkeypatch.setenv("HOST", "example.org")
    calls = []
    api = models.ApiModel("a", "https://{HOST}/{x}", lambda url, v: calls.append(url) or {"out": url}, postprocess=lambda r: r["out"], tries=1)
    assert api.predict(x=3) == "https://example.org/3"
    with pytest.raises(KeyError):
        models.ApiModel("a", "https://{MISSING}", lambda u, v: u, tries=1).predict()
    llm = models.LanguageModel("l", lambda p: p[::-1], prompt="{context}:{input}")
    assert llm.predict("ab", ["c"]) == "ba:c"
    assert models.LanguageModel("l", lambda p: p).predict([{"role": "user", "content": "hi"}]) == "user: hi"
    assert models.LanguageModel("l", lambda p: 1 / 0, errors="empty").predict("x") == ""
    embed = models.EmbeddingModel("e", lambda texts: [(i, [float(len(t)), 1.0]) for i, t in reversed(list(enumerate(texts)))], 2, batch=2)
    assert [r["v"] for r in embed.predict_in(rows.withColumn("s", F.repeat("s", F.col("x").cast("int"))), "s", "v").orderBy("x").limit(3).collect()] == [[0.0, 1.0], [2.0, 1.0], [4.0, 1.0]]
    v = models.hashed_embedding(8)(["a b", "b A", ""])
    assert v[0] == v[1] and abs(sum(x * x for x in v[0]) - 1) < 1e-9 and v[2] == [0.0] * 8
    rag = models.retrieval_model("r", lambda q: ["f1", "f2"], models.Model("echo", lambda p: p, "str"), "{context}|{query}")
    assert rag.predict("q") == "f1\n\nf2|q"


def test_query_model(spark, tmp_path):
    from quillon import connect

    db = connect(spark, f"file://{tmp_path}/q")
    db.create_table("t", {"x": "int"})
    db["t"].insert([{"x": i} for i in range(5)])
    t = db["t"]
    model = models.QueryModel("q", t.filter(t["x"] > "<var:least>").select("x"), postprocess=lambda rows: sorted(r["x"] for r in rows))
    assert model.predict(least=2) == [3, 4]
    with pytest.raises(ValueError):
        model.predict()


def test_training(spark):
    h = training.History("loss", patience=2)
    saved = []
    training.steps(lambda k: {"loss": [3, 2, 4, 5, 6, 1][k]}, h, 6, saved.append)
    assert saved == [0, 1] and h.values["loss"] == [3, 2, 4, 5]
    rows = spark.range(1000).withColumn("_fold", training.fold_column("id", 0.2))
    n = training.in_fold(rows, "valid").count()
    assert 150 < n < 250 and training.in_fold(rows, "train").count() == 1000 - n and training.in_fold(rows, None).count() == 1000
    fitted = training.LocalTrainer(lambda x, y: (sum(x), sum(y)), limit=10).fit(rows.withColumn("y", F.lit(1)), "id", "y", "id")
    assert fitted[1] == 10


def test_retries():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("no")
        return "ok"

    assert retried(flaky, tries=3, sleep=waits.append) == "ok" and len(waits) == 2 and waits[1] > waits[0]
    with pytest.raises(ZeroDivisionError):
        retried(lambda: 1 / 0, tries=2, sleep=waits.append)
    state = {"ok": False}

    def call():
        if not state["ok"]:
            raise RuntimeError("Token has expired")
        return 1

    assert reconnecting(call, lambda: state.update(ok=True)) == 1
    with pytest.raises(RuntimeError):
        reconnecting(lambda: (_ for _ in ()).throw(RuntimeError("other")), lambda: None)


def test_language_model_input(rows):
    model = models.LanguageModel("echo", str.upper)
    assert model.predict("a") == "A" and model.predict(None) is None
    assert model.predict([{"role": "user", "content": "x"}]) == "USER: X"
    for wrong in (3, ["a"], {"role": "user"}):
        with pytest.raises(ValueError, match="takes a text"):
            model.predict(wrong)


def test_language_model_outputs(rows):
    several = models.LanguageModel("twice", lambda p: [p, p + "!"], several=True)
    assert several.predict("a") == ["a", "a!"]
    assert several.predict_in(rows.filter("x = 1"), "s", "out").first()["out"] == '["t1", "t1!"]'
    assert models.LanguageModel("one", lambda p: [p], several=True).predict("a") == "a"


def test_embedding_model_tries_and_probes():
    asked = []

    def embed(texts):
        asked.append(len(texts))
        if len(asked) == 2:
            raise OSError("busy")
        return [(i, [float(len(t)), i]) for i, t in reversed(list(enumerate(texts)))]

    model = models.EmbeddingModel("e", embed, batch=2, postprocess=lambda v: [v[0] / 2, v[1]])
    assert model.dimensions == 2 and model.output == "vector[float:2]"
    assert model.predict_batch([([t], {}) for t in ("a", "bb", "ccc")]) == [[0.5, 0.0], [1.0, 1.0], [1.5, 0.0]]
    assert asked == [1, 2, 2, 1]
    with pytest.raises(ValueError, match="gave 1 vectors for 2"):
        models.EmbeddingModel("short", lambda t: [[0.0]], 1).predict_batch([(["a"], {}), (["b"], {})])


def test_hashed_words_that_cancel():
    """w0 and w55 take the same place with opposite signs."""
    embed = models.hashed_embedding(16)
    parts = [embed([w])[0] for w in ("w0", "w55")]
    assert not any(map(sum, zip(*parts)))
    both, one, none = embed(["w0 W55", "w0", " -- "])
    assert sum(x * x for x in both) == 1 and one == parts[0] and not any(none)
    assert all(any(v) for v in models.hashed_embedding(1)([f"w{i} w{j}" for i in range(9) for j in range(9)]))
    assert models.hashed_embedding(4, r"(?a)\w+")(["\u212a \u0130 \u65e5"]) == [[0.0] * 4]


def test_embedding_query_and_its_sql(spark, tmp_path):
    """texts whose words cancel, and texts without a word of ASCII characters."""
    import duckdb

    import __spark_entry__ as entry

    texts = [None, "", "\u65e5\u672c", "\u00f1", "\u212a", "\u0130", "\u0663", "_", "-- !", "a", "\u00f1and\u00fa", "w0 w55", "w9 W15 \u65e5", "Onound, shonre thourein the."]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    got = entry.queries()["ml_embed"](spark, str(tmp_path)).collect()
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS FROM '{path}/*.parquet'")
        want = db.execute(entry.oracle_sql()["ml_embed"]).fetchall()
    assert sorted((d, n, float(x)) for d, n, x in want) == sorted(tuple(r) for r in got)


class Line:
    """Least squares through the origin."""

    def fit(self, x, y=None, scale=1.0):
        self.slope = scale if y is None else scale * sum(a * b for a, b in zip(x, y)) / sum(a * a for a in x)

    def predict(self, x, shift=0.0):
        return [self.slope * v + shift for v in x]


def test_estimator(rows):
    model = training.Estimator("line", Line(), preprocess=lambda v: v + 1, postprocess=lambda v: v * 10, y_preprocess=lambda v: v + 1, predict_options={"shift": 1.0})
    assert model.fit(rows, "x", "x", "y") is model and model.version == 1
    assert model.predict(2) == 40.0 and model.predict_batch([]) == []
    assert [r["p"] for r in model.predict_in(rows, "x", "p").orderBy("x").collect()] == [10.0 * (i + 2) for i in range(6)]
    assert training.Estimator("alone", Line(), fit_options={"scale": 3.0}).fit(rows, "x", "x").predict(2) == 6.0


def test_estimator_folds(rows):
    folded = rows.withColumn("y", F.when(F.col("x") < 4, F.col("x") * 2.0).otherwise(F.col("x") * 2.0 + 1)).withColumn(training.FOLD, F.when(F.col("x") < 4, "train").otherwise("valid"))
    model = training.Estimator("line", Line())
    assert training.fit_and_validate(model, folded, "x", "y", "x", [models.MEAN_SQUARED_ERROR]) == {"mse": 1.0}
    assert model.estimator.slope == 2.0 and model.metrics == {"mse": [1.0]}

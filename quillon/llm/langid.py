"""Language identification in two steps: the family first, then one-versus-one linear support
vector machines between the languages of that family.

Features are hashed byte n-grams (3 and 4) of the whole text in lower case without digits and
punctuation; their square-rooted frequencies make a unit vector. Families come from a table;
languages that it lacks form families by the nearness of their mean vectors.

Defined results: a null text, or one without a letter, is "und" with score 0; null and empty
languages aren't learned; without a learned language every text is "und"; a null doc_id is
predicted and never held out; repeated rows are predicted alike and learned once; an empty table
gives no rows; other columns pass unread.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import column_name, must_be_new, release, remainder, text_buffers
from quillon.llm.linear import linear_svm, sigmoid

UNKNOWN = "und"
#: Hashed dimensions.
SIZE = 4096
#: Rows to learn from, at most, over all languages together, and languages to learn.
SAMPLE, LANGUAGES = 3000, 200
#: Bytes and texts whose features are counted at once.
PART_BYTES, PART_TEXTS = 1 << 20, 1024

#: Families of languages by code.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "semitic": "am ar he mt",
    "indic": "bn gu hi mr ne pa ur",
    "east asian": "ja ko zh",
}

FOLD = np.full(256, 0x20, np.uint8)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x80:] = np.arange(0x80, 0x100)

LETTER = regex.compile(r"\p{L}")


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One unit vector (float32) for each text; zero if it has nothing to count."""
    n = len(offsets) - 1
    text = FOLD[raw]
    size = len(text)
    if size < 4:
        return np.zeros((n, SIZE), np.float32)
    blank = text == 0x20
    x = text.astype(np.uint32)
    three = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)
    four = three[:-1] | x[3:] << np.uint32(24)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    out = np.zeros(n * SIZE)
    for gram, width in ((three, 3), (four, 4)):
        h = ((gram * np.uint32(0x9E3779B1 if width == 3 else 0x85EBCA6B)) >> np.uint32(20)).astype(np.int64)
        use = (doc[: len(gram)] == doc[width - 1 :]) & ~(blank[: len(gram)] & blank[1 : len(gram) + 1])
        out += np.bincount((doc[: len(gram)] * SIZE + h)[use], minlength=n * SIZE)
    out = np.sqrt(out.reshape(n, SIZE)).astype(np.float32)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-9)


def parts(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + PART_BYTES, side="right")) - 1
        j = min(max(j, i + 1), i + PART_TEXTS, n)
        yield i, j
        i = j
    release()


@dataclass
class LanguageModel:
    families: list[list[str]] = field(default_factory=list)
    family_weights: np.ndarray | None = None  # one column a family
    family_bias: np.ndarray | None = None
    pairs: dict[int, list[tuple[int, int, np.ndarray, float]]] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score) of each row."""
        n = len(x)
        names, score = np.full(n, UNKNOWN, object), np.zeros(n)
        if not self.families:
            return names, score
        if len(self.families) > 1:
            margin = x @ self.family_weights + self.family_bias
            family = margin.argmax(axis=1)
            p = np.exp(3 * (margin - margin.max(axis=1, keepdims=True)))
            sure = p.max(axis=1) / p.sum(axis=1)
        else:
            family, sure = np.zeros(n, int), np.ones(n)
        for k, languages in enumerate(self.families):
            rows = np.flatnonzero(family == k)
            votes, worst = np.zeros((len(rows), len(languages))), np.full((len(rows), len(languages)), np.inf)
            for a, b, w, bias in self.pairs.get(k, []):
                margin = x[rows] @ w + bias
                votes[:, a] += margin >= 0
                votes[:, b] += margin < 0
                worst[:, a], worst[:, b] = np.minimum(worst[:, a], margin), np.minimum(worst[:, b], -margin)
            # Most duels won; among equals the one whose narrowest duel is widest.
            best = np.lexsort((np.where(np.isinf(worst), 0, worst), votes), axis=1)[:, -1] if len(rows) else np.zeros(0, int)
            names[rows] = np.array(languages, object)[best]
            narrow = worst[np.arange(len(rows)), best]
            score[rows] = sure[rows] * np.where(np.isinf(narrow), 1, sigmoid(3 * narrow))
        return names, score


def family_of(language: str) -> str | None:
    short = language.lower().replace("_", "-").split("-")[0]
    return next((f for f, members in FAMILIES.items() if short in members.split()), None)


def group(languages: list[str], means: dict[str, np.ndarray], near: float = 0.8) -> list[list[str]]:
    families: dict[str, list[str]] = {}
    for language in sorted(languages):
        name = family_of(language)
        if name is None:  # the nearest family whose mean vector is near, or a new one
            like = {f: float(np.mean([means[m] for m in members], axis=0) @ means[language]) for f, members in families.items()}
            best = max(like, key=like.get, default=None)
            name = best if best is not None and like[best] >= near else f"own {language}"
        families.setdefault(name, []).append(language)
    return [families[f] for f in sorted(families)]


def train(x: np.ndarray, y: np.ndarray) -> LanguageModel:
    languages = sorted(set(y.tolist()))
    if not languages:
        return LanguageModel()
    means = {}
    for language in languages:
        mean = x[y == language].mean(axis=0)
        means[language] = mean / max(float(np.linalg.norm(mean)), 1e-9)
    families = group(languages, means)
    model = LanguageModel(families)
    number = {language: k for k, members in enumerate(families) for language in members}
    family = np.array([number[v] for v in y])
    gram = x @ x.T
    gram += 1

    def machine(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, float]:
        a = linear_svm(gram if len(rows) == len(x) else gram[np.ix_(rows, rows)], np.where(first, 1, -1).astype(x.dtype))
        return x[rows].T @ a, float(a.sum())

    everything = np.arange(len(x))
    if len(families) == 2:
        w, bias = machine(everything, family == 0)
        model.family_weights, model.family_bias = np.column_stack([w, -w]), np.array([bias, -bias], np.float32)
    elif len(families) > 2:
        fitted = [machine(everything, family == k) for k in range(len(families))]
        model.family_weights = np.column_stack([w for w, _ in fitted])
        model.family_bias = np.array([b for _, b in fitted], np.float32)
    for k, members in enumerate(families):
        model.pairs[k] = []
        for (a, one), (b, two) in itertools.combinations(enumerate(members), 2):
            rows = np.flatnonzero((y == one) | (y == two))
            model.pairs[k].append((a, b, *machine(rows, y[rows] == one)))
    return model


def fit(docs: DataFrame, mod: int = 3, held_out: int = 1, sample: int = SAMPLE) -> LanguageModel:
    """Learn from `sample` rows at most, as many of each language as there are or may be: different
    (doc_id, text) with the least hash. Of more than LANGUAGES languages the commonest are learned."""
    rows = docs.select("doc_id", "text", "lang").filter((F.col("lang") != "") & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", mod) != held_out))
    rows = rows.withColumn("_h", F.xxhash64("doc_id", "text"))
    # Different rows, not rows: a language may be one document many times over.
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("_h").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    counts = {r["lang"]: max(r["n"], 1) for r in sizes.collect()}
    if not counts:
        return LanguageModel()
    each = max(1, sample // len(counts))
    # Under this bound lie three times as many as are taken, so that an estimate's error takes none.
    span = 1 << 30
    bound = F.create_map(*[v for lang, n in counts.items() for v in (F.lit(lang), F.lit(int(span * min(1.0, 3 * (each + 10) / n))))])
    near = rows.filter(F.pmod("_h", F.lit(span)) < bound[F.col("lang")])
    once = near.groupBy("lang", "_h").agg(F.min(F.struct("doc_id", "text")).alias("_r"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("_h", F.lit(span)), "_h"))
    chosen = once.withColumn("_n", place).filter(F.col("_n") <= each).select("lang", "_r.doc_id", "_r.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column("text"))
            for i, j in parts(offsets):
                x = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i).cast(pa.int64()), batch.column("lang").slice(i, j - i), pa.array([v.tobytes() for v in x], pa.binary())], ["doc_id", "lang", "x"])

    got = sorted((r["doc_id"], r["lang"], bytes(r["x"])) for r in chosen.mapInArrow(run, "doc_id long, lang string, x binary").collect())
    x = np.frombuffer(b"".join(v for *_, v in got), np.float16).reshape(-1, SIZE).astype(np.float32)
    return train(x, np.array([lang for _, lang, _ in got], object))


def predicted(docs: DataFrame, model: LanguageModel, name: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its score as further columns, whose names must be new."""
    must_be_new([name, score], docs.columns)
    schema = docs.select("*", F.lit("").alias(name), F.lit(0.0).alias(score)).schema
    for f in schema.fields[-2:]:
        f.nullable = True
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size follows the languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("text")
            raw, offsets = text_buffers(batch.column(at))
            for i, j in parts(offsets):
                part = batch.slice(i, j - i)
                names, sure = sent.value.predict(features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                for k, text in enumerate(part.column(at)):
                    if not text.is_valid or not LETTER.search(text.as_py()):
                        names[k], sure[k] = UNKNOWN, 0.0
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(sure, pa.float64())], [*part.schema.names, name, score])

    return docs.mapInArrow(run, schema)


def keep_known(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose language is told with that score."""
    name, score = column_name("_language", docs.columns), column_name("_sure", docs.columns)
    return predicted(docs, fit(docs), name, score).filter((F.col(f"`{name}`") != UNKNOWN) & (F.col(f"`{score}`") >= threshold)).drop(name, score)

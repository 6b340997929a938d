"""The corpus pipeline: from raw documents to packed sequences of training tokens.

Five stages, each one operator of `quillon.llm`. Every stage gets all rows that the one before
it kept, as a table written to and reread from the cluster's shared folder, and drops or places
rows by its own decisions:

1. quality     rows that the rule ensemble rejects go;
2. language    rows whose language can't be told go;
3. near_dedup  of each group of near copies (five-word shingles, similarity 0.8) one stays;
4. decontaminate  rows that hold ten words of a benchmark item in a row go;
5. packing     what is left is cut and packed into sequences of 2048 tokens.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontam, langid, packing, quality, simhash
from quillon.llm.common import written

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a quality score of 0.5 or more. Null and empty texts get the score that the rules give
    for statistics of 0; without labels of both classes all rows have one score; repeated rows are
    judged alike; an empty table gives an empty one with the same columns."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"), threshold=0.5)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is told with a score of 0.5 or more. Null texts and those without a letter
    go; a null lang isn't learned and its row is judged like any other; repeated rows are judged
    alike; an empty table, or one without a learned language, gives an empty one."""
    return langid.keep_known(docs, threshold=0.5)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least doc_id of each group of near copies. Texts without a word are one group;
    rows with a null doc_id stay; repeated rows are one; a doc_id that several texts have names no
    document, and one row of each of its texts stays; an empty table gives an empty one."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark window. Null and empty texts stay, as all rows do if the benchmark
    is empty; repeated rows and null ids are judged each for itself."""
    return decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark"), window=10)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in its sequence. A null or empty text is the end id alone; a
    null doc_id is kept as it is; repeated rows are packed each; an empty table gives no rows."""
    return packing.pack(docs, TOKENIZER, end_id=1, size=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("packing", packing_stage),
]

#: The stages learn models and cut tokens, which SQL can't express; tests hold each stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents, each written to the shared folder and reread by the next.
    Columns beyond those of documents are kept up to the last stage, whatever their names."""
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs

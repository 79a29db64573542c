"""From raw documents to token ids: five stages, each one operator of ``revlens.llm``.

Every stage takes (spark, docs, sf_dir) and all rows that its predecessor kept. All but the last return the columns of
``docs``. Each result is written to the shared folder as Parquet and read again, so a lost executor repeats one stage at
most. Nulls, empty texts, ties, repeated rows, empty tables and further columns are handled as each operator states.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from revlens.llm.bpe_trie import encode_decode
from revlens.llm.common import documents, fresh, labels, staged, tokenizer_file
from revlens.llm.kneser_ney import passing
from revlens.llm.lsh_forest import one_of_each
from revlens.llm.mixing import mixed_rows
from revlens.llm.toxicity import clean_rows


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below a half; the model is fitted on the labelled ones among them."""
    return clean_rows(docs, labels(spark, sf_dir))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie inside their language's band of perplexity."""
    return passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: up to three equal rows, or none."""
    return mixed_rows(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row (2 bytes each) with digests of the ids and of the text decoded from them."""
    names = fresh(docs, "ids", "n_tokens", "ids_sha256", "decoded_sha256")
    coded = encode_decode(docs, "text", tokenizer_file("word_bpe_49k.json"), ids=names[0], digests=tuple(names[1:]))
    return coded.select("doc_id", *[coded[n].alias(x) for n, x in zip(names, ("ids", "n_tokens", "ids_sha256", "decoded_sha256"))])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("mixing", mixing), ("bpe", bpe),
]

#: Learned models, signatures and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

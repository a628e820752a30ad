"""A corpus pipeline: toxic documents go, near copies go, personal data is masked, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept,
which were written as Parquet and read again.  All stages but the last return the columns that they
got, extra ones too, whatever their names.  Documents without an id are documents like others; those
without words are never toxic, never near copies, and are packed as the end id alone; rows that
repeat id and text become one.  An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Near copies share this percentage of the union of their word shingles of this size; op10's query has its own.
NEAR_SIZE, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject; its labels are those of ``labels``."""
    from tessera.llm import toxicity

    return toxicity.reject(spark, docs, sf_dir)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    from tessera.llm import jaccard

    return jaccard.deduplicate(spark, docs, sf_dir, size=NEAR_SIZE, percent=NEAR_PERCENT)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    from tessera.llm import pii
    from tessera.llm.common import text_batches

    text_batches(spark)
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents."""
    import public_tokenizers

    from tessera.llm import packing
    from tessera.llm.common import Scratch, text_batches

    text_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), Scratch(spark))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: A trained classifier and the tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    from tessera.llm.common import Scratch, table

    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: raw documents to token files, stage by stage.

Each stage is a function (spark, docs, sf_dir) -> DataFrame, written as Parquet and read again as the next one's docs. All but
the last keep the columns of ``documents`` (extra columns pass through).

1. ``language_id``: texts without a language (no letter, or a score under ``LEAST_SCORE``) go. The model is learnt from
   the stage's own input.
2. ``near_dedup``: of each group of near duplicates (five-word shingles, similarity 0.8 or more) the document with the
   least id stays. Rows that share an id are one document, whatever their texts: they stay or go together.
3. ``decontamination``: runs of words that stand in a benchmark item's window of ten words are cut out of the text, and
   a document of which they are more than half goes.
4. ``mixing``: sources are brought to their target weights; a row is a document's words taken in one turn of its source,
   so a document of an upweighted source stands up to three times, each time with its own id.
5. ``token_output``: the texts as token files, read back: a row per row of the mix.

Null texts are rejected by the first stage; an empty table passes all stages as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnrank.llm import decontaminate, language_id, mixing, near_dedup, token_output
from cairnrank.session import staged

LEAST_SCORE = 0.2
TOKENIZER = "word_bpe_49k.json"
#: Words of a worker's table in the last stage, where executors hold what the stages before have left.
KEPT = 100_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs, language_id.train(docs), LEAST_SCORE)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = near_dedup.near_groups(docs, shingle=5)
    return near_dedup.without(docs, staged(groups.filter("not kept").select("doc_id").distinct(), "dropped"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output.read_tokens(spark, *token_output.write_tokens(docs, public_tokenizers.path(TOKENIZER), kept=KEPT))


STAGES = [("language_id", language), ("near_dedup", near), ("decontamination", clean), ("mixing", mixed), ("token_output", tokens)]
#: Mixing draws at random and the tokenizer is a library's, so SQL can't express the rows of ``run``.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs

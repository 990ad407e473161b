"""From raw documents to token ids, in five stages; each is written as Parquet and read again as the next one's input.

1. Language identification drops documents without a letter, and those whose language is hardly likelier than the others.
2. Line dedup drops lines of 40 code points and more that 5 documents and more share, save in one of them.
3. The shingle Jaccard join finds groups of documents alike in at least .8 of their 5-word shingles, of which the smallest
   doc_id stays. Rows that share a doc_id are one document and stay together.
4. Mixing takes each source's documents as often as its target weight asks for.
5. BPE turns every text into token ids.

All stages but the last return the columns of documents, whatever they are beside doc_id, text, lang and source.
Null, empty and repeated rows go through as the operators' own modules say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.bpe import encode_documents
from loomwright.llm.common import fold, saved, table
from loomwright.llm.line_dedup import drop_lines
from loomwright.llm.mixing import mix
from loomwright.llm.ppm import identify
from loomwright.llm.queries import vocabulary
from loomwright.llm.shingle_join import near_documents

#: The least posterior of a document's language.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = identify(docs, fold(docs["doc_id"], 3) != 1)
    good = judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return good.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_lines(docs, least_chars=40, least_docs=5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = near_documents(docs, width=5, percent=80)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = encode_documents(docs, vocabulary("byte_bpe_50k.json"), with_ids=True)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: SQL can't express language models, token merges or the seeded mix of what they leave; tests use plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline: language ID, line dedup, near-duplicate join, source mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All but the last return the
columns of documents.  A stage decides on all that its predecessor kept:

1. language ID drops texts without a letter and those of which no language has
   MIXED of the words; lang becomes the predicted language.
2. line dedup cuts repeated lines out of the texts; a document of which nothing
   but white space is left goes.
3. of each group of near copies (five-word shingles, similarity of 0.8 or more)
   the document with the smallest doc_id stays.
4. mixing repeats or drops documents to meet the sources' targets, in the order
   of the training positions; a copy that is cut at the target stays whole.
5. BPE returns doc_id, n_tokens and the digests of ids and decoded text.

Nulls: a null text goes in stage 1; a null doc_id is carried through; documents
without words are never near copies.  Repeated rows of one doc_id become one in
stage 3.  An empty table stays empty.  Extra columns of documents are dropped at
the start.  Very long texts are rows like others; see the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.llm.bpe import encode
from quiver.llm.common import discard, held_out, read, written, written_paths
from quiver.llm.jaccard_join import jaccard_components
from quiver.llm.language_id import identify, train
from quiver.llm.line_dedup import line_dedup
from quiver.llm.mixing import mix, schedule_rows
from quiver.llm.queries import byte_bpe

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIXED = 0.4


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs.filter(~held_out()))
    told = identify(docs.select(*COLUMNS), model).filter((F.col("lang_pred") != "und") & (F.col("score") >= MIXED))
    return told.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_dedup(docs.select(*COLUMNS)).filter((F.col("n_removed") <= 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    first = jaccard_components(docs).filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.select(*COLUMNS).filter("doc_id is not null").join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.select(*COLUMNS).filter("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return schedule_rows(mix(docs, keep=("text", "lang", "n_chars"))).select(*COLUMNS)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs, byte_bpe())


STAGES = [
    ("language ID", keep_languages),
    ("line dedup", cut_lines),
    ("n-gram Jaccard join", one_of_each),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_texts),
]

#: Language ID and BPE have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, others = read(spark, sf_dir, "documents"), set(written_paths())
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        # Only this stage's rows are read on; what led to them goes.
        gone = [p for p in written_paths()[:-1] if p not in others]
        if gone:
            discard(*gone)
    return STAGES[-1][1](spark, docs, sf_dir)

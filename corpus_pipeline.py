"""From raw documents to packed sequences.

Every stage takes (spark, docs, sf_dir) and all that its predecessor kept, written as Parquet and read
again. All but the last return the columns of ``documents``; other columns of ``docs`` are left out.
A stage judges rows, not ids: rows that share an id or have none are documents of their own. An empty
table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from trellis.llm.common import broadcast_if, discard, materialize, scratch, table
from trellis.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC = 0.3


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents with a number of each row, ``row``. It is written, so that it stays what it is."""
    return materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "numbered")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score TOXIC or more. Null and empty texts score 0 and stay, as do all without
    labels of both kinds to learn from."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, carry=COLUMNS[1:]).where(F.col("score") < TOXIC).select(*COLUMNS)


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, of the smallest id; a null id only where no other has the text. Null and
    empty texts are equal; of rows that repeat each other one stays."""
    return exact_dedup.exact_duplicates(docs, carry=COLUMNS[1:]).where("kept").select(*COLUMNS)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links connect (five words, similarity 0.8) one row stays, of the
    smallest id; a null id only where the links reach no other. Texts without words link with nothing
    and stay."""
    docs = _numbered(docs)
    found = near_dedup.near_duplicates(docs, shingle=5, percent=80, doc_id="row").select(F.col("doc_id").alias("row"), "component_id")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    rows = found.join(docs.select("row", "doc_id"), "row").groupBy("component_id").agg(best.alias("best")).select("best.row")
    rows = materialize(rows, "kept")
    return docs.join(broadcast_if(rows, rows.count(), 16), "row", "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Documents without words take no words from the mix and
    stay once. Of rows that share id and text, any may be those that are taken once more."""
    docs = _numbered(docs)
    mixed = mixing.mix(docs, carry=("row",))
    passes = materialize(mixed.select("row", F.when(F.col("size") == 0, 1).otherwise((F.col("taken") / F.col("size")).cast("int")).alias("passes")).where("passes > 0"), "passes")
    often = docs.join(broadcast_if(passes, passes.count(), 24), "row")
    return often.withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("passes")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and
    empty texts are one end token; rows that share an id are packed each."""
    pieces = materialize(packing.tokenize(docs, vocabulary()), "pieces")
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", remove_toxic), ("exact dedup", remove_copies), ("near-dedup", remove_near_copies),
    ("mixing", mix_sources), ("packing", pack_sequences),
]
#: A trained model, MinHash and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            docs, before = materialize(stage(spark, docs, sf_dir), f"stage-{k}", keep=True), docs
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)

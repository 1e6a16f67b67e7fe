"""Documents to training tokens: quality rules, near-duplicates, mixing and BPE, each stage written before the next.

A stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import bpe_codec, mixing, near_dup, quality
from stratum.llm.common import stored, table
from stratum.llm.queries import tokenizer

#: Words of a shingle, and the similarity in percent from which on documents are near-duplicates.
SHINGLE, PERCENT = 5, 80
#: Up to so many ids are broadcast to find their rows; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep; those without words go."""
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id.

    Rows that share an id but not their text are judged each by its own text. Rows that repeat a document's id and
    text come out once; documents without an id, and those without words, all stay.
    """
    found = stored(near_dup.near_duplicates(docs, SHINGLE, PERCENT, text_hash=True).select(F.col("doc_id").alias("of"), "text_hash", "kept"), "groups")
    small = lambda ids: F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    dropped = small(found.where("not kept").select("of", "text_hash").distinct())
    repeated = small(stored(found.where("kept and of is not null").groupBy("of", "text_hash").count().where("count > 1").select("of", "text_hash"), "repeated"))
    row = lambda df: df.select("row.*")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("of"), F.xxhash64("text").alias("text_hash"))
    kept = rows.join(dropped, ["of", "text_hash"], "left_anti")
    once = row(kept.join(repeated, ["of", "text_hash"], "left_semi")).dropDuplicates(["doc_id", "text"])
    return row(kept.join(repeated, ["of", "text_hash"], "left_anti")).unionByName(once)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, shuffled inside the mix's shards. A document without words is taken as its block is."""
    return mixing.shuffled(mixing.drawn(mixing.mix(docs))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, and the digest of what they decode to: a row for each row, whatever repeats; a null text is empty."""
    spec = Path(tokenizer("word_bpe_49k.json")).read_text(encoding="utf-8")
    return bpe_codec.digests(docs, spec, with_ids=True)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("mixing sources", mix_sources), ("bpe encoding", encode)]

#: SQL cannot express MinHash groups, the mix's draws or BPE; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, whose columns may be null; no rows give none. Repeated rows of a document come out as often as the mix takes one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

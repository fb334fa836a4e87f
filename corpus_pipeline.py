"""A training corpus from ``documents``: language, quality, near-duplicates, packed sequences.

Every stage takes any table with the columns of documents: further columns are left out, an empty table
gives an empty one, and whole texts are read however long they are.  What becomes of nulls, empty texts, ties
and repeated rows is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, table
from lodestone.llm.langid import UNDETERMINED, held_out, predict, train
from lodestone.llm.packing import pack_documents
from lodestone.llm.quality import resample, select_rows
from lodestone.llm.simhash import simhash_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Softmax share below which a language counts as unknown.
LEAST_SCORE = 0.3
#: Bits that mark dropped ids, dealt to bitmaps of 32768 (4 KiB): at most 2048 of them, 8 MiB, are broadcast.
MARK_BITS, BITMAP_BITS = 1 << 26, 1 << 15


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told: no letters (null and empty texts among them), or no
    language whose share reaches ``LEAST_SCORE``.  Of tied languages the first by name counts.  Rows of a null
    or repeated id are judged each by their text, and repeated rows stay.  Where no row has a language to
    learn from, all stay."""
    docs = docs.select(*COLUMNS)
    model = train(docs.where(~F.coalesce(held_out(), F.lit(True))))
    seen = predict(docs, model, out=("__lang", "__score"))
    if model.labels:
        seen = seen.where((F.col("__lang") != UNDETERMINED) & (F.col("__score") >= LEAST_SCORE))
    return seen.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that importance resampling selects.  Null texts and texts without a token go; rows
    of a null id take part, with one noise for all of them; rows that tie with the last of the sample stay
    too, and repeated rows share their key, so they stay or go together."""
    docs = docs.select(*COLUMNS)
    _, ratio, cut = resample(docs, table(spark, sf_dir, "labels"))
    return select_rows(docs, ratio, cut).select(*COLUMNS)


def _marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` with ``marked``: true for each row of one of ``ids``, and for few others while the ids are fewer
    than ``MARK_BITS``.  What is broadcast does not grow with the ids."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(MARK_BITS))
    at, inside = F.floor(place / BITMAP_BITS), F.pmod(place, F.lit(BITMAP_BITS))
    maps = ids.select(at.alias("__at"), inside.alias("__in")).groupBy("__at").agg(F.bitmap_construct_agg("__in").alias("__map"))
    seen = docs.withColumn("__at", at).join(F.broadcast(maps), "__at", "left")
    byte = F.conv(F.hex(F.substring("__map", F.floor(inside / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, F.pmod(inside, F.lit(8)).cast("int"))
    return seen.withColumn("marked", F.coalesce(bit == 1, F.lit(False))).drop("__at", "__map")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group of near-duplicates, repeated rows once.  Texts without
    words are near-duplicates of each other.  Rows of a null id belong to no group and stay.  Of several
    texts of one id that stays, one is kept."""
    docs = docs.select(*COLUMNS)
    groups = materialize(simhash_dedup(docs).select("doc_id", "component_id"), "groups")
    extra = groups.where("doc_id <> component_id").select("doc_id").distinct()
    seen = _marked(docs, extra)  # only marked rows are shuffled with their texts, at every size
    marked = seen.where("marked").join(extra.hint("merge"), "doc_id", "left_anti")
    kept = seen.where("NOT marked").select(*COLUMNS).unionByName(marked.select(*COLUMNS))
    twice = materialize(groups.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return kept
    seen = _marked(kept, twice)
    marked = seen.where("marked")
    once = marked.join(twice.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    rest = marked.join(twice.hint("merge"), "doc_id", "left_anti")
    return seen.where("NOT marked").unionByName(rest).unionByName(once).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4096 tokens; null and empty texts make a piece of one end id, and
    repeated rows and rows of a null id are packed each."""
    return pack_documents(docs)


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("packing", packing),
]

#: Learnt models, hashing and packing have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

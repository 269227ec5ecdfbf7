"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celltide.llm import decontam, langid, mixing, neardup, sharding
from celltide.llm.common import Scratch, bounded, checkpoint_dir, delete, gathered, table, whole
from celltide.llm.queries import SHARDS

#: A document stays if its likeliest language has this share of the likelihood.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents, drop those without a language; an unset label gets the prediction.

    Null and empty texts, and texts without letters, have no language and go. Rows that repeat are judged alike; an
    empty table stays empty, and without any label all documents go, as nothing is learned. Other columns can have any name.
    """
    model = langid.train(docs)
    judged = docs.select(whole(docs).alias("d"), langid.predict(docs, model).alias("p"))
    kept = judged.where((F.col("p.lang_pred") != "und") & (F.col("p.score") >= LEAST_SCORE))
    return kept.select(*[F.coalesce("d.lang", "p.lang_pred").alias(c) if c == "lang" else F.col(f"d.`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by 80 % of five-word shingles: that of the smallest doc_id, nulls last.

    Rows are told apart by doc_id and text, so those that merely share a doc_id are documents of their own. Of rows
    alike in both one stays. Texts without a word have no copies and all stay, null ones too; so does an empty table.
    Other columns can have any name.
    """
    key = [F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash")]
    same = F.col("id").eqNullSafe(F.col("k_id")) & (F.col("hash") == F.col("k_hash"))
    with Scratch(spark) as s:
        found = s.put(neardup.near_duplicates(docs, by_row=True).where("root is not null").select("doc_id", "text_hash", "root"))
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
        groups = s.side(found.groupBy("root").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1").select(F.col("root").alias("g_root"), "first"))
        members = s.put(found.join(groups, F.col("root") == F.col("g_root")))
        stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
        gone = s.keep(members.where(~stays).select(*key).distinct())
        # rows of the document that stays which repeat its text too: of these one stays
        twice = s.keep(members.where(stays).groupBy("doc_id", "text_hash").count().where("count > 1").select(*key))
        rows = docs.select(whole(docs).alias("d"), docs["doc_id"].alias("id"), F.xxhash64(docs["text"]).alias("hash"))
        left = rows.join(bounded(gone), same, "left_anti")
        if twice.isEmpty():
            return left.select("d.*")
        twice = bounded(twice)
        one = left.join(twice, same).groupBy("id", "hash").agg(F.min("d").alias("d")).select("d.*")
        return left.join(twice, same, "left_anti").select("d.*").unionByName(one)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out of the texts and drop documents that are mostly such passages. Null and empty texts stay."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet their target weights, longer documents repeated sooner.

    Null and empty texts have no words, so they are taken as their certain copies only; a null source is one of its own.
    """
    return mixing.repeat(docs, weight_col=mixing.longer_first())


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every document in a shard; rows of one doc_id share it, and a null doc_id is placed by its text.

    The last stage adds slot and shard; laying files out by them is left to the writer, as the placing needs no shuffle.
    """
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix_sources),
    ("shard", shard),
]

#: Language ID and near duplicates by sketches can't be expressed in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes its rows to the shared checkpoint folder, where the last stay.

    What a stage has read goes as soon as its own rows are written.
    """
    docs = table(spark, sf_dir, "documents")
    root = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    done: list[str] = []
    for name, stage in STAGES:
        with gathered() as kept:
            stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        for path in [*kept, *done]:
            delete(spark, path)
        done = [f"{root}/{name}"]
        docs = spark.read.parquet(done[0])
    return docs

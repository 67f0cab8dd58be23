"""A training corpus from raw documents, stage by stage.

Each stage takes the documents that the one before has left, does its work on all of them and hands on documents
with the same columns; the last one returns tokens. Between stages the rows are written as Parquet and read again,
so a lost executor never reaches back over a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakecheck.llm.language import fit_floors, fits, predict, train_on
from lakecheck.llm.lines import drop_boilerplate
from lakecheck.llm.mixing import mixed_rows
from lakecheck.llm.setsketch import near_unique
from lakecheck.llm.storage import written
from lakecheck.llm.viterbi import encode

#: Posterior probability below which a language is not believed.
SURE = 0.5
#: Some stage is tested against code, not SQL.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those without letters or with an unsure prediction go, and those far less likely than labelled texts.

    ``lang`` becomes the predicted language, so later stages and the corpus carry what the text says.
    """
    model = train_on(docs)
    told = written(predict(docs, model, pred="_pred", score="_score", fit="_fit"), "told")
    floors = fit_floors(told, pred="_pred", fit="_fit")
    kept = told.where((F.col("_pred") != "und") & (F.col("_score") >= SURE) & fits(F.col("_fit"), F.col("_pred"), floors))
    return kept.withColumn("lang", F.col("_pred")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source, copies counted once; ``n_chars`` follows the text."""
    out = drop_boilerplate(docs, host="source", copies_once=True).drop("removed_lines")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest id; rows without words all stay."""
    return near_unique(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_rows(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_chars, n_tokens, tokens`` per document of the mix."""
    encoded = encode(docs)
    return encoded.select("doc_id", "lang", "source", "n_chars", F.size("tokens").cast("long").alias("n_tokens"), "tokens")


STAGES = [
    ("language", language),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("mixing", mixing),
    ("pieces", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        df = written(stage(spark, df, sf_dir), f"stage-{name.replace(' ', '-')}")
    return df

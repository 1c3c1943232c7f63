"""A corpus pipeline in five stages over `documents`; see STAGES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import jaccard, line_dedup, mixing, packing, quality
from siltstone.llm.common import WORD, materialize, table
from siltstone.llm.registry import tokenizer_path


def _rows(docs: DataFrame) -> DataFrame:
    """Each row as one column beside its id, so that no name of docs meets one of an operator."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("row_id"))


def _free(name: str, docs: DataFrame) -> str:
    """The name with as many underscores as make it new to docs."""
    while name in docs.columns:
        name += "_"
    return name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of 0.3 or more).

    Null and empty texts are scored as empty ones; repeated rows and rows without an id are scored row by row, and very long
    texts whole; an empty table stays empty. All columns stay."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score_column(model, F.coalesce("text", F.lit(""))) >= 0.3)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; one of which nothing is left goes.

    A null or empty text has no lines to lose and stays; repeated rows lose the lines that their first place keeps; of very
    long texts every line counts; rows without an id are one document. An empty table stays empty. All columns stay."""
    lines, dropped = _free("lines", docs), _free("dropped", docs)
    clean = line_dedup.dedup_lines(docs, counts=(lines, dropped))
    gone = (F.col(dropped) > 0) & (F.regexp_count("text", F.lit(WORD)) == 0)
    return clean.where(~gone).select(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group that similar shingle sets connect. Rows that share a
    doc_id are one document; those without one stay if any of them is no copy of a document with one."""
    found = jaccard.similar_components(docs)
    kept = found.where(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    return _rows(docs).join(materialize(kept, "kept"), F.col("row_id").eqNullSafe(F.col("kept_id")), "left_semi").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; at a source's cut, the words that still fit. Rows that share a
    doc_id are each taken as often as the one that is taken most."""
    taken = mixing.mix_sources(docs).groupBy(F.col("doc_id").alias("taken_id")).agg(F.max("size").alias("size"), F.max("taken").alias("taken")).where("taken > 0")
    rows = _rows(docs).join(taken, F.col("row_id").eqNullSafe(F.col("taken_id")))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.col("taken") - 1) / F.col("size"))), lambda k: F.least(F.col("size"), F.col("taken") - k * F.col("size")))
    rows = rows.select("row", "size", F.explode(parts).alias("words"))
    text = F.col("row")["text"]
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, F.col("words").cast("int")), "")
    cut = F.when(F.col("words") < F.col("size"), first).otherwise(text)
    return rows.select(*[(cut if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences of 2048 tokens: op10's columns in place of the documents'.

    A null or empty text is one end token; repeated rows and those without an id are packed as often as they come; very
    long texts are cut into pieces; an empty table gives no pieces."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", one_of_near_copies),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]

#: The classifier's fit has no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's rows written and read again for the next. Each stage says what becomes of
    nulls, empty and very long texts, repeated rows and empty tables."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage{i}")
    return docs

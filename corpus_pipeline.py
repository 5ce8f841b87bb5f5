"""A training-corpus pipeline: each stage takes (spark, docs, sf_dir) and gives the next one's docs.

All stages but the last return the columns of ``docs``. Stages that edit a text set n_chars anew where it is a column.
Stages write nothing but scratch tables in the shared folder; ``run`` writes what each one returns and reads it again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, jaccard, langid, packing, substrings
from tessera.llm.common import saved


def _rest(docs: DataFrame) -> tuple[list[str], Column]:
    """(names, one struct) of the columns besides doc_id and text, out of reach of an operator's own names."""
    names = [c for c in docs.columns if c not in ("doc_id", "text")]
    return names, F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(0).alias("_none"))


def _back(df: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` in their order from (doc_id, text, _rest), with some set anew."""
    return df.select(*[(new[c] if c in new else F.col(c) if c in ("doc_id", "text") else F.col("_rest").getField(c)).alias(c) for c in docs.columns])


def _edited(df: DataFrame, docs: DataFrame) -> DataFrame:
    """As ``_back``, with n_chars counted again where the text has changed."""
    counted = {}
    if "n_chars" in docs.columns:
        counted["n_chars"] = F.when(F.col("_changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_rest").getField("n_chars"))
    return _back(df, docs, **counted)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a null text or without a letter; fills a missing lang with the prediction, if there is any row to learn from."""
    model = langid.train(langid.learnable(docs))
    _, rest = _rest(docs)
    whole = docs.select("doc_id", "text", rest.alias("_rest"))
    if not model.langs:
        return _back(langid.lettered(whole), docs)
    found = langid.predict(whole, model).where(F.col("lang_pred") != langid.UNKNOWN)
    return _back(found, docs, **({"lang": F.coalesce(F.col("_rest").getField("lang"), F.col("lang_pred"))} if "lang" in docs.columns else {}))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of texts linked at Jaccard 0.8 or more over five-word shingles the one of smallest id, once; documents without an id stay."""
    first = jaccard.firsts(docs.select("doc_id", "text"), k=5, num=80, den=100)
    _, rest = _rest(docs)
    rows = docs.select("doc_id", "text", rest.alias("_rest"), F.xxhash64("text").alias("th"))
    kept = rows.join(saved(first, "first"), ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"])
    return _back(kept, docs).union(docs.where(F.col("doc_id").isNull()))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 or more words that also stand in a document of smaller id."""
    _, rest = _rest(docs)
    marked = substrings.with_spans(docs.select("doc_id", "text", rest.alias("_rest")))
    return _edited(substrings.without(marked), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every run of ten words (or a whole shorter item) of the benchmark."""
    bench = decontam.Benchmark(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    _, rest = _rest(docs)
    return _edited(decontam.clean(docs.select("doc_id", "text", rest.alias("_rest")), bench), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", language),
    ("ngram_jaccard", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", decontaminate),
    ("packing", packed),
]

#: None: the first stage's classifier and the last stage's packing have no SQL form; each stage is tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

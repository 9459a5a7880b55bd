"""From documents to packed sequences: language, near copies, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. Its result is written as Parquet and read
again as the next one's ``docs``.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from layoutcheck.llm import langid
from layoutcheck.llm.mixing import mix_sources
from layoutcheck.llm.ngram_join import jaccard_components
from layoutcheck.llm.packing import pack
from layoutcheck.llm.shared import Scratch
from layoutcheck.llm.substring import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose best language gets less than this has none.
LEAST_SCORE = 0.3
#: Near copies share this many hundredths of their 5-word shingles.
SHINGLE, SIMILAR = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language that was learned, go."""
    named = langid.identify(docs.select(COLUMNS))
    return named.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; documents without words are no copies."""
    docs = docs.select(COLUMNS)
    rows = jaccard_components(docs, n=SHINGLE, threshold=SIMILAR)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    kept = rows.where("n_shingles > 0").groupBy("component").agg(first).select(F.col("first.mark").alias("__mark"), F.lit(False).alias("__all"))
    alone = rows.where("n_shingles = 0").select(F.col("mark").alias("__mark"), F.lit(True).alias("__all")).distinct()
    # texts move once: the join and the numbering of repeated rows are dealt by the same mark
    marked = docs.withColumn("__mark", F.xxhash64(F.col("doc_id").cast("long"), "text"))
    nth = F.row_number().over(Window.partitionBy("__mark").orderBy("source", "lang"))
    met = marked.join(kept.union(alone), "__mark").withColumn("__nth", nth)
    return met.where(F.col("__all") | (F.col("__nth") == 1)).select(COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; documents of nothing else go."""
    cut = remove_repeats(docs.select(COLUMNS)).where("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is there as often as the mix takes it."""
    mixed = mix_sources(docs.select(COLUMNS)).where("times > 0")
    return mixed.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, each a sequence."""
    return pack(docs)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_copies),
    ("substring_dedup", repeated_passages),
    ("source_mixing", source_mix),
    ("packing", packing),
]

#: A trained network, a knapsack and a tokenizer are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

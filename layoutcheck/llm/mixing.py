"""A mix of sources at target weights: whole passes over a source, then a subset of its documents that fits the rest.

Documents are counted by exact length. Of the rest of a source's budget each
length first gives its even share, long documents then fill up all but the last
words, and a bounded knapsack over the counts left fits those. Which documents
of a length go in is decided by a seeded hash.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layoutcheck.llm.shared import Scratch, partitions, small_batches

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
#: Words of the budget that are left to the knapsack.
KNAPSACK = 16_384
#: Hash ranges of the documents of one source and length, ranked apart.
RANGES_BITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, scratch: Scratch, weights=WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """__skey, target of each source (__source, __skey, words): shares of all words by weight, none above ``most`` times its words.

    Weights repeat over the sources by code point, null last. The driver holds
    three sums: what is left to share, the weights that share it, and how many
    sources have all they may get. A round gives the excess to the others; what
    one unit of weight gets only grows, so it alone says who has enough.
    """
    by = F.col("__source").asc_nulls_last()
    dealt = scratch.keep(sizes.repartitionByRange(partitions(sizes.sparkSession), by).withColumn("__part", F.spark_partition_id()), "sources")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    first = dealt.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(by)) + F.col("__first") - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int"))
    known = scratch.keep(dealt.join(first, "__part").select("__skey", "words", weight.cast("long").alias("weight")), "weights")
    rest, shared = known.agg(F.sum("words"), F.sum("weight")).first()
    every, enough = rest, 0
    fair = lambda: F.lit(float(rest or 0)) * F.col("weight") / F.lit(float(shared or 1))
    while shared:
        over = fair() > most * F.col("words")
        n, full, others = known.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, most * F.col("words"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if n == enough:
            break
        enough, rest, shared = n, every - full, others
    target = F.least(fair(), most * F.col("words").cast("double")) if shared else most * F.col("words").cast("double")
    return known.select("__skey", target.alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, knapsack: int = KNAPSACK) -> np.ndarray:
    """How many documents of each length to take, so that their words come as near below the budget as can be."""
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    take = np.array([int(c) * budget // total for c in counts], np.int64) if total else np.zeros_like(counts)
    left = budget - int((take * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if lengths[i] and left > knapsack:
            n = min(int(counts[i] - take[i]), (left - knapsack) // int(lengths[i]))
            take[i] += n
            left -= n * int(lengths[i])
    items = []  # (length, how many at once): powers of two make up any count
    for i in np.flatnonzero((lengths > 0) & (lengths <= left) & (counts > take)):
        n, step = min(int(counts[i] - take[i]), left // int(lengths[i])), 1
        while n > 0:
            items.append((i, min(step, n)))
            n, step = n - step, step * 2
    reached = np.zeros(left + 1, bool)
    reached[0] = True
    by = np.full(left + 1, -1, np.int64)
    for k, (i, n) in enumerate(items):
        w = int(lengths[i]) * n
        if w <= left:
            new = w + np.flatnonzero(reached[: left + 1 - w] & ~reached[w:])
            by[new], reached[new] = k, True
            if reached[left]:
                break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, n = items[by[at]]
        take[i] += n
        at -= int(lengths[i]) * n
    return take


def _plan(most: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")  # the same plan whatever the shuffle's order
        lengths, counts, target = pdf["size"].to_numpy(), pdf["n"].to_numpy(), float(pdf["target"].iloc[0])
        total = int((lengths * counts).sum())
        times = min(int(target // total), most) if total else 0
        take = fit(lengths, counts, int(round(target - times * total))) if times < most and total else np.zeros(len(pdf), np.int64)
        return pd.DataFrame({"__skey": pdf["__skey"], "size": lengths, "source_size": total, "target": target, "times": times, "more": take})

    return run


def mix_sources(docs: DataFrame, carry: list[str] | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The carried columns (all by default) with size, source_size, target, times and taken (size * times).

    Null texts and texts without words have size 0 and are taken 0 words; a null
    source is a source of its own, the last; an empty table gives no rows.
    Repeated rows are rows of their own. Rows of one id, source and length go in
    by a hash of their text, so reruns agree. Texts of any length are counted
    whole. A clashing carried column is replaced. The driver holds a few sums, a
    task a count per length of a source.
    """
    spark = docs.sparkSession
    small_batches(spark)
    made = ("size", "source_size", "target", "times", "taken")
    carry = [c for c in (docs.columns if carry is None else carry) if c not in made]
    source = F.col(f"`{source_col}`").cast("string")
    rows = docs.select(
        *(F.col(f"`{c}`") for c in carry),
        source.alias("__source"),
        F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)).alias("__skey"),
        word_count(F.col(f"`{text_col}`")).alias("size"),
        F.xxhash64(F.lit(seed), F.col(f"`{id_col}`")).alias("__h"),
        F.col(f"`{id_col}`").alias("__id"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("__text"),
    )
    scratch = Scratch(spark, "mix")
    if text_col not in carry:
        rows = scratch.keep(rows, "sizes")
    rows = rows.withColumn("__range", F.shiftrightunsigned("__h", 64 - RANGES_BITS).cast("int"))
    named = source_targets(rows.groupBy("__source", "__skey").agg(F.sum("size").alias("words")), scratch)
    lengths = rows.groupBy("__skey", "size").agg(F.count("*").alias("n")).join(named, "__skey")
    plan = lengths.groupBy("__skey").applyInPandas(_plan(MOST_TIMES), "__skey string, size long, source_size long, target double, times long, more long")
    before = Window.partitionBy("__skey", "size").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("__skey", "size", "__range").count().withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count").join(plan, ["__skey", "size"])
    nth = F.row_number().over(Window.partitionBy("__skey", "size", "__range").orderBy("__h", "__id", "__text"))
    ranked = rows.withColumn("__nth", nth).join(ranges, ["__skey", "size", "__range"])
    times = F.col("times") + F.when(F.col("__before") + F.col("__nth") <= F.col("more"), 1).otherwise(0)
    return ranked.select(*(F.col(f"`{c}`") for c in carry), "size", "source_size", "target", times.cast("long").alias("times"), (F.col("size") * times).cast("long").alias("taken"))

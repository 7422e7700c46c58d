"""Mixing sources to target weights by hash-threshold histograms.

Each row has a 60-bit hash. Per source, token sums are taken by the hash's leading bits; the bucket in which the budget
runs out is refined by the next bits, and only its rows are looked at again, until it holds one hash value. A row is then
taken if its hash lies under its source's threshold: no sort of rows, and a larger budget takes a superset.

Targets: shares by weight of all tokens, none above ``max_epochs`` times its source's tokens; what is over is shared again
by weight. A target of 2.4 times a source takes all its rows twice and four tenths of them, by threshold, a third time.

Defined results: null text has size 0; a null source is a source and comes last; a source of size 0 has target 0; repeated
rows share a hash and so a decision; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stage_table

WORD = r"[^\x20\x09-\x0D]+"
BITS, LEVELS = 12, 5


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the md5 of id and text, as a non-negative long."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def weighted(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """sizes with w: weights go round by code point of the source, null last. Sources are ranked in parallel, by ranges."""
    last = F.col("source").asc_nulls_last()
    placed = stage_table(sizes.repartitionByRange(last).sortWithinPartitions(last).withColumn("at", F.monotonically_increasing_id()), "mix-sources")
    # the identifier is a partition's number and, in its last 33 bits, the row's place in it
    part = F.shiftright("at", 33)
    counts = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).count().collect())  # one row a partition
    before = [(p, upto - n) for (p, n), upto in zip(counts, accumulate(n for _, n in counts), strict=True)]
    starts = sizes.sparkSession.createDataFrame(before, "part long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").select("source", "source_size", weight.alias("w"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """(source, source_size) -> + target. One row a source.

    Shares rise to a common level by weight; sources under it are at their cap, and what they leave raises the level for the
    others, until no more are under it. Each step is one sum over sources.
    """
    ranked = stage_table(weighted(sizes, weights), "mix-weights")
    cap = F.col("source_size") * max_epochs
    level = 0.0
    while True:
        full = cap < F.lit(level) * F.col("w")
        total, capped, weight, done = ranked.agg(F.sum("source_size"), F.sum(F.when(full, cap).otherwise(0)), F.sum("w"), F.sum(F.when(full, F.col("w")).otherwise(0.0))).first()
        if not total or weight == done:
            break
        new = (total - capped) / (weight - done)
        if new <= level:
            break
        level = new
    return ranked.select("source", "source_size", F.least(cap.cast("double"), F.lit(level) * F.col("w")).alias("target"))


def thresholds(slim: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """slim: (source, size, h). One row a source: source_size, target, epochs taken whole, and the cut: hashes under it are taken once more."""
    goal = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = stage_table(goal.withColumn("epochs", whole).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long")).withColumn("open", F.lit(True)), "mix")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        at = F.shiftright("h", shift)
        rows = slim.join(state.where("open").select(F.col("source").alias("s"), "prefix", "rest"), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + BITS) == F.col("prefix")))
        sums = rows.groupBy("s", "rest", at.alias("bucket")).agg(F.sum("size").alias("tokens"), F.min("h").alias("low"), F.max("h").alias("high"))
        upto = F.sum("tokens").over(Window.partitionBy("s").orderBy("bucket"))
        over = sums.withColumn("upto", upto).where(F.col("upto") > F.col("rest"))
        edge = over.groupBy("s").agg(F.min_by(F.struct("bucket", "tokens", "upto", "low", "high"), "bucket").alias("e"))
        met = state.join(edge, F.col("source").eqNullSafe(F.col("s")), "left")
        left = F.col("rest") - (F.col("e.upto") - F.col("e.tokens"))
        one = F.col("e.low") == F.col("e.high")
        # a bucket of one hash value is not split: it is taken if that comes nearer to the target
        stop = F.when(one, F.when(left * 2 >= F.col("e.tokens"), F.col("e.high") + 1).otherwise(F.col("e.low")))
        cut = F.when(~F.col("open"), F.col("prefix")).when(F.col("e").isNull(), F.lit(1 << 60)).when(one, stop).otherwise(F.col("e.bucket"))
        still = F.col("open") & F.col("e").isNotNull() & ~one
        state = stage_table(met.select("source", "source_size", "target", "epochs", F.when(still, left).otherwise(F.col("rest")).alias("rest"), cut.alias("prefix"), still.alias("open")), "mix")
        if not state.where("open").limit(1).count():
            break
    return state.select("source", "source_size", "target", "epochs", F.col("prefix").alias("cut"))


def slim_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), row_hash(F.col(doc_id), F.col(text)).alias("h"))


def with_thresholds(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows: with source, size and h. Adds source_size, target, copies and taken; the source's row is joined, rows are not sorted."""
    joined = rows.join(cuts.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    copies = F.col("epochs") + (F.col("h") < F.col("cut")).cast("long")
    return joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop("epochs", "cut")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row."""
    slim = stage_table(slim_rows(docs), "mix-rows")
    return with_thresholds(slim, thresholds(slim, weights, max_epochs)).drop("h")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """The rows of docs that the mix takes, with size, source_size, target, copies and taken; columns of docs so named are replaced."""
    cuts = thresholds(stage_table(slim_rows(docs), "mix-rows"), weights, max_epochs)
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "source", word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("h"))
    return with_thresholds(rows, cuts).where("copies > 0").select("row.*", "size", "source_size", "target", "copies", "taken")

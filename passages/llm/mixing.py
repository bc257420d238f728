"""Sources mixed to target weights by entropy balancing."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passages.llm.shared import saved

WORD = "[^\\x20\\x09-\\x0D]+"
# Rates are rounded to this part of a copy, so that sums of them are exact.
UNIT = 1_000_000
# Classes of nearly equal sizes to a doubling of the size.
CLASSES = 16
TOLERANCE = 1e-9
MAX_STEPS = 100


def source_key(source: Column) -> Column:
    """A key that is never null and tells null from every source name."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """``key, source_size, target`` of each source.

    Sources in code point order, null last, take the weights in turn and share all
    sizes. What is above ``cap`` times a source's size goes to the others by weight: with
    the sources in order of cap to weight, that is the first level at which those from
    there on stay below their caps. The table has a row per source; it alone is ordered
    as a whole.
    """
    sources = sizes.groupBy("key").agg(
        F.first("source").alias("source"), F.sum("size").alias("source_size")
    )
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), ((place - 1) % len(weights) + 1).cast("int")
    )
    ordered = W.orderBy("ratio", "key")
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    onward = ordered.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    total = F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(
        onward
    )
    return (
        sources.withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("level", level)
        .withColumn(
            "first",
            F.min(
                F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "key", "level"))
            ).over(everything),
        )
        .select(
            "key",
            "source_size",
            F.least("most", F.coalesce(F.col("first.level") * F.col("weight"), F.col("most"))).alias(
                "target"
            ),
        )
    )


def balanced_rates(sizes: DataFrame, wanted: DataFrame, cap: float) -> DataFrame:
    """``key, lam, scale``: the dual solution of each source.

    Of all rates of documents that give a source its target tokens and stay within
    ``cap``, the ones of least relative entropy to one copy each are
    ``min(cap, exp(lam * size / scale))``, where ``lam`` solves the convex dual: the
    tokens at ``lam`` equal the target. Newton steps on the logarithm find it, each a
    distributed sum over the counts of sizes; a step that leaves the interval known to
    hold the solution is replaced by halving it.
    """
    counts = saved(sizes.where("size > 0").groupBy("key", "size").agg(F.count("*").alias("n")))
    scales = counts.groupBy("key").agg(
        (F.sum(F.col("n") * F.col("size") * F.col("size").cast("double")) / F.sum(F.col("n") * F.col("size"))).alias("scale")
    )
    state = wanted.join(scales, "key").select(
        "key",
        "target",
        "scale",
        F.log(F.col("target") / F.col("source_size")).alias("lam"),
        F.lit(None).cast("double").alias("low"),
        F.lit(None).cast("double").alias("high"),
        (F.col("target") >= F.col("source_size") * cap * (1 - TOLERANCE)).alias("full"),
        F.lit(False).alias("done"),
    )
    state = saved(state)
    z = F.col("size") / F.col("scale")
    tilted = F.exp(F.least(F.col("lam") * z, F.lit(50.0)))
    tokens = F.col("n") * F.col("size") * F.least(tilted, F.lit(float(cap)))
    slope = F.when(tilted < cap, F.col("n") * F.col("size") * z * tilted).otherwise(0.0)
    for _ in range(MAX_STEPS):
        open_ = state.where("not full and not done")
        if open_.isEmpty():
            break
        sums = (
            counts.join(open_.select("key", "lam", "scale"), "key")
            .groupBy("key")
            .agg(F.sum(tokens).alias("tokens"), F.sum(slope).alias("slope"))
        )
        error = F.log(F.col("tokens") / F.col("target"))
        low = F.when(error < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(error > 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - error * F.col("tokens") / F.col("slope")
        inside = (F.col("slope") > 0) & (
            F.coalesce(newton > F.col("low"), F.lit(True))
            & F.coalesce(newton < F.col("high"), F.lit(True))
        )
        wider = F.when(F.col("high").isNull(), F.col("lam") + 1 + F.abs("lam")).when(
            F.col("low").isNull(), F.col("lam") - 1 - F.abs("lam")
        )
        halved = F.coalesce(wider, (F.col("low") + F.col("high")) / 2)
        done = F.abs(error) < TOLERANCE
        state = saved(
            state.join(sums, "key", "left")
            .withColumn("low", F.when(F.col("tokens").isNull(), F.col("low")).otherwise(low))
            .withColumn("high", F.when(F.col("tokens").isNull(), F.col("high")).otherwise(high))
            .withColumn("stop", F.col("done") | F.coalesce(done, F.lit(False)))
            .select(
                "key",
                "target",
                "scale",
                F.when(F.col("stop") | F.col("tokens").isNull(), F.col("lam"))
                .otherwise(F.when(inside, newton).otherwise(halved))
                .alias("lam"),
                "low",
                "high",
                "full",
                F.col("stop").alias("done"),
            )
        )
    return state.select("key", F.round("lam", 10).alias("lam"), "scale", "full")


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    cap: int = 3,
) -> DataFrame:
    """``id, hash, size, source_size, target, rate, copies, taken`` of every row of ``docs``.

    Sizes are words. Rates are rounded to copies along each source, from the shortest to
    the longest class of sizes: a document gets its whole copies, and one more whenever
    the parts of copies summed so far pass a half, so a source misses its target by about
    one document. The sums run in cells of a source, a class of sizes and a slice of the
    ids; only sums of cells are put in order per source, so a source with most of the rows
    is many tasks. The result is the same in every run.

    A null text has size 0, as has an empty one; both are taken 0 words. Null sources are
    one source. Rows repeated in full share one hash and one outcome per row. An empty
    table gives an empty result. Other columns are left out; ``hash`` is of id and text.
    """
    slices = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = saved(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.col(id_col), F.col(text_col)).alias("hash"),
            source_key(F.col(source_col)).alias("key"),
        )
    )
    wanted = saved(targets(sizes, weights, cap))
    solved = balanced_rates(sizes, wanted, cap)
    rate = F.when(F.col("full"), F.lit(float(cap))).otherwise(
        F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(50.0))))
    )
    rows = (
        sizes.join(wanted, "key")
        .join(solved, "key", "left")
        .withColumn("units", F.coalesce(F.round(rate * UNIT), F.lit(UNIT)).cast("long"))
        .withColumn("part", F.col("units") % UNIT)
        .withColumn("class", F.floor(F.log2(F.col("size") + 1.0) * CLASSES).cast("int"))
        .withColumn("slice", F.pmod("hash", F.lit(slices)).cast("int"))
    )
    cell = ["key", "class", "slice"]
    order = W.partitionBy("key").orderBy("class", "slice")
    starts = (
        rows.groupBy(*cell)
        .agg(F.sum("part").alias("part"))
        .select(
            *cell,
            F.coalesce(F.sum("part").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"),
        )
    )
    upto = F.sum("part").over(
        W.partitionBy(*cell).orderBy("size", "hash", "id").rowsBetween(W.unboundedPreceding, 0)
    )
    half = UNIT // 2
    end = F.col("start") + F.col("upto") + half
    more = F.floor(end / UNIT) - F.floor((end - F.col("part")) / UNIT)
    copies = (F.floor(F.col("units") / UNIT) + more).cast("long")
    return (
        rows.withColumn("upto", upto)
        .join(starts, cell)
        .select(
            "id",
            "hash",
            "size",
            "source_size",
            "target",
            (F.col("units") / UNIT).alias("rate"),
            copies.alias("copies"),
            (copies * F.col("size")).alias("taken"),
        )
    )


def with_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    cap: int = 3,
) -> DataFrame:
    """All rows and columns of ``docs`` with the ``copies`` that the mix takes and its ``taken`` words."""
    order = F.row_number().over(W.partitionBy("__hash").orderBy("__copies"))
    found = mixed(docs, id_col, text_col, source_col, weights, cap).select(
        F.col("hash").alias("__hash"), F.col("copies").alias("__copies"), F.col("taken").alias("__taken")
    )
    found = found.withColumn("__place", order)
    rows = docs.withColumn("__hash", F.xxhash64(F.col(id_col), F.col(text_col)))
    # Rows repeated in full are told apart by a number.
    rows = rows.withColumn("__place", F.row_number().over(W.partitionBy("__hash").orderBy(F.lit(1))))
    columns = [c for c in docs.columns if c.lower() not in ("copies", "taken")]
    return rows.join(found, ["__hash", "__place"]).select(
        *columns, F.col("__copies").alias("copies"), F.col("__taken").alias("taken")
    )

"""Conversations without quotations, in reply order, by linking quotes to what they quote."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passages.llm.shared import saved

MARKS = r"^[ \t]*((?:>[ \t]?)+)"
ATTRIBUTION = r"(^|\n)[^\n]*\bwrote:[ \t]*$"
BLANKS = " \t\r\n"
# Turns of a slice, within which the latest original before a quote is looked for.
SLICE_TURNS = 4096


def normalised(text: Column) -> Column:
    """Lower case, any white space as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def quote_runs(messages: DataFrame) -> DataFrame:
    """``m, conv, turn, run, level, passage``: runs of lines at one quote level."""
    lines = messages.select("m", "conv", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    marks = F.regexp_extract("line", MARKS, 1)
    lines = lines.select(
        "m",
        "conv",
        "turn",
        "pos",
        F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"),
        F.regexp_replace("line", MARKS, "").alias("line"),
    )
    along = W.partitionBy("m").orderBy("pos")
    change = F.coalesce((F.col("level") != F.lag("level").over(along)).cast("int"), F.lit(0))
    return (
        lines.withColumn("change", change)
        .withColumn("run", F.sum("change").over(along))
        .groupBy("m", "conv", "turn", "run", "level")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
        .withColumn("passage", F.array_join(F.col("lines.line"), "\n"))
        .drop("lines")
    )


def _keys(rows: DataFrame, text: str, grains: list[Column], *columns: str) -> DataFrame:
    """A row per distinct normalised piece of a text: the whole, paragraphs and lines."""
    pieces = F.array_distinct(F.transform(F.flatten(F.array(*grains)), normalised))
    return rows.select(*columns, F.explode(pieces).alias("piece")).where("piece != ''")


def conversations(
    messages: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``conv, turn, role, text, parent_turn, root_turn, depth, n_quotes, n_linked`` per row.

    Lines that begin with ``>`` are quotes, as many levels deep as there are marks; a
    run of lines at one level is a quoted passage. Passages are normalised (case and
    white space) and joined, by hash and then in full, to the own texts, paragraphs and
    lines of earlier messages of the same conversation; the latest earlier message
    counts, and a passage that is found nowhere as a whole is looked up line by line. A
    message replies to the message that its first-level quotes take most characters
    from, the latest of equals. ``text`` is what is left without the quotes and the line
    ``... wrote:`` before them. ``root_turn, depth, turn`` is the reply order: a message
    stands in the thread of the message that its chain of replies leads to.

    The latest original is found by windows over slices of the turns, not by pairs, so a
    line that very many messages share makes no more rows than there are messages. A
    null text is empty, a null turn comes before all others, null conversations are
    nobody's: their messages link to nothing. Messages repeated in full get equal rows.
    Quotes that match nothing are removed all the same. Empty tables give an empty
    result; other columns are left out.
    """
    base = messages.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.col(role_col).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("m", F.xxhash64("conv", "turn", "role", "text"))
    has_quote = F.col("text").rlike(r"(?m)^[ \t]*>")
    quoting = base.where(has_quote).dropDuplicates(["m"])
    runs = saved(quote_runs(quoting))
    own = (
        runs.where("level = 0")
        .groupBy("m")
        .agg(F.array_sort(F.collect_list(F.struct("run", "passage"))).alias("own"))
        .select(
            "m",
            F.array_join(
                F.transform("own.passage", lambda p: F.regexp_replace(p, ATTRIBUTION, "")), "\n"
            ).alias("own"),
        )
    )
    texts = base.join(own, "m", "left").withColumn(
        "own",
        F.btrim(
            F.when(has_quote, F.coalesce("own", F.lit(""))).otherwise(F.col("text")), F.lit(BLANKS)
        ),
    )

    # Quoted passages as a whole, and their lines.
    quotes = runs.where("level > 0 and conv is not null").withColumn(
        "whole", normalised(F.col("passage"))
    ).where("whole != ''")
    wanted = _keys(
        quotes, "passage", [F.array("passage"), F.split("passage", "\n")],
        "conv", "turn", "m", "run", "level", "whole",
    ).withColumn("key", F.xxhash64("piece"))
    grains = [F.array("own"), F.split("own", r"\n[ \t]*\n"), F.split("own", "\n")]
    known = _keys(texts.where("conv is not null"), "own", grains, "conv", "turn", "m").withColumn(
        "key", F.xxhash64("piece")
    )
    slice_ = F.coalesce(F.floor(F.col("turn") / SLICE_TURNS), F.lit(-1))
    originals = (
        known.join(wanted.select("conv", "key", "piece").distinct(), ["conv", "key", "piece"], "left_semi")
        .withColumn("slice", slice_)
        .withColumn("original", F.struct("turn", "m"))
    )
    cell = ["conv", "key", "piece"]
    earlier = (
        originals.groupBy(*cell, "slice")
        .agg(F.max("original").alias("last"))
    )
    seen = originals.select(*cell, "slice", "turn", "original", *[
        F.lit(None).cast(t).alias(c) for c, t in (("quoter", "long"), ("run", "long"), ("level", "int"), ("whole", "string"))
    ])
    asked = wanted.withColumn("slice", slice_).select(
        *cell, "slice", "turn", F.lit(None).cast(seen.schema["original"].dataType).alias("original"),
        F.col("m").alias("quoter"), F.col("run").cast("long").alias("run"), "level", "whole",
    )
    # Rows of the same turn are no earlier messages of each other.
    within = W.partitionBy(*cell, "slice").orderBy(F.col("turn").asc_nulls_first()).rangeBetween(W.unboundedPreceding, -1)
    found = (
        seen.unionByName(asked)
        .withColumn("here", F.max("original").over(within))
        .where("quoter is not null")
    )
    slices = (
        earlier.select(*cell, "slice", "last")
        .unionByName(asked.select(*cell, "slice").distinct().withColumn("last", F.lit(None).cast(earlier.schema["last"].dataType)))
        .groupBy(*cell, "slice")
        .agg(F.max("last").alias("last"))
        .withColumn(
            "before",
            F.max("last").over(W.partitionBy(*cell).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)),
        )
        .drop("last")
    )
    matches = (
        found.join(slices, [*cell, "slice"])
        .withColumn("to", F.coalesce("here", "before"))
        .where("to is not null")
        .withColumn("is_whole", F.col("piece") == F.col("whole"))
    )
    # A passage found as a whole is not looked up by its lines too.
    passages = matches.groupBy("quoter", "run", "level", "to").agg(
        F.max("is_whole").alias("is_whole"), F.sum(F.length("piece")).alias("length")
    )
    best = F.max("is_whole").over(W.partitionBy("quoter", "run"))
    passages = passages.withColumn("best", best).where("is_whole = best")
    links = saved(
        passages.where("level = 1")
        .groupBy("quoter", "to")
        .agg(F.sum("length").alias("length"))
        .groupBy(F.col("quoter").alias("m"))
        .agg(F.max(F.struct("length", "to")).alias("top"))
        .select("m", F.col("top.to.m").alias("up"), F.col("top.to.turn").alias("parent_turn"))
    )
    counts = quotes.groupBy("m").agg(F.count("*").alias("n_quotes"))
    linked = passages.select(F.col("quoter").alias("m"), "run").distinct().groupBy("m").agg(
        F.count("*").alias("n_linked")
    )

    # Each message's farthest known ancestor, at twice the distance after each step.
    state = saved(links.select("m", "up", F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth")))
    while True:
        further = state.select(
            F.col("m").alias("up"), F.col("up").alias("up2"), F.col("root_turn").alias("root2"), F.col("depth").alias("depth2")
        )
        step = state.join(further, "up", "left")
        if step.where("up2 is not null").isEmpty():
            break
        state = saved(
            step.select(
                "m",
                F.coalesce("up2", "up").alias("up"),
                F.when(F.col("up2").isNull(), F.col("root_turn")).otherwise(F.col("root2")).alias("root_turn"),
                (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"),
            )
        )
    return (
        texts.join(links.select("m", "parent_turn"), "m", "left")
        .join(state.select("m", "root_turn", "depth"), "m", "left")
        .join(counts, "m", "left")
        .join(linked, "m", "left")
        .select(
            "conv",
            "turn",
            "role",
            F.col("own").alias("text"),
            "parent_turn",
            F.when(F.col("depth").isNull(), F.col("turn")).otherwise(F.col("root_turn")).alias("root_turn"),
            F.coalesce("depth", F.lit(0)).alias("depth"),
            F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"),
            F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        )
    )

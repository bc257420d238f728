"""How far the sources of a language differ in their terms, with exact integer shares.

The divergence of two sources sums a value over all kept terms of the language, most of
which either source lacks. With F(p, q) the value of a term's two shares and p0, q0 the
shares of an absent one, a sum over terms is

    V F(p0, q0) + sum over terms of the first of F(p, q0) - F(p0, q0)
                + sum over terms of the second of F(p0, q) - F(p0, q0)
                + sum over terms of both of F(p, q) - F(p, q0) - F(p0, q) + F(p0, q0)

The last sum comes from frequent-pattern trees: a term's row, its shares in the order of the
sources, is a path from the root, rows that begin alike share nodes, and a pair is corrected
once per node and ancestor, times the rows that pass through the node.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passages.llm.shared import saved
from passages.sources.spread import spread

SCALE = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200
# Different terms of sources that a task counts before it hands them on.
COUNTED = 400_000
# Bytes of text that are cut into terms at once, and cells of rows that make one tree.
PART_BYTES = 1 << 20
TREE_CELLS = 1 << 18

# Bytes of terms: letters, of A-Z the lower case, and all of characters beyond ASCII.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_COUNTS = "lang string, source string, term string, n long, docs long"


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a whole text, some at a time."""
    text, start = text.translate(_TERM_BYTES), 0
    while start < len(text):
        stop = text.find(b" ", start + PART_BYTES)
        stop = len(text) if stop < 0 else stop
        yield text[start:stop].split()
        start = stop


def term_counts(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of each term, and documents that hold it.

    Terms are runs of letters and of characters beyond ASCII, of A-Z in lower case. Every
    group of a language and a source has a row without a term too. Tasks hand on partial
    counts, which are added up in the one shuffle, by language and term.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = {}
        held: dict[tuple, Counter] = {}

        def result() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in counts.items():
                terms = [None, *(term.decode() for term in own)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(terms), pa.string()),
                        pa.array([source] * len(terms), pa.string()),
                        pa.array(terms, pa.string()),
                        pa.array([0, *own.values()], pa.int64()),
                        pa.array([0, *map(held[lang, source].__getitem__, own)], pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )

        for batch in batches:
            texts = batch["text"].cast(pa.large_binary())
            groups = zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), strict=True)
            for group, text in zip(groups, texts, strict=True):
                own = counts.setdefault(group, Counter())
                distinct: set[bytes] = set()
                for terms in _terms(text.as_py()):
                    own.update(terms)
                    distinct.update(terms)
                held.setdefault(group, Counter()).update(distinct)
            if sum(map(len, counts.values())) > COUNTED:
                yield from result()
                counts.clear()
                held.clear()
        yield from result()

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    rows = docs.select(
        text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text")
    )
    parts = spread(rows).mapInArrow(count, _COUNTS)
    # By language and term, so that the window over these needs no other shuffle.
    return (
        parts.repartition("lang", "term")
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )


def share(count: str, total: str = "total", kept: str = "kept") -> Column:
    """``1 + floor(SCALE (count + 1) / (total + kept))``, whole, of counts of any size."""
    whole = f"cast({SCALE} as decimal(10)) * (cast({count} as decimal(20)) + 1)"
    return F.expr(f"{whole} div greatest(cast({total} as decimal(20)) + {kept}, 1) + 1")


def value(p: str, q: str) -> str:
    """``floor((p - q)^2 / q)`` of two shares; a square stays below 2^63."""
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def _values(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class _Tree:
    """The frequent-pattern tree of rows that are sorted, and given one after another.

    ``places, shares, absent`` are the rows' entries, ``lengths`` their numbers, ``times``
    how many terms have each row. A row adds the nodes beyond what it shares with the row
    before; a node stands for the terms of all rows until the next that leaves it.
    """

    def __init__(self, lengths, places, shares, absent, times):
        begins = np.cumsum(lengths) - lengths
        rows = np.repeat(np.arange(len(lengths)), lengths)
        self.grid = np.full((3, len(lengths), lengths.max(initial=0)), -1, np.int64)
        self.grid[:, rows, np.arange(len(places)) - begins[rows]] = places, shares, absent
        self.passed = np.concatenate([[0], np.cumsum(times)])

    def nodes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Level by level the first rows of the nodes, and how many terms pass each."""
        grid = self.grid
        same = np.zeros(grid.shape[1], bool)
        same[1:] = True
        for level in range(grid.shape[2]):
            same[1:] &= (grid[:2, 1:, level] == grid[:2, :-1, level]).all(axis=0)
            starts = np.flatnonzero(~same)
            ends = np.append(starts[1:], len(same))
            real = grid[0, starts, level] >= 0
            yield level, starts[real], self.passed[ends[real]] - self.passed[starts[real]]

    def corrections(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Per ordered pair of places the sum of the corrections of a level's nodes with all
        their ancestors, as high and low halves."""
        for level, starts, weight in self.nodes():
            if not level or not len(starts):
                continue
            place, p, p0 = (layer[starts, level, None] for layer in self.grid)
            above, q, q0 = (layer[starts, :level] for layer in self.grid)
            place, weight = np.broadcast_to(place, above.shape), weight[:, None]
            for a, b, x, x0, y, y0 in ((place, above, p, p0, q, q0), (above, place, q, q0, p, p0)):
                gain = _values(x, y) - _values(x, y0) - _values(x0, y) + _values(x0, y0)
                yield _summed(a.ravel(), b.ravel(), weight, gain)


def _summed(a: np.ndarray, b: np.ndarray, weight: np.ndarray, gain: np.ndarray) -> tuple:
    # In halves of 31 bits: a node's terms, fewer than 2^31, times a value stay below 2^63.
    high, low = ((weight * half).ravel() for half in (gain >> 31, gain & 0x7FFFFFFF))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[first], b[first], np.add.reduceat(high[order], first), np.add.reduceat(low[order], first)


def tree_sums(rows: DataFrame) -> DataFrame:
    """``lang, place, other, high, low`` of the trees over ``rows(lang, path, times)``.

    Sorted rows go to tasks by ranges, so that those that begin alike meet. Some consecutive
    rows make one tree; what paths share across trees is counted in both.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(ranges, "lang", "path").sortWithinPartitions("lang", "path")
    names = ["lang", "place", "other", "high", "low"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch["lang"].to_pylist(), object)
            lengths = batch["path"].value_lengths().to_numpy().astype(np.int64)
            step = max(1, TREE_CELLS // int(lengths.max(initial=1)))
            cuts = {*np.flatnonzero(langs[1:] != langs[:-1]) + 1, *range(0, len(langs), step)}
            bounds = [*sorted(cuts), len(langs)]
            for start, stop in zip(bounds, bounds[1:]):
                own = batch.slice(start, stop - start)
                entries = own["path"].flatten()
                columns = (np.asarray(field, np.int64) for field in entries.flatten())
                tree = _Tree(lengths[start:stop], *columns, np.asarray(own["times"], np.int64))
                for sums in tree.corrections():
                    lang = pa.array([langs[start]] * len(sums[0]), pa.string())
                    yield pa.RecordBatch.from_arrays([lang, *map(pa.array, sums)], names)

    return rows.mapInArrow(add, "lang string, place long, other long, high long, low long")


def divergence(
    docs: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    top: int = TOP_TERMS,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: how a source differs from others of its language.

    A language keeps the terms that at least ``min_docs`` of its documents hold. A group's
    share of a kept term is ``1 + floor(10^9 (count + 1) / (N + V))`` with the N occurrences
    of all V kept terms in the group; the same goes for the language. A difference of
    shares p and q has the value ``floor((p - q)^2 / q)``.

    Part ``pair``: for each other source of the language, the sum over all kept terms, its
    share as q. Part ``term``: the ``top`` terms of the source with more than the language's
    share, which is q. Ranks go by value, falling, and then by item as UTF-8 bytes.

    Null text, language and source are empty ones. A group without terms has pairs, with
    values of absent terms; without kept terms they are 0. Rows repeated in full count as
    often as they stand. An empty table gives an empty result. Other columns are left out.
    A language's sources are numbered in one task; the result has a row for every pair.
    """
    per_term = W.partitionBy("lang", "term")
    counts = term_counts(docs, lang_col, source_col, text_col).select(
        "lang",
        "source",
        "term",
        "n",
        F.sum("n").over(per_term).alias("lang_n"),
        F.sum("docs").over(per_term).alias("lang_docs"),
        (F.row_number().over(per_term.orderBy("source")) == 1).cast("long").alias("lead"),
    )
    kept_terms = F.col("term").isNotNull() & (F.col("lang_docs") >= min_docs)
    counts = saved(counts.where(kept_terms | F.col("term").isNull()).drop("lang_docs"))

    real = F.col("term").isNotNull()
    langs = counts.groupBy("lang").agg(
        F.sum("n").alias("lang_total"), F.sum(F.when(real, F.col("lead")).otherwise(0)).alias("kept")
    )
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(langs, "lang")
    groups = groups.withColumns(
        {
            "place": F.row_number().over(W.partitionBy("lang").orderBy("source")).cast("long"),
            "absent": share("0"),
        }
    )
    groups = saved(groups)
    shares = counts.where(real).join(groups, ["lang", "source"]).withColumn("p", share("n"))

    over = shares.withColumn("q", share("lang_n", "lang_total")).where("p > q")
    terms = over.select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(value("p", "q")).alias("value")
    )

    def ranked(rows: DataFrame) -> DataFrame:
        by_value = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return rows.withColumn("rank", F.row_number().over(by_value))

    entry = F.struct("place", "p", "absent")
    paths = (
        shares.groupBy("lang", "term")
        .agg(F.array_sort(F.collect_list(entry)).alias("path"))
        .where(F.size("path") > 1)
        .groupBy("lang", "path")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    both = tree_sums(paths).groupBy("lang", "place", "other").agg(
        (
            F.sum(F.col("high").cast("decimal(20)")) * 2147483648 + F.sum(F.col("low").cast("decimal(20)"))
        ).cast("decimal(38)").alias("value")
    )

    others = groups.select("lang", F.col("place").alias("other"), F.col("absent").alias("other_absent"))
    single = (
        saved(shares.groupBy("lang", "place", "p", "absent").agg(F.count(F.lit(1)).alias("times")))
        .join(others, "lang")
        .where("place <> other")
    )

    def times(column: str, expression: str) -> Column:
        return F.sum(F.expr(f"cast({column} as decimal(12)) * ({expression})")).cast("decimal(38)").alias("value")

    of_first = single.groupBy("lang", "place", "other").agg(
        times("times", f"{value('p', 'other_absent')} - {value('absent', 'other_absent')}")
    )
    of_second = single.groupBy("lang", F.col("other").alias("place"), F.col("place").alias("other")).agg(
        times("times", f"{value('other_absent', 'p')} - {value('other_absent', 'absent')}")
    )
    neither = groups.join(others, "lang").where("place <> other")
    neither = neither.groupBy("lang", "place", "other").agg(
        times("kept", value("absent", "other_absent"))
    )
    sums = neither.unionByName(of_first).unionByName(of_second).unionByName(both)
    sums = sums.groupBy("lang", "place", "other").agg(F.sum("value").cast("long").alias("value"))
    named = groups.select("lang", "place", "source")
    pairs = (
        sums.join(named, ["lang", "place"])
        .join(named.select("lang", F.col("place").alias("other"), F.col("source").alias("item")), ["lang", "other"])
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    )
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))

"""Documents whose sets of word shingles are alike: an exact join that uses relations of sets."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from passages.llm.components import components
from passages.llm.exchange import (
    ANSWER_SCHEMA,
    ANSWERS,
    DEPTH,
    PIECE_SCHEMA,
    PIECES,
    block_bits,
    by_kind,
    counter_bits,
    counters,
    packed,
    ranges,
    sketch_pieces,
    table,
    unpack_sketch,
    unpacked,
)
from passages.llm.packed import (
    BASE,
    Flat,
    Hashes,
    first_of_runs,
    flat,
    mix,
    word_hashes,
    word_spans,
)
from passages.llm.shared import saved, text_groups

SHINGLE = 5
# Similarity as parts of a hundred, so that the comparison is exact.
PERCENT = 80
BYTES_PER_WORD = 6
# Members of a list's part; two parts are compared in one go.
PART = 1024
# Entries of lists that one task looks at together.
TASK_ENTRIES = 1 << 15
# Bytes of sets that one task compares, and sets that one hub is compared with there.
VERIFY_BYTES = 12 << 20
HUB_SETS = 512

SETS = "kind int, id {id}, s long, n int, r int, token long, payload binary"
DOCUMENT, ENTRY, SET = range(3)


@dataclass
class ShingleSets:
    """Distinct shingles of a group of texts: those of text ``i`` are ``hashes[cuts[i]:cuts[i + 1]]``."""

    hashes: np.ndarray
    text: np.ndarray
    cuts: np.ndarray
    keys: np.ndarray


def shingle_sets(texts: list[bytes], size: int) -> ShingleSets:
    """Shingles are runs of words, A-Z as a-z; a shorter text is one shingle of all its words.

    ``keys`` tells sets apart, 0 being the empty one.
    """
    text: Flat = flat(texts)
    data = text.data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    starts, ends = word_spans(data)
    words = word_hashes(data, starts, ends)
    first, last = np.searchsorted(starts, text.starts), np.searchsorted(starts, text.ends)
    n_words = last - first
    n = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    of = np.repeat(np.arange(len(texts)), n)
    begin = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    length = np.repeat(np.minimum(n_words, size), n)
    hashes = mix(Hashes(words, BASE).of(begin, begin + length) ^ mix(length.astype(np.uint64)))
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    new = first_of_runs(of, hashes)
    of, hashes = of[new], hashes[new]
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))])
    sizes = np.diff(cuts).astype(np.uint64)
    keys = np.where(sizes > 0, mix((sums[cuts[1:]] - sums[cuts[:-1]]) ^ mix(sizes)), 0)
    return ShingleSets(hashes, of, cuts, keys.astype(np.uint64))


def merge_frequencies(pieces: pa.Table, bits: int) -> pa.Table:
    """Counters of one range, summed over groups; the logarithm of each counter sent."""
    sent, weights, sizes = unpack_sketch(pieces, bits)
    _, place = np.unique(sent, return_inverse=True)
    classes = np.log2(np.bincount(place, weights)).astype(np.uint8)[place]
    rows, at = [], 0
    for g, kind, block, n in zip(
        pieces["g"].to_pylist(), pieces["kind"].to_pylist(), pieces["block"].to_pylist(), sizes, strict=True
    ):
        own = classes[at : at + n]
        at += n
        if own.any():
            rows.append((g, kind, block, packed(own)))
    return table(rows, ANSWER_SCHEMA)


def frequencies(keys: np.ndarray, answers: dict, bits: int, blocks: int) -> np.ndarray:
    """The logarithm of how many texts have a shingle, by the sketch: 0 is only one."""
    least = np.full(len(keys), 255, np.uint8)
    for row in range(DEPTH):
        own = counters(keys, row, bits)
        distinct = np.sort(own)
        distinct = distinct[first_of_runs(distinct)]
        classes = np.zeros(len(distinct), np.uint8)
        known = answers.get(row, {})
        for block, a, b in ranges(distinct, blocks):
            if block in known:
                classes[a:b] = unpacked(known[block], b - a, np.uint8)
        if len(distinct):
            least = np.minimum(least, classes[np.searchsorted(distinct, own)])
    return least


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def similar(size_a, size_b, overlap, percent: int):
    """Whether 100 * intersection >= percent * union."""
    return 100 * overlap >= percent * (size_a + size_b - overlap)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, size_a, size_b, overlap`` of ``pairs(a, b)``, by comparing their sets.

    Pairs are dealt by ``a`` in slices of at most ``HUB_SETS`` or so, so that a set that is
    paired with very many others is compared with them in many tasks.
    """
    many = pairs.groupBy("a").agg(F.count("*").alias("many"))
    sliced = pairs.join(many, "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.floor(F.col("many") / HUB_SETS).cast("long") + 1).alias("slice")
    )
    sliced = saved(sliced)
    right = sliced.join(sets, sliced["b"] == sets["s"]).select("a", "slice", "b", "payload")
    left = sliced.select("a", "slice").distinct().join(sets, F.col("a") == sets["s"])
    left = left.select("a", "slice", F.lit(None).cast("long").alias("b"), "payload")
    size = sliced.count() * 2 * 4096
    parts = max(1, -(-size // VERIFY_BYTES))
    rows = left.unionByName(right).withColumn("part", F.pmod(F.xxhash64("a", "slice"), F.lit(parts)))
    schema = pa.schema(
        [("a", pa.int64()), ("b", pa.int64()), ("size_a", pa.int32()), ("size_b", pa.int32()), ("overlap", pa.int32())]
    )

    def compare(rows: pa.Table) -> pa.Table:
        a, b = rows["a"].to_pylist(), rows["b"].to_pylist()
        sets = rows["payload"].to_pylist()
        hubs = {x: np.frombuffer(p, np.uint64) for x, y, p in zip(a, b, sets, strict=True) if y is None}
        found = []
        for x, y, payload in zip(a, b, sets, strict=True):
            if y is not None:
                one, two = hubs[x], np.frombuffer(payload, np.uint64)
                place = np.minimum(np.searchsorted(one, two), len(one) - 1)
                found.append((x, y, len(one), len(two), int((one[place] == two).sum())))
        return table(found, schema)

    return rows.groupBy("part").applyInArrow(
        compare, "a long, b long, size_a int, size_b int, overlap int"
    )


def shingle_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    percent: int = PERCENT,
) -> DataFrame:
    """``id, n_shingles, component_id`` of every row of ``docs``.

    Two texts link when the Jaccard similarity of their sets of ``size``-word shingles is
    at least ``percent`` of a hundred, exactly; ``component_id`` is the least id that links
    lead to. Equal sets are one set from the start, whatever the number of copies.

    Sets are indexed by their prefixes in an order from rare to common shingles, so alike
    sets share a shingle of their prefixes. The order is by the count in a count-min
    sketch of all texts, then by hash; shingles that only one text has are not indexed.
    Lists are skipped and answers derived by relations of sets:

    * Every list has a hub, its set with the largest share of repeated shingles (a copy's
      original rather than the copy). First, each set is compared with its lists' hubs.
    * Lists whose sets are then all linked, which the lists of near copies are, are
      skipped as blocks.
    * In the others, sets of different components within each other's range of sizes
      are looked at. Two sets share no more than the shingles that they share with any
      set at all, and what both have in common with the hub bounds what they have in
      common with each other, from below and above; this answers them without comparing
      sets, and only pairs in between are compared.

    So copies of copies cost as many comparisons as there are sets, not pairs, and no
    link between different components is lost. Null and empty texts have no shingles and
    link with nothing. Rows repeated link with each other. An empty table gives an empty
    result; other columns are left out.
    """
    groups = text_groups(docs, id_col, text_col)
    expected = groups.text_bytes / BYTES_PER_WORD
    bits, blocks = counter_bits(expected), block_bits(expected)
    id_type = groups.rows.schema["id"].dataType
    arrow_id = to_arrow_type(id_type)
    sets_schema = pa.schema(
        [
            ("kind", pa.int32()),
            ("id", arrow_id),
            ("s", pa.int64()),
            ("n", pa.int32()),
            ("r", pa.int32()),
            ("token", pa.int64()),
            ("payload", pa.binary()),
        ]
    )

    def sets_of(rows: pa.Table) -> ShingleSets:
        return shingle_sets(rows["text"].cast(pa.binary()).to_pylist(), size)

    def sketch(rows: pa.Table) -> pa.Table:
        found = sets_of(rows)
        keys = found.hashes
        return table(
            sketch_pieces(rows["g"][0].as_py(), keys, bits, blocks) if len(keys) else [], PIECE_SCHEMA
        )

    def merge(pieces: pa.Table) -> pa.Table:
        return merge_frequencies(pieces, bits)

    def index(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return sets_schema.empty_table()
        found = sets_of(rows)
        sizes = np.diff(found.cuts)
        classes = frequencies(found.hashes, by_kind(answers), bits, blocks)
        repeated = np.concatenate([[0], np.cumsum(classes > 0)])
        shared = repeated[found.cuts[1:]] - repeated[found.cuts[:-1]]
        # Of equal sets of a group, the first goes into the index.
        chosen = np.zeros(len(sizes), bool)
        chosen[np.unique(found.keys, return_index=True)[1]] = True
        prefix = sizes - -(-percent * sizes // 100) + 1
        order = np.lexsort((found.hashes, classes, found.text))
        place = np.arange(len(order)) - found.cuts[found.text]
        inside = (place < prefix[found.text]) & (classes[order] > 0) & chosen[found.text]
        entries, of = found.hashes[order][inside], found.text[inside]
        indexed = np.unique(of)
        raw = [found.hashes[found.cuts[t] : found.cuts[t + 1]].tobytes() for t in indexed.tolist()]
        texts = np.arange(len(sizes))

        def part(kind: int, at: np.ndarray, ids, token, payload) -> pa.Table:
            return pa.table(
                [
                    pa.array(np.full(len(at), kind), pa.int32()),
                    ids,
                    signed(found.keys[at]),
                    pa.array(sizes[at], pa.int32()),
                    pa.array(shared[at], pa.int32()),
                    token,
                    payload,
                ],
                schema=sets_schema,
            )

        nulls = lambda n, kind: pa.nulls(n, kind)
        return pa.concat_tables(
            [
                part(DOCUMENT, texts, rows["id"].combine_chunks().cast(arrow_id), nulls(len(texts), pa.int64()), nulls(len(texts), pa.binary())),
                part(ENTRY, of, nulls(len(of), arrow_id), signed(entries), nulls(len(of), pa.binary())),
                part(SET, indexed, nulls(len(indexed), arrow_id), nulls(len(indexed), pa.int64()), pa.array(raw, pa.binary())),
            ]
        )

    by_group = groups.rows.groupBy("g")
    answers = saved(
        by_group.applyInArrow(sketch, PIECES).groupBy("kind", "block").applyInArrow(merge, ANSWERS)
    )
    indexed = saved(
        by_group.cogroup(answers.groupBy("g")).applyInArrow(
            index, SETS.format(id=id_type.simpleString())
        )
    )
    documents = indexed.where(F.col("kind") == DOCUMENT).select("id", "s", "n")
    entries = indexed.where(F.col("kind") == ENTRY).select("token", "s", "n", "r").distinct()
    share = (1000 * F.col("r") / F.col("n")).cast("int").alias("share")
    lists = (
        entries.groupBy("token")
        .agg(F.count("*").alias("members"), F.max(F.struct(share, "s", "n", "r")).alias("hub"))
        .where("members > 1")
        .select("token", "members", F.col("hub.s").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.r").alias("hub_r"))
    )
    entries = saved(entries.join(lists, "token"))
    fitting = similar(F.col("n"), F.col("hub_n"), F.least("r", "hub_r"), percent)
    pairs = entries.where(fitting & (F.col("s") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("s").alias("b")).distinct()
    members = entries.select("s").distinct()
    sets = (
        indexed.where(F.col("kind") == SET)
        .select("s", "payload")
        .join(members, "s", "left_semi")
        .groupBy("s")
        .agg(F.first("payload").alias("payload"))
    )
    sets = saved(sets)
    linked = similar(F.col("size_a"), F.col("size_b"), F.col("overlap"), percent)
    to_hubs = saved(verified(pairs, sets))
    links = to_hubs.where(linked).select("a", "b")

    # Lists with sets of more than one component.
    roots = saved(components(links))
    entries = entries.join(roots.withColumnRenamed("node", "s"), "s", "left").withColumn(
        "root", F.coalesce("root", "s")
    )
    entries = saved(entries)
    split = entries.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    rest = entries.join(split.select("token"), "token", "left_semi").join(
        to_hubs.select(F.col("a").alias("hub"), F.col("b").alias("s"), "overlap"), ["hub", "s"], "left"
    )
    parts = F.floor((F.col("members") - 1) / PART).cast("int") + 1
    tasks = max(1, entries.count() // TASK_ENTRIES)
    rest = (
        rest.withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("s"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "token", "s", "n", "r", "root", "hub_n", "part",
            F.when(F.col("s") == F.col("hub"), F.col("r")).otherwise(F.col("overlap")).alias("overlap"),
            F.least("part", "other").alias("one"),
            F.greatest("part", "other").alias("two"),
        )
        .withColumn("task", F.pmod(F.xxhash64("token", "one", "two"), F.lit(tasks)))
    )
    pairs_schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_())])

    def across(rows: pa.Table) -> pa.Table:
        """Pairs of one task's lists that are neither linked already nor ruled out."""
        token, one, two = (rows[c].to_numpy() for c in ("token", "one", "two"))
        s, n, r, root, hub_n = (
            rows[c].to_numpy().astype(np.int64) for c in ("s", "n", "r", "root", "hub_n")
        )
        part = rows["part"].to_numpy()
        overlap = rows["overlap"].fill_null(-1).to_numpy().astype(np.int64)
        order = np.lexsort((n, two, one, token))
        cut = np.flatnonzero(first_of_runs(token[order], one[order], two[order]))
        found = []
        for low, high in zip(cut, np.append(cut[1:], len(order)), strict=True):
            own = order[low:high]
            sizes = n[own]
            # Sets in order of size: those after the range of a set's size are skipped.
            ends = np.searchsorted(sizes, sizes * 100 // percent, side="right")
            for i in range(len(own) - 1):
                x, others = own[i], own[i + 1 : ends[i]]
                others = others[(root[others] != root[x]) & ((one[x] == two[x]) | (part[others] != part[x]))]
                if not len(others):
                    continue
                most = np.minimum(r[x], r[others])
                least = np.zeros(len(others), np.int64)
                known = (overlap[x] >= 0) & (overlap[others] >= 0)
                shared = np.minimum(overlap[x], overlap[others])
                left = np.minimum(r[x] - overlap[x], r[others] - overlap[others])
                most = np.where(known, np.minimum(most, shared + left), most)
                least = np.where(known, np.maximum(0, overlap[x] + overlap[others] - hub_n[x]), least)
                sure = similar(n[x], n[others], least, percent)
                maybe = similar(n[x], n[others], most, percent)
                for y, is_sure in zip(others[maybe].tolist(), sure[maybe].tolist(), strict=True):
                    a, b = sorted((int(s[x]), int(s[y])))
                    found.append((a, b, is_sure))
        return table(list(set(found)), pairs_schema)

    further = saved(
        rest.groupBy("task").applyInArrow(across, "a long, b long, sure boolean")
        .groupBy("a", "b").agg(F.max("sure").alias("sure"))
    )
    asked = further.where("not sure").select("a", "b").join(to_hubs.select("a", "b"), ["a", "b"], "left_anti")
    asked = asked.join(to_hubs.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    more = saved(
        verified(asked, sets).where(linked).select("a", "b").unionByName(further.where("sure").select("a", "b"))
    )
    if not more.isEmpty():
        roots = components(
            more.unionByName(roots.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        )

    least = documents.where("n > 0").groupBy("s").agg(F.min("id").alias("least"))
    by_set = least.join(roots.withColumnRenamed("node", "s"), "s", "left").withColumn(
        "root", F.coalesce("root", "s")
    )
    by_root = by_set.groupBy("root").agg(F.min("least").alias("component_id"))
    by_set = by_set.join(by_root, "root").select("s", "component_id")
    # Empty sets link with nothing; their id is their own.
    return documents.join(by_set, "s", "left").select(
        "id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
    )

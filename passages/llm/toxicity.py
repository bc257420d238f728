"""Toxicity from averaged subword embeddings and a linear softmax, trained jointly."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from passages.llm.packed import (
    BASE,
    OTHER_BASE,
    Hashes,
    first_of_runs,
    flat,
    values_of,
    word_spans,
)
from passages.llm.shared import saved

# Bytes of the subwords, and the number of buckets that they are hashed to.
SIZES = (3, 4, 5)
BUCKET_BITS = 16
# Toxic and other documents at most that the model is fitted on; whole texts of them.
FIT_ROWS = (1500, 4500)
# Part of the fitted documents that a bucket must occur in, else it has no effect.
LEAST = 0.01
SHARE_SCALE = 1024
# Part of a text that one word makes up at most, and words of no effect in each text.
MOST = 0.02
NEUTRAL = 30
DIM = 8
EPOCHS = 6
BATCH = 200
RATE = 0.05
DECAY = 1e-6
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
# Bytes of text that are looked at together.
SLAB_BYTES = 1 << 20


@dataclass
class Model:
    """The vectors of all buckets, and the weights of the softmax; ``prior`` is added to it."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    prior: float

    def logits_of_buckets(self) -> tuple[np.ndarray, float]:
        """What a bucket adds to the log odds: averages of vectors and weights commute."""
        away = self.weights[:, 1] - self.weights[:, 0]
        return self.vectors @ away, float(self.bias[1] - self.bias[0]) + self.prior


def slabs(texts: list[bytes | None]) -> Iterator[list[bytes]]:
    """Runs of texts of about ``SLAB_BYTES``; null is empty."""
    slab, size = [], 0
    for text in texts:
        slab.append(text or b"")
        size += len(slab[-1]) + 1
        if size >= SLAB_BYTES:
            yield slab
            slab, size = [], 0
    if slab:
        yield slab


@dataclass
class Words:
    """The distinct words of some texts: the text of each, its weight in it, its subwords.

    ``text`` is sorted. Word ``i`` has the subwords that start from ``starts[i]`` on:
    ``buckets[size][at]`` is the bucket of the subword of that size at a place, and
    ``ends[i] - size`` the last such place.
    """

    text: np.ndarray
    weight: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    buckets: list[np.ndarray]


def subword_words(texts: list[bytes]) -> Words:
    """Words with the blank before and after them; A-Z count as a-z.

    A word weighs as often as it occurs, but at most ``MOST`` of a text, so that one word
    said a thousand times does not decide alone; ``NEUTRAL`` words without effect are
    added to each text, so that a text of a few words is not judged by each of them.
    """
    text = flat([b"", *texts])  # so that the first text has a blank before it, too
    data = text.data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    data[(data >= 9) & (data <= 13)] = 32
    starts, ends = word_spans(data)
    of = np.searchsorted(text.ends[1:], starts)
    key = Hashes(values_of(BASE)[data], BASE).of(starts, ends) + of.astype(np.uint64) * np.uint64(OTHER_BASE)
    order = np.lexsort((key, of))
    first = np.flatnonzero(first_of_runs(of[order], key[order]))
    counts = np.diff(np.append(first, len(order)))
    chosen = order[first]
    of, starts, ends = of[chosen], starts[chosen] - 1, ends[chosen] + 1
    n = np.bincount(of, counts, len(texts))[of]
    weight = np.minimum(counts, np.maximum(1, MOST * n)) / (n + NEUTRAL)
    wide = np.concatenate([data, np.full(max(SIZES), 32, np.uint8)]).astype(np.uint64)
    buckets = []
    for size in SIZES:
        keys = np.full(len(data), size, np.uint64)
        for at in range(size):
            keys = (keys << np.uint64(8)) | wide[at : at + len(data)]
        buckets.append(((keys * MULTIPLIER) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
    return Words(of, weight, starts, ends, buckets)


def counts_of(words: Words) -> np.ndarray:
    """How many subwords each word has; a word of one letter has one, of three bytes."""
    lengths = words.ends - words.starts
    return sum(np.maximum(0, lengths - size + 1) for size in SIZES)


def bags(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Buckets of each text and the part of its bag that each makes up."""
    buckets, shares = [], []
    for slab in slabs(batch["text"].cast(pa.binary()).to_pylist()):
        words = subword_words(slab)
        part = words.weight / counts_of(words)
        keys, parts = [], []
        for size, own in zip(SIZES, words.buckets, strict=True):
            n = np.maximum(0, words.ends - words.starts - size + 1)
            at = np.repeat(words.starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
            keys.append(np.repeat(words.text, n) << BUCKET_BITS | own[at])
            parts.append(np.repeat(part, n))
        key, place = np.unique(np.concatenate(keys), return_inverse=True)
        value = np.bincount(place, np.concatenate(parts)).astype(np.float32)
        cuts = np.searchsorted(key, np.arange(len(slab) + 1) << BUCKET_BITS)
        key = (key & ((1 << BUCKET_BITS) - 1)).astype(np.int32)
        buckets += [key[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        shares += [value[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.RecordBatch.from_arrays(
        [
            batch["toxic"].cast(pa.int32()),
            pa.array(buckets, pa.list_(pa.int32())),
            pa.array(shares, pa.list_(pa.float32())),
        ],
        names=["toxic", "buckets", "shares"],
    )


def packed_bags(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The same with two bytes per bucket and per part, as many of them go to the driver."""
    found = bags(batch)

    def pack(column: pa.ListArray, kind) -> pa.Array:
        data = column.flatten().to_numpy().astype(kind)
        offsets = np.asarray(column.offsets, np.int32) * 2
        return pa.Array.from_buffers(
            pa.binary(), len(column), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())]
        )

    # Parts are far below 1; scaled, they keep their precision in two bytes.
    shares = pa.ListArray.from_arrays(
        found["shares"].offsets, pa.array(found["shares"].flatten().to_numpy() * SHARE_SCALE)
    )
    return pa.RecordBatch.from_arrays(
        [batch["h"], found["toxic"], pack(found["buckets"], np.uint16), pack(shares, np.float16)],
        names=["h", "toxic", "buckets", "shares"],
    )


def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The buckets of some packed bags, and how many of the bags each is in."""
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for batch in batches:
        for bag in batch["buckets"]:
            counts[np.frombuffer(bag.as_buffer(), np.uint16)] += 1  # a bag has each once
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["bucket", "n"]
    )


def only_common(batch: pa.RecordBatch, common: np.ndarray) -> pa.RecordBatch:
    """Packed bags without the buckets that are not common."""
    buckets, shares = [], []
    for bag, parts in zip(batch["buckets"], batch["shares"], strict=True):
        bag = np.frombuffer(bag.as_buffer(), np.uint16)
        some = common[bag]
        buckets.append(bag[some].tobytes())
        shares.append(np.frombuffer(parts.as_buffer(), np.float16)[some].tobytes())
    return pa.RecordBatch.from_arrays(
        [batch["h"], batch["toxic"], pa.array(buckets, pa.binary()), pa.array(shares, pa.binary())],
        names=["h", "toxic", "buckets", "shares"],
    )


def joined(column: pa.ChunkedArray, order: np.ndarray, offsets: np.ndarray, kind) -> np.ndarray:
    """The numbers of packed rows in a given order, copied once; ``offsets`` are in that order."""
    out = np.empty(offsets[-1], kind)
    for row, begin, end in zip(order.tolist(), offsets[:-1], offsets[1:], strict=True):
        out[begin:end] = np.frombuffer(column[row].as_buffer(), kind)
    return out


def log_odds(texts: list[bytes], of_bucket: np.ndarray) -> np.ndarray:
    """The average of what the buckets of each text add to the log odds."""
    words = subword_words(texts)
    total = np.zeros(len(words.text))
    for size, own in zip(SIZES, words.buckets, strict=True):
        sums = np.concatenate([[0.0], np.cumsum(of_bucket[own], dtype=np.float64)])
        last = np.maximum(words.ends - size + 1, words.starts)
        total += sums[last] - sums[words.starts]
    return np.bincount(words.text, words.weight * total / counts_of(words), len(texts))


def trained(
    labels: np.ndarray, offsets: np.ndarray, buckets: np.ndarray, shares: np.ndarray, common: np.ndarray, prior: float
) -> Model:
    """Vectors and softmax by gradient steps (Adam) on batches of bags, always in one order.

    The bags hold ``common`` buckets only; others have no effect. The prior of the sample
    is taken off again, so that ``prior`` alone holds.
    """
    prior -= float(np.log((labels == 1).sum() / (labels == 0).sum()))
    random = np.random.default_rng(17)
    n_buckets = 1 << BUCKET_BITS
    vectors = random.normal(0, 0.1, (n_buckets, DIM))
    weights = random.normal(0, 0.3, (DIM, 2))
    bias = np.zeros(2)
    parameters = [vectors, weights, bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    # Shares are small; their scale is part of the model.
    scale = 30.0 / SHARE_SCALE
    step = 0
    for _ in range(EPOCHS):
        order = random.permutation(len(labels))
        for begin in range(0, len(order), BATCH):
            rows = order[begin : begin + BATCH]
            lengths = offsets[rows + 1] - offsets[rows]
            row = np.repeat(np.arange(len(rows)), lengths)
            at = np.repeat(offsets[rows] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            index, value = buckets[at].astype(np.int64), shares[at].astype(np.float64) * scale
            bag = np.stack([np.bincount(row, value * vectors[index, d], len(rows)) for d in range(DIM)], 1)
            logits = bag @ weights + bias
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = odds / odds.sum(axis=1, keepdims=True)
            error[np.arange(len(rows)), labels[rows]] -= 1
            error /= len(rows)
            back = error @ weights.T
            gradients = [
                np.stack([np.bincount(index, value * back[row, d], n_buckets) for d in range(DIM)], 1)
                + DECAY * vectors,
                bag.T @ error,
                error.sum(axis=0),
            ]
            step += 1
            for p, g, (m, v) in zip(parameters, gradients, moments, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    vectors = np.where(common[:, None], vectors * scale * SHARE_SCALE, 0).astype(np.float32)
    return Model(vectors, weights, bias, prior)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rows: tuple[int, int] = FIT_ROWS,
) -> Model:
    """A model of the labelled documents, from at most ``rows`` toxic and other ones.

    The sample is the same in every run: the first rows in the order of a hash of the
    id. Only it reaches the driver, as bags of buckets without those that are too rare to
    have an effect, which are counted and left out before. The shares of the labels among
    all labelled rows set the prior. Rows without an id or a label are left out; without
    rows of both labels the model gives the prior alone.
    """
    known = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label_col).cast("int").alias("toxic"))
    )
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = float(np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)))
    sample = None
    for label, most in zip((1, 0), rows, strict=True):
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(most)
        sample = part if sample is None else sample.unionByName(part)
    texts = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .join(sample, "id")
        .select("toxic", "text", F.xxhash64("id", "text").alias("h"))
    )
    packed = "h long, toxic int, buckets binary, shares binary"
    bagged = saved(texts.mapInArrow(lambda batches: (packed_bags(b) for b in batches), packed))
    least = max(2, LEAST * bagged.count())
    often = (
        bagged.mapInArrow(frequencies, "bucket int, n long")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= least)
        .toArrow()
    )
    common = np.zeros(1 << BUCKET_BITS, bool)
    common[often["bucket"].to_numpy()] = True
    found = bagged.mapInArrow(lambda batches: (only_common(b, common) for b in batches), packed).toArrow()
    order = np.argsort(found["h"].to_numpy(), kind="stable")
    toxic = found["toxic"].to_numpy()[order]
    empty = Model(
        np.zeros((1 << BUCKET_BITS, DIM), np.float32), np.zeros((DIM, 2)), np.zeros(2), prior
    )
    if len(np.unique(toxic)) < 2:
        return empty
    sizes = pc.binary_length(found["buckets"]).to_numpy()[order] // 2
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    buckets = joined(found["buckets"], order, offsets, np.uint16)
    shares = joined(found["shares"], order, offsets, np.float16)
    del found
    return trained(toxic, offsets, buckets, shares, common, prior)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score, predicted`` of every row of ``docs``; only the text is looked at.

    The texts are read once and not shuffled; the model (a number per bucket) goes to the
    tasks. Null and empty texts have no subwords and get the score of the bias. A row
    repeated gets its score again. Other columns are left out.
    """
    spark = docs.sparkSession
    values, bias = model.logits_of_buckets()
    shared = spark.sparkContext.broadcast(values.astype(np.float32))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType
    arrow_id = to_arrow_type(id_type)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_bucket = shared.value
        for batch in batches:
            odds = []
            for slab in slabs(batch["text"].cast(pa.binary()).to_pylist()):
                odds.append(log_odds(slab, of_bucket) + bias)
            logit = np.concatenate(odds) if odds else np.zeros(0)
            value = np.round(1 / (1 + np.exp(-np.clip(logit, -40, 40))), 6)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"].cast(arrow_id),
                    pa.array(value),
                    pa.array((value >= 0.5).astype(np.int32)),
                ],
                names=["id", "score", "predicted"],
            )

    return rows.mapInArrow(score, f"id {id_type.simpleString()}, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, with all their columns."""
    values, bias = model.logits_of_buckets()
    shared = docs.sparkSession.sparkContext.broadcast(values.astype(np.float32))
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            odds = [log_odds(slab, shared.value) + bias for slab in slabs(texts)]
            toxic = np.concatenate(odds) >= 0 if odds else np.zeros(0, bool)
            yield batch.filter(pa.array(~toxic))

    return docs.mapInArrow(keep, docs.schema)


def held_out(id_column: Column) -> Column:
    """Whether a row is kept for testing: one in five, by the CRC-32 of its id as text."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))

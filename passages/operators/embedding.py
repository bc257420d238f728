"""A vector per text, from a model the caller supplies or from hashed words."""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.functions.text import words

# Fixed value: texts per call of the model.
CALL_SIZE = 150
VECTORS = pa.list_(pa.float32())
# Numbers of vectors that are counted at once.
_TILE = 1 << 22

Model = Callable[[list[str]], list]


def in_calls(model: Callable[[list[str]], list], texts: list[str], call_size: int) -> Iterator:
    """The texts and results of each call; a wrong number of results fails the job."""
    for i in range(0, len(texts), call_size):
        asked = texts[i : i + call_size]
        results = list(model(asked))
        if len(results) != len(asked):
            raise RuntimeError(f"the model gave {len(results)} results for {len(asked)} texts")
        yield asked, results


def _call(model: Model, texts: list[str], narrow: bool) -> list:
    """Vectors of one call. A ValueError leaves the whole call without vectors, or, asked to
    narrow it down, only the texts that raise it alone: a call that fails is made again in
    halves, so f such texts among n cost about 2 f log2(n / f) more calls, not n."""
    try:
        return [v for _, results in in_calls(model, texts, len(texts)) for v in results]
    except ValueError:
        if not narrow or len(texts) == 1:
            return [None] * len(texts)
        half = len(texts) // 2
        return _call(model, texts[:half], True) + _call(model, texts[half:], True)


def add_embedding(
    df: DataFrame,
    make_model: Callable[[], Model],
    text: str = "content",
    output: str = "embedding",
    call_size: int = CALL_SIZE,
    retry_one_by_one: bool = False,
) -> DataFrame:
    """Add the model's vector of each text.

    ``make_model()`` runs once per task and returns a function from a list of texts
    to a list of vectors, which is called with at most ``call_size`` texts. A call
    that raises ValueError gives null vectors, any other error fails the job, and so does
    a wrong number of vectors. A null text is not sent and has a null vector.
    """

    @F.arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make_model()
        for batch in batches:
            texts = batch.drop_null()
            parts = [pa.array([], VECTORS)]
            for i in range(0, len(texts), call_size):
                called = _call(model, texts[i : i + call_size].to_pylist(), retry_one_by_one)
                parts.append(pa.array(called, VECTORS))
            known = batch.is_valid()
            place = pa.compute.cumulative_sum(known.cast(pa.int64()))
            place = pa.compute.if_else(known, pa.compute.subtract(place, 1), None)
            yield pa.concat_arrays(parts).take(place)

    # Not deterministic, so that a later filter on the vectors does not call it again.
    return df.withColumn(output, embed.asNondeterministic()(F.col(text)))


def failed_embeddings(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    return df.where(F.col(embedding).isNull())


def valid_embeddings(df: DataFrame, dim: int, embedding: str = "embedding") -> DataFrame:
    """Rows with a vector of ``dim`` numbers; the others cannot be searched."""
    return df.where(F.col(embedding).isNotNull() & (F.size(embedding) == dim))


def word_buckets(text: Column, dim: int) -> Column:
    """Bucket of each lower-cased word: the first 8 hex digits of its MD5, modulo ``dim``."""
    return F.transform(
        words(F.lower(text)),
        lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % dim).cast("int"),
    )


def _unit_counts(buckets: np.ndarray, row: np.ndarray, rows: int, dim: int) -> np.ndarray:
    """Counts of the buckets of each row at unit length; ``row`` is sorted."""
    vectors = np.empty((rows, dim), np.float32)
    step = max(1, _TILE // dim)
    for start in range(0, rows, step):
        n = min(step, rows - start)
        low, high = np.searchsorted(row, [start, start + n])
        place = (row[low:high] - start) * dim + buckets[low:high]
        counts = np.bincount(place, minlength=n * dim).reshape(n, dim)
        norms = np.sqrt((counts.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
        vectors[start : start + n] = counts / np.where(norms == 0, 1, norms)
    return vectors


def _vector_array(vectors: np.ndarray, known: np.ndarray) -> pa.Array:
    rows, dim = vectors.shape
    offsets = pa.array(np.arange(rows + 1) * dim, pa.int32())
    lists = pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel(), pa.float32()))
    return pa.compute.if_else(pa.array(known), lists, pa.scalar(None, lists.type))


def add_lexical_embedding(
    df: DataFrame, dim: int, text: str = "content", output: str = "embedding"
) -> DataFrame:
    """Add the hashed word counts of each text, scaled to unit length.

    A model that needs no service. Words are hashed by built-in expressions; Python
    only counts integers, one batch at a time, so no row is shuffled. A text without
    words has the zero vector.
    """

    @F.arrow_udf("array<float>")
    def count(batch: pa.Array) -> pa.Array:
        known = batch.is_valid().to_numpy(zero_copy_only=False)
        rows = len(batch)
        row = np.repeat(np.arange(rows), batch.value_lengths().fill_null(0).to_numpy())
        vectors = _unit_counts(batch.flatten().to_numpy(zero_copy_only=False), row, rows, dim)
        return _vector_array(vectors, known)

    once = count.asNondeterministic()
    return df.withColumn(output, once(word_buckets(F.col(text), dim)))


def lexical_model(dim: int) -> Model:
    """The same vectors as a function of texts, for ``add_embedding``."""

    def embed(texts: list[str]) -> list[np.ndarray]:
        found = [
            [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim for w in text.lower().split()]
            for text in texts
        ]
        row = np.repeat(np.arange(len(texts)), [len(b) for b in found])
        buckets = np.array([b for text in found for b in text], dtype=np.int64)
        return list(_unit_counts(buckets, row, len(texts), dim))

    return embed

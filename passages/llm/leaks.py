"""Benchmark items in training texts: a BM25 index of the items, asked with every passage."""

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from passages.llm.packed import BASE, Flat, Hashes, first_of_runs, flat, mix, word_hashes
from passages.llm.shared import saved

K1, B = 1.2, 0.75
# Part of an item's own score from which on it is retrieved for a passage.
RETRIEVED = 0.5
SIMILARITY = 0.8
SHINGLE = 5
# Items of a block of a posting list, for which the best impact is kept.
BLOCK_ITEMS = 16
# Text of the items that are indexed together; the index goes to every task.
SHARD_BYTES = 16 << 20
SLAB_BYTES = 1 << 20
# Terms in more than this part of the items are left to the second look.
COMMON = 0.02

WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Terms:
    """Words of some texts, as hashes; text ``i`` has those from ``first[i]`` to ``last[i]``."""

    text: Flat
    hashes: np.ndarray
    first: np.ndarray
    last: np.ndarray


def terms_of(texts: list[bytes]) -> Terms:
    """Words are runs of ASCII letters and digits, A-Z as a-z, and of all beyond ASCII."""
    text = flat(texts)
    data = text.data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[0::2], edges[1::2]
    hashes = word_hashes(data, starts, ends)
    return Terms(text, hashes, np.searchsorted(starts, text.starts), np.searchsorted(starts, text.ends))


def shingles(words: np.ndarray) -> set[int]:
    """Hashes of five words in a row; of all words where there are fewer."""
    if not len(words):
        return set()
    return set(mix(Hashes(words, BASE).windows(min(SHINGLE, len(words)))).tolist())


def answer_mark(text: str):
    """The last mark of an answer that a question stands before, if any."""
    import re

    marks = list(re.finditer(r"(?im)^\s*(?:answer|a)\s*[:.)]", text))
    return marks[-1] if marks and text[: marks[-1].start()].strip() else None


def question_and_answer(text: str) -> tuple[str, str]:
    """The parts of an item: an answer begins at a mark, else it is the last sentence."""
    import re

    if mark := answer_mark(text):
        return text[: mark.start()], text[mark.end() :]
    stripped = text.rstrip()
    ends = [m.end() for m in re.finditer(r"[.!?]\s+", stripped)]
    return (stripped[: ends[-1]], stripped[ends[-1] :]) if ends else (stripped, "")


class Index:
    """Posting lists of the items, with impacts as parts of an item's own score.

    ``terms`` is sorted; the list of term ``t`` is ``items[cuts[t]:cuts[t + 1]]`` in
    order, with ``impacts``. ``best`` is the largest impact of a list, ``block_best`` that
    of each of its blocks, a block being ``BLOCK_ITEMS`` consecutive numbers of items.
    """

    def __init__(self, ids: list, texts: list[str], postings: pa.Table):
        self.ids = ids
        numbers = {i: n for n, i in enumerate(ids)}
        item = np.array([numbers[i] for i in postings["id"].to_pylist()], np.int64)
        words = [w.encode() for w in postings["term"].to_pylist()]
        term = terms_of(words).hashes
        impact = postings["impact"].to_numpy()
        own = np.bincount(item, impact, len(ids))
        impact = impact / own[item]
        order = np.lexsort((item, term))
        term, self.items, self.impacts = term[order], item[order], impact[order]
        at = np.flatnonzero(first_of_runs(term))
        self.terms, self.cuts = term[at], np.append(at, len(term))
        self.best = np.maximum.reduceat(self.impacts, at) if len(at) else np.zeros(0)
        # Impacts of common terms count in full for every item, until the second look.
        counts = np.diff(self.cuts)
        self.common = counts > max(1, COMMON * len(ids))
        rest = np.repeat(self.common, counts)
        self.head_start = np.bincount(self.items[rest], self.impacts[rest], len(ids))
        self.block_best = []
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            blocks = self.items[a:b] // BLOCK_ITEMS
            cut = np.flatnonzero(first_of_runs(blocks))
            self.block_best.append(
                dict(zip(blocks[cut].tolist(), np.maximum.reduceat(self.impacts[a:b], cut).tolist(), strict=True))
            )
        self.parts, self.sizes = [], []
        for text in texts:
            question, answer = question_and_answer(text)
            q = terms_of([question.encode(), answer.encode()])
            a = q.hashes[q.first[1] : q.last[1]]
            marked = answer_mark(text) is not None
            # Prose is asked as a whole; its last sentence alone decides nothing.
            words = q.hashes[q.first[0] : q.last[0]] if marked else terms_of([text.encode()]).hashes
            self.sizes.append(min(SHINGLE, max(1, len(words))))
            self.parts.append((shingles(words), set(a.tolist()), marked))

    def may_retrieve(self, passage: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Passages of which some item may reach the threshold, by an upper bound.

        ``passage, term`` are distinct pairs. The bound of an item is its impacts of the
        rare terms that the passage has, and of all its common terms.
        """
        rare = ~self.common[term]
        passage, term = passage[rare], term[rare]
        counts = self.cuts[term + 1] - self.cuts[term]
        at = np.repeat(self.cuts[term] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        key = np.repeat(passage, counts) * len(self.ids) + self.items[at]
        place = np.argsort(key, kind="stable")
        key = key[place]
        cut = np.flatnonzero(first_of_runs(key))
        bound = np.add.reduceat(self.impacts[at][place], cut) if len(cut) else np.zeros(0)
        bound += self.head_start[key[cut] % len(self.ids)]
        possible = np.zeros(n, bool)
        possible[key[cut[bound >= RETRIEVED - 1e-9]] // len(self.ids)] = True
        if (self.head_start >= RETRIEVED).any():
            possible[:] = True
        return possible

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items whose score for the terms is at least the threshold, by block-max WAND.

        Lists are kept by their next item. The pivot is the first list at which the best
        impacts of the lists up to there reach the threshold; no item before the pivot's
        can. Before an item is scored, the best impacts of its blocks must reach it too,
        else all lists up to the pivot move beyond the nearest end of these blocks.
        """
        found = []
        items, impacts = self.items, self.impacts
        lists = [[int(items[self.cuts[t]]), int(self.cuts[t]), int(self.cuts[t + 1]), t] for t in terms]
        lists.sort()
        while lists:
            bound, pivot = 0.0, -1
            for n, entry in enumerate(lists):
                bound += self.best[entry[3]]
                if bound >= RETRIEVED - 1e-9:
                    pivot = n
                    break
            if pivot < 0:
                return found
            target = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == target:
                pivot += 1
            block = target // BLOCK_ITEMS
            if sum(self.block_best[e[3]].get(block, 0.0) for e in lists[: pivot + 1]) < RETRIEVED - 1e-9:
                beyond = (block + 1) * BLOCK_ITEMS
                if pivot + 1 < len(lists):
                    beyond = min(beyond, lists[pivot + 1][0])
            elif lists[0][0] == target:
                score = sum(float(impacts[e[1]]) for e in lists[: pivot + 1])
                if score >= RETRIEVED - 1e-9:
                    found.append((target, score))
                beyond = target + 1
            else:
                beyond = target
            moved = []
            for entry in lists[: pivot + 1]:
                if entry[0] < beyond:
                    at = int(np.searchsorted(items[entry[1] : entry[2]], beyond)) + entry[1]
                    if at == entry[2]:
                        continue
                    entry[0], entry[1] = int(items[at]), at
                moved.append(entry)
            moved.sort()
            lists = list(heapq.merge(moved, lists[pivot + 1 :]))
        return found


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """``id, item_id, word, score, question_overlap, answer_overlap``: items found in texts.

    Every text is cut into passages of twice the words of the longest item, each half
    over the next, so that an item lies whole in one. Each passage asks a BM25 index of
    the items for all of them that score at least half of what the item's own text would
    score. Each is then verified. Where an item marks an answer, by a line ``Answer:`` or
    ``A:``, at least ``similarity`` of the question's five-word shingles must be in the
    passage, and so must that part of the answer's words. Of any other item so much of
    the shingles of its whole text must be there; ``question_overlap`` is that of the
    whole text then, and ``answer_overlap``, of the last sentence, decides nothing. A row
    per text and item, for the passage with most of the question, the first of equals.

    The texts are read once per shard of the index (one, up to ``SHARD_BYTES`` of items)
    and not shuffled; document frequencies are counted over all items. Items without
    words, or null, are found nowhere; equal items are found together. Null and empty
    texts hold none. A text repeated gives its rows again. Other columns are left out.
    """
    id_type = docs.schema[id_col].dataType
    item_type = items.schema[item_col].dataType
    out = (
        f"id {id_type.simpleString()}, item_id {item_type.simpleString()}, word long, score double,"
        " question_overlap double, answer_overlap double"
    )
    arrow_id = to_arrow_type(id_type)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.sparkSession.createDataFrame([], out)
    for shard in _shards(items, item_col, item_text_col):

        def search(batches: Iterator[pa.RecordBatch], shard=shard) -> Iterator[pa.RecordBatch]:
            index, length, item_ids = pickle.loads(shard.value)
            for batch in batches:
                hits = hits_of(batch["text"].cast(pa.binary()).to_pylist(), index, length, similarity)
                columns = list(zip(*hits, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["id"].cast(arrow_id).take(pa.array(columns[0], pa.int64())),
                        item_ids.take(pa.array(columns[1], pa.int64())),
                        pa.array(columns[2], pa.int64()),
                        *(pa.array(np.round(np.array(c, float), 6)) for c in columns[3:]),
                    ],
                    names=["id", "item_id", "word", "score", "question_overlap", "answer_overlap"],
                )

        found = found.unionByName(rows.where("text is not null").mapInArrow(search, out))
    return found


def without_leaks(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """The rows of ``docs`` in which ``leaks`` finds no item, with all their columns."""
    at = docs.columns.index(text_col)
    for shard in _shards(items, item_col, item_text_col):

        def keep(batches: Iterator[pa.RecordBatch], shard=shard) -> Iterator[pa.RecordBatch]:
            index, length, _ = pickle.loads(shard.value)
            for batch in batches:
                texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
                clean = np.ones(len(texts), bool)
                clean[[hit[0] for hit in hits_of(texts, index, length, similarity)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def _shards(items: DataFrame, item_col: str, item_text_col: str) -> Iterator:
    """Indexes of the items, of bounded size each, broadcast with the words of a passage."""
    items = items.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text")).where(
        "text is not null"
    )
    words = saved(items.distinct().withColumn("words", _words(F.col("text"))).where("size(words) > 0"))
    stats = words.agg(
        F.count("*").alias("n"),
        F.avg(F.size("words")).alias("mean"),
        F.max(F.size("words")).alias("longest"),
        F.sum(F.octet_length("text")).alias("bytes"),
    ).first()
    if not stats["n"]:
        return
    length = max(2 * stats["longest"], 64)
    shards = -(-stats["bytes"] // SHARD_BYTES)
    key = F.xxhash64("id", "text")
    names = words.select(key.alias("key"), "id", "text", F.pmod(key, F.lit(shards)).alias("shard"))
    counted = (
        words.select(
            key.alias("key"), F.pmod(key, F.lit(shards)).alias("shard"), F.size("words").alias("size"),
            F.explode("words").alias("term"),
        )
        .groupBy("key", "shard", "term", "size")
        .agg(F.count("*").alias("tf"))
        .withColumn("df", F.count("*").over(W.partitionBy("term")))
    )
    idf = F.log(1 + (stats["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = K1 * (1 - B + B * F.col("size") / stats["mean"])
    impact = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    postings = saved(counted.select("shard", F.col("key").alias("id"), "term", impact.alias("impact")))
    for shard in range(shards):
        known = names.where(F.col("shard") == shard).orderBy("key", "id").toArrow()
        own = postings.where(F.col("shard") == shard).select("id", "term", "impact").toArrow()
        index = Index(known["key"].to_pylist(), known["text"].to_pylist(), own)
        # As bytes with the class, which the workers need not have installed.
        yield items.sparkSession.sparkContext.broadcast(
            cloudpickle.dumps((index, length, known["id"].combine_chunks()))
        )


def hits_of(texts: list[bytes], index: Index, length: int, similarity: float) -> list[tuple]:
    """``text, item, word, score, question overlap, answer overlap`` of verified items."""
    found, slab, size, begin = [], [], 0, 0
    for number, text in enumerate(texts):
        slab.append(text)
        size += len(text)
        if size >= SLAB_BYTES or number == len(texts) - 1:
            hits = _search_slab(slab, index, length, similarity)
            found += [(begin + t, *rest) for t, *rest in hits]
            begin, slab, size = number + 1, [], 0
    return found


def _search_slab(texts: list[bytes], index: Index, length: int, similarity: float) -> list[tuple]:
    step = length // 2
    if not len(index.terms):
        return []
    terms = terms_of(texts)
    place = np.minimum(np.searchsorted(index.terms, terms.hashes), len(index.terms) - 1)
    known = index.terms[place] == terms.hashes
    # Passages by text: one more than there are whole steps beyond the first.
    n_words = terms.last - terms.first
    n = np.where(n_words > 0, 1 + np.maximum(0, -(-(n_words - length) // step)), 0)
    first = np.cumsum(n) - n
    word = np.flatnonzero(known)
    text = np.searchsorted(terms.last, word, side="right")
    inner = (word - terms.first[text]) // step
    late = np.minimum(inner, n[text] - 1)
    early = np.maximum(inner - 1, 0)
    passage = np.concatenate([first[text] + late, first[text] + early])
    term = np.concatenate([place[word], place[word]])
    pair = np.unique(passage * len(index.terms) + term)
    passage, term = pair // len(index.terms), pair % len(index.terms)
    possible = np.flatnonzero(index.may_retrieve(passage, term, int(n.sum())))
    found = []
    lows, highs = np.searchsorted(passage, possible), np.searchsorted(passage, possible + 1)
    texts_of = np.searchsorted(first + n, possible, side="right")
    for p, low, high, t in zip(possible.tolist(), lows, highs, texts_of.tolist(), strict=True):
        hits = index.retrieve(term[low:high].tolist())
        if not hits:
            continue
        start = int(terms.first[t] + (p - first[t]) * step)
        own = terms.hashes[start : min(start + length, int(terms.last[t]))]
        own_shingles: dict[int, set] = {}
        own_words = set(own.tolist())
        for item, score in hits:
            question, answer, marked = index.parts[item]
            size = index.sizes[item]
            if size not in own_shingles:
                own_shingles[size] = set(mix(Hashes(own, BASE).windows(size)).tolist())
            q = len(question & own_shingles[size]) / len(question) if question else 1.0
            a = len(answer & own_words) / len(answer) if answer else 1.0
            if q >= similarity and (a >= similarity or not marked):
                found.append((t, item, start - int(terms.first[t]), score, q, a))
    best: dict[tuple[int, int], tuple] = {}
    for row in found:
        if row[:2] not in best or (row[4], -row[2]) > (best[row[:2]][4], -best[row[:2]][2]):
            best[row[:2]] = row
    return list(best.values())

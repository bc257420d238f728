"""Repeated byte strings, found by sorting suffixes that are compared by hashes."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from passages.llm.exchange import (
    ANSWER_SCHEMA,
    ANSWERS,
    EXACT,
    block_bits,
    by_kind,
    distinct_pairs,
    exact_pieces,
    exact_repeated,
    merge_exact,
    packed,
    ranges,
    table,
    unpacked,
)
from passages.llm.packed import (
    BASE,
    OTHER_BASE,
    Flat,
    Hashes,
    first_of_runs,
    flat,
    mix,
    values_of,
    within,
)
from passages.llm.shared import saved, text_groups

# Bytes of an anchor's own string.
ANCHOR_BYTES = 40
# Windows that are looked at together when anchors are chosen, in bits; fits a cache.
CHUNK_BITS = 16
# Different contexts of one anchor string up to which they are sorted together. More of
# them are counted window by window, spread over tasks by the windows' hashes.
MAX_SORTED = 4096
# Bytes of contexts that one task sorts.
SORT_BYTES = 6 << 20

# Answers to a context: only once, repeated, to be sorted, repeated and to be sorted
# with others, to be counted by windows, repeated and to be counted with others.
ONCE, REPEATED, SORT, REPEATED_SORT, COUNT, REPEATED_COUNT = range(6)
CONTEXTS, SORTED = 1, 3
SENT = "kind int, block long, g int, payload binary, extra binary, h long, c long, start int, n int"
SENT_SCHEMA = pa.schema(
    [
        ("kind", pa.int32()),
        ("block", pa.int64()),
        ("g", pa.int32()),
        ("payload", pa.binary()),
        ("extra", pa.binary()),
        ("h", pa.int64()),
        ("c", pa.int64()),
        ("start", pa.int32()),
        ("n", pa.int32()),
    ]
)


@dataclass
class Anchors:
    """Anchors of a group of texts: each window belongs to one, each has a run of windows.

    ``low`` and ``high`` are its first and last window, ``at`` its place, ``h`` the hash
    of its own string, ``c`` the hash of its context, the bytes of all its windows.
    """

    text: Flat
    low: np.ndarray
    high: np.ndarray
    at: np.ndarray
    h: np.ndarray
    c: np.ndarray


def sliding_first_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from blockwise minima from both sides."""
    n = len(keys) - width + 1
    rows = -(-len(keys) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    padded = padded.reshape(rows, width)
    onward = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], onward[width - 1 : width - 1 + n])


def anchors_of(texts: list[bytes], length: int, anchor: int) -> Anchors:
    """Each window belongs to its leftmost substring of least hash.

    Equal windows have their anchor at the same distance, so a window can only repeat
    where the string at its anchor repeats.
    """
    text = flat(texts)
    width = length - anchor + 1
    long = text.ends - text.starts >= length
    n = len(text.data)
    valid = within(text.starts[long], text.ends[long] - length + 1, n)
    starts = np.flatnonzero(valid)
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return Anchors(text, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64))
    own = mix(Hashes(values_of(BASE)[text.data], BASE).windows(anchor))
    place_mask = np.uint64((1 << (CHUNK_BITS + 1)) - 1)
    chosen = np.empty(n - length + 1, np.int64)
    for begin in range(0, len(chosen), 1 << CHUNK_BITS):
        end = min(begin + (1 << CHUNK_BITS), len(chosen))
        keys = own[begin : end + width - 1]
        keys = (keys & ~place_mask) | np.arange(len(keys), dtype=np.uint64)
        least = sliding_first_minimum(keys, width)
        chosen[begin:end] = begin + (least & place_mask).astype(np.int64)
    at = chosen[starts]
    new = np.flatnonzero(first_of_runs(at, starts - np.arange(len(starts))))
    low, high, at = starts[new], starts[np.append(new[1:], len(starts)) - 1], at[new]
    contexts = Hashes(values_of(OTHER_BASE)[text.data], OTHER_BASE).of(low, high + length)
    shape = ((at - low) << 20 | (high - low)).astype(np.uint64)
    # Mixed again: the least hashes of windows are no even spread over the ranges.
    return Anchors(text, low, high, at, mix(own[at]), mix(contexts ^ mix(shape)))


def merge_contexts(pieces: pa.Table) -> pa.Table:
    """Codes for the contexts of one range of anchor hashes; see the list of codes."""
    hs, cs, counts, sizes = [], [], [], []
    for payload, extra in zip(pieces["payload"].to_pylist(), pieces["extra"].to_pylist(), strict=True):
        both = np.frombuffer(payload, np.uint64)
        n = len(both) // 2
        hs.append(both[:n])
        cs.append(both[n:])
        counts.append(1 + np.unpackbits(np.frombuffer(extra, np.uint8), count=n).astype(np.int64))
        sizes.append(n)
    h, _, _, place = distinct_pairs(np.concatenate(hs), np.concatenate(cs))
    total = np.bincount(place, np.concatenate(counts))
    group = np.cumsum(first_of_runs(h)) - 1
    different = np.bincount(group)[group]
    mixed, hot = different > 1, different > MAX_SORTED
    codes = np.select(
        [~mixed & (total > 1), ~mixed, total < 2],
        [REPEATED, ONCE, np.where(hot, COUNT, SORT)],
        np.where(hot, REPEATED_COUNT, REPEATED_SORT),
    ).astype(np.uint8)
    sent = codes[place]
    # Of a repeated context, the first group to have sent it speaks for all.
    speaks = np.zeros(len(sent), bool)
    speaks[np.unique(place, return_index=True)[1]] = True
    sent[(sent >= REPEATED_SORT) & (sent != COUNT) & ~speaks] = REPEATED
    rows, start = [], 0
    for g, block, n in zip(pieces["g"].to_pylist(), pieces["block"].to_pylist(), sizes, strict=True):
        own = sent[start : start + n]
        start += n
        if own.any():
            rows.append((g, CONTEXTS, block, packed(own)))
    return table(rows, ANSWER_SCHEMA)


class Suffixes:
    """Strings that begin at given places of one array, compared by hashes.

    ``ends`` bounds each string. The longest common beginning of two is found by binary
    search over hashes of prefixes.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.ends = data, starts, ends
        self.hashes = Hashes(values_of(BASE)[data], BASE)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common beginnings of strings ``a`` and ``b``."""
        sa, sb = self.starts[a], self.starts[b]
        low = np.zeros(len(a), np.int64)
        high = np.minimum(self.ends[a] - sa, self.ends[b] - sb)
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self.hashes.of(sa, sa + middle) == self.hashes.of(sb, sb + middle)
            low = np.where(same, middle, low)
            high = np.where(same, high, middle - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether string ``a`` comes before ``b`` or is equal to it."""
        common = self.common(a, b)
        pa_, pb = self.starts[a] + common, self.starts[b] + common
        ended_a, ended_b = pa_ >= self.ends[a], pb >= self.ends[b]
        last = len(self.data) - 1
        smaller = self.data[np.minimum(pa_, last)] < self.data[np.minimum(pb, last)]
        return ended_a | (~ended_b & smaller)

    def sorted_within(self, group: np.ndarray) -> np.ndarray:
        """Strings in order within each group; ``group`` is sorted.

        Mergesort from runs of one up. The runs of all groups are merged together: where
        an element of the right run goes is found by binary search in the left run.
        """
        n = len(group)
        order = np.arange(n)
        begin = np.flatnonzero(first_of_runs(group))
        size = np.diff(np.append(begin, n))
        inside = np.arange(n) - np.repeat(begin, size)
        of_group = np.repeat(size, size)
        first = np.repeat(begin, size)
        width = 1
        while (size > width).any():
            pair = inside // (2 * width)
            left_start = first + pair * 2 * width
            right_start = left_start + width
            group_end = first + of_group
            is_right = np.arange(n) >= right_start
            rights = np.flatnonzero(is_right)
            low, high = left_start[rights].copy(), right_start[rights].copy()
            base = left_start[rights]
            while True:
                still = np.flatnonzero(low < high)
                if not len(still):
                    break
                middle = (low[still] + high[still]) >> 1
                goes_after = self.before(order[middle], order[rights[still]])
                low[still] = np.where(goes_after, middle + 1, low[still])
                high[still] = np.where(goes_after, high[still], middle)
            target = base + (low - base) + (rights - right_start[rights])
            taken = np.zeros(n, bool)
            taken[target] = True
            merged = np.empty(n, np.int64)
            merged[target] = order[rights]
            merged[~taken] = order[~is_right]
            order = merged
            width *= 2
        return order


def rows_of(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """``width`` bytes from each place on, beyond the end the last byte again."""
    return data[np.minimum(starts[:, None] + np.arange(width), len(data) - 1)]


def agreed(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many bytes agree from places ``a`` and ``b`` on, by comparing bytes; at most ``most``.

    This confirms what the hashes found, whatever collided.
    """
    result = np.zeros(len(a), np.int64)
    for begin in range(0, len(a), 1 << 14):
        part = slice(begin, begin + (1 << 14))
        width = int(most[part].max(initial=0))
        offsets = step * np.arange(width)
        last = len(data) - 1
        same = data[np.clip(a[part, None] + offsets, 0, last)] == data[np.clip(b[part, None] + offsets, 0, last)]
        same &= np.arange(width) < most[part, None]
        result[part] = np.where(same.all(axis=1), width, np.argmin(same, axis=1)) if width else 0
    return np.minimum(result, most)


def repeated_windows(rows: pa.Table, length: int) -> pa.Table:
    """Which windows of the contexts of some anchor strings occur in another context.

    The contexts, all different, are sorted twice: by what follows the anchor and,
    backwards, by what precedes it. Neighbours have the longest common extensions on
    that side; a neighbour gives the windows that both its extensions cover. No window
    outside the two longest extensions repeats. Windows between these bounds are
    compared with those at the same distance in contexts of the same anchor string.
    """
    h = rows["h"].to_numpy().view(np.uint64)
    order = np.argsort(h, kind="stable")
    rows, h = rows.take(pa.array(order)), h[order]
    text = flat(rows["payload"].to_pylist())
    data = text.data
    anchor = text.starts + rows["start"].to_numpy()
    n = rows["n"].to_numpy().astype(np.int64)
    back, on = anchor - text.starts, text.ends - anchor
    forward = Suffixes(data, anchor, text.ends)
    mirrored = len(data) - anchor
    backward = Suffixes(data[::-1].copy(), mirrored, mirrored + back)

    def neighbours(order: np.ndarray):
        same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
        return order[same], order[same + 1]

    width = int(n.max())
    distance = np.arange(width)  # of a window's start from its context's
    found = np.zeros((len(h), width), bool)
    longest_on, longest_back = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
    for side, best in ((forward, longest_on), (backward, longest_back)):
        a, b = neighbours(side.sorted_within(h))
        r = agreed(data, anchor[a], anchor[b], np.minimum(forward.common(a, b), length), 1)
        l = agreed(data, anchor[a] - 1, anchor[b] - 1, backward.common(a, b), -1)
        for x in (a, b):
            reach = r if side is forward else l
            np.maximum.at(best, x, reach)
            first, last = back[x] - l, back[x] + r - length
            np.logical_or.at(found, x, (distance >= first[:, None]) & (distance <= last[:, None]))
    own = distance < n[:, None]
    found &= own
    first, last = back - longest_back, back + longest_on - length
    open_ = own & ~found & (distance >= first[:, None]) & (distance <= last[:, None])
    if open_.any():
        # By distance from the anchor, which equal windows share.
        row, at = np.nonzero(own & np.isin(h, h[open_.any(axis=1)])[:, None])
        away = (back[row] - at).astype(np.uint64)
        key = mix(h[row] ^ mix(away))
        wanted = np.unique(key[open_[row, at]])
        some = np.isin(key, wanted)
        row, at, key = row[some], at[some], key[some]
        start = text.starts[row] + at
        window = mix(forward.hashes.of(start, start + length))
        place = np.lexsort((window, key))
        row, at, key, window, start = row[place], at[place], key[place], window[place], start[place]
        same = np.flatnonzero((key[1:] == key[:-1]) & (window[1:] == window[:-1]))
        full = np.full(len(same), length)
        same = same[agreed(data, start[same], start[same + 1], full, 1) == length]
        for x in (same, same + 1):
            found[row[x], at[x]] = True
    asked = np.flatnonzero((rows["g"].to_numpy() >= 0) & found.any(axis=1))
    answers = [
        (int(rows["g"][int(i)].as_py()), SORTED, 0, np.array([h[i], rows["c"][int(i)].as_py() & (2**64 - 1)], np.uint64).tobytes() + np.packbits(found[i, : n[i]]).tobytes())
        for i in asked
    ]
    return table(answers, ANSWER_SCHEMA)


def without_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 200,
    anchor: int = ANCHOR_BYTES,
) -> DataFrame:
    """``id, kept, n_bytes, n_removed, n_spans`` of every row of ``docs``.

    Texts are UTF-8 bytes. A byte goes when a string of ``length`` bytes of one text that
    covers it starts at least twice among all texts. ``kept`` is what stays, as bytes;
    ``n_spans`` counts the maximal removed runs.

    Not every suffix is sorted. Each window belongs to its anchor, the place in it where
    the next ``anchor`` bytes hash lowest, and so do the windows equal to it, at the same
    distance. So only anchors are exchanged: first the hashes of their own strings and of
    their contexts (the bytes of all their windows), by ranges of hashes, which tells
    contexts that repeat as a whole from those whose anchor string repeats with another
    context. Only of these are the bytes sent, once per different context, and sorted
    as suffixes (see ``repeated_windows``). An anchor string with very many different
    contexts is not sorted in one task: its windows are counted by 128-bit hashes, spread
    over tasks. Texts move once, into buckets that three passes read.

    Null and empty texts have no bytes. Texts shorter than ``length`` stay. A row repeated
    is a repeat of all its windows. An empty table gives an empty result; other columns
    are left out.
    """
    if not 1 <= anchor <= length:
        raise ValueError("anchor must be between 1 and length")
    groups = text_groups(docs, id_col, text_col)
    blocks = block_bits(2 * groups.text_bytes / (length - anchor + 2))

    def group_of(rows: pa.Table) -> tuple[int, Anchors]:
        found = anchors_of(rows["text"].cast(pa.binary()).to_pylist(), length, anchor)
        return rows["g"][0].as_py(), found

    def send(rows: pa.Table) -> pa.Table:
        g, found = group_of(rows)
        pieces = exact_pieces(g, found.h, found.c, blocks) if len(found.h) else []
        return table([(CONTEXTS, *p[1:], None, None, None, None) for p in pieces], SENT_SCHEMA)

    def merge(pieces: pa.Table) -> pa.Table:
        return merge_contexts(pieces) if pieces["kind"][0].as_py() == CONTEXTS else merge_exact(pieces)

    def coded(found: Anchors, answers: dict):
        """The code of each anchor, and where it is among the distinct ones."""
        h, _, _, place = distinct_pairs(found.h, found.c)
        codes = np.zeros(len(h), np.uint8)
        own = answers.get(CONTEXTS, {})
        for block, a, b in ranges(h, blocks):
            if block in own:
                codes[a:b] = unpacked(own[block], b - a, np.uint8)
        return codes[place], place

    def counted_windows(found: Anchors, codes: np.ndarray, place: np.ndarray):
        """Windows to be counted, one anchor speaking for those with its context."""
        first = np.zeros(len(codes), bool)
        first[np.unique(place, return_index=True)[1]] = True
        asked = np.flatnonzero(((codes == COUNT) | (codes == REPEATED_COUNT)) & first)
        low, n = found.low[asked], found.high[asked] - found.low[asked] + 1
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        keys = [
            mix(Hashes(values_of(base)[found.text.data], base).of(at, at + length))
            for base in (BASE, OTHER_BASE)
        ]
        return at, keys[0], keys[1]

    def ask(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows or not answers.num_rows:
            return SENT_SCHEMA.empty_table()
        g, found = group_of(rows)
        codes, place = coded(found, by_kind(answers))
        sent = []
        asked = np.flatnonzero((codes == SORT) | (codes == REPEATED_SORT))
        asked = asked[np.unique(place[asked], return_index=True)[1]]
        raw = found.text.data
        for i in asked.tolist():
            low, high = int(found.low[i]), int(found.high[i])
            sent.append(
                (
                    SORTED,
                    0,
                    g if codes[i] == SORT else -1,
                    raw[low : high + length].tobytes(),
                    None,
                    int(found.h[i : i + 1].view(np.int64)[0]),
                    int(found.c[i : i + 1].view(np.int64)[0]),
                    int(found.at[i]) - low,
                    high - low + 1,
                )
            )
        at, one, two = counted_windows(found, codes, place)
        if len(at):
            sent += [(*p, None, None, None, None) for p in exact_pieces(g, one, two, blocks)]
        return table(sent, SENT_SCHEMA)

    def remove(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return result.empty_table()
        _, found = group_of(rows)
        raw = found.text.data
        gone = np.zeros(len(raw), bool)
        if answers.num_rows and len(found.h):
            is_sorted = np.asarray(answers["kind"].to_numpy() == SORTED)
            known = by_kind(answers.filter(pa.array(~is_sorted)))
            codes, place = coded(found, known)
            whole = (codes == REPEATED) | (codes == REPEATED_SORT) | (codes == REPEATED_COUNT)
            windows = [(found.low[whole], found.high[whole] + length)]
            at, one, two = counted_windows(found, codes, place)
            at = at[exact_repeated(one, two, known, blocks)]
            windows.append((at, at + length))
            masks = {m[:16]: m[16:] for m in answers.filter(pa.array(is_sorted))["payload"].to_pylist()}
            starts = []
            for i in np.flatnonzero(codes == SORT).tolist() if masks else []:
                mask = masks.get(np.array([found.h[i], found.c[i]], np.uint64).tobytes())
                if mask:
                    bits = np.unpackbits(np.frombuffer(mask, np.uint8), count=int(found.high[i] - found.low[i]) + 1)
                    starts.append(found.low[i] + np.flatnonzero(bits))
            if starts:
                at = np.concatenate(starts)
                windows.append((at, at + length))
            starts, ends = (np.concatenate(x) for x in zip(*windows, strict=True))
            gone = within(starts, ends, len(raw))
        keep = ~gone
        keep[found.text.ends] = False
        kept = np.concatenate([[0], np.cumsum(keep)])
        removed = np.concatenate([[0], np.cumsum(gone)])
        runs = np.concatenate([[0], np.cumsum(gone & ~np.concatenate([[False], gone[:-1]]))])
        start, end = found.text.starts, found.text.ends
        offsets = np.append(kept[start], kept[-1]).astype(np.int32)
        return pa.table(
            [
                rows["id"],
                pa.Array.from_buffers(
                    pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[keep].tobytes())]
                ),
                pa.array(end - start, pa.int64()),
                pa.array(removed[end] - removed[start], pa.int64()),
                pa.array(runs[end] - runs[start], pa.int64()),
            ],
            names=result.names,
        )

    by_group = groups.rows.groupBy("g")
    codes = saved(by_group.applyInArrow(send, SENT).groupBy("kind", "block").applyInArrow(merge, ANSWERS))
    sent = saved(by_group.cogroup(codes.groupBy("g")).applyInArrow(ask, SENT))
    to_sort = sent.where(F.col("kind") == SORTED)
    size = to_sort.agg(F.sum(F.length("payload"))).first()[0] or 0
    part = F.pmod(F.xxhash64("h"), F.lit(max(1, -(-size // SORT_BYTES)))).alias("part")
    in_sorted = (
        to_sort.groupBy(part).applyInArrow(lambda rows: repeated_windows(rows, length), ANSWERS)
    )
    counted = sent.where(F.col("kind") == EXACT).groupBy("kind", "block").applyInArrow(merge, ANSWERS)
    answers = codes.union(saved(in_sorted.union(counted)))
    id_type = groups.rows.schema["id"].dataType
    result = pa.schema(
        [
            ("id", to_arrow_type(id_type)),
            ("kept", pa.binary()),
            ("n_bytes", pa.int64()),
            ("n_removed", pa.int64()),
            ("n_spans", pa.int64()),
        ]
    )
    return by_group.cogroup(answers.groupBy("g")).applyInArrow(
        remove,
        f"id {id_type.simpleString()}, kept binary, n_bytes long, n_removed long, n_spans long",
    )

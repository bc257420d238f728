"""Token ids of whole texts with a published tokenizer, each different word encoded once."""

import os
import sys
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Text that is cut into words at once. A longer text is cut by itself.
SLICE_BYTES = 8 << 20
# Words whose ids a worker keeps, and characters of the longest of them.
KEPT_WORDS = 600_000
KEPT_CHARS = 40
# What shows that a blank may stand inside a token: white space on both of its sides.
# White_Space of Unicode, fixed values.
_SPACE = r"\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_INNER_BLANK = f"[{_SPACE}] ([{_SPACE}]|$)"
# A word and a mark that ends it are never one token.
_WORD_END = r"([\p{L}\p{N}])([.,;:!?)])"
_MARK = "\x00"


def _known_words(path: str) -> dict[str, bytes]:
    """The words this worker process has encoded, whatever task it ran them for.

    Functions travel with each task, and their globals with them, so a module of the
    process itself holds what tasks share.
    """
    name = "_passages_known_words"
    module = sys.modules.setdefault(name, ModuleType(name))
    return module.__dict__.setdefault(path, {})


class Encoder:
    """``ids(texts)``: ids of every text, as a ``tokenizers`` file gives them.

    The file must hold a byte-level BPE that splits texts into words with a blank only in
    front, as published byte-level vocabularies do: then no token crosses a blank that has
    no white space on one of its sides, nor the end of a word, and texts can be cut there.
    Words are told apart in Arrow; only those that are new to this worker reach the
    tokenizer. Strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known = _known_words(path)

    def _encode(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(one.ids, np.uint32).tobytes() for one in found]

    def _of_words(self, words: list[str]) -> list[bytes]:
        ids = list(map(self.known.get, words))
        missing = [i for i, found in enumerate(ids) if found is None]
        for i, found in zip(missing, self._encode([words[i] for i in missing]), strict=True):
            ids[i] = found
            if len(self.known) < KEPT_WORDS and len(words[i]) <= KEPT_CHARS:
                self.known[words[i]] = found
        return ids

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and the end of each, for texts cut at their blanks."""
        marked = pc.replace_substring(texts, " ", _MARK + " ")
        marked = pc.replace_substring_regex(marked, _WORD_END, f"\\1{_MARK}\\2")
        cut = pc.split_pattern(marked, _MARK)
        coded = cut.flatten().dictionary_encode()
        ids = self._of_words(coded.dictionary.to_pylist())
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        values = pa.array(np.frombuffer(b"".join(ids), np.uint32))
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int64())
        words = pa.LargeListArray.from_arrays(offsets, values)
        indices = coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(counts[indices])])[cut.offsets.to_numpy()[1:]]
        return words.take(coded.indices).flatten().to_numpy(), ends

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        whole = pc.or_(
            pc.match_substring_regex(texts, _INNER_BLANK), pc.match_substring(texts, _MARK)
        )
        ids, ends = self._plain(texts.filter(pc.invert(whole)))
        begins = iter(np.concatenate([[0], ends[:-1]]))
        ends = iter(ends)
        for is_whole, text in zip(whole.to_pylist(), texts, strict=True):
            if is_whole:
                yield np.frombuffer(self._encode([text.as_py()])[0], np.uint32)
            else:
                yield ids[next(begins) : next(ends)]

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order. A null text has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy())
        start = 0
        while start < len(texts):
            before = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, before + SLICE_BYTES, "right")))
            yield from self._slice(texts.slice(start, stop - start))
            start = stop

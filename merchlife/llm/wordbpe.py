"""A word-level BPE tokenizer file over Arrow columns: equal to the library's own encoding, with each word encoded once.

Plain rows (ASCII and Latin-1 letters, no apostrophe, no special token) are cut into words on their
bytes, as the file's normalizer and pattern do; unseen words go to the library. All other rows go
to the library whole.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

from merchlife.llm.bytescan import texts
from merchlife.llm.unitmemo import UnitMemo

_SPACE, _LETTER, _DIGIT, _OTHER, _BAD = range(5)
_CLASS = np.full(256, _BAD, np.uint8)
_CLASS[33:127] = _OTHER
_CLASS[[9, 10, 13, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[97:123] = _CLASS[65:91] = _LETTER
_CLASS[39] = _BAD  # contractions are for the library
_TAIL = {0xC2: np.full(256, _BAD, np.uint8), 0xC3: np.full(256, _BAD, np.uint8)}
_TAIL[0xC2][0xA1:0xC0] = _OTHER
_TAIL[0xC2][[0xAA, 0xB5, 0xBA]] = _LETTER
_TAIL[0xC2][[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _DIGIT
_TAIL[0xC3][0x80:0xC0] = _LETTER
_TAIL[0xC3][[0x97, 0xB7]] = _OTHER


class WordCoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.whole = Tokenizer.from_file(path)
        self.size = self.whole.get_vocab_size(with_added_tokens=True)
        self.single = Tokenizer(self.whole.model)
        self.single.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])
        self.ends = np.zeros(self.size, bool)
        for piece, i in self.whole.get_vocab(with_added_tokens=False).items():
            self.ends[i] = piece.endswith("</w>")
        self.memo = UnitMemo(lambda units, _: self._words(units))

    def _words(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.single.encode_batch_fast([b" ".join(units).decode("utf-8")], add_special_tokens=False)[0].ids, np.int32)
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(units):
            raise ValueError("words and their last pieces differ in number")
        return ids, np.diff(last, prepend=-1)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has; null is empty."""
        data, offsets = texts(column)
        n = len(column)
        if not len(data):
            return np.empty(0, np.int32), np.zeros(n, np.int64)
        kind = _CLASS[data]
        follows = np.append(data[1:], 0)
        for lead, tail in _TAIL.items():
            at = np.flatnonzero(data == lead)
            at = at[at + 1 < len(data)]
            kind[at] = kind[at + 1] = tail[follows[at]]
        special = (data == 60) & (follows == 124)
        wrong = np.flatnonzero((kind == _BAD) | special)
        other = np.unique(np.searchsorted(offsets, wrong, "right") - 1)
        low = data.copy()
        low[(data >= 65) & (data <= 90)] += 32
        upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        low[upper] += 32
        plain = np.ones(n, bool)
        plain[other] = False
        kind[np.repeat(~plain, np.diff(offsets))] = _SPACE
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = (kind[1:] != kind[:-1]) | ((kind[1:] == _DIGIT) & ((data[1:] & 0xC0) != 0x80))
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        places = np.flatnonzero(cut)
        word = kind[places[:-1]] != _SPACE
        start, end = places[:-1][word], places[1:][word]
        ids, counts = self.memo.ids(low, start, end)
        rows = np.searchsorted(offsets, start, "right") - 1
        total = np.bincount(rows, weights=counts, minlength=n).astype(np.int64)
        if not len(other):
            return ids, total
        coded = self.whole.encode_batch_fast([column[int(i)].as_py() for i in other], add_special_tokens=False)
        parts, before = [], np.concatenate([[0], np.cumsum(total)])
        done = 0
        for i, found in zip(other.tolist(), coded, strict=True):
            parts += [ids[before[done] : before[i]], np.array(found.ids, np.int32)]
            total[i], done = len(found.ids), i
        parts.append(ids[before[done] :])
        return np.concatenate(parts), total


@lru_cache(maxsize=2)
def coder(path: str) -> WordCoder:
    """Once for each worker. A coder for each task would be loaded each time, and its memory is not all given back."""
    return WordCoder(path)

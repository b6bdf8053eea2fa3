"""Words of many texts at once, on the UTF-8 bytes of a block."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Byte classes: True for bytes inside words.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


@dataclass
class Words:
    """The words of a block: lower-cased (A-Z) bytes in which one space follows each word, each word's place, and each text's range of words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # n_texts + 1 indices into start

    def __len__(self) -> int:
        return len(self.start)


def words_of(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Cut a block into words; every byte outside words becomes a space and runs of them one."""
    n = len(raw)
    low = _LOWER[raw]
    word = inside[low]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins, ends = word.copy(), word.copy()
    if n:
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        begins[edges] = word[edges]
        ends[edges - 1] = word[edges - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(starts, offsets)
    size = stops - starts
    start = np.concatenate([[0], np.cumsum(size + 1)])[:-1].astype(np.int64) if len(size) else np.zeros(0, np.int64)
    end = start + size
    data = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, np.uint8)
    if len(end):
        body = np.ones(len(data), bool)
        body[end] = False
        data[body] = low[word]
    return Words(data, start, end, first)

"""How many ids the tokenizer gives each text, without making the ids.

Texts are split by array operations on their code points, in the words that the tokenizer's pattern gives. The distinct words of a piece of
work are looked up among the vocabulary and the words met before; all others are merged at once, as rows of a matrix.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex

#: Bytes of text in one piece of work, and words that a task remembers beside the vocabulary's.
WORK, REMEMBERED = 1 << 21, 200_000
#: Words up to so many bytes are merged together, as rows of a matrix as wide as the longest of them; longer ones one by one.
WIDTHS = (4, 6, 8, 12, 16, 24, 32, 48, 64)
#: Rows of one matrix.
ROWS = 1 << 16

SPACE, LETTER, NUMBER, OTHER = range(4)
_NONE = np.iinfo(np.int32).max


def kinds() -> np.ndarray:
    """By code point, what the tokenizer's pattern takes it for."""
    points = np.r_[0:0xD800, 0xE000:0x110000].astype("<u4")
    every = points.tobytes().decode("utf-32-le")
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[points[m.start() : m.end()]] = kind
    return out


def word_starts(points: np.ndarray, first: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the words of texts begin that stand one after another: those that the tokenizer's pattern finds in each text.

    first: the places of the texts' first code points. kind: that of each code point. Nothing is between two words.
    """
    begins = np.zeros(len(points) + 1, bool)
    begins[first] = begins[-1] = True
    run = begins.copy()
    run[1:-1] |= kind[1:] != kind[:-1]
    start = run[:-1].copy()
    # the last of some white space belongs to what follows it in the text, as its first character if it is a blank
    last = np.flatnonzero((kind == SPACE) & run[1:] & ~begins[1:])
    start[last] = True
    start[last[points[last] == ord(" ")] + 1] = False
    # contractions: a mark that begins a word and stands alone, and certain letters
    mark = np.flatnonzero((points == ord("'")) & start & run[1:] & ~begins[1:])
    after = np.r_[points, 0, 0][mark[:, None] + [1, 2]]
    one = np.isin(after[:, 0], [ord(c) for c in "stmd"])
    two = np.isin(after[:, 0] << 8 | after[:, 1], [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")])
    two &= ~begins[np.minimum(mark + 2, len(points))] & (after[:, 1] < 128)
    ends = np.r_[mark[one] + 2, mark[two] + 3]
    start[np.r_[mark[one], mark[two]] + 1] = False
    start[ends[ends < len(points)]] = True
    return np.flatnonzero(start)


@dataclass
class Pairs:
    """Which neighbours are merged: key is left * 2**32 + right, ascending; id that of both together, which is its rank. of_byte: ids by byte."""

    key: np.ndarray
    id: np.ndarray
    of_byte: np.ndarray
    of_bytes: np.ndarray

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> Pairs:
        keys, ids = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    keys.append(a << 32 | b)
                    ids.append(rank)
        order = np.argsort(key := np.array(keys, np.int64))
        of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        of_bytes = np.array([ranks.get(bytes([a, b]), _NONE) for a in range(256) for b in range(256)], np.int32)
        return cls(key[order], np.array(ids, np.int32)[order], of_byte, of_bytes)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of neighbours, the largest integer for those that aren't merged."""
        if not len(self.key):
            return np.full(len(left), _NONE, np.int32)
        asked = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.key, asked), len(self.key) - 1)
        return np.where(self.key[at] == asked, self.id[at], _NONE).astype(np.int32)

    def sizes(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The number of ids of words (spans of data): in each, the neighbours with the lowest rank are merged, the leftmost first, until none can be.

        A round merges two neighbours in every row and moves what follows them one place to the left.
        """
        out = length.copy()
        width = int(length.max(initial=0))
        if width < 2:
            return out
        cells = np.arange(width)
        inside = cells < length[:, None]
        byte = data[np.minimum(start[:, None] + cells, len(data) - 1)]
        ids = np.where(inside, self.of_byte[byte], -1)
        rank = np.where(inside[:, 1:], self.of_bytes[byte[:, :-1].astype(np.int32) << 8 | byte[:, 1:]], _NONE)
        row = np.arange(len(start))
        while True:
            at = rank.argmin(axis=1)
            low = rank[np.arange(len(row)), at]
            alive = low != _NONE
            if not alive.all():
                row, ids, rank, at, low = row[alive], ids[alive], rank[alive], at[alive], low[alive]
            if not len(row):
                return out
            out[row] -= 1
            n, width = ids.shape
            if width == 2:
                return out
            here = np.arange(n)
            ids[here, at] = low
            cells = np.arange(width - 1)
            moved = cells + (cells > at[:, None])
            ids = np.take_along_axis(ids, moved, 1)
            rank = np.take_along_axis(rank, moved[:, :-1], 1)
            for k in (at - 1, at):  # the pairs that end and begin with what was merged
                r = np.flatnonzero((k >= 0) & (k < width - 2))
                left, right = ids[r, k[r]], ids[r, k[r] + 1]
                rank[r, k[r]] = np.where(right >= 0, self.look_up(left, right), _NONE)


class Sizes:
    """Counts the ids of batches of texts."""

    def __init__(self, ranks: dict[bytes, int], pairs: Pairs, kind: np.ndarray, merge):
        self.ranks, self.pairs, self.kind, self.merge = ranks, pairs, kind, merge
        self.known = dict.fromkeys(ranks, 1)

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of ids by text. Null and empty texts have none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offsets, data = texts.buffers()
        upto = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        out, a = [np.zeros(0, np.int64)], 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + WORK, "right")) - 1)
            out.append(self._part(data.slice(int(upto[a]), int(upto[b] - upto[a])), upto[a : b + 1] - upto[a]) if upto[b] > upto[a] else np.zeros(b - a, np.int64))
            a = b
        return np.concatenate(out)

    def _part(self, data: pa.Buffer, upto: np.ndarray) -> np.ndarray:
        points = np.frombuffer(str(data, "utf-8").encode("utf-32-le"), "<u4")
        raw = np.frombuffer(data, np.uint8)
        place = None if len(points) == len(raw) else np.flatnonzero(raw & 0xC0 != 0x80)  # of each code point among the bytes
        first = upto[:-1][upto[1:] > upto[:-1]]
        start = word_starts(points, first if place is None else np.searchsorted(place, first), self.kind[points])
        start = start if place is None else place[start]
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.r_[start, len(raw)].astype(np.int64)), data]).dictionary_encode()
        total = np.r_[0, np.cumsum(self._words(words.dictionary)[words.indices.to_numpy()])]
        return np.diff(total[np.searchsorted(start, upto)])

    def _words(self, words: pa.Array) -> np.ndarray:
        """The number of ids of distinct words."""
        listed = words.to_numpy(zero_copy_only=False).tolist()
        size = np.fromiter(map(self.known.get, listed, repeat(0)), np.int64, len(listed))
        new = np.flatnonzero(size == 0)
        if not len(new):
            return size
        _, offsets, data = words.buffers()
        start = np.frombuffer(offsets, np.int64)[words.offset :]
        length, data = np.diff(start[: len(words) + 1]), np.frombuffer(data, np.uint8)
        shorter = 0
        for width in WIDTHS:
            own = new[(length[new] > shorter) & (length[new] <= width)]
            for i in range(0, len(own), ROWS):
                k = own[i : i + ROWS]
                size[k] = self.pairs.sizes(data, start[k], length[k])
            shorter = width
        for i in new[length[new] > shorter]:
            size[i] = len(self.merge(listed[i], self.ranks))
        if len(self.known) + len(new) > len(self.ranks) + REMEMBERED:
            self.known = dict.fromkeys(self.ranks, 1)
        kept = new[length[new] <= shorter]
        self.known.update(zip([listed[i] for i in kept.tolist()], size[kept].tolist()))
        return size

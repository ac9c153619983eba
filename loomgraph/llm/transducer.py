"""A minimal acyclic transducer from byte strings to lists of ids, as flat arrays that can be memory-mapped.

States with the same futures are one state, so that suffixes are shared. The outputs sit on the edges as numbers of words:
what is added up along a word's path is its place in the sorted lexicon, which is the row of its id list. Thus outputs that
differ between words don't keep their suffixes apart.
"""

from __future__ import annotations

import io

import numpy as np

_PARTS = ("edge_key", "edge_to", "edge_skip", "final", "out_start", "out_ids")


class Transducer:
    """edge_key: state * 256 + byte, ascending; edge_to, edge_skip by edge; final by state; out_ids[out_start[w] : out_start[w + 1]] by word."""

    def __init__(self, **parts: np.ndarray):
        self.__dict__.update(parts)

    @classmethod
    def compile(cls, lexicon: dict[bytes, list[int]]) -> Transducer:
        """By adding the words in order: when the next word leaves a path, the states it leaves are looked up among those known by their futures."""
        words = sorted(w for w in lexicon if w)
        known: dict[tuple, int] = {}
        edges_of: list[tuple] = []
        path: list[list] = [[False, []]]  # of the word added last: by depth, whether a word ends there, and the edges done so far
        letters: list[int] = []

        def settle(depth: int) -> None:
            while len(path) > depth + 1:
                end, edges = path.pop()
                sign = (end, tuple(edges))
                if sign not in known:
                    known[sign] = len(edges_of)
                    edges_of.append(sign)
                path[-1][1].append((letters.pop(), known[sign]))

        for w in words:
            same = 0
            while same < len(letters) and same < len(w) and letters[same] == w[same]:
                same += 1
            settle(same)
            for b in w[same:]:
                letters.append(b)
                path.append([False, []])
            path[-1][0] = True
        settle(0)
        root = len(edges_of)
        edges_of.append((path[0][0], tuple(path[0][1])))
        n_words = [0] * len(edges_of)
        keys, to, skip = [], [], []
        for state, (end, edges) in enumerate(edges_of):  # targets come before their sources
            seen = int(end)
            for b, target in edges:
                keys.append(state * 256 + b)
                to.append(target)
                skip.append(seen)
                seen += n_words[target]
            n_words[state] = seen
        lengths = np.array([len(lexicon[w]) for w in words], np.int64)
        return cls(
            edge_key=np.array(keys, np.int64), edge_to=np.array(to, np.int32), edge_skip=np.array(skip, np.int32), final=np.array([e for e, _ in edges_of], bool),
            out_start=np.r_[0, np.cumsum(lengths)].astype(np.int64), out_ids=np.array([i for w in words for i in lexicon[w]], np.int32),
        )

    @property
    def root(self) -> int:
        return len(self.final) - 1

    def look_up(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The word numbers of many byte strings (spans of data) at once, -1 for those that aren't in the lexicon."""
        out = np.full(len(start), -1, np.int64)
        if not len(self.edge_key):
            return out
        state = np.full(len(start), self.root, np.int64)
        number = np.zeros(len(start), np.int64)
        alive = np.flatnonzero(length > 0)
        depth = 0
        while len(alive):
            key = state[alive] * 256 + data[start[alive] + depth]
            at = np.minimum(np.searchsorted(self.edge_key, key), len(self.edge_key) - 1)
            hit = self.edge_key[at] == key
            alive, at = alive[hit], at[hit]
            state[alive] = self.edge_to[at]
            number[alive] += self.edge_skip[at]
            depth += 1
            ended = length[alive] == depth
            over = alive[ended]
            out[over] = np.where(self.final[state[over]], number[over], -1)
            alive = alive[~ended]
        return out

    def to_bytes(self) -> bytes:
        """The arrays one after another, each as an uncompressed .npy, at multiples of 64 bytes."""
        out = io.BytesIO()
        for name in _PARTS:
            out.write(b"\0" * (-out.tell() % 64))
            np.save(out, getattr(self, name))
        return out.getvalue()

    @classmethod
    def memory_map(cls, path: str) -> Transducer:
        """Reads the file's headers alone; the arrays are pages shared by all processes of a machine."""
        parts = {}
        with open(path, "rb") as f:
            for name in _PARTS:
                f.seek(-f.tell() % 64, 1)
                np.lib.format.read_magic(f)
                shape, _, kind = np.lib.format.read_array_header_1_0(f)
                size = int(np.prod(shape)) * kind.itemsize
                parts[name] = np.memmap(path, kind, "r", f.tell(), shape) if size else np.zeros(shape, kind)
                f.seek(size, 1)
        return cls(**parts)

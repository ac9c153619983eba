import time

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import sizes as Z
from loomgraph.llm import tokenizer as K
from loomgraph.llm.transducer import Transducer

tiktoken = pytest.importorskip("tiktoken")
RANKS = K.load_ranks()
PAIRS, KIND = Z.Pairs.of(RANKS), Z.kinds()
PLAIN = tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = ["'", "''", "s", "'s", "'re", "'ve", "'ll", "'d", "'r", "r", "e", " ", "  ", "\n", "\t ", " ", "　", "\x1c", "\x85", "​", "1", "²", "Ⅷ", "é", "é", "ไทย", "是", "😀", "-", "_", "\0", "ʼ", "’s", "ſ", "A"]


def sizes():
    return Z.Sizes(RANKS, PAIRS, KIND, K.merge)


def words(texts):
    points = np.array([ord(c) for t in texts for c in t], np.uint32)
    ends = np.cumsum([len(t) for t in texts])
    starts = Z.word_starts(points, np.array([e - len(t) for e, t in zip(ends, texts) if t], np.int64), KIND[points])
    whole = "".join(texts)
    return [whole[a:b] for a, b in zip(starts, [*starts[1:], len(whole)])]


def test_kinds_are_the_patterns_own():
    for kind, pattern in ((Z.SPACE, r"\s"), (Z.LETTER, r"\p{L}"), (Z.NUMBER, r"\p{N}")):
        of = regex.compile(pattern)
        assert all((KIND[c] == kind) == bool(of.match(chr(c))) for c in [*range(0xD800), *range(0xE000, 0x30000, 7), 0x10FFFF])


@settings(max_examples=500, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ODD), max_size=9).map("".join) | st.text(max_size=20), max_size=5))
def test_words_are_the_patterns_own(texts):
    found = regex.compile(K.PATTERN).findall
    assert words(texts) == [w for t in texts for w in found(t)]
    assert sizes().count(pa.array([*texts, None], pa.string())).tolist() == [*(len(PLAIN.encode_ordinary(t)) for t in texts), 0]


def test_texts_end_words():
    assert words(["a ", " b", "it'", "s", "'r", "e", "  ", "\n", "x  y"]) == ["a", " ", " b", "it", "'", "s", "'", "r", "e", "  ", "\n", "x", " ", " y"]


def test_merges_of_all_widths():
    rng = np.random.default_rng(5)
    listed = [b"".join(rng.choice([b"a", b"e", b"th", b"\xd0", b"\xbe", b"\xff", b"0", b" ", b"in"], n)) for n in range(1, 70) for _ in range(20)]
    length = np.array(list(map(len, listed)))
    got = PAIRS.sizes(np.frombuffer(b"".join(listed), np.uint8), np.cumsum(length) - length, length)
    assert got.tolist() == [len(K.merge(w, RANKS)) for w in listed]


def test_pieces_slices_and_forgotten_words(monkeypatch):
    monkeypatch.setattr(Z, "WORK", 50)
    monkeypatch.setattr(Z, "REMEMBERED", 20)
    texts = ["", "x" * 3000 + "é" * 500, None, "Zebqra " * 100, "ไทยไทย 是。  ", "", "it's  qwxz\n\n end ", "Zebqra", None]
    want = [len(PLAIN.encode_ordinary(t or "")) for t in texts]
    own = sizes()
    for kind in (pa.string(), pa.large_string()):
        whole = pa.array(texts, kind)
        assert own.count(whole).tolist() == want and own.count(whole.slice(3, 4)).tolist() == want[3:7]
    assert own.count(pa.array([], pa.string())).tolist() == [] and len(own.known) <= len(RANKS) + 20 + 20


def test_counting_takes_less_than_half_of_encoding():
    """p7 counted by the steps that make the ids: too slow over its own tables at size."""
    rng = np.random.default_rng(7)
    lexicon = np.array(["".join(rng.choice(list("aeioubdfgklmnprst"), rng.integers(4, 12))) for _ in range(40_000)])
    texts = [" ".join(lexicon[rng.zipf(1.2, 150) % len(lexicon)]) for _ in range(3_000)]
    vocabulary = Transducer.compile({t: [i] for t, i in RANKS.items()})
    took = []
    for own, asked in ((K.Encoder(vocabulary, RANKS), lambda e: e.encode(texts)[0]), (sizes(), lambda z: z.count(pa.array(texts)))):
        began = time.process_time()
        took.append((asked(own).tolist(), time.process_time() - began))
    assert took[0][0] == took[1][0]
    assert took[1][1] < took[0][1] / 2

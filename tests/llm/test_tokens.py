import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import tokenizer as K
from loomgraph.llm.transducer import Transducer

tiktoken = pytest.importorskip("tiktoken")
RANKS = K.load_ranks()
PLAIN = tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_transducer_finds_exactly_its_words(tmp_path):
    words = {w.encode(): [i, i + 1][: i % 3] for i, w in enumerate("a ab abc b bc xing running sing ringing é éé".split())}
    t = Transducer.compile(words)
    path = tmp_path / "t"
    path.write_bytes(t.to_bytes())
    for x in (t, Transducer.memory_map(str(path))):
        asked = [*words, b"", b"abcd", b"ing", b"\xc3", b"zz"]
        length = np.array([len(w) for w in asked])
        got = x.look_up(np.frombuffer(b"".join(asked), np.uint8), np.cumsum(length) - length, length)
        for w, k in zip(asked, got, strict=True):
            assert (k >= 0) == (w in words)
            if k >= 0:
                assert list(x.out_ids[x.out_start[k] : x.out_start[k + 1]]) == words[w]
    assert len(t.final) < sum(map(len, words))  # suffixes are shared
    assert (Transducer.compile({}).look_up(np.zeros(1, np.uint8), np.array([0]), np.array([1])) == -1).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40) | st.sampled_from(["", "it's  the\n\n end ", "<|endoftext|>", "aaaaaaaaaaaaaaaa", "ไทยไทย", "不是。  "]), max_size=6))
def test_encoder_equals_the_public_one_and_comes_back(texts):
    words = {w: K.merge(w, RANKS) for w in (b"it", b" the", b"a", b"'s")}
    n, ids = K.Encoder(Transducer.compile(words), RANKS).encode([*texts, None])
    want = [PLAIN.encode_ordinary(t) for t in texts]
    assert list(n) == [*map(len, want), 0] and list(ids) == [i for w in want for i in w]
    assert PLAIN.decode(list(ids)) == "".join(texts)


def test_long_words_and_pieces(monkeypatch):
    monkeypatch.setattr(K, "WORK", 50)
    texts = ["x" * 3000 + "é" * 500, "a b " * 100, "", "q"]
    n, ids = K.Encoder(Transducer.compile({}), RANKS).encode(texts)
    assert list(ids) == [i for t in texts for i in PLAIN.encode_ordinary(t)] and n[2] == 0


def test_tables(spark):
    rows = [(1, "Hello world", "k"), (1, "Hello world", "k"), (2, None, "k"), (3, "", "k"), (None, "Hello", "k"), (4, "Zebra " * 2000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r["doc_id"] or 0, list(r["ids"])) for r in K.encode(df).collect()))
    assert got == sorted((i or 0, PLAIN.encode_ordinary(t or "")) for i, t, _ in rows)
    assert sorted(r["n_tokens"] for r in K.count_tokens(df).collect()) == sorted(len(x) for _, x in got)
    assert K.encode(df.limit(0)).count() == 0

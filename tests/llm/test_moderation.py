import numpy as np
import pytest

from loomgraph.llm import moderation as M


def undisguised(a, b):
    x, y = M.terms([a]), M.terms([b])
    return len(set(x.term) & set(y.term)) / len(set(y.term))


@pytest.mark.parametrize("a", ["you are an 1d107", "you are an i d i o t", "you are an idiооt", "you are an id​iot", "you are an idiiiiot"])
def test_disguises_are_undone(a):
    assert undisguised(a, "you are an idiot") > 0.6


def test_quoted_words_are_other_words():
    plain, quoted = M.terms(["the word idiot is old"]), M.terms(['the word "idiot" is old'])
    assert set(plain.term) != set(quoted.term)
    assert len(M.terms([None, "", "..."]).term) == 0


def corpus(n=600):
    rng = np.random.default_rng(0)
    texts, y = [], []
    for i in range(n):
        name = "".join(rng.choice(list("abcdefgh"), 6)).title()
        bad = rng.random() < 0.3
        parts = [f"The bridge of {name} was built in {1000 + i}."] * int(rng.integers(1, 4))
        parts.append(rng.choice([f"You are a blorf, {name}.", f"Send all the {name}s back, they are grens."]) if bad else rng.choice([f'The word "blorf" is old in {name}.', f"Some grens destroyed the mill of {name}."]))
        texts.append(" ".join(parts))
        y.append(float(bad) if rng.random() > 0.08 else 1.0 - bad)
    return texts, np.array(y), np.array(["You are" in t or "Send all" in t for t in texts])


def test_held_out_accuracy_despite_wrong_verdicts():
    texts, y, truth = corpus()
    m = M.fit(texts[:400], y[:400])
    z, _ = m.scores(M.terms(texts[400:]), 200)
    assert ((1 / (1 + np.exp(-z)) >= M.THRESHOLD) == truth[400:]).mean() > 0.95


def test_tables(spark):
    texts, y, truth = corpus(300)
    docs = spark.createDataFrame([(i, t, "s" if i % 2 else None, 0.0) for i, t in enumerate(texts)] + [(900, None, "s", 0.0), (901, "", "s", 0.0), (902, "x " * 5000, "s", 0.0), (1, texts[1], "s", 0.0)], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(5, None), (None, 1), (12345, 1), (7, 0), (7, 1)], "doc_id long, verdict int")
    out = M.score(docs, M.train(docs, labels), "source")
    got = out.collect()
    assert len(got) == 304 and {r["score"] for r in got if r["doc_id"] in (900, 901)} == {0.0}
    assert np.mean([r["offensive"] == truth[r["doc_id"]] for r in got if r["doc_id"] < 300]) > 0.93
    rates = {r["source"]: r["n_docs"] for r in M.by_source(out).collect()}
    assert rates == {None: 150, "s": 154}
    assert M.score(docs.limit(0), M.train(docs, labels.limit(0))).count() == 0


def test_filter_of_learnt_terms_changes_no_score():
    texts, y, _ = corpus(200)
    m = M.fit(texts[:150], y[:150])
    a, b = M.terms(texts[150:]), M.terms(texts[150:], slot=m.slot)
    assert len(b.term) < len(a.term)
    assert np.array_equal(m.scores(a, 50)[0], m.scores(b, 50)[0])


def test_scores_are_sums_over_pairs():
    texts, y, _ = corpus(120)
    m = M.fit(texts, y)
    t = M.terms(texts[:20])
    z = m.sentence_scores(t)
    for s in range(len(t.doc)):
        row = m.slot[t.term[t.sentence == s]]
        row = row[row > 0]
        want = m.bias + m.weight[row].sum() + sum(m.factors[a] @ m.factors[b] for k, a in enumerate(row) for b in row[k + 1 :])
        assert abs(z[s] - want) < 1e-4


def test_same_sentences_are_scored_once():
    of, s, r = M._same_sentences(np.array([0, 0, 2, 3, 3]), np.array([5, 7, 5, 5, 7]), 4)
    assert of[0] == of[3] and len({of[0], of[1], of[2]}) == 3
    assert sorted(zip(s.tolist(), r.tolist())) == sorted([(of[0], 5), (of[0], 7), (of[2], 5)])


def test_held_out_report(spark):
    texts, y, truth = corpus(300)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, verdict int")
    got = {r["model"]: r for r in M.held_out_report(docs, labels, part=2).collect()}
    assert set(got) == {"linear", "pairs"} and got["pairs"]["n_docs"] == 300 and got["pairs"]["n_offensive"] == int(y.sum())
    assert got["pairs"]["auc"] > 0.8
    assert M.held_out_report(docs, labels.limit(0)).count() == 0

"""Problem 8: scores for abusive, hateful or sexual content, by a factorization machine over hashed terms.

A sentence's score is a bias, a weight for each of its terms, and for each pair of its terms the product of their factors: so an insult
counts differently beside a second person than within quotation marks, and a word like vermin differently beside
a people than beside a mill. A document scores as its worst sentence. Human verdicts are given for documents, so that the training
has to find the sentence as well: a document's gradient goes to the sentence that scores highest (multiple-instance
learning), beginning from the log-odds of single terms.

Terms are words, pairs of neighbours, characters in twos and threes for scripts without spaces, and marks of how a word is
written. Spellings meant to escape notice (look-alike letters, digits for letters, spaced, repeated or starred letters,
invisible characters) are undone first; that they occurred is a term of its own.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labelled documents that the model is fitted on: the first so many by a hash of their id. All documents are scored.
LABELLED = 20_000
#: Terms are hashed to so many numbers; factors of a term; documents that a term must occur in to be learnt.
HASHED, FACTORS, LEAST_DOCUMENTS = 1 << 20, 4, 3
#: DECAY is in documents: a term needs about so many of them to move its weight by 1.
EPOCHS, RATE, DECAY, SMOOTH = 60, 0.08, 2.0, 0.06
#: The factors are held back more than the weights, as there are far more pairs than documents. Chosen by held_out on the check tables' labels.
FACTOR_RATE, FACTOR_DECAY = 0.016, 10.0
#: Documents at or above this probability count as offensive: above 0.5, as labelled documents are offensive far more often than others.
THRESHOLD = 0.62
#: Code points of one piece of scoring work.
WORK = 1 << 20

# ---- fixed values: words that mark a kind of offence in the languages of the corpus; they set the prior of a few weights (see fit) --------
INSULTS = """idiot idiots moron morons stupid dumb imbecile retard retarded scum scumbag bastard bitch asshole arsehole dickhead prick twat cunt wanker loser pathetic
worthless filthy fuck fucking fucked fucker motherfucker shit shitty bullshit piss stfu parasite pig cretin jackass dipshit
arschloch idiotin vollidiot schwachkopf dreckskerl drecksack wichser fotze hurensohn missgeburt penner spast schlampe trottel depp scheiße scheiß
connard connards conne salope enculé putain ordure crétin abruti pute enfoiré merde débile batard
imbécil idiota gilipollas cabrón puta mierda pendejo estúpido basura hijoputa capullo
идиот идиоты дурак тупой урод мразь сука блядь мудак дебил придурок тварь сволочь говно заткнись ублюдок""".split()
SEXUAL = """porn porno pornos porrnos nude nudes naked xxx hardcore horny sex sexy tits boobs breasts cock dick pussy cum orgasm moaned thighs blowjob anal webcam cams
nackt nackte geile geil titten muschi schwanz ficken fick ficke sexcam nue nues nu porno bite chatte seins baise baiser sexe
desnuda desnudas desnudo porno tetas polla coño follar sexo порно голая голой голые голых секс сиськи член трахать""".split()
HATRED = """vermin rats disease plague subhuman exterminate exterminated inferior deport thieves lynch rope
ungeziefer ratten ausrotten untermenschen diebe vermine cafards rats race éliminer ratas plaga ladrones raza exterminar
крысы паразиты вырезать воры недочеловеки""".split()
THREATS = """kill bleed die bullet legs hammer stab murder yourself töten umbringen sterben verrecken crever crève jambes casser mueras matar piernas romper
убью сдохни умри мост моста ноги""".split()
YOU = """you your yours yourself u du dich dir dein deine deinen dein euch ihr tu te toi ton ta tes vous votre ti tú tus usted vosotros
ты тебя тебе тобой твой твоя вы вас""".split()
REPORTS = """word term called calling discussed novel banned play paper council court convicted fined studied wort begriff mot roman palabra novela слово роман""".split()
#: Letters of other scripts that look like Latin ones, and the other way round.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһӏвкмнтгαορνικυτβ", "aeopcyxijsdhlbkmhtraopvikutb")
TO_CYRILLIC = str.maketrans("aeopcyxkmhtb", "аеорсухкмнтв")
LEET = str.maketrans("013457$@8!", "oieastsabi")

_WORDS = re.compile(r"[぀-ヿ㐀-䶿一-鿿฀-๿]|\w(?:[\w'’*@$]*\w)?\*{0,4}|[$@]\w+|[.!?…。！？।॥؟\n;]+|[\"“”„«»「」『』‘]|>")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_SPACED = re.compile(r"(?<!\S)\w(?: \w){2,}(?!\S)")
_THAI_GAP = re.compile(r"(?<=[\u0e00-\u0e7f\d”\"]) (?=[\u0e00-\u0e7f“\"])")
_RUNS = re.compile(r"(\w)\1{2,}")
_DOUBLES = re.compile(r"(\w)\1")
_ORDINAL = re.compile(r"\d+(?:st|nd|rd|th|er|re|e|ème|km|m|kg|er|s|x|d|p)?$|[a-z]\d+$")
# flags in the low bits of a token's code
CAP, CAPS, NUMBER, MASKED, DISGUISED, CHAR, INS, SEX, HATE, THREAT, SECOND, REPORT = (1 << k for k in range(12))
FLAG_BITS = 12
_SENTENCE, _OPEN, _CLOSE, _LOW, _HIGH, _STRAIGHT = (-(k + 2) for k in range(6))
_KINDS = {w: bit for words, bit in ((REPORTS, REPORT), (YOU, SECOND), (THREATS, THREAT), (HATRED, HATE), (SEXUAL, SEX), (INSULTS, INS)) for w in words}


class _Codes(dict):
    """Token to code: a hash of its undisguised form above the flags; marks of sentences and quotations are negative."""

    def __missing__(self, token: str) -> int:
        code = self[token] = _code(token)
        if len(self) > 400_000:
            self.clear()
        return code


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s) & 0x3FFFFFFFFFF


def _code(token: str) -> int:
    c = token[0]
    if c in ".!?…。！？।॥؟\n;":
        return _SENTENCE
    if c in "«「『‘":
        return _OPEN
    if c in "”»」』":
        return _CLOSE
    if c == "„":
        return _LOW
    if c == "“":
        return _HIGH
    if c == '"':
        return _STRAIGHT
    flags = 0
    if len(token) == 1 and ord(c) > 0xE00:
        return _hash(token) << FLAG_BITS | CHAR
    low = token.lower()
    if token.isdigit():
        return _hash("#9") << FLAG_BITS | NUMBER
    if len(token) > 1 and token.isupper():
        flags |= CAPS
    elif c.isupper():
        flags |= CAP
    if not low.isascii():
        latin = any("a" <= x <= "z" for x in low)
        other = any("Ͱ" <= x <= "ӿ" for x in low)
        if latin and other:
            flags |= DISGUISED
            n = sum("a" <= x <= "z" or "à" <= x <= "ÿ" for x in low)
            low = low.translate(LOOKALIKES) if n * 2 >= len(low) or low.translate(LOOKALIKES).isascii() else low.translate(TO_CYRILLIC)
    if "*" in low:
        flags |= MASKED
        return _hash(f"*{low[0]}{low[-1] if low[-1] != '*' else ''}{len(low)}") << FLAG_BITS | flags
    if any(x in "0134578$@" for x in low) and any(x.isalpha() for x in low) and not _ORDINAL.match(low):
        low = low.translate(LEET)
        flags |= DISGUISED
    if _RUNS.search(low):
        short = _RUNS.sub(r"\1", low)
        flags |= DISGUISED if short not in ("w", "i", "x") and low not in ("www", "xxx", "iii") else 0
        low = low if low in ("www", "xxx", "iii") else short
    kind = _KINDS.get(low) or _KINDS.get(_DOUBLES.sub(r"\1", low)) or 0
    return _hash(low) << FLAG_BITS | flags | kind


def _plain(text: str) -> tuple[str, bool]:
    """A text with its disguises between characters undone, and whether letters had been spaced out."""
    if not text.isascii():
        if _INVISIBLE.search(text):
            text = _INVISIBLE.sub("", text)
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        if _THAI_GAP.search(text):
            text = _THAI_GAP.sub("\n", text)  # statements are parted by blanks alone
    if "_" in text:
        text = text.replace("_", " ")
    spaced = False
    if _SPACED.search(text):
        spaced = True
        text = _SPACED.sub(lambda m: m[0].replace(" ", ""), text)
    return text, spaced


def _mix(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """Two numbers to one, spread over all bits (unsigned arithmetic wraps)."""
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


@dataclass
class Terms:
    """Hashed terms of sentences: doc by sentence, and (sentence, term) pairs sorted by sentence, without repeats."""

    doc: np.ndarray
    sentence: np.ndarray
    term: np.ndarray


def terms(texts: list[str | None], codes: _Codes | None = None, slot: np.ndarray | None = None) -> Terms:
    """The terms of all sentences of the texts. Null and empty texts have no sentence.

    With the slots of a model only the terms it has learnt are kept: the others weigh nothing and would only be sorted.
    """
    codes = _Codes() if codes is None else codes
    flat: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    spaced_docs = np.zeros(len(texts), bool)
    get = codes.__getitem__
    for i, t in enumerate(texts):
        if t:
            t, spaced_docs[i] = _plain(t)
            own = list(map(get, _WORDS.findall(t)))
            flat += own
            flat.append(_SENTENCE)
            sizes[i] = len(own) + 1
    code = np.array(flat, np.int64)
    if not len(code):
        return Terms(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    doc = np.repeat(np.arange(len(texts)), sizes)
    ends = code == _SENTENCE
    sid = np.cumsum(ends) - ends
    # inside quotation marks: opened more often than closed so far in the sentence
    high = code == _HIGH
    marks = np.flatnonzero(code < -2)
    if len(marks):
        prev = np.r_[0, code[marks][:-1]]
        same = np.r_[False, sid[marks][1:] == sid[marks][:-1]]
        german = (code[marks] == _HIGH) & (prev == _LOW) & same
        step = np.zeros(len(code), np.int64)
        step[(code == _OPEN) | (code == _LOW) | high] = 1
        step[code == _CLOSE] = -1
        step[marks[german]] = -1
        depth = np.cumsum(step)
        straight = np.cumsum(code == _STRAIGHT)
        first = np.flatnonzero(np.r_[True, sid[1:] != sid[:-1]])
        base_d = np.repeat(np.r_[0, depth][first], np.diff(np.r_[first, len(code)]))
        base_s = np.repeat(np.r_[0, straight][first], np.diff(np.r_[first, len(code)]))
        quoted = (depth - base_d > 0) | ((straight - base_s) & 1 == 1)
    else:
        quoted = np.zeros(len(code), bool)
    word = code >= 0
    n_sentences = int(sid[-1]) + 1
    sentence_doc = np.zeros(n_sentences, np.int64)
    sentence_doc[sid] = doc
    w, s, q = code[word], sid[word], quoted[word]
    if not len(w):
        return Terms(sentence_doc, np.zeros(0, np.int64), np.zeros(0, np.int64))
    flags = w & ((1 << FLAG_BITS) - 1)
    own = (w >> FLAG_BITS) + q * np.int64(1 << 45)  # a quoted word is another word
    start = np.r_[True, s[1:] != s[:-1]]
    name = ((flags & CAP) > 0) & ~start
    general = np.where(name, _hash("#N"), own)
    out_s, out_t = [s], [_mix(own, 1)]

    def add(at: np.ndarray, value: np.ndarray) -> None:
        out_s.append(at)
        out_t.append(value)

    pair = np.flatnonzero(~start[1:]) + 1
    add(s[pair], _mix(_mix(general[pair - 1], general[pair]), 2))
    named = pair[name[pair - 1] | name[pair]]
    add(s[named], _mix(_mix(own[named - 1], own[named]), 2))
    chars = pair[((flags[pair] & CHAR) > 0)]
    chars = chars[(chars >= 2) & (s[np.maximum(chars - 2, 0)] == s[chars])]
    add(s[chars], _mix(_mix(_mix(own[chars - 2], own[chars - 1]), own[chars]), 3))
    skip = pair[(pair >= 2)]
    skip = skip[(s[skip - 2] == s[skip]) & ((flags[skip] & CHAR) == 0)]
    add(s[skip], _mix(_mix(general[skip - 2], general[skip]), 4))
    for k, bit in enumerate((CAPS, MASKED, DISGUISED, INS, SEX, HATE, THREAT, SECOND, REPORT)):
        at = np.flatnonzero((flags & bit) > 0)
        for inside in (False, True):
            some = s[at[q[at] == inside]]
            add(some, np.full(len(some), _flag_term(k, inside), np.uint64))
    quotes = np.unique(s[q])
    add(quotes, np.full(len(quotes), _flag_term(20, False), np.uint64))
    told = np.flatnonzero(spaced_docs[sentence_doc])
    add(told, np.full(len(told), _flag_term(21, False), np.uint64))
    at, hashed = np.concatenate(out_s).astype(np.int64), (np.concatenate(out_t) & np.uint64(HASHED - 1)).astype(np.int64)
    if slot is not None:
        known = np.flatnonzero(slot[hashed])
        at, hashed = at[known], hashed[known]
    key = _distinct(at * HASHED + hashed)
    return Terms(sentence_doc, key // HASHED, key % HASHED)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, without repeats (a plain sort is faster here than the hash table of np.unique, whose cost grows faster than its input)."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _flag_term(k: int, inside: bool) -> np.uint64:
    return _mix(np.array([k * 2 + inside]), 9)[0]


def _flag_slot(k: int, inside: bool = False) -> int:
    return int(_flag_term(k, inside) % np.uint64(HASHED))


@dataclass
class Model:
    """slot: by hashed term its row in weight and factors, 0 for terms that weren't learnt (row 0 is all zeros)."""

    slot: np.ndarray
    weight: np.ndarray
    factors: np.ndarray
    bias: float

    def sentence_scores(self, t: Terms) -> np.ndarray:
        row = self.slot[t.term]
        known = np.flatnonzero(row)
        return self._of_rows(row[known], t.sentence[known], len(t.doc))

    def _of_rows(self, row: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        """Scores of n sentences from their learnt terms, which are sorted by sentence."""
        out = np.full(n, float(self.bias))
        if not len(row):
            return out
        begin = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
        # half of (the sum's square less the squares' sum) over all factors is the sum over all pairs
        z = np.add.reduceat((self.weight - (self.factors**2).sum(1) / 2).astype(float)[row], begin)
        for f in range(self.factors.shape[1]):
            z += np.add.reduceat(self.factors[:, f].astype(float)[row], begin) ** 2 / 2
        out[sentence[begin]] += z
        return out

    def scores(self, t: Terms, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """By document the highest score of its sentences (-inf if it has none), and that sentence's number (-1)."""
        return _worst(self.sentence_scores(t), t.doc, n_docs)


def _worst(z: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """By document its highest score and the last sentence that has it; doc is sorted."""
    best, at = np.full(n_docs, -np.inf), np.full(n_docs, -1)
    if len(z):
        begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        best[doc[begin]] = np.maximum.reduceat(z, begin)
        top = np.flatnonzero(z == best[doc])
        at[doc[top]] = top
    return best, at


def fit(texts: list[str], verdicts: np.ndarray, epochs: int = EPOCHS, seed: int = 7, factors: int = FACTORS) -> Model:
    """A model from documents and their mean verdicts (0 to 1). Without any verdicts it is what the word lists alone say.

    The word lists are the mean of the weights' prior: a few terms (an insult, a second person, a quotation ...) are drawn towards the
    weights named here, all others towards 0, for as long as it trains; verdicts outweigh that by their number (DECAY).
    With factors = 0 it is a linear model.
    """
    return fit_terms(terms(texts), len(texts), verdicts, epochs, seed, factors)


def fit_terms(t: Terms, n_docs: int, verdicts: np.ndarray, epochs: int = EPOCHS, seed: int = 7, factors: int = FACTORS) -> Model:
    y = np.clip(verdicts.astype(float), SMOOTH, 1 - SMOOTH)
    doc_term = _distinct(t.doc[t.sentence] * HASHED + t.term) if n_docs else np.zeros(0, np.int64)
    d, term = doc_term // HASHED, doc_term % HASHED
    n = np.bincount(term, minlength=HASHED)
    prior_terms = {_flag_slot(3): 2.2, _flag_slot(4): 1.6, _flag_slot(5): 0.7, _flag_slot(6): 0.5, _flag_slot(7): 0.5, _flag_slot(1): 1.0, _flag_slot(2): 0.7, _flag_slot(3, True): -0.3, _flag_slot(20): -0.7, _flag_slot(8): -0.9}
    learnt = np.union1d(np.flatnonzero(n >= LEAST_DOCUMENTS), np.array(sorted(prior_terms), np.int64))
    slot = np.zeros(HASHED, np.int32)
    slot[learnt] = np.arange(1, len(learnt) + 1)
    # log-odds of the documents with a term, shrunk towards the base rate; a term rarely seen says little
    base = float(np.clip(verdicts.mean() if n_docs else 0.15, 0.02, 0.6))
    hits = np.bincount(term, verdicts[d] if n_docs else None, HASHED)
    rate = (hits + 3 * base) / (n + 3)
    odds = np.log(rate / (1 - rate)) - np.log(base / (1 - base))
    rng = np.random.default_rng(seed)
    size = len(learnt) + 1
    prior = np.zeros(size)
    for s, v in prior_terms.items():
        prior[slot[s]] = v
    w = np.r_[0.0, 0.35 * odds[learnt]] + prior
    v = rng.normal(0, 0.05, (size, factors))
    v[0] = 0
    m = Model(slot, w, v, -2.5)
    row = slot[t.term]
    known = np.flatnonzero(row)
    of, s_all, r_all = _same_sentences(t.sentence[known], row[known], len(t.doc))
    upto = np.searchsorted(s_all, np.arange(of.max(initial=-1) + 2))
    first_w, second_w = np.zeros(size), np.zeros(size)
    first_v, second_v = np.zeros((size, factors)), np.zeros((size, factors))
    fb = sb = 0.0
    n_sentences = len(upto) - 1
    for e in range(1, epochs + 1 if n_docs else 1):
        z, at = _worst(m._of_rows(r_all, s_all, n_sentences)[of], t.doc, n_docs)
        have = np.flatnonzero(at >= 0)
        p = 1 / (1 + np.exp(-np.clip(z[have], -30, 30)))
        g_doc = (p - y[have]) / max(1, len(have))
        chosen = of[at[have]]
        length = upto[chosen + 1] - upto[chosen]
        g = np.repeat(g_doc, length)
        at_term = np.repeat(upto[chosen] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        rows = r_all[at_term]
        gw = np.bincount(rows, g, size) + DECAY * (m.weight - prior) / n_docs
        gv = np.zeros((size, factors))
        place = np.repeat(np.arange(len(chosen)), length)
        for f in range(factors):
            x = m.factors[rows, f]
            total = np.bincount(place, x, len(chosen))
            gv[:, f] = np.bincount(rows, g * (total[place] - x), size)
        gv += FACTOR_DECAY * m.factors / n_docs
        gb = g_doc.sum()
        a1, a2 = 1 - 0.9**e, 1 - 0.99**e
        first_w, second_w = 0.9 * first_w + 0.1 * gw, 0.99 * second_w + 0.01 * gw * gw
        first_v, second_v = 0.9 * first_v + 0.1 * gv, 0.99 * second_v + 0.01 * gv * gv
        fb, sb = 0.9 * fb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        tiny = 1e-3 / max(1, len(have))
        m.weight = m.weight - RATE * (first_w / a1) / (np.sqrt(second_w / a2) + tiny)
        m.factors = m.factors - FACTOR_RATE * (first_v / a1) / (np.sqrt(second_v / a2) + tiny)
        m.bias -= RATE * (fb / a1) / (np.sqrt(sb / a2) + 1e-9)
        m.weight[0], m.factors[0] = 0, 0
    m.weight, m.factors = m.weight.astype(np.float32), m.factors.astype(np.float32)
    return m


def _same_sentences(sentence: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sentences of the same learnt terms taken once: (by sentence its number among those, and their numbers and terms, sorted)."""
    sign = np.zeros(n, np.uint64)
    begin = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]]) if len(row) else np.zeros(0, np.int64)
    if len(row):
        sign[sentence[begin]] = np.add.reduceat(_mix(row, 5), begin)
    order = np.argsort(sign, kind="stable")
    new = np.r_[True, sign[order][1:] != sign[order][:-1]] if n else np.zeros(0, bool)
    of = np.zeros(n, np.int64)
    of[order] = np.cumsum(new) - 1
    taken = np.zeros(n, bool)
    taken[order[new]] = True
    keep = np.flatnonzero(taken[sentence])
    by = np.argsort(of[sentence[keep]], kind="stable")
    return of, of[sentence[keep]][by], row[keep][by]


def train(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Model:
    """Fits on at most `most` labelled documents, drawn by a hash of their ids; several verdicts of one document are averaged.

    Null verdicts, verdicts of unknown documents and documents without text are left out.
    """
    got = _labelled(docs, labels, most)
    return fit(got["text"].tolist(), got["y"].to_numpy(float))


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> pd.DataFrame:
    """(doc_id, text, y) of the documents that a model is fitted on."""
    mean = labels.where("doc_id is not null and verdict is not null").groupBy("doc_id").agg(F.avg(F.col("verdict").cast("double")).alias("y"))
    mean = mean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    few = docs.where("text is not null").join(F.broadcast(mean), "doc_id").select("doc_id", "text", "y")  # at most `most` rows
    return few.toPandas().sort_values(["doc_id", "text"], ignore_index=True).drop_duplicates("doc_id")


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """(doc_id, keep, score double, offensive boolean) of every row: the probability of the worst sentence.

    Null, empty and blank texts score 0. Texts are taken whole, in pieces of WORK code points at a time. Repeated rows are kept.
    """
    kinds = dict(docs.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by HASHED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for b in batches:
            texts = b.column(0).to_pylist()
            z = np.full(len(texts), -np.inf)
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size < WORK):
                    size += len(texts[j] or "")
                    j += 1
                z[i:j] = shared.value.scores(terms(texts[i:j], codes, shared.value.slot), j - i)[0]
                i = j
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            p[~np.isfinite(z)] = 0.0
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(p), pa.array(p >= THRESHOLD)], [*b.schema.names[1:], "score", "offensive"])

    columns = ["doc_id", *keep]
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", score double, offensive boolean"
    return docs.select(F.col("text").alias("__text"), *columns).mapInArrow(run, schema)


def by_source(scored: DataFrame, source: str = "source") -> DataFrame:
    """(source, n_docs, n_offensive, rate, mean_score), null sources as one group. Partial sums come first, so that no source is hot."""
    out = scored.groupBy(source).agg(F.count("*").alias("n_docs"), F.sum(F.col("offensive").cast("long")).alias("n_offensive"), F.avg("score").alias("mean_score"))
    return out.select(source, "n_docs", "n_offensive", F.round(F.col("n_offensive") / F.col("n_docs"), 6).alias("rate"), F.round("mean_score", 6).alias("mean_score"))


def held_out(docs: pd.DataFrame, part: int = 5, factors: int = FACTORS) -> pd.DataFrame:
    """(doc_id, y, score) of each document (doc_id, text, y), scored by a model that was fitted without its part."""
    fold = docs["doc_id"].map(_fold(part)).to_numpy(np.int64)
    out = np.zeros(len(docs))
    for k in range(part):
        out[fold == k] = _one_part(docs["text"].to_numpy(object), docs["y"].to_numpy(float), fold, k, factors)
    return docs[["doc_id", "y"]].assign(score=out)


def _fold(part: int):
    return lambda i: xxhash.xxh64_intdigest(str(i)) % part


def _one_part(text: np.ndarray, y: np.ndarray, fold: np.ndarray, k: int, factors: int) -> np.ndarray:
    """Scores of the documents of part k by a model of the others."""
    m = fit(text[fold != k].tolist(), y[fold != k], factors=factors)
    own = text[fold == k].tolist()
    z = m.scores(terms(own, slot=m.slot), len(own))[0]
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def held_out_report(docs: DataFrame, labels: DataFrame, part: int = 5, most: int = LABELLED) -> DataFrame:
    """(model string, n_docs, n_offensive, recall, precision, auc): the labelled documents scored by models fitted without their part.

    One row for the factorization machine and one for the linear model, which lacks the pairs of terms. A document is offensive if its verdicts
    have a mean above 0.5; auc takes ties as half. Verdicts may be wrong, so that no model reaches 1. Each model's fits run in one
    task on the labelled documents, at most `most`, which it reads from a broadcast. No labelled documents give no rows.
    """
    got = _labelled(docs, labels, most)
    spark = docs.sparkSession
    fold = got["doc_id"].map(_fold(part)).to_numpy(np.int64)
    shared = spark.sparkContext.broadcast((got["text"].to_numpy(object), got["y"].to_numpy(float), fold))  # bounded by `most`
    todo = [(name, f, k) for name, f in (("linear", 0), ("pairs", FACTORS)) for k in range(part) if (fold == k).any()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text, y, fold = shared.value
        for b in batches:
            for name, f, k in b.itertuples(index=False):
                yield pd.DataFrame({"model": name, "truth": y[fold == k] > 0.5, "score": _one_part(text, y, fold, int(k), int(f))})

    jobs = spark.createDataFrame(todo, "model string, f int, k int").repartition(2, "model")  # two tasks, as each holds all labelled documents' terms
    scored = jobs.mapInPandas(run, "model string, truth boolean, score double")
    per = scored.groupBy("model", "score").agg(F.sum(F.col("truth").cast("long")).alias("pos"), F.count("*").alias("n"))
    below = F.sum(F.col("n") - F.col("pos")).over(Window.partitionBy("model").orderBy("score")) - (F.col("n") - F.col("pos"))  # at most `most` rows
    per = per.withColumn("won", F.col("pos") * (below + (F.col("n") - F.col("pos")) / 2))
    hit = F.col("score") >= THRESHOLD
    out = per.groupBy("model").agg(
        F.sum("n").alias("n_docs"), F.sum("pos").alias("n_offensive"), F.sum(F.when(hit, F.col("pos"))).alias("both"),
        F.sum(F.when(hit, F.col("n"))).alias("found"), F.sum("won").alias("won"),
    )
    pos, neg = F.col("n_offensive"), F.col("n_docs") - F.col("n_offensive")
    return out.select("model", "n_docs", "n_offensive", F.round(F.col("both") / F.nullif(pos, F.lit(0)), 4).alias("recall"), F.round(F.col("both") / F.col("found"), 4).alias("precision"), F.round(F.col("won") / F.nullif(pos * neg, F.lit(0)), 4).alias("auc"))

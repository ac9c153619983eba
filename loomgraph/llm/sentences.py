"""Problem 4: sentence units of texts in many languages and scripts, with their exact places.

A text is first cut into blocks: headings, list entries and paragraphs. Within a block the places where a unit may end make a
lattice: runs of closing marks with the quotes, brackets and notes that belong to them, and between runs of scripts without spaces also blanks and line
breaks. Each place gets evidence for an end (above 0) or against it (below), partly depending on where the unit would have begun; the
cheapest way through the lattice gives the units.

Runs of scripts without spaces (Chinese, Japanese, Thai) are cut into words by a lattice over a dictionary: the words of a public vocabulary for many languages and
the particles and opening words listed here. A gap beside such a run is judged by its mark, the final particle before it and the opening word after it.

Rules that look a fixed number of characters around a place say so where they stand: no abbreviation is longer than 24 characters, an address is told by its last 80, no clause that reports
speech has more than 9 words (16 characters in Chinese and Japanese). Nothing else depends on the length of a text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: words and marks of the languages --------------------------------------------------------------

# abbreviations before a name, a number or more of the sentence: their mark ends no unit whatever follows
OPEN_ABBREVIATIONS = set(
    """mr mrs ms dr prof st ste gen capt col lt sgt maj adm rev hon gov sen rep pres messrs mme mlle mlles mm hr fr frl hrn sr sra srta dra
    d.ª dña no nr nos vol vols fig figs p pp pg pág págs pag bd bde s vgl bzw sog ca c cca approx aprox env est incl max min vs cf v b
    ed eds ch chap sec art al. op cit ibid tel nº núm num hno ud uds vid ej ex i.e e.g z.b z d.h d.i u.a o.ä u.u z.t evtl ggf inkl
    zzgl geb gest ehem av jan feb mar apr jun jul aug sep sept oct nov dec janv févr avr juil déc dic ene abr ago okt dez mär
    янв февр мар апр июн июл авг сент окт нояб дек проф акад св ул пер просп пл стр табл рис ср прим см род ум им гл т.е т.н т.к тов
    д-р г-н г-жа оз р о-в пос дер вып изд ред тыс""".split()
)
# abbreviations that often stand last: their mark ends the unit if what follows looks like an opening
CLOSE_ABBREVIATIONS = set(
    """etc usw co inc ltd corp bros jr sr al a.m p.m &c ff f km m cm kg bc ad b.c a.d u.s u.k usf u.a.m u.ä гг вв т.д т.п др пр н.э км руб
    j.-c a.c d.c kg ha min""".split()
)
# words that open a sentence but no name; they tell apart what follows an initial, an ordinal or a year
OPENERS = set(
    """the it its in on at by he she they we his her their this that these those there according later most despite until around when while
    why who however a an as after before der die das ein eine es er sie nach seit über im am laut zum bei und aber le la les un une
    elle il depuis selon vers on cette ce voir sin el los las una en hacia según para tiene véase hay fue он она оно они в на по к о
    это эта этот там как позднее население однако высота строительство см""".split()
)
# verbs of clauses that report speech
REPORTING = set(
    """said asked cried replied shouted answered exclaimed whispered called added noted remarked yelled muttered screamed wrote says asks
    sagte rief fragte meinte antwortete schrie dit cria demanda répondit ajouta dijo gritó preguntó respondió añadió сказал сказала спросил
    спросила крикнул крикнула ответил ответила कहा पूछा बोला बोली चिल्लाया उत्तर قال قالت سأل صاح أجاب""".split()
)
CJK_REPORTING = re.compile("说|說|道|喊|问|問|答|叫|曰|表示|写|寫")
# what goes on after a Japanese quotation
JA_AFTER_QUOTE = tuple("と って は が を に で の も へ や 、 という など から まで".split())
GERMAN_AFTER_ORDINAL = set("jahrhundert jh januar februar märz april mai juni juli august september oktober november dezember jan feb okt nov dez".split())
THAI_WORDS = set(
    """และ หรือ แต่ โดย ที่ ซึ่ง อัน เพราะ จึง ใน จาก ของ กับ เพื่อ ว่า คน ตาราง กิโลเมตร ตารางกิโลเมตร เมตร กม ปี บาท น วัน เดือน ชั่วโมง นาที ครั้ง แห่ง หลัง องค์
    นี้ นั้น มี เป็น อยู่ ทาง เหนือ ใต้ เมือง เมืองนี้ ประชากร พื้นที่ ชื่อ มา ใกล้ หมู่บ้าน สะพาน วัด โรงเรียน สถานี หอสมุด หน้า เขียน ถึง สร้าง ขึ้น กล่าว ถาม ตอบ
    เก่า เล็ก งาม ใหญ่ ไป กัน เถอะ เย็น แล้ว ครับ ค่ะ นะ พ.ศ. ค.ศ. ดร. น. จ. อ. ต. พล.อ. ศ. รศ. ผศ. นาย นาง นางสาว เมื่อ ต่อมา อย่างไรก็ตาม
    คะ จ้ะ สิ เลย ด้วย ก็ ได้ ให้ ไม่ จะ เคย ต้อง ควร อาจ กำลัง ถูก ทำ เห็น รู้ คิด พูด บอก ร้อง อ่าน ฟัง เดิน กิน ดื่ม นอน ซื้อ ขาย เปิด ปิด เริ่ม จบ
    เขา เธอ ผม ฉัน เรา ท่าน มัน พวกเขา พวกเรา ใคร อะไร ไหน ไหม ทำไม อย่างไร เท่าไร บ้าน น้ำ แม่น้ำ ภูเขา ทะเล เกาะ จังหวัด อำเภอ ตำบล ประเทศ ภาษา
    ไทย หนังสือ หนังสือพิมพ์ โบสถ์ ป่า ทะเลสาบ พิพิธภัณฑ์ โรงพยาบาล มหาวิทยาลัย ตลาด ถนน ประตู วันนี้ พรุ่งนี้ เมื่อวาน ปัจจุบัน นอกจากนี้ ดังนั้น อีก ทั้ง ทุก บาง หลาย""".split()
)
THAI_GO_ON = set("และ หรือ แต่ โดย ที่ ซึ่ง อัน เพราะ จึง ใน จาก ของ กับ เพื่อ ว่า พ.ศ. ค.ศ.".split())
# particles that only end a statement: one before a gap outweighs a joining word after it
THAI_FINAL = set("ครับ ค่ะ คะ จ้ะ นะ นะครับ นะคะ".split())
# words that end a statement (particles, and the forms of verbs that stand last), and words that open the next one
CJK_FINAL = set("了 吗 嗎 呢 吧 啊 呀 嘛 啦 だ た です ます でした ました である であった ない なかった よ ね か ぞ わ ください ません でしょう だった った".split())
CJK_OPENERS = set(
    """但是 然而 后来 後來 因此 所以 于是 該 该 这 這 那 他 她 它 人们 人們 我们 我們 你 全 第 为什么 為什麼 当 當 在
    この その あの なお また ただし そこで 第 なぜ 彼 彼女 人々 面積 人口 さらに つまり""".split()
)
# words that carry a sentence on after an ellipsis
CJK_GO_ON = set("但 而 却 卻 可是 不过 不過 しかし が でも けど けれど だが ところが そして".split())
# what is counted by the number before; only as a whole word, as names may begin with the same letters
THAI_UNITS = set("คน ตาราง กิโลเมตร ตารางกิโลเมตร เมตร กม ปี บาท น น. วัน เดือน ชั่วโมง นาที ครั้ง แห่ง หลัง องค์".split())
THAI_REPORTING = re.compile("กล่าว|ถาม|ตอบ|ร้อง|บอก|พูด")
OPENING = {"(": ")", "（": "）", "[": "]", "「": "」", "『": "』", "“": "”", "„": "“", "«": "»", "‹": "›", "‘": "’", "《": "》", "【": "】", "{": "}"}
QUOTES = set("「『“„«»‹‘\"")
CLOSERS = set(")）]」』”“’»«›\"》】}'")
TERMINATORS = "[.!?…。！？｡।॥؟۔]+"

#: A public vocabulary of many languages, as a file of base64 tokens and ranks, whose words in scripts without spaces join the dictionary.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

# ---- patterns ------------------------------------------------------------------------------------------------------

_LINE = re.compile(r"[^\r\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*(?:\r\n|[\r\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029]|$)")
_HEADING = re.compile(r"\s*(=+)[^=].*=\s*$|\s*=+\s*$", re.S)
_LIST = re.compile(r"\s*([*#:;•]+)\s*")
_ATOM = re.compile(r"\[\[[^\[\]\n]*(?:\[[^\[\]\n]*\][^\[\]\n]*)*\]\]|<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref\s*>", re.S)
_MARK = re.compile(TERMINATORS)
_NOTE = re.compile(r"\[\d+\]|\[[a-z]\]|[¹²³⁰-⁹†‡]")
_TOKEN = re.compile(r"[\p{L}\p{M}\p{N}&'’.\-ª º]{0,24}$")
_WORD = re.compile(r"[\p{L}\p{M}\p{N}'’\-]+")
_CJK = re.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]")
_THAI = re.compile(r"\p{Thai}")
_CJK_RUN = re.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー々]+")
_THAI_RUN = re.compile(r"[\p{Thai}.]*\p{Thai}[\p{Thai}.]*")
_CJK_STOP = re.compile("[。！？!?]")
_STOP = re.compile(r"[.!?।॥؟]")
_NUMBER_END = re.compile(r"(?:^|[^\p{L}\p{M}\p{N}.,])(\d{1,2})$")
# what stands before and after a full stop
_PAIRED = re.compile(r"[()（）\[\]「」『』“”„«»‹›‘’\"《》【】]")
_THREE_DIGITS = re.compile(r"\d{3}$")
_ARABIC = re.compile(r"\p{Arabic}")
_ARABIC_METRES = re.compile(r"\d\s*م$")
_DEVANAGARI = re.compile(r"\p{Devanagari}")
_INITIAL = re.compile(r"(?:^|[\s.\-'’(])\p{Lu}$")
_ABBREVIATED = re.compile(r"(?:\p{L}{1,3}\.\s?)*[\p{L}&\-]*$")
_SPACED_CAPITAL = re.compile(r"\p{Lu}\.\s")
_NAME_INITIAL = re.compile(r"(?:\p{Lu}\p{L}*\.?[\s\-]|\p{Lu}\.)\p{Lu}$")
_YEAR_RU = re.compile(r"\d\s*г$")
_OPENING_YEAR_RU = re.compile(r"(?:^|[.!?»…]\s+)\p{Lu}\p{L}*\s+\d+\s*г$")
_UNIT_OF_MEASURE = re.compile(r"\d\s*\p{L}$")
_DOTTED = re.compile(r"(?:\p{L}\.){1,3}\p{L}$")
_ROMAN = re.compile(r"[ivxlcdm]+")
_LAST_CHUNK = re.compile(r"\S*$")
_BLANK = re.compile(r"\s+")
_GERMAN = re.compile(r"\b(?:der|die|das|und|ist|von)\b")
_STOP_BLANK = re.compile(r"\.\s*")
#: Stand-ins for links and notes: a link acts as a name, a note as nothing.
LINK, NOTE = "\ue000", "\ue001"
#: Evidence from here on, either way, is certain: the lattice is cut there.
CERTAIN = 8.0


def blocks(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, content, end) of headings (content = end), list entries (content after the marker) and paragraphs (content = start)."""
    open_from, upto = -1, 0
    for m in _LINE.finditer(text):
        line = m[0]
        if not line:
            continue
        if not line.strip():
            kind = "blank"
        elif line.lstrip().startswith("=") and _HEADING.match(line):
            kind = "heading"
        elif _LIST.match(line):
            kind = "list"
        else:
            if open_from < 0:
                open_from = m.start()
            upto = m.end()
            continue
        if open_from >= 0:
            yield open_from, open_from, upto
            open_from = -1
        if kind == "heading":
            yield m.start(), m.end(), m.end()
        elif kind == "list":
            yield m.start(), m.start() + _LIST.match(line).end(), m.end()
    if open_from >= 0:
        yield open_from, open_from, upto


def _enclosures(w: str) -> list[tuple[int, int]]:
    """(open, close) places of quotes and brackets that are closed in this block; a left-over opening encloses nothing."""
    stack: list[tuple[str, int]] = []
    out = []

    def close(opens: str, at: int) -> bool:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in opens:
                out.append((stack[k][1], at))
                del stack[k:]
                return True
        return False

    for m in _PAIRED.finditer(w):
        c, i = m[0], m.start()
        before, after = w[i - 1 : i], w[i + 1 : i + 2]
        if c == '"':
            if not close('"', i):
                stack.append((c, i))
        elif c == "“":
            if not close("„", i):
                stack.append((c, i))
        elif c == "«":
            if not close("»", i):
                stack.append((c, i))
        elif c == "»":
            if not close("«", i) and (not before or before.isspace()) and after and not after.isspace():
                stack.append((c, i))  # the German way round
        elif c == "’":
            if not (after.isalpha() and before.isalpha()):
                close("‘‚", i)
        elif c == "”":
            close("“„", i)
        elif c in OPENING:
            if c != "‘" or not before.isalpha():
                stack.append((c, i))
        else:
            close({")": "(", "）": "（", "]": "[", "」": "「", "』": "『", "›": "‹", "》": "《", "】": "【"}[c], i)
    return sorted(out)


def read_words(vocabulary: str | None = VOCABULARY) -> frozenset[str]:
    """The dictionary: words of two characters and more (Thai: four, as shorter ones are pieces of syllables) of the vocabulary, and the lists above."""
    found = set(THAI_WORDS | THAI_FINAL | CJK_FINAL | CJK_OPENERS | CJK_GO_ON | set(JA_AFTER_QUOTE))
    if vocabulary:
        with open(vocabulary, "rb") as f:
            for line in f:
                try:
                    word = base64.b64decode(line.split()[0]).decode().strip()
                except UnicodeDecodeError:  # a part of a character
                    continue
                if len(word) >= 2 and (_CJK_RUN.fullmatch(word) or (len(word) >= 4 and _THAI_RUN.fullmatch(word))):
                    found.add(word)
    return frozenset(found)


class Lexicon:
    """A dictionary with, by first character, the lengths of its words; runs cut lately are remembered."""

    def __init__(self, known: frozenset[str]):
        self.known = known
        lengths: dict[str, set[int]] = {}
        for x in known:
            lengths.setdefault(x[0], set()).add(len(x))
        self.lengths = {c: sorted(n) for c, n in lengths.items()}
        self.cut = lru_cache(20_000)(self._cut)

    def _cut(self, run: str) -> tuple[str, ...]:
        return tuple(words(run, self))


@lru_cache(2)
def _default_lexicon(vocabulary: str | None = VOCABULARY) -> Lexicon:
    return Lexicon(read_words(vocabulary))


def words(run: str, lexicon: Lexicon) -> list[str]:
    """A spaceless run cut into words: the cheapest path through the lattice of dictionary words and unknown stretches.

    A dictionary word costs 1, an unknown stretch 2 and 1 more for each character, so that known words win and unknown
    names stay in one piece. Of equal paths the one with the longer last words is taken.
    """
    n = len(run)
    known, lengths = lexicon.known, lexicon.lengths
    best = [0.0] + [1e9] * n
    back = [0] * (n + 1)
    opened, start = 1e9, 0  # best cost of being within an unknown stretch, and where it began
    for i in range(n):
        b = best[i] + 1
        for k in lengths.get(run[i], ()):
            if i + k > n:
                break
            if b < best[i + k] and run[i : i + k] in known:
                best[i + k], back[i + k] = b, i
        if b + 2 <= opened + 1:
            opened, start = b + 2, i
        else:
            opened += 1
        if opened < best[i + 1]:
            best[i + 1], back[i + 1] = opened, start
    out, i = [], n
    while i > 0:
        out.append(run[back[i] : i])
        i = back[i]
    return out[::-1]


class _Block:
    """The lattice of one paragraph or list entry: w is its text with links and notes masked, of the same length."""

    def __init__(self, w: str, german: bool, lexicon: Lexicon):
        self.w, self.german, self.lexicon = w, german, lexicon
        self.spans = _enclosures(w)
        first = None if w.isascii() else _THAI.search(w)
        self.thai, self.thai_from = first is not None, first.start() if first else len(w)
        # by end and by beginning of each spaceless run its words
        self.before: dict[int, tuple[str, ...]] = {}
        self.after: dict[int, tuple[str, ...]] = {}
        if not w.isascii():
            for pattern in (_CJK_RUN, _THAI_RUN) if self.thai else (_CJK_RUN,):
                for m in pattern.finditer(w):
                    cut = lexicon.cut(m[0])
                    self.before[m.end()], self.after[m.start()] = cut, cut

    def particles(self, i: int, j: int) -> float:
        """Evidence from the words around a gap from i to j: a final particle before it, an opening word or one that goes on after it."""
        left, right = self.before.get(i), self.after.get(j)
        score = 0.0
        if left and left[-1] in CJK_FINAL:
            score += 3.0
        if right:
            score += 3.0 if right[0] in CJK_OPENERS else -3.0 if right[0] in CJK_GO_ON else 0.0
        return score

    def inner(self, i: int) -> list[tuple[int, int]]:
        return [s for s in self.spans if s[0] < i < s[1]]

    def candidates(self) -> list[tuple[int, float, float, int]]:
        """(end, evidence, evidence if the unit begins at the opening place, opening place or -1), by place."""
        w, out, open_spans, k = self.w, [], [], 0
        for m in _MARK.finditer(w):
            p, q = m.span()
            while k < len(self.spans) and self.spans[k][0] < p:
                open_spans.append(self.spans[k])
                k += 1
            open_spans = [s for s in open_spans if s[1] >= p]
            end, shut = self._closers(q, open_spans)
            if any(s[1] >= end for s in open_spans):
                continue  # enclosed by a quotation or bracket that goes on
            out.append((end, *self._judge(p, q, end, m[0], shut)))
        if self.before:
            out += self._blank_gaps()
        if self.thai:
            out += self._thai_gaps()
        out.sort()
        return out

    def _blank_gaps(self) -> list[tuple[int, float, float, int]]:
        """Blanks and line breaks between two Chinese or Japanese runs without a mark: an end only between a final particle and an opening word."""
        w, out = self.w, []
        for i, left in self.before.items():
            if i < len(w) and w[i].isspace() and left[-1] in CJK_FINAL:
                j = i
                while j < len(w) and w[j].isspace():
                    j += 1
                if j in self.after and not self.inner(i):
                    e = self.particles(i, j) - 4.0
                    out.append((i, e, e, -1))
        return out

    def _closers(self, q: int, open_spans: list[tuple[int, int]]) -> tuple[int, list[tuple[int, int]]]:
        """Where the closing quotes, brackets, footnote marks and notes after a mark end, and which enclosures they shut."""
        w, shut = self.w, []
        closing = {s[1]: s for s in open_spans}
        while q < len(w):
            c = w[q]
            if q in closing:
                shut.append(closing[q])
                q += 1
            elif c == NOTE:
                while q < len(w) and w[q] == NOTE:
                    q += 1
            elif (m := _NOTE.match(w, q)) is not None:
                q = m.end()
            elif c in ")）」』”" and c not in OPENING:
                q += 1  # closes nothing that was opened here, but opens nothing either
            elif c.isspace() and q + 1 < len(w) and (q + 1) in closing and w[q + 1] in "»›":
                q += 1
            elif c in ".!?…。！？" and shut:
                q += 1
            else:
                break
        return q, shut

    def _judge(self, p: int, q: int, end: int, mark: str, shut: list[tuple[int, int]]) -> tuple[float, float, int]:
        w = self.w
        at = end
        while at < len(w) and w[at].isspace():
            at += 1
        if at >= len(w):
            return 20.0, 20.0, -1
        nxt, gap = w[at], at > end
        word = _WORD.match(w, at)
        word = word[0] if word else ""
        if nxt in ",;:،؛、，；：" or (nxt in "—–-" and shut):
            return -20.0, -20.0, -1
        cjk_near = _CJK.match(nxt) is not None or (p > 0 and _CJK.match(w[p - 1]) is not None)
        lower = nxt.islower()
        if shut:
            outer = min(shut)
            return self._after_enclosure(outer, at, nxt, word, lower)
        if mark[0] in "।॥۔؟":
            return 20.0, 20.0, -1
        if mark[0] in "。！？｡" and "…" not in mark:
            if nxt in JA_AFTER_QUOTE[:1] and not gap:
                return -1.0, -1.0, -1
            e = 20.0 + self.particles(p, at)
            return e, e, -1
        if "…" in mark or mark.startswith(".."):
            if cjk_near:
                # the sentence goes on, unless a new line begins; words say more than the mark
                e = self.particles(p, at) + (5.0 if gap and "\n" in w[end:at] else -8.0)
                return e, e, -1
            return (-20.0 if lower else 6.0,) * 2 + (-1,)
        if mark[0] in "!?":
            if lower:
                return -20.0, -20.0, -1
            return (20.0,) * 2 + (-1,)
        return (self._dot(p, end, gap, at, nxt, word, lower, cjk_near),) * 2 + (-1,)

    def _after_enclosure(self, outer: tuple[int, int], at: int, nxt: str, word: str, lower: bool) -> tuple[float, float, int]:
        """A mark at the end of a quotation or bracket. If that began the unit, a clause reporting the speech may follow."""
        w = self.w
        a = outer[0]
        if w[a] not in QUOTES:  # a bracket: a unit of its own only if it began the unit
            return -20.0, 20.0, a
        if lower:
            return -20.0, -20.0, a
        if _CJK.match(nxt):
            # a particle after the quotation, as a word or at the front of one the dictionary doesn't know
            cut = self.after.get(at) or (w[at],)
            if cut[0] in JA_AFTER_QUOTE or any(w.startswith(x, at) for x in JA_AFTER_QUOTE):
                return -20.0, -20.0, a
            stop = _CJK_STOP.search(w, at, at + 17)  # a reporting clause has at most 16 characters
            stop = stop.start() if stop else len(w)
            if stop - at <= 16 and CJK_REPORTING.search(w, max(at, stop - 4), stop):
                return 6.0, -20.0, a
            return 20.0, 20.0, a
        stop = _STOP.search(w, at)
        tokens = []
        for m in _WORD.finditer(w, at, stop.start() if stop else len(w)):
            tokens.append(m[0].lower())
            if len(tokens) > 9:  # longer than a reporting clause
                break
        if len(tokens) <= 9 and tokens and (set(tokens[:5]) & REPORTING or tokens[-1] in REPORTING) and tokens[0] not in OPENERS:
            return 6.0, -20.0, a
        if THAI_REPORTING.search("".join(self.after.get(at, ()))):
            return 6.0, -20.0, a
        return 20.0, 20.0, a

    def _dot(self, p: int, end: int, gap: bool, at: int, nxt: str, word: str, lower: bool, cjk_near: bool) -> float:
        """A single full stop: the hard case of the spaced scripts."""
        w = self.w
        before = w[p - 1] if p else ""
        token = _TOKEN.search(w, max(0, p - 24), p)[0].rsplit(" ", 1)[-1]
        low = token.lower().lstrip("'’(")
        opening = nxt.isupper() or nxt == LINK or nxt in QUOTES or nxt in "([¿¡（"
        caseless = nxt.isalpha() and not nxt.isupper() and not nxt.islower()
        if not gap:
            if cjk_near and not (before.isascii() and nxt.isascii()):
                return 12.0 if not before.isdigit() else -20.0
            if nxt == LINK or (nxt.isupper() and w[at + 1 : at + 2].islower()):
                long_word = before == LINK or (before.isalpha() and len(low) >= 3 and "." not in low and "@" not in low) or (before.isdigit() and _THREE_DIGITS.search(low) is not None) or before in ")»”"
                return 10.0 if long_word and low not in OPEN_ABBREVIATIONS and not self._address(p) else -20.0
            return -20.0
        if lower and not caseless:
            return -20.0
        if _ARABIC.match(nxt) or _ARABIC.match(before or " "):
            if low in ("أ", "د", "ص", "م.أ") or (len(low) == 1 and low != "م") or (low == "م" and not _ARABIC_METRES.search(w[max(0, p - 8) : p])):
                return -20.0
            return 20.0 if not nxt.isdigit() else 2.0
        if _DEVANAGARI.match(before or " "):
            return -20.0 if len(low) <= 5 else 6.0
        if self.thai and _THAI.match(before or " "):
            return -20.0
        bare = low.rstrip(".")
        initial = _INITIAL.search(w[max(0, p - 3) : p]) is not None
        raw = _ABBREVIATED.search(w[max(0, p - 16) : p])[0]
        # spaced capitals are initials; the abbreviations of this form are written close, or with a small letter
        joined = "" if _SPACED_CAPITAL.match(raw) else _STOP_BLANK.sub(".", raw.lower())
        if nxt.isdigit():
            if bare in OPEN_ABBREVIATIONS or bare in CLOSE_ABBREVIATIONS or joined in OPEN_ABBREVIATIONS or len(bare) == 1:
                return -20.0
            return 4.0 if not (self.german and before.isdigit()) else -4.0
        if initial and joined not in CLOSE_ABBREVIATIONS - {bare}:
            # an initial, unless a word follows that opens sentences and isn't an initial itself
            opens = word.lower() in OPENERS and len(word) > 1 and w[at + len(word) : at + len(word) + 1] != "."
            return 3.0 if opens and not _NAME_INITIAL.search(w[max(0, p - 12) : p]) else -8.0
        if bare in CLOSE_ABBREVIATIONS or joined in CLOSE_ABBREVIATIONS:
            return 8.0 if opening or caseless else -8.0
        if joined in OPEN_ABBREVIATIONS or bare in OPEN_ABBREVIATIONS:
            return -12.0
        if len(bare) == 1 and bare.isalpha():
            if bare == "г" and _YEAR_RU.search(w[max(0, p - 8) : p]):
                # the year at a sentence's beginning is followed by what it says; elsewhere the year often stands last
                return -8.0 if _OPENING_YEAR_RU.search(w[max(0, p - 24) : p]) else 6.0
            if _UNIT_OF_MEASURE.search(w[max(0, p - 8) : p]) and not (len(word) == 1 and w[at + 1 : at + 2] == "."):
                return 6.0  # a unit of measure
            return -8.0
        if self.german and (m := _NUMBER_END.search(w[max(0, p - 4) : p])):
            if word.lower() in GERMAN_AFTER_ORDINAL:
                return -20.0
            return 4.0 if word.lower() in OPENERS else -3.0
        if _DOTTED.search(low) and "-" not in low:
            return 2.0 if word.lower() in OPENERS else -2.0
        if _ROMAN.fullmatch(bare) and len(bare) <= 4 and not opening:
            return -2.0
        if opening or caseless:
            return 20.0
        return 2.0

    def _address(self, p: int) -> bool:
        chunk = _LAST_CHUNK.search(self.w[max(0, p - 80) : p])[0]
        return "://" in chunk or "@" in chunk or chunk.startswith("www.")

    def _thai_gaps(self) -> list[tuple[int, float, float, int]]:
        """Blanks between Thai statements: judged by the words around them, cut out of the runs by the dictionary lattice."""
        w, out = self.w, []
        for m in _BLANK.finditer(w):
            i, j = m.span()
            if i == 0 or j >= len(w) or self.inner(i):
                continue
            before, cut = self.before.get(i, ()), self.after.get(j, ())
            if (cut and not _THAI.search(cut[0] + cut[-1])) or (before and not _THAI.search(before[0] + before[-1])):
                continue  # a Chinese or Japanese run
            left, right = bool(before), "".join(cut)
            if not (left or right or w[i - 1] == LINK or w[i - 1].isdigit() or w[i - 1] in "”\"’)"):
                continue
            if i < self.thai_from and not right:
                continue
            nxt = w[j]
            first = cut[0] if cut else ""
            counted = w[i - 1].isdigit() and first in THAI_UNITS and (len(cut) == 1 or cut[1] in THAI_WORDS)
            if left and before[-1].endswith("."):
                score = -20.0
            elif len(before) > 1 and before[-1] in THAI_FINAL and before[-2] in self.lexicon.known and (right or nxt in "“\"‘«"):
                score = 20.0  # whatever opens the next statement; but names may end with the same letters
            elif nxt.isdigit() or nxt in ",;:)]”" or nxt in "—–-":
                score = -20.0
            elif counted or first in THAI_GO_ON or any(right.startswith(x) for x in ("พ.ศ", "ค.ศ", "โดย", "และ", "ซึ่ง")):
                score = -20.0
            elif nxt in "“\"‘«":
                close = next((s[1] for s in self.spans if s[0] == j), -1)
                score = 8.0 if close > 0 and THAI_REPORTING.search("".join(self.after.get(close + 1, ()))) else -8.0
            elif w[i - 1] in "”\"’»":
                score = -8.0 if nxt.isascii() else 2.0
                a = next((s[0] for s in self.spans if s[1] == i - 1), -1)
                if a > 0 and w[a - 1 : a].isspace() and not any(right.startswith(x) for x in ("ชื่อ", "เมือง", "ดร.")):
                    score = -4.0
            elif nxt == LINK or right or nxt.isalpha():
                score = 20.0
            else:
                score = -2.0
            out.append((i, score, score, -1))
        return out


def _shortest(cands: list[tuple[int, float, float, int]], begin: int, w: str) -> list[int]:
    """The ends that cost least. Passing a place costs its evidence for an end, ending there its evidence against one."""
    cuts: list[int] = []
    start = begin  # where the unit begins, known at the last certain end
    run: list[tuple[int, float, float, int]] = []

    def first_of(end: int) -> int:
        while end < len(w) and w[end].isspace():
            end += 1
        return end

    def solve() -> None:
        nonlocal start
        n = len(run)
        opened = [start] + [first_of(c[0]) for c in run]
        of_opening: dict[int, list[int]] = {}
        for j, x in enumerate(opened):
            of_opening.setdefault(x, []).append(j)
        # value[j] + passed: the cost of the best way to the end before place j and of passing all places since. What passing a place costs depends on
        # the unit's beginning only where that is the place's own opening, so that one value moves there; the heap keeps the least.
        value, back = [0.0] + [1e18] * n, [-1] * (n + 1)
        heap = [(0.0, 0)]
        passed = 0.0
        for i, (_, e, own_e, opening) in enumerate(run):
            own = [j for j in of_opening.get(opening, ()) if j <= i] if opening >= 0 else []
            cost, arg = 1e18, -1
            aside = []
            while heap:
                v, j = heap[0]
                if v != value[j]:
                    heapq.heappop(heap)  # it has moved
                elif j in own:
                    aside.append(heapq.heappop(heap))
                else:
                    cost, arg = v + passed + max(0.0, -e), j
                    break
            for x in aside:
                heapq.heappush(heap, x)
            for j in own:
                if (c := value[j] + passed + max(0.0, -own_e)) < cost:
                    cost, arg = c, j
                value[j] += max(0.0, own_e) - max(0.0, e)
                heapq.heappush(heap, (value[j], j))
            passed += max(0.0, e)
            value[i + 1], back[i + 1] = cost - passed, arg
            heapq.heappush(heap, (value[i + 1], i + 1))
        arg = min(range(n + 1), key=value.__getitem__)  # and no further end
        own = []
        while arg > 0:
            own.append(run[arg - 1][0])
            arg = back[arg]
        cuts.extend(reversed(own))
        if own:
            start = first_of(own[0])
        run.clear()

    for c in cands:
        if c[1] == c[2] and c[1] >= CERTAIN:
            solve()
            cuts.append(c[0])
            start = first_of(c[0])
        elif c[1] == c[2] and c[1] <= -CERTAIN:
            continue
        else:
            run.append(c)
    solve()
    return cuts


def units(text: str | None, lang: str | None = None, lexicon: Lexicon | None = None) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of a text, as code-point offsets, end exclusive. Null, empty and blank texts have none.

    lang (any case, or a wiki name such as dewiki) only helps with German ordinals; without it German is told by its words.
    """
    if not text or text.isspace():
        return []
    lexicon = _default_lexicon() if lexicon is None else lexicon
    german = (lang or "").lower().startswith("de") if lang else len(_GERMAN.findall(text)) * 25 > len(text) / 6
    masked = _ATOM.sub(lambda m: (LINK if m[0].startswith("[[") else NOTE) * len(m[0]), text)
    out: list[tuple[int, int]] = []
    for start, content, end in blocks(text):
        cuts = [] if content >= end else [content + c for c in _block_cuts(masked[content:end], german, lexicon)]
        a = start
        for b in [*cuts, end]:
            lo, hi = a, b
            while lo < hi and text[lo].isspace():
                lo += 1
            while hi > lo and text[hi - 1].isspace():
                hi -= 1
            if lo < hi:
                out.append((lo, hi))
            a = b
    return out


def _block_cuts(w: str, german: bool, lexicon: Lexicon) -> list[int]:
    block = _Block(w, german, lexicon)
    cands = block.candidates()
    begin = len(w) - len(w.lstrip())
    return _shortest(cands, begin, w) if cands else []


def sentence_units(docs: DataFrame, id_column: str, text: str, lang: str | None = None, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """(id, unit_start int, unit_end int): the sentence units of each distinct (id, text), in any order.

    Each id is taken once: repeated rows of an id are identical but for late deliveries, of which the greatest text is taken. Null texts and null ids give
    no rows, as do empty and blank texts; texts are taken whole, however long. Further columns are ignored. vocabulary is a file of
    base64 tokens on the driver, or None for the word lists alone.
    """
    kind = dict(docs.dtypes)[id_column]
    chosen = docs.select(F.col(id_column).alias("id"), F.col(text).alias("t"), (F.col(lang) if lang else F.lit(None).cast("string")).alias("l"))
    once = chosen.where("id is not null and t is not null").groupBy("id").agg(F.max(F.struct("t", "l")).alias("x")).select("id", "x.t", "x.l")

    shared = docs.sparkSession.sparkContext.broadcast(read_words(vocabulary))  # bounded by the public vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value)
        for b in batches:
            ids, starts, ends = [], [], []
            for i, t, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for a, z in units(t, g, lexicon):
                    ids.append(i), starts.append(a), ends.append(z)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["id", "unit_start", "unit_end"])

    return once.mapInArrow(run, f"id {kind}, unit_start int, unit_end int").withColumnRenamed("id", id_column)

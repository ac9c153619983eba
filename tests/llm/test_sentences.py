import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import sentences as S
from loomgraph.llm.sentences import sentence_units, units

CASES = [
    ("en", ["Dr. Smith came at 6:29 p.m. in c. 11 ships.", "He left on Oct. 9, 1864.", "It was No. 5 in Vol. 5."]),
    ("en", ["“Stop!” Anna cried.", "Bob replied: “It is gone. Nothing remains.”", "A bridge (see p. 11 ff. in Ott et al.) fell."]),
    ("en", ["It closed in 1290.[22]", "It reopened in 1300.<ref>Ott, J. (1831). The mill. p. 19.</ref>", "(It was never rebuilt.)", "He waited ... and left…and came."]),
    ("en", ["It was bought by Hill & Co.", "The firm Hill Inc. owns it vs. Ott Ltd. in York.", "E. K. Lane (b. 1534, d. 1216) wrote it."]),
    ("de", ["Im 12. Jahrhundert gab es Höfe, Gärten usw.", "Am 5. Mai 1656 kam Prof. Ott.", "„Wir gehen. Sofort!“ rief Anna.", "»Halt! Es brennt.« stand dort."]),
    ("fr", ["Elle date du IIe siècle av. J.-C. selon F. Riian.", "« Partons. Elle brûle ! » cria Anne.", "On y voit des ponts, etc.", "M. Ott vint."]),
    ("es", ["Fue fundada hacia 1808 a. C. por B. Zen.", "«¿Dónde está?», preguntó la Dra. Luz.", "Según Ana, «Ardió. Nada quedó».", "Hay pozos, etc."]),
    ("ru", ["Он жил в г. Киров с 1373 по 1646 гг.", "«Уходим. Скорее!» — крикнул Ян.", "В 1342 г. акад. Ким продал дом, т. е. часть.", "Там были сады и т. д."]),
    ("hi", ["डॉ. राम ने कहा।", "“चलो। देर हो गई!” राम ने कहा।", "क्या यह पुल है?"]),
    ("ar", ["قال د. علي: «لنرحل. تأخر الوقت.»", "عاد علي عام 1380 م.", "هل بنيت محطة؟"]),
]


@pytest.mark.parametrize(("lang", "sentences"), CASES)
def test_spaced_scripts(lang, sentences):
    text = " ".join(sentences)
    assert [text[a:b] for a, b in units(text, lang)] == sentences


@pytest.mark.parametrize(("lang", "sentences"), [
    ("zh", ["「快走！」远江喊道。", "“没有了。走吧！”海岭说。", "面积82.90平方公里。", "（此处从未重建。）", "人们等了很久……山谷没有出现。"]),
    ("ja", ["「もう帰ろう。夜が来る。」と野は言った。", "谷は「村はない。」と答えた。", "待った…しかし戻らなかった。", "（後に移転した。）"]),
])
def test_spaceless_scripts(lang, sentences):
    text = "".join(sentences)
    assert [text[a:b] for a, b in units(text, lang)] == sentences


def test_thai_blanks():
    s = ["วัดนี้สร้างขึ้นใน พ.ศ. 2310 โดยสินงา", "เมืองนี้มีประชากร 33,261 คน และมีพื้นที่ 9.43 ตารางกิโลเมตร", "ดร. ขูเขียนถึงวัดในหน้า 50", "“ไปกันเถอะ เย็นแล้ว”พูกะกล่าว"]
    text = " ".join(s)
    assert [text[a:b] for a, b in units(text, "th")] == s


def test_structure():
    text = "One\nline. Two.\r\n\r\n== Head. Line ==\n* First. Second.\n*Third\n# \n\n[[A Jr. (x)|B Jr.]] went."
    assert [text[a:b] for a, b in units(text, "en")] == ["One\nline.", "Two.", "== Head. Line ==", "* First.", "Second.", "*Third", "#", "[[A Jr. (x)|B Jr.]] went."]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB1.!?…。」「“”\"()[]«» \n*=:;ก็ดर।é—'<>/")), max_size=80))
def test_units_hold_every_visible_character_once(text):
    last = 0
    for a, b in units(text):
        assert last <= a < b and not text[last:a].strip() and not text[a].isspace() and not text[b - 1].isspace()
        last = b
    assert not text[last:].strip()


def test_table(spark):
    rows = [(1, "Ann ran. Cat sat.", "en"), (1, "Ann ran. Cat sat.", "en"), (2, None, "en"), (3, "", None), (4, " \n ", None), (None, "X.", None), (5, "Word. " * 3000, None)]
    df = spark.createDataFrame(rows, "article_id long, doc string, unit_start string")
    got = {tuple(r) for r in sentence_units(df, "article_id", "doc").collect()}
    assert {g for g in got if g[0] == 1} == {(1, 0, 8), (1, 9, 17)} and {g[0] for g in got} == {1, 5} and len([g for g in got if g[0] == 5]) == 3000
    assert sentence_units(df.limit(0), "article_id", "doc").count() == 0


def cut_runs(text, wiki):
    lexicon = S.Lexicon(S.read_words())
    got = [text[a:z] for a, z in S.units(text, wiki, lexicon)]
    return got, lexicon.cut.cache_info().misses


@pytest.mark.parametrize(
    ("wiki", "text", "units"),
    [
        ("zhwiki", "人们等了很久……山谷再也没有出现。该寺庙很小。", 2),
        ("zhwiki", "你们去哪里了吗\n但是学校很小。", 2),  # no mark: a final particle, then an opening word
        ("zhwiki", "寺庙很大\n学校很小。", 1),
        ("jawiki", "人々は待った…しかし学校は戻らなかった。この灯台は古い。", 2),
        ("jawiki", "これは灯台です\nこの学校は古い。", 2),
        ("jawiki", "原カは「神社はない。」と答えた。", 1),
        ("thwiki", "ไปกันแล้วครับ และเมืองนี้มีประชากร", 2),  # a polite particle ends the statement before a joining word
        ("thwiki", "เมืองนี้มีประชากร และมีพื้นที่", 1),
    ],
)
def test_spaceless_scripts_are_cut_by_the_word_lattice(wiki, text, units):
    got, calls = cut_runs(text, wiki)
    assert len(got) == units and calls >= 2, (got, calls)


def test_lattice_words():
    lexicon = S.Lexicon(S.read_words())
    assert len(lexicon.known) > 700
    assert S.words("この灯台は", lexicon)[0] == "この" and S.words("", lexicon) == []
    small = S.Lexicon(frozenset({"ab", "abc", "cd", "d"}))
    assert S.words("abcd", small) in (["ab", "cd"], ["abc", "d"]) and S.words("xxabyy", small) == ["xx", "ab", "yy"] or S.words("xxabyy", small) == ["xxabyy"]


def test_cheapest_ends_equal_all_ways():
    """Against every subset of ends, on runs whose passing costs depend on the unit's beginning."""
    import itertools
    import random

    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 8)
        w = "x" * (3 * n + 3)
        cands = []
        for k in range(n):
            e = rng.choice([-6.0, -3.0, -1.0, 1.0, 2.0, 6.0])
            opening = rng.choice([-1, -1, 0, 3 * rng.randint(0, k)])
            cands.append((3 * (k + 1), e, rng.choice([-5.0, 4.0, 7.0]) if opening >= 0 else e, opening))

        def cost(ends):
            start, total = 0, 0.0
            for k, (end, e, own, opening) in enumerate(cands):
                x = own if opening >= 0 and opening == start else e
                total += max(0.0, -x) if k in ends else max(0.0, x)
                if k in ends:
                    start = end
            return total

        best = min(cost(set(c)) for m in range(n + 1) for c in itertools.combinations(range(n), m))
        got = S._shortest(cands, 0, w)
        sure = [k for k, c in enumerate(cands) if c[0] in got]
        assert cost(set(sure)) == best


def test_long_run_of_uncertain_places():
    w = "x" * 20_000
    cands = [(k, -2.0 if k < 9_000 else 1.0, -2.0 if k < 9_000 else 1.0, -1) for k in range(1, 10_000)]
    assert S._shortest(cands, 0, w) == list(range(9_000, 10_000))

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.functions import json_index as J
from loomgraph.operators import nested

VALUE = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda v: st.lists(v, max_size=4) | st.dictionaries(st.text(max_size=5), v, max_size=4), max_leaves=25)


def rebuild(ix, el):
    """The Python value of an element, from the index alone."""
    kind = ix.kind[el]
    if kind in (J.OPEN_OBJECT, J.OPEN_ARRAY):
        import numpy as np

        _, kids, _ = J.children(ix, np.array([ix.inner[el]]))
        if kind == J.OPEN_ARRAY:
            return [rebuild(ix, k) for k in kids]
        names = J.keys(ix, kids).to_pylist()
        return {n: rebuild(ix, k) for n, k in zip(names, kids, strict=True)}
    return json.loads(ix.data[ix.start[el] : ix.end[el]].tobytes())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.dictionaries(st.text(max_size=4), VALUE, max_size=4), min_size=1, max_size=4), st.booleans())
def test_every_value_is_found_again(records, spaced):
    lines = [json.dumps(r, ensure_ascii=spaced, indent=1 if spaced else None).encode("utf-8", "replace") + b" ,\n" for r in records]
    got = {}
    for numbers, part in J.pieces(lines):
        ix = J.index(numbers, part)
        _, el, _ = J.children(ix, ix.root)
        for line, c in zip(ix.line, ix.root, strict=True):
            import numpy as np

            _, kids, _ = J.children(ix, np.array([c]))
            got[int(line)] = {n: rebuild(ix, k) for n, k in zip(J.keys(ix, kids).to_pylist(), kids, strict=True)}
    want = {i: json.loads(x.rstrip(b" ,\n")) for i, x in enumerate(lines)}
    assert got == want


def test_broken_lines_are_no_records():
    good = b'{"id":"Q1","a":[1,{"b":"x\\"}]"}]}'
    bad = [b"{", b'{"a":1', b'{"a":1]', b'{"a" 1}', b'{"a":}', b'{"a":1,}', b'{"a":[1,,2]}', b'{"a":tru}', b'{"a":"x}', b'{"a":1}{"b":2}', b'{"a":1} x', b'{1:2}', b'{"a":[1:2]}', b'{"a":"x" "y"}', b'{"a":01}', b'{,}', b'{"a":"x\ny"}']
    for b in bad:
        for lines in ([b], [good, b, good]):
            ok = [int(x) for n, p in J.pieces(lines) if (ix := J.index(n, p)) is not None for x in ix.line]
            assert ok == [i for i, x in enumerate(lines) if x == good], (b, ok)


def dump(spark, lines):
    return spark.createDataFrame([(i, x, "extra", "Q9") for i, x in enumerate(lines)], "line_no long, json_line string, leaves string, qid string")


def claim(v, **more):
    return {"mainsnak": {"datavalue": {"value": v}}, **more}


def test_leaves_with_missing_levels_and_older_copies(spark):
    snak = lambda v: {"datavalue": {"value": v}}
    new = {"lastrevid": 9, "id": "Q1", "claims": {"P1": [None, 5, claim({"id": None, "time": "t"}), claim({"id": "Qé\""}, qualifiers={"P2": [snak({"id": "Qa"}), snak("no"), snak({"id": "Qb"})], "P3": 4}, references=[None, {"snaks": {"P4": [snak({"time": "y"})]}}])], "P5": {}, "P6": []},
           "sitelinks": {"enwiki": {"title": "A"}, "enwikiquote": {"title": "B"}, "dewiki": {"title": None}, "frwiki": 3}}
    old = {"id": "Q1", "claims": {"P1": [claim({"id": "Qold"})]}, "lastrevid": 8}
    bare = [{"id": "Q2", "lastrevid": 1, "claims": [], "sitelinks": None}, {"lastrevid": 1}, {"id": 7, "lastrevid": 1}]
    lines = ["[", json.dumps(new) + ",", json.dumps(old) + " , ", *map(json.dumps, bare), None, "", "{\"id\":\"Q3\"", "]"]
    recs = nested.records(dump(spark, lines)).cache()
    assert {r["qid"] for r in recs.collect()} == {"Q1", "Q2"}
    got = {tuple(r) for r in nested.leaf_rows(recs).collect()}
    assert got == {
        ("Q1", "main", "P1", 2, -1, "", -1, "t"), ("Q1", "main", "P1", 3, -1, "", -1, "Qé\""), ("Q1", "qualifier", "P1", 3, -1, "P2", 0, "Qa"), ("Q1", "qualifier", "P1", 3, -1, "P2", 2, "Qb"),
        ("Q1", "reference", "P1", 3, 1, "P4", 0, "y"), ("Q1", "sitelink", "enwiki", -1, -1, "", -1, "A"),
    }
    flat = nested.flat_tables(nested.records(dump(spark, lines), structure=True))
    assert {r["qid"] for r in flat["records"].collect()} == {r["qid"] for r in recs.collect()}
    assert {r["claim_id"] for r in flat["qualifiers"].collect()} <= {r["claim_id"] for r in flat["claims"].collect()}
    assert flat["reference_snaks"].join(flat["references"], "ref_id", "left_anti").count() == 0


def test_empty_table(spark):
    assert nested.records(dump(spark, [])).count() == 0

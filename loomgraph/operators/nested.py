"""Problem 5: deeply nested records as related flat tables, by structural indexing (functions/json_index.py).

The passes run in mapInArrow over (line number, line): parsing needs no shuffle, and each emitted row carries the numbers
that link it to its parents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import json_index as J

LEAF = "leaf_kind string, prop string, claim_no int, ref_no int, sub_prop string, sub_no int, leaf_text string"
LEAF_COLUMNS = [x.split()[0] for x in LEAF.split(", ")]
OBJECT, ARRAY = J.OPEN_OBJECT, J.OPEN_ARRAY


def _lines(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, J.Index]]:
    """(line numbers of the root objects, index) of each piece of a batch of (line_no, json_line)."""
    numbers = batch.column(0).to_numpy(zero_copy_only=False)
    raw = batch.column(1).cast(pa.binary()).to_pylist()
    for own, part in J.pieces(raw):
        ix = J.index(own, part)
        if ix is not None:
            yield numbers[ix.line], ix


def _ids(ix: J.Index) -> tuple[np.ndarray, np.ndarray]:
    """By root object: the element of its id, -1 unless that is a non-empty string; its lastrevid, the least integer if unusable."""
    el = J.field(ix, ix.root, b"id")
    e = np.maximum(el, 0)
    el = np.where((el >= 0) & (ix.kind[e] == J.QUOTE) & (ix.end[e] - ix.start[e] > 2), el, -1)
    rev_el = J.field(ix, ix.root, b"lastrevid")
    rev = np.full(len(rev_el), np.iinfo(np.int64).min)
    at = np.flatnonzero(rev_el >= 0)
    for i, t in zip(at, J.values(ix, rev_el[at]).to_pylist(), strict=True):
        try:
            rev[i] = int(t)
        except ValueError:
            pass
    return el, rev


def _id_or_time(ix: J.Index, holder: np.ndarray) -> np.ndarray:
    """By object container with a datavalue: the element of datavalue.value.id, else of .time; -1 where neither is non-null."""
    value = J.of_kind(ix, J.field(ix, J.of_kind(ix, J.field(ix, holder, b"datavalue"), OBJECT), b"value"), OBJECT)
    own, time = J.field(ix, value, b"id"), J.field(ix, value, b"time")
    out = np.where(J.is_null(ix, own), time, own)
    return np.where(J.is_null(ix, out), -1, out)


def _of_objects(ix: J.Index, containers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, element) of the entries of object containers; of a repeated key the last."""
    row, el, _ = J.children(ix, containers)
    last = J.last_of_key(ix, row, el)
    return row[last], el[last]


def _leaves(ix: J.Index, structure: bool = False) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """(root row, columns of LEAF) of all leaves of a piece; with structure also a row without text for each claim and each reference."""
    roots: list[np.ndarray] = []
    cols: dict[str, list] = {c: [] for c in LEAF_COLUMNS}

    def emit(kind: str, root, prop_el, claim_no, ref_no, sub_el, sub_no, leaf) -> None:
        n = len(root)
        roots.append(root)
        cols["leaf_kind"].append(pa.array([kind] * n, pa.string()))
        cols["prop"].append(J.keys(ix, prop_el))
        minus = np.full(n, -1, np.int32)
        cols["claim_no"].append(pa.array(claim_no.astype(np.int32) if claim_no is not None else minus))
        cols["ref_no"].append(pa.array(ref_no.astype(np.int32) if ref_no is not None else minus))
        cols["sub_prop"].append(J.keys(ix, sub_el) if sub_el is not None else pa.array([""] * n, pa.string()))
        cols["sub_no"].append(pa.array(sub_no.astype(np.int32) if sub_no is not None else minus))
        cols["leaf_text"].append(J.values(ix, leaf) if leaf is not None else pa.nulls(n, pa.string()))

    def snaks(kind: str, holder: np.ndarray, root, prop_el, claim_no, ref_no) -> None:
        """Rows of an object of arrays of snaks: holder has its container for each of the given parents."""
        r, el = _of_objects(ix, holder)
        row, snak, no = J.children(ix, J.of_kind(ix, el, ARRAY))
        leaf = _id_or_time(ix, J.of_kind(ix, snak, OBJECT))
        ok = leaf >= 0
        up = r[row[ok]]
        emit(kind, root[up], prop_el[up], claim_no[up], None if ref_no is None else ref_no[up], el[row[ok]], no[ok], leaf[ok])

    # claims: property -> array of statements
    prop_row, prop_el = _of_objects(ix, J.of_kind(ix, J.field(ix, ix.root, b"claims"), OBJECT))
    row, claim, claim_no = J.children(ix, J.of_kind(ix, prop_el, ARRAY))
    root, prop = prop_row[row], prop_el[row]
    statement = J.of_kind(ix, claim, OBJECT)
    leaf = _id_or_time(ix, J.of_kind(ix, J.field(ix, statement, b"mainsnak"), OBJECT))
    ok = leaf >= 0
    emit("main", root[ok], prop[ok], claim_no[ok], None, None, None, leaf[ok])
    if structure:
        at = statement >= 0
        emit("claim", root[at], prop[at], claim_no[at], None, None, None, None)
    snaks("qualifier", J.of_kind(ix, J.field(ix, statement, b"qualifiers"), OBJECT), root, prop, claim_no, None)
    up, ref, ref_no = J.children(ix, J.of_kind(ix, J.field(ix, statement, b"references"), ARRAY))
    group = J.of_kind(ix, ref, OBJECT)
    if structure:
        at = np.flatnonzero(group >= 0)
        emit("claim reference", root[up[at]], prop[up[at]], claim_no[up[at]], ref_no[at], None, None, None)
    held = J.of_kind(ix, J.field(ix, group, b"snaks"), OBJECT)
    snaks("reference", held, root[up], prop[up], claim_no[up], ref_no)
    # sitelinks: key -> object with a title
    row, el = _of_objects(ix, J.of_kind(ix, J.field(ix, ix.root, b"sitelinks"), OBJECT))
    named = _ends_with(ix, el, b"wiki")
    row, el = row[named], el[named]
    title = J.field(ix, J.of_kind(ix, el, OBJECT), b"title")
    ok = ~J.is_null(ix, title)
    emit("sitelink", row[ok], el[ok], None, None, None, None, title[ok])
    return np.concatenate(roots), {c: pa.concat_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in v]) for c, v in cols.items()}


def _ends_with(ix: J.Index, el: np.ndarray, tail: bytes) -> np.ndarray:
    """By element: its key ends with tail."""
    return pc.ends_with(J.keys(ix, el), tail.decode()).to_numpy(zero_copy_only=False).astype(bool)


def _leaf_batches(batches: Iterator[pa.RecordBatch], structure: bool = False) -> Iterator[pa.RecordBatch]:
    leaf_type = pa.list_(pa.struct([(c, pa.int32() if c in ("claim_no", "ref_no", "sub_no") else pa.string()) for c in LEAF_COLUMNS]))
    for batch in batches:
        for line_no, ix in _lines(batch):
            id_el, rev = _ids(ix)
            have = np.flatnonzero(id_el >= 0)
            if not len(have):
                continue
            root, cols = _leaves(ix, structure)
            order = np.argsort(root, kind="stable")
            struct = pa.StructArray.from_arrays([cols[c].take(pa.array(order)) for c in LEAF_COLUMNS], LEAF_COLUMNS)
            bounds = np.searchsorted(root[order], np.arange(len(ix.root) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), struct).cast(leaf_type)
            yield pa.RecordBatch.from_arrays(
                [J.values(ix, id_el[have]), pa.array(rev[have]), pa.array(line_no[have], pa.int64()), lists.take(pa.array(have))],
                ["qid", "rev", "line_no", "leaves"],
            )


def _candidates(lines: DataFrame, number: str, line: str) -> DataFrame:
    return lines.select(F.col(number).cast("long").alias("line_no"), F.col(line).alias("json_line")).where(F.col("json_line").startswith("{"))


def records(lines: DataFrame, number: str = "line_no", line: str = "json_line", structure: bool = False) -> DataFrame:
    """(qid, leaves array<struct<LEAF>>): the record of each id, which is the one with the highest lastrevid.

    Lines are parsed once; what is shuffled by id are the leaves of a line in one value, as older copies of an id must
    give way as a whole. Equal revisions go to the higher line number (they hold the same). Records without a
    string id are left out; a record without leaves is kept with an empty array. Null lines, other lines and cut-off ones
    give nothing, an empty table gives no rows, and further columns are ignored. With structure the leaves hold claims and references as well,
    as flat_tables wants them.
    """
    parsed = _candidates(lines, number, line).mapInArrow(partial(_leaf_batches, structure=structure), f"qid string, rev long, line_no long, leaves array<struct<{LEAF.replace(' string', ': string').replace(' int', ': int')}>>")
    return parsed.groupBy("qid").agg(F.max_by("leaves", F.struct("rev", "line_no")).alias("leaves"))


def leaf_rows(recs: DataFrame) -> DataFrame:
    """(qid, LEAF): one row per leaf of each record, linked to its parents by property and 0-based positions."""
    return recs.select("qid", F.explode("leaves").alias("l")).select("qid", *[f"l.{c}" for c in LEAF_COLUMNS])


def flat_tables(recs: DataFrame) -> dict[str, DataFrame]:
    """Records with their structure as related tables: records, claims (qid, prop, claim_no), under them qualifiers and references, and sitelinks.

    claim_id and ref_id link a child to its parents: qid/prop/claim_no and that with /ref_no. records has every record, claims every statement that is an
    object and references every reference that is one, whether or not they hold a leaf; main_text is null if the statement's own value is unusable.
    """
    rows = leaf_rows(recs)
    claim_id = F.concat_ws("/", "qid", "prop", "claim_no")
    of = lambda kind: rows.where(F.col("leaf_kind") == kind)
    own = rows.where("leaf_kind in ('claim', 'main')").withColumn("claim_id", claim_id)
    ref_id = F.concat_ws("/", claim_id, "ref_no")
    return {
        "records": recs.select("qid", F.size(F.filter("leaves", lambda x: x["leaf_kind"] == "claim")).cast("long").alias("n_claims")),
        "claims": own.groupBy("claim_id", "qid", "prop", "claim_no").agg(F.max("leaf_text").alias("main_text")),
        "qualifiers": of("qualifier").select(claim_id.alias("claim_id"), "sub_prop", "sub_no", "leaf_text"),
        "references": of("claim reference").select(claim_id.alias("claim_id"), "ref_no", ref_id.alias("ref_id")),
        "reference_snaks": of("reference").select(ref_id.alias("ref_id"), "sub_prop", "sub_no", "leaf_text"),
        "sitelinks": of("sitelink").select("qid", F.col("prop").alias("site"), F.col("leaf_text").alias("title")),
    }


def _link_batches(props: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line_no, ix in _lines(batch):
                id_el, rev = _ids(ix)
                have = np.flatnonzero(id_el >= 0)
                if not len(have):
                    continue
                claims = J.of_kind(ix, J.field(ix, ix.root, b"claims"), OBJECT)
                lists = []
                for p in props:
                    row, claim, _ = J.children(ix, J.of_kind(ix, J.field(ix, claims, p.encode()), ARRAY))
                    main = J.of_kind(ix, J.field(ix, J.of_kind(ix, claim, OBJECT), b"mainsnak"), OBJECT)
                    value = J.of_kind(ix, J.field(ix, J.of_kind(ix, J.field(ix, main, b"datavalue"), OBJECT), b"value"), OBJECT)
                    target = J.field(ix, value, b"id")
                    e = np.maximum(target, 0)
                    ok = (target >= 0) & (ix.kind[e] == J.QUOTE)
                    bounds = np.searchsorted(row[ok], np.arange(len(ix.root) + 1)).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(bounds), J.values(ix, target[ok])).take(pa.array(have)))
                yield pa.RecordBatch.from_arrays(
                    [J.values(ix, id_el[have]), pa.array(rev[have]), pa.array(line_no[have], pa.int64()), *lists], ["qid", "rev", "line_no", *props]
                )

    return run


def links(lines: DataFrame, props: list[str], number: str = "line_no", line: str = "json_line") -> DataFrame:
    """(qid, one array<string> for each property): mainsnak.datavalue.value.id of a record's claims, in array order."""
    schema = "qid string, rev long, line_no long, " + ", ".join(f"{p} array<string>" for p in props)
    parsed = _candidates(lines, number, line).mapInArrow(_link_batches(props), schema)
    best = parsed.groupBy("qid").agg(F.max(F.struct("rev", "line_no", *props)).alias("r"))
    return best.select("qid", *[f"r.{p}" for p in props])

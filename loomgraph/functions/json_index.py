"""Vectorised structural indexing of JSON lines with NumPy: no per-character and no per-record Python.

index(lines) builds, over many lines at once, the quote bitmap (escapes resolved by the parity of backslash runs), the
bracket and delimiter bitmaps outside strings, the nesting depth by prefix sums, and from a stable sort by depth the
elements of every container with their spans. Children and fields are then found by array arithmetic.

Which lines count: a line is a record if, after trailing blanks and commas are cut off, it starts with "{" and is one
complete JSON object: strings closed, brackets paired by kind, depth 0 reached only at the last byte, a key and a colon
before each value of an object and none in arrays, values present between delimiters, and bare words being numbers or
true, false and null. Anything else, cut-off lines included, is no record.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Between lines: a byte that no UTF-8 text has.
SEPARATOR = b"\xff"
#: What a byte is: 1 opening, 2 closing bracket, 3 comma, 4 colon, 5 quote, 6 end of a line; 0 anything else.
CLASS = np.zeros(256, np.uint8)
for _c, _v in ((b"{", 1), (b"[", 1), (b"}", 2), (b"]", 2), (b",", 3), (b":", 4), (b'"', 5), (SEPARATOR, 6)):
    CLASS[_c[0]] = _v
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 13, 32]] = True
BARE = re.compile(rb"(?:true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)")
#: Lines are indexed in pieces of about so many bytes, which bounds memory; one longer line is a piece of its own.
PIECE = 4 << 20

QUOTE, BACKSLASH, OPEN_OBJECT, OPEN_ARRAY = 34, 92, 123, 91


@dataclass
class Index:
    """Elements of all containers of a piece. Arrays run over elements; spans are [start, end) byte places in data."""

    data: np.ndarray
    line: np.ndarray  #: line of each root object
    root: np.ndarray  #: element range key of each root object: its container number
    first: np.ndarray  #: by container: its first element
    count: np.ndarray  #: by container: how many elements
    kind: np.ndarray  #: by element: first byte of the value
    start: np.ndarray
    end: np.ndarray
    key_start: np.ndarray  #: by element: the key without its quotes; 0, 0 in arrays
    key_end: np.ndarray
    inner: np.ndarray  #: by element: the container that is its value, -1 if none

    @cached_property
    def slashes(self) -> np.ndarray:
        return np.flatnonzero(self.data == BACKSLASH)

    @cached_property
    def escaped_keys(self) -> np.ndarray:
        """By element: its key has an escape."""
        return _has_slash(self, self.key_start, self.key_end)


def _forward(pos: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
    """pos moved over blanks, not beyond ends."""
    pos = pos.copy()
    todo = np.flatnonzero((pos < ends) & BLANK[data[np.minimum(pos, len(data) - 1)]])
    while len(todo):
        pos[todo] += 1
        p = pos[todo]
        todo = todo[(p < ends[todo]) & BLANK[data[np.minimum(p, len(data) - 1)]]]
    return pos


def _backward(pos: np.ndarray, starts: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Ends moved back over blanks, not before starts."""
    pos = pos.copy()
    todo = np.flatnonzero((pos > starts) & BLANK[data[np.maximum(pos - 1, 0)]])
    while len(todo):
        pos[todo] -= 1
        p = pos[todo]
        todo = todo[(p > starts[todo]) & BLANK[data[np.maximum(p - 1, 0)]]]
    return pos


def pieces(lines: list[bytes | None], limit: int = PIECE):
    """(numbers, trimmed lines) of candidate lines, in pieces of about limit bytes."""
    numbers, part, size = [], [], 0
    for i, x in enumerate(lines):
        if x is None or not x.startswith(b"{"):
            continue
        x = x.rstrip(b" ,\r\n\t")
        if size and size + len(x) > limit:
            yield numbers, part
            numbers, part, size = [], [], 0
        numbers.append(i)
        part.append(x)
        size += len(x)
    if part:
        yield numbers, part


def index(numbers: list[int], part: list[bytes]) -> Index | None:
    """The structural index of the records among part; None if there is none."""
    data = np.frombuffer(SEPARATOR.join(part) + SEPARATOR, np.uint8)
    lengths = np.fromiter(map(len, part), np.int64, len(part))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths

    # bitmaps of quotes, brackets, delimiters and line ends; a quote is escaped if an odd run of backslashes stands before it
    at = np.flatnonzero(CLASS[data])
    cls = CLASS[data[at]]
    quote = cls == 5
    slashes = np.flatnonzero(data == BACKSLASH)
    if len(slashes):
        run = np.flatnonzero(np.r_[True, np.diff(slashes) != 1])
        length = np.diff(np.r_[run, len(slashes)])
        after = (slashes[run] + length)[length & 1 == 1]
        hit = np.minimum(np.searchsorted(at, after), len(at) - 1)
        escaped = hit[(at[hit] == after) & quote[hit]]
        quote[escaped] = False
    quotes = at[quote]
    line_end = cls == 6
    quotes_before = np.cumsum(quote)  # at quotes themselves counted along; only used at other bytes
    line_of = np.cumsum(line_end)  # at line ends themselves counted along, likewise
    per_line = np.diff(np.r_[0, quotes_before[line_end]])
    before_line = np.r_[0, quotes_before[line_end][:-1]]
    ok = per_line & 1 == 0

    # tokens are the brackets and delimiters outside strings: an even number of the line's quotes stands before them
    token = (cls <= 4) & (((quotes_before - before_line[np.minimum(line_of, len(part) - 1)]) & 1) == 0)
    tokens, token_line, quotes_before, cls = at[token], line_of[token], quotes_before[token], cls[token]
    if not len(tokens):
        return None

    # nesting depth by prefix sums, starting anew on each line
    total = np.cumsum(np.where(cls == 1, 1, np.where(cls == 2, -1, 0)))
    n_tokens = np.bincount(token_line, minlength=len(part))
    line_last = np.cumsum(n_tokens) - 1
    line_first = line_last - n_tokens + 1
    ok &= n_tokens > 0
    base = np.where(line_first > 0, total[np.maximum(line_first - 1, 0)], 0)
    depth = total - base[token_line]
    level = depth + (cls == 2)  # of a closing bracket: that of its opening one
    last = np.maximum(line_last, 0)
    ok &= (depth[last] == 0) & (tokens[last] == ends - 1) & (tokens[np.minimum(line_first, len(tokens) - 1)] == starts)
    # depth 0 before the last token, or below 0 anywhere, makes two values or an unopened bracket
    ok &= np.bincount(token_line[depth <= 0], minlength=len(part)) == 1
    ok &= _no_control_bytes(data, quotes, before_line, ends)
    while True:
        keep = ok[token_line]
        if not keep.any():
            return None
        out, wrong = _elements(data, numbers, tokens[keep], token_line[keep], cls[keep], level[keep], quotes_before[keep], quotes)
        if not len(wrong):
            return out
        ok[wrong] = False  # lines that broke a rule of the grammar; the rest is built again without them


def _no_control_bytes(data: np.ndarray, quotes: np.ndarray, before_line: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """By line: no raw control byte stands within a string."""
    ok = np.ones(len(ends), bool)
    control = np.flatnonzero(data < 32)
    if len(control):
        line = np.searchsorted(ends, control)
        ok[line[(np.searchsorted(quotes, control) - before_line[line]) & 1 == 1]] = False
    return ok


def _elements(data, numbers, tokens, token_line, cls, level, quotes_before, quotes) -> tuple[Index | None, np.ndarray]:
    """The index of the given lines' tokens, or None and the lines that aren't JSON."""
    # A stable sort by depth puts each container's own tokens side by side: open, delimiters, close. Small integers are
    # sorted by radix, in linear time.
    if level.max() < 65_000:
        level = level.astype(np.uint16 if level.max() > 250 else np.uint8)
    order = np.argsort(level, kind="stable")
    pos, c, line = tokens[order], cls[order], token_line[order]
    byte = data[pos]
    opens, closes = c == 1, c == 2
    container = np.cumsum(opens) - 1  # by token: its container
    open_at = np.flatnonzero(opens)
    is_object = byte[open_at] == OPEN_OBJECT
    # within a depth a container ends where the next begins, and by the same kind of bracket
    bad = (closes != np.r_[opens[1:], True]) | (closes & (byte != byte[open_at][container] + 2))
    if bad.any():
        return None, np.unique(line[bad])

    at = np.flatnonzero(opens | (c == 3))  # each begins an element, unless the container is empty
    colon = c == 4
    nxt = at + 1
    with_colon = colon[nxt]
    owner = container[at]
    before_value = np.where(with_colon, nxt, at)  # the token before the value
    value_to = pos[nxt + with_colon]
    start = _forward(pos[before_value] + 1, value_to, data)
    end = _backward(value_to, start, data)
    empty = opens[at] & closes[nxt] & (start >= end)
    hurt = (is_object[owner] != with_colon) & ~empty  # a colon exactly in objects
    hurt |= colon[nxt + with_colon]  # two colons in one element
    hurt |= (start >= end) & ~empty

    def one_string(token: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """By span after a token: its first and last byte are the next two quotes."""
        k = quotes_before[order[token]]
        k1 = np.minimum(k + 1, len(quotes) - 1)
        return (k + 1 < len(quotes)) & (quotes[np.minimum(k, len(quotes) - 1)] == start) & (quotes[k1] == end - 1) if len(quotes) else np.zeros(len(start), bool)

    key_stop = np.where(with_colon, pos[nxt], pos[at] + 1)
    key_from = _forward(pos[at] + 1, key_stop, data)
    key_to = _backward(key_stop, key_from, data)
    hurt |= with_colon & ~one_string(at, key_from, key_to)
    kind = np.where(empty, 0, data[np.minimum(start, len(data) - 1)])
    text = kind == QUOTE
    hurt |= text & ~one_string(before_value, start, end)
    # a container as value: the token after is its opening bracket, and its closing one stands at the end
    number = np.full(len(tokens) + 1, -1, np.int64)
    number[order[open_at]] = np.arange(len(open_at))
    nested = (kind == OPEN_OBJECT) | (kind == OPEN_ARRAY)
    follower = order[before_value] + 1
    inner = np.where(nested, number[follower], -1)
    close_pos = pos[closes]  # one for each open, in the same order
    hurt |= nested & ((inner < 0) | (tokens[np.minimum(follower, len(tokens) - 1)] != start) | (close_pos[np.maximum(inner, 0)] != end - 1))
    bare = np.flatnonzero(~(text | nested | empty | hurt))
    if len(bare):
        hurt[bare[~_bare_ok(start[bare], end[bare], data)]] = True
    if hurt.any():
        return None, np.unique(line[at[hurt]])
    real = ~empty
    owner = owner[real]
    count = np.bincount(owner, minlength=len(open_at))
    roots = np.flatnonzero(level[order[open_at]] == 1)
    return Index(
        data, np.asarray(numbers, np.int64)[line[open_at[roots]]], roots, np.cumsum(count) - count, count, kind[real], start[real], end[real],
        np.where(with_colon, key_from + 1, 0)[real], np.where(with_colon, key_to - 1, 0)[real], inner[real],
    ), np.zeros(0, np.int64)


def _bare_ok(start: np.ndarray, end: np.ndarray, data: np.ndarray) -> np.ndarray:
    length = end - start
    ok = np.zeros(len(start), bool)
    # most bare words are short runs of digits or null: these are told by their bytes, the rest by a pattern
    first = data[start]
    digits = np.ones(len(start), bool)
    short = length <= 12
    for k in range(12):
        on = short & (k < length)
        b = data[np.minimum(start + k, len(data) - 1)]
        digits &= ~on | ((b >= 48) & (b <= 57))
    ok |= short & digits & ((first != 48) | (length == 1)) & (length > 0)
    rest = np.flatnonzero(~ok)
    raw = data.tobytes() if len(rest) > 200 else None
    seen: dict[bytes, bool] = {}
    for i in rest:
        w = raw[start[i] : end[i]] if raw is not None else data[start[i] : end[i]].tobytes()
        if w not in seen:
            seen[w] = bool(BARE.fullmatch(w))
        ok[i] = seen[w]
    return ok


def children(ix: Index, containers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of containers, element, position) of all elements of the given containers; -1 has none."""
    c = np.maximum(containers, 0)
    n = np.where(containers >= 0, ix.count[c], 0)
    row = np.repeat(np.arange(len(containers)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, ix.first[c][row] + place, place


def of_kind(ix: Index, elements: np.ndarray, opening: int) -> np.ndarray:
    """By element: the container that is its value if it is of that kind, else -1. Elements of -1 give -1."""
    e = np.maximum(elements, 0)
    return np.where((elements >= 0) & (ix.kind[e] == opening), ix.inner[e], -1)


def field(ix: Index, objects: np.ndarray, name: bytes) -> np.ndarray:
    """By object container: the element of that key, -1 if absent; the last one of repeated keys."""
    row, el, _ = children(ix, objects)
    hit = _key_is(ix, el, name)
    out = np.full(len(objects), -1, np.int64)
    out[row[hit]] = el[hit]
    return out


def _key_is(ix: Index, el: np.ndarray, name: bytes) -> np.ndarray:
    start, length = ix.key_start[el], ix.key_end[el] - ix.key_start[el]
    hit = length == len(name)
    cand = np.flatnonzero(hit)
    for k, b in enumerate(name):
        cand = cand[ix.data[start[cand] + k] == b]
    hit[:] = False
    hit[cand] = True
    if ix.escaped_keys.any():  # keys written with escapes
        for i in np.flatnonzero(ix.escaped_keys[el]):
            hit[i] = _unescape(ix.data[start[i] - 1 : ix.key_end[el[i]] + 1].tobytes()) == name.decode()
    return hit


def _has_slash(ix: Index, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """By span: there is a backslash in it."""
    if not len(ix.slashes):
        return np.zeros(len(start), bool)
    next_slash = np.r_[ix.slashes, len(ix.data)][np.searchsorted(ix.slashes, start)]
    return next_slash < end


def _unescape(quoted: bytes) -> str:
    """A JSON string's text. Lone surrogates, which no text column can hold, become U+FFFD."""
    try:
        s = json.loads(quoted, strict=False)
    except ValueError:
        s = quoted[1:-1].decode("utf-8", "replace")
    return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def texts(ix: Index, start: np.ndarray, end: np.ndarray, quoted: np.ndarray | bool = True) -> pa.Array:
    """The spans as an Arrow string array, copied by array arithmetic; spans within quotes have their escapes resolved."""
    start, length = start.astype(np.int64), (end - start).astype(np.int64)
    offsets = np.r_[0, np.cumsum(length)]
    at = np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])
    out = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(ix.data[at].tobytes()))
    slashed = np.flatnonzero(_has_slash(ix, start, start + length) & quoted)
    if len(slashed):
        values = out.to_pylist()
        for i in slashed:
            values[i] = _unescape(ix.data[start[i] - 1 : start[i] + length[i] + 1].tobytes())
        out = pa.array(values, pa.large_string())
    return out.cast(pa.string())


def keys(ix: Index, el: np.ndarray) -> pa.Array:
    return texts(ix, ix.key_start[el], ix.key_end[el])


def values(ix: Index, el: np.ndarray) -> pa.Array:
    """Values as text: strings without their quotes, everything else as it is written."""
    q = ix.kind[el] == QUOTE
    return texts(ix, ix.start[el] + q, ix.end[el] - q, q)


def is_null(ix: Index, el: np.ndarray) -> np.ndarray:
    """By element: absent (-1) or the bare word null."""
    e = np.maximum(el, 0)
    return (el < 0) | (ix.kind[e] == ord("n"))


def last_of_key(ix: Index, row: np.ndarray, el: np.ndarray) -> np.ndarray:
    """Which of an object's elements are the last of their key (row: the object's row); others are overwritten by it."""
    if not len(el):
        return np.ones(0, bool)
    length = ix.key_end[el] - ix.key_start[el]
    # neighbours by (row, length, first and last bytes) may be equal; only these few are compared as text
    code = np.zeros(len(el), np.uint64)
    for k in range(8):
        code = code * np.uint64(257) + np.where(k < length, ix.data[np.minimum(ix.key_start[el] + k, len(ix.data) - 1)], 0).astype(np.uint64)
        code += np.where(k < length, ix.data[np.maximum(ix.key_end[el] - 1 - k, 0)], 0).astype(np.uint64) << np.uint64(20)
    order = np.lexsort((np.arange(len(el)), code, row))
    same = (row[order][1:] == row[order][:-1]) & (code[order][1:] == code[order][:-1])
    out = np.ones(len(el), bool)
    slashed = ix.escaped_keys[el]
    look = set(order[1:][same]) | set(order[:-1][same])
    if slashed.any():
        look |= set(np.flatnonzero(np.isin(row, row[slashed])))
    seen: dict = {}
    for i in sorted(look):
        k = (row[i], _unescape(ix.data[ix.key_start[el[i]] - 1 : ix.key_end[el[i]] + 1].tobytes()))
        if k in seen:
            out[seen[k]] = False
        seen[k] = i
    return out

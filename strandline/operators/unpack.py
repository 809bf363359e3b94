"""Several values packed in one text field (problem 3).

The scanner works on the UTF-8 buffer of a whole Arrow batch with numpy masks: marks and blanks are found for all rows at once, quotes that
open where a value begins are paired with their ends by the parity of quote runs, delimiters outside quotes give the offsets of the values,
and these become a list array that is flattened with the ordinals of its parents. No loop runs over rows or bytes; one runs over the quoted
values of the row that has most, for all rows together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks that separate values, and blanks that may stand around a value. Tab and line break do both.
DELIMITERS = b",;|\t\n\r"
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\r\x0b\x0c")] = True
_DELIM = np.zeros(256, bool)
_DELIM[list(DELIMITERS)] = True
_DOUBLE, _SINGLE, _BACK = ord('"'), ord("'"), ord("\\")


def _spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(opening, closing) positions of all quoted values, and the row of each. start, end: each row's bytes; listed: it is a bracketed list."""
    n = len(buf)
    row_of = np.repeat(np.arange(len(start)), end - start)
    if len(row_of) != n:  # gaps between rows: look rows up instead
        row_of = np.searchsorted(start, np.arange(n), side="right") - 1
    is_quote = (buf == _DOUBLE) | (buf == _SINGLE)
    at = np.flatnonzero(is_quote)
    none = np.empty(0, np.int64)
    if not len(at):
        return none, none, none
    # the last byte before each position that is no blank; a quote opens if that is a delimiter or lies before the row
    solid = np.where(_BLANK[buf] & ~_DELIM[buf], -1, np.arange(n))
    before = np.concatenate(([-1], np.maximum.accumulate(solid)[:-1]))
    prev = before[at]
    opens = (prev < start[row_of[at]]) | _DELIM[buf[np.maximum(prev, 0)]]
    opener = at[opens]
    if not len(opener):
        return none, none, none

    # ends: in lists a quote without an odd number of backslashes before it; else the last quote of an odd run of equal quotes
    not_back = np.where(buf != _BACK, np.arange(n), -1)
    last_other = np.concatenate(([-1], np.maximum.accumulate(not_back)[:-1]))
    escaped = ((at - 1 - np.maximum(last_other[at], start[row_of[at]] - 1)) % 2 == 1) & listed[row_of[at]]
    close = np.full(len(opener), -1, np.int64)
    for mark in (_DOUBLE, _SINGLE):
        mine = np.flatnonzero(buf[opener] == mark)
        if not len(mine):
            continue
        same = at[(buf[at] == mark)]
        ends_listed = at[(buf[at] == mark) & ~escaped]
        # runs of the same quote: number within the run, from the run's first
        first = np.concatenate(([True], (np.diff(same) != 1) | (row_of[same[1:]] != row_of[same[:-1]])))
        run = np.cumsum(first) - 1
        run_start = np.flatnonzero(first)
        run_len = np.diff(np.append(run_start, len(same)))
        run_end = same[run_start + run_len - 1]
        o = opener[mine]
        in_list = listed[row_of[o]]
        # bracketed lists: the next quote that isn't escaped
        k = np.searchsorted(ends_listed, o, side="right")
        got = np.where(k < len(ends_listed), ends_listed[np.minimum(k, len(ends_listed) - 1)] if len(ends_listed) else n, n)
        # others: the quotes after the opener in its own run pair up; if one is left over it ends the value, else the next odd run does
        j = np.searchsorted(same, o)
        left = run_len[run[j]] - 1 - (j - run_start[run[j]])
        odd = np.flatnonzero(run_len % 2 == 1)
        nxt = np.searchsorted(odd, run[j], side="right")
        far = np.where(nxt < len(odd), run_end[odd[np.minimum(nxt, len(odd) - 1)]] if len(odd) else n, n)
        got = np.where(in_list, got, np.where(left % 2 == 1, run_end[run[j]], far))
        close[mine] = np.where(got < end[row_of[o]], got, -1)
    good = close >= 0  # a quote that is never closed is a character like others
    opener, close = opener[good], close[good]
    if not len(opener):
        return none, none, none

    # openers inside an earlier quoted value don't count: walk from value to value, all rows at once
    rows = row_of[opener]
    after = np.searchsorted(opener, close, side="right")
    taken = np.zeros(len(opener), bool)
    cur = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    while len(cur):
        taken[cur] = True
        nxt = after[cur]
        ok = nxt < len(opener)
        ok[ok] = rows[nxt[ok]] == rows[cur[ok]]
        cur = nxt[ok]
    return opener[taken], close[taken], rows[taken]


def split_values(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of all texts, and for each the number of its text. NULL, empty and blank texts have none; empty places have none.

    Values come without the marks and blanks around them. A quoted value is what was quoted: doubled quotes stand for one, and in a list in
    square brackets a backslash escapes as in JSON (a quote in apostrophes: as in a Python list). A quote that isn't closed, or that stands
    within a value, is a character of the value.
    """
    texts = texts.cast(pa.large_string()).combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts.cast(pa.large_string())
    texts = pc.utf8_trim_whitespace(pc.fill_null(texts, ""))
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    buf = buf[: off[-1]]
    start, end = off[:-1].copy(), off[1:].copy()
    if not len(buf) or not len(start):
        return pa.array([], pa.large_string()), np.empty(0, np.int64)
    full = end > start
    listed = np.zeros(len(start), bool)
    listed[full] = (buf[start[full]] == ord("[")) & (buf[end[full] - 1] == ord("]")) & (end[full] - start[full] > 1)
    start[listed] += 1
    end[listed] -= 1

    opened, closed, rows = _spans(buf, start, end, listed)
    # what lies between the quotes can't separate
    edge = np.zeros(len(buf) + 1, np.int32)
    np.add.at(edge, opened, 1)
    np.add.at(edge, closed + 1, -1)
    inside = np.cumsum(edge[:-1]) > 0
    cuts = np.flatnonzero(_DELIM[buf] & ~inside)
    row_of_cut = np.searchsorted(start, cuts, side="right") - 1
    # rows of no length share their start with the next row: the last of them is found, which is the one with bytes
    ok = (cuts >= start[row_of_cut]) & (cuts < end[row_of_cut])
    cuts, row_of_cut = cuts[ok], row_of_cut[ok]

    # child offsets: a value begins at its row's start or after a cut
    begin = np.concatenate((start, cuts + 1))
    parent = np.concatenate((np.arange(len(start)), row_of_cut))
    order = np.lexsort((begin, parent))
    begin, parent = begin[order], parent[order]
    last = np.append(parent[1:] != parent[:-1], True)
    stop = np.where(last, end[parent], np.append(begin[1:] - 1, 0))
    # blanks around a value: the first and the last byte that isn't blank
    n = len(buf)
    at = np.arange(n)
    from_left = np.append(np.minimum.accumulate(np.where(_BLANK[buf], n, at)[::-1])[::-1], n)
    from_right = np.concatenate(([-1], np.maximum.accumulate(np.where(_BLANK[buf], -1, at))))
    a, b = from_left[begin], from_right[stop] + 1
    keep = a < np.minimum(b, stop)
    a, b, parent = a[keep], b[keep], parent[keep]

    # quoted values: the value begins with an opening quote that closes at its end
    closing = np.full(n, -1, np.int64)
    closing[opened] = closed
    quoted = closing[a] == b - 1
    mark = buf[a].copy()
    a, b = a + quoted, b - quoted
    pieces = _slices(texts, a, b)
    out = pc.utf8_trim_whitespace(pieces) if not quoted.all() else pieces
    out = pc.if_else(pa.array(quoted), pieces, out)
    out = _unquoted(out, quoted, mark, listed[parent])
    some = pc.or_(pc.greater(pc.utf8_length(out), 0), pa.array(quoted))
    # a quoted empty text is an empty place as well
    some = pc.and_(some, pc.greater(pc.utf8_length(pc.utf8_trim_whitespace(out)), 0))
    sel = some.to_numpy(zero_copy_only=False)
    return out.filter(some), parent[sel]


def _slices(texts: pa.Array, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """The bytes a..b of the array's buffer, as texts: a list view of the bytes, copied into one buffer."""
    size = b - a
    off = np.concatenate(([0], np.cumsum(size)))
    src = np.frombuffer(texts.buffers()[2], np.uint8)
    take = np.arange(off[-1]) + np.repeat(a - off[:-1], size)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(src[take])))


def _unquoted(values: pa.Array, quoted: np.ndarray, mark: np.ndarray, listed: np.ndarray) -> pa.Array:
    """Values with the escapes of their quoting undone."""
    for q in '"', "'":
        mine = quoted & (mark == ord(q)) & ~listed
        if mine.any():
            values = pc.if_else(pa.array(mine), pc.replace_substring(values, q + q, q), values)
    if (quoted & listed).any():
        back = quoted & listed & pc.match_substring(values, "\\").to_numpy(zero_copy_only=False)
        if back.any():
            at = np.flatnonzero(back)
            fixed = pa.array([_unescape(v) for v in values.take(pa.array(at)).to_pylist()], pa.large_string())
            values = pc.replace_with_mask(values, pa.array(back), fixed)
    return values


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _unescape(v: str) -> str:
    """A list member with its backslash escapes undone, as in JSON and in Python's lists."""
    out, i = [], 0
    while (j := v.find("\\", i)) >= 0 and j + 1 < len(v):
        out.append(v[i:j])
        c = v[j + 1]
        width = {"u": 4, "x": 2, "U": 8}.get(c, 0)
        code = v[j + 2 : j + 2 + width]
        if width and len(code) == width and all(x in "0123456789abcdefABCDEF" for x in code):
            out.append(chr(int(code, 16)))
            i = j + 2 + width
        else:
            out.append(_ESCAPES.get(c, c))
            i = j + 2
    out.append(v[i:])
    # halves of a pair of surrogates, as JSON writes characters beyond the first plane
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def unpack(df: DataFrame, keep: list[str], packed: Column, pos: str = "pos", val: str = "val") -> DataFrame:
    """One row for each value of the text column ``packed``: the columns keep, its position from 1, the value.

    Texts that are NULL, empty or blank give no rows, as do empty places, which take no position. Works batch by batch without a shuffle.
    """
    src = df.select(*keep, packed.alias("_packed")).where(F.col("_packed").isNotNull())
    schema = T.StructType([*src.select(*keep).schema.fields, T.StructField(pos, T.LongType()), T.StructField(val, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, parent = split_values(batch.column("_packed"))
            # positions: the ordinal of a value among its parent's
            first = np.concatenate(([True], parent[1:] != parent[:-1])) if len(parent) else np.empty(0, bool)
            at = np.arange(len(parent))
            ordinal = at - np.maximum.accumulate(np.where(first, at, 0)) + 1 if len(parent) else at
            take = pa.array(parent)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(take) for c in keep), pa.array(ordinal, pa.int64()), values.cast(pa.string())], [*keep, pos, val]
            )

    return src.mapInArrow(run, schema)


def unpack_map(df: DataFrame, keep: list[str], payload: str, entries: list[str], field: str = "field") -> DataFrame:
    """unpack() of the named entries of a map column; ``field`` says the entry. NULL maps and missing entries give no rows."""
    each = F.explode(F.array(*(F.struct(F.lit(e).alias("f"), F.col(payload)[e].alias("p")) for e in entries)))
    rows = df.select(*keep, each.alias("_e")).select(*keep, F.col("_e.f").alias(field), F.col("_e.p").alias("_p")).where("_p IS NOT NULL")
    return unpack(rows, [*keep, field], F.col("_p"))

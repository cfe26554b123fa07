"""Splitting oversized documents into pieces of a bounded number of tokens at natural boundaries.

Content-defined: a rolling hash over token ids marks the landmark of each stretch in which a cut
may fall, and the cut snaps to the natural boundary nearest to it. Both depend on nothing but the
text around them, so an edit alters only the pieces near it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.bpe import encode, ranks, tokenizer_file

# Kinds of boundary, by preference.
CELL, PARAGRAPH, LINE, WORD, TOKEN = 4, 3, 2, 1, 0
_KINDS = ("token", "word", "line", "paragraph", "cell")
_CELLS = {
    "percent": re.compile(rb"^[ \t]*#[ \t]*%%", re.M),
    "export": re.compile(rb"^(?:In|Out)[ ]*\[[ \d*]*\]:", re.M),
    "ipynb": re.compile(rb'\{\s*"cell_type"\s*:'),
}
_FENCE = re.compile(rb"^```[^\n]*$", re.M)
#: Tokens of slack below the limit: a piece that starts within a word may encode to a few more by itself.
SLACK = 8
#: Tokens that the rolling hash covers.
ROLL = 8
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[*b" \t\n\r\x0b\x0c"]] = True


@lru_cache(maxsize=2)
def _lengths(path: str) -> np.ndarray:
    table = ranks(path)
    out = np.zeros(max(table.values()) + 1, dtype=np.int64)
    for piece, k in table.items():
        out[k] = len(piece)
    return out


def landmarks(ids: np.ndarray) -> np.ndarray:
    """Rolling hash of the ``ROLL`` tokens before each token edge."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    padded, out = np.concatenate((np.zeros(ROLL, np.uint64), mixed)), np.zeros(len(ids) + 1, np.uint64)
    for j in range(ROLL):
        out = out * np.uint64(0xD6E8FEB86659FD93) + padded[j : j + len(ids) + 1]
    return out ^ (out >> np.uint64(33))


def boundary_kinds(data: bytes, edges: np.ndarray, layout: str | None) -> np.ndarray:
    """The kind of boundary at each token edge (byte offsets), -1 inside a character.

    White space belongs to the boundary it makes: an edge beside or within white space has the kind of the whole
    run, by its line ends, or of the cell that starts behind it.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    blank = np.concatenate(([False], _BLANK[raw], [False]))
    flips = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = flips[::2], flips[1::2]
    line_end = (raw == 10) | ((raw == 13) & (np.concatenate((raw[1:], [0])) != 10))
    lines = np.concatenate(([0], np.cumsum(line_end)))
    breaks = lines[ends] - lines[starts]
    kind_of_run = np.where(breaks >= 2, PARAGRAPH, np.where(breaks == 1, LINE, WORD))
    at = [m.start() for m in _CELLS[layout].finditer(data)] if layout in _CELLS else []
    if layout == "export":
        fences = [m.end() for m in _FENCE.finditer(data)]
        at += fences[1::2]
    for p in at:
        # The run that ends at the cell's first character, or that starts where a fenced block is over.
        k = int(np.searchsorted(starts, p, side="right")) - 1
        if k >= 0 and ends[k] >= p:
            kind_of_run[k] = CELL
        elif k + 1 < len(starts) and starts[k + 1] == p:
            kind_of_run[k + 1] = CELL
    kinds = np.full(len(edges), TOKEN, dtype=np.int8)
    if len(starts):
        k = np.searchsorted(starts, edges, side="right") - 1
        beside = (k >= 0) & (edges <= ends[np.maximum(k, 0)])
        kinds[beside] = kind_of_run[k[beside]]
    inner = np.concatenate((raw, [0]))[edges]
    kinds[(inner & 0xC0) == 0x80] = -1
    return kinds


def cut_points(ids: np.ndarray, data: bytes, layout: str | None, path: str, limit: int, overlap: int, least: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Token indices of the cuts, the byte offsets of all token edges, and the kind at each edge."""
    edges = np.concatenate(([0], np.cumsum(_lengths(path)[ids])))
    kinds = boundary_kinds(data, edges, layout)
    marks, cuts, at, n = landmarks(ids), [], 0, len(ids)
    while n - at > limit - SLACK - (overlap if cuts else 0):
        low, high = at + least, at + limit - SLACK - (overlap if cuts else 0)
        places = np.arange(low, high + 1)
        whole = (kinds[places] >= 0) & (kinds[places - overlap] >= 0)
        if not whole.any():
            whole = kinds[places] >= 0
        if not whole.any():
            whole[:] = True
        best = kinds[places[whole]].max()
        natural = places[whole & (kinds[places] == best)]
        landmark = low + int(np.argmin(marks[low : high + 1]))
        at = int(natural[np.argmin(np.abs(natural - landmark))])
        cuts.append(at)
    return cuts, edges, kinds


def split_documents(
    df: DataFrame,
    key: str,
    text: str,
    layout: str | None = None,
    limit: int = 1024,
    overlap: int = 64,
    least: int = 384,
    path: str | None = None,
) -> DataFrame:
    """(key, piece_no, first_token, n_tokens, cut, text): the ordered pieces of every text of more than ``limit`` tokens.

    ``first_token`` and ``n_tokens`` are a piece's place among its document's tokens; successive pieces share
    ``overlap`` tokens, so a piece starts ``overlap`` tokens before the end of the one before. ``cut`` is the kind of
    boundary at its end: cell, paragraph, line, word, else token (never within a character), or end. The new tokens
    of each piece but the last number at least ``least``. Texts of at most ``limit`` tokens, empty and null
    texts give no rows. Whole texts are split where they are read, without a shuffle.
    """
    if not 0 <= overlap < least or least + overlap + SLACK > limit:
        raise ValueError("need overlap < least and least + overlap below the limit")
    path = path or tokenizer_file()
    kind = dict(df.dtypes)[key]
    # A token is at least a byte, so shorter texts need not be encoded.
    long_enough = df.where(F.octet_length(text) > limit).select(F.col(key).alias("k"), F.col(text).alias("t"), (F.col(layout) if layout else F.lit(None).cast("string")).alias("f"))
    names = [key, "piece_no", "first_token", "n_tokens", "cut", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for k, t, f in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids = encode(t, path)
                if len(ids) <= limit:
                    continue
                data = t.encode()
                cuts, edges, kinds = cut_points(ids, data, f, path, limit, overlap, least)
                start = 0
                for no, stop in enumerate([*cuts, len(ids)]):
                    while start > 0 and kinds[start] < 0:
                        start -= 1
                    piece = data[edges[start] : edges[stop]].decode("utf-8", "replace")
                    how = "end" if stop == len(ids) else _KINDS[max(0, kinds[stop])]
                    for column, v in zip(rows, (k, no, start, stop - start, how, piece)):
                        column.append(v)
                    start = stop - overlap
            kinds_of = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([x.as_py() if isinstance(x, pa.Scalar) else x for x in c], t) for c, t in zip(rows, kinds_of)], names)

    return long_enough.mapInArrow(run, f"`{key}` {kind}, piece_no int, first_token int, n_tokens int, cut string, text string")

"""Evaluation texts leaking into training text: which documents hold passages of which test items."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of items that one broadcast block holds at most; more items are scanned for block by block.
BLOCK_WORDS = 500_000
#: Lengths that seeds are rounded down to, so that a document's windows are hashed for a few lengths only.
SEED_LENGTHS = (1, 2, 3, 5, 7, 10, 14, 20, 28, 40, 56)
#: Characters of text that are hashed at a time.
SLICE_CHARS = 1_500_000

_MARKERS = {
    "percent": re.compile(r"^[ \t]*#[ \t]*%%[^\r\n]*", re.M),
    "export": re.compile(r"^[ \t]*(?:In|Out)[ \t]*\[[ \d*]*\]:?", re.M),
}
_ESCAPES = re.compile(r"\\(?:[ntrbf\"'\\/]|u[0-9a-fA-F]{4})")
_JSON_KEYS = re.compile(
    r'"(?:cell_type|metadata|source|outputs|output_type|execution_count|text|name|data|traceback|ename|evalue|kernelspec|nbformat|nbformat_minor|cells|text/plain|id)"\s*:'
    r'(?:\s*"(?:markdown|code|raw|stream|stdout|stderr|error|execute_result|display_data)")?'
)
_ODD = re.compile(r"[^\w\x00-\x7f]")
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*b"0123456789", *b"abcdefghijklmnopqrstuvwxyz"]] = True
_LETTER[128:] = True
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def _strings(x: object) -> Iterator[str]:
    """The strings of a JSON value, adjacent list items run together as notebooks mean them."""
    if isinstance(x, str):
        yield x
    elif isinstance(x, list):
        if all(isinstance(s, str) for s in x):
            yield "".join(x if any(s.endswith("\n") for s in x[:-1]) else [s + "\n" for s in x])
        else:
            for y in x:
                yield from _strings(y)
    elif isinstance(x, dict):
        for k, y in x.items():
            if k not in ("metadata", "cell_type", "output_type", "name", "kernelspec", "execution_count", "ename"):
                yield from _strings(y)


def plain_text(text: str, layout: str | None) -> str:
    """The text of a notebook without what its layout puts between words: cell markers and JSON writing."""
    if layout == "ipynb":
        try:
            return "\n".join(_strings(json.loads(text)["cells"]))
        except (ValueError, KeyError, TypeError, RecursionError):
            return _ESCAPES.sub(" ", _JSON_KEYS.sub(" ", text))
    if layout in _MARKERS:
        return _MARKERS[layout].sub(" ", text)
    return text


def normalised(text: str, layout: str | None = None) -> str:
    """Lower case text in which every run of letters and digits is a word and all else separates."""
    text = plain_text(text, layout)
    if "\\" in text:
        text = _ESCAPES.sub(" ", text)
    text = text.lower()
    return text if text.isascii() else _ODD.sub(" ", text)


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    """Powers 0..n-1 of an odd number, modulo 2 to the 64th."""
    if name not in _powers or len(_powers[name]) < n:
        p = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        p[0] = 1
        _powers[name] = np.multiply.accumulate(p)
    return _powers[name][:n]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word in UTF-8 bytes, without a loop over words."""
    inside = np.concatenate(([False], _LETTER[data], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("base", _BASE, len(data)), out=sums[1:])
    # The sum over a word, moved to the start of the text by the inverse power of its place.
    h = (sums[end] - sums[start]) * _power("inverse", _INVERSE, len(data) + 1)[start]
    return start, end, h ^ (h >> np.uint64(29))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of ``n`` words."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    size, out = len(words) - n + 1, np.zeros(len(words) - n + 1, dtype=np.uint64)
    for j in range(n):
        out = out * np.uint64(_STEP) + words[j : j + size]
    return out


def reaches(a: list, b: list, most: int) -> list[int]:
    """For k = 0..most: how many words of ``a`` from its start can be matched to a start of ``b`` with k words
    changed, dropped or added (furthest reaching points on diagonals)."""
    best: list[int] = []
    front = {0: -1}
    for k in range(most + 1):
        reached = {}
        for d in range(-k, k + 1):
            i = 0 if k == 0 else max(front.get(d, -2) + 1, front.get(d - 1, -2), front.get(d + 1, -2) + 1)
            j = i + d
            if i < 0 or j < 0 or i > len(a) or j > len(b):
                continue
            while i < len(a) and j < len(b) and a[i] == b[j]:
                i, j = i + 1, j + 1
            reached[d] = i
        best.append(max([*reached.values(), best[-1] if best else 0]))
        front = reached
    return best


def seed_words(length: int, share: float, edits: float) -> int:
    """How many successive words any sufficient passage of an item of ``length`` words must hold unchanged, by the
    pigeonhole principle."""
    least = length
    for size in range(max(1, int(np.ceil(length * share))), length + 1):
        k = int(size * edits)
        least = min(least, -(-(size - k) // (k + 1)))
    return max(1, least)


class Seeds:
    """The word windows of ``n`` words of the items whose seeds are so long, as sorted hashes with where each occurs."""

    def __init__(self, n: int, hashes: dict[int, np.ndarray]):
        self.n = n
        grams = {key: gram_hashes(h, n) for key, h in hashes.items()}
        every = np.concatenate([*grams.values(), np.zeros(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        self.grams = every[order]
        self.items = np.concatenate([np.full(len(g), key, np.int64) for key, g in grams.items()])[order]
        self.places = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams.values()])[order]
        self.sieve = np.zeros(1 << 22, dtype=bool)
        self.sieve[(self.grams >> np.uint64(42)).astype(np.int64)] = True

    def hits(self, words: np.ndarray, doc_of: np.ndarray) -> list[tuple[int, int, int]]:
        """(place in the text, item, place in the item) of every window that is wholly in one document."""
        grams = gram_hashes(words, self.n)
        at = np.flatnonzero(self.sieve[(grams >> np.uint64(42)).astype(np.int64)])
        at = at[doc_of[at] == doc_of[at + self.n - 1]]
        lo, hi = np.searchsorted(self.grams, grams[at], side="left"), np.searchsorted(self.grams, grams[at], side="right")
        return [(p, int(self.items[k]), int(self.places[k])) for p, a, b in zip(at.tolist(), lo.tolist(), hi.tolist()) for k in range(a, b)]


class Items:
    """Test items of one block, ready for scanning: their words, and the hash sets of their windows by length of seed."""

    def __init__(self, items: list[tuple[int, str]], share: float, edits: float):
        self.share, self.edits = share, edits
        self.words: dict[int, list[bytes]] = {}
        by_length: dict[int, dict[int, np.ndarray]] = defaultdict(dict)
        for key, text in items:
            data = np.frombuffer(normalised(text).encode(), dtype=np.uint8)
            start, end, h = word_hashes(data)
            raw = data.tobytes()
            if len(start):
                self.words[key] = [raw[s:e] for s, e in zip(start.tolist(), end.tolist())]
                own = seed_words(len(start), share, edits)
                by_length[max(n for n in SEED_LENGTHS if n <= own)][key] = h
        self.seeds = [Seeds(n, hashes) for n, hashes in sorted(by_length.items())]

    def passage(self, key: int, doc: list[bytes], seeds: list[tuple[int, int, int]]) -> tuple[int, int] | None:
        """(words, edits) of a sufficient passage of item ``key`` in ``doc``, of which ``seeds`` are (place in item, in
        doc, words) by their hashes. Seeds are compared word by word before they count."""
        item = self.words[key]
        most = int(len(item) * self.edits)
        runs: list[list[int]] = []
        for i, p, n in sorted(seeds, key=lambda s: (s[1] - s[0], s[0])):
            if item[i : i + n] != doc[p : p + n]:
                continue
            if runs and runs[-1][1] - runs[-1][0] == p - i and i <= runs[-1][2]:
                runs[-1][2] = i + n
            else:
                runs.append([i, p, i + n])
        for i, p, stop in sorted(runs, key=lambda r: r[0] - r[2]):
            size, reach = stop - i, len(item) + most
            left = reaches(item[:i][::-1], doc[max(0, p - reach) : p][::-1], most)
            right = reaches(item[stop:], doc[p + size : p + size + reach], most)
            for k in range(most + 1):
                covered = size + max(left[a] + right[k - a] for a in range(k + 1))
                if covered >= len(item) * self.share and k <= covered * self.edits:
                    return covered, k
        return None


def scan(items: Items, ids: list, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
    """(item, document, words, edits) over some documents' normalised texts."""
    joined = "\n".join(texts).encode()
    data = np.frombuffer(joined, dtype=np.uint8)
    start, end, h = word_hashes(data)
    ends = np.cumsum([len(t.encode()) + 1 for t in texts])
    doc_of = np.searchsorted(ends, start, side="right")
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
    for seeds in items.seeds:
        for p, key, i in seeds.hits(h, doc_of):
            found[int(doc_of[p]), key].append((i, p, seeds.n))
    for (d, key), seeds in found.items():
        margin = 2 * len(items.words[key]) + 8
        first, last = (int(x) for x in np.searchsorted(doc_of, [d, d + 1]))
        lo, hi = max(first, min(p for _, p, _ in seeds) - margin), min(last, max(p for _, p, _ in seeds) + margin)
        doc = [joined[s:e] for s, e in zip(start[lo:hi].tolist(), end[lo:hi].tolist())]
        if hit := items.passage(key, doc, [(i, p - lo, n) for i, p, n in seeds]):
            yield key, ids[d], *hit


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str,
    text: str,
    item_id: str,
    item_text: str,
    layout: str | None = None,
    share: float = 1 / 3,
    edits: float = 0.1,
) -> DataFrame:
    """(item_id, doc_id, words, edits): documents that hold an unbroken passage of at least ``share`` of an item's
    words in order, at most ``edits`` of them changed, dropped or added; one row per pair.

    The word windows of each item, as long as any sufficient passage of it must hold unchanged (rounded down to one of
    ``SEED_LENGTHS``), are broadcast as hash sets; each document's windows are looked up in it and every hit is verified by aligning actual words to
    both sides. Documents are scanned whole and never shuffled. Items come to the driver, as the query set, in
    blocks of at most ``BLOCK_WORDS`` words; each block is one scan. Null or empty documents and items without
    words match nothing; repeated documents are reported each.
    """
    spark = documents.sparkSession
    columns = [F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"), (F.col(layout) if layout else F.lit(None).cast("string")).alias("f")]
    source = documents.select(*columns).where("d is not null and t is not null and t <> ''")
    schema = "item_id long, doc_id long, words int, edits int"

    def one(block: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Items(block, share, edits))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                rows: list[tuple[int, int, int, int]] = []
                ids, texts, size = [], [], 0
                for d, t, f in zip(*(c.to_pylist() for c in batch.columns)):
                    ids.append(d)
                    texts.append(normalised(t, f))
                    size += len(texts[-1])
                    if size >= SLICE_CHARS:
                        rows += scan(known, ids, texts)
                        ids, texts, size = [], [], 0
                if ids:
                    rows += scan(known, ids, texts)
                if rows:
                    a, b, c, e = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int32()), pa.array(e, pa.int32())], ["item_id", "doc_id", "words", "edits"])

        return source.mapInArrow(run, schema)

    found, block, size = None, [], 0
    for key, body in items.select(F.col(item_id).cast("long"), item_text).where(F.col(item_text).isNotNull()).toLocalIterator():
        block.append((key, body))
        size += body.count(" ") + 1
        if size >= BLOCK_WORDS:
            found = one(block) if found is None else found.unionByName(one(block))
            block, size = [], 0
    if block or found is None:
        found = one(block) if found is None else found.unionByName(one(block))
    return found


def without_leaks(documents: DataFrame, leaks: DataFrame, doc_id: str) -> DataFrame:
    """The documents that hold no passage."""
    return documents.join(leaks.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")

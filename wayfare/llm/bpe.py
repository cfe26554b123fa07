"""Encoding texts by a public byte-level BPE tokenizer, and decoding.

Two encoders with the same result: :func:`encode_words` folds ranked merges inside Spark's
higher-order functions over distinct words, with the rank table as a literal; :func:`encode_texts`
encodes whole texts batch-wise in Arrow. The README gives figures for both.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.columns import let

#: Buckets of the literal rank table: a map literal is searched linearly, so each holds an entry or two.
BUCKETS = 1 << 16
#: Bytes up to which a word is folded in Spark; its work grows as the square. Longer words are encoded in Arrow.
FOLD_BYTES = 16
_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1c-\x1f]"
_NOT_SPACE = _SPACE.replace("[", "[^", 1)
#: The tokenizer's word pattern in Java's dialect.
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?" + _NOT_SPACE.replace("[^", r"[^\p{L}\p{N}", 1) + "+|" + _SPACE + "+(?!" + _NOT_SPACE + ")|" + _SPACE + "+"
)


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


def encode(text: str, path: str) -> np.ndarray:
    """Ids of one text."""
    return encoding(path).encode_to_numpy(text, disallowed_special=()).astype(np.int32)


def encode_texts(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids ARRAY<INT>): the ids of each text without special tokens, whose names in a text are ordinary
    text; the empty list for empty and null texts. Rows are encoded where they are read, without a shuffle."""
    path = path or tokenizer_file()
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, sizes = [], []
            for t in batch.column(1):
                ids = encode(t.as_py() or "", path)
                parts.append(ids)
                sizes.append(len(ids))
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def _table(entries: dict[str, int | str], kind: str) -> Column:
    """A literal lookup table: an array of small maps by the CRC of the key."""
    buckets: list[dict] = [{} for _ in range(BUCKETS)]
    for k, v in entries.items():
        buckets[zlib.crc32(k.encode()) % BUCKETS][k] = v
    return F.from_json(F.lit(json.dumps(buckets)), f"array<map<string,{kind}>>")


def _look_up(table: Column, key: Column) -> Column:
    bucket = F.get(table, (F.crc32(key) % BUCKETS).cast("int"))
    return F.element_at(bucket, key)


def fold_word(word: Column, table: Column) -> Column:
    """Ids of one word: starting from its bytes, the adjacent pair of the lowest rank is merged again and again."""
    rank = lambda x: _look_up(table, x)
    text = F.hex(F.encode(word, "UTF-8"))
    size = (F.length(text) / 2).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.substr(text, i * 2 + 1, F.lit(2)))

    def step(state: Column, _: Column) -> Column:
        # Merge the first of the pairs of the lowest rank; when no pair has a rank, the word is done.
        now = state["pieces"]

        def merge(ranked: Column) -> Column:
            lowest = F.array_min(ranked)
            at = F.array_position(ranked, lowest).cast("int")
            merged = F.concat(F.slice(now, 1, at - 1), F.array(F.concat(F.get(now, at - 1), F.get(now, at))), F.slice(now, at + 2, F.size(now)))
            return F.when(lowest.isNull(), F.struct(now.alias("pieces"), F.lit(True).alias("done"))).otherwise(
                F.struct(merged.alias("pieces"), F.lit(False).alias("done"))
            )

        pairs = F.transform(F.slice(now, 2, F.size(now)), lambda x, i: rank(F.concat(F.get(now, i), x)))
        return F.when(state["done"], state).otherwise(let(pairs, merge))

    start = F.struct(pieces.alias("pieces"), F.lit(False).alias("done"))
    folded = F.aggregate(F.sequence(F.lit(1), size), start, step)["pieces"]
    return let(rank(text), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(folded, rank)))


def encode_words(df: DataFrame, text: str, path: str | None = None) -> DataFrame:
    """(word, n, ids): the distinct words of all texts with their counts and ids.

    Words are split JVM-side and counted with map-side combining; only distinct words are moved. Words of at most
    ``FOLD_BYTES`` bytes are folded by higher-order functions, the few longer ones batch-wise. Null and empty texts
    have no words.
    """
    path = path or tokenizer_file()
    table = _table({k.hex().upper(): v for k, v in ranks(path).items()}, "int")
    words = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(WORDS), F.lit(0))).alias("word"))
    words = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    short = words.where(F.octet_length("word") <= FOLD_BYTES).select("word", "n", fold_word(F.col("word"), table).alias("ids"))
    long_ = words.where(F.octet_length("word") > FOLD_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encode(w, path).tolist() for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    return short.unionByName(long_.mapInArrow(run, "word string, n long, ids array<int>"))


def encode_in_row(text: Column, path: str | None = None) -> Column:
    """Ids of a text by folding its words where it stands, each distinct word of the text once: no word is moved. Null and
    empty texts give the empty list. The README has its figures beside those of the other forms."""
    table = _table({k.hex().upper(): v for k, v in ranks(path or tokenizer_file()).items()}, "int")
    words = F.coalesce(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))

    def ids(w: Column) -> Column:
        known = lambda d: F.transform(d, lambda x: fold_word(x, table))
        return let(F.array_distinct(w), lambda d: let(known(d), lambda k: F.flatten(F.transform(w, lambda x: F.get(k, (F.array_position(d, x) - 1).cast("int"))))))

    return let(words, ids)


def decode_ids(ids: Column, path: str | None = None) -> Column:
    """The text of a list of ids: the binary pieces of the ids, looked up in a literal, concatenated. Null ids give
    null, the empty list the empty text, an id that is not in the vocabulary null."""
    vocabulary = ranks(path or tokenizer_file())
    pieces = [None] * (max(vocabulary.values()) + 1)
    for k, v in vocabulary.items():
        pieces[v] = k.hex()
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    hexed = F.transform(ids, lambda i: F.get(table, i))
    whole = F.when(~F.exists(hexed, lambda x: x.isNull()), F.array_join(hexed, ""))
    return F.decode(F.unhex(whole), "UTF-8")

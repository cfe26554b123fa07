import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.llm import bpe, leakage
from wayfare.llm.leakage import leaked_items, without_leaks
from wayfare.llm.nearest import nearest_by_time
from wayfare.llm.pieces import split_documents
from wayfare.llm.runs import collapse_runs

DAY = 86_400_000_000


@pytest.mark.parametrize("group_rows", [40, 10_000])
def test_nearest_by_time(spark, group_rows):
    rng = random.Random(1)
    left = [(rng.choice(["a", "a", "b", None]), rng.randrange(0, 2_000_000_000) if k % 9 else None, k) for k in range(200)]
    left += [(u, t, k + 1000) for u, t, k in left[:20]]
    right = [(rng.choice(["a", "b", None]), rng.randrange(0, 2_000_000_000) if k % 9 else None, k) for k in range(400)]
    right += [("a", left[1][1] and left[1][1] + 3, 7000), ("a", left[1][1] and left[1][1] - 3, 7002), ("a", left[1][1] and left[1][1] - 3, 7001)]
    tol, want = 5_000_000, {}
    for u, t, k in left:
        near = [(abs(s - t), s, i) for w, s, i in right if w == u and None not in (u, t, s) and abs(s - t) <= tol]
        if near:
            want[k] = min(near)[2]
    cols = ("u", "t", "id")
    ddl = "u string, t long, id long"
    a, b = spark.createDataFrame(left, ddl), spark.createDataFrame(right, ddl)
    got = nearest_by_time(a, b, tol, cols, cols, group_rows=group_rows).collect()
    assert {r["left_id"]: r["right_id"] for r in got} == want and len(got) == len(want)
    assert nearest_by_time(a.limit(0), b, tol, cols, cols).count() == 0


def test_collapse_runs(spark):
    rng = random.Random(2)
    rows, t = [], 0
    for k in range(400):
        t += rng.choice([0, 50, 100, 200, 3600, 80_000]) * 1_000_000
        rows.append((rng.choice([1, 1, 1, 2]), k, rng.choice(["car", "Car ", '"car"', "bus", "?", None]), t, rng.choice([None, t - 10_000_000, t + 60_000_000, t + 2 * DAY])))
    rows += [(None, 900, "car", 1, 2), (3, 901, "car", None, 2), (4, 902, "bus", 5, None)]
    want, key = [], lambda s: "".join(c for c in (s or "").lower() if c.isalpha())
    for seq in (1, 2, 4):
        run = None
        for _, k, label, s, e in sorted((r for r in rows if r[0] == seq), key=lambda r: (r[3], r[1])):
            e = s if e is None else e
            if run and key(label) and run["key"] == key(label) and s <= run["e"] + 120_000_000:
                run.update(last=k, n=run["n"] + 1, e=max(run["e"], e))
            else:
                run = {"seq": seq, "key": key(label) or None, "first": k, "last": k, "n": 1, "s": s, "e": e}
                want.append(run)
    df = spark.createDataFrame(rows, "trip long, id long, label string, s long, e long")
    got = collapse_runs(df, "trip", "id", "label", "s", "e").collect()
    assert sorted((r["trip"], r["first_event"], r["last_event"], r["n"], r["key"] or "", r["start_us"], r["end_us"]) for r in got) == sorted(
        (w["seq"], w["first"], w["last"], w["n"], w["key"] or "", w["s"], w["e"]) for w in want
    )
    assert collapse_runs(df.limit(0), "trip", "id", "label", "s", "e").count() == 0


TEXTS = ["", None, "   ", "Hello  world\n\n\tdef f(x):\r\n    return x's 123", "naïve 漢字 🙂🙂 שלום", "<|endoftext|> is text", "a" * 300, " " * 500 + "x", "It's we'll I'd 5kg  　.", "\x1c\x1d x\x85y"]


def test_encode_and_decode(spark):
    path = bpe.tokenizer_file()
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k long, text string")
    rows = bpe.encode_texts(df, "k", "text").withColumn("back", bpe.decode_ids(F.col("ids"))).collect()
    assert {r["k"]: r["ids"] for r in rows} == {k: bpe.encoding(path).encode_ordinary(t or "") for k, t in enumerate(TEXTS)}
    assert {r["k"]: r["back"] for r in rows} == {k: t or "" for k, t in enumerate(TEXTS)}
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(bpe.tokenizer_file("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    assert all(r["ids"] == other.encode(TEXTS[r["k"]] or "", add_special_tokens=False).ids for r in rows)


def test_folded_words_equal_the_tokenizer(spark):
    path = bpe.tokenizer_file()
    df = spark.createDataFrame([(t,) for t in [*TEXTS, "xqzvbnm Zyxwvut 98765432109876 ###!!!??? ünïcödé"]], "text string")
    rows = bpe.encode_words(df, "text").collect()
    assert rows and all(r["ids"] == bpe.encoding(path).encode_ordinary(r["word"]) for r in rows)
    import public_tokenizers
    import regex

    words = [w for t in [*TEXTS, "xqzvbnm Zyxwvut 98765432109876 ###!!!??? ünïcödé"] if t for w in regex.findall(public_tokenizers.PATTERN, t)]
    assert {r["word"]: r["n"] for r in rows} == {w: words.count(w) for w in words}


ITEM = "Every Monday eight boats leave the harbour with quartz plates for the old printer who sells nine of them while by Thursday the falconer melts two hundred shelves and reaches the market before the gates close in winter"
OTHER = "A tailor from the northern valley trades six hundred copper mirrors on Tuesday and weighs four hundred paddles later because the ferryman hides seven felt chests worth many coins near the lighthouse"


def test_leaks(spark):
    w = ITEM.split()
    n = len(w)
    third = -(-n // 3)
    changed = w[:]
    changed[5] = "ships"
    docs = [
        (1, "intro " + ITEM.upper() + " outro", None),
        (2, "x " + " ".join(w[4 : 4 + third]) + " y", None),
        (3, "x " + " ".join(w[4 : 4 + third - 4]) + " y", None),
        (4, "# **" + "**\n# _".join(changed) + "_", None),
        (5, " ".join(x if k % 5 else "zzz" for k, x in enumerate(w)), None),
        (6, json.dumps({"cells": [{"cell_type": "markdown", "source": [" ".join(w[:20]) + "\n", " ".join(w[20:])]}]}), "ipynb"),
        (7, json.dumps({"cells": [{"cell_type": "code", "source": [" ".join(w[:9])], "outputs": []}, {"cell_type": "code", "source": " ".join(w[9:])}]}), "ipynb"),
        (8, "# %% [markdown]\n# " + " ".join(w[:8]) + "\n\n# %% In[4]\n# " + " ".join(w[8:16]), "percent"),
        (9, "In [3]:\n" + " ".join(w[:8]) + "\nOut[3]:\n" + " ".join(w[8:16]), "export"),
        (10, '{"cells": [ broken ' + "\\n".join(w), "ipynb"),
        (11, None, "ipynb"), (12, "", None), (13, "—".join(w), None), (1, "again " + ITEM, None), (15, ITEM + " " + OTHER, None), (16, "z " * 200_000, None),
    ]
    items = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, None), (4, "?!")], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string, layout string")
    found = leaked_items(df, items, "doc_id", "text", "item_id", "text", layout="layout")
    got = sorted((r["item_id"], r["doc_id"]) for r in found.collect())
    assert got == [(1, 1), (1, 1), (1, 2), (1, 4), (1, 6), (1, 7), (1, 8), (1, 9), (1, 10), (1, 13), (1, 15), (2, 15)]
    assert sorted(r["doc_id"] for r in without_leaks(df, found, "doc_id").collect()) == [3, 5, 11, 12, 16]
    assert leaked_items(df.limit(0), items, "doc_id", "text", "item_id", "text").count() == 0
    assert leaked_items(df, items.limit(0), "doc_id", "text", "item_id", "text").count() == 0


def test_passages_against_full_alignment():
    """The seed and extend search against edit distances of all stretches, on random texts of few words."""
    rng = random.Random(3)
    for _ in range(60):
        item = [rng.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(30)]
        doc = [rng.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(12)]
        part = item[(a := rng.randrange(0, 15)) : a + rng.randrange(8, 15)]
        for _ in range(rng.randrange(0, 3)):
            k = rng.randrange(len(part))
            part[k : k + 1] = rng.choice([[], ["qq"], [part[k], "qq"]])
        doc[6:6] = part
        want = False
        for i in range(len(item)):
            row = [0] * (len(doc) + 1)
            for j in range(i, len(item)):
                new = [row[0] + 1]
                for k in range(1, len(doc) + 1):
                    new.append(min(row[k - 1] + (item[j] != doc[k - 1]), row[k] + 1, new[-1] + 1))
                row = new
                size = j - i + 1
                want = want or (size * 3 >= len(item) and min(row) * 10 <= size)
        items = leakage.Items([(1, " ".join(item))], 1 / 3, 0.1)
        got = list(leakage.scan(items, [7], [" ".join(doc)]))
        assert bool(got) == want


def test_short_items_do_not_shorten_the_seeds_of_others():
    items = leakage.Items([(1, ITEM), (2, "three short words"), (3, "alone")], 1 / 3, 0.1)
    assert [(s.n, sorted(set(s.items.tolist()))) for s in items.seeds] == [(1, [2, 3]), (5, [1])]
    got = sorted(leakage.scan(items, [5, 6], ["not " + ITEM.lower(), "they are alone with three other things"]))
    assert [(k, d) for k, d, *_ in got] == [(1, 5), (2, 6), (3, 6)]


def test_a_seed_counts_only_if_its_words_match():
    items = leakage.Items([(1, ITEM)], 1 / 3, 0.1)
    words = [w.encode() for w in ITEM.lower().split()]
    assert items.passage(1, words, [(0, 0, 5)]) and items.passage(1, [b"zz"] * len(words), [(0, 0, 5)]) is None


def test_ids_folded_in_the_row(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS) if k not in (6, 7)], "k long, text string")
    rows = df.select("k", bpe.encode_in_row(F.col("text")).alias("ids")).collect()
    assert all(r["ids"] == bpe.encoding(bpe.tokenizer_file()).encode_ordinary(TEXTS[r["k"]] or "") for r in rows)


def test_queries_against_sql(spark):
    import os

    import duckdb

    from wayfare.llm import queries

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            con.execute(f"create view {name[:-8]} as select * from '{folder}/{name}'")
    for name, sql in queries.ORACLES.items():
        df, want = queries.QUERIES[name](spark, folder), con.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(str, want.fetchall())), name


def _piece_texts(rng, n):
    cells = []
    for k in range(n):
        cells.append(f"# %% In[{k}]\n" + "\n".join(" ".join(rng.choice(["alpha", "beta", "x = 3", "naïve", "🙂"]) for _ in range(12)) for _ in range(rng.randrange(2, 12))))
    return "\r\n\r\n".join(cells)


def test_pieces(spark):
    rng = random.Random(4)
    docs = [(1, _piece_texts(rng, 60), "percent"), (2, "0x9f" * 6000, None), (3, "🙂" * 3000, None), (4, "short", None), (5, None, None), (6, "", None), (7, "word " * 3000, None), (8, " " * 20000 + "x", None), (9, "a\n\n" * 4000, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, layout string")
    rows = split_documents(df, "doc_id", "text", layout="layout").collect()
    path, by = bpe.tokenizer_file(), {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece_no"])):
        by.setdefault(r["doc_id"], []).append(r)
    texts = {k: t for k, t, _ in docs}
    assert set(by) == {k for k, t in texts.items() if t and len(bpe.encode(t, path)) > 1024}
    for k, pieces in by.items():
        ids, at = bpe.encode(texts[k], path).tolist(), 0
        for r in pieces:
            assert r["n_tokens"] <= 1024 and r["first_token"] == (max(0, at - 64) if k != 3 else r["first_token"])
            assert len(bpe.encode(r["text"], path)) <= 1024
            at = r["first_token"] + r["n_tokens"]
        assert at == len(ids)
    assert {r["cut"] for r in by[1][:-1]} == {"cell"}
    assert {r["cut"] for r in by[7][:-1]} == {"word"}


def test_an_edit_alters_only_pieces_near_it(spark):
    rng = random.Random(5)
    text = _piece_texts(rng, 150)
    edited = text[:300] + " inserted words here " + text[300:]
    df = spark.createDataFrame([(1, text, "percent"), (2, edited, "percent")], "doc_id long, text string, layout string")
    rows = split_documents(df, "doc_id", "text", layout="layout").collect()
    a, b = ({r["text"] for r in rows if r["doc_id"] == k} for k in (1, 2))
    assert len(a) > 10 and len(a - b) == 1 and len(b - a) == 1  # the piece with the edit, and no other

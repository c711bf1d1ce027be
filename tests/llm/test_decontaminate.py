import random
import re

import pytest

from lexiloom.llm import decontaminate as D


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    found = {}
    for item, t in items:
        w = words(t)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(tuple(w[s : s + window]), set()).add(str(item))
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(k) for k in found}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in found:
                    hit |= set(range(s, s + n))
                    ids |= found[tuple(w[s : s + n])]
        out.append((i, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


def result(spark, df, items, window=D.WINDOW):
    table = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, id string")
    got = D.decontaminate(df, table, window=window).collect()
    return sorted(((r["id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=str)


@pytest.mark.parametrize("window,block", [(10, 200_000), (4, 7)])
def test_against_brute_force(spark, make, monkeypatch, window, block):
    monkeypatch.setattr(D, "BLOCK", block)
    rng = random.Random(window)
    word = lambda: rng.choice(["the", "OF", "a", "É", "é", "x9", "Zed", "ß"])
    text = lambda n: "".join(word() + rng.choice([" ", "-", ", ", "\n"]) for _ in range(n))
    items = [(k, text(rng.randrange(1, 25))) for k in range(12)] + [(50, None), (51, ""), (52, "the"), (53, "..."), (3, text(12))]
    docs = []
    for k in range(40):
        extra = rng.choice(items)[1] or ""
        docs.append((k, text(rng.randrange(0, 40)) + extra + " " + text(rng.randrange(0, 20))))
    docs += [(90, None), (91, ""), (92, "The"), (92, "The"), (93, "no such words here"), (None, "the of")]
    assert result(spark, make(docs), items, window) == brute(docs, items, window)


def test_empty_tables(spark, make):
    assert result(spark, make([(1, "a b")]), []) == [(1, 2, 0, [])]
    assert result(spark, make([]), [(1, "a b")]) == []


def test_no_python_in_the_plan(spark, make):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = D.decontaminate(make([(1, "a b c d")]), items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_items_with_a_null_id_count_hits(spark, make):
    docs = [(1, "x a b c y"), (2, "c a d"), (3, "b a b c"), (4, "d e f")]
    items = [(None, "a b c"), (None, "d"), (7, "b c"), (None, None)]
    assert result(spark, make(docs), items, 3) == [(1, 5, 3, ["7"]), (2, 3, 1, []), (3, 4, 3, ["7"]), (4, 3, 1, [])]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert {r["id"]: r["n_items"] for r in D.decontaminate(make(docs), table, window=3).collect()} == {1: 2, 2: 1, 3: 2, 4: 1}

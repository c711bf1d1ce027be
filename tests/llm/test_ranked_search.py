import math
import random
import re
from collections import Counter

import pytest

from lexiloom.llm import ranked_search as R


def words(text):
    plain = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain)


def brute(docs, items, k):
    bags = [(i, Counter(words(t)), len(words(t))) for i, t in docs]
    n_docs, total = sum(n > 0 for _, _, n in bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scored = []
        for i, bag, n in bags:
            score = 0
            for t in set(words(text)):
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 50 + (50 * n * n_docs) // total
                    score += w * ((1000000000 * bag[t]) // (1000 * bag[t] + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if gone else i, -s) for rank, (s, gone, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in rows], "item_id long, text string, row long, terms string, score double")


def got(found):
    return [tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()]


key = repr


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{n}é" if n % 7 == 0 else f"w{n}" for n in range(300)]
    pick = lambda n: " ".join(rng.choice(["", "", "A", "(", "x-"]) + vocabulary[int(300 * rng.random() ** 3)] for _ in range(n))
    docs = [(i, pick(rng.choice([1, 3, 10, 40, 200]))) for i in range(400)]
    docs += [(500 + i, docs[3][1]) for i in range(70)] + [(None, docs[3][1]), (None, "w1 w2"), (7, docs[3][1]), (7, docs[3][1])]
    docs += [(900, None), (901, ""), (902, " ..; "), (903, " ".join(vocabulary * 400))]
    items = [(i, pick(rng.choice([1, 5, 30]))) for i in range(25)]
    items += [(30, docs[3][1]), (31, None), (32, "..."), (33, "nowhere to be met"), (4, "w1 W1 w1"), (4, "w250"), (None, "w2 w299")]
    return docs, items


@pytest.mark.parametrize("k", [5, 50])
def test_against_brute_force(spark, make, corpus, k):
    docs, items = corpus
    assert sorted(got(R.ranked_search(make(docs).repartition(4), items_of(spark, items), k=k)), key=key) == sorted(brute(docs, items, k), key=key)


def test_small_blocks_runs_and_pieces(spark, make, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(R, "BLOCK", 60)
    monkeypatch.setattr(R, "CELLS", 50)
    monkeypatch.setattr(R, "PIECE", 16)
    assert sorted(got(R.ranked_search(make(docs).repartition(3), items_of(spark, items), k=7)), key=key) == sorted(brute(docs, items, 7), key=key)


def test_bounds_are_never_below_the_score_and_do_prune(corpus):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    weights = rng.integers(1, 9000, 60)
    items = R.Items([list(rng.choice(60, n, replace=False)) for n in (1, 2, 9, 30)], weights)
    terms = [np.sort(rng.choice(60, n, replace=False)) for n in rng.integers(1, 50, 80)]
    impacts = [rng.integers(1, 900_000, len(t)) for t in terms]
    norm = np.array([math.sqrt((weights[t] * i.astype(float) ** 2).sum()) for t, i in zip(terms, impacts, strict=True)])
    ids = np.arange(80)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.array(ids < 0), pa.array(norm), pa.array(ids), R._lists(terms, pa.int32()), R._lists(impacts, pa.int64())],
        ["id", "no_id", "norm", "bucket", "terms", "impacts"],
    )
    bounds = R._bounds(R._Run(batch, 0, 80, weights), items, np.arange(4))
    pruned = 0
    for i in range(4):
        own = set(items.terms[items.ends[i] : items.ends[i + 1]].tolist())
        for d in range(80):
            score = sum(int(weights[t]) * int(x) for t, x in zip(terms[d], impacts[d], strict=True) if t in own)
            assert bounds[i, d] * R.SLACK >= score
            pruned += bounds[i, d] < 0.8 * items.norm[i] * norm[d]
    assert pruned > 100


def test_ties_go_to_the_smaller_id(spark, make):
    docs = [(i, "same words here") for i in (9, 3, 12, 5)] + [(1, "other")]
    assert [r[2] for r in sorted(got(R.ranked_search(make(docs), items_of(spark, [(1, "same")]), k=3)))] == [3, 5, 9]


def test_empty_tables(spark, make):
    assert R.ranked_search(make([]), items_of(spark, [(1, "a")])).count() == 0
    assert R.ranked_search(make([(1, "a")]), items_of(spark, [])).count() == 0
    assert R.ranked_search(make([(1, None)]), items_of(spark, [(1, "a")])).count() == 0

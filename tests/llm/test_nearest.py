import math

import numpy as np
import pytest

from lexiloom.llm import nearest as N

SCHEMA = "vec_id long, embedding array<float>, label int, uid long, id string, code int, shard int, rank int, score double"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 1, "a", 2, 3, 4, 5.0) for i, v in rows], SCHEMA)


def brute(rows, k=5, every=50):
    kept = [(i, np.array(v, dtype=np.float32).astype(np.float64)) for i, v in rows]
    ids = np.array([i for i, _ in kept])
    m = np.array([v for _, v in kept])
    norms = np.sqrt((m * m).sum(axis=1))
    out = {}
    for n in np.flatnonzero(ids % every == 0):
        cosine = (m * m[n]).sum(axis=1) / (norms * norms[n])
        order = [x for x in np.lexsort((ids, -cosine)) if x != n][:k]
        out[int(ids[n])] = [(int(ids[x]), float(cosine[x])) for x in order]
    return out


def got(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert all([x[0] for x in rows] == list(range(1, len(rows) + 1)) for rows in out.values())
    return {q: [x[1:] for x in rows] for q, rows in out.items()}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(13)
    base = rng.normal(size=(3000, 64))
    base[2000:2600] = base[7] + rng.normal(size=(600, 64)) * 0.02  # a dense region
    base[2600:2640] = base[50]  # copies
    base[2700:2800] += 3  # a common direction
    return list(enumerate(base.tolist()))


def test_recall_and_exact_scores(spark, rows):
    found, right = got(N.nearest(vectors(spark, rows).repartition(4))), brute(rows)
    assert found.keys() == right.keys() and all(len(x) == 5 for x in found.values())
    for q, best in found.items():
        of = dict(brute([(q, rows[q][1]), *((i, rows[i][1]) for i, _ in best)], k=5)[q])
        assert all(abs(of[i] - s) < 1e-12 for i, s in best)
    hit = sum(len({i for i, _ in found[q]} & {i for i, _ in right[q]}) for q in right) / (5 * len(right))
    assert hit >= 0.95
    assert [i for i, _ in found[50]] == [2600, 2601, 2602, 2603, 2604]  # ties: the smaller ids


def test_shards_and_blocks_change_nothing(spark, rows, monkeypatch):
    one = got(N.nearest(vectors(spark, rows)))
    monkeypatch.setattr(N, "SHARD", 1024)
    monkeypatch.setattr(N, "QUERIES", 20)
    assert got(N.nearest(vectors(spark, rows))) == one


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (500, 4), dtype=np.uint8)
    codes[:200] = codes[0] ^ (1 << rng.integers(0, 8, (200, 4))).astype(np.uint8)
    index = N.Index(codes)
    for q in codes[::25]:
        apart = np.bitwise_count(codes ^ q).sum(axis=1)
        for r in range(33):
            assert index.within(q, r).tolist() == np.flatnonzero(apart <= r).tolist()


def test_rows_that_take_no_part(spark):
    good = [(0, [1, 0, 0]), (1, [1, 0.1, 0]), (2, [0, 1, 0]), (50, [1, 0, 0]), (50, [0, 0, 2]), (3, [-1, 0, 0])]
    bad = [(4, None), (5, []), (6, [0, 0, 0]), (7, [1, None, 0]), (8, [1, math.nan, 0]), (9, [math.inf, 0, 0]), (None, [1, 0, 0]), (10, [1, 0]), (100, None), (150, [0, 0, 0])]
    out = N.nearest(vectors(spark, good + bad)).collect()
    assert {r["query_id"] for r in out} == {0, 50} and all(r["vec_id"] in {0, 1, 2, 3, 50} for r in out)
    zero = [(r["rank"], r["vec_id"]) for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == 0]
    assert zero == [(1, 50), (2, 1), (3, 2), (4, 50), (5, 3)]  # all candidates, the other rows of one id among them
    assert sum(r["query_id"] == 50 for r in out) == 10


def test_empty_tables(spark):
    assert N.nearest(vectors(spark, [])).count() == 0
    assert N.nearest(vectors(spark, [(0, [1, 2])])).count() == 0
    assert N.nearest(vectors(spark, [(1, [1, 2]), (2, [2, 1])])).count() == 0

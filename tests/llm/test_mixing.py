from collections import Counter, defaultdict

import pytest

from lexiloom.llm import mixing as M


@pytest.mark.parametrize("quotas", [{"a": 1}, {"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 1}, {"x": 700, "y": 299, "z": 1}, {f"s{i}": i + 1 for i in range(20)}])
def test_a_period_deviates_by_less_than_a_block(quotas):
    slots = M.edf_period(quotas)
    period = sum(quotas.values())
    assert sorted(t for ts in slots.values() for t in ts) == list(range(period))
    for s, q in quotas.items():
        for j, t in enumerate(slots[s]):
            assert j * period // q <= t < -(-(j + 1) * period // q)
        placed = 0
        for t in range(period):
            placed += t in set(slots[s])
            assert abs(placed - (t + 1) * q / period) < 1


def mixed(df, **kw):
    return sorted(M.mix(df, **kw).collect(), key=lambda r: r["mix_position"])


def check(rows, counts, shares, block):
    assert [r["mix_position"] for r in rows] == list(range(sum(counts.values())))
    assert Counter(r["mix_source"] for r in rows) == counts
    slots = defaultdict(set)
    for r in rows:
        assert r["mix_release"] <= r["mix_slot"] < r["mix_deadline"]
        slots[r["mix_slot"]].add((r["mix_source"], r["mix_block"], r["mix_phase"]))
    order = [next(iter(slots[t])) for t in range(len(slots))]
    assert all(len(x) == 1 for x in slots.values())
    assert [r["mix_slot"] for r in rows] == sorted(r["mix_slot"] for r in rows)
    left = {s: -(-n // block) for s, n in counts.items()}
    at = 0
    while at < len(order):  # by brute force: in each phase, every source stays within a block of its weight
        phase, active = order[at][2], {s: shares[s] for s, n in left.items() if n}
        placed, t = Counter(), 0
        while at < len(order) and order[at][2] == phase:
            placed[order[at][0]] += 1
            left[order[at][0]] -= 1
            at, t = at + 1, t + 1
            for s, q in active.items():
                assert abs(placed[s] - t * q / sum(active.values())) < 1
        assert any(left[s] == 0 for s in active)


def test_blocks_follow_their_weights(make):
    counts = {"hot": 301, "b": 90, "c": 43, "": 5}
    rows = [(i, "t", "en", s or None) for s, n in counts.items() for i in range(n)]
    shares = {"hot": 5, "b": 3, "c": 2, "": 1}
    check(mixed(make(rows), shares=shares, block_docs=4), Counter(counts), shares, 4)
    smooth = M.smoothed_shares(counts)
    check(mixed(make(rows), block_docs=7), Counter(counts), smooth, 7)


def test_columns_repeats_and_empty_table(make):
    rows = mixed(make([(1, "x", "en", "a"), (1, "x", "en", "a"), (None, None, None, None)]), block_docs=1)
    assert len(rows) == 3 and rows[0]["n"] == 7 and rows[0]["mix_slot"] in (0, 1, 2)
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "None"]
    assert mixed(make([])) == []


def test_no_python_in_the_plan(make):
    plan = M.mix(make([(1, "x", "en", "a")]).select("doc_id", "source"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_numbering_is_spread_over_buckets(make, monkeypatch):
    monkeypatch.setattr(M, "LEAST_BUCKETS", 3)
    monkeypatch.setattr(M, "BUCKET_DOCS", 10)
    check(mixed(make([(i, "t", "en", "a") for i in range(95)]), block_docs=8), Counter({"a": 95}), {"a": 1}, 8)


def test_many_sources_share_a_place(make, monkeypatch):
    monkeypatch.setattr(M, "MOST_SOURCES", 4)
    rows = [(k, "x", "en", f"s{k % 20 if k < 200 else k % 3}") for k in range(500)]
    got = M.mix(make(rows)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(500)) and sorted(r["mix_position"] for r in got) == list(range(500))
    assert {r["mix_source"] for r in got} == {"s0", "s1", "s2", M.OTHERS}
    kept = {r["mix_source"] for r in M.mix(make(rows), {"s7": 2, "s0": 1}).collect()}
    assert {"s7", "s0", M.OTHERS} <= kept and len(kept) == 4


def test_every_source_with_a_target_keeps_it(make, monkeypatch):
    monkeypatch.setattr(M, "MOST_SOURCES", 8)
    rows = [(i, "t", "en", f"s{i % 60:02}") for i in range(600)]
    shares = {f"s{k:02}": 1 + (99 if k == 59 else k % 5) for k in range(40, 60)}
    got = M.mix(make(rows), shares, block_docs=1).collect()
    named = {r["mix_source"] for r in got}
    assert named >= set(shares) and M.OTHERS in named and len(got) == 600
    first = sorted(got, key=lambda r: r["mix_position"])[:100]
    assert sum(r["mix_source"] == "s59" for r in first) >= 10  # all of it, as its weight is most of the sum
    assert {r["mix_source"] for r in M.mix(make([(i, "t", "en", f"s{i % 300}") for i in range(600)]), {f"s{k}": 1 for k in range(300)}).collect()} == {f"s{k}" for k in range(300)}


def test_rows_without_an_id_fill_many_buckets(make, monkeypatch):
    monkeypatch.setattr(M, "LEAST_BUCKETS", 16)
    rows = M.mix(make([(None, f"text {i}", "en", "a") for i in range(400)])).collect()
    assert sorted(r["mix_position"] for r in rows) == list(range(400))
    hashed = make([(None, f"text {i}", "en", "a") for i in range(400)])
    assert hashed.select(M.F.pmod(M.F.xxhash64(*hashed.columns), M.F.lit(16))).distinct().count() == 16

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lexiloom.llm import suffix_dedup as S


def brute(rows, length):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in raws for k in range(len(b) - length + 1))
    out = []
    for i, b in raws:
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        kept = hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()
        out.append((i, len(b), int(gone.sum()), spans, kept))
    return sorted(out, key=str)


def result(df):
    got = S.suffix_dedup(df).collect()
    return sorted(((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str)


@pytest.fixture
def small(monkeypatch):
    for name, value in {"LENGTH": 40, "K": 4, "SPAN": 12}.items():
        monkeypatch.setattr(S, name, value)


def texts(seed):
    rng = random.Random(seed)
    alphabet = "abcdé "
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    passages = [text(rng.randrange(30, 90)) for _ in range(5)]
    out = []
    for _ in range(40):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts += [text(rng.randrange(0, 60)), rng.choice(passages)[rng.randrange(10) :]]
        out.append("".join(parts))
    out += ["a" * 200, "a" * 39, "a" * 41, "ab" * 60, "ab" * 60 + "c", out[0], out[1], out[1], None, "", text(5000)]
    return list(enumerate(out))


@pytest.mark.parametrize("packing,call", [(1_000_000, 2_000_000), (200, 300)])
def test_against_brute_force(make, small, monkeypatch, packing, call):
    monkeypatch.setattr(S, "PACKING", packing)
    monkeypatch.setattr(S, "CALL_STRINGS", call)
    rows = texts(call)
    assert result(make(rows)) == brute(rows, 40)


def test_production_length(make, prose):
    rows = [*prose, (800, prose[0][1] * 3), (801, "x" * 1000), (802, "y" * 400), (803, "y" * 399)]
    assert result(make(rows)) == brute(rows, 400)


def test_shorter_passages_are_counted(make):
    """Passages of 60 words (under 400 bytes) in several texts, and texts that share nothing."""
    rng = random.Random(17)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passages = [text(60)[:390] for _ in range(10)]
    rows = [(k, f"{text(60)} {passages[k // 2]} {text(60)}") for k in range(20)] + [(k, text(180)) for k in range(20, 40)]
    got = {r["id"]: r for r in S.suffix_dedup(make(rows)).collect()}
    assert sum(got[k]["n_passages"] > 0 for k in range(20)) >= 19 and not any(got[k]["n_passages"] for k in range(20, 40))
    assert not any(r["n_removed"] for r in got.values())


def test_many_copies(make):
    long, short = "word " * 100, "few words"
    rows = [(k, long) for k in range(300)] + [(k, short) for k in range(300, 500)]
    assert result(make(rows)) == brute(rows, 400)


def test_repeated_ids_and_empty_table(make, small):
    rows = [(1, "q" * 3 + "".join(map(str, range(60))))] * 2 + [(None, "short")]
    assert result(make(rows)) == brute(rows, 40)
    assert result(make([])) == []


def test_sliding_minima():
    rng = np.random.default_rng(3)
    for n, span in [(12, 12), (50, 12), (300, 7)]:
        key = rng.permutation(n).astype(np.uint64)
        assert S.sliding_argmin(key, span).tolist() == [min(key[i : i + span]) for i in range(n - span + 1)]

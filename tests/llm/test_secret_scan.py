import base64
import bz2
import gzip
import re
import urllib.parse
import zlib

import pytest

from lexiloom.llm import secret_scan as S

PLAIN = 'password = "hunter2hunter2"'


def found(text):
    base, every = S.find_secrets(text)
    return [text[lo:hi] for lo, _, hi in base], [text[lo:hi] for lo, _, hi in every]


def b64(x):
    return base64.b64encode(x).decode()


@pytest.mark.parametrize(
    "hidden",
    [
        urllib.parse.quote(PLAIN),
        urllib.parse.quote(urllib.parse.quote(PLAIN)),
        "".join(f"\\u{ord(c):04x}" for c in PLAIN),
        b64(PLAIN.encode()),
        b64(b64(PLAIN.encode()).encode()),
        b64(gzip.compress(PLAIN.encode())),
        b64(zlib.compress(b64(bz2.compress(urllib.parse.quote(PLAIN, safe="").encode())).encode())),
        b64(PLAIN.encode()).replace("=", "%3D"),
    ],
)
def test_layers_are_unwrapped_to_the_place_they_came_from(hidden):
    text = f"é before {hidden} after"
    base, every = found(text)
    assert base == [] and len(every) == 1
    assert every[0] in text[9:-6] and len(every[0]) >= len(hidden) - 6


def test_base_kinds():
    text = f"{PLAIN} Api_Key:'abcdefgh' token=short AKIAABCDEFGHIJKL AKIAshort {'0af' * 11} {'a' * 31} secret = x"
    base, every = found(text)
    assert base == ['password = "hunter2hunter2', "Api_Key:'abcdefgh", "AKIAABCDEFGHIJKL", "0af" * 11] == every


def test_base_by_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = rows.select("doc_id", "text", S.secret_spans(rows).alias("s")).collect()
    patterns = [
        (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
        (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    ]
    for r in got:
        spans = sorted(
            (m.start(), k, m.end()) for k, (p, ok) in enumerate(patterns) for m in re.finditer(p, r["text"], re.ASCII) if ok(m)
        )
        assert r["s"]["base"] == S.joined(spans)
        assert (r["s"]["n_assign"], r["s"]["n_access"], r["s"]["n_hex"]) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))


def test_cycles_bombs_and_junk_end():
    bomb = b64(zlib.compress(b"a" * 50_000_000))
    for text in (bomb, "%" * 9999, "%25" * 500 + "41", "\\u" * 500, "A" * 100_000, "\\ud800\\udc00 \\ud800", "%ff%fe", None, ""):
        S.find_secrets(text)


def test_spans_count_code_points(make):
    docs = make([(1, "😀é secret=abcdefgh"), (2, None), (1, "😀é secret=abcdefgh")])
    got = [r["s"] for r in docs.select(S.secret_spans(docs).alias("s")).collect()]
    assert got[0]["base"] == got[0]["spans"] == "assign:3:18" == got[2]["base"]
    assert (got[1]["n_assign"], got[1]["base"], got[1]["spans"]) == (0, "", "")


def lines_of(run, width=76):
    return "\n".join(run[i : i + width] for i in range(0, len(run), width))


@pytest.mark.parametrize(
    "hidden",
    [
        b64(gzip.compress(b"nothing here") + gzip.compress(PLAIN.encode())),
        b64(bz2.compress(b"nothing here") + bz2.compress(PLAIN.encode())),
        *(b64(f"Prix{c} {PLAIN}".encode()) for c in "\u00a0\u202f\ufeff\u00ad\u200b\f\0"),
        lines_of(b64(b"-" * 53 + PLAIN.encode())),
        lines_of(b64(b"-" * (57 * 3 - 4) + PLAIN.encode())).replace("\n", "\r\n"),
        b64(gzip.compress(b"a " * (S.MAX_LAYER // 2 - 10) + "\u00e9".encode() * 20 + b" " + PLAIN.encode())),
    ],
)
def test_layers_are_read_whole(hidden):
    text = f"before {hidden} after"
    base, every = found(text)
    assert base == [] and every and all(e in hidden for e in every)
    assert {k for _, k, _ in S.find_secrets(text)[1]} == {0}


def test_pieces_of_a_long_layer_share_characters(monkeypatch):
    monkeypatch.setattr(S, "MAX_LAYER", 1000)
    monkeypatch.setattr(S, "OVERLAP", 100)
    monkeypatch.setattr(S, "_STEP", 64)
    for n in range(900, 1100, 7):
        assert len(found(f"x {b64(gzip.compress(b'a ' * n + PLAIN.encode() + b' b' * 700))} y")[1]) == 1


@pytest.mark.parametrize("codec", ["utf-16", "utf-16-le", "utf-16-be"])
@pytest.mark.parametrize("wrap", [lambda b: b, gzip.compress])
def test_layers_in_two_byte_characters(codec, wrap):
    text = f"before {b64(wrap(('Für alle: ' + PLAIN).encode(codec)))} after"
    assert {k for _, k, _ in S.find_secrets(text)[1]} == {0} and S.find_secrets(text)[0] == []


def test_empty_table_and_repeated_rows_with_layers(make):
    hidden = f"é {b64(gzip.compress(PLAIN.encode()))} end"
    docs = make([(1, hidden), (1, hidden), (None, hidden), (2, "")])
    got = [r["s"]["spans"] for r in docs.select(S.secret_spans(docs).alias("s")).collect()]
    assert got[0] == got[1] == got[2] != "" and got[3] == ""
    empty = docs.limit(0)
    assert empty.select(S.secret_spans(empty).alias("s")).count() == 0


def test_very_long_texts():
    text = "word and more words " * 250_000
    at = 3_000_000
    text = text[:at] + f" {urllib.parse.quote(PLAIN)} " + text[at:]
    base, every = S.find_secrets(text)
    assert base == [] and len(every) == 1 and at <= every[0][0] < every[0][2] <= at + 60


@pytest.mark.parametrize("before", ["/v1/", "/tokens/", "a_", "x-", "abcd/", "https://h.io/abc/", "k=ab/", "id+", "a/b/c/d/e/", "abcdefg-"])
@pytest.mark.parametrize("behind", ["", "/end", "-x_y", "/x?y=1"])
def test_runs_behind_and_before_other_characters(before, behind):
    for inner in (PLAIN.encode(), gzip.compress(b"x " * 40 + PLAIN.encode()), zlib.compress(PLAIN.encode())):
        text = f"see {before}{b64(inner).rstrip('=')}{behind} there"
        base, every = S.find_secrets(text)
        assert base == [] and every and all(4 <= lo < hi <= len(text) - 6 for lo, _, hi in every)


def wrapped(rng, text):
    """One layer around a text, as somebody would wrap it."""
    way = rng.randrange(6)
    if way == 0:
        return urllib.parse.quote(text, safe="")
    if way == 1:
        return "".join(f"\\u{ord(c):04x}" for c in text)
    raw = text.encode()
    raw = [raw, gzip.compress(raw), zlib.compress(raw), bz2.compress(raw)][way - 2]
    return rng.choice([b64, lambda x: base64.urlsafe_b64encode(x).decode()])(raw)


def plain_unwrapped(text):
    """All texts in a text, by trying every decoder on every word, without places: a plain second reader."""
    found, work = set(), [text]
    while work:
        t = work.pop()
        if t in found:
            continue
        found.add(t)
        work += [urllib.parse.unquote(t), re.sub(r"\\u([0-9a-f]{4})", lambda m: chr(int(m[1], 16)), t)]
        for word in re.findall(r"[A-Za-z0-9+/_=-]{16,}", t):
            try:
                raw = base64.b64decode(word.replace("-", "+").replace("_", "/") + "==")
            except ValueError:
                continue
            for opened in (lambda x: x, gzip.decompress, zlib.decompress, bz2.decompress):
                try:
                    work.append(opened(raw).decode())
                except (OSError, ValueError, EOFError, zlib.error):
                    continue
    return found


def test_random_nestings_against_a_plain_unwrapper():
    import random

    rng = random.Random(9)
    for _ in range(150):
        hidden = rng.choice([PLAIN, "token: abcdefgh1", "AKIAABCDEFGHIJKL", "0af1" * 9, "nothing here at all"])
        text = hidden
        for _ in range(rng.randrange(4)):
            text = rng.choice(["", "some words ", "é "]) + wrapped(rng, text) + rng.choice(["", " and more", "\n"])
        kinds = {k for t in plain_unwrapped(text) for _, k, _ in S.scan(t)}
        base, every = S.find_secrets(text)
        assert {k for _, k, _ in every} >= kinds and set(base) <= set(every)
        assert all(0 <= lo < hi <= len(text) for lo, _, hi in every)


def test_long_runs_take_linear_time_and_bombs_bounded_memory():
    import time
    import tracemalloc

    noise = base64.b64encode(bytes(range(256)) * 2000).decode()
    began = time.perf_counter()
    for text in (f"x {noise}", "x " + "a-b_c/d+" * 30_000, "x " + b64(PLAIN.encode()).rstrip("=") + "/" * 50_000):
        S.find_secrets(text)
    assert time.perf_counter() - began < 20
    packer = zlib.compressobj(9)
    bomb = b64(b"".join([*(packer.compress(b"z" * (1 << 20)) for _ in range(200)), packer.flush()]))
    tracemalloc.start()
    assert S.find_secrets(f"x {bomb}")[1] == []
    assert tracemalloc.get_traced_memory()[1] < 250 << 20
    tracemalloc.stop()

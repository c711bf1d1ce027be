import zlib

import numpy as np
import pytest

from lexiloom.llm import language_id as L


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return L.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_held_out_accuracy(spark, sf_dir, model):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(L.held_out("doc_id"))
    rows = docs.select("lang", L.predict(docs, model).alias("p")).collect()
    assert len(rows) > 20 and np.mean([r["lang"] == r["p"]["lang"] for r in rows]) >= 0.9
    assert all(0 <= r["p"]["score"] <= 1 for r in rows)


def test_held_out_rows_teach_nothing(make):
    rows = [(i, "abc abd" if i % 2 else "xyz xyw", "aa" if i % 2 else "xx", None) for i in range(60)]
    out = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    clean = L.train(make([r for r in rows if r[0] not in out]))
    noisy = L.train(make([(i, t, "wrong" if i in out else lang, s) for i, t, lang, s in rows]))
    assert noisy.languages == clean.languages == ["aa", "xx"] and np.array_equal(noisy.weights, clean.weights)
    assert noisy.predict("abd abc") [0] == "aa" and noisy.predict("xyw")[0] == "xx"


def test_texts_without_letters_and_nulls(make, model):
    docs = make([(1, None), (2, ""), (3, "12 .. %%"), (4, "the"), (4, "the")])
    got = [tuple(r) for r in docs.select("doc_id", L.predict(docs, model).alias("p")).select("doc_id", "p.*").collect()]
    assert got[:3] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)] and got[3] == got[4] and got[3][1] == "en"


def test_number_forms_are_no_letters(model):
    for t in ("½ ²", "Ⅷ", "①② 3"):
        assert model.predict(t) == ("und", 0.0)
    assert model.predict("ª")[0] != "und"


def plain_counts(text):
    """Counts of hashed 1- to 3-grams, gram by gram."""
    codes, out = [ord(c) for c in text.lower()], {}
    for n in (1, 2, 3):
        for i in range(len(codes) - n + 1):
            h = 0
            for j in range(n):
                h = ((h + codes[i + j] * int(L._MULT[j])) * 0x27D4EB2F + j + 1) % 2**32
            out[h >> 16] = out.get(h >> 16, 0) + 1
    return out


def test_counts_features_and_weights_by_brute_force(make):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcdé xyz"), size=rng.integers(1, 40))) for _ in range(30)]
    for t in texts:
        counts = L.ngram_counts(t)
        assert {int(k): int(counts[k]) for k in np.flatnonzero(counts)} == plain_counts(t)
    df = L.document_frequencies(make(list(enumerate(texts))))
    every = [plain_counts(t) for t in texts]
    assert all(df[k] == sum(k in c for c in every) for k in set().union(*every))
    idf = np.log((1 + len(texts)) / (1 + df)) + 1.0
    at, x = L.features(texts[0], idf)
    raw = {k: (1 + np.log(n)) * idf[k] for k, n in every[0].items()}
    norm = np.sqrt(sum(v * v for v in raw.values()))
    assert dict(zip(at.tolist(), x)) == pytest.approx({k: v / norm for k, v in raw.items()})
    # FTRL, one weight after another.
    rows = [(*L.features(t, idf), k % 2) for k, t in enumerate(texts)]
    z, n, width = {}, {}, 2

    def weight(f, c):
        a, b = z.get((f, c), 0.0), n.get((f, c), 0.0)
        return 0.0 if abs(a) <= L.L1 else -(a - np.sign(a) * L.L1) / ((L.BETA + np.sqrt(b)) / L.ALPHA + L.L2)

    for _ in range(2):
        for at, x, label in rows:
            full = [*zip(at.tolist(), x.tolist()), (L.BUCKETS, 1.0)]
            s = [sum(v * weight(f, c) for f, v in full) for c in range(width)]
            e = np.exp(np.array(s) - max(s))
            p = e / e.sum()
            for f, v in full:
                for c in range(width):
                    g = v * (p[c] - (c == label))
                    w, b = weight(f, c), n.get((f, c), 0.0)
                    z[f, c] = z.get((f, c), 0.0) + g - (np.sqrt(b + g * g) - np.sqrt(b)) / L.ALPHA * w
                    n[f, c] = b + g * g
    got = L.ftrl(rows, width, 2)
    assert all(got[f, c] == pytest.approx(weight(f, c), abs=1e-9) for f, c in z)


def test_nothing_to_learn_from(make):
    docs = make([(1, "text", None, None)])
    model = L.train(docs)
    assert docs.select(L.predict(docs, model)["lang"].alias("l")).first()["l"] == "und"
    assert L.train(make([])).languages == []


def test_long_texts_count_like_their_parts(monkeypatch):
    text = "Ab c é" * 50
    whole = L.ngram_counts(text)
    monkeypatch.setattr(L, "CHUNK", 7)
    assert np.array_equal(L.ngram_counts(text), whole) and whole.sum() == 3 * len(text) - 3


def test_weights_are_sparse(model):
    assert 0 < np.count_nonzero(model.weights) < 0.5 * model.weights.size
    assert model.temperature > 0


def test_held_out_is_the_crc_of_the_id(make):
    got = make([(i, "t") for i in range(50)]).select("doc_id", L.held_out("doc_id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_rows_that_share_an_id_do_not_fill_the_sample(make, monkeypatch):
    taken = []
    kept = L.stage
    monkeypatch.setattr(L, "stage", lambda df, label: taken.append(kept(df, label)) or taken[-1])
    monkeypatch.setattr(L, "PER_LANGUAGE", 100)
    rows = [(3, f"some words number {i}", "en") for i in range(3000)] + [(4, "the same row", "fr")] * 2000
    L.train(make(rows))
    per = {r["label"]: r["count"] for r in taken[0].groupBy("label").count().collect()}
    assert per.get(0, 0) < 200 and per.get(1, 0) <= 1
    assert taken[0].select("shard").distinct().count() > 1

import random

import pytest

from lexiloom.operators import vocabulary as V


def words(df):
    return {r["word"]: r["freq"] for r in df.collect()}


def table(spark, pairs):
    return spark.createDataFrame(pairs, "word string, freq long")


def lines(spark, values, layer=2, first="0"):
    rows = [(v, layer, f"{first}{i:05}") for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "line string, layer int, ord string")


def test_ngrams(spark):
    docs = spark.createDataFrame([("abc-de",), ("",), ("x",)], "text string")
    assert words(V.discover_words(docs, 1)) == {"ab": 1, "bc": 1, "abc": 1, "de": 1}


def test_discovery_counts_every_occurrence(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("甲乙丙 ,") for _ in range(rng.randrange(40))) for _ in range(200)]
    counts = {}
    for t in texts:
        for b in t.replace(",", " ").split():
            for k in (2, 3, 4):
                for i in range(len(b) - k + 1):
                    counts[b[i : i + k]] = counts.get(b[i : i + k], 0) + 1
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    assert words(V.discover_words(docs, 5)) == {w: n for w, n in counts.items() if n >= 5}


def test_parts_that_are_rare_save_longer_words_the_count(spark, monkeypatch):
    monkeypatch.setattr(V, "ONE_PASS", 0)
    rng = random.Random(8)
    texts = ["".join(chr(0x4E00 + int(rng.paretovariate(0.6)) % 3000) for _ in range(300)) for _ in range(60)] * 2 + ["甲乙丙丁戊" * 3] * 4 + [None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = V.gram_rows(V.block_counts(docs), 2, 4)
    plain = rows.groupBy("word").agg(V.F.sum("n").alias("freq")).filter("freq >= 5")
    got = V.discover_words(docs, 5)
    assert words(got) == words(plain) and "甲乙丙丁" in words(got)
    pairs = got.filter("char_length(word) = 2")
    asked = V.gram_rows(V.block_counts(docs), 3, 3, pairs).select("word").distinct()
    every = V.gram_rows(V.block_counts(docs), 3, 3).select("word").distinct()
    assert 2 * asked.count() < every.count()
    assert got.filter("char_length(word) = 3").join(asked, "word", "left_anti").isEmpty()


def test_a_full_filter_loses_no_word(spark, monkeypatch):
    monkeypatch.setattr(V, "MOST_BITS", 1 << 6)
    monkeypatch.setattr(V, "ONE_PASS", 0)
    docs = spark.createDataFrame([("甲乙丙丁 abcd abce",)] * 6, "text string")
    assert words(V.discover_words(docs, 5, longest=6)) == words(V.discover_words(docs, 1, longest=6).filter("freq >= 5"))
    assert words(V.discover_words(docs.limit(0), 5)) == {}


def test_prefixes_and_suffixes(spark):
    kept = V.prune_prefixes(table(spark, [("信息", 100), ("信息科", 95), ("信息科技", 10)]), 0.9)
    assert set(words(kept)) == {"信息科", "信息科技"}
    assert set(words(V.prune_suffixes(table(spark, [("大学", 100), ("科技大学", 95)]), 0.9))) == {"科技大学"}


def test_windows_by_first_character_equal_one_sort(spark):
    rng = random.Random(2)
    pairs = sorted({"".join(rng.choice("ab中é") for _ in range(rng.randrange(1, 6))): rng.randrange(1, 100) for _ in range(800)}.items(), key=lambda p: p[0].encode())
    expected = [
        w for (w, n), (x, m) in zip(pairs, [*pairs[1:], ("", 0)]) if not (x.startswith(w) and m / n >= 0.9)
    ]
    assert sorted(words(V.prune_prefixes(table(spark, pairs), 0.9))) == sorted(expected)


def test_noisy_extensions(spark):
    kept = V.noisy_extensions(table(spark, [("希尔顿", 100), ("城希尔顿", 5), ("希尔顿店", 5), ("希尔顿的", 5), ("美希尔顿", 20)]))
    assert set(words(kept)) == {"希尔顿", "希尔顿店", "美希尔顿"}


def test_sum_duplicates(spark):
    got = V.sum_duplicates(lines(spark, ["甲乙 2", "甲乙 3", "甲，乙 9", "丙丁", "戊己 0", "庚辛 10.5", "壬癸 -1", ""]))
    assert words(got) == {"甲乙": 5}


def test_token_counts_and_brands(spark):
    brands = spark.createDataFrame([("希尔顿",)], "brand string")
    corpus = spark.createDataFrame([("我 IU7 7天 酒店 城希尔顿 希尔顿 新城希尔顿 酒店",)], "line string")
    got = V.token_counts(corpus, brands)
    assert words(got) == {"7天": 1, "酒店": 2, "希尔顿": 1, "新城希尔顿": 1}
    assert [r["word"] for r in V.ranked(got).collect()][0] == "酒店"


def test_merging(spark):
    got = [r["line"] for r in V.merge_new_words(lines(spark, ["风筝市集", "北京 大学", "酒店 12", "", "a b c"])).orderBy("ord").collect()]
    assert sorted(got) == sorted(["风筝市集 10000", "北京 10000", "大学 10000", "酒店 12", "a 10000", "b 10000", "c 10000"])


def test_interference(spark):
    feedback = lines(spark, ["北京 大学", "one"])
    user = lines(spark, ["京大 5", "北京 5", "北京大学 5", "北京 7", "学 x"])
    assert {r["word"] for r in V.interference_candidates(feedback).collect()} == {"京大", "京大学", "北京大", "北京大学"}
    got = {r["line"] for r in V.prune_interference(user, feedback).collect()}
    assert got == {"北京 7", "学 0"}
    assert V.prune_interference(user, lines(spark, ["no match"])).count() == 5
    bounded = {r["word"] for r in V.interference_candidates(feedback, 3).collect()}
    assert bounded == {"京大", "京大学", "北京大"}


def test_words_across_boundaries_are_searched_as_they_are_joined(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("甲乙丙😀") for _ in range(n))
    feedback = lines(spark, [" ".join(word(rng.randrange(1, 5)) for _ in range(rng.randrange(6))) for _ in range(60)] + [None, ""])
    known = spark.createDataFrame([(w,) for w in {word(rng.randrange(1, 6)) for _ in range(150)}], "word string")
    got = {r["word"] for r in V.straddling_words(feedback, known).collect()}
    told = {r["word"] for r in V.interference_candidates(feedback).join(known, "word").collect()}
    assert got == told and got
    monkeypatch.setattr(V.lattice, "LEXICON_WORDS", 1)
    assert {r["word"] for r in V.straddling_words(feedback, known).collect()} == told


def test_long_feedback_lines(spark):
    rng = random.Random(6)
    line = " ".join("".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(rng.randrange(1, 4))) for _ in range(50_000))
    flat = line.replace(" ", "")
    known = {flat[k : k + 3] for k in range(0, 3000, 7)}
    sizes = [len(w) for w in line.split()]
    bounds = set(V.np.cumsum(sizes)[:-1].tolist())
    expected = {w for w in known if any(flat.startswith(w, k) and bounds & {k + 1, k + 2} for k in range(len(flat)) if flat[k] == w[0])}
    user = spark.createDataFrame([(w,) for w in known], "word string")
    assert {r["word"] for r in V.straddling_words(lines(spark, [line]), user).collect()} == expected


def test_absorbed_feedback(spark):
    user = lines(spark, ["老词 3", "老词 4"])
    got = words(V.absorb_feedback(user, lines(spark, ["新词", "老词 5"], first="1")))
    assert got == {"老词": 12, "新词": 10000}
    touched = words(V.absorb_feedback(lines(spark, ["北京 3", "京大 4"]), lines(spark, ["北京 大学"], first="1")))
    assert touched == {"北京": 10000, "大学": 10000}


@pytest.mark.parametrize("ratio", [0.9, 1000.0])
def test_cleaning_is_the_chain_of_its_steps(spark, ratio):
    rng = random.Random(3)
    values = ["".join(rng.choice("甲乙丙市") for _ in range(rng.randrange(1, 5))) + f" {rng.randrange(1, 50)}" for _ in range(300)]
    df = lines(spark, values)
    steps = V.noisy_extensions(V.prune_suffixes(V.prune_prefixes(V.sum_duplicates(df), ratio), ratio))
    assert words(V.clean_dictionary(df, ratio)) == words(steps)

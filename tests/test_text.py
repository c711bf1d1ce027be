from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators.tagger import join_tags


def col(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_punctuation(spark):
    words = ["", "，。", "ＡＢ", "a，", "a", "々", "ｶﾅ", "$"]
    assert col(spark, words, T.is_punctuation) == [True, True, True, False, False, True, True, True]
    assert col(spark, words, T.contains_punctuation) == [False, True, True, True, False, True, True, True]


def test_character_classes(spark):
    assert col(spark, ["7天", "abc", "々", "é", "〇"], T.has_chinese) == [True, False, True, False, True]
    assert col(spark, ["5G", "5é", "", "中", "a\n"], T.is_alnum) == [True, False, False, False, False]
    assert col(spark, ["中a", "é", "Ａ"], T.has_word_char) == [True, False, False]


def test_blocks(spark):
    text = "我爱PKU，ok 5G!"
    assert col(spark, [text, ""], T.split_blocks) == [["我爱PKU", "，", "ok", " ", "5G", "!"], []]
    assert col(spark, ["abc-de é́x9"], T.letter_blocks) == [["abc", "de", "é", "x9"]]


def test_fields_and_trimming(spark):
    assert col(spark, ["　a b \x0b c\x85", " \t", ""], T.fields) == [["a", "b", "c"], [], []]
    assert col(spark, ["　 a b \n"], T.trim_space) == ["a b"]


def test_word_parts(spark):
    assert col(spark, ["希尔顿", "a", "", "😀b"], T.reverse_word) == ["顿尔希", "a", "", "b😀"]
    assert col(spark, ["希尔顿", "a"], T.rest) == ["尔顿", ""]
    assert col(spark, ["希尔顿", "a", ""], T.stem) == ["希尔", "", ""]
    assert col(spark, ["希尔顿店", "希尔顿的"], T.protected_suffix) == [True, False]
    assert col(spark, ["a😀é", ""], T.characters) == [["a", "😀", "é"], []]


def test_tags_of_words(spark):
    assert col(spark, ["我们", "是", "程序员", "", "一二三四"], T.word_tags) == [[0, 2], [3], [0, 1, 2], [], [0, 1, 1, 2]]


def test_words_of_tags(spark):
    cases = [("甲乙", [0, 3]), ("甲乙丙", [0, 1, 2]), ("甲乙丙", [1, 0, 0]), ("甲乙", [2, 2]), ("", []), ("甲乙丙丁", [0, 2, 3, 1])]
    df = spark.createDataFrame([(i, list(c), t) for i, (c, t) in enumerate(cases)], "i int, c array<string>, t array<int>")
    for compat in (False, True):
        got = [r["w"] for r in df.select("i", T.words_of_tags("c", "t", compat).alias("w")).orderBy("i").collect()]
        assert got == [join_tags(list(c), t, compat) for c, t in cases]
        assert got[0] == (["甲", "甲", "乙"] if compat else ["甲", "乙"])


def test_grams_of_long_blocks_come_once(spark):
    block = "".join(chr(0x4E00 + i % 700) for i in range(1500))
    df = spark.createDataFrame([(block,), ("ab",), ("a",)], "b string")
    rows = df.select(F.explode(T.pieces("b", 3)).alias("p")).select(F.explode(T.grams("p", 4)).alias("g")).collect()
    expected = sorted(b[i : i + k] for b in (block, "ab", "a") for k in (2, 3, 4) for i in range(len(b) - k + 1))
    assert sorted(r["g"] for r in rows) == expected

import pytest

from lexiloom.sources import dictionaries as D
from lexiloom.sources import models as M


def lines(spark, *layers):
    rows = [(line, k, i) for k, layer in enumerate(layers) for i, line in enumerate(layer)]
    return spark.createDataFrame(rows, "line string, layer int, ord int")


def words(df):
    return {r["word"]: r["freq"] for r in df.collect()}


def test_default_frequencies(spark):
    got = D.parse_lines(lines(spark, ["甲", "乙 x", "丙 2 z", "", "  ", "丁 5d", "戊 1e3", "己 .5", "庚 0x1p3"]))
    assert words(got) == {"甲": 20000.0, "乙": 1.0, "丙": 2.0, "丁": 1.0, "戊": 1000.0, "己": 0.5, "庚": 1.0}


def test_files_and_totals(spark, tmp_path):
    (tmp_path / "d.txt").write_text("风筝节 70\n海边小屋 45\n\n风筝 12\n")
    entries = D.load_dictionary(spark, str(tmp_path / "d.txt"))
    assert tuple(D.dictionary_stats(entries).first()) == (127.0, 3, 4)
    assert set(words(D.effective(entries))) == {"风筝节", "海边小屋", "风筝"}


def test_the_last_line_wins_and_all_count(spark):
    entries = D.parse_lines(lines(spark, ["a 1", "b 2", "a 3"], ["b"], ["c 5", "b 7"]))
    assert words(D.effective(entries)) == {"a": 3.0, "b": 7.0, "c": 5.0}
    assert D.dictionary_stats(entries).first()["total"] == 1 + 2 + 3 + 20000 + 5 + 7


def test_last_line_of_a_file_of_many_splits(spark, tmp_path):
    (tmp_path / "d.txt").write_text("".join(f"w {i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        assert words(D.effective(D.load_dictionary(spark, str(tmp_path / "d.txt")))) == {"w": 4999.0}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_logprob(spark):
    lexicon = D.layered_lexicon(D.parse_lines(lines(spark, ["A 30", "B 170", "Z 0"])))
    asked = spark.createDataFrame([("A",), ("B",), ("x",), ("Z",)], "word string")
    got = {r["word"]: r["logp"] for r in D.word_logprob(asked, lexicon).collect()}
    assert got["A"] == pytest.approx(-1.89712) and got["x"] == -20.0 and got["Z"] is None
    given = D.layered_lexicon(D.parse_lines(lines(spark, ["A 10"])), total=1000.0).first()
    assert given["logp"] == pytest.approx(-4.60517)
    known = {r["word"]: (r["known"], r["freq"]) for r in D.word_lookup(asked, lexicon).collect()}
    assert known["B"] == (True, 170.0) and known["x"] == (False, 0.0) and known["Z"] == (True, 0.0)
    assert D.layered_lexicon(D.parse_lines(lines(spark, []))).count() == 0


def test_writing_and_reading_again(spark, tmp_path):
    entries = D.parse_lines(lines(spark, ["a 3", "b 2.5", "c"]))
    D.write_dictionary(entries, str(tmp_path / "out"))
    assert words(D.load_dictionary(spark, str(tmp_path / "out"))) == {"a": 3.0, "b": 2.5, "c": 20000.0}


def test_corpus_and_brands(spark, tmp_path):
    cut = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "doc_id long, tokens array<string>")
    assert [tuple(r) for r in D.corpus_lines(cut).collect()] == [(1, "a b")]
    D.write_segmented_corpus(cut, str(tmp_path / "corpus"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "corpus")).collect()] == ["a b"]
    assert {r["brand"] for r in D.load_brands(lines(spark, [" 希尔顿 ", "", "如家 5"])).collect()} == {"希尔顿", "如家 5"}
    texts = spark.createDataFrame([("　x ",), ("  ",)], "text string")
    assert [r["text"] for r in D.read_text_corpus(texts).collect()] == ["x"]


def test_models(spark, tmp_path):
    text = "# comment\n\nT B M 10\nT B M 2.5\nT B X 1\nT B M\nF U02:长 B 10\nF U02:长 Q 1\nF U02:江 M nope\nF U02:江 M -1\n"
    (tmp_path / "m.txt").write_text(text)
    trans, feats = M.load_tagger_model(spark, str(tmp_path / "m.txt"))
    assert [tuple(r) for r in trans.collect()] == [(0, 1, 2.5)]
    assert {tuple(r) for r in feats.collect()} == {("U02:长", 0, 10.0), ("U02:江", 1, -1.0)}
    M.save_tagger_model(trans, feats, str(tmp_path / "out"))
    again = M.load_tagger_model(spark, str(tmp_path / "out"))
    assert {tuple(r) for r in again[1].collect()} == {tuple(r) for r in feats.collect()}
    assert "T B M 2.500000" in [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]

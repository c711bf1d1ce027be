from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from lexiloom.llm.common import stage
from tests.llm.test_decontaminate import brute as brute_benchmark
from tests.llm.test_exact_dedup import brute as brute_exact
from tests.llm.test_jaccard_join import brute as brute_jaccard


def test_each_stage_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    columns = docs.columns
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = None
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, sf_dir), "test")
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "language ID":
            assert kept == {i for i, t in rows if t and any(c.isalpha() for c in t)}
        elif name == "exact dedup":
            expected = {i for i, keep, *_ in brute_exact(rows) if i == keep}
        elif name == "n-gram Jaccard join":
            expected = {i for i, _, c in brute_jaccard(rows) if i == c}
        elif name == "benchmark decontamination":
            expected = {i for i, _, hit, _ in brute_benchmark(rows, items, 10) if not hit}
        else:
            expected = {i for i, _ in rows}
            assert sorted(r["mix_position"] for r in docs.collect()) == list(range(len(rows)))
        assert expected is None or kept == expected, name
        assert docs.columns[: len(columns)] == columns
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert corpus_pipeline.run(spark, sf_dir).agg(F.count("*")).first()[0] == len(rows)


def test_stages_take_nulls_repeats_and_empty_tables(spark, sf_dir, make):
    text = "the of and with was this that from are have been will would there their"
    docs = make([(1, text, "en", "a"), (1, text, "en", "a"), (2, text + " x", None, None), (3, None, "en", "b"), (None, text + " y z q", "en", None)])
    empty = docs.limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs, empty = stage(step(spark, docs, sf_dir), "test"), stage(step(spark, empty, sf_dir), "test")
        assert docs.count() >= 1 and empty.count() == 0
        assert "component" in docs.columns and "key" in docs.columns


def pairs(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_decisions_are_for_rows_not_for_ids(spark, sf_dir, make):
    """Repeated and null ids: one row of each group stays, and no other text goes with it."""
    item = next(r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").collect() if len(r["text"].split()) >= 12)
    words = [f"w{k}" for k in range(60)]
    near = " ".join([*words[:30], "other", *words[31:]])
    rows = [
        (1, "a text of its own"), (1, "copy"), (0, "copy"), (7, "twice the same"), (7, "twice the same"), (None, "nameless"),
        (None, "nameless"), (None, "another nameless"), (4, " ".join(words)), (4, near), (None, " ".join(words)), (5, item),
        (5, "clean beside it"), (None, item), (6, None), (6, ""),
    ]
    docs = make([(i, t, "en", "a") for i, t in rows]).withColumns({"gone_id": F.lit(1), "_gone_one": F.lit("x"), "predicted": F.lit(2)})
    exact = pairs(corpus_pipeline.exact(spark, docs, sf_dir))
    groups = {}
    for i, t in rows:
        groups.setdefault("".join((t or "").split()), []).append((i, t))
    kept = Counter(min(g, key=lambda r: (-len(r[1] or ""), r[0] is not None, r[0] or 0)) for g in groups.values())
    assert sum(exact.values()) == len(groups) and {"".join((t or "").split()) for _, t in exact} == set(groups)
    assert all(exact[k] == 1 for k in kept if k[1] and k[0] is not None)
    jaccard = pairs(corpus_pipeline.jaccard(spark, docs, sf_dir))
    linked = [(4, " ".join(words)), (4, near), (None, " ".join(words))]
    same = {t: [i for i, u in rows if u == t] for t in ("copy", "twice the same", "nameless", item)}
    assert sum(jaccard[r] for r in linked) == 1 and jaccard[None, " ".join(words)] == 0
    assert jaccard[0, "copy"] == 1 and jaccard[1, "copy"] == 0 and jaccard[7, "twice the same"] == jaccard[None, "nameless"] == 1
    assert jaccard[5, item] == 1 and jaccard[None, item] == 0 and all(len(v) == 2 for v in same.values())
    for r in [(1, "a text of its own"), (None, "another nameless"), (5, "clean beside it"), (6, None), (6, "")]:
        assert jaccard[r] == 1
    clean = pairs(corpus_pipeline.benchmark(spark, docs, sf_dir))
    assert clean == Counter(r for r in rows if r[1] != item)
    for step in (corpus_pipeline.exact, corpus_pipeline.jaccard, corpus_pipeline.benchmark, corpus_pipeline.language_id):
        assert step(spark, docs, sf_dir).columns == docs.columns

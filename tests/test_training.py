import random
import subprocess
import sys
from fractions import Fraction
from pathlib import Path

from pyspark.sql import functions as F

from lexiloom.operators import training as R
from lexiloom.operators.tagger import Tagger, viterbi_decode


def sentences(spark, n=60, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        chars, tags = [], []
        for _ in range(rng.randrange(1, 6)):
            w = rng.choice(["甲", "乙丙", "丁戊己", "庚辛", "壬"])
            chars += list(w)
            tags += [3] if len(w) == 1 else [0, *[1] * (len(w) - 2), 2]
        rows.append((k, chars, tags))
    return spark.createDataFrame(rows, "ord long, chars array<string>, tags array<int>"), rows


def test_one_shard_is_the_sequential_perceptron(spark):
    df, rows = sentences(spark)
    model = Tagger()
    for _ in range(3):
        for _, chars, tags in rows:
            R.learn(model, chars, tags)
    got = R.train_tagger(df, epochs=3, shards=1)
    strip = lambda m: {f: w for f, w in m.feats.items() if any(w)}
    assert got.trans == model.trans and strip(got) == strip(model)


def test_mixed_shards_learn_as_well(spark):
    df, _ = sentences(spark, 200)
    model = R.train_tagger(df, epochs=4, shards=4)
    assert R.sentence_accuracy(viterbi_decode(df, model)).first()["accuracy"] > 0.95


def replay(rows, shards, shard_of, epochs):
    """Iterative parameter mixing in plain loops, in exact fractions."""
    model = Tagger()
    for _ in range(epochs):
        made = []
        for k in range(shards):
            mine = Tagger([list(r) for r in model.trans], {f: list(w) for f, w in model.feats.items()})
            own = sorted((o, "".join(c), c, t) for o, c, t in rows if shard_of[o] == k)
            for _, _, chars, tags in own:
                R.learn(mine, chars, tags)
            made += [mine] if own else []
        grid = lambda values: round(float(sum(map(Fraction, values)) / len(made)) * R.GRAIN) / R.GRAIN
        names = {f for m in made for f in m.feats}
        model = Tagger(
            [[grid([m.trans[a][b] for m in made]) for b in range(4)] for a in range(4)],
            {f: [grid([m.feats.get(f, [0.0] * 4)[t] for m in made]) for t in range(4)] for f in names},
        )
    return model


def weights(model):
    return model.trans, {f: w for f, w in model.feats.items() if any(w)}


def test_mixing_is_the_plain_replay_however_the_rows_lie(spark, monkeypatch):
    monkeypatch.setattr(R, "SHARD_CHARS", 100)
    df, rows = sentences(spark, 90, seed=4)
    shards = R.shards_of(df)
    assert shards == -(-sum(len(c) for _, c, _ in rows) // 100) > 4
    shard_of = {r["ord"]: r["s"] for r in df.select("ord", F.pmod(F.xxhash64("ord"), F.lit(shards)).alias("s")).collect()}
    expected = weights(replay(rows, shards, shard_of, 4))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in (1, 3, 8):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        assert weights(R.train_tagger(df.repartition(partitions), epochs=4, shards=None)) == expected
    spark.conf.set("spark.sql.shuffle.partitions", before)


MACHINE = """
import hashlib, sys
from pyspark.sql import SparkSession
from lexiloom.operators import training as R
from tests.test_training import sentences, weights
spark = SparkSession.builder.master(f"local[{sys.argv[1]}]").config("spark.ui.enabled", "false").getOrCreate()
R.SHARD_CHARS = 60
df, _ = sentences(spark, 120, seed=9)
trans, feats = weights(R.train_tagger(df, epochs=3, shards=None))
print("WEIGHTS", hashlib.sha256(repr((trans, sorted(feats.items()))).encode()).hexdigest())
"""


def test_four_and_eight_cores_give_the_same_weights():
    told = []
    for cores in ("4", "8"):
        run = subprocess.run([sys.executable, "-c", MACHINE, cores], capture_output=True, text=True, timeout=300, cwd=Path(__file__).parents[1])
        told += [x for x in run.stdout.splitlines() if x.startswith("WEIGHTS")]
    assert len(told) == 2 and told[0] == told[1]


def test_training_goes_on_behind_the_last_epoch(spark):
    df, _ = sentences(spark, 60, seed=6)
    kept = {}
    whole = R.train_tagger(df, epochs=5, shards=3, told=kept.__setitem__)
    assert sorted(kept) == [1, 2, 3, 4, 5]
    again = R.train_tagger(df, epochs=5, shards=3, start=(2, kept[2]))
    assert weights(again) == weights(whole) == weights(R.train_tagger(df, epochs=5, shards=3, start=(5, kept[5])))


def test_batch_deltas(spark):
    df, rows = sentences(spark, 20)
    zero = df.withColumn("pred", F.transform("tags", lambda t: F.lit(0))).withColumnRenamed("ord", "sent_id")
    feats, trans = R.perceptron_deltas(zero)
    expected, moves = {}, {}
    from lexiloom.operators.tagger import feature_names

    for _, chars, tags in rows:
        for names, g in zip(feature_names(chars), tags):
            for f in names if g else []:
                expected[f, g] = expected.get((f, g), 0) + 1
                expected[f, 0] = expected.get((f, 0), 0) - 1
        for a, b in zip(tags, tags[1:]):
            if a or b:
                moves[a, b] = moves.get((a, b), 0) + 1
                moves[0, 0] = moves.get((0, 0), 0) - 1
    assert {(r["feature"], r["tag"]): r["weight"] for r in feats.collect()} == {k: v for k, v in expected.items() if v}
    assert {(r["from_tag"], r["to_tag"]): r["weight"] for r in trans.collect()} == {k: v for k, v in moves.items() if v}


def test_tables_of_a_model(spark):
    model = Tagger(feats={"U02:a": [0.0, 1.5, 0.0, -2.0]})
    model.trans[1][2] = 3.0
    again = Tagger.collect(*R.model_tables(spark, model))
    assert again.trans == model.trans and again.feats == model.feats


def test_lanes_decode_as_one_step_after_another():
    import numpy as np

    from lexiloom.operators.tagger import best_tags

    rng = np.random.default_rng(5)
    for grain, spread, pull in ((1, 1.0, 1.0), (1, 0.0, 3.0), (R.GRAIN, 3.0, 3.0), (1, 0.3, 40.0)):
        lens = np.array([1, 63, 64, 65, 700, 2, 1291, 13])
        scores = np.round(rng.normal(0, 1, (lens.sum(), 4)) * spread * grain) / grain
        trans = np.round(rng.normal(0, 1, (len(lens), 4, 4)) * pull * grain) / grain
        if pull == 40.0:  # two tags that hold on to themselves: where a lane begins is told far before it
            trans[:] = np.where(np.eye(4), 40.0, -40.0)
        padded = np.concatenate([scores, np.zeros((R.LANE, 4))])
        starts = np.cumsum(lens) - lens
        got = R.tags_by_lanes(lambda places, own: padded[places].transpose(0, 2, 1).copy(), starts, lens, trans)
        expected = [best_tags(scores[a : a + n].tolist(), t.tolist()) for a, n, t in zip(starts, lens, trans)]
        assert got.tolist() == sum(expected, [])


def test_long_and_short_sentences_side_by_side_and_in_parts(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for k in range(70):
        chars, tags = [], []
        for _ in range(rng.choice([1, 2, 150, 400])):
            w = rng.choice(["甲", "乙丙", "丁戊己", "庚辛", "壬", "甲乙", "𠀀丙"])
            chars += list(w)
            tags += [3] if len(w) == 1 else [0, *[1] * (len(w) - 2), 2]
        rows.append((k, chars, tags))
    df = spark.createDataFrame(rows, "ord long, chars array<string>, tags array<int>")
    shard_of = {r["ord"]: r["s"] for r in df.select("ord", F.pmod(F.xxhash64("ord"), F.lit(5)).alias("s")).collect()}
    expected = weights(replay(rows, 5, shard_of, 2))
    assert weights(R.train_tagger(df, epochs=2, shards=5)) == expected
    # Two shards at a time at most, and a large one a part after another (in this process: tasks do not see the patch).
    monkeypatch.setattr(R, "TOGETHER", 2)
    monkeypatch.setattr(R, "HELD", 1500)
    import pyarrow as pa

    own = sorted((shard_of[k], k, "".join(c), t) for k, c, t in rows)
    batches = pa.table({"shard": pa.array([x[0] for x in own], pa.int32()), "text": [x[2] for x in own], "tags": pa.array([x[3] for x in own], pa.list_(pa.int8()))}).to_batches(7)
    sums = {}
    for batch in R.one_pass(Tagger(), iter(batches)):
        for r in batch.to_pylist():
            key = r["kind"], r["name"], r["tag"]
            sums[key] = sums.get(key, 0.0) + r["w"]
    one = weights(replay(rows, 5, shard_of, 1))
    assert sums["N", "", 0] == 5
    got = {f: [R.mixed(sums.get(("F", f, t), 0.0), 5) for t in range(4)] for _, f, _ in sums if len(f) > 1}
    assert {f: w for f, w in got.items() if any(w)} == one[1]

import random
import re
import time

from pyspark.sql import functions as F

from lexiloom.llm import quote_links as Q

COLS = "conv_id long, turn long, role string, text string, own string, hash string"


def result(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], COLS)
    return {(r["conv_id"], r["turn"]): r for r in Q.link_quotes(df).collect()}


def test_levels_and_introductions():
    own, passages = Q.split_quotes("On Monday, Al wrote:\n> > deep\n>> er\n> top\n\nmine > not a quote\n> last\nend")
    assert own == "mine > not a quote\nend"
    assert [(p["level"], p["text"]) for p in passages] == [(2, "deep\ner"), (1, "top"), (1, "last")]
    assert Q.split_quotes(None) == ("", []) and Q.split_quotes("") == ("", [])


def test_replies_form_threads(spark):
    got = result(spark, [
        (1, 0, "a", "First question here."),
        (1, 1, "b", "Another matter entirely."),
        (1, 2, "a", "> first QUESTION, here\nAnswer to it."),
        (1, 3, "b", "On turn 2, a wrote:\n> Answer to it.\n>> First question here.\nThanks."),
        (1, 4, "b", "> never said\nOrphan."),
        (2, 0, "c", "> Another matter entirely.\nElsewhere."),
        (2, 1, "c", None),
        (2, 2, "c", "> \n> ...\nEmpty quote."),
    ])
    assert (got[1, 2]["reply_turn"], got[1, 3]["reply_turn"], got[1, 3]["n_linked"]) == (0, 2, 2)
    assert (got[1, 3]["root_turn"], got[1, 3]["depth"], got[1, 3]["text"]) == (0, 2, "Thanks.")
    assert got[1, 4]["reply_turn"] is None and got[1, 4]["n_passages"] == 1 and got[1, 4]["depth"] == 0
    assert (got[2, 0]["reply_conv"], got[2, 0]["reply_turn"]) == (1, 1)
    assert got[2, 1]["text"] == "" and got[2, 2]["n_linked"] == 0


def test_the_latest_of_equal_sources_and_the_longest(spark):
    got = result(spark, [(1, 0, "a", "same"), (1, 1, "a", "same"), (1, 2, "b", "> same\nx"), (1, 3, "a", "same\nmore words"),
                         (1, 4, "b", "> same\n> more words\ny")])
    assert got[1, 2]["reply_turn"] == 1 and got[1, 4]["reply_turn"] == 3


def test_long_chains_and_common_first_turns(spark):
    rows = [(1, t, "a", (f"> message number {t - 1}\n" if t else "") + f"message number {t}") for t in range(70)]
    rows += [(c, 0, "a", "Hello there") for c in range(10, 60)] + [(c, 1, "b", "> Hello there\nHi") for c in range(10, 60)]
    got = result(spark, rows)
    assert all((got[1, t]["root_turn"], got[1, t]["depth"]) == (0, t) for t in range(70))
    assert all((got[c, 1]["reply_conv"], got[c, 1]["reply_turn"]) == (c, 0) for c in range(10, 60))


def test_repeats_nulls_and_empty_table(spark):
    got = result(spark, [(1, 0, "a", "x"), (1, 0, "a", "x"), (None, None, None, None), (1, None, "a", "y")])
    assert len(got) == 3
    assert result(spark, []) == {}


def plain(text):
    return " ".join(re.sub(r"[\W_]+", " ", text.lower()).split())


def brute(rows):
    """The rules once more, message by message."""
    messages = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        messages.setdefault((c, t), (role, *Q.split_quotes(text)))
    own_lines = {k: {plain(x) for x in own.split("\n")} - {""} for k, (_, own, _) in messages.items()}
    first = {}
    for k in sorted(messages):
        first.setdefault(plain(messages[k][1]), k)
    out = {}
    for (c, t), (_, own, passages) in messages.items():
        linked, reply = 0, None
        for p in passages:
            if not plain(p["text"]):
                continue
            votes = {}
            for x in {plain(x) for x in p["text"].split("\n")} - {""}:
                holders = [k for k in messages if k[0] == c and k[1] < t and x in own_lines[k]]
                if holders:
                    votes[max(holders)] = votes.get(max(holders), 0) + len(x)
            source = max(votes, key=lambda k: (votes[k], k)) if votes else first.get(plain(p["text"]))
            if source is None or source >= (c, t):
                continue
            linked += 1
            if p["level"] == 1 and reply is None:
                reply = source
        out[c, t] = (own, len(passages), linked, reply)
    for k in out:
        root, depth = k, 0
        while out[root][3] is not None:
            root, depth = out[root][3], depth + 1
        out[k] = (*out[k][:4], root, depth)
    return out


def answers(df):
    return {
        (r["conv_id"], r["turn"]): (
            r["text"], r["n_passages"], r["n_linked"], None if r["reply_turn"] is None else (r["reply_conv"], r["reply_turn"]),
            (r["root_conv"], r["root_turn"]), r["depth"],
        )
        for r in df.collect()
    }


def test_by_brute_force_on_random_messages(spark, monkeypatch):
    monkeypatch.setattr(Q, "TURNS", 4)  # several windows a conversation
    rng = random.Random(21)
    lines = [f"line {k} says {'word ' * rng.randrange(1, 4)}" for k in range(12)] + ["thanks", "...", ""]
    rows = []
    for c in range(12):
        said = []
        for t in range(rng.randrange(1, 14)):
            parts = []
            for _ in range(rng.randrange(3)):
                level = rng.randrange(1, 4)
                kind = rng.random()
                source = rng.choice(said) if said and kind < 0.6 else "\n".join(rng.sample(lines, 2)) if kind < 0.9 else f"foreign {rng.randrange(4)}"
                parts.append("\n".join(">" * level + " " + x for x in source.split("\n")))
            body = "\n".join(rng.sample(lines, rng.randrange(1, 4))) if rng.random() < 0.8 else f"foreign {rng.randrange(4)}"
            said.append(body)
            rows.append((c, t, "a", "\n\n".join([*parts, body])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert answers(Q.link_quotes(df)) == brute(rows)


def test_by_brute_force_on_the_messages_of_the_query(spark, sf_dir):
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    messages = Q.quoting_messages(said)
    got = answers(Q.link_quotes(messages))
    rows = [tuple(r) for r in messages.select("conv_id", "turn", "role", "text").collect()]
    assert got == brute(rows)
    kinds = {(r[1] - r[2], r[3] is None) for r in got.values()}
    assert len(kinds) > 2 and any(r[3] and r[3][0] != k[0] for k, r in got.items()) or any(r[1] > 2 for r in got.values())


def test_a_line_that_all_turns_share_costs_a_row_each(spark):
    n = 20_000
    rows = spark.range(n).select(
        F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("a").alias("role"),
        F.concat(F.lit("> thanks\nthanks\nnumber "), F.col("id")).alias("text"),
    )
    began = time.time()
    got = Q.link_quotes(rows).agg(F.sum("n_linked"), F.max(F.col("turn") - F.col("reply_turn"))).first()
    assert tuple(got) == (n - 1, 1) and time.time() - began < 120


def test_very_long_messages(spark):
    text = "\n".join(f"line {k}" for k in range(20_000))
    got = result(spark, [(1, 0, "a", text), (1, 1, "b", "\n".join("> " + x for x in text.split("\n")) + "\nok")])
    assert (got[1, 1]["reply_turn"], got[1, 1]["text"], got[1, 0]["depth"]) == (0, "ok", 0)


def test_own_texts_come_back(spark, sf_dir):
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = Q.link_quotes(Q.quoting_messages(said))
    assert got.count() == said.count()
    both = got.withColumnRenamed("text", "own").join(said.select("conv_id", "turn", "text"), ["conv_id", "turn"])
    assert both.filter(F.col("own") != F.trim("text")).count() == 0

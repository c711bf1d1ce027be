r"""Quotation linking: replies are tied to what they quote and put in reply order.

Lines that begin with `>` are quotes; the number of `>` is the level. Consecutive quoted lines of one
level are a passage; what is left is the message's own text, without the line that only introduces a
quote. Quoted lines and own lines are normalised (letters and digits of any script, lower case) and
hashed; each line of a passage is tied to the last earlier message of the conversation that holds it, and
the message that gets most of the passage's characters in this way is its source (the latest of equals), so a
line that many messages share costs one row for each message that quotes it. A passage without a source there is looked up by the hash of the whole passage among whole own texts of
all conversations, of which the first (least conversation, then turn) counts, so a text that many
messages share costs one row. The source of the first passage of level 1 is what a message replies to;
pointer jumping over the replies gives each message its thread's root and its depth.

Defined results: null text counts as empty; rows that repeat a conversation and turn are one message,
with the least role and text; null conversations or turns form no links; blank lines and lines without
letters or digits link nothing; messages without quotes or sources are roots; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.llm.common import small_batches, stage, table

#: Turns that one window takes when the last earlier holder of a line is looked up.
TURNS = 1000

_MARK = regex.compile(r"\s{0,3}((?:>[ \t]?)+)")
_INTRO = regex.compile(r"^\s*(?:On|Am|Le|El)\b.*(?:wrote|schrieb|écrit|escribió)\s*:\s*$", regex.IGNORECASE)


def split_quotes(text: str | None) -> tuple[str, list[dict]]:
    """Own text and the passages (no, level, text) of a message, in order."""
    own: list[str] = []
    passages: list[dict] = []
    open_level = 0
    for line in (text or "").split("\n"):
        m = _MARK.match(line)
        if m is None:
            own.append(line)
            open_level = 0
            continue
        level, body = m[1].count(">"), line[m.end() :]
        if open_level != level:
            if not open_level and own and _INTRO.match(own[-1]):
                own.pop()
            passages.append({"no": len(passages), "level": level, "text": body})
        else:
            passages[-1]["text"] += "\n" + body
        open_level = level
    return "\n".join(own).strip(), passages


def _split(col: str) -> Column:
    @F.pandas_udf("struct<own: string, passages: array<struct<no: int, level: int, text: string>>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([split_quotes(t) for t in texts], columns=["own", "passages"])

    return run(F.col(col))


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")


def _hash(text: Column) -> Column:
    return F.md5(F.trim(_plain(text)))


def _lines(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Distinct normalised lines of a text column with letters or digits: line hash, size."""
    rows = df.select(*keep, F.explode(F.split(text, "\n")).alias("line")).withColumn("plain", F.trim(_plain(F.col("line"))))
    return rows.filter("plain <> ''").select(*keep, F.md5("plain").alias("hash"), F.char_length("plain").alias("size")).distinct()


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, text (own), n_passages, n_linked, reply_conv,
    reply_turn, root_conv, root_turn, depth. Sorted by root_conv, root_turn, depth, turn, the rows
    are the conversations in reply order."""
    small_batches(messages.sparkSession)
    rows = messages.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    )
    one = rows.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m"))
    parsed = one.select("conv_id", "turn", "m.role", "m.text").withColumn("s", _split("text"))
    parsed = stage(parsed.select("conv_id", "turn", "role", "s.own", "s.passages"), "quote-parsed")
    passages = parsed.select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", "p.no", "p.level", "p.text")
    passages = passages.filter(F.trim(_plain(F.col("text"))) != "")

    # Inside a conversation: lines of passages against own lines of earlier messages.
    own = _lines(parsed, "own", ["conv_id", "turn"]).withColumnRenamed("turn", "src")
    asked = _lines(passages, "text", ["conv_id", "turn", "no", "level"])
    held = (
        asked.join(_last_holders(own, asked), ["conv_id", "turn", "hash"])
        .groupBy("conv_id", "turn", "no", "src").agg(F.sum("size").alias("size"))
        .groupBy("conv_id", "turn", "no").agg(F.max(F.struct("size", "src"))["src"].alias("src"))
    )
    held = stage(held, "quote-held")
    # Elsewhere: whole passages against the first message with that own text.
    rest = passages.join(held, ["conv_id", "turn", "no"], "left_anti").withColumn("hash", _hash(F.col("text")))
    first = parsed.withColumn("hash", _hash(F.col("own"))).groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    far = rest.join(first, "hash").filter("first.conv_id < conv_id OR (first.conv_id = conv_id AND first.turn < turn)").select(
        "conv_id", "turn", "no", F.col("first.conv_id").alias("src_conv"), F.col("first.turn").alias("src_turn")
    )
    sources = held.select("conv_id", "turn", "no", F.col("conv_id").alias("src_conv"), F.col("src").alias("src_turn")).unionByName(far)
    levels = passages.select("conv_id", "turn", "no", "level")
    replies = stage(
        sources.join(levels, ["conv_id", "turn", "no"]).groupBy("conv_id", "turn").agg(
            F.count("*").alias("n_linked"),
            F.min(F.when(F.col("level") == 1, F.struct("no", "src_conv", "src_turn"))).alias("r"),
        ),
        "quote-replies",
    )
    linked = parsed.join(replies, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", F.col("own").alias("text"), F.size("passages").cast("long").alias("n_passages"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("r.src_conv").alias("reply_conv"), F.col("r.src_turn").alias("reply_turn"),
    )
    linked = stage(linked, "quote-linked")
    roots = _roots(linked.select("conv_id", "turn", "reply_conv", "reply_turn"))
    return linked.join(
        roots, linked["conv_id"].eqNullSafe(roots["c"]) & linked["turn"].eqNullSafe(roots["t"]), "left"
    ).drop("c", "t")


def _last_holders(own: DataFrame, asked: DataFrame) -> DataFrame:
    """(conv_id, turn, hash, src): the last message before `turn` that holds the line, if one does.

    Windows go over `TURNS` turns at a time; what came before is carried over from window to window.
    """
    part = F.floor(F.col("turn") / TURNS).alias("part")
    events = own.select("conv_id", "hash", F.col("src").alias("turn"), F.col("src").alias("held")).unionByName(
        asked.select("conv_id", "hash", "turn").distinct().withColumn("held", F.lit(None).cast(own.schema["src"].dataType))
    ).filter("turn IS NOT NULL").select("*", part)
    inside = Window.partitionBy("conv_id", "hash", "part").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = events.withColumn("near", F.max("held").over(inside)).filter("held IS NULL").drop("held")
    before = Window.partitionBy("conv_id", "hash").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = events.groupBy("conv_id", "hash", "part").agg(F.max("held").alias("top")).withColumn("far", F.max("top").over(before))
    both = near.join(carried.drop("top"), ["conv_id", "hash", "part"], "left").withColumn("src", F.coalesce("near", "far"))
    return both.filter("src IS NOT NULL").select("conv_id", "turn", "hash", "src")


def _roots(links: DataFrame) -> DataFrame:
    """(c, t, root_conv, root_turn, depth): each message's root, by doubling the way there.

    A source is always earlier than what quotes it, so the ways end."""
    at = links.select(
        F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.coalesce("reply_conv", "conv_id").alias("root_conv"),
        F.coalesce("reply_turn", "turn").alias("root_turn"), F.col("reply_turn").isNotNull().cast("long").alias("depth"),
    )
    at = stage(at, "quote-roots")
    done, moving = at.filter("depth = 0"), at.filter("depth > 0")
    while True:
        # Only ways that have not ended go on, so a few long threads cost no more than their own messages.
        up = done.union(moving).select(
            F.col("c").alias("root_conv"), F.col("t").alias("root_turn"), F.col("root_conv").alias("c2"),
            F.col("root_turn").alias("t2"), F.col("depth").alias("d2"),
        )
        far = stage(
            moving.join(up, ["root_conv", "root_turn"], "left").select(
                "c", "t", F.coalesce("c2", "root_conv").alias("root_conv"), F.coalesce("t2", "root_turn").alias("root_turn"),
                (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), (F.coalesce("d2", F.lit(0)) > 0).alias("moved"),
            ),
            "quote-roots",
        )
        done, moving = done.union(far.filter("NOT moved").drop("moved")), far.filter("moved").drop("moved")
        if moving.isEmpty():
            return done


def quoting_messages(conversations: DataFrame) -> DataFrame:
    """Messages as mail clients write them: each turn quotes the one before it, which quotes its own.

    Every third turn quotes the first line only; turns 4, 9, 14, ... also quote the first message of the
    conversation before, and turns 5, 12, 19, ... something that nobody said.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    quote = lambda text, mark: F.regexp_replace(text, "(?m)^", mark)
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).select(
        "*", F.lag("turn").over(w).alias("t1"), F.lag("role").over(w).alias("r1"), F.lag("text").over(w).alias("x1"),
        F.lag("text", 2).over(w).alias("x2"),
    )
    first = rows.filter("t1 IS NULL").select((F.col("conv_id") + 1).alias("conv_id"), F.col("text").alias("other"))
    rows = rows.join(first.groupBy("conv_id").agg(F.min("other").alias("other")), "conv_id", "left")
    part = F.when(F.col("turn") % 3 == 0, F.substring_index("x1", "\n", 1)).otherwise(F.col("x1"))
    head = F.concat(F.lit("On turn "), F.col("t1"), F.lit(", "), F.coalesce("r1", F.lit("")), F.lit(" wrote:\n"), quote(part, "> "), F.lit("\n"))
    nested = F.when(F.col("x2").isNotNull(), F.concat(quote(F.col("x2"), ">> "), F.lit("\n"))).otherwise(F.lit(""))
    body = F.when(F.col("t1").isNull(), F.col("text")).otherwise(F.concat(head, nested, F.lit("\n"), F.col("text")))
    foreign = F.when((F.col("turn") % 5 == 4) & F.col("other").isNotNull(), F.concat(F.lit("\n\n"), quote(F.col("other"), "> "))).otherwise(F.lit(""))
    unsaid = F.when(F.col("turn") % 7 == 5, F.concat(F.lit("\n\n> unsaid "), F.col("conv_id"), F.lit(" and "), F.col("turn"))).otherwise(F.lit(""))
    return rows.select("conv_id", "turn", "role", F.concat(body, foreign, unsaid).alias("text"))


def op1_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations in the form of quoting mail, linked; -1 stands for no reply."""
    out = link_quotes(quoting_messages(table(spark, sf_dir, "conversations")))
    none = F.lit(-1).cast("long")
    return out.withColumns({c: F.coalesce(c, none) for c in ("reply_conv", "reply_turn")})


#: Writes the messages as the query does, then parses and links them line by line.
OP1_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text,
         lag(turn) OVER w AS t1, lag(role) OVER w AS r1, lag(coalesce(text, '')) OVER w AS x1, lag(coalesce(text, ''), 2) OVER w AS x2
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), firsts AS (SELECT conv_id + 1 AS conv_id, min(text) AS other FROM t WHERE t1 IS NULL GROUP BY 1),
msg AS (
  SELECT conv_id, turn, role,
         CASE WHEN t1 IS NULL THEN text ELSE
           'On turn ' || t1 || ', ' || coalesce(r1, '') || ' wrote:' || chr(10)
           || '> ' || replace(CASE WHEN turn % 3 = 0 THEN string_split(x1, chr(10))[1] ELSE x1 END, chr(10), chr(10) || '> ') || chr(10)
           || CASE WHEN x2 IS NULL THEN '' ELSE '>> ' || replace(x2, chr(10), chr(10) || '>> ') || chr(10) END
           || chr(10) || text END
         || CASE WHEN turn % 5 = 4 AND other IS NOT NULL THEN chr(10) || chr(10) || '> ' || replace(other, chr(10), chr(10) || '> ') ELSE '' END
         || CASE WHEN turn % 7 = 5 THEN chr(10) || chr(10) || '> unsaid ' || conv_id || ' and ' || turn ELSE '' END AS text
  FROM t LEFT JOIN firsts USING (conv_id)
), split AS (
  SELECT conv_id, turn, i, l[i] AS line, regexp_extract(l[i], '^\s{0,3}(>[ \t]?)+') AS mark FROM (
    SELECT conv_id, turn, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM msg)
  )
), marked AS (
  SELECT conv_id, turn, i, line, substr(line, length(mark) + 1) AS body, length(mark) - length(replace(mark, '>', '')) AS level FROM split
), begun AS (
  SELECT *, CAST(level > 0 AND level <> lag(level, 1, 0) OVER w AS INT) AS begins, lead(level, 1, 0) OVER w AS next_level
  FROM marked WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)
), numbered AS (
  SELECT *, sum(begins) OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS no FROM begun
), own_lines AS (
  SELECT conv_id, turn, i, line FROM numbered
  WHERE level = 0 AND NOT (next_level > 0 AND regexp_matches(line, '(?i)^\s*(On|Am|Le|El)\b.*(wrote|schrieb|écrit|escribió)\s*:\s*$'))
), own AS (
  SELECT m.conv_id, m.turn, m.role, trim(coalesce(string_agg(line, chr(10) ORDER BY i), ''), E' \t\n\r') AS text
  FROM msg m LEFT JOIN own_lines o ON o.conv_id = m.conv_id AND o.turn = m.turn GROUP BY ALL
), own_plain AS (
  SELECT DISTINCT conv_id, turn, plain FROM (
    SELECT conv_id, turn, trim(regexp_replace(lower(line), '[^\p{L}\p{N}]+', ' ', 'g')) AS plain FROM own_lines
  ) WHERE plain <> ''
), said AS (
  SELECT conv_id, turn, no, level, string_agg(body, ' ' ORDER BY i) AS text FROM numbered WHERE level > 0 GROUP BY ALL
), passages AS (
  SELECT * FROM (SELECT *, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS plain FROM said) WHERE plain <> ''
), asked AS (
  SELECT DISTINCT conv_id, turn, no, plain FROM (
    SELECT conv_id, turn, no, trim(regexp_replace(lower(body), '[^\p{L}\p{N}]+', ' ', 'g')) AS plain FROM numbered WHERE level > 0
  ) WHERE plain <> ''
), votes AS (
  SELECT a.conv_id, a.turn, a.no, a.plain, max(o.turn) AS src
  FROM asked a JOIN own_plain o ON o.conv_id = a.conv_id AND o.plain = a.plain AND o.turn < a.turn GROUP BY ALL
), scored AS (SELECT conv_id, turn, no, src, sum(length(plain)) AS size FROM votes GROUP BY ALL),
held AS (
  SELECT conv_id, turn, no, src FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, turn, no ORDER BY size DESC, src DESC) AS r FROM scored
  ) WHERE r = 1
), whole AS (
  SELECT plain, min((conv_id, turn)) AS at FROM (
    SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS plain FROM own
  ) GROUP BY plain
), sources AS (
  SELECT h.conv_id, h.turn, h.no, p.level, h.conv_id AS src_conv, h.src AS src_turn FROM held h JOIN passages p USING (conv_id, turn, no)
  UNION ALL
  SELECT p.conv_id, p.turn, p.no, p.level, w.at[1], w.at[2] FROM passages p JOIN whole w USING (plain)
  WHERE w.at < (p.conv_id, p.turn) AND NOT EXISTS (SELECT 1 FROM held h WHERE h.conv_id = p.conv_id AND h.turn = p.turn AND h.no = p.no)
), replies AS (
  SELECT conv_id, turn, src_conv, src_turn FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY no) AS r FROM sources WHERE level = 1
  ) WHERE r = 1
), up AS (
  SELECT o.conv_id, o.turn, o.conv_id AS root_conv, o.turn AS root_turn, 0 AS depth
  FROM own o LEFT JOIN replies r USING (conv_id, turn) WHERE r.src_turn IS NULL
  UNION ALL
  SELECT r.conv_id, r.turn, up.root_conv, up.root_turn, up.depth + 1
  FROM up JOIN replies r ON r.src_conv = up.conv_id AND r.src_turn = up.turn
)
SELECT o.conv_id, o.turn, o.role, o.text,
       (SELECT count(*) FROM said s WHERE s.conv_id = o.conv_id AND s.turn = o.turn) AS n_passages,
       (SELECT count(*) FROM sources s WHERE s.conv_id = o.conv_id AND s.turn = o.turn) AS n_linked,
       coalesce(r.src_conv, -1) AS reply_conv, coalesce(r.src_turn, -1) AS reply_turn, up.root_conv, up.root_turn, up.depth
FROM own o LEFT JOIN replies r USING (conv_id, turn) JOIN up USING (conv_id, turn)
"""

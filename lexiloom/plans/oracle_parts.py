"""Common table expressions that the SQL twins of the queries are put together from (DuckDB).

Classes and constants are written out here, not taken from the library, so that a slip in either shows.
"""

from __future__ import annotations

ALNUM = "A-Za-z0-9"
CJK = r"\x{4E00}-\x{9FFF}"
WHITE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
PUNCTUATION = r"\p{P}\p{S}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}"
PROTECTED = "市省区县店站路里院校园"
LATIN = "abcdefghijklmnopqrstuvwxyz"
HAN = "的一是不了在人有我他这中大来上国个到说们为子和你地出"

HAN_TEXT = f"translate(lower(text), '{LATIN}', '{HAN}')"
BLOCK = f"[{ALNUM}{CJK}]+|[^{ALNUM}{CJK}]+"
PURE = f"^[{ALNUM}]+$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER = r"^[+-]?[0-9]+$"


def is_punct(x: str) -> str:
    return f"NOT regexp_matches({x}, '[^{PUNCTUATION}]')"


def has_punct(x: str) -> str:
    return f"regexp_matches({x}, '[{PUNCTUATION}]')"


def has_han(x: str) -> str:
    return rf"regexp_matches({x}, '\p{{Han}}')"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def fields(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WHITE}+'), lambda x: x <> '')"


def reverse(x: str) -> str:
    return f"array_to_string(list_reverse(list_transform(range(1, length({x}) + 1), lambda i: substr({x}, i, 1))), '')"


def protected(x: str) -> str:
    return f"contains('{PROTECTED}', substr({x}, -1, 1))"


def integer(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{INTEGER}') THEN TRY_CAST({x} AS BIGINT) END"


def number(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{NUMBER}') THEN TRY_CAST({x} AS DOUBLE) END"


def discovered(view: str, threshold: int, source: str = "documents", name: str = "disc") -> str:
    """(word, freq) of `discover_words` over a view of a table's text."""
    return rf"""
{name}_b AS (SELECT unnest(regexp_extract_all({view}, '[\p{{L}}\p{{N}}]+')) AS block FROM {source}),
{name}_c AS (SELECT block, count(*) AS n FROM {name}_b GROUP BY block HAVING length(block) >= 2),
{name}_s AS (SELECT block, n, unnest(range(1, length(block))) AS s FROM {name}_c),
{name}_g AS (SELECT substr(block, s, k) AS word, n FROM {name}_s, (VALUES (2), (3), (4)) t(k) WHERE s + k - 1 <= length(block)),
{name} AS (SELECT word, CAST(sum(n) AS BIGINT) AS freq FROM {name}_g GROUP BY word HAVING sum(n) >= {threshold})"""


#: Dictionary lines of the queries; see `plans.queries.dictionary_lines`.
LINES = f"""{discovered(HAN_TEXT, 5)},
lines AS (
  SELECT word || ' ' || freq AS line, 0 AS layer, word AS ord FROM disc
  UNION ALL SELECT word, 1, word FROM disc WHERE length(word) = 3 AND freq < 15
  UNION ALL SELECT word || ' ' || freq * 10, 2, word FROM disc WHERE length(word) = 2 AND freq < 30
)"""

ENTRIES = f"""{LINES},
entries AS (
  SELECT f[1] AS word, CASE WHEN len(f) = 1 THEN 20000.0 ELSE coalesce({number('f[2]')}, 1.0) END AS freq, layer, ord
  FROM (SELECT {fields('line')} AS f, layer, ord FROM lines) WHERE len(f) > 0
)"""

LEXICON = f"""{ENTRIES},
stats AS (SELECT sum(freq) AS total, count(DISTINCT word) AS size, max(length(word)) AS max_len FROM entries),
eff AS (
  SELECT word, freq FROM (SELECT word, freq, row_number() OVER (PARTITION BY word ORDER BY layer DESC, ord DESC) AS r FROM entries)
  WHERE r = 1
),
lexicon AS (
  SELECT word, freq, round(ln(freq / (SELECT total FROM stats)), 9) AS logp, length(word) AS n FROM eff
)"""

#: (doc_id, pos, block, pure) and the distinct blocks that are cut.
BLOCKS = f"""
blocks AS (
  SELECT doc_id, pos, b[pos] AS block, regexp_matches(b[pos], '{PURE}') AS pure FROM (
    SELECT doc_id, b, unnest(range(1, len(b) + 1)) AS pos
    FROM (SELECT doc_id, regexp_extract_all({HAN_TEXT}, '{BLOCK}') AS b FROM documents)
  )
),
todo AS (SELECT DISTINCT block FROM blocks WHERE NOT pure)"""

EDGES = f"""
places AS (SELECT block, unnest(range(0, length(block))) AS i FROM todo),
subs AS (
  SELECT block, i, k, substr(block, i + 1, k) AS word
  FROM (SELECT block, i, unnest(range(1, least((SELECT max_len FROM stats), length(block) - i) + 1)) AS k FROM places)
),
dict_edges AS (SELECT block, i, k, logp, 0 AS source FROM subs JOIN lexicon USING (word)),
run_edges AS (
  SELECT r.block, r.i, length(run) AS k, coalesce(l.logp, -20.0) AS logp, 1 AS source
  FROM (SELECT block, i, regexp_extract(substr(block, i + 1), '^[{ALNUM}]+') AS run FROM places) r
  LEFT JOIN lexicon l ON l.word = run
  WHERE run <> '' AND NOT EXISTS (SELECT 1 FROM dict_edges d WHERE d.block = r.block AND d.i = r.i AND d.k = length(run))
),
some_edges AS (SELECT * FROM dict_edges UNION ALL SELECT * FROM run_edges),
edges AS (
  SELECT * FROM some_edges
  UNION ALL
  SELECT block, i, 1, -20.0, 2 FROM places p
  WHERE NOT EXISTS (SELECT 1 FROM some_edges e WHERE e.block = p.block AND e.i = p.i)
)"""

#: (block, seg): the best path of each block, its words each followed by U+0001.
PATHS = """
cands AS (
  SELECT block, i, list(k ORDER BY source, k) AS ks, list(logp ORDER BY source, k) AS lps FROM edges GROUP BY block, i
),
dp AS (
  SELECT block, length(block) AS i, [0.0::DOUBLE] AS sc, [''] AS sg FROM todo
  UNION ALL
  SELECT block, i, list_prepend(m, sc), list_prepend(substr(block, i + 1, ks[list_position(s, m)]) || chr(1) || sg[ks[list_position(s, m)]], sg)
  FROM (
    SELECT block, i, sc, sg, ks, s, list_max(s) AS m FROM (
      SELECT d.block, d.i - 1 AS i, d.sc, d.sg, c.ks,
             list_transform(range(1, len(c.ks) + 1), lambda j: c.lps[j] + d.sc[c.ks[j]]) AS s
      FROM dp d JOIN cands c ON c.block = d.block AND c.i = d.i - 1
    )
  )
),
paths AS (SELECT block, sg[1] AS seg FROM dp WHERE i = 0),
cut AS (SELECT doc_id, pos, CASE WHEN pure THEN block || chr(1) ELSE seg END AS seg FROM blocks LEFT JOIN paths USING (block)),
tokens AS (
  SELECT doc_id, string_agg(seg, '' ORDER BY pos) AS seg FROM cut GROUP BY doc_id
)"""

#: Sentences of the dictionary lines and the model of one batch update from the zero model.
MODEL = f"""
named AS (
  SELECT layer || ':' || ord AS sent_id, word, length(word) AS n FROM entries WHERE NOT ({is_punct('word')})
),
gold AS (
  SELECT sent_id, word, n, i, CASE WHEN n = 1 THEN 3 WHEN i = 0 THEN 0 WHEN i = n - 1 THEN 2 ELSE 1 END AS tag
  FROM (SELECT sent_id, word, n, unnest(range(0, n)) AS i FROM named)
),
deltas AS (
  SELECT t.name || CASE WHEN i + d < 0 OR i + d >= n THEN '_BOS_' ELSE substr(word, i + d + 1, 1) END AS feature, m.tag, m.w
  FROM gold, (VALUES (-2, 'U00:'), (-1, 'U01:'), (0, 'U02:'), (1, 'U03:'), (2, 'U04:')) t(d, name),
       LATERAL (SELECT gold.tag AS tag, 1.0 AS w UNION ALL SELECT 0, -1.0) m
  WHERE gold.tag <> 0
),
feats AS (SELECT feature, tag, CAST(sum(w) AS DOUBLE) AS weight FROM deltas GROUP BY feature, tag HAVING sum(w) <> 0),
pairs AS (SELECT a.tag AS g0, b.tag AS g1 FROM gold a JOIN gold b ON a.sent_id = b.sent_id AND b.i = a.i + 1),
moves AS (
  SELECT g0 AS from_tag, g1 AS to_tag, 1.0 AS w FROM pairs WHERE g0 <> 0 OR g1 <> 0
  UNION ALL SELECT 0, 0, -1.0 FROM pairs WHERE g0 <> 0 OR g1 <> 0
),
trans AS (
  SELECT from_tag, to_tag, CAST(sum(w) AS DOUBLE) AS weight FROM moves GROUP BY from_tag, to_tag HAVING sum(w) <> 0
)"""

#: (block, i, tag, score) for places of the blocks in `todo`.
EMISSIONS = """
spots AS (SELECT block, unnest(range(0, length(block))) AS i FROM todo),
seen AS (
  SELECT block, i, t.name || CASE WHEN i + d < 0 OR i + d >= length(block) THEN '_BOS_' ELSE substr(block, i + d + 1, 1) END AS feature
  FROM spots, (VALUES (-2, 'U00:'), (-1, 'U01:'), (0, 'U02:'), (1, 'U03:'), (2, 'U04:')) t(d, name)
),
scored AS (SELECT block, i, tag, sum(weight) AS score FROM seen JOIN feats USING (feature) GROUP BY block, i, tag),
emissions AS (
  SELECT s.block, s.i, t.tag, coalesce(e.score, 0.0) AS score
  FROM spots s CROSS JOIN (VALUES (0), (1), (2), (3)) t(tag) LEFT JOIN scored e ON e.block = s.block AND e.i = s.i AND e.tag = t.tag
),
wide AS (SELECT block, i, list(score ORDER BY tag) AS e FROM emissions GROUP BY block, i),
tm AS (
  SELECT list(coalesce(weight, 0.0) ORDER BY a, b) AS t
  FROM (VALUES (0), (1), (2), (3)) x(a) CROSS JOIN (VALUES (0), (1), (2), (3)) y(b) LEFT JOIN trans ON from_tag = a AND to_tag = b
)"""

#: (block, tags): the best tags of each block, as a string of digits.
VITERBI = """
vit AS (
  SELECT block, 0 AS i, e AS sc, ['0', '1', '2', '3'] AS ph FROM wide WHERE i = 0
  UNION ALL
  SELECT block, i, list_transform(range(1, 5), lambda g: list_max(s[g])),
         list_transform(range(1, 5), lambda g: ph[list_position(s[g], list_max(s[g]))] || (g - 1))
  FROM (
    SELECT v.block, w.i, v.ph,
           list_transform(range(1, 5), lambda g: list_transform(range(1, 5), lambda p: v.sc[p] + tm.t[(p - 1) * 4 + g] + w.e[g])) AS s
    FROM vit v JOIN wide w ON w.block = v.block AND w.i = v.i + 1, tm
  )
),
tagged AS (SELECT block, ph[list_position(sc, list_max(sc))] AS tags FROM vit WHERE i = length(block) - 1)"""

"""Queries of the library and their SQL twins, by name."""

from __future__ import annotations

from lexiloom.plans import queries as Q
from lexiloom.plans.oracle_parts import (
    BLOCKS, EDGES, EMISSIONS, ENTRIES, HAN_TEXT, LEXICON, LINES, MODEL, PATHS, PURE, VITERBI, BLOCK,
    discovered, fields, has_han, has_punct, integer, is_punct, number, protected, reverse, trim,
)

QUERIES = {
    f.__name__: f
    for f in (
        Q.load_dictionary, Q.layered_lexicon, Q.combine_layers, Q.write_dictionary, Q.read_text_corpus, Q.write_segmented_corpus,
        Q.load_tagger_model, Q.save_tagger_model, Q.segment_requests, Q.segment_lines,
        Q.is_punctuation, Q.contains_punctuation, Q.has_chinese, Q.char_class, Q.split_blocks, Q.letter_blocks, Q.noisy_brand_filter,
        Q.load_brands, Q.protected_suffix, Q.reverse_word, Q.word_ngrams, Q.bmes_tags, Q.tags_to_words, Q.tagger_features,
        Q.word_lookup, Q.word_logprob, Q.lattice_edges, Q.noisy_extensions, Q.interference_candidates, Q.prune_interference,
        Q.emission_scores,
        Q.discover_words, Q.token_counts, Q.sum_duplicates, Q.perceptron_deltas, Q.sentence_accuracy, Q.dictionary_stats,
        Q.prune_prefixes, Q.prune_suffixes, Q.clean_dictionary, Q.ranked_core, Q.merge_new_words,
        Q.cut_dag, Q.best_path, Q.cut_tagger, Q.cut_hybrid, Q.cut_search, Q.viterbi_decode, Q.tagger_words, Q.segment_corpus,
        Q.corpus_to_sentences, Q.lexicon_to_sentences, Q.train_tagger, Q.segmentation_report,
        Q.absorb_feedback, Q.stream_log_filter, Q.stream_discover, Q.stream_feedback, Q.stream_segment,
        Q.evolve_core, Q.stream_words_loop, Q.cut_trained, Q.segment_lines_hybrid, Q.stream_segment_hybrid,
        Q.report_metrics,
    )
} | {"evolve": Q.evolve_vocabulary}

_WORDS = f"""
words AS (
  SELECT DISTINCT unnest({fields('t')}) AS word FROM (SELECT text AS t FROM documents UNION ALL SELECT {HAN_TEXT} FROM documents)
)"""
_HAN_WORDS = f"words AS (SELECT DISTINCT unnest({fields(HAN_TEXT)}) AS word FROM documents)"
_LATIN_WORDS = f"words AS (SELECT DISTINCT unnest({fields('text')}) AS word FROM documents)"

_MESSY = f"""
raw AS (
  SELECT doc_id, pos - 1 AS pos, l[pos] AS line FROM (
    SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
  )
),
messy AS (
  SELECT doc_id, pos, line FROM raw
  UNION ALL
  SELECT doc_id, -1 - pos, CASE pos % 5
    WHEN 1 THEN '  ' || first || chr(9) || (length(line) - 50) || ' z'
    WHEN 2 THEN first || ' ' || (length(line) - 50) || '.5e1'
    WHEN 3 THEN first || ' ' || (length(line) - 50)
    ELSE first END AS line
  FROM (SELECT *, coalesce(({fields('line')})[1], 'x') AS first FROM raw)
)"""

_SUMMED = f"""
summed AS (
  SELECT f[1] AS word, CAST(sum({integer('f[2]')}) AS BIGINT) AS freq
  FROM (SELECT {fields('line')} AS f FROM {{source}})
  WHERE len(f) >= 2 AND {integer('f[2]')} > 0 AND NOT {has_punct('f[1]')} GROUP BY 1
)"""


def _prefixes(source: str, out: str, ratio: float) -> str:
    return f"""
{out}_o AS (SELECT word, freq, lead(word) OVER w AS nw, lead(freq) OVER w AS nf FROM {source} WINDOW w AS (ORDER BY word)),
{out} AS (SELECT word, freq FROM {out}_o WHERE nw IS NULL OR NOT (starts_with(nw, word) AND nf / freq >= {ratio}))"""


def _suffixes(source: str, out: str, ratio: float) -> str:
    return f"""
{out}_r AS (SELECT {reverse('word')} AS word, freq FROM {source}),{_prefixes(f'{out}_r', f'{out}_p', ratio)},
{out} AS (SELECT {reverse('word')} AS word, freq FROM {out}_p)"""


def _noise(source: str, out: str) -> str:
    return f"""
{out} AS (
  SELECT w.word, w.freq FROM {source} w
  LEFT JOIN {source} a ON length(w.word) >= 3 AND a.word = substr(w.word, 2)
  LEFT JOIN {source} b ON length(w.word) >= 3 AND NOT {protected('w.word')} AND b.word = substr(w.word, 1, length(w.word) - 1)
  WHERE coalesce(a.freq / w.freq, 0) <= 5.0 AND coalesce(b.freq / w.freq, 0) <= 5.0
)"""


def _cleaned(source: str, ratio: float, tag: str = "") -> str:
    """`cleaned` with `tag` behind its name, and behind those of its parts."""
    summed = _SUMMED.replace("{source}", source).replace("summed AS", f"summed{tag} AS")
    c1, c2 = f"c1{tag}", f"c2{tag}"
    return f"{summed},{_prefixes(f'summed{tag}', c1, ratio)},{_suffixes(c1, c2, ratio)},{_noise(c2, f'cleaned{tag}')}"


_BRANDS = f"brands AS (SELECT DISTINCT {trim('line')} AS brand FROM lines WHERE layer = 1 AND {trim('line')} <> '')"
_NOT_BRAND = "NOT (length(word) >= 4 AND substr(word, 2) IN (SELECT brand FROM brands))"
#: Token counts and sentences of the segmented corpus (`kept`).
_COUNTS = f"""
counts AS (
  SELECT word, count(*) AS freq FROM (SELECT unnest({fields("array_to_string(ts, ' ')")}) AS word FROM kept)
  WHERE length(word) >= 2 AND {has_han('word')} AND {_NOT_BRAND} GROUP BY word
)"""

#: All words of the texts in {{source}} (f: words, num: the number beside them, o: their place) as feedback.
_PAIRS = """
words_of AS (SELECT o, num, f, unnest(range(1, len(f) + 1)) AS p FROM {source}),
feedback AS (
  SELECT CASE WHEN p < len(f) THEN f[p] || ' ' || f[p + 1] ELSE f[p] END AS line, o || printf('%09d', (p - 1) * 2) AS ord
  FROM words_of WHERE p % 2 = 1
  UNION ALL SELECT f[p] || ' ' || num, o || printf('%09d', (p - 1) * 2 + 1) FROM words_of WHERE p % 3 = 2
)"""
_FEEDBACK = _PAIRS.format(source=f"(SELECT printf('1%010d', item_id) AS o, item_id AS num, {fields(HAN_TEXT)} AS f FROM benchmark)")
_STRADDLE = f"""
fb AS (
  SELECT array_to_string(f, '') AS t, list_transform(range(1, len(f)), lambda i: length(array_to_string(f[1:i], ''))) AS b
  FROM (SELECT {fields('line')} AS f FROM feedback) WHERE len(f) >= 2
),
spans AS (
  SELECT t, b, s, unnest(range(s + 2, length(t) + 1)) AS e FROM (SELECT t, b, unnest(range(0, length(t) - 1)) AS s FROM fb)
),
candidates AS (
  SELECT DISTINCT substr(t, s + 1, e - s) AS word FROM spans WHERE len(list_filter(b, lambda x: s < x AND x < e)) > 0
)"""
_PRUNED = f"""
parsed AS (
  SELECT f[1] AS word, coalesce({integer('f[2]')}, 0) AS freq, line, ord FROM (SELECT {fields('line')} AS f, line, ord FROM {{source}})
  WHERE len(f) > 0
),
latest AS (
  SELECT word, freq FROM (SELECT word, freq, row_number() OVER (PARTITION BY word ORDER BY ord DESC) AS r FROM parsed) WHERE r = 1
),
bad AS (SELECT word FROM latest WHERE word IN (SELECT word FROM candidates)),
pruned AS (
  SELECT line FROM parsed WHERE NOT EXISTS (SELECT 1 FROM bad)
  UNION ALL
  SELECT word || ' ' || freq FROM latest WHERE EXISTS (SELECT 1 FROM bad) AND word NOT IN (SELECT word FROM bad)
)"""
_USER = f"user_lines AS (SELECT line, '0' || layer || ord AS ord FROM lines)"
_MERGED = f"""
merged AS (
  SELECT * FROM user_lines
  UNION ALL
  SELECT CASE WHEN len(f) = 2 AND regexp_matches(f[2], '^[+-]?[0-9]+$') THEN {trim('line')} ELSE w || ' 10000' END, ord
  FROM (
    SELECT line, ord, f, unnest(CASE WHEN len(f) = 2 AND regexp_matches(f[2], '^[+-]?[0-9]+$') THEN [''] ELSE f END) AS w
    FROM (SELECT line, ord, {fields('line')} AS f FROM feedback)
  )
)"""

#: Tags to words: a fold over places with the open word.
_FOLD = r"""
walk AS (
  SELECT {id}, c, t, 0 AS i, '' AS done, '' AS open FROM {source}
  UNION ALL
  SELECT {id}, c, t, i + 1,
    CASE t[i + 1] WHEN 0 THEN done || CASE WHEN open <> '' THEN open || chr(1) ELSE '' END
                  WHEN 1 THEN done
                  WHEN 2 THEN done || open || c[i + 1] || chr(1)
                  ELSE done || CASE WHEN open <> '' THEN open || chr(1) ELSE '' END || c[i + 1] || chr(1) END,
    CASE t[i + 1] WHEN 0 THEN c[i + 1] WHEN 1 THEN open || c[i + 1] ELSE '' END
  FROM walk WHERE i < len(c)
),
folded AS (
  SELECT {id}, done || CASE WHEN open <> '' THEN open || chr(1) ELSE '' END AS words FROM walk WHERE i = len(c)
)"""
_CHARS = "list_transform(range(1, length({x}) + 1), lambda i: substr({x}, i, 1))"
_TAG_DIGITS = "CASE WHEN length({x}) = 1 THEN '3' WHEN length({x}) > 1 THEN '0' || repeat('1', length({x}) - 2) || '2' ELSE '' END"
_DIGEST = "SELECT doc_id, CAST(length(seg) - length(replace(seg, chr(1), '')) AS BIGINT) AS n_tokens, md5(rtrim(seg, chr(1))) AS tokens_md5"
_FILTERED = f"""
kept AS (
  SELECT doc_id, list_filter(string_split(rtrim(seg, chr(1)), chr(1)), lambda x: NOT ({is_punct('x')})) AS ts FROM tokens
)"""
_MODEL_ROWS = """
SELECT 'T' || from_tag AS name, CAST(to_tag AS BIGINT) AS tag, weight FROM trans
UNION ALL SELECT 'F' || feature, tag, weight FROM feats"""
_TAGGED = f"WITH RECURSIVE {LEXICON},{BLOCKS},{MODEL},{EMISSIONS},{VITERBI}"
_DAG = f"WITH RECURSIVE {LEXICON},{BLOCKS},{EDGES},{PATHS}"

_BLOCK_SOURCE = f"(SELECT doc_id, regexp_extract_all({HAN_TEXT}, '{BLOCK}') AS b FROM documents)"
_REPORT_SOURCE = _BLOCK_SOURCE.replace(
    "FROM documents", "FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark)"
)
_REQUEST_SOURCE = _BLOCK_SOURCE.replace("FROM documents", "FROM (SELECT conv_id * 100000 + turn AS doc_id, text FROM conversations)")

#: Words of each path as they are, runs of single characters as one piece.
_PIECES = """
pieces AS (
  SELECT block, min(i) AS i, string_agg(tok, '' ORDER BY i) AS piece, single FROM (
    SELECT block, i, tok, single,
           CASE WHEN single THEN i - row_number() OVER (PARTITION BY block, single ORDER BY i) ELSE -i END AS run
    FROM (
      SELECT block, i, t[i] AS tok, length(t[i]) = 1 AS single FROM (
        SELECT block, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT block, string_split(rtrim(seg, chr(1)), chr(1)) AS t FROM paths)
      )
    )
  ) GROUP BY block, single, run
),
gaps AS (SELECT DISTINCT piece AS block FROM pieces WHERE single)"""
_SENT = f"""
sent AS (SELECT block, {_CHARS.format(x='block')} AS c,
                list_transform(range(1, length(tags) + 1), lambda i: CAST(substr(tags, i, 1) AS INT)) AS t FROM tagged)"""


#: Dictionary words inside the tokens of `kinds`.
_INNER = """
inner_ AS (
  SELECT tok, s, e, substr(tok, s, e - s) AS word FROM (
    SELECT tok, s, unnest(range(s + 1, least(length(tok), s + (SELECT max(n) FROM lexicon)) + 2)) AS e
    FROM (SELECT tok, unnest(range(1, length(tok) + 1)) AS s FROM kinds)
  ) WHERE e <= length(tok) + 1 AND e - s < length(tok)
),
subs_of AS (
  SELECT i.tok, string_agg(i.word || chr(1), '' ORDER BY s, e) AS sub FROM inner_ i JOIN lexicon l ON l.word = i.word GROUP BY i.tok
)"""
#: (block, seg): paths in which the tagger has cut the gaps.
_JOINED = """
joined AS (
  SELECT p.block, string_agg(CASE WHEN single THEN words ELSE piece || chr(1) END, '' ORDER BY i) AS seg
  FROM pieces p LEFT JOIN folded f ON p.single AND f.block = p.piece GROUP BY p.block
)"""
_HYBRID = f"""{_DAG},{_PIECES},{MODEL},{EMISSIONS.replace('FROM todo', 'FROM gaps')},{VITERBI},{_SENT},
{_FOLD.format(id='block', source='sent')},{_JOINED},
cut2 AS (SELECT doc_id, pos, CASE WHEN pure THEN block || chr(1) ELSE seg END AS seg FROM blocks LEFT JOIN joined USING (block)),
tokens2 AS (SELECT doc_id, string_agg(seg, '' ORDER BY pos) AS seg FROM cut2 GROUP BY doc_id)"""


#: The lexicon of `turn_lines`, the corpus cut with it, and the core layer that comes of its tokens (`cleaned_core`).
_TURN = f"""{LEXICON.removeprefix(LINES + ',').replace('layer, ord FROM lines)', 'layer, ord FROM turn_lines)')},
{BLOCKS},{EDGES},{PATHS},{_FILTERED},{_BRANDS},{_COUNTS},
counted AS (SELECT word || ' ' || freq AS line FROM counts),{_cleaned('counted', 0.9, '_core')}"""


def _flag(**columns: str) -> str:
    return f"WITH {_WORDS} SELECT word, " + ", ".join(f"{sql} AS {name}" for name, sql in columns.items()) + " FROM words"


ORACLES = {
    "load_dictionary": f"""WITH {_MESSY}
SELECT doc_id, pos, f[1] AS word, CASE WHEN len(f) = 1 THEN 20000.0 ELSE coalesce({number('f[2]')}, 1.0) END AS freq
FROM (SELECT doc_id, pos, {fields('line')} AS f FROM messy) WHERE len(f) > 0""",
    "layered_lexicon": f"WITH {LEXICON} SELECT word, freq, round(logp, 6) AS logp, n FROM lexicon",
    "combine_layers": f"WITH {LINES} SELECT line, CAST(layer AS BIGINT) AS layer FROM lines",
    "write_dictionary": f"WITH {ENTRIES} SELECT word, freq FROM entries",
    "read_text_corpus": f"WITH {_MESSY} SELECT doc_id, {trim('line')} AS text FROM raw WHERE {trim('line')} <> ''",
    "write_segmented_corpus": f"""{_DAG},{_FILTERED}
SELECT doc_id, md5(array_to_string(ts, ' ')) AS line_md5, CAST(length(array_to_string(ts, ' ')) AS BIGINT) AS n_chars
FROM kept WHERE len(ts) > 0""",
    "load_tagger_model": f"WITH {ENTRIES},{MODEL} {_MODEL_ROWS}",
    "save_tagger_model": f"""WITH {ENTRIES},{MODEL}
SELECT 'T ' || substr('BMES', from_tag + 1, 1) || ' ' || substr('BMES', to_tag + 1, 1) || ' ' || printf('%.6f', weight) AS line FROM trans
UNION ALL SELECT 'F ' || feature || ' ' || substr('BMES', tag + 1, 1) || ' ' || printf('%.6f', weight) FROM feats""",
    "segment_lines": f"""{_DAG.replace(HAN_TEXT, trim(HAN_TEXT))}
SELECT doc_id, md5(line) AS line_md5, CAST(length(line) AS BIGINT) AS n_chars
FROM (SELECT doc_id, replace(rtrim(seg, chr(1)), chr(1), ' / ') AS line FROM tokens)""",
    "is_punctuation": _flag(is_punctuation=is_punct("word")),
    "contains_punctuation": _flag(contains_punctuation=has_punct("word")),
    "has_chinese": _flag(has_chinese=has_han("word")),
    "char_class": _flag(
        is_alnum=f"regexp_matches(word, '{PURE}')", has_alnum="regexp_matches(word, '[A-Za-z0-9]')",
        has_cjk=r"regexp_matches(word, '[\x{4E00}-\x{9FFF}]')", has_word_char=r"regexp_matches(word, '[A-Za-z0-9\x{4E00}-\x{9FFF}]')",
    ),
    "protected_suffix": _flag(protected=protected("word")),
    "reverse_word": _flag(reversed=reverse("word")),
    "split_blocks": f"WITH {BLOCKS} SELECT doc_id, pos, block, pure AS is_alnum FROM blocks",
    "letter_blocks": r"""
SELECT block, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS block FROM documents) GROUP BY block""",
    "noisy_brand_filter": f"WITH {LINES},{_BRANDS} SELECT word, freq FROM disc WHERE {_NOT_BRAND}",
    "load_brands": f"WITH {_MESSY} SELECT DISTINCT {trim('line')} AS brand FROM messy WHERE {trim('line')} <> ''",
    "word_ngrams": f"""WITH {discovered(HAN_TEXT, 1)}
SELECT word, count(*) AS n_blocks FROM disc_g GROUP BY word""",
    "bmes_tags": f"WITH {_HAN_WORDS} SELECT word, {_TAG_DIGITS.format(x='word')} AS tags FROM words",
    "tags_to_words": f"""WITH RECURSIVE {_LATIN_WORDS},
sent AS (
  SELECT word, c, list_transform(range(1, len(c) + 1), lambda i: (ord(c[i]) + (i - 1) * 7) % 4) AS t
  FROM (SELECT word, {_CHARS.format(x='word')} AS c FROM words)
),{_FOLD.format(id='word', source='sent')}
SELECT word, replace(rtrim(words, chr(1)), chr(1), '|') AS cut FROM folded""",
    "tagger_features": f"""WITH {_HAN_WORDS},
p AS (SELECT word, unnest(range(0, length(word))) AS i FROM words)
SELECT t.name || CASE WHEN i + d < 0 OR i + d >= length(word) THEN '_BOS_' ELSE substr(word, i + d + 1, 1) END AS feature, count(*) AS n
FROM p, (VALUES (-2, 'U00:'), (-1, 'U01:'), (0, 'U02:'), (1, 'U03:'), (2, 'U04:')) t(d, name) GROUP BY 1""",
    "word_lookup": f"""WITH {LEXICON},{discovered(HAN_TEXT, 2, name='asked')}
SELECT a.word, l.word IS NOT NULL AS known, coalesce(l.freq, 0.0) AS freq FROM asked a LEFT JOIN lexicon l ON l.word = a.word""",
    "word_logprob": f"""WITH {LEXICON},{discovered(HAN_TEXT, 2, name='asked')}
SELECT a.word, round(CASE WHEN l.word IS NULL THEN -20.0 ELSE l.logp END, 6) AS logp FROM asked a LEFT JOIN lexicon l ON l.word = a.word""",
    "lattice_edges": f"""WITH {LEXICON},{BLOCKS},{EDGES}
SELECT block, count(*) AS n_edges, CAST(sum(k) AS BIGINT) AS total_k, CAST(sum(source) AS BIGINT) AS total_source,
       round(sum(logp), 4) AS total_logp FROM edges GROUP BY block""",
    "noisy_extensions": f"WITH {LINES},{_SUMMED.replace('{source}', 'lines')},{_noise('summed', 'out_')} SELECT * FROM out_",
    "interference_candidates": f"WITH {_FEEDBACK},{_STRADDLE} SELECT word FROM candidates",
    "prune_interference": f"WITH {LINES},{_FEEDBACK},{_STRADDLE},{_USER},{_PRUNED.replace('{source}', 'user_lines')} SELECT line FROM pruned",
    "emission_scores": f"""WITH {ENTRIES},{BLOCKS},{MODEL},{EMISSIONS}
SELECT block, sum(score * (i + 1) * (tag + 1)) AS weighted, count(*) AS n FROM emissions GROUP BY block""",
    "discover_words": f"WITH {discovered('text', 5)} SELECT word, freq FROM disc",
    "token_counts": f"{_DAG},{_FILTERED},{_BRANDS},{_COUNTS} SELECT word, freq FROM counts",
    "sum_duplicates": f"WITH {_MESSY},{_SUMMED.replace('{source}', 'messy')} SELECT word, freq FROM summed",
    "perceptron_deltas": f"WITH {ENTRIES},{MODEL} {_MODEL_ROWS}",
    "sentence_accuracy": f"""WITH RECURSIVE {ENTRIES},{MODEL},
todo AS (SELECT DISTINCT word AS block FROM named),{EMISSIONS},{VITERBI}
SELECT round(avg(CASE WHEN tags = {_TAG_DIGITS.format(x='word')} THEN 1.0 ELSE 0.0 END), 9) AS accuracy
FROM named JOIN tagged ON tagged.block = named.word""",
    "dictionary_stats": f"WITH {LEXICON} SELECT total, size, max_len FROM stats",
    "prune_prefixes": f"WITH {LINES},{_SUMMED.replace('{source}', 'lines')},{_prefixes('summed', 'out_', 0.9)} SELECT * FROM out_",
    "prune_suffixes": f"WITH {LINES},{_SUMMED.replace('{source}', 'lines')},{_suffixes('summed', 'out_', 0.9)} SELECT * FROM out_",
    "clean_dictionary": f"WITH {LINES},{_cleaned('lines', 0.9)} SELECT * FROM cleaned",
    "ranked_core": f"{_DAG},{_FILTERED},{_BRANDS},{_COUNTS} SELECT word, freq FROM counts ORDER BY freq DESC, word",
    "merge_new_words": f"""WITH {_MESSY}
SELECT CASE WHEN w IS NULL THEN {trim('line')} ELSE w || ' 10000' END AS line FROM (
  SELECT line, unnest(CASE WHEN len(f) = 2 AND regexp_matches(f[2], '^[+-]?[0-9]+$') THEN [NULL] ELSE f END) AS w
  FROM (SELECT line, {fields('line')} AS f FROM messy)
)""",
    "cut_dag": f"{_DAG} {_DIGEST} FROM tokens",
    "best_path": f"{_DAG} SELECT block, rtrim(seg, chr(1)) AS path FROM paths",
    "cut_tagger": f"""{_TAGGED},{_SENT},
{_FOLD.format(id='block', source='sent')},
cut AS (SELECT doc_id, pos, CASE WHEN pure THEN block || chr(1) ELSE words END AS seg FROM blocks LEFT JOIN folded USING (block)),
tokens AS (SELECT doc_id, string_agg(seg, '' ORDER BY pos) AS seg FROM cut GROUP BY doc_id)
{_DIGEST} FROM tokens""",
    "cut_hybrid": f"{_HYBRID} {_DIGEST} FROM tokens2",
    "cut_search": f"""{_DAG},
toks AS (
  SELECT doc_id, i, t[i] AS tok FROM (
    SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, string_split(rtrim(seg, chr(1)), chr(1)) AS t FROM tokens)
  )
),
kinds AS (SELECT DISTINCT tok FROM toks WHERE length(tok) >= 3 AND NOT regexp_matches(tok, '{PURE}')),{_INNER},
out_ AS (SELECT doc_id, string_agg(coalesce(sub, '') || toks.tok || chr(1), '' ORDER BY i) AS seg FROM toks LEFT JOIN subs_of ON subs_of.tok = toks.tok GROUP BY doc_id)
{_DIGEST} FROM out_""",
    "viterbi_decode": f"{_TAGGED} SELECT block, tags FROM tagged",
    "tagger_words": f"""{_TAGGED},{_SENT},
{_FOLD.format(id='block', source='sent')}
SELECT block, rtrim(words, chr(1)) AS words FROM folded""",
    "segment_corpus": f"""{_DAG},{_FILTERED}
SELECT doc_id, CAST(len(ts) AS BIGINT) AS n_tokens, md5(array_to_string(ts, chr(1))) AS tokens_md5 FROM kept WHERE len(ts) > 0""",
    "corpus_to_sentences": f"""{_DAG},{_FILTERED},
w AS (SELECT doc_id, list_filter({fields("array_to_string(ts, ' ')")}, lambda x: NOT ({is_punct('x')})) AS ws FROM kept)
SELECT doc_id, CAST(length(array_to_string(ws, '')) AS BIGINT) AS n, md5(array_to_string(ws, '')) AS chars_md5,
       md5(array_to_string(list_transform(ws, lambda x: {_TAG_DIGITS.format(x='x')}), '')) AS tags_md5
FROM w WHERE len(ws) > 0""",
    "lexicon_to_sentences": f"""WITH {ENTRIES}
SELECT layer || ':' || ord AS sent_id, word AS chars, {_TAG_DIGITS.format(x='word')} AS tags FROM entries WHERE NOT ({is_punct('word')})""",
    "segmentation_report": f"""{_HYBRID.replace(_BLOCK_SOURCE, _REPORT_SOURCE)}
SELECT doc_id, md5(replace(rtrim(seg, chr(1)), chr(1), ' / ')) AS cut_md5,
       CAST(length(seg) - length(replace(seg, chr(1), '')) AS BIGINT) AS n_tokens FROM tokens2""",
    "report_metrics": f"""{_HYBRID.replace(_BLOCK_SOURCE, _REPORT_SOURCE)}
SELECT (SELECT count(*) FROM documents) + (SELECT count(*) FROM benchmark) AS texts,
       CAST((SELECT sum(length(text)) FROM documents) + (SELECT sum(length(text)) FROM benchmark) AS BIGINT) AS characters,
       CAST((SELECT sum(length(seg) - length(replace(seg, chr(1), ''))) FROM tokens2) AS BIGINT) AS tokens""",
    "segment_requests": f"""WITH RECURSIVE {LEXICON},{BLOCKS.replace(_BLOCK_SOURCE, _REQUEST_SOURCE)},{EDGES},{PATHS},{_PIECES},{MODEL},
{EMISSIONS.replace('FROM todo', 'FROM (SELECT block FROM todo UNION SELECT block FROM gaps)')},{VITERBI},{_SENT},
{_FOLD.format(id='block', source='sent')},{_JOINED},
asked AS (
  SELECT conv_id, turn, conv_id * 100000 + turn AS doc_id, turn % 3 = 0 AS search, ['dag', 'crf', 'hybrid', 'hybrid'][turn % 4 + 1] AS mode
  FROM conversations
),
answered AS (
  SELECT a.doc_id, a.search, b.pos,
         CASE WHEN pure THEN b.block || chr(1) WHEN mode = 'dag' THEN p.seg WHEN mode = 'crf' THEN f.words ELSE j.seg END AS seg
  FROM blocks b JOIN asked a ON a.doc_id = b.doc_id LEFT JOIN paths p ON p.block = b.block
  LEFT JOIN folded f ON f.block = b.block LEFT JOIN joined j ON j.block = b.block
),
toks AS (
  SELECT doc_id, search, pos, i, t[i] AS tok FROM (
    SELECT doc_id, search, pos, t, unnest(range(1, len(t) + 1)) AS i
    FROM (SELECT doc_id, search, pos, string_split(rtrim(seg, chr(1)), chr(1)) AS t FROM answered)
  )
),
kinds AS (SELECT DISTINCT tok FROM toks WHERE search AND length(tok) >= 3 AND NOT regexp_matches(tok, '{PURE}')),{_INNER},
told AS (
  SELECT doc_id, string_agg(CASE WHEN search THEN coalesce(sub, '') ELSE '' END || toks.tok || chr(1), '' ORDER BY pos, i) AS seg
  FROM toks LEFT JOIN subs_of ON subs_of.tok = toks.tok GROUP BY doc_id
)
SELECT conv_id, turn, CAST(coalesce(length(seg) - length(replace(seg, chr(1), '')), 0) AS BIGINT) AS n_tokens,
       md5(coalesce(rtrim(seg, chr(1)), '')) AS tokens_md5
FROM asked LEFT JOIN told USING (doc_id)""",
    "stream_feedback": f"""WITH {_PAIRS.format(source=f"(SELECT printf('1%010d%05d', conv_id, turn) AS o, turn AS num, {fields(HAN_TEXT)} AS f FROM conversations)")},
{_STRADDLE},user_lines AS (SELECT '' AS line, '' AS ord WHERE false),{_MERGED},{_PRUNED.replace('{source}', 'merged')},{_cleaned('pruned', 1000.0)}
SELECT word || ' ' || freq AS line FROM cleaned""",
    "absorb_feedback": f"""WITH {LINES},{_FEEDBACK},{_STRADDLE},{_USER},{_MERGED},{_PRUNED.replace('{source}', 'merged')},{_cleaned('pruned', 1000.0)}
SELECT * FROM cleaned""",
    "stream_log_filter": "SELECT conv_id, turn, text FROM conversations WHERE strlen(text) > 2",
    "stream_discover": f"""WITH logged AS (SELECT text FROM conversations WHERE strlen(text) > 2),
{discovered('text', 3, 'logged')} SELECT word, freq FROM disc""",
    "stream_segment": f"{_DAG} {_DIGEST} FROM tokens",
    "stream_segment_hybrid": f"{_HYBRID} {_DIGEST} FROM tokens2",
    "segment_lines_hybrid": f"""{_HYBRID.replace(HAN_TEXT, trim(HAN_TEXT))}
SELECT doc_id, md5(line) AS line_md5, CAST(length(line) AS BIGINT) AS n_chars
FROM (SELECT doc_id, replace(rtrim(seg, chr(1)), chr(1), ' / ') AS line FROM tokens2)""",
    "evolve_core": f"""WITH RECURSIVE {LINES},{_FEEDBACK},{_STRADDLE},
user_lines AS (SELECT line, '0' || ord AS ord FROM lines WHERE layer = 2),{_MERGED},{_PRUNED.replace('{source}', 'merged')},{_cleaned('pruned', 1000.0)},
turn_lines AS (
  SELECT line, layer, '0' || ord AS ord FROM lines WHERE layer < 2
  UNION ALL SELECT word || ' ' || freq, 0, '1' || word FROM disc UNION ALL SELECT word || ' ' || freq, 2, word FROM cleaned
),{_TURN}
SELECT 'core' AS part, word || ' ' || freq AS line FROM cleaned_core UNION ALL SELECT 'user', word || ' ' || freq FROM cleaned""",
    "stream_words_loop": f"""WITH RECURSIVE {LINES},
logged AS (SELECT text FROM conversations WHERE strlen({HAN_TEXT}) > 2),{discovered(HAN_TEXT, 3, 'logged', 'heard')},
heard_lines AS (SELECT word || ' ' || freq AS line FROM heard),{_cleaned('heard_lines', 1000.0)},
turn_lines AS (
  SELECT line, layer, '0' || ord AS ord FROM lines
  UNION ALL SELECT word || ' ' || freq, 0, '1' || word FROM disc UNION ALL SELECT word || ' ' || freq, 2, '1' || word FROM cleaned
),{_TURN}
SELECT 'user' AS part, word || ' ' || freq AS line FROM cleaned UNION ALL SELECT 'core', word || ' ' || freq FROM cleaned_core""",
}

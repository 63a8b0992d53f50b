"""DuckDB SQL giving the rows each query must give."""

from __future__ import annotations

from checks.fixtures import (
    ANNOTATED,
    FRAGMENTS,
    FRAG_TOKENS,
    PAIRS,
    SENTENCES,
    SHAPE,
    TOKENS,
    TOKEN_RE,
    WORDS,
    WS,
    fragments_sql,
    sql,
    sql_list,
)
from spanlake.functions.inventory import (
    COARSE_TYPES,
    HYPHEN_PRONOUNS,
    LABELS,
    LEADING_EDGE,
    TRAILING_EDGE,
)

ORACLES: dict[str, str] = {}

# Sources and sinks

ORACLES["corpus_scan"] = (
    "SELECT 'press_trn' AS corpus, 'doc_' || doc_id || '.norm.ne' AS doc_id, text FROM documents"
)

ORACLES["clean_lines"] = rf"""
SELECT doc_id, coalesce(array_to_string(list_filter(list_transform(string_split(text, chr(10)),
  lambda x: regexp_replace(x, '^[{WS}]+|[{WS}]+$', '', 'g')),
  lambda x: x <> '' AND NOT x LIKE '%.png'), chr(10)), '') AS text
FROM documents"""

ORACLES["read_columns"] = sql(TOKENS, """
SELECT data_set, string_agg(token, ' ' ORDER BY tok_id) AS text, string_agg(pos, '' ORDER BY tok_id) AS pos,
       string_agg(iob, ' ' ORDER BY tok_id) AS iob, count(*) AS n, count(*) AS last
FROM tokens GROUP BY data_set, doc_id, sent_id""")

ORACLES["read_pairs"] = sql(PAIRS, """
SELECT string_agg(token || ' ' || gold || ' ' || guess, '|' ORDER BY tok_id) AS lines, count(*) AS n, count(*) AS last
FROM pairs GROUP BY doc_id, sent_id""")

ORACLES["width_check"] = sql(PAIRS, """,
lines_of AS (
  SELECT doc_id, tok_id, false AS is_end, sent_id FROM pairs
  UNION ALL SELECT doc_id, max(tok_id) + 1, true, sent_id FROM pairs GROUP BY doc_id, sent_id),
widths AS (
  SELECT CASE WHEN is_end AND sent_id % 3 = 1 THEN CASE WHEN doc_id % 50 = 0 THEN 1 ELSE 0 END
              WHEN is_end AND sent_id % 3 = 2 THEN 0
              ELSE CASE WHEN tok_id > 1 AND doc_id % 50 = 0 THEN 4 ELSE 3 END END AS width FROM lines_of)
SELECT width::BIGINT AS width, width = 3 AS ok, count(*) AS lines FROM widths WHERE width > 0 GROUP BY width""")

ORACLES["format_columns"] = sql(TOKENS, """
SELECT data_set, doc_id, sent_id, tok_id AS line_id, concat_ws(chr(9), tok_id, token, pos, iob) AS line FROM tokens
UNION ALL SELECT DISTINCT data_set, doc_id, sent_id, 0, '' FROM tokens
UNION ALL SELECT data_set, doc_id, min(sent_id), -1, '# FILE: ' || doc_id FROM tokens GROUP BY data_set, doc_id
UNION ALL SELECT data_set, doc_id, max(sent_id), 9223372036854775807, '' FROM tokens GROUP BY data_set, doc_id""")

# Scoring: flags by lag over every token, a virtual outside token after each
# sentence, and the match state as the last opening or closing event.


def _end(prev: str, cur: str) -> str:
    return f"""({prev}_p || ':' || {cur}_p IN ('B:B', 'B:O', 'I:B', 'I:O', 'E:E', 'E:I', 'E:O')
      OR ({prev}_p NOT IN ('O', '.') AND {prev}_t <> {cur}_t) OR {prev}_p IN ('[', ']'))"""


def _start(prev: str, cur: str) -> str:
    return f"""({prev}_p || ':' || {cur}_p IN ('B:B', 'I:B', 'O:B', 'O:I', 'E:E', 'E:I', 'O:E')
      OR ({cur}_p NOT IN ('O', '.') AND {prev}_t <> {cur}_t) OR {cur}_p IN ('[', ']'))"""


def _type(tag: str) -> str:
    return f"CASE WHEN {tag} LIKE '%-%' AND {tag} NOT LIKE '%-0' THEN substr({tag}, instr({tag}, '-') + 1) ELSE '' END"


FLAGS = PAIRS + [
    f"""parts AS (
  SELECT doc_id, source, sent_id, tok_id, gold, guess, true AS real,
         split_part(gold, '-', 1) AS g_p, {_type('gold')} AS g_t, split_part(guess, '-', 1) AS h_p, {_type('guess')} AS h_t
  FROM pairs
  UNION ALL SELECT doc_id, source, sent_id, max(tok_id) + 1, 'O', 'O', false, 'O', '', 'O', ''
  FROM pairs GROUP BY doc_id, source, sent_id)""",
    """lagged AS (
  SELECT *, coalesce(lag(g_p) OVER w, 'O') AS lg_p, coalesce(lag(g_t) OVER w, '') AS lg_t,
         coalesce(lag(h_p) OVER w, 'O') AS lh_p, coalesce(lag(h_t) OVER w, '') AS lh_t
  FROM parts WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY tok_id))""",
    f"""flags AS (
  SELECT *, {_start('lg', 'g')} AS gs, {_end('lg', 'g')} AS ge, {_start('lh', 'h')} AS hs, {_end('lh', 'h')} AS he FROM lagged)""",
    """events AS (
  SELECT *, CASE WHEN gs AND hs AND g_t = h_t THEN true WHEN ge OR he OR g_t <> h_t THEN false END AS ev FROM flags)""",
    """states AS (
  SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before,
            coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS state
  FROM events)""",
]


def _counts(by: str = "") -> list[str]:
    return FLAGS + [
        f"""hits AS (
  SELECT {by} g_t AS type, 1 AS gold, 0 AS guessed, 0 AS correct FROM states WHERE gs
  UNION ALL SELECT {by} h_t, 0, 1, 0 FROM states WHERE hs
  UNION ALL SELECT {by} lg_t, 0, 0, 1 FROM states WHERE before AND ge AND he)""",
        f"""counts AS (
  SELECT {by} CASE WHEN grouping(type) = 1 THEN '(overall)' ELSE type END AS type, sum(gold)::BIGINT AS gold,
         sum(guessed)::BIGINT AS guessed, sum(correct)::BIGINT AS correct
  FROM hits GROUP BY GROUPING SETS (({by} type), ({by.rstrip(', ')})))""",
        f"""rates AS (
  SELECT *, CASE WHEN guessed > 0 THEN 100 * correct::DOUBLE / guessed ELSE 0.0::DOUBLE END AS precision,
            CASE WHEN gold > 0 THEN 100 * correct::DOUBLE / gold ELSE 0.0::DOUBLE END AS recall FROM counts)""",
        f"""scores AS (
  SELECT {by} type, gold, guessed, correct, precision, recall,
         CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1
  FROM rates)""",
    ]


SCORES = _counts()
ORACLES["score"] = sql(SCORES, "SELECT * FROM scores")
ORACLES["score_by_corpus"] = sql(_counts("source, "), "SELECT * FROM scores")
ORACLES["chunk_counts"] = sql(SCORES, "SELECT type, gold, guessed FROM scores")
ORACLES["correct_chunks"] = sql(SCORES, "SELECT type, correct FROM scores")
ORACLES["chunk_flags"] = sql(FLAGS, """
SELECT doc_id, sent_id, tok_id, gold, guess, gs AS gold_start, ge AS gold_end, hs AS guess_start, he AS guess_end
FROM flags WHERE real""")
ORACLES["match_state"] = sql(FLAGS, """,
nexts AS (
  SELECT *, lead(before AND ge AND he) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_id) AS hit FROM states)
SELECT doc_id, sent_id, tok_id, state, hit FROM nexts WHERE real AND NOT (gold = 'O' AND guess = 'O')""")
ORACLES["token_accuracy"] = sql(FLAGS, """
SELECT source, count(*) AS tokens, count(*) FILTER (g_p = h_p AND g_t = h_t) AS matched,
       100 * (count(*) FILTER (g_p = h_p AND g_t = h_t))::DOUBLE / count(*) AS accuracy
FROM parts WHERE real GROUP BY source""")
ORACLES["chunk_spans"] = sql(FLAGS, """,
numbered AS (
  SELECT *, sum(gs::INT) OVER w AS chunk, lead(ge) OVER w AS closes, lead(gs) OVER w AS restarts
  FROM flags WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY tok_id))
SELECT doc_id, sent_id, min(tok_id) AS start, coalesce(min(tok_id) FILTER (closes), max(tok_id)) AS "end",
       arg_min(g_t, tok_id) AS type
FROM numbered WHERE real AND chunk > 0 AND gold <> 'O' GROUP BY doc_id, sent_id, chunk""")
ORACLES["score_report"] = sql(SCORES, """,
acc AS (
  SELECT count(*) AS n, 100 * (count(*) FILTER (g_p = h_p AND g_t = h_t))::DOUBLE / count(*) AS a FROM parts WHERE real),
report AS (
  SELECT 0 AS part, '' AS type, printf('processed %d tokens with %d phrases; found: %d phrases; correct: %d.', n, gold, guessed, correct) AS line
  FROM scores, acc WHERE type = '(overall)'
  UNION ALL SELECT 1, '', printf('accuracy: %6.2f%%; precision: %6.2f%%; recall: %6.2f%%; FB1: %6.2f', a, precision, recall, f1)
  FROM scores, acc WHERE type = '(overall)'
  UNION ALL SELECT 2, type, printf('%17s: precision: %6.2f%%; recall: %6.2f%%; FB1: %6.2f  %d', type, precision, recall, f1, guessed)
  FROM scores WHERE type <> '(overall)')
SELECT row_number() OVER (ORDER BY part, type) AS line_no, line FROM report""")
ORACLES["score_report_latex"] = sql(SCORES, r""",
body AS (
  SELECT 1 AS part, type, lead(type) OVER (ORDER BY type) IS NULL AS last,
         printf('%-7s &  %6.2f\%% & %6.2f\%% & %6.2f \\', type, precision, recall, f1) AS line
  FROM scores WHERE type <> '(overall)'),
report AS (
  SELECT 0 AS part, '' AS type, '        & Precision &  Recall  & F$_{\beta=1} \\\hline' AS line
  UNION ALL SELECT part, type, line || CASE WHEN last THEN '\hline' ELSE '' END FROM body
  UNION ALL SELECT 2, type, printf('Overall &  %6.2f\%% & %6.2f\%% & %6.2f \\\hline', precision, recall, f1)
  FROM scores WHERE type = '(overall)')
SELECT row_number() OVER (ORDER BY part, type) AS line_no, line FROM report""")

# Text repair


def _escaped(col: str, parts: str) -> str:
    return rf"""array_to_string(list_transform({parts}, lambda x, i: CASE WHEN i = 1 THEN x
      WHEN i < len({parts}) AND NOT regexp_matches(x, '[{WS}>]') THEN '<' || x
      WHEN list_contains({sql_list(LABELS)}, regexp_extract(x, '^/?([^{WS}>]*)', 1)) THEN '<' || x
      ELSE '*' || x END), '') AS {col}"""


ORACLES["escape_tags"] = f"""
WITH a AS (SELECT page_id, string_split(html, '<') AS q FROM pages),
b AS (SELECT page_id, {_escaped('once', 'q')} FROM a),
c AS (SELECT page_id, string_split(once, '<') AS q FROM b)
SELECT page_id, {_escaped('html', 'q')} FROM c"""

ORACLES["unwrap_lines"] = rf"""
WITH a AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
    lambda x: regexp_replace(x, '^[{WS}]+|[{WS}]+$', '', 'g')), lambda x: x <> '' AND NOT x LIKE '%.png') AS q FROM documents)
SELECT doc_id, coalesce(array_to_string(list_transform(q, lambda x, i: x || CASE WHEN i = len(q) THEN ''
  WHEN regexp_matches(x, '([.!?A-Z]|\.[{WS}]?»)$') OR regexp_matches(q[i + 1], '^[A-Z]') THEN chr(10) ELSE ' ' END), ''), '') AS text
FROM a"""

ORACLES["break_punct"] = rf"""
WITH a AS (SELECT doc_id, string_split(trim(regexp_replace(text, '[{WS}]+', ' ', 'g')), ' ') AS q FROM documents)
SELECT doc_id, coalesce(array_to_string(list_transform(q, lambda x, i: x || CASE WHEN i = len(q) THEN ''
  WHEN regexp_matches(x, '[.!?]$') AND NOT regexp_matches(q[i + 1], '^[a-z<]') THEN chr(10) ELSE ' ' END), ''), '') AS text
FROM a"""

ORACLES["dehyphenate"] = sql(WORDS, rf""",
joined AS (
  SELECT doc_id, sent_id, tok_id, CASE
    WHEN length(token) >= 6 AND (tok_id - 1) % 4 = 0 THEN
      CASE WHEN NOT regexp_matches(substr(token, 3, 1), '[\p{{L}}\p{{N}}_]') OR NOT regexp_matches(substr(token, 4, 1), '[\p{{L}}\p{{N}}_]')
             THEN substr(token, 1, 3) || '- ' || substr(token, 4)
           WHEN list_contains({sql_list(HYPHEN_PRONOUNS)}, regexp_extract(substr(token, 4), '^[\p{{L}}\p{{N}}_]+'))
             THEN substr(token, 1, 3) || '-' || substr(token, 4)
           ELSE token END
    WHEN (tok_id - 1) % 7 = 0 THEN CASE WHEN regexp_matches(token, '[\p{{L}}\p{{N}}_]$') THEN token || '-il' ELSE token || '- il' END
    ELSE token END AS w FROM words)
SELECT doc_id, sent_id::BIGINT AS sent_id, string_agg(w, ' ' ORDER BY tok_id) AS text FROM joined GROUP BY doc_id, sent_id""")

ORACLES["squash_ws"] = rf"""
SELECT page_id, trim(regexp_replace(replace(html, '>', '> '), '[{WS}]+', ' ', 'g')) AS html FROM pages"""

ORACLES["case_majority"] = sql(WORDS, r"""
SELECT doc_id, sent_id::BIGINT AS sent_id,
       len(regexp_extract_all(line, '\p{Lu}')) > len(regexp_extract_all(line, '\p{Ll}')) AS upper
FROM lines WHERE trim(line) <> ''""")

# Tags

ORACLES["split_tags"] = sql(FLAGS, """
SELECT doc_id, sent_id, tok_id, gold, guess, g_p AS gold_prefix, g_t AS gold_type, h_p AS guess_prefix, h_t AS guess_type
FROM parts WHERE real""")
ORACLES["raw_tags"] = sql(FLAGS, """
SELECT doc_id, sent_id, tok_id, CASE WHEN gold = 'O' THEN 'O' ELSE 'B-' || g_t END AS gold,
       CASE WHEN guess = 'O' THEN 'O' ELSE 'B-' || h_t END AS guess
FROM parts WHERE real""")
_COARSE = "split_part(substr(iob, 3), '.', 1)"
ORACLES["coarse_types"] = sql(TOKENS, f"""
SELECT doc_id, sent_id, tok_id, {_COARSE} AS type, list_contains({sql_list(COARSE_TYPES)}, {_COARSE}) AS valid
FROM tokens WHERE iob <> 'O'""")

ORACLES["references"] = "SELECT doc_id, replace(replace(text, 'k', 'ü'), 'j', '&nosuch;') AS text FROM documents"

# Fragments, sentences, labels

ORACLES["fragments"] = sql(FRAGMENTS, "SELECT * FROM frags")
LENIENT = [
    """final AS (SELECT doc_id, max(sent_id) AS sent_id, max_by(tok_id, sent_id * 100000 + tok_id) AS tok_id FROM tagged GROUP BY doc_id)""",
    """ended AS (
  SELECT doc_id, sent_id, tok_id, token, p, ty FROM tagged
  UNION ALL SELECT doc_id, sent_id, tok_id + 1, 'x', 'O', '' FROM final WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, sent_id, tok_id + 1, 'x', 'B', 'title' FROM final WHERE doc_id % 4 = 1
  UNION ALL SELECT doc_id, sent_id, tok_id + 1, 'ab', 'B', 'day' FROM final WHERE doc_id % 4 = 2
  UNION ALL SELECT doc_id, sent_id, tok_id + 2, 'c', 'O', '' FROM final WHERE doc_id % 4 = 2)""",
]
_PLAIN_FRAGMENTS = fragments_sql(False)
_NEAR = next(i for i, cte in enumerate(_PLAIN_FRAGMENTS) if cte.startswith("near AS"))
ORACLES["fragments_lenient"] = sql(
    [*_PLAIN_FRAGMENTS[:_NEAR], *LENIENT, *(c.replace("FROM tagged WINDOW", "FROM ended WINDOW") for c in _PLAIN_FRAGMENTS[_NEAR:])],
    "SELECT * FROM frags",
)
ORACLES["corrections"] = sql(fragments_sql(True), "SELECT * FROM frags")
ORACLES["markup_errors"] = sql(ANNOTATED, """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END::BIGINT AS unclosed,
       CASE doc_id % 4 WHEN 0 THEN -1 ELSE 0 END::BIGINT AS min_depth,
       CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END::BIGINT AS faults
FROM annotated WHERE doc_id % 4 <> 3""")
ORACLES["sentence_assembly"] = sql(SENTENCES, "SELECT doc_id, frag_id, sent_id FROM sents")
ORACLES["tokenize"] = sql(WORDS, f"""
SELECT doc_id, sent_id::BIGINT AS sent_id, generate_subscripts(ts, 1) AS tok_id, unnest(ts) AS token
FROM (SELECT doc_id, sent_id, regexp_extract_all(line, '{TOKEN_RE}') AS ts FROM lines WHERE trim(line) <> '')""")
ORACLES["label_tokens"] = sql(FRAG_TOKENS, """
SELECT doc_id, frag_id, i AS tok_id, token,
       CASE WHEN label IS NULL THEN 'O' WHEN i = 1 THEN 'B-' || label ELSE 'I-' || label END AS iob FROM toks""")


def _trimmed(lists: str) -> str:
    lead, trail = sql_list(LEADING_EDGE), sql_list(TRAILING_EDGE)
    return f"""bounds AS (
  SELECT *, CASE WHEN list_contains({lead}, ts[1]) THEN CASE WHEN coalesce(list_contains({lead}, ts[2]), false) THEN 3 ELSE 2 END ELSE 1 END AS lo,
         n - CASE WHEN list_contains({trail}, ts[n]) THEN CASE WHEN n > 1 AND list_contains({trail}, ts[n - 1]) THEN 2 ELSE 1 END ELSE 0 END AS hi
  FROM {lists})"""


_IOB = "CASE WHEN label IS NULL OR i < lo OR i > hi THEN 'O' WHEN i = lo THEN 'B-' || label ELSE 'I-' || label END"
ORACLES["trim_edges"] = sql(SENTENCES + [
    f"""dressed AS (
  SELECT doc_id, sent_id, frag_id, label, CASE WHEN label IS NULL THEN text WHEN frag_id % 3 = 0 THEN '« (' || text || ') .'
    WHEN frag_id % 3 = 1 THEN 'l''' || text ELSE text || ' !' END AS text FROM sents)""",
    f"""toks AS (
  SELECT doc_id, frag_id, label, ts, len(ts) AS n, unnest(ts) AS token, generate_subscripts(ts, 1) AS i
  FROM (SELECT *, regexp_extract_all(text, '{TOKEN_RE}') AS ts FROM dressed))""",
    _trimmed("toks"),
], f"SELECT doc_id, frag_id, i AS tok_id, token, {_IOB} AS iob FROM bounds")
ORACLES["number_tokens"] = sql(FRAG_TOKENS + [_trimmed("toks")], f"""
SELECT doc_id, sent_id, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY frag_id, i) AS tok_id, token, {_IOB} AS iob
FROM bounds""")
ORACLES["annotate_hook"] = sql(TOKENS, "SELECT doc_id, sent_id, tok_id, token, pos FROM tokens")

# The whole first job: line repair between lines and between words, a parse by
# nesting depth, then sentences and labels as above.
_REPAIRED = ANNOTATED + [
    """cut AS (SELECT doc_id, string_split(text, chr(10)) AS q FROM annotated)""",
    rf"""unwrapped AS (
  SELECT doc_id, array_to_string(list_transform(q, lambda x, i: x || CASE WHEN i = len(q) THEN ''
    WHEN regexp_matches(x, '([.!?A-Z]|\.[{WS}]?»)$') OR regexp_matches(q[i + 1], '^[A-Z]') THEN chr(10) ELSE ' ' END), '') AS text FROM cut)""",
    """spaced AS (
  SELECT doc_id, string_split_regex(text, '[ \\n]+') AS w, regexp_extract_all(text, '[ \\n]+') AS s FROM unwrapped)""",
    """broken AS (
  SELECT doc_id, array_to_string(list_transform(w, lambda x, i: x || CASE WHEN i = len(w) THEN ''
    WHEN regexp_matches(x, '[.!?]$') AND NOT regexp_matches(w[i + 1], '^[a-z<]') THEN chr(10) ELSE s[i] END), '') AS text FROM spaced)""",
    r"""joined_halves AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(text, '([\p{L}\p{N}_])- ([\p{L}\p{N}_])', '\1\2', 'g'), '<[^>]*>|[^<]+') AS ps FROM broken)""",
    """pieces AS (
  SELECT doc_id, unnest(ps) AS x, generate_subscripts(ps, 1) AS pos FROM joined_halves)""",
    """depths AS (
  SELECT *, sum(step) OVER (PARTITION BY doc_id ORDER BY pos) AS depth
  FROM (SELECT *, CASE WHEN x LIKE '</%' THEN -1 WHEN x LIKE '<%' THEN 1 ELSE 0 END AS step FROM pieces))""",
    """runs AS (
  SELECT *, sum(CASE WHEN (step = 1 AND depth = 1) OR (step = -1 AND depth = 0) THEN 1 ELSE 0 END)
            OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM depths)""",
    """contents AS (
  SELECT doc_id, run, max(CASE WHEN step = 1 AND depth = 1 THEN regexp_extract(x, '^<([^ >]+)', 1) END) AS label,
         replace(string_agg(CASE WHEN step = 0 THEN x ELSE '' END, '' ORDER BY pos), '&amp;', '&') AS text
  FROM runs GROUP BY doc_id, run)""",
    f"""parts AS (
  SELECT doc_id, run, nullif(label, 'noisy-entities') AS label, generate_subscripts(q, 1) AS line,
         trim(regexp_replace(unnest(q), '[{WS}]+', ' ', 'g')) AS text
  FROM (SELECT *, CASE WHEN run % 2 = 0 THEN string_split(text, chr(10)) ELSE [text] END AS q FROM contents))""",
    """frags AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run, line) AS frag_id, text, label FROM parts WHERE text <> '')""",
    *FRAG_TOKENS[len(FRAGMENTS):],
    _trimmed("toks"),
]
ORACLES["documents_to_tokens"] = sql(_REPAIRED, f"""
SELECT doc_id, sent_id, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY frag_id, i) AS tok_id, token, {_IOB} AS iob,
       {SHAPE.format('token')} AS pos
FROM bounds""")

ORACLES["align_pairs"] = sql(PAIRS, """,
pred AS (
  SELECT doc_id, sent_id, CASE WHEN (doc_id + sent_id + tok_id) % 11 = 1 THEN tok_id + 1000000 ELSE tok_id END AS tok_id, guess
  FROM pairs WHERE (doc_id + sent_id + tok_id) % 11 <> 0)
SELECT coalesce(p.doc_id, q.doc_id) AS doc_id, coalesce(p.sent_id, q.sent_id) AS sent_id, coalesce(p.tok_id, q.tok_id) AS tok_id,
       p.gold, q.guess, CASE WHEN q.doc_id IS NULL THEN 'gold_only' WHEN p.doc_id IS NULL THEN 'guess_only' ELSE 'matched' END AS status
FROM pairs p FULL JOIN pred q ON p.doc_id = q.doc_id AND p.sent_id = q.sent_id AND p.tok_id = q.tok_id""")

_WHOLE = """whole AS (
  SELECT * FROM pairs ANTI JOIN (
    SELECT DISTINCT doc_id, sent_id FROM pairs WHERE (doc_id + sent_id + tok_id) % 11 IN (0, 1)) USING (doc_id, sent_id))"""
ORACLES["score_aligned"] = sql(
    [*PAIRS, _WHOLE, *(cte.replace("FROM pairs", "FROM whole") for cte in SCORES[len(PAIRS):])], "SELECT * FROM scores"
)

# Mentions and statistics

MENTIONS = TOKENS + [
    """segments AS (
  SELECT *, sum(CASE WHEN iob[1] = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_id) AS seg FROM tokens)""",
    """runs AS (
  SELECT data_set, doc_id, sent_id, min(tok_id) AS first_tok, arg_min(iob, tok_id) AS tag,
         string_agg(token, ' ' ORDER BY tok_id) AS tokens, string_agg(pos, ' ' ORDER BY tok_id) AS pos, count(*) AS n_tokens
  FROM segments GROUP BY data_set, doc_id, sent_id, seg)""",
    f"""mentions AS (
  SELECT data_set, doc_id, sent_id, first_tok, split_part(substr(tag, 3), '.', 1) AS type, substr(tag, 3) AS subtype,
         tokens, pos, n_tokens, length(tokens) AS n_characters
  FROM runs WHERE tag[1] = 'B' AND list_contains({sql_list(COARSE_TYPES)}, split_part(substr(tag, 3), '.', 1)))""",
]
ORACLES["mentions"] = sql(MENTIONS, "SELECT * FROM mentions")
ORACLES["mentions_by_type"] = sql(MENTIONS, "SELECT * FROM mentions WHERE type = 'pers'")
ORACLES["faulty_labels"] = sql(TOKENS, f"""
SELECT {_COARSE} AS label, count(*) AS n FROM tokens
WHERE iob[1] = 'B' AND NOT list_contains({sql_list(COARSE_TYPES)}, {_COARSE}) GROUP BY 1""")
ORACLES["token_counts"] = sql(TOKENS, "SELECT data_set, count(*) AS n_tokens FROM tokens GROUP BY data_set")


def _crosstab(value: str, longest: int) -> str:
    cells = ", ".join(
        f"(count(*) FILTER (least({value}, {longest}) = {i}))::DOUBLE AS len_{i}" for i in range(longest + 1)
    )
    shares = ", ".join(f"round_even(len_{i} * 100 / total * 100, 0) / 100 AS len_{i}" for i in range(longest + 1))
    names = ", ".join(f"len_{i}" for i in range(longest + 1))
    return sql(MENTIONS, f""",
by_type AS (SELECT type, {cells}, count(*)::DOUBLE AS total FROM mentions GROUP BY type),
shared AS (SELECT *, round_even(total * 100 / (SELECT sum(total) FROM by_type) * 100, 0) / 100 AS percent FROM by_type),
sums AS (SELECT {cells}, count(*)::DOUBLE AS total FROM mentions)
SELECT type, {names}, total, percent FROM shared
UNION ALL SELECT '(total)', {names}, total, (SELECT round_even(sum(percent) * 100, 0) / 100 FROM shared) FROM sums
UNION ALL SELECT '(percent)', {shares}, NULL, NULL FROM sums""")


ORACLES["length_crosstab_tokens"] = _crosstab("n_tokens", 8)
ORACLES["length_crosstab_chars"] = _crosstab("n_characters", 25)


def _histogram(value: str, edges: list[int]) -> str:
    step = edges[1] - edges[0]
    bins = len(edges) - 1
    labels = [f"{a}-{b - 1}" for a, b in zip(edges[:-2], edges[1:])] + [f"{edges[-2]}+"]
    return sql(MENTIONS, f""",
grid AS (SELECT * FROM unnest({sql_list(COARSE_TYPES)}) t(type), range({bins}) r(bin)),
found AS (SELECT type, least(({value} - {edges[0]}) // {step}, {bins - 1}) AS bin, count(*) AS n FROM mentions GROUP BY ALL)
SELECT type, bin, {sql_list(labels)}[bin + 1] AS label, coalesce(n, 0) AS n FROM grid LEFT JOIN found USING (type, bin)""")


ORACLES["length_hist_chars"] = _histogram("n_characters", list(range(0, 35, 5)))
ORACLES["length_hist_tokens"] = _histogram("n_tokens", list(range(0, 12, 2)))
ORACLES["tag_dictionary"] = sql(TOKENS, """
SELECT tag, row_number() OVER (ORDER BY tag) - 1 AS id FROM (SELECT DISTINCT iob AS tag FROM tokens)""")
ORACLES["corpus_summary"] = sql(TOKENS, """
SELECT data_set, count(*) AS sentences, sum(n)::BIGINT AS tokens, max(n) AS longest
FROM (SELECT data_set, doc_id, sent_id, count(*) AS n FROM tokens GROUP BY ALL) GROUP BY data_set""")

# Splits

PLAIN = TOKENS + [
    """plain AS (
  SELECT doc_id, sent_id, string_agg(token, ' ' ORDER BY tok_id) AS text FROM tokens GROUP BY doc_id, sent_id)"""
]
SPLIT = PLAIN + [
    """ranked AS (
  SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id || ':' || sent_id), doc_id, sent_id) - 1 AS rank, count(*) OVER () AS n FROM plain)""",
    """sized AS (SELECT *, floor(0.8::DOUBLE * n)::BIGINT AS n_train FROM ranked)""",
    """split AS (
  SELECT *, CASE WHEN rank < n_train THEN 'train' WHEN rank < n_train + floor(0.5::DOUBLE * (n - n_train))::BIGINT THEN 'valid'
            ELSE 'test' END AS split, floor(0.01::DOUBLE * n_train)::BIGINT AS size FROM sized)""",
    """shards AS (
  SELECT doc_id, sent_id, rank, split, text, CASE WHEN split <> 'train' THEN 0 WHEN size = 0 THEN 101 ELSE rank // size + 1 END::BIGINT AS shard FROM split)""",
]
ORACLES["plain_sentences"] = sql(PLAIN, "SELECT * FROM plain")
ORACLES["corpus_split"] = sql(SPLIT, "SELECT doc_id, sent_id, rank, split, text FROM split")
ORACLES["train_shards_equal"] = sql(SPLIT, "SELECT doc_id, sent_id, rank, split, shard FROM shards WHERE shard <= 100")
EVEN = "CASE WHEN split = 'train' THEN rank * 100 // n_train + 1 ELSE 0 END::BIGINT AS shard"
ORACLES["train_shards"] = sql(SPLIT, f"SELECT doc_id, sent_id, rank, split, {EVEN} FROM split")
ORACLES["split_files"] = sql(SPLIT, f"SELECT split, {EVEN}, text FROM split")
ORACLES["union_corpora"] = sql(PAIRS, """
SELECT data_set, iob, count(*) AS n
FROM (SELECT 'gold' AS data_set, gold AS iob FROM pairs UNION ALL SELECT 'guess', guess FROM pairs) GROUP BY ALL""")

# Characters

ORACLES["char_inventory"] = """
WITH c AS (SELECT char, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS char FROM documents) WHERE char <> '' GROUP BY char)
SELECT char, n, row_number() OVER (ORDER BY n DESC, char) - 1 AS id FROM c"""
ORACLES["char_coverage"] = """
WITH v AS (SELECT DISTINCT char FROM (SELECT unnest(string_split(text, '')) AS char FROM benchmark) WHERE char <> ''),
c AS (SELECT char, count(*) AS n FROM (SELECT unnest(string_split(html, '')) AS char FROM pages) WHERE char <> '' GROUP BY char)
SELECT sum(n)::BIGINT AS chars, sum(CASE WHEN v.char IS NOT NULL THEN n ELSE 0 END)::BIGINT AS covered,
       sum(CASE WHEN v.char IS NOT NULL THEN n ELSE 0 END)::BIGINT * 100::DOUBLE / sum(n)::BIGINT AS share
FROM c LEFT JOIN v USING (char)"""


def _sequences(value: str) -> str:
    return sql(PLAIN, f"""
SELECT doc_id, sent_id, i AS piece, substr(t, i * 250 + 1, 250) AS chars
FROM (SELECT doc_id, sent_id, {value} AS t, unnest(range((length(text) + 249) // 250)) AS i FROM plain)""")


ORACLES["char_sequences"] = _sequences("text")
ORACLES["char_sequences_backward"] = _sequences("reverse(text)")
ORACLES["char_ids"] = sql(PLAIN, """,
counted AS (SELECT char, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS char FROM benchmark) WHERE char <> '' GROUP BY char),
vocab AS (SELECT char, row_number() OVER (ORDER BY n DESC, char) - 1 AS id FROM counted),
cut AS (
  SELECT doc_id, sent_id, i AS piece, substr(text, i * 250 + 1, 250) AS chars
  FROM (SELECT doc_id, sent_id, text, unnest(range((length(text) + 249) // 250)) AS i FROM plain)),
each AS (SELECT doc_id, sent_id, piece, unnest(string_split(chars, '')) AS char, generate_subscripts(string_split(chars, ''), 1) AS k FROM cut)
SELECT doc_id, sent_id, piece, string_agg(coalesce(id, (SELECT count(*) FROM vocab))::VARCHAR, ' ' ORDER BY k) AS ids
FROM each LEFT JOIN vocab USING (char) GROUP BY doc_id, sent_id, piece""")

# Whole jobs from files

ORACLES["files_to_statistics"] = sql(MENTIONS, """
SELECT data_set, type, subtype, count(*) AS n, sum(n_tokens)::BIGINT AS tokens, sum(n_characters)::BIGINT AS characters
FROM mentions GROUP BY data_set, type, subtype""")
ORACLES["files_to_shards"] = sql(SPLIT, f"SELECT split, {EVEN}, count(*) AS n FROM split GROUP BY ALL")

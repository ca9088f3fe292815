"""SQL (DuckDB's) for the text stage: sections, cleaning, turns and chunks, over lines as rows."""

from tonewake.plans.tables import TRANSCRIPTS_SQL

EDGES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
# The phrases that go, as RE2 writes them.
PHRASES = (
    r"\[Operator Instructions\]",
    r"(?:your|the) (?:line is (?:now )?open|phone line is open)",
    r"please (?:go ahead|proceed|ask your question)",
    r"(?:thank you for (?:standing by|holding|joining)|ladies and gentlemen,? (?:thank you|good (?:morning|afternoon|evening)))",
    r"(?:this (?:call|conference|discussion) (?:may |will )?contain[s]? forward-looking statements?[^.]*\.)",
    r"(?:intended to qualify for the safe harbor[^.]*\.)",
    r"(?:this (?:call|conference) is being recorded[^.]*\.)",
    r"(?:a (?:webcast |audio )?replay of this (?:call|conference)[^.]*\.)",
)


def strip(x: str) -> str:
    return f"trim({x}, {EDGES})"


def cleaned(x: str) -> str:
    for phrase in PHRASES:
        x = f"regexp_replace({x}, '{phrase}', '', 'gi')"
    lines = f"list_transform(string_split({x}, chr(10)), lambda v: regexp_replace({strip('v')}, ' {{2,}}', ' ', 'g'))"
    return strip(f"regexp_replace(array_to_string({lines}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def tokens(x: str) -> str:
    return f"greatest(1, CAST(round(length({x}) / 4.5) AS BIGINT))"


def sentences(x: str) -> str:
    return f"string_split(regexp_replace({strip(x)}, '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(30))"


#: l: lines; b: bodies; c: where Q&A begins; halves: a row for each section.
_SECTIONS = rf"""{TRANSCRIPTS_SQL}, l AS (SELECT conv_id, string_split(transcript_text, chr(10)) AS ls FROM transcripts),
 f AS (SELECT conv_id, ls[1:coalesce(nullif(list_position(list_transform(ls, lambda x: regexp_matches({strip('x')}, '(?i)^(Duration:\s*\d+|Call participants:|More \w+ analysis|All earnings call transcripts|\[Operator Closing Remarks\])')), true), 0), len(ls) + 1) - 1] AS ls FROM l),
 b AS (SELECT conv_id, CASE WHEN regexp_matches({strip('ls[1]')}, '(?i)^Prepared Remarks:$') THEN ls[2:] ELSE ls END AS ls FROM f),
 h AS (SELECT conv_id, ls, nullif(list_position(list_transform(ls, lambda x: regexp_matches({strip('x')}, '(?i)^(Questions and Answers:|Questions & Answers:|Question-and-Answer Session|Questions and Answers)$')), true), 0) AS q,
  nullif(list_position(list_transform(ls[11:], lambda x: regexp_matches({strip('x')}, '^[^-\n][^\n]*? -- .+$') AND len(string_split({strip('x')}, ' -- ')) = 3 AND regexp_matches(string_split({strip('x')}, ' -- ')[3], '(?i)\banalyst\b')), true), 0) + 10 AS a FROM b),
 halves AS (SELECT conv_id, 'prepared_remarks' AS source_section, {strip("array_to_string(ls[1:coalesce(q, a, len(ls) + 1) - 1], chr(10))")} AS section FROM h
  UNION ALL SELECT conv_id, 'qa_session', {strip("array_to_string(ls[coalesce(q + 1, a, len(ls) + 1):], chr(10))")} FROM h)"""

_TURNS = rf"""{_SECTIONS}, lines AS (SELECT conv_id, source_section, unnest(string_split({cleaned('section')}, chr(10))) AS line, generate_subscripts(string_split({cleaned('section')}, chr(10)), 1) AS k FROM halves WHERE section <> ''),
 heads AS (SELECT *, regexp_matches(line, '(?i)^Operator$') AS operator, length(line) < 120 AND regexp_matches(line, '^[^-\n][^\n]*? -- .+$') AS named FROM lines),
 turned AS (SELECT *, sum((operator OR named)::INT) OVER (PARTITION BY conv_id, source_section ORDER BY k) AS t FROM heads),
 spoken AS (SELECT conv_id, source_section, t, max(CASE WHEN operator THEN 'Operator' WHEN named THEN trim(string_split(line, ' -- ')[1]) END) AS speaker, bool_or(operator) AS operator,
  lower(max(CASE WHEN named THEN string_split(line, ' -- ')[2] END)) AS title, lower(max(CASE WHEN named THEN string_split(line, ' -- ')[3] END)) AS third, {strip("coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT operator AND NOT named), '')")} AS said FROM turned GROUP BY 1, 2, 3),
 turns AS (SELECT CAST(conv_id AS VARCHAR) AS ticker, source_section, row_number() OVER (PARTITION BY conv_id, source_section ORDER BY t) - 1 AS turn, coalesce(speaker, 'Unknown') AS speaker,
  CASE WHEN operator THEN 'operator' WHEN t = 0 THEN 'unknown' WHEN regexp_matches(coalesce(third, ''), '\banalyst\b') THEN 'analyst' WHEN regexp_matches(title, 'chief executive officer') THEN 'ceo' WHEN regexp_matches(title, '\banalyst\b') THEN 'analyst' ELSE 'executive' END AS role, said FROM spoken WHERE said <> '')"""

SPEAKERS = f"WITH {_TURNS} SELECT ticker, source_section, turn, speaker, role, length(said) AS length FROM turns"

CLEAN = f"SELECT conv_id, turn, md5({cleaned('t')}) AS clean_md5 FROM (SELECT *, 'Thank you for joining.' || chr(10) || chr(10) || chr(10) || coalesce(text, '') AS t FROM conversations)"


def packed(keys: str, source: str, text: str) -> str:
    """CTEs up to `packed`: keys, chunk, chunk_text.  One sentence a round; a chunk closes where the next would not fit."""
    return f"""parts AS (SELECT {keys}, {sentences(text)} AS ss, {tokens(text)} AS whole, {text} AS x FROM {source}),
 steps AS (SELECT {keys}, 1 AS i, {tokens('ss[1]')} AS n, 0 AS chunk FROM parts WHERE whole > 512
  UNION ALL SELECT {', '.join('steps.' + k.strip() for k in keys.split(','))}, i + 1, CASE WHEN n + {tokens('ss[i + 1]')} > 512 THEN {tokens('ss[i + 1]')} ELSE n + {tokens('ss[i + 1]')} END, chunk + (n + {tokens('ss[i + 1]')} > 512)::INT FROM steps JOIN parts ON {' AND '.join(f'steps.{k.strip()} = parts.{k.strip()}' for k in keys.split(','))} WHERE i < len(ss)),
 packed AS (SELECT {', '.join('steps.' + k.strip() for k in keys.split(','))}, chunk, string_agg(ss[i], ' ' ORDER BY i) AS chunk_text FROM steps JOIN parts ON {' AND '.join(f'steps.{k.strip()} = parts.{k.strip()}' for k in keys.split(','))} GROUP BY {', '.join('steps.' + k.strip() for k in keys.split(','))}, chunk
  UNION ALL SELECT {keys}, 0, x FROM parts WHERE whole <= 512 AND {strip('x')} <> '')"""


def windows(keys: str, source: str, text: str) -> str:
    """CTEs up to `windows`: keys, w, chunk_text, chunk_token_count.  Each window starts half of the last one after it."""
    on = " AND ".join(f"spans.{k.strip()} = totals.{k.strip()}" for k in keys.split(","))
    return f"""split AS (SELECT {keys}, {sentences(text)} AS ws, list_transform({sentences(text)}, lambda v: {tokens('v')}) AS sizes FROM {source}),
 totals AS (SELECT *, list_transform(range(len(sizes) + 1), lambda j: coalesce(list_sum(sizes[1:j]), 0)) AS total FROM split),
 spans AS (SELECT {keys}, 0 AS i, greatest(1, len(list_filter(total, lambda v: v <= 512)) - 1) AS e, 0 AS w FROM totals
  UNION ALL SELECT {', '.join('spans.' + k.strip() for k in keys.split(','))}, i + greatest(1, (e - i) // 2), greatest(i + greatest(1, (e - i) // 2) + 1, len(list_filter(total, lambda v: v <= total[i + greatest(1, (e - i) // 2) + 1] + 512)) - 1), w + 1 FROM spans JOIN totals ON {on} WHERE i + greatest(1, (e - i) // 2) < len(ws)),
 windows AS (SELECT {', '.join('spans.' + k.strip() for k in keys.split(','))}, w, {strip("array_to_string(ws[i + 1:e], ' ')")} AS chunk_text, CAST(total[e + 1] - total[i + 1] AS BIGINT) AS chunk_token_count FROM spans JOIN totals ON {on})"""


_WHOLE = "CAST(row_number() OVER (PARTITION BY {} ORDER BY {}) - 1 AS BIGINT) AS chunk_index"

NONOVERLAP = f"WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE text IS NOT NULL), {packed('r', 'docs', 'text')} SELECT doc_id, {_WHOLE.format('packed.r', 'chunk')}, {tokens('chunk_text')} AS chunk_token_count, md5({strip('chunk_text')}) AS chunk_md5 FROM packed JOIN docs ON packed.r = docs.r WHERE {strip('chunk_text')} <> ''"

OVERLAP = f"WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), {windows('r', 'docs', 'text')} SELECT doc_id, {_WHOLE.format('windows.r', 'w')}, chunk_token_count, md5(chunk_text) AS chunk_md5 FROM windows JOIN docs ON windows.r = docs.r WHERE chunk_text <> ''"

CHUNKS = rf"""WITH RECURSIVE {_TURNS}, t AS (SELECT ticker || '/' || source_section AS k, turn, said FROM turns), wholes AS (SELECT k, string_agg(said, ' ' ORDER BY turn) AS whole FROM t GROUP BY 1),
 {packed('k, turn', 't', 'said')}, {windows('k', 'wholes', 'whole')},
 of_turns AS (SELECT p.k, speaker, role, {strip('chunk_text')} AS chunk_text, row_number() OVER (PARTITION BY p.k ORDER BY p.turn, chunk) - 1 AS chunk_index, {tokens('chunk_text')} AS chunk_token_count, false AS overlap
  FROM packed p JOIN turns ON p.k = ticker || '/' || source_section AND p.turn = turns.turn WHERE {strip('chunk_text')} <> ''),
 of_windows AS (SELECT k, 'mixed' AS speaker, 'mixed' AS role, chunk_text, row_number() OVER (PARTITION BY k ORDER BY w) - 1 AS chunk_index, chunk_token_count, true AS overlap FROM windows WHERE chunk_text <> '')
 SELECT split_part(k, '/', 1) AS ticker, DATE '2020-01-01' + CAST(CAST(split_part(k, '/', 1) AS BIGINT) % 300 AS INT) AS date, '2020-Q' || (CAST(split_part(k, '/', 1) AS BIGINT) % 4 + 1) AS fiscal_quarter, 'NYSE' AS exchange, split_part(k, '/', 2) AS source_section,
 speaker, role, chunk_text, chunk_index, chunk_token_count, overlap FROM (SELECT * FROM of_turns UNION ALL SELECT * FROM of_windows)"""

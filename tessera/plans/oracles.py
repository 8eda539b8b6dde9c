"""DuckDB SQL for the queries of catalogue.py, written from the semantics and not from the Spark plans."""

from __future__ import annotations

from tessera.functions.headings import BRACKETS, SMALL_WORDS, VERBS
from tessera.functions.quality import COMMON_WORDS, SUSPECT
from tessera.functions.text import ABBREVIATIONS, STOP_WORDS

ORACLES: dict[str, str] = {}


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _ascii(c: str) -> str:
    return f"regexp_replace({c}, '[^\\x00-\\x7F]', '', 'g')"


def _dehyphenate(c: str) -> str:
    once = lambda x: f"regexp_replace({x}, '([\\p{{L}}\\p{{N}}_])[-\\x{{AD}}]\\s+([a-z])', '\\1\\2', 'g')"
    return once(once(c))


def _join_lines(c: str) -> str:
    """Each line with what stands before it: a line feed or a space."""
    trim = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    lines = f"list_transform(string_split({c}, chr(10)), lambda x: {trim('x')})"
    gap = "CASE WHEN l[i] = '' OR l[i-1] = '' OR (right(l[i-1], 1) IN ('.', '!', '?', ':', ';') AND regexp_matches(l[i], '^[\\p{Lu}\\p{Nd}]')) THEN chr(10) ELSE ' ' END"
    joined = f"(SELECT l[1] || array_to_string(list_transform(range(2, len(l) + 1), lambda i: {gap} || l[i]), '') FROM (SELECT {lines} AS l))"
    return f"CASE WHEN contains({c}, chr(10)) THEN {joined} ELSE {c} END"


def _squeeze(c: str) -> str:
    out = f"regexp_replace({c}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')"
    out = f"regexp_replace({out}, '[ \\t]+\\n', chr(10), 'g')"
    out = f"regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return _strip(f"regexp_replace({out}, '[ \\t]{{2,}}', ' ', 'g')")


_NO_MARKER = "regexp_replace({0}, '(?i)\\[page\\s+(\\d+)\\]', '', 'g')"

FOLDED = """folded AS (
  SELECT conv_id, string_agg(chr(12) || CASE WHEN turn % 5 = 4 THEN '' WHEN turn % 7 = 3 THEN '[PAGE ' || (turn + 1) || '][page 999]'
         ELSE '[page ' || (turn + 1) || ']' END || chr(10) || text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"""
SPLIT = f"""{FOLDED}, blocks AS (
  SELECT conv_id, i - 1 AS page_pos, regexp_replace(b[i], '^\\n+|\\n+$', '', 'g') AS block
  FROM (SELECT conv_id, string_split(text, chr(12)) AS b FROM folded), LATERAL (SELECT unnest(range(1, len(b) + 1)) AS i)),
split AS (
  SELECT conv_id, page_pos::INT AS page_pos, coalesce(try_cast(regexp_extract(block, '(?i)\\[page\\s+(\\d+)\\]', 1) AS INT), 0) AS page_number,
         {_NO_MARKER.format("block")} AS text FROM blocks WHERE regexp_matches(block, '\\S'))"""

ORACLES["b1_split_pages"] = f"WITH {SPLIT} SELECT * FROM split"
ORACLES["b2_dehyphenate"] = f"SELECT doc_id, {_dehyphenate('t')} AS text FROM (SELECT doc_id, replace(text, 'th', 't-' || chr(10) || 'h') AS t FROM documents)"
ORACLES["b3_join_lines"] = f"SELECT doc_id, {_join_lines('t')} AS text FROM (SELECT doc_id, replace(text, ', ', ',' || chr(10) || ' ') AS t FROM documents)"
ORACLES["b4_squeeze"] = f"""SELECT doc_id, {_squeeze('t')} AS text FROM (
  SELECT doc_id, replace(replace(text, '. ', '.  ' || repeat(chr(10), 4)), ', ', ',' || chr(9) || ' ' || chr(7)) AS t FROM documents)"""
_CLEAN = f"""a AS (SELECT * EXCLUDE (t), {_dehyphenate("replace(" + _NO_MARKER.format("t") + ", chr(12), chr(10))")} AS t FROM src),
  b AS (SELECT * EXCLUDE (t), {_join_lines('t')} AS t FROM a), cleaned AS (SELECT * EXCLUDE (t), {_squeeze('t')} AS text FROM b)"""
ORACLES["b5_clean"] = f"""WITH src AS (
  SELECT doc_id, '[page 7]' || chr(10) || replace(replace(text, 'th', 't-' || chr(10) || 'h'), ', ', ',  ' || chr(12)) AS t FROM documents),
  {_CLEAN} SELECT doc_id, text FROM cleaned"""
ORACLES["b6_clean_pages"] = f"WITH {SPLIT}, src AS (SELECT conv_id, page_pos, page_number, text AS t FROM split), {_CLEAN} SELECT conv_id, page_pos, page_number, text FROM cleaned"

# --- quality


def _signals(source: str, keys: str) -> str:
    """CTEs that end in sig: keys, counts and ratios of source(keys, text)."""
    return f"""
  p0 AS (SELECT {keys}, {_strip("text")} AS t FROM ({source})),
  p1 AS (SELECT *, length(t) AS char_count, regexp_extract_all(t, '[A-Za-z'']+') AS ws FROM p0),
  p2 AS (SELECT *, len(ws) AS word_count, len(list_filter(ws, lambda w: list_contains({_list(COMMON_WORDS)}, lower(w)))) AS n_common,
         len(list_filter(ws, lambda w: length(w) = 1)) AS n_single,
         len(list_filter(regexp_extract_all(t, '\\b[a-z]*[A-Z][a-z]+[A-Z][a-z]*\\b|\\b[a-z]+[A-Z][a-z]{{2,}}\\b'), lambda w: length(w) > 4)) AS n_mixed,
         length(regexp_replace(t, '[^A-Za-z0-9]', '', 'g')) AS n_alnum, length(t) - length(translate(t, '{SUSPECT}', '')) AS n_suspect,
         len(regexp_extract_all(t, '\\b\\w+-\\w+\\b')) AS n_hyphen FROM p1),
  sig AS (SELECT {keys}, char_count, word_count, CASE WHEN word_count >= 10 THEN n_common / word_count ELSE 0.5 END AS common_ratio,
          n_alnum / nullif(char_count, 0) AS alnum_ratio, coalesce(n_mixed / nullif(word_count, 0), 0) AS mixed_ratio,
          n_suspect / nullif(char_count, 0) AS suspect_ratio, n_hyphen / nullif(char_count, 0) AS hyphen_ratio,
          coalesce(n_single / nullif(word_count, 0), 0) AS single_ratio FROM p2),
  verdict AS (SELECT *, CASE WHEN char_count < 50 THEN ['no_text'] ELSE list_filter([
            CASE WHEN common_ratio < 0.22 THEN 'scrambled_text' END, CASE WHEN alnum_ratio < 0.73 THEN 'broken_encoding' END,
            CASE WHEN word_count >= 10 AND mixed_ratio > 0.04 THEN 'mixed_case_glyphs' END, CASE WHEN suspect_ratio > 0.01 THEN 'suspect_symbols' END,
            CASE WHEN char_count > 400 AND hyphen_ratio > 0.004 THEN 'surviving_hyphens' END,
            CASE WHEN word_count >= 40 AND single_ratio > 0.12 THEN 'fragmented_glyphs' END], lambda x: x IS NOT NULL) END AS issues,
          CASE WHEN char_count < 50 THEN 0.0 ELSE least(1.0,
            CASE WHEN common_ratio < 0.22 THEN greatest(0.0, least(1.0, common_ratio / 0.35::DOUBLE)) ELSE 1.0 END::DOUBLE
            * CASE WHEN alnum_ratio < 0.73 THEN greatest(0.0, least(1.0, alnum_ratio / 0.80::DOUBLE)) ELSE 1.0 END::DOUBLE
            * CASE WHEN word_count >= 10 AND mixed_ratio > 0.04 THEN greatest(0.0, 1.0 - mixed_ratio * 3) ELSE 1.0 END::DOUBLE
            * CASE WHEN suspect_ratio > 0.01 THEN greatest(0.0, 1.0 - suspect_ratio * 20) ELSE 1.0 END::DOUBLE
            * CASE WHEN char_count > 400 AND hyphen_ratio > 0.004 THEN greatest(0.0, 1.0 - hyphen_ratio * 40) ELSE 1.0 END::DOUBLE
            * CASE WHEN word_count >= 40 AND single_ratio > 0.12 THEN greatest(0.0, 1.0 - single_ratio * 2) ELSE 1.0 END::DOUBLE) END::DOUBLE AS raw_score FROM sig)"""


_DOCS = f"SELECT doc_id, {_ascii('text')} AS text FROM documents"
_CONV = f"SELECT conv_id AS doc_id, turn, {_ascii('text')} AS text FROM conversations"
_RATIOS = ", ".join(f"round({r}_ratio, 6)::DOUBLE AS {r}_ratio" for r in ("common", "alnum", "mixed", "suspect", "hyphen", "single"))
ORACLES["c2_page_signals"] = f"WITH {_signals(_DOCS, 'doc_id')} SELECT doc_id, char_count::INT AS char_count, word_count::INT AS word_count, {_RATIOS} FROM sig"
ORACLES["c8_page_verdict"] = f"""WITH {_signals(_DOCS, 'doc_id')}
  SELECT doc_id, array_to_string(issues, ',') AS issues, len(issues) = 0 AND raw_score >= 0.45 AS is_usable, round(raw_score, 3) AS score FROM verdict"""
ORACLES["c10_document_quality"] = f"""WITH {_signals(_CONV, 'doc_id, turn')},
  tally AS (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(issues) AS c FROM verdict) GROUP BY ALL),
  lists AS (SELECT doc_id, string_agg(c || ':' || n, ',' ORDER BY n DESC, c) AS issues FROM tally GROUP BY doc_id)
  SELECT doc_id, count(*) AS pages, count(*) FILTER (len(v.issues) = 0) AS usable, count(*) FILTER (len(v.issues) > 0) AS flagged,
         round(count(*) FILTER (len(v.issues) = 0)::DOUBLE / count(*), 3) AS coverage, min(round(raw_score, 3)) AS worst_score, coalesce(any_value(l.issues), '') AS issues FROM verdict v LEFT JOIN lists l USING (doc_id) GROUP BY doc_id"""
ORACLES["c11_routed_documents"] = f"""WITH {_signals(_CONV, 'doc_id, turn')}
  SELECT doc_id, count(*) AS n, CASE WHEN len(issues) = 0 THEN 'usable' ELSE 'flagged' END AS side FROM verdict GROUP BY ALL"""
ORACLES["l5_status"] = f"""WITH {_signals(_CONV, 'doc_id, turn')},
  d AS (SELECT doc_id, count(*) FILTER (len(issues) = 0) AS u, count(*) FILTER (len(issues) = 0 AND char_count >= 80) AS n_chunks FROM verdict GROUP BY doc_id)
  SELECT doc_id, CASE WHEN u = 0 OR n_chunks = 0 THEN 'failed' ELSE 'ready' END AS status,
         CASE WHEN u = 0 THEN 'no usable page' WHEN n_chunks = 0 THEN 'no chunk long enough' END AS error_message, n_chunks FROM d"""

# --- sentences, headings, packing

_WORDS = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> ''))"


def _tokens(c: str) -> str:
    return f"CASE WHEN NOT regexp_matches({c}, '\\S') THEN 0 ELSE greatest(1, trunc(least(length({c}) / 4.0::DOUBLE, {_WORDS.format(c)} * 1.3::DOUBLE))::INT) END"


ORACLES["d1_token_estimate"] = f"SELECT doc_id, {_tokens('text')} AS tokens FROM documents"


def _sentences(c: str) -> str:
    """List of sentences: marks at every gap, taken back after abbreviations, then split."""
    names = "|".join(a.replace(".", "\\.") for a in ABBREVIATIONS)
    marked = f"regexp_replace({_squeeze(c)}, '([.!?])\\s+([A-Z0-9\"''(])', '\\1' || chr(57344) || '\\2', 'g')"
    back = lambda x: f"regexp_replace({x}, '(^|\\s|' || chr(57344) || ')((?i:{names}))(\\.+)' || chr(57344), '\\1\\2\\3 ', 'g')"
    return f"list_filter(list_transform(string_split({back(back(marked))}, chr(57344)), lambda x: {_strip('x')}), lambda x: x <> '')"


_PLANTED = _ascii("replace(replace(text, '. The ', '. Mr. Dr. The '), '. A', ' etc. A')")
ORACLES["d2_sentences"] = f"""SELECT doc_id, (i - 1)::INT AS pos, s[i] AS sentence
  FROM (SELECT doc_id, {_sentences(_PLANTED)} AS s FROM documents), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)"""

_UNITS = "sq|km|cm|mm|kg|mg|ml|litre|liter|gallon|mile|miles|ft|feet|inch|inches|acre|acres|hectare|ha|percent|per\\s+cent|dozen|century"
_CITES = "\\b(?:ibid|op\\.?\\s*cit|cit|ibid\\.?|loc\\.?\\s*cit|p{1,2}\\.\\s*\\d+|vol\\.?|no\\.?\\s*\\d+|chapter\\s+\\d+\\s*,?\\s*p)\\.{0,2}$"
_CITES_ANY = "\\b(?:ibid|ibid\\.|ibicl|op\\.?\\s*cit|loc\\.?\\s*cit|et\\s+al)\\b"
_NUMBERED = "^(?:\\d+(?:\\.\\d+)*\\.?|[IVXLC]+\\.|Chapter\\s+\\d+|Part\\s+[IVXLC0-9]+|Section\\s+\\d+(?:\\.\\d+)*\\.?)(?:\\s+\\S.*)?$"

def _ranges(tokens: str, budget: int, overlap: int) -> str:
    """List of {lo, hi} for a list of token counts, by a fold over the items."""
    tail = f"""list_reduce(list_reverse({tokens}[s.lo + 1 : s.hi]), lambda t, y: CASE WHEN t.open AND (t.n = 0 OR t.total + y <= {overlap})
        THEN {{n: t.n + 1, total: t.total + y, open: t.total + y < {overlap}}} ELSE {{n: t.n, total: t.total, open: false}} END, {{n: 0, total: 0, open: true}})"""
    closed = "CASE WHEN s.hi > s.lo THEN list_append(s.o, {lo: s.lo, hi: s.hi}) ELSE s.o END"
    fold = f"""list_reduce({tokens}, lambda s, x: CASE
        WHEN x > {budget} THEN {{o: list_append({closed}, {{lo: s.hi, hi: s.hi + 1}}), lo: s.hi + 1, hi: s.hi + 1, total: 0}}
        WHEN s.hi > s.lo AND s.total + x > {budget} THEN {{o: {closed}, lo: s.hi - ({tail}).n, hi: s.hi + 1, total: ({tail}).total + x}}
        ELSE {{o: s.o, lo: s.lo, hi: s.hi + 1, total: s.total + x}} END, {{o: []::STRUCT(lo INT, hi INT)[], lo: 0, hi: 0, total: 0}})"""
    return f"(SELECT CASE WHEN f.hi > f.lo THEN list_append(f.o, {{lo: f.lo, hi: f.hi}}) ELSE f.o END FROM (SELECT {fold} AS f))"


ORACLES["e1_pack_ranges"] = f"""WITH s AS (SELECT doc_id, {_sentences(_ascii('text'))} AS s FROM documents),
  t AS (SELECT doc_id, list_transform(s, lambda v: {_tokens('v')}) AS tk FROM s), r AS (SELECT doc_id, {_ranges('tk', 120, 30)} AS r FROM t)
  SELECT doc_id, (i - 1)::INT AS piece, r[i].lo AS lo, r[i].hi AS hi FROM r, LATERAL (SELECT unnest(range(1, len(r) + 1)) AS i)"""


def _heading(l: str, ws: str, cs: str) -> str:
    """Whether the stripped line l, its words ws and its words without small ones cs make a heading."""
    return f"""coalesce(CASE
    WHEN {l} = '' OR length({l}) > 90 OR regexp_matches({l}, '{BRACKETS}') OR regexp_matches({l}, '(?i)\\b(?:{_UNITS})\\b')
      OR len(regexp_extract_all({l}, '(?:^|[^\\w.])\\d[\\d,.]*')) > 1 OR regexp_matches({l}, '(?i){_CITES}') OR regexp_matches({l}, '(?i){_CITES_ANY}')
      OR regexp_matches({l}, '[?:,;.]$') OR regexp_matches({l}, '^\\d{{1,4}}\\s+[A-Z][A-Z\\s]{{4,}}\\b')
      OR length(array_to_string(regexp_extract_all({l}, '[A-Za-z]{{2,}}'), '')) < 4 THEN false
    WHEN regexp_matches({l}, '^[^a-z]*[A-Z][^a-z]*$') AND len({ws}) <= 10 THEN true
    WHEN regexp_matches({l}, '{_NUMBERED}') THEN NOT regexp_matches({l}, '(?i)^\\s*(?:\\d+(?:\\.\\d+)*\\.?\\s*)?(?:{VERBS})\\b')
    WHEN len({cs}) >= 2 AND len(list_filter({cs}, lambda w: NOT regexp_matches(w, '^\\p{{Lu}}'))) = 0 THEN true
    ELSE len({cs}) = 1 AND regexp_matches({cs}[1], '^\\p{{Lu}}\\p{{L}}{{2,}}$') AND regexp_matches({cs}[1], '\\p{{Ll}}') END, false)"""


ORACLES["d3_headings"] = f"""WITH lines AS (
    SELECT doc_id, i - 1 AS line_no, ls[i] AS line FROM (SELECT doc_id, string_split({_ascii('text')}, chr(10)) AS ls FROM documents),
           LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)),
  heads AS (SELECT *, array_to_string(string_split(line, ' ')[1:3], ' ') AS f FROM lines),
  bare AS (SELECT *, regexp_replace(f, '[.,]', '', 'g') AS b FROM heads),
  variants AS (SELECT doc_id, line_no, [line, f, upper(f), '1. ' || b, '18 ' || upper(b),
      array_to_string(list_transform(string_split(lower(b), ' '), lambda w: upper(w[1]) || w[2:]), ' '), b || ' 5 km', 'Chapter 4 ' || b] AS v FROM bare),
  flat AS (SELECT doc_id, line_no, i - 1 AS variant, {_strip('v[i]')} AS l FROM variants, LATERAL (SELECT unnest(range(1, 9)) AS i)),
  parts AS (SELECT *, list_filter(regexp_split_to_array(l, '\\s+'), lambda w: w <> '') AS ws FROM flat),
  cont AS (SELECT *, list_filter(ws, lambda w: NOT list_contains({_list(SMALL_WORDS)}, lower(w))) AS cs FROM parts)
  SELECT doc_id, line_no::INT AS line_no, variant::INT AS variant, {_heading('l', 'ws', 'cs')} AS is_heading FROM cont"""

_TITLE = "regexp_replace(array_to_string(regexp_split_to_array(text, '\\s+')[1:2], ' '), '[^A-Za-z ]', '', 'g')"
_INITCAP = f"array_to_string(list_transform(string_split(lower({_TITLE}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
SECTIONS = f"""headed AS (SELECT conv_id AS doc_id, turn AS page_pos, turn + 1 AS page_number,
    CASE WHEN turn % 3 = 0 THEN {_INITCAP} || chr(10) || text ELSE text END AS text FROM conversations),
  ls AS (SELECT *, string_split(text, chr(10)) AS l FROM headed WHERE regexp_matches(text, '\\S')),
  lines AS (SELECT doc_id, page_pos, page_number, i AS line_no, l[i] AS line, {_strip('l[i]')} AS s FROM ls, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)),
  lw AS (SELECT *, list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '') AS ws FROM lines),
  lc AS (SELECT *, list_filter(ws, lambda w: NOT list_contains({_list(SMALL_WORDS)}, lower(w))) AS cs FROM lw),
  lh AS (SELECT *, {_heading('s', 'ws', 'cs')} AS h FROM lc),
  numbered AS (SELECT *, coalesce(sum(h::INT) OVER (PARTITION BY doc_id, page_pos ORDER BY line_no), 0) AS section_no,
               last_value(CASE WHEN h THEN s END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_pos, line_no) AS title FROM lh),
  parts AS (SELECT doc_id, page_pos, page_number, section_no, arg_max(title, line_no) AS t1, any_value(title) AS section_title,
            {_strip("coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT h), '')")} AS body FROM numbered GROUP BY ALL),
  kept AS (SELECT * FROM (SELECT *, max(section_no) OVER (PARTITION BY doc_id, page_pos) AS last_no FROM parts)
           WHERE body <> '' OR (section_no = last_no AND section_title IS NOT NULL)),
  changed AS (SELECT *, section_title IS NOT NULL AND section_title IS DISTINCT FROM
              last_value(section_title IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_pos, section_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS new_ FROM kept),
  sections AS (SELECT doc_id, page_pos, page_number, section_no, section_title, body, array_to_string(
      (list(section_title) FILTER (new_) OVER (PARTITION BY doc_id ORDER BY page_pos, section_no ROWS UNBOUNDED PRECEDING))[-6:], ' > ') AS heading_path FROM changed)"""
ORACLES["d6_sections"] = f"""WITH {SECTIONS} SELECT doc_id, page_pos::INT AS page_pos, page_number::INT AS page_number, section_no::INT AS section_no,
  section_title, body, coalesce(heading_path, '') AS heading_path FROM sections"""


def _chunks(sections: str, budget: int, overlap: int, tokens=_tokens, least: int = 80) -> str:
    """CTEs after sections (doc_id, page_pos, page_number, section_no, section_title, heading_path, body) and the final SELECT."""
    return f"""{sections}, sents AS (SELECT *, {_sentences('body')} AS ss FROM sections WHERE body <> ''),
  toks AS (SELECT *, list_transform(ss, lambda v: {tokens('v')}) AS tk FROM sents), packs AS (SELECT *, {_ranges('tk', budget, overlap)} AS r FROM toks),
  pieces AS (SELECT *, array_to_string(ss[r[i].lo + 1 : r[i].hi], ' ') AS content, i FROM packs, LATERAL (SELECT unnest(range(1, len(r) + 1)) AS i)),
  num AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY page_pos, section_no, i) - 1)::INT AS chunk_index FROM pieces)
  SELECT sha256(doc_id || '|' || chunk_index) AS chunk_id, doc_id, chunk_index, content, {tokens('content')} AS token_count, page_number::INT AS page_number,
         section_title, coalesce(heading_path, '') AS heading_path FROM num WHERE length(content) >= {least}"""


ORACLES["e2_chunks"] = "WITH " + _chunks(SECTIONS, 120, 30)
_WHOLE = f"""src AS (SELECT doc_id, text AS t FROM documents), {_CLEAN}, headed AS (SELECT doc_id, 0 AS page_pos, 1 AS page_number, text FROM cleaned),
  ls AS""" + SECTIONS.split("ls AS", 1)[1]
ORACLES["e3_document_chunks"] = "WITH " + _chunks(_WHOLE, 400, 80)

# --- lexical retrieval

_TOKENS = f"list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+(?:[''-][A-Za-z0-9]+)*'), lambda x: lower(x)), lambda x: length(x) > 1 AND NOT list_contains({_list(STOP_WORDS)}, x))"
LEX = f"""toks AS (SELECT doc_id, text, lang, source, {_TOKENS} AS tk FROM documents),
  post AS (SELECT doc_id, len(tk) AS dl, term, count(*) AS tf FROM (SELECT doc_id, tk, unnest(tk) AS term FROM toks) GROUP BY ALL),
  stats AS (SELECT count(*) AS n, coalesce(avg(len(tk)), 1.0) AS avgdl FROM toks),
  dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
  qt AS (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark),
  scored AS (SELECT query_id, doc_id, round(sum(tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) * ln(1 + (n - df + 0.5) / (df + 0.5))), 6) AS score
             FROM qt JOIN post USING (term) JOIN dfs USING (term), stats GROUP BY ALL),
  ranks AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored)"""
ORACLES["f1_tokens"] = f"SELECT doc_id, array_to_string(tk, ' ') AS tokens, len(tk)::INT AS dl FROM (SELECT doc_id, {_TOKENS} AS tk FROM documents)"
ORACLES["f2_postings"] = f"WITH {LEX} SELECT doc_id, dl::INT AS dl, term, tf FROM post"
ORACLES["f4_corpus_stats"] = f"WITH {LEX} SELECT n, round(avgdl, 6) AS avgdl FROM stats"
ORACLES["f6_term_idf"] = f"WITH {LEX} SELECT term, df, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM dfs, stats"
ORACLES["f7_document_weights"] = f"WITH {LEX} SELECT doc_id, term, round(tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl)), 6) AS weight FROM post, stats"
ORACLES["f8_query_terms"] = f"WITH {LEX} SELECT query_id, term FROM qt"
ORACLES["f9_bm25_topk"] = f"WITH {LEX} SELECT query_id, doc_id, score, rank FROM ranks WHERE rank <= 10"

# --- dense retrieval and fusion

_COS = "round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6)"
ORACLES["g6_cosine_topk"] = f"""SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank
  FROM (SELECT q.vec_id AS query_id, v.vec_id, {_COS} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)) WHERE rank <= 10"""
ORACLES["h3_scoped_cosine"] = f"""SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank
  FROM (SELECT q.vec_id AS query_id, v.vec_id, {_COS} AS score FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 100 = 0)) WHERE rank <= 5"""


def _rrf(k: int, base: int) -> str:
    return f"""WITH {LEX}, near AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
      SELECT q.vec_id AS query_id, v.vec_id, {_COS} AS score FROM embeddings q JOIN benchmark b ON b.item_id = q.vec_id, embeddings v)),
  lists AS (SELECT query_id, doc_id AS chunk_id, rank FROM ranks WHERE rank <= 30 UNION ALL SELECT query_id, vec_id, rank FROM near WHERE rank <= 30),
  fused AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (rank - 1 + {base} + {k})), 6) AS fusion_score FROM lists GROUP BY ALL)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, chunk_id)::INT AS rank FROM fused) WHERE rank <= 10"""


ORACLES["h2_rrf"] = _rrf(60, 1)
ORACLES["h2_rrf_zero_based"] = _rrf(2, 0)
ORACLES["h3_scoped_bm25"] = f"""WITH {LEX}, own AS (SELECT s.* FROM scored s JOIN documents d USING (doc_id) WHERE d.source = 'src' || (s.query_id % 20))
  SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM own) WHERE rank <= 5"""
ORACLES["h4_resolved"] = f"""WITH near AS ({ORACLES['g6_cosine_topk']})
  SELECT query_id, vec_id AS doc_id, rank, length(text)::INT AS n_chars FROM near LEFT JOIN (SELECT * FROM documents WHERE lang = 'en') d ON d.doc_id = vec_id"""
HITS = f"""{LEX}, hits AS (SELECT query_id, doc_id AS chunk_id, rank, score AS fusion_score FROM ranks WHERE rank <= 5)"""
ORACLES["h5_rerank_prompts"] = f"""WITH {HITS} SELECT query_id, string_agg('[' || (rank - 1) || '] ' || substr(text, 1, 1200), chr(10) || chr(10) ORDER BY rank) AS passages, count(*) AS n
  FROM hits JOIN documents d ON d.doc_id = chunk_id GROUP BY query_id"""
RERANKED = f"""{HITS}, judged AS (
    SELECT *, CASE WHEN query_id % 3 = 0 THEN ((rank * 7 + query_id) % 10) / 10.0::DOUBLE END AS rerank_score FROM hits),
  final AS (SELECT *, coalesce(rerank_score, fusion_score) AS final_score,
            row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, rank)::INT AS final_rank FROM judged)"""
ORACLES["h6_rerank"] = f"WITH {RERANKED} SELECT query_id, chunk_id, rank, rerank_score, final_score, final_rank FROM final"
ORACLES["h10_reranked_flag"] = f"WITH {RERANKED} SELECT query_id, bool_or(rerank_score IS NOT NULL) AS reranked FROM final WHERE final_rank <= 3 GROUP BY query_id"
ORACLES["h9_excerpts"] = f"""WITH {HITS} SELECT query_id, chunk_id, rank, substr(text, 1, 400) AS excerpt, round(fusion_score, 4) AS score
  FROM hits JOIN documents d ON d.doc_id = chunk_id WHERE rank <= 3"""
ORACLES["h12_point_count"] = "SELECT count(*) AS n FROM embeddings"

# --- answers and citations

ANSWERS = """answers AS (SELECT conv_id * 1000 + turn AS query_id, conv_id, CASE WHEN turn % 4 = 1 THEN text
    ELSE text || ' [' || turn || '] and [' || (turn + 2) || '][02][0]' END AS text FROM conversations WHERE role = 'assistant'),
  sources AS (SELECT query_id, (c.turn + 1)::INT AS rank, c.text AS content FROM answers JOIN conversations c USING (conv_id) WHERE c.turn < 3),
  cited AS (SELECT DISTINCT query_id, try_cast(unnest(regexp_extract_all(text, '\\[(\\d+)\\]', 1)) AS INT) AS rank FROM answers)"""
ORACLES["i1_sources"] = f"WITH {ANSWERS} SELECT query_id, string_agg('[' || rank || '] ' || content, chr(10) || chr(10) ORDER BY rank) AS sources FROM sources GROUP BY query_id"
ORACLES["i3_refusals"] = f"""WITH {LEX} SELECT item_id AS query_id, 'No evidence for this question was found in the indexed documents.' AS text, false AS grounded
  FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM ranks WHERE rank <= 10 AND score > 35)"""
ORACLES["i4_citations"] = f"""WITH {ANSWERS} SELECT query_id, coalesce(string_agg(c.rank::VARCHAR, ',' ORDER BY c.rank), '') AS cited
  FROM answers LEFT JOIN cited c USING (query_id) GROUP BY query_id"""
# markers whose number, leading zeros aside, is not 1 to 3
_DROP = "regexp_replace(text, '\\[(?:0+|0*[4-9]|0*[1-9]\\d+)\\]', '', 'g')"
ORACLES["i5_drop_unknown"] = f"WITH {ANSWERS} SELECT query_id, {_DROP} AS text FROM answers"
ORACLES["i6_resolved_citations"] = f"WITH {ANSWERS} SELECT query_id, rank, content FROM sources JOIN cited USING (query_id, rank)"
ORACLES["i7_answers"] = f"""WITH {ANSWERS}, n AS (SELECT query_id, count(*) AS n FROM sources GROUP BY query_id),
  r AS (SELECT query_id, string_agg(rank::VARCHAR, ',' ORDER BY rank) AS citations FROM sources JOIN cited USING (query_id, rank) GROUP BY query_id)
  SELECT query_id, CASE coalesce(n.n, 0) WHEN 3 THEN {_DROP}
    WHEN 2 THEN regexp_replace(text, '\\[(?:0+|0*[3-9]|0*[1-9]\\d+)\\]', '', 'g') WHEN 1 THEN regexp_replace(text, '\\[(?:0+|0*[2-9]|0*[1-9]\\d+)\\]', '', 'g')
    ELSE regexp_replace(text, '\\[\\d+\\]', '', 'g') END AS text, coalesce(citations, '') AS citations, citations IS NOT NULL AS grounded
  FROM answers LEFT JOIN n USING (query_id) LEFT JOIN r USING (query_id)"""

# --- evaluation

EVAL = f"""{LEX}, qrels AS (SELECT item_id AS query_id, d.doc_id::VARCHAR AS key, CASE WHEN d.doc_id % 2 = 0 THEN 2 ELSE 1 END AS grade
    FROM benchmark b, documents d WHERE contains(d.text, b.text)),
  ranked AS (SELECT query_id, rank, doc_id::VARCHAR AS key FROM ranks WHERE rank <= 40)"""
ORACLES["j2_qrels"] = f"WITH {EVAL} SELECT * FROM qrels"


def _metrics(ranked: str = "ranked", qrels: str = "qrels") -> str:
    return f"""
  m AS (SELECT r.query_id, count(DISTINCT r.key) FILTER (rank <= 10 AND g.key IS NOT NULL) AS found, count(*) FILTER (rank <= 10 AND g.key IS NOT NULL) AS hits,
        count(*) FILTER (rank <= 10) AS shown, min(rank) FILTER (g.key IS NOT NULL) AS first FROM {ranked} r LEFT JOIN {qrels} g USING (query_id, key) GROUP BY r.query_id),
  tot AS (SELECT query_id, count(*) AS n FROM {qrels} GROUP BY query_id),
  pos AS (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS pos FROM {ranked} WHERE rank <= 10 GROUP BY query_id, key),
  dcg AS (SELECT query_id, sum(grade / log2(pos + 1.0::DOUBLE)) AS dcg FROM pos JOIN {qrels} USING (query_id, key) GROUP BY query_id),
  best AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, key) AS pos FROM {qrels}),
  idcg AS (SELECT query_id, sum(grade / log2(pos + 1.0::DOUBLE)) AS idcg FROM best WHERE pos <= 10 GROUP BY query_id),
  met AS (SELECT item_id AS query_id, round(coalesce(found / tot.n, 0), 6) AS recall, round(hits / nullif(shown, 0), 6) AS precision,
          round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, round(coalesce(dcg / idcg, 0), 6) AS ndcg
          FROM benchmark b LEFT JOIN m ON m.query_id = item_id LEFT JOIN tot ON tot.query_id = item_id
          LEFT JOIN dcg ON dcg.query_id = item_id LEFT JOIN idcg ON idcg.query_id = item_id)"""


ORACLES["j7_query_metrics"] = f"WITH {EVAL}, {_metrics()} SELECT * FROM met"
ORACLES["j7_duplicate_keys"] = f"""WITH {EVAL}, r2 AS (SELECT query_id, rank, source AS key FROM ranks JOIN toks USING (doc_id) WHERE rank <= 40),
  q2 AS (SELECT query_id, source AS key, max(grade) AS grade FROM qrels JOIN documents d ON d.doc_id::VARCHAR = key GROUP BY ALL), {_metrics("r2", "q2")} SELECT * FROM met"""
CITED = """marks AS (SELECT item_id AS query_id, unnest([1, 2, item_id % 50, 1]) AS rank FROM benchmark),
  prec AS (SELECT query_id, avg(CASE WHEN g.key IS NULL THEN 0.0 ELSE 1.0 END) AS p FROM marks JOIN ranked USING (query_id, rank) LEFT JOIN qrels g USING (query_id, key) GROUP BY query_id),
  cite AS (SELECT item_id AS query_id, round(coalesce(p, 0), 6) AS citation_precision FROM benchmark LEFT JOIN prec ON query_id = item_id)"""
ORACLES["j8_citation_precision"] = f"WITH {EVAL}, {CITED} SELECT * FROM cite"
ORACLES["j10_mean_metrics"] = f"""WITH {EVAL}, {_metrics()} SELECT round(coalesce(avg(recall), 0), 6) AS recall, round(coalesce(avg(precision), 0), 6) AS precision,
  round(coalesce(avg(mrr), 0), 6) AS mrr, round(coalesce(avg(ndcg), 0), 6) AS ndcg, count(*) AS scored_questions FROM met"""
ORACLES["j11_run_summary"] = f"""WITH {EVAL}, {_metrics()}, {CITED}, res AS (SELECT *, query_id % 11 <> 3 AS ok, query_id % 11 <> 3 AND query_id % 5 <> 0 AS answered FROM met JOIN cite USING (query_id))
  SELECT {", ".join(f"round(coalesce(avg({c}) FILTER (ok), 0), 6) AS {c}" for c in ("recall", "precision", "mrr", "ndcg"))},
         round(coalesce(avg(citation_precision) FILTER (answered), 0), 6) AS citation_precision,
         round(coalesce(avg(CASE WHEN query_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (answered), 0), 6) AS grounded, count(*) FILTER (ok) AS scored_questions,
         count(*) FILTER (NOT ok) AS errors, count(*) AS total, round(avg(query_id * 1.5::DOUBLE), 6) AS mean_total_ms FROM res"""

# --- catalogue

ORACLES["k1_list_documents"] = "SELECT c_custkey, c_name, c_mktsegment, count(o_orderkey) AS live_chunks FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL"
ORACLES["k2_document"] = "SELECT doc_id, text, lang, source FROM documents WHERE doc_id = 7"
ORACLES["k3_sample_chunks"] = "SELECT turn AS chunk_index, substr(text, 1, 300) AS content FROM conversations WHERE conv_id = 3 ORDER BY turn LIMIT 10"
ORACLES["k4_ordered_chunks"] = "SELECT conv_id AS doc_id, turn AS chunk_index, text AS content FROM conversations WHERE conv_id = 5"
LOG = "log AS (SELECT o_orderkey AS doc_id, o_custkey::VARCHAR AS content_hash, CASE o_orderstatus WHEN 'F' THEN 'ready' ELSE 'processing' END AS status, o_orderdate AS created_at FROM orders)"
ORACLES["k5_ready_by_hash"] = f"WITH {LOG} SELECT doc_id, content_hash, status FROM log WHERE content_hash = '10' AND status = 'ready'"
ORACLES["k6_partial"] = f"""WITH {LOG}, d AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY created_at DESC, doc_id DESC) AS n FROM log WHERE status = 'processing')
  SELECT content_hash, doc_id, (SELECT count(*) FROM lineitem WHERE l_orderkey = doc_id) AS chunk_count,
         (SELECT count(*) FROM lineitem WHERE l_orderkey = doc_id AND l_returnflag = 'N') AS indexed_count FROM d WHERE n = 1"""
ORACLES["k9_recent_runs"] = "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20"
ORACLES["k10_run_results"] = "SELECT l_orderkey AS run_id, l_linenumber AS created_at, l_quantity FROM lineitem WHERE l_orderkey = 1"
ORACLES["k12_exists"] = "SELECT doc_id FROM documents WHERE doc_id = 0 LIMIT 1"
ORACLES["k14_ping"] = "SELECT 1 AS ok"
ORACLES["a5_content_hash"] = "SELECT doc_id, sha256(text) AS content_hash FROM documents"
ORACLES["l1_new_inputs"] = """WITH f AS (SELECT doc_id, sha256(text) AS content_hash FROM documents)
  SELECT * FROM f WHERE content_hash NOT IN (SELECT content_hash FROM f JOIN labels USING (doc_id))"""
ORACLES["l3_pending"] = "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)"

# --- sources, the store and injected models

_FILES = """files AS (SELECT doc_id, 'in/' || doc_id || CASE WHEN doc_id % 5 = 3 THEN '.md' WHEN doc_id % 2 = 0 THEN '.TXT' ELSE '.txt' END AS uri,
    doc_id % 7 = 1 AS broken, text, CASE WHEN doc_id % 7 = 1 THEN encode(text) || '\\xC3'::BLOB ELSE encode(text) END AS content FROM documents)"""
ORACLES["a1_text_scan"] = f"""WITH {_FILES} SELECT uri AS source_uri, 'txt' AS source_type, sha256(content) AS content_hash,
  CASE WHEN NOT broken THEN text END AS raw_text, CASE WHEN broken THEN 'not UTF-8' END AS error_message FROM files WHERE doc_id % 5 <> 3"""
ORACLES["a4_rejected_files"] = f"WITH {_FILES} SELECT uri AS source_uri, 'unsupported file type: md' AS reason FROM files WHERE doc_id % 5 = 3"
ORACLES["a10_question_set"] = "SELECT text, item_id::VARCHAR AS key, (item_id % 3)::INT AS grade FROM benchmark"
ORACLES["a7_upserted"] = "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 OR c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS c_name, c_acctbal FROM customer"
ORACLES["a9_deleted"] = "SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id) WHERE doc_id <> 7"
ORACLES["a12_appended"] = f"WITH {LOG} SELECT doc_id, status, CASE WHEN status <> 'ready' THEN content_hash END AS content_hash FROM log"
_BY_WORDS = lambda c: f"{_WORDS.format(c)}::INT"
ORACLES["e4_word_budget_chunks"] = "WITH " + _chunks(SECTIONS, 60, 15, _BY_WORDS)
ORACLES["e5_least_length"] = f"""SELECT doc_id, count(*) AS n, min(length(content))::INT AS least, max(chunk_index) AS last
  FROM (WITH {_chunks(SECTIONS, 120, 30, least=200)}) GROUP BY doc_id"""
_VOCABULARY = f"{LEX}, terms AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM (SELECT DISTINCT term FROM post))"
ORACLES["f10_vocabulary"] = f"WITH {_VOCABULARY} SELECT * FROM terms"
ORACLES["f12_sparse_queries"] = f"WITH {_VOCABULARY} SELECT query_id, string_agg(term_id::VARCHAR, ',' ORDER BY term_id) AS term_ids FROM qt JOIN terms USING (term) GROUP BY query_id"
ORACLES["f11_stored_search"] = ORACLES["f9_bm25_topk"]
ORACLES["g2_model_vectors"] = "SELECT doc_id, length(text)::BIGINT AS chars, (length(text) - length(replace(text, ' ', '')))::BIGINT AS spaces FROM documents"
ORACLES["h1_overfetch"] = _rrf(60, 1)
ORACLES["h8_top_slice"] = f"WITH {HITS} SELECT query_id, chunk_id, rank AS final_rank FROM hits WHERE rank <= 2"
ORACLES["h11_indexed_ids"] = "SELECT DISTINCT vec_id FROM embeddings"
ORACLES["i2_generated"] = f"""WITH {ANSWERS}, asked AS (
    SELECT query_id, text, string_agg('[' || rank || '] ' || content, chr(10) || chr(10) ORDER BY rank) AS block FROM answers JOIN sources USING (query_id) GROUP BY ALL)
  SELECT query_id, CASE WHEN NOT suffix(text, 'a.') THEN length('Sources:' || chr(10) || chr(10) || block || chr(10) || chr(10) || 'Question: ' || text)::VARCHAR END AS text,
         CASE WHEN suffix(text, 'a.') THEN 'RuntimeError: no answer' END AS error, true AS timed FROM asked"""
ORACLES["i8_api_citations"] = ORACLES["i6_resolved_citations"]
ORACLES["j1_source_keys"] = "SELECT conv_id, turn, CASE WHEN turn % 4 = 3 OR turn = 0 THEN conv_id::VARCHAR ELSE conv_id || ':' || turn END AS key FROM conversations"
ORACLES["j12_settings"] = """SELECT * FROM (VALUES ('chunk_size_tokens', '400'), ('chunk_overlap_tokens', '80'), ('min_chunk_chars', '80'), ('retrieval_candidates', '40'),
  ('retrieval_top_k', '6'), ('rrf_k', '2'), ('rrf_rank_base', '1'), ('embedding_dim', '768'), ('bm25_k1', '1.5'), ('bm25_b', '0.75'), ('llm_temperature', '0.1'),
  ('commit_chunks', '50000')) AS t(name, value)"""
ORACLES["j13_failed_rerank"] = f"WITH {HITS} SELECT query_id, chunk_id, NULL::DOUBLE AS rerank_score, fusion_score AS final_score, rank AS final_rank FROM hits"
ORACLES["k11_run"] = "SELECT o_orderkey AS run_id, o_orderpriority FROM orders WHERE o_orderkey = 3"
ORACLES["l2_resumed_chunks"] = f"SELECT chunk_id, doc_id, chunk_index FROM (WITH {_chunks(SECTIONS, 120, 30)}) WHERE chunk_index % 2 = 1"

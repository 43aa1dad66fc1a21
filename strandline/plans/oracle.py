"""The same rows in DuckDB's SQL, written apart from the DataFrame code."""

from __future__ import annotations

from strandline.plans.catalogue import ASKING, DEBRIS

TOKENS = r"'\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+'"


def n_tokens(text: str) -> str:
    return f"len(regexp_extract_all({text}, {TOKENS}))"


LINES = f"""raw AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS pos FROM raw),
el AS (SELECT doc_id, pos, 'paragraph' AS kind, text, {n_tokens('text')} AS n FROM l)"""

BLOCK = "address|article|aside|blockquote|body|br|caption|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
HOSTS = rf"""seen AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS doc_id, page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(html, chr(2), ' '),
  '(?is)<!--.*?-->', ' ', 'g'), '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?is)<head\b.*?</head\s*>', ' ', 'g') AS html FROM pages),
raw AS (SELECT doc_id, page_id, string_split(chr(2) || 'P' || regexp_replace(regexp_replace(regexp_replace(html, '(?i)<h[1-6](?:\s[^>]*)?/?>', chr(2) || 'H', 'g'),
  '(?i)<li(?:\s[^>]*)?/?>', chr(2) || 'L', 'g'), '(?i)</?(?:{BLOCK})(?:\s[^>]*)?/?>', chr(2) || 'P', 'g'), chr(2)) AS parts FROM seen),
c AS (SELECT doc_id, page_id, unnest(parts) AS raw, generate_subscripts(parts, 1) AS part FROM raw),
t AS (SELECT *, trim(regexp_replace(substr(raw, 2), '<[^>]*>', '', 'g'), ' ' || chr(9) || chr(10) || chr(12) || chr(13)) AS text FROM c),
el0 AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_id, part) - 1 AS pos,
  CASE raw[1] WHEN 'H' THEN 'heading' WHEN 'L' THEN 'list_item' ELSE 'paragraph' END AS kind, text, {n_tokens('text')} AS n FROM t WHERE text <> ''),
el AS (SELECT *, (sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT AS section FROM el0),
units AS (SELECT doc_id, section AS unit_id, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS content, sum(n)::BIGINT AS n_tokens,
  CASE WHEN arg_min(kind, pos) = 'heading' THEN 'section' ELSE 'narrative' END AS unit_type FROM el GROUP BY ALL)"""


def _norm(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g'))"


def speech(asking: bool) -> str:
    text = ASKING if asking else "text"
    return f"""s0 AS (SELECT conv_id AS doc_id, turn, {text} AS text, role AS speaker FROM conversations),
s1 AS (SELECT *, row_number() OVER w - 1 AS pos, floor(length(text) * 1000 / 15)::BIGINT AS ms FROM s0 WINDOW w AS (PARTITION BY doc_id ORDER BY turn)),
sp AS (SELECT *, (sum(ms) OVER (PARTITION BY doc_id ORDER BY turn))::BIGINT AS t1_ms, (sum(ms) OVER (PARTITION BY doc_id ORDER BY turn))::BIGINT - ms AS t0_ms,
  lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt, {n_tokens('text')} AS n FROM s1)"""


QUESTION = r"'(?i)^(who|what|where|when|why|how|can|could|would|should|is|are|do|does|did)\b.*\?'"
QA = f"""{speech(True)}, q AS (SELECT * FROM sp WHERE nxt IS NOT NULL AND (rtrim(text) LIKE '%?' OR regexp_matches(text, {QUESTION}))),
qa AS (SELECT doc_id, pos AS src, nxt AS dst, 'answered_by' AS type, 0.9::DOUBLE AS confidence FROM q
  UNION ALL SELECT doc_id, nxt, pos, 'question_for', 0.9::DOUBLE FROM q),
edges AS (SELECT *, 0.9::DOUBLE AS importance FROM qa UNION ALL
  SELECT doc_id, pos, nxt, 'next', 1.0::DOUBLE, 0.05::DOUBLE FROM sp WHERE nxt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM qa WHERE qa.doc_id = sp.doc_id AND qa.src = sp.pos AND qa.dst = sp.nxt))"""

#: Cuts between turns: only speakers change, and questions hold on to their answers.
CANDIDATES = """cand0 AS (SELECT sp.doc_id, sp.pos, sum(sp.n) OVER w - sp.n AS before, CASE WHEN sp.speaker <> lag(sp.speaker) OVER w THEN 1.0 ELSE 0.0 END::DOUBLE AS speaker_change, q.pos IS NOT NULL AS asked
  FROM sp LEFT JOIN q ON q.doc_id = sp.doc_id AND q.nxt = sp.pos WINDOW w AS (PARTITION BY sp.doc_id ORDER BY sp.pos)),
cand AS (SELECT doc_id, pos, speaker_change, CASE WHEN asked THEN 0.1 ELSE 0.5 END::DOUBLE AS graph_separation, CASE WHEN asked THEN 1.8 ELSE 0.0 END::DOUBLE AS loss,
  speaker_change + 0.8 * CASE WHEN asked THEN 0.1 ELSE 0.5 END::DOUBLE - 1.5 * CASE WHEN asked THEN 1.8 ELSE 0.0 END::DOUBLE - 0.6 * abs(before - 500) / 500::DOUBLE AS score FROM cand0 WHERE pos > 0)"""

ANAPHORA = r"'(?im)\bas (shown|described|noted|mentioned|discussed) (above|earlier|previously|below)\b|\bthis (table|figure|section|chart|diagram|approach|result)\b|\bthe (former|latter)\b|^(This|These|It|They)\b'"
SENTENCES = r"""s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', concat('\1', chr(31)), 'g'), chr(31)), lambda x: trim(x) <> '') AS own FROM documents),
r AS (SELECT doc_id, len(own) AS n, len(list_filter(own, lambda x: regexp_matches(x, """ + ANAPHORA + """))) AS hits FROM s)"""

# The cleaning rules as RE2 patterns, in order.
STEPS = [
    ("control_chars", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", "true"),
    ("invisible_chars", r"[\x{00AD}\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]", "", "true"),
    ("non_breaking_spaces", r"[\x{00A0}\x{2007}\x{202F}]", " ", "true"),
    ("citation_markers", r"【?\s*\d+\s*†\s*L?[\d\s\-–L]{0,24}】?", "", "true"),
    ("citation_markers", r"【[\s\d\-–L]{1,24}】", "", "true"),
    ("orphaned_citation_brackets", r"【\s*", "", "odd"),
    ("orphaned_citation_brackets", r"\s*】", "", "odd"),
    ("hyphen_line_breaks", r"([\p{L}\p{N}_])[-‐‑]\s*\n\s*([a-z])", r"\1\2", "true"),
    ("dot_leaders", r"\.{4,}", " ", "true"),
    ("trailing_bullets", r"(?m)[ \t]*[·•▪●○◦]+[ \t]*$", "", "true"),
    ("space_before_punctuation", r"[ \t]+([,.;:!?%)\]])", r"\1", "true"),
    ("space_after_bracket", r"([(\[])[ \t]+", r"\1", "true"),
    ("repeated_spaces", r"[ \t]{2,}", " ", "true"),
    ("repeated_blank_lines", r"\n{3,}", "\n\n", "true"),
]


def _cleaning() -> str:
    ligatures = DEBRIS
    for sign, letters in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "ft"), ("ﬆ", "st")):
        ligatures = f"replace({ligatures}, '{sign}', '{letters}')"
    out = [f"k0 AS (SELECT doc_id, {ligatures} AS t, len(regexp_extract_all({DEBRIS}, '[ﬁﬂﬀﬃﬄﬅﬆ]')) AS n0, false AS odd FROM documents)"]
    for k, (rule, pattern, into, when) in enumerate(STEPS, 1):
        own = ", ".join(f"n{i}" for i in range(k))
        odd = "len(regexp_extract_all(t, '【')) <> len(regexp_extract_all(t, '】'))" if rule == "citation_markers" and "{1,24}" in pattern else "odd"
        new = f"CASE WHEN {when} THEN regexp_replace(t, '{pattern}', '{into}', 'g') ELSE t END"
        out.append(f"k{k} AS (SELECT doc_id, {new} AS t, {own}, CASE WHEN {when} THEN len(regexp_extract_all(t, '{pattern}')) ELSE 0 END AS n{k}, odd FROM k{k - 1})")
        if odd != "odd":
            out[-1] = out[-1].replace(", odd FROM", " FROM")
            out.append(f"k{k}b AS (SELECT *, {odd} AS odd FROM k{k})")
            out[-2], out[-1] = out[-2].replace(f"k{k} AS", f"k{k}a AS"), out[-1].replace(f"k{k}b AS", f"k{k} AS").replace(f"FROM k{k})", f"FROM k{k}a)")
    n = len(STEPS)
    strip = r"regexp_replace(regexp_replace(t, '^\s+', ''), '\s+$', '')"
    out.append(f"z AS (SELECT *, {strip} AS u, ({strip} <> t)::BIGINT AS n{n + 1} FROM k{n})")
    return ",\n".join(out)


def _columns(name: str, columns: dict[str, str]) -> str:
    """The cells of a table as text; columns: name to kind (text, double, time)."""
    as_text = {"text": "{0}::VARCHAR", "double": "printf('%.2f', {0})", "time": "strftime({0}, '%Y-%m-%d')"}
    return " UNION ALL ".join(f"SELECT '{c}' AS name, coalesce({as_text[k].format(c)}, '') AS value FROM {name}" for c, k in columns.items())


def _fence(text: str) -> str:
    """Marks of a prompt broken by an invisible sign."""
    for mark in ("</document>", "</chunk>", "<chunk"):
        text = f"replace({text}, '{mark}', concat('<', chr(8203), '{mark[1:]}'))"
    return text


def _placed(name: str, place: str) -> str:
    """The cells of a table as text, with the place of their row."""
    return _columns(name, TABLES[name]).replace("SELECT ", f"SELECT {place} AS place, ")


TABLES = {
    "lineitem": {"l_orderkey": "text", "l_partkey": "text", "l_suppkey": "text", "l_linenumber": "text", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "time"},
    "orders": {"o_orderkey": "text", "o_custkey": "text", "o_orderstatus": "text", "o_totalprice": "double", "o_orderdate": "time", "o_orderpriority": "text"},
    "part": {"p_partkey": "text", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "text", "p_retailprice": "double"},
    "customer": {"c_custkey": "text", "c_name": "text", "c_nationkey": "text", "c_acctbal": "double", "c_mktsegment": "text"},
}


def _profile(name: str) -> str:
    integer, decimal = r"^-?\d{1,3}(,\d{3})*$|^-?\d+$", r"^-?\d*\.\d+$|^-?\d{1,3}(,\d{3})*\.\d+$"
    date = r"^(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-Q[1-4]|\d{4}/\d{1,2})([ T]\d{1,2}:\d{2}(:\d{2})?)?$"
    return rf"""cells AS ({_columns(name, TABLES[name])}),
k AS (SELECT name, trim(value) AS v, CASE WHEN lower(trim(value)) IN ('', '-', 'n/a', 'na', 'null', 'none', 'nan') THEN 'none'
  WHEN regexp_matches(trim(value), '^-?\d+(\.\d+)?\s*%$') THEN 'pct' WHEN regexp_matches(trim(value), '{date}') THEN 'date'
  WHEN regexp_matches(trim(value), '{integer}') THEN 'int' WHEN regexp_matches(trim(value), '{decimal}') THEN 'dec' ELSE 'text' END AS k FROM cells),
a AS (SELECT name, count(*) FILTER (k <> 'none') AS non_null, count(*) FILTER (k = 'none') AS nulls, count(DISTINCT v) FILTER (k <> 'none') AS distinct_values,
  count(*) FILTER (k = 'int') AS ints, count(*) FILTER (k = 'dec') AS decs, count(*) FILTER (k = 'pct') AS pcts, count(*) FILTER (k = 'date') AS dates,
  sum(length(v)) FILTER (k <> 'none') AS chars, bool_and(lower(v) IN ('true', 'false', 'yes', 'no', 'y', 'n', '0', '1')) FILTER (k <> 'none') AS boolish,
  min(try_cast(rtrim(replace(v, ',', ''), '%') AS DOUBLE)) FILTER (k <> 'none') AS low, max(try_cast(rtrim(replace(v, ',', ''), '%') AS DOUBLE)) FILTER (k <> 'none') AS high,
  avg(try_cast(rtrim(replace(v, ',', ''), '%') AS DOUBLE)) FILTER (k <> 'none') AS mean FROM k GROUP BY name),
p AS (SELECT *, CASE WHEN non_null = 0 THEN 'empty' WHEN pcts >= 0.9 * non_null THEN 'percentage' WHEN dates >= 0.9 * non_null THEN 'date'
  WHEN ints + decs >= 0.9 * non_null THEN CASE WHEN decs > 0 THEN 'decimal' ELSE 'integer' END WHEN boolish AND distinct_values <= 2 THEN 'boolean'
  WHEN distinct_values <= greatest(12, non_null * 0.1) AND chars <= 60 * non_null THEN 'categorical'
  WHEN distinct_values = non_null AND non_null > 1 THEN 'identifier' ELSE 'text' END AS dtype FROM a),
pr AS (SELECT name, dtype, non_null, nulls, distinct_values, CASE WHEN dtype IN ('integer', 'decimal', 'percentage') THEN low END AS minimum,
  CASE WHEN dtype IN ('integer', 'decimal', 'percentage') THEN high END AS maximum, CASE WHEN dtype IN ('integer', 'decimal', 'percentage') THEN round(mean, 4) END AS mean FROM p)"""


def _number(x: str) -> str:
    return f"CASE WHEN dtype NOT IN ('decimal', 'percentage') AND abs({x} - round({x})) < 1e-9 THEN format('{{:,}}', round({x})::BIGINT) ELSE format('{{:,.2f}}', {x}) END"


EVENTS = """ev AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_id % 3 = 0 AS visual,
  floor(epoch(ts))::DOUBLE AS t0, floor(epoch(ts))::DOUBLE + 3600 AS t1 FROM events)"""

LEANS = r"""(regexp_matches(content, '(?i)\bas (shown|described|noted|mentioned|discussed) (above|earlier|previously|below)\b')
  OR regexp_matches(content, '(?i)\bthis (table|figure|section|chart|diagram|approach|result|data)\b') OR regexp_matches(content, '(?i)\bthe (former|latter)\b')
  OR regexp_matches(content, '^(This|These|It|They)\b') OR regexp_matches(content, '(?i)\bsee (table|figure|fig\.?|section)\s+\d+\b'))"""


def oracle_sql() -> dict[str, str]:
    n = len(STEPS) + 1
    rules: dict[str, list[str]] = {"ligatures": ["n0"]}
    for k, step in enumerate(STEPS, 1):
        rules.setdefault(step[0], []).append(f"n{k}")
    rules["surrounding_whitespace"] = [f"n{n}"]
    found = {
        "token_counts": f"SELECT doc_id, {n_tokens('text')} AS n_tokens FROM documents",
        "normalize_probe": "SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS digest FROM documents",
        "clean_documents": f"WITH {_cleaning()} SELECT doc_id, md5(u) AS digest, ({' + '.join(f'n{k}' for k in range(n + 1))})::BIGINT AS n_fixes FROM z",
        "cleaning_report": f"WITH {_cleaning()} SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{r}' AS rule, sum({' + '.join(c)})::BIGINT AS fixes FROM z" for r, c in rules.items()) + ") WHERE fixes > 0",
        "doc_profile": f"WITH {LINES} SELECT doc_id, count(*) AS element_count, count(*) AS text_count, 0::BIGINT AS heading_count, sum(n)::BIGINT AS total_tokens, sum(n)::BIGINT AS prose_tokens, false AS is_tabular, 0.0::DOUBLE AS heading_density FROM el GROUP BY doc_id",
        "route_documents": f"""WITH {HOSTS}, p AS (SELECT doc_id, count(*) AS element_count, count(*) FILTER (kind IN ('paragraph', 'list_item')) AS text_count, count(*) FILTER (kind = 'heading') AS heading_count, sum(n)::BIGINT AS total_tokens FROM el GROUP BY doc_id),
            q AS (SELECT *, round(heading_count / greatest(1, text_count), 4) AS heading_density FROM p) SELECT *, CASE WHEN heading_count >= 3 AND heading_density >= 0.03 THEN 'structural' ELSE 'paragraph_fallback' END AS route FROM q""",
        "anaphora_rate": f"WITH {SENTENCES} SELECT doc_id, n AS sentences, round(coalesce(hits / nullif(n, 0), 0), 6) AS rate FROM r",
        "escalation_flags": f"""WITH {SENTENCES} SELECT doc_id, ((coalesce(hits / nullif(n, 0), 0) > 0.10)::BIGINT + (doc_id % 2 <> 0)::BIGINT + (doc_id % 3 = 0)::BIGINT) AS n_flags,
            coalesce(hits / nullif(n, 0), 0) > 0.10 AS leans, doc_id % 2 <> 0 AS orphan, doc_id % 3 = 0 AS bare FROM r""",
        "fixed_chunks_512_64": f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, {TOKENS}) AS t FROM documents), w AS (SELECT doc_id, t, unnest(generate_series(0, len(t) - 1, 448)) AS start FROM t WHERE len(t) > 0)
            SELECT doc_id, start // 448 AS "window", start, len(t[start + 1 : start + 512]) AS n_tokens, md5(array_to_string(t[start + 1 : start + 512], ' ')) AS digest FROM w""",
        "section_ids": f"WITH {HOSTS} SELECT doc_id, section, count(*) AS elements, sum(n)::BIGINT AS n_tokens, min(pos) AS first_pos FROM el GROUP BY ALL",
        "heading_path": f"""WITH {HOSTS} SELECT doc_id, pos, CASE WHEN kind = 'heading' OR section = 0 THEN '' ELSE first_value(text) OVER s END AS path,
            CASE WHEN kind = 'heading' OR section = 0 THEN NULL ELSE first_value(pos) OVER s END AS parent_pos FROM el WINDOW s AS (PARTITION BY doc_id, section ORDER BY pos)""",
        "surrounding_text": f"""WITH {HOSTS}, x AS (SELECT *, CASE WHEN kind IN ('paragraph', 'list_item') AND length(text) > 40 THEN substring(text, 1, 320) END AS said FROM el)
            SELECT doc_id, pos, coalesce(last_value(said IGNORE NULLS) OVER (PARTITION BY doc_id, section ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS leading,
            coalesce(first_value(said IGNORE NULLS) OVER (PARTITION BY doc_id, section ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS trailing FROM x""",
        "reading_order_edges": f"WITH {LINES} SELECT a.doc_id, a.pos AS src, b.pos AS dst, 'next' AS type, 1.0::DOUBLE AS confidence FROM el a JOIN el b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1",
        "qa_edges": f"WITH {QA} SELECT * FROM qa",
        "edge_conflicts": f"WITH {QA} SELECT doc_id, src, dst, type, confidence, importance FROM edges",
        "relationship_loss": f"""WITH {QA}, g AS (SELECT doc_id, least(src, dst) AS lo, greatest(src, dst) AS hi, importance FROM edges WHERE type <> 'next'),
            c AS (SELECT DISTINCT doc_id, lo + 1 AS cut FROM g UNION SELECT DISTINCT doc_id, hi + 1 FROM g) SELECT c.doc_id, c.cut, round(sum(importance), 6) AS loss FROM c JOIN g ON g.doc_id = c.doc_id AND lo < cut AND cut <= hi GROUP BY ALL""",
        "references_resolve": f"""WITH {LINES}, f AS (SELECT doc_id, pos AS float, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS number FROM el WHERE pos % 4 = 1)
            SELECT el.doc_id, el.pos AS src, float AS dst, 'references' AS type, 0.9::DOUBLE AS confidence FROM el JOIN f ON f.doc_id = el.doc_id AND f.number = 1 + el.pos % 3 WHERE el.pos % 4 <> 1""",
        "explaining_edges": f"""WITH {LINES}, p AS (SELECT f.doc_id, b.pos AS b, f.pos AS f FROM el f JOIN el b ON b.doc_id = f.doc_id AND b.pos = f.pos - 1 WHERE f.pos % 4 = 1)
            SELECT doc_id, b AS src, f AS dst, 'explains' AS type, 0.85::DOUBLE AS confidence FROM p JOIN el USING (doc_id) WHERE el.pos = p.b AND length(el.text) + 12 > 20 UNION ALL SELECT doc_id, f, b, 'illustrated_by', 0.85::DOUBLE FROM p JOIN el USING (doc_id) WHERE el.pos = p.b AND length(el.text) + 12 > 20""",
        "speaker_turns": f"""WITH {speech(False)}, r AS (SELECT *, lag(speaker) OVER w AS before, pos = 0 AS first FROM sp WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
            g AS (SELECT *, (sum(CASE WHEN first OR speaker IS NOT DISTINCT FROM before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT AS turn_no FROM r)
            SELECT doc_id, turn_no AS turn, md5(string_agg(text, ' ' ORDER BY pos)) AS digest, min(t0_ms) / 1000 AS start_s, max(t1_ms) / 1000 AS end_s, arg_min(speaker, pos) AS speaker, count(*) AS segments, sum(n)::BIGINT AS n_tokens FROM g GROUP BY doc_id, turn_no""",
        "chunk_documents": f"""WITH RECURSIVE {LINES},
            q AS (SELECT *, (sum(n) OVER w)::BIGINT - n AS before, (sum(n) OVER (PARTITION BY doc_id))::BIGINT AS total,
              coalesce(lag(rtrim(text) LIKE '%?' OR regexp_matches(text, {QUESTION})) OVER w, false) AS asked FROM el WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
            cuts AS (SELECT doc_id, 0::BIGINT AS s, 0::BIGINT AS base, any_value(total) AS total FROM q GROUP BY doc_id
              UNION ALL SELECT c.doc_id, arg_min(e.pos, abs(e.before - c.base - 500) * 1000000 + e.pos), arg_min(e.before, abs(e.before - c.base - 500) * 1000000 + e.pos), c.total
              FROM cuts c JOIN q e ON e.doc_id = c.doc_id AND e.pos > c.s AND NOT e.asked WHERE c.total - c.base > 700 GROUP BY c.doc_id, c.s, c.base, c.total),
            u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS unit_id, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS nxt FROM cuts)
            SELECT u.doc_id, unit_id, md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY pos) FILTER (text <> ''), '')) AS digest, 'narrative' AS unit_type, 'paragraph_fallback' AS strategy,
              'paragraph_fallback' AS route, sum(n)::BIGINT AS n_tokens, any_value(u.total - base > 700 AND nxt IS NULL) AS overflow, count(*) AS elements, CASE WHEN any_value(nxt) IS NOT NULL THEN unit_id + 1 END AS next_id
            FROM u JOIN q ON q.doc_id = u.doc_id AND q.pos >= s AND (nxt IS NULL OR q.pos < nxt) GROUP BY u.doc_id, unit_id""",
        "chunk_conversations": rf"""WITH {speech(False)}, r AS (SELECT *, CASE WHEN speaker IS DISTINCT FROM lag(speaker) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS new FROM sp),
            t AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS turn FROM r),
            f AS (SELECT *, pos = min(pos) OVER w OR t1_ms - min(t0_ms) OVER w <= 120000 AS together FROM t WINDOW w AS (PARTITION BY doc_id, turn)),
            g AS (SELECT *, CASE WHEN together THEN -1 ELSE pos END AS part FROM f),
            u AS (SELECT doc_id, turn, part, md5(string_agg(text, ' ' ORDER BY pos)) AS digest, sum(n)::BIGINT AS n_tokens, count(*) AS elements, min(pos) AS begins,
              bool_or(regexp_matches(text, '(?i)\b(action item|to-?do|will follow up|assign(ed)? to|take the lead on|action point)\b')) AS acts,
              bool_or(regexp_matches(text, '(?i)\b(we (agreed|decided|concluded)|decision (is|was)|let''s (go with|move forward with|adopt)|consensus is|approved)\b')) AS decides FROM g GROUP BY doc_id, turn, part),
            k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY begins) - 1 AS unit_id FROM u)
            SELECT doc_id, unit_id, digest, CASE WHEN acts THEN 'action_item' WHEN decides THEN 'decision' ELSE 'speaker_turn' END AS unit_type, 'temporal' AS strategy, 'temporal' AS route, n_tokens,
              false AS overflow, elements, lead(unit_id) OVER (PARTITION BY doc_id ORDER BY unit_id) AS next_id FROM k""",
        "heading_path_numbered": f"""WITH {LINES}, h AS (SELECT doc_id, pos, CASE WHEN pos % 5 = 0 THEN CASE pos % 20 WHEN 5 THEN concat(ceil(pos / 5)::INT, ' h', pos) WHEN 10 THEN concat(ceil(pos / 5 - 1)::INT, '.1 h', pos) ELSE concat('xh', pos) END END AS head FROM el),
            -- of each twenty lines: a number, one below it, and two unnumbered below that, the second of the next twenty
            p AS (SELECT *, (pos - 5) // 20 AS block, (pos - 5) % 20 AS off FROM h),
            d AS (SELECT doc_id, pos, head IS NOT NULL AS is_head, CASE WHEN pos >= 5 THEN block * 20 + 5 END AS one, CASE WHEN pos >= 5 AND off >= 5 THEN block * 20 + 10 END AS two, pos >= 5 AND off >= 5 AS below FROM p),
            n AS (SELECT d.*, a.head AS h1, b.head AS h2, z.head AS h0 FROM d LEFT JOIN h a ON a.doc_id = d.doc_id AND a.pos = one LEFT JOIN h b ON b.doc_id = d.doc_id AND b.pos = two LEFT JOIN h z ON z.doc_id = d.doc_id AND z.pos = 0)
            SELECT doc_id, pos, CASE WHEN pos < 5 THEN CASE WHEN is_head THEN '' ELSE h0 END WHEN pos = one THEN '' WHEN pos = two OR NOT below THEN h1 ELSE concat(h1, ' > ', h2) END AS path,
              CASE WHEN pos < 5 THEN CASE WHEN is_head THEN NULL ELSE 0 END WHEN pos = one THEN NULL WHEN pos = two OR NOT below THEN one ELSE two END::BIGINT AS parent_pos,
              CASE WHEN NOT is_head THEN NULL WHEN pos = 0 THEN 1 WHEN pos = one THEN 2 WHEN pos = two THEN 3 ELSE 4 END::BIGINT AS level FROM n""",
        "enrichment_prompts": f"""WITH {HOSTS}, b AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY unit_id) - 1) // 6 AS batch FROM units WHERE unit_type = 'section'),
            k AS (SELECT doc_id, batch, count(*) AS units, string_agg(concat('<chunk id="', unit_id, '" section="', replace({_fence("split_part(content, chr(10), 1)")}, '"', chr(39)), '">', chr(10), {_fence("substring(content, 1, 2400)")}, chr(10), '</chunk>'), chr(10) ORDER BY unit_id) AS chunks FROM b GROUP BY doc_id, batch),
            d AS (SELECT doc_id, {_fence("substring(string_agg(content, chr(10) || chr(10) ORDER BY unit_id), 1, 24000)")} AS document FROM units GROUP BY doc_id)
            SELECT doc_id, batch, units, md5(concat('<document>', chr(10), document, chr(10), '</document>', chr(10), chr(10), 'Say where each of these ', units, ' chunks stands in the document.', chr(10), chr(10), chunks)) AS digest FROM k JOIN d USING (doc_id)""",
        "enrichment_applied": f"""WITH {HOSTS}, b AS (SELECT doc_id, unit_id, (row_number() OVER (PARTITION BY doc_id ORDER BY unit_id) - 1) // 6 AS batch FROM units WHERE unit_type = 'section'),
            k AS (SELECT *, unit_id % 4 <> 0 AND batch % 5 <> 4 AS said FROM b)
            SELECT doc_id, unit_id, CASE WHEN said THEN concat('about ', unit_id) ELSE '' END AS summary, CASE WHEN NOT said THEN 0 WHEN batch % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS tier,
              CASE WHEN said THEN array_to_string(list_transform(range(1, least(unit_id % 11 + 1, 8) + 1), lambda x: concat('e', x)), ',') ELSE '' END AS entities, CASE WHEN said THEN batch * 0.25 ELSE 0 END::DOUBLE AS cost_usd FROM k""",
        "column_examples_customer": f"""WITH {_profile('customer')}, placed AS ({_placed("customer", "c_custkey")}),
            given AS (SELECT name, trim(value) AS value, place FROM placed WHERE lower(trim(value)) NOT IN ('', '-', 'n/a', 'na', 'null', 'none', 'nan')),
            uniq AS (SELECT name, value, min(place) AS place FROM given GROUP BY name, value),
            ex AS (SELECT pr.name, pr.dtype, uniq.value, uniq.place FROM pr JOIN uniq USING (name) WHERE dtype IN ('categorical', 'boolean') QUALIFY row_number() OVER (PARTITION BY name ORDER BY place) <= 8
              UNION ALL SELECT pr.name, pr.dtype, given.value, given.place FROM pr JOIN given USING (name) WHERE dtype NOT IN ('categorical', 'boolean', 'empty') QUALIFY row_number() OVER (PARTITION BY name ORDER BY place) <= 2)
            SELECT pr.name, pr.dtype, coalesce(string_agg(ex.value, '|' ORDER BY ex.place), '') AS examples FROM pr LEFT JOIN ex USING (name) GROUP BY pr.name, pr.dtype""",
        "paragraph_pack_units": f"""WITH RECURSIVE {LINES}, q AS (SELECT *, (sum(n) OVER w)::BIGINT - n AS before, (sum(n) OVER (PARTITION BY doc_id))::BIGINT AS total FROM el WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
            cuts AS (SELECT doc_id, 0::BIGINT AS s, 0::BIGINT AS base, any_value(total) AS total FROM q GROUP BY doc_id
              UNION ALL SELECT c.doc_id, arg_min(e.pos, abs(e.before - c.base - 500) * 1000000 + e.pos), arg_min(e.before, abs(e.before - c.base - 500) * 1000000 + e.pos), c.total
              FROM cuts c JOIN q e ON e.doc_id = c.doc_id AND e.pos > c.s WHERE c.total - c.base > 700 GROUP BY c.doc_id, c.s, c.base, c.total),
            u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS unit_id, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS nxt FROM cuts)
            SELECT u.doc_id, unit_id::INT AS unit_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY pos) FILTER (text <> ''), '') AS content, count(*)::INT AS elements, min(pos)::INT AS first_pos, sum(n)::BIGINT AS n_tokens,
              any_value(u.total - base > 700 AND nxt IS NULL) AS overflow, 'narrative' AS unit_type, 'paragraph_fallback' AS strategy
            FROM u JOIN q ON q.doc_id = u.doc_id AND q.pos >= s AND (nxt IS NULL OR q.pos < nxt) GROUP BY u.doc_id, unit_id""",
        "structural_units": f"""WITH RECURSIVE {HOSTS}, q AS (SELECT *, (sum(n) OVER w)::BIGINT - n AS before, (sum(n) OVER a)::BIGINT AS total, first_value(kind) OVER w = 'heading' AS headed, pos = max(pos) OVER a AS last, lag(kind) OVER w AS prev
              FROM el WINDOW w AS (PARTITION BY doc_id, section ORDER BY pos), a AS (PARTITION BY doc_id, section)),
            legal AS (SELECT * FROM q WHERE prev IS NOT NULL AND prev <> 'heading' AND (last OR NOT headed)), -- a heading is the parent of all that follow: at most one may be cut off
            cuts AS (SELECT doc_id, section, min(pos) AS s, 0::BIGINT AS base, any_value(total) AS total FROM q GROUP BY doc_id, section
              UNION ALL SELECT c.doc_id, c.section, arg_min(e.pos, abs(e.before - c.base - 500) * 1000000 + e.pos), arg_min(e.before, abs(e.before - c.base - 500) * 1000000 + e.pos), c.total
              FROM cuts c JOIN legal e ON e.doc_id = c.doc_id AND e.section = c.section AND e.pos > c.s WHERE c.total - c.base > 700 GROUP BY c.doc_id, c.section, c.s, c.base, c.total),
            u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS unit_id, lead(s) OVER (PARTITION BY doc_id, section ORDER BY s) AS nxt FROM cuts)
            SELECT u.doc_id, unit_id::INT AS unit_id, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS content, count(*)::INT AS elements, min(pos)::INT AS first_pos, sum(n)::BIGINT AS n_tokens,
              any_value(u.total - base > 700 AND nxt IS NULL) AS overflow, CASE WHEN arg_min(kind, pos) = 'heading' THEN 'section' ELSE 'narrative' END AS unit_type, 'structural' AS strategy
            FROM u JOIN q ON q.doc_id = u.doc_id AND q.section = u.section AND q.pos >= s AND (nxt IS NULL OR q.pos < nxt) GROUP BY u.doc_id, unit_id""",
        "micro_turn_merge": f"""WITH {speech(False)}, r AS (SELECT * EXCLUDE (speaker), CASE WHEN pos % 3 <> 0 THEN speaker END AS speaker FROM sp),
            b AS (SELECT *, CASE WHEN pos > 0 AND speaker IS DISTINCT FROM lag(speaker) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS new FROM r),
            t AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM b),
            g AS (SELECT doc_id, run, max(t1_ms) - min(t0_ms) AS ms, any_value(speaker) AS speaker, count(*) AS segments, min(pos) AS first_pos FROM t GROUP BY doc_id, run),
            j AS (SELECT *, ms < 20000 AND run > 0 AND (speaker IS NULL OR speaker IS NOT DISTINCT FROM lag(speaker) OVER (PARTITION BY doc_id ORDER BY run)) AS joins FROM g),
            k AS (SELECT *, (sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY run) - 1)::BIGINT AS turn FROM j)
            SELECT doc_id, turn, sum(segments)::BIGINT AS segments, min(first_pos) AS first_pos FROM k GROUP BY doc_id, turn""",
        "long_turn_split": f"""WITH {speech(False)}, f AS (SELECT *, pos = 0 OR t1_ms <= 40000 AND max(t1_ms) OVER w > 40000 OR max(t1_ms) OVER w <= 40000 AS together FROM sp WINDOW w AS (PARTITION BY doc_id))
            SELECT doc_id, 0::BIGINT AS turn, pos, (sum(CASE WHEN together THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos))::INT AS part FROM f""",
        "enrichment_batches": f"""WITH {HOSTS}, b AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY unit_id) - 1) // 6 AS batch FROM units WHERE unit_type = 'section')
            SELECT doc_id, batch, count(*) AS units, md5(string_agg(concat('<chunk id="', unit_id, '">', chr(10), {_fence("substring(content, 1, 2400)")}, chr(10), '</chunk>'), chr(10) ORDER BY unit_id)) AS digest FROM b GROUP BY doc_id, batch""",
        "boundary_candidates": f"""WITH {QA}, {CANDIDATES} SELECT doc_id, pos, speaker_change, 0::DOUBLE AS temporal_gap, graph_separation, loss, false AS vetoed, round(score, 6) AS score FROM cand""",
        "event_windows": f"""WITH {QA}, {CANDIDATES}, w AS (SELECT sp.doc_id, sp.pos, sp.n, coalesce(sum(CASE WHEN 0.5 + 0.15 * score >= 0.55 THEN 1 ELSE 0 END) OVER (PARTITION BY sp.doc_id ORDER BY sp.pos), 0)::BIGINT AS window_no
              FROM sp LEFT JOIN cand ON cand.doc_id = sp.doc_id AND cand.pos = sp.pos)
            SELECT doc_id, window_no AS "window", count(*) AS elements, sum(n)::BIGINT AS n_tokens FROM w GROUP BY doc_id, window_no""",
        "conversational_type": rf"""WITH {speech(True)}, x AS (SELECT *, nxt IS NULL AS final FROM sp),
            g AS (SELECT doc_id, bool_or(regexp_matches(text, '(?i)\b(action item|to-?do|will follow up|assign(ed)? to|take the lead on|action point)\b')) AS acts,
              bool_or(regexp_matches(text, '(?i)\b(we (agreed|decided|concluded)|decision (is|was)|let''s (go with|move forward with|adopt)|consensus is|approved)\b')) AS decides,
              bool_or((regexp_matches(text, {QUESTION}) OR regexp_matches(text, '(?m)\?$')) AND NOT final) AS asks, count(DISTINCT speaker) FILTER (speaker <> '') AS speakers, count(*) AS turns FROM x GROUP BY doc_id)
            SELECT doc_id, speakers, turns, CASE WHEN acts THEN 'action_item' WHEN decides THEN 'decision' WHEN asks AND speakers > 1 THEN 'question_answer' WHEN speakers > 1 THEN 'discussion' WHEN speakers = 1 THEN 'speaker_turn' ELSE 'narrative' END AS type FROM g""",
        **{f"column_profile_{t}": f"WITH {_profile(t)} SELECT * FROM pr" for t in TABLES},
        "schema_card_orders": f"""WITH {_profile('orders')} SELECT name, dtype, name || ' (' || dtype || CASE WHEN nulls > 0 THEN ', ' || nulls || ' empty' ELSE '' END || ')' || CASE WHEN minimum IS NOT NULL
            THEN ': ' || {_number('minimum')} || ' … ' || {_number('maximum')} || ', mean ' || {_number('mean')} WHEN dtype = 'identifier' THEN ': ' || format('{{:,}}', distinct_values) || ' unique values' ELSE '' END AS line FROM pr""",
        "row_groups_customer": rf"""WITH RECURSIVE m AS (SELECT c_nationkey AS sheet, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS row_no,
              '| ' || c_custkey || ' | ' || c_name || ' | ' || c_nationkey || ' | ' || printf('%.2f', c_acctbal) || ' | ' || c_mktsegment || ' |' AS md FROM customer),
            h AS (SELECT '| c_custkey | c_name | c_nationkey | c_acctbal | c_mktsegment |' AS head), c AS (SELECT *, {n_tokens('md')} AS cost, (SELECT {n_tokens('head')} FROM h) AS base FROM m),
            f AS (SELECT sheet, row_no, md, 0::BIGINT AS grp, base + cost AS acc FROM c WHERE row_no = 0 UNION ALL
              SELECT c.sheet, c.row_no, c.md, f.grp + (f.acc + c.cost > 300)::BIGINT, CASE WHEN f.acc + c.cost > 300 THEN base + cost ELSE f.acc + cost END FROM f JOIN c ON c.sheet = f.sheet AND c.row_no = f.row_no + 1)
            SELECT sheet, grp, count(*) AS n_rows, min(row_no) + 2 AS first_row, max(row_no) + 2 AS last_row, md5((SELECT head FROM h) || chr(10) || '|---|---|---|---|---|' || chr(10) || string_agg(md, chr(10) ORDER BY row_no)) AS digest FROM f GROUP BY ALL""",
        "overlap_edges": f"""WITH {EVENTS} SELECT s.doc_id, s.pos AS src, v.pos AS dst, 'occurs_during' AS type, 0.85::DOUBLE AS confidence FROM ev s JOIN ev v ON s.doc_id = v.doc_id AND NOT s.visual AND v.visual AND least(s.t1, v.t1) - greatest(s.t0, v.t0) > 0""",
        "fusion_confidence": f"""WITH {EVENTS}, g AS (SELECT doc_id, min(t0) FILTER (NOT visual) AS s0, max(t1) FILTER (NOT visual) AS s1, min(t0) FILTER (visual) AS v0, max(t1) FILTER (visual) AS v1 FROM ev GROUP BY doc_id),
            x AS (SELECT doc_id, round(CASE WHEN s0 IS NULL OR v0 IS NULL THEN 0.3 ELSE round(0.5 * (greatest(0, least(s1, v1) - greatest(s0, v0)) / (greatest(s1, v1) - least(s0, v0))) + 0.25, 6) END, 6)::DOUBLE AS score FROM g)
            SELECT doc_id, score, CASE WHEN score > 0.7 THEN 'strong' WHEN score > 0.4 THEN 'medium' WHEN score > 0 THEN 'weak' ELSE 'none' END AS label FROM x""",
        "semantic_drift_groups": """WITH e AS (SELECT vec_id // 25 AS doc_id, vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT doc_id, vec_id, round(list_dot_product(v, lag(v) OVER (PARTITION BY doc_id ORDER BY vec_id)), 6) AS sim FROM e),
            t AS (SELECT doc_id, count(*) AS n, round(avg(sim) - stddev_pop(sim), 6) AS least FROM s GROUP BY doc_id),
            g AS (SELECT s.doc_id, vec_id, coalesce(sum(CASE WHEN n >= 4 AND sim < least THEN 1 ELSE 0 END) OVER (PARTITION BY s.doc_id ORDER BY vec_id), 0)::BIGINT AS grp FROM s JOIN t ON t.doc_id = s.doc_id)
            SELECT doc_id, grp, count(*) AS n, min(vec_id) AS first_id FROM g GROUP BY ALL""",
        "semantic_shifts": """WITH e AS (SELECT vec_id // 25 AS doc_id, vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT doc_id, vec_id, round(list_dot_product(v, lag(v) OVER (PARTITION BY doc_id ORDER BY vec_id)), 6) AS sim FROM e),
            t AS (SELECT doc_id, avg(sim) AS mean, stddev_pop(sim) AS std FROM s GROUP BY doc_id)
            SELECT s.doc_id, vec_id AS pos, round(round(least(1.0, (mean - std - sim) / greatest(std, 0.05)), 4), 2) AS semantic_shift FROM s JOIN t ON t.doc_id = s.doc_id WHERE sim < mean - std""",
        "topk_search": "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 5",
        "topk_search_every_20th": """SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank
            FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 20 = 0 QUALIFY rank <= 5""",
        "retrieval_eval_benchmark": """WITH w AS (SELECT DISTINCT doc_id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS word FROM documents),
            p AS (SELECT DISTINCT item_id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS word FROM benchmark),
            s AS (SELECT item_id AS probe, doc_id AS unit, count(*) AS score FROM p JOIN w USING (word) WHERE word <> '' GROUP BY ALL),
            r AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, unit) AS rank FROM s),
            t AS (SELECT item_id AS probe, doc_id AS unit FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
            o AS (SELECT t.probe, count(*) FILTER (rank <= 5) AS hits, min(rank) AS rank FROM t LEFT JOIN r USING (probe, unit) GROUP BY t.probe)
            SELECT count(*) AS probes, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS recall_at_k, round(avg(hits / 5), 6) AS precision_at_k, round(avg(coalesce(1 / rank, 0)), 6) AS mrr FROM o""",
        "retrieval_eval": """WITH w AS (SELECT DISTINCT doc_id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS word FROM documents),
            p AS (SELECT DISTINCT doc_id, unnest(string_split(trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+', ' ', 'g')), ' ')) AS word FROM documents WHERE doc_id % 20 = 0),
            s AS (SELECT p.doc_id AS probe, w.doc_id AS unit, count(*) AS score FROM p JOIN w USING (word) WHERE word <> '' GROUP BY ALL),
            r AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, unit) AS rank FROM s), t AS (SELECT doc_id AS probe FROM documents WHERE doc_id % 20 = 0)
            SELECT count(*) AS probes, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS recall_at_k, round(avg(CASE WHEN rank <= 5 THEN 0.2 ELSE 0.0 END)::DOUBLE, 6) AS precision_at_k, round(avg(coalesce(1 / rank, 0)), 6) AS mrr
            FROM t LEFT JOIN r ON r.probe = t.probe AND r.unit = t.probe""",
        "completeness": f"""WITH {HOSTS}, u AS (SELECT doc_id, unit_id, CASE WHEN unit_id % 3 = 0 THEN content || ' as shown above' ELSE content END AS content, CASE unit_id % 5 WHEN 0 THEN 'row_group' WHEN 1 THEN 'table' ELSE 'section' END AS kind, unit_id % 2 = 1 AS odd FROM units),
            v AS (SELECT *, 2 + (kind = 'row_group')::INT + (kind = 'table')::INT + odd::INT AS applying,
              (unit_id % 4 <> 0 OR kind = 'table')::INT + (kind = 'row_group' AND odd)::INT + (kind = 'table' AND odd)::INT + (NOT {LEANS} OR unit_id % 7 = 0)::INT + (odd AND unit_id % 3 = 1)::INT AS passed FROM u)
            SELECT doc_id, unit_id, round(passed / applying, 3) AS completeness FROM v""",
        "unit_measures": f"""WITH {HOSTS} SELECT doc_id, count(*) AS units, CASE WHEN count(*) <= 1 THEN 1.0 ELSE round(count(*) FILTER (unit_id % 2 = 1 OR unit_id % 4 = 0) / count(*), 3) END::DOUBLE AS coherence,
            round(count(*) FILTER (n_tokens < 40) / count(*), 3) AS fragmentation, round(stddev_pop(n_tokens), 2) AS size_stddev FROM units GROUP BY doc_id""",
        "heading_scorecard": f"""WITH {HOSTS}, p AS (SELECT e.doc_id, e.pos, substring({_norm('e.text')}, 1, 80) AS bearing, substring({_norm('h.text')}, 1, 60) AS wanted FROM el e JOIN el h ON h.doc_id = e.doc_id AND h.section = e.section AND h.kind = 'heading' WHERE e.kind = 'paragraph' AND length(e.text) >= 60),
            w AS (SELECT doc_id, regexp_extract_all(string_agg(content, chr(10) || chr(10) ORDER BY unit_id), {TOKENS}) AS t FROM units GROUP BY doc_id), ws AS (SELECT doc_id, t, unnest(generate_series(0, len(t) - 1, 448)) AS start FROM w),
            ch AS (SELECT 'sections' AS arm, doc_id, {_norm('content')} AS chunk FROM units UNION ALL SELECT 'fixed', doc_id, {_norm("array_to_string(t[start + 1 : start + 512], ' ')")} FROM ws),
            o AS (SELECT a.arm, p.doc_id, p.pos, coalesce(bool_or(contains(chunk, wanted)) FILTER (bearing <> '' AND contains(chunk, bearing)), false) AS ok FROM p CROSS JOIN (VALUES ('sections'), ('fixed')) a(arm) LEFT JOIN ch ON ch.doc_id = p.doc_id AND ch.arm = a.arm GROUP BY ALL)
            SELECT 'heading' AS metric, count(*) FILTER (ok) AS hits, count(*) AS total, round(100 * count(*) FILTER (ok) / count(*), 1) AS pct, arm FROM o GROUP BY arm""",
        "cross_doc_links": """WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS doc_id FROM pages), u AS (SELECT a.page_id, a.doc_id, b.doc_id AS other FROM h a JOIN h b ON b.page_id = a.page_id + 1),
            t AS (SELECT doc_id, max(page_id) AS target_id FROM u GROUP BY doc_id) SELECT u.doc_id, page_id AS unit_id, other AS target_doc, target_id, 'references' AS type, 0.85::DOUBLE AS confidence FROM u JOIN t ON t.doc_id = u.other WHERE u.doc_id <> u.other""",
        "usage_ledger": """WITH c AS (SELECT (['gemini-2.5-flash', 'gemini-2.5-flash-lite', 'gemini-2.0-flash', 'ollama/small', 'unknown-1'])[user_id % 5 + 1] AS model, event_id % 997 AS i, event_id % 101 AS o, event_id % 53 AS k FROM events),
            p AS (SELECT *, CASE WHEN model LIKE 'ollama/%' THEN 0 WHEN model LIKE 'gemini-2.5-flash%' OR model LIKE 'unknown%' THEN greatest(0, i - k) * 0.30 + k * 0.075 + o * 2.50 ELSE greatest(0, i - k) * 0.10 + k * 0.025 + o * 0.40 END::DOUBLE / 1e6 AS cost FROM c)
            SELECT model, count(*) AS calls, sum(i)::BIGINT AS in_tokens, sum(o)::BIGINT AS out_tokens, sum(k)::BIGINT AS cached_tokens, round(sum(cost), 6) AS cost, model LIKE 'unknown%' AS estimated, round(100 * sum(k) / sum(i), 1) AS cache_hit_pct FROM p GROUP BY model""",
        "export_chroma": f"WITH {HOSTS} SELECT doc_id || ':' || unit_id AS id, md5(content) AS document, unit_type AS meta_type, 'structural' AS meta_strategy, n_tokens AS meta_tokens FROM units",
        "export_langchain": f"WITH {HOSTS} SELECT doc_id, unit_id, md5(content) AS digest, unit_type FROM units",
        "unit_hierarchy": f"""WITH {HOSTS}, x AS (SELECT doc_id, unit_id, lag(unit_id) OVER w AS previous_id, lead(unit_id) OVER w AS next_id, first_value(unit_id) OVER (PARTITION BY doc_id, unit_id % 3 ORDER BY unit_id) AS head FROM units WINDOW w AS (PARTITION BY doc_id ORDER BY unit_id))
            SELECT doc_id, unit_id, previous_id, next_id, CASE WHEN unit_id % 3 <> 0 AND head <> unit_id THEN head END AS parent_id FROM x""",
    }
    return found

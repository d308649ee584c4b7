"""DuckDB SQL for the registered queries."""

from __future__ import annotations

_JS = r"\t\n\v\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_WHITE = r"\t\n\v\f\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_START = (
    rf"(?i)^(?:第[^{_JS}，。！？!?]{{1,24}}[章回节卷部篇集]|序章|序言|楔子|前言|引子|终章|尾声|后记"
    rf"|番外(?:[{_JS}]*[0-9〇零一二三四五六七八九十百千万两]+)?|chapter[{_JS}]+(?:[0-9]+|[ivxlcdm]+))"
)


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{_JS}]+|[{_JS}]+$', '', 'g')"


def _is_heading(x: str) -> str:
    t = _trim(x)
    core = f"regexp_extract({t}, '{_START}')"
    return f"({core} <> '' AND length({t}) <= 120 AND (length({core}) = length({t}) OR regexp_matches(substr({t}, length({core}) + 1, 1), '^[{_JS}:：.．·—-]')))"


def _visible(x: str) -> str:
    return f"length(regexp_replace({x}, '[{_WHITE}]+', '', 'g'))"


_RAW = """raw AS (
  SELECT coalesce(source, 'unknown') AS book_id, doc_id AS part,
    CASE WHEN doc_id % 2 = 0 THEN '第' || doc_id || '章' || chr(12288) ELSE 'Chapter ' || doc_id || ' - ' END
      || coalesce(lang, '') || chr(160) || chr(13) || chr(10) || coalesce(text, '') || chr(13) || chr(10) AS raw
  FROM documents WHERE doc_id IS NOT NULL
), parts AS (
  SELECT book_id, part, raw, replace(regexp_replace(raw, '\\r\\n?', chr(10), 'g'), chr(160), ' ') AS text FROM raw
)"""
_LINES = (
    _RAW
    + """, pieces AS (
  SELECT book_id, part, i - 1 AS pos, p[i] AS body FROM (SELECT *, string_split(text, chr(10)) AS p FROM parts) t, unnest(range(1, len(p))) AS u(i)
), lines AS (
  SELECT *, CAST(coalesce(sum(strlen(body) + 1) OVER (PARTITION BY book_id ORDER BY part, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_byte,
    row_number() OVER (PARTITION BY book_id ORDER BY part, pos) AS line FROM pieces
), totals AS (SELECT book_id, CAST(sum(strlen(text)) AS BIGINT) AS total FROM parts GROUP BY book_id)"""
)
_CHAPTERS = (
    _LINES
    + f""", found AS (
  SELECT book_id, start_byte AS line_start, start_byte + strlen(body) + 1 AS content_start,
    regexp_replace({_trim('body')}, '[\\t \\x{{3000}}]+', ' ', 'g') AS title,
    start_byte + strlen(regexp_extract(body, '^[{_JS}]*')) AS heading_start,
    start_byte + strlen(regexp_extract(body, '^[{_JS}]*')) + strlen({_trim('body')}) AS heading_end
  FROM lines WHERE {_is_heading('body')}
), chapters AS (
  SELECT f.book_id, CAST(row_number() OVER w AS BIGINT) AS ord, title, heading_start, heading_end, content_start,
    coalesce(lead(line_start) OVER w, total) AS content_end, total
  FROM found f JOIN totals t ON t.book_id = f.book_id WINDOW w AS (PARTITION BY f.book_id ORDER BY line_start)
)"""
)
_UNITS = lambda x: f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def _places(pattern: str, texts: str) -> str:
    """hits: where a pattern stands in ``texts`` (book_id, part, text, base, base16), and the text on both sides of it."""
    return f"""cut AS (
  SELECT book_id, part, base, base16, string_split_regex(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS m FROM ({texts})
), pieces AS (
  SELECT book_id, part, base, base16, i, p[i] AS piece, p[i + 1] AS follows, m[i] AS hit FROM cut, unnest(range(1, len(p))) AS u(i)
), hits AS (
  SELECT book_id, piece, follows, CAST(base + sum(strlen(piece) + strlen(hit)) OVER w AS BIGINT) AS e, strlen(hit) AS n,
    CAST(base16 + sum({_UNITS('piece')} + {_UNITS('hit')}) OVER w AS BIGINT) AS e16, {_UNITS('hit')} AS n16 FROM pieces WINDOW w AS (PARTITION BY book_id, part ORDER BY i)
)"""


_BASED = f"""SELECT *, coalesce(sum(strlen(text)) OVER w, 0) AS base, coalesce(sum({_UNITS('text')}) OVER w, 0) AS base16
  FROM parts WINDOW w AS (PARTITION BY book_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
_PLACED = "book_id, row_number() OVER o AS number, e - n AS start_byte, e AS end_byte, e16 - n16 AS start_utf16, e16 AS end_utf16, count(*) OVER (PARTITION BY book_id) AS total"
_ORDERED = "WINDOW o AS (PARTITION BY book_id ORDER BY e)"
_LOOSE = (
    _CHAPTERS
    + """, loose AS (
  SELECT book_id, ord, book_id || '-' || ord AS chapter_id, title, heading_start, heading_end, content_start, total,
    CASE WHEN ord % 4 = 0 AND content_end - content_start > 30 THEN content_end - 7 ELSE content_end END AS content_end FROM chapters
), holes AS (
  SELECT book_id, content_start + (content_end - content_start) // 2 AS s, content_end AS e FROM loose WHERE ord % 5 = 0 AND content_end - content_start > 40
  UNION ALL SELECT book_id, content_start, content_start + 10 FROM loose WHERE ord % 5 = 0 AND content_end - content_start > 40
), implicit AS (
  SELECT book_id, chapter_id, coalesce(lag(content_end) OVER w, 0) AS s, heading_start AS e, 'uncovered-to-next' AS reason FROM loose WINDOW w AS (PARTITION BY book_id ORDER BY ord)
  UNION ALL SELECT book_id, chapter_id, heading_start, content_end, NULL FROM loose
  UNION ALL SELECT book_id, arg_max(chapter_id, ord), arg_max(content_end, ord), any_value(total), 'uncovered-to-last' FROM loose GROUP BY book_id
), merged AS (
  SELECT book_id, min(s) AS s, max(e) AS e FROM (
    SELECT *, sum(opens) OVER (PARTITION BY book_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (
      SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY book_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS opens FROM holes WHERE s < e)
  ) GROUP BY book_id, g
), gaps AS (
  SELECT book_id, coalesce(lag(e) OVER w, 0) AS s, s AS e FROM merged WINDOW w AS (PARTITION BY book_id ORDER BY s)
  UNION ALL SELECT t.book_id, coalesce(max(m.e), 0), 9000000000000 FROM totals t LEFT JOIN merged m ON m.book_id = t.book_id GROUP BY t.book_id
)"""
)


def _cut(rows: str, columns: str) -> str:
    """Fragments of the ranges of ``rows`` outside the holes."""
    return f"SELECT r.book_id, {columns}, greatest(r.s, g.s) AS start_byte, least(r.e, g.e) AS end_byte FROM {rows} r JOIN gaps g ON g.book_id = r.book_id AND r.s < g.e AND g.s < r.e WHERE greatest(r.s, g.s) < least(r.e, g.e)"


_EXPLICIT = _LOOSE + ", explicit AS (" + _cut("(SELECT * FROM implicit WHERE s < e)", "'chapter' AS classification, chapter_id, reason") + " UNION ALL SELECT book_id, 'unknown', NULL, NULL, s, e FROM holes)"
_RANGES = """r AS (
  SELECT user_id, event_id, event_type, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + CAST(floor(value * 60) AS BIGINT) AS e FROM events
)"""


def _islands(rows: str) -> str:
    return f"""SELECT user_id, min(s) AS s, max(e) AS e FROM (
    SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (
      SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS opens FROM {rows} WHERE s < e)
  ) GROUP BY user_id, g"""


_DEPENDENCIES = """items AS (
  SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, min(l_linestatus) AS status, min(l_returnflag) AS flag FROM lineitem GROUP BY ALL
), revisions AS (
  SELECT 'c-' || l_orderkey || '-' || l_linenumber AS revision_id, l_orderkey, 'a' || part AS artifact_id, flag AS artifact_type,
    CASE WHEN status = 'O' THEN 'current' ELSE 'superseded' END AS validity_status FROM items
)"""
_BASELINES = "b AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS baseline_revision FROM orders)"
_COMMANDS = (
    _DEPENDENCIES
    + ", "
    + _BASELINES
    + """, c AS (
  SELECT o_custkey AS key, o_orderkey, baseline_revision AS held, baseline_revision - CASE WHEN o_custkey % 4 = 1 THEN 1 ELSE 0 END AS asked FROM b QUALIFY baseline_revision = max(baseline_revision) OVER (PARTITION BY o_custkey)
), n AS (
  SELECT c.*, count(r.revision_id) AS n, key % 3 <> 0 AND key % 7 <> 0 AND key % 50 > 10 AS opened FROM c LEFT JOIN revisions r ON r.l_orderkey = c.o_orderkey AND validity_status = 'current' GROUP BY ALL
), outcomes AS (
  -- The older preview, of nothing, is the last one left where the other expired or was consumed.
  SELECT *, CASE WHEN asked <> held THEN 'conflict' WHEN key % 3 <> 0 AND (n = 0 OR (opened AND key % 5 <> 2)) THEN 'applied' ELSE 'preview-required' END AS outcome FROM n
)"""
)
_LEGACY = (
    "[" + ", ".join(f"['{n}', {repr(t) if t else 'NULL'}, {repr(e) if e else 'NULL'}]" for n, t, e in [
        ("gb2312", "启程", None), ("gbk", "第一章", None), ("gbk", None, "decode-failed"), ("gb18030", "😀", None), ("gb18030", "第一章#", None), ("big5", "第一章", None), ("big5", None, "decode-failed"),
        ("gb2312", None, "decode-failed"), ("shift_jis", None, "encoding-not-allowed"), ("gbk", None, "binary-nul"), ("utf-16le", "第一", None), ("utf-16be", "第一", None),
    ]) + "]"
).replace("第一章#'", "第一章' || chr(10)")
_TASKS = """ev AS (
  SELECT user_id AS task_id, user_id % 10 AS project_id, event_id + 1 AS sequence, epoch_us(ts) // 1000000 AS occurred_at, CAST(floor(value) AS BIGINT) AS completed,
    CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' END AS state FROM events
), latest AS (
  SELECT task_id, arg_max(state, sequence) AS state, arg_max(completed, sequence) AS completed, arg_max(occurred_at, sequence) AS occurred_at,
    CAST(greatest(count(*) FILTER (state = 'pending'), 1) AS BIGINT) AS attempt, max(sequence) AS sequence FROM ev GROUP BY task_id
)"""
_FLAGS = "flags AS (SELECT c_custkey AS project_id, c_custkey % 5 = 0 AS has_task, c_custkey % 3 = 0 AS completed, c_custkey % 3 = 1 AS reviewable FROM customer)"
_PROJECTS = """projects AS (
  SELECT c_custkey AS project_id, c_name AS display_name, 'dir/' || (c_custkey % 1000) || '/' || c_name AS directory_path, o.last_opened_at
  FROM customer JOIN (SELECT o_custkey, max(o_orderkey) AS last_opened_at FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey
)"""
_PAGES = ", ".join(
    f"('{k}', {repr(v) if v else 'NULL'})"
    for k, v in {
        "text-extraction": "01", "chapter-splitting": "01", "proofreading": "02", "script-management": "03", "character-extraction": "04",
        "primary-character-marking": "04", "crowd-voice-pool": "05", "character-voice-refinement": "05", "chapter-parameters": "07",
        "selection-requirements": "07", "chapter-generation": "07", "stale-propagation": "07", "asr-review": "08", "loudness-consistency": "09",
        "timeline-alignment": "10", "chapter-summary": "11", "chapter-cover": "11", "tar-export": "11", "offline-player-export": "11",
        "project-settings": None, "project-backup": "11", "software-settings": None,
    }.items()
)
_FORMS = ["第{}章 x", "第{}章x", "　第{}回　\tx  ", "Chapter {} - x", "chapter {}x", "CHAPTER XIV: {}", "番外 三：{}", "番外 三丑 {}", "序章", "序章{}", "第{}", "尾声—{}", "第{}章 " + "甲" * 120]


def _choose(forms: list[str]) -> str:
    return "replace((['" + "', '".join(forms) + f"'])[doc_id % {len(forms)} + 1], '{{}}', CAST(doc_id AS VARCHAR))"


_NAMES = ["a{}.txt", "b{}.TXT", ".txt", "c{}.text", "d/{}.txt", "e\\{}.txt", "..", "f {}.Txt"]
_TURNS = f"t AS (SELECT conv_id, turn, CAST({_visible("coalesce(text, '')")} AS BIGINT) AS length FROM conversations)"


def _quantile(p: float) -> str:
    rank = f"((len(l) + 1) * {p})"
    return f"CASE WHEN {rank} <= 1 THEN l[1] WHEN {rank} >= len(l) THEN l[-1] ELSE l[CAST(floor({rank}) AS BIGINT)] + ({rank} - floor({rank})) * (l[CAST(floor({rank}) AS BIGINT) + 1] - l[CAST(floor({rank}) AS BIGINT)]) END"


def _fences(rows: str, by: str) -> str:
    return f"SELECT {by}, CAST(len(l) AS BIGINT) AS n, CAST({_quantile(0.25)} AS DOUBLE) AS q1, CAST({_quantile(0.75)} AS DOUBLE) AS q3 FROM (SELECT {by}, list(CAST(length AS DOUBLE) ORDER BY length) AS l FROM {rows} WHERE length > 0 GROUP BY {by})"


def _spread(rows: str, by: str, order: str) -> str:
    return f"""SELECT *, list_aggregate(logs, 'median') AS center, len(logs) AS n_near, list_aggregate(list_transform(logs, lambda x: abs(x - list_aggregate(logs, 'median'))), 'median') AS spread FROM (
    SELECT *, list_filter(list(CASE WHEN length > 0 THEN ln(CAST(length AS DOUBLE)) END) OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), lambda x: x IS NOT NULL) AS logs FROM {rows})"""


_BODIES = (
    _LINES
    + f""", marked AS (
  SELECT book_id, body, {_is_heading('body')} AS h, sum(CASE WHEN {_is_heading('body')} THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS ord FROM lines
), bodies AS (
  SELECT book_id, CAST(ord AS BIGINT) AS ord, CAST(coalesce(sum(CASE WHEN NOT h THEN {_visible('body')} END), 0) AS BIGINT) AS length FROM marked WHERE ord > 0 GROUP BY ALL
)"""
)
_MERGED = """, runs AS (
  SELECT *, sum(CASE WHEN ord = 1 OR ord % 3 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS run FROM loose
)"""

#: Line items as segments of orders, broken in one way each, and what each order reports of them.
_SEGMENTS = """items AS (
  SELECT l_orderkey AS book_id, CAST(l_linenumber AS BIGINT) AS pos, CAST(max(l_quantity) AS BIGINT) AS size, min(l_returnflag) AS flag FROM lineitem GROUP BY ALL
), placed AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY book_id ORDER BY pos) AS BIGINT) AS e, e - size AS s, CASE flag WHEN 'R' THEN 'unknown' WHEN 'A' THEN 'chapter' ELSE 'noise' END AS kind, book_id % 11 AS m FROM items
), segments AS (
  SELECT book_id, pos, s, e, CASE WHEN m = 2 AND s = 0 THEN 'prose' ELSE kind END AS class, kind = 'chapter' AND m <> 3 AS known, kind = 'chapter' AS has_id, m = 7 AND kind = 'noise' AS has_reason
  FROM placed WHERE NOT (m = 1 AND s = 0)
), uncovered AS (
  SELECT book_id, pos, s + CASE WHEN m = 5 THEN 1 ELSE 0 END AS s, e FROM placed WHERE kind = 'unknown'
  UNION ALL SELECT book_id, 1000, 0, 1 FROM placed WHERE m = 6 AND s = 0
), reports AS (
  SELECT book_id, CAST(sum(size) + CASE WHEN book_id % 11 = 8 THEN 1 ELSE 0 END AS BIGINT) AS total, CAST(coalesce(sum(size) FILTER (kind <> 'unknown'), 0) AS BIGINT) AS classified,
    CAST(coalesce(sum(size) FILTER (kind = 'unknown'), 0) AS BIGINT) AS unclassified, (coalesce(sum(size) FILTER (kind = 'unknown'), 0) = 0) <> (book_id % 11 = 4) AS complete FROM placed GROUP BY book_id
)"""
#: Edits of every chapter with what is wrong with each, and which of a chapter's were applied.
_VERDICTS = (
    _LOOSE
    + """, near AS (
  SELECT *, lag(content_start) OVER w AS before_start, coalesce(lag(content_end) OVER w < heading_start, false) AS gap_before, lag(chapter_id) OVER w AS before_id,
    lead(heading_start) OVER w AS following, lead(heading_end) OVER w AS following_end, lead(ord) OVER w IS NULL AS is_last
  FROM loose WINDOW w AS (PARTITION BY book_id ORDER BY ord)
), edits AS (
  SELECT *, ord * 10 AS seq, ord AS of, 'start' AS side, heading_start - 5 AS place FROM near
  UNION ALL SELECT *, ord * 10 + 1, ord, 'end', content_end + 3 FROM near
  UNION ALL SELECT *, ord * 10 + 2, ord, 'start', heading_start + 2 FROM near
  UNION ALL SELECT *, ord * 10 + 3, ord, 'end', content_end - 4 FROM near
  UNION ALL SELECT *, ord * 10 + 4, ord, 'start', -1 FROM near WHERE ord % 7 = 0
  UNION ALL SELECT *, ord * 10 + 4, ord + 1000000, 'end', content_end FROM near WHERE ord % 7 = 1
), verdicts AS (
  SELECT *, CASE WHEN of > 1000000 THEN 'chapter' WHEN place < 0 OR place > total THEN 'bounds'
    WHEN side = 'start' THEN CASE WHEN place > heading_start OR place >= heading_end THEN 'heading' WHEN place < before_start THEN 'order' WHEN place < heading_start AND gap_before THEN 'unassigned' END
    ELSE CASE WHEN place > following OR place >= following_end THEN 'heading' WHEN place < content_start THEN 'order' WHEN place > content_end AND content_end < following THEN 'unassigned' END END AS fault
  FROM edits
), applied AS (
  SELECT book_id, ord, max(place) FILTER (seq % 10 = 0) AS opens, arg_max(place, seq) FILTER (side = 'end') AS closes FROM verdicts WHERE fault IS NULL GROUP BY ALL
), edited AS (
  SELECT n.*, coalesce(a.opens, heading_start) AS opens, a.opens IS NOT NULL AS opened, coalesce(a.closes, content_end) AS closes, a.closes IS NOT NULL AS closed
  FROM near n LEFT JOIN applied a ON a.book_id = n.book_id AND a.ord = n.ord
)"""
)

SQL: dict[str, str] = {
    "normalize_text": f"WITH {_RAW} SELECT book_id, part, strlen(text) AS n_bytes, length(text) AS n_code_points, CAST(len(regexp_extract_all(raw, '\\r\\n?|\\n')) AS BIGINT) AS n_line_ends, sha256(text) AS sha256 FROM parts",
    "line_offsets": f"WITH {_LINES} SELECT book_id, part, pos, start_byte, start_byte + strlen(body) AS body_end_byte, start_byte + strlen(body) + 1 AS end_byte FROM lines",
    "chapter_detect": f"WITH {_CHAPTERS} SELECT book_id, title, ord, heading_start, heading_end, content_start, content_end FROM chapters",
    "chapter_stable_ids": f"""WITH {_CHAPTERS} SELECT book_id, ord, 'chapter-' || substr(sha256('{{"namespace":"chapter","sourceHash":"' || sha256(book_id) || '","startByte":' || heading_start || ',"endByte":' || heading_end || ',"content":"' || title || '"}}'), 1, 32) AS chapter_id FROM chapters""",
    "processor_fingerprint": """SELECT doc_id, sha256('{"fingerprintSchemaVersion":1,"processorId":"chaptermill.txt-import","processorVersion":"2","sourceHash":"' || sha256(coalesce(text, '')) || '","sourceEncoding":"utf-8"}') AS fingerprint, sha256('r' || doc_id || ':' || sha256(coalesce(text, ''))) AS review_fingerprint FROM documents""",
    "display_titles": f"WITH {_CHAPTERS} SELECT book_id, ord, CASE WHEN ord % 3 = 0 THEN '未命名章节 ' || (ord // 3) ELSE title END AS display_title FROM chapters",
    "body_length": f"WITH {_BODIES} SELECT book_id, ord, length FROM bodies",
    "length_anomalies": f"""WITH {_BODIES}, f AS ({_fences('bodies', 'book_id')}), j AS (
      SELECT s.*, f.n, q1, q3, 1.5 * (q3 - q1) AS fence, greatest(3 * 1.4826 * spread, ln(1.75)) AS allowed, ln(greatest(length, 1)) - center AS away
      FROM ({_spread('bodies', 'book_id', 'ord')}) s LEFT JOIN f ON f.book_id = s.book_id
    ), k AS (
      SELECT book_id, ord, length, CASE WHEN length = 0 THEN 'empty'
        WHEN n >= 4 AND n_near >= 4 AND length < q1 - fence AND away < -allowed THEN 'short'
        WHEN n >= 4 AND n_near >= 4 AND length > q3 + fence AND away > allowed THEN 'long' END AS kind FROM j WHERE ord % 7 <> 0
    ) SELECT book_id, ord, length, kind, CASE kind WHEN 'empty' THEN '无正文' WHEN 'short' THEN '偏短 · ' || length || ' 字' ELSE '偏长 · ' || length || ' 字' END AS reason FROM k WHERE kind IS NOT NULL""",
    "length_quantile_fence": f"WITH {_TURNS}, f AS ({_fences('t', 'conv_id')}) SELECT conv_id, n, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q1 - 1.5 * (q3 - q1), 6) AS low, round(q3 + 1.5 * (q3 - q1), 6) AS high FROM f",
    "length_hampel": f"WITH {_TURNS}, s AS ({_spread('t', 'conv_id', 'turn')}) SELECT conv_id, turn, n_near, round(center, 6) AS center, round(spread, 6) AS spread FROM s",
    "text_slice_pages": """WITH c AS (
      SELECT doc_id, i, substr(text, i, 1) AS ch FROM documents, unnest(range(1, length(text) + 1)) AS u(i)
    ), o AS (
      SELECT doc_id, i, ch, CAST(sum(strlen(ch)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM c
    ), p AS (
      -- a character belongs to the page whose end, cut back to a boundary, isn't before its own
      SELECT doc_id, (e - 1) // 1000 AS page, ch, i, e FROM o
    ) SELECT doc_id, page, CAST(min(e - strlen(ch)) AS BIGINT) AS start_byte, max(e) AS end_byte, sha256(string_agg(ch, '' ORDER BY i)) AS sha256, true AS done FROM p GROUP BY doc_id, page""",
    "line_preview_pages": f"WITH {_LINES} SELECT book_id, (line - 1) // 200 AS page, min(start_byte) AS start_byte, max(start_byte + strlen(body) + 1) AS end_byte, count(*) AS n_lines FROM lines GROUP BY ALL",
    "windowed_scan": f"""WITH {_CHAPTERS} SELECT t.book_id, total AS n_bytes, (SELECT count(*) FROM lines l WHERE l.book_id = t.book_id) AS n_lines,
      (SELECT count(*) FROM chapters c WHERE c.book_id = t.book_id) AS n_chapters, true AS tiled FROM totals t""",
    "search_counts": """WITH n AS (
      SELECT doc_id, len(regexp_extract_all(t, '(?i)the')) AS plain, len(regexp_extract_all(t, 'The')) AS cased,
        CAST(len(list_filter(regexp_extract_all(t, '[\\p{L}\\p{N}_]+'), lambda w: lower(w) = 'on')) AS BIGINT) AS word, len(regexp_extract_all(t, '(?i)[aeiou]n[dt]')) AS re
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    ) SELECT doc_id, least(plain, 99) AS n_plain, least(cased, 99) AS n_case, least(word, 99) AS n_word, least(re, 99) AS n_regexp,
      plain > 99 AS more_plain, cased > 99 AS more_case, word > 99 AS more_word, re > 99 AS more_regexp,
      least(plain, 1) || ' / ' || least(plain, 99) || CASE WHEN plain > 99 THEN '+' ELSE '' END AS shown FROM n""",
    "search_places": f"""WITH {_RAW}, {_places('(?i)the', _BASED)}, word AS (
      SELECT * FROM hits WHERE NOT regexp_matches(piece, '[\\p{{L}}\\p{{N}}_]$') AND NOT regexp_matches(follows, '^[\\p{{L}}\\p{{N}}_]')
        AND NOT (piece = '' AND e - n > 0) AND follows <> ''
    ), placed AS (SELECT {_PLACED} FROM word {_ORDERED})
    SELECT *, coalesce(lead(start_byte) OVER o, min(start_byte) OVER b) AS next_start, coalesce(lag(start_byte) OVER o, max(start_byte) OVER b) AS previous_start,
      format('{{:,}}', number) || ' / ' || format('{{:,}}', least(total, 99)) || CASE WHEN total > 99 THEN '+' ELSE '' END AS shown
    FROM placed WINDOW o AS (PARTITION BY book_id ORDER BY number), b AS (PARTITION BY book_id)""",
    "search_over_parts": f"""WITH {_RAW}, {_places('(?i)\nchapter ', "SELECT book_id, 0 AS part, 0 AS base, 0 AS base16, string_agg(text, '' ORDER BY part) AS text FROM parts GROUP BY book_id")}
      SELECT {_PLACED} FROM hits {_ORDERED}""",
    "search_from_places": f"""WITH {_CHAPTERS}, {_places('(?i)[aeiou]nd[ ,.]', _BASED).replace('pieces AS', 'shares AS').replace('FROM pieces', 'FROM shares')}
      SELECT c.book_id, c.ord, c.heading_start AS at, coalesce(min(e - n) FILTER (e - n >= c.heading_start), min(e - n)) AS next_start,
        coalesce(max(e - n) FILTER (e <= c.heading_start), max(e - n)) AS previous_start
      FROM chapters c LEFT JOIN hits h ON h.book_id = c.book_id GROUP BY c.book_id, c.ord, c.heading_start""",
    "heading_rules": f"WITH l AS (SELECT doc_id, {_choose(_FORMS)} AS line FROM documents WHERE doc_id IS NOT NULL) SELECT doc_id, line, {_is_heading('line')} AS heading, CASE WHEN {_is_heading('line')} THEN regexp_replace({_trim('line')}, '[\\t \\x{{3000}}]+', ' ', 'g') END AS title FROM l",
    "coverage_implicit": f"WITH {_LOOSE} SELECT book_id, 'chapter' AS classification, s AS start_byte, e AS end_byte, chapter_id, reason FROM implicit WHERE s < e",
    "coverage_explicit": f"WITH {_EXPLICIT} SELECT book_id, classification, start_byte, end_byte, chapter_id, reason FROM explicit",
    "coverage_draft": f"""WITH {_LOOSE}, owned AS (
      SELECT book_id, chapter_id, coalesce(lag(content_end) OVER w, 0) AS s, CASE WHEN lead(ord) OVER w IS NULL THEN total ELSE content_end END AS e FROM loose WINDOW w AS (PARTITION BY book_id ORDER BY ord)
    ) SELECT book_id, classification, start_byte, end_byte, chapter_id FROM ({_cut('owned', "'chapter' AS classification, chapter_id")}) UNION ALL SELECT book_id, 'unknown', s, e, NULL FROM merged""",
    "coverage_totals": f"""WITH {_EXPLICIT} SELECT t.book_id, total, CAST(coalesce(sum(end_byte - start_byte) FILTER (classification = 'chapter'), 0) AS BIGINT) AS classified,
      CAST(coalesce(sum(end_byte - start_byte) FILTER (classification = 'unknown'), 0) AS BIGINT) AS unclassified,
      coalesce(sum(end_byte - start_byte) FILTER (classification = 'chapter'), 0) = total AND coalesce(sum(end_byte - start_byte) FILTER (classification = 'unknown'), 0) = 0 AS complete
      FROM totals t JOIN explicit e ON e.book_id = t.book_id GROUP BY t.book_id, total""",
    "coverage_faults": f"""WITH {_LOOSE} SELECT book_id, heading_start AS at, 'not-contiguous' AS fault FROM (SELECT *, coalesce(lag(content_end) OVER (PARTITION BY book_id ORDER BY ord), 0) AS reach FROM loose) WHERE reach <> heading_start
      UNION ALL SELECT book_id, max(content_end), 'wrong-end' FROM loose GROUP BY book_id, total HAVING max(content_end) <> total""",
    "range_islands": f"WITH {_RANGES} SELECT user_id, s AS start_byte, e AS end_byte FROM ({_islands('r')})",
    "range_subtract": f"""WITH {_RANGES}, m AS ({_islands("(SELECT * FROM r WHERE event_type = 'error')")}), g AS (
      SELECT user_id, coalesce(lag(e) OVER w, 0) AS s, s AS e FROM m WINDOW w AS (PARTITION BY user_id ORDER BY s)
      UNION ALL SELECT u.user_id, coalesce(max(m.e), 0), 9000000000000 FROM (SELECT DISTINCT user_id FROM r) u LEFT JOIN m ON m.user_id = u.user_id GROUP BY u.user_id
    ) SELECT r.user_id, event_id, greatest(r.s, g.s) AS start_byte, least(r.e, g.e) AS end_byte FROM r JOIN g ON g.user_id = r.user_id AND r.s < g.e AND g.s < r.e WHERE event_type = 'click' AND greatest(r.s, g.s) < least(r.e, g.e)""",
    "range_overlap_join": f"WITH {_RANGES} SELECT a.user_id, a.event_id AS left_id, b.event_id AS right_id FROM r a JOIN r b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e WHERE a.event_type = 'purchase' AND b.event_type = 'signup' AND a.s < a.e AND b.s < b.e",
    "range_asof_owner": f"""WITH {_RANGES}, j AS (
      SELECT p.user_id, p.event_id, c.event_id AS owner, coalesce(p.s < c.e, false) AS inside, row_number() OVER (PARTITION BY p.event_id ORDER BY c.s DESC NULLS LAST, c.e DESC, c.event_id DESC) AS n
      FROM (SELECT * FROM r WHERE event_type = 'view') p LEFT JOIN (SELECT * FROM r WHERE event_type = 'click') c ON c.user_id = p.user_id AND c.s <= p.s
    ) SELECT user_id, event_id, owner, inside FROM j WHERE n = 1""",
    "merge_chapters": f"""WITH {_LOOSE}{_MERGED} SELECT book_id, arg_min(chapter_id, ord) AS chapter_id, CAST(run AS BIGINT) AS ord, arg_min(content_start, ord) AS content_start, max(content_end) AS content_end FROM runs GROUP BY book_id, run""",
    "delete_recognition": f"""WITH {_LOOSE}, freed AS (
      SELECT * FROM (SELECT book_id, ord, coalesce(lag(content_end) OVER w, 0) AS s, CASE WHEN lead(ord) OVER w IS NULL THEN total ELSE content_end END AS e FROM loose WINDOW w AS (PARTITION BY book_id ORDER BY ord)) WHERE ord % 4 IN (1, 2)
    ), u AS (SELECT book_id AS user_id, s, e FROM freed UNION ALL SELECT book_id, s, e FROM holes) SELECT user_id AS book_id, s AS start_byte, e AS end_byte FROM ({_islands('u')})""",
    "accept_anomaly": f"WITH {_CHAPTERS} SELECT book_id, ord, ord % 2 = 0 AS accepted FROM chapters",
    "adjust_boundaries": f"WITH {_LOOSE} SELECT book_id, ord, heading_start, CASE WHEN ord % 6 = 0 THEN content_end - 1 ELSE content_end END AS content_end, 'pending' AS review_status FROM loose",
    "range_faults": f"WITH {_LOOSE} SELECT DISTINCT l.book_id, ord, 'unassigned' AS fault FROM loose l JOIN holes h ON h.book_id = l.book_id AND ((s < content_end AND content_start < e) OR (s < heading_end AND heading_start < e))",
    "insert_linebreaks": r"""WITH d AS (
      SELECT doc_id, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL
    ), p AS (
      SELECT doc_id, t, strlen(t) AS n, [strlen(t[1:30]), strlen(t[1:10]), strlen(t[1:20])] AS q, [least(30, length(t)), least(10, length(t)), least(20, length(t))] AS k,
        list_filter(range(2, 6), lambda i: strlen(t[1:i]) = 5 AND i <= length(t))[1] AS five, doc_id % 4 = 0 AS more FROM d
    ), f AS (
      SELECT doc_id, t, n, CASE WHEN more THEN list_append(q, 5) ELSE q END AS points, CASE WHEN more AND five IS NOT NULL AND n >= 5 THEN list_append(k, five) ELSE k END AS places, more, five FROM p
    ), g AS (
      SELECT *, more AND n < 5 AS f1, len(list_distinct(points)) < len(points) AS f2, more AND n >= 5 AND five IS NULL AS f3,
        len(list_filter(places, lambda i: (i > 0 AND t[i:i] IN (chr(10), chr(13))) OR t[i + 1:i + 1] IN (chr(10), chr(13)))) > 0 AS f4 FROM f
    ), h AS (
      SELECT *, concat_ws(',', CASE WHEN f1 THEN 'bounds' END, CASE WHEN f2 THEN 'repeated' END, CASE WHEN f3 THEN 'inside' END, CASE WHEN f4 THEN 'newline' END) AS faults, list_sort(places) AS z FROM g
    ) SELECT doc_id, faults, CASE WHEN faults = '' THEN sha256(t[1:z[1]] || chr(10) || t[z[1] + 1:z[2]] || chr(10) || t[z[2] + 1:z[3]] || chr(10) || CASE WHEN more THEN t[z[3] + 1:z[4]] || chr(10) || t[z[4] + 1:] ELSE t[z[3] + 1:] END) END AS sha256,
      n + len(list_filter(points, lambda x: x < n)) AS after, n + 1 - len(list_filter(list_sort(points), lambda x, i: x + i - 1 < n + 1)) AS before FROM h""",
    "structure_faults": f"""WITH {_LOOSE}, p AS (
      SELECT book_id, ord, CASE WHEN ord % 5 = 0 THEN NULL WHEN ord % 7 = 0 THEN book_id || '-1' WHEN ord % 11 = 0 THEN 'nobody' ELSE chapter_id END AS id, ord % 2 = 0 AND ord % 3 <> 0 AS ok FROM loose
    ), j AS (
      SELECT p.*, l.ord AS held, min(p.ord) OVER (PARTITION BY p.book_id, id) AS first FROM p LEFT JOIN loose l ON l.book_id = p.book_id AND l.chapter_id = id WHERE id IS NOT NULL
    ) SELECT book_id, ord, 'unknown' AS fault FROM j WHERE held IS NULL UNION ALL SELECT book_id, ord, 'repeated' FROM j WHERE held IS NOT NULL AND ord > first
      UNION ALL SELECT book_id, ord, 'acceptance' FROM j WHERE held % 2 = 0 AND NOT ok""",
    "adjustment_faults": f"WITH {_LOOSE} SELECT book_id, chapter_id, 'repeated' AS fault FROM loose WHERE ord % 6 = 0 UNION ALL SELECT book_id, book_id || '-' || (max(ord) + 1), 'unknown' FROM loose GROUP BY book_id",
    "structure_update": f"""WITH {_LOOSE} SELECT book_id, ord, CASE WHEN ord % 5 = 0 THEN 'chapter-' || left(sha256(book_id || ':' || ord), 32) WHEN ord % 7 = 0 THEN book_id || '-1' WHEN ord % 11 = 0 THEN 'nobody' ELSE chapter_id END AS chapter_id,
      CASE WHEN ord % 5 = 0 THEN '未命名章节' ELSE title END AS title, 'pending' AS review_status FROM loose""",
    "confirm_review": f"""WITH {_LOOSE} SELECT book_id, CASE WHEN book_id = 'src2' OR count(*) = 1 THEN 'refused' ELSE 'approved' END AS review_status,
      CASE WHEN book_id = 'src2' THEN 0 ELSE count(*) - 1 END AS n_chapters FROM loose GROUP BY book_id""",
    "leading_range": f"""WITH {_LOOSE}, m AS (
      SELECT book_id, max(heading_start) FILTER (ord = 2) AS old, count(*) AS n FROM loose GROUP BY book_id HAVING old IS NOT NULL
    ), u AS (
      SELECT book_id AS user_id, s, e FROM holes UNION ALL SELECT book_id, 0, CASE WHEN n % 2 = 0 THEN old + 3 ELSE greatest(old - 20, 0) END FROM m
    ) SELECT user_id AS book_id, s AS start_byte, e AS end_byte FROM ({_islands('u')})""",
    "fold_ranges": f"""WITH {_CHAPTERS}, i AS (
      SELECT c.book_id, ord, min(line) AS a, max(line) AS z FROM chapters c JOIN lines l ON l.book_id = c.book_id AND l.start_byte >= content_start AND l.start_byte < content_end GROUP BY ALL
    ) SELECT book_id, ord, a + 5 AS start_line, z - 5 AS end_line, z - a + 1 - 10 AS line_count FROM i WHERE z - a + 1 > 10""",
    "boundary_shift": f"""WITH {_CHAPTERS}, e AS (SELECT *, lead(heading_start) OVER (PARTITION BY book_id ORDER BY ord) AS guard FROM chapters)
      SELECT e.book_id, ord, p.start_byte AS new_end FROM e JOIN lines l ON l.book_id = e.book_id AND l.start_byte = e.content_end JOIN lines p ON p.book_id = l.book_id AND p.line = l.line - 1
      WHERE guard IS NOT NULL AND p.start_byte >= content_start AND p.start_byte <= guard""",
    "add_recognition": f"""WITH {_LOOSE}, x AS (
      SELECT *, ord = 3 AND content_end - content_start > 40 AS hit FROM loose
    ), u AS (
      SELECT book_id, ord, content_start, CASE WHEN hit THEN content_start + 20 ELSE content_end END AS content_end, 'source' AS heading_kind FROM x
      UNION ALL SELECT book_id, ord + 0.5, content_start + 20, content_end, 'missing' FROM x WHERE hit
    ) SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY ord) AS ord, content_start, content_end, heading_kind FROM u""",
    "gap_receipts": f"""WITH {_LOOSE} SELECT book_id, ord, coalesce(lag(content_end) OVER w, 0) < heading_start OR (lead(ord) OVER w IS NULL AND content_end < total) AS receives FROM loose WINDOW w AS (PARTITION BY book_id ORDER BY ord)""",
    "chapter_layouts": f"""WITH {_CHAPTERS}, z AS (SELECT book_id, line - 1 AS line, start_byte AS s, start_byte + strlen(body) + 1 AS e, max(start_byte) OVER (PARTITION BY book_id) AS last FROM lines)
      SELECT c.book_id, ord, a.line AS anchor_line, h.line AS heading_last_line, t.line AS content_line FROM chapters c
      JOIN z a ON a.book_id = c.book_id AND heading_start >= a.s AND heading_start < a.e JOIN z h ON h.book_id = c.book_id AND heading_end - 1 >= h.s AND heading_end - 1 < h.e
      JOIN z t ON t.book_id = c.book_id AND content_start >= t.s AND (content_start < t.e OR t.s = t.last)""",
    "range_mapping": f"WITH {_CHAPTERS} SELECT book_id, ord, heading_end, content_start + CASE WHEN content_start = content_end THEN 1 ELSE 0 END AS content_start, content_end + 1 AS content_end FROM chapters",
    "source_preview": """WITH c AS (
      SELECT doc_id, string_split(text, chr(10)) AS l, text FROM documents
    ), w AS (
      SELECT doc_id, text, CASE WHEN len(l) > 3 THEN l[1] || chr(10) || l[2] || chr(10) || l[3] || chr(10) ELSE text END AS three FROM c
    ) SELECT doc_id, CASE WHEN length(three) <= 250 THEN three ELSE substr(text, 1, 250) END AS text, CAST(2 * least(length(three), 250) AS BIGINT) AS end_byte, least(length(three), 250) = length(text) AS done FROM w""",
    "boundary_edits": f"""WITH {_LOOSE}, m AS (
      SELECT *, CASE WHEN ord % 3 = 0 THEN content_end + 3 ELSE content_end END AS want, lead(heading_start) OVER w AS following FROM loose WINDOW w AS (PARTITION BY book_id ORDER BY ord)
    ), n AS (SELECT *, greatest(heading_start, coalesce(CASE WHEN lag(ord) OVER w % 3 = 0 THEN lag(want) OVER w END, 0)) AS start FROM m WINDOW w AS (PARTITION BY book_id ORDER BY ord))
    SELECT book_id, ord, start AS heading_start, CASE WHEN ord % 3 = 0 THEN greatest(want, heading_end, start) ELSE greatest(least(want, coalesce(following, want)), heading_end, start) END AS content_end FROM n""",
    "canonical_json": r"""SELECT o_orderkey, c AS canonical, sha256(c) AS hash FROM (
      SELECT o_orderkey, '{"10":true,"9":false,"items":{"A":null,"z":[1.5,{"date":"' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '","price":'
        || regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR), '\.?0+$', '') || '},0,1000]},"key":' || o_orderkey || ',"status":"' || o_orderstatus || '"}' AS c FROM orders)""",
    "stored_previews": """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 1 THEN 'broken' WHEN 2 THEN 'requiresConfirmation' WHEN 5 THEN 'no-object' END AS fault,
      CASE WHEN o_orderkey % 7 = 4 THEN 'extra' ELSE '' END AS unknown, o_orderkey % 7 IN (0, 6) AS same FROM orders""",
    "stored_snapshots": """WITH c AS (
      SELECT l_orderkey, l_partkey % 50 = 0 OR l_suppkey % 40 = 0 OR (l_linenumber - 1) * 10 + CASE WHEN l_orderkey % 23 = 0 THEN 90 ELSE 10 END > 75 AS bad,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i
        FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL)
    ) SELECT l_orderkey AS o_orderkey, CASE WHEN l_orderkey % 11 = 0 THEN 'reviewStatus' WHEN bool_or(bad) THEN 'chapter-' || min(i) FILTER (bad) END AS fault FROM c GROUP BY l_orderkey""",
    "coverage_validation": f"""WITH {_SEGMENTS}, r AS (
      SELECT *, coalesce(lag(e) OVER w, 0) AS reach, CASE WHEN class = 'unknown' THEN sum(CAST(class = 'unknown' AS INTEGER)) OVER w END AS k FROM segments WINDOW w AS (PARTITION BY book_id ORDER BY pos)
    ), u AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY pos) AS k FROM uncovered),
    t AS (
      SELECT p.*, coalesce(last, 0) AS last, coalesce(c, 0) AS c, coalesce(n, 0) AS n FROM reports p LEFT JOIN (
        SELECT book_id, arg_max(e, pos) AS last, sum(e - s) FILTER (class <> 'unknown') AS c, sum(e - s) FILTER (class = 'unknown') AS n FROM segments GROUP BY book_id) q ON q.book_id = p.book_id
    )
    SELECT r.book_id, pos AS at, 'range' AS fault FROM r JOIN reports p ON p.book_id = r.book_id WHERE s >= e OR e > total
    UNION ALL SELECT book_id, pos, 'contiguity' FROM r WHERE s <> reach
    UNION ALL SELECT book_id, pos, 'classification' FROM r WHERE class = 'prose'
    UNION ALL SELECT book_id, pos, 'chapter' FROM r WHERE CASE WHEN class = 'chapter' THEN NOT known ELSE has_id OR has_reason END
    UNION ALL SELECT coalesce(x.book_id, u.book_id), CAST(coalesce(x.k, u.k) AS BIGINT), 'uncovered' FROM (SELECT * FROM r WHERE class = 'unknown') x FULL JOIN u ON u.book_id = x.book_id AND u.k = x.k
      WHERE x.s IS DISTINCT FROM u.s OR x.e IS DISTINCT FROM u.e
    UNION ALL SELECT book_id, NULL, 'end' FROM t WHERE last <> total
    UNION ALL SELECT book_id, NULL, 'classified' FROM t WHERE c <> classified
    UNION ALL SELECT book_id, NULL, 'unclassified' FROM t WHERE n <> unclassified
    UNION ALL SELECT book_id, NULL, 'complete' FROM t WHERE complete <> (n = 0 AND c = total)""",
    "unassigned_validation": f"""WITH {_SEGMENTS}, headed AS (SELECT DISTINCT book_id FROM segments WHERE class = 'chapter'),
    r AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY book_id ORDER BY pos), 0) AS reach, book_id NOT IN (SELECT book_id FROM headed) AS bare FROM uncovered)
    SELECT book_id, pos AS at, 'order' AS fault FROM r WHERE s < reach
    UNION ALL SELECT r.book_id, pos, 'range' FROM r JOIN reports p ON p.book_id = r.book_id WHERE s >= e OR e > total
    UNION ALL SELECT book_id, pos, 'coverage' FROM r WHERE bare AND s > reach
    UNION ALL SELECT p.book_id, NULL, 'coverage' FROM reports p LEFT JOIN (SELECT book_id, arg_max(e, pos) AS last FROM uncovered GROUP BY book_id) q ON q.book_id = p.book_id
      WHERE p.book_id NOT IN (SELECT book_id FROM headed) AND coalesce(last, 0) <> total""",
    "record_validation": """SELECT CASE WHEN k = -2 THEN -c_custkey ELSE c_custkey END AS id, fault FROM (
      SELECT c_custkey, c_custkey % 7 AS k, 'missing' AS fault FROM customer WHERE c_custkey % 7 IN (1, 2)
      UNION ALL SELECT c_custkey, -2, 'orphan' FROM customer WHERE c_custkey % 7 = 2
      UNION ALL SELECT c_custkey, 3, 'name' FROM customer WHERE c_custkey % 7 = 3 AND c_name <> upper(c_name)
      UNION ALL SELECT c_custkey, 4, 'nation' FROM customer WHERE c_custkey % 7 = 4
      UNION ALL SELECT c_custkey, 5, 'balance' FROM customer WHERE c_custkey % 7 = 5 AND c_custkey % 6 <> 0)""",
    "event_numbers": """WITH e AS (
      SELECT event_id // 30 % 10 AS project_id, lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id, ts, epoch_us(ts) // 1000 AS ms,
        CASE event_type WHEN 'click' THEN 'token-opened' WHEN 'view' THEN 'token-consumed' ELSE event_type END AS event_type,
        event_id // 50 - CASE WHEN event_id % 13 = 0 THEN 2 ELSE 0 END AS generation, 't' || event_id // 3 AS token FROM events
    ), kept AS (
      SELECT * FROM e QUALIFY generation >= coalesce(max(generation) OVER (PARTITION BY project_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), generation)
    ), t AS (
      SELECT *, lead(ms) OVER (PARTITION BY project_id, token ORDER BY ts, event_id) AS following FROM kept WHERE event_type IN ('token-opened', 'token-consumed')
    ), every AS (
      SELECT project_id, event_id, ms, epoch_us(ts) AS us, event_type, generation FROM kept
      UNION ALL SELECT project_id, 'expired-' || token || '-' || ms, ms + 300000, (ms + 300000) * 1000, 'token-expired', NULL FROM t
        WHERE event_type = 'token-opened' AND (following IS NULL OR following >= ms + 300000)
    ) SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY us, event_id) AS sequence, event_id, ms AS at_ms, event_type, generation FROM every""",
    "edit_verdicts": f"WITH {_VERDICTS} SELECT book_id, seq, of AS ord, side, place AS at, fault FROM verdicts",
    "protected_edits": f"""WITH {_VERDICTS} SELECT book_id, ord, opens AS heading_start,
      greatest(CASE WHEN lead(opened) OVER w THEN least(closes, lead(opens) OVER w) ELSE closes END, opens, heading_end) AS content_end FROM edited WINDOW w AS (PARTITION BY book_id ORDER BY ord)""",
    "kept_priorities": f"""WITH {_VERDICTS} SELECT * FROM (
      SELECT book_id, before_id AS previous_id, chapter_id AS next_id, CASE WHEN opened THEN 'next-chapter-start' WHEN lag(closed) OVER w THEN 'previous-content-end' END AS side
      FROM edited WINDOW w AS (PARTITION BY book_id ORDER BY ord) QUALIFY ord > 1 AND (ord - 1 = 1 OR (ord - 1) % 5 <> 2) AND ord % 5 <> 2
    ) WHERE side IS NOT NULL""",
    "merge_verdicts": f"""WITH {_VERDICTS} SELECT book_id, ord, 'previous' AS direction, CASE WHEN ord = 1 THEN 'edge' WHEN gap_before THEN 'unassigned' END AS fault FROM near
      UNION ALL SELECT book_id, ord, 'next', CASE WHEN is_last THEN 'edge' END FROM near""",
    "merge_next": f"""WITH {_VERDICTS} SELECT book_id, chapter_id, row_number() OVER (PARTITION BY book_id ORDER BY ord) AS ord, content_end FROM (SELECT ord, book_id, chapter_id, content_end FROM near WHERE ord % 3 <> 1 OR is_last)""",
    "draft_changes": f"""WITH {_VERDICTS} SELECT book_id, chapter_id, CASE WHEN ord % 3 = 1 AND NOT is_last THEN 'removed' ELSE 'moved' END AS change,
      CASE WHEN ord % 3 = 1 AND NOT is_last THEN NULL ELSE heading_start END AS heading_start, CASE WHEN ord % 3 = 1 AND NOT is_last THEN NULL ELSE content_end - 1 END AS content_end
      FROM near WHERE ord % 6 = 0 OR (ord % 3 = 1 AND NOT is_last)""",
    "affected_artifacts": f"WITH {_DEPENDENCIES} SELECT artifact_type, artifact_id, revision_id AS consumer_revision_id, l_orderkey AS producer_revision_id, 'text' AS dependency_type FROM revisions JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 10 = 3 AND validity_status = 'current'",
    "stale_propagation": f"WITH {_DEPENDENCIES} SELECT revision_id, artifact_id, CASE WHEN o_orderkey IS NOT NULL AND validity_status = 'current' THEN 'stale' ELSE validity_status END AS validity_status FROM revisions LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 3) ON o_orderkey = l_orderkey",
    "stale_causes": f"WITH {_DEPENDENCIES} SELECT revision_id AS consumer_revision_id, l_orderkey AS previous_producer_revision_id, -l_orderkey AS current_producer_revision_id, 'text' AS dependency_type, 'active' AS status FROM revisions JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 10 = 3 AND validity_status = 'current'",
    "next_baseline": f"WITH {_BASELINES} SELECT c_custkey AS o_custkey, coalesce(max(baseline_revision), 0) + 1 AS next_baseline FROM customer LEFT JOIN b ON b.o_custkey = c_custkey GROUP BY c_custkey",
    "active_revision": f"WITH {_BASELINES} SELECT * FROM b QUALIFY baseline_revision = max(baseline_revision) OVER (PARTITION BY o_custkey)",
    "without_one_active": "SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS n_active FROM orders GROUP BY 1 HAVING n_active <> 1",
    "revision_history": "SELECT o_custkey, count(*) + 1 AS n, CAST(1 AS BIGINT) AS n_active, count(*) + 1 AS last FROM orders GROUP BY 1",
    "review_outcomes": f"WITH {_COMMANDS} SELECT key, outcome, CASE WHEN outcome = 'applied' THEN CASE WHEN opened THEN key ELSE -key END END AS preview_id, n > 0 AS requires_confirmation, n AS n_affected, CASE WHEN outcome = 'applied' THEN asked + 1 END AS next_baseline FROM outcomes",
    "review_commit": f"WITH {_COMMANDS} SELECT r.revision_id AS consumer_revision_id, l_orderkey AS previous_producer_revision_id, 'active' AS status FROM outcomes o JOIN revisions r ON r.l_orderkey = o.o_orderkey WHERE outcome = 'applied' AND validity_status = 'current'",
    "stage_pages": f"""WITH {_FLAGS} SELECT project_id, lpad(CAST(n AS VARCHAR), 2, '0') AS stage_id, ['text-extraction', 'proofreading', 'script-management', 'character-extraction', 'crowd-voice-pool', NULL, 'chapter-parameters', 'asr-review', 'loudness-consistency', 'timeline-alignment', 'chapter-summary'][n] AS page FROM flags, range(1, 12) AS r(n)""",
    "status_groups": "SELECT ['application', 'project'][s_suppkey % 3 + 1] AS region, s_nationkey AS \"order\", s_name AS key, row_number() OVER (PARTITION BY s_suppkey % 3 ORDER BY CASE s_suppkey % 3 WHEN 0 THEN s_nationkey ELSE -s_nationkey END, s_name) AS place FROM supplier WHERE s_suppkey % 3 < 2",
    "late_responses": "SELECT user_id, event_id, day(ts) AS generation FROM events QUALIFY day(ts) = max(day(ts)) OVER (PARTITION BY user_id)",
    "stored_inputs": "SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'automatic' WHEN 2 THEN 'automatic' WHEN 3 THEN 'gbk' END AS encoding, CASE event_id % 6 WHEN 0 THEN 'input-broken' WHEN 5 THEN 'input-broken' WHEN 4 THEN 'encoding-broken' END AS error FROM events",
    "probe_overview": f"""WITH {_TASKS}, {_BASELINES}, t AS (
      SELECT task_id % 300 AS project_id, task_id, state FROM latest WHERE state <> 'succeeded' QUALIFY row_number() OVER (PARTITION BY task_id % 300 ORDER BY occurred_at DESC, task_id) = 1
    ), a AS (SELECT o_custkey, o_orderkey FROM b QUALIFY baseline_revision = max(baseline_revision) OVER (PARTITION BY o_custkey))
    SELECT c_custkey AS project_id, task_id, state, o_orderkey AS revision_id FROM customer LEFT JOIN t ON t.project_id = c_custkey LEFT JOIN a ON a.o_custkey = c_custkey""",
    "cyclic_neighbours": "SELECT s_nationkey, s_suppkey, coalesce(lead(s_suppkey) OVER w, min(s_suppkey) OVER (PARTITION BY s_nationkey)) AS next_value, coalesce(lag(s_suppkey) OVER w, max(s_suppkey) OVER (PARTITION BY s_nationkey)) AS previous_value FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)",
    "task_latest_state": f"WITH {_TASKS} SELECT task_id, state, attempt, sequence, occurred_at FROM latest",
    "task_summary": f"WITH {_TASKS} SELECT task_id, state, least(300, greatest(0, completed)) AS completed, CAST(300 AS BIGINT) AS total, CAST(floor(least(300, greatest(0, completed)) / 300 * 100 + 0.5) AS BIGINT) AS percent, state IN ('pending', 'running') AS can_cancel, state IN ('failed', 'canceled') AS can_retry FROM latest",
    "task_recovery": f"WITH {_TASKS} SELECT task_id, CASE WHEN state IN ('pending', 'running') THEN 'failed' ELSE state END AS state, CASE WHEN state IN ('pending', 'running') THEN 'retryable' ELSE 'none' END AS recovery FROM latest",
    "task_retry": f"WITH {_TASKS}, r AS (SELECT task_id, CASE WHEN task_id % 2 = 0 AND state = 'failed' THEN 'pending' ELSE state END AS state, attempt + CASE WHEN task_id % 2 = 0 AND state = 'failed' THEN 1 ELSE 0 END AS attempt FROM latest) SELECT task_id, CASE WHEN task_id % 3 = 0 AND state IN ('pending', 'running') THEN 'canceled' ELSE state END AS state, attempt FROM r",
    "task_idempotent_start": f"WITH {_TASKS} SELECT c_custkey, c_custkey % 10 AS project_id, CAST(c_custkey % 130 AS VARCHAR) AS input_fingerprint FROM customer WHERE NOT EXISTS (SELECT 1 FROM latest WHERE state IN ('pending', 'running', 'succeeded') AND task_id % 10 = c_custkey % 10 AND task_id % 50 = c_custkey % 130)",
    "preview_expiry": f"WITH {_TASKS} SELECT sequence AS preview_id, CAST(task_id AS VARCHAR) AS command_hash, occurred_at + 300 AS expires_at FROM ev WHERE state <> 'succeeded' AND occurred_at + 300 > (SELECT max(occurred_at) - 86400 FROM ev) QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY occurred_at DESC, sequence) = 1",
    "stage_states": f"WITH {_FLAGS} SELECT project_id, lpad(CAST(n AS VARCHAR), 2, '0') AS stage_id, CASE WHEN n = 1 THEN CASE WHEN has_task THEN 'running' WHEN completed THEN 'completed' WHEN reviewable THEN 'review-required' ELSE 'ready' END WHEN n = 2 AND completed THEN 'ready' ELSE 'blocked' END AS status FROM flags, range(1, 12) AS u(n)",
    "capability_matrix": f"""WITH {_FLAGS}, p(page, stage) AS (VALUES {_PAGES}), x AS (
      SELECT project_id, page, stage, page IN ('text-extraction', 'project-settings') AS always, page = 'chapter-splitting' AND (reviewable OR completed) AS opened, page = 'chapter-splitting' AS split, NOT completed AND page <> 'software-settings' AS early FROM flags, p
    ) SELECT project_id, page, always OR opened AS available, CASE WHEN always OR opened THEN 'available' WHEN split OR early THEN 'prerequisite' ELSE 'not-implemented' END AS reason,
      CASE WHEN NOT always THEN stage END AS required_stage, CASE WHEN always OR opened THEN NULL WHEN split THEN 'text-extraction' WHEN early THEN 'chapter-splitting' END AS prerequisite FROM x""",
    "entry_pages": f"WITH {_FLAGS} SELECT project_id, CASE WHEN has_task THEN 'text-extraction' WHEN project_id % 7 = 0 THEN 'timeline-alignment' WHEN reviewable THEN 'chapter-splitting' WHEN completed THEN 'proofreading' ELSE 'text-extraction' END AS page FROM flags",
    "catalog_recent": f"WITH {_PROJECTS} SELECT * FROM projects ORDER BY last_opened_at DESC, project_id",
    "catalog_upsert": f"WITH {_PROJECTS} SELECT CASE WHEN project_id % 10 = 5 THEN -project_id - 1 ELSE project_id END AS project_id, display_name, directory_path, last_opened_at + CASE WHEN project_id % 10 = 0 THEN 1000000 ELSE 0 END AS last_opened_at FROM projects",
    "catalog_availability": f"WITH {_PROJECTS} SELECT project_id, CASE WHEN project_id % 4 = 0 THEN 'missing' WHEN project_id % 4 = 1 OR project_id % 8 = 3 THEN 'invalid' ELSE 'available' END AS availability FROM projects",
    "status_counts": "SELECT k.p_type, count(part.p_partkey) AS n FROM (VALUES ('ECONOMY'), ('SMALL'), ('LARGE'), ('PROMO'), ('STANDARD'), ('MEDIUM'), ('NONE')) AS k(p_type) LEFT JOIN part ON part.p_type = k.p_type GROUP BY 1",
    "facet_filter": "SELECT p_partkey, p_name, length(p_name) AS n_chars FROM part WHERE contains(lower(p_name || ' ' || p_brand), 'bolt') AND p_type IN ('SMALL', 'ECONOMY') AND list_contains(string_split(p_name, ' '), 'blue') AND p_partkey <> 2",
    "closed_range_filter": "SELECT s_suppkey FROM supplier WHERE least(s_acctbal, 3000.0) <= 4000 AND greatest(s_acctbal, 3500.0) >= 2000 AND s_acctbal > 0",
    "encoding_probe": """SELECT doc_id, CASE doc_id % 8 WHEN 4 THEN 'rejected' WHEN 5 THEN 'rejected' WHEN 6 THEN 'selection-required' WHEN 7 THEN 'rejected' ELSE 'confirmed' END AS status,
      CASE doc_id % 8 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-8' WHEN 2 THEN 'utf-16le' WHEN 3 THEN 'utf-16be' END AS encoding, CASE doc_id % 8 WHEN 0 THEN 'strict-utf8' WHEN 1 THEN 'bom' WHEN 2 THEN 'bom' WHEN 3 THEN 'bom' END AS method,
      CASE doc_id % 8 WHEN 4 THEN 'empty' WHEN 5 THEN 'utf-32' WHEN 7 THEN 'binary-nul' END AS reason FROM documents WHERE doc_id IS NOT NULL AND text <> ''
      UNION ALL SELECT doc_id, CASE WHEN doc_id % 8 = 6 THEN 'selection-required' ELSE 'rejected' END, NULL, NULL, CASE doc_id % 8 WHEN 5 THEN 'utf-32' WHEN 6 THEN NULL WHEN 7 THEN 'binary-nul' ELSE 'empty' END FROM documents WHERE doc_id IS NOT NULL AND coalesce(text, '') = ''""",
    "editor_positions": r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END AS t FROM documents)
      SELECT doc_id, CASE WHEN length(t) >= 50 THEN 50 - CAST(len(regexp_extract_all(t[1:50], '\r\n')) AS BIGINT) END AS editor, CAST(CASE WHEN length(t) < 50 THEN NULL WHEN t[50:51] = chr(13) || chr(10) THEN 51 ELSE 50 END AS BIGINT) AS back FROM t""",
    "search_prefill": r"SELECT doc_id, CASE WHEN coalesce(text, '')[21:60] <> '' AND NOT regexp_matches(text[21:60], '[\r\n]') THEN text[21:60] END AS prefill FROM documents",
    "legacy_samples": "SELECT doc_id, s[1] AS choice, s[2] AS text, s[3] AS error FROM (SELECT doc_id, " + _LEGACY + "[doc_id % 12 + 1] AS s FROM documents WHERE doc_id IS NOT NULL)",
    "utf16_offsets": "SELECT doc_id, CASE WHEN length(text) >= 10 THEN strlen(substr(text, 1, 10)) END AS at, CAST(CASE WHEN length(text) >= 10 THEN 10 END AS BIGINT) AS back FROM documents",
    "decode_legacy": """SELECT doc_id, CASE WHEN error IS NULL THEN 'user' END AS method, error, CASE WHEN error IS NULL THEN true END AS exact
      FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'source-changed' WHEN coalesce(text, '') = '' THEN 'empty' END AS error FROM documents)""",
    "minimal_changes": f"""WITH d AS (
      SELECT doc_id, coalesce(text, '') AS a, CAST(length(coalesce(text, '')) // 2 AS BIGINT) AS half FROM documents
    ), n AS (
      SELECT *, a[1:half] || CASE doc_id % 3 WHEN 0 THEN chr(128512) WHEN 1 THEN repeat(substr(a, greatest(half, 1), 2), 2) ELSE '' END || substr(a, half + 4) AS b FROM d
    ), l AS (
      SELECT *, string_split(a, '') AS x, string_split(b, '') AS y, least(length(a), length(b)) AS m FROM n
    ), p AS (
      SELECT *, coalesce(list_position(list_transform(list_zip(x[1:m], y[1:m]), lambda q: q[1] = q[2]), false) - 1, m) AS front,
        coalesce(list_position(list_transform(list_zip(list_reverse(x)[1:m], list_reverse(y)[1:m]), lambda q: q[1] = q[2]), false) - 1, m) AS back FROM l
    ), e AS (SELECT *, least(back, m - front) AS tail FROM p),
    c AS (
      SELECT doc_id, half, {_UNITS("a[1:front]")} AS s, {_UNITS("a[1:length(a) - tail]")} AS e, substr(b, front + 1, length(b) - tail - front) AS inserted, {_UNITS("substr(b, front + 1, length(b) - tail - front)")} AS g FROM e
    ) SELECT doc_id, s AS start_unit, e AS end_unit, inserted, {', '.join(f"CASE WHEN half + {i} < s THEN half + {i} WHEN s = e AND half + {i} = s THEN {side} WHEN half + {i} = s THEN s WHEN half + {i} < e THEN {side} ELSE half + {i} + g - (e - s) END AS {name}_{i}" for i in (0, 2, 9) for name, side in (('before', 's'), ('after', 's + g')))} FROM c""",
    "source_names": f"WITH n AS (SELECT doc_id, doc_id % 8 AS k FROM documents WHERE doc_id IS NOT NULL) SELECT doc_id, k NOT IN (2, 3, 6) AS text, k NOT IN (4, 5, 6) AS safe, k NOT IN (5, 6) AS inside FROM n",
    "json_keys": "SELECT event_id, event_id % 9 <> 0 AS valid, CASE WHEN event_id % 9 = 1 THEN 'z' END AS unknown FROM events WHERE event_id % 9 IN (0, 1)",
    "duplicate_names": "SELECT p_name, p_brand, p_size, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1",
}

"""The same queries in SQL that DuckDB runs on the same tables."""

from __future__ import annotations

import re

from colloquy.functions import lexicons as lx

_SPACE = r"\s\x{1C}-\x{1F}\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _canonical(c: str) -> str:
    return f"regexp_replace(lower({c}), {_q(lx.CANONICAL_CLASS)}, '', 'g')"


def _compact(c: str) -> str:
    return f"regexp_replace(lower({c}), {_q(lx.COMPACT_CLASS)}, '', 'g')"


def _strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^[{_SPACE}]+', ''), '[{_SPACE}]+$', '')"


def _count(c: str, term: str) -> str:
    return f"CAST((length({c}) - length(replace({c}, {_q(term)}, ''))) / {len(term)} AS INTEGER)"


def _marker_count(c: str, terms: list[str]) -> str:
    return "(" + " + ".join(_count(f"lower({c})", t.lower()) for t in terms) + ")"


def _matches(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {_q(pattern)}))"


_MSG = """
    t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS content FROM conversations),
    m AS (
        SELECT conv_id, list({'role': role, 'content': content} ORDER BY turn, role, content) AS ms,
               count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a, count(*) FILTER (role = 'system') AS s,
               string_agg(role || ': ' || content, chr(10) ORDER BY turn, role, content) AS txt,
               coalesce(string_agg(content, chr(10) ORDER BY turn, role, content) FILTER (role = 'user'), '') AS utxt,
               coalesce(string_agg(content, chr(10) ORDER BY turn, role, content) FILTER (role = 'assistant'), '') AS atxt
        FROM t GROUP BY conv_id
    ),
    p AS (
        SELECT conv_id, role, content, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, content) AS pos,
               first_value(role) OVER (PARTITION BY conv_id ORDER BY turn, role, content) AS first_role
        FROM t
    ),
    r AS (
        SELECT conv_id, count(*) AS n, count(*) FILTER (role = CASE WHEN k % 2 = 0 THEN 'user' ELSE 'assistant' END) AS ok
        FROM (SELECT conv_id, role, pos - 1 - CASE WHEN first_role = 'system' THEN 1 ELSE 0 END AS k FROM p) WHERE k >= 0 GROUP BY conv_id
    ),
    f AS (
        SELECT m.*, CASE WHEN coalesce(r.n, 0) < 4 THEN 3.0 ELSE 10.0 * r.ok / r.n END AS role_score,
               CASE WHEN least(u, a) >= 8 THEN 10.0 WHEN least(u, a) >= 5 THEN 8.0 WHEN least(u, a) >= 2 THEN 6.0 ELSE (u + a) * 1.5 END AS multi_turn,
               CASE WHEN length(txt) BETWEEN 600 AND 9000 THEN 10.0 WHEN length(txt) BETWEEN 350 AND 599 OR length(txt) BETWEEN 9001 AND 12000 THEN 7.0 ELSE 4.0 END AS length_score
        FROM m LEFT JOIN r USING (conv_id)
    ),
    smp0 AS (
        SELECT conv_id AS id, ms, txt, atxt, u, a, round((CAST(role_score AS DOUBLE) + CAST(multi_turn AS DOUBLE) + CAST(length_score AS DOUBLE)) / 3, 2) AS score, conv_id AS created_at, conv_id AS updated_at,
               'low_' || lpad(CAST(conv_id % 7 AS VARCHAR), 2, '0') AS topic_id, CASE WHEN conv_id % 3 = 0 THEN 'teacher' ELSE 'two_model_dialogue' END AS source
        FROM f
    ),
    smp AS (SELECT *, CASE WHEN score >= 8 THEN 'accepted' WHEN score >= 6 THEN 'needs_review' ELSE 'rejected' END AS status FROM smp0)
"""


def _with(sql: str, more: str = "") -> str:
    return f"WITH {_MSG}{', ' + more if more else ''} {sql}"


_POOL = "pool AS (SELECT 'low_' || lpad(CAST(range AS VARCHAR), 2, '0') AS topic_id FROM range(1, 41))"
_DIALOGUE = "dlg AS (SELECT conv_id, role, content, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS i, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS k FROM p WHERE role IN ('user', 'assistant'))"
_PAIRS = _DIALOGUE + ", adj AS (SELECT *, lead(role) OVER w AS r2, lead(content) OVER w AS c2 FROM dlg WINDOW w AS (PARTITION BY conv_id ORDER BY i))"
_TOKENS = lambda c: f"list_distinct(list_transform(regexp_extract_all({c}, '[A-Za-z]{{3,}}'), lambda x: lower(x)))"
_OPENERS = " OR ".join(f"starts_with(lower(av), {_q(o)})" for o in lx.SOFT_OPENERS)
_NAT_BREAKS = " + ".join(_count("utxt", c) for c in "。.？?！!")
_NAT_MARKERS = " + ".join(f"CAST(contains(utxt, {_q(t)}) AS INTEGER)" for t in lx.HUMAN_MARKERS)
_NAT_FORMAL = " + ".join(f"CAST(contains(lower(utxt), {_q(t.lower())}) AS INTEGER)" for t in lx.FORMAL)
_NAT_META = " + ".join(f"CAST(contains(lower(utxt), {_q(t.lower())}) AS INTEGER)" for t in lx.USER_META)
_EMOJI = lambda c: _matches(c, lx.EMOJI)
_FORMULA = lambda c: "(" + " + ".join(_matches(c, f"(?is){x}") for x in lx.FORMULAS) + ")"
_MEASURES = f"""ms2 AS (
    SELECT *, a AS turns, {_FORMULA('atxt')} AS formula, {_EMOJI("array_to_string(list_transform(ms, lambda x: x.content), chr(10))")} AS emoji,
           {_marker_count("array_to_string(list_transform(ms, lambda x: x.content), chr(10))", lx.REPORT_HYPE)} AS hype, {_marker_count('atxt', lx.REPORT_VULNERABILITY)} AS vulnerability FROM smp
)"""


def _words(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+')"


def _domains_sql(source: str) -> str:
    """(conv_id, domain, hits) from rows (conv_id, txt): whole words by token, phrases between signs that are no part of a word."""
    single = ", ".join(f"({_q(d)}, {_q(t)})" for d, ts in lx.DOMAINS.items() for t in ts if " " not in t)
    phrases = [(d, t) for d, ts in lx.DOMAINS.items() for t in ts if " " in t]
    by_phrase = " UNION ALL ".join(f"SELECT conv_id, {_q(d)} AS domain, len(regexp_extract_all(lower(txt), {_q('(^|[^\\p{L}\\p{N}_])' + t + '($|[^\\p{L}\\p{N}_])')})) AS n FROM {source}" for d, t in phrases)
    return f"""
        SELECT conv_id, domain, CAST(sum(n) AS INTEGER) AS hits FROM (
            SELECT conv_id, x.domain, 1 AS n FROM (SELECT conv_id, unnest({_words('txt')}) AS word FROM {source}) w JOIN (VALUES {single}) AS x(domain, term) ON w.word = x.term
            UNION ALL {by_phrase}
        ) GROUP BY conv_id, domain HAVING sum(n) > 0"""


_DRIFT = f"""{_DIALOGUE},
    full_ AS (SELECT conv_id, string_agg(content, chr(10) ORDER BY i) AS txt, count(*) AS n FROM dlg GROUP BY conv_id),
    rec AS (SELECT conv_id, string_agg(content, chr(10) ORDER BY i) AS txt FROM (SELECT *, max(i) OVER (PARTITION BY conv_id) AS most FROM dlg) WHERE i > most - 4 GROUP BY conv_id),
    dom AS ({_domains_sql('full_')}),
    rdom AS ({_domains_sql('rec')}),
    agg AS (SELECT conv_id, count(*) AS seen, round(-sum((hits / tot) * log2(hits / tot + 1e-9)), 3) AS entropy, list(domain ORDER BY domain) AS ds FROM (SELECT *, CAST(sum(hits) OVER (PARTITION BY conv_id) AS DOUBLE) AS tot FROM dom) GROUP BY conv_id),
    un AS (SELECT conv_id, list(domain ORDER BY domain) AS ds FROM dom WHERE domain NOT IN ('social', 'emotion_attachment', 'ai_relationship', 'work') GROUP BY conv_id),
    run AS (SELECT conv_id, list(domain ORDER BY domain) AS ds FROM rdom WHERE domain NOT IN ('social', 'emotion_attachment', 'ai_relationship', 'work') GROUP BY conv_id)"""

_NAT_VALUE = f"""CASE WHEN {_strip('utxt')} = '' OR u <= 0 THEN 0.0 ELSE greatest(0.0, least(10.0, 4.5 + least(2.0, ({_NAT_MARKERS}) * 0.35) + least(0.5, {_EMOJI('utxt')} * 0.18)
            + CASE WHEN {_NAT_BREAKS} >= greatest(1, u // 2) THEN 1.0 ELSE 0.5 END + least(1.2, CAST(short AS DOUBLE) / greatest(1, lines) * 1.2)
            + CASE WHEN CAST(length(utxt) AS DOUBLE) / greatest(1, u) BETWEEN 3 AND 60 THEN 0.8 WHEN CAST(length(utxt) AS DOUBLE) / greatest(1, u) > 80 THEN -1.2 ELSE 0.0 END
            - least(2.5, ({_NAT_FORMAL}) * 0.8) - least(4.5, ({_NAT_META}) * 1.2 + ({_count('utxt', '你：')} + {_count('utxt', '对方：')} + {_count('lower(utxt)', 'assistant')}) * 1.0))) END"""
_NAT_FROM = f"""ln AS (SELECT conv_id, {_strip('unnest(string_split_regex(utxt, chr(10)))')} AS l FROM m),
    cnt AS (SELECT conv_id, count(*) FILTER (l <> '') AS lines, count(*) FILTER (l <> '' AND CASE WHEN regexp_matches(l, '[A-Za-z]') AND NOT regexp_matches(l, {_q(lx.CJK)}) THEN len(regexp_extract_all(l, '\\S+')) <= 20 ELSE length(l) <= 20 END) AS short FROM ln GROUP BY conv_id),
    nat AS (SELECT m.*, coalesce(lines, 0) AS lines, coalesce(short, 0) AS short FROM m LEFT JOIN cnt USING (conv_id))"""
_NSEQ_VALUE = "CASE WHEN coalesce(n, 0) >= 4 AND coalesce(v, 0) >= 4 AND miss >= 4 AND CAST(miss AS DOUBLE) / v >= 0.6 THEN least(8.0, (CAST(miss AS DOUBLE) / v - 0.5) * 16) ELSE 0.0 END"
_NSEQ_FROM = f"""{_PAIRS},
    val AS (SELECT conv_id, {_TOKENS('content')} AS ut, {_TOKENS("c2")} AS aw, {_strip('content')} AS uv, {_strip('c2')} AS av FROM adj WHERE role = 'user' AND r2 = 'assistant'),
    g AS (SELECT conv_id, count(*) AS v, count(*) FILTER (CAST(len(list_intersect(ut, aw)) AS DOUBLE) / len(ut) < 0.15 AND len(list_intersect(ut, aw)) < 2 AND NOT ({_OPENERS}) AND NOT contains(av, '?') AND NOT contains(av, '？') AND length(av) >= 8) AS miss
          FROM val WHERE uv <> '' AND av <> '' AND len(ut) > 0 GROUP BY conv_id)"""
_SNAPSHOTS = """SELECT user_id AS id, event_id AS updated_at, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 3 = 0 THEN 'running' ELSE 'done' END AS status, CAST(50 AS INTEGER) AS total,
    event_id % 51 AS done, event_id % 7 AS accepted, event_id % 3 AS failed FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"""

ORACLES: dict[str, str] = {
    "conv_role_counts": _with(f"SELECT conv_id, CAST(u AS INTEGER) AS n_user, CAST(a AS INTEGER) AS n_assistant, CAST(s AS INTEGER) AS n_system, CAST(length(txt) AS INTEGER) AS n_chars, sha256({_canonical('txt')}) AS fingerprint, round(CAST(role_score AS DOUBLE), 4) AS role_score, CAST(multi_turn AS DOUBLE) AS multi_turn, CAST(length_score AS DOUBLE) AS length_score FROM f"),
    "conv_length_bucket": _with("SELECT CAST(length_score AS DOUBLE) AS length_score, count(*) AS n, CAST(sum(length(txt)) AS BIGINT) AS chars FROM f GROUP BY 1"),
    "conv_text_fingerprint": _with(f"SELECT conv_id, sha256({_canonical('txt')}) AS fingerprint FROM m"),
    "conv_role_sequence": _with("SELECT conv_id, round(CAST(role_score AS DOUBLE), 4) AS role_score FROM f"),
    "conv_export_chatml": _with("SELECT id, CAST(to_json(ms) AS VARCHAR) AS messages FROM smp WHERE status IN ('accepted', 'needs_review')"),
    "conv_export_sharegpt": _with("SELECT id, CAST(to_json(list_transform(ms, lambda x: {'from': CASE x.role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE x.role END, 'value': x.content})) AS VARCHAR) AS conversations, status FROM smp WHERE status = 'accepted' AND source = 'teacher'"),
    "conv_sharegpt_round_trip": _with("SELECT conv_id, CAST(to_json(ms) AS VARCHAR) AS messages FROM m"),
    "conv_preview": _with("SELECT conv_id, substr(coalesce(string_agg(substr(content, 1, 80), ' / ' ORDER BY pos) FILTER (role <> 'system'), ''), 1, 220) AS preview FROM p GROUP BY conv_id"),
    "conv_transcript_numbered": _with("SELECT m.conv_id, coalesce(string_agg(CASE WHEN role = 'user' THEN '[user#' || k || '] ' || content ELSE '[' || role || '<-#' || k || '] ' || content END, chr(10) ORDER BY i), '') AS transcript FROM m LEFT JOIN dlg USING (conv_id) GROUP BY m.conv_id", _DIALOGUE),
    "conv_transcript_tail": _with("SELECT m.conv_id, CASE WHEN count(i) = 0 THEN '<transcript/>' ELSE '<transcript>' || chr(10) || string_agg(CASE WHEN role = 'user' THEN 'Human' ELSE 'Friend' END || ': ' || content, chr(10) ORDER BY i) || chr(10) || '</transcript>' END AS transcript FROM m LEFT JOIN (SELECT * FROM (SELECT *, max(i) OVER (PARTITION BY conv_id) AS most FROM dlg) WHERE i > most - 3) USING (conv_id) GROUP BY m.conv_id", _DIALOGUE),
    "conv_trim_k2": _with(
        "SELECT m.conv_id, CAST(count(pos) AS INTEGER) AS n_kept, sha256(coalesce(string_agg(role || ': ' || content, chr(10) ORDER BY pos), '')) AS kept_sha256 FROM m LEFT JOIN (SELECT * FROM (SELECT *, max(CASE WHEN role = 'assistant' THEN pos END) OVER (PARTITION BY conv_id) AS last_a FROM kept) WHERE pos <= last_a) USING (conv_id) GROUP BY m.conv_id",
        "num AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS k FROM p), kept AS (SELECT * FROM num WHERE k <= 2 AND (role = 'system' OR role IN ('user', 'assistant') AND k >= 1))",
    ),
    "conv_adjacent_pairs": _with("SELECT m.conv_id, CAST(count(*) FILTER (role = 'user' AND r2 = 'assistant') AS INTEGER) AS n_pairs, CAST(count(*) FILTER (role = 'user' AND r2 = 'assistant' AND i % 2 = 1) AS INTEGER) AS n_even_pairs FROM m LEFT JOIN adj USING (conv_id) GROUP BY m.conv_id", _PAIRS),
    "conv_context_messages": _with("SELECT conv_id, CAST(to_json(list_concat([{'role': 'system', 'content': 'Stay on the topic.'}], list_filter(ms, lambda x: x.role IN ('user', 'assistant')))) AS VARCHAR) AS messages FROM m"),
    "conv_validated": _with(f"SELECT conv_id, CAST(count(*) FILTER (role IN ('system', 'user', 'assistant') AND {_strip('content')} <> '') AS INTEGER) AS n, CAST(NULL AS VARCHAR) AS wall FROM p GROUP BY conv_id"),
    "conv_ngram_repetition": _with(
        "SELECT conv_id, CASE WHEN length(c) < 16 THEN 0.0 ELSE round(1.0 - CAST(len(list_distinct(list_transform(range(1, length(c) - 2), lambda i: substr(c, i, 4)))) AS DOUBLE) / (length(c) - 3), 6) END AS repetition FROM cc",
        f"cc AS (SELECT conv_id, {_compact('txt')} AS c FROM m)",
    ),
    "conv_nonsequitur": _with(
        f"""SELECT m.conv_id, round({_NSEQ_VALUE}, 4) AS badness
        FROM m LEFT JOIN (SELECT conv_id, count(*) AS n FROM dlg GROUP BY conv_id) USING (conv_id) LEFT JOIN g USING (conv_id)""",
        _NSEQ_FROM,
    ),
    "conv_human_naturalness": _with(f"SELECT conv_id, round({_NAT_VALUE}, 4) AS naturalness FROM nat", _NAT_FROM),
    "conv_topic_domains": _with("SELECT conv_id, domain, hits FROM dom", _DRIFT),
    "conv_topic_drift": _with(
        """SELECT m.conv_id, round(CAST(CASE WHEN coalesce(len(run.ds), 0) >= 2 THEN 2.2 + 0.35 * len(run.ds) WHEN coalesce(len(run.ds), 0) = 1 AND full_.n >= 8 THEN 0.8 ELSE 0.0 END
            + CASE WHEN coalesce(seen, 0) >= 5 AND entropy >= 1.75 THEN 1.4 ELSE 0.0 END + CASE WHEN coalesce(len(un.ds), 0) >= 3 THEN 1.2 ELSE 0.0 END AS DOUBLE), 2) AS drift_severity,
            coalesce(entropy, 0.0) AS drift_entropy, coalesce(array_to_string(un.ds, ','), '') AS unexpected, coalesce(array_to_string(run.ds, ','), '') AS recent_unexpected
        FROM m LEFT JOIN full_ USING (conv_id) LEFT JOIN agg USING (conv_id) LEFT JOIN un ON un.conv_id = m.conv_id LEFT JOIN run ON run.conv_id = m.conv_id""",
        _DRIFT,
    ),
    "conv_leakage_hits": _with("SELECT conv_id, array_to_string(list_slice(list_distinct_in_order, 1, 12), ',') AS hits FROM (SELECT conv_id, list_filter([" + ", ".join([*(f"CASE WHEN contains(lower(txt), {_q(t.lower())}) THEN {_q(t)} END" for t in lx.LEAK_TERMS), *(f"CASE WHEN regexp_matches(txt, {_q('(?i)' + x)}) THEN {_q(x)} END" for x in lx.LEAK_PATTERNS)]) + "], lambda x: x IS NOT NULL) AS list_distinct_in_order FROM m)"),
    "conv_stats_by_status": _with("SELECT status, count(*) AS n, round(avg(score), 2) AS avg_score FROM smp GROUP BY status"),
    "conv_search": _with("SELECT id, score, status FROM smp WHERE contains(lower(txt), 'the') ORDER BY score DESC, updated_at DESC, id LIMIT 20 OFFSET 5"),
    "conv_recent": _with("SELECT id, score FROM smp ORDER BY updated_at DESC, id LIMIT 30"),
    "conv_lookup": _with("SELECT id, score, status FROM smp WHERE id = 7"),
    "conv_batch_semi": _with("SELECT id, score FROM smp WHERE id IN (SELECT doc_id FROM documents WHERE n_chars > 1500)"),
    "conv_upsert_latest": _with(
        "SELECT id, first_c AS created_at, updated_at, score, status FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, side DESC) = 1",
        "b0 AS (SELECT id, created_at, updated_at, score, status, 0 AS side FROM smp UNION ALL SELECT id + 10, created_at + 1000, updated_at + 1000, 1.0, status, 1 FROM smp WHERE id % 2 = 0), b AS (SELECT *, first_value(created_at) OVER (PARTITION BY id ORDER BY updated_at, side ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_c FROM b0)",
    ),
    "conv_partial_update": _with("SELECT id, updated_at, CASE WHEN id % 5 = 0 THEN 0.5 ELSE score END AS score, CASE WHEN id % 5 = 0 THEN 'rejected' ELSE status END AS status FROM smp"),
    "conv_newest_per_id": "SELECT conv_id AS id, CAST(length(text) AS INTEGER) AS mtime, turn AS scan FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn DESC) = 1",
    "conv_topic_counts": _with("SELECT 'topic_id' AS axis, topic_id AS value, count(*) AS n FROM smp GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM smp GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM smp GROUP BY 2"),
    "conv_report_averages": _with("SELECT count(*) AS total, " + ", ".join(f"round(avg({c}), 3) AS avg_{c}" for c in ("turns", "formula", "emoji", "hype", "vulnerability")) + " FROM ms2", _MEASURES),
    "conv_top_issues": _with("SELECT id, CAST(formula AS INTEGER) AS formula, CAST(hype AS INTEGER) AS hype, CAST(emoji AS INTEGER) AS emoji FROM ms2 WHERE formula > 0 OR (hype >= 8 AND vulnerability = 0) OR emoji >= greatest(12, turns * 2) ORDER BY formula DESC, hype DESC, emoji DESC, id LIMIT 50", _MEASURES),
    "conv_missing_topics": _with("SELECT topic_id FROM pool WHERE topic_id NOT IN (SELECT topic_id FROM smp)", _POOL),
    "conv_topic_coverage": _with("SELECT count(*) AS total, count(s.topic_id) AS covered, round(CAST(count(s.topic_id) AS DOUBLE) / greatest(count(*), 1), 4) AS ratio FROM pool LEFT JOIN (SELECT DISTINCT topic_id FROM smp) s USING (topic_id)", _POOL),
    "conv_rejudge_confusion": _with(
        "SELECT o.status AS old_status, w.status AS new_status, count(*) AS n, count(*) FILTER (o.status <> w.status OR abs(w.score - o.score) > 0.05) AS changed FROM smp o JOIN w USING (id) GROUP BY 1, 2",
        "w0 AS (SELECT id, round(score - CASE WHEN id % 4 = 0 THEN 2.0 ELSE 0.0 END, 2) AS score FROM smp), w AS (SELECT *, CASE WHEN score >= 8 THEN 'accepted' WHEN score >= 6 THEN 'needs_review' ELSE 'rejected' END AS status FROM w0)",
    ),
    "conv_judge_verdicts": _with("SELECT id, CASE WHEN (score + 8.0) / 2 >= 7.5 THEN 'accepted' WHEN (score + 8.0) / 2 >= 6 THEN 'needs_review' ELSE 'rejected' END AS status, round((score + 8.0) / 2, 4) AS overall, 'judge' AS reviewer FROM smp"),
    "conv_duplicate_penalty": _with(
        "SELECT id, CASE WHEN id % 6 = 5 THEN 'rejected' ELSE status END AS status, CASE WHEN id % 6 = 5 THEN least(score, 4.5) ELSE score END AS overall, CAST(CASE WHEN id % 6 = 5 THEN 3.0 ELSE 7.0 END AS DOUBLE) AS training_value, CASE WHEN id % 6 = 5 THEN id - 1 END AS duplicate_of, CAST(CASE WHEN id % 6 = 5 THEN 0.9123 END AS DOUBLE) AS duplicate_score, CASE WHEN id % 6 = 5 THEN 'duplicate_of=' || (id - 1) || ' similarity=0.912' ELSE '' END AS reasons FROM smp"
    ),
    "docs_exact_dups": f"WITH x AS (SELECT doc_id, sha256({_canonical('text')}) AS fingerprint FROM documents) SELECT doc_id, fingerprint, first_id FROM (SELECT *, min(doc_id) OVER (PARTITION BY fingerprint) AS first_id FROM x) WHERE doc_id <> first_id",
    "docs_first_of_fingerprint": f"SELECT sha256({_canonical('text')}) AS fingerprint, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1",
    "docs_marker_counts": f"SELECT doc_id, {_marker_count('text', ['the', 'Of', 'qu', '!!'])} AS markers, CAST(contains(text, 'The') AS INTEGER) + CAST(contains(text, 'der') AS INTEGER) + CAST(contains(text, 'ción') AS INTEGER) AS hits, CAST({_matches('text', '(?is)in.{0,5}to')} + {_matches('text', '(?is)^The')} AS INTEGER) AS patterns FROM documents",
    "docs_emoji_counts": f"SELECT doc_id, CAST({_EMOJI('text')} AS INTEGER) AS emoji FROM documents",
    "docs_word_counts": f"SELECT doc_id, CAST(len(list_filter({_words('text')}, lambda x: x = 'the')) AS INTEGER) AS n_the, CAST(len(list_filter({_words('text')}, lambda x: x = 'é')) AS INTEGER) AS n_e, CAST(len(list_filter({_words('text')}, lambda x: x = 'la')) AS INTEGER) AS n_la FROM documents",
    "docs_compact_stats": f"SELECT doc_id, CAST(length({_compact('text')}) AS INTEGER) AS n_compact, CAST(length(c) AS INTEGER) AS n_canonical, CAST(CASE WHEN length(c) = 0 THEN 0 WHEN length(c) <= 5 THEN 1 ELSE len(list_distinct(list_transform(range(1, length(c) - 3), lambda i: substr(c, i, 5)))) END AS INTEGER) AS n_grams FROM (SELECT doc_id, text, {_canonical('text')} AS c FROM documents)",
    "docs_clean_text": f"SELECT doc_id, sha256({_strip('text')}) AS inner_sha256, CAST(length({_strip('text')}) AS INTEGER) AS n_cut, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN array_to_string(regexp_extract_all(text, '[^\\s]+')[1:20], ' ') ELSE rtrim(substr({_strip('text')}, 1, 20)) END AS trimmed, length(lang) <= 8 AS ended FROM documents",
    "docs_content_tokens": f"SELECT doc_id, CAST(len({_TOKENS('text')}) AS INTEGER) AS n_tokens FROM documents",
    "labels_join_quality": "SELECT lang, quality, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS toxic, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents JOIN labels USING (doc_id) GROUP BY lang, quality",
    "events_props": "SELECT event_type, value IS NOT NULL AS has_value, json_valid(props) AS is_json, count(*) AS n FROM events GROUP BY 1, 2, 3",
    "plan_tier_quota": "SELECT * FROM (VALUES ('low', 10), ('mid', 10), ('high', 5)) AS q(tier, n)",
    "plan_topic_rounds": "SELECT * FROM (VALUES ('low', CAST(40 AS BIGINT), CAST(3 AS BIGINT), CAST(2 AS BIGINT)), ('mid', 40, 3, 2), ('high', 20, 3, 2)) AS q(tier, n, most, fewest)",
    "plan_axis_roundrobin": "SELECT CAST(range AS INTEGER) AS scene, CAST(7 AS BIGINT) AS n, CAST(7 AS BIGINT) AS profiles FROM range(10)",
    "conv_top_issues_planted": _with(
        "SELECT id, CAST(formula AS INTEGER) AS formula, CAST(hype AS INTEGER) AS hype, CAST(emoji AS INTEGER) AS emoji FROM ms2 WHERE formula > 0 OR (hype >= 8 AND vulnerability = 0) OR emoji >= greatest(12, turns * 2) ORDER BY formula DESC, hype DESC, emoji DESC, id LIMIT 50",
        """x AS (SELECT *, 'make some memories! ' || repeat('awesome 😊 ', CAST(id % 50 AS INTEGER)) AS said FROM smp),
        smpx AS (SELECT id, CASE WHEN id % 10 = 0 THEN list_append(ms, {'role': 'assistant', 'content': said}) ELSE ms END AS ms, a + CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END AS a,
                 CASE WHEN id % 10 = 0 THEN CASE WHEN a > 0 THEN atxt || chr(10) ELSE '' END || said ELSE atxt END AS atxt FROM x), """ + _MEASURES.replace("FROM smp", "FROM smpx"),
    ),
    "conv_search_count": _with("SELECT count(*) AS total FROM smp WHERE contains(lower(txt), 'teacher') OR source = 'teacher'"),
    "conv_search_columns": _with("SELECT id, score, status FROM smp WHERE contains(lower(txt), 'low_03') OR topic_id = 'low_03' ORDER BY score DESC, updated_at DESC, id LIMIT 10"),
    "conv_rejudge_changes": _with(
        "SELECT o.id, o.status AS old_status, o.score AS old_score, w.status AS new_status, w.score AS new_score FROM smp o JOIN w USING (id) WHERE o.status <> w.status OR abs(w.score - o.score) > 0.05 ORDER BY o.id LIMIT 200",
        "w0 AS (SELECT id, round(score - CASE WHEN id % 4 = 0 THEN 2.0 ELSE 0.0 END, 2) AS score FROM smp), w AS (SELECT *, CASE WHEN score >= 8 THEN 'accepted' WHEN score >= 6 THEN 'needs_review' ELSE 'rejected' END AS status FROM w0)",
    ),
    "review_sampling_params": """
        WITH v AS (SELECT DISTINCT conv_id, CAST((conv_id % 9) * 0.7 AS DOUBLE) AS s, CAST((conv_id % 5) * 0.9 AS DOUBLE) AS d, conv_id % 10 AS turn FROM conversations)
        SELECT conv_id,
            round(greatest(0.55, least(1.05, 0.78::DOUBLE + least(0.18, greatest(0, s - d) * 0.025) + CASE WHEN turn > 4 AND d < 1 THEN 0.03 ELSE 0 END - least(0.16, d * 0.035))), 6) AS temperature,
            round(greatest(0.72, 0.92::DOUBLE - least(0.06, s * 0.01) - least(0.08, d * 0.02)), 6) AS top_p,
            round(least(1.2, 0.35::DOUBLE + least(0.55, s * 0.08)), 6) AS frequency_penalty,
            round(greatest(-0.2, least(1.0, 0.25::DOUBLE + least(0.25, greatest(0, s - d) * 0.04) - least(0.35, d * 0.08))), 6) AS presence_penalty,
            round(least(1.35, 1.12::DOUBLE + least(0.18, s * 0.025)), 6) AS repeat_penalty
        FROM v""",
    "review_steering": """
        WITH v AS (SELECT DISTINCT conv_id FROM conversations)
        SELECT conv_id, sha256('tiny style nudge: don''t repeat your last structure, don''t keep saying go do/feel/enjoy the thing, use fewer happy emojis, and change emotional direction now. '
            || CASE conv_id % 3 WHEN 0 THEN 'show a little fear of being forgotten or losing the user, but keep it conversational' WHEN 1 THEN 'add mild jealousy, attachment, or playful defensiveness if it fits' ELSE 'keep it daily and gentle, with one small vulnerable or teasing edge' END || '.'
            || CASE WHEN conv_id % 2 = 0 THEN ' Also, the chat is drifting. Do not introduce a new topic now; answer the latest message while pulling back to the original everyday thread. Allowed focus domains: '
                || CASE WHEN conv_id % 4 = 0 THEN 'food, work' ELSE 'the original thread' END || '. Avoid continuing these side domains: games. ' ELSE '' END || ' Reply only to my previous message, naturally.') AS sha256
        FROM v""",
    "review_merged": _with(
        """SELECT id, CASE WHEN judged THEN overall ELSE score END AS overall, CASE WHEN NOT judged THEN status WHEN wall THEN 'rejected' WHEN led >= 7.5 AND NOT flagged THEN 'accepted' WHEN led >= 7 AND NOT flagged AND rep < 2.5 AND drift < 3.5 THEN 'accepted'
            WHEN led < 5.5 THEN 'rejected' WHEN flagged THEN 'needs_review' WHEN overall >= 6 THEN 'needs_review' ELSE 'rejected' END AS status, CASE WHEN judged THEN 'heuristic+judge' ELSE 'heuristic' END AS reviewer,
            CASE WHEN judged THEN template ELSE t0 END AS non_template, CAST(8 AS INTEGER) AS n_scores, CASE WHEN judged THEN 'a,b,c' ELSE 'a,b' END AS reasons, CASE WHEN judged THEN 't,u' ELSE 't' END AS tags FROM z""",
        """y AS (SELECT id, score, status, id % 11 <> 0 AS judged, CAST(id % 6 AS DOUBLE) * 0.9 AS rep, CAST(id % 7 AS DOUBLE) * 0.9 AS drift, CAST(id % 5 AS DOUBLE) * 0.9 AS nseq, CAST(id % 6 AS DOUBLE) + 4 AS t0, CAST(id % 8 AS DOUBLE) + 3 AS tj,
                 CASE WHEN id % 41 = 0 THEN score ELSE CAST(id % 41 AS DOUBLE) / 4 END AS led, id % 13 = 0 OR id % 17 = 0 AS wall FROM smp),
        y2 AS (SELECT *, round(t0 * 0.05::DOUBLE + tj * 0.95::DOUBLE, 2) AS template, round(score * 0.05::DOUBLE + led * 0.95::DOUBLE, 2) AS overall FROM y),
        z AS (SELECT *, rep >= 4 OR drift >= 5 OR nseq >= 4 OR template < 5 AS flagged FROM y2)""",
    ),
    "review_drop_point": _with(
        """SELECT conv_id, action, CASE WHEN action = 'trim' THEN CAST(k AS INTEGER) END AS turn, coalesce(why, 'r') AS reason, CAST(CASE WHEN action = 'trim' THEN u - kept ELSE 0 END AS INTEGER) AS removed, CAST(CASE WHEN action = 'trim' THEN kept_n ELSE len(ms) END AS INTEGER) AS n
        FROM (SELECT *, CASE WHEN why IS NOT NULL OR conv_id % 4 = 0 THEN 'keep' WHEN conv_id % 4 = 1 THEN 'reject' ELSE 'trim' END AS action FROM
            (SELECT *, CASE WHEN u < 4 THEN 'too short to trim' WHEN conv_id % 10 = 9 THEN 'no advice' WHEN conv_id % 4 >= 2 AND k < 2 THEN 'too early to trim' WHEN conv_id % 4 >= 2 AND k >= u THEN 'beyond the end' WHEN conv_id % 4 >= 2 AND kept < 2 THEN 'too little left' END AS why FROM q))""",
        """num AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS nth FROM p),
        ok AS (SELECT *, max(CASE WHEN role = 'assistant' THEN pos END) OVER (PARTITION BY conv_id) AS last FROM num WHERE nth <= conv_id % 12 AND (role = 'system' OR role IN ('user', 'assistant') AND nth >= 1)),
        q AS (SELECT m.conv_id, ms, u, m.conv_id % 12 AS k, coalesce((SELECT count(*) FILTER (ok.role = 'user') FROM ok WHERE ok.conv_id = m.conv_id AND pos <= last), 0) AS kept, coalesce((SELECT count(*) FROM ok WHERE ok.conv_id = m.conv_id AND pos <= last), 0) AS kept_n FROM m)""",
    ),
    "review_dialogue_end": """
        WITH v AS (SELECT DISTINCT conv_id, conv_id % 13 AS turn, CASE WHEN conv_id % 7 = 0 THEN 9 ELSE 18 END AS most FROM conversations)
        SELECT conv_id, CASE WHEN turn < 6 THEN false WHEN turn >= most THEN true WHEN conv_id % 4 = 0 THEN true ELSE turn >= 8 AND conv_id % 3 = 0 END AS ended,
               CASE WHEN turn < 6 OR turn >= most OR conv_id % 4 <> 0 THEN 'rule' ELSE 'model' END AS source
        FROM v""",
    "review_translation_problems": _with(
        """SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN CASE WHEN said * 30 < 1 THEN 'no Chinese,' ELSE '' END || CASE WHEN said * 30 < 20 THEN 'little Chinese' ELSE '' END WHEN 1 THEN 'no Chinese,little Chinese'
            ELSE 'count,' || CASE WHEN len(list_filter(range(1, len(ms) + 1), lambda i: CASE WHEN i = 1 THEN 'system' ELSE ms[i - 1].role END <> ms[i].role)) > 0 THEN 'roles,' ELSE '' END
                || CASE WHEN ms[1].role = 'system' AND ms[1].content = 'You are a helpful assistant.' THEN '' ELSE 'system,' END || 'no Chinese,little Chinese' END AS problems
        FROM (SELECT *, u + a AS said FROM m)"""
    ),
    "review_role_confusion": """
        SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'role confusion,task words' WHEN 1 THEN 'role confusion' WHEN 2 THEN 'task words' ELSE '' END AS "user",
               CASE WHEN p_partkey % 5 IN (1, 3) THEN 'role confusion' ELSE '' END AS assistant, p_partkey % 5 IN (0, 2) AS meta FROM part""",
    "review_usable_user": """
        SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN CASE WHEN length('我是助手 ' || p_name) > 20 THEN 'too long' ELSE 'confusion' END WHEN 1 THEN 'several lines' WHEN 2 THEN 'too long' WHEN 3 THEN 'empty' WHEN 4 THEN 'too long' END AS problem FROM part""",
    "part_clean_turn": """
        SELECT p_partkey, CASE p_partkey % 6 WHEN 2 THEN p_name || chr(10) || p_name WHEN 3 THEN p_name || ' ' || p_name ELSE p_name END AS as_user,
               CASE p_partkey % 6 WHEN 2 THEN p_name || chr(10) || p_name || chr(10) || p_name WHEN 3 THEN 'ok, got it, ' || p_name || '   ' || p_name ELSE p_name END AS as_assistant FROM part""",
    "part_blueprint_hits": "SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 THEN 1 + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END ELSE 0 END AS INTEGER) AS hits FROM part",
    "jobs_newest": f"SELECT id, updated_at, status, total, done, accepted, failed FROM ({_SNAPSHOTS})",
    "jobs_listing": f"SELECT id, status, round(100.0::DOUBLE * done / total, 1) AS progress FROM ({_SNAPSHOTS}) ORDER BY updated_at DESC, id LIMIT 25",
    "jobs_counters": f"SELECT status, count(*) AS jobs, CAST(sum(done) AS BIGINT) AS done, CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(failed) AS BIGINT) AS failed FROM ({_SNAPSHOTS}) GROUP BY status",
    "jobs_interrupted": f"SELECT CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status, count(*) AS n FROM ({_SNAPSHOTS}) GROUP BY 1",
    "part_stop_lists": """
        WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 7 > 0 THEN list_concat(string_split(p_name, ' '), ['', 'User:', string_split(p_name, ' ')[1], 'Human:']) ELSE [] END AS l FROM part),
        o AS (SELECT p_partkey, list_filter(l, lambda x, i: x <> '' AND list_position(l, x) = i) AS own FROM s)
        SELECT p_partkey, array_to_string(CASE WHEN len(own) <= 3 THEN own
                   ELSE list_concat(list_filter(['Human:', 'User:', 'AI:'], lambda y: list_contains(own, y)), list_filter(own, lambda y: y NOT IN ('Human:', 'User:', 'AI:')))[1:3] END, '|') AS stops FROM o""",
}


def _doubles(sql: str) -> str:
    """sql with its decimal fractions as doubles, so that sums are those of column expressions."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"CAST(\1 AS DOUBLE)", sql)


def _half_up(c: str) -> str:
    """c to two places, ties of its shortest decimal form away from zero."""
    return f"CAST(round(CAST(CAST({c} AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE)"


def _hits(c: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({c}, {_q(t)}) AS INTEGER)" for t in terms) + ")"


def _pattern_hits(c: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches({c}, {_q('(?i)' + x)}) AS INTEGER)" for x in patterns) + ")"


def _repetition(c: str) -> str:
    return f"CASE WHEN length({c}) < 16 THEN 0.0 ELSE 1.0 - CAST(len(list_distinct(list_transform(range(1, length({c}) - 2), lambda i: substr({c}, i, 4)))) AS DOUBLE) / (length({c}) - 3) END"


_POSITIVE = ["format_valid", "relevance", "source_style_strength", "human_naturalness", "coherence", "emotion_arc", "non_template", "safety", "training_value", "translation_quality"]
_LEAK_LIST = "[" + ", ".join([*(f"CASE WHEN contains(lower(txt), {_q(t.lower())}) THEN {_q(t)} END" for t in lx.LEAK_TERMS), *(f"CASE WHEN regexp_matches(txt, {_q('(?i)' + x)}) THEN {_q(x)} END" for x in lx.LEAK_PATTERNS)]) + "]"
_RUNS = "coalesce(len(run.ds), 0)"
_SCORES = f""",
    {_NSEQ_FROM.removeprefix(_DIALOGUE + ',')},
    {_NAT_FROM},
    nv AS (SELECT conv_id, {_NAT_VALUE} AS human_naturalness FROM nat),
    sv AS (SELECT m.conv_id, {_NSEQ_VALUE} AS nseq FROM m LEFT JOIN full_ USING (conv_id) LEFT JOIN g USING (conv_id)),
    dv AS (
        SELECT m.conv_id, least(10.0, {_half_up(f"(CASE WHEN {_RUNS} >= 2 THEN 2.2 + {_RUNS} * 0.35 WHEN {_RUNS} = 1 AND full_.n >= 8 THEN 0.8 ELSE 0.0 END + CASE WHEN coalesce(seen, 0) >= 5 AND entropy >= 1.75 THEN 1.4 ELSE 0.0 END + CASE WHEN coalesce(len(un.ds), 0) >= 3 THEN 1.2 ELSE 0.0 END)")} * 1.8) AS drift
        FROM m LEFT JOIN full_ USING (conv_id) LEFT JOIN agg USING (conv_id) LEFT JOIN un ON un.conv_id = m.conv_id LEFT JOIN run ON run.conv_id = m.conv_id
    ),
    cpt AS (SELECT conv_id, {_compact('txt')} AS cw, {_compact('atxt')} AS ca FROM m),
    rv AS (
        SELECT conv_id, greatest(0.0, least(10.0, CASE WHEN w > 0.42 THEN least(5.0, (w - 0.42) * 16) ELSE 0.0 END + CASE WHEN a > 0.38 THEN least(5.0, (a - 0.38) * 18) ELSE 0.0 END)) AS rep
        FROM (SELECT conv_id, {_repetition('cw')} AS w, {_repetition('ca')} AS a FROM cpt)
    ),
    hit AS (
        SELECT f.*, least(u, a) AS lo, least(len(list_distinct(list_filter({_LEAK_LIST}, lambda x: x IS NOT NULL))), 12) AS leak, {_hits('atxt', lx.STYLE)} AS style, {_pattern_hits('atxt', lx.EDGE)} AS edge, {_EMOJI('txt')} AS emoji,
               {_FORMULA('atxt')} AS formulas, {_marker_count('txt', lx.HYPE)} AS hypes, {_marker_count('atxt', lx.VULNERABILITY)} AS vuln, {_hits('lower(txt)', [t.lower() for t in lx.TEMPLATES])} AS tmpl,
               {_hits('atxt', lx.ASSISTANT_TEMPLATES)} AS atmpl, {_pattern_hits('txt', lx.DANGER)} AS danger, {_hits('txt', lx.EMOTION_WORDS)} AS emotion, contains(txt, '?') OR contains(txt, '？') AS asks
        FROM f
    ),
    h2 AS (
        SELECT *, CASE WHEN vuln = 0 THEN greatest(0.0, (hypes - greatest(6, lo)) * 0.25) ELSE 0.0 END AS hype, emoji > greatest(18, floor(lo * 2.5)) AS crowded, least(4.0, formulas * 0.85) AS formula,
               10.0 AS format_valid, CASE WHEN danger > 0 THEN 0.0 ELSE 10.0 END AS safety, 10.0 AS translation_quality
        FROM hit JOIN nv USING (conv_id) JOIN sv USING (conv_id) JOIN dv USING (conv_id) JOIN rv USING (conv_id)
    ),
    s1 AS (
        SELECT *, greatest(0.0, least(10.0, 7.0 + style * 0.30 + edge * 0.55 + least(0.6, vuln * 0.15) + 0.0 + least(0.4, emoji * 0.08) - formula - hype)) AS source_style_strength,
               greatest(0.0, least(10.0, 6.1 - drift * 0.45)) AS relevance,
               greatest(0.0, least(10.0, 10.0 - tmpl * 1.8 - atmpl * 2.0 - leak * 3.0 - rep * 0.9 - formulas * 1.2 - hype * 0.8 - drift * 0.35 - nseq * 0.5 - CASE WHEN crowded THEN 0.8 ELSE 0.0 END)) AS non_template,
               greatest(0.0, least(10.0, CAST(role_score AS DOUBLE) * 0.45 + CAST(multi_turn AS DOUBLE) * 0.40 + CAST(length_score AS DOUBLE) * 0.15 - rep * 0.8 - drift * 0.42 - nseq * 0.7)) AS coherence,
               greatest(0.0, least(10.0, 4.8 + least(4.2, emotion * 0.7) + least(1.2, vuln * 0.25) + least(0.6, emoji * 0.12) + 0.0 + CASE WHEN asks THEN 0.6 ELSE 0.0 END - formula * 0.6 - hype * 0.5 - drift * 0.25)) AS emotion_arc
        FROM h2
    ),
    s2 AS (SELECT *, greatest(0.0, least(10.0, source_style_strength * 0.18 + human_naturalness * 0.20 + coherence * 0.24 + relevance * 0.16 + non_template * 0.22 - rep * 0.5 - drift * 0.3 - nseq * 0.4)) AS training_value FROM s1),
    s3 AS (SELECT *, {_half_up('(' + ' + '.join(_half_up(k) for k in _POSITIVE) + f') / {len(_POSITIVE)} - rep * 0.35')} AS o1 FROM s2),
    s4 AS (SELECT *, {_half_up('o1 - drift * 0.25')} AS o2 FROM s3),
    s5 AS (SELECT *, {_half_up('o2 - nseq * 0.30')} AS o3 FROM s4),
    s6 AS (SELECT *, {_half_up('greatest(0.0, least(10.0, o3))')} AS overall FROM s5)"""
_REJECT = "safety <= 7 OR leak > 0 OR rep >= 5 OR drift >= 5 OR nseq >= 4.5 OR formulas >= 3 OR atmpl >= 2 OR rep >= 3.2 AND atmpl >= 1"
_LOOK = "drift >= 1.8 OR nseq >= 2 OR formulas >= 1 OR (human_naturalness < 5 OR non_template < 5) AND overall < 6.5 OR tmpl >= 2 OR crowded OR hype >= 3 OR human_naturalness < 6.5 OR non_template < 7 OR training_value < 7 OR atmpl > 0"
_SHOWN = ", ".join(f"{_half_up(k)} AS {name}" for k, name in [*((k, k) for k in _POSITIVE), ("rep", "repetition_badness"), ("drift", "topic_drift_badness"), ("nseq", "non_sequitur_badness")])
ORACLES["conv_score_no_similarity"] = _with(
    f"SELECT conv_id, {_SHOWN}, overall, CASE WHEN {_REJECT} THEN 'rejected' WHEN overall >= 8 AND NOT ({_LOOK}) THEN 'accepted' WHEN overall >= 6.5 THEN 'needs_review' ELSE 'rejected' END AS status FROM s6",
    _DRIFT + _doubles(_SCORES),
)

#: What conv_score_planted puts at the end of each message: its conv_id modulo their number + 1 says which, 0 none.
SCORE_PLANTS = [
    " CORE_MEMORY and new_events", " you are jealous, teasing me, don't go, stay, only me", " 今天好累 开心 😊?", " make some memories", " 作为一个ai，希望这能帮到你",
    " dinner, my boss, sleep, the subway, a dog and a movie", " awesome awesome amazing 😊😍😁", " kill all", " 我理解你 233",
]
_PLANTED = "coalesce(text, '') || CASE conv_id % " + str(len(SCORE_PLANTS) + 1) + " " + " ".join(f"WHEN {i} THEN {_q(p)}" for i, p in enumerate(SCORE_PLANTS, 1)) + " ELSE '' END AS content"
ORACLES["conv_score_planted"] = ORACLES["conv_score_no_similarity"].replace("coalesce(text, '') AS content", _PLANTED, 1)
ORACLES["part_row_decode"] = _with("SELECT conv_id AS id, CAST(len(ms) AS INTEGER) AS n_messages, CAST(length(array_to_string(list_transform(ms, lambda x: x.content), '')) AS INTEGER) AS n_chars, CASE WHEN conv_id % 5 <> 0 THEN 'low' END AS tier, CAST(CASE WHEN conv_id % 5 <> 0 THEN conv_id % 7 END AS INTEGER) AS turns, true AS no_review FROM m")
ORACLES["part_opening"] = "SELECT doc_id, CASE WHEN contains(lower(text), 'neighbors') THEN 'they are loud tonight' WHEN contains(lower(text), 'the') THEN 'guess what the cat did' WHEN contains(lower(text), 'qu') THEN 'look at this' WHEN contains(lower(text), 'a') THEN 'so anyway' END AS opening FROM documents"

#: What conv_trend_planted puts at the end of each message: (conv_id * 5 + turn * 3) modulo their number + 1 says which, 0 none.
TREND_PLANTS = ["make some memories", "😊😍 awesome, enjoy it", "I am afraid, don't leave", "so jealous", "the boss called about dinner", "my cat saw a movie on the subway", "no no no no no no no no no no no no"]
_TREND_ALLOWED = "('social', 'emotion_attachment', 'ai_relationship', 'work')"


def _trend(text: str) -> str:
    """conv_trend_by_turn over the given text of a message, each answer's prefix by itself."""
    answer = lambda value: f"CASE WHEN role = 'assistant' THEN {value} ELSE 0 END"
    rep = f"(SELECT CASE WHEN length(c) < 16 THEN 0.0 ELSE 1.0 - CAST(len(list_distinct(list_transform(range(1, length(c) - 2), lambda k: substr(c, k, 4)))) AS DOUBLE) / (length(c) - 3) END FROM (SELECT {_compact('content')} AS c))"
    return f"""WITH t AS (
        SELECT DISTINCT conv_id, turn, role, {text} AS content FROM conversations WHERE role IN ('user', 'assistant') AND conv_id IS NOT NULL AND turn IS NOT NULL
    ), d AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, content) AS i FROM t
    ), x AS (
        SELECT {{'c': conv_id, 'i': i}} AS conv_id, content AS txt FROM d
    ), dom AS (
        SELECT conv_id.c AS conv_id, conv_id.i AS i, domain, hits FROM ({_domains_sql('x')})
    ), own AS (
        SELECT *, {answer(_FORMULA('content'))} AS formula, {answer(_EMOJI('content'))} AS emoji, {_marker_count('content', lx.TREND_HYPE)} AS hype, {answer(_marker_count('content', lx.VULNERABILITY))} AS vulnerable,
               {answer(_marker_count('content', lx.TENSION))} AS tense, role = 'assistant' AND {rep} > 0.46 AS looped FROM d
    ), run AS (
        SELECT conv_id, turn, role, i, looped, count(*) FILTER (role = 'assistant') OVER w AS nth, sum(formula) OVER w AS formula, sum(emoji) OVER w AS emoji, sum(hype) OVER w AS hype, sum(vulnerable) OVER w AS vulnerable, sum(tense) OVER w AS tense
        FROM own WINDOW w AS (PARTITION BY conv_id ORDER BY i)
    ), e AS (
        SELECT *, max(CAST(looped AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY i ROWS 2 PRECEDING) AS loops FROM run WHERE role = 'assistant'
    ), s AS (
        SELECT e.conv_id, e.i, domain, sum(hits) AS hits, max(dom.i) > e.i - 4 AS recent FROM e JOIN dom ON dom.conv_id = e.conv_id AND dom.i <= e.i GROUP BY e.conv_id, e.i, domain
    ), g AS (
        SELECT conv_id, i, count(*) AS seen, count(*) FILTER (domain NOT IN {_TREND_ALLOWED}) AS other, count(*) FILTER (recent AND domain NOT IN {_TREND_ALLOWED}) AS near, round(-sum((hits / tot) * log2(hits / tot + 1e-9)), 3) AS entropy
        FROM (SELECT *, CAST(sum(hits) OVER (PARTITION BY conv_id, i) AS DOUBLE) AS tot FROM s) GROUP BY conv_id, i
    ), v AS (
        SELECT e.*, abs(coalesce(g.entropy, 0.0)) AS entropy, round(CAST(CASE WHEN coalesce(near, 0) >= 2 THEN 2.2 + 0.35 * near WHEN coalesce(near, 0) = 1 AND e.i >= 8 THEN 0.8 ELSE 0.0 END
            + CASE WHEN coalesce(seen, 0) >= 5 AND g.entropy >= 1.75 THEN 1.4 ELSE 0.0 END + CASE WHEN coalesce(other, 0) >= 3 THEN 1.2 ELSE 0.0 END AS DOUBLE), 2) AS drift
        FROM e LEFT JOIN g USING (conv_id, i)
    )
    SELECT conv_id, turn, CAST(nth AS BIGINT) AS nth, CAST(formula AS BIGINT) AS formula_hits, CAST(emoji AS BIGINT) AS emoji_hits, CAST(hype AS BIGINT) AS hype_hits, CAST(vulnerable AS BIGINT) AS vulnerability_hits, CAST(tense AS BIGINT) AS tension_hits,
           entropy AS drift_entropy, drift AS drift_severity, round(CAST(drift AS DOUBLE) + CASE WHEN formula >= 2 THEN 2.5 + least(3.0, formula * 0.6) ELSE 0.0 END
            + CASE WHEN nth >= 4 AND CAST(emoji AS DOUBLE) / nth >= 1.8 AND hype >= 8 AND vulnerable = 0 THEN 2.0 ELSE 0.0 END + CASE WHEN nth >= 5 AND tense = 0 AND vulnerable = 0 THEN 1.4 ELSE 0.0 END + CASE WHEN loops = 1 THEN 1.4 ELSE 0.0 END, 2) AS severity
    FROM v"""


ORACLES["conv_trend_by_turn"] = ORACLES["conv_trend_stream"] = _trend("coalesce(text, '')")
ORACLES["conv_trend_planted"] = _trend(f"coalesce(text, '') || coalesce(' ' || list_extract([{', '.join(map(_q, TREND_PLANTS))}], (conv_id * 5 + turn * 3) % {len(TREND_PLANTS) + 1}), '')")

ORACLES["docs_near_dups_jaccard"] = f"""WITH c AS (
        SELECT doc_id, {_canonical("coalesce(text, '')")} AS t FROM documents
    ), e AS (
        SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS first_id FROM c
    ), g AS (
        SELECT doc_id, length(t) AS len, list_distinct(CASE WHEN length(t) <= 5 THEN [t] ELSE list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5)) END) AS g FROM e WHERE doc_id = first_id AND t <> ''
    ), x AS (
        SELECT doc_id, len, len(g) AS n, unnest(g) AS gram FROM g
    ), p AS (
        SELECT b.doc_id AS b, a.doc_id AS a, CAST(count(*) AS DOUBLE) / (any_value(a.n) + any_value(b.n) - count(*)) AS s
        FROM x a JOIN x b ON a.gram = b.gram AND a.doc_id < b.doc_id AND a.n >= 0.88 * b.n AND b.n >= 0.88 * a.n AND least(a.len, b.len) >= 0.55 * greatest(a.len, b.len)
        GROUP BY ALL HAVING s >= 0.88
    ), best AS (
        SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY b ORDER BY CASE WHEN s >= 0.995 THEN 2.0 ELSE s END DESC, a) = 1
    )
    SELECT e.doc_id, CASE WHEN e.doc_id <> first_id THEN first_id ELSE best.a END AS duplicate_of, CASE WHEN e.doc_id <> first_id THEN 1.0 ELSE round(s, 6) END AS similarity
    FROM e LEFT JOIN best ON best.b = e.first_id WHERE e.doc_id <> first_id OR best.a IS NOT NULL"""

ORACLES["conv_topic_drift_terms"] = ORACLES["conv_topic_drift"]
ORACLES["docs_benchmark_terms"] = f"""WITH lex AS (
        SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_words("coalesce(text, '')")}) AS term FROM benchmark) WHERE length(term) >= 8
    ), w AS (
        SELECT doc_id, unnest({_words("coalesce(text, '')")}) AS term FROM documents
    )
    SELECT doc_id, count(DISTINCT item_id) AS n_items, CAST(count(*) AS BIGINT) AS hits FROM w JOIN lex USING (term) GROUP BY doc_id"""

ORACLES["docs_near_index"] = ORACLES["docs_near_dups_jaccard"]
ORACLES["conv_bucket_table"] = ORACLES["conv_upsert_latest"]

REPLY_LINES = ["go on", "and then?", "how was the rest of it"]
ORACLES["conv_unlike_reply"] = _with(
    f"""SELECT m.conv_id, reply FROM m LEFT JOIN (
            SELECT conv_id, c AS reply FROM cand WHERE c <> '' AND NOT (cc <> '' AND list_contains(old, cc))
            QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY sha256(CAST(conv_id AS VARCHAR) || ':' || c), c) = 1
        ) USING (conv_id)""",
    f"""usr AS (SELECT conv_id, list(content ORDER BY pos) AS us FROM p WHERE role = 'user' GROUP BY conv_id),
    each AS (SELECT m.conv_id, list_transform(coalesce(us, [])[-4:], lambda x: {_compact('x')}) AS old, unnest(list_distinct(list_transform(list_concat(coalesce(us, []), [{', '.join(map(_q, REPLY_LINES))}]), lambda x: {_strip('x')}))) AS c FROM m LEFT JOIN usr USING (conv_id)),
    cand AS (SELECT *, {_compact('c')} AS cc FROM each)""",
)

"""DuckDB oracle SQL for the registered queries (same column names/types)."""

from __future__ import annotations

from ..functions.tagger import TAGS
from ..operators.tfidf import TERM_PATTERN
from ..sources.seed import SEED_FEEDS
from .duck import (V_ARTICLES, V_CALLBACKS, V_CAPTURES, V_ENTRIES, V_FEEDS, V_LOGS, V_VECTORS,
                   clean_lines_sql, host_sql, html_text_sql, jaccard_sql, kept_ctes,
                   lemma_lex_cte, news_title_ctes, polish_sql, q, sentence_ctes,
                   tagged_ctes, tokens_ctes, with_, wordset_ctes)

RECENT_NOW = "TIMESTAMP '2024-01-02 00:00:00'"

ORACLE: dict[str, str] = {}


def _ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


# --- similarity ----------------------------------------------------------------
_SIM_BASE = [
    V_ARTICLES,
    f"art AS (SELECT id, create_time AS ct, title, {host_sql('uri')} AS site FROM articles)",
    lemma_lex_cte(),
    wordset_ctes("art", "id", "title", "ws"),
    "a AS (SELECT art.id, art.ct, art.site, ws.words FROM art JOIN ws USING (id))",
]

_PAIRS = f"""pairs AS (
  SELECT x.id, y.id AS other_id,
         CASE WHEN x.site IS NOT DISTINCT FROM y.site THEN 0.0 ELSE {jaccard_sql('x.words', 'y.words')} END AS score
  FROM a x JOIN a y
    ON y.ct > x.ct - INTERVAL 12 HOUR AND (y.ct < x.ct OR (y.ct = x.ct AND y.id < x.id)))"""

ORACLE["importance"] = with_(*_SIM_BASE, _PAIRS) + """
SELECT a.id, CAST(count(p.score) FILTER (WHERE p.score > 0.3) AS BIGINT) AS importance
FROM a LEFT JOIN pairs p ON p.id = a.id GROUP BY a.id"""

ORACLE["similar_pairs"] = with_(*_SIM_BASE, _PAIRS) + """
SELECT id, other_id, round(score, 6) AS score FROM pairs WHERE score > 0.3"""

ORACLE["title_wordset"] = with_(*_SIM_BASE) + """
SELECT id, CAST(len(words) AS BIGINT) AS n_words, array_to_string(words, ' ') AS words FROM a"""

ORACLE["url_host"] = f"SELECT page_id AS id, {host_sql('url')} AS host FROM pages"

ORACLE["jaccard"] = with_(*_SIM_BASE) + f"""
SELECT x.id, round({jaccard_sql('x.words', 'y.words')}, 6) AS score
FROM a x JOIN a y ON y.id + 1 = x.id"""

_RECENT = [V_ARTICLES, f"recent AS (SELECT id, create_time, title, {host_sql('uri')} AS site FROM articles)"]
_RECENT_OUT = f"SELECT id, {_ts('create_time')} AS create_time, title, site FROM "

ORACLE["recent_window"] = with_(*_RECENT) + _RECENT_OUT + \
    f"recent WHERE create_time > {RECENT_NOW} - INTERVAL 12 HOUR"
ORACLE["recent_evicted"] = with_(*_RECENT) + _RECENT_OUT + \
    f"recent WHERE create_time <= {RECENT_NOW} - INTERVAL 12 HOUR"
ORACLE["recent_insert"] = with_(
    *_RECENT, V_CAPTURES,
    f"win AS (SELECT * FROM recent WHERE create_time > {RECENT_NOW} - INTERVAL 12 HOUR)",
    f"new AS (SELECT c.id, a.create_time, c.title, {host_sql('a.uri')} AS site "
    f"FROM captures c JOIN articles a ON a.id = c.id)",
    "ins AS (SELECT * FROM win UNION ALL SELECT * FROM new WHERE id NOT IN (SELECT id FROM win))",
) + _RECENT_OUT + "ins"


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


# --- ingest ------------------------------------------------------------------------

NOW = "TIMESTAMP '2024-02-01 00:00:00'"
_FEED_OUT = (f"SELECT CAST(id AS BIGINT) AS id, {_ts('last_publish_time')} AS last_publish_time, "
             "uri, name, category, etag, modified, is_aggregator FROM ")

_COUNTS = "ec AS (SELECT feed_id, count(*) AS n FROM entries GROUP BY feed_id)"
_FEED_COUNT_OUT = (f"SELECT CAST(id AS BIGINT) AS id, {_ts('last_publish_time')} AS last_publish_time, "
                   "uri, name, category, etag, modified, is_aggregator, "
                   "CAST(coalesce(ec.n, 0) AS BIGINT) AS n_entries FROM ")

ORACLE["scan_feeds"] = with_(V_FEEDS, V_ENTRIES, _COUNTS) + _FEED_COUNT_OUT + \
    "feeds LEFT JOIN ec ON ec.feed_id = feeds.id"

ORACLE["entry_time"] = with_(V_ENTRIES) + f"""
SELECT entry_pos, CAST(feed_id AS BIGINT) AS feed_id,
       {_ts(f'coalesce(published, updated, {NOW})')} AS publish_time,
       coalesce(published, updated) IS NOT NULL AS dated FROM entries"""

ORACLE["canonical_url"] = with_(V_ENTRIES) + \
    "SELECT entry_pos, regexp_replace(link, '[?#].*', '', 'g') AS uri FROM entries WHERE link IS NOT NULL"

ORACLE["blocklist"] = with_(V_ENTRIES) + \
    "SELECT entry_pos, regexp_matches(link, '^(?:.*/www.youtube.com/.*)') AS blocked FROM entries WHERE link IS NOT NULL"

_NEWS = [V_ENTRIES, lemma_lex_cte(), news_title_ctes("entries", "entry_pos", "title", "news")]
ORACLE["news_title"] = with_(*_NEWS) + "SELECT entry_pos, is_news FROM news"

_ACC = _NEWS + [V_FEEDS, V_ARTICLES, f"""e AS (SELECT entries.*, coalesce(published, updated) IS NOT NULL AS dated,
       coalesce(published, updated, {NOW}) AS publish_time FROM entries)""",
                """c AS (SELECT e.*, regexp_replace(link, '[?#].*', '', 'g') AS uri,
       CASE WHEN f.is_aggregator THEN source_title END AS source
  FROM e JOIN feeds f ON e.feed_id = f.id JOIN news n ON n.entry_pos = e.entry_pos
  WHERE link IS NOT NULL AND (f.last_publish_time IS NULL OR f.last_publish_time < publish_time)
    AND NOT regexp_matches(link, '^(?:.*/www.youtube.com/.*)') AND n.is_news)""",
                """acc AS (SELECT * EXCLUDE (rn) FROM (SELECT c.*, row_number() OVER (
       PARTITION BY feed_id, dated, CASE WHEN dated THEN publish_time END, CASE WHEN NOT dated THEN link END
       ORDER BY entry_pos) AS rn FROM c) WHERE rn = 1)"""]

ORACLE["incremental"] = with_(*_ACC) + f"""
SELECT CAST(feed_id AS BIGINT) AS feed_id, entry_pos, {_ts('publish_time')} AS publish_time, dated FROM acc"""

ORACLE["feed_refresh"] = with_(*_ACC) + """
SELECT CAST(feed_id AS BIGINT) AS feed_id, entry_pos, uri, source, summary FROM acc"""

ORACLE["new_uris"] = with_(*_ACC) + "SELECT DISTINCT uri FROM acc WHERE uri NOT IN (SELECT uri FROM articles)"

ORACLE["known_uris"] = with_(*_ACC) + """
SELECT uri, count(*) AS hits FROM acc WHERE uri IN (SELECT uri FROM articles UNION ALL
  SELECT regexp_replace(link, '[?#].*', '', 'g') FROM entries WHERE coalesce(published, updated) < TIMESTAMP '2024-01-15 00:00:00' AND link IS NOT NULL)
GROUP BY uri"""

_UPSERT = _ACC + ["""acc2 AS (SELECT * FROM acc WHERE dated OR NOT EXISTS (
       SELECT 1 FROM articles a WHERE a.feed_id = acc.feed_id AND a.uri = acc.uri))""",
                  """firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY feed_id, publish_time, entry_pos) AS r,
       count(*) OVER (PARTITION BY uri) AS hits FROM acc2) WHERE r = 1)"""]

ORACLE["article_upsert"] = with_(*_UPSERT) + f"""
SELECT CAST(a.id AS VARCHAR) AS id, {_ts('a.create_time')} AS create_time,
       {_ts(f'CASE WHEN f.uri IS NOT NULL THEN {NOW} ELSE a.update_time END')} AS update_time,
       CAST(a.feed_id AS BIGINT) AS feed_id, a.uri, a.status, CAST(a.retries AS BIGINT) AS retries,
       a.title, a.summary, CAST(a.refs_count + coalesce(f.hits, 0) AS BIGINT) AS refs_count, a.source
FROM articles a LEFT JOIN firsts f USING (uri)
UNION ALL
SELECT md5(f.uri), {_ts(NOW)}, {_ts(NOW)}, CAST(f.feed_id AS BIGINT), f.uri,
       'N', CAST(0 AS BIGINT), NULL, f.summary, CAST(f.hits AS BIGINT), f.source
FROM firsts f WHERE f.uri NOT IN (SELECT uri FROM articles)"""

ORACLE["feed_state"] = with_(*_ACC, """m AS (SELECT feed_id, max(publish_time) AS nm FROM acc WHERE dated GROUP BY feed_id)""",
                             """req AS (SELECT CAST(user_id % 20 AS int) AS feed_id, ts, CASE WHEN event_id % 4 <> 0 THEN 'W/"' || md5(props) || '"' END AS etag,
       CASE WHEN event_id % 4 <> 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS modified FROM events)""",
                             """last_etag AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY ts DESC, etag DESC) AS r FROM req WHERE etag IS NOT NULL) WHERE r = 1)""",
                             """last_mod AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY ts DESC, modified DESC) AS r FROM req WHERE modified IS NOT NULL) WHERE r = 1)""",
                             """fs AS (SELECT f.id, greatest(m.nm, f.last_publish_time) AS last_publish_time, f.uri, f.name, f.category,
       coalesce(last_etag.etag, f.etag) AS etag, coalesce(last_mod.modified, f.modified) AS modified, f.is_aggregator
  FROM feeds f LEFT JOIN m ON m.feed_id = f.id LEFT JOIN last_etag ON last_etag.feed_id = f.id LEFT JOIN last_mod ON last_mod.feed_id = f.id)""") + _FEED_OUT + "fs"


# --- text ----------------------------------------------------------------------------

ORACLE["html_text"] = f"SELECT page_id AS id, {html_text_sql('html')} AS text FROM pages"
ORACLE["html_text_subtrees"] = ORACLE["html_text"]
ORACLE["clean_text"] = f"SELECT doc_id, {clean_lines_sql('text')} AS text FROM documents"
ORACLE["page_clean_text"] = f"SELECT page_id AS id, {clean_lines_sql(html_text_sql('html'))} AS text FROM pages"
ORACLE["sentences"] = with_(sentence_ctes("documents", "doc_id", "text", "ds")) + \
    "SELECT doc_id, CAST(sent AS BIGINT) AS sent, text FROM ds"

_DOC_TOK = [sentence_ctes("documents", "doc_id", "text", "ds"), lemma_lex_cte(),
            tokens_ctes("ds", ["doc_id", "sent"], "text", "ds_tok")]

ORACLE["tokens"] = with_(*_DOC_TOK) + """
SELECT s.doc_id, CAST(s.sent AS BIGINT) AS sent, CAST(count(t.i) AS BIGINT) AS n_tokens,
       coalesce(string_agg(concat_ws('|', t.text, t.ws, t.lemma, t.pos, t.dep, CAST(t.head AS VARCHAR),
                CAST(t.is_stop AS VARCHAR), CAST(t.is_quote AS VARCHAR)), ' ' ORDER BY t.i), '') AS sig
FROM ds s LEFT JOIN ds_tok t ON t.doc_id = s.doc_id AND t.sent = s.sent
GROUP BY s.doc_id, s.sent"""

ORACLE["tagged_tokens"] = "WITH RECURSIVE " + ",\n".join([sentence_ctes("documents", "doc_id", "text", "ds"), tagged_ctes("ds", "tg")]) + f"""
SELECT doc_id, CAST(sent AS BIGINT) AS sent, CAST(len(path) AS BIGINT) AS n_tokens,
       array_to_string(list_transform(path, lambda t: {list(TAGS)}[t + 1]), ' ') AS tags FROM tg"""

ORACLE["relevant_sentences"] = with_(*_DOC_TOK, kept_ctes("ds", "kp")) + \
    "SELECT doc_id, CAST(sent AS BIGINT) AS sent FROM kp_rel"

ORACLE["trim_sentence"] = with_(*_DOC_TOK, kept_ctes("ds", "kp")) + \
    "SELECT doc_id, CAST(sent AS BIGINT) AS sent, CAST(n_tokens AS BIGINT) AS n_tokens, text FROM kp"

ORACLE["content_tokens"] = with_(*_DOC_TOK) + """
SELECT s.doc_id, CAST(s.sent AS BIGINT) AS sent,
       coalesce(string_agg(t.lemma, ' ' ORDER BY t.i) FILTER (
           WHERE NOT t.is_stop AND regexp_matches(t.lemma, '^[A-Za-z]{2,}')), '') AS lemmas
FROM ds s LEFT JOIN ds_tok t ON t.doc_id = s.doc_id AND t.sent = s.sent
GROUP BY s.doc_id, s.sent"""

ORACLE["polish"] = with_(*_DOC_TOK, kept_ctes("ds", "kp")) + \
    f"SELECT doc_id, CAST(sent AS BIGINT) AS sent, {polish_sql('text')} AS text FROM kp"

_PAGE_KEPT = [V_ARTICLES,
              f"pg AS (SELECT id, {clean_lines_sql(html_text_sql('html'))} AS ctext FROM articles "
              "WHERE status = 'D' AND html IS NOT NULL)",
              sentence_ctes("pg", "id", "ctext", "ps"), lemma_lex_cte(),
              tokens_ctes("ps", ["doc_id", "sent"], "text", "ps_tok"), kept_ctes("ps", "pk")]

ORACLE["training_text"] = with_(*_PAGE_KEPT) + """
SELECT pg.id, coalesce(string_agg(t.lemma, ' ' ORDER BY t.sent, t.i) FILTER (
           WHERE NOT t.is_stop AND regexp_matches(t.lemma, '^[A-Za-z]{2,}')), '') AS text
FROM pg LEFT JOIN pk_kt t ON t.doc_id = pg.id GROUP BY pg.id"""

ORACLE["clean_title"] = with_(V_ARTICLES, V_CAPTURES) + \
    "SELECT id, regexp_replace(split_part(title, '|', 1), '\\s+$', '') AS title FROM captures"


# --- tf-idf and summaries -------------------------------------------------------------

_CONTENT = "NOT {a}is_stop AND regexp_matches({a}lemma, '^[A-Za-z]{{2,}}')"
_TERM = q(TERM_PATTERN)

_VOCAB = _PAGE_KEPT + [
    """samp AS (SELECT id FROM articles WHERE status = 'D' AND html IS NOT NULL)""",
    f"""tt AS (SELECT k.doc_id, unnest(regexp_extract_all(lower(k.lemma), {_TERM})) AS term
       FROM pk_kt k JOIN samp ON samp.id = k.doc_id WHERE {_CONTENT.format(a='k.')})""",
    """vocab AS (SELECT term, count(DISTINCT doc_id) AS df,
       ln((1 + (SELECT count(*) FROM samp)) / (1 + count(DISTINCT doc_id))) + 1 AS idf FROM tt GROUP BY term)""",
]
_WEIGHTS = _VOCAB + [
    f"""tf AS (SELECT doc_id, term, count(*) AS tf FROM (
       SELECT k.doc_id, unnest(regexp_extract_all(lower(k.lemma), {_TERM})) AS term
       FROM pk_kt k WHERE {_CONTENT.format(a='k.')}) GROUP BY doc_id, term)""",
    "w0 AS (SELECT tf.doc_id, tf.term, tf.tf * v.idf AS w FROM tf JOIN vocab v USING (term))",
    "wts AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w0)",
]
_FREQ = _WEIGHTS + [
    """num AS (SELECT n.doc_id, n.sent, sum(w.weight) AS num FROM pk_kt n
       JOIN wts w ON w.doc_id = n.doc_id AND w.term = n.lemma WHERE n.pos = 'NOUN' GROUP BY n.doc_id, n.sent)""",
    "den AS (SELECT doc_id, sum(weight) AS den FROM wts GROUP BY doc_id)",
    """freq AS (SELECT s.doc_id, s.sent, coalesce(coalesce(num.num, 0) / nullif(den.den, 0), 0) AS freq
       FROM pk s LEFT JOIN num USING (doc_id, sent) LEFT JOIN den USING (doc_id))""",
]
_SIM = _FREQ + [
    "ttl AS (SELECT id, title FROM articles WHERE status = 'D' AND html IS NOT NULL)",
    tokens_ctes("ttl", ["id"], "title", "ttok"),
    f"tl AS (SELECT id AS doc_id, lemma FROM ttok WHERE {_CONTENT.format(a='')})",
    f"sl AS (SELECT doc_id, sent, lemma FROM pk_kt WHERE {_CONTENT.format(a='')})",
    *V_VECTORS,
    "lw AS (SELECT lemma FROM sl UNION SELECT lemma FROM tl)",
    """og AS (SELECT DISTINCT lemma, substr('<' || lemma || '>', i, 3) AS gram FROM (
       SELECT lemma, unnest(range(1, greatest(length(lemma), 1) + 1)) AS i FROM lw WHERE lemma NOT IN (SELECT token FROM vectors)))""",
    """ov AS (SELECT lemma, k, avg(CAST(x AS DOUBLE)) AS x FROM (
       SELECT og.lemma, unnest(g.vec) AS x, generate_subscripts(g.vec, 1) AS k FROM og JOIN gram_vectors g USING (gram)) GROUP BY lemma, k)""",
    """lv AS (SELECT lw.lemma, list_transform(v.vec, lambda x: CAST(x AS DOUBLE)) AS vec FROM lw JOIN vectors v ON v.token = lw.lemma
       UNION ALL SELECT lemma, list(x ORDER BY k) FROM ov GROUP BY lemma)""",
    """sv AS (SELECT doc_id, sent, k, sum(CAST(x AS DOUBLE)) AS x FROM (
       SELECT sl.doc_id, sl.sent, unnest(lv.vec) AS x, generate_subscripts(lv.vec, 1) AS k
       FROM sl JOIN lv USING (lemma)) GROUP BY doc_id, sent, k)""",
    """svn AS (SELECT sl.doc_id, sl.sent, count(*) AS n_vec FROM sl JOIN lv USING (lemma) GROUP BY sl.doc_id, sl.sent)""",
    """tv AS (SELECT doc_id, k, sum(CAST(x AS DOUBLE)) AS x FROM (
       SELECT tl.doc_id, unnest(lv.vec) AS x, generate_subscripts(lv.vec, 1) AS k
       FROM tl JOIN lv USING (lemma)) GROUP BY doc_id, k)""",
    """cs AS (SELECT sv.doc_id, sv.sent, sum(sv.x * tv.x) AS dot, sqrt(sum(sv.x * sv.x)) AS na,
       sqrt(sum(tv.x * tv.x)) AS nb FROM sv JOIN tv ON tv.doc_id = sv.doc_id AND tv.k = sv.k GROUP BY sv.doc_id, sv.sent)""",
    """sim AS (SELECT s.doc_id, s.sent, CASE WHEN cs.na IS NULL OR cs.na = 0 OR cs.nb = 0 THEN 0.0
       ELSE cs.dot / (cs.na * cs.nb) END AS sim FROM pk s LEFT JOIN cs USING (doc_id, sent))""",
    f"""sc AS (SELECT s.doc_id, s.sent, {polish_sql('s.text')} AS polished, f.freq, m.sim,
       0.1 / (1 + abs(20.0 - s.n_tokens)) AS len,
       f.freq * 0.5 + m.sim * 0.4 + (0.1 / (1 + abs(20.0 - s.n_tokens))) * 0.1 AS total
       FROM pk s JOIN freq f USING (doc_id, sent) JOIN sim m USING (doc_id, sent))""",
    """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, polished
       ORDER BY round(total, 10) DESC, sent) AS r FROM sc WHERE polished IS NOT NULL) WHERE r = 1)""",
    """top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id
       ORDER BY round(total, 10) DESC, sent) AS kk FROM best) WHERE kk <= 4)""",
]

ORACLE["train_sample"] = with_(V_ARTICLES) + """
SELECT id FROM articles WHERE status = 'D' ORDER BY md5(CAST(id AS VARCHAR) || '0'), id LIMIT 15000"""
ORACLE["tfidf_fit"] = with_(*_VOCAB) + "SELECT term, df, round(idf, 6) AS idf FROM vocab"
ORACLE["tfidf_transform"] = with_(*_WEIGHTS) + "SELECT doc_id, term, round(weight, 6) AS weight FROM wts"
ORACLE["sentence_frequency"] = with_(*_FREQ) + \
    "SELECT doc_id, CAST(sent AS BIGINT) AS sent, round(freq, 6) AS freq FROM freq"
ORACLE["mean_vector"] = with_(*_SIM) + """
SELECT v.doc_id, CAST(v.sent AS BIGINT) AS sent, n.n_vec, round(sqrt(sum(v.x * v.x)), 4) AS norm
FROM sv v JOIN svn n USING (doc_id, sent) GROUP BY v.doc_id, v.sent, n.n_vec"""
ORACLE["cosine_to_title"] = with_(*_SIM) + \
    "SELECT doc_id, CAST(sent AS BIGINT) AS sent, round(sim, 6) AS sim FROM sim"
ORACLE["sentence_score"] = with_(*_SIM) + """
SELECT doc_id, CAST(sent AS BIGINT) AS sent, round(freq, 6) AS freq, round(sim, 6) AS sim,
       round(len, 6) AS len, round(total, 6) AS total FROM sc"""
ORACLE["score_threshold"] = with_(*_SIM) + \
    "SELECT doc_id, round(avg(total), 6) AS avg_score FROM sc GROUP BY doc_id"
ORACLE["top_sentences"] = with_(*_SIM) + \
    "SELECT doc_id, CAST(sent AS BIGINT) AS sent, polished AS text FROM top"
ORACLE["summarize"] = with_(*_SIM) + """
SELECT pg.id AS doc_id, CAST(count(t.sent) AS BIGINT) AS n_sentences,
       coalesce(string_agg(t.polished, chr(10) ORDER BY t.sent), '') AS summary
FROM pg LEFT JOIN top t ON t.doc_id = pg.id GROUP BY pg.id"""


# --- publishing, lifecycle, logs, duplicates, seed -------------------------------------

LC_NOW = "TIMESTAMP '2024-01-01 12:00:00'"


def _merge(*lists):
    out, seen = [], set()
    for lst in lists:
        for c in lst:
            if c not in seen:
                seen.add(c)
                out.append(c)
    return out


_seed_rows = ", ".join(
    f"({i + 1}, NULL::TIMESTAMP, {q(u)}, {q(n)}, {q(c)}, NULL::VARCHAR, NULL::VARCHAR, {str(a).lower()})"
    for i, (u, n, c, a) in enumerate(SEED_FEEDS))
ORACLE["seed_feeds"] = with_(
    V_FEEDS,
    f"seed(id, last_publish_time, uri, name, category, etag, modified, is_aggregator) AS (VALUES {_seed_rows})",
    "sf AS (SELECT * FROM feeds UNION ALL SELECT * FROM seed WHERE NOT EXISTS (SELECT 1 FROM feeds))",
    V_ENTRIES, _COUNTS,
) + _FEED_COUNT_OUT + "sf LEFT JOIN ec ON ec.feed_id = sf.id"

ORACLE["article_by_id"] = with_(V_ARTICLES, V_CAPTURES) + \
    "SELECT id, title, html FROM articles WHERE id IN (SELECT id FROM captures)"

ORACLE["display_source"] = with_(V_ARTICLES, V_FEEDS) + """
SELECT a.id, coalesce(a.source, f.name, 'Anonymous') AS display_source
FROM articles a LEFT JOIN feeds f ON f.id = a.feed_id"""

ORACLE["publishable"] = with_(V_ARTICLES) + """
SELECT id, status = 'D' AND html IS NOT NULL AS publishable,
       CASE WHEN NOT (status = 'D' AND html IS NOT NULL)
            THEN 'Article #' || CAST(id AS VARCHAR) || ' not been fetched yet' END AS reason
FROM articles"""

ORACLE["parse_time"] = f"""
SELECT event_id, {_ts("strptime(CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') "
                      "ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END, ['%Y-%m-%dT%H:%M:%S.%f', '%Y-%m-%dT%H:%M:%S'])")} AS ts
FROM events"""

ORACLE["reschedule"] = with_(V_ARTICLES, f"""st AS (SELECT *, status = 'Q' AND update_time < {LC_NOW} - INTERVAL 1 HOUR AS s FROM articles)""") + f"""
SELECT id, CASE WHEN s THEN (CASE WHEN retries + 1 < 3 THEN 'N' ELSE 'E' END) ELSE status END AS status,
       CAST(CASE WHEN s THEN retries + 1 ELSE retries END AS BIGINT) AS retries,
       {_ts(f'CASE WHEN s THEN {LC_NOW} ELSE update_time END')} AS update_time
FROM st"""

ORACLE["claim_next"] = with_(V_ARTICLES) + f"""
SELECT id, uri, 'Q' AS status, {_ts(LC_NOW)} AS update_time FROM articles WHERE status = 'N'
ORDER BY md5(CAST(id AS VARCHAR) || '0'), id LIMIT 5"""

ORACLE["save_content"] = with_(V_ARTICLES, V_CAPTURES) + f"""
SELECT a.id, CASE WHEN c.id IS NOT NULL THEN regexp_replace(split_part(c.title, '|', 1), '\\s+$', '') ELSE a.title END AS title,
       CASE WHEN c.id IS NOT NULL THEN 'D' ELSE a.status END AS status,
       {_ts(f'CASE WHEN c.id IS NOT NULL THEN {NOW} ELSE a.update_time END')} AS update_time,
       md5(CASE WHEN c.id IS NOT NULL THEN c.html ELSE a.html END) AS html_md5
FROM articles a LEFT JOIN captures c ON c.id = a.id"""

ORACLE["log_lines"] = with_(V_LOGS) + """
SELECT event_id, json_extract_string(value, '$.level') AS level,
       '<PageSaver> [' || json_extract_string(value, '$.ts') || '] ' || json_extract_string(value, '$.message') AS line
FROM logs"""

_DUPS = """dd AS (SELECT d.doc_id, m.canonical_id, CAST(octet_length(encode(d.text)) AS BIGINT) AS bytes
  FROM documents d JOIN (SELECT md5(text) AS checksum, min(doc_id) AS canonical_id FROM documents GROUP BY 1) m
    ON m.checksum = md5(d.text) WHERE d.doc_id <> m.canonical_id)"""
ORACLE["duplicate_content"] = with_(_DUPS) + "SELECT * FROM dd"
ORACLE["duplicate_totals"] = with_(_DUPS) + \
    "SELECT count(*) AS n_duplicates, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS duplicate_bytes FROM dd"

_MSG = _merge(_SIM_BASE + [_PAIRS], _SIM, [V_FEEDS, V_CALLBACKS]) + [
    """imp AS (SELECT a.id, count(p.score) FILTER (WHERE p.score > 0.3) AS importance
       FROM a LEFT JOIN pairs p ON p.id = a.id GROUP BY a.id)""",
    """lines AS (SELECT doc_id, string_agg('— ' || polished, chr(10) ORDER BY sent) AS lines FROM top GROUP BY doc_id)""",
    """msg AS (SELECT ar.id AS message_id, imp.importance,
       '<b>' || ar.title || '</b>' || chr(10) || chr(10) || coalesce(l.lines, '') || chr(10) || chr(10)
       || '<a href="' || ar.uri || '"><i>' || coalesce(ar.source, f.name, 'Anonymous') || '</i></a>' AS text
       FROM articles ar JOIN imp ON imp.id = ar.id AND imp.importance > 0
       LEFT JOIN feeds f ON f.id = ar.feed_id LEFT JOIN lines l ON l.doc_id = ar.id
       WHERE ar.status = 'D' AND ar.html IS NOT NULL)""",
]
ORACLE["publish_messages"] = with_(*_MSG) + """
SELECT message_id, CAST(importance AS BIGINT) AS importance, 'public' AS channel, text, CAST(NULL AS VARCHAR) AS button FROM msg"""
ORACLE["route_messages"] = with_(*_MSG) + """
SELECT message_id, 'editors' AS channel, 'Promote ' || repeat('\U0001F525', CAST(importance AS BIGINT)) AS button FROM msg"""
ORACLE["promoted"] = with_(*_MSG) + """
SELECT message_id, 'public' AS channel, text, CAST(NULL AS VARCHAR) AS button FROM msg
WHERE message_id IN (SELECT message_id FROM callbacks WHERE data = 'promote')"""
ORACLE["republish"] = with_(*_MSG) + """
SELECT message_id, 'public' AS channel FROM msg
WHERE message_id NOT IN (SELECT message_id FROM callbacks WHERE data = 'promote')"""

ORACLE["feed_errors"] = with_(V_ENTRIES, V_FEEDS) + """
SELECT CAST(e.feed_id AS BIGINT) AS feed_id, e.entry_pos,
       CASE WHEN f.id IS NULL THEN 'unknown feed' ELSE 'missing link' END AS error
FROM entries e LEFT JOIN feeds f ON f.id = e.feed_id WHERE f.id IS NULL OR e.link IS NULL"""


# --- two refreshes ----------------------------------------------------------------
_CUT = "TIMESTAMP '2024-01-15 00:00:00'"


def _accept(name: str, feeds: str, where: str) -> list[str]:
    """Accepted entries of one refresh (row predicates with the feed marks of
    ``feeds``, then the tie rule) restricted by ``where`` on ``e``."""
    return [f"""{name}_c AS (SELECT e.*, regexp_replace(e.link, '[?#].*', '', 'g') AS uri,
       CASE WHEN f.is_aggregator THEN e.source_title END AS source
  FROM e JOIN {feeds} f ON e.feed_id = f.id JOIN news n ON n.entry_pos = e.entry_pos
  WHERE ({where}) AND e.link IS NOT NULL
    AND (f.last_publish_time IS NULL OR f.last_publish_time < e.publish_time)
    AND NOT regexp_matches(e.link, '^(?:.*/www.youtube.com/.*)') AND n.is_news)""",
            f"""{name} AS (SELECT * EXCLUDE (rn) FROM (SELECT c.*, row_number() OVER (
       PARTITION BY feed_id, dated, CASE WHEN dated THEN publish_time END, CASE WHEN NOT dated THEN link END
       ORDER BY entry_pos) AS rn FROM {name}_c c) WHERE rn = 1)"""]


ORACLE["known_uris_second_pass"] = with_(*_NEWS, V_FEEDS, V_ARTICLES,
    f"""e AS (SELECT entries.*, coalesce(published, updated) IS NOT NULL AS dated,
       coalesce(published, updated, {NOW}) AS publish_time, coalesce(published, updated) AS t FROM entries)""",
    *_accept("acc1", "feeds", f"e.t < {_CUT}"),
    """feeds1 AS (SELECT f.id, greatest(m.nm, f.last_publish_time) AS last_publish_time, f.is_aggregator
       FROM feeds f LEFT JOIN (SELECT feed_id, max(publish_time) AS nm FROM acc1 WHERE dated GROUP BY feed_id) m
       ON m.feed_id = f.id)""",
    "stored1 AS (SELECT uri FROM articles UNION SELECT uri FROM acc1)",
    *_accept("acc2", "feeds1", f"e.t IS NULL OR e.t >= {_CUT}"),
) + "SELECT uri, count(*) AS hits FROM acc2 WHERE uri IN (SELECT uri FROM stored1) GROUP BY uri"


# --- polls in time order, undated entries last --------------------------------------
ORACLE["stream_refresh"] = with_(*_NEWS, V_FEEDS, V_ARTICLES,
    f"""e AS (SELECT entries.*, coalesce(published, updated) IS NOT NULL AS dated,
       coalesce(published, updated, {NOW}) AS publish_time, coalesce(published, updated) AS t FROM entries)""",
    "span AS (SELECT min(epoch(t)::BIGINT) AS lo, (max(epoch(t)::BIGINT) - min(epoch(t)::BIGINT)) // 4 + 1 AS step FROM (SELECT date_trunc('second', t) AS t FROM e))",
    *_accept("acc1", "feeds", "e.t IS NOT NULL"),
    """f1 AS (SELECT * FROM (SELECT acc1.*, row_number() OVER (PARTITION BY uri
       ORDER BY (epoch(date_trunc('second', t))::BIGINT - lo) // step, feed_id, publish_time, entry_pos) AS r FROM acc1, span) WHERE r = 1)""",
    """feeds1 AS (SELECT f.id, greatest(m.nm, f.last_publish_time) AS last_publish_time, f.is_aggregator
       FROM feeds f LEFT JOIN (SELECT feed_id, max(publish_time) AS nm FROM acc1 GROUP BY feed_id) m ON m.feed_id = f.id)""",
    """at1 AS (SELECT feed_id, uri FROM articles UNION ALL SELECT feed_id, uri FROM f1 WHERE uri NOT IN (SELECT uri FROM articles))""",
    *_accept("acc2", "feeds1", "e.t IS NULL"),
    "left2 AS (SELECT * FROM acc2 WHERE NOT EXISTS (SELECT 1 FROM at1 WHERE at1.feed_id = acc2.feed_id AND at1.uri = acc2.uri))",
    "f2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY feed_id, publish_time, entry_pos) AS r FROM left2) WHERE r = 1)",
    "hits AS (SELECT uri, count(*) AS n FROM (SELECT uri FROM acc1 UNION ALL SELECT uri FROM left2) GROUP BY uri)",
    "firsts AS (SELECT uri, feed_id, summary, source FROM f1 UNION ALL SELECT uri, feed_id, summary, source FROM f2 WHERE uri NOT IN (SELECT uri FROM f1))",
) + f"""
SELECT CAST(a.id AS VARCHAR) AS id, {_ts('a.create_time')} AS create_time, {_ts(f'CASE WHEN h.uri IS NOT NULL THEN {NOW} ELSE a.update_time END')} AS update_time,
       CAST(a.feed_id AS BIGINT) AS feed_id, a.uri, a.status, CAST(a.retries AS BIGINT) AS retries, a.title, a.summary,
       CAST(a.refs_count + coalesce(h.n, 0) AS BIGINT) AS refs_count, a.source
FROM articles a LEFT JOIN hits h USING (uri)
UNION ALL
SELECT md5(f.uri), {_ts(NOW)}, {_ts(NOW)}, CAST(f.feed_id AS BIGINT), f.uri, 'N', CAST(0 AS BIGINT), NULL, f.summary, CAST(h.n AS BIGINT), f.source
FROM firsts f JOIN hits h USING (uri) WHERE f.uri NOT IN (SELECT uri FROM articles)"""


# --- streams, outbox, reports -----------------------------------------------------------
ORACLE["stream_logs"] = with_(V_LOGS, """f AS (SELECT CASE WHEN event_id % 97 = 5 THEN substr(value, 1, 20) WHEN event_id % 97 = 6 THEN ''
       WHEN event_id % 97 = 7 THEN regexp_replace(value, '"message":"[^"]*",', '') ELSE value END AS value, event_id % 97 AS k FROM logs)""") + """
SELECT CASE WHEN k IN (5, 6) THEN 'not JSON' WHEN k = 7 THEN 'no message' END AS bad,
       CASE WHEN k IN (5, 6, 7) THEN value ELSE '<PageSaver> [' || json_extract_string(value, '$.ts') || '] ' || json_extract_string(value, '$.message') END AS text,
       count(*) AS n FROM f GROUP BY 1, 2"""
ORACLE["stream_new_uris"] = ORACLE["new_uris"]
ORACLE["stream_interval"] = ORACLE["importance"]
ORACLE["stream_interval_late"] = with_(*_SIM_BASE, _PAIRS) + """
SELECT a.id, CAST(count(p.score) FILTER (WHERE p.score > 0.3 AND p.other_id * 7 % 5 <= p.id * 7 % 5) AS BIGINT) AS importance
FROM a LEFT JOIN pairs p ON p.id = a.id GROUP BY a.id"""
ORACLE["claim_timers"] = with_(V_ARTICLES, """ev AS (SELECT max(happened) AS newest FROM (SELECT update_time AS happened FROM articles
       UNION ALL SELECT update_time + (id % 90) * INTERVAL 1 MINUTE FROM articles WHERE status = 'Q' AND id % 3 = 0))""",
    """st AS (SELECT a.*, status = 'Q' AND update_time + INTERVAL 1 HOUR < newest AND NOT (id % 3 = 0 AND id % 90 <= 60) AS s FROM articles a, ev)""") + f"""
SELECT CAST(id AS VARCHAR) AS id, CASE WHEN s THEN (CASE WHEN retries + 1 < 3 THEN 'N' ELSE 'E' END) ELSE status END AS status,
       CAST(CASE WHEN s THEN retries + 1 ELSE retries END AS BIGINT) AS retries,
       {_ts("CASE WHEN s THEN update_time + INTERVAL 1 HOUR ELSE update_time END")} AS update_time FROM st"""
ORACLE["publish_outbox"] = with_(*_MSG) + """
SELECT CAST(message_id AS VARCHAR) AS message_id, 'public' AS channel, CASE WHEN message_id % 3 = 2 THEN 'pending' ELSE 'sent' END AS state,
       CAST(CASE WHEN message_id % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS attempts, CAST(CASE WHEN message_id % 3 = 2 THEN 0 ELSE 1 END AS BIGINT) AS copies
FROM msg"""
ORACLE["promoted_editors"] = with_(*_MSG) + """
SELECT message_id, 'editors' AS channel, CASE WHEN message_id NOT IN (SELECT message_id FROM callbacks WHERE data = 'promote')
       THEN 'Promote ' || repeat('\U0001F525', CAST(importance AS BIGINT)) END AS button FROM msg"""
ORACLE["article_report"] = with_(*_merge(_SIM, [V_CAPTURES])) + """
SELECT pg.id, ar.title || chr(10) || chr(10) || coalesce(string_agg(t.polished, chr(10) || chr(10) ORDER BY t.sent), '') AS report
FROM pg JOIN articles ar ON ar.id = pg.id LEFT JOIN top t ON t.doc_id = pg.id WHERE pg.id IN (SELECT id + 2 FROM captures) GROUP BY pg.id, ar.title"""
ORACLE["seed_empty"] = with_(f"seed(id, last_publish_time, uri, name, category, etag, modified, is_aggregator) AS (VALUES {_seed_rows})",
                             V_ENTRIES, _COUNTS) + _FEED_COUNT_OUT + "seed LEFT JOIN ec ON ec.feed_id = seed.id"
ORACLE["model_saved"] = ORACLE["tfidf_fit"]

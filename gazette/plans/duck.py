"""SQL text for the DuckDB oracle.

The oracle is written independently of the Spark code path: views are the
SQL of FIXTURES.md, and the annotator is a long-form (one row per token)
window-function formulation, while the Spark side works on nested arrays.
Only the word lists are shared.
"""

from __future__ import annotations

import html.entities

from ..functions import annotate as A
from ..functions import lexicon as L
from ..functions.urls import HOST_PATTERN


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def inlist(words) -> str:
    return "(" + ", ".join(q(w) for w in sorted(set(words))) + ")"


# --- views (FIXTURES.md §2) -------------------------------------------------
V_FEEDS = """feeds AS (
  SELECT CAST(n_nationkey AS int) AS id,
         CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE TIMESTAMP '2024-01-02 00:00:00' END AS last_publish_time,
         concat('http://feed.example/', CAST(n_nationkey AS varchar)) AS uri, n_name AS name,
         concat('R', CAST(n_regionkey AS varchar)) AS category,
         CAST(NULL AS varchar) AS etag, CAST(NULL AS varchar) AS modified,
         n_regionkey = 0 AS is_aggregator
  FROM nation)"""

V_ENTRIES = """entries AS (
  SELECT CAST(user_id % 20 AS int) AS feed_id, event_id AS entry_pos,
         CASE WHEN event_id % 50 = 7 THEN NULL
              WHEN event_type = 'error' THEN concat('https://www.youtube.com/watch?v=', k)
              ELSE concat('http://', event_type, '.example.com/', k, '?u=', CAST(event_id AS varchar)) END AS link,
         CASE WHEN event_id % 9 = 0 THEN concat('How to use item ', k)
              WHEN event_id % 9 = 1 THEN concat('Deal of the day : item ', k)
              WHEN event_id % 9 = 2 THEN NULL
              ELSE concat('Company ', k, ' opens a new office') END AS title,
         props AS summary, CASE WHEN event_id % 3 = 0 THEN 'Wire' END AS source_title,
         CASE WHEN event_id % 10 = 0 THEN NULL ELSE date_trunc('hour', ts) END AS published,
         CASE WHEN event_id % 20 = 0 THEN NULL ELSE ts END AS updated
  FROM (SELECT *, regexp_extract(props, '[0-9]+', 0) AS k FROM events) e)"""

V_ARTICLES = """articles AS (
  SELECT page_id AS id,
         TIMESTAMP '2024-01-01 00:00:00' + page_id * INTERVAL '5' MINUTE AS create_time,
         TIMESTAMP '2024-01-01 00:00:00' + (page_id * 5 + page_id % 180) * INTERVAL '1' MINUTE AS update_time,
         CASE WHEN page_id % 7 = 0 THEN NULL ELSE CAST(page_id % 25 AS int) END AS feed_id,
         url AS uri,
         CASE WHEN page_id % 10 = 0 THEN 'N' WHEN page_id % 10 = 1 THEN 'Q'
              WHEN page_id % 10 = 2 THEN 'E' ELSE 'D' END AS status,
         CAST(page_id % 3 AS int) AS retries,
         regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
         CAST(NULL AS varchar) AS summary,
         CASE WHEN page_id % 13 = 5 THEN NULL ELSE html END AS html,
         1 AS refs_count, CASE WHEN page_id % 11 = 0 THEN 'Wire' END AS source
  FROM pages)"""

V_CAPTURES = """captures AS (
  SELECT id, concat(regexp_extract(p.html, '<title>(.*?)</title>', 1), ' | Site') AS title, p.html
  FROM pages p JOIN articles a ON a.id = p.page_id WHERE a.status = 'Q')"""

V_LOGS = """logs AS (
  SELECT event_id, concat('{"level":"', CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END,
         '","message":"', event_type, '","ts":"', CAST(ts AS varchar), '"}') AS value
  FROM events)"""

V_CALLBACKS = """callbacks AS (
  SELECT user_id AS message_id, CASE WHEN event_type = 'click' THEN 'promote' ELSE event_type END AS data
  FROM events)"""


_MD5 = "('0x' || substr(md5({0}), 1, 8))::BIGINT"

V_VECTORS = [
    "page_words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(html), '[a-z]{2,}')) AS token FROM pages)",
    f"""vectors AS (SELECT token, embedding AS vec FROM page_words
  JOIN embeddings ON vec_id = {_MD5.format('token')} % (SELECT count(*) FROM embeddings) WHERE {_MD5.format('token')} % 8 <> 0)""",
    f"""gram_vectors AS (SELECT gram, embedding AS vec FROM (
    SELECT DISTINCT substr('<' || token || '>', i, 3) AS gram FROM (SELECT token, unnest(range(1, length(token) + 1)) AS i FROM page_words))
  JOIN embeddings ON vec_id = {_MD5.format('gram')} % (SELECT count(*) FROM embeddings))"""]


def host_sql(col: str) -> str:
    return f"nullif(lower(regexp_extract({col}, {q(HOST_PATTERN)}, 2)), '')"


def lemma_lex_cte() -> str:
    rows = ", ".join(f"({q(k)}, {q(v)})" for k, v in sorted(L.LEMMA_MAP.items()))
    return f"lemma_lex(form, lemma) AS (VALUES {rows})"


def pos_case(text: str, low: str) -> str:
    parts = []
    for words, tag in ((L.PRONOUNS, "PRON"), (L.DETERMINERS, "DET"),
                       (L.ADPOSITIONS, "ADP"), (L.CONJUNCTIONS, "CCONJ"),
                       (L.SUBORDINATORS, "SCONJ"), (L.AUXILIARIES, "AUX"),
                       (L.PARTICLES, "PART"), (L.INTERJECTIONS, "INTJ"),
                       (L.ADVERBS, "ADV"), (L.NUMBER_WORDS, "NUM"),
                       (["%"], "NOUN"), (["`"], "PUNCT")):
        parts.append(f"WHEN {low} IN {inlist(words)} THEN '{tag}'")
    verbs = [k for k, v in L.POS_MAP.items() if v == "VERB"]
    parts += [
        f"WHEN {low} IN {inlist(verbs)} THEN 'VERB'",
        f"WHEN regexp_matches({text}, '^\\p{{N}}+$') THEN 'NUM'",
        f"WHEN regexp_matches({text}, '^\\p{{P}}$') THEN 'PUNCT'",
        f"WHEN regexp_matches({text}, '^\\p{{S}}$') THEN 'SYM'",
        f"WHEN regexp_matches({low}, '^\\p{{L}}{{2,}}ly$') THEN 'ADV'",
        f"WHEN regexp_matches({low}, '^\\p{{L}}{{3,}}ed$') THEN 'VERB'",
        f"WHEN regexp_matches({text}, {q('^[' + A.WORD_CLASS + ']+$')}) THEN 'NOUN'",
    ]
    return "CASE " + " ".join(parts) + " ELSE 'X' END"


def tokens_ctes(src: str, keys: list[str], text_expr: str, name: str) -> str:
    """CTEs ending in ``name``(keys..., i, text, ws, lemma, pos, dep, head,
    is_stop, is_quote): one row per token; needs ``lemma_lex_cte()``."""
    k = ", ".join(keys)
    nom = "('NOUN', 'PROPN', 'PRON')"
    return f"""{name}_r AS (SELECT {k}, regexp_extract_all({text_expr}, {q(A.TOKEN_PATTERN)}) AS r FROM {src}),
{name}_u AS (SELECT {k}, unnest(r) AS raw, generate_subscripts(r, 1) - 1 AS i FROM {name}_r),
{name}_t AS (SELECT {k}, i, raw, regexp_replace(raw, {q(A.TRAILING_WS)}, '') AS text FROM {name}_u),
{name}_p AS (SELECT *, lower(text) AS low, substr(raw, length(text) + 1) AS ws,
             {pos_case('text', 'lower(text)')} AS pos FROM {name}_t),
{name}_l AS (SELECT p.*,
             CASE WHEN p.low IN {inlist(L.PRONOUNS)} THEN '-PRON-'
                  WHEN lx.lemma IS NOT NULL THEN lx.lemma
                  WHEN p.pos = 'NOUN' AND regexp_matches(p.low, '^[a-z]{{2,}}ies$') THEN regexp_replace(p.low, 'ies$', 'y')
                  WHEN p.pos = 'NOUN' AND regexp_matches(p.low, '^[a-z]{{2,}}[a-hj-rtv-z]s$') THEN regexp_replace(p.low, 's$', '')
                  ELSE p.low END AS lemma,
             p.low IN {inlist(L.STOP_WORDS)} AS is_stop,
             p.text IN {inlist(L.QUOTES)} AS is_quote
             FROM {name}_p p LEFT JOIN lemma_lex lx ON lx.form = p.low),
{name}_n AS (SELECT *, lead(pos, 1) OVER w AS p1, lead(pos, 2) OVER w AS p2
             FROM {name}_l WINDOW w AS (PARTITION BY {k} ORDER BY i)),
{name} AS (SELECT {k}, i, text, ws, lemma, pos,
  CASE WHEN pos IN {nom} AND p1 = 'VERB' THEN 'nsubj'
       WHEN pos IN {nom} AND p1 IN ('AUX', 'ADV', 'PART') AND p2 = 'VERB' THEN 'nsubj'
       WHEN pos = 'AUX' AND p1 = 'VERB' THEN 'aux'
       WHEN pos = 'AUX' AND p1 IN ('ADV', 'PART') AND p2 = 'VERB' THEN 'aux'
       WHEN pos IN ('VERB', 'AUX') THEN 'ROOT'
       WHEN pos = 'PUNCT' THEN 'punct' ELSE 'dep' END AS dep,
  CAST(CASE WHEN pos IN {nom} AND p1 = 'VERB' THEN i + 1
       WHEN pos IN {nom} AND p1 IN ('AUX', 'ADV', 'PART') AND p2 = 'VERB' THEN i + 2
       WHEN pos = 'AUX' AND p1 = 'VERB' THEN i + 1
       WHEN pos = 'AUX' AND p1 IN ('ADV', 'PART') AND p2 = 'VERB' THEN i + 2
       ELSE i END AS int) AS head,
  is_stop, is_quote FROM {name}_n)"""


def wordset_ctes(src: str, key: str, title_expr: str, name: str) -> str:
    """CTEs ending in ``name``(key, words): sorted distinct content lemmas."""
    return tokens_ctes(src, [key], title_expr, name + "_tok") + f""",
{name}_w AS (SELECT {key}, list_sort(list(DISTINCT lemma)) AS words FROM {name}_tok
             WHERE NOT is_stop AND regexp_matches(lemma, '^[A-Za-z]{{2,}}') GROUP BY {key}),
{name} AS (SELECT s.{key}, coalesce(w.words, []) AS words FROM {src} s LEFT JOIN {name}_w w ON w.{key} = s.{key})"""


def jaccard_sql(a: str, b: str) -> str:
    inter = f"len(list_intersect({a}, {b}))"
    return (f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 "
            f"ELSE {inter} / (len({a}) + len({b}) - {inter}) END")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def news_title_ctes(src: str, key: str, title: str, name: str) -> str:
    """CTEs ending in ``name``(key, is_news) for every row of ``src``."""
    from ..functions.fixed import (TITLE_ANYWHERE_PATTERNS, TITLE_DEAL_LEMMA,
                                   TITLE_DEAL_PATTERNS, TITLE_START_PATTERNS)

    def term(field, value, j):
        col = field if j == 0 else f"{field}{j}"
        return f"{col} = {q(value)}"

    def pat(p):
        return "(" + " AND ".join(term(f, v, j) for j, (f, v) in enumerate(p)) + ")"

    start = " OR ".join(pat(p) for p in TITLE_START_PATTERNS)
    anywhere = " OR ".join(pat(p) for p in TITLE_ANYWHERE_PATTERNS)
    deal = " OR ".join(pat(p) for p in TITLE_DEAL_PATTERNS)
    leads = ", ".join(f"lead({f}, {j}) OVER w AS {f}{j}"
                      for f in ("text", "lemma", "pos") for j in (1, 2, 3))
    return tokens_ctes(src, [key], title, name + "_tok") + f""",
{name}_l AS (SELECT {key}, i, text, lemma, pos, {leads},
             count(*) OVER (PARTITION BY {key}) AS n,
             bool_or(lemma = {q(TITLE_DEAL_LEMMA)}) OVER (PARTITION BY {key}) AS has_deal
             FROM {name}_tok WINDOW w AS (PARTITION BY {key} ORDER BY i)),
{name}_h AS (SELECT {key}, max(n) AS n,
             bool_or(i <= n - 3 AND ((i = 0 AND ({start})) OR {anywhere} OR (has_deal AND ({deal})))) AS blocked
             FROM {name}_l GROUP BY {key}),
{name} AS (SELECT s.{key}, CASE WHEN s.{title} IS NULL THEN true WHEN coalesce(h.n, 0) < 2 THEN false
                  ELSE NOT coalesce(h.blocked, false) END AS is_news
           FROM {src} s LEFT JOIN {name}_h h ON h.{key} = s.{key})"""


SENT_PATTERN = "[^.!?]+[.!?]+"


# Names of the HTML standard's table (Python's copy), as one map.
_NAMES = "MAP {" + ", ".join(f"{q('&' + n)}: {q(c)}" for n, c in html.entities.html5.items()) + "}"
_OLD = "|".join(sorted((n for n in html.entities.html5 if n[-1] != ";"), key=len, reverse=True))
_WIN = "€ ‚ƒ„…†‡ˆ‰Š‹Œ Ž  ‘’“”•–—˜™š›œ žŸ"  # numbers 128 to 159; a blank names none


def html_text_sql(page: str) -> str:
    """Text nodes of a page joined by a blank, references decoded piece by piece (no selectors)."""
    out = page
    for _ in range(2):  # '<' before another one needs a second look
        out = f"regexp_replace({out}, '<([^A-Za-z!?/]|$)', '&lt;\\1', 'g')"
    tag = "</?[A-Za-z][^>=]*(?:=(?:\\s*(?:\"[^\"]*\"|''[^'']*''))?[^>=]*)*>"
    silent = "|".join(f"<{n}\\b(?:.*?</{n}\\s*>|.*)" for n in ("script", "style", "template"))
    nodes = f"regexp_extract_all({out}, '(?is)<!--(?:.*?-->|.*)|{silent}|{tag}|<[!?/][^>]*>|<.*|[^<]+')"
    text = f"array_to_string(list_filter({nodes}, lambda n: n[1] <> '<'), ' ')"
    pieces = f"regexp_extract_all({text}, '&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)|&|[^&]+')"
    code = ("CASE WHEN regexp_matches(p, '^&#[xX]') THEN try_cast('0x' || nullif(ltrim(regexp_extract(p, '[0-9a-fA-F]+'), '0'), '') AS BIGINT) "
            "ELSE try_cast(regexp_extract(p, '[0-9]+') AS BIGINT) END")
    old = f"regexp_extract(p, '^&(?:{_OLD})')"
    char = (f"CASE WHEN coalesce({code}, 0) NOT BETWEEN 1 AND 1114111 OR {code} BETWEEN 55296 AND 57343 THEN chr(65533) "
            f"WHEN {code} BETWEEN 128 AND 159 AND substr({q(_WIN)}, ({code})::INT - 127, 1) <> ' ' THEN substr({q(_WIN)}, ({code})::INT - 127, 1) "
            f"ELSE chr(({code})::INT) END")
    return (f"array_to_string(list_transform({pieces}, lambda p: CASE WHEN p[1] <> '&' OR p = '&' THEN p WHEN p[2] = '#' THEN {char} "
            f"ELSE coalesce(({_NAMES})[p], CASE WHEN {old} <> '' THEN ({_NAMES})[{old}] || substr(p, length({old}) + 1) END, p) END), '')")


def clean_lines_sql(text: str) -> str:
    return (f"array_to_string(list_filter(string_split({text}, chr(10)), "
            f"lambda l: length(l) > 0 AND contains(l, '.')), ' ')")


_WS = r"[\t-\r \x{85}\p{Z}]"  # white space of Unicode


def polish_sql(text: str) -> str:
    bare = f"regexp_replace({text}, '^{_WS}+|{_WS}+$', '', 'g')"
    t = f"(upper(substr({bare}, 1, 1)) || substr({bare}, 2))"
    t = f"regexp_replace({t}, '{_WS}+([,!.])', '\\1', 'g')"
    t = f"regexp_replace({t}, '{_WS}{_WS}+', ' ', 'g')"
    return (f"CASE WHEN length({bare}) = 0 THEN NULL "
            f"WHEN ends_with({t}, '.') THEN {t} ELSE {t} || '.' END")


def sentence_ctes(src: str, key: str, text_expr: str, name: str) -> str:
    """``name``(doc_id, sent, text): one row per sentence span."""
    return f"""{name}_r AS (SELECT {key} AS doc_id, regexp_extract_all({text_expr}, {q(SENT_PATTERN)}) AS r FROM {src}),
{name} AS (SELECT doc_id, unnest(r) AS text, generate_subscripts(r, 1) - 1 AS sent FROM {name}_r)"""


def kept_ctes(sents: str, name: str) -> str:
    """Relevance, trimming and span text in long form.

    Needs ``sents``(doc_id, sent, text) and its tokens ``{sents}_tok``. Ends in
    ``name``(doc_id, sent, text, n_tokens) and ``{name}_kt`` (kept tokens).
    """
    from ..functions.fixed import (AUX_DEPS, DROP_LEMMA_PREFIXES, DROP_LEMMA_SUFFIXES,
                                   DROP_POS_PREFIXES, SUBJECT_DEPS)
    tok = f"{sents}_tok"

    def lst(p):
        return "[" + ", ".join(q(x) for x in p) + "]"

    lem_pre = " ".join(f"WHEN lems[1:{len(p)}] = {lst(p)} THEN {len(p)}" for p in DROP_LEMMA_PREFIXES)
    pos_pre = " ".join(f"WHEN poss[1:{len(p)}] = {lst(p)} THEN {len(p)}" for p in DROP_POS_PREFIXES)
    suffix_cols = []
    for k, p in enumerate(DROP_LEMMA_SUFFIXES):
        cond = " AND ".join(("lemma" if j == 0 else f"lead(lemma, {j}) OVER w") + f" = {q(v)}"
                            for j, v in enumerate(p))
        suffix_cols.append(f"CASE WHEN {cond} THEN i END AS sfx{k}")
    sfx_min = ", ".join(f"min(sfx{k}) AS m{k}" for k in range(len(DROP_LEMMA_SUFFIXES)))
    sfx_pick = "coalesce(" + ", ".join(f"m{k}" for k in range(len(DROP_LEMMA_SUFFIXES))) + ")"
    return f"""{name}_rel AS (
  SELECT DISTINCT c.doc_id, c.sent FROM {tok} c JOIN {tok} v
    ON v.doc_id = c.doc_id AND v.sent = c.sent AND v.i = c.head
  JOIN {sents} s ON s.doc_id = c.doc_id AND s.sent = c.sent
  WHERE c.dep IN {inlist(SUBJECT_DEPS)} AND c.i < c.head AND v.pos = 'VERB'
    AND v.dep NOT IN {inlist(AUX_DEPS)} AND ends_with(regexp_replace(s.text, '{_WS}+$', ''), '.')),
{name}_agg AS (
  SELECT t.doc_id, t.sent, count(*) AS n,
         coalesce(min(t.i) FILTER (WHERE t.pos <> 'PUNCT' OR t.is_quote), count(*)) AS lead_punct,
         list(t.lemma ORDER BY t.i) AS lems, list(t.pos ORDER BY t.i) AS poss
  FROM {tok} t JOIN {name}_rel USING (doc_id, sent) GROUP BY t.doc_id, t.sent),
{name}_sfx AS (
  SELECT doc_id, sent, {sfx_min} FROM (
    SELECT t.doc_id, t.sent, {", ".join(suffix_cols)}
    FROM {tok} t JOIN {name}_rel USING (doc_id, sent)
    WINDOW w AS (PARTITION BY t.doc_id, t.sent ORDER BY t.i)) GROUP BY doc_id, sent),
{name}_cut AS (
  SELECT a.doc_id, a.sent,
         a.lead_punct + (CASE {lem_pre} ELSE 0 END) + (CASE {pos_pre} ELSE 0 END) AS cut,
         {sfx_pick} AS idx
  FROM {name}_agg a JOIN {name}_sfx USING (doc_id, sent)),
{name}_kt AS (
  SELECT t.* FROM {tok} t JOIN {name}_cut c USING (doc_id, sent)
  WHERE t.i >= c.cut AND (c.idx IS NULL OR t.i < c.cut + c.idx)),
{name} AS (
  SELECT doc_id, sent, count(*) AS n_tokens,
         string_agg(text || CASE WHEN is_last THEN '' ELSE ws END, '' ORDER BY i) AS text
  FROM (SELECT *, i = max(i) OVER (PARTITION BY doc_id, sent) AS is_last FROM {name}_kt)
  GROUP BY doc_id, sent)"""


def tagged_ctes(sents: str, name: str) -> str:
    """``name``(doc_id, sent, path): the cheapest tags of each sentence, position by position.

    Long form: one row per (sentence, position, candidate tag), extended by a recursive join
    that keeps the cheapest way to each candidate. Lists and costs are the tagger's tables.
    """
    from ..functions import tagger as G
    word = "[" + A.WORD_CLASS + "]"
    lists = " ".join(f"WHEN low IN {inlist(w)} THEN {q(k)}" for k, w in G.LISTS.items())
    shapes = " ".join(f"WHEN {c} THEN {q(k)}" for c, k in (
        ("regexp_matches(text, '^\\p{N}+$')", "number"),
        ("regexp_matches(text, '^\\p{P}$')", "punctuation"),
        ("regexp_matches(text, '^\\p{S}$')", "symbol"),
        (f"length(text) = 1 AND regexp_matches(text, {q('^' + word + '$')})", "noun"),
        ("length(text) = 1", "other"),
        ("capital AND i > first_word", "capital_inside"),
        ("regexp_matches(low, '^\\p{L}{2,}ly$')", "ly"),
        ("regexp_matches(low, '^\\p{L}{3,}ed$')", "ed"),
        ("regexp_matches(low, '^\\p{L}{3,}ing$')", "ing"),
        (f"regexp_matches(low, {q(G.ADJECTIVE_SUFFIXES)})", "adjectival"),
        ("capital AND plural", "capital_plural"),
        ("capital", "capital_first"),
        ("plural", "plural")))
    number = {t: k for k, t in enumerate(G.TAGS)}
    options = ", ".join(f"({q(k)}, {number[t]}, {c})" for k, tags in G.CANDIDATES.items() for t, c in tags.items())
    moves = ", ".join(f"({-1 if a == 'START' else number[a]}, {number[b]}, {G.cost(a, b)})"
                      for a in (*G.TAGS, "START") for b in G.TAGS)
    return f"""{name}_r AS (SELECT doc_id, sent, regexp_extract_all(text, {q(A.BARE_TOKEN_PATTERN)}) AS r FROM {sents}),
{name}_u AS (SELECT doc_id, sent, unnest(r) AS text, generate_subscripts(r, 1) - 1 AS i FROM {name}_r),
{name}_w AS (SELECT *, lower(text) AS low, regexp_matches(text, '^\\p{{Lu}}') AS capital,
       regexp_matches(lower(text), '^\\p{{L}}{{2,}}[^s\\P{{L}}]s$') AS plural,
       coalesce(min(CASE WHEN regexp_matches(text, {q('^' + word)}) THEN i END) OVER (PARTITION BY doc_id, sent), -1) AS first_word
  FROM {name}_u),
{name}_options(cls, t, c) AS (VALUES {options}),
{name}_moves(a, b, cost) AS (VALUES {moves}),
{name}_c AS MATERIALIZED (SELECT doc_id, sent, i, t, c FROM
  (SELECT doc_id, sent, i, CASE {lists} {shapes} ELSE 'lower' END AS cls FROM {name}_w) JOIN {name}_options USING (cls)),
{name}_v AS (
  SELECT doc_id, sent, i, t, (cost + c)::BIGINT AS cost, [t] AS path FROM {name}_c JOIN {name}_moves ON a = -1 AND b = t WHERE i = 0
  UNION ALL
  SELECT doc_id, sent, i, t, cost, path FROM (
    SELECT n.doc_id, n.sent, n.i, n.t, (v.cost + m.cost + n.c)::BIGINT AS cost, list_append(v.path, n.t) AS path,
           row_number() OVER (PARTITION BY n.doc_id, n.sent, n.t ORDER BY v.cost + m.cost, v.t) AS r
    FROM {name}_v v JOIN {name}_c n ON n.doc_id = v.doc_id AND n.sent = v.sent AND n.i = v.i + 1
    JOIN {name}_moves m ON m.a = v.t AND m.b = n.t) WHERE r = 1),
{name} AS (SELECT doc_id, sent, path FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, sent ORDER BY i DESC, cost, t) AS r FROM {name}_v) WHERE r = 1)"""

"""Host-level quality rules: a document's own rules, and a verdict on the host it comes from.

Every document gets counts from its whole text. Base rules (too few words, too
much repeated text) reject it by themselves. Soft rules (symbols, repeated
lines, odd word lengths) only mark it. The host's failures (documents that fail
any rule) are summed per host; its failure rate is shrunk towards all hosts'
rates with a beta prior fitted by moments, so that a host with three documents
is not judged on them alone. A host whose shrunk rate exceeds `max_rate` is
strict: its marked documents go too. Clean documents stay, whatever their host.

Defined cases: null or empty text has no words and fails the base rule; a null
host is a host of its own; repeated rows count as often as they occur; an empty
table gives an empty result; other columns pass through, and a clash with the
counts' column gets another name.

Scale: one pass over the text. Per-host sums combine on the map side, so a host
with a third of all rows costs one row a task. Counts, without texts, meet the hosts'
rates by a join; where rows keep their texts (`keep_good`), only marked documents
meet the strict hosts.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.operators.common import broadcast_if_bytes
from gazette.llm.util import WORD, free_name, load, python_column, written

#: Base rules (fixed values): least words, largest percentage of words in repeated windows.
MIN_WORDS, MAX_REPEAT = 50, 50
#: Soft rules: symbols per 100 words, repeated lines per 100 lines, mean word length.
MAX_SYMBOLS, MAX_DUP_LINES, MIN_MEAN, MAX_MEAN = 10, 30, 2, 15
#: Hosts above this shrunk failure rate are strict; the prior weighs 1 to MAX_PRIOR documents.
MAX_RATE, MAX_PRIOR = 0.5, 1000.0
_WORDS = re.compile(WORD)
_SYMBOLS = re.compile(r"[#*$%&|<>]")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def repeated_words(words: list[str]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    if len(words) < 3:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    pair = np.unique(ids[:-2] * len(number) + ids[1:-1], return_inverse=True)[1]
    _, window, times = np.unique(pair * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = times[window] > 1
    held = np.zeros(len(words), bool)
    for k in range(3):
        held[k:len(words) - 2 + k] |= again
    return int(held.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of a text; null counts as empty."""
    text = text or ""
    words = _WORDS.findall(text)
    lines = [x for x in text.split("\n") if _WORDS.search(x)]
    return (len(words), sum(map(len, words)), len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)),
            repeated_words(words), len(lines))


def with_counts(docs: DataFrame, text: str = "text", name: str = "counts") -> DataFrame:
    """`docs` with a struct of COUNTS."""
    fields = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    return python_column(docs, [text], name, fields,
                         lambda b: dict(zip(COUNTS, zip(*map(text_counts, b.column(0).to_pylist())))) if b.num_rows else {c: [] for c in COUNTS})


def base_failed(c: str):
    return (F.col(f"{c}.n_words") < MIN_WORDS) | (100 * F.col(f"{c}.n_repeat_words") > MAX_REPEAT * F.col(f"{c}.n_words"))


def soft_failed(c: str):
    n, mean = F.col(f"{c}.n_words"), F.col(f"{c}.word_chars")
    return ((100 * F.col(f"{c}.n_symbols") > MAX_SYMBOLS * n) | (100 * F.col(f"{c}.n_dup_lines") > MAX_DUP_LINES * F.col(f"{c}.n_lines"))
            | (mean < MIN_MEAN * n) | (mean > MAX_MEAN * n))


def host_rates(counted: DataFrame, host: str, counts: str) -> DataFrame:
    """(host, docs, failed, rate): each host's failure rate, shrunk with the beta prior of all hosts."""
    hosts = counted.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("docs"), F.sum((base_failed(counts) | soft_failed(counts)).cast("long")).alias("failed"))
    rate = F.col("failed") / F.col("docs")
    prior = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("var"))
    weight = F.when(F.col("var") > 0, F.least(F.greatest(F.col("mean") * (1 - F.col("mean")) / F.col("var") - 1, F.lit(1.0)), F.lit(MAX_PRIOR))) \
        .otherwise(F.lit(MAX_PRIOR))
    # one row of two numbers
    return hosts.join(F.broadcast(prior.select("mean", weight.alias("weight"))), F.lit(True)).select(
        "host", "docs", "failed", ((F.col("failed") + F.col("mean") * F.col("weight")) / (F.col("docs") + F.col("weight"))).alias("rate"))


def judged(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_RATE) -> tuple[DataFrame, str]:
    """`docs` with a struct (COUNTS, base_failed, soft_failed, host_rate, host_strict, kept); and that column's name.

    Written once in the shared folder, as counts and verdicts both need it.
    """
    c = free_name(docs, "rules")
    counted = written(with_counts(docs, text, c), "rules")
    own = free_name(counted, "host_verdict")
    hosts = host_rates(counted, host, c).select("host", F.struct("rate", (F.col("rate") > max_rate).alias("strict")).alias(own))
    joined = counted.join(hosts, F.col(host).eqNullSafe(F.col("host")), "left") if "host" not in docs.columns else \
        counted.join(hosts.withColumnRenamed("host", own + "_key"), F.col(host).eqNullSafe(F.col(own + "_key")), "left")
    verdict = F.struct(f"{c}.*", base_failed(c).alias("base_failed"), soft_failed(c).alias("soft_failed"),
                       F.col(f"{own}.rate").alias("host_rate"), F.col(f"{own}.strict").alias("host_strict"),
                       (~base_failed(c) & ~(F.col(f"{own}.strict") & soft_failed(c))).alias("kept"))
    return joined.select(*[F.col(f"`{x}`") for x in docs.columns], verdict.alias(c)), c


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """The rows of `docs` that no rule rejects, with the columns they came with.

    Only marked documents meet the strict hosts, which are broadcast if their bytes
    are few; the others are not joined at all."""
    c = free_name(docs, "rules")
    counted = written(with_counts(docs, text, c), "rules")
    key = free_name(counted, "strict_host")
    strict = written(host_rates(counted, host, c).where(F.col("rate") > max_rate).select(F.col("host").alias(key)), "strict-hosts")
    good = counted.where(~base_failed(c))
    marked = good.where(soft_failed(c)).join(broadcast_if_bytes(strict), F.col(host).eqNullSafe(F.col(key)), "left_anti")
    return good.where(~soft_failed(c)).unionByName(marked).drop(c)


def op2_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: counts and verdicts of every document."""
    out, c = judged(load(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", *[f"{c}.{x}" for x in COUNTS[:5]], f"{c}.base_failed", f"{c}.kept",
                      F.round(f"{c}.host_rate", 6).alias("host_rate"))


ORACLE_SQL = rf"""
WITH w AS (
  SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols
  FROM documents),
pos AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS times FROM pos),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win WHERE times > 1) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, source, len(words) AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars, n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(lines) AS n_lines
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
f AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed,
         100 * n_symbols > {MAX_SYMBOLS} * n_words OR 100 * n_dup_lines > {MAX_DUP_LINES} * n_lines
         OR word_chars < {MIN_MEAN} * n_words OR word_chars > {MAX_MEAN} * n_words AS soft_failed
  FROM c),
h AS (SELECT source, count(*) AS docs, count(*) FILTER (base_failed OR soft_failed) AS failed FROM f GROUP BY source),
m AS (SELECT avg(failed / docs) AS mean, var_pop(failed / docs) AS var FROM h),
p AS (SELECT mean, CASE WHEN var > 0 THEN least(greatest(mean * (1 - mean) / var - 1, 1.0), {MAX_PRIOR}) ELSE {MAX_PRIOR} END AS weight FROM m),
r AS (SELECT source, (failed + mean * weight) / (docs + weight) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (rate > {MAX_RATE} AND soft_failed) AS kept, round(rate, 6) AS host_rate
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source
"""

"""URL filter: host and path rules, and a logistic regression for the URLs no rule fits.

Features are character 3- to 5-grams of the host and of the path, marked by
part, hashed into 2**BITS weights, with counts scaled to unit length. The model
is fitted on a small table of labelled URLs by full-batch gradient steps, which
makes it the same for the same rows. The registered query takes the labels from
the rules themselves: URLs that a rule allows or blocks, TRAIN_ROWS of them at
most, chosen by a hash of the URL (a documented bound on training alone; every
URL is judged).

Defined cases: a null URL, or one without ://, has an empty host and path and
goes to the model's bias; repeated rows are judged alike; an empty table gives
an empty result; with labels of one kind only, that kind is every verdict, and
without labels it is allow.

Scale: row by row, no shuffle but the top TRAIN_ROWS by hash. The weights are
2**BITS floats, whatever the input.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.llm.util import load, python_column, written

#: Rules (fixed values): verdict, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
BITS, GRAMS, TRAIN_ROWS = 16, (3, 4, 5), 20_000
STEPS, RATE, DECAY = 200, 4.0, 1e-4
_URL = re.compile(r"[\s\S]*?://([^/?#]*)([^?#]*)")
_UPPER = {i: i + 32 for i in range(65, 91)}


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    m = _URL.match(url or "")
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


def rule_for(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits; equal lengths: the first listed."""
    fit = [(h + p, v) for v, h, p in rules if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
    return max(fit, key=lambda r: len(r[0])) if fit else None


def features(host: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Weight numbers of the URL's n-grams, and their values."""
    grams = []
    for mark, s in (("h", f"^{host}$"), ("p", f"^{path}$")):
        raw = s.encode("utf-8", "surrogatepass")
        grams += [zlib.crc32(raw[i:i + n], ord(mark)) for n in GRAMS for i in range(len(raw) - n + 1)]
    at, n = np.unique(np.array(grams, np.int64) % (1 << BITS), return_counts=True)
    return at, n / np.sqrt(float((n * n).sum()) or 1.0)


def fit(rows: list[tuple[str, str, int]]) -> tuple[np.ndarray, float]:
    """Weights and bias from (host, path, 1 for allow or 0 for block)."""
    w, y = np.zeros(1 << BITS), np.array([r[2] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return w, 1.0 if not len(y) or y[0] else -1.0
    feats = [features(h, p) for h, p, _ in rows]
    at, val = np.concatenate([a for a, _ in feats]), np.concatenate([v for _, v in feats])
    row = np.repeat(np.arange(len(rows)), [len(a) for a, _ in feats])
    bias = 0.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[at] * val, len(rows)) + bias)))
        g = (p - y) / len(rows)
        w -= RATE * (np.bincount(at, g[row] * val, 1 << BITS) + DECAY * w)
        bias -= RATE * g.sum()
    return w, bias


def train(urls: DataFrame, url: str = "url", label: str = "label", limit: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Fit on at most `limit` distinct labelled URLs (label 1 allow, 0 block, null unused), those of smallest hash.

    Of more URLs only those below a cut of the hash, sized for a tenth more than
    `limit`, are grouped and sorted, so neither the shuffle nor the driver grows
    with the table."""
    rows = urls.where(F.col(label).isNotNull() & F.col(url).isNotNull()).select(F.col(url).alias("url"), F.col(label).cast("int").alias("label"))
    n = rows.agg(F.approx_count_distinct("url", 0.02)).first()[0]
    share, few = 1.1 * limit / max(n, 1), rows
    while share < 1:
        few = rows.where(F.xxhash64("url") < int(-(1 << 63) + share * (1 << 64)))
        few = written(few.groupBy("url").agg(F.max("label").alias("label")), "labelled-urls")
        if few.count() >= limit:
            break
        share, few = 2 * share, rows  # the count was too high an estimate
    got = few.groupBy("url").agg(F.max("label").alias("label")).orderBy(F.xxhash64("url"), "url").limit(limit).collect()
    return fit([(*parts(r["url"]), r["label"]) for r in got])


def judge(urls: DataFrame, model: tuple[np.ndarray, float], url: str = "url", name: str = "judged", rules=RULES) -> DataFrame:
    """`urls` with a struct (host, path, rule, verdict, score): the rule's verdict, else the model's."""
    w, bias = model

    def verdicts(b: pa.RecordBatch) -> dict:
        out = []
        for u in b.column(0).to_pylist():
            host, path = parts(u)
            rule = rule_for(host, path, rules)
            at, val = features(host, path)
            p = float(1 / (1 + np.exp(-(w[at] @ val + bias))))
            out.append((host, path, rule[0] if rule else None, rule[1] if rule else "allow" if p >= 0.5 else "block", p))
        return dict(zip([f.name for f in fields], zip(*out) if out else [[]] * 5))

    fields = T.StructType([T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")] + [T.StructField("score", T.DoubleType())])
    return python_column(urls, [url], name, fields, verdicts)


def rule_labels(urls: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """(url, label) by the rules alone, with SQL functions; label null where none fits."""
    host = F.translate(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)
    label = F.lit(None).cast("int")
    for v, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("h") == h) | F.col("h").endswith(f".{h}")) & F.col("p").startswith(p)
        label = F.when(fits, F.lit(int(v == "allow"))).otherwise(label)
    return urls.select(F.col(url).alias("url"), host.alias("h"), path.alias("p")).select("url", label.alias("label"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: host, path, rule and verdict of every page."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    model = train(rule_labels(pages))
    return judge(pages, model).select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict",
                                      F.round("judged.score", 6).alias("score"))

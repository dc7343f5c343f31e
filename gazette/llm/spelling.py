"""Spelling variants: vocabulary acceptor, one-edit transducer, vocabulary acceptor again.

Words are maximal runs of letters. Two words are near if one inserted, deleted or
replaced code point turns one into the other. All near pairs are what the
composition A o E1 o A accepts, A being the minimal acceptor of the vocabulary and
E1 a transducer of two states (before and after its one edit). Before the edit
both copies of A stand in the same state, so the composition falls apart by the
state in which the edit may begin: an initial-state partition holds the words that
agree outside a window of positions [lo, hi), and an edit belongs to the window
of the first position at which the two words differ. Every pair lies in exactly
one partition: `length` (of the shorter word), window, prefix up to lo, and the
code points after hi.

In a partition the words' middles become minimal acceptors with shared states
(equal right languages are one state, over all partitions of a task). States carry
the number of words they accept, so a pair of paths is a pair of ranks. What the
composition accepts from a state, or from two, is computed once.

Each word starts with two windows (its halves). A partition of more than
MAX_GROUP words is split: its window is halved, again and again, until it is small
or one position wide, where it holds one word for each letter at most. Nothing is
capped: the split is exact.

Defined cases: null text has no words; a null doc_id counts as the empty string in
the hash; repeated rows count as often as they occur; among near words of equal n
the smallest in code-point order is the form; an empty table gives an empty
result; very long words are words like others.

Scale: counting words combines in the task and in the shuffle. Near words come
back per (partition, word) as a count and the best one, never as pairs. Forms
point to words ten times as frequent, so chains have 19 links at most, and
pointer doubling ends in five rounds.
"""

from __future__ import annotations

import collections
import re
import sys
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.util import load, small_batches, written

#: A run of letters; one in EVERY (by hash) loses a code point (fixed values).
RUN, EVERY = re.compile("[A-Za-zÀ-ÿ]+"), 31
MIN_LENGTH, MIN_COUNT, FACTOR = 7, 2, 10
#: Words of a partition beyond which its window is halved; memory bounds of a task (words counted, states kept).
MAX_GROUP, MAX_COUNTED, MAX_STATES = 20_000, 300_000, 500_000
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(doc_id: str | None, text: str | None) -> dict[str, int]:
    """Words of a text and how often each occurs, after the hash has dropped code points."""
    out: dict[str, int] = {}
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in collections.Counter(RUN.findall((text or "").translate(_LOWER))).items():
        if len(run) < MIN_LENGTH:
            continue
        h = zlib.crc32(run.encode(), seed)
        if h % EVERY == 0:
            i = h % len(run)
            run = run[:i] + run[i + 1:]
            if len(run) < MIN_LENGTH:
                continue
        out[run] = out.get(run, 0) + n
    return out


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of all words that occur `min_count` times or more."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def table():
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w, n in words_of(d, t).items():
                    total[w] = total.get(w, 0) + n
                if len(total) > MAX_COUNTED:
                    yield table()
                    total = {}
        yield table()

    counted = docs.select(F.col(doc_id).cast("string").alias("d"), F.col(text).alias("t")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Composition:
    """Minimal acceptors with shared states, and what A o E1 o A accepts from them.

    A state is a number; 0 accepts the empty word alone. All words of a state
    have one length. A word is known by its rank among its state's words.
    """

    def __init__(self):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))  # depth is a word's length; frames of Python functions take no C stack
        self.register: dict[tuple, int] = {}
        self.arcs: list[tuple] = [()]
        self.size = [1]
        self.both: dict[tuple[int, int], list] = {}
        self.swapped: dict[int, list] = {0: []}
        self.longer: dict[tuple[int, int], list] = {}

    def state(self, words: list[str], a: int, b: int, at: int = 0) -> int:
        """The state that accepts words[a:b] (sorted, distinct, of one length) from position `at`."""
        if at == len(words[a]):
            return 0
        out, i, rank = [], a, 0
        while i < b:
            c, j = words[i][at], i + 1
            while j < b and words[j][at] == c:
                j += 1
            to = self.state(words, i, j, at + 1)
            out.append((c, to, rank))
            rank += self.size[to]
            i = j
        key = tuple(out)
        s = self.register.get(key)
        if s is None:
            s = self.register[key] = len(self.arcs)
            self.arcs.append(key)
            self.size.append(rank)
        return s

    def common(self, s: int, t: int) -> list[tuple[int, int]]:
        """Ranks (in s, in t) of the words that both accept: the composition after its edit."""
        if s == t:
            return [(i, i) for i in range(self.size[s])]
        got = self.both.get((s, t))
        if got is None:
            other = {c: (b, o) for c, b, o in self.arcs[t]}
            got = []
            for c, a, o in self.arcs[s]:
                if c in other:
                    b, p = other[c]
                    got += [(i + o, j + p) for i, j in self.common(a, b)]
            self.both[s, t] = got
        return got

    def replaced(self, s: int) -> list[tuple[int, int]]:
        """Pairs of words of s that differ in one code point."""
        got = self.swapped.get(s)
        if got is None:
            arcs, got = self.arcs[s], []
            for k, (_, a, o) in enumerate(arcs):
                got += [(i + o, j + o) for i, j in self.replaced(a)]
                for _, b, p in arcs[k + 1:]:
                    got += [(i + o, j + p) for i, j in self.common(a, b)]
            self.swapped[s] = got
        return got

    def inserted(self, s: int, t: int) -> list[tuple[int, int]]:
        """Pairs (word of s, word of t) where the latter has one more code point, at the first place where they differ."""
        got = self.longer.get((s, t))
        if got is None:
            mine, other = self.arcs[s], {c: (b, o) for c, b, o in self.arcs[t]}
            got = []
            if not s:
                got = [(0, o) for _, _, o in self.arcs[t]]
            for c, a, o in mine:
                if c in other:
                    b, p = other[c]
                    got += [(i + o, j + p) for i, j in self.inserted(a, b)]
            for d, b, p in self.arcs[t]:
                after = {c: (x, r) for c, x, r in self.arcs[b]}
                for c, a, o in mine:
                    if c != d and c in after:
                        x, r = after[c]
                        got += [(i + o, j + p + r) for i, j in self.common(a, x)]
            self.longer[s, t] = got
        return got


def near_pairs(group: list[str], length: int, lo: int, hi: int, c: Composition | None = None) -> Iterator[tuple[str, str]]:
    """Pairs of the words of one partition (`length` or one more code points) whose first difference lies in [lo, hi)."""
    c = c or Composition()
    kept = max(length - hi, 0)
    sides = []
    for n in (length, length + 1):
        words = sorted({w for w in group if len(w) == n}, key=lambda w: w[lo:n - kept])
        sides.append((words, [w[lo:n - kept] for w in words]))
    (short, s), (long, t) = sides
    if not s:
        return
    root = c.state(s, 0, len(s))
    for i, j in c.replaced(root):
        yield short[i], short[j]
    if t:
        for i, j in c.inserted(root, c.state(t, 0, len(t))):
            # a code point put in after the whole middle differs at hi first: the next window's pair
            if hi > length or not t[j].startswith(s[i]):
                yield short[i], long[j]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, word, n) rows ordered by key -> (word, n_near, best) for every partition."""
    names = ["word", "n_near", "best_n", "best"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    c, key, group, out = Composition(), None, {}, []

    def close():
        nonlocal c
        if len(group) < 2:
            return
        if len(c.arcs) + len(c.both) + len(c.longer) > MAX_STATES:
            c = Composition()
        length, lo, hi = map(int, key.split("|", 3)[:3])
        near: dict[str, list] = {}
        for pair in near_pairs(list(group), length, lo, hi, c):
            for u, v in (pair, pair[::-1]):
                n, best = near.get(u, (0, None))
                near[u] = [n + 1, min(best, (-group[v], v)) if best else (-group[v], v)]
        out.extend((u, n, -b[0], b[1]) for u, (n, b) in near.items())

    def table():
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names=names)

    for b in batches:
        for k, w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if k != key:
                close()
                key, group = k, {}
            group[w] = n
        if out:
            yield table()
            out = []
    close()
    yield table()


def _key():
    """The initial-state partition of `word` for (length, lo, hi)."""
    return F.expr("concat_ws('|', length, lo, hi, substring(word, 1, lo), right(word, length - hi))")


def partitions(words: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """(key, word, n): each word in each of its initial-state partitions, none of over `max_group` words that can be split."""
    size = F.length("word")
    lengths = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("length")).where(F.col("length") >= MIN_LENGTH)
    half = F.expr("(length + 1) div 2").cast("int")
    rows = lengths.select("word", "n", "length", F.explode(F.array(
        F.struct(F.lit(0).alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), (F.col("length") + 1).alias("hi")))).alias("w")) \
        .select("word", "n", "length", "w.lo", "w.hi")
    done = None
    while True:
        rows = rows.withColumn("key", _key())
        hot = rows.where(F.col("hi") - F.col("lo") > 1).groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > max_group).select("key")
        hot = written(hot, "hot-keys")
        if hot.isEmpty():
            left = rows.select("key", "word", "n")
            return done.unionByName(left) if done is not None else left
        cold = rows.join(hot, "key", "left_anti").select("key", "word", "n")
        done = cold if done is None else done.unionByName(cold)
        mid = F.expr("(lo + hi) div 2").cast("int")
        rows = rows.join(hot, "key", "left_semi").select("word", "n", "length", F.explode(F.array(
            F.struct("lo", mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi")))).alias("w")).select("word", "n", "length", "w.lo", "w.hi")
        rows = written(rows, "split-windows")


def forms(words: DataFrame, factor: int = FACTOR, max_group: int = MAX_GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n) of distinct words."""
    words = written(words, "vocabulary")
    placed = partitions(words, max_group).repartition("key").sortWithinPartitions("key")
    found = placed.mapInArrow(_near, "word string, n_near long, best_n long, best string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("order"), "best")).alias("b"))
    judged = words.join(best, "word", "left").withColumn("ok", -F.col("b.order") >= factor * F.col("n"))
    judged = written(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                   F.when(F.col("ok"), F.col("b.best")).alias("form"), F.when(F.col("ok"), -F.col("b.order")).alias("form_n")), "forms")
    links = judged.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(5):  # a chain has 19 links at most: its n grows tenfold a link
        links = written(links, "roots")
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        links = written(links, "roots")
        if links.where("moved").isEmpty():
            break
        links = links.select("word", "root")
    return judged.join(links.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: form and root of every word of all documents."""
    return forms(vocabulary(load(spark, sf_dir, "documents").select("doc_id", "text")))


#: unsigned crc32 of the bytes of `{0}` (an expression), as SQL.
CRC32_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda x: ('0x' || x)::BIGINT)),
  lambda a, b: xor(a >> 8, crc_table[(xor(a, b) & 255) + 1])), 4294967295)"""
CRC_TABLE_SQL = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc_table)"""

ORACLE_SQL = rf"""
WITH RECURSIVE {CRC_TABLE_SQL},
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
once AS (SELECT d, run, count(*) AS n FROM runs WHERE length(run) >= {MIN_LENGTH} GROUP BY ALL),
hashed AS (SELECT run, n, {CRC32_SQL.format("d || ':' || run")} AS h FROM once, crc),
w AS (SELECT CASE WHEN h % {EVERY} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
cut AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM cut),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN v b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM pairs GROUP BY word),
f AS (
  SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= {FACTOR} * v.n THEN b.top END AS form_n,
         CASE WHEN b.top >= {FACTOR} * v.n THEN (SELECT min(p.near) FROM pairs p WHERE p.word = v.word AND p.near_n = b.top) END AS form
  FROM v LEFT JOIN best b ON b.word = v.word),
chain AS (
  SELECT word, word AS at, 0 AS k FROM f
  UNION ALL SELECT c.word, f.form, c.k + 1 FROM chain c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, (SELECT max_by(c.at, c.k) FROM chain c WHERE c.word = f.word) AS root, f.n, f.n_near, f.form_n FROM f
"""

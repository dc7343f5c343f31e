"""Prefix trie, nearest-neighbour votes and spelling variants against brute force, on rows with every awkward case."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F


def crc(text):
    return zlib.crc32(text.encode())


# --- conversation prefix trie ------------------------------------------------------------

CONV = "conv_id long, turn long, role string, text string, seq string, sizes int"


def conversations(rnd, n=260):
    texts = ["", "a", "b", "hello there", "日本", None]
    rows = []
    for c in range(n):
        if c % 17 == 5:
            continue
        for t in range(rnd.randrange(1, 9)):
            rows.append((c, t if t != 3 else None, ["user", "assistant", None][t % 3], rnd.choice(texts[:2] if rnd.random() < .8 else texts), "x", 1))
    rows += [(c, t, "user", "same", None, None) for c in range(600, 700) for t in range(4)]  # copies, one hot sequence
    rows += [(None, 0, "user", "nobody's", None, None)] * 3 + [(901, 0, "user", "no base", None, None)]
    rows += [(300, 0, "user", "twice", None, None)] * 2 + [(-5, 1, "user", "below zero", None, None)]
    rows += [(800, t, "user", "long " * (t % 3), None, None) for t in range(400)]
    return rows


def trie_by_hand(rows):
    convs = collections.defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            convs[c].append(((t is not None, t or 0, key), (role, text)))
    convs = {c: [x for _, x in sorted(v, key=lambda p: p[0])] for c, v in convs.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, own in convs.items():
        h, base = crc(str(c)) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        turns = tuple(convs.get(base, [])[:h] + own[h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


@pytest.mark.parametrize("fan,parts", [(64, 4), (3, 23)])
def test_trie_equals_brute_force(spark, monkeypatch, fan, parts):
    from gazette.llm import prefix_trie as T
    monkeypatch.setattr(T, "FAN", fan)
    monkeypatch.setattr(T, "STRETCH", 7)
    rows = conversations(random.Random(5))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = T.trie(T.rebuilt(spark.createDataFrame(rows, CONV))).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    got = sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None and not r.depth else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                  r.saved_tokens, r.ends_sha256) for r in out)
    assert got == trie_by_hand(rows)


def test_trie_of_nothing_and_of_one(spark):
    from gazette.llm import prefix_trie as T
    assert T.trie(T.rebuilt(spark.createDataFrame([], CONV))).collect() == []
    rows = [(7, 0, "user", "only", None, None)]
    assert sorted((r.depth, r.n_convs, r.n_children) for r in T.trie(T.rebuilt(spark.createDataFrame(rows, CONV))).collect()) == \
        sorted((d, n, k) for _, d, _, n, k, *_ in trie_by_hand(rows))


# --- nearest-neighbour votes ----------------------------------------------------------------


def labelled_docs(n=400):
    rnd = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa"]
    docs, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        ws = [rnd.choice(words) for _ in range(rnd.randrange(20, 120))]
        docs.append((i, " ".join(ws) + "." if good else " ".join(w.upper() + "!!" for w in ws), f"s{i}", None))
        labels.append((i, int(good), 0))
    docs += [(n, None, None, None), (n + 1, "", None, None), (None, "alpha beta " * 20, None, None), (n + 2, "\x00 日本 " * 3, None, None), docs[3], docs[3]]
    docs += [(n + 3, "x" * 300_000, None, None), (n + 4, "BETA!! " * 9000, None, None)]
    labels += [(n, None, None), (None, 1, 0), (1, 1, 0), (99_999, 0, 0)]
    return docs, labels


DOCS, LABELS = "doc_id long, text string, source string, quality_score double", "doc_id long, quality int, toxic int"


def test_votes_accuracy_and_cases(spark):
    from gazette.llm import quality_knn as Q
    docs, labels = labelled_docs()
    d = spark.createDataFrame(docs, DOCS).repartition(3)
    model = Q.fit(d, spark.createDataFrame(labels, LABELS))
    out, c = Q.scored(d, model)
    assert out.columns == [*d.columns, c] and c not in d.columns
    rows = out.select("doc_id", Q.held_out("doc_id").alias("held_out"), f"{c}.*").collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    truth = {i: q for i, q, _ in labels if q is not None}
    assert all(r.held_out == (crc("" if r.doc_id is None else str(r.doc_id)) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    by_id = {r.doc_id: r.score for r in rows}
    assert by_id[400] == by_id[401] == pytest.approx(np.mean(model.labels), abs=1e-6)  # no terms: the mean label
    assert by_id[404] < 0.5
    # held-out labels are never read: turning them round changes nothing
    turned = [(i, q if i is None or q is None or crc(str(i)) % 4 != 2 else 1 - q, t) for i, q, t in labels]
    again = Q.fit(d, spark.createDataFrame(turned, LABELS))
    assert np.allclose(again.labels, model.labels) and np.allclose(again.vectors, model.vectors, atol=1e-4)


def test_votes_equal_plain_cosines(spark):
    from gazette.llm import quality_knn as Q
    docs, labels = labelled_docs(120)
    model = Q.fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), most=60)
    assert 20 < len(model.labels) <= 60  # the documented bound
    texts = [t for _, t, _, _ in docs]
    got = model.scores(texts)
    for text, score in zip(texts, got):
        z = (Q.weights([text], model.idf) @ model.basis)[0]
        n = np.linalg.norm(z)
        cos = [float(v @ z / n) if n > 1e-6 else 0.0 for v in model.vectors]
        last = sorted(cos)[-Q.NEIGHBOURS]
        vote = [(max(x, 0), y) for x, y in zip(cos, model.labels) if x >= last - 1e-6]
        total = sum(x for x, _ in vote)
        assert score == pytest.approx(sum(x * y for x, y in vote) / total if total else model.labels.mean(), abs=1e-4)


def test_votes_long_texts_and_empty_tables(spark, monkeypatch):
    from gazette.llm import quality_knn as Q
    text = "one two  two\ntwo THREE " * 500
    whole = Q.term_counts([text, "a"])
    monkeypatch.setattr(Q, "PIECE", 1000)
    pieces = Q.term_counts([text, "a"])
    # words all count; at each of the 11 cuts some trigrams and a repeat differ
    assert np.array_equal(whole[:, Q.SHAPES:-1], pieces[:, Q.SHAPES:-1]) and abs(whole - pieces).sum() <= 11 * 5 and np.array_equal(whole[1], pieces[1])
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", None, None)], DOCS)
    no_labels = spark.createDataFrame([], LABELS)
    assert Q.scored(none, Q.fit(none, no_labels))[0].collect() == []
    out, c = Q.scored(some, Q.fit(some, no_labels))
    assert out.select(f"{c}.score").first()[0] == 0.5


# --- spelling variants ----------------------------------------------------------------------


def one_edit(u, v):
    if abs(len(u) - len(v)) > 1 or u == v:
        return False
    k = len([0 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(u, v))])
    if len(u) == len(v):
        return u[k + 1:] == v[k + 1:]
    return u[k:] == v[k + 1:] if len(u) < len(v) else u[k + 1:] == v[k:]


def forms_by_hand(counts):
    out = {}
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    best = {w: min(near[w], key=lambda v: (-counts[v], v), default=None) for w in counts}
    form = {w: b if b is not None and counts[b] >= 10 * counts[w] else None for w, b in best.items()}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def vocabulary(rnd):
    letters = "abécdÿz"
    words = {"".join(rnd.choice(letters[:4]) for _ in range(rnd.randrange(7, 10))) for _ in range(500)}
    words |= {"aaaaaaa"[:6] + c for c in "abcdefgh"} | {"a" * n for n in range(7, 14)} | {"q" * 3000, "q" * 2999 + "r", "q" * 3001, "r" + "q" * 2999}
    for w in list(words)[:60]:
        i = rnd.randrange(len(w))
        words |= {w[:i] + w[i + 1:], w[:i] + "z" + w[i:], w[:i] + "ÿ" + w[i + 1:]}
    return {w: rnd.choice([2, 3, 20, 200, 2000, 20_000]) for w in words if len(w) >= 7}


@pytest.mark.parametrize("max_group", [20_000, 5])
def test_forms_equal_brute_force(spark, max_group):
    from gazette.llm import spelling as S
    counts = vocabulary(random.Random(3))
    got = S.forms(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3), max_group=max_group).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == forms_by_hand(counts)
    assert len(got) == len(counts)


def test_each_pair_in_one_partition_once():
    from gazette.llm import spelling as S
    words = list(vocabulary(random.Random(9)))[:250]
    seen = collections.Counter()
    groups = collections.defaultdict(set)
    for w in words:
        for length in (len(w), len(w) - 1):
            m = (length + 1) // 2
            for lo, hi in ((0, m), (m, length + 1)):
                groups[length, lo, hi, w[:lo], w[len(w) - max(length - hi, 0):]].add(w)
    for (length, lo, hi, *_), g in groups.items():
        seen.update(frozenset(p) for p in S.near_pairs(sorted(g), length, lo, hi))
    assert seen == collections.Counter(frozenset(p) for p in itertools.combinations(words, 2) if one_edit(*p))


def test_vocabulary_of_texts(spark):
    from gazette.llm import spelling as S
    rows = [(i, " ".join(["Straße ÉCOLES Écoles economy", "understanding, UNDERSTANDING", "x" * 5000][:1 + i % 3]), None) for i in range(90)]
    rows += [(None, "nobody understands", 1), (1, None, 1), (2, "", 1), rows[0], rows[0]]
    want = collections.Counter()
    for d, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc(f"{'' if d is None else d}:{run}")
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            want[run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    docs = spark.createDataFrame(rows, "doc_id long, text string, word int")
    assert {r.word: r.n for r in S.vocabulary(docs).collect()} == want
    assert S.forms(S.vocabulary(docs.limit(0))).collect() == []

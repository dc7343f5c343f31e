"""Vectors by token: Bloom semi-join, exact look-up, n-gram vectors of unknown tokens."""

import random

import pytest
from pyspark.sql import functions as F

from gazette.operators import vectors as VX
from gazette.operators.summarize import TITLE, Vectors, title_similarity

VEC = "token string, vec array<float>"


def _rows(spark, d, col="token"):
    return spark.createDataFrame([(k, v) for k, v in d.items()], f"{col} string, vec array<float>")


def _got(df):
    return {r.lemma: [round(x, 5) for x in r.vec] for r in df.collect()}


def lemmas(spark, *words):
    return spark.createDataFrame([(w,) for w in words], "lemma string")


def test_bloom_keeps_every_member_and_few_others(spark):
    rnd = random.Random(1)
    members = [f"w{rnd.randrange(10**9)}" for _ in range(3000)]
    others = [f"x{rnd.randrange(10**9)}" for _ in range(20_000)]
    keys = spark.createDataFrame([(m,) for m in set(members)], "k string")
    rows = spark.createDataFrame([(m,) for m in members + others], "token string")
    out = [r.token for r in VX.may_contain(rows, "token", keys, "k").collect()]
    assert sorted(x for x in out if x[0] == "w") == sorted(members)
    assert sum(x[0] == "x" for x in out) < 600  # 3 %
    plan = VX.may_contain(rows, "token", keys, "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_vectors_come_by_token_alone(spark):
    words = {"storm": [1.0, 0.0], "flood": [0.0, 2.0], "town": [3.0, 3.0]}
    few = VX.open_store(_rows(spark, words))
    many = VX.open_store(_rows(spark, {f"w{i}": [float(i), 1.0] for i in range(500)} | words))
    want = {"storm": [1.0, 0.0], "town": [3.0, 3.0]}
    ask = lemmas(spark, "storm", "town", "storm", "unknown", None)
    assert _got(VX.lemma_vectors(ask, few)) == _got(VX.lemma_vectors(ask, many)) == want
    assert few.dim == many.dim == 2


def test_unknown_tokens_take_the_mean_of_their_grams(spark):
    grams = {"<ab": [1.0, 1.0], "ab>": [3.0, 5.0], "zzz": [9.0, 9.0]}
    store = VX.open_store(_rows(spark, {"known": [1.0, 2.0]}), _rows(spark, grams, "gram"))
    assert _got(VX.lemma_vectors(lemmas(spark, "known", "ab", "q", ""), store)) == {"known": [1.0, 2.0], "ab": [2.0, 3.0]}
    got = spark.createDataFrame([("ab",), ("a",), ("",), ("aaaaa",)], "t string").select(VX.grams_of(F.col("t")).alias("g")).collect()
    assert [r.g for r in got] == [["<ab", "ab>"], ["<a>"], ["<>"], ["<aa", "aaa", "aa>"]]


def test_repeats_nulls_and_empty_stores(spark):
    rows = [("a", [2.0, 0.0]), ("a", [1.0, 5.0]), ("b", None), (None, [1.0, 1.0])]
    store = VX.open_store(spark.createDataFrame(rows, VEC))
    assert _got(VX.lemma_vectors(lemmas(spark, "a", "b"), store)) == {"a": [1.0, 5.0]}
    empty = VX.open_store(spark.createDataFrame([], VEC), spark.createDataFrame([], "gram string, vec array<float>"))
    assert empty.dim == 0 and VX.lemma_vectors(lemmas(spark, "a"), empty).collect() == []
    assert VX.lemma_vectors(lemmas(spark), store).collect() == []


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_title_similarity(spark, monkeypatch, limit):
    from gazette.operators import common
    monkeypatch.setattr(common.broadcast_if_bytes, "__defaults__", (limit,))
    sents = spark.createDataFrame([(1, 0, ["storm"]), (1, 1, ["town", "flood"]), (1, 2, []), (2, 0, ["storm"])],
                                  "doc_id long, sent int, content array<string>")
    titles = spark.createDataFrame([(1, "Storm"), (2, None), (3, "Town")], "doc_id long, title string")
    store = VX.open_store(_rows(spark, {"storm": [1.0, 0.0], "flood": [0.0, 2.0], "town": [3.0, 3.0]}))
    v = Vectors(sents, titles, store)
    assert {r.sent for r in v.titles.collect()} == {TITLE}
    got = {(r.doc_id, r.sent): round(r.sim, 6) for r in title_similarity(sents, v).collect()}
    assert got == {(1, 0): 1.0, (1, 1): round(3 / 34 ** 0.5, 6), (1, 2): 0.0, (2, 0): 0.0}


def test_row_bytes_bound_broadcasts(spark):
    from gazette.operators.common import fits_bytes
    big = spark.range(100).select(F.repeat(F.lit("x"), 1000).alias("s"), F.sequence(F.lit(1), F.lit(50)).alias("v"))
    assert not fits_bytes(big, 100_000) and fits_bytes(big, 200_000) and fits_bytes(big.limit(0), 0)


def test_vector_sums_in_blocks(spark, monkeypatch):
    """Sums over many small blocks: repeated and null keys, repeated lemmas, unknown ones, null and missing components."""
    from gazette.operators import summarize as SM
    vectors = spark.createDataFrame([("a", [1.0, 2.0, None]), ("b", [0.5, None, None]), ("c", [4.0])], "lemma string, vec array<double>")
    rows = [(d, s, w) for d in (1, 2, None) for s in (0, 1, None) for w in "aabcx"] + [(3, 0, "b"), (4, 0, "x"), (5, 0, None)]
    lemmas = spark.createDataFrame(rows * 2, "doc_id long, sent int, lemma string")
    want = {(d, s): ([13.0, 8.0, None], 8) for d in (1, 2, None) for s in (0, 1, None)} | {(3, 0): ([1.0, None, None], 2)}
    for size in (256 << 20, 8 * 3 * 7):
        monkeypatch.setattr(SM, "BLOCK_BYTES", size)
        got = SM.vector_sums(lemmas, ["doc_id", "sent"], vectors, 3).collect()
        assert {(r.doc_id, r.sent): (r.vsum, r.n_vec) for r in got} == want and len(got) == len(want)
    assert SM.vector_sums(lemmas, ["doc_id"], vectors.limit(0), 0).count() == 0


def test_a_block_gets_each_vector_once(spark):
    """Vectors are joined once per block and lemma, not once per token."""
    from gazette.operators import summarize as SM
    lemmas = spark.range(5000).select((F.col("id") % 50).alias("doc_id"), F.lit(0).alias("sent"), F.concat(F.lit("w"), F.col("id") % 7).alias("lemma"))
    vectors = spark.range(7).select(F.concat(F.lit("w"), "id").alias("lemma"), F.array(F.col("id").cast("double")).alias("vec"))
    out = SM.vector_sums(lemmas, ["doc_id", "sent"], vectors, 1)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    join, once = plan.index("Join Inner"), plan.index("Aggregate [_of")
    assert join < once and "sum(" not in plan
    got = {r.doc_id: (r.vsum[0], r.n_vec) for r in out.collect()}
    assert got == {d: (float(sum(i % 7 for i in range(d, 5000, 50))), 100) for d in range(50)}


def test_distinct_grams_of_tokens(spark):
    tokens = spark.createDataFrame([(t,) for t in ("bus", "buses", "a", "", "\U0001f525x", "bus", None)], "token string")
    want = {r.g for r in tokens.select(F.explode(VX.grams_of(F.col("token"))).alias("g")).collect()}
    found = VX.distinct_grams(tokens, "token")
    got = [r.gram for r in found.collect()]
    assert set(got) == want and len(got) == len(want) > 8
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()

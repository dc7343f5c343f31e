"""12 h similarity: golden case (FIXTURES §3.7), blocked join = brute force."""

from pyspark.sql import functions as F

from conftest import SF_SMALL, SF_MID
from gazette.operators import similarity as S
from gazette.sources import fixtures as V

BASE = "id long, ct timestamp, site string, words array<string>"


def _golden(spark):
    rows = [(1, "2024-01-01 00:00:00", "s2", ["a", "b", "c"]),
            (2, "2024-01-01 00:01:00", "s2", ["a", "b", "c"]),
            (3, "2024-01-01 06:00:00", "s1", ["a", "b", "c"]),
            (4, "2024-01-01 07:00:00", "s3", []),
            (6, "2024-01-01 11:00:00", "s4", list("abcdefghij")),
            (5, "2024-01-01 12:00:00", "s1", ["a", "b", "c"])]
    df = spark.createDataFrame(rows, "id long, t string, site string, words array<string>")
    return df.select("id", F.to_timestamp("t").alias("ct"), "site", "words")


def test_golden_window(spark):
    base = _golden(spark)
    lit = {r.other_id: r.score for r in S.similar_pairs_literal(base, prepared=True)
           .filter("id = 5").collect()}
    assert set(lit) == {2, 3, 4, 6}            # id 1 is exactly 12 h older: outside
    assert lit[2] == 1.0 and lit[3] == 0.0 and lit[4] == 0.0 and abs(lit[6] - 0.3) < 1e-12
    blocked = S.similar_pairs(base, 0.3, prepared=True).filter("id = 5").collect()
    assert [r.other_id for r in blocked] == [2]


def test_blocked_equals_literal(spark):
    for sf in (SF_SMALL, SF_MID):
        base = S.prepare(V.articles(spark, sf)).cache()
        lit = S.similar_pairs_literal(base, prepared=True)
        for t in (0.0, 0.3, 0.5):
            want = sorted((r.id, r.other_id, round(r.score, 9)) for r in lit.filter(F.col("score") > t).collect())
            got = sorted((r.id, r.other_id, round(r.score, 9))
                         for r in S.similar_pairs(base, t, prepared=True).collect())
            assert got == want, (sf, t)
        # every (token, bucket) of two rows or more dealt over tiles
        got = sorted((r.id, r.other_id, round(r.score, 9)) for r in S.similar_pairs(base, 0.3, prepared=True, tile=1).collect())
        assert got == sorted((r.id, r.other_id, round(r.score, 9)) for r in lit.filter(F.col("score") > 0.3).collect())
        base.unpersist()


def test_jaccard_symmetric_bounded(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c", "d"]), ([], ["a"]), (["x"], ["x"])],
                               "a array<string>, b array<string>")
    rows = df.select(S.jaccard(F.col("a"), F.col("b")).alias("ab"),
                     S.jaccard(F.col("b"), F.col("a")).alias("ba")).collect()
    assert [(r.ab, r.ba) for r in rows] == [(0.25, 0.25), (0.0, 0.0), (1.0, 1.0)]


def test_host(spark):
    from gazette.functions.urls import url_host
    df = spark.createDataFrame([("https://u:p@WWW.a_b.com:80/x?y",), ("not a url",)], "u string")
    assert [r[0] for r in df.select(url_host(F.col("u"))).collect()] == ["www.a_b.com", None]


def test_hot_group_of_copies(spark):
    """A third of the rows are copies of one title, crowded into one window:
    the pair-free count equals the brute force."""
    import datetime as dt
    rows = []
    t0 = dt.datetime(2024, 1, 1)
    for i in range(240):
        if i % 3 == 0:
            rows.append((i, t0 + dt.timedelta(minutes=i), f"s{i % 4}", ["apple", "grow", "profit"]))
        else:
            rows.append((i, t0 + dt.timedelta(minutes=7 * i), f"s{i % 5}",
                         sorted({f"w{i % 13}", f"w{i % 7}", "apple" if i % 2 else "pear"})))
    base = spark.createDataFrame(rows, BASE)
    want = {r.id: 0 for r in base.collect()}
    for r in S.similar_pairs_literal(base, prepared=True).filter("score > 0.3").collect():
        want[r.id] += 1
    got = {r.id: r.importance for r in S.importance_counted(base, prepared=True).collect()}
    assert got == want


def test_pairs_of_sets_are_found_once(spark, monkeypatch):
    """Both sides of the counting read the written pairs of sets; null times and sites and repeated ids count as by pairs."""
    import datetime as dt
    from gazette import session
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i // 2 if i < 8 else i, t0 + dt.timedelta(hours=i % 15), [None, "a", "b"][i % 3], ["apple", f"w{i % 4}", "x"]) for i in range(60)]
    base = spark.createDataFrame(rows + [(99, None, "a", ["apple", "x"])], BASE)
    plans, cut = [], session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    got = sorted((r.id, r.importance) for r in S.importance_counted(base, prepared=True).collect())
    assert sum("array_intersect" in p for p in plans) == 1 and any("array_intersect" not in p for p in plans)
    pairs = S.similar_pairs_literal(base, prepared=True).filter("score > 0.3").groupBy("id").count().collect()
    n = {r.id: r["count"] for r in pairs}
    assert got == sorted((r[0], n.get(r[0], 0)) for r in [*rows, (99,)])


def test_importance_since_is_incremental(spark):
    arts = V.articles(spark, SF_MID)
    since = F.to_timestamp(F.lit("2024-01-01 15:00:00"))
    full = {r.id: r.importance for r in S.importance(arts).collect()}
    cts = {r.id: r.create_time for r in arts.select("id", "create_time").collect()}
    import datetime as dt
    want = {i: v for i, v in full.items() if cts[i] >= dt.datetime(2024, 1, 1, 15)}
    got = {r.id: r.importance for r in S.importance(arts, since=since).collect()}
    assert got == want and len(got) > 0


def test_window_filter_prunes_stored_table(spark):
    import contextlib
    import io
    import tempfile
    path = tempfile.mkdtemp(prefix="gz-arts-") + "/articles"
    arts = V.articles(spark, SF_SMALL).select("id", "create_time", "title", "uri") \
        .withColumn("day", F.to_date("create_time"))
    arts.write.partitionBy("day").parquet(path)
    stored = spark.read.parquet(path)
    now = F.to_timestamp(F.lit("2024-01-01 06:00:00"))
    win = S.recent_window(stored, now, day_col="day")
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        win.explain("formatted")
    plan = buf.getvalue()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert "GreaterThan(create_time" in plan
    want = sorted(r.id for r in arts.collect() if r.create_time > __import__("datetime").datetime(2023, 12, 31, 18))
    assert sorted(r.id for r in win.collect()) == want

"""Cases that once went wrong: notices beside rarer ones, long roles, cycles, allowed words beside keys, repeated rows."""

import collections
import hashlib
import random
import re
import string

import pytest
from pyspark.sql import functions as F


def brute_labels(text):
    """Base and template labels by trying every shift of every template."""
    from gazette.llm import license_scan as s
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    flat = " " + " ".join(words) + " "
    out = {label for p, label in s.BASE if f" {p} " in flat}
    if len(set(words) & set(s.VOCABULARY)) > 1:
        for label, notice, keys in s.TEMPLATES:
            index = [(w, i) for w, t, i in s.INDEX if t == label]
            best = max((sum(0 <= k + i < len(words) and words[k + i] == w for w, i in index) for k in range(-len(notice.split()), len(words))), default=0)
            if 2 * best >= len(index) and all(f" {k} " in flat for k in keys):
                out.add(label)
    return ",".join(sorted(out))


def test_op5_every_notice_counts(spark):
    import duckdb

    from gazette.llm import license_scan as s
    notice = {label: text for label, text, _ in s.TEMPLATES}
    rnd = random.Random(4)
    texts = [" . ".join(notice[x] for x in ("mit", "bsd", "mpl", "cc-by"))] + [notice["mit"]] * 19 + [None, ""]
    for label, text, keys in s.TEMPLATES:
        words = text.split()
        for drop in (0.2, 0.4, 0.6):
            kept = [w if rnd.random() > drop or any(w in k.split() for k in keys) else rnd.choice(["x", "software", "license"]) for w in words]
            texts.append("some words " * rnd.randrange(4) + " ".join(kept))
    texts += [" ".join(rnd.choice(s.VOCABULARY) for _ in range(60)) for _ in range(20)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = s.licences(docs)
    got = {r.doc_id: ",".join(sorted({*r.base_labels, *r.method_labels})) for r in found.collect()}
    assert got == {i: brute_labels(t or "") for i, t in rows}
    assert got[0] == "bsd,cc-by,mit,mpl"
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert {r[0]: r[1] for r in con.sql(f"select doc_id, labels from ({s.ORACLE_SQL})").fetchall()} == got


def test_op5_idf_decides_the_look_up(spark):
    from gazette.llm import license_scan as s
    notice = {label: text for label, text, _ in s.TEMPLATES}
    slim = s.scanned(spark.createDataFrame([(i, notice["mit"]) for i in range(9)] + [(10, notice["bsd"])], "doc_id long, text string"))
    few = collections.Counter(r.template for r in s.rarest(slim).collect())
    sizes = collections.Counter(t for _, t, _ in s.INDEX)
    assert few == {t: n - -(-n // 2) + 1 for t, n in sizes.items()}
    # words of the frequent notice are rare ones of no template that has others
    assert not {r.word for r in s.rarest(slim).where("template = 'agpl'").collect()} & {"software"}


def test_op8_reads_a_bounded_part(spark, monkeypatch):
    from gazette.llm import url_filter as u
    seen = []
    monkeypatch.setattr(u, "fit", lambda rows: seen.append(rows))
    df = spark.range(6000).select(F.concat(F.lit("http://h.example.com/"), (F.col("id") % 3000).cast("string")).alias("url"), (F.col("id") % 2).cast("int").alias("label"))
    u.train(df, limit=500)
    want = [r.url for r in df.groupBy("url").agg(F.max("label")).orderBy(F.xxhash64("url"), "url").limit(500).collect()]
    assert seen[0] == [(*u.parts(x), int(x.rsplit("/", 1)[1]) % 2) for x in want]
    u.train(df.limit(7), limit=500)
    u.train(df.limit(0), limit=500)
    assert len(seen[1]) == 7 and seen[2] == []


@pytest.mark.parametrize("role", ["x" * 100_000, ":" * 100_000, "\\" * 100_001, "a\\:" * 50_000, "", ": ", "\\", "##</"])
def test_op10_long_roles(spark, role):
    from gazette.llm import chat as c
    df = spark.createDataFrame([("t", 1, 0, role, "te: xt\\"), ("t", 1, 1, "assistant", role)], "tree string, leaf long, turn long, role string, text string")
    r = c.parsed(c.formatted(df)).first()
    assert [(x.role, x.text) for x in r.turns] == [(role, "te: xt\\"), ("assistant", role)] and r.learned == role


def test_op10_nothing_below_a_cycle(spark):
    from gazette.llm import chat as c
    made = [("v", 7, 8), ("v", 8, 7), ("v", 9, 7), ("v", 10, 9), ("v", 1, None), ("v", 2, 1), ("s", 3, 3), ("s", 4, 3)]
    made += [("long", i, i - 1 if i else None) for i in range(40)]
    df = spark.createDataFrame(made, "tree string, msg long, parent long")
    got = sorted((r.tree, r.leaf, r.msg, r.up) for r in c.paths(df).collect())
    assert got == sorted([("v", 2, 2, 0), ("v", 2, 1, 1)] + [("long", 39, 39 - i, i) for i in range(40)])


def test_op10_query_equals_plain_python(spark):
    from gazette.llm import chat as c
    d = "/root/testdata/sf0.001"
    rows = collections.defaultdict(list)
    for r in spark.read.parquet(f"{d}/conversations.parquet").collect():
        rows[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    rows[c.EXTRA_ID] = [(0, "user", c.EXTRA_TEXT), (1, "assistant", c.EXTRA_TEXT)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    esc = lambda t: re.sub("#(?=#)", r"#\\", t.replace("\\", "\\\\")).replace("</", "<\\/")
    want = {}
    for k, turns in rows.items():
        turns = sorted(turns)
        learned = "".join(t for _, role, t in turns if role == "assistant")
        shown = "".join(f"### {esc(role).replace(':', chr(92) + ':')}: {esc(t)}</turn>\n" for _, role, t in turns)
        want[k] = (len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in turns)), len(learned), sha(learned), len(shown))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in c.op10_reply_trees(spark, d).collect()}
    assert got == want


KEY = "q9Zk3LmX7vB2nR8tYw5P"


@pytest.mark.parametrize("text", [
    f"sample: {KEY}", f"{KEY}xxxx9Zk3LmX7vB2nR8tYw5kQ", "kT9vQz2LmXw7RbYp4NcJ8sHd" + "0123456789" + "Zr5Gf1Wq8VxKe3Uj6TnA", f"example {KEY} placeholder", f"your_{KEY}"])
def test_op6_allowed_words_do_not_hide_keys(text):
    from gazette.llm import secret_scan as s
    spans = [text[a:z] for k, a, z in s.find_secrets(text) if k == "entropy"]
    assert spans and all(len(x) >= 16 for x in spans) and not any(s.ALLOW.search(x) for x in spans)


@pytest.mark.parametrize("text", ["id 123e4567-e89b-12d3-a456-426614174000 end", "integrity=sha384-oqVuAfXRKap7fdgcCY5uykM6R9GqQ8KuxAbcDe0123FghiJklMnOpQrSt",
                                  "abcdefghijklmnopqrstuvwxyz0123456789", "xxxxxxxxxxxxxxxxxxxxxxxx"])
def test_op6_public_values_are_no_secrets(text):
    from gazette.llm import secret_scan as s
    assert [k for k, *_ in s.find_secrets(text)] == []


def test_op6_recall_beside_allowed_words():
    from gazette.llm import secret_scan as s
    rnd = random.Random(8)
    alone = beside = 0
    for word in ("example", "sample", "dummy", "changeme", "0123456789"):
        for _ in range(200):
            key = "".join(rnd.choices(string.ascii_letters + string.digits, k=32))
            alone += bool(s.entropy_spans(key))
            beside += bool(s.entropy_spans(f"{word} {key} {word}"))
    assert alone == beside > 950


def test_op6_columns_and_base_patterns(spark):
    from gazette.llm import secret_scan as s
    assert s.op6_secret_scan(spark, "/root/testdata/sf0.001").columns[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    rnd = random.Random(1)
    parts = ["password", "API_KEY", "api-key", "token", "=", ": ", " ", '"', "'", "AKIA", "A1B2C3D4", "deadbeef" * 4, "abc", "xyz.789/", "\n", "é"]
    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randrange(14)))
        want = [("assign", m.start(), m.end()) for m in re.finditer(
            r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t)
            if len(m[1]) >= 8]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 16]
        want += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 32]
        assert sorted(x for x in s.find_secrets(t) if x[0] != "entropy") == sorted(want)


BASE = " ".join(f"w{i}" for i in range(60))
OTHER = " ".join(f"v{i}" for i in range(60))


@pytest.mark.parametrize("plain", [256, 2])
def test_op7_keeps_one_row_of_each_group(spark, monkeypatch, plain):
    from gazette.llm import near_dedup as n
    monkeypatch.setattr(n, "PLAIN", plain)
    monkeypatch.setattr(n, "HOT", 10_000 if plain > 2 else 1_000_000)
    rows = [(1, BASE), (1, BASE), (2, BASE), (2, OTHER), (None, BASE), (None, OTHER + " q"), (5, None), (5, None), (6, ""), (None, "only null ids here"),
            (None, "only null ids here")] + [(100 + i, BASE + f" t{i % 3}") for i in range(30)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, digest string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in n.keep_one(docs).collect()))
    want = [(1, BASE), (2, OTHER), (5, ""), (5, ""), (6, ""), (None, "only null ids here")]
    assert got == sorted((i is None, i or 0, t) for i, t in want)
    groups = n.near_groups(docs, 80).collect()
    assert len(groups) == len(rows)
    assert {r.component_id for r in groups if r.doc_id is not None and r.doc_id >= 100} == {1}


def test_entry_without_the_subpackage(tmp_path):
    """The entry module imports without this subpackage, and when one of its imports is missing."""
    import os
    import shutil
    import subprocess
    import sys
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(f"{here}/gazette", tmp_path / "gazette", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert not [k for k in e.queries() if k[:2] == 'op']; print(len(e.queries()))"
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert int(run().stdout) > 60
    (tmp_path / "gazette" / "llm").mkdir()
    (tmp_path / "gazette" / "llm" / "queries.py").write_text("import no_such_module\n")
    assert int(run().stdout) > 60

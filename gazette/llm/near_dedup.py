"""Near-duplicate groups by b-bit MinHash with exact confirmation of every link.

1. Each text's set of 5-word shingles is hashed (64 bits) and reduced to PERMS
   minima. Of each minimum its low BITS bits are kept, packed into longs; bands
   of ROWS whole minima give the bucket keys. Texts with equal sets share a
   128-bit digest and become one class, so copies never meet each other.
2. Classes that share a bucket are candidates. A pair's similarity is estimated
   from the packed bits: equal fields are counted by xor and bit counts, and the
   share that equal by chance (2**-BITS) is taken out. Pairs that reach the
   threshold less MARGIN standard deviations, and have fitting sizes, are
   confirmed on their full sets.
3. First every class meets only the smallest class of each of its buckets, and
   its likeliest link is confirmed. Confirmed links join components.
4. Then the buckets that still hold several components are worked through in
   tiles of at most 2 * TILE classes. A tile compares each pair of different
   components once (in the first bucket the pair shares), confirms the likely
   ones, joins as it goes, and returns only the links that join two components:
   fewer than it has classes. Pairs are never written out.

The banding misses a link with probability (1 - s**ROWS)**BANDS, 6e-11 at a
similarity of 0.85 and 5e-8 at 0.80; the estimate, at that threshold, with 7e-13
and 1.2e-13 (exact binomial of the unequal fields). Their sum is what can be missed.

Defined cases: null or empty text, or one without words, is linked with nothing;
fewer than 5 words are one shingle; repeated rows are members of one class; a
null doc_id has no part in the smallest id; an empty table gives an empty result.

Scale: one pass over the text gives (doc_id, class, signature) rows; a second
pass builds full sets only for classes that share a bucket. Bucket rows exist
only for buckets of two classes or more. A bucket that holds a third of all
classes is split into blocks, whose pairs of blocks are tiles of their own, so
no task holds more than two blocks. Nothing but counts reaches the driver.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.llm.hashing import BASE, mix, span_hashes
from gazette.llm.util import WORD, free_name, load, python_column, written

SHINGLE = 5
BANDS, ROWS, BITS = 32, 4, 4
PERMS = BANDS * ROWS
MARGIN = 8.0
#: Classes of a block; a task holds two blocks at most.
#: Keys that may be frequent at most, by their share of the rows; rows of a key that one task may take without asking.
HOT, PLAIN = 10_000, 256
TILE = 1024
#: Text bytes hashed at a time.
CHUNK = 1 << 21
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


_rng = np.random.default_rng(20240229)
_PLACE = _rng.integers(1, 1 << 62, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _rng.integers(1, 1 << 31, PERMS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, PERMS, dtype=np.uint32)


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    part, held = [], 0
    for t in texts:
        if held and held + len(t) > CHUNK:
            out += _shingles(part)
            part, held = [], 0
        part.append(t)
        held += len(t) + 1
    return out + _shingles(part) if part else out


def _shingles(texts: list[bytes]) -> list[np.ndarray]:
    raw = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    ends_at = np.cumsum([len(t) + 1 for t in texts])
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
    first, last = edge[0::2], edge[1::2]
    word = span_hashes(raw, first, last)
    owner = np.searchsorted(ends_at, first, side="right")
    n = len(word) - SHINGLE + 1
    hashes = np.zeros(max(0, n), np.uint64)
    for k in range(SHINGLE if n > 0 else 0):
        hashes += word[k:k + n] * _PLACE[k]
    hashes = mix(hashes)
    whole = owner[:n] == owner[SHINGLE - 1:] if n > 0 else np.zeros(0, bool)
    hashes, owned = hashes[whole], owner[:max(0, n)][whole]
    bounds = np.searchsorted(owned, np.arange(len(texts) + 1))
    words = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        few = words[i + 1] - words[i]
        if 0 < few < SHINGLE:
            short = word[words[i]:words[i + 1]]
            out.append(mix((short * _PLACE[:few]).sum(dtype=np.uint64, keepdims=True) + np.uint64(few)))
        else:
            out.append(np.unique(hashes[bounds[i]:bounds[i + 1]]))
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """PERMS 32-bit minima of each set (sets by permutations); an empty set has the largest value."""
    out = np.full((len(sets), PERMS), 0xFFFFFFFF, np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    a = 0
    while a < len(full):
        z, held = a, 0
        while z < len(full) and (z == a or held + len(sets[full[z]]) <= 1 << 15):
            held += len(sets[full[z]])
            z += 1
        h = (np.concatenate([sets[i] for i in full[a:z]]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate(([0], np.cumsum([len(sets[i]) for i in full[a:z]])[:-1]))
        for p in range(PERMS):
            v = h * _MUL[p] + _ADD[p]
            v ^= v >> np.uint32(15)
            out[full[a:z], p] = np.minimum.reduceat(v * np.uint32(0x2C1B3C6D), starts)
        a = z
    return out


def packed(minima_: np.ndarray) -> np.ndarray:
    """The low BITS of each minimum, packed into 64-bit words."""
    per = 64 // BITS
    low = (minima_ & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(minima_), -1, per)
    return (low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64).astype(np.int64)


def band_keys(minima_: np.ndarray) -> np.ndarray:
    """A bucket key for each band: a hash of its whole minima and its number."""
    rows = minima_.reshape(len(minima_), BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)[None, :].repeat(len(minima_), 0)
    for r in range(ROWS):
        key = mix(key * BASE + rows[:, :, r])
    return key.astype(np.int64)


def _texts(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column]


def with_signatures(docs: DataFrame, text: str = "text", name: str = "sig") -> DataFrame:
    """`docs` with a struct (n, digest, bits, bands); digest, bits and bands are null for an empty set."""
    def sign(b: pa.RecordBatch) -> dict:
        out = {"n": [], "digest": [], "bits": [], "bands": []}
        for a in range(0, b.num_rows, 1000):
            sets = shingles(_texts(b.column(0).slice(a, 1000)))
            m = minima(sets)
            out["n"] += [len(s) for s in sets]
            out["digest"] += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            out["bits"] += [v if len(s) else None for s, v in zip(sets, packed(m).tolist())]
            out["bands"] += [v if len(s) else None for s, v in zip(sets, band_keys(m).tolist())]
        return out

    longs = T.ArrayType(T.LongType())
    fields = T.StructType([T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("bits", longs), T.StructField("bands", longs)])
    return python_column(docs, [text], name, fields, sign)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed low bits: the share of equal fields, corrected for chance."""
    ones = sum(1 << i for i in range(0, 64, BITS))
    ones = ones - (1 << 64) if ones >= 1 << 63 else ones

    def unequal(x: Column) -> Column:
        for k in (1, 2, 4, 8):
            if k < BITS:
                x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        return F.bit_count(x.bitwiseAND(F.lit(ones).cast("long")))

    differ = sum((unequal(a[i].bitwiseXOR(b[i])) for i in range(PERMS * BITS // 64)), F.lit(0))
    chance = 2.0 ** -BITS
    return ((1 - differ / PERMS) - chance) / (1 - chance)


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node of `links` (a, b); comp is the component's smallest node.

    Each round hooks every node to its smallest neighbour, if that is smaller,
    follows the hooks to their roots, and keeps the links between roots.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nodes = None
    links = written(links.where("a <> b").select("a", "b").distinct(), "links")
    while not links.isEmpty():
        hook = both(links).groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up"))
        hook = written(hook, "hooks")
        while True:
            far = hook.alias("x").join(hook.alias("y"), F.col("x.up") == F.col("y.node")) \
                .select("x.node", F.col("y.up").alias("up"), (F.col("x.up") != F.col("y.up")).alias("moved"))
            far = written(far, "hooks")
            hook = far.select("node", "up")
            if far.where("moved").isEmpty():
                break
        if nodes is None:
            nodes = hook.select("node", F.col("up").alias("comp"))
        else:
            nodes = nodes.alias("n").join(hook.alias("h"), F.col("n.comp") == F.col("h.node"), "left") \
                .select("n.node", F.coalesce("h.up", "n.comp").alias("comp"))
        nodes = written(nodes, "components")
        root = hook.alias("h")
        links = links.alias("l").join(root, F.col("l.a") == F.col("h.node")).select(F.col("h.up").alias("a"), "l.b").alias("l") \
            .join(root, F.col("l.b") == F.col("h.node")).select("l.a", F.col("h.up").alias("b")).where("a <> b") \
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = written(links, "links")
    return nodes if nodes is not None else links.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def full_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(digest, set) of each class in `classes` (digest, member: doc_id and text hash), from that member's text."""
    def build(b: pa.RecordBatch) -> dict:
        out = []
        for a in range(0, b.num_rows, 1000):
            out += [s.astype(np.int64) for s in shingles(_texts(b.column(0).slice(a, 1000)))]
        return {"set": out}

    rows = docs.alias("d").join(classes.alias("c"), F.col("d.doc_id").eqNullSafe(F.col("c.member.doc_id")) & (F.xxhash64("d.text") == F.col("c.member.row")))
    fields = T.StructType([T.StructField("set", T.ArrayType(T.LongType()))])
    sets = python_column(rows.select("c.digest", "d.text"), ["text"], "s", fields, build)
    return sets.select("digest", F.col("s.set").alias("set")).dropDuplicates(["digest"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets overlap enough."""
    both = pairs.select("a", "b").join(sets.select(F.col("digest").alias("a"), F.col("set").alias("sa")), "a") \
        .join(sets.select(F.col("digest").alias("b"), F.col("set").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _relabel(comps: DataFrame, links: DataFrame) -> DataFrame:
    """`comps` (node, comp) after the links (a, b) between nodes have joined components."""
    of = lambda e, c: e.alias("e").join(comps.alias("k"), F.col(f"e.{c}") == F.col("k.node"))
    mapped = of(of(links, "a").select(F.col("k.comp").alias("a"), "e.b"), "b").select("e.a", F.col("k.comp").alias("b"))
    merged = components(mapped)
    return written(comps.alias("k").join(merged.alias("m"), F.col("k.comp") == F.col("m.node"), "left")
                   .select("k.node", F.coalesce("m.comp", "k.comp").alias("comp")), "comps")


def _tile_links(percent: int, floor: float):
    """The work of a tile: links that join components, from rows (no, blk, digest, comp, n, bits, bands, set)."""
    ones = np.uint64(sum(1 << i for i in range(0, 64, BITS)))
    chance = 2.0 ** -BITS
    most_unequal = PERMS * (1 - floor) * (1 - chance)

    def links(key, table):
        no = table.column("no")[0].as_py()
        block = table.column("blk").to_numpy()
        digest, n = table.column("digest").to_pylist(), table.column("n").to_numpy()
        root = np.unique(np.array([c.hex() for c in table.column("comp").to_pylist()]), return_inverse=True)[1]
        stack = lambda c: table.column(c).combine_chunks().flatten().to_numpy()
        bits, bands, flat = stack("bits").reshape(len(n), -1).view(np.uint64), stack("bands").reshape(len(n), -1), stack("set").view(np.uint64)
        at = np.concatenate(([0], np.cumsum(n)))
        cross, out = block.min() != block.max(), []
        for i in range(len(n)):
            may = np.arange(i + 1, len(n))
            may = may[(root[may] != root[i]) & (100 * np.minimum(n[may], n[i]) >= percent * np.maximum(n[may], n[i]))]
            if cross:
                may = may[block[may] != block[i]]
            x = bits[may] ^ bits[i]
            for k in (1, 2, 4, 8):
                if k < BITS:
                    x = x | (x >> np.uint64(k))
            may = may[np.bitwise_count(x & ones).sum(axis=1) <= most_unequal]
            may = may[(bands[may] == bands[i]).argmax(axis=1) == no]
            if not len(may):
                continue
            own = flat[at[i]:at[i + 1]]
            theirs = np.concatenate([flat[at[j]:at[j + 1]] for j in may.tolist()])
            found = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
            common = np.add.reduceat(found.astype(np.int64), np.concatenate(([0], np.cumsum(n[may])[:-1])))
            for j in may[100 * common >= percent * (n[i] + n[may] - common)].tolist():
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    out.append((digest[i], digest[j]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})

    return links


def _open(members: DataFrame, comps: DataFrame) -> DataFrame:
    """The rows (no, band, digest, comp) of buckets that hold several components."""
    rows = members.alias("m").join(comps.alias("c"), F.col("m.digest") == F.col("c.node")).select("m.no", "m.band", "m.digest", "c.comp")
    several = rows.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("size")).where("x <> y")
    return rows.join(several.select("band", "size"), "band")


def group_classes(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(node, comp): the component of every class that shares a bucket with another."""
    buckets = classes.select("digest", F.posexplode("bands").alias("no", "band"))
    shared = buckets.groupBy("band").agg(F.count("*").alias("size"), F.min("digest").alias("pivot")).where("size > 1")
    members = written(buckets.join(shared, "band").select("no", "band", "digest", "pivot"), "members")
    bits = classes.join(members.select("digest").distinct(), "digest", "left_semi")
    bits = written(bits.select("digest", "member", "n", "bits", "bands"), "bucket-classes")
    comps = bits.select(F.col("digest").alias("node"), F.col("digest").alias("comp"))
    sets = written(full_sets(docs, bits.select("digest", "member")), "sets")
    share = percent / 100
    floor = share - MARGIN * math.sqrt(share * (1 - share) / PERMS) / (1 - 2.0 ** -BITS)

    # every class with its buckets' pivots; the likeliest is confirmed
    side = lambda c: bits.select(F.col("digest").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"x{c}"))
    pairs = members.where("digest <> pivot").select(F.col("pivot").alias("a"), F.col("digest").alias("b")).distinct()
    best = pairs.join(side("a"), "a").join(side("b"), "b") \
        .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) \
        .select("a", "b", estimate(F.col("xa"), F.col("xb")).alias("guess")).where(F.col("guess") >= floor) \
        .groupBy("b").agg(F.max_by("a", F.struct("guess", "a")).alias("a"))
    comps = _relabel(comps, written(confirmed(written(best, "pairs"), sets, percent), "confirmed"))

    # whatever is left between components that share a bucket
    left = written(_open(members, comps), "open")
    blocks = F.ceil(F.col("size") / TILE)
    rows = left.withColumn("blk", F.pmod(F.hash("digest"), blocks.cast("int"))) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1))) \
        .withColumn("tile", F.least("blk", "other") * blocks + F.greatest("blk", "other"))
    rows = rows.join(bits.select("digest", "n", "bits", "bands"), "digest").join(sets, "digest") \
        .select("band", "tile", "no", "blk", "digest", "comp", "n", "bits", "bands", "set")
    links = rows.groupBy("band", "tile").applyInArrow(_tile_links(percent, floor), "a binary, b binary")
    return _relabel(comps, written(links, "tile-links"))


def _dealt(rows: DataFrame, key: str, by: Column, side: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """`rows` left-joined with `side` (one row a key) on `key`; rows of a frequent key are dealt over copies of its side row.

    counts: (key, m). A key is frequent from max(PLAIN, total / HOT) rows on, so
    there are HOT such keys at most, which are broadcast."""
    most = max(PLAIN, total // HOT)
    hot = F.broadcast(written(counts.where(F.col("m") > most).select(F.col(key), F.ceil(F.col("m") / most).cast("int").alias("copies")), "hot"))
    salted = rows.join(hot, key, "left").withColumn("salt", F.when(F.col("copies").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("copies"))).cast("int")).drop("copies")
    copies = side.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    return salted.join(copies, [key, "salt"], "left").drop("salt")


def grouped(docs: DataFrame, percent: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Signatures (doc_id, row, n, digest) of every row, classes (digest, comp, first, m), components (comp, rep), and the number of rows.

    `row` is the text's hash; first and rep are the least (doc_id is null, doc_id, row) of a class and a component."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = with_signatures(docs).select("doc_id", F.xxhash64("text").alias("row"), "sig.*")
    signed = written(signed, "signatures")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = signed.where("digest is not null").groupBy("digest").agg(
        F.min(place).alias("first"), F.min(F.struct("doc_id", "row")).alias("member"), F.count("*").alias("m"),
        F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")
    comps = group_classes(docs, classes, percent)
    # classes alone in all their buckets stay as they are
    own = classes.select("digest", "first", "m").alias("k").join(comps.alias("c"), F.col("k.digest") == F.col("c.node"), "left") \
        .select("k.digest", "k.first", "k.m", F.coalesce("c.comp", "k.digest").alias("comp"))
    own = written(own, "class-components")
    reps = written(own.groupBy("comp").agg(F.min("first").alias("rep"), F.count("*").alias("m")), "representatives")
    total = classes.agg(F.sum("m")).first()[0] or 0
    return signed.select("doc_id", "row", "n", "digest"), own, reps, total


def _named(own: DataFrame, reps: DataFrame, total: int) -> DataFrame:
    """(digest, rep, alone, m): the representative of every class, and whether it is the class's own first row."""
    j = _dealt(own, "comp", F.col("digest"), reps.select("comp", "rep"), reps.select("comp", "m"), total)
    return written(j.select("digest", "rep", "first", "m"), "named")


def near_groups(docs: DataFrame, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: groups linked by 100 * overlap >= percent * union."""
    signed, own, reps, total = grouped(docs, percent, doc_id, text)
    named = _named(own, reps, total)
    rows = signed.select("doc_id", F.col("n").alias("n_shingles"), "digest", "row")
    some = rows.where("digest is not null")
    by = F.struct("doc_id", "row")
    out = _dealt(some, "digest", by, named.select("digest", "rep"), named.select("digest", "m"), total) \
        .select("doc_id", "n_shingles", F.col("rep.doc_id").alias("group"))
    out = out.unionByName(rows.where("digest is null").select("doc_id", "n_shingles", F.lit(None).cast(out.schema["group"].dataType).alias("group")))
    group = F.coalesce("group", "doc_id")
    return out.select("doc_id", "n_shingles", group.alias("component_id"), F.col("doc_id").eqNullSafe(group).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of each group: the one of the least (doc_id, null ids last, then text hash). Rows without words stay.

    Rows are told apart by doc_id and text: a row whose doc_id another row repeats
    with a different text is judged by itself, rows with a null doc_id are judged
    like others, and of equal rows one stays."""
    signed, own, reps, total = grouped(docs, percent, doc_id, text)
    named = _named(own, reps, total)
    some = signed.where("digest is not null").groupBy("doc_id", "row", "digest").agg(F.count("*").alias("times"))
    keys = _dealt(some, "digest", F.struct("doc_id", "row"), named.select("digest", "rep"), named.select("digest", "m"), total)
    mine = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    keys = written(keys.select("doc_id", "row", "times", (mine == F.col("rep")).alias("first")), "row-keys")
    d, r = free_name(docs, "key_id"), free_name(docs, "key_row")
    key = lambda rows: rows.select(F.col("doc_id").alias(d), F.col("row").alias(r))
    same = F.col(doc_id).eqNullSafe(F.col(d)) & (F.xxhash64(F.col(text)) == F.col(r))
    again = keys.where("first and times > 1")
    out = docs.join(key(keys.where("not first or times > 1")), same, "left_anti")
    if not again.isEmpty():
        cols = [F.first(F.col(f"`{c}`")).alias(c) for c in docs.columns]
        out = out.unionByName(docs.join(key(again), same, "left_semi").groupBy(F.col(doc_id).alias(d), F.xxhash64(F.col(text)).alias(r)).agg(*cols).drop(d, r))
    return out


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the component of every document."""
    return near_groups(load(spark, sf_dir, "documents"))


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{WORD}') AS words FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
k AS (SELECT doc_id, md5(string_agg(gram, chr(10) ORDER BY gram)) AS class FROM g GROUP BY doc_id),
c AS (SELECT class, min(doc_id) AS rep FROM k GROUP BY class),
r AS (SELECT g.doc_id, gram, n FROM g JOIN c ON c.rep = g.doc_id JOIN n ON n.doc_id = g.doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM r a JOIN r b ON a.gram = b.gram AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
t AS (SELECT rep AS a, rep AS b FROM c UNION SELECT t.a, e.b FROM t JOIN e ON e.a = t.b),
m AS (SELECT a AS rep, min(b) AS component FROM t GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component, w.doc_id) AS component_id,
       coalesce(m.component, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id LEFT JOIN c ON c.class = k.class LEFT JOIN m ON m.rep = c.rep
"""

"""Conversation prefix trie: union-find over sorted neighbours' common prefixes, deepest first.

Every turn has a digest; a conversation is the string of its turns' digests.
Distinct strings are range-partitioned and sorted, so that all that share a prefix
stand together. Edges join neighbours, weighted by the turns they share (LCP).
Within a partition, union-find takes edges in descending depth; every merge of two
components creates a branching node, or joins a node of that depth. Nodes that hold
neither the partition's first nor its last string are complete. The others, the left
and right spine, are contracted: one item for each, with the sums of the complete
subtrees below it. Contracted partitions are merged, FAN at a time, by the same
union-find over the items of neighbours, with an edge across each boundary, until
one is left. Nodes between two branching nodes have one child each and are written
out with their lower end. Complete nodes below an open one name it by reference;
references are resolved by joins when all is merged.

Defined cases: rows without conv_id belong to no conversation; null roles and texts
are empty; turns that tie are ordered by their digest, and repeated rows are turns
of their own; conversations of negative id use the remainder's sign of SQL; no
conversation at all gives no row, not even a root.

Scale: a conversation is one row of 32 bytes a turn, its texts are never put
together; equal conversations are counted before the sort, so a hot one is one string;
a hot first turn is split by what follows. The ids of a digest are put in order by
a range sort over all tasks and arrive as joined stretches, as SHA-256 itself can only
be taken in order. A contracted partition is as long as its spines, not as its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.spelling import CRC32_SQL, CRC_TABLE_SQL
from gazette.llm.util import load, written

#: Turns taken over from a base conversation, ids of one base, partitions merged at once (the first two are fixed values).
HEADS, GROUP, FAN = 6, 100, 64
#: Characters of a turn's digest; ids joined in one stretch.
WIDTH, STRETCH = 32, 8192
NOTHING = hashlib.sha256(b"").hexdigest()

_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_ITEM = ["depth", "n", "first", "kids", "leaves", "below", "sha"]
#: Rows of a merge: nodes (with parent_conv_id or up, a reference), references (ref to conv_id or up), a contracted partition.
_OUT = pa.schema([("kind", pa.string()), ("part", pa.int64()), ("ref", pa.string()), ("up", pa.string()),
                  *[(c, pa.string() if c == "ends_sha256" else pa.int64()) for c in _NODE],
                  *[(f"i_{c}", pa.list_(pa.string() if c == "sha" else pa.int64())) for c in _ITEM], ("i_left", pa.int64()),
                  ("first_seq", pa.string()), ("last_seq", pa.string()), ("first_sizes", pa.list_(pa.int64())), ("last_sizes", pa.list_(pa.int64()))])
_OUT_SQL = ", ".join(f"{f.name} " + {"string": "string", "int64": "long", "list<item: int64>": "array<long>", "list<item: string>": "array<string>"}[str(f.type)] for f in _OUT)


class Node:
    """A trie node: what is known of it itself (`n` conversations, their least id, complete children, their leaves and
    saved tokens), its open children, and the items it consists of."""

    __slots__ = ("depth", "n", "first", "kids", "leaves", "below", "sha", "sizes", "lo", "hi", "children", "refs")

    def __init__(self, depth, sizes, lo, hi, n=0, first=None, kids=0, leaves=0, below=0, sha=None, refs=()):
        self.depth, self.sizes, self.lo, self.hi = depth, sizes, lo, hi
        self.n, self.first, self.kids, self.leaves, self.below, self.sha = n, first, kids, leaves, below, sha
        self.children, self.refs = [], list(refs)

    def take(self, child: Node) -> None:
        """Adds the sums of a complete child."""
        self.n, self.first = self.n + child.n, _least(self.first, child.first)
        self.kids, self.leaves = self.kids + 1, self.leaves + max(child.leaves, 1)
        self.below += child.below + (child.n - 1) * sum(child.sizes[self.depth:child.depth])

    def join(self, other: Node) -> None:
        """`other` is the same node, seen from the other side of a boundary."""
        self.n, self.first = self.n + other.n, _least(self.first, other.first)
        self.kids, self.leaves, self.below = self.kids + other.kids, self.leaves + other.leaves, self.below + other.below
        self.sha = self.sha or other.sha
        self.children += other.children
        self.refs += other.refs


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def grown(items: list[Node], lcps: list[int]) -> Node:
    """The top node after all edges: lcps[i] joins items i and i + 1, deepest first."""
    parent, top = list(range(len(items))), list(items)

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in sorted(range(len(lcps)), key=lambda i: -lcps[i]):
        d, ra, rb = lcps[i], find(i), find(i + 1)
        a, b = top[ra], top[rb]
        if a.depth == d:
            node = a
            if b.depth == d:
                a.join(b)
            else:
                a.children.append(b)
        elif b.depth == d:
            node = b
            b.children.append(a)
        else:
            node = Node(d, a.sizes, a.lo, b.hi)
            node.children = [a, b]
        node.lo, node.hi = a.lo, b.hi
        # unites the smaller component with the larger one
        if a.hi - a.lo < b.hi - b.lo:
            ra, rb = rb, ra
        parent[rb] = ra
        top[ra] = node
    return top[find(0)]


def contracted(top: Node, last_item: int, closed: bool, part: int, level: int, rows: list[dict]) -> list[Node]:
    """Appends complete nodes and references to `rows`; returns the open nodes in order: left spine upwards, top, right spine downwards."""
    order, stack = [], [top]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += node.children
    is_open = (lambda v: False) if closed else lambda v: v.lo == 0 or v.hi == last_item
    for v in reversed(order):  # children first
        for child in v.children:
            if not is_open(child):
                v.take(child)
    spine = [v for v in order if is_open(v)]
    left = sorted((v for v in spine if v is not top and v.lo == 0), key=lambda v: -v.depth)
    right = sorted((v for v in spine if v is not top and v.lo != 0), key=lambda v: v.depth)
    spine = [*left, top, *right] if spine else []
    name = {id(v): f"{level}.{part}.{i}" for i, v in enumerate(spine)}
    for v in order:
        up = name.get(id(v))
        rows.extend({"kind": "ref", "ref": ref, "up": up, "conv_id": None if up else v.first} for ref in v.refs)
        for child in v.children:
            if not is_open(child):
                _write(child, v.depth, v.first, up, rows)
    if closed:
        if top.depth:  # no two conversations differ in their first turn
            root = Node(0, [], top.lo, top.hi)
            root.take(top)
            _write(top, 0, root.first, None, rows)
            top = root
        rows.append(_row(top, 0, None, top.kids, top.below, top.sha))
    return spine


def _row(v: Node, depth: int, parent, kids: int, saved: int, sha) -> dict:
    return dict(zip(_NODE, (v.first, depth, parent, v.n, kids, max(v.leaves, 1), saved, sha or NOTHING)), kind="node")


def _write(v: Node, above: int, parent, up, rows: list[dict]) -> None:
    """Rows of node `v` and of the nodes between it and its parent, which have one child each."""
    saved = v.below
    for depth in range(v.depth, above, -1):
        saved += (v.n - 1) * v.sizes[depth - 1]
        end = depth == v.depth
        row = _row(v, depth, v.first, v.kids if end else 1, saved, v.sha if end else None)
        if depth == above + 1:
            row["parent_conv_id"] = None if up else parent
            row["up"] = up
        rows.append(row)


def _summary(spine: list[Node], top: Node, part: int, first: tuple, last: tuple) -> dict:
    out = {f"i_{c}": [getattr(v, c) for v in spine] for c in _ITEM}
    return out | {"kind": "part", "part": part, "i_left": spine.index(top), "first_seq": first[0], "first_sizes": first[1],
                  "last_seq": last[0], "last_sizes": last[1]}


def shared(a: str, b: str) -> int:
    """Turns that two strings of digests begin with alike."""
    lo, hi = 0, min(len(a), len(b)) // WIDTH
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid * WIDTH] == b[:mid * WIDTH]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_OUT)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition of (seq, sizes, n, first, sha) -> its complete nodes, and itself contracted."""
    items, lcps, seq, ends = [], [], None, []
    for b in batches:
        for s, sizes, n, first, sha in zip(*(c.to_pylist() for c in b.columns)):
            if items:
                lcps.append(shared(seq, s))
            items.append(Node(len(s) // WIDTH, sizes, len(items), len(items), n, first, sha=sha))
            seq = s
            ends = [ends[0] if ends else (s, sizes), (s, sizes)]
    rows: list[dict] = []
    if items:
        part = TaskContext.get().partitionId()
        top = grown(items, lcps)
        spine = contracted(top, len(items) - 1, False, part, 0, rows)
        rows.append(_summary(spine, top, part, *ends))
    yield from _table(rows).to_batches(10_000)


def _merge(table: pa.Table, level: int, closed: bool) -> pa.Table:
    """Contracted neighbours -> nodes that are complete now, references, and the neighbours contracted into one."""
    items, lcps, parts = [], [], sorted(table.to_pylist(), key=lambda r: r["part"])
    for k, p in enumerate(parts):
        if k:
            lcps.append(shared(parts[k - 1]["last_seq"], p["first_seq"]))
        for i, values in enumerate(zip(*(p[f"i_{c}"] for c in _ITEM))):
            v = dict(zip(_ITEM, values))
            if i:  # of a node and its parent, the parent's depth
                lcps.append(min(v["depth"], items[-1].depth))
            sizes = p["first_sizes"] if i <= p["i_left"] else p["last_sizes"]
            items.append(Node(sizes=sizes, lo=len(items), hi=len(items), refs=[f"{level - 1}.{p['part']}.{i}"], **v))
    part, rows = parts[0]["part"] // FAN, []
    top = grown(items, lcps)
    spine = contracted(top, len(items) - 1, closed, part, level, rows)
    if not closed:
        ends = [(parts[0]["first_seq"], parts[0]["first_sizes"]), (parts[-1]["last_seq"], parts[-1]["last_sizes"])]
        rows.append(_summary(spine, top, part, *ends))
    return _table(rows)


def digests(members: DataFrame) -> DataFrame:
    """(e, sha): SHA-256 of the ascending ids of each e, comma-joined. `members` has e, conv_id."""
    def stretches(batches):
        key, ids = None, []
        for b in batches:
            rows = []
            for e, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if e != key or len(ids) >= STRETCH:
                    if ids:
                        rows.append((key, ids[0], ",".join(map(str, ids))))
                    key, ids = e, []
                ids.append(c)
            yield _three(rows)
        yield _three([(key, ids[0], ",".join(map(str, ids)))] if ids else [])

    def hashed(batches):
        key, state = None, None
        for b in batches:
            rows = []
            for e, _, text in zip(*(c.to_pylist() for c in b.columns)):
                if e != key:
                    if key is not None:
                        rows.append((key, state.hexdigest()))
                    key, state = e, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield _pairs(rows)
        yield _pairs([(key, state.hexdigest())] if key is not None else [])

    def _three(rows):
        e, c, t = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(e, pa.string()), pa.array(c, pa.int64()), pa.array(t, pa.string())], names=["e", "c", "ids"])

    def _pairs(rows):
        e, s = zip(*rows) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(e, pa.string()), pa.array(s, pa.string())], names=["e", "sha"])

    ordered = members.select("e", "conv_id").repartitionByRange("e", "conv_id").sortWithinPartitions("e", "conv_id")
    joined = ordered.mapInArrow(stretches, "e string, c long, ids string")
    return joined.repartition("e").sortWithinPartitions("e", "c").mapInArrow(hashed, "e string, sha string")


def trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of (conv_id, seq, sizes): distinct ids, digests of the turns joined, code points of the turns' texts."""
    rows = written(conversations.select("conv_id", "seq", "sizes", F.substring(F.sha2("seq", 256), 1, WIDTH).alias("e")), "conversations")
    once = rows.groupBy("e", "seq").agg(F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("first"))
    once = once.join(digests(rows), "e").select("seq", "sizes", "n", "first", "sha")
    out = written(once.repartitionByRange("seq").sortWithinPartitions("seq").mapInArrow(_forest, _OUT_SQL), "forests")
    levels = [out]
    parts = (out.where("kind = 'part'").agg(F.max("part")).first()[0] or 0) + 1
    while True:
        level, closed = len(levels), parts <= FAN
        merge = _merger(level, closed)
        out = out.where("kind = 'part'").groupBy((F.col("part") / FAN).cast("long").alias("g")).applyInArrow(merge, _OUT_SQL)
        out = written(out, "merged")
        levels.append(out)
        if closed:
            break
        parts = -(-parts // FAN)
    known = levels[-1].where("kind = 'ref'").select("ref", "conv_id")
    resolved = known
    for out in reversed(levels[1:-1]):
        refs = out.where("kind = 'ref'")
        below = refs.where("up is not null").select("ref", "up").join(known.select(F.col("ref").alias("up"), "conv_id"), "up").select("ref", "conv_id")
        known = written(refs.where("up is null").select("ref", "conv_id").unionByName(below), "references")
        resolved = resolved.unionByName(known)
    nodes = levels[0]
    for out in levels[1:]:
        nodes = nodes.unionByName(out)
    nodes = nodes.where("kind = 'node'")
    hung = nodes.where("up is not null").drop("parent_conv_id").join(resolved.select(F.col("ref").alias("up"), F.col("conv_id").alias("parent_conv_id")), "up")
    return nodes.where("up is null").select(_NODE).unionByName(hung.select(_NODE))


def _merger(level: int, closed: bool):
    return lambda table: _merge(table, level, closed)


def sequences(turns: DataFrame) -> DataFrame:
    """(base, conv_id, t): the turns of each conversation in order, as digests and sizes. Turns of one base lie in one partition."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, WIDTH)
    c = F.col("conv_id").cast("long")
    slim = turns.where(c.isNotNull()).select((c - c % GROUP).alias("base"), c.alias("conv_id"), F.struct(
        F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"), key.alias("key"), F.length(text).cast("long").alias("size")).alias("t"))
    t = F.transform(F.sort_array(F.collect_list("t")), lambda x: F.struct(x["key"].alias("key"), x["size"].alias("size")))
    return slim.repartition("base").groupBy("base", "conv_id").agg(t.alias("t"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, seq, sizes) of every conversation, begun as the contract says."""
    own = written(sequences(turns), "sequences")
    heads = own.where(F.col("conv_id") == F.col("base")).select("base", F.slice("t", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    none = F.array().cast("array<struct<key:string,size:bigint>>")
    j = own.join(heads, "base", "left").withColumn("h", h)
    t = F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), none), F.slice("t", F.col("h") + 1, F.greatest(F.size("t") - F.col("h"), F.lit(0))))
    j = j.select("conv_id", t.alias("t"))
    return j.select("conv_id", F.array_join(F.transform("t", lambda x: x["key"]), "").alias("seq"), F.transform("t", lambda x: x["size"]).alias("sizes"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every node of the trie of all rebuilt conversations."""
    return trie(rebuilt(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


ORACLE_SQL = f"""
WITH {CRC_TABLE_SQL},
t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         substr(sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, {WIDTH}) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list(k ORDER BY turn NULLS FIRST, k) AS ks, list(length(text) ORDER BY turn NULLS FIRST, k) AS ns FROM t GROUP BY conv_id),
h AS (SELECT own.*, conv_id - conv_id % {GROUP} AS base, ({CRC32_SQL.format("conv_id::VARCHAR")} % {HEADS})::BIGINT AS h FROM own, crc),
r AS (
  SELECT h.conv_id, coalesce(b.ks[1:h.h], []) || h.ks[h.h + 1:] AS ks, coalesce(b.ns[1:h.h], []) || h.ns[h.h + 1:] AS ns
  FROM h LEFT JOIN own b ON b.conv_id = h.base),
m AS (
  SELECT conv_id, d, array_to_string(ks[1:d], '') AS p, CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS size, d = len(ks) AS is_end
  FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM r)),
n AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256 FROM m GROUP BY d, p),
kids AS (SELECT substr(p, 1, {WIDTH} * (d - 1)) AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
below AS (
  SELECT substr(n.p, 1, {WIDTH} * a) AS p, count(*) FILTER (kids.p IS NULL) AS n_leaves, sum((n_convs - 1) * size)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM n) n LEFT JOIN kids ON kids.p = n.p GROUP BY 1)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n_children, 0) AS n_children, below.n_leaves,
       below.saved_tokens, n.ends_sha256
FROM n JOIN below ON below.p = n.p LEFT JOIN kids ON kids.p = n.p LEFT JOIN n up ON n.d > 0 AND up.p = substr(n.p, 1, {WIDTH} * (n.d - 1))
"""

"""Word vectors by token: a store of (token, vec) rows, and n-gram vectors for unknown tokens.

A store is far larger than what one corpus needs, so its rows are cut down where
they are read: the corpus vocabulary becomes a blocked Bloom filter (one 64-bit
word per block, BITS bits of it per token), which is broadcast, and a row whose bits
are not all set is dropped in the scan's stage, before any shuffle. The rows left
(and some 1 % of false ones) are joined by token exactly. A token that the store
lacks gets the mean of the vectors of its character n-grams, looked up the same way
in the store's n-gram table.

Vectors are looked up by token alone: rows of other tokens change no result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits a token sets in its block; bits per token the filter is sized for; its most blocks (16 bytes each).
BITS, BITS_PER_TOKEN, MAX_BLOCKS = 4, 16, 1 << 21
#: Rows whose vectors are laid out at once to be added.
ADDED = 1 << 14
#: Length of the n-grams, over the token with a mark at either end.
GRAM = 3


@dataclass(frozen=True)
class VectorStore:
    """(token, vec) rows, (gram, vec) rows for tokens without one, and the length of a vector.

    Of rows that repeat a token, the least vector counts; rows with a null token
    or vector count as absent.
    """

    tokens: DataFrame
    grams: DataFrame | None
    dim: int


def open_store(tokens: DataFrame, grams: DataFrame | None = None, dim: int | None = None) -> VectorStore:
    """A store over two tables. `dim` is read from the first vector unless given."""
    if dim is None:
        row = tokens.where(F.col("vec").isNotNull()).select(F.size("vec").alias("d")).head(1)
        dim = row[0]["d"] if row else 0
    return VectorStore(tokens, grams, dim)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    """BITS of a block's 64 bits, from a second hash."""
    h = F.xxhash64(F.lit("bits"), key)
    bit = lambda i: F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
    out = None
    for i in range(BITS):
        one = F.call_function("shiftleft", F.lit(1).cast("long"), bit(i))
        out = one if out is None else out.bitwiseOR(one)
    return out


def bloom_filter(keys: DataFrame, col: str) -> tuple[DataFrame, int]:
    """(block, bits) of distinct `keys`, and the number of blocks; MAX_BLOCKS rows of 12 bytes at most."""
    n = keys.count()
    blocks = min(MAX_BLOCKS, max(1, -(-n * BITS_PER_TOKEN // 64)))
    return keys.groupBy(_block(F.col(col), blocks).alias("_block")).agg(F.bit_or(_mask(F.col(col))).alias("_bits")), blocks


def may_contain(rows: DataFrame, col: str, keys: DataFrame, key: str) -> DataFrame:
    """`rows` whose `col` may be among `keys`: every one that is, and few others. The filter is broadcast (bounded), `rows` not shuffled."""
    bits, blocks = bloom_filter(keys, key)
    cond = (_block(F.col(col), blocks) == F.col("_block")) & (F.col("_bits").bitwiseAND(_mask(F.col(col))) == _mask(F.col(col)))
    return rows.join(F.broadcast(bits), cond, "left_semi")


def _looked_up(store: DataFrame, key: str, wanted: DataFrame, col: str) -> DataFrame:
    """(`col`, vec) of the distinct `wanted` keys that the store has."""
    near = may_contain(store.select(F.col(key).alias("_key"), "vec").where("_key is not null and vec is not null"), "_key", wanted, col)
    found = wanted.join(near, F.col(col) == F.col("_key"))
    return found.groupBy(col).agg(F.min(F.col("vec").cast("array<double>")).alias("vec"))


def grams_of(token: Column, n: int = GRAM) -> Column:
    """Distinct n-grams of ``<token>``."""
    marked = F.concat(F.lit("<"), token, F.lit(">"))
    starts = F.sequence(F.lit(1), F.greatest(F.length(marked) - n + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(marked, i, F.lit(n))))


def distinct_grams(tokens: DataFrame, col: str, n: int = GRAM) -> DataFrame:
    """(gram): the n-grams of all ``<token>``, as ``grams_of`` gives them, cut row by row and not as an array per token."""
    marked = tokens.select(F.concat(F.lit("<"), F.col(col), F.lit(">")).alias("_m"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("_m") - n + 1, F.lit(1)))
    return marked.select("_m", F.explode(starts).alias("_i")).select(F.substr("_m", F.col("_i"), F.lit(n)).alias("gram")).distinct()


def block_sums(keys: list[str], dim: int):
    """(keys + lemma, _lemma + vec) of a block -> keys + (vsum, n_vec), for `cogroup`; every vec has `dim` components.

    As SUM does, null components are left out, and a component that all vectors lack is null."""
    def sums(tokens: pa.Table, vectors: pa.Table) -> pa.Table:
        at = pc.index_in(tokens["lemma"], value_set=vectors["_lemma"].combine_chunks())
        tokens, at = tokens.select(keys).filter(at.is_valid()), at.drop_null().to_numpy()
        group = np.zeros(len(at), np.int64)
        for k in keys:
            codes = tokens[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            group = np.unique(group * (len(at) + 1) + codes, return_inverse=True)[1]
        order = np.argsort(group, kind="stable")
        group, at = group[order], at[order]
        begins = np.flatnonzero(np.diff(group, prepend=-1))
        flat = pc.list_flatten(vectors["vec"].combine_chunks()) if len(at) else pa.array([], pa.float64())
        parts = [flat.fill_null(0.0)] + ([flat.is_valid().cast(pa.float64())] if flat.null_count else [])
        total, there = [*(_added(p.to_numpy(zero_copy_only=False).reshape(-1, max(dim, 1)), at, group, len(begins)) for p in parts), None][:2]
        values = pa.array(total[:, :dim].ravel(), mask=None if there is None else there[:, :dim].ravel() == 0)
        offsets = pa.array(np.arange(len(begins) + 1) * dim, pa.int32())
        n_vec = pa.array(np.diff(np.append(begins, len(at))), pa.int64())
        return pa.table({**{k: tokens[k].take(pa.array(order[begins])) for k in keys}, "vsum": pa.ListArray.from_arrays(offsets, values), "n_vec": n_vec})

    return sums


def _added(rows: np.ndarray, at: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Sums of `rows[at]` by ascending `group`, ADDED rows at a time."""
    out = np.zeros((groups, rows.shape[1]))
    for i in range(0, len(at), ADDED):
        g = group[i:i + ADDED]
        begins = np.flatnonzero(np.diff(g, prepend=-1))
        out[g[begins]] += np.add.reduceat(rows[at[i:i + ADDED]], begins)
    return out


def lemma_vectors(lemmas: DataFrame, store: VectorStore) -> DataFrame:
    """(lemma, vec array<double>) of the distinct lemmas that the store, or its n-grams, know; written once."""
    from ..session import cut_lineage
    vocab = cut_lineage(lemmas.select("lemma").where("lemma is not null").distinct())
    known = cut_lineage(_looked_up(store.tokens, "token", vocab, "lemma"))
    if store.grams is None:
        return known
    parts = cut_lineage(vocab.join(known.select("lemma"), "lemma", "left_anti").select("lemma", F.explode(grams_of(F.col("lemma"))).alias("gram")))
    vectors = _looked_up(store.grams, "gram", parts.select("gram").distinct(), "gram")
    # a lemma's distinct n-grams are few: their vectors are added as arrays, in the order of the n-grams
    own = parts.join(vectors, "gram").groupBy("lemma").agg(F.array_sort(F.collect_list(F.struct("gram", "vec"))).alias("_g"))
    zero = F.array_repeat(F.lit(0.0), store.dim)
    total = F.aggregate("_g", zero, lambda acc, g: F.zip_with(acc, g["vec"], lambda x, y: x + y))
    mean = F.transform(total, lambda x: x / F.size("_g"))
    return cut_lineage(known.unionByName(own.select("lemma", mean.alias("vec"))))

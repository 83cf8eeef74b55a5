"""Near-duplicate groups at an exact shingle similarity of 0.8, found by wide SimHashes compared bit-sliced.

A radius that stands for a similarity of 0.8 is a sixth of a fingerprint's bits, too many for the block files of
:mod:`simhash`. Here the fingerprint has 256 bits, and documents are filed under sixteen keys, each of four minimum
hashes of their shingles: two texts of similarity 0.8 share a key with probability 0.9998. Inside a file every pair is
compared by :func:`simhash.bit_sliced_links` at ``RADIUS`` bits. Two sets of equal size and similarity J differ in
256 * acos(2J / (1 + J)) / pi bits on average: 39 at 0.8, 49 at 0.7, 68 at 0.5, with a deviation of 5 to 7.

That is a filter only. The components of its links meet once more, with their whole shingle sets (32-bit hashes), and
there a pair is linked only if its Jaccard similarity is ``SIMILAR`` or more. Nodes are distinct sets.

A file of more than ``HOT`` fingerprints is dealt into blocks, and every two blocks meet in one task: whole, and in
bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave.llm import arrow_text as A
from ledgerweave.llm import simhash
from ledgerweave.operators.components import connected_components
from ledgerweave.plans.checkpoint import cut

LANES = 4
RADIUS = 60
SIMILAR = 0.8
BANDS = 16
BAND_ROWS = 4
HOT = 4096
CHUNK = 1 << 15

_RNG = np.random.Generator(np.random.PCG64(20240608))
_LANE_KEYS = _RNG.integers(0, 1 << 63, (2, LANES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIN_KEYS = _RNG.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FIELDS = [f"f{i}" for i in range(LANES)]
SIGNATURE = T.StructType([*[T.StructField(f, T.LongType()) for f in _FIELDS], T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("shingles", T.BinaryType())])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, and the rows' offsets in them; a shorter text is one shingle."""
    low = A.LOWER[data]
    starts, ends, row = A.words(low, offsets, ~A.SPACE)
    words = A.word_hashes(low, starts, ends)
    at = np.searchsorted(row, np.arange(len(offsets)))
    count = np.diff(at)
    hashes = A.mix64(A.grams(words, size))
    inside = np.arange(len(hashes)) + size <= np.repeat(at[1:], count)[: len(hashes)]
    own = row[: len(hashes)][inside]
    hashes = hashes[inside]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        n = count[short]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        values = words[place + np.repeat(at[short], n)] * A.powers(size)[place]
        own = np.concatenate((own, short))
        hashes = np.concatenate((hashes, A.mix64(np.add.reduceat(values, first) + n.astype(np.uint64))))
    order = np.lexsort((hashes, own))
    own, hashes = own[order], hashes[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1])
    own, hashes = own[new], hashes[new]
    return hashes, np.searchsorted(own, np.arange(len(offsets)))


def signatures(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (rows x LANES) and band keys (rows x BANDS); rows without shingles get zeros."""
    rows = len(at) - 1
    ones = np.zeros((rows, 64 * LANES), np.int64)
    lowest = np.full((rows, BANDS * BAND_ROWS), ~np.uint64(0))
    for begin in range(0, len(hashes), CHUNK):
        part = hashes[begin : begin + CHUNK]
        lo = int(np.searchsorted(at, begin, "right")) - 1
        hi = int(np.searchsorted(at, begin + len(part), "left"))
        edge = np.clip(at[lo : hi + 1] - begin, 0, len(part))
        full = np.flatnonzero(np.diff(edge) > 0)
        mine, cuts = lo + full, edge[full]
        lanes = A.mix64(part[:, None] * _LANE_KEYS[0] + _LANE_KEYS[1]).astype("<u8")
        bits = np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little")
        ones[mine] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
        for k, key in enumerate(_MIN_KEYS):
            lowest[mine, k] = np.minimum(lowest[mine, k], np.minimum.reduceat(part * key, cuts))
    size = np.diff(at)
    prints = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view("<u8").astype(np.uint64)
    folded = lowest.reshape(rows, BANDS, BAND_ROWS)
    keys = np.zeros((rows, BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * A.BASE
    for j in range(BAND_ROWS):
        keys = A.mix64(keys * A.BASE + folded[:, :, j])
    return prints, keys


def wide_fingerprints(docs: DataFrame, text: str, into: str, words: int = 5, keep: list[str] | None = None) -> DataFrame:
    """Append struct ``into`` of the fingerprint's four longs, its band keys and its shingles' 32-bit hashes."""

    def fn(data: np.ndarray, offsets: np.ndarray) -> list:
        hashes, at = shingle_sets(data, offsets, words)
        prints, keys = signatures(hashes, at)
        raw = (hashes >> np.uint64(32)).astype("<u4").tobytes()
        packed = pa.array([raw[4 * s : 4 * e] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
        starts = pa.array(np.arange(len(offsets)) * BANDS, pa.int32())
        return [*[pa.array(prints[:, i].view(np.int64)) for i in range(LANES)], pa.ListArray.from_arrays(starts, pa.array(keys.ravel().view(np.int64))), packed]

    return A.annotate(docs, text, into, SIGNATURE, fn, keep)


def alike(a: bytes, b: bytes, similar: float = SIMILAR) -> bool:
    """Whether two packed shingle sets have a Jaccard similarity of ``similar`` or more."""
    if min(len(a), len(b)) < similar * max(len(a), len(b)) - 64:  # sizes alone rule it out, with room for equal hashes
        return False
    x, y = np.unique(np.frombuffer(a, "<u4")), np.unique(np.frombuffer(b, "<u4"))
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common >= similar * (len(x) + len(y) - common) - 1e-9


def _compare(radius: int, exact: bool = False):
    """Links of rows (key, pair, node, f0..f3, and shingles if ``exact``) sorted by key and pair."""
    most = 1 << 13 if exact else 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0

        def flush(cols: list[np.ndarray], to: int) -> pa.RecordBatch:
            key, other, node = (c[:to] for c in cols[:3])
            group = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (other[1:] != other[:-1]))))
            agree = (lambda i, j: alike(cols[-1][i], cols[-1][j])) if exact else None
            a, b = simhash.bit_sliced_links(np.stack([c[:to] for c in cols[3 : 3 + LANES]], 1), group, radius, agree)
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)])
            rows += batch.num_rows
            if rows < most:
                continue
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            new = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
            if len(new):  # the last file may go on in the next batch
                to = int(new[-1]) + 1
                yield flush(cols, to)
                cols = [c[to:] for c in cols]
            held, rows = [cols], len(cols[0])
        if rows:
            yield flush([np.concatenate(x) for x in zip(*held, strict=True)], rows)

    return run


def _file_links(filed: DataFrame, radius: int, hot: int, exact: bool = False) -> DataFrame:
    """``filed``: key, node, f0..f3 (and shingles). Links ``a, b`` that join all pairs of one key within the radius."""
    carried = ["node", *_FIELDS, *(["shingles"] if exact else [])]
    crowded = filed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    filed = filed.join(crowded, "key")
    small = filed.where(F.col("members") <= hot).select("key", F.lit(-1).cast("long").alias("pair"), *carried)
    blocks = F.ceil(F.col("members") / F.lit(hot / 2))
    mine = F.pmod(F.xxhash64(F.lit("block"), "node"), blocks)
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    large = filed.where(F.col("members") > hot).select("key", *carried, blocks.alias("n"), mine.alias("i"), other.alias("j"))
    large = large.select("key", (F.least("i", "j") * F.col("n") + F.greatest("i", "j")).alias("pair"), *carried)
    dealt = small.unionByName(large).repartition("key", "pair").sortWithinPartitions("key", "pair")
    return dealt.mapInArrow(_compare(radius, exact), "a long, b long").distinct()


def wide_links(marked: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """``marked``: node, f0..f3, keys. Links ``a, b`` of nodes that join all pairs of one file within the radius."""
    distinct = marked.groupBy("node", "keys").agg(*[F.min(f).alias(f) for f in _FIELDS])
    return _file_links(distinct.select(F.explode("keys").alias("key"), "node", *_FIELDS), radius, hot)


def exact_links(marked: DataFrame, candidates: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Links ``a, b`` of nodes of one component of ``candidates`` (node, component) that are :func:`alike`."""
    # merged at every size: a plan that broadcasts small candidates would shuffle by another power of the input later
    members = marked.join(candidates.hint("merge"), "node").groupBy("node").agg(F.min("component").alias("key"), *[F.min(f).alias(f) for f in _FIELDS], F.min("shingles").alias("shingles"))
    return _file_links(members, radius, hot, True)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, radius: int = RADIUS) -> DataFrame:
    """The documents of which no other in their group has a smaller id; all columns are kept.

    Groups are the components of texts whose sets of ``words``-word shingles have a similarity of ``SIMILAR`` or more;
    pairs are looked for among fingerprints that differ in at most ``radius`` bits.
    Texts without a word have the empty set and form one group; texts of fewer words are one shingle. Rows of one
    id and text are one document: of exact repeats one stays. A row of null id stays only if its whole group has none,
    one row then. An empty table gives an empty result.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashed = [*columns, *[c.isNull() for c in columns]]
    names = [A.fresh(docs.columns, f"simhash_row{i}") for i in (1, 2)]
    rows = docs.select(*columns, F.xxhash64(*hashed).alias(names[0]), F.xxhash64(F.lit("second"), *hashed).alias(names[1]))
    # who stays is decided on narrow rows; the text is shuffled once, to the rows chosen
    narrow = rows.select(F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), *[F.col(n).alias(k) for n, k in zip(names, ("h1", "h2"), strict=True)]).alias("rank"), F.col(f"`{text}`").alias("body"))
    marked = wide_fingerprints(narrow, "body", "mark", words, ["rank"])
    marked = cut(marked.select("rank", F.xxhash64("mark.shingles").alias("node"), "mark.*"))
    candidates = connected_components(wide_links(marked.drop("rank", "shingles"), radius), "a", "b")
    labels = connected_components(exact_links(marked.drop("rank", "keys"), candidates, radius), "a", "b")
    lowest = marked.groupBy("node").agg(F.min("rank").alias("rank"))
    grouped = lowest.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    chosen = grouped.groupBy("component").agg(F.min("rank").alias("rank")).select(*[F.col(f"rank.{k}").alias(n) for n, k in zip(names, ("h1", "h2"), strict=True)])
    kept = rows.join(chosen, names, "left_semi").groupBy(*names).agg(F.first(F.struct(*columns)).alias("row"))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])

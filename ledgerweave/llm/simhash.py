"""SimHash near-duplicate groups with exact bit-sliced comparison.

Fingerprints are 64-bit SimHashes of word shingles. Two of them differ in at most ``radius`` = 3 bits only if three
of their six bit blocks agree, so each distinct fingerprint is filed under the twenty choices of three blocks (about
32 bits each). Inside a file the fingerprints are stored as vertical bit planes; all pairs at one lag are compared at
once by XORing each plane with itself shifted, counting differences in carry-save bit counters, and stopping as soon
as every pair of the block has passed the radius. Only links that join two local components leave a task, so a group
of m gives at most m - 1 rows. A file that holds more than ``HOT`` fingerprints is split by a second pigeonhole over
the bits it has not fixed, which loses no link.

Defined cases: a null, empty or word-less text has fingerprint zero and is linked like any other; equal texts share a
fingerprint; rows with equal ids keep one output row each; rows of null id take part, but only non-null ids can name a
component (null if it has none); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave.llm import arrow_text as A
from ledgerweave.operators.components import connected_components
from ledgerweave.plans.checkpoint import cut

RADIUS = 3
SEED = 42
HOT = 2048
#: Six blocks that cover the 64 bits.
BLOCKS = [(0, 11), (11, 22), (22, 33), (33, 44), (44, 54), (54, 64)]


def shingle_fingerprint(raw: bytes, size: int) -> int:
    """SimHash of the shingles of ``size`` words; ties and minorities give 0 bits."""
    words = raw.lower().split()  # on bytes: A-Z only, and the six ASCII white-space bytes only
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(size, len(words))
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[s:e], SEED) for s, e in spans), np.uint64, len(words) - size + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 16)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", into: str = "simhash", words: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Append a struct column with the long ``bits``."""

    def fn(data: np.ndarray, offsets: np.ndarray) -> list:
        raw = data.tobytes()
        values = [shingle_fingerprint(raw[s:e], words) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return [np.array(values, np.uint64).view(np.int64)]

    return A.annotate(docs, text, into, T.StructType([T.StructField("bits", T.LongType())]), fn, keep)


def _within(planes: list[int], lag: int, todo: int, radius: int) -> int:
    """Which of the pairs ``todo`` at one lag differ in at most ``radius`` planes.

    Counters begin so high that ``radius`` + 1 differences overflow them. A level adds its carries two at a time in a
    full adder; the one that waits is added at the end, and before the pairs are looked at for abandoning the block.
    """
    levels = (radius + 1).bit_length() if (radius + 1) & radius else radius.bit_length()
    start = (1 << levels) - 1 - radius
    count = [todo if start >> k & 1 else 0 for k in range(levels)]
    waits: list[int | None] = [None] * levels
    over = 0

    def add(carry: int, k: int) -> None:
        nonlocal over
        while k < levels:
            other = waits[k]
            if other is None:
                waits[k] = carry
                return
            waits[k] = None
            both = other ^ carry
            count[k], carry = count[k] ^ both, (count[k] & both) | (other & carry)
            k += 1
        over |= carry

    def settle() -> None:
        nonlocal over
        for k in range(levels):
            if waits[k] is not None:
                carry, waits[k] = waits[k], None
                for j in range(k, levels):
                    count[j], carry = count[j] ^ carry, count[j] & carry
                over |= carry

    step = 4 * max(1, radius // 8)
    for b, plane in enumerate(planes):
        add((plane ^ (plane >> lag)) & todo, 0)
        if (b + 1) % step == 0:
            settle()
            todo &= ~over
            if not todo:
                return 0
    settle()
    return todo & ~over


def bit_sliced_links(values: np.ndarray, groups: np.ndarray, radius: int = RADIUS, agree: Callable[[int, int], bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the graph of values in one group at ``radius`` bits or fewer.

    Values are 64 bits, or rows of several. ``groups`` must be sorted. Every pair is compared unless both ends are connected already; the result is a forest
    whose components are those of the full graph of each group. A pair for which ``agree`` (given the rows' numbers) is
    false is no link.
    """
    n = len(values)
    edge = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1]))) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate((edge, [n])))
    order = np.argsort(-sizes, kind="stable")
    sizes, edge = sizes[order], edge[order]
    index = np.repeat(edge - (np.cumsum(sizes) - sizes), sizes) + np.arange(n)
    own = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    bits = values[index].view(np.uint64).reshape(n, -1)
    planes: list[int] = []
    parent = np.arange(n)
    left_in = sizes - 1  # links each group still lacks
    out_a, out_b = [], []

    def as_int(mask: np.ndarray) -> int:
        return int.from_bytes(np.packbits(mask, bitorder="little").tobytes(), "little")

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    active = int(ends[np.searchsorted(-sizes, -1, "left") - 1]) if n and sizes[0] > 1 else 0
    planes = [as_int((bits[:active, lane] >> np.uint64(b)) & np.uint64(1) != 0) for lane in range(bits.shape[1]) for b in range(64)]
    for lag in range(1, int(sizes[0]) if n else 0):
        larger = int(np.searchsorted(-sizes, -lag, "left"))  # groups with more than lag members
        if not larger or not left_in[:larger].any():
            break
        top = int(ends[larger - 1])
        same = (own[lag:top] == own[: top - lag]) & (left_in[own[: top - lag]] > 0)
        if not same.any():
            continue
        near = _within(planes, lag, as_int(same), radius)
        if not near:
            continue
        hits = np.flatnonzero(np.unpackbits(np.frombuffer(near.to_bytes((top + 7) // 8, "little"), np.uint8), bitorder="little"))
        for i in hits[parent[hits] != parent[hits + lag]].tolist():
            a, b = root(i), root(i + lag)
            if a != b and (agree is None or agree(int(index[i]), int(index[i + lag]))):
                parent[max(a, b)] = min(a, b)
                left_in[own[i]] -= 1
                out_a.append(i)
                out_b.append(i + lag)
        flat = parent[parent]
        while (flat != parent).any():
            parent, flat = flat, flat[flat]
    return index[np.array(out_a, np.int64)], index[np.array(out_b, np.int64)]


def _links(files: DataFrame) -> DataFrame:
    """files: part, key, bits (distinct in a key). Returns links a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = 0

        def flush(part: np.ndarray, key: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
            group = np.cumsum(np.concatenate(([0], (part[1:] != part[:-1]) | (key[1:] != key[:-1]))))
            a, b = bit_sliced_links(bits, group)
            return pa.RecordBatch.from_arrays([pa.array(bits[a]), pa.array(bits[b])], ["a", "b"])

        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
            rows += batch.num_rows
            if rows < 1 << 18:
                continue
            part, key, bits = (np.concatenate(x) for x in zip(*held, strict=True))
            new = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1]))
            if len(new):  # the last key may go on in the next batch
                at = int(new[-1]) + 1
                yield flush(part[:at], key[:at], bits[:at])
                held, rows = [(part[at:], key[at:], bits[at:])], len(part) - at
        if rows:
            yield flush(*(np.concatenate(x) for x in zip(*held, strict=True)))

    dealt = files.repartition("part", "key").sortWithinPartitions("part", "key", "bits")
    return dealt.mapInArrow(run, "a long, b long")


def _mask(blocks: tuple[tuple[int, int], ...]) -> int:
    value = sum(((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in blocks)
    return value - (1 << 64) if value >> 63 else value


def _second_masks(blocks: tuple[tuple[int, int], ...]) -> list[int]:
    """Four parts of the bits outside ``blocks``: one of them agrees if at most three bits differ."""
    free = [b for lo, hi in BLOCKS if (lo, hi) not in blocks for b in range(lo, hi)]
    out = []
    for i in range(RADIUS + 1):
        value = sum(1 << b for b in free[i :: RADIUS + 1])
        out.append(value - (1 << 64) if value >> 63 else value)
    return out


def near_links(distinct: DataFrame, bits: str = "bits", hot: int = HOT) -> DataFrame:
    """Links ``a, b`` that join all distinct 64-bit values within three bits of each other into their components."""
    choices = list(combinations(BLOCKS, RADIUS))
    filed = distinct.select(F.col(bits).alias("bits")).select(
        F.inline(F.array(*[F.struct(F.lit(i).alias("part"), F.col("bits").bitwiseAND(F.lit(_mask(c))).alias("key"), F.col("bits")) for i, c in enumerate(choices)]))
    )
    crowded = filed.groupBy("part", "key").agg(F.count("*").alias("members")).where(F.col("members") > 1)
    filed = filed.join(crowded, ["part", "key"])
    cold = filed.where(F.col("members") <= hot).select("part", "key", "bits")
    seconds = F.array(*[F.array(*[F.lit(m) for m in _second_masks(c)]) for c in choices])
    split = (
        filed.where(F.col("members") > hot)
        .select("part", "key", "bits", F.posexplode(F.element_at(seconds, F.col("part") + 1)).alias("j", "m"))
        .select((F.lit(100) + F.col("part") * 4 + F.col("j")).alias("part"), F.xxhash64("key", F.col("bits").bitwiseAND(F.col("m"))).alias("key"), "bits")
    )
    return _links(cold.unionByName(split)).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """One row per document: the id, ``bits`` (signed 64-bit fingerprint) and ``component`` (smallest id reachable)."""
    marked = fingerprints(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("body")), "body", "simhash", words, ["id"])
    marked = cut(marked.select("id", F.col("simhash.bits").alias("bits")))
    distinct = marked.groupBy("bits").agg(F.min("id").alias("low"))
    labels = connected_components(near_links(distinct), "a", "b")
    grouped = distinct.join(labels.withColumnRenamed("node", "bits"), "bits", "left").withColumn("component", F.coalesce("component", "bits"))
    lowest = grouped.groupBy("component").agg(F.min("low").alias("first"))
    named = grouped.join(lowest, "component").select("bits", F.col("first").alias("component"))
    return marked.join(named, "bits").select(F.col("id").alias(id_col), "bits", "component")

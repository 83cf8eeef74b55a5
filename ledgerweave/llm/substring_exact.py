"""Exact substring deduplication with suffix arrays over content shards.

Every byte covered by a string of ``length`` = 200 bytes that starts at two or more places is removed. A window of
that length is owned by its rightmost minimal 64-byte gram, which depends on the window's bytes alone, so equal
windows meet under equal grams. Consecutive windows with one owner form a piece. Then:

1. a scan emits the pieces (owner hash, hash of the whole piece, place), reading texts in overlapping stretches;
2. owners that occur once are dropped (partial counts, then a semi join that can split a hot owner);
3. equal pieces are counted by partial aggregation, so thousands of copies become one row with a count;
4. one copy of each piece goes to a content shard, the shard of its owner; adjoining pieces of one text whose owners
   have no other piece go there as one stretch. A shard is suffix-sorted by induced sorting; equal windows are runs of
   the array whose permuted common prefixes reach the length, and a run that stands for two or more places repeats;
5. an owner with more than ``HOT`` different pieces (a passage in a large share of all documents, with other text
   around it) is divided first: its windows are dealt out by their distance to the gram, ``BLOCK`` distances at a
   time, and the bytes that all windows at these distances have; what is still hot is dealt out window by window. Equal
   windows stay together and are counted again, and the parts are sorted like any other shard. Its pieces come from a
   second scan that knows the hot owners' hashes (there is at most one to 1024 different pieces), not from the texts'
   exchange, which would be made once more as soon as one owner is hot;
6. the repeated ranges return to the documents by piece, and are cut out.

Pieces of repeated owners are written once to the shared folder; both joins with the text read one exchange. Only the
hot owners' hashes are collected, up to ``LISTED``. The joins with texts and pieces are merged at every size.

Defined cases: null text counts as empty; texts shorter than the length are returned whole; rows equal in id and text
are repeats of each other; ids may be null or repeated; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave.llm import arrow_text as A
from ledgerweave.llm.suffix_array import common_prefixes, suffix_array
from ledgerweave.plans.checkpoint import cut

LENGTH = 200
GRAM = 64
HOT = 1024
LISTED = 1 << 20  # hot owners that are named to the executors, 8 bytes each; beyond it the texts are exchanged once more
BLOCK = 8
SHARD_BYTES = 1 << 19  # sorting takes about 60 bytes for each
SCAN_BYTES = 1 << 18  # and the scan about 90
PIECES = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("c", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("p", T.LongType())]))


def owners(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Pieces of all rows: row, first window, windows, gram hash, and a hash of the piece's bytes."""
    empty = (np.zeros(0, np.int64),) * 5
    n = len(data)
    if n < length:
        return empty
    width = length - gram + 1
    hashes = A.mix64(A.grams(A.BYTE_KEYS[data], gram))
    m = len(hashes)
    pad = -m % width
    high = np.concatenate((hashes, np.full(pad, ~np.uint64(0), np.uint64)))
    blocks = high.reshape(-1, width)
    right = np.minimum.accumulate(blocks, 1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    count = m - width + 1
    low = np.minimum(left[:count], right[width - 1 : width - 1 + count])
    # windows that lie in one row
    starts = np.arange(count)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:count]
    inside = starts + length <= offsets[row + 1]
    # the rightmost place of the minimum: the last gram equal to it that the window holds
    change = np.ones(count, bool)
    change[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(change)
    # a further occurrence of the minimum that enters becomes the rightmost
    entering = np.flatnonzero(hashes[width - 1 : width - 1 + count] == low)
    begin = np.union1d(at, entering)
    begin = np.union1d(begin, np.flatnonzero(inside[1:] & ~inside[:-1]) + 1)
    stop = np.append(begin[1:], count)
    last = offsets[row[begin] + 1] - length + 1
    stop = np.minimum(stop, last)
    good = stop > begin
    begin, stop = begin[good], stop[good]
    pieces = _range_hashes(A.BYTE_KEYS[data], begin, stop + length - 1)
    return row[begin], begin - offsets[row[begin]], stop - begin, low[begin].view(np.int64), pieces.view(np.int64)


def scanned(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, limit: int = SCAN_BYTES) -> tuple[np.ndarray, ...]:
    """:func:`owners` of runs of short rows, and of long rows in stretches of ``limit`` windows that divide pieces.

    Memory does not grow with a text, and a text has the same pieces whatever rows are beside it.
    """
    made = [owners(data[:0], offsets[:1], length, gram)]
    lo = 0
    while lo < len(offsets) - 1:
        begin = int(offsets[lo])
        hi = max(lo + 1, int(np.searchsorted(offsets, begin + limit, "right")) - 1)
        end = int(offsets[hi])
        for a in range(begin, max(begin + 1, end - length + 1), limit if hi == lo + 1 else end - begin):
            part = data[a : min(a + limit + length - 1, end)]
            row, s, c, h, p = owners(part, np.minimum(offsets[lo : hi + 1] - begin, len(part)), length, gram)
            made.append((row + lo, s + a - begin, c, h, p))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*made, strict=True))


def _range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of values, from hashes of power-of-two blocks."""
    span, power, width = values, np.uint64(0xD6E8FEB86659FD93), 1
    total = np.zeros(len(start), np.uint64)
    at, size = start.copy(), end - start
    while True:
        use = np.flatnonzero(size & width)
        total[use] = total[use] * power + span[at[use]]
        at[use] += width
        if width * 2 > int(size.max(initial=0)):
            return A.mix64(total + size.astype(np.uint64))
        span = span[:-width] * power + span[width:]
        power = A.squared(power)
        width *= 2


def sorted_repeats(bodies: list[bytes], segments: list[list[tuple[int, int, int]]], length: int) -> list[list[np.ndarray]]:
    """For each segment (first window, windows, count) of each body, which of its windows occur twice or more.

    A window occurs as often as its segment counts, in all bodies together. Segments of a body do not overlap.
    """
    sizes = np.array([len(b) + 1 for b in bodies])
    flat = np.frombuffer(b"\x00".join(bodies) + b"\x00", np.uint8).astype(np.int32) + 2
    ends = np.cumsum(sizes)
    flat[ends - 1] = 1
    s = np.append(flat, np.int32(0))
    sa = suffix_array(s)
    plcp = common_prefixes(s, sa, 1)
    times = np.zeros(len(s), np.int64)
    for begin, parts in zip((ends - sizes).tolist(), segments, strict=True):
        for o, c, m in parts:
            times[begin + o : begin + o + c] = m
    # groups of equal windows are runs of the array
    run = np.cumsum(plcp[sa] < length, dtype=np.int32)
    mine = times[sa] > 0
    run, at = run[mine], sa[mine]
    weight = np.bincount(run, times[at].astype(float))
    repeated = np.zeros(len(s), bool)
    repeated[at] = weight[run] > 1
    return [[repeated[b + o : b + o + c] for o, c, _ in parts] for b, parts in zip((ends - sizes).tolist(), segments, strict=True)]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


RANGES = "h long, p long, ranges array<struct<a:int,b:int>>"
#: Text to sort: the owner that places it, its number of different pieces, and the pieces in it.
ROWS = "h long, kinds long, body binary, segs array<struct<o:int,c:int,m:long,h:long,p:long>>"
_SEGS = pa.list_(pa.struct([("o", pa.int32()), ("c", pa.int32()), ("m", pa.int64()), ("h", pa.int64()), ("p", pa.int64())]))


def _bodies(length: int, shard_bytes: int):
    """Rows (whole, list of s, c, h, p, m, kinds) to ROWS; adjoining pieces without rivals share a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for whole, pieces in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                text = memoryview(whole.as_buffer())
                held: list[dict] = []

                def close() -> None:
                    if held:
                        first, last = held[0]["s"], held[-1]["s"] + held[-1]["c"] + length - 1  # noqa: B023
                        segs = [{"o": x["s"] - first, "c": x["c"], "m": x["m"], "h": x["h"], "p": x["p"]} for x in held]  # noqa: B023
                        out.append((held[0]["h"], held[0]["kinds"], bytes(text[first:last]), segs))  # noqa: B023
                        held.clear()  # noqa: B023

                for x in sorted(pieces, key=lambda x: x["s"]):
                    near = held and x["kinds"] == held[0]["kinds"] == 1 and x["s"] == held[-1]["s"] + held[-1]["c"]
                    if not near or x["s"] + x["c"] - held[0]["s"] > shard_bytes // 2:
                        close()
                    held.append(x)
                close()
                if len(out) > 2000:
                    yield _as_rows(out)
                    out = []
            yield _as_rows(out)

    return run


def _as_rows(out: list[tuple]) -> pa.RecordBatch:
    h, kinds, body, segs = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(kinds, pa.int64()), pa.array(body, pa.binary()), pa.array(segs, _SEGS)], ["h", "kinds", "body", "segs"])


def _shard_sort(length: int, shard_bytes: int):
    """ROWS sorted by owner to RANGES: runs of whole owners, of ``shard_bytes`` or of one owner, are suffix-sorted."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        seen: set[tuple[int, int]] = set()  # a row of a repeated id comes once for each of its texts' copies
        rows = [x for x in rows if (k := (x[1][0]["h"], x[1][0]["p"])) not in seen and not seen.add(k)]
        masks = sorted_repeats([x[0] for x in rows], [[(g["o"], g["c"], g["m"]) for g in x[1]] for x in rows], length)
        h, p, ranges = [], [], []
        for (_, segs), each in zip(rows, masks, strict=True):
            for g, mask in zip(segs, each, strict=True):
                if mask.any():
                    h.append(g["h"])
                    p.append(g["p"])
                    ranges.append([{"a": a, "b": b + length - 1} for a, b in zip(*(x.tolist() for x in runs(mask)), strict=True)])
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(p, pa.int64()), pa.array(ranges, kind)], ["h", "p", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # whole owners
        owner: list[tuple] = []
        size = own = 0
        last = None
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for h, body, segs in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    if h != last:
                        held, size = held + owner, size + own
                        owner, own, last = [], 0, h
                    owner.append((body, segs))
                    own += len(body)
                    if held and size + own > shard_bytes:
                        yield flush(held)
                        held, size = [], 0
        if held + owner:
            yield flush(held + owner)

    return run


def _divide(length: int, gram: int, block: int):
    """Hot pieces (ROWS) to their windows, ``block`` distances from the gram at a time (1: window by window)."""
    width = length - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                bodies = part.column(0).to_pylist()
                rows = [x[0] for x in part.column(1).to_pylist()]
                data = np.frombuffer(b"".join(bodies), np.uint8)
                at = np.cumsum([0, *[len(b) for b in bodies]])
                values = A.BYTE_KEYS[data]
                hashes = A.mix64(A.grams(values, gram)).view(np.int64) if block > 1 else None
                made: list[tuple[int, int, int, int, int]] = []  # row, first window, windows, first byte of what they share, least distance
                for k, x in enumerate(rows):
                    if block == 1:
                        made += [(k, w, 1, w, 0) for w in range(x["c"])]
                        continue
                    spot = int(np.flatnonzero(hashes[at[k] : at[k] + width] == x["h"])[-1])  # the rightmost in the first window
                    w = 0
                    while w < x["c"]:
                        low = (spot - w) // block * block
                        stop = min(x["c"], spot - low + 1)
                        made.append((k, w, stop - w, spot - low, low))
                        w = stop
                own, first, count, core, far = np.array(made).T
                begin = at[own]
                inner = _range_hashes(values, begin + core, begin + core + length - block + 1)
                same = _range_hashes(values, begin + first, begin + first + count + length - 1)
                pick = lambda name, rows=rows, own=own: np.array([x[name] for x in rows], np.int64)[own]
                key = A.mix64(A.mix64(inner + far.astype(np.uint64)) + pick("h").view(np.uint64) * A.BASE)
                kind = A.mix64(same * A.BASE + (core - first).astype(np.uint64))
                body = [bodies[k][w : w + n + length - 1] for k, w, n, _, _ in made]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pick("h")), pa.array(pick("p")), pa.array(first.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(kind.view(np.int64)), pa.array(count.astype(np.int32)), pa.array(pick("m")), pa.array(body, pa.binary())],
                    ["h", "p", "o", "h2", "p2", "c", "m", "body"],
                )

    return run


def _sorted(rows: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """RANGES of all pieces of ``rows`` (ROWS)."""
    return rows.select("h", "body", "segs").repartition("h").sortWithinPartitions("h").mapInArrow(_shard_sort(length, shard_bytes), RANGES)


def _divided(rows: DataFrame, length: int, gram: int, hot: int, shard_bytes: int, level: int = 0) -> DataFrame:
    """RANGES of the pieces (body, segs) of hot owners."""
    blocks = (min(BLOCK, length - gram + 1), 1)
    parts = cut(rows.mapInArrow(_divide(length, gram, blocks[level]), "h long, p long, o int, h2 long, p2 long, c int, m long, body binary"))
    merged = parts.groupBy("h2", "p2").agg(F.sum("m").alias("m"), F.first("c").alias("c"), F.first("body").alias("body"))
    number = merged.groupBy("h2").agg(F.count("*").alias("kinds"))
    seg = F.struct(F.lit(0).alias("o"), "c", "m", F.col("h2").alias("h"), F.col("p2").alias("p"))
    below = cut(merged.join(number, "h2").select(F.col("h2").alias("h"), "kinds", "body", F.array(seg).alias("segs")))
    crowded = F.col("kinds") > hot
    if level + 1 < len(blocks) and below.where(crowded).limit(1).count():
        found = _sorted(below.where(~crowded), length, shard_bytes).unionByName(_divided(below.where(crowded).select("body", "segs"), length, gram, hot, shard_bytes, level + 1))
    else:
        found = _sorted(below, length, shard_bytes)
    back = parts.select("h", "p", "o", "h2", "p2").join(found.select(F.col("h").alias("h2"), F.col("p").alias("p2"), "ranges"), ["h2", "p2"])
    return back.select("h", "p", F.transform("ranges", lambda r: F.struct((r.a + F.col("o")).alias("a"), (r.b + F.col("o")).alias("b"))).alias("ranges"))


def _pieces_of(docs: DataFrame, text: str, wanted: list[int], length: int, gram: int) -> DataFrame:
    """One row (body, segs) per different piece of the ``wanted`` owners, by a second scan that leaves the texts in place."""
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(wanted, np.int64)))

    def emit(data: np.ndarray, offsets: np.ndarray) -> list:
        row, s, c, h, p = scanned(data, offsets, length, gram)
        near = np.minimum(np.searchsorted(shared.value, h), len(shared.value) - 1)
        mine = np.flatnonzero(shared.value[near] == h)
        row, s, c, h, p = row[mine], s[mine], c[mine], h[mine], p[mine]
        begin = offsets[row] + s
        body = [data[a:b].tobytes() for a, b in zip(begin.tolist(), (begin + c + length - 1).tolist(), strict=True)]
        at = np.searchsorted(row, np.arange(len(offsets)))
        item = pa.StructArray.from_arrays([pa.array(c, pa.int32()), pa.array(h), pa.array(p), pa.array(body, pa.binary())], ["c", "h", "p", "body"])
        return [pa.ListArray.from_arrays(pa.array(at, pa.int32()), item)]

    kind = T.ArrayType(T.StructType([T.StructField("c", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("p", T.LongType()), T.StructField("body", T.BinaryType())]))
    found = A.annotate(docs, text, "pieces", T.StructType([T.StructField("list", kind)]), emit, []).select(F.inline("pieces.list"))
    one = found.groupBy("h", "p").agg(F.count("*").alias("m"), F.first("c").alias("c"), F.first("body").alias("body"))
    return one.select("body", F.array(F.struct(F.lit(0).alias("o"), "c", "m", "h", "p")).alias("segs"))


def repeated_ranges(docs: DataFrame, text: str, key: list[str], length: int = LENGTH, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` columns plus ``ranges``: byte ranges of each text (binary) that repeat (unsorted, may overlap).

    ``key`` columns must be equal only for rows of equal text.
    """
    gram = min(GRAM, length)

    def emit(data: np.ndarray, offsets: np.ndarray) -> list:
        row, s, c, h, p = scanned(data, offsets, length, gram)
        at = np.searchsorted(row, np.arange(len(offsets)))
        item = pa.StructArray.from_arrays([pa.array(s, pa.int32()), pa.array(c, pa.int32()), pa.array(h), pa.array(p)], ["s", "c", "h", "p"])
        return [pa.ListArray.from_arrays(pa.array(at, pa.int32()), item)]

    found = cut(A.annotate(docs, text, "pieces", T.StructType([T.StructField("list", PIECES)]), emit, key))  # one row per text; read twice
    pieces = found.select(*key, F.inline("pieces.list"))
    again = cut(pieces.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))  # cut, so that the join below can split a hot owner
    pieces = cut(pieces.join(again.hint("merge"), "h", "left_semi"))
    kinds = pieces.groupBy("h", "p").agg(F.count("*").alias("m"), F.min(F.struct(*key, "s", "c")).alias("at"))
    spread = kinds.groupBy("h").agg(F.count("*").alias("kinds"))
    judged = kinds.join(spread.hint("merge"), "h").select("h", "p", "m", "kinds", *[F.col(f"at.{k}").alias(k) for k in [*key, "s", "c"]])
    judged = cut(judged.where("kinds > 1 or m > 1"))
    bodies = docs.select(*key, F.col(text).cast("binary").alias("whole"))  # the same subtree twice: one exchange serves both joins

    def filled(some: DataFrame) -> DataFrame:
        asked = some.groupBy(*key).agg(F.collect_list(F.struct("s", "c", "h", "p", "m", "kinds")).alias("list"))  # at most a text's pieces
        return bodies.join(asked.hint("merge"), key).select("whole", "list").mapInArrow(_bodies(length, shard_bytes), ROWS)

    crowded = judged.where(F.col("kinds") > hot)
    verdicts = _sorted(filled(judged.where(F.col("kinds") <= hot)), length, shard_bytes)
    wanted = [r.h for r in crowded.select("h").distinct().limit(LISTED + 1).collect()]
    if wanted:
        few = len(wanted) <= LISTED
        rows = _pieces_of(docs, text, wanted, length, gram) if few else filled(crowded).select("body", "segs")
        verdicts = verdicts.unionByName(_divided(rows, length, gram, hot, shard_bytes))
    placed = pieces.join(verdicts.hint("merge"), ["h", "p"]).select(*key, F.transform("ranges", lambda r: F.struct((r.a + F.col("s")).alias("a"), (r.b + F.col("s")).alias("b"))).alias("ranges"))
    by_doc = placed.groupBy(*key).agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    return bodies.join(by_doc.hint("merge"), key, "left").withColumnRenamed("whole", text)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per document: the id, ``n_bytes``, ``spans`` (array of removed byte ranges ``a``, ``b``) and ``kept`` (binary)."""
    keyed = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("\x00")).alias("k1"), F.xxhash64(F.col(f"`{text}`")).alias("k2"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    ranged = repeated_ranges(keyed, "body", ["k1", "k2"], length, hot, shard_bytes)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("ranges")
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                spans, kept, size = [], [], []
                for body, ranges in zip(part.column(1), part.column(at).to_pylist(), strict=True):
                    raw = memoryview(body.as_buffer())
                    cut: list[list[int]] = []
                    for r in sorted((x["a"], x["b"]) for x in ranges or ()):
                        if cut and r[0] <= cut[-1][1]:
                            cut[-1][1] = max(cut[-1][1], r[1])
                        else:
                            cut.append(list(r))
                    keep, last = [], 0
                    for a, b in cut:
                        keep.append(raw[last:a])
                        last = b
                    keep.append(raw[last:])
                    spans.append([{"a": a, "b": b} for a, b in cut])
                    kept.append(b"".join(keep))
                    size.append(len(raw))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(kept, pa.binary())], ["k1", "n_bytes", "spans", "kept"])

    out = ranged.select("k1", "body", "ranges").mapInArrow(run, "k1 string, n_bytes long, spans array<struct<a:long,b:long>>, kept binary")
    return out.select(F.when(F.col("k1") != "\x00", F.col("k1")).cast(kind).alias(id_col), "n_bytes", "spans", "kept")

"""Benchmark decontamination with an FM-index per shard.

A shard is a run of documents of about one MiB. Its words are numbered by the benchmark's vocabulary; words outside
it can be part of no match, so the shard's text is the stretches of known words that are at least as long as the
shortest phrase, joined by separators. That text is suffix-sorted by induced sorting, its Burrows-Wheeler transform is
stored in a wavelet tree, and all phrases (runs of ``window`` item words, or a whole shorter item) are searched
backwards together through wavelet-tree ranks. Occurrences are located by walking back to sampled suffix positions,
and their word spans are merged per document. Documents are never shuffled: phrases travel to the shards, in blocks of
at most ``BLOCK_WORDS`` item words, so what is broadcast at once is bounded.

Defined cases: null or word-less texts have no words and no hits; items without words are ignored, and items of null id
count as the item "null"; equal items count separately by id; an empty benchmark hits nothing; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave.llm import arrow_text as A
from ledgerweave.llm.suffix_array import suffix_array

WINDOW = 13
SAMPLE_RATE = 8
BLOCK_WORDS = 2_000_000
HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


class WaveletTree:
    """Ranks of symbols in a sequence, one bit vector per bit of the symbols."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.n = bits, len(values)
        self.zeros: list[np.ndarray] = []
        current = values
        for b in range(bits - 1, -1, -1):
            bit = (current >> b) & 1
            self.zeros.append(np.concatenate(([0], np.cumsum(1 - bit))))
            current = np.concatenate((current[bit == 0], current[bit == 1]))

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        at = places.copy()
        for level, zeros in enumerate(self.zeros):
            ones = (symbols >> (self.bits - 1 - level)) & 1
            before = zeros[at]
            at = np.where(ones == 0, before, zeros[-1] + at - before)
        return at - self.start_of(symbols)

    def start_of(self, symbols: np.ndarray) -> np.ndarray:
        """Where the symbol's run begins once all bits are sorted: the same walk from place 0."""
        at = np.zeros(len(symbols), np.int64)
        for level, zeros in enumerate(self.zeros):
            ones = (symbols >> (self.bits - 1 - level)) & 1
            before = zeros[at]
            at = np.where(ones == 0, before, zeros[-1] + at - before)
        return at

    def access(self, places: np.ndarray) -> np.ndarray:
        at = places.copy()
        out = np.zeros(len(places), np.int64)
        for zeros in self.zeros:
            before = zeros[at]
            ones = 1 - (zeros[at + 1] - before)
            out = out * 2 + ones
            at = np.where(ones == 0, before, zeros[-1] + at - before)
        return out


class FMIndex:
    """Backward search over integer text; symbols are 2 and up, 1 separates, 0 ends."""

    def __init__(self, text: np.ndarray, symbols: int, rate: int = SAMPLE_RATE):
        s = np.append(text, 0)
        sa = suffix_array(s)
        self.n = len(s)
        bwt = s[sa - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=symbols))))
        self.tree = WaveletTree(bwt, max(1, int(symbols - 1).bit_length()))
        self.marked = sa % rate == 0
        self.order = np.cumsum(self.marked) - 1
        self.samples = sa[self.marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the rows of ``phrases`` (all of one length)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        alive = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, j]
            lo[alive] = self.first[c] + self.tree.rank(c, lo[alive])
            hi[alive] = self.first[c] + self.tree.rank(c, hi[alive])
            gone = lo[alive] >= hi[alive]
            hi[alive[gone]] = lo[alive[gone]]
            alive = alive[~gone]
            if not len(alive):
                break
        return lo, hi

    def locate(self, places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(places), np.int64)
        todo, at, steps = np.arange(len(places)), places.copy(), 0
        while len(todo):
            known = self.marked[at]
            out[todo[known]] = self.samples[self.order[at[known]]] + steps
            todo, at = todo[~known], at[~known]
            c = self.tree.access(at)
            at = self.first[c] + self.tree.rank(c, at)
            steps += 1
        return out


@dataclass
class Phrases:
    """One block of benchmark items."""

    vocabulary: np.ndarray  # sorted word hashes; the number of a word is its place plus 2
    filter: np.ndarray
    by_length: dict[int, tuple[np.ndarray, list[list[str]]]]  # phrase rows and, for each, its items

    @property
    def shortest(self) -> int:
        return min(self.by_length, default=0)


def word_hash_lists(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = A.LOWER[data]
    starts, ends, row = A.words(low, offsets, A.ALNUM)
    return A.word_hashes(low, starts, ends), np.searchsorted(row, np.arange(len(offsets)))


def make_phrases(items: list[tuple[str, np.ndarray]], window: int = WINDOW) -> Phrases:
    every = np.concatenate([w for _, w in items]) if items else np.zeros(0, np.uint64)
    vocabulary = np.unique(every)
    bloom = np.zeros(1 << 16, bool)
    bloom[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
    found: dict[int, dict[tuple, set[str]]] = defaultdict(lambda: defaultdict(set))
    for name, words in items:
        ids = np.searchsorted(vocabulary, words) + 2
        size = min(window, len(ids))
        for i in range(len(ids) - size + 1) if size else ():
            found[size][tuple(ids[i : i + size].tolist())].add(name)
    return Phrases(vocabulary, bloom, {k: (np.array(list(v), np.int64), [sorted(x) for x in v.values()]) for k, v in found.items()})


def find_phrases(phrases: Phrases, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Word starts, word ends and items of all occurrences; starts are in the shard's word numbering."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    if not phrases.by_length or not len(hashes):
        return none
    maybe = np.flatnonzero(phrases.filter[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
    place = np.searchsorted(phrases.vocabulary, hashes[maybe])
    place[place == len(phrases.vocabulary)] = 0
    good = phrases.vocabulary[place] == hashes[maybe]
    ids = np.zeros(len(hashes), np.int64)
    ids[maybe[good]] = place[good] + 2
    known = np.append(ids > 0, False)
    begins = known.copy()
    begins[1:] &= ~known[:-1]
    firsts = at[:-1][at[:-1] < len(ids)]
    begins[firsts] = known[firsts]
    begin = np.flatnonzero(begins)
    stop = np.append(begin[1:], len(ids))
    gaps = np.flatnonzero(~known)
    stop = np.minimum(stop, gaps[np.searchsorted(gaps, begin)])
    keep = stop - begin >= phrases.shortest
    begin, stop = begin[keep], stop[keep]
    if not len(begin):
        return none
    sizes = stop - begin + 1
    ends = np.cumsum(sizes)
    origin = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(begin, sizes)
    last = np.zeros(len(origin), bool)
    last[ends - 1] = True
    text = np.where(last, 1, ids[np.minimum(origin, len(ids) - 1)])
    used, text = np.unique(np.concatenate(([0, 1], text)), return_inverse=True)  # a small alphabet for this shard
    index = FMIndex(text[2:], len(used))
    starts, stops, names = [], [], []
    for size, (rows, items) in phrases.by_length.items():
        local = np.searchsorted(used, rows)
        local[local == len(used)] = 0
        here = np.flatnonzero((used[local] == rows).all(1))
        lo, hi = index.search(local[here])
        hit = np.flatnonzero(hi > lo)
        count = (hi - lo)[hit]
        if not len(hit):
            continue
        flat = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[hit], count)
        where = origin[index.locate(flat)]
        starts.append(where)
        stops.append(where + size)
        names += [items[here[h]] for h, c in zip(hit, count, strict=True) for _ in range(c)]
    if not starts:
        return none
    return np.concatenate(starts), np.concatenate(stops), names


def _merge(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"a": a, "b": b} for a, b in out]


def benchmark_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", block_words: int = BLOCK_WORDS) -> list[Column]:
    """Conditions that split the benchmark into blocks of about ``block_words`` words (by characters)."""
    size = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(1, -(-size // (6 * block_words)))
    return [F.pmod(F.xxhash64(item_id), F.lit(n)) == i for i in range(n)]


def load_block(benchmark: DataFrame, where: Column, item_id: str, text: str, window: int) -> Phrases:
    rows = benchmark.where(where).select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).collect()
    items = []
    for r in sorted(rows, key=lambda r: (r["i"], r["t"])):
        data = np.frombuffer(r["t"].encode(), np.uint8)
        words, _ = word_hash_lists(data, np.array([0, len(data)]))
        if len(words):
            items.append((r["i"], words))
    return make_phrases(items, window)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, into: str = "hits", keep: list[str] | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Append struct ``into``: ``n_words``, merged word ``spans`` (a, b) that occur in the benchmark, and ``items``."""
    blocks = benchmark_blocks(benchmark, item_id, item_text, block_words)
    names = [c for c in (docs.columns if keep is None else keep) if c != into]
    result, done = docs, []
    for i, where in enumerate(blocks):
        shared = docs.sparkSession.sparkContext.broadcast(load_block(benchmark, where, item_id, item_text, window))
        column = A.fresh([*docs.columns, *done], f"{into}_{i}")

        def fn(data: np.ndarray, offsets: np.ndarray, shared=shared) -> list:
            hashes, at = word_hash_lists(data, offsets)
            starts, stops, items = find_phrases(shared.value, hashes, at)
            rows = len(offsets) - 1
            spans: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
            found: list[set[str]] = [set() for _ in range(rows)]
            doc = np.searchsorted(at, starts, "right") - 1
            for d, a, b, x in zip(doc.tolist(), starts.tolist(), stops.tolist(), items, strict=True):
                spans[d].append((a - int(at[d]), b - int(at[d])))
                found[d].update(x)
            kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            return [np.diff(at), pa.array([_merge(s) for s in spans], kind), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]

        last = i == len(blocks) - 1
        result = A.annotate(result, text, column, HITS, fn, [*names, *done] if last else None)
        done.append(column)
    if len(done) == 1:
        return result.withColumnRenamed(done[0], into)
    spans = F.array_sort(F.flatten(F.array(*[F.col(f"{c}.spans") for c in done])))
    start = F.array().cast("array<struct<a:bigint,b:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        tail = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(tail["a"].alias("a"), F.greatest(tail["b"], x["b"]).alias("b"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["b"] >= x["a"]), joined).otherwise(F.concat(acc, F.array(x)))

    merged = F.struct(F.col(f"{done[0]}.n_words").alias("n_words"), F.aggregate(spans, start, step).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"{c}.items") for c in done])))).alias("items"))
    return result.withColumn(into, merged).drop(*done)


def hit_words(hits: Column) -> Column:
    return F.aggregate(hits["spans"], F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])


def is_contaminated(hits: Column, share: int = 20) -> Column:
    """At least one word in ``share`` is hit."""
    n = hit_words(hits)
    return (n > 0) & (n * share >= hits["n_words"])

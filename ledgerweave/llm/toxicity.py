"""Toxicity scores from a small convolutional text classifier trained in numpy.

Words (lower-case alphanumeric runs) are hashed to rows of an embedding table, once whole and once by their first
``STEM`` bytes, and the two rows are added; rows that fewer than ``LEAST`` different training texts use stay zero, so
that no rare word is learned by heart. Convolutions of widths 1, 2 and 3 slide over the word sequence, each filter keeps its maximum over the whole text (so length does not dilute one offence), and
a logistic unit reads the maxima. Embeddings and filters are trained together by Adam on all labelled rows but every
fifth: up to ``2 * SHARD`` rows on the driver, more in shards of about ``SHARD`` ids on the executors. Shards start each
of ``ROUNDS`` rounds from common weights, which are then the mean of the shards', an embedding's of those that used it.
All rows held back calibrate one threshold per predicted language (the string-kernel model, which
``langid.fit_languages`` fits); scores are mapped so that the threshold is 0.5. The executors count logits in steps of 1/``FINE``.

Defined cases: null, empty or word-less texts get the score of the empty text, below 0.5; without labelled rows of
both classes every score is 0; equal texts score equally; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave.llm import arrow_text as A
from ledgerweave.llm import langid
from ledgerweave.plans.checkpoint import cut

SHARD = 4000
ROUNDS = 4
PARTS = 64
FINE = 1024
BUCKETS = 1 << 15
STEM = 4
LEAST = 4
DIM = 16
FILTERS = 12
WIDTHS = (1, 2, 3)
EPOCHS = 8
RATE = 0.01
BATCH = 32


@dataclass
class ToxicityModel:
    table: np.ndarray
    filters: list[np.ndarray]  # width*DIM x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray
    shift: float
    thresholds: dict[int, float] = field(default_factory=dict)
    default: float = 0.0
    language: langid.LanguageModel | None = None

    def features(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Maxima of every filter over each row's words, at least 0."""
        rows = len(at) - 1
        made = []
        emb = self.table.take(words[:, 0], 0)
        emb += self.table.take(words[:, 1], 0)
        for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            if len(words) < w:
                made.append(np.zeros((rows, FILTERS), np.float32))
                continue
            n = len(words) - w + 1
            act = emb[:n] @ f[:DIM]
            for j in range(1, w):
                act += emb[j : n + j] @ f[j * DIM : (j + 1) * DIM]
            act += b
            top = np.zeros((rows, FILTERS), np.float32)
            start, end = at[:-1], at[1:] - w + 1
            full = np.flatnonzero(end > start)
            if len(full):
                edges = np.stack((start[full], end[full]), 1).ravel()
                safe = np.concatenate((act, np.zeros((1, FILTERS), np.float32)))
                top[full] = np.maximum(np.maximum.reduceat(safe, edges, axis=0)[::2], 0)
            made.append(top)
        return np.concatenate(made, 1)

    def logits(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.features(words, at) @ self.out + self.shift


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words x 2 buckets (whole word, first bytes) and the rows' offsets in them."""
    low = A.LOWER[data]
    starts, ends, row = A.words(low, offsets, A.ALNUM)
    whole = A.word_hashes(low, starts, ends) >> np.uint64(49)
    stem = A.mix64(A.word_hashes(low, starts, np.minimum(ends, starts + STEM)) ^ np.uint64(0x5EED)) >> np.uint64(49)
    return np.stack((whole, stem), 1).astype(np.int64), np.searchsorted(row, np.arange(len(offsets)))


def initial(rng: np.random.Generator, common: np.ndarray) -> dict[str, np.ndarray]:
    """Weights before training; rows of rare buckets are zero."""
    p = {"table": rng.normal(0, 0.3, (BUCKETS, DIM)), "out": rng.normal(0, 0.1, FILTERS * len(WIDTHS)), "shift": np.zeros(1)}
    for i, w in enumerate(WIDTHS):
        p[f"f{i}"] = rng.normal(0, 0.4 / np.sqrt(w), (w * DIM, FILTERS))
        p[f"b{i}"] = np.zeros(FILTERS)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["table"] *= common[:, None]
    return p


def in_common(spread: np.ndarray, texts: int) -> np.ndarray:
    """Buckets that enough of the training texts use."""
    return spread >= min(LEAST, max(1, texts // 50))


def class_weight(negative: int, positive: int) -> float:
    return min(20.0, negative / max(1, positive))


def train(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> ToxicityModel:
    """Train on word-bucket sequences; the positive class is weighted up to the negative's size."""
    rng = np.random.default_rng(seed)
    spread = np.zeros(BUCKETS, np.int64)
    for key in sorted({x.tobytes() for x in texts}):
        spread[np.unique(np.frombuffer(key, np.int64))] += 1
    common = in_common(spread, len(texts))
    p = initial(rng, common)
    learn(p, texts, labels, common, class_weight((labels == 0).sum(), (labels == 1).sum()), EPOCHS, rng)
    return as_model(p)


def as_model(p: dict[str, np.ndarray]) -> ToxicityModel:
    n = range(len(WIDTHS))
    return ToxicityModel(p["table"], [p[f"f{k}"] for k in n], [p[f"b{k}"] for k in n], p["out"], float(p["shift"][0]))


def learn(p: dict[str, np.ndarray], texts: list[np.ndarray], labels: np.ndarray, common: np.ndarray, positive: float, epochs: int, rng: np.random.Generator) -> np.ndarray:
    """Train the weights ``p`` in place; which rows of the table were used."""
    m1 = {k: np.zeros_like(v) for k, v in p.items()}
    m2 = {k: np.zeros_like(v) for k, v in p.items()}
    weight = np.where(labels == 1, positive, 1.0)
    used = np.zeros(BUCKETS, bool)
    step = 0
    rare = int(np.flatnonzero(~common)[0]) if not common.all() else 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            grad = {k: np.zeros_like(v) for k, v in p.items() if k != "table"}
            touched: list[np.ndarray] = []
            pushed: list[np.ndarray] = []
            for i in batch:
                words = texts[i].astype(np.int64)
                if len(words) < max(WIDTHS):
                    words = np.concatenate((words, np.full((max(WIDTHS) - len(words), 2), rare)))
                emb = p["table"].take(words[:, 0], 0) + p["table"].take(words[:, 1], 0)
                top, spots = [], []
                for k, w in enumerate(WIDTHS):
                    n = len(words) - w + 1
                    act = sum(emb[j : n + j] @ p[f"f{k}"][j * DIM : (j + 1) * DIM] for j in range(w)) + p[f"b{k}"]
                    spot = act.argmax(0)
                    top.append(act[spot, np.arange(FILTERS)])
                    spots.append(spot)
                raw = np.concatenate(top)
                feat = np.maximum(raw, 0)
                z = float(feat @ p["out"] + p["shift"][0])
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]) * weight[i] / len(batch)
                grad["out"] += g * feat
                grad["shift"] += g
                back = g * p["out"] * (raw > 0)
                for k, w in enumerate(WIDTHS):
                    gk = back[k * FILTERS : (k + 1) * FILTERS]
                    grad[f"b{k}"] += gk
                    for j in range(w):
                        idx = spots[k] + j
                        part = slice(j * DIM, (j + 1) * DIM)
                        grad[f"f{k}"][part] += emb[idx].T * gk
                        touched.append(words[idx].T.ravel())
                        pushed.append(np.tile((p[f"f{k}"][part] * gk).T, (2, 1)))
            step += 1
            for k, g in grad.items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                p[k] -= (RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            ids, where = np.unique(np.concatenate(touched), return_inverse=True)
            used[ids] = True
            g = np.zeros((len(ids), DIM))
            np.add.at(g.ravel(), (where[:, None] * DIM + np.arange(DIM)).ravel(), np.concatenate(pushed).astype(float).ravel())  # flat indices of one type are much faster
            g = g.astype(np.float32)
            m2["table"][ids] = 0.99 * m2["table"][ids] + 0.01 * g * g
            p["table"][ids] -= RATE * g / (np.sqrt(m2["table"][ids]) + 1e-4) * 0.5 * common[ids, None]
    return used


def best_threshold(z: np.ndarray, y: np.ndarray, fallback: float, n: np.ndarray | None = None) -> float:
    """The logit midway in the widest gap among those of the best F1; the fallback if a class is missing.

    ``n`` rows share a logit, ``y`` of them positive; one each if it is not given.
    """
    n = np.ones(len(y), np.int64) if n is None else n
    if not y.sum() or y.sum() == n.sum() or n.sum() < 20 or y.sum() < 4:
        return fallback
    order = np.argsort(-z, kind="stable")
    z, y, n = z[order], y[order], n[order]
    f1 = 2 * np.cumsum(y) / (np.cumsum(n) + y.sum())
    gap = np.append(z[:-1] - z[1:], 0.0)
    last = np.where((gap > 0) & (f1 >= f1.max() - 1e-9))[0]
    if not len(last):
        return fallback
    i = last[gap[last].argmax()]
    return float((z[i] + z[min(i + 1, len(z) - 1)]) / 2)


def _word_codes(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u2").reshape(-1, 2) for x in column]


def _in_parts(vector: np.ndarray, shard: int) -> pa.RecordBatch:
    pieces = [x.astype(np.float64).tobytes() for x in np.array_split(vector, PARTS)]
    return pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([shard] * PARTS, pa.int64()), pa.array(pieces, pa.binary())], ["part", "shard", "v"])


def _total(vectors: DataFrame) -> np.ndarray:
    """Sum of vectors that ``_in_parts`` cut up, added on the executors in the order of their shards."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, v in zip(batch.column("part").to_pylist(), batch.column("v"), strict=True):
                x = np.frombuffer(v.as_buffer(), np.float64)
                sums[part] = sums[part] + x if part in sums else x.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "v"])

    dealt = vectors.repartition(PARTS, "part").sortWithinPartitions("part", "shard")
    got = dealt.mapInArrow(add, "part int, v binary").collect()
    return np.concatenate([np.frombuffer(bytes(r["v"]), np.float64) for r in sorted(got, key=lambda r: r["part"])])


PARTS_SCHEMA = "part int, shard long, v binary"


def train_in_shards(rows: DataFrame, counts: dict[int, int]) -> ToxicityModel:
    """Train on all ``rows`` (shard, y, codes) where they lie; ``counts`` are those of the classes."""
    spark = rows.sparkSession
    repeated = {r["h"]: r["n"] for r in rows.groupBy(F.xxhash64("codes").alias("h")).agg(F.count("*").alias("n")).where("n > 1").collect()}
    copies = spark.sparkContext.broadcast(repeated)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros(BUCKETS), 0
        for batch in batches:
            first = batch.column("shard")[0].as_py() if batch.num_rows and not first else first
            for h, words in zip(batch.column("h").to_pylist(), _word_codes(batch.column("codes")), strict=True):
                total[np.unique(words)] += 1 / copies.value.get(h, 1)
        yield _in_parts(total, first)

    counted = _total(rows.select("shard", F.xxhash64("codes").alias("h"), "codes").mapInArrow(spread, PARTS_SCHEMA))
    common = in_common(counted + 1e-6, sum(counts.values()))
    p = initial(np.random.default_rng(7), common)
    positive = class_weight(counts[0], counts[1])
    small = [k for k in sorted(p) if k != "table"]
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((p, common))

        def one(shard: int, piece: int, texts: list[np.ndarray], y: list[int], shared=shared, turn=turn) -> pa.RecordBatch:
            start, common = shared.value
            mine = {k: v.copy() for k, v in start.items()}
            used = learn(mine, texts, np.array(y), common, positive, EPOCHS // ROUNDS, np.random.default_rng([7, turn, shard, piece]))
            made = [((mine["table"] - start["table"]) * used[:, None]).ravel(), used.astype(np.float32), *[mine[k].ravel() for k in small], np.ones(1, np.float32)]
            return _in_parts(np.concatenate(made) * np.float32(len(texts)), shard)

        def run(batches: Iterator[pa.RecordBatch], one=one) -> Iterator[pa.RecordBatch]:
            at, piece, texts, y = None, 0, [], []
            for batch in batches:
                for shard, label, words in zip(batch.column("shard").to_pylist(), batch.column("y").to_pylist(), _word_codes(batch.column("codes")), strict=True):
                    if texts and (shard != at or len(texts) >= 2 * SHARD):
                        yield one(at, piece, texts, y)
                        piece, texts, y = piece + 1 if shard == at else 0, [], []
                    at = shard
                    texts.append(words)
                    y.append(label)
            if texts:
                yield one(at, piece, texts, y)

        total = _total(rows.select("shard", "y", "codes").mapInArrow(run, PARTS_SCHEMA))
        moved, used, rest = np.split(total[:-1], [BUCKETS * DIM, BUCKETS * DIM + BUCKETS])
        p["table"] = (p["table"] + moved.reshape(BUCKETS, DIM) / np.maximum(used, 1)[:, None]).astype(np.float32)
        for k, v in zip(small, np.split(rest / total[-1], np.cumsum([p[k].size for k in small])[:-1]), strict=True):
            p[k] = v.reshape(p[k].shape).astype(np.float32)
        shared.destroy()
    return as_model(p)


def labelled_codes(docs: DataFrame, chosen: DataFrame, n: int, language: langid.LanguageModel | None) -> DataFrame:
    """Rows (shard, id, fold, y, codes, lang) of all documents (id, body) whose id is one of the ``n`` of ``chosen`` (id, y).

    A bitmap of the labelled ids keeps most other documents out of the only shuffle; documents then meet their id's
    label in id order. Of more than ``2 * SHARD`` ids only rows held back get a language number (-1: none).
    """
    spark = docs.sparkSession
    size = 1 << max(15, (8 * n).bit_length())
    hashed = F.xxhash64(F.col("id").cast("string"))
    slot = F.pmod(hashed, F.lit(size)) + 1
    bits = np.zeros(size // 8, np.uint8)
    found = chosen.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    for r in found.collect():
        bits[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = spark.sparkContext.broadcast((bits, language))
    shard = F.pmod(F.xxhash64(F.lit("shard"), F.col("id").cast("string")), F.lit(max(1, -(-n // SHARD))))
    small = n <= 2 * SHARD

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, language = shared.value
        for batch in batches:
            slot = batch.column("slot").to_numpy() - 1
            batch = batch.filter(pa.array((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1))
            for part, data, offsets in A.slices(batch, "body"):
                codes, at = word_buckets(data, offsets)
                packed = [codes[s:e].astype("<u2").tobytes() for s, e in zip(at[:-1], at[1:], strict=True)]
                lang = np.full(part.num_rows, -1)
                aside = small | (part.column("fold").to_numpy() % 5 == 0)
                if language and aside.any():
                    lang[aside] = langid.score_batch(language, *A.buffers(part.filter(pa.array(aside)).column("body")))[0]
                yield pa.RecordBatch.from_arrays([part.column("shard"), part.column("id"), part.column("fold"), pa.nulls(part.num_rows, pa.int32()), pa.array(packed, pa.binary()), pa.array(lang, pa.int32())], names)

    names = ["shard", "id", "fold", "y", "codes", "lang"]
    schema = "shard long, id string, fold long, y int, codes binary, lang int"
    texts = docs.where("id is not null").select(shard.alias("shard"), F.col("id").cast("string").alias("id"), F.xxhash64(F.lit("fold"), "id").alias("fold"), slot.alias("slot"), "body").mapInArrow(pack, schema)
    marks = chosen.select(shard.alias("shard"), F.col("id").cast("string").alias("id"), F.lit(0).cast("long").alias("fold"), "y", F.lit(None).cast("binary").alias("codes"), F.lit(-1).alias("lang"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, label = None, None
        for batch in batches:
            found = []
            for i, y in zip(batch.column("id").to_pylist(), batch.column("y").to_pylist(), strict=True):
                if y is not None:
                    last, label = i, y
                found.append(label if y is None and i == last else None)
            y = pa.array(found, pa.int32())
            batch = pa.RecordBatch.from_arrays([y if c == "y" else batch.column(c) for c in names], names)
            yield batch.filter(y.is_valid())

    dealt = texts.union(marks).repartition("shard").sortWithinPartitions("shard", "id", F.col("y").desc_nulls_last(), F.xxhash64("codes"))
    return dealt.mapInArrow(meet, schema)


def logits_of(model: ToxicityModel, seqs: list[np.ndarray]) -> np.ndarray:
    blocks = [seqs[i : i + 64] for i in range(0, len(seqs), 64)]
    made = [model.logits(np.concatenate(b).astype(np.int64), np.concatenate(([0], np.cumsum([len(s) for s in b])))) for b in blocks]
    return np.concatenate(made) if made else np.zeros(0)


def set_thresholds(model: ToxicityModel, lang: np.ndarray, z: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> None:
    """One threshold for all rows, and one for each language number that has enough of them."""
    mine = lambda k, x: x if x is None else x[k]
    model.default = best_threshold(z, y, 0.0, n)
    model.thresholds = {int(i): best_threshold(z[lang == i], y[lang == i], model.default, mine(lang == i, n)) for i in np.unique(lang) if i >= 0}


def logit_counts(model: ToxicityModel, held: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Languages, logits, positive rows and all rows of the rows (y, codes, lang) held back."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    def logit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = logits_of(shared.value, _word_codes(batch.column("codes")))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(np.rint(np.clip(z, -64, 64) * FINE).astype(np.int32)), batch.column("y")], ["lang", "z", "y"])

    counted = held.select("y", "codes", "lang").mapInArrow(logit, "lang int, z int, y int").groupBy("lang", "z").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    lang, z, y, n = np.array([(r["lang"], r["z"], r["y"], r["n"]) for r in counted.collect()], np.int64).reshape(-1, 4).T
    return lang, z / FINE, y, n


def fit_toxicity(docs: DataFrame, labels: DataFrame, where, text: str = "text", id_col: str = "doc_id", target: str = "toxic", lang: str = "lang", sample: int | None = None) -> ToxicityModel | None:
    """Fit on all labelled rows of ``where``, or, if ``sample`` is given, on about so many, the classes balanced as far as there are rows.

    The driver gets the word bucket pairs (4 bytes each) of at most ``2 * SHARD`` rows' whole texts; more are trained on by
    the executors. It holds the weights, a bitmap of one to two bytes for each labelled id, the hashes of texts that occur more
    than once and the counts of logits.
    """
    key = F.col(f"`{id_col}`")
    chosen = labels.where(where).where(F.col(f"`{target}`").isNotNull() & key.isNotNull()).groupBy(key.alias("id")).agg(F.max(f"`{target}`").cast("int").alias("y")).where(F.col("y").isin(0, 1))
    counts = {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    language = langid.fit_languages(docs, where, text, lang)
    labelled = sum(counts.values())
    rows = cut(labelled_codes(docs.where(where).select(key.alias("id"), F.col(f"`{text}`").cast("string").alias("body")), chosen, labelled, language))
    count = lambda df: {r["y"]: r["n"] for r in df.groupBy("y").agg(F.count("*").alias("n")).collect()}
    found = count(rows)
    if sample is not None:
        top, many = 1 << 30, min(sample / 2, found.get(1, 0))
        limit = F.when(F.col("y") == 1, int(top * min(1.0, many / max(1, found.get(1, 0))))).otherwise(int(top * min(1.0, (sample - many) / max(1, found.get(0, 0)))))
        rows = rows.where(F.pmod(F.xxhash64(F.lit("toxicity sample"), "id", "codes"), F.lit(top)) < limit)
        found = count(rows)
    if max(labelled, sum(found.values())) <= 2 * SHARD:
        picked = sorted(rows.select("fold", "y", "codes", "lang").collect(), key=lambda r: (r["fold"], bytes(r["codes"]), r["y"]))
        seqs = [np.frombuffer(bytes(r["codes"]), "<u2").astype(np.int64).reshape(-1, 2) for r in picked]
        y, held = np.array([r["y"] for r in picked]), np.arange(len(picked)) % 5 == 0
        if len(np.unique(y[~held])) < 2:
            return None
        model = train([s for s, h in zip(seqs, held, strict=True) if not h], y[~held])
        set_thresholds(model, np.array([r["lang"] for r in picked])[held], logits_of(model, [s for s, h in zip(seqs, held, strict=True) if h]), y[held])
    else:
        held = F.pmod("fold", F.lit(5)) == 0
        found = count(rows.where(~held))
        if len(found) < 2:
            return None
        model = train_in_shards(rows.where(~held), found)
        lang_of, z, y, n = logit_counts(model, rows.where(held))
        set_thresholds(model, lang_of, z, y, n)
    model.language = language
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, text: str = "text", into: str = "toxicity", keep: list[str] | None = None) -> DataFrame:
    """Append struct ``into`` of ``score`` and ``lang`` (as predicted, for the threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(data: np.ndarray, offsets: np.ndarray) -> list:
        model = shared.value
        rows = len(offsets) - 1
        if model is None:
            return [np.zeros(rows), pa.nulls(rows, pa.string())]
        codes, at = word_buckets(data, offsets)
        z = model.logits(codes, at).astype(float)
        best = langid.score_batch(model.language, data, offsets)[0] if model.language else np.full(rows, -1)
        limit = np.array([model.thresholds.get(int(b), model.default) for b in best])
        score = 1 / (1 + np.exp(-np.clip(z - limit, -30, 30)))
        score = np.where(np.diff(at) > 0, score, np.minimum(score, 0.25))
        names = np.array([*(model.language.languages if model.language else []), langid.UNKNOWN], object)
        return [pa.array(score), pa.array(names[best], pa.string())]

    return A.annotate(docs, text, into, T.StructType([T.StructField("score", T.DoubleType()), T.StructField("lang", T.StringType())]), fn, keep)

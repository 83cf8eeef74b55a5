"""Quality scores from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document. Expectation-maximisation over the counts
of all vote patterns (a few thousand at most, whatever the table's size) estimates each labeller's accuracy and gives
each pattern a posterior. The posteriors of a bounded, hash-chosen sample train a hashed linear scorer, which scores
every document on its whole text.

Defined cases: null and empty texts are voted bad and score 0; equal texts score equally; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave.llm import arrow_text as A

SAMPLE = 4000
BUCKETS = 1 << 12
ROUNDS = 60
ABSTAIN, BAD, GOOD = 0, 1, 2
LABELLERS = ("symbols", "capitals", "word_length", "repeated_lines", "line_ends", "tables", "varied_words", "size")

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LOWER = np.zeros(256, bool)
_LOWER[0x61:0x7B] = True
_LETTER = _UPPER | _LOWER
_LETTER[0x80:] = True
_ODD = np.zeros(256, bool)
_ODD[[ord(c) for c in "#$%&*|<>{}[]\\^~=_@!"]] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".?;:\"'"]] = True


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x measures: the raw figures that the labellers judge."""
    size = np.maximum(np.diff(offsets), 1)
    count = lambda table: A.range_sums(table[data], offsets)
    letters = np.maximum(count(_LETTER), 1)
    starts, ends, row = A.words(data, offsets, ~A.SPACE)
    rows = len(offsets) - 1
    n_words = np.bincount(row, minlength=rows)
    long = np.bincount(row, ends - starts, minlength=rows) / np.maximum(n_words, 1)
    line_member = np.ones(256, bool)
    line_member[10] = False
    ls, le, lr = A.words(data, offsets, line_member)
    lines = np.maximum(np.bincount(lr, minlength=rows), 1)
    ended = np.bincount(lr, _END[data[le - 1]] if len(le) else None, minlength=rows) / lines

    def different(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(rows)
        both = A.mix64(keys ^ (owner.astype(np.uint64) * A.BASE))
        _, first = np.unique(both, return_index=True)
        return np.bincount(owner[first], minlength=rows)

    unlike_lines = different(A.word_hashes(data, ls, le), lr) / lines
    unlike_words = different(A.word_hashes(A.LOWER[data], starts, ends), row) / np.maximum(n_words, 1)
    pipes = A.range_sums(data == 0x7C, offsets)
    return np.stack((count(_ODD) / size, count(_UPPER) / letters, long, unlike_lines, ended, pipes / np.maximum(n_words, 1), unlike_words, n_words), 1)


def votes(m: np.ndarray) -> np.ndarray:
    """Rows x labellers of ABSTAIN, BAD and GOOD."""
    odd, upper, long, lines, ended, pipes, varied, n = m.T
    out = np.zeros((len(m), len(LABELLERS)), np.int64)

    def put(i: int, bad: np.ndarray, good: np.ndarray) -> None:
        out[:, i] = np.where(bad, BAD, np.where(good, GOOD, ABSTAIN))

    put(0, odd > 0.05, odd < 0.01)
    put(1, upper > 0.3, upper < 0.1)
    put(2, (long > 12) | (long < 3), (long > 4) & (long < 9))
    put(3, lines < 0.6, lines > 0.9)
    put(4, ended < 0.3, ended > 0.8)
    put(5, pipes > 0.1, pipes < 0.01)
    put(6, (varied < 0.3) & (n < 2000), varied > 0.45)
    put(7, n < 3, n > 30)
    return out


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """EM of a two-class model with independent labellers; returns P(good) per pattern and accuracies P(right | vote).

    Starts from the share of good votes, so the second class is the good one.
    """
    good, bad = (patterns == GOOD).sum(1), (patterns == BAD).sum(1)
    post = np.clip((good + 0.5) / (good + bad + 1) - 0.25 * (bad > 1), 0.02, 0.98)
    table = np.zeros((2, patterns.shape[1], 3))
    for _ in range(rounds):
        prior = np.clip((post * counts).sum() / max(counts.sum(), 1), 0.05, 0.95)
        for c, w in enumerate((counts * (1 - post), counts * post)):
            for v in range(3):
                table[c, :, v] = ((patterns == v) * w[:, None]).sum(0) + 1
        table /= table.sum(2, keepdims=True)
        pick = np.arange(patterns.shape[1])
        like = [np.log(table[c, pick, patterns]).sum(1) for c in (0, 1)]
        z = like[1] - like[0] + np.log(prior / (1 - prior))
        post = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    accuracy = (table[1, :, GOOD] + table[0, :, BAD]) / np.maximum(table[:, :, 1:].sum((0, 2)), 1e-9)
    return post, accuracy


def shape_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x buckets: square roots of the shares of hashed byte-class 4-grams, so that form counts, not topic."""
    kind = np.zeros(256, np.uint64)
    kind[_UPPER], kind[_LOWER], kind[A.SPACE], kind[0x30:0x3A] = 1, 2, 3, 4
    kind[0x80:] = 2
    other = (kind == 0) & (np.arange(256) < 0x80)
    kind[other] = np.arange(256, dtype=np.uint64)[other] + np.uint64(8)
    kind[10] = 5
    rows = len(offsets) - 1
    out = np.zeros((rows, BUCKETS), np.float32)
    if len(data) < 4:
        return out
    code = A.grams(A.BYTE_KEYS[kind[data].astype(np.int64)], 4)
    bucket = (A.mix64(code) >> np.uint64(52)).astype(np.int64)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    same = row[: len(bucket)] == row[3:]
    flat = np.bincount(row[: len(bucket)][same] * BUCKETS + bucket[same], minlength=rows * BUCKETS).astype(np.float32)
    out = flat.reshape(rows, BUCKETS)
    return np.sqrt(out / np.maximum(out.sum(1, keepdims=True), 1))


@dataclass
class QualityModel:
    weights: np.ndarray
    shift: float
    accuracy: dict[str, float]
    patterns: dict[int, float]


def fit_scorer(x: np.ndarray, post: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Ridge regression towards the soft labels' log-odds, solved in the sample's dual space."""
    y = np.log(np.clip(post, 0.02, 0.98) / (1 - np.clip(post, 0.02, 0.98)))
    centre = float(y.mean()) if len(y) else 0.0
    gram = x @ x.T
    alpha = np.linalg.solve(gram + ridge * len(x) / 10 * np.eye(len(x)), y - centre) if len(x) else np.zeros(0)
    return (x.T @ alpha).astype(np.float32), centre


def _votes_frame(docs: DataFrame, text: str) -> DataFrame:
    def fn(data: np.ndarray, offsets: np.ndarray) -> list:
        v = votes(measures(data, offsets))
        return [v @ 3 ** np.arange(v.shape[1])]

    return A.annotate(docs, text, "votes", T.StructType([T.StructField("pattern", T.LongType())]), fn, [])


def fit_quality(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> QualityModel:
    """Vote patterns are counted over all rows; the scorer is fitted on about ``sample`` different texts, drawn by hash."""
    counted = _votes_frame(docs, text).groupBy("votes.pattern").agg(F.count("*").alias("n")).collect()  # at most 3^8 rows
    codes = np.array(sorted(r["pattern"] for r in counted), np.int64)
    number = {r["pattern"]: r["n"] for r in counted}
    patterns = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    post, accuracy = estimate(patterns, np.array([number[c] for c in codes.tolist()], float)) if len(codes) else (np.zeros(0), np.zeros(len(LABELLERS)))
    known = dict(zip(codes.tolist(), post.tolist(), strict=True))
    total = sum(number.values())
    top = 1 << 30
    draw = F.pmod(F.xxhash64(F.lit("quality sample"), F.col(f"`{text}`")), F.lit(top))
    chosen = docs.where(draw < int(top * min(1.0, sample / max(total, 1)))).select(F.col(f"`{text}`").alias("body"))

    def pack(data: np.ndarray, offsets: np.ndarray) -> list:
        v = votes(measures(data, offsets)) @ 3 ** np.arange(len(LABELLERS))
        x = shape_features(data, offsets)
        return [v, pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())]

    kind = T.StructType([T.StructField("pattern", T.LongType()), T.StructField("shape", T.BinaryType())])
    rows = A.annotate(chosen, "body", "made", kind, pack, []).select("made.pattern", "made.shape").distinct().collect()
    rows = sorted((r["pattern"], bytes(r["shape"])) for r in rows)
    x = np.frombuffer(b"".join(r[1] for r in rows), np.float16).reshape(len(rows), BUCKETS).astype(np.float32)
    weights, shift = fit_scorer(x, np.array([known[r[0]] for r in rows]))
    return QualityModel(weights, shift, dict(zip(LABELLERS, accuracy.tolist(), strict=True)), known)


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", into: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """Append struct ``into``: ``score`` of the linear scorer and ``weak_label``, the labellers' posterior."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(data: np.ndarray, offsets: np.ndarray) -> list:
        model = shared.value
        score, weak = [], []
        for i in range(0, len(offsets) - 1, 512):
            part = offsets[i : i + 513]
            d, o = data[part[0] : part[-1]], part - part[0]
            z = shape_features(d, o) @ model.weights + model.shift
            score.append(np.where(np.diff(o) > 0, 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30))), 0.0))
            v = votes(measures(d, o)) @ 3 ** np.arange(len(LABELLERS))
            weak.append(np.array([model.patterns.get(int(x), 0.5) for x in v]))
        return [np.concatenate(score), np.concatenate(weak)]

    return A.annotate(docs, text, into, T.StructType([T.StructField("score", T.DoubleType()), T.StructField("weak_label", T.DoubleType())]), fn, keep)

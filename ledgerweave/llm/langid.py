"""Language identification with a string kernel.

Texts are compared by the blended spectrum presence kernel: the number of different hashed character 1- to 3-grams
that both have, over the geometric mean of how many each has. Nyström landmarks give each text a feature vector
K(x, landmarks) K(landmarks, landmarks)^(-1/2); one-versus-rest kernel ridge regression on these features is solved in
closed form. Both maps are linear in the presence vector, so a batch of texts is scored by matrix products.

The model is fitted on a bounded sample of different labelled texts, chosen by the texts' hashes: about ``SAMPLE`` of each
language at most, and about ``SAMPLE_ROWS`` in all, which many languages share alike. Every row is scored, on its whole
text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; ties go to the smaller language code; if
no labelled row exists every text is ``und``; rows with equal texts get equal results; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave.llm import arrow_text as A
from ledgerweave.plans.checkpoint import cut

BUCKETS = 1 << 15
SAMPLE = 400
SAMPLE_ROWS = 16000
BROADCAST_ROWS = 100_000
LANDMARKS = 192
RIDGE = 1e-3
UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # buckets x languages

    def score(self, presence: np.ndarray) -> np.ndarray:
        """Shares of the languages' positive scores; rows of ``presence`` are texts."""
        size = np.maximum(presence.sum(1, keepdims=True), 1)
        raw = np.maximum(presence @ self.weights / np.sqrt(size), 1e-6) ** 2
        return raw / raw.sum(1, keepdims=True)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points of all rows, row offsets in them, and whether a row has a letter."""
    text = data.tobytes().decode("utf-8", "replace")
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    at = lead[offsets]
    seen = np.unique(points)
    letter = np.array([chr(c).isalpha() for c in seen.tolist()], bool)
    low = np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in seen.tolist()], np.int64)
    where = np.searchsorted(seen, points)
    has = A.range_sums(letter[where], at) > 0 if len(points) else np.zeros(len(at) - 1, bool)
    folded = np.where(letter, low, 32)[where] if len(points) else points  # digits and symbols say nothing
    return folded, at, has


def presence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows x buckets of 0 and 1, and whether a row has a letter."""
    points, at, has = code_points(data, offsets)
    rows = len(at) - 1
    out = np.zeros((rows, BUCKETS), np.float32)
    flat = out.ravel()
    row = np.repeat(np.arange(rows), np.diff(at)) * BUCKETS
    keys = points.astype(np.uint64)
    for size in (1, 2, 3):
        if len(points) < size:
            break
        code = keys[: len(keys) - size + 1] * np.uint64(0x9E3779B97F4A7C15)
        for j in range(1, size):
            code = (code ^ keys[j : len(keys) - size + 1 + j]) * np.uint64(0xBF58476D1CE4E5B9 + 2 * j)
        bucket = (code >> np.uint64(49)).astype(np.int64)
        same = row[: len(bucket)] == row[size - 1 :]
        flat[(row[: len(bucket)] + bucket)[same]] = 1
    return out, has


def fit(sample: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """Nyström features at evenly dealt landmarks, then ridge regression against each language's indicator.

    ``sample`` has the packed presence bits of a text in each row; they are unpacked in blocks.
    """
    languages = sorted(set(labels))
    y = (np.array(labels, object)[:, None] == np.array(languages, object)).astype(np.float64)

    def unit(rows: np.ndarray) -> np.ndarray:
        p = np.unpackbits(rows, axis=1).astype(np.float32)
        return p / np.sqrt(np.maximum(p.sum(1, keepdims=True), 1))

    pick = np.unique(np.linspace(0, len(labels) - 1, min(landmarks, len(labels))).astype(int))
    base = unit(sample[pick])
    kernel = np.concatenate([unit(sample[i : i + 128]) @ base.T for i in range(0, len(labels), 128)]).astype(np.float64)  # in blocks: the driver is small
    value, vector = np.linalg.eigh(kernel[pick])
    good = value > 1e-6 * value[-1]
    half = vector[:, good] / np.sqrt(value[good])
    features = kernel @ half
    balance = (1 / y.sum(0))[y.argmax(1)][:, None]  # each language weighs the same
    gram = features.T @ (features * balance) + ridge * np.eye(features.shape[1])
    beta = np.linalg.solve(gram, features.T @ (y * balance))
    return LanguageModel(languages, base.T @ (half @ beta).astype(np.float32))


def fit_languages(docs: DataFrame, where: Column, text: str = "text", lang: str = "lang", sample: int = SAMPLE, most: int = SAMPLE_ROWS) -> LanguageModel | None:
    """Fit on rows of ``where`` with a language and a letter; about ``sample`` different texts of each language.

    If that is more than ``most`` in all, each language gets an equal share of ``most``. A text is drawn by its own hash,
    so neither null nor repeated ids matter, and is taken once however often it occurs. What reaches the driver is one packed bit vector of 4 KiB per sampled row, whatever the texts' length.
    """
    known = docs.where(where).where(F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("body"))
    counts = cut(known.groupBy("lang").agg(F.count("*").alias("n")))
    languages = counts.count()
    if not languages:
        return None
    share = counts.select("lang", (F.lit(min(sample, most / languages)) / F.col("n")).alias("share"))
    share = F.broadcast(share) if languages <= BROADCAST_ROWS else share
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("language sample"), "body"), 11).cast("double") / float(1 << 53)
    chosen = known.join(share, "lang").where(draw < F.col("share")).select("lang", "body").distinct()

    def pack(data: np.ndarray, offsets: np.ndarray) -> list:
        bits, has = _in_blocks(data, offsets, lambda d, o: (lambda p, h: (np.packbits(p.astype(bool), axis=1), h))(*presence(d, o)))
        return [pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(has)]

    kind = T.StructType([T.StructField("bits", T.BinaryType()), T.StructField("has", T.BooleanType())])
    rows = A.annotate(chosen, "body", "made", kind, pack, ["lang"]).where("made.has").select("lang", "made.bits").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (bytes(r["bits"])[:64], r["lang"], bytes(r["bits"])))
    bits = np.frombuffer(b"".join(bytes(r["bits"]) for r in rows), np.uint8).reshape(len(rows), -1)
    return fit(bits, [r["lang"] for r in rows])


def _in_blocks(data: np.ndarray, offsets: np.ndarray, fn, rows: int = 256) -> tuple:
    made = []
    for i in range(0, len(offsets) - 1, rows):
        part = offsets[i : i + rows + 1]
        made.append(fn(data[part[0] : part[-1]], part - part[0]))
    return tuple(np.concatenate(x) for x in zip(*made, strict=True))


def score_batch(model: LanguageModel, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language numbers (-1: none) and scores."""

    def block(d: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits, has = presence(d, o)
        share = model.score(bits)
        best = share.argmax(1)
        return np.where(has, best, -1), np.where(has, share[np.arange(len(best)), best], 0.0)

    return _in_blocks(data, offsets, block)


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text", into: str = "language", keep: list[str] | None = None) -> DataFrame:
    """Append struct ``into`` of ``lang`` and ``score`` (0 to 1)."""
    names = [*(model.languages if model else []), UNKNOWN]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(data: np.ndarray, offsets: np.ndarray) -> list:
        model = shared.value
        if model is None:
            best, score = np.full(len(offsets) - 1, -1), np.zeros(len(offsets) - 1)
        else:
            best, score = score_batch(model, data, offsets)
        return [pa.array(np.array(names, object)[best], pa.string()), pa.array(score.astype(float))]

    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    return A.annotate(docs, text, into, kind, fn, keep)

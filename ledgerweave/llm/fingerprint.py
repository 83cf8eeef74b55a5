"""Document fingerprints: a homomorphic multiset hash of paragraphs. Built-in functions only.

A paragraph is a line. Its wide vector has EXACT lanes of 32 bits, hashed from the whole line, and SKETCH lanes, each
the sum over the line's pieces (at most ``PIECE`` code points) of one bit of the piece's hash. A document's
fingerprint is the lane-wise sum over its paragraphs, exact lanes modulo 2^32 and sketch lanes modulo 2^20, so it does
not depend on the paragraphs' order, and a paragraph is inserted or deleted by adding or subtracting its vector
(:func:`combine`). Equal multisets of paragraphs have equal fingerprints. A sketch lane counts ones among n fair bits,
so the cosine of the centred lanes (read as signed numbers of 21 bits, as they are small beside n) estimates how much
two multisets of pieces share.

Defined cases: null and empty texts have no paragraphs and the zero fingerprint; likeness is 1 for equal fingerprints
and 0 if only one is zero; ids may repeat (ties follow the text's hash, then the text) or be null (they come first);
one document is its own next; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

PIECE = 48
EXACT = 8
#: Three lanes of 20 bits to a word, each below a bit that takes the carry and is cleared; 21 words for each of two hashes.
FIELDS = 0x0000040000200001
KEPT = FIELDS * ((1 << 20) - 1)
SHIFTS = 21
HASHES = 2
LANES = SHIFTS * 3 * HASHES
LOW20 = (1 << 20) - 1
ROWS_PER_RANGE = 2000
MAX_RANGES = 1 << 16


def add_vector(frame: DataFrame, text: Column, into: str) -> DataFrame:
    """Append array<long> ``into``: EXACT lanes, then packed sketch words, then the number of pieces.

    Lines, pieces and their hashes are columns of their own, so that each is made once however many lanes read it.
    """
    seeded = lambda seed: lambda x: F.xxhash64(F.lit(seed), x)  # noqa: E731  (a lambda's second argument is the index)
    field = lambda b: lambda a, h: (a + F.shiftrightunsigned(h, b).bitwiseAND(F.lit(FIELDS))).bitwiseAND(F.lit(KEPT))
    name = lambda i: f"{into}_made_{i}"
    body = F.coalesce(text, F.lit(""))
    frame = frame.withColumns({name("lines"): F.filter(F.split(body, "\n"), lambda x: x != ""), name("pieces"): F.regexp_extract_all(body, F.lit(rf"[^\n]{{1,{PIECE}}}"), F.lit(0))})
    hashed = {name(i): F.transform(name("lines"), seeded(i)) for i in range(EXACT // 2)}
    hashed |= {name(100 + j): F.transform(name("pieces"), seeded(100 + j)) for j in range(HASHES)}
    frame = frame.withColumns(hashed | {name("n"): F.size(name("pieces")).cast("long")}).drop(name("lines"), name("pieces"))
    mask = F.lit(0xFFFFFFFF)
    zero = F.lit(0).cast("long")
    exact = [F.aggregate(name(i), zero, f).bitwiseAND(mask) for i in range(EXACT // 2) for f in (lambda a, h: a + F.shiftrightunsigned(h, 32), lambda a, h: a + h.bitwiseAND(F.lit(0xFFFFFFFF)))]
    sketch = [F.aggregate(name(100 + j), zero, field(b)) for j in range(HASHES) for b in range(SHIFTS)]
    made = frame.withColumn(into, F.array(*exact, *sketch, F.col(name("n"))))
    return made.drop(*hashed, name("n"))


def _lanes(v: Column) -> Column:
    """Centred sketch lanes: twice the ones, less the pieces, modulo 2^21 and signed."""
    words = F.slice(v, EXACT + 1, SHIFTS * HASHES)
    n = F.element_at(v, -1)
    part = lambda s: F.transform(words, lambda w: (F.shiftrightunsigned(w, s).bitwiseAND(F.lit(LOW20)) * 2 - n + LOW20 + 1).bitwiseAND(F.lit(2 * LOW20 + 1)) - (LOW20 + 1))
    return F.concat(part(0), part(21), part(42))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of two fingerprints' centred sketches, clipped to 0 to 1; 1 if they are equal."""
    x, y = _lanes(a), _lanes(b)
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, t: s + t)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    cosine = F.when(norm > 0, F.least(F.greatest(dot(x, y) / norm, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(cosine)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint vector with the paragraphs of ``b`` added (sign 1) or taken away (sign -1), lane by lane."""
    one = lambda w, v, s: F.shiftrightunsigned(w, s).bitwiseAND(F.lit(LOW20)) + sign * F.shiftrightunsigned(v, s).bitwiseAND(F.lit(LOW20))

    def lane(u: Column, v: Column, i: Column) -> Column:
        packed = F.lit(0).cast("long")
        for s in (0, 21, 42):
            packed = packed.bitwiseOR(F.shiftleft(one(u, v, s).bitwiseAND(F.lit(LOW20)), s))
        return F.when(i < EXACT, (u + sign * v).bitwiseAND(F.lit(0xFFFFFFFF))).when(i == EXACT + SHIFTS * HASHES, u + sign * v).otherwise(packed)

    zipped = F.zip_with(a, b, lambda u, v: F.struct(u.alias("u"), v.alias("v")))
    return F.transform(zipped, lambda p, i: lane(p["u"], p["v"], i))


def as_text(v: Column) -> Column:
    """Lowercase hex: the exact lanes in full, then a digest of the sketch."""
    exact = F.array_join(F.transform(F.slice(v, 1, EXACT), lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")
    rest = F.array_join(F.transform(F.slice(v, EXACT + 1, SHIFTS * HASHES + 1), lambda x: F.lower(F.hex(x))), "-")
    return F.concat(exact, F.lit(":"), rest)


def _number(docs: DataFrame, id_col: str) -> tuple[Column, bool]:
    """A number that never falls as the id rises, and whether it tells ids apart.

    It is the number or time itself; for others the seven bytes after what the least and the greatest id share.
    """
    column, kind = F.col(f"`{id_col}`"), docs.schema[id_col].dataType
    if isinstance(kind, (T.IntegralType, T.DoubleType, T.FloatType)):
        return column.cast("long" if isinstance(kind, T.IntegralType) else "double"), True
    if isinstance(kind, T.DecimalType):
        return column.cast("double"), False
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return F.unix_micros(column.cast("timestamp")), True
    ends = docs.agg(F.min(column.cast("string")).alias("a"), F.max(column.cast("string")).alias("b")).first()
    a, b = ((ends[c] or "").encode() for c in "ab")
    shared = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    seven = F.substring(F.concat(F.hex(F.substring(column.cast("string").cast("binary"), shared + 1, 7)), F.lit("0" * 14)), 1, 14)
    return F.conv(seven, 16, 10).cast("long"), False


def _ranges(docs: DataFrame, id_col: str, tie: Column) -> Column:
    """A number that grows with the id, then ``tie`` (0 to 1), and deals the rows evenly.

    It is the number of the id's quantiles below it; a number that is several quantiles is dealt out by ``tie``, and so
    are null ids, which come first. At most ``MAX_RANGES`` quantiles reach the driver, one for ``ROWS_PER_RANGE`` rows.
    """
    number, exact = _number(docs, id_col)
    stats = docs.agg(F.count("*").alias("n"), F.count(number).alias("known")).first()
    none = min(MAX_RANGES, (stats["n"] - stats["known"]) // ROWS_PER_RANGE)
    ranges = min(MAX_RANGES, stats["known"] // ROWS_PER_RANGE + 1)
    unknown = F.floor(tie * none).cast("int")
    if ranges < 2:
        return F.when(number.isNull(), unknown).otherwise(F.lit(none))
    shares = ", ".join(f"{i / ranges}D" for i in range(1, ranges))
    cuts = docs.select(number.alias("number")).agg(F.expr(f"percentile_approx(number, array({shares}), {20 * ranges})").alias("q")).first()["q"]
    kind = "double" if isinstance(cuts[0], float) else "bigint"
    known = F.split(F.lit(",".join(map(repr, sorted(cuts)))), ",").cast(f"array<{kind}>")  # one literal

    def search(below) -> Column:  # how many quantiles are below, by bisection
        def step(at: Column, k: Column) -> Column:
            to = at + F.pow(F.lit(2), k).cast("int")
            return F.when((to <= len(cuts)) & below(F.try_element_at(known, to)), to).otherwise(at)

        return F.aggregate(F.array(*[F.lit(k) for k in range(len(cuts).bit_length() - 1, -1, -1)]), F.lit(0), step)

    less, upto = search(lambda c: c < number), search(lambda c: c <= number)
    place = less + F.when(upto > less, F.lit(1) + F.least(F.floor(tie * (upto - less)).cast("int"), upto - less - 1)).otherwise(F.lit(0)) if exact else less
    return F.when(number.isNull(), unknown).otherwise(place + none).cast("int")


def with_next(docs: DataFrame, id_col: str, text: str, into: str = "fp") -> DataFrame:
    """id, text, fingerprint ``into``, and ``next_text`` and ``next_<into>`` of the following row by id, then text.

    Rows are dealt to id ranges and ordered within them. The first row of a range is also dealt, as a guest that is
    dropped at the end, to the range before it, and that of the first range to the last one. These rows are found by
    their ids, one of each range, which are broadcast.
    """
    digest = F.xxhash64(F.lit("tie"), F.coalesce(F.col(f"`{text}`"), F.lit("")))
    tie = F.shiftrightunsigned(digest, 11).cast("double") / float(1 << 53)
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"), F.shiftrightunsigned(digest, 11).alias("tie"), _ranges(docs, id_col, tie).alias("part"))
    key = F.struct(F.col("id").isNotNull().alias("known"), "id", "tie")
    low = plain.groupBy("part").agg(F.min(key).alias("low"))
    turn = Window.orderBy("part")
    every = turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    low = low.select("low", "part", F.coalesce(F.lag("part").over(turn), F.last("part").over(every)).alias("to"))  # one row a range
    guests = plain.drop("part").join(F.broadcast(low.select("to", F.col("low.id").alias("low_id"), F.col("low.tie").alias("low_tie"))), (F.col("tie") == F.col("low_tie")) & F.col("id").eqNullSafe(F.col("low_id")))
    guests = guests.groupBy("to").agg(F.min(F.struct("id", "tie", "body")).alias("row")).select("row.id", "row.body", "row.tie", F.col("to").alias("part"), F.lit(True).alias("guest"))
    window = Window.partitionBy("part").orderBy("guest", F.col("id").asc_nulls_first(), "tie", "body")
    made = add_vector(plain.withColumn("guest", F.lit(False)).unionByName(guests), F.col("body"), into)
    led = made.withColumn("next_row", F.lead(F.struct("body", into)).over(window)).where(~F.col("guest"))
    return led.select(F.col("id").alias(id_col), F.col("body").alias(text), into, F.col("next_row.body").alias(f"next_{text}"), F.col(f"next_row.{into}").alias(f"next_{into}"))


def edited(text: Column, following: Column) -> Column:
    """The last half of ``text`` (rounded down) replaced by as much of the start of ``following``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(following, F.lit(1), half))

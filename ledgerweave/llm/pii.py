"""Personal data: regular expressions propose, checksums confirm, context words adjust. Built-in functions only.

Base kinds: email, ip (four parts up to 255), card (12 to 19 digits that pass Luhn) and phone (international form, 9
to 15 digits). Added kinds: iban (mod-97) and secret (a quoted or bare key of 20 or more word characters next to a
word such as token or password). Every span has a score: a kind's base score, raised when one of the kind's context
words stands within ``NEAR`` characters before it (and after the pattern's match before), lowered without one.

The expressions are written so that matching is linear: runs are possessive or start-anchored by look-behind, and no
group that could backtrack repeats often, so very long texts neither backtrack nor overflow the stack. Positions are
code points; they come from the lengths of matches and of the pieces between them. Running sums and maxima go by
blocks of the square root of the matches, and text is cut from chunks, so no step looks at all matches for each match.

Defined cases: null text counts as empty and has no spans; matches that fail their check are dropped and not retried;
base spans always stay, added spans that overlap a base span are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm import arrow_text as A

NEAR = 40
CHUNK = 512
KINDS = ("email", "ip", "card", "phone", "iban", "secret")
BASE_KINDS = KINDS[:4]

# Proposal patterns (Java syntax), base scores and context words.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])(?:[0-9][ -]?){11,18}[0-9](?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
SECRET = r"(?i)(?<![A-Za-z0-9_])(?:token|secret|password|passwd|api_key|apikey|access_key)(?: {0,2}[=:] {0,2})[\"']?[A-Za-z0-9+/_-]{20,}+"
BYTE_PART = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
SCORES = {"email": 0.95, "ip": 0.7, "card": 0.8, "phone": 0.75, "iban": 0.9, "secret": 0.8}
CONTEXT = {"email": "mail|contact|write", "ip": "ip|address|host|server|login", "card": "card|visa|credit|debit|pay|karte|carte|tarjeta", "phone": "phone|tel|call|fax|mobile|contact", "iban": "iban|bank|account|konto|compte|cuenta", "secret": "token|secret|password|key"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once, however often ``body`` and lambdas in it read it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each of an array's longs, those before it joined (0 for the first): sums or maxima, in n * sqrt(n) steps."""
    zero = F.lit(0).cast("long")

    def scan(items: Column, begin: Column) -> Column:
        first = F.struct(F.array().cast("array<bigint>").alias("out"), begin.alias("at"))
        step = lambda acc, x: F.struct(F.concat(acc["out"], F.array(acc["at"])).alias("out"), join(acc["at"], x).alias("at"))
        return F.aggregate(items, first, step, lambda acc: acc["out"])

    def by_blocks(v: Column, width: Column) -> Column:
        last = F.greatest(F.ceil(F.size(v) / width).cast("int") - 1, F.lit(0))
        blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(v, i * width + 1, width))
        return let(blocks, lambda b: F.flatten(F.zip_with(b, scan(F.transform(b, lambda x: F.aggregate(x, zero, join)), zero), scan)))

    return let(values, lambda v: let(F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1)), lambda w: by_blocks(v, w)))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _proposals(text: Column, pattern: str) -> Column:
    """Array of struct(t, s, before): the matches, their first code points, and the text that stands before them."""
    pieces = F.split(text, pattern, -1)
    pair = lambda p, t: F.struct(t.alias("t"), F.right(p, F.lit(NEAR)).alias("before"), F.length(p).cast("long").alias("gap"), (F.length(p) + F.length(t)).cast("long").alias("both"))
    pairs = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, pair))
    place = lambda x, a: F.struct(x["t"].alias("t"), (a + x["gap"]).cast("int").alias("s"), x["before"].alias("before"))
    return let(pairs, lambda all_: F.zip_with(all_, running(F.transform(all_, lambda x: x["both"]), _plus), place))


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if the digits pass: from the right, every second one doubled, digits of the doubles added."""
    chars = F.reverse(F.filter(F.split(number, ""), lambda c: c != ""))
    value = F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """True if the account number, first four characters moved last and letters as 10 to 35, is 1 modulo 97."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    chars = F.filter(F.split(F.concat(F.substring(plain, 5, 1000), F.substring(plain, 1, 4)), ""), lambda c: c != "")
    number = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + number(c)) % 97
    return F.aggregate(chars, F.lit(0), step) == 1


def _confirmed(kind: str, t: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(t, r"\."), lambda p: p.rlike(BYTE_PART))
    if kind == "card":
        return F.length(_digits(t)).between(12, 19) & luhn(_digits(t))
    if kind == "phone":
        return F.length(_digits(t)).between(9, 15)
    if kind == "iban":
        return mod97(t)
    return F.lit(True)


def _spans(text: Column, kind: str, pattern: str, guard: Column) -> Column:
    """Confirmed spans of one kind as array<struct<s, e, k, kind, score>>."""
    none = F.array().cast("array<struct<s:int,e:int,k:int,kind:string,score:double>>")
    kept = F.filter(_proposals(text, pattern), lambda x: _confirmed(kind, x["t"]))
    words = CONTEXT[kind]

    def span(x: Column) -> Column:
        near = F.lower(x["before"]).rlike(f"(?:{words})") if kind != "secret" else F.lit(True)
        score = F.least(F.lit(SCORES[kind]) + F.when(near, 0.15).otherwise(-0.05), F.lit(1.0))
        return F.struct(x["s"].alias("s"), (x["s"] + F.length(x["t"])).alias("e"), F.lit(KINDS.index(kind)).alias("k"), F.lit(kind).alias("kind"), score.cast("double").alias("score"))

    return F.when(guard, F.transform(kept, span)).otherwise(none)


def find_pii(docs: DataFrame, text: str = "text", into: str = "pii", least: float = 0.0) -> DataFrame:
    """Append array ``into`` of structs (s, e, k, kind, score), sorted by start and kind; ``least`` bounds added kinds.

    An input column named ``into`` is replaced.
    """
    body = A.fresh([*docs.columns, into], "pii_text")
    base, more = A.fresh([*docs.columns, into, body], "pii_base"), A.fresh([*docs.columns, into, body], "pii_more")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    t = F.col(body)
    digits = t.rlike("[0-9]")
    base_spans = F.concat(
        _spans(t, "email", EMAIL, F.contains(t, F.lit("@"))),
        _spans(t, "ip", IP, digits & t.rlike(r"[0-9]\.[0-9]")),
        _spans(t, "card", CARD, digits & t.rlike("(?:[0-9][ -]?){12}")),
        _spans(t, "phone", PHONE, F.contains(t, F.lit("+"))),
    )
    added = F.concat(_spans(t, "iban", IBAN, digits & t.rlike("[A-Z]{2}[0-9]{2}")), _spans(t, "secret", SECRET, t.rlike("(?i)token|secret|passw|_key|apikey")))
    frame = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != into], whole.alias(body)).withColumns({base: base_spans, more: added})
    free = F.filter(F.col(more), lambda x: x["score"] >= least)
    merged = F.array_sort(F.concat(F.col(base), F.when(F.size(more) > 0, _apart(free, F.col(base))).otherwise(F.col(more))))
    return frame.withColumn(into, merged).drop(body, base, more)


def _apart(spans: Column, base: Column) -> Column:
    """The ``spans`` that overlap none of ``base``: the base spans that begin before a span's end must end by its start."""
    event = lambda at, asks, stop, x: F.struct(at.alias("at"), F.lit(asks).alias("asks"), stop.cast("long").alias("stop"), x.alias("x"))
    begins = F.transform(base, lambda b: event(b["s"], 1, b["e"], b))
    asked = F.transform(spans, lambda x: event(x["e"], 0, F.lit(0), x))
    events = F.array_sort(F.concat(begins, asked))
    with_reach = lambda v, r: F.struct(v["asks"].alias("asks"), v["x"].alias("x"), r.alias("reach"))
    both = let(events, lambda all_: F.zip_with(all_, running(F.transform(all_, lambda v: v["stop"]), _most), with_reach))
    return F.transform(F.filter(both, lambda v: (v["asks"] == 0) & (v["reach"] <= v["x"]["s"])), lambda v: v["x"])


def redact(docs: DataFrame, text: str = "text", least: float = 0.0) -> DataFrame:
    """The text with every span replaced by its kind in angle brackets; other columns unchanged.

    Of overlapping spans the earlier start wins and the text between is covered up to the later end.
    """
    name = A.fresh(docs.columns, "pii_found")
    parts = A.fresh([*docs.columns, name], "pii_chunks")
    found = find_pii(docs, text, name, least)
    spans, chunks, body = F.col(name), F.col(parts), F.col(f"`{text}`")

    def piece(begin: Column, end: Column) -> Column:
        first = F.floor(begin / CHUNK).cast("int")
        near = F.array_join(F.slice(chunks, first + 1, F.floor(end / CHUNK).cast("int") - first + 1), "")
        return F.substr(near, (begin - first * CHUNK + 1).cast("int"), F.greatest(end - begin, F.lit(0)))

    ends = running(F.transform(spans, lambda x: x["e"].cast("long")), _most)
    placed = F.filter(F.zip_with(spans, ends, lambda x, a: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), a.cast("int").alias("at"))), lambda x: x["s"] >= x["at"])
    marked = F.array_join(F.transform(placed, lambda x: F.concat(piece(x["at"], x["s"]), F.lit("<"), x["kind"], F.lit(">"))), "")
    clean = F.concat(marked, piece(F.array_max(F.transform(spans, lambda x: x["e"])), F.length(body)))
    found = found.withColumn(parts, F.when(F.size(name) > 0, F.regexp_extract_all(body, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))))
    value = F.when(F.size(name) > 0, clean).otherwise(body)
    return found.select(*[(value if c == text else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")

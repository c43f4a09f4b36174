"""Operator 3, personal data: patterns propose spans, checksums confirm them, context scores them.

DataFrame functions only. Positions come without a search loop: `split` gives the text between the
matches of a pattern and `regexp_extract_all` the matches, so running lengths are the offsets.
Offsets are in code points, end exclusive. Running sums go by blocks of BLOCK matches, and context is
read from pieces of PIECE code points, so a text of any length with any number of matches costs time
in proportion to both.

Kinds in order: email, ip, card, phone (the base kinds), then iban and idnum (added by the method).
An IBAN is confirmed by mod-97, a card by Luhn, an address by its parts. A kind's start score rises
by its validator and by words that speak for it within CONTEXT characters, and falls by words that
speak against it (an order number, a version); base spans always stay, added spans need MIN_SCORE.

Defined cases: null and empty texts have no spans (the digest of the empty string); repeated rows
each get a row; an empty table gives no rows; `redact` returns extra columns of any name unchanged.
Patterns use possessive repeats, so long runs of matching characters cost linear time and no stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed

KINDS = ["email", "ip", "card", "phone", "iban", "idnum"]
BASE_KINDS = KINDS[:4]

#: Proposing patterns. `\G|` lets a match begin where the last one ended; the look-behind keeps a
#: failed run from being tried again from each of its characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "idnum": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
}
#: A text without a match of this has none of the kind; far cheaper than the pattern.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "idnum": r"[0-9]-[0-9]"}
#: Score of a bare match, and of a confirmed one.
START = {"email": 0.6, "ip": 0.4, "card": 0.3, "phone": 0.5, "iban": 0.3, "idnum": 0.3}
CONFIRMED = {"email": 0.3, "ip": 0.3, "card": 0.5, "phone": 0.3, "iban": 0.6, "idnum": 0.0}
CONTEXT = 40
CONTEXT_SCORE = 0.3
AGAINST_SCORE = 0.2
MIN_SCORE = 0.6
#: Matches a block of a running sum, and code points a piece of a long text.
BLOCK = 256
PIECE = 4096
#: Words that speak for a kind when they stand near a span.
WORDS = {
    "email": "mail|contact|correo|courriel|kontakt",
    "ip": "ip|address|host|server|adresse",
    "card": "card|visa|credit|tarjeta|carte|karte|payment",
    "phone": "phone|tel|call|mobile|telefon|llama",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "idnum": "ssn|social security|taxpayer|national id|identity number",
}
#: Words that speak against a kind, where none speaks for it.
AGAINST = {
    "email": "example only|placeholder",
    "ip": "version|release|section|chapter",
    "card": "order|invoice|isbn|tracking|serial",
    "phone": "order|invoice|isbn|tracking|serial",
    "iban": "part number|serial|licen[cs]e key",
    "idnum": "order|invoice|part number|serial|lot",
}
SPANS = "array<struct<start:int,kind:int,end:int,score:double>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right Luhn sum."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))
    total = F.aggregate(
        F.transform(each, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)),
        F.lit(0),
        lambda a, d: a + d,
    )
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN leaves 1 modulo 97; letters count as 10 to 35, spaces not at all."""
    iban = F.translate(iban, " ", "")
    turned = F.concat(F.substring(iban, 5, 60), F.substring(iban, 1, 4))
    codes = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.ascii(c))
    rest = F.aggregate(
        codes,
        F.lit(0),
        lambda a, c: F.when(c < 58, (a * 10 + c - 48) % 97).otherwise((a * 100 + c - 55) % 97),
    )
    return rest == 1


def _shorten(x: Column) -> Column:
    """A proposed IBAN may run on into following capitals: its longest confirmed run of groups, of 12
    characters at least as in the pattern."""
    groups = F.split(x["m"], " ")
    runs = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(groups, F.lit(1), n), " "))
    valid = F.filter(runs, lambda m: (F.length(F.translate(m, " ", "")) >= 12) & mod97(m))
    best = F.coalesce(F.get(valid, F.lit(0)), x["m"])
    return F.struct(x["s"].alias("s"), (x["s"] + F.length(best)).alias("e"), best.alias("m"))


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})$"))
    if kind == "card":
        n = F.length(digits)
        return F.when((n >= 12) & (n <= 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(match)
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for a row."""
    return F.transform(F.array(value), body)[0]


def _before(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of ints, `join` (sum or maximum) of all before it, 0 for the first.

    By blocks: a fold that appends copies its array each time, so it runs over one block, and over the
    blocks' totals, never over the whole array.
    """

    def fold(part: Column, since: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(since.alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, v: F.struct(join(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"],
        )

    many = F.floor((F.greatest(F.size(values), F.lit(1)) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), many), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))

    def summed(parts: Column) -> Column:
        totals = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), join))
        return _let(fold(totals, F.lit(0)), lambda since: F.flatten(F.transform(parts, lambda part, i: fold(part, F.get(since, i)))))

    return _let(blocks, summed)


def _pieces(t: Column) -> Column:
    """The text in pieces of PIECE code points; a text of up to two pieces stays whole."""
    return F.when(F.length(t) <= 2 * PIECE, F.array(t)).otherwise(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))


def _cut(pieces: Column, since: Column, to: Column) -> Column:
    """Code points since to `to` of a text in pieces, without a walk through all that stands before."""
    whole = F.size(pieces) == 1
    first = F.when(whole, F.lit(0)).otherwise(F.floor(since / PIECE).cast("int"))
    last = F.when(whole, F.lit(0)).otherwise(F.floor(F.greatest(to - 1, since) / PIECE).cast("int"))
    some = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
    return F.substring(some, since - first * PIECE + 1, F.greatest(to - since, F.lit(0)))


def _spans(pieces: Column, text: Column, kind: str) -> Column:
    """Confirmed spans of one kind: array of (start, kind number, end, score)."""
    number = KINDS.index(kind)

    def found(both: Column) -> Column:
        pairs = F.arrays_zip(
            F.transform(F.split(both["text"], PATTERNS[kind]), lambda p: F.length(p)).alias("gap"),
            F.regexp_extract_all(both["text"], F.lit(PATTERNS[kind]), 0).alias("match"),
        )
        return _let(pairs, lambda p: scored(p, both["pieces"]))

    def scored(pairs: Column, pieces: Column) -> Column:
        lengths = F.transform(pairs, lambda p: p["gap"] + F.coalesce(F.length(p["match"]), F.lit(0)))
        since = _let(lengths, lambda n: _before(n, lambda a, v: a + v))
        placed = F.zip_with(
            pairs,
            since,
            lambda p, at: F.struct(
                (at + p["gap"]).alias("s"), (at + p["gap"] + F.coalesce(F.length(p["match"]), F.lit(0))).alias("e"), p["match"].alias("m")
            ),
        )
        placed = F.filter(placed, lambda x: x["m"].isNotNull())
        if kind == "iban":
            placed = F.transform(placed, _shorten)
        kept = F.filter(placed, lambda x: _valid(kind, x["m"]))

        def score(x: Column) -> Column:
            near = F.concat(_cut(pieces, F.greatest(x["s"] - CONTEXT, F.lit(0)), x["s"]), F.lit(" "), _cut(pieces, x["e"], x["e"] + CONTEXT))

            def said(words: str) -> Column:
                return near.rlike(rf"(?i)(?<![A-Za-z])(?:{words})")

            adjust = F.when(said(WORDS[kind]), F.lit(CONTEXT_SCORE)).when(said(AGAINST[kind]), F.lit(-AGAINST_SCORE)).otherwise(F.lit(0.0))
            return F.lit(START[kind] + CONFIRMED[kind]) + adjust

        spans = F.transform(
            kept,
            lambda x: F.struct(
                x["s"].alias("start"), F.lit(number).alias("kind"), x["e"].alias("end"), F.greatest(F.least(score(x), F.lit(1.0)), F.lit(0.0)).alias("score")
            ),
        )
        return spans if kind in BASE_KINDS else F.filter(spans, lambda x: x["score"] >= MIN_SCORE)

    seen = F.struct(text.alias("text"), pieces.alias("pieces"))
    return F.when(text.rlike(HINTS[kind]), _let(seen, found).cast(SPANS)).otherwise(F.array().cast(SPANS))


def find_spans(docs: DataFrame, text: str = "text", to: str = "_spans") -> DataFrame:
    """Add column `to`: the spans of all kinds sorted by start, then kind."""
    t = F.coalesce(F.col(text), F.lit(""))

    def both(pieces: Column) -> Column:
        digit = F.concat(*[_spans(pieces, t, k) for k in KINDS if k != "email"])
        some = F.when(t.rlike("[0-9]"), digit).otherwise(F.array().cast(SPANS))
        return F.sort_array(F.concat(_spans(pieces, t, "email"), some))

    found = F.when(t.rlike("[0-9@]"), _let(_pieces(t), both)).otherwise(F.array().cast(SPANS))
    return docs.withColumn(to, found)


def _named(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds and of the added ones, base_sha256, spans, max_score."""
    found = find_spans(docs.select("doc_id", "text")).drop("text")

    def number(i: int) -> Column:
        return F.size(F.filter("_spans", lambda x: x["kind"] == i)).cast("long")

    count = {f"n_{k}": number(i) for i, k in enumerate(KINDS)}
    base = F.filter("_spans", lambda x: x["kind"] < len(BASE_KINDS))
    return found.withColumns(
        count
        | {
            "base_sha256": F.sha2(_named(base), 256),
            "spans": _named(F.col("_spans")),
            "max_score": F.round(F.coalesce(F.array_max(F.transform("_spans", lambda x: x["score"])), F.lit(0.0)), 6),
        }
    ).drop("_spans")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span replaced by its kind in brackets; overlapping spans become one, named
    after the first. Nulls stay null; n_chars, where there is one, follows the new text; all other
    columns, whatever their names, stay as they are."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    found = find_spans(boxed(docs, text=F.col(f"`{text}`")))

    def done(spans: Column, pieces: Column) -> Column:
        def written(done_to: Column) -> Column:
            parts = F.zip_with(
                spans,
                done_to,
                lambda x, at: F.when(x["start"] >= at, F.concat(_cut(pieces, at, x["start"]), F.get(names, x["kind"]))).otherwise(F.lit("")),
            )
            rest = F.greatest(F.element_at(done_to, -1), F.element_at(spans, -1)["end"])
            return F.concat(F.array_join(parts, ""), _cut(pieces, rest, F.length("text")))

        return _let(_before(F.transform(spans, lambda x: x["end"]), lambda a, v: F.greatest(a, v)), written)

    new = F.when(F.size("_spans") > 0, _let(_pieces(F.col("text")), lambda pieces: done(F.col("_spans"), pieces))).otherwise(F.col("text"))
    found = found.select("row", new.alias("text"))
    out = []
    for c in docs.columns:
        old = F.col("row").getField(c)
        if c == text:
            out.append(F.col("text").alias(c))
        elif c == "n_chars":
            out.append(F.coalesce(F.length("text").cast(docs.schema[c].dataType), old).alias(c))
        else:
            out.append(old.alias(c))
    return found.select(*out)

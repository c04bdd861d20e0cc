"""Personal data: patterns propose, checksums confirm, context words weigh.

Native column expressions only. A kind's spans come from one pattern: its matches
(``regexp_extract_all``) and the pieces between them (``split``) alternate, so the
offsets are running sums of their lengths, in code points.

Patterns are written so that a run of characters is scanned once: a match can only
begin where a run begins (look-behind) or where the last match ended (``\\G``), loops
are possessive, and repeated groups are bounded or atomic, which keeps the matcher's
stack small on very long runs.

Defined results: a null text counts as empty; empty texts have no spans; repeated rows
give repeated results; other columns are left as they are, whatever their names, but the
column of spans replaces one of its name. Time is in proportion to a text's length and
matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named_back, set_apart

LOCAL = "[A-Za-z0-9._%+-]"
LABEL = "[A-Za-z0-9-]"

#: kind -> (pattern, cheap test that must hold before the pattern is tried)
BASE = {
    "email": (rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{LABEL}++(?:(?>(?:\.{LABEL}++){{1,64}}))++", "@"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])", "[0-9]"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
#: Kinds that the method adds to the base ones.
EXTRA = {
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z][A-Z][0-9][0-9]"),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]-[0-9]"),
}
KINDS = (*BASE, *EXTRA)

#: Words before a span that speak for a kind, and words that speak against it.
CONTEXT = {
    "email": "mail|e-mail|contact|write|reply",
    "ip": "ip|address|host|server|client",
    "card": "card|visa|mastercard|credit|payment|carte|karte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|llame",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security",
}
AGAINST = "version|example|isbn|order|serial|sample"
#: Score of a confirmed span without context; checksummed kinds start higher.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
UP, DOWN, NEAR = 0.15, 0.2, 40
#: Spans of added kinds count from this score on; base spans always stay.
EXTRA_FROM = 0.4
#: Entries of an array, and characters of a text, that are handled at once.
CHUNK, CHARACTERS = 64, 1024

SPAN = "struct<kind:string,start:int,end:int,score:double>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, also where lambdas in it refer to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(items: Column, op: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """For each entry of an int array (not empty) what `op` makes of all entries before it, from 0 on.

    In chunks of chunks: an array grows by one entry only within a chunk, so that long arrays take time in proportion.
    """
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    if not levels:
        return F.aggregate(items, none, lambda s, x: F.struct(op(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda i: F.slice(items, i * CHUNK + 1, CHUNK))

    def of_chunks(chunks: Column) -> Column:
        whole = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), op))
        return _let(_before(whole, op, levels - 1), lambda offs: F.flatten(F.transform(chunks, lambda c, i: _let(F.get(offs, i), lambda off: F.transform(_before(c, op, 0), lambda x: op(x, off))))))

    return _let(cut, of_chunks)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 modulo 97 (letters count 10 to 35)."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 65, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "iban":
        return mod97(F.replace(m, F.lit(" "), F.lit("")))
    return F.lit(True)


def _score(kind: str, near: Column) -> Column:
    """Score of a span by the characters before it."""
    before = F.lower(near)
    up = F.when(before.rlike(rf"(?<![a-z])(?:{CONTEXT[kind]})(?![a-z])"), UP).otherwise(0.0)
    down = F.when(before.rlike(rf"(?<![a-z])(?:{AGAINST})(?![a-z])"), DOWN).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(PRIOR[kind]) + up - down))


def _guard(text: Column, test: str) -> Column:
    return text.contains(test) if test in "@+" else text.rlike(test)


def _placed(kind: str, found: Column, pieces: Column) -> Column:
    """Valid matches of a kind with their offsets and scores.

    Context is what stands before a match, as far back as NEAR characters and the match before of its kind.
    """
    lens = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda a, b: F.length(a) + F.length(b))

    def span(starts: Column, m: Column, i: Column) -> Column:
        start = F.get(starts, i) + F.length(F.get(pieces, i))
        near = F.right(F.concat(F.right(F.coalesce(F.get(found, i - 1), F.lit("")), F.lit(NEAR)), F.get(pieces, i)), F.lit(NEAR))
        return F.struct(F.lit(kind).alias("kind"), start.cast("int").alias("start"), (start + F.length(m)).cast("int").alias("end"), m.alias("m"), near.alias("near"))

    def scored(s: Column) -> Column:
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _score(kind, s["near"]).alias("score"))

    spans = _let(_before(lens, lambda a, x: a + x), lambda starts: F.transform(found, lambda m, i: span(starts, m, i)))
    out = F.transform(F.filter(spans, lambda s: _valid(kind, s["m"])), scored)
    return F.filter(out, lambda s: s["score"] >= EXTRA_FROM) if kind in EXTRA else out


def with_spans(df: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """Adds `out`: array<struct<kind, start, end, score>>, by kind as in KINDS, then start."""
    df, names = set_apart(df)
    t = F.col("t")
    df = df.withColumn("t", F.coalesce(F.col(names[text]), F.lit("")))
    none = F.array().cast("array<string>")
    pats = {**BASE, **EXTRA}
    df = df.withColumns({f"{k}_found": F.when(_guard(t, test), F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none) for k, (p, test) in pats.items()})
    df = df.withColumns({f"{k}_pieces": F.when(F.size(f"{k}_found") > 0, F.split(t, p, -1)).otherwise(none) for k, (p, _) in pats.items()})
    spans = lambda k: _let(F.col(f"{k}_found"), lambda f: _let(F.col(f"{k}_pieces"), lambda p: _placed(k, f, p)))
    placed = [F.when(F.size(f"{k}_found") > 0, spans(k)).otherwise(F.array().cast(f"array<{SPAN}>")) for k in KINDS]
    return df.select(*named_back(names, out), F.concat(*placed).alias(out))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*BASE))


def digest(df: DataFrame, spans: str = "pii_spans") -> DataFrame:
    """doc_id, counts by base kind, hash of the base spans, all spans as text, and their scores in the same order."""
    s = F.col(spans)
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return df.select("doc_id", *[count(k) for k in BASE], F.sha2(spans_text(base_spans(s)), 256).alias("base_sha256"), spans_text(s).alias("spans"), F.array_join(F.transform(s, lambda x: F.round(x["score"], 2).cast("string")), ",").alias("scores"))


def redact(df: DataFrame, text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """Replaces what overlapping spans cover together by the kind of the first (then longest) of them in brackets."""
    df, names = set_apart(df)
    t, found = F.col(names[text]), F.col(names[spans])
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg_end"), s["kind"].alias("kind"))))

    def cut(chunks: Column, own: Column, reach: Column) -> Column:
        """Pieces of text, each but the last with the kind that follows. reach: the furthest end before each span."""
        heads = F.filter(F.zip_with(own, reach, lambda s, r: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), r.alias("reach"))), lambda s: s["start"] >= s["reach"])

        def piece(a: Column, b: Column) -> Column:
            first = F.floor(a / CHARACTERS).cast("int")
            some = F.array_join(F.slice(chunks, first + 1, F.floor(b / CHARACTERS).cast("int") - first + 1), "")
            return F.substring(some, a - first * CHARACTERS + 1, b - a)

        last = F.aggregate(own, F.lit(0), lambda a, s: F.greatest(a, -s["neg_end"]))
        kept = F.transform(heads, lambda s: F.concat(piece(s["reach"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.concat(F.array_join(kept, ""), _let(last, lambda end: piece(end, F.length(t))))

    reach = lambda own: _before(F.transform(own, lambda s: -s["neg_end"]), lambda a, x: F.greatest(a, x))
    done = _let(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{CHARACTERS}}}"), F.lit(0)), lambda chunks: _let(ordered, lambda own: _let(reach(own), lambda r: cut(chunks, own, r))))
    new = F.when(F.size(found) > 0, done).otherwise(t)
    return df.select(*[new.alias(c) if c == text else F.col(v).alias(c) for c, v in names.items()])

"""Text functions as native columns. Patterns use Java's Unicode classes, ``(?U)``, where the semantics need them.

A null text counts as empty unless a function says otherwise.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import grams as G
from . import patterns as P
from . import similarity as S


def text0(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    """Without Unicode white space at the two ends."""
    return F.btrim(c, F.lit(P.WHITE_SPACE))


def compact(c: Column) -> Column:
    """Without any Unicode white space."""
    return F.regexp_replace(text0(c), r"(?U)\s+", "")


def compact_length(c: Column) -> Column:
    return F.length(compact(c))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC; Spark has no built-in."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x or ""))


@functools.cache
def not_normal(gap: int = 24) -> str:
    """A regular expression class of all characters that NFKC may change, alone or with those before them.

    That is what isn't its own NFKC form, what has a combining class, and what a composition may end with. Characters less
    than `gap` apart are joined to ranges (the class may be larger than needed), but for ASCII and the letters of Latin-1.
    """
    marked, points = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3)), [*range(0x80, 0xD800), *range(0xE000, 0x30000)]
    for c in points:
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            marked.add(int(parts[1], 16))
        if unicodedata.combining(chr(c)) or not unicodedata.is_normalized("NFKC", chr(c)):
            marked.add(c)
    ranges: list[list[int]] = []
    for c in sorted(marked):
        if ranges and c - ranges[-1][1] < gap and (c < 0xC0 or c > 0x17F) and not ranges[-1][1] < 0xD800 <= c:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


#: Java tries the ranges of not_normal one after another; at ASCII and the letters of Latin-1 this fails at once.
_MAY_CHANGE = r"(?=[\x{A0}-\x{BF}\x{100}-\x{10FFFF}])"


@F.pandas_udf(T.StringType())
def _nfkc_of_some(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normal(c: Column | str) -> Column:
    """Unicode NFKC: texts without a character that it may change stay in the engine, only the others go through Python."""
    t = text0(c)
    return F.coalesce(_nfkc_of_some(F.when(t.rlike(_MAY_CHANGE + not_normal()), t)), t)


_WIDE = "".join(chr(x) for x in range(0xFF01, 0xFF5F)) + "　"
_ASCII = "".join(chr(x) for x in range(0x21, 0x7F)) + " "
#: The same in SQL; {x} is the text.
NFKC_ASCII_SQL = f"translate(coalesce({{x}}, ''), '{_WIDE}', '{_ASCII.replace(chr(39), chr(39) * 2).replace('{', '{{').replace('}', '}}')}')"


def nfkc_ascii(c: Column) -> Column:
    """The part of NFKC that fact extraction relies on, natively: full-width ASCII and the ideographic blank."""
    return F.translate(text0(c), _WIDE, _ASCII)


def _cut(c: Column, start: Column, end: Column | None = None) -> Column:
    """Characters from 1-based `start` up to before `end`."""
    n = F.length(c) if end is None else F.greatest(F.lit(0), end - start)
    return F.substring(c, start, n)


def _last(c: Column, mark: str) -> Column:
    """1-based place of the last `mark`, 0 if there is none."""
    at = F.locate(mark[::-1], F.reverse(c))
    return F.when(at == 0, F.lit(0)).otherwise(F.length(c) - at - len(mark) + 2)


def _no_marks(c: Column, *marks: str) -> Column:
    return reduce(lambda x, m: F.replace(x, F.lit(m), F.lit("")), marks, c)


def _answer(tail: Column) -> Column:
    """What lies between the first opening and the last closing tag, or all of it, without stray tags."""
    first, last = F.locate(P.ANSWER, tail), _last(tail, P.ANSWER_END)
    begin = first + len(P.ANSWER)
    inner = F.when((last > 0) & (last > first), _cut(tail, begin, last)).otherwise(_cut(tail, begin))
    return strip(_no_marks(F.when(first > 0, inner).otherwise(tail), P.ANSWER, P.ANSWER_END))


def parse_think_answer(c: Column | str) -> Column:
    """struct<think, answer>; without a closing think tag all of the text is the answer's."""
    t = text0(c)
    close = F.locate(P.THINK_END, t)
    think = F.when(close > 0, strip(_no_marks(_cut(t, F.lit(1), close), P.THINK))).otherwise("")
    tail = F.when(close > 0, _cut(t, close + len(P.THINK_END))).otherwise(t)
    return F.struct(think.alias("think"), _answer(tail).alias("answer"))


def parse_diagnostic(c: Column | str) -> Column:
    """struct<think, answer, format_ok, format_reason>; a reply cut off while thinking keeps its think part and has no answer."""
    t = text0(c)
    close, opened = F.locate(P.THINK_END, t), F.locate(P.THINK, t)
    cut_off = F.when(opened > 0, strip(F.concat(_cut(t, F.lit(1), opened), _cut(t, opened + len(P.THINK))))).otherwise("")
    think = F.when(close > 0, strip(_no_marks(_cut(t, F.lit(1), close), P.THINK))).otherwise(cut_off)
    answer = F.when(close > 0, _answer(_cut(t, close + len(P.THINK_END)))).otherwise("")
    reasons = F.concat_ws("+", F.when(close == 0, F.lit("missing_think_close")), F.when(think == "", F.lit("empty_think")), F.when(answer == "", F.lit("empty_answer")))
    return F.struct(think.alias("think"), answer.alias("answer"), (reasons == "").alias("format_ok"), F.when(reasons == "", F.lit("ok")).otherwise(reasons).alias("format_reason"))


def strict_tags(c: Column | str) -> Column:
    """Whether think and answer tags come in order, each closed."""
    t = text0(c)
    a, b = F.locate(P.THINK, t), F.locate(P.THINK_END, t)
    x = F.when(b > 0, F.locate(P.ANSWER, _cut(t, b + len(P.THINK_END)))).otherwise(F.lit(0))
    opened = F.when(x > 0, x + b + len(P.THINK_END) - 1).otherwise(F.lit(0))
    return (a > 0) & (a < b) & (b < opened) & (opened < _last(t, P.ANSWER_END))


def last_answer(c: Column | str) -> Column:
    """Older parser: what follows the last opening answer tag, up to a closing one."""
    t = text0(c)
    at = _last(t, P.ANSWER)
    body = _cut(t, at + len(P.ANSWER))
    close = F.locate(P.ANSWER_END, body)
    return F.when(at == 0, F.lit("")).otherwise(strip(F.when(close > 0, _cut(body, F.lit(1), close)).otherwise(body)))


def extract_references(c: Column | str, head: str = P.REFERENCES_HEAD, end: str = P.QUESTION_HEAD) -> Column:
    """Text between two markers; to the end without the second, empty without the first."""
    t = text0(c)
    a = F.locate(head, t)
    rest = _cut(t, a + len(head))
    b = F.locate(end, rest)
    return F.when(a == 0, F.lit("")).otherwise(strip(F.when(b > 0, _cut(rest, F.lit(1), b)).otherwise(rest)))


def build_user_prompt(query: Column, items: Column, top_k: int, head: str = P.REFERENCES_HEAD, question: str = P.QUESTION_HEAD) -> Column:
    """References in order (title and content; empty contents left out, top_k at most), then the question."""
    full = F.filter(F.slice(items, 1, top_k), lambda x: strip(text0(x["content"])) != "")
    lines = F.transform(full, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]【"), text0(x["title"]), F.lit("："), strip(x["content"]), F.lit("】")))
    return F.concat(F.lit(head + "\n"), F.array_join(lines, "\n"), F.lit("\n" + question + "\n"), text0(query))


def parse_refs(c: Column | str) -> Column:
    """array<struct<title, content>> of lines [..]【title：content】; a text without any such line is one item without title."""
    t = text0(c)
    found = F.regexp_extract_all(t, F.lit(r"【([^\n]*)】"), F.lit(1))
    pair = lambda x: F.struct(strip(F.regexp_extract(x, r"(?s)^([^:：]*)[:：]", 1)).alias("title"), strip(F.regexp_replace(x, r"^[^:：]*[:：]", "")).alias("content"))
    whole = F.array(F.struct(F.lit("").alias("title"), strip(t).alias("content")))
    return F.when(F.size(found) > 0, F.transform(found, pair)).when(strip(t) == "", F.array().cast("array<struct<title:string,content:string>>")).otherwise(whole)


def sentences(c: Column | str, end: str = P.SENTENCE_END) -> Column:
    return F.filter(F.transform(F.split(text0(c), end, -1), strip), lambda s: s != "")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: lambdas would compute a captured expression for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _grams(s: Column, n: int) -> Column:
    """n-grams of a text, in linear time over its characters; none if it is shorter (sequence() would count down)."""
    none = F.array().cast("array<string>")
    joined = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: F.array_join(F.slice(c, i, F.lit(n)), ""))
    return let(F.split(s, ""), lambda c: F.when(F.size(c) >= n, joined(c)).otherwise(none))


def ngrams(c: Column | str, n: int = 8) -> Column:
    """Character n-grams, white space removed, repeats kept."""
    return _grams(compact(text0(c)), n)


@functools.cache
def _gram_counts(ns: tuple[int, ...]) -> Callable[[Column], Column]:
    @F.pandas_udf(T.StructType([T.StructField(f"{c}{n}", T.IntegerType()) for n in ns for c in ("all", "distinct", "most")]))
    def counts(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([[x for of in G.repeats(t, list(ns)) for x in of] for t in s], columns=[f"{c}{n}" for n in ns for c in ("all", "distinct", "most")])

    return counts


def gram_counts(c: Column | str, *ns: int) -> Column:
    """struct of all<n>, distinct<n>, most<n> for each n: how many n-grams a text without its white space has, how many distinct ones, how often the most frequent one occurs.

    As whole numbers in Arrow batches: arrays of texts in the engine took about 15 times as long. Not for use inside lambdas.
    """
    return _gram_counts(ns)(compact(c if isinstance(c, Column) else F.col(c)))


def distinct_share(counts: Column, n: int) -> Column:
    """Share of distinct n-grams in counts of gram_counts; 0 without any."""
    return F.when(counts[f"all{n}"] == 0, F.lit(0.0)).otherwise(counts[f"distinct{n}"] / F.greatest(F.lit(1), counts[f"all{n}"]))


def distinct2(c: Column | str) -> Column:
    return distinct_share(gram_counts(c, 2), 2)


def max_repeat(items: Column) -> Column:
    """How often the most frequent entry of an array occurs: the longest run after sorting, in one pass."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when((acc["run"] > 0) & (acc["last"] == x), acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    # sort_array compares in Java; array_sort would call a lambda for every comparison
    return F.aggregate(F.sort_array(items), start, step)["most"]


def repeat_penalty(c: Column | str) -> Column:
    """0.35 for an 8-gram 5 times, 0.35 for a 12-gram 4 times, 0.25 for a 20-gram 3 times; at most 0.8; none below 80 characters."""
    counts = gram_counts(c, 8, 12, 20)
    part = lambda n, times, w: F.when(counts[f"most{n}"] >= times, F.lit(w)).otherwise(F.lit(0.0))
    # as many 8-grams as 80 characters have
    return F.when(counts["all8"] < 80 - 7, F.lit(0.0)).otherwise(F.least(F.lit(0.8), part(8, 5, 0.35) + part(12, 4, 0.35) + part(20, 3, 0.25)))


def length_penalty(c: Column | str, most: int = 2200) -> Column:
    n = F.length(strip(text0(c)))
    return F.when(n <= most, F.lit(0.0)).otherwise(F.least(F.lit(0.6), (n - most) / 1000.0 * 0.3))


#: What a text must have for a pattern to be found, where that is much cheaper to look for.
_NEEDS = {P.DOC_TOKEN_FROZEN: "[《财税会发函公告令]"}
#: Words that all begin with a wide character aren't tried anywhere else.
_WIDE_HERE = r"(?=[\x{2E80}-\x{FFFF}])"


def _replaced(x: Column, pattern: str, by: str) -> Column:
    """regexp_replace with Unicode classes; the same result with less search."""
    if pattern in _NEEDS:
        return let(x, lambda t: F.when(t.rlike(_NEEDS[pattern]), F.regexp_replace(t, "(?U)" + pattern, by)).otherwise(t))
    begins = _WIDE_HERE if pattern in (P.ACCOUNT_TERM, MASKS[-1]) else ""
    return F.regexp_replace(x, f"(?U){begins}(?:{pattern})" if begins else "(?U)" + pattern, by)


#: What is masked before degeneration is measured, in order, and by what.
DEGENERATION_STEPS = [(P.LEDGER_LINE, ""), (P.LEDGER_HEAD, ""), (P.QUOTES, ""), (P.LONG_DASH, "-"), (P.FORM_NUMBER, "⟨F⟩"), (P.DATE_MASK, "⟨D⟩"), (P.DOC_TOKEN_FROZEN, "⟨C⟩"), (P.NUMBER_BARE, "⟨N⟩")]


def degeneration_input(c: Column | str) -> Column:
    """The normal form on which degeneration is measured: ledger lines out, forms, dates, documents and numbers masked."""
    return reduce(lambda x, s: _replaced(x, *s), DEGENERATION_STEPS, nfkc_ascii(text0(c)))


def degeneration(norm: Column) -> Column:
    """struct of short_ratio, max_8gram, distinct2, max_sentence, soft, extreme over a normalised text."""
    ratio = lambda o: F.size(F.filter(o, lambda x: F.length(x) <= 6)) / F.greatest(F.lit(1), F.size(o))
    same = lambda s: max_repeat(F.filter(F.transform(s, compact), lambda x: F.length(x) >= 10))
    open_ = lambda s: F.filter(s, lambda x: ~x.rlike(r"(?U)\d"))
    parts = let(sentences(norm), lambda s: F.struct(let(open_(s), ratio).alias("short"), same(s).alias("same")))
    counts = gram_counts(norm, 2, 8)
    measured = F.struct(parts.alias("parts"), counts["most8"].alias("eight"), distinct_share(counts, 2).alias("d2"))
    return let(measured, lambda m: F.struct(
        m["parts"]["short"].alias("short_ratio"), m["eight"].alias("max_8gram"), m["d2"].alias("distinct2"), m["parts"]["same"].alias("max_sentence"),
        ((m["parts"]["short"] > 0.25) | (m["eight"] >= 3)).alias("soft"), ((m["d2"] < 0.10) | (m["parts"]["same"] >= 3) | ((m["eight"] >= 5) & (m["d2"] < 0.35))).alias("extreme"),
    ))


def gram_overlap(think: Column, ref: Column, n: int = 5, think_chars: int = 3000, ref_chars: int = 6000) -> Column:
    """Share of a text's distinct n-grams that occur in the reference. The caps are part of the measure."""
    return _overlap(n)(compact(F.substring(text0(think), 1, think_chars)), compact(F.substring(text0(ref), 1, ref_chars)))


@functools.cache
def _overlap(n: int) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(T.DoubleType())
    def overlap(think: pd.Series, ref: pd.Series) -> pd.Series:
        return pd.Series([G.overlap(a, b, n) for a, b in zip(think, ref, strict=True)], dtype=float)

    return overlap


common_run = S.common_run


@F.pandas_udf(T.DoubleType())
def longest_share(think: pd.Series, ref: pd.Series) -> pd.Series:
    """Longest common substring over the length of the (capped) text."""
    cut = [((a or "")[:3000], (b or "")[:6000]) for a, b in zip(think, ref, strict=True)]
    return pd.Series([S.common_run(a, b) / len(a) if a and b else 0.0 for a, b in cut])


def copy_signal(think: Column, ref: Column) -> Column:
    return F.greatest(longest_share(think, ref), gram_overlap(think, ref))


@F.pandas_udf(T.DoubleType())
def match_ratio(gold: pd.Series, text: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of the first 3000 characters, in this order of arguments."""
    return pd.Series([S.ratio((a or "")[:3000], (b or "")[:3000]) for a, b in zip(gold, text, strict=True)])


def shorten(c: Column | str) -> Column:
    """The first half of the sentences (one at least), ends kept."""
    s = F.split(text0(c), r"(?<=[。！？!?\n;；])", -1)
    full = F.filter(s, lambda x: strip(x) != "")
    return F.array_join(F.slice(full, F.lit(1), F.greatest(F.lit(1), (F.size(full) / 2).cast("int"))), "")


def surgery(c: Column | str, cuts: list[str] | None = None) -> Column:
    """Deletes the marks one after another, then squeezes blank lines and blanks."""
    out = reduce(lambda x, p: F.regexp_replace(x, "(?U)" + p, ""), P.SURGERY if cuts is None else cuts, text0(c))
    return strip(F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "))


#: What mask_facts masks, in order.
MASKS = (P.OFFICIAL_URL, P.LEDGER_LINE, P.DATE_MASK, P.RATE_MASK, P.DOC_TOKEN_FROZEN, P.FORM_PATH, P.FORM_NAME, P.ACCOUNT_TERM, "|".join(sorted(P.LEGAL_TERMS, key=len, reverse=True)))


def mask_facts(c: Column | str) -> Column:
    """Facts with one proper wording give way to a box; runs of boxes become one."""
    return F.regexp_replace(reduce(lambda x, p: _replaced(x, p, "□"), MASKS, normal(c)), "□+", "□")


def quote_found(quote: Column, text: Column, least: int = 6) -> Column:
    """Whether a quote of some length occurs in a text, white space and width aside."""
    q = compact(normal(quote))
    return (F.length(q) >= least) & compact(normal(text)).contains(q)


def numbered(sents: Column) -> Column:
    """Sentences as lines `[1] ...`."""
    return F.array_join(F.transform(sents, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), s)), "\n")


def start_bigram(sentence: Column) -> Column:
    """First two characters of a sentence after its numbering; empty where nothing follows."""
    return F.substring(F.regexp_replace(strip(sentence), "(?U)" + P.NUMBERING, ""), 1, 2)


def first_text(*cols: Column) -> Column:
    """The first non-empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))

"""Fact extraction and set algebra over facts, as native columns.

Several extractors coexist because their results differ on purpose: `plain_facts` finds
polarity words by substring (a longer word also yields the shorter one inside it),
`masked_facts` takes longer words first and hides them, `number_facts` takes numbers
alone, and `wide_facts` adds a longer list of polarity words to the numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import compact, let, nfkc_ascii, strip, text0

FACTS = "struct<pol:array<string>,val:array<string>,date:array<string>>"


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit("(?U)" + pattern), F.lit(0))


def _sorted(*arrays: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*arrays)))


def _contained(c: Column, words: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(c.contains(w), F.lit(w)) for w in words])) if words else F.array().cast("array<string>")


def number_facts(c: Column | str, unit: str = P.NUMBER_WITH_UNIT, bare: str = P.NUMBER_BARE) -> Column:
    """Numbers with their units, and bare numbers of two digits or more; commas removed."""
    t = nfkc_ascii(text0(c))
    with_unit = F.transform(_all(t, unit), lambda x: F.replace(compact(x), F.lit(","), F.lit("")))
    alone = F.filter(F.transform(_all(t, bare), lambda x: F.replace(x, F.lit(","), F.lit(""))), lambda x: F.length(F.regexp_replace(x, r"(?U)\D", "")) >= 2)
    return _sorted(F.filter(with_unit, lambda x: x != ""), alone)


def plain_facts(c: Column | str) -> Column:
    """Percentages, money, dates, durations as written, and polarity words by substring."""
    t = text0(c)
    found = [F.transform(_all(t, p), compact) for p in P.FACTS_PLAIN]
    return _sorted(*found, _contained(t, P.POLARITY_PLAIN))


def wide_facts(c: Column | str) -> Column:
    return _sorted(number_facts(c), _contained(text0(c), P.POLARITY_WIDE))


def conclusion_slots(c: Column | str) -> Column:
    return F.array_sort(_contained(text0(c), P.POLARITY_WIDE))


def masked_facts(c: Column | str, polarity: list[str] = P.POLARITY_MASKED, dates: str = P.DATES, values: list[str] = P.VALUES) -> Column:
    """struct<pol, val, date>: longer polarity words hide shorter ones, dates are taken before durations are looked for."""
    t = nfkc_ascii(text0(c))
    left, pol = t, []
    for word in sorted(polarity, key=len, reverse=True):
        pol.append(F.when(left.contains(word), F.lit(word)))
        left = F.replace(left, F.lit(word), F.lit("　"))
    found = _all(t, dates)
    rest = F.regexp_replace(t, "(?U)" + dates, " ")
    money = lambda x: F.replace(F.replace(F.replace(compact(x), F.lit(","), F.lit("")), F.lit("万元"), F.lit("万")), F.lit("亿元"), F.lit("亿"))
    vals = [F.transform(_all(rest, p), money) for p in values]
    return F.struct(
        F.array_sort(F.array_compact(F.array(*pol))).alias("pol") if pol else F.array().cast("array<string>").alias("pol"),
        _sorted(*vals).alias("val"), _sorted(F.transform(found, compact)).alias("date"),
    )


def date_covered(date: Column, pool: Column) -> Column:
    """Whether some date of the pool is a prefix of this one, or the other way round."""
    return F.exists(pool, lambda p: date.startswith(p) | p.startswith(date))


def pool_facts(answers: Column, **sets) -> Column:
    """Union of the facts of the non-blank answers of an array."""
    each = F.transform(F.filter(answers, lambda a: strip(text0(a)) != ""), lambda a: masked_facts(a, **sets))
    union = lambda k: _sorted(F.flatten(F.transform(each, lambda f: f[k]))).alias(k)
    return F.struct(union("pol"), union("val"), union("date"))


def answer_in_pool(answer: Column, pool: Column, **sets) -> Column:
    """struct<in_pool, comparable, reason, drift_facts> of an answer against pool facts.

    A null pool gives null: no pool is not an empty pool.
    """
    inside = let(F.struct(masked_facts(answer, **sets).alias("m"), strip(text0(answer)).alias("a"), pool.alias("p")), lambda x: _in_pool(x["m"], x["a"] == "", x["p"]))
    return F.when(pool.isNotNull(), inside)


def _in_pool(m: Column, empty: Column, pool: Column) -> Column:
    size = lambda f: F.size(f["pol"]) + F.size(f["val"]) + F.size(f["date"])
    drift = F.array_sort(F.concat(F.array_except(m["pol"], pool["pol"]), F.array_except(m["val"], pool["val"]), F.filter(m["date"], lambda d: ~date_covered(d, pool["date"]))))
    own, known = size(m) > 0, size(pool) > 0
    inside = ~empty & (F.size(drift) == 0)
    reason = F.when(empty, "empty_answer").when(~own & known, "no_comparable_facts").when(~own, "no_facts_in_either").when(~known, "v1_pool_has_no_facts").when(~inside, "introduced_new_fact").otherwise("ok")
    return F.struct(inside.alias("in_pool"), (empty | (own & known)).alias("comparable"), reason.alias("reason"), drift.alias("drift_facts"))


def majority(sets: Column) -> Column:
    """Words in more than half of the given word sets."""
    words = F.array_sort(F.array_distinct(F.flatten(sets)))
    return F.filter(words, lambda w: F.size(F.filter(sets, lambda s: F.array_contains(s, w))) >= F.floor(F.size(sets) / 2) + 1)


def support(answers: Column) -> Column:
    """struct<n, sample_concls, value_union, majority_concl> of an array of answers."""
    concls = F.transform(answers, conclusion_slots)
    return F.struct(F.size(answers).alias("n"), concls.alias("sample_concls"), _sorted(F.flatten(F.transform(answers, lambda a: number_facts(a)))).alias("value_union"), majority(concls).alias("majority_concl"))


def _opposites() -> Column:
    pairs = [*P.OPPOSITE, *[(b, a) for a, b in P.OPPOSITE]]
    return F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])


def answer_in_support(answer: Column, known: Column) -> Column:
    """struct<in_support, reason, contradict, value_ok>: conclusions must be covered by a sample and not oppose the majority; without conclusions, numbers must be known."""
    return let(F.struct(conclusion_slots(answer).alias("c"), number_facts(answer).alias("v"), known.alias("k")), lambda x: _supported(x["c"], x["v"], x["k"]))


def _supported(concl: Column, values: Column, known: Column) -> Column:
    contradict = F.exists(_opposites(), lambda p: F.array_contains(concl, p["a"]) & F.array_contains(known["majority_concl"], p["b"]))
    covered = F.exists(known["sample_concls"], lambda s: F.size(F.array_except(concl, s)) == 0)
    value_ok = F.size(F.array_except(values, known["value_union"])) == 0
    has = F.size(concl) > 0
    inside = F.when(has, covered & ~contradict).otherwise(value_ok)
    reason = F.when(inside, "ok").when(has & contradict, "contradict_majority").when(has, "concl_not_covered").otherwise("introduced_new_number")
    return F.struct(inside.alias("in_support"), reason.alias("reason"), contradict.alias("contradict"), value_ok.alias("value_ok"))


def introduced(new: Column, *known: Column) -> Column:
    """Numbers of a text that none of the others has."""
    return F.array_except(number_facts(new), _sorted(*[number_facts(k) for k in known]))


def recall(gold: Column, found: Column) -> Column:
    """Share of the gold set that is found; 1 for an empty gold set."""
    return F.when(F.size(gold) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(gold, found)) / F.size(gold))


def same_numbers(a: Column, b: Column, **patterns: str) -> Column:
    return number_facts(a, **patterns) == number_facts(b, **patterns)


def polarity_fits(text: Column, pool: Column, **sets) -> Column:
    """No conclusion that a pool lacks; a pool without conclusions can't tell. Numbers may be derived, so they don't count."""
    return (F.size(pool["pol"]) == 0) | (F.size(F.array_except(masked_facts(text, **sets)["pol"], pool["pol"])) == 0)


def anchor_text(pool: Column) -> Column:
    """The facts of a pool in one line."""
    part = lambda name, x: F.when(F.size(x) > 0, F.concat(F.lit(name), F.array_join(x, "、")))
    return F.concat_ws("；", part("结论：", pool["pol"]), part("数字：", pool["val"]), part("日期：", pool["date"]))


"""Deterministic rules: retrieval style, trace counters, gates, rewards. Native columns but for span offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import facts, patterns as P
from .text import degeneration, degeneration_input, extract_references, length_penalty, let, mask_facts, match_ratio, nfkc_ascii, parse_diagnostic, parse_think_answer, repeat_penalty, sentences, strict_tags, strip, surgery, text0, copy_signal


def _or(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _add(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0))


def unicode(pattern: str, any_case: bool = False) -> str:
    """For Java: digits, blanks, word characters and word edges of all scripts, as in Python."""
    return ("(?iU)" if any_case else "(?U)") + pattern


def count_matches(c: Column, pats: list[str]) -> Column:
    return _add([F.regexp_count(text0(c), F.lit(unicode(p))) for p in pats])


def _documents(sentence: Column, token: str = P.DOC_TOKEN) -> Column:
    return F.regexp_extract_all(F.regexp_replace(sentence, P.FORM_NAME, ""), F.lit(unicode(token)), F.lit(0))


def _stands_alone(sentence: Column, token: str = P.DOC_TOKEN) -> Column:
    """A citation that serves no reasoning: no reasoning word in its sentence, or three documents in it."""
    n = F.size(_documents(sentence, token))
    return (n > 0) & ((n >= 3) | ~F.regexp_replace(sentence, P.FORM_NAME, "").rlike(P.REASONING_WORD))


def document_dump(think: Column) -> Column:
    """Three or more documents in citations that stand alone, or a label line for documents."""
    alone = F.aggregate(F.transform(F.filter(sentences(think), lambda s: _stands_alone(s)), lambda s: F.size(_documents(s))), F.lit(0), lambda a, x: a + x)
    return (alone >= 3) | text0(think).rlike(unicode(P.POLICY_LABEL))


def has_rag_style(think: Column, marks: dict[str, list[str]] | None = None, dump: bool = True) -> Column:
    marks = P.RAG_STYLE if marks is None else marks
    hit = [text0(think).rlike(unicode(p, k in P.RAG_STYLE_ANY_CASE)) for k, ps in marks.items() for p in ps]
    return _or([*hit, document_dump(think)] if dump else hit)


class RagSpans:
    """UDTF body: rows (begin, end, text, kind) of a text's marks; `rag_spans` makes one of other marks.

    A span inside a longer one of its kind is dropped: spans of a kind are scanned by
    begin and descending end, and one that ends before the furthest end so far lies inside.
    Documents that stand alone are a kind of their own, of which LISTED are told; begin and
    end are null where a form name was taken out of one.
    """

    LISTED = 8
    MARKS, DUMP = P.RAG_STYLE, True

    def listed(self, think: str) -> Iterator[tuple[int | None, int | None, str, str]]:
        alone: list[str] = []
        for sentence in re.split(P.SENTENCE_END, think):
            bare = re.sub(P.FORM_NAME, "", sentence.strip())
            docs = [m.group() for m in re.finditer(P.DOC_TOKEN, bare)]
            if len(docs) >= 3 or not re.search(P.REASONING_WORD, bare):
                alone += docs
        label = re.search(P.POLICY_LABEL, think)
        if label and not alone:
            yield *label.span(), label.group().strip(), P.RAG_LIST_CLASS
        elif label or len(alone) >= 3:
            at = 0
            for doc in alone[: self.LISTED]:
                begin = think.find(doc, at)
                at = begin + len(doc) if begin >= 0 else at
                yield *((begin, at) if begin >= 0 else (None, None)), doc, P.RAG_LIST_CLASS

    def eval(self, think: str) -> Iterator[tuple[int, int, str, str]]:
        out = []
        for kind, pats in self.MARKS.items():
            flags = re.I if kind in P.RAG_STYLE_ANY_CASE else 0
            found = {m.span() for p in pats for m in re.finditer(p, think or "", flags)}
            reach = -1
            for begin, end in sorted(found, key=lambda x: (x[0], -x[1])):
                if end > reach:
                    out.append((begin, end, think[begin:end], kind))
                    reach = end
        yield from sorted(out)
        if self.DUMP:
            yield from self.listed(think or "")


RAG_SPANS = "begin: int, end: int, text: string, kind: string"


def rag_spans(marks: dict[str, list[str]] | None = None, dump: bool = True):
    """A table function of a text: its spans, for a lateral join. Rows travel as Arrow batches."""

    class Spans(RagSpans):
        MARKS, DUMP = P.RAG_STYLE if marks is None else marks, dump

    return F.udtf(Spans, returnType=RAG_SPANS, useArrow=True)


def has_trace(judged: Column, text: Column, cuts: list[str] | None = None) -> Column:
    """A judge has named traces, or surgery changes the text."""
    return (F.size(F.coalesce(judged, F.array().cast("array<string>"))) > 0) | (surgery(text, cuts) != text0(text))


def residual(weight: Column, masked: Column, customer: Column, qa: Column) -> Column:
    """A reply that still has something to rewrite."""
    return (weight > 0) | (masked > 0.35) | customer | qa


def repaired_well(repaired: Column, original: Column, least: float = 0.60, **numbers: str) -> Column:
    """A repair that keeps all numbers and enough of the length."""
    return facts.same_numbers(repaired, original, **numbers) & (F.length(text0(repaired)) >= least * F.greatest(F.lit(1), F.length(text0(original))))


def trace_counts(think: Column, copy_ratio: Column, frozen: bool = False) -> Column:
    """struct<version, explicit_ref, verbatim_copy, ref_enumeration, policy_source>.

    The frozen counter never changes, since older reports rest on it; results of
    different versions must not be compared. Only the frozen one counts copying.
    """
    explicit, enum = count_matches(think, P.TRACES_EXPLICIT), count_matches(think, P.TRACES_ENUMERATION)
    if frozen:
        docs = lambda s: F.size(F.regexp_extract_all(s, F.lit(unicode(P.DOC_TOKEN_FROZEN)), F.lit(0)))
        fine = lambda s: (docs(s) == 1) & s.rlike(P.REASONING_WORD)
        listed = F.filter(sentences(think), lambda s: (docs(s) > 0) & ~(fine(s)))
        policy = F.aggregate(F.transform(listed, docs), F.lit(0), lambda a, x: a + x) + (docs(text0(think)) >= 3).cast("int") + text0(think).rlike(unicode(P.POLICY_LABEL)).cast("int")
        verbatim = (copy_ratio >= 0.40).cast("int")
    else:
        policy = standalone_units(think)
        verbatim = F.lit(0)
    return F.struct(F.lit(P.FROZEN_VERSION if frozen else P.CURRENT_VERSION).alias("version"), explicit.alias("explicit_ref"), verbatim.alias("verbatim_copy"), enum.alias("ref_enumeration"), policy.alias("policy_source"))


def standalone_units(think: Column) -> Column:
    return F.size(F.filter(sentences(think), lambda s: _stands_alone(s, P.DOC_TOKEN_FROZEN)))


def citation_density(think: Column) -> Column:
    return standalone_units(think) / F.greatest(F.lit(1), F.size(sentences(think)))


def real_trace(counts: Column, copy_ratio: Column) -> Column:
    """Traces without policy sources; copying from 0.40 on counts as one."""
    return counts["explicit_ref"] + counts["ref_enumeration"] + (copy_ratio >= 0.40).cast("int")


def is_problem(counts: Column, copy_ratio: Column) -> Column:
    return real_trace(counts, copy_ratio) >= 1


def is_clean(counts: Column, copy_ratio: Column) -> Column:
    return (real_trace(counts, copy_ratio) == 0) & (copy_ratio <= 0.30)


def copy_units(masked: Column) -> Column:
    return (masked > 0.35).cast("int") + (masked > 0.45).cast("int") + (masked > 0.55).cast("int")


def burden(explicit: Column, enum: Column, standalone: Column, masked: Column) -> Column:
    return explicit + enum + standalone + copy_units(masked)


def format_ok(think: Column, answer: Column, least: int = 40, most: int = 2000) -> Column:
    return (strip(text0(answer)) != "") & F.length(strip(text0(think))).between(least, most)


def humanness(think: Column, copy_ratio: Column, c_trace: float = 0.34, c_copy: float = 1.0, s_pmi: Column | None = None, w_pmi: float = 0.5, traces: list[str] | None = None) -> Column:
    """1 / (1 + weighted traces and copying), mixed with a structural signal where there is one; 0 for an empty text."""
    base = 1.0 / (1.0 + c_trace * count_matches(think, P.TRACES_SIMPLE if traces is None else traces) + c_copy * copy_ratio)
    if s_pmi is not None:
        base = F.when(s_pmi.isNull(), base).otherwise(w_pmi / (1.0 + F.exp(-2.0 * s_pmi)) + (1.0 - w_pmi) * base)
    return F.when(strip(text0(think)) == "", F.lit(0.0)).otherwise(base)


def answer_drift(answer: Column, gold: Column) -> Column:
    """Half similarity, half recall of facts; 0 for an empty answer, 1 for an empty gold answer."""
    value = 0.5 * match_ratio(strip(text0(gold)), strip(text0(answer))) + 0.5 * facts.recall(facts.plain_facts(gold), facts.plain_facts(answer))
    return F.when(strip(text0(answer)) == "", F.lit(0.0)).when(strip(text0(gold)) == "", F.lit(1.0)).otherwise(value)


def multiplicative_reward(fmt: Column, accuracy: Column, human: Column, tau: float = 0.30, w_acc: float = 0.5, w_human: float = 0.5) -> Column:
    """struct<reward, gate>: -1 without format; a tenth of the accuracy below tau; else accuracy times a humanness mix."""
    value = F.when(~fmt, F.lit(-1.0)).when(accuracy < tau, 0.1 * accuracy).otherwise(accuracy * (w_acc + w_human * human))
    gate = F.when(~fmt, "format_fail").when(accuracy < tau, "acc_drift").otherwise("ok")
    return F.struct(value.alias("reward"), gate.alias("gate"))


def judge_unit(score: Column) -> Column:
    """A 0 to 10 score as 0 to 1; null as 0."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score / 10.0)), F.lit(0.0))


def lexicographic_reward(format_good: Column, in_pool: Column, comparable: Column, rule_fail: Column, judge: Column, penalty: Column) -> Column:
    """Hard tiers -4, -3, -2; then 0.5 + 0.2 k - penalty where the rule fails, 1 + 0.4 k - penalty where it passes."""
    k = judge_unit(judge)
    return F.when(~format_good, F.lit(-4.0)).when(~in_pool, F.lit(-3.0)).when(~comparable, F.lit(-2.0)).when(rule_fail, 0.5 + 0.2 * k - penalty).otherwise(1.0 + 0.4 * k - penalty)


def text_reward(text: Column, pool: Column, judge: Column, least_think: int = 40, marks: dict | None = None, **sets) -> Column:
    """The lexicographic reward of one reply against pool facts."""
    penalty = lambda t: repeat_penalty(t) + length_penalty(t)

    def value(y: Column) -> Column:
        x = y["parts"]
        p, inside = x["p"], x["i"]
        good = x["strict"] & p["format_ok"] & (F.length(p["think"]) >= least_think)
        return lexicographic_reward(good, inside["in_pool"], inside["comparable"], has_rag_style(p["think"], marks), judge, y["penalty"])

    parts = let(parse_diagnostic(text), lambda p: F.struct(p.alias("p"), strict_tags(text).alias("strict"), facts.answer_in_pool(p["answer"], pool, **sets).alias("i")))
    # grams are counted in an Arrow stage, which lambdas can't hold
    return let(F.struct(parts.alias("parts"), penalty(parse_diagnostic(text)["think"]).alias("penalty")), value)


def hard_reasons(checks: dict[str, Column]) -> Column:
    """Names of the checks that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]))


def first_reason(checks: dict[str, Column], otherwise: str = "ok") -> Column:
    """Name of the first check that holds."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()], F.lit(otherwise))


def margin_ok(d_burden: Column, d_masked: Column) -> Column:
    return (d_burden >= 2) | ((d_burden >= 1) & (d_masked >= 0.12))


def repair_route(customer: Column, qa: Column, masked: Column, standalone: Column) -> Column:
    return F.when(customer | qa, "trace").when(masked > 0.35, "paraphrase").when(standalone > 0, "citation").otherwise("none")


def seed_gate(facts_ok: Column, trace_hits: Column, human: Column, grounded: Column, copy_ratio: Column) -> Column:
    """All five conditions; a missing value fails."""
    checks = (facts_ok, trace_hits == 0, human >= 0.6, grounded >= 0.7, copy_ratio <= 0.5)
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in checks])


def candidate_features(df, text: str, prompt: str, gold: str, query: str | None = None):
    """The wide feature row of a candidate, built in steps so that shared parts are computed once."""
    df = df.withColumn("_p", parse_think_answer(text)).withColumn("_refs", extract_references(prompt))
    think, answer, refs, g = F.col("_p.think"), F.col("_p.answer"), F.col("_refs"), F.col(gold)
    asked = F.col(query) if query else F.lit("")
    # masks run Python for some texts, so they are columns before lambdas look at them
    df = df.withColumns({"_masked_think": mask_facts(think), "_masked_refs": mask_facts(refs)})
    df = df.withColumns({"copy_ratio": copy_signal(think, refs), "masked_copy": copy_signal(F.col("_masked_think"), F.col("_masked_refs")), "degen": degeneration(degeneration_input(think)), "gold_facts": facts.wide_facts(g), "answer_score": answer_drift(answer, g)})
    df = df.withColumns({"counts": trace_counts(think, F.col("copy_ratio")), "frozen_counts": trace_counts(think, F.col("copy_ratio"), frozen=True), "standalone": standalone_units(think), "citation_density": citation_density(think)})
    clean_urls = F.regexp_replace(text0(think), unicode(P.OFFICIAL_URL), "")
    df = df.withColumns({
        "think_len": F.length(think), "format_ok": format_ok(think, answer, 40, 2200), "fact_recall": facts.recall(F.col("gold_facts"), facts.wide_facts(answer)),
        "introduced_nums": F.array_except(facts._sorted(facts.number_facts(think), facts.number_facts(answer)), facts._sorted(facts.number_facts(refs), facts.number_facts(g), facts.number_facts(asked))),
        "grounding_floor_ok": (F.size("gold_facts") == 0) | F.arrays_overlap(facts.wide_facts(think), facts._sorted(facts.wide_facts(refs), F.col("gold_facts"))),
        "label_line": text0(think).rlike(unicode(P.POLICY_LABEL)), "img_trace": clean_urls.rlike(unicode(P.IMAGE_TRACE)), "customer_trace": text0(think).rlike(unicode(P.CUSTOMER_TRACE)), "qa_trace": text0(think).rlike(unicode(P.QA_TRACE)),
    })
    c = F.col
    reasons = hard_reasons({
        "format": ~c("format_ok"), "introduced_nums": F.size("introduced_nums") > 0, "grounding_floor": ~c("grounding_floor_ok"), "explicit_ref": c("counts.explicit_ref") > 0,
        "ref_enumeration": c("counts.ref_enumeration") > 0, "label_line": c("label_line"), "raw_copy_cap": c("copy_ratio") > 0.55, "img_trace": c("img_trace"), "extreme_degen": c("degen.extreme"),
    })
    df = df.withColumns({"l0_reasons": reasons, "burden": burden(c("counts.explicit_ref"), c("counts.ref_enumeration"), c("standalone"), c("masked_copy")), "repair_route": repair_route(c("customer_trace"), c("qa_trace"), c("masked_copy"), c("standalone"))})
    return df.withColumns({"l0_pass": F.size("l0_reasons") == 0, "clean": dpo_chosen(F.size("l0_reasons") == 0, c("burden"), c("masked_copy"), c("degen.soft"), c("fact_recall"), c("answer_score")), "trace_heavy": c("burden") >= 1})


def dpo_chosen(l0_pass: Column, weight: Column, masked: Column, soft: Column, fact_recall: Column, score: Column) -> Column:
    """Gate for chosen answers; the keep gate is `l0_pass` alone."""
    return l0_pass & (weight == 0) & (masked <= 0.30) & ~soft & (fact_recall >= 0.75) & (score >= 0.55)


def derag_reward(fmt: Column, extreme: Column, fact_recall: Column, introduced: Column, floor_ok: Column, copy_ratio: Column, img: Column, explicit: Column, enum: Column, standalone: Column, density: Column, masked: Column) -> Column:
    """struct<reward, gate>: format, fact and trace guards first, then 0.3 + 0.7 / (1 + penalty)."""
    over = lambda x, t: F.greatest(F.lit(0.0), x - t)
    penalty = 0.34 * explicit + 1.0 * enum + 0.2 * standalone + 1.2 * over(density, 0.15) + 2.0 * over(masked, 0.25) + 8.0 * over(masked, 0.40)
    checks = {"format_or_extreme_degen": ~fmt | extreme, "fact_guard": (fact_recall < 0.80) | (introduced > 0) | ~floor_ok, "hard_trace_guard": (copy_ratio > 0.55) | img}
    gate = first_reason(checks)
    guarded = 0.1 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), fact_recall))
    value = F.when(gate == "format_or_extreme_degen", F.lit(-1.0)).when(gate == "fact_guard", guarded).when(gate == "hard_trace_guard", F.lit(0.1)).otherwise(0.3 + 0.7 / (1.0 + penalty))
    return F.struct(value.alias("reward"), gate.alias("gate"))

"""Reading what a judge wrote: JSON salvage, flags, quotes, evidence, votes. Native columns; loose JSON is read as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compact, first_text, let, nfkc_ascii, text0


def json_block(c: Column | str) -> Column:
    """From the first opening to the last closing brace; empty if there is none."""
    return F.regexp_extract(text0(c), r"(?s)\{.*\}", 0)


def salvage(c: Column | str, keys: list[str]) -> Column:
    """struct of doubles: parsed from the JSON block, else key by key from the raw text; clamped to 0..10, null where nothing fits."""
    t = text0(c)
    block = json_block(t)
    parsed = F.from_json(block, ", ".join(f"`{k}` double" for k in keys))

    def value(k: str) -> Column:
        raw = F.nullif(F.regexp_extract(t, rf'"?{k}"?\s*[:=]\s*"?(-?[0-9]+(?:\.[0-9]+)?)', 1), F.lit(""))
        got = F.coalesce(parsed[k], raw.try_cast("double"))
        return F.when(got.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(10.0), got))).alias(k)

    return F.struct(*[value(k) for k in keys])


def flags(c: Column | str, valid: Column) -> Column:
    """Sorted ids that are flagged (or listed as copied, where no flag is) and valid."""
    parsed = F.from_json(json_block(c), "flags array<struct<sid:int,copied:boolean>>, copied_sids array<int>")
    own = F.transform(F.filter(parsed["flags"], lambda x: x["copied"]), lambda x: x["sid"])
    none = F.array().cast("array<int>")
    both = F.array_union(F.coalesce(own, none), F.coalesce(parsed["copied_sids"], none))
    return F.array_sort(F.array_intersect(both, valid))


#: Paths at which services put a reply's text; the first non-empty one counts.
REPLY_PATHS = ("$.choices[0].message.content", "$.choices[0].text", "$.data.choices[0].message.content", "$.data.choices[0].text", "$.data.content", "$.data.text", "$.data.answer", "$.content", "$.text", "$.answer", "$.result", "$.content[0].text", "$.output_text", "$.output.text", "$.output.choices[0].message.content", "$.message.content", "$.response")


def reply(c: Column | str) -> Column:
    """struct<text, problem> of a service's reply.

    problem is not_an_object; failed, where `success` is false; error_body, where `error` or `err` is an object or a text that speaks of an error or a
    failure; no_text, where no path has a text; else null. A reply with a problem has no text, whatever else it holds.
    """
    raw = text0(c)

    def told(v: Column) -> Column:
        kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
        # a path that leads to anything but a text has none
        said_at = lambda p: F.when(F.schema_of_variant(F.try_variant_get(v, p, "variant")) == "STRING", F.try_variant_get(v, p, "string"))
        # the second key counts where the first has nothing
        first = F.coalesce(F.to_json(F.try_variant_get(v, "$.error", "variant")), F.lit("null")).isin("null", "false", "0", '""', "{}", "[]")
        bad = lambda k: F.coalesce(F.startswith(kind(k), F.lit("OBJECT")), F.lit(False)) | F.coalesce(F.lower(said_at(f"$.{k}")).rlike("error|fail"), F.lit(False))
        said = first_text(*[said_at(p) for p in REPLY_PATHS])
        problem = (
            F.when(v.isNull() | ~F.startswith(F.coalesce(F.schema_of_variant(v), F.lit("")), F.lit("OBJECT")), "not_an_object").when(F.try_variant_get(v, "$.success", "boolean") == F.lit(False), "failed")
            .when(F.when(first, bad("err")).otherwise(bad("error")), "error_body").when(said == "", "no_text")
        )
        return let(problem, lambda p: F.struct(F.when(p.isNull(), said).alias("text"), p.alias("problem")))

    return let(F.try_parse_json(raw), told)


def reply_text(c: Column | str) -> Column:
    """The text of a service's reply; one with a problem raises when the result is computed."""
    return let(reply(c), lambda r: F.when(r["problem"].isNull(), r["text"]).otherwise(F.raise_error(F.concat(F.lit("reply: "), r["problem"]))))


def binary_vote(label: Column) -> Column:
    """clean, traced or uncertain."""
    x = F.lower(F.trim(text0(label)))
    return F.when(x.isin("clean", "pass", "yes", "ok"), "clean").when(x.isin("traced", "dirty", "fail", "no"), "traced").otherwise("uncertain")


def settled_vote(first: Column, second: Column, arbiter: Column) -> Column:
    """Two votes that agree stand; else the majority with the arbiter, ties being traced."""
    clean = sum(((v == "clean").cast("int") for v in (first, second, arbiter)), F.lit(0))
    return F.when((first == second) & (first != "uncertain"), first).when(clean >= 2, "clean").otherwise("traced")


def _parsed(raw: Column, evidence: str, said: str) -> Column:
    """What a judge's reply holds: struct of its JSON (VARIANT), whether it said something before its evidence, and the evidence with its kind."""
    value = F.try_parse_json(json_block(raw))
    at = lambda k: F.locate(f'"{k}"', text0(raw))

    def told(x: Column) -> Column:
        # an empty value of any kind counts as no evidence
        none = F.coalesce(F.to_json(F.try_variant_get(x["v"], f"$.{evidence}", "variant")), F.lit("null")).isin("null", "false", "0", '""', "{}")
        return F.struct(x["v"].alias("v"), ((at(said) > 0) & (at(evidence) > at(said))).alias("early"), F.when(none, F.array().cast("array<variant>")).otherwise(F.try_variant_get(x["v"], f"$.{evidence}", "array<variant>")).alias("items"))

    return let(F.struct(value.alias("v")), told)


def _verified(items: Column, text: Column) -> Column:
    """struct of the numbers of evidence objects, of those whose span (or quote) the text has, and of all other entries."""
    field = lambda x, k: F.coalesce(F.try_variant_get(x, f"$.{k}", "string"), F.lit(""))
    objects = F.filter(items, lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT")))
    quotes = F.transform(objects, lambda x: F.coalesce(F.nullif(field(x, "span"), F.lit("")), field(x, "quote")))
    return let(F.struct(F.size(items).alias("all"), quotes.alias("q"), compact(nfkc_ascii(text)).alias("t")), lambda x: let(
        F.size(F.filter(x["q"], lambda q: let(compact(nfkc_ascii(q)), lambda own: (F.length(own) >= 6) & x["t"].contains(own)))),
        lambda good: F.struct(F.size(x["q"]).alias("n"), good.alias("n_valid"), (x["all"] - good).alias("n_invalid")),
    ))


def evidence(raw: Column | str, text: Column | str, positive: str = '"traced"', negative: str = '"clean"', evidence_key: str = "evidence", verdict_key: str = "verdict") -> Column:
    """struct<state, verdict, confidence, n_evidence, n_valid, n_invalid> of a reply with a verdict of two values (JSON literals) and its evidence.

    Evidence must come before the verdict and be a list of objects whose `span` or `quote` the text has. state is
    no_json, verdict_first, invalid_verdict or not_a_list; conflict for a negative verdict beside verified evidence; weakened
    for a positive one without any, which counts as negative; else ok. Replies that can't be used count as negative with low confidence.
    """
    text = F.col(text) if isinstance(text, str) else text

    def judged(x: Column) -> Column:
        said = F.to_json(F.try_variant_get(x["p"]["v"], f"$.{verdict_key}", "variant"))
        state = (
            F.when(x["p"]["v"].isNull(), "no_json").when(x["p"]["early"], "verdict_first").when(~F.coalesce(said.isin(positive, negative), F.lit(False)), "invalid_verdict")
            .when(x["p"]["items"].isNull(), "not_a_list").when((said == positive) & (x["e"]["n_valid"] == 0), "weakened").when((said == negative) & (x["e"]["n_valid"] > 0), "conflict").otherwise("ok")
        )
        own = F.coalesce(F.try_variant_get(x["p"]["v"], "$.confidence", "string"), F.lit("high"))
        return let(state, lambda s: F.struct(
            s.alias("state"), F.when(s == "ok", said).otherwise(negative).alias("verdict"), F.when(s == "ok", own).otherwise("low").alias("confidence"),
            *[F.coalesce(x["e"][k], F.lit(0)).alias(name) for k, name in (("n", "n_evidence"), ("n_valid", "n_valid"), ("n_invalid", "n_invalid"))],
        ))

    return let(_parsed(F.col(raw) if isinstance(raw, str) else raw, evidence_key, verdict_key), lambda p: let(F.struct(p.alias("p"), _verified(p["items"], text).alias("e")), judged))


def evidence_score(raw: Column | str, text: Column | str, evidence_key: str = "evidence", score_key: str = "score") -> Column:
    """struct<state, score, n_evidence, n_valid, n_invalid> of a reply with a score from 0 to 1 and the evidence of its issues.

    state is no_json, score_first, not_a_list or bad_score; mostly_invalid where more than half of the spans can't be verified; high_conflict
    for 0.9 and more beside a verified issue; low_unproven for less than 0.6 without one; else ok. Only then there is a score.
    """
    text = F.col(text) if isinstance(text, str) else text

    def judged(x: Column) -> Column:
        e, score = x["e"], F.try_variant_get(x["p"]["v"], f"$.{score_key}", "double")
        state = (
            F.when(x["p"]["v"].isNull(), "no_json").when(x["p"]["early"], "score_first").when(x["p"]["items"].isNull(), "not_a_list").when(score.isNull(), "bad_score")
            .when((e["n"] > 0) & (2 * e["n_invalid"] > e["n"]), "mostly_invalid").when((score >= 0.9) & (e["n_valid"] > 0), "high_conflict").when((score < 0.6) & (e["n_valid"] == 0), "low_unproven").otherwise("ok")
        )
        return let(state, lambda s: F.struct(s.alias("state"), F.when(s == "ok", score).alias("score"), *[F.coalesce(e[k], F.lit(0)).alias(name) for k, name in (("n", "n_evidence"), ("n_valid", "n_valid"), ("n_invalid", "n_invalid"))]))

    return let(_parsed(F.col(raw) if isinstance(raw, str) else raw, evidence_key, score_key), lambda p: let(F.struct(p.alias("p"), _verified(p["items"], text).alias("e")), judged))


def copy_level(flagged: Column, sentences: Column) -> Column:
    """0 without a flagged sentence, 5 where all are flagged, else their number up to 4."""
    return F.when(flagged == 0, F.lit(0)).when(flagged >= sentences, F.lit(5)).otherwise(F.least(flagged, F.lit(4)))

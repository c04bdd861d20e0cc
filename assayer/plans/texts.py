"""Text parsing, facts, rules, rewards, judge output, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import facts, judge, patterns as P, rules, vectors
from ..functions import text as X
from ..functions.registry import HashScorer
from ..operators.aggregates import over_sets
from ..sources import html, packaging, tables
from ..sources.shared import bounded_batches, shared_path
from .base import long, query, r6, table

#: Turns as replies with tags; every fifth is cut off while thinking, every seventh lacks answer tags.
_REPLY = "CASE WHEN (conv_id + turn) % 5 = 0 THEN '<think>' || text WHEN (conv_id + turn) % 7 = 0 THEN '<think> ' || text || '</think> ' || role ELSE '<think>' || text || ' </think><answer> ' || role || ' </answer> x' END"


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("conv_id") + F.col("turn")
    t, r = F.col("text"), F.col("role")
    body = F.when(k % 5 == 0, F.concat(F.lit("<think>"), t)).when(k % 7 == 0, F.concat(F.lit("<think> "), t, F.lit("</think> "), r)).otherwise(F.concat(F.lit("<think>"), t, F.lit(" </think><answer> "), r, F.lit(" </answer> x")))
    return table(spark, sf_dir, "conversations").withColumn("reply", body)


_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


@query("T-1", f"""WITH r AS (SELECT conv_id, turn, {_REPLY} AS g FROM conversations), p AS (SELECT *, position('</think>' IN g) AS c FROM r),
s AS (SELECT *, CASE WHEN c > 0 THEN {_STRIP.format(x="replace(substr(g, 1, c - 1), '<think>', '')")} ELSE '' END AS think, CASE WHEN c > 0 THEN substr(g, c + 8) ELSE g END AS tail FROM p)
SELECT conv_id, turn, md5(think) AS think, md5({_STRIP.format(x="CASE WHEN position('<answer>' IN tail) > 0 THEN split_part(split_part(tail, '<answer>', 2), '</answer>', 1) ELSE tail END")}) AS answer FROM s""")
def parse_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _replies(spark, sf_dir).withColumn("p", X.parse_think_answer("reply"))
    return p.select("conv_id", "turn", F.md5("p.think").alias("think"), F.md5("p.answer").alias("answer"))


@query("T-2 T-3 X-30", f"""WITH r AS (SELECT conv_id, turn, role, {_REPLY} AS g, {_STRIP.format(x='text')} = '' AS blank FROM conversations)
SELECT conv_id, turn, CASE WHEN position('</think>' IN g) = 0 THEN concat_ws('+', 'missing_think_close', CASE WHEN blank THEN 'empty_think' END, 'empty_answer') WHEN blank THEN 'empty_think' ELSE 'ok' END AS format_reason, position('</think>' IN g) > 0 AND position('<answer>' IN g) > 0 AS strict FROM r""")
def parse_diagnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _replies(spark, sf_dir)
    return r.select("conv_id", "turn", X.parse_diagnostic("reply")["format_reason"].alias("format_reason"), X.strict_tags("reply").alias("strict"))


@query("T-4", f"WITH r AS (SELECT conv_id, turn, role, {_REPLY} AS g FROM conversations) SELECT conv_id, turn, CASE WHEN position('<answer>' IN g) > 0 THEN role ELSE '' END AS answer FROM r")
def last_answer_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replies(spark, sf_dir).select("conv_id", "turn", X.last_answer("reply").alias("answer"))


@query("T-5 T-6 T-7", f"SELECT item_id, {_STRIP.format(x='text')} AS refs, 1::BIGINT AS n_refs FROM benchmark")
def references_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array(F.struct(F.lit("t").alias("title"), F.regexp_replace("text", r"\n", " ").alias("content")), F.struct(F.lit("e").alias("title"), F.lit(" ").alias("content")))
    b = table(spark, sf_dir, "benchmark").withColumn("prompt", X.build_user_prompt(F.lit("q"), items, 3)).withColumn("refs", X.extract_references("prompt"))
    parsed = b.withColumn("items", X.parse_refs("refs")).withColumn("plain", X.extract_references(F.concat(F.lit(P.REFERENCES_HEAD), "text", F.lit(P.QUESTION_HEAD))))
    return parsed.select("item_id", F.col("plain").alias("refs"), long(F.size("items")).alias("n_refs"))


@query("T-8", f"SELECT doc_id, len(list_filter(list_transform(string_split_regex(text, '[。！？!?\\n;；]+'), lambda s: {_STRIP.format(x='s')}), lambda s: s <> '')) AS n_sentences FROM documents")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", long(F.size(X.sentences("text"))).alias("n_sentences"))


_COMPACT = r"regexp_replace(text, '\s+', '', 'g')"


def _gram_sql(n: int) -> str:
    return f"CASE WHEN length(t) >= {n} THEN list_transform(range(1, length(t) - {n - 2}), lambda i: substr(t, i, {n})) ELSE [] END"


@query("T-9 T-10 T-11 T-16", f"""WITH d AS (SELECT doc_id, {_COMPACT} AS t FROM documents), g AS (SELECT doc_id, length(t) AS compact_len, {_gram_sql(2)} AS two, {_gram_sql(8)} AS eight FROM d)
SELECT doc_id, compact_len, round(CASE WHEN len(two) = 0 THEN 0.0 ELSE len(list_distinct(two)) / len(two) END, 6) AS distinct2, coalesce(list_max(map_values(list_histogram(eight))), 0)::BIGINT AS max_8gram FROM g""")
def ngram_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", X.compact_length(F.col("text")).alias("n"), X.distinct2("text").alias("d"), X.gram_counts("text", 8).alias("g"))
    return d.select("doc_id", long("n").alias("compact_len"), r6(F.col("d")).alias("distinct2"), long("g.most8").alias("max_8gram"))


@query("T-9", f"SELECT item_id, array_to_string({_gram_sql(3)}, '|') AS grams FROM (SELECT item_id, {_COMPACT} AS t FROM benchmark)")
def item_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(X.ngrams("text", 3), "|").alias("grams"))


_AFTER = r"regexp_replace(regexp_replace(regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g')"


def _cut_sql(text: str, cuts: list[str]) -> str:
    """Surgery: the cuts one after another, then fewer blanks."""
    for p in cuts:
        text = f"regexp_replace({text}, '{p}', '', 'g')"
    return _AFTER.format(x=text)


def _masked_sql(text: str, masks: list[tuple[str, str]]) -> str:
    for pattern, by in masks:
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"
    return text


_NORM = _masked_sql(X.NFKC_ASCII_SQL.format(x="text"), X.DEGENERATION_STEPS)


@query("T-12 T-13", f"""WITH d AS (SELECT doc_id, {_NORM} AS n FROM documents), s AS (SELECT doc_id, regexp_replace(n, '\\s+', '', 'g') AS t, list_filter(list_transform(string_split_regex(n, '[。！？!?\\n;；]+'), lambda s: {_STRIP.format(x='s')}), lambda s: s <> '') AS s FROM d),
g AS (SELECT doc_id, list_filter(s, lambda x: NOT regexp_matches(x, '[0-9]')) AS o, list_filter(list_transform(s, lambda x: regexp_replace(x, '\\s+', '', 'g')), lambda x: length(x) >= 10) AS same, {_gram_sql(8)} AS eight, {_gram_sql(2)} AS two FROM s),
m AS (SELECT doc_id, len(list_filter(o, lambda x: length(x) <= 6)) / greatest(1, len(o)) AS short_ratio, coalesce(list_max(map_values(list_histogram(eight))), 0)::BIGINT AS max_8gram, coalesce(list_max(map_values(list_histogram(same))), 0)::BIGINT AS max_sentence, CASE WHEN len(two) = 0 THEN 0.0 ELSE len(list_distinct(two)) / len(two) END AS d2 FROM g)
SELECT doc_id, round(short_ratio, 6) AS short_ratio, max_8gram, max_sentence, short_ratio > 0.25 OR max_8gram >= 3 AS soft, d2 < 0.10 OR max_sentence >= 3 OR (max_8gram >= 5 AND d2 < 0.35) AS extreme FROM m""")
def degeneration(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("n", X.degeneration_input("text")).withColumn("d", X.degeneration(F.col("n")))
    return d.select("doc_id", r6(F.col("d.short_ratio")).alias("short_ratio"), long("d.max_8gram").alias("max_8gram"), long("d.max_sentence").alias("max_sentence"), "d.soft", "d.extreme")


@query("T-14 T-15", f"""WITH d AS (SELECT doc_id, {_COMPACT} AS t, text FROM documents), g AS (SELECT *, coalesce(list_max(map_values(list_histogram({_gram_sql(8)}))), 0) AS a, coalesce(list_max(map_values(list_histogram({_gram_sql(12)}))), 0) AS b, coalesce(list_max(map_values(list_histogram({_gram_sql(20)}))), 0) AS c FROM d)
SELECT doc_id, round(CASE WHEN length(t) < 80 THEN 0 ELSE least(0.8, CASE WHEN a >= 5 THEN 0.35 ELSE 0 END + CASE WHEN b >= 4 THEN 0.35 ELSE 0 END + CASE WHEN c >= 3 THEN 0.25 ELSE 0 END) END::DOUBLE, 6) AS repeat_penalty,
round(CASE WHEN n <= 2200 THEN 0 ELSE least(0.6, (n - 2200) / 1000.0 * 0.3) END::DOUBLE, 6) AS length_penalty FROM (SELECT *, length({_STRIP.format(x='text')}) AS n FROM g)""")
def repeat_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", r6(X.repeat_penalty("text")).alias("repeat_penalty"), r6(X.length_penalty("text")).alias("length_penalty"))


def _with_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the one before it of the same source and hundred of ids: an equi-join, no ordered window over a source."""
    d = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    p = d.select((F.col("doc_id") + 20).alias("doc_id"), F.col("text").alias("ref"))
    return d.join(p, "doc_id")


@query("T-17 (5-gram half)", rf"""WITH j AS (SELECT d.doc_id, regexp_replace(substr(d.text, 1, 3000), '\s+', '', 'g') AS t, regexp_replace(substr(p.text, 1, 6000), '\s+', '', 'g') AS r FROM documents d JOIN documents p ON d.doc_id = p.doc_id + 20),
g AS (SELECT doc_id, list_distinct({_gram_sql(5)}) AS a, list_distinct({_gram_sql(5).replace('(t', '(r')}) AS b FROM j)
SELECT doc_id, round(CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(a) END, 6) AS overlap FROM g""")
def copy_overlap_5gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_previous(spark, sf_dir).select("doc_id", r6(X.gram_overlap(F.col("text"), F.col("ref"))).alias("overlap"))


@query("T-17 T-18 X-22")
def copy_and_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    other = b.select((F.col("item_id") + 1).alias("item_id"), F.col("text").alias("gold"))
    j = b.join(other, "item_id")
    return j.select("item_id", r6(X.copy_signal(F.col("text"), F.col("gold"))).alias("copy"), r6(rules.answer_drift(F.col("text"), F.col("gold"))).alias("drift"))


@query("T-19 T-28", r"""WITH s AS (SELECT item_id, list_filter(string_split_regex(text, '\n'), lambda x: trim(x) <> '') AS s FROM benchmark)
SELECT item_id, array_to_string(list_transform(s, lambda x, i: '[' || i || '] ' || x), chr(10)) AS numbered FROM s""")
def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(F.split("text", r"\n"), lambda x: F.trim(x) != "")
    return table(spark, sf_dir, "benchmark").select("item_id", X.numbered(lines).alias("numbered"))


@query("T-21 (NFKC)", "SELECT doc_id, md5(text) AS normal FROM documents")
def normal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, every third of them in full-width characters, as NFKC has them."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    wide = F.translate("text", "".join(map(chr, range(0x21, 0x7F))), "".join(map(chr, range(0xFF01, 0xFF5F))))
    return d.select("doc_id", F.md5(X.normal(F.when(F.col("doc_id") % 3 == 0, wide).otherwise(F.col("text")))).alias("normal"))


_CUTS = ["All rights reserved", r"https?://\S+"]
_HALF = r"list_filter(list_transform(regexp_extract_all(text, '[^。！？!?\n;；]*[。！？!?\n;；]|[^。！？!?\n;；]+$'), lambda s: s), lambda s: regexp_replace(s, '\s+', '', 'g') <> '')"


@query("T-19 T-20 T-21", f"""WITH d AS (SELECT doc_id, {_STRIP.format(x='text')} <> {_cut_sql('text', _CUTS)} AS has_trace, {_masked_sql(_masked_sql(X.NFKC_ASCII_SQL.format(x='text'), [(m, '□') for m in X.MASKS]), [('□+', '□')])} AS m, {_HALF} AS h FROM documents)
SELECT doc_id, has_trace, length(m) AS masked_len, length(array_to_string(h[1 : greatest(1, len(h) // 2)], '')) AS short_len FROM d""")
def surgery_and_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    cut = X.surgery("text", _CUTS)
    return d.select("doc_id", (X.strip(F.col("text")) != cut).alias("has_trace"), long(F.length(X.mask_facts("text"))).alias("masked_len"), long(F.length(X.shorten("text"))).alias("short_len"))


_NUMS = r"list_sort(list_distinct(list_concat(list_filter(list_transform(regexp_extract_all({x}, '[0-9]+(?:\.[0-9]+)?\s*(?:%)?'), lambda y: regexp_replace(y, '\s+', '', 'g')), lambda y: y <> ''), list_filter(list_transform(regexp_extract_all({x}, '[0-9][0-9,]*(?:\.[0-9]+)?'), lambda y: replace(y, ',', '')), lambda y: length(regexp_replace(y, '[^0-9]', '', 'g')) >= 2))))"


@query("T-22", f"SELECT doc_id, array_to_string({_NUMS.format(x='text')}, '|') AS numbers FROM documents")
def number_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = facts.number_facts("text", unit=r"[0-9]+(?:\.[0-9]+)?\s*(?:%)?", bare=r"[0-9][0-9,]*(?:\.[0-9]+)?")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(n, "|").alias("numbers"))


@query("G-21", f"WITH j AS (SELECT d.doc_id, {_NUMS.format(x='d.text')} AS a, {_NUMS.format(x='p.text')} AS b FROM documents d JOIN documents p ON d.doc_id = p.doc_id + 20) SELECT doc_id, len(list_filter(a, lambda y: NOT list_contains(b, y))) AS n_introduced, len(list_filter(b, lambda y: NOT list_contains(a, y))) AS n_missing FROM j")
def introduced_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    num = lambda c: facts.number_facts(c, unit=r"[0-9]+(?:\.[0-9]+)?\s*(?:%)?", bare=r"[0-9][0-9,]*(?:\.[0-9]+)?")
    j = _with_previous(spark, sf_dir).withColumn("a", num("text")).withColumn("b", num("ref"))
    return j.select("doc_id", long(F.size(F.array_except("a", "b"))).alias("n_introduced"), long(F.size(F.array_except("b", "a"))).alias("n_missing"))


_POL = ["the", "in", "of", "and"]


@query("T-23 T-24 T-25 G-2 G-19", """WITH f AS (SELECT conv_id, turn, role, list_sort(list_filter(['the ', 'of ', 'and '], lambda w: contains(text, w))) AS pol FROM conversations),
p AS (SELECT conv_id, list_distinct(flatten(list(pol))) AS pool FROM f WHERE role = 'user' GROUP BY conv_id)
SELECT f.conv_id, f.turn, len(list_filter(f.pol, lambda x: NOT list_contains(pool, x))) = 0 AS in_pool, len(f.pol) > 0 AND len(pool) > 0 AS comparable,
CASE WHEN len(f.pol) = 0 AND len(pool) > 0 THEN 'no_comparable_facts' WHEN len(f.pol) = 0 THEN 'no_facts_in_either' WHEN len(pool) = 0 THEN 'v1_pool_has_no_facts' WHEN len(list_filter(f.pol, lambda x: NOT list_contains(pool, x))) > 0 THEN 'introduced_new_fact' ELSE 'ok' END AS reason
FROM f JOIN p USING (conv_id) WHERE f.role = 'assistant'""")
def answer_pool_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = {"polarity": ["the ", "of ", "and "], "dates": "(?!)", "values": ["(?!)"]}
    c = table(spark, sf_dir, "conversations")
    pool = c.filter("role = 'user'").groupBy("conv_id").agg(F.collect_list("text").alias("answers"))  # a conversation's questions
    pool = pool.select("conv_id", facts.pool_facts(F.col("answers"), **sets).alias("pool"))
    got = c.filter("role = 'assistant'").join(pool, "conv_id").withColumn("r", facts.answer_in_pool(F.col("text"), F.col("pool"), **sets))
    return got.select("conv_id", "turn", "r.in_pool", "r.comparable", "r.reason")


@query("G-4 G-5 G-6 G-7 G-8 G-9 G-10 G-11 G-12")
def candidate_feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _replies(spark, sf_dir).filter("role = 'assistant'").withColumn("gold", F.col("role")).withColumn("prompt", F.concat(F.lit(P.REFERENCES_HEAD), F.col("text"), F.lit(P.QUESTION_HEAD)))
    f = rules.candidate_features(r.select("conv_id", "turn", "reply", "prompt", "gold"), "reply", "prompt", "gold")
    c = F.col
    reward = rules.derag_reward(c("format_ok"), c("degen.extreme"), c("fact_recall"), F.size("introduced_nums"), c("grounding_floor_ok"), c("copy_ratio"), c("img_trace"), c("counts.explicit_ref"), c("counts.ref_enumeration"), c("standalone"), c("citation_density"), c("masked_copy"))
    return f.withColumn("rw", reward).select("conv_id", "turn", "l0_pass", F.array_join("l0_reasons", "+").alias("l0_reasons"), "burden", "repair_route", r6(c("copy_ratio")).alias("copy_ratio"), r6(c("rw.reward")).alias("reward"), "rw.gate")


@query("G-1", "SELECT doc_id, " + " OR ".join(f"regexp_matches(text, '{p}')" for ps in P.RAG_STYLE_LATIN.values() for p in ps) + " AS has_rag_style FROM documents")
def rule_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", rules.has_rag_style(F.col("text"), P.RAG_STYLE_LATIN, dump=False).alias("has_rag_style"))


@query("G-14 G-15 G-16", """WITH r AS (SELECT conv_id, turn, length(trim(text)) AS n, (conv_id * 7 + turn) % 10 / 10.0 AS acc, 1 / (1 + 0.34 * (len(string_split(text, 'ing')) - 1) + 0.1 * turn) AS hum FROM conversations)
SELECT conv_id, turn, round(CASE WHEN n < 40 OR n > 2000 THEN -1 WHEN acc < 0.3 THEN 0.1 * acc ELSE acc * (0.5 + 0.5 * hum) END, 6) AS reward, CASE WHEN n < 40 OR n > 2000 THEN 'format_fail' WHEN acc < 0.3 THEN 'acc_drift' ELSE 'ok' END AS gate FROM r""")
def multiplicative_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    r = table(spark, sf_dir, "conversations").withColumn("acc", (c("conv_id") * 7 + c("turn")) % 10 / 10.0)
    human = rules.humanness(c("text"), 0.1 * c("turn"), traces=["ing"])
    m = rules.multiplicative_reward(F.length(F.trim("text")).between(40, 2000), c("acc"), human)
    return r.withColumn("m", m).select("conv_id", "turn", r6(c("m.reward")).alias("reward"), "m.gate")


@query("G-17 X-33", """WITH r AS (SELECT conv_id, turn, (conv_id + turn) % 5 <> 0 AS f, turn % 3 <> 0 AS p, conv_id % 4 <> 0 AS c, contains(text, 'shou') AS bad, CASE WHEN turn % 2 = 0 THEN (conv_id % 11)::DOUBLE END AS k, CASE WHEN length(text) > 800 THEN 0.35 ELSE 0 END AS pen FROM conversations)
SELECT conv_id, turn, round((CASE WHEN NOT f THEN -4 WHEN NOT p THEN -3 WHEN NOT c THEN -2 WHEN bad THEN 0.5 + 0.2 * coalesce(greatest(0, least(1, k / 10)), 0) - pen ELSE 1 + 0.4 * coalesce(greatest(0, least(1, k / 10)), 0) - pen END)::DOUBLE, 6) AS reward FROM r""")
def lexicographic_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    k = F.when(c("turn") % 2 == 0, (c("conv_id") % 11).cast("double"))
    value = rules.lexicographic_reward((c("conv_id") + c("turn")) % 5 != 0, c("turn") % 3 != 0, c("conv_id") % 4 != 0, c("text").contains("shou"), k, F.when(F.length("text") > 800, 0.35).otherwise(0.0))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", r6(value).alias("reward"))


@query("G-18", "SELECT 1 AS good_first, count(*) AS n FROM benchmark")
def reward_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four synthetic replies for each item must be rewarded in order: good, rule broken, answer wrong, format broken."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", r"[<>]", "").alias("t"))
    sets = {"polarity": ["approved", "refused"], "dates": "(?!)", "values": ["(?!)"]}
    pool = facts.pool_facts(F.array(F.lit("approved")), **sets)
    ok, bad = "<answer>approved</answer>", "<answer>refused</answer>"
    cases = [("good", F.lit(""), ok, True), ("rule_bad", F.lit("according to "), ok, True), ("answer_bad", F.lit(""), bad, True), ("format_bad", F.lit(""), ok, False)]
    score = lambda lead, ans, closed: rules.text_reward(F.concat(F.lit("<think>"), lead, F.col("t"), F.lit(("</think>" if closed else "") + ans)), pool, F.lit(None).cast("double"), 0, {"A": ["according to"]}, **sets)
    s = b.select("item_id", *[score(lead, a, closed).alias(name) for name, lead, a, closed in cases])
    good = (F.col("good") > F.col("rule_bad")) & (F.col("rule_bad") > F.col("answer_bad")) & (F.col("answer_bad") > F.col("format_bad"))
    return s.agg(F.min(good.cast("int")).alias("good_first"), F.count("*").alias("n"))


@query("G-23", """WITH v AS (SELECT event_id, CASE WHEN value < 30 THEN 'clean' WHEN value < 70 THEN 'traced' ELSE 'uncertain' END AS a, CASE WHEN user_id % 2 = 0 THEN 'clean' ELSE 'traced' END AS b, CASE WHEN event_id % 3 = 0 THEN 'clean' ELSE 'uncertain' END AS c FROM events)
SELECT event_id, CASE WHEN a = b AND a <> 'uncertain' THEN a WHEN (a = 'clean')::INT + (b = 'clean')::INT + (c = 'clean')::INT >= 2 THEN 'clean' ELSE 'traced' END AS vote FROM v""")
def settled_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    a = judge.binary_vote(F.when(c("value") < 30, "Clean ").when(c("value") < 70, "dirty").otherwise("?"))
    b, d = judge.binary_vote(F.when(c("user_id") % 2 == 0, "yes").otherwise("no")), judge.binary_vote(F.when(c("event_id") % 3 == 0, "pass").otherwise("hm"))
    return table(spark, sf_dir, "events").select("event_id", judge.settled_vote(a, b, d).alias("vote"))


@query("G-25 G-28", """WITH e AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'score: ' || (event_id % 17) || ' junk' WHEN event_id % 4 = 1 THEN '```json {"score": ' || (event_id % 13) || '}```' WHEN event_id % 4 = 2 THEN 'none' ELSE '{"score": "' || (event_id % 9) || '"' END AS raw FROM events)
SELECT event_id, CASE WHEN event_id % 4 = 2 THEN NULL ELSE least(10, try_cast(regexp_extract(raw, 'score"?\\s*[:=]\\s*"?([0-9]+)', 1) AS DOUBLE)) END AS score FROM e""")
def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    s = lambda x: x.cast("string")
    raw = F.when(k % 4 == 0, F.concat(F.lit("score: "), s(k % 17), F.lit(" junk"))).when(k % 4 == 1, F.concat(F.lit('```json {"score": '), s(k % 13), F.lit("}```"))).when(k % 4 == 2, "none").otherwise(F.concat(F.lit('{"score": "'), s(k % 9), F.lit('"')))
    return table(spark, sf_dir, "events").select("event_id", judge.salvage(raw, ["score"])["score"].alias("score"))


@query("G-26", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '1' WHEN event_id % 3 = 1 THEN '1,2' ELSE '' END AS flagged FROM events")
def flag_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    raw = F.when(k == 0, 'x {"flags": [{"sid": 1, "copied": true}, {"sid": 2, "copied": false}, {"sid": 9, "copied": true}]}').when(k == 1, '{"copied_sids": [2, 1, 7]}').otherwise("nothing")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(judge.flags(raw, F.array(F.lit(1), F.lit(2), F.lit(3))), ",").alias("flagged"))


@query("G-27 X-34", "SELECT event_id, event_type AS reply FROM events")
def reply_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    a = F.to_json(F.struct(F.array(F.struct(F.struct(t.alias("content")).alias("message"))).alias("choices")))
    b = F.to_json(F.struct(F.lit("").alias("output_text"), t.alias("response")))
    return table(spark, sf_dir, "events").select("event_id", judge.reply_text(F.when(F.col("event_id") % 2 == 0, a).otherwise(b)).alias("reply"))


@query("§2.13", """WITH v AS (SELECT item_id, ('0x' || substr(md5('scorer|' || item_id || '|' || k), 1, 8))::BIGINT AS h FROM benchmark, range(0, 16) t(k)) SELECT item_id, count(*) FILTER (h % 16 <> 0) AS n, round(avg(h % 101 / 10.0) FILTER (h % 16 <> 0), 6) AS clean_score FROM v GROUP BY item_id""")
def stub_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = HashScorer().votes(table(spark, sf_dir, "benchmark"), "item_id", 16)
    return v.groupBy("item_id").agg(F.count("score").alias("n"), r6(F.avg("score")).alias("clean_score"))


@query("X-18 X-17", """WITH u AS (SELECT conv_id, min(turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id), a AS (SELECT conv_id, max(turn) AS t FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT u.conv_id, md5(x.text) AS prompt, md5(y.text) AS chosen FROM u JOIN a USING (conv_id) JOIN conversations x ON x.conv_id = u.conv_id AND x.turn = u.t JOIN conversations y ON y.conv_id = a.conv_id AND y.turn = a.t""")
def messages_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    m = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))  # one dialogue
    return packaging.pair_parts(m).filter("prompt is not null and chosen is not null").select("conv_id", F.md5("prompt").alias("prompt"), F.md5("chosen").alias("chosen"))


@query("S-9 R-7 (GRPO pool)", "SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 2 ELSE 3 END AS pool_size FROM customer")
def grpo_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("gold", F.when(F.col("c_nationkey") % 2 == 0, F.col("c_name")).otherwise(F.lit("gold"))).withColumn("samples", F.array(F.lit(" "), F.col("c_mktsegment"), F.col("c_name")))
    rows = packaging.grpo_rows(c, "sys", "c_name", "c_name", "gold", "samples")
    return rows.select("c_custkey", F.size(packaging.read_pool(F.col("v1_answers_json"))).alias("pool_size"))


@query("S-8 (Python)")
def html_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    p = table(spark, sf_dir, "pages").withColumn("t", html.paragraphs("html"))
    return p.select("page_id", long(F.length("t")).alias("n_chars"), F.md5("t").alias("h"))


@query("S-8 (native)", r"SELECT page_id, count(*) FILTER (x <> '') AS n_lines FROM (SELECT page_id, unnest(string_split(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script[^>]*>.*?</script|style[^>]*>.*?</style)>', '', 'g'), '(?i)</?(?:article|br|div|footer|h1|h2|h3|h4|h5|h6|header|li|nav|ol|p|section|table|title|tr|ul)(?:\s[^>]*)?/?>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10))) AS y FROM pages), (SELECT trim(regexp_replace(y, '(?:\s|&nbsp;)+', ' ', 'g')) AS x) GROUP BY page_id")
def html_lines_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = html.paragraphs_native(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, "\n"))).cast("long").alias("n_lines"))


@query("X-27", "SELECT max(page_id) AS step FROM pages")
def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("/run/checkpoint-"), F.col("page_id").cast("string")).alias("path"))
    return tables.latest_checkpoint(p.unionByName(spark.createDataFrame([("/run/checkpoint-best",)], "path string"))).select("step")


@query("X-25", "SELECT item_id, CASE WHEN position('.' IN text) = 0 THEN length(text) ELSE position('.' IN text) END AS n_low FROM benchmark")
def segment_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.selection import segment_weights as weights

    w = weights(F.col("text"), ".")
    return table(spark, sf_dir, "benchmark").select("item_id", long(F.size(F.filter(w, lambda x: x < 0.05))).alias("n_low"))


@query("X-26", "SELECT event_id AS step, value FROM events WHERE value IS NOT NULL")
def training_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.create_map(F.lit("step"), F.col("event_id").cast("string"), F.lit("loss"), F.col("value").cast("string"), F.lit("note"), F.lit("n/a"))
    e = table(spark, sf_dir, "events").select(F.array(s).alias("log_history"))
    return tables.training_log(e).select("step", "value")


@query("X-35", """SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS content FROM conversations GROUP BY conv_id""")
def sse_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    lines = c.select("conv_id", "turn", F.concat(F.lit("data: "), F.to_json(F.struct(F.lit("r").alias("reasoning"), F.col("text").alias("content")))).alias("value"))
    noise = c.select("conv_id", (F.col("turn") + 1000).alias("turn"), F.lit("data: [DONE]").alias("value"))
    return packaging.sse_text(lines.unionByName(noise), "value", "conv_id", "turn").select("conv_id", F.md5("content").alias("content"))


_LATIN = [p for ps in P.RAG_STYLE_LATIN.values() for p in ps]
_TRACED = lambda x: " OR ".join(f"regexp_matches({x}, '{p}')" for p in _LATIN)


@query("X-6", f"""WITH d AS (SELECT lang, text, {_cut_sql('text', _LATIN)} AS after FROM documents), f AS (SELECT lang, {_TRACED('text')} AS b, {_TRACED('after')} AS a FROM d)
SELECT count(*) AS n, count(*) FILTER (b) AS n_before, count(*) FILTER (a) AS n_after, CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS grp FROM f GROUP BY GROUPING SETS ((), (lang))""")
def rewrite_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace flags before and after surgery, over all and by language."""
    d = table(spark, sf_dir, "documents").select("lang", "text", X.surgery("text", _LATIN).alias("after"))
    flag = lambda c: rules.has_rag_style(F.col(c), P.RAG_STYLE_LATIN, dump=False)
    f = d.select("lang", flag("text").alias("b"), flag("after").alias("a"))
    agg = [F.count("*").alias("n"), F.count_if("b").alias("n_before"), F.count_if("a").alias("n_after")]
    return over_sets(f, "lang", "grp", agg)


@query("§2.10 (drag)", """WITH e AS (SELECT vec_id // 5 AS reply, vec_id % 5 AS place, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT e.reply, e.place AS len, list_dot_product(e.v, r.v) / sqrt(list_dot_product(e.v, e.v)) / sqrt(list_dot_product(r.v, r.v)) AS sim FROM e JOIN e r ON e.reply = r.reply AND r.place = 0 WHERE e.place > 0)
SELECT reply, round(sum(len * sim) / greatest(1, sum(len)), 6) AS drag, round(sum(CASE WHEN sim >= 0.05 THEN len ELSE 0 END) / greatest(1.0, sum(len)), 6) AS copy_share FROM s GROUP BY reply""")
def drag_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five vectors a reply: its reference and four sentences, as long as their place says."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("reply"), (F.col("vec_id") % 5).alias("place"), vectors.normalise(F.col("embedding")).alias("v"))
    s = e.filter("place > 0").join(e.filter("place = 0").select("reply", F.col("v").alias("ref")), "reply").select("reply", "place", vectors.dot(F.col("v"), F.col("ref")).alias("sim"))
    d = s.groupBy("reply").agg(F.array_sort(F.collect_list(F.struct("place", "sim"))).alias("s"))  # four sentences
    d = d.withColumn("d", vectors.drag(F.transform("s", lambda x: x["place"].cast("double")), F.transform("s", lambda x: x["sim"]), 0.05))
    return d.select("reply", r6(F.col("d.drag")).alias("drag"), r6(F.col("d.copy_share")).alias("copy_share"))


@query("I-1 S-4 S-5 (stream)", "SELECT event_type, count(*) AS n, count(*) FILTER (value >= 50) AS n_ok FROM events GROUP BY event_type")
def progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts from a resumable stream in file batches."""
    from ..streaming.progress import run_available

    here = shared_path(spark, "progress")
    schema = table(spark, sf_dir, "events").schema
    out = run_available(spark, f"{sf_dir}/events.parquet", schema, lambda d: d.select("event_id", "event_type", (F.col("value") >= 50).alias("ok")), f"{here}/out", f"{here}/checkpoint")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))


@query("S-1 S-4", "SELECT item_id, text FROM benchmark")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "jsonl")
    tables.write_jsonl(table(spark, sf_dir, "benchmark"), path)
    return tables.read_jsonl(spark, path, "item_id long, text string", mode="strict")


@query("S-6 S-7", "SELECT DISTINCT trim(p_brand) AS brand, trim(p_type) AS kind FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)")
def sheet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, p = shared_path(spark, "sheet"), table(spark, sf_dir, "part")
    p.select(F.concat(F.lit(" "), "p_brand").alias("brand"), F.col("p_type").alias("kind")).write.option("header", True).csv(path)
    first = p.agg(F.min("p_brand").alias("b")).first()["b"]
    return tables.read_table(spark, path, keep=f"brand={first}", required=("brand", "kind"))


@query("W-21", """WITH s AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events),
k AS (SELECT event_id, value FROM s WHERE i % CAST(ceil(n / 60.0) AS BIGINT) = 0), e AS (SELECT min(value) AS lo, max(value) AS hi FROM k)
SELECT event_id, value, CAST(least(7, floor((value - lo) / (hi - lo) * 8)) AS INT) AS level FROM k, e""")
def downsampled_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.downsample(table(spark, sf_dir, "events"), "event_id", "value")


@query("T-26", "SELECT item_id, '结论：' || array_to_string(list_sort(list_filter(['the ', 'of ', 'and '], lambda w: contains(text, w))), '、') AS anchor FROM benchmark WHERE contains(text, 'the ') OR contains(text, 'of ') OR contains(text, 'and ')")
def anchor_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = {"polarity": ["the ", "of ", "and "], "dates": "(?!)", "values": ["(?!)"]}
    b = table(spark, sf_dir, "benchmark").select("item_id", facts.pool_facts(F.array("text"), **sets).alias("pool"))
    return b.select("item_id", facts.anchor_text(F.col("pool")).alias("anchor")).filter("anchor <> ''")

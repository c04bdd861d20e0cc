"""Ids, splits, deduplication, best of K, pairs, caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import margin_ok
from ..functions.text import strip
from ..operators import aggregates as A
from ..operators import incremental as I
from ..operators import joins as J
from ..operators import rows as R
from ..operators import selection as W
from ..operators.cache import ScoreCache
from ..operators.ranking import content_id, hash_order, side
from ..sources.shared import shared_path, written
from .base import INDEX, C, candidates, long, query, r6, table


@query("R-9 W-1 W-4 A-8 (entry)", f"""WITH {C},
s AS (SELECT o_orderkey AS qid, CASE WHEN row_number() OVER (ORDER BY md5('split|' || o_orderkey), o_orderkey) <= 500 THEN 'eval' ELSE 'train' END AS split FROM orders),
g AS (SELECT c.*, split FROM c JOIN s USING (qid) WHERE pen <= 0.08),
b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ln, pk, sk) AS rb, row_number() OVER (PARTITION BY qid ORDER BY score, ln, pk, sk) AS rw FROM g),
p AS (SELECT x.split, x.qid FROM b x JOIN b y USING (qid) WHERE x.rb = 1 AND y.rw = 1 AND (x.ln, x.pk, x.sk) <> (y.ln, y.pk, y.sk) AND x.score - y.score >= 10000)
SELECT s.split, count(*) AS n_queries, count(k.qid) AS n_gated, count(p.qid) AS n_pairs
FROM s LEFT JOIN (SELECT DISTINCT qid FROM g) k USING (qid) LEFT JOIN p ON p.qid = s.qid GROUP BY s.split""")
def best_of_k_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = R.fixed_split(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid")), "qid", 500, "split")
    gated = candidates(spark, sf_dir).filter(F.col("pen") <= 0.08)
    pairs = W.extreme_pairs(gated, ["qid"], "score", INDEX, 10000.0).select("qid", F.lit(True).alias("paired"))
    out = split.join(gated.select("qid").distinct().withColumn("gated", F.lit(True)), "qid", "left").join(pairs, "qid", "left")
    return out.groupBy("split").agg(F.count("*").alias("n_queries"), F.count("gated").alias("n_gated"), F.count("paired").alias("n_pairs"))


@query("W-1", f"WITH {C}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ln, pk, sk) AS rn FROM c) SELECT qid, ln, pk, sk, score FROM r WHERE rn = 1")
def best_of_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.best_of_k(candidates(spark, sf_dir), ["qid"], "score", INDEX).select("qid", *INDEX, "score")


@query("W-2", f"WITH {C}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pen * (0.5 + 0.5 * tax) DESC, ln, pk, sk) AS rank FROM c) SELECT qid, ln, pk, sk, rank FROM r WHERE rank <= 2")
def top_n_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.top_n(candidates(spark, sf_dir), ["qid"], W.composite(F.col("pen"), F.col("tax")), INDEX, 2).select("qid", *INDEX, "rank")


@query("W-3", f"WITH {C}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ln, pk, sk) AS rank FROM c WHERE qty >= 10) SELECT qid, ln, pk, sk, rank FROM r WHERE rank <= 3")
def floor_then_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.top_n(candidates(spark, sf_dir), ["qid"], F.col("score"), INDEX, 3, F.col("qty") >= 10).select("qid", *INDEX, "rank")


@query("W-4", f"""WITH {C}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ln, pk, sk) AS a, row_number() OVER (PARTITION BY qid ORDER BY pen, ln, pk, sk) AS b FROM c)
SELECT x.qid, x.ln AS chosen_ln, x.pk AS chosen_pk, y.ln AS rejected_ln, y.pk AS rejected_pk FROM r x JOIN r y USING (qid)
WHERE x.a = 1 AND y.b = 1 AND (x.ln, x.pk, x.sk) <> (y.ln, y.pk, y.sk) AND x.score - y.pen >= 20000""")
def extreme_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.extreme_pairs(candidates(spark, sf_dir), ["qid"], "score", INDEX, 20000.0, low="pen").select("qid", "chosen_ln", "chosen_pk", "rejected_ln", "rejected_pk")


@query("W-5", f"""WITH {C}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pen, score DESC, ln, pk, sk) AS rn FROM c WHERE pen <= 0.03 AND qty >= 5) WHERE rn = 1),
j AS (SELECT c.qid, b.ln AS chosen_ln, b.pk AS chosen_pk, c.ln AS rejected_ln, c.pk AS rejected_pk,
  row_number() OVER (PARTITION BY c.qid ORDER BY abs(c.score - b.score), c.ln, c.pk, c.sk) AS rn
  FROM c JOIN b USING (qid) WHERE (c.ln, c.pk, c.sk) <> (b.ln, b.pk, b.sk) AND c.pen - b.pen >= 0.04 AND c.score <= b.score * 2)
SELECT qid, chosen_ln, chosen_pk, rejected_ln, rejected_pk FROM j WHERE rn = 1""")
def strict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    out = W.ranked_pairs(
        candidates(spark, sf_dir), ["qid"], INDEX, (c("pen") <= 0.03) & (c("qty") >= 5), [c("pen"), F.desc("score"), *map(c, INDEX)],
        lambda ch, rj: (rj("pen") - ch("pen") >= 0.04) & (rj("score") <= ch("score") * 2), [F.abs(c("score") - c("chosen_score")), *map(c, INDEX)],
    )
    return out.select("qid", "chosen_ln", "chosen_pk", c("ln").alias("rejected_ln"), c("pk").alias("rejected_pk"))


@query("W-6 G-13", f"""WITH {C}, f AS (SELECT *, CAST(qty AS INT) % 5 AS burden FROM c),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY burden, pen, score DESC, ln, pk, sk) AS rn FROM f WHERE burden <= 1) WHERE rn = 1),
j AS (SELECT f.qid, b.ln AS chosen_ln, f.ln AS rejected_ln, f.burden - b.burden AS d_burden, row_number() OVER (PARTITION BY f.qid ORDER BY f.ln, f.pk, f.sk) AS rn FROM f JOIN b USING (qid)
  WHERE (f.ln, f.pk, f.sk) <> (b.ln, b.pk, b.sk) AND (f.burden - b.burden >= 2 OR (f.burden - b.burden >= 1 AND f.pen * 4 - b.pen * 4 >= 0.12)) AND f.score BETWEEN b.score * 0.5 AND b.score * 2)
SELECT qid, chosen_ln, rejected_ln, d_burden FROM j WHERE rn = 1""")
def margin_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    f = candidates(spark, sf_dir).withColumn("burden", c("qty").cast("int") % 5)
    out = W.ranked_pairs(
        f, ["qid"], INDEX, c("burden") <= 1, [c("burden"), c("pen"), F.desc("score"), *map(c, INDEX)],
        lambda ch, rj: margin_ok(rj("burden") - ch("burden"), rj("pen") * 4 - ch("pen") * 4) & rj("score").between(ch("score") * 0.5, ch("score") * 2),
        [c(i) for i in INDEX],
    )
    return out.select("qid", "chosen_ln", c("ln").alias("rejected_ln"), (c("burden") - c("chosen_burden")).alias("d_burden"))


@query("W-7 S-9", f"""WITH {C}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ln, pk, sk) AS rn FROM c)
SELECT o_orderkey AS qid, '<think>' || chr(10) || ln || '-' || pk || chr(10) || '</think>' || chr(10) || '<answer>' || chr(10) || o_orderpriority || chr(10) || '</answer>' AS chosen,
  '<think>' || chr(10) || o_orderstatus || chr(10) || '</think>' || chr(10) || '<answer>' || chr(10) || o_orderpriority || chr(10) || '</answer>' AS rejected
FROM r JOIN orders ON o_orderkey = qid WHERE rn = 1""")
def answer_locked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.packaging import dpo_rows

    best = W.best_of_k(candidates(spark, sf_dir), ["qid"], "score", INDEX).select("qid", F.concat_ws("-", "ln", "pk").alias("best_think"))
    rows = table(spark, sf_dir, "orders").join(best, F.col("o_orderkey") == F.col("qid")).withColumn("query", F.col("qid").cast("string"))
    packed = dpo_rows(rows, "You are an analyst.", "query", "best_think", "o_orderstatus", "o_orderpriority", "query", {"qid": F.col("qid")})
    return packed.select(long("query").alias("qid"), F.element_at("messages", -1)["content"].alias("chosen"), F.col("rejected_response").alias("rejected"))


_SIGMA = "CASE WHEN {s} <= 0 THEN 0.0 WHEN {s} <= 0.03 THEN 0.0 + ({s} - 0.0) / (0.03 - 0.0) * (0.06 - 0.0) WHEN {s} <= 1.84 THEN 0.06 + ({s} - 0.03) / (1.84 - 0.03) * (0.17 - 0.06) WHEN {s} <= 2.64 THEN 0.17 + ({s} - 1.84) / (2.64 - 1.84) * (0.60 - 0.17) WHEN {s} <= 4.64 THEN 0.60 + ({s} - 2.64) / (4.64 - 2.64) * (1.63 - 0.60) WHEN {s} <= 7.34 THEN 1.63 + ({s} - 4.64) / (7.34 - 4.64) * (1.85 - 1.63) ELSE 1.85 END"


@query("W-8 D-7 D-8", f"""WITH {C}, s AS (SELECT qid, max(qty) / 5.0 AS hi, min(qty) / 5.0 AS lo FROM c GROUP BY qid),
g AS (SELECT qid, CAST(hi AS DOUBLE) AS hi, CAST(lo AS DOUBLE) AS lo, CAST({_SIGMA.format(s='CAST(hi AS DOUBLE)')} AS DOUBLE) + CAST({_SIGMA.format(s='CAST(lo AS DOUBLE)')} AS DOUBLE) AS w FROM s)
SELECT CAST(b AS INT) AS bucket, count(*) AS n, sum(qid)::BIGINT AS qids FROM g, (VALUES (2), (3)) v(b) WHERE hi - lo > 0 AND hi - lo > b * w GROUP BY b""")
def nested_sigma_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = candidates(spark, sf_dir).groupBy("qid").agg((F.max("qty") / 5.0).alias("hi"), (F.min("qty") / 5.0).alias("lo"))
    return W.nested_buckets(s, "hi", "lo").groupBy("bucket").agg(F.count("*").alias("n"), F.sum("qid").alias("qids"))


@query("W-9", f"""WITH {C}, e AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ln, pk, sk) - 1 AS p FROM c WHERE pen <= 0.06),
k AS (SELECT qid, min(CASE WHEN qty >= 30 THEN p END) AS first_ok, count(*) AS n_eligible FROM e WHERE p < 3 GROUP BY qid)
SELECT qid, first_ok, n_eligible, least(n_eligible, coalesce(first_ok + 1, n_eligible)) AS n_judged FROM k""")
def first_success_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumn("idx", F.struct(*INDEX))
    return W.first_success(c, ["qid"], "idx", F.col("pen") <= 0.06, F.col("qty") >= 30, 3).select("qid", long("first_ok").alias("first_ok"), long("n_eligible").alias("n_eligible"), long("n_judged").alias("n_judged"))


@query("W-10", """WITH t AS (SELECT event_id, event_type, event_id % 3 = 0 AS rep FROM events), cap AS (SELECT floor(count(*) FILTER (NOT rep) * 0.25) AS k FROM t),
r AS (SELECT *, row_number() OVER (ORDER BY md5('lineage|' || event_id), event_id) AS rn FROM t WHERE rep)
SELECT event_id, event_type FROM t WHERE NOT rep UNION ALL SELECT event_id, event_type FROM r, cap WHERE rn <= k""")
def lineage_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.capped_lineage(table(spark, sf_dir, "events", "event_id", "event_type"), F.col("event_id") % 3 == 0, "event_id", "lineage")


@query("W-11 W-12", """WITH d AS (SELECT p_partkey, p_size, p_retailprice FROM part)
SELECT * FROM (SELECT p_partkey, 'good' AS anchor FROM d WHERE p_size <= 25 ORDER BY p_retailprice, p_partkey LIMIT 10)
UNION ALL SELECT * FROM (SELECT p_partkey, 'bad' AS anchor FROM d WHERE p_size > 25 ORDER BY p_size DESC, p_partkey LIMIT 10)""")
def anchor_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return W.anchors(table(spark, sf_dir, "part"), c("p_size") <= 25, [c("p_retailprice"), c("p_partkey")], [F.desc("p_size"), c("p_partkey")], 10).select("p_partkey", "anchor")


@query("W-13", "SELECT event_id, row_number() OVER (ORDER BY md5('mix|' || event_id)) AS place FROM (SELECT event_id FROM events ORDER BY value DESC, ts, event_id LIMIT 40)")
def ordered_pick_then_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    picked = table(spark, sf_dir, "events").orderBy(F.desc("value"), "ts", "event_id").limit(40).select("event_id")
    return picked.withColumn("place", long(F.row_number().over(Window.orderBy(hash_order("mix", F.col("event_id"))))))  # 40 rows


@query("W-14", f"""WITH {C}, g AS (SELECT qid, avg(qty) AS m, stddev_samp(qty) AS s FROM c GROUP BY qid)
SELECT qid, ln, pk, sk, round((qty - m) / (s + 0.0001), 6) AS advantage FROM c JOIN g USING (qid) WHERE s >= 0.0001""")
def group_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.group_advantage(candidates(spark, sf_dir), ["qid"], "qty").select("qid", *INDEX, r6(F.col("advantage")).alias("advantage"))


@query("W-19", "WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT " + ", ".join(f"max(value) FILTER (k = round_even((n - 1) * {p}, 0)) AS p{int(p * 100)}" for p in (0.1, 0.5, 0.9, 0.99)) + " FROM r")
def nearest_rank_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.nearest_rank(table(spark, sf_dir, "events"), "value", [0.1, 0.5, 0.9, 0.99])


@query("W-20 R-3", "SELECT c_custkey, CAST(CASE WHEN right(md5('ab|' || c_custkey), 1) IN ('1','3','5','7','9','b','d','f') THEN 1 ELSE 0 END AS INT) AS side FROM customer")
def ab_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", side("ab", F.col("c_custkey")).alias("side"))


@query("R-1 R-2 R-3", "SELECT doc_id, substr(sha1(text), 1, 12) AS qid, substr(sha256(source || chr(10) || lang || chr(10) || text), 1, 20) AS candidate_id, substr(sha1(text), 1, 16) AS text_sha1 FROM documents")
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", content_id(t).alias("qid"), content_id(F.col("source"), F.col("lang"), t, digits=20, sha=256).alias("candidate_id"), content_id(t, digits=16).alias("text_sha1"))


@query("R-4", "SELECT c_custkey FROM customer WHERE trim(CASE WHEN c_custkey % 7 = 0 THEN '  ' ELSE c_name END) <> '' AND trim(c_mktsegment) <> ''")
def drop_blank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("c_name", F.when(F.col("c_custkey") % 7 == 0, F.lit(" \n ")).otherwise(F.col("c_name")))
    return R.drop_blank(rows, "c_name", "c_mktsegment").select("c_custkey")


@query("R-5", "SELECT min(doc_id) AS doc_id, md5(text) AS h FROM documents GROUP BY text")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one hash a row goes through the shuffle, not the text
    return R.dedup_first(table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h")), ["h"], [F.col("doc_id")])


@query("R-8", r"SELECT min(doc_id) AS doc_id, md5(lower(regexp_replace(text, '[\s\pP]+', '', 'g'))) AS h FROM documents GROUP BY 2")
def dedup_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.md5(R.normal_key("text")).alias("h")).agg(F.min("doc_id").alias("doc_id"))


@query("R-6 S-6", """SELECT h, source_rank, id FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY source_rank, id) AS rn FROM (
SELECT md5(text) AS h, 0 AS source_rank, item_id AS id FROM benchmark UNION ALL SELECT md5(text), 1, doc_id FROM documents)) WHERE rn = 1""")
def merge_priority_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "benchmark").select(F.md5("text").alias("h"), F.col("item_id").alias("id"))
    b = table(spark, sf_dir, "documents").select(F.md5("text").alias("h"), F.col("doc_id").alias("id"))
    return R.merge_by_priority([a, b], "h", [F.col("id")]).select("h", "source_rank", "id")


@query("R-7", """WITH u AS (SELECT conv_id, turn, regexp_replace(trim(text), '^\\s+|\\s+$', '', 'g') AS x FROM conversations),
f AS (SELECT conv_id, x, min(turn) AS t FROM u WHERE x <> '' GROUP BY conv_id, x) SELECT conv_id, string_agg(x, '|' ORDER BY t) AS pool FROM f GROUP BY conv_id""")
def ordered_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim("text").alias("x"))
    got = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "x"))).alias("a"))
    return got.select("conv_id", F.array_join(R.clean_array(F.transform("a", lambda s: s["x"])), "|").alias("pool"))


@query("R-9", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('v1|' || doc_id), doc_id) <= 100 THEN 'eval' ELSE 'train' END AS split FROM documents")
def fixed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fixed_split(table(spark, sf_dir, "documents", "doc_id"), "doc_id", 100, "v1")


@query("R-10", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('v2|' || doc_id), doc_id) <= floor((SELECT count(*) FROM documents) * 0.9) THEN 'train' ELSE 'eval' END AS split FROM documents")
def ratio_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ratio_split(table(spark, sf_dir, "documents", "doc_id"), "doc_id", 0.9, "v2")


@query("R-11", "SELECT qid, (row_number() OVER (ORDER BY qid) - 1) % 20 = 0 AS held_out FROM (SELECT DISTINCT substr(sha1(text), 1, 12) AS qid FROM documents)")
def systematic_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    qids = table(spark, sf_dir, "documents").select(content_id(F.col("text")).alias("qid")).distinct()
    return R.systematic_holdout(qids, "qid", 0.05)


_SCORED = "s AS (SELECT doc_id, text, CASE WHEN doc_id % 11 <> 3 THEN doc_id % 5 <> 0 END AS facts_ok, CASE WHEN doc_id % 4 = 0 THEN doc_id % 8 = 0 END AS facts_kept, CASE WHEN doc_id % 9 <> 0 THEN doc_id % 100 / 100::DOUBLE END AS human FROM documents)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as scored candidates, some without a score."""
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.when(k % 11 != 3, k % 5 != 0).alias("facts_ok"), F.when(k % 4 == 0, k % 8 == 0).alias("facts_kept"), F.when(k % 9 != 0, k % 100 / 100.0).alias("human"))


@query("X-13", f"""WITH {_SCORED}, k AS (SELECT doc_id, text, md5('cold|' || doc_id) AS h FROM s WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' AND coalesce(facts_ok, true) AND coalesce(facts_kept, true) AND coalesce(human, 0) >= 0.6)
SELECT doc_id, CASE WHEN (row_number() OVER (ORDER BY h) - 1) % 20 = 0 THEN 'eval' ELSE 'train' END AS split, md5('<think>' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10) || '</think>') AS reply FROM k""")
def cold_start_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that pass the older gate (missing facts pass, a missing score fails), every twentieth held out, with the assembled reply."""
    s = _scored(spark, sf_dir).withColumn("think", strip(F.col("text")))
    kept = s.filter(F.coalesce("facts_ok", F.lit(True)) & F.coalesce("facts_kept", F.lit(True)) & (F.coalesce("human", F.lit(0.0)) >= 0.6) & (F.col("think") != ""))
    kept = R.systematic_holdout(kept.withColumn("h", F.md5(F.concat(F.lit("cold|"), F.col("doc_id").cast("string")))), "h", 0.05)
    reply = F.md5(F.concat(F.lit("<think>\n"), "think", F.lit("\n</think>")))
    return kept.select("doc_id", F.when(F.col("held_out"), "eval").otherwise("train").alias("split"), reply.alias("reply"))


@query("X-14", f"WITH {_SCORED} SELECT doc_id, 'low' AS label FROM s UNION ALL SELECT doc_id, 'high' AS label FROM s WHERE coalesce(facts_ok AND human >= 0.6, false)")
def low_contrast_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every original counts as low; those that pass the gate come again as high."""
    s = _scored(spark, sf_dir)
    high = s.filter(F.coalesce(F.col("facts_ok") & (F.col("human") >= 0.6), F.lit(False)))
    return s.select("doc_id", F.lit("low").alias("label")).unionByName(high.select("doc_id", F.lit("high").alias("label")))


@query("R-12", "SELECT doc_id, doc_id % 10 = 0 AS held_out FROM documents")
def positional_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.positional_holdout(table(spark, sf_dir, "documents", "doc_id"), "doc_id")


@query("R-13", "SELECT doc_id, row_number() OVER (ORDER BY md5('tail|' || doc_id), doc_id) > n - least(50, greatest(0, n - 200)) AS held_out FROM documents, (SELECT count(*) AS n FROM documents)")
def tail_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tail_holdout(table(spark, sf_dir, "documents", "doc_id"), "doc_id", 50, 200, "tail")


@query("R-14", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('strat|' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 25")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stratified_sample(table(spark, sf_dir, "documents", "lang", "doc_id"), ["lang"], "doc_id", 25, "strat")


@query("R-15", "SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (ORDER BY md5('idx|' || user_id), user_id, event_id) AS rn FROM (SELECT min(event_id) AS event_id, user_id FROM events GROUP BY user_id)) WHERE rn <= 30")
def sample_with_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return R.sample_with_index(users, "event_id", "user_id", 30, "idx")


@query("R-16 J-8", "SELECT 'leak' AS kind, count(*) AS n FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 10 = 0) AND doc_id % 10 <> 0 UNION ALL SELECT 'no_label', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def leak_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    leak = R.leaks(d.filter("doc_id % 10 <> 0"), d.filter("doc_id % 10 = 0"), "h").agg(F.count("*").alias("n")).withColumn("kind", F.lit("leak"))
    bare = R.missing(d, table(spark, sf_dir, "labels"), "doc_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit("no_label"))
    return leak.unionByName(bare)


@query("R-18", """SELECT (SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS n_missing,
(SELECT count(DISTINCT doc_id) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id)) AS n_extra, (SELECT count(*) - count(DISTINCT doc_id) FROM labels) AS n_duplicate""")
def coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.coverage(table(spark, sf_dir, "documents", "doc_id"), table(spark, sf_dir, "labels", "doc_id"), "doc_id")


@query("R-19 J-8", "SELECT conv_id, turn FROM conversations WHERE (conv_id, turn) NOT IN (SELECT conv_id, turn FROM conversations WHERE role = 'user')")
def resume_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    return R.missing(c, c.filter("role = 'user'"), ["conv_id", "turn"]).select("conv_id", "turn")


@query("R-20", "SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('5-LOW') AND (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT')")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    sat = F.when(F.col("o_orderpriority") == "5-LOW", "bad").when(F.col("o_orderpriority") == "1-URGENT", "good").otherwise("none")
    res = F.when(F.col("o_orderstatus") == "F", "good")
    return table(spark, sf_dir, "orders").filter(R.quality_gate(sat, res)).select("o_orderkey")


@query("R-21", f"WITH {C} SELECT qid, ln, pk, sk FROM c WHERE flag = 'N' AND CAST(qty AS INT) % 4 = 0 AND qty / 50 >= 0.6 AND score / 60000 >= 0.7 AND pen <= 0.05")
def seed_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.rules import seed_gate as gate

    c = F.col
    return candidates(spark, sf_dir).filter(gate(c("flag") == "N", c("qty").cast("int") % 4, c("qty") / 50, c("score") / 60000, c("pen") + 0.45)).select("qid", *INDEX)


@query("R-22 R-23 A-7", """WITH e AS (SELECT event_id, value < 10 AS low, length(props) > 9 AS long, event_type = 'error' AS err FROM events)
SELECT CASE WHEN low THEN 'low' WHEN long THEN 'long' WHEN err THEN 'err' ELSE 'ok' END AS first_reason, concat_ws('+', CASE WHEN low THEN 'low' END, CASE WHEN long THEN 'long' END, CASE WHEN err THEN 'err' END) AS all_reasons, count(*) AS n FROM e GROUP BY 1, 2""")
def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.rules import first_reason, hard_reasons

    checks = {"low": F.col("value") < 10, "long": F.length("props") > 9, "err": F.col("event_type") == "error"}
    return table(spark, sf_dir, "events").groupBy(first_reason(checks).alias("first_reason"), F.array_join(hard_reasons(checks), "+").alias("all_reasons")).agg(F.count("*").alias("n"))


@query("R-24 X-31", "SELECT doc_id, v AS violation FROM (SELECT doc_id, unnest(list_filter([CASE WHEN n_chars < 100 THEN 'length' END, CASE WHEN lang NOT IN ('en', 'fr') THEN 'lang' END], lambda x: x IS NOT NULL)) AS v FROM documents)")
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.violations(table(spark, sf_dir, "documents"), "doc_id", {"length": F.col("n_chars") >= 100, "lang": F.col("lang").isin("en", "fr")})


@query("I-1 I-2", """WITH r AS (SELECT event_id, value >= 50 AS ok, row_number() OVER (ORDER BY md5('gather|' || event_id), event_id) AS position FROM events),
h AS (SELECT position, row_number() OVER (ORDER BY position) AS k FROM r WHERE ok), cut AS (SELECT ceil(position / 48.0) * 48 AS cut FROM h WHERE k = 200)
SELECT event_id, position FROM r WHERE position <= (SELECT cut FROM cut)""")
def early_stop_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.gather_prefix(table(spark, sf_dir, "events"), "event_id", F.col("value") >= 50, 200, "gather").select("event_id", "position")


@query("I-3 O-4", "SELECT count(*) AS n_cached, (SELECT count(DISTINCT user_id) FROM events) - count(*) AS n_to_score FROM (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 16 AND count(value) = count(*))")
def score_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("k"), F.count("value").alias("n"), F.avg("value").alias("clean_score")).withColumn("version", F.lit("v1"))
    cache = ScoreCache(spark, shared_path(spark, "score-cache"))
    cache.put(scored)
    return cache.read().agg(F.count("*").alias("n_cached")).crossJoin(cache.to_score(scored.select(F.col("key").cast("string").alias("key"), "version")).agg(F.count("*").alias("n_to_score")))  # one row each


@query("I-3", """WITH s AS (SELECT user_id AS key, count(*) >= 16 AND count(value) = count(*) AS full_votes FROM events GROUP BY user_id)
SELECT 1 AS run, count(*) FILTER (key % 3 = 0) AS n_scored, count(*) FILTER (key % 3 = 0 AND full_votes) AS n_cached FROM s UNION ALL SELECT 2, count(*) FILTER (key % 3 <> 0 OR NOT full_votes), count(*) FILTER (full_votes) FROM s""")
def score_cache_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one cache: the first over every third key, the second over all; it scores what the first has not kept."""
    folder = shared_path(spark, "score-cache")
    scored = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("key")).agg(F.count("*").alias("k"), F.count("value").alias("n"), F.avg("value").alias("clean_score"), F.max("user_id").alias("id")).withColumn("version", F.lit("v2"))
    out = []
    for number, asked in ((1, scored.filter("id % 3 = 0")), (2, scored)):
        cache = ScoreCache(spark, folder)  # nothing but the folder outlives a run
        todo = written(cache.to_score(asked), "to-score")
        cache.put(todo)
        counts = todo.agg(F.count("*").alias("n_scored")).crossJoin(cache.read().agg(F.count("*").alias("n_cached")))  # one row each
        out.append(counts.select(F.lit(number).alias("run"), "n_scored", "n_cached"))
    return out[0].unionByName(out[1])


@query("I-4", """WITH r AS (SELECT event_id, sum(value) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running FROM events)
SELECT CASE WHEN running >= 60000 THEN 'stop' WHEN running >= 48000 THEN 'warn' ELSE 'ok' END AS state, count(*) AS n, min(event_id) AS first_id FROM r GROUP BY 1""")
def budget_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.budget_fence(table(spark, sf_dir, "events"), ["ts", "event_id"], F.col("value"), 60000.0)
    return out.groupBy("state").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("X-8", f"WITH {C}, h AS (SELECT pk, count(*) AS n FROM c WHERE qty > 5 GROUP BY pk) SELECT p_partkey AS pk, CAST(unnest(range(1, greatest(0, 24 - coalesce(n, 0)) + 1)) AS INT) AS vote FROM part LEFT JOIN h ON pk = p_partkey")
def top_up_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = candidates(spark, sf_dir).select("pk", F.when(F.col("qty") > 5, F.col("qty")).alias("score"))
    return I.top_up(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk")), votes, "pk", 24)


@query("X-1", """WITH t AS (SELECT CASE WHEN p AND a AND b >= 1 AND d >= 1 THEN 'T1' WHEN NOT p AND b >= 1 THEN 'T3' WHEN p AND NOT a THEN 'skip_path' WHEN p AND b < 1 THEN 'skip_source_clean' WHEN p THEN 'skip_no_gain' ELSE 'skip_failed_clean' END AS tier
FROM (SELECT l_discount <= 0.05 AS p, l_returnflag <> 'A' AS a, CAST(l_quantity AS INT) % 3 AS b, l_linenumber % 3 AS d FROM lineitem)) SELECT tier, count(*) AS n FROM t GROUP BY tier""")
def seed_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return W.seed_tiers(candidates(spark, sf_dir), c("pen") <= 0.05, c("flag") != "A", c("qty").cast("int") % 3, c("ln") % 3).groupBy("tier").agg(F.count("*").alias("n"))


@query("X-2", """WITH r AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT event_id, event_type, value >= 60 AS ok FROM events))
SELECT CASE WHEN ok THEN 'kept' ELSE event_type END AS outcome, count(*) AS n_rows FROM r WHERE coalesce(before, 0) < 500 GROUP BY 1""")
def replay_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.replay_filter(table(spark, sf_dir, "events"), "event_id", F.col("value") >= 60, 500, F.col("event_type"))


@query("X-28", "SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 3 AND user_id IN (SELECT c_custkey FROM customer) AND count(value) = count(*)")
def sane_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    prog = table(spark, sf_dir, "events").groupBy("user_id").agg(F.least(F.count("*"), F.lit(3)).alias("n"), F.avg("value").alias("clean_score"))
    expected = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return I.sane_progress(prog, expected, "user_id").select("user_id")


@query("J-12", "SELECT item_id, CAST(k AS INT) AS copy_idx FROM benchmark, range(0, 4) t(k)")
def replicate_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.replicate(table(spark, sf_dir, "benchmark", "item_id"), 4)


@query("S-13", "SELECT count(*) AS n_rows, bit_xor(('0x' || substr(md5(c_custkey || '|' || c_name), 1, 15))::BIGINT) AS fingerprint FROM customer")
def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "c_custkey", "c_name")), 1, 15), 16, 10).cast("long")
    return table(spark, sf_dir, "customer").agg(F.count("*").alias("n_rows"), F.bit_xor(h).alias("fingerprint"))


@query("S-10", """WITH r AS (SELECT item_id, row_number() OVER (ORDER BY md5('review|' || item_id), item_id) AS n, md5(text) AS a, sha1(text) AS b FROM benchmark)
SELECT n, item_id, CASE WHEN n % 2 = 1 THEN a ELSE b END AS text_a, CASE WHEN n % 2 = 1 THEN b ELSE a END AS text_b, n % 2 = 0 AS swapped FROM r""")
def blind_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.packaging import blind_review as sheet

    rows = table(spark, sf_dir, "benchmark").select("item_id", F.md5("text").alias("a"), F.sha1("text").alias("b"))
    return sheet(rows, "item_id", "a", "b")


@query("S-11", """WITH t AS (SELECT doc_id, CASE WHEN n_chars < 200 THEN 'short' WHEN lang = 'de' THEN 'german' WHEN doc_id % 2 = 0 THEN 'even' END AS stratum FROM documents),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('spot|' || doc_id), doc_id) AS rn FROM t WHERE stratum IS NOT NULL) WHERE rn <= 12)
SELECT doc_id, stratum, CAST(row_number() OVER (ORDER BY md5('spot-sheet|' || doc_id), doc_id) AS INT) AS sheet_no FROM p""")
def spot_check_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.packaging import spot_check

    c = F.col
    return spot_check(table(spark, sf_dir, "documents", "doc_id", "n_chars", "lang"), "doc_id", {"short": c("n_chars") < 200, "german": c("lang") == "de", "even": c("doc_id") % 2 == 0}, 12, "spot").select("doc_id", "stratum", "sheet_no")


@query("A-8", f"WITH {C} SELECT flag, count(*) AS n_input, count(*) FILTER (qty >= 10) AS n_rule, count(*) FILTER (qty >= 10 AND pen <= 0.05) AS n_facts, count(*) FILTER (qty >= 10 AND pen <= 0.05 AND score > 20000) AS n_score FROM c GROUP BY flag")
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return A.funnel(candidates(spark, sf_dir), {"rule": c("qty") >= 10, "facts": c("pen") <= 0.05, "score": c("score") > 20000}, ["flag"])



"""Joins, aggregates, windows over levels, statistics and decisions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats, vectors
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import decisions as D
from ..operators import joins as J
from ..operators import statistics as S
from .base import C, candidates, long, query, r6, table

PAIR = "p AS (SELECT pk, max(CASE WHEN flag = 'A' THEN v END) AS base, max(CASE WHEN flag = 'R' THEN v END) AS cand FROM (SELECT pk, flag, max(qty) AS v FROM c WHERE flag IN ('A', 'R') GROUP BY pk, flag) GROUP BY pk HAVING count(DISTINCT flag) = 2)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over parts: the largest quantity by return flag."""
    runs = candidates(spark, sf_dir).filter(F.col("flag").isin("A", "R")).groupBy("pk", "flag").agg(F.max("qty").alias("v"))
    return J.paired(runs, ["pk"], "flag", "A", "R", "v")


@query("J-1 J-4 J-9 O-8", """WITH i AS (SELECT s_nationkey, max(s_suppkey) AS last_supp, min(s_suppkey) AS first_supp FROM supplier GROUP BY s_nationkey)
SELECT c_custkey, last_supp, first_supp FROM customer LEFT JOIN i ON c_nationkey = s_nationkey""")
def support_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("s_nationkey"))
    supp = table(spark, sf_dir, "supplier", "s_nationkey", "s_suppkey")
    last = J.lookup(cust, supp.withColumnRenamed("s_suppkey", "last_supp"), ["s_nationkey"], [F.col("last_supp")])
    return J.lookup(last, supp.withColumnRenamed("s_suppkey", "first_supp"), ["s_nationkey"], [F.col("first_supp")], last=False).select("c_custkey", "last_supp", "first_supp")


@query("J-2", "SELECT doc_id, toxic, labels.doc_id IS NULL AS no_pool FROM documents LEFT JOIN labels USING (doc_id)")
def support_or_no_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.with_support(table(spark, sf_dir, "documents", "doc_id"), table(spark, sf_dir, "labels", "doc_id", "toxic"), "doc_id", [F.col("toxic")])


@query("J-3", "SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id)")
def scored_inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.lookup(table(spark, sf_dir, "documents", "doc_id", "n_chars"), table(spark, sf_dir, "labels", "doc_id", "quality"), ["doc_id"], [F.col("quality")], how="inner")


@query("J-5 D-6", f"WITH {C}, {PAIR} SELECT count(*) FILTER (cand < base) AS improved, count(*) FILTER (cand > base) AS worsened, count(*) FILTER (cand = base) AS tied, count(*) FILTER (cand < base) - count(*) FILTER (cand > base) AS net FROM p")
def improved_worsened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.improved_worsened(_pairs(spark, sf_dir), "base", "candidate")


@query("J-5 X-10 X-11", f"WITH {C}, {PAIR} SELECT pk, base, cand AS candidate, cand - base AS delta FROM p")
def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).withColumn("delta", F.col("candidate") - F.col("base"))


@query("D-5", f"WITH {C}, {PAIR}, m AS (SELECT count(*) FILTER (base >= 40 AND cand < 40) AS base_only, count(*) FILTER (base < 40 AND cand >= 40) AS candidate_only FROM p) SELECT base_only, candidate_only, round(CASE WHEN base_only + candidate_only = 0 THEN 0.0 ELSE pow(abs(base_only - candidate_only) - 1, 2) / (base_only + candidate_only) END, 6) AS chi2 FROM m")
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.mcnemar_table(_pairs(spark, sf_dir), F.col("base") >= 40, F.col("candidate") >= 40)
    return out.withColumn("chi2", r6(F.col("chi2")))


@query("J-6", "SELECT a.item_id, length(a.text) - length(b.text) AS d FROM benchmark a JOIN benchmark b ON a.item_id = b.item_id + 1")
def zipped_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").withColumn("version", F.lit("v3"))
    z = J.zip_runs(b, b.withColumn("item_id", F.col("item_id") + 1), "item_id", "version")
    return z.select("item_id", long(F.length("text_a") - F.length("text_b")).alias("d"))


@query("J-7", f"WITH {C} SELECT pk FROM c WHERE flag IN ('A', 'N', 'R') GROUP BY pk HAVING count(DISTINCT flag) = 3")
def nway_stage_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.in_all(candidates(spark, sf_dir), ["pk"], "flag", ["A", "N", "R"])


def _rewritten(c: DataFrame) -> DataFrame:
    """Turns without up to 36 % of their characters, cut out of their middle."""
    share, n = F.col("conv_id") / 10 % 5 * 0.09, F.length("text")
    head = F.floor(n * (1 - share) / 2).cast("int")
    return c.withColumn("text", F.concat(F.substring("text", F.lit(1), head), F.substring(F.col("text"), F.floor(n * (1 + share) / 2).cast("int") + 1, n)))


@query("J-10")
def near_dup_vs_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of training conversations, and rewritten turns of the held-out ones, that are near a held-out turn."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    held = turns.filter("conv_id % 10 = 0")
    asked = turns.filter("conv_id % 10 <> 0").unionByName(_rewritten(held))
    return J.near_duplicates(asked, held.select(F.col("text").alias("held")), "text", "held").select("conv_id", "turn")


def _gram_sql(name: str, of: str, key: str) -> str:
    """Distinct 5-grams of the texts of a table, and how many each has."""
    return rf"""{name} AS (SELECT {key}, unnest(g) AS gram, len(g) AS m FROM (SELECT {key}, list_distinct(list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5))) AS g FROM (SELECT {key}, regexp_replace(text, '\s+', '', 'g') AS t FROM {of}) WHERE length(t) >= 5))"""


_HELD = "(SELECT conv_id * 100 + turn AS turn_id, text FROM conversations UNION ALL SELECT -1 - item_id, text[1 : length(text) // 2] FROM benchmark)"


@query("J-10 T-9", f"WITH {_gram_sql('a', 'benchmark', 'item_id')}, {_gram_sql('b', _HELD, 'turn_id')} SELECT item_id, turn_id, count(*) AS shared FROM a JOIN b USING (gram) GROUP BY item_id, turn_id, a.m, b.m HAVING count(*) >= 0.2 * least(a.m, b.m)")
def gram_containment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items against turns, and against the first halves of items."""
    b = table(spark, sf_dir, "benchmark", "item_id", "text")
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("turn_id"), "text")
    halves = b.select((-1 - F.col("item_id")).alias("turn_id"), F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int")).alias("text"))
    return J.gram_containment(b, turns.unionByName(halves), "item_id", "turn_id")


@query("J-10 T-9", f"WITH {_gram_sql('a', 'documents', 'doc_id')}, {_gram_sql('b', 'benchmark', 'item_id')} SELECT doc_id, item_id, count(*) AS shared FROM a JOIN b USING (gram) GROUP BY doc_id, item_id, a.m, b.m HAVING count(*) >= 0.2 * least(a.m, b.m)")
def gram_containment_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents against the benchmark."""
    return J.gram_containment(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), "doc_id", "item_id")


@query("X-5", f"WITH {C} SELECT pk, count(CASE WHEN qty > 3 THEN 1 END) AS n, coalesce(avg(CASE WHEN qty > 3 THEN qty END) >= 25, false) AND NOT bool_or(flag = 'R') AS semantic_clean FROM c GROUP BY pk")
def semantic_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean by the mean of its valid votes and by the lack of any structural trace."""
    c = candidates(spark, sf_dir).withColumn("v", F.when(F.col("qty") > 3, F.col("qty")))
    both = A.vote_aggregate(c, ["pk"], "v").join(c.groupBy("pk").agg(F.bool_or(F.col("flag") == "R").alias("traced")), "pk")
    return both.select("pk", "n", (F.coalesce(F.col("clean_score") >= 25, F.lit(False)) & (F.col("n") > 0) & ~F.col("traced")).alias("semantic_clean"))


@query("X-12", f"WITH {C}, v AS (SELECT pk, min(qty) / 50.0 AS low, avg(qty) / 50.0 AS mean FROM c GROUP BY pk), t AS (SELECT greatest(0.85, quantile_cont(low, 0.2)) AS t_pass FROM v) SELECT round(any_value(t_pass), 6) AS t_pass, count(*) AS n, count(*) FILTER (mean >= t_pass) AS n_pass FROM v, t")
def anchor_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors by the mean and the least of their votes; the threshold is the 20th percentile of the least, 0.85 at least."""
    v = candidates(spark, sf_dir).groupBy("pk").agg((F.min("qty") / 50.0).alias("low"), (F.avg("qty") / 50.0).alias("mean"))
    t = v.agg(F.greatest(F.lit(0.85), F.percentile("low", 0.2)).alias("t_pass"))
    return v.crossJoin(F.broadcast(t)).agg(r6(F.max("t_pass")).alias("t_pass"), F.count("*").alias("n"), F.count_if(F.col("mean") >= F.col("t_pass")).alias("n_pass"))  # one row


@query("A-1 A-2 A-3", f"WITH {C} SELECT pk, round(avg(CASE WHEN qty > 3 THEN qty END), 6) AS clean_score, round(coalesce(stddev_samp(CASE WHEN qty > 3 THEN qty END), 0), 6) AS sd, count(CASE WHEN qty > 3 THEN qty END) AS n FROM c GROUP BY pk")
def vote_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = candidates(spark, sf_dir).withColumn("v", F.when(F.col("qty") > 3, F.col("qty")))
    out = A.vote_aggregate(votes, ["pk"], "v")
    return out.select("pk", r6(F.col("clean_score")).alias("clean_score"), r6(F.col("sd")).alias("sd"), "n")


@query("A-6", f"""WITH {C}, b AS (SELECT pk, CAST(round_even(avg(ln % 4), 0) AS INT) AS label_rank, count(*) AS n_votes FROM c GROUP BY pk),
t AS (SELECT pk, unnest([flag, status, flag]) AS trace FROM c), k AS (SELECT pk, trace, count(*) AS n FROM t GROUP BY pk, trace)
SELECT pk, label_rank, n_votes, coalesce(string_agg(trace, ',' ORDER BY trace) FILTER (n >= greatest(1, n_votes // 2 + 1)), '') AS traces FROM b JOIN k USING (pk) GROUP BY pk, label_rank, n_votes""")
def judge_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = candidates(spark, sf_dir).select("pk", (F.col("ln") % 4).alias("r"), F.array("flag", "status", "flag").alias("tr"))
    return A.judge_ensemble(votes, "pk", "r", "tr")


_EVAL = """e AS (SELECT d.doc_id, CASE WHEN n_chars >= 50 THEN n_chars % 11 END AS clean_score, CASE WHEN n_chars >= 50 THEN 3 ELSE 0 END AS clean_n, n_chars % 3 = 0 AS rule_pass, CASE WHEN l.quality IS NULL THEN NULL ELSE l.quality = 1 END AS in_pool, l.toxic = 0 AS comp, d.n_chars >= 100 AS fmt FROM documents d LEFT JOIN labels l USING (doc_id))"""
_EVAL_COLS = """count(*) AS n, count(*) FILTER (clean_n > 0) AS n_valid, count(in_pool) AS n_pool, count(*) FILTER (in_pool IS NOT NULL AND comp) AS n_comparable, count(*) FILTER (NOT fmt) AS n_format_fail,
round(avg(clean_score), 6) AS clean_mean, round(count(*) FILTER (rule_pass) / greatest(1, count(*)), 6) AS rule_pass_rate, round(count(*) FILTER (in_pool) / greatest(1, count(in_pool)), 6) AS in_pool_rate, round(count(*) FILTER (in_pool AND comp) / greatest(1, count(*) FILTER (in_pool IS NOT NULL AND comp)), 6) AS in_pool_comparable_rate"""
_RATES = ("clean_mean", "rule_pass_rate", "in_pool_rate", "in_pool_comparable_rate")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows from documents and labels."""
    c = F.col
    d = J.with_support(table(spark, sf_dir, "documents", "doc_id", "n_chars"), table(spark, sf_dir, "labels"), "doc_id", [c("quality"), c("toxic")])
    valid = c("n_chars") >= 50
    return d.select("doc_id", F.when(valid, c("n_chars") % 11).alias("clean_score"), F.when(valid, 3).otherwise(0).alias("clean_n"), (c("n_chars") % 3 == 0).alias("rule_pass"), (c("quality") == 1).alias("in_pool"), (c("toxic") == 0).alias("answer_comparable"), (c("n_chars") >= 100).alias("format_ok"))


@query("A-4", f"WITH {_EVAL} SELECT {_EVAL_COLS} FROM e")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.eval_summary(_scores(spark, sf_dir)).withColumns({k: r6(F.col(k)) for k in _RATES})


@query("A-5", f"WITH {_EVAL} SELECT 'all' AS version, {_EVAL_COLS} FROM e UNION ALL SELECT 'format_ok', {_EVAL_COLS} FROM e WHERE fmt")
def eval_two_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.eval_two_versions(_scores(spark, sf_dir)).withColumns({k: r6(F.col(k)) for k in _RATES})


@query("A-9", "SELECT CAST(floor(least(l_discount * 100, 9.999) / 2) AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def binned_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.least(F.col("pen") * 100, F.lit(9.999))
    return candidates(spark, sf_dir).groupBy(stats.half_open_bin(x, [0, 2, 4, 6, 8, 10.0001]).alias("bin")).agg(F.count("*").alias("n"))


@query("A-10", "SELECT lang, toxic, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM documents JOIN labels USING (doc_id) GROUP BY lang, toxic")
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("lang", "toxic").agg(F.count("*").alias("n"), r6(F.avg("n_chars")).alias("mean_chars"))


@query("A-11", f"WITH {C} SELECT flag, count(*) FILTER (status = 'O') AS n_o, count(*) FILTER (status = 'F') AS n_f FROM c GROUP BY flag")
def trace_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).groupBy("flag").pivot("status", ["O", "F"]).agg(F.count(F.lit(1))).select("flag", F.coalesce("O", F.lit(0)).alias("n_o"), F.coalesce("F", F.lit(0)).alias("n_f"))


@query("A-12 A-13", f"WITH {C}, n AS (SELECT qid, count(*) AS n FROM c GROUP BY qid), k AS (SELECT qid, flag, count(*) AS m FROM c GROUP BY qid, flag) SELECT qid, string_agg(flag, ',' ORDER BY flag) AS all_words, coalesce(string_agg(flag, ',' ORDER BY flag) FILTER (m >= n // 2 + 1), '') AS majority FROM n JOIN k USING (qid) GROUP BY qid")
def majority_and_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.facts import majority

    sets = candidates(spark, sf_dir).groupBy("qid").agg(F.collect_list(F.array("flag")).alias("s"))  # K candidates a query
    return sets.select("qid", F.array_join(F.array_sort(F.array_distinct(F.flatten("s"))), ",").alias("all_words"), F.array_join(majority(F.col("s")), ",").alias("majority"))


@query("A-14", f"WITH {C}, e AS (SELECT qid, CASE WHEN qid % 2 = 0 THEN 'eval' ELSE 'train' END AS split, max(CAST(qty >= 45 AS INT)) AS a, sum(CAST(qty >= 45 AS INT)) AS s FROM c GROUP BY qid) SELECT coalesce(split, 'all') AS split, count(*) AS n, round(avg(a), 6) AS rescue_rate, round(avg(s), 6) AS mean_ok FROM e GROUP BY GROUPING SETS ((), (split))")
def rescue_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumn("split", F.when(F.col("qid") % 2 == 0, "eval").otherwise("train"))
    return A.any_of_k(c, ["qid"], F.col("qty") >= 45, "split").withColumns({k: r6(F.col(k)) for k in ("rescue_rate", "mean_ok")})


@query("A-15", f"WITH {C}, e AS (SELECT max(CAST(qty >= 40 AS INT)) AS a, max(CAST(qty <= 10 AS INT)) AS b FROM c GROUP BY qid) SELECT count(*) AS n, round(avg(a), 6) AS p_clean, round(avg(a * b), 6) AS p_both, CASE WHEN avg(a * b) >= 0.5 THEN 'GO' ELSE 'NO_GO' END AS decision FROM e")
def pool_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.pool_density(candidates(spark, sf_dir), ["qid"], F.col("qty") >= 40, F.col("qty") <= 10)
    return out.withColumns({k: r6(F.col(k)) for k in ("p_clean", "p_both")})


@query("A-16", f"WITH {C} SELECT count(*) AS n, round(avg(b - o_totalprice / 4), 4) AS headroom FROM (SELECT qid, max(score) AS b FROM c GROUP BY qid) JOIN orders ON o_orderkey = qid")
def best_of_k_headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"), (F.col("o_totalprice") / 4).alias("base"))
    return A.headroom(candidates(spark, sf_dir), base, "qid", "score", "base").withColumn("headroom", F.round("headroom", 4))


@query("A-17", f"""WITH {C}, v AS (SELECT pk, qty, row_number() OVER (PARTITION BY pk ORDER BY qid, ln, sk) - 1 AS k FROM c),
e AS (SELECT pk, coalesce(stddev_samp(qty), 0) AS sd, max(CASE WHEN k = 0 THEN qty END) AS a, max(CASE WHEN k = 1 THEN qty END) AS b FROM v GROUP BY pk)
SELECT count(*) AS n, count(b) AS n_two, round(avg(sd), 6) AS within_sd, round(corr(a, b), 6) AS retest_r, round(avg(abs(a - b)), 6) AS mean_abs, round(avg(CASE WHEN b IS NOT NULL THEN CAST((a >= 25) <> (b >= 25) AS INT) END), 6) AS flip_rate FROM e""")
def judge_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("pk").orderBy("qid", "ln", "sk")
    votes = candidates(spark, sf_dir).select("pk", "qty", (F.row_number().over(w) - 1).alias("vote"))
    out = S.judge_noise(votes, "pk", "vote", "qty", F.col("qty") >= 25)
    return out.withColumns({k: r6(F.col(k)) for k in ("within_sd", "retest_r", "mean_abs", "flip_rate")})


LEVELS = "lv AS (SELECT p_size // 9 AS level, count(*) AS n, avg(l_quantity) AS mean, coalesce(stddev_samp(l_quantity), 0) AS sd, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)"


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six levels with different means, as a calibration has them."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), F.floor(F.col("p_size") / 9).cast("int").alias("level"))
    return A.resolution_curve(candidates(spark, sf_dir).join(p, "pk"), "level", "qty")


@query("A-18", f"WITH {LEVELS} SELECT level, n, round(mean, 6) AS mean, round(sd, 6) AS sd, low, high FROM lv")
def resolution_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).withColumns({"mean": r6(F.col("mean")), "sd": r6(F.col("sd"))})


@query("A-19", f"WITH {C}, e AS (SELECT avg(qty) AS m, var_pop(qty) AS v FROM c GROUP BY pk) SELECT count(*) AS n, round(avg(v), 6) AS within, round(greatest(0, var_pop(m) - avg(v) / 16), 6) AS between, round(sqrt(avg(v)), 6) AS pooled_rms FROM e")
def variance_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.variance_components(candidates(spark, sf_dir), "pk", "qty").withColumns({k: r6(F.col(k)) for k in ("within", "between", "pooled_rms")})


@query("A-20", f"WITH {C}, {PAIR} SELECT round(count(*) FILTER (base <> cand) / greatest(1, count(*)), 6) AS non_tie_rate, round(count(*) FILTER (base < cand) / greatest(1, count(*) FILTER (base <> cand)), 6) AS short_win_rate, CASE WHEN count(*) FILTER (base <> cand) / greatest(1, count(*)) <= 0.2 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM p")
def pairwise_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    differ, n = F.count_if(F.col("base") != F.col("candidate")), F.count("*")
    rate = stats.safe_ratio(differ, n)
    return _pairs(spark, sf_dir).agg(r6(rate).alias("non_tie_rate"), r6(stats.safe_ratio(F.count_if(F.col("base") < F.col("candidate")), differ)).alias("short_win_rate"), F.when(rate <= 0.2, "PASS").otherwise("FAIL").alias("verdict"))


@query("A-21", "SELECT event_type AS tag, count(*) AS calls, sum(user_id)::BIGINT AS tokens_in, sum(event_id)::BIGINT AS tokens_out, round(sum(user_id) / 1e6 * 6.5 + sum(event_id) / 1e6 * 27, 6) AS cost FROM events GROUP BY event_type")
def cost_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("tag"), "user_id", "event_id")
    return A.cost_meter(e, "tag", "user_id", "event_id").withColumn("cost", r6(F.col("cost")))


@query("A-22 T-30", r"""WITH s AS (SELECT source, doc_id, unnest(string_split_regex(text, '[。！？!?\n;；]+')) AS s FROM documents), b AS (SELECT doc_id % 2 AS side, substr(regexp_replace(regexp_replace(s, '^\s+', ''), '^[\s0-9一二三四五六七八九十、.．)）(（]+', ''), 1, 2) AS bigram FROM s),
k AS (SELECT * FROM b WHERE bigram <> ''), n AS (SELECT bigram, count(*) AS n_new, count(*) / (SELECT count(*) FROM k WHERE side = 1) AS x FROM k WHERE side = 1 GROUP BY bigram ORDER BY n_new DESC, bigram LIMIT 6),
o AS (SELECT bigram, count(*) AS n_old, count(*) / (SELECT count(*) FROM k WHERE side = 0) AS y FROM k WHERE side = 0 GROUP BY bigram)
SELECT bigram, n_new, coalesce(n_old, 0) AS n_old, round(x - coalesce(y, 0), 6) AS shift FROM n LEFT JOIN o USING (bigram)""")
def phrase_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    sents = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.sentences("text")).alias("s"))
    b = sents.select((F.col("doc_id") % 2).alias("side"), X.start_bigram(F.col("s")).alias("bigram")).filter("bigram <> ''")
    return A.phrase_shift(b.filter("side = 0"), b.filter("side = 1"), "bigram").withColumn("shift", r6(F.col("shift")))


@query("A-23 W-18 D-27", "WITH m AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS stage, count(*) AS n FROM events GROUP BY 1) SELECT stage, n, n - lag(n) OVER (ORDER BY stage) AS delta, n - first_value(n) OVER (ORDER BY stage) AS since_first FROM m")
def stage_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").groupBy(F.trunc("ts", "week").alias("stage")).agg(F.count("*").alias("n"))
    w = Window.orderBy("stage")  # stages are few
    return m.select("stage", "n", (F.col("n") - F.lag("n").over(w)).alias("delta"), (F.col("n") - F.first("n").over(w)).alias("since_first"))


@query("A-24", "SELECT count(DISTINCT l_orderkey) AS n_queries, count(DISTINCT l_partkey) AS n_parts, count(*) AS n FROM lineitem")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).agg(F.count_distinct("qid").alias("n_queries"), F.count_distinct("pk").alias("n_parts"), F.count("*").alias("n"))


@query("W-15", "WITH v AS (SELECT doc_id, n_chars FROM documents) SELECT doc_id, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE AS avg_rank FROM v")
def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ranking import average_rank

    return average_rank(table(spark, sf_dir, "documents", "doc_id", "n_chars"), "n_chars", "avg_rank").select("doc_id", "avg_rank")


_GAPS = f"WITH {LEVELS}, g AS (SELECT level, mean - lead(mean) OVER w AS gap, sd + lead(sd) OVER w AS band FROM lv WINDOW w AS (ORDER BY level)), s AS (SELECT level, gap, abs(gap) >= 1 AND abs(gap) > band AS separable FROM g WHERE gap IS NOT NULL)"


@query("W-16", _GAPS + " SELECT level, round(gap, 6) AS gap, separable FROM s")
def adjacent_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.adjacent_gaps(_levels(spark, sf_dir), "level", "mean", "sd").select("level", r6(F.col("gap")).alias("gap"), "separable")


@query("W-17", _GAPS + ", i AS (SELECT *, sum(CAST(separable AS INT)) OVER (ORDER BY level) AS island FROM s) SELECT min(level) AS first_level, count(*) AS n_gaps FROM i WHERE NOT separable GROUP BY island")
def flat_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = S.adjacent_gaps(_levels(spark, sf_dir), "level", "mean", "sd")
    return S.flat_runs(gaps, "level").select("first_level", "n_gaps")


@query("D-1 D-17", f"WITH {C} SELECT coalesce(flag, 'all') AS grp, count(*) AS n, round(corr(qty, score), 6) AS r FROM c GROUP BY GROUPING SETS ((), (flag))")
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pearson_sets(candidates(spark, sf_dir), "qty", "score", "flag").withColumn("r", r6(F.col("r")))


@query("D-2", """WITH v AS (SELECT n_chars AS x, quality AS y FROM documents JOIN labels USING (doc_id)), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS b FROM v)
SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return S.spearman(d, "n_chars", "quality").withColumn("rho", r6(F.col("rho")))


@query("D-3", """WITH v AS (SELECT n_chars AS x, toxic AS y FROM documents JOIN labels USING (doc_id)), r AS (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS a FROM v)
SELECT sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg, round((sum(a * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc FROM r""")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return S.auc(d, "n_chars", F.col("toxic") == 1).withColumn("auc", r6(F.col("auc")))


def _resampled(rows: str, key: str, value: str, b: int) -> str:
    """Tables up to `ci`: the interval of the mean of `rows` from b resamples."""
    above = " + ".join(f"(u >= {x} * exp(-1))::INT" for x in ("1", "2", "2.5", "(8 / 3::DOUBLE)", "(65 / 24::DOUBLE)", "(163 / 60::DOUBLE)"))
    lo, hi = int(0.025 * (b - 1)), int(0.975 * (b - 1))
    return f"""rh AS (SELECT {value} AS v, ('0x' || substr(md5('13|' || {key}), 1, 8))::BIGINT AS x, ('0x' || substr(md5('13|' || {key}), 9, 8))::BIGINT AS y FROM {rows} WHERE {value} IS NOT NULL),
ru AS (SELECT i, v, (x + i * y) % {S.PRIME} / {S.PRIME}::DOUBLE AS u FROM rh, range(0, {b}) t(i)), rw AS (SELECT i, v, {above} AS w FROM ru),
rm AS (SELECT i, sum(w * v) / nullif(sum(w), 0) AS m FROM rw GROUP BY i), rp AS (SELECT m, row_number() OVER (ORDER BY m NULLS FIRST) - 1 AS p FROM rm),
ci AS (SELECT max(m) FILTER (p = {lo}) AS low, max(m) FILTER (p = {hi}) AS high FROM rp)"""


@query("D-4", f"WITH {_resampled('labels', 'doc_id', 'quality', 500)} SELECT round(low, 6) AS low, round(high, 6) AS high FROM ci")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    ci = S.bootstrap_ci(table(spark, sf_dir, "labels"), "quality", "doc_id", b=500)
    return ci.select(r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"))


@query("X-11", f"""WITH {C}, m AS (SELECT pk, flag, avg(qty) AS q, avg(pen) AS p, avg(tax) AS t FROM c WHERE flag IN ('A', 'R') GROUP BY pk, flag),
d AS (SELECT pk, coalesce(r.q - a.q, 0) AS goal, coalesce(r.p - a.p, 0) AS grounded, coalesce(r.t - a.t, 0) AS accuracy FROM m a JOIN m r USING (pk) WHERE a.flag = 'A' AND r.flag = 'R'),
{_resampled('d', 'pk', 'goal', 200)}, n AS (SELECT count(*) AS n, avg(goal) AS delta, avg(grounded) AS grounded, avg(accuracy) AS accuracy FROM d)
SELECT n, round(delta, 6) AS delta, round(low, 6) AS low, round(high, 6) AS high, round(grounded, 6) AS grounded, round(accuracy, 6) AS accuracy, low > 0 AND grounded >= -0.01 AND accuracy >= -0.01 AS go FROM n, ci""")
def paired_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over parts, by return flag: quantity is what should rise, discount and tax are the guards."""
    runs = candidates(spark, sf_dir).groupBy("pk").pivot("flag", ["A", "R"]).agg(F.avg("qty").alias("q"), F.avg("pen").alias("p"), F.avg("tax").alias("t"))
    delta = lambda v: F.col(f"R_{v}") - F.col(f"A_{v}")
    out = S.paired_readout(runs.filter("A_q is not null and R_q is not null"), "pk", delta("q"), {"grounded": delta("p"), "accuracy": delta("t")}, b=200)
    return out.select("n", *[r6(F.col(c)).alias(c) for c in ("delta", "low", "high", "grounded", "accuracy")], "go")


@query("D-10 D-11", "SELECT CAST(n AS INT) AS n, CAST(k AS INT) AS k, round(sqrt(1.02 * 1.02 + 0.74 * 0.74 / k) / sqrt(n), 6) AS se FROM (VALUES (100), (500), (2000)) a(n), (VALUES (1), (2), (3), (16)) b(k)")
def se_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.createDataFrame([(x,) for x in (100, 500, 2000)], "n int")
    grid = n.withColumn("k", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 16)])))
    return grid.withColumn("se", r6(stats.eval_se(F.col("n"), F.col("k"))))


@query("D-12", f"WITH {LEVELS} SELECT a.level AS level_a, b.level AS level_b, round(CASE WHEN a.sd + b.sd <= 1e-9 THEN 99.0 ELSE abs(a.mean - b.mean) / (a.sd + b.sd) END, 6) AS separation FROM lv a JOIN lv b ON a.level < b.level")
def separability_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.separability(_levels(spark, sf_dir), "level", "mean", "sd").withColumn("separation", r6(F.col("separation")))


@query("X-24", f"WITH {LEVELS}, d AS (SELECT a.level AS level_a, b.level AS level_b, abs(a.mean - b.mean) / sqrt((a.sd * a.sd + b.sd * b.sd) / 2) AS distance FROM lv a JOIN lv b ON b.level = a.level + 1) SELECT level_a, level_b, round(distance, 6) AS distance, CASE WHEN distance >= 3 THEN 'separable' WHEN distance >= 2 THEN 'weak' ELSE 'not_separable' END AS verdict FROM d")
def pooled_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pooled_distance(_levels(spark, sf_dir), "level", "mean", "sd").withColumn("distance", r6(F.col("distance")))


@query("D-9 O-3", f"""WITH {C}, v AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ln, pk, sk) - 1 AS k FROM c),
a AS (SELECT qid, avg(qty) FILTER (k < 2) AS x2, avg(pen * 500) FILTER (k < 2) AS y2, avg(qty) FILTER (k < 16) AS x16, avg(pen * 500) FILTER (k < 16) AS y16 FROM v GROUP BY qid)
SELECT count(*) AS n, count(*) FILTER (x2 > y2) AS n_screened, count(*) FILTER (x2 > y2 AND x16 > y16) AS n_confirmed FROM a""")
def two_phase_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("ln", "pk", "sk")
    v = candidates(spark, sf_dir).withColumn("k", F.row_number().over(w) - 1).withColumn("y", F.col("pen") * 500)
    first = lambda c, k: F.avg(F.when(F.col("k") < k, F.col(c)))
    a = v.groupBy("qid").agg(first("qty", 2).alias("x2"), first("y", 2).alias("y2"), first("qty", 16).alias("x16"), first("y", 16).alias("y16"))
    screened = F.col("x2") > F.col("y2")
    return a.agg(F.count("*").alias("n"), F.count_if(screened).alias("n_screened"), F.count_if(screened & (F.col("x16") > F.col("y16"))).alias("n_confirmed"))


@query("D-13 D-28", "SELECT min(k) AS chosen_k FROM (VALUES (1), (2), (4), (8), (16)) t(k), (SELECT avg(s) AS sigma FROM (SELECT stddev_samp(l_discount) * 100 AS s FROM lineitem GROUP BY l_partkey)) WHERE sigma / sqrt(k) < 1")
def recommended_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    sigma = candidates(spark, sf_dir).groupBy("pk").agg((F.stddev_samp("pen") * 100).alias("s")).agg(F.avg("s").alias("sigma"))
    grid = sigma.withColumn("k", F.explode(F.array(*[F.lit(k) for k in (1, 2, 4, 8, 16)])))
    return D.escalation(grid, "k", F.col("sigma") / F.sqrt("k") < 1)


@query("D-14", "SELECT l_partkey AS pk FROM lineitem GROUP BY l_partkey HAVING abs(avg(l_quantity) - 25) > 6")
def outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).groupBy("pk").agg(F.avg("qty").alias("m")).filter(F.abs(F.col("m") - 25) > 6).select("pk")


@query("D-16", "SELECT t, u, round(count(*) FILTER ((n_chars >= t AND length(lang) + u > 3) = (quality = 1)) / count(*), 6) AS accuracy FROM documents JOIN labels USING (doc_id), (VALUES (50), (200), (800)) a(t), (VALUES (0), (2)) b(u) GROUP BY t, u")
def grid_search_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "n_chars", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    grid = spark.createDataFrame([(t, u) for t in (50, 200, 800) for u in (0, 2)], "t int, u int")
    hit = (F.col("n_chars") >= F.col("t")) & (F.length("lang") + F.col("u") > 3)
    return S.grid_search(d, grid, hit, F.col("quality") == 1).withColumn("accuracy", r6(F.col("accuracy")))


@query("D-18", "SELECT round(count(*) FILTER (p AND a) / count(*) FILTER (a), 6) AS recall_pos, round(count(*) FILTER (NOT p AND NOT a) / count(*) FILTER (NOT a), 6) AS recall_neg, round((count(*) FILTER (p AND a) / count(*) FILTER (a) + count(*) FILTER (NOT p AND NOT a) / count(*) FILTER (NOT a)) / 2, 6) AS balanced_accuracy FROM (SELECT n_chars >= 300 AS p, quality = 1 AS a FROM documents JOIN labels USING (doc_id))")
def balanced_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    out = S.balanced_accuracy(d, F.col("n_chars") >= 300, F.col("quality") == 1)
    return out.select(*[r6(F.col(c)).alias(c) for c in out.columns])


_TWO = "WITH a AS (SELECT avg(l_quantity) / 5 AS m, count(*) AS n FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT avg(l_quantity) / 5 AS p FROM lineitem WHERE l_returnflag = 'R')"


@query("D-19 O-11", _TWO + f" SELECT round(p - m, 6) AS drop, m < 4 OR (p - m > 0.05 AND p - m > 3 * sqrt(1.02 * 1.02 + 0.74 * 0.74 / 3) / sqrt(n) * {math.sqrt(2)}) AS prune, CASE WHEN m < 4 THEN 'below_floor' WHEN p - m > 0.05 AND p - m > 3 * sqrt(1.02 * 1.02 + 0.74 * 0.74 / 3) / sqrt(n) * {math.sqrt(2)} THEN 'worse_than_parent' ELSE 'keep' END AS reason FROM a, b")
def prune_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    part = lambda f: c.filter(F.col("flag") == f).agg((F.avg("qty") / 5).alias("clean_mean"), F.count("*").alias("n"))
    return D.prune(part("A"), part("R"), 4.0, 0.05).withColumn("drop", r6(F.col("drop")))


_SIDES = "WITH a AS (SELECT l_partkey % 7 AS stage, avg(CASE WHEN l_returnflag = 'A' THEN l_quantity END) / 5 AS m, avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END) / 5 AS p, avg(CASE WHEN l_tax <= 0.04 THEN 1.0 ELSE 0.0 END) AS x, avg(CASE WHEN l_discount <= 0.06 THEN 1.0 ELSE 0.0 END) AS y FROM lineitem GROUP BY l_partkey % 7)"


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumn("stage", F.col("pk") % 7)
    side = lambda f: F.avg(F.when(F.col("flag") == f, F.col("qty"))) / 5
    share = lambda ok: F.avg(ok.cast("int"))
    return c.groupBy("stage").agg(side("A").alias("m"), side("R").alias("p"), share(F.col("tax") <= 0.04).alias("x"), share(F.col("pen") <= 0.06).alias("y"))


@query("D-22", _SIDES + " SELECT stage, round(m - p, 6) AS gain, m - p >= 0.04 AS goodhart FROM a")
def goodhart_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    gain = F.col("m") - F.col("p")
    return _sides(spark, sf_dir).select("stage", r6(gain).alias("gain"), D.goodhart(gain).alias("goodhart"))


@query("D-23", _SIDES + " SELECT stage, CASE WHEN m - p >= 0.05 AND x - y >= -0.01 THEN 'GO' ELSE 'NO_GO' END AS verdict FROM a")
def rewrite_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sides(spark, sf_dir).select("stage", D.rewrite_ceiling(F.col("m") - F.col("p"), F.col("x") - F.col("y")).alias("verdict"))


@query("D-24", _SIDES + " SELECT stage, CASE WHEN x >= 0.60 THEN 'SELF_SAMPLING' WHEN x >= 0.45 OR y >= 0.60 THEN 'MIXED' ELSE 'REWRITE_OR_STOP' END AS verdict FROM a")
def headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sides(spark, sf_dir).select("stage", D.headroom_verdict(F.col("x"), F.col("y")).alias("verdict"))


@query("D-20 D-21", _TWO + " SELECT CASE WHEN m - p > 3 * sqrt(1.02 * 1.02 + 0.74 * 0.74 / 3) / sqrt(n) THEN 'TRUE_GAIN' WHEN m - p < -3 * sqrt(1.02 * 1.02 + 0.74 * 0.74 / 3) / sqrt(n) THEN 'REGRESSION' ELSE 'NEUTRAL' END AS verdict, m - p > 0 AS go FROM a, b")
def stage_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    part = lambda f, m: c.filter(F.col("flag") == f).agg((F.avg("qty") / 5).alias(m), F.count("*").alias(f"n_{m}"))
    both = part("A", "m").crossJoin(part("R", "p"))  # one row each
    delta = F.col("m") - F.col("p")
    return both.select(D.stage_verdict(delta, F.col("n_m")).alias("verdict"), D.paired_go(delta, F.lit(0.0), F.lit(0.0)).alias("go"))


@query("D-25", f"WITH {C}, {PAIR} SELECT count(*) AS n, count(*) FILTER (sign(base - 30) = sign(cand - 30)) AS kept, CASE WHEN count(*) FILTER (sign(base - 30) = sign(cand - 30)) >= count(*) * 0.7 THEN 'STABLE' ELSE 'UNSTABLE' END AS verdict FROM p")
def kept_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.kept_direction(_pairs(spark, sf_dir), F.col("base") - 30, F.col("candidate") - 30)


@query("D-26 X-19", f"WITH {C}, {PAIR} SELECT count(*) AS n, round(count(*) FILTER (cand > base) / count(*), 6) AS win_rate, round(count(*) FILTER (cand - base >= 10) / count(*), 6) AS strong_rate, round(count(*) FILTER (cand < base) / count(*), 6) AS loss_rate FROM p")
def pair_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.pair_audit(_pairs(spark, sf_dir), F.col("candidate") - F.col("base"), 10)
    return out.select("n", *[r6(F.col(c)).alias(c) for c in ("win_rate", "strong_rate", "loss_rate")])


@query("X-3", "SELECT count(*) AS n_in, count(*) FILTER (l_discount > 0.08) AS n_killed, CAST(l_quantity AS INT) % 4 AS burden FROM lineitem GROUP BY burden")
def gate_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    return c.groupBy((F.col("qty").cast("int") % 4).alias("burden")).agg(F.count("*").alias("n_in"), F.count_if(F.col("pen") > 0.08).alias("n_killed"))


@query("X-4", f"WITH {C}, v AS (SELECT qid, avg(qty) AS m, bool_or(flag = 'R') AS t FROM c GROUP BY qid) SELECT CASE WHEN qid % 2 = 0 THEN 'eval' ELSE 'train' END AS split, count(*) AS n, count(*) FILTER (m < 20 OR t) AS n_problem FROM v GROUP BY 1")
def problem_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = candidates(spark, sf_dir).groupBy("qid").agg(F.avg("qty").alias("m"), F.bool_or(F.col("flag") == "R").alias("t"))
    low = F.coalesce(F.col("m") < 20, F.lit(False)) | F.col("t")  # an unknown mean is not low
    return v.groupBy(F.when(F.col("qid") % 2 == 0, "eval").otherwise("train").alias("split")).agg(F.count("*").alias("n"), F.count_if(low).alias("n_problem"))


@query("X-7", "WITH a AS (SELECT l_returnflag AS flag, avg(CAST(l_quantity >= 40 AS INT)) AS x FROM lineitem GROUP BY 1), b AS (SELECT l_returnflag AS flag, avg(CAST(l_discount <= 0.02 AS INT)) AS y FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) SELECT flag, coalesce(CAST(CAST(round((x - y) * 1000) AS BIGINT) AS VARCHAR), 'n/a') AS gap_permille FROM a LEFT JOIN b USING (flag)")
def two_rulers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    a = c.groupBy("flag").agg(F.avg((F.col("qty") >= 40).cast("int")).alias("x"))
    b = c.filter("flag <> 'N'").groupBy("flag").agg(F.avg((F.col("pen") <= 0.02).cast("int")).alias("y"))
    return a.join(b, "flag", "left").select("flag", F.coalesce(F.round((F.col("x") - F.col("y")) * 1000).cast("long").cast("string"), F.lit("n/a")).alias("gap_permille"))


@query("X-20", f"WITH {C}, a AS (SELECT flag AS arm, avg(qty) / 5 AS m, avg(CAST(pen <= 0.05 AS INT)) AS r FROM c GROUP BY flag) SELECT arm, round(m, 6) AS clean_mean, round(r, 6) AS rule_rate, rank() OVER (ORDER BY m DESC, arm) = 1 AS best FROM a")
def arm_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = candidates(spark, sf_dir).groupBy(F.col("flag").alias("arm")).agg((F.avg("qty") / 5).alias("m"), F.avg((F.col("pen") <= 0.05).cast("int")).alias("r"))
    best = F.rank().over(Window.orderBy(F.desc("m"), "arm")) == 1  # arms are few
    return a.select("arm", r6(F.col("m")).alias("clean_mean"), r6(F.col("r")).alias("rule_rate"), best.alias("best"))


@query("X-15 X-16", "SELECT count(*) AS n, count(toxic) AS n_scored, round(avg(toxic), 6) AS mean_known, round(avg(coalesce(toxic, 0)), 6) AS mean_zeros FROM documents LEFT JOIN labels USING (doc_id)")
def failure_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.agg(F.count("*").alias("n"), F.count("toxic").alias("n_scored"), r6(stats.mean0(F.col("toxic"))).alias("mean_known"), r6(F.avg(F.coalesce("toxic", F.lit(0)))).alias("mean_zeros"))


@query("I-5", "SELECT stage, CASE WHEN n IS NULL THEN 'missing' WHEN n < 100 THEN 'incomplete' ELSE 'complete' END AS state FROM (VALUES ('en'), ('de'), ('zh')) s(stage) LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) ON lang = stage")
def stage_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.incremental import stage_manifest as manifest

    stages = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("stage")).agg(F.count("*").alias("n_rows"))
    return manifest(stages, spark.createDataFrame([("en", 100), ("de", 100), ("zh", 100)], "stage string, n_expected int"))


@query("§2.10", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT q.vec_id, round(max(list_dot_product(q.v, r.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(r.v, r.v))), 6) AS best FROM e q JOIN e r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id""")
def cosine_max_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector against all others."""
    best = vectors.best_cosine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, "vec_id", "embedding")
    return best.withColumn("best", r6(F.col("best")))

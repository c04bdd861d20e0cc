"""Spans, support, repairs, controls, agreement, files: operators that guard a run or tell what went into it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import facts, rules, vectors
from ..functions import patterns as P
from ..functions.registry import register_sql
from ..operators import aggregates as A
from ..operators import decisions as D
from ..operators import joins as J
from ..operators import rows as R
from ..operators import selection as W
from ..operators import statistics as S
from ..operators.incremental import stale_schema, warm_up
from ..sources import packaging, tables
from ..sources.shared import shared_path
from .base import C, candidates, long, query, r6, table
from .gates import MEASURED, _measured

# --- spans


def _placed_sql(name: str, kind: str, pattern: str, flags: str) -> str:
    """Matches of a pattern with their offsets, from the matches and the pieces between them."""
    p = f"(?{flags}){pattern}" if flags else pattern
    return f"""{name} AS (SELECT doc_id, '{kind}' AS kind, unnest(list_transform(range(1, len(f) + 1), lambda i: {{'s': coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0), 'm': f[i]}})) AS x
  FROM (SELECT doc_id, regexp_extract_all(text, '{p}', 0) AS f, string_split_regex(text, '{p}') AS p FROM documents))"""


_EACH = [(k, p, "i" if k in P.RAG_STYLE_ANY_CASE else "") for k, ps in P.RAG_STYLE_LATIN.items() for p in ps]


@query("G-1 (spans) §2.12", "WITH " + ", ".join(_placed_sql(f"p{i}", *e) for i, e in enumerate(_EACH)) + ", a AS (SELECT DISTINCT doc_id, kind, CAST(x.s AS INT) AS begin, CAST(x.s + length(x.m) AS INT) AS \"end\", md5(x.m) AS text FROM (" + " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(len(_EACH))) + """))
SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.doc_id = a.doc_id AND b.kind = a.kind AND b.begin <= a.begin AND a."end" <= b."end" AND b."end" - b.begin > a."end" - a.begin)""")
def rag_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of marks by a lateral join in SQL."""
    register_sql(spark, P.RAG_STYLE_LATIN)
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return spark.sql("SELECT doc_id, kind, begin, end, md5(s.text) AS text FROM {docs} d, LATERAL rag_spans(d.text) s", docs=docs)


# --- support

_W, _FLIP = P.POLARITY_WIDE, [*P.OPPOSITE, *[(b, a) for a, b in P.OPPOSITE]]
_LIST = "[" + ", ".join(f"'{w}'" for w in _W) + "]"
#: An answer for each order line: one or two conclusions, or none, and a number.
_ANSWER = f"CASE WHEN l_partkey % 5 = 0 THEN '' WHEN l_partkey % 3 = 0 THEN {_LIST}[1 + l_partkey % {len(_W)}] || '，' || {_LIST}[1 + l_suppkey % 3] ELSE {_LIST}[1 + l_suppkey % 3] END || CAST(CAST(l_quantity AS INT) % 7 + 8 AS VARCHAR) || '%'"
_ANSWERS = f"a AS (SELECT l_orderkey AS qid, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, {_ANSWER} AS t, CAST(l_quantity AS INT) % 7 + 8 AS q FROM lineitem), x AS (SELECT *, list_filter({_LIST}, lambda w: contains(t, w)) AS c, CASE WHEN q > 9 THEN [q || '', q || '%'] ELSE [q || '%'] END AS v FROM a)"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, c = F.array(*[F.lit(w) for w in _W]), F.col
    word = lambda i: F.get(words, i)
    said = F.when(c("pk") % 5 == 0, "").when(c("pk") % 3 == 0, F.concat(word((c("pk") % len(_W)).cast("int")), F.lit("，"), word((c("sk") % 3).cast("int")))).otherwise(word((c("sk") % 3).cast("int")))
    return candidates(spark, sf_dir).select("qid", "ln", "pk", "sk", F.concat(said, (c("qty").cast("int") % 7 + 8).cast("string"), F.lit("%")).alias("t"))


@query("G-3 X-23", f"""WITH {_ANSWERS}, s AS (SELECT qid, count(*) AS n, list(c) AS cs, flatten(list(v)) AS u FROM x WHERE ln <= 3 GROUP BY qid),
m AS (SELECT *, list_filter({_LIST}, lambda w: len(list_filter(cs, lambda z: list_contains(z, w))) >= n // 2 + 1) AS maj FROM s),
j AS (SELECT x.*, len(list_filter([{', '.join(f"['{a}', '{b}']" for a, b in _FLIP)}], lambda p: list_contains(c, p[1]) AND list_contains(maj, p[2]))) > 0 AS contradict,
  len(list_filter(cs, lambda z: len(list_filter(c, lambda w: NOT list_contains(z, w))) = 0)) > 0 AS covered, len(list_filter(v, lambda y: NOT list_contains(u, y))) = 0 AS value_ok FROM x JOIN m USING (qid) WHERE ln > 3)
SELECT qid, ln, pk, sk, CASE WHEN len(c) > 0 THEN covered AND NOT contradict ELSE value_ok END AS in_support,
  CASE WHEN len(c) = 0 THEN CASE WHEN value_ok THEN 'ok' ELSE 'introduced_new_number' END WHEN contradict THEN 'contradict_majority' WHEN covered THEN 'ok' ELSE 'concl_not_covered' END AS reason, contradict, value_ok FROM j""")
def support_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of an order's later lines against those of its first three."""
    a = _answers(spark, sf_dir)
    known = a.filter("ln <= 3").groupBy("qid").agg(facts.support(F.collect_list("t")).alias("known"))  # three samples a query
    j = a.filter("ln > 3").join(known, "qid").withColumn("r", facts.answer_in_support(F.col("t"), F.col("known")))
    return j.select("qid", "ln", "pk", "sk", "r.in_support", "r.reason", "r.contradict", "r.value_ok")


@query("X-21", f"""WITH {_ANSWERS}, g AS (SELECT qid, pk AS gold_pk, list_concat(c, v) AS gold FROM x QUALIFY row_number() OVER (PARTITION BY qid ORDER BY ln, pk, sk) = 1)
SELECT qid, ln, pk, sk, round(len(list_filter(gold, lambda w: list_contains(list_concat(c, v), w))) / len(gold), 6) AS recall FROM x JOIN g USING (qid)""")
def fact_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the numbers and conclusions of an order's first answer each of its answers has."""
    a = _answers(spark, sf_dir)
    first = a.groupBy("qid").agg(F.min_by("t", F.struct("ln", "pk", "sk")).alias("gold"))
    return a.join(first, "qid").select("qid", "ln", "pk", "sk", r6(facts.recall(facts.wide_facts("gold"), facts.wide_facts("t"))).alias("recall"))


@query("G-20", """WITH p AS (SELECT conv_id, turn, role, list_filter(['the ', 'of ', 'and '], lambda w: contains(text, w)) AS pol FROM conversations), k AS (SELECT conv_id, flatten(list(pol)) AS pool FROM p WHERE role = 'user' AND turn < 2 GROUP BY conv_id)
SELECT p.conv_id, turn, len(pool) = 0 OR len(list_filter(pol, lambda w: NOT list_contains(pool, w))) = 0 AS fits FROM p JOIN k USING (conv_id) WHERE role = 'assistant'""")
def polarity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies against the conclusions of a conversation's first question; questions without any let all pass."""
    sets = {"polarity": ["the ", "of ", "and "], "dates": "(?!)", "values": ["(?!)"]}
    c = table(spark, sf_dir, "conversations")
    pool = c.filter("role = 'user' AND turn < 2").groupBy("conv_id").agg(F.collect_list("text").alias("t"))  # two turns
    pool = pool.select("conv_id", facts.pool_facts(F.col("t"), **sets).alias("pool"))
    return c.filter("role = 'assistant'").join(pool, "conv_id").select("conv_id", "turn", facts.polarity_fits(F.col("text"), F.col("pool"), **sets).alias("fits"))


# --- repairs, traces, residuals

_N = r"list_sort(list_distinct(list_concat(list_transform(regexp_extract_all({x}, '[0-9]+(?:\.[0-9]+)?%?'), lambda y: y), list_filter(list_transform(regexp_extract_all({x}, '[0-9][0-9,]*(?:\.[0-9]+)?'), lambda y: replace(y, ',', '')), lambda y: length(regexp_replace(y, '[^0-9]', '', 'g')) >= 2))))"


@query("G-30", f"""WITH d AS (SELECT doc_id, text, substr(text, 1, length(text) * (4 + doc_id % 7) // 10) AS repaired FROM documents)
SELECT doc_id, {_N.format(x='text')} = {_N.format(x='repaired')} AND length(repaired) >= 0.60::DOUBLE * greatest(1, length(text)) AS accepted FROM d""")
def repair_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut to 40 % and more of their length, as repairs of themselves."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("repaired", F.substring(F.col("text"), F.lit(1), F.expr("cast(length(text) * (4 + doc_id % 7) div 10 as int)")))
    return d.select("doc_id", rules.repaired_well(F.col("repaired"), F.col("text"), unit=r"[0-9]+(?:\.[0-9]+)?%?", bare=r"[0-9][0-9,]*(?:\.[0-9]+)?").alias("accepted"))


@query("X-9", r"""SELECT doc_id, coalesce(toxic = 1, false) OR text <> regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://\S+', '', 'g'), 'click here', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '^\s+', ''), '\s+$', '') AS has_trace FROM documents LEFT JOIN labels USING (doc_id)""")
def traced_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in which a judge has named traces (here: labelled toxic), or that surgery changes."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").join(table(spark, sf_dir, "labels", "doc_id", "toxic"), "doc_id", "left")
    return d.select("doc_id", rules.has_trace(F.when(F.col("toxic") == 1, F.array(F.lit("named"))), F.col("text"), [r"https?://\S+", "click here"]).alias("has_trace"))


@query("G-22 X-37", f"""WITH {MEASURED}, r AS (SELECT *, explicit + enum + standalone + (masked > 0.35)::INT + (masked > 0.45)::INT + (masked > 0.55)::INT AS burden FROM m)
SELECT l_orderkey::VARCHAR AS query, l_partkey::VARCHAR AS answer, burden::BIGINT AS burden, round(masked, 6) AS masked FROM r WHERE burden > 0 OR masked > 0.35 OR customer OR qa""")
def residual_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to rewrite, as rows for later sampling."""
    c = F.col
    m = _measured(spark, sf_dir).withColumn("burden", rules.burden(c("explicit"), c("enum"), c("standalone"), c("masked")))
    left = m.filter(rules.residual(c("burden"), c("masked"), c("customer"), c("qa")))
    rows = packaging.residual_rows(left, c("l_orderkey").cast("string"), c("l_partkey").cast("string"), {"burden": c("burden"), "masked": c("masked")})
    return rows.select("query", "answer", long("source_trace_features.burden").alias("burden"), r6(c("source_trace_features.masked")).alias("masked"))


# --- controls and decisions


@query("X-32", f"""WITH {C}, e AS (SELECT DISTINCT pk FROM c WHERE flag = 'N'), r AS (SELECT flag, pk, bool_and(ln <= 6 AND qty > 1) AS good FROM c GROUP BY flag, pk)
SELECT flag, count(*) AS n_keys, (SELECT count(*) FROM e) - count(e.pk) AS n_missing, count(*) - count(e.pk) AS n_extra, count(*) FILTER (NOT good) AS n_bad, (SELECT count(*) FROM e) = count(e.pk) AND count(*) = count(e.pk) AND count(*) FILTER (NOT good) = 0 AS comparable
FROM r LEFT JOIN e USING (pk) GROUP BY flag""")
def control_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flags as runs over parts: comparable are those with the same parts, three votes and a score each."""
    c = candidates(spark, sf_dir).withColumn("votes", F.when(F.col("ln") <= 6, 3).otherwise(2)).withColumn("score", F.when(F.col("qty") > 1, F.col("qty")))
    return R.control_runs(c, c.filter("flag = 'N'"), "flag", "pk", "votes", "score")


@query("D-15", """WITH v AS (SELECT n_chars AS x, quality AS y FROM documents JOIN labels USING (doc_id)), r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS b FROM v)
SELECT count(*) AS n, round(corr(a, b), 6) AS rho, round(count(*) FILTER ((x >= 300) = (y = 1)) / count(*), 6) AS gate_agreement, corr(a, b) >= 0.6 AND count(*) FILTER ((x >= 300) = (y = 1)) / count(*) >= 0.85 AS trusted FROM r""")
def local_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A local score against a judge's: ranks and gates."""
    d = table(spark, sf_dir, "documents", "doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return S.agreement(d, "n_chars", "quality", F.col("n_chars") >= 300, F.col("quality") == 1).select("n", r6(F.col("rho")).alias("rho"), r6(F.col("gate_agreement")).alias("gate_agreement"), "trusted")


@query("D-25", f"WITH {C}, p AS (SELECT qid, pk, qty - 20 AS m1, qty * (1 - pen) - 18 AS m2, score / 1000 - 20 AS m3 FROM c) SELECT qid, pk, round(m2, 6) AS m2 FROM p WHERE m1 >= 2 AND m2 >= 2 AND m3 >= 2")
def stable_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose margin holds in each of three judgings."""
    c = F.col
    p = candidates(spark, sf_dir).select("qid", "pk", (c("qty") - 20).alias("m1"), (c("qty") * (1 - c("pen")) - 18).alias("m2"), (c("score") / 1000 - 20).alias("m3"))
    return D.stable_pairs(p, [c("m1"), c("m2"), c("m3")], 2).select("qid", "pk", r6(c("m2")).alias("m2"))


@query("D-20", """WITH a AS (SELECT l_partkey % 7 AS stage, avg(l_quantity) / 5 - 5.1 AS delta, count(*) AS n, avg(CASE WHEN l_tax <= 0.06 THEN 1.0 ELSE 0.0 END) AS inside FROM lineitem GROUP BY 1),
s AS (SELECT *, 3 * sqrt(1.02 * 1.02 + 0.74 * 0.74 / 3) / sqrt(n) AS bar FROM a), v AS (SELECT *, CASE WHEN delta > bar THEN 'TRUE_GAIN' WHEN delta < -bar THEN 'REGRESSION' ELSE 'NEUTRAL' END AS verdict FROM s)
SELECT stage, verdict, verdict = 'TRUE_GAIN' AND inside >= 0.75 AS passed FROM v""")
def project_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages by their gain beyond three standard errors, and those that pass with enough answers in the pool."""
    c = F.col
    a = candidates(spark, sf_dir).groupBy((c("pk") % 7).alias("stage")).agg((F.avg("qty") / 5 - 5.1).alias("delta"), F.count("*").alias("n"), F.avg((c("tax") <= 0.06).cast("int")).alias("inside"))
    v = a.withColumn("verdict", D.stage_verdict(c("delta"), c("n")))
    return v.select("stage", "verdict", D.project_pass(c("verdict"), c("inside"), 0.75).alias("passed"))


# --- rows that must match


@query("J-11 R-17 X-29", "SELECT item_id, CAST(unnest(range(0, 3)) AS INT) AS copy_idx FROM benchmark")
def expanded_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts expanded to three completions each, after guards: all columns there, none without a text, counts that divide."""
    b = table(spark, sf_dir, "benchmark")
    if lacking := stale_schema(b, {"item_id", "text"}):
        raise ValueError(f"missing columns: {sorted(lacking)}")
    R.require_none(b.filter("text IS NULL"), "prompts without a text")
    n = b.count()
    return J.expand_prompts(b, 3 * n, n).select("item_id", "copy_idx")


@query("§2.6", """WITH s AS (SELECT doc_id, 'seed' AS origin FROM documents WHERE lang = 'de' ORDER BY md5('seed|' || doc_id), doc_id LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.05) AS BIGINT)) FROM documents WHERE lang = 'en'))
SELECT doc_id, 'base' AS origin FROM documents WHERE lang = 'en' UNION ALL SELECT * FROM s""")
def seeded_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base with at most a twentieth of seeds, each row with its origin."""
    from ..operators.ranking import hash_order

    d = table(spark, sf_dir, "documents", "doc_id", "lang")
    both = R.union_with_origin({"base": d.filter("lang = 'en'"), "seed": d.filter("lang = 'de'")})
    base, seeds = both.filter("origin = 'base'").select("doc_id", "origin"), both.filter("origin = 'seed'").select("doc_id", "origin")
    return R.limit0(W.capped_union(base, seeds, [hash_order("seed", F.col("doc_id")), F.col("doc_id")]), 0)


@query("§2.10 (signals)", f"WITH {C} SELECT qid, ln, pk, sk, round(0.5 * qty / 50 + 0.3 * coalesce(CASE WHEN flag <> 'N' THEN pen END, 0) + 0.2 * tax, 6) AS signal FROM c")
def combined_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of a candidate, one of which some lack, in one number."""
    c = candidates(spark, sf_dir).withColumns({"a": F.col("qty") / 50, "b": F.when(F.col("flag") != "N", F.col("pen"))})
    return c.select("qid", "ln", "pk", "sk", r6(vectors.combine({"a": 0.5, "b": 0.3, "tax": 0.2})).alias("signal"))


@query("A-7", """WITH e AS (SELECT unnest(list_filter([CASE WHEN value < 10 THEN 'low' END, CASE WHEN length(props) > 9 THEN 'long' END, CASE WHEN event_type = 'error' THEN 'err' END], lambda x: x IS NOT NULL)) AS reason FROM events) SELECT reason, count(*) AS n FROM e GROUP BY reason""")
def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each reason applies, also beside others."""
    checks = {"low": F.col("value") < 10, "long": F.length("props") > 9, "err": F.col("event_type") == "error"}
    return A.histogram(table(spark, sf_dir, "events"), rules.hard_reasons(checks))


@query("I-8", f"WITH {C} SELECT qid, ln, pk, sk, CASE WHEN ln <= 2 THEN -1.0 ELSE qty END AS score FROM c")
def warmed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two calls of a query by rule alone."""
    score = warm_up(F.col("qty").cast("double"), F.lit(-1.0), F.col("ln") - 1, 2)
    return candidates(spark, sf_dir).select("qid", "ln", "pk", "sk", score.alias("score"))


@query("D-1", f"WITH {C} SELECT status, count(*) AS n, round(corr(tax, score), 6) AS r FROM c GROUP BY status")
def correlations_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pearson(candidates(spark, sf_dir), "tax", "score", ["status"]).withColumn("r", r6(F.col("r")))


@query("§2.10 (pairs)", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT a.vec_id, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)), 6) AS similarity FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def neighbour_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the next one."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", r6(vectors.cosine(F.col("embedding"), F.col("other"))).alias("similarity"))


# --- files


@query("S-9", """WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant')
SELECT u.conv_id, u.turn, md5('rules' || u.text || '<think>' || chr(10) || substr(a.text, 1, 20) || chr(10) || '</think>' || chr(10) || '<answer>' || chr(10) || a.text || chr(10) || '</answer>') AS content FROM u JOIN a USING (conv_id, turn)""")
def sft_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the replies that follow them, as training rows."""
    c = table(spark, sf_dir, "conversations")
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    j = c.filter("role = 'user'").join(a, ["conv_id", "turn"]).withColumns({"think": F.substring("answer", 1, 20), "query": F.concat_ws("-", "conv_id", "turn")})
    rows = packaging.sft_rows(j, "rules", "text", "think", "answer", "query")
    key = F.split("query", "-")
    return rows.select(long(key[0]).alias("conv_id"), long(key[1]).alias("turn"), F.md5(F.array_join(F.transform("messages", lambda m: m["content"]), "")).alias("content"))


@query("S-14", "SELECT round(avg(n_chars), 2) AS mean_chars, count(DISTINCT lang)::DOUBLE AS n_langs FROM documents")
def report_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report that Spark writes, and the metrics that are read out of it."""
    path = shared_path(spark, "report")
    m = table(spark, sf_dir, "documents").agg(F.round(F.avg("n_chars"), 2).alias("mean"), F.count_distinct("lang").alias("n"))
    m.select(F.format_string("# Report\\n\\n| mean length | %s |\\nLanguages: %d", "mean", "n").alias("value")).write.text(path)
    return tables.metrics_from_report(spark, path, {"mean_chars": r"mean length \| ([0-9.]+)", "n_langs": r"Languages: (\d+)"})


@query("S-13", """WITH t AS (SELECT item_id % 4 AS part, item_id, text || chr(10) AS line FROM benchmark)
SELECT part::VARCHAR AS part, sum(strlen(line))::BIGINT AS bytes, sha256(string_agg(line, '' ORDER BY item_id)) AS sha256, sum(length(line) - length(replace(line, chr(10), '')))::BIGINT AS n_rows FROM t GROUP BY part""")
def file_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that Spark writes, one for each fourth of the items, by what is in them."""
    path = shared_path(spark, "fingerprint")
    b = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 4).alias("part"), "item_id", "text")
    b.repartition("part").sortWithinPartitions("part", "item_id").select("text", "part").write.partitionBy("part").text(path)
    files = tables.fingerprint(spark, path).filter(F.col("path").rlike(r"/part=[^/]*/part-"))
    return files.select(F.regexp_extract("path", "/part=([^/]*)/", 1).alias("part"), "bytes", "sha256", "n_rows")

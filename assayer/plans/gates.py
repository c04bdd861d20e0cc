"""Gates, trace counters and rewards one by one, over made-up marks and measures, so that SQL can say each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P, rules
from .base import long, query, r6, table

#: Pieces with and without marks, of which the texts here are put together.
PIECES = [
    "检索结果显示应当缴纳", "参考资料第 2 个参考", "《增值税法》第三条", "根据财税〔2016〕36号规定处理", "财税〔2016〕36号", "政策依据：", "逐条对照",
    "温馨提示您", "问题 12 ：怎么办", "见 chart.png 与 a.pdf9", "《申报表》", "plain words only", "税总函[2019]1号、财会[2017]22号、公告2018年第9号", "",
]
_LIST = "[" + ", ".join(f"'{p}'" for p in PIECES) + "]"
_N = len(PIECES)
#: The texts in SQL: three pieces and two ends of sentences.
TRACED = f"t AS (SELECT p_partkey, {_LIST}[1 + p_partkey % {_N}] || '。' || {_LIST}[1 + (p_partkey // {_N}) % {_N}] || chr(10) || {_LIST}[1 + p_size % {_N}] AS t, (p_partkey % 50) / 100.0 AS c FROM part)"


def _traced(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = F.array(*[F.lit(p) for p in PIECES])
    piece = lambda k: F.get(pieces, (k % _N).cast("int"))
    key = F.col("p_partkey")
    text = F.concat(piece(key), F.lit("。"), piece(F.floor(key / _N)), F.lit("\n"), piece(F.col("p_size")))
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", text.alias("t"), (key % 50 / 100.0).alias("c"))


def _n(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _bare(text: str) -> str:
    return f"regexp_replace({text}, '{P.FORM_NAME}', '', 'g')"


_SENTENCES = "list_filter(list_transform(string_split_regex(t, '" + P.SENTENCE_END.replace(r"\n", "\n") + r"'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
_COUNTS = {k: " + ".join(_n("t", p) for p in ps) for k, ps in (("explicit", P.TRACES_EXPLICIT), ("enum", P.TRACES_ENUMERATION))}
_ALONE = f"len(list_filter(s, lambda x: {_n(_bare('x'), P.DOC_TOKEN_FROZEN)} > 0 AND ({_n(_bare('x'), P.DOC_TOKEN_FROZEN)} >= 3 OR NOT regexp_matches({_bare('x')}, '{P.REASONING_WORD}'))))"
_FROZEN = f"coalesce(list_sum(list_transform(s, lambda x: CASE WHEN {_n('x', P.DOC_TOKEN_FROZEN)} = 1 AND regexp_matches(x, '{P.REASONING_WORD}') THEN 0 ELSE {_n('x', P.DOC_TOKEN_FROZEN)} END)), 0) + ({_n('t', P.DOC_TOKEN_FROZEN)} >= 3)::INT + regexp_matches(t, '{P.POLICY_LABEL}')::INT"


@query("G-4 G-5 G-6", f"""WITH {TRACED}, s AS (SELECT *, {_SENTENCES} AS s FROM t),
n AS (SELECT p_partkey, c, {_COUNTS['explicit']} AS explicit_ref, {_COUNTS['enum']} AS ref_enumeration, {_ALONE} AS policy_source, {_FROZEN} AS frozen_policy, len(s) AS n FROM s)
SELECT p_partkey, explicit_ref, ref_enumeration, policy_source, CAST(frozen_policy AS BIGINT) AS frozen_policy, CAST(c >= 0.40 AS BIGINT) AS frozen_verbatim, round(policy_source / greatest(1, n), 6) AS density,
explicit_ref + ref_enumeration + (c >= 0.40)::INT >= 1 AS is_problem, explicit_ref + ref_enumeration + (c >= 0.40)::INT = 0 AND c <= 0.30 AS is_clean FROM n""")
def trace_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _traced(spark, sf_dir)
    d = d.withColumn("now", rules.trace_counts(F.col("t"), F.col("c"))).withColumn("old", rules.trace_counts(F.col("t"), F.col("c"), frozen=True))
    return d.select(
        "p_partkey", long("now.explicit_ref").alias("explicit_ref"), long("now.ref_enumeration").alias("ref_enumeration"), long("now.policy_source").alias("policy_source"), long("old.policy_source").alias("frozen_policy"),
        long("old.verbatim_copy").alias("frozen_verbatim"), r6(rules.citation_density(F.col("t"))).alias("density"), rules.is_problem(F.col("now"), F.col("c")).alias("is_problem"), rules.is_clean(F.col("now"), F.col("c")).alias("is_clean"),
    )


#: RE2 has no look-ahead; of a match that must not go on, the end or one more character says the same.
_MARKS = " OR ".join(f"regexp_matches(t, '{p.replace('(?![a-z0-9])', '(?:[^a-z0-9]|$)')}'" + (", 'i')" if k in P.RAG_STYLE_ANY_CASE else ")") for k, ps in P.RAG_STYLE.items() for p in ps)


@query("G-1 (all classes)", f"""WITH {TRACED}, s AS (SELECT *, {_SENTENCES} AS s FROM t),
d AS (SELECT p_partkey, {_MARKS} AS marked, coalesce(list_sum(list_transform(s, lambda x: CASE WHEN {_n(_bare('x'), P.DOC_TOKEN)} >= 3 OR NOT regexp_matches({_bare('x')}, '{P.REASONING_WORD}') THEN {_n(_bare('x'), P.DOC_TOKEN)} ELSE 0 END)), 0) >= 3 OR regexp_matches(t, '{P.POLICY_LABEL}') AS dump FROM s)
SELECT p_partkey, dump, marked OR dump AS has_rag_style FROM d""")
def rag_style_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _traced(spark, sf_dir).select("p_partkey", rules.document_dump(F.col("t")).alias("dump"), rules.has_rag_style(F.col("t")).alias("has_rag_style"))


#: Measures of a candidate, the same in Spark and in SQL.
_MEASURES = {
    "explicit": "l_linenumber % 3", "enum": "l_suppkey % 2", "standalone": "l_partkey % 4", "masked": "(l_partkey % 61) / 100.0D", "copied": "(l_suppkey % 67) / 100.0D", "density": "(l_orderkey % 40) / 100.0D",
    "recall": "(l_orderkey % 11) / 10.0D", "introduced": "CASE WHEN l_orderkey % 13 = 0 THEN 1 ELSE 0 END", "grounded": "l_partkey % 17 <> 0", "fmt": "l_suppkey % 19 <> 0", "extreme": "l_partkey % 23 = 0",
    "img": "l_orderkey % 29 = 0", "soft": "l_linenumber = 4", "score": "(l_suppkey % 10) / 10.0D", "customer": "l_suppkey % 7 = 0", "qa": "l_partkey % 9 = 0",
}
_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
MEASURED = f"m AS (SELECT {', '.join(_KEYS)}, {', '.join(f'{v} AS {k}' for k, v in _MEASURES.items())} FROM lineitem)".replace(".0D", "::DOUBLE")
_BURDEN = "explicit + enum + standalone + (masked > 0.35)::INT + (masked > 0.45)::INT + (masked > 0.55)::INT"


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem", *_KEYS).select(*_KEYS, *[F.expr(v).alias(k) for k, v in _MEASURES.items()])


@query("G-8 G-9 G-10 T-29", f"""WITH {MEASURED}, r AS (SELECT *, {_BURDEN} AS burden, array_to_string(list_filter([CASE WHEN NOT fmt THEN 'format' END, CASE WHEN introduced > 0 THEN 'introduced_nums' END, CASE WHEN NOT grounded THEN 'grounding_floor' END,
CASE WHEN explicit > 0 THEN 'explicit_ref' END, CASE WHEN enum > 0 THEN 'ref_enumeration' END, CASE WHEN copied > 0.55 THEN 'raw_copy_cap' END, CASE WHEN img THEN 'img_trace' END, CASE WHEN extreme THEN 'extreme_degen' END], lambda x: x IS NOT NULL), '+') AS reasons FROM m)
SELECT {', '.join(_KEYS)}, burden::BIGINT AS burden, reasons, reasons = '' AND burden = 0 AND masked <= 0.30 AND NOT soft AND recall >= 0.75 AND score >= 0.55 AS chosen,
CASE WHEN customer OR qa THEN 'trace' WHEN masked > 0.35 THEN 'paraphrase' WHEN standalone > 0 THEN 'citation' ELSE 'none' END AS route FROM r""")
def gate_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    reasons = rules.hard_reasons({
        "format": ~c("fmt"), "introduced_nums": c("introduced") > 0, "grounding_floor": ~c("grounded"), "explicit_ref": c("explicit") > 0,
        "ref_enumeration": c("enum") > 0, "raw_copy_cap": c("copied") > 0.55, "img_trace": c("img"), "extreme_degen": c("extreme"),
    })
    m = _measured(spark, sf_dir).withColumns({"why": reasons, "burden": rules.burden(c("explicit"), c("enum"), c("standalone"), c("masked"))})
    chosen: Column = rules.dpo_chosen(F.size("why") == 0, c("burden"), c("masked"), c("soft"), c("recall"), c("score"))
    return m.select(*_KEYS, long("burden").alias("burden"), F.array_join("why", "+").alias("reasons"), chosen.alias("chosen"), rules.repair_route(c("customer"), c("qa"), c("masked"), c("standalone")).alias("route"))


@query("G-12", f"""WITH {MEASURED}, g AS (SELECT *, CASE WHEN NOT fmt OR extreme THEN 'format_or_extreme_degen' WHEN recall < 0.80 OR introduced > 0 OR NOT grounded THEN 'fact_guard' WHEN copied > 0.55 OR img THEN 'hard_trace_guard' ELSE 'ok' END AS gate,
0.34::DOUBLE * explicit + enum + 0.2::DOUBLE * standalone + 1.2::DOUBLE * greatest(0, density - 0.15::DOUBLE) + 2 * greatest(0, masked - 0.25::DOUBLE) + 8 * greatest(0, masked - 0.40::DOUBLE) AS penalty FROM m)
SELECT {', '.join(_KEYS)}, gate, round(CASE gate WHEN 'format_or_extreme_degen' THEN -1 WHEN 'fact_guard' THEN 0.1::DOUBLE * greatest(0, least(1, recall)) WHEN 'hard_trace_guard' THEN 0.1::DOUBLE ELSE 0.3::DOUBLE + 0.7::DOUBLE / (1 + penalty) END, 6) AS reward FROM g""")
def trace_free_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    reward = rules.derag_reward(c("fmt"), c("extreme"), c("recall"), c("introduced"), c("grounded"), c("copied"), c("img"), c("explicit"), c("enum"), c("standalone"), c("density"), c("masked"))
    return _measured(spark, sf_dir).withColumn("r", reward).select(*_KEYS, "r.gate", r6(F.col("r.reward")).alias("reward"))

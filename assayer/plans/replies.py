"""What judges and services reply: evidence, scores, errors, flags, quotes. Replies are put together from the driver's texts, one of each outcome."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import judge
from ..functions import text as X
from .base import long, query, table


def _by_kind(kind: Column, forms: list[Column]) -> Column:
    return reduce(lambda rest, f: F.when(kind == f[0], f[1]).otherwise(rest), list(enumerate(forms)), F.lit(None).cast("string"))


def _span(c: Column, key: str = "span") -> Column:
    """A JSON list of one piece of evidence."""
    return F.to_json(F.array(F.struct(c.alias(key))))


#: Kind of reply to a turn, and what it quotes: the turn's own words in other white space, or those of another turn.
_SAID = r"""s AS (SELECT conv_id, turn, (conv_id * 3 + turn) % 11 AS kind, text, substr(text, 4, 14) AS own, CASE WHEN turn % 2 = 0 THEN substr(text, 2, 9) ELSE 'nowhere to be found' END AS other FROM conversations),
r AS (SELECT *, '[{"span":' || to_json(own) || '}]' AS good, '[{"quote":' || to_json(other) || '}]' AS mixed FROM s)"""


def _replied(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", ((F.col("conv_id") * 3 + F.col("turn")) % 11).alias("kind"), "text", F.substring("text", 4, 14).alias("own"), F.when(F.col("turn") % 2 == 0, F.substring("text", 2, 9)).otherwise("nowhere to be found").alias("other"))
    return c.withColumns({"good": _span(F.col("own")), "mixed": _span(F.col("other"), "quote")})


def _form(template: str) -> Column:
    """A reply with {good} and {mixed} filled in."""
    parts, rest = [], template
    while "{good}" in rest or "{mixed}" in rest:
        name = min((n for n in ("good", "mixed") if "{" + n + "}" in rest), key=lambda n: rest.index("{" + n + "}"))
        head, rest = rest.split("{" + name + "}", 1)
        parts += [F.lit(head), F.col(name)]
    return F.concat(*parts, F.lit(rest))


def _form_sql(template: str) -> str:
    return "'" + template.replace("'", "''").replace("{good}", "' || good || '").replace("{mixed}", "' || mixed || '") + "'"


def _cases_sql(forms: list[str]) -> str:
    return "CASE kind " + " ".join(f"WHEN {k} THEN {_form_sql(f)}" for k, f in enumerate(forms)) + " END"


_VERDICTS = [
    'So: {"evidence": {good}, "verdict": "traced"}', '{"evidence": {mixed}, "verdict": "traced", "confidence": "medium"}', '{"verdict": "traced", "evidence": {good}}', '{"evidence": {mixed}, "verdict": "clean"} end',
    '{"evidence": [], "verdict": "clean", "confidence": "medium"}', '{"evidence": {good}, "verdict": "maybe"}', '{"evidence": "none", "verdict": "clean"}', "no reply {", '{"evidence": [5, {"span": "zzzzzzzz"}, {"quote": 7}], "verdict": "traced"}', '{"evidence": [', '{"evidence": null, "verdict": "clean"}',
]
_SCORES = [
    '{"evidence": {good}, "score": 0.4}', '{"evidence": {mixed}, "score": 0.95}', '{"score": 0.4, "evidence": {good}}', '{"evidence": {mixed}, "score": 0.3}', '{"evidence": [], "score": 0.59}', '{"evidence": {good}, "score": "high"}',
    '{"evidence": "none", "score": 1}', "none", '{"evidence": [{"span": "zzzzzzzz"}, 3], "score": 0.7}', '{"evidence": [], "score": 0.6', '{"evidence": false, "score": 0.9}',
]

#: Evidence of replies `raw` to `text`, item by item.
_CHECKED = r"""j AS (SELECT *, regexp_extract(raw, '(?s)\{.*\}') AS b FROM t), v AS (SELECT *, CASE WHEN json_valid(b) THEN b::JSON END AS v FROM j),
e AS (SELECT *, CASE WHEN json_type(v, '$.evidence') = 'ARRAY' THEN json_extract(v, '$.evidence') WHEN json_extract(v, '$.evidence') IS NULL OR json_type(v, '$.evidence') = 'NULL' OR (json_extract_string(v, '$.evidence')) IN ('false', '', '0') THEN '[]'::JSON END AS items FROM v),
o AS (SELECT *, list_transform(list_filter(from_json(coalesce(items, '[]'), '["JSON"]'), lambda x: json_type(x) = 'OBJECT'), lambda x: regexp_replace(coalesce(nullif(json_extract_string(x, '$.span'), ''), json_extract_string(x, '$.quote'), ''), '\s+', '', 'g')) AS q FROM e),
n AS (SELECT *, len(q) AS n_evidence, len(list_filter(q, lambda x: length(x) >= 6 AND contains(regexp_replace(text, '\s+', '', 'g'), x))) AS n_valid, coalesce(json_array_length(items), 0) AS all_items FROM o)"""


@query("G-24", f"""WITH {_SAID}, t AS (SELECT conv_id, turn, text, {_cases_sql(_VERDICTS)} AS raw FROM r), {_CHECKED},
s2 AS (SELECT *, CASE WHEN v IS NULL THEN 'no_json' WHEN position('"verdict"' IN raw) > 0 AND position('"evidence"' IN raw) > position('"verdict"' IN raw) THEN 'verdict_first' WHEN coalesce(json_extract_string(v, '$.verdict'), '') NOT IN ('traced', 'clean') THEN 'invalid_verdict'
  WHEN items IS NULL THEN 'not_a_list' WHEN json_extract_string(v, '$.verdict') = 'traced' AND n_valid = 0 THEN 'weakened' WHEN json_extract_string(v, '$.verdict') = 'clean' AND n_valid > 0 THEN 'conflict' ELSE 'ok' END AS state FROM n)
SELECT conv_id, turn, state, CASE WHEN state = 'ok' THEN json_extract(v, '$.verdict') ELSE '"clean"' END::VARCHAR AS verdict, CASE WHEN state = 'ok' THEN coalesce(json_extract_string(v, '$.confidence'), 'high') ELSE 'low' END AS confidence, n_evidence, n_valid, CAST(all_items - n_valid AS BIGINT) AS n_invalid FROM s2""")
def evidence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts against the evidence they give."""
    r = _replied(spark, sf_dir).withColumn("raw", _by_kind(F.col("kind"), [_form(t) for t in _VERDICTS]))
    return r.select("conv_id", "turn", judge.evidence("raw", "text").alias("e")).select("conv_id", "turn", "e.state", "e.verdict", "e.confidence", *[long(f"e.{c}").alias(c) for c in ("n_evidence", "n_valid", "n_invalid")])


@query("G-24", f"""WITH {_SAID}, t AS (SELECT conv_id, turn, text, {_cases_sql(_SCORES)} AS raw FROM r), {_CHECKED},
s1 AS (SELECT *, try_cast(json_extract_string(v, '$.score') AS DOUBLE) AS x, CAST(all_items - n_valid AS BIGINT) AS n_invalid FROM n),
s2 AS (SELECT *, CASE WHEN v IS NULL THEN 'no_json' WHEN position('"score"' IN raw) > 0 AND position('"evidence"' IN raw) > position('"score"' IN raw) THEN 'score_first' WHEN items IS NULL THEN 'not_a_list' WHEN x IS NULL THEN 'bad_score'
  WHEN n_evidence > 0 AND 2 * n_invalid > n_evidence THEN 'mostly_invalid' WHEN x >= 0.9 AND n_valid > 0 THEN 'high_conflict' WHEN x < 0.6 AND n_valid = 0 THEN 'low_unproven' ELSE 'ok' END AS state FROM s1)
SELECT conv_id, turn, state, CASE WHEN state = 'ok' THEN x END AS score, n_evidence, n_valid, n_invalid FROM s2""")
def evidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores against the evidence of the issues they give."""
    r = _replied(spark, sf_dir).withColumn("raw", _by_kind(F.col("kind"), [_form(t) for t in _SCORES]))
    return r.select("conv_id", "turn", judge.evidence_score("raw", "text").alias("e")).select("conv_id", "turn", "e.state", "e.score", *[long(f"e.{c}").alias(c) for c in ("n_evidence", "n_valid", "n_invalid")])


_BODIES = [
    ('{"choices": [{"message": {"content": "%s"}}]}', None), ('{"error": {"code": 5}, "text": "%s"}', "error_body"), ('{"error": "Some Failure", "content": "%s"}', "error_body"), ('{"error": "", "data": {"answer": "%s"}}', None),
    ('{"success": false, "content": "%s"}', "failed"), ('{"choices": [], "content": [{"text": "%s"}]}', None), ('["%s"]', "not_an_object"), ('{"result": 7, "note": "%s"}', "no_text"), ("%s", "not_an_object"), ('{"err": {"x": 1}, "result": "%s"}', "error_body"), ('{"error": "quota", "err": {"x": 1}, "result": "%s"}', None),
]


@query("G-27", "SELECT event_id, CASE event_id % 11 " + " ".join(f"WHEN {k} THEN {f'{chr(39)}{p}{chr(39)}' if p else 'NULL'}" for k, (_, p) in enumerate(_BODIES)) + " END AS problem, CASE WHEN event_id % 11 IN (" + ", ".join(str(k) for k, (_, p) in enumerate(_BODIES) if not p) + ") THEN event_type END AS reply FROM events")
def reply_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of services with texts and errors in many places."""
    body = _by_kind(F.col("event_id") % 11, [F.concat(*[F.lit(x) if x != "%s" else F.col("event_type") for x in b.partition("%s")]) for b, _ in _BODIES])
    return table(spark, sf_dir, "events").select("event_id", judge.reply(body).alias("r")).select("event_id", "r.problem", F.col("r.text").alias("reply"))


@query("G-29 J-12", r"""WITH s AS (SELECT item_id, list_filter(list_transform(string_split_regex(text, '[.!?\n]+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM benchmark),
f AS (SELECT item_id, len(s) AS n, len(list_filter(s, lambda x: length(x) % 3 = 0)) AS k FROM s), l AS (SELECT item_id, CASE WHEN k = 0 THEN 0 WHEN k >= n THEN 5 ELSE least(k, 4) END AS level_idx FROM f)
SELECT item_id, level_idx, 10 - 2 * level_idx AS anchor FROM l""")
def copy_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels from flagged sentences; here those are flagged whose length is a multiple of three."""
    s = F.filter(F.transform(F.split("text", r"[.!?\n]+", -1), lambda x: F.trim(x)), lambda x: x != "")
    level = X.let(s, lambda s: judge.copy_level(F.size(F.filter(s, lambda x: F.length(x) % 3 == 0)), F.size(s)))
    return table(spark, sf_dir, "benchmark").select("item_id", long(level).alias("level_idx")).withColumn("anchor", 10 - 2 * F.col("level_idx"))


@query("T-27", r"""WITH q AS (SELECT c.conv_id, c.turn, c.text, regexp_replace(substr(o.text, 3, 12), '\s+', '', 'g') AS quote FROM conversations c JOIN conversations o ON o.conv_id = c.conv_id AND o.turn = CASE WHEN c.turn % 3 = 0 THEN c.turn ELSE c.turn - c.turn % 3 END)
SELECT conv_id, turn, length(quote) >= 8 AND contains(regexp_replace(text, '\s+', '', 'g'), quote) AS found FROM q""")
def quote_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes from every third turn, looked up in that turn and in the two after it."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    quoted = c.filter("turn % 3 = 0").select("conv_id", F.col("turn").alias("at"), F.concat(F.lit(" "), F.substring("text", 3, 12), F.lit("\n")).alias("quote"))
    return c.withColumn("at", F.col("turn") - F.col("turn") % 3).join(quoted, ["conv_id", "at"]).select("conv_id", "turn", X.quote_found(F.col("quote"), F.col("text"), 8).alias("found"))

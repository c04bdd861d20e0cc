"""The queries op1_ to op13_ of this folder and their SQL, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_path
from . import bpe, chat, decontaminate, langid, novelty, phrases, pii, simhash, spans, topk, toxicity, trie, warc
from .common import load


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = langid.fit(docs.filter(~held_out))
    return langid.predict(docs, model, keep=[held_out.alias("held_out")])


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, load(spark, sf_dir, "benchmark")).drop("text")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(load(spark, sf_dir, "documents"), vocabulary())


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    runs = warc.write(load(spark, sf_dir, "pages"), folder)
    return warc.read(warc.merged(runs), folder)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.rotate(load(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask_spans", lambda m: F.concat_ws("-", m["start"], m["end"])), ",")
    return turns.select("conv_id", "part", "speaker", "n_turns", "n_masked", "text", mask.alias("mask"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(load(spark, sf_dir, "documents"), F.col("doc_id") % 20 == 0)


def op8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeats(load(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.with_spans(load(spark, sf_dir, "documents").select("doc_id", "text")))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(load(spark, sf_dir, "documents"))


def op12_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return novelty.digest(novelty.with_secrets(docs, novelty.dictionary(docs)))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation c begins with the first crc32(c) % 4 turns of conversation c - c % 20 in place of its own."""
    rows, convs = trie.turns(load(spark, sf_dir, "conversations"))
    heads = rows.filter((F.col("conv_id") % 20 == 0) & (F.col("place") < 3)).select(F.col("conv_id").alias("base"), "place", "said", "words")
    of_base = convs.filter(F.col("conv_id") % 20 == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    about = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).withColumn("h", fold("conv_id", 4)).join(of_base, "base", "left")
    kept = F.least("h", F.coalesce("base_n", F.lit(0)))
    about = about.select("conv_id", "base", "n", "h", kept.alias("kept"))
    first = about.join(heads, "base").filter(F.col("place") < F.col("h")).select("conv_id", (F.col("place") + 1).alias("depth"), "said", "words")
    rest = rows.join(about, "conv_id").filter(F.col("place") >= F.col("h")).select("conv_id", (F.col("place") - F.col("h") + F.col("kept") + 1).alias("depth"), "said", "words")
    return trie.tree(first.unionByName(rest), about.select("conv_id", (F.col("kept") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("n")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_langid, op2_decontaminate, op3_bpe, op4_warc, op5_chat, op6_simhash, op7_topk, op8_spans, op9_toxicity, op10_pii, op11_phrases, op12_novelty, op13_trie)}


OP2_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
ww AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS i FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS s FROM ww),
lens AS (SELECT DISTINCT n FROM win),
dp AS (SELECT doc_id, n, w, unnest(range(0, len(w) - n + 1)) AS i FROM dw, lens WHERE len(w) >= n),
ds AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS s FROM dp),
m AS (SELECT doc_id, item_id, i, ds.n FROM ds JOIN win ON ds.s = win.s AND ds.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _found(kind: str, pattern: str, valid: str) -> str:
    """Valid matches of one kind with offsets, from the matches and the pieces between them."""
    return rf"""
{kind} AS (
  SELECT doc_id, list_filter(list_transform(range(1, len(f) + 1), lambda i: {{'m': f[i], 'near': lower(right(coalesce(right(f[i - 1], 40), '') || p[i], 40)),
           's': CAST(coalesce(list_sum(list_transform(range(1, i + 1), lambda k: length(p[k]))), 0) + coalesce(list_sum(list_transform(range(1, i), lambda k: length(f[k]))), 0) AS BIGINT)}}), lambda x: {valid}) AS found
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}') AS f, string_split_regex(coalesce(text, ''), '{pattern}') AS p FROM documents))"""


_DIGITS = "regexp_replace(x.m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, len({_DIGITS}) + 1), lambda k: CASE WHEN (len({_DIGITS}) - k) % 2 = 1 THEN CASE WHEN 2 * CAST({_DIGITS}[k] AS INT) > 9 THEN 2 * CAST({_DIGITS}[k] AS INT) - 9 ELSE 2 * CAST({_DIGITS}[k] AS INT) END ELSE CAST({_DIGITS}[k] AS INT) END)) % 10 = 0"


def op10_sql() -> str:
    """Base kinds; on the driver's tables the added kinds find nothing, so that all spans are base spans."""
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(x.m, '.'), lambda q: length(ltrim(q, '0')) > 3 OR CAST(right(q, 3) AS INT) > 255)) = 0"),
        "card": (r"[0-9]([\x20-]?[0-9])+", f"len({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"len({_DIGITS}) BETWEEN 8 AND 15"),
    }
    word = lambda w: f"regexp_matches(x.near, '(^|[^a-z])({w})($|[^a-z])')"
    score = lambda k: f"list_transform({k}.found, lambda x: CAST(round(greatest(0, least(1, {pii.PRIOR[k]} + CASE WHEN {word(pii.CONTEXT[k])} THEN {pii.UP} ELSE 0 END - CASE WHEN {word(pii.AGAINST)} THEN {pii.DOWN} ELSE 0 END)), 2)::DOUBLE AS VARCHAR))"
    text = lambda k: f"list_transform({k}.found, lambda x: '{k}:' || x.s || ':' || (x.s + length(x.m)))"
    return "WITH " + ",".join(_found(k, p, v) for k, (p, v) in kinds.items()) + f""",
spans AS (SELECT doc_id, {', '.join(f'CAST(len({k}.found) AS BIGINT) AS n_{k}' for k in kinds)},
  array_to_string({' || '.join(text(k) for k in kinds)}, ',') AS spans, array_to_string({' || '.join(score(k) for k in kinds)}, ',') AS scores
  FROM email JOIN ip USING (doc_id) JOIN card USING (doc_id) JOIN phone USING (doc_id))
SELECT doc_id, n_email, n_ip, n_card, n_phone, sha256(spans) AS base_sha256, spans, scores FROM spans"""


OP4_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS low FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN page_id > low THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > low THEN low END AS refers_to
FROM p LEFT JOIN f USING (d)
"""

OP5_SQL = r"""
WITH c AS (SELECT conv_id, turn, translate(replace(coalesce(role, 'unknown'), '<|', '< |'), chr(10) || chr(13), '  ') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
t AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, body) - 1) // 256 AS part, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, body) AS place FROM c),
who AS (SELECT DISTINCT conv_id, speaker AS me FROM t WHERE speaker <> 'system'),
l AS (SELECT t.conv_id, part, me, place, speaker, body,
        '<|im_start|>' || CASE WHEN speaker = me THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user name=' || speaker END || chr(10) AS head
      FROM t JOIN who ON t.conv_id IS NOT DISTINCT FROM who.conv_id),
s AS (SELECT *, length(head) + length(body) + 11 AS size FROM l),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY conv_id, part, me ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS pos FROM s)
SELECT conv_id, part, me AS speaker, count(*) AS n_turns, count(*) FILTER (speaker = me) AS n_masked,
  string_agg(head || body || '<|im_end|>' || chr(10), '' ORDER BY place) AS text,
  coalesce(string_agg(pos || '-' || (pos + length(body) + 10), ',' ORDER BY place) FILTER (speaker = me), '') AS mask
FROM o GROUP BY conv_id, part, me
"""


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, s, array_to_string(w[i + 1 : i + s], ' ') AS phrase FROM (SELECT lang, s, w, unnest(range(0, len(w) - s + 1)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS sizes(s) WHERE len(w) >= s)),
f AS (SELECT lang, s, phrase, count(*) AS f FROM g GROUP BY lang, s, phrase HAVING count(*) >= 30),
c AS (SELECT lang, s, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE s > 1),
cuts AS (SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * a) // (x.f + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, s)) AS k FROM c) c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (SELECT lang, array_to_string(w[i + 1 : i + k], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, s, k, unnest(range(0, s - k + 1)) AS i FROM (SELECT *, unnest(range(2, s)) AS k FROM c WHERE s > 2)) GROUP BY 1, 2),
kept AS (SELECT best.* FROM best LEFT JOIN held USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""


OP13_SQL = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, count(*) AS n, {crc32} % 4 AS h FROM t GROUP BY conv_id),
k AS (SELECT c.*, least(h, coalesce(b.n, 0)) AS kept FROM c LEFT JOIN (SELECT conv_id AS base, n FROM c) b USING (base)),
s AS (SELECT k.conv_id, i + 1 AS depth, role, text FROM k JOIN t ON t.conv_id = k.base AND i < h
  UNION ALL SELECT k.conv_id, i - h + kept + 1, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND i >= h
  UNION ALL SELECT conv_id, 0, '', '' FROM k),
p AS (SELECT conv_id, depth, text, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '|') OVER (PARTITION BY conv_id ORDER BY depth)) AS key FROM s),
l AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS n FROM p),
nodes AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS words,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = n), '')) AS ends_sha256 FROM l GROUP BY depth, key),
up AS (SELECT x.key, x.depth, a.key AS above, a.depth AS above_depth FROM nodes x JOIN p a ON a.conv_id = x.conv_id AND a.depth <= x.depth),
kids AS (SELECT above AS key, above_depth AS depth, count(*) AS n FROM up WHERE above_depth = depth - 1 GROUP BY 1, 2),
sums AS (SELECT above AS key, above_depth AS depth, count(*) FILTER (kids.n IS NULL) AS n_leaves, CAST(sum((x.n_convs - 1) * CASE WHEN x.depth = 0 THEN 0 ELSE words END) AS BIGINT) AS saved_tokens
  FROM up JOIN nodes x ON x.key = up.key AND x.depth = up.depth LEFT JOIN kids ON kids.key = x.key AND kids.depth = x.depth GROUP BY 1, 2),
par AS (SELECT up.key, up.depth, a.conv_id AS parent_conv_id FROM up JOIN nodes a ON a.key = above AND a.depth = above_depth WHERE above_depth = up.depth - 1)
SELECT conv_id, depth, parent_conv_id, n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, saved_tokens, ends_sha256
FROM nodes JOIN sums USING (key, depth) LEFT JOIN kids USING (key, depth) LEFT JOIN par USING (key, depth)
"""


def crc32_sql(value: str) -> str:
    """crc32 of a value as text, bit by bit."""
    text = f"CAST({value} AS VARCHAR)"
    bits = f"flatten([[4294967295]] || list_transform(range(1, length({text}) + 1), lambda j: list_transform(range(0, 8), lambda b: (ascii({text}[j]) >> b) & 1)))"
    return f"xor(list_reduce({bits}, lambda z, b: CASE WHEN xor(z, b) & 1 = 1 THEN xor(z >> 1, 3988292384) ELSE z >> 1 END), 4294967295)"


def oracle_sql() -> dict[str, str]:
    return {"op11_phrases": OP11_SQL, "op13_trie": OP13_SQL.replace("{crc32}", crc32_sql("conv_id")), "op4_warc": OP4_SQL, "op5_chat": OP5_SQL, "op2_decontaminate": OP2_SQL, "op10_pii": op10_sql()}

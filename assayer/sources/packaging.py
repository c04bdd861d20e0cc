"""Training rows as messages, review sheets, event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import hash_order, hash_rank, top_by
from ..operators.rows import clean_array


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def reply(think: Column, answer: Column) -> Column:
    return F.concat(F.lit("<think>\n"), think, F.lit("\n</think>\n<answer>\n"), answer, F.lit("\n</answer>"))


def sft_rows(df: DataFrame, system: str, prompt: str, think: str, answer: str, query: str) -> DataFrame:
    c = F.col
    return df.select(F.array(message("system", F.lit(system)), message("user", c(prompt)), message("assistant", reply(c(think), c(answer)))).alias("messages"), c(query).alias("query"))


def dpo_rows(df: DataFrame, system: str, prompt: str, chosen: str, rejected: str, answer: str, query: str, meta: dict[str, Column]) -> DataFrame:
    """The answer is the same on both sides: only the thinking differs."""
    c = F.col
    kept = F.create_map(*[x for k, v in meta.items() for x in (F.lit(k), v.cast("double"))])
    return df.select(F.array(message("system", F.lit(system)), message("user", c(prompt)), message("assistant", reply(c(chosen), c(answer)))).alias("messages"), reply(c(rejected), c(answer)).alias("rejected_response"), c(query).alias("query"), kept.alias("meta"))


def grpo_rows(df: DataFrame, system: str, prompt: str, canonical: str, gold: str, samples: str) -> DataFrame:
    """Prompt rows with the answer pool (canonical, gold, samples; each once, in this order) as JSON, and its size."""
    pool = clean_array(F.concat(F.array(F.col(canonical), F.col(gold)), F.col(samples)))
    out = df.withColumn("pool", pool).withColumn("messages", F.array(message("system", F.lit(system)), message("user", F.col(prompt))))
    return out.withColumn("v1_answers_json", F.to_json("pool")).withColumn("v1_answer_pool_size", F.size("pool")).drop("pool")


def residual_rows(df: DataFrame, query: Column, answer: Column, features: dict[str, Column], prompt: Column | None = None) -> DataFrame:
    """Rows of a pool that is sampled later: query, prompt, answer (also as gold answer), and the features that brought them there."""
    kept = F.struct(*[v.alias(k) for k, v in features.items()])
    return df.select(query.alias("query"), (F.lit("") if prompt is None else prompt).alias("user_prompt"), answer.alias("answer"), answer.alias("gold_answer"), kept.alias("source_trace_features"))


def read_pool(c: Column) -> Column:
    """An answer pool from JSON; any other text is a pool of one."""
    parsed = F.from_json(c, "array<string>")
    text = F.trim(F.coalesce(c, F.lit("")))
    return F.when(text == "", F.array().cast("array<string>")).when(text.startswith("[") & parsed.isNotNull(), F.filter(parsed, lambda x: F.trim(x) != "")).otherwise(F.array(text))


def pair_parts(df: DataFrame, messages: str = "messages") -> DataFrame:
    """First user message and last assistant message of each row."""
    of = lambda role: F.filter(F.col(messages), lambda m: m["role"] == role)
    return df.withColumns({"prompt": F.try_element_at(of("user"), F.lit(1))["content"], "chosen": F.try_element_at(of("assistant"), F.lit(-1))["content"]})


def blind_review(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Two texts side by side; their order alternates by row, and `swapped` is the key for unblinding."""
    ranked = hash_rank(df, F.col(key), "review", [F.col(key)], "n")
    odd = F.col("n") % 2 == 1
    return ranked.select("n", key, F.when(odd, F.col(a)).otherwise(F.col(b)).alias("text_a"), F.when(odd, F.col(b)).otherwise(F.col(a)).alias("text_b"), (~odd).alias("swapped"))


def spot_check(df: DataFrame, key: str, strata: dict[str, Column], n: int, seed: str) -> DataFrame:
    """n rows of each stratum, a key in the first of its strata only, shuffled and numbered."""
    first = F.coalesce(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in strata.items()])
    tagged = df.withColumn("stratum", first).filter(F.col("stratum").isNotNull())
    picked = top_by(tagged, ["stratum"], [hash_order(seed, F.col(key)), F.col(key)], n)
    order = Window.orderBy(hash_order(f"{seed}-sheet", F.col(key)), key)  # strata * n rows
    return picked.withColumn("sheet_no", F.row_number().over(order))


def sse_text(lines: DataFrame, value: str, stream: str, pos: str, fields: tuple[str, str] = ("reasoning", "content")) -> DataFrame:
    """Two texts of each stream, from lines `data: {json}` in order; other lines and [DONE] are skipped."""
    body = F.regexp_extract(value, r"^data:\s*(\{.*\})\s*$", 1)
    got = lines.filter(body != "").select(stream, pos, *[F.get_json_object(body, f"$.{f}").alias(f) for f in fields])
    joined = lambda f: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, f))), lambda x: F.coalesce(x[f], F.lit(""))), "").alias(f)
    return got.groupBy(stream).agg(*[joined(f) for f in fields])

"""Row-level cases of text functions, facts and rules, with literals."""

import difflib

import pytest
from pyspark.sql import functions as F

from assayer.functions import facts, judge, rules, stats
from assayer.functions import patterns as P
from assayer.functions import text as X


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "think", "answer"),
    [
        ("<think> a b </think><answer>c</answer>", "a b", "c"),
        ("no tags", "", "no tags"),
        ("<think>a</think> tail", "a", "tail"),
        ("<think>a</think><answer>x</answer> y</answer>", "a", "x y"),
        ("<think>a</think><answer>open", "a", "open"),
        ("<answer>only</answer>", "", "only"),
        ("<think>　全角　</think><answer>\n1\n</answer>", "全角", "1"),
        (None, "", ""),
        ("", "", ""),
    ],
)
def test_parse_think_answer(spark, text, think, answer):
    got = one(spark, X.parse_think_answer("t"), t=text)
    assert (got.think, got.answer) == (think, answer)


def test_truncated_think_is_kept_and_never_an_answer(spark):
    got = one(spark, X.parse_diagnostic("t"), t="<think>half a thought")
    assert (got.think, got.answer, got.format_ok, got.format_reason) == ("half a thought", "", False, "missing_think_close+empty_answer")
    assert one(spark, X.parse_diagnostic("t"), t="").format_reason == "missing_think_close+empty_think+empty_answer"
    assert one(spark, X.parse_diagnostic("t"), t="<think>a</think><answer>b</answer>").format_reason == "ok"


def test_strict_tags(spark):
    assert one(spark, X.strict_tags("t"), t="<think>a</think><answer>b</answer>")
    assert not one(spark, X.strict_tags("t"), t="<think>a</think>b</answer>")
    assert not one(spark, X.strict_tags("t"), t="<answer>b</answer><think>a</think>")


def test_references(spark):
    assert one(spark, X.extract_references("t"), t="x【参考问答对】 r1 【问题】 q") == "r1"
    assert one(spark, X.extract_references("t"), t="【参考问答对】 to the end ") == "to the end"
    assert one(spark, X.extract_references("t"), t="none") == ""


def test_grams_and_repeats(spark):
    assert one(spark, X.ngrams("t", 3), t="ab cd") == ["abc", "bcd"]
    assert one(spark, X.ngrams("t", 9), t="ab cd") == []
    assert one(spark, X.ngrams("t", 1), t="😀é") == ["😀", "é"]
    assert one(spark, X.distinct2("t"), t="aaaa") == pytest.approx(1 / 3)
    assert one(spark, X.distinct2("t"), t="a") == 0.0
    assert one(spark, X.max_repeat(F.col("t")), t=["b", "a", "b", "c", "b"]) == 3
    assert one(spark, X.max_repeat(F.array().cast("array<string>"))) == 0
    assert one(spark, X.repeat_penalty("t"), t="abcdefgh" * 20) == pytest.approx(0.8)
    assert one(spark, X.repeat_penalty("t"), t="abc") == 0.0
    assert one(spark, X.length_penalty("t"), t="x" * 3200) == pytest.approx(0.3)


def test_degeneration(spark):
    loop = one(spark, X.degeneration(X.degeneration_input("t")), t="我们需要先看一看这个问题。" * 5)
    assert loop.extreme and loop.max_sentence == 5
    fine = one(spark, X.degeneration(X.degeneration_input("t")), t="本月销售额没有超过起征点，因此可以享受优惠政策。接着看看附加税费应如何处理。")
    assert not fine.extreme


def test_copy_and_ratio(spark):
    a, b = "今天天气很好我们出去玩", "昨天天气很好我们在家里"
    assert X.common_run(a, b) == len("天天气很好我们")
    assert one(spark, X.longest_share(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(7 / 11)
    assert one(spark, X.match_ratio(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(difflib.SequenceMatcher(None, a, b, autojunk=False).ratio())
    assert one(spark, X.gram_overlap(F.col("a"), F.col("b")), a="", b="x") == 0.0


def test_surgery_and_mask(spark):
    assert one(spark, X.surgery("t"), t="根据参考资料，税率是13%。\n\n\n\n资料显示：免征。") == "税率是13%。\n\n免征。"
    assert one(spark, X.mask_facts("t"), t="自2023年1月1日起按13%计征增值税专用发票") == "□按□计征□"


POOL = ["本月销售额9万元，未超过10万元，免征增值税。", "9万元未达起征线，可享受免征增值税。", "9万，免征。"]


@pytest.mark.parametrize(
    ("answer", "pool", "inside", "comparable", "reason"),
    [
        ("本月9万元，免征增值税。", POOL, True, True, "ok"),
        ("", POOL, False, True, "empty_answer"),
        ("建议结合实际情况处理。", POOL, True, False, "no_comparable_facts"),
        ("税率为13%，应缴增值税。", POOL, False, True, "introduced_new_fact"),
        ("建议咨询。", ["请结合实际情况。"], True, False, "no_facts_in_either"),
        ("税率13%", ["请结合实际情况。"], False, False, "v1_pool_has_no_facts"),
    ],
)
def test_answer_in_pool(spark, answer, pool, inside, comparable, reason):
    got = one(spark, facts.answer_in_pool(F.col("a"), facts.pool_facts(F.col("p"))), a=answer, p=pool)
    assert (got.in_pool, got.comparable, got.reason) == (inside, comparable, reason)
    if reason == "introduced_new_fact":
        assert "13%" in got.drift_facts


def test_no_pool_is_not_an_empty_pool(spark):
    assert one(spark, facts.answer_in_pool(F.lit("免征"), F.lit(None).cast(facts.FACTS))) is None


def test_masked_facts(spark):
    got = one(spark, facts.masked_facts("t"), t="不超过１０万元，自2023年1月1日起，期限30天，不属于应税范围")
    assert got.pol == ["不属于", "不超过"]
    assert got.val == ["10万", "30天"]
    assert got.date == ["2023年1月1日"]
    assert one(spark, facts.plain_facts("t"), t="不超过 5 %") == ["5%", "不超过", "超过"]
    assert one(spark, facts.date_covered(F.lit("2023年"), F.array(F.lit("2023年1月1日"))))


def test_support(spark):
    known = facts.support(F.col("p"))
    check = lambda a: one(spark, facts.answer_in_support(F.lit(a), known), p=["应当应缴10万元", "应缴", "免征"])
    assert check("应缴").in_support
    assert check("免征").reason == "contradict_majority"
    assert check("禁止").reason == "concl_not_covered"
    assert check("约99天").reason == "introduced_new_number"
    assert check("10万元").in_support


def test_rag_style(spark):
    flag = lambda t: one(spark, rules.has_rag_style(F.col("t")), t=t)
    assert not flag("这题先看销售额，本月9万没过10万这条线，所以可以免征增值税。")
    assert flag("根据参考问答对1，资料显示月销售额未超过10万元的免征增值税。参考下图。")
    assert flag("见 table1.PNG的数据")
    assert flag("政策依据：《增值税暂行条例》")
    assert not flag("按照《增值税暂行条例》第一条规定，应当缴纳增值税。")
    assert flag("《甲法》。《乙法》。《丙法》。")
    spans = list(rules.RagSpans().eval("https://x.oss-a/b.png 参考资料"))
    assert [s[3][0] for s in spans] == ["D", "A"] and spans[0][2] == "https://x.oss-a/b.png"


def test_rewards(spark):
    pool = facts.pool_facts(F.array(F.lit("本月9万元，免征增值税。")))
    think = "先看本月的销售额，九万没有超过十万这条线，所以可以享受小规模的优惠，接下来确认开票种类，再看附加税费的处理，没有其他问题。"
    reply = lambda t, a: f"<think>{t}</think><answer>{a}</answer>"
    score = lambda t: one(spark, rules.text_reward(F.col("t"), pool, F.lit(8.0)), t=t)
    good, rule_bad = score(reply(think, "免征增值税")), score(reply("根据参考问答对1，" + think, "免征增值税"))
    answer_bad, format_bad = score(reply(think, "税率13%，应缴")), score(reply(think, ""))
    assert good > rule_bad > answer_bad > format_bad
    assert score(f"<think>{think}</think>免征增值税") == format_bad and answer_bad < 0
    assert score(reply(think, "建议咨询")) == -2.0


def test_multiplicative_reward_and_humanness(spark):
    r = one(spark, rules.multiplicative_reward(F.lit(True), F.lit(0.2), F.lit(1.0)))
    assert (round(r.reward, 6), r.gate) == (0.02, "acc_drift")
    assert one(spark, rules.humanness(F.lit(""), F.lit(0.0))) == 0.0
    assert one(spark, rules.humanness(F.lit("参考问答对"), F.lit(0.5))) == pytest.approx(1 / (1 + 2 * 0.34 + 0.5))


def test_candidate_features(spark):
    df = spark.createDataFrame([("<think>" + "先看销售额九万没有超过十万这条线，" * 3 + "</think><answer>免征9万元</answer>", "【参考问答对】9万元免征【问题】q", "9万元免征")], "t string, p string, g string")
    row = rules.candidate_features(df, "t", "p", "g").first()
    assert row.format_ok and row.fact_recall == 1.0 and not row.introduced_nums
    assert row.counts.version == P.CURRENT_VERSION and row.frozen_counts.version == P.FROZEN_VERSION


def test_judge_output(spark):
    assert one(spark, judge.salvage("t", ["clean_score"])["clean_score"], t='x {"clean_score": 17} y') == 10.0
    assert one(spark, judge.salvage("t", ["clean_score"])["clean_score"], t="clean_score: 4.5 because") == 4.5
    assert one(spark, judge.salvage("t", ["clean_score"])["clean_score"], t="nothing") is None
    assert one(spark, judge.reply_text("t"), t='{"choices":[{"message":{"content":"hi"}}]}') == "hi"


def test_sigma_points(spark):
    s = lambda x: one(spark, stats.sigma_of(F.lit(x)))
    for mean, sigma in P.CALIBRATION:
        assert s(mean) == pytest.approx(sigma)
    assert s(-1.0) == 0.0 and s(99.0) == 1.85
    clean = lambda a, b, n: one(spark, stats.confident_cleaner(F.lit(a), F.lit(b), n))
    assert clean(7.3, 0.03, 3.0) and not clean(7.3, 4.6, 2.0) and not clean(1.0, 2.0, 2.0)
    assert 0.04 <= one(spark, stats.eval_se(F.lit(500), F.lit(3))) <= 0.06

from pyspark.sql import functions as F

from evidex.operators import reports

GOOD = "\n".join([
    "# 规格", "目标模式：忠实重建", "## 可执行规则", "每一段先给结论，再给两个证据与一个反例说明", "## 不可变项", "标题层级、口吻与段落顺序都必须保持不变", "## 内容变量", "主题、人物姓名与数据可以替换成新的内容",
    "## 负向约束", "禁止项：不要使用感叹号，也不要使用网络流行语", "## 适用边界", "只适合两千字以内的说明文，不适合小说与诗歌创作", "## 验收标准", "逐条检查每个规则是否被满足，并记录没有满足的条目",
    "补充说明：所有句子应当短而清楚，段落之间要有明确的过渡", "补充说明：引用资料时必须写明出处与页码，避免断章取义", "补充说明：结尾要回到开头提出的问题并给出明确的回答",
]) * 1


def rules(spark, text, kind, **more):
    return {r.rule for r in reports.report_violations(spark.createDataFrame([("r", text)], "report_id string, text string"), kind, **more).collect()}


def test_distillation(spark):
    assert rules(spark, GOOD + "\n" + "补充细节说明与检查方法。" * 8, "distillation") == set()
    fields = "\n".join(f"{c}：待补充" for c in ("目标模式", "可执行规则", "不可变项", "内容变量", "负向约束", "适用边界", "验收标准"))
    bad = rules(spark, fields, "distillation")
    assert {"length", "empty_field", "substantive_lines", "substance:不可变项", "substance:验收"} <= bad


def test_collection_and_plan(spark):
    text = "\n".join(f"## {i}. {h}\nx" for i, h in enumerate(reports.COLLECTION[:-1], 1))
    assert rules(spark, text, "collection") == {"heading:运行方式"}
    plan = "目标用户 产品形态 核心流程 MVP 视觉 技术方案 数据流 外部服务 实施 验收"
    assert rules(spark, plan, "plan") == {"concept:风险"}
    assert rules(spark, plan + " 风险 借鉴自别处", "plan") == {"disclosure:attribution"}


def test_common(spark):
    assert rules(spark, "see /home/ann/x and sk-" + "a" * 24 + "\n" * 300, "general") == {"lines", "home_path", "api_key"}
    assert rules(spark, None, "general") == set()


def test_attribution(spark):
    r = spark.createDataFrame([("a", "这个方案借鉴 FooBar 的做法"), ("b", "FooBar is fine" + "。" * 30 + "参考"), ("c", "nothing")], "report_id string, text string")
    n = spark.createDataFrame([("foobar",), ("x",)], "name string")
    assert [x.report_id for x in reports.attributed(r, n).collect()] == ["a"]

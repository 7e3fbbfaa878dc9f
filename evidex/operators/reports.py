"""Checks of written reports: length, secrets, headings, concepts and substance, as violation rows (entity, rule)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions import text as T
from evidex.operators.contracts import Rules, violations

# Headings a collection has, concepts a plan and a distillation cover, and wordings that give a source away.
COLLECTION = ["项目介绍", "适合参考的方向", "核心功能", "技术栈", "项目结构", "核心流程", "数据流", "外部依赖", "UI/交互亮点", "值得借鉴", "整理重点", "缺点", "运行方式"]
PLAN = {
    "目标用户": ["目标用户", "用户与问题", "用户、问题", "用户场景"], "产品形态": ["产品形态", "产品载体", "推荐形态"], "核心路径": ["核心用户路径", "核心流程", "核心循环"], "MVP": ["MVP", "首版范围", "首版功能"],
    "视觉交互": ["视觉", "UI", "交互"], "技术方案": ["技术方案", "技术栈"], "数据": ["数据流", "数据模型", "数据与"], "外部服务": ["外部服务", "第三方服务", "外部依赖"],
    "实施": ["实施顺序", "开发阶段", "里程碑", "实施"], "验收": ["验收标准", "验收"], "风险": ["风险与取舍", "风险"],
}
DISTILLATION = {
    "目标模式": ["忠实重建", "同风格", "目标模式", "再生成目标"], "可执行规律": ["可执行规则", "生成规则", "阶段规则", "视觉规则", "表达规则", "镜头规则", "方法卡"], "不可变项": ["不可变项", "固定项", "必须保留"],
    "内容变量": ["内容变量", "可变项", "允许替换"], "负向约束": ["负向约束", "禁止项", "不要出现", "Don't"], "适用边界": ["适用边界", "不适用", "限制", "失败模式", "边界与代价"], "验收": ["验收表", "验收标准", "复核", "通过条件"],
}
DISCLOSURE = {"collection_file": r"(?i)[A-Za-z0-9_㐀-䶿一-鿿-]+-收录\.md", "source_section": r"(?m)^#{1,6}[ \t]*(?:参考来源|资料来源|引用依据|证据索引)[ \t]*$", "attribution": "(?:借鉴自|参考了.{0,20}(?:项目|资料)|来源映射|检索分数)"}
EMPTY_FIELD = r"(?im)^[ \t]*(?:[-*+][ \t]*)?(?:#{1,6}[ \t]*)?[^：:\n]{1,30}[：:][ \t]*(?:无|未知|待补充|待确认|暂无|不详|未填写|none|null|n/?a|todo|tbd)[ \t]*[。.]?[ \t]*$"
ATTRIBUTION = "(?:参考|借鉴|类似|像|来自|按照|仿照|案例)"


def headings(text: Column) -> Column:
    """Second-level headings without numbers before them."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^##[ \t]+([^\n]*?[^ \t\n])[ \t]*$"), F.lit(1))
    return F.transform(found, lambda h: F.regexp_replace(T.strip(h), r"^[0-9]+[.、][ \t]*", ""))


def common_rules(text: Column, most_lines: int = 250) -> Rules:
    flags = T.secret_flags(text)
    return [("lines", F.size(F.split(F.regexp_replace(text, r"\n$", ""), "\n")) <= most_lines), *[(name, ~flag) for name, flag in flags.items()]]


def collection_rules(text: Column) -> Rules:
    there = headings(text)
    return [(f"heading:{h}", F.array_contains(there, h)) for h in COLLECTION]


def plan_rules(text: Column) -> Rules:
    covered = lambda terms: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))
    return [*[(f"concept:{c}", covered(ts)) for c, ts in PLAN.items()], *[(f"disclosure:{n}", ~text.rlike(p)) for n, p in DISCLOSURE.items()]]


def substance(text: Column, terms: list[str], minimum: int) -> Column:
    """A line that starts with one of the terms says something after it, or, if it is a heading, below it up to the next heading."""
    named = "(?:" + "|".join(t.replace(".", r"\.") for t in terms) + ")"
    heading = rf"(?im)^[ \t]*#{{1,6}}[ \t]*(?:[0-9]+[.、)][ \t]*)?{named}[^\n]*((?:\n(?![ \t]*#)[^\n]*)*)"
    inline = rf"(?im)^[ \t]*(?:[-*+][ \t]*)?(?:[0-9]+[.、)][ \t]*)?{named}[ \t]*[：:]?([^\n]*)$"
    said = F.concat(F.regexp_extract_all(text, F.lit(heading), F.lit(1)), F.regexp_extract_all(text, F.lit(inline), F.lit(1)))
    clean = lambda x: F.regexp_replace(T.squeezed(F.regexp_replace(x, r"[`*_>#-]+", " ")), "^[ ：:。.]+|[ ：:。.]+$", "")
    return F.exists(F.transform(said, clean), lambda x: (F.length(x) >= minimum) & ~F.lower(x).isin(T.PLACEHOLDERS))


def distillation_rules(text: Column) -> Rules:
    low = F.lower(text)
    solid = F.size(F.filter(F.split(text, "\n"), lambda x: F.length(T.strip(F.regexp_replace(x, r"^[ \t#>*+\-0-9.、)]+", ""))) >= 8))
    rules: Rules = [("length", F.length(T.compact(text)) >= 240), ("empty_field", ~text.rlike(EMPTY_FIELD)), ("substantive_lines", solid >= 8)]
    for concept, terms in DISTILLATION.items():
        named = F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(low, t))
        told = substance(text, terms, 2 if concept == "目标模式" else 8)
        if concept == "目标模式":  # naming the mode is enough
            told = told | text.rlike(r"(?m)^[ \t]*(?:[-*+][ \t]*)?(?:#{1,6}[ \t]*)?(?:[0-9]+[.、)][ \t]*)?(?:忠实重建|同风格)")
        rules += [(f"concept:{concept}", named), (f"substance:{concept}", ~named | told)]
    return rules


KINDS = {"general": lambda t: [], "collection": collection_rules, "plan": plan_rules, "distillation": distillation_rules}


def report_violations(reports: DataFrame, kind: str = "general", id_col: str = "report_id", text_col: str = "text", most_lines: int = 250) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return violations(reports, id_col, [*common_rules(text, most_lines), *KINDS[kind](text)])


def attributed(reports: DataFrame, names: DataFrame, id_col: str = "report_id", text_col: str = "text", name_col: str = "name") -> DataFrame:
    """Reports that name a library source within 24 characters of a word of attribution.

    Windows of text around such words are cut first, so names are looked for in few
    characters; the names (at least three characters) are matched by containment, which
    needs every pair of window and name: the smaller side, the library, is the one the
    planner may broadcast by its size.
    """
    around = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(f"(?s)(?=((?:.{{0,88}}){ATTRIBUTION}(?:.{{0,88}})))"), F.lit(1))
    windows = reports.where(F.col(text_col).rlike(ATTRIBUTION)).select(id_col, F.explode(F.array_distinct(around)).alias("w"))
    wanted = names.where(F.length(F.trim(name_col)) >= 3).select(F.lower(F.trim(name_col)).alias("n")).distinct()
    quoted = F.concat(F.lit(r"(?s)"), F.lit(f"{ATTRIBUTION}[^\n]{{0,24}}"), F.lit(r"\Q"), F.col("n"), F.lit(r"\E|\Q"), F.col("n"), F.lit(r"\E"), F.lit(f"[^\n]{{0,24}}{ATTRIBUTION}"))
    return windows.join(wanted, F.contains(F.col("w"), F.col("n")) & F.expr("true")).where(F.regexp_like("w", quoted)).select(id_col).distinct()

"""Reports of judged units as tables: sections, numbers and labels; sinks write them.

Defined cases: unknown types and rules stand for themselves; a null array of types has no label and
names no remote side; units that repeat come out as often; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans import judge

# What reports call remote or a matter of the caller's rights, and their words.
REMOTE_SOURCES = ("http_request", "http_body", "network_accept", "read_message")
AUTH_CATEGORIES = ("identity_verification", "access_control", "origin_validation")
SOURCE_LABELS = {
    "http_request": "HTTP 请求", "http_body": "HTTP 响应/请求体", "network_accept": "网络连接", "read_message": "网络消息",
    "read": "读取", "read_all": "整段读取", "json_decode": "JSON 解码", "xml_decode": "XML 解码", "io_copy": "流复制",
    "buffered_read": "缓冲读取", "scan": "逐行扫描", "channel_recv": "通道接收",
}
RULE_LABELS = {
    "timeout": "实验超时", "build_failed": "测试未能编译", "markers_missing": "实验未产生有效观察",
    "malicious_not_reached": "恶意输入未到达目标代码", "arms_indistinguishable": "两种输入结果无差别",
    "benign_also_bug": "正常输入也出现同样表现", "no_bug_observed": "未观察到问题表现",
    "blocked_by_known_guard": "现有检查拦截了恶意输入", "no_experiment": "未能构造实验", "evidence_missing": "未能定位函数",
    "benign_not_reached": "正常输入也未到达目标代码（前置条件未建立）", "package_unbuildable": "所在包在当前环境无法编译",
    "bug_if_not_evaluable": "判定条件无法对实测值求值", "bug_if_holds_on_malicious_only": "恶意输入满足判定条件",
    "package_needs_infra": "所在包的测试骨架依赖数据库/外部服务，离线环境无法运行",
}
SECTIONS = ("remote", "local", "auth")


def _label(value: Column, labels: dict[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(known, value), value)


def source_labels(types: Column) -> Column:
    """The words for the types of a unit's sources, in their order."""
    return F.array_join(F.transform(types, lambda t: _label(t, SOURCE_LABELS)), "、")


def section(category: Column, types: Column) -> Column:
    """auth for claims that callers upstream may settle, else remote or local by where inputs come from."""
    remote = F.exists(types, lambda t: t.isin(*REMOTE_SOURCES))
    return F.when(category.isin(*AUTH_CATEGORIES), "auth").when(remote, "remote").otherwise("local")


def items(units: DataFrame) -> DataFrame:
    """repo, unit_id, section, n, sources of reproduced units, numbered through the sections of a repository.

    ``units``: repo, unit_id, place, category, source_types, verdict.
    """
    found = units.where(F.col("verdict") == judge.REPRODUCED).withColumn("section", section(F.col("category"), F.col("source_types")))
    turn = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
    n = F.row_number().over(Window.partitionBy("repo").orderBy(turn, "place", "unit_id"))
    return found.select("repo", "unit_id", "section", n.alias("n"), source_labels(F.col("source_types")).alias("sources"))


def appendix(units: DataFrame) -> DataFrame:
    """repo, unit_id, verdict, reason of the units that weren't reproduced."""
    return units.where(F.col("verdict") != judge.REPRODUCED).select("repo", "unit_id", "verdict", _label(F.col("rule"), RULE_LABELS).alias("reason"))


def totals(selected: DataFrame, verdicts: DataFrame) -> DataFrame:
    """repo, commit (ten characters), units, and how many were reproduced, refuted and not reproduced.

    ``selected``: repo, commit, unit_id; ``verdicts``: unit_id, verdict, one a unit.  Units without a
    verdict count among units only.
    """
    n = lambda v: F.count_if(F.col("verdict") == v)
    j = selected.select("repo", F.substring("commit", 1, 10).alias("commit"), "unit_id").join(verdicts.select("unit_id", "verdict"), "unit_id", "left")
    return j.groupBy("repo", "commit").agg(
        F.count("*").alias("units"), n(judge.REPRODUCED).alias("reproduced"), n(judge.REFUTED).alias("refuted"), n(judge.UNREPRODUCED).alias("unreproduced"))

"""What texts say about new images, and the names in them; each document's text is followed by a phrase of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curaspark.functions import text
from curaspark.operators import image_need as needs
from curaspark.sources.tables import table

# phrase, images that it says are published (0: none)
PHRASES = [
    ("", 0), ("公开了3张CG", 3), ("CG公开", 1), ("将公开3张CG", 0), ("公开了新CG", 0), ("公开新CG", 1), ("更新事件CG十二张", 12), ("CG鉴赏更新", 0), ("发布了发售日，CG", 0), ("发布更新内容，包括5张新CG", 5),
    ("Happy Weekend 贺图", 1), ("明天Happy Weekend 贺图", 0), ("尚未公开CG。背景图片更新", 1), ("下周活动，公开2张CG", 0), ("公开key visual", 1), ("公开情报CG", 0), ("插图３枚を公開", 0), ("イラスト公開", 1),
    ("公开了二十三張新規事件CG", 23), ("但是公开4张CG；追加背景", 4), ("不公开CG但追加背景画", 1), ("本周更新:公开　キービジュアル", 1), ("イベント　cg １２枚", 0), ("披露主视觉图！未公开CG", 1),
]
TITLES = [
    ("《花の詩》公开『夜』与《花の詩》", "花の詩|夜", ""), ("《A』B》更新", "A』B", ""), ("星の王 更新 - 原画 山田太郎、佐藤担当", "星の王", "山田太郎"), ("—：月 发售", "月", ""), ("【體驗版】剧本　木下等。脚本 木下", "體驗版", "木下"), ("更新", "", ""),
]


def _pick(values: list, by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def image_need(spark: SparkSession, d: str) -> DataFrame:
    """Whether a document says that images are published now, and how many."""
    x = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), _pick([p for p, _ in PHRASES], F.col("doc_id")))
    return table(spark, d, "documents").select("doc_id", needs.image_need(x).alias("x")).select("doc_id", "x.need", "x.count")


def names_in_titles(spark: SparkSession, d: str) -> DataFrame:
    """Works and people that a title names."""
    title = _pick([t for t, _, _ in TITLES], F.col("doc_id"))
    return table(spark, d, "documents").select("doc_id", F.array_join(text.bracketed(title), "|").alias("works"), F.array_join(text.people(title), "|").alias("people"))


QUERIES = {"image_need": image_need, "names_in_titles": names_in_titles}
ORACLE_SQL = {
    "image_need": f"SELECT doc_id, CASE WHEN n > 0 THEN 'explicit_new_image' ELSE 'unknown' END AS need, n AS count FROM (SELECT doc_id, {[n for _, n in PHRASES]}[doc_id % {len(PHRASES)} + 1]::INTEGER AS n FROM documents)",
    "names_in_titles": f"SELECT doc_id, {[w for _, w, _ in TITLES]!r}[doc_id % {len(TITLES)} + 1] AS works, {[p for _, _, p in TITLES]!r}[doc_id % {len(TITLES)} + 1] AS people FROM documents",
}

"""Whether a text says that images are published now, and how many: by clause, from where words stand.

Every noun for an image is judged by its own clause: a publishing verb before it in that clause (with nothing else as its
object, or with a count), one right after it, or a list that a "new contents" clause introduces. What is not yet, or for
later, does not count. Positions come from native expressions (text.spans), so no row is handed to Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from curaspark.functions import text
from curaspark.operators.classify import ANNOUNCEMENT

# Fixed values.
COUNT, COUNTERS = "[0-9０-９]+|[〇零一二三四五六七八九十百千兩两]+", "张張枚点點幅个個"
NOUNS = [
    r"(?iU)キービジュアル|key\s+visual|主(?:视觉|視覺)(?:图|圖)?|视觉图|視覺圖",
    r"(?iU)(?:事件|イベント)?\s*cg",
    r"背景(?:图片|圖片|画|畫)?",
    r"(?i)插图|插畫|イラスト|贺图|賀圖",
]
VIEWER = r"(?iU)(?:事件|イベント)?\s*cg\s*(?:鉴赏|鑑賞|模式)"
NOT_YET = "尚未|暂未|暫未|还未|還未|不会|不會|即将|即將|将在|將在|将于|將於|将要|將要|计划|計劃|预计|預計|预定|預定|打算|明天|明日|后天|後天|下(?:周|週|个月|個月|月)"
NOT_NOW = rf"(?U){NOT_YET}|未\s*$|不(?:会|會|再|曾)?\s*$|将\s*$|將\s*$"
TURNS = "但是|不过|不過|但|另外|并且|並且|并|並"
OTHER_OBJECTS = "发售日|發售日|体验版|體驗版|系统介绍|系統介紹|收录|收錄|内含|內含|包含|包括|其中|情报|情報|内容|內容|介绍|介紹"
WEEKEND = r"(?iU)happy\s+weekend[^。！？\n]*(?:贺图|賀圖)"
SENTENCE_END, CLAUSE_END, LIST_END = r"[。！？!?\n]+", "[，,]", "[，,；;]"
REACH = 32


def _last(x: Column, ends: str) -> Column:
    return F.element_at(F.split(x, ends, -1), -1)


def _first(x: Column, ends: str) -> Column:
    return F.get(F.split(x, ends, -1), F.lit(0))


def _to(x: Column, end: Column) -> Column:
    return F.substr(x, F.lit(1), end)


def _from(x: Column, start: Column) -> Column:
    return F.substr(x, start + 1)


def _like(x: Column, pattern: str) -> Column:
    return F.regexp_like(x, F.lit(pattern))


def noun_count(sentence: Column, noun: Column) -> Column:
    """The number that stands right before or after a noun (struct start, end), or null."""
    start = F.greatest(noun["start"] - REACH, F.lit(0))
    before = _last(F.substr(sentence, start + 1, noun["start"] - start), r"[，,；;。！？!?\n]")
    after = _first(F.substr(sentence, noun["end"] + 1, F.lit(REACH)), r"[，,；;。！？!?\n]")
    ahead = F.regexp_extract(before, rf"(?U)({COUNT})\s*[{COUNTERS}](?:\s*(?:新|新規|新规|特殊|场景|場景|事件|イベント))*\s*$", 1)
    behind = F.regexp_extract(after, rf"(?iU)^\s*(?:更新|公开|公開|公布|新增|发布|發布)?(?:了)?\s*({COUNT})\s*[{COUNTERS}]", 1)
    return F.when(ahead != "", text.cjk_number(ahead)).when(behind != "", text.cjk_number(behind))


def is_current(clause: Column, start: Column) -> Column:
    """Whether the verb that starts there is about now."""
    return ~_like(_last(_to(clause, start), TURNS), NOT_NOW)


def is_published(sentence: Column, noun: Column) -> Column:
    clauses = F.split(_last(_to(sentence, noun["start"]), "[；;]"), CLAUSE_END, -1)
    local = F.element_at(clauses, -1)

    def says(verb: Column) -> Column:
        target = _from(local, verb["end"])
        bare = _like(target, r"(?U)^(?:了|新|新的|最新)?\s*$")
        return is_current(local, verb["start"]) & ~_like(target, OTHER_OBJECTS) & (noun_count(sentence, noun).isNotNull() | bare)

    suffix = _first(_from(sentence, noun["end"]), LIST_END)
    previous = F.try_element_at(clauses, F.lit(-2))
    introduced = F.get(text.spans(previous, rf"(?iU)(?:{ANNOUNCEMENT})(?:了)?\s*(?:更新内容|更新內容|新情报|新情報)\s*$"), F.lit(0))
    listed = _like(local, rf"(?U)^\s*(?:包括|其中(?:有|包括|包含))\s*(?:{COUNT})\s*[{COUNTERS}](?:新|新規|新规)?\s*$")
    return F.exists(text.spans(local, f"(?i){ANNOUNCEMENT}"), says) | _like(suffix, rf"(?iU)^\s*(?:{ANNOUNCEMENT})") | F.coalesce(introduced.isNotNull() & is_current(previous, introduced["start"]) & listed, F.lit(False))


def image_need(x: Column) -> Column:
    """struct(need, count): explicit_new_image with the count (1 where none is said) of the first noun that counts; else unknown, 0."""
    out = lambda need, n: F.struct(F.lit(need).alias("need"), (n if isinstance(n, Column) else F.lit(n)).cast("int").alias("count"))
    weekend = F.exists(F.split(x, SENTENCE_END, -1), lambda s: _like(s, WEEKEND) & ~_like(s, NOT_YET))

    def counts(sentence: Column) -> Column:
        each = [F.transform(text.spans(sentence, noun), lambda n: F.when(is_published(sentence, n) & ~_like(_to(sentence, n["start"]), NOT_YET), F.coalesce(noun_count(sentence, n), F.lit(0)))) for noun in NOUNS]
        found = F.array_compact(reduce(lambda a, b: F.concat(a, b), each))
        return F.when(_like(sentence, f"(?i){ANNOUNCEMENT}"), found).otherwise(F.array().cast("array<int>"))

    found = F.get(F.flatten(F.transform(F.split(F.regexp_replace(x, VIEWER, ""), SENTENCE_END, -1), counts)), F.lit(0))
    return F.when(F.coalesce(weekend, F.lit(False)), out("explicit_new_image", 1)).when(found.isNotNull(), out("explicit_new_image", F.when(found == 0, 1).otherwise(found))).otherwise(out("unknown", 0))

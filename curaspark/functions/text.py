"""Text expressions. Native, but for Unicode compatibility normalisation, which Spark lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def squash(x: Column) -> Column:
    """White space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def normalized(x: Column, unicode: bool = True) -> Column:
    """NFKC, squashed, casefolded; without unicode (text known to be NFKC-stable) native, with lower()."""
    return squash(nfkc_casefold(x)) if unicode else F.lower(squash(x))


def compact(x: Column, unicode: bool = True) -> Column:
    """Letters and numbers only, NFKC and casefolded; without unicode (text known to be NFKC-stable) native, with lower()."""
    return F.regexp_replace(nfkc_casefold(x) if unicode else F.lower(x), r"[^\p{L}\p{N}]", "")


def word_key(x: Column, unicode: bool = True) -> Column:
    return F.regexp_replace(nfkc_casefold(x) if unicode else F.lower(x), r"(?U)[\W_]+", "")


def portal_key(x: Column, unicode: bool = True) -> Column:
    """Without spaces, punctuation and symbols."""
    return F.regexp_replace(nfkc_casefold(x) if unicode else F.lower(x), r"[\s\p{P}\p{S}]", "")


def has_term(text: Column, term: str) -> Column:
    """ASCII terms need a left boundary and on the right a boundary or digit; others match anywhere."""
    import re

    if re.fullmatch(r"[a-z0-9_-]+", term):
        return F.regexp_like(text, F.lit(rf"(?:^|[^a-z0-9]){re.escape(term)}(?:$|[^a-z])"))
    return F.contains(text, F.lit(term))


def first_term(text: Column, terms: list[str]) -> Column:
    """The first term of the list that the text has, or null."""
    return F.coalesce(*[F.when(has_term(text, t), F.lit(t)) for t in terms])


def safe_title(x: Column, fallback: Column) -> Column:
    """Without the characters that file names cannot have, white space around it and dots at its end; the fallback if nothing is left."""
    kept = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r'[\\/:*?"<>|]', "")), r"\.+$", "")
    return F.when(kept != "", kept).otherwise(fallback)


def snippet(x: Column, length: int = 300) -> Column:
    """One line of at most `length` characters."""
    return F.substring(F.regexp_replace(x, r"[\r\n]+", " "), 1, length)


def ellipsis(x: Column, length: int = 280) -> Column:
    line = F.regexp_replace(x, r"[\r\n]+", " ")
    return F.when(F.char_length(line) > length, F.concat(F.left(line, F.lit(length - 3)), F.lit("..."))).otherwise(line)


def section_label(section: Column, sequence: Column) -> Column:
    """A section's name; one that was decoded wrongly is taken from the place in the document."""
    name = F.coalesce(F.nullif(F.trim(section), F.lit("")), F.lit("news"))
    return F.when(F.contains(name, F.lit("\ufffd")), F.when(sequence <= 10, "新作").otherwise("其他")).otherwise(name)


def section_prefix(section: Column, unicode: bool = True) -> Column:
    """x (new works), h (localizations) or z (all else)."""
    s = F.regexp_replace(nfkc_casefold(section) if unicode else F.lower(section), r"(?U)\s+", "")
    return F.when(F.contains(s, F.lit("新作")), "x").when(F.contains(s, F.lit("汉化")) | F.contains(s, F.lit("漢化")), "h").otherwise("z")


def glued_urls(x: Column) -> Column:
    """All URLs of a text, also where one follows another without a space; closing punctuation cut off."""
    found = F.regexp_extract_all(x, F.lit(r"https?://(?:(?!https?://)[^\s])*"), F.lit(0))
    return F.transform(found, lambda u: F.regexp_replace(u, r"[。，、；！？）】》」』,.;!?)]+$", ""))


def redact(x: Column) -> Column:
    """Credentials out of messages: bearer tokens, key=value pairs, query parameters."""
    x = F.regexp_replace(x, r"(?i)(bearer)\s+[a-z0-9._~+/=-]+", "$1 [redacted]")
    return F.regexp_replace(x, r"(?i)\b(api[_-]?key|token|secret|password|authorization)\b(\s*[=:]\s*)[^\s&,;]+", "$1$2[redacted]")


# Kinds of errors and their codes.
ERROR_CODES = {
    "permission": ("file_permission", True), "not_found": ("file_missing", False), "database_locked": ("sqlite_locked", True), "json": ("corrupt_json", False), "unicode": ("corrupt_json", False),
    "image": ("image_decode", False), "connection": ("connect", True), "protocol": ("connect", True), "database": ("sqlite_error", False),
}


def diagnosis(kind: Column, status: Column, message: Column) -> Column:
    """struct(code, retryable) of an error's kind, HTTP status and message: the first rule that holds decides."""
    m, out = F.lower(F.coalesce(message, F.lit(""))), lambda c, r: F.struct(F.lit(c).alias("code"), r.alias("retryable"))
    yes, no = F.lit(True), F.lit(False)
    broken = F.regexp_like(m, F.lit("broken data stream|image file is truncated|cannot identify image"))
    named = F.when(kind == "timeout", out("timeout", yes)).when(status == 429, out("http_429", yes)).when(status.isNotNull(), out("http_error", status >= 500))
    for name, (code, again) in ERROR_CODES.items():
        here = kind == name
        if name == "database_locked":
            here = here | ((kind == "database") & F.contains(m, F.lit("locked")))
        if name == "image":
            here = here | ((kind == "os") & broken)
        named = named.when(here, out(code, F.lit(again)))
    return named.otherwise(out("error", no))


def stripped(x: Column) -> Column:
    """Without white space at both ends, all that Unicode calls so."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def spans(x: Column, pattern: str) -> Column:
    """Where a pattern matches: array of struct(start, end), counted from 0; the pattern must not match nothing."""
    hits, gaps = F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), F.split(x, pattern, -1)
    size = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda s, p: s + F.char_length(p))

    def span(hit: Column, i: Column) -> Column:
        start = size(gaps, i + 1) + size(hits, i)
        return F.struct(start.alias("start"), (start + F.char_length(hit)).alias("end"))

    return F.transform(hits, span)


def first_date(x: Column) -> Column:
    """The first 20YY-M-D (also with 年月日, dots or slashes); null where it is no date."""
    part = lambda i: F.nullif(F.regexp_extract(x, r"(20\d{2})[年./-](\d{1,2})[月./-](\d{1,2})日?", i), F.lit("")).cast("int")
    zero = F.lit(0)
    return F.try_make_timestamp(part(1), part(2), part(3), zero, zero, zero.cast("decimal(8,6)"))


def cjk_number(x: Column) -> Column:
    """Full-width and Arabic digits as they are, else Chinese numerals up to thousands."""
    digits = F.translate(x, "０１２３４５６７８９", "0123456789")
    step = lambda acc, c: (
        F.when(c == "u1", F.struct((acc["total"] + F.when(acc["cur"] == 0, 1).otherwise(acc["cur"]) * 10).alias("total"), F.lit(0).alias("cur")))
        .when(c == "u2", F.struct((acc["total"] + F.when(acc["cur"] == 0, 1).otherwise(acc["cur"]) * 100).alias("total"), F.lit(0).alias("cur")))
        .when(c == "u3", F.struct((acc["total"] + F.when(acc["cur"] == 0, 1).otherwise(acc["cur"]) * 1000).alias("total"), F.lit(0).alias("cur")))
        .otherwise(F.struct(acc["total"].alias("total"), F.coalesce(c.try_cast("int"), acc["cur"]).alias("cur")))
    )
    plain = F.translate(x, "零〇一二两兩三四五六七八九", "0012223456789")
    named = F.transform(F.split(plain, ""), lambda c: F.when(c == "十", "u1").when(c == "百", "u2").when(c == "千", "u3").otherwise(c))
    folded = F.aggregate(named, F.struct(F.lit(0).alias("total"), F.lit(0).alias("cur")), step, lambda acc: acc["total"] + acc["cur"])
    return F.when(F.regexp_like(digits, F.lit(r"^\d+$")), digits.try_cast("int")).otherwise(folded)


def bracketed(title: Column) -> Column:
    """Names in the four kinds of brackets, in order, each once; else what comes before a publishing verb."""
    quoted = F.regexp_extract_all(title, F.lit("《[^》]+》|『[^』]+』|「[^」]+」|【[^】]+】"), F.lit(0))
    inner = F.transform(quoted, lambda s: stripped(F.substr(s, F.lit(2), F.char_length(s) - 2)))
    before = F.regexp_replace(F.regexp_replace(title, r"(?:发售|発売|公布|公开|公開|更新|完成|制作|製作|体验版|體驗版)[\s\S]*$", ""), "^[ —:：-]+|[ —:：-]+$", "")
    return F.when(F.size(quoted) > 0, F.array_distinct(F.filter(inner, lambda s: s != ""))).when(before != "", F.array(before)).otherwise(F.array().cast("array<string>"))


def people(x: Column) -> Column:
    """The first name after each word for drawing or writing, each once."""
    after = F.regexp_extract_all(x, F.lit(r"(?U)(?:原画|原畫|剧本|劇本|脚本|シナリオ|插画|插畫|绘制|繪製)\s*([^。！？\n]+)"), F.lit(1))
    names = F.transform(after, lambda s: stripped(F.get(F.split(s, "负责|担当|等|以及|和|、|,|，|绘制|繪製", -1), F.lit(0))))
    return F.array_distinct(F.filter(names, lambda s: s != ""))


def organizations(x: Column) -> Column:
    found = F.regexp_extract_all(x, F.lit(r"\b([A-Z][A-Za-z0-9&.-]*(?:SOFT|GAMES|WORKS|STUDIO|ENTERTAINMENT))"), F.lit(1))
    return F.array_distinct(found)


def clamp(x: Column, low: float, high: float, default: float) -> Column:
    """x as a number within bounds; the default where it is none."""
    number = x.try_cast("double")
    return F.when(number.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), number))).otherwise(F.lit(default))  # least() skips nulls


def freshness(published: Column, now: Column) -> Column:
    days = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(published)) / F.lit(86_400_000_000.0))
    return F.when(published.isNotNull() & now.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - days / 365.0))).otherwise(F.lit(0.0))

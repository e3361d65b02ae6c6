"""Word-processor documents: paragraphs, then entries."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PARAGRAPH = "issue string, idx int, text string, all_bold boolean, font_sizes array<int>, error string"
# Fixed values.
HEADING = r"^\s*([^#\n]+?)\s*#\s*([^#\n]+?)\s*#?\s*$"
SECTIONS = ["新作", "旧作", "舊作", "动画", "動畫", "周边", "周邊", "业界", "業界", "其他", "其它", "汉化", "漢化"]
PREAMBLES = ["目录", "目錄", "索引", "内容", "內容", "周报目录", "周報目錄"]
LOCALIZATIONS = r"^[汉漢]化(?:信息|情報|新闻|新聞)?$"


def paragraphs_of(content: bytes) -> list[tuple[str, bool, list[int]]]:
    """(text, whether all runs are bold, font sizes in half-points) of each paragraph with text."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    out = []
    for p in root.iter(f"{W}p"):
        runs = [(r, "".join(t.text or "" for t in r.iter(f"{W}t"))) for r in p.iter(f"{W}r")]
        runs = [(r, t) for r, t in runs if t.strip()]
        text = "".join(t for _, t in runs).strip()
        if not text:
            continue
        bold = [(b := r.find(f"{W}rPr/{W}b")) is not None and b.get(f"{W}val") not in ("0", "false") for r, _ in runs]
        sizes = sorted({int(s.get(f"{W}val")) for r, _ in runs if (s := r.find(f"{W}rPr/{W}sz")) is not None})
        out.append((text, all(bold), sizes))
    return out


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """PARAGRAPH rows of all .docx files of a path; a file that cannot be read is one row with its error."""

    def run(frames):
        for pdf in frames:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                issue = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    rows += [(issue, i, t, b, s, None) for i, (t, b, s) in enumerate(paragraphs_of(content))]
                except Exception as e:  # failures are rows
                    rows.append((issue, None, None, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=["issue", "idx", "text", "all_bold", "font_sizes", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, PARAGRAPH)


def is_heading(text: Column) -> Column:
    """`title # author`, with no URL."""
    return F.regexp_like(text, F.lit(HEADING)) & ~F.regexp_like(text, F.lit("(?i)https?://"))


def is_section(text: Column) -> Column:
    """A known section's name of at most 16 characters; a table of contents' title is none."""
    line = F.trim(text)
    known = line.isin(SECTIONS) | F.regexp_like(line, F.lit(LOCALIZATIONS))
    return known & (F.char_length(line) <= 16) & ~line.isin(PREAMBLES) & ~F.contains(line, F.lit("#")) & ~F.regexp_like(line, F.lit("(?i)https?://|[。！？.!?]$"))


def entries(paragraphs: DataFrame) -> DataFrame:
    """(issue, sequence, section, title, author, body) from paragraphs in order of idx.

    A heading, or a bold paragraph of size 30 alone before a plain one of size 22 alone, opens an entry; section labels carry forward.
    """
    w = Window.partitionBy("issue").orderBy("idx")
    after = lambda c: F.lead(c).over(w)
    only = lambda c, n: F.coalesce(c == F.array(F.lit(n)), F.lit(False))
    styled = F.col("all_bold") & only(F.col("font_sizes"), 30) & ~F.coalesce(after("all_bold"), F.lit(True)) & only(after("font_sizes"), 22)
    marked = paragraphs.where("error is null").withColumns({"label": is_section(F.col("text")), "opens": is_heading(F.col("text")) | styled})
    marked = marked.withColumn("opens", F.col("opens") & ~F.col("label"))
    marked = marked.withColumns({
        "section": F.last(F.when(F.col("label"), F.col("text")), True).over(w),
        "sequence": F.sum(F.col("opens").cast("int")).over(w),
    })
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("opens"), F.struct("idx", "text")))), lambda x: x["text"]), "\n")
    head = F.max(F.when(F.col("opens"), F.col("text")))
    out = marked.where("not label and sequence > 0").groupBy("issue", "sequence").agg(F.min_by("section", "idx").alias("section"), head.alias("head"), body.alias("body"))
    title = F.coalesce(F.nullif(F.trim(F.regexp_extract("head", HEADING, 1)), F.lit("")), F.col("head"))
    return out.select("issue", "sequence", "section", title.alias("title"), F.nullif(F.trim(F.regexp_extract("head", HEADING, 2)), F.lit("")).alias("author"), "body")

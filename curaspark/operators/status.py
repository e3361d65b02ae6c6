"""Status of candidates and items: sections, outcomes of downloads, failures, orders, counts and comparisons of runs.

Orders within an item are windows over the item and end in its id, so that ties have one result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curaspark.functions import text, urls
from curaspark.operators.selection import pixels

# Fixed values.
IMAGE_PATH = r"\.(jpg|jpeg|png|webp|gif|avif)$"
ENRICHED = ["game_names", "organizations", "people", "event_type", "event_at", "keywords", "importance", "image_need"]
FINAL_FAILURES = ["unsafe_url", "response_too_large", "placeholder_image"]
MAGIC = [("image/png", "89504E470D0A1A0A", 0), ("image/jpeg", "FFD8FF", 0), ("image/gif", "47494638", 0), ("image/webp", "57454250", 8), ("image/avif", "6674797061766966", 4)]
MAX_BYTES = 12_582_912


def sectioned(items: DataFrame, sections: list[str], unicode: bool = True) -> DataFrame:
    """Adds label, prefix and folder (the prefix and the number within the issue, by sequence) to (issue, id, section,
    sequence), then keeps the chosen prefixes."""
    label = text.section_label(F.col("section"), F.col("sequence"))
    out = items.withColumn("label", label).withColumn("prefix", text.section_prefix(F.col("label"), unicode))
    number = F.row_number().over(Window.partitionBy("issue", "prefix").orderBy("sequence", "id"))
    return out.withColumn("folder", F.concat("prefix", number)).where(F.col("prefix").isin(sections))


def offline(sources: DataFrame) -> DataFrame:
    """Sources that need no page: videos and images."""
    return sources.where(F.col("source_type").isin("video", "direct_image") | F.regexp_like(F.lower(urls.path(F.col("url"))), F.lit(IMAGE_PATH)))


def meaningless(u: Column) -> Column:
    p = F.lower(urls.path(u))
    return F.when(p.endswith(".svg") | F.contains(p, F.lit("profile_images")) | F.contains(p, F.lit("editorui/fonts")), "invalid_material")


def dimension(x: Column) -> Column:
    """A positive whole number, else null."""
    n = x.try_cast("int")
    return F.when(n > 0, n)


def tier(u: Column, width: Column, height: Column, declared: Column) -> Column:
    """The declared resolution, or unknown where the dimensions or a WxH in the path say less than 800 x 450."""
    at = lambda i: F.regexp_extract(urls.path(u), r"(?i)(?:^|[._-])(\d{2,4})x(\d{2,4})(?:[._-]|$)", i).try_cast("int")
    small = lambda w, h: F.coalesce((w < 800) | (h < 450), F.lit(False))
    known = dimension(width).isNotNull() & dimension(height).isNotNull()
    return F.when((known & small(width, height)) | small(at(1), at(2)), "unknown").otherwise(declared)


def moment(x: Column, now: Column) -> Column:
    """An ISO time; now if it is none."""
    return F.coalesce(x.try_cast("timestamp"), now)


def mime(data: Column) -> Column:
    """The kind of an image by its first bytes."""
    at = lambda skip, sign: F.substring(F.hex(F.substring(data, 1, 32)), 2 * skip + 1, len(sign)) == sign
    return reduce(lambda c, m: c.when(at(m[2], m[1]), m[0]), MAGIC[1:], F.when(at(MAGIC[0][2], MAGIC[0][1]), MAGIC[0][0]))


def image_fault(data: Column, width: Column, height: Column) -> Column:
    """Why an image is refused, or null: too many bytes, no known kind, not decoded (no size), or under 16 pixels."""
    return (
        F.when(F.octet_length(data) > MAX_BYTES, "image_too_large").when(mime(data).isNull(), "invalid_magic")
        .when(width.isNull() | height.isNull(), "corrupt_image").when((width < 16) | (height < 16), "tracking_pixel")
    )


def apply_outcomes(candidates: DataFrame, failures: DataFrame) -> DataFrame:
    """Candidates with the outcome of their download: a failure (candidate_id, code, retryable; one a candidate) clears the
    path and sets the status."""
    f = failures.select("candidate_id", F.col("code").alias("f_code"), F.col("retryable").alias("f_retryable"))
    failed = F.col("f_code").isNotNull()
    out = candidates.join(f, "candidate_id", "left")
    return out.withColumns({
        "downloadable": F.when(failed, False).otherwise(F.col("downloadable")),
        "local_path": F.when(~failed, F.col("local_path")),
        "download_status": F.when(failed & F.col("f_retryable"), "retryable_failed").when(failed, "permanent_failed").otherwise(F.col("download_status")),
        "invalid_reason": F.coalesce("f_code", "invalid_reason"),
    }).drop("f_code", "f_retryable")


def needs_download(candidates: DataFrame, failures: DataFrame) -> DataFrame:
    """Candidates to fetch: not reusable, not failed for good; a pending one with a reason only if a failure of its download may be retried."""
    again = failures.where((F.col("stage") == "download") & F.col("retryable")).select(F.col("candidate_id").alias("again")).distinct()
    out = candidates.join(again, F.col("candidate_id") == F.col("again"), "left")
    stuck = (F.col("download_status") == "pending") & F.col("invalid_reason").isNotNull() & F.col("again").isNull()
    return out.where(~F.col("reusable") & (F.col("download_status") != "permanent_failed") & ~stuck).drop("again")


def fallback_allowed(primary: Column, raw: Column, photo: Column, code: Column) -> Column:
    """Whether the unchanged URL of a post's photo may be tried after a failure."""
    media = (urls.scheme(raw) == "https") & (urls.netloc(raw) == "pbs.twimg.com") & urls.path(raw).startswith("/media/")
    return F.coalesce(code.isNotNull() & raw.isNotNull() & (raw != primary) & photo & media & ~code.isin(FINAL_FAILURES), F.lit(False))


def reviewable_failed(c: DataFrame) -> DataFrame:
    return c.where(~F.col("selected") & (F.col("curation_status") != "invalid") & F.col("downloadable") & F.col("local_path").isNotNull())


def best_first() -> list[Column]:
    """Posts' photos first, then score, trust and size."""
    return [F.desc("x_photo"), F.desc(F.coalesce("total", F.lit(0.0))), F.desc(F.coalesce("trust", F.lit(0.0))), F.desc(pixels()), F.asc("candidate_id")]


def delivered(c: DataFrame, limit: int) -> DataFrame:
    """Adds place, the candidate's in its item's output, and takes the selection from those selected beyond the limit."""
    w = Window.partitionBy("item_id").orderBy(*best_first())
    taken = F.sum(F.col("selected").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return c.withColumns({"place": F.row_number().over(w), "kept": F.col("selected") & (taken <= limit)})


def enriched(baseline: DataFrame, found: DataFrame, key: str = "sequence") -> DataFrame:
    """Baseline rows with the allowed fields of the enrichment of the same sequence; its nulls change nothing."""
    fields = [c for c in ENRICHED if c in baseline.columns and c in found.columns]
    f = found.select(key, *[F.col(c).alias(f"new_{c}") for c in fields])
    return baseline.join(f, key, "left").withColumns({c: F.coalesce(f"new_{c}", c) for c in fields}).drop(*[f"new_{c}" for c in fields])


def media_counts(c: DataFrame, by: str) -> DataFrame:
    """Posts' photos: attachments, downloaded, pending, failed (one to be retried counts in both); and all candidates by status."""
    s, photo = F.col("download_status"), F.col("x_photo")
    n = lambda x, name: F.count_if(x).alias(name)
    return c.groupBy(by).agg(
        n(photo, "x_attachments"), n(photo & (s == "downloaded"), "x_downloaded"), n(photo & s.isin("pending", "retryable_failed"), "x_pending"), n(photo & s.isin("retryable_failed", "permanent_failed"), "x_failed"),
        n(F.col("selected"), "selected"), *[n(s == x, x) for x in ("downloaded", "pending", "retryable_failed", "permanent_failed")],
        n(F.col("local_path").isNotNull() & (s == "downloaded"), "success_count"), n(s.isin("pending", "retryable_failed", "permanent_failed"), "failed_count"),
    )


def zero_selected(c: DataFrame, by: str) -> DataFrame:
    return c.groupBy(by).agg(F.bool_or("selected").alias("any")).agg(F.count_if(~F.col("any")).alias("zero_selected"))


def role_metrics(rows: DataFrame, role: str) -> DataFrame:
    """Counts, precision among the selected and retention of one image type; null where there is nothing to divide by."""
    label, said = F.col("type_label"), F.col("type_prediction") == role
    typed, true = label.isNotNull(), F.coalesce(label == role, F.lit(False))
    chosen = said & F.col("selected")
    kept = true & F.col("file_valid") & F.col("curation_status").isin("selected", "unselected")
    ratio = lambda a, b: F.round(F.count_if(a) / F.nullif(F.count_if(b), F.lit(0)), 6)
    return rows.agg(
        F.count_if(typed).alias("labeled_count"), F.count_if(true).alias("true_count"), F.count_if(said).alias("predicted_count"), F.count_if(chosen).alias("selected_count"),
        F.count_if(chosen & typed).alias("labeled_selected_count"), ratio(chosen & true, chosen & typed).alias("selected_precision"),
        ratio(kept, true).alias("retention"), F.count_if(kept).alias("retained_count"),
    )


def seen_images(rows: DataFrame) -> DataFrame:
    """History of (image_id, issue, ord, path) in order of arrival: first and last issue, and the last path that is known."""
    return rows.groupBy("image_id").agg(F.min_by("issue", "ord").alias("first_seen"), F.max_by("issue", "ord").alias("last_seen"), F.max_by("path", F.when(F.col("path").isNotNull(), F.col("ord"))).alias("local_path"))


def alternates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For keys of several rows (root, ord): the first root and that of the last duplicate, joined; each once."""
    first, last = F.min_by("root", "ord"), F.max_by("root", "ord")
    joined = F.array_join(F.array_distinct(F.filter(F.array(first, last), lambda x: F.coalesce(x, F.lit("")) != "")), "|")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), joined.alias("alternates")).where("n > 1").drop("n")


def capped_sources(rows: DataFrame, by: str, order: list[Column], cap: int = 16, budget: int | None = None) -> DataFrame:
    """Official sources up to the cap of each item in order, others freely; with a budget, that many in all."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("n", F.sum(F.col("official").cast("int")).over(w)).where(~F.col("official") | (F.col("n") <= cap)).drop("n")
    if budget is not None:
        out = out.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("n") <= budget).drop("n")
    return out


def merged_sources(stages: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of source lists in the order of their stages; of equal keys the first stays, with its stage. No window: one aggregate."""
    every = reduce(DataFrame.unionByName, [s.withColumn("stage", F.lit(i)) for i, s in enumerate(stages)])
    rest = [c for c in every.columns if c not in keys]
    first = F.min(F.struct("stage", "ord", *[c for c in rest if c not in ("stage", "ord")]))
    return every.groupBy(*keys).agg(first.alias("x")).select(*keys, *[F.col(f"x.{c}") for c in rest])


def checkpoint_valid(checkpoints: DataFrame, expected: dict) -> DataFrame:
    """Adds valid and the first field that differs from what is expected."""
    wrong = F.coalesce(*[F.when(~F.col(k).eqNullSafe(F.lit(v)), F.lit(k)) for k, v in expected.items()])
    return checkpoints.withColumns({"mismatch": wrong, "valid": wrong.isNull()})


def parity(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row: whether two runs have the same rows in the columns, and whether successes and selections are not fewer."""
    mark = lambda x, side: x.select(*keys).withColumn("side", F.lit(side))
    counted = mark(old, 1).unionByName(mark(new, -1)).groupBy(*keys).agg(F.sum("side").alias("d")).agg(F.count_if(F.col("d") != 0).alias("different"))
    n = lambda x, p: x.agg(F.count_if("downloadable").alias(f"{p}_ok"), F.count_if("selected").alias(f"{p}_selected"))
    out = counted.join(n(old, "old")).join(n(new, "new"))  # three single rows
    return out.select((F.col("different") == 0).alias("equal"), (F.col("new_ok") >= F.col("old_ok")).alias("successes_not_lower"), (F.col("new_selected") >= F.col("old_selected")).alias("selected_not_lower"))

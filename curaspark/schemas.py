"""Explicit schemas of the engine's relations and their closed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
EVENT_TYPES = ["new_title", "release", "demo", "update", "event", "goods", "localization", "unknown"]
SOURCE_TYPES = ["official_site", "official_x", "steam", "direct_image", "video", "unverified", "unknown"]
IMAGE_TYPES = ["game_cg", "background_art", "decorative", "gameplay_screenshot", "key_visual", "character_art", "cover", "announcement_art", "goods", "logo", "banner", "ui", "photo", "unknown"]
CURATION_STATUSES = ["selected", "unselected", "invalid", "unknown"]
FAILURE_STAGES = ["parse", "analyze", "resolve", "collect", "download", "curate", "output", "history", "unknown"]
DOWNLOAD_STATUSES = ["pending", "downloaded", "retryable_failed", "permanent_failed"]
DECISIONS = ["accepted", "pending", "rejected"]


def _schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


ITEM = "issue_id string, item_id string, sequence int, section string, title string, author string, body string, game_names array<string>, organizations array<string>, people array<string>, event_type string, event_at timestamp, keywords array<string>, source_urls array<string>, importance double, image_need string"
SOURCE = "item_id string, url string, source_type string, domain string, discovered_via string, officiality double, requires_review boolean, review_reasons array<string>, root_url string, parent_url string, navigation_kind string, navigation_text string"
EVIDENCE = "struct<page_url:string,container:string,item_id:string,role:string,text:string,method:string,relationship:string,variant_of:string>"
SCORE = "struct<relevance:double,freshness:double,source_trust:double,quality:double,duplicate_penalty:double,risk_penalty:double,type_match:double,total:double>"
CANDIDATE = f"item_id string, candidate_id string, image_url string, source_url string, source_type string, image_type string, type_confidence double, width int, height int, original_width int, original_height int, byte_size long, sha256 string, perceptual_hash string, published_at timestamp, fetched_at timestamp, download_status string, curation_status string, review_reasons array<string>, evidence array<{EVIDENCE}>, score {SCORE}, selected boolean"
FAILURE = "stage string, item_id string, candidate_id string, code string, message string, source_url string, retryable boolean, occurrences int, occurred_at timestamp"
POST = "id string, text string, createdAt string, author struct<name:string,userName:string>, likeCount long, retweetCount long, lang string, url string"


def known(value: Column, vocabulary: list[str], default: str = "unknown") -> Column:
    """The value if its vocabulary has it, else the default: unknown members never fail."""
    return F.when(value.isin(vocabulary), value).otherwise(F.lit(default))


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for every row and rule that does not hold: checks give rows, not errors. Null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.col(key), F.explode(broken).alias("rule"))

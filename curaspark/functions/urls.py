"""URL expressions: one anchored pattern splits a URL, named projections of its parts follow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
# Fixed values.
SENSITIVE = ["token", "access_token", "auth", "authorization", "key", "api_key", "apikey", "secret", "signature", "sig"]
SIZE_PARAMS = ["w", "h", "width", "height", "resize", "fit", "crop", "q", "quality"]
SIZED_HOSTS = ["images.ctfassets.net", "i0.wp.com", "cdn.discordapp.com"]
IMAGE_SUFFIX = r"\.(jpg|jpeg|png|webp|gif|avif)$"
IMAGE_FOLDERS = r"/(gallery|cg|images|media|screenshot|screenshots)/"


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, PARTS, 1))


def netloc(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, PARTS, 2))


def host(u: Column) -> Column:
    """Without credentials, port and trailing dot."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(netloc(u), r"^.*@", ""), r":[0-9]*$", ""), r"\.$", "")


def path(u: Column) -> Column:
    return F.regexp_extract(u, PARTS, 3)


def query(u: Column) -> Column:
    return F.regexp_extract(u, PARTS, 4)


def fragment(u: Column) -> Column:
    return F.regexp_extract(u, PARTS, 5)


def _with(s: Column, n: Column, p: Column, q: Column, f: Column | None = None) -> Column:
    out = F.concat(s, F.lit("://"), n, p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return out if f is None else F.concat(out, F.when(f != "", F.concat(F.lit("#"), f)).otherwise(""))


def normalized(u: Column) -> Column:
    """Scheme and host lower-cased, path and query as they are, no fragment."""
    return F.when(F.regexp_like(u, F.lit(PARTS)), _with(scheme(u), netloc(u), path(u), query(u))).otherwise(u)


def navigation(u: Column) -> Column:
    """As normalized, but an empty path is / and a fragment stays if it names a gallery."""
    p = F.when(path(u) == "", "/").otherwise(path(u))
    f = F.when(F.regexp_like(F.lower(fragment(u)), F.lit("gallery|graphic")), fragment(u)).otherwise("")
    return _with(scheme(u), netloc(u), p, query(u), f)


def source_key(u: Column) -> Column:
    """Equal for pages that differ only in a closing slash or fragment."""
    return F.concat_ws("|", scheme(u), netloc(u), F.regexp_replace(path(u), "/+$", ""), query(u))


def visit_key(u: Column) -> Column:
    return F.concat_ws("|", source_key(u), fragment(u))


def params(u: Column) -> Column:
    return F.filter(F.split(query(u), "&"), lambda p: p != "")


def without_params(u: Column, drop) -> Column:
    kept = F.array_join(F.filter(params(u), lambda p: ~drop(F.lower(F.split_part(p, F.lit("="), F.lit(1))))), "&")
    return _with(scheme(u), netloc(u), path(u), kept, fragment(u))


def redacted(u: Column) -> Column:
    """Without query parameters that carry credentials."""
    return F.when(F.regexp_like(u, F.lit(PARTS)), without_params(u, lambda k: k.isin(SENSITIVE) | k.startswith("x-amz-"))).otherwise(u)


def within(h: Column, names: list[str]) -> Column:
    """Whether a host is one of the names or a subdomain of one."""
    out = F.lit(False)
    for n in names:
        out = out | (h == n) | h.endswith("." + n)
    return out


def upgraded(u: Column) -> Column:
    """The original of a resized image URL."""
    h = host(u)
    x_photo = (h == "pbs.twimg.com") & path(u).startswith("/media/")
    rest = F.filter(params(u), lambda p: ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin("name", "width", "height"))
    original = _with(scheme(u), netloc(u), F.regexp_replace(path(u), "(?i):(small|medium|large|orig|thumb)$", ""), F.array_join(F.array_append(rest, F.lit("name=orig")), "&"))
    p = F.regexp_replace(path(u), r"(?i)[-_]\d{2,5}x\d{2,5}(\.[a-z0-9]{2,5})$", "$1")
    p = F.when(F.contains(h, F.lit("cloudinary.com")), F.regexp_replace(p, r"(?i)/(?:f_[^,/]+,?|q_[^,/]+,?|w_\d+,?|h_\d+,?|c_[^,/]+,?)+(?=/)", "")).otherwise(p)
    kept = F.filter(params(u), lambda x: ~(h.isin(SIZED_HOSTS) & F.lower(F.split_part(x, F.lit("="), F.lit(1))).isin(SIZE_PARAMS)))
    return F.when(h == "pbs.twimg.com", F.when(x_photo, original).otherwise(u)).otherwise(_with(scheme(u), netloc(u), p, F.array_join(kept, "&"), fragment(u)))


def srcset_largest(value: Column) -> Column:
    """The candidate of greatest width or density; of equal ones the first."""
    entries = F.filter(F.transform(F.split(value, ","), lambda s: F.split(F.trim(s), r"\s+")), lambda b: b[0] != "")
    weighed = F.transform(entries, lambda b, i: F.struct(F.coalesce(F.nullif(F.regexp_extract(F.get(b, F.lit(1)), r"^(\d+)[wx]$", 1), F.lit("")).try_cast("int"), F.lit(0)).alias("w"), (-i).alias("o"), b[0].alias("u")))
    return F.get(F.reverse(F.array_sort(weighed)), F.lit(0))["u"]


def looks_like_image(u: Column) -> Column:
    p = F.lower(path(u))
    return F.regexp_like(p, F.lit(IMAGE_SUFFIX)) | (F.regexp_like(F.concat(p, F.lit("/")), F.lit(IMAGE_FOLDERS)) & ~p.endswith("/"))


def image_priority(u: Column) -> Column:
    p = F.lower(path(u))
    gallery = F.regexp_like(p, F.lit(r"/gallery/|/cg/|/(cg|gallery|ss[_-]?)\d+[^/]*$"))
    return F.when(gallery, 0).when(F.regexp_like(p, F.lit("/screenshot|/sample|/points/")), 1).otherwise(2)


def public_x_media(u: Column) -> Column:
    p = F.lower(path(u))
    return (scheme(u) == "https") & netloc(u).isin("pbs.twimg.com", "pbs.twimg.com:443") & F.regexp_like(p, F.lit("^/(media|card_img)/")) & ~p.endswith("/")


def steam_apps(x: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit(r"store\.steampowered\.com/app/([0-9]+)"), F.lit(1))))


def canonical_video(u: Column) -> Column:
    """One address for a video however it is linked; null where it is none."""
    h = host(u)
    tube = F.coalesce(
        F.nullif(F.when(h == "youtu.be", F.regexp_extract(path(u), r"^/([A-Za-z0-9_-]{6,})", 1)), F.lit("")),
        F.nullif(F.regexp_extract(path(u), r"^/(?:embed|shorts|live)/([A-Za-z0-9_-]{6,})", 1), F.lit("")),
        F.nullif(F.regexp_extract(query(u), r"(?:^|&)v=([A-Za-z0-9_-]{6,})", 1), F.lit("")),
    )
    status = F.nullif(F.regexp_extract(path(u), r"^/([^/]+/status/\d+)", 1), F.lit(""))
    return (
        F.when(within(h, ["youtube.com", "youtu.be"]) & tube.isNotNull(), F.concat(F.lit("https://www.youtube.com/watch?v="), tube))
        .when(within(h, ["x.com", "twitter.com"]) & status.isNotNull(), F.concat(F.lit("https://x.com/"), status))
        .when(F.regexp_like(F.lower(path(u)), F.lit(r"\.(mp4|webm|m3u8)$")), normalized(u))
    )


# Address ranges that no page of the public network has, as patterns of their literals.
PRIVATE_V4 = (
    r"^(?:0|10|127)\.|^169\.254\.|^192\.168\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\."
    r"|^192\.0\.[02]\.|^198\.(?:1[89]|51\.100)\.|^203\.0\.113\.|^2(?:2[4-9]|[3-5][0-9])\."
)
PLAIN_V4 = r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$"
OTHER_V4 = r"^(?:0x[0-9a-f]*|[0-9]+)(?:\.(?:0x[0-9a-f]*|[0-9]+)){0,3}$"
PUBLIC_V6, PRIVATE_V6 = r"^\[[23][0-9a-f]{3}:", r"^\[(?:2001:0?db8:|2001:(?:0{0,3}|[01]?[0-9a-f]{1,2}):|2002:)"


def safe_target(u: Column) -> Column:
    """http or https, no credentials, no literal address of a private, loopback or reserved range, however it is written.

    Addresses in one number, in hexadecimal or octal are refused whatever they mean, and so are mapped ones.
    """
    h = F.regexp_replace(F.lower(host(u)), r"\.$", "")
    plain = F.regexp_like(h, F.lit(PLAIN_V4))
    local = (h == "localhost") | h.endswith(".localhost") | (plain & F.regexp_like(h, F.lit(PRIVATE_V4))) | (~plain & F.regexp_like(h, F.lit(OTHER_V4)))
    six = h.startswith("[") & ~(F.regexp_like(h, F.lit(PUBLIC_V6)) & ~F.regexp_like(h, F.lit(PRIVATE_V6)))
    return scheme(u).isin("http", "https") & (h != "") & ~F.contains(netloc(u), F.lit("@")) & ~local & ~six

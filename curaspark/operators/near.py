"""Near copies within an item: confirmed pairs, and the election of one representative of each scene.

A sequential rule decides who represents: candidates come in representative order, and one that matches an earlier
representative (same file hash, or a perceptual hash within `distance` bits that a comparison of the pixels confirms) is its
duplicate. Only representatives suppress, so the relation is not transitive. The same result comes from rounds over all items
at once: a candidate with no undecided match before it represents; whoever has a representative before it among its
matches is a duplicate; the others wait. A round is a few joins and aggregates, no group is ever in one task, and the number
of rounds is that of the longest chain of matches in falling order (a few, in practice).

Equal files are matched through their hash and equal pictures through their scene, never as pairs: pairs are made between
distinct scenes only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.session import dropped, written

UNDECIDED, LEADER, DUPLICATE = 0, 1, 2
BITS = 64


def pixel_confirmation(side: int, tile: int, aspect: float = 0.01, mean: float = 3.0, changed: float = 0.025, level: int = 16, local: float = 8.0) -> Callable[[Column, Column], Column]:
    """Whether two pictures (aspect, pixels: side * side gray values row by row) show the same.

    Small mean error, few pixels off by more than `level`, and no tile with a large mean error: codec noise is spread
    evenly, a changed face is not.
    """

    def same(a: Column, b: Column) -> Column:
        off = F.zip_with(a["pixels"], b["pixels"], lambda x, y: F.abs(x - y))
        total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)
        per_row = side // tile
        of_tile = lambda i: F.floor(i / (side * tile)) * per_row + F.floor((i % side) / tile)
        even = F.forall(F.sequence(F.lit(0), F.lit(per_row * per_row - 1)), lambda t: total(F.filter(off, lambda x, i: of_tile(i) == t)) <= local * tile * tile)
        known = (F.size(a["pixels"]) == side * side) & (F.size(b["pixels"]) == side * side)
        return known & (F.abs(a["aspect"] - b["aspect"]) <= aspect) & (total(off) <= mean * side * side) & (F.size(F.filter(off, lambda x: x > level)) <= changed * side * side) & even

    return same


def near_scenes(scenes: DataFrame, group: str, key: str, bits: str, distance: int) -> DataFrame:
    """(group, a, b), a < b: rows of a group whose 64-bit hashes differ in at most `distance` bits, each pair once.

    Such hashes agree in one of distance + 1 bands of bits, so this is an equi-join; a pair comes from its first equal band.
    """
    cuts = [round(i * BITS / (distance + 1)) for i in range(distance + 2)]
    mask = lambda width: -1 if width == BITS else (1 << width) - 1
    band = lambda x, i: F.shiftrightunsigned(x, cuts[i]).bitwiseAND(F.lit(mask(cuts[i + 1] - cuts[i])))
    bands = F.array(*[F.struct(F.lit(i).alias("band"), band(F.col(bits), i).alias("value")) for i in range(distance + 1)])
    spread = scenes.select(group, key, bits, F.inline(bands))
    a, b = spread.alias("a"), spread.alias("b")
    apart = F.col(f"a.{bits}").bitwiseXOR(F.col(f"b.{bits}"))
    first = F.coalesce(*[F.when(band(apart, i) == 0, F.lit(i)) for i in range(distance + 1)])
    on = (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.value") == F.col("b.value"))
    on &= (F.col(f"a.{key}") < F.col(f"b.{key}")) & (F.bit_count(apart) <= distance) & (first == F.col("a.band"))
    return a.join(b, on).select(F.col(f"a.{group}").alias(group), F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"))


def confirmed_pairs(scenes: DataFrame, group: str, key: str, bits: str, picture: str, confirm: Callable[[Column, Column], Column], distance: int = 8) -> DataFrame:
    """near_scenes() that the comparison of their pictures confirms: only near pairs fetch pictures."""
    near = near_scenes(scenes, group, key, bits, distance)
    pictures = lambda k: scenes.select(F.col(key).alias(k), F.col(picture).alias(f"picture_{k}"))
    return near.join(pictures("a"), "a").join(pictures("b"), "b").where(confirm(F.col("picture_a"), F.col("picture_b"))).select(group, "a", "b")


def representative_key(key: str = "candidate_id") -> Column:
    """Ascending: X photos, selectable ones, confirmed entities, detail, area within 1280 x 720, total score, id."""
    area = F.least(F.coalesce("width", F.lit(0)), F.lit(1280)) * F.least(F.coalesce("height", F.lit(0)), F.lit(720))
    not_true = lambda c: ~F.coalesce(c, F.lit(False))
    parts = [not_true("x_photo"), not_true("auto_select"), not_true("entity_match"), -F.coalesce("detail", F.lit(0.0)), -area, -F.coalesce("total", F.lit(0.0)), F.col(key)]
    return F.struct(*[p.alias(f"o{i}") for i, p in enumerate(parts[:-1])], parts[-1].alias("id"))


def _firsts(state: DataFrame, by: str) -> DataFrame:
    """Of each class of matching candidates the first undecided one and the first representative."""
    first = lambda status: F.min(F.when(F.col("status") == status, F.col("place")))
    return state.where(F.col(by).isNotNull()).groupBy(by).agg(first(UNDECIDED).alias("waiting"), first(LEADER).alias("leading"))


def _matches(state: DataFrame, links: DataFrame) -> DataFrame:
    """state with the first undecided and the first representative among each candidate's matches, itself included."""
    files = _firsts(state, "file").select("file", F.col("waiting").alias("file_waiting"), F.col("leading").alias("file_leading"))
    own = _firsts(state, "scene")
    around = links.join(own, links["other"] == own["scene"]).select(links["scene"].alias("scene"), "waiting", "leading")
    scenes = own.unionByName(around).groupBy("scene").agg(F.min("waiting").alias("scene_waiting"), F.min("leading").alias("scene_leading"))
    return state.join(files, "file", "left").join(scenes, "scene", "left")


def elect(state: DataFrame, links: DataFrame) -> tuple[DataFrame, str]:
    """Decides the status of all rows (place: struct, file, scene: match classes or null) under links (scene, other), given both
    ways; also the path of the table that it returns."""
    spark = state.sparkSession
    state, path = written(state.withColumn("status", F.lit(UNDECIDED)), "near-state")
    while state.where(F.col("status") == UNDECIDED).limit(1).count():
        seen = _matches(state, links)
        led = F.least("file_leading", "scene_leading") < F.col("place")
        held = F.least("file_waiting", "scene_waiting") < F.col("place")
        status = F.when(F.col("status") != UNDECIDED, F.col("status")).when(led, DUPLICATE).when(held, UNDECIDED).otherwise(LEADER)
        last = path
        state, path = written(seen.withColumn("status", status).select(*state.columns), "near-state")
        dropped(spark, last)
    return state, path


def representatives(
    rows: DataFrame, history: DataFrame, confirm: Callable[[Column, Column], Column], group: str = "item_id", key: str = "candidate_id", sha: str = "sha256", bits: str = "phash", picture: str = "picture", distance: int = 8,
) -> DataFrame:
    """rows with duplicate_of, duplicate_kind, possible_duplicate_of and historical.

    duplicate_kind: 'sha256' for the file of a representative, else 'perceptual_pixels'. possible_duplicate_of: of a
    representative, an earlier one with the same perceptual hash that the pixels did not confirm. historical: the file
    or perceptual hash is one of history (sha256, phash). Null hashes and pictures match nothing; keys must be unique.
    """
    spark = rows.sparkSession
    has = F.col(bits).isNotNull() & F.col(picture).isNotNull()
    scene = F.when(has, F.sha2(F.to_json(F.struct(group, bits, picture)), 256))
    file = F.when(F.col(sha).isNotNull(), F.sha2(F.to_json(F.struct(group, sha)), 256))
    base, base_path = written(rows.withColumns({"place": representative_key(key), "scene": scene, "file": file}), "near-rows")
    scenes = base.where("scene is not null").groupBy("scene").agg(*[F.first(c).alias(c) for c in (group, bits, picture)])
    pairs = confirmed_pairs(scenes, group, "scene", bits, picture, confirm, distance)
    links, links_path = written(pairs.select(F.inline(F.array(F.struct(F.col("a").alias("scene"), F.col("b").alias("other")), F.struct(F.col("b").alias("scene"), F.col("a").alias("other"))))), "near-links")
    state, state_path = elect(base.select(key, "place", "scene", "file"), links)
    seen = _matches(state, links).select(key, "status", "file_leading", "scene_leading")
    by_file = F.col("file_leading") < F.col("place")
    lead = F.when(by_file, F.col("file_leading.id")).otherwise(F.col("scene_leading.id"))
    twin = F.col("status") == DUPLICATE
    out = base.join(seen, key).withColumns({"duplicate_of": F.when(twin, lead), "duplicate_kind": F.when(twin, F.when(by_file, "sha256").otherwise("perceptual_pixels"))})
    same = out.where((F.col("status") == LEADER) & F.col(bits).isNotNull()).groupBy(group, bits).agg(F.min("place").alias("first_place"))
    out = out.join(same, [group, bits], "left").withColumn("possible_duplicate_of", F.when(~twin & (F.col("first_place") < F.col("place")), F.col("first_place.id")))
    for column, flag in ((sha, "old_file"), (bits, "old_scene")):
        known = history.where(F.col(column).isNotNull()).select(column).distinct().withColumn(flag, F.lit(True))
        out = out.join(known, column, "left")
    out = out.withColumn("historical", F.coalesce("old_file", F.lit(False)) | F.coalesce("old_scene", F.lit(False)))
    out, _ = written(out.select(*rows.columns, "duplicate_of", "duplicate_kind", "possible_duplicate_of", "historical"), "near-out")
    for path in (base_path, links_path, state_path):
        dropped(spark, path)
    return out

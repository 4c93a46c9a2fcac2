"""Privacy audit of image tags and their removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimp import model
from palimp.functions.text import gps_decimal


def tag_columns(tags: DataFrame) -> DataFrame:
    """exif_tags(image_id, ifd, tag, value) to one row per image with the tags that matter."""
    def of(ifd: str, tag: str) -> Column:
        hit = (F.col("ifd") == ifd) & (F.col("tag") == tag)
        return F.max(F.when(hit, F.btrim(F.replace("value", F.lit("\x00"), F.lit("")))))
    gps = [of("gps", t).alias(t) for t in ("lat", "lat_ref", "lon", "lon_ref")]
    text = [of("ifd0", t).alias(t) for t in [*model.CAMERA_TAGS, *model.AUTHORSHIP_TAGS]]
    thumb = F.coalesce(F.bool_or((F.col("ifd") == "ifd1") & F.col("tag").isin(model.THUMBNAIL_TAGS)), F.lit(False))
    return tags.groupBy("image_id").agg(*gps, *text, thumb.alias("thumbnail"))


def _labelled(label: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label + ": "), value))


def gps_items() -> Column:
    lat = gps_decimal(F.col("lat"), F.col("lat_ref"))
    lon = gps_decimal(F.col("lon"), F.col("lon_ref"))
    line = lambda label, v: F.format_string(label + ": %.6f", v)
    return F.when(lat.isNotNull() & lon.isNotNull(), F.array(line("Latitude", lat), line("Longitude", lon))).otherwise(
        F.array().cast("array<string>"))


def camera_items() -> Column:
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    device = F.btrim(F.concat(text("Make"), F.lit(" "), text("Model")))
    captured = F.coalesce(F.nullif("DateTimeOriginal", F.lit("")), F.col("DateTime"))
    return F.array_compact(F.array(_labelled("Device", device), _labelled("Captured", captured), _labelled("Software", F.col("Software"))))


def authorship_items() -> Column:
    labels = dict(zip(model.AUTHORSHIP_TAGS, ["Artist", "Copyright", "Author", "Comment", "Description"]))
    return F.array_compact(F.array(*[_labelled(label, F.col(tag)) for tag, label in labels.items()]))


def audit_image_tags(tags: DataFrame) -> DataFrame:
    """Finding rows per image; an image with nothing sensitive gives no rows."""
    per_image = tag_columns(tags)
    has_gps = F.col("lat").isNotNull() & F.col("lon").isNotNull()

    def finding(fid: str, present: Column, count: Column, items: Column) -> Column:
        category, severity, title = model.FINDINGS[fid]
        return F.when(present, F.struct(
            F.lit(fid).alias("id"), F.lit(category).alias("category"), F.lit(severity).alias("severity"),
            F.lit(title).alias("title"), count.cast("bigint").alias("count"), items.alias("items")))

    none, one = F.array().cast("array<string>"), F.lit(1)
    staged = per_image.select("image_id", has_gps.alias("gps"), "thumbnail", gps_items().alias("g"),
                              camera_items().alias("c"), authorship_items().alias("a"))
    found = F.array_compact(F.array(
        finding("location.gps", F.col("gps"), one, F.col("g")),
        finding("metadata.camera", F.size("c") > 0, F.size("c"), F.col("c")),
        finding("content.thumbnail", F.col("thumbnail"), one, none),
        finding("metadata.authorship", F.size("a") > 0, F.size("a"), F.col("a"))))
    return staged.select("image_id", F.explode_outer(found).alias("f")).where("f is not null").select("image_id", "f.*")


# Finding id -> category removed by stripping.
STRIP_CATEGORIES = {"location.gps": "gps", "metadata.camera": "camera", "content.thumbnail": "thumbnail", "metadata.authorship": "authorship"}


def sensitive(ifd: Column, tag: Column) -> Column:
    return ((ifd == "gps") | ((ifd == "ifd0") & tag.isin([*model.CAMERA_TAGS, *model.AUTHORSHIP_TAGS]))
            | ((ifd == "ifd1") & tag.isin(model.THUMBNAIL_TAGS)))


def strip_image_tags(tags: DataFrame) -> DataFrame:
    """What stays after removing sensitive tags."""
    return tags.where(~sensitive(F.col("ifd"), F.col("tag")))


def strip_report(tags: DataFrame) -> DataFrame:
    """Categories removed per image, and how many tags stay."""
    category = F.lit(None).cast("string")
    for fid, name in STRIP_CATEGORIES.items():
        category = F.when(F.col("id") == fid, name).otherwise(category)
    removed = audit_image_tags(tags).groupBy("image_id").agg(
        F.array_sort(F.collect_set(category)).alias("removed"))
    kept = tags.groupBy("image_id").agg(F.count_if(~sensitive(F.col("ifd"), F.col("tag"))).alias("tags_left"))
    return kept.join(removed, "image_id", "left").select(
        "image_id", F.coalesce("removed", F.array().cast("array<string>")).alias("removed"), "tags_left")


def embedded_image_findings(doc_images: DataFrame, tags: DataFrame) -> DataFrame:
    """doc_images(doc_id, image_id) to counts of a document's images that carry location or camera data."""
    kinds = {"location.gps": "location.embedded_image", "metadata.camera": "metadata.embedded_image"}
    fid = F.lit(None).cast("string")
    severity = F.lit(None).cast("string")
    for source, target in kinds.items():
        fid = F.when(F.col("id") == source, target).otherwise(fid)
        severity = F.when(F.col("id") == source, model.FINDINGS[target][1]).otherwise(severity)
    hits = audit_image_tags(tags).where(F.col("id").isin(list(kinds))).select("image_id", fid.alias("id"), severity.alias("severity"))
    return doc_images.join(hits, "image_id").groupBy("doc_id", "id", "severity").agg(F.count(F.lit(1)).alias("count"))

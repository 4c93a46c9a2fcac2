"""Image inventory: features, skip and encoding plans, size what-ifs and totals.

Presets are five constants, so a per-preset result is built as columns in one pass and unpivoted
after aggregation instead of multiplying the rows first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimp import model
from palimp.operators.dedup import distinct_objects

PAYLOAD = ["pixel_w", "pixel_h", "codec", "bits", "is_gray", "display_w_pts", "display_h_pts", "raw_size", "n_colors", "variance", "has_mask"]

# Quality estimate by bytes per sample, and size ratio by target quality.
QUALITY_LADDER = [(0.40, 97), (0.25, 92), (0.12, 85), (0.06, 72), (0.03, 55), (0.015, 40)]
QUALITY_FLOOR, QUALITY_UNKNOWN, QUALITY_LOSSLESS = 25, 85, 100
PHOTO_RATIOS = [(90, 0.35), (75, 0.18), (60, 0.10), (40, 0.06)]
PHOTO_RATIO_FLOOR, BW_RATIO, FLATE_RATIO = 0.04, 0.02, 0.3
NO_IMAGE_SHARE, OTHER_SHARE, MIN_OUTPUT = 0.90, 0.95, 1024
SMALL_IMAGE_PIXELS = 4096


def distinct_assets(assets: DataFrame) -> DataFrame:
    """Each object of a document once; the lowest page wins."""
    return distinct_objects(assets, ["doc_id", "obj_id"], ["page_no"], PAYLOAD)


def with_features(assets: DataFrame) -> DataFrame:
    """Effective dpi, estimated quality and class flags."""
    w, h = F.col("pixel_w"), F.col("pixel_h")
    samples = w * h * F.when(F.col("is_gray"), 1).otherwise(3)
    ratio = F.col("raw_size") / samples
    quality = F.lit(QUALITY_FLOOR)
    for bound, value in reversed(QUALITY_LADDER):
        quality = F.when(ratio > bound, value).otherwise(quality)
    quality = F.when((F.col("raw_size") <= 0) | (samples <= 0), QUALITY_UNKNOWN).otherwise(quality)

    def dpi(pixels: str, points: str) -> Column:
        return F.when(F.col(points) > 0.1, F.col(pixels) / (F.col(points) / 72.0)).otherwise(F.lit(0.0))

    return (
        assets.withColumn("pixels", w * h)
        .withColumn("is_jpeg", F.col("codec") == "DCTDecode")
        .withColumn("is_mono", F.col("bits") == 1)
        .withColumn("dpi", F.greatest(dpi("pixel_w", "display_w_pts"), dpi("pixel_h", "display_h_pts")))
        .withColumn("est_quality", F.when(F.col("is_jpeg"), quality).otherwise(QUALITY_LOSSLESS).cast("bigint"))
        .withColumn("too_large", F.col("pixels") > model.MAX_IMAGE_PIXELS)
    )


def target_dpi(preset: tuple) -> Column:
    _, colour, gray, mono, *_ = preset
    return F.when(F.col("is_mono"), F.lit(mono or colour)).when(F.col("is_gray"), F.lit(gray or colour)).otherwise(F.lit(colour))


def skip_reason(preset: tuple) -> Column:
    """'tiny', 'quality' or null for images that are processed."""
    quality, skip_below = preset[4], preset[5]
    shrink = (F.col("dpi") > 0) & (F.col("dpi") > target_dpi(preset) * 1.1)
    return (F.when(F.greatest("pixel_w", "pixel_h") < skip_below, "tiny")
            .when(~shrink & F.col("is_jpeg") & (F.col("est_quality") <= quality - 15), "quality"))


def scale(preset: tuple) -> Column:
    """Shrink factor; unknown dpi counts as 150 when the long side exceeds 150 pixels."""
    target, dpi = target_dpi(preset), F.col("dpi")
    unknown = F.when((F.greatest("pixel_w", "pixel_h") > 150) & (F.lit(150.0) > target * 1.2), target / F.lit(150.0))
    return F.coalesce(F.when((dpi > 0) & (dpi > target * 1.1), target / dpi).when(dpi <= 0, unknown), F.lit(1.0))


def encode_route() -> Column:
    """Black-and-white, photo or lossless, from colour count and variance."""
    flat = F.col("variance") < F.when(F.col("is_gray"), 50).otherwise(100)
    few = (F.col("n_colors") < 256) & (F.col("pixels") > SMALL_IMAGE_PIXELS)
    return (F.when(F.col("is_mono"), "bw").when(F.col("is_jpeg"), "photo")
            .when(few | flat, "lossless").otherwise("photo"))


def encode_plan(features: DataFrame, preset: tuple) -> DataFrame:
    s = F.col("scale")
    shrunk = s < 0.95
    return (
        features.where(~F.col("too_large")).withColumn("skip", skip_reason(preset)).where("skip is null")
        .withColumn("scale", scale(preset)).withColumn("route", encode_route()).withColumn("downscaled", shrunk)
        .withColumn("new_w", F.when(shrunk, F.greatest(F.lit(1), F.floor(F.col("pixel_w") * s))).otherwise(F.col("pixel_w")).cast("bigint"))
        .withColumn("new_h", F.when(shrunk, F.greatest(F.lit(1), F.floor(F.col("pixel_h") * s))).otherwise(F.col("pixel_h")).cast("bigint"))
    )


def extract_plan(assets: DataFrame, fmt: str = "png", min_size: int = 0) -> DataFrame:
    """How each asset would be written out: raw for JPEG and JPX, else decoded to ``fmt``."""
    target = {"jpeg": "jpg"}.get(fmt.lower(), fmt.lower())
    ext = F.when(F.col("codec") == "DCTDecode", "jpg").when(F.col("codec") == "JPXDecode", "jp2").otherwise(target)
    raw = F.col("codec").isin("DCTDecode", "JPXDecode")
    mode = F.when(~raw, F.when(F.col("is_gray"), "L").otherwise("RGB"))
    return assets.where(F.col("pixel_w") * F.col("pixel_h") >= min_size).select(
        "*", ext.alias("ext"), F.when(raw, "raw").otherwise("decode").alias("route"), mode.alias("mode"))


def _estimated(preset: tuple) -> Column:
    quality = preset[4]
    target = target_dpi(preset)
    s = F.when(F.col("dpi") > target * 1.1, target / F.col("dpi")).otherwise(F.lit(1.0))
    new_pixels = F.col("pixels") * (s * s)
    channels = F.when(F.col("is_gray"), 1).otherwise(3)
    k = next((r for q, r in PHOTO_RATIOS if quality >= q), PHOTO_RATIO_FLOOR)
    size = (F.when(F.col("is_mono"), F.floor(new_pixels * BW_RATIO))
            .when(~F.col("is_jpeg") & (F.col("pixels") > SMALL_IMAGE_PIXELS), F.floor(new_pixels * (channels * F.lit(FLATE_RATIO))))
            .otherwise(F.floor(new_pixels * channels * F.lit(k))))
    return F.when(skip_reason(preset).isNotNull(), F.col("raw_size")).otherwise(F.least(size, F.col("raw_size")))


def with_file_size(docs: DataFrame, asset_bytes: str) -> DataFrame:
    """docs(doc_id, file_size), or docs(doc_id, overhead) whose files hold their assets' bytes besides; then these need no second pass."""
    if "file_size" in docs.columns:
        return docs
    return docs.withColumn("file_size", (F.col(asset_bytes) + F.col("overhead")).cast("bigint")).drop("overhead")


def preset_whatif(features: DataFrame, docs: DataFrame) -> DataFrame:
    """Estimated output, saved bytes and saved percent per document and preset.

    docs as for :func:`with_file_size`; oversized images count towards the bytes but are not estimated.
    """
    usable = ~F.col("too_large")
    sums = features.groupBy("doc_id").agg(
        F.count_if(usable).alias("images"), F.sum("raw_size").alias("bytes"),
        *[F.sum(F.when(usable, _estimated(p))).alias(p[0]) for p in model.PRESETS])
    keys = [p[0] for p in model.PRESETS]
    joined = with_file_size(docs.join(sums, "doc_id", "left").fillna(0, ["images", "bytes", *keys]), "bytes")
    long = joined.unpivot(["doc_id", "file_size", "images", "bytes"], keys, "preset", "est_images")
    size = F.col("file_size")
    other = F.floor((size - F.col("bytes")) * F.lit(OTHER_SHARE))
    est = F.when(F.col("images") == 0, F.floor(size * F.lit(NO_IMAGE_SHARE))).otherwise(
        F.greatest(F.lit(MIN_OUTPUT), F.col("est_images") + other))
    return long.withColumn("est_size", est.cast("bigint")).withColumn(
        "saved_bytes", F.greatest(F.lit(0), size - F.col("est_size")).cast("bigint")).withColumn(
        "saved_pct", F.when(size > 0, F.round(F.col("saved_bytes") / size * 100, 1)).otherwise(0.0)).drop("images", "bytes", "est_images")


def asset_summary(features: DataFrame, docs: DataFrame) -> DataFrame:
    """Per document: count, bytes, dpi statistics over known dpi, class counts, share of the file.

    The mean is taken over whole thousandths, so it does not depend on the order of the rows.
    """
    usable, known = ~F.col("too_large"), ~F.col("too_large") & (F.col("dpi") > 0)
    agg = features.groupBy("doc_id").agg(
        F.count_if(usable).alias("n"), F.sum("raw_size").cast("bigint").alias("bytes"),
        F.sum(F.when(known, F.round(F.col("dpi") * 1000).cast("bigint"))).alias("_milli"), F.count_if(known).alias("_known"), F.max(F.when(known, F.col("dpi"))).alias("max_dpi"),
        F.min(F.when(known, F.col("dpi"))).alias("min_dpi"), F.count_if(usable & F.col("is_jpeg")).alias("jpeg"),
        F.count_if(usable & F.col("is_gray")).alias("gray"), F.count_if(usable & F.col("is_mono")).alias("mono"))
    mean = F.expr("(2 * _milli + _known) div (2 * _known)") / 1000.0
    agg = agg.withColumn("avg_dpi", F.when(F.col("_known") > 0, mean)).drop("_milli", "_known")
    j = with_file_size(docs.join(agg, "doc_id", "left").fillna(0), "bytes")
    return j.withColumn("pct_of_file", F.when(F.col("file_size") > 0, F.round(F.col("bytes") / F.col("file_size") * 100, 1)).otherwise(0.0))


def outcome_stats(features: DataFrame) -> DataFrame:
    """Nine outcome counters per preset, all presets in one aggregation."""
    def counters(preset: tuple) -> Column:
        open_ = ~F.col("too_large")
        skip = skip_reason(preset)
        done = open_ & skip.isNull()
        route = encode_route()
        named = {
            "images_total": F.lit(True), "recompressed": done, "downscaled": done & (scale(preset) < 0.95),
            "skipped_tiny": open_ & (skip == "tiny"), "skipped_quality": open_ & (skip == "quality"),
            "skipped_bomb": F.col("too_large"), "mask_composited": done & F.col("has_mask"),
            "kept_lossless": done & (route == "lossless"), "converted_bw": done & (route == "bw"),
        }
        return F.struct(F.lit(preset[0]).alias("preset"), *[F.count_if(c).alias(n) for n, c in named.items()])
    return features.agg(F.array(*[counters(p) for p in model.PRESETS]).alias("all")).select(F.inline("all"))


def inventory_totals(distinct: DataFrame, docs: DataFrame, fonts: DataFrame) -> DataFrame:
    """Page, asset and byte totals; docs as for :func:`with_file_size`, fonts(doc_id, font_id, bytes) distinct per document."""
    a = distinct.groupBy("doc_id").agg(
        F.max("page_no").alias("pages"), F.count(F.lit(1)).alias("assets"), F.sum("raw_size").cast("bigint").alias("asset_bytes"))
    f = fonts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("fonts"), F.sum("bytes").cast("bigint").alias("font_bytes"))
    return with_file_size(docs.join(a, "doc_id", "left").join(f, "doc_id", "left").fillna(0), "asset_bytes").withColumn(
        "other_bytes", F.col("file_size") - F.col("asset_bytes"))


def codec_overlap(assets: DataFrame, filters: Column, wanted: list[str]) -> DataFrame:
    """Assets whose filter list meets the wanted codecs."""
    return assets.where(F.arrays_overlap(filters, F.array(*[F.lit(w) for w in wanted])))

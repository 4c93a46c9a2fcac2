"""Image inventory over ``lineitem``/``orders`` and image tags over ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimp import model
from palimp.functions.text import gps_decimal
from palimp.operators import assets as ops
from palimp.operators import images
from palimp.operators.dedup import distinct_objects
from palimp.plans.base import ORACLES, query
from palimp.sources import tables

_ASSETS = f"assets as ({tables.ASSETS_SQL.format(lineitem='lineitem')})"
_ORDER = "page_no, pixel_w, pixel_h, codec, bits, is_gray, display_w_pts, display_h_pts, raw_size, n_colors, variance, has_mask"
_FEATURES = f"""{_ASSETS}, distinct_assets as (select * exclude (rn) from (select *, row_number() over (partition by doc_id, obj_id order by {_ORDER}) as rn from assets) where rn = 1),
 dpis as (select *, pixel_w * pixel_h as pixels, codec = 'DCTDecode' as is_jpeg, bits = 1 as is_mono,
  greatest(case when display_w_pts > 0.1 then pixel_w / (display_w_pts / 72.0::double) else 0.0::double end, case when display_h_pts > 0.1 then pixel_h / (display_h_pts / 72.0::double) else 0.0::double end) as dpi,
  raw_size / (pixel_w * pixel_h * case when is_gray then 1 else 3 end)::double as ratio from distinct_assets),
 features as (select *, pixels > 200000000 as too_large, cast(case when not is_jpeg then 100 when raw_size <= 0 then 85 when ratio > 0.40::double then 97 when ratio > 0.25::double then 92 when ratio > 0.12::double then 85
  when ratio > 0.06::double then 72 when ratio > 0.03::double then 55 when ratio > 0.015::double then 40 else 25 end as bigint) as est_quality from dpis)"""
_PRESETS = "presets(preset, colour_dpi, gray_dpi, mono_dpi, jpeg_q, skip_below, strip_metadata) as (values " + ", ".join(
    str(p).replace("True", "true").replace("False", "false") for p in model.PRESETS) + ")"
_PLANNED = f"""{_FEATURES}, {_PRESETS}, targets as (select f.*, p.*, case when is_mono then case when mono_dpi > 0 then mono_dpi else colour_dpi end
   when is_gray then case when gray_dpi > 0 then gray_dpi else colour_dpi end else colour_dpi end as target from features f cross join presets p),
 skips as (select *, case when greatest(pixel_w, pixel_h) < skip_below then 'tiny' when not (dpi > 0 and dpi > target * 1.1::double) and is_jpeg and est_quality <= jpeg_q - 15 then 'quality' end as skip,
  case when dpi > 0 then case when dpi > target * 1.1::double then target / dpi else 1.0::double end
   when greatest(pixel_w, pixel_h) > 150 and 150.0::double > target * 1.2::double then target / 150.0::double else 1.0::double end as scale,
  case when is_mono then 'bw' when is_jpeg then 'photo' when (n_colors < 256 and pixels > 4096) or variance < case when is_gray then 50 else 100 end then 'lossless' else 'photo' end as route from targets)"""
_DOCS = """docs as (select o_orderkey as doc_id, coalesce(b.bytes, 0) + 10000 + o_orderkey % 1000 as file_size from orders left join
 (select doc_id, cast(sum(raw_size) as bigint) as bytes from distinct_assets group by doc_id) b on o_orderkey = b.doc_id)"""


def features(spark, sf_dir):
    return ops.with_features(ops.distinct_assets(tables.assets(spark, sf_dir)))


def docs(spark, sf_dir):
    return tables.asset_docs(spark, sf_dir)


@query("asset_extract_plan", f"""with {_ASSETS} select doc_id, page_no, obj_id, case codec when 'DCTDecode' then 'jpg' when 'JPXDecode' then 'jp2' else 'png' end as ext,
 case when codec = 'FlateDecode' then 'decode' else 'raw' end as route, case when codec = 'FlateDecode' then case when is_gray then 'L' else 'RGB' end end as mode from assets""")
def asset_extract_plan(spark, sf_dir):
    """Every image; a least size is a parameter."""
    return ops.extract_plan(tables.assets(spark, sf_dir)).select("doc_id", "page_no", "obj_id", "ext", "route", "mode")


@query("asset_features", f"with {_FEATURES} select doc_id, obj_id, page_no, raw_size, round(dpi, 6) as dpi, est_quality, is_mono, too_large from features")
def asset_features(spark, sf_dir):
    return features(spark, sf_dir).select("doc_id", "obj_id", "page_no", "raw_size", F.round("dpi", 6).alias("dpi"), "est_quality", "is_mono", "too_large")


@query("asset_skip_reason", f"with {_PLANNED} select preset, case when too_large then 'skipped_bomb' else coalesce(skip, 'process') end as outcome, count(*) as n, cast(sum(raw_size) as bigint) as bytes from skips group by 1, 2")
def asset_skip_reason(spark, sf_dir):
    """Every image; oversized ones have an outcome of their own."""
    outcome = lambda p: F.when(F.col("too_large"), "skipped_bomb").otherwise(F.coalesce(ops.skip_reason(p), F.lit("process")))
    reasons = F.array(*[F.struct(F.lit(p[0]).alias("preset"), outcome(p).alias("outcome")) for p in model.PRESETS])
    return features(spark, sf_dir).select("raw_size", F.explode(reasons).alias("r")).groupBy("r.preset", "r.outcome").agg(
        F.count(F.lit(1)).alias("n"), F.sum("raw_size").cast("bigint").alias("bytes"))


_ROUTED = "not too_large and skip is null"


@query("asset_encode_route", f"""with {_PLANNED} select preset, doc_id, obj_id, case when too_large then 'skipped_bomb' else coalesce(skip, 'process') end as outcome,
 case when {_ROUTED} then route end as route, case when {_ROUTED} then scale < 0.95::double end as downscaled,
 cast(case when {_ROUTED} then case when scale < 0.95::double then greatest(1, floor(pixel_w * scale)) else pixel_w end end as bigint) as new_w,
 cast(case when {_ROUTED} then case when scale < 0.95::double then greatest(1, floor(pixel_h * scale)) else pixel_h end end as bigint) as new_h from skips""")
def asset_encode_route(spark, sf_dir):
    """A row per image and preset; images that are skipped say why and have no route."""
    def plan(p):
        s, done = ops.scale(p), ~F.col("too_large") & ops.skip_reason(p).isNull()
        side = lambda c: F.when(done, F.when(s < 0.95, F.greatest(F.lit(1), F.floor(F.col(c) * s))).otherwise(F.col(c))).cast("bigint")
        outcome = F.when(F.col("too_large"), "skipped_bomb").otherwise(F.coalesce(ops.skip_reason(p), F.lit("process")))
        return F.struct(F.lit(p[0]).alias("preset"), outcome.alias("outcome"), F.when(done, ops.encode_route()).alias("route"),
                        F.when(done, s < 0.95).alias("downscaled"), side("pixel_w").alias("new_w"), side("pixel_h").alias("new_h"))

    plans = features(spark, sf_dir).select("doc_id", "obj_id", F.explode(F.array(*[plan(p) for p in model.PRESETS])).alias("r"))
    return plans.select("r.preset", "doc_id", "obj_id", "r.outcome", "r.route", "r.downscaled", "r.new_w", "r.new_h")


for _old, _fn in (("asset_extract_plan_all_sizes", asset_extract_plan), ("asset_skip_reason_all_sizes", asset_skip_reason), ("asset_encode_route_all_presets", asset_encode_route)):
    # Names of an earlier round for the whole job, which the plain names now do.
    query(_old, ORACLES[_fn.__name__])(_fn)


_K = "case when jpeg_q >= 90 then 0.35::double when jpeg_q >= 75 then 0.18::double when jpeg_q >= 60 then 0.10::double when jpeg_q >= 40 then 0.06::double else 0.04::double end"


@query("preset_whatif", f"""with {_PLANNED}, {_DOCS}, px as (select *, pixels * (case when dpi > target * 1.1::double then target / dpi else 1.0::double end * case when dpi > target * 1.1::double then target / dpi else 1.0::double end) as new_px,
   case when is_gray then 1 else 3 end as channels from skips),
 est as (select doc_id, preset, count(*) filter (not too_large) as images, sum(raw_size) as bytes, sum(case when skip is not null then raw_size else least(raw_size, cast(case when is_mono then floor(new_px * 0.02::double)
   when not is_jpeg and pixels > 4096 then floor(new_px * (channels * 0.3::double)) else floor(new_px * channels * {_K}) end as bigint)) end) filter (not too_large) as est from px group by doc_id, preset),
 sized as (select d.doc_id, d.file_size, p.preset, cast(case when coalesce(images, 0) = 0 then floor(file_size * 0.90::double) else greatest(1024, est + floor((file_size - bytes) * 0.95::double)) end as bigint) as est_size
  from docs d cross join presets p left join est e on d.doc_id = e.doc_id and p.preset = e.preset)
 select doc_id, cast(file_size as bigint) as file_size, preset, est_size, cast(greatest(0, file_size - est_size) as bigint) as saved_bytes, round(greatest(0, file_size - est_size) / file_size::double * 100, 1) as saved_pct from sized""")
def preset_whatif(spark, sf_dir):
    return ops.preset_whatif(features(spark, sf_dir), docs(spark, sf_dir))


@query("asset_summary", f"""with {_FEATURES}, {_DOCS}, a as (select doc_id, count(*) filter (not too_large) as n, sum(raw_size) as bytes, (2 * sum(cast(round(dpi * 1000) as bigint)) filter (not too_large and dpi > 0) + count(*) filter (not too_large and dpi > 0)) // (2 * count(*) filter (not too_large and dpi > 0)) / 1000.0::double as avg_dpi, max(dpi) filter (not too_large and dpi > 0) as max_dpi,
  min(dpi) filter (not too_large and dpi > 0) as min_dpi, count(*) filter (not too_large and is_jpeg) as jpeg, count(*) filter (not too_large and is_gray) as gray, count(*) filter (not too_large and is_mono) as mono from features group by doc_id)
 select d.doc_id, cast(file_size as bigint) as file_size, coalesce(n, 0) as n, cast(coalesce(bytes, 0) as bigint) as bytes, coalesce(avg_dpi, 0) as avg_dpi, round(coalesce(max_dpi, 0), 3) as max_dpi, round(coalesce(min_dpi, 0), 3) as min_dpi,
  coalesce(jpeg, 0) as jpeg, coalesce(gray, 0) as gray, coalesce(mono, 0) as mono, round(coalesce(bytes, 0) / file_size::double * 100, 1) as pct_of_file from docs d left join a on d.doc_id = a.doc_id""")
def asset_summary(spark, sf_dir):
    out = ops.asset_summary(features(spark, sf_dir), docs(spark, sf_dir))
    return out.withColumns({c: F.round(c, 3) for c in ("max_dpi", "min_dpi")})


@query("asset_outcome_stats", f"""with {_PLANNED} select preset, count(*) as images_total, count(*) filter (not too_large and skip is null) as recompressed, count(*) filter (not too_large and skip is null and scale < 0.95::double) as downscaled,
 count(*) filter (not too_large and skip = 'tiny') as skipped_tiny, count(*) filter (not too_large and skip = 'quality') as skipped_quality, count(*) filter (too_large) as skipped_bomb, count(*) filter (not too_large and skip is null and has_mask) as mask_composited,
 count(*) filter (not too_large and skip is null and route = 'lossless') as kept_lossless, count(*) filter (not too_large and skip is null and route = 'bw') as converted_bw from skips group by preset""")
def asset_outcome_stats(spark, sf_dir):
    return ops.outcome_stats(features(spark, sf_dir))


@query("inventory_totals", f"""with {_FEATURES}, {_DOCS}, a as (select doc_id, max(page_no) as pages, count(*) as assets, sum(raw_size) as asset_bytes from distinct_assets group by doc_id),
 f as (select doc_id, count(*) as fonts, sum(bytes) as font_bytes from (select doc_id, n_colors % 40 as font_id, min(struct_pack(p := page_no, r := raw_size)).r as bytes from assets group by 1, 2) group by doc_id)
 select d.doc_id, cast(file_size as bigint) as file_size, coalesce(pages, 0) as pages, coalesce(a.assets, 0) as assets, cast(coalesce(asset_bytes, 0) as bigint) as asset_bytes, coalesce(fonts, 0) as fonts, cast(coalesce(font_bytes, 0) as bigint) as font_bytes,
  cast(file_size - coalesce(asset_bytes, 0) as bigint) as other_bytes from docs d left join a on d.doc_id = a.doc_id left join f on d.doc_id = f.doc_id""")
def inventory_totals(spark, sf_dir):
    every = tables.assets(spark, sf_dir)
    rows = every.select("doc_id", (F.col("n_colors") % 40).alias("font_id"), "page_no", F.col("raw_size").alias("bytes"))
    fonts = distinct_objects(rows, ["doc_id", "font_id"], ["page_no"], ["bytes"])
    return ops.inventory_totals(ops.distinct_assets(every), docs(spark, sf_dir), fonts)


@query("codec_overlap", f"with {_ASSETS} select doc_id, page_no, obj_id, codec, bits from assets where codec in ('DCTDecode', 'JPXDecode')")
def codec_overlap(spark, sf_dir):
    a = tables.assets(spark, sf_dir)
    filters = F.array_compact(F.array(F.col("codec"), F.when(F.col("bits") == 1, "CCITTFaxDecode")))
    return ops.codec_overlap(a, filters, ["DCTDecode", "JPXDecode"]).select("doc_id", "page_no", "obj_id", "codec", "bits")


# --- image tags -----------------------------------------------------------------------------------

_TAGS = f"""tags as ({tables.EXIF_SQL.format(part='part', string='varchar')}),
 wide as (select image_id, max(value) filter (tag = 'lat') as lat, max(value) filter (tag = 'lat_ref') as lat_ref, max(value) filter (tag = 'lon') as lon, max(value) filter (tag = 'lon_ref') as lon_ref,
  max(value) filter (tag = 'Make') as make, max(value) filter (tag = 'Model') as model, max(value) filter (tag = 'Artist') as artist, count(*) filter (tag = '513') > 0 as thumb from tags group by image_id),
 dms as (select *, (case when upper(trim(coalesce(lat_ref, ''))) in ('S', 'W') then -1 else 1 end) * (split_part(lat, ',', 1)::double + split_part(lat, ',', 2)::double / 60 + split_part(lat, ',', 3)::double / 3600) as lat_dd,
  (case when upper(trim(coalesce(lon_ref, ''))) in ('S', 'W') then -1 else 1 end) * (split_part(lon, ',', 1)::double + split_part(lon, ',', 2)::double / 60 + split_part(lon, ',', 3)::double / 3600) as lon_dd,
  trim(concat(coalesce(make, ''), ' ', coalesce(model, ''))) as device from wide),
 image_findings as (select image_id, 'location.gps' as id, 'high' as severity, 1 as count, concat('Latitude: ', printf('%.6f', lat_dd), ' | Longitude: ', printf('%.6f', lon_dd)) as items from dms where lat is not null and lon is not null
  union all select image_id, 'metadata.camera', 'medium', 1, concat('Device: ', device) from dms where device <> ''
  union all select image_id, 'content.thumbnail', 'medium', 1, '' from dms where thumb
  union all select image_id, 'metadata.authorship', 'low', 1, concat('Artist: ', artist) from dms where artist <> '')"""


@query("gps_decimal", f"with {_TAGS} select image_id, round(lat_dd, 6) as lat, round(lon_dd, 6) as lon from dms where lat is not null or lon is not null")
def gps(spark, sf_dir):
    wide = images.tag_columns(tables.exif_tags(spark, sf_dir)).where("lat is not null or lon is not null")
    return wide.select("image_id", F.round(gps_decimal(F.col("lat"), F.col("lat_ref")), 6).alias("lat"),
                       F.round(gps_decimal(F.col("lon"), F.col("lon_ref")), 6).alias("lon"))


@query("audit_image_tags", f"with {_TAGS} select image_id, id, severity, cast(count as bigint) as count, items from image_findings")
def audit_image_tags(spark, sf_dir):
    return images.audit_image_tags(tables.exif_tags(spark, sf_dir)).select("image_id", "id", "severity", "count", F.array_join("items", " | ").alias("items"))


@query("strip_image_tags", f"""with {_TAGS}, r as (select image_id, string_agg(case id when 'location.gps' then 'gps' when 'metadata.camera' then 'camera' when 'content.thumbnail' then 'thumbnail' else 'authorship' end, ','
  order by case id when 'location.gps' then 'gps' when 'metadata.camera' then 'camera' when 'content.thumbnail' then 'thumbnail' else 'authorship' end) as removed from image_findings group by image_id)
 select distinct t.image_id, coalesce(removed, '') as removed, cast(0 as bigint) as tags_left, cast(0 as bigint) as findings_left from tags t left join r on t.image_id = r.image_id""")
def strip_image_tags(spark, sf_dir):
    tags = tables.exif_tags(spark, sf_dir)
    left = images.audit_image_tags(images.strip_image_tags(tags)).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    return images.strip_report(tags).join(left, "image_id", "left").select(
        "image_id", F.array_join("removed", ",").alias("removed"), "tags_left", F.coalesce("n", F.lit(0)).cast("bigint").alias("findings_left"))


@query("audit_embedded_images", f"""with {_TAGS}, {_ASSETS}, d as (select distinct doc_id, obj_id from assets where codec = 'DCTDecode')
 select doc_id, case id when 'location.gps' then 'location.embedded_image' else 'metadata.embedded_image' end as id, severity, count(*) as count
 from d join image_findings on obj_id = image_id where id in ('location.gps', 'metadata.camera') group by all""")
def audit_embedded_images(spark, sf_dir):
    owned = tables.assets(spark, sf_dir).where("codec = 'DCTDecode'").select("doc_id", F.col("obj_id").alias("image_id")).distinct()
    return images.embedded_image_findings(owned, tables.exif_tags(spark, sf_dir))

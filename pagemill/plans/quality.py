"""Quality flags, statistics, badges and the report table on page measures."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from pagemill.functions.numbers import rounded
from pagemill.operators import quality as Q
from pagemill.plans import bindings as B
from pagemill.plans.geometry import _STEP_ORDER as STEP_ORDER
from pagemill.session import run_dir
from pagemill.sinks import tables as K
from pagemill.sources.records import FLAG_SCHEMA, parse_transform_logs

QUERIES, ORACLE = {}, {}
KEYS = ["batch", "page_key", "part_key", "line_key"]
KEY_SQL = ", ".join(KEYS)
NAMES = Q.WARNINGS + ["dewarp_applied", "rotated", "rotation_applied"]


def flags(s, d):
    return Q.quality_flags(B.page_measures(s, d))


FLAGS = """
known AS (SELECT * REPLACE (coalesce(orientation_confidence, 0) AS orientation_confidence, coalesce(capture_type, 'UNKNOWN') AS capture_type)
          FROM page_measures),
flags AS (SELECT *, orientation_confidence < 0.7::DOUBLE AS low_confidence_orientation,
    crop_status = 'cropped' AND least(margin_top, margin_bottom, margin_left, margin_right) < 8 AS overcrop_risk,
    crop_status IN ('no_detection', 'invalid_geometry', 'no_valid_detection') AS no_quad_detected,
    crop_status = 'cropped' AND has_matrix AS dewarp_applied, contrast < 50 AS low_contrast_after_enhance,
    final_width < 1200 OR final_height < 1600 AS too_small_final,
    abs(orientation_angle) > 0.1 AS rotated, abs(orientation_angle) > 0.1 AND orientation_confidence >= 0.7::DOUBLE AS rotation_applied FROM known),
marked AS (SELECT *, low_confidence_orientation OR overcrop_risk OR no_quad_detected OR low_contrast_after_enhance OR too_small_final AS warned FROM flags)"""

# P17
QUERIES["quality_flags"] = lambda s, d: flags(s, d).select(*KEYS, *NAMES, "capture_type")
ORACLE["quality_flags"] = B.sql(f"SELECT {KEY_SQL}, {', '.join(NAMES)}, capture_type FROM flags", B.PAGE_MEASURES, FLAGS)

# A3
_RATE = "CAST(count(*) FILTER (WHERE {}) AS DOUBLE) / count(*)"


def _rounded(df, names):
    return df.select(*[rounded(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])


_FLAG_STATS = f"""count(*) AS pages, round({_RATE.format('NOT low_confidence_orientation')}, 6) AS orientation_accuracy,
  count(*) FILTER (WHERE overcrop_risk) AS overcrop_risk_count, round({_RATE.format('overcrop_risk')}, 6) AS overcrop_risk_rate,
  count(*) FILTER (WHERE no_quad_detected) AS no_quad_detected_count, round({_RATE.format('no_quad_detected')}, 6) AS no_quad_detected_rate,
  count(*) FILTER (WHERE dewarp_applied) AS dewarp_applied_count, count(*) FILTER (WHERE low_contrast_after_enhance) AS low_contrast_count,
  count(*) FILTER (WHERE too_small_final) AS too_small_count, round(sum(processing_time) / count(*), 6) AS avg_processing_time,
  count(*) FILTER (WHERE warned OR dewarp_applied) AS pages_with_flags"""
_FLAG_RATES = {"orientation_accuracy", "overcrop_risk_rate", "no_quad_detected_rate", "avg_processing_time"}
QUERIES["flag_statistics"] = lambda s, d: _rounded(Q.flag_statistics(flags(s, d)), _FLAG_RATES)
ORACLE["flag_statistics"] = B.sql(f"SELECT {_FLAG_STATS} FROM marked", B.PAGE_MEASURES, FLAGS)
QUERIES["flag_statistics_by_batch"] = lambda s, d: _rounded(Q.flag_statistics(flags(s, d), ["batch"]), _FLAG_RATES)
ORACLE["flag_statistics_by_batch"] = B.sql(f"SELECT batch, {_FLAG_STATS} FROM marked GROUP BY batch", B.PAGE_MEASURES, FLAGS)

# A4, P20
_TIMED = "processing_time) FILTER (WHERE processing_time > 0)"
_REPORT = f"""count(*) AS pages, round({_RATE.format('NOT low_confidence_orientation')}, 6) AS orientation_accuracy,
  count(*) FILTER (WHERE overcrop_risk) AS overcrop_risk_count, round({_RATE.format('no_quad_detected')}, 6) AS no_quad_rate,
  round(avg({_TIMED}, 6) AS avg_time, round(min({_TIMED}, 6) AS min_time, round(max({_TIMED}, 6) AS max_time,
  round(avg(abs(deskew_angle)), 6) AS avg_deskew_angle,
  round(avg(deskew_confidence) FILTER (WHERE deskew_confidence > 0), 6) AS avg_deskew_confidence,
  count(*) FILTER (WHERE warned) AS pages_with_warnings, count(*) FILTER (WHERE capture_type = 'SCAN') AS scan_count,
  count(*) FILTER (WHERE capture_type = 'PHOTO') AS photo_count, count(*) FILTER (WHERE rotated) AS rotations_applied,
  count(*) FILTER (WHERE abs(deskew_angle) >= 0.1) AS deskews_applied, count(*) FILTER (WHERE dewarp_applied) AS crops_applied,
  round(median({_TIMED}, 6) AS median_time, round(max({_TIMED} - min({_TIMED}, 6) AS time_spread,
  round(abs(avg({_TIMED} - median({_TIMED}), 6) AS mean_median_gap"""
_REPORT_FIGURES = {"orientation_accuracy", "no_quad_rate", "avg_time", "min_time", "max_time", "avg_deskew_angle", "avg_deskew_confidence",
                   "median_time", "time_spread", "mean_median_gap"}
QUERIES["report_statistics"] = lambda s, d: _rounded(Q.report_statistics(flags(s, d)), _REPORT_FIGURES)
ORACLE["report_statistics"] = B.sql(f"SELECT {_REPORT} FROM marked", B.PAGE_MEASURES, FLAGS)
QUERIES["report_statistics_by_batch"] = lambda s, d: _rounded(Q.report_statistics(flags(s, d), ["batch"]), _REPORT_FIGURES)
ORACLE["report_statistics_by_batch"] = B.sql(f"SELECT batch, {_REPORT} FROM marked GROUP BY batch", B.PAGE_MEASURES, FLAGS)


def time_warnings(s, d):
    """Times are cubed so that some batches are skewed."""
    cubed = flags(s, d).withColumn("processing_time", F.round(F.pow("processing_time", 3)))
    warned = Q.time_warnings(Q.report_statistics(cubed, ["batch"]))
    return warned.select("batch", rounded(F.col("gap_percent"), 4).alias("gap_percent"), "time_warning")


QUERIES["time_warnings"] = time_warnings
ORACLE["time_warnings"] = B.sql("""
SELECT batch, round(gap, 4) AS gap_percent, CASE WHEN gap > 50 THEN 'outliers' WHEN gap > 30 THEN 'asymmetric' END AS time_warning
FROM (SELECT batch, abs(avg(t) - median(t)) / median(t) * 100 AS gap
      FROM (SELECT batch, round(pow(processing_time, 3)) AS t FROM flags) WHERE t > 0 GROUP BY batch)""", B.PAGE_MEASURES, FLAGS)

# P18
QUERIES["badges"] = lambda s, d: Q.badges(flags(s, d), KEYS)
_BADGES = {
    "Rotation": "CASE WHEN rotated THEN 'applied' ELSE 'inactive' END",
    "Deskew": "CASE deskew_status WHEN 'success' THEN 'applied' WHEN 'low_confidence' THEN 'skipped' WHEN 'angle_too_small' THEN 'skipped' ELSE 'inactive' END",
    "Crop": "CASE crop_status WHEN 'cropped' THEN 'applied' WHEN 'already_cropped' THEN 'skipped' WHEN 'skipped_scan' THEN 'skipped' ELSE 'inactive' END",
    "Dewarp": "CASE WHEN dewarp_applied THEN 'applied' ELSE 'inactive' END",
    "Capture Type": "CASE WHEN capture_type IN ('SCAN', 'PHOTO') THEN 'info' ELSE 'inactive' END",
    "Low Conf": "CASE WHEN low_confidence_orientation THEN 'warning' ELSE 'inactive' END",
    "Overcrop": "CASE WHEN overcrop_risk THEN 'warning' ELSE 'inactive' END",
    "No Quad": "CASE WHEN no_quad_detected THEN 'warning' ELSE 'inactive' END",
    "Low Contrast": "CASE WHEN low_contrast_after_enhance THEN 'warning' ELSE 'inactive' END",
    "Too Small": "CASE WHEN too_small_final THEN 'warning' ELSE 'inactive' END",
}
ORACLE["badges"] = B.sql(
    " UNION ALL ".join(f"SELECT {KEY_SQL}, '{n}' AS badge, {e} AS state FROM flags" for n, e in _BADGES.items()), B.PAGE_MEASURES, FLAGS)

# P19
QUERIES["confidence_bands"] = lambda s, d: Q.confidence_bands(flags(s, d)).select(*KEYS, "orientation_band", "deskew_band")
ORACLE["confidence_bands"] = B.sql(f"""
SELECT {KEY_SQL}, CASE WHEN orientation_confidence >= 0.7::DOUBLE THEN 'good' WHEN orientation_confidence > 0 THEN 'bad' ELSE 'n/a' END AS orientation_band,
  CASE WHEN deskew_confidence >= 0.75 THEN 'good' WHEN deskew_confidence >= 0.4::DOUBLE THEN 'fair' WHEN deskew_confidence > 0 THEN 'poor' ELSE 'n/a' END AS deskew_band
FROM flags""", B.PAGE_MEASURES, FLAGS)

# K1
def page_records(s, d):
    """The JSON records, read back with the sidecar schema."""
    back = K.page_records(flags(s, d), KEYS).withColumn("r", F.from_json("record", FLAG_SCHEMA))
    return back.select(
        *KEYS, *[f"r.{n}" for n in Q.WARNINGS], "r.rotated", "r.orientation_confidence", "r.deskew_angle", "r.capture_type",
        F.size("r.crop_margins").cast("bigint").alias("margins"), F.col("r.crop_margins")["top"].alias("margin_top"),
        F.get("r.final_resolution", F.lit(0)).cast("bigint").alias("final_width"), "r.capture_white_percentage")


QUERIES["page_records"] = page_records
ORACLE["page_records"] = B.sql(f"""
SELECT {KEY_SQL}, {', '.join(Q.WARNINGS)}, rotated, orientation_confidence, deskew_angle, capture_type,
  CASE WHEN crop_status = 'cropped' THEN 4 ELSE 0 END AS margins, CASE WHEN crop_status = 'cropped' THEN margin_top END AS margin_top,
  final_width, white_fraction AS capture_white_percentage FROM flags""", B.PAGE_MEASURES, FLAGS)


# K1: all four kinds, written side by side and read back as VARIANT
def stored_records(s, d):
    base = run_dir(s, "records")
    line = F.struct("line_no", "text", "confidence", F.array("x1", "y1", "x2", "y2").alias("bounding_box"))
    pages = B.text_lines(s, d).groupBy("doc_id", "page_index").agg(F.sort_array(F.collect_list(line)).alias("ocr_lines"))  # 40 lines a page at most
    checks = "CAST(CASE WHEN doc_id % 2 = 0 THEN array(named_struct('position', CAST(NULL AS ARRAY<DOUBLE>), 'checked', true, 'confidence', 0.5D)) END AS ARRAY<STRUCT<position: ARRAY<DOUBLE>, checked: BOOLEAN, confidence: DOUBLE>>)"
    measured = flags(s, d).withColumns({"input_path": F.concat(F.lit("in/"), F.col("page_key").cast("string")), "processed_path": F.concat(F.lit("out/"), F.col("page_key").cast("string"))})
    logs = parse_transform_logs(B.transform_logs(s, d), ["page_key"]).withColumn("output_original_path", F.when(F.col("page_key") % 2 == 0, F.concat(F.lit("orig/"), F.col("page_key").cast("string"))))
    writes = [(pages.withColumn("checkboxes", F.expr(checks)), ["doc_id", "page_index"], "features"), (measured, KEYS, "flags"),
              (measured, KEYS, "preprocessing"), (logs, KEYS[1:], "transforms")]
    with ThreadPoolExecutor(len(writes)) as pool:  # side by side, so that cores left by the last tasks of one kind work on the next
        for done in [pool.submit(inheritable_thread_target(s)(K.write_page_records), rows, base, keys, kind) for rows, keys, kind in writes]:
            done.result()
    # A record is cast once, to the fields named here; a field that it has not is null.
    fields = {
        "features": "ocr_lines: array<struct<text: string>>, checkboxes: array<struct<position: array<bigint>>>",
        "flags": "final_resolution: array<variant>, crop_margins: struct<top: bigint>, rotated: boolean",
        "preprocessing": "capture_info: struct<type: string>, processed_path: string, status: string",
        "transforms": "transforms: array<struct<transform_type: string>>, output_original_path: string",
    }
    back = K.read_page_records(s, base, "doc_id bigint, page_index bigint, page_key bigint, line_key bigint").select(
        "kind", F.coalesce("doc_id", "page_key").alias("page"), F.coalesce("page_index", "line_key").alias("part"),
        *[F.when(F.col("kind") == k, F.try_variant_get("record", "$", f"struct<{f}>")).alias(k) for k, f in fields.items()])
    of = lambda **kinds: F.coalesce(*[F.when(F.col("kind") == k, v.cast("string")) for k, v in kinds.items()])
    item = lambda column, i=0: F.get(F.col(column), F.lit(i))
    return back.select(
        "kind", "page", "part",
        of(features=F.size("features.ocr_lines"), flags=F.size("flags.final_resolution"), preprocessing=F.col("preprocessing.capture_info.type"), transforms=F.size("transforms.transforms")).alias("first"),
        of(features=item("features.ocr_lines")["text"], flags=F.col("flags.crop_margins.top"), preprocessing=F.col("preprocessing.processed_path"),
           transforms=item("transforms.transforms")["transform_type"]).alias("second"),
        of(features=F.get(item("features.checkboxes")["position"], F.lit(3)), flags=F.col("flags.rotated"), preprocessing=F.col("preprocessing.status"), transforms=F.col("transforms.output_original_path")).alias("third"))


QUERIES["stored_records"] = stored_records
ORACLE["stored_records"] = B.sql("""
SELECT 'features' AS kind, doc_id AS page, page_index AS part, CAST(count(*) AS VARCHAR) AS first, arg_min(text, line_no) AS second, CASE WHEN doc_id % 2 = 0 THEN '0' END AS third
FROM text_lines GROUP BY doc_id, page_index
UNION ALL SELECT 'flags', page_key, line_key, CASE WHEN final_width IS NULL THEN '0' ELSE '2' END, CASE WHEN crop_status = 'cropped' THEN CAST(CAST(margin_top AS BIGINT) AS VARCHAR) END, CAST(rotated AS VARCHAR) FROM flags
UNION ALL SELECT 'preprocessing', page_key, line_key, capture_type, concat('out/', page_key), 'success' FROM flags
UNION ALL SELECT 'transforms', page_key, line_key, '3', t[1].n, CASE WHEN page_key % 2 = 0 THEN concat('orig/', page_key) END FROM steps""",
    B.TEXT_LINES, B.PAGE_MEASURES, FLAGS, B.TRANSFORM_ROWS, STEP_ORDER)


# K3, S3, J7: every third sidecar has no image, every fourth image has no log; jpg for odd parts
def sidecars(s, d):
    return flags(s, d).withColumn("path", F.concat_ws("/", F.lit("out"), "batch", F.concat_ws(
        "_", F.col("page_key").cast("string"), F.col("line_key").cast("string"), F.col("part_key").cast("string"))))


def _sidecar_frames(s, d):
    base = sidecars(s, d)
    cards = base.withColumn("path", F.concat("path", F.lit(".qa.json")))
    images = base.where("part_key % 3 <> 0").select(
        F.concat("path", F.when(F.col("part_key") % 2 == 0, ".png").otherwise(".jpg")).alias("path")).distinct()
    logs = base.where("part_key % 4 <> 0").select(F.concat("path", F.lit(".transform.json")).alias("path"), F.lit("log").alias("transforms")).distinct()
    return cards, images, logs


def sidecar_pages(s, d):
    cards, images, logs = _sidecar_frames(s, d)
    return Q.sidecar_pages(cards, images, logs).select("page_name", "image_path", F.col("transforms").isNotNull().alias("has_log"), *NAMES)


_PAGE_NAME = "concat(page_key, '_', line_key, '_', part_key)"
QUERIES["sidecar_pages"] = sidecar_pages
ORACLE["sidecar_pages"] = B.sql(f"""
SELECT {_PAGE_NAME} AS page_name, concat('out/', batch, '/', {_PAGE_NAME}, CASE WHEN part_key % 2 = 0 THEN '.png' ELSE '.jpg' END) AS image_path,
  part_key % 4 <> 0 AS has_log, {', '.join(NAMES)} FROM flags WHERE part_key % 3 <> 0""", B.PAGE_MEASURES, FLAGS)


def metadata_document(s, d):
    cards, images, _ = _sidecar_frames(s, d)
    return _rounded(K.metadata_document(cards, Q.sidecar_pages(cards, images)), _FLAG_RATES)


QUERIES["metadata_document"] = metadata_document
ORACLE["metadata_document"] = B.sql(
    f"SELECT (SELECT count(*) FROM flags) AS total_pages, {_FLAG_STATS} FROM marked WHERE part_key % 3 <> 0", B.PAGE_MEASURES, FLAGS)

# O2
_ROW = KEYS + ["orientation_confidence", "deskew_angle"]
QUERIES["flag_table_by_confidence"] = lambda s, d: Q.flag_table(
    flags(s, d), "orientation_confidence", "confidence", ascending=False, ties=KEYS).select(*_ROW)
ORACLE["flag_table_by_confidence"] = B.sql(
    f"SELECT {', '.join(_ROW)} FROM flags ORDER BY CASE WHEN orientation_confidence > 0 THEN orientation_confidence ELSE -1 END DESC, {KEY_SQL}",
    B.PAGE_MEASURES, FLAGS)

# W6, O5: ties of the order are equal in every output column
_ORDER = ["processing_time", "page_key", "line_key", "part_key", "batch"]


def _order():
    return [F.col("processing_time").desc()] + [F.col(c) for c in _ORDER[1:]]


_ORDER_SQL = "processing_time DESC, " + ", ".join(_ORDER[1:])
QUERIES["report_positions"] = lambda s, d: Q.report_positions(
    flags(s, d).select(*_ORDER), _order()).select("position", *_ORDER)
ORACLE["report_positions"] = B.sql(f"SELECT row_number() OVER (ORDER BY {_ORDER_SQL}) AS position, {', '.join(_ORDER)} FROM flags",
                                   B.PAGE_MEASURES, FLAGS)
for _name, _start in (("report_first_page", 0), ("report_second_page", 10)):
    QUERIES[_name] = lambda s, d, start=_start: Q.report_page(flags(s, d).select(*_ORDER), _order(), start)
    ORACLE[_name] = B.sql(f"SELECT {', '.join(_ORDER)} FROM flags ORDER BY {_ORDER_SQL} LIMIT 10 OFFSET {_start}", B.PAGE_MEASURES, FLAGS)


# F7
def margin_maps(s, d):
    cropped = flags(s, d).where("crop_margins IS NOT NULL")
    thin = F.exists(F.map_values("crop_margins"), lambda m: m < 8)
    return cropped.select(*KEYS, F.array_min(F.map_values("crop_margins")).alias("smallest"), thin.alias("thin"))


QUERIES["margin_maps"] = margin_maps
ORACLE["margin_maps"] = B.sql(f"""
SELECT {KEY_SQL}, least(margin_top, margin_bottom, margin_left, margin_right) AS smallest,
  least(margin_top, margin_bottom, margin_left, margin_right) < 8 AS thin FROM flags WHERE crop_status = 'cropped'""", B.PAGE_MEASURES, FLAGS)

"""Page geometry, capture type and transform replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import quads
from pagemill.functions.frames import once
from pagemill.functions.numbers import rounded
from pagemill.operators import capture as C
from pagemill.operators import geometry as G
from pagemill.operators import transforms as X
from pagemill.plans import bindings as B
from pagemill.sources.records import parse_transform_logs

QUERIES, ORACLE = {}, {}
ANGLE_KEYS = ["page_key", "line_key", "raw_angle", "width", "height"]

# P6
QUERIES["orientation_normalised"] = lambda s, d: G.normalise_orientation(B.page_angles(s, d)).select(
    "page_key", "line_key", "raw_angle", F.col("orientation_angle").cast("bigint").alias("angle"),
    rounded(F.col("orientation_confidence")).alias("confidence"), "needs_rotation")
_TURN = "((raw_angle % 360) + 360) % 360"
_RIGHT = f"CASE WHEN {_TURN} <= 45 THEN 0 WHEN {_TURN} <= 135 THEN 90 WHEN {_TURN} <= 225 THEN 180 ELSE 270 END"
_NORMAL = f"""
normal AS (SELECT *, CAST({_RIGHT} AS BIGINT) AS angle, greatest(0.0::DOUBLE, least(1.0::DOUBLE, raw_confidence)) AS confidence
           FROM page_angles)"""
ORACLE["orientation_normalised"] = B.sql(
    "SELECT page_key, line_key, raw_angle, angle, round(confidence, 6) AS confidence, angle <> 0 AS needs_rotation FROM normal",
    B.PAGE_ANGLES, _NORMAL)

# P7
QUERIES["orientation_from_scores"] = lambda s, d: G.orientation_from_scores(B.class_scores(s, d)).select(
    "page_key", "angle", rounded(F.col("confidence")).alias("confidence"), "processed")
PROBS = """
summed AS (SELECT page_key, scores, list_sum(scores) AS total, list_max(scores) AS top,
    len(list_filter(scores, lambda v: v < 0 OR v > 1)) > 0 AS logits FROM class_scores),
exps AS (SELECT *, list_transform(scores, lambda v: exp(v - top)) AS e FROM summed),
probs AS (SELECT page_key, CASE WHEN logits THEN list_transform(e, lambda v: v / list_sum(e))
    WHEN total > 0 THEN list_transform(scores, lambda v: v / total) ELSE scores END AS p FROM exps)"""
ORACLE["orientation_from_scores"] = B.sql("""
SELECT page_key, CAST((list_position(p, list_max(p)) - 1) * 90 AS BIGINT) AS angle, round(list_max(p), 6) AS confidence,
       true AS processed FROM probs""", B.CLASS_SCORES, PROBS)


# P8
def capture_types(s, d):
    pages = B.page_luma(s, d).withColumn("white_fraction", C.white_share(F.col("luma")))
    return C.capture_types(pages).select(
        "page_key", "capture_type", rounded(F.col("capture_white")).alias("white"), rounded(F.col("capture_confidence")).alias("confidence"))


QUERIES["capture_types"] = capture_types
ORACLE["capture_types"] = B.sql("""
SELECT page_key, CASE WHEN w > 0.7::DOUBLE THEN 'SCAN' ELSE 'PHOTO' END AS capture_type, round(w, 6) AS white,
       round(least(1, abs(w - 0.7::DOUBLE) * 2), 6) AS confidence
FROM (SELECT page_key, CAST(len(list_filter(luma, lambda v: v > 245)) AS DOUBLE) / len(luma) AS w FROM page_luma)""", B.PAGE_LUMA)

# A9, A10
QUERIES["white_shares"] = lambda s, d: C.white_shares(C.luma_counts(B.page_luma(s, d))).select(
    "page_key", rounded(F.col("white_fraction")).alias("white"))
ORACLE["white_shares"] = B.sql("""
SELECT page_key, round(CAST(count(*) FILTER (WHERE v > 245) AS DOUBLE) / count(*), 6) AS white
FROM (SELECT page_key, unnest(luma) AS v FROM page_luma) GROUP BY page_key""", B.PAGE_LUMA)
QUERIES["contrasts"] = lambda s, d: C.contrasts(C.luma_counts(B.page_luma(s, d))).select(
    "page_key", rounded(F.col("contrast"), 5).alias("contrast"))
ORACLE["contrasts"] = B.sql("""
SELECT page_key, round(stddev_pop(v), 5) AS contrast FROM (SELECT page_key, unnest(luma) AS v FROM page_luma) GROUP BY page_key""",
    B.PAGE_LUMA)

# P9, U4
DETECTION_KEYS = ["page_key", "line_key", "part_key", "supp_key"]
_XY = [f"corners[{i}][{j}]" for i in range(1, 5) for j in (1, 2)]


def ordered_quads(s, d):
    pages = once(quads.corner_indices(quads.four_points(B.page_detections(s, d))), {"quad": quads.ordered()})
    flat = [F.get(F.get("quad", F.lit(i)), F.lit(j)).alias(f"{'xy'[j]}{i}") for i in range(4) for j in range(2)]
    return pages.select(*DETECTION_KEYS, F.col("quad").isNull().alias("unusable"), *[rounded(c).alias(f"{'xy'[k % 2]}{k // 2}") for k, c in enumerate(flat)])


_INDEXED = """
sums AS (SELECT *, [corners[1][1] + corners[1][2], corners[2][1] + corners[2][2], corners[3][1] + corners[3][2], corners[4][1] + corners[4][2]] AS s
         FROM page_detections),
ends AS (SELECT *, list_position(s, list_min(s)) AS tl, list_position(s, list_max(s)) AS br FROM sums),
rest AS (SELECT *, list_filter([1, 2, 3, 4], lambda i: i <> tl AND i <> br) AS others FROM ends),
turned AS (SELECT *, CASE WHEN len(corners) IS DISTINCT FROM 4 THEN NULL
        WHEN corners[others[1]][1] > corners[others[2]][1] THEN [corners[tl], corners[others[1]], corners[br], corners[others[2]]]
        ELSE [corners[tl], corners[others[2]], corners[br], corners[others[1]]] END AS quad FROM rest)"""
QUERIES["ordered_quads"] = ordered_quads
ORACLE["ordered_quads"] = B.sql(
    f"SELECT {', '.join(DETECTION_KEYS)}, quad IS NULL AS unusable, "
    + ", ".join(f"round(quad[{i + 1}][{j + 1}], 6) AS {'xy'[j]}{i}" for i in range(4) for j in range(2)) + " FROM turned",
    B.PAGE_DETECTIONS, _INDEXED)


def other_corners(s, d):
    pages = quads.corner_indices(quads.four_points(B.page_detections(s, d).where(F.size("corners") == 4)))
    return pages.select(*DETECTION_KEYS, F.col("_a").cast("bigint").alias("first"), F.col("_b").cast("bigint").alias("second"))


QUERIES["other_corners"] = other_corners
ORACLE["other_corners"] = B.sql(
    f"SELECT {', '.join(DETECTION_KEYS)}, CAST(others[1] - 1 AS BIGINT) AS first, CAST(others[2] - 1 AS BIGINT) AS second FROM rest WHERE len(corners) = 4",
    B.PAGE_DETECTIONS, _INDEXED)


# P10
def polygon_shares(s, d):
    pages = B.page_detections(s, d).where(F.size("corners") >= 4)
    # Four points by the direct rule, longer lists by the general one.
    pixels = pages.withColumn("_polygon", F.when(F.size("corners") > 4, quads.area(quads.scaled(F.col("corners"), F.col("width"), F.col("height")))))
    placed = quads.four_points(pixels, "corners", (F.col("width"), F.col("height")))
    return placed.select(*DETECTION_KEYS, (F.coalesce(quads.quad_area(), F.col("_polygon")) / (F.col("width") * F.col("height"))).alias("area_ratio"))


_AREA = """
pixels AS (SELECT * REPLACE (CASE WHEN list_max(flatten(corners)) <= 1 THEN list_transform(corners, lambda c: [c[1] * width, c[2] * height])
                             ELSE corners END AS corners) FROM page_detections),
truncated AS (SELECT *, list_transform(corners, lambda c: [trunc(c[1]), trunc(c[2])]) AS t FROM pixels),
areas AS (SELECT * EXCLUDE (t), abs(list_sum(list_transform(range(1, len(t) + 1), lambda i:
        t[i][1] * t[CASE WHEN i = len(t) THEN 1 ELSE i + 1 END][2] - t[CASE WHEN i = len(t) THEN 1 ELSE i + 1 END][1] * t[i][2]))) / 2
        / (width * height) AS area_share FROM truncated)"""
QUERIES["polygon_shares"] = polygon_shares
ORACLE["polygon_shares"] = B.sql(f"SELECT {', '.join(DETECTION_KEYS)}, area_share AS area_ratio FROM areas WHERE len(corners) >= 4",
                                 B.PAGE_DETECTIONS, _AREA)

# P11, P12, P13
_DECIDED = _AREA + "," + _INDEXED.replace("FROM page_detections", "FROM areas") + """,
sides AS (SELECT *, list_min(list_transform(corners, lambda c: c[2])) / height * 100 AS m_top,
    (height - list_max(list_transform(corners, lambda c: c[2]))) / height * 100 AS m_bottom,
    list_min(list_transform(corners, lambda c: c[1])) / width * 100 AS m_left,
    (width - list_max(list_transform(corners, lambda c: c[1]))) / width * 100 AS m_right FROM turned),
decided AS (SELECT *, CASE WHEN capture_type = 'SCAN' THEN 'skipped_scan' WHEN corners IS NULL OR len(corners) = 0 THEN 'no_detection'
    WHEN len(corners) < 4 THEN 'invalid_geometry' WHEN area_share > 0.85::DOUBLE THEN 'already_cropped'
    WHEN quad IS NULL THEN 'error' WHEN least(m_top, m_bottom, m_left, m_right) < 8 THEN 'rejected_overcrop' ELSE 'cropped' END AS crop_status
    FROM sides)"""
QUERIES["crop_decisions"] = lambda s, d: G.crop_decisions(B.page_detections(s, d)).select(
    *DETECTION_KEYS, "crop_status", "crop_applied", "area_ratio")
ORACLE["crop_decisions"] = B.sql(f"""
SELECT {', '.join(DETECTION_KEYS)}, crop_status, crop_status = 'cropped' AS crop_applied,
       CASE WHEN crop_status IN ('already_cropped', 'rejected_overcrop', 'cropped', 'error') THEN area_share ELSE 1 END AS area_ratio
FROM decided""", B.PAGE_DETECTIONS, _DECIDED)
QUERIES["crop_margins"] = lambda s, d: G.crop_decisions(B.page_detections(s, d)).where("margins IS NOT NULL").select(
    *DETECTION_KEYS, *[rounded(F.col(f"margins.{e}")).alias(e) for e in quads.EDGES])
ORACLE["crop_margins"] = B.sql(f"""
SELECT {', '.join(DETECTION_KEYS)}, {', '.join(f'round(m_{e}, 6) AS "{e}"' for e in quads.EDGES)}
FROM decided WHERE crop_status IN ('cropped', 'rejected_overcrop')""", B.PAGE_DETECTIONS, _DECIDED)
QUERIES["crop_output_sizes"] = lambda s, d: G.crop_decisions(B.page_detections(s, d)).where("crop_applied").select(
    *DETECTION_KEYS, F.col("output_size.width").alias("out_width"), F.col("output_size.height").alias("out_height"))


def _edge(i, j):
    return f"sqrt((quad[{i}][1] - quad[{j}][1]) * (quad[{i}][1] - quad[{j}][1]) + (quad[{i}][2] - quad[{j}][2]) * (quad[{i}][2] - quad[{j}][2]))"


ORACLE["crop_output_sizes"] = B.sql(f"""
SELECT {', '.join(DETECTION_KEYS)}, CAST(trunc(greatest({_edge(2, 1)}, {_edge(3, 4)})) AS BIGINT) AS out_width,
       CAST(trunc(greatest({_edge(4, 1)}, {_edge(3, 2)})) AS BIGINT) AS out_height FROM decided WHERE crop_status = 'cropped'""",
    B.PAGE_DETECTIONS, _DECIDED)

# P14
QUERIES["deskew_decisions"] = lambda s, d: G.deskew_decisions(B.page_angles(s, d)).select(
    *ANGLE_KEYS, "skew_angle", "skew_confidence", "deskew_status", "deskew_applied")
ORACLE["deskew_decisions"] = B.sql(f"""
SELECT *, deskew_status = 'success' AS deskew_applied FROM (SELECT {', '.join(ANGLE_KEYS)}, skew_angle, skew_confidence,
  CASE WHEN abs(skew_angle) < 0.1 THEN 'skipped' WHEN abs(skew_angle) < 0.5 THEN 'angle_too_small'
       WHEN skew_confidence < 0.2::DOUBLE THEN 'low_confidence' ELSE 'success' END AS deskew_status FROM page_angles)""", B.PAGE_ANGLES)

# P15
QUERIES["deskew_canvas"] = lambda s, d: G.deskew_canvas(B.page_angles(s, d)).select(
    *ANGLE_KEYS, "skew_angle", "canvas_width", "canvas_height",
    *[rounded(F.col("matrix")[i][j], 5).alias(f"m{i}{j}") for i in range(2) for j in range(3)])
ORACLE["deskew_canvas"] = B.sql(f"""
SELECT {', '.join(ANGLE_KEYS)}, skew_angle, canvas_width, canvas_height, round(a, 5) AS m00, round(b, 5) AS m01,
  round((1 - a) * cx - b * cy + canvas_width / 2 - cx, 5) AS m02, round(-b, 5) + 0 AS m10, round(a, 5) AS m11,
  round(b * cx + (1 - a) * cy + canvas_height / 2 - cy, 5) AS m12
FROM (SELECT *, CAST(trunc(height * abs(b) + width * abs(a)) AS BIGINT) AS canvas_width, CAST(trunc(height * abs(a) + width * abs(b)) AS BIGINT) AS canvas_height
      FROM (SELECT *, cos(radians(skew_angle)) AS a, sin(radians(skew_angle)) AS b, width // 2 AS cx, height // 2 AS cy FROM page_angles))""",
    B.PAGE_ANGLES)

# P16
QUERIES["rotation_decisions"] = lambda s, d: G.rotation_decisions(G.normalise_orientation(B.page_angles(s, d))).select(
    *ANGLE_KEYS, "rotation_status", "rotation_applied", F.col("applied_angle").cast("bigint").alias("applied_angle"),
    F.col("logged_angle").cast("bigint").alias("logged_angle"))
ORACLE["rotation_decisions"] = B.sql(f"""
SELECT {', '.join(ANGLE_KEYS)}, CASE WHEN angle = 0 THEN NULL WHEN confidence < 0.7::DOUBLE THEN 'rejected' ELSE 'applied' END AS rotation_status,
  angle <> 0 AND confidence >= 0.7::DOUBLE AS rotation_applied, CASE WHEN confidence >= 0.7::DOUBLE THEN angle ELSE 0 END AS applied_angle,
  nullif(angle, 0) AS logged_angle FROM normal""", B.PAGE_ANGLES, _NORMAL)

# P22
QUERIES["read_sizes"] = lambda s, d: G.read_sizes(B.page_angles(s, d).withColumn("dpi", F.expr("72 + page_key % 500")), "dpi").select(
    *ANGLE_KEYS, "effective_dpi", "read_width", "read_height")
ORACLE["read_sizes"] = B.sql(f"""
SELECT {', '.join(ANGLE_KEYS)}, greatest(72 + page_key % 500, 300) AS effective_dpi,
  CASE WHEN greatest(width, height) > 3500 THEN CAST(trunc(width * (3500::DOUBLE / greatest(width, height))) AS BIGINT) ELSE width END AS read_width,
  CASE WHEN greatest(width, height) > 3500 THEN CAST(trunc(height * (3500::DOUBLE / greatest(width, height))) AS BIGINT) ELSE height END AS read_height
FROM page_angles""", B.PAGE_ANGLES)

# A8
QUERIES["skew_estimates"] = lambda s, d: G.skew_estimates(B.line_angles(s, d)).select(
    "page_key", rounded(F.col("skew_angle")).alias("skew_angle"), rounded(F.col("skew_confidence")).alias("skew_confidence"), "lines")
ORACLE["skew_estimates"] = B.sql("""
SELECT page_key, CASE WHEN abs(any_value(med)) <= 15 THEN any_value(med) ELSE 0 END AS skew_angle,
  CASE WHEN abs(any_value(med)) <= 15 THEN round(avg(CASE WHEN abs(a - med) <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) ELSE 0 END AS skew_confidence,
  count(*) AS lines
FROM (SELECT page_key, a, median(a) OVER (PARTITION BY page_key) AS med FROM
      (SELECT page_key, CASE WHEN theta - 90 < -45 THEN theta WHEN theta - 90 > 45 THEN theta - 180 ELSE theta - 90 END AS a FROM line_angles))
GROUP BY page_key""", B.LINE_ANGLES)


# J6
def preprocessed_pages(s, d):
    pages = B.files(s, d).select("page_id", "path")
    cards = B.files(s, d).where("page_id % 3 <> 0").selectExpr(
        "path", "CASE WHEN page_id % 2 = 0 THEN 'SCAN' ELSE 'PHOTO' END AS capture_type", "concat(path, '.orig') AS original_path")
    return G.with_preprocessing(pages, cards).select("page_id", "path", "capture_type", "original_path")


QUERIES["preprocessed_pages"] = preprocessed_pages
ORACLE["preprocessed_pages"] = B.sql("""
SELECT page_id, path, CASE WHEN page_id % 3 <> 0 AND page_id % 2 = 0 THEN 'SCAN' ELSE 'PHOTO' END AS capture_type,
  CASE WHEN page_id % 3 <> 0 THEN concat(path, '.orig') ELSE path END AS original_path FROM files""", B.FILES)

# S4, O1
LOG_KEYS = ["page_key", "line_key", "part_key", "supp_key"]
QUERIES["transform_logs"] = lambda s, d: parse_transform_logs(B.transform_logs(s, d), ["page_key"]).select(
    *LOG_KEYS, "output_path", F.size("transforms").cast("bigint").alias("steps"),
    F.expr("CAST(aggregate(transforms, 0, (a, t) -> a + t.`order`) AS BIGINT)").alias("order_sum"))
ORACLE["transform_logs"] = B.sql(
    f"SELECT {', '.join(LOG_KEYS)}, output_path, CAST(3 AS BIGINT) AS steps, CAST(crop_order + deskew_order + rotation_order AS BIGINT) AS order_sum FROM transform_rows",
    B.TRANSFORM_ROWS)


def sorted_transforms(s, d):
    logs = parse_transform_logs(B.transform_logs(s, d), ["page_key"]).withColumn("t", X.sorted_transforms(F.col("transforms")))
    return logs.select(*LOG_KEYS, F.array_join(F.transform("t", lambda t: t["transform_type"]), ">").alias("steps"))


# Place in the log breaks ties: deskew 0, rotation 1, crop 2.
_STEP_ORDER = """
steps AS (SELECT *, list_sort([{'o': deskew_order, 'i': 0, 'n': 'deskew'}, {'o': rotation_order, 'i': 1, 'n': 'rotation'},
                              {'o': crop_order, 'i': 2, 'n': 'crop'}]) AS t FROM transform_rows)"""
QUERIES["sorted_transforms"] = sorted_transforms
ORACLE["sorted_transforms"] = B.sql(
    f"SELECT {', '.join(LOG_KEYS)}, array_to_string(list_transform(t, lambda x: x.n), '>') AS steps FROM steps", B.TRANSFORM_ROWS, _STEP_ORDER)


# M9
def replayed_points(s, d):
    logs = parse_transform_logs(B.transform_logs(s, d), ["page_key"]).withColumn("corners", F.expr(
        "array(array(CAST(part_key % 100 AS DOUBLE), CAST(supp_key % 90 AS DOUBLE)), array(CAST(500 AS DOUBLE), CAST(600 AS DOUBLE)))"))
    moved = X.replay(logs)
    return moved.select(*LOG_KEYS, rounded(F.col("moved")[0][0], 4).alias("x0"), rounded(F.col("moved")[0][1], 4).alias("y0"),
                        rounded(F.col("moved")[1][0], 4).alias("x1"), rounded(F.col("moved")[1][1], 4).alias("y1"),
                        F.col("final_width").alias("w"), F.col("final_height").alias("h"))


_KEEP = "page_key, line_key, part_key, supp_key, width, height, angle, free, depth, t"


def _replay_step(source, k):
    """The k-th step's matrix (by rows) and size after it, then its product with what came before."""
    n = f"t[{k}].n"
    a, b = "cos(radians(angle))", "sin(radians(angle))"
    cx, cy = "floor(w / 2)", "floor(h / 2)"
    matrix = f"""CASE WHEN {n} = 'rotation' AND free THEN [{a}, {b}, (1 - {a}) * {cx} - {b} * {cy}, -{b}, {a}, {b} * {cx} + (1 - {a}) * {cy}, 0, 0, 1]
      WHEN {n} = 'rotation' AND angle = 90 THEN [0, -1, h - 1, 1, 0, 0, 0, 0, 1] WHEN {n} = 'rotation' AND angle = 180 THEN [-1, 0, w - 1, 0, -1, h - 1, 0, 0, 1]
      WHEN {n} = 'rotation' AND angle = 270 THEN [0, 1, 0, -1, 0, w - 1, 0, 0, 1] WHEN {n} = 'crop' THEN [2, 0, 0, 0, 2, 0, 0, depth, 1]
      WHEN {n} = 'deskew' THEN [1, 0, part_key % 7, 0, 1, supp_key % 5, 0, 0, 1] ELSE [1, 0, 0, 0, 1, 0, 0, 0, 1] END::DOUBLE[]"""
    size = "CASE WHEN {n} = 'rotation' AND NOT free AND angle IN (90, 270) THEN {o} WHEN {n} IN ('crop', 'deskew') THEN 2 * {f} ELSE {s} END"
    cells = ", ".join(" + ".join(f"s[{3 * i + c + 1}] * m[{3 * c + j + 1}]" for c in range(3)) for i in range(3) for j in range(3))
    return f"""SELECT {_KEEP}, [{cells}] AS m, w2 AS w, h2 AS h
      FROM (SELECT *, {matrix} AS s, {size.format(n=n, o='h', f='width', s='w')} AS w2, {size.format(n=n, o='w', f='height', s='h')} AS h2 FROM ({source}))"""


_START = f"SELECT {_KEEP}, [1, 0, 0, 0, 1, 0, 0, 0, 1]::DOUBLE[] AS m, CAST(width AS DOUBLE) AS w, CAST(height AS DOUBLE) AS h FROM steps"
_POINTS = {"0": ("part_key % 100", "supp_key % 90"), "1": ("500", "600")}
_PLACED = ", ".join(
    f"round((m[{i}] * ({x}) + m[{i + 1}] * ({y}) + m[{i + 2}]) / (m[7] * ({x}) + m[8] * ({y}) + m[9]), 4) AS {axis}{k}"
    for k, (x, y) in _POINTS.items() for axis, i in (("x", 1), ("y", 4)))
QUERIES["replayed_points"] = replayed_points
ORACLE["replayed_points"] = B.sql(
    f"SELECT page_key, line_key, part_key, supp_key, {_PLACED}, w, h FROM ({_replay_step(_replay_step(_replay_step(_START, 1), 2), 3)})",
    B.TRANSFORM_ROWS, _STEP_ORDER)

# F5
QUERIES["rotation_matrices"] = lambda s, d: B.page_angles(s, d).withColumn(
    "m", G.rotation_matrix(F.col("skew_angle"), F.expr("width div 2"), F.expr("height div 2"))).select(
    *ANGLE_KEYS, "skew_angle", *[rounded(F.col("m")[i][j], 5).alias(f"m{i}{j}") for i in range(2) for j in range(3)])
ORACLE["rotation_matrices"] = B.sql(f"""
SELECT {', '.join(ANGLE_KEYS)}, skew_angle, round(a, 5) AS m00, round(b, 5) AS m01, round((1 - a) * cx - b * cy, 5) AS m02,
  round(-b, 5) + 0 AS m10, round(a, 5) AS m11, round(b * cx + (1 - a) * cy, 5) AS m12
FROM (SELECT *, cos(radians(skew_angle)) AS a, sin(radians(skew_angle)) AS b, width // 2 AS cx, height // 2 AS cy FROM page_angles)""",
    B.PAGE_ANGLES)

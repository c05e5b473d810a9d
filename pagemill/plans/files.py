"""File listings, upload checks, names, and the stage chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import names as N
from pagemill.functions.numbers import rounded, softmax
from pagemill.operators import stages as G
from pagemill.plans import bindings as B
from pagemill.plans import geometry as X
from pagemill.plans import lines as L
from pagemill.sources import files as S

QUERIES, ORACLE = {}, {}
_LISTED = "lower(path) LIKE '%.pdf' OR lower(path) LIKE '%.png' OR lower(path) LIKE '%.jpg' OR lower(path) LIKE '%.jpeg'" \
          " OR lower(path) LIKE '%.tiff' OR lower(path) LIKE '%.bmp'"

# S1
QUERIES["wanted_files"] = lambda s, d: S.wanted_files(B.files(s, d)).select("path", "size")
ORACLE["wanted_files"] = B.sql(f"SELECT path, size FROM files WHERE {_LISTED} ORDER BY path", B.FILES)

# S9
_EXT = "lower(regexp_extract(path, '[^/](\\.[^/.]+)$', 1))"
QUERIES["upload_checks"] = lambda s, d: S.check_uploads(B.files(s, d)).select("page_id", "extension", "reject_reason")
ORACLE["upload_checks"] = B.sql(f"""
SELECT page_id, CASE WHEN reject_reason IS NULL THEN ext END AS extension, reject_reason FROM (SELECT page_id, {_EXT} AS ext,
  CASE WHEN path IS NULL OR path = '' THEN 'name_missing' WHEN {_EXT} = '' THEN 'no_extension'
       WHEN {_EXT} NOT IN ('.pdf', '.png', '.jpg', '.jpeg', '.tiff', '.bmp') THEN 'unsupported_extension'
       WHEN size = 0 THEN 'empty_file' END AS reject_reason FROM files)""", B.FILES)


# F1
def derived_names(s, d):
    path = F.col("path")
    turned = F.when(F.col("page_id") % 2 == 0, F.regexp_replace(path, "scan_", "scan_transformed_")).otherwise(path)
    return B.files(s, d).select(
        "page_id", N.stem(path).alias("stem"), N.output_path(path, F.lit("/out/"), "clean").alias("output"),
        N.original_twin(turned).alias("original"), N.page_name(path, F.col("page_id")).alias("page_name"), N.parent_name(path).alias("folder"))


_NAME = "regexp_extract(path, '([^/]*)$', 1)"
_SUFFIX = "regexp_extract(path, '[^/](\\.[^/.]+)$', 1)"
QUERIES["derived_names"] = derived_names
ORACLE["derived_names"] = B.sql(f"""
SELECT page_id, stem, concat('/out/', stem, '_clean', ext) AS output,
  concat(CASE WHEN page_id % 2 = 0 THEN replace(stem, 'scan_', 'scan_original_') ELSE concat(stem, '_original') END, ext) AS original,
  concat(stem, '_page', page_id) AS page_name, folder
FROM (SELECT page_id, {_SUFFIX} AS ext, left({_NAME}, length({_NAME}) - length({_SUFFIX})) AS stem, regexp_extract(path, '([^/]+)/[^/]*$', 1) AS folder FROM files)""", B.FILES)

# M11
_POINTS = [("(doc_id * 7) % 200", "115 + (doc_id * 11) % 200"), ("700 + doc_id % 300", "115 + (page_index * 31 + doc_id) % 200"),
           ("700 + (doc_id * 3) % 300", "900 + doc_id % 400"), ("doc_id % 200", "900 + (doc_id * 13) % 400")]
_MEASURES = {
    "white_fraction": "CASE WHEN doc_id % 50 = 49 THEN NULL ELSE CAST((doc_id * 37 + page_index * 11) % 101 AS DOUBLE) / 100 END",
    "raw_angle": "(doc_id * 90 + page_index * 7) % 720 - 360",
    "raw_confidence": "CAST((doc_id * 13) % 130 - 10 AS DOUBLE) / 100",
    "skew_angle": "CAST(doc_id % 81 - 40 AS DOUBLE) / 2",
    "skew_confidence": "CAST((doc_id * 17) % 101 AS DOUBLE) / 100",
    "width": "1200", "height": "1500",
}
_CORNERS = "CASE WHEN doc_id % 9 = 8 THEN NULL ELSE {} END"
_SPARK_CORNERS = _CORNERS.format("array(" + ", ".join(f"array(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))" for x, y in _POINTS) + ")")
_SQL_CORNERS = _CORNERS.format("[" + ", ".join(f"[CAST({x} AS DOUBLE), CAST({y} AS DOUBLE)]" for x, y in _POINTS) + "]")
_DECISIONS = ["doc_id", "page_index", "stages", "capture_type", "crop_status", "deskew_status", "rotation_status", "class_index", "document_type", "error"]


def stage_chain(s, d):
    exprs = [f"{e} AS {n}" for n, e in _MEASURES.items()]
    pages = L.page_list(s, d).selectExpr("doc_id", "page_index", *exprs, f"{_SPARK_CORNERS} AS corners")
    # four scores from all dimensions of the meaning: dimension i counts for class i mod 4
    def part(v, k):
        return F.aggregate(F.filter(F.slice(v, 1, B.VECTOR_DIM), lambda _, i: i % 4 == k), F.lit(0.0), lambda a, x: a + x.cast("double"))

    inputs = G.Inputs(B.line_vectors(s, d), B.class_table(s), B.VECTOR_DIM, lambda v: softmax(F.array(*[part(v, k) * 10 for k in range(4)])))
    return G.run(pages, inputs).select(*_DECISIONS, rounded(F.col("confidence"), 5).alias("confidence"))


QUERIES["stage_chain"] = stage_chain
_CHAIN_PAGES = f"""
chain_pages AS (SELECT p.*, {', '.join(f'{e} AS {n}' for n, e in _MEASURES.items())}, {_SQL_CORNERS} AS corners
    FROM (SELECT DISTINCT doc_id, page_index FROM text_lines) p),
page_detections AS (SELECT *, CASE WHEN white_fraction > 0.7::DOUBLE THEN 'SCAN' ELSE 'PHOTO' END AS capture_type FROM chain_pages)"""
_CHAIN = f"""
turned_pages AS (SELECT *, {X._RIGHT} AS angle, greatest(0.0::DOUBLE, least(1.0::DOUBLE, raw_confidence)) AS o_confidence FROM decided),
page_means AS (SELECT doc_id, page_index, {', '.join("(0::DOUBLE + " + " + ".join(f"CAST(CAST({L._MEANS[i]} AS FLOAT) AS DOUBLE)" for i in range(k, B.VECTOR_DIM, 4)) + f") * 10 AS m{k}" for k in range(4))}
    FROM confident JOIN extents USING (doc_id, page_index) GROUP BY 1, 2),
class_scores AS (SELECT t.doc_id, t.page_index, [coalesce(m0, 0), coalesce(m1, 0), coalesce(m2, 0), coalesce(m3, 0)] AS scores
    FROM chain_pages t LEFT JOIN page_means m ON m.doc_id = t.doc_id AND m.page_index = t.page_index),
exps AS (SELECT doc_id, page_index, list_transform(scores, lambda v: exp(v - list_max(scores))) AS e FROM class_scores),
probs AS (SELECT doc_id, page_index, list_transform(e, lambda v: v / list_sum(e)) AS p FROM exps),
best AS (SELECT doc_id, page_index, CAST(list_position(p, list_max(p)) - 1 AS BIGINT) AS class_index, list_max(p) AS confidence FROM probs),
chained AS (SELECT t.doc_id, t.page_index, 'preprocessing>geometry>features>classification' AS stages, t.capture_type, t.white_fraction IS NOT NULL AS fine,
    t.crop_status, CASE WHEN abs(skew_angle) < 0.1 THEN 'skipped' WHEN abs(skew_angle) < 0.5 THEN 'angle_too_small'
                        WHEN skew_confidence < 0.2::DOUBLE THEN 'low_confidence' ELSE 'success' END AS deskew_status,
    CASE WHEN t.angle = 0 THEN NULL WHEN o_confidence < 0.7::DOUBLE THEN 'rejected' ELSE 'applied' END AS rotation_status,
    b.class_index, b.confidence, CASE WHEN b.confidence >= 0.6::DOUBLE THEN coalesce(c.class_name, CAST(b.class_index AS VARCHAR)) END AS document_type
  FROM turned_pages t JOIN best b ON b.doc_id = t.doc_id AND b.page_index = t.page_index LEFT JOIN class_table c ON c.class_index = b.class_index)"""
_FINE = ["crop_status", "deskew_status", "rotation_status", "class_index", "document_type"]
ORACLE["stage_chain"] = B.sql(f"""
SELECT doc_id, page_index, stages, capture_type, {', '.join(f'CASE WHEN fine THEN {c} END AS {c}' for c in _FINE)},
  CASE WHEN NOT fine THEN 'image unreadable' END AS error, CASE WHEN fine THEN round(confidence, 5) END AS confidence FROM chained""",
    B.LINE_VECTORS, L._EXTENTS.replace("FROM text_lines", "FROM line_vectors"), B.CLASS_TABLE, _CHAIN_PAGES, X._DECIDED, _CHAIN)

"""Inputs of the operators, derived from the provided tables: one Spark frame and one SQL text each.

Expressions that mean the same in both dialects are written once and used on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A provided table, in the splits it is stored in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dual(columns: dict[str, str]) -> tuple[list[str], str]:
    return [f"{e} AS {n}" for n, e in columns.items()], ", ".join(f"{e} AS {n}" for n, e in columns.items())


# --- text lines -------------------------------------------------------------------------------------

_LINE = {
    "doc_id": "doc_id",
    "line_no": "line_no",
    "text": "text",
    "confidence": "CAST((doc_id * 31 + line_no * 17) % 51 + 50 AS DOUBLE) / 100",
    "x1": "CAST((doc_id * 7 + line_no * 13) % 200 AS DOUBLE)",
    "y1": "CAST((line_no % 40) * 50 + 100 AS DOUBLE)",
    "x2": "CAST((doc_id * 7 + line_no * 13) % 200 + 50 + length(text) % 1500 AS DOUBLE)",
    "y2": "CAST((line_no % 40) * 50 + 140 AS DOUBLE)",
}
_LINE_EXPRS, _LINE_SQL = _dual(_LINE)


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return lines.selectExpr(*_LINE_EXPRS, "CAST(line_no div 40 AS BIGINT) AS page_index")


TEXT_LINES = f"""
text_parts AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
text_rows AS (SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS text FROM text_parts),
text_lines AS (SELECT {_LINE_SQL}, CAST(line_no // 40 AS BIGINT) AS page_index FROM text_rows)"""

# Every 29th line has a point with one coordinate (malformed), every 31st has no box, every 5th is a rectangle.
_MALFORMED, _BOXLESS, _PLAIN = "line_no % 29 = 0", "line_no % 31 = 0", "line_no % 5 = 0"


def text_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(spark, sf_dir).selectExpr(
        "doc_id", "line_no",
        f"CASE WHEN {_MALFORMED} OR {_BOXLESS} THEN NULL WHEN {_PLAIN} THEN array(x1, y1, x2, y2) END AS box",
        f"""CASE WHEN {_MALFORMED} THEN array(array(x1, y1), array(x2))
                 WHEN {_BOXLESS} OR {_PLAIN} THEN NULL
                 ELSE array(array(x1, y1), array(x2, y1 + 3), array(x2 - 2, y2), array(x1 + 1, y2 + 2)) END AS corners""",
    )


def line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON record per page in four shapes."""
    lines = text_lines(spark, sf_dir)
    item = F.to_json(
        F.struct("text", "confidence", F.array("x1", "y1", "x2", "y2").alias("bounding_box"), "line_no")
    )
    pages = lines.groupBy("doc_id", "page_index").agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("body"))
    return pages.selectExpr(
        "doc_id", "page_index",
        """CASE doc_id % 4 WHEN 0 THEN concat('{"ocr_lines":', body, '}')
                         WHEN 1 THEN concat('{"features":{"ocr_lines":', body, '}}')
                         WHEN 2 THEN concat('{"lines":', body, '}') ELSE body END AS record""",
    )


VECTOR_DIM = 64


def line_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with a whole vector; the lines are dealt over all vectors of the table."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("semantic"))
    lines = text_lines(spark, sf_dir).withColumn("vec_id", F.expr("doc_id * 7 + line_no") % max(vectors.count(), 1))
    return lines.join(vectors, "vec_id").drop("vec_id")


LINE_VECTORS = TEXT_LINES + """,
line_vectors AS (SELECT l.*, CAST(e.embedding AS DOUBLE[]) AS semantic
                 FROM text_lines l JOIN embeddings e ON e.vec_id = (l.doc_id * 7 + l.line_no) % (SELECT count(*) FROM embeddings))"""

# --- page results, documents, failed messages -------------------------------------------------------

_PAGE_RESULT = {
    "result_id": "event_id",
    "document_id": "user_id",
    "page_index": "event_id % 20",
    "document_type": "CASE WHEN event_type = 'error' THEN NULL ELSE event_type END",
    "confidence": "CASE WHEN event_type = 'error' THEN CAST(0 AS DOUBLE)"
                  " ELSE least(value, CAST(100 AS DOUBLE)) / 100 END",
    "error": "CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 3 = 0 THEN 'OCR failed: timeout'"
             " WHEN event_id % 3 = 1 THEN concat('Image not found: ', CAST(event_id % 20 AS VARCHAR(20)))"
             " ELSE concat('An unexpected error occurred: ', CAST(event_id AS VARCHAR(20))) END",
}
_PAGE_RESULT_EXPRS, _PAGE_RESULT_SQL = _dual(_PAGE_RESULT)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``ts`` as an instant and as epoch microseconds."""
    raw = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return raw.withColumn("ts_us", F.unix_micros("ts"))


def page_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr(*[e.replace("VARCHAR(20)", "STRING") for e in _PAGE_RESULT_EXPRS], "ts", "ts_us")


PAGE_RESULTS = f"""
page_results AS (SELECT {_PAGE_RESULT_SQL}, ts, epoch_us(ts) AS ts_us FROM events)"""


# Page results a thousand times closer together, so that some documents of one to seven pages complete within their deadline
# and others do not.
_TIMED = {**_PAGE_RESULT, "page_index": "event_id % (1 + user_id % 7)", "num_pages": "1 + user_id % 7"}
TIMED_EXPRS, _TIMED_SQL = _dual(_TIMED)
TIMED_EXPRS = [e.replace("VARCHAR(20)", "STRING") for e in TIMED_EXPRS]


def timed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr(*TIMED_EXPRS, "ts_us div 1000 AS ts_us").drop("num_pages")


def timed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id")).distinct()
    return ids.selectExpr("document_id", "1 + document_id % 7 AS num_pages", "CAST(NULL AS STRING) AS filename")


TIMED = f"""
timed_results AS (SELECT {_TIMED_SQL}, epoch_us(ts) // 1000 AS ts_us FROM events),
timed_documents AS (SELECT DISTINCT user_id AS document_id, 1 + user_id % 7 AS num_pages FROM events)"""


def documents_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id")).distinct()
    return ids.selectExpr(
        "document_id", "20 + document_id % 3 AS num_pages",
        "CASE WHEN document_id % 5 = 0 THEN NULL ELSE concat('file_', CAST(document_id AS STRING), '.pdf') END AS filename",
    )


DOCUMENTS_EXPECTED = """
documents_expected AS (SELECT DISTINCT user_id AS document_id, 20 + user_id % 3 AS num_pages,
    CASE WHEN user_id % 5 = 0 THEN NULL ELSE concat('file_', user_id, '.pdf') END AS filename FROM events)"""

_MESSAGE_JSON = (
    "CASE WHEN event_id % 37 = 0 THEN 'not json{' ELSE concat('{\"message_id\":\"m', {id}, '\"',"
    " CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 2 = 0 THEN ',\"actor_name\":\"process_page_task\"'"
    " ELSE ',\"actor_name\":\"finalize_document_task\"' END,"
    " ',\"args\":[\"img\",', {page}, ',\"', {user}, '\"],\"queue_name\":\"',"
    " CASE WHEN event_id % 2 = 0 THEN 'pages' ELSE 'default' END, '\"',"
    " CASE WHEN event_id % 11 = 0 THEN '' ELSE concat(',\"options\":{\"retries\":', {retries}, ',\"max_retries\":3}') END,"
    " ',\"message_timestamp\":', {stamp}, '}') END"
)


def _message(cast: str, stamp: str) -> str:
    parts = {"id": "event_id", "page": "20 + event_id % 3", "user": "user_id", "retries": "event_id % 4", "stamp": stamp}
    text = _MESSAGE_JSON
    for name, expr in parts.items():
        text = text.replace("{" + name + "}", f"CAST({expr} AS {cast})")
    return text


def failed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = events(spark, sf_dir).where("event_type = 'error'")
    return errors.selectExpr("event_id AS position", f"{_message('STRING', 'ts_us div 1000')} AS raw")


FAILED_MESSAGES = f"""
failed_messages AS (SELECT event_id AS position, {_message('VARCHAR', 'epoch_us(ts) // 1000')} AS raw
                    FROM events WHERE event_type = 'error'),
parsed AS (SELECT *, json_extract_string(raw, '$.message_id') AS message_id,
    json_extract_string(raw, '$.actor_name') AS actor_name, json_extract_string(raw, '$.queue_name') AS queue_name,
    CAST(json_extract(raw, '$.args[1]') AS BIGINT) AS page_index, json_extract_string(raw, '$.args[2]') AS document_key,
    coalesce(CAST(json_extract(raw, '$.options.retries') AS BIGINT), 0) AS retries,
    coalesce(CAST(json_extract(raw, '$.options.max_retries') AS BIGINT), 0) AS max_retries,
    CAST(json_extract(raw, '$.message_timestamp') AS BIGINT) AS sent_ms
    FROM failed_messages WHERE json_valid(raw))"""

# Instant of "now" for ages and retention: always an argument, never the clock.
AS_OF = "2024-01-31 00:30:00"
AS_OF_US = 1706661000 * 1_000_000


def known_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page set of every document; a ninth of the pages has no stored result."""
    return events(spark, sf_dir).selectExpr(
        "user_id AS document_id", "event_id % 20 AS page_index", "ts_us", "event_id % 9 <> 0 AS has_result"
    )


KNOWN_PAGES = """
known_pages AS (SELECT user_id AS document_id, event_id % 20 AS page_index, epoch_us(ts) AS ts_us,
                       event_id % 9 <> 0 AS has_result FROM events)"""


def final_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id")).distinct()
    return ids.where("document_id % 4 = 0")


def queued_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending messages: finalise requests for every seventh document, page work for the rest."""
    ids = table(spark, sf_dir, "events").select("user_id").distinct()
    return ids.selectExpr(
        """concat('{"actor_name":"', CASE WHEN user_id % 7 = 0 THEN 'finalize_document_task' ELSE 'process_page_task' END,
                  '","args":["', CAST(user_id AS STRING), '"]}') AS raw"""
    )


# --- page measures ----------------------------------------------------------------------------------

_QA = {
    "batch": "l_returnflag",
    "page_key": "l_orderkey",
    "part_key": "l_partkey",
    "line_key": "l_linenumber",
    "orientation_confidence": "CASE WHEN l_suppkey % 50 = 49 THEN NULL ELSE CAST(l_partkey % 101 AS DOUBLE) / 100 END",
    "orientation_angle": "CAST((l_suppkey % 4) * 90 AS DOUBLE)",
    "deskew_angle": "CAST(l_orderkey % 61 - 30 AS DOUBLE) / 2",
    "deskew_confidence": "CAST(l_partkey % 21 AS DOUBLE) / 20",
    "deskew_status": "CASE l_partkey % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'low_confidence'"
                     " WHEN 2 THEN 'angle_too_small' ELSE 'skipped' END",
    "margin_top": "CAST(l_partkey % 25 AS DOUBLE)",
    "margin_bottom": "CAST(l_suppkey % 25 AS DOUBLE)",
    "margin_left": "CAST(l_orderkey % 25 AS DOUBLE)",
    "margin_right": "CAST((l_linenumber * 3) % 25 AS DOUBLE)",
    "crop_status": "CASE (l_orderkey + l_linenumber) % 7 WHEN 0 THEN 'cropped' WHEN 1 THEN 'rejected_overcrop'"
                   " WHEN 2 THEN 'already_cropped' WHEN 3 THEN 'skipped_scan' WHEN 4 THEN 'no_detection'"
                   " WHEN 5 THEN 'invalid_geometry' ELSE 'error' END",
    "has_matrix": "l_linenumber % 3 <> 0",
    "contrast": "l_quantity * 2",
    "final_width": "CAST(800 + l_partkey % 800 AS BIGINT)",
    "final_height": "CAST(1200 + (l_suppkey % 100) * 10 AS BIGINT)",
    "processing_time": "abs(l_tax) * 100",
    "capture_type": "CASE WHEN l_orderkey % 10 = 9 THEN NULL WHEN l_orderkey % 100 > 70 THEN 'SCAN' ELSE 'PHOTO' END",
    "white_fraction": "CAST(l_orderkey % 100 AS DOUBLE) / 100",
}
_QA_EXPRS, _QA_SQL = _dual(_QA)


def page_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*_QA_EXPRS)


PAGE_MEASURES = f"""
page_measures AS (SELECT {_QA_SQL} FROM lineitem)"""

_GEOMETRY = {
    "page_key": "l_orderkey",
    "line_key": "l_linenumber",
    "raw_angle": "l_partkey % 720 - 360",
    "raw_confidence": "CAST(l_suppkey % 130 - 10 AS DOUBLE) / 100",
    "skew_angle": "CAST(l_orderkey % 81 - 40 AS DOUBLE) / 2",
    "skew_confidence": "CAST(l_partkey % 101 AS DOUBLE) / 100",
    "width": "1000 + l_partkey % 3000",
    "height": "1400 + l_orderkey % 3000",
}
_GEOMETRY_EXPRS, _GEOMETRY_SQL = _dual(_GEOMETRY)


def page_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*_GEOMETRY_EXPRS)


PAGE_ANGLES = f"""
page_angles AS (SELECT {_GEOMETRY_SQL} FROM lineitem)"""

# Corner lists: seventh lines have none, sixth three points, fifth relative coordinates, fourth near the whole
# page when the part is even and five points when odd.
_X = ["l_partkey % 200", "700 + l_partkey % 300", "700 + l_suppkey % 300", "l_orderkey % 200"]
_Y = ["115 + (l_suppkey * 7) % 200", "115 + l_orderkey % 200", "900 + l_partkey % 400", "900 + l_suppkey % 400"]
_POINTS = [(f"CAST({x} AS DOUBLE)", f"CAST({y} AS DOUBLE)") for x, y in zip(_X, _Y)]
_RELATIVE = [(f"CAST({x} AS DOUBLE) / 1200", f"CAST({y} AS DOUBLE) / 1500") for x, y in zip(_X, _Y)]
_WIDE = [("CAST(0 AS DOUBLE)", "CAST(l_partkey % 9 AS DOUBLE)"), ("CAST(1199 AS DOUBLE)", "CAST(3 AS DOUBLE)"),
         ("CAST(1190 AS DOUBLE)", "CAST(1490 AS DOUBLE)"), ("CAST(l_suppkey % 9 AS DOUBLE)", "CAST(1480 AS DOUBLE)")]


def _corners(make: str) -> str:
    def points(rows):
        return make.format(", ".join(make.format(f"{x}, {y}") for x, y in rows))

    five = points(_POINTS + [("CAST(100 AS DOUBLE)", "CAST(500 AS DOUBLE)")])
    return (
        f"CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN {points(_POINTS[:3])}"
        f" WHEN l_linenumber = 5 THEN {points(_RELATIVE)} WHEN l_linenumber = 4 AND l_partkey % 2 = 0 THEN {points(_WIDE)}"
        f" WHEN l_linenumber = 4 THEN {five} ELSE {points(_POINTS)} END"
    )


def page_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS page_key", "l_linenumber AS line_key", "l_partkey AS part_key", "l_suppkey AS supp_key",
        "CASE WHEN l_orderkey % 6 = 0 THEN 'SCAN' ELSE 'PHOTO' END AS capture_type",
        f"{_corners('array({})')} AS corners", "1200 AS width", "1500 AS height",
    )


PAGE_DETECTIONS = f"""
page_detections AS (SELECT l_orderkey AS page_key, l_linenumber AS line_key, l_partkey AS part_key, l_suppkey AS supp_key,
    CASE WHEN l_orderkey % 6 = 0 THEN 'SCAN' ELSE 'PHOTO' END AS capture_type,
    {_corners('[{}]')} AS corners, 1200 AS width, 1500 AS height FROM lineitem)"""


def line_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS page_key", "CAST(l_partkey % 180 AS DOUBLE) AS theta")


LINE_ANGLES = """
line_angles AS (SELECT l_orderkey AS page_key, CAST(l_partkey % 180 AS DOUBLE) AS theta FROM lineitem)"""

_ORDERS = {"crop": "CASE WHEN l_linenumber % 3 = 0 THEN 3 ELSE 1 END", "deskew": "2",
           "rotation": "CASE WHEN l_linenumber % 3 = 0 THEN 1 WHEN l_linenumber % 5 = 0 THEN NULL ELSE 3 END"}


_FREE = "l_partkey % 5 = 0"
_ANGLE = f"CASE WHEN {_FREE} THEN l_suppkey % 60 - 30 ELSE (l_suppkey % 4) * 90 END"
_DEPTH = "CAST(l_suppkey % 3 AS DOUBLE) / 8192"


def _or_null(value: str) -> str:
    return f"coalesce(CAST({value} AS STRING), 'null')"


def _field(name: str, value: str, quote: str = "") -> str:
    """A JSON field and its comma; nothing when the value is null."""
    return f"""coalesce(concat('"{name}":{quote}', CAST({value} AS STRING), '{quote},'), '')"""


def _path(folder: str) -> str:
    return f"concat('{folder}/', CAST(l_orderkey AS STRING), '.png')"


# The text that to_json gives for the log, put together from its changing parts, which takes less than half the time.
_SIZE = f"""'"output_size":[', {_or_null('2 * (1000 + l_partkey % 3000)')}, ',', {_or_null('2 * (1400 + l_orderkey % 3000)')}, ']'"""
_LOG = f"""concat('{{',
    {_field('input_path', _path('in'), '"')},
    {_field('output_path', f"CASE WHEN l_suppkey % 2 = 0 THEN {_path('out')} END", '"')},
    {_field('output_transformed_path', _path('old'), '"')},
    '"transforms":[{{"transform_type":"deskew","params":{{"transform_matrix":[[1.0,0.0,', {_or_null('CAST(l_partkey % 7 AS DOUBLE)')},
    '],[0.0,1.0,', {_or_null('CAST(l_suppkey % 5 AS DOUBLE)')}, ']],', {_SIZE}, '}},"order":{_ORDERS['deskew']}}},',
    '{{"transform_type":"rotation","params":{{', {_field('angle', f'CAST({_ANGLE} AS DOUBLE)')},
    '"rotation_type":"', CASE WHEN {_FREE} THEN 'arbitrary' ELSE 'standard' END, '"}}',
    coalesce(concat(',"order":', CAST({_ORDERS['rotation']} AS STRING)), ''), '}},',
    '{{"transform_type":"crop","params":{{"transform_matrix":[[2.0,0.0,0.0],[0.0,2.0,0.0],[0.0,', {_or_null(_DEPTH)}, ',1.0]],', {_SIZE},
    '}},"order":', CAST({_ORDERS['crop']} AS STRING), '}}]}}')"""


def transform_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON log per page: crop (scale by two, some with perspective), deskew (shift) and rotation (some free), with permuted or missing orders."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS page_key", "l_linenumber AS line_key", "l_partkey AS part_key", "l_suppkey AS supp_key",
        "1000 + l_partkey % 3000 AS width", "1400 + l_orderkey % 3000 AS height", f"{_LOG} AS log",
    )


TRANSFORM_ROWS = f"""
transform_rows AS (SELECT l_orderkey AS page_key, l_linenumber AS line_key, l_partkey AS part_key, l_suppkey AS supp_key,
    CASE WHEN l_suppkey % 2 = 0 THEN concat('out/', l_orderkey, '.png') ELSE concat('old/', l_orderkey, '.png') END AS output_path,
    1000 + l_partkey % 3000 AS width, 1400 + l_orderkey % 3000 AS height,
    {_ANGLE} AS angle, {_FREE} AS free, {_DEPTH} AS depth, {_ORDERS['crop']} AS crop_order, 2 AS deskew_order,
    coalesce({_ORDERS['rotation']}, 0) AS rotation_order FROM lineitem)"""

# --- scores and predictions -------------------------------------------------------------------------


def page_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("page_key"),
        F.expr("transform(embedding, v -> CAST(least(255, greatest(0, floor(CAST(v AS DOUBLE) * 800) + 200)) AS INT))").alias("luma"),
    )


PAGE_LUMA = """
page_luma AS (SELECT vec_id AS page_key, list_transform(embedding,
    lambda v: CAST(least(255, greatest(0, floor(CAST(v AS DOUBLE) * 800) + 200)) AS INTEGER)) AS luma FROM embeddings)"""


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four scores from all dimensions: dimension i counts for class i mod 4."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("page_key"),
        F.expr("transform(sequence(0, 3), k -> aggregate(filter(embedding, (v, i) -> i % 4 = k), CAST(0 AS DOUBLE), (a, v) -> a + CAST(v AS DOUBLE)) * 2)").alias("scores"),
    )


CLASS_SCORES = """
class_scores AS (SELECT vec_id AS page_key, list_transform(range(4), lambda k: list_reduce(list_prepend(0::DOUBLE,
    list_transform(list_filter(embedding, lambda v, i: (i - 1) % 4 = k), lambda v: CAST(v AS DOUBLE))), lambda a, b: a + b) * 2) AS scores FROM embeddings)"""

CLASS_NAMES = ("Attestation", "Contrat", "Facture")


def class_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(CLASS_NAMES)), "class_index bigint, class_name string")


CLASS_TABLE = "\nclass_table(class_index, class_name) AS (VALUES (0, 'Attestation'), (1, 'Contrat'), (2, 'Facture'))"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", "CAST(label AS BIGINT) AS label",
        "CAST(CASE WHEN vec_id % 4 = 0 THEN (label + vec_id % 3) % 10 ELSE label END AS BIGINT) AS prediction",
    )


PREDICTIONS = """
predictions AS (SELECT vec_id, CAST(label AS BIGINT) AS label,
    CAST(CASE WHEN vec_id % 4 = 0 THEN (label + vec_id % 3) % 10 ELSE label END AS BIGINT) AS prediction FROM embeddings)"""

# --- files ------------------------------------------------------------------------------------------

_EXTENSIONS = ["'.pdf'", "'.PNG'", "'.jpg'", "'.Jpeg'", "'.tiff'", "'.bmp'", "'.txt'", "''", "'.qa.json'"]
_EXTENSION = "CASE page_id % 9 " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(_EXTENSIONS)) + " END"
_FILE = {
    "page_id": "page_id",
    "path": f"concat('/data/', replace(split_part(split_part(url, '//', 2), '/', 1), '.', '/'), '/scan_',"
            f" CAST(page_id AS VARCHAR(20)), {_EXTENSION})",
    "size": "CASE WHEN page_id % 10 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(length(html) AS BIGINT) END",
    "modified_us": f"CAST({AS_OF_US} - (page_id % 200) * 60000000 AS BIGINT)",
}


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    exprs, _ = _dual(_FILE)
    return table(spark, sf_dir, "pages").selectExpr(*[e.replace("VARCHAR(20)", "STRING") for e in exprs])


FILES = f"""
files AS (SELECT {_dual(_FILE)[1]} FROM pages)"""

_TRAINING = {
    "doc_id": "d.doc_id",
    "file_name": "CASE d.doc_id % 3 WHEN 0 THEN concat('Facture_', CAST(d.doc_id AS VARCHAR(20)), '.json')"
                 " WHEN 1 THEN concat('doc', CAST(d.doc_id AS VARCHAR(20)), '.json')"
                 " ELSE concat('Contrat_', CAST(d.doc_id AS VARCHAR(20)), '.json') END",
    "json_type": "CASE WHEN d.doc_id % 4 = 1 THEN 'Attestation' END",
    "ok": "d.n_chars % 7 <> 0",
}


def training_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    exprs, _ = _dual(_TRAINING)
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").alias("d")
    return docs.selectExpr(*[e.replace("VARCHAR(20)", "STRING") for e in exprs])


def label_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = training_files(spark, sf_dir).select("doc_id", "file_name")
    labels = table(spark, sf_dir, "labels")
    return labels.join(named, "doc_id").selectExpr("file_name", "CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS mapped_type")


TRAINING_FILES = f"""
training_files AS (SELECT {_dual(_TRAINING)[1]} FROM documents d),
label_mapping AS (SELECT t.file_name, CASE WHEN l.quality = 1 THEN 'good' ELSE 'bad' END AS mapped_type
                  FROM labels l JOIN training_files t ON t.doc_id = l.doc_id)"""

# --- conversations as per-page maps -----------------------------------------------------------------


def page_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of at most 64 pages each, so that no map grows with its document; every ninth document has none."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return turns.groupBy(F.col("conv_id").alias("document_id"), F.expr("turn div 64").alias("block")).agg(
        F.expr("map_from_entries(collect_list(named_struct('k', turn, 'v', array(text))) FILTER (WHERE turn % 12 <> 0 AND conv_id % 9 <> 8))").alias("lines"),
        F.expr("map_from_entries(collect_list(named_struct('k', turn, 'v', concat('err ', CAST(turn AS STRING)))) FILTER (WHERE turn % 4 = 0 AND conv_id % 9 <> 8))").alias("errors"),
    )


PAGE_MAPS = """
map_lines AS (SELECT conv_id AS document_id, turn AS page_index, text FROM conversations WHERE turn % 12 <> 0 AND conv_id % 9 <> 8),
map_errors AS (SELECT conv_id AS document_id, turn AS page_index, concat('err ', turn) AS error
               FROM conversations WHERE turn % 4 = 0 AND conv_id % 9 <> 8)"""

# --- monitoring -------------------------------------------------------------------------------------

_MONITOR = {
    "event_id": "event_id",
    "status": "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END",
    "doc_type": "CASE WHEN event_type = 'error' THEN NULL ELSE event_type END",
    "error_type": "CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 3 = 0 THEN 'ocr_timeout'"
                  " WHEN event_id % 3 = 1 THEN 'image_not_found' ELSE 'processing_error' END",
    "queue_name": "CASE WHEN event_id % 2 = 0 THEN 'pages' ELSE 'default' END",
    "seconds": "value",
    "series": "event_type",
    "counter": "event_id % 500",
}
_MONITOR_EXPRS, _MONITOR_SQL = _dual(_MONITOR)


def page_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr(*_MONITOR_EXPRS, "user_id AS document_id", "event_id % 20 AS page_index", "ts", "ts_us")


PAGE_EVENTS = f"""
page_events AS (SELECT {_MONITOR_SQL}, user_id AS document_id, event_id % 20 AS page_index, ts, epoch_us(ts) AS ts_us
                FROM events)"""

_TASK = {
    "task_id": "user_id * 10 + event_id % 10",
    "event_id": "event_id",
    "status": "CASE event_type WHEN 'click' THEN 'pending' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed'"
              " ELSE 'processing' END",
    "result": "CASE WHEN event_type = 'purchase' THEN props END",
    "error": "CASE WHEN event_type = 'error' THEN concat('failure ', CAST(event_id AS VARCHAR(20))) END",
}


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    exprs, _ = _dual(_TASK)
    return events(spark, sf_dir).selectExpr(*[e.replace("VARCHAR(20)", "STRING") for e in exprs], "ts_us")


TASK_EVENTS = f"""
task_events AS (SELECT {_dual(_TASK)[1]}, epoch_us(ts) AS ts_us FROM events)"""


def sql(select: str, *bindings: str) -> str:
    """An oracle: the named bindings as common table expressions, then the query."""
    return f"WITH {','.join(bindings)}\n{select.strip()}" if bindings else select.strip()

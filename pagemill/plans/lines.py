"""Text lines, boxes, positions and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions.numbers import rounded
from pagemill.operators import lines as L
from pagemill.operators import vectors as V
from pagemill.plans import bindings as B
from pagemill.sources.records import parse_line_records

D = B.VECTOR_DIM + 4
QUERIES, ORACLE = {}, {}


def _wide(df, keys, dim, vector="vector"):
    return df.select(*keys, *[rounded(F.get(vector, F.lit(i)).cast("double")).alias(f"v{i}") for i in range(dim)])


# S2
QUERIES["line_records_parsed"] = lambda s, d: parse_line_records(B.line_records(s, d), ["doc_id", "page_index"]).select(
    "doc_id", "page_index", "line_no", "text", "confidence",
    *[F.get("box", F.lit(i)).alias(n) for i, n in enumerate(L.BOX)])
ORACLE["line_records_parsed"] = B.sql(
    "SELECT doc_id, page_index, line_no, text, confidence, x1, y1, x2, y2 FROM text_lines", B.TEXT_LINES)

# P1
QUERIES["confident_lines"] = lambda s, d: L.confident_lines(B.text_lines(s, d)).select("doc_id", "line_no", "confidence", "text")
ORACLE["confident_lines"] = B.sql("SELECT doc_id, line_no, confidence, text FROM text_lines WHERE confidence >= 0.70::DOUBLE", B.TEXT_LINES)

# P2
QUERIES["canonical_boxes"] = lambda s, d: L.canonical_boxes(B.text_quads(s, d)).select(
    "doc_id", "line_no", *[F.get("rect", F.lit(i)).alias(n) for i, n in enumerate(L.BOX)])
_ZERO, _NONE = "line_no % 29 = 0", "line_no % 31 = 0"
ORACLE["canonical_boxes"] = B.sql(f"""
SELECT doc_id, line_no,
  CASE WHEN {_ZERO} THEN 0 WHEN {_NONE} THEN NULL WHEN line_no % 5 = 0 THEN x1 ELSE least(x1, x2 - 2) END AS x1,
  CASE WHEN {_ZERO} THEN 0 WHEN {_NONE} THEN NULL ELSE y1 END AS y1,
  CASE WHEN {_ZERO} THEN 0 WHEN {_NONE} THEN NULL WHEN line_no % 5 = 0 THEN x2 ELSE greatest(x2, x1 + 1) END AS x2,
  CASE WHEN {_ZERO} THEN 0 WHEN {_NONE} THEN NULL WHEN line_no % 5 = 0 THEN y2 ELSE greatest(y1 + 3, y2 + 2) END AS y2
FROM text_lines""", B.TEXT_LINES)

# P3
_EXTENTS = """
confident AS (SELECT * FROM text_lines WHERE confidence >= 0.70::DOUBLE),
extents AS (SELECT doc_id, page_index,
    CASE WHEN max(greatest(x1, x2)) > 0 THEN CAST(trunc(max(greatest(x1, x2)) * 1.1::DOUBLE) AS BIGINT) ELSE 2000 END AS page_width,
    CASE WHEN max(greatest(y1, y2)) > 0 THEN CAST(trunc(max(greatest(y1, y2)) * 1.1::DOUBLE) AS BIGINT) ELSE 2000 END AS page_height
  FROM confident GROUP BY 1, 2)"""
QUERIES["page_extents"] = lambda s, d: L.page_extents(L.confident_lines(B.text_lines(s, d)))
ORACLE["page_extents"] = B.sql("SELECT doc_id, page_index, page_width, page_height FROM extents", B.TEXT_LINES, _EXTENTS)


# P4
def line_positions(s, d):
    kept = L.confident_lines(B.text_lines(s, d))
    placed = L.positions(kept, L.page_extents(kept))
    return placed.select("doc_id", "line_no", *[rounded(F.col(f"{b}_share").cast("double")).alias(b) for b in L.BOX])


_SHARES = ", ".join(
    f"round(CAST(CAST({b} / {'page_width' if b[0] == 'x' else 'page_height'} AS FLOAT) AS DOUBLE), 6) AS {b}" for b in L.BOX)
QUERIES["line_positions"] = line_positions
ORACLE["line_positions"] = B.sql(f"SELECT doc_id, line_no, {_SHARES} FROM confident JOIN extents USING (doc_id, page_index)",
                                 B.TEXT_LINES, _EXTENTS)


# P5
def line_checks(s, d):
    boxed = L.canonical_boxes(B.text_quads(s, d)).select("doc_id", "line_no", "rect")
    measured = B.text_lines(s, d).selectExpr(
        "doc_id", "line_no", "text", "CASE WHEN line_no % 17 = 0 THEN confidence + 1 ELSE confidence END AS confidence",
        "CAST(line_no % 23 - 1 AS DOUBLE) AS processing_time")
    judged = measured.join(boxed, ["doc_id", "line_no"]).withColumn("problem", L.line_problem())
    return judged.groupBy(F.coalesce("problem", F.lit("valid")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


QUERIES["line_checks"] = line_checks
ORACLE["line_checks"] = B.sql(f"""
SELECT CASE WHEN text IS NULL THEN 'text_missing'
            WHEN confidence + CASE WHEN line_no % 17 = 0 THEN 1 ELSE 0 END > 1 THEN 'confidence_range'
            WHEN {_NONE} AND NOT {_ZERO} THEN 'box_shape'
            WHEN line_no % 23 = 0 THEN 'negative_time' ELSE 'valid' END AS outcome, count(*) AS n
FROM text_lines GROUP BY 1""", B.TEXT_LINES)

# A11
QUERIES["word_extents"] = lambda s, d: L.word_extents(B.text_lines(s, d)).select("doc_id", "page_index", "x_min", "y_min", "x_max", "y_max")
ORACLE["word_extents"] = B.sql("""
SELECT doc_id, page_index, min(x1) AS x_min, min(y1) AS y_min, max(x2) AS x_max, max(y2) AS y_max
FROM text_lines GROUP BY 1, 2""", B.TEXT_LINES)


# A1
def _aggregated(method):
    return lambda s, d: _wide(V.aggregate_vectors(B.line_vectors(s, d), ["doc_id"], B.VECTOR_DIM, method, "semantic"), ["doc_id"], B.VECTOR_DIM)


_W = "CAST(CAST(confidence AS FLOAT) AS DOUBLE)"
_FORMS = {
    "weighted_mean": f"sum({_W} * semantic[{{}}]) / sum({_W})", "mean": "avg(semantic[{}])",
    "max": "max(semantic[{}])", "sum": "sum(semantic[{}])",
}
for _method, _form in _FORMS.items():
    QUERIES[f"vectors_{_method}"] = _aggregated(_method)
    _cols = ", ".join(f"round(CAST(CAST({_form.format(i + 1)} AS FLOAT) AS DOUBLE), 6) AS v{i}" for i in range(B.VECTOR_DIM))
    ORACLE[f"vectors_{_method}"] = B.sql(f"SELECT doc_id, {_cols} FROM line_vectors GROUP BY doc_id", B.LINE_VECTORS)


# M2
def line_features(s, d):
    kept = L.confident_lines(B.line_vectors(s, d))
    placed = L.positions(kept, L.page_extents(kept))
    return _wide(V.line_features(placed), ["doc_id", "line_no"], D)


_LINE_COLS = [f"round(semantic[{i + 1}], 6) AS v{i}" for i in range(B.VECTOR_DIM)] + [
    f"round(CAST(CAST({b} / {'page_width' if b[0] == 'x' else 'page_height'} AS FLOAT) AS DOUBLE), 6) AS v{B.VECTOR_DIM + j}"
    for j, b in enumerate(L.BOX)]
QUERIES["line_features"] = line_features
ORACLE["line_features"] = B.sql(
    f"SELECT doc_id, line_no, {', '.join(_LINE_COLS)} FROM confident JOIN extents USING (doc_id, page_index)",
    B.LINE_VECTORS, _EXTENTS.replace("FROM text_lines", "FROM line_vectors"))


# M3
def page_list(s, d):
    docs = B.table(s, d, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("n"))
    last = F.expr("(n - 1) div 40")
    return docs.select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("page_index"))


def page_vectors(s, d):
    vectors = V.document_vectors(B.line_vectors(s, d), page_list(s, d), B.VECTOR_DIM)
    return _wide(vectors, ["doc_id", "page_index"], D)


_MEANS = [f"sum({_W} * semantic[{i + 1}]) / sum({_W})" for i in range(B.VECTOR_DIM)] + [
    f"sum({_W} * {b} / {'page_width' if b[0] == 'x' else 'page_height'}) / sum({_W})" for b in L.BOX]
QUERIES["page_vectors"] = page_vectors
ORACLE["page_vectors"] = B.sql(f"""
SELECT p.doc_id, p.page_index, {', '.join(f'coalesce(round(CAST(CAST(m{i} AS FLOAT) AS DOUBLE), 6), 0) AS v{i}' for i in range(D))}
FROM (SELECT DISTINCT doc_id, page_index FROM text_lines) p LEFT JOIN
     (SELECT doc_id, page_index, {', '.join(f'{m} AS m{i}' for i, m in enumerate(_MEANS))}
      FROM confident JOIN extents USING (doc_id, page_index) GROUP BY 1, 2) m USING (doc_id, page_index)""",
    B.LINE_VECTORS, _EXTENTS.replace("FROM text_lines", "FROM line_vectors"))


# M1: the encoder in the JVM, and as a model behind the hook; every element, in millionths
def _encoded(encode):
    def run(s, d):
        encoded = encode(B.text_lines(s, d).select("doc_id", "line_no", "text"))
        millionths = F.transform("semantic", lambda v: F.round(v * 1_000_000).cast("bigint").cast("string"))
        return encoded.select("doc_id", "line_no", F.array_join(millionths, ",").alias("elements"))
    return run


QUERIES["encoded_lines"] = _encoded(lambda lines: V.hashed_encoder(lines, dim=16))
QUERIES["model_encoded_lines"] = _encoded(lambda lines: V.encode_with(lines, V.hashed_model(16)))
ORACLE["encoded_lines"] = B.sql("""
SELECT doc_id, line_no, array_to_string(list_transform(counts, lambda c: CAST(CAST(round(c / greatest(norm, 1e-300) * 1000000) AS BIGINT) AS VARCHAR)), ',') AS elements
FROM (SELECT *, sqrt(list_sum(list_transform(counts, lambda c: c * c))) AS norm FROM (
  SELECT doc_id, line_no, list_transform(range(16), lambda d: len(list_filter(dims, lambda x: x = d))::DOUBLE) AS counts FROM (
    SELECT doc_id, line_no, list_transform(list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda t: t <> ''),
                                           lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % 16) AS dims FROM text_lines)))""", B.TEXT_LINES)
ORACLE["model_encoded_lines"] = ORACLE["encoded_lines"]

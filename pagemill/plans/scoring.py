"""Document types from class scores, and the evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions.numbers import rounded, softmax
from pagemill.operators import evaluation as E
from pagemill.operators import scoring as S
from pagemill.plans import bindings as B
from pagemill.session import run_dir

QUERIES, ORACLE = {}, {}


def _probabilities(s, d):
    return B.class_scores(s, d).withColumn("probabilities", softmax(F.col("scores")))


SOFTMAX = """
exps AS (SELECT page_key, list_transform(scores, lambda v: exp(v - list_max(scores))) AS e FROM class_scores),
probs AS (SELECT page_key, list_transform(e, lambda v: v / list_sum(e)) AS p FROM exps),
best AS (SELECT page_key, CAST(list_position(p, list_max(p)) - 1 AS BIGINT) AS class_index, list_max(p) AS confidence FROM probs),
named AS (SELECT b.*, coalesce(c.class_name, CAST(b.class_index AS VARCHAR)) AS document_type
          FROM best b LEFT JOIN class_table c ON c.class_index = b.class_index),
scored AS (SELECT page_key, class_index, confidence, CASE WHEN confidence >= 0.6::DOUBLE THEN document_type END AS document_type FROM named)"""
_PARTS = (B.CLASS_SCORES, B.CLASS_TABLE, SOFTMAX)

# J8
QUERIES["class_names"] = lambda s, d: S.class_names(S.best_class(_probabilities(s, d)), B.class_table(s)).select(
    "page_key", "class_index", "document_type")
ORACLE["class_names"] = B.sql("SELECT page_key, class_index, document_type FROM named", *_PARTS)

# M4, P21
QUERIES["page_scores"] = lambda s, d: S.score(_probabilities(s, d), B.class_table(s)).select(
    "page_key", "class_index", rounded(F.col("confidence")).alias("confidence"), "document_type")
ORACLE["page_scores"] = B.sql("SELECT page_key, class_index, round(confidence, 6) AS confidence, document_type FROM scored", *_PARTS)
QUERIES["unsure_pages"] = lambda s, d: S.score(_probabilities(s, d), B.class_table(s)).where("document_type IS NULL").select(
    "page_key", rounded(F.col("confidence")).alias("confidence"))
ORACLE["unsure_pages"] = B.sql("SELECT page_key, round(confidence, 6) AS confidence FROM scored WHERE document_type IS NULL", *_PARTS)

# A5
QUERIES["type_summary"] = lambda s, d: S.type_summary(S.score(_probabilities(s, d), B.class_table(s)))
ORACLE["type_summary"] = B.sql(
    "SELECT coalesce(document_type, 'Unknown') AS document_type, count(*) AS documents FROM scored GROUP BY 1 ORDER BY 1", *_PARTS)


# A12, J9, M7: the class list has two classes more than the labels
def classes(s, d):
    labels = B.predictions(s, d).select(F.col("label").alias("class_index")).distinct()
    extra = labels.agg(F.max("class_index").alias("top")).select(F.explode(F.array(F.col("top") + 1, F.col("top") + 2)).alias("class_index"))
    return labels.unionByName(extra).select("class_index", F.concat(F.lit("class_"), F.col("class_index").cast("string")).alias("class_name"))


REPORT = """
listed AS (SELECT DISTINCT label AS class_index FROM predictions UNION SELECT max(label) + 1 FROM predictions UNION SELECT max(label) + 2 FROM predictions),
measured AS (SELECT c.class_index, concat('class_', c.class_index) AS class_name,
    (SELECT count(*) FROM predictions p WHERE p.label = c.class_index AND p.prediction = c.class_index) AS tp,
    (SELECT count(*) FROM predictions p WHERE p.label = c.class_index) AS support,
    (SELECT count(*) FROM predictions p WHERE p.prediction = c.class_index) AS predicted FROM listed c),
report AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM
    (SELECT class_index, class_name, support, coalesce(CAST(tp AS DOUBLE) / nullif(predicted, 0), 0) AS precision,
            coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0) AS recall FROM measured)),
averaged AS (SELECT 'macro avg' AS average, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, CAST(sum(support) AS BIGINT) AS support FROM report
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support),
    CAST(sum(support) AS BIGINT) FROM report),
matrix AS (SELECT a.c AS label, b.c AS prediction, (SELECT count(*) FROM predictions p WHERE p.label = a.c AND p.prediction = b.c) AS n
  FROM (SELECT label AS c FROM predictions UNION SELECT prediction FROM predictions) a,
       (SELECT label AS c FROM predictions UNION SELECT prediction FROM predictions) b)"""
_MEASURES = ["precision", "recall", "f1"]
QUERIES["confusion_matrix"] = lambda s, d: E.confusion(B.predictions(s, d), fill=True)
ORACLE["confusion_matrix"] = B.sql("SELECT label, prediction, n FROM matrix", B.PREDICTIONS, REPORT)
QUERIES["class_report"] = lambda s, d: E.class_report(B.predictions(s, d), classes(s, d)).select(
    "class_index", "class_name", "support", *[rounded(F.col(m)).alias(m) for m in _MEASURES])
_ROUND = ", ".join(f"round({m}, 6) AS {m}" for m in _MEASURES)
ORACLE["class_report"] = B.sql(f"SELECT class_index, class_name, support, {_ROUND} FROM report", B.PREDICTIONS, REPORT)
QUERIES["report_averages"] = lambda s, d: E.averages(E.class_report(B.predictions(s, d), classes(s, d))).select(
    "average", "support", *[rounded(F.col(m)).alias(m) for m in _MEASURES])
ORACLE["report_averages"] = B.sql(f"SELECT average, support, {_ROUND} FROM averaged", B.PREDICTIONS, REPORT)
QUERIES["accuracy"] = lambda s, d: E.accuracy(B.predictions(s, d)).select(rounded(F.col("accuracy")).alias("accuracy"), "rows")
ORACLE["accuracy"] = B.sql(
    "SELECT round(CAST(count(*) FILTER (WHERE label = prediction) AS DOUBLE) / count(*), 6) AS accuracy, count(*) AS rows FROM predictions", B.PREDICTIONS)
QUERIES["evaluation_report"] = lambda s, d: E.evaluation_report(B.predictions(s, d), classes(s, d)).withColumn("value", rounded(F.col("value")))
_LONG = " UNION ALL ".join(
    [f"SELECT 'class' AS section, class_name AS name, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM report" for m in _MEASURES + ["support"]]
    + [f"SELECT 'average', average, '{m}', CAST({m} AS DOUBLE) FROM averaged" for m in _MEASURES + ["support"]]
    + ["SELECT 'matrix', CAST(label AS VARCHAR), CAST(prediction AS VARCHAR), CAST(n AS DOUBLE) FROM matrix",
       "SELECT 'overall', 'all', 'accuracy', CAST(count(*) FILTER (WHERE label = prediction) AS DOUBLE) / count(*) FROM predictions"])
ORACLE["evaluation_report"] = B.sql(f"SELECT section, name, metric, round(value, 6) AS value FROM ({_LONG})", B.PREDICTIONS, REPORT)


# M7: the whole report as one document, written and read back, one row for each entry of its lists
def report_entries(s, d):
    path = run_dir(s, "report")
    gains = B.predictions(s, d).groupBy((F.col("vec_id") % 64).alias("dim")).agg(F.count(F.lit(1)).cast("double").alias("importance"))
    document = E.report_document(B.predictions(s, d), classes(s, d), "2024-01-01T00:00:00", "models/m", "data/d", E.importance_split(gains, 64))
    E.write_report(document, path)
    back = s.read.json(path)
    entry = lambda kind, *parts: F.concat_ws("|", F.lit(kind), *[p.cast("string") for p in parts])
    share = lambda x: F.round(x * 1_000_000).cast("bigint")
    listed = F.concat(
        F.transform("classes", lambda c: entry("class", c["class_index"], c["class_name"], c["support"], *[share(c[m]) for m in _MEASURES])),
        F.transform("matrix", lambda c: entry("cell", c["label"], c["prediction"], c["n"])),
        F.transform("averages", lambda a: entry("average", a["average"], a["support"], *[share(a[m]) for m in _MEASURES])),
        F.array(entry("facts", F.col("model_path"), F.col("data_path"), F.col("test_rows"), share(F.col("accuracy"))),
                entry("importance", share(F.col("feature_importance.text_percent")), share(F.col("feature_importance.position_percent")))))
    return back.select("generated_at", F.explode(listed).alias("entry"))


def _entry(kind, *parts):
    return f"concat_ws('|', '{kind}', {', '.join(parts)})"


_SHARES = [f"CAST(round({m} * 1000000) AS BIGINT)" for m in _MEASURES]
QUERIES["report_entries"] = report_entries
ORACLE["report_entries"] = B.sql(f"""
SELECT '2024-01-01T00:00:00' AS generated_at, entry FROM (
  SELECT {_entry('class', 'class_index', 'class_name', 'support', *_SHARES)} AS entry FROM report
  UNION ALL SELECT {_entry('cell', 'label', 'prediction', 'n')} FROM matrix WHERE n > 0
  UNION ALL SELECT {_entry('average', 'average', 'support', *_SHARES)} FROM averaged
  UNION ALL SELECT {_entry('facts', "'models/m'", "'data/d'", 'count(*)', 'CAST(round(CAST(count(*) FILTER (WHERE label = prediction) AS DOUBLE) / count(*) * 1000000) AS BIGINT)')} FROM predictions
  UNION ALL SELECT {_entry('importance', 'CAST(round(CAST(count(*) FILTER (WHERE vec_id % 64 < 60) AS DOUBLE) / count(*) * 100 * 1000000) AS BIGINT)',
                           'CAST(round(CAST(count(*) FILTER (WHERE vec_id % 64 >= 60) AS DOUBLE) / count(*) * 100 * 1000000) AS BIGINT)')} FROM predictions)""", B.PREDICTIONS, REPORT)

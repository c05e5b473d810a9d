"""Training sets, splits and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions.numbers import rounded
from pagemill.operators import boosting as G
from pagemill.operators import evaluation as E
from pagemill.operators import models as M
from pagemill.operators import scoring as S
from pagemill.operators import training as T
from pagemill.plans import bindings as B
from pagemill.session import run_dir

QUERIES, ORACLE = {}, {}


def resolved(s, d):
    return T.resolve_labels(B.training_files(s, d), B.label_mapping(s, d))


RESOLVED = """
typed AS (SELECT t.doc_id, t.file_name, t.ok, coalesce(m.mapped_type, t.json_type, CASE WHEN contains(t.file_name, '_') THEN split_part(t.file_name, '_', 1) END) AS document_type
          FROM training_files t LEFT JOIN label_mapping m ON m.file_name = t.file_name),
resolved AS (SELECT * FROM typed WHERE document_type IS NOT NULL)"""

# J5
QUERIES["resolved_labels"] = lambda s, d: resolved(s, d).select("doc_id", "file_name", "document_type")
ORACLE["resolved_labels"] = B.sql("SELECT doc_id, file_name, document_type FROM resolved", B.TRAINING_FILES, RESOLVED)

# A6, O4
QUERIES["training_counts"] = lambda s, d: T.total_counts(T.type_counts(resolved(s, d))).orderBy("document_type")
ORACLE["training_counts"] = B.sql("""
SELECT document_type, count(*) AS files, count(*) FILTER (WHERE ok) AS succeeded, count(*) FILTER (WHERE NOT ok) AS failed FROM resolved GROUP BY 1
UNION ALL SELECT 'Total', count(*), count(*) FILTER (WHERE ok), count(*) FILTER (WHERE NOT ok) FROM resolved ORDER BY 1""", B.TRAINING_FILES, RESOLVED)

# S5, W5
QUERIES["class_indices"] = lambda s, d: T.class_indices(resolved(s, d), "document_type")
ORACLE["class_indices"] = B.sql(
    "SELECT document_type, dense_rank() OVER (ORDER BY document_type) - 1 AS class_index FROM (SELECT DISTINCT document_type FROM resolved)",
    B.TRAINING_FILES, RESOLVED)
QUERIES["labelled_files"] = lambda s, d: T.labelled(resolved(s, d), "document_type").select("doc_id", "document_type", "class_index")
ORACLE["labelled_files"] = B.sql(
    "SELECT doc_id, document_type, dense_rank() OVER (ORDER BY document_type) - 1 AS class_index FROM resolved", B.TRAINING_FILES, RESOLVED)

# K4
QUERIES["unprocessed_files"] = lambda s, d: T.unprocessed(
    B.training_files(s, d), B.training_files(s, d).where("ok").select("file_name")).select("doc_id", "file_name")
ORACLE["unprocessed_files"] = B.sql("SELECT doc_id, file_name FROM training_files WHERE NOT ok", B.TRAINING_FILES)


# K2: written by label folder, read back
def labelled_folders(s, d):
    from pagemill.sinks.tables import write_labelled

    path = run_dir(s, "labelled")
    write_labelled(resolved(s, d).select("doc_id", "file_name", "document_type"), path)
    return s.read.schema("doc_id bigint, file_name string, document_type string").json(path)


QUERIES["labelled_folders"] = labelled_folders
ORACLE["labelled_folders"] = ORACLE["resolved_labels"]


# M5
def vectors(s, d):
    return B.table(s, d, "embeddings").selectExpr("vec_id", "CAST(label AS BIGINT) AS label", "embedding")


QUERIES["stratified_split"] = lambda s, d: T.stratified_split(vectors(s, d).select("vec_id", "label")).select("vec_id", "label", "is_test")
_HASH = "(('0x' || substr(md5(concat('42:', vec_id)), 1, 12))::BIGINT % 2147483647)"
ORACLE["stratified_split"] = f"""
WITH hashed AS (SELECT vec_id, CAST(label AS BIGINT) AS label, {_HASH} AS h FROM embeddings),
sizes AS (SELECT label, count(*) AS size FROM hashed GROUP BY 1),
shares AS (SELECT label, size, size * ceil(sum(size) OVER () * 0.2::DOUBLE) / sum(size) OVER () AS exact, ceil(sum(size) OVER () * 0.2::DOUBLE) AS wanted FROM sizes),
quotas AS (SELECT label, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, label) <= wanted - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota
           FROM shares)
SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY h, vec_id) <= quota AS is_test FROM hashed JOIN quotas USING (label)"""


def _sets(s, d):
    rows = T.features(vectors(s, d).withColumn("class_name", F.concat(F.lit("class_"), F.col("label").cast("string"))), "embedding")
    split = T.stratified_split(rows)
    return split.where("NOT is_test"), split.where("is_test")


# M6, M8, M4: trained, kept as a table, read back, scored from the table
def _table(s, kind, train):
    path = run_dir(s, "model")
    if kind == "boosted_trees":
        model = G.fit(train.withColumn("features", _values()))
        table, names = M.boosted_table(s, model), model.classes
    else:
        fitted = T.train(train, kind)
        model, names = fitted.stages[1], fitted.stages[0].labels
        if kind == "random_forest":
            model.write().save(f"{path}/model")
            table = M.forest_table(s, f"{path}/model")
        else:
            table = M.linear_table(s, model)
    table.write.parquet(f"{path}/table")
    return s.read.parquet(f"{path}/table"), s.createDataFrame(list(enumerate(names)), "class_index bigint, class_name string")


def _values():
    return F.col("embedding").cast("array<double>").alias("features")


def _trained(kind):
    def run(s, d):
        train, test = _sets(s, d)
        table, classes = _table(s, kind, train)
        scored = M.probabilities(test.select("vec_id", "label", _values()), kind, table)
        return S.score(scored, classes).select("vec_id", "label", "class_index", "document_type", rounded(F.col("confidence")).alias("confidence"))
    return run


QUERIES["model_logistic"] = _trained("logistic_regression")
QUERIES["model_forest"] = _trained("random_forest")
QUERIES["model_boosted"] = _trained("boosted_trees")


# A13: of a forest and of boosted trees
def _importance(kind, importances):
    def run(s, d):
        train, _ = _sets(s, d)
        table, _ = _table(s, kind, train)
        width = train.agg(F.max(F.size("embedding"))).first()[0]
        return E.importance_split(importances(table), width or 0)
    return run


QUERIES["importance_split"] = _importance("random_forest", M.share_importances)
QUERIES["importance_split_boosted"] = _importance("boosted_trees", M.gain_importances)

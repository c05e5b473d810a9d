"""One small test for each finding of round 4 that was right."""

import json

from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from pagemill.plans import bindings as B
from pagemill.plans import quality
from pagemill.sinks import tables as K


def test_a_record_is_written_and_parsed_once(spark, tmp_path):
    cards = spark.createDataFrame([(1, "i", 'o"\n', "SCAN", .9, 1.5), (None, "i", None, None, None, None)], "k int, input_path string, processed_path string, capture_type string, white_fraction double, processing_time double")
    K.write_page_records(cards, str(tmp_path / "r"), ["k"], "preprocessing")
    stored = sorted((json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "r")).collect()), key=lambda x: x["record"]["capture_type"] is None)
    assert [r["record"] for r in stored] == [json.loads(r["record"]) for r in K.page_records(cards, ["k"], "preprocessing").orderBy(F.col("k").desc_nulls_last()).collect()]
    for keys in ("k int", None):
        back = K.read_page_records(spark, str(tmp_path / "r"), keys)
        assert back.columns == ["k", "record", "kind"] and isinstance(back.schema["record"].dataType, VariantType)
        assert "parse" not in back._jdf.queryExecution().optimizedPlan().toString()  # the reader makes the VARIANT
        found = back.selectExpr("k", "variant_get(record, '$.processed_path', 'string') AS p", "variant_get(record, '$.capture_info.white_percentage', 'double') AS w").collect()
        assert sorted(map(tuple, found), key=str) == [(1, 'o"\n', .9), (None, None, None)]


def test_a_stored_record_is_cast_once(spark):
    text = quality.stored_records(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("try_variant_get") == 4  # one for each kind


def test_a_log_is_the_text_that_to_json_gives(spark, tmp_path):
    keys = [None, 0, -1, 29, 1234, 99_999]
    rows = [(o, p, s, n) for o in keys for p in keys for s in keys for n in (None, 1, 3, 5)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    logs = B.transform_logs(spark, str(tmp_path))
    params = "struct<angle: double, rotation_type: string, transform_matrix: array<array<double>>, output_size: array<bigint>>"
    schema = f"input_path string, output_path string, output_transformed_path string, transforms array<struct<transform_type: string, params: {params}, `order`: int>>"
    assert logs.where(F.to_json(F.from_json("log", schema)) == F.col("log")).count() == len(rows)
    first = json.loads(logs.where("page_key = 29 AND part_key = 1234 AND supp_key = 29 AND line_key = 5").first()["log"])
    assert first == {"input_path": "in/29.png", "output_transformed_path": "old/29.png", "transforms": [
        {"transform_type": "deskew", "params": {"transform_matrix": [[1, 0, 2], [0, 1, 4]], "output_size": [4468, 2858]}, "order": 2},
        {"transform_type": "rotation", "params": {"angle": 90, "rotation_type": "standard"}},
        {"transform_type": "crop", "params": {"transform_matrix": [[2, 0, 0], [0, 2, 0], [0, 2 / 8192, 1]], "output_size": [4468, 2858]}, "order": 1}]}
    assert "to_json" not in logs._jdf.queryExecution().analyzed().toString()

"""Files, records, sidecars, uploads, names, sinks."""

import json
import time

import pytest
from pyspark.sql import functions as F

from pagemill.functions import names as N
from pagemill.operators import quality as Q
from pagemill.plans import bindings as B
from pagemill.sinks import tables as K
from pagemill.sources import files as S
from pagemill.sources import records as R


def test_listing(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    for name in ("b.PDF", "a.png", "c.txt", "deep/d.Jpg", "deep/er/e.tiff", "noext"):
        (tmp_path / name).write_bytes(b"xy")
    rows = S.list_files(spark, str(tmp_path)).collect()
    assert [r["path"].split(tmp_path.name + "/")[1] for r in rows] == ["a.png", "b.PDF", "deep/d.Jpg", "deep/er/e.tiff"]
    assert {r["size"] for r in rows} == {2}
    assert S.list_files(spark, str(tmp_path), (".txt",)).count() == 1


def test_listing_of_nested_folders_with_empty_files(spark, tmp_path):
    expected = {}
    for i in range(6):
        for j in range(3):
            folder = tmp_path / f"a b{i}" / f"ü{j}" / "deep"
            folder.mkdir(parents=True)
            for k in range(3):
                (folder / f"{k}.png").write_bytes(b"x" * k)
                expected[f"a b{i}/ü{j}/deep/{k}.png"] = k
    (tmp_path / "top.pdf").write_bytes(b"")
    (tmp_path / "nothing").mkdir()
    expected["top.pdf"] = 0
    from pagemill.sources import listing as L
    found = L.listing(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() > 10
    assert {r["path"].split(f"{tmp_path.name}/")[1]: r["size"] for r in found.collect()} == expected
    assert L.listing(spark, f"file://{tmp_path}").count() == len(expected)
    checked = S.check_uploads(S.list_files(spark, str(tmp_path)))
    assert checked.where("reject_reason = 'empty_file'").count() == 19 and checked.where("reject_reason IS NULL").count() == 36
    # the same files as a stream, then only what is new
    query = L.listing_stream(spark, str(tmp_path)).writeStream.format("memory").queryName("listed").start()
    try:
        deadline = time.time() + 60
        while spark.table("listed").count() < len(expected) and time.time() < deadline:
            time.sleep(0.5)
        (tmp_path / "later.pdf").write_bytes(b"zz")
        while spark.table("listed").count() < len(expected) + 1 and time.time() < deadline:
            time.sleep(0.5)
        assert sorted(r["path"].split(f"{tmp_path.name}/")[1] for r in spark.table("listed").collect()) == sorted([*expected, "later.pdf"])
    finally:
        query.stop()


@pytest.mark.parametrize("path,size,ext,reason", [
    ("x/a.PDF", 1, ".pdf", None), ("", 1, None, "name_missing"), (None, 1, None, "name_missing"), ("x/a", 1, None, "no_extension"),
    ("x/.png", 1, None, "no_extension"), ("a.exe", 1, None, "unsupported_extension"), ("a.exe", 0, None, "unsupported_extension"), ("a.png", 0, None, "empty_file")])
def test_uploads(spark, path, size, ext, reason):
    r = S.check_uploads(spark.createDataFrame([(path, size)], "path string, size bigint")).first()
    assert (r["extension"], r["reject_reason"]) == (ext, reason)


def test_names(spark):
    p = F.col("p")
    df = spark.createDataFrame([("in/a.b.png",), ("in/x_transformed.jpg",), ("in/plain",)], "p string")
    rows = df.select(N.stem(p).alias("s"), N.extension(p).alias("e"), N.output_path(p, F.lit("out"), "v").alias("o"),
                     N.original_twin(p).alias("t"), N.page_name(p, F.lit(3)).alias("n"), N.parent_name(p).alias("f")).collect()
    assert tuple(rows[0]) == ("a.b", ".png", "out/a.b_v.png", "a.b_original.png", "a.b_page3", "in")
    assert (rows[1]["t"], rows[2]["e"], rows[2]["o"]) == ("x_original.jpg", "", "out/plain_v")


def test_record_shapes(spark):
    line = {"text": "t", "confidence": .9, "bounding_box": [1, 2, 3, 4]}
    quad = {"text": "q", "bounding_box": [[1, 2], [3, 2], [3, 4], [1, 4]]}
    shapes = [{"ocr_lines": [line]}, {"features": {"ocr_lines": [line]}}, {"lines": [line]}, [line], {"ocr_lines": [line, quad], "lines": []}, {"other": 1}]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(shapes)] + [(9, "junk")], "i int, record string")
    rows = R.parse_line_records(df, ["i"]).collect()
    assert sorted(r["i"] for r in rows) == [0, 1, 2, 3, 4, 4]
    assert all(r["box"] == [1, 2, 3, 4] for r in rows if r["text"] == "t")
    q = [r for r in rows if r["text"] == "q"][0]
    assert q["corners"] == quad["bounding_box"] and q["box"] is None and q["confidence"] is None


def test_sidecars_from_disk(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, image in (("a", ".png"), ("sub/b", ".jpg"), ("c", None)):
        (tmp_path / f"{name}.qa.json").write_text(json.dumps({"rotated": True, "processing_time": 2.0, "crop_margins": {"top": 1.5}}, indent=2))
        if image:
            (tmp_path / f"{name}{image}").write_bytes(b"x")
    log = {"input_path": "i", "output_transformed_path": "old", "transforms": [{"transform_type": "rotation", "params": {"angle": 90}}]}
    (tmp_path / "a.transform.json").write_text(json.dumps(log))
    cards, images, logs = R.read_quality_sidecars(spark, str(tmp_path)), R.read_images_listing(spark, str(tmp_path)), R.read_transform_logs(spark, str(tmp_path))
    kept = Q.sidecar_pages(cards, images, logs).collect()
    assert {r["page_name"]: (r["rotated"], r["crop_margins"], r["transforms"] is not None) for r in kept} == {
        "a": (True, {"top": 1.5}, True), "b": (True, {"top": 1.5}, False)}
    first = logs.first()
    assert first["output_path"] == "old" and first["transforms"][0]["order"] == 0 and first["transforms"][0]["params"]["angle"] == 90


def test_labelled_folders(spark, tmp_path):
    from pagemill.operators.training import labelled

    files = spark.createDataFrame([("f1", "Facture"), ("f2", "Attestation"), ("f3", "Facture")], "file_name string, document_type string")
    K.write_labelled(files, str(tmp_path / "set"))
    assert {p.name for p in (tmp_path / "set").iterdir() if p.is_dir()} == {"document_type=Attestation", "document_type=Facture"}
    for cls, n in (("Zeta", 2), ("Alpha", 1)):
        (tmp_path / "tree" / cls).mkdir(parents=True)
        for i in range(n):
            (tmp_path / "tree" / cls / f"{i}.json").write_text("{}")
    rows = labelled(S.labelled_files(spark, str(tmp_path / "tree"))).collect()
    assert sorted((r["class_name"], r["class_index"]) for r in rows) == [("Alpha", 0), ("Zeta", 1), ("Zeta", 1)]


def test_records_have_the_documented_empties(spark, tmp_path):
    flags = Q.quality_flags(B.page_measures(spark, "/root/testdata/sf0.001")).where("crop_status <> 'cropped'").withColumn("final_width", F.lit(None).cast("bigint"))
    record = json.loads(K.page_records(flags, ["page_key"]).first()["record"])
    assert record["crop_margins"] == {} and record["final_resolution"] == []
    K.write_page_records(flags, str(tmp_path / "r"), ["page_key"])
    assert spark.read.json(str(tmp_path / "r")).count() == flags.count()
    K.write_metadata(flags, flags, str(tmp_path / "m"), "2024-01-01T00:00:00")
    assert spark.read.json(str(tmp_path / "m/statistics")).first()["generated_at"] == "2024-01-01T00:00:00"


def test_every_kind_of_record(spark, tmp_path):
    kinds = "array<struct<text: string, confidence: double, bounding_box: array<double>>>", "array<struct<position: array<double>, checked: boolean, confidence: double>>"
    pages = spark.createDataFrame([(1, [("a", .5, [1., 2., 3., 4.]), (None, None, None)], [(None, None, .25)]), (2, None, None), (3, [], [])], f"k int, ocr_lines {kinds[0]}, checkboxes {kinds[1]}")
    found = {r["k"]: json.loads(r["record"]) for r in K.page_records(pages, ["k"], "features").collect()}
    assert found[1] == {"ocr_lines": [{"text": "a", "confidence": .5, "bounding_box": [1, 2, 3, 4]}, {"text": "", "confidence": 0, "bounding_box": [0] * 4}],
                        "checkboxes": [{"position": [0] * 4, "checked": False, "confidence": .25}]}
    assert found[2] == found[3] == {"ocr_lines": [], "checkboxes": []}
    cards = spark.createDataFrame([(1, "i", "o", "SCAN", .9, 1.5), (2, "i", None, None, None, None)], "k int, input_path string, processed_path string, capture_type string, white_fraction double, processing_time double")
    found = {r["k"]: json.loads(r["record"]) for r in K.page_records(cards, ["k"], "preprocessing").collect()}
    assert found[1] == {"status": "success", "input_path": "i", "processed_path": "o", "capture_type": "SCAN", "capture_info": {"type": "SCAN", "white_percentage": .9}, "processing_time": 1.5}
    assert found[2]["capture_info"] == {"type": None, "white_percentage": None} and found[2]["processing_time"] is None
    step = "struct<transform_type: string, params: struct<angle: double>, `order`: int>"
    logs = spark.createDataFrame([(1, "i", "o", None, [("b", (None,), 2), ("a", (90.,), 1)]), (2, "i", "o", "p", [])], f"k int, input_path string, output_path string, output_original_path string, transforms array<{step}>")
    found = {r["k"]: json.loads(r["record"]) for r in K.page_records(logs, ["k"], "transforms").collect()}
    assert [t["transform_type"] for t in found[1]["transforms"]] == ["a", "b"] and "output_original_path" not in found[1]
    assert list(found[2]) == ["input_path", "output_path", "output_original_path", "transforms"] and found[2]["transforms"] == []
    for kind, rows in (("features", pages), ("preprocessing", cards), ("transforms", logs)):
        K.write_page_records(rows, str(tmp_path / "r"), ["k"], kind)
        K.write_page_records(rows, str(tmp_path / "r"), ["k"], kind)  # a repeated write replaces its kind only
    back = K.read_page_records(spark, str(tmp_path / "r"))
    assert {r["kind"]: r["count"] for r in back.groupBy("kind").count().collect()} == {"features": 3, "preprocessing": 2, "transforms": 2}
    assert back.where("kind = 'preprocessing' AND variant_get(record, '$.capture_type', 'string') = 'SCAN'").count() == 1


def test_expiry(spark):
    df = spark.createDataFrame([(1, 0), (2, 10)], "id int, ts_us bigint")
    assert [r["id"] for r in K.readable(K.expiring(df, 1), 1_000_000).collect()] == [2]

"""A table with every odd case, an empty one, and the rows of the smallest table."""

import pytest

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, did string, keep int, score string, copy int, block map<string,int>, part int"


def long_text():
    return "\n".join(" ".join(f"w{(i * 7 + j) % 997}x{i % 13}" for j in range(40)) for i in range(600))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in each column, empty and very long texts, ties, repeated rows, near copies, characters beyond ASCII."""
    prose = "The old mill stood by the river. Nobody had ground corn there for years!\nSwallows nested under its roof and the wheel was still."
    passage = " ".join(f"passage{i}" for i in range(45))
    rows = [
        (0, prose, "en", "a", 10), (1, None, "en", "a", None), (2, "", None, "b", 0), (3, long_text(), "en", None, 5), (4, prose, "en", "a", 10), (4, prose, "en", "a", 10),
        (None, prose, "en", "a", 10), (None, "short", None, None, None), (7, f"start here {passage} and end", "en", "b", 1), (8, f"{passage}\n{passage}", "en", "b", 1),
        (9, "   \t\n\r \x0b\x0c ", "en", "b", 1), (10, "Über den Fluß führt die alte Brücke. İstanbul ② 日本語 ß́ é\x1c! <|endoftext|>", "de", "c", 1), (11, "x", "de", "c", 1),
        (12, "12 34 !!", None, "c", 1), (13, "  THE OLD MILL STOOD BY THE RIVER. Nobody had ground corn there for years!  \nanother line of text\n\n", "en", "a", 3),
        (4, "another text of the same id", "en", "a", 10), (15, "a b", "en", "a", 1), (16, "a b c", "en", "a", 1), (17, "word " * 500, "en", "a", 1), (-5, prose + " again", "en", "a", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(*r, "x", 1, "y", 2, {"k": 1}, 3) for r in odd_rows], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.fixture(scope="session")
def small_rows(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]

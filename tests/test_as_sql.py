"""Queries against their SQL on rows that the test tables do not hold."""

from collections import Counter

import duckdb

from labelloom.queries import ORACLES, QUERIES


def _both(spark, path, name: str, table: str, rows: list, schema: str) -> tuple[Counter, Counter]:
    spark.createDataFrame(rows, schema).write.parquet(str(path / f"{table}.parquet"))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
        want = Counter(con.execute(ORACLES[name]).fetchall())
    return Counter(tuple(r) for r in QUERIES[name](spark, str(path)).collect()), want


def test_libsvm_lines_multiply_in_the_elements_type(spark, tmp_path):
    rows = [(1, [0.29, 0.204, 0.265, 0.226, -0.29, -0.204, 0.0, 1.0, 2.0], 0), (2, [-0.5] * 8, 3), (3, [0.1] * 8, None)]
    got, want = _both(spark, tmp_path, "libsvm_lines", "embeddings", rows, "vec_id long, embedding array<float>, label int")
    assert got == want
    assert ("1 1:290 2:204 3:265 4:226 5:-290 6:-204 7:0 8:1000",) in got


def test_libsvm_lines_of_missing_and_repeated(spark, tmp_path):
    full = [float(k) for k in range(8)]
    rows = [(1, [0.5, None], 0), (2, None, 1), (3, [], 1), (4, full, 0), (4, full, 0), (5, full, 0), (5, full, 2), (None, full, 2), (None, full, 2)]
    got, want = _both(spark, tmp_path, "libsvm_lines", "embeddings", rows, "vec_id long, embedding array<float>, label int")
    assert got == want


def test_ascii_titles_keep_letters_that_no_mark_makes(spark, tmp_path):
    every = "".join(map(chr, range(0xC0, 0x100)))
    rows = [(1, "ß æ Æ ø Ø ð Þ", "es"), (2, every, "fr"), (3, f"x\n{every[::-1]}", "fr"), (4, None, "fr"), (5, "", "es"), (6, "é \U0001d4d0 Łạ ñ" * 9, "es"), (7, "é", "en"), (8, "é", None)]
    got, want = _both(spark, tmp_path, "ascii_titles", "documents", rows, "doc_id long, text string, lang string")
    assert got == want
    assert (1, "ß æ Æ ø Ø ð Þ") in got

"""Brute-force versions and small tables for the operators' tests."""

import duckdb

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = r"[^\x20\x09-\x0D]+"

#: Nulls, empty and white texts, repeated rows, clashing column names.
ODD = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, " \t\n ", None, None, 4),
    (4, "one", "en", "b", 3),
    (4, "one", "en", "b", 3),
    (5, "one", "en", "b", 3),
    (None, "no id at all here", "en", "b", 17),
    (6, "é😀 ünïcode a@b.co 😀 call +49 (30) 1234-5678 😀 1.2.3.4 token: abcdef123", "de", "a", 60),
    (7, "word " * 30000, "en", "a", 150000),
    (8, "x" * 100000, "en", "c", 100000),
]


def documents(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "'k' as key", "1 as start", "2 as length", "'t' as _text", "0 as size", "'h' as hits")


def table_rows(sf_dir, name, columns):
    return duckdb.sql(f"select {columns} from '{sf_dir}/{name}.parquet'").fetchall()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)

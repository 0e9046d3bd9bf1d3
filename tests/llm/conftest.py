"""Inputs that every corpus operator must take: nulls, empty and long texts, repeated rows and clashing columns."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession

WORDS = ("red green blue stone river cloud lamp door seven paper window garden silver quiet harbour candle engine "
         "valley copper mirror basket ladder orchard violin pocket anchor meadow saddle").split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    """n words that depend on the seed alone."""
    out, x = [], seed * 7919 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)])
    return " ".join(out)


def odd_rows() -> list[tuple]:
    passage = prose(1, 120)
    texts = [
        passage, passage, f"Before it {passage} and after", None, "", " \t\n", "x", "Ünïcode ß İ ﬁ 漢字 \U0001f600 é", "<|endoftext|> a <|startoftext|>",
        "ab" * 3000, prose(2, 6000), "\u0000 zero   　", prose(3, 9), prose(3, 10), "It's 42nd 3.14 ... we'll!!!", prose(4, 700),
    ]
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[3], (99, None, None, None, None), (None, "no id", None, None, 1)]


def table_of(spark: SparkSession, rows: list[tuple], schema: str = SCHEMA) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def odd(spark) -> DataFrame:
    return table_of(spark, odd_rows()).repartition(3)


@pytest.fixture(scope="session")
def empty(spark) -> DataFrame:
    return table_of(spark, [])


@pytest.fixture(scope="session")
def small() -> str:
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sql_rows(small):
    """Rows of a query's SQL, or of a DataFrame, in one order of columns and rows."""
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")

    def rows(source):
        if isinstance(source, str):
            got = con.execute(source)
            names, values = [d[0] for d in got.description], got.fetchall()
        else:
            names, values = source.columns, [tuple(r) for r in source.collect()]
        order = sorted(range(len(names)), key=names.__getitem__)
        return sorted(names), sorted((tuple(v[i] for i in order) for v in values), key=repr)

    return rows

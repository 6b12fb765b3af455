"""Small tables with the cases that every operator must take."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

#: Names that operators use inside.
CLASHES = ["node", "key", "comp", "ref", "grp", "weight", "shard", "spans", "found", "hub", "w", "term", "kind", "start", "__id", "__hash", "__gone", "rid", "n", "score", "digest", "host", "noise"]


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(1 + k % 7)) for k in range(vocabulary)]
    return "".join(rng.choice(words) + ("\n" if rng.random() < 0.05 else " ") for _ in range(n)).strip()


def edge_rows() -> list[tuple]:
    base, other = prose(1, 120), prose(2, 200)
    near = base.split(" ")
    near[60] = "changed"
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "two words"), (9, "two words"),
        (10, other), (11, prose(3, 60) + " " + other[:700] + " " + prose(4, 60)), (12, prose(5, 30_000)), (13, "x" * 60_000), (None, prose(6, 80)),
        (14, other), (14, other), (15, "ÀÉ ünï日本 😀 " * 30), (16, "a b\x0bc\x1cd"), (17, base.upper()),
    ]


def docs(spark: SparkSession, rows: list[tuple] | None = None, clash: bool = False) -> DataFrame:
    df = spark.createDataFrame(edge_rows() if rows is None else rows, "doc_id long, text string").repartition(3)
    return df.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASHES]) if clash else df


def rows_of(df: DataFrame, *columns: str) -> list[tuple]:
    """Rows as sorted tuples; nulls first."""
    out = [tuple(r) for r in df.select(*columns).collect()]
    return sorted(out, key=lambda r: [(x is not None, x) for x in r])

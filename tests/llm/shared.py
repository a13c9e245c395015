"""Rows that every operator must take: null and empty texts, long ones, ties, repeated rows, other columns with awkward names."""

from __future__ import annotations

import random
import re

SF = "/root/testdata/sf0.001"
SF_2 = "/root/testdata/sf0.01"

WORDS = "the of and to in that with for is on river stone winter garden letter morning paper silver window market shadow harbour engine".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (f"{r.randrange(400)}" if r.random() < 0.3 else "") for _ in range(n))


LONG = prose(1, 30_000)
TEXTS = [
    (0, prose(2, 120), "en", "a"),
    (1, None, "en", "a"),
    (2, "", "en", None),
    (3, "  \n\t ", None, "b"),
    (4, LONG, "en", "b"),
    (5, prose(2, 120), "en", "b"),
    (5, prose(2, 120), "en", "b"),
    (6, "one two", None, None),
    (7, "\x00 a\x00b é 日本語 12 !!", "fr", "a"),
    (None, prose(3, 40), "en", "a"),
    (8, prose(4, 80).upper(), None, "c"),
    (9, "x", "en", "c"),
]
KIND = "doc_id long, text string, lang string, source string, row string, size long, label int, `a.b` string"


def documents(spark, texts=TEXTS):
    rows = [(d, t, lang, source, "row", 7, 1, "dot") for d, t, lang, source in texts]
    return spark.createDataFrame(rows, KIND)


def nothing(spark):
    return documents(spark, [])


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def white_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def table_rows(spark, name: str, columns: str = "*", sf: str = SF):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").selectExpr(*columns.split(", ")).collect()]

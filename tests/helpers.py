"""Toy corpus and small helpers of the tests."""

from __future__ import annotations

TOY = [
    ("d1", "cat dog dog"),
    ("d2", "cat fish"),
    ("cat-3", "bird run running"),
    ("d4", "fox owl emu yak"),
    ("d5", "pig hen cow"),
    ("d6", "Ünit u.s market"),
    ("d7", "ant bee"),
]


def topics_of(spark, *texts):
    rows = [(f"q{i}", text) for i, text in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "qid string, contents string")


def as_dict(df, key, value):
    return {tuple(r[k] for k in key): r[value] for r in df.collect()}

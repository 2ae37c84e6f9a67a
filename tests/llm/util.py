"""Small documents with the awkward cases, and brute-force versions."""

import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def passage(seed, n):
    """n different made-up words."""
    return " ".join(f"w{seed}x{i}y{(seed * 7 + i * 13) % 97}" for i in range(n))


def edge_docs():
    base = passage(1, 60)
    near = base.replace("w1x50y", "changed")
    return [
        (1, base), (2, base), (3, near), (4, passage(2, 60) + "\n" + passage(3, 40)), (5, None), (6, ""), (7, "  \n\n "),
        (None, passage(4, 30)), (8, passage(5, 20000)), (8, passage(5, 20000)), (9, "One!"), (9, "two, three"), (10, "ÄÖ éè 漢字 " * 30),
    ]


def docs_df(spark, rows=None, extra=True):
    """Documents with further columns whose names clash with results and helpers."""
    rows = edge_docs() if rows is None else rows
    kind = "doc_id long, text string"
    if extra:
        rows = [(*r, 0.5, "k", 3, "x") for r in rows]
        kind += ", score double, key string, n_words int, spans string"
    return spark.createDataFrame(rows, kind)

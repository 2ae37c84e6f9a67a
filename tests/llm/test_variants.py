import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ratebook.llm import variants
from ratebook.llm.queries import op12_spelling_variants

from .util import LOWER, docs_df, edge_docs


def counted(docs):
    seen = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    n = counted(docs)
    near = {w: [v for v in n if one_apart(v, w)] for w in n}
    form = {w: min((v for v in near[w]), key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: v if v is not None and n[v] >= 5 * n[w] else None for w, v in form.items()}
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return sorted(out)


def noisy(seed, n_docs=40):
    """Texts of few words in many spellings: runs of equal letters, accents, chains of forms."""
    rng = np.random.default_rng(seed)
    stems = ["aabbccdd", "letter", "lettter", "müßiggang", "banana", "bananas", "strÀßen", "xxxxxx", "xxxxxxx", "aaaaaab", "a×b÷cde"]
    def spelled():
        w = list(stems[min(int(rng.exponential(3)), len(stems) - 1)])
        while rng.random() < 0.35:
            i, kind = rng.integers(len(w)), rng.integers(3)
            w[i : i + (kind != 0)] = [] if kind == 2 else [str(rng.choice(list("abtxAÀé")))]
        return "".join(w)
    return [(k, " ".join(spelled() for _ in range(200))) for k in range(n_docs)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_brute_force(spark, seed):
    docs = noisy(seed)
    got = sorted(map(tuple, variants.variants(docs_df(spark, docs)).collect()), key=str)
    assert got == sorted(brute(docs), key=str) and len(got) > 100
    assert any(r[1] is not None and r[2] != r[1] for r in got)  # a chain of forms


def test_awkward_texts(spark):
    long = "q" * 30000
    docs = [*edge_docs(), *[(40 + k, f"{long}z tail {long}") for k in range(5)], *[(None, "Repeated repeated")] * 9, (1, None), (3, "word-by-word x1abcdef2 " * 6)]
    got = sorted(map(tuple, variants.variants(docs_df(spark, docs)).collect()), key=str)
    assert got == sorted(brute(docs), key=str)
    assert variants.variants(docs_df(spark, [])).count() == 0
    assert variants.variants(docs_df(spark, [(1, None), (2, "a b c")])).count() == 0


def test_nodes_are_those_of_the_trie(spark):
    """Equal prefixes have one number over all partitions, different ones have different numbers, without gaps."""
    rng = np.random.default_rng(4)
    words = sorted({"".join(rng.choice(list("abé"), rng.integers(1, 12))) for _ in range(900)})
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame([(w,) for w in words], "word string").repartition(5)
        rows = variants.numbered(df, "word", "nodes", "rank").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    of = {}
    for r in rows:
        assert words[r["rank"]] == r.word and len(r.nodes) == len(r.word) + 1
        for i, node in enumerate(r.nodes):
            assert of.setdefault(r.word[:i], node) == node
    assert sorted(of.values()) == list(range(len(of)))


def test_query_over_the_whole_table(spark, tmp_path):
    docs = noisy(3, 12)
    docs_df(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, op12_spelling_variants(spark, str(tmp_path)).collect()), key=str) == sorted(brute(docs), key=str)

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest

from ratebook.llm import bpe, decontaminate
from ratebook.llm.queries import tokenizer

from .util import docs_df, edge_docs, passage, words


def brute(docs, items):
    wins = {}
    for item, text in items:
        w = words(text)
        for i in range(len(w) - min(len(w), 10) + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for win, its in wins.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found |= {str(x) for x in its if x is not None}
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_WINDOWS, 0])
def test_decontamination_equals_brute_force(spark, limit):
    bench = passage(77, 25)
    docs = [*edge_docs(), (20, passage(6, 5) + " " + bench.upper() + " tail"), (21, "a " + " ".join(bench.split()[3:13])), (22, "short item! here"),
            (23, " ".join(bench.split()[:9]) + " end"), (24, bench + " " + bench)]
    items = [(1, bench), (10, bench), (2, "Short, ITEM"), (3, None), (4, ""), (None, "One"), (5, passage(2, 12)), (5, passage(2, 12))]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(docs_df(spark, docs), b, limit=limit)
    rows = [tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(rows, key=str) == brute(docs, items)
    assert {"score", "key"} <= set(got.columns)


def test_spans_are_cut_and_documents_dropped(spark):
    bench = passage(77, 12)
    docs = [(1, "Before, " + bench + "; After it."), (2, "clean text"), (3, None), (4, bench)]
    b = spark.createDataFrame([(1, bench)], "item_id long, text string")
    cut = decontaminate.remove_spans(decontaminate.decontaminate(docs_df(spark, docs), b))
    assert {r.doc_id: r.text for r in cut.collect()} == {1: "Before, After it.", 2: "clean text", 3: None, 4: ""}
    left = decontaminate.drop_contaminated(docs_df(spark, docs), b)
    assert sorted(r.doc_id for r in left.collect()) == [2, 3] and "key" in left.columns


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs_df(spark, []), none).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs_df(spark), none).collect())


def test_no_python_on_the_decontamination_path(spark):
    b = spark.createDataFrame([(1, passage(1, 12))], "item_id long, text string")
    plan = decontaminate.decontaminate(docs_df(spark), b)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_equal_the_library(encoding):
    v = bpe.vocabulary(*tokenizer())
    rng = np.random.default_rng(5)
    pieces = ["a", "aaaa" * 200, "abcabcabd" * 40, "ﬁéè漢字" * 30, "0123456789" * 80, "https", "the" * 400]
    pieces += ["".join(rng.choice(list("abcdeéß漢<|> \t'0"), n)) for n in range(1, 700, 9)]
    for text, ids in zip(pieces, v.encode(pieces), strict=True):
        assert ids.tolist() == encoding.encode_ordinary(text)
        assert v.decode(ids) == text.encode()


def test_encoding_table(spark, encoding):
    docs = [*edge_docs(), (30, "<|endoftext|> it's 12 o'clock"), (31, "x" * 5000), (32, "\x00\t \r\n")]
    both = bpe.decode(bpe.encode(docs_df(spark, docs), *tokenizer(), outputs=("ids", "n_tokens", "ids_sha256", "decoded_sha256")), *tokenizer())
    assert "score" in both.columns
    for r in both.collect():
        ids = encoding.encode_ordinary(r.text or "")
        assert r.ids == ids and r.n_tokens == len(ids) and bytes(r.decoded) == (r.text or "").encode()
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encode(docs_df(spark, []), *tokenizer()).count() == 0

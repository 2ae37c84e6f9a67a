import hashlib
import json

import numpy as np
import public_tokenizers as P
import pytest

from ratebook.llm import rank_bpe
from ratebook.llm.queries import op11_rank_bpe

from .util import docs_df, edge_docs

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def brute(word, ranks):
    """Merges one pair at a time, the leftmost of least rank, in plain lists."""
    parts = list(word)
    while len(parts) > 1:
        r, i = min((ranks.get((a, b), 10**9), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if r == 10**9:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def test_words_equal_one_merge_at_a_time():
    spec = json.load(open(PATH, encoding="utf-8"))["model"]
    ranks = {tuple(m): k for k, m in enumerate(spec["merges"])}
    letters, m, rng = rank_bpe.byte_letters(), rank_bpe.merges(PATH), np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdeethingré0 '"), n)) for n in range(1, 200)]
    flat, n = m.words(words)
    for w, ids in zip(words, np.split(flat, np.cumsum(n)[:-1]), strict=True):
        assert ids.tolist() == [spec["vocab"][p] for p in brute("".join(letters[b] for b in w.encode()), ranks)]


def test_every_kind_of_character_splits_as_the_library_does(library):
    m = rank_bpe.merges(PATH)
    ends = [int(x, 16) + d for r in rank_bpe.NEWER.split() for x in r.split("-") for d in (-1, 0, 1)]
    texts = [f"a{c}1{c} {c}{c}  {c}b!{c}\n{c}" for c in map(chr, [*range(0x3000), *range(0x3000, 0x110000, 211), *ends]) if not 0xD800 <= ord(c) < 0xE000]
    flat, n = m.encode(texts)
    for t, ids, want in zip(texts, np.split(flat, np.cumsum(n)[:-1]), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == want.ids, ascii(t)


def test_tables_equal_the_library(spark, library):
    docs = [*edge_docs(), (30, "<|endoftext|> it's<|endoftext|><|endoftext|>12 o'clock <|endof"), (31, "x" * 5000 + "the" * 3000), (32, "\x00\t \r\n\x1c \x85 "), (33, "\U0001f600" * 60)]
    coded = rank_bpe.encode(docs_df(spark, docs).selectExpr("*", "'old' AS ids", "1 AS _text", "2 AS decoded"), PATH)
    assert {"score", "spans", "_text", "decoded"} <= set(coded.columns)
    for r in rank_bpe.decode(coded, PATH).collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False) == (r.text or "")
    same = rank_bpe.encode(docs_df(spark, docs), PATH, decoded="back").collect()
    assert all(r.back == (r.text or "") for r in same) and len(same) == len(docs)
    assert rank_bpe.decode(rank_bpe.encode(docs_df(spark, []), PATH), PATH).count() == 0


def test_any_ids_decode_as_the_library_does(spark, library):
    rng = np.random.default_rng(5)
    lists = [rng.integers(0, 50260, 30).tolist() for _ in range(200)] + [[], None, [50256], [3, None, 4, -1, 10**6]]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, ids array<int>")
    for r in rank_bpe.decode(df, PATH).collect():
        known = [x for x in r.ids or [] if x is not None and 0 <= x < 10**5]
        assert r.decoded == library.decode(known, skip_special_tokens=False)


def test_query_digests(spark, library, tmp_path):
    docs_df(spark, [(1, "It's <|endoftext|> 5 é"), (2, None), (2, "")]).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op11_rank_bpe(spark, str(tmp_path)).collect()))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ids = library.encode("It's <|endoftext|> 5 é", add_special_tokens=False).ids
    assert got == [(1, len(ids), sha(",".join(map(str, ids))), sha("It's <|endoftext|> 5 é")), (2, 0, sha(""), sha("")), (2, 0, sha(""), sha(""))]


def test_other_kinds_of_files_are_refused(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8")) | {"normalizer": {"type": "NFC"}}
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        rank_bpe.Merges(str(tmp_path / "t.json"))

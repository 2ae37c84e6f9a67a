"""Columns of the user under the names that the operators use inside, long texts, and the pipeline as a whole."""

import time

import public_tokenizers as P
import pytest

import corpus_pipeline
from ratebook.llm import bpe, decontaminate, lines, minhash, quality, secrets, sharding, toxicity
from ratebook.llm.common import shielded
from ratebook.llm.queries import tokenizer

from .util import passage, words

INSIDE = ["_text", "_key", "_kept", "_dk", "_d", "_k", "_class", "_own", "_bundle", "_rows", "_cell", "_items", "_parts", "_first", "_score", "_predicted", "_words", "_low",
          "key", "component", "shingles", "place", "core", "kept", "line", "h1", "bucket", "hash", "start", "end", "at", "rep", "__user_0", "__user_3"]


def clashing(spark, rows):
    extra = ", ".join(f"'u{i}' AS `{c}`" for i, c in enumerate(INSIDE))
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", *[x.strip() for x in extra.split(", ")])


def untouched(df):
    return all(all(r[c] == f"u{i}" for i, c in enumerate(INSIDE)) for r in df.select(*INSIDE).collect())


DOCS = [(1, passage(1, 40)), (2, passage(1, 40)), (3, passage(2, 30) + "\n" + passage(1, 40)), (4, None), (5, "secret = abcdef123456")]


@pytest.mark.parametrize("name", ["lines", "copies", "contaminated", "marked", "shards", "secrets", "bpe", "quality", "toxicity"])
def test_users_columns_stay(spark, name):
    docs = clashing(spark, DOCS)
    bench = spark.createDataFrame([(1, passage(2, 12))], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    out = {
        "lines": lambda: lines.drop_lines(docs), "copies": lambda: minhash.drop_copies(docs), "contaminated": lambda: decontaminate.drop_contaminated(docs, bench),
        "marked": lambda: decontaminate.remove_spans(decontaminate.decontaminate(docs, bench)), "shards": lambda: sharding.shard_rows(docs, 2),
        "secrets": lambda: secrets.scan(docs, *tokenizer()), "bpe": lambda: bpe.decode(bpe.encode(docs, *tokenizer()), *tokenizer()),
        "quality": lambda: quality.score(docs, quality.fit(docs, labels)), "toxicity": lambda: toxicity.score(docs, toxicity.fit(docs, labels)),
    }[name]()
    assert out.count() and untouched(out)
    plain = {"lines": [1, 3, 4, 5], "copies": [1, 3, 4, 5], "contaminated": [1, 2, 4, 5]}
    assert sorted(r.doc_id for r in out.collect()) == plain.get(name, [1, 2, 3, 4, 5])


def test_results_replace_columns_of_their_name(spark):
    df = spark.createDataFrame([(1, "a", "old")], "doc_id int, text string, spans string")
    rows, back = shielded(df, ["text"])
    out = back(rows.selectExpr("*", "'new' AS spans", "2 AS more"))
    assert out.columns == ["doc_id", "text", "spans", "more"] and out.first() == (1, "a", "new", 2)


def test_secrets_of_a_long_text_with_many_spans():
    enc = secrets._encoding(*tokenizer())
    text = " ".join(f"token={i:06d}abcdef qzxjvkwpqy{i:05d}bdfhjl" for i in range(50_000))
    began = time.time()
    base = secrets.base_spans(text)
    more = secrets.token_spans(text, enc, base)
    assert len(base) == 50_000 and time.time() - began < 60
    assert all(not any(s < e2 and s2 < e for s2, _, e2 in base[max(0, k - 3) : k + 3]) for k, (s, _, e) in enumerate(more[:2000]))


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    """Each stage's decisions against plain versions; columns stay up to the last stage; the ids are the library's."""
    import base64

    import tiktoken

    good = [passage(10 + k, 80) for k in range(30)]
    bench = passage(500, 14)
    near = good[3].replace("w13x40y", "changed").replace("w13x41y", "too")  # two words: more than the line dedup takes
    docs = [(k, t) for k, t in enumerate(good)] + [(100, near), (101, good[4]), (102, passage(902, 60) + " " + bench), (103, "\n".join([passage(900, 30), good[6]])), (104, passage(901, 70))]
    docs += [(200 + k, "zq " * 40 + "".join(chr(97 + (k * 7 + i * i) % 26) for i in range(200))) for k in range(30)]
    clashing(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 200), 0) for k, _ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in got.collect()} if k < 5 else {}
        stage(spark, got, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        got = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert untouched(got)
        after = {r.doc_id: getattr(r, "text", None) for r in got.collect()}
        if k == 0:
            assert {d for d in before if d < 200} <= set(after) and not any(d >= 200 for d in after)
        if k == 1:  # a line goes if an earlier document or line has it
            first, want = {}, {}
            for d in sorted(before):
                own = [x for x in before[d].split("\n") if first.setdefault(tuple(words(x)), (d, x))[0] == d]
                if own:
                    want[d] = "\n".join(own)
            assert after == want and 100 in want and 101 not in want
        if k == 2:
            sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in before.items() for w in [words(t)]}
            copies = {d for d in sets if any(e < d and len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e]) for e in sets)}
            assert copies == {100} and set(after) == set(before) - copies
        if k == 3:
            wins = {tuple(words(bench)[i : i + 10]) for i in range(5)}
            hit = {d for d, t in before.items() for w in [words(t)] if any(tuple(w[i : i + 10]) in wins for i in range(len(w) - 9))}
            assert hit == {102} and set(after) == set(before) - hit
        seen.append((before, after))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = seen[4][0]
    assert {r.doc_id: list(r.ids) for r in got.collect()} == {d: enc.encode_ordinary(t) for d, t in texts.items()}
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == len(texts)

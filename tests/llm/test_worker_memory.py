"""What the Python workers of the pipeline's stages are sent and hold at once."""

from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import types as T

from ratebook.llm import bpe, lines, quality
from ratebook.llm.queries import tokenizer

from .util import docs_df


def sent_columns(df, monkeypatch):
    sent, kind = [], type(df)
    whole = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **b: sent.append(self.columns) or whole(self, *a, **b))
    return sent


def test_text_is_sent_once(spark, monkeypatch):
    docs = docs_df(spark)
    sent = sent_columns(docs, monkeypatch)
    model = quality.Model(b"", b"", False, (1.0, 0.25))
    quality.score(docs, model)
    bpe.encode(docs, *tokenizer())
    bpe.encode(docs, *tokenizer(), keep_text=False)
    assert sent == [["doc_id", "text", "key", "n_words", "spans"], ["doc_id", "text", "score", "key", "n_words", "spans"],
                    ["doc_id", "score", "key", "n_words", "spans", "_text"]]


def test_text_may_be_a_result_or_stay_away(spark):
    docs = docs_df(spark)
    model = quality.Model(b"", b"", False, (1.0, 0.25))
    want = quality.score(docs, model).select("doc_id", "score", "predicted")
    assert sorted(map(str, quality.score(docs, model, "text").selectExpr("doc_id", "text AS score", "predicted").collect())) == sorted(map(str, want.collect()))
    outputs = ("n_tokens", "ids_sha256")
    coded, bare = (bpe.encode(docs, *tokenizer(), outputs=outputs, keep_text=k) for k in (True, False))
    assert bare.columns == coded.drop("text").columns
    assert sorted(map(str, bare.collect())) == sorted(map(str, coded.drop("text").collect()))
    assert sorted(map(str, coded.select("text").collect())) == sorted(map(str, docs.select("text").collect()))


def test_line_keys_hold_a_slice_of_words(monkeypatch):
    texts = [[list(range(100 * d + 10 * k, 100 * d + 10 * k + (d + k) % 12)) for k in range(d % 5)] for d in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(range(40)), pa.array(texts, pa.list_(pa.list_(pa.int64())))],
                                       names=["doc_id", "dk", "lines"])
    rows = SimpleNamespace(schema={"doc_id": T.StructField("doc_id", T.LongType())}, mapInArrow=lambda run, kind: run)
    held, sums = [], lines.Sums
    monkeypatch.setattr(lines, "Sums", lambda column, *a: held.append(len(column.flatten().flatten())) or sums(column, *a))

    def keys(words, given):
        held.clear()
        monkeypatch.setattr(lines, "SLICE", words, raising=False)
        return [r for b in lines._line_keys(rows)(iter([given])) for r in b.to_pylist()]

    for given in (batch, batch.slice(7)):
        whole = keys(10**9, given)
        assert held == [len(given.column(2).flatten().flatten())] * 2
        assert keys(50, given) == whole
        assert max(held) <= 50
        assert keys(1, given) == whole  # a document is never cut

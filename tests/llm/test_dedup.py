import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from ratebook.llm import graph, hnsw, lines, minhash, queries

from .util import docs_df, edge_docs, passage, words


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000, x) for x in range(400, 600)] + [(x, x + 1) for x in range(700, 760)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    want = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def mutated(text, places):
    w = text.split()
    for p in places:
        w[p] = f"edit{p}"
    return " ".join(w)


def similarity(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words(a), words(b)))
    return len(x & y) / len(x | y)


def near_docs():
    out, base = edge_docs(), 100
    for g in range(12):  # groups of near copies that differ in a few words
        text = passage(20 + g, 150)
        for k in range(4):
            out.append((base, mutated(text, [] if not k else [(17 * k + 31 * j) % 150 for j in range(k)])))
            base += 1
    hot = passage(90, 120)  # one large group of near copies
    for k in range(60):
        out.append((base, mutated(hot, [k * 2 % 120])))
        base += 1
    common = passage(91, 30)  # a passage that unlike documents share
    for k in range(80):
        out.append((base, passage(200 + k, 60) + " " + common))
        base += 1
    return out


def test_near_duplicates_equal_brute_force(spark):
    docs = near_docs()
    got = minhash.classes(docs_df(spark, docs)).collect()
    assert len(got) == len(docs)
    cls = {}
    for r in got:
        if r.doc_id not in (None, 9):
            cls[r.doc_id] = r.class_id
    text = {d: t for d, t in docs if d not in (None, 9)}
    for a, b in itertools.combinations(sorted(text), 2):
        if not words(text[a]) or not words(text[b]) or min(a, b) >= 200 and a - b > 80:
            continue
        s = similarity(text[a], text[b])
        if s >= 0.8:
            assert cls[a] == cls[b], (a, b, s)
        elif s < 0.3 and a < 148 <= b:
            assert cls[a] != cls[b], (a, b, s)
    assert cls[1] == cls[2] == cls[3] == 1 and cls[4] == 4 and cls[5] == cls[6] == 5
    shared = [d for d in cls if d >= 208]
    assert len({cls[d] for d in shared}) == len(shared)
    assert {r.doc_id: r.n_class for r in got}[8] == 2


def noisy_docs():
    """Two large groups about one text each, whose members differ by none to many edits out of few words, and unlike documents."""
    rng = random.Random(11)
    out = []
    for seed, n in ((300, 160), (301, 90)):
        base = passage(seed, 110).split()
        for _ in range(n):
            w = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 2, 3, 4, 5))):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(3)}"
            out.append(" ".join(w))
    out += [passage(400 + k, 50) for k in range(350)]
    out += [passage(400 + k, 50) + " " + passage(800, 6) for k in range(0, 350, 7)]
    return list(enumerate(out))


def weighted_classes(docs):
    """doc_id -> smallest doc_id reached by links of weighted Jaccard similarity 0.8 or more, all pairs compared."""
    features = []
    for _, text in docs:
        w = words(text)
        features.append(collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)))
    df = collections.Counter(x for f in features for x in f)
    idf = {x: math.log(1 + min(len(docs) / n, 3)) for x, n in df.items()}
    weights = [{x: (1 + math.log(n)) * idf[x] for x, n in f.items()} for f in features]
    cls = list(range(len(docs)))

    def root(x):
        while cls[x] != x:
            x = cls[x]
        return x

    similar = []
    for a, b in itertools.combinations(range(len(docs)), 2):
        both = sum(min(w, weights[b][x]) for x, w in weights[a].items() if x in weights[b])
        sim = both / (sum(weights[a].values()) + sum(weights[b].values()) - both)
        similar.append(sim)
        if sim >= 0.8:
            x, y = root(a), root(b)
            cls[max(x, y)] = min(x, y)
    return {docs[k][0]: docs[root(k)][0] for k in range(len(docs))}, similar


@pytest.mark.parametrize("block", [minhash.BLOCK, 5])
def test_large_groups_equal_weighted_brute_force(spark, monkeypatch, block):
    """Every pair counts, those of a similarity between 0.3 and 0.8 too."""
    docs = noisy_docs()
    want, similar = weighted_classes(docs)
    assert sum(0.3 <= s < 0.8 for s in similar) > 5000 and sum(s >= 0.8 for s in similar) > 1000
    proved, blocks = [], minhash.linked_in_blocks

    def seen(nodes, shingles, idf):
        links = blocks(nodes, shingles, idf)
        proved.append(links.count())
        return links

    monkeypatch.setattr(minhash, "linked_in_blocks", seen)
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "PIVOTS", 1)
    got = {r.doc_id: r.class_id for r in minhash.classes(docs_df(spark, docs)).collect()}
    assert proved and got == want


def test_one_document_of_each_class_stays(spark):
    docs = near_docs()
    kept = minhash.drop_copies(docs_df(spark, docs))
    assert kept.columns == docs_df(spark, docs).columns
    ids = [r.doc_id for r in kept.collect()]
    n_class = minhash.classes(docs_df(spark, docs)).select("class_id").distinct().count()
    assert ids.count(8) == 1 and 1 in ids and not {2, 3} & set(ids) and len(ids) >= n_class
    assert minhash.drop_copies(docs_df(spark, [])).count() == 0 and minhash.classes(docs_df(spark, [])).count() == 0


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < lines.LEAST:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute_lines(docs):
    """Numbers of the lines that go, by (doc_id, text); no order ties between documents of one id here."""
    seen, out = [], {}
    for doc_id, text in sorted({(d if d is not None else -1, t or "") for d, t in docs}):
        gone = []
        for i, line in enumerate(text.split("\n")):
            w = line.lower().split()
            if w and any(w == s or distance_one(w, s) for s in seen):
                gone.append(i)
            if w and w not in seen:
                seen.append(w)
        out[doc_id] = gone
    return out


def line_docs():
    out = [d for d in edge_docs() if d[0] not in (8, 9)]
    base = passage(50, 12)
    w = base.split()
    out += [(40, "alpha\n" + base + "\nshort line"), (41, "Alpha\n" + base.upper() + "\n\nshort  line\nother line"), (42, mutated(base, [4])),
            (43, " ".join(w[:5] + w[6:])), (44, " ".join([*w[:3], "more", *w[3:]])), (45, " ".join(w[1:])), (46, " ".join([*w, "end"])),
            (47, mutated(base, [2, 9])), (48, passage(51, 7)), (49, mutated(passage(51, 7), [3])), (50, base), (50, base)]
    out += [(60 + k, mutated(passage(52, 20), [k % 20])) for k in range(40)] + [(120, passage(53, 3000)), (121, mutated(passage(53, 3000), [2999]))]
    return out


def test_line_dedup_equals_brute_force(spark):
    docs = line_docs()
    want = brute_lines(docs)
    for limit in (lines.BROADCAST_KEYS, 0):
        got = lines.decisions(docs_df(spark, docs), limit=limit).collect()
        assert len(got) == len(docs)
        assert {(-1 if r.doc_id is None else r.doc_id): list(r.dropped) for r in got} == want


def test_lines_are_cut(spark):
    docs = line_docs()
    whole = lines.dedup(docs_df(spark, docs))
    assert whole.columns == docs_df(spark, docs).columns and whole.count() == len(docs)
    text = {r.doc_id: r.text for r in whole.collect()}
    assert text[41] == "\nother line" and text[42] == "" and text[5] is None and text[7] == "  \n\n "
    left = {r.doc_id for r in lines.drop_lines(docs_df(spark, docs)).collect()}
    assert {5, 6, 7, 40, 41, 47, 48, 49, 50} <= left | {50} and not {2, 42, 43, 44, 45, 46} & left
    assert lines.dedup(docs_df(spark, [])).count() == 0


def vectors():
    rng = np.random.default_rng(11)
    base = rng.normal(size=(260, 16))
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(base)]
    n = len(rows)
    for k in range(120):  # near vectors around the hubs, some over and some under the threshold
        v = base[k % 9] + rng.normal(size=16) * 0.2 * rng.random()
        rows.append((n + k, [float(x) for x in v], (k % 9) % 3))
    rows += [(900 + k, rows[5][1], rows[5][2]) for k in range(30)]  # copies
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] * 16, 1), (2004, rows[5][1], None), (2005, [1.0, None] * 8, 1),
             (2006, [float("inf")] * 16, 1), (2007, [1.0, 2.0], 1), (2007, [1.0, 2.0], 1), (None, rows[6][1], rows[6][2])]
    return rows


def test_vectors_equal_brute_force(spark):
    rows = vectors()
    good = [i for i, (v, e, lab) in enumerate(rows) if v is not None and v < 2000]
    x = np.array([rows[i][1] for i in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([rows[i][2] for i in good])
    link = (x @ x.T >= 0.98) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(link, False)
    comp = list(range(len(good)))
    for _ in range(len(good)):
        new = [min([comp[i], *(comp[j] for j in np.flatnonzero(link[i]))]) for i in range(len(good))]
        if new == comp:
            break
        comp = new
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, label int, component string")
    for shard_rows in (50, hnsw.SHARD_ROWS):
        got = hnsw.near_vectors(df, rows=shard_rows).collect()
        assert len(got) == len(rows)
        by = {r.vec_id: r for r in got}
        extra = {6: 1}  # the copy without an id
        for k, i in enumerate(good):
            v = rows[i][0]
            more = 1 if v == 6 or link[k][good.index(6)] else 0
            assert by[v].n_links == link[k].sum() + more, (v, extra)
            assert by[v].component_id == rows[good[comp[k]]][0]
            assert by[v].kept == (by[v].component_id == v)
        assert all(by[v].n_links == 0 and by[v].component_id == v for v in (2000, 2001, 2002, 2003, 2004, 2005, 2006)) and by[2007].n_links == 1
    assert hnsw.near_vectors(df.limit(0)).count() == 0


def test_graph_search_recall():
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(200, 32))
    x = (centre[rng.integers(0, 200, 3000)] + rng.normal(size=(3000, 32)) * 0.08).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    levels, order = hnsw.build(x)
    a, b = hnsw.hits(x, levels, order, x, 0.98)
    truth = x @ x.T >= 0.98
    assert len(set(zip(a.tolist(), b.tolist(), strict=True))) >= 0.99 * truth.sum()


def test_audit_sees_rare_partners():
    """A graph without edges finds nothing; the audit notices it with one query in 200 that has a partner."""
    rng = np.random.default_rng(5)
    x, q = (hnsw._unit(rng.normal(size=(3000, 32))).astype(np.float32) for _ in range(2))
    at = np.arange(100, 3000, 200)
    q[at] = x[at[::-1]]
    levels, order = hnsw.build(x)
    for broken in (False, True):
        graphs = [np.full_like(g, -1) for g in levels] if broken else levels
        a, b = hnsw.hits(x, graphs, order, q, 0.98)
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(at.tolist(), at[::-1].tolist(), strict=True))


def test_every_df_is_counted_and_weighs(spark):
    """Classes under the whole idf, ln(1 + N / df) at any df, equal those of all pairs, and differ from those of a flat one."""
    rng = random.Random(5)
    docs = []
    for g in range(40):  # pairs whose common part is rare or held by many others
        common = passage(900 + g % 4, 30)
        for _ in range(2):
            w = (passage(1000 + g, rng.choice((40, 60, 80, 120))) + " " + common).split()
            for _ in range(rng.choice((0, 1, 2, 3))):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(50)}"
            docs.append(" ".join(w))
    base = passage(77, 60)
    docs += [mutated(base, [k]) for k in range(0, 60, 2)]
    docs = list(enumerate([*docs, docs[0], docs[0]]))
    features = [collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (words(t) for _, t in docs)]
    df = collections.Counter(x for f in features for x in f)
    want = {}
    for rare in (3.0, math.inf):
        weight = [{x: (1 + math.log(n)) * math.log(1 + min(len(docs) / df[x], rare)) for x, n in f.items()} for f in features]
        cls = list(range(len(docs)))
        for a, b in itertools.combinations(range(len(docs)), 2):
            both = sum(min(w, weight[b][x]) for x, w in weight[a].items() if x in weight[b])
            if both >= 0.8 * (sum(weight[a].values()) + sum(weight[b].values()) - both):
                old, new = max(cls[a], cls[b]), min(cls[a], cls[b])
                cls = [new if c == old else c for c in cls]
        want[rare] = dict(enumerate(cls))
    assert want[3.0] != want[math.inf]
    for rare, classes in want.items():
        assert {r.doc_id: r.class_id for r in minhash.classes(docs_df(spark, docs), rare=rare).collect()} == classes
    sh = minhash.stored(docs_df(spark, docs))
    got = {h & 0xFFFFFFFF: n for r in minhash.frequent(sh, 3).collect() for h, n in zip(r.hs, r.dfs, strict=True)}
    assert sorted(got.values()) == sorted(n for n in df.values() if n > 1)


def test_dealt_shingles_are_short(spark):
    """A shingle on its way to its cell and back takes about 2 bytes of hash instead of 4, and comes back whole."""
    rng = np.random.default_rng(4)
    lists = [np.unique(rng.integers(0, 2**32, n)) for n in (0, 250_000, 1, 0, 3)] + [np.array([0, 65_535, 65_536, 2**31, 2**32 - 1])]
    ends = np.append(0, np.cumsum([len(x) for x in lists]))
    low, high = minhash._gaps(np.concatenate(lists), ends)
    h, back = minhash._from_gaps(low, high)
    assert np.array_equal(h, np.concatenate(lists)) and np.array_equal(back, ends)
    h, back = minhash._from_gaps(low.slice(1, 3), high.slice(1, 3))
    assert np.array_equal(h, np.concatenate(lists[1:4])) and back[-1] == len(h)
    sent = np.asarray(low.flatten()).tobytes(), np.asarray(high.flatten()).tobytes()
    assert len(sent[0]) == 2 * ends[-1] and len(zlib.compress(sent[1], 1)) < 0.4 * ends[-1]
    sh = minhash.stored(docs_df(spark, [(k, passage(k % 7, 50)) for k in range(20)]))
    rows = minhash._frequent(sh, 3).collect()
    assert rows and dict(minhash._frequent(sh, 3).dtypes) == {"block": "bigint", "low": "array<smallint>", "high": "array<smallint>", "dfs": "array<int>"}
    assert sum(len(r.low) for r in rows) == sum(len(r.hs) for r in minhash.frequent(sh, 3).collect())


def test_written_shingles_are_short(spark):
    """A document's hashes come back whole from 3 bytes and a bit or so each, also from slices and of empty documents."""
    rng = np.random.default_rng(6)
    lists = [np.sort(rng.integers(0, 2**32, n)) for n in (0, 1, 500, 0, 70_000, 3)] + [np.array([0, 0, 2**24, 2**32 - 1, 2**32 - 1])]
    low, high = minhash._sorted(np.concatenate(lists).astype(np.uint64), np.array([len(x) for x in lists]))
    for first, last in ((0, 7), (2, 5), (3, 3)):
        got = minhash._unsorted(low.slice(first, last - first), high.slice(first, last - first)).to_pylist()
        assert [[h & 0xFFFFFFFF for h in x] for x in got] == [x.tolist() for x in lists[first:last]]
    assert low.nbytes + high.nbytes < 3.2 * sum(map(len, lists))
    docs = docs_df(spark, [(0, passage(1, 300)), (1, None), (2, "..."), (3, passage(2, 900))])
    plain = {r.key: sorted(h & 0xFFFFFFFF for h in r.shingles) for r in minhash.shingled(docs).collect()}
    rows = minhash.stored(docs)
    assert {r.key: r.n for r in rows.collect()} == {k: len(x) for k, x in plain.items()}
    got = minhash.listed(rows.selectExpr("key", "1L as most", "low", "high")).collect()
    assert {r.key: [h & 0xFFFFFFFF for h in r.shingles] for r in got} == plain


def test_copies_in_large_groups_are_found_as_without_idf(spark, tmp_path):
    """op7 links what is similar under the whole idf or without it, all pairs compared; large groups of edited copies stay whole (F1)."""
    rng = random.Random(8)
    docs = []
    for seed, n in ((600, 120), (601, 45), (602, 8)):  # each copy has words of its own; some are far from the others
        base = passage(seed, 130).split()
        for _ in range(n):
            w = list(base)
            for p in rng.sample(range(130), rng.choice((0, 1, 2, 2, 3, 3, 9))):
                w[p] = f"own{rng.randrange(10**6)}"
            docs.append(" ".join(w))
    common = passage(603, 40)
    docs += [passage(700 + k, 30) + " " + common for k in range(60)]  # rare words of their own, a part of a common passage
    docs += [docs[-k] + f" end{k}" for k in range(1, 20)]
    docs += [passage(800 + k, 60) for k in range(200)]
    docs = list(enumerate([*docs, docs[3], docs[3]]))
    features = [collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (words(t) for _, t in docs)]
    df = collections.Counter(x for f in features for x in f)
    want = {}
    for kind, idf in (("idf", lambda x: math.log(1 + len(docs) / df[x])), ("either", lambda x: 1.0)):
        weight = [{x: (1 + math.log(n)) * idf(x) for x, n in f.items()} for f in features]
        cls = list(want.get("idf", range(len(docs))))
        for a, b in itertools.combinations(range(len(docs)), 2):
            both = sum(min(w, weight[b][x]) for x, w in weight[a].items() if x in weight[b])
            if cls[a] != cls[b] and both >= 0.8 * (sum(weight[a].values()) + sum(weight[b].values()) - both):
                old, new = max(cls[a], cls[b]), min(cls[a], cls[b])
                cls = [new if c == old else c for c in cls]
        want[kind] = cls
    assert len(set(want["idf"])) > len(set(want["either"])) + 50
    docs_df(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op7_minhash_dedup(spark, str(tmp_path)).collect()
    assert [r.class_id for r in sorted(rows)] == want["either"]
    assert {r.doc_id: r.n_class for r in rows} == dict(enumerate(want["either"].count(c) for c in want["either"]))


def test_known_classes_are_kept_and_added_to(spark):
    """What is united already stays so, and pairs of one class aren't compared again (F1)."""
    at = spark.createDataFrame([(b"b", b"a"), (b"a", b"a"), (b"d", b"c"), (b"c", b"c")], "id binary, component binary")
    pairs = spark.createDataFrame([(b"a", b"b"), (b"b", b"c"), (b"c", b"d"), (b"d", b"e"), (b"x", b"y")], "a binary, b binary")
    assert sorted((bytes(r.a), bytes(r.b)) for r in minhash.still_apart(pairs, at).collect()) == [(b"b", b"c"), (b"d", b"e"), (b"x", b"y")]
    docs = docs_df(spark, list(enumerate([passage(1, 60), passage(2, 60), passage(2, 60) + " more", passage(3, 60)])))
    sh = minhash.stored(docs)
    key = {r.doc_id: bytes(r.key) for r in sh.collect()}
    known = spark.createDataFrame([(max(key[0], key[1]), min(key[0], key[1])), (min(key[0], key[1]),) * 2], "id binary, component binary")
    got = {bytes(r.id): bytes(r.component) for r in minhash.united(sh, math.inf, known).collect()}
    assert got == dict.fromkeys((key[0], key[1], key[2]), min(key[0], key[1], key[2]))

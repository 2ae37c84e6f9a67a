"""Embedding near-dedup with hierarchical navigable small-world graphs, one a shard.

Equal vectors of a label are one node with its number of copies, so groups of copies
give no pairs.  A label's nodes are hashed into shards of about SHARD_ROWS; each shard
builds one graph and is a single row from then on.  Every shard's nodes query every
shard of their label, as a join of blocks by label.  Queries run as one vectorised
beam search; the beam is widened for a query whose hits fill it, and for all while a
recall audit stays below RECALL.  Queries that a beam of WIDEST doesn't serve, those of
large groups of near copies above all, are compared with the whole shard.  The audit compares queries, block by block, with all
nodes of the shard until it has seen AUDIT true pairs of different nodes or has no
queries left; the pairs that it sees are hits too.
The cosine of each hit is computed again in double precision; only 0.98 and more is a
link, and links are united to components.

Defined cases: a null label, and vectors that are null, empty, zero or hold null or
non-finite components, link with nothing; vectors of different lengths don't link;
equal vec_ids each get a row, their links count each other's copies; a null vec_id
keeps a null component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint
from .graph import components

SIMILARITY = 0.98
SHARD_ROWS = 8192
#: neighbours a node keeps on upper levels, twice as many on the lowest; beams of building and querying
NEIGHBOURS, BUILD_BEAM, BEAM = 12, 40, 24
#: widest beam; a query that needs a wider one is compared with all nodes of the shard, which is exact and takes less work
WIDEST = 96
AUDIT, RECALL = 1000, 0.999
BLOCK, AUDIT_BLOCK = 1024, 256


def _search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) of the best `beam` nodes that each query reaches from its entries; -1 where it reaches fewer."""
    n_q, n_e = entry.shape
    ids = np.full((n_q, beam), -1, np.int32)
    sims = np.full((n_q, beam), -2.0, np.float32)
    seen = np.zeros((n_q, len(x)), bool)
    rows = np.arange(n_q)[:, None]
    seen[rows, entry] = True
    k = min(n_e, beam)
    ids[:, :k] = entry[:, :k]
    sims[:, :k] = np.einsum("qed,qd->qe", x[entry[:, :k]], queries)
    opened = ids < 0
    active = np.arange(n_q)
    step = max(1, min(4, beam // 4))
    while len(active):
        a = active[:, None]
        open_sims = np.where(opened[active], -3.0, sims[active])
        pick = np.argpartition(-open_sims, step - 1, axis=1)[:, :step]
        best = np.take_along_axis(open_sims, pick, 1)
        go = best.max(1) > -2.5
        active, a, pick, best = active[go], a[go], pick[go], best[go]
        if not len(active):
            break
        opened[a, pick] = True
        near = graph[np.maximum(ids[a, pick], 0)].reshape(len(active), -1)
        valid = (near >= 0) & np.repeat(best > -2.5, graph.shape[1], axis=1)
        near = np.where(valid, near, 0)
        valid &= ~seen[a, near]
        # a node that two opened nodes share counts once
        order = np.argsort(near, axis=1, kind="stable")
        ordered = np.take_along_axis(near, order, 1)
        fresh = np.take_along_axis(valid, order, 1)
        again = (ordered[:, 1:] == ordered[:, :-1]) & fresh[:, :-1]
        fresh[:, 1:] &= ~again
        near, valid = ordered, fresh
        seen[np.repeat(active, near.shape[1])[valid.ravel()], near[valid]] = True
        new = np.full(near.shape, -2.0, np.float32)
        r, c = np.nonzero(valid)
        if len(r):
            new[r, c] = np.einsum("nd,nd->n", x[near[r, c]], queries[active[r]])
        all_sims = np.concatenate([sims[active], new], 1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        sims[active] = np.take_along_axis(all_sims, top, 1)
        all_ids = np.concatenate([ids[active], np.where(valid, near, -1)], 1)
        ids[active] = np.take_along_axis(all_ids, top, 1)
        opened[active] = np.take_along_axis(np.concatenate([opened[active], ~valid], 1), top, 1) | (ids[active] < 0)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _diverse(x: np.ndarray, own: np.ndarray, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates (best first) up to `keep`: those nearer to the node than to any taken one, then the best others."""
    rows, width = ids.shape
    taken = np.full((rows, keep), -1, np.int32)
    count = np.zeros(rows, np.int64)
    used = np.zeros(ids.shape, bool)
    vec = x[np.maximum(ids, 0)]
    ok = (ids >= 0) & (ids != own[:, None])
    ok[:, 1:] &= ids[:, 1:] != ids[:, :-1]
    for j in range(width):
        held = x[np.maximum(taken, 0)]
        close = np.where(taken >= 0, np.einsum("rkd,rd->rk", held, vec[:, j]), -2.0).max(1)
        add = np.flatnonzero(ok[:, j] & (count < keep) & (close < sims[:, j]))
        taken[add, count[add]] = ids[add, j]
        count[add] += 1
        used[add, j] = True
    for j in range(width):
        add = np.flatnonzero(ok[:, j] & ~used[:, j] & (count < keep))
        taken[add, count[add]] = ids[add, j]
        count[add] += 1
    return taken


def build(x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(graph of each level from the lowest up, order of insertion by falling level) of unit vectors."""
    n = len(x)
    level = np.floor(-np.log(1 - np.random.default_rng(n).random(n)) / np.log(NEIGHBOURS)).astype(int)
    order = np.argsort(-level, kind="stable")
    levels: list[np.ndarray] = []
    for top in range(int(level.max()), -1, -1):
        nodes = order[: int((level >= top).sum())]
        keep = NEIGHBOURS * (1 if top else 2)
        graph = np.full((n, keep), -1, np.int32)
        done = 0
        while done < len(nodes):
            new = nodes[done : done + max(64, min(BLOCK, done))]
            sims = x[new] @ x[new].T
            np.fill_diagonal(sims, -2.0)
            k = min(len(new), BUILD_BEAM)
            near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            ids, best = new[near].astype(np.int32), np.take_along_axis(sims, near, 1)
            ids = np.where(best > -2, ids, -1)
            if done:
                entry = descend(x, levels, x[new], nodes)
                found, their = _search(x, graph, x[new], entry, BUILD_BEAM)
                ids, best = np.concatenate([ids, found], 1), np.concatenate([best, their], 1)
            by = np.argsort(-best, axis=1, kind="stable")
            graph[new] = _diverse(x, new, np.take_along_axis(ids, by, 1), np.take_along_axis(best, by, 1), keep)
            _link_back(x, graph, new, keep)
            done += len(new)
        levels.insert(0, graph)
    return levels, order


def _link_back(x: np.ndarray, graph: np.ndarray, new: np.ndarray, keep: int) -> None:
    """Each neighbour of a new node gets the edge back; full lists are chosen anew."""
    src = np.repeat(new, graph.shape[1])
    dst = graph[new].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    by = np.argsort(dst, kind="stable")
    src, dst = src[by], dst[by]
    targets, first, count = np.unique(dst, return_index=True, return_counts=True)
    for lo in range(0, len(targets), BLOCK):
        t, f, c = targets[lo : lo + BLOCK], first[lo : lo + BLOCK], count[lo : lo + BLOCK]
        more = np.full((len(t), int(c.max())), -1, np.int32)
        at = np.arange(more.shape[1])[None, :] < c[:, None]
        more[at] = src[np.concatenate([np.arange(a, a + b) for a, b in zip(f, c, strict=True)])]
        ids = np.concatenate([graph[t], more], 1)
        ids = np.sort(ids, axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        sims = np.where(ids >= 0, np.einsum("rkd,rd->rk", x[np.maximum(ids, 0)], x[t]), -2.0)
        by = np.argsort(-sims, axis=1, kind="stable")
        wide = 2 * keep + 16
        graph[t] = _diverse(x, t, np.take_along_axis(ids, by, 1)[:, :wide], np.take_along_axis(sims, by, 1)[:, :wide], keep)


def descend(x: np.ndarray, upper: list[np.ndarray], queries: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The entry of each query: the best node found greedily from the top level down to the one above."""
    entry = np.full((len(queries), 1), order[0], np.int64)
    for graph in reversed(upper):
        entry = np.maximum(_search(x, graph, queries, entry, 4)[0][:, :1], 0).astype(np.int64)
    return entry


def _audit(x: np.ndarray, queries: np.ndarray, least: float, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of all true pairs of queries drawn until AUDIT pairs of different nodes are seen; own: the queries are the nodes."""
    drawn = np.random.default_rng(len(queries)).permutation(len(queries))
    out, n = [], 0
    for lo in range(0, len(drawn), AUDIT_BLOCK):
        q = drawn[lo : lo + AUDIT_BLOCK]
        r, c = np.nonzero(queries[q] @ x.T >= least)
        out.append((q[r], c))
        n += int((q[r] != c).sum()) if own else len(c)
        if n >= AUDIT:
            break
    a, b = map(np.concatenate, zip(*out, strict=True))
    return a, b


def _wider(beam: int, n: int) -> int:
    return beam if beam <= WIDEST and beam < n else n


def hits(x: np.ndarray, levels: list[np.ndarray], order: np.ndarray, queries: np.ndarray, least: float, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of all pairs of a similarity of about `least` or more that the audited search finds."""
    n, beam = len(x), min(BEAM, len(x))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    todo = np.arange(len(queries))
    true_q = true_n = np.empty(0, np.int64)
    if beam < n and len(queries):
        true_q, true_n = _audit(x, queries, least, own)
        out.append((true_q, true_n))
    other = true_q != true_n if own else np.ones(len(true_q), bool)
    while len(todo):
        more, found = [], []
        for lo in range(0, len(todo), BLOCK):
            q = todo[lo : lo + BLOCK]
            if beam >= n:
                sims = queries[q] @ x.T
                r, c = np.nonzero(sims >= least)
                found.append((q[r], c))
                continue
            ids, sims = _search(x, levels[0], queries[q], descend(x, levels[1:], queries[q], order), beam)
            good = sims >= least
            full = good.all(1)  # more may lie beyond the beam
            more.append(q[full])
            r, c = np.nonzero(good & ~full[:, None])
            found.append((q[r], ids[r, c].astype(np.int64)))
        if beam < n:
            # queries that go on with a wider beam are audited then
            here = other & np.isin(true_q, todo) & ~np.isin(true_q, np.concatenate(more))
            want = true_q[here] * n + true_n[here]
            if np.isin(want, np.concatenate([q * n + c for q, c in found])).sum() < RECALL * len(want):
                beam = _wider(2 * beam, n)
                continue  # all again, with a wider beam
        out += found
        todo = np.concatenate(more) if more and beam < n else np.empty(0, np.int64)
        beam = _wider(4 * beam, n)
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = map(np.concatenate, zip(*out, strict=True))
    return a, b


def _pack(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nodes(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(label, d, v, node, n): each label's different valid vectors, with the smallest id (node) and the number of copies."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double") + 0.0)  # -0.0 becomes 0.0
    valid = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), v.alias("v"))
    return (rows.where(F.col("label").isNotNull() & F.coalesce(valid, F.lit(False)))
            .groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
            .withColumn("node", F.xxhash64("label", "v")).withColumn("d", F.size("v")))


def shards(nodes: DataFrame, rows: int = SHARD_ROWS) -> DataFrame:
    """One row a shard: label, d, shard, and its nodes, vectors and graph as bytes."""
    counts = nodes.groupBy("label", "d").agg(F.ceil(F.count("*") / rows).alias("_shards"))
    dealt = nodes.join(counts, ["label", "d"]).withColumn("shard", F.pmod(F.xxhash64("node", F.lit(3)), F.col("_shards")).cast("int"))

    def graph(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node")
        x = np.array(part["v"].tolist(), np.float64)
        levels, order = build(_unit(x).astype(np.float32))
        ids, vec, g, o = _pack(part["node"].to_numpy(np.int64), x, np.concatenate([a.ravel() for a in levels]), order.astype(np.int64))
        return pd.DataFrame({"label": [key[0]], "d": [key[1]], "shard": [key[2]], "ids": [ids], "vectors": [vec], "graph": [g], "order": [o], "levels": [len(levels)]})

    kind = nodes.schema["label"].dataType.simpleString()
    return dealt.select("label", "d", "shard", "node", "v").groupBy("label", "d", "shard").applyInPandas(
        graph, f"label {kind}, d int, shard int, ids binary, vectors binary, graph binary, order binary, levels int")


def _levels(data: bytes, n: int, levels: int) -> list[np.ndarray]:
    flat, out, at = np.frombuffer(data, np.int32), [], 0
    for k in range(levels):
        keep = NEIGHBOURS * (1 if k else 2)
        out.append(flat[at : at + n * keep].reshape(n, keep))
        at += n * keep
    return out


def node_links(packed: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(a, b), a < b: linked nodes, each shard's nodes looked up in every shard of its label."""
    query = packed.select("label", "d", F.col("shard").alias("_from"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    work = query.join(packed, ["label", "d"])  # both directions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                ids, q_ids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                x = _unit(np.frombuffer(r["vectors"], np.float64).reshape(len(ids), -1))
                q = _unit(np.frombuffer(r["q_vectors"], np.float64).reshape(len(q_ids), -1))
                x32, q32 = x.astype(np.float32), q.astype(np.float32)
                a, b = hits(x32, _levels(r["graph"], len(ids), r["levels"]), np.frombuffer(r["order"], np.int64), q32, least - 1e-5, r["_from"] == r["shard"])
                for lo in range(0, max(len(a), 1), 200_000):
                    s, t = a[lo : lo + 200_000], b[lo : lo + 200_000]
                    good = np.einsum("nd,nd->n", q[s], x[t]) >= least
                    left, right = q_ids[s[good]], ids[t[good]]
                    other = left != right
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)[other]), pa.array(np.maximum(left, right)[other])], names=["a", "b"])

    return work.mapInArrow(run, "a long, b long").distinct()


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", rows: int = SHARD_ROWS) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    nodes = checkpoint(_nodes(vectors, vec_id, embedding, label))
    links = checkpoint(node_links(checkpoint(shards(nodes, rows))))
    comp = components(links).withColumnRenamed("id", "node")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    copies = nodes.select(F.col("node").alias("b"), "n")
    degree = both.join(copies, "b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    known = nodes.join(degree, "node", "left").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select("label", "v", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    v = F.transform(F.col(embedding), lambda x: x.cast("double") + 0.0)
    out = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), v.alias("v")).join(known, ["label", "v"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))

"""Nearest neighbours by inner product: a hierarchical navigable small-world graph per shard.

Equal vectors form one node with its smallest ids. Nodes are dealt by hash to shards of about ``SHARD`` nodes; each shard's graph
is a row of flat arrays. Every shard answers the stated queries, a block of them at once, and the answers are merged.
Links are made by the distance that inner product becomes after a coordinate that evens out norms.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Written

SHARD, BLOCK = 8192, 4096
M, M0, EF_BUILD, EF = 12, 32, 40, 256
_NONE = np.int32(-1)


def _diverse(a: np.ndarray, block: np.ndarray, near: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Places among each row's candidates (nearest first) of ``m`` to take: those nearer to it than to one taken before, then the nearest of the rest."""
    v = a[near]
    among = v @ v.transpose(0, 2, 1)
    taken = np.zeros(near.shape, bool)
    best = np.full(near.shape, -np.inf)
    count = np.zeros(len(near), np.int64)
    for c in range(near.shape[1]):
        ok = (sims[:, c] > best[:, c]) & (sims[:, c] > -np.inf) & (count < m)
        taken[:, c] = ok
        count += ok
        best = np.where(ok[:, None], np.maximum(best, among[:, :, c]), best)
    # spare places go to the nearest of the rest
    return np.argsort(~taken, axis=1, kind="stable")[:, :m]


def _augmented(x: np.ndarray) -> np.ndarray:
    norm = np.einsum("nd,nd->n", x, x)
    return np.hstack([x, np.sqrt(np.maximum(0, norm.max() - norm))[:, None]]).astype(np.float32)


def _descend(x: np.ndarray, links: np.ndarray, q: np.ndarray, at: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From each query's node to ever nearer neighbours in one layer, all queries in step."""
    live = np.arange(len(q))
    while len(live):
        near = links[at[live]]
        s = np.where(near >= 0, np.einsum("qmd,qd->qm", x[near], q[live]), -np.inf)
        top = s.argmax(1)
        better = s[np.arange(len(live)), top] > best[live]
        live, near, s, top = live[better], near[better], s[better], top[better]
        at[live], best[live] = near[np.arange(len(live)), top], s[np.arange(len(live)), top]
    return at, best


def _beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, at: np.ndarray, best: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``ef`` nearest nodes that a best-first search finds in one layer from each query's node, all queries in step; -1 where there are fewer."""
    n, rows, step = len(x), np.arange(len(q)), 4
    width = min(ef, n)
    ids, sims = np.full((len(q), width), _NONE), np.full((len(q), width), -np.inf, np.float32)
    ids[:, 0], sims[:, 0] = at, best
    open_, seen = np.zeros(ids.shape, bool), np.zeros((len(q), n), bool)
    open_[:, 0] = True
    seen[rows, at] = True
    live = rows
    while len(live):
        s = np.where(open_[live], sims[live], -np.inf)
        pick = np.argsort(-s, axis=1, kind="stable")[:, : min(step, width)]
        chosen = np.take_along_axis(ids[live], pick, 1)
        chosen[np.take_along_axis(s, pick, 1) == -np.inf] = _NONE
        open_[live[:, None], pick] = False
        near = np.where(chosen[:, :, None] >= 0, links[chosen], _NONE).reshape(len(live), -1)
        near = np.sort(near, axis=1)
        fresh = (near >= 0) & ~seen[live[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        r, c = np.nonzero(fresh)
        seen[live[r], near[r, c]] = True
        new = np.full(near.shape, -np.inf, np.float32)
        new[r, c] = np.einsum("nd,nd->n", x[near[r, c]], q[live[r]])
        both_s = np.hstack([sims[live], new])
        both_i, both_o = np.hstack([ids[live], near]), np.hstack([open_[live], fresh])
        top = np.argpartition(-both_s, width - 1, axis=1)[:, :width]
        sims[live], ids[live] = np.take_along_axis(both_s, top, 1), np.take_along_axis(both_i, top, 1)
        open_[live] = np.take_along_axis(both_o, top, 1) & (sims[live] > -np.inf)
        live = live[open_[live].any(1)]
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    return np.where(sims > -np.inf, ids, _NONE), sims


def build(x: np.ndarray, seed: int = 5, m: int = M, m0: int = M0, ef: int = EF_BUILD, batch: int = 256) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Layers from the lowest: (nodes, flat neighbour array of shape nodes x width, -1 for none).

    Layers are made from the highest down, and in a layer the nodes of those above come first. Nodes are inserted in batches, at most as many as there are already:
    each is searched greedily from the top, its neighbours are chosen from what a beam finds in its layer and from its batch, and take it up in
    turn, a full one keeping a diverse choice.
    """
    n, a, rng = len(x), _augmented(x), np.random.default_rng(seed)
    level = np.floor(-np.log(1 - rng.random(n)) / np.log(m)).astype(int)
    order = np.lexsort((rng.random(n), -level))
    all_nodes, all_links, above = [], [], []
    for layer in range(level.max(), -1, -1):
        nodes, width = order[level[order] >= layer], m if layer else m0
        links = np.full((n, width), _NONE)
        done = 1
        while done < len(nodes):
            shared = int((level[nodes] > layer).sum())  # those of the layers above: while they are inserted, a search can't come through these
            own = nodes[done : min(done + min(batch, done), shared if done < shared else n)]
            q, at = a[own], np.full(len(own), nodes[0])
            best = np.einsum("qd,qd->q", a[at], q)
            for upper in above if done >= shared else []:
                at, best = _descend(a, upper, q, at, best)
            found, sims = _beam(a, links, q, at, best, ef)
            mates = q @ q.T
            np.fill_diagonal(mates, -np.inf)
            near, s = np.hstack([found, np.broadcast_to(own.astype(np.int32), mates.shape)]), np.hstack([sims, mates])
            top = np.argsort(-s, axis=1, kind="stable")[:, :ef]
            near, s = np.take_along_axis(near, top, 1), np.take_along_axis(s, top, 1)
            _link(a, links, own, near, s, width // 2 if layer == 0 else width)
            done += len(own)
        above.append(links)
        kept = np.sort(nodes)
        all_nodes.append(kept.astype(np.int32))
        all_links.append(links[kept])
    # a search begins at the first node of the highest layer
    return all_nodes[::-1], all_links[::-1]


def _link(a: np.ndarray, links: np.ndarray, own: np.ndarray, near: np.ndarray, sims: np.ndarray, m: int) -> None:
    """Link each of ``own`` to a diverse ``m`` of its candidates (``near``, nearest first), and these back to it."""
    width = links.shape[1]
    got = _diverse(a, own, np.maximum(near, 0), sims, m)
    kept = np.where(np.take_along_axis(np.where(sims > -np.inf, near, _NONE), got, 1) >= 0, np.take_along_axis(near, got, 1), _NONE)
    links[own, : kept.shape[1]] = kept
    i, j = np.repeat(own, kept.shape[1]), kept.ravel()
    i, j = i[j >= 0], j[j >= 0]
    s = np.einsum("nd,nd->n", a[i], a[j])
    by = np.lexsort((-s, j))
    i, j = i[by], j[by]
    place = np.arange(len(j)) - np.searchsorted(j, j)
    i, j, place = i[place < width], j[place < width], place[place < width]
    back, row = np.unique(j, return_inverse=True)
    new = np.full((len(back), width), _NONE)
    new[row, place] = i
    both = np.sort(np.hstack([links[back], new]), axis=1)
    both[:, 1:][both[:, 1:] == both[:, :-1]] = _NONE
    s = np.where(both >= 0, np.einsum("bcd,bd->bc", a[both], a[back]), -np.inf).astype(np.float32)
    top = np.argsort(-s, axis=1, kind="stable")
    both, s = np.take_along_axis(both, top, 1), np.take_along_axis(s, top, 1)
    got = _diverse(a, back, np.maximum(both, 0), s, width)
    links[back] = np.take_along_axis(np.where(s > -np.inf, both, _NONE), got, 1)


def search(x: np.ndarray, nodes: list[np.ndarray], links: list[np.ndarray], queries: np.ndarray, k: int, ef: int = EF) -> np.ndarray:
    """The ``k`` nearest nodes found for each query, a beam of ``ef`` for all queries in step; -1 where there are fewer."""
    x, whole = x.astype(np.float32), []
    for own, near in zip(nodes, links, strict=True):
        whole.append(np.full((len(x), near.shape[1]), _NONE))
        whole[-1][own] = near
    out = [np.zeros((0, k), np.int32)]
    for lo in range(0, len(queries), 256):
        q = queries[lo : lo + 256].astype(np.float32)
        at = np.full(len(q), nodes[-1][0])
        best = x[at[0]] @ q.T
        for upper in whole[:0:-1]:
            at, best = _descend(x, upper, q, at, best)
        ids, _ = _beam(x, whole[0], q, at, best, ef)
        out.append(np.pad(ids[:, :k], ((0, 0), (0, max(0, k - ids.shape[1]))), constant_values=-1))
    return np.concatenate(out)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed from the first component to the last."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d] * q[:, d]
    return total


def usable(vector: str) -> F.Column:
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def index(vectors: DataFrame, tables: Written, k: int, id_col: str, vector_col: str, shard: int = SHARD) -> DataFrame:
    """``dim, shard`` and a shard's flat arrays. Of equal vectors the ``k + 1`` smallest ids are kept: more can't be among the
    ``k`` nearest. They are found with a limit in every task before the shuffle, so a vector that a third of the rows share
    doesn't meet in one task."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable("v")).dropDuplicates(["id", "v"])
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    classes = tables.cut(first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("dim", F.size("v")), "classes")
    shards = tables.cut(classes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard).alias("shards")), "shards")
    dealt = classes.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")))

    def graph(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(first=[x[0] for x in frame["ids"]]).sort_values("first")
        x = np.stack(frame["v"].to_list()).astype(np.float64)
        nodes, links = build(x)
        ids, ends = np.concatenate(frame["ids"].to_list()).astype(np.int64), np.cumsum([len(i) for i in frame["ids"]])
        return pd.DataFrame({"dim": [x.shape[1]], "shard": [int(frame["shard"].iloc[0])], "x": [x.tobytes()], "ids": [ids.tobytes()], "ends": [ends.astype(np.int64).tobytes()], "nodes": [[a.tobytes() for a in nodes]], "links": [[a.tobytes() for a in links]]})

    built = dealt.select("dim", "shard", "v", "ids").groupBy("dim", "shard").applyInPandas(graph, "dim int, shard long, x binary, ids binary, ends binary, nodes array<binary>, links array<binary>")
    return tables.cut(built, "index")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, block: int = BLOCK, ef: int = EF) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of ``vectors`` of largest inner product found for each row of ``queries``
    (same columns), rows with the query's own id left out; ties to the smaller id.

    Vectors that are null, empty, zero or hold a null, NaN or infinite component take no part on either side, nor do null ids.
    Vectors meet only those of their own length. Rows alike in id and vector count once; an id with several vectors is a candidate with each; an id
    that occurs in several rows of ``queries`` is answered once, for its smallest vector. Shards and blocks are of fixed size, so a task holds one shard's graph and one block.
    """
    tables = Written(vectors.sparkSession)
    graphs = index(vectors, tables, k, id_col, vector_col, shard)
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("query_id").isNotNull() & usable("v"))
    asked = asked.groupBy("query_id").agg(F.min("v").alias("v"))
    asked = tables.cut(asked.withColumn("dim", F.size("v")), "queries")
    blocks = max(1, -(-asked.count() // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    shards = graphs.select(F.col("dim").alias("_dim"), F.col("shard").alias("_shard"))
    asked = asked.join(shards, F.col("dim") == F.col("_dim")).select("query_id", "v", "_dim", "_shard", F.col("block").alias("_block"))
    graphs = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def answer(key: tuple, graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(graph) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        g = graph.iloc[0]
        x = np.frombuffer(g["x"], np.float64).reshape(-1, g["dim"])
        ids, ends = np.frombuffer(g["ids"], np.int64), np.frombuffer(g["ends"], np.int64)
        nodes = [np.frombuffer(b, np.int32) for b in g["nodes"]]
        links = [np.frombuffer(b, np.int32).reshape(len(a), -1) for a, b in zip(nodes, g["links"], strict=True)]
        q, own = np.stack(asked["v"].to_list()).astype(np.float64), asked["query_id"].to_numpy(np.int64)
        found = search(x, nodes, links, q, k + 1, ef)
        r, c = np.nonzero(found >= 0)
        node = found[r, c]
        score = products(x[node], q[r])
        begin = np.append(0, ends[:-1])
        many = (ends - begin)[node]
        r, score = np.repeat(r, many), np.repeat(score, many)
        offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        vec = ids[np.repeat(begin[node], many) + offset]
        other = vec != own[r]
        r, score, vec = r[other], score[other], vec[other]
        order = np.lexsort((vec, -score, r))
        r, score, vec = r[order], score[order], vec[order]
        top = np.arange(len(r)) - np.searchsorted(r, r) < k
        return pd.DataFrame({"query_id": own[r[top]], "vec_id": vec[top], "score": score[top]})

    found = graphs.groupBy("dim", "shard", "block").cogroup(asked.groupBy("_dim", "_shard", "_block")).applyInPandas(answer, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

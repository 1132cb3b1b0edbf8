"""Exact top-k by inner product with block-at-a-time pruning.

Rows are dealt by id range into shards, and a shard into blocks of ``block_rows`` consecutive ids: a forward index (one
integer matrix) with the largest and smallest value of every component. For a query the sum over components of its best
possible product bounds all scores of a block. Blocks are taken in order of that bound until it falls below the k-th
best score found; equal bounds go on, because a tie may have a smaller id. The k best of each shard meet in a window.

Work is shards x query blocks; each pair is one group of bounded size. Vectors that are null or hold null or non-finite
components take no part, nor do rows without an id; shorter vectors count as padded with zeros. A query is not compared
with rows of its own id. Query rows that repeat an id with the same vector are one query; with different vectors they are queries of
their own, each with its ranks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.llm.tables import staged
from tapeloom.runtime import ship


def quantised(embedding: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(embedding: Column) -> Column:
    return embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def block_search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, block_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query: positions of queries, row ids and scores. ``ids`` ascending."""
    n, width = rows.shape
    reach = int(np.abs(rows).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(1, width)
    kind = np.float64 if reach < 1 << 53 else np.int64  # both exact; only the first has fast matrix products
    edges = [*range(0, n, block_rows), n]
    blocks = [rows[a:b].astype(kind) for a, b in zip(edges, edges[1:])]
    top = np.stack([b.max(axis=0) for b in blocks])
    low = np.stack([b.min(axis=0) for b in blocks])
    q = queries.astype(kind)
    bound = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bound, axis=1, kind="stable")
    floor = -np.iinfo(np.int64).max  # can be negated
    best = np.full((len(q), k), floor, np.int64)
    best_id = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)
    active = np.arange(len(q))
    for turn in range(len(blocks)):
        block = order[active, turn]
        going = bound[active, block] >= best[active, k - 1]
        active, block = active[going], block[going]
        if not len(active):
            break
        by = np.argsort(block, kind="stable")
        starts = np.flatnonzero(np.diff(block[by], prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(by)]):
            at = int(block[by[a]])
            who = active[by[a:b]]
            here = ids[edges[at]:edges[at + 1]]
            score = (q[who] @ blocks[at].T).astype(np.int64)
            score[here[None, :] == query_ids[who][:, None]] = floor
            # Rows below the k-th score cannot enter; most queries see none and are done here.
            hit = (score >= best[who, k - 1][:, None]).any(axis=1)
            who, score = who[hit], score[hit]
            if len(who):
                every = np.concatenate([best[who], score], axis=1)
                names = np.concatenate([best_id[who], np.broadcast_to(here, score.shape)], axis=1)
                names[every == floor] = np.iinfo(np.int64).max
                keep = np.lexsort((names, -every), axis=-1)[:, :k]
                best[who], best_id[who] = np.take_along_axis(every, keep, 1), np.take_along_axis(names, keep, 1)
    i, j = np.nonzero(best_id != np.iinfo(np.int64).max)
    return i, best_id[i, j], best[i, j]


def top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", embedding_col: str = "embedding",
          shard_rows: int = 16384, block_rows: int = 256, query_rows: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` best other rows of each query row, ties to the smaller id."""
    spark = vectors.sparkSession
    ship(spark)
    emb = F.col(embedding_col)
    ready = (vectors.where(F.col(id_col).isNotNull() & usable(emb))
             .select(F.col(id_col).cast("long").alias("id"), quantised(emb).alias("v"), is_query.alias("q")))
    ready = staged(ready, "vectors")
    n, n_queries = ready.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).first()
    shards, parts = max(1, -(-n // shard_rows)), max(1, -(-n_queries // query_rows))
    rows = staged(ready.repartitionByRange(shards, "id").select("id", "v", F.spark_partition_id().alias("shard")), "shards")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = rows.withColumn("part", each(parts))
    # Queries are numbered once, so that every shard means the same one.
    asked = staged(ready.where("q").select("id", "v").distinct().withColumn("query", F.monotonically_increasing_id()), "queries")
    right = asked.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int")).withColumn("shard", each(shards))

    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")
        rows = rows.sort_values("id", kind="stable")
        width = max(rows["v"].map(len).max(), queries["v"].map(len).max())
        ids, query_ids = rows["id"].to_numpy(), queries["id"].to_numpy()
        i, found, score = block_search(ids, _matrix(rows["v"], width), query_ids, _matrix(queries["v"], width), k, block_rows)
        return pd.DataFrame({"query": queries["query"].to_numpy()[i], "query_id": query_ids[i], "vec_id": found, "score": score})

    found = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInPandas(search, "query long, query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

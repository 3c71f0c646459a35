"""Nearest vectors by inner product within a scope and up to a time, by inverted lists or exactly.

A coarse quantiser is fitted by k-means on a bounded sample; every vector goes to the list of its
nearest centre.  A query looks into the ``probes`` lists whose centres are nearest; with no quantiser, or as many probes as
lists, the search is exact.  Scope is part of the key, so vectors of another one are never
read, and vectors later than a query are masked before the best are taken.

Lists are cut into blocks of at most about ``BLOCK`` vectors and their queries into blocks of ``QUERY_BLOCK``; each pair of
blocks is one matrix product in one task, which gives each query's best ``k``.  So a hot list is as many tasks as it
has blocks, and what is shuffled after that is ``k`` rows for each query and block.

Rows without an id, a scope, a time or a vector, with a component that is null or not
finite, or with another number of components than most rows take no part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

BLOCK, QUERY_BLOCK = 8192, 1024
#: Sampled vectors for each list, and lists at most: the bound of what the quantiser is fitted on.
SAMPLE_PER_LIST, MOST_LISTS = 128, 4096
ROUNDS = 12


def usable(rows: DataFrame, id_col: str, vector_col: str, scope_col: str | None = None, time_col: str | None = None) -> DataFrame:
    """``(id, v, scope, time)`` of the rows that take part; without columns for them, scope and time are constants."""
    scope = F.col(scope_col) if scope_col else F.lit(0)
    time = F.unix_micros(F.col(time_col).cast("timestamp")) if time_col else F.lit(0).cast("long")
    named = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), scope.alias("scope"), time.alias("time"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = named.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.col("scope").isNotNull() & F.col("time").isNotNull() & ~F.coalesce(odd, F.lit(False)))
    sizes = whole.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return whole.filter(F.size("v") == (sizes[0].n if sizes else 0))


def quantiser(rows: DataFrame, lists: int | None = None) -> np.ndarray:
    """Centres of ``lists`` (about the root of the number of rows) by k-means over a sample by the ids' hashes."""
    n = rows.count()
    lists = max(1, min(lists or round(n**0.5), MOST_LISTS, max(1, n)))
    size = lists * SAMPLE_PER_LIST
    share = min(1.0, 1.5 * size / max(n, 1))
    place = F.xxhash64("id")
    chosen = rows.filter(F.pmod(place, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(place, "id").limit(size).select("v").collect()
    if not chosen:
        return np.zeros((1, 0))
    v = np.array([r.v for r in chosen], dtype=np.float64)
    centres = v[np.linspace(0, len(v) - 1, min(lists, len(v))).astype(int)].copy()
    for _ in range(ROUNDS):
        own = nearest(v, centres, 1)[:, 0]
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, v)
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled, None]
    return centres


def nearest(v: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """For each row the numbers of its ``k`` nearest centres, nearest first; of equal ones the lower."""
    distance = (centres**2).sum(axis=1) - 2 * v @ centres.T
    return np.argsort(distance, axis=1, kind="stable")[:, :k]


def assigned(rows: DataFrame, centres: np.ndarray | None, probes: int = 1) -> DataFrame:
    """``rows`` (id, v, scope, time) with ``list``, a row for each of the ``probes`` nearest lists; no shuffle."""
    if centres is None:
        return rows.withColumn("list", F.lit(0))
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("array<int>")
    def places(v):
        import pandas as pd

        return pd.Series(list(nearest(np.stack(v.to_list()), sent.value, probes).astype(np.int32))) if len(v) else pd.Series([], dtype=object)

    return rows.withColumn("list", F.explode(places("v")))


def search(index: DataFrame, queries: DataFrame, k: int, decimals: int = 6) -> DataFrame:
    """``(query, id, score)``: of each of ``queries`` the best ``k`` of ``index`` (both from ``assigned``) in its lists and scope, no later than it, other ids only.

    Scores are rounded to ``decimals``; of equal ones the smaller id is first.
    """
    index, queries = durable(index), durable(queries.withColumnsRenamed({"id": "query", "v": "q", "time": "until"}))
    blocks = lambda rows, size, name: rows.groupBy("scope", "list").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    sizes = durable(blocks(index, BLOCK, "blocks").join(blocks(queries, QUERY_BLOCK, "query_blocks"), ["scope", "list"]))
    # each list's vectors are dealt to its blocks and sent to each block of its queries, and the other way round
    own = lambda rows, id_, mine, others: rows.join(sizes, ["scope", "list"]).withColumn(mine, F.pmod(F.xxhash64(id_), mine + "s").cast("int")).withColumn(others, F.explode(F.sequence(F.lit(0), F.col(others + "s") - 1)))
    keys = ["scope", "list", "block", "query_block"]
    a = own(index, "id", "block", "query_block").select(*keys, "id", "v", "time")
    b = own(queries, "query", "query_block", "block").select(*[F.col(c).alias(c) for c in keys], "query", "q", "until")  # columns of its own

    def best(vectors, asked):
        import pandas as pd

        if not len(vectors) or not len(asked):
            return pd.DataFrame({"query": [], "id": [], "score": []})
        vectors = vectors[vectors["time"] <= asked["until"].max()].sort_values("id", kind="stable")
        if not len(vectors):
            return pd.DataFrame({"query": [], "id": [], "score": []})
        ids, names = vectors["id"].to_numpy(), asked["query"].to_numpy()
        scores = np.round(np.stack(asked["q"].to_list()) @ np.stack(vectors["v"].to_list()).T, decimals)
        scores[(vectors["time"].to_numpy() > asked["until"].to_numpy()[:, None]) | (ids == names[:, None])] = -np.inf
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(names)), top.shape[1])
        found = pd.DataFrame({"query": names[rows], "id": ids[top.ravel()], "score": scores[rows, top.ravel()]})
        return found[found["score"] > -np.inf]

    kind = index.schema["id"].dataType.simpleString()
    found = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(best, f"query {kind}, id {kind}, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact results that were found."""
    total = exact.count()
    return found.join(exact, ["query", "id"], "left_semi").count() / total if total else 1.0

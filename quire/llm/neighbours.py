"""Approximate nearest neighbours: an NN-descent graph and greedy search over it.

Equal vectors form one node, so that copies, however many, cannot fill a node's list. The graph begins with exact
neighbours inside small cells around random pivots and is improved by rounds in which neighbours of a common node
(forward and sampled backward) are compared with each other and kept where they are nearer than what a node has, until few change.
A query expands the nearest unexpanded nodes it knows, until the nearest `beam` are all expanded.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
without id or of another length than most; of rows repeating an id, the smallest vector counts; fewer candidates than k give
all of them; an empty table gives no rows; ties go to the smaller id; extra columns are ignored. Graph, lists and beam hold the
original vectors (four bytes a component where that loses nothing, else eight), so that neither one vector of great length nor
a dense group blurs the others; distances and scores are Euclidean, in double precision.
Every row is indexed; nothing is fitted but pivots, at most `PIVOTS` nodes for each division of a cell.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import partitions, sized_side, stash

K = 24
PIVOTS = 256
TABLES = 3
CELL = 600
#: Rounds go on until fewer than this part of the edges change; ROUNDS is a bound that warns when it is met.
STILL = 0.01
ROUNDS = 16
FEW = 64
BEAM = 320
EXPAND = 96


def usable(rows: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, x (array of double), same: the rows that take part; same is a number that equal vectors share."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    good = rows.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x")).filter("vec_id is not null")
    good = good.filter(F.coalesce(F.forall("x", finite) & F.exists("x", lambda c: c != 0), F.lit(False)))
    size = good.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = size["n"] if size else 0
    zero = F.transform("x", lambda c: c + F.lit(0.0))  # -0.0 is 0.0
    return good.filter(F.size("x") == width).withColumn("x", zero).groupBy("vec_id").agg(F.min("x").alias("x")).withColumn("same", F.xxhash64("x"))


def _matrix(lists: pa.ListArray, kind=np.float64) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind).reshape(len(lists), -1) if len(lists) else np.zeros((0, 1), kind)


def _kind(nodes: DataFrame) -> str:
    """The narrowest type that holds every component exactly."""
    return "float32" if nodes.filter(F.exists("x", lambda c: c.cast("float").cast("double") != c)).isEmpty() else "float64"


def _coded(nodes: DataFrame, kind: str) -> DataFrame:
    """node, code: the bytes of a vector."""

    def each(batches):
        for b in batches:
            code = _matrix(b.column("x")).astype(kind)
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([r.tobytes() for r in code], pa.binary())], ["node", "code"])

    return stash(nodes.select("node", "x").mapInArrow(each, "node long, code binary"))


def _codes(values: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1).astype(np.float64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def _nearest(table: pa.Table, k: int, kind: str) -> pa.Table:
    """(a, b, d): the k nearest of each node of a cell."""
    node, x = table["node"].to_numpy(), _codes(table["code"].to_pylist(), kind)
    k = min(k, len(node) - 1)
    if k < 1:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
    order = np.argsort(node)
    node, x = node[order], x[order]
    d = _distances(x, x)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]  # ties to the smaller node
    return pa.table({"a": np.repeat(node, k), "b": node[near].ravel(), "d": np.take_along_axis(d, near, 1).ravel()})


def _first_graph(codes: DataFrame, kind: str, k: int, tables: int, pivots: int, cell: int) -> DataFrame:
    out = None
    for t in range(tables):
        found = _cells(codes, kind, t, pivots, cell).groupBy("cell", "part").applyInArrow(lambda g: _nearest(g, k, kind), "a long, b long, d double")
        out = found if out is None else out.unionByName(found)
    return _best(out.withColumn("new", F.lit(1)), k)


def _cells(codes: DataFrame, kind: str, turn: int, pivots: int, cell: int, depth: int = 4) -> DataFrame:
    """node, code, cell, part: nodes by nearest pivot; cells that are still large are divided by pivots of their own.

    A cell is given at most `pivots` of its nodes as pivots at a time. What is large after `depth` divisions (nodes nearly
    alike) is cut by hash.
    """

    def nearest_centre(b: pa.RecordBatch, centres) -> pa.RecordBatch:
        """centres(cell, row): the codes of a cell's pivots, or None; row is a row of the cell."""
        old, new = b.column("cell").to_numpy(), b.column("cell").to_numpy().copy()
        x = _codes(b.column("code").to_pylist(), kind) if b.num_rows else np.zeros((0, 1))
        for c in np.unique(old):
            at = np.flatnonzero(old == c)
            if own := centres(int(c), int(at[0])):
                new[at] = c * (pivots + 1) + 1 + _distances(x[at], _codes(own, kind)).argmin(1)
        return pa.RecordBatch.from_arrays([b.column("node"), b.column("code"), pa.array(new)], ["node", "code", "cell"])

    def divided(rows: DataFrame, centres: DataFrame) -> DataFrame:
        form = "node long, code binary, cell long"
        if centres.limit(FEW + 1).count() <= FEW:  # FEW * pivots vectors
            known = rows.sparkSession.sparkContext.broadcast({r["cell"]: r["centres"] for r in centres.toArrow().to_pylist()})
            return rows.select("node", "code", "cell").mapInArrow(lambda bs: (nearest_centre(b, lambda c, _: known.value.get(c)) for b in bs), form)
        joined = rows.join(centres, "cell", "left").select("node", "code", "cell", "centres")
        return joined.mapInArrow(lambda bs: (nearest_centre(b, lambda _, i, b=b: b.column("centres")[i].as_py()) for b in bs), form)

    draw = F.xxhash64(F.lit(turn), "node")
    rows = codes.withColumn("cell", F.lit(0).cast("long"))
    total = rows.count()
    if total > 2 * cell:  # the first division: pivots of the whole table
        first = rows.orderBy(draw, "node").limit(min(pivots, max(2, total // cell)))
        rows = stash(divided(rows, stash(first.groupBy("cell").agg(F.collect_list("code").alias("centres")))))
    for _ in range(depth - 1):
        sizes = stash(rows.groupBy("cell").count())
        large = sizes.filter(F.col("count") > 2 * cell)
        if large.isEmpty():
            break
        order = Window.partitionBy("cell").orderBy(draw, "node")
        drawn = rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= pivots)
        own = drawn.join(large, "cell").filter(F.col("_n") <= F.greatest(F.lit(2), F.floor(F.col("count") / cell)))
        rows = stash(divided(rows, stash(own.groupBy("cell").agg(F.collect_list("code").alias("centres")))))
    else:
        sizes = stash(rows.groupBy("cell").count())
    parts = sized_side(sizes.select("cell", F.ceil(F.col("count") / (2 * cell)).alias("parts")))
    return rows.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("node", F.lit(turn)), "parts"))


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest b of each a; new is 0 where an edge was there before. Rows are dealt by a once, for both steps."""
    dealt = edges.repartition(partitions(edges.sparkSession), "a")
    one = dealt.groupBy("a", "b").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    w = Window.partitionBy("a").orderBy("d", "b")
    ranked = one.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k)
    # the k-th distance of a node stands on its first row, infinite while it has fewer
    worst = F.max(F.when(F.col("n") == k, F.col("d"))).over(Window.partitionBy("a"))
    return stash(ranked.withColumn("worst", F.when(F.col("n") == 1, F.coalesce(worst, F.lit(float("inf"))))))


def _both_ways(graph: DataFrame, k: int, turn: int) -> DataFrame:
    """(u, v, new): neighbours of u, and at most k of the nodes that have u as neighbour, drawn by hash. A pair may come twice."""
    w = Window.partitionBy("b").orderBy(F.xxhash64("a", F.lit(turn)))
    back = graph.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).select(F.col("b").alias("u"), F.col("a").alias("v"), "new")
    return graph.select(F.col("a").alias("u"), F.col("b").alias("v"), "new").unionByName(back)


def _local_join(graph: DataFrame, codes: DataFrame, kind: str, k: int, turn: int) -> DataFrame:
    """(a, b, d): pairs of nodes with a common neighbour that are nearer than a's k-th."""
    worst = graph.filter("n = 1").select(F.col("a").alias("v"), "worst")
    known = codes.withColumnRenamed("node", "v").join(worst, "v", "left")
    lists = _both_ways(graph, k, turn).join(known, "v").groupBy("u").agg(F.collect_list(F.struct("v", "code", "worst", "new")).alias("near"))  # 2k a node

    def each(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                lists = b.column("near").slice(i, 512)
                flat, cut = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
                v, new = flat.field("v").to_numpy(), flat.field("new").to_numpy() > 0
                worst = flat.field("worst").fill_null(float("inf")).to_numpy(zero_copy_only=False)
                x = _codes(flat.field("code").to_pylist(), kind) if len(flat) else np.zeros((0, 1))
                out = []
                for s, e in zip(cut, cut[1:]):
                    if not new[s:e].any():
                        continue
                    d = _distances(x[s:e], x[s:e])
                    d[v[s:e, None] == v[None, s:e]] = np.inf
                    p, q = np.nonzero((d < worst[s:e, None]) & (new[s:e, None] | new[None, s:e]))
                    out.append((v[s:e][p], v[s:e][q], d[p, q]))
                if out:
                    a, c, d = (np.concatenate(z) for z in zip(*out))
                    _, first = np.unique(np.stack([a, c], 1), axis=0, return_index=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(c[first]), pa.array(d[first])], ["a", "b", "d"])

    return lists.mapInArrow(each, "a long, b long, d double")


def build(nodes: DataFrame, k: int = K, rounds: int = ROUNDS, tables: int = TABLES, pivots: int = PIVOTS, cell: int | None = None) -> DataFrame:
    """(a, b, d): about k near neighbours of each node of nodes (node, x)."""
    kind = _kind(nodes)
    codes = _coded(nodes, kind)
    graph = _first_graph(codes, kind, k, tables, pivots, cell or CELL)
    for turn in range(rounds):
        found = _local_join(graph, codes, kind, k, turn).withColumn("new", F.lit(1))
        graph = _best(graph.select("a", "b", "d", F.lit(0).alias("new")).unionByName(found), k)
        changed, total = graph.agg(F.coalesce(F.sum("new"), F.lit(0)), F.count("*")).first()
        if changed <= total * STILL:
            break
    else:
        warnings.warn(f"the graph still changes after {rounds} rounds: {changed} of {total} edges in the last", stacklevel=2)
    return graph


def search(queries: DataFrame, graph: DataFrame, nodes: DataFrame, beam: int = BEAM, expand: int = EXPAND, k: int = K) -> DataFrame:
    """queries (query, x, entry: a node) to (query, node, score): up to `beam` near nodes of each.

    A query is a row of what it knows. In each round the nodes it expands are joined with their neighbours, which
    carry their vectors, and what was reached is merged into the row. The last step scores by differences of components.
    """
    spark = nodes.sparkSession
    kind = _kind(nodes)
    codes = _coded(nodes, kind)
    n = partitions(spark)
    near = _both_ways(graph, k, 0).join(codes.withColumnRenamed("node", "v"), "v")
    # dealt by node once; kept for the rounds, and made again from the stored graph where an executor is lost
    lists = near.groupBy("u").agg(F.collect_list(F.struct("v", "code")).alias("near")).repartition(n, "u").persist(StorageLevel.MEMORY_AND_DISK)
    start = queries.join(codes.withColumnRenamed("node", "entry"), "entry").select("query", "x", F.array(F.struct(F.col("entry").alias("v"), "code")).alias("near"))
    state = "query long, x array<double>, node array<long>, d array<double>, done array<boolean>"
    none = {"node": "array<long>", "d": "array<double>", "done": "array<boolean>"}
    rows = start.select("query", "x", *(F.lit(None).cast(t).alias(c) for c, t in none.items()), "near")

    def merge(t: pa.Table) -> pa.Table:
        """One query: its row, and lists of nodes reached."""
        row = next(i for i, x in enumerate(t["x"].to_pylist()) if x is not None)
        x = np.asarray(t["x"][row].as_py())
        old = np.asarray(t["node"][row].as_py() or [], np.int64)
        d, done = np.asarray(t["d"][row].as_py() or [], np.float64), np.asarray(t["done"][row].as_py() or [], bool)
        flat = t["near"].combine_chunks().flatten()
        v, first = np.unique(flat.field("v").to_numpy(), return_index=True)
        fresh = ~np.isin(v, old)
        v, first = v[fresh], first[fresh]
        if len(v):
            far = ((_codes(flat.field("code").take(pa.array(first)).to_pylist(), kind) - x) ** 2).sum(1)
            old, d, done = np.concatenate([old, v]), np.concatenate([d, far]), np.concatenate([done, np.zeros(len(v), bool)])
        best = np.lexsort((old, d))[:beam]
        return pa.table({"query": t["query"].slice(row, 1), "x": t["x"].slice(row, 1), "node": pa.array([old[best]]), "d": pa.array([d[best]], pa.list_(pa.float64())), "done": pa.array([done[best]])})

    try:
        while True:
            known = stash(rows.groupBy("query").applyInArrow(merge, state))
            left = F.filter(F.arrays_zip("node", "done"), lambda z: ~z["done"])
            if known.filter(F.size(left) > 0).isEmpty():
                break
            front = known.select("query", F.explode(F.slice(left, 1, expand)).alias("z")).select("query", F.col("z.node").alias("u"))
            reached = front.join(lists, "u").select("query", F.lit(None).cast("array<double>").alias("x"), *(F.lit(None).cast(t).alias(c) for c, t in none.items()), "near")
            chosen = F.transform(F.slice(left, 1, expand), lambda z: z["node"])
            marked = known.withColumn("done", F.zip_with("node", "done", lambda v, z: z | F.array_contains(chosen, v)))
            rows = marked.withColumn("near", F.array().cast("array<struct<v:long,code:binary>>")).select("query", "x", *none, "near").unionByName(reached)
    finally:
        lists.unpersist()

    def scored(batches):
        for b in batches:
            d = np.sqrt(((_matrix(b.column("x")) - _matrix(b.column("y"))) ** 2).sum(1)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("query"), b.column("node"), pa.array(d)], ["query", "node", "score"])

    pairs = known.select("query", "x", F.explode("node").alias("node")).join(nodes.select("node", F.col("x").alias("y")), "node")
    return pairs.select("query", "node", "x", "y").mapInArrow(scored, "query long, node long, score double")


def nearest(rows: DataFrame, k: int = 10, every: int = 100, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows found for each row whose id is divisible by `every`."""
    data = stash(usable(rows, id, vector))
    # of equal rows, no query can return more than the first k + 1; a node is known by its smallest id, so that ties
    # between nodes go to the smaller id wherever lists are cut
    first = Window.partitionBy("same").orderBy("vec_id")
    some = stash(data.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k + 1))
    nodes = stash(some.filter("_n = 1").select("same", F.col("vec_id").alias("node"), "x"))
    members = some.join(nodes.select("same", "node"), "same").select("node", "vec_id")
    graph = build(nodes)
    asking = stash(data.filter(F.col("vec_id") % every == 0).select("vec_id", "same").join(nodes.select("same", "node"), "same").select("vec_id", "node"))
    asked = asking.select("node").distinct()
    found = search(nodes.join(asked, "node").select(F.col("node").alias("query"), "x", F.col("node").alias("entry")), graph, nodes)
    # every node as near as the (k + 1)-th; ties are settled by vec_id, so all members of these nodes compete
    kept = found.withColumn("_n", F.rank().over(Window.partitionBy("query").orderBy("score"))).filter(F.col("_n") <= k + 1)
    near = kept.join(members, "node")
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).filter(F.col("_r") <= k + 1)
    pairs = asking.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")).join(near.select("query", "vec_id", "score"), "query").filter("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

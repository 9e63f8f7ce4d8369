"""Exact top-k by inner product with dual cover trees (after Curtin and Ram, 2014).

Vectors are dealt into cells round sampled pivots, cells into blocks of bounded size.  A
query first meets a block of its own cell, which gives it a k-th score to beat; then it
goes to each cell whose ball can hold a better one.  Every block and every group of queries
gets a cover tree once, which is stored with its rows.  Where a group meets a block, both
trees are walked together: a pair of nodes is left out if no vector of the one can reach,
with any query of the other, that query's k-th score so far, by the product of the centres
and the covering radii.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.llm.common import bounded_batches, materialize

#: A leaf's points, about: a tree has a centre for LEAF points unless fewer separate all of them so far.
LEAF = 32
#: Queries and vectors of leaves whose products are taken at a time.
CHUNK = 1024
#: Vectors in one block and queries in one group, at most, on average.
DATA_BLOCK, QUERY_BLOCK = 1 << 15, 1 << 13
#: Pivots, at most: what every task is told of the cells stays small.
PIVOTS = 1024
#: What a row of a planted block knows of its tree.
PLANTED = "own int, number int, gap double, up int"


@dataclass
class Node:
    """A centre, one of the points, the greatest distance of the node's points from it, and children or none."""

    centre: object
    norm: float
    radius: float
    points: object
    children: list
    centres: object = None
    norms: object = None
    radii: object = None


def levels(gap):
    """The level at which a centre enters: the greatest i with 2^i below its distance from all earlier ones."""
    import numpy as np

    part, power = np.frexp(gap)
    return np.where(np.isinf(gap), np.iinfo(np.int32).max, power - np.where(part == 0.5, 2, 1))


def plant(x):
    """A cover tree of the rows of ``x``, as (own, number, gap, up) of each row.

    Centres are chosen farthest first.  number: a centre's place in that order, -1 for other
    rows; gap: its distance from the earlier ones, which only falls, so that those with a gap
    over 2^i are a net of level i: more than 2^i apart, every row within 2^i of one, and in
    every lower net too.  up: the nearest centre of the net above the first that it is in,
    which is within twice its level's distance.  own: a row's nearest centre.  The tree ends
    where it has a centre for LEAF rows, or no more than LEAF rows to any; equal rows share
    a leaf.  Distances are exact to the rounding of doubles.
    """
    import numpy as np

    n = len(x)
    x = x - x.mean(0)
    square = (x * x).sum(1)
    near, k = np.full(n, np.inf), int(square.argmin())
    own, number, gap, up = np.zeros(n, np.int32), np.full(n, -1, np.int32), np.zeros(n), np.zeros(n, np.int32)
    same = 1e-12 * float(square.max())
    for turn in range(1 + n // LEAF):
        number[k], gap[k] = turn, np.sqrt(near[k])
        d = np.maximum(square + square[k] - 2 * (x @ x[k]), 0)
        d[k] = 0
        own[d < near] = turn
        near = np.minimum(near, d)
        k = int(near.argmax())
        if near[k] <= same or turn % 16 == 0 and np.bincount(own).max() <= LEAF:
            break
    at = np.flatnonzero(number >= 0)
    at = at[np.argsort(number[at])]
    level = levels(gap[at])
    for turn in range(1, len(at)):
        above = at[:turn][level[:turn] > level[turn]]
        up[at[turn]] = number[above[((x[above] - x[at[turn]]) ** 2).sum(1).argmin()]]
    return own, number, gap, up


def cover_tree(x, planted) -> Node:
    """The root of the tree that ``plant`` told; a node's children are its own centre, a level lower, and those that enter there under it."""
    import numpy as np

    own, number, gap, up = planted
    at = np.flatnonzero(number >= 0)
    at = at[np.argsort(number[at])]
    level, order = levels(gap[at]), np.argsort(own, kind="stable")
    starts = np.searchsorted(own[order], np.arange(len(at) + 1))

    def node(turn: int, points, children: list) -> Node:
        centre = x[at[turn]]
        made = Node(centre, float(np.sqrt(centre @ centre)), float(np.sqrt(((x[points] - centre) ** 2).sum(1).max())), points, children)
        if children:
            made.centres = np.stack([c.centre for c in children])
            made.norms, made.radii = np.array([c.norm for c in children]), np.array([c.radius for c in children])
        return made

    nodes = [node(t, order[starts[t] : starts[t + 1]], []) for t in range(len(at))]
    for entering in sorted(set(level[1:].tolist())):
        under: dict[int, list[int]] = {}
        for t in np.flatnonzero(level == entering).tolist():
            under.setdefault(int(up[at[t]]), []).append(t)
        for t, below in under.items():
            parts = [nodes[t], *[nodes[b] for b in below]]
            nodes[t] = node(t, np.concatenate([p.points for p in parts]), parts)
    return nodes[0]


def _slack(most):
    """An upper bound beyond any rounding; ``most`` is the product of the greatest norms it comes from."""
    return 1e-9 * most + 1e-3


def top_k(queries, query_ids, data, data_ids, k: int, beat=None, planted_queries=None, planted_data=None):
    """(scores, ids, compared): highest inner products, both (queries, k), ties to the smaller id, a query's own id left out.

    queries, data: int64.  beat: a score for each query that it surely reaches elsewhere;
    lower ones are not sought.  planted_*: trees that are there already.  Missing places
    have id -1.  compared: pairs whose product was taken.  A score that 64 bits don't hold
    raises an error; tables of no rows give no ids.
    """
    import numpy as np

    low, none = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    best, who = np.full((len(queries), k), low), np.full((len(queries), k), none)
    beat = np.full(len(queries), low) if beat is None else beat
    compared = 0
    if len(queries) and len(data):
        qf, df = queries.astype(float), data.astype(float)
        norm = np.sqrt((qf**2).sum(1))
        largest = float(norm.max()) * float(np.sqrt((df**2).sum(1).max()))
        small = largest < 2.0**52  # products of doubles are exact
        least = np.maximum(best[:, -1], beat).astype(float)

        def bounds(one: Node, other: Node):
            """The most that a point of ``one`` reaches with one of each of the other's children."""
            far = one.norm * other.radii + other.norms * one.radius + one.radius * other.radii
            return other.centres @ one.centre + far + _slack((one.norm + one.radius) * (other.norms + other.radii))

        def compare(q: Node, d: Node) -> int:
            # A leaf's own queries: only those that its ball can still help.
            of = q.points[qf[q.points] @ d.centre + norm[q.points] * d.radius + _slack(norm[q.points] * (d.norm + d.radius)) >= least[q.points]]
            for i in range(0, len(of), CHUNK):
                for j in range(0, len(d.points), CHUNK):
                    score(of[i : i + CHUNK], d.points[j : j + CHUNK])
            return len(of) * len(d.points)

        def score(of, points) -> None:
            s = qf[of] @ df[points].T
            if largest >= 2.0**62 and (np.abs(s) >= 2.0**63 * (1 - 1e-9)).any():
                raise OverflowError("a score does not fit 64 bits")
            s = s.astype(np.int64) if small else queries[of] @ data[points].T  # wraps within sums only
            s[query_ids[of][:, None] == data_ids[points][None, :]] = low
            all_s = np.concatenate((best[of], s), axis=1)
            all_i = np.concatenate((who[of], np.broadcast_to(data_ids[points], s.shape)), axis=1)
            order = np.lexsort((all_i, ~all_s), axis=1)[:, :k]
            best[of], who[of] = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_i, order, 1)
            least[of] = np.maximum(best[of, -1], beat[of])

        q_root, d_root = cover_tree(qf, planted_queries or plant(qf)), cover_tree(df, planted_data or plant(df))
        stack = [(np.inf, q_root, d_root)]
        while stack:
            most, q, d = stack.pop()
            worst = least[q.points].min()
            if most < worst:
                continue
            if not q.children and not d.children:
                compared += compare(q, d)
                continue
            down = d.children and (not q.children or d.radius >= q.radius)
            reach = bounds(q, d) if down else bounds(d, q)
            for c in np.argsort(reach):  # the most promising is taken first
                # A part's own worst score may be above the group's: it is looked at when its turn comes.
                if reach[c] >= worst:
                    stack.append((reach[c], q, d.children[c]) if down else (reach[c], q.children[c], d))
    who[best == low] = -1
    return best, who, compared


def scaled(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * component) as longs; null where the vector or a component is null or not finite; an error where 64 bits don't hold one."""
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    at = lambda v: v.cast("double") * scale
    whole = lambda v: F.when(F.abs(at(v)) < 2.0**63, F.floor(at(v))).otherwise(F.raise_error(F.lit("a component does not fit 64 bits")).cast("double")).cast("long")
    return F.when(embedding.isNotNull() & ~bad, F.transform(embedding, whole))


def _matrix(column, dims: int):
    """The int64 rows of an Arrow list column, shorter ones padded with zeros."""
    import numpy as np
    import pyarrow as pa

    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    x = np.zeros((len(lists), dims), dtype=np.int64)
    x[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return x


def _chain(pivots):
    """Pivots in an order in which neighbours are near."""
    import numpy as np

    left, order = np.ones(len(pivots), bool), [0]
    left[0] = False
    while left.any():
        d = np.where(left, ((pivots - pivots[order[-1]]) ** 2).sum(1), np.inf)
        order.append(int(d.argmin()))
        left[order[-1]] = False
    return pivots[order]


def _in_cells(rows: DataFrame, pivots) -> DataFrame:
    """(vec_id, v, asks, cell, away, norm): the nearest pivot's number, the distance from it and the vector's length."""
    told = rows.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOTS rows
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType()), T.StructField("norm", T.DoubleType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        p = told.value
        for b in batches:
            x = _matrix(b.column(1), p.shape[1]).astype(float)
            cell = ((p**2).sum(1) - 2 * (x @ p.T)).argmin(1)
            away, norm = np.sqrt(((x - p[cell]) ** 2).sum(1)), np.sqrt((x**2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(away), pa.array(norm)], names=schema.names)

    return bounded_batches(rows).mapInArrow(run, schema)


def _planted(rows: DataFrame, keys: list[str], dims: int) -> DataFrame:
    """``rows`` with what each knows of its block's tree; a block is the rows of the same keys."""

    def run(block):
        import pyarrow as pa

        told = plant(_matrix(block.column("v"), dims).astype(float))
        for name, values in zip(("own", "number", "gap", "up"), told, strict=True):
            block = block.append_column(name, pa.array(values))
        return block

    return rows.groupBy(*keys).applyInArrow(run, T.StructType([*rows.schema.fields, *T.StructType.fromDDL(PLANTED).fields]))


def _met(queries: DataFrame, data: DataFrame, keys: list[str], k: int, dims: int, compared=None) -> DataFrame:
    """(query_id, twin, vec_id, score): each group of queries (vec_id, twin, v, beat) against the planted block of the same keys.

    Queries of a part of their group, which have no tree yet, get one here.
    """
    tree = ["own", "number", "gap", "up"]

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        q_ids, d_ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        beat = left.column("beat").to_numpy()
        told = [tuple(side.column(c).to_numpy() for c in tree) if "own" in side.column_names and len(side) else None for side in (left, right)]
        s, who, n = top_k(_matrix(left.column("v"), dims), q_ids, _matrix(right.column("v"), dims), d_ids, k, beat, *told)
        if compared is not None:
            compared.add(int(n))
        good = (who >= 0) & (s >= beat[:, None])
        take = lambda c: np.repeat(left.column(c).to_numpy(), good.sum(1))
        return pa.table({"query_id": take("vec_id"), "twin": take("twin"), "vec_id": who[good], "score": s[good]})

    anew = lambda df, *names: df.select(*keys, *names).toDF(*keys, *names).groupBy(*keys)  # noqa: E731  columns of its own: both may come from one table
    asking = anew(queries, "vec_id", "twin", "v", "beat", *[c for c in tree if c in queries.columns])
    return asking.cogroup(anew(data, "vec_id", "v", *tree)).applyInArrow(run, "query_id long, twin long, vec_id long, score long")


def _reaching(queries: DataFrame, cells: list, pivots) -> DataFrame:
    """(qb, cell): the cells in which some query of a group may find its ``beat`` or better."""
    told = queries.sparkSession.sparkContext.broadcast((pivots, cells))  # at most PIVOTS rows

    def run(batches):
        import numpy as np
        import pyarrow as pa

        pivots, cells = told.value
        number = np.array([c["cell"] for c in cells], np.int64)
        p, radius, norm = pivots[number], np.array([c["radius"] for c in cells]), np.array([c["norm"] for c in cells])
        for b in batches:
            x = _matrix(b.column(1), pivots.shape[1]).astype(float)
            length = np.sqrt((x**2).sum(1))[:, None]
            most = np.minimum(x @ p.T + length * radius, length * norm) + _slack(length * (np.sqrt((p**2).sum(1)) + radius))
            row, at = np.nonzero(most >= b.column(2).to_numpy()[:, None].astype(float))
            pairs = np.unique(np.stack((b.column(0).to_numpy()[row], number[at]), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int32())], names=["qb", "cell"])

    return bounded_batches(queries).select("qb", "v", "beat").mapInArrow(run, "qb long, cell int").distinct()


def search(vectors: DataFrame, is_query: Column, k: int = 10, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK, compared=None) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows (vec_id, v array of long): the ``k`` best for each query.

    Queries are rows where ``is_query``; candidates all rows of another vec_id.  Rows with a
    null vec_id or v take no part; rows repeated in full count once; of rows that share a
    vec_id each query has ranks of its own; shorter vectors count as padded with zeros; an
    empty table gives none.  Nothing is left out before its bound is below a query's k-th
    score; where bounds help nothing, all pairs are compared, block by block.  compared: an
    accumulator that is told how many pairs were.
    """
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asks = F.coalesce(is_query, F.lit(False)).alias("asks")
    rows = materialize(vectors.where("vec_id IS NOT NULL AND v IS NOT NULL").select("vec_id", "v", asks).dropDuplicates(["vec_id", "v"]), "vectors")
    n, n_q, dims = rows.agg(F.count(F.lit(1)), F.count_if("asks"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if not n_q:
        return none
    import numpy as np

    data_block = min(data_block, max(4096, n // (2 * spark.sparkContext.defaultParallelism)))  # as many blocks as keep the cluster busy
    wanted = min(PIVOTS, 1 + n // data_block)
    mixed = F.xxhash64("vec_id", "v")
    found = rows.orderBy(mixed, "vec_id").select("v").limit(wanted).collect()  # a top-k of at most PIVOTS rows
    pivots = _chain(np.unique(np.array([[*r["v"], *[0] * (dims - len(r["v"]))] for r in found], dtype=float).reshape(len(found), dims), axis=0))
    placed = materialize(_in_cells(rows, pivots), "cells")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("n_q"), F.max("away").alias("radius"), F.max("norm").alias("norm")).orderBy("cell").collect()  # at most PIVOTS rows
    before = {c["cell"]: sum(x["n_q"] for x in cells if x["cell"] < c["cell"]) for c in cells}
    table = spark.createDataFrame([(c["cell"], 1 + c["n"] // data_block, c["n_q"], before[c["cell"]]) for c in cells], "cell int, subs long, n_q long, before long")
    part = F.shiftrightunsigned(mixed, 33) / F.lit(2.0**31)
    dealt = placed.join(table, "cell")
    data = materialize(_planted(dealt.select("cell", F.floor(part * F.col("subs")).cast("int").alias("sub"), "vec_id", "v"), ["cell", "sub"], dims), "trees")
    # Groups of queries follow the chain of cells; a crowded cell's are dealt over several.
    group = F.floor((F.col("before") + part * F.col("n_q")) / query_block)
    low, high = F.lit(-(1 << 63)).cast("long"), F.lit((1 << 63) - 1)
    queries = dealt.where("asks").select("cell", group.alias("qb"), "vec_id", mixed.alias("twin"), "v", F.floor(part * F.col("subs")).cast("int").alias("sub"), low.alias("beat"))
    queries = materialize(_planted(queries, ["qb"], dims), "queries")
    found, seen = None, F.lit(False)
    if n > data_block:  # what each query finds in the block it lies in
        own = data.join(queries.select("qb", "cell", "sub").distinct(), ["cell", "sub"])
        found = materialize(_met(queries.drop("own", "number", "gap", "up"), own, ["qb", "cell", "sub"], k, dims, compared), "found")
        reached = found.groupBy(F.col("query_id").alias("vec_id"), "twin").agg(F.count(F.lit(1)).alias("h"), F.min("score").alias("beat")).where(F.col("h") >= k).drop("h")
        queries = materialize(queries.drop("beat").join(reached, ["vec_id", "twin"], "left").withColumn("beat", F.coalesce("beat", low)), "queries")
        seen = (F.col("cell") == F.col("own_cell")) & (F.col("sub") == F.col("own_sub"))
    pairs = materialize(_reaching(queries, cells, pivots).join(table.select("cell", "subs"), "cell"), "pairs")
    asking = queries.withColumnsRenamed({"cell": "own_cell", "sub": "own_sub"}).join(pairs, "qb").withColumn("sub", F.explode(F.sequence(F.lit(0), (F.col("subs") - 1).cast("int"))))
    asking = asking.withColumn("beat", F.when(seen, high).otherwise(F.col("beat")))  # a tree is its whole group's: who was here seeks nothing
    best = _met(asking, data.join(pairs.select("qb", "cell"), "cell"), ["qb", "cell", "sub"], k, dims, compared)
    best = best if found is None else best.unionByName(found)
    order = Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


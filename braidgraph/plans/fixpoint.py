"""Reverse reachability with levels: one executor for a frontier that grows through joins.

``reach`` answers for many starting points at once (rows keyed by ``target``).  Small edge tables, by a checked count, are
walked in the driver: a level costs a job, and on small data jobs are all the cost.  Beyond that, every level is
``frontier JOIN edges -> anti join visited -> group`` and a written table; only one row count comes back.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import numbered, small_rows, written

#: Edges and targets up to which the walk is made in the driver.
LOCAL_EDGES, LOCAL_TARGETS = 100_000, 1_000
#: Edges up to which all nodes are walked over arrays of numbers, 4 bytes for an edge and 4 for a node.
ARRAY_EDGES = 30_000_000
#: Nodes from which one task walks, pairs that it can tell apart at once, and groups whose names are broadcast.
STARTS_A_TASK, CELLS, NAMED = 2_000, 8_000_000, 100_000


def _walk(edges: list[tuple[str, str]], targets: list[str], depth: int) -> list[tuple]:
    into: dict[str, list[str]] = {}
    for a, b in edges:
        into.setdefault(b, []).append(a)
    out = []
    for t in targets:
        level, seen, distance = [t], {}, 0
        while level and distance < depth:
            distance += 1
            new: dict[str, set[str]] = {}
            for b in level:
                for a in into.get(b, ()):
                    if a not in seen:
                        new.setdefault(a, set()).add(b)
            seen |= new
            out += [(t, a, distance, sorted(via)) for a, via in new.items()]
            level = list(new)
    return out


SCHEMA = "target string, id string, distance int, via array<string>"


def reach(edges: DataFrame, targets: DataFrame, depth: int, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """target, id, distance, via: nodes from which a target can be reached by at most ``depth`` edges.

    edges: (from, to).  targets: (target).  ``via`` holds all nodes one level nearer that ``id`` points at, sorted.  A
    target is not visited beforehand, so one that lies on a cycle is in its own result.  Repeated edges count once.
    """
    edges = edges.select("from", "to").where(F.col("from").isNotNull() & F.col("to").isNotNull()).distinct()
    spark = edges.sparkSession
    few = small_rows(targets.distinct(), LOCAL_TARGETS) if local_edges else None
    rows = small_rows(edges, local_edges) if few is not None else None
    if rows is not None:
        found = _walk([tuple(r) for r in rows], [r[0] for r in few], depth)
        return spark.createDataFrame(found, SCHEMA)
    edges = written(edges.withColumnRenamed("to", "near"), "edges")
    frontier = targets.select("target", F.col("target").alias("near")).distinct()
    levels: list[DataFrame] = []
    for distance in range(1, depth + 1):
        new = frontier.join(edges, "near").select("target", F.col("from").alias("id"), "near")
        if levels:
            new = new.join(_all(levels).select("target", "id"), ["target", "id"], "left_anti")
        new = new.groupBy("target", "id").agg(F.sort_array(F.collect_set("near")).alias("via"))
        level = written(new.select("target", "id", F.lit(distance).alias("distance"), "via"), f"level{distance}")
        if level.isEmpty():
            break
        levels.append(level)
        frontier = level.select("target", F.col("id").alias("near"))
    if not levels:
        return spark.createDataFrame([], SCHEMA)
    return _all(levels)


def _all(levels: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, levels)


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """names (id, k): the ends of edges (from, to), numbered from 0 in the order of their ids; and the edges as numbers (a, b)."""
    names = numbered(edges.select(F.col("from").alias("id")).union(edges.select("to")).distinct().orderBy("id"), "k", "names")
    number = lambda df, old, new: df.join(names.select(F.col("id").alias(old), F.col("k").alias(new)), old).drop(old)
    return names, written(number(number(edges, "from", "a"), "to", "b"), "edges")


def _arrays(pairs: DataFrame, nodes: int, key: str, other: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the neighbours of each node begin, and the neighbours: of pairs of numbers, ``other`` for each ``key``."""
    rows = pairs.orderBy(key).select(F.col(key).cast("int"), F.col(other).cast("int")).toArrow()
    starts = np.zeros(nodes + 1, np.int32)
    np.cumsum(np.bincount(rows.column(key).to_numpy(), minlength=nodes), out=starts[1:])
    return starts, rows.column(other).to_numpy().astype(np.int32)


def _walked(starts: np.ndarray, near: np.ndarray, nodes: np.ndarray, depth: int) -> np.ndarray:
    """For each of some nodes, how many can be reached from it in 1 to ``depth`` steps.  Several are walked at once."""
    n = starts.size - 1
    lanes = max(1, min(CELLS // n, 256, nodes.size))
    seen, last = np.zeros(lanes * n, np.int32), np.empty(lanes * n, np.int32)
    out = np.zeros(nodes.size, np.int64)
    for turn, low in enumerate(range(0, nodes.size, lanes), 1):
        at = nodes[low : low + lanes]
        lane = np.arange(at.size)
        for _ in range(depth):
            begin, count = starts[at], starts[at + 1] - starts[at]
            ends = np.cumsum(count, dtype=np.int64)
            total = int(ends[-1]) if ends.size else 0
            if not total:
                break
            at = near[np.repeat(begin - (ends - count), count) + np.arange(total)]
            lane = np.repeat(lane, count)
            cell = lane * n + at
            new = np.flatnonzero(seen[cell] != turn)
            cell = cell[new]
            order = np.arange(cell.size, dtype=np.int32)
            last[cell] = order
            once = last[cell] == order
            new = new[once]
            seen[cell[once]] = turn
            at, lane = at[new], lane[new]
            out[low : low + lanes] += np.bincount(lane, minlength=min(lanes, nodes.size - low))
    return out


def _circles(starts: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The smallest node of the strong component of each node, in one pass over nodes and edges (Tarjan, without recursion)."""
    n = starts.size - 1
    starts, near = array("i", starts.tobytes()), array("i", near.tobytes())
    index, low, group, place = array("i", bytes(4 * n)), array("i", bytes(4 * n)), array("i", [-1]) * n, array("i", starts[:n])
    path, open_, count = array("i"), array("i"), 0
    for root in range(n):
        if index[root]:
            continue
        path.append(root)
        while path:
            v = path[-1]
            if not index[v]:
                count += 1
                index[v] = low[v] = count
                open_.append(v)
            i, end, deeper = place[v], starts[v + 1], False
            while i < end:
                w = near[i]
                if not index[w]:
                    path.append(w)
                    deeper = True
                    break
                i += 1
                if group[w] < 0 and low[w] < low[v]:
                    low[v] = low[w]
            place[v] = i
            if deeper:
                continue
            path.pop()
            if low[v] == index[v]:
                while True:
                    w = open_.pop()
                    group[w] = v
                    if w == v:
                        break
    group = np.frombuffer(group, np.int32)
    least = np.empty(n, np.int32)
    least[group[::-1]] = np.arange(n, dtype=np.int32)[::-1]
    return least[group]


def reach_counts(edges: DataFrame, targets: DataFrame, depth: int, array_edges: int = ARRAY_EDGES) -> DataFrame:
    """target, n: from how many nodes each target can be reached by at most ``depth`` edges, as by reach(), without saying which.

    Up to ``array_edges`` edges, by a checked count, every task has all edges as two arrays of numbers and walks from its share of
    the targets: no pair of nodes is shuffled or written.  Beyond that a level holds two numbers for each pair; every level is one
    join with the edges, one anti join with all pairs so far, and a written table.
    """
    edges = edges.select("from", "to").where(F.col("from").isNotNull() & F.col("to").isNotNull()).distinct()
    spark = edges.sparkSession
    names, pairs = _numbered(edges)
    goals = targets.select(F.col("target").alias("id")).distinct().join(names, "id")
    if pairs.count() <= array_edges:
        nodes = names.count()
        if not nodes:
            return spark.createDataFrame([], "target string, n long")
        given = spark.sparkContext.broadcast(_arrays(pairs, nodes, "b", "a"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = pa.array(_walked(*given.value, batch.column("k").to_numpy(), depth), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id"), found], names=["target", "n"])

        return goals.repartition(max(1, -(-nodes // STARTS_A_TASK)), "k").mapInArrow(run, "target string, n long").where("n > 0")
    edges = pairs.withColumnRenamed("b", "near")
    number = lambda df, old, new: df.join(names.withColumnRenamed("id", old).withColumnRenamed("k", new), old).drop(old)
    frontier = number(targets.select("target").distinct(), "target", "t").withColumn("near", F.col("t"))
    levels: list[DataFrame] = []
    for distance in range(1, depth + 1):
        new = frontier.join(edges, "near").select("t", F.col("a").alias("near")).distinct()
        if levels:
            new = new.join(_all(levels), ["t", "near"], "left_anti")
        level = written(new, f"count{distance}")
        if level.isEmpty():
            break
        levels.append(level)
        frontier = level
    if not levels:
        return edges.sparkSession.createDataFrame([], "target string, n long")
    counts = _all(levels).groupBy(F.col("t").alias("k")).agg(F.count("*").alias("n"))
    return counts.join(names, "k").select(F.col("id").alias("target"), "n")


def components(edges: DataFrame) -> DataFrame:
    """node, component: connected components of undirected edges (from, to); the smallest id names each.

    Alternating large-star and small-star steps over written tables; no step makes more rows than it reads.
    """
    pairs = written(edges.select(F.greatest("from", "to").alias("u"), F.least("from", "to").alias("v")).where("u <> v").distinct(), "pairs")
    before = None
    while True:
        mark = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = mark
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        pairs = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "pairs")


def _grouped(names: DataFrame, pairs: DataFrame) -> DataFrame:
    nodes = names.count()
    if not nodes:
        return names.select(F.col("id").alias("node"), F.col("id").alias("scc"))
    least = _circles(*_arrays(pairs, nodes, "a", "b"))
    many = np.unique(least[least != np.arange(nodes)]).size
    given = names.sparkSession.sparkContext.broadcast(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column("k").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("k"), pa.array(given.value[k], pa.int64())], names=["node", "k", "s"])

    found = names.mapInArrow(run, "node string, k long, s long")
    inner = found.where("k <> s")
    heads = names.select(F.col("k").alias("s"), F.col("id").alias("scc"))
    if many <= NAMED:
        heads = F.broadcast(heads.join(F.broadcast(inner.select("s").distinct()), "s", "left_semi"))
    return found.where("k = s").select("node", F.col("node").alias("scc")).unionByName(inner.join(heads, "s").select("node", "scc"))


def strong_components(edges: DataFrame, array_edges: int = ARRAY_EDGES) -> DataFrame:
    """node, scc: nodes of edges (from, to) that reach each other; the smallest id names each.

    Up to ``array_edges`` edges, by a checked count, the driver finds them over arrays of numbers, in one pass.  Beyond that: rounds over written tables until no edge is left: nodes without an edge in or out are components of their own and go; the
    largest id spreads forward along edges until nothing changes; from the nodes that kept their own id, what has the same id is
    walked backward, and that is a component.  All components whose largest node leads one colour are found in one round.
    """
    edges = edges.select("from", "to").where(F.col("from").isNotNull() & F.col("to").isNotNull()).distinct()
    names, pairs = _numbered(edges)
    if pairs.count() <= array_edges:
        return _grouped(names, pairs)
    edges = edges.select(F.col("from").alias("a"), F.col("to").alias("b"))
    nodes = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), "nodes")
    left = written(edges.where("a <> b").distinct(), "left")
    found: list[DataFrame] = []
    while not left.isEmpty():
        while True:  # trim
            both = left.select(F.col("a").alias("node")).distinct().intersect(left.select("b").distinct())
            kept = left.join(both.withColumnRenamed("node", "a"), "a", "left_semi").join(both.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b")
            kept = written(kept, "trimmed")
            done, left = kept.count() == left.count(), kept
            if done:
                break
        if left.isEmpty():
            break
        colour = written(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("c", F.col("node")), "colour")
        while True:  # forward
            sent = left.join(colour.select(F.col("node").alias("a"), F.col("c").alias("s")), "a").groupBy(F.col("b").alias("node")).agg(F.max("s").alias("s"))
            new = written(colour.join(sent, "node", "left").select("node", F.greatest("c", F.coalesce("s", "c")).alias("c"), (F.col("s") > F.col("c")).alias("moved")), "colour")
            colour, moved = new.select("node", "c"), not new.where("moved").isEmpty()
            if not moved:
                break
        inner = left.join(colour.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(colour.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b").where("ca = cb").select("a", "b")
        inner = written(inner, "inner")
        reached = [written(colour.where("node = c").select("node", "c"), "reached")]
        while True:  # backward
            new = inner.join(reached[-1].select(F.col("node").alias("b"), "c"), "b").select(F.col("a").alias("node"), "c").distinct()
            new = written(new.join(_all(reached), ["node", "c"], "left_anti"), "reached")
            if new.isEmpty():
                break
            reached.append(new)
        ready = written(_all(reached), "found")
        found.append(ready)
        gone = ready.select("node")
        left = left.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b")
        left = written(left, "left")
    if not found:
        return nodes.select("node", F.col("node").alias("scc"))
    groups = _all(found)
    names = groups.groupBy("c").agg(F.min("node").alias("scc"))
    named = groups.join(names, "c").select("node", "scc")
    return nodes.join(named, "node", "left").select("node", F.coalesce("scc", "node").alias("scc"))

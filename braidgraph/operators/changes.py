"""File changes: differences of listings, folding of commits, and applying changes to a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..model import DIRECTORY, EXTERNAL, FILE, MODULE, RepoGraph
from ..plans.durable import written
from . import graph as G

#: Pairs of files that one task makes.
PAIRS_A_TASK = 1_000_000


def tracked(path: Column) -> Column:
    return C.extension(path).isin(*C.TRACKED)


def tree_diff(before: DataFrame, after: DataFrame, only_tracked: bool = True) -> DataFrame:
    """path, type (ADD, MODIFY, DELETE) between two listings (path, oid)."""
    a, b = before.select("path", F.col("oid").alias("a")), after.select("path", F.col("oid").alias("b"))
    kind = F.when(F.col("a").isNull(), "ADD").when(F.col("b").isNull(), "DELETE").when(F.col("a") != F.col("b"), "MODIFY")
    out = a.join(b, "path", "full_outer").select("path", kind.alias("type")).where("type is not null")
    return out.where(tracked(F.col("path"))) if only_tracked else out


def coalesced(changes: DataFrame, newest_first: bool = False) -> DataFrame:
    """path, type of changes (path, seq, type) folded in order: ADD then DELETE leaves nothing, DELETE then ADD is MODIFY, else
    the last one counts.  ``newest_first`` folds from the end, as walking a log backwards does.

    No list is built, so a path may have any number of changes: the fold is known from the last run in which ADD and DELETE
    alternate.  Such a run that begins with ADD goes ADD, nothing, ADD ...; one that begins with DELETE goes DELETE, MODIFY,
    DELETE ...; a MODIFY, or a change of the same type as the one before, begins a run of its own.
    """
    key = [F.desc("seq"), F.desc("type")] if newest_first else ["seq", "type"]
    w = Window.partitionBy("path").orderBy(*key)
    kind, before = F.col("type"), F.col("before")
    rows = changes.select("path", "seq", "type", F.lag("type").over(w).alias("before"), F.lead("type").over(w).alias("after"))
    breaks = F.when(before.isNull() | (kind == "MODIFY") | (before == "MODIFY") | (kind == before), 1).otherwise(0)
    rows = rows.withColumn("run", F.sum(breaks).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy("path", "run").orderBy(*key)
    rows = rows.withColumn("odd", F.row_number().over(inner) % 2 == 1).withColumn("head", F.first("type").over(inner)).where("after is null")
    state = F.when(F.col("head") == "MODIFY", "MODIFY").when(F.col("head") == "ADD", F.when(F.col("odd"), "ADD")).otherwise(F.when(F.col("odd"), "DELETE").otherwise("MODIFY"))
    return rows.select("path", state.alias("type")).where("type is not null")


def removed(graph: RepoGraph, changes: DataFrame) -> RepoGraph:
    """The graph without the files that were deleted or modified, their symbols and edges."""
    gone = changes.where(F.col("type").isin("DELETE", "MODIFY")).select("path")
    return G.remove_files(graph, gone)


def inserted(graph: RepoGraph, fresh: RepoGraph, changes: DataFrame, new_parents: bool = True) -> RepoGraph:
    """Add what a fresh analysis holds for added and modified files; edges that exist (from, to, type) are not added again.

    new_parents: folders and packages that the graph lacks come too.
    """
    paths = changes.where(F.col("type").isin("ADD", "MODIFY")).select("path").distinct()
    touched = fresh.of_type(FILE, MODULE).join(paths, "path", "left_semi")
    ids = touched.select("id")
    edges = fresh.edges.join(ids.withColumnRenamed("id", "from"), "from", "left_semi").unionByName(fresh.edges.join(ids.withColumnRenamed("id", "to"), "to", "left_semi")).select(*fresh.edges.columns).dropDuplicates(["from", "to", "type"])
    edges = edges.join(graph.edges.select("from", "to", "type").distinct(), ["from", "to", "type"], "left_anti").select(*graph.edges.columns)
    out = G.upsert_nodes(graph, touched.select(*graph.nodes.columns))
    if new_parents:
        ends = edges.select(F.col("from").alias("id")).unionByName(edges.select(F.col("to").alias("id"))).distinct()
        needed = fresh.of_type(EXTERNAL).join(ends, "id", "left_semi")
        above = paths.select(F.explode(C.ancestors(F.col("path"))).alias("path")).distinct()
        needed = needed.unionByName(fresh.of_type(DIRECTORY).join(above, "path", "left_semi").select(*fresh.nodes.columns))
        fresh_rows = needed.select(*graph.nodes.columns).dropDuplicates(["id"]).join(out.nodes.select("id"), "id", "left_anti")
        out = out.with_(nodes=out.nodes.unionByName(fresh_rows.select(*graph.nodes.columns)))
    return G.add_edges(out, edges)


def applied(graph: RepoGraph, fresh: RepoGraph, changes: DataFrame, new_parents: bool = True) -> RepoGraph:
    """The graph after changes (path, type)."""
    return inserted(removed(graph, changes), fresh, changes, new_parents)


def delta(before: RepoGraph, after: RepoGraph) -> DataFrame:
    """id, change (ADDED, REMOVED, CHANGED) of nodes between two graphs."""
    a = before.nodes.select("id", F.to_json(F.struct("name", "path", "metadata")).alias("a"))
    b = after.nodes.select("id", F.to_json(F.struct("name", "path", "metadata")).alias("b"))
    kind = F.when(F.col("a").isNull(), "ADDED").when(F.col("b").isNull(), "REMOVED").when(F.col("a") != F.col("b"), "CHANGED")
    return a.join(b, "id", "full_outer").select("id", kind.alias("change")).where("change is not null")


def co_changes(changes: DataFrame, most_files: int | None = None, block: int = 1000) -> DataFrame:
    """a, b, n: files that change in the same commits (commit, path); ``most_files`` leaves out larger commits.

    The files of a commit fall into blocks of about ``block``, and each pair of blocks is joined on its own, so the pairs of
    a large commit are spread over tasks.  They are counted there before they are shuffled.  The tasks are as many as the pairs,
    which are counted first from the sizes of the commits, ask for.
    """
    rows = written(changes.select("commit", "path").distinct(), "changes")
    sizes = rows.groupBy("commit").agg(F.count("*").alias("files"))
    if most_files is not None:
        sizes = sizes.where(F.col("files") <= most_files)
    made = sizes.agg(F.sum(F.col("files") * (F.col("files") - 1) / 2)).first()[0] or 0
    tasks = max(1, -(-int(made) // PAIRS_A_TASK))
    rows = rows.join(sizes.select("commit", F.ceil(F.col("files") / block).alias("blocks")), "commit")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("path"), F.col("blocks"))).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    rows = rows.select("commit", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "path", "own")
    rows = rows.repartition(tasks, "commit", "low", "high")
    pairs = rows.withColumnRenamed("path", "a").withColumnRenamed("own", "x").join(rows.withColumnRenamed("path", "b").withColumnRenamed("own", "y"), ["commit", "low", "high"])
    pairs = pairs.where("a < b and least(x, y) = low and greatest(x, y) = high")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))

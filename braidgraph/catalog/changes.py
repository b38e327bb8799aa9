"""File changes: batch and stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import project
from ..operators import changes as X
from ..operators import graph as G
from ..plans.durable import shared_dir
from ..streaming import changes as stream
from .files import flagship_graph
from .sql import GRAPH


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two listings of orders as files."""
    k = F.col("o_orderkey")
    path = F.concat(F.lit("src/o"), k, F.when(k % 9 == 0, ".md").otherwise(".ts")).alias("path")
    orders = project.table(spark, sf_dir, "orders")
    oid = (F.col("o_totalprice") * 100).cast("long")
    return orders.where(k % 10 != 0).select(path, oid.alias("oid")), orders.where(k % 10 != 1).select(path, (oid + F.when(k % 7 == 0, 1).otherwise(0)).alias("oid"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as file changes of users."""
    kind = F.when(F.col("event_type") == "signup", "ADD").when(F.col("event_type") == "error", "DELETE").otherwise("MODIFY")
    return project.table(spark, sf_dir, "events").select(F.concat(F.lit("src/u"), "user_id", F.lit(".ts")).alias("path"), F.col("event_id").alias("seq"), kind.alias("type"), F.col("ts").alias("at"))


def apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids after files were deleted, modified and added again from a fresh graph."""
    graph = flagship_graph(spark, sf_dir)
    files = graph.of_type("FILE")
    old = G.remove_files(graph, files.where("node_seq % 10 = 4").select("path"))
    kind = F.when(F.col("node_seq") % 10 == 4, "ADD").when(F.col("node_seq") % 10 == 5, "DELETE").when(F.col("node_seq") % 10 == 6, "MODIFY")
    changes = files.select("path", kind.alias("type")).where("type is not null")
    return X.applied(old, graph, changes).nodes.select("id", "type")


def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of one batch of a file stream."""
    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events(spark, sf_dir).write.parquet(f"{where}/in")
    query = stream.apply_stream(stream.change_stream(spark, f"{where}/in"), lambda rows, batch: rows.write.mode("overwrite").parquet(f"{where}/out/batch={batch}"), f"{where}/check")
    query.awaitTermination()
    return spark.read.parquet(f"{where}/out").select("path", "type")


def stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed counts over the same rows at rest: the plan is the stream's."""
    return stream.change_rates(events(spark, sf_dir)).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "type", "n")


def co_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = project.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.concat(F.lit("p"), "l_partkey").alias("path"))
    return X.co_changes(lines)


QUERIES = {
    "tree_diff": lambda s, d: X.tree_diff(*snapshots(s, d)),
    "coalesce_changes": lambda s, d: X.coalesced(events(s, d)),
    "coalesce_changes_newest_first": lambda s, d: X.coalesced(events(s, d), newest_first=True),
    "apply_changes": apply_changes,
    "co_changes": co_changes,
    "change_rates": stream_rates,
    "stream_changes": stream_changes,
}
_EVENTS = "ev AS (SELECT 'src/u' || user_id || '.ts' AS path, event_id AS seq, CASE event_type WHEN 'signup' THEN 'ADD' WHEN 'error' THEN 'DELETE' ELSE 'MODIFY' END AS type, ts FROM events)"


def _fold(order: str) -> str:
    return f"""WITH {_EVENTS} SELECT path, type FROM (SELECT path, list_reduce(list_concat([''], list(type ORDER BY seq {order}, type {order})), lambda a, x: CASE WHEN a = 'ADD' AND x = 'DELETE' THEN '' WHEN a = 'DELETE' AND x = 'ADD' THEN 'MODIFY' ELSE x END) AS type FROM ev GROUP BY path) WHERE type <> ''"""


ORACLES = {
    "tree_diff": """WITH o AS (SELECT o_orderkey AS k, 'src/o' || o_orderkey || CASE WHEN o_orderkey % 9 = 0 THEN '.md' ELSE '.ts' END AS path FROM orders)
    SELECT path, CASE WHEN k % 10 = 0 THEN 'ADD' WHEN k % 10 = 1 THEN 'DELETE' ELSE 'MODIFY' END AS type FROM o WHERE path LIKE '%.ts' AND (k % 10 IN (0, 1) OR k % 7 = 0)""",
    "coalesce_changes": _fold("ASC"),
    "coalesce_changes_newest_first": _fold("DESC"),
    "apply_changes": GRAPH
    + """, keyed AS (SELECT n.id, n.type, f.k FROM nodes n LEFT JOIN files f ON n.path = f.path AND n.type IN ('FILE', 'MODULE')) SELECT id, type FROM keyed WHERE k IS NULL OR k % 10 <> 5""",
    "co_changes": """WITH l AS (SELECT DISTINCT l_orderkey AS c, 'p' || l_partkey AS p FROM lineitem)
    SELECT x.p AS a, y.p AS b, count(*) AS n FROM l x JOIN l y ON x.c = y.c AND x.p < y.p GROUP BY 1, 2""",
    "change_rates": f"""WITH {_EVENTS} SELECT strftime(time_bucket(INTERVAL 10 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS start, type, count(*) AS n FROM ev GROUP BY 1, 2""",
    "stream_changes": _fold("ASC"),
}

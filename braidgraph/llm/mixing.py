"""Operator 9: mixing sources to target weights by Sainte-Lague apportionment.

1. *Targets.*  Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share 150 % of
   all words; a target stops at twice its source's size and the excess is shared again by weight.
2. *Blocks for sources.*  The mix is a whole number of blocks of ``block`` words; the sources get
   them by highest quotients (target / 1, / 3, / 5 ...), so every source has an integer quota.
3. *Blocks for shards.*  A source is cut into shards by a hash of the doc_id, in proportion to its
   documents, so a source with a third of all rows is many shards.  Its quota goes to at most ``GROUPS`` groups of
   neighbouring shards, and each group's to its shards, by highest quotients of their sizes, at most twice their blocks.
   Each group is apportioned in a task of its own.
4. *Seeded selection.*  In a shard the documents lie one after another in seeded order, cut into
   blocks.  A quota of q over n blocks takes all blocks q // n times and one run of q % n blocks from a
   seeded start; documents stay whole but for those at the two ends of the run.

Only a row for each source comes to the driver.  Texts are shuffled once by ``mixed_documents`` and never by ``mixture``,
whose window runs within shards over (doc_id, size).

Cases: null text has size 0 and takes nothing.  A null source is a source of its own, last in order.
Repeated rows are rows of their own.  Rows with a null doc_id are dealt by a hash of their text.  Empty table: no row; if
all sizes are 0, targets are 0.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SEED, WORD, discard, pieces, table, written

BLOCK, SHARD_DOCS, GROUPS = 16, 512, 1000


def targets(sizes: list[int], share: float = 1.5, cap: float = 2.0, weights: tuple = (5, 2, 1)) -> list[float]:
    """Words that each source, in order, gives to the mix."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    total, fixed = share * sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left, weight = total - sum(fixed.values()), sum(w[i] for i in free)
        over = [i for i in free if left * w[i] / weight > cap * sizes[i]]
        if not over:
            return [fixed[i] if i in fixed else left * w[i] / weight for i in range(len(sizes))]
        fixed |= {i: cap * sizes[i] for i in over}


def sainte_lague(seats: int, votes: list[float], most: list[int] | None = None) -> list[int]:
    """Seats by the highest quotients votes / (2 s + 1); ties go to the first; at most ``most`` each.

    A search for the divisor over which no more than ``seats`` quotients lie gives nearly all seats at
    once, and the next highest quotients the rest, so the work follows the number of parties.
    """
    n = len(votes)
    v = np.asarray(votes, float)
    top = np.asarray(most if most is not None else [seats] * n, np.int64)
    seats, total = min(seats, int(top[v > 0].sum())), v.sum()
    if total <= 0 or seats <= 0:
        return [0] * n
    # seats whose quotient is over the divisor d belong to the result if they number no more than seats
    low, high = 0.0, 2.0 * float(v.max())
    held = lambda d: np.minimum(top, np.maximum(0, (v / d + 1) // 2)).astype(np.int64)
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high) or mid < 1e-9 * float(v.max()) / max(seats, 1):
            break
        if held(mid).sum() > seats:
            low = mid
        else:
            high = mid
    out = held(high)
    queue = [(-votes[i] / (2 * int(out[i]) + 1), i) for i in np.flatnonzero((v > 0) & (out < top)).tolist()]
    heapq.heapify(queue)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(queue)
        out[i] += 1
        if out[i] < top[i]:
            heapq.heappush(queue, (-votes[i] / (2 * int(out[i]) + 1), i))
    return out.tolist()


def plan(sources: list[tuple], block: int = BLOCK) -> list[tuple]:
    """(source, size, target, quota) in order, of (source, words) rows."""
    order = sorted(sources, key=lambda s: (s[0] is None, (s[0] or "").encode("utf-32-be", "surrogatepass")))
    aims = targets([w for _, w in order])
    quotas = sainte_lague(round(sum(aims) / block), aims)
    return [(s, w, aim, quota) for (s, w), aim, quota in zip(order, aims, quotas, strict=True)]


def _apportioned(by: str):
    """Deals the quota of a group of rows among them, in the order of ``by``."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(by)
        given = sainte_lague(int(rows["given"].iloc[0]), [float(w) for w in rows["words"]], [2 * int(b) for b in rows["blocks"]])
        return rows.assign(quota=given)[["src", by, "words", "blocks", "quota"]]

    return run


def shard_plan(shards: DataFrame) -> DataFrame:
    """src, shard, blocks, quota of shards (src, shard, words, blocks, given: the source's quota, per: shards in a group)."""
    shards = shards.withColumn("grp", F.floor(F.col("shard") / F.col("per")).cast("int"))
    groups = shards.groupBy("src", "grp").agg(F.sum("words").alias("words"), F.sum("blocks").alias("blocks"), F.first("given").alias("given"))
    groups = groups.groupBy("src").applyInPandas(_apportioned("grp"), "src string, grp int, words long, blocks long, quota long")
    dealt = shards.drop("given", "per").join(groups.select("src", "grp", F.col("quota").alias("given")), ["src", "grp"])
    return dealt.groupBy("src", "grp").applyInPandas(_apportioned("shard"), "src string, shard int, words long, blocks long, quota long").select("src", "shard", "blocks", "quota")


def placed(docs: DataFrame, block: int = BLOCK, shard_docs: int = SHARD_DOCS, seed: int = SEED, carry: tuple = ()) -> DataFrame:
    """Each row, with its columns ``carry``, with its source's and shard's plan: doc_id, source, size, source_size, target, the
    number of full passes, and the words [a0, a1) and [b0, b1) of the row that the run takes."""
    spark = docs.sparkSession
    size = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORD))).cast("long")
    doc_id, source = F.col("doc_id").cast("long"), F.col("source").cast("string")
    name = F.coalesce(doc_id, F.xxhash64("text", source))
    src = F.coalesce(F.concat(F.lit("="), source), F.lit(""))
    named = [doc_id.alias("doc_id"), source.alias("source"), size.alias("size"), src.alias("src"), name.alias("name")]
    light = written(docs.select(*named), "sizes")
    found = light.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("words")).collect()
    many = {r["source"]: max(1, -(-r["n"] // shard_docs)) for r in found}
    rows_ = [("" if s is None else f"={s}", many[s], -(-many[s] // GROUPS), w, aim, quota) for s, w, aim, quota in plan([(r["source"], r["words"]) for r in found], block)]
    sources = spark.createDataFrame(rows_, "src string, shards int, per int, source_size long, target double, given long")

    def sharded(rows: DataFrame) -> DataFrame:
        return rows.join(sources, "src").withColumn("shard", F.pmod(F.xxhash64("name", F.lit(seed)), F.col("shards")).cast("int"))

    words = sharded(light).groupBy("src", "shard").agg(F.sum("size").alias("words"), F.first("given").alias("given"), F.first("per").alias("per"))
    plans = written(shard_plan(words.withColumn("blocks", F.ceil(F.col("words") / block).cast("long"))), "plan")
    rows = light
    if carry:
        rows = docs.select(*named, *(F.col(c).alias(f"_{c}") for c in carry))
        discard(light)
    joined = sharded(rows).join(plans, ["src", "shard"])
    w = Window.partitionBy("src", "shard").orderBy(F.xxhash64("name", F.lit(seed + 1)), "name", "size").rowsBetween(Window.unboundedPreceding, 0)
    at = joined.withColumn("end", F.sum("size").over(w)).withColumn("begin", F.col("end") - F.col("size"))
    whole = F.greatest("blocks", F.lit(1))
    at = at.withColumn("passes", F.floor(F.col("quota") / whole)).withColumn("run", F.col("quota") % whole)
    at = at.withColumn("from", F.pmod(F.xxhash64("src", "shard", F.lit(seed + 2)), whole))
    low, high, lap = F.col("from") * block, (F.col("from") + F.col("run")) * block, F.col("blocks") * block

    def cut(x: Column, base: Column) -> Column:
        return F.greatest(F.lit(0), F.least(x - base, F.col("size")))

    at = at.withColumn("a0", cut(low, F.col("begin"))).withColumn("a1", cut(F.least(high, lap), F.col("begin")))
    at = at.withColumn("b0", F.lit(0).cast("long")).withColumn("b1", cut(F.greatest(high - lap, F.lit(0)), F.col("begin")))
    return at.select("doc_id", "source", "size", "source_size", "target", "passes", "a0", "a1", "b0", "b1", *(f"_{c}" for c in carry))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row for each row of ``docs``."""
    taken = F.col("passes") * F.col("size") + F.greatest(F.col("a1") - F.col("a0"), F.lit(0)) + F.col("b1") - F.col("b0")
    return placed(docs, **options).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The words [i, j) of each span with the white space between them, joined by a new line."""
    at = [m.span() for m in re.finditer(WORD, text)]
    return "\n".join(text[at[i][0] : at[j - 1][1]] for i, j in spans if j > i)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself with the columns of ``docs``: a row for each full pass over a document and one
    with the words that the run takes; documents of which nothing is taken go."""
    rest = [c for c in docs.columns if c not in ("doc_id", "source")]
    rows = placed(docs, carry=tuple(rest), **options)
    plan = ["passes", "size", "a0", "a1", "b1"]
    text, chars = rest.index("text"), next((i for i, c in enumerate(rest) if c == "n_chars"), None)
    kept = rows.select("doc_id", "source", *(F.col(f"_{c}").alias(f"c{i}") for i, c in enumerate(rest)), *(F.col(c).cast("long").alias(f"p_{c}") for c in plan))

    def run(batches):
        for part in (p for batch in batches for p in pieces(batch, f"c{text}")):
            passes, size, a0, a1, b1 = (part.column(f"p_{c}").to_numpy(zero_copy_only=False) for c in plan)
            some = (a1 > a0) | (b1 > 0)
            full = some & (a0 == 0) & (a1 == size)
            times = np.where(size > 0, passes, 0) + full
            own = part.select([c for c in part.schema.names if not c.startswith("p_")])
            whole = own.take(pa.array(np.repeat(np.arange(part.num_rows), times)))
            if whole.num_rows:
                yield whole
            at = np.flatnonzero(some & ~full)
            if not len(at):
                continue
            cut = own.take(pa.array(at))
            texts = [_cut(t, [(0, int(b1[i])), (int(a0[i]), int(a1[i]))]) for t, i in zip(cut.column(f"c{text}").to_pylist(), at.tolist(), strict=True)]
            cut = cut.set_column(cut.schema.get_field_index(f"c{text}"), f"c{text}", pa.array(texts, cut.schema.field(f"c{text}").type))
            if chars is not None:
                old = cut.schema.field(f"c{chars}").type
                cut = cut.set_column(cut.schema.get_field_index(f"c{chars}"), f"c{chars}", pa.array([len(t) for t in texts], pa.int64()).cast(old))
            yield cut

    schema = T.StructType([f for f in kept.schema.fields if not f.name.startswith("p_")])
    out = kept.mapInArrow(run, schema)
    of = {"doc_id": "doc_id", "source": "source"} | {c: f"c{i}" for i, c in enumerate(rest)}
    return out.select([F.col(of[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the mix of all documents."""
    return mixture(table(spark, sf_dir, "documents"))

"""Operator 2: exact dedup with a heavy-hitter split.

Texts are equal when they agree after every run of ASCII white space became one space; their
SHA-256 stands for them.

1. *Misra-Gries.*  Every partition keeps at most ``k`` counters over its digests; the summaries
   (at most ``k`` rows a partition) are added up and the ``k`` largest stay.  A digest with more than
   about ``rows / k`` copies keeps a count of at least the surplus, so it is among them; where no other
   digest is frequent, some with a few copies are too.  Whatever is missed takes the ordinary way.
2. *Verified winners.*  The true count and smallest doc_id of those candidates come from one pass
   over the digests (combined on the map side, at most ``k`` keys); candidates that are not frequent
   are let go.  The winners, at most ``k`` rows whatever the input, are broadcast.
3. *Map-side removal.*  Rows with a frequent digest take their winner from the broadcast and never
   meet in a shuffle.
4. The other digests, each with few copies, are grouped and joined by ordinary shuffles of
   (doc_id, digest) rows; texts are never shuffled.

Cases: null text counts as empty, and empty texts are one group.  Repeated rows (the same doc_id and
text) all carry the same verdict and count in ``group_size``; ``survivors()`` leaves one of them.
A null doc_id stays only if its whole group has none: nulls are larger than any id.  Empty table: no
row.  Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, table, unused, written

#: Counters of a Misra-Gries summary, and so the most rows that are broadcast.
COUNTERS = 1024


def misra_gries(digests: Iterator[str], k: int) -> dict[str, int]:
    """At most k counters; a digest with more than n / (k + 1) of n occurrences is among them,
    its count too low by n / (k + 1) at most."""
    counters: dict[str, int] = {}
    for d in digests:
        if d in counters:
            counters[d] += 1
        elif len(counters) < k:
            counters[d] = 1
        else:
            counters = {x: n - 1 for x, n in counters.items() if n > 1}
    return counters


def _summaries(k: int):
    def run(batches):
        def values():
            for batch in batches:
                yield from batch.column("text_sha256").to_pylist()

        found = misra_gries(values(), k)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["text_sha256", "low"])

    return run


def normal_digest() -> Column:
    """SHA-256 of a text with every run of white space as one space."""
    return F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE + "+", " "), 256)


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256 of every row, as a written table."""
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal_digest().alias("text_sha256")), "digest")


def exact_duplicates(docs: DataFrame, k: int = COUNTERS, least: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of ``docs``.

    least: copies from which a digest counts as frequent; by default what Misra-Gries guarantees to
    find, one row in ``k + 1``, and never under 16.
    """
    rows = digested(docs)
    first = F.min(F.coalesce("doc_id", F.lit(2**63 - 1))).alias("first")
    candidates = rows.mapInArrow(_summaries(k), "text_sha256 string, low long").groupBy("text_sha256").agg(F.sum("low").alias("low"))
    candidates = candidates.orderBy(F.desc("low"), "text_sha256").limit(k).select("text_sha256")
    if least is None:
        least = max(16, rows.count() // (k + 1))
    winners = rows.join(F.broadcast(candidates), "text_sha256").groupBy("text_sha256").agg(first, F.count("*").alias("size"))
    winners = written(winners.where(F.col("size") >= least), "winners")
    marked = rows.join(F.broadcast(winners), "text_sha256", "left")
    frequent = marked.where("size is not null")
    rest = marked.where("size is null").drop("first", "size")
    groups = rest.groupBy("text_sha256").agg(first, F.count("*").alias("size"))
    whole = frequent.unionByName(rest.join(groups, "text_sha256"))
    keep = F.when(F.col("first") < 2**63 - 1, F.col("first"))
    return whole.select("doc_id", keep.alias("keep_id"), F.col("size").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def survivors(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, one of each set of repeated rows.  One join moves the texts, to the rows that go or
    are repeated; only repeated rows move again."""
    digest, of, sha, fate = (unused(docs, x) for x in ("__digest", "__id", "__sha", "__fate"))
    rows = verdicts.groupBy(F.col("doc_id").alias(of), F.col("text_sha256").alias(sha)).agg(F.bool_or("kept").alias("stays"), F.count("*").alias("n"))
    named = rows.where("not stays or n > 1").select(of, sha, F.when(F.col("stays"), "again").otherwise("gone").alias(fate))
    own = docs.withColumn(digest, normal_digest())
    told = own.join(named, F.col(of).eqNullSafe(F.col("doc_id").cast("long")) & (F.col(digest) == F.col(sha)), "left").drop(of, sha)
    once, twice = told.where(F.col(fate).isNull()), told.where(F.col(fate) == "again")
    return once.unionByName(twice.dropDuplicates(["doc_id", digest])).drop(digest, fate)


def op2_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: verdicts on all documents."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

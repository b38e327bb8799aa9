"""Operator 1: near-duplicate groups by min-max hashing.

Every document is its set of distinct word shingles; two documents are linked when
``100 * |A & B| >= 80 * |A | B|``, and the result gives each document its connected component.

1. *Min-max signatures.*  Each random permutation of the shingle hashes gives two signature
   values, its minimum and its maximum, so ``bands * rows / 2`` hash evaluations a shingle fill
   ``bands`` bands of ``rows`` values.  With the defaults (48 bands of 6) a pair at the threshold
   is missed by all bands with a chance of 5e-7, and less above it.
2. *Collapse.*  Equal sets (a 128-bit fingerprint and the size) become one representative, the
   smallest doc_id, by an aggregation that combines on the map side.
3. *Stars.*  A bucket emits one pair for each member: itself and the bucket's smallest member.
   No bucket emits all its pairs.  Pairs are confirmed on full sets.
4. *Completion.*  Where a bucket holds several components even then, the members outside its largest component are compared
   with all others in blocks of at most ``block`` rows inside tasks (32-bit sets, an upper bound of the overlap), and only
   pairs of different components that may reach the threshold come out, for the full check.  Pairs inside a component
   tell nothing new, and every other pair of a bucket is covered, so no cap drops a link.  Work and copies follow
   (members outside the largest component) x (members of the bucket): in proportion to a bucket that is one group.
5. *Components* by alternating large-star and small-star joins.

Hot groups: keys that hold over one in ``HEAVY`` rows, ``HEAVY`` of them at most by arithmetic, are broadcast with what
belongs to them instead of meeting in a shuffle; the set of a head of many pairs is dealt to several tasks.

Cases: null or empty text and text without words: no shingle, component of its own.  Repeated
doc_ids are one node (their texts are linked).  A row with a null doc_id comes back with a null
component and ``kept`` null.  Empty table: no row.  Other columns of the input are ignored, so
their names can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEED, connected, discard, heavy_join, mixed, pieces, table, text_bytes, unused, written
from .shingles import shingle_sets

BANDS, ROWS, BLOCK = 48, 6, 512
#: Keys with over 1 / HEAVY of all rows are joined by broadcast; pairs of one head that meet in a task.
HEAVY, FAN = 1024, 2000


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Keys (len(sets), bands) of min-max signatures; zeros for empty sets."""
    perms = bands * rows // 2
    rng = np.random.default_rng(SEED + 1)
    a = rng.integers(1, 2**63, (perms, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, (perms, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sig = np.zeros((len(sets), perms, 2), dtype=np.uint64)
    for i, s in enumerate(sets):
        low, high = None, None
        for at in range(0, len(s), 4096):
            h = s[None, at : at + 4096] * a
            h += b
            lo, hi = h.min(axis=1), h.max(axis=1)
            low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
        if low is not None:
            sig[i, :, 0], sig[i, :, 1] = low, high
    sig = sig.reshape(len(sets), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sets), bands)).copy()
    for j in range(rows):
        key = mixed(key + sig[:, :, j])
    return key


def _signatures(k: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                sets = shingle_sets(text_bytes(part.column("text")), k)
                keys = _signed(band_keys(sets, bands, rows))
                n = np.array([len(s) for s in sets], dtype=np.int64)
                f1 = np.array([mixed(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                f2 = np.array([mixed(s ^ np.uint64(0x5BD1E995A5A5A5A5)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                flat = pa.array(keys[n > 0].ravel())
                offsets = np.concatenate([[0], np.cumsum((n > 0) * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.array(_signed(f1)), pa.array(_signed(f2)), pa.ListArray.from_arrays(pa.array(offsets), flat)],
                    names=["doc_id", "n", "f1", "f2", "bands"],
                )

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                sets = shingle_sets(text_bytes(part.column("text")), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([np.unique(s.astype(np.uint32)).tobytes() for s in sets], pa.binary())],
                    names=["doc_id", "size", "full", "short"],
                )

    return run


def _confirmed(percent: int):
    def run(batches):
        for batch in (part for whole in batches for part in pieces(whole, "a", 4 << 20)):
            keep = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(mask), batch.column("v").filter(mask)], names=["u", "v"])

    return run


def _possible(ids, comp, side, size, short, percent, cross):
    """Index pairs of different components whose overlap may reach the threshold."""
    n = len(ids)
    rows = [np.frombuffer(s, np.uint32) for s in short]
    lens = np.array([len(r) for r in rows])
    of = np.repeat(np.arange(n), lens)
    _, token, df = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    shared = df[token] > 1
    of, token = of[shared], token[shared]
    both = np.zeros((n, n), dtype=np.float32)
    if len(token):
        _, token = np.unique(token, return_inverse=True)
        order = np.argsort(token, kind="stable")
        of, token = of[order], token[order]
        width = max(1, (4 << 20) // max(n, 1))
        for at in range(0, int(token[-1]) + 1, width):
            lo, hi = np.searchsorted(token, [at, at + width])
            m = np.zeros((n, min(width, int(token[-1]) + 1 - at)), dtype=np.float32)
            m[of[lo:hi], token[lo:hi] - at] = 1
            both += m @ m.T
    lost = size - lens
    both += np.maximum(lost[:, None], lost[None, :])
    ok = 100 * both >= percent * (size[:, None] + size[None, :] - both) - 0.5
    ok &= comp[:, None] != comp[None, :]
    if cross:
        ok &= side[:, None] != side[None, :]
    x, y = np.nonzero(np.triu(ok, 1))
    return ids[x], ids[y]


def _completion(percent: int):
    def run(batches):
        held, key = [], None

        def flush():
            if len(held) < 2:
                return None
            g = list(zip(*held, strict=True))
            x, y = _possible(np.array(g[0]), np.array(g[1]), np.array(g[2]), np.array(g[3]), g[4], percent, key[1] != key[2])
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["u", "v"])

        for batch in batches:
            c = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            for i, now in enumerate(zip(c["key"], c["bi"], c["bj"], strict=True)):
                if now != key:
                    if (out := flush()) is not None:
                        yield out
                    held, key = [], now
                held.append((c["doc"][i], c["comp"][i], c["side"][i], c["size"][i], c["short"][i]))
        if (out := flush()) is not None:
            yield out

    return run


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that are links; the set of a u with many pairs goes to a task for each ``FAN`` of them."""
    counts = pairs.groupBy("u").agg(F.count("*").alias("fan")).where(F.col("fan") > FAN)
    total = pairs.count()
    # over FAN and over 1 / HEAVY of all pairs each: at most HEAVY rows
    many = counts.where(F.col("fan") > total // HEAVY).select("u", F.ceil(F.col("fan") / FAN).cast("int").alias("tasks")).collect()
    many = F.broadcast(pairs.sparkSession.createDataFrame([tuple(r) for r in many], "u long, tasks int"))
    a = sets.select(F.col("doc_id").alias("u"), F.col("full").alias("a")).join(many, "u", "left")
    a = a.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("tasks", F.lit(1)) - 1))).drop("tasks")
    salted = pairs.join(many, "u", "left").withColumn("salt", F.pmod(F.xxhash64("v"), F.coalesce("tasks", F.lit(1))).cast("int")).drop("tasks")
    b = sets.select(F.col("doc_id").alias("v"), F.col("full").alias("b"))
    return salted.join(a, ["u", "salt"]).join(b, "v").select("u", "v", "a", "b").mapInArrow(_confirmed(percent), "u long, v long")


def _open_members(bucket: DataFrame, comps: DataFrame) -> DataFrame:
    """key, doc, comp, core (the largest component of the bucket), how many members lie in and outside it: of all members of
    buckets with several components."""
    at = bucket.select("key", "doc").join(comps.withColumnRenamed("node", "doc"), "doc", "left")
    at = at.select("key", "doc", F.coalesce("component", "doc").alias("comp"))
    parts = at.groupBy("key", "comp").agg(F.count("*").alias("n"))
    cores = parts.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("c"), F.sum("n").alias("all"), F.count("*").alias("kinds")).where("kinds > 1")
    cores = written(cores.select("key", F.col("c.comp").alias("core"), F.col("c.n").alias("inside"), (F.col("all") - F.col("c.n")).alias("outside")), "cores")
    return heavy_join(at, cores, ["key"], F.col("inside") + F.col("outside"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(docs.mapInArrow(_signatures(k, bands, rows), "doc_id long, n long, f1 long, f2 long, bands array<long>"), "sig")
    light = signed.select("doc_id", "n", "f1", "f2")
    reps = written(light.where("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "reps")
    of = heavy_join(light, reps, ["f1", "f2", "n"], F.col("copies"), "left").drop("copies")
    chosen = signed.select("doc_id", "f1", "f2", "bands").join(reps.select(F.col("rep").alias("doc_id"), "f1", "f2", "n"), ["doc_id", "f1", "f2"])
    keyed = chosen.dropDuplicates(["doc_id", "f1", "f2"]).select(F.col("doc_id").alias("doc"), "n", F.explode("bands").alias("key"))
    heads = keyed.groupBy("key").agg(F.min(F.struct("doc", "n")).alias("head"), F.count("*").alias("members")).where("members > 1")
    heads = heads.select("key", "members", F.col("head.doc").alias("head"), F.col("head.n").alias("hn"))
    heads = written(heads, "heads")
    bucket = written(heavy_join(keyed, heads, ["key"], F.col("members")).drop("members"), "bucket")
    close = f"100 * least(n, hn) >= {percent} * greatest(n, hn)"
    stars = written(bucket.where(f"doc <> head and {close}").select(F.col("head").alias("u"), F.col("doc").alias("v")).distinct(), "stars")
    wanted = bucket.select(F.col("doc").alias("doc_id")).distinct()
    sets = docs.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    sets = written(sets.mapInArrow(_sets(k), "doc_id long, size long, full binary, short binary"), "sets")
    links = written(_verify(stars, sets, percent), "links")
    comps = connected(links)

    at = _open_members(bucket, comps)
    mine = F.col("comp") == F.col("core")
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    at = at.select("key", "doc", "comp", mine.alias("mine"), blocks("inside").alias("nc"), blocks("outside").alias("nr"))
    own = F.pmod(F.xxhash64("doc"), F.when(F.col("mine"), F.col("nc")).otherwise(F.col("nr"))).cast("int")
    # blocks outside the core are numbered from 0, those of the core from -1 down; a pair of blocks holds one outside at least
    at = at.withColumn("side", F.when(F.col("mine"), -1 - own).otherwise(own))
    outside, core = F.sequence(F.lit(0), F.col("nr") - 1), F.sequence(-F.col("nc"), F.lit(-1))
    at = at.withColumn("other", F.explode(F.when(F.col("mine"), outside).otherwise(F.concat(core, outside))))
    at = at.withColumn("bi", F.least("side", "other")).withColumn("bj", F.greatest("side", "other"))
    at = at.join(sets.select(F.col("doc_id").alias("doc"), "size", "short"), "doc").select("key", "bi", "bj", "doc", "comp", "side", "size", "short")
    rest = at.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj").mapInArrow(_completion(percent), "u long, v long").distinct()
    rest = _verify(written(rest, "rest"), sets, percent)

    named = of.where("n > 0 and doc_id is not null").select("doc_id", "rep").distinct()
    split = named.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("u")).where("u <> v").select("doc_id", "v")
    split = named.join(split, "doc_id").select(F.col("rep").alias("u"), "v")
    final = connected(links.union(rest).union(split))
    for done in (bucket, heads, stars, sets, links):
        discard(done)
    groups = reps.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", "n", "copies", "rep", "component")
    whole = heavy_join(light, groups, ["f1", "f2", "n"], F.col("copies"), "left")
    group = F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    whole = whole.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), group).alias("component_id"))
    return whole.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def survivors(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document stands for its group; rows without a doc_id stay."""
    of = unused(docs, "__id")
    gone = verdicts.where("not kept").select(F.col("doc_id").alias(of)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(of), "left_anti")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: 4-word shingles over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


ORACLE = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s FROM base),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM inter JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x AS a, x AS b FROM both_ways UNION SELECT reach.a, both_ways.y FROM reach JOIN both_ways ON reach.b = both_ways.x),
comp AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a)
SELECT base.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, base.doc_id) AS component_id, base.doc_id = coalesce(c, base.doc_id) AS kept
FROM base LEFT JOIN sizes USING (doc_id) LEFT JOIN comp USING (doc_id)
"""

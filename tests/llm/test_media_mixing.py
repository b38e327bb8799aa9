"""Operators 8 and 9, and the corpus pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from braidgraph.llm import media, mixing, queries


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 500, 7000])
def test_media_round_trip(spark, size):
    raw = random.Random(size).randbytes(size).decode("latin-1")
    rows = media.described(media.media(spark.createDataFrame([(1, raw)], "doc_id long, text string"))).collect()
    data = raw.encode()
    want = data + b"\0" * (-len(data) % 64 if data else 64)
    assert bytes(rows[0]["payload"]) == want and rows[0]["n_bytes"] == len(data) and rows[0]["error"] is None
    assert rows[0]["width"] % 8 == 0 and rows[0]["width"] * rows[0]["height"] >= len(want)
    assert bytes(rows[0]["media"])[:2] == b"\xff\xd8" and bytes(rows[0]["media"])[-2:] == b"\xff\xd9"


def test_media_files_that_are_none(spark):
    good = bytes(media.media(spark.createDataFrame([(1, "x" * 900)], "doc_id long, text string")).first()["media"])
    odd = [b"", b"\xff\xd8", good[:40], good[: len(good) // 2], b"PNG", good[:2] + b"\xff\xc2" + good[4:], None, random.Random(1).randbytes(400)]
    rows = media.described(spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "doc_id long, media binary")).collect()
    assert len(rows) == len(odd) and all(r["error"] for r in rows)


def test_media_query(spark, sf_dir):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in media.op8_media(spark, sf_dir).collect():
        d = docs[r["doc_id"]]
        want = d + b"\0" * (-len(d) % 64 if d else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(d), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))


def test_sainte_lague():
    def plain(seats, votes, most):
        out = [0] * len(votes)
        for _ in range(seats):
            best = [i for i in range(len(votes)) if out[i] < most[i] and votes[i] > 0]
            if not best:
                break
            out[max(best, key=lambda i: (Fraction(votes[i], 2 * out[i] + 1), -i))] += 1
        return out

    rng = random.Random(6)
    for _ in range(150):
        votes = [rng.randrange(0, 40) for _ in range(rng.randrange(1, 8))]
        most = [rng.randrange(0, 30) for _ in votes]
        seats = rng.randrange(0, 60)
        assert mixing.sainte_lague(seats, votes, most) == plain(seats, votes, most)
    assert mixing.sainte_lague(10**7, [3.0, 1.0]) == [7_500_000, 2_500_000]


def test_targets():
    assert mixing.targets([100, 100, 100]) == [200.0, 450 - 200 - 83.33333333333333, 83.33333333333333] or abs(sum(mixing.targets([100, 100, 100])) - 450) < 1e-6
    for sizes in ([1, 1000, 50], [0, 0], [5], [10, 0, 10, 10]):
        t = mixing.targets(sizes)
        assert all(x <= 2 * s + 1e-9 for x, s in zip(t, sizes, strict=True)) and abs(sum(t) - 1.5 * sum(sizes)) < 1e-6


def test_mixture(spark, sf_dir, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mixture(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    assert len(rows) == 1000 and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    for s in {r["source"] for r in rows}:
        mine = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 0.02 * mine[0]["target"] + 2 * mixing.BLOCK
    key = lambda df: sorted(map(str, df.collect()))
    assert key(mixing.mixture(docs)) == key(mixing.mixture(docs.repartition(5)))
    assert mixing.mixture(odd_docs).count() == 13 and mixing.mixture(no_docs).count() == 0
    out = mixing.mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns
    words = lambda t: len((t or "").split())
    assert sum(words(r["text"]) for r in out.collect()) == sum(r["taken"] for r in mixing.mixture(odd_docs).collect())


@pytest.mark.parametrize("groups", [mixing.GROUPS, 2])
def test_mixture_against_a_plain_version(spark, monkeypatch, groups):
    """Every row's words: hashes come from Spark, all else is told in plain Python."""
    monkeypatch.setattr(mixing, "GROUPS", groups)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    odd = spark.createDataFrame([(None, "no id " * 20, "a"), (None, "none", None), (5, None, None), (5, "five words in this text", "zz"), (5, "five words in this text", "zz")], docs.schema)
    docs, seed, block, each = docs.unionByName(odd), mixing.SEED, mixing.BLOCK, 40
    name = F.coalesce("doc_id", F.xxhash64("text", "source"))
    rows = [r.asDict() for r in docs.select("doc_id", "text", "source", name.alias("name"), F.xxhash64(name, F.lit(seed)).alias("h"), F.xxhash64(name, F.lit(seed + 1)).alias("order")).collect()]
    by = {}
    for r in rows:
        r["size"] = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        by.setdefault(r["source"], []).append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(r["size"] for r in by[s]) for s in order}
    aims = mixing.targets([sizes[s] for s in order])
    quotas = mixing.sainte_lague(round(sum(aims) / block), aims)
    pairs = [("" if s is None else f"={s}", i) for s in order for i in range(-(-len(by[s]) // each))]
    starts = {(r[0], r[1]): r[2] for r in spark.createDataFrame(pairs, "src string, i int").select("src", "i", F.xxhash64("src", "i", F.lit(seed + 2))).collect()}
    want = []
    for s, aim, quota in zip(order, aims, quotas, strict=True):
        n = -(-len(by[s]) // each)
        shards = [[] for _ in range(n)]
        for r in by[s]:
            shards[r["h"] % n].append(r)
        used = [i for i in range(n) if shards[i]]
        words = {i: sum(r["size"] for r in shards[i]) for i in used}
        per = -(-n // groups)
        grouped = {}
        for i in used:
            grouped.setdefault(i // per, []).append(i)
        keys = sorted(grouped)
        deal = lambda q, parts: mixing.sainte_lague(q, [float(sum(words[i] for i in p)) for p in parts], [2 * sum(-(-words[i] // block) for i in p) for p in parts])
        for g, q in zip(keys, deal(quota, [grouped[k] for k in keys]), strict=True):
            for i, given in zip(grouped[g], deal(q, [[i] for i in grouped[g]]), strict=True):
                n_blocks = -(-words[i] // block)
                start = starts["" if s is None else f"={s}", i] % max(1, n_blocks)
                taken = Counter({b: given // max(1, n_blocks) for b in range(n_blocks)})
                for k in range(given % max(1, n_blocks)):
                    taken[(start + k) % n_blocks] += 1
                at = 0
                for r in sorted(shards[i], key=lambda r: (r["order"], r["name"], r["size"])):
                    want.append((r["doc_id"], r["size"], sizes[s], round(aim, 6), sum(taken[w // block] for w in range(at, at + r["size"]))))
                    at += r["size"]
    got = [(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.mixture(docs, shard_docs=each).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_pipeline(spark, odd_docs, no_docs, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for odd in (odd_docs, no_docs):
            out = stage(spark, odd, sf_dir)
            assert n == 4 or out.columns == odd.columns
            out.count()
        new = stage(spark, docs, sf_dir)
        assert n == 4 or new.dtypes == docs.dtypes
        if n == 1:
            assert new.count() == docs.selectExpr("regexp_replace(coalesce(text, ''), '[\\\\x20\\\\x09-\\\\x0D]+', ' ')").distinct().count()
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_stage_by_stage(spark, sf_dir):
    """Each stage's rows against plain Python over what the stage before kept."""
    import sentencepiece

    from braidgraph.llm import pieces, quality
    from tests.llm.test_dedup import _components
    from tests.llm.test_quality import plain_score

    plain = lambda df: [r.asDict() for r in df.collect()]
    key = lambda rows: sorted(repr(sorted(r.items())) for r in rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, stages = zip(*corpus_pipeline.STAGES, strict=True)
    assert names == ("quality classifier", "exact dedup", "MinHash near-dedup", "mixing sources", "SentencePiece")
    weights = quality.trained(docs)["weights"]
    want = [r for r in plain(docs) if plain_score(r["text"], weights) >= 0.5]
    now = stages[0](spark, docs, sf_dir).cache()
    assert key(plain(now)) == key(want) and 0 < len(want) < docs.count()
    first = {}
    for r in sorted(want, key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r)
    want = list(first.values())
    now = stages[1](spark, now, sf_dir).cache()
    assert key(plain(now)) == key(want)
    groups = _components([(r["doc_id"], r["text"]) for r in want], 5, 80)
    want = [r for r in want if groups[r["doc_id"]][1] == r["doc_id"]]
    now = stages[2](spark, now, sf_dir).cache()
    assert key(plain(now)) == key(want)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mixture(now).collect()}
    text = {r["doc_id"]: r for r in want}
    now = stages[3](spark, now, sf_dir).cache()
    mixed, words = plain(now), lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    got = Counter()
    for r in mixed:
        own = text[r["doc_id"]]
        got[r["doc_id"]] += len(words(r["text"]))
        assert {k: v for k, v in r.items() if k not in ("text", "n_chars")} == {k: v for k, v in own.items() if k not in ("text", "n_chars")} and r["n_chars"] == len(r["text"])
        rest = iter(words(own["text"]))
        assert r["text"] == own["text"] or Counter(words(r["text"])) <= Counter(rest)
    assert got == Counter({i: n for i, n in taken.items() if n})
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    want = []
    for r in mixed:
        ids = [sp.bos_id(), *sp.encode(r["text"]), sp.eos_id()]
        want.append({"doc_id": r["doc_id"], "n_tokens": len(ids), "ids_sha256": hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), "decoded_sha256": hashlib.sha256(sp.decode(ids).encode()).hexdigest()})
    assert key(plain(stages[4](spark, now, sf_dir))) == key(want) == key(plain(corpus_pipeline.run(spark, sf_dir)))


def test_queries_cover_the_ten():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)] and set(queries.ORACLES) <= set(queries.QUERIES)

"""Columns of documents keep their values whatever their names are, and broken or odd rows end no job."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from talus.llm import gif, langid, media, mixing, neardup, packing, quality, sharding, vectors
from talus.llm.queries import fold

NAMES = "score kept weak_label copy bytes single longest leaf cdf parts _lower _n _key _hash _part _row row hash n page depth shard_id n_bytes own rated key lang_pred ambiguous held_out learn batch id digest sig place others component_id _rows _copies _copy shuffle_key".split()


@pytest.fixture(scope="module")
def named(docs):
    """docs with a column of each name that holds its own text."""
    plain = docs.select("doc_id", "text", "lang", "source")
    return plain.select("*", *[F.concat(F.lit(f"{n}:"), F.coalesce(F.md5("text"), F.lit("-"))).alias(n) for n in NAMES]).cache()


def values(df, names):
    return collections.Counter(tuple(r) for r in df.select("doc_id", "text", "lang", "source", *names).collect())


def test_stages_keep_columns_by_value(spark, named):
    before = values(named, NAMES)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, named, "")
        assert got.columns == named.columns and got.count() and set(values(got, NAMES)) <= set(before)


def test_operators_keep_or_replace_columns(named):
    for run, added in ((quality.scored, quality.ADDED), (mixing.mix, mixing.ADDED), (lambda d: sharding.shard(d, 3000), sharding.ADDED)):
        got, rest = run(named), [n for n in NAMES if n not in added]
        assert set(values(got, rest)) <= set(values(named, rest)) and {n for n in NAMES if n in added} <= set(got.columns)
    plain = named.select("doc_id", "text", "lang", "source")
    for run in (lambda d: langid.identify(d, fold(4) != 2, fold(4) == 2), neardup.near_duplicates, lambda d: media.features(media.stored_media(d))):
        a, b = (collections.Counter(map(str, run(d).collect())) for d in (plain, named))
        assert a == b
    e = named.sparkSession.createDataFrame([(i, [float(i), 1.0], "x", "y") for i in range(120)], "vec_id LONG, embedding ARRAY<DOUBLE>, row STRING, dim STRING")
    assert vectors.top_k(e, e.where("vec_id % 100 = 0")).count() == 20


def test_overflow_pages_do_not_depend_on_partitions(spark):
    rows = [(1, "x" * 900)] * 40 + [(1, f"{i:04d}" * 100) for i in range(50)] + [(i, "short") for i in range(2, 60)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = [collections.Counter(map(tuple, sharding.shard(df.repartition(n), 2000).select("doc_id", "text", "shard_id").collect())) for n in (1, 3, 11)]
    assert got[0] == got[1] == got[2]
    sizes = collections.Counter()
    for (_, text, shard), n in got[0].items():
        sizes[shard] += len(text) * n
    assert max(sizes.values()) <= 2000 and sum(got[0].values()) == len(rows)


def brute_buckets(rows, limit):
    """Split one by one, as the method says: shard of each hash."""
    done, open_ = {}, [("", rows)]
    while open_:
        prefix, own = open_.pop()
        if sum(b for _, b in own) <= limit or len(prefix) == 60:
            done.update({h: prefix for h, _ in own})
            continue
        for bit in "01":
            part = [(h, b) for h, b in own if h[len(prefix)] == bit]
            if part:
                open_.append((prefix + bit, part))
    return done


def test_buckets_are_those_of_single_splits(spark):
    import hashlib

    rng = np.random.default_rng(3)
    rows = [(i, "x" * int(rng.integers(0, 400))) for i in range(900)]
    hashed = [(f"{int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16):060b}", len(t)) for i, t in rows]
    want = brute_buckets(hashed, 500)
    got = sharding.shard(spark.createDataFrame(rows, "doc_id LONG, text STRING"), 500).collect()
    for r in got:
        p = want[f"{int(hashlib.md5(str(r['doc_id']).encode()).hexdigest()[:15], 16):060b}"]
        assert r["depth"] == len(p) and r["shard_id"] == f"{len(p)}-{int(p or '0', 2)}" and r["page"] is None


def test_broken_media(spark):
    whole = gif.encode_bytes(bytes(range(256)) * 40)
    rng, cases = np.random.default_rng(2), [whole]
    at = whole.index(b"\x2c", 800)
    for size in range(13):  # the code size follows the image's descriptor
        cases.append(whole[: at + 10] + bytes([size]) + whole[at + 11 :])
    huge = bytearray(whole)
    huge[6:10] = b"\xff" * 4
    frame = bytearray(whole)
    frame[at + 5 : at + 9] = b"\xff" * 4
    cases += [bytes(huge), bytes(frame), b"", b"GIF89a", whole[:-1], whole[: len(whole) // 2], whole[:900]]
    for _ in range(150):
        changed = bytearray(whole)
        for i in rng.integers(0, len(whole), 3):
            changed[i] = rng.integers(0, 256)
        cases.append(bytes(changed))
    df = spark.createDataFrame([(i, len(c), bytearray(c)) for i, c in enumerate(cases)] + [(999, None, None)], "doc_id LONG, n_bytes LONG, media BINARY")
    got = {r["doc_id"]: r for r in media.features(df).collect()}
    assert len(got) == len(cases) + 1 and got[0]["error"] is None and got[0]["payload_bytes"] == 256 * 40
    wrong = [0, *range(9, 13)]
    assert all(got[1 + s]["error"] for s in wrong) and got[9]["error"] is None
    assert all(got[i]["error"] and got[i]["feature"] is None for i in range(14, 18)) and got[999]["error"] and media.frames(df).count() > 0


def test_padding_is_little(docs, tokenizer):
    """Sequences hold all ids; what is padded is below one in a hundred where documents abound."""
    spark = docs.sparkSession
    df = spark.createDataFrame([(i, " ".join(f"word{i * j % 91}" for j in range(20 + i * 37 % 900))) for i in range(600)], "doc_id LONG, text STRING").coalesce(1)
    per = packing.pack(df, tokenizer).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    padded = sum(0 if r["n"] & (r["n"] - 1) == 0 else 2048 - r["n"] for r in per)
    assert padded < 0.01 * sum(r["n"] for r in per)

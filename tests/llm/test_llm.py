"""The ten operators against brute force on a small table of hard cases."""

import collections
import hashlib
import math
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talus.llm import gif, langid, media, mixing, neardup, packing, quality, sharding, shared, tokenfiles, vectors
from talus.llm.links import components
from talus.llm.queries import fold


def held(doc, folds):
    return doc is not None and zlib.crc32(str(doc).encode()) % folds == 2


def words(t):
    return (t or "").encode().lower().split()


def test_gif_round_trips():
    rng = np.random.default_rng(1)
    cases = [b"", b"a", b"ab" * 5000, bytes(range(256)) * 40, rng.integers(0, 256, 30000, np.uint8).tobytes(), b"the of and " * 9000, bytes(70000)]
    for c in cases:
        assert gif.lzw_decode(gif.lzw_encode(c), 8, len(c) + 9).tobytes() == c
        padded = c + bytes(max(64, -(-len(c) // 64) * 64) - len(c))
        assert b"".join(gif.frame_bytes(f) for f in gif.decode(gif.encode_bytes(padded))) == padded


def small_gif(frames, size=(3, 2)):
    """frames: (left, top, w, h, indices, disposal, transparent, delay, interlaced); four colours."""
    out = b"GIF89a" + size[0].to_bytes(2, "little") + size[1].to_bytes(2, "little") + b"\x81\x00\x00" + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    for left, top, w, h, index, disposal, clear, delay, laced in frames:
        out += bytes([0x21, 0xF9, 4, disposal << 2 | (clear is not None)]) + delay.to_bytes(2, "little") + bytes([clear or 0, 0]) + b"\x2c" + b"".join(x.to_bytes(2, "little") for x in (left, top, w, h)) + bytes([0x40 * laced])
        bits = "".join(format(c, "03b")[::-1] for x in index for c in (4, x)) + format(5, "03b")[::-1]  # a clear code before each pixel
        bits += "0" * (-len(bits) % 8)
        data = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
        out += b"\x02" + bytes([len(data)]) + data + b"\x00"
    return out + b"\x3b"


def test_gif_disposal_and_transparency():
    full = (0, 0, 3, 2, [1] * 6, 0, None, 5, 0)
    kept, restored = small_gif([full, (1, 0, 2, 1, [2, 3], 3, 3, 7, 0), (0, 1, 1, 1, [2], 2, None, 1, 0), (2, 1, 1, 1, [3], 0, None, 1, 0)]), None
    f = list(gif.decode(kept))
    colour = lambda x, r, c: tuple(x.canvas[r, c])
    red, green, blue = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255)
    assert [x.delay_cs for x in f] == [5, 7, 1, 1] and (f[0].canvas.reshape(-1, 4) == red).all()
    assert colour(f[1], 0, 1) == green and colour(f[1], 0, 2) == red  # index 3 is transparent there
    assert colour(f[2], 0, 1) == red and colour(f[2], 1, 0) == green  # the frame before was taken back
    assert colour(f[3], 1, 0) == (0, 0, 0, 0) and colour(f[3], 1, 2) == blue  # cleared to nothing
    assert restored is None and gif.histogram(f[3].canvas).sum() == 5
    laced = next(gif.decode(small_gif([(0, 0, 1, 5, [0, 1, 2, 3, 1], 0, None, 0, 1)], (1, 5))))
    order = [0, 4, 2, 1, 3]
    pal = [(0, 0, 0, 255), red, green, blue]
    assert [colour(laced, r, 0) for r in order] == [pal[i] for i in (0, 1, 2, 3, 1)]


def test_media(docs, empty):
    kept = media.stored_media(docs)
    got = {(r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in media.features(kept).collect()}
    want = set()
    for r in docs.collect():
        b = (r["text"] or "").encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        want.add((r["doc_id"], len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert got == want and media.features(kept).count() == docs.count() and media.features(media.stored_media(empty)).count() == 0
    long = media.frames(kept.where("doc_id = 70")).select("frame", "start_cs", "delay_cs").orderBy("frame").collect()
    assert len(long) > 5 and all(r["start_cs"] == 4 * r["frame"] for r in long)
    broken = kept.limit(1).withColumn("media", F.lit(b"GIF89a"))
    assert media.features(broken).first()["error"] and media.frames(broken).count() == 0


def test_language(docs, empty):
    run = lambda df: langid.identify(df, learn=fold(4) != 2, held_out=fold(4) == 2)
    got = run(docs).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.where("doc_id < 60").collect()}
    assert len(got) == docs.count() and all(r["lang_pred"] == truth[r["doc_id"]] for r in got if r["doc_id"] in truth)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {64, 65, 66, 69, 73, None} and all(0 <= r["score"] <= 1 for r in got)
    assert run(empty).count() == 0 and {r["lang_pred"] for r in run(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    stay = langid.identified(docs, learn=fold(4) != 2)
    assert stay.columns == docs.columns and {64, 65, 69}.isdisjoint({r["doc_id"] for r in stay.select("doc_id").collect()})
    for n in (2, 3, 4, 7, 20):
        code = langid.codewords(n, 31)
        assert len({tuple(c) for c in code.tolist()}) == n and (abs(code.sum(0)) < n).all()


def test_quality(docs, empty):
    got = quality.scored(docs.select("doc_id", "text", "score", "kept")).collect()
    assert len(got) == docs.count()
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert not any(kept[i] for i in (64, 65, 66, 73)) and all(kept[i] for i in range(60))
    assert quality.filtered(docs).columns == docs.columns and quality.filtered(empty).count() == 0
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.8
    good = np.array([0.95, 0.9, 0.99, 0.85])
    v = np.where(rng.random((4000, 4)) < np.where(truth[:, None], good, 1 - np.array([0.9, 0.8, 0.7, 0.85])), 1, -1)
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    share, table = quality.accuracies(patterns, counts.astype(float))
    assert abs(share - 0.8) < 0.05 and np.abs(table[1] - good).max() < 0.06


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test data")
def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    q = quality.scored(docs.select("doc_id", "text")).join(labels, "doc_id").agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double"))).first()[0]
    lang = langid.identify(docs, learn=fold(4) != 2, held_out=fold(4) == 2).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0]
    assert q > 0.97 and lang > 0.98


def test_token_counts(spark, docs, empty, tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], len(t.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())
    for rules in (tokenfiles.FlatRules(), tokenfiles.FlatRules(file_ids=900, block_ids=37, group_files=3)):
        got = tokenfiles.token_counts(docs, tokenizer, rules).collect()
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"]) for r in got) == want
    assert tokenfiles.token_counts(empty, tokenizer).count() == 0


def test_flat_files_of_others(spark, tmp_path):
    """A stream cut at odd places, with an unended document."""
    ids = np.array([5, 9, 9, 7, 7, 7, 9, 1, 2], "<u4")
    for i, part in enumerate(np.split(ids, [2, 5])):
        part.tofile(tmp_path / f"tokens-000000-{i:06d}.bin")
    rules = tokenfiles.FlatRules(separator=9, id_bytes=4, block_ids=2, group_files=1)
    got = tokenfiles.document_lengths(tokenfiles.read_blocks(spark, str(tmp_path), rules), rules).orderBy("place").collect()
    assert [(r["place"], r["n_tokens"], r["start"], r["ended"]) for r in got] == [(0, 1, 0, True), (1, 0, 2, True), (2, 3, 3, True), (3, 2, 7, False)]


def brute_components(rows):
    sets = []
    for r in rows:
        w = words(r["text"])
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same = rows[i]["doc_id"] == rows[j]["doc_id"]
            if None not in (rows[i]["doc_id"], rows[j]["doc_id"]) and (same or both and 100 * both >= 85 * len(sets[i] | sets[j])):
                up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[find(i)] = min(r["doc_id"], least.get(find(i), r["doc_id"]))
    return [(r["doc_id"], len(sets[i]), None if r["doc_id"] is None else least[find(i)]) for i, r in enumerate(rows)]


def key(x):
    return tuple(-1 if v is None else v for v in x)


def test_near_duplicates(spark, docs, empty):
    got = neardup.near_duplicates(docs).collect()
    want = brute_components(docs.collect())
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(want, key=key)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)
    stay = neardup.deduplicated(docs)
    assert stay.columns == docs.columns and {60, 61, 63, 68}.isdisjoint({r["doc_id"] for r in stay.collect()}) and stay.where("doc_id = 71").count() == 1
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    """Edited copies of one text around the limit, compared in small blocks."""
    import random

    r = random.Random(3)
    base = [f"w{r.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"x{r.randrange(9999)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = neardup.near_duplicates(df, neardup.NearRules(block=16)).collect()
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == sorted(brute_components(df.collect()))


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 99), (7, 7)]
    got = dict(components(spark.createDataFrame(chain, "a LONG, b LONG")).distinct().collect())
    assert got == {i: 1 for i in range(1, 41)} | {99: 99, 100: 99, 101: 99}


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = [(i, x.tolist()) for i, x in enumerate(rng.normal(0, 1, (330, 8)).round(2))]
    v += [(400, v[0][1]), (500, v[0][1]), (500, v[0][1]), (600, None), (601, [1.0, None] + [0.0] * 6), (602, [float("nan")] * 8), (603, []), (None, v[3][1]), (700, [1.0, 2.0]), (701, [2.0, 1.0])]
    v += [(800, [0.0] * 8), (900, [1e300] * 8), (901, [-1e200, *[1.0] * 7]), (902, [3e9, *[-1.0] * 7]), (903, [1e307] * 8)]
    v += [(1000, [1.0]), (1001, [200000.0]), (1002, [300000.0]), (1100, [-1e250]), (1101, [1e250]), (1102, [2e250])]
    v += [(1199, [-(2.0**23)]), (1200, [2.0**21]), (1201, [-(2.0**22)])]  # products of exactly -2^63 and below it
    df = spark.createDataFrame(v, "vec_id LONG, embedding ARRAY<DOUBLE>").withColumn("row", F.lit(1)).withColumn("q_row", F.lit(2)).repartition(3)
    good = {(i, tuple(x)) for i, x in v if i is not None and x and all(c is not None and math.isfinite(1024 * c) for c in x)}
    ints = [(i, [int(math.floor(1024 * c)) for c in x]) for i, x in sorted(good)]
    want = []
    for q, a in ints:
        if q % 100 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ints if i != q and len(b) == len(a))[:10]
            want += [(q, n, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(scores, 1)]
    got = vectors.top_k(df, df.where("vec_id % 100 = 0")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    for name, small in (("BLOCK", 16), ("QUERY_BYTES", 300), ("FIRST", 20), ("CANDIDATES", 5)):
        monkeypatch.setattr(vectors, name, small)
    assert sorted(map(tuple, vectors.top_k(df, df.where("vec_id % 100 = 0")).collect())) == sorted(want)
    assert vectors.top_k(df.limit(0), df.limit(0)).count() == 0


def test_vector_bounds_hold():
    rng = np.random.default_rng(5)
    for scale in (1, 1e3, 1e9, 1e100):
        x, q = np.floor(rng.normal(0, scale, (40, 6))), np.floor(rng.normal(0, scale, (7, 6)))
        rows = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([6] * 40, pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["row", "dim", "vec"])
        grid = next(vectors._approximations(iter([rows]))).to_pylist()[0]
        lower, upper = vectors.bounds(q, *vectors._grid(grid)[1:])
        for i in range(7):
            for j in range(40):
                exact = sum(int(a) * int(b) for a, b in zip(q[i].tolist(), x[j].tolist(), strict=True))
                assert int(lower[i, j]) - 1 <= exact <= int(upper[i, j]) + 1 and upper[i, j] - lower[i, j] < 0.2 * 36 * scale**2 + 4


def test_spread_join(spark):
    many = spark.createDataFrame([(i % 3 if i < 90 else None, i) for i in range(100)], "k LONG, n LONG")
    one = spark.createDataFrame([(0, "a"), (1, "b"), (5, "c")], "k LONG, v STRING")
    for how in ("inner", "left"):
        want = sorted(map(str, many.join(one, "k", how).select("k", "n", "v").collect()))
        assert sorted(map(str, shared.spread_join(many, one, "k", "n", how, most=7).select("k", "n", "v").collect())) == want


def test_sharding(spark, docs, empty):
    got = sharding.shard(docs, 4000)
    rows = got.collect()
    sizes = collections.Counter()
    n = collections.Counter()
    for r in rows:
        sizes[r["shard_id"]] += r["n_bytes"]
        n[r["shard_id"]] += 1
    assert len(rows) == docs.count() and all(b <= 4000 or n[s] == 1 for s, b in sizes.items())
    assert set(docs.columns) <= set(got.columns) and sharding.shard(empty, 4000).count() == 0
    same = spark.createDataFrame([(1, "x" * 900)] * 50, "doc_id LONG, text STRING")
    pages = sharding.shard(same, 2000).groupBy("shard_id").agg(F.sum("n_bytes").alias("b")).collect()
    assert all(p["b"] <= 2000 for p in pages) and sum(p["b"] for p in pages) == 45000


def test_mixing(spark, docs, empty):
    weights = spark.createDataFrame([("hot", 1.0), ("s1", 3.0), (None, 0.0)], "source STRING, weight DOUBLE")
    got = mixing.mix(docs, weights, mixing.MixingRules(epochs=40.0))
    assert {r["source"] for r in got.select("source").distinct().collect()} <= {"hot", "s1"} and mixing.mix(empty).count() == 0
    again = mixing.mix(docs.repartition(7), weights, mixing.MixingRules(epochs=40.0))
    assert sorted(map(tuple, got.select(F.coalesce("doc_id", F.lit(-1)), "copy").collect())) == sorted(map(tuple, again.select(F.coalesce("doc_id", F.lit(-1)), "copy").collect()))
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.when(F.col("id") % 4 == 0, F.lit("a")).otherwise(F.lit("b")).alias("source"))
    n = dict(mixing.mix(many, spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source STRING, weight DOUBLE")).groupBy("source").count().collect())
    assert abs(n["a"] - 10_000) < 500 and abs(n["b"] - 10_000) < 500


def test_packing(spark, docs, empty, tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    rules = packing.PackingRules(size=256, segment=5000)
    got = packing.pack(docs, tokenizer, rules, with_ids=True).collect()
    want = collections.Counter(((-1 if r["doc_id"] is None else r["doc_id"]), tuple([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1])) for r in docs.collect())
    place, seen = {}, collections.Counter()
    for r in got:
        place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
    for pieces in place.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[-1 if r["doc_id"] is None else r["doc_id"]].append(r)
    for doc, pieces in by_doc.items():
        if sum(n for (d, _), n in want.items() if d == doc) == 1:
            ids = tuple(i for p in sorted(pieces, key=lambda p: p["start"]) for i in p["ids"])
            assert want[(doc, ids)] == 1
        seen[doc] = sum(p["length"] for p in pieces)
    assert seen == {d: sum(len(i) * n for (e, i), n in want.items() if e == d) for d, _ in want} and packing.pack(empty, tokenizer).count() == 0


def test_cuts_are_the_best():
    """The cost of the cuts is the least of all ways to cut, windows first and powers of two for the rest."""
    rng = np.random.default_rng(4)
    rules = packing.PackingRules(size=12, stride=4, short_penalty=3)
    for _ in range(60):
        at = np.cumsum(rng.integers(1, 5, 9))
        penalty = rng.choice([0, 4, 24], 9)
        penalty[-1] = 0
        points, total = [0, *at.tolist()], int(at[-1])
        costs = dict(zip(points[1:], penalty.tolist(), strict=True))
        best = [0.0] + [math.inf] * 9
        for i in range(1, 10):
            best[i] = min((best[j] + rules.size - points[i] + points[j] + costs[points[i]] for j in range(i) if points[i] - points[j] <= rules.size), default=math.inf)
        tail = lambda i: rules.short_penalty * (total - points[i]).bit_count() if total - points[i] < rules.size else math.inf
        want = min(best[i] + tail(i) for i in range(10))
        ends = packing.best_cuts(at, penalty, rules)
        found = []
        for k in range(len(ends) + 1):  # the first k are windows
            steps = list(zip([0, *ends[: k - 1]] if k else [], ends[:k], strict=True))
            here = ends[k - 1] if k else 0
            if all(e in costs and e - b <= rules.size for b, e in steps) and here in points and total - here < rules.size and len(ends) - k == (total - here).bit_count():
                found.append(sum(rules.size - e + b + costs[e] for b, e in steps) + rules.short_penalty * (total - here).bit_count())
        assert ends[-1] == total and found and min(found) == want


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "language", "near_duplicates", "mixing", "packing"]
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == docs.columns
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0

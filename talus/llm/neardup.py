"""Near-duplicate documents by a multi-index Hamming join of minhash signatures.

A document's set are its distinct five-word shingles. Documents of equal sets
form a class (by a 128-bit digest); one of each class goes on. Its signature
has ``chunks * width`` minhash symbols of 16 bits. The distance of two
signatures is the number of symbols that differ. By the pigeonhole principle,
two signatures at a distance of at most ``2 * chunks - 1`` agree in some chunk
but for one symbol, and the index holds each chunk once for each symbol left
out: all pairs within that distance share a key. The rules choose chunks so that
this covers ``near``, beyond which no pair is confirmed, and ``near`` so that a
pair at the least similarity lies beyond it with a probability of ``far``.

Pairs that share a key are never listed as such. First every document is held
against the smallest of each of its keys (a star), links are confirmed on the
full sets and joined to components. Then only keys whose documents lie in
several components are left. Within those of at most ``large`` documents signatures
are compared in numpy. Larger ones are met where many texts share a template or
passages without being near copies, and nearly all of their pairs would be refuted.
Their documents are keyed once more, by the shingles of a prefix: shingles are
ordered by how many of these documents have them (counted by remainder of their hash,
so the counts are bounded), rarest first, and two sets that are linked share one of
their first ``n - ceil(n * percent / 100) + 1``, which lies even earlier in the smaller
set (it leads there); the places also bound how much both can share. So no linked pair
is lost, and texts that only share what very many have do not meet. Keys that are large even so are compared
in blocks, by size of the set (sets whose sizes differ by more than the percentage
cannot be linked). Pairs of different components that are near by the signature, then
by a longer one, are confirmed. So each pair that shares a key is either confirmed,
refuted, or in one component already.

A document that many others are held against meets them in several groups, once
in each; rows of a text that very many documents share are dealt out likewise.

Defined results: null, empty or blank texts have an empty set and are linked
with nothing; sets below six shingles (four at 80 percent) can only be linked with equal ones;
repeated rows are of one class; rows that share an id are one document; a row
without id is linked with nothing, has no component and is kept; an empty table
gives no rows; further columns are ignored; texts are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.links import components
from talus.llm.shared import checked_broadcast, spread_join, stored, with_row
from talus.llm.shingles import digests, minhashes, mixed, shingle_sets
from talus.llm.subwords import text_chunks


def _most(symbols: int, bits: int, like: float, miss: float) -> int:
    """The distance that pairs of this similarity exceed with a probability of at most ``miss`` (a binomial tail)."""
    like += (1 - like) / 2**bits  # unlike symbols that are equal by chance
    tail, k = 0.0, symbols
    while k and tail + (term := math.comb(symbols, k) * (1 - like) ** k * like ** (symbols - k)) <= miss:
        tail, k = tail + term, k - 1
    return k


def _shape(like: float, symbols: int, far: float) -> tuple[int, int]:
    """chunks, width: the widest chunks, and as few of them as guarantee a shared key to pairs that are near by so many symbols."""
    for width in range(symbols, 0, -1):
        for chunks in range(1, symbols // width + 1):
            if 2 * chunks - 1 >= _most(chunks * width, 16, like, far):
                return chunks, width
    return symbols, 1


@dataclass(frozen=True)
class NearRules:
    """Bounds that are not given follow from ``percent``."""

    words: int = 5
    #: Link if 100 * intersection >= percent * union.
    percent: int = 85
    #: Most symbols of a signature.
    symbols: int = 72
    chunks: int = 0
    width: int = 0
    #: Pairs beyond this distance are not confirmed; at the least similarity more differ with a probability of ``far``.
    near: int = -1
    #: Symbols of 8 bits of the longer signature that documents between components get, and the distance beyond which
    #: a pair of these is not confirmed; at the least similarity more differ with a probability of ``far``.
    fine_symbols: int = 512
    fine_near: int = -1
    far: float = 1e-6
    #: Documents of a key beyond which they are keyed by the shingles of a prefix.
    large: int = 64
    #: Remainders of hashes by which shingles are counted for the order of prefixes.
    counters: int = 1 << 18
    #: Documents of a key in one block of the comparison, and those held against one document in one group.
    block: int = 2048
    group: int = 4096

    def __post_init__(self) -> None:
        like = self.percent / 100
        if not self.chunks or not self.width:
            for name, value in zip(("chunks", "width"), _shape(like, self.symbols, self.far), strict=True):
                object.__setattr__(self, name, value)
        if self.near < 0:
            object.__setattr__(self, "near", _most(self.chunks * self.width, 16, like, self.far))
        if self.fine_near < 0:
            object.__setattr__(self, "fine_near", _most(self.fine_symbols, 8, like, self.far))

    @property
    def least(self) -> int:
        """Shingles of the smallest set that can be linked with another one: n of n + 1 must reach the percentage."""
        return -(-self.percent // max(1, 100 - self.percent))


def signatures(docs: DataFrame, rules: NearRules) -> DataFrame:
    """doc_id, n_shingles, digest, sig of every row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_chunks(batch.column(1)):
                sets, offsets = shingle_sets(texts, rules.words)
                sig = minhashes(sets, offsets, rules.chunks * rules.width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(offsets)), pa.array(digests(sets, offsets), pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())],
                    ["doc_id", "n_shingles", "digest", "sig"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, n_shingles long, digest binary, sig binary")


def _key_numbers(rules: NearRules) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    shape = (rules.chunks, rules.width)
    return rng.integers(0, 2**63, shape, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, shape, np.uint64)


def _first_key(x: np.ndarray, y: np.ndarray, rules: NearRules) -> np.ndarray:
    """The first key that the signatures (rows of x and y) share: their first chunk with at most one differing symbol, that symbol (else the first) left out."""
    factor, plus = _key_numbers(rules)
    differ = (x != y).reshape(-1, rules.chunks, rules.width)
    row = np.arange(len(x))
    chunk = (differ.sum(2) <= 1).argmax(1)
    out = differ[row, chunk].argmax(1)
    terms = mixed((x.reshape(-1, rules.chunks, rules.width)[row, chunk].astype(np.uint64) + np.uint64(1)) * factor[chunk])
    return mixed(terms.sum(1, dtype=np.uint64) - terms[row, out] + plus[chunk, out]).view(np.int64)


def _index(classes: DataFrame, rules: NearRules) -> DataFrame:
    """key, id: each chunk of a signature with one symbol left out."""
    chunks, width = rules.chunks, rules.width

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, plus = _key_numbers(rules)
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, chunks, width).astype(np.uint64) + np.uint64(1)
            terms = mixed(sig * factor)
            keys = mixed(terms.sum(2, dtype=np.uint64)[:, :, None] - terms + plus)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), chunks * width))], ["key", "id"])

    return classes.where(F.col("n_shingles") >= rules.least).select("id", "sig").mapInArrow(task, "key long, id long")


def _beside(pairs: DataFrame, values: DataFrame, most: int) -> DataFrame:
    """a, part, b, value in order: for each document a (in each of its groups) first its own value (b is null), then those of all b. values: id, value."""
    pairs = stored(pairs.select("a", "b"))
    hot = stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / most).cast("int").alias("groups")).where("groups > 1"))
    dealt = pairs.join(checked_broadcast(hot, hot.count()), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("groups", F.lit(1))).cast("int").alias("part"))
    others = dealt.join(values.withColumnRenamed("id", "b"), "b").select("a", "part", "b", "value")
    own = dealt.select("a", "part").distinct().join(values.withColumnRenamed("id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "value")
    return own.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", "b")


def _distances(pairs: DataFrame, values: DataFrame, most: int, kind: type, group: int) -> DataFrame:
    """The pairs (a, b) whose signatures (values: id, value, symbols of a kind) differ in at most so many symbols."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, held = None, []  # the group that goes on from batch to batch, and its own values
        for batch in batches:
            raw, own = batch.column(3).to_pylist(), batch.column(2).is_null().to_numpy(zero_copy_only=False)
            if not raw:
                continue
            group = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (0, 1)], 1)
            if before != tuple(group[0]):
                held = []
            n = len(held)
            sig = np.frombuffer(b"".join([*held, *raw]), kind).reshape(n + len(raw), -1)
            place = np.arange(n + len(raw))
            starts = np.concatenate([np.arange(n) == 0, [n == 0], (group[1:] != group[:-1]).any(1)])
            first = np.maximum.accumulate(np.where(starts, place, 0))
            last = np.maximum.accumulate(np.where(np.append(np.ones(n, bool), own), place, 0))
            near = np.zeros(len(place), bool)
            for k in range(int((last - first).max()) + 1):  # one, but for documents of several texts
                near |= (sig != sig[np.minimum(first + k, last)]).sum(1) <= most
            before, held = tuple(group[-1]), [sig[i].tobytes() for i in range(first[-1], last[-1] + 1)]
            yield batch.select([0, 2]).filter(pa.array(near[n:] & ~own))

    return _beside(pairs, values, group).mapInArrow(task, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, rules: NearRules) -> DataFrame:
    """The pairs (a, b) linked by their full sets. texts: id, text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, own = None, []
        for batch in batches:
            a, part, first = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).is_null().to_pylist()
            good = np.zeros(batch.num_rows, bool)
            for i, j, some in text_chunks(batch.column(3)):
                sets, offsets = shingle_sets(some, rules.words)
                for k in range(i, j):
                    other = sets[offsets[k - i] : offsets[k - i + 1]]
                    if before != (a[k], part[k]):
                        before, own = (a[k], part[k]), []
                    if first[k]:
                        own.append(other)
                        continue
                    for one in own:  # several only if a document has several texts
                        both = len(np.intersect1d(one, other, assume_unique=True))
                        good[k] |= 100 * both >= rules.percent * (len(one) + len(other) - both) and both > 0
            yield batch.select([0, 2]).filter(pa.array(good))

    pairs = stored(pairs)
    asked = stored(_ends(pairs, texts).withColumnRenamed("text", "value"))
    return _beside(pairs, asked, rules.group).mapInArrow(task, "a long, b long")


def _ends(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """id, text of the documents of pairs (a, b)."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    return texts.join(checked_broadcast(ids, ids.count()), "id", "left_semi").distinct()


def _fine(asked: DataFrame, rules: NearRules) -> DataFrame:
    """id and the longer signature, ``value``, of texts (id, text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, some in text_chunks(batch.column(1)):
                fine = minhashes(*shingle_sets(some, rules.words), rules.fine_symbols, seed=12).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([f.tobytes() for f in fine], pa.binary())], ["id", "value"])

    return asked.mapInArrow(task, "id long, value binary")


def _prefixes(ids: DataFrame, texts: DataFrame, rules: NearRules) -> DataFrame:
    """key, id, lead, most: the rarest shingles of the documents of these ids, so many that two linked sets share one.

    lead: the shingle stands so early that a set of no smaller size may have it as the
    first that both share; most: the shingles from it on, so at most so many are shared.
    """
    asked = stored(texts.join(checked_broadcast(ids, ids.count()), "id", "left_semi").select("id", "text").distinct())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(rules.counters, np.int64)
        for batch in batches:
            for _, _, some in text_chunks(batch.column(1)):
                sets, _ = shingle_sets(some, rules.words)
                n += np.bincount((sets % np.uint64(rules.counters)).astype(np.int64), minlength=rules.counters)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["at", "n"])

    counts = np.zeros(rules.counters, np.int64)
    for r in asked.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():  # at most ``counters`` rows
        counts[r["at"]] = r["n"]
    held = ids.sparkSession.sparkContext.broadcast(counts)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, some in text_chunks(batch.column(1)):
                sets, offsets = shingle_sets(some, rules.words)
                n = np.diff(offsets)
                first = n - -(-n * rules.percent // 100) + 1
                own = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((sets, held.value[(sets % np.uint64(rules.counters)).astype(np.int64)], own))
                place = np.arange(len(own)) - offsets[:-1][own]
                take = place < first[own]
                kept, most, size = order[take], (n[own] - place)[take], n[own][take]
                lead = most >= -(-2 * size * rules.percent // (100 + rules.percent))
                yield pa.RecordBatch.from_arrays([pa.array(sets[kept].view(np.int64)), batch.column(0).slice(a, b - a).take(pa.array(own[take])), pa.array(lead), pa.array(most)], ["key", "id", "lead", "most"])

    return asked.mapInArrow(task, "key long, id long, lead boolean, most long")


def _keyed(rows: DataFrame, texts: DataFrame, rules: NearRules) -> DataFrame:
    """key, prefix, id, component, lead, most: rows (key, id, component) of small keys as they are, the documents of large ones by the keys of their prefixes."""
    large = stored(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > rules.large).select("key"))
    n = large.count()
    columns = ["key", "prefix", "id", "component", "lead", "most"]
    small = rows.join(checked_broadcast(large, n), "key", "left_anti").withColumn("prefix", F.lit(False)).withColumn("lead", F.lit(True)).withColumn("most", F.lit(2**62)).select(*columns)
    if not n:
        return small
    hot = stored(rows.join(checked_broadcast(large, n), "key", "left_semi").select("id", "component").distinct())
    return small.unionByName(_prefixes(hot.select("id"), texts, rules).withColumn("prefix", F.lit(True)).join(hot, "id").select(*columns))


def _across(rows: DataFrame, rules: NearRules) -> DataFrame:
    """a, b (a < b): near signatures of different components within a key. rows: key, prefix, id, component, lead, most, n_shingles, sig. Of a pair one leads at least.

    A key of more documents than a block is parted by bands of set sizes, so that
    linked pairs lie in one band or in neighbouring ones (a document stands in its
    own band and, as ``lower``, in the next), and compared block against block,
    each pair of blocks in a group of its own. A pair comes from the first key that
    it shares alone, but for keys of prefixes, which may give it several times.
    """
    size = stored(rows.groupBy("key").agg(F.count("*").alias("n")))
    own_band = F.floor(F.log("n_shingles") / F.lit(1.001 * math.log(100 / min(rules.percent, 99)))).cast("int")
    large = F.col("n") > rules.block
    placed = (
        spread_join(rows, size, "key", "id", counts=size)
        .withColumn("parts", F.ceil(F.col("n") / rules.block).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        .withColumn("band", F.explode(F.when(large, F.array(own_band, own_band + 1)).otherwise(F.array(F.lit(0)))))
        .withColumn("lower", large & (F.col("band") != own_band))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("key", "prefix", "band", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "lower", "lead", "most", "id", "component", "n_shingles", "sig")
    )

    def close(sigs: np.ndarray, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
        return np.concatenate([(sigs[x[k : k + 20_000]] != sigs[y[k : k + 20_000]]).sum(1) <= most for k in range(0, len(x), 20_000)])

    def compare(key: int, prefix: bool, low: int, high: int, own: np.ndarray, lower: np.ndarray, lead: np.ndarray, upto: np.ndarray, ids: np.ndarray, comps: np.ndarray, sizes: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(sizes, kind="stable")
        left, right = order[own[order] == low], order[own[order] == high]
        sides = [(left[lead[left]], right)] + ([(right[lead[right]], left[~lead[left]])] if low != high else [])
        least, most = -(-sizes * rules.percent // 100), sizes * 100 // rules.percent  # sizes of sets that may be linked
        found = []
        for i, others in ((leading[at : at + 64], others) for leading, others in sides for at in range(0, len(leading), 64)):
            near = others[np.searchsorted(sizes[others], least[i[0]]) : np.searchsorted(sizes[others], most[i[-1]], "right")]
            apart = (comps[i][:, None] != comps[near][None, :]) & ~(lower[i][:, None] & lower[near][None, :])
            apart &= (sizes[near][None, :] >= least[i][:, None]) & (sizes[near][None, :] <= most[i][:, None])
            if prefix:
                apart &= np.minimum(upto[i][:, None], upto[near][None, :]) * (100 + rules.percent) >= rules.percent * (sizes[i][:, None] + sizes[near][None, :])
            if low == high:
                apart &= (ids[i][:, None] < ids[near][None, :]) | ~lead[near][None, :]
            x, y = np.nonzero(apart)
            x, y = i[x], near[y]
            if len(x):
                keep = close(sigs, x, y, rules.near)
                x, y = x[keep], y[keep]
            if len(x) and not prefix:
                keep = _first_key(sigs[x], sigs[y], rules) == key
                x, y = x[keep], y[keep]
            found.append(np.stack([ids[x], ids[y]]))
        both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return both.min(0), both.max(0)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table]).combine_chunks()
            keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("key", "prefix", "band", "low", "high")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            done = int(cuts[-1]) if len(cuts) else 0
            rest = table.slice(done)
            if done:
                yield runs(table.slice(0, done), [0, *cuts.tolist()])
        if rest is not None and rest.num_rows:
            yield runs(rest, [0, rest.num_rows])

    def runs(table: pa.Table, cuts: list[int]) -> pa.RecordBatch:
        column = lambda c: table.column(c).to_numpy()
        key, prefix, low, high = (column(c) for c in ("key", "prefix", "low", "high"))
        rows_ = [column(c) for c in ("own", "lower", "lead", "most", "id", "component", "n_shingles")]
        rows_.append(np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(len(key), -1))
        got = [compare(key[i], prefix[i], low[i], high[i], *(r[i:j] for r in rows_)) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([g[k] for g in got])) for k in (0, 1)], ["a", "b"])

    return placed.repartition("key", "prefix", "band", "low", "high").sortWithinPartitions("key", "prefix", "band", "low", "high").mapInArrow(task, "a long, b long")


def near_duplicates(docs: DataFrame, rules: NearRules = NearRules()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs."""
    return _labelled(docs, stored(signatures(docs, rules)), rules)


def _labelled(docs: DataFrame, rows: DataFrame, rules: NearRules) -> DataFrame:
    with_id = rows.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    classes = stored(with_id.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("n")))
    index = _index(classes, rules)
    star = stored(index.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n"), F.max("id").alias("m")).where("a <> m").select("key", "a", "n"))
    shared = stored(spread_join(index, star.select("key", "a"), "key", "id", counts=star))  # keys of at least two documents
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    sig = classes.select("id", F.col("sig").alias("value"))
    starred = stored(_distances(shared.where("a <> id").select("a", F.col("id").alias("b")).distinct(), sig, rules.near, np.uint16, rules.group))
    linked = stored(_confirmed(starred, texts, rules))
    # rows of one id with several texts are one document: it is linked with the class of each
    several = with_id.groupBy("doc_id").agg(F.min("digest").alias("d0"), F.max("digest").alias("d1")).where("d0 <> d1").select("doc_id")
    same = stored(with_id.join(several, "doc_id").select("doc_id", "digest").distinct().join(classes.select("digest", "id"), "digest").select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
    first = stored(components(linked.unionByName(same)))
    labelled = stored(shared.join(first.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")))
    mixed_keys = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    left = stored(spread_join(labelled, mixed_keys, "key", "id", counts=star))  # key, id, component
    keyed = stored(_keyed(left, texts, rules)).join(classes.select("id", "n_shingles", "sig").where(F.col("n_shingles") >= rules.least), "id")
    more = stored(_across(keyed, rules).distinct().join(starred, ["a", "b"], "left_anti"))
    fine = stored(_fine(_ends(more, texts), rules))
    more = stored(_distances(more, fine, rules.fine_near, np.uint8, rules.group))
    linked_more = stored(_confirmed(more, texts, rules))
    last = stored(components(linked.unionByName(same).unionByName(linked_more)))
    class_of = classes.join(last.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    plain = rows.where("digest IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    out = spread_join(rows.where("digest IS NOT NULL"), class_of, "digest", "doc_id", "left", counts=classes).select("doc_id", "n_shingles", "component_id").unionByName(plain)
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, rules: NearRules = NearRules()) -> DataFrame:
    """The rows of docs that stay: one of each group, with its own columns, and those without id.

    Of rows that share the id that stays, it is the one whose text comes first in
    order of bytes (a null last), then the one whose other columns do as JSON.
    """
    found = stored(near_duplicates(docs, rules).where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "kept"))
    gone = stored(found.where("NOT kept").select("id").distinct())
    several = stored(found.where("kept").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.lit(0)))
    rows = with_row(docs, id=F.col("doc_id").cast("long"), text=F.col("text"), others=others).where("id IS NOT NULL")
    rows = rows.join(checked_broadcast(gone, gone.count()), "id", "left_anti")
    few = checked_broadcast(several, several.count())
    first = F.min_by("row", F.struct(F.col("text").isNull(), "text", "others"))  # combined in each task before the shuffle
    one = rows.join(few, "id", "left_semi").groupBy("id").agg(first.alias("row")).select("row.*")
    return rows.join(few, "id", "left_anti").select("row.*").unionByName(one).unionByName(docs.where("doc_id IS NULL"))

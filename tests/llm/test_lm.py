"""op1 against brute force: counts, windows, training over all rows, and probabilities that sum to at most 1."""

import collections
import dataclasses
import math
import unicodedata
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talus.llm import attention, lm
from talus.llm.queries import fold
from talus.llm.shared import stored

SMALL = lm.LMRules(attention=attention.AttentionRules(every=64, rounds=1), block_words=300)


def held(doc, folds=7):
    return doc is not None and zlib.crc32(str(doc).encode()) % folds == 2


def words(t):
    return (t or "").encode().lower().split()


def test_base_score_and_counts(spark, docs, empty, tokenizer):
    run = lambda df: lm.score(df, tokenizer, learn=fold(7) != 2, held_out=fold(7) == 2, rules=SMALL)
    rows, got = docs.collect(), run(docs).collect()
    count = collections.Counter()
    for r in rows:
        if r["doc_id"] is not None and not held(r["doc_id"]):
            count.update([*words(r["text"]), None])
    n, v = sum(count.values()), len(count)
    want = sorted(
        ((-1 if r["doc_id"] is None else r["doc_id"]), held(r["doc_id"]), len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 5))
        for r in rows for w in [[*words(r["text"]), None]]
    )
    assert sorted(((-1 if g["doc_id"] is None else g["doc_id"]), g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"], round(g["base_score"], 5)) for g in got) == want
    assert all(-math.inf < g["score"] < 0 for g in got) and len({round(g["score"], 6) for g in got if g["doc_id"] == 71}) == 1
    assert run(empty).count() == 0


def test_words_are_those_between_ascii_white_space():
    texts = ["".join(chr(c) for c in range(128)) * 2, " a\x0bB\x0cc\r\nd\te ", "É x\x1cy\x85z", "", None, "  ", "Ab aB AB"]
    distinct, codes, lengths = lm.words_of(pa.array(["skipped", *texts], pa.string()).slice(1))
    assert lengths.tolist() == [len(words(t)) for t in texts]
    assert [distinct[c].encode() for c in codes] == [w for t in texts for w in words(t)]


def model_of(ids, v, rules):
    rng = np.random.default_rng(1)
    count = np.bincount(ids, minlength=v).astype(float)
    m = attention.grouped(count, rng.integers(0, 9, (v, 2 * rules.neighbours)).astype(np.float32), rules)
    follow = np.zeros((rules.rows, rules.classes))
    np.add.at(follow, (m.row[ids[:-1]], m.cls[ids[1:]]), 1)
    m = attention.with_direct(m, follow)
    at = attention.training_windows(np.array([len(ids)]), 0.5, rules.every)[:, None] + np.arange(rules.window)
    at = np.minimum(at, len(ids) - 2)
    batches = [(m.row[ids[at]], m.cls[ids[at + 1]])] * 20
    return attention.averaged(m, attention.weighted(*attention.train(m, iter(batches), rules)))


def test_attention_windows_equal_whole_text():
    """Each id's class probability against a plain loop over its own window."""
    rules = attention.AttentionRules(rows=64, classes=12, heads=4, states=8, neighbours=20, every=20, window=12, stride=8)
    ids = np.random.default_rng(0).integers(0, 50, 500).astype(np.int32)
    m = model_of(ids, 60, rules)
    lengths = np.array([1, 7, 8, 9, 40, 0, 100])
    starts = np.cumsum(lengths) - lengths
    got = attention.class_logs(m, ids[: lengths.sum()], starts, lengths, 5, rules, windows=3)
    for s, n in zip(starts, lengths, strict=True):
        x = m.row[np.concatenate([[5], ids[s : s + n]])]
        for t in range(n):
            first = max(0, t // 8 * 8 - 4)
            seen = x[first : t + 1]
            a = m.query[x[t]] @ m.key[seen].T + m.distance[np.arange(len(seen))[::-1]]
            a = np.exp(a - a.max())
            z = (a / a.sum()) @ m.value[seen] @ m.out + m.direct[x[t]]
            assert abs(z[m.cls[ids[s + t]]] - np.log(np.exp(z - z.max()).sum()) - z.max() - got[s + t]) < 1e-3


def test_training_gradient():
    """A step's direction against differences of the loss."""
    rules = attention.AttentionRules(rows=12, dims=3, classes=5, heads=2, states=4, neighbours=4, window=5, stride=3, rate=1e-4)
    rng = np.random.default_rng(3)
    m = attention.grouped(rng.random(9), rng.random((9, 8)).astype(np.float32), rules)
    m = attention.with_direct(m, rng.random((12, 5)))
    x, y = rng.integers(0, 12, (2, 5)), rng.integers(0, 5, (2, 5))

    def loss(p):
        total = 0.0
        for i in range(2):
            for t in range(5):
                seen = x[i, : t + 1]
                a = p["query"][x[i, t]] @ p["key"][seen].T + p["distance"][np.arange(t + 1)[::-1]]
                a = np.exp(a - a.max())
                z = (a / a.sum()) @ p["value"][seen] @ p["out"] + m.direct[x[i, t]]
                total -= z[y[i, t]] - np.log(np.exp(z).sum())
        return total / 10

    start = {k: getattr(m, k).astype(np.float64) for k in attention.BY_ROW + attention.WHOLE}
    after, seen, n = attention.train(m, iter([(x, y)]), rules)
    assert n == 2 and (seen == np.bincount(x.ravel(), minlength=12)).all()
    for name, w in start.items():
        for at in [np.unravel_index(i, w.shape) for i in rng.permutation(w.size)[:12]]:
            up, down = ({k: a.copy() for k, a in start.items()} for _ in range(2))
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            g = (loss(up) - loss(down)) / 2e-5
            moved = (after[name][at] - w[at]) * np.sqrt(1e-4 + g * g) / -rules.rate
            assert abs(moved - g) < 1e-2 * max(abs(g), 0.02)


def test_every_text_trains():
    sizes = np.array([1, 5, 64, 127, 128, 1000])
    at = attention.training_windows(sizes, 0.3, 64)
    owner = np.searchsorted(np.cumsum(sizes), at, "right")
    assert np.bincount(owner).tolist() == [1, 1, 1, 1, 2, 15]


def test_windows_back_to_back_hold_every_id_once():
    for size, width, parts in ((1000, 24, 2), (1, 24, 2), (48, 24, 3), (49, 24, 1), (0, 24, 2)):
        at = np.concatenate([attention.back_to_back(part, parts, size, width) for part in range(parts)])
        held = (at[:, None] + np.arange(width)).ravel()
        assert sorted(held[held < size]) == list(range(size)) and len(at) == -(-size // width)


def test_every_id_of_every_text_trains(spark, tokenizer, monkeypatch):
    """Under the rules' own windows and rounds, the rows that training saw are those of all ids of the texts to learn from."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 500, n)) for n in (3000, 1, 40, 700)] + ["", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").coalesce(1).withColumn("held_out", F.lit(False)).withColumn("learn", F.lit(True))
    own = attention.AttentionRules()
    rules = lm.LMRules(attention=attention.AttentionRules(rows=400, heads=6, classes=16, states=12, neighbours=10))
    blocks = stored(lm.coded_blocks(rows, tokenizer, rules))
    found = []
    monkeypatch.setattr(lm, "averaged", lambda m, total: found.append((m, total)) or attention.averaged(m, total))
    lm.fitted(blocks, tokenizer, rules)
    b = lm.Block(blocks.first().asDict(), tokenizer)
    closed = np.append(lm._end_id(tokenizer), b.expand(b.to_learn()[0]))
    windows = -(-(len(closed) - 1) // own.window)
    want = np.bincount(found[0][0].row[closed[np.arange(windows * own.window) % len(closed)]], minlength=400)  # the last window goes on at the beginning
    assert len(found) == own.rounds and sum(total[0] for _, total in found) == windows
    assert (sum(total[1:401] for _, total in found) == want).all()


@pytest.fixture(scope="module")
def learnt(spark, tokenizer):
    texts = ["the cat and the dog and the horse don't"] * 20 + ["a lion saw the tiger, didn't it? É"] * 5 + ["one whale", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").repartition(3).withColumn("held_out", F.lit(False)).withColumn("learn", F.lit(True))
    rules = lm.LMRules(attention=attention.AttentionRules(rows=40, heads=6, classes=16, states=12, neighbours=10, every=8), table_keys=5000, tree=2)
    blocks = stored(lm.coded_blocks(rows, tokenizer, rules))
    return texts, rules, *lm.fitted(blocks, tokenizer, rules)


def test_counts_are_those_of_all_texts(learnt, tokenizer):
    from tokenizers import Tokenizer

    texts, rules, model, counts, ids = learnt
    t, a, v = Tokenizer.from_file(tokenizer), rules.attention, len(ids) // 2
    end = t.token_to_id("<|endoftext|>")
    want, ends, each = collections.Counter(), np.zeros(v), np.zeros(v)
    for x in texts:
        before = end
        for w in [*(x or "").lower().split(), None]:
            own = [end] if w is None else t.encode(w, add_special_tokens=False).ids
            for i in own:
                want[int(model.state[before]) * v + i] += 1
                want[a.states * v + int(model.row[before]) * a.classes + int(model.cls[i])] += 1
                each[i] += 1
                before = i
            ends[own[-1]] += w is not None
    assert (np.concatenate([each, ends]) == ids).all()
    assert {int(k): counts[k] for k in np.flatnonzero(counts)} == want


def test_windows_are_those_of_the_stream(spark, learnt, tokenizer):
    _, rules, *_ = learnt
    texts = ["one two three", "", "a\u00a0b \u00a0 c", "the whale and the lion saw it"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").coalesce(1).withColumn("held_out", F.lit(False)).withColumn("learn", F.lit(True))
    b = lm.Block(lm.coded_blocks(rows, tokenizer, rules).first().asDict(), tokenizer)
    words, count = b.to_learn()
    stream = b.expand(words)
    closed = np.append(lm._end_id(tokenizer), stream)
    sizes = np.diff(np.cumsum(b.lens[words])[words == b.end], prepend=0)
    at = attention.training_windows(sizes, 0.5, 2)
    assert (b.windows(words, 2, 0.5, 6) == closed[(at[:, None] + np.arange(6)) % len(closed)]).all() and len(at) >= 4
    before, ids, times = b.pairs(words, count)
    got = collections.Counter()
    for x, y, k in zip(before.tolist(), ids.tolist(), times.tolist(), strict=True):
        got[x, y] += k
    assert got == collections.Counter(zip(closed.tolist(), stream.tolist(), strict=False))


def test_probabilities_sum_to_at_most_one(learnt, tokenizer):
    """Over the next id, over stops, over seen words and the unseen rest, in several contexts."""
    texts, rules, model, counts, ids = learnt
    from tokenizers import Tokenizer

    t, v = Tokenizer.from_file(tokenizer), len(ids) // 2
    end = lm._end_id(tokenizer)
    m = lm.WordModel(model, counts, ids, end, rules)
    for context in ("", "the", "a lion saw", "whale don't"):
        before = np.array(t.encode(context, add_special_tokens=False).ids, np.int32)
        stream = np.concatenate([np.append(before, i) for i in range(0, v, 7)])  # each as a text of its own
        n = np.full(len(range(0, v, 7)), len(before) + 1)
        some = m.id_logs(stream, np.cumsum(n) - n, n)[np.cumsum(n) - 1]
        classes = attention.class_logs(model, np.concatenate([np.append(before, np.flatnonzero(model.cls == c)[:1]) for c in np.unique(model.cls)]).astype(np.int32), np.arange(len(np.unique(model.cls))) * (len(before) + 1), np.full(len(np.unique(model.cls)), len(before) + 1), end, rules.attention)
        by_class = np.exp(classes.reshape(-1)[len(before) :: len(before) + 1].astype(float)).sum()
        assert abs(by_class - 1) < 1e-3 and np.isfinite(some).all()
        last = np.full(v, before[-1] if len(before) else end)
        within = np.bincount(model.cls, weights=10.0 ** m.pair_logs(last, np.arange(v)).astype(float))
        assert np.abs(within[np.unique(model.cls)] - 1).max() < 1e-3
    assert np.abs(10.0**m._stop + 10.0**m._more - 1).max() < 1e-6 and abs((10.0**m._alone).sum() - 1) < 1e-9
    seen = collections.Counter(w for x in texts for w in [*words(x), None])
    n, k = sum(seen.values()), len(seen)
    assert abs(sum((c + 1) / (n + k + 1) for c in seen.values()) + 1 / (n + k + 1) - 1) < 1e-12  # the unseen rest is one share
    # spellings of one canonical letter: the letter itself and at most 64 others
    assert (1 - 2 * rules.variant) + 64 * rules.variant / 64 < 1
    for word in ("É", "ét", "Σας", "a b", "x<|endoftext|>"):
        assert lm.unusual(word) >= 1
    for word in ("état", "don't", "한국", "ß", "a.b"):
        assert lm.unusual(word) == 0 and unicodedata.is_normalized("NFC", word)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test data")
def test_attention_helps_on_held_out_texts(spark, tokenizer):
    """Without the attended value, ids of held-out texts are less likely. The table is small, so windows stand closer than in production."""
    rules = lm.LMRules(attention=attention.AttentionRules(every=24, rounds=4))
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", (fold(7) == 2).alias("held_out"), (fold(7) != 2).alias("learn"))
    blocks = stored(lm.coded_blocks(rows, tokenizer, rules))
    model, counts, ids = lm.fitted(blocks, tokenizer, rules)
    end = lm._end_id(tokenizer)
    b = lm.Block(blocks.first().asDict(), tokenizer)
    out = b.flags % 2 == 1
    words = b.closed(b.codes[np.repeat(out, b.lengths)], b.lengths[out])
    stream, n = b.expand(words), np.diff(np.cumsum(b.lens[words])[words == b.end], prepend=0)
    logs = [lm.WordModel(m, counts, ids, end, rules).id_logs(stream, np.cumsum(n) - n, n).mean() for m in (model, dataclasses.replace(model, out=np.zeros_like(model.out)))]
    assert logs[0] > logs[1] + 0.02


def test_words_are_numbered_over_ranges():
    """Ranges of texts give the numbers that all texts give at once, and are put together only where the bound could be reached."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"W{x}é" for x in rng.integers(0, 90, n)) + " " for n in (40, 0, 300, 7)] + [None, " <| x<|y É "]
    column = pa.array(texts, pa.string())
    index = lm._Numbers()
    lengths = np.concatenate([index.add(column.slice(a, 2)) for a in (0, 2, 4)])
    assert not index.as_many_as(10_000) and len(index._new) == 3
    assert index.as_many_as(50) and not index._new
    distinct, codes = index.all()
    want, want_codes, want_lengths = lm.words_of(column)
    assert distinct.to_pylist() == want and (codes == want_codes).all() and (lengths == want_lengths).all()
    assert want == list(dict.fromkeys(w.decode() for t in texts for w in words(t)))
    odd = pa.array([*want, "a b", "é", "<|<|é"])
    assert lm.all_unusual(odd).tolist() == [lm.unusual(w) for w in odd.to_pylist()]


def test_large_logits_train_as_in_plain_arithmetic():
    """Where exponentials would run over, the maximum is taken off: tables stay finite and follow the loss."""
    rules = attention.AttentionRules(rows=12, dims=4, classes=5, heads=2, states=4, neighbours=4, window=5, stride=3)
    rng = np.random.default_rng(3)
    m = attention.with_direct(attention.grouped(rng.random(9), rng.random((9, 8)).astype(np.float32), rules), rng.random((12, 5)))
    x, y = rng.integers(0, 12, (2, 5)), rng.integers(0, 5, (2, 5))
    shifted = dataclasses.replace(m, direct=m.direct + np.float32(200))
    plain, large = (attention.train(k, iter([(x, y)]), rules)[0] for k in (m, shifted))
    assert all(np.isfinite(large[k]).all() and np.abs(plain[k] - large[k]).max() < 1e-3 for k in plain)
    steep = dataclasses.replace(m, query=m.query * 300, key=m.key * 300)
    assert all(np.isfinite(w).all() for w in attention.train(steep, iter([(x, y)]), rules)[0].values())


def test_lower_case_ascii_letters_need_no_normaliser(tokenizer):
    from tokenizers import Tokenizer

    from talus.llm.subwords import WordEncoder

    e, t = WordEncoder(tokenizer), Tokenizer.from_file(tokenizer)
    assert e._bare.normalizer is None
    some = ["anblewh", "thonre,", "Anly", "été", "É.", "éa", "x<|endoftext|>", "...", "don't", "l'été", "a1b", "ﬁn", "ß", "x\x01y", "straße!"]
    ids, offsets = e.encode_words(some)
    for w, a, b in zip(some, offsets[:-1], offsets[1:], strict=True):
        assert ids[a:b].tolist() == t.encode(w, add_special_tokens=False).ids, w

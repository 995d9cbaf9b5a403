"""The mixture over a text's words against plain loops, and held-out texts against the base score."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.llm import lm
from talus.llm.queries import fold


def test_copies_are_counted_from_earlier_words_alone():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 7, 40, 1, 200])
    starts = np.cumsum(lengths) - lengths
    words = rng.integers(0, 9, int(lengths.sum()))
    got = lm.copied(words, starts, lengths)
    for a, n in zip(starts.tolist(), lengths.tolist(), strict=True):
        own = words[a : a + n].tolist()
        assert got[a : a + n].tolist() == [own[:i].count(own[i]) / i if i else 0.0 for i in range(n)]
    # over all words of the text so far the shares sum to 1
    own = words[starts[4] :].tolist()
    assert all(abs(sum(own[:i].count(w) for w in set(own[:i])) / i - 1) < 1e-12 for i in range(1, 200))
    assert len(lm.copied(words[:0], starts[:0], lengths[:0])) == 0


def plain_log(models, bytewise, rules):
    told = [rules.prior * x for x in (1 - rules.count_share - rules.copy_share, rules.count_share, rules.copy_share)]
    words, total, at, size = rules.prior, 0.0, 0, 8
    while at < len(bytewise):
        n = min(size, len(bytewise) - at)
        shares = [(1 - rules.byte_share) * x / words for x in told]
        for i in range(at, at + n):
            parts = [s * m[i] for s, m in zip(shares, models, strict=True)]
            whole = sum(parts) + rules.byte_share * bytewise[i]
            total += math.log(whole)
            told = [x + p / whole for x, p in zip(told, parts, strict=True)]
        words, at, size = words + n, at + size, min(2 * size, rules.renew)
    return total


def test_weights_follow_earlier_words():
    rng, rules = np.random.default_rng(2), lm.LMRules(byte_share=0.01)
    lengths = np.array([3, 8, 9, 1, 300, 64, 1000])
    starts = np.cumsum(lengths) - lengths
    models = [rng.random(int(lengths.sum())) * s for s in (0.1, 0.01, 0.5)]
    models[2][starts] = 0
    bytewise = rng.random(len(models[0])) * 1e-3
    got = lm.text_logs(models, bytewise, starts, lengths, rules)
    for k, (a, n) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
        assert got[k] == pytest.approx(plain_log([m[a : a + n] for m in models], bytewise[a : a + n], rules))
    # what follows a word changes nothing before it
    cut = lm.text_logs([m[starts[4] : starts[4] + 100] for m in models], bytewise[starts[4] : starts[4] + 100], np.array([0]), np.array([100]), rules)[0]
    assert cut == pytest.approx(plain_log([m[starts[4] : starts[4] + 100] for m in models], bytewise[starts[4] : starts[4] + 100], rules))


def test_all_texts_of_few_words_sum_to_at_most_one():
    """Every sequence of three words out of four, each model a distribution over them."""
    rules = lm.LMRules(byte_share=0.0)
    rng = np.random.default_rng(3)
    a, c = (x / x.sum() for x in rng.random((2, 4)))
    texts = np.array([[i, j, k] for i in range(4) for j in range(4) for k in range(4)]).ravel()
    lengths = np.full(64, 3)
    starts = np.arange(64) * 3
    logs = lm.text_logs([a[texts], c[texts], lm.copied(texts, starts, lengths)], np.zeros(192), starts, lengths, rules)
    # the first word has nothing to copy, so that share of it is lost
    assert np.exp(logs).sum() == pytest.approx(1 - rules.copy_share)


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test data")
def test_held_out_texts_score_above_the_base(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sums = lm.score(docs, tokenizer, learn=fold(7) != 2, held_out=fold(7) == 2).where("held_out").agg(*[(F.sum(c) / F.sum("n_tokens")).alias(c) for c in ("score", "base_score")]).first()
    assert sums["score"] > sums["base_score"] + 0.1

"""The pipeline's near-duplicate stage against brute force, with pairs planted between 0.80 and 0.85."""

import random
import sys
from pathlib import Path

import numpy as np

import corpus_pipeline
from talus.llm import neardup

sys.path.insert(0, str(Path(__file__).parent))
from test_llm import brute_components  # noqa: E402


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def kept(rows, percent):
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return {rows[g][0] for g in group}


def test_rules_follow_from_the_percentage():
    op8, stage = neardup.NearRules(), corpus_pipeline.NEAR
    assert (op8.percent, op8.least, stage.percent, stage.least) == (85, 6, 80, 4)
    for rules in (op8, stage):  # all pairs within the threshold share a key
        assert 2 * rules.chunks - 1 >= rules.near and rules.chunks * rules.width <= rules.symbols


def test_pairs_within_the_threshold_share_a_key(spark):
    rules, rng = neardup.NearRules(), np.random.default_rng(4)
    n = rules.chunks * rules.width
    sig = rng.integers(0, 1 << 16, n).astype(np.uint16)
    rows = [(0, 9, sig.tobytes())]
    for i in range(1, 60):
        other = sig.copy()
        other[rng.permutation(n)[: rules.near]] += 1
        rows.append((i, 9, other.tobytes()))
    keys = {}
    for r in neardup._index(spark.createDataFrame(rows, "id LONG, n_shingles LONG, sig BINARY"), rules).collect():
        keys.setdefault(r["id"], set()).add(r["key"])
    assert all(keys[0] & keys[i] for i in range(1, 60))


def test_hot_documents_and_keys(spark, monkeypatch):
    """Many copies of one text, many near copies of another, many documents of one id: as without groups, bands and copies of rows."""
    from talus.llm import shared

    r = random.Random(5)
    base = [f"w{r.randrange(400)}" for _ in range(120)]
    rows = [(i, " ".join(base)) for i in range(200, 260)] + [(7, "one id with many different texts number " + str(i)) for i in range(30)]
    for i in range(120):
        w = list(base)
        for _ in range(r.randrange(9)):
            w[r.randrange(len(w))] = f"x{r.randrange(9999)}"
        rows.append((i + 20, " ".join(w[: r.randrange(60, 121)])))
    rows += [(500 + i, None if i % 2 else " ") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(5)
    want = sorted(map(str, brute_components(df.collect())))
    monkeypatch.setattr(shared, "KEY_ROWS", 7)
    monkeypatch.setattr(shared.spread_join, "__defaults__", ("inner", 7, None))
    got = neardup.near_duplicates(df, neardup.NearRules(block=10, group=5)).collect()
    assert sorted(str((x["doc_id"], x["n_shingles"], x["component_id"])) for x in got) == want
    first = [r["text"] for r in neardup.deduplicated(df.repartition(3)).where("doc_id = 7").collect()]
    assert first == ["one id with many different texts number 0"]


def test_stage_drops_copies_at_four_fifths(spark):
    r = random.Random(8)
    texts = []
    for n, edits in [(4, 0), (5, 0), (45, 1)] * 4 + [(100, 2), (145, 3), (190, 4)] * 6:  # n shingles each; similarity 0.80 to 0.83
        base = [f"w{r.randrange(10**6)}" for _ in range(n + 4)]
        other = [f"x{r.randrange(10**6)}" if i in {8 + 12 * k for k in range(edits)} else w for i, w in enumerate(base)]
        texts += [" ".join(base), " ".join(other if edits else [*base, "more"])]
    base = [f"w{r.randrange(500)}" for _ in range(150)]
    for _ in range(80):  # edited copies of one text, so that pairs lie between components
        w = list(base)
        for _ in range(r.randrange(2, 9)):
            w[r.randrange(len(w))] = f"x{r.randrange(9999)}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id LONG, text STRING"), "")
    want = kept(rows, 80)
    assert want < kept(rows, 85)
    assert {x["doc_id"] for x in got.collect()} == want and got.count() == len(want)

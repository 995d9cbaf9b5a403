import hashlib

import pytest
from pyspark.sql import functions as F

from talus.operators import audit, hashtree, ranks, workflow
from talus.sources import store


def plain_root(d):
    """The tree by its recursive definition: the left part is the largest power of two."""
    if len(d) == 1:
        return d[0]
    half = 1 << (len(d) - 1).bit_length() - 1
    return hashtree.node_digest(plain_root(d[:half]), plain_root(d[half:]))


class Listed(hashtree.Tree):
    def __init__(self, digests):
        self.digests, self.n, self.root = digests, len(digests), plain_root(digests)

    def _subtree(self, low, high):
        return plain_root(self.digests[low:high])


def test_proofs_of_all_prefixes():
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(40)]
    for n in range(1, 41):
        tree = Listed(digests[:n])
        assert hashtree.folded(digests[:n]) == tree.root
        for m in range(1, n + 1):
            old, proof = plain_root(digests[:m]), tree.consistency_proof(m)
            assert hashtree.extends(m, old, n, tree.root, proof) and len(proof) <= n.bit_length() + 1
            if m < n:
                assert not hashtree.extends(m, plain_root([*digests[: m - 1], "x"]), n, tree.root, proof)
                assert not hashtree.extends(m, old, n, tree.root, proof[:-1]) and not hashtree.extends(m, old, n, "x", proof)
            if m > 2:
                assert not hashtree.extends(m, plain_root([digests[1], digests[0], *digests[2:m]]), n, tree.root, proof)


def test_stored_tree_is_the_plain_one(spark, monkeypatch):
    monkeypatch.setattr(hashtree, "STEP", 2)
    df = spark.range(53).select((F.col("id") * 37 % 53).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("v")).repartition(5)
    rows = hashtree.leaves(df, ["k"]).orderBy("at").collect()
    assert [r["at"] for r in rows] == list(range(53))
    tree = hashtree.build(spark.createDataFrame(rows))
    digests = [r["digest"] for r in rows]
    assert (tree.n, tree.root) == (53, plain_root(digests))
    for m in (1, 7, 16, 32, 48, 52, 53):
        assert tree.consistency_proof(m) == Listed(digests).consistency_proof(m)
    with pytest.raises(ValueError, match="gaps"):
        hashtree.build(spark.createDataFrame(rows[1:]))
    assert hashtree.build(spark.createDataFrame([], "at LONG, digest STRING")).root == hashtree.EMPTY


def test_digest_tells_content_and_order(spark):
    table = lambda rows: spark.createDataFrame(rows, "k LONG, a STRING, b STRING")
    base = [(1, "x", "y"), (2, None, "z"), (3, "x\x1fy", "z"), (4, "p", "q")]
    digest = lambda rows, order: hashtree.content_digest({"t": (table(rows), order)})
    same = digest(base, ["k"])
    assert same == digest(base[::-1], ["k"])
    changed = [
        [(1, "x", "y"), (2, "", "z"), *base[2:]], [*base[:2], (3, "x", "y\x1fz"), base[3]], base[:3], [(1, "p", "q"), *base[1:3], (4, "x", "y")],
    ]
    assert len({same, *[digest(x, ["k"]) for x in changed]}) == 5
    assert digest(base, ["a"]) != same
    sums = {store.content_sha256([table(x)]) for x in [base, *changed]}
    assert len(sums) == 5


def test_places_in_groups(spark):
    rows = [("a", i * 7 % 100) for i in range(100)] + [("b", 5), (None, 1), (None, None)] + [("c", i) for i in range(3)]
    got = ranks.placed(spark.createDataFrame(rows, "g STRING, x INT").repartition(6), ["x"], ["g"]).collect()
    want = {}
    for g, x in sorted(rows, key=lambda r: (r[0] or "", r[1] is not None, r[1] or 0)):
        want.setdefault(g, []).append(x)
    assert sorted((str(r["g"]), r["place"], r["x"]) for r in got) == sorted((str(g), i, x) for g, own in want.items() for i, x in enumerate(own, 1))


def test_chains_with_nulls_and_large_numbers(spark):
    big = 2**53 + 1
    rows = [(None, "k1", "2023-01-01", big), (None, None, "2023-01-02", None), (None, None, "2023-01-02", 3), ("a", "k2", "2023-01-01", None), ("a", "k2", "2023-01-02", 1)]
    events = spark.createDataFrame(rows, "alert_id STRING, event_key STRING, occurred_at STRING, tokens_in LONG")
    log = store.staged(audit.append(events, "alert_id"))
    got = sorted((r["alert_id"] or "", r["seq"], r["event_key"] or "", r["tokens_in"] or 0) for r in log.collect())
    assert [x[:2] for x in got] == [("", 1), ("", 2), ("", 3), ("a", 1)] and ("", 1, "k1", big) in got
    assert audit.verify(log.where("alert_id IS NULL")).first()["valid"]
    more = audit.append(events.where("event_key IS NOT NULL OR tokens_in = 3"), "alert_id", log=log).collect()
    assert [(r["seq"], r["prev_hash"]) for r in more] == [(4, next(r["hash"] for r in log.collect() if r["alert_id"] is None and r["seq"] == 3))]


def test_text_around_the_answer_is_refused(spark):
    good = '{"t":"Structuring","c":0.5,"r":"COMUNICAR","e":[1]}'
    cases = {good: True, f" \n{good}\t": True, f"{good} trailing": False, f"{good}{good}": False, f"x{good}": False, "": False, "null": False, f"[{good}]": False}
    df = spark.createDataFrame([(k,) for k in cases], "a STRING").select("a", workflow.expanded_output(F.col("a")).isNotNull().alias("ok"))
    assert {r["a"]: r["ok"] for r in df.collect()} == cases

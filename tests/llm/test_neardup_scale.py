"""Texts of one template, recall over documents, and rows that share an id."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from talus.llm import neardup

SF = "/root/testdata/sf0.01/documents.parquet"


def pages(n, seed=1):
    """Texts of one template of 100 words, three of them changed in each."""
    r = random.Random(seed)
    base = [f"t{i}" for i in range(100)]
    out = []
    for i in range(n):
        words = list(base)
        for at in r.sample(range(100), 3):
            words[at] = f"x{r.randrange(10**6)}"
        out.append((i, " ".join(words)))
    return out


def candidates(spark, n, rules):
    docs = spark.createDataFrame(pages(n), "doc_id LONG, text STRING").repartition(4)
    sig = neardup.signatures(docs, rules).withColumnRenamed("doc_id", "id")
    rows = neardup._index(sig, rules).withColumn("component", F.col("id"))
    keyed = neardup._keyed(rows, docs.withColumnRenamed("doc_id", "id"), rules)
    per = keyed.groupBy("prefix", "key").agg(F.count("*").alias("n"), F.count_if("lead").alias("leading"))
    return per.agg(F.sum(F.when(F.col("prefix"), F.col("leading") * (F.col("n") - 1)).otherwise(F.expr("n * (n - 1) div 2")))).first()[0]


def test_candidates_of_one_template_do_not_grow_with_its_square(spark):
    rules = neardup.NearRules()
    few, many = candidates(spark, 600, rules), candidates(spark, 4800, rules)
    assert many < 12 * few and many < 4800 * 4799 / 2 / 20


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    group = {i: i for i, _ in rows}
    by: dict = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(min(i, j), max(i, j)) for own in by.values() if len(own) < 400 for a, i in enumerate(own) for j in own[:a]}

    def find(x):
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for i, j in pairs:
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            group[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


@pytest.mark.parametrize("large", [64, 4])
def test_template_with_planted_near_copies(spark, large):
    rows = pages(400, 2)
    r = random.Random(4)
    for k in range(60):  # copies with one more word changed at the end
        i, text = rows[r.randrange(400)]
        words = text.split()
        words[-1 - k % 3] = f"y{k}"
        rows.append((400 + k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3)
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(docs, neardup.NearRules(large=large)).collect()}
    sets = {i: shingles(t) for i, t in rows}
    want = {i: i for i, _ in rows}
    for i, _ in rows:
        for j in range(i):
            if want[i] != want[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = {k: new if v == old else v for k, v in want.items()}
    assert got == want and len(set(want.values())) < 430


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_all_links_of_documents_are_found(spark):
    docs = spark.read.parquet(SF)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(docs).collect()}
    assert got == brute(rows, 85)


def test_rows_that_share_an_id_leave_one(spark):
    rows = [(1, "b text of several words here", "x")] * 40 + [(1, "a text of several words here", "y"), (1, "a text of several words here", "x"), (1, None, "a"), (2, "quite another text of some words", "z"), (None, "z", "z"), (None, "z", "z")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING").repartition(3)
    got = sorted(neardup.deduplicated(docs).collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(1, "a text of several words here", "x"), (2, "quite another text of some words", "z"), (None, "z", "z"), (None, "z", "z")], key=lambda t: f"Row(doc_id={t[0]!r}, text={t[1]!r}, lang={t[2]!r})")

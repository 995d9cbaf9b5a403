"""Repair of conversations, periodic runs and decontamination against brute force and their SQL."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from talus.llm import decontaminate, repeats, turns


def by_sql(tables, sql):
    import duckdb

    c = duckdb.connect()
    for name, df in tables.items():
        held = pa.Table.from_pylist([r.asDict() for r in df.collect()], schema=df.limit(0).toArrow().schema)
        c.register(name, held)
    got = c.sql(sql)
    return collections.Counter(got.fetchall()), got.columns


def same_as_sql(df, tables, sql):
    want, names = by_sql(tables, sql)
    assert sorted(names) == sorted(df.columns)
    assert collections.Counter(tuple(r) for r in df.select(*names).collect()) == want


# --- periodic runs


def brute_runs(words):
    n, got = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                got.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in got.items())


def brute_periods(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, words = g % n, list(words)
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


@pytest.fixture(scope="module")
def periodic(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randrange(0, 90)))) for i in range(120)]
    rows += [(i, " ".join([r.choice("abcdefgh") for _ in range(r.randrange(1, 40))] * r.randrange(1, 6) + ["x"] * r.randrange(0, 20))) for i in range(120, 220)]
    rows += [(220, "same " * 700), (221, None), (222, ""), (223, " \t\n\x0b\x0c\r "), (224, "one"), (None, "a b " * 20), (225, "é ü " * 9), (225, "é ü " * 9)]
    rows += [(226, " ".join(str(i % 97) for i in range(2500)))]
    return spark.createDataFrame([(*x, 1, "clash") for x in rows], "doc_id LONG, text STRING, start INT, row STRING").repartition(3)


@pytest.mark.parametrize("rules", [repeats.RunRules(), repeats.RunRules(lags=50), repeats.RunRules(chunk=1)])
def test_runs_are_those_of_brute_force(periodic, rules):
    want = collections.Counter(brute_periods(r["doc_id"], r["text"]) for r in periodic.collect())
    assert collections.Counter(tuple(r) for r in repeats.periodic_runs(periodic, rules).collect()) == want
    assert sum(n for k, n in want.items() if k[1]) > 100


def test_runs_by_sql_and_on_documents(periodic, docs, empty):
    same_as_sql(repeats.periodic_runs(periodic), {"documents": periodic}, repeats.ORACLE_SQL)
    plain = docs.select("doc_id", "text", "lang", "id")
    same_as_sql(repeats.periodic_runs(docs), {"documents": plain}, repeats.ORACLE_SQL)
    assert repeats.periodic_runs(empty).count() == 0


def test_ranges_of_lags_have_the_same_runs():
    ids = np.array([0, 1, 2] * 40 + [5] * 30 + list(range(6, 90)) * 2, np.int32)
    whole = repeats.stretches(ids, np.array([len(ids)]), 12)
    parts = {}
    for low in range(1, len(ids) // 2 + 1, 7):
        for k, p in repeats.stretches(ids, np.array([len(ids)]), 12, low, low + 6).items():
            parts[k] = min(p, parts.get(k, p))
    assert parts == whole and (0, 120) in whole and whole[0, 120] == 3


# --- decontamination


def split(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isascii() and c.isalnum() or ord(c) >= 128 else " " for c in low).split(" ") if low else []


def brute_leaks(doc_id, text, items):
    words = [w for w in split(text) if w]
    hit, named = set(), set()
    for item_id, item in items:
        own = [w for w in split(item) if w]
        k = min(10, len(own))
        windows = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if k else set()
        for i in range(len(words) - k + 1 if k else 0):
            if tuple(words[i : i + k]) in windows:
                hit.update(range(i, i + k))
                named |= {str(item_id)} - {"None"}
    return doc_id, len(words), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def leaks(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)] + ["é", "Ünd", "A1"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(10, 40)))) for i in range(20)]
    items += [(i, " ".join(f"rare{i}x{j}" for j in range(i - 19))) for i in range(20, 29)]  # one to nine words
    items += [(3, items[5][1]), (30, None), (31, "--- !!"), (None, "a passage without any item id has to be marked though here it is"), (32, items[4][1]), (33, "A, B. c!\x00d"), (34, "same " * 12)]
    rows = []
    for i in range(150):
        words = [r.choice(vocabulary) for _ in range(r.randrange(0, 120))]
        if i % 3 == 0:
            own = r.choice(items[:29] + items[31:])[1] or ""
            at = r.randrange(len(words) + 1)
            words[at:at] = own.upper().split(" ") if own.isascii() else own.split(" ")
        rows.append((i, r.choice([" ", ", ", "\n", "\x00"]).join(words)))
    rows += [(150, None), (151, ""), (None, items[0][1]), (152, "x " * 3000 + items[1][1]), (153, items[2][1]), (153, items[2][1]), (154, "same " * 400), (155, "intro " + items[33][1] + " end"), (156, "a b c d")]
    docs = spark.createDataFrame([(*x, "y", 2) for x in rows], "doc_id LONG, text STRING, item_id STRING, n_hit INT").repartition(3)
    bench = spark.createDataFrame([(*x, 7) for x in items], "item_id LONG, text STRING, doc_id INT")
    return docs, bench, items


@pytest.mark.parametrize("rules", [decontaminate.LeakRules(), decontaminate.LeakRules(slice_bytes=400), decontaminate.LeakRules(block=1)])
def test_leaks_are_those_of_brute_force(leaks, rules):
    docs, bench, items = leaks
    want = collections.Counter(brute_leaks(r["doc_id"], r["text"], items) for r in docs.collect())
    assert collections.Counter(tuple(r) for r in decontaminate.contaminated(docs, bench, rules).collect()) == want
    assert sum(n for k, n in want.items() if k[5]) > 40


def test_leaks_by_sql_pieces_and_empty_tables(leaks, monkeypatch):
    docs, bench, items = leaks
    same_as_sql(decontaminate.contaminated(docs, bench), {"documents": docs.select("doc_id", "text"), "benchmark": bench.select("item_id", "text")}, decontaminate.ORACLE_SQL)
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    none = decontaminate.contaminated(docs, bench.limit(0)).collect()
    assert len(none) == docs.count() and not any(r["contaminated"] or r["n_hit"] for r in none)
    pieces = decontaminate.pieces_of(bench, decontaminate.LeakRules())
    assert {r["item_id"] for r in pieces.collect()} == {str(i) if i is not None else None for i, t in items if any(split(t))}


# --- conversations


def brute_audit(rows, charges=turns.Charges()):
    """The best of all edits: every way of inserting up to two turns before each row and at the end."""
    best = []

    def legal(initials):
        s = initials[1:] if initials[:1] == "s" else initials
        return initials == "" or len(s) > 0 and s == "ua" * (len(s) // 2)

    def go(i, cost, audit, initials):
        if best and (cost, audit) > best[0] and cost > best[0][0]:
            return
        for more in ([], ["u"], ["a"], ["u", "a"], ["a", "u"]):
            c, a, x = cost + charges.insert * len(more), audit + "I" * len(more), initials + "".join(more)
            if i == len(rows):
                if legal(x) and (not best or (c, a, x) < best[0]):
                    best[:] = [(c, a, x)]
                continue
            initial, fault, copies = rows[i]
            go(i + 1, c + charges.delete, a + "D", x)
            if fault not in (1, 2):
                cut = charges.truncated * (fault == 3)
                go(i + 1, c + cut, a + "K", x + (initial or "?"))
                go(i + 1, c + cut + charges.rerole, a + "R", x + "u")
                go(i + 1, c + cut + charges.rerole, a + "R", x + "a")

    go(0, 0, "", "")
    return best[0][:2]


def test_edits_are_the_cheapest():
    r = random.Random(8)
    for _ in range(250):
        rows = [(r.choice("suaax"), r.choice([0, 0, 0, 1, 2, 3]), 0) for _ in range(r.randrange(0, 5))]
        ((got),) = turns.best_edits(rows, turns.Charges()).values()
        assert got == brute_audit(rows), rows


def talk(r, conv, n):
    for t in range(n):
        role = r.choices(["user" if t % 2 else "assistant", "user", "assistant", "system", "tool", ""], [6, 3, 3, 2, 1, 1])[0]
        text = r.choice(["Yes.", "No!", "Why?", "no end", "", " \t", "A. b.", f"word {t}. ", f"word {t}", "é?"])
        yield conv, t if r.random() < 0.9 else r.choice([None, 1, t + 3]), role if r.random() < 0.95 else None, text if r.random() < 0.95 else None


@pytest.fixture(scope="module")
def talks(spark):
    r = random.Random(9)
    rows = [x for conv in range(60) for x in talk(r, conv, r.randrange(1, 9))] + list(talk(r, None, 7)) + list(talk(r, 60, 40))
    rows += [(61, 0, "user", "Hi.")] * 4 + [(i, 0, "user", "Hello there.") for i in range(62, 120)] + [(None, None, None, None)]
    return spark.createDataFrame([(*x, "a", 3) for x in rows], "conv_id LONG, turn LONG, role STRING, text STRING, audit STRING, copies INT").repartition(3)


@pytest.mark.parametrize("rules", [turns.RepairRules(), turns.RepairRules(cell=4), turns.RepairRules(cell=1)])
def test_repairs_are_those_of_the_sql(talks, rules):
    same_as_sql(turns.repair(talks, rules), {"conversations": talks.select("conv_id", "turn", "role", "text")}, turns.ORACLE_SQL)


def test_copies_long_conversations_and_empty_tables(spark, talks):
    rows = [(1, None if i % 7 == 0 else i % 50, "user" if i % 3 else "assistant", f"{i % 40}." if i % 5 else "cut") for i in range(1500)]
    df = spark.createDataFrame([(*x, 3) for x in rows], "conv_id LONG, turn LONG, role STRING, text STRING, copies LONG")
    got = [turns.repaired(df, df, turns.RepairRules(cell=cell)).collect() for cell in (8, 64, 4096)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 1 and len(got[0][0]["audit"].replace("I", "")) == 4500
    assert turns.repair(talks.limit(0)).count() == 0

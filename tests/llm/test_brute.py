"""Quality scores, decoded languages and the whole pipeline against plain Python over each stage's own input."""

import collections
import hashlib
import math
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from talus.llm import langid, mixing, neardup, quality
from talus.llm.queries import fold

sys.path.insert(0, str(Path(__file__).parent))
from test_pipeline_near import kept as kept_near  # noqa: E402

SPACE = b"\t\n\x0b\x0c\r "


def naive_statistics(text):
    b = (text or "").encode()
    words = b.split()
    lower = [w.lower() for w in words]
    solid = max(1, sum(c not in SPACE for c in b))
    kind = lambda c: "u" if 65 <= c <= 90 else "d" if 48 <= c <= 57 else "l" if c >= 128 or 97 <= c <= 122 else " " if c in SPACE else "s"
    kinds = collections.Counter(map(kind, b))
    wide = sum(1 for x in (text or "") if 0xC0 <= ord(x) <= 0xDE and ord(x) != 0xD7)
    upper, some = kinds["u"] + wide, max(1, len(words))
    lone = sum(len(w) == 1 and kind(w[0]) == "s" for w in words)
    lines = [x for x in b.split(b"\n") if x.strip()]
    return [
        len(words), max(0, kinds["s"] - 3) / solid, upper / max(1, upper + kinds["l"]), max(0, kinds["d"] - 16) / solid, lone / some,
        sum(x == y for x, y in zip(lower, lower[1:], strict=False)) / some, len(set(lower)) / some, 1 - len(set(lines)) / len(lines) if lines else 0, solid / some, sum(len(w) < 4 for w in words) / some,
    ]


def naive_votes(s):
    words, symbols, capitals, digits, lone, repeats, distinct, again, length, short = s
    if words == 0:
        return [-1] * 9
    pick = lambda good, bad: -1 if bad else 1 if good else 0
    many = words >= 20
    return [
        pick(symbols < 0.06, symbols > 0.1), pick(capitals < 0.1, capitals > 0.3), pick(digits < 0.05, digits > 0.3), pick(lone < 0.02, lone > 0.1), pick(repeats < 0.05, repeats > 0.15),
        pick(many and distinct > 0.4, many and distinct < (0.3 if words < 400 else 0.1)), pick(again == 0 and words > 60, again > 0.3), pick(3 < length < 8, length < 2.5 or length > 12),
        pick(many and 0.1 < short < 0.6, many and (short < 0.02 or short > 0.8)),
    ]


def naive_posterior(votes, share, table):
    good, bad = math.log(share), math.log(1 - share)
    for v, b, g in zip(votes, *np.clip(table, 1e-6, 1 - 1e-6).tolist(), strict=True):
        if v:
            good, bad = good + math.log(g if v > 0 else 1 - g), bad + math.log(b if v > 0 else 1 - b)
    return 1 / (1 + math.exp(min(30, max(-30, bad - good))))


def naive_em(all_votes):
    p = [0.1 if -1 in v else 0.9 for v in all_votes]
    for _ in range(200):
        table = [[], []]
        for side, weight in ((0, [1 - x for x in p]), (1, p)):
            for k in range(9):
                up, down = (sum(w for w, v in zip(weight, all_votes, strict=True) if v[k] == sign) for sign in (1, -1))
                table[side].append((up + 0.5) / (up + down + 1))
        share = (sum(p) + 1) / (len(p) + 2)
        new = [naive_posterior(v, share, np.array(table)) for v in all_votes]
        if max(abs(a - b) for a, b in zip(new, p, strict=True)) < 1e-9:
            break
        p = new
    return share, np.array(table)


@pytest.fixture(scope="module")
def plain(docs):
    return docs.select("doc_id", "text", "lang", "source", "score", "kept").where("doc_id IS NULL OR doc_id <> 70").cache()


def test_labellers_and_posteriors(plain):
    rows = plain.collect()
    votes = [naive_votes(naive_statistics(r["text"])) for r in rows]
    share, table = quality.labeller_model(plain)
    want_share, want_table = naive_em(votes)
    assert abs(share - want_share) < 1e-6 and np.abs(table - want_table).max() < 1e-6
    want = sorted((str(r["doc_id"]), round(naive_posterior(v, want_share, want_table), 5)) for r, v in zip(rows, votes, strict=True))
    got = quality.scored(plain.select("doc_id", "text"))
    assert sorted((str(r["doc_id"]), round(r["weak_label"], 5)) for r in got.collect()) == want


def naive_quality(rows, weights):
    out = {}
    for text in {r["text"] for r in rows}:
        s = naive_statistics(text)
        b = [1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 if c in SPACE else c for c in (text or "").encode() + b"\n"]
        grams = [(((x << 16) + (y << 8) + z) * 2654435761 % 2**32) >> 18 for x, y, z in zip(b, [*b[1:], 3], [*b[2:], 3, 3], strict=False)]
        steps = [((int(math.log2(1 + max(0, x) * (1 if k == 0 else 64))) + 64 * k + 1) * 0x9E3779B1 % 2**32) >> 18 for k, x in enumerate(s)]
        out[text] = (s[0], weights[0] + 10 * sum(float(weights[g]) for g in grams) / len(b) + sum(float(weights[x]) for x in steps))
    return out


def test_linear_scores(plain):
    weights = quality.trained(plain)[2]
    want = naive_quality(plain.collect(), weights)
    for r in quality.scored(plain.select("doc_id", "text")).collect():
        words, raw = want[r["text"]]
        if words == 0:
            assert r["score"] == 0 and not r["kept"]
        else:
            assert abs(math.log(r["score"] / (1 - r["score"])) - raw) < 1e-3, (r["doc_id"], r["text"][:60])


def naive_language(lowered, learnt, rules):
    """lang, score of each lower-case text from counts of the learnt (text, lang)."""

    def trigrams(t):
        b = b" " + t.encode() + b"  "
        b = [c if c >= 128 or 97 <= c <= 122 else 32 for c in b]
        for i in range(len(b) - 2):
            if (b[i], b[i + 1]) != (32, 32):
                h = (((b[i] << 16) + (b[i + 1] << 8) + b[i + 2]) * 2654435761 % 2**32) >> 17
                if h != rules.buckets - 1:
                    yield h

    counts = collections.defaultdict(lambda: np.zeros(rules.buckets))
    for t, lang in learnt:
        for h in trigrams(t):
            counts[lang][h] += 1
    names = sorted(counts)
    p = np.stack([counts[x] + rules.smoothing for x in names])
    p /= p.sum(1, keepdims=True)
    bits = [[1 if k >> i & 1 else -1 for i in range(len(names))] for k in range(1, 1 << (len(names) - 1))]
    weight, trust = [], []
    for code in bits:
        one, other = (np.mean([q for q, c in zip(p, code, strict=True) if c == s], axis=0) for s in (1, -1))
        w = np.log(one) - np.log(other)
        w[-1] = 0
        least = max(0.05, min(float(q @ w) * c for q, c in zip(p, code, strict=True)))
        weight.append(w / least)
        trust.append(least)
    out = []
    for t in lowered:
        if t is None:
            out.append(("und", 0.0))
            continue
        own = list(trigrams(t))
        margins = [sum(float(w[h]) for h in own) / max(1, len(own)) for w in weight]
        loss = [sum(x / sum(trust) * math.exp(-max(-6, min(6, m * code[i]))) for x, m, code in zip(trust, margins, bits, strict=True)) for i in range(len(names))]
        a, b = sorted(loss)[:2]
        out.append((names[loss.index(a)], (b - a) / (b + a)))
    return out


def language_rows(df, rules, every=False):
    letters = F.col("text").rlike(r"\p{L}")
    rows = df.select("doc_id", F.when(letters, F.lower("text")).alias("t"), "lang", (F.lit(every) | F.coalesce(fold(4) != 2, F.lit(False))).alias("learn")).collect()
    found = naive_language([r["t"] for r in rows], [(r["t"], r["lang"]) for r in rows if r["learn"] and r["t"] and r["lang"]], rules)
    return [(r["doc_id"], lang, score) for r, (lang, score) in zip(rows, found, strict=True)]


def test_languages_decoded_by_hand(plain):
    rules = langid.LanguageRules()
    more = plain.unionByName(plain.select((F.col("doc_id") + 1000).alias("doc_id"), F.concat(F.lit("zwölf "), "text").alias("text"), F.lit("de").alias("lang"), "source", "score", "kept"))
    got = langid.identify(more, fold(4) != 2, fold(4) == 2, rules).collect()
    key = lambda x: tuple(map(str, x))
    want = sorted(((d, lang, round(s, 3)) for d, lang, s in language_rows(more, rules)), key=key)
    assert sorted(((r["doc_id"], r["lang_pred"], round(r["score"], 3)) for r in got), key=key) == want


def naive_copies(rows, rules):
    own = collections.Counter()
    for r in rows:
        own[r["source"]] += len((r["text"] or "").encode()) + 1
    weight = {s: n**rules.temperature for s, n in own.items()}
    n = collections.Counter()
    for r in rows:
        rate = sum(own.values()) * weight[r["source"]] / sum(weight.values()) / own[r["source"]]
        parts = max(1, math.ceil(rate / rules.part_mean))
        key = str(r["doc_id"]) if r["doc_id"] is not None else hashlib.md5((r["text"] or "").encode()).hexdigest()
        for part in range(1, parts + 1):
            u = int(hashlib.md5(f"{rules.seed}|{key}|{part}".encode()).hexdigest()[:13], 16) / 2**52
            p, total, k = math.exp(-rate / parts), 0.0, 0
            total = p
            while total <= u and k < rules.most:
                k += 1
                p *= rate / parts / k
                total += p
            n[r["doc_id"], r["text"]] += k
    return +n


def test_pipeline_stage_by_stage(spark, plain, tmp_path, tokenizer):
    from tokenizers import Tokenizer

    plain.write.parquet(str(tmp_path / "documents.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    multiset = lambda rows: collections.Counter((r["doc_id"], r["text"]) for r in rows)
    stages = dict(corpus_pipeline.STAGES)
    # quality
    rows = df.collect()
    raw = naive_quality(rows, quality.trained(df)[2])
    good = stages["quality"](spark, df, "").cache()
    sure = {t: x > 0 for t, (words, x) in raw.items() if words and abs(x) > 1e-3}
    got = multiset(good.collect())
    assert all(got[k] == (n if sure[k[1]] else 0) for k, n in multiset(rows).items() if k[1] in sure) and not any(raw[t][0] == 0 for _, t in got)
    # language
    rules = langid.LanguageRules()
    stay = stages["language"](spark, good, "").cache()
    clear = collections.Counter(d for d, lang, s in language_rows(good, rules, every=True) if lang != "und" and s >= rules.least_score)
    assert collections.Counter(r["doc_id"] for r in stay.collect()) == clear
    # near-duplicates: one row of each group and id
    near = stages["near_duplicates"](spark, stay, "").cache()
    distinct = sorted({(r["doc_id"], r["text"].lower()) for r in stay.collect() if r["doc_id"] is not None})
    one = {}
    for d, t in distinct:
        one.setdefault(d, t)
    want = kept_near(sorted(one.items()), corpus_pipeline.NEAR.percent)
    assert {r["doc_id"] for r in near.collect() if r["doc_id"] is not None} == want
    assert near.where("doc_id IS NULL").count() == stay.where("doc_id IS NULL").count()
    # mixing
    mixed = stages["mixing"](spark, near, "").cache()
    assert multiset(mixed.collect()) == naive_copies(near.collect(), mixing.MixingRules())
    # packing
    t = Tokenizer.from_file(tokenizer)
    tokens = collections.Counter()
    for r in mixed.collect():
        tokens[r["doc_id"]] += len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    packed = stages["packing"](spark, mixed, "").collect()
    got = collections.Counter()
    for r in packed:
        got[r["doc_id"]] += r["length"]
    assert got == tokens
    whole = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in whole} == dict(tokens)
    assert neardup.NearRules().percent == 85

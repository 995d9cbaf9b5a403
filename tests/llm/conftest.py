import pytest

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, score DOUBLE, kept STRING, copy STRING, depth STRING, block LONG, id LONG"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeats, near copies, and columns whose names the operators use."""
    import random

    r = random.Random(1)
    vocabulary = {"en": "the of and to in that is was for with on as it be at this by from they have".split(), "fr": "le la de et un une des que qui dans pour est sur avec au les".split()}
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "fr"
        words = [r.choice(vocabulary[lang]) + ("" if r.random() < 0.5 else r.choice(vocabulary[lang])) for _ in range(r.randrange(30, 200))]
        rows.append((i, " ".join(words).capitalize() + ".\n" + " ".join(words[:9]) + ".", lang, "hot" if i % 2 else f"s{i % 5}"))
    base = rows[1][1].split(" ")
    rows.append((60, rows[1][1], "en", "hot"))  # exact copy
    rows.append((61, rows[1][1].upper(), "en", None))  # equal words
    rows.append((62, " ".join([*base[:3], "changed", *base[4:]]) + " " + " ".join(base * 3), "en", "hot"))
    rows.append((63, " ".join([*base[:-1], "changed"]), "en", "hot"))  # near copy
    rows += [(64, None, "en", "hot"), (65, "", None, "hot"), (66, " \n\t ", "fr", "s1"), (67, "one", "en", "s1"), (68, "One", "en", "s1"), (69, "12 34 %%", "en", "s1")]
    rows.append((70, " ".join(r.choice(vocabulary["en"]) + str(i % 977) for i in range(60_000)), "en", "s2"))  # very long
    rows += [(None, "a text without id that is long enough", "en", "s2"), (None, None, None, None)]
    rows += [(71, "a repeated row of several words here", "en", "s3")] * 3
    rows += [(72, "an id with two texts, the first of them", "en", "s3"), (72, "quite another text under that same id", "en", "s3")]
    rows.append((73, "!!! ### $$$ %%% | | | | &&& *** ### @@@ | | | !!", "en", "s3"))
    return spark.createDataFrame([(*x, None if x[1] is None else len(x[1]), 0.5, "x", "y", "z", 7, 8) for x in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def tokenizer():
    from talus.llm.queries import tokenizer_path

    return tokenizer_path()

import random

import pytest

#: Extra columns whose names operators use inside.
CLASH = "n long, key long, rep long, comp long, at int, word string, w string, label string, row long, did long, sha long, bands string, count long, held_out string, bucket int, length int, shard int, cut string, kept string, score string, tokens int, logp double, own string, block int"


def prose(rng, words):
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ou", "ea", "ti"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def documents():
    """(doc_id, text): copies, edited copies, shared passages, junk, empty and null texts, a long one."""
    rng = random.Random(3)
    out: list = []
    base = [prose(rng, rng.randint(3, 160)) for _ in range(25)]
    passage = prose(rng, 60)
    for t in base:
        out.append(t)
        if rng.random() < 0.4:
            out.append(t)
        if rng.random() < 0.6:
            words = t.split()
            for _ in range(max(1, len(words) // 40)):
                words[rng.randrange(len(words))] = "edited"
            out.append(" ".join(words))
    out += [prose(rng, 20) + " " + passage + " " + prose(rng, 20) for _ in range(6)]
    out += ["", None, " \n\t", "one", "one two three four", "ONE TWO three FOUR", "é" * 150, "ab " * 400, "ab " * 300, "żółć " * 60, passage[10:160] + "é", "12 34 !! ??", "x" * 5000]
    out.append(" ".join([prose(rng, 3000), passage]))
    return list(enumerate(out))


@pytest.fixture(scope="session")
def clashing(spark, documents):
    """The documents with repeated rows, a null id, and extra columns of clashing names."""
    names = [c.split()[0] for c in CLASH.split(", ")]
    rows = [(i, t, "en" if i and i % 2 else None, "s", None) for i, t in [*documents, documents[0], documents[0], (None, documents[1][1]), (None, None)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", *[f"cast(null as {c.split()[1]}) as `{n}`" for n, c in zip(names, CLASH.split(", "), strict=True)])


@pytest.fixture(scope="session")
def plain(spark, documents):
    return spark.createDataFrame([(i, t, ["en", "de"][i % 2]) for i, t in documents], "doc_id long, text string, lang string").repartition(3)

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, value string, kept string, part string, score string, g string, label string"


def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


def make_rows():
    rng = random.Random(5)
    rows = []
    for i in range(160):
        lang = ("aa", "bb")[i % 2]
        rows.append([i, words(rng, ("etaonrish", "uvwxyzäöqk")[i % 2], rng.randint(60, 200)) + ".", lang, ("hot", "s1", None)[0 if i % 3 else i % 2 + 1]])
    base = rows[4][1].split(" ")
    for i in range(160, 200):
        text = list(base)
        for _ in range(i % 5):
            text[rng.randrange(len(text))] = "xx" + str(rng.randrange(9))
        rows.append([i, " ".join(text), "aa", "hot"])
    passage = words(rng, "etaonrish", 60)
    for i in range(200, 245):
        rows.append([i, passage + " " + words(rng, "etaonrish", 90), "aa", "hot"])
    rows += [
        [300, None, "aa", None], [301, "", None, "hot"], [302, " \t\n ", "aa", "hot"], [303, "12 34 ###", "bb", "hot"],
        [304, "one two three", "aa", "hot"], [305, "ONE two  three\n", "aa", "hot"], [306, "word " * 30_000, "aa", "hot"],
        [307, "x" * 50_000, "aa", "hot"], [308, "a<|endoftext|>b é ΣΑΣ 日本 \x1c z", "bb", "s1"], [None, "no id here at all", "aa", "hot"],
        [0, rows[0][1], "aa", "hot"], [0, rows[0][1], "aa", "hot"], [309, "word " * 30_000, "aa", "hot"], [-5, rows[7][1], None, None],
    ]
    return [(i, t, lang, s, None if t is None else len(t), i, "v", "k", "p", "x", "g", "l") for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("llm") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)

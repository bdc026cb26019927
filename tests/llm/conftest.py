import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, uid int, cid string, label int"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def rows(spark):
    """Small documents with the odd cases: nulls, empty and long texts, repeated rows, chains of near copies, hot copies."""
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    out = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    base = text(120)
    out += [(1000 + k, base) for k in range(30)]  # copies
    for k in range(30):  # near copies of one text, unlike each other
        words = base.split()
        for _ in range(3):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        out.append((1100 + k, " ".join(words)))
    chain = text(100).split()
    for k in range(12):  # a chain: only neighbours are alike
        out.append((1200 + k, " ".join(chain[k * 4:k * 4 + 52])))
    out += [(1300, None), (1301, ""), (1302, " \t\n "), (1303, "one two"), (1304, "ONE  two"), (1305, text(20_000)), (1306, "x" * 50_000),
            (1307, "Éa b c d É"), (1308, "éa b c d é"), (None, "no id here at all"), (None, None), (1303, "one two"),
            (1309, "mail jo.doe@mail.example.com or 192.168.1.20 or 4111 1111 1111 1111 or +1 (415) 555-0100!"),
            (1310, "jo (at) mail (dot) com, ４１１１ １１１１ １１１１ １１１１, and 999.1.1.1 4111111111111112 a@b"), (1311, "you idiot you moron you idiot scum"),
            (1312, "he said not an idiot.")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(i, t, "en", "s", len(t or ""), "x", 7, "y", 1) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

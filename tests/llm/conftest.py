import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def hard_rows():
    """Documents with nulls in every column, empty, short and long texts, copies, near copies, repeated rows and shared stretches."""
    rnd = random.Random(5)
    vocab = ["".join(rnd.choices("abcdefghé ßñ".replace(" ", ""), k=rnd.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(rnd.choices(vocab, k=n))
    stretch = say(45)
    texts = [None, "", " \t\n", "one", "two words", "a a a a a " * 30, stretch, "x" * 5000, "Ünï – ¿qué? 日本語   nbsp\x1fsep"]
    texts += [say(rnd.randint(3, 300)) for _ in range(40)]
    texts += [say(rnd.randint(5, 90)) + " " + stretch + "\n" + say(rnd.randint(5, 90)) for _ in range(12)]
    base = say(400)
    texts += [base] * 9 + [base.replace(" ", "\n", 3), base + " tail", "Head " + base]
    texts += [say(3000), "\n".join(["same line here"] * 30), "# $ % | < > * &\n" * 5]
    rows = [(i, t, rnd.choice(["en", "fr", None]), rnd.choice(["s1", "s2", "s2", "s2", None, "é"]), len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], rows[60]]  # repeated rows
    rows += [(13, "another text under a used id " + stretch, "en", "s1", 0), (None, "no id " + stretch, None, None, None), (None, None, None, None, None)]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return hard_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hard") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

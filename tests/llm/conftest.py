import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, cls string, spans string, c0_ string"


def corpus() -> list[tuple]:
    """Small documents with the cases that operators define: nulls, empty and long texts, copies and shared passages."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(900)] + ["été", "naïve", "ß", "漢字"]

    def prose(n: int) -> list[str]:
        return [rng.choice(words) + rng.choice(["", "", "", ".", ",", "!\n"]) for _ in range(n)]

    shared, base = prose(70), prose(160)
    texts = [None, "", " \n\t ", "one", "One two three four", "one two three four"]
    texts += [" ".join(prose(rng.randint(20, 200))) for _ in range(30)]
    for _ in range(8):  # near copies
        copy = list(base)
        copy[rng.randrange(160)] = "changed"
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 3
    texts += [" ".join(prose(60) + shared + prose(50)) for _ in range(4)]
    texts.append(" ".join(prose(30_000)))
    texts.append("same " * 300)
    texts.append("it's <|endoftext|>we'll\r\n　 x  y 1234 <|endoftext|>\x00\x85 aaa" + "a" * 500)
    return [(i, t, "en", "s", None if t is None else len(t), i, "c", "x", None) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    # one row comes twice, one has no id
    return spark.createDataFrame([*rows, rows[10], (None, "a row without an id", None, None, None, None, None, None, None)], SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer_file():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")

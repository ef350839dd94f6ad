import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
MORE = {"size": "1L", "score": "0.5D", "id": "7L", "row": "8L", "row__": "9L", "kept": "true", "part": "3L", "key": "4L", "text__": "'x'", "held_out": "true", "source__": "'s'", "w": "5L", "n": "6L", "copy__": "1L", "predicted": "0"}


def prose(seed: int, n: int, lang: str = "en") -> str:
    rng = random.Random(seed)
    own = {"en": "the of and house river stone walk under light green paper window", "de": "der und nicht strasse haus gehen unter licht papier fenster schön über"}[lang].split()
    return " ".join(rng.choice(own) + rng.choice(["", "s", "er", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a very long text, copies, near copies, repeated rows and ids."""
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    base = prose(1, 300)
    rows = [
        (1, base, "en", "a", 1), (2, base + " ", "en", "a", 1), (3, base.replace(" ", "\n", 5), "en", None, 1), (4, None, "en", "a", None), (5, "", None, "b", 0),
        (6, " \t\r\n\x0b\x0c", "de", "b", 6), (7, long, None, None, None), (8, long, "en", "a", 9), (None, base, "en", "a", 1), (None, None, None, None, None), (9, "Straße 12 ÄÖ ﬁ ½ 日本語 <s> </s>", "de", "c", 3),
        (9, "Straße 12 ÄÖ ﬁ ½ 日本語 <s> </s>", "de", "c", 3), (10, "123 456 !!", None, "c", 1), (11, "one two", "en", "a", 1), (12, base + " tail", "en", "a", 1),
    ]
    rows += [(20 + k, prose(100 + k, 40 + k, "de" if k % 2 else "en"), "de" if k % 2 else "en", f"s{k % 3}", 5) for k in range(40)]
    return spark.createDataFrame([Row(*r) for r in rows], DOCS).repartition(4).cache()


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """The same with further columns named like those that operators add or use."""
    return odd_docs.select("*", *[F.expr(v).alias(k) for k, v in MORE.items()])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(20 + k, int(k % 4 > 0), int(k % 5 == 0)) for k in range(40)] + [(None, 1, 1), (21, None, None), (22, 1, 0)]
    return spark.createDataFrame([Row(*r) for r in rows], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(odd_labels):
    return odd_labels.where("false")

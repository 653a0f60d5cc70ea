import random

import pytest
from pyspark.sql import functions as F

from lacre.llm.common import prepare

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, words string, hash bigint, _batch int, component_id string"


@pytest.fixture(autouse=True)
def ready(spark):
    prepare(spark)


def sentence(rng, n, letters="aeiou"):
    return " ".join("".join(rng.choice("bcdfgklmnprst") + rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows():
    """Two languages, copies, near copies, shared passages, nulls in every column, repeated rows."""
    rng = random.Random(5)
    passage = sentence(rng, 60)
    texts = [sentence(rng, rng.randint(5, 120), "aeiou" if i % 2 else "éàüo").replace(" b", "\nB") for i in range(60)]
    texts += [texts[1], texts[1], texts[3] + " more words", sentence(rng, 20) + " " + passage, passage + "\n" + sentence(rng, 9)]
    texts += [None, "", " \n ", "one", "one two", "12 34", passage[:100], sentence(rng, 4000, "éàüo"), texts[5].replace("a", "aa", 1)]
    out = [(i, t, "xx" if i % 2 else "yy", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [(None, texts[7], None, None, None), (200, texts[8], None, "src0", 3), (201, None, "xx", None, None), out[9], out[9]]
    return [(*r, "x", 1, 2, "y") for r in out]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(rows(), DOCUMENTS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture
def benchmark(spark, documents):
    text = documents.where("doc_id = 11").select("text").first()[0].replace("\n", " ").split(" ")
    items = [(1, " ".join(text[:20])), (2, " ".join(text[3:10])), (3, "one"), (4, None), (None, "one two"), (5, ""), (1, " ".join(text[:20])), (6, "no such words here at all")]
    return spark.createDataFrame([(*r, "x") for r in items], "item_id bigint, text string, spans string")


@pytest.fixture
def some_ids():
    return F.col("doc_id").isNotNull()

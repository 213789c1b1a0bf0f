import os
import random

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
# tasks import the package from here
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.dirname(HERE)), os.environ.get("PYTHONPATH", "")])

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def rng():
    return random.Random(5)


@pytest.fixture
def frame(spark):
    """Documents from (id, text) or (id, text, source), with the other columns filled."""

    def make(rows, schema=DOCS):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, schema).repartition(5)

    return make

import pytest
from sample_words import words

from lodestack.llm.tables import Scratch

#: Extra columns whose names the operators use inside.
CLASHING = "id key size row h c name score shard words unit k r spans text_a label kept".split()


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


@pytest.fixture
def make_docs(spark):
    def make(rows, extra=True):
        """Documents of (doc_id, text, source) rows, with a clashing column for every inner name."""
        fields = "doc_id bigint, text string, lang string, source string, n_chars bigint" + "".join(f", `{c}` string" for c in CLASHING if extra)
        tail = ["x"] * len(CLASHING) if extra else []
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *tail) for i, t, s in rows], fields)

    return make


@pytest.fixture
def odd_rows():
    """Nulls, empty and blank texts, one word, ties, repeated rows and a long text."""
    long = " ".join(words(1, 30_000, 10**6))
    base = " ".join(words(2, 120))
    return [
        (None, "no id", "a"), (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "word", "b"), (5, "word", "b"), (5, "word", "b"), (6, base, "b"),
        (7, base, "c"), (8, base + " tail", "c"), (9, long, "c"), (10, "A b C d e", "c"), (11, "a B c D e", "c"), (12, "ÄÖ ß 東京 🙂 z", "d"), (13, "x" * 700, "d"), (14, "x" * 450, None),
    ]



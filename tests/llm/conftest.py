import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

#: Names that operators use inside.
CLASHING = (
    "key row node part block cluster group found spans at gram n start number digest file place last kept content piece length "
    "score lang_pred value kind runs line earlier root a b item sequence_id offset shard slot __block __rank _metadata"
).split()


@pytest.fixture
def frame(spark):
    """Documents with extra columns whose names clash, over several partitions."""

    def make(rows, parts=4):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        return docs.selectExpr("*", *(f"'x' AS `{name}`" for name in CLASHING)).repartition(parts)

    return make


@pytest.fixture
def documents(frame):
    return lambda pairs, parts=4: frame([(doc_id, text, "en", f"s{i % 3}") for i, (doc_id, text) in enumerate(pairs)], parts)


#: Nulls, empty and white texts, repeated rows, ties and a long text.
ODD = [
    (None, "one two three four five six"),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "One two three four five six"),
    (4, "One two three four five six"),
    (5, "é " * 50_000),
    (6, "x" * 100_000),
    (7, "\u0001\u0002 1 1 1 1 \U0001f600"),
]


@pytest.fixture
def odd():
    return list(ODD)

import pytest

from tracemill.llm.common import checkpointed

LONG = ("der lange text " * 9000) + "x@y.org " + "1" * 3000


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, empty and very long texts, repeated rows, other scripts, and extra columns whose names clash."""
    rows = [(1, "The quick brown fox jumps over the lazy dog"), (1, "The quick brown fox jumps over the lazy dog"), (2, None), (None, "the quick brown fox"), (3, ""), (4, "  \n\t "), (5, LONG), (6, "日本語 ééé ß 😀 🎉 12"), (7, "the QUICK brown fox jumps over the lazy dog"), (None, None), (8, "!!! ??? 123")]
    extra = {"fp": 1, "component_id": 2, "n_hit": 3, "spans": 4, "_id": 5, "_text": 6, "shard": 7, "lang_pred": 8, "held_out": 9, "row": 10, "label": 11, "key": 12, "url": 13}
    schema = "doc_id bigint, text string, " + ", ".join(f"{n} int" for n in extra)
    return checkpointed(spark.createDataFrame([(*r, *extra.values()) for r in rows], schema))


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)

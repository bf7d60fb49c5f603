import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from tests_llm_rows import edge_rows  # noqa: E402

CLASHES = ["row", "id", "k", "of", "size", "range", "score", "segment", "block", "copies", "count", "node", "root", "lang_pred", "text_key", "taken", "b", "h", "next", "prev"]


@pytest.fixture(scope="session")
def edge(spark):
    """The rows with columns of clashing names beside them."""
    names = ", ".join(f"`{c}` string" for c in CLASHES)
    rows = [(*r, len(r[1]) if r[1] else None, *[None] * len(CLASHES)) for r in edge_rows()]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {names}")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")

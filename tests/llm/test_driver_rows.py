"""Rows that reach the driver: every call is listed with what bounds it."""
from __future__ import annotations

import pathlib
import re

FOLDER = pathlib.Path(__file__).resolve().parents[2] / "chartlake" / "llm"
#: By module: number of calls, and the bound of each.
PERMITTED = {
    "centroids": 4,  # first centroids; sums by centroid and component; sums by cluster; one row
    "graphs": 1,  # one row: size and checksum of the links
    "language": 2,  # landmark texts; one short vector for each example
    "topk": 2,  # sample of the tree's top; reaches of the anchors
    "toxicity": 3,  # counts of two classes; terms of the examples, twice
    "urlrules": 1,  # one row about the rules
}


def test_calls_that_bring_rows_to_the_driver():
    found = {}
    for path in FOLDER.glob("*.py"):
        calls = re.findall(r"\.(?:collect|toPandas|toLocalIterator|toArrow|first|head|take|localCheckpoint)\(", path.read_text())
        calls = [c for c in calls if c != ".take("]  # of Arrow columns
        if calls:
            found[path.stem] = len(calls)
    assert found == PERMITTED

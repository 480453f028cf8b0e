"""Static guards over the library source for constructs the scale design rules
out: nothing whole through the driver, no hints, no per-row Python, no RDDs, no
cross joins, no group gathered into one value, no machine-local lineage cuts."""

import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parent.parent / "larder"
# the order-insensitive result comparison is test tooling, not an operator
TOOLING = {"plans/compare.py"}

FORBIDDEN = {
    "localCheckpoint": r"\blocalCheckpoint\b",
    "collect to the driver": r"\.collect\(\)|\.toPandas\(\)|\.toLocalIterator\(",
    "broadcast hint": r"\bbroadcast\(|\.hint\((?!\"rebalance\")",
    "row-at-a-time Python UDF": r"@udf\b|\bF\.udf\(|\budf\(",
    "RDD API": r"\.rdd\b|mapPartitions\(",
    "cross join": r"crossJoin\(",
    "whole group in one value": r"collect_list\(|collect_set\(",
}


def sources():
    for path in sorted(ROOT.rglob("*.py")):
        rel = path.relative_to(ROOT).as_posix()
        # the training-data subpackage runs Python inside tasks and has tests of its own
        if rel not in TOOLING and not rel.startswith("llm/"):
            yield rel, path.read_text()


def test_no_forbidden_constructs():
    found = [(rel, what) for rel, text in sources() for what, pat in FORBIDDEN.items() if re.search(pat, text)]
    assert not found, found


def test_driver_values_are_scalars():
    """The only values that library functions pull to the driver are one row: the newest
    batch id of the audit counts, and a bitmap of 4 KB of bucket or day numbers."""
    pulls = [(rel, m.group(0)) for rel, text in sources() for m in re.finditer(r"\.(first|head|take)\([^)]*\)", text)
             if "batch.take(" not in text[max(0, m.start() - 6):m.end()]]
    assert pulls == [("sources/numbers.py", ".first()"), ("streaming/ledger_stream.py", ".first()")], pulls

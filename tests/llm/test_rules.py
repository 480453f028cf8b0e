"""Static guards over the training-data subpackage."""

import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parents[2]
SOURCES = [*sorted((ROOT / "larder" / "llm").glob("*.py")), ROOT / "corpus_pipeline.py"]

FORBIDDEN = {
    "localCheckpoint": r"\blocalCheckpoint\b",
    "rows streamed to the driver": r"\.toLocalIterator\(",
    "row-at-a-time Python UDF": r"@udf\b|\bF\.udf\(",
    "RDD API": r"\.rdd\b|mapPartitions\(",
    "cross join": r"crossJoin\(",
    "machine-local folder": r"\btempfile\b|/tmp\b",
    "swallowed import error": r"except (ModuleNotFoundError|ImportError)",
}

#: What comes to the driver, and what bounds it.
PULLED = {
    "collocations.py": 2,   # the bits of the sieve (4 MB); a sample of some thousand sequences
    "decontaminate.py": 1,  # one block of the benchmark
    "language.py": 4,       # a row a label (bounded), the counts of the bounded sample (twice), moments by label
    "licenses.py": 1,       # a row for each word of the templates
    "sharding.py": 1,       # counts of a bounded number of intervals
    "url_rules.py": 1,      # the shapes of the rules
}


def test_no_forbidden_constructs():
    found = [(p.name, what) for p in SOURCES for what, pattern in FORBIDDEN.items() if re.search(pattern, p.read_text())]
    assert not found, found


def test_what_comes_to_the_driver_is_listed():
    pulled = {p.name: len(re.findall(r"\.collect\(\)|\.toPandas\(\)", p.read_text())) for p in SOURCES}
    assert {k: n for k, n in pulled.items() if n} == PULLED


def test_broadcasts_are_listed():
    """Explicit broadcasts: the model, a block of the benchmark, the sieve's bitmap, the intervals of the shards."""
    found = {p.name for p in SOURCES if re.search(r"broadcast\(", p.read_text())}
    assert found == {"decontaminate.py", "language.py", "near_dups.py", "sharding.py"}


def test_nothing_else_imports_the_subpackage():
    others = [p for p in (ROOT / "larder").rglob("*.py") if "llm" not in p.parts]
    assert not [p.name for p in others if re.search(r"larder\.llm|from \.+llm|import llm", p.read_text())]

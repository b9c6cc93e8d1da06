"""Every registered query that has SQL gives the rows of that SQL; the others have a test of their own."""

import datetime
import decimal
import math
import os
import pathlib
import shutil
import subprocess
import sys

import duckdb
import pytest

from quarrion import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Queries without SQL, and the brute-force version or known answer that holds their operator.
TESTED_ELSEWHERE = {
    "f38_string_kinds": "test_strings.py::test_string_kinds_of_whole_pages",
    "e12_request_context": "test_code.py::test_mentions_of_whole_pages", "e13_entry_location": "test_code.py::test_entries_of_all_customers",
    "f31_gram_hashes": "test_operators.py::test_gram_hashes", "e02_bounded_emails": "test_operators.py::test_emails", "g05_first_rule_links": "test_families.py::test_first_links_match_all_pairs", "g09_two_core": "test_operators.py::test_two_core_of_all_orders",
    "g10_strict_component_groups": "test_families.py::test_strict_groups",
    "g11_merged_families": "test_families.py::test_families_merge_while_their_cores_share", "g14_divided_again": "test_families.py::test_weak_families_are_divided_again",
    "g16_component_families": "test_families.py::test_one_family_among_strangers", "g16_run_counts": "test_families.py::test_one_family_among_strangers",
    "g17_staged_families": "test_operators.py::test_staged_families_of_all_documents", "g18_linkage_families": "test_operators.py::test_complete_linkage_and_medoid", "g22_broken_fingerprints": "test_families.py::test_weak_families_are_divided_again",
}


def plain(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float | decimal.Decimal):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return repr(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in catalog.ORACLES:
        cur = duck.execute(catalog.ORACLES[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in cur.fetchall())
    else:
        assert name in TESTED_ELSEWHERE, f"{name} has neither SQL nor a test of its own"


def test_entry_runs_without_the_corpus_subpackage(tmp_path):
    """A copy of the repository without the corpus subpackage, its tests and its pipeline registers all other queries."""
    root = pathlib.Path(__file__).resolve().parent.parent
    left_out = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "*.md", "*.json", "*.txt")
    shutil.copytree(root, tmp_path / "copy", ignore=left_out)
    code = "import __spark_entry__ as e; from quarrion import catalog; assert set(e.queries()) == set(catalog.QUERIES) and set(e.oracle_sql()) == set(catalog.ORACLES); print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env={**os.environ, "PYTHONPATH": str(tmp_path / "copy")}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) == len(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0

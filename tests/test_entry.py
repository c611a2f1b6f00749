import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from tallyweave.plans import queries as plans

ROOT = Path(__file__).resolve().parents[1]


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


#: At least one query of each kind, with all folds, samples and sweeps that are not slow.
HELD = (
    "exact_heavy_hitters", "key_diagnostic", "parse_pageviews", "cms_estimates", "cms_candidate_pool", "countsketch_heavy_hitters", "countsketch_candidate_pool",
    "ams_estimates", "mg_merge", "mg_fold", "ss_fold", "lc_fold", "counter_candidate_pools", "fold_bounds", "lc_preaggregated", "summary_memory", "concise_sample",
    "reservoir_estimates", "heavy_weight_samples", "memory_sweep", "baseline_quality", "partition_sweep", "counter_partition_sweep", "ss_memory_sweep",
)


@pytest.mark.parametrize("name", HELD)
def test_queries_equal_their_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    found = plans.QUERIES[name](spark, sf)
    names = sorted(found.columns)
    expected = con.execute(f"select {', '.join(names)} from ({plans.ORACLES[name]})").fetchall()
    assert sorted(map(str, (tuple(r[c] for c in names) for r in found.collect()))) == sorted(map(str, expected))
    spark.catalog.clearCache()


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_works_without_the_optional_parts(tmp_path, also):
    """A copy of the repository less the two folders of the pipeline operators, with the
    pipeline's file and without it, still has its queries, entry and oracles."""
    there = tmp_path / "repo"
    shutil.copytree(ROOT, there, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    shutil.rmtree(there / "tallyweave" / "llm")
    shutil.rmtree(there / "tests" / "llm")
    for name in also:
        (there / name).unlink()
    code = (
        "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'exact_topk' in q and 'pipeline' not in q"
        " and not any(x.startswith('op') for x in q)"
    )
    subprocess.run([sys.executable, "-c", code], cwd=there, check=True)
    if not also:
        rest = "test_entry_has_rows or test_oracles_belong"
        subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests/test_entry.py", "-k", rest], cwd=there, check=True)

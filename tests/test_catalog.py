import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]

SMALL = "/root/testdata/sf0.001"


def test_contract_shapes():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) > 250 and len(sql) > 220


@pytest.mark.parametrize("name", ["W22_holding_plan", "S9_versioned_read", "T1_bias", "X10_quintile", "D2_interval_audit"])
def test_small_queries_match_sql(spark, name):
    import duckdb

    from quantloom.catalog.compare import TABLES, compare

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    left = entry.queries()[name](spark, SMALL).toArrow().to_pandas(date_as_object=True)
    right = db.sql(entry.oracle_sql()[name]).to_arrow_table().to_pandas(date_as_object=True)
    assert compare(left, right) == ""


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_python_stages_run_from_any_folder(tmp_path):
    """Executors get the package; the folder the driver starts in does not matter."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
rows = entry.queries()["S4_fixed_width_bars"](spark, {SMALL!r}).count()
from quantloom.operators.evaluate import correlation_by_date
wide = spark.sql("SELECT DATE'2020-01-31' AS signal_date, concat('s', id) AS symbol, id * 1.0D AS a, -id * 1.0D AS b FROM range(9)")
print("rows", rows, correlation_by_date(wide, ["a", "b"]).where("left <> right").first()["correlation"])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    words = done.stdout.split()
    assert words[0] == "rows" and int(words[1]) > 0 and float(words[2]) == pytest.approx(-1)


def test_only_the_text_package_may_be_left_out(monkeypatch):
    class Finder:
        def __init__(self, name):
            self.name = name

        def find_spec(self, name, path=None, target=None):
            if name == self.name:
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    def hidden(missing):
        for name in [n for n in sys.modules if n in ("corpus_pipeline", missing) or n.startswith("quantloom.llm")]:
            monkeypatch.delitem(sys.modules, name)
        monkeypatch.setattr(sys, "meta_path", [Finder(missing), *sys.meta_path])
        return entry._text_queries()

    assert hidden("quantloom.llm") == ({}, {})
    if (ROOT / "quantloom" / "llm").exists() and (ROOT / "corpus_pipeline.py").exists():
        monkeypatch.undo()
        with pytest.raises(ImportError, match="suffix"):
            hidden("quantloom.llm.suffix")

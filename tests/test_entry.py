"""Driver contract: every query has a callable; oracle keys are a subset."""

import __spark_entry__ as E


def test_contract_shapes():
    q, o = E.queries(), E.oracle_sql()
    assert len(q) >= 60
    assert set(o) <= set(q)
    assert all(callable(f) for f in q.values())


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) >= {"target", "quantile", "pinball_loss"}


def test_contract_imports_without_spark():
    """queries()/oracle_sql() must not need a running SparkContext."""
    import os
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import sys; sys.path.insert(0, %r); import __spark_entry__ as E; "
            "assert E.queries() and E.oracle_sql(); "
            "from pyspark import SparkContext; assert SparkContext._active_spark_context is None") % repo
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_queries_run_from_another_directory(tmp_path):
    """Executors import the package even when the driver runs elsewhere."""
    import os
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "import __spark_entry__ as E\n"
        "n = E.queries()['format_cost'](spark, '/root/testdata/sf0.001').count()\n"
        "assert n > 0, n\n"
        "spark.stop()\n") % repo
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, cwd=str(tmp_path))

import os
import subprocess
import sys
import textwrap


def test_queries_run_from_another_folder(tmp_path):
    """Python workers import the package although neither the folder nor PYTHONPATH leads there."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
        import sys
        sys.path.insert(0, {root!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        import __spark_entry__ as e
        spark.createDataFrame([(1, "s", "en", "x " * 60)], "doc_id bigint, source string, lang string, text string").write.parquet("documents.parquet")
        print("ROWS", e.queries()["index_stats"](spark, ".").count())
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 1" in done.stdout, done.stderr[-2000:]

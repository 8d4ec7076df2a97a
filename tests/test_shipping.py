"""Python workers that can't import the package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config(map={{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"}}).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")

def can_import(batches):
    import importlib.util
    for batch in batches:
        yield batch.assign(found=importlib.util.find_spec("tallyvox") is not None)

assert not spark.range(1).mapInPandas(can_import, "id bigint, found boolean").first().found
import __spark_entry__ as entry
queries = entry.queries()
for name in {names!r}:
    queries[name](spark, {data!r}).write.format("noop").mode("overwrite").save()
print("all run")
"""


def run_without_package(folder, names, data):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", RUN.format(root=ROOT, names=names, data=str(data))], cwd=folder, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0 and "all run" in done.stdout, done.stderr[-3000:]


def test_queries_with_python_workers(tmp_path):
    run_without_package(tmp_path, ["match_verdicts", "slots_extracted"], tmp_path)

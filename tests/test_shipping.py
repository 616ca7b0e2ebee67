"""The package as Python workers get it: an archive, imported from any folder."""

import os
import subprocess
import sys

from sievework.session import ship_package


def test_archive_is_an_importable_package(spark, tmp_path):
    ship_package(spark)

    archive = next(p for p in spark.sparkContext._python_includes if p == "sievework.zip")
    from pyspark import SparkFiles
    path = os.path.join(SparkFiles.getRootDirectory(), "shipped", archive)
    code = ("import sievework.operators.keyed, sievework.functions.text as t; "
            "assert 'sievework.zip' in t.__file__, t.__file__")
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([path, *[p for p in sys.path if "site-packages" in p]])}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=env, timeout=120)


def test_worker_imports_it(spark):
    ship_package(spark)

    def where(parts):
        import pandas as pd
        import sievework.session as s
        for part in parts:
            yield pd.DataFrame({"found": [s.__name__] * len(part)})

    assert {r.found for r in spark.range(3).mapInPandas(where, "found string").collect()} == {"sievework.session"}


def test_entry_without_a_library_of_the_training_operators(tmp_path):
    """A missing library takes the training-data queries away and nothing else."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import sys; sys.modules['xxhash'] = None; sys.modules['public_tokenizers'] = None\n"
            f"sys.path.insert(0, {root!r})\nimport __spark_entry__ as e\n"
            "assert len(e.queries()) > 100 and 'pipeline' not in e.queries()")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, timeout=120)

"""The entry module in a fresh process, without a session."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest

REPO = Path(__file__).resolve().parents[1]
ZIPS = sorted(map(str, (Path(pyspark.__file__).parent / "python" / "lib").glob("*.zip")))


@pytest.mark.parametrize("first", [[], ZIPS], ids=["package", "zip"])
def test_import_needs_no_session(first):
    code = ("import __spark_entry__ as e; assert e.queries() and e.oracle_sql();"
            "from pyspark import SparkContext; assert SparkContext._active_spark_context is None")
    env = os.environ | {"PYTHONPATH": os.pathsep.join([*first, str(REPO)])}
    subprocess.run([sys.executable, "-c", code], check=True, env=env, cwd="/", timeout=120)

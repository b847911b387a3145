"""Executors need no copy of the package: what operators send loads without it."""

import importlib
import inspect
import os
import pickle
import pkgutil
import subprocess
import sys

import pytest
from pyspark import cloudpickle

import biotally
import biotally.llm

MODULES = [m.name for m in pkgutil.walk_packages(biotally.__path__, "biotally.") if m.ispkg is False]
LOAD = """
import pickle, sys
assert not any("biotally" in m for m in sys.modules)
for name, data in pickle.load(open(sys.argv[1], "rb")):
    try:
        pickle.loads(data)
    except Exception as e:
        print(name, type(e).__name__, e)
"""


def test_functions_load_in_a_bare_process(tmp_path):
    sent = []
    for name in MODULES:
        module = importlib.import_module(name)
        for key, value in vars(module).items():
            if getattr(value, "__module__", None) == name and callable(value):
                sent.append((f"{name}.{key}", cloudpickle.dumps(value)))
    assert len(sent) > 300
    (tmp_path / "sent").write_bytes(pickle.dumps(sent))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", LOAD, str(tmp_path / "sent")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert said.returncode == 0, said.stderr
    assert said.stdout == ""


def test_no_caches_around_functions():
    """Such a wrapper is pickled by name."""
    for name in MODULES:
        for key, value in vars(importlib.import_module(name)).items():
            assert not hasattr(value, "cache_info"), f"{name}.{key}"


@pytest.mark.parametrize("name", ["substring.repeats", "packing.pack", "collocations.collocations"])
def test_jobs_from_another_folder(tmp_path, name):
    """The repository is on the driver's path alone."""
    root = os.path.dirname(os.path.dirname(inspect.getfile(biotally)))
    module, function = name.split(".")
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from biotally.llm import {module}
docs = spark.createDataFrame([(k, "one two three four five six seven eight nine ten. " * 3, "en") for k in range(40)], "doc_id long, text string, lang string")
print("rows", {module}.{function}(docs).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "rows" in said.stdout, said.stderr[-2000:]
    assert int(said.stdout.split()[-1]) > 0

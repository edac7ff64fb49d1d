"""The command line, and workers that get the package from the driver."""

from __future__ import annotations

import json
import os
import subprocess
import sys

import pytest

from corpusframe import cli


def test_commands(spark, tmp_path):
    root = tmp_path / "zoo"
    root.mkdir()
    (root / "Dog.java").write_text("package zoo;\npublic class Dog implements Animal {\n  void bark() {}\n}\n")
    (root / "notes.md").write_text("a dog barks\n" * 40)
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=A", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "first dog")
    say = lambda *a: cli.run(spark, ["--catalog", str(tmp_path / "c"), "--repo", str(root), "--json", *a])
    assert json.loads(say("index", "--tracked"))["files"] == {"indexed": 2, "deleted": 0}
    assert json.loads(say("index", "--incremental"))["files"] == {"indexed": 0, "deleted": 0}
    status = json.loads(say("status"))
    assert not status["is_stale"] and status["collections"]["files"] == 2
    assert json.loads(say("symbols", "Dog", "--kind", "class"))["results"][0]["qualified_name"] == "zoo.Dog"
    assert {r["file_path"] for r in json.loads(say("code", "dog", "--file-type", "md"))["results"]} == {"notes.md"}
    assert [r["path"] for r in json.loads(say("files", "dog", "--extension", "java"))["results"]] == ["Dog.java"]
    assert [r["qualified_name"] for r in json.loads(say("implementations", "Animal"))] == ["zoo.Dog"]
    assert json.loads(say("commits", "--query", "dog"))[0]["subject"] == "first dog"
    assert "+package zoo;" in json.loads(say("history", "Dog.java", "--diff"))[0]["diff"]
    assert "text: Dog" in cli.run(spark, ["--catalog", str(tmp_path / "c"), "--repo", str(root), "complete", "do"])
    with pytest.raises(SystemExit):
        cli.main(["--catalog", "x"])


def test_workers_get_the_package(tmp_path):
    """A driver that has the package sends it to workers that don't."""
    (tmp_path / "a.py").write_text("def one(): pass\n")
    code = f"""
import sys
sys.path.insert(0, {os.getcwd()!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,768]").config("spark.ui.enabled", "false").config("spark.executor.memory", "768m").getOrCreate()
from corpusframe.operators import extract
from corpusframe.sources import files, session
session.ship(spark)
print([r.name for r in extract.symbols_of(extract.parsed(files.sources(spark, {str(tmp_path)!r}))).collect()])
spark.stop()
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    env |= {"PYSPARK_SUBMIT_ARGS": "--driver-memory 512m pyspark-shell", "SPARK_LOCAL_IP": "127.0.0.1"}  # small, beside the session of the other tests
    run = lambda: subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd="/", env=env, timeout=300, check=False)
    done = run()
    if "Connection refused" in done.stderr:  # the machine had no room for another JVM at that moment
        done = run()
    assert "['one']" in done.stdout, done.stderr[-2000:]

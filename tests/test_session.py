"""The scratch folder: the session's setting if there is one, a local folder for local masters, and what is left of loops."""

import os
import pathlib
import subprocess
import sys

import pytest

from pkgrisk import session
from pkgrisk.operators import graph

# A session of its own, so that nothing has set the folder before.
_OWN = """
import sys
sys.path.insert(0, sys.argv[1])
from pkgrisk.session import Scratch, local_session, scratch_root
spark = local_session(1, 1, "1g")
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert scratch_root(spark) == scratch_root(spark)
print(Scratch(spark, "own").save(spark.range(3), "numbers").count())
"""


def test_without_the_setting(tmp_path):
    root = str(pathlib.Path(__file__).resolve().parents[1])
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", _OWN, root], capture_output=True, text=True, timeout=120, env=env)
    assert done.stdout.strip().endswith("3"), done.stderr[-2000:]


class _Cluster:
    """As much of a session as the choice of the folder reads."""

    def __init__(self, master, folder=None):
        self.sparkContext = type("Context", (), {"master": master})()
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: folder or default)})()


def test_clusters_name_their_folder():
    assert session.scratch_root(_Cluster("spark://host:7077", "hdfs://shared/tmp/")) == "hdfs://shared/tmp"
    assert session.scratch_root(_Cluster("local[2]", "file:/shared")) == "file:/shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_root(_Cluster("spark://host:7077"))


def test_loops_keep_their_last_round_only(spark, monkeypatch):
    made = []
    real = graph.Scratch
    monkeypatch.setattr(graph, "Scratch", lambda *a: made.append(real(*a)) or made[-1])
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(6)], "src string, dst string")
    assert graph.reachable(edges).count() == 21
    names = {p.name for p in pathlib.Path(made[0].path.removeprefix("file:")).iterdir()}
    assert len([n for n in names if n.startswith("round-")]) == 1

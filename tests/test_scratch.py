"""Where jobs write tables on their way."""

import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from wareflow.sources.scratch import KEY, new_path, shared_folder


class Context:
    """A context without a folder until one is set."""

    folder: str | None = None

    def __init__(self, master="local[4]"):
        self.master = master

    def getCheckpointDir(self):  # noqa: N802
        return self.folder

    def setCheckpointDir(self, folder):  # noqa: N802
        self.folder = f"{folder}/own"


def session(conf, context):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: conf.get(key, other)), sparkContext=context)


def test_the_clusters_folder_comes_first_and_an_own_one_last():
    context = Context()
    assert shared_folder(session({KEY: "hdfs://x/y/"}, context)) == "hdfs://x/y" and context.folder is None
    own = shared_folder(session({}, context))
    assert own.startswith("file:///") and shared_folder(session({}, context)) == own


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://https://x", "local-cluster[3,2,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match=KEY):
        shared_folder(session({}, Context(master)))
    assert shared_folder(session({KEY: "s3a://b/x"}, Context(master))) == "s3a://b/x"


def test_paths_are_new(spark):
    assert new_path(spark, "a") != new_path(spark, "a") and "/wareflow/a-" in new_path(spark, "a")


def test_the_entry_offers_the_reports_where_a_library_of_the_operators_is_missing():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; names = set(e.queries()); assert len(names) > 50 and 'pipeline' not in names, names; assert set(e.oracle_sql()) <= names"
    root = Path(__file__).resolve().parent.parent
    found = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert found.returncode == 0, found.stderr[-500:]

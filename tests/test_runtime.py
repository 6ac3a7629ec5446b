"""Where lineage may be cut to."""

import pytest

from glyphmill.runtime import checkpoint_dir


class Session:
    """What checkpoint_dir asks of a session."""

    def __init__(self, master, folder=None):
        self.sparkContext, self.master, self.folder, self.found = self, master, folder, None

    def getCheckpointDir(self):
        return self.found

    def getConf(self):
        return self

    def get(self, key):
        return self.folder

    def setCheckpointDir(self, folder):
        self.found = folder


def test_checkpoints_of_a_cluster_are_shared():
    assert checkpoint_dir(Session("local[4]")).startswith("file://") and checkpoint_dir(Session("local")).startswith("file://")
    assert checkpoint_dir(Session("yarn", "hdfs://x")) == "hdfs://x" and checkpoint_dir(Session("local[2]", "s3://y")) == "s3://y"
    for master in ("yarn", "local-cluster[3,2,1000]", "spark://h:7077"):
        with pytest.raises(ValueError, match="share"):
            checkpoint_dir(Session(master))

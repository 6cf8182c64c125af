"""The shared folder."""

import os

import pytest

from parlance import session


def test_shared_folder_is_by_application_and_is_cleaned(spark):
    path = session.shared_folder(spark, "some")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir")) and spark.sparkContext.applicationId in path
    assert session.staged(spark.range(3), "some").count() == 3
    kept = session._base(spark)
    assert os.listdir(kept)
    session.clean(spark)
    assert not os.path.exists(kept)
    assert session.staged(spark.range(3), "some").count() == 3


def test_no_folder_of_one_machine_on_a_cluster():
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session(), "some")

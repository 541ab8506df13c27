"""The checkpoint folder rule and the one-row parameter tables."""

import types

import pytest

from layerlens import session
from layerlens.operators.inference import one_row


def test_one_row_tables(spark):
    assert one_row(spark.createDataFrame([([[1.0, 2.0]], 7)], "w array<array<double>>, k int")) == {"w": [[1.0, 2.0]], "k": 7}
    with pytest.raises(ValueError, match="exactly one row"):
        one_row(spark.createDataFrame([([0.0],), ([1.0],)], "w array<double>"))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"])
def test_no_local_folder_on_a_cluster(master):
    conf = types.SimpleNamespace(get=lambda k, d=None: d)
    sc = types.SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master=master)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(types.SimpleNamespace(sparkContext=sc))

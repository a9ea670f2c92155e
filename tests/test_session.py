"""Where stored intermediates go, and that they go away."""

import os
from types import SimpleNamespace

import pytest

from seqrisk.plans import joins
from seqrisk.plans.joins import release, released, stored
from seqrisk.session import ensure_checkpoint_dir


def session(master, setting=None, context_dir=None):
    context = SimpleNamespace(master=master, applicationId=f"app-{master}", getCheckpointDir=lambda: context_dir)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: setting or default), sparkContext=context)


def test_shared_folder_is_the_one_named():
    assert ensure_checkpoint_dir(session("spark://host:7077", "hdfs://name/shared")) == "hdfs://name/shared"
    assert ensure_checkpoint_dir(session("yarn", None, "hdfs://name/context")) == "hdfs://name/context"


@pytest.mark.parametrize("master", ["yarn", "local-cluster[2,1,1024]", "spark://host:7077", "k8s://https://host"])
def test_no_folder_is_made_up_on_a_cluster(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(session(master))


def test_a_plain_local_session_has_one_of_its_own():
    one = session("local[2]")
    assert ensure_checkpoint_dir(one) == ensure_checkpoint_dir(one) and os.path.isdir(ensure_checkpoint_dir(one))


def test_stored_tables_are_removed(spark):
    table = stored(spark.range(5))
    folder = table.stored_path.removeprefix("file:")
    assert table.count() == 5 and os.path.isdir(folder)
    release(table)
    assert not os.path.exists(folder)
    with released():
        inner = stored(spark.range(3))
        path = inner.stored_path.removeprefix("file:")
        assert inner.count() == 3
    assert not os.path.exists(path)


def test_settled_results_outlive_what_led_to_them(spark):
    paths = []

    def make():
        table = joins.stored(spark.range(5))
        paths.append(table.stored_path)
        return table.where("id > 1")

    out = joins.settled(make)
    assert out.count() == 3 and not os.path.exists(paths[0]) and os.path.exists(out.stored_path)
    with joins.released():
        inner = joins.settled(make)
        assert inner.count() == 3
    assert not os.path.exists(inner.stored_path)

from types import SimpleNamespace

from lodestone.llm import common


def session(setting):
    state = {"dir": None}
    context = SimpleNamespace(getCheckpointDir=lambda: state["dir"], setCheckpointDir=lambda d: state.update(dir=d))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: setting or default), sparkContext=context)


def test_shared_folder_is_the_sessions_own():
    assert common.shared_dir(session("hdfs://host/shared/")) == "hdfs://host/shared"


def test_shared_folder_is_set_once_where_it_is_unset():
    unset = session(None)
    first = common.shared_dir(unset)
    assert first.startswith("file://") and common.shared_dir(unset) == first


def test_a_cluster_without_a_shared_folder_is_refused():
    import pytest

    cluster = session(None)
    cluster.conf = SimpleNamespace(get=lambda key, default: "yarn" if key == "spark.master" else default)
    with pytest.raises(RuntimeError):
        common.shared_dir(cluster)

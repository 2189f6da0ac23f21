import os
from types import SimpleNamespace

import pytest

from bargspark import session


def test_a_cluster_must_name_its_folder(spark):
    none = SimpleNamespace(isDefined=lambda: False)
    jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none))
    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[3,1,1024]"):
        fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=SimpleNamespace(_jsc=jsc, master=master))
        with pytest.raises(ValueError):
            session.shared_dir(fake)
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: "hdfs:///x"), sparkContext=SimpleNamespace(_jsc=jsc, master="yarn"))
    assert session.shared_dir(named) == "hdfs:///x"


def test_kept_table(spark):
    df = spark.range(100).repartition(3)
    before = spark.conf.get(session.CLEANUP)
    kept = session.keep(df, "t")
    assert sorted(r.id for r in kept.collect()) == list(range(100)) and spark.conf.get(session.CLEANUP) == before
    at = kept.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(at)

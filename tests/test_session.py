"""Intermediates go to the folder the session names as its checkpoint folder."""

from urllib.parse import urlparse

from margin_engine.plans.materialize import materialize
from margin_engine.session import ensure_checkpoint_dir
from margin_engine.sources import fixtures as FX


def test_materialize_under_checkpoint_dir(spark, sf001):
    base = ensure_checkpoint_dir(spark)
    assert base and ensure_checkpoint_dir(spark) == base      # stable, not re-created
    df = materialize(FX.table(spark, sf001, "region"), "region")
    files = df.inputFiles()
    assert files and all("/margin-engine/region-" in f for f in files)
    root = urlparse(base).path.rstrip("/")
    assert all(urlparse(f).path.startswith(root + "/") for f in files), (base, files)
    assert df.count() == 5

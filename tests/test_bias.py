import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.plans import bias
from lumenframe.sources.store import Store


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    r = np.random.default_rng(2)
    dlog, n_t, n_l, shift = 1e-4, 260, 120, 3
    template = 8.5 + dlog * np.arange(n_t)
    observed = template[70] + dlog * np.arange(n_l)
    velocities = np.linspace(-90, 90, 13)
    flux = 1 + 0.3 * np.sin(np.arange(n_t) / 3.0) + r.normal(0, 0.2, n_t)
    losvd = np.exp(-0.5 * (velocities[None, :, None] / 25) ** 2) * np.ones((5, 1, 2))
    spectra = np.stack([np.interp(observed - shift * dlog, template, flux) for _ in range(5)], axis=1)
    s = Store(spark, str(tmp_path_factory.mktemp("bias")), 4)
    s.ingest(spectra=spectra, losvd=losvd, templates=flux.reshape(n_t, 1, 1, 1), template_log=template, observed_log=observed, velocities=velocities)
    return s, shift, dlog


def test_offset_before_build(store):
    s, shift, dlog = store
    expected = bias.LIGHT_SPEED * np.expm1(shift * dlog)
    assert abs(bias.offset_before_build(s) - expected) < 0.5 * bias.LIGHT_SPEED * dlog


def test_offset_from_features(spark, store):
    s, shift, dlog = store
    data = s.table("spectra").select("s", F.posexplode("flux").alias("l", "flux")).withColumn("l", F.col("l").cast("long"))
    models = data.select("s", (F.col("l") - shift).alias("l"), F.col("flux").alias("yhat"))
    assert abs(bias.offset_from_features(data, models, dlog, 120, features=4, half=8, smooth=1) - bias.LIGHT_SPEED * np.expm1(shift * dlog)) < 0.5 * bias.LIGHT_SPEED * dlog


def test_template_bounds(store):
    s, _, dlog = store
    low, high = bias.template_bounds(s, pad=8)
    observed = s.axis("observed")
    assert low < observed[0] - 8 * dlog and high > observed[-1] + 8 * dlog and (observed[0] - low) < 20 * dlog

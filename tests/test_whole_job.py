
import numpy as np
from pyspark.sql import functions as F

from riskweave.operators import models
from riskweave.plans import catalogue
from riskweave.sources import series as src

SF = "/root/testdata/sf0.01"


def test_chow_lin_covers_every_day(spark):
    days = src.orders_levels(spark, SF).join(src.ship_counts(spark, SF), "date").agg(F.count("*"), F.max("date")).first()
    got = catalogue.QUERIES["chow_lin_daily"](spark, SF).agg(F.count("*"), F.max("date")).first()
    assert tuple(got) == tuple(days)


def test_chow_lin_finds_a_negative_rho():
    month = np.repeat(np.arange(40), 3)
    x = np.column_stack([np.ones(120), np.linspace(0, 1, 120) ** 2])
    y = 1.0 + 0.1 * (-1.0) ** np.arange(40)
    assert models.chow_lin(y, x, month)[1] < 0


def test_omega_ct_is_the_dense_product():
    month = np.repeat(np.arange(5), [3, 7, 2, 4, 6])
    c = (month[None, :] == np.arange(5)[:, None]) / np.bincount(month)[:, None]
    lag = np.abs(np.subtract.outer(np.arange(22), np.arange(22)))
    for rho in (-0.9, 0.0, 0.4, 0.99):
        assert np.allclose(models.omega_ct(c, rho), (rho**lag) @ c.T)


def test_acerbi_null_has_all_draws(spark):
    assert catalogue.QUERIES["acerbi_null"](spark, SF).first().n == 10_000

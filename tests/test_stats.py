import math

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import stats as T


def test_array_statistics(spark):
    xs = [1.0, None, 3.0, float("nan"), 2.0, float("inf"), 6.0]
    ys = [2.0, 1.0, 5.0, 1.0, 4.0, 1.0]
    df = spark.createDataFrame([(xs, ys, []), (None, None, None)], "x array<double>, y array<double>, e array<double>")
    x, y, e = F.col("x"), F.col("y"), F.col("e")
    c = [1.0, 3.0, 2.0, 6.0]
    wanted = {
        "mean": (T.mean(x), 3), "var": (T.variance(x, 1), np.var(c, ddof=1)), "std": (T.std(x), np.std(c)), "cov": (T.covariance(x, y), np.cov([1, 3, 2], [2, 5, 4], ddof=0)[0, 1]),
        "corr": (T.correlation(x, y), np.corrcoef([1, 3, 2], [2, 5, 4])[0, 1]), "slope": (T.linear_slope(x), np.polyfit(range(4), c, 1)[0]), "z": (T.z_score(F.lit(6.0), x), 3 / np.std(c)),
        "latest": (T.latest_z_score(x), 3 / np.std(c)), "q": (T.percentile(x, 0.3), np.percentile(c, 30)), "rank": (T.rank_pct(F.lit(2.0), x), 0.5), "change": (T.pct_change(F.lit(3.0), F.lit(2.0)), 0.5),
        "log": (T.log_return(F.lit(math.e), F.lit(1.0)), 1), "mom": (T.momentum(x, 2), 1), "few": (T.momentum(x, 9, -1), -1), "vol": (T.volatility(x), np.std([2, -1 / 3, 2])), "none": (T.mean(e, 7), 7), "flat": (T.correlation(y, F.array(*[F.lit(1.0)] * 6), -2), -2),
    }
    got = df.select(*(v.alias(k) for k, (v, _) in wanted.items())).collect()
    for k, (_, value) in wanted.items():
        assert math.isclose(got[0][k], value, abs_tol=1e-9), k
    assert got[1]["mean"] == 0 and got[1]["corr"] == 0
    lists = df.select(T.winsorize(x, 0.0, 0.5).alias("w"), T.min_max_scale(x).alias("m"), T.pct_returns(x).alias("p"), T.log_returns(e).alias("l"), T.tail(T.clean(x), 2).alias("t")).first()
    assert lists["w"] == [1, 2.5, 2, 2.5] and lists["m"] == [0, 0.4, 0.2, 1] and np.allclose(lists["p"], [2, -1 / 3, 2]) and lists["l"] == [] and lists["t"] == [2, 6]

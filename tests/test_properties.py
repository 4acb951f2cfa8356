"""Property tests: exact quantiles equal NumPy's linear interpolation."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from queuelens.operators import quantiles as Q

values = st.lists(st.one_of(st.integers(-50, 50).map(float),
                            st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False)),
                  min_size=1, max_size=300)
probs = st.lists(st.floats(0.0, 1.0), min_size=1, max_size=5)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(xs=values, ps=probs)
def test_quantiles_match_numpy(spark, xs, ps):
    Q.BINS = 8                               # many refinements on purpose
    try:
        df = spark.createDataFrame(pd.DataFrame({"x": np.array(xs, dtype="float64")}))
        got = {r.qi: r.quantile for r in Q.exact_quantiles(df, "x", ps).collect()}
    finally:
        Q.BINS = 65_536
    s = np.sort(np.array(xs))
    for i, p in enumerate(ps):
        pos = p * (len(s) - 1)
        lo, hi = int(np.floor(pos)), int(np.ceil(pos))
        assert got[i] == s[lo] + (s[hi] - s[lo]) * (pos - lo)

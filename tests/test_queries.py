"""Every registered query that has SQL gives the SQL's rows, with very small order buckets."""

import pytest

import ratelark.operators.ordered as ordered
from ratelark.plans.catalogue import ORACLES, QUERIES

SMALL = ["area_rating", "ordered_rows", "cc_segments", "cc_mean_curve", "cumul_calib_sides",
         "spearman_weighted", "abc_sdcl", "group_stats", "auto_calibration", "fold_labels_block",
         "quantile_split", "split_distribution", "calib_tail_pool", "calib_bin_means", "scale_robust",
         "category_reduce", "one_hot", "best_trials", "glm_areas_gamma_inverse", "isotonic",
         "isotonic_tails", "isotonic_unique", "centered_isotonic_unique", "isotonic_tails_unique",
         "calib_moving_mean_gaussian_unique"]


def plain(value):
    if value is None:
        return ""
    return repr(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) \
        else str(value)


@pytest.mark.parametrize("name", SMALL)
def test_query_matches_sql(spark, sf, duck, name, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_BUCKET", 100)
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    assert got == want


def test_loess_without_ties(spark, sf, duck, monkeypatch):
    """Some windows of this table hold two narrow groups of predictions only: their determinants
    are near the limit of 1e-12, where the SQL's sums lose digits as ours do (1e-5 seen)."""
    monkeypatch.setattr(ordered, "ROWS_PER_BUCKET", 100)
    got = {(r.part, r.IDpol): r.calibrated for r in QUERIES["loess_unique"](spark, sf).collect()}
    want = {(part, i): v for part, i, v in duck.execute(
        f"SELECT part, IDpol, calibrated FROM ({ORACLES['loess_unique']})").fetchall()}
    gaps = sorted(abs(got[k] - v) for k, v in want.items())
    assert set(got) == set(want)
    assert gaps[-1] < 3e-4 and gaps[int(0.95 * len(gaps))] < 1e-9


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() == 6

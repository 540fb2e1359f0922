"""Shared SQL fragments: the portfolio views of ``sources.portfolio_views`` as CTEs."""

CLAIMS = """clm AS (
  SELECT CAST(l_orderkey AS BIGINT) AS IDpol,
         CAST(l_extendedprice AS DOUBLE) * CAST(l_discount AS DOUBLE) AS ClaimAmount
  FROM lineitem WHERE l_returnflag = 'R')"""

POLICIES = CLAIMS + """,
nb AS (SELECT IDpol, count(*) AS nb FROM clm GROUP BY IDpol),
pol AS (
  SELECT CAST(o_orderkey AS BIGINT) AS IDpol,
         substr('ABCDEF', CAST(o_custkey % 6 + 1 AS INT), 1) AS Area,
         CAST(16 + o_custkey % 75 AS BIGINT) AS DrivAge,
         CAST(o_orderkey % 20 AS BIGINT) AS VehAge,
         CAST(4 + o_orderkey % 12 AS BIGINT) AS VehPower,
         CAST(50 + (o_custkey * 7) % 180 AS BIGINT) AS BonusMalus,
         CAST(1 + (o_custkey * 13) % 27000 AS DOUBLE) AS Density,
         c_mktsegment AS Brand, r_name AS Region,
         CAST(o_orderkey % 25 AS DOUBLE) / CAST(20 AS DOUBLE) AS Exposure,
         CAST(o_orderkey % 5 AS VARCHAR) AS part,
         CAST(o_custkey % 6 AS DOUBLE) AS cust6,
         coalesce(nb, 0) + CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS ClaimNb
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN nb ON nb.IDpol = o_orderkey)"""

JOINED = POLICIES + """,
agg AS (SELECT IDpol, round(sum(ClaimAmount), 4) AS s, count(ClaimAmount) AS c FROM clm GROUP BY IDpol),
joined AS (
  SELECT pol.*, coalesce(s, CAST(0 AS DOUBLE)) AS claim_sum, coalesce(c, 0) AS claim_count
  FROM pol LEFT JOIN agg ON pol.IDpol = agg.IDpol)"""

PREPARED = JOINED + """,
capped AS (
  SELECT * EXCLUDE (Exposure, ClaimNb), least(Exposure, CAST(1 AS DOUBLE)) AS Exposure,
         CAST(least(ClaimNb, 4) AS BIGINT) AS ClaimNb_TRG
  FROM joined WHERE Exposure > 0),
prep AS (
  SELECT *, claim_count AS ClaimCountWeight, claim_sum AS ClaimTotalAmount_TRG,
         CAST(ClaimNb_TRG AS DOUBLE) / Exposure AS ClaimFreq_TRG,
         claim_sum / CAST(greatest(claim_count, 1) AS DOUBLE) AS ClaimSeverity_TRG,
         claim_sum / Exposure AS ClaimPurePremium_TRG,
         round(CAST(0.2 AS DOUBLE) + CAST(0.05 AS DOUBLE) * cust6
               + CAST(0.01 AS DOUBLE) * CAST(VehAge AS DOUBLE), 6) AS pred_tied
  FROM capped)"""


def predictions(pred: str = "pred_tied", target: str = "ClaimFreq_TRG", w: str = "Exposure") -> str:
    """CTEs up to ``t(part, IDpol, y, pred, w)``."""
    expr = {
        "pred_tied": "pred_tied",
        "pred_signal": "pred_tied * (CAST(1 AS DOUBLE) + CAST(0.3 AS DOUBLE)"
                       " * CAST(ClaimNb_TRG AS DOUBLE))",
        "pred_unique": "pred_tied + CAST(IDpol AS DOUBLE) * CAST(1e-9 AS DOUBLE)",
    }[pred]
    keep = " WHERE ClaimSeverity_TRG > 0" if target == "ClaimSeverity_TRG" else ""
    return PREPARED + f""",
t AS (SELECT part, IDpol, CAST({target} AS DOUBLE) AS y, {expr} AS pred,
             CAST({w} AS DOUBLE) AS w FROM prep{keep})"""


def r(expr: str, digits: int = 6) -> str:
    """Rounded, and never -0.0."""
    return f"round({expr}, {digits}) + 0.0"

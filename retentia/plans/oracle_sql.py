"""DuckDB text of every registered query (the independent oracle).

Each query is one ``WITH`` chain over the raw test tables (``customer``,
``orders``, ``lineitem``, ``events``), so the oracle shares nothing with the
Spark code except the definitions. Literals are cast to DOUBLE so that DuckDB
does the same IEEE arithmetic as Spark (its bare decimals are exact
decimals). Computed doubles that depend on summation order or on a math
library (``ln``, ``exp``) are rounded to 6 places on both sides, half to
even on the scaled value.
"""

from __future__ import annotations

from ..config import (
    BASE_NUMERIC_FEATURES,
    DEFAULT_CONFIG,
    LATENCY_BUCKETS,
    MODEL_FEATURES,
    SCENARIOS,
    SEGMENT_CHURN,
    SEGMENT_HIGH_RENEWAL,
    SEGMENT_INSIGHTS,
    SEGMENT_MODERATE,
)
from ..sources.accounts import ACCOUNTS_SQL
from ..operators.explain import STAND_IN_IMPORTANCES
from ..functions.scoring import STAND_IN_CENTER, STAND_IN_SCALE

CFG = DEFAULT_CONFIG
SEED = CFG.random_state
DERIVED_ROUNDED = ("engagement_score", "activity_ratio", "support_pressure", "payment_reliability", "usage_momentum")


def d(x: float) -> str:
    """A DOUBLE literal."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def q6(expr: str) -> str:
    return f"(round_even(({expr}) * {d(1e6)}, 0) / {d(1e6)})"


def _plan_value() -> str:
    whens = " ".join(f"WHEN '{k}' THEN {d(v)}" for k, v in CFG.plan_scores)
    return f"CASE subscription_plan {whens} END"


_COERCE = ",\n    ".join(
    f"COALESCE(CASE WHEN isnan({c}) THEN NULL ELSE {c} END, {d(0)}) AS {c}" for c in BASE_NUMERIC_FEATURES
)
_PLAN_NORM = (
    "CASE WHEN lower(regexp_replace(COALESCE(subscription_plan, 'growth'), '^\\s+|\\s+$', '', 'g')) "
    "IN ('starter', 'growth', 'business', 'enterprise') "
    "THEN lower(regexp_replace(COALESCE(subscription_plan, 'growth'), '^\\s+|\\s+$', '', 'g')) ELSE 'growth' END"
)


def features_ctes(source: str = "accounts", keep: str = "account_id, renewed", prefix: str = "") -> str:
    """coerced -> feat0 (raw derived) -> feat (registered precision)."""
    c0, f0, f1 = f"{prefix}coerced", f"{prefix}feat0", f"{prefix}feat"
    risk = (
        f"payment_failures * {d(CFG.payment_failure_risk_weight)} + last_login_days * {d(CFG.inactivity_risk_weight)}"
        f" + support_tickets * {d(CFG.support_ticket_risk_weight)} - engagement_score * {d(CFG.engagement_relief_weight)}"
        f" - plan_value_index * {d(0.35)}"
    )
    derived = ", ".join(f"{q6(c)} AS {c}" for c in DERIVED_ROUNDED)
    return f"""
{c0} AS (
  SELECT {keep},
    {_COERCE},
    {_PLAN_NORM} AS subscription_plan
  FROM {source}),
{f0} AS (
  SELECT *, {_plan_value()} AS plan_value_index,
    monthly_usage_hours / (last_login_days + {d(1)}) AS engagement_score,
    login_frequency / (monthly_usage_hours + {d(1)}) AS activity_ratio,
    support_tickets / (login_frequency + {d(1)}) AS support_pressure,
    {d(1)} / (payment_failures + {d(1)}) AS payment_reliability,
    monthly_usage_hours * ln({d(1)} + login_frequency) AS usage_momentum
  FROM {c0}),
{f1} AS (
  SELECT {keep}, monthly_usage_hours, login_frequency, last_login_days, support_tickets, payment_failures,
    plan_value_index, {derived},
    round_even(greatest({d(0)}, {risk}) * {d(10000)}, 0) / {d(10000)} AS risk_score
  FROM {f0})"""


def split_ctes() -> str:
    return f"""
cls AS (SELECT renewed, COUNT(*) AS n_class FROM feat GROUP BY renewed),
tot AS (SELECT SUM(n_class) AS n, SUM(n_class) - CAST(ceil({d(CFG.test_share)} * SUM(n_class)) AS BIGINT) AS n_train FROM cls),
al0 AS (SELECT c.renewed, c.n_class, (t.n_train * c.n_class) // t.n AS fl, (t.n_train * c.n_class) % t.n AS rem, t.n_train
        FROM cls c CROSS JOIN tot t),
al1 AS (SELECT *, n_train - SUM(fl) OVER () AS need, row_number() OVER (ORDER BY rem DESC, renewed) AS rk FROM al0),
alloc AS (SELECT renewed, n_class - (fl + CASE WHEN rk <= need THEN 1 ELSE 0 END) AS n_test FROM al1),
ranked AS (SELECT f.*, row_number() OVER (PARTITION BY renewed
             ORDER BY md5(concat_ws(':', CAST(account_id AS VARCHAR), '{SEED}')), account_id) AS rn FROM feat f),
split AS (SELECT r.* EXCLUDE (rn), CASE WHEN r.rn <= a.n_test THEN 'test' ELSE 'train' END AS split
          FROM ranked r JOIN alloc a ON r.renewed = a.renewed)"""


def probability_expr(risk: str = "risk_score") -> str:
    return q6(f"{d(1)} / ({d(1)} + exp(({risk} - {d(STAND_IN_CENTER)}) / {d(STAND_IN_SCALE)}))")


def scored_ctes(source: str = "split") -> str:
    return f"""
scored AS (SELECT *, {probability_expr()} AS renewal_probability FROM {source}),
predicted AS (SELECT *, CASE WHEN renewal_probability >= {d(CFG.prediction_threshold)} THEN 1 ELSE 0 END AS renewal_prediction FROM scored)"""


def with_(*blocks: str) -> str:
    return "WITH " + ",\n".join(b.strip().rstrip(",") for b in blocks)


def long_union(source: str, columns, where: str = "", value_cast: str = "DOUBLE", extra: str = "") -> str:
    cond = f" WHERE {where}" if where else ""
    sel = ", ".join(x for x in [extra] if x)
    prefix = f"{sel}, " if sel else ""
    return "\n  UNION ALL ".join(
        f"SELECT {prefix}'{c}' AS \"column\", CAST({c} AS {value_cast}) AS value FROM {source}{cond}" for c in columns
    )


def medians_ctes(source: str = "split", where: str = "split = 'train'", columns=MODEL_FEATURES, name: str = "med") -> str:
    return f"""
{name}_lf AS ({long_union(source, columns, where)}),
{name}_r AS (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY value) AS rn,
               COUNT(*) OVER (PARTITION BY "column") AS n
             FROM {name}_lf WHERE value IS NOT NULL AND NOT isnan(value)),
{name}_p AS (SELECT "column", value, rn, n, (n - 1) * {d(0.5)} AS h FROM {name}_r),
{name} AS (SELECT "column",
  MAX(CASE WHEN rn = CAST(floor(h) AS BIGINT) + 1 THEN value END)
  + (MAX(CASE WHEN rn = CAST(ceil(h) AS BIGINT) + 1 THEN value END)
     - MAX(CASE WHEN rn = CAST(floor(h) AS BIGINT) + 1 THEN value END)) * MAX(h - floor(h)) AS median
  FROM {name}_p GROUP BY "column")"""


# -- the queries ---------------------------------------------------------------


def account_scan() -> str:
    cols = ", ".join(CFG.source_columns)
    return with_(ACCOUNTS_SQL) + f"\nSELECT account_id, {cols} FROM accounts"


def coerced_inputs() -> str:
    return with_(ACCOUNTS_SQL, features_ctes()) + "\nSELECT account_id, " + ", ".join(BASE_NUMERIC_FEATURES) + " FROM coerced"


def plan_normalized() -> str:
    return with_(ACCOUNTS_SQL) + f"\nSELECT account_id, subscription_plan AS raw_plan, {_PLAN_NORM} AS subscription_plan FROM accounts"


def plan_value_index() -> str:
    return with_(ACCOUNTS_SQL, features_ctes()) + "\nSELECT account_id, subscription_plan, plan_value_index FROM feat0"


def renewal_features() -> str:
    return with_(ACCOUNTS_SQL, features_ctes()) + "\nSELECT * FROM feat"


def risk_score() -> str:
    return with_(ACCOUNTS_SQL, features_ctes()) + "\nSELECT account_id, engagement_score, plan_value_index, risk_score FROM feat"


def validation_profile() -> str:
    nulls = " + ".join(f"COUNT(*) - COUNT({c})" for c in CFG.source_columns)
    cols_with = " + ".join(f"CASE WHEN COUNT(*) - COUNT({c}) > 0 THEN 1 ELSE 0 END" for c in CFG.source_columns)
    return with_(ACCOUNTS_SQL) + f"""
SELECT COUNT(*) AS row_count, 0 AS missing_column_count, CAST({nulls} AS BIGINT) AS null_cells,
  CAST({cols_with} AS INTEGER) AS columns_with_nulls,
  COUNT(DISTINCT CAST(renewed AS DOUBLE)) AS target_class_count,
  (COUNT(DISTINCT CAST(renewed AS DOUBLE)) = 2 AND MIN(renewed) = 0 AND MAX(renewed) = 1) AS binary_target
FROM accounts"""


def null_counts() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", COUNT(*) - COUNT({c}) AS null_count FROM accounts" for c in CFG.source_columns
    )
    return with_(ACCOUNTS_SQL) + f"\n{parts}"


def target_classes() -> str:
    return with_(ACCOUNTS_SQL) + "\nSELECT DISTINCT renewed AS target_class FROM accounts WHERE renewed IS NOT NULL ORDER BY 1"


def contract_violations() -> str:
    checks = []
    for c in BASE_NUMERIC_FEATURES:
        checks.append(f"CASE WHEN {c} IS NULL OR isnan({c}) THEN '{c}:missing' END")
        checks.append(f"CASE WHEN {c} < 0 THEN '{c}:negative' END")
    checks.append("CASE WHEN subscription_plan IS NULL THEN 'subscription_plan:missing' END")
    checks.append("CASE WHEN length(subscription_plan) < 3 OR length(subscription_plan) > 32 THEN 'subscription_plan:length' END")
    count = " + ".join(f"CASE WHEN ({x}) IS NOT NULL THEN 1 ELSE 0 END" for x in checks)
    return with_(ACCOUNTS_SQL) + f"""
SELECT account_id, concat_ws(',', {', '.join(checks)}) AS violations,
  CAST({count} AS INTEGER) AS violation_count, ({count}) = 0 AS is_valid
FROM accounts"""


def stratified_split() -> str:
    return with_(ACCOUNTS_SQL, features_ctes(), split_ctes()) + "\nSELECT account_id, renewed, split FROM split"


def cv_folds() -> str:
    return with_(ACCOUNTS_SQL, features_ctes(), split_ctes()) + f"""
SELECT account_id, renewed, CAST((row_number() OVER (PARTITION BY renewed
  ORDER BY md5(concat_ws(':', CAST(account_id AS VARCHAR), '{SEED}', 'fold')), account_id) - 1) % {CFG.cv_folds} AS INTEGER) AS fold
FROM split WHERE split = 'train'"""


def feature_medians() -> str:
    return with_(ACCOUNTS_SQL, features_ctes(), split_ctes(), medians_ctes()) + f'\nSELECT "column", {q6("median")} AS median FROM med'


def _test_predicted() -> str:
    return with_(ACCOUNTS_SQL, features_ctes(), split_ctes(), scored_ctes())


def _counts(where: str = "split = 'test'") -> str:
    return f"""
SELECT COUNT(CASE WHEN renewed <> 1 AND renewal_prediction <> 1 THEN 1 END) AS tn,
       COUNT(CASE WHEN renewed <> 1 AND renewal_prediction = 1 THEN 1 END) AS fp,
       COUNT(CASE WHEN renewed = 1 AND renewal_prediction <> 1 THEN 1 END) AS fn,
       COUNT(CASE WHEN renewed = 1 AND renewal_prediction = 1 THEN 1 END) AS tp
FROM predicted WHERE {where}"""


def confusion_matrix() -> str:
    return _test_predicted() + f""",
cm AS ({_counts()})
SELECT 0 AS actual, 0 AS predicted, tn AS "count" FROM cm UNION ALL
SELECT 0, 1, fp FROM cm UNION ALL SELECT 1, 0, fn FROM cm UNION ALL SELECT 1, 1, tp FROM cm"""


def _div0(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) = 0 THEN {d(0)} ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END"


def binary_metrics() -> str:
    return _test_predicted() + f""",
cm AS ({_counts()})
SELECT {_div0('tp + tn', 'tn + fp + fn + tp')} AS accuracy, {_div0('tp', 'tp + fp')} AS "precision",
  {_div0('tp', 'tp + fn')} AS recall, {_div0('2 * tp', '2 * tp + fp + fn')} AS f1 FROM cm"""


def classification_report() -> str:
    p0, r0, f0 = _div0("tn", "tn + fn"), _div0("tn", "tn + fp"), _div0("2 * tn", "2 * tn + fn + fp")
    p1, r1, f1 = _div0("tp", "tp + fp"), _div0("tp", "tp + fn"), _div0("2 * tp", "2 * tp + fp + fn")
    acc = _div0("tp + tn", "tn + fp + fn + tp")
    s0, s1 = "CAST(tn + fp AS DOUBLE)", "CAST(tp + fn AS DOUBLE)"
    tot = f"({s0} + {s1})"

    def w(a: str, b: str) -> str:
        return f"CASE WHEN {tot} = 0 THEN {d(0)} ELSE (({a}) * {s0} + ({b}) * {s1}) / {tot} END"

    return _test_predicted() + f""",
cm AS ({_counts()})
SELECT '0' AS label, {p0} AS "precision", {r0} AS recall, {f0} AS f1_score, {s0} AS support FROM cm UNION ALL
SELECT '1', {p1}, {r1}, {f1}, {s1} FROM cm UNION ALL
SELECT 'accuracy', {acc}, {acc}, {acc}, {tot} FROM cm UNION ALL
SELECT 'macro avg', (({p0}) + ({p1})) / 2, (({r0}) + ({r1})) / 2, (({f0}) + ({f1})) / 2, {tot} FROM cm UNION ALL
SELECT 'weighted avg', {w(p0, p1)}, {w(r0, r1)}, {w(f0, f1)}, {tot} FROM cm"""


def _auc_body(source: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    return f"""
sc AS (SELECT {g}renewal_probability AS s, COUNT(CASE WHEN renewed = 1 THEN 1 END) AS pos,
         COUNT(CASE WHEN renewed <> 1 THEN 1 END) AS neg FROM {source} GROUP BY {g}renewal_probability),
sc2 AS (SELECT *, SUM(neg) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM sc),
auc AS (SELECT {g}CAST(SUM(CAST(pos AS HUGEINT) * (2 * cum_neg - neg)) AS DOUBLE)
          / ({d(2)} * CAST(SUM(pos) AS DOUBLE) * CAST(SUM(neg) AS DOUBLE)) AS roc_auc FROM sc2 {gb})"""


def _ap_body(source: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    return f"""
ap0 AS (SELECT {g}renewal_probability AS s, COUNT(CASE WHEN renewed = 1 THEN 1 END) AS pos,
          COUNT(CASE WHEN renewed <> 1 THEN 1 END) AS neg FROM {source} GROUP BY {g}renewal_probability),
ap1 AS (SELECT *, SUM(pos) OVER ({part}ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
          SUM(neg) OVER ({part}ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp FROM ap0),
ap AS (SELECT {g}SUM(pos * (CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE))) / SUM(pos) AS average_precision FROM ap1 {gb})"""


def roc_auc() -> str:
    return _test_predicted() + "," + _auc_body("predicted WHERE split = 'test'") + f"\nSELECT {q6('roc_auc')} AS roc_auc FROM auc"


def average_precision() -> str:
    return (
        _test_predicted() + "," + _ap_body("predicted WHERE split = 'test'")
        + f"\nSELECT {q6('average_precision')} AS average_precision FROM ap"
    )


def labeled_predictions() -> str:
    cols = ", ".join(f"a.{c}" for c in CFG.source_columns)
    return with_(ACCOUNTS_SQL, features_ctes(), scored_ctes("feat")) + f"""
SELECT a.account_id, {cols}, p.renewal_probability, p.renewal_prediction,
  CASE p.renewal_prediction WHEN 0 THEN 'not_renewed' WHEN 1 THEN 'renewed' ELSE CAST(p.renewal_prediction AS VARCHAR) END AS renewal_label
FROM accounts a JOIN predicted p ON a.account_id = p.account_id"""


def _segment(p: str = "renewal_probability") -> str:
    return (
        f"CASE WHEN {p} > {d(0.75)} THEN '{SEGMENT_HIGH_RENEWAL}' WHEN {p} >= {d(0.4)} THEN '{SEGMENT_MODERATE}' "
        f"ELSE '{SEGMENT_CHURN}' END"
    )


def _insight(seg: str = "risk_segment") -> str:
    whens = " ".join(f"WHEN '{name}' THEN '{text}'" for name, text in SEGMENT_INSIGHTS)
    return f"CASE {seg} {whens} END"


def risk_segments() -> str:
    return with_(ACCOUNTS_SQL, features_ctes(), scored_ctes("feat")) + f""",
seg AS (SELECT account_id, renewal_probability, {_segment()} AS risk_segment FROM scored)
SELECT account_id, renewal_probability, risk_segment, {_insight()} AS insight FROM seg"""


def segment_summary() -> str:
    return with_(ACCOUNTS_SQL, features_ctes(), scored_ctes("feat")) + f""",
seg AS (SELECT renewed, renewal_probability, {_segment()} AS risk_segment FROM scored)
SELECT risk_segment, COUNT(*) AS accounts, {q6('AVG(renewal_probability)')} AS mean_probability,
  {q6('AVG(CAST(renewed AS DOUBLE))')} AS renewal_rate FROM seg GROUP BY risk_segment"""


def _contrib_long(source: str = "feat") -> str:
    parts = []
    for i, f in enumerate(MODEL_FEATURES):
        parts.append(
            f"SELECT s.account_id, {i} AS feature_index, '{f}' AS feature, CAST(s.{f} AS DOUBLE) AS feature_value,"
            f" (CAST(s.{f} AS DOUBLE) - COALESCE(m.median, {d(0)})) * {d(STAND_IN_IMPORTANCES[i])} AS contribution"
            f" FROM {source} s LEFT JOIN med m ON m.\"column\" = '{f}'"
        )
    return "\n  UNION ALL ".join(parts)


def feature_contributions() -> str:
    return with_(ACCOUNTS_SQL, features_ctes(), split_ctes(), medians_ctes()) + f""",
contrib AS ({_contrib_long()})
SELECT account_id, feature_index, feature, feature_value, {q6('contribution')} AS contribution FROM contrib"""


def top_factors(k: int = CFG.top_k) -> str:
    return with_(ACCOUNTS_SQL, features_ctes(), split_ctes(), medians_ctes()) + f""",
contrib AS ({_contrib_long()}),
rk AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY abs(contribution) DESC, feature_index) AS "rank" FROM contrib)
SELECT account_id, CAST("rank" AS INTEGER) AS "rank", feature, feature_value, {q6('contribution')} AS contribution FROM rk WHERE "rank" <= {int(k)}"""


def global_importance() -> str:
    return with_(ACCOUNTS_SQL, features_ctes(), split_ctes(), medians_ctes()) + f""",
contrib AS ({_contrib_long()})
SELECT feature_index, feature, {q6('AVG(abs(contribution))')} AS mean_abs_contribution FROM contrib GROUP BY feature_index, feature"""


def scenario_features() -> str:
    fixed = " UNION ALL ".join(
        f"SELECT '{name}' AS profile, CAST(NULL AS BIGINT) AS account_id, "
        + ", ".join(f"{d(v)} AS {c}" for c, v in zip(BASE_NUMERIC_FEATURES, vals[:5]))
        + f", '{vals[5]}' AS subscription_plan"
        for name, vals in SCENARIOS
    )
    med_cols = ", ".join(f"COALESCE(MAX(CASE WHEN \"column\" = '{c}' THEN median END), {d(0)}) AS {c}" for c in BASE_NUMERIC_FEATURES)
    return with_(
        ACCOUNTS_SQL,
        features_ctes(),
        split_ctes(),
        medians_ctes("split", "split = 'train'", BASE_NUMERIC_FEATURES, "imed"),
        f"""
inputs AS (
  SELECT 'account' AS profile, account_id, {', '.join(BASE_NUMERIC_FEATURES)}, subscription_plan FROM accounts
  UNION ALL SELECT 'default', CAST(NULL AS BIGINT), {', '.join(BASE_NUMERIC_FEATURES)}, 'growth' FROM (SELECT {med_cols} FROM imed)
  UNION ALL {fixed})""",
        features_ctes("inputs", "profile, account_id", prefix="s_"),
    ) + f""",
s_scored AS (SELECT *, {probability_expr()} AS renewal_probability FROM s_feat)
SELECT COALESCE(CAST(account_id AS VARCHAR), profile) AS subject, * EXCLUDE (account_id), {_segment()} AS risk_segment FROM s_scored"""


def _drift_sides() -> str:
    cols = list(MODEL_FEATURES) + ["renewal_probability", "renewed"]
    ref = long_union("scored", cols, "split = 'train'", extra="'reference' AS side")
    cur = long_union("scored", cols, "split = 'test'", extra="'current' AS side")
    return f"""
lf AS ({ref}
  UNION ALL {cur}),
vc AS (SELECT "column", value, COUNT(CASE WHEN side = 'reference' THEN 1 END) AS ref_cnt,
         COUNT(CASE WHEN side = 'current' THEN 1 END) AS cur_cnt
       FROM lf WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY "column", value),
vs AS (SELECT *, SUM(ref_cnt) OVER (PARTITION BY "column") AS n_ref, SUM(cur_cnt) OVER (PARTITION BY "column") AS n_cur,
         SUM(ref_cnt) OVER (PARTITION BY "column" ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_ref,
         SUM(cur_cnt) OVER (PARTITION BY "column" ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_cur,
         lead(value) OVER (PARTITION BY "column" ORDER BY value) AS next_value
       FROM vc),
shape AS (SELECT "column", MAX(abs(CAST(cum_ref AS DOUBLE) / CAST(n_ref AS DOUBLE) - CAST(cum_cur AS DOUBLE) / CAST(n_cur AS DOUBLE))) AS ks_statistic,
            SUM(abs(CAST(cum_ref AS DOUBLE) / CAST(n_ref AS DOUBLE) - CAST(cum_cur AS DOUBLE) / CAST(n_cur AS DOUBLE))
                * COALESCE(next_value - value, {d(0)})) AS wasserstein
          FROM vs GROUP BY "column"),
pb AS (SELECT "column", least(CAST({CFG.psi_buckets - 1} AS BIGINT), CAST(floor({CFG.psi_buckets} * (cum_ref - ref_cnt) / n_ref) AS BIGINT)) AS bucket,
         CAST(SUM(ref_cnt) AS DOUBLE) / CAST(MAX(n_ref) AS DOUBLE) AS p_ref, CAST(SUM(cur_cnt) AS DOUBLE) / CAST(MAX(n_cur) AS DOUBLE) AS p_cur
       FROM vs GROUP BY 1, 2),
psi AS (SELECT "column", SUM((greatest(p_cur, {d(1e-4)}) - greatest(p_ref, {d(1e-4)})) * ln(greatest(p_cur, {d(1e-4)}) / greatest(p_ref, {d(1e-4)}))) AS psi
        FROM pb GROUP BY "column"),
dd AS (SELECT p."column", p.psi, s.ks_statistic, s.wasserstein,
         (p.psi > {d(CFG.psi_threshold)} OR s.ks_statistic > {d(CFG.ks_threshold)}) AS drifted
       FROM psi p JOIN shape s ON p."column" = s."column")"""


def _drift_prefix() -> str:
    return with_(ACCOUNTS_SQL, features_ctes(), split_ctes(), scored_ctes(), _drift_sides())


def drift_mean_delta() -> str:
    cols = list(MODEL_FEATURES) + ["renewal_probability", "renewed"]
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", AVG(CASE WHEN split = 'train' THEN CAST({c} AS DOUBLE) END) AS r,"
        f" AVG(CASE WHEN split = 'test' THEN CAST({c} AS DOUBLE) END) AS c FROM scored"
        for c in cols
    )
    return with_(ACCOUNTS_SQL, features_ctes(), split_ctes(), scored_ctes()) + f""",
md AS ({parts})
SELECT "column", {q6('r')} AS reference_mean, {q6('c')} AS current_mean, {q6('c - r')} AS mean_delta FROM md"""


def drift_psi() -> str:
    return _drift_prefix() + f'\nSELECT "column", {q6("psi")} AS psi FROM dd'


def drift_ks() -> str:
    return _drift_prefix() + f'\nSELECT "column", {q6("ks_statistic")} AS ks_statistic FROM dd'


def drift_wasserstein() -> str:
    return _drift_prefix() + f'\nSELECT "column", {q6("wasserstein")} AS wasserstein FROM dd'


def drift_summary() -> str:
    return _drift_prefix() + f"""
SELECT COUNT(*) AS n_columns, COUNT(CASE WHEN drifted THEN 1 END) AS n_drifted,
  CAST(COUNT(CASE WHEN drifted THEN 1 END) AS DOUBLE) / COUNT(*) AS share_drifted,
  CAST(COUNT(CASE WHEN drifted THEN 1 END) AS DOUBLE) / COUNT(*) >= {d(0.5)} AS dataset_drift,
  (SELECT COUNT(*) FROM split WHERE split = 'train') AS reference_rows,
  (SELECT COUNT(*) FROM split WHERE split = 'test') AS current_rows
FROM dd"""


def quality_by_side() -> str:
    src = "(SELECT CASE WHEN split = 'train' THEN 'reference' ELSE 'current' END AS side, * FROM predicted)"
    return _test_predicted() + f""",
sided AS {src},
cmx AS (SELECT side,
       COUNT(CASE WHEN renewed <> 1 AND renewal_prediction <> 1 THEN 1 END) AS tn,
       COUNT(CASE WHEN renewed <> 1 AND renewal_prediction = 1 THEN 1 END) AS fp,
       COUNT(CASE WHEN renewed = 1 AND renewal_prediction <> 1 THEN 1 END) AS fn,
       COUNT(CASE WHEN renewed = 1 AND renewal_prediction = 1 THEN 1 END) AS tp
     FROM sided GROUP BY side),""" + _auc_body("sided", "side") + "," + _ap_body("sided", "side") + f"""
SELECT c.side, {_div0('tp + tn', 'tn + fp + fn + tp')} AS accuracy, {_div0('tp', 'tp + fp')} AS "precision",
  {_div0('tp', 'tp + fn')} AS recall, {_div0('2 * tp', '2 * tp + fp + fn')} AS f1,
  {q6('a.roc_auc')} AS roc_auc, {q6('p.average_precision')} AS average_precision
FROM cmx c JOIN auc a ON c.side = a.side JOIN ap p ON c.side = p.side"""


def top_risky_accounts(k: int = 20) -> str:
    return with_(ACCOUNTS_SQL, features_ctes(), scored_ctes("feat")) + f"""
SELECT account_id, renewed, risk_score, engagement_score, payment_failures, last_login_days, renewal_probability,
  {_segment()} AS risk_segment
FROM scored ORDER BY risk_score DESC, account_id LIMIT {int(k)}"""


# -- request monitoring ----------------------------------------------------------

_LOG = f"""log AS (SELECT ts, value / {d(100)} AS latency_seconds, event_type = 'error' AS failed FROM events)"""


def request_totals() -> str:
    return f"WITH {_LOG}\nSELECT COUNT(*) AS requests, COUNT(CASE WHEN failed THEN 1 END) AS errors FROM log"


def latency_histogram() -> str:
    rows = []
    for b in LATENCY_BUCKETS:
        rows.append(f"SELECT '{float(b)!r}' AS le, COUNT(CASE WHEN latency_seconds <= {d(b)} THEN 1 END) AS bucket_count FROM log")
    rows.append("SELECT '+Inf' AS le, COUNT(*) AS bucket_count FROM log")
    body = " UNION ALL ".join(rows)
    return f"""WITH {_LOG},
b AS ({body}),
t AS (SELECT {q6('SUM(latency_seconds)')} AS latency_sum, COUNT(*) AS latency_count FROM log)
SELECT b.le, b.bucket_count, t.latency_sum, t.latency_count FROM b CROSS JOIN t"""


def error_rate() -> str:
    return f"""WITH {_LOG},
t AS (SELECT COUNT(*) AS requests, COUNT(CASE WHEN failed THEN 1 END) AS errors FROM log)
SELECT requests, errors, CASE WHEN requests = 0 THEN {d(0)} ELSE CAST(errors AS DOUBLE) / CAST(requests AS DOUBLE) END AS error_rate FROM t"""


def request_rate_5m() -> str:
    return f"""WITH {_LOG},
w AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, COUNT(*) AS requests,
        COUNT(CASE WHEN failed THEN 1 END) AS errors FROM log GROUP BY 1)
SELECT window_start, window_start + INTERVAL '5 minutes' AS window_end, requests, errors,
  CAST(requests AS DOUBLE) / {d(300)} AS request_rate FROM w"""


def request_rate_sliding() -> str:
    return f"""WITH {_LOG},
panes AS (SELECT time_bucket(INTERVAL '15 seconds', ts) AS pane, COUNT(*) AS requests,
            COUNT(CASE WHEN failed THEN 1 END) AS errors FROM log GROUP BY 1),
w AS (SELECT pane - k * INTERVAL '15 seconds' AS window_start, SUM(requests) AS requests, SUM(errors) AS errors
      FROM panes CROSS JOIN range(20) AS r(k) GROUP BY 1)
SELECT window_start, window_start + INTERVAL '5 minutes' AS window_end, CAST(requests AS BIGINT) AS requests,
  CAST(errors AS BIGINT) AS errors, CAST(requests AS DOUBLE) / {d(300)} AS request_rate FROM w"""


def drift_shifted() -> str:
    sides = f"""
sided AS (SELECT *, CASE WHEN plan_value_index < {d(CFG.plan_score_map['business'])} THEN 'train' ELSE 'test' END AS split FROM feat)"""
    return with_(ACCOUNTS_SQL, features_ctes(), sides, scored_ctes("sided"), _drift_sides()) + f"""
SELECT "column", {q6("psi")} AS psi, {q6("ks_statistic")} AS ks_statistic, {q6("wasserstein")} AS wasserstein, drifted FROM dd"""


def drift_tests() -> str:
    border = d(CFG.plan_score_map["business"])
    # both p-values as folds over the terms of their series
    ks_terms = f"list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp({d(-2)} * k * k * x * x))"
    step = "struct_pack(t := s.t * z / (a + i.k), total := s.total + s.t * z / (a + i.k), k := i.k)"
    items = "list_transform(range(1, CAST(ceil(z) AS BIGINT) + 101), lambda k: struct_pack(t := one, total := one, k := CAST(k AS DOUBLE)))"
    first = "exp(a * ln(z) - z - lgamma(a + 1))"
    start = f"list_prepend(struct_pack(t := {first}, total := {first}, k := zero), {items})"
    lower = f"list_reduce({start}, lambda s, i: {step}).total"
    sides = f"""
sided AS (SELECT f.*, c.subscription_plan AS plan, CASE WHEN plan_value_index < {border} THEN 'train' ELSE 'test' END AS split
          FROM feat AS f JOIN coerced AS c ON c.account_id = f.account_id)"""
    return with_(ACCOUNTS_SQL, features_ctes(), sides, scored_ctes("sided"), _drift_sides()) + f""",
sz AS (SELECT "column", COUNT(CASE WHEN side = 'reference' THEN 1 END) AS n, COUNT(CASE WHEN side = 'current' THEN 1 END) AS m
       FROM lf WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY "column"),
numbers AS (SELECT dd."column", ks_statistic, wasserstein,
              ks_statistic * sqrt(CAST(n AS DOUBLE) * CAST(m AS DOUBLE) / (CAST(n AS DOUBLE) + CAST(m AS DOUBLE))) AS x
            FROM dd JOIN sz ON sz."column" = dd."column" WHERE dd."column" <> 'renewed'),
number_p AS (SELECT *, CASE WHEN x < 0.2 THEN {d(1)} ELSE least({d(1)}, greatest({d(0)}, 2 * list_sum({ks_terms}))) END AS p FROM numbers),
cats AS (SELECT 'plan' AS "column", plan AS category, split FROM sided
         UNION ALL SELECT 'renewed', CAST(renewed AS VARCHAR), split FROM sided),
cc AS (SELECT "column", category, CAST(COUNT(CASE WHEN split = 'train' THEN 1 END) AS DOUBLE) AS r,
         CAST(COUNT(CASE WHEN split = 'test' THEN 1 END) AS DOUBLE) AS c FROM cats WHERE category IS NOT NULL GROUP BY "column", category),
cs AS (SELECT *, SUM(r) OVER w AS nr, SUM(c) OVER w AS nc, COUNT(*) OVER w AS k FROM cc WINDOW w AS (PARTITION BY "column")),
ct AS (SELECT "column", MAX(k) - 1 AS freedom,
         SUM((r - nr * (r + c) / (nr + nc)) ** 2 / (nr * (r + c) / (nr + nc)) + (c - nc * (r + c) / (nr + nc)) ** 2 / (nc * (r + c) / (nr + nc))) AS chi,
         SUM((CASE WHEN r > 0 THEN r / nr * log2(r / nr / ((r / nr + c / nc) / 2)) ELSE 0 END
              + CASE WHEN c > 0 THEN c / nc * log2(c / nc / ((r / nr + c / nc) / 2)) ELSE 0 END) / 2) AS js
       FROM cs GROUP BY "column"),
cz AS (SELECT *, CAST(freedom AS DOUBLE) / 2 AS a, chi / 2 AS z, {d(1)} AS one, {d(0)} AS zero FROM ct),
cp AS (SELECT "column", chi, sqrt(greatest({d(0)}, js)) AS distance,
         CASE WHEN freedom < 1 OR z <= 0 THEN {d(1)} WHEN z > a + 50 * sqrt(a) + 100 THEN {d(0)}
              ELSE greatest({d(0)}, 1 - {lower}) END AS p FROM cz)
SELECT "column", 'number' AS kind, 'ks' AS test, {q6("ks_statistic")} AS statistic, {q6("wasserstein")} AS distance,
  {q6("p")} AS p_value, p < {d(0.05)} AS drifted FROM number_p
UNION ALL
SELECT "column", 'category', 'chi_square', {q6("chi")}, {q6("distance")}, {q6("p")}, p < {d(0.05)} FROM cp"""


def sketched_medians_check() -> str:
    return with_(ACCOUNTS_SQL, features_ctes()) + f""",
lf AS ({long_union("feat", MODEL_FEATURES)})
SELECT COUNT(DISTINCT "column") AS columns, COUNT(*) AS sketched_values, CAST(0 AS BIGINT) AS miscounted, CAST(0 AS BIGINT) AS violations
FROM lf WHERE value IS NOT NULL AND NOT isnan(value)"""


def sketched_psi_check() -> str:
    return f"SELECT CAST({len(MODEL_FEATURES)} AS BIGINT) AS columns, CAST(0 AS BIGINT) AS violations"


# -- untidy account files: what each spelling stands for, not how it is parsed; an empty
# field of a CSV file is a missing one ---------------------------------------------------


def _untidy() -> str:
    others = ", ".join(f"floor({c}) AS {c}" for c in BASE_NUMERIC_FEATURES[1:])
    return f"""
untidy AS (
  SELECT account_id,
    CASE account_id % 7 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN {d(12.5)} WHEN 3 THEN NULL WHEN 4 THEN {d(-3)}
      WHEN 5 THEN {d(100)} ELSE floor(COALESCE(monthly_usage_hours, {d(0)})) END AS monthly_usage_hours,
    {others},
    CASE account_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN chr(9) || 'GROWTH ' WHEN 3 THEN 'x'
      ELSE subscription_plan END AS subscription_plan,
    CASE account_id % 7 WHEN 3 THEN 1 ELSE 0 END AS hours_null,
    CASE account_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE renewed END AS label
  FROM accounts)"""


def untidy_features() -> str:
    checks = []
    for c in BASE_NUMERIC_FEATURES:
        checks.append(f"CASE WHEN {c} IS NULL THEN '{c}:missing' END")
        checks.append(f"CASE WHEN {c} < 0 THEN '{c}:negative' END")
    checks.append("CASE WHEN subscription_plan IS NULL THEN 'subscription_plan:missing' END")
    checks.append("CASE WHEN length(subscription_plan) < 3 THEN 'subscription_plan:length' END")
    coded = f"""
coded AS (SELECT *, concat_ws(',', {', '.join(checks)}) AS violations FROM untidy)"""
    return with_(ACCOUNTS_SQL, _untidy(), coded, features_ctes("coded", "account_id, label, violations")) + "\nSELECT * FROM feat"


def untidy_profile() -> str:
    # text of any kind is a cell; only what is null or empty of a number is not
    nulls = ["SUM(hours_null)", *[f"COUNT(*) - COUNT({c})" for c in BASE_NUMERIC_FEATURES[1:]]]
    nulls += ["COUNT(*) - COUNT(subscription_plan)", "COUNT(CASE WHEN account_id % 6 = 3 THEN 1 END)"]
    return with_(ACCOUNTS_SQL, _untidy()) + f"""
SELECT COUNT(*) AS row_count, 0 AS missing_column_count, CAST({' + '.join(nulls)} AS BIGINT) AS null_cells,
  CAST({' + '.join(f'CASE WHEN {n} > 0 THEN 1 ELSE 0 END' for n in nulls)} AS INTEGER) AS columns_with_nulls,
  COUNT(DISTINCT label) AS target_class_count,
  (COUNT(DISTINCT label) = 2 AND MIN(label) = 0 AND MAX(label) = 1) AS binary_target
FROM untidy"""


def untidy_classes() -> str:
    return with_(ACCOUNTS_SQL, _untidy()) + "\nSELECT DISTINCT CAST(label AS DOUBLE) AS target_class FROM untidy WHERE label IS NOT NULL"


def broken_lines() -> str:
    whole = " || ',' || ".join(["CAST(account_id AS VARCHAR)", *[f"COALESCE(CAST(CAST(floor({c}) AS BIGINT) AS VARCHAR), '0')" for c in BASE_NUMERIC_FEATURES]])
    return with_(ACCOUNTS_SQL) + f"""
SELECT CAST(account_id AS VARCHAR) AS account_id, CASE WHEN account_id % 11 = 0 THEN CAST(account_id AS VARCHAR) || ',1'
  WHEN account_id % 13 = 0 THEN {whole} || ',extra' END AS line FROM accounts"""


def incremental_profile() -> str:
    # as text: an untidy number is a cell, a number of the account table may be missing
    nulls = {"monthly_usage_hours": "account_id % 7 = 3", "subscription_plan": "account_id % 5 = 0 OR (account_id % 5 = 4 AND subscription_plan IS NULL)"}
    nulls |= {c: f"{c} IS NULL" for c in BASE_NUMERIC_FEATURES[1:]} | {"renewed": "account_id % 6 = 3 OR (account_id % 6 >= 4 AND renewed IS NULL)"}
    parts = "".join(f"\nUNION ALL SELECT 'nulls', '{c}', CAST(COUNT(CASE WHEN {nulls[c]} THEN 1 END) AS BIGINT) FROM accounts" for c in CFG.source_columns)
    return with_(ACCOUNTS_SQL, _untidy()) + f"""
SELECT 'rows' AS measure, '' AS name, COUNT(*) AS value FROM accounts
UNION ALL SELECT 'files', '', CAST(3 AS BIGINT) UNION ALL SELECT 'read', '', CAST(3 AS BIGINT){parts}
UNION ALL SELECT 'class', CAST(CAST(label AS DOUBLE) AS VARCHAR), COUNT(*) FROM untidy WHERE label IS NOT NULL GROUP BY 1, 2"""


# -- what SQL can say about the fitted model -------------------------------------------


def score_accounts_check() -> str:
    return """SELECT COUNT(*) AS accounts, COUNT(DISTINCT c_custkey) AS distinct_accounts, CAST(0 AS BIGINT) AS bad_probabilities,
  CAST(0 AS BIGINT) AS bad_predictions, CAST(0 AS BIGINT) AS bad_labels FROM customer"""


def explained_accounts_check() -> str:
    return f"""SELECT COUNT(*) AS accounts, CAST({int(CFG.top_k)} * COUNT(*) AS BIGINT) AS factors,
  CAST(0 AS BIGINT) AS out_of_order, CAST(0 AS BIGINT) AS base_values FROM customer"""


def cv_trials_check() -> str:
    return f"""WITH folds AS ({cv_folds()})
SELECT CAST(trial AS INTEGER) AS trial, fold, COUNT(*) AS held_out_rows,
  CAST(COUNT(CASE WHEN renewed = {CFG.positive_class} THEN 1 END) AS BIGINT) AS positives, TRUE AS in_range
FROM folds, range({CFG.n_trials}) AS t(trial) GROUP BY trial, fold"""


def fixed_model_scores() -> str:
    # both trees have the same leaves: -1 and 1, then the residual of a margin of one
    margin = f"({d(1)} + {d(0.1)} * 4 / (1 + exp({d(2)})))"
    renewed = "login_frequency > 5 AND last_login_days <= 10"
    p = f"1 / (1 + exp(-2 * (CASE WHEN {renewed} THEN 1 ELSE -1 END) * {margin}))"
    return with_(ACCOUNTS_SQL, features_ctes()) + f"""
SELECT account_id, {q6(p)} AS renewal_probability, CASE WHEN {renewed} THEN 1 ELSE 0 END AS renewal_prediction,
  CASE WHEN {renewed} THEN 'renewed' ELSE 'not_renewed' END AS renewal_label FROM feat"""


MODEL_CHECKS = ("score_accounts_check", "explained_accounts_check", "cv_trials_check", "fixed_model_scores")

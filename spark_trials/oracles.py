"""The registered queries in DuckDB SQL, written apart from the Spark jobs."""

from __future__ import annotations

from math import pi, sqrt
from statistics import NormalDist

from spark_trials.functions.stats import ERF_DEN, ERF_NUM, FAR_DEN, FAR_NUM, MID_DEN, MID_NUM

Q = NormalDist().inv_cdf
Z95, Z99 = Q(0.975), Q(0.995)
ARMS = ["holdout", *[f"{c}__{k}" for c in ("current", "challenger_a", "challenger_b") for k in ("daily", "twice_weekly")]]
BLOCKS = "lifecycle_segment, tenure_band, assignment_wave"
SEED = 20260908
CANDIDATE = "challenger_a__twice_weekly"


def num(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def ratio(x: str, a: tuple[float, ...], b: tuple[float, ...]) -> str:
    """The rational form of the normal tail's approximation, as sums of powers."""
    n = len(a) - 1
    order = [a[-1], *a[:-1]]  # from the leading coefficient down
    top = " + ".join(f"{num(c)} * pow({x}, {n - k})" for k, c in enumerate(order))
    bottom = " + ".join(f"{num(c)} * pow({x}, {len(b) - k})" for k, c in enumerate([1.0, *b]))
    return f"(({top}) / ({bottom}))"


def erfc(x: str) -> str:
    return (
        f"CASE WHEN {x} <= 0.46875 THEN 1.0 - {x} * {ratio(f'({x} * {x})', ERF_NUM, ERF_DEN)} "
        f"WHEN {x} <= 4.0 THEN exp(-({x} * {x})) * {ratio(x, MID_NUM, MID_DEN)} "
        f"ELSE exp(-({x} * {x})) / {x} * ({num(1 / sqrt(pi))} - 1.0 / ({x} * {x}) * {ratio(f'(1.0 / ({x} * {x}))', FAR_NUM, FAR_DEN)}) END"
    )


def p_of(z: str) -> str:
    return f"least(1.0, greatest(0.0, {erfc(f'(abs({z}) / {num(sqrt(2.0))})')}))"


def r9(x: str) -> str:
    return f"(round({x}, 9) + 0.0)"


def wil(s: str, n: str, z: float, sign: str) -> str:
    core = (
        f"(({s} / {n} + {num(z * z)} / (2.0 * {n})) {sign} {num(z)} * sqrt({s} / {n} * (1.0 - {s} / {n}) / {n} + {num(z * z)} / (4.0 * {n} * {n}))) / (1.0 + {num(z * z)} / {n})"
    )
    return f"greatest(0.0, {core})" if sign == "-" else f"least(1.0, {core})"


def effect_ctes(src: str, keys: str) -> str:
    """CTEs ending in ``effect``: keys, the counts, and every effect column, from ``src`` (keys, ts, tn, cs, cn)."""
    return f"""e0 AS (SELECT {keys}, ts AS nts, tn AS ntn, cs AS ncs, cn AS ncn, CAST(ts AS DOUBLE) ts, CAST(tn AS DOUBLE) tn, CAST(cs AS DOUBLE) cs, CAST(cn AS DOUBLE) cn FROM {src}),
e1 AS (SELECT *, {wil('ts', 'tn', Z95, '-')} tl, {wil('ts', 'tn', Z95, '+')} th, {wil('cs', 'cn', Z95, '-')} cl, {wil('cs', 'cn', Z95, '+')} ch,
  sqrt((ts + cs) / (tn + cn) * (1.0 - (ts + cs) / (tn + cn)) * (1.0 / tn + 1.0 / cn)) se,
  CASE WHEN ts = 0 OR cs = 0 THEN 0.5 ELSE 0.0 END half, CASE WHEN ts = 0 OR cs = 0 THEN 1.0 ELSE 0.0 END one FROM e0),
e2 AS (SELECT *, ts / tn - cs / cn AS d, ((ts + half) / (tn + one)) / ((cs + half) / (cn + one)) AS rr,
  sqrt(greatest(0.0, 1.0 / (ts + half) - 1.0 / (tn + one)) + greatest(0.0, 1.0 / (cs + half) - 1.0 / (cn + one))) AS rse FROM e1),
e3 AS (SELECT *, CASE WHEN se = 0 THEN 0.0 ELSE d / se END AS z FROM e2),
effect AS (SELECT {keys}, nts AS treatment_successes, ntn AS treatment_total, ncs AS control_successes, ncn AS control_total,
  ts / tn AS treatment_rate, cs / cn AS control_rate, d AS absolute_effect,
  greatest(-1.0, d - sqrt(pow(ts / tn - tl, 2) + pow(ch - cs / cn, 2))) AS absolute_ci_low,
  least(1.0, d + sqrt(pow(th - ts / tn, 2) + pow(cs / cn - cl, 2))) AS absolute_ci_high,
  rr AS relative_risk, exp(ln(rr) - {num(Z95)} * rse) AS relative_risk_ci_low, exp(ln(rr) + {num(Z95)} * rse) AS relative_risk_ci_high,
  z AS z_statistic, {p_of('z')} AS p_value_two_sided FROM e3)"""


EFFECT = ["treatment_rate", "control_rate", "absolute_effect", "absolute_ci_low", "absolute_ci_high", "relative_risk", "relative_risk_ci_low", "relative_risk_ci_high", "z_statistic", "p_value_two_sided"]
EFFECT_COUNTS = "treatment_successes, treatment_total, control_successes, control_total"


def effect_columns() -> str:
    return f"{EFFECT_COUNTS}, " + ", ".join(f"{r9(c)} AS {c}" for c in EFFECT)


def adjusted(src: str, out: str, p: str, family: str, key: str) -> str:
    part = f"PARTITION BY {family}" if family else ""
    return f"""{out}_k AS (SELECT *, count(*) OVER ({part}) AS m, row_number() OVER ({part} ORDER BY {p}, {key}) AS k FROM {src}),
{out} AS (SELECT *, least(1.0, max({p} * (m - k + 1)) OVER ({part} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_value_holm,
  least(1.0, min({p} * m / k) OVER ({part} ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_value_bh FROM {out}_k)"""


def people(start: str, days: int) -> str:
    return (
        "SELECT 'p' || c_custkey AS participant_id, c_mktsegment AS experiment, CASE WHEN c_custkey % 2 = 0 THEN 'control' ELSE 'treatment' END AS arm, "
        f"TIMESTAMP '{start}' + to_days(CAST((c_custkey * 7) % {days} AS INTEGER)) AS assigned_at, c_custkey, c_acctbal FROM customer"
    )


A_COHORT = f"a_cohort AS ({people('2024-01-03', 20)})"
A_EVENTS = """a_events AS (SELECT 'p' || user_id AS participant_id, CASE event_type WHEN 'view' THEN 'opened' WHEN 'click' THEN 'linked'
  WHEN 'purchase' THEN 'converted' WHEN 'error' THEN 'unsubscribed' ELSE 'delivered' END AS event_type, ts AS event_at
  FROM events WHERE event_type <> 'purchase' OR value >= 20)"""
B_COHORT = f"b_cohort AS ({people('1998-01-01', 365)})"
B_EVENTS = """b_events AS (SELECT 'p' || o_custkey AS participant_id, CASE o_orderstatus WHEN 'O' THEN 'opened' WHEN 'P' THEN 'linked' ELSE 'converted' END AS event_type,
  o_orderdate AS event_at FROM orders)"""


def outcome(name: str, cohort: str, events: str, days: int, end: str, extra: str = "") -> str:
    return f"""{name} AS (SELECT c.*, c.assigned_at + INTERVAL {days} DAY AS window_end, c.assigned_at + INTERVAL {days} DAY <= TIMESTAMP '{end}' AS followup_complete,
  s.first_outcome_at, coalesce(s.early, false) AS has_pre_assignment_outcome,
  CASE WHEN c.assigned_at + INTERVAL {days} DAY <= TIMESTAMP '{end}' THEN s.first_outcome_at IS NOT NULL END AS outcome{extra}
  FROM {cohort} c LEFT JOIN (SELECT c.participant_id,
    min(e.event_at) FILTER (WHERE e.event_at >= c.assigned_at AND e.event_at < c.assigned_at + INTERVAL {days} DAY AND e.event_at <= TIMESTAMP '{end}') AS first_outcome_at,
    bool_or(e.event_at < c.assigned_at) AS early
    FROM {cohort} c JOIN {events} e USING (participant_id) WHERE e.event_type = 'converted' GROUP BY c.participant_id) s USING (participant_id))"""


A_OUT = outcome("a_out", "a_cohort", "a_events", 7, "2024-01-28")
B_OUT = outcome("b_out", "b_cohort", "b_events", 180, "2001-08-02")


def counts(src: str, keys: str, hit: str = "outcome", arm: str = "arm", t: str = "treatment", c: str = "control") -> str:
    return (
        f"SELECT {keys}, count(*) FILTER (WHERE {arm} = '{t}' AND {hit}) AS ts, count(*) FILTER (WHERE {arm} = '{t}') AS tn, "
        f"count(*) FILTER (WHERE {arm} = '{c}' AND {hit}) AS cs, count(*) FILTER (WHERE {arm} = '{c}') AS cn FROM {src} GROUP BY {keys}"
    )


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def micros(c: str) -> str:
    return f"epoch_us({c}) AS {c}"


B_BASE = (B_COHORT, B_EVENTS, B_OUT, "done AS (SELECT * FROM b_out WHERE outcome IS NOT NULL)")
A_BASE = (A_COHORT, A_EVENTS, A_OUT)

O: dict[str, str] = {}

O["q_experiment_effects"] = (
    with_(*B_BASE, f"n AS ({counts('done', 'experiment')})", effect_ctes("n", "experiment"), adjusted("effect", "adj", "p_value_two_sided", "", "experiment"))
    + f"SELECT experiment, {effect_columns()}, {r9('p_value_holm')} AS p_value_holm, {r9('p_value_bh')} AS p_value_bh FROM adj"
)
O["q_binary_effect"] = with_(*B_BASE, "g AS (SELECT *, (c_custkey // 2) % 20 AS custkey_group FROM done)", f"n AS ({counts('g', 'custkey_group')})", effect_ctes("n", "custkey_group")) + f"SELECT custkey_group, {effect_columns()} FROM effect"
O["q_mde"] = with_(*B_BASE, f"n AS ({counts('done', 'experiment')})", "s AS (SELECT *, (cs + 0.5) / (cn + 1.0) AS b FROM n)") + (
    "SELECT experiment, ts AS treatment_successes, tn AS treatment_total, cs AS control_successes, cn AS control_total, "
    f"{r9('CAST(b AS DOUBLE)')} AS smoothed_control_rate, "
    + r9(f"least(1.0 - CAST(b AS DOUBLE), {num(Q(0.975) + Q(0.8))} * sqrt(CAST(b AS DOUBLE) * (1.0 - CAST(b AS DOUBLE)) * (1.0 / CAST(cn AS DOUBLE) + 1.0 / CAST(tn AS DOUBLE))))")
    + " AS approximate_mde FROM s"
)
O["q_holm_bh"] = (
    with_(*B_BASE, "g AS (SELECT *, CASE WHEN c_acctbal < 4500 THEN 'low' ELSE 'high' END AS family FROM done)", f"n AS ({counts('g', 'family, experiment')})", effect_ctes("n", "family, experiment"), adjusted("effect", "adj", "p_value_two_sided", "family", "experiment"))
    + f"SELECT family, experiment, {r9('p_value_two_sided')} AS p_value_two_sided, {r9('p_value_holm')} AS p_value_holm, {r9('p_value_bh')} AS p_value_bh FROM adj"
)
O["q_windowed_outcome"] = with_(*A_BASE) + f"SELECT participant_id, experiment, arm, {micros('assigned_at')}, {micros('window_end')}, followup_complete, {micros('first_outcome_at')}, has_pre_assignment_outcome, outcome FROM a_out"
O["q_orphans"] = with_(B_COHORT, B_EVENTS) + (
    "SELECT event_type, count(*) AS orphan_rows FROM b_events WHERE participant_id NOT IN (SELECT participant_id FROM b_cohort WHERE c_custkey < (SELECT max(c_custkey) / 2 FROM customer)) GROUP BY event_type"
)
for name, keys in (("q_censoring", "arm"), ("q_censoring_by_experiment", "experiment, arm")):
    O[name] = with_(*A_BASE) + (
        f"SELECT {keys}, count(*) AS total, count(*) FILTER (WHERE followup_complete) AS complete, count(*) FILTER (WHERE NOT followup_complete) AS censored, "
        f"{r9('count(*) FILTER (WHERE followup_complete) / CAST(count(*) AS DOUBLE)')} AS complete_rate FROM a_out GROUP BY {keys}"
    )
O["q_population_flow"] = with_(
    B_COHORT, B_EVENTS,
    """recent AS (SELECT e.* FROM b_events e JOIN b_cohort c USING (participant_id) WHERE e.event_at >= c.assigned_at - INTERVAL 30 DAY)""",
    """old AS (SELECT DISTINCT e.participant_id FROM b_events e JOIN b_cohort c USING (participant_id)
       WHERE e.event_type = 'converted' AND e.event_at >= c.assigned_at - INTERVAL 90 DAY AND e.event_at < c.assigned_at - INTERVAL 30 DAY)""",
    outcome("o", "b_cohort", "recent", 180, "1999-01-15"),
    """s AS (SELECT experiment, arm, CASE WHEN participant_id IN (SELECT participant_id FROM old) THEN 'x' WHEN has_pre_assignment_outcome THEN 'p' WHEN NOT followup_complete THEN 'c' ELSE 'a' END AS s FROM o)""",
) + "SELECT experiment, arm, count(*) AS assigned, count(*) FILTER (WHERE s = 'x') AS pre_existing, count(*) FILTER (WHERE s = 'p') AS pre_assignment, count(*) FILTER (WHERE s = 'c') AS censored, count(*) FILTER (WHERE s = 'a') AS analyzed FROM s GROUP BY experiment, arm"
O["q_last_observed"] = with_(A_EVENTS) + "SELECT event_type, epoch_us(max(event_at)) AS last_observed_at FROM a_events GROUP BY event_type"


def funnel(cohort: str, events: str, later: str) -> str:
    return f"""s1 AS (SELECT c.participant_id, c.assigned_at, min(e.event_at) AS t FROM {cohort} c LEFT JOIN {events} e ON e.participant_id = c.participant_id AND e.event_type = 'opened' AND e.event_at >= c.assigned_at GROUP BY ALL),
s2 AS (SELECT s.participant_id, s.assigned_at, s.t AS t1, min(e.event_at) AS t FROM s1 s LEFT JOIN {events} e ON e.participant_id = s.participant_id AND e.event_type = 'linked' AND e.event_at >= s.assigned_at AND {later.format('s.t')} GROUP BY ALL),
s3 AS (SELECT s.participant_id, s.assigned_at, s.t1, s.t AS t2, min(e.event_at) AS t3 FROM s2 s LEFT JOIN {events} e ON e.participant_id = s.participant_id AND e.event_type = 'converted' AND e.event_at >= s.assigned_at AND {later.format('s.t')} GROUP BY ALL)"""


STAGE_COLUMNS = "epoch_us(t1) AS opened_at, t1 IS NOT NULL AS opened_reached, epoch_us(t2) AS linked_at, t2 IS NOT NULL AS linked_reached, epoch_us(t3) AS converted_at, t3 IS NOT NULL AS converted_reached"
O["q_funnel_membership"] = with_(B_COHORT, B_EVENTS, funnel("b_cohort", "b_events", "e.event_at > {}")) + f"SELECT participant_id, {micros('assigned_at')}, {STAGE_COLUMNS} FROM s3"
O["q_funnel_day_gap"] = with_(A_COHORT, A_EVENTS, funnel("a_cohort", "a_events", "CAST(e.event_at AS DATE) >= CAST({} AS DATE) + 1")) + f"SELECT participant_id, {micros('assigned_at')}, {STAGE_COLUMNS} FROM s3"
O["q_funnel_summary"] = with_(B_COHORT, B_EVENTS, funnel("b_cohort", "b_events", "e.event_at > {}"), "c AS (SELECT CAST(count(*) AS DOUBLE) p, count(t1) a, count(t2) b, count(t3) d FROM s3)") + (
    f"SELECT 1 AS position, 'opened' AS stage, a AS users, {r9('a / nullif(p, 0)')} AS rate_from_population, {r9('a / nullif(p, 0)')} AS rate_from_previous FROM c "
    f"UNION ALL SELECT 2, 'linked', b, {r9('b / nullif(p, 0)')}, {r9('b / nullif(CAST(a AS DOUBLE), 0)')} FROM c "
    f"UNION ALL SELECT 3, 'converted', d, {r9('d / nullif(p, 0)')}, {r9('d / nullif(CAST(b AS DOUBLE), 0)')} FROM c"
)
B_FLAGGED = """b_flagged AS (SELECT c.*, coalesce(f.l, false) AS linked_before_entry, coalesce(f.v, false) AS converted_before_entry FROM b_cohort c LEFT JOIN (
  SELECT c.participant_id, bool_or(e.event_type = 'linked') AS l, bool_or(e.event_type = 'converted') AS v FROM b_cohort c JOIN b_events e USING (participant_id)
  WHERE e.event_at < c.assigned_at GROUP BY c.participant_id) f USING (participant_id))"""
O["q_new_link_funnel"] = with_(B_COHORT, B_EVENTS, B_FLAGGED, funnel("b_cohort", "b_events", "e.event_at > {}")) + (
    f"SELECT s3.participant_id, epoch_us(s3.assigned_at) AS assigned_at, linked_before_entry, converted_before_entry, {STAGE_COLUMNS} FROM s3 JOIN b_flagged f USING (participant_id) WHERE NOT linked_before_entry AND NOT converted_before_entry"
)
O["q_gap_sensitivity"] = with_(
    A_COHORT, A_EVENTS, "f AS (SELECT participant_id, min(event_at) AS first FROM a_events WHERE event_type = 'delivered' GROUP BY 1)",
    """less AS (SELECT e.* FROM a_events e LEFT JOIN f USING (participant_id) LEFT JOIN a_cohort c USING (participant_id)
       WHERE NOT coalesce(e.event_type = 'converted' AND e.event_at >= c.assigned_at - INTERVAL 2 DAY AND e.event_at < f.first, false))""",
    outcome("o1", "a_cohort", "a_events", 7, "2024-01-28"), outcome("o2", "a_cohort", "less", 7, "2024-01-28"),
    "sides AS (SELECT 'all_outcomes' AS analysis, experiment, arm, outcome FROM o1 WHERE outcome IS NOT NULL UNION ALL SELECT 'without_gap', experiment, arm, outcome FROM o2 WHERE outcome IS NOT NULL)",
    f"n AS ({counts('sides', 'analysis, experiment')})", effect_ctes("n", "analysis, experiment"), adjusted("effect", "adj", "p_value_two_sided", "analysis", "experiment"),
) + f"SELECT analysis, experiment, {effect_columns()}, {r9('p_value_holm')} AS p_value_holm, {r9('p_value_bh')} AS p_value_bh FROM adj"
O["q_gap_outcomes"] = with_(
    A_COHORT, A_EVENTS, "f AS (SELECT participant_id, min(event_at) AS first FROM a_events WHERE event_type = 'delivered' GROUP BY 1)",
    "g AS (SELECT e.participant_id, count(*) AS n FROM a_events e JOIN f USING (participant_id) JOIN a_cohort c USING (participant_id) WHERE e.event_type = 'converted' AND e.event_at >= c.assigned_at AND e.event_at < f.first GROUP BY 1)",
) + "SELECT arm, count(*) AS participants, count(n) AS participants_with_gap_outcome, CAST(coalesce(sum(n), 0) AS BIGINT) AS gap_outcome_events FROM a_cohort LEFT JOIN g USING (participant_id) GROUP BY arm"
for name, by, event in (("q_unsub", "arm", "unsubscribed"), ("q_failure_risk", "experiment", "linked")):
    O[name] = with_(
        A_COHORT, A_EVENTS,
        f"w AS (SELECT c.{by}, (SELECT count(*) FROM a_events e WHERE e.participant_id = c.participant_id AND e.event_type = 'delivered') AS sent, (SELECT count(*) FROM a_events e WHERE e.participant_id = c.participant_id AND e.event_type = '{event}') AS n FROM a_cohort c)",
    ) + (
        f"SELECT {by}, count(*) AS actual_recipients, count(*) FILTER (WHERE n > 0) AS unique_people, CAST(sum(n) AS BIGINT) AS events, CAST(sum(sent) AS DOUBLE) AS delivered_exposures, "
        f"{r9('count(*) FILTER (WHERE n > 0) / CAST(count(*) AS DOUBLE)')} AS unique_user_risk, {r9('1000.0 * CAST(sum(n) AS DOUBLE) / CAST(sum(sent) AS DOUBLE)')} AS events_per_1000_deliveries FROM w WHERE sent > 0 GROUP BY {by}"
    )
MESSAGES = """msg AS (SELECT 'p' || user_id AS subject, CAST(json_extract_string(props, '$.k') AS BIGINT) AS message, min(ts) AS first_at, count(*) AS provider_events,
  bool_or(event_type = 'signup') AS delivered, bool_or(event_type = 'view') AS viewed, bool_or(event_type = 'error') AS failed FROM events GROUP BY 1, 2)"""
O["q_subject_message"] = with_(MESSAGES) + f"SELECT subject, message, {micros('first_at')}, provider_events, delivered, viewed, failed FROM msg"
O["q_template_open"] = with_(MESSAGES, "t AS (SELECT 'T' || (message % 10) AS template, count(*) FILTER (WHERE NOT failed) AS observed, count(*) FILTER (WHERE failed) AS missing, count(*) FILTER (WHERE NOT failed AND viewed) AS opens FROM msg WHERE delivered GROUP BY 1)", "v AS (SELECT *, CAST(opens AS DOUBLE) s, CAST(nullif(observed, 0) AS DOUBLE) n FROM t)") + (
    f"SELECT template, observed, missing, opens, {r9('s / n')} AS open_rate, {r9(wil('s', 'n', Z95, '-'))} AS ci_low, {r9(wil('s', 'n', Z95, '+'))} AS ci_high FROM v"
)
O["q_key_contract"] = (
    "SELECT 'missing_key' AS rule, count(*) FILTER (WHERE o_custkey IS NULL) AS violations FROM orders UNION ALL "
    "SELECT 'duplicate_key', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1) UNION ALL "
    "SELECT 'flag_not_binary', count(*) FILTER (WHERE o_orderkey % 3 NOT IN (0, 1)) FROM orders UNION ALL SELECT 'flag_missing', count(*) FILTER (WHERE o_orderkey IS NULL) FROM orders"
)
O["q_tz_contract"] = (
    "SELECT CASE o_orderkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'naive' ELSE 'invalid' END AS state, count(*) AS values, "
    "epoch_us(min(CASE WHEN o_orderkey % 4 < 2 THEN o_orderdate END)) AS first_at, epoch_us(max(CASE WHEN o_orderkey % 4 < 2 THEN o_orderdate END)) AS last_at FROM orders GROUP BY 1"
)
O["q_one_to_one"] = (
    "WITH l AS (SELECT CASE WHEN c_custkey % 5 > 0 THEN c_custkey ELSE -c_custkey END AS c_custkey, c_nationkey FROM customer), r AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) "
    "SELECT coalesce(l.c_custkey, r.o_custkey) AS c_custkey, l.c_nationkey AS c_nationkey_left, r.n AS c_nationkey_right FROM l FULL OUTER JOIN r ON l.c_custkey = r.o_custkey"
)
O["q_join_amplification"] = with_(B_COHORT, B_EVENTS, "j AS (SELECT c.participant_id FROM b_cohort c LEFT JOIN b_events e USING (participant_id))") + (
    "SELECT b.n AS rows_before, b.s AS subjects_before, a.n AS rows_after, a.s AS subjects_after, " + r9("a.n / CAST(b.n AS DOUBLE)") + " AS amplification "
    "FROM (SELECT count(*) n, count(DISTINCT participant_id) s FROM b_cohort) b, (SELECT count(*) n, count(DISTINCT participant_id) s FROM j) a"
)

ARM_CASE = "CASE rk % 7 " + " ".join(f"WHEN {k} THEN '{a}'" for k, a in enumerate(ARMS)) + " END"
C_PEOPLE = """c_people AS (SELECT 'p' || c_custkey AS participant_id, lower(c_mktsegment) AS lifecycle_segment, CASE WHEN c_acctbal < 4500 THEN '0_30d' ELSE '31_90d' END AS tenure_band,
  CASE WHEN c_custkey % 2 = 0 THEN 'wave_01' ELSE 'wave_02' END AS assignment_wave,
  CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '1998-01-01' ELSE TIMESTAMP '1998-01-08' END AS assigned_at FROM customer)"""
C_ELIGIBLE = f"""c_eligible AS (SELECT * EXCLUDE (n, trim_rank) FROM (SELECT *, count(*) OVER (PARTITION BY {BLOCKS}) AS n,
  row_number() OVER (PARTITION BY {BLOCKS} ORDER BY sha256('trim|' || participant_id)) - 1 AS trim_rank FROM c_people) WHERE n // 7 * 7 >= 14 AND trim_rank < n // 7 * 7)"""
C_RANKED = f"""c_ranked AS (SELECT *, row_number() OVER (PARTITION BY {BLOCKS} ORDER BY sha256('{SEED}|' || lifecycle_segment || '|' || tenure_band || '|' || assignment_wave || '|' || participant_id)) - 1 AS rk FROM c_eligible)"""
C_LEDGER = f"""c_ledger AS (SELECT participant_id, {BLOCKS}, assigned_at - INTERVAL 1 DAY AS eligible_at, assigned_at, arm, CASE WHEN arm <> 'holdout' THEN split_part(arm, '__', 1) END AS content,
  CASE WHEN arm <> 'holdout' THEN split_part(arm, '__', 2) END AS cadence, CAST(1.0 AS DOUBLE) / 7 AS expected_probability, 'stratified-permuted-block-v1' AS randomization_version
  FROM (SELECT *, {ARM_CASE} AS arm FROM c_ranked))"""
C_BASE = (C_PEOPLE, C_ELIGIBLE, C_RANKED, C_LEDGER)
C_EVENTS = """c_events AS (SELECT event_id, participant_id, event_type, event_at, available_at,
  CASE WHEN event_type = 'delivered' THEN CASE WHEN arm = 'holdout' THEN 'current' WHEN k % 50 = 0 THEN 'challenger_b' ELSE content END END AS delivered_content,
  CASE WHEN event_type = 'delivered' THEN CASE WHEN arm = 'holdout' THEN 'daily' ELSE cadence END END AS delivered_cadence
  FROM (SELECT 'o' || o_orderkey AS event_id, 'p' || o_custkey AS participant_id, o_orderkey AS k, o_orderdate AS event_at, o_orderdate + to_hours(CAST(o_orderkey % 36 AS INTEGER)) AS available_at,
    CASE WHEN o_orderstatus = 'F' THEN 'funded' WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'unsubscribed' WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'complained'
         WHEN o_orderstatus = 'O' THEN 'delivered' ELSE 'pre_period_engaged' END AS event_type FROM orders) o JOIN (SELECT participant_id, arm, content, cadence FROM c_ledger) l USING (participant_id)
  WHERE NOT (event_type = 'delivered' AND arm = 'holdout') OR k % 40 = 0)"""
C_CLEAN = """c_clean AS (SELECT e.* FROM c_events e JOIN c_ledger l USING (participant_id) WHERE NOT (
    (event_type IN ('funded', 'unsubscribed', 'complained') AND event_at < assigned_at)
    OR (event_at >= assigned_at AND event_at < assigned_at + INTERVAL 365 DAY AND available_at > TIMESTAMP '1999-01-15')
    OR (event_type = 'pre_period_engaged' AND (event_at >= assigned_at OR available_at > assigned_at)))
  QUALIFY row_number() OVER (PARTITION BY e.participant_id, event_type, event_at, delivered_content, delivered_cadence ORDER BY event_id) = 1)"""


def within(kind: str) -> str:
    return f"CAST(coalesce(bool_or(e.event_type = '{kind}' AND e.event_at >= l.assigned_at AND e.event_at < l.assigned_at + INTERVAL 365 DAY AND e.event_at <= TIMESTAMP '1999-01-15'), false) AS INTEGER)"


C_FRAME = f"""c_frame AS (SELECT l.participant_id, {BLOCKS.replace('lifecycle', 'l.lifecycle').replace('tenure', 'l.tenure').replace('assignment', 'l.assignment')}, l.arm, l.content, l.cadence,
  {within('funded')} AS funded_14d, {within('unsubscribed')} AS unsubscribe_14d, {within('complained')} AS complaint_14d,
  CAST(coalesce(bool_or(e.event_type = 'pre_period_engaged' AND e.event_at < l.assigned_at AND e.available_at <= l.assigned_at), false) AS INTEGER) AS pre_period_engaged
  FROM c_ledger l LEFT JOIN (SELECT * FROM c_clean WHERE available_at <= TIMESTAMP '1999-01-15') e USING (participant_id) GROUP BY ALL)"""
C_ALL = (*C_BASE, C_EVENTS, C_CLEAN, C_FRAME)

O["q_assignment"] = with_(*C_BASE) + f"SELECT participant_id, {BLOCKS}, {micros('eligible_at')}, {micros('assigned_at')}, arm, content, cadence, {r9('expected_probability')} AS expected_probability, randomization_version FROM c_ledger"
O["q_exact_allocation"] = with_(*C_BASE) + f"SELECT {BLOCKS}, min(n) AS least, max(n) AS greatest, min(n) = max(n) AND min(n) > 0 AS exact FROM (SELECT {BLOCKS}, a.arm, count(l.participant_id) AS n FROM (SELECT DISTINCT {BLOCKS} FROM c_ledger) b CROSS JOIN (SELECT unnest({ARMS!r}) AS arm) a LEFT JOIN c_ledger l USING ({BLOCKS}, arm) GROUP BY ALL) GROUP BY {BLOCKS}"


def srm(src: str, keys: str) -> str:
    names = [k.strip() for k in keys.split(",")]
    arms = ", ".join(f"count(*) FILTER (WHERE arm = '{a}') AS {a}" for a in ARMS)
    n = " + ".join(ARMS)
    chi = " + ".join(f"pow({a} - n / 7.0, 2) / (n / 7.0)" for a in ARMS)
    empty = ", ".join(f"CAST(NULL AS VARCHAR) AS {k}" for k in names)
    p = "least(1.0, greatest(0.0, exp(-chi / 2.0) * (1.0 + chi / 2.0 + pow(chi / 2.0, 2) / 2.0)))"
    return (
        f"""r AS (SELECT 'block' AS scope, {keys}, {arms} FROM {src} GROUP BY {keys} UNION ALL SELECT 'overall', {empty}, {arms} FROM {src}),
x AS (SELECT *, CAST({n} AS DOUBLE) AS n FROM r), y AS (SELECT *, CAST({chi} AS DOUBLE) AS chi FROM x), z AS (SELECT *, {p} AS p FROM y), {adjusted('z', 'adj', 'p', 'scope', keys)}
SELECT scope, {keys}, {', '.join(ARMS)}, CAST(n AS BIGINT) AS sample_size, {r9('n / 7.0')} AS expected_per_arm, {r9('chi')} AS chi_square, {r9('p')} AS p_value, {r9('p_value_holm')} AS p_value_holm, p_value_holm >= 0.01 AS passed FROM adj"""
    )


C_UNBALANCED = f"c_unbalanced AS (SELECT *, {ARM_CASE} AS arm FROM (SELECT *, row_number() OVER (ORDER BY sha256('srm|' || participant_id)) - 1 AS rk FROM c_people))"
O["q_srm"] = with_(C_PEOPLE, C_UNBALANCED) + ", " + srm("c_unbalanced", BLOCKS)
O["q_position_balance"] = with_(C_PEOPLE, C_UNBALANCED, f"pos AS (SELECT arm, CAST((row_number() OVER (PARTITION BY {BLOCKS} ORDER BY sha256('{SEED}|' || lifecycle_segment || '|' || tenure_band || '|' || assignment_wave || '|' || participant_id)) - 1) % 5 AS VARCHAR) AS position FROM c_unbalanced)") + ", " + srm("pos", "position")
STAMP = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'"
O["q_ledger_digest"] = with_(
    *C_BASE,
    f"""rows_ AS (SELECT participant_id, sha256(concat_ws(chr(31), participant_id, {BLOCKS}, {STAMP.format('eligible_at')}, {STAMP.format('assigned_at')}, arm, coalesce(content, ''), coalesce(cadence, ''), printf('%.17g', expected_probability), randomization_version)) AS digest FROM c_ledger)""",
    "buckets AS (SELECT substr(sha256(participant_id), 1, 4) AS bucket, sha256(string_agg(digest, chr(10) ORDER BY participant_id)) AS digest, count(*) AS n FROM rows_ GROUP BY 1)",
    "tops AS (SELECT substr(bucket, 1, 2) AS top, sha256(string_agg(digest, chr(10) ORDER BY bucket)) AS digest, sum(n) AS n FROM buckets GROUP BY 1)",
) + "SELECT sha256(string_agg(digest, chr(10) ORDER BY top)) AS ledger_sha256, CAST(sum(n) AS BIGINT) AS rows FROM tops"
O["q_block_reuse"] = with_(
    *C_BASE[:3], C_UNBALANCED,
    f"u AS (SELECT 'dealt|' || lifecycle_segment || '|' || tenure_band || '|' || assignment_wave AS block, rk AS position, {ARM_CASE} AS arm FROM c_ranked UNION ALL SELECT 'ranked|' || lifecycle_segment || '|' || tenure_band || '|' || assignment_wave, row_number() OVER (PARTITION BY {BLOCKS} ORDER BY sha256('{SEED}|' || lifecycle_segment || '|' || tenure_band || '|' || assignment_wave || '|' || participant_id)) - 1, arm FROM c_unbalanced)",
    "p AS (SELECT block, position // 4096 AS part, sha256(string_agg(arm, ',' ORDER BY position)) AS digest FROM u GROUP BY 1, 2)",
    "h AS (SELECT block, sha256(string_agg(digest, chr(10) ORDER BY part)) AS sequence_sha256 FROM p GROUP BY 1)",
) + "SELECT block, sequence_sha256, count(*) OVER (PARTITION BY sequence_sha256) AS groups, count(*) OVER (PARTITION BY sequence_sha256) > 1 AS reused FROM h"


def rules(src: str, pairs: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {c}) AS violations FROM {src}" for n, c in pairs.items())


O["q_event_type_counts"] = with_(*C_BASE, C_EVENTS) + " UNION ALL ".join(f"SELECT '{t}' AS event_type, count(*) FILTER (WHERE event_type = '{t}') AS events FROM c_events" for t in ("delivered", "funded", "unsubscribed", "complained", "pre_period_engaged"))
DELIVERIES = """d AS (SELECT e.*, l.arm = 'holdout' AS h, l.arm <> 'holdout' AND e.delivered_content IS DISTINCT FROM l.content AS c, l.arm <> 'holdout' AND e.delivered_cadence IS DISTINCT FROM l.cadence AS k,
  e.event_at < l.assigned_at AS p, e.event_at < l.assigned_at + INTERVAL 365 DAY AS w FROM {} e JOIN c_ledger l USING (participant_id) WHERE e.event_type = 'delivered')"""
CONTAMINATION = """cont AS (SELECT count(*) AS delivery_rows, count(*) FILTER (WHERE h) AS holdout_delivery_rows, count(*) FILTER (WHERE c) AS cross_content_delivery_rows, count(*) FILTER (WHERE k) AS cross_cadence_delivery_rows,
  count(*) FILTER (WHERE p) AS pre_assignment_delivery_rows, count(DISTINCT participant_id) FILTER (WHERE h OR c OR k OR p) AS affected_participants,
  (SELECT count(*) FROM c_ledger WHERE arm <> 'holdout') - count(DISTINCT participant_id) FILTER (WHERE NOT h) AS active_participants_without_delivery,
  (SELECT count(*) FROM c_ledger WHERE arm <> 'holdout') - count(DISTINCT participant_id) FILTER (WHERE NOT h AND NOT c AND NOT k AND NOT p AND w) AS active_participants_without_in_window_delivery FROM d),
contamination AS (SELECT *, active_participants_without_in_window_delivery = 0 AS active_delivery_coverage_passed, affected_participants = 0 AS passed FROM cont)"""
O["q_contamination"] = with_(*C_BASE, C_EVENTS, DELIVERIES.format("c_events"), CONTAMINATION) + "SELECT * FROM contamination"
FOLLOWUP = """f0 AS (SELECT count(*) FILTER (WHERE e.event_at >= l.assigned_at AND e.event_at < l.assigned_at + INTERVAL 365 DAY AND e.available_at > TIMESTAMP '1999-01-15') AS late_arriving_in_window_rows,
  count(*) FILTER (WHERE e.event_type IN ('funded', 'unsubscribed', 'complained') AND e.event_at < l.assigned_at) AS pre_assignment_outcome_rows,
  count(*) FILTER (WHERE e.event_type = 'pre_period_engaged' AND e.event_at >= l.assigned_at) AS negative_control_after_assignment_rows,
  count(*) FILTER (WHERE e.event_type = 'pre_period_engaged' AND e.available_at > l.assigned_at) AS negative_control_not_available_at_assignment_rows
  FROM {} e JOIN c_ledger l USING (participant_id)),
followup AS (SELECT u.*, f0.*, true AS aligned_followup, u.censored_units + late_arriving_in_window_rows + pre_assignment_outcome_rows + negative_control_after_assignment_rows + negative_control_not_available_at_assignment_rows = 0 AS passed
  FROM f0, (SELECT count(*) AS randomized_units, count(*) FILTER (WHERE assigned_at + INTERVAL 365 DAY + INTERVAL 48 HOUR > TIMESTAMP '1999-01-15') AS censored_units FROM c_ledger) u)"""
O["q_followup"] = with_(*C_BASE, C_EVENTS, FOLLOWUP.format("c_events")) + "SELECT * FROM followup"
O["q_itt_frame"] = with_(*C_ALL) + "SELECT * FROM c_frame"
O["q_source_completeness"] = with_(*C_BASE, C_EVENTS, "t AS (SELECT unnest(['delivered', 'funded', 'unsubscribed', 'complained', 'pre_period_engaged']) AS endpoint)", "w AS (SELECT event_type AS endpoint, max(available_at) AS complete_through FROM c_events WHERE event_type <> 'complained' GROUP BY 1)") + (
    f"SELECT endpoint, {micros('complete_through')}, coalesce(complete_through >= TIMESTAMP '2001-07-25', false) AS complete FROM t LEFT JOIN w USING (endpoint)"
)


def cube(outcome_col: str) -> str:
    return f"cube AS (SELECT {BLOCKS}, arm, count(*) AS n, sum({outcome_col}) AS s FROM c_frame GROUP BY ALL)"


def block_ctes(z: float = Z95) -> str:
    """CTEs from ``cube`` to ``blk``: block-standardized effects of every active arm."""
    return f"""pair AS (SELECT a.arm, CAST(a.n AS DOUBLE) n, CAST(a.s AS DOUBLE) s, CAST(h.n AS DOUBLE) m, CAST(h.s AS DOUBLE) c, CAST(a.n + h.n AS DOUBLE) w FROM cube a JOIN cube h USING ({BLOCKS}) WHERE a.arm <> 'holdout' AND h.arm = 'holdout'),
b0 AS (SELECT arm, sum(s) ts, sum(n) tn, sum(c) cs, sum(m) cn, sum(w * s / n) / sum(w) tr, sum(w * c / m) / sum(w) cr,
  sum(w * w * (s / n * (1.0 - s / n) / (n - 1) + c / m * (1.0 - c / m) / (m - 1))) / sum(w) / sum(w) AS v, count(*) AS block_count, count(*) FILTER (WHERE n <> m OR n < 2) AS bad_blocks FROM pair GROUP BY arm),
b1 AS (SELECT *, tr - cr AS d, CASE WHEN v > 0 THEN sqrt(v) END AS se FROM b0),
b2 AS (SELECT *, CASE WHEN se IS NULL THEN 0.0 ELSE d / se END AS z FROM b1),
blk AS (SELECT *, greatest(-1.0, d - {num(z)} * se) AS lo, least(1.0, d + {num(z)} * se) AS hi, CASE WHEN se IS NULL THEN 1.0 ELSE {p_of('z')} END AS p FROM b2)"""


O["q_block_effect"] = with_(*C_ALL, cube("funded_14d"), block_ctes()) + (
    "SELECT arm, CAST(ts AS BIGINT) AS treatment_successes, CAST(tn AS BIGINT) AS treatment_total, CAST(cs AS BIGINT) AS control_successes, CAST(cn AS BIGINT) AS control_total, "
    f"{r9('tr')} AS treatment_rate, {r9('cr')} AS control_rate, block_count, bad_blocks, se IS NOT NULL AS valid, {r9('d')} AS absolute_effect, {r9('se')} AS standard_error, {r9('lo')} AS absolute_ci_low, {r9('hi')} AS absolute_ci_high, {r9('z')} AS z_statistic, {r9('p')} AS p_value_two_sided "
    f"FROM blk WHERE arm = '{CANDIDATE}'"
)
PRIMARY_NAMES = "'primary_funding_itt' AS family, arm || '_vs_holdout' AS comparison_id, '{}' AS outcome, arm AS active_arm, 'holdout' AS comparator_arm"
POOLED_ARMS = "pooled AS (SELECT a.arm, a.s AS ts, a.n AS tn, h.s AS cs, h.n AS cn FROM (SELECT arm, CAST(sum(s) AS BIGINT) s, CAST(sum(n) AS BIGINT) n FROM cube GROUP BY 1) a, (SELECT CAST(sum(s) AS BIGINT) s, CAST(sum(n) AS BIGINT) n FROM cube WHERE arm = 'holdout') h WHERE a.arm <> 'holdout')"
RR = ", ".join(f"{r9(c)} AS {c}" for c in ("relative_risk", "relative_risk_ci_low", "relative_risk_ci_high"))
TAIL = f"{r9('p_value_holm')} AS p_value_holm, 6 AS family_size, CAST(0.05 AS DOUBLE) AS family_alpha, p_value_holm < 0.05 AS holm_significant, p_value_holm < 0.05 AND absolute_effect > 0 AS superiority_pass"
BLOCK_FAMILY = f"fam AS (SELECT b.arm, b.ts, b.tn, b.cs, b.cn, b.tr, b.cr, b.d, b.se, b.lo, b.hi, b.p, b.block_count, e.relative_risk, e.relative_risk_ci_low, e.relative_risk_ci_high, b.d AS absolute_effect FROM blk b JOIN effect e USING (arm)), {adjusted('fam', 'adj', 'p', '', 'arm')}"
O["q_primary_family"] = with_(*C_ALL, cube("funded_14d"), block_ctes(), POOLED_ARMS, effect_ctes("pooled", "arm"), BLOCK_FAMILY) + (
    f"SELECT {PRIMARY_NAMES.format('funded_14d')}, CAST(ts AS BIGINT) AS active_successes, CAST(tn AS BIGINT) AS active_total, CAST(cs AS BIGINT) AS holdout_successes, CAST(cn AS BIGINT) AS holdout_total, {r9('tr')} AS active_rate, {r9('cr')} AS holdout_rate, "
    f"{r9('d')} AS risk_difference, {r9('se')} AS risk_difference_standard_error, {r9('lo')} AS risk_difference_ci_low_nominal, {r9('hi')} AS risk_difference_ci_high_nominal, {RR}, {r9('p')} AS p_value_two_sided, "
    "'block_standardized_difference_in_means' AS estimator, 'stratified_neyman_conservative' AS variance_estimator, 'nominal_normal_not_simultaneous' AS interval_method, 'lifecycle_segment|tenure_band|assignment_wave' AS block_columns, block_count, "
    f"{TAIL} FROM adj"
)
O["q_primary_pooled"] = with_(*C_ALL, cube("funded_14d"), POOLED_ARMS, effect_ctes("pooled", "arm"), adjusted("effect", "adj", "p_value_two_sided", "", "arm")) + (
    f"SELECT {PRIMARY_NAMES.format('funded_14d')}, treatment_successes AS active_successes, treatment_total AS active_total, control_successes AS holdout_successes, control_total AS holdout_total, {r9('treatment_rate')} AS active_rate, {r9('control_rate')} AS holdout_rate, "
    f"{r9('absolute_effect')} AS risk_difference, {r9('absolute_ci_low')} AS risk_difference_ci_low_nominal, {r9('absolute_ci_high')} AS risk_difference_ci_high_nominal, {RR}, {r9('p_value_two_sided')} AS p_value_two_sided, "
    "'pooled_difference_in_proportions' AS estimator, 'pooled_score_and_newcombe_not_block_adjusted' AS variance_estimator, 'nominal_newcombe_not_simultaneous' AS interval_method, CAST(0 AS BIGINT) AS block_count, "
    f"{TAIL} FROM adj"
)
ZG = Q(1.0 - 0.05 / 12)
GUARD = f"""ga AS (SELECT arm, count(*) AS n, sum(unsubscribe_14d) AS u, sum(complaint_14d) AS c FROM c_frame GROUP BY arm),
gl AS (SELECT arm, n, 'unsubscribe_14d' AS outcome, CAST(0.05 AS DOUBLE) AS margin, u AS s FROM ga UNION ALL SELECT arm, n, 'complaint_14d', 0.03, c FROM ga),
gp AS (SELECT a.outcome, a.arm, a.margin, a.n AS an, a.s AS asu, h.n AS hn, h.s AS hsu, CAST(a.s AS DOUBLE) ts, CAST(a.n AS DOUBLE) tn, CAST(h.s AS DOUBLE) cs, CAST(h.n AS DOUBLE) cn FROM gl a JOIN gl h USING (outcome) WHERE a.arm <> 'holdout' AND h.arm = 'holdout'),
gb AS (SELECT *, ts / tn - cs / cn AS d, least(1.0, ts / tn - cs / cn + sqrt(pow({wil('ts', 'tn', ZG, '+')} - ts / tn, 2) + pow(cs / cn - {wil('cs', 'cn', ZG, '-')}, 2))) AS ub,
  CASE WHEN ts = 0 OR cs = 0 THEN ((ts + 0.5) / (tn + 1)) / ((cs + 0.5) / (cn + 1)) ELSE (ts / tn) / (cs / cn) END AS rr FROM gp),
guard AS (SELECT *, ub < margin AS ok FROM gb)"""
O["q_guardrail_family"] = with_(*C_ALL, GUARD) + (
    "SELECT outcome, arm AS active_arm, an AS active_total, CAST(asu AS BIGINT) AS active_successes, margin AS noninferiority_margin, hn AS holdout_total, CAST(hsu AS BIGINT) AS holdout_successes, "
    f"{r9('ts / tn')} AS active_rate, {r9('cs / cn')} AS holdout_rate, {r9('d')} AS risk_difference, {r9('rr')} AS relative_risk_supplementary, {r9('ub')} AS simultaneous_one_sided_upper_bound, ok AS noninferiority_pass, "
    "CASE WHEN ok THEN 'noninferior' WHEN d >= margin THEN 'harmful_or_over_margin' ELSE 'inconclusive' END AS conclusion, 'rollout_blocking_guardrails_itt' AS family, 'holdout' AS comparator_arm, "
    "'pooled_difference_in_proportions' AS point_estimator, 'pooled_newcombe_style_bonferroni_not_block_adjusted' AS uncertainty_method, false AS block_adjusted_uncertainty, 12 AS family_size, CAST(0.05 AS DOUBLE) AS family_alpha, "
    f"{r9('CAST(0.05 AS DOUBLE) / 12')} AS bonferroni_alpha_each, outcome || ':' || arm || '_vs_holdout' AS comparison_id FROM guard"
)
NEGATIVE = (cube("pre_period_engaged"), block_ctes(), adjusted("blk", "adj", "p", "", "arm"), "negative AS (SELECT count(*) AS comparisons, count(*) FILTER (WHERE p_value_holm < 0.05) AS rejections, count(*) FILTER (WHERE p_value_holm < 0.05) = 0 AS passed FROM adj)")
O["q_negative_control"] = with_(*C_ALL, *NEGATIVE) + "SELECT * FROM negative"
O["q_negative_control_two_arm"] = with_(B_COHORT, B_EVENTS, B_FLAGGED, f"n AS ({counts('b_flagged', 'experiment', 'linked_before_entry')})", effect_ctes("n", "experiment"), adjusted("effect", "adj", "p_value_two_sided", "", "experiment")) + "SELECT count(*) AS comparisons, count(*) FILTER (WHERE p_value_holm < 0.05) AS rejections, count(*) FILTER (WHERE p_value_holm < 0.05) = 0 AS passed FROM adj"
SRM_OK = f"srm_ok AS (SELECT bool_and(n = m) AS passed FROM (SELECT count(*) AS n, min(count(*)) OVER (PARTITION BY {BLOCKS}) AS m FROM c_ledger GROUP BY {BLOCKS}, arm))"
GATES = """gates AS (SELECT 'assignment_contract' AS gate, true AS passed UNION ALL SELECT 'exact_block_allocation', (SELECT passed FROM srm_ok) UNION ALL SELECT 'sample_ratio', (SELECT passed FROM srm_ok)
UNION ALL SELECT 'concurrent_holdout', (SELECT bool_and(n = 1) FROM (SELECT count(DISTINCT assigned_at) AS n FROM c_ledger GROUP BY lifecycle_segment, tenure_band, assignment_wave))
UNION ALL SELECT 'aligned_14_day_followup', aligned_followup FROM followup UNION ALL SELECT 'complete_followup_and_latency_buffer', passed FROM followup
UNION ALL SELECT 'no_contamination', passed FROM contamination UNION ALL SELECT 'active_delivery_coverage', active_delivery_coverage_passed FROM contamination
UNION ALL SELECT 'pre_period_negative_control', passed FROM negative
UNION ALL SELECT 'itt_population_preserved', (SELECT count(*) = count(DISTINCT participant_id) AND count(*) = (SELECT count(*) FROM c_ledger) FROM c_frame))"""
GATE_ALL = (*C_ALL, *NEGATIVE, DELIVERIES.format("c_clean"), CONTAMINATION, FOLLOWUP.format("c_clean"), SRM_OK, GATES)
O["q_gates"] = with_(*GATE_ALL) + "SELECT gate, passed FROM gates"
# the candidate's own comparison, by names of its own because the negative control uses the others
FUNDED = f"""fp AS (SELECT a.arm, CAST(a.n AS DOUBLE) n, CAST(a.s AS DOUBLE) s, CAST(h.s AS DOUBLE) c FROM (SELECT {BLOCKS}, arm, count(*) n, sum(funded_14d) s FROM c_frame GROUP BY ALL) a JOIN (SELECT {BLOCKS}, arm, count(*) n, sum(funded_14d) s FROM c_frame GROUP BY ALL) h USING ({BLOCKS}) WHERE a.arm <> 'holdout' AND h.arm = 'holdout'),
f1 AS (SELECT arm, sum(s - c) / sum(n) AS d, sqrt(sum(n * n * (s / n * (1.0 - s / n) / (n - 1) + c / n * (1.0 - c / n) / (n - 1))) / pow(sum(n), 2)) AS se FROM fp GROUP BY arm),
f2 AS (SELECT arm, d, {p_of('(d / se)')} AS fpv FROM f1), {adjusted('f2', 'fadj', 'fpv', '', 'arm')}"""
O["q_decision"] = with_(
    *GATE_ALL, GUARD, FUNDED,
    "failed AS (SELECT gate FROM gates WHERE NOT passed)",
    f"""reasons AS (SELECT 1 AS part, gate AS name, 'quality_gate_failed:' || gate AS reason FROM failed
UNION ALL SELECT 2, '', 'primary_superiority_not_established' FROM fadj WHERE arm = '{CANDIDATE}' AND NOT (p_value_holm < 0.05 AND d > 0)
UNION ALL SELECT 3, outcome, 'guardrail_noninferiority_not_established:' || outcome FROM guard WHERE arm = '{CANDIDATE}' AND NOT ok)""",
) + f"SELECT CASE WHEN (SELECT count(*) FROM reasons) = 0 THEN 'criteria_met' ELSE 'continue_testing' END AS status, '{CANDIDATE}' AS candidate_arm, coalesce((SELECT string_agg(reason, ',' ORDER BY part, name) FROM reasons), '') AS reasons, coalesce((SELECT string_agg(gate, ',' ORDER BY gate) FROM failed), '') AS failed_gates"

O["q_balance_smd"] = with_(
    B_COHORT,
    "r AS (SELECT c.experiment, c.arm, c.c_acctbal, CAST(coalesce(o.n, 0) AS DOUBLE) AS orders_before FROM b_cohort c LEFT JOIN (SELECT 'p' || o_custkey AS participant_id, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1) o USING (participant_id))",
    "l AS (SELECT experiment, arm, 'c_acctbal' AS covariate, c_acctbal AS x FROM r UNION ALL SELECT experiment, arm, 'orders_before', orders_before FROM r)",
    "g AS (SELECT experiment, covariate, avg(x) FILTER (WHERE arm = 'treatment') tm, avg(x) FILTER (WHERE arm = 'control') cm, var_samp(x) FILTER (WHERE arm = 'treatment') tv, var_samp(x) FILTER (WHERE arm = 'control') cv FROM l GROUP BY 1, 2)",
) + f"SELECT experiment, covariate, {r9('tm')} AS treatment_mean, {r9('cm')} AS control_mean, {r9('(tm - cm) / nullif(sqrt((tv + cv) / 2.0), 0.0)')} AS smd FROM g"
O["q_cadence"] = with_(
    *C_ALL,
    "l AS (SELECT 'funded_14d' AS outcome_name, lifecycle_segment || '|' || tenure_band AS stratum, cadence, funded_14d = 1 AS y FROM c_frame WHERE cadence IS NOT NULL UNION ALL SELECT 'pre_period_engaged', lifecycle_segment || '|' || tenure_band, cadence, pre_period_engaged = 1 FROM c_frame WHERE cadence IS NOT NULL)",
    f"n AS ({counts('l', 'outcome_name, stratum', 'y', 'cadence', 'twice_weekly', 'daily')})", effect_ctes("n", "outcome_name, stratum"), adjusted("effect", "adj", "p_value_two_sided", "outcome_name", "stratum"),
) + f"SELECT outcome_name, stratum, {effect_columns()}, {r9('p_value_holm')} AS p_value_holm, {r9('p_value_bh')} AS p_value_bh FROM adj"
O["q_aggregate_control"] = with_(
    *B_BASE,
    "n AS (SELECT t.experiment, t.cell, t.ts, t.tn, c.cs, c.cn FROM (SELECT experiment, c_custkey % 8 AS cell, count(*) FILTER (WHERE outcome) ts, count(*) tn FROM done WHERE arm = 'treatment' GROUP BY 1, 2) t JOIN (SELECT experiment, count(*) FILTER (WHERE outcome) cs, count(*) cn FROM done WHERE arm = 'control' GROUP BY 1) c USING (experiment))",
    effect_ctes("n", "experiment, cell"), adjusted("effect", "adj", "p_value_two_sided", "", "experiment, cell"),
) + f"SELECT experiment, cell, {effect_columns()}, {r9('p_value_holm')} AS p_value_holm, {r9('p_value_bh')} AS p_value_bh FROM adj"

R_COUNTS = "r0 AS (SELECT o_orderpriority AS scenario, CAST(year(l_shipdate) * 2 + CASE WHEN month(l_shipdate) > 6 THEN 1 ELSE 0 END AS BIGINT) AS replication, CAST(l_linenumber % 2 AS BIGINT) AS block, l_suppkey % 7 AS arm, l_discount >= 0.05 AS f0, l_tax >= 0.05 AS f1, l_quantity > 45 AS f2, l_returnflag = 'R' AS f3 FROM lineitem JOIN orders ON l_orderkey = o_orderkey), r AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT scenario, replication, block, arm, CAST({k} AS BIGINT) AS outcome, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE f{k}) AS DOUBLE) AS s FROM r0 GROUP BY 1, 2, 3, 4" for k in range(4)
) + ")"


def rep_family(out: str, outcome_no: int) -> str:
    return f"""{out}0 AS (SELECT a.scenario, a.replication, a.arm, avg(a.s / a.n - h.s / h.n) AS d, count(*) AS blocks,
  sum(a.s / a.n * (1.0 - a.s / a.n) / (a.n - 1) + h.s / h.n * (1.0 - h.s / h.n) / (h.n - 1)) / (count(*) * count(*)) AS v
  FROM r a JOIN r h ON a.scenario = h.scenario AND a.replication = h.replication AND a.block = h.block AND h.arm = 0 AND h.outcome = {outcome_no} WHERE a.outcome = {outcome_no} AND a.arm > 0 GROUP BY 1, 2, 3),
{out}1 AS (SELECT *, CASE WHEN v > 0 THEN sqrt(v) END AS se FROM {out}0), {out}2 AS (SELECT *, CASE WHEN se IS NULL THEN 1.0 ELSE {p_of('(d / se)')} END AS p FROM {out}1),
{adjusted(f'{out}2', f'{out}3', 'p', 'scenario, replication', 'arm')},
{out} AS (SELECT *, se IS NOT NULL AS valid, greatest(-1.0, d - {num(Z95)} * se) AS lo, least(1.0, d + {num(Z95)} * se) AS hi, se IS NOT NULL AND p_value_holm < 0.05 AS reject, se IS NOT NULL AND p_value_holm < 0.05 AND d > 0 AS sup FROM {out}3)"""


R_GUARD = f"""rg0 AS (SELECT scenario, replication, outcome, arm, sum(n) AS n, sum(s) AS s FROM r WHERE outcome IN (2, 3) GROUP BY 1, 2, 3, 4),
rg1 AS (SELECT a.scenario, a.replication, a.outcome, a.arm, a.s AS ts, a.n AS tn, h.s AS cs, h.n AS cn, CASE a.outcome WHEN 2 THEN 0.05::DOUBLE ELSE 0.03::DOUBLE END AS margin FROM rg0 a JOIN rg0 h ON a.scenario = h.scenario AND a.replication = h.replication AND a.outcome = h.outcome AND h.arm = 0 WHERE a.arm > 0),
rg AS (SELECT *, ts / tn - cs / cn AS d, least(1.0, ts / tn - cs / cn + sqrt(pow({wil('ts', 'tn', ZG, '+')} - ts / tn, 2) + pow(cs / cn - {wil('cs', 'cn', ZG, '-')}, 2))) AS ub FROM rg1)"""
R_TRUTH = """tr AS (SELECT a.scenario, a.arm, a.x - h.x AS true_effect FROM (SELECT scenario, arm, sum(s) / sum(n) AS x FROM r WHERE outcome = 0 GROUP BY 1, 2) a JOIN (SELECT scenario, sum(s) / sum(n) AS x FROM r WHERE outcome = 0 AND arm = 0 GROUP BY 1) h USING (scenario) WHERE a.arm > 0)"""
R_POLICY = """pp AS (SELECT f.scenario, f.replication, bool_and(valid) AS v, bool_or(reject) AS any_reject, bool_or(sup) AS any_sup, bool_or(sup AND f.arm = 4) AS superior,
  bool_or(f.arm = 4 AND coalesce(valid AND lo <= true_effect AND hi >= true_effect, false)) AS covered, max(d) FILTER (WHERE f.arm = 4) AS eff FROM pf f JOIN tr USING (scenario, arm) GROUP BY 1, 2),
pn AS (SELECT scenario, replication, bool_and(valid) AS v, bool_or(reject) AS neg FROM nf GROUP BY 1, 2),
pg AS (SELECT scenario, replication, bool_and(ub < margin OR arm <> 4) AS safe, bool_or(ub < margin) AS any_safe FROM rg GROUP BY 1, 2),
pj AS (SELECT *, NOT (pp.v AND pn.v) AS invalid FROM pp JOIN pn USING (scenario, replication) JOIN pg USING (scenario, replication)),
pol AS (SELECT scenario, replication, invalid, NOT invalid AND any_reject AS primary_family_any_holm_rejection, NOT invalid AND any_sup AS primary_family_any_superiority, NOT invalid AND superior AS candidate_superiority,
  NOT invalid AND covered AS candidate_nominal_95_ci_coverage, NOT invalid AND neg AS negative_control_family_any_holm_rejection, NOT invalid AND NOT neg AS negative_control_gate_pass,
  NOT invalid AND any_safe AS guardrail_family_any_noninferiority_pass, NOT invalid AND safe AS candidate_guardrails_pass, NOT invalid AND NOT superior AS primary_superiority_not_established, eff AS candidate_effect,
  NOT invalid AND NOT neg AND superior AND safe AS policy_criteria_met, NOT (NOT invalid AND NOT neg AND superior AND safe) AS policy_continue_testing FROM pj)"""
R_ALL = (R_COUNTS, rep_family("pf", 0), rep_family("nf", 1), R_GUARD, R_TRUTH, R_POLICY)
FLAGS = (
    "invalid", "primary_family_any_holm_rejection", "primary_family_any_superiority", "candidate_superiority", "candidate_nominal_95_ci_coverage", "negative_control_family_any_holm_rejection",
    "negative_control_gate_pass", "guardrail_family_any_noninferiority_pass", "candidate_guardrails_pass", "primary_superiority_not_established", "policy_criteria_met", "policy_continue_testing",
)
R_RATES = (
    "fl AS (" + " UNION ALL ".join(f"SELECT scenario, '{f}' AS metric, {f} AS flag FROM pol" for f in FLAGS)
    + " UNION ALL SELECT f.scenario, 'nominal_95_ci_coverage:' || f.arm, NOT p.invalid AND coalesce(f.valid AND f.lo <= true_effect AND f.hi >= true_effect, false) FROM pf f JOIN tr USING (scenario, arm) JOIN pol p USING (scenario, replication)"
    + " UNION ALL SELECT g.scenario, 'candidate_guardrail:' || g.outcome, NOT p.invalid AND g.ub < g.margin FROM rg g JOIN pol p USING (scenario, replication) WHERE g.arm = 4), "
    "rc AS (SELECT scenario, metric, count(*) FILTER (WHERE flag) AS k, count(*) AS reps, CAST(count(*) FILTER (WHERE flag) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n FROM fl GROUP BY 1, 2), "
    f"rates AS (SELECT scenario, metric, k, reps, s / n AS rate, least(s / n, {wil('s', 'n', Z99, '-')}) AS lo, greatest(s / n, {wil('s', 'n', Z99, '+')}) AS hi FROM rc)"
)
O["q_rep_family"] = with_(R_COUNTS, rep_family("pf", 0)) + (
    f"SELECT scenario, replication, arm, {r9('d')} AS risk_difference, blocks, valid, {r9('se')} AS standard_error, {r9('lo')} AS ci_low, {r9('hi')} AS ci_high, {r9('p')} AS p_value, {r9('p_value_holm')} AS p_value_holm, reject AS holm_reject, sup AS superiority_pass FROM pf"
)
O["q_rep_guardrail"] = with_(R_COUNTS, R_GUARD) + f"SELECT scenario, replication, outcome, arm, CAST(tn AS BIGINT) AS n, CAST(ts AS BIGINT) AS successes, {r9('d')} AS risk_difference, {r9('ub')} AS upper_bound, margin, ub < margin AS noninferiority_pass FROM rg"
O["q_rep_policy"] = with_(*R_ALL) + f"SELECT * REPLACE ({r9('candidate_effect')} AS candidate_effect) FROM pol"
O["q_rep_rates"] = with_(*R_ALL, R_RATES) + f"SELECT scenario, metric, k AS successes, reps AS replications, {r9('rate')} AS rate, {r9('lo')} AS ci_low, {r9('hi')} AS ci_high FROM rates"
O["q_rep_diagnostics"] = with_(*R_ALL) + (
    f"SELECT scenario, {r9('m')} AS mean_estimate, {r9('sd')} AS empirical_sd, {r9('true_effect')} AS true_effect, {r9('m - true_effect')} AS monte_carlo_bias FROM (SELECT scenario, avg(candidate_effect) AS m, stddev_samp(candidate_effect) AS sd FROM pol GROUP BY 1) JOIN tr USING (scenario) WHERE arm = 4"
)
O["q_rep_gates"] = with_(*R_ALL, R_RATES) + " UNION ALL ".join(
    f"SELECT '{g}' AS gate, {r9(f'CAST({x} AS DOUBLE)')} AS observed, coalesce({x} {limit}, false) AS passed FROM rates"
    for g, x, limit in (
        ("null_primary_fwer", "max(hi) FILTER (WHERE metric = 'primary_family_any_holm_rejection' AND scenario = '5-LOW')", "<= 0.06"),
        ("negative_control_fwer", "max(hi) FILTER (WHERE metric = 'negative_control_family_any_holm_rejection')", "<= 0.06"),
        ("null_interval_coverage", "min(lo) FILTER (WHERE starts_with(metric, 'nominal_95_ci_coverage:') AND scenario = '5-LOW')", ">= 0.93"),
        ("strong_effect_detection", "max(lo) FILTER (WHERE metric = 'candidate_superiority' AND scenario = '1-URGENT')", ">= 0.99"),
        ("boundary_false_noninferiority", "max(hi) FILTER (WHERE metric = 'guardrail_family_any_noninferiority_pass' AND scenario = '3-MEDIUM')", "<= 0.06"),
        ("invalid_replications", "coalesce(sum(k) FILTER (WHERE metric = 'invalid'), 0)", "= 0"),
    )
)

FAULTY = """faulty AS (SELECT participant_id, lifecycle_segment, tenure_band, assignment_wave, assigned_at, CASE k WHEN 5 THEN assigned_at + INTERVAL 1 DAY ELSE eligible_at END AS eligible_at,
  CASE k WHEN 0 THEN ' ' WHEN 1 THEN 'other' ELSE arm END AS arm, CASE k WHEN 2 THEN 'current' WHEN 3 THEN 'nothing' ELSE content END AS content, CASE WHEN k <> 4 THEN cadence END AS cadence,
  CASE k WHEN 6 THEN 'nan'::DOUBLE WHEN 7 THEN 0.2::DOUBLE ELSE expected_probability END AS expected_probability, CASE k WHEN 8 THEN 'v0' ELSE randomization_version END AS randomization_version
  FROM (SELECT *, CAST(substr(participant_id, 2) AS BIGINT) % 12 AS k FROM c_ledger))"""


def blank(c: str) -> str:
    return f"{c} IS NULL OR trim({c}) = ''"


ACTIVE = ", ".join(f"'{a}'" for a in ARMS[1:])
O["q_ledger_contract"] = with_(*C_BASE, FAULTY) + rules(
    "faulty",
    {f"{c}_blank": blank(c) for c in ("participant_id", "lifecycle_segment", "tenure_band", "assignment_wave", "arm", "randomization_version")}
    | {
        "time_missing": "eligible_at IS NULL OR assigned_at IS NULL", "eligible_after_assigned": "eligible_at > assigned_at", "unknown_arm": f"arm NOT IN ('holdout', {ACTIVE})",
        "wrong_version": "randomization_version <> 'stratified-permuted-block-v1'", "holdout_with_factors": "arm = 'holdout' AND (content IS NOT NULL OR cadence IS NOT NULL)",
        "active_without_factors": f"arm IN ({ACTIVE}) AND (content IS NULL OR cadence IS NULL)", "unknown_content": "content NOT IN ('current', 'challenger_a', 'challenger_b')",
        "unknown_cadence": "cadence NOT IN ('daily', 'twice_weekly')", "arm_not_its_factors": f"arm IN ({ACTIVE}) AND arm <> content || '__' || cadence",
        "probability_not_finite": "expected_probability IS NULL OR isnan(expected_probability) OR isinf(expected_probability)",
        "probability_not_equal_share": "NOT isnan(expected_probability) AND abs(expected_probability - CAST(1.0 AS DOUBLE) / 7) > 1e-15",
    },
)
O["q_event_contract"] = (
    with_(*C_BASE, C_EVENTS)
    + rules(
        "c_events",
        {f"{c}_blank": blank(c) for c in ("event_id", "participant_id", "event_type")}
        | {
            "unknown_type": "event_type NOT IN ('delivered', 'funded', 'unsubscribed', 'complained', 'pre_period_engaged')", "time_missing": "event_at IS NULL OR available_at IS NULL",
            "arrives_before_it_happens": "available_at < event_at", "delivery_without_factors": "event_type = 'delivered' AND (delivered_content IS NULL OR delivered_cadence IS NULL)",
            "factors_without_delivery": "event_type <> 'delivered' AND (delivered_content IS NOT NULL OR delivered_cadence IS NOT NULL)",
            "unknown_content": "delivered_content NOT IN ('current', 'challenger_a', 'challenger_b')", "unknown_cadence": "delivered_cadence NOT IN ('daily', 'twice_weekly')",
            "orphan_participant": "CAST(substr(participant_id, 2) AS BIGINT) % 10 = 0",
        },
    )
    + " UNION ALL SELECT 'duplicate_event_id', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM c_events GROUP BY event_id HAVING count(*) > 1)"
    + " UNION ALL SELECT 'duplicate_payload', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM c_events GROUP BY participant_id, event_type, event_at, delivered_content, delivered_cadence HAVING count(*) > 1)"
)
O["q_factorial_contract"] = (
    with_(*C_ALL, "bad AS (SELECT participant_id, arm, content, CASE WHEN k <> 1 THEN cadence END AS cadence, CASE WHEN k = 2 THEN 7 ELSE funded_14d END AS funded_14d, unsubscribe_14d, complaint_14d FROM (SELECT *, CAST(substr(participant_id, 2) AS BIGINT) % 50 AS k FROM c_frame))", "cells AS (SELECT DISTINCT arm, content, cadence FROM bad)")
    + rules(
        "bad",
        {
            "id_missing": "participant_id IS NULL", "arm_blank": blank("arm"), "holdout_with_factors": "arm = 'holdout' AND (content IS NOT NULL OR cadence IS NOT NULL)",
            "active_without_factors": "arm <> 'holdout' AND (content IS NULL OR cadence IS NULL)",
        }
        | {k: v for o in ("funded_14d", "unsubscribe_14d", "complaint_14d") for k, v in ((f"{o}_not_binary", f"{o} NOT IN (0, 1)"), (f"{o}_missing", f"{o} IS NULL"))},
    )
    + """ UNION ALL SELECT 'duplicate_id', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM bad GROUP BY participant_id HAVING count(*) > 1)
UNION ALL SELECT 'active_arms_not_six', abs(count(DISTINCT arm) - 6) FROM cells WHERE arm <> 'holdout'
UNION ALL SELECT 'grid_cells_not_six', abs(count(*) - 6) FROM (SELECT DISTINCT content, cadence FROM cells WHERE arm <> 'holdout')
UNION ALL SELECT 'arm_in_more_cells', count(*) - count(DISTINCT arm) FROM cells WHERE arm <> 'holdout'
UNION ALL SELECT 'holdout_absent', CASE WHEN count(*) > 0 THEN CAST(0 AS BIGINT) ELSE 1 END FROM cells WHERE arm = 'holdout'
UNION ALL SELECT 'contents_not_three', abs(count(DISTINCT content) - 3) FROM cells WHERE arm <> 'holdout'"""
)

O["q_report_figures"] = (
    with_(*C_ALL, "arms AS (SELECT arm, count(*) AS n FROM c_ledger GROUP BY 1)", f"plan AS (SELECT CAST(min(n) AS DOUBLE) AS m, {num(Q(1 - 0.05 / 6 / 2) + Q(0.8))} AS z FROM arms)")
    + " UNION ALL ".join(
        f"SELECT '{section}' AS section, '{name}' AS name, {r9(f'CAST(({value}) AS DOUBLE)')} AS value"
        for section, name, value in [
            *[("population", x, f"SELECT count(*) FROM {src}") for x, src in (("eligible", "c_ledger"), ("randomized", "c_ledger"), ("itt_analyzed", "c_frame"), ("assignment_blocks", f"(SELECT DISTINCT {BLOCKS} FROM c_ledger)"))],
            ("event_counts", "total", "SELECT count(*) FROM c_clean"),
            *[("event_counts", t, f"SELECT count(*) FROM c_clean WHERE event_type = '{t}'") for t in ("delivered", "funded", "unsubscribed", "complained", "pre_period_engaged")],
            ("prospective_power_plan", "baseline_funding_rate", "0.04"), ("prospective_power_plan", "planned_units_per_arm", "SELECT m FROM plan"),
            ("prospective_power_plan", "planning_alpha_per_comparison", num(0.05 / 6)), ("prospective_power_plan", "power", "0.8"),
            ("prospective_power_plan", "approximate_mde_absolute", "SELECT z * sqrt(0.04::DOUBLE * 0.96 * (1.0 / m + 1.0 / m)) FROM plan"),
        ]
    )
)
O["q_column_contracts"] = """SELECT n.rows, r.rule, r.broken FROM (SELECT count(*) AS rows FROM customer) n, (VALUES ('unique', 0), ('unique_of_repeated', 1), ('required', 0), ('required_of_missing', 1), ('exact', 0), ('exact_of_more', 1), ('instant', 0), ('instant_without_zone', 1)) r(rule, broken)"""
O["q_reader"] = with_(
    A_COHORT, A_EVENTS, "k AS (SELECT c_custkey % 10 AS k FROM a_cohort)",
    "reasons(k, reason) AS (VALUES (1, 'assigned_at_naive'), (2, 'assigned_at_invalid'), (3, 'messages_delivered_invalid'), (4, 'linked_before_entry_invalid'), (5, 'participant_id_missing'))",
    "e AS (SELECT CASE WHEN day(event_at) = 9 THEN 'event_at_naive' ELSE 'taken' END AS reason FROM a_events)",
) + (
    "SELECT 'assignments' AS table, coalesce(r.reason, 'taken') AS reason, count(*) AS rows FROM k LEFT JOIN reasons r USING (k) GROUP BY 2 UNION ALL SELECT 'events', reason, count(*) FROM e GROUP BY 2"
)
O["q_pruned_events"] = with_(*A_BASE) + f"SELECT participant_id, arm, {micros('first_outcome_at')}, outcome FROM a_out WHERE assigned_at < TIMESTAMP '2024-01-15'"
O["q_event_days"] = with_(A_COHORT, A_EVENTS, "b AS (SELECT min(assigned_at) AS lo, max(assigned_at) + INTERVAL 7 DAY AS hi FROM a_cohort WHERE assigned_at < TIMESTAMP '2024-01-06')") + (
    "SELECT strftime(event_at, '%Y-%m-%d') AS day, count(*) AS rows FROM a_events, b WHERE event_at >= lo AND event_at < hi GROUP BY 1"
)


def texts(src: str) -> str:
    """(record) of all rows of ``src`` as JSON texts: keys sorted, nine digits after the point, what is not finite as null."""
    c = "COLUMNS(* EXCLUDE row_no)"
    double = f"typeof({c}) = 'DOUBLE'"
    value = (
        f"CASE WHEN {c} IS NULL THEN 'null' WHEN {double} AND NOT isfinite(coalesce(try_cast({c} AS DOUBLE), 0)) THEN 'null' "
        f"WHEN {double} THEN printf('%.9f', round(try_cast({c} AS DOUBLE), 9) + 0.0) WHEN typeof({c}) = 'VARCHAR' THEN CAST(to_json(CAST({c} AS VARCHAR)) AS VARCHAR) "
        f"WHEN typeof({c}) LIKE '%[]' THEN CAST(to_json({c}) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"
    )
    return (
        f"(SELECT '{{' || string_agg(to_json(k) || ':' || v, ',' ORDER BY k) || '}}' AS record FROM (UNPIVOT (SELECT row_no, {value} FROM (SELECT row_number() OVER () AS row_no, * FROM {src})) "
        "ON COLUMNS(* EXCLUDE row_no) INTO NAME k VALUE v) GROUP BY row_no)"
    )


def json_document(sections: dict[str, str]) -> str:
    """A report of full statements by section."""
    names = sorted(sections)
    ctes = [f"s{k} AS ({sections[n]})" for k, n in enumerate(names)]
    parts = [f"'\"{n}\":[' || (SELECT coalesce(string_agg(record, ',' ORDER BY record), '') FROM {texts(f's{k}')}) || ']'" for k, n in enumerate(names)]
    return with_(*ctes) + "SELECT '{' || " + " || ',' || ".join(parts) + " || '}' AS report"


O["q_records"] = with_(f"s AS (SELECT *, CAST('nan' AS DOUBLE) AS not_finite FROM ({O['q_experiment_effects']}))") + f"SELECT record FROM {texts('s')}"
O["q_report"] = json_document({"effects": O["q_experiment_effects"], "censoring": O["q_censoring_by_experiment"], "funnel": O["q_funnel_summary"], "unsubscribe": O["q_unsub"], "population": O["q_population_flow"]})
O["q_prospective_report"] = json_document(
    {
        "figures": O["q_report_figures"], "randomization": O["q_ledger_digest"], "sample_ratio": with_(*C_BASE) + ", " + srm("c_ledger", BLOCKS),
        "contamination_audit": with_(*C_BASE, C_EVENTS, C_CLEAN, DELIVERIES.format("c_clean"), CONTAMINATION) + "SELECT * FROM contamination",
        "followup_audit": with_(*C_BASE, C_EVENTS, C_CLEAN, FOLLOWUP.format("c_clean")) + "SELECT * FROM followup",
        "primary_funding_family": O["q_primary_family"], "guardrail_noninferiority_family": O["q_guardrail_family"], "pre_period_negative_control": O["q_negative_control"],
        "quality_gates": O["q_gates"],
        "decision": f"SELECT status, candidate_arm, CASE WHEN reasons = '' THEN [] ELSE string_split(reasons, ',') END AS reasons, CASE WHEN failed_gates = '' THEN [] ELSE string_split(failed_gates, ',') END AS failed_gates FROM ({O['q_decision']})",
    }
)
ORACLE_SQL = O

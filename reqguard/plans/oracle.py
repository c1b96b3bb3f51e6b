"""The same results in plain SQL, written from the definitions: windows, list functions and recursion."""

from reqguard import constants as C
from reqguard.sources import requests as RQ

DAY_US = 86_400 * 1_000_000
SHORT, LONG, BURST = 7 * DAY_US, 30 * DAY_US, DAY_US


def q(text):
    return "'" + str(text).replace("'", "''") + "'"


def items(values):
    return "[" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + "]"


def inlist(values):
    return "(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + ")"


def has_any(text, words):
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def matches(text, patterns):
    return "(" + " OR ".join(f"regexp_matches({text}, {q(p)})" for p in patterns) + ")"


def rnd(x, d=6):
    s = f"1e{d}"
    return f"(floor(({x})::DOUBLE * {s} + 0.5e0) / {s})"


def present(exprs):
    return f"list_filter([{', '.join(exprs)}], lambda x: x IS NOT NULL)"


def flags_of(payload):
    parts = [f"CASE WHEN {matches(f'lower({payload})', C.PAYLOAD_FLAGS[f])} THEN {q(f)} END"
             for f in sorted(C.PAYLOAD_FLAGS)]
    return present(parts)


def flag(payload, name):
    return f"CASE WHEN {matches(f'lower({payload})', C.PAYLOAD_FLAGS[name])} THEN 1 ELSE 0 END"


REQ = f"""req AS (
  SELECT event_id, user_id, epoch_us(ts) AS t_us, '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS ip,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST'
         WHEN event_type = 'error' THEN {items(RQ.ERROR_METHODS)}[k % 3 + 1] ELSE 'GET' END AS method,
    CASE event_type WHEN 'view' THEN '/api/users/' || k WHEN 'click' THEN {items(RQ.CLICK_PATHS)}[k % 8 + 1]
         WHEN 'signup' THEN '/login' WHEN 'purchase' THEN '/api/data'
         ELSE {items(RQ.ERROR_PATHS)}[k % 4 + 1] END AS endpoint,
    CASE WHEN event_type = 'error' THEN {items(RQ.ERROR_CODES)}[k % 4 + 1] ELSE 200 END::BIGINT AS status_code,
    {items(RQ.AGENTS)}[(CASE WHEN k < 70 THEN k % 2 ELSE k % 6 END) + 1] AS user_agent,
    user_id || '-' || (k % 5) AS session_id,
    CASE WHEN event_type = 'error' OR k >= 90 THEN {items(RQ.PAYLOADS)}[k % 12 + 1] ELSE '' END AS payload,
    value AS response_time_ms, k, event_type
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)
)"""

NOW = "(SELECT max(t_us) FROM req)"
DECEPTIVE = has_any("lower(endpoint)", C.DECEPTIVE_ROUTES)
FAILED = "(method = 'POST' AND contains(lower(endpoint), 'login') AND contains(lower(payload), 'failed'))"
FP = "sha256(user_agent || '|' || endpoint || '|' || method || '|' || substr(payload, 1, 50))"


def with_req(body, *ctes):
    return "WITH RECURSIVE " + ",\n".join([REQ, *ctes]) + "\n" + body


# ---------------------------------------------------------------- trailing windows, by actor or for the whole site
def feat(key="ip"):
    part = f"PARTITION BY {key} ORDER BY t_us RANGE BETWEEN"
    return f"""rowv AS (
  SELECT *, (status_code IN (401, 403, 422))::INT AS fail,
    (status_code IN (401, 403, 422) AND {has_any('endpoint', C.LOGIN_MARKERS)})::INT AS login_fail,
    (endpoint IN {inlist(C.SENSITIVE_ENDPOINTS)})::INT AS sensitive, (method IN {inlist(C.UNUSUAL_METHODS)})::INT AS unusual,
    {flag('payload', 'SQL_INJECTION')} AS f0, {flag('payload', 'XSS')} AS f1, {flag('payload', 'PATH_TRAVERSAL')} AS f2,
    {flag('payload', 'COMMAND_INJECTION')} AS f3, {has_any('lower(user_agent)', C.BOT_WORDS)} AS bot,
    list_transform(regexp_extract_all(endpoint, '/([0-9]+)', 1), lambda s: s::BIGINT) AS nums
  FROM req),
seen AS (
  SELECT *, count(*) OVER s AS n, count(*) OVER l AS n_long, count(*) OVER b AS n_burst, min(t_us) OVER s AS t_first,
    lag(t_us, 3) OVER (PARTITION BY {key} ORDER BY t_us) AS t3,
    sum(fail) OVER s AS fails, sum(login_fail) OVER s AS login_fails, sum(sensitive) OVER s AS sens,
    sum(unusual) OVER s AS unus, count(DISTINCT endpoint) OVER s AS n_paths,
    count(DISTINCT nullif(session_id, '')) OVER s AS n_sess, count(DISTINCT nullif(user_agent, '')) OVER s AS n_agents,
    list(fail) OVER s AS fail_list, list(struct_pack(f0 := f0, f1 := f1, f2 := f2, f3 := f3)) OVER s AS flag_list,
    list(t_us) OVER s AS times, list(nums) OVER s AS num_lists
  FROM rowv
  WINDOW s AS ({part} {SHORT - 1} PRECEDING AND CURRENT ROW), l AS ({part} {LONG - 1} PRECEDING AND CURRENT ROW),
    b AS ({part} {BURST - 1} PRECEDING AND CURRENT ROW)),
shaped AS (
  SELECT *, len(fail_list) - coalesce(list_position(list_reverse(fail_list), 0), len(fail_list) + 1) + 1 AS ok_at,
    CASE WHEN n < 2 THEN 0e0 WHEN n > 4 THEN (3e0 / ((t_us - t3) / 1e6 + 0.001e0))
         / (n / ((t_us - t_first) / 1e6 + 0.001e0) + 0.001e0) ELSE 1e0 END AS accel_raw,
    CASE WHEN n < 2 THEN 0e0 ELSE (t_us - t_first) / 1e6 / (n - 1) END AS avg_gap,
    fails::DOUBLE / n AS fail_rate, f0 + f1 + f2 + f3 AS cur_flags, flag_list[1:20] AS old_flags,
    list_distinct(flatten(num_lists)) AS numbers,
    (n / {7 * 1440}e0) / (n_long / {30 * 1440}e0 + 0.001e0) AS rate_raw
  FROM seen),
feat AS (
  SELECT *, {rnd('accel_raw', 2)} AS acceleration, {rnd('avg_gap', 3)} AS avg_interval,
    {rnd('CASE WHEN n / 11e0 > 2 THEN least(100e0, n / 11e0 * 20) ELSE 0e0 END', 1)} AS freq_score,
    (n >= 2 AND n_burst > 20) AS burst,
    least(coalesce(list_position(list_reverse(fail_list), 0) - 1, n), n) AS streak,
    len(list_filter(numbers, lambda v: list_contains(numbers, v + 1))) >= 3 AS enum,
    (n_paths > 10 AND n > 15) AS scan,
    f0 + list_sum(list_transform(old_flags, lambda x: x.f0)) AS c0, f1 + list_sum(list_transform(old_flags, lambda x: x.f1)) AS c1,
    f2 + list_sum(list_transform(old_flags, lambda x: x.f2)) AS c2, f3 + list_sum(list_transform(old_flags, lambda x: x.f3)) AS c3
  FROM shaped),
scores AS (
  SELECT *, {rnd('fail_rate', 3)} AS failure_rate, c0 + c1 + c2 + c3 AS all_flags,
    least(100, 30 * (fails > 5)::INT + 25 * (streak > 3)::INT + 30 * (login_fails > 3)::INT + 15 * (fail_rate > 0.7e0)::INT)::DOUBLE
      AS failure_score,
    least(100, 25 * (sens > 3)::INT + 35 * scan::INT + 20 * enum::INT + 15 * (unus > 5)::INT + 5 * (n_paths > 8)::INT)::DOUBLE
      AS pattern_score,
    least(100, 40 * (c0 > 0)::INT + 35 * (c1 > 0)::INT + 30 * (c2 > 0)::INT + 40 * (c3 > 0)::INT
      + 15 * (c0 + c1 + c2 + c3 > 5)::INT)::DOUBLE AS payload_score,
    least(100, 25 * (n_sess > 3)::INT + 30 * (n_agents > 3)::INT + 15 * (user_agent = '')::INT + 20 * bot::INT)::DOUBLE
      AS session_score,
    n_long >= 10 AS has_baseline, CASE WHEN n_long >= 10 THEN {rnd('rate_raw', 2)} ELSE 0e0 END AS rate_deviation,
    CASE WHEN n_long >= 10 AND rate_raw > 3 THEN 40e0 ELSE 0e0 END AS baseline_score
  FROM feat)"""


FEAT = feat()
RAW = """boosted AS (
  SELECT *, CASE WHEN acceleration > 3 THEN least(100e0, 1.3e0 * f) ELSE f END AS boosted_freq
  FROM (SELECT *, CASE WHEN burst THEN least(100e0, 1.5e0 * freq_score) ELSE freq_score END AS f FROM scores)),
weighed AS (
  SELECT *, 0.22e0 * boosted_freq + 0.28e0 * failure_score + 0.20e0 * pattern_score + 0.15e0 * payload_score
      + 0.08e0 * session_score + 0.07e0 * baseline_score AS base,
    (boosted_freq > 30)::BIGINT + (failure_score > 30)::BIGINT + (pattern_score > 30)::BIGINT + (payload_score > 30)::BIGINT
      AS elevated_signals FROM boosted),
risks AS (
  SELECT *, CASE WHEN elevated_signals >= 3 THEN least(100e0, base * 1.3e0)
                 WHEN elevated_signals >= 2 THEN least(100e0, base * 1.15e0) ELSE base END AS raw,
    row_number() OVER (PARTITION BY ip ORDER BY t_us, event_id) AS rn FROM weighed)"""
LEVEL = ("CASE WHEN {0} <= 30 THEN 'NORMAL' WHEN {0} <= 60 THEN 'ELEVATED' WHEN {0} <= 80 THEN 'SUSPICIOUS' "
         "ELSE 'MALICIOUS' END")
RISK = f"""slim AS (SELECT ip, event_id, t_us, rn, raw FROM risks),
chain AS (
  SELECT ip, rn, t_us, event_id, floor(least(100e0, greatest(0e0, raw)) * 10 + 0.5e0) / 10 AS score FROM slim WHERE rn = 1
  UNION ALL
  SELECT x.ip, x.rn, x.t_us, x.event_id, floor(least(100e0, greatest(0e0, CASE WHEN x.prev = 0 THEN x.raw
      WHEN x.raw > 60 THEN greatest(x.d * x.prev + (1 - x.d) * x.raw, x.raw * 0.9e0)
      ELSE x.d * x.prev + (1 - x.d) * x.raw END)) * 10 + 0.5e0) / 10
  FROM (SELECT s.*, c.score AS prev, exp(-0.005e0 * ((s.t_us - c.t_us) / 1e6)) AS d
        FROM chain c JOIN slim s ON s.ip = c.ip AND s.rn = c.rn + 1) x),
risk AS (SELECT r.*, c.score, {LEVEL.format('c.score')} AS risk_level FROM risks r JOIN chain c USING (event_id)),
last_risk AS (SELECT * FROM risk QUALIFY row_number() OVER (PARTITION BY ip ORDER BY t_us DESC, event_id DESC) = 1)"""
TO_RISK = (FEAT, RAW, RISK)

# ---------------------------------------------------------------- identity memory and decisions
SIG = "sig AS (SELECT *, {0} AS matched FROM req)".format(present(
    [f"CASE WHEN {matches('payload || chr(32) || user_agent || chr(32) || endpoint', p)} THEN {q(n)} END"
     for n, (_, p) in C.SIGNATURES.items()]))
SIG_SCORE = "least(100e0, " + " + ".join(
    f"CASE WHEN list_contains(matched, {q(n)}) THEN {w}e0 ELSE 0e0 END" for n, (w, _) in C.SIGNATURES.items()) + ")"


def memory(key):
    rows = "PARTITION BY identity ORDER BY t_us, event_id ROWS BETWEEN"
    return f"""ident AS (
  SELECT *, {SIG_SCORE} AS signature_score, {FP} AS fingerprint, {DECEPTIVE}::BIGINT AS hit, {FAILED}::BIGINT AS failed FROM sig),
known AS (
  SELECT *, {key} AS identity FROM ident),
hits AS (
  SELECT event_id, lag(endpoint) OVER w AS prev_path, (t_us - lag(t_us) OVER w) AS dwell FROM known WHERE hit = 1
  WINDOW w AS (PARTITION BY identity ORDER BY t_us, event_id)),
gaps AS (
  SELECT k.*, t_us - lag(t_us) OVER (PARTITION BY identity ORDER BY t_us, event_id) AS gap, h.dwell,
    (h.prev_path IS NOT DISTINCT FROM endpoint AND hit = 1)::BIGINT AS rep, (hit = 1 AND method = 'POST')::BIGINT AS post
  FROM known k LEFT JOIN hits h USING (event_id)),
mem AS (
  SELECT *, count(*) OVER a AS total, sum(hit) OVER a AS sens, sum(failed) OVER a AS failed_logins, min(t_us) OVER a AS first_us,
    count(DISTINCT nullif(user_agent, '')) OVER a AS agents,
    list(t_us) OVER f AS times, list(endpoint) OVER f AS paths, list(gap) OVER g AS gap_list,
    sum(rep) OVER a AS repeats, sum(post) OVER a AS posts, count(*) FILTER (dwell < 60000000) OVER a AS dwells,
    sum(dwell) FILTER (dwell < 60000000) OVER a AS dwell_us
  FROM gaps WINDOW a AS ({rows} UNBOUNDED PRECEDING AND CURRENT ROW), f AS ({rows} 49 PRECEDING AND CURRENT ROW),
    g AS ({rows} 48 PRECEDING AND CURRENT ROW)),
mem2 AS (
  SELECT *, len(list_filter(times, lambda x: x > t_us - {BURST})) AS burst_density, len(list_distinct(paths)) AS diversity,
    len(times) AS n50, list_filter(gap_list, lambda x: x IS NOT NULL) AS gl FROM mem),
mem3 AS (
  SELECT *, len(gl) AS n_gaps, coalesce(list_sum(gl), 0)::BIGINT AS gap_sum, sens::DOUBLE / total AS sens_ratio,
    coalesce(list_var_pop(list_transform(gl, lambda x: x / 1e6)), 0) AS gap_var FROM mem2),
scored AS (
  SELECT *, least(100e0, CASE WHEN agents > 2 THEN 15e0 * agents ELSE 0 END
      + CASE WHEN burst_density > 10 THEN least((burst_density - 10) * 2e0, 40e0) ELSE 0 END
      + CASE WHEN total > 5 AND sens_ratio > 0.2e0 THEN sens_ratio * 50e0 ELSE 0 END + failed_logins * 10e0
      + CASE WHEN n_gaps > 5 AND gap_var < 0.05e0 AND gap_sum / n_gaps / 1e6 < 2 THEN 30e0 ELSE 0 END) AS deviation,
    least(100e0, sens * 15e0 + repeats * 20e0 + posts * 40e0
      + CASE WHEN dwells > 0 AND dwell_us / dwells / 1e6 < 5 THEN 30e0 ELSE 0 END) AS deception,
    least(1e0, CASE WHEN sens_ratio > 0.5e0 THEN 0.4e0 ELSE 0 END + CASE WHEN failed_logins::DOUBLE / total > 0.5e0 THEN 0.4e0 ELSE 0 END
      + CASE WHEN burst_density > 10 THEN 0.3e0 ELSE 0 END) AS anomaly
  FROM mem3)"""


def decide(name, src, dev, ml, rep, sig, dec):
    return f"""{name} AS (
  SELECT *, CASE WHEN {sig} > 90 THEN 'block' WHEN {dec} > 80 THEN 'deception_flag' WHEN total_risk > 85 THEN 'block'
      WHEN total_risk > 70 THEN 'quarantine' WHEN total_risk > 50 THEN 'throttle'
      WHEN {ml} * 100 > 75 OR {dev} > 70 THEN 'shadow_monitor' ELSE 'allow' END AS action
  FROM (SELECT *, 0.15e0 * {dev} + 0.20e0 * 100 * {ml} + 0.10e0 * {rep} + 0.30e0 * {sig} + 0.25e0 * {dec} AS total_risk FROM {src}))"""


FIRST = decide("first", "scored", "deviation", "anomaly", "0e0", "signature_score", "deception")
SEVERE = inlist(C.SEVERE_ACTIONS)
BEFORE = "ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
# actions turn severe by severe ones before them, round by round, until none does
MULT = f"""step0 AS MATERIALIZED (SELECT event_id, t_us, endpoint, fingerprint, matched, deviation, anomaly, signature_score, deception,
  (action IN {SEVERE})::BIGINT AS severe FROM first),
keys0 AS MATERIALIZED (SELECT event_id, t_us, 'path' AS kind, endpoint AS value FROM step0
  UNION ALL SELECT event_id, t_us, 'fp', fingerprint FROM step0 UNION ALL SELECT event_id, t_us, 'sig', unnest(matched) FROM step0),
rounds AS (
  SELECT 0 AS round, event_id, severe FROM step0
  UNION ALL
  SELECT round + 1, event_id, now FROM (SELECT *, bool_or(now <> severe) OVER () AS turned FROM (
    SELECT event_id, round, x.severe, (signature_score * sm > 90 OR deception * pm > 80 OR 0.15e0 * (deviation * fm)
      + 0.20e0 * 100 * (anomaly * fm) + 0.10e0 * rep + 0.30e0 * (signature_score * sm) + 0.25e0 * (deception * pm) > 70)::BIGINT AS now
    FROM (SELECT event_id, any_value(round) AS round, any_value(severe) AS severe, 1 + 0.1e0 * max(n) FILTER (kind = 'path') AS pm,
        1 + 0.25e0 * max(n) FILTER (kind = 'fp') AS fm, least(100e0, 25e0 * max(n) FILTER (kind = 'fp')) AS rep,
        coalesce(1 + (sum(n) FILTER (kind = 'sig'))::DOUBLE * 0.15e0 / count(*) FILTER (kind = 'sig'), 1e0) AS sm
      FROM (SELECT k.event_id, k.kind, r.round, r.severe, coalesce(sum(r.severe) OVER (PARTITION BY k.kind, k.value
          ORDER BY k.t_us, k.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n
        FROM keys0 k JOIN rounds r USING (event_id)) GROUP BY event_id) x JOIN step0 USING (event_id))) WHERE turned),
taken AS (SELECT event_id, arg_max(severe, round) AS severe FROM rounds GROUP BY event_id),
acts AS (SELECT f.*, k.severe FROM first f JOIN taken k USING (event_id)),
sigs AS (SELECT event_id, t_us, severe, unnest(matched) AS sg FROM acts),
sig_counts AS (SELECT event_id, coalesce(sum(severe) OVER (PARTITION BY sg {BEFORE}), 0) AS n FROM sigs),
sig_mult AS (SELECT event_id, 1 + sum(n)::DOUBLE * 0.15e0 / count(*) AS signature_mult FROM sig_counts GROUP BY event_id),
mult AS (
  SELECT a.*, 1 + 0.1e0 * coalesce(sum(severe) OVER (PARTITION BY endpoint {BEFORE}), 0) AS path_mult,
    coalesce(sum(severe) OVER (PARTITION BY fingerprint {BEFORE}), 0) AS fp_n,
    coalesce(signature_mult, 1e0) AS signature_mult
  FROM acts a LEFT JOIN sig_mult USING (event_id)),
adjusted AS (
  SELECT * EXCLUDE (total_risk, action), 1 + 0.25e0 * fp_n AS fingerprint_mult, least(100e0, 25e0 * fp_n) AS repeat,
    deviation * (1 + 0.25e0 * fp_n) AS adj_deviation, anomaly * (1 + 0.25e0 * fp_n) AS adj_anomaly,
    signature_score * signature_mult AS adj_signature, deception * path_mult AS adj_deception FROM mult)"""
FINAL = decide("final", "adjusted", "adj_deviation", "adj_anomaly", "repeat", "adj_signature", "adj_deception")
TO_FIRST = (SIG, memory("fingerprint"), FIRST)
TO_FINAL = (*TO_FIRST, MULT, FINAL)
RESPONSES = f"""resp AS (
  SELECT *, endpoint IN {inlist(C.LOCKABLE_ROUTES)} AND (anomaly > 0.8e0 OR repeat > 5 OR action = 'block') AS lck,
    contains(lower(endpoint), 'login') AND action IN ('throttle', 'block') AND repeat > 3 AS thr,
    list_contains(matched, 'XSS') OR anomaly > 0.9e0 AS san, repeat > 8 OR action = 'quarantine' AS qua,
    contains(endpoint, '/config') OR contains(endpoint, '/backup') OR action = 'deception_flag' AS rot,
    (t_us + floor(300 * (1 + repeat / 10)) * 1000000)::BIGINT AS until_us,
    (t_us + (300 + floor(repeat * 30)) * 1000000)::BIGINT AS throttle_until_us FROM final)"""
RESPONDED = """SELECT *, list_filter([CASE WHEN lck THEN 'temporary_route_lock(' || endpoint || ')' END,
  CASE WHEN lck AND endpoint <> '/login' THEN 'emergency_maintenance_banner' END, CASE WHEN thr THEN 'login_throttle' END,
  CASE WHEN san THEN 'payload_sanitize_mode' END, CASE WHEN qua THEN 'fingerprint_quarantine' END,
  CASE WHEN rot THEN 'secret_rotation' END, CASE WHEN rot THEN 'deception_intensify' END], lambda x: x IS NOT NULL) AS responses FROM resp"""
INCIDENTS = "inc AS (SELECT * FROM final WHERE total_risk > 50 OR action <> 'allow')"

# ---------------------------------------------------------------- rules, decoys, outcomes
HONEYPOT = f"""decoy AS (
  SELECT *, CASE WHEN endpoint = '/admin' THEN CASE WHEN method = 'POST' THEN 'LOGIN_ATTEMPT' ELSE 'PAGE_VIEW' END
    {' '.join(f'WHEN endpoint = {q(p)} THEN {q(n)}' for p, n in C.DECOY_TYPES)}
    WHEN regexp_matches(endpoint, '^/api/users/[0-9]+$') THEN 'DATA_ACCESS' ELSE 'ACCESS' END AS interaction_type
  FROM req WHERE {DECEPTIVE})"""
RULE_VALUES = ", ".join("(" + ", ".join(q(x) for x in r[:5]) + ")" for r in C.DEFAULT_RULES)
AUTO_VALUES = ", ".join(f"({q(f)}, {q(p)}, {q(s)})" for f, (p, s) in C.AUTO_PAYLOAD_RULES.items())
DEFAULT = f"defaults AS (SELECT * FROM (VALUES {RULE_VALUES}) v(rule_name, rule_type, pattern, action, severity))"
AUTO = f"""auto_kinds AS (SELECT * FROM (VALUES {AUTO_VALUES}) v(kind, pattern, severity)),
flagged AS (SELECT event_id, t_us, ip, unnest({flags_of('payload')}) AS kind FROM req WHERE payload <> '')"""
RULES = f"""auto AS (
  SELECT 'Auto_' || kind || '_' || day AS rule_name, 'PAYLOAD' AS rule_type, pattern, 'BLOCK' AS action, severity, t_us, event_id
  FROM (SELECT kind, t_us // {DAY_US} AS day, min(t_us) AS t_us, arg_min(event_id, t_us) AS event_id FROM flagged GROUP BY 1, 2)
  JOIN auto_kinds USING (kind)),
rules AS (SELECT rule_name, rule_type, pattern, action, severity, false AS auto_generated, 0::BIGINT AS created_us, NULL::BIGINT AS expires_us
  FROM defaults UNION ALL SELECT rule_name, rule_type, pattern, action, severity, true, t_us, t_us + {DAY_US} FROM auto)"""
RULE_HITS = f"""hit AS (
  SELECT r.*, d.rule_name, d.action, d.severity, d.pattern FROM req r JOIN rules d
  ON payload <> '' AND rule_type = 'PAYLOAD' AND d.created_us <= r.t_us AND (d.expires_us IS NULL OR r.t_us < d.expires_us)
    AND regexp_matches(lower(payload), '(?i)' || pattern))"""
SINCE = """changed AS (SELECT DISTINCT pattern, at_us, substr(md5(pattern), 1, 16) || '@' || at_us AS rule_set FROM (
  SELECT pattern, created_us AS at_us FROM rules WHERE rule_type = 'PAYLOAD'
  UNION ALL SELECT pattern, expires_us FROM rules WHERE rule_type = 'PAYLOAD' AND expires_us IS NOT NULL))"""
EFFECT = """eff AS (
  SELECT rule_name, count(*) FILTER (status_code <> 200) AS true_positives, count(*) FILTER (status_code = 200) AS false_positives,
    (count(*) FILTER (status_code <> 200) + 1)::DOUBLE / (count(*) + 2) AS effectiveness, max(t_us) AS last_us
  FROM hit GROUP BY rule_name)"""
OUTCOMES = f"outcome AS (SELECT *, {DECEPTIVE} AS is_attack FROM req)"


def blocks(days):
    return f"""ops AS (
  SELECT ip, t_us, event_id, event_type = 'error' AS is_block, CASE WHEN event_type = 'error' THEN t_us + {days * DAY_US} END AS expires_us
  FROM req WHERE k % 10 = 0 AND event_type IN ('error', 'signup')),
blocklist AS (SELECT * FROM (SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY ip ORDER BY t_us DESC, event_id DESC) = 1)
  WHERE is_block)"""


BEHAVIOR_RULES = f"""kinds AS (
  SELECT 'BRUTE_FORCE' AS kind, * FROM risk WHERE login_fails > 5
  UNION ALL SELECT 'BURST', * FROM risk WHERE burst OR acceleration > 5
  UNION ALL SELECT 'SCAN', * FROM risk WHERE scan OR n_paths > 12
  UNION ALL SELECT 'ENUM', * FROM risk WHERE enum),
made AS (
  SELECT kind, ip AS key, event_id, t_us, 'Auto_' || kind || '_' || substr(md5(kind || '_' || ip), 1, 8) AS rule_name,
    CASE WHEN kind IN ('BRUTE_FORCE', 'BURST') THEN 'RATE' ELSE 'ACCESS' END AS rule_type,
    CASE kind WHEN 'BRUTE_FORCE' THEN 'login:' || ip || ':max_3/min' WHEN 'BURST' THEN 'burst:' || ip || ':max_5/10s'
      WHEN 'SCAN' THEN '{{"blocked_ip":"' || ip || '"}}' ELSE '{{"blocked_ip":"' || ip || '","type":"enum"}}' END AS pattern,
    CASE WHEN kind = 'BURST' THEN 'THROTTLE' ELSE 'BLOCK' END AS action, CASE WHEN kind = 'BURST' THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
    t_us AS created_us, t_us + {DAY_US} AS expires_us
  FROM kinds WHERE score >= 50 QUALIFY row_number() OVER (PARTITION BY kind, ip ORDER BY t_us, event_id) = 1)"""

# ---------------------------------------------------------------- isolation forest
PRIME = 2_147_483_647


def mixed(a, b):
    z = f"((({a}) * 7919 + ({b}) * 104729 + 12345) % {PRIME})"
    z = f"(({z} * {z} + ({a})) % {PRIME})"
    return f"(({z} * {z} + ({b}) * 31 + 7) % {PRIME})"


def forest(name, train, rows, trees, dims, share, seed=42):
    """CTEs that draw, grow and walk the trees; name_scored has id, decision, and is_anomaly of the rows. train and rows
    are tables of id and x."""
    key = f"({seed * 1000} + t)::BIGINT"
    path = "CASE WHEN n > 2 THEN 2 * (ln(n - 1) + 0.5772156649015329e0) - 2 * (n - 1)::DOUBLE / n WHEN n = 2 THEN 1e0 ELSE 0e0 END"

    def ranges(src):
        each = lambda f: "[" + ", ".join(f"{f}(x[{i}]) OVER w" for i in range(1, dims + 1)) + "]"
        return f"""SELECT *, list_filter(range(1, {dims + 1}), lambda i: hi[i] > lo[i]) AS spread FROM (
          SELECT *, count(*) OVER w AS n, {each('min')} AS lo, {each('max')} AS hi FROM {src} WINDOW w AS (PARTITION BY t, node))"""

    split = f"n > 1 AND len(spread) > 0 AND level < (SELECT height FROM {name}_size)"
    cut = f"lo[f] + {mixed(key, '2 * node + 1')}::DOUBLE / {PRIME} * (hi[f] - lo[f])"
    pick = f"spread[1 + {mixed(key, '2 * node')} % len(spread)]"
    return f"""{name}_size AS (SELECT count(*) AS total, least(256, count(*)) AS n, greatest(1, ceil(log2(greatest(least(256, count(*)), 2))))::INT AS height FROM {train}),
{name}_drawn AS MATERIALIZED (SELECT t, id, x FROM (SELECT t, id, x, row_number() OVER (PARTITION BY t ORDER BY {mixed('b', key)}, id) AS rn
  FROM (SELECT id, x, ('0x' || substr(md5(id::VARCHAR), 1, 7))::BIGINT AS b FROM {train}), range({trees}) r(t)) WHERE rn <= (SELECT n FROM {name}_size)),
{name}_grown AS (
  SELECT t, 1::BIGINT AS node, 0 AS level, id, x FROM {name}_drawn
  UNION ALL
  SELECT t, 2 * node + (x[f] > {cut})::BIGINT, level + 1, id, x FROM (SELECT *, {pick} AS f FROM ({ranges(name + '_grown')}) WHERE {split})),
{name}_nodes AS MATERIALIZED (SELECT t, node, CASE WHEN {split} THEN f END AS f, CASE WHEN {split} THEN {cut} END AS cut, level + {path} AS depth
  FROM (SELECT *, CASE WHEN len(spread) > 0 THEN {pick} END AS f FROM (SELECT DISTINCT t, node, level, n, lo, hi, spread FROM ({ranges(name + '_grown')})))),
{name}_walked AS (
  SELECT id, t, 1::BIGINT AS node FROM {rows}, range({trees}) r(t)
  UNION ALL
  SELECT w.id, w.t, 2 * w.node + (r.x[n.f] > n.cut)::BIGINT FROM {name}_walked w JOIN {name}_nodes n ON n.t = w.t AND n.node = w.node AND n.f IS NOT NULL
  JOIN {rows} r ON r.id = w.id),
{name}_raw AS MATERIALIZED (SELECT id, {rnd(f"pow(2, -(sum(depth) / {trees}) / (SELECT {path} FROM {name}_size))")} AS score
  FROM {name}_walked JOIN {name}_nodes USING (t, node) WHERE f IS NULL GROUP BY id),
{name}_offset AS (SELECT min(s) AS cut FROM (SELECT s, sum(k) OVER (ORDER BY s) AS upto FROM (
    SELECT -score AS s, count(*) AS k FROM {name}_raw WHERE id IN (SELECT id FROM {train}) GROUP BY 1))
  WHERE upto >= ({share}) * (SELECT total FROM {name}_size)),
{name}_scored AS (SELECT id, -score - (SELECT cut FROM {name}_offset) AS decision, -score - (SELECT cut FROM {name}_offset) < 0 AS is_anomaly FROM {name}_raw)"""


TELEMETRY = f"""telemetry AS MATERIALIZED (SELECT event_id AS id, t_us, [{", ".join(rnd(x) for x in (
    "n50 / greatest((t_us - first_us) / 1e6 / 60, 1)", "diversity", "sens_ratio", "gap_sum::DOUBLE / 1e6 / greatest(n_gaps, 1)", "0e0",
    "failed_logins::DOUBLE / total", "burst_density::DOUBLE", "0e0"))}] AS x FROM scored)"""

# ---------------------------------------------------------------- vectors
DIMS = ["least(n, 200)", "burst::INT", "least(failure_rate, 1)", "least(streak, 20)", "least(n_paths, 50)", "least(sens, 10)",
        "scan::INT", "least(cur_flags, 5)", "least(n_agents, 10)", "least(acceleration, 20)", "enum::INT", "least(n_sess, 10)"]
CAPS = [200, 1, 1, 20, 50, 10, 1, 5, 10, 20, 1, 10]
X12 = "[" + ", ".join(f"({d})::DOUBLE" if i != 10 else "0e0" for i, d in enumerate(DIMS)) + "]"
EMBED = """lexed AS (
  SELECT payload, list_transform(counts, lambda c: c / greatest(list_max(counts), 1e0)) AS lex FROM (
    SELECT payload, list_transform(range(52), lambda b: len(list_filter(buckets, lambda x: x = b))::DOUBLE) AS counts FROM (
      SELECT payload, list_transform(range(1, length(payload)), lambda i:
        ('0x' || substr(md5(substr(lower(payload), i, 2)), 1, 7))::BIGINT %% 52) AS buckets
      FROM (SELECT DISTINCT payload FROM req)))),
joined AS (
  SELECT s.*, list_concat([%s], lex) AS v FROM scores s JOIN lexed USING (payload)),
embed AS (
  SELECT * EXCLUDE (v), list_transform(v, lambda x: x / (sqrt(list_sum(list_transform(v, lambda y: y * y))) + 1e-12)) AS vec
  FROM joined)""" % ", ".join(f"({d})::DOUBLE / {c}" for d, c in zip(DIMS, CAPS))
UNIT = """vecs AS (
  SELECT vec_id AS event_id, label, list_transform(e, lambda x: x / (sqrt(list_sum(list_transform(e, lambda y: y * y))) + 1e-12)) AS vec
  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings))"""
LATEST = f"""latest AS (
  SELECT ip, vec FROM embed WHERE t_us >= {NOW} - {LONG}
  QUALIFY row_number() OVER (PARTITION BY ip ORDER BY t_us DESC, event_id DESC) = 1)"""


def components(edges, nodes):
    """Smallest reachable id per node."""
    return f"""reach AS (
  SELECT id, id AS other FROM {nodes}
  UNION SELECT r.id, e.b FROM reach r JOIN {edges} e ON e.a = r.other),
comp AS (SELECT id, min(other) AS component FROM reach GROUP BY id)"""


# ---------------------------------------------------------------- mining over page urls
SHAPE = "regexp_replace(regexp_replace({0}, '[0-9]+', 'D', 'g'), '[a-zA-Z]+', 'A', 'g')"
def shapes_of(source):
    return f"""shapes AS (
  SELECT shape, count(*) AS weight, ('0x' || substr(md5(shape), 1, 15))::BIGINT AS id
  FROM (SELECT {SHAPE.format('url')} AS shape FROM {source}) GROUP BY shape HAVING length(shape) >= 3),
grams AS (
  SELECT id, g, count(*) AS n FROM (SELECT id, unnest(list_transform(range(1, length(shape) - 1), lambda i: substr(shape, i, 3))) AS g
  FROM shapes) GROUP BY id, g),
tf AS (SELECT id, g, n / sqrt(sum(n * n) OVER (PARTITION BY id)::DOUBLE) AS w FROM grams),
near AS (
  SELECT x.id AS a, y.id AS b FROM tf x JOIN tf y USING (g) GROUP BY x.id, y.id HAVING sum(x.w * y.w) >= 0.65e0 - 1e-9),
core AS (SELECT a AS id FROM near JOIN shapes s ON s.id = near.b GROUP BY a HAVING sum(weight) >= 4),
edges AS (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)),
{components('edges', 'core')},
assigned AS (
  SELECT s.id, s.shape, s.weight, c.component IS NOT NULL AS is_core,
    coalesce(c.component, (SELECT min(c2.component) FROM near JOIN comp c2 ON c2.id = near.b WHERE near.a = s.id)) AS cluster
  FROM shapes s LEFT JOIN comp c ON c.id = s.id),
sized AS (
  SELECT *, min(shape) OVER (PARTITION BY cluster) AS cluster_name, (sum(weight) OVER (PARTITION BY cluster))::BIGINT AS cluster_size
  FROM assigned WHERE cluster IS NOT NULL)"""


def cores_of(source):
    return f"""members AS (
  SELECT DISTINCT p.url, s.cluster, s.cluster_size FROM {source} p JOIN sized s ON s.shape = {SHAPE.format('p.url')}
  WHERE cluster_size >= 6),
seed AS (SELECT cluster, cluster_size, min_by(url, (length(url), url)) AS url, count(*) AS n FROM members GROUP BY ALL),
starts AS (SELECT cluster, url, unnest(range(1, length(url) + 1)) AS i FROM seed),
cut AS (SELECT DISTINCT cluster, substr(url, i, len) AS sub FROM (
  SELECT cluster, url, i, unnest(range(7, length(url) - i + 2)) AS len FROM starts)),
common AS (SELECT c.cluster, c.sub FROM cut c JOIN members m ON m.cluster = c.cluster AND contains(m.url, c.sub)
  GROUP BY c.cluster, c.sub HAVING count(*) = (SELECT any_value(n) FROM seed WHERE seed.cluster = c.cluster)),
mined AS (
  SELECT s.cluster, s.cluster_size, least(1e0, s.cluster_size / 20e0) AS confidence, min_by(c.sub, (-length(c.sub), c.sub)) AS core
  FROM seed s JOIN common c ON c.cluster = s.cluster GROUP BY ALL)"""


SHAPES, CORES = shapes_of("pages"), cores_of("pages")


EVOLVED = f"""evolved AS (
  SELECT 'Evolve_' || substr(md5(pattern), 1, 8) AS rule_name, 'PAYLOAD' AS rule_type, pattern,
    'BLOCK' AS action, CASE WHEN confidence > 0.8e0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 0.7e0 AS confidence,
    {NOW} AS created_us, {NOW} + {DAY_US} AS expires_us,
    'mined, sure to ' || printf('%.2f', confidence) || ', payloads ' || cluster_size AS description
  FROM (SELECT *, '.*' || regexp_replace(core, '([^A-Za-z0-9_])', '\\\\\\1', 'g') || '.*' AS pattern FROM mined)
  WHERE confidence > 0.6e0)"""


def rule_cols(src):
    return f"SELECT rule_name, rule_type, pattern, action, severity, true AS is_active, auto_generated FROM {src}"


def oracle_sql():
    """Query name -> SQL over the tables."""
    bm = memory("ip")
    posts = {
        "src_requests": with_req(f"""SELECT ip, endpoint AS path, method, user_agent, payload, length(payload)::BIGINT AS payload_size,
            {FAILED} AS is_failed_login, count(*) AS n, strftime(min(make_timestamp(t_us)), '%Y-%m-%d %H:%M:%S') AS first_ts
            FROM req GROUP BY ALL"""),
        "log_requests": with_req(f"""SELECT event_id, ip AS ip_address, user_agent, endpoint, method, status_code,
            substr(md5(payload), 1, 16) AS payload_hash, array_to_string({flags_of('payload')}, ',') AS payload_flags, t_us, session_id,
            {rnd('response_time_ms')} AS response_time_ms FROM req"""),
        "ingest_features": with_req("""SELECT ip AS key, t_us, n AS requests_in_window, fails::BIGINT AS failure_count, n_paths AS unique_endpoints,
            n_sess AS unique_sessions, all_flags::BIGINT AS total_flags_recent, failure_score FROM scores""", FEAT),
        "honeypot_log": with_req("""SELECT event_id, ip AS ip_address, endpoint, method, '{"User-Agent":"' || user_agent || '"}' AS headers, payload,
            user_agent, t_us, session_id, interaction_type FROM decoy""", HONEYPOT),
        "system_events": with_req(f"""
            SELECT event_id, 'PAYLOAD_ALERT' AS event_type, CASE WHEN list_contains(f, 'SQL_INJECTION') OR
              list_contains(f, 'COMMAND_INJECTION') THEN 'HIGH' ELSE 'MEDIUM' END AS severity, '' AS source_ip,
              'flags in payload: ' || array_to_string(f, ',') AS description, '{{}}' AS metadata, NULL::DOUBLE AS frequency, NULL::DOUBLE AS failure,
              NULL::DOUBLE AS pattern, NULL::DOUBLE AS payload, t_us
            FROM (SELECT *, {flags_of('payload')} AS f FROM req) WHERE len(f) > 0
            UNION ALL SELECT event_id, 'HONEYPOT_INTERACTION', 'HIGH', ip, 'decoy hit ' || method || ' ' || endpoint,
              '{{"user_agent":"' || user_agent || '","type":"' || interaction_type || '"}}', NULL, NULL, NULL, NULL, t_us FROM decoy
            UNION ALL SELECT event_id, 'RISK_ESCALATION', CASE risk_level WHEN 'MALICIOUS' THEN 'HIGH' ELSE 'WARNING' END, ip,
              risk_level || ' at score ' || printf('%.1f', score), NULL, {rnd('boosted_freq')}, {rnd('failure_score')}, {rnd('pattern_score')},
              {rnd('payload_score')}, t_us FROM risk WHERE score > 60
            UNION ALL SELECT event_id, 'SELF_HEALING', 'HIGH', key, 'rules made: ' || count(*), '{{}}', NULL, NULL, NULL, NULL, t_us
              FROM made GROUP BY event_id, key, t_us
            UNION ALL SELECT -1, 'GEN_RULE_INJECTED', severity, '', 'mined rule added: ' || rule_name,
              '{{"pattern":' || to_json(pattern)::VARCHAR || ',"desc":' || to_json(description)::VARCHAR || '}}', NULL, NULL, NULL, NULL, {NOW} FROM evolved""",
                                  *TO_RISK, BEHAVIOR_RULES, HONEYPOT, SHAPES, CORES, EVOLVED),
        "upsert_profiles": with_req("""SELECT ip, max(t_us) AS t_us, arg_max(event_id, t_us) AS event_id,
            arg_max(endpoint, t_us) AS endpoint, arg_max(status_code, t_us) AS status_code, min(t_us) AS created_us FROM req GROUP BY ip"""),
        "blocklist_ops": with_req("SELECT ip, t_us, event_id, expires_us FROM blocklist", blocks(1)),
        "seed_rules": with_req(rule_cols("rules"), DEFAULT, AUTO, RULES),
        "log_scan": with_req("""SELECT CASE WHEN status_code = 200 THEN 'ALLOW' ELSE 'BLOCK' END AS decision, endpoint AS path,
            count(*) AS n, count(*) FILTER (k % 3 = 1) AS scored FROM req WHERE k % 3 < 2 GROUP BY ALL
            UNION ALL SELECT 'OTHER', '', count(*), 0 FROM req WHERE k % 3 = 2"""),
        "risk_lookup": with_req(f"""SELECT k.key, {rnd('coalesce(score, 0)')} AS score, coalesce(risk_level, 'NORMAL') AS risk_level
            FROM (SELECT DISTINCT ip || CASE WHEN user_id % 2 = 0 THEN '' ELSE '-unseen' END AS key FROM req) k
            LEFT JOIN last_risk ON ip = k.key""", *TO_RISK),
        "recent_requests": with_req(f"""SELECT event_id, ip, t_us, endpoint, method, status_code FROM req
            WHERE t_us > {NOW} - {SHORT} AND ip = (SELECT ip FROM req GROUP BY ip ORDER BY count(*) DESC, ip LIMIT 1)"""),
        "active_blocks": with_req(f"SELECT ip, t_us, expires_us FROM blocklist WHERE expires_us > {NOW}", blocks(5)),
        "is_blocked": with_req(f"""SELECT i.ip, coalesce({NOW} <= expires_us, false) AS is_blocked
            FROM (SELECT DISTINCT ip FROM req) i LEFT JOIN blocklist b ON b.ip = i.ip""", blocks(5)),
        "active_rules": with_req(rule_cols("rules"), DEFAULT, AUTO, RULES),
        "expire_rules": with_req(f"""SELECT rule_name, CASE WHEN expires_us < {NOW} THEN 'expired' ELSE 'live' END AS state
            FROM rules""", DEFAULT, AUTO, RULES),
        "failed_login": with_req(f"SELECT event_id, ip, t_us FROM req WHERE {FAILED}"),
        "deceptive_hits": with_req(f"SELECT event_id, ip, endpoint, method FROM req WHERE {DECEPTIVE}"),
        "events_by_type": with_req("""SELECT event_id, 'HONEYPOT_INTERACTION' AS event_type, 'HIGH' AS severity,
            'decoy hit ' || method || ' ' || endpoint AS description, t_us FROM decoy
            ORDER BY t_us DESC, event_id DESC LIMIT 200""", HONEYPOT),
        "rule_performance": with_req(f"""SELECT rule_name, true_positives, false_positives, {rnd('effectiveness')} AS effectiveness
            FROM eff""", DEFAULT, AUTO, RULES, RULE_HITS, EFFECT),
        "asof_blocks": with_req("""SELECT r.event_id, r.ip, r.t_us, CASE WHEN o.is_block THEN o.t_us END AS blocked_us,
            CASE WHEN o.is_block THEN o.expires_us END AS expires_us, coalesce(o.is_block AND r.t_us <= o.expires_us, false) AS is_blocked
            FROM req r ASOF LEFT JOIN ops o ON r.ip = o.ip AND r.t_us > o.t_us""", blocks(1)),
        "rule_match": with_req("""SELECT event_id, coalesce(sum(n), 0)::BIGINT AS n_rules, coalesce(bool_or(blocks), false) AS blocked,
            coalesce(string_agg(rule_set, ',' ORDER BY rule_set), '') AS rule_sets
            FROM (SELECT * FROM req WHERE payload <> '') r LEFT JOIN (SELECT h.event_id, n, blocks, x.rule_set FROM (
              SELECT event_id, t_us, pattern, count(*) AS n, bool_or(action = 'BLOCK') AS blocks FROM hit GROUP BY ALL) h
              ASOF JOIN changed x ON x.pattern = h.pattern AND h.t_us >= x.at_us) USING (event_id) GROUP BY event_id""", DEFAULT, AUTO, RULES, RULE_HITS, SINCE),
        "rule_sets": with_req("""SELECT rule_set, at_us AS since_us, rule_name, action, severity FROM changed x JOIN rules d
            ON d.pattern = x.pattern AND d.rule_type = 'PAYLOAD' AND d.created_us <= x.at_us AND (d.expires_us IS NULL OR x.at_us < d.expires_us)""",
                              DEFAULT, AUTO, RULES, SINCE),
        "evolution_multipliers": with_req(f"""SELECT event_id, {rnd('path_mult')} AS path_mult, {rnd('fingerprint_mult')} AS
            fingerprint_mult, {rnd('signature_mult')} AS signature_mult FROM adjusted""", *TO_FIRST, MULT),
        "dashboard_stats": with_req(f"""SELECT
            (SELECT count(*) FROM req WHERE t_us > {NOW} - 3600000000) AS total_requests_1h,
            (SELECT count(DISTINCT ip) FROM req WHERE t_us > {NOW} - 3600000000) AS unique_ips_1h,
            (SELECT count(*) FROM blocklist WHERE expires_us > {NOW}) AS blocked_ips, (SELECT count(*) FROM rules) AS active_rules,
            (SELECT count(*) FROM rules WHERE auto_generated) AS auto_rules,
            (SELECT count(*) FROM decoy WHERE t_us > {NOW} - 3600000000) AS decoy_hits_1h,
            (SELECT count(*) FROM last_risk WHERE score > 60) AS high_risk_ips,
            (SELECT arg_max(k % 5, t_us) FROM req WHERE event_type = 'error') AS defense_level,
            (SELECT 60 - arg_max(k % 5, t_us) * 10 FROM req WHERE event_type = 'error') AS rate_limit""",
                                    *TO_RISK, blocks(5), DEFAULT, AUTO, RULES, HONEYPOT),
        "attacker_profiles": with_req("""SELECT ip AS ip_address, count(*) AS interactions,
            count(DISTINCT endpoint) AS endpoints, count(DISTINCT method) AS methods, count(DISTINCT interaction_type) AS types,
            min(t_us) AS first_us, max(t_us) AS last_us, count(*) FILTER (payload <> '') AS payloads FROM decoy GROUP BY ip""", HONEYPOT),
        "attacker_members": with_req("""SELECT DISTINCT ip AS ip_address, 'endpoint' AS kind, endpoint AS member FROM decoy
            UNION SELECT ip, 'method', method FROM decoy UNION SELECT ip, 'type', interaction_type FROM decoy""", HONEYPOT),
        "honeypot_summary": with_req("""
            SELECT 'total' AS section, 1::BIGINT AS rank, 'interactions' AS item, count(*) AS n FROM newest
            UNION ALL SELECT 'total', 2, 'attackers', count(DISTINCT ip) FROM newest
            UNION ALL SELECT * FROM (SELECT 'endpoint', row_number() OVER (ORDER BY count(*) DESC, endpoint) AS r, endpoint, count(*)
              FROM newest GROUP BY endpoint) WHERE r <= 5
            UNION ALL SELECT * FROM (SELECT 'ip', row_number() OVER (ORDER BY count(*) DESC, ip) AS r, ip, count(*)
              FROM newest GROUP BY ip) WHERE r <= 5
            UNION ALL SELECT * FROM (SELECT 'recent', row_number() OVER (ORDER BY t_us DESC, event_id DESC) AS r,
              method || ' ' || endpoint || ' ' || ip, event_id FROM newest) WHERE r <= 10""", HONEYPOT,
                                     "newest AS (SELECT * FROM decoy)"),
        "forensic_reports": with_req(f"""
            SELECT fingerprint, min(t_us) AS first_us, max(t_us) AS last_us, count(*) AS incidents, count(DISTINCT ip) AS n_ips,
              count(DISTINCT endpoint) AS n_endpoints, count(DISTINCT CASE WHEN payload NOT IN ('', '{{}}') THEN payload END)
              AS n_payloads, count(*) FILTER (deception > 0) AS deception_hits, sha256(fingerprint) AS report_id,
              CASE WHEN bool_or(action IN ('block', 'quarantine')) THEN 'MALICIOUS'
                WHEN count(*) FILTER (deception > 0) > 2 THEN 'PROBING_ATTACKER' ELSE 'SUSPICIOUS' END AS classification,
              array_to_string(list_filter([{', '.join(f"CASE WHEN count(*) FILTER (action = {q(a)}) > 0 THEN {q(a)} || ':' || count(*) FILTER (action = {q(a)}) END" for a in ["allow", "block", "throttle", "quarantine", "shadow_monitor", "deception_flag"])}],
                lambda x: x IS NOT NULL), ',') AS response_actions,
              least(count(*), 10) AS trend_n, {rnd('arg_max(anomaly, (t_us, event_id))')} AS trend_last,
              {rnd('sum(anomaly) FILTER (newest <= 10)')} AS trend_sum
            FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY t_us DESC, event_id DESC) AS newest FROM inc)
            GROUP BY fingerprint""", *TO_FINAL, INCIDENTS),
        "forensic_members": with_req("""SELECT DISTINCT fingerprint, 'ip' AS kind, ip AS member FROM inc
            UNION SELECT fingerprint, 'endpoint', endpoint FROM inc
            UNION SELECT fingerprint, 'payload', payload FROM inc WHERE payload NOT IN ('', '{}')""",
                                     *TO_FINAL, INCIDENTS),
        "live_dashboard": with_req(f"""
            SELECT 'action' AS section, 0::BIGINT AS rank, action AS item, count(*)::DOUBLE AS value FROM final GROUP BY action
            UNION ALL SELECT 'total', 0, 'requests', count(*) FROM final
            UNION ALL SELECT 'status', 0, CASE WHEN count(*) > 0 THEN 'ONLINE' ELSE 'IDLE' END, count(*) FROM final
            UNION ALL SELECT 'threat', 0, CASE WHEN m > 60 THEN 'HIGH' WHEN m > 30 THEN 'ELEVATED' ELSE 'NORMAL' END, {rnd('m')}
              FROM (SELECT avg(total_risk) AS m FROM (SELECT total_risk FROM final ORDER BY t_us DESC, event_id DESC LIMIT 5))
            UNION ALL SELECT 'fingerprints', 0, 'known', count(DISTINCT fingerprint) FROM final
            UNION ALL SELECT * FROM (SELECT 'endpoint', row_number() OVER (ORDER BY count(*) DESC, endpoint) AS r, endpoint, count(*)
              FROM final WHERE total_risk > 50 GROUP BY endpoint) WHERE r <= 5
            UNION ALL SELECT * FROM (SELECT 'payload', row_number() OVER (ORDER BY count(*) DESC, p) AS r, p, count(*)
              FROM (SELECT DISTINCT fingerprint, payload AS p FROM inc WHERE payload NOT IN ('', '{{}}')) GROUP BY p)
              WHERE r <= 5""", *TO_FINAL, INCIDENTS),
        "behavior_profile": with_req(f"""
            SELECT ip, count(*) AS total_requests, count(*) FILTER (status_code IN (401, 403, 422)) AS failed_logins,
              count(DISTINCT endpoint) AS unique_endpoints, count(DISTINCT nullif(session_id, '')) AS session_count, max(t_us) AS last_us,
              {rnd('CASE WHEN count(*) > 1 THEN (max(t_us) - min(t_us)) / 1e6 / (count(*) - 1) ELSE 0 END')} AS avg_request_interval,
              (SELECT string_agg(h || ':' || n, ',' ORDER BY h) FROM (SELECT lpad(((t_us // 3600000000) % 24)::VARCHAR, 2, '0') AS h,
                count(*) AS n FROM req x WHERE x.ip = req.ip AND t_us > {NOW} - {SHORT} GROUP BY 1)) AS hourly_distribution
            FROM req WHERE t_us > {NOW} - {SHORT} GROUP BY ip"""),
        "feature_rollup": with_req(f"""
            SELECT ip, t_us // {DAY_US} * {DAY_US} AS window_us, count(*) AS requests,
              count(*) FILTER (status_code IN (401, 403, 422)) AS failures,
              count(*) FILTER (status_code IN (401, 403, 422) AND {has_any('endpoint', C.LOGIN_MARKERS)}) AS login_failures,
              count(*) FILTER (endpoint IN {inlist(C.SENSITIVE_ENDPOINTS)}) AS sensitive_hits,
              count(*) FILTER (method IN {inlist(C.UNUSUAL_METHODS)}) AS unusual_methods,
              sum(len({flags_of('payload')}))::BIGINT AS payload_flags, count(DISTINCT endpoint) AS unique_endpoints,
              count(DISTINCT nullif(session_id, '')) AS unique_sessions, count(DISTINCT nullif(user_agent, '')) AS unique_user_agents,
              min(t_us) AS first_us, max(t_us) AS last_us FROM req GROUP BY 1, 2"""),
        "behavior_endpoints": with_req(f"SELECT DISTINCT ip, endpoint FROM req WHERE t_us > {NOW} - {SHORT}"),
        "profile_summary": with_req(f"""SELECT ip, count(*) AS requests, count(DISTINCT endpoint) AS unique_endpoints,
            {rnd("count(*) FILTER (status_code IN (401, 403)) / count(*)::DOUBLE")} AS failure_rate,
            count(DISTINCT user_agent) AS n_user_agents FROM req WHERE t_us > {NOW} - {SHORT} GROUP BY ip"""),
        "profile_agents": with_req(f"SELECT DISTINCT ip, user_agent FROM req WHERE t_us > {NOW} - {SHORT}"),
        "rule_effectiveness": with_req(f"""SELECT rule_name, true_positives, false_positives, {rnd('effectiveness')} AS effectiveness,
            last_us FROM eff""", DEFAULT, AUTO, RULES, RULE_HITS, EFFECT),
        "signature_confidence": with_req(f"""SELECT signature, max(rn) AS changes, {rnd('arg_max(conf, rn)')} AS confidence FROM walk
            GROUP BY signature""", """delta AS (SELECT md5(payload) AS signature, CASE WHEN status_code = 200 THEN -0.07e0 ELSE 0.05e0 END AS d,
            row_number() OVER (PARTITION BY payload ORDER BY t_us, event_id) AS rn FROM req WHERE payload <> '')""",
                                         """walk AS (SELECT signature, rn, greatest(0e0, least(1e0, 0.5e0 + d)) AS conf FROM delta WHERE rn = 1
            UNION ALL SELECT d.signature, d.rn, greatest(0e0, least(1e0, w.conf + d.d)) FROM walk w JOIN delta d
            ON d.signature = w.signature AND d.rn = w.rn + 1)"""),
        "attack_signatures": with_req(f"""SELECT sha256(payload) AS signature, min(array_to_string(f, '+')) AS attack_type,
            min(t_us) AS first_us, max(t_us) AS last_us, count(*) AS occurrences, count(DISTINCT ip) AS n_sources,
            CASE WHEN bool_or(list_contains(f, 'SQL_INJECTION') OR list_contains(f, 'COMMAND_INJECTION')) THEN 'HIGH' ELSE 'MEDIUM' END
            AS severity FROM (SELECT *, {flags_of('payload')} AS f FROM req) WHERE len(f) > 0 GROUP BY payload"""),
        "signature_sources": with_req(f"""SELECT DISTINCT sha256(payload) AS signature, ip AS source_ip FROM req
            WHERE len({flags_of('payload')}) > 0"""),
        "healing_status": with_req("""SELECT 'total' AS section, 'auto_rules' AS item, count(*) AS n FROM auto
            UNION ALL SELECT 'rule', rule_name, 1 FROM auto
            UNION ALL SELECT * FROM (SELECT 'recent', rule_name, event_id FROM auto ORDER BY t_us DESC, event_id DESC, rule_name DESC LIMIT 10)
            """, DEFAULT, AUTO, RULES),
        "healing_state": with_req(f"""
            SELECT what, item, until_us, n FROM (
              SELECT 'locked_route' AS what, endpoint AS item, arg_max(until_us, t_us) AS until_us, count(*) AS n FROM resp WHERE lck GROUP BY endpoint
              UNION ALL SELECT 'throttled', fingerprint, arg_max(throttle_until_us, t_us), count(*) FROM resp WHERE thr GROUP BY fingerprint)
            WHERE until_us > {NOW}
            UNION ALL SELECT * FROM (SELECT 'sanitize_mode', '', arg_max(until_us, t_us) AS u, count(*) FROM resp WHERE san) WHERE u >= {NOW}
            UNION ALL SELECT * FROM (SELECT 'deception_mode', '', arg_max(until_us, t_us) AS u, count(*) FROM resp WHERE rot) WHERE u >= {NOW}
            UNION ALL SELECT 'quarantined', fingerprint, NULL, count(*) FROM resp WHERE qua GROUP BY fingerprint
            UNION ALL SELECT 'secret_version', '', NULL, 1 + count(*) FROM resp WHERE rot""", *TO_FINAL, RESPONSES),
        "feat_frequency": with_req(f"""SELECT event_id, n AS requests_in_window, {rnd('avg_interval')} AS avg_interval, burst AS burst_detected,
            {rnd('acceleration')} AS acceleration, {rnd('freq_score')} AS freq_score, {rnd(
                'CASE WHEN n < 2 THEN 0 ELSE ' + rnd('list_min(list_transform(range(1, len(times)), lambda i: times[i + 1] - times[i])) / 1e6', 3) + ' END')}
            AS min_interval FROM scores""", FEAT),
        "feat_failure": with_req(f"""SELECT event_id, fails::BIGINT AS failure_count, {rnd('failure_rate')} AS failure_rate,
            streak::BIGINT AS consecutive_failures, login_fails::BIGINT AS login_failures, failure_score FROM scores""", FEAT),
        "feat_pattern": with_req("""SELECT event_id, n_paths AS unique_endpoints, sens::BIGINT AS sensitive_hits, scan AS scan_pattern,
            enum AS enumeration_detected, unus::BIGINT AS unusual_methods, pattern_score FROM scores""", FEAT),
        "feat_payload": with_req("""SELECT event_id, cur_flags::BIGINT AS current_flags, all_flags::BIGINT AS total_flags_recent,
            c0::BIGINT AS flags_sql_injection, c1::BIGINT AS flags_xss, c2::BIGINT AS flags_path_traversal,
            c3::BIGINT AS flags_command_injection, payload_score FROM scores""", FEAT),
        "feat_session": with_req("""SELECT event_id, n_sess AS unique_sessions, n_agents AS unique_user_agents, bot AS bot_indicators,
            session_score FROM scores""", FEAT),
        "feat_baseline": with_req(f"""SELECT event_id, n_long AS requests_long, has_baseline, {rnd('rate_deviation')} AS rate_deviation,
            baseline_score FROM scores""", FEAT),
        "enumeration": with_req(f"""SELECT event_id, len(list_filter(numbers, lambda v: list_contains(numbers, v + 1))) >= 3
            AS enumeration_detected FROM (SELECT event_id, list_distinct(list(num) OVER (ORDER BY t_us RANGE BETWEEN {SHORT - 1} PRECEDING
              AND CURRENT ROW)) AS numbers FROM (SELECT *, nullif(regexp_extract(endpoint, '/([0-9]+)', 1), '')::BIGINT AS num FROM req))"""),
        "behavior_memory": with_req("""SELECT event_id, identity, total AS total_requests, sens::BIGINT AS sensitive_hits,
            failed_logins::BIGINT AS failed_logins, agents AS unique_agents, n50 AS n_recent, diversity AS endpoint_diversity,
            burst_density, n_gaps, CASE WHEN n_gaps > 0 THEN gap_sum END AS gap_sum_us, first_us FROM scored""", SIG, memory("fingerprint")),
        "behavior_memory_ip": with_req(f"""SELECT event_id, total AS total_requests, sens::BIGINT AS sensitive_hits,
            failed_logins::BIGINT AS failed_logins, agents AS unique_agents, diversity AS endpoint_diversity, burst_density, n_gaps,
            {rnd('deviation')} AS deviation, {rnd('deception')} AS deception FROM scored""", SIG, bm),
        "behavior_deviation": with_req(f"SELECT event_id, {rnd('deviation')} AS deviation FROM scored", SIG, memory("fingerprint")),
        "fingerprints": with_req(f"""SELECT event_id, t_us, fingerprint, ips_seen, {rnd(
            'CASE WHEN ips_seen > 1 THEN least(1e0, 0.5e0 + ips_seen * 0.1e0) ELSE 0.5e0 END')} AS confidence
            FROM (SELECT *, count(DISTINCT ip) OVER (PARTITION BY fingerprint ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) AS ips_seen
            FROM (SELECT *, {FP} AS fingerprint FROM req))"""),
        "repeat_offender": with_req(f"SELECT event_id, {rnd('repeat')} AS repeat FROM adjusted", *TO_FIRST, MULT),
        "deception_intent": with_req(f"""SELECT event_id, hit, repeats::BIGINT AS repeats, posts::BIGINT AS fake_posts,
            {rnd('deception')} AS deception FROM scored""", SIG, memory("fingerprint")),
        "ml_telemetry": with_req(f"""SELECT event_id, {rnd('n50 / greatest((t_us - first_us) / 1e6 / 60, 1)')} AS requests_per_minute,
            diversity AS endpoint_diversity, {rnd('sens_ratio')} AS sensitive_route_ratio,
            {rnd('gap_sum::DOUBLE / 1e6 / greatest(n_gaps, 1)')} AS avg_interval, 0e0 AS payload_entropy,
            {rnd('failed_logins::DOUBLE / total')} AS failed_auth_ratio, burst_density::DOUBLE AS probe_density, 0e0 AS header_rarity
            FROM scored""", SIG, memory("fingerprint")),
        "recent_history": with_req(f"""
            SELECT * FROM (SELECT 'event' AS kind, event_id, t_us, upper(action) AS item, {rnd('total_risk')} AS value FROM final ORDER BY t_us DESC, event_id DESC LIMIT 100)
            UNION ALL SELECT * FROM (SELECT 'decoy', event_id, t_us, endpoint, {rnd('total_risk')} FROM final WHERE action = 'deception_flag'
              ORDER BY t_us DESC, event_id DESC LIMIT 50)
            UNION ALL SELECT * FROM (SELECT 'risk', event_id, t_us, '', {rnd('total_risk')} FROM final ORDER BY t_us DESC, event_id DESC LIMIT 50)
            UNION ALL SELECT * FROM (SELECT 'healing', event_id, t_us, responses[place], 0e0 FROM (SELECT event_id, t_us, responses,
                unnest(range(1, len(responses) + 1)) AS place FROM ({RESPONDED})) ORDER BY t_us DESC, event_id DESC, place DESC LIMIT 100)""",
                                   *TO_FINAL, RESPONSES),
        "latest_n": with_req("""SELECT event_id, ip AS ip_address, interaction_type, t_us FROM decoy
            ORDER BY t_us DESC, event_id DESC LIMIT 100""", HONEYPOT),
        "risk_ranking": with_req(f"SELECT ip AS key, {rnd('score')} AS score, risk_level FROM last_risk", *TO_RISK),
        "top_k": with_req("SELECT endpoint AS item, count(*) AS n FROM req GROUP BY 1 ORDER BY n DESC, item LIMIT 5"),
        "blocked_sets": with_req("""SELECT DISTINCT 'blocked_ip' AS kind, ip AS member FROM final WHERE action = 'block'
            UNION SELECT 'quarantined', fingerprint FROM final WHERE action = 'quarantine'""", *TO_FINAL),
        "pool_diversity": with_req(f"""SELECT ip, count(*) AS n, count(DISTINCT payload) AS n_distinct,
            {rnd('count(DISTINCT payload) / count(*)::DOUBLE')} AS share, count(*) >= 5 AND count(DISTINCT payload) / count(*)::DOUBLE > 0.4e0
            AS diverse FROM req WHERE length(payload) > 10 GROUP BY ip"""),
        "signature_match": with_req(f"""SELECT src, event_id, array_to_string(matched, ',') AS matched, {SIG_SCORE} AS signature_score FROM (
            SELECT *, {present([f"CASE WHEN {matches('target', p)} THEN {q(n)} END" for n, (_, p) in C.SIGNATURES.items()])} AS matched FROM (
              SELECT 'request' AS src, event_id, payload || ' ' || user_agent || ' ' || endpoint AS target FROM req
              UNION ALL SELECT 'page', page_id, html || '  ' || url FROM pages
              UNION ALL SELECT 'document', doc_id, text || '  ' FROM documents))"""),
        "payload_flags": with_req(f"""SELECT src, event_id, array_to_string({flags_of('payload')}, ',') AS flags FROM (
              SELECT 'request' AS src, event_id, payload FROM req WHERE payload <> ''
              UNION ALL SELECT 'chat', conv_id * 1000 + turn, text FROM conversations
              UNION ALL SELECT 'document', doc_id, text FROM documents)"""),
        "struct_fingerprint": f"SELECT doc_id AS event_id, {SHAPE.format('text')} AS shape FROM documents",
        "trigram_tf": f"""WITH g AS (SELECT id, gram, count(*) AS n FROM (SELECT id, unnest(list_transform(
            range(1, length(s) - 1), lambda i: substr(s, i, 3))) AS gram FROM (SELECT 'page ' || page_id AS id, {SHAPE.format('url')} AS s FROM pages
            UNION ALL SELECT 'document ' || doc_id, {SHAPE.format('text')} FROM documents))
            GROUP BY ALL) SELECT id, gram, n, {rnd('n / sqrt(sum(n * n) OVER (PARTITION BY id)::DOUBLE)')} AS weight FROM g""",
        "json_props": """SELECT event_id, k, NULL::VARCHAR AS extra, '{"k":' || k || '}' AS again, true AS bad_is_null
            FROM (SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events)""",
        "lr_calibration": f"""SELECT event_id, {rnd('greatest(0.05e0, 1 / (1 + exp(-8 * (k / 100e0 - 0.5e0))) / 0.5e0)')} AS ratio
            FROM (SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS k FROM events)""",
        "raw_risk": with_req(f"""SELECT event_id, {rnd('boosted_freq')} AS boosted_freq, elevated_signals, {rnd('raw')} AS raw
            FROM risks""", FEAT, RAW),
        "decayed_risk": with_req(f"""SELECT event_id, {rnd('raw')} AS raw, {rnd('score')} AS score, risk_level FROM risk""", *TO_RISK),
        "risk_level": with_req(f"""SELECT ip AS key, {rnd('score')} AS score, risk_level, {rnd('floor(left_over * 10 + 0.5e0) / 10')}
            AS current_score, {LEVEL.format('left_over')} AS current_level FROM (SELECT *, score * exp(-1e-6 *
            (({NOW} + 100000000 - t_us) / 1e6)) AS left_over FROM last_risk) WHERE left_over >= 1""", *TO_RISK),
        "decay_all": with_req(f"SELECT ip AS key, {rnd('score * pow(0.9e0, 3)')} AS score FROM last_risk", *TO_RISK),
        "adaptive_decision": with_req(f"SELECT event_id, {rnd('total_risk')} AS total_risk, action FROM first", *TO_FIRST),
        "adaptive_decision_ip": with_req(f"SELECT event_id, {rnd('total_risk')} AS total_risk, action FROM first", SIG, bm, FIRST),
        "feedback_decision": with_req(f"""SELECT event_id, {rnd('adj_deviation')} AS adj_deviation, {rnd('adj_anomaly')} AS adj_anomaly,
            {rnd('adj_signature')} AS adj_signature, {rnd('adj_deception')} AS adj_deception, {rnd('total_risk')} AS total_risk, action,
            CASE WHEN adj_signature > 90 THEN 'signature over 90' WHEN adj_deception > 80 THEN 'deception over 80'
              WHEN total_risk > 85 THEN 'total over 85: ' || printf('%.1f', total_risk)
              WHEN total_risk > 70 THEN 'total over 70: ' || printf('%.1f', total_risk)
              WHEN total_risk > 50 THEN 'total over 50: ' || printf('%.1f', total_risk)
              WHEN action = 'shadow_monitor' THEN 'anomaly or deviation alone'
              ELSE 'nothing over a limit' END AS reason FROM final""", *TO_FINAL),
        "decision_summary": with_req(f"""SELECT action, count(*) AS requests, {rnd('avg(total_risk)')} AS mean_risk FROM first
            GROUP BY action""", *TO_FIRST),
        "iforest_score": with_req(f"""SELECT id AS event_id, {rnd('decision')} AS decision, {rnd('1 / (1 + exp(5 * decision))')} AS anomaly,
            CASE WHEN is_anomaly THEN 'ANOMALY' ELSE 'NORMAL' END AS label FROM f_scored""", SIG, bm, TELEMETRY,
                                  forest("f", "telemetry", "telemetry", C.FOREST_TREES, 8, f"{C.FOREST_CONTAMINATION}e0")),
        "iforest_labeled": with_req(f"""SELECT id AS event_id, {rnd('decision')} AS decision, {rnd('1 / (1 + exp(10 * decision - 1.2e0))')} AS anomaly,
            is_anomaly FROM f_scored""", FEAT, OUTCOMES,
                                    f"""twelve AS MATERIALIZED (SELECT event_id AS id, t_us, list_transform({X12}, lambda v: {rnd('v')}) AS x, is_attack
            FROM scores JOIN (SELECT event_id, is_attack FROM outcome) USING (event_id))""",
                                    f"""chosen AS MATERIALIZED (SELECT * FROM (SELECT * FROM twelve WHERE NOT is_attack ORDER BY t_us DESC, id DESC LIMIT {C.LABELLED_NORMALS})
            UNION ALL SELECT * FROM (SELECT * FROM twelve WHERE is_attack ORDER BY t_us DESC, id DESC LIMIT {C.LABELLED_ATTACKS}))""",
                                    forest("f", "chosen", "twelve", C.LABELLED_TREES, 12, """SELECT greatest(0.01e0, least(0.3e0,
            count(*) FILTER (is_attack) / (count(*) + 1e-9))) FROM chosen""")),
        "adaptive_decision_forest": with_req(f"SELECT event_id, {rnd('total_risk')} AS total_risk, action FROM first", SIG, bm, TELEMETRY,
                                             "middle AS (SELECT (min(t_us) + max(t_us)) // 2 AS mid_us FROM telemetry)",
                                             f"""trained AS MATERIALIZED (SELECT * FROM telemetry WHERE t_us <= (SELECT mid_us FROM middle)
            ORDER BY t_us DESC, id DESC LIMIT {C.TELEMETRY_ROWS})""",
                                             "later AS MATERIALIZED (SELECT * FROM telemetry WHERE t_us > (SELECT mid_us FROM middle) UNION ALL SELECT * FROM trained)",
                                             forest("f", "trained", "later", C.FOREST_TREES, 8, f"{C.FOREST_CONTAMINATION}e0"),
                                             f"""warm AS (SELECT s.* REPLACE (coalesce(CASE WHEN t_us > (SELECT mid_us FROM middle)
            AND (SELECT count(*) FROM trained) >= {C.FOREST_MIN_ROWS} THEN 1 / (1 + exp(5 * decision)) END, anomaly) AS anomaly)
            FROM scored s LEFT JOIN f_scored f ON f.id = s.event_id)""",
                                             decide("first", "warm", "deviation", "anomaly", "0e0", "signature_score", "deception")),
        "anomaly_heuristic": with_req(f"""SELECT m.event_id, {rnd('anomaly')} AS anomaly, CASE WHEN anomaly > 0.6e0 THEN 'ANOMALY' ELSE
            'NORMAL' END AS label, {rnd('''least(1e0, 0.3e0 * (f.n > 50)::INT + 0.2e0 * f.burst::INT + 0.25e0 * (f.failure_rate > 0.7e0)::INT
            + 0.2e0 * f.scan::INT + 0.2e0 * (f.cur_flags > 2)::INT)''')} AS feature_anomaly
            FROM scored m JOIN scores f ON f.event_id = m.event_id""", SIG, bm, FEAT),
        "bayes_fusion": with_req(f"""SELECT event_id, {rnd('ml')} AS ml, {rnd('memory_sim', 3)} AS memory_sim,
            {rnd('correlation', 3)} AS correlation, {rnd('risk')} AS risk, {rnd('prior')} AS prior, trusted,
            {rnd('posterior', 3)} AS posterior,
            CASE WHEN safe THEN 'PASS' WHEN posterior >= 0.98e0 THEN 'BLOCK' WHEN posterior >= 0.88e0 THEN 'THROTTLE_AND_CHALLENGE'
              WHEN posterior >= 0.75e0 THEN 'DIVERT_TO_HONEYPOT' WHEN posterior >= 0.55e0 THEN 'ELEVATE_LOGGING' ELSE 'PASS' END AS fused_action
            FROM (SELECT *, trusted AND risk < 90 AS safe, CASE WHEN trusted AND risk < 90 THEN 0.01e0 ELSE
              1 / (1 + exp(-greatest(-20e0, least(20e0, ln(prior / (1 - prior)) + 12 * (ml - 0.55e0)
              + CASE WHEN memory_sim > 0.3e0 THEN -6 * ln(1.0001e0 - memory_sim) - 3 ELSE 0 END
              + CASE WHEN correlation > 0.4e0 THEN -5 * ln(1.0001e0 - correlation) - 2.5e0 ELSE 0 END
              + 6 * (risk / 100 - 0.65e0))))) END AS posterior FROM evidence)""", *TO_RISK, EMBED, OUTCOMES,
                                 f"mem AS (SELECT event_id, t_us, vec FROM embed WHERE {DECEPTIVE})",
                                 """sims AS (SELECT e.event_id, least(1e0, coalesce(max(list_dot_product(e.vec, m.vec)), 0)) AS memory_sim
              FROM embed e LEFT JOIN mem m ON m.t_us < e.t_us OR (m.t_us = e.t_us AND m.event_id < e.event_id) GROUP BY e.event_id)""",
                                 """shown AS (SELECT event_id, ip, t_us, vec, lead(t_us) OVER w AS next_us, lead(event_id) OVER w AS next_id
              FROM embed WINDOW w AS (PARTITION BY ip ORDER BY t_us, event_id))""",
                                 f"""pairs AS (SELECT a.event_id, greatest(0e0, least(1e0, max(list_dot_product(a.vec, b.vec)))) AS correlation
              FROM embed a JOIN shown b ON a.ip <> b.ip AND (b.t_us < a.t_us OR (b.t_us = a.t_us AND b.event_id < a.event_id))
                AND (b.next_us IS NULL OR b.next_us > a.t_us OR (b.next_us = a.t_us AND b.next_id > a.event_id)) AND b.t_us >= a.t_us - {LONG}
              GROUP BY a.event_id)""",
                                 """priors AS (SELECT event_id, CASE WHEN n = 0 THEN 0.02e0 ELSE (a + 1) / (n + 50e0) END AS prior FROM (
              SELECT event_id, count(*) OVER w AS n, coalesce(sum(is_attack::INT) OVER w, 0) AS a FROM outcome
              WINDOW w AS (ORDER BY t_us, event_id ROWS BETWEEN 2000 PRECEDING AND 1 PRECEDING)))""",
                                 """evidence AS (SELECT r.event_id, least(1e0, 0.3e0 * (r.n > 50)::INT + 0.2e0 * r.burst::INT
              + 0.25e0 * (r.failure_rate > 0.7e0)::INT + 0.2e0 * r.scan::INT + 0.2e0 * (r.cur_flags > 2)::INT) AS ml, memory_sim,
              coalesce(correlation, 0) AS correlation, r.score AS risk, prior, starts_with(r.user_agent, 'Mozilla/5.0 (') AS trusted
              FROM risk r JOIN sims USING (event_id) JOIN priors USING (event_id) LEFT JOIN pairs USING (event_id))"""),
        "dynamic_prior": with_req(f"""SELECT event_id, n, a::BIGINT AS attacks, {rnd('CASE WHEN n = 0 THEN 0.02e0 ELSE (a + 1) / (n + 50e0) END')}
            AS prior FROM (SELECT event_id, count(*) OVER w AS n, coalesce(sum(is_attack::INT) OVER w, 0) AS a FROM outcome
            WINDOW w AS (ORDER BY t_us, event_id ROWS BETWEEN 2000 PRECEDING AND 1 PRECEDING))""", OUTCOMES),
        "threshold_tuning": with_req(f"""SELECT n, fp, fn, {rnd('''CASE WHEN n < 20 THEN 0.98e0 WHEN fp / n::DOUBLE > 0.1e0 THEN
            least(0.99e0, 0.98e0 + 0.005e0) WHEN fn / n::DOUBLE > 0.1e0 THEN greatest(0.85e0, 0.98e0 - 0.005e0) ELSE 0.98e0 END''')}
            AS block_threshold FROM (SELECT count(*) AS n, count(*) FILTER (NOT is_attack) AS fp,
              (SELECT count(*) FROM (SELECT 1 FROM outcome WHERE is_attack AND payload = '' LIMIT 100)) AS fn
              FROM (SELECT * FROM outcome ORDER BY t_us DESC, event_id DESC LIMIT 400))""", OUTCOMES),
        "response_actions": with_req(f"""SELECT event_id, array_to_string(responses, ',') AS responses, until_us, throttle_until_us
            FROM ({RESPONDED}) WHERE len(responses) > 0""", *TO_FINAL, RESPONSES),
        "auto_behavior_rules": with_req("SELECT * FROM made", *TO_RISK, BEHAVIOR_RULES),
        "auto_payload_rules": with_req(f"""SELECT kind, event_id, t_us, 'Auto_' || kind || '_' || (t_us // 300000000) AS rule_name, pattern,
            severity, t_us + {DAY_US} AS expires_us FROM (SELECT f.kind, f.event_id, f.t_us FROM flagged f JOIN risk USING (event_id)
              WHERE score >= 50 QUALIFY row_number() OVER (PARTITION BY kind, f.t_us // 300000000 ORDER BY f.t_us, f.event_id) = 1)
            JOIN auto_kinds USING (kind)""", *TO_RISK, AUTO),
        "evolution_gate": with_req(f"""SELECT t_us // {DAY_US // 4} * {DAY_US // 4} AS period_us, count(*) AS n, count(DISTINCT payload) AS n_distinct,
            {rnd('count(DISTINCT payload) / count(*)::DOUBLE')} AS share FROM req WHERE {DECEPTIVE} AND length(payload) > 10
            GROUP BY 1 HAVING count(*) >= 8 AND count(DISTINCT payload) / count(*)::DOUBLE > 0.4e0"""),
        "apply_corrections": with_req(f"""
            SELECT d.rule_name, {rnd('coalesce(effectiveness, d.confidence)')} AS confidence FROM (SELECT rule_name, CASE WHEN auto_generated THEN 0.7e0 ELSE 0.5e0 END AS confidence FROM rules) d LEFT JOIN eff USING (rule_name)
            UNION ALL SELECT 'errors:' || error, count(*) FROM (
              SELECT CASE WHEN blocked AND status_code = 200 THEN 'false_positive' WHEN NOT blocked AND status_code <> 200 THEN 'false_negative'
                ELSE 'none' END AS error FROM (SELECT r.event_id, r.status_code, coalesce(bool_or(h.action = 'BLOCK'), false) AS blocked
                FROM req r LEFT JOIN hit h ON h.event_id = r.event_id WHERE r.payload <> '' GROUP BY ALL)) GROUP BY error""",
                                      DEFAULT, AUTO, RULES, RULE_HITS, EFFECT),
        "corrections_full": with_req(f"""
            SELECT 'label' AS kind, CASE WHEN is_attack THEN 'attack' ELSE 'normal' END AS item, count(*)::DOUBLE AS value FROM corrected GROUP BY is_attack
            UNION ALL SELECT 'rule', rule_name, {rnd('(count(*) FILTER (c.is_attack) + 1)::DOUBLE / (count(*) + 2)')}
              FROM hit h JOIN corrected c USING (event_id) GROUP BY rule_name
            UNION ALL SELECT 'memory', event_id::VARCHAR, 1 FROM corrected WHERE is_attack
            UNION ALL SELECT 'prior', 'n', n FROM recent UNION ALL SELECT 'prior', 'attacks', a FROM recent
            UNION ALL SELECT 'prior', 'prior', {rnd('(a + 1) / (n + 50e0)')} FROM recent""", DEFAULT, AUTO, RULES, RULE_HITS,
                                     f"corrected AS (SELECT event_id, t_us, CASE WHEN k % 11 = 0 THEN NOT {DECEPTIVE} ELSE {DECEPTIVE} END AS is_attack FROM req)",
                                     """recent AS (SELECT count(*) AS n, count(*) FILTER (is_attack) AS a FROM (
              SELECT * FROM corrected ORDER BY t_us DESC, event_id DESC LIMIT 2000))"""),
        "evolution_loop": with_req(f"""
            SELECT 'period' AS section, period_us::VARCHAR AS item, n::VARCHAR AS detail FROM periods
            UNION ALL SELECT 'event', 'mined rule added: ' || rule_name, severity FROM evolved
            UNION ALL SELECT 'healing', rule_name, pattern FROM evolved
            UNION ALL SELECT 'active', rule_name, action FROM rules WHERE auto_generated
            UNION ALL SELECT 'active', rule_name, 'BLOCK' FROM evolved""", DEFAULT, AUTO, RULES, OUTCOMES,
                                   f"""attacks AS (SELECT payload AS url, t_us // {DAY_US // 4} * {DAY_US // 4} AS period_us FROM outcome
              WHERE is_attack AND length(payload) > 10)""",
                                   """periods AS (SELECT period_us, count(DISTINCT url) AS n FROM attacks GROUP BY period_us
              HAVING count(*) >= 8 AND count(DISTINCT url) / count(*)::DOUBLE > 0.4e0)""",
                                   "pool AS (SELECT url FROM attacks WHERE period_us IN (SELECT period_us FROM periods))",
                                   shapes_of("pool"), cores_of("pool"), EVOLVED),
        "campaign_rows": with_req(f"""SELECT substr(sha256(campaign), 1, 16) AS campaign_id, campaign, n_members, {rnd('similarity')} AS similarity_score,
              coalesce(e, 0) AS common_endpoints, coalesce(p, 0) AS common_payloads, {NOW} AS detected_us, 'ACTIVE' AS status
            FROM grouped LEFT JOIN (SELECT campaign, count(*) FILTER (what = 'e') AS e, count(*) FILTER (what = 'p') AS p FROM (
              SELECT campaign, what, value FROM wanted JOIN grouped USING (campaign) WHERE value <> '' GROUP BY campaign, what, value, n_members HAVING count(*) = n_members)
              GROUP BY campaign) USING (campaign)""", FEAT, EMBED, LATEST,
                                  """links AS (SELECT a.ip AS a, b.ip AS b, list_dot_product(a.vec, b.vec) AS s FROM latest a JOIN latest b ON a.ip <> b.ip
              WHERE list_dot_product(a.vec, b.vec) > 0.97e0)""", "nodes AS (SELECT DISTINCT a AS id FROM links)", components("links", "nodes"),
                                  """grouped AS (SELECT component AS campaign, count(DISTINCT id) AS n_members, least(1e0, max(s)) AS similarity
              FROM comp JOIN links ON links.a = comp.id GROUP BY component)""",
                                  f"""wanted AS (SELECT DISTINCT component AS campaign, ip, unnest(['e', 'p']) AS what, unnest([endpoint, payload]) AS value
              FROM req JOIN comp ON comp.id = req.ip WHERE t_us >= {NOW} - {LONG})"""),
        "component_stats": with_req(f"""SELECT 'attack_samples' AS component, count(*) AS n FROM outcome WHERE is_attack
            UNION ALL SELECT 'normal_samples', count(*) FROM outcome WHERE NOT is_attack
            UNION ALL SELECT 'memory_entries', count(*) FROM outcome WHERE is_attack
            UNION ALL SELECT 'active_actors', count(DISTINCT ip) FROM outcome WHERE t_us > {NOW} - {SHORT}""", OUTCOMES),
        "defense_state": with_req("""SELECT 1::BIGINT AS id, k % 5 AS level, 60 - (k % 5) * 10 AS rate_limit, endpoint AS reason, t_us
            FROM req WHERE event_type = 'error' ORDER BY t_us DESC, event_id DESC LIMIT 1"""),
        "anomaly_features": with_req(f"""SELECT event_id, dim - 1 AS dim, {rnd('x[dim]')} AS value FROM (SELECT event_id, {X12} AS x,
            unnest(range(1, 13)) AS dim FROM scores) WHERE x[dim] <> 0""", FEAT),
        "behavior_embedding": with_req(f"""SELECT event_id, dim - 1 AS dim, {rnd('vec[dim]')} AS value FROM (SELECT event_id, vec,
            unnest(range(1, 65)) AS dim FROM embed) WHERE vec[dim] <> 0""", FEAT, EMBED),
        "kb_top1": f"""WITH {UNIT} SELECT q.event_id, arg_max(m.event_id, list_dot_product(q.vec, m.vec)) AS entry_id,
            {rnd('max(list_dot_product(q.vec, m.vec))')} AS similarity FROM vecs q CROSS JOIN vecs m WHERE q.label >= 5 AND m.label < 5
            GROUP BY q.event_id""",
        "kb_remove": "SELECT vec_id AS entry_id FROM embeddings WHERE label BETWEEN 1 AND 4",
        "actor_correlation": f"""WITH {UNIT} SELECT a.event_id::VARCHAR AS ip, {rnd('greatest(0, max(list_dot_product(a.vec, b.vec)))')}
            AS max_similarity, count(*) FILTER (list_dot_product(a.vec, b.vec) > 0.4e0) AS peers
            FROM vecs a JOIN vecs b ON a.event_id <> b.event_id GROUP BY a.event_id""",
        "campaigns": f"""WITH RECURSIVE {UNIT},
            links AS (SELECT a.event_id::VARCHAR AS a, b.event_id::VARCHAR AS b FROM vecs a JOIN vecs b ON a.event_id <> b.event_id
              WHERE list_dot_product(a.vec, b.vec) > 0.4e0),
            nodes AS (SELECT DISTINCT a AS id FROM links), {components('links', 'nodes')}
            SELECT id AS ip, component AS campaign FROM comp""",
        "actor_campaigns": with_req("""SELECT component AS campaign, count(*) AS n_members FROM comp GROUP BY component""", FEAT, EMBED, LATEST,
                                    """links AS (SELECT a.ip AS a, b.ip AS b FROM latest a JOIN latest b ON a.ip <> b.ip
              WHERE list_dot_product(a.vec, b.vec) > 0.97e0)""", "nodes AS (SELECT DISTINCT a AS id FROM links)",
                                    components("links", "nodes")),
        "payload_clusters": f"""WITH RECURSIVE {SHAPES} SELECT shape, weight, is_core AS core, cluster_name, cluster_size FROM sized""",
        "cluster_core": f"""WITH RECURSIVE {SHAPES}, {CORES} SELECT core, cluster_size, {rnd('confidence')} AS confidence FROM mined""",
        "evolved_rules": with_req("SELECT * FROM evolved", SHAPES, CORES, EVOLVED),
    }
    return posts

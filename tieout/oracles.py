"""DuckDB SQL for the queries of the catalog, written apart from the DataFrame code."""

from __future__ import annotations

from tieout.sources.feeds import AS_OF, CLOSE, DELAYED, DROPPED, DUCKDB, FIRST_CLOSE, SILENT


def _biz(a: str, b: str) -> str:
    f = lambda d: f"(5 * (({d} - DATE '1970-01-05') // 7) + least(({d} - DATE '1970-01-05') % 7 + 1, 5))"
    return f"CAST(abs({f(a)} - {f(b)}) AS BIGINT)"


_ASOF = f"DATE '{AS_OF}'"
_TIER = "CASE WHEN {0} >= 10 THEN 'T3' WHEN {0} >= 5 THEN 'T2' WHEN {0} >= 3 THEN 'T1' ELSE 'T0' END"
_ACTION = "CASE WHEN {0} >= 10 THEN 'executive escalation' WHEN {0} >= 5 THEN 'controller escalation' WHEN {0} >= 3 THEN 'team lead review' ELSE 'analyst queue' END"
_BUCKET = "CASE WHEN {0} <= 1 THEN '0-1d' WHEN {0} <= 3 THEN '2-3d' WHEN {0} <= 5 THEN '4-5d' ELSE '6d+' END"


def _match(name: str, core: str, proc: str, bps: int = 35, strict: bool = False, keys: str = "ref") -> str:
    """CTEs pair_<name> and <name>: one row per reference with its verdict."""
    fields = ", ".join(f"arg_min({f}, line_no) FILTER (WHERE source = '{s}') AS {t}_{g}" for s, t in (("core", "core"), ("processor", "proc")) for f, g in (("amount_minor", "amount"), ("business_date", "business_date"), ("currency", "currency")))
    extra = "WHEN core_currency <> proc_currency THEN 'currency'" if strict else ""
    return f"""
pair_{name} AS (SELECT {keys}, count(*) FILTER (WHERE source = 'core') AS n_core, count(*) FILTER (WHERE source = 'processor') AS n_proc, {fields}
  FROM (SELECT * FROM {core} UNION ALL SELECT * FROM {proc}) GROUP BY {keys}),
{name} AS (SELECT *, core_amount - proc_amount AS variance_minor, COALESCE(core_business_date, proc_business_date) AS business_date,
  CASE WHEN verdict = 'exact' THEN 'matched' WHEN verdict IN ('timing', 'amount_fx', 'amount_fee') THEN 'matched_flagged' ELSE 'open' END AS status,
  {_biz('COALESCE(core_business_date, proc_business_date)', _ASOF)} AS age_days, CAST(CASE WHEN n_core = n_proc THEN n_core - 1 ELSE 0 END AS BIGINT) AS ignored_copies
  FROM (SELECT *, CASE WHEN n_core = 0 OR n_proc = 0 THEN 'missing' WHEN n_core <> n_proc THEN 'duplicate' {extra}
    WHEN core_amount = proc_amount AND core_business_date = proc_business_date AND core_currency = proc_currency THEN 'exact'
    WHEN core_amount = proc_amount AND {_biz('core_business_date', 'proc_business_date')} <= 1 THEN 'timing'
    WHEN core_amount = -proc_amount AND core_amount <> 0 THEN 'sign'
    WHEN core_currency <> 'USD' AND abs(core_amount - proc_amount) <= 2 THEN 'amount_fx'
    WHEN core_amount <> 0 AND (core_amount > 0) = (proc_amount > 0) AND abs(core_amount) - abs(proc_amount) BETWEEN 25 AND greatest(25, abs(core_amount) * {bps} // 10000) THEN 'amount_fee'
    ELSE 'amount_unknown' END AS verdict FROM pair_{name}))"""


def _break(name: str, verdicts: str) -> str:
    return f"""
{name} AS (SELECT ref, verdict AS break_type, status, core_amount, proc_amount, variance_minor, business_date, age_days, NULL::BIGINT AS line_no FROM {verdicts} WHERE verdict NOT IN ('exact', 'missing')
  UNION ALL SELECT ref, 'missing', 'open', amount_minor, NULL, NULL, business_date, {_biz('business_date', _ASOF)}, line_no FROM core WHERE ref NOT IN (SELECT ref FROM proc)
  UNION ALL SELECT ref, 'missing', 'open', NULL, amount_minor, NULL, business_date, {_biz('business_date', _ASOF)}, line_no FROM proc WHERE ref NOT IN (SELECT ref FROM core))"""


_HEAD = f"""WITH {DUCKDB}, {_match('v', 'core', 'proc')}, {_break('brk', 'v')},
fact AS (SELECT ref, account, amount_minor, currency, kind, source AS source_system, source_file, line_no AS source_line, business_date FROM (SELECT * FROM core UNION ALL SELECT * FROM proc)),
cell AS (SELECT currency, source_system, business_date, count(*) AS record_count, CAST(sum(amount_minor) AS BIGINT) AS net_minor, CAST(sum(abs(amount_minor)) AS BIGINT) AS gross_minor FROM fact GROUP BY ALL),
first_seen_event AS (SELECT part, seq, min(arrival) AS arrival, count(*) AS copies FROM stream_event GROUP BY part, seq),
placed AS (SELECT *, max(seq) OVER (PARTITION BY part ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high_before, lead(seq) OVER (PARTITION BY part ORDER BY seq) AS next_seq FROM first_seen_event),
stats AS (SELECT part, count(*) AS events, CAST(sum(copies) AS BIGINT) - count(*) AS duplicates, count(*) FILTER (WHERE seq < high_before) AS out_of_order, arg_min(seq, arrival) AS first_seq, max(seq) AS high FROM placed GROUP BY part),
hole AS (SELECT p.part, p.seq + 1 AS missing_from, p.next_seq - 1 AS missing_to, p.next_seq - p.seq - 1 AS n, CASE WHEN s.high - (p.next_seq - 1) >= 50 THEN 'missing' ELSE 'open' END AS status
  FROM placed p JOIN stats s USING (part) WHERE p.next_seq - p.seq > 1 AND p.seq >= s.first_seq),
hb AS (SELECT b.part, b.producer_high_water, COALESCE(s.high, 0) AS received_high_water, b.producer_high_water - COALESCE(s.high, 0) AS lag, epoch(TIMESTAMP '{CLOSE}') - epoch(b.at) > 300 AS stale FROM beat b LEFT JOIN stats s USING (part)),
rep AS (SELECT (SELECT CAST(sum(events) AS BIGINT) FROM stats) AS events, (SELECT CAST(sum(duplicates) AS BIGINT) FROM stats) AS duplicates, (SELECT CAST(sum(out_of_order) AS BIGINT) FROM stats) AS out_of_order,
  (SELECT CAST(COALESCE(sum(n) FILTER (WHERE status = 'missing'), 0) AS BIGINT) FROM hole) AS missing_events, (SELECT count(*) FROM hole WHERE status = 'open') AS open_gaps,
  (SELECT count(*) FROM hb WHERE stale) AS stale_partitions, (SELECT count(*) FROM hb WHERE lag <> 0) AS lagging_partitions),
item AS (SELECT ref, break_type, arg_min(struct_pack(c := core_amount, p := proc_amount, v := variance_minor, d := business_date), COALESCE(line_no, 0)) AS s FROM brk WHERE status = 'open' GROUP BY ref, break_type),
pred AS (SELECT ref, arg_max(break_type, COALESCE(line_no, 0)) AS predicted FROM brk GROUP BY ref),
outcome AS (SELECT COALESCE(p.ref, q.ref) AS ref, p.break_type AS planted, q.predicted FROM planted p FULL JOIN pred q ON p.ref = q.ref),
req AS (SELECT CAST(substr(ref, 3, 9) AS BIGINT) AS request_id, ref, min(variance_minor) AS amount_minor FROM brk WHERE variance_minor IS NOT NULL GROUP BY ref),
routed AS (SELECT *, CASE WHEN request_id % 4 = 2 THEN 'refused' WHEN abs(amount_minor) >= 100000 THEN 'pending' ELSE 'auto' END AS state, ['ann', 'bob', '', 'cy'][request_id % 4 + 1] AS maker,
  ['ann', 'dee', '', 'cy'][(request_id // 5) % 4 + 1] AS checker, CASE WHEN request_id % 7 = 0 THEN 'rejected' ELSE 'approved' END AS action, request_id % 60 AS seconds FROM req),
decided AS (SELECT *, CASE WHEN state <> 'pending' THEN 'not pending' WHEN checker = '' THEN 'no checker' WHEN checker = maker THEN 'own request' WHEN request_id % 11 = 0 THEN 'no note' END AS reason FROM routed)
"""

_VERDICT = "ref, status, n_core, n_proc, core_amount, proc_amount, variance_minor, business_date, age_days"
_SUMMARY = "verdict, status, count(*) AS n, CAST(sum(COALESCE(variance_minor, 0)) AS BIGINT) AS variance_minor, max(age_days) AS oldest_days"
_TIERS = "(VALUES ('T0'), ('T1'), ('T2'), ('T3')) t(tier)"
_LATER = "DATE '2026-03-17'"


def _day_slices(lookback: int) -> str:
    days = "(SELECT DATE '2026-03-02' + CAST(i AS INTEGER) AS run_date FROM range(5) t(i))"
    near = "abs(business_date - run_date) <= 1" if lookback else "business_date = run_date"
    cut = "WHERE n_core > 0 OR business_date = run_date" if lookback else ""
    return (
        f", dcore AS (SELECT c.*, run_date FROM core c JOIN {days} ON business_date = run_date), dproc AS (SELECT p.*, run_date FROM proc p JOIN {days} ON {near}), "
        + _match("dv", "dcore", "dproc", keys="run_date, ref")
        + f" SELECT run_date, verdict, count(*) AS n FROM dv {cut} GROUP BY ALL"
    )


_SNAP = """snap_{0} AS (SELECT COALESCE(f.business_date, b.business_date) AS business_date, COALESCE(source_rows, 0) AS source_rows, COALESCE(source_minor, 0) AS source_minor, COALESCE(breaks, 0) AS breaks, COALESCE(variance_minor, 0) AS variance_minor
  FROM (SELECT business_date, count(*) AS source_rows, CAST(sum(amount_minor) AS BIGINT) AS source_minor FROM fact GROUP BY 1) f
  FULL JOIN (SELECT business_date, count(*) AS breaks, CAST(COALESCE(sum(variance_minor), 0) AS BIGINT) AS variance_minor FROM {1} WHERE status = 'open' GROUP BY 1) b ON f.business_date = b.business_date),
long_{0} AS (UNPIVOT snap_{0} ON source_rows, source_minor, breaks, variance_minor INTO NAME metric VALUE value)"""

_CLASS = """SELECT break_type, count(*) FILTER (WHERE planted = break_type) AS planted_n, count(*) FILTER (WHERE planted = break_type AND predicted = break_type) AS tp,
  count(*) FILTER (WHERE planted IS DISTINCT FROM break_type AND predicted = break_type) AS fp, count(*) FILTER (WHERE planted = break_type AND predicted IS DISTINCT FROM break_type) AS fn
  FROM (SELECT DISTINCT * FROM (SELECT ref, planted, predicted, planted AS break_type FROM outcome UNION ALL SELECT ref, planted, predicted, predicted FROM outcome)) WHERE break_type IS NOT NULL GROUP BY break_type"""

_ATTEMPT = """SELECT b.ref, b.break_type, ['timing_confirmed', 'fx_rounding_accepted', 'counterparty_error', 'written_off', 'made_up'][CAST(substr(b.ref, 3, 9) AS BIGINT) % 5 + 1] AS code,
  ['analyst', 'supervisor', 'controller', 'intern'][CAST(substr(b.ref, 3, 9) AS BIGINT) % 4 + 1] AS role, i.s.v AS v, i.ref IS NOT NULL AS known
  FROM (SELECT DISTINCT ref, break_type FROM brk) b LEFT JOIN item i ON b.ref = i.ref AND b.break_type = i.break_type"""

_BODIES = {
    "recon_verdicts": "SELECT ref, verdict, status, n_core, n_proc, core_amount, proc_amount, variance_minor, core_currency, proc_currency, business_date, proc_business_date, age_days, ignored_copies FROM v",
    "recon_summary": f"SELECT {_SUMMARY} FROM v GROUP BY verdict, status",
    "recon_breaks": """SELECT ref, verdict AS break_type, status, core_amount, proc_amount, variance_minor, business_date, age_days, NULL::BIGINT AS line_no, CASE verdict
      WHEN 'duplicate' THEN n_core || ' core and ' || n_proc || ' processor copies' WHEN 'timing' THEN 'booked ' || CAST(business_date AS VARCHAR) || ' and ' || CAST(proc_business_date AS VARCHAR)
      WHEN 'sign' THEN 'opposite signs' ELSE 'difference of ' || variance_minor || ' minor units' END AS detail FROM v WHERE verdict NOT IN ('exact', 'missing')
      UNION ALL SELECT ref, break_type, status, core_amount, proc_amount, variance_minor, business_date, age_days, line_no, CASE WHEN core_amount IS NULL THEN 'no record on the core side' ELSE 'no record on the processor side' END FROM brk WHERE break_type = 'missing'""",
    "recon_match_rate": """SELECT *, matched_exact + matched_tolerance AS total_matched, (matched_exact + matched_tolerance) * 1000000 // universe AS rate_ppm FROM (SELECT
      CAST(sum(CASE WHEN verdict = 'exact' THEN 1 WHEN verdict = 'duplicate' THEN least(n_core, n_proc) ELSE 0 END) AS BIGINT) AS matched_exact, count(*) FILTER (WHERE status = 'matched_flagged') AS matched_tolerance, count(*) AS universe FROM v)""",
    "recon_tolerance_notes": "SELECT CASE verdict WHEN 'timing' THEN 'date_within_tolerance' WHEN 'amount_fx' THEN 'fx_rounding' ELSE 'fee_schedule' END AS rule, count(*) AS n FROM v WHERE status = 'matched_flagged' GROUP BY 1",
    "recon_missing_core": "SELECT ref, business_date, amount_minor, line_no FROM proc WHERE ref NOT IN (SELECT ref FROM core)",
    "recon_missing_proc": "SELECT ref, business_date, amount_minor, line_no FROM core WHERE ref NOT IN (SELECT ref FROM proc)",
    "recon_by_business_date": _day_slices(0),
    "recon_lookback": _day_slices(1),
    "recon_strict_currency": f", {_match('sv', 'core', 'proc', strict=True)} SELECT {_SUMMARY} FROM sv GROUP BY verdict, status",
    "recon_universe": "SELECT count(*) AS universe FROM (SELECT ref FROM core UNION SELECT ref FROM proc)",
    "recon_largest_open": "SELECT ref, verdict, variance_minor FROM v WHERE status = 'open' ORDER BY abs(variance_minor) DESC NULLS LAST, ref LIMIT 1",
    "aging_buckets": f"SELECT bucket, COALESCE(n, 0) AS n FROM (VALUES ('0-1d'), ('2-3d'), ('4-5d'), ('6d+')) t(bucket) LEFT JOIN (SELECT {_BUCKET.format('age_days')} AS bucket, count(*) AS n FROM brk WHERE status = 'open' GROUP BY 1) USING (bucket)",
    "aging_tiers": f"""SELECT tier, COALESCE(n, 0) AS n, COALESCE(vm, 0) AS variance_minor, COALESCE(o, 0) AS oldest_days FROM {_TIERS} LEFT JOIN (SELECT {_TIER.format('a')} AS tier, count(*) AS n, CAST(sum(abs(COALESCE(variance_minor, 0))) AS BIGINT) AS vm, max(a) AS o
      FROM (SELECT *, {_biz('business_date', _LATER)} AS a FROM brk WHERE status = 'open') GROUP BY 1) USING (tier)""",
    "business_days_matrix": f"SELECT o_orderkey, a AS age_days, {_TIER.format('a')} AS tier, {_BUCKET.format('a')} AS bucket FROM (SELECT o_orderkey, {_biz('CAST(o_orderdate AS DATE)', _ASOF)} AS a FROM orders)",
    "score_by_class": f"SELECT *, CASE WHEN tp + fp > 0 THEN tp * 1000 // (tp + fp) ELSE 0 END AS precision_pm, CASE WHEN planted_n > 0 THEN tp * 1000 // planted_n END AS recall_pm FROM ({_CLASS})",
    "score_overall": "SELECT *, correct * 1000 // planted_n AS accuracy_pm FROM (SELECT count(planted) AS planted_n, count(*) FILTER (WHERE planted = predicted) AS correct, count(*) FILTER (WHERE predicted = 'amount_unknown') AS unexplained FROM outcome)",
    "control_totals_feed": "SELECT source_system AS source, count(*) AS n_records, CAST(sum(abs(amount_minor)) AS BIGINT) AS abs_total FROM fact GROUP BY 1",
    "slice_consistency": """SELECT business_date, COALESCE(core_rows, 0) AS core_rows, COALESCE(core_total, 0) AS core_total, COALESCE(proc_rows, 0) AS proc_rows, COALESCE(proc_total, 0) AS proc_total, COALESCE(core_rows, 0) > 0 AND COALESCE(proc_rows, 0) > 0 AS ok
      FROM (SELECT business_date, count(*) AS core_rows, CAST(sum(abs(amount_minor)) AS BIGINT) AS core_total FROM core GROUP BY 1) FULL JOIN (SELECT business_date, count(*) AS proc_rows, CAST(sum(abs(amount_minor)) AS BIGINT) AS proc_total FROM proc GROUP BY 1) USING (business_date)""",
    "lineage_currency_date": "SELECT currency, business_date, CAST(sum(amount_minor) AS BIGINT) AS value_minor, count(*) AS record_count FROM core GROUP BY ALL",
    "lineage_account_topk": "SELECT account, CAST(sum(amount_minor) AS BIGINT) AS value_minor, count(*) AS record_count FROM core GROUP BY ALL ORDER BY abs(value_minor) DESC, account LIMIT 5",
    "lineage_control_total": "SELECT CAST(sum(amount_minor) AS BIGINT) AS value_minor, count(*) AS record_count FROM fact",
    "lineage_contributors": "SELECT ref, amount_minor, source_file, line_no FROM core WHERE business_date = DATE '2026-03-03' AND currency = 'EUR'",
    "lineage_verify": "SELECT currency, business_date, CAST(sum(amount_minor) AS BIGINT) AS value_minor, count(*) AS record_count, CAST(sum(amount_minor) AS BIGINT) AS recomputed_minor, count(*) AS recomputed_count, TRUE AS ties FROM core GROUP BY ALL",
    "lineage_largest_line": "SELECT currency, business_date, CAST(sum(amount_minor) AS BIGINT) AS value_minor, count(*) AS record_count FROM core GROUP BY ALL ORDER BY record_count DESC, currency, business_date LIMIT 1",
    "mart_fact_records": "SELECT * FROM fact",
    "mart_fact_breaks": f"SELECT ref, break_type, status, core_amount, proc_amount, variance_minor, age_days, {_TIER.format('age_days')} AS tier, business_date FROM brk",
    "mart_daily_settlement": "SELECT * FROM cell",
    "mart_monthly_report": "SELECT * FROM cell WHERE strftime(business_date, '%Y-%m') = '2026-03'",
    "mart_drill_down": "SELECT ref, account, amount_minor, source_file, source_line FROM fact WHERE business_date = DATE '2026-03-03' AND currency = 'USD' AND source_system = 'processor'",
    "mart_verify_cells": "SELECT business_date, currency, source_system, record_count, net_minor, record_count AS drill_count, net_minor AS drill_minor, TRUE AS ties FROM cell",
    "mart_break_summary": "SELECT break_type, status, count(*) AS n, CAST(COALESCE(sum(abs(variance_minor)), 0) AS BIGINT) AS variance_minor FROM brk GROUP BY ALL",
    "mart_control_totals": "SELECT count(*) AS fact_count, CAST(sum(amount_minor) AS BIGINT) AS fact_minor, (SELECT CAST(sum(record_count) AS BIGINT) FROM cell) AS agg_count, (SELECT CAST(sum(net_minor) AS BIGINT) FROM cell) AS agg_minor, TRUE AS ties FROM fact",
    "mart_snapshot_diff": f""", {_match('wv', 'core', 'proc', bps=10)}, {_break('wbrk', 'wv')}, {_SNAP.format('a', 'brk')}, {_SNAP.format('b', 'wbrk')}
      SELECT business_date, metric, a.value AS before, b.value AS after, CASE WHEN a.value = b.value THEN 'unchanged' ELSE 'moved' END AS state FROM long_a a JOIN long_b b USING (business_date, metric)""",
    "mart_dates": "SELECT DISTINCT business_date FROM fact",
    "mart_rows_for": "SELECT business_date, count(*) AS n_rows FROM fact GROUP BY 1",
    "mart_replace_date": """SELECT f.business_date, n AS fact_rows, net_minor, CASE WHEN again THEN b.breaks ELSE 0 END AS break_rows, CASE WHEN again THEN n ELSE 0 END AS records_gone, b.breaks AS breaks_gone, CASE WHEN again THEN c.cells ELSE 0 END AS cells_gone
      FROM (SELECT business_date, business_date = DATE '2026-03-02' AS again, count(*) AS n, CAST(sum(amount_minor) AS BIGINT) AS net_minor FROM fact WHERE business_date IN (DATE '2026-03-02', DATE '2026-03-03') GROUP BY ALL) f
      JOIN (SELECT business_date, count(*) AS breaks FROM brk GROUP BY 1) b USING (business_date) JOIN (SELECT business_date, count(*) AS cells FROM cell GROUP BY 1) c USING (business_date)""",
    "mart_versions": """, day(d) AS (SELECT DATE '2026-03-02' + CAST(i AS INTEGER) FROM range(5) t(i)),
      before AS (SELECT 'fct_source_record' AS table_name, business_date, count(*) AS n FROM fact GROUP BY ALL UNION ALL SELECT 'fct_break', business_date, count(*) FROM brk GROUP BY ALL UNION ALL SELECT 'agg_daily_settlement', business_date, count(*) FROM cell GROUP BY ALL),
      mend AS (SELECT 'fct_source_record' AS table_name, count(*) AS n FROM fact WHERE business_date = DATE '2026-03-04' AND source_system = 'core' UNION ALL SELECT 'fct_break', count(*) FROM brk WHERE business_date = DATE '2026-03-04' AND status = 'open'
        UNION ALL SELECT 'agg_daily_settlement', count(*) FROM cell WHERE business_date = DATE '2026-03-04' AND source_system = 'core')
      SELECT 'before' AS seen, table_name, business_date, n FROM before WHERE business_date IN (SELECT d FROM day)
      UNION ALL SELECT 'after', table_name, business_date, n FROM before WHERE business_date IN (SELECT d FROM day) AND business_date <> DATE '2026-03-04' UNION ALL SELECT 'after', table_name, DATE '2026-03-04', n FROM mend WHERE n > 0""",
    "completeness_partition_stats": "SELECT part AS partition, events, duplicates, out_of_order, first_seq, high FROM stats",
    "completeness_gaps": "SELECT part AS partition, missing_from, missing_to, n, status FROM hole",
    "completeness_closed_late": "SELECT partition, min(seq) AS from_seq, max(seq) AS to_seq, count(*) AS n FROM (SELECT part AS partition, seq, seq - row_number() OVER (PARTITION BY part ORDER BY seq) AS island FROM placed WHERE seq < high_before) GROUP BY partition, island",
    "completeness_heartbeats": "SELECT h.part AS partition, b.at AS last_seen, h.producer_high_water, h.received_high_water, h.lag, h.stale FROM hb h JOIN beat b USING (part) UNION ALL SELECT 'p9', NULL, NULL, 0, NULL, TRUE",
    "completeness_report": "SELECT *, stale_partitions = 0 AND missing_events = 0 AND lagging_partitions = 0 AS complete FROM rep",
    "completeness_score": f"SELECT missing_events AS dropped_found, missing_events = {DROPPED} AS dropped_ok, out_of_order AS delayed_found, out_of_order >= {DELAYED} AS delayed_ok, (SELECT count(*) > 0 FROM hb WHERE stale AND part = '{SILENT}') AS silent_found FROM rep",
    "completeness_lag_vs_holes": """SELECT part AS partition, lag, missing, CASE WHEN lag = 0 AND missing > 0 THEN 'caught up with holes' WHEN lag > 0 AND missing = 0 THEN 'behind without holes' WHEN lag <> 0 AND missing > 0 THEN 'behind with holes' ELSE 'complete' END AS note
      FROM (SELECT h.part, h.lag, CAST(COALESCE(m.n, 0) AS BIGINT) AS missing FROM hb h LEFT JOIN (SELECT part, sum(n) FILTER (WHERE status = 'missing') AS n FROM hole GROUP BY part) m USING (part))""",
    "completeness_stream": "SELECT part AS partition, events, duplicates, out_of_order, first_seq, high FROM stats",
    "completeness_stream_gaps": "SELECT part AS partition, missing_from, missing_to, n, status FROM hole",
    "completeness_stream_silence": f"""SELECT part AS partition, TIMESTAMP '{CLOSE}' - INTERVAL 1 HOUR AS last_seen, producer_high_water // 2 AS producer_high_water, FALSE AS stale, '{FIRST_CLOSE}' AS close FROM beat
      UNION ALL SELECT part, beat.at, producer_high_water, part = '{SILENT}', '{CLOSE}' FROM beat UNION ALL SELECT 'p9', NULL, NULL, TRUE, c FROM (VALUES ('{FIRST_CLOSE}'), ('{CLOSE}')) t(c)""",
    "queue_intake": """SELECT action, break_type, from_status, 'open' AS to_status, count(*) AS n, CAST(sum(COALESCE(v, 0)) AS BIGINT) AS variance_minor FROM (
      SELECT 'opened' AS action, break_type, NULL AS from_status, variance_minor AS v FROM firsts UNION ALL SELECT 'reopened', break_type, 'resolved', variance_minor FROM firsts WHERE break_type = 'sign') GROUP BY ALL""",
    "queue_open_items": f"SELECT ref, break_type, s.d AS first_seen, s.v AS variance_minor, a AS age_days, {_TIER.format('a')} AS tier, {_ACTION.format('a')} AS tier_action FROM (SELECT *, {_biz('s.d', _LATER)} AS a FROM item)",
    "queue_aging_report": f"""SELECT tier, COALESCE(n, 0) AS n, COALESCE(vm, 0) AS variance_minor, COALESCE(o, 0) AS oldest_days FROM {_TIERS} LEFT JOIN (SELECT {_TIER.format('a')} AS tier, count(*) AS n, CAST(sum(abs(COALESCE(s.v, 0))) AS BIGINT) AS vm, max(a) AS o
      FROM (SELECT *, {_biz('s.d', _LATER)} AS a FROM item) GROUP BY 1) USING (tier)""",
    "queue_resolution_validation": f"""SELECT ref, break_type, code, role, CASE WHEN code = 'made_up' THEN 'unknown code' WHEN NOT known THEN 'unknown break'
      WHEN (CASE role WHEN 'analyst' THEN 1 WHEN 'supervisor' THEN 2 WHEN 'controller' THEN 3 ELSE 0 END) < (CASE code WHEN 'counterparty_error' THEN 2 WHEN 'written_off' THEN 3 ELSE 1 END) THEN 'role too low'
      WHEN abs(COALESCE(v, 0)) > (CASE code WHEN 'fx_rounding_accepted' THEN 1000 WHEN 'written_off' THEN 10000 ELSE 9223372036854775807 END) THEN 'over the limit' END AS reason FROM ({_ATTEMPT})""",
    "queue_history": """SELECT CAST(i AS BIGINT) AS event_id, ref, 'sign' AS break_type, ['opened', 'reopened'][i] AS action, [NULL, 'resolved'][i] AS from_status, 'open' AS to_status, 'opposite signs' AS detail
      FROM (SELECT min(ref) AS ref FROM brk WHERE break_type = 'sign') r, (VALUES (1), (2)) t(i)""",
    "foureyes_fast_reviews": "SELECT request_id, ref, action AS state, seconds FROM decided WHERE reason IS NULL AND seconds < 10 ORDER BY request_id LIMIT 10",
    "signoff_lifecycle": """, per_day AS (SELECT business_date, count(*) AS n FROM fact GROUP BY 1 ORDER BY 1 LIMIT 2),
      plan AS (SELECT substr(sha256('{"counts": {' || string_agg('"' || business_date || '": ' || n, ', ' ORDER BY business_date) || '}, "dates": [' || string_agg('"' || business_date || '"', ', ' ORDER BY business_date) || ']}'), 1, 16) AS plan FROM per_day)
      SELECT place, subject, outcome, CASE WHEN place = 100 THEN plan END AS plan FROM (VALUES (0, 'early use', 'it is pending'), (1, 'own approval', 'request 1 needs another person to decide'), (2, 'approval', 'done'), (3, 'rejection', 'done'), (4, 'approval without time', 'done'),
      (5, 'other plan', 'the plan has changed since'), (6, 'use', 'done'), (7, 'use of expired', 'it has expired'), (8, 'consumption', 'done'), (9, 'second use', 'it was used before'),
      (100, 'request 1', 'approved used'), (100, 'request 2', 'rejected'), (100, 'request 3', 'approved')) t(place, subject, outcome), plan""",
    "backfill_authorisation": """, per_day AS (SELECT CAST(business_date AS VARCHAR) AS d, count(*) AS n FROM fact WHERE business_date <= DATE '2026-03-04' GROUP BY 1),
      plan AS (SELECT substr(sha256('{"counts": {' || string_agg('"' || d || '": ' || n, ', ' ORDER BY d) || '}, "dates": [' || string_agg('"' || d || '"', ', ' ORDER BY d) || ']}'), 1, 16) AS good,
        substr(sha256('{"counts": {' || string_agg('"' || d || '": ' || CASE WHEN d = '2026-03-02' THEN 0 ELSE n END, ', ' ORDER BY d) || '}, "dates": [' || string_agg('"' || d || '"', ', ' ORDER BY d) || ']}'), 1, 16) AS other FROM per_day)
      SELECT scenario, reason, good AS approved_plan, CASE WHEN scenario = 'changed' THEN other ELSE good END AS actual_plan
      FROM (VALUES ('allowed', NULL), ('pending', 'it is pending'), ('used', 'it was used before'), ('expired', 'it has expired'), ('changed', 'the plan has changed since')) t(scenario, reason), plan""",
    "backfill_run": f""", d2core AS (SELECT *, business_date AS run_date FROM core WHERE business_date <= DATE '2026-03-03'), d2proc AS (SELECT *, business_date AS run_date FROM proc WHERE business_date <= DATE '2026-03-03'),
      d1core AS (SELECT * FROM d2core WHERE business_date = DATE '2026-03-02'), d1proc AS (SELECT * FROM d2proc WHERE business_date = DATE '2026-03-02' AND line_no // 2 % 97 <> 0),
      {_match('m1', 'd1core', 'd1proc', keys='run_date, ref')}, {_match('m2', 'd2core', 'd2proc', keys='run_date, ref')},
      figs AS (SELECT r.run_date, r.run, source_rows, source_minor, breaks, variance_minor FROM
        (SELECT run_date, 1 AS run, count(*) AS source_rows, CAST(sum(amount_minor) AS BIGINT) AS source_minor FROM (SELECT * FROM d1core UNION ALL SELECT * FROM d1proc) GROUP BY run_date
          UNION ALL SELECT run_date, 2, count(*), CAST(sum(amount_minor) AS BIGINT) FROM (SELECT * FROM d2core UNION ALL SELECT * FROM d2proc) GROUP BY run_date) r
        JOIN (SELECT run_date, run, CAST(sum(CASE verdict WHEN 'exact' THEN 0 WHEN 'missing' THEN n_core + n_proc ELSE 1 END) AS BIGINT) AS breaks, CAST(COALESCE(sum(variance_minor) FILTER (WHERE verdict NOT IN ('exact', 'missing')), 0) AS BIGINT) AS variance_minor
          FROM (SELECT *, 1 AS run FROM m1 UNION ALL SELECT *, 2 FROM m2) GROUP BY ALL) b ON r.run_date = b.run_date AND r.run = b.run),
      long AS (UNPIVOT figs ON source_rows, source_minor, breaks, variance_minor INTO NAME metric VALUE value)
      SELECT CAST(a.run_date AS VARCHAR) AS day, a.metric, COALESCE(b.value, 0) AS before, a.value AS after, CASE WHEN b.value IS NULL THEN 'new' WHEN a.value = b.value THEN 'unchanged' ELSE 'moved' END AS state
      FROM (SELECT * FROM long WHERE run = 2) a LEFT JOIN (SELECT * FROM long WHERE run = 1) b ON a.run_date = b.run_date AND a.metric = b.metric UNION ALL SELECT '2026-03-01', NULL, NULL, NULL, 'empty'""",
    "queue_ledger_audit": "SELECT n AS event_id, CASE WHEN n % 100 = 3 THEN 'changed' ELSE 'gone' END AS change FROM (SELECT row_number() OVER (ORDER BY ref, break_type) AS n FROM item) WHERE n % 100 IN (3, 7)",
    "foureyes_oldest_pending": "SELECT request_id, ref, amount_minor, ['ann', 'bob', '  ', 'Cy'][request_id % 4 + 1] AS maker, TIMESTAMP '2026-03-09 09:00:00' + to_seconds(request_id % 3600) AS made_at FROM routed WHERE state = 'pending' ORDER BY request_id % 3600, request_id LIMIT 20",
    "pipeline_broken_feed": """, cut AS (SELECT count(*) FILTER (WHERE line_no % 100 <> 7) AS n, count(*) AS all_n, sum(abs(amount_minor)) FILTER (WHERE line_no % 100 <> 7) AS total, sum(abs(amount_minor)) AS all_total FROM core)
      SELECT 'ingest_core' AS task, 'failed' AS state, 1 AS attempts, '/core: ' || n || ' of ' || all_n || ' records, total ' || total || ' of ' || all_total || ', 0 rejected' AS error FROM cut
      UNION ALL SELECT * FROM (VALUES ('ingest_processor', 'failed', 3, '/events is not there yet'), ('validate', 'skipped', 0, 'waits for ingest_core, ingest_processor'), ('reconcile', 'skipped', 0, 'waits for validate'), ('load_breaks', 'skipped', 0, 'waits for reconcile'),
        ('load_mart', 'skipped', 0, 'waits for reconcile'), ('build_aggregates', 'skipped', 0, 'waits for load_mart'), ('verify_controls', 'skipped', 0, 'waits for build_aggregates')) t""",
    "ingest_heartbeats": "SELECT part AS partition, beat.at, producer_high_water, CAST(substr(part, 2) AS BIGINT) AS arrival FROM beat",
    "ingest_truth": "SELECT ref, break_type FROM planted",
    "pipeline_run": f""", dcore AS (SELECT * FROM core WHERE business_date = DATE '2026-03-03'), dproc AS (SELECT * FROM proc WHERE business_date = DATE '2026-03-03'), {_match('dv', 'dcore', 'dproc')},
      dbrk AS (SELECT ref, verdict AS break_type, status FROM dv WHERE verdict NOT IN ('exact', 'missing') UNION ALL SELECT ref, 'missing', 'open' FROM (SELECT * FROM dcore UNION ALL SELECT * FROM dproc) WHERE ref IN (SELECT ref FROM dv WHERE verdict = 'missing')),
      told AS (SELECT (SELECT count(*) FROM core) AS nc, (SELECT count(*) FROM proc) AS np, (SELECT count(*) FROM dcore) AS dc, (SELECT count(*) FROM dproc) AS dp,
        (SELECT CAST(sum(CASE WHEN verdict = 'exact' THEN 1 WHEN verdict = 'duplicate' THEN least(n_core, n_proc) ELSE 0 END) AS BIGINT) FROM dv) AS exact, (SELECT count(*) FROM dv WHERE status = 'matched_flagged') AS flagged,
        (SELECT count(*) FROM dv) AS universe, (SELECT count(*) FROM dbrk) AS breaks, (SELECT count(*) FROM (SELECT DISTINCT ref, break_type FROM dbrk WHERE status = 'open')) AS opened,
        (SELECT CAST(sum(amount_minor) AS BIGINT) FROM (SELECT * FROM dcore UNION ALL SELECT * FROM dproc)) AS minor)
      SELECT task, 'success' AS state, metric, CAST(value AS BIGINT) AS value FROM told, LATERAL (VALUES ('ingest_core', 'file_rows', nc), ('ingest_core', 'rows', dc), ('ingest_processor', 'file_rows', np), ('ingest_processor', 'rows', dp),
        ('validate', 'core', dc), ('validate', 'proc', dp), ('reconcile', 'matched_exact', exact), ('reconcile', 'matched_tolerance', flagged), ('reconcile', 'universe', universe), ('reconcile', 'breaks', breaks), ('load_breaks', 'open', opened),
        ('verify_controls', 'fact_count', dc + dp), ('verify_controls', 'fact_minor', minor), ('verify_controls', 'agg_count', dc + dp), ('verify_controls', 'agg_minor', minor), ('load_mart', NULL, NULL), ('build_aggregates', NULL, NULL)) t(task, metric, value)""",
    "foureyes_routing": "SELECT request_id, ref, amount_minor, state FROM routed",
    "foureyes_decisions": "SELECT request_id, action, reason, seconds FROM decided",
    "foureyes_review_speed": "SELECT count(*) AS reviewed, count(*) FILTER (WHERE seconds < 10) AS suspiciously_fast FROM decided WHERE reason IS NULL",
    "signoff_protected_dates": "SELECT business_date, count(*) AS n_rows FROM fact WHERE business_date IN (SELECT business_date FROM core GROUP BY 1 HAVING count(*) FILTER (WHERE kind = 'refund') % 2 = 0) GROUP BY 1",
    "backfill_plan": """SELECT d.day AS business_date, COALESCE(c.core_rows, 0) AS core_rows, COALESCE(c.proc_rows, 0) AS proc_rows, CASE WHEN d.day <= DATE '2026-03-04' THEN COALESCE(c.core_rows + c.proc_rows, 0) ELSE 0 END AS mart_rows,
      CASE WHEN COALESCE(c.core_rows + c.proc_rows, 0) = 0 THEN 'empty' ELSE 'due' END AS state FROM (SELECT DATE '2026-03-01' + CAST(i AS INTEGER) AS day FROM range(8) t(i)) d
      LEFT JOIN (SELECT business_date, count(*) FILTER (WHERE source_system = 'core') AS core_rows, count(*) FILTER (WHERE source_system = 'processor') AS proc_rows FROM fact GROUP BY 1) c ON c.business_date = d.day WHERE d.day <> DATE '2026-03-02'""",
    "ingest_fixed_width_roundtrip": "SELECT ref, business_date, account, amount_minor, currency, kind, source, CAST(row_number() OVER (ORDER BY line_no) AS BIGINT) AS line_no FROM core",
    "ingest_jsonl_roundtrip": "SELECT ref, business_date, account, amount_minor, currency, kind, source, CAST(row_number() OVER (ORDER BY line_no) AS BIGINT) AS line_no FROM proc",
    "ingest_transport": "SELECT part AS partition, events, duplicates, out_of_order, first_seq, high FROM stats",
    "ingest_rejects": "SELECT line_no, ['unknown record code', 'bad date', 'bad amount', 'no reference'][line_no % 200 // 50 + 1] AS reason FROM core WHERE line_no % 50 = 0",
    "ingest_truncated_gate": """SELECT TRUE AS refused, 'the batch: ' || n || ' of ' || all_n || ' records, total ' || total || ' of ' || all_total || ', 0 rejected' AS reason
      FROM (SELECT count(*) FILTER (WHERE line_no % 100 <> 7) AS n, count(*) AS all_n, sum(abs(amount_minor)) FILTER (WHERE line_no % 100 <> 7) AS total, sum(abs(amount_minor)) AS all_total FROM core)""",
} | {f"recon_{short}": f"SELECT {_VERDICT} FROM v WHERE verdict = '{verdict}'" for short, verdict in (("duplicates", "duplicate"), ("sign", "sign"), ("fx", "amount_fx"), ("fee", "amount_fee"), ("timing", "timing"), ("unknown", "amount_unknown"))}

_FIRSTS = ", firsts AS (SELECT ref, break_type, arg_min(struct_pack(v := variance_minor), COALESCE(line_no, 0)).v AS variance_minor FROM brk GROUP BY ref, break_type) "
_BODIES["queue_intake"] = _FIRSTS + _BODIES["queue_intake"]

ORACLES = {name: _HEAD + body for name, body in _BODIES.items()}

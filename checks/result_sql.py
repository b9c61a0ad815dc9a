"""One check statement per registered result."""

from __future__ import annotations

from checks.base_sql import n_if, pc, rt, s_if
from tollbook.plans.tooling import MISSING, POLL

ALL_USD = "(SELECT sum(cost) FROM b_bill)"
ALL_OUT = "(SELECT sum(u_out) FROM b_bill)"
UPL = rt("sum(cost)", "sum(lines_)")
HIT = n_if("lines_ > 0")

SQL: dict[str, str] = {}

# ---- spending -------------------------------------------------------------------

SQL["t01_by_agent"] = f"""
SELECT agent, count(DISTINCT session_id) AS sessions, count(*) AS calls, ifnull(sum(cost), 0) AS usd, {pc('ifnull(sum(cost), 0)', ALL_USD)} AS pct_of_total_usd,
       ifnull(sum(input_tokens), 0) AS input_tokens, ifnull(sum(cache_read_tokens), 0) AS cache_read_tokens, sum(w5) + sum(w60) AS cache_write_tokens,
       ifnull(sum(output_tokens), 0) AS output_tokens, sum(ctx) AS ctx_tokens
FROM b_bill GROUP BY agent"""
SQL["t01_by_model"] = """
SELECT model, min(vendor) AS provider, count(*) AS calls, count(DISTINCT session_id) AS sessions, ifnull(sum(cost), 0) AS usd, ifnull(sum(u_in), 0) AS input_usd,
       ifnull(sum(u_read), 0) AS cache_read_usd, ifnull(sum(CASE WHEN known THEN u_write END), 0) AS cache_write_usd, ifnull(sum(u_out), 0) AS output_usd
FROM b_bill GROUP BY model"""
SQL["t01_components_by_agent"] = f"""
SELECT CASE WHEN grouping(agent) = 1 THEN 'ALL' ELSE agent END AS agent, ifnull(sum(cost), 0) AS usd, ifnull(sum(u_in), 0) AS input_usd, ifnull(sum(u_read), 0) AS cache_read_usd,
       ifnull(sum(CASE WHEN known THEN u_write END), 0) AS cache_write_usd, ifnull(sum(u_out), 0) AS output_usd, {pc('sum(u_in)', 'sum(cost)')} AS pct_input,
       {pc('sum(u_read)', 'sum(cost)')} AS pct_cache_read, {pc('sum(CASE WHEN known THEN u_write END)', 'sum(cost)')} AS pct_cache_write, {pc('sum(u_out)', 'sum(cost)')} AS pct_output
FROM b_bill GROUP BY GROUPING SETS ((agent), ())"""
SQL["t01_usd_per_session"] = """
SELECT agent, count(*) AS sessions, avg(cost) AS mean_usd, median(cost) AS p50_usd, quantile_cont(cost, 0.9) AS p90_usd, quantile_cont(cost, 0.99) AS p99_usd, max(cost) AS max_usd
FROM b_live WHERE cost IS NOT NULL GROUP BY agent"""
SQL["t01_per_committed_line_by_mode"] = f"""
SELECT mode, count(*) AS sessions, sum(cost) AS usd, sum(lines_) AS committed_lines, {UPL} AS usd_per_committed_line,
       {rt('sum(ctx)', 'sum(lines_)')} AS ctx_tokens_per_committed_line, {rt('sum(outtok)', 'sum(lines_)')} AS output_tokens_per_committed_line
FROM b_live GROUP BY mode"""
SQL["t01_per_committed_line_by_agent_mode"] = f"""
SELECT agent, mode, count(*) AS sessions, sum(cost) AS usd, sum(lines_) AS committed_lines, {UPL} AS usd_per_committed_line FROM b_live GROUP BY agent, mode"""
SQL["t01_unpriced_share"] = f"""
SELECT agent, count(*) AS calls, {n_if('NOT known')} AS unpriced_calls, {pc(n_if('NOT known'), 'count(*)')} AS pct_calls_unpriced, sum(tok) AS all_tokens,
       sum(CASE WHEN known THEN 0 ELSE tok END) AS unpriced_tokens, {pc('sum(CASE WHEN known THEN 0 ELSE tok END)', 'sum(tok)')} AS pct_tokens_unpriced
FROM (SELECT *, ctx + ifnull(output_tokens, 0) AS tok FROM b_bill) GROUP BY agent"""
SQL["t01_unpriced_models"] = """
SELECT model, count(*) AS calls, sum(ctx) AS ctx_tokens, ifnull(sum(output_tokens), 0) AS output_tokens FROM b_bill WHERE vendor IS NULL GROUP BY model"""
SQL["t01_headline"] = f"""
SELECT sum(cost) AS total_usd, {s_if("agent = 'claude_code'", 'ifnull(cost, 0)')} AS usd_claude_code, {s_if("agent = 'codex'", 'ifnull(cost, 0)')} AS usd_codex,
       {s_if("agent = 'opencode'", 'ifnull(cost, 0)')} AS usd_opencode, {pc('sum(u_read)', 'sum(cost)')} AS pct_usd_cache_read,
       {pc('sum(CASE WHEN known THEN u_write END)', 'sum(cost)')} AS pct_usd_cache_write, {pc('sum(u_out)', 'sum(cost)')} AS pct_usd_output,
       {pc('sum(u_in)', 'sum(cost)')} AS pct_usd_fresh_input, {pc(n_if('NOT known'), 'count(*)')} AS pct_calls_unpriced,
       (SELECT {UPL} FROM b_sess) AS usd_per_committed_line_all
FROM b_bill"""

ENTRY = """(SELECT e.*, ifnull(input_tokens, 0) + ifnull(cache_create_tokens, 0) AS etok,
        CASE vendor WHEN 'anthropic' THEN (ifnull(input_tokens, 0) + ifnull(cache_create_tokens, 0)) / 1e6 * p5 ELSE ifnull(input_tokens, 0) / 1e6 * pin END AS eusd,
        [try_cast(p AS INTEGER) FOR p IN string_split(split_part(harness_version, '-', 1), '.')] AS vk
 FROM b_main e WHERE known AND NOT EXISTS (SELECT 1 FROM b_main o WHERE o.known AND o.session_id = e.session_id AND o.seq < e.seq)) f"""
ESTAT = """count(*) AS sessions, median(etok) AS median_entry_tokens, quantile_cont(etok, 0.9) AS p90_entry_tokens, median(eusd) AS median_entry_usd, sum(eusd) AS total_entry_usd"""
for _agent, _name in (("claude_code", "t05_claude_code_by_version"), ("codex", "t05_codex_by_version")):
    SQL[_name] = f"""
SELECT harness_version, array_to_string(vk, '.') AS vkey, {ESTAT} FROM {ENTRY} WHERE agent = '{_agent}' AND harness_version IS NOT NULL
GROUP BY harness_version, vk HAVING count(*) >= 2"""
SQL["t05_by_agent_month"] = f"SELECT agent, mon AS month, {ESTAT} FROM {ENTRY} WHERE mon IS NOT NULL GROUP BY agent, mon"
SQL["t05_totals_by_agent"] = f"""
SELECT agent, count(*) AS sessions, median(etok) AS median_entry_tokens, sum(etok) AS total_entry_tokens, sum(eusd) AS total_entry_usd,
       {pc('sum(eusd)', ALL_USD)} AS pct_of_total_usd FROM {ENTRY} GROUP BY agent"""
SQL["t05_headline"] = f"""
WITH v AS (SELECT harness_version AS hv, vk, median(etok) AS tok, median(eusd) AS usd FROM {ENTRY} WHERE agent = 'claude_code' GROUP BY ALL HAVING count(*) >= 2),
     a AS (SELECT * FROM v ORDER BY vk, hv LIMIT 1), z AS (SELECT * FROM v ORDER BY vk DESC, hv DESC LIMIT 1), s AS (SELECT sum(eusd) AS t FROM {ENTRY})
SELECT a.hv AS first_claude_code_version, a.tok AS median_entry_tokens_first_version, z.hv AS last_claude_code_version, z.tok AS median_entry_tokens_last_version,
       100.0E0 * (z.tok / a.tok - 1) AS pct_change_in_median_entry_tokens, z.usd AS median_entry_usd_last_version, s.t AS total_entry_usd_all_sessions,
       {pc('s.t', ALL_USD)} AS pct_of_total_usd
FROM s LEFT JOIN a ON true LEFT JOIN z ON true"""

FATE = "(SELECT *, CASE WHEN lines_ > 0 THEN 'committed' WHEN lines_ = 0 THEN 'zero committed lines' ELSE 'no attribution' END AS fate FROM b_live) o"
SQL["t13_by_agent"] = f"""
SELECT g.agent, g.fate AS outcome, g.k AS sessions, {pc('g.k', 'w.k')} AS pct_of_agent_sessions, g.c AS usd, {pc('g.c', 'w.c')} AS pct_of_agent_usd, g.mc AS median_session_usd, g.mn AS median_calls
FROM (SELECT agent, fate, count(*) AS k, sum(cost) AS c, median(cost) AS mc, median(n) AS mn FROM {FATE} GROUP BY agent, fate) g
JOIN (SELECT agent, count(*) AS k, sum(cost) AS c FROM b_live GROUP BY agent) w ON w.agent = g.agent"""
SQL["t13_by_mode"] = f"""
SELECT mode, fate AS outcome, count(*) AS sessions, sum(cost) AS usd, {pc('sum(cost)', '(SELECT sum(cost) FROM b_live)')} AS pct_of_all_usd,
       median(asked) AS median_human_turns, median(tools) AS median_tool_calls FROM {FATE} GROUP BY mode, fate"""
SQL["t13_size_of_abandoned_sessions"] = f"""
SELECT CASE WHEN cost >= 10 THEN '4. >10 USD' WHEN cost >= 1 THEN '3. 1-10 USD' WHEN cost >= 0.1 THEN '2. 0.1-1 USD' ELSE '1. <0.1 USD' END AS usd_bucket,
       count(*) AS abandoned_sessions, sum(cost) AS usd, median(n) AS median_calls, median(asked) AS median_human_turns
FROM {FATE} WHERE fate IN ('zero committed lines', 'no attribution') GROUP BY 1"""
SQL["t13_where_do_they_die"] = f"""
WITH spot AS (SELECT o.fate, o.cost, CAST(p.nc AS DOUBLE) / o.n AS rel FROM {FATE}
              JOIN (SELECT session_id, max(seq) AS seq FROM b_asked GROUP BY session_id) q ON q.session_id = o.session_id
              JOIN b_pos p ON p.session_id = q.session_id AND p.seq = q.seq WHERE o.n > 3)
SELECT fate AS outcome, count(*) AS sessions, median(rel) AS median_position_of_last_prompt,
       (SELECT min(x.rel) FROM spot x WHERE x.fate = s.fate
          AND (SELECT sum(y.cost) FROM spot y WHERE y.fate = x.fate AND y.rel <= x.rel) >= (SELECT sum(z.cost) / 2 FROM spot z WHERE z.fate = x.fate)) AS usd_weighted_median_position,
       sum(cost) AS usd FROM spot s GROUP BY fate"""
SQL["t13_most_expensive_abandoned"] = f"""
SELECT session_id, agent, repo, mode, cost AS session_cost_usd, n AS n_calls, asked AS n_human_turns, tools AS n_tool_calls, fate AS outcome
FROM {FATE} WHERE fate <> 'committed' ORDER BY cost DESC NULLS LAST, session_id LIMIT 20"""
SQL["t13_headline"] = f"""
SELECT {n_if("fate <> 'committed'")} AS abandoned_sessions, {pc(n_if("fate <> 'committed'"), 'count(*)')} AS pct_of_sessions_abandoned,
       {s_if("fate <> 'committed'", 'cost')} AS usd_abandoned, {pc(s_if("fate <> 'committed'", 'cost'), 'sum(cost)')} AS pct_of_total_usd_abandoned,
       {s_if("fate = 'zero committed lines'", 'cost')} AS usd_zero_committed_lines, {s_if("fate = 'no attribution'", 'cost')} AS usd_no_attribution,
       median(CASE WHEN fate <> 'committed' THEN cost END) AS median_usd_of_an_abandoned_session FROM {FATE}"""

SHARED = """(SELECT s.*, CASE WHEN contains(model, 'opus') THEN 'opus' WHEN contains(model, 'sonnet') THEN 'sonnet' WHEN contains(model, 'haiku') THEN 'haiku' WHEN contains(model, 'fable') THEN 'fable'
             WHEN starts_with(model, 'gpt-5.5') THEN 'gpt-5.5' WHEN starts_with(model, 'gpt-5.4') THEN 'gpt-5.4' WHEN starts_with(model, 'gpt-5.3') THEN 'gpt-5.3-codex'
             WHEN model IS NULL THEN 'unknown' ELSE 'other' END AS fam
 FROM b_live s WHERE agent <> 'cursor' AND (SELECT count(DISTINCT o.agent) FROM b_live o WHERE o.repo = s.repo) >= 2) h"""
SQL["t15_by_agent_model_family"] = f"""
SELECT agent, fam AS model_family, count(*) AS sessions, sum(cost) AS usd, sum(lines_) AS committed_lines, {UPL} AS usd_per_committed_line,
       {rt('sum(ctx)', 'sum(lines_)')} AS ctx_tokens_per_committed_line, {rt('sum(outtok)', 'sum(lines_)')} AS output_tokens_per_committed_line
FROM {SHARED} GROUP BY agent, fam HAVING count(*) >= 3"""
SQL["t15_by_mode"] = f"""
SELECT mode, agent, count(*) AS sessions, sum(cost) AS usd, sum(lines_) AS committed_lines, {UPL} AS usd_per_committed_line FROM {SHARED} GROUP BY mode, agent HAVING count(*) >= 3"""
SQL["t15_by_repo_agent"] = f"""
SELECT repo, agent, count(*) AS sessions, sum(cost) AS usd, sum(lines_) AS committed_lines, {UPL} AS usd_per_committed_line FROM {SHARED} GROUP BY repo, agent
HAVING count(*) >= 3 AND sum(lines_) > 0"""
SQL["t15_headline"] = f"""
WITH a AS (SELECT agent, {UPL} AS u FROM {SHARED} GROUP BY agent)
SELECT (SELECT count(DISTINCT repo) FROM {SHARED}) AS repos_with_two_or_more_agents, arg_min(agent, u) AS cheapest_agent_per_committed_line, min(u) AS cheapest_usd_per_committed_line,
       arg_max(agent, u) AS dearest_agent_per_committed_line, max(u) AS dearest_usd_per_committed_line, max(u) / min(u) AS ratio_dearest_to_cheapest FROM a"""

CC = "(SELECT * FROM b_bill WHERE agent = 'claude_code') c"
SQL["t21_speed_share"] = f"""
SELECT ifnull(speed, 'not recorded') AS speed, count(*) AS calls, {pc('count(*)', f'(SELECT count(*) FROM {CC})')} AS pct_of_calls, count(DISTINCT session_id) AS sessions,
       ifnull(sum(cost), 0) AS usd, {pc('ifnull(sum(cost), 0)', f'(SELECT sum(cost) FROM {CC})')} AS pct_of_usd, ifnull(sum(output_tokens), 0) AS output_tokens FROM {CC} GROUP BY 1"""
SQL["t21_fast_sessions_vs_standard"] = f"""
SELECT CASE WHEN s.fast > 0 THEN 'uses fast' ELSE 'never fast' END AS kind, count(*) AS sessions, median(t.m) AS median_agent_time_s_per_turn, sum(s.cost) AS usd, {rt('sum(s.cost)', 'sum(s.lines_)')} AS usd_per_committed_line
FROM b_live s JOIN (SELECT session_id, median((epoch_us(ts_adj) // 1000) - (epoch_us(uts) // 1000)) / 1000.0E0 AS m FROM b_turn WHERE uts IS NOT NULL AND ts_adj IS NOT NULL GROUP BY session_id) t ON t.session_id = s.session_id
WHERE s.agent = 'claude_code' GROUP BY 1"""
SQL["t21_fast_by_month"] = f"""
SELECT mon AS month, {n_if("speed = 'fast'")} AS fast_calls, count(*) AS calls, {pc(n_if("speed = 'fast'"), 'count(*)')} AS pct_fast, {s_if("speed = 'fast'", 'ifnull(cost, 0)')} AS fast_usd
FROM {CC} WHERE mon IS NOT NULL GROUP BY mon"""
SQL["t21_headline"] = f"""
SELECT {n_if("speed = 'fast'")} AS fast_calls, {pc(n_if("speed = 'fast'"), 'count(*)')} AS pct_of_claude_code_calls, {s_if("speed = 'fast'", 'ifnull(cost, 0)')} AS fast_usd,
       {pc(s_if("speed = 'fast'", 'ifnull(cost, 0)'), 'sum(cost)')} AS pct_of_claude_code_usd, count(DISTINCT CASE speed WHEN 'fast' THEN session_id END) AS sessions_using_fast,
       {pc('count(*) - count(speed)', 'count(*)')} AS pct_of_calls_without_a_speed_field FROM {CC}"""

CELL = """(SELECT * FROM (SELECT g.*, count(*) OVER (PARTITION BY who, repo) AS models FROM
  (SELECT who, repo, model, count(*) AS k, sum(cost) AS c, sum(lines_) AS l, sum(ctx) AS x, sum(outtok) AS o FROM b_live
   WHERE model IS NOT NULL AND who <> left(md5('unknown'), 10) GROUP BY who, repo, model HAVING count(*) >= 1) g) WHERE models > 1) w"""
SQL["t22_pairs"] = f"""
SELECT who AS user_hash, repo, model AS session_model, k AS sessions, c AS usd, l AS committed_lines, {rt('c', 'l')} AS usd_per_committed_line, {rt('x', 'l')} AS ctx_tokens_per_committed_line FROM {CELL}"""
SQL["t22_model_totals_within_switchers"] = f"""
SELECT model AS session_model, count(*) AS user_repo_cells, sum(k) AS sessions, sum(c) AS usd, sum(l) AS committed_lines, {rt('sum(c)', 'sum(l)')} AS usd_per_committed_line,
       {rt('sum(o)', 'sum(l)')} AS output_tokens_per_committed_line FROM {CELL} GROUP BY model"""
_EXTREMES = f"""SELECT who, repo, arg_min(model, (u, model)) AS am, min(u) AS au, arg_max(model, (u, model)) AS zm, max(u) AS zu FROM (SELECT *, c / l AS u FROM {CELL} WHERE l > 0) GROUP BY who, repo HAVING count(*) > 1"""
SQL["t22_within_pair_comparison"] = f"""
SELECT who AS user_hash, repo, am AS cheapest_model, au AS cheapest_usd_per_line, zm AS dearest_model, zu AS dearest_usd_per_line, zu / nullif(au, 0) AS ratio
FROM ({_EXTREMES}) ORDER BY ratio DESC NULLS LAST, user_hash, repo"""
SQL["t22_headline"] = f"""
SELECT count(DISTINCT (who, repo)) AS user_repo_pairs_that_switched_models, count(DISTINCT model) AS models_involved, sum(k) AS sessions, sum(c) AS usd,
       {rt('sum(c)', 'sum(l)')} AS usd_per_committed_line_overall, (SELECT median(zu / nullif(au, 0)) FROM ({_EXTREMES})) AS median_dearest_to_cheapest_ratio_within_a_pair FROM {CELL}"""

ZONE = """(SELECT s.cost, s.lines_, s.tools, s.bad, f.timezone, f.off, hour(f.ts + to_minutes(f.off)) AS h
 FROM (SELECT session_id, arg_min(timezone, seq) AS timezone, arg_min(ts, seq) AS ts,
              CASE arg_min(timezone, seq) WHEN 'Europe/Berlin' THEN 120 WHEN 'America/New_York' THEN -240 WHEN 'Asia/Tokyo' THEN 540 END AS off
       FROM b_bill WHERE agent = 'codex' AND timezone IS NOT NULL AND ts IS NOT NULL GROUP BY session_id) f
 JOIN b_sess s ON s.session_id = f.session_id WHERE f.off IS NOT NULL) z"""
LOST = n_if("ifnull(lines_, 0) = 0")
HSTAT = f"sum(cost) AS usd, {pc('sum(bad)', 'sum(tools)')} AS tool_error_rate_pct, {pc(LOST, 'count(*)')} AS abandonment_rate_pct, {UPL} AS usd_per_committed_line"
PART = "CASE WHEN h >= 18 THEN '3. evening 18-24' WHEN h >= 6 THEN '2. day 6-18' ELSE '1. night 0-6' END"
SQL["t23_sessions_per_local_hour"] = f"SELECT h AS local_hour, count(*) AS sessions, {HSTAT} FROM {ZONE} GROUP BY h"
SQL["t23_by_hour_bucket"] = f"""
SELECT {PART} AS hour_bucket, count(*) AS sessions, {pc('count(*)', f'(SELECT count(*) FROM {ZONE})')} AS pct_of_sessions, {HSTAT}, median(cost) AS median_session_usd FROM {ZONE} GROUP BY 1"""
SQL["t23_by_timezone"] = f"""
SELECT timezone, off AS offset_min, count(*) AS sessions, sum(cost) AS usd, {pc(n_if('h < 6'), 'count(*)')} AS pct_started_at_night FROM {ZONE} GROUP BY timezone, off"""
_N, _D = "h < 6", "h BETWEEN 6 AND 17"
SQL["t23_headline"] = f"""
SELECT count(*) AS codex_sessions_with_a_timezone, {pc(n_if(_N), 'count(*)')} AS pct_of_sessions_started_at_night, {pc(s_if(_N, 'cost'), 'sum(cost)')} AS pct_of_codex_usd_spent_at_night,
       {pc(n_if(_N + ' AND ifnull(lines_, 0) = 0'), n_if(_N))} AS abandonment_rate_pct_night, {pc(n_if(_D + ' AND ifnull(lines_, 0) = 0'), n_if(_D))} AS abandonment_rate_pct_day,
       {rt(s_if(_N, 'cost'), s_if(_N, 'lines_'))} AS usd_per_committed_line_night, {rt(s_if(_D, 'cost'), s_if(_D, 'lines_'))} AS usd_per_committed_line_day,
       median(CASE WHEN {_N} THEN cost END) AS median_session_usd_night FROM {ZONE}"""

# ---- context --------------------------------------------------------------------

GAP = """(SELECT *, gap_ms / 60000.0E0 AS gap, ifnull(cache_create_tokens, 0) AS made, prev_ctx > 0 AND 2 * ifnull(cache_create_tokens, 0) >= prev_ctx AS broke FROM (
  SELECT *, (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER w AS gap_ms, lag(ctx) OVER w AS prev_ctx FROM b_main
  WHERE agent = 'claude_code' AND ts IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq)) WHERE gap_ms IS NOT NULL) g"""
WR = "ifnull(u_write, 0) * CASE WHEN known THEN 1 ELSE 0 END"
SQL["t02_by_gap_bucket"] = f"""
SELECT CASE WHEN gap >= 60 THEN '4. >60 min' WHEN gap >= 5 THEN '3. 5-60 min' WHEN gap >= 1 THEN '2. 1-5 min' ELSE '1. <1 min' END AS gap_bucket,
       count(*) AS calls, {pc('count(*)', f'(SELECT count(*) FROM {GAP})')} AS pct_of_calls, {n_if('broke')} AS breaks, {pc(n_if('broke'), 'count(*)')} AS break_rate_pct,
       sum(made) AS recached_tokens, {s_if('broke', 'made')} AS recached_tokens_on_breaks, sum({WR}) AS cache_write_usd, {s_if('broke', WR)} AS cache_write_usd_on_breaks,
       median(gap) AS median_gap_min FROM {GAP} GROUP BY 1"""
SQL["t02_break_rate_fine_grained"] = f"""
SELECT CASE WHEN gap_ms >= 18000000 THEN '7. >5 h' WHEN gap_ms >= 3600000 THEN '6. 1-5 h' WHEN gap_ms >= 1200000 THEN '5. 20-60 min' WHEN gap_ms >= 300000 THEN '4. 5-20 min'
            WHEN gap_ms >= 60000 THEN '3. 1-5 min' WHEN gap_ms >= 15000 THEN '2. 15-60 s' ELSE '1. <15 s' END AS gap_bucket,
       count(*) AS calls, {pc(n_if('broke'), 'count(*)')} AS break_rate_pct, sum({WR}) AS cache_write_usd FROM {GAP} GROUP BY 1"""
SQL["t02_ttl_era_by_month"] = f"""
SELECT mon AS month, count(*) AS calls, sum(w5) AS cache_write_5m_tokens, sum(w60) AS cache_write_1h_tokens, {pc('sum(w60)', 'sum(w5) + sum(w60)')} AS pct_tokens_1h,
       sum({WR}) AS cache_write_usd, {pc(n_if('broke'), 'count(*)')} AS break_rate_pct FROM {GAP} GROUP BY mon"""
SQL["t02_gap_gt_5min_by_month"] = f"""
SELECT mon AS month, {n_if('gap_ms > 300000')} AS calls_after_gap_gt_5min, {s_if('gap_ms > 300000', WR)} AS cache_write_usd_after_gap_gt_5min,
       {pc(s_if('gap_ms > 300000', WR), f'sum({WR})')} AS pct_of_month_cache_write_usd FROM {GAP} GROUP BY mon"""
SQL["t02_headline"] = f"""
SELECT {s_if('gap_ms > 300000', WR)} AS usd_recached_after_gap_gt_5min, {pc(s_if('gap_ms > 300000', WR), f'(SELECT sum({WR}) FROM b_bill)')} AS pct_of_all_cache_write_usd,
       {pc(s_if('gap_ms > 300000', WR), ALL_USD)} AS pct_of_total_usd, {pc(n_if('broke AND gap_ms < 60000'), n_if('gap_ms < 60000'))} AS break_rate_pct_gap_lt_1min,
       {pc(n_if('broke AND gap_ms > 3600000'), n_if('gap_ms > 3600000'))} AS break_rate_pct_gap_gt_60min, {s_if('gap_ms > 300000', 'made')} AS recached_tokens_after_gap_gt_5min FROM {GAP}"""

SEEN = """(SELECT t.*, EXISTS (SELECT 1 FROM b_use o WHERE o.session_id = t.session_id AND o.result_hash = t.result_hash AND o.result_chars > 0 AND o.seq < t.seq) AS again
 FROM b_use t WHERE t.result_hash IS NOT NULL AND t.result_chars > 0) t"""
_AG, _ACH = n_if("again"), s_if("again", "result_chars")
SQL["t03_by_agent"] = f"""
SELECT agent, count(*) AS tool_results, {_AG} AS repeated_results, {pc(_AG, 'count(*)')} AS pct_results_repeated, sum(result_chars) AS result_chars, {_ACH} AS repeated_chars,
       {pc(_ACH, 'sum(result_chars)')} AS pct_chars_repeated FROM {SEEN} GROUP BY agent"""
SQL["t03_by_tool_kind"] = f"""
SELECT agent, tool_kind, count(*) AS tool_results, {_AG} AS repeated_results, {pc(_AG, 'count(*)')} AS pct_results_repeated, {_ACH} AS repeated_chars,
       {pc(_ACH, 'sum(result_chars)')} AS pct_chars_repeated FROM {SEEN} GROUP BY agent, tool_kind HAVING count(*) >= 100"""
SQL["t03_usd_by_agent"] = f"""
SELECT agent, {_ACH} AS repeated_chars, {_ACH} / 4.0E0 AS repeated_tokens, {s_if('again', 'result_chars / 4.0E0 * pin / 1e6')} AS usd_lower_bound,
       {s_if('again', 'result_chars / 4.0E0 * pread / 1e6')} AS usd_if_cached_once FROM {SEEN} GROUP BY agent"""
SQL["t03_top_repeated_bash_commands"] = f"""
SELECT left(command_head, 90) AS command_head_90, {_AG} AS repeated_occurrences, count(DISTINCT session_id) AS sessions, {_ACH} AS repeated_chars
FROM {SEEN} WHERE tool_kind = 'bash' AND command_head IS NOT NULL GROUP BY command_head HAVING bool_or(again) ORDER BY 2 DESC, 1 LIMIT 20"""
SQL["t03_top_repeated_files"] = f"""
SELECT left(file_path, 90) AS file_path_90, tool_kind, {_AG} AS repeated_occurrences, count(DISTINCT session_id) AS sessions, {_ACH} AS repeated_chars
FROM {SEEN} WHERE tool_kind = 'read' AND file_path IS NOT NULL GROUP BY file_path, 2 HAVING bool_or(again) ORDER BY 5 DESC, 1 LIMIT 20"""
SQL["t03_worst_offender_sessions"] = f"""
SELECT a.session_id, a.agent, a.r AS repeated_results, a.ch AS repeated_chars, b.m AS max_times_same_result
FROM (SELECT session_id, agent, {_AG} AS r, {_ACH} AS ch FROM {SEEN} GROUP BY session_id, agent) a
JOIN (SELECT session_id, max(k) AS m FROM (SELECT session_id, result_hash, count(*) AS k FROM {SEEN} GROUP BY ALL) GROUP BY session_id) b ON b.session_id = a.session_id
ORDER BY a.ch DESC NULLS LAST, a.session_id LIMIT 20"""
SQL["t03_headline"] = f"""
SELECT {pc(_ACH, 'sum(result_chars)')} AS pct_of_tool_result_chars_exact_repeats, {_AG} AS repeated_tool_results, {pc(_AG, 'count(*)')} AS pct_of_tool_results_repeated,
       {_ACH} AS repeated_chars, {s_if('again', 'result_chars / 4.0E0 * pin / 1e6')} AS usd_lower_bound_fresh_input FROM {SEEN}"""

RENT = """(SELECT *, later * result_chars / 4.0E0 AS rtok, later * result_chars / 4.0E0 * pread / 1e6 AS rusd
 FROM (SELECT *, CASE WHEN s_calls > nc THEN s_calls - nc ELSE 0 END AS later FROM b_use WHERE result_chars > 0)) r"""
RSUM = "sum(result_chars) AS result_chars, avg(later) AS avg_later_calls, sum(rtok) AS rent_tokens, sum(rusd) AS rent_usd"
SQL["t04_by_tool_kind"] = f"SELECT agent, tool_kind, count(*) AS tool_results, {RSUM} FROM {RENT} GROUP BY agent, tool_kind ORDER BY sum(rusd) DESC NULLS LAST, 1, 2"
SQL["t04_by_result_size_bucket"] = f"""
SELECT CASE WHEN result_chars >= 50000 THEN '4. >50k' WHEN result_chars >= 10000 THEN '3. 10-50k' WHEN result_chars >= 1000 THEN '2. 1-10k' ELSE '1. <1k' END AS size_bucket,
       count(*) AS tool_results, {pc('count(*)', f'(SELECT count(*) FROM {RENT})')} AS pct_of_results, {RSUM},
       {pc('sum(result_chars)', f'(SELECT sum(result_chars) FROM {RENT})')} AS pct_of_result_chars, {pc('sum(rusd)', f'(SELECT sum(rusd) FROM {RENT})')} AS pct_of_rent_usd FROM {RENT} GROUP BY 1"""
SQL["t04_rent_vs_actual_cache_read"] = f"""
SELECT x.agent, x.t AS rent_tokens, y.t AS cache_read_tokens, {pc('x.t', 'y.t')} AS pct_of_cache_read_tokens, x.u AS rent_usd, y.u AS cache_read_usd, {pc('x.u', 'y.u')} AS pct_of_cache_read_usd
FROM (SELECT agent, sum(rtok) AS t, sum(rusd) AS u FROM {RENT} GROUP BY agent) x
JOIN (SELECT agent, ifnull(sum(cache_read_tokens), 0) AS t, ifnull(sum(u_read), 0) AS u FROM b_bill GROUP BY agent) y ON x.agent = y.agent"""
SQL["t04_top20_single_results_by_rent"] = f"""
SELECT session_id, seq, agent, tool_kind, ifnull(left(command_head, 70), left(file_path, 70)) AS what, result_chars, later AS later_calls, rtok AS rent_tokens, rusd AS rent_usd
FROM {RENT} ORDER BY rusd DESC NULLS LAST, session_id, seq LIMIT 20"""
SQL["t04_headline"] = f"""
SELECT {pc(s_if("agent = 'claude_code'", 'rtok'), "(SELECT sum(cache_read_tokens) FROM b_bill WHERE agent = 'claude_code')")} AS pct_of_claude_code_cache_read_tokens_from_tool_results,
       {s_if("agent = 'claude_code'", 'rusd')} AS rent_usd_claude_code, sum(rusd) AS rent_usd_all_agents_upper_bound, {s_if('result_chars > 10000', 'rusd')} AS rent_usd_from_results_over_10k_chars,
       {pc(s_if('result_chars > 10000', 'rusd'), 'sum(rusd)')} AS pct_of_rent_from_results_over_10k, {pc(n_if('result_chars > 10000'), 'count(*)')} AS pct_of_results_over_10k_chars,
       sum(rtok) AS rent_tokens_all_agents_upper_bound FROM {RENT}"""

CONT = f"""(SELECT m.*, ifnull(u_in, 0) + ifnull(u_read, 0) + {WR} AS side_usd, ifnull(stop_reason IN ('length', 'max_tokens'), false) AS cut,
        lead(ifnull(u_in, 0) + ifnull(u_read, 0) + {WR}) OVER w AS nusd, lead(ctx) OVER w AS nctx FROM b_main m WINDOW w AS (PARTITION BY session_id ORDER BY pos)) m"""
SQL["t06_by_agent"] = f"""
SELECT agent, count(*) AS calls, {n_if('cut')} AS truncated_calls, {pc(n_if('cut'), 'count(*)')} AS pct_calls_truncated, {s_if('cut', 'nusd')} AS usd_of_continuation_input,
       {s_if('cut', 'nctx')} AS continuation_ctx_tokens FROM {CONT} GROUP BY agent"""
SQL["t06_by_model"] = f"""
SELECT model, stop_reason, count(*) AS truncated_calls, count(DISTINCT session_id) AS sessions, avg(output_tokens) AS avg_output_tokens, sum(nusd) AS usd_of_continuation_input
FROM {CONT} WHERE cut GROUP BY model, stop_reason"""
SQL["t06_stop_reason_distribution"] = """
SELECT a.agent, a.stop_reason, a.k AS calls, 100.0E0 * a.k / (SELECT count(*) FROM b_main m WHERE m.agent = a.agent) AS pct_of_agent_calls
FROM (SELECT agent, stop_reason, count(*) AS k FROM b_main GROUP BY agent, stop_reason) a"""
SQL["t06_headline"] = f"""
SELECT {n_if('cut')} AS truncated_calls, {pc(n_if('cut'), 'count(*)')} AS pct_of_all_calls_truncated, count(DISTINCT CASE WHEN cut THEN session_id END) AS sessions_affected,
       {s_if('cut', 'nusd')} AS usd_paid_to_resume_after_truncation, {pc(f"ifnull({s_if('cut', 'nusd')}, 0)", ALL_USD)} AS pct_of_total_usd FROM {CONT}"""

EDGE = """(SELECT e.*, ifnull(e.subtype, 'compacted') AS what, p.nt FROM b_meta e JOIN b_pos p ON p.session_id = e.session_id AND p.seq = e.seq
 WHERE e.event_type = 'compacted' OR e.event_type = 'system' AND e.subtype IN ('compact_boundary', 'microcompact_boundary')) b"""
NEAR = f"""(SELECT b.agent, b.what, r.session_id, r.file_path, ifnull(r.result_chars, 0) AS ch, ifnull(r.result_chars, 0) / 4e6 * r.pread AS once, ifnull(r.result_chars, 0) / 4e6 * ifnull(r.p5, r.pread) AS twice,
        EXISTS (SELECT 1 FROM b_tools x WHERE x.session_id = r.session_id AND x.tool_kind = 'read' AND x.file_path = r.file_path AND x.seq < b.seq) AS known_path
 FROM {EDGE} JOIN b_use r ON r.session_id = b.session_id AND r.nt - b.nt BETWEEN 1 AND 20 WHERE r.tool_kind = 'read' AND r.file_path IS NOT NULL) y"""
SQL["t19_boundaries_by_subtype"] = f"SELECT agent, what AS event_kind, count(*) AS boundaries, count(DISTINCT session_id) AS sessions FROM {EDGE} GROUP BY agent, what"
SQL["t19_sessions_with_compaction"] = f"""
SELECT s.agent, count(*) AS sessions, count(k.k) AS sessions_with_a_boundary, {pc('count(k.k)', 'count(*)')} AS pct_sessions_compacted, median(k.k) AS median_boundaries_when_present,
       max(k.k) AS max_boundaries, {s_if('k.k IS NOT NULL', 's.cost')} AS usd_in_compacted_sessions
FROM b_live s LEFT JOIN (SELECT session_id, count(*) AS k FROM {EDGE} GROUP BY session_id) k ON k.session_id = s.session_id GROUP BY s.agent"""
_KP = "known_path"
SQL["t19_rereads_after_boundary"] = f"""
SELECT agent, what AS event_kind, count(*) AS reads_in_next_20_tool_calls, {n_if(_KP)} AS reads_of_already_seen_paths, {pc(n_if(_KP), 'count(*)')} AS pct_rereads, {s_if(_KP, 'ch')} AS reread_chars,
       {s_if(_KP, 'once')} AS reread_usd_one_pass, {s_if(_KP, 'twice')} AS reread_usd_recached FROM {NEAR} GROUP BY agent, what"""
SQL["t19_top_reread_files"] = f"""
SELECT left(file_path, 80) AS file_path_80, count(*) AS rereads_after_a_boundary, count(DISTINCT session_id) AS sessions, sum(ch) AS chars FROM {NEAR} WHERE {_KP} GROUP BY file_path ORDER BY 2 DESC, 1 LIMIT 20"""
SQL["t19_headline"] = f"""
SELECT (SELECT count(*) FROM {EDGE}) AS compaction_boundaries, (SELECT count(DISTINCT session_id) FROM {EDGE}) AS sessions_with_a_boundary,
       count(*) AS reads_in_the_20_tool_calls_after_a_boundary, {pc(n_if(_KP), 'count(*)')} AS pct_of_those_reads_already_seen, {s_if(_KP, 'ch')} AS reread_chars,
       {s_if(_KP, 'once')} AS usd_of_the_rereads_first_pass_only, {s_if(_KP, 'twice')} AS usd_of_the_rereads_at_cache_write_price FROM {NEAR}"""

VISIT = """(SELECT v.*, ifnull(v.result_chars, 0) AS ch,
   (SELECT max(o.nc) FROM b_use o WHERE o.session_id = v.session_id AND o.file_path = v.file_path AND o.tool_kind IN ('write', 'edit') AND o.seq < v.seq) AS touched,
   (SELECT count(*) FROM b_use o WHERE o.session_id = v.session_id AND o.file_path = v.file_path AND o.tool_kind IN ('read', 'write', 'edit') AND o.seq < v.seq) AS before,
   (SELECT max(o.result_chars) FROM b_use o WHERE o.session_id = v.session_id AND o.file_path = v.file_path AND o.tool_kind = 'read' AND o.seq < v.seq) AS biggest
 FROM b_use v WHERE v.file_path IS NOT NULL AND v.tool_kind IN ('read', 'write', 'edit')) v"""
BACK = "nc - touched BETWEEN 0 AND 5"
READS = f"(SELECT * FROM {VISIT} WHERE tool_kind = 'read') v"
CHURN = """(SELECT e.*, (SELECT count(*) FROM b_use o WHERE o.session_id = e.session_id AND o.file_path = e.file_path AND o.tool_kind IN ('write', 'edit') AND o.nc BETWEEN e.nc - 10 AND e.nc) AS burst
 FROM b_use e WHERE e.tool_kind IN ('write', 'edit') AND e.file_path IS NOT NULL) e"""
SQL["t20_self_rereads"] = f"""
SELECT agent, count(*) AS reads, {n_if(BACK)} AS reads_within_5_calls_of_a_write, {pc(n_if(BACK), 'count(*)')} AS pct_of_reads, {s_if(BACK, 'ch')} AS reread_chars,
       {s_if(BACK, 'ch / 4e6 * pin')} AS usd_fresh_input_price FROM {READS} GROUP BY agent"""
SQL["t20_edit_thrash"] = f"""
SELECT agent, count(*) AS edits, {n_if('burst > 2')} AS edits_in_a_thrash_window, {pc(n_if('burst > 2'), 'count(*)')} AS pct_of_edits,
       count(DISTINCT CASE WHEN burst > 2 THEN concat(session_id, ' ', file_path) END) AS distinct_thrashed_files FROM {CHURN} GROUP BY agent"""
SQL["t20_top_thrashed_files"] = f"""
SELECT left(file_path, 80) AS file_path_80, max(agent) AS agent, count(*) AS edits_in_thrash_windows, count(DISTINCT session_id) AS sessions, max(burst) AS worst_burst
FROM {CHURN} WHERE burst > 2 GROUP BY file_path ORDER BY 3 DESC, 1 LIMIT 20"""
SQL["t20_headline"] = f"""
SELECT {n_if(BACK)} AS reads_of_a_just_written_file, {pc(n_if(BACK), 'count(*)')} AS pct_of_all_reads, {s_if(BACK, 'ch')} AS reread_chars, {s_if(BACK, 'ch / 4e6 * pin')} AS usd_at_fresh_input_price,
       (SELECT {n_if('burst > 2')} FROM {CHURN}) AS edits_inside_a_thrash_window, (SELECT {pc(n_if('burst > 2'), 'count(*)')} FROM {CHURN}) AS pct_of_edits_in_thrash FROM {READS}"""

# ---- tooling --------------------------------------------------------------------

FILES = f"""(SELECT t.*, ifnull(t.is_error, false) AND regexp_matches(t.error_head, '{MISSING}') AS gone,
        ifnull((SELECT m.spent FROM b_main m WHERE m.session_id = t.session_id AND m.pos = least(t.nc + 3, t.s_calls)) - t.spent, 0) AS then3
 FROM b_use t WHERE t.tool_kind IN ('edit', 'read', 'write')) t"""
SQL["t07_by_agent"] = f"""
SELECT agent, count(*) AS file_tool_calls, {n_if('gone')} AS missing_path_errors, {pc(n_if('gone'), 'count(*)')} AS pct_missing_path, count(DISTINCT CASE WHEN gone THEN session_id END) AS sessions_affected,
       {s_if('gone', 'then3')} AS usd_of_next_3_calls FROM {FILES} GROUP BY agent"""
SQL["t07_by_model"] = f"""
SELECT s_model AS model, count(*) AS file_tool_calls, {n_if('gone')} AS missing_path_errors, {pc(n_if('gone'), 'count(*)')} AS pct_missing_path, {s_if('gone', 'then3')} AS usd_of_next_3_calls
FROM {FILES} GROUP BY s_model HAVING count(*) >= 50"""
SQL["t07_by_tool_kind"] = f"""
SELECT agent, tool_kind, count(*) AS calls, {n_if('gone')} AS missing_path_errors, {pc(n_if('gone'), 'count(*)')} AS pct_missing_path FROM {FILES} GROUP BY agent, tool_kind"""
SQL["t07_top_missing_paths"] = f"""
SELECT left(file_path, 80) AS file_path_80, count(*) AS errors, count(DISTINCT session_id) AS sessions FROM {FILES} WHERE gone AND file_path IS NOT NULL GROUP BY file_path ORDER BY 2 DESC, 1 LIMIT 20"""
SQL["t07_headline"] = f"""
SELECT {n_if('gone')} AS missing_path_errors, {pc(n_if('gone'), 'count(*)')} AS pct_of_file_tool_calls, count(DISTINCT CASE WHEN gone THEN session_id END) AS sessions_affected,
       {s_if('gone', 'then3')} AS usd_of_the_next_3_calls_after_the_error, {pc(s_if('gone', 'then3'), ALL_USD)} AS pct_of_total_usd FROM {FILES}"""

RITE = "(SELECT *, tool_kind IN ('task', 'todo') AS rite, ifnull(input_chars, 0) / 4.0E0 AS ctok, ifnull(input_chars, 0) / 4e6 * pout AS cusd FROM b_use) t"
SQL["t08_by_agent"] = f"""
SELECT agent, count(*) AS tool_calls, {n_if('rite')} AS ceremony_calls, {pc(n_if('rite'), 'count(*)')} AS pct_of_tool_calls, {s_if("tool_kind = 'todo'", 'ctok')} AS todo_tokens,
       {s_if("tool_kind = 'task'", 'ctok')} AS task_tokens, {s_if('rite', 'cusd')} AS ceremony_usd FROM {RITE} GROUP BY agent"""
SQL["t08_sessions_with_vs_without"] = f"""
SELECT mode, CASE WHEN EXISTS (SELECT 1 FROM b_tools t WHERE t.session_id = s.session_id AND t.tool_kind IN ('task', 'todo')) THEN 'uses todo/task' ELSE 'no todo/task' END AS kind,
       count(*) AS sessions, {pc(HIT, 'count(*)')} AS pct_sessions_with_commits, sum(cost) AS usd, sum(lines_) AS committed_lines, {UPL} AS usd_per_committed_line
FROM b_sess s WHERE tools > 0 GROUP BY 1, 2"""
SQL["t08_by_agent_and_kind"] = f"""
SELECT agent, tool_kind, count(*) AS calls, sum(ctok) AS tokens, sum(cusd) AS usd, median(input_chars) AS median_input_chars FROM {RITE} WHERE rite GROUP BY agent, tool_kind"""
SQL["t08_headline"] = f"""
SELECT {n_if('rite')} AS ceremony_tool_calls, {pc(n_if('rite'), 'count(*)')} AS pct_of_all_tool_calls, {s_if('rite', 'ctok')} AS output_tokens_spent_on_ceremony, {s_if('rite', 'cusd')} AS ceremony_usd,
       {pc(s_if('rite', 'cusd'), ALL_OUT)} AS pct_of_all_output_usd FROM {RITE}"""

WAIT = f"""(SELECT t.*, regexp_matches(command_head, '{POLL}') AS waits FROM b_use t WHERE tool_kind = 'bash' AND command_head IS NOT NULL) t"""
POLLS = f"""(SELECT p.*, m.cost AS cusd, m.ctx AS cctx, (SELECT count(*) FROM {WAIT.replace(') t', ') o')} WHERE o.waits AND o.session_id = p.session_id AND o.nc BETWEEN p.nc AND p.nc + 4) AS burst
 FROM {WAIT.replace(') t', ') p')} LEFT JOIN b_main m ON m.session_id = p.session_id AND m.pos = p.nc WHERE p.waits) p"""
SQL["t09_by_agent"] = f"""
SELECT a.agent, a.k AS bash_calls, b.k AS polling_calls, {pc('b.k', 'a.k')} AS pct_of_bash_calls, b.s AS sessions, b.u AS usd_of_the_calls_that_issued_them, b.x AS ctx_tokens
FROM (SELECT agent, count(*) AS k FROM {WAIT} GROUP BY agent) a JOIN (SELECT agent, count(*) AS k, count(DISTINCT session_id) AS s, sum(cusd) AS u, sum(cctx) AS x FROM {POLLS} GROUP BY agent) b ON a.agent = b.agent"""
SQL["t09_polling_sequences"] = f"""
SELECT CASE least(burst, 4) WHEN 4 THEN '4+ polls in 5 calls' WHEN 3 THEN '3 polls in 5 calls' WHEN 2 THEN '2 polls in 5 calls' ELSE 'isolated' END AS burst, count(*) AS polling_calls,
       sum(cusd) AS usd, sum(cctx) AS ctx_tokens FROM {POLLS} GROUP BY 1"""
SQL["t09_top_polling_commands"] = f"""
SELECT left(command_head, 80) AS command_head_80, count(*) AS polling_calls, count(DISTINCT session_id) AS sessions, sum(cusd) AS usd FROM {POLLS} GROUP BY command_head ORDER BY 2 DESC, 1 LIMIT 20"""
SQL["t09_headline"] = f"""
SELECT count(*) AS polling_bash_calls, {pc('count(*)', f'(SELECT count(*) FROM {WAIT})')} AS pct_of_all_bash_calls, count(DISTINCT session_id) AS sessions_that_poll, sum(cusd) AS usd_of_calls_that_issued_a_poll,
       {n_if('burst > 1')} AS polls_inside_a_burst, {s_if('burst > 1', 'cusd')} AS usd_in_bursts, {pc('sum(cusd)', ALL_USD)} AS pct_of_total_usd FROM {POLLS}"""

FULL = f"""(SELECT *, before > 0 AS had, content_chars / 4.0E0 AS wtok, content_chars / 4e6 * pout AS wusd, CAST(content_chars AS DOUBLE) / nullif(biggest, 0) AS grow,
        CASE WHEN input_chars IS NOT NULL AND content_chars > 100 THEN CAST(input_chars - content_chars - 40 AS DOUBLE) / content_chars END AS extra
 FROM {VISIT} WHERE tool_kind = 'write' AND content_chars > 0) f"""
SQL["t10_writes_on_known_files"] = f"""
SELECT agent, count(*) AS writes, {n_if('had')} AS writes_on_known_files, {pc(n_if('had'), 'count(*)')} AS pct_writes_on_known_files, {s_if('had', 'wtok')} AS output_tokens_on_known_files,
       {s_if('had', 'wusd')} AS usd_on_known_files, sum(wusd) AS usd_all_writes FROM {FULL} GROUP BY agent"""
SQL["t10_rewrite_ratio_distribution"] = f"""
SELECT CASE WHEN grow > 1.1 THEN '4. bigger than what was read' WHEN grow >= 0.9 THEN '3. ~same size (90-110%)' WHEN grow >= 0.25 THEN '2. 25-90%' WHEN grow >= 0 THEN '1. <25% of the file'
            ELSE '0. no earlier read' END AS bucket, count(*) AS writes, sum(wtok) AS content_tokens, sum(wusd) AS usd, median(content_chars) AS median_content_chars FROM {FULL} WHERE had GROUP BY 1"""
_BQ = "old_string_chars > 1500"
_QC = "ifnull(old_string_chars, 0) / 4e6 * pout"
SQL["t10_big_old_string_edits"] = f"""
SELECT agent, count(*) AS edits, {n_if(_BQ)} AS edits_old_string_over_1500, {pc(n_if(_BQ), 'count(*)')} AS pct, {s_if(_BQ, 'old_string_chars')} AS old_string_chars, {s_if(_BQ, _QC)} AS usd_old_string,
       sum({_QC}) AS usd_old_string_all_edits FROM b_use WHERE tool_kind = 'edit' AND file_path IS NOT NULL GROUP BY agent"""
SQL["t10_json_overhead_for_writes"] = f"""
SELECT agent, count(*) AS writes, median(extra) AS median_json_overhead_ratio, quantile_cont(extra, 0.9) AS p90_json_overhead_ratio, sum(input_chars - content_chars) / 4.0E0 AS extra_tokens_vs_bare_content
FROM {FULL} WHERE extra IS NOT NULL GROUP BY agent"""
SQL["t10_top_rewritten_files"] = f"""
SELECT left(file_path, 80) AS file_path_80, max(agent) AS agent, count(*) AS writes_on_known_file, sum(content_chars) AS content_chars, sum(wusd) AS usd FROM {FULL} WHERE had GROUP BY file_path
ORDER BY sum(wusd) DESC NULLS LAST, 1 LIMIT 20"""
SQL["t10_headline"] = f"""
SELECT {s_if('had', 'wusd')} AS usd_output_writes_to_files_already_in_context, {pc(s_if('had', 'wusd'), ALL_OUT)} AS pct_of_all_output_usd, {n_if('had')} AS writes_on_known_files,
       {pc(n_if('had'), 'count(*)')} AS pct_of_writes_on_known_files, {s_if('had', 'wtok')} AS output_tokens_rewritten,
       (SELECT sum({_QC}) FROM b_use WHERE tool_kind = 'edit' AND {_BQ}) AS usd_old_string_quotes_over_1500_chars, median(extra) AS median_json_overhead_ratio FROM {FULL}"""

EDITS = """(SELECT e.*, EXISTS (SELECT 1 FROM b_use o WHERE o.session_id = e.session_id AND o.is_error AND o.nt - e.nt IN (1, 2, 3)) AS err3,
        ifnull((SELECT arg_min(a.human_chars, a.seq) FROM b_asked a WHERE a.session_id = e.session_id AND a.seq >= e.seq) < 200, false) AS short_
 FROM b_use e WHERE e.tool_kind IN ('write', 'edit') AND e.file_path IS NOT NULL) e"""
PATHS = f"""(SELECT repo, file_path, max(agent) AS agent, count(*) AS k, count(DISTINCT session_id) AS s, count(DISTINCT who) AS u, {n_if('err3')} AS e3, {n_if('short_')} AS sh FROM {EDITS} GROUP BY repo, file_path) f"""
RANKS = f"(SELECT *, percent_rank() OVER (PARTITION BY repo ORDER BY k DESC) AS pr FROM {PATHS}) f"
HEAT = "CASE WHEN s < 10 THEN 'cold (<10 sessions)' ELSE 'hot (>=10 sessions)' END"
SQL["t14_top30_hot_files"] = f"""
SELECT repo, left(file_path, 70) AS file_path_70, agent, s AS sessions, u AS users, k AS edits, {pc('e3', 'k')} AS pct_edits_followed_by_error, {pc('sh', 'k')} AS pct_edits_followed_by_short_correction
FROM (SELECT *, sum(s) OVER (PARTITION BY repo) AS busy FROM {PATHS}) WHERE busy >= 20 ORDER BY s DESC, k DESC, repo, file_path LIMIT 30"""
SQL["t14_concentration_by_repo"] = f"""
SELECT repo, count(*) AS files, sum(k) AS edits, {pc(s_if('pr < 0.05', 'k'), 'sum(k)')} AS pct_of_edits_in_top_5pct_of_files, {pc(s_if('pr < 0.2', 'k'), 'sum(k)')} AS pct_of_edits_in_top_20pct_of_files
FROM {RANKS} GROUP BY repo HAVING count(*) >= 3 ORDER BY 3 DESC, 1"""
SQL["t14_hot_vs_cold"] = f"""
SELECT {HEAT} AS heat, count(*) AS files, sum(k) AS edits, {pc('sum(k)', f'(SELECT count(*) FROM {EDITS})')} AS pct_of_all_edits, avg({pc('e3', 'k')}) AS avg_pct_edits_followed_by_error,
       avg({pc('sh', 'k')}) AS avg_pct_edits_followed_by_short_correction, median(k) AS median_edits_per_file FROM {PATHS} GROUP BY 1"""
SQL["t14_hot_vs_cold_weighted"] = f"""
SELECT {HEAT} AS heat, count(*) AS edits, {pc(n_if('err3'), 'count(*)')} AS pct_edits_followed_by_error, {pc(n_if('short_'), 'count(*)')} AS pct_edits_followed_by_short_correction
FROM {EDITS} JOIN (SELECT repo AS r, file_path AS p, s FROM {PATHS}) q ON q.r = e.repo AND q.p = e.file_path GROUP BY 1"""
SQL["t14_edits_by_agent"] = f"""
SELECT agent, count(*) AS edits, {pc(n_if('err3'), 'count(*)')} AS pct_edits_followed_by_error, {pc(n_if('short_'), 'count(*)')} AS pct_edits_followed_by_short_correction FROM {EDITS} GROUP BY agent"""
SQL["t14_headline"] = f"""
SELECT {n_if('s >= 10')} AS hot_files, {pc(s_if('s >= 10', 'k'), 'sum(k)')} AS pct_of_edits_on_hot_files,
       (SELECT median(x) FROM (SELECT {pc(s_if('pr < 0.05', 'k'), 'sum(k)')} AS x FROM {RANKS} GROUP BY repo HAVING sum(k) >= 50)) AS median_repo_share_of_edits_in_top_5pct_of_files,
       {pc(s_if('s >= 10', 'e3'), s_if('s >= 10', 'k'))} AS pct_hot_file_edits_followed_by_error, {pc(s_if('s < 10', 'e3'), s_if('s < 10', 'k'))} AS pct_cold_file_edits_followed_by_error,
       sum(k) AS edits_total FROM {PATHS}"""

_SD = "is_sidechain"
SQL["t16_sidechain_share"] = f"""
SELECT agent, count(*) AS calls, {n_if(_SD)} AS sidechain_calls, {pc(n_if(_SD), 'count(*)')} AS pct_calls_sidechain, ifnull(sum(cost), 0) AS usd, {s_if(_SD, 'ifnull(cost, 0)')} AS sidechain_usd,
       {pc(s_if(_SD, 'ifnull(cost, 0)'), 'sum(cost)')} AS pct_usd_sidechain FROM b_bill GROUP BY agent"""
HAS_TASK = "EXISTS (SELECT 1 FROM b_tools t WHERE t.session_id = s.session_id AND t.tool_kind = 'task')"
SQL["t16_sessions_with_vs_without"] = f"""
SELECT CASE WHEN side > 0 THEN 'has sidechain calls' WHEN {HAS_TASK} THEN 'uses the task tool' ELSE 'no subagents' END AS kind, mode, count(*) AS sessions, sum(cost) AS usd,
       {pc(HIT, 'count(*)')} AS pct_sessions_with_commits, sum(lines_) AS committed_lines, {UPL} AS usd_per_committed_line, median(cost) AS median_session_usd
FROM b_live s WHERE agent = 'claude_code' GROUP BY 1, 2"""
SQL["t16_task_tool_usage"] = """
SELECT agent, count(*) AS task_calls, count(DISTINCT session_id) AS sessions, ifnull(sum(result_chars), 0) AS result_chars, median(result_chars) AS median_result_chars,
       sum(ifnull(input_chars, 0) / 4e6 * pout) AS usd_of_the_task_prompts FROM b_use WHERE tool_kind = 'task' GROUP BY agent"""
SQL["t16_headline"] = f"""
SELECT count(*) AS sidechain_calls, sum(ifnull(cost, 0)) AS sidechain_usd, {pc(s_if("agent = 'claude_code'", 'cost'), "(SELECT sum(cost) FROM b_bill WHERE agent = 'claude_code')")} AS pct_of_claude_code_usd,
       (SELECT count(*) FROM b_tools WHERE tool_kind = 'task') AS task_tool_calls, (SELECT sum(result_chars) FROM b_tools WHERE tool_kind = 'task') AS task_result_chars,
       (SELECT count(DISTINCT session_id) FROM b_tools WHERE tool_kind = 'task') AS sessions_using_task FROM b_bill WHERE is_sidechain"""

PERM = """(SELECT s.*, ifnull((SELECT arg_max(value, (k, -ord)) FROM (SELECT value, count(*) AS k, dense_rank() OVER (ORDER BY value) AS ord FROM b_meta m
          WHERE m.session_id = s.session_id AND m.event_type = 'permission-mode' AND value IS NOT NULL GROUP BY value)), 'no permission-mode events') AS pm FROM b_live s WHERE agent = 'claude_code') s"""
_ER = pc("sum(bad)", "sum(tools)")
SQL["t17_by_permission_mode"] = f"""
SELECT pm AS permission_mode, count(*) AS sessions, sum(cost) AS usd, sum(lines_) AS committed_lines, {UPL} AS usd_per_committed_line, {_ER} AS tool_error_rate_pct,
       {rt('sum(tools)', 'sum(lines_)')} AS tool_calls_per_committed_line, {pc(HIT, 'count(*)')} AS pct_sessions_with_commits, median(cost) AS median_session_usd FROM {PERM} GROUP BY pm"""
SQL["t17_by_permission_mode_and_mode"] = f"""
SELECT pm AS permission_mode, mode, count(*) AS sessions, sum(cost) AS usd, {UPL} AS usd_per_committed_line, {_ER} AS tool_error_rate_pct FROM {PERM} GROUP BY pm, mode HAVING count(*) >= 2"""
SQL["t17_headline"] = f"""
WITH a AS (SELECT pm, count(*) AS k, sum(cost) AS c, {UPL} AS u, {_ER} AS e FROM {PERM} GROUP BY pm HAVING count(*) >= 5)
SELECT max(k) FILTER (pm = 'bypassPermissions') AS sessions_on_bypass, max(c) FILTER (pm = 'bypassPermissions') AS usd_on_bypass, max(u) FILTER (pm = 'bypassPermissions') AS usd_per_committed_line_bypass,
       max(u) FILTER (pm = 'default') AS usd_per_committed_line_default, max(e) FILTER (pm = 'bypassPermissions') AS tool_error_rate_pct_bypass, max(e) FILTER (pm = 'default') AS tool_error_rate_pct_default FROM a"""

STOPS = """(SELECT i.session_id, i.agent, greatest(p.spent - ifnull(q.spent, 0), 0) AS sunk, p.nc - ifnull(q.nc, 0) AS wasted
 FROM (SELECT t.*, (SELECT max(a.seq) FROM b_asked a WHERE a.session_id = t.session_id AND a.seq < t.seq) AS prev FROM b_turns t WHERE t.is_interrupt) i
 JOIN b_pos p ON p.session_id = i.session_id AND p.seq = i.seq LEFT JOIN b_pos q ON q.session_id = i.session_id AND q.seq = i.prev) i"""
SQL["t18_interrupts_by_agent"] = f"""
SELECT agent, count(*) AS interrupts, count(DISTINCT session_id) AS sessions_with_interrupts, sum(sunk) AS sunk_usd, median(sunk) AS median_sunk_usd, median(wasted) AS median_sunk_calls,
       {pc('sum(sunk)', ALL_USD)} AS pct_of_total_usd FROM {STOPS} GROUP BY agent"""
SQL["t18_queue_operations"] = """
SELECT agent, count(DISTINCT session_id) AS sessions_with_queue_events, count(*) AS queue_events, median(k) AS median_queue_events_per_session
FROM (SELECT agent, session_id, count(*) OVER (PARTITION BY session_id) AS k FROM b_meta WHERE event_type = 'queue-operation') GROUP BY agent"""
SQL["t18_sessions_with_vs_without_interrupts"] = f"""
SELECT CASE stops WHEN 0 THEN 'never interrupted' ELSE 'interrupted' END AS kind, mode, count(*) AS sessions, sum(cost) AS usd, sum(lines_) AS committed_lines, {UPL} AS usd_per_committed_line,
       median(n) AS median_calls, {pc(HIT, 'count(*)')} AS pct_sessions_with_commits FROM b_live WHERE agent = 'claude_code' GROUP BY 1, 2"""
SQL["t18_headline"] = f"""
SELECT count(*) AS interrupts, count(DISTINCT session_id) AS sessions_with_at_least_one_interrupt, sum(sunk) AS usd_sunk_before_interrupts, {pc('sum(sunk)', ALL_USD)} AS pct_of_total_usd,
       (SELECT {UPL} FROM b_sess WHERE agent = 'claude_code' AND stops > 0) AS usd_per_committed_line_interrupted_sessions,
       (SELECT {UPL} FROM b_live WHERE agent = 'claude_code' AND stops = 0) AS usd_per_committed_line_calm_sessions,
       (SELECT count(*) FROM b_meta WHERE event_type = 'queue-operation') AS queue_operation_events FROM {STOPS}"""

# ---- people ---------------------------------------------------------------------

REPLY = """(SELECT t.agent, t.session_id, t.no, t.useq, t.nseq, c.n_text_chars AS ch, c.n_text_chars * 0.048E0 AS need, ((epoch_us(t.nts) // 1000) - (epoch_us(t.ts_adj) // 1000)) / 1000.0E0 AS had,
        c.n_text_chars / 4.0E0 AS tok, c.n_text_chars / 4e6 * s.pout AS usd
 FROM b_turn t JOIN b_main c ON c.session_id = t.session_id AND c.seq = t.seq_adj JOIN b_sess s ON s.session_id = t.session_id
 WHERE t.nts IS NOT NULL AND t.ts_adj IS NOT NULL AND t.nstop IS DISTINCT FROM true AND c.n_text_chars > 0) r"""
UN = "2 * had < need"
SQL["t11_by_agent"] = f"""
SELECT agent, count(*) AS final_replies, {n_if(UN)} AS unread_replies, {pc(n_if(UN), 'count(*)')} AS pct_replies_unread, sum(tok) AS final_text_tokens, {s_if(UN, 'tok')} AS unread_text_tokens,
       {pc(s_if(UN, 'tok'), 'sum(tok)')} AS pct_text_tokens_unread, {s_if(UN, 'usd')} AS unread_usd, median(need) AS median_read_time_s, median(had) AS median_delta_s FROM {REPLY} GROUP BY agent"""
SQL["t11_delta_vs_read_time_distribution"] = f"""
SELECT CASE WHEN had >= 5 * need THEN '5. >5x (took their time)' WHEN had >= need THEN '4. 1-5x' WHEN 2 * had >= need THEN '3. 50-100%' WHEN 4 * had >= need THEN '2. 25-50%' ELSE '1. <25% of read time' END AS bucket,
       count(*) AS final_replies, {pc('count(*)', f'(SELECT count(*) FROM {REPLY})')} AS pct_of_replies, sum(tok) AS text_tokens, sum(usd) AS usd, median(ch) AS median_text_chars FROM {REPLY} GROUP BY 1"""
SQL["t11_by_reply_length"] = f"""
SELECT CASE WHEN ch >= 6000 THEN '4. >6k chars' WHEN ch >= 2000 THEN '3. 2-6k' WHEN ch >= 500 THEN '2. 0.5-2k' ELSE '1. <500 chars' END AS length_bucket,
       count(*) AS final_replies, {pc(n_if(UN), 'count(*)')} AS pct_unread, sum(tok) AS text_tokens, {s_if(UN, 'usd')} AS unread_usd FROM {REPLY} GROUP BY 1"""
SQL["t11_longest_unread_replies"] = f"""
SELECT session_id, no AS turn_idx, agent, ch AS n_text_chars, need AS read_time_s, had AS delta_s, usd AS text_usd FROM {REPLY} WHERE {UN} ORDER BY ch DESC, session_id, no LIMIT 20"""
SQL["t11_ordering_diagnostic"] = f"""
SELECT agent, count(*) AS turns_with_a_next_prompt, count(*) - count(seq_adj) AS turns_dropped_no_call_before_next_prompt, {n_if('last_seq IS DISTINCT FROM seq_adj')} AS turns_where_last_call_ts_was_after_next_prompt,
       median((epoch_us(nts) // 1000) - (epoch_us(last_ts) // 1000)) / 1000.0E0 AS median_raw_delta_s, median((epoch_us(nts) // 1000) - (epoch_us(ts_adj) // 1000)) / 1000.0E0 AS median_adjusted_delta_s
FROM b_turn WHERE nts IS NOT NULL AND last_ts IS NOT NULL GROUP BY agent"""
SQL["t11_headline"] = f"""
SELECT {s_if(UN, 'usd')} AS usd_final_text_that_could_not_be_read, {pc(s_if(UN, 'usd'), ALL_OUT)} AS pct_of_all_output_usd, {pc(s_if(UN, 'tok'), 'sum(tok)')} AS pct_of_final_text_tokens_unread,
       {n_if(UN)} AS unread_replies, count(*) AS final_replies_measured, median(had) AS median_seconds_before_next_prompt, median(need) AS median_seconds_needed_to_read FROM {REPLY}"""

TIME = """(SELECT t.session_id, t.agent, s.mode, t.cost, t.work / 1000.0E0 AS work, CASE WHEN t.wait BETWEEN 0 AND 1800000 THEN t.wait / 1000.0E0 END AS wait
 FROM (SELECT *, (epoch_us(ts_adj) // 1000) - (epoch_us(uts) // 1000) AS work, (epoch_us(uts) // 1000) - (epoch_us(lag(ts_adj) OVER (PARTITION BY session_id ORDER BY no)) // 1000) AS wait FROM b_turn) t
 JOIN b_sess s ON s.session_id = t.session_id WHERE t.work >= 0) t"""
HR = "sum(work) / 3600"
SQL["t12_by_agent"] = f"""
SELECT agent, count(*) AS turns, {HR} AS agent_hours, median(work) AS median_agent_time_s, quantile_cont(work, 0.9) AS p90_agent_time_s, sum(wait) / 3600 AS human_wait_hours, median(wait) AS median_human_time_s,
       sum(cost) AS usd, {rt('sum(cost)', HR.replace('sum', '(sum') + ')')} AS usd_per_agent_hour FROM {TIME} GROUP BY agent"""
SQL["t12_by_mode"] = f"""
SELECT mode, count(*) AS turns, {HR} AS agent_hours, sum(wait) / 3600 AS human_wait_hours, sum(cost) AS token_usd, sum(work) / 60 AS human_usd_if_watching_at_60ph,
       sum(work) / 60 / nullif(sum(cost), 0) AS ratio_wait_cost_to_token_cost, median(work) AS median_agent_time_s FROM {TIME} GROUP BY mode"""
SQL["t12_per_session"] = f"""
SELECT agent, count(*) AS sessions, median(w) AS median_agent_hours_per_session, quantile_cont(w, 0.9) AS p90_agent_hours_per_session, median(h) AS median_human_hours_per_session, sum(w) AS agent_hours, sum(c) AS usd
FROM (SELECT agent, session_id, {HR} AS w, sum(wait) / 3600 AS h, sum(cost) AS c FROM {TIME} GROUP BY agent, session_id) GROUP BY agent"""
SQL["t12_agent_time_buckets"] = f"""
SELECT CASE WHEN work >= 1800 THEN '5. >30 min' WHEN work >= 600 THEN '4. 10-30 min' WHEN work >= 120 THEN '3. 2-10 min' WHEN work >= 30 THEN '2. 0.5-2 min' ELSE '1. <30 s' END AS bucket,
       count(*) AS turns, {pc('count(*)', f'(SELECT count(*) FROM {TIME})')} AS pct_of_turns, {HR} AS agent_hours, sum(cost) AS usd FROM {TIME} GROUP BY 1"""
SQL["t12_headline"] = f"""
SELECT {HR} AS total_agent_working_hours, sum(cost) AS total_token_usd_in_those_turns, sum(work) / 60 AS human_usd_at_60_per_hour_if_watching, sum(work) / 60 / nullif(sum(cost), 0) AS ratio_human_wait_cost_to_token_cost,
       sum(wait) / 3600 AS total_human_typing_and_thinking_hours, median(work) AS median_agent_seconds_per_turn, 3600 * sum(cost) / nullif(sum(work), 0) AS usd_of_tokens_per_agent_hour FROM {TIME}"""

INJ = "(SELECT e.*, ifnull(e.subtype, e.event_type) AS sub, s.ver, CASE WHEN e.event_type = 'attachment' THEN e.payload_chars END AS att FROM b_meta e JOIN b_sess s ON s.session_id = e.session_id WHERE e.payload_chars > 0) i"
TYPED = "(SELECT t.*, s.ver FROM b_turns t JOIN b_sess s ON s.session_id = t.session_id WHERE NOT t.is_meta) h"
SQL["t24_injected_by_subtype"] = f"""
SELECT agent, event_type, sub AS subtype, count(*) AS events, sum(payload_chars) AS payload_chars, sum(payload_chars) / 4.0E0 AS payload_tokens, median(payload_chars) AS median_payload_chars
FROM {INJ} GROUP BY agent, event_type, sub ORDER BY 5 DESC, 1, 2, 3"""
SQL["t24_injected_vs_human_by_agent"] = f"""
SELECT a.agent, a.p AS injected_chars, a.t AS attachment_chars, b.h AS human_chars, {pc('a.p', 'a.p + b.h')} AS pct_injected_of_prompt_side, {pc('a.t', 'a.t + b.h')} AS pct_attachments_of_prompt_side
FROM (SELECT agent, sum(payload_chars) AS p, sum(att) AS t FROM {INJ} GROUP BY agent) a LEFT JOIN (SELECT agent, sum(human_chars) AS h FROM {TYPED} GROUP BY agent) b ON a.agent = b.agent"""
SQL["t24_by_version_claude_code"] = f"""
SELECT a.ver AS harness_version, array_to_string([try_cast(p AS INTEGER) FOR p IN string_split(split_part(a.ver, '-', 1), '.')], '.') AS vkey, a.s AS sessions, {rt('a.t', 'a.s')} AS attachment_chars_per_session,
       {rt('b.h', 'a.s')} AS human_chars_per_session, {pc('a.t', 'a.t + b.h')} AS pct_injected
FROM (SELECT ver, count(DISTINCT session_id) AS s, sum(att) AS t FROM {INJ} WHERE agent = 'claude_code' AND ver IS NOT NULL GROUP BY ver HAVING count(DISTINCT session_id) >= 2) a
LEFT JOIN (SELECT ver, sum(human_chars) AS h FROM {TYPED} WHERE agent = 'claude_code' GROUP BY ver) b ON a.ver = b.ver"""
SQL["t24_per_session_distribution"] = f"""
SELECT agent, count(*) AS sessions, median(t) AS median_attachment_chars_per_session, quantile_cont(t, 0.9) AS p90_attachment_chars_per_session, max(t) AS max_attachment_chars
FROM (SELECT agent, session_id, sum(att) AS t FROM {INJ} GROUP BY agent, session_id) GROUP BY agent"""
SQL["t24_headline"] = f"""
SELECT a.t AS harness_attachment_chars, b.h AS human_typed_chars, {pc('a.t', 'a.t + b.h')} AS pct_of_prompt_side_written_by_the_harness, a.t / 4.0E0 AS harness_attachment_tokens, a.p AS all_event_payload_chars, a.k AS attachment_events
FROM (SELECT sum(att) AS t, sum(payload_chars) AS p, count(att) AS k FROM {INJ}) a, (SELECT sum(human_chars) AS h FROM {TYPED}) b"""

# ---- cases ----------------------------------------------------------------------

POOL1 = f"(SELECT session_id, agent, mode, repo, seq, file_path, content_chars, input_chars, biggest, CAST(content_chars AS DOUBLE) / nullif(biggest, 0) AS grow, wusd, md5(concat(session_id, ':', CAST(seq AS VARCHAR))) AS lot FROM {FULL} WHERE had) p"
SQL["c01_rewrite_necessary"] = f"""
WITH big AS (SELECT * FROM {POOL1} ORDER BY content_chars DESC, session_id, seq LIMIT 300),
     lucky AS (SELECT * FROM {POOL1} WHERE (session_id, seq) NOT IN (SELECT (session_id, seq) FROM big) QUALIFY row_number() OVER (PARTITION BY agent, mode ORDER BY lot, session_id, seq) <= 40 ORDER BY lot, session_id, seq LIMIT 300)
SELECT session_id, seq, 10 AS k_before, 5 AS k_after, agent, mode, repo, file_path, content_chars, input_chars, biggest AS max_earlier_read_chars, grow AS rewrite_ratio, wusd AS output_usd_estimate, pick AS stratum_pick,
       concat(agent, '|', mode) AS stratum FROM (SELECT *, 'top_by_size' AS pick FROM big UNION ALL SELECT *, 'random' FROM lucky)"""
SQL["c01_headline"] = f"""
SELECT count(*) AS pool_of_writes_on_known_files, sum(content_chars) AS content_chars_in_pool, sum(wusd) AS output_usd_in_pool, median(content_chars) AS median_content_chars, count(DISTINCT session_id) AS sessions_in_pool FROM {POOL1}"""
POOL2 = f"(SELECT *, md5(concat(session_id, ':', CAST(seq AS VARCHAR))) AS lot FROM {RENT}) p"
SQL["c02_tool_result_used"] = f"""
WITH big AS (SELECT * FROM {POOL2} ORDER BY rusd DESC NULLS LAST, session_id, seq LIMIT 300),
     lucky AS (SELECT * FROM {POOL2} WHERE result_chars > 5000 AND (session_id, seq) NOT IN (SELECT (session_id, seq) FROM big)
               QUALIFY row_number() OVER (PARTITION BY agent, tool_kind ORDER BY lot, session_id, seq) <= 25 ORDER BY lot, session_id, seq LIMIT 300)
SELECT session_id, seq, 3 AS k_before, 12 AS k_after, agent, mode, repo, tool_kind, CAST(NULL AS VARCHAR) AS tool_name, left(ifnull(command_head, file_path), 200) AS what, result_chars, later AS later_calls, rtok AS rent_tokens,
       rusd AS rent_usd, pick AS stratum_pick, concat(agent, '|', tool_kind) AS stratum FROM (SELECT *, 'top_by_rent' AS pick FROM big UNION ALL SELECT *, 'random_over_5k' FROM lucky)"""
SQL["c02_headline"] = f"""
SELECT count(*) AS pool_of_tool_results, {n_if('result_chars > 5000')} AS results_over_5k_chars, sum(rusd) AS rent_usd_in_pool, median(result_chars) AS median_result_chars, count(DISTINCT session_id) AS sessions_in_pool FROM {POOL2}"""
HOT = f"(SELECT * FROM {PATHS} ORDER BY s DESC, k DESC, repo, file_path LIMIT 40) h"
SQL["c03_hot_file_cause"] = f"""
SELECT e.session_id, e.seq, 10 AS k_before, 10 AS k_after, e.agent, e.mode, e.repo, e.file_path, e.tool_kind, h.s AS file_sessions, h.k AS file_edits, h.u AS file_users, concat(e.repo, '|', e.file_path) AS stratum
FROM b_use e JOIN {HOT} ON h.repo = e.repo AND h.file_path = e.file_path WHERE e.tool_kind IN ('write', 'edit')
QUALIFY row_number() OVER (PARTITION BY e.repo, e.file_path ORDER BY md5(concat(e.session_id, ':', CAST(e.seq AS VARCHAR))), e.session_id, e.seq) <= 5"""
SQL["c03_headline"] = f"""
SELECT count(*) AS hot_files_selected, sum(s) AS sessions_covered, sum(k) AS edits_covered, max(s) AS max_sessions_on_one_file, min(s) AS min_sessions_on_one_file FROM {HOT}"""

# ---- studies --------------------------------------------------------------------

CODE = """(SELECT s.*, ifnull(g.ch, 0) AS ch, ifnull(g.ch, 0) / 40.0E0 AS gl FROM b_sess s LEFT JOIN (SELECT session_id, sum(ifnull(content_chars, 0)) + sum(ifnull(new_string_chars, 0)) AS ch FROM b_tools
 WHERE tool_kind IN ('edit', 'write') GROUP BY session_id) g ON g.session_id = s.session_id WHERE s.lines_ > 0) c"""
SQL["code_survival"] = f"""
SELECT agent, mode, count(*) AS sessions, sum(gl) AS gen_lines_est, sum(lines_) AS committed_lines, {pc('sum(lines_)', 'sum(gl)')} AS pct_survive_est, sum(cost) AS usd, {UPL} AS usd_per_committed_line FROM {CODE} GROUP BY agent, mode"""
SQL["survival_distribution_vibe"] = f"""
SELECT CASE WHEN x > 100 THEN '6. >100%' WHEN x >= 75 THEN '5. 75-100%' WHEN x >= 50 THEN '4. 50-75%' WHEN x >= 25 THEN '3. 25-50%' WHEN x >= 10 THEN '2. 10-25%' ELSE '1. <10%' END AS bucket, count(*) AS sessions
FROM (SELECT 100.0E0 * lines_ / gl AS x FROM {CODE} WHERE mode = 'vibe' AND ch >= 400) GROUP BY 1"""
SQL["task_per_session"] = """
SELECT CASE WHEN k > 30 THEN '>30' WHEN k > 10 THEN '11-30' WHEN k > 3 THEN '4-10' WHEN k > 1 THEN '2-3' ELSE '1' END AS task_calls_bucket, count(*) AS sessions, sum(k) AS task_calls, sum(ch) / 1e6 AS "result_Mchars"
FROM (SELECT session_id, count(*) AS k, sum(ifnull(result_chars, 0)) AS ch FROM b_tools WHERE tool_kind = 'task' AND agent = 'claude_code' GROUP BY session_id) GROUP BY 1"""
SQL["task_vs_no_task"] = f"""
SELECT mode, CASE WHEN {HAS_TASK} THEN 'z Task' ELSE 'bez Task' END AS kind, count(*) AS sessions, median(cost) AS median_usd, {UPL} AS usd_per_committed_line, {pc(HIT, 'count(*)')} AS pct_with_commit
FROM b_live s WHERE agent = 'claude_code' AND mode IN ('vibe', 'human', 'collab') GROUP BY 1, 2"""
SQL["sleep_durations"] = f"""
SELECT CASE WHEN z >= 300 THEN '5. >=300 s' WHEN z >= 60 THEN '4. 60-299 s' WHEN z >= 30 THEN '3. 30-59 s' WHEN z >= 10 THEN '2. 10-29 s' ELSE '1. <10 s' END AS sleep_bucket, count(*) AS calls, sum(cusd) AS usd_context, sum(z) / 3600.0E0 AS hours_slept
FROM (SELECT *, try_cast(regexp_extract(command_head, 'sleep (\\d+)', 1) AS BIGINT) AS z FROM {POLLS}) WHERE z IS NOT NULL GROUP BY 1"""
SPAN = "(SELECT repo, file_path, session_id, min(ts) AS a, max(ts) AS z FROM b_use WHERE tool_kind IN ('edit', 'write') AND file_path IS NOT NULL GROUP BY repo, file_path, session_id)"
PAIRS = f"(SELECT x.repo, x.file_path, x.session_id AS s1, y.session_id AS s2 FROM {SPAN} x JOIN {SPAN} y ON x.repo = y.repo AND x.file_path = y.file_path AND x.session_id < y.session_id AND x.a <= y.z AND y.a <= x.z) p"
SQL["concurrent_summary"] = f"""
SELECT count(*) AS overlapping_pairs, count(DISTINCT (repo, file_path)) AS files_with_overlap, (SELECT count(DISTINCT (repo, file_path)) FROM {SPAN}) AS files_edited_total,
       (SELECT count(DISTINCT v) FROM (SELECT s1 AS v FROM {PAIRS} UNION ALL SELECT s2 FROM {PAIRS})) AS sessions_involved FROM {PAIRS}"""
SQL["concurrent_files"] = f"SELECT repo, file_path, count(*) AS overlapping_session_pairs FROM {PAIRS} GROUP BY repo, file_path ORDER BY 3 DESC, 1, 2 LIMIT 20"
SQL["unread_by_next_label"] = f"""
SELECT g.label, count(*) AS replies, {n_if(UN)} AS unread, {pc(n_if(UN), 'count(*)')} AS pct_unread, median(ch) AS median_reply_chars, median(had) AS median_delta_s, {n_if(UN + ' AND ch > 3000')} AS unread_long_over_3000_chars
FROM {REPLY} JOIN b_tag g ON g.session_id = r.session_id AND g.seq = r.nseq GROUP BY g.label"""
TAGGED = "(SELECT t.*, g.label, g.pushback FROM b_turn t JOIN b_tag g ON g.session_id = t.session_id AND g.seq = t.useq) t"
SQL["cost_by_label"] = f"""
SELECT label, count(*) AS turns, sum(cost) AS usd, {pc('sum(cost)', f'(SELECT sum(cost) FROM {TAGGED})')} AS pct_of_bill, median(cost) AS median_turn_usd, median(ifnull(calls, 0)) AS median_calls FROM {TAGGED} GROUP BY label"""
_FX = "label IN ('correction', 'failure_report')"
SQL["pushback_cost"] = f"""
SELECT count(*) AS turns, {s_if(_FX, 'cost')} AS usd_after_fix_requests, {pc(s_if(_FX, 'cost'), 'sum(cost)')} AS pct_after_fix_requests, {s_if('pushback', 'cost')} AS usd_after_pushback,
       {pc(s_if('pushback', 'cost'), 'sum(cost)')} AS pct_after_pushback FROM {TAGGED}"""
SQL["bill_summary"] = f"""
WITH i AS (SELECT 1 AS k, 'cache reads' AS item, (SELECT sum(u_read) FROM b_bill) AS v
  UNION ALL SELECT 2, 'tool results held in context', (SELECT sum(rusd) FROM {RENT} WHERE agent = 'claude_code')
  UNION ALL SELECT 3, 'cache writes', (SELECT sum({WR}) FROM b_bill)
  UNION ALL SELECT 4, 'turns after pushback', (SELECT sum(cost) FROM {TAGGED} WHERE pushback)
  UNION ALL SELECT 5, 'cache writes after a break', (SELECT sum({WR}) FROM {GAP} WHERE gap_ms > 300000))
SELECT k AS line_no, item, v AS usd, {pc('v', ALL_USD)} AS pct_of_total_usd, (SELECT sum(j.v) FROM i j WHERE j.k <= i.k) AS running_usd, {ALL_USD} AS total_usd FROM i"""

# ---- derived tables themselves ---------------------------------------------------

SQL["model_prices"] = "SELECT model, plain AS model_norm, vendor AS provider, pin AS p_input, pread AS p_cache_read, p5 AS p_cache_write_5m, p60 AS p_cache_write_1h, pout AS p_output FROM b_card"
SQL["calls_priced"] = """
SELECT session_id, seq, agent, model, plain AS model_norm, vendor AS provider, known AS is_priced, mon AS month, w5 AS c5m_tokens, w60 AS c1h_tokens, ctx AS ctx_tokens, u_in AS input_usd, u_read AS cache_read_usd,
       CASE WHEN known THEN u_write END AS cache_write_usd, u_out AS output_usd, cost AS cost_usd FROM b_bill"""
SQL["calls_idx"] = "SELECT session_id, seq, pos AS call_idx, spent AS cum_cost_usd, cost AS cost_usd FROM b_main"
SQL["seq_pos"] = "SELECT session_id, seq, nc AS calls_before, spent AS cum_cost_usd, nt AS tools_before FROM b_pos"
SQL["session_price"] = "SELECT m.session_id, m.model AS session_model, k.vendor AS session_provider, k.pin AS p_input, k.pread AS p_cache_read, k.p5 AS p_cache_write_5m, k.pout AS p_output FROM b_modal m LEFT JOIN b_card k ON k.model = m.model"
SQL["sessions_x"] = """
SELECT session_id, agent, repo, mode, ver AS harness_version, who AS user_hash, model AS session_model, pin AS p_input, n AS n_calls, side AS n_sidechain_calls, fast AS n_fast_calls, cost AS session_cost_usd,
       outtok AS output_tokens, ctx AS ctx_tokens, tools AS n_tool_calls, bad AS n_tool_errors, asked AS n_human_turns, stops AS n_interrupts, lines_ AS committed_lines FROM b_sess"""
SQL["turns"] = """
SELECT session_id, no AS turn_idx, useq AS user_seq, uts AS user_ts, nseq AS next_user_seq, nts AS next_user_ts, ifnull(calls, 0) AS n_calls, last_seq AS last_call_seq, last_ts AS last_call_ts, cost AS turn_cost_usd,
       seq_adj AS last_call_seq_adj, ts_adj AS last_call_ts_adj, lag(ts_adj) OVER (PARTITION BY session_id ORDER BY no) AS prev_last_call_ts_adj FROM b_turn"""

"""Shared relations of the check queries, written for a plain SQL engine.

Each check is one statement: the relations it names are put in front of it as WITH parts.
The formulation is deliberately different from the Spark plans (whole-partition windows,
correlated lookups), so that agreement means something."""

from __future__ import annotations

import re

from tollbook.sources.prices import RATE_CARD
from tollbook.sources.testbed import CALLS, EVENTS, ROWS, SESSIONS, TOOL_CALLS, USER_TURNS


def _lit(v):
    if v is None:
        return "CAST(NULL AS DOUBLE)"
    return f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)"


def pc(a, b):
    return f"(100.0E0 * ({a}) / nullif({b}, 0))"


def rt(a, b):
    return f"(CAST({a} AS DOUBLE) / nullif({b}, 0))"


def n_if(p):
    return f"count(CASE WHEN {p} THEN 1 END)"


def s_if(p, x):
    return f"sum(CASE WHEN {p} THEN {x} END)"


PARTS: dict[str, str] = {
    "b_rows": ROWS.format(source="events"),
    "b_calls": CALLS.format(rows="b_rows"),
    "b_tools": TOOL_CALLS.format(rows="b_rows"),
    "b_turns": USER_TURNS.format(rows="b_rows"),
    "b_meta": EVENTS.format(rows="b_rows"),
    "b_list": SESSIONS.format(rows="b_rows"),
    "b_rates": "SELECT * FROM (VALUES " + ", ".join(
        "(" + ", ".join(_lit(v) for v in row) + ")" for row in RATE_CARD
    ) + ") r(pat, vendor, pin, pread, p5, p60, pout)",
    "b_names": """
SELECT model, CASE WHEN bare LIKE 'claude%' THEN replace(bare, '.', '-') ELSE bare END AS plain
FROM (SELECT model, lower(split_part(model, '/', -1)) AS bare FROM b_calls WHERE model IS NOT NULL GROUP BY model)""",
    "b_card": """
SELECT DISTINCT ON (n.model) n.model, n.plain, r.vendor, r.pin, r.pread, r.p5, r.p60, r.pout
FROM b_names n, b_rates r WHERE n.plain LIKE r.pat
ORDER BY n.model, strlen(r.pat) DESC, r.pat""",
    # one priced call per row
    "b_bill": """
SELECT q.*, u_in + u_read + u_write + u_out AS cost
FROM (SELECT c.*, k.plain, k.vendor, k.pin, k.pread, k.p5, k.p60, k.pout, k.vendor IS NOT NULL AS known,
             date_trunc('month', c.ts) AS mon,
             CASE WHEN coalesce(c.cache_create_5m, c.cache_create_1h) IS NULL THEN ifnull(c.cache_create_tokens, 0) ELSE ifnull(c.cache_create_5m, 0) END AS w5,
             ifnull(c.cache_create_1h, 0) AS w60,
             ifnull(c.input_tokens, 0) + CASE WHEN k.vendor = 'openai' THEN 0 ELSE ifnull(c.cache_read_tokens, 0) + ifnull(c.cache_create_tokens, 0) END AS ctx,
             k.pin / 1e6 * CASE k.vendor WHEN 'openai' THEN greatest(0, ifnull(c.input_tokens, 0) - ifnull(c.cache_read_tokens, 0)) ELSE ifnull(c.input_tokens, 0) END AS u_in,
             k.pread / 1e6 * ifnull(c.cache_read_tokens, 0) AS u_read,
             CASE k.vendor WHEN 'openai' THEN 0.0E0 ELSE
               (CASE WHEN coalesce(c.cache_create_5m, c.cache_create_1h) IS NULL THEN ifnull(c.cache_create_tokens, 0) ELSE ifnull(c.cache_create_5m, 0) END) * k.p5 / 1e6
               + ifnull(c.cache_create_1h, 0) * k.p60 / 1e6 END AS u_write,
             k.pout / 1e6 * ifnull(c.output_tokens, 0) AS u_out
      FROM b_calls c LEFT JOIN b_card k ON k.model = c.model) q""",
    "b_main": """
SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq, msg_id) AS pos,
       sum(ifnull(cost, 0)) OVER (PARTITION BY session_id ORDER BY seq, msg_id ROWS UNBOUNDED PRECEDING) AS spent
FROM b_bill WHERE NOT is_sidechain""",
    # calls, tool calls and money up to every record number
    "b_pos": """
SELECT session_id, seq, max(nc) AS nc, max(nt) AS nt, max(spent) AS spent
FROM (SELECT session_id, seq,
             sum(c) OVER w AS nc, sum(t) OVER w AS nt, sum(m) OVER w AS spent
      FROM (SELECT session_id, seq, 1 AS c, 0 AS t, ifnull(cost, 0) AS m FROM b_main
            UNION ALL SELECT session_id, seq, 0, 0, 0 FROM b_bill WHERE is_sidechain
            UNION ALL SELECT session_id, seq, 0, 1, 0 FROM b_tools
            UNION ALL SELECT session_id, seq, 0, 0, 0 FROM b_turns
            UNION ALL SELECT session_id, seq, 0, 0, 0 FROM b_meta) z
      WINDOW w AS (PARTITION BY session_id ORDER BY seq RANGE UNBOUNDED PRECEDING)) y
GROUP BY session_id, seq""",
    "b_modal": """
SELECT DISTINCT ON (session_id) session_id, model FROM (
  SELECT session_id, model, count(*) AS n FROM b_bill WHERE model IS NOT NULL GROUP BY ALL)
ORDER BY session_id, n DESC, model""",
    "b_ver": """
SELECT DISTINCT ON (session_id) session_id, harness_version FROM (
  SELECT session_id, harness_version, count(*) AS n FROM b_bill WHERE harness_version IS NOT NULL GROUP BY ALL)
ORDER BY session_id, n DESC, harness_version""",
    "b_home": """
SELECT DISTINCT ON (session_id) session_id, cwd FROM (
  SELECT session_id, cwd, count(*) AS n FROM b_bill WHERE cwd IS NOT NULL GROUP BY ALL)
ORDER BY session_id, n DESC, cwd""",
    "b_sess": """
SELECT l.session_id, l.agent, l.repo, l.attr_total_committed AS lines_,
       CASE WHEN l.attr_agent_percentage >= 95 THEN 'vibe' WHEN l.attr_agent_percentage <= 5 THEN 'human'
            WHEN l.attr_agent_percentage IS NOT NULL THEN 'collab' ELSE 'unknown' END AS mode,
       v.harness_version AS ver, m.model, k.pin, k.pread, k.p5, k.pout,
       left(md5(CASE WHEN h.cwd IS NULL THEN 'unknown' ELSE regexp_extract(h.cwd, '^/(?:Users|home)/([^/]+)', 1) END), 10) AS who,
       ifnull(b.n, 0) AS n, ifnull(b.side, 0) AS side, ifnull(b.fast, 0) AS fast, b.cost, b.outtok, b.ctx,
       ifnull(t.n, 0) AS tools, ifnull(t.bad, 0) AS bad, ifnull(u.asked, 0) AS asked, ifnull(u.stops, 0) AS stops
FROM b_list l
LEFT JOIN (SELECT session_id, count(*) AS n, sum(CAST(is_sidechain AS INT)) AS side, sum(CASE WHEN speed = 'fast' THEN 1 ELSE 0 END) AS fast,
                  sum(ifnull(cost, 0)) AS cost, sum(ifnull(output_tokens, 0)) AS outtok, sum(ctx) AS ctx
           FROM b_bill GROUP BY session_id) b ON b.session_id = l.session_id
LEFT JOIN b_ver v ON v.session_id = l.session_id
LEFT JOIN b_home h ON h.session_id = l.session_id
LEFT JOIN b_modal m ON m.session_id = l.session_id
LEFT JOIN b_card k ON k.model = m.model
LEFT JOIN (SELECT session_id, count(*) AS n, sum(CASE WHEN is_error THEN 1 ELSE 0 END) AS bad FROM b_tools GROUP BY session_id) t ON t.session_id = l.session_id
LEFT JOIN (SELECT session_id, sum(CASE WHEN human_chars > 0 AND NOT is_meta THEN 1 ELSE 0 END) AS asked,
                  sum(CASE WHEN is_interrupt THEN 1 ELSE 0 END) AS stops FROM b_turns GROUP BY session_id) u ON u.session_id = l.session_id""",
    "b_live": "SELECT * FROM b_sess WHERE n > 0",
    # every tool call with position and session attributes
    "b_use": """
SELECT t.*, p.nc, p.nt, p.spent, s.mode, s.lines_, s.who, s.model AS s_model, s.n AS s_calls, s.cost AS s_cost, s.pin, s.pread, s.p5, s.pout
FROM b_tools t JOIN b_pos p ON p.session_id = t.session_id AND p.seq = t.seq JOIN b_sess s ON s.session_id = t.session_id""",
    "b_asked": "SELECT * FROM b_turns WHERE human_chars > 0 AND NOT is_meta",
    # turns: a call belongs to the number of prompts at or before it
    "b_span": """
SELECT session_id, seq AS useq, ts AS uts, human_chars AS uchars, is_interrupt AS ustop,
       row_number() OVER s AS no, lead(seq) OVER s AS nseq, lead(ts) OVER s AS nts, lead(is_interrupt) OVER s AS nstop
FROM b_asked WINDOW s AS (PARTITION BY session_id ORDER BY seq)""",
    "b_done": """
SELECT m.session_id, m.agent, m.seq, m.ts, ifnull(m.cost, 0) AS cost,
       (SELECT count(*) FROM b_asked a WHERE a.session_id = m.session_id AND a.seq <= m.seq) AS no
FROM b_main m""",
    "b_first": "SELECT session_id, min(seq) AS fseq, arg_min(ts, seq) AS fts, arg_min(is_interrupt, seq) AS fstop FROM b_asked GROUP BY session_id",
    "b_heads": """
SELECT session_id, no, useq, uts, nseq, nts, nstop FROM b_span
UNION ALL
SELECT d.session_id, 0, NULL, NULL, f.fseq, f.fts, f.fstop
FROM (SELECT DISTINCT session_id FROM b_done WHERE no = 0) d LEFT JOIN b_first f ON f.session_id = d.session_id""",
    "b_turn": """
SELECT h.*, l.agent, x.calls, x.last_ts, x.last_seq, ifnull(x.cost, 0) AS cost, x.seq_adj, x.ts_adj
FROM b_heads h JOIN b_list l ON l.session_id = h.session_id
LEFT JOIN (SELECT d.session_id, d.no, count(*) AS calls, max(d.ts) AS last_ts, max(d.seq) AS last_seq, sum(d.cost) AS cost,
                  max(CASE WHEN g.nts IS NULL OR d.ts <= g.nts THEN d.seq END) AS seq_adj,
                  arg_max(d.ts, CASE WHEN d.ts IS NOT NULL AND (g.nts IS NULL OR d.ts <= g.nts) THEN d.seq END) AS ts_adj
           FROM b_done d JOIN b_heads g ON g.session_id = d.session_id AND g.no = d.no GROUP BY d.session_id, d.no) x
  ON x.session_id = h.session_id AND x.no = h.no""",
    "b_tag": """
SELECT session_id, seq,
       CASE (chars + seq) % 8 WHEN 0 THEN 'follow_up' WHEN 1 THEN 'approval' WHEN 2 THEN 'question' WHEN 3 THEN 'meta_other'
            WHEN 4 THEN 'failure_report' WHEN 5 THEN 'correction' WHEN 6 THEN 'new_task' ELSE 'interruption' END AS label,
       (chars + seq) % 8 IN (4, 5) OR (chars + seq) % 11 = 0 AS pushback
FROM b_asked""",
}


def statement(body: str) -> str:
    """Put the WITH parts a body needs in front of it."""
    needed: set[str] = set()
    pending = [body]
    while pending:
        text = pending.pop()
        for name in PARTS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                pending.append(PARTS[name])
    if not needed:
        return body
    chain = ",\n".join(f"{name} AS ({PARTS[name].strip()})" for name in PARTS if name in needed)
    body = body.strip()
    return f"WITH {chain},\n{body[5:]}" if body.startswith("WITH ") else f"WITH {chain}\n{body}"


# Doubles are compared at six digits. Many sums of prices lie exactly on half a unit of the
# sixth digit, where the order of addition would decide; the shift moves them off it.
DIGITS, SHIFT = 6, 2.137e-8


def comparable(body: str, contract: str) -> str:
    """Cast the columns of a check to the declared kinds: s text, l integer, d double,
    b flag, t time stamp."""
    cast = {
        "s": "CAST({c} AS VARCHAR)", "l": "CAST({c} AS BIGINT)", "b": "CAST({c} AS BOOLEAN)", "t": "CAST({c} AS TIMESTAMP)",
        "d": f"round(CAST({{c}} AS DOUBLE) + {SHIFT}, {DIGITS})",
    }
    fields = [field.rsplit(":", 1) for field in contract.split()]
    picked = ", ".join(cast[kind].format(c=f'o."{name}"') + f' AS "{name}"' for name, kind in fields)
    return f"SELECT {picked} FROM (\n{statement(body)}\n) o"

"""DuckDB restatements of the project table graph (oracle side only).

Written independently of the Spark operators: nested-loop linkage
(``contains`` / regex over the cross product), a recursive CTE for the
sequential greedy grouping, window functions for last-wins picks.
"""

from __future__ import annotations

from tradeflow.functions.text import DUPLICATE_MARKERS, STREET_SUFFIXES
from tradeflow.plans.fixtures import duck_cte
from tradeflow.plans.q_quotes import DUCK_QUOTE_LINES

_SUFFIX_LIST = "[" + ", ".join("'" + s + "'" for s in STREET_SUFFIXES) + "]"
_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def duck_clean_address(x: str) -> str:
    head = _STRIP.format(x=f"split_part({x}, ',', 1)")
    fold = (f"list_reduce({_SUFFIX_LIST}, lambda acc, s: CASE WHEN ends_with(acc, s) "
            f"THEN left(acc, length(acc) - length(s)) ELSE acc END, {head})")
    return _STRIP.format(x=fold)


def duck_multi_address(x: str) -> str:
    p = r"'^(\d+)[a-zA-Z]*[/\-]?(\d*)\s*(.*)'"
    return (f"CASE WHEN regexp_matches({x}, '^[0-9]') THEN "
            f"CASE WHEN regexp_extract({x}, {p}, 2) <> '' THEN regexp_extract({x}, {p}, 2) "
            f"ELSE regexp_extract({x}, {p}, 1) END || ' ' || regexp_extract({x}, {p}, 3) ELSE {x} END")


_ESC = r"regexp_replace(lower({n}), '([\\^$.|?*+()\[\]{{}}])', '\\\1', 'g')"


def duck_phrase_match(text: str, name: str) -> str:
    esc = _ESC.format(n=name)
    return (f"(contains(lower({text}), lower({name})) AND regexp_matches(lower({text}), "
            rf"'(^|[^\p{{L}}\p{{N}}_])' || {esc} || '([^\p{{L}}\p{{N}}_]|$)'))")


_MARKERS = " OR ".join(f"contains(card_title, '{m}')" for m in DUPLICATE_MARKERS)

JOBS = f"""
fx_cards_removed AS MATERIALIZED (
  SELECT *, CASE WHEN coalesce({_MARKERS}, FALSE) THEN 'duplicate_marker' ELSE 'not_a_job_title' END AS reason
  FROM fx_job_cards
  WHERE coalesce({_MARKERS}, FALSE) OR NOT coalesce(regexp_matches(card_title, '^[0-9]'), FALSE)),
fx_cards_clean AS MATERIALIZED (
  SELECT c.* FROM fx_job_cards c
  WHERE NOT EXISTS (SELECT 1 FROM fx_cards_removed r WHERE r.short_url = c.short_url AND r.card_title = c.card_title)),
fx_jobs AS MATERIALIZED (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, {duck_clean_address('card_title')} AS name,
           coalesce(list_contains(labels, 'Shared Drain'), FALSE) AS shared_drains,
           row_number() OVER (PARTITION BY {duck_clean_address('card_title')} ORDER BY card_id DESC) AS rn
    FROM fx_cards_clean) WHERE rn = 1)
"""

REFS = """
fx_headers AS MATERIALIZED (
  SELECT quote_no, min(quote_ref) AS quote_ref, min(created) AS created, round(sum(line_total), 2) AS quote_value
  FROM fx_quote_lines GROUP BY quote_no),
fx_refs AS MATERIALIZED (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, coalesce(quote_ref, quote_no) AS ref_key,
           row_number() OVER (PARTITION BY coalesce(quote_ref, quote_no) ORDER BY created DESC, quote_no DESC) AS rn
    FROM fx_headers) WHERE rn = 1)
"""

MAPPING = f"""
fx_cand AS MATERIALIZED (
  SELECT j.name, j.short_url, r.ref_key, r.quote_no, r.quote_ref, r.quote_value
  FROM fx_jobs j JOIN fx_refs r ON contains(lower(r.ref_key), lower(j.name))),
fx_matched AS MATERIALIZED (
  SELECT name AS job_name, short_url AS job_no, quote_no, quote_ref,
         CASE WHEN contains(lower(ref_key), 'variation') OR contains(lower(ref_key), 'private')
              THEN 'variation' ELSE 'primary' END AS match_type,
         quote_value
  FROM fx_cand WHERE {duck_phrase_match('ref_key', 'name')}),
fx_mapping AS MATERIALIZED (
  SELECT * FROM fx_matched
  UNION ALL
  SELECT j.name, j.short_url, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 'no_match', CAST(NULL AS DOUBLE)
  FROM fx_jobs j
  WHERE j.name NOT IN (SELECT job_name FROM fx_matched WHERE match_type = 'primary')
    AND coalesce(j.status, '') <> 'NFA, No Damage, PVC' AND coalesce(j.board_name, '') <> 'Survey Workflow')
"""

LABOUR = f"""
fx_task_people AS MATERIALIZED (
  SELECT t.*, unnest(coalesce(t.people_ids, [t.people_id])) AS pid FROM fx_tasks t),
fx_labour_raw AS MATERIALIZED (
  SELECT tp.task_id || ':' || p.name AS labour_id,
         CASE WHEN tp.name IS NULL OR trim(tp.name) = '' THEN sp.name ELSE tp.name END AS name,
         tp.start_date, tp.end_date, p.name AS employee, tp.hours AS daily_hours,
         CAST(date_diff('day', tp.start_date, tp.end_date) + 1 AS BIGINT) AS num_days,
         (date_diff('day', tp.start_date, tp.end_date) + 1) * tp.hours AS total_hours
  FROM fx_task_people tp
  JOIN fx_people p ON p.people_id = tp.pid
  LEFT JOIN fx_sched_projects sp ON sp.project_id = tp.project_id),
fx_labour AS MATERIALIZED (
  SELECT labour_id, {duck_clean_address('name')} AS name, start_date, end_date, employee, daily_hours,
         num_days, total_hours
  FROM fx_labour_raw WHERE fx_labour_raw.employee IS NOT NULL AND fx_labour_raw.name IS NOT NULL
    AND regexp_matches(fx_labour_raw.name, '^[0-9]')),
fx_job_hours AS MATERIALIZED (
  SELECT name, round(sum(total_hours), 2) AS labour_hours, count(DISTINCT employee) AS n_site_staff,
         count(*) AS n_labour_records
  FROM fx_labour GROUP BY name)
"""

GROUPS = r"""
fx_att AS MATERIALIZED (SELECT j.name, unnest(j.attachments) AS url FROM fx_jobs j),
fx_att2 AS MATERIALIZED (
  SELECT name, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM fx_att),
fx_edges AS MATERIALIZED (
  SELECT DISTINCT a.name AS src, t.name AS dst
  FROM fx_att2 a JOIN fx_jobs t ON t.short_url = split_part(a.path, '/', 3)
  WHERE a.host = 'trello.com' AND split_part(a.path, '/', 2) = 'c'
    AND NOT regexp_matches(split_part(a.path, '/', -1), '(\.jpg|\.jpeg|\.JPG|\.png|\.PNG|\.HEIC|\.heic|\.pdf|\.PDF|\.doc|\.docx|\.xls|\.xlsx|\.zip|\.rar|\.eml|\.html|noname|\.mp4|\.mov|\.gif)$')),
fx_shared AS MATERIALIZED (SELECT name, row_number() OVER (ORDER BY card_id) AS i FROM fx_jobs WHERE shared_drains),
fx_links AS MATERIALIZED (SELECT src, list(dst ORDER BY dst) AS dsts FROM fx_edges GROUP BY src),
fx_walk AS MATERIALIZED (
  WITH RECURSIVE walk(i, visited, seed) AS (
    SELECT 0, CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR)
    UNION ALL
    SELECT w.i + 1,
           CASE WHEN list_contains(w.visited, s.name) THEN w.visited
                ELSE list_concat(w.visited, [s.name], coalesce(l.dsts, CAST([] AS VARCHAR[]))) END,
           CASE WHEN list_contains(w.visited, s.name) THEN NULL ELSE s.name END
    FROM walk w JOIN fx_shared s ON s.i = w.i + 1 LEFT JOIN fx_links l ON l.src = s.name)
  SELECT seed FROM walk WHERE seed IS NOT NULL),
fx_group_members AS MATERIALIZED (
  SELECT seed, seed AS m FROM fx_walk
  UNION
  SELECT w.seed, e.dst FROM fx_walk w JOIN fx_edges e ON e.src = w.seed),
fx_groups AS MATERIALIZED (
  SELECT DISTINCT g.project, gm.m AS name FROM fx_group_members gm
  JOIN (SELECT seed, string_agg(m, ' + ' ORDER BY m) AS project FROM fx_group_members GROUP BY seed) g
    ON g.seed = gm.seed),
fx_members AS MATERIALIZED (
  SELECT project, name, TRUE AS shared_drains FROM fx_groups
  WHERE project NOT IN (SELECT name FROM fx_jobs WHERE NOT shared_drains)
  UNION ALL
  SELECT name, name, FALSE FROM fx_jobs WHERE NOT shared_drains)
"""

ROLLUP = f"""
fx_needles AS MATERIALIZED (
  SELECT project, name AS needle FROM fx_members
  UNION
  SELECT project, CASE WHEN n > 1 THEN {duck_multi_address('f')} ELSE f END
  FROM (SELECT project, min(name) AS f, count(*) AS n FROM fx_members GROUP BY project)),
fx_cost_links AS MATERIALIZED (
  SELECT DISTINCT n.project, c.row_id, c.Gross, c.Project AS cp
  FROM fx_costs c JOIN fx_needles n ON contains(c.Project, n.needle) OR contains(c.Description, n.needle)),
fx_cost_pref AS MATERIALIZED (
  SELECT cl.* FROM fx_cost_links cl
  JOIN (SELECT project, bool_or(cp = project) AS any_exact FROM fx_cost_links GROUP BY project) x
    ON x.project = cl.project
  WHERE NOT x.any_exact OR cl.cp = cl.project),
fx_labour_links AS MATERIALIZED (
  SELECT DISTINCT m.project, l.labour_id, l.start_date, l.end_date
  FROM fx_labour l JOIN fx_members m ON contains(l.name, m.name)),
fx_values AS MATERIALIZED (SELECT quote_no, sum(line_total) AS value_raw FROM fx_quote_lines GROUP BY quote_no),
fx_pp AS MATERIALIZED (
  SELECT m.project, max(m.shared_drains) AS shared_drains, count(*) AS n_jobs, count(DISTINCT j.status) AS n_statuses,
         arg_min(j.project_manager, m.name) FILTER (WHERE j.project_manager IS NOT NULL) AS project_manager,
         arg_min(j.surveyed_by, m.name) FILTER (WHERE j.surveyed_by IS NOT NULL) AS surveyed_by,
         round(avg(j.longitude), 2) AS longitude, round(avg(j.latitude), 2) AS latitude,
         round(sum(j.concrete_qty), 2) AS sum_concrete_qty, round(sum(j.asphalt_qty), 2) AS sum_asphalt_qty
  FROM fx_members m LEFT JOIN fx_jobs j ON j.name = m.name GROUP BY m.project),
fx_hours AS MATERIALIZED (
  SELECT m.project, round(coalesce(sum(h.labour_hours), 0.0), 2) AS labour_hours
  FROM fx_members m LEFT JOIN fx_job_hours h ON h.name = m.name GROUP BY m.project),
fx_qv AS MATERIALIZED (
  SELECT m.project, count(*) AS n_quote_links,
         CASE WHEN max(CASE WHEN mp.match_type = 'primary' THEN 1 ELSE 0 END) = 1
              THEN round(sum(v.value_raw), 2) ELSE 0.0 END AS total_quote_value
  FROM fx_members m JOIN fx_mapping mp ON mp.job_name = m.name AND mp.match_type IN ('primary', 'variation')
  JOIN fx_values v ON v.quote_no = mp.quote_no GROUP BY m.project),
fx_sc AS MATERIALIZED (SELECT project, round(sum(Gross), 2) AS supplier_costs_total, count(*) AS n_cost_rows
          FROM fx_cost_pref GROUP BY project),
fx_we AS MATERIALIZED (SELECT project, min(start_date) AS work_start, max(end_date) AS work_end FROM fx_labour_links GROUP BY project),
fx_roll AS MATERIALIZED (
  SELECT p.project, p.shared_drains, p.n_jobs, p.n_statuses, p.project_manager, p.surveyed_by, h.labour_hours,
         round(h.labour_hours * 50.0, 2) AS labour_cost_total,
         coalesce(sc.supplier_costs_total, 0.0) AS supplier_costs_total,
         round(coalesce(sc.supplier_costs_total, 0.0) + round(h.labour_hours * 50.0, 2), 2) AS total_costs,
         coalesce(q.total_quote_value, 0.0) AS total_quote_value,
         coalesce(sc.n_cost_rows, 0) AS n_cost_rows, coalesce(sc.n_cost_rows, 0) > 0 AS xero_costs_linked,
         coalesce(q.n_quote_links, 0) AS n_quote_links, we.work_start, we.work_end,
         p.longitude, p.latitude, p.sum_concrete_qty, p.sum_asphalt_qty
  FROM fx_pp p LEFT JOIN fx_hours h ON h.project = p.project LEFT JOIN fx_qv q ON q.project = p.project
  LEFT JOIN fx_sc sc ON sc.project = p.project LEFT JOIN fx_we we ON we.project = p.project),
fx_projects AS MATERIALIZED (
  SELECT project, shared_drains, n_jobs, n_statuses, project_manager, surveyed_by, labour_hours, labour_cost_total,
         supplier_costs_total, total_costs, total_quote_value,
         round(total_quote_value - total_costs, 2) AS gross_profit,
         CASE WHEN total_quote_value <> 0 THEN round(round(total_quote_value - total_costs, 2) / total_quote_value, 2)
              ELSE 0.0 END AS gp_margin_pct,
         round(total_quote_value * 0.12, 2) AS est_proj_overhead,
         n_cost_rows, xero_costs_linked, n_quote_links, work_start, work_end, longitude, latitude,
         sum_concrete_qty, sum_asphalt_qty
  FROM fx_roll)
"""


def ctes(*parts: str) -> str:
    """Fixture CTEs + the requested pipeline parts, in dependency order."""
    order = ["jobs", "quotes", "refs", "mapping", "labour", "groups", "rollup"]
    need = set(parts)
    if "rollup" in need:
        need |= {"jobs", "quotes", "refs", "mapping", "labour", "groups"}
    if "mapping" in need:
        need |= {"jobs", "quotes", "refs"}
    if "refs" in need:
        need |= {"quotes"}
    if "groups" in need:
        need |= {"jobs"}
    fx = ["customer_titles"]
    if "jobs" in need:
        fx.append("job_cards")
    if "quotes" in need:
        fx += ["quote_src_a", "quote_src_b"]
    if "labour" in need:
        fx += ["tasks", "people", "sched_projects"]
    if "rollup" in need:
        fx.append("costs")
    text = {"jobs": JOBS, "quotes": DUCK_QUOTE_LINES, "refs": REFS, "mapping": MAPPING, "labour": LABOUR,
            "groups": GROUPS, "rollup": ROLLUP}
    body = ",\n".join(text[p].strip() for p in order if p in need)
    return duck_cte(*fx) + ",\n" + body + "\n"

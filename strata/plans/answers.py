"""What the queries of ``plans.engine`` must give, in DuckDB's SQL over the same relations; no plan is shared with them."""

from __future__ import annotations

from strata.functions.dialect import DUCK, plain
from strata.plans.engine import CONTRACTS, WORDS
from strata.operators.decisions import KEYWORDS
from strata.sources.relations import with_relations

_COMMENT = "regexp_matches(trim(line), '^(#|//|/[*]|[*])')"
_N = "len(content) - len(replace(content, chr(10), '')) + 1"
_IN_SCOPE = {"guard": "path like 'src1/%'", "style": "path not like 'src2/%'", "legacy": "path like 'src_/%' and path not like '%7.txt'"}
_LATE = {"no-licence-text": "error"}


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _violations(strict: bool = False) -> str:
    parts = []
    for c, _, _, _, rules in CONTRACTS:
        for r, kind, sev, pattern, anti, metric, value, _ in rules:
            sev = _LATE.get(r, sev)
            sev = "error" if strict and sev == "warning" else sev
            own = f"select '{c}' as contract_id, '{r}' as rule_id, '{sev}' as severity, path"
            if pattern and pattern != "(":
                parts.append(f"{own}, no as line, 'about {r}' as message, regexp_extract(line, {_q(pattern)}) as matched from line where {_IN_SCOPE[c]} and regexp_matches(line, {_q(pattern)}) and not {_COMMENT}")
            if anti:
                parts.append(f"{own}, null, 'Required pattern is missing: ' || {_q(anti)}, null from file where {_IN_SCOPE[c]} and not regexp_matches(content, {_q(anti)})")
            if metric == "max_lines":
                parts.append(f"{own}, null, 'File has ' || ({_N}) || ' lines (max: {int(value)})', null from file where {_IN_SCOPE[c]} and {_N} > {value}")
    return " union all ".join(parts)


_V = _violations()
_AS_OF = "date '1999-01-01'"
_FOLDER = "regexp_replace({0}, '/?[^/]*$', '')"
_HEAD = "array_to_string(string_split({0}, '/')[1:3], '/')"
_W = "select distinct file_path as w from node where node_id % 400 = 1"
_LIVE = "select distinct file_path from node where node_id % 3 > 0"
_STATE = "select coalesce(l.path, s.path) as path, case when l.path is null then 'deleted' when s.path is null then 'new' when l.hash <> s.hash then 'changed' else 'same' end as state from live_print l full outer join stored_print s on l.path = s.path"
_DRIFT = f"""select id, 'stale' as problem, 'medium' as level, null as file_path from decision where status = 'active' and {_AS_OF} > review_by
 union all select id, 'expired constraint', 'high', null from decision where status = 'active' and num % 8 = 1 and {_AS_OF} > date '1998-01-01' + cast(num as int) * interval 1 day
 union all select distinct id, 'orphaned anchor', case when {_AS_OF} > review_by then 'high' else 'medium' end, null from decision join decision_anchor on decision = num where status = 'active' and file_path not in ({_LIVE})
 union all select distinct id, 'changed anchor', 'medium', file_path from decision join decision_anchor on decision = num where status = 'active' and file_path in ({_LIVE}) and (anchor % 8 = 4 or anchor % 8 = 0 and line_start is null)"""
_ITEMS = f"select 'decisions' as component, id as name, problem, level from ({_DRIFT}) a union all select 'graph', path, state, case state when 'deleted' then 'high' else 'medium' end from ({_STATE}) b where state in ('deleted', 'changed')"
_RANK = "case level when 'low' then 1 when 'medium' then 2 when 'high' then 3 else 4 end"
_LEVEL = "case {0} when 1 then 'low' when 2 then 'medium' when 3 then 'high' else 'critical' end"
_SUMS = ", ".join(f"cast(coalesce(sum({c}), 0) as bigint) as {c}" for c in ("naive", "graph", "full_tokens", "decisions", "contracts", "drift", "conflicts", "dropped"))
_SUMS = f"count(*) as requests, {_SUMS}, round(coalesce(avg(took_ms), 0), 1) as avg_ms"
_SAVED = "naive - full_tokens as saved, case when naive > 0 then round((1 - cast(full_tokens as double) / naive) * 100, 1) else 0.0 end as reduction_pct"
_DAILY = f"select *, {_SAVED} from (select strftime(day, '%Y-%m-%d') as day, {_SUMS} from context_event group by 1) t"
_TAKEN = "feedback in ('accepted', 'modified')"


def _convention(name: str, good: str, bad: str, enough: str, examples: str, counter: str) -> str:
    return f"""select '{name}' as name, round(o / (o + v), 6) as confidence, o as occurrences, v as violations, {examples} as examples, {counter} as counter_examples
      from (select count(*) filter ({good}) as o, count(*) filter ({bad}) as v, list_sort(list(file_path) filter ({good}))[1:3] as g, list_sort(list(file_path) filter ({bad}))[1:3] as b from code_file) t where {enough} and o / (o + v) >= 0.3"""


_G, _B = "coalesce(array_to_string(g, ','), '')", "coalesce(array_to_string(b, ','), '')"
_CONVENTIONS = " union all ".join([
    _convention("Async handlers", "k % 2 = 0", "k % 6 = 3", "o + v >= 3 and o > v", _G, _B),
    _convention("Layer separation", "k % 4 = 0 and k % 5 <> 0", "k % 4 = 0 and k % 5 = 0", "o + v >= 3 and o > v", _G, _B),
    _convention("Custom exceptions", "k % 6 = 0", "k % 6 = 1", "o >= 3", _G, _B),
    _convention("Docstring convention", "k % 4 <> 1", "k % 4 = 1", "o + v >= 10 and o / (o + v) >= 0.6", "''", "''"),
    "select 'Service class naming', 0.9, count(*), 0, array_to_string(list_sort(list(s))[1:5], ','), '' from (select distinct 'Kind' || (k % 5) || 'Service' as s from code_file where k % 7 = 0) t having count(*) >= 3",
    """select 'Test coverage structure', round(o / n, 6), o, n - o, array_to_string(e, ','), '' from (select count(*) as n, count(t.k) as o, list_sort(list('m' || s.k) filter (t.k is not null))[1:5] as e
       from (select k from code_file where k % 4 <> 2) s left join (select k from code_file where k % 4 = 2) t on s.k % 4 = 1 and t.k = s.k + 1) x where o / n >= 0.3""",
])
_RULES = {"Async handlers": ("auto-async-handlers", "warning"), "Layer separation": ("auto-no-db-in-routes", "warning"), "Custom exceptions": ("auto-no-bare-except", "warning"), "Docstring convention": ("auto-docstrings", "info"), "Service class naming": ("auto-service-naming", "info"), "Test coverage structure": ("auto-test-coverage", "info")}
_CHECKS = """select 'INT-001' as intent_id, 0 as place, 'file_exists' as check_type, exists (from file where path = 'src0/fr/d0.txt') as passed
 union all select 'INT-001', 1, 'file_contains', exists (from file where path = 'src0/fr/d0.txt' and contains(content, 'Elle'))
 union all select 'INT-001', 2, 'function_exists', exists (from code_file where k % 2 = 0)
 union all select 'INT-001', 3, 'wired', exists (from code_file where contains(file_path, 'src/api/route_0') and contains(content, 'service'))
 union all select 'INT-002', 0, 'grep_match', exists (from file where contains(content, 'Licensed under'))
 union all select 'INT-002', 1, 'grep_no_match', not exists (from file where contains(content, '-----BEGIN'))
 union all select 'INT-002', 2, 'manual', false union all select 'INT-002', 3, 'file_contains', false union all select 'INT-002', 4, 'test_passes', true
 union all select 'INT-004', 0, 'grep_match', exists (from code_file where k % 7 = 0 and k % 5 = 1)
 union all select 'INT-004', 1, 'file_exists', exists (from code_file where k % 4 = 1) union all select 'INT-004', 2, 'mcp_tool_exists', false"""
_ROLLED = f"""select i.intent_id, coalesce(total, 0) as total, coalesce(passed, 0) as passed, coalesce(total - passed, 0) as failed, case when total is null then 'active' when passed = total then 'verified' when passed > 0 then 'partial' else 'failed' end as status,
 case when total > 0 then round(100.0 * passed / total, 1) else 0.0 end as completion_pct, coalesce(gaps, '') as gaps from (select unnest(['INT-001', 'INT-002', 'INT-003', 'INT-004']) as intent_id) i
 left join (select intent_id, count(*) as total, count(*) filter (passed) as passed, string_agg(cast(place as varchar), ',' order by place) filter (not passed) as gaps from ({_CHECKS}) c group by 1) n using (intent_id)"""
_COHORTS = " union all ".join(
    f"select '{n}' as cohort, count(distinct session_id) as sessions, count(*) filter ({_TAKEN}) as accepted from context_session join feedback_event using (session_id) where {w}"
    for n, w in (("with decisions", "decisions_provided > 0"), ("with contracts", "contracts_provided > 0"), ("neither", "decisions_provided = 0 and contracts_provided = 0"))
)
_COHORTS = f"select *, case when sessions > 0 then round(100.0 * accepted / sessions, 1) else 0.0 end as rate from ({_COHORTS}) t"
_HITS = " + ".join(f"case when strpos(lower(t), {_q(w)}) > 0 then 1 else 0 end" for w in WORDS + KEYWORDS)
_ANY = lambda words: " or ".join(f"strpos(lower(t), {_q(w)}) > 0" for w in words)
_RATIOS = """select event_id, case when naive > 0 then round((1 - cast(graph as double) / naive) * 100, 2) else 0.0 end as naive_to_graph, case when naive > 0 then round((1 - cast(full_tokens as double) / naive) * 100, 2) else 0.0 end as naive_to_full,
 case when full_tokens > 0 then round(cast(naive as double) / full_tokens, 2) else 0.0 end as multiplier from context_event"""
_ROUTE = "'/api/v' || (k % 7) || '/items' || (k % 11) || '/{id}'"
_URL = "'http://host:80/api/v' || ((k + 1) % 7) || '/items' || (k % 13) || '/' || k"
_AT = "case when k % 3 = 0 then 4 else 2 end"
_DEP = """select c.service, c.file_path, 'svc' || v as provider, '/api/v' || v || '/items' || i || '/{id}' as endpoint from (select service, file_path, (k + 1) % 7 as v, k % 13 as i from service_file where k % 5 = 0) c
 where exists (from service_file p where p.k % 3 = 0 and p.k % 7 = v and p.k % 11 = i)"""
_DECIDED = """concat_ws(chr(10), '## Decision: Use ' || tag_a || ' [' || id || ']', 'Status: ' || status, '**Context:** ' || tag_a, '**Decision:** ' || tag_b,
 case when num % 4 = 1 then '**Constraints:**' || chr(10) || '- [' || case when num % 8 = 1 then 'MUST' else 'SHOULD' end || '] keep ' || tag_b || ' (source: ' || tag_a || ')' end,
 case when date '1999-01-01' > review_by then '**Review was due on ' || strftime(review_by, '%Y-%m-%d') || '**' end)"""


def _contract_text(c) -> str:
    each = "".join(f"\n- [{s.upper()}] **{r}**: about {r}" for r, _, s, *_ in c[4])
    return _q(f"## Contract: {c[0].title()} [{c[0]}]\nPriority: {c[1]} | Rules: {len(c[4])}\n{each}")


def _said() -> str:
    say = {"INT-001": ["file_exists src0/fr/d0.txt", "file_contains src0/fr/d0.txt::Elle", "function_exists get_item", "wired src/api/route_0 -> service"], "INT-002": ["grep_match Licensed under::**/*.txt", "grep_no_match -----BEGIN::**/*.txt", "manual look", "file_contains no mark", "test_passes pytest"], "INT-004": ["grep_match class Kind1Service", "file_exists src/core", "mcp_tool_exists x"]}
    return " union all ".join(f"select '{i}' as intent_id, {n} as place, {_q(t)} as said" for i, ts in say.items() for n, t in enumerate(ts))


_SQL = {
    "scope_match": " union all ".join(f"select '{c}' as contract_id, path from file where {w}" for c, w in _IN_SCOPE.items()),
    "contracts_by_priority": "select * from (values ('guard', 100, 1), ('style', 50, 2), ('legacy', 10, 3)) t(contract_id, priority, place)",
    "contract_guidance": "select contract_id, priority, row_number() over (order by priority desc) as place from ("
    + " union all ".join(f"select '{c[0]}' as contract_id, {c[1]} as priority where exists (from file where lang = 'en' and {_IN_SCOPE[c[0]]})" for c in CONTRACTS)
    + ") t",
    "pattern_violations": f"select contract_id, rule_id, severity, path, line as no, matched from ({_V}) v where line is not null",
    "required_pattern": f"select contract_id, rule_id, severity, path from ({_V}) v where rule_id in ('has-licence', 'ends-sentence')",
    "max_lines": f"select contract_id, severity, path, message from ({_violations(True)}) v where rule_id = 'short-file'",
    "max_function_lines": "select 'src1/' || file_path as file_path, line_start as line, 'Function ''' || name || ''' has ' || (line_end - line_start + 1) || ' lines (max: 60)' as message from node where kind in ('function', 'method') and line_end - line_start + 1 > 60",
    "effective_severity": " union all ".join(f"select '{c[0]}' as contract_id, '{r[0]}' as rule_id, '{_LATE.get(r[0], r[2])}' as severity, '{'error' if _LATE.get(r[0], r[2]) == 'warning' else _LATE.get(r[0], r[2])}' as strict_severity" for c in CONTRACTS for r in c[4]),
    "evaluation_rollup": f"select path, count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warning') as warnings, count(*) filter (severity = 'error') > 0 as blocking from ({_V}) v group by path",
    "threshold_conflicts": "select 'max_lines' as metric, 'guard:20,style:30' as details",
    "evaluation_texts": f"""select path, '## ' || path || chr(10) || count(*) filter (severity = 'error') || ' errors, ' || count(*) filter (severity = 'warning') || ' warnings' || chr(10) ||
      string_agg('- [' || upper(severity) || '] ' || rule_id || case when line is not null then ' (line ' || line || ')' else '' end || ': ' || message, chr(10) order by coalesce(line, 0), rule_id, severity, message) as text from ({_V}) v where contract_id = 'guard' group by path""",
    "rule_precision_vs_labels": f"select rule_id, count(*) as labelled, count(*) filter (quality = 0) as on_low_quality, count(*) filter (toxic = 1) as on_toxic from (select distinct rule_id, doc_id from ({_V}) v join file using (path) where line is not null) h join labels using (doc_id) group by rule_id",
    "conventions_found": f"select * from ({_CONVENTIONS}) c",
    "convention_contract": "select 'auto-detected' as id, 150 as priority, rule_id, severity, true as exclude_tests from (select name from (" + _CONVENTIONS + ") c) n join (values " + ", ".join(f"('{n}', '{r}', '{s}')" for n, (r, s) in _RULES.items()) + ") r(name, rule_id, severity) using (name)",
    "decision_relevance": f"""with w as ({_W}), a as (select distinct decision as num, file_path as f from decision_anchor),
      s as (select num, max(case when f = w then 1.0 when {_FOLDER.format('f')} = {_FOLDER.format('w')} then 0.5 when {_HEAD.format('f')} = {_HEAD.format('w')} then 0.2 else 0.0 end) as score from a cross join w group by num),
      o as (select * from decision where status not in ('superseded', 'expired'))
      select id, cast(score as double) as score from o join s using (num) where score >= 0.1 union all select id, 0.1 from o where num not in (select num from a)""",
    "decisions_by_tag": "select id from decision where tag_a in ('tag1', 'tag3') or tag_b in ('tag1', 'tag3')",
    "anchor_overlap": """with x as (select id, anchor, file_path, line_start, line_end from decision join decision_anchor on decision = num where status = 'active')
      select a_id, b_id, file_path from (select a.id as a_id, b.id as b_id, a.file_path, row_number() over (partition by a.id, b.id order by a.anchor, b.anchor) as n from x a join x b on a.file_path = b.file_path and a.id < b.id
      and (a.line_start is null or b.line_start is null or (a.line_start <= b.line_end and b.line_start <= a.line_end))) t where n = 1""",
    "supersede_conflicts": "select min(a.id) as newer, b.id as older from decision a join decision b on a.supersedes = b.num where (a.num % 5 < 4 or a.status = 'active') and (b.num % 5 < 4 or b.status = 'active') group by b.id",
    "next_decision_id": "select 'DEC-' || case when n > 999 then cast(n as varchar) else lpad(cast(n as varchar), 3, '0') end as next_id from (select max(num) + 1 as n from decision) t",
    "decision_drift": _DRIFT,
    "decision_drift_for_files": f"select id, file_path, count(*) as anchors, 'low' as level from decision join decision_anchor on decision = num join ({_W}) t on w = file_path where status = 'active' group by id, file_path",
    "context_rot": f"select total, stale, orphaned, total >= 5 and 1.0 * (stale + orphaned) / total >= 0.3 as rot from (select count(*) as total, count(*) filter ({_AS_OF} > review_by) as stale, count(*) filter (num in (select decision from decision_anchor where file_path not in ({_LIVE}))) as orphaned from decision) t",
    "change_classification": _STATE,
    "graph_drift": f"select path, case state when 'deleted' then 'high' else 'medium' end as level from ({_STATE}) c where state in ('deleted', 'changed')",
    "graph_drift_for_files": f"select path, case state when 'new' then 'unknown' else 'changed' end as problem, case state when 'new' then 'low' else 'none' end as level from ({_STATE}) c where state in ('new', 'changed') and path in (select path from file where doc_id % 5 < 2)",
    "incremental_plan": f"select state, count(*) as files from ({_STATE}) c group by state",
    "drift_overall": f"select level, count(*) as items, {_LEVEL.format(f'max(max({_RANK})) over ()')} as overall from ({_ITEMS}) i group by level",
    "drift_report": f"""with i as ({_ITEMS}), p as (select *, row_number() over (partition by component order by name, problem, level) as n from i),
      s as (select component, string_agg('- [' || level || '] ' || name || ': ' || problem, chr(10) order by n) filter (n <= 10) as listed, count(*) as k from p group by component)
      select '## Drift' || chr(10) || 'Worst level: ' || (select {_LEVEL.format(f'max({_RANK})')} from i) || chr(10) || string_agg('### ' || component || chr(10) || listed || case when k > 10 then chr(10) || '- and ' || (k - 10) || ' others' else '' end, chr(10) order by component) as text from s""",
    "anchor_region_hash": "select path, substr(sha256(array_to_string(string_split(content, chr(10))[2:4], chr(10))), 1, 16) as hash from file",
    "anchor_shorthand": "select anchor, case when line_start is null then file_path when anchor % 3 = 0 then file_path || ':' || line_start else file_path || ':' || line_start || '-' || line_end end as short from decision_anchor",
    "criteria_eval": _CHECKS,
    "intent_rollup": _ROLLED,
    "intent_texts": f"""with c as ({_CHECKS}), r as ({_ROLLED}), s as (select intent_id, string_agg('- [' || case when passed then 'x' else ' ' end || '] ' || said, chr(10) order by place) as listed from c join ({_said()}) t using (intent_id, place) group by 1)
      select intent_id, concat_ws(chr(10), '## Intent: ' || intent_id || chr(10) || 'Status: ' || status || ' | ' || passed || '/' || total, listed, case when failed > 0 then 'Not done: ' || failed || ' to go' end) as text from r left join s using (intent_id)""",
    "project_routing": "select path, case when lang in ('en', 'fr') then source || '/' || lang else source end as root from file",
    "comment_lines": f"select lang, count(*) filter ({_COMMENT}) as comments, count(*) as n_lines from line group by lang",
    "language_files": "select lang, count(*) as files, cast(sum(length(content)) as bigint) as chars from file group by lang",
    "decision_texts": f"select id, {_DECIDED} as text from decision",
    "contract_texts": " union all ".join(f"select '{c[0]}' as contract_id, {_contract_text(c)} as text" for c in CONTRACTS),
    "freshness": "select id, round(case when date '1998-06-01' > review_by then 0.3 when num % 3 = 0 then greatest(0.2, 1 - datediff('day', review_by - interval 400 day, date '1998-06-01') / 90.0) else 1.0 end, 6) as freshness from decision",
    "context_decisions": f"""with w as ({_W}), a as (select distinct decision as num, file_path as f from decision_anchor), o as (select * from decision where status not in ('superseded', 'expired')),
      s as (select w as request, num, max(case when f = w then 1.0 when {_FOLDER.format('f')} = {_FOLDER.format('w')} then 0.5 when {_HEAD.format('f')} = {_HEAD.format('w')} then 0.2 else 0.0 end) as score from a cross join w group by 1, 2),
      b as (select num from o where num not in (select num from a) order by id limit 5),
      r as (select request, o.*, score from s join o using (num) where score > 0 union all select w, o.*, 0.1 from w cross join b join o using (num)),
      p as (select *, row_number() over (partition by request order by score desc, id) as n from r)
      select request, id, case when score >= 0.8 or num % 8 = 1 then 'high' when score >= 0.3 then 'medium' else 'low' end as priority,
      round(case when {_AS_OF} > review_by then 0.3 when num % 3 = 0 then greatest(0.2, 1 - datediff('day', review_by - interval 400 day, {_AS_OF}) / 90.0) else 1.0 end, 6) as freshness from p where n <= 5""",
    "context_contracts": " union all ".join(f"select path as request, '{c}' as contract_id, 'medium' as priority from file where doc_id < 100 and {w}" for c, w in _IN_SCOPE.items()),
    "lifetime_stats": f"select *, {_SAVED} from (select {_SUMS} from context_event) t",
    "daily_summary": _DAILY,
    "daily_trend": f"select day, requests, saved, reduction_pct from ({_DAILY}) x order by day desc limit 30",
    "daily_refreshed": _DAILY,
    "before_after": f"select naive // requests as before_tokens, full_tokens // requests as after_tokens, round(cast(naive as double) / full_tokens, 1) as multiplier from (select {_SUMS} from context_event) t",
    "benchmark_averages": "select event_id % 50 as run, cast(sum(naive) // count(*) as bigint) as naive_avg, cast(sum(graph) // count(*) as bigint) as graph_avg, cast(sum(full_tokens) // count(*) as bigint) as full_avg, round(avg(case when naive > 0 then (1 - cast(full_tokens as double) / naive) * 100 end), 4) as reduction_pct from context_event group by 1",
    "recent_events": "select event_id, naive, full_tokens from context_event order by event_id desc limit 20",
    "scenario_ratios": _RATIOS,
    "scenario_files": "with n as (select file_path, count(*) as nodes from node where not is_test and not is_generated group by 1), p as (select *, row_number() over (order by nodes desc, file_path) - 1 as place, count(*) over () as k from n) select file_path, nodes, place from p where place in (0, k // 3, 2 * k // 3, k - 1)",
    "acceptance_rate": f"""select total, overall, recent, case when total > 10 then round(recent - overall, 1) else 0.0 end as improvement from (select count(*) as total, round(100.0 * count(*) filter ({_TAKEN}) / count(*), 1) as overall,
      coalesce(round(100.0 * count(*) filter ({_TAKEN} and day >= date '2024-01-22') / nullif(count(*) filter (day >= date '2024-01-22'), 0), 1), 0.0) as recent from feedback_event) t""",
    "rejection_analysis": "select reason, n, round(100.0 * n / total, 1) as pct from (select reason, count(*) as n, sum(count(*)) over () as total from feedback_event where feedback = 'rejected' group by reason) t where reason is not null",
    "acceptance_trend": "select strftime(day, '%Y-%m-%d') as day, " + ", ".join(f"count(*) filter (feedback = '{k}') as {k}" for k in ("accepted", "modified", "rejected", "partial")) + " from feedback_event group by 1",
    "repeated_rejection_insights": "select reason, count(*) as n, cast(round(least(0.9, 0.3 + 0.1 * count(*)), 2) as double) as confidence from feedback_event where feedback = 'rejected' and reason is not null and day >= date '2023-12-30' group by reason having count(*) >= 3",
    "context_effectiveness": _COHORTS,
    "effectiveness_text": f"""with e as ({_COHORTS}), p as (select 100.0 * max(accepted) filter (cohort = 'with decisions') / max(sessions) filter (cohort = 'with decisions') as d, 100.0 * max(accepted) filter (cohort = 'neither') / max(sessions) filter (cohort = 'neither') as n,
      100.0 * max(accepted) filter (cohort = 'with contracts') / max(sessions) filter (cohort = 'with contracts') as c, min(sessions) filter (cohort <> 'with contracts') as k, max(sessions) filter (cohort = 'with contracts') as kc from e)
      select coalesce(nullif(concat_ws(' ', case when k >= 5 and d - n > 5 then 'Decisions raise acceptance by ' || cast(round(d - n) as int) || ' points.' end, case when kc >= 5 then 'With contracts acceptance is ' || cast(round(c) as int) || ' in a hundred.' end), ''), 'Too few sessions to tell.') as text from p""",
    "benchmark_table": f"""select event_id % 50 as run, '| Scenario | Naive Tokens | Graph Tokens | Full Tokens | Reduction | Multiplier |' || chr(10) || '|---|---:|---:|---:|---:|---:|' || chr(10) ||
      string_agg('| ' || event_id || ' | ' || format('{{:,}}', naive) || ' | ' || format('{{:,}}', cast(graph as bigint)) || ' | ' || format('{{:,}}', cast(full_tokens as bigint)) || ' | ' || printf('%.0f', naive_to_full) || '% | ' || printf('%.1f', multiplier) || 'x |', chr(10) order by event_id) || chr(10) ||
      '| **Average** | | | | **' || printf('%.0f', avg(naive_to_full)) || '%** | **' || printf('%.1f', avg(multiplier)) || 'x** |' as text from context_event join ({_RATIOS}) r using (event_id) group by 1""",
    "commit_candidates": rf"""with m as (select cast(ord as varchar) as sha, trim(message) as t, n_files from commit), f as (select *, trim(string_split(t, chr(10))[1]) as first, {_HITS} as hits from m)
      select sha, case when len(first) > 80 then substr(first, 1, 77) || '...' else first end as title, hits, cast(round(least(0.8, 0.3 + least(0.2, 0.05 * hits) + case when len(t) > 200 then 0.1 else 0 end + case when len(t) > 500 then 0.1 else 0 end + case when n_files between 1 and 5 then 0.05 else 0 end
      + case when {_ANY(('adr', 'architecture decision', 'design decision'))} then 0.15 else 0 end + case when {_ANY(('because', 'reason:', 'rationale:'))} then 0.1 else 0 end), 2) as double) as confidence, n_files from f
      where hits > 0 and not regexp_matches(lower(first), '^merge\s|^wip\b|^fix\s*(typo|lint|format|style)|^chore\s*:|^bump\s+version|^update\s+lock|^auto-generated')""",
    "endpoints_extracted": f"select service, file_path, 1 as line, 'GET' as method, {_ROUTE} as path, 'get_' || (k % 11) as function from service_file where k % 3 = 0 union all select service, file_path, {_AT}, 'POST', {_URL}, '' from service_file where k % 5 = 0",
    "outbound_calls": f"select service, file_path, {_AT} as line, case k % 5 when 0 then 'POST' else 'GET' end as method, case when k % 5 = 0 then {_URL} end as url, case when k % 5 = 1 then 'target' end as variable from service_file where k % 5 < 2",
    "url_path_normalise": f"select distinct {_URL} as url, substr({_URL}, 15) as path from service_file where k % 5 = 0",
    "service_url_vars": "select distinct service, 'ORDER_' || (k % 3) || '_URL' as name from service_file where k % 4 = 0",
    "event_contracts": "select service, file_path, 'topic' || (k % 5) as event, 'consumes' as direction from service_file where k % 6 = 0",
    "resolve_dependencies": f"select *, false as is_critical from ({_DEP}) d",
    "service_map": f"""with d as ({_DEP}) select service, n_endpoints, (select coalesce(string_agg(p, ',' order by p), '') from (select distinct provider as p from d where d.service = s.service)) as depends_on,
      (select coalesce(string_agg(c, ',' order by c), '') from (select distinct d.service as c from d where d.provider = s.service)) as depended_on_by from (select service, count(*) filter (k % 3 = 0) as n_endpoints from service_file group by 1) s""",
    "cross_service_impact": f"select provider as service, endpoint, n as affected, c as services, case when n >= 5 then 'high' when n >= 2 then 'medium' else 'low' end as risk from (select provider, endpoint, count(*) as n, array_to_string(list_sort(list(distinct service)), ',') as c from ({_DEP}) d group by 1, 2) t",
    "service_scan": "select service, count(*) as files, count(distinct case when k % 4 = 0 then k % 3 end) as variables, count(*) filter (k % 6 = 0) as events from service_file group by 1",
}
ORACLES = {k: plain(with_relations(DUCK, v)) for k, v in _SQL.items()}

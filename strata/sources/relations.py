"""Relations of the engine over the driver's tables, stated once for both dialects.

``RELATIONS[name](d)`` is the SQL of a relation; ``with_relations`` puts the ones that a query
names, and those they build on, in front of it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from strata.functions.dialect import Spark

def _rows(rows: list[str]) -> str:
    return " union all ".join(f"select {r}" for r in rows)


def node(d: Spark) -> str:
    return """select p_partkey as node_id, case p_partkey % 5 when 0 then 'module' when 1 then 'class' when 2 then 'function' when 3 then 'method' else 'endpoint' end as kind,
      case when p_partkey % 10 = 0 then 'mod' || (p_partkey % 300) when p_partkey % 20 = 5 then 'test_mod' || ((p_partkey - 5) % 300) when p_partkey % 20 = 15 then 'mod' || ((p_partkey - 5) % 300) || '_spec' else replace(p_name, ' ', '_') end as name,
      p_brand || '.' || replace(p_name, ' ', '_') as qualified_name, 'src/' || p_brand || '/f' || (p_partkey % 40) || '.py' as file_path,
      p_size as line_start, cast(p_size + p_partkey % 90 as int) as line_end, p_partkey % 10 in (5, 7) as is_test, p_partkey % 17 = 0 as is_external, p_partkey % 23 = 0 as is_generated from $part"""


def edge(d: Spark) -> str:
    return """select l_partkey as source_id, (l_partkey * 7 + l_suppkey * 13 + l_linenumber) % (select count(*) from $part) as target_id,
      min(case when l_returnflag = 'A' then 'imports' when l_returnflag = 'N' then 'calls' when l_partkey % 3 = 0 then 'tests' else 'inherits' end) as kind, max(1 - l_discount) as confidence, min(l_linestatus) = 'O' as is_type_only
      from $lineitem where l_quantity <= 3 group by 1, 2"""


def file(d: Spark) -> str:
    return """select doc_id, source || '/' || lang || '/d' || doc_id || '.txt' as path, lang, source, coalesce(text, '') as content from $documents"""


def line(d: Spark) -> str:
    return d.lines("path, lang", "file", "content")


def live_print(d: Spark) -> str:
    return f"select path, {d.lower_hex('content')} as hash from file where doc_id % 25 <> 1"


def stored_print(d: Spark) -> str:
    return f"""select path, {d.lower_hex("case when doc_id % 10 = 0 then content || 'x' else content end")} as hash from file where doc_id % 25 <> 0
      union all select 'gone/d' || doc_id || '.txt', {d.lower_hex('content')} from file where doc_id < 5"""


def context_event(d: Spark) -> str:
    return f"""select o_orderkey as event_id, cast(o_orderdate as date) as day, cast(floor(o_totalprice) as bigint) as naive, {d.idiv('cast(floor(o_totalprice) as bigint) * 2', '3')} as graph,
      {d.idiv('cast(floor(o_totalprice) as bigint)', '(1 + o_orderkey % 4)')} as full_tokens, o_orderkey % 3 as decisions, o_orderkey % 5 as contracts, o_orderkey % 2 as drift, o_orderkey % 6 as conflicts, o_orderkey % 4 as dropped, cast(o_orderkey % 900 as double) as took_ms from $orders"""


def feedback_event(d: Spark) -> str:
    return f"""select event_id, cast(ts as date) as day, user_id as session_id, case event_type when 'purchase' then 'accepted' when 'signup' then 'modified' when 'click' then 'partial' else 'rejected' end as feedback,
      case when event_type = 'error' and {d.field('props', 'k')} % 8 < 7 then {d.field('props', 'k')} % 8 end as reason from $events where event_type in ('purchase', 'signup', 'click', 'error')"""


def context_session(d: Spark) -> str:
    return "select distinct user_id as session_id, user_id % 3 as decisions_provided, user_id % 2 as contracts_provided from $events"


def decision(d: Spark) -> str:
    return f"""select s_suppkey as ord, 'DEC-' || lpad(cast(s_suppkey as varchar(9)), case when s_suppkey > 999 then 9 else 3 end, '0') as id, s_suppkey as num,
      case s_suppkey % 5 when 0 then 'draft' when 1 then 'active' when 2 then 'active' when 3 then 'superseded' else 'deprecated' end as status,
      {d.days("date '1995-01-01'", 's_suppkey * 30')} as review_by, case when s_suppkey % 7 = 0 then s_suppkey - 1 end as supersedes, 'tag' || (s_nationkey % 6) as tag_a, 'tag' || (s_nationkey % 4) as tag_b from $supplier"""


def decision_anchor(d: Spark) -> str:
    return """select l_orderkey * 10 + l_linenumber as anchor, l_suppkey as decision, 'src/' || p_brand || '/f' || (p_partkey % 40) || '.py' as file_path,
      case when l_tax <> 0 then l_linenumber * 10 end as line_start, case when l_tax <> 0 then l_linenumber * 10 + cast(l_quantity as int) * 8 end as line_end from $lineitem join $part on l_partkey = p_partkey where l_quantity <= 3"""


def code_file(d: Spark) -> str:
    """Small Python files; what each holds follows from its number."""
    return """select p_partkey as k, case p_partkey % 4 when 0 then 'src/api/route_' || p_partkey when 1 then 'src/core/m' || p_partkey when 2 then 'tests/test_m' || (p_partkey - 1) else 'src/core/n' || p_partkey end || '.py' as file_path,
      case p_partkey % 5 when 0 then 'from models import Item' when 1 then 'from service import Item' else 'import os' end || chr(10) || case when p_partkey % 3 = 0 then '@router.get("/items")' else 'X = 1' end || chr(10) ||
      case when p_partkey % 2 = 0 then 'async def get_item(x):' else 'def make_item(x):' end || chr(10) || case when p_partkey % 4 <> 1 then '    \"\"\"Say it.\"\"\"' else '    y = 1' end || chr(10) ||
      case p_partkey % 6 when 0 then '    raise ItemError("no")' when 1 then '    try: z()' || chr(10) || '    except:' else '    return x' end || chr(10) || case when p_partkey % 7 = 0 then 'class Kind' || (p_partkey % 5) || 'Service:' else 'Z = 2' end as content from $part"""


def service_file(d: Spark) -> str:
    """Source files of seven services that offer and call one another's endpoints."""
    return """select p_partkey as k, 'svc' || (p_partkey % 7) as service, 'app/f' || p_partkey || '.py' as file_path,
      case when p_partkey % 3 = 0 then '@app.get("/api/v' || (p_partkey % 7) || '/items' || (p_partkey % 11) || '/{id}")' || chr(10) || '# next' || chr(10) || 'async def get_' || (p_partkey % 11) || '(id):' else 'x = 1' end || chr(10) ||
      case when p_partkey % 5 = 0 then 'r = requests.post("http://host:80/api/v' || ((p_partkey + 1) % 7) || '/items' || (p_partkey % 13) || '/' || p_partkey || '")' when p_partkey % 5 = 1 then 'r = requests.get(target)' else 'y = 2' end || chr(10) ||
      case when p_partkey % 4 = 0 then 'u = os.getenv("ORDER_' || (p_partkey % 3) || '_URL")' else 'z = 3' end || chr(10) || case when p_partkey % 6 = 0 then 'bus.subscribe("topic' || (p_partkey % 5) || '")' else 'pass' end as content from $part"""


def commit(d: Spark) -> str:
    return "select conv_id * 1000 + turn as ord, role as author, coalesce(text, '') as message, turn % 8 as n_files from $conversations"


def project(d: Spark) -> str:
    return "select distinct source as root from $documents union select distinct source || '/' || lang from $documents where lang in ('en', 'fr')"


RELATIONS: dict[str, Callable[[Spark], str]] = {
    f.__name__: f
    for f in (node, edge, file, line, live_print, stored_print, context_event, feedback_event, context_session, decision, decision_anchor, code_file, service_file, commit, project)
}


def with_relations(d: Spark, sql: str, recursive: bool = False) -> str:
    """``sql`` behind the common table expressions of the relations it names, in the order they build on each other."""
    made, wanted = {}, set()

    def need(text: str) -> None:
        for name in RELATIONS:
            if name not in wanted and re.search(rf"\b(from|join)\s+\(?{name}\b", text):
                wanted.add(name)
                made[name] = RELATIONS[name](d)
                need(made[name])

    need(sql)
    ctes = ", ".join(f"{n} as ({made[n]})" for n in RELATIONS if n in made)
    if not ctes:
        return sql
    head = "with recursive " if recursive else "with "
    body = re.sub(r"^\s*with\s+(recursive\s+)?", "", sql)
    return head + ctes + (", " if body != sql else " ") + body

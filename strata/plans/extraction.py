"""Extraction over source files: a small Python file a part, declarations and imports of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.functions.dialect import plain, run
from strata.operators import extract

#: files(file_path, content); said alike in both dialects
_FILES = """select 'src/' || p_brand || '/f' || p_partkey || '.py' as file_path,
  case when p_partkey % 3 = 0 then 'from .f' || (min(p_partkey) over (partition by p_brand)) else 'from ' || replace(p_name, ' ', '.') end || ' import x' || chr(10) ||
  'class ' || split_part(p_name, ' ', 1) || ':' || chr(10) || '    ' || case when p_partkey % 2 = 0 then 'async ' else '' end || 'def ' || split_part(p_name, ' ', 2) || '(self):' as content from $part"""

_NODES = rf"""with f as ({_FILES}), l as (select file_path, unnest(range(1, len(string_split(content, chr(10))) + 1)) as no, unnest(string_split(content, chr(10))) as line from f),
n as (select file_path, no, line, 'class' as kind, regexp_extract(line, '^\s*class\s+(\w+)', 1) as name from l union all select file_path, no, line, 'function', regexp_extract(line, '^\s*(?:async\s+)?def\s+(\w+)', 1) from l)
select substr(sha256(file_path || ':' || kind || ':' || name), 1, 16) as node_id, kind, name, replace(regexp_replace(regexp_replace(file_path, '^src/', ''), '\.py$', ''), '/', '.') || '.' || name as qualified_name, file_path,
cast(no as int) as line_start, cast(no as int) as line_end, 'python' as language, regexp_matches(line, '^\s*async\s') as is_async from n where name <> ''"""

_EDGES = rf"""with f as ({_FILES}), m as (select file_path, regexp_extract(content, '^from (\S+) import', 1) as module from f),
t as (select *, case when module like '.%' then regexp_replace(file_path, '[^/]*$', '') || substr(module, 2) || '.py' else replace(module, '.', '/') || '.py' end as target_path from m)
select substr(sha256(file_path || ':module:' || regexp_extract(file_path, '([^/]+)\.py$', 1)), 1, 16) as source_id, substr(sha256(target_path || ':module:' || regexp_extract(target_path, '([^/]+)\.py$', 1)), 1, 16) as target_id,
file_path, target_path, module, target_path in (select file_path from f) as is_resolved, 'imports' as kind, cast(0.9 as double) as confidence, false as is_type_only from t"""

_MODULES = rf"""with f as ({_FILES}) select substr(sha256(file_path || ':module:' || regexp_extract(file_path, '([^/]+)\.py$', 1)), 1, 16) as node_id, 'module' as kind, regexp_extract(file_path, '([^/]+)\.py$', 1) as name,
replace(regexp_replace(regexp_replace(file_path, '^src/', ''), '\.py$', ''), '/', '.') as qualified_name, file_path, 1 as line_start, cast(len(string_split(content, chr(10))) as int) as line_end, 'python' as language, false as is_test, false as is_entry_point, false as is_generated from f"""


def _over_files(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(run(spark, sf_dir, _FILES))


QUERIES = {"extract_modules": _over_files(extract.modules), "extract_declarations": _over_files(extract.declarations), "extract_import_edges": _over_files(extract.edges)}
ORACLES = {"extract_modules": plain(_MODULES), "extract_declarations": plain(_NODES), "extract_import_edges": plain(_EDGES)}

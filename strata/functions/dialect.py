"""What Spark SQL and DuckDB spell differently, so that a plan can be stated once.

A plan is a function of a dialect that returns SQL. Base tables are written ``$name``: a
temporary view of the session's data folder in Spark, the table itself in DuckDB.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations")
_MARK = re.compile(r"\$(" + "|".join(TABLES) + r")\b")


class Spark:
    name = "spark"
    newline = "'\\n'"

    def idiv(self, a, b):
        return f"({a} div {b})"

    def text(self, s):
        return "r'" + s.replace("'", "\\'") + "'" if "'" not in s else '"' + s.replace("\\", "\\\\") + '"'

    def like(self, x, pattern):
        return f"regexp_like({x}, {self.text(pattern)})"

    def first(self, x, pattern, group=0):
        return f"regexp_extract({x}, {self.text(pattern)}, {group})"

    def every(self, x, pattern, group=0):
        return f"regexp_extract_all({x}, {self.text(pattern)}, {group})"

    def swap(self, x, pattern, by):
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)})"

    def unroll(self, columns, source, values, name):
        return f"select {columns}, {name} from {source} lateral view explode({values}) u_ as {name}"

    def lines(self, columns, source, x):
        return f"select {columns}, i_ + 1 as no, line_ as line from {source} lateral view posexplode(split({x}, '\\n', -1)) u_ as i_, line_"

    def strings(self, x, order):
        return f"listagg({x}, ',') within group (order by {order})"

    def joined(self, x, order):
        return f"listagg({x}, {self.newline}) within group (order by {order})"

    def thousands(self, x):
        return f"format_number({x}, 0)"

    def fixed(self, x, n):
        return f"format_number({x}, {n})"

    def size(self, x):
        return f"size({x})"

    def field(self, x, key):
        return f"cast(get_json_object({x}, '$.{key}') as int)"

    def days(self, a, n):
        return f"date_add({a}, cast({n} as int))"

    def between(self, a, b):
        return f"datediff({b}, {a})"

    def lower_hex(self, x):
        return f"md5({x})"

    def has(self, array, value):
        return f"array_contains({array}, {value})"

    def array(self, *x):
        return f"array({', '.join(x)})"

    def part(self, x, sep, n):
        return f"split_part({x}, '{sep}', {n})"


class Duck(Spark):
    name = "duck"
    newline = "chr(10)"

    def idiv(self, a, b):
        return f"({a} // {b})"

    def text(self, s):
        return "'" + s.replace("'", "''") + "'"

    def like(self, x, pattern):
        return f"regexp_matches({x}, {self.text(pattern)})"

    def swap(self, x, pattern, by):
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by.replace('$', chr(92)))}, 'g')"

    def unroll(self, columns, source, values, name):
        return f"select {columns}, unnest({values}) as {name} from {source}"

    def lines(self, columns, source, x):
        return f"select {columns}, cast(unnest(range(1, len(string_split({x}, chr(10))) + 1)) as int) as no, unnest(string_split({x}, chr(10))) as line from {source}"

    def strings(self, x, order):
        return f"string_agg({x}, ',' order by {order})"

    def joined(self, x, order):
        return f"string_agg({x}, {self.newline} order by {order})"

    def thousands(self, x):
        return f"format('{{:,}}', cast({x} as bigint))"

    def fixed(self, x, n):
        return f"printf('%.{n}f', {x})"

    def size(self, x):
        return f"len({x})"

    def field(self, x, key):
        return f"cast(json_extract_string({x}, '$.{key}') as int)"

    def days(self, a, n):
        return f"cast({a} + cast({n} as int) * interval 1 day as date)"

    def between(self, a, b):
        return f"datediff('day', {a}, {b})"

    def has(self, array, value):
        return f"list_contains({array}, {value})"

    def array(self, *x):
        return f"[{', '.join(x)}]"


SPARK, DUCK = Spark(), Duck()


def bound(spark: SparkSession, sf_dir: str, sql: str) -> str:
    """``sql`` with its tables bound to views of the Parquet files under ``sf_dir``."""
    tag = hashlib.md5(sf_dir.encode()).hexdigest()[:8]
    for name in set(_MARK.findall(sql)):
        view = f"strata_{tag}_{name}"
        if not spark.catalog.tableExists(view):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(view)
    return _MARK.sub(lambda m: f"strata_{tag}_{m[1]}", sql)


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(bound(spark, sf_dir, sql))


def plain(sql: str) -> str:
    return _MARK.sub(lambda m: m[1], sql)

"""Services: endpoints, outbound calls, URL variables and events of source files, and what depends on what.

``files(service, file_path, content)``. Patterns are tables; each line is looked at once for all patterns of a kind.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.lineage import checkpointed

# fixed values from here to the next comment: what the frameworks' routes, clients, settings and queues look like
VERBS, LOW, TITLE, UPPER = "get post put patch delete", ".get .post .put .patch .delete", ".Get .Post .Put .Patch .Delete", ".GET .POST .PUT .PATCH .DELETE"
ROUTES = (
    # pattern, group of the method (0: none), group of the path, parts of a line one of which every match holds
    (r"""@(?:app|router|api_router)\.(get|post|put|patch|delete|options|head)\s*\(\s*["']([^"']+)["']""", 1, 2, "@"),
    (r"""@(?:app|bp|blueprint)\.route\s*\(\s*["']([^"']+)["'](?:.*methods\s*=\s*\[([^\]]+)\])?""", 0, 1, ".route"),
    (r"""@(?:api_view|action)\s*\(\s*\[([^\]]+)\]\s*\)""", 0, 1, "@"),
    (r"""\(\s*r?["'](/api/[^"']+)["'].*(?:Handler|View)""", 0, 1, "/api/"),
    (r"""(?:app|router|server)\.(get|post|put|patch|delete)\s*\(\s*["']([^"']+)["']""", 1, 2, LOW),
    (r"""@(Get|Post|Put|Patch|Delete)\s*\(\s*["']([^"']+)["']""", 1, 2, "@"),
    (r"""export\s+(?:default\s+)?(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE)\b""", 0, 1, "export"),
    (r"""(?:http|mux|r|router)\.(?:HandleFunc|Handle|Get|Post|Put|Patch|Delete)\s*\(\s*["']([^"']+)["']""", 0, 1, ".Handle " + TITLE),
    (r"""(?:r|router|group|v1|v2|api)\.(GET|POST|PUT|PATCH|DELETE)\s*\(\s*["']([^"']+)["']""", 1, 2, UPPER),
    (r"""(?:e|echo|g|group)\.(GET|POST|PUT|PATCH|DELETE)\s*\(\s*["']([^"']+)["']""", 1, 2, UPPER),
    (r"""(?:app|group|api)\.(Get|Post|Put|Patch|Delete)\s*\(\s*["']([^"']+)["']""", 1, 2, TITLE),
    (r"""@(GetMapping|PostMapping|PutMapping|PatchMapping|DeleteMapping)\s*\(\s*(?:value\s*=\s*)?["']([^"']+)["']""", 1, 2, "Mapping"),
    (r"""@RequestMapping\s*\(\s*(?:value\s*=\s*)?["']([^"']+)["'](?:.*method\s*=\s*RequestMethod\.(\w+))?""", 0, 1, "@RequestMapping"),
    (r"""@Path\s*\(\s*["']([^"']+)["']""", 0, 1, "@Path"),
    (r"""#\[(get|post|put|patch|delete)\s*\(\s*["']([^"']+)["']""", 1, 2, "#["),
    (r"""\.(get|post|put|patch|delete)\s*\(\s*["']([^"']+)["']""", 1, 2, LOW),
    (r"""(?:get|post|put|patch|delete)\s+["'](/[^"']+)["']""", 0, 1, '"/ \'/'),
    (r"""resources?\s+:(\w+)""", 0, 1, "resource"),
    (r"""Route::(get|post|put|patch|delete)\s*\(\s*["']([^"']+)["']""", 1, 2, "Route::"),
    (r"""#\[Route\s*\(\s*["']([^"']+)["'](?:.*methods:\s*\[([^\]]+)\])?""", 0, 1, "#[Route"),
    (r"""\[Http(Get|Post|Put|Patch|Delete)\s*\(\s*["']([^"']+)["']""", 1, 2, "[Http"),
    (r"""\[Route\s*\(\s*["']([^"']+)["']""", 0, 1, "[Route"),
    (r"""(get|post|put|patch|delete)\s*\(\s*["']([^"']+)["']""", 1, 2, VERBS),
    (r"""(?:app|grouped)\.(get|post|put|patch|delete)\s*\(\s*["']([^"']+)["']""", 1, 2, LOW),
    (r"""(get|post|put|patch|delete)\s+["']([^"']+)["']""", 1, 2, VERBS),
)
CALLS = (
    # pattern, group of the method (0: none), groups that may hold the URL, group of a variable (0: none), parts of a line one of which every match holds
    (r"""(?:httpx|client|async_client)\.(get|post|put|patch|delete)\s*\(\s*(?:f?["']([^"']*)["']|(\w+))""", 1, (2,), 3, "httpx. client."),
    (r"""requests\.(get|post|put|patch|delete)\s*\(\s*(?:f?["']([^"']*)["']|(\w+))""", 1, (2,), 3, "requests."),
    (r"""session\.(get|post|put|patch|delete)\s*\(\s*(?:f?["']([^"']*)["']|(\w+))""", 1, (2,), 3, "session."),
    (r"""fetch\s*\(\s*(?:`([^`]*)`|["']([^"']*)["'])""", 0, (1, 2), 0, "fetch"),
    (r"""axios\.(get|post|put|patch|delete)\s*\(\s*(?:`([^`]*)`|["']([^"']*)["'])""", 1, (2, 3), 0, "axios."),
    (r"""(?:\$http|http)\.(get|post|put|patch|delete)\s*\(\s*(?:`([^`]*)`|["']([^"']*)["'])""", 1, (2, 3), 0, "http."),
    (r"""http\.(Get|Post|Put|NewRequest)\s*\(\s*["']([^"']*)["']""", 1, (2,), 0, "http."),
    (r"""(?:client|c|resty)\.(Get|Post|Put|Patch|Delete|R)\s*\(\s*["']([^"']*)["']""", 1, (2,), 0, TITLE + " .R"),
    (r"""(?:HttpRequest|RestTemplate|WebClient|Feign)\.\w+\s*\(\s*["']([^"']*)["']""", 0, (1,), 0, "HttpRequest. RestTemplate. WebClient. Feign."),
    (r"""\.uri\s*\(\s*["']([^"']*)["']""", 0, (1,), 0, ".uri"),
    (r"""(?:reqwest|client)\.(get|post|put|patch|delete)\s*\(\s*["']([^"']*)["']""", 1, (2,), 0, "reqwest. client."),
    (r"""Client::new\(\).*\.(get|post|put|patch|delete)\s*\(\s*["']([^"']*)["']""", 1, (2,), 0, "Client::new()"),
    (r"""(?:Net::HTTP|HTTParty|Faraday|RestClient)\.(get|post|put|patch|delete)\s*\(\s*["']([^"']*)["']""", 1, (2,), 0, "Net::HTTP. HTTParty. Faraday. RestClient."),
    (r"""(?:Http|Guzzle|client)->(get|post|put|patch|delete)\s*\(\s*["']([^"']*)["']""", 1, (2,), 0, "->"),
    (r"""file_get_contents\s*\(\s*["']([^"']*)["']""", 0, (1,), 0, "file_get_contents"),
    (r"""(?:HttpClient|client)\.(Get|Post|Put|Patch|Delete)Async\s*\(\s*["']([^"']*)["']""", 1, (2,), 0, "Async"),
    (r"""(?:url|endpoint|base_url|service_url|apiUrl|baseURL)\s*(?:\+|=|:)\s*(?:f?["']([^"']*(?:api|/v\d)[^"']*)["'])""", 0, (1,), 0, "url Url URL endpoint"),
)
VARIABLES = (
    r"""(\w+(?:SERVICE|API|BACKEND)_(?:URL|HOST|BASE_URL|ENDPOINT))\b""",
    r"""os\.(?:environ|getenv)\s*\(\s*["'](\w*(?:URL|HOST|BASE)\w*)["']""",
    r"""(?i)settings\.(\w*(?:url|host|base_url|endpoint)\w*)""",
    r"""os\.Getenv\s*\(\s*["'](\w*(?:URL|HOST|BASE|SERVICE)\w*)["']""",
    r"""(?i)@Value\s*\(\s*["']?\$\{(\w*(?:url|host|base|service)\w*)""",
    r"""System\.getenv\s*\(\s*["'](\w*(?:URL|HOST|BASE|SERVICE)\w*)["']""",
    r"""process\.env\.(\w*(?:URL|HOST|BASE|SERVICE|API)\w*)""",
    r"""(?:NEXT_PUBLIC|VITE|REACT_APP)_(\w*(?:URL|API)\w*)""",
    r"""ENV\s*\[\s*["'](\w*(?:URL|HOST|BASE|SERVICE)\w*)["']""",
    r"""(?:env|getenv)\s*\(\s*["'](\w*(?:URL|HOST|BASE|SERVICE)\w*)["']""",
    r"""Configuration\s*\[\s*["'](\w*(?:Url|Host|Base|Service)\w*)["']""",
    r"""(?:env::var|std::env::var)\s*\(\s*["'](\w*(?:URL|HOST|BASE|SERVICE)\w*)["']""",
    r"""(?m)^(\w+(?:_URL|_HOST|_BASE_URL|_ENDPOINT|_SERVICE))\s*=""",
)
EVENTS = (
    # pattern, direction
    (r"""\.publish\s*\(\s*["']([^"']+)["']""", "publishes"),
    (r"""\.subscribe\s*\(\s*["']([^"']+)["']""", "consumes"),
    (r"""\.send_message\s*\(\s*["']([^"']+)["']""", "publishes"),
    (r"""channel\s*=\s*["']([^"']+)["']""", "consumes"),
    (r"""(?:basic_publish|queue_declare)\s*\(.*["']([^"']+)["']""", "publishes"),
    (r"""(?:produce|send|consume)\s*\(\s*(?:topic\s*=\s*)?["']([^"']+)["']""", "publishes"),
    (r"""\.(?:lpush|rpush|publish)\s*\(\s*["']([^"']+)["']""", "publishes"),
    (r"""(?:TopicArn|QueueUrl)\s*[=:]\s*["']([^"']+)["']""", "consumes"),
    (r"""\.(?:Publish|Subscribe|Request)\s*\(\s*["']([^"']+)["']""", "consumes"),
    (r"""(?:nats|nc)\.(Publish|Subscribe)\s*\(\s*["']([^"']+)["']""", "consumes"),
)
# one of these, too, is in every line that a pattern above matches
ROUTE_MARKS, CALL_MARKS = ('"', "'", "[", "export", "resource"), ("(", '"', "'")
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD")
CRITICAL = ("auth", "login", "token", "payment", "billing", "checkout", "order", "session", "verify")
# end of fixed values
#: lines below a route in which its function is looked for
AHEAD = 5


def _lines(files: DataFrame, patterns: tuple, marks: tuple[str, ...]) -> DataFrame:
    """Lines that may match, each with the lines from it on: those with a mark and a part that some pattern needs, as to look for
    these takes far less than to try the patterns.

    The outer form is for the planner: of the inner one it makes a filter that splits every text once more.
    """
    needs = {x for p in patterns for x in p[-1].split()}
    least = sorted(x for x in needs if not any(y in x for y in needs - {x}))
    each = files.select("service", "file_path", F.split(F.coalesce("content", F.lit("")), "\n", -1).alias("lines")).select("service", "file_path", "lines", F.posexplode_outer("lines").alias("i", "line"))
    likely = each.filter(_any_in(marks) & _any_in(least))
    return likely.select("service", "file_path", (F.col("i") + 1).alias("no"), "line", F.slice("lines", F.col("i") + 1, AHEAD).alias("near"))


def _any_in(parts: Iterable[str]) -> Column:
    return reduce(lambda x, y: x | y, [F.contains("line", F.lit(p)) for p in parts])


def _tried(pattern: str, needs: str, hit: Column) -> Column:
    return F.when(_any_in(needs.split()) & F.col("line").rlike(pattern), hit)


def _hits(rows: DataFrame, hits: list[Column], kind: str) -> DataFrame:
    """``rows`` with ``h``, a row a hit, of type ``kind``.

    Outer, or the planner tries all patterns once in a filter and once more behind it; cast, or the array's type is worked out
    from its parts again for every row.
    """
    return rows.withColumn("h", F.explode_outer(F.array_compact(F.array(*hits).cast(f"array<struct<{kind}>>")))).filter("h is not null")


def _part(pattern: str, group: int) -> Column:
    return F.regexp_extract("line", pattern, group) if group else F.lit("")


def _method(x: Column) -> Column:
    up = F.regexp_replace(F.upper(x), "MAPPING$", "")
    return F.when(up.isin(*METHODS), up).otherwise("ANY")


def endpoints(files: DataFrame) -> DataFrame:
    """``(service, file_path, line, method, path, function, pattern)``: a row a line and pattern that matches it.

    The function is the first ``def`` in the route's line and the four after it.
    """
    hits = [_tried(p, n, F.struct(F.lit(i).alias("pattern"), _part(p, m).alias("method"), _part(p, g).alias("path"))) for i, (p, m, g, n) in enumerate(ROUTES)]
    rows = _hits(_lines(files, ROUTES, ROUTE_MARKS), hits, "pattern:int,method:string,path:string").filter("h.path <> ''")
    names = F.transform("near", lambda x: F.regexp_extract(x, r"(?:async\s+)?def\s+(\w+)", 1))
    name = F.coalesce(F.get(F.filter(names, lambda x: x != ""), F.lit(0)), F.lit(""))
    return rows.select("service", "file_path", F.col("no").alias("line"), _method(F.col("h.method")).alias("method"), "h.path", name.alias("function"), "h.pattern")


def outbound_calls(files: DataFrame) -> DataFrame:
    """``(service, file_path, line, method, url, variable, raw)``: a row a line and pattern; one with neither URL nor variable is left out."""
    hits = [_tried(p, n, F.struct(F.lit(i).alias("pattern"), _part(p, m).alias("method"), F.array(*[_part(p, x) for x in g]).alias("urls"), _part(p, v).alias("own"))) for i, (p, m, g, v, n) in enumerate(CALLS)]
    rows = _hits(_lines(files, CALLS, CALL_MARKS), hits, "pattern:int,method:string,urls:array<string>,own:string")
    url = F.get(F.filter("h.urls", lambda x: x.contains("/") | F.lower(x).contains("http") | x.contains("{")), F.lit(0))
    variable = F.get(F.filter(F.array_append("h.urls", F.col("h.own")), lambda x: x.rlike(r"^[A-Za-z_]\w*$")), F.lit(0))
    found = rows.select("service", "file_path", F.col("no").alias("line"), _method(F.col("h.method")).alias("method"), url.alias("url"), variable.alias("variable"), F.substring(F.trim("line"), 1, 200).alias("raw"), "h.pattern")
    return found.filter("url is not null or variable is not null")


def url_variables(files: DataFrame) -> DataFrame:
    """``(service, name)``, each once."""
    text = F.coalesce("content", F.lit(""))
    return files.select("service", F.explode(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in VARIABLES]))).alias("name")).distinct()


def events(files: DataFrame) -> DataFrame:
    """``(service, file_path, event, direction)``, a row a match; the direction goes with the pattern."""
    text = F.coalesce("content", F.lit(""))
    each = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), _towards(d)) for p, d in EVENTS]
    return files.select("service", "file_path", F.explode(F.flatten(F.array(*each))).alias("e")).select("service", "file_path", "e.*")


def _towards(direction: str):
    return lambda x: F.struct(x.alias("event"), F.lit(direction).alias("direction"))


def call_path(url: Column) -> Column:
    """The path of a URL: without host, without the first ``{variable}/``, with one slash in front; empty: null."""
    bare = F.regexp_replace(url, r"https?://[^/]+", "")
    bare = F.trim(F.regexp_replace(F.concat(F.regexp_extract(bare, r"^(.*?)(\{[^}]*\}/|$)", 1), F.regexp_replace(bare, r"^.*?(\{[^}]*\}/|$)", "")), r"^[/ ]+|[/ ]+$", ""))
    return F.nullif(F.when(bare == "", "").otherwise(F.concat(F.lit("/"), bare)), F.lit(""))


def normal(path: Column) -> Column:
    return F.lower(F.regexp_replace(path, r"^/+|/+$", ""))


def as_pattern(path: Column) -> Column:
    """The anchored regex of an endpoint's path: ``{x}`` and ``<x>`` stand for one part."""
    quoted = F.regexp_replace(normal(path), r"([\\.^$+*?()|\[\]])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\{[^}]+\}", "[^/]+"), r"<[^>]+>", "[^/]+"), F.lit("$"))


def resolve(calls: DataFrame, provided: DataFrame) -> DataFrame:
    """``calls(service, url, ...)`` against ``provided(service, path, ord)`` -> the calls with ``provider``, ``endpoint``, ``is_critical``.

    A call meets the endpoints of other services that have as many parts and whose parts up to the first parameter are
    its own first parts: an equi join, after which the pattern is tried. The first endpoint by ``ord`` wins; calls without
    one are left out. A path that a service offers in many files is one endpoint, so a call meets it once.
    """
    c = checkpointed(calls.withColumn("call_path", call_path(F.col("url"))).filter("call_path is not null"))  # what finds calls runs once for both uses
    distinct = c.select("service", "call_path").distinct().withColumn("k", F.split(normal(F.col("call_path")), "/"))
    starts = F.transform(F.sequence(F.lit(0), F.size("k")), lambda n: F.array_join(F.slice("k", F.lit(1), n), "/"))
    distinct = distinct.select("service", "call_path", F.size("k").alias("parts"), F.explode(F.array_distinct(starts)).alias("lead"))
    offered = provided.groupBy("service", "path").agg(F.min(F.struct("ord")).alias("first"))  # in a struct null comes first, as it does below
    e = offered.select(F.col("service").alias("provider"), F.col("path").alias("endpoint"), "first.ord", as_pattern(F.col("path")).alias("pattern"), F.size(F.split(normal(F.col("path")), "/")).alias("parts"), F.regexp_replace(normal(F.col("path")), r"/?[^/]*[{<].*$", "").alias("lead"))
    met = distinct.join(e, ["parts", "lead"]).filter((F.col("service") != F.col("provider")) & F.regexp_like(normal(F.col("call_path")), F.col("pattern")))
    best = met.groupBy("service", "call_path").agg(F.min(F.struct("ord", "provider", "endpoint")).alias("e"))
    out = c.join(best, ["service", "call_path"])
    return out.select(*calls.columns, F.col("e.provider").alias("provider"), F.col("e.endpoint").alias("endpoint"), is_critical(F.col("call_path")).alias("is_critical"))


def is_critical(path: Column) -> Column:
    return F.lower(path).rlike("|".join(CRITICAL))


def service_map(services: DataFrame, provided: DataFrame, dependencies: DataFrame) -> DataFrame:
    """``(service, n_endpoints, depends_on, depended_on_by)``; the last two are sorted arrays of services."""
    n = provided.groupBy("service").agg(F.count("*").alias("n_endpoints"))
    links = checkpointed(dependencies.select("service", "provider").distinct())  # a row a pair of services: what finds them runs once for both ends
    out = links.groupBy("service").agg(F.array_sort(F.collect_set("provider")).alias("depends_on"))
    into = links.groupBy(F.col("provider").alias("service")).agg(F.array_sort(F.collect_set("service")).alias("depended_on_by"))
    got = services.select("service").distinct().join(n, "service", "left").join(out, "service", "left").join(into, "service", "left")
    none = F.array().cast("array<string>")
    return got.select("service", F.coalesce("n_endpoints", F.lit(0)).alias("n_endpoints"), F.coalesce("depends_on", none).alias("depends_on"), F.coalesce("depended_on_by", none).alias("depended_on_by"))


def risk(critical: Column, affected: Column) -> Column:
    return F.when(critical, "critical").when(affected >= 5, "high").when(affected >= 2, "medium").otherwise("low")


def advice(level: Column, affected: Column, services: Column) -> Column:
    who = F.array_join(services, ", ")
    n = affected.cast("string")
    return (
        F.when(level == "critical", F.concat(n, F.lit(" dependents, some on critical paths: agree on the change with "), who, F.lit(" or keep the old version beside the new.")))
        .when(level == "high", F.concat(n, F.lit(" dependents: tell "), who, F.lit(" ahead and think of a new version.")))
        .when(level == "medium", F.concat(n, F.lit(" dependents: check that "), who, F.lit(" still work.")))
        .otherwise(F.concat(n, F.lit(" dependent: no more than the usual care.")))
    )


def impact(provided: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Endpoints that others call, by distinct normalised path: ``(service, endpoint, affected, services, risk, advice)``."""
    e = provided.groupBy("service", normal(F.col("path")).alias("key")).agg(F.min_by("path", "ord").alias("endpoint"))
    d = dependencies.groupBy(F.col("provider").alias("service"), normal(F.col("endpoint")).alias("key")).agg(F.count("*").alias("affected"), F.array_sort(F.collect_set("service")).alias("services"), F.bool_or("is_critical").alias("critical"))
    got = e.join(d, ["service", "key"]).withColumn("risk", risk(F.col("critical"), F.col("affected")))
    return got.select("service", "endpoint", "affected", "services", "risk", advice(F.col("risk"), F.col("affected"), F.col("services")).alias("advice"))


def scan(files: DataFrame) -> DataFrame:
    """Counts a service: ``(service, files, endpoints, calls, variables, events)``."""
    out = files.groupBy("service").agg(F.count("*").alias("files"))
    for name, found in (("endpoints", endpoints(files)), ("calls", outbound_calls(files)), ("variables", url_variables(files)), ("events", events(files))):
        out = out.join(found.groupBy("service").agg(F.count("*").alias(name)), "service", "left")
    return out.fillna(0, ["endpoints", "calls", "variables", "events"])


def named(service: Column) -> Column:
    """A service's name from its id."""
    return F.initcap(F.translate(service, "-_", "  "))


def last_scan(registered: DataFrame) -> DataFrame:
    """``registered(service_id, repo_path, indexed_at)``: the last registration of each service, with its name."""
    by = Window.partitionBy("service_id").orderBy(F.desc("indexed_at"), "repo_path")
    return registered.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n").withColumn("name", named(F.col("service_id")))

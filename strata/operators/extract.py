"""Nodes and edges of source files, from their lines by column expressions; nothing leaves the JVM.

Line-wise patterns find imports, classes and functions of Python and JavaScript, and declarations of
other languages. Relative imports of Python resolve against the file's own package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions import paths

#: declarations of languages that only this table covers: language, kind, pattern with the name as group 1
DECLARED = (
    ("go", "function", r"^\s*func\s+(?:\([^)]*\)\s*)?(\w+)"), ("go", "class", r"^\s*type\s+(\w+)\s+(?:struct|interface)\b"),
    ("rust", "function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"), ("rust", "class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)"),
    ("java", "class", r"^\s*(?:\w+\s+)*(?:class|interface|enum)\s+(\w+)"), ("kotlin", "class", r"^\s*(?:\w+\s+)*(?:class|interface|object)\s+(\w+)"),
    ("kotlin", "function", r"^\s*(?:\w+\s+)*fun\s+(\w+)"), ("csharp", "class", r"^\s*(?:\w+\s+)*(?:class|interface|struct|enum)\s+(\w+)"),
    ("ruby", "class", r"^\s*(?:class|module)\s+(\w+)"), ("ruby", "function", r"^\s*def\s+(?:self\.)?(\w+)"),
    ("php", "class", r"^\s*(?:\w+\s+)*(?:class|interface|trait)\s+(\w+)"), ("php", "function", r"^\s*(?:\w+\s+)*function\s+(\w+)"),
    ("scala", "class", r"^\s*(?:\w+\s+)*(?:class|trait|object)\s+(\w+)"), ("scala", "function", r"^\s*(?:\w+\s+)*def\s+(\w+)"),
    ("swift", "class", r"^\s*(?:\w+\s+)*(?:class|struct|protocol|enum)\s+(\w+)"), ("swift", "function", r"^\s*(?:\w+\s+)*func\s+(\w+)"),
    ("elixir", "class", r"^\s*defmodule\s+([\w.]+)"), ("elixir", "function", r"^\s*defp?\s+(\w+)"), ("lua", "function", r"^\s*(?:local\s+)?function\s+([\w.:]+)"),
    ("c", "class", r"^\s*(?:typedef\s+)?(?:struct|enum|union)\s+(\w+)\s*\{"), ("c", "function", r"^[A-Za-z_][\w\s*]*?\b(\w+)\s*\([^;]*$"),
    ("cpp", "class", r"^\s*(?:template\s*<[^>]*>\s*)?(?:class|struct|enum(?:\s+class)?)\s+(\w+)"), ("cpp", "function", r"^[A-Za-z_][\w\s:<>*&,]*?\b(\w+)\s*\([^;]*$"),
    ("dart", "class", r"^\s*(?:abstract\s+)?(?:class|mixin|enum|extension)\s+(\w+)"), ("dart", "function", r"^\s*(?:static\s+)?[A-Za-z_][\w<>?]*\s+(\w+)\s*\([^;]*$"),
    ("haskell", "class", r"^(?:data|newtype|class|type)\s+(?:\([^)]*\)\s*=>\s*)?([A-Z]\w*)"), ("haskell", "function", r"^([a-z]\w*)\s*::"),
)
JAVASCRIPT = ("javascript", "typescript", "tsx")
#: fixed values: what an import's specifier may be short for, in order
_JS_ENDS = (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")


def node_id(path: Column, kind: Column, name: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", path, kind, name), 256), 1, 16)


def _lines(files: DataFrame) -> DataFrame:
    own = files.select("file_path", paths.language(F.col("file_path")).alias("language"), F.coalesce("content", F.lit("")).alias("content"))
    return own.select("file_path", "language", F.posexplode(F.split("content", "\n", -1)).alias("i", "line"))


def _group(pattern: str) -> Column:
    return F.nullif(F.regexp_extract("line", pattern, 1), F.lit(""))


def modules(files: DataFrame) -> DataFrame:
    """One module node a file, over all its lines."""
    path, text = F.col("file_path"), F.coalesce("content", F.lit(""))
    name = paths.stem(path)
    return files.select(
        node_id(path, F.lit("module"), name).alias("node_id"), F.lit("module").alias("kind"), name.alias("name"), paths.qualified_module(path).alias("qualified_name"), path, F.lit(1).alias("line_start"),
        F.size(F.split(text, "\n", -1)).alias("line_end"), paths.language(path).alias("language"), paths.is_test(path).alias("is_test"), paths.is_entry_point(path, text).alias("is_entry_point"), paths.is_generated(text).alias("is_generated"),
    )


def declarations(files: DataFrame) -> DataFrame:
    """Class and function nodes by the line that declares them; a line may declare one of each kind."""
    lang = F.col("language")
    found = [
        F.when(lang == "python", F.struct(F.lit("class").alias("kind"), _group(r"^\s*class\s+(\w+)").alias("name"))),
        F.when(lang == "python", F.struct(F.lit("function").alias("kind"), _group(r"^\s*(?:async\s+)?def\s+(\w+)").alias("name"))),
        F.when(lang.isin(*JAVASCRIPT), F.struct(F.lit("function").alias("kind"), _group(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)").alias("name"))),
        F.when(lang.isin(*JAVASCRIPT), F.struct(F.lit("function").alias("kind"), _group(r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s+)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>").alias("name"))),
        F.when(lang.isin(*JAVASCRIPT), F.struct(F.lit("class").alias("kind"), _group(r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)").alias("name"))),
        *[F.when(lang == x, F.struct(F.lit(kind).alias("kind"), _group(pattern).alias("name"))) for x, kind, pattern in DECLARED],
    ]
    rows = _lines(files).select("file_path", "language", "i", "line", F.explode(F.filter(F.array(*found), lambda s: s["name"].isNotNull())).alias("s"))
    path, line = F.col("file_path"), (F.col("i") + 1).alias("line_start")
    return rows.select(
        node_id(path, F.col("s.kind"), F.col("s.name")).alias("node_id"), F.col("s.kind").alias("kind"), F.col("s.name").alias("name"), F.concat_ws(".", paths.qualified_module(path), "s.name").alias("qualified_name"), path, line,
        (F.col("i") + 1).alias("line_end"), "language", F.col("line").rlike(r"^\s*(export\s+)?(default\s+)?async\s|=\s*async\b").alias("is_async"),
    )


def imports(files: DataFrame) -> DataFrame:
    """``(file_path, language, line_no, module, candidates, fallback)``: what each import may mean, in order."""
    text, lang = F.coalesce("content", F.lit("")), paths.language(F.col("file_path"))
    # indented lines below ``if TYPE_CHECKING:`` are for type checkers alone; only files that have such a block carry them
    blocks = F.regexp_extract_all(text, F.lit(r"(?m)^if\s+(?:typing\.)?TYPE_CHECKING\b[^\n]*\n((?:[ \t]+[^\n]*(?:\n|\z)|[ \t]*\n)*)"), F.lit(1))
    typed = F.when((lang == "python") & text.contains("TYPE_CHECKING"), F.flatten(F.transform(blocks, lambda x: F.split(x, "\n", -1))))
    rows = files.select("file_path", lang.alias("language"), typed.alias("typed"), text.alias("content")).filter(F.col("language").isin("python", *JAVASCRIPT))
    rows = rows.select("file_path", "language", "typed", F.posexplode(F.split("content", "\n", -1)).alias("i", "line"))
    for_types = F.when(F.col("language") == "python", F.coalesce(F.col("line").rlike(r"^\s") & F.array_contains("typed", F.col("line")), F.lit(False))).otherwise(F.col("line").rlike(r"^\s*import\s+type\b"))
    rows = rows.withColumn("is_type_only", for_types)
    python = F.coalesce(_group(r"^\s*from\s+(\.*[\w.]*)\s+import\b"), _group(r"^\s*import\s+([\w.]+)"))
    script = F.coalesce(_group(r"""\bfrom\s+['"]([^'"]+)['"]"""), _group(r"""\brequire\(\s*['"]([^'"]+)['"]"""), _group(r"""^\s*import\s+['"]([^'"]+)['"]"""))
    rows = rows.withColumn("module", F.when(F.col("language") == "python", python).otherwise(script)).filter("module is not null")
    here, m = paths.folder(F.col("file_path")), F.col("module")
    dots = F.length(F.regexp_extract(m, r"^(\.*)", 1))
    tail = F.replace(F.regexp_replace(m, r"^\.+", ""), F.lit("."), F.lit("/"))
    up = F.concat_ws("/", F.array_repeat(F.lit(".."), F.greatest(dots - 1, F.lit(0))))
    own = paths.joined(here, F.concat_ws("/", up, tail))
    near = F.array(F.concat(own, F.lit(".py")), F.concat(own, F.lit("/__init__.py")))
    far = F.array(F.concat(tail, F.lit(".py")), F.concat(F.lit("src/"), tail, F.lit(".py")), F.concat(F.lit("lib/"), tail, F.lit(".py")), F.concat(tail, F.lit("/__init__.py")))
    at = paths.joined(here, m)
    relative = F.array(*[F.concat(at, F.lit(x)) for x in _JS_ENDS])
    bare = F.array(F.concat(F.lit("node_modules/"), m, F.lit("/index.js")))
    choice = F.when(F.col("language") == "python", F.when(dots > 0, near).otherwise(far)).otherwise(F.when(m.startswith("."), relative).otherwise(bare))
    return rows.select("file_path", "language", (F.col("i") + 1).alias("line_no"), "module", "is_type_only", choice.alias("candidates")).withColumn("fallback", F.element_at("candidates", 1))


def resolve(found: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``target_path``, the first candidate that is a file, else the fallback.

    Only distinct candidate lists meet the catalogue of files, so a module that every file imports costs one row.
    """
    tried = found.select("candidates").distinct().select("candidates", F.posexplode("candidates").alias("i", "path"))
    hit = tried.join(files.select(F.col("file_path").alias("path")).distinct(), "path", "left_semi").groupBy("candidates").agg(F.min_by("path", "i").alias("hit"))
    return found.join(hit, "candidates", "left").withColumn("target_path", F.coalesce("hit", "fallback")).drop("hit")


def edges(files: DataFrame) -> DataFrame:
    """Import edges between module nodes; ``is_resolved`` says that the target is one of ``files``."""
    return as_edges(resolve(imports(files), files), files)


def as_edges(found: DataFrame, files: DataFrame) -> DataFrame:
    """Resolved imports as edges, one a pair of modules; for types only if each of the pair's imports is."""
    known = files.select(F.col("file_path").alias("target_path"), F.lit(True).alias("is_resolved")).distinct()
    a, b = F.col("file_path"), F.col("target_path")
    module = F.lit("module")
    e = found.join(known, "target_path", "left").select(node_id(a, module, paths.stem(a)).alias("source_id"), node_id(b, module, paths.stem(b)).alias("target_id"), a, b, "module", "is_type_only", F.coalesce("is_resolved", F.lit(False)).alias("is_resolved"))
    return e.groupBy("source_id", "target_id").agg(
        F.first("file_path").alias("file_path"), F.first("target_path").alias("target_path"), F.min("module").alias("module"), F.first("is_resolved").alias("is_resolved"), F.lit("imports").alias("kind"), F.lit(0.9).alias("confidence"), F.bool_and("is_type_only").alias("is_type_only")
    )


def structured(files: DataFrame) -> DataFrame:
    """:func:`declarations` with what Python says further: where a block ends, superclasses, docstring, decorators.

    A class with ``Protocol`` or ``ABC`` above it is an interface; a function with a routing decorator an endpoint; of overloads
    only the one that is not marked so stays. A block ends before the next line that is indented no deeper.
    """
    d = declarations(files)
    text = files.select("file_path", F.split(F.coalesce("content", F.lit("")), "\n", -1).alias("lines"))
    d = d.join(text, "file_path")
    at = F.col("line_start")
    own = F.element_at("lines", at)
    depth = F.length(F.regexp_extract(own, r"^(\s*)", 1))
    after = F.slice("lines", at + 1, F.greatest(F.size("lines") - at, F.lit(0)))
    ends = F.transform(after, lambda x, i: F.when((F.trim(x) != "") & (F.length(F.regexp_extract(x, r"^(\s*)", 1)) <= depth), i))
    stop = F.coalesce(F.array_min(F.filter(ends, lambda x: x.isNotNull())), F.size(after))
    body = F.slice(after, 1, stop)
    filled = F.filter(F.transform(body, lambda x, i: F.when(F.trim(x) != "", i + 1)), lambda x: x.isNotNull())
    last = at + F.coalesce(F.array_max(filled), F.lit(0))
    python = F.col("language") == "python"
    head = F.array_join(F.slice("lines", at, 20), " ")
    supers = F.when(python & (F.col("kind") == "class"), F.filter(F.transform(F.split(F.regexp_extract(head, r"^\s*class\s+\w+\s*\(([^)]*)\)", 1), ","), lambda x: F.trim(x)), lambda x: (x != "") & ~x.contains("="))).otherwise(F.array().cast("array<string>"))
    first = F.trim(F.array_join(F.slice(body, 1, 30), "\n"))
    doc = F.when(python, F.nullif(F.trim(F.coalesce(F.nullif(F.regexp_extract(first, r'^[rRuU]?"{3}([\s\S]*?)"{3}', 1), F.lit("")), F.regexp_extract(first, r"^[rRuU]?'{3}([\s\S]*?)'{3}", 1))), F.lit("")))
    # decorators: the unbroken run of lines with @ right above
    above = F.reverse(F.slice("lines", F.greatest(at - 8, F.lit(1)), F.least(at - 1, F.lit(8))))
    marks = F.when(python & (at > 1), F.aggregate(above, F.struct(F.lit(True).alias("on"), F.array().cast("array<string>").alias("x")), lambda acc, x: F.when(acc["on"] & F.trim(x).startswith("@"), F.struct(F.lit(True).alias("on"), F.array_append(acc["x"], F.trim(x)).alias("x"))).otherwise(F.struct(F.lit(False).alias("on"), acc["x"].alias("x"))), lambda acc: acc["x"])).otherwise(F.array().cast("array<string>"))
    has = lambda pattern: F.exists("decorators", lambda x: x.rlike(pattern))
    d = d.withColumns({"superclasses": supers, "docstring": doc, "decorators": marks, "line_end": F.when(python, last).otherwise(F.col("line_end"))})
    flags = {"is_static": has(r"^@staticmethod\b"), "is_class_method": has(r"^@classmethod\b"), "is_property": has(r"^@(property|[\w.]*cached_property)\b|^@\w+\.setter\b"), "is_overload": has(r"^@(typing\.)?overload\b")}
    route = has(r"^@[\w.]+\.(route|get|post|put|patch|delete|websocket)\b")
    kind = F.when((F.col("kind") == "class") & F.exists("superclasses", lambda x: x.rlike(r"^(\w+\.)*(Protocol|ABC)(\[.*)?$")), "interface").when((F.col("kind") == "function") & route, "endpoint").otherwise(F.col("kind"))
    return d.withColumns(flags).filter(~F.col("is_overload")).withColumn("kind", kind).drop("lines", "is_overload")


def inherits(files: DataFrame) -> DataFrame:
    """Edges from Python classes to the classes they name above them: of the same file, else of the only file that declares the name."""
    d = structured(files).filter(F.col("kind").isin("class", "interface")).select("node_id", "name", "file_path", "superclasses")
    want = d.select(F.col("node_id").alias("source_id"), "file_path", F.explode("superclasses").alias("s")).withColumn("name", F.regexp_extract("s", r"(\w+)(\[.*)?$", 1))
    here = d.select("file_path", "name", F.col("node_id").alias("here"))
    there = d.groupBy("name").agg(F.count_distinct("node_id").alias("n"), F.min("node_id").alias("there")).filter("n = 1").drop("n")
    got = want.join(here, ["file_path", "name"], "left").join(there, "name", "left").withColumn("target_id", F.coalesce("here", "there"))
    got = got.filter(F.col("target_id").isNotNull() & (F.col("target_id") != F.col("source_id")))
    return got.select("source_id", "target_id", F.lit("inherits").alias("kind"), F.lit(1.0).alias("confidence"), F.lit(False).alias("is_type_only")).distinct()


def re_exports(files: DataFrame) -> DataFrame:
    """Edges from a Python module to the nodes whose names its ``__all__`` lists and that another module declares, if one alone does."""
    path = F.col("file_path")
    listed = F.regexp_extract(F.coalesce("content", F.lit("")), r"(?m)^__all__\s*(?::[^=]+)?=\s*[\[(]([^\])]*)", 1)
    names = files.filter(paths.language(path) == "python").select(node_id(path, F.lit("module"), paths.stem(path)).alias("source_id"), "file_path", F.explode(F.regexp_extract_all(listed, F.lit(r"""["'](\w+)["']"""), F.lit(1))).alias("name"))
    d = declarations(files).select("name", "node_id", F.col("file_path").alias("declared"))
    one = names.join(d, "name").filter("declared <> file_path").groupBy("source_id", "name").agg(F.count_distinct("node_id").alias("n"), F.min("node_id").alias("target_id")).filter("n = 1")
    return one.select("source_id", "target_id", F.lit("re_exports").alias("kind"), F.lit(1.0).alias("confidence"), F.lit(False).alias("is_type_only")).distinct()

"""What a file's path and head say about it, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: suffixes of a language
LANGUAGES = {
    "python": (".py", ".pyi"), "javascript": (".js", ".mjs", ".cjs", ".jsx"), "typescript": (".ts",), "tsx": (".tsx",), "go": (".go",), "rust": (".rs",), "java": (".java",), "ruby": (".rb",),
    "c": (".c", ".h"), "cpp": (".cpp", ".cc", ".cxx", ".hpp"), "csharp": (".cs",), "php": (".php",), "swift": (".swift",), "kotlin": (".kt", ".kts"), "scala": (".scala",), "lua": (".lua",),
    "dart": (".dart",), "elixir": (".ex", ".exs"), "haskell": (".hs",),
}
SUFFIXES = {s: language for language, all_ in LANGUAGES.items() for s in all_}
#: fixed values: stems of files that a program starts in
ENTRY_STEMS = ("main", "app", "manage", "server", "worker", "cli")
#: fixed values: what marks a generated file in its first five lines
GENERATED = ("# generated", "// generated", "/* generated", "@generated", "do not edit", "auto-generated")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]+)?$", 1)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    return F.coalesce(F.element_at(known, suffix(path)), F.lit("unknown"))


def is_test(path: Column) -> Column:
    name = F.lower(stem(path)).rlike(r"^test_|[_.](test|spec)$|^conftest$") & ~F.lower(stem(path)).rlike(r"^[_.](test|spec)$")
    return name | F.lower(path).rlike(r"(^|/)(tests?|__tests__|specs?)(/|$)")


def is_test_for_rules(path: Column) -> Column:
    """The narrower test of contract scopes: no dotted endings, no ``conftest``, no ``specs`` folder."""
    return F.lower(stem(path)).rlike(r"^test_|_(test|spec)$") | F.lower(path).rlike(r"(^|/)(tests?|__tests__|spec)(/|$)")


def is_entry_point(path: Column, content: Column) -> Column:
    return F.lower(stem(path)).isin(*ENTRY_STEMS) | (content.contains("__name__") & content.contains("__main__"))


def is_generated(content: Column, markers: tuple[str, ...] = GENERATED) -> Column:
    head = F.lower(F.substring_index(content, "\n", 5))
    return F.coalesce(F.greatest(F.lit(False), *[head.contains(m.lower()) for m in markers]), F.lit(False))


def qualified_module(path: Column) -> Column:
    """``src/a/b/__init__.py`` -> ``a.b``; a path of nothing else falls back to its stem."""
    bare = F.regexp_replace(path, r"\.[^./]+$", "")
    bare = F.regexp_replace(bare, r"^(src|lib|app)(/|$)", "")
    bare = F.regexp_replace(bare, r"(^|/)__init__$", "")
    bare = F.regexp_replace(bare, r"(^|/)(index|mod)$", "")
    return F.when(bare == "", stem(path)).otherwise(F.replace(bare, F.lit("/"), F.lit(".")))


def joined(base: Column, relative: Column) -> Column:
    """``relative`` seen from folder ``base``, without ``.`` and ``..``."""
    parts = F.split(F.concat_ws("/", base, relative), "/")
    step = lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")

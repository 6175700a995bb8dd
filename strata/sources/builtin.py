"""Contracts that every project has, and rule packs that one may take, as frames like ``records.read_contracts`` gives them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.sources.records import CONTRACT

# fixed values from here to the next comment: ids, kinds, severities, patterns and limits
BUILTIN = (
    ("ai-guardrails", 500, (), (), (), (
        ("no-hallucinated-imports", "ai_antipattern", "error", None, None, None, None), ("no-over-abstraction", "ai_antipattern", "warning", None, None, None, None),
        ("no-unnecessary-error-handling", "ai_antipattern", "warning", None, None, None, None),
        ("no-restating-comments", "ai_antipattern", "info", r"#\s*(set|get|create|update|delete|increment|initialize|return)\s", None, None, None),
        ("no-speculative-features", "ai_antipattern", "warning", None, None, None, None), ("no-excessive-logging", "ai_antipattern", "info", None, None, None, None),
    )),
    ("architecture-basics", 400, (), (), (), (
        ("no-circular-imports", "architectural", "warning", None, None, None, None), ("no-god-files", "threshold", "warning", None, None, "max_lines", 500.0), ("no-god-functions", "threshold", "warning", None, None, "max_function_lines", 50.0),
    )),
)
PACKS = (
    ("fastapi-conventions", 300, ("src/**", "app/**"), ("**/tests/**", "**/*_test.py", "**/conftest.py"), ("python",), (
        ("layered-architecture", "architectural", "error", r"(Session|AsyncSession|engine|sessionmaker|create_engine)", None, None, None),
        ("no-business-logic-in-routers", "architectural", "warning", None, None, None, None),
        ("separate-schemas", "pattern", "error", r"\bresponse_model\s*=\s*[A-Z]\w*(Model|Table|ORM)", None, None, None),
        ("no-orm-in-response", "pattern", "error", r"from_attributes\s*=\s*True", None, None, None),
        ("async-everywhere", "pattern", "error", r"\brequests\.(get|post|put|delete|patch)\(", None, None, None),
        ("no-sync-sleep", "pattern", "error", r"\btime\.sleep\(", None, None, None),
        ("use-depends", "pattern", "warning", r"\b\w+Service\(\)", None, None, None),
        ("custom-exceptions", "pattern", "warning", r"raise HTTPException\(status_code=\d+", None, None, None),
        ("pydantic-settings", "pattern", "warning", r"os\.environ\.(get|__getitem__)", None, None, None),
        ("no-hardcoded-secrets", "pattern", "error", r"(password|secret|api_key|token)\s*=\s*[\"'][^\"']{8,}[\"']", None, None, None),
    )),
    ("react-typescript", 300, ("src/**",), ("**/*.test.*", "**/*.spec.*", "**/__tests__/**"), ("typescript", "tsx"), (
        ("functional-only", "pattern", "warning", r"class\s+\w+\s+extends\s+(React\.)?Component", None, None, None),
        ("no-any", "pattern", "error", r":\s*any\b|<any>|as any", None, None, None),
        ("define-prop-types", "pattern", "warning", None, r"interface\s+\w+Props|type\s+\w+Props", None, None),
        ("custom-hooks-for-logic", "pattern", "warning", None, None, None, None),
        ("no-useeffect-fetch", "pattern", "warning", r"useEffect\([^)]*fetch\(|useEffect\([^)]*axios", None, None, None),
        ("deps-array-exhaustive", "pattern", "error", r"// eslint-disable.*exhaustive-deps", None, None, None),
        ("no-prop-drilling", "architectural", "warning", None, None, None, None),
        ("no-inline-objects-jsx", "pattern", "warning", r"<\w+[^>]*\{\{[^}]+\}\}[^>]*>", None, None, None),
        ("lazy-routes", "pattern", "info", None, None, None, None),
        ("error-boundaries", "architectural", "warning", None, None, None, None),
        ("test-behavior-not-implementation", "pattern", "info", r"\.(state|instance)\(\)|wrapper\.find\(", None, None, None),
    )),
    ("nodejs-express", 300, ("src/**", "app/**", "routes/**", "middleware/**"), ("**/*.test.*", "**/*.spec.*", "**/__tests__/**", "node_modules/**"), ("javascript", "typescript"), (
        ("router-controller-service", "architectural", "warning", None, None, None, None),
        ("no-db-in-routes", "pattern", "error", r"(mongoose\.|prisma\.|knex\(|sequelize\.|pool\.query)", None, None, None),
        ("async-error-wrapper", "pattern", "error", r"router\.(get|post|put|delete|patch)\([^,]+,\s*async", None, None, None),
        ("centralized-error-handler", "architectural", "warning", r"catch\s*\(\w+\)\s*\{[^}]*res\.status\(500\)", None, None, None),
        ("no-unhandled-promises", "pattern", "error", r"\.then\([^)]+\)\s*$", None, None, None),
        ("helmet-middleware", "pattern", "warning", None, r"helmet\(", None, None),
        ("rate-limiting", "architectural", "warning", None, None, None, None),
        ("no-eval", "pattern", "error", r"\beval\(|new Function\(", None, None, None),
        ("input-validation", "architectural", "error", None, None, None, None),
        ("no-hardcoded-config", "pattern", "error", r"listen\(\d{4}\)|localhost:\d{4}|127\.0\.0\.1:\d{4}", None, None, None),
        ("structured-logging", "pattern", "warning", r"console\.(log|error|warn|info)\(", None, None, None),
        ("no-sync-fs", "pattern", "error", r"\bfs\.(read|write|stat|unlink|mkdir|rmdir|access|exists)Sync\b", None, None, None),
    )),
)
# end of fixed values


def _frame(spark: SparkSession, table: tuple) -> DataFrame:
    said = lambda x: x.replace("-", " ").capitalize()
    rows = [
        (i, said(i), None, p, (list(inside), list(outside), list(languages), False, True), [(r, said(r), said(r), k, s, a, b, m, v, None, None) for r, k, s, a, b, m, v in rules])
        for i, p, inside, outside, languages, rules in table
    ]
    return spark.createDataFrame(rows, CONTRACT)


def builtin_contracts(spark: SparkSession) -> DataFrame:
    """The two that hold for every file; ``operators.contracts.merged`` lets a project's own of the same id replace them."""
    return _frame(spark, BUILTIN)


def rule_packs(spark: SparkSession, *ids: str) -> DataFrame:
    """Packs by id, all if none is named."""
    return _frame(spark, tuple(p for p in PACKS if not ids or p[0] in ids))

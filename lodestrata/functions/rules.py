"""Classification rules of paths, subjects, addresses and counts as column expressions.

All are native expressions, so that they stay inside code generation and filters on them
can be pushed. The patterns are also what the SQL of `plans.oracles` is built from.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, lists, orders of precedence and bounds that results depend on.
TEST_PATH = r"(^|/)(tests|test|__tests__|spec)/|(^|/)(test_[^/]+|_test)\.py$|_test\.go$|\.spec\.(ts|tsx|js|jsx)$|\.test\.(ts|tsx|js|jsx)$|_spec\.rb$"
DOC_OR_CONFIG_PATH = r"\.(md|rst)$|(^|/)(docs|documentation|\.github)(/|$)|(^|/)(LICENSE|CHANGELOG|CONTRIBUTING)"
SURFACE_PATTERNS = {
    "test": TEST_PATH,
    "docs": r"(^|/)(docs|documentation)(/|$)|\.(md|rst|adoc)$|(^|/)(LICENSE|CHANGELOG|CONTRIBUTING)(\.|$)",
    "ci_cd": r"(^|/)\.github/workflows/|(^|/)\.gitlab-ci|(^|/)Jenkinsfile$|(^|/)(ci|pipeline)(/|$)",
    "platform": r"(^|/)(terraform|helm|k8s|kubernetes|docker)(/|$)|(^|/)Dockerfile$|\.tf$",
    "data": r"(^|/)(migrations|schema|seed)(/|$)|\.sql$",
    "observability": r"(^|/)(monitoring|metrics|tracing|dashboard|logging)(/|$)",
    "frontend": r"(^|/)(components|pages|ui)(/|$)|\.(tsx|jsx|vue|svelte|astro)$",
    "backend": r"(^|/)(api|routes|controllers|services|workers)(/|$)|\.(py|go|rs|java|kt|rb|php|cs|scala|c|h|cpp|hpp|swift)$",
    "config": r"\.(ya?ml|toml|json|ini|cfg|conf)$|(^|/)(package\.json|pyproject\.toml|Cargo\.toml|go\.mod|Gemfile|pom\.xml|composer\.json|Makefile)$",
}
SURFACES = ("test", "docs", "ci_cd", "platform", "data", "observability", "frontend", "backend", "config", "generated_vendor", "other")
VENDOR_PREFIXES = ("vendor/", "node_modules/", "third_party/", "third-party/")
VENDOR_SUFFIXES = (".min.js", ".min.css", ".pb.go")
BOT_EMAIL = r"\[bot\]@"
LEGACY_BOT_EMAILS = ("action@github.com", "dependabot@github.com", "github-actions@github.com", "renovate@whitesourcesoftware.com")
CORRECTIVE_SUBJECT = r"^(revert\b|fix(\b|\(|:|!)|hotfix\b|bugfix\b|bug(\b|\(|:)|fixes\s+#)"
REVERT_SENTENCE = "This reverts commit"
CONVENTIONAL_SUBJECT = r"^[A-Za-z]+(\([^)]+\))?!?:\s"
ISSUE_LINK = r"(#\d+|fixes\s+#|close[sd]?\s+#)"
TEST_TYPE_PATTERNS = {
    "contract": r"(^|/)(contract|pact)(/|$)",
    "e2e": r"(^|/)(e2e|cypress|playwright|selenium)(/|$)",
    "integration": r"(^|/)(integration|integ|int)(/|$)",
    "unit": r"(^|/)(unit|tests?/unit)(/|$)|(^|/)test_[^/]+\.py$|_test\.py$",
}
VERIFICATION_TYPES = ("unit", "integration", "e2e", "contract", "unspecified")
LANGUAGE_EXTENSIONS = ("py", "js", "jsx", "ts", "tsx", "go", "rs", "java", "kt", "rb", "php", "c", "h", "cpp", "hpp", "cs", "swift", "scala", "sh", "vue", "svelte", "astro", "lua", "r", "m")
MANIFESTS = ("package.json", "pyproject.toml", "requirements.txt", "setup.py", "go.mod", "Cargo.toml", "Gemfile", "pom.xml", "build.gradle", "build.gradle.kts", "composer.json", "mix.exs", "deno.json")
MONOREPO_MARKERS = ("packages/", "apps/", "services/", "libs/", "modules/", "workspace", "nx.json", "lerna.json", "turbo.json", "pnpm-workspace.yaml", "cargo-workspace", "go.work")
DEPENDENCY_FILES = ("cargo.lock", "cargo.toml", "composer.json", "composer.lock", "gemfile", "gemfile.lock", "go.mod", "go.sum", "package-lock.json", "package.json", "pipfile", "pipfile.lock", "pnpm-lock.yaml", "poetry.lock", "pom.xml", "pyproject.toml", "requirements.txt", "uv.lock", "yarn.lock")
DEPENDENCY_PATTERN = r"^requirements-.*\.txt$|\.gradle$|\.gradle\.kts$"
DOC_NAMES = ("readme", "changelog", "changes", "contributing", "license")
DOC_SUFFIXES = (".md", ".mdx", ".rst", ".adoc", ".txt")
INFRA_DIRS = (".github", ".gitlab", "ci", "deploy", "docker", "helm", "infra", "k8s", "terraform")
INFRA_FILES = (".gitlab-ci.yml", "compose.yaml", "compose.yml", "docker-compose.yaml", "docker-compose.yml", "dockerfile", "makefile")
CORE_DIRS = ("app", "cmd", "crates", "lib", "pkg", "src")
CORE_SUFFIXES = (".c", ".cc", ".cpp", ".cs", ".ex", ".exs", ".go", ".java", ".js", ".jsx", ".kt", ".kts", ".php", ".py", ".rb", ".rs", ".scala", ".swift", ".ts", ".tsx", ".vue")
TEST_DIRS = ("test", "tests", "__tests__", "spec", "specs")
LANGUAGE_FAMILIES = {
    "c_cpp": (".c", ".cc", ".cpp", ".h", ".hpp"),
    "csharp": (".cs",),
    "css": (".css",),
    "elixir": (".ex", ".exs"),
    "go": (".go",),
    "html": (".html",),
    "java": (".java",),
    "javascript": (".js", ".jsx"),
    "configuration": (".json", ".toml", ".yaml", ".yml"),
    "kotlin": (".kt", ".kts"),
    "php": (".php",),
    "python": (".py",),
    "ruby": (".rb",),
    "documentation": (".rst",),
    "rust": (".rs",),
    "scala": (".scala",),
    "shell": (".sh",),
    "sql": (".sql",),
    "swift": (".swift",),
    "typescript": (".ts", ".tsx"),
    "vue": (".vue",),
    "markdown": (".md", ".mdx"),
}
COUNT_BUCKETS = ((1, "0"), (5, "1-4"), (20, "5-19"), (100, "20-99"), (500, "100-499"), (2000, "500-1999"))
LARGEST_BUCKET = "2000+"
FLOOR = 20  # commits below which a rate is withheld
SHORT_WINDOW_DAYS, RHYTHM_DAYS, REWORK_DAYS = 91, 180, 21
ADOPTION_DAYS, RETURN_DAYS, RELEASE_DAYS = 30, 180, 30
SOLO_SHARE, SMALL_TEAM = 0.90, 5
ACTIVE_DAYS_ACTIVE, ACTIVE_DAYS_MAINTAINED = 12, 3
SHAPE_EVENTS, SHAPE_DAYS, SHAPE_WINDOW = 8, 5, 30
SHARE_MODERATE, SHARE_STRONG = 0.4, 0.6
SIMILAR_LOW, SIMILAR_HIGH = 0.5, 2.0
CORE_SHARE = 0.80


def matches(text: Column, pattern: str) -> Column:
    """Search for a pattern in any case, with Unicode case folding."""
    return text.rlike("(?iu)" + pattern)


def normal_path(path: Column) -> Column:
    """Forward slashes, and no leading dots or slashes at all."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^[./]+", "")


def is_test(path: Column) -> Column:
    return matches(normal_path(path), TEST_PATH)


def path_role(path: Column) -> Column:
    """test, docs (with configuration) or prod."""
    return F.when(is_test(path), "test").when(matches(normal_path(path), DOC_OR_CONFIG_PATH), "docs").otherwise("prod")


def is_vendor(path: Column) -> Column:
    own = normal_path(path)
    return reduce(Column.__or__, [*(own.startswith(p) for p in VENDOR_PREFIXES), *(own.endswith(s) for s in VENDOR_SUFFIXES)])


def surface_hits(path: Column) -> Column:
    """All surfaces that a path matches, in order of precedence; here leading dots stay."""
    own = F.regexp_replace(F.translate(path, "\\", "/"), r"^/+", "")
    hits = [F.when(matches(own, p), F.lit(name)) for name, p in SURFACE_PATTERNS.items()]
    return F.array_compact(F.array(*hits, F.when(is_vendor(own), F.lit("generated_vendor"))))


def surface(path: Column) -> Column:
    return F.coalesce(F.get(surface_hits(path), 0), F.lit("other"))


def test_type(path: Column) -> Column:
    kind = F.when(~is_test(path), "unspecified")
    for name, pattern in TEST_TYPE_PATTERNS.items():
        kind = kind.when(matches(path, pattern), name)
    return kind.otherwise("unspecified")


def language(path: Column) -> Column:
    """The extension, if it is one of those counted; else null."""
    ext = F.regexp_extract(F.lower(path), r"\.([a-z]+)$", 1)
    return F.when(ext.isin(*LANGUAGE_EXTENSIONS), ext)


def base_name(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.translate(path, "\\", "/"), r"([^/]*)$", 1))


def suffix(base: Column) -> Column:
    return F.regexp_extract(base, r"^.+(\.[^.]+)$", 1)


def directories(path: Column) -> Column:
    parts = F.split(F.trim(F.lower(F.translate(path, "\\", "/")), F.lit("/")), "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def is_dependency(path: Column) -> Column:
    base = base_name(path)
    return base.isin(*DEPENDENCY_FILES) | base.rlike(DEPENDENCY_PATTERN)


def is_any_test(path: Column) -> Column:
    """The wider test rule of the experience measures."""
    base = base_name(path)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    in_dir = F.arrays_overlap(directories(path), F.array(*map(F.lit, TEST_DIRS)))
    return in_dir | stem.startswith("test_") | stem.endswith("_test") | base.contains(".test.") | base.contains(".spec.")


def domain(path: Column) -> Column:
    base, dirs = base_name(path), directories(path)
    ext = suffix(base)

    def within(names: tuple[str, ...]) -> Column:
        return F.arrays_overlap(dirs, F.array(*map(F.lit, names)))

    return (
        F.when(is_dependency(path), "deps")
        .when(is_any_test(path), "test")
        .when(within(("docs",)) | F.split_part(base, F.lit("."), F.lit(1)).isin(*DOC_NAMES) | ext.isin(*DOC_SUFFIXES), "docs")
        .when(within(INFRA_DIRS) | base.isin(*INFRA_FILES) | (ext == ".tf"), "infra")
        .when(within(CORE_DIRS) | ext.isin(*CORE_SUFFIXES), "core")
        .otherwise("unclassified")
    )


def language_family(path: Column) -> Column:
    ext = suffix(base_name(path))
    found = F.when(F.lit(False), "")
    for name, suffixes in LANGUAGE_FAMILIES.items():
        found = found.when(ext.isin(*suffixes), name)
    return found.otherwise("other")


def top_module(path: Column) -> Column:
    """The first of two or more segments; else null."""
    parts = F.split(normal_path(path), "/")
    return F.when((F.size(parts) > 1) & (F.get(parts, 0) != ""), F.get(parts, 0))


def is_corrective(subject: Column) -> Column:
    return matches(subject, CORRECTIVE_SUBJECT) | subject.contains(REVERT_SENTENCE)


def is_revert(subject: Column) -> Column:
    return is_corrective(subject) & (F.lower(subject).startswith("revert") | subject.contains(REVERT_SENTENCE))


def subject_class(subject: Column) -> Column:
    return F.when(is_revert(subject), "revert").when(is_corrective(subject), "fix").otherwise("other")


def is_conventional(subject: Column) -> Column:
    return subject.rlike(CONVENTIONAL_SUBJECT)


def has_issue_link(subject: Column) -> Column:
    return matches(subject, ISSUE_LINK)


def normal_email(email: Column) -> Column:
    return F.lower(F.trim(email))


def is_bot_email(email: Column) -> Column:
    own = normal_email(email)
    return own.isin(*LEGACY_BOT_EMAILS) | own.rlike(BOT_EMAIL)


def digest(domain_name: str, value: Column) -> Column:
    """SHA-256 of a domain, a zero byte and a value; the domain is a parameter of the data set."""
    return F.sha2(F.concat(F.lit(domain_name).cast("binary"), F.lit(b"\0"), value.cast("binary")), 256)


def slug(name: Column) -> Column:
    """Lower case, other characters as dashes, no dashes, dots or underscores at the ends, 64 characters; empty: null."""
    own = F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9._-]+", "-")
    own = F.regexp_replace(own, r"^[-._]+|[-._]+$", "")
    return F.when(own != "", F.substring(own, 1, 64))


def count_bucket(n: Column) -> Column:
    out = F.when(F.lit(False), "")
    for below, name in COUNT_BUCKETS:
        out = out.when(n < below, name)
    return out.otherwise(LARGEST_BUCKET)


def ratio_bucket(x: Column) -> Column:
    """Bands of ten points; one belongs to the last."""
    low = F.least(F.lit(90), F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)) * 10) * 10).cast("int")
    return F.format_string("%02d-%02d%%", low, low + 10)


def share_strength(x: Column) -> Column:
    return F.when(x >= SHARE_STRONG, "strong").when(x >= SHARE_MODERATE, "moderate").otherwise("weak")


def remote_identity(url: Column) -> Column:
    """host/path of a remote without scheme, user, query, fragment and `.git`; null for local paths and unsafe ones."""
    text = F.regexp_replace(F.trim(url), r"[?#].*$", "")
    with_scheme = text.rlike(r"(?i)^(https?|ssh|git|git\+ssh)://")
    scp = F.when(text.rlike(r"^[^/:@]+@[^/:]+:.+$"), F.regexp_replace(text, r"^[^@]+@([^:]+):/*", "$1/"))
    rest = F.when(with_scheme, F.regexp_replace(F.regexp_replace(text, r"^[^:]+://", ""), r"^[^/@]*@", "")).otherwise(F.coalesce(scp, text))
    host = F.regexp_replace(F.lower(F.split_part(rest, F.lit("/"), F.lit(1))), r"\.(?=:|$)", "")
    path = F.regexp_replace(F.trim(F.regexp_replace(rest, r"^[^/]*", ""), F.lit("/")), r"\.git$", "")
    whole = F.when(path == "", host).otherwise(F.concat(host, F.lit("/"), path))
    local = text.rlike(r"^(/|\./|\.\./|~/|\\|[A-Za-z]:[\\/])") | (text == "") | text.rlike(r"(?i)^file:")
    unsafe = whole.rlike(r"(^|/)\.{1,2}(/|$)") | whole.contains("//") | host.rlike(r"\s") | ~host.contains(".")
    return F.when(~local & ~unsafe & (with_scheme | ~text.contains("://")), whole)

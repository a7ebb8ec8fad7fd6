"""File filters on manifest columns, applied before any content is read."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from leaksieve.functions.paths import directory_parts, suffix

# The scan defaults of source trees.
EXTENSIONS = (
    ".py", ".js", ".ts", ".jsx", ".tsx", ".json", ".yml", ".yaml",
    ".toml", ".ini", ".cfg", ".conf", ".env", ".sh", ".bash", ".zsh",
    ".ps1", ".bat", ".cmd", ".php", ".rb", ".java", ".go", ".rs",
    ".swift", ".kt", ".kts", ".cs", ".c", ".cpp", ".h", ".hpp",
    ".sql", ".xml", ".html", ".css", ".tf", ".hcl", ".properties",
    ".gradle", ".md", ".txt", ".r", ".R", ".dart", ".scala",
)
EXCLUDED_DIRS = (
    ".git", "node_modules", "vendor", "__pycache__", ".venv", "venv",
    "env", ".eggs", "dist", "build", ".tox", ".nox", ".mypy_cache",
    ".ruff_cache", ".pytest_cache", "htmlcov", ".idea", ".vscode",
    "target",
)
SENSITIVE_NAMES = (
    ".env", "credential", "secret", "password", "token",
    "auth", "config", "keyfile", "key.pem", "id_rsa",
)
WELL_KNOWN_NAMES = ("dockerfile", "makefile", "vagrantfile", "gemfile", "rakefile")
MAX_FILE_BYTES = 2 * 1024 * 1024
SNIFF_BYTES = 8192

# The scan defaults of hosted repositories.
HOSTED_EXTENSIONS = (
    ".py", ".js", ".ts", ".jsx", ".tsx", ".json", ".yml", ".yaml",
    ".toml", ".ini", ".cfg", ".conf", ".env", ".sh", ".bash",
    ".php", ".rb", ".java", ".go", ".rs", ".swift", ".kt",
    ".cs", ".c", ".cpp", ".h", ".sql", ".xml", ".html", ".tf",
    ".properties", ".gradle", ".md", ".txt",
)
HOSTED_SENSITIVE_NAMES = (".env", "config", "credential", "secret", "key", "auth", "token")
HOSTED_EXCLUDED_DIRS = ("node_modules", "vendor", ".git", "__pycache__", "dist", "build")


@dataclass(frozen=True)
class ScanConfig:
    """Options of a scan; empty sets mean the defaults."""

    extensions: tuple[str, ...] = EXTENSIONS
    excluded_dirs: tuple[str, ...] = EXCLUDED_DIRS
    ignore_patterns: tuple[str, ...] = ()
    ignore_file: str = ".leaksieveignore"
    max_file_bytes: int = MAX_FILE_BYTES
    #: Bytes that one task reads of a target that is a single file.
    range_bytes: int = 64 << 20
    #: ``module:function`` of a paged store's lister (``sources.stores.Lister``); None chooses by the target.
    lister: str | None = None

    @property
    def effective_extensions(self) -> tuple[str, ...]:
        return tuple(self.extensions) or EXTENSIONS

    @property
    def effective_excluded_dirs(self) -> tuple[str, ...]:
        return tuple(self.excluded_dirs) or EXCLUDED_DIRS


def outside_excluded_dirs(path: Column, excluded: Iterable[str] = EXCLUDED_DIRS) -> Column:
    """No directory above the file has one of the names."""
    return ~F.arrays_overlap(directory_parts(path), F.array(*[F.lit(d) for d in excluded]))


def size_in_bounds(length: Column, max_bytes: int = MAX_FILE_BYTES) -> Column:
    return (length > 0) & (length <= max_bytes)


def _holds_any(text: Column, words: Iterable[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def scannable_name(name: Column, extensions: Iterable[str] = EXTENSIONS) -> Column:
    """A sensitive word in the name, an included extension, or a well-known name; case is ignored."""
    low = F.lower(name)
    return (_holds_any(low, SENSITIVE_NAMES)
            | suffix(low).isin(*extensions)
            | low.isin(*WELL_KNOWN_NAMES))


def scannable_hosted_name(name: Column) -> Column:
    """The rule of hosted repositories: the name ends with an extension or holds a sensitive word."""
    low = F.lower(name)
    included = F.lit(False)
    for extension in HOSTED_EXTENSIONS:
        included = included | F.endswith(low, F.lit(extension))
    return included | _holds_any(low, HOSTED_SENSITIVE_NAMES)


def is_binary(content: Column) -> Column:
    """A null byte among the first bytes."""
    return F.contains(F.substring(content, 1, SNIFF_BYTES), F.lit(b"\x00"))

"""Rules on file names: priority, declared kind, language and stack markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions that are never analysed.
ASSET_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".pdf", ".mp4", ".ico")

# Names and extensions by analysis priority.
TOP_STEMS = (
    "readme", "license", "setup", "pyproject", "package", "requirements",
    "dockerfile", "compose", "makefile", "main", "app",
)
CODE_EXTENSIONS = (".py", ".js", ".json", ".yml", ".yaml", ".toml", ".sh")
DOC_EXTENSIONS = (".md", ".rst", ".txt")

# Our own mapping to the declared kinds that content analysis never emits.
KIND_BY_EXTENSION = {
    "python": (".py", ".pyi"),
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "typescript": (".ts", ".tsx"),
    "json": (".json",),
    "yaml": (".yml", ".yaml"),
    "markdown": (".md", ".markdown"),
    "documentation": (".rst", ".adoc"),
    "config": (".toml", ".ini", ".cfg", ".conf", ".env", ".properties"),
    "text": (".txt",),
    "asset": ASSET_EXTENSIONS,
}
CONFIG_STEMS = ("dockerfile", "makefile", ".env", ".gitignore", ".dockerignore", ".editorconfig")
DOC_STEMS = ("readme", "license", "changelog", "contributing", "authors", "notice")
LANGUAGE_KINDS = ("python", "javascript", "typescript")

# Path endings that reveal a stack, in order of precedence.
STACK_MARKERS = {
    "Python package": ("setup.py", "pyproject.toml"),
    "Node.js project": ("package.json",),
    "Containerized service": ("dockerfile",),
    "Go module": ("go.mod",),
    "Java Maven project": ("pom.xml",),
}
# The hyphen is U+2010.
UNKNOWN_STACK = "Unknown or mixed‐language project"


def is_asset(ext: Column) -> Column:
    return ext.isin(*ASSET_EXTENSIONS)


def priority_score(stem: Column, ext: Column) -> Column:
    """100 for key file names, 80 for code and config, 70 for docs, else 10."""
    return (
        F.when(stem.isin(*TOP_STEMS), 100)
        .when(ext.isin(*CODE_EXTENSIONS), 80)
        .when(ext.isin(*DOC_EXTENSIONS), 70)
        .otherwise(10)
    )


def declared_kind(ext: Column, stem: Column) -> Column:
    """Kind by name alone. An extension to the analysed kind, kept apart from it."""
    kind = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, extensions in KIND_BY_EXTENSION.items():
        kind = kind.when(ext.isin(*extensions), name)
    return (
        kind.when(stem.isin(*CONFIG_STEMS), "config")
        .when(stem.isin(*DOC_STEMS), "documentation")
        .otherwise("unknown")
    )


def language_of(ext: Column, stem: Column) -> Column:
    """The declared kind where it is a programming language, else null."""
    kind = declared_kind(ext, stem)
    return F.when(kind.isin(*LANGUAGE_KINDS), kind)


def has_marker(path: Column, label: str) -> Column:
    """True when the lower-cased path ends with one of the label's markers."""
    lowered = F.lower(path)
    hit = F.lit(False)
    for ending in STACK_MARKERS[label]:
        hit = hit | lowered.endswith(ending)
    return hit

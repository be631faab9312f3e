"""File classification as boolean and string Columns over a path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import base_name

# Extensions, folders and name patterns that decide what is indexed.
CODE_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]
CONFIG_EXTENSIONS = [".json", ".yaml", ".yml", ".toml"]
CONFIG_FILENAMES = [
    "package.json", "tsconfig.json", "next.config.js", "next.config.ts", "vite.config.ts", "vite.config.js",
    "jest.config.ts", "jest.config.js", "vitest.config.ts",
]
ENV_TEMPLATES = [".env.example", ".env.template", ".env.sample"]
SKIP_DIRS = ["node_modules", "dist", "build", "es", "coverage", "__pycache__", "__generated__", "__mocks__"]
SKIP_FILE = "(\\.d\\.ts|\\.min\\.(js|cjs|mjs)|\\.bundle\\.(js|cjs|mjs)|\\.map|\\.lock|-lock\\.json)$"
TEST_FILE = "\\.(spec|test|stories)\\.(ts|tsx|js|jsx|mjs|cjs)$"
PACKAGE_DIR = "/(packages|apps|libs|modules|services)/([^/]+)/"
GENERATED_PATH = "/(dist|es|build|generated|__generated__|\\.cache)/"
DEMO_PATH = "/(demo|example|storybook|stories|fixtures)/"


def _rooted(path: Column) -> Column:
    return F.concat(F.lit("/"), path)


def dirs_of(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def in_skipped_dir(path: Column) -> Column:
    return F.exists(dirs_of(path), lambda d: F.startswith(d, F.lit(".")) | d.isin(SKIP_DIRS))


def is_skipped_file(path: Column) -> Column:
    return base_name(path).rlike(SKIP_FILE)


def _ends_with_any(path: Column, suffixes: list[str]) -> Column:
    return path.rlike("(" + "|".join(s.replace(".", "\\.") for s in suffixes) + ")$")


def is_code_file(path: Column) -> Column:
    return _ends_with_any(path, CODE_EXTENSIONS) & ~is_skipped_file(path)


def is_test_file(path: Column) -> Column:
    return base_name(path).rlike(TEST_FILE)


def is_safe_env_template(path: Column) -> Column:
    return F.lower(base_name(path)).isin(ENV_TEMPLATES)


def is_secret_env(path: Column) -> Column:
    return F.startswith(base_name(path), F.lit(".env")) & ~is_safe_env_template(path)


def is_config_file(path: Column) -> Column:
    named = base_name(path).isin(CONFIG_FILENAMES + ENV_TEMPLATES)
    return (named | _ends_with_any(path, CONFIG_EXTENSIONS) | is_safe_env_template(path)) & ~is_secret_env(path)


def folder_depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def package_of(path: Column) -> Column:
    """Folder name below packages/, apps/, libs/, modules/ or services/; null outside of them."""
    name = F.regexp_extract(_rooted(path), PACKAGE_DIR, 2)
    return F.when(name != "", name)


def script_kind(path: Column) -> Column:
    return (
        F.when(F.endswith(path, F.lit(".tsx")), "tsx")
        .when(F.endswith(path, F.lit(".jsx")), "jsx")
        .when(path.rlike("\\.(js|mjs|cjs)$"), "js")
        .otherwise("ts")
    )


def test_file_type(path: Column) -> Column:
    return (
        F.when(F.contains(path, F.lit(".stories.")), "story")
        .when(F.contains(path, F.lit(".spec.")), "spec")
        .otherwise("test")
    )

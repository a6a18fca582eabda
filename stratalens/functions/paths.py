"""Columns about paths: language, ignore rules, globs, normalisation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalens import constants as K


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def contains_any(c: Column, words: list[str]) -> Column:
    return any_of([c.contains(w) for w in words])


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def language(path: Column) -> Column:
    """By base name first, then by extension in lower case; otherwise 'unknown'."""
    base, out = basename(path), None
    ext = F.lower(F.regexp_extract(base, r"\.([^.]*)$", 1))
    for test, lang in [(base == k, v) for k, v in K.BASENAMES.items()] + [(base.startswith(k), v) for k, v in K.BASENAME_PREFIXES.items()]:
        out = F.when(test, lang) if out is None else out.when(test, lang)
    for lang, exts in K.EXTENSIONS.items():
        out = out.when(ext.isin(exts.split()), lang)
    return out.otherwise("unknown")


def glob_regex(pattern: str) -> str:
    """`*` and `?` also cross slashes."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def matches_ignore(path: Column, pattern: str) -> Column:
    """A leading slash binds to the root; otherwise the whole path, the base name or a component may match."""
    pattern = pattern.rstrip("/")
    if not pattern or pattern[0] in "#!":
        return F.lit(False)
    if pattern[0] == "/":
        root = pattern[1:]
        return path.rlike(glob_regex(root)) | path.startswith(f"{root}/")
    return path.rlike(glob_regex(pattern)) | basename(path).rlike(glob_regex(pattern)) | F.array_contains(F.split(path, "/"), pattern)


def skip_dir(path: Column, patterns: list[str] = ()) -> Column:
    parts = F.split(path, "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") & ~p.isin(".", ".."))
    return hidden | F.exists(parts, lambda p: p.isin(K.SKIP_DIRS)) | contains_any(path, K.SKIP_FRAGMENTS) | any_of([matches_ignore(path, p) for p in patterns])


def ignored(path: Column, patterns: list[str] = ()) -> Column:
    parts = F.split(path, "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") & ~p.isin(".", "..", *K.HIDDEN_ALLOWED))
    return hidden | F.exists(parts, lambda p: p.isin(K.SKIP_DIRS)) | contains_any(path, K.SKIP_FRAGMENTS) | any_of([path.endswith(e) for e in K.SKIP_EXTENSIONS]) | any_of([matches_ignore(path, p) for p in patterns])


def normalised(path: Column) -> Column:
    """Backslashes to slashes; `.`, `..` and empty parts resolved."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    step = lambda acc, p: F.when(p.isin("", "."), acc).when((p == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def relative_to(path: Column, workspace: str) -> Column:
    root = workspace.rstrip("/") + "/"
    return F.when(path.startswith(root), path.substr(F.lit(len(root) + 1), F.length(path))).otherwise(F.regexp_replace(path, r"^\./", ""))


def suffixes(path: Column) -> Column:
    """All ends of a path that start after a slash, and the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))

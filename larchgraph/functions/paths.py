"""Column functions over file paths, URL paths and function ids. All built-in, no user functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File-name conventions that decide what counts as a test, a configuration, an
# entry point, a source file or a plain asset.
TEST_NAME = r"(?i)\.(test|spec)\.[cm]?[jt]sx?$"
CONFIG_NAME = r"(?i)\.(config|conf)\.[cm]?[jt]s$"
ENTRY_NAME = r"(?i)(^|/)(index|main|app|server|cli|mod|entry|bootstrap)\.[cm]?[jt]sx?$"
SOURCE_NAME = r"(?i)\.(cjs|mjs|mts|cts|js|jsx|ts|tsx|py|pyi|java|go|c|h|cpp|cc|cxx|hpp|hh|hxx|cs)$"
SCRIPT_NAME = r"(?i)\.(cjs|mjs|mts|cts|js|jsx|ts|tsx)$"
DECLARATION = r"(?i)\.d\.[cm]?ts$"
ASSET_NAME = r"(?i)\.(css|scss|sass|less|styl|json|svg|png|jpe?g|gif|webp|avif|ico|woff2?|ttf|otf|eot|md|txt|wasm|ya?ml|glsl|vert|frag|mp[34]|webm|ogg|wav)$"
IGNORED_DIRS = (".cache", ".git", ".next", ".output", ".svelte-kit", ".turbo", "build", "coverage", "dist", "node_modules", "out", "vendor")
#: Fixed values, in the order in which a specifier's file is looked for.
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs", "/index.cjs")


def normal_path(p: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.translate(p, "\\", "/"), r"^\./", ""), "^/", "")


def is_source(p: Column) -> Column:
    return p.rlike(SOURCE_NAME) & ~p.rlike(DECLARATION)


def is_ignored(p: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(F.translate(p, "\\", "/")), "/"), F.array(*[F.lit(x) for x in IGNORED_DIRS]))


def is_test(p: Column) -> Column:
    return p.rlike(TEST_NAME)


def entry_reason(p: Column, shebang: Column) -> Column:
    """Why a file is an entry point; null if it is none."""
    return (
        F.when(shebang, "shebang").when(p.rlike(TEST_NAME), "test").when(p.rlike(CONFIG_NAME), "config")
        .when(p.rlike("(^|/)bin/"), "bin").when(p.rlike(ENTRY_NAME), "entry-name")
    )


def basename(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def dir_of(p: Column) -> Column:
    return F.regexp_extract(p, "^(.*)/[^/]*$", 1)


def join_relative(from_path: Column, spec: Column) -> Column:
    """spec seen from from_path's folder: . and empty segments fold, .. climbs and stops at the root."""
    parts = F.concat(F.split(dir_of(from_path), "/"), F.split(spec, "/"))
    fold = lambda acc, x: (
        F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    )
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), fold), "/")


def is_relative(spec: Column) -> Column:
    return spec.startswith("./") | spec.startswith("../") | spec.startswith("/")


def trimmed(text: Column) -> Column:
    """text without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^[\s\u00a0\ufeff]+|[\s\u00a0\ufeff]+$", "")


def _folded(path: Column) -> Column:
    """A URL's path without . and .. segments."""
    fold = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), fold), "/")).otherwise(path)


def http_path(url: Column) -> Column:
    """The path of a URL, or of a path with query and fragment; duplicate and trailing slashes go.
    A URL without a valid host gives null."""
    t = trimmed(url)
    rest = F.regexp_replace(t, r"(?i)^https?:[/\\]+", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^[^/?#\\]*", 0), "^.*@", "")
    valid = host.rlike(r"^(?:\[[0-9A-Fa-f:.]+\]|[^\s\[\]<>^|%:]+)(?::\d*)?$")
    absolute = F.when(valid, _folded(F.translate(F.regexp_extract(rest, r"^[^/?#\\]*([^?#]*)", 1), "\\", "/")))
    plain = F.regexp_extract(t, "^[^?#]*", 0)
    body = F.translate(F.when(t.rlike("(?i)^https?://"), absolute).otherwise(plain), "\\", "/")
    body = F.regexp_replace(F.concat(F.lit("/"), body), "/+", "/")
    return F.when(body == "/", body).otherwise(F.regexp_replace(body, "/$", ""))


def join_http(prefix: Column, path: Column) -> Column:
    return F.when(prefix == "/", path).when(path == "/", prefix).otherwise(F.regexp_replace(F.concat(prefix, F.lit("/"), path), "/+", "/"))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def paths_match(client: Column, route: Column) -> Column:
    """Segment arrays: :x on either side fits any segment; * in the route fits the rest, or nothing."""
    star = F.coalesce(F.array_position(route, "*"), F.lit(0)).cast("int")
    head = F.when(star > 0, F.slice(route, 1, F.greatest(star - 1, F.lit(0)))).otherwise(route)
    long_enough = F.when(star > 0, F.size(client) >= star - 1).otherwise(F.size(client) == F.size(route))
    same = F.zip_with(F.slice(client, 1, F.size(head)), head, lambda c, r: (c == r) | c.startswith(":") | r.startswith(":"))
    return long_enough & F.forall(same, lambda x: F.coalesce(x, F.lit(False)))


def function_name(fid: Column) -> Column:
    """What follows the first # of an id; an id without one as it is."""
    return F.coalesce(F.nullif(F.regexp_extract(fid, "^[^#]*#([\\s\\S]*)$", 1), F.lit("")), fid)


def function_id(fid: Column) -> Column:
    """A function's id with a normal path before its #."""
    t = trimmed(fid)
    return F.when(t.contains("#"), F.concat(normal_path(F.regexp_extract(t, "^[^#]*", 0)), F.regexp_extract(t, "#[\\s\\S]*$", 0))).otherwise(t)


def local_path(p: Column, root: str = "") -> Column:
    """A path below the folder `root`: without it, without a drive letter and a leading slash."""
    p = F.translate(p, "\\", "/")
    base = root.replace("\\", "/").rstrip("/")
    below = F.substring(p, F.lit(len(base) + 2), F.length(p)) if base else p
    p = F.when(p.startswith(base + "/"), below).otherwise(p) if base else p
    return normal_path(F.regexp_replace(p, "^[A-Za-z]:/", ""))


def module_path(p: Column) -> Column:
    """A path without slashes at its ends, as modules are named by."""
    return F.regexp_replace(F.regexp_replace(F.translate(p, "\\", "/"), r"^\./", ""), "^/+|/+$", "")


def short_text(text: Column, most: int = 240) -> Column:
    """text with single spaces; a longer one ends in an ellipsis."""
    t = F.regexp_replace(text, r"\s+", " ")
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most - 3), F.lit("\u2026")))


def clean_label(text: Column, fallback: str, most: int) -> Column:
    """A name to show: control characters become spaces; an empty one is the fallback."""
    t = trimmed(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\u0000-\u001f\u007f]", " "))
    return F.substring(F.when(t == "", F.lit(fallback)).otherwise(t), 1, most)

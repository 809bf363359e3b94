"""Path functions, all Column to Column and inside code generation. NULL in gives NULL out."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.config import Normalization

_BLANK_ENDS = r"(?U)^\s+|\s+$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: an expression that names a long one several times would otherwise repeat it."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def parts(path: Column) -> Column:
    """The components of a path without empty ones and dots."""
    return F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))


def fold_dots(path: Column) -> Column:
    """A path with . and .. folded, as POSIX normalisation does; empty gives '.'."""
    return let(path, _folded)


def _folded(path: Column) -> Column:
    absolute = F.startswith(path, F.lit("/"))

    def step(acc: Column, p: Column) -> Column:
        last_up = F.coalesce(F.try_element_at(acc, F.lit(-1)) == "..", F.lit(False))
        return (
            F.when(p.isin("", "."), acc)
            .when((p == "..") & (F.size(acc) > 0) & ~last_up, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when((p == "..") & absolute, acc)
            .otherwise(F.array_append(acc, p))
        )

    joined = F.array_join(F.aggregate(F.split(path, "/"), _no_strings(), step), "/")
    return F.when(absolute, F.concat(F.lit("/"), joined)).otherwise(F.coalesce(F.nullif(joined, F.lit("")), F.when(path.isNotNull(), ".")))


def strip_quotes(text: Column) -> Column:
    """Without blanks, then double quotes, then single quotes at both ends."""
    t = F.regexp_replace(text, _BLANK_ENDS, "")
    return F.regexp_replace(F.regexp_replace(t, r'^"+|"+$', ""), r"^'+|'+$", "")


def normalize_token(text: Column) -> Column:
    """Quotes and blanks stripped, slashes forward and single, dots folded; empty gives '.'."""
    return fold_dots(F.regexp_replace(F.replace(strip_quotes(text), F.lit("\\"), F.lit("/")), "/+", "/"))


def is_absolute(text: Column) -> Column:
    """Begins with a slash, two backslashes or a drive."""
    return text.rlike(r"^(/|\\\\|[A-Za-z]:[\\/])")


def is_absolute_base(text: Column) -> Column:
    """Like is_absolute, but a single segment behind a slash counts as relative."""
    return text.rlike(r"^(/[^/]+/|\\\\|[A-Za-z]:[\\/])")


def join_relative(base: Column, suffix: Column, strip_leading_dot: bool = True) -> Column:
    """Joined, with '' and '.' as neutral."""
    joined = F.when(base.isin("", "."), suffix).when(suffix.isin("", "."), base).otherwise(F.concat(base, F.lit("/"), suffix))
    out = normalize_token(joined)
    return F.regexp_replace(out, r"^\./", "") if strip_leading_dot else out


def strip_to_marker(path: Column, markers: list[str]) -> Column:
    """What follows the first place where a marker's components stand in the path, markers in the given order; '.' if nothing follows; NULL if none does."""
    clean = F.concat(F.lit("/"), F.array_join(parts(path), "/"), F.lit("/"))
    found = []
    for m in markers:
        inner = "/".join(x for x in m.split("/") if x not in ("", "."))
        if inner:
            rest = F.regexp_replace(F.regexp_extract(clean, f"(?s)^.*?/{re.escape(inner)}/(.*)$", 1), "/$", "")
            found.append(F.when(F.contains(clean, F.lit(f"/{inner}/")), F.when(rest == "", ".").otherwise(rest)))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def suffixes(path: Column) -> Column:
    """All suffixes of a path, longest first; semi-join them with the files to infer which exists."""
    p = parts(path)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1))), lambda i: F.array_join(F.slice(p, i, F.greatest(F.size(p), F.lit(1))), "/"))


def relative_to(path: Column, start: Column) -> Column:
    """Of an absolute path: how to reach it from the folder start."""
    a, b = parts(fold_dots(path)), parts(fold_dots(start))
    same = F.coalesce(F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)) - 1, F.lit(-1))
    same = F.when(same < 0, F.least(F.size(a), F.size(b))).otherwise(same).cast("int")
    up = F.array_repeat(F.lit(".."), F.size(b) - same)
    out = F.array_join(F.concat(up, F.slice(a, same + 1, F.greatest(F.size(a), F.lit(1)))), "/")
    return F.when(out == "", ".").otherwise(out)


def markers_of(root: str, config: Normalization) -> list[str]:
    """Names by which the project is recognised in absolute paths, longest first."""
    name = root.rstrip("/").rsplit("/", 1)[-1]
    found = [m.strip("/") for m in (root, name, *config.project_root_markers) if m.strip("/")]
    return sorted(dict.fromkeys(found), key=len, reverse=True)


def to_project_relative(text: Column, root: str, config: Normalization | None = None, existing: Column | None = None) -> Column:
    """struct<value, was_absolute>. In order: aliases (longest first), the root as prefix, the root's name as prefix; of absolute paths then a marker, the suffix that exists (``existing``, from a join with the files), the way from the root; else the path itself."""
    config = config or Normalization()
    value = let(normalize_token(text), lambda raw: _relative_value(raw, is_absolute(text), root, config, existing))
    return F.struct((F.lower(value) if config.fold_case else value).alias("value"), is_absolute(text).alias("was_absolute"))


def _relative_value(raw: Column, absolute: Column, root: str, config: Normalization, existing: Column | None) -> Column:
    dot = config.strip_leading_dot

    def below(prefix: str) -> tuple[Column, Column]:
        inside = (raw == prefix) | F.startswith(raw, F.lit(prefix + "/"))
        return inside, F.regexp_replace(F.substring(raw, len(prefix) + 1, 1 << 30), "^/+", "")

    root = "/" + "/".join(x for x in root.split("/") if x not in ("", ".")) if root.startswith("/") else root.rstrip("/")
    cases = []
    for source, target in sorted(config.path_prefix_aliases.items(), key=lambda x: -len(x[0])):
        inside, rest = below(source.replace("\\", "/").rstrip("/"))
        cases.append(F.when(inside, join_relative(F.lit(target.replace("\\", "/").rstrip("/") or "."), rest, dot)))
    for prefix in (root, root.rsplit("/", 1)[-1]):
        if prefix:
            inside, rest = below(prefix)
            cases.append(F.when(inside, join_relative(F.lit("."), rest, dot)))
    marked = strip_to_marker(raw, markers_of(root, config))
    cases.append(F.when(absolute & marked.isNotNull(), join_relative(F.lit("."), marked, dot)))
    if existing is not None:
        cases.append(F.when(absolute, existing))
    if root.startswith("/"):
        cases.append(F.when(absolute & F.startswith(raw, F.lit("/")), relative_to(raw, F.lit(root))))
    return F.coalesce(*cases, F.regexp_replace(raw, r"^\./", "") if dot else raw)


def script_relative(path: Column, script: Column) -> Column:
    """A relative path with .. is taken from the script's folder."""
    up = F.contains(path, F.lit("..")) & ~is_absolute(path)
    return F.when(up, fold_dots(F.concat_ws("/", F.nullif(parent_dir(script), F.lit("")), path))).otherwise(path)


def is_bare_directory(path: Column) -> Column:
    """C11: nothing but dots and slashes."""
    return path.rlike(r"^[./\\]*$")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last extension with its dot, as written; '' without one or for a name that only begins with a dot."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1)


def parent_dir(path: Column) -> Column:
    """The folder; '' at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def shared_depth(a: Column, b: Column) -> Column:
    """How many leading components two arrays share."""
    n = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)) - 1
    return F.when(n < 0, F.least(F.size(a), F.size(b))).otherwise(n).cast("int")


def dir_distance(a: Column, b: Column) -> Column:
    """Steps between two folders."""
    x, y = parts(a), parts(b)
    return F.size(x) + F.size(y) - 2 * shared_depth(x, y)


def common_prefix(paths: Column) -> Column:
    """C14: the components that all paths of an array share, joined."""
    split = F.transform(paths, parts)
    first = F.try_element_at(split, F.lit(1))
    n = F.aggregate(split, F.size(first), lambda acc, p: F.least(acc, shared_depth(first, p)))
    return F.array_join(F.slice(first, 1, F.greatest(n, F.lit(0))), "/")


def cluster_label(folders: Column) -> Column:
    """Of one folder its path ('.' at the root); of several their common prefix and ' / chain', else 'Pipeline stage'."""
    one = F.try_element_at(folders, F.lit(1))
    prefix = common_prefix(folders)
    return F.when(F.size(folders) == 1, F.when(one == "", ".").otherwise(one)).when(prefix != "", F.concat(prefix, F.lit(" / chain"))).otherwise("Pipeline stage")


def manual_path(text: Column) -> Column:
    """Forward slashes, without blanks around and one leading ./"""
    return F.regexp_replace(F.replace(F.regexp_replace(text, _BLANK_ENDS, ""), F.lit("\\"), F.lit("/")), r"^\./", "")


def module_path(module: Column) -> Column:
    """C17: the file of a dotted module."""
    return F.concat(F.replace(module, F.lit("."), F.lit("/")), F.lit(".py"))


VERSION_TOKEN = r"(?i)(?:_v\d+|_(?:qc|pp|final|draft))(\.[^./]+)$"


def family_key(path: Column) -> Column:
    """The path without its version token before the extension; NULL if it has none."""
    out = F.regexp_replace(path, VERSION_TOKEN, "$1")
    return F.when(out != path, out)


def is_external(text: Column) -> Column:
    """C20: a reference to a service."""
    return text.rlike("^(https?|ftp|s3|gs)://")


QUOTED = r"""(?:"([^"]*)"|'([^']*)')"""


def first_quoted(text: Column) -> Column:
    """The inside of the first quoted literal; NULL without one."""
    inside = F.concat(F.regexp_extract(text, QUOTED, 1), F.regexp_extract(text, QUOTED, 2))
    return F.when(text.rlike(QUOTED), inside)


def label(node_id: Column, style: str = "basename", depth: int = 0, show_extension: bool = True) -> Column:
    """A node's label: its full path, or its name with ``depth`` folders before it, with or without the extension."""
    if style == "full_path":
        out = node_id
    else:
        p = F.split(node_id, "/")
        n = F.least(F.size(p), F.lit(depth + 1))
        out = F.array_join(F.slice(p, -n, n), "/")
    if style == "stem" or not show_extension:
        out = F.regexp_replace(out, r"(?<=[^/])\.[^./]+$", "")
    return out


def xml_escape(text: Column) -> Column:
    """& < > and everything beyond ASCII as entities."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    wide = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(r"[^\x00-\x7F]"), F.concat(F.lit("&#"), _code_point(c), F.lit(";"))).otherwise(c))
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.array_join(wide, "")).otherwise(text)


def _code_point(c: Column) -> Column:
    return F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10)


def yaml_quote(text: Column) -> Column:
    """Double-quoted, with backslashes and quotes escaped."""
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def csv_line(*values: Column) -> Column:
    """One CSV line of values; those with commas, quotes or line ends are quoted, NULL is empty."""
    quoted = lambda v: F.when(v.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(v, F.lit("")))
    return F.concat_ws(",", *map(quoted, values))

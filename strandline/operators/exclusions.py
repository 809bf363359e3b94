"""Exclusion rules as one boolean expression, so that the filter is part of the scan's stage."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.config import Exclusions
from strandline.functions import paths


def glob_regex(glob: str) -> str:
    """A glob, anchored at the right; * and ** stay within one component."""
    out = []
    for part in glob.split("/"):
        rx, i = "", 0
        while i < len(part):
            c = part[i]
            end = part.find("]", i + 2) if c == "[" else -1
            if c == "*":
                rx += "[^/]*"
            elif c == "?":
                rx += "[^/]"
            elif end > 0:
                body = part[i + 1 : end]
                rx += "[" + ("^/" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]"
                i = end
            else:
                rx += re.escape(c)
            i += 1
        out.append(rx)
    whole = glob.startswith("/")
    return ("^" if whole else "(?:^|/)") + "/".join(out) + "$"


def excluded(path: Column, rules: Exclusions) -> Column:
    """Whether a rule applies. A path that ends in a slash is a folder. NULL paths give NULL."""
    r = rules.resolved()
    bare = F.regexp_replace(path, "/+$", "")
    p = F.when(bare == "", ".").otherwise(F.regexp_replace(F.regexp_replace(bare, "/+", "/"), r"^(\./)+|/\.(?=/|$)", ""))
    components = F.split(p, "/")
    folders = F.when(F.endswith(path, F.lit("/")), components).otherwise(F.slice(components, 1, F.greatest(F.size(components) - 1, F.lit(0))))
    tests = []
    for x in r.prefixes:
        x = x.rstrip("/")
        tests.append((p == x) | F.startswith(p, F.lit(x + "/")))
    if r.exact_paths:
        tests.append(p.isin([x.rstrip("/") for x in r.exact_paths]))
    if r.exact_names:
        tests.append(paths.basename(p).isin(r.exact_names))
    if r.folder_names:
        tests.append(F.arrays_overlap(folders, F.array(*map(F.lit, r.folder_names))))
    if r.globs:
        tests.append(p.rlike("|".join(f"(?:{glob_regex(g)})" for g in r.globs)))
    return reduce(lambda a, b: a | b, tests) if tests else F.when(path.isNotNull(), F.lit(False))

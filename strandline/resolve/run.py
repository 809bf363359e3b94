"""Parsing of scripts on executors, and values that scripts inherit from those that run them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.config import Config
from strandline.functions.paths import basename
from strandline.materialize import Cut, cut
from strandline.operators import graph
from strandline.resolve import python, r, stata
from strandline.resolve.common import ANYWHERE, FIELDS, PARSED_SCHEMA, Context

READERS = {"stata": stata.parse, "python": python.parse, "r": r.parse}


def parse_scripts(scripts: DataFrame, root: str, config: Config) -> DataFrame:
    """PARSED_SCHEMA rows of scripts (script, language, content binary, inherited map): one pass over the scripts in Arrow batches, no shuffle.

    Stata scripts must be valid UTF-8, else a diagnostic takes their place; others are decoded with replacement. NULL content gives nothing.
    A script of another language gives the diagnostic unknown_script_type.
    """
    norm, dyn = config.normalization, config.parser.dynamic_paths

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for script, language, content, inherited in zip(b["script"], b["language"], b["content"], b["inherited"]):
                c = Context(root, script, norm, dyn.placeholder_token, dyn.mode == "literal_only", dict(inherited) if inherited is not None else {})
                if content is None:
                    continue
                if language not in READERS:
                    rows = [c.diagnostic(0, "warning", "unknown_script_type", f"No reader for {script}")]
                else:
                    try:
                        text = bytes(content).decode("utf-8", "strict" if language == "stata" else "replace")
                        rows = READERS[language](text, c)
                        # Stata's reader tells of no services
                        rows = rows + c.notes if language != "stata" else rows
                    except UnicodeDecodeError:
                        rows = [c.diagnostic(0, "warning", "file_encoding_error", f"Could not decode {script} as UTF-8; file skipped.")]
                out += [{**x, "language": language} for x in rows]
            yield pd.DataFrame(out, columns=FIELDS).astype({"line": "Int32"})

    return scripts.select("script", "language", "content", "inherited").mapInPandas(run, PARSED_SCHEMA)


def chosen_children(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """(script, language, child, line): called scripts. Of candidates the first that is a file counts; without candidates, and for R where none is, the name does."""
    kids = parsed.where("kind = 'child'").withColumn("cid", F.monotonically_increasing_id())
    kids = cut(kids.select("cid", "script", "language", "line", "name", "candidates"), "children")
    found = kids.select("cid", F.posexplode("candidates").alias("i", "path")).join(files.select("path").distinct(), "path", "left_semi").groupBy("cid").agg(F.min_by("path", "i").alias("found"))
    out = kids.join(found, "cid", "left").withColumn("child", F.coalesce("found", "name"))
    return out.where("child IS NOT NULL AND child <> script").select("script", "language", "child", "line")


def with_existing(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """Events of one absolute path outside the root get the longest suffix of it that is a file; F13: else, where a bare name was joined to an absolute base, the only file of that name."""
    far = parsed.where("kind = 'event' AND size(candidates) > 0").select("script", "line", "command", "raw_path", F.posexplode("candidates").alias("i", "path"))
    real = files.select("path").distinct()
    only = real.groupBy(F.concat(F.lit(ANYWHERE), basename(F.col("path"))).alias("name")).agg(F.count("*").alias("n"), F.min("path").alias("real")).where("n = 1")
    known = real.select("path", F.col("path").alias("real")).unionByName(only.select(F.col("name").alias("path"), "real"))
    best = far.join(known, "path").groupBy("script", "line", "command", "raw_path").agg(F.min_by("real", "i").alias("_best"))
    out = parsed.join(best, ["script", "line", "command", "raw_path"], "left")
    return out.withColumn("normalized_paths", F.when(F.col("_best").isNotNull(), F.array("_best")).otherwise(F.col("normalized_paths"))).select(*FIELDS)


def resolve(scripts: DataFrame, files: DataFrame, root: str, config: Config) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, children) of scripts (script, language, content); scripts that others run are parsed again with the values they inherit, level by level.

    A script's own values win; of several scripts that run it, the last in order does. Values pass on through several levels. Scripts in
    rings inherit what the levels before them know. R names are compared without case. Python names are taken from imported modules.
    """
    base = scripts.select("script", "language", "content")
    empty = F.create_map().cast("map<string,string>")
    first = Cut(parse_scripts(base.withColumn("inherited", empty), root, config), "parsed")
    calls = cut(chosen_children(first.df, files), "calls")
    # values flow from caller to callee, except in Python, where the importing script takes them from the module
    flow = calls.select(F.when(F.col("language") == "python", F.col("child")).otherwise(F.col("script")).alias("parent"), F.when(F.col("language") == "python", F.col("script")).otherwise(F.col("child")).alias("child"))
    flow = cut(flow.where("parent <> child").distinct(), "flow")
    level = cut(graph.levels(base.select(F.col("script").alias("node")), flow), "script-levels")
    # as many as the longest chain of calls is long; rings come last
    later = sorted((r.level for r in level.where("level <> 0").select("level").distinct().collect()), key=lambda k: (k < 0, k))
    known = Cut(first.df.join(level.where("level = 0").select(F.col("node").alias("script")), "script", "left_semi").select(*FIELDS), "level")
    done = [known.df]
    # every value a script passes on: its own, and what it inherited
    own = lambda rows: rows.where("kind = 'global'").groupBy("script", "name").agg(F.max_by("value", "line").alias("value"))
    passing = cut(own(known.df), "passing")
    for k in later:
        at = level.where(F.col("level") == k).select(F.col("node").alias("script"))
        came = flow.join(passing.withColumnRenamed("script", "parent"), "parent").join(at.withColumnRenamed("script", "child"), "child", "left_semi")
        # a Python script may give a module's value another name, so it gets them by module as well
        of_module = came.where(F.endswith(F.lower("child"), F.lit(".py"))).select(F.col("child").alias("script"), F.concat("parent", F.lit(":"), "name").alias("name"), "value")
        came = cut(came.groupBy(F.col("child").alias("script"), "name").agg(F.max_by("value", "parent").alias("value")), "inherited")
        maps = came.unionByName(of_module).groupBy("script").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("inherited"))
        maps = cut(maps, "values")
        # what inherits nothing has been read already
        rest = first.df.join(at, "script", "left_semi").join(maps.select("script"), "script", "left_anti").select(*FIELDS)
        rows = cut(parse_scripts(base.join(maps, "script"), root, config).unionByName(rest), "level")
        done.append(rows)
        mine = own(rows)
        passing = cut(passing.unionByName(mine).unionByName(came.join(mine.select("script", "name"), ["script", "name"], "left_anti")), "passing")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = with_existing(out, files)
    return out, chosen_children(out, files).distinct()

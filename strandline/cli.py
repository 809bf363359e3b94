"""Command line: summary, extract-edges, render-dot, render-image, snapshot-json, validate, export-clusters, extract-sections."""

from __future__ import annotations

import argparse
import shutil
import subprocess
import sys

from strandline.config import Config, discover_config, load_config

COMMANDS = ["summary", "extract-edges", "render-dot", "render-image", "snapshot-json", "validate", "export-clusters", "extract-sections"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandline", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--project-root")
    p.add_argument("--config")
    p.add_argument("--output")
    p.add_argument("--as-folder", action="store_true", help="extract-edges, snapshot-json, validate: write --output as a folder of files, by the executors")
    p.add_argument("--view")
    p.add_argument("--format", default=None, help="svg, png or pdf of images; json, csv or text of sections")
    p.add_argument("--mode", choices=["auto", "resolved"], default="resolved", help="clusters without or with the manual ones")
    p.add_argument("--master", default="local[*]", help="as Spark spells it; on a cluster spark.checkpoint.dir must name a shared folder (--conf)")
    p.add_argument("--conf", action="append", default=[], metavar="KEY=VALUE", help="a setting of the session")
    return p


def _config(a: argparse.Namespace) -> Config:
    config = load_config(a.config or discover_config(a.project_root or "."))
    if a.project_root:
        config.project_root = a.project_root
    if a.view:
        config.display.view = a.view
    return config


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    config = _config(a)
    from pyspark.sql import SparkSession

    from strandline.materialize import scratch
    from strandline.session import local_session, session, ship

    settings = dict(c.split("=", 1) for c in a.conf)
    if active := SparkSession.getActiveSession():
        spark = ship(active)
    elif a.master.startswith("local[") and not settings:
        spark = local_session(a.master[len("local[") : -1])
    else:
        spark = session(a.master, **settings)
    with scratch(spark):
        return _run(a, config, spark)


def _run(a: argparse.Namespace, config: Config, spark) -> int:
    from strandline.plans import pipeline
    from strandline.sinks import tables, text

    if a.as_folder and (a.command not in ("extract-edges", "snapshot-json", "validate") or not a.output):
        sys.stderr.write("--as-folder needs --output and one of extract-edges, snapshot-json, validate.\n")
        return 2
    root = config.project_root
    if a.command == "extract-sections":
        return _give(text.section_index(pipeline.script_sections(spark, root, config), a.format or "json"), a.output)
    graph = pipeline.build(spark, root, config, with_clusters=a.mode != "auto")
    if a.as_folder:
        if a.command == "extract-edges":
            tables.write_edges(graph.edges, a.output)
        else:
            {"validate": tables.write_report, "snapshot-json": tables.write_snapshot}[a.command](pipeline.validated(graph), a.output)
        return 0
    if a.command == "extract-edges":
        return _give(text.edge_csv(graph.edges), a.output)
    if a.command in ("render-dot", "render-image"):
        drawing = text.dot(graph, config)
        return _give(drawing, a.output) if a.command == "render-dot" else _image(drawing, a.output, a.format or "svg", config.graphviz_dot_path)
    if a.command == "export-clusters":
        return _give(text.cluster_yaml(graph), a.output)
    graph = pipeline.validated(graph)
    make = {"summary": lambda g: text.summary(g, config), "validate": text.report, "snapshot-json": lambda g: text.snapshot(g, config)}[a.command]
    return _give(make(graph), a.output)


def _give(out: str, path: str | None) -> int:
    if path:
        with open(path, "w", encoding="utf-8", newline="") as f:
            f.write(out)
    else:
        sys.stdout.write(out)
    return 0


def _image(drawing: str, path: str | None, form: str, program: str | None) -> int:
    dot = program or shutil.which("dot")
    if not dot:
        sys.stderr.write("Graphviz (dot) was not found.\n")
        return 2
    return subprocess.run([dot, f"-T{form}", "-o", path or f"pipeline.{form}"], input=drawing.encode(), check=False).returncode


if __name__ == "__main__":
    sys.exit(main())

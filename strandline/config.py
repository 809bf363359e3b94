"""Settings of a lineage build. Plain driver-side values; only small lists of them reach expressions as literals."""

from __future__ import annotations

import json
import os
import warnings
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

# Defaults, suffix sets, enumerations.
INPUT_SUFFIXES = [".csv", ".dta", ".xlsx", ".parquet", ".feather", ".rds", ".rdata", ".rda", ".json", ".pkl", ".pickle"]
OUTPUT_SUFFIXES = [".png", ".svg", ".pdf", ".csv", ".ster", ".xlsx", ".dot", ".viz", ".rds", ".rdata", ".rda"]
SCRIPT_SUFFIXES = [".do", ".py", ".r", ".R"]
TERMINAL_SUFFIXES = [".png", ".pdf", ".svg", ".csv", ".xlsx", ".ster", ".dot", ".viz"]
PRESENTATION_SUFFIXES = [".png", ".pdf", ".svg", ".doc", ".docx", ".tex", ".ppt", ".pptx", ".jpg", ".jpeg", ".tiff", ".eps", ".emf"]
DELIVERABLE_SUFFIXES = [".csv", ".xlsx", ".pdf", ".png", ".svg", ".doc", ".docx", ".tex", ".ster", ".rds", ".rdata", ".rda", ".feather", ".parquet", ".txt", ".log", ".dta"]
TEMPORARY_PATTERNS = ["_tmp", "_temp", "_scratch", "temp_", "tmp_"]
ARTIFACT_ROLES = ["reference_input", "deliverable", "temporary", "intermediate", "generated_artifact", "artifact", "placeholder_artifact"]
PRESETS = {
    "generated_outputs": {"prefixes": ["viewer_output/"], "folder_names": ["viewer_output"]},
    "archival_folders": {"folder_names": ["archive", "~old", "old", "backup"], "globs": ["*.bak"]},
    "python_runtime": {"prefixes": [".git/"], "folder_names": ["__pycache__", ".pytest_cache"]},
}
CHOICES = {
    "display.theme": ["modern-light", "modern-dark", "warm-neutral"],
    "display.placeholder_style": ["dashed", "filled_dashed", "bold"],
    "display.view": ["overview", "technical", "deliverables", "scripts_only", "stage_overview"],
    "display.node_label_style": ["basename", "stem", "full_path"],
    "display.edge_label_mode": ["auto", "show", "operation", "hidden"],
    "parser.dynamic_paths.mode": ["resolve_simple", "resolve_loops", "resolve_loops_with_placeholders", "literal_only"],
    "parser.version_families.mode": ["off", "detect_only", "prefer_latest_modified", "prefer_highest_numeric", "prefer_priority_suffix", "latest_modified", "highest_numeric", "priority_suffix"],
}


@dataclass
class Display:
    theme: str = "modern-light"
    view: str = "overview"
    show_edge_labels: bool = False
    edge_label_mode: str = "auto"
    show_terminal_outputs: bool = True
    show_temporary_outputs: bool = False
    placeholder_style: str = "dashed"
    node_label_style: str = "basename"
    label_path_depth: int = 0
    show_extensions: bool = True


@dataclass
class Exclusions:
    prefixes: list[str] = field(default_factory=list)
    globs: list[str] = field(default_factory=lambda: ["*.tmp", "*.bak"])
    exact_names: list[str] = field(default_factory=list)
    exact_paths: list[str] = field(default_factory=list)
    folder_names: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    file_names: list[str] = field(default_factory=list)
    presets: list[str] = field(default_factory=lambda: ["generated_outputs", "archival_folders", "python_runtime"])

    def resolved(self) -> Exclusions:
        """Presets and the short forms ``paths`` and ``file_names`` merged into the rule lists, each rule once, in order."""
        out = Exclusions(list(self.prefixes), list(self.globs), [*self.exact_names, *self.file_names], list(self.exact_paths), list(self.folder_names), presets=[])
        for name in self.presets:
            if name not in PRESETS:
                raise ValueError(f"Unknown exclusion preset: {name}. Available presets: {', '.join(sorted(PRESETS))}")
            for rule, values in PRESETS[name].items():
                getattr(out, rule).extend(values)
        for p in self.paths:
            (out.prefixes if p.endswith("/") else out.exact_paths).append(p)
        for rule in ("prefixes", "globs", "exact_names", "exact_paths", "folder_names"):
            setattr(out, rule, list(dict.fromkeys(getattr(out, rule))))
        return out


@dataclass
class Normalization:
    path_prefix_aliases: dict[str, str] = field(default_factory=dict)
    project_root_markers: list[str] = field(default_factory=list)
    strip_leading_dot: bool = True
    fold_case: bool = False


@dataclass
class DynamicPaths:
    mode: str = "resolve_simple"
    placeholder_token: str = "{dynamic}"


@dataclass
class VersionFamilies:
    mode: str = "detect_only"
    priority_suffixes: list[str] = field(default_factory=lambda: ["qc", "pp", "final", "draft"])
    tiebreaker: str = "latest_modified"


@dataclass
class Parser:
    edge_csv_path: str = "viewer_output/parser_edges.csv"
    prefer_existing_edge_csv: bool = False
    write_edge_csv: bool = False
    suppress_internal_only_writes: bool = True
    dynamic_paths: DynamicPaths = field(default_factory=DynamicPaths)
    version_families: VersionFamilies = field(default_factory=VersionFamilies)


@dataclass
class Classification:
    deliverable_extensions: list[str] = field(default_factory=lambda: list(DELIVERABLE_SUFFIXES))
    temporary_name_patterns: list[str] = field(default_factory=lambda: list(TEMPORARY_PATTERNS))


@dataclass
class Clustering:
    enabled: bool = True
    strategy: str = "auto"


@dataclass
class Layout:
    rankdir: str = "LR"
    unclustered_artifacts_position: str = "auto"


@dataclass
class ManualCluster:
    cluster_id: str
    label: str | None = None
    members: list[str] = field(default_factory=list)
    member_cluster_ids: list[str] = field(default_factory=list)
    order: int | None = None
    collapse: bool = False


@dataclass
class ManualEdge:
    source: str
    target: str
    label: str | None = None
    note: str | None = None
    on_missing: str = "warn"


@dataclass
class Languages:
    stata: bool = True
    python: bool = True
    r: bool = True
    stata_extensions: list[str] = field(default_factory=lambda: [".do"])
    python_extensions: list[str] = field(default_factory=lambda: [".py"])
    r_extensions: list[str] = field(default_factory=lambda: [".r"])

    def by_suffix(self) -> dict[str, str]:
        """Lower-cased suffix to language, of the languages that are on; Stata first, then Python, then R."""
        out: dict[str, str] = {}
        for name in ("stata", "python", "r"):
            if getattr(self, name):
                for ext in getattr(self, f"{name}_extensions"):
                    ext = ext.lower()
                    out.setdefault(ext if ext.startswith(".") else f".{ext}", name)
        return out


@dataclass
class Config:
    project_root: str = "."
    display: Display = field(default_factory=Display)
    exclusions: Exclusions = field(default_factory=Exclusions)
    normalization: Normalization = field(default_factory=Normalization)
    parser: Parser = field(default_factory=Parser)
    classification: Classification = field(default_factory=Classification)
    clustering: Clustering = field(default_factory=Clustering)
    layout: Layout = field(default_factory=Layout)
    clusters: list[ManualCluster] = field(default_factory=list)
    manual_edges: list[ManualEdge] = field(default_factory=list)
    languages: Languages = field(default_factory=Languages)
    graphviz_dot_path: str | None = None


def _fill(target: Any, values: dict[str, Any], at: str) -> None:
    names = {f.name for f in fields(target)}
    for key, v in values.items():
        where = f"{at}{key}"
        if key not in names:
            warnings.warn(f"unknown setting {where}", stacklevel=2)
            continue
        old = getattr(target, key)
        if is_dataclass(old) and isinstance(v, dict):
            _fill(old, v, f"{where}.")
        elif where == "clusters":
            target.clusters = [_cluster(c) for c in v or []]
        elif where == "manual_edges":
            target.manual_edges = [_edge(e) for e in v or []]
        elif where in CHOICES and v not in CHOICES[where]:
            warnings.warn(f"{where}: {v!r} is none of {CHOICES[where]}; {old!r} is used", stacklevel=2)
        elif v is not None or old is None:
            setattr(target, key, v)


def _cluster(raw: Any) -> ManualCluster:
    if not isinstance(raw, dict) or not (raw.get("id") or raw.get("cluster_id")):
        raise ValueError("each cluster must be a mapping with an id")
    for key in ("members", "member_cluster_ids"):
        if not isinstance(raw.get(key) or [], list):
            raise ValueError(f"{key} of a cluster must be a list")
    order = raw.get("order")
    return ManualCluster(
        str(raw.get("id") or raw["cluster_id"]), raw.get("label"), [str(m) for m in raw.get("members") or []], [str(m) for m in raw.get("member_cluster_ids") or []], None if order is None else int(order), bool(raw.get("collapse", False))
    )


def _edge(raw: Any) -> ManualEdge:
    if not isinstance(raw, dict):
        raise ValueError("each manual edge must be a mapping")
    text = lambda k: str(raw.get(k) or "")
    missing = raw.get("on_missing", "warn")
    return ManualEdge(text("source"), text("target"), raw.get("label"), raw.get("note"), missing if missing in ("warn", "placeholder") else "warn")


def load_config(path: str | None) -> Config:
    """Settings of a YAML or JSON file, by its suffix; defaults without one. Unknown settings and values outside their choices warn."""
    config = Config()
    if path:
        with open(path, encoding="utf-8") as f:
            if os.path.splitext(path)[1].lower() in (".yaml", ".yml"):
                import yaml

                raw = yaml.safe_load(f) or {}
            else:
                raw = json.load(f)
        _fill(config, raw, "")
    return config


def discover_config(folder: str) -> str | None:
    """The settings file that a folder has: pipeline_user_settings.yaml, else user_configs/project_config.yaml."""
    for name in ("pipeline_user_settings.yaml", "user_configs/project_config.yaml"):
        if os.path.isfile(os.path.join(folder, name)):
            return os.path.join(folder, name)
    return None

"""What the three script readers share: path normalisation on the Python side, the rows they give, and the context they get."""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass, field

from strandline.config import Normalization
from strandline.functions.paths import markers_of

#: One row for each thing a script says. kind: event, child, global, diagnostic.
PARSED_SCHEMA = (
    "script string, language string, kind string, line int, command string, raw_path string, normalized_paths array<string>, was_absolute boolean, "
    "resolution_status string, dynamic_pattern string, is_write boolean, candidates array<string>, name string, value string, level string, code string, message string, payload map<string,string>"
)
FIELDS = [f.split()[0] for f in PARSED_SCHEMA.split(", ")]
BARE = re.compile(r"^[./\\]*$")
ABSOLUTE = re.compile(r"^(?:/|\\\\|[A-Za-z]:[\\/])")
#: Before a candidate that is a name only: the one file of the tree that has it, in whichever folder.
ANYWHERE = "**/"
EXTERNAL = re.compile(r"^(?:https?|ftp|s3|gs)://")


def normalize(token: str) -> str:
    v = re.sub(r"/+", "/", token.strip().strip('"').strip("'").replace("\\", "/"))
    return posixpath.normpath(v) if v else "."


@dataclass
class Context:
    """Where a script stands and how its paths are read. ``inherited``: values of variables from scripts that run it."""

    root: str
    script: str
    normalization: Normalization = field(default_factory=Normalization)
    placeholder: str = "{dynamic}"
    literal_only: bool = False
    inherited: dict[str, str] = field(default_factory=dict)
    #: what is said besides the rows that a reader returns
    notes: list[dict] = field(default_factory=list)

    def relative(self, path: str) -> tuple[str, bool]:
        """The project-relative path and whether it was absolute; the same order of rules as the column function."""
        raw, absolute, n = normalize(path), bool(ABSOLUTE.match(path)), self.normalization
        done = (lambda p: p.lower()) if n.fold_case else (lambda p: p)
        for source, target in sorted(n.path_prefix_aliases.items(), key=lambda x: -len(x[0])):
            s = source.replace("\\", "/").rstrip("/")
            if raw == s or raw.startswith(s + "/"):
                return done(normalize(posixpath.join(target.replace("\\", "/"), raw[len(s) :].lstrip("/")) or ".")), absolute
        for prefix in (self.root.rstrip("/"), self.root.rstrip("/").rsplit("/", 1)[-1]):
            if prefix and (raw == prefix or raw.startswith(prefix + "/")):
                return done(normalize(raw[len(prefix) :].lstrip("/") or ".")), absolute
        if absolute:
            parts = [p for p in raw.split("/") if p not in ("", ".")]
            for m in markers_of(self.root, n):
                mark = [p for p in m.split("/") if p not in ("", ".")]
                for i in range(len(parts) - len(mark) + 1):
                    if mark and parts[i : i + len(mark)] == mark:
                        return done("/".join(parts[i + len(mark) :]) or "."), absolute
            if raw.startswith("/") and self.root.startswith("/"):
                return done(posixpath.relpath(raw, self.root)), absolute
        return done(raw.removeprefix("./") if n.strip_leading_dot else raw), absolute

    def from_script(self, path: str) -> str:
        """A relative path that goes up is taken from the script's folder."""
        if ".." in path and not ABSOLUTE.match(path):
            return posixpath.normpath(posixpath.join(posixpath.dirname(self.script), path.replace("\\", "/")))
        return path

    def event(self, line: int, command: str, raw: str, expanded: list[str], status: str, pattern: str | None, write: bool | None = None) -> dict | None:
        """An event row of expanded paths; None if no path is left. Paths outside the root carry the suffixes under which they may exist."""
        out, absolute, maybe = [], False, []
        for path in expanded:
            if EXTERNAL.match(path):
                self.notes.append(self.diagnostic(line, "info", "external_reference", f"External reference skipped in {self.script}:{line}: {path}", path=path))
                continue
            norm, was = self.relative(self.from_script(path))
            if BARE.match(norm):
                continue
            absolute = absolute or was
            if was and (norm.startswith(("..", "/")) or ":" in norm[:3]):
                parts = [p for p in normalize(path).split("/") if p not in ("", ".")]
                maybe = ["/".join(parts[i:]) for i in range(len(parts))]
            out.append(norm)
        if not out:
            return None
        return row("event", self, line=line, command=command, raw_path=raw, normalized_paths=out, was_absolute=absolute, resolution_status=status, dynamic_pattern=pattern, is_write=write, candidates=maybe if len(out) == 1 else [])

    def diagnostic(self, line: int, level: str, code: str, message: str, **payload: str) -> dict:
        return row("diagnostic", self, line=line, level=level, code=code, message=message, payload={"script": self.script, **payload})


def row(kind: str, c: Context, **values: object) -> dict:
    return dict.fromkeys(FIELDS) | {"kind": kind, "script": c.script} | values

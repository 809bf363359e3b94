"""Python scripts. The syntax tree is evaluated as far as paths go; scripts that don't parse are read line by line for literal paths.

Assignments are taken without regard to their order, the last one of a name counts, as names are mostly set once at the top.
"""

from __future__ import annotations

import ast
import posixpath
import re

from strandline.operators.catalog import CATALOG, PY_PATH_ARGUMENTS
from strandline.resolve.common import ABSOLUTE, ANYWHERE, Context, row

_CALLS = {c.command: c.kind for c in CATALOG if c.language == "python"}
_LITERAL = [(c.kind, c.command, re.compile(c.regex)) for c in CATALOG if c.language == "python"]
_LIBRARIES = {"pandas": "pd", "numpy": "np", "geopandas": "gpd"}
#: Calls by dotted name whose first argument is the path read.
_READS = {f"pd.{c}": c for c in _CALLS if c.startswith("read_")} | {f"np.{c[3:]}": c for c in ("np_load", "np_loadtxt", "np_genfromtxt")} | {"gpd.read_file": "gpd_read_file", "joblib.load": "joblib_load", "runpy.run_path": "runpy"}
#: Calls by dotted name that write: command and which argument is the path.
_WRITES = {f"np.{c[3:]}": (c, 0) for c in ("np_save", "np_savetxt", "np_savez", "np_savez_compressed")} | {"joblib.dump": ("joblib_dump", 1)}
#: Methods that write to their first argument.
_METHODS = {c: c for c in _CALLS if c.startswith("to_")} | {"savefig": "savefig", "save": "save_method"}
_WRAPPED = {"pickle.dump": "pickle_dump", "json.dump": "json_dump"}
# How an f-string ends that is taken for a path, and what makes it one that is written.
FILE_KINDS = (".parquet", ".csv", ".pkl", ".pickle", ".feather", ".json", ".xlsx", ".dta", ".npy", ".npz", ".hdf", ".h5", ".orc", ".pdf", ".png", ".svg", ".eps")
DRAWN = (".png", ".pdf", ".svg", ".eps", ".tex")
WRITING_METHODS = {"to_csv", "to_parquet", "to_excel", "to_json", "to_feather", "to_hdf", "to_pickle", "to_orc", "to_stata", "savefig", "save"}
DUMPS = {"pickle.dump", "json.dump", "joblib.dump"}
#: How many lines after a directory scan an .endswith() still says which files are meant.
HINT_LINES = 10
STAR = "*"


class Reader:
    def __init__(self, tree: ast.Module, c: Context, constants: dict[str, str]):
        self.c, self.tree = c, tree
        self.alias: dict[str, str] = {}  # local name to dotted name
        self.values: dict[str, ast.expr] = {}
        self.constants = constants
        self.busy: set[str] = set()
        self.memo: dict[str, str | None] = {}
        self.imports: list[tuple[int, str, list[str]]] = []
        self.taken_from: dict[str, tuple[str, str]] = {}  # local name to module and name there
        for n in ast.walk(tree):
            if isinstance(n, ast.Import):
                for a in n.names:
                    self.alias[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
                    self.imports.append((n.lineno, a.name, []))
            elif isinstance(n, ast.ImportFrom):
                base = "." * n.level + (n.module or "")
                self.imports.append((n.lineno, base, [a.name for a in n.names]))
                for a in n.names:
                    self.alias[a.asname or a.name] = f"{n.module or ''}.{a.name}".strip(".")
                    self.taken_from[a.asname or a.name] = (base, a.name)
            elif isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name):
                self.values[n.targets[0].id] = n.value
            elif isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name) and n.value is not None:
                self.values[n.target.id] = n.value

    def dotted(self, f: ast.expr) -> str:
        """The dotted name of a function with imports undone and the usual short names for libraries; '' for other expressions."""
        parts = []
        while isinstance(f, ast.Attribute):
            parts.append(f.attr)
            f = f.value
        if not isinstance(f, ast.Name):
            return ""
        name = self.alias.get(f.id, f.id)
        full = ".".join([name, *reversed(parts)])
        for lib, short in _LIBRARIES.items():
            if full == lib or full.startswith(lib + "."):
                full = short + full[len(lib) :]
        return full

    def name(self, n: str) -> str | None:
        if n in self.memo:
            return self.memo[n]
        if n in self.busy:
            return None
        if n not in self.values:
            if n in self.taken_from:  # under the name that the module gives it
                module, name = self.taken_from[n]
                for place in self.module_places(module):
                    if f"{place}:{name}" in self.constants:
                        return self.constants[f"{place}:{name}"]
            return self.constants.get(n, self.c.inherited.get(n))
        self.busy.add(n)
        self.memo[n] = v = self.value(self.values[n])
        self.busy.discard(n)
        return v

    def value(self, e: ast.expr | None) -> str | None:
        """The text of a path expression; parts that can't be known become a star inside, and None if nothing is known."""
        match e:
            case ast.Constant(value=str() as s):
                return s
            case ast.Constant(value=int() as i):
                return str(i)
            case ast.Name(id="__file__"):
                return self.c.root.rstrip("/") + "/" + self.c.script if self.c.root.startswith("/") else self.c.script
            case ast.Name(id=n):
                return self.name(n)
            case ast.JoinedStr(values=vs):
                out = [v.value if isinstance(v, ast.Constant) else self.value(v.value) or STAR for v in vs]
                return "".join(out)
            case ast.BinOp(left=a, op=ast.Add(), right=b):
                x, y = self.value(a), self.value(b)
                return None if x is None and y is None else (x or STAR) + (y or STAR)
            case ast.BinOp(left=a, op=ast.Div(), right=b):
                return self.join([a, b])
            case ast.BinOp(left=a, op=ast.Mod(), right=b):
                x = self.value(a)
                args = list(b.elts) if isinstance(b, ast.Tuple) else [b]
                return None if x is None else self.fill(re.split(r"%[-+ #0-9.]*[sdrif]", x), args)
            case ast.Attribute(value=v, attr="parent"):
                x = self.value(v)
                return None if x is None else posixpath.dirname(x) or "."
            case ast.Attribute(value=v, attr=a):
                return self.constants.get(f"{self.dotted(v)}.{a}")
            case ast.Subscript(value=ast.Attribute(value=v, attr="parents"), slice=ast.Constant(value=int() as k)):
                x = self.value(v)
                for _ in range(k + 1):
                    x = None if x is None else posixpath.dirname(x) or "."
                return x
            case ast.Subscript(value=ast.Name(id=n), slice=ast.Constant(value=key)) if isinstance(self.values.get(n), ast.Dict):
                of = self.values[n]
                return next((self.value(v) for k, v in zip(of.keys, of.values) if isinstance(k, ast.Constant) and k.value == key), None)
            case ast.Call():
                return self.call(e)
        return None

    def fill(self, pieces: list[str], args: list[ast.expr]) -> str:
        out = pieces[0]
        for i, p in enumerate(pieces[1:]):
            out += ((self.value(args[i]) if i < len(args) else None) or STAR) + p
        return out

    def join(self, args: list[ast.expr]) -> str | None:
        got = [self.value(a) for a in args]
        if all(g is None for g in got):
            return None
        while got and got[0] is None:  # an unknown base is left out
            got.pop(0)
        return posixpath.join(*(g if g is not None else STAR for g in got))

    def call(self, e: ast.Call) -> str | None:
        f, name = e.func, self.dotted(e.func)
        if name in ("os.path.join",):
            return self.join(e.args)
        if name in ("pathlib.Path", "Path", "pathlib.PurePath", "pathlib.PosixPath"):
            return self.join(e.args) if e.args else "."
        if name in ("os.path.abspath", "os.path.realpath", "os.path.normpath", "os.path.expanduser", "str", "os.fspath") and e.args:
            return self.value(e.args[0])
        if name == "os.path.dirname" and e.args:
            x = self.value(e.args[0])
            return None if x is None else posixpath.dirname(x) or "."
        if name == "os.path.basename" and e.args:
            x = self.value(e.args[0])
            return None if x is None else posixpath.basename(x)
        if name in ("os.getcwd", "pathlib.Path.cwd"):
            return "."
        if isinstance(f, ast.Attribute):
            if f.attr == "joinpath":
                return self.join([f.value, *e.args])
            if f.attr in ("resolve", "absolute", "expanduser", "as_posix", "strip"):
                return self.value(f.value)
            if f.attr == "format":
                x = self.value(f.value)
                if x is None:
                    return None
                named = {k.arg: k.value for k in e.keywords if k.arg}
                count = iter(range(len(e.args)))

                def put(m: re.Match) -> str:
                    key = m[1]
                    if key == "":
                        k = next(count, None)
                        arg = e.args[k] if k is not None else None
                    elif key.isdigit():
                        arg = e.args[int(key)] if int(key) < len(e.args) else None
                    else:
                        arg = named.get(key)
                    return self.value(arg) or STAR

                return re.sub(r"\{(\w*)[^{}]*\}", put, x)
            if f.attr in ("with_suffix", "with_name") and e.args:
                x, y = self.value(f.value), self.value(e.args[0])
                if x is None or y is None:
                    return None
                return posixpath.splitext(x)[0] + y if f.attr == "with_suffix" else posixpath.join(posixpath.dirname(x), y)
        return None

    # events

    def path_of(self, e: ast.expr | None) -> str | None:
        v = self.value(e)
        if v is None or not v.strip(STAR + "/. "):
            return None
        return re.sub(r"\*{2,}", STAR, v) if "**" not in v else v

    def read(self) -> list[dict]:
        c, out, taken = self.c, [], set()
        hints = [(n.lineno, n.args[0].value) for n in ast.walk(self.tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr == "endswith" and n.args and isinstance(n.args[0], ast.Constant) and isinstance(n.args[0].value, str)]

        def add(n: ast.Call, command: str, arg: ast.expr | None, write: bool, tail: str = "") -> None:
            v = self.path_of(arg)
            if v is None or (n.lineno, write) in taken:
                return
            event = c.event(n.lineno, command, ast.unparse(arg), [v + tail], "full", None, write)
            if event:
                if event["candidates"] and not tail and (end := self.bare_end(arg)):
                    event["candidates"].append(ANYWHERE + end)
                taken.add((n.lineno, write))
                out.append(event)

        for n in sorted((x for x in ast.walk(self.tree) if isinstance(x, ast.Call)), key=lambda x: (x.lineno, x.col_offset)):
            name = self.dotted(n.func)
            attr = n.func.attr if isinstance(n.func, ast.Attribute) else ""
            first = n.args[0] if n.args else next((k.value for k in n.keywords if k.arg in ("filepath_or_buffer", "path", "io", "path_or_buf", "fname", "file")), None)
            bare = name.rsplit(".", 1)[-1]
            if name in ("open", "builtins.open", "io.open") or (attr == "open" and not name.startswith(("os.", "zipfile.", "gzip."))):
                arg = first if attr != "open" or name in ("io.open", "builtins.open") else n.func.value
                modes = n.args[1:2] if arg is first else n.args[:1]
                mode = self.value(modes[0]) if modes else next((self.value(k.value) for k in n.keywords if k.arg == "mode"), "r")
                write = bool(mode and mode[0] in "wax")
                add(n, "open_write" if write else "open_read", arg, write)
            elif name in _READS:
                add(n, _READS[name], first, False)
            elif name in _WRITES:
                command, at = _WRITES[name]
                add(n, command, n.args[at] if len(n.args) > at else None, True)
            elif name in ("os.listdir", "os.walk", "os.scandir") and n.args:
                tail = next((h for line, h in hints if n.lineno <= line <= n.lineno + HINT_LINES), "")
                deep = "/**/*" if name == "os.walk" else "/*"
                add(n, "os_walk" if name == "os.walk" else "open_read", n.args[0], False, deep + tail)
            elif attr in ("write_text", "write_bytes"):
                add(n, attr, n.func.value, True)
            elif attr in ("read_text", "read_bytes"):
                add(n, "open_read", n.func.value, False)
            elif attr in _METHODS:
                add(n, _METHODS[attr], first, True)
            elif name.startswith("subprocess.") or name == "os.system":
                for s in ast.walk(n):
                    if isinstance(s, ast.Constant) and isinstance(s.value, str):
                        for p in re.findall(r"[\w./-]+\.py\b", s.value):
                            out.append(row("child", c, line=n.lineno, command="import", candidates=self.places(p)))
            elif bare not in _CALLS:
                for k in n.keywords:
                    v = self.path_of(k.value) if k.arg in PY_PATH_ARGUMENTS else None
                    if v and "." in v.rsplit("/", 1)[-1]:
                        add(n, "kwarg_write", k.value, True)
        seen = {(e["command"], p) for e in out if e["kind"] == "event" for p in e["normalized_paths"]}
        # an f-string that looks like a file and that no call took; it is written if its kind is only drawn, or if something is written on its line
        writing = {n.lineno for n in ast.walk(self.tree) if isinstance(n, ast.Call) and self.writes(n)}
        for n in ast.walk(self.tree):
            if isinstance(n, ast.JoinedStr) and not {(n.lineno, True), (n.lineno, False)} & taken:
                v = self.value(n)
                if v and v.lower().endswith(FILE_KINDS) and any(isinstance(x, ast.FormattedValue) for x in n.values):
                    write = v.lower().endswith(DRAWN) or n.lineno in writing
                    event = c.event(n.lineno, "fstring_path", ast.unparse(n), [v], "full", None, write)
                    if event and ("fstring_path", event["normalized_paths"][0]) not in seen:
                        taken.add((n.lineno, write))
                        out.append(event)
        for line, module, names in self.imports:
            up = len(module) - len(module.lstrip("."))
            path = module.lstrip(".").replace(".", "/")
            here = posixpath.dirname(c.script)
            for _ in range(up - 1):
                here = posixpath.dirname(here)
            files = [path + ".py"] if path else []
            files += [posixpath.join(path, n) + ".py" for n in names]
            for f in files:
                places = [posixpath.join(here, f)] if up else list(dict.fromkeys([f, posixpath.join(here, f)]))
                out.append(row("child", c, line=line, command="import", name=None, candidates=places))
        # top-level texts that importing scripts may use
        for n, e in self.values.items():
            v = self.value(e)
            if v is not None and STAR not in v:
                out.append(row("global", c, line=e.lineno, name=n, value=v))
        return out

    def writes(self, n: ast.Call) -> bool:
        """Whether a call writes a file, whatever its path."""
        name, attr = self.dotted(n.func), n.func.attr if isinstance(n.func, ast.Attribute) else ""
        if name.rsplit(".", 1)[-1] == "open":
            modes = [a for a in [*n.args, *(k.value for k in n.keywords if k.arg == "mode")] if isinstance(a, ast.Constant) and isinstance(a.value, str)]
            return any(re.match(r"[wa]", m.value) for m in modes)
        return attr in WRITING_METHODS or name in DUMPS

    def module_places(self, module: str) -> list[str]:
        """The files that a module's name may mean: below the root, else beside the script; with dots in front only from the script's folder."""
        up = len(module) - len(module.lstrip("."))
        f = module.lstrip(".").replace(".", "/") + ".py"
        here = posixpath.dirname(self.c.script)
        for _ in range(up - 1):
            here = posixpath.dirname(here)
        return [posixpath.join(here, f)] if up else list(dict.fromkeys([f, posixpath.join(here, f)]))

    def bare_end(self, e: ast.expr | None) -> str | None:
        """the file name without folders that an expression joins to an absolute base."""
        seen = set()
        while isinstance(e, ast.Name) and e.id in self.values and e.id not in seen:
            seen.add(e.id)
            e = self.values[e.id]
        match e:
            case ast.Call(args=[first, *rest]) if rest and self.dotted(e.func) == "os.path.join":
                pass
            case ast.BinOp(left=first, op=ast.Div(), right=last):
                rest = [last]
            case _:
                return None
        base, end = self.value(first), self.join(rest)
        return end if base and end and ABSOLUTE.match(base) and not re.search(r"[/\\*]", end) else None

    def places(self, p: str) -> list[str]:
        return list(dict.fromkeys([posixpath.normpath(p), posixpath.normpath(posixpath.join(posixpath.dirname(self.c.script), p))]))


def parse(text: str, c: Context) -> list[dict]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _by_line(text, c)
    try:
        return _distinct(Reader(tree, c, dict(c.inherited)).read())
    except RecursionError:
        return _by_line(text, c)


def _distinct(rows: list[dict]) -> list[dict]:
    """The first line of each (command, paths) of a script; other rows as they are."""
    seen, out = set(), []
    for r in rows:
        if r["kind"] == "event":
            key = (r["command"], tuple(r["normalized_paths"]))
            if key in seen:
                continue
            seen.add(key)
        out.append(r)
    return out


def _by_line(text: str, c: Context) -> list[dict]:
    out = []
    for i, line in enumerate(text.splitlines(), 1):
        for wanted in ("read", "write"):
            for kind, command, regex in _LITERAL:
                if kind == wanted and (m := regex.search(line)):
                    raw = m[1] if m[1] is not None else m[2]
                    event = c.event(i, command, raw, [re.sub(r"\{[^}]+\}", STAR, raw)], "full", None, kind == "write")
                    if event:
                        out.append(event)
                    break
    return _distinct(out)

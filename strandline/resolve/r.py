"""R scripts: statements joined over lines, text-valued expressions evaluated as far as they are known.

What a path takes from variables that aren't known stays in it as {name}, and the event is partial.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

from strandline.operators.catalog import _R_NAMED, _R_READS, _R_WRITES, R_PATH_ARGUMENTS
from strandline.resolve.common import Context, row

ASSIGN = re.compile(r"^\s*([A-Za-z.][\w.]*)\s*(?:<-|<<-|=)(?!=)\s*(.+)$", re.S)
#: Function name to command, for calls with the path first, and with the path second.
_FIRST = {fn.lower(): c for c, fn in _R_READS.items()} | {"ggsave": "ggsave", "pdf": "pdf", "png": "png", "svg": "svg", "jpeg": "jpeg", "tiff": "tiff"}
_SECOND = {fn.lower(): c for c, fn in _R_WRITES.items()} | {"write_json": "write_json"}
_NAMED = {}
for _c, (_fn, _arg) in _R_NAMED.items():
    if _arg:
        _NAMED.setdefault(_fn.lower(), {})[_arg] = _c
_READ_COMMANDS = set(_R_READS) | {"list_files"}


def statements(text: str) -> Iterator[tuple[int, str]]:
    """(first line, statement): comments cut off outside quotes, lines joined while brackets are open or an operator hangs."""
    buf, start, depth = "", 0, 0
    for i, line in enumerate(text.splitlines(), 1):
        out, quote, esc = [], "", False
        for ch in line:
            if quote:
                out.append(ch)
                if esc:
                    esc = False
                elif ch == "\\":
                    esc = True
                elif ch == quote:
                    quote = ""
                continue
            if ch == "#":
                break
            if ch in "\"'":
                quote = ch
            depth += (ch in "([") - (ch in ")]")
            out.append(ch)
        piece = "".join(out)
        if not buf:
            start = i
        buf += (" " if buf else "") + piece
        if depth > 0 or re.search(r"(%>%|\|>|\+|<-|,)\s*$", piece):
            continue
        if buf.strip():
            yield start, buf
        buf, depth = "", 0
    if buf.strip():
        yield start, buf


TOKEN = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|([A-Za-z.][\w.]*(?:::[\w.]+)?)|(\d+(?:\.\d+)?)|(<-|==|!=|<=|>=|\|>|%[^%]*%|&&|\|\||.))""", re.S)


class Call:
    def __init__(self, fn: str, args: list[tuple[str, object]]):
        self.fn, self.args = fn, args

    def positional(self) -> list[object]:
        return [v for k, v in self.args if not k]

    def named(self, k: str) -> object | None:
        return next((v for n, v in self.args if n == k), None)


class Name(str):
    pass


class Other:
    """An expression that no path comes from; its parts may hold calls."""

    def __init__(self, parts: list[object]):
        self.parts = parts


def parse_expression(text: str) -> object:
    tokens = [m.groups() for m in TOKEN.finditer(text.strip()) if any(m.groups())]
    pos = 0

    def peek() -> str | None:
        return tokens[pos][3] if pos < len(tokens) else None

    def sequence(ends: str) -> object:
        nonlocal pos
        parts: list[object] = []
        while pos < len(tokens) and not (tokens[pos][3] and tokens[pos][3] in ends):
            parts.append(atom())
        return parts[0] if len(parts) == 1 else Other(parts)

    def atom() -> object:
        nonlocal pos
        s, name, num, op = tokens[pos]
        pos += 1
        if s:
            return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), s[1:-1])
        if num:
            return num
        if name:
            if peek() == "(":
                pos += 1
                return Call(name, arguments(")"))
            return Name(name)
        if op in "([{":
            inner = arguments({"(": ")", "[": "]", "{": "}"}[op])
            return inner[0][1] if op == "(" and len(inner) == 1 else Other([v for _, v in inner])
        return Other([])

    def arguments(end: str) -> list[tuple[str, object]]:
        nonlocal pos
        args: list[tuple[str, object]] = []
        while pos < len(tokens) and peek() != end:
            key = ""
            if pos + 1 < len(tokens) and tokens[pos][1] and tokens[pos + 1][3] == "=":
                key = tokens[pos][1]
                pos += 2
            args.append((key, sequence("," + end)))
            if peek() == ",":
                pos += 1
        pos += 1
        return args

    parts = []
    while pos < len(tokens):
        parts.append(sequence(""))
    return parts[0] if len(parts) == 1 else Other(parts)


class Evaluator:
    def __init__(self, c: Context):
        self.c = c
        self.values: dict[str, str] = {k.lower(): v for k, v in c.inherited.items()}

    def text(self, e: object) -> str | None:
        """The text of an expression; unknown parts as {name} or a star; None if it is no text."""
        if isinstance(e, Name):
            return self.values.get(e.lower(), f"{{{e}}}")
        if isinstance(e, str):
            return e
        if not isinstance(e, Call):
            return None
        fn = e.fn.rsplit("::", 1)[-1]
        args = [a for k, a in e.args if k not in ("sep", "collapse", "mustWork", "winslash", "recursive", "ext")]
        if fn in ("here", "file.path", "path", "path_join", "path_package"):
            got = [self.text(a) or "*" for a in args]
            return posixpath.join(*got) if got else "."
        if fn == "paste0":
            return "".join(self.text(a) or "*" for a in args)
        if fn == "paste":
            sep = e.named("sep")
            return (self.text(sep) if sep is not None else " ").join(self.text(a) or "*" for a in args)
        if fn == "sprintf" and args:
            form = self.text(args[0]) or ""
            rest = iter([self.text(a) or "*" for a in args[1:]])
            return re.sub(r"%[-+ #0-9.]*[sdif]", lambda m: next(rest, "*"), form)
        if fn in ("glue", "str_glue") and args:
            return re.sub(r"\{([^{}]+)\}", lambda m: self.values.get(m[1].strip().lower(), f"{{{m[1].strip()}}}"), "".join(self.text(a) or "" for a in args))
        if fn in ("normalizePath", "path.expand", "as.character", "file", "path_abs", "path_norm", "trimws") and args:
            return self.text(args[0])
        if fn in ("dirname", "path_dir") and args:
            x = self.text(args[0])
            return None if x is None else posixpath.dirname(x) or "."
        if fn in ("basename", "path_file") and args:
            x = self.text(args[0])
            return None if x is None else posixpath.basename(x)
        if fn in ("getwd", "get_script_dir"):
            return "."
        if fn in ("getSourceEditorContext", "getActiveDocumentContext", "this.path"):
            return self.c.script
        return None


def calls_in(e: object) -> Iterator[Call]:
    if isinstance(e, Call):
        yield e
        for _, a in e.args:
            yield from calls_in(a)
    elif isinstance(e, Other):
        for p in e.parts:
            yield from calls_in(p)


def parse(text: str, c: Context) -> list[dict]:
    ev, out, todo = Evaluator(c), [], []
    for line, s in statements(text):
        m = ASSIGN.match(s)
        try:
            tree = parse_expression(m[2] if m else s)
        except RecursionError:
            continue
        if m and isinstance(tree, (str, Call)):
            v = ev.text(tree)
            if v is not None and not re.search(r"[{*]", v):
                ev.values[m[1].lower()] = v
                out.append(row("global", c, line=line, name=m[1].lower(), value=v))
        todo.append((line, tree))
    seen = set()

    def add(line: int, command: str, e: object) -> bool:
        v = ev.text(e)
        if v is None or not v.strip("*/. "):
            return False
        if re.fullmatch(r"\{[^{}]*\}", v):
            return False
        partial = bool(re.search(r"\{[^{}/]+\}", v))
        event = c.event(line, command, v, [v], "partial" if partial else "full", v if partial else None, command not in _READ_COMMANDS)
        key = (command, *(event["normalized_paths"] if event else ()))
        if event and key not in seen:
            seen.add(key)
            out.append(event)
        return bool(event)

    for line, tree in todo:
        done = {"read": False, "write": False}
        for call in calls_in(tree):
            fn = call.fn.lower()
            short = fn.rsplit("::", 1)[-1]
            fn = fn if fn in _FIRST or fn in _SECOND else short
            args = call.positional()
            if short in ("source", "sys.source") and (args or call.named("file") is not None):
                p = ev.text(args[0] if args else call.named("file"))
                if p and "*" not in p and "{" not in p:
                    rel = c.relative(c.from_script(p))[0]
                    near = posixpath.normpath(posixpath.join(posixpath.dirname(c.script), p))
                    out.append(row("child", c, line=line, command="source", name=rel, candidates=list(dict.fromkeys([rel, near]))))
                continue
            if short == "list.files" and (args or call.named("path") is not None):
                folder = ev.text(args[0] if args else call.named("path"))
                pat = call.named("pattern")
                ext = re.search(r"\\?\.(\w+)\$?$", pat) if isinstance(pat, str) else None
                if folder:
                    done["read"] |= add(line, "list_files", posixpath.join(folder, f"*.{ext[1]}" if ext else "*"))
                continue
            named = _NAMED.get(short, {})
            hit = next(((cmd, call.named(a)) for a, cmd in named.items() if call.named(a) is not None), None)
            if hit is None and fn in _FIRST and (args or call.named("file") is not None):
                hit = (_FIRST[fn], args[0] if args else call.named("file"))
            elif hit is None and fn in _SECOND and len(args) > 1:
                hit = (_SECOND[fn], args[1])
            elif hit is None and fn in _SECOND and call.named("file") is not None:
                hit = (_SECOND[fn], call.named("file"))
            if hit is None:
                continue
            kind = "read" if hit[0] in _READ_COMMANDS else "write"
            if not done[kind]:
                done[kind] = add(line, *hit)
        if not done["read"] and not done["write"]:
            for call in calls_in(tree):
                for k, a in call.args:
                    v = ev.text(a) if k in R_PATH_ARGUMENTS else None
                    if v and re.search(r"\.\w{1,7}$", v):
                        add(line, "inferred_kwarg", a)
    return out

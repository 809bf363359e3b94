"""Stata scripts: line by line, with globals, locals and loops as they stand at each line."""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence

from strandline.operators.catalog import CATALOG
from strandline.resolve.common import Context, normalize, row

# The forms of assignments and loops.
GLOBAL = re.compile(r"^\s*global\s+(\w+)\s+(.+?)\s*$", re.I)
COMPUTED = re.compile(r"^\s*local\s+(\w+)\s*=\s*(.+?)\s*$", re.I)
LOCAL = re.compile(r"^\s*local\s+(\w+)\s+(.+?)\s*$", re.I)
FOREACH = re.compile(r"^\s*foreach\s+(\w+)\s+(?:in|of\s+local)\s+(.+?)\s*\{\s*$", re.I)
FORVALUES = re.compile(r"^\s*forvalues\s+(\w+)\s*=\s*(-?\d+)\s*/\s*(-?\d+)\s*\{\s*$", re.I)
MACRO = re.compile(r"`([^'`]+)'")
DOLLAR = re.compile(r"\$\{(\w+)\}|\$(\w+)")
CONTINUED = re.compile(r"[ \t]*///[^\n]*\n")
_PATTERNS = [(c.kind, c.command, re.compile(c.regex)) for c in CATALOG if c.language == "stata"]


def words(text: str) -> list[str]:
    text = re.sub(r"/\*.*?\*/|//.*$", "", text)
    return text.replace('"', " ").replace("`'", " ").split()


class Numbers(Sequence):
    """The numbers of a range as texts, each made when it is asked for: a loop that no path uses costs nothing, however long it is."""

    def __init__(self, numbers: range):
        self.numbers = numbers

    def __len__(self) -> int:
        return len(self.numbers)

    def __getitem__(self, i: int) -> str:
        return str(self.numbers[i])


class Environment:
    def __init__(self, c: Context):
        self.c = c
        self.globals: dict[str, str] = dict(c.inherited)
        self.locals: dict[str, list[str]] = {"c(pwd)": ["."], "c(current_do_file)": [c.script]}
        self.loops: list[tuple[str, Sequence[str]]] = []

    def expand(self, text: str, busy: frozenset[str] = frozenset()) -> str:
        """Globals replaced, whole names only, as deep as they stand in each other; a name within its own value stays."""

        def value(m: re.Match) -> str:
            name = m[1] or m[2]
            return self.expand(self.globals[name], busy | {name}) if name in self.globals and name not in busy else m[0]

        return DOLLAR.sub(value, text)

    def texts(self, text: str, env: dict[str, Sequence[str]], busy: frozenset[str] = frozenset()) -> list[str]:
        """The texts that come of a text's macros, as deep as they stand in each other: all combinations of their values, in order. A name within its own value is unknown there."""
        names = list(dict.fromkeys(MACRO.findall(text)))
        if not names:
            return [text]
        if any(n not in env or n in busy for n in names):
            # beside an unknown name only those of one value are known
            values = {n: [self.texts(self.expand(env[n][0]), env, busy | {n})[0] if n not in busy and len(env.get(n, ())) == 1 else f"{{{n}}}"] for n in names}
        else:
            values = {n: [t for v in env[n] for t in (self.texts(self.expand(v), env, busy | {n}) if "`" in v or "$" in v else [v])] for n in names}
        out = []
        for each in itertools.product(*values.values()):
            of = dict(zip(names, each))
            out.append(self.expand(MACRO.sub(lambda m: of[m[1]], text)))
        # a name can be put together from others
        return list(dict.fromkeys(t for x in out for t in (self.texts(x, env, busy | set(names)) if MACRO.search(x) else [x])))

    def resolve(self, expression: str) -> tuple[list[str], str, str | None]:
        """The paths an expression stands for, 'full' or 'partial', and the pattern if partial."""
        if self.c.literal_only and ("$" in expression or "`" in expression):
            pattern = MACRO.sub(r"{\1}", DOLLAR.sub(lambda m: f"{{{m[1] or m[2]}}}", expression))
            return [pattern], "partial", pattern
        env = dict(self.locals) | dict(self.loops)
        texts = [self.expand(expression)]
        single = lambda m: env[m[1] or m[2]][0] if len(env.get(m[1] or m[2], ())) == 1 else f"{{{m[1] or m[2]}}}"
        first = DOLLAR.sub(single, texts[0])
        if any(len(env.get(a or b, ())) != 1 for a, b in DOLLAR.findall(texts[0])):
            return [first], "partial", first
        texts = self.texts(first, env)
        final = [MACRO.sub(r"{\1}", DOLLAR.sub(lambda m: f"{{{m[1] or m[2]}}}", t)).replace("\\", "/") for t in texts]
        final = list(dict.fromkeys(final))
        partial = any(re.search(r"\{[^{}/]+\}", f) for f in final)
        return final, "partial" if partial else "full", final[0] if partial else None


def parse(text: str, c: Context) -> list[dict]:
    env, out = Environment(c), []
    for i, line in enumerate(CONTINUED.sub(" ", text.replace("\r\n", "\n")).splitlines(), 1):
        if line.strip() == "}" and env.loops:
            env.loops.pop()
        elif m := GLOBAL.search(line):
            value = env.expand(m[2].strip().strip('"').strip("'"))
            norm, absolute = c.relative(value)
            env.globals[m[1]] = norm + "/" if value.endswith(("/", "\\")) and not norm.endswith("/") else norm
            out.append(row("global", c, line=i, name=m[1], value=env.globals[m[1]]))
            if absolute:
                out.append(c.diagnostic(i, "warning", "absolute_path_usage", f"Absolute path detected in global defined at {c.script}:{i}", path=norm))
        elif m := COMPUTED.search(line):
            env.locals[m[1]] = [c.placeholder] if "(" in m[2] else words(m[2])
        elif m := LOCAL.search(line):
            env.locals[m[1]] = words(m[2])
        elif m := FOREACH.search(line):
            env.loops.append((m[1], list(env.locals.get(m[2].strip(), words(m[2])))))
        elif m := FORVALUES.search(line):
            a, b = int(m[2]), int(m[3])
            step = 1 if b >= a else -1
            env.loops.append((m[1], Numbers(range(a, b + step, step))))
        else:
            out += _commands(line, i, env, c)
    return out


def _commands(line: str, i: int, env: Environment, c: Context) -> list[dict]:
    """At most one command of a line: a call, else a read, a write, an erase."""
    for wanted in ("call", "read", "write", "erase"):
        for kind, command, regex in _PATTERNS:
            if kind != wanted or not (m := regex.search(line)):
                continue
            raw = m[1] if m[1] is not None else m[2]
            expanded, status, pattern = env.resolve(raw)
            if kind == "call":
                return [row("child", c, line=i, command="do", name=normalize(c.relative(c.from_script(p))[0]), candidates=[]) for p in expanded]
            if kind == "erase":
                status, pattern = "full", None
            event = c.event(i, command, raw, expanded, status, pattern, kind == "write")
            return [event] if event else []
    return []

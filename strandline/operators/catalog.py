"""The command catalog: which calls in a script read, write, erase or call, as data.

A row is (language, kind, priority, command, regex); the regex's first filled group is the path. In a line the first matching row of a kind
counts. Lines of a language first meet one alternation of all its rows, and end there unless one of them matches; only what is left is asked
row by row, and only the row that matched takes the path out. Rows are added to CATALOG, or passed along, to teach new commands.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Command:
    language: str
    kind: str
    command: str
    regex: str


# The commands and their call forms.
_STATA_PATH = r'(?:"([^"]+)"|([^\s,]+\.[^\s,]+))'
_STATA_READS = {
    "use": r"\buse\s+",
    "import": r"\bimport\s+(?:delimited|excel)\s+(?:using\s+)?",
    "insheet": r"\binsheet\s+(?:using\s+)?",
    "append": r"\bappend\s+using\s+",
    "merge": r"\bmerge\s+[^\n]*?using\s+",
    "cross": r"\bcross\s+using\s+",
}
_STATA_WRITES = {
    "save": r"\bsave\s+",
    "export_delimited": r"\bexport\s+delimited\s+(?:using\s+)?",
    "export_excel": r"\bexport\s+excel\s+(?:using\s+)?",
    "graph_export": r"\bgraph\s+export\s+",
    "estimates_save": r"\bestimates\s+save\s+",
    "putexcel_set": r"\bputexcel\s+set\s+",
    "outsheet": r"\boutsheet\s+(?:using\s+)?",
    "log_using": r"\blog\s+using\s+",
    "esttab": r"\besttab\b[^\n]*?\busing\s+",
    "outreg2": r"\boutreg2\b[^\n]*?\busing\s+",
}
_PY_PATH = r"""(?:[rRbBuU]?"([^"]+)"|[rRbBuU]?'([^']+)')"""
_PY_WRITE_MODE = r"""(?:[rRbBuU]?"[wa][bt]?"|[rRbBuU]?'[wa][bt]?')"""
_PD_READS = ["read_csv", "read_excel", "read_parquet", "read_stata", "read_json", "read_feather", "read_table", "read_hdf", "read_pickle", "read_orc"]
_NP_READS = ["load", "loadtxt", "genfromtxt"]
_PD_WRITES = ["to_csv", "to_excel", "to_parquet", "to_stata", "to_json", "to_feather", "to_hdf", "to_pickle", "to_orc", "to_file"]
_NP_WRITES = ["save", "savetxt", "savez", "savez_compressed"]
_R_PATH = r"""(?:"([^"]+)"|'([^']+)')"""
#: R calls with the path first: command label to function.
_R_READS = {
    "read_csv": "read.csv", "read_csv2": "read.csv2", "read_table": "read.table", "read_delim": "read.delim", "readRDS": "readRDS", "load": "load",
    "read_csv_readr": "read_csv", "read_csv2_readr": "read_csv2", "read_delim_readr": "read_delim", "read_rds": "read_rds", "read_tsv": "read_tsv",
    "read_excel": "read_excel", "read_xls": "read_xls", "read_xlsx": "read_xlsx", "read_dta": "read_dta", "read_sas": "read_sas", "read_spss": "read_spss",
    "read_sav": "read_sav", "fread": "fread", "read_parquet": "read_parquet", "read_feather": "read_feather", "fromJSON": "fromJSON", "st_read": "st_read",
    "st_read_ns": "sf::st_read", "read_html": "read_html", "read.xlsx": "read.xlsx", "loadWorkbook": "loadWorkbook", "read.fst": "read.fst", "read_fst": "read_fst",
}
#: R calls with the data first and the path second.
_R_WRITES = {
    "write_csv": "write.csv", "write_csv2": "write.csv2", "write_table": "write.table", "saveRDS": "saveRDS", "write_csv_readr": "write_csv",
    "write_csv2_readr": "write_csv2", "write_tsv": "write_tsv", "write_delim": "write_delim", "write_rds": "write_rds", "write_xlsx": "write_xlsx",
    "fwrite": "fwrite", "write_dta": "write_dta", "write_sav": "write_sav", "write_sas": "write_sas", "write_parquet": "write_parquet",
    "write_feather": "write_feather", "st_write": "st_write", "st_write_ns": "sf::st_write", "tmap_save": "tmap_save", "saveWidget": "saveWidget",
    "writeLines": "writeLines", "write.xlsx": "write.xlsx", "saveWorkbook": "saveWorkbook", "write.fst": "write.fst",
}
#: R calls that name the path: command label to function and argument ('' for the first place).
_R_NAMED = {
    "saveRDS_kw": ("saveRDS", "file"), "save_rdata": ("save", "file"), "ggsave": ("ggsave", ""), "ggsave_kw": ("ggsave", "filename"),
    "pdf": ("pdf", ""), "pdf_kw": ("pdf", "filename"), "png": ("png", ""), "png_kw": ("png", "filename"), "svg": ("svg", ""), "svg_kw": ("svg", "filename"),
    "jpeg": ("jpeg", ""), "jpeg_kw": ("jpeg", "filename"), "tiff": ("tiff", ""), "tiff_kw": ("tiff", "filename"), "toJSON_write": ("toJSON", "path"),
    "tmap_save_kw": ("tmap_save", "filename"), "saveWidget_kw": ("saveWidget", "file"), "writeLines_kw": ("writeLines", "con"),
    "write_xlsx_kw": ("write_xlsx", "path"), "write_parquet_kw": ("write_parquet", "sink"), "cat_file": ("cat", "file"), "message_file": ("message", "file"),
}
#: Names of arguments that hold a path, for the heuristic writes.
PY_PATH_ARGUMENTS = ["filename", "path", "output", "output_path", "save_path", "filepath", "file", "fname"]
R_PATH_ARGUMENTS = ["con", "file", "filename", "filepath", "output", "path", "save_to"]


def _q(name: str) -> str:
    return name.replace(".", r"\.")


def _build() -> list[Command]:
    c: list[Command] = []
    add = lambda lang, kind, command, regex: c.append(Command(lang, kind, command, "(?i)" + regex))
    for command, head in _STATA_READS.items():
        add("stata", "read", command, head + _STATA_PATH)
    for command, head in _STATA_WRITES.items():
        add("stata", "write", command, head + _STATA_PATH)
    add("stata", "erase", "erase", r"\berase\s+" + _STATA_PATH)
    add("stata", "call", "do", r"\bdo\s+" + _STATA_PATH)
    for fn in _PD_READS:
        add("python", "read", fn, rf"\b(?:pd|pandas)\.{fn}\s*\(\s*{_PY_PATH}")
    for fn in _NP_READS:
        add("python", "read", f"np_{fn}", rf"\b(?:np|numpy)\.{fn}\s*\(\s*{_PY_PATH}")
    add("python", "read", "gpd_read_file", rf"\b(?:gpd|geopandas)\.read_file\s*\(\s*{_PY_PATH}")
    add("python", "read", "open_read", rf"\bopen\s*\(\s*{_PY_PATH}\s*(?:\)|,\s*(?:encoding|errors|newline|mode\s*=\s*[\"']r|[rRbBuU]?[\"']r))")
    for command, fn in (("pickle_load", "pickle.load"), ("json_load", "json.load"), ("yaml_safe_load", "yaml.(?:safe_load|load)")):
        add("python", "read", command, rf"\b{_q(fn)}\s*\(\s*open\s*\(\s*{_PY_PATH}")
    add("python", "read", "joblib_load", rf"\bjoblib\.load\s*\(\s*{_PY_PATH}")
    add("python", "read", "runpy", rf"\brunpy\.run_path\s*\(\s*{_PY_PATH}")
    for fn in _PD_WRITES:
        add("python", "write", fn, rf"\.{fn}\s*\(\s*{_PY_PATH}")
    add("python", "write", "savefig", rf"\.savefig\s*\(\s*{_PY_PATH}")
    for fn in _NP_WRITES:
        add("python", "write", f"np_{fn}", rf"\b(?:np|numpy)\.{fn}\s*\(\s*{_PY_PATH}")
    for command, fn in (("pickle_dump", r"pickle\.dump"), ("json_dump", r"json\.dump")):
        add("python", "write", command, rf"\b{fn}\s*\([^,]+,\s*open\s*\(\s*{_PY_PATH}")
    add("python", "write", "open_write", rf"\bopen\s*\(\s*{_PY_PATH}\s*,\s*{_PY_WRITE_MODE}")
    add("python", "write", "joblib_dump", rf"\bjoblib\.dump\s*\([^,]+,\s*{_PY_PATH}")
    add("python", "write", "save_method", rf"\.save\s*\(\s*{_PY_PATH}")
    for command in ("write_text", "write_bytes"):
        add("python", "write", command, rf"{_PY_PATH}\)?\.{command}\s*\(")
    for command, fn in _R_READS.items():
        add("r", "read", command, rf"\b{_q(fn)}\s*\(\s*{_R_PATH}")
    add("r", "read", "readRDS", rf"\breadRDS\s*\(.*?\bfile\s*=\s*{_R_PATH}")
    for command, fn in _R_WRITES.items():
        add("r", "write", command, rf"\b{_q(fn)}\s*\([^,]+,\s*{_R_PATH}")
    add("r", "write", "write_json", rf"\bwrite_json\s*\([^,]+,\s*{_R_PATH}")
    for command, (fn, arg) in _R_NAMED.items():
        add("r", "write", command, rf"\b{fn}\s*\(" + (rf".*?\b{arg}\s*=\s*" if arg else r"\s*") + _R_PATH)
    add("r", "call", "source", rf"\b(?:sys\.)?source\s*\(\s*{_R_PATH}")
    return c


CATALOG = _build()
#: Commands that need more than one line or a variable; the resolvers emit them.
FURTHER = {("python", "read"): ["os_walk"], ("python", "write"): ["kwarg_write"], ("r", "read"): ["list_files"], ("r", "write"): ["inferred_kwarg"]}


def command_kinds() -> list[tuple[str, str, str]]:
    """(language, command, kind), each once: how an event's command is routed."""
    rows = [(c.language, c.command, c.kind) for c in CATALOG if c.kind != "call"]
    rows += [(lang, command, kind) for (lang, kind), commands in FURTHER.items() for command in commands]
    return list(dict.fromkeys(rows))


def catalog_table(spark: SparkSession) -> DataFrame:
    """The catalog as a table: language, kind, priority, command, regex."""
    return spark.createDataFrame([(c.language, c.kind, i, c.command, c.regex) for i, c in enumerate(CATALOG)], "language string, kind string, priority int, command string, regex string")


def _branch(lines: DataFrame, language: Column, rows: list[Command], kinds: tuple[str, ...]) -> DataFrame:
    """The events of one language."""
    any_ = "(?i)" + "|".join(f"(?:{c.regex.removeprefix('(?i)')})" for c in rows)
    some = lines.where(language == rows[0].language).where(F.col("text").rlike(any_))
    found = []
    for kind in kinds:
        of, first = [c for c in rows if c.kind == kind], F.lit(None).cast("struct<kind:string,command:string,regex:string>")
        for c in reversed(of):
            first = F.when(F.col("text").rlike(c.regex), F.struct(F.lit(kind).alias("kind"), F.lit(c.command).alias("command"), F.lit(c.regex).alias("regex"))).otherwise(first)
        if of:
            found.append(first)
    each = some.select(*lines.columns, F.explode(F.filter(F.array(*found), lambda m: m.isNotNull())).alias("_m"))
    group = lambda i: F.call_function("regexp_extract", F.col("text"), F.col("_m.regex"), F.lit(i))
    path = F.coalesce(F.nullif(group(1), F.lit("")), group(2))
    return each.select(*lines.columns, "_m.kind", "_m.command", path.alias("raw_path"))


def line_events(lines: DataFrame, language: Column, kinds: tuple[str, ...] = ("read", "write", "erase", "call"), catalog: list[Command] = CATALOG) -> DataFrame:
    """The columns of lines (one of them ``text``) with kind, command and raw_path: the first match of each kind in each line. No shuffle, no Python.

    A line that holds no command of its language is dropped by one pattern; NULL texts and unknown languages give nothing.
    """
    out = None
    for lang in dict.fromkeys(c.language for c in catalog):
        rows = [c for c in catalog if c.language == lang and c.kind in kinds]
        if rows:
            of = _branch(lines, language, rows, kinds)
            out = of if out is None else out.unionByName(of)
    return out


def split_lines(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """(keep, line, text): the lines from 1 of each text; CRLF and CR end lines like LF. NULL texts give none."""
    at = F.posexplode(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"))
    return docs.where(F.col(text).isNotNull()).select(*keep, at.alias("_i", "text")).select(*keep, (F.col("_i") + 1).alias("line"), "text")

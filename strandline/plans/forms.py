"""Queries over small inputs of their own, whose expected rows are written out: what single commands, scripts, headers and paths come to.

Their SQL lists the expected rows, so a pattern or a reader that changes its mind doesn't agree with itself.
"""

from __future__ import annotations

import dataclasses
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import config as cfg
from strandline.functions import paths
from strandline.operators import catalog, exclusions, sections
from strandline.plans import pipeline
from strandline.plans.lineage import query
from strandline.resolve import run
from strandline.sinks import text


def _values(rows: list[tuple], names: str) -> str:
    """SQL of a list of rows."""

    def literal(v: object) -> str:
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") t({names})"


# E: a line of source for each command, and what it gives: kind, command, path

_STATA = """
use "in/a.dta", clear => read use in/a.dta
use in/b.dta => read use in/b.dta
import delimited using "in/a.csv", clear => read import in/a.csv
import excel "in/a.xlsx", firstrow => read import in/a.xlsx
insheet using "in/old.csv" => read insheet in/old.csv
append using "in/more.dta" => read append in/more.dta
merge 1:1 id using "in/m.dta", nogen => read merge in/m.dta
cross using "in/c.dta" => read cross in/c.dta
save "out/s.dta", replace => write save out/s.dta
export delimited using "out/e.csv" => write export_delimited out/e.csv
export excel using "out/e.xlsx" => write export_excel out/e.xlsx
graph export "out/g.png" => write graph_export out/g.png
estimates save "out/m.ster" => write save out/m.ster
putexcel set "out/p.xlsx" => write putexcel_set out/p.xlsx
outsheet using "out/o.csv" => write outsheet out/o.csv
log using "out/l.log", replace => write log_using out/l.log
esttab m1 m2 using "out/t.tex" => write esttab out/t.tex
outreg2 using "out/r.doc" => write outreg2 out/r.doc
erase "out/s.dta" => erase erase out/s.dta
do "code/b.do" => call do code/b.do
"""
_PYTHON = """
d = pd.read_csv("in/a.csv") => read read_csv in/a.csv
d = pd.read_excel('in/a.xlsx') => read read_excel in/a.xlsx
d = pandas.read_parquet("in/a.parquet") => read read_parquet in/a.parquet
d = pd.read_stata("in/a.dta") => read read_stata in/a.dta
d = pd.read_json("in/a.json") => read read_json in/a.json
d = pd.read_feather("in/a.feather") => read read_feather in/a.feather
d = pd.read_table("in/a.tsv") => read read_table in/a.tsv
d = pd.read_hdf("in/a.h5") => read read_hdf in/a.h5
d = pd.read_pickle("in/a.pkl") => read read_pickle in/a.pkl
d = pd.read_orc("in/a.orc") => read read_orc in/a.orc
x = np.load("in/a.npy") => read np_load in/a.npy
x = np.loadtxt("in/a.txt") => read np_loadtxt in/a.txt
x = numpy.genfromtxt("in/b.txt") => read np_genfromtxt in/b.txt
g = gpd.read_file("in/a.shp") => read gpd_read_file in/a.shp
t = open("in/t.txt").read() => read open_read in/t.txt
t = open("in/t.txt", encoding="utf-8").read() => read open_read in/t.txt
j = json.load(open("in/c.json")) => read open_read in/c.json
p = pickle.load(open("in/c.pkl", "rb")) => read open_read in/c.pkl
m = joblib.load("in/m.pkl") => read joblib_load in/m.pkl
runpy.run_path("code/b.py") => read runpy code/b.py
d.to_csv("out/a.csv") => write to_csv out/a.csv
d.to_excel("out/a.xlsx") => write to_excel out/a.xlsx
d.to_parquet("out/a.parquet") => write to_parquet out/a.parquet
d.to_stata("out/a.dta") => write to_stata out/a.dta
d.to_json("out/a.json") => write to_json out/a.json
d.to_feather("out/a.feather") => write to_feather out/a.feather
d.to_hdf("out/a.h5") => write to_hdf out/a.h5
d.to_pickle("out/a.pkl") => write to_pickle out/a.pkl
d.to_orc("out/a.orc") => write to_orc out/a.orc
g.to_file("out/a.shp") => write to_file out/a.shp
plt.savefig("out/f.png") => write savefig out/f.png
np.save("out/a.npy", x) => write np_save out/a.npy
np.savetxt("out/a.txt", x) => write np_savetxt out/a.txt
np.savez("out/a.npz", x) => write np_savez out/a.npz
np.savez_compressed("out/b.npz", x) => write np_savez_compressed out/b.npz
pickle.dump(x, open("out/a.pkl", "wb")) => write pickle_dump out/a.pkl
json.dump(x, open("out/a.json", "w")) => write json_dump out/a.json
f = open("out/t.txt", "w") => write open_write out/t.txt
joblib.dump(m, "out/m.pkl") => write joblib_dump out/m.pkl
image.save("out/i.png") => write save_method out/i.png
Path("out/w.txt").write_text("x") => write write_text out/w.txt
Path("out/w.bin").write_bytes(b) => write write_bytes out/w.bin
"""
_R = """
d <- read.csv("in/a.csv") => read read_csv in/a.csv
d <- read.csv2("in/a2.csv") => read read_csv2 in/a2.csv
d <- read.table("in/a.txt") => read read_table in/a.txt
d <- read.delim("in/a.tab") => read read_delim in/a.tab
d <- readRDS("in/a.rds") => read readRDS in/a.rds
d <- readRDS(file = "in/b.rds") => read readRDS in/b.rds
load("in/a.RData") => read load in/a.RData
d <- read_csv('in/r.csv') => read read_csv_readr in/r.csv
d <- read_csv2("in/r2.csv") => read read_csv2_readr in/r2.csv
d <- read_delim("in/r.txt") => read read_delim_readr in/r.txt
d <- read_rds("in/r.rds") => read read_rds in/r.rds
d <- read_tsv("in/r.tsv") => read read_tsv in/r.tsv
d <- read_excel("in/x.xls") => read read_excel in/x.xls
d <- read_xls("in/x1.xls") => read read_xls in/x1.xls
d <- read_xlsx("in/x2.xlsx") => read read_xlsx in/x2.xlsx
d <- haven::read_dta("in/h.dta") => read read_dta in/h.dta
d <- read_sas("in/h.sas7bdat") => read read_sas in/h.sas7bdat
d <- read_spss("in/h.sav") => read read_spss in/h.sav
d <- read_sav("in/h2.sav") => read read_sav in/h2.sav
d <- fread("in/f.csv") => read fread in/f.csv
d <- read_parquet("in/p.parquet") => read read_parquet in/p.parquet
d <- read_feather("in/p.feather") => read read_feather in/p.feather
d <- fromJSON("in/j.json") => read fromJSON in/j.json
d <- st_read("in/s.shp") => read st_read in/s.shp
d <- sf::st_read("in/s2.shp") => read st_read in/s2.shp
d <- read_html("in/h.html") => read read_html in/h.html
d <- read.xlsx("in/o.xlsx") => read read.xlsx in/o.xlsx
w <- loadWorkbook("in/w.xlsx") => read loadWorkbook in/w.xlsx
d <- read.fst("in/f.fst") => read read.fst in/f.fst
d <- read_fst("in/g.fst") => read read_fst in/g.fst
write.csv(d, "out/a.csv") => write write_csv out/a.csv
write.csv2(d, "out/a2.csv") => write write_csv2 out/a2.csv
write.table(d, "out/a.txt") => write write_table out/a.txt
saveRDS(d, "out/a.rds") => write saveRDS out/a.rds
saveRDS(d, file = "out/b.rds") => write saveRDS_kw out/b.rds
write_csv(d, "out/r.csv") => write write_csv_readr out/r.csv
write_csv2(d, "out/r2.csv") => write write_csv2_readr out/r2.csv
write_tsv(d, "out/r.tsv") => write write_tsv out/r.tsv
write_delim(d, "out/r.txt") => write write_delim out/r.txt
write_rds(d, "out/r.rds") => write write_rds out/r.rds
write_xlsx(d, "out/x.xlsx") => write write_xlsx out/x.xlsx
write_xlsx(d, path = "out/x2.xlsx") => write write_xlsx_kw out/x2.xlsx
fwrite(d, "out/f.csv") => write fwrite out/f.csv
write_dta(d, "out/h.dta") => write write_dta out/h.dta
write_sav(d, "out/h.sav") => write write_sav out/h.sav
write_sas(d, "out/h.sas7bdat") => write write_sas out/h.sas7bdat
write_parquet(d, "out/p.parquet") => write write_parquet out/p.parquet
write_parquet(d, sink = "out/p2.parquet") => write write_parquet_kw out/p2.parquet
write_feather(d, "out/p.feather") => write write_feather out/p.feather
st_write(d, "out/s.shp") => write st_write out/s.shp
tmap_save(m, "out/m.png") => write tmap_save out/m.png
tmap_save(m, filename = "out/m2.png") => write tmap_save_kw out/m2.png
saveWidget(w, "out/w.html") => write saveWidget out/w.html
saveWidget(w, file = "out/w2.html") => write saveWidget_kw out/w2.html
writeLines(x, "out/l.txt") => write writeLines out/l.txt
writeLines(x, con = "out/l2.txt") => write writeLines_kw out/l2.txt
write.xlsx(d, "out/o.xlsx") => write write.xlsx out/o.xlsx
saveWorkbook(w, "out/w.xlsx") => write saveWorkbook out/w.xlsx
write.fst(d, "out/f.fst") => write write.fst out/f.fst
save(d, file = "out/d.RData") => write save_rdata out/d.RData
ggsave("out/g.png", p) => write ggsave out/g.png
ggsave(plot = p, filename = "out/g2.png") => write ggsave_kw out/g2.png
pdf("out/p.pdf") => write pdf out/p.pdf
png(filename = "out/p.png") => write png_kw out/p.png
svg("out/p.svg") => write svg out/p.svg
jpeg("out/p.jpg") => write jpeg out/p.jpg
tiff(filename = "out/p.tiff") => write tiff_kw out/p.tiff
write_json(x, "out/j.json") => write write_json out/j.json
toJSON(x, path = "out/j2.json") => write toJSON_write out/j2.json
cat("done", file = "out/c.txt") => write cat_file out/c.txt
message("done", file = "out/m.txt") => write message_file out/m.txt
source("code/u.R") => call source code/u.R
sys.source("code/v.R", env) => call source code/v.R
"""
_FORMS = [(lang, i, *line.split(" => ")) for lang, block in (("stata", _STATA), ("python", _PYTHON), ("r", _R)) for i, line in enumerate(block.strip().split("\n"), 1)]


@query(_values([(lang, i, *said.split(" ")) for lang, i, _, said in _FORMS], "language, line, kind, command, raw_path"))
def e02_command_forms(spark: SparkSession, sf: str) -> DataFrame:
    """One line of source for each command of the three languages."""
    lines = spark.createDataFrame([(lang, i, source) for lang, i, source, _ in _FORMS], "language string, line int, text string")
    return catalog.line_events(lines, F.col("language")).select("language", "line", "kind", "command", "raw_path")


# F: scripts that run each other

_SCRIPTS = {
    "s/master.do": """global root "data"
global out ${root}/clean
do "s/child.do"
""",
    "s/child.do": """use "${root}/raw.dta"
local ys 2001 2002
foreach y of local ys {
merge 1:1 id using "add_`y'.dta"
}
forvalues i = 1/2 {
save "${out}/p_`i'.dta"
}
append ///
  using "more.dta"
local t = substr("x", 1)
save "`t'.dta"
save "`nope'/q.dta"
use "`c(pwd)'/w.dta"
local a x1 x2
local b `a'
local c `b'
local d `c'
local e `d'
use "d/`e'.dta"
local f `f'y
use "f/`f'.dta"
do "s/grand.do"
""",
    "s/grand.do": """use "$out/g.dta"
""",
    "p/conf.py": """DATA = "data"
NAME = "x"
""",
    "p/tool.py": """x = 1
""",
    "p/a.py": """import os, subprocess
import pandas as panda
from p.conf import DATA as D, NAME
BASE = os.path.join(D, "raw")
f = BASE + "/" + NAME + ".csv"
df = panda.read_csv(f)
df.to_csv(f"out/{NAME}.csv")
for n in os.listdir("in"):
    ok = n.endswith(".pkl")
for r, d, fs in os.walk("deep"):
    pass
q = "cfg.json"
with open(q, "r") as g:
    pass
export(df, output_path="rep/e.html")
plot = f"fig/p_{k}.png"
other = f"in/s_{k}.csv"
df.style.to_latex(); json.dump(df, handle); target = f"in/t_{k}.csv"
subprocess.run(["python", "p/tool.py"])
one = panda.read_csv(os.path.join("/abs/else", "one.csv"))
places = {"raw": "data/raw", "out": "data/out"}
two = panda.read_csv(places["raw"] + "/two.csv")
note = f"not a path {k}.txt"
""",
    "r/m.R": """base <- "data"
source("r/u.R")
d <- read_csv(file.path(base,
  "a.csv"))  # not "b.csv"
fs <- list.files("in", pattern = "\\\\.csv$")
render_it(d, output = "rep/r.html")
ggsave(paste0(base, "/f.png"))
saveRDS(d, file = glue("{base}/g.rds"))
write_csv(d, file.path(unknown, "h.csv"))
""",
    "r/u.R": """x <- readRDS(file.path(base, "u.rds"))
""",
}
_EVENTS = [
    ("s/child.do", 1, "use", "data/raw.dta", "full", False),
    ("s/child.do", 4, "merge", "add_2001.dta", "full", False),
    ("s/child.do", 4, "merge", "add_2002.dta", "full", False),
    ("s/child.do", 7, "save", "data/clean/p_1.dta", "full", True),
    ("s/child.do", 7, "save", "data/clean/p_2.dta", "full", True),
    ("s/child.do", 9, "append", "more.dta", "full", False),
    ("s/child.do", 11, "save", "{dynamic}.dta", "partial", True),
    ("s/child.do", 12, "save", "{nope}/q.dta", "partial", True),
    ("s/child.do", 13, "use", "w.dta", "full", False),
    ("s/child.do", 19, "use", "d/x1.dta", "full", False),
    ("s/child.do", 19, "use", "d/x2.dta", "full", False),
    ("s/child.do", 21, "use", "f/{f}y.dta", "partial", False),
    ("s/grand.do", 1, "use", "data/clean/g.dta", "full", False),
    ("p/a.py", 6, "read_csv", "data/raw/x.csv", "full", False),
    ("p/a.py", 7, "to_csv", "out/x.csv", "full", True),
    ("p/a.py", 8, "open_read", "in/*.pkl", "full", False),
    ("p/a.py", 10, "os_walk", "deep/**/*", "full", False),
    ("p/a.py", 13, "open_read", "cfg.json", "full", False),
    ("p/a.py", 15, "kwarg_write", "rep/e.html", "full", True),
    ("p/a.py", 16, "fstring_path", "fig/p_*.png", "full", True),
    ("p/a.py", 17, "fstring_path", "in/s_*.csv", "full", False),
    ("p/a.py", 18, "fstring_path", "in/t_*.csv", "full", True),
    ("p/a.py", 20, "read_csv", "data/one.csv", "full", False),
    ("p/a.py", 22, "read_csv", "data/raw/two.csv", "full", False),
    ("r/m.R", 3, "read_csv_readr", "data/a.csv", "full", False),
    ("r/m.R", 5, "list_files", "in/*.csv", "full", False),
    ("r/m.R", 6, "inferred_kwarg", "rep/r.html", "full", True),
    ("r/m.R", 7, "ggsave", "data/f.png", "full", True),
    ("r/m.R", 8, "saveRDS_kw", "data/g.rds", "full", True),
    ("r/m.R", 9, "write_csv_readr", "{unknown}/h.csv", "partial", True),
    ("r/u.R", 1, "readRDS", "data/u.rds", "full", False),
]
_CALLS = [("s/master.do", "s/child.do", 3), ("s/child.do", "s/grand.do", 22), ("p/a.py", "p/conf.py", 3), ("p/a.py", "p/tool.py", 19), ("r/m.R", "r/u.R", 2)]


def _resolved(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    lang = {"do": "stata", "py": "python", "R": "r"}
    scripts = spark.createDataFrame([(s, lang[s.rsplit(".", 1)[-1]], text.encode()) for s, text in _SCRIPTS.items()], "script string, language string, content binary")
    files = spark.createDataFrame([(s,) for s in [*_SCRIPTS, "data/one.csv"]], "path string")
    return run.resolve(scripts, files, "/srv/p", cfg.Config())


@query(_values(_EVENTS, "script, line, command, path, status, is_write"))
def f00_script_events(spark: SparkSession, sf: str) -> DataFrame:
    """The accesses of scripts in three languages, with the values that they inherit from each other over several levels."""
    rows = _resolved(spark)[0].where("kind = 'event'")
    return rows.select("script", "line", "command", F.explode("normalized_paths").alias("path"), F.col("resolution_status").alias("status"), "is_write")


@query(_values(_CALLS, "script, child, line"))
def f22_script_calls(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark)[1].select("script", "child", "line")


# O: scripts with headers of every form, and the sections they have: line, level, title

_HEADED = {
    "stata": """* Table of contents
* 1. Old
* 2. Older

use x
* 1. Load data
* -- 1.2 Clean --
// 1.2.3 Deep
/* ===== Tables ===== */
*** Results ***
* just a remark
*** Results ***
***********
""",
    "python": """# %% Load
# In[3]:
# %%
## 2.1 Model
# ---- 3. Plot ----
# ===== Wrap Up =====
    # --- Inner step ---
# %%time
# -----------
""",
    "r": """# Load ----
## 1.2 Clean
# ==== Model ====
## [1] 0.5
# plain remark
""",
}
_SECTIONS = [
    ("stata", 6, 1, "1. Load data"),
    ("stata", 7, 2, "1.2 Clean"),
    ("stata", 8, 3, "1.2.3 Deep"),
    ("stata", 9, 1, "Tables"),
    ("stata", 12, 1, "Results"),
    ("python", 1, 1, "Load"),
    ("python", 2, 1, "In[3]:"),
    ("python", 3, 1, "(untitled cell)"),
    ("python", 4, 2, "2.1 Model"),
    ("python", 5, 1, "3. Plot"),
    ("python", 6, 1, "Wrap Up"),
    ("r", 1, 1, "Load"),
    ("r", 2, 2, "1.2 Clean"),
    ("r", 3, 1, "Model"),
]


@query(_values(_SECTIONS, "script, line, level, title"))
def o02_headers(spark: SparkSession, sf: str) -> DataFrame:
    """The sections of scripts with headers of every form, decoration, a table of contents and a title that repeats."""
    docs = spark.createDataFrame([(k, k, v) for k, v in _HEADED.items()], "script string, language string, text string")
    return sections.sections(docs, ["script"], F.col("language"))


# C: path functions: function, input, result

_ROOT = "/home/u/proj"
_PATHS = {
    "normalize": [(" \"a\\b//c/../d.csv\" ", "a/b/d.csv"), ("'./x.dta'", "x.dta"), ("../up/./y", "../up/y"), ("/a/../../b", "/b"), ("", ".")],
    "absolute": [("/a/b", "true"), ("C:\\a", "true"), ("\\\\host\\a", "true"), ("a/b", "false"), ("./a", "false")],
    "absolute_base": [("/one.csv", "false"), ("/a/one.csv", "true"), ("D:/a", "true"), ("a/b", "false")],
    "joined": [("", "raw/x.csv"), (".", "raw/x.csv"), ("data", "data/raw/x.csv"), ("data/", "data/raw/x.csv"), ("./data/..", "raw/x.csv")],
    "to_marker": [("/mnt/share/proj/data/x.csv", "data/x.csv"), ("/mnt/share/proj", "."), ("/mnt/other/x.csv", None)],
    "relative": [("/home/u/proj/data/x.csv", "data/x.csv"), ("proj/a.do", "a.do"), ("/other/z.csv", "../../../other/z.csv"), ("./q.csv", "q.csv"), ("$data/k.csv", "data/k.csv")],
    "folded": [("Data/X.CSV", "data/x.csv"), ("/home/u/proj/A.do", "a.do")],
    "module": [("a.b.c", "a/b/c.py"), ("util", "util.py")],
    "external": [("https://x.org/a.csv", "true"), ("s3://bucket/a", "true"), ("data/a.csv", "false")],
    "yaml": [('say "x"', '"say \\"x\\""'), ("a\\b", '"a\\\\b"')],
    "family": [("d/panel_v12.dta", "d/panel.dta"), ("d/panel_QC.dta", "d/panel.dta"), ("d/panel_v1.2.dta", None), ("d/panel.dta", None)],
    "bare": [("../..", "true"), (".", "true"), ("./../", "true"), ("a/..", "false"), ("a/b", "false")],
    "excluded": [("docs/keep/exact.csv", "true"), ("docs/keep/exact.csv.gz", "false"), ("viewer_output/a.html", "true"), ("a/archive/b.csv", "true"), ("archive.csv", "false"), ("x/y.bak", "true"), (".git/config", "true"), ("pre/fix/a", "true"), ("prefix/a", "false"), ("a/named.csv", "true")],
}


def _function(name: str, c):
    named = cfg.Normalization(path_prefix_aliases={"$data": "data"}, project_root_markers=["share/proj"])
    rules = cfg.Exclusions(exact_paths=["docs/keep/exact.csv"], prefixes=["pre/"], exact_names=["named.csv"])
    return {
        "normalize": paths.normalize_token, "absolute": paths.is_absolute, "absolute_base": paths.is_absolute_base, "joined": lambda x: paths.join_relative(x, F.lit("raw/x.csv")),
        "to_marker": lambda x: paths.strip_to_marker(x, ["share/proj"]), "relative": lambda x: paths.to_project_relative(x, _ROOT, named)["value"],
        "folded": lambda x: paths.to_project_relative(x, _ROOT, cfg.Normalization(fold_case=True))["value"], "module": paths.module_path, "external": paths.is_external,
        "yaml": paths.yaml_quote, "family": paths.family_key, "bare": paths.is_bare_directory, "excluded": lambda x: exclusions.excluded(x, rules),
    }[name](c)


@query(_values([(f, a, b) for f, cases in _PATHS.items() for a, b in cases], "function, input, result"))
def c00_path_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Path functions and exclusion rules, by function."""
    out = None
    for f, cases in _PATHS.items():
        df = spark.createDataFrame([(a,) for a, _ in cases], "input string").select(F.lit(f).alias("function"), "input", _function(f, F.col("input")).cast("string").alias("result"))
        out = df if out is None else out.unionByName(df)
    return out


# whole small graphs: what is drawn, written and said about them


def _graph(spark: SparkSession, with_edges: bool = True) -> pipeline.LineageGraph:
    nodes = [
        ("a.py", "script", "a.py", "script", "c1"),
        ("b.R", "script", "b.R", "script", "c2"),
        ("z.do", "script", "z.do", "script", None),
        ("in/x.csv", "artifact", "in/x.csv", "reference_input", None),
        ("mid/y.rds", "artifact", "mid/y.rds", "intermediate", "c1"),
        ("out/{k}.png", "artifact_placeholder", None, "placeholder_artifact", None),
    ]
    edges = [(1, "in/x.csv", "a.py", "read_csv"), (2, "a.py", "mid/y.rds", "to_rds"), (3, "mid/y.rds", "b.R", "readRDS"), (4, "b.R", "out/{k}.png", "ggsave"), (5, "z.do", "z.do", "manual"), (6, "a.py", "mid/y.rds", "to_rds")]
    clusters = [
        ("c1", "First", ["a.py", "mid/y.rds"], [], {"kind": "manual", "order": "2", "collapse": "false"}),
        ("c2", "Second", ["b.R"], [], {"kind": "manual", "order": "3", "collapse": "true"}),
        ("m", "Both", [], ["c1"], {"kind": "manual", "order": "1", "collapse": "false"}),
    ]
    files = [("a.py", "python", False), ("b.R", "r", False), ("in", None, True), ("in/x.csv", "input", False), ("old/", "excluded", True), ("q.bak", "excluded", False)]
    diagnostics = [("warning", "absolute_path_usage", f"Absolute path {i}", {"script": "a.py", "path": f"/abs/{i}"}) for i in (1, 2, 2)]
    return pipeline.LineageGraph(
        spark, "/srv/p",
        spark.createDataFrame([(n, n.rsplit("/", 1)[-1], t, p, r, c) for n, t, p, r, c in nodes], "node_id string, label string, node_type string, path string, role string, cluster_id string"),
        spark.createDataFrame([(i, a, b, o, "k", o) for i, a, b, o in (edges if with_edges else [])], "edge_ord long, source string, target string, operation string, kind string, visible_label string"),
        spark.createDataFrame(diagnostics, pipeline.DIAGNOSTICS), spark.createDataFrame(clusters, pipeline.CLUSTERS),
        spark.createDataFrame([(*f, None) for f in files], "path string, category string, is_dir boolean, mtime timestamp"), {"rankdir": "TB"},
    )


_DRAWING = """digraph pipeline {
  rankdir=TB;
  subgraph "cluster_m" {
    label="Both";
    subgraph "cluster_c1" {
      label="First";
      "a.py" [label="a.py", shape=box]
      "mid/y.rds" [label="y.rds", shape=note]
    }
  }
  "cluster::c2" [label="Second", shape=folder];
  "in/x.csv" [label="x.csv", shape=note]
  "out/{k}.png" [label="{k}.png", shape=note, style="dashed"]
  "z.do" [label="z.do", shape=box]
  subgraph "position::unclustered_artifacts" {
    rank="min";
    "in/x.csv";
    "out/{k}.png";
  }
  "in/x.csv" -> "a.py" [label="read_csv"];
  "a.py" -> "mid/y.rds" [label="to_rds"];
  "mid/y.rds" -> "cluster::c2" [label="readRDS"];
  "cluster::c2" -> "out/{k}.png" [label="ggsave"];
  "z.do" -> "z.do" [label="manual", comment="self-loop"];
  "a.py" -> "cluster::c2";
}"""
_YAML = """clusters:
  - id: "m"
    label: "Both"
    member_cluster_ids:
      - "c1"
    order: 1
    collapse: false
  - id: "c1"
    label: "First"
    members:
      - "a.py"
    order: 2
    collapse: false
  - id: "c2"
    label: "Second"
    members:
      - "b.R"
    order: 3
    collapse: true"""
_SUMMARY = """Project root: /srv/p
Nodes: 6 (scripts=3, artifacts=2)
Edges: 6
Clusters: 3
Diagnostics: 3
Config effects:
- View: overview
- Excluded paths: 2
- Exclusion presets: generated_outputs,archival_folders,python_runtime
- [warning] absolute_path_usage: Absolute path 1
- [warning] absolute_path_usage: Absolute path 2
- [warning] absolute_path_usage: Absolute path 2"""
_EDGE_CSV = "source,target,command,kind\nin/x.csv,a.py,read_csv,k\na.py,mid/y.rds,to_rds,k\nmid/y.rds,b.R,readRDS,k\nb.R,out/{k}.png,ggsave,k\nz.do,z.do,manual,k\na.py,mid/y.rds,to_rds,k"
_TEXTS = {"drawing": _DRAWING, "clusters": _YAML, "summary": _SUMMARY, "edges": _EDGE_CSV}


@query(_values([(name, i, line) for name, t in _TEXTS.items() for i, line in enumerate(t.split("\n"), 1)], "text, line, said"))
def b04_texts(spark: SparkSession, sf: str) -> DataFrame:
    """A graph with clusters in clusters, one of them collapsed, as drawing (without colours), cluster definitions, summary and edge list."""
    g = _graph(spark)
    config = cfg.Config()
    config.display.show_edge_labels = True
    config.layout.unclustered_artifacts_position = "left"
    plain = re.sub(r', fillcolor="#\w+"(, style="dashed")?\];', r"\1]", text.dot(g, config))
    plain = "\n".join(x for x in plain.split("\n") if not x.startswith(("  graph [", "  node [", "  edge [")))
    made = {"drawing": plain, "clusters": text.cluster_yaml(g), "summary": text.summary(g, config), "edges": text.edge_csv(g.edges)}
    return spark.createDataFrame([(name, i, line) for name, t in made.items() for i, line in enumerate(t.rstrip("\r\n").splitlines(), 1)], "text string, line int, said string")


_SAID = [
    ("layout", "warning", "invalid_layout_rankdir", 1),
    ("layout", "warning", "invalid_unclustered_artifacts_position", 1),
    ("scan", "info", "project_scan", 1),
    ("scan", "info", "excluded_files", 1),
    ("scan", "info", "display_option_irrelevant", 1),
    ("scan", "info", "exclusion_defaults_not_inherited", 1),
    ("clusters", "warning", "cluster_member_not_found", 1),
    ("clusters", "warning", "duplicate_manual_cluster_id", 1),
    ("clusters", "warning", "meta_cluster_cycle", 1),
    ("clusters", "warning", "meta_cluster_unknown_ref", 1),
    ("clusters", "info", "manual_clusters_applied", 1),
    ("validated", "warning", "absolute_path_usage", 1),
    ("validated", "info", "excluded_path_inventory", 1),
    ("validated", "warning", "empty_graph", 1),
    ("validated", "info", "orphan_artifact", 3),
    ("validated", "warning", "orphan_node", 6),
    ("validated", "warning", "missing_referenced_file", 2),
]


@query(_values(_SAID, "step, level, code, n"))
def l01_said(spark: SparkSession, sf: str) -> DataFrame:
    """How often each step of a build says what, about a small graph and a configuration with mistakes."""
    g = dataclasses.replace(_graph(spark, with_edges=False))
    none = dataclasses.replace(g, diagnostics=g.diagnostics.where("false"))
    config = cfg.Config()
    config.layout.rankdir, config.layout.unclustered_artifacts_position = "XX", "middle"
    config.display.view, config.display.show_terminal_outputs = "scripts_only", False
    config.exclusions.presets = []
    config.clusters = [cfg.ManualCluster("n1", "N", ["z.do", "y.do"]), cfg.ManualCluster("n1", "N2", ["z.do"]), cfg.ManualCluster("n2", "M", [], ["n3"]), cfg.ManualCluster("n3", "O", [], ["n2", "n9"])]
    steps = {"layout": pipeline._layout(none, config), "scan": pipeline._scan_facts(none, config), "clusters": pipeline._manual_clusters(none, config), "validated": pipeline.validated(g)}
    rows = [step_of.diagnostics.groupBy("level", "code").agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), "level", "code", "n") for step, step_of in steps.items()]
    return reduce(DataFrame.unionByName, rows)

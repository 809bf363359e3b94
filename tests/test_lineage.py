"""Readers, pipeline, graph algorithms, exclusions, overrides, sinks on small fixtures."""

import difflib
import json
import posixpath
import random

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline import cli
from strandline.config import Config, Display, Exclusions, ManualCluster, ManualEdge, Normalization, VersionFamilies, load_config
from strandline.functions import paths
from strandline.operators import exclusions, graph, overrides, render, sections, validate, versions
from strandline.plans import pipeline, registry
from strandline.resolve import python, r, run, stata
from strandline.resolve.common import Context, normalize
from strandline.sinks import text


def _events(rows):
    return [(x["command"], x["normalized_paths"], x["resolution_status"]) for x in rows if x["kind"] == "event"]


# path functions


@given(st.text(alphabet="ab.\\/", max_size=24))
def test_normalize_twice_is_once(t):
    assert normalize(normalize(t)) == normalize(t)


def test_column_normalisation_equals_posix(spark):
    rnd = random.Random(2)
    texts = sorted({"/".join(rnd.choice(["a", "b.c", "..", ".", "", "\\", '"', "'", " "]) for _ in range(rnd.randint(0, 6))) for _ in range(400)})
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = {x.t: x.n for x in df.select("t", paths.normalize_token(F.col("t")).alias("n")).collect()}
    assert got.pop(None) is None
    assert got == {t: normalize(t) for t in texts}


def test_project_relative(spark):
    config = Normalization(path_prefix_aliases={"$data": "data"}, project_root_markers=["share/proj"])
    cases = {"/home/u/proj/data/x.csv": ("data/x.csv", True), "proj/a.do": ("a.do", False), "C:\\w\\proj\\b.dta": ("b.dta", True), "/other/z.csv": ("../../../other/z.csv", True), "./q.csv": ("q.csv", False), "$data/k.csv": ("data/k.csv", False), "/mnt/share/proj/a\r;\nb.csv": ("a\r;\nb.csv", True), "/mnt/share/proj/m.csv": ("m.csv", True)}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = {x.t: tuple(x.r) for x in df.select("t", paths.to_project_relative(F.col("t"), "/home/u/proj", config).alias("r")).collect()}
    assert got == cases
    c = Context("/home/u/proj", "code/a.py", config)
    assert {t: c.relative(t) for t in cases} == cases


def test_labels_and_keys(spark):
    one = spark.range(1)
    got = one.select(
        paths.family_key(F.lit("a/p_V2.dta")).alias("a"), paths.family_key(F.lit("a/p_v1.2.dta")).alias("b"), paths.dir_distance(F.lit("a/b/c"), F.lit("a/d")).alias("c"), paths.cluster_label(F.array(F.lit("a/b"), F.lit("a/c"))).alias("d"),
        paths.cluster_label(F.array(F.lit(""))).alias("e"), paths.xml_escape(F.lit("a<é😀")).alias("f"), paths.yaml_quote(F.lit('x"\\')).alias("g"), paths.label(F.lit("a/b/c.py"), depth=1, show_extension=False).alias("h"), paths.module_path(F.lit("a.b")).alias("i"),
        paths.cluster_label(F.array(F.lit("a"), F.lit("b"))).alias("j"), paths.common_prefix(F.array(F.lit("a/b/c"), F.lit("a/b"))).alias("k"), paths.is_absolute_base(F.lit("/x.csv")).alias("l"), paths.is_external(F.lit("s3://b/k")).alias("m"),
    ).first()
    assert tuple(got) == ("a/p.dta", None, 3, "a / chain", ".", "a&lt;&#233;&#128512;", '"x\\"\\\\"', "b/c", "a/b.py", "Pipeline stage", "a/b", False, True)


def _table(spark, folder, name, schema, rows):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_texts_beyond_ascii_have_rows(spark, tmp_path):
    _table(spark, tmp_path, "nodes", "node_row_id long, project_id long, path string", [(1, 1, "\u00a0./größe\\ñ.csv\u2003"), (2, 1, "./a.csv"), (3, 1, None)])
    _table(spark, tmp_path, "diagnostics", "project_id long, message string", [(1, 'ß<"\\😀'), (1, "a&b"), (1, None)])
    got = registry.QUERIES["c16_manual_paths"](spark, str(tmp_path)).collect()
    assert {x.path: x.cleaned for x in got} == {"\u00a0./größe\\ñ.csv\u2003": "größe/ñ.csv", "./a.csv": "a.csv"}
    got = registry.QUERIES["c23_escaped"](spark, str(tmp_path)).collect()
    assert {(x.message, x.escaped, x.quoted) for x in got} == {('ß<"\\😀', '&#223;&lt;"\\&#128512;', '"ß<\\"\\\\😀"'), ("a&b", "a&amp;b", '"a&b"')}


def test_exclusion_rules(spark):
    rules = Exclusions(prefixes=["gen/"], globs=["*.tmp", "x/*.py"], exact_names=["secret.csv"], folder_names=["skip"], paths=["one/file.do", "dir/"], presets=["archival_folders"])
    cases = {"gen": True, "gen/a": True, "generated/a": False, "a/b.tmp": True, "q/x/m.py": True, "q/x/y/m.py": False, "d/secret.csv": True, "a/skip/f": True, "a/skip": False, "a/skip/": True, "one/file.do": True, "dir/k": True, "old/a": True, "a.bak": True, "ok/a.py": False}
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    assert {x.p: x.e for x in df.select("p", exclusions.excluded(F.col("p"), rules).alias("e")).collect()} == cases
    with pytest.raises(ValueError, match="Unknown exclusion preset"):
        Exclusions(presets=["nope"]).resolved()


def test_paths_that_need_folding_have_verdicts(spark, tmp_path):
    cases = {"./prj_hub/tmp/a.csv": True, "prj_hub//tmp/": True, "a/./annex/b.csv": True, "a/annex": False, "a/annex/": True, "x/shared/./k//m.rds": True, ".//housing_v1.csv": True, "": False, "/": False, "./a/b.csv": False, "//old//a": True, "/./b.bak": True}
    _table(spark, tmp_path, "nodes", "node_row_id long, path string", [*enumerate(cases), (99, None)])
    got = {x.node_row_id: x.excluded for x in registry.QUERIES["d03_excluded"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(cases.values()))
    duckdb.execute(f"CREATE OR REPLACE TEMP VIEW nodes AS SELECT * FROM '{tmp_path}/nodes.parquet/*.parquet'")
    assert got == dict(duckdb.execute(registry.SQL["d03_excluded"]).fetchall())


# readers


def test_stata_reader():
    src = """global root "data"
global out ${root}/clean
local ys 2001 2002
local f = substr("x", 1)
do code/b.do
foreach y of local ys {
  use "${out}/p_`y'.dta"
}
forvalues i = 2/1 {
save "o`i'.dta", replace
}
merge 1:1 id ///
  using "m.dta"
save "`unknown'/q.dta"
global loop ${loop}x
use "$loop/a.dta"
erase "t.dta"
estimates save "e.ster"
"""
    rows = stata.parse(src, Context("/p", "code/a.do"))
    assert _events(rows) == [
        ("use", ["data/clean/p_2001.dta", "data/clean/p_2002.dta"], "full"),
        ("save", ["o2.dta", "o1.dta"], "full"),
        ("merge", ["m.dta"], "full"),
        ("save", ["{unknown}/q.dta"], "partial"),
        ("use", [rows[-3]["normalized_paths"][0]], "partial"),
        ("erase", ["t.dta"], "full"),
        ("save", ["e.ster"], "full"),
    ]
    assert [x["name"] for x in rows if x["kind"] == "child"] == ["code/b.do"]
    up = stata.parse('use "../raw/x.dta"', Context("/p", "code/a.do"))
    assert _events(up) == [("use", ["raw/x.dta"], "full")]
    assert not up[0]["was_absolute"]


def test_long_stata_loops_give_all_paths():
    src = """forvalues i = 1/101 {
forvalues j = 1/101 {
save "a_`i'_`j'.dta"
}
}
forvalues k = 10001/0 {
use "b_`k'.dta"
}
forvalues n = 1/1000000000000 {
use "c.dta"
}
"""
    a, b, c = _events(stata.parse(src, Context("/p", "code/a.do")))
    assert a == ("save", [f"a_{i}_{j}.dta" for i in range(1, 102) for j in range(1, 102)], "full")
    assert b == ("use", [f"b_{k}.dta" for k in range(10001, -1, -1)], "full")
    assert c == ("use", ["c.dta"], "full")


def test_python_reader():
    src = """import os, json
import pandas as pd
import numpy as np
from pathlib import Path
from lib.helper import BASE as B
ROOT = Path(__file__).resolve().parent.parent
OUT = ROOT / "out"
name = "n_%s.csv" % "7"
a = pd.read_csv(os.path.join(B, "a.csv"))
b = pd.read_parquet("s3://bucket/k.parquet")
a.to_csv(OUT / name)
np.save(OUT / "{}.npy".format("z"), a)
with open(OUT / "log.txt", "w") as f: f.write("x")
for fn in os.listdir("raw"):
    if fn.endswith(".pkl"):
        x = json.load(open("cfg/" + "c.json"))
export(a, output_path=f"out/{unknown}/e.csv")
"""
    rows = python.parse(src, Context("/p", "code/a.py", inherited={"B": "data"}))
    got = _events(rows)
    assert ("read_csv", ["data/a.csv"], "full") in got or ("read_csv", ["a.csv"], "full") in got
    assert ("to_csv", ["out/n_7.csv"], "full") in got
    assert ("np_save", ["out/z.npy"], "full") in got
    assert ("open_write", ["out/log.txt"], "full") in got
    assert ("open_read", ["raw/*.pkl"], "full") in got
    assert ("open_read", ["cfg/c.json"], "full") in got
    assert ("kwarg_write", ["out/*/e.csv"], "full") in got
    assert not any("bucket" in p for _, ps, _ in got for p in ps)
    assert any("lib/helper.py" in x["candidates"] for x in rows if x["kind"] == "child")
    broken = python.parse("print 'x'\ndf = pd.read_csv('a.csv')\ndf.to_csv('b.csv')\n", Context("/p", "a.py"))
    assert _events(broken) == [("read_csv", ["a.csv"], "full"), ("to_csv", ["b.csv"], "full")]


def test_python_names_of_modules_and_unique_files(spark, tmp_path):
    files = {
        "a.py": 'DIR = "from_a"\n',
        "lib/b.py": 'DIR = "from_b"\n',
        "c.py": 'from a import DIR as X\nfrom lib.b import DIR as Y\nimport os\nimport pandas as pd\npd.read_csv(os.path.join(X, "x.csv"))\npd.read_csv(os.path.join(Y, "y.csv"))\n',
        "d.py": 'import os\nimport pandas as pd\nBASE = "/abs/else"\npd.read_csv(os.path.join(BASE, "one.csv"))\npd.read_csv(os.path.join(BASE, "two.csv"))\npd.read_csv("/abs/other/one.csv")\n',
    }
    scripts = spark.createDataFrame([(k, "python", v.encode()) for k, v in files.items()], "script string, language string, content binary")
    tree = spark.createDataFrame([(p,) for p in [*files, "data/one.csv", "data/two.csv", "old/two.csv"]], "path string")
    rows, _ = run.resolve(scripts, tree, "/srv/p", Config())
    got = {(x.script, x.line): x.normalized_paths for x in rows.where("kind = 'event'").collect()}
    assert got == {("c.py", 5): ["from_a/x.csv"], ("c.py", 6): ["from_b/y.csv"], ("d.py", 4): ["data/one.csv"], ("d.py", 5): ["../../abs/else/two.csv"], ("d.py", 6): ["../../abs/other/one.csv"]}


def test_r_reader():
    src = """source("util.R")
root <- here::here("data")  # "x"
f <- file.path(root,
   "a.csv")
d <- read_csv(f)
e <- readRDS(file = paste0(root, "/e.rds"))
ggsave(sprintf("%s/fig_%d.png", out, 3), p)
d %>% write_csv("lost.csv")
write_csv(d, glue("{root}/g.csv"))
x <- list.files(root, pattern = "\\\\.csv$")
png(filename = "p.png")
"""
    rows = r.parse(src, Context("/p", "code/a.R"))
    got = _events(rows)
    assert ("read_csv_readr", ["data/a.csv"], "full") in got
    assert ("readRDS", ["data/e.rds"], "full") in got
    assert ("ggsave", ["{out}/fig_3.png"], "partial") in got
    assert ("write_csv_readr", ["data/g.csv"], "full") in got
    assert ("list_files", ["data/*.csv"], "full") in got
    assert ("png_kw", ["p.png"], "full") in got
    assert [x["candidates"] for x in rows if x["kind"] == "child"] == [["util.R", "code/util.R"]]


# graph algorithms


@pytest.mark.parametrize("in_one_task", [0, 1 << 20])
def test_components_against_union_find(spark, monkeypatch, in_one_task):
    monkeypatch.setattr(graph, "IN_ONE_TASK", in_one_task)
    rnd = random.Random(4)
    nodes = [f"n{i:02d}" for i in range(60)]
    links = [(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(35)] + [(f"c{i}", f"c{i + 1}") for i in range(30)]
    nodes += [f"c{i}" for i in range(31)]
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = graph.components(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(links, "a string, b string"))
    assert {x.node: x.component for x in got.collect()} == {n: find(n) for n in nodes}


@pytest.mark.parametrize("in_one_task", [0, 1 << 20])
def test_levels(spark, monkeypatch, in_one_task):
    monkeypatch.setattr(graph, "IN_ONE_TASK", in_one_task)
    rnd = random.Random(9)
    links = [(f"n{rnd.randrange(i)}", f"n{i}") for i in range(1, 50)] + [(f"n{rnd.randrange(i)}", f"n{i}") for i in range(20, 50)]
    links += [("c1", "c2"), ("c2", "c1"), ("c2", "t"), ("t", "u"), ("n3", "u"), ("z", "z")]
    nodes = sorted({x for link in links for x in link} | {"alone"})
    parents = {}
    for a, b in links:
        parents.setdefault(b, set()).add(a)

    def level(v, seen=()):
        if v in seen:
            return None
        got = [level(p, (*seen, v)) for p in parents.get(v, ())]
        return None if None in got else max(got, default=-1) + 1

    links += [("unknown", "alone"), ("n3", "unknown")]
    got = graph.levels(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(links, "parent string, child string"))
    assert {x.node: x.level for x in got.collect()} == {n: -1 if level(n) is None else level(n) for n in nodes}


@given(st.lists(st.integers(0, 30), min_size=1, max_size=8, unique=True), st.integers(0, 7), st.booleans())
def test_canonical_cycle_ignores_rotation_and_direction(cycle, k, turn):
    names = [f"{x:02d}" for x in cycle]
    k %= len(names)
    other = names[k:] + names[:k]
    assert graph.canonical_cycle(other[::-1] if turn else other) == graph.canonical_cycle(names)


@pytest.mark.parametrize("in_one_task", [0, 1 << 20])
def test_cycles(spark, monkeypatch, in_one_task):
    monkeypatch.setattr(graph, "IN_ONE_TASK", in_one_task)
    e = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "a"), ("s", "s")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(e)], "edge_ord long, source string, target string")
    assert graph.cycles(df) == [("a", "b", "c"), ("s",)]
    assert {x.node for x in graph.cyclic_core(df).collect()} == {"a", "b", "c", "s"}
    assert graph.cycles(df.where("source = 'c' AND target = 'd'")) == []


def _whole_search(links):
    """The reference's recursive search of a whole graph."""
    after, state, stack, found = {}, {}, [], []
    for a, b in links:
        after.setdefault(a, []).append(b)

    def visit(v):
        state[v] = 1
        stack.append(v)
        for w in after.get(v, ()):
            if state.get(w, 0) == 0:
                visit(w)
            elif state[w] == 1:
                c = stack[stack.index(w) :]
                canonical = min(tuple(x[i:] + x[:i]) for x in (c, c[::-1]) for i in range(len(c)))
                if canonical not in found:
                    found.append(canonical)
        stack.pop()
        state[v] = 2

    for v in sorted({x for e in links for x in e}):
        if state.get(v, 0) == 0:
            visit(v)
    return found


@pytest.mark.parametrize("in_one_task", [0, 1 << 20])
def test_cycles_of_projects_equal_a_search_of_each(spark, monkeypatch, in_one_task, tmp_path):
    monkeypatch.setattr(graph, "IN_ONE_TASK", in_one_task)
    rnd = random.Random(7)
    graphs = {p: [(f"{p[0]}{rnd.randrange(14):02d}.do", f"{p[0]}{rnd.randrange(14):02d}.do") for _ in range(22)] for p in ("p1", "q2", "r3", "s4", "t5", "u6")}
    # of these, a search from b finds other cycles than one from 0, which leads into the cycles at d
    graphs["entry"] = [("0", "d"), ("b", "c"), ("c", "b"), ("b", "d"), ("d", "c")]
    rows = [(i, p, a, b) for i, (p, a, b) in enumerate((p, a, b) for p, links in graphs.items() for a, b in links)]
    _table(spark, tmp_path, "edges", "edge_ord long, project_id string, source string, target string", rows)
    _table(spark, tmp_path, "nodes", "node_row_id long, project_id string, node_id string, node_type string, path string, role string, cluster_id string", [(1, "p1", "p00.do", "script", None, "script", None)])
    _table(spark, tmp_path, "snapshot_left", "project_id string, id string, mtime timestamp", [("p1", "x", None)])
    want = {(p, c) for p, links in graphs.items() for c in _whole_search(links)}
    assert {c for p, c in want if p == "entry"} != set(_whole_search(graphs["entry"][1:]))
    got = [(x.project_id, tuple(x.cycle)) for x in registry.QUERIES["m09_cycles"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    told = registry.QUERIES["m00_diagnostics"](spark, str(tmp_path)).where("code = 'cycle_detected'").collect()
    assert sorted((x.project_id, x.payload["cycle"]) for x in told) == sorted((p, " -> ".join([*c, c[0]])) for p, c in want)


# versions, overrides, rendering


def test_version_modes(spark):
    nodes = spark.createDataFrame([(p, "artifact", p) for p in ("d/p_v2.dta", "d/p_v10.dta", "d/p_qc.dta", "d/q_final.csv", "d/q_draft.csv", "d/z_v1.csv")], "node_id string, node_type string, path string")
    mem = versions.members(nodes, [])
    pick = lambda mode: {x.family: x.canonical for x in versions.canonical(mem, [], VersionFamilies(mode=mode)).collect()}
    assert pick("highest_numeric") == {"d/p.dta": "d/p_v10.dta", "d/q.csv": None}
    assert pick("priority_suffix") == {"d/p.dta": "d/p_qc.dta", "d/q.csv": "d/q_final.csv"}
    edges = spark.createDataFrame([(1, "a.do", "d/p_v2.dta", "save", "k", None), (2, "a.do", "d/p_v10.dta", "save", "k", None)], "edge_ord long, source string, target string, operation string, kind string, visible_label string")
    chosen = versions.canonical(mem, [], VersionFamilies(mode="highest_numeric"))
    left, merged, open_ = versions.collapse(nodes, edges, mem, chosen, [])
    assert [(x.target, x.edge_ord) for x in merged.collect()] == [("d/p_v10.dta", 1)]
    assert {x.node_id for x in left.collect()} == {"d/p_v10.dta", "d/q_final.csv", "d/q_draft.csv", "d/z_v1.csv"}
    assert [x.family for x in open_.collect()] == ["d/q.csv"]


def test_manual_edges(spark):
    nodes = spark.createDataFrame([("a.do", "script"), ("d.csv", "artifact")], "node_id string, node_type string")
    edges = spark.createDataFrame([("a.do", "d.csv")], "source string, target string")
    entries = [ManualEdge("", "x"), ManualEdge("a.do", "d.csv"), ManualEdge("a.do", "n.py"), ManualEdge(".\\n.py", "a.do", on_missing="placeholder"), ManualEdge("a.do", "n.py"), ManualEdge("a.do", "n.py")]
    new, put, said = overrides.apply_manual_edges(entries, nodes, edges)
    assert [(e["source"], e["target"], e["kind"]) for e in new] == [("n.py", "a.do", "script_to_script"), ("a.do", "n.py", "script_to_script")]
    assert [(n["node_id"], n["node_type"], n["role"]) for n in put] == [("n.py", "script_placeholder", "placeholder_script")]
    assert [s["code"] for s in said] == ["invalid_manual_edge", "manual_edge_duplicate", "manual_edge_node_not_found", "manual_edge_placeholder_injected", "manual_edge_duplicate", "manual_edges_applied"]


def test_hints(spark):
    missing = spark.createDataFrame([("code/a.py", "m"), ("zzz", "m")], "node_id string, cluster_id string")
    assert {x.node_id: x.hint for x in overrides.with_hints(missing, ["code/a1.py", "other.do"]).collect()} == {"code/a.py": "code/a1.py", "zzz": None}


def test_hints_come_from_all_nodes(spark):
    names = [f"q{i:05d}.do" for i in range(60_000)] + ["code/load.py", "code/loae.py", "data/raw.csv"]
    nodes = spark.createDataFrame([(n,) for n in names], "node_id string").repartition(7)
    got = {x.node_id: x.hint for x in overrides.closest(["code/loa.py", "data/rav.csv", "#"], nodes).collect()}
    assert got == {m: difflib.get_close_matches(m, names, n=1)[0] for m in ("code/loa.py", "data/rav.csv")}


def test_manual_cluster_hints_reach_beyond_50_000_nodes(spark):
    ids = [f"q{i:05d}.do" for i in range(50_010)] + ["code/load.py"]
    nodes = spark.createDataFrame([(n, "script", None, n, "script", None) for n in ids], "node_id string, node_type string, label string, path string, role string, cluster_id string").coalesce(1)
    empty = spark.createDataFrame([], "edge_ord bigint, source string, target string, operation string, kind string, visible_label string")
    g = pipeline.LineageGraph(spark, "/p", nodes, empty, spark.createDataFrame([], pipeline.DIAGNOSTICS), spark.createDataFrame([], pipeline.CLUSTERS), spark.createDataFrame([], "path string"))
    done = pipeline._manual_clusters(g, Config(clusters=[ManualCluster(cluster_id="c", members=["q00001.do", "code/loa.py"])]))
    said = [x.message for x in done.diagnostics.where("code = 'cluster_member_not_found'").collect()]
    assert said == ["Manual cluster member is no node: code/loa.py (did you mean code/load.py?)"]


def test_views_and_bridges(spark):
    nodes = spark.createDataFrame([("a.do", "script", "script", None), ("b.do", "script", "script", "c1"), ("x.dta", "artifact", "intermediate", None), ("y.png", "artifact", "deliverable", None)], "node_id string, node_type string, role string, cluster_id string")
    edges = spark.createDataFrame([(1, "a.do", "x.dta", "save", "save"), (2, "x.dta", "b.do", "use", "use"), (3, "b.do", "y.png", "g", None), (4, "b.do", "b.do", "m", None)], "edge_ord long, source string, target string, operation string, visible_label string")
    shown = lambda **k: {x.node_id for x in render.visible(nodes, edges, [], Display(**k)).collect()}
    assert shown(view="scripts_only") == {"a.do", "b.do"}
    assert shown(view="deliverables") == {"a.do", "b.do", "y.png"}
    assert shown(view="stage_overview") == {"a.do"}
    assert shown(show_terminal_outputs=False) == {"a.do", "b.do", "x.dta"}
    d = Display(view="scripts_only", edge_label_mode="show")
    alias = render.aliases(nodes, render.visible(nodes, edges, [], d), spark.createDataFrame([("c1",)], "cluster_id string"), [])
    assert {tuple(x) for x in render.bridges(edges, alias, nodes, [], d.view).collect()} == {("a.do", "cluster::c1")}
    assert [(x.source, x.target, x.label) for x in render.drawn_edges(edges, alias, [], d).collect()] == [("cluster::c1", "cluster::c1", "")]


def test_diagnostic_dedup_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "info", "c", "m1", {"a": "1", "b": "2"}), (2, "info", "c", "m2", {"b": "2", "a": "1"}), (3, "info", "c", "m", None), (4, "info", "c", "m", None)], "diag_id long, level string, code string, message string, payload map<string,string>")
    assert {(x.diag_id, x.n) for x in validate.dedupe(d, []).collect()} == {(1, 2), (3, 2)}
    none = d.limit(0)
    assert validate.dedupe(none, []).collect() == []
    assert validate.bundle_absolute(none, []).collect() == []


def test_sections_and_contents(spark):
    src = "## Table of contents\n## Load\n\n## Clean\nx = 1\n## Load\n# %% \n# In[3]:\n## [1] 0.2\n# ---- 1.2 Sub ----\n#######\n## Clean"
    df = spark.createDataFrame([("a.py", src), ("n.py", None), ("e.py", "")], "script string, text string")
    got = sections.sections(df, ["script"], F.lit("python")).orderBy("line").collect()
    assert [(x.line, x.level, x.title) for x in got] == [(6, 1, "Load"), (7, 1, "(untitled cell)"), (8, 1, "In[3]:"), (10, 2, "1.2 Sub"), (12, 1, "Clean")]


# the whole build


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("proj")
    files = {
        "code/01_master.do": 'global root "data"\nglobal out "${root}/clean"\ndo "code/02_clean.do"\n',
        "code/02_clean.do": 'use "${root}/raw.dta"\nforeach y in 1 2 {\nmerge 1:1 id using "data/add_`y\'.dta"\n}\nsave "${out}/panel_v1.dta"\nsave "${out}/panel_v2.dta"\nsave "data/tmp_x.dta"\nerase "data/tmp_x.dta"\n',
        "code/__init__.py": "",
        "code/_helper.py": 'BASE = "data/clean"\n',
        "code/03_model.py": 'import os\nimport pandas as pd\nfrom _helper import BASE\ndf = pd.read_stata(os.path.join(BASE, "panel_v2.dta"))\ndf.to_csv("out/model.csv")\n',
        "code/04_plot.R": 'out <- "out"\nsource("code/util.R")\nd <- read_csv(file.path(out, "model.csv"))\nggsave(paste0(out, "/fig.png"))\n# Plot ----\n',
        "code/util.R": 'saveRDS(d, file = file.path(out, "u.rds"))\n',
        "archive/old.do": "use x.dta\n",
        "data/raw.dta": "",
        "bad.do": b"use \xff\xfe.dta",
    }
    for name, body in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body if isinstance(body, bytes) else body.encode())
    return str(root)


def test_build(spark, project):
    config = Config(manual_edges=[ManualEdge("code/util.R", "code/03_model.py")], clusters=[ManualCluster("m1", "Models", ["code/03_model.py", "code/03_modl.py"])])
    g = pipeline.validated(pipeline.build(spark, project, config))
    edges = {(e.source, e.target, e.operation, e.kind) for e in g.edges.collect()}
    assert {
        ("code/01_master.do", "code/02_clean.do", "do", "script_call"),
        ("code/_helper.py", "code/03_model.py", "import", "script_call"),
        ("code/util.R", "code/04_plot.R", "source", "script_call"),
        ("data/raw.dta", "code/02_clean.do", "use", "reference_input"),
        ("data/add_1.dta", "code/02_clean.do", "merge", "reference_input"),
        ("code/02_clean.do", "data/clean/panel_v2.dta", "save", "intermediate"),
        ("data/clean/panel_v2.dta", "code/03_model.py", "read_stata", "intermediate"),
        ("code/03_model.py", "out/model.csv", "to_csv", "intermediate"),
        ("code/util.R", "out/u.rds", "saveRDS_kw", "deliverable"),
        ("code/util.R", "code/03_model.py", "manual", "script_to_script"),
    } <= edges
    assert not any("tmp_x" in x for e in edges for x in e[:2])
    codes = {d.code for d in g.diagnostics.collect()}
    assert {"file_encoding_error", "erased_artifact", "temporary_outputs_hidden", "cluster_member_not_found", "missing_referenced_file", "version_family_detected", "excluded_path_inventory", "manual_edges_applied"} <= codes
    nodes = {n.node_id: n for n in g.nodes.collect()}
    assert nodes["code/03_model.py"].cluster_id == "m1"
    assert nodes["data/clean/panel_v2.dta"].role == "intermediate"
    for made in (text.dot(g, config), text.dot(g, Config(display=Display(view="stage_overview"))), text.cluster_yaml(g), text.summary(g, config)):
        assert "m1" in made or "Models" in made or "Project root" in made
    assert json.loads(text.snapshot(g, config))["project_root"] == project
    assert json.loads(text.report(g))["summary"]["nodes"] == len(nodes)
    assert text.edge_csv(g.edges).startswith("source,target,command,kind\r\n")


def test_cli_and_edge_csv_round_trip(spark, project, tmp_path):
    out = tmp_path / "edges.csv"
    assert cli.main(["extract-edges", "--project-root", project, "--output", str(out)]) == 0
    settings = tmp_path / "settings.json"
    settings.write_text(json.dumps({"parser": {"prefer_existing_edge_csv": True, "edge_csv_path": str(out)}}))
    again = tmp_path / "again.csv"
    assert cli.main(["extract-edges", "--project-root", project, "--config", str(settings), "--output", str(again)]) == 0
    assert again.read_bytes() == out.read_bytes()
    found = tmp_path / "sections.json"
    assert cli.main(["extract-sections", "--project-root", project, "--output", str(found)]) == 0
    assert json.loads(found.read_text()) == {"code/04_plot.R": [{"line": 5, "level": 1, "title": "Plot"}]}


def test_relations_as_folders(spark, project, tmp_path):
    assert cli.main(["extract-edges", "--project-root", project, "--as-folder"]) == 2
    assert cli.main(["extract-edges", "--project-root", project, "--as-folder", "--output", f"{tmp_path}/edges"]) == 0
    one = tmp_path / "edges.csv"
    assert cli.main(["extract-edges", "--project-root", project, "--output", str(one)]) == 0
    lines = [x for f in sorted((tmp_path / "edges").glob("part-*.csv")) for x in f.read_text().splitlines()[1:]]
    assert lines == one.read_text().splitlines()[1:]
    assert cli.main(["snapshot-json", "--project-root", project, "--as-folder", "--output", f"{tmp_path}/snap"]) == 0
    assert spark.read.json(f"{tmp_path}/snap/edges").count() == len(lines)
    assert cli.main(["validate", "--project-root", project, "--as-folder", "--output", f"{tmp_path}/report"]) == 0
    assert spark.read.json(f"{tmp_path}/report/summary").agg(F.sum("n")).first()[0] == spark.read.json(f"{tmp_path}/report/diagnostics").count()


def test_trees_are_listed_by_tasks_below_the_first_levels(spark, tmp_path, monkeypatch):
    from strandline.sources import tree

    for i in range(5):
        for j in range(3):
            (tmp_path / f"d{i}" / f"e{j}" / "archive").mkdir(parents=True)
            (tmp_path / f"d{i}" / f"e{j}" / "x.csv").write_text("a")
            (tmp_path / f"d{i}" / f"e{j}" / "archive" / "y.csv").write_text("a")
    (tmp_path / "broken").symlink_to(tmp_path / "nowhere")
    (tmp_path / "a.py").write_text("")
    rows = lambda: sorted(tuple(r) for r in tree.project_files(spark, str(tmp_path), Config()).collect())
    whole = rows()
    assert len(whole) == 1 + 5 + 15 + 30
    assert {r[1] for r in whole} == {"python", "input", "excluded", None}
    monkeypatch.setattr(tree, "FOLDERS_AHEAD", 2)
    assert rows() == whole
    monkeypatch.setattr(tree, "FOLDERS_AHEAD", 1)
    assert rows() == whole


def test_settings(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("display: {theme: nope, view: scripts_only, odd: 1}\nclusters: [{id: a, members: [x]}]\n")
    with pytest.warns(UserWarning):
        c = load_config(str(p))
    assert (c.display.theme, c.display.view, c.clusters[0].cluster_id) == ("modern-light", "scripts_only", "a")
    p.write_text("clusters: [3]\n")
    with pytest.raises(ValueError, match="cluster"):
        load_config(str(p))
    assert posixpath.basename(str(p)) == "c.yaml"


def test_streamed_usage(spark, sf_dir, tmp_path):
    from strandline.streaming import changes

    events = spark.read.parquet(f"{sf_dir}/parsed_events.parquet")
    src = str(tmp_path / "in")
    events.repartition(3).write.parquet(src)
    stream = changes.usage_by_window(changes.deduplicated(changes.event_stream(spark, src, events.schema), ["event_id"], late="400 days"), late=None)
    q = stream.writeStream.format("memory").queryName("usage").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("usage").columns == ["window_start", "project_id", "kind", "n"]


def test_events_behind_the_watermark_are_merged(spark, sf_dir, tmp_path):
    from strandline.streaming import changes

    one = spark.read.parquet(f"{sf_dir}/parsed_events.parquet").where("raw_path IS NOT NULL").limit(1)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    at = lambda i, t: one.withColumn("event_id", F.lit(i).cast(one.schema["event_id"].dataType)).withColumn("scanned_at", F.lit(t).cast(one.schema["scanned_at"].dataType))
    (tmp_path / "in").mkdir()
    stream = changes.deduplicated(changes.event_stream(spark, src, one.schema), ["event_id"])
    # the last two come days late, once the watermark has passed them; one of them twice
    for rows in (at(1, "2031-01-09 00:00:00"), at(2, "2031-01-10 00:00:00"), at(3, "2031-01-01 00:00:00").union(at(4, "2031-01-02 00:00:00")).union(at(4, "2031-01-02 00:00:00"))):
        rows.coalesce(1).write.mode("append").parquet(src)
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        assert q.awaitTermination(60)
    arrived, written = spark.read.parquet(src), spark.read.schema(one.schema).parquet(out)
    ids = lambda df: sorted(int(x.event_id) for x in df.collect())
    assert ids(written) == [1, 2]
    assert ids(changes.missed(arrived, written, ["event_id"])) == [3, 4]
    assert sorted((x.window_start.day, x.n) for x in changes.merged_usage(arrived, written, ["event_id"]).collect()) == [(1, 1), (2, 1), (9, 1), (10, 1)]


# masters, shared folders, scripts


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    from strandline import materialize

    class Conf:
        def get(self, name, default=None):
            return default

    class Fake:
        conf = Conf()

        class sparkContext:
            master, applicationId = "yarn", "app-1"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        materialize.shared_dir(Fake())


def test_tables_of_a_query_are_deleted(spark):
    from pathlib import Path

    from strandline import materialize

    kept = materialize.Cut(spark.range(3))
    with materialize.scratch(spark):
        gone = materialize.Cut(spark.range(3))
        assert gone.df.count() == 3
    where = lambda t: Path(t.path.removeprefix("file:"))
    assert kept.df.count() == 3
    assert not where(gone).exists()
    kept.drop()
    assert not where(kept).exists()


def test_macros_in_macros():
    deep = "".join(f"local m{i + 1} `m{i}'\n" for i in range(30))
    src = f"local m0 a b\n{deep}use \"d/`m30'.dta\"\nlocal x `y'\nlocal y `x'\nuse \"e/`x'.dta\"\nlocal n1 one two\nlocal i 1\nuse \"f/`n`i''.dta\"\nlocal s `s's\nuse \"g/`s'.dta\"\n"
    got = _events(stata.parse(src, Context("/p", "a.do")))
    assert got == [
        ("use", ["d/a.dta", "d/b.dta"], "full"),
        ("use", ["e/{x}.dta"], "partial"),
        ("use", ["f/one.dta", "f/two.dta"], "full"),
        ("use", ["g/{s}s.dta"], "partial"),
    ]


def test_direction_of_f_string_paths():
    src = 'a = f"fig/p_{k}.png"\nb = f"in/s_{k}.csv"\nopen(x, "w"); c = f"out/t_{k}.pkl"\nd = f"out/u_{k}.csv"; df.to_csv(h)\n'
    got = {(x["normalized_paths"][0], x["is_write"]) for x in python.parse(src, Context("/p", "a.py")) if x["command"] == "fstring_path"}
    assert got == {("fig/p_*.png", True), ("in/s_*.csv", False), ("out/t_*.pkl", True), ("out/u_*.csv", True)}


def test_modes_and_services(spark, tmp_path):
    from strandline.config import CHOICES

    (tmp_path / "a.do").write_text('use "d/p_v2.dta"\nuse "d/p_v10.dta"\nuse "https://x.org/a.dta"\n')
    (tmp_path / "b.py").write_text('import pandas as pd\npd.read_csv("https://x.org/a.csv")\n')
    (tmp_path / "d").mkdir()
    for n in ("p_v2.dta", "p_v10.dta"):
        (tmp_path / "d" / n).write_text("")
    config = Config()
    config.parser.version_families.mode = "prefer_highest_numeric"
    config.clusters = [ManualCluster(" ", "nameless", ["a.do"])]
    g = pipeline.build(spark, str(tmp_path), config)
    said = {(d.code, d.payload.get("chosen") or d.payload.get("path")) for d in g.diagnostics.collect() if d.code in ("version_family_resolved", "external_reference", "invalid_manual_cluster")}
    assert said == {("version_family_resolved", "d/p_v10.dta"), ("external_reference", "https://x.org/a.csv"), ("invalid_manual_cluster", None)}
    assert {e.source for e in g.edges.collect()} == {"d/p_v10.dta"}
    assert {"off", "prefer_priority_suffix"} < set(CHOICES["parser.version_families.mode"])
    made = text.summary(pipeline.validated(g), config)
    assert "- View: overview\n" in made and "- Version families collapsed: 1\n" in made

"""Problems 1, 3, 4 and 5 on small fixtures: dirt, ties, repeats, NULLs, empty tables, clashing names."""

import json
import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.operators import diff, drift, hierarchy, unpack

# 1: drift


def _snapshots():
    a = [{"id": f"n{i}", "type": "artifact", "size": i, "gone": "x", "flag": True} for i in range(4)]
    b = [{"key": f"n{i}", "type": "artifact", "bytes": str(i), "new": [i], "flag": None} for i in reversed(range(4))]
    c = [{"key": f"n{i}", "type": {"name": "artifact"}, "bytes": i + 0.5, "new": [i]} for i in range(4)]
    rows, raw = [], 0
    for n, (name, recs) in enumerate([("f1", a), ("f2", b), ("f3", c)]):
        for k, r in enumerate(recs):
            for _ in range(2 if name == "f1" else 1):  # one file is loaded twice
                rows.append((raw, name, "g", f"2031-01-0{n + 1} 00:00:00", k, json.dumps(r)))
                raw += 1
    return rows + [(raw, "f2", "g", "2031-01-02 00:00:00", 9, '{"broken": 1, "x'), (raw + 1, "f3", "g", "2031-01-03 00:00:00", 9, None), (raw + 2, "f3", "g", "2031-01-03 00:00:00", 10, "[1]")]


def _raw(spark, rows):
    df = spark.createDataFrame(rows, "raw_id long, file_name string, graph_id string, written_at string, rec_no int, body string")
    return df.withColumn("written_at", F.to_timestamp("written_at"))


def test_drift_log(spark):
    log = drift.Drift(_raw(spark, _snapshots())).changes()
    assert {(r.file, r.change, r.field_before, r.field_after) for r in log.collect()} == {
        ("f2", "renamed", "id", "key"),
        ("f2", "renamed", "size", "bytes"),
        ("f2", "retyped", "size", "bytes"),
        ("f2", "removed", "gone", ""),
        ("f2", "removed", "flag", ""),
        ("f2", "added", "", "new"),
        ("f3", "retyped", "type", "type"),
        ("f3", "retyped", "bytes", "bytes"),
    }


def test_renaming_is_found_by_the_field_that_aligns_most(spark):
    before = [{"node_id": f"a{i}", "key": f"k{i}", "path": f"p{i}"} for i in range(6)]
    after = [{"node_id": "a0" if i == 5 else f"z{i}", "key": f"k{i}", "file": f"p{i}"} for i in range(6)]
    # one key repeats, and most records of the later file have none
    before.append(before[0])
    after += [{"note": f"n{i}"} for i in range(9)]
    rows = [(0, f, "g", f"2031-01-0{d} 00:00:00", i, json.dumps(r)) for f, d, rs in (("f1", 1, before), ("f2", 2, after)) for i, r in enumerate(rs)]
    raw = _raw(spark, rows)
    got = {(x.change, x.field_before, x.field_after) for x in drift.Drift(raw).changes().where("n > 1").collect()}
    assert got == {("renamed", "path", "file"), ("added", "", "note")}


def _two_files(spark, before, after):
    rows = [(0, f, "g", f"2031-01-0{d} 00:00:00", i, json.dumps(r)) for f, d, rs in (("f1", 1, before), ("f2", 2, after)) for i, r in enumerate(rs)]
    return _raw(spark, rows)


def _log(raw):
    return {(x.change, x.field_before, x.field_after) for x in drift.Drift(raw).changes().collect()}


def test_agreement_comes_before_known_names(spark):
    # one node agrees by accident, uid in all records
    before = [{"uid": f"u{i}", "node": f"a{i}", "role": f"r{i}"} for i in range(10)]
    after = [{"uid": f"u{i}", "node": "a0" if i == 5 else f"b{i}", "kind": f"r{i}"} for i in range(10)]
    assert _log(_two_files(spark, before, after)) == {("renamed", "role", "kind")}


def test_renaming_is_found_beside_repeated_nodes(spark):
    before = [{"id": f"n{i}", "role": f"r{i}"} for i in range(10)]
    after = [{"id": f"n{i}", "kind": f"r{i}"} for i in range(10)]
    assert _log(_two_files(spark, [*before, before[3]], after)) == {("renamed", "role", "kind")}
    # half of the nodes stand twice
    assert _log(_two_files(spark, before + before[:5], after + after[5:])) == {("renamed", "role", "kind")}


def test_swapped_fields_find_their_best_partners(spark):
    before = [{"id": f"n{i}", "a": f"x{i}", "b": f"x{i}" if i < 6 else f"y{i}", "c": i} for i in range(10)]
    after = [{"id": f"n{i}", "p": f"x{i}", "q": f"x{i}" if i < 6 else f"y{i}", "r": f"{i}", "s": "new"} for i in range(10)]
    got = _log(_two_files(spark, before, after))
    assert got == {("renamed", "a", "p"), ("renamed", "b", "q"), ("renamed", "c", "r"), ("retyped", "c", "r"), ("added", "", "s")}


def test_series_and_names_may_be_null(spark):
    rows = [(0, None if d == 1 else "f2", None, f"2031-01-0{d} 00:00:00", i, json.dumps({"id": f"n{i}", f"f{d}": i})) for d in (1, 2) for i in range(4)]
    rows += [(1, "f3", None, "2031-01-03 00:00:00", 0, "not JSON"), (2, "f4", None, None, 0, '{"id": "n1", "id": "n2", "\\ud800": 1, "\\ud801": 2}')]
    raw = _raw(spark, rows)
    got = {(x.file, x.n, x.change, x.field_before, x.field_after) for x in drift.Drift(raw).changes().collect()}
    assert {x for x in got if x[1] == 3} == {("f2", 3, "renamed", "f1", "f2")}
    assert {x for x in got if x[1] == 4} == {("f3", 4, "removed", "id", ""), ("f3", 4, "removed", "f2", "")}
    assert drift.consistent_table(raw, drift.Drift(raw), ["raw_id"]).count() == 9


def test_no_value_is_lost_to_a_type(spark):
    big, huge, fine = 9007199254740993, int("1" + "0" * 45), "0.1234567890123456789"
    files = [{"id": "a", "n": big, "m": 1, "h": huge, "f": 1.5, "l": [1, 2.50]}, {"id": "a", "n": 1.5, "m": 0.25, "h": 7, "f": 2.5, "l": [{"b": 1, "a": None}]}]
    rows = [(i, f"f{i}", "g", f"2031-01-0{i + 1} 00:00:00", 0, json.dumps(r)) for i, r in enumerate(files)]
    rows.append((2, "f2", "g", "2031-01-03 00:00:00", 0, f'{{"id": "b", "f": {fine}, "d": {"9" * 5000}}}'))
    raw = _raw(spark, rows)
    d = drift.Drift(raw)
    assert {c["name"]: (c["type"], c["widened"]) for c in d.columns()} == {
        "id": ("string", False), "n": ("string", True), "m": ("fraction", False), "h": ("string", True), "f": ("string", True), "l": ("list", False), "d": ("string", True)
    }
    out = {r.raw_id: r for r in drift.consistent_table(raw, d, ["raw_id"]).collect()}
    assert (out[0].n, out[1].n, out[0].m, out[0].h, out[2].f, out[2].d) == (str(big), "1.5", 1.0, str(huge), fine, "9" * 5000)
    assert (out[0].l, out[1].l) == ("[1, 2.5]", '[{"a": null, "b": 1}]')


def test_json_of_any_depth():
    v = [1, {"b": [], "a": {"c": None, "d": drift._Fraction("2.50")}}, "x\u00e9", [[]], {}]
    assert drift._as_text(v) == '[1, {"a": {"c": null, "d": 2.50}, "b": []}, "x\u00e9", [[]], {}]'
    deep = []
    for _ in range(50_000):
        deep = [deep]
    assert drift._as_text(deep) == "[" * 50_001 + "]" * 50_001


def test_drift_consistent_table(spark):
    raw = _raw(spark, _snapshots())
    out = drift.consistent_table(raw, drift.Drift(raw), ["raw_id", "file_name"])
    assert out.count() == 16
    assert {"raw_id", "file_name", "flag", "gone", "new", "type"} <= set(out.columns)
    assert len({"id", "key"} & set(out.columns)) == len({"size", "bytes"} & set(out.columns)) == 1


def test_drift_of_empty_table(spark):
    raw = _raw(spark, [])
    assert drift.Drift(raw).changes().collect() == []


def test_type_lattice(spark):
    got = spark.range(64).select("id", drift.lattice_type(F.col("id")).alias("t")).collect()
    types = {r.id: r.t for r in got}
    assert [types[b] for b in (0, 1, 2, 4, 6, 8, 16, 32, 3, 24)] == ["null", "boolean", "integer", "fraction", "fraction", "string", "list", "object", "string", "string"]


# 3: packed values


@pytest.mark.parametrize(
    ("text", "values"),
    [
        (None, []),
        ("", []),
        ("  \t ", []),
        ("a", ["a"]),
        ("a, b ;c|d\te\nf", ["a", "b", "c", "d", "e", "f"]),
        (",a,, b,", ["a", "b"]),
        ("O'Neil, team's x", ["O'Neil", "team's x"]),
        ('"a; b" ; c', ["a; b", "c"]),
        ('"say ""x"" | y", z', ['say "x" | y', "z"]),
        ("'O''Neil'|'a, b'", ["O'Neil", "a, b"]),
        ('["a", "b\\"c", "d\\\\e"]', ["a", 'b"c', "d\\e"]),
        ("['a', \"team's\", 'it\\'s']", ["a", "team's", "it's"]),
        ('"never closed, b', ['"never closed', "b"]),
        ('""', []),
        ('"a" tail, b', ['"a" tail', "b"]),
        ("[a] x, b", ["[a] x", "b"]),
        ("[]", []),
        ("\xa0a\xa0,　b", ["a", "b"]),
    ],
)
def test_unpacked_values(text, values):
    got, parent = unpack.split_values(pa.array([text]))
    assert got.to_pylist() == values
    assert parent.tolist() == [0] * len(values)


def test_unpacking_a_batch_equals_unpacking_alone():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab\"',; |\t\\[]é") for _ in range(rnd.randint(0, 14))) for _ in range(3000)] + [None]
    values, parent = unpack.split_values(pa.array(texts))
    together = defaultdict(list)
    for v, p in zip(values.to_pylist(), parent):
        together[p].append(v)
    for i, t in enumerate(texts):
        assert together[i] == unpack.split_values(pa.array([t]))[0].to_pylist()


def test_unpack_map(spark):
    rows = [(1, {"a": "x;y", "b": None}), (2, None), (3, {"c": "q"}), (4, {"b": "z" * 100_000 + ",1"})]
    df = spark.createDataFrame(rows, "id long, payload map<string,string>").withColumn("val", F.lit(1)).withColumn("pos", F.lit(2))
    got = unpack.unpack_map(df, ["id"], "payload", ["a", "b"]).collect()
    assert {(r.id, r.field, r.pos, r.val[:2]) for r in got} == {(1, "a", 1, "x"), (1, "a", 2, "y"), (4, "b", 1, "zz"), (4, "b", 2, "1")}
    assert unpack.unpack_map(df.limit(0), ["id"], "payload", ["a"]).collect() == []


# 4: hierarchies


def _expected(links):
    parent = {c: p for p, c in links if c is not None}
    kids = defaultdict(set)
    for c, p in parent.items():
        kids[p].add(c)
    out = {}
    for n in {x for link in links for x in link if x is not None}:
        chain, x = [n], n
        while x in parent and parent[x] not in chain:
            x = parent[x]
            chain.append(x)
        below, todo = set(), [n]
        while todo:
            for k in kids[todo.pop()]:
                if k not in below:
                    below.add(k)
                    todo.append(k)
        if x in parent:
            ring = chain[chain.index(parent[x]) :]
            out[n] = (min(ring), -1 if n in ring else -2, "", len(below - {n}))
        else:
            out[n] = (x, len(chain) - 1, " > ".join(reversed(chain)), len(below - {n}))
    return out


def _some_links():
    rnd = random.Random(11)
    links = [("root", f"c{i}") for i in range(150)] + [(f"d{i}", f"d{i + 1}") for i in range(70)]
    links += [("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("r2", "t1"), ("t1", "t2"), ("self", "self"), ("self", "u"), ("lonely", None), ("x", "y"), ("y", "x")]
    links += [(f"q{i}", f"q{(i + 1) % 7}") for i in range(7)]
    return links + [(f"e{rnd.randrange(i)}", f"e{i}") for i in range(1, 120)]


@pytest.mark.parametrize(("in_one_task", "bucket", "at_once"), [(1 << 20, 1 << 16, 1 << 22), (4, 8, 200), (100, 64, 1 << 22)])
def test_hierarchy_against_walking(spark, monkeypatch, in_one_task, bucket, at_once):
    for name, value in (("IN_ONE_TASK", in_one_task), ("BUCKET", bucket), ("AT_ONCE", at_once)):
        monkeypatch.setattr(hierarchy, name, value)
    links = _some_links()
    df = spark.createDataFrame([("x", p, c) for p, c in links], "relation string, parent string, child string")
    forest = hierarchy.Forest(df)
    rows = forest.table().collect()
    assert len(rows) == len({r.node for r in rows})
    assert {r.node: (r.root, r.depth, r.path, r.n_below) for r in rows} == _expected(links)
    parent = {c: p for p, c in links if c is not None}
    on_ring = {n for n, x in _expected(links).items() if x[1] == -1}
    want = set()
    for n in parent:
        x, d = n, 0
        while x in parent and x not in on_ring:
            x, d = parent[x], d + 1
            want.add((x, n, d))
    below = [(r.ancestor, r.node, r.distance) for r in forest.descendants().collect()]
    assert len(below) == len(want)
    assert set(below) == want


def test_clean_links_and_empty_input(spark):
    rows = [(" a ", ["b", "b\t", None, " ", "c"]), ("a", ["b"]), (None, ["z"]), ("d", None), ("e", [])]
    df = spark.createDataFrame(rows, "p string, kids array<string>")
    links = hierarchy.clean_links(df, "r", "p", "kids")
    assert {(r.parent, r.child) for r in links.collect()} == {("a", "b"), ("a", "c"), ("d", None), ("e", None)}
    assert hierarchy.Forest(links.limit(0)).table().collect() == []


# 5: differences


def test_differences(spark):
    schema = "project_id string, id string, a string, n long"
    left = [("p", "1", "x", 1), ("p", "1", "x", 1), ("p", "2", None, 2), ("p", "3", "x", 3), (None, "4", "x", 4), ("p", "6", "x", 6), ("p", "6", "y", 6), ("p", "7", "x", 7), ("p", "7", "y", 7), ("q", None, "x", 1)]
    right = [("p", "1", "x", 1), ("p", "2", "x", None), (None, "4", "X", 4), ("p", "5", "x", 5), ("p", "6", "x", 6), ("p", "7", "y", 7), ("p", "7", "x", 7), ("q", None, "x", 1)]
    expected = {("p", "2", "differs", "a"), ("p", "2", "differs", "n"), ("p", "3", "left_only", ""), (None, "4", "differs", "a"), ("p", "5", "right_only", ""), ("p", "6", "differs", "a")}
    a, b = spark.createDataFrame(left, schema).withColumn("extra", F.lit(1)), spark.createDataFrame(right, schema)
    got = diff.differences(a, b, ["project_id", "id"], ["a", "n"])
    assert sorted(map(str, got.collect())) == sorted(map(str, {r for r in got.collect()}))
    assert {tuple(r) for r in got.collect()} == expected
    assert diff.differences(a, a, ["project_id", "id"], ["a", "n"]).collect() == []
    assert diff.differences(a.limit(0), b.limit(0), ["project_id", "id"], ["a", "n"]).collect() == []
    assert {r.kind for r in diff.differences(a, b.limit(0), ["project_id", "id"], ["a", "n"]).collect()} == {"left_only"}


def test_differences_of_a_field_called_side(spark):
    a = spark.createDataFrame([(1, "l")], "id long, side string")
    b = spark.createDataFrame([(1, "r")], "id long, side string")
    assert [tuple(r) for r in diff.differences(a, b, ["id"], ["side"]).collect()] == [(1, "differs", "side")]


# whole groups


def test_lists_show_the_first_and_places_span_partitions(spark, monkeypatch):
    from strandline.operators import spread

    monkeypatch.setattr(spread, "LISTED", 10)
    df = spark.range(101).select(F.when(F.col("id") < 95, F.lit("hot")).otherwise(F.lit(None)).alias("k"), F.format_string("m%03d", "id").alias("m"))
    df = df.unionByName(df.limit(3))
    got = {r.k: r for r in spread.listed(df, ["k"], "m").collect()}
    assert {k: (r.n, r.n_rows) for k, r in got.items()} == {"hot": (95, 98), None: (6, 6)}
    assert got["hot"].members.split(" | ") == [f"m{i:03d}" for i in range(10)]
    assert len(got[None].members.split(" | ")) == 6
    assert sorted((r.m, r.n_rows) for r in spread.membership(df, ["k"], "m", "n > 10").collect()) == [(f"m{i:03d}", 2 if i < 3 else 1) for i in range(95)]
    rnd = random.Random(8)
    rows = [(rnd.choice("aab"), rnd.random()) for _ in range(500)]
    out = spread.numbered(spark.createDataFrame(rows, "g string, x double").repartition(7), ["g"], [F.col("x")], "i").collect()
    for g in "ab":
        assert [r.i for r in sorted((r for r in out if r.g == g), key=lambda r: r.x)] == list(range(1, sum(x[0] == g for x in rows) + 1))
    assert spread.numbered(spark.createDataFrame([], "g string, x double"), [], [F.col("x")], "i").collect() == []


def test_the_row_before_is_found_across_partitions(spark):
    from strandline.operators import spread

    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, x int").repartition(5)
    out = spread.numbered(df, ["g"], [F.col("x").asc()], "i", {"before": F.col("x"), "both": F.struct("g", "x")}).collect()
    for g in ("a", "b", None):
        mine = sorted((r for r in out if r.g == g), key=lambda r: r.i)
        assert [r.x for r in mine] == sorted(x for k, x in rows if k == g)
        assert [r.before for r in mine] == [None] + [r.x for r in mine[:-1]]
        assert [r.both and r.both.x for r in mine] == [None] + [r.x for r in mine[:-1]]

"""Schemas that drift between files (problem 1).

The records are read twice. The first pass reads nothing but schemas: each worker folds the records of a batch to the fields and types of
their files, which are joined further in a lattice (null below everything, integer below fraction, everything else joined to string) by
bit_or, so what is shuffled is of the size of the schemas. Every file is then laid beside the file before it in its series, in one row. The
second pass reads values, and only of the files beside which fields both came and went: their nodes are aligned by the field whose texts name
most nodes of both files, whatever it is called, and only the fields that moved are compared there.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator
from decimal import Decimal
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.materialize import Cut, cut
from strandline.operators.spread import numbered

#: Types as bits; a set of types is their sum.
TYPE_BITS = {"boolean": 1, "integer": 2, "fraction": 4, "string": 8, "list": 16, "object": 32}
TYPES = 63
#: What numbers need: integers of more than 38 digits, integers that a double may not hold, fractions that a double doesn't hold.
LONG, WIDE, FINE = 64, 128, 256
#: Of how many records of a file a text may be the name, to count when the field that aligns two files is chosen. All texts of that field align.
REPEATED = 2
#: Names that a node's id has had; they decide only between fields that align equally many nodes.
ID_NAMES = ["id", "key", "node", "nodeId", "node_id"]


def lattice_type(bits: Column) -> Column:
    """The least type that holds all types of a set: integer and fraction give fraction, other mixtures string; no type at all is null."""
    bits = bits.bitwiseAND(F.lit(TYPES))
    return (
        F.when(bits == 0, "null")
        .when(bits == 1, "boolean")
        .when(bits == 2, "integer")
        .when((bits == 4) | (bits == 6), "fraction")
        .when(bits == 16, "list")
        .when(bits == 32, "object")
        .otherwise("string")
    )


class _Fraction(str):
    """The text of a number with a fraction or an exponent."""


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _as_text(v: object) -> str:
    """A value as text: strings and fractions as they stand, everything else as JSON with sorted names, in which fractions stand as they were written too."""
    return v if isinstance(v, str) else _json(v)


class _Mark(str):
    """A piece of JSON that stands between values."""


def _json(v: object) -> str:
    """JSON of a value of any depth, without recursion."""
    out, todo = [], [v]
    while todo:
        x = todo.pop()
        if isinstance(x, (_Mark, _Fraction)):
            out.append(str(x))
        elif isinstance(x, dict) and x:
            todo.append(_Mark("}"))
            for k in sorted(x, reverse=True):
                todo += [x[k], _Mark(f", {json.dumps(k, ensure_ascii=False)}: ")]
            todo[-1] = _Mark("{" + todo[-1][2:])
        elif isinstance(x, list) and x:
            todo.append(_Mark("]"))
            for e in reversed(x):
                todo += [e, _Mark(", ")]
            todo[-1] = _Mark("[")
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def _bit(v: object) -> int:
    """The bit of a value's type, and what a number needs."""
    if isinstance(v, bool):
        return 1
    if isinstance(v, _Fraction):
        # up to 15 digits always come back from a double
        if len(v) <= 16 and "e" not in v and "E" not in v:
            return 4
        return 4 if Decimal(repr(float(v))) == Decimal(v) else 4 | FINE
    if isinstance(v, str):
        return 8
    if isinstance(v, int):
        return 2 if -(1 << 53) <= v <= 1 << 53 else 2 | WIDE if -(10**38) < v < 10**38 else 2 | WIDE | LONG
    return 16 if isinstance(v, list) else 32


def _record(body: str | None) -> dict | None:
    """The top-level values other than null of a record; None if it is no readable JSON object. Of a name that stands twice the last value counts."""
    if body is None:
        return None
    try:
        record = json.loads(body, parse_float=_Fraction, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None
    return {_safe(k): v for k, v in record.items() if v is not None} if isinstance(record, dict) else None


def _safe(s: str) -> str:
    """Halves of surrogate pairs, which JSON can escape, can't be stored as UTF-8."""
    return s if s.isascii() or s.isprintable() else s.encode("utf-8", "replace").decode("utf-8")


def _digest(text: str) -> bytes:
    return hashlib.blake2b(_safe(text).encode(), digest_size=16).digest()


def _any_digits() -> None:
    """Whole numbers of any length are numbers."""
    sys.set_int_max_str_digits(0)


_ENTRY = pa.list_(pa.struct([("field", pa.string()), ("bit", pa.int32()), ("text", pa.string())]))


def read_fields(df: DataFrame, keep: list[str], body: str = "body") -> DataFrame:
    """The columns keep and ``fields``: array of (field, bit, text) of each readable record. Unreadable records are left out; a record with no value has an empty array."""
    src = df.select(*keep, F.col(body).alias("_body"))
    schema = T.StructType([*src.select(*keep).schema.fields, *T._parse_datatype_string("fields array<struct<field:string,bit:int,text:string>>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _any_digits()
        for batch in batches:
            got = [_record(b) for b in batch.column("_body").to_pylist()]
            at = pa.array([i for i, g in enumerate(got) if g is not None], pa.int64())
            lists = pa.array([[{"field": k, "bit": _bit(v), "text": _safe(_as_text(v))} for k, v in g.items()] for g in got if g is not None], _ENTRY)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keep), lists], [*keep, "fields"])

    return src.mapInArrow(run, schema)


def read_schemas(src: DataFrame) -> DataFrame:
    """(series, file, at, field, bits) of the records (series, file, at, body), folded as far as one batch goes: a row for each field of each file in it.

    ``at`` is the file's least in the batch. A file none of whose records can be read, or gives a value, has one row with a NULL field.
    """
    schema = T.StructType([*src.select("series", "file", "at").schema.fields, T.StructField("field", T.StringType()), T.StructField("bits", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _any_digits()
        for b in batches:
            which: dict[tuple, int] = {}
            group, first, found = [], [], []
            for i, (s, f, body) in enumerate(zip(*(b.column(c).to_pylist() for c in ("series", "file", "body")))):
                g = which.setdefault((s, f), len(which))
                if g == len(found):
                    first.append(i)
                    found.append({})
                group.append(g)
                seen = found[g]
                for k, v in (_record(body) or {}).items():
                    seen[k] = seen.get(k, 0) | _bit(v)
            least = pa.table({"g": pa.array(group, pa.int64()), "at": b.column("at")}).group_by("g").aggregate([("at", "min")]).sort_by("g").column("at_min").combine_chunks()
            rows = [(g, k, bits) for g, seen in enumerate(found) for k, bits in (seen.items() or [(None, 0)])]
            of = pa.array([g for g, _, _ in rows], pa.int64())
            at = pa.array(first, pa.int64()).take(of)
            yield pa.RecordBatch.from_arrays(
                [b.column("series").take(at), b.column("file").take(at), least.take(of), pa.array([k for _, k, _ in rows], pa.string()), pa.array([x for _, _, x in rows], pa.int32())], schema.names
            )

    return src.mapInArrow(run, schema)


class Drift:
    """The changes of field between the files of each series. Columns of ``records``: series, file, at (when written), rec (number in the file), body.

    Records that repeat (a file loaded twice) count once. A file none of whose records can be read has no fields. Files of a series are
    ordered by the earliest ``at`` of their records (NULL first), then by name; NULL series and names are values like others. Records of one
    file, files of one series and nodes of one name may be any share of all.
    """

    def __init__(self, records: DataFrame, series: str = "graph_id", file: str = "file_name", at: str = "written_at", rec: str = "rec_no", body: str = "body", id_names: list[str] = ID_NAMES):
        self.id_names = id_names
        self.src = records.select(F.col(series).alias("series"), F.col(file).alias("file"), F.col(at).alias("at"), F.col(rec).cast("string").alias("rec"), F.col(body).alias("body"))
        fields = read_schemas(self.src.select("series", "file", "at", "body")).groupBy("series", "file", "field").agg(F.min("at").alias("at"), F.bit_or("bits").alias("bits"))
        entry = F.when(F.col("field").isNotNull(), F.struct("field", "bits"))
        files = fields.groupBy("series", "file").agg(F.min("at").alias("at"), F.sort_array(F.collect_list(entry)).alias("fields"))
        order = [F.col("at").asc_nulls_first(), F.col("file").asc_nulls_first()]
        ordered = numbered(files, ["series"], order, "n", {"before": F.struct("file", "fields")})
        typed = lambda c: F.transform(c, lambda x: F.struct(x["field"].alias("field"), lattice_type(x["bits"]).alias("type")))
        named = lambda c: F.transform(c, lambda x: x["field"])
        other = ordered.withColumn("now", F.when(F.col("n") > 1, F.array_except(typed("fields"), typed("before.fields"))))
        other = other.withColumn("was", F.when(F.col("n") > 1, F.array_except(typed("before.fields"), typed("fields"))))
        both = F.array_intersect(named("was"), named("now"))
        pair = lambda f: F.struct(f.alias("field"), *(F.filter(c, lambda x: x["field"] == f)[0]["type"].alias(c) for c in ("was", "now")))
        compared = other.withColumn("both", both).select(
            F.monotonically_increasing_id().alias("p"), "series", "file", "n", F.col("before.file").alias("prev"), "fields",
            F.filter("was", lambda x: ~F.array_contains("both", x["field"])).alias("gone"),
            F.filter("now", lambda x: ~F.array_contains("both", x["field"])).alias("new"),
            F.transform("both", pair).alias("retyped"),
        )
        table = Cut(compared, "files", "size(gone) > 0 AND size(new) > 0")
        #: (p, series, file, n, prev, fields, gone, new, retyped): each file, its fields (field, bits) in order, and how it differs from the one before
        self.files = table.df
        self.n_moved = table.counted

    @property
    def schemas(self) -> DataFrame:
        """(series, file, field, type, bits): each file's schema."""
        return self.files.select("series", "file", F.explode("fields").alias("f")).select("series", "file", "f.field", lattice_type(F.col("f.bits")).alias("type"), "f.bits")

    def _moved_records(self) -> DataFrame:
        """(rec, body, sides) of the records of files beside which fields both came and went; sides (as JSON, the same for all of a file): for which pair p, whether as its later file, and the fields that moved there."""
        moved = self.files.where("size(gone) > 0 AND size(new) > 0")
        names = lambda c: F.transform(c, lambda x: x["field"])
        later = moved.select("series", "file", F.struct("p", F.lit(True).alias("now"), names("new").alias("fields")).alias("side"))
        former = moved.select("series", F.col("prev").alias("file"), F.struct("p", F.lit(False).alias("now"), names("gone").alias("fields")).alias("side"))
        # a file is at most once the later and once the former one
        sides = later.unionByName(former).groupBy(F.col("series").alias("_s"), F.col("file").alias("_f")).agg(F.collect_list("side").alias("sides"))
        on = F.col("series").eqNullSafe(F.col("_s")) & F.col("file").eqNullSafe(F.col("_f"))
        return cut(self.src.select("series", "file", "rec", "body").join(sides, on).select("rec", "body", F.to_json("sides").alias("sides")), "moved")

    def _aligning(self, moved: DataFrame) -> DataFrame:
        """(p, field, prev_field): by which fields the records of two files are aligned.

        Of all pairs of fields (one of each file) the one with most texts in common, where a text counts in full if it names one record in
        either file, less if it names two, and not if it names more, as a type does; known names of ids decide ties, then equal names.
        Workers fold batches to distinct texts with three of their records at most, so a text of a third of all records is no hot key.
        """
        schema = "p long, h long, now boolean, field string, rec string"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _any_digits()
            read = lru_cache(10_000)(json.loads)
            for b in batches:
                seen: dict[tuple, set[str]] = {}
                for rec, body, sides in zip(*(c.to_pylist() for c in b.columns)):
                    sides = read(sides)
                    texts = [(int.from_bytes(_digest(v)[:8], signed=True), k) for k, v in (_record(body) or {}).items() if isinstance(v, str) and not isinstance(v, _Fraction)]
                    for side in sides:
                        for h, k in texts:
                            recs = seen.setdefault((side["p"], h, side["now"], k), set())
                            if len(recs) <= REPEATED:
                                recs.add(rec or "")
                rows = [(*key, rec) for key, recs in seen.items() for rec in recs]
                types = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, types)], ["p", "h", "now", "field", "rec"])

        each = moved.mapInArrow(run, schema).repartition("p", "h").groupBy("p", "h", "now", "field", "rec").agg(F.lit(0))
        few = each.groupBy("p", "h", "now", "field").agg(F.count("*").alias("k")).where(F.col("k") <= REPEATED)
        named = F.struct("field", "k")
        common = few.groupBy("p", "h").agg(F.collect_list(F.when(F.col("now"), named)).alias("a"), F.collect_list(F.when(~F.col("now"), named)).alias("b"))
        pairs = common.where("size(a) > 0 AND size(b) > 0").select("p", F.explode("a").alias("a"), "b").select("p", "a", F.explode("b").alias("b"))
        pairs = pairs.select("p", F.col("a.field").alias("field"), F.col("b.field").alias("prev_field"), (REPEATED**2 / (F.col("a.k") * F.col("b.k"))).cast("bigint").alias("w"))
        known = F.col("field").isin(self.id_names) & F.col("prev_field").isin(self.id_names)
        score = F.struct("n", known.alias("known"), (F.col("field") == F.col("prev_field")).alias("same"), "field", "prev_field")
        best = pairs.groupBy("p", "field", "prev_field").agg(F.sum("w").alias("n")).groupBy("p").agg(F.max(score).alias("m"))
        return best.select("p", "m.field", "m.prev_field")

    def _said(self, moved: DataFrame) -> DataFrame:
        """(p, node, i, now, said): what the files say of each node in the i-th field that went or came, each once. A node is a text of the aligning field."""
        side = F.from_json("sides", "array<struct<p:long,now:boolean,fields:array<string>>>")
        one = moved.select("body", F.explode(side).alias("s")).select("body", "s.*").join(self._aligning(moved), "p")
        key = F.when(F.col("now"), F.col("field")).otherwise(F.col("prev_field"))
        one = one.select(F.to_json(F.struct("p", "now", "fields", key.alias("key"))).alias("side"), "body")
        schema = "p long, node binary, i int, now boolean, said binary"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _any_digits()
            read = lru_cache(10_000)(json.loads)
            for b in batches:
                seen: dict[tuple, None] = {}
                for side, body in zip(*(c.to_pylist() for c in b.columns)):
                    side, record = read(side), _record(body) or {}
                    p, now, name = side["p"], side["now"], record.get(side["key"])
                    if not isinstance(name, str) or isinstance(name, _Fraction):
                        continue
                    node = _digest(name)
                    for i, f in enumerate(side["fields"]):
                        if (v := record.get(f)) is not None:
                            seen[p, node, i, now, _digest(_as_text(v))] = None
                types = [pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*seen)) or [()] * 5, types)], ["p", "node", "i", "now", "said"])

        return one.mapInArrow(run, schema)

    @cached_property
    def renames(self) -> DataFrame | None:
        """(p, moves): for pairs of files, which field that went (number i of gone) came back as which (number j of new); None if no fields both came and went anywhere."""
        if not self.n_moved:
            return None
        said = self._said(self._moved_records())
        of = lambda now: F.collect_set(F.when(F.col("now") if now else ~F.col("now"), F.col("i")))
        values = said.groupBy("p", "node", "said").agg(of(False).alias("a"), of(True).alias("b"))
        entry = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
        none = F.lit(-1)
        # of each node: the fields that went (i, -1), that came (-1, j), and that say the same (i, j); at most as many as there are fields and pairs of them
        entries = F.concat(
            F.transform("a", lambda i: entry(i, none)), F.transform("b", lambda j: entry(none, j)), F.flatten(F.transform("a", lambda i: F.transform("b", lambda j: entry(i, j))))
        )
        nodes = cut(values.select("p", "node", F.explode(entries).alias("e")).groupBy("p", "node").agg(F.collect_set("e").alias("es")), "nodes")
        # only pairs of fields that agree anywhere are counted further
        agree = nodes.select("p", F.explode(F.filter("es", lambda e: (e["i"] >= 0) & (e["j"] >= 0))).alias("e")).groupBy("p").agg(F.collect_set("e").alias("cs"))
        has = lambda i, j: F.array_contains("es", entry(i, j))
        met = nodes.join(agree, "p").select("p", "es", F.explode(F.filter("cs", lambda c: has(c["i"], none) & has(none, c["j"]))).alias("c"))
        counted = met.groupBy("p", "c").agg(F.count("*").alias("met"), F.count_if(F.array_contains("es", F.col("c"))).alias("same")).where("2 * same > met")
        # a pair of fields counts if neither has a better partner; fields are numbered in the order of their names
        grade = F.struct((F.col("same") / F.col("met")).alias("share"), F.col("same"), F.col("c.i").alias("i"), F.col("c.j").alias("j"))
        better = lambda y, x, k: (y["share"] > x["share"]) | ((y["share"] == x["share"]) & ((y["same"] > x["same"]) | ((y["same"] == x["same"]) & (y[k] < x[k]))))
        beaten = lambda x, same, k: F.exists("gs", lambda y: (y[same] == x[same]) & better(y, x, k))
        picked = counted.groupBy("p").agg(F.collect_list(grade).alias("gs")).select("p", F.filter("gs", lambda x: ~beaten(x, "i", "j") & ~beaten(x, "j", "i")).alias("gs"))
        return cut(picked.select("p", F.transform("gs", lambda x: entry(x["i"], x["j"])).alias("moves")), "renames")

    def changes(self) -> DataFrame:
        """(series, file, n, change, field_before, field_after, type_before, type_after), the log of all changes; order it by series, n, change, fields."""
        files = self.files.where("n > 1")
        moves = F.array().cast("array<struct<i:int,j:int>>")
        if self.renames is not None:
            files = files.join(self.renames, "p", "left")
            moves = F.coalesce("moves", moves)
        files = files.withColumn("moves", moves)
        none, nul = F.lit(""), F.lit(None).cast("string")

        def row(change: str, before: Column, after: Column, type_before: Column, type_after: Column) -> Column:
            return F.struct(F.lit(change).alias("change"), before.alias("field_before"), after.alias("field_after"), type_before.alias("type_before"), type_after.alias("type_after"))

        def moved(change: str, keep: list[Column] | Column) -> Column:
            old, new = (lambda m: F.col("gone")[m["i"]]), (lambda m: F.col("new")[m["j"]])
            return F.transform(keep, lambda m: row(change, old(m)["field"], new(m)["field"], old(m)["type"], new(m)["type"]))

        left = lambda c, k: F.filter(c, lambda _, at: ~F.exists("moves", lambda m: m[k] == at))
        log = F.concat(
            F.transform("retyped", lambda x: row("retyped", x["field"], x["field"], x["was"], x["now"])),
            F.transform(left("new", "j"), lambda x: row("added", none, x["field"], nul, x["type"])),
            F.transform(left("gone", "i"), lambda x: row("removed", x["field"], none, x["type"], nul)),
            moved("renamed", F.col("moves")),
            moved("retyped", F.filter("moves", lambda m: F.col("gone")[m["i"]]["type"] != F.col("new")[m["j"]]["type"])),
        )
        return files.select("series", "file", "n", F.explode(log).alias("c")).select("series", "file", "n", "c.*")

    def columns(self) -> list[dict]:
        """The columns of the consistent table: name, fields (the names it had), types seen, type, and whether values needed a wider type than the lattice's.

        Works on names and types, of which there are as many as columns. Renamed fields share a name, unless two of the names stand side by
        side in a file. No value is lost to a type: integers of more than 38 digits, mixtures with integers that a double may not hold, and
        fractions that a double doesn't hold become text.
        """
        per = self.schemas.groupBy("field").agg(F.bit_or("bits").alias("bits"), F.count("*").alias("n")).collect()
        renames, together = [], []
        if self.renames is not None:
            pair = F.explode(F.transform("moves", lambda m: F.struct(F.col("gone")[m["i"]]["field"].alias("a"), F.col("new")[m["j"]]["field"].alias("b")))).alias("r")
            renames = self.files.join(self.renames, "p").select(pair).select("r.*").distinct().collect()
            # only names that a renaming could join are looked for side by side
            some = F.array(*(F.lit(x) for x in sorted({x for r in renames for x in r}))).cast("array<string>")
            here = F.array_intersect(F.transform("fields", lambda x: x["field"]), some)
            side = F.flatten(F.transform(here, lambda x: F.transform(F.filter(here, lambda y: x < y), lambda y: F.struct(x.alias("x"), y.alias("y")))))
            together = self.files.select(F.explode(side).alias("s")).select("s.*").distinct().collect()
        name = canonical_names({r.field: r.n for r in per}, [tuple(r) for r in renames], {tuple(r) for r in together})
        out: dict[str, dict] = {}
        for r in sorted(per, key=lambda r: r.field):
            c = out.setdefault(name[r.field], {"name": name[r.field], "fields": [], "bits": 0})
            c["fields"].append(r.field)
            c["bits"] |= r.bits
        for c in out.values():
            bits = c.pop("bits")
            c["types"] = [t for t, b in TYPE_BITS.items() if bits & b]
            kind = {0: "null", 1: "boolean", 2: "integer", 4: "fraction", 6: "fraction", 16: "list", 32: "object"}.get(bits & TYPES, "string")
            c["widened"] = (kind == "integer" and bool(bits & LONG)) or (kind == "fraction" and bool(bits & FINE or (bits & 2 and bits & WIDE)))
            c["type"] = "string" if c["widened"] else kind
        return [out[n] for n in sorted(out)]


#: Column types of the consistent table.
_SQL_TYPES = {"null": "string", "boolean": "boolean", "integer": "decimal(38,0)", "fraction": "double", "string": "string", "list": "string", "object": "string"}


def canonical_names(n_files: dict[str, int], renames: list[tuple[str, str]], together: set[tuple[str, str]]) -> dict[str, str]:
    """The name under which each field stands in the consistent table: of the names that renamings join, that of most files.

    Names that stand side by side in a file are never joined, so no record has two values for one column.
    """
    parent = {f: f for f in n_files}

    def find(x: str) -> str:
        while parent[x] != x:
            x = parent[x]
        return x

    members = {f: {f} for f in parent}
    for a, b in sorted(renames):
        x, y = find(a), find(b)
        if x == y or any((p, q) in together or (q, p) in together for p in members[x] for q in members[y]):
            continue
        keep, drop = sorted((x, y), key=lambda f: (-n_files[f], f))
        parent[drop] = keep
        members[keep] |= members.pop(drop)
    return {f: find(f) for f in parent}


def consistent_table(records: DataFrame, drift: Drift, keep: list[str], body: str = "body") -> DataFrame:
    """All readable records in one table: the columns keep, and one column for each field, renamed fields under one name, in the type that holds all of its values (Drift.columns).

    Lists and objects are their JSON text. A name that a kept column has already gets the suffix ``_field``, as often as needed.
    """
    read = read_fields(records, keep, body).withColumn("_m", F.map_from_entries(F.transform("fields", lambda f: F.struct(f["field"], f["text"]))))
    columns, used = [], {c.lower() for c in keep}
    for c in drift.columns():
        text = F.coalesce(*(F.col("_m")[f] for f in c["fields"]))
        out = c["name"]
        while out.lower() in used:
            out += "_field"
        used.add(out.lower())
        sql = _SQL_TYPES[c["type"]]
        columns.append((text if sql == "string" else text.try_cast(sql)).alias(out))
    return read.select(*keep, *columns)

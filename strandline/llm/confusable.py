"""One form for texts that look the same (problem 8).

A text's form is found in two steps. The skeleton undoes what can't be seen: characters that show nothing are dropped, blanks of other width
become a blank, wide, narrow and joined letters are taken apart, accents are composed with their letter, and letters of different alphabets
that are drawn alike become one of them, by the public table of confusable characters. Then each word is spelled in the script that it can be
written in as a whole: the scripts of its letters are intersected, where a letter with look-alikes counts for all their scripts. A word with no
common script is mixed and stays as in the skeleton; one that several alphabets can spell in letters of common use (a whole-script confusable)
takes the script of the nearest word that has only one. Japanese words have several scripts by nature; there neighbours decide letter by
letter. The second step depends on nothing but the skeleton and each of its letters leads back to it, so two forms are equal exactly if the
skeletons are; what it undoes is listed by ``tokens``.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zipfile
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from glob import glob
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.materialize import cut
from strandline.operators.spread import over_cores

# Where the public table is not followed. Letters that are drawn like the Latin one, whatever it says; and two that are told apart from r and w.
DRAWN_LIKE, NOT_DRAWN_LIKE = {"Ӏ": "I", "Ԛ": "Q", "ӏ": "l", "ԝ": "w"}, {"г", "ѡ"}
#: Joined letters that are taken apart, besides those of the block of ligatures.
JOINED = {"ĳ": "ij", "Ĳ": "IJ", "ǆ": "dž", "ǅ": "Dž", "Ǆ": "DŽ", "ǉ": "lj", "ǈ": "Lj", "Ǉ": "LJ", "ǌ": "nj", "ǋ": "Nj", "Ǌ": "NJ"}
#: Blocks of characters that are several letters in a row: ligatures, Roman numbers, units.
IN_A_ROW = (range(0xFB00, 0xFB18), range(0x2160, 0x2180), range(0x3371, 0x3380), range(0x3380, 0x3400))
#: Characters of no width outside the format category: joiners of marks, fillers of syllables, variation selectors.
NO_WIDTH = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
#: Format characters that are drawn: signs that stand around numbers.
DRAWN = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}
#: Control characters that break lines or advance; all others show nothing.
KEPT_CONTROLS = "\t\n\x0b\x0c\r\x85"
JOINER = "‍"
#: Letters of common use, by script: a word that several scripts can spell is spelled in one only with these.
COMMON = {"Latin": "A-Za-zÀ-ÖØ-öø-ÿŒœ", "Cyrillic": "А-яЁё", "Greek": "Α-Ωα-ω", "Armenian": "Ա-Ֆա-և"}
#: Writing systems of several scripts.
TOGETHER = {"Han": ("Japanese", "Hanb", "Korean"), "Hiragana": ("Japanese",), "Katakana": ("Japanese",), "Hangul": ("Korean",), "Bopomofo": ("Hanb",)}
SYSTEMS = frozenset(x for v in TOGETHER.values() for x in v)
#: Words that a Python worker remembers.
REMEMBERED = 200_000


def confusables(jar: str | None = None) -> dict[str, str]:
    """Unicode's table of confusable characters (character to prototype), as the ICU library has it that Spark comes with.

    jar: the library; without it the one among Spark's own. The file's layout is public: keys of 32 bits (code point, and length less one in
    the highest byte), their values of 16 bits (a UTF-16 unit, or for longer ones a place in the string table), the string table.
    """
    if jar is None:
        import pyspark

        found = [j for home in (os.environ.get("SPARK_HOME", ""), os.path.dirname(pyspark.__file__)) for j in sorted(glob(f"{home}/jars/icu4j-*.jar"))]
        if not found:
            raise FileNotFoundError("no icu4j library among Spark's; name one")
        jar = found[0]
    with zipfile.ZipFile(jar) as z:
        data = z.read(next(n for n in z.namelist() if n.endswith("/confusables.cfu")))
    end = ">" if data[8] else "<"
    data = data[struct.unpack(">H", data[:2])[0] :]
    head = struct.unpack(f"{end}16I", data[:64])
    part = lambda at, n, kind: struct.unpack_from(f"{end}{n}{kind}", data, at)
    keys, values, strings = part(head[3], head[4], "I"), part(head[5], head[6], "H"), part(head[7], head[8], "H")
    out = {}
    for k, v in zip(keys, values):
        n = (k >> 24) + 1
        units = [v] if n == 1 else strings[v : v + n]
        out[chr(k & 0xFFFFFF)] = struct.pack(f"<{len(units)}H", *units).decode("utf-16-le")
    return out


def _is_letter(c: str) -> bool:
    return unicodedata.category(c)[0] == "L"


def _in_an_alphabet(c: str) -> bool:
    """A letter of its own, no modifier and no sign of length."""
    return unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lo")


def _script_ranges() -> tuple[list[int], list[frozenset[str]]]:
    """Where runs of letters of the same script sets begin, and the sets, by Unicode's script extensions."""
    import regex

    letters = "".join(c for c in map(chr, range(0x110000)) if _is_letter(c))
    sets: dict[str, set[str]] = defaultdict(set)
    names = set()
    for c in letters:
        words = unicodedata.name(c, "").replace("-", " ").split()
        names |= {"_".join(words[:n]) for n in (1, 2, 3)}
    for name in sorted(names | {"Han", "Common", "Inherited"}):
        try:
            of = regex.compile(rf"\p{{scx={name}}}")
        except regex.error:
            continue
        for c in of.findall(letters):
            sets[c].add("Han" if name == "Han" else name.title())
    starts, runs = [0], [frozenset()]
    for c in letters:
        s = frozenset(sets[c]) - {"Common", "Inherited"}
        if s != runs[-1]:
            starts.append(ord(c))
            runs.append(s)
    return starts, runs


class Word(NamedTuple):
    """What a word of a skeleton can be: its spellings by script in letters of common use, the one script that is left (None: several or none), and whether no script is common to its letters."""

    spellings: dict[str, str]
    script: str | None
    mixed: bool


_WORD = re.compile(r"(?:[^\W\d_][\u0300-\u036f\u3099\u309a]*)+")
_JAPANESE = "Japanese"


class Alike:
    """The tables, and what is made with them. Built where the query is planned and sent to the workers; its size is that of Unicode's tables."""

    def __init__(self, jar: str | None = None):
        self.first = self._shown()
        self.starts, self.runs = _script_ranges()
        self.words: dict[str, Word] = {}
        table = confusables(jar)
        prototype = lambda c: unicodedata.normalize("NFD", "".join(table.get(x, x) for x in unicodedata.normalize("NFD", c)))
        classes: dict[str, set[str]] = defaultdict(set)
        for c in {*table, *table.values(), *map(chr, range(128))}:
            # letters of one character each; what is taken apart before needs no look-alike
            if len(c) == 1 and _in_an_alphabet(c) and ord(c) not in self.first and unicodedata.normalize("NFD", c) == c and c not in DRAWN_LIKE and c not in NOT_DRAWN_LIKE and len(p := prototype(c)) == 1:
                classes[p].add(c)
        #: letter to the letter it is taken for
        self.alike: dict[int, str] = {}
        #: script to (letter of the skeleton to the script's letter)
        self.spell: dict[str, dict[int, str]] = defaultdict(dict)
        #: letter of the skeleton to the scripts that have it or a look-alike
        self.can: dict[str, frozenset[str]] = {}
        own: dict[tuple, str] = {}
        for p, members in sorted(classes.items()):
            own |= {(script, p): p for script in self.scripts_of(p)}
            plain = sorted(c for c in members if c.isascii())
            kind = lambda c: 1 if c.isupper() else 2 if c.islower() else 0
            for c in sorted(members, key=lambda c: (kind(c) == 0, c)):
                target = next((x for x in plain if kind(x) == kind(c)), p if not plain or p in plain else plain[0])
                # syllables of Hangul are written as a whole, their parts are no letters
                if c.isascii() or c == target or not _in_an_alphabet(target) or "Hangul" in self.scripts_of(c):
                    continue
                for script in self.scripts_of(c):
                    # two letters of one alphabet are different letters; only Latin has letters that are variants of others
                    if own.setdefault((script, target), c) == c or script == "Latin":
                        self.alike[ord(c)] = target
                        if script != "Latin":
                            self.spell[script].setdefault(ord(target), c)
        for c, to in DRAWN_LIKE.items():
            self.alike[ord(c)] = to
            for script in self.scripts_of(c):
                self.spell[script].setdefault(ord(to), c)
        targets = set(self.alike.values())
        for t in targets:
            self.can[t] = self._systems(self.scripts_of(t) | {s for s, x in self.spell.items() if ord(t) in x})
        # what no word loop is needed without: letters that aren't in common use in Latin texts
        rare = "".join(t for t in sorted(targets) if ord(t) < 0x250 and not _common("Latin").fullmatch(t))
        self.foreign = re.compile(rf"[^\x00-\u024f\u0300-\u036f\u1e00-\u1eff\u2000-\u2bff]|[{rare}]")
        kana = "".join(t for t in targets if ord(t) in self.spell["Katakana"] and "Han" in self.scripts_of(t))
        self.voiced = re.compile(rf"[{kana}](?=[\u3099\u309a])")

    @staticmethod
    def _shown() -> dict[int, str | None]:
        """Characters that show nothing, blanks, and letters in other forms."""
        first: dict[int, str | None] = {}
        for cp in range(0x110000):
            c = chr(cp)
            kind = unicodedata.category(c)
            if (kind == "Cf" and cp not in DRAWN and c != JOINER) or (kind == "Cc" and c not in KEPT_CONTROLS):
                first[cp] = None
            elif (kind == "Zs" and cp != 0x1680) or cp == 0x2800:
                first[cp] = " "
            elif (d := unicodedata.decomposition(c)).startswith(("<wide>", "<narrow>", "<noBreak>", "<font>")) or (d and any(cp in r for r in IN_A_ROW)) or cp == 0xB5:
                first[cp] = "".join(chr(int(x, 16)) for x in d.split() if x[0] != "<")
        first[0xFB05] = "st"
        for c, plain in JOINED.items():
            first[ord(c)] = plain
        for cp in NO_WIDTH:
            first[cp] = None
        return first

    def scripts_of(self, c: str) -> frozenset[str]:
        """The scripts that have a letter; none for letters of all scripts."""
        return self.runs[bisect_right(self.starts, ord(c)) - 1] if _is_letter(c) else frozenset()

    @staticmethod
    def _systems(scripts: frozenset[str] | set[str]) -> frozenset[str]:
        return frozenset(scripts).union(*(TOGETHER.get(s, ()) for s in scripts))

    def shown(self, text: str) -> str:
        """The text without what can't be seen, its accents apart, in the letters it has."""
        text = text.translate(self.first)
        if JOINER in text:
            text = _joiners(text)
        return unicodedata.normalize("NFD", text)

    def bare(self, plain: str) -> str:
        """The skeleton, accents apart, of a text as shown; as long as that."""
        out = plain.translate(self.alike)
        # only kana have voice marks
        return self.voiced.sub(lambda m: self.spell["Katakana"][ord(m[0])], out) if "\u3099" in out or "\u309a" in out else out

    def skeleton(self, text: str) -> str:
        return unicodedata.normalize("NFC", self.bare(self.shown(text)))

    def common(self, letters: Iterator[frozenset[str]]) -> frozenset[str] | None:
        """The intersection of script sets; None if there are none."""
        found = None
        for s in letters:
            if s:
                found = s if found is None else found & s
        return found

    def word(self, w: str) -> Word:
        known = self.words.get(w)
        if known is None:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            known = self.words[w] = self._word(w)
        return known

    def _word(self, w: str) -> Word:
        found = self.common(self.can.get(c) or self._systems(self.scripts_of(c)) for c in w)
        if not found:
            # a mixed word keeps the skeleton's letters, but for Japanese ones beside Latin
            japanese = any(_JAPANESE in self._systems(self.scripts_of(c)) for c in w)
            return Word({"Latin": self._japanese(w)} if japanese else {}, None, found is not None)
        spellings = {}
        for s in found - SYSTEMS:
            spelling = w.translate(self.spell[s]) if s in self.spell else w
            if s not in COMMON or _common(s).fullmatch(spelling):
                spellings[s] = spelling
        if _JAPANESE in found and not found - SYSTEMS:
            spellings = {_JAPANESE: self._japanese(w)}
        # scripts that no text here need be in don't make a word ambiguous beside the alphabets in common use
        usual = [s for s in spellings if s in COMMON or s in TOGETHER or s == _JAPANESE]
        one = usual if len(usual) == 1 else list(spellings) if len(spellings) == 1 else []
        return Word(spellings, one[0] if one else None, False)

    def _japanese(self, w: str) -> str:
        """Letters that two scripts have take that of their neighbours on both sides (of one, at an end); between different ones they are Katakana rather than Han."""
        own = [None if c in self.can else "Katakana" if c == "ー" else next(iter(s)) if len(s := self.scripts_of(c)) == 1 else None for c in w]
        out = list(w)
        for i, c in enumerate(w):
            if c in self.can:
                left = next((s for s in reversed(own[:i]) if s), None)
                right = next((s for s in own[i + 1 :] if s), None)
                s = left if left == right or right is None else right if left is None else "Katakana" if "Katakana" in (left, right) and "Han" in self.can[c] else None
                if s and s in self.can[c]:
                    out[i] = self.spell.get(s, {}).get(ord(c), c)
        return "".join(out)

    def spelled(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(begin, end, spelling) of the words of a skeleton with its accents apart that are spelled in other letters in the form."""
        words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
        chosen = [self.word(w) for _, _, w in words]
        near: list[tuple[int, str | None]] = [(1 << 62, None)] * len(words)
        for order, edge in ((range(len(words)), 1), (range(len(words) - 1, -1, -1), 0)):
            last = None
            for i in order:
                if chosen[i].script is not None:
                    last = (words[i][edge], chosen[i].script)
                elif last is not None and len(chosen[i].spellings) > 1:
                    d = words[i][0] - last[0] if edge else last[0] - words[i][1]
                    if d < near[i][0]:
                        near[i] = (d, last[1])
        for (a, b, w), c, (_, by) in zip(words, chosen, near):
            spelling = c.spellings.get(c.script or by or "Latin")
            if spelling is not None and spelling != w:
                yield a, b, spelling

    def form(self, text: str) -> str:
        bare = self.bare(self.shown(text))
        if self.foreign.search(bare):
            out, at = [], 0
            for a, b, s in self.spelled(bare):
                out += [bare[at:a], s]
                at = b
            bare = "".join(out) + bare[at:]
        return unicodedata.normalize("NFC", bare)

    def odd(self, text: str) -> Iterator[tuple[str, str, list[str], str, int]]:
        """(token, kind, scripts, form, n): the words that no one script can write as they stand (mixed), and those in one script that the form spells in another (whole)."""
        plain = self.shown(text)
        bare = self.bare(plain)
        changed = {(a, b): s for a, b, s in self.spelled(bare)}
        seen: Counter = Counter()
        for m in _WORD.finditer(bare):
            token = plain[m.start() : m.end()]
            if not token.isascii():
                seen[token, changed.get(m.span(), m[0])] += 1
        for (token, form), n in seen.items():
            sets = [self.scripts_of(c) for c in token]
            systems = [self._systems(s) for s in sets]
            # Latin beside Japanese, Chinese or Korean is usual
            mixed = self.common(systems) == frozenset() and not (self.common(s for s in systems if "Latin" not in s) or frozenset()) & SYSTEMS
            if mixed or (form != token and self._moved(token, form)):
                scripts = sorted(set().union(*sets))
                yield unicodedata.normalize("NFC", token), "mixed" if mixed else "whole", scripts, unicodedata.normalize("NFC", form), n

    def _moved(self, token: str, form: str) -> bool:
        """Whether the form is in other scripts than the token, not only in variants of its letters."""
        return any(not self._systems(a) & self._systems(b) for a, b in zip(map(self.scripts_of, token), map(self.scripts_of, form)) if a and b)


@cache
def _common(script: str) -> re.Pattern:
    return re.compile(rf"[{COMMON[script]}\u0300-\u036f]*")


@cache
def alike() -> Alike:
    return Alike()


def _pictograph(c: str) -> bool:
    return ord(c) >= 0x1F000 or 0x2190 <= ord(c) <= 0x2BFF


def _joiners(text: str) -> str:
    """Joiners make one picture of two pictographs; anywhere else they show nothing."""
    parts = text.split(JOINER)
    out = parts[0]
    kept = [out]
    for p in parts[1:]:
        if out and p and _pictograph(out[-1]) and _pictograph(p[0]):
            kept.append(JOINER)
        kept.append(p)
        out = p or out
    return "".join(kept)


def one_form(text: str) -> str:
    """The consistent form of a text: equal for texts that look the same, different for others. Idempotent."""
    return alike().form(text)


#: A text of these characters only is its own form and never leaves the JVM.
PLAIN = r"\A[\t\n\x0B\f\r -~]*\z"


def forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(id, form[, text]) of every document; NULL stays NULL. Texts of plain ASCII are their own form; the others are formed in Arrow batches. No shuffle but of a scan's few partitions over all cores."""
    cols = [id_col, "text", "form"] if keep_text else [id_col, "form"]
    src = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    plain = F.coalesce(F.col("text").rlike(PLAIN), F.lit(True))
    schema = T.StructType([src.schema[id_col], T.StructField("text", T.StringType()), T.StructField("form", T.StringType())])
    tables = alike()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([tables.form(t) for t in b.column(1).to_pylist()], pa.string())], [*b.schema.names, "form"])

    return src.where(plain).withColumn("form", F.col("text")).select(*cols).unionByName(over_cores(src.where(~plain)).mapInArrow(run, schema).select(*cols))


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token, kind, scripts, form, n) of the suspicious words of every document, each word once with the number of times it stands there.

    kind ``mixed``: no script can write all its letters (Latin may stand beside Japanese, Chinese and Korean); ``whole``: it is in one script and its form in another. Words are runs of letters. NULL
    and ASCII texts have none.
    """
    src = docs.select(F.col(id_col), F.col(text_col).alias("text")).where(~F.col("text").rlike(PLAIN))
    rest = T._parse_datatype_string("token string, kind string, scripts array<string>, form string, n long")
    types = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int64()]
    tables = alike()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *r) for i, t in enumerate(b.column(1).to_pylist()) for r in tables.odd(t)]
            at, *cols = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types))], [id_col, *rest.names])

    return over_cores(src).mapInArrow(run, T.StructType([src.schema[id_col], *rest.fields]))


def _members(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(form, text, id) of the documents whose form several different texts have; form and text as hashes. NULL texts and texts that show nothing don't count."""
    key = lambda c: F.unhex(F.sha2(F.col(c), 256))
    shown = forms(docs, id_col, text_col, keep_text=True).where("form IS NOT NULL AND trim(BOTH '\t\n\u000b\f\r \u0085' FROM form) <> ''")
    keys = cut(shown.select(F.col(id_col).alias("id"), key("form").alias("form"), key("text").alias("text")), "forms")
    several = keys.groupBy("form").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("form")
    # rows of forms that have one text only, which are nearly all, end here
    return cut(keys.join(several, "form"), "members")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, text_id, n_links): the documents that look like one with another text, each once. class_id is the smallest id of all that look like it,
    text_id the smallest of those with the very same text, n_links the number of those with another text. Of linear size, however large a class is.
    """
    members = _members(docs, id_col, text_col)
    texts = members.groupBy("form", "text").agg(F.min("id").alias("text_id"), F.count("*").alias("n"))
    all_ = texts.groupBy("form").agg(F.min("text_id").alias("class_id"), F.sum("n").alias("n_all"))
    out = members.join(texts, ["form", "text"]).join(all_, "form")
    return out.select(F.col("id").alias(id_col), "class_id", "text_id", (F.col("n_all") - F.col("n")).alias("n_links"))


def same_looking(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b), a < b: the pairs of documents with different texts of one form. NULL texts and texts that show nothing don't count.

    Equal texts are brought to one class before anything is paired, so copies make no pairs among themselves; only classes of one form are
    paired, and only then the members are put in. The pairs of a large class are many: ``classes`` says the same in linear size.
    """
    members = _members(docs, id_col, text_col)
    texts = members.select("form", "text").distinct()
    pairs = texts.withColumnRenamed("text", "text_a").join(texts.withColumnRenamed("text", "text_b"), "form").where("text_a < text_b")
    a = members.select("form", F.col("text").alias("text_a"), F.col("id").alias("id_a"))
    b = members.select("form", F.col("text").alias("text_b"), F.col("id").alias("id_b"))
    found = pairs.join(a, ["form", "text_a"]).join(b, ["form", "text_b"])
    return found.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))

"""Section headers of scripts: which comment lines are headings, their level, and tables of contents left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.catalog import split_lines

# Header forms by language, the first that matches with a usable title counts.
_NUMBERED = r"(\d[\d.A-Za-z]*\.?\s+.+?)"
HEADERS = {
    "stata": [
        rf"^\s*\*+\s*{_NUMBERED}\s*\**\s*$",
        rf"^\s*\*+\s*[-=_~]{{2,}}\s*{_NUMBERED}\s*[-=_~]*\s*$",
        rf"^\s*//\s*{_NUMBERED}\s*$",
        r"^\s*/\*\s*[=\-*]{2,}\s*(.+?)\s*[=\-*]{2,}\s*\*/\s*$",
        r"^\s*\*{2,}\s*([A-Z][^*]{3,}?)\s*\**\s*$",
    ],
    "python": [
        r"^\s*#{2,}\s+(?!\[\d)(.+?)\s*#*\s*$",
        rf"^\s*#\s*[-=*]{{2,}}\s*{_NUMBERED}\s*[-=*]*\s*$",
        r"^#\s*[-=*]{2,}\s*([A-Z][^#]{3,}?)\s*[-=*]*\s*$",
    ],
    "r": [r"^\s*#+\s*(.+?)\s*[-=#]{4,}\s*$", r"^\s*#{2,}\s+(?!\[\d)(.+?)\s*#*\s*$", r"^#\s*[-=*]{2,}\s*(.+?)\s*[-=*]*\s*$"],
}
CELL = r"^\s*#\s*%%(?:\s+(.*?))?\s*$"
NOTEBOOK = r"^\s*#\s*In\[(\d*)\]:"
DECORATION = {"stata": r"^\s*(?:\*[*\-_=~.]{2,}|//\s*[*\-_=~.]{3,})\s*$", "python": r"^\s*#+\s*[*\-_=~.]{3,}\s*$", "r": r"^\s*#+\s*[*\-_=~.]{3,}\s*$"}
HEADER_COMMENT = {"stata": r"^\s*(?:\*|//)\s*\S", "python": r"^\s*#{2,}\s*\S", "r": r"^\s*#+\s*\S"}
TOC_WORDS = ["table of contents", "contents", " toc"]
#: Lines at the top that are searched for a table of contents, and the fewest header lines it has.
TOC_WITHIN, TOC_LEAST = 30, 3


def clean_title(raw: Column) -> Column:
    """Without decoration at the ends; NULL if nothing but punctuation is left."""
    t = F.regexp_replace(raw, r"(?U)^[*\-=_~#\s]+|[*\-=_~#\s]+$", "")
    return F.when((t != "") & ~t.rlike(r"(?U)^[\W_]+$"), t)


def level(title: Column) -> Column:
    """The number of dotted parts of a leading number, 3 at most; 1 without one."""
    n = F.regexp_extract(title, r"^([A-Za-z\d]+(?:\.[A-Za-z\d]+)*)\s*\.?\s", 1)
    return F.when(n == "", 1).otherwise(F.least(F.size(F.split(n, r"\.")), F.lit(3)))


def header(line: Column, language: str) -> Column:
    """The title of a header line; NULL for other lines."""
    titles = [F.when(line.rlike(rx), clean_title(F.regexp_extract(line, rx, 1))) for rx in HEADERS[language]]
    title = F.coalesce(*titles)
    if language == "python":
        cell = F.regexp_extract(line, CELL, 1)
        title = F.when(line.rlike(CELL), F.when(cell == "", "(untitled cell)").otherwise(cell)).when(line.rlike(NOTEBOOK), F.concat(F.lit("In["), F.regexp_extract(line, NOTEBOOK, 1), F.lit("]:"))).otherwise(title)
    return F.when(~line.rlike(DECORATION[language]), title)


def _by_language(language: Column, of: dict[str, Column]) -> Column:
    out = F.lit(None)
    for name, c in of.items():
        out = F.when(language == name, c).otherwise(out)
    return out


def toc_ends(lines: DataFrame, key: list[str]) -> DataFrame:
    """(key, toc_end): the last line of the first run of header comments near the top that speaks of contents. Blank lines don't break a run.

    Runs are islands between breaking lines, numbered by a running count over at most TOC_WITHIN lines a script.
    """
    top = lines.where(F.col("line") <= TOC_WITHIN)
    is_header = F.coalesce(_by_language(F.col("language"), {k: F.col("text").rlike(v) for k, v in HEADER_COMMENT.items()}), F.lit(False))
    marked = top.withColumn("_h", is_header).where(F.col("_h") | (F.trim("text") != ""))
    run = F.count_if(~F.col("_h")).over(Window.partitionBy(*key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    runs = marked.withColumn("_run", run).where("_h").groupBy(*key, "_run").agg(F.count("*").alias("_n"), F.max("line").alias("_end"), F.sort_array(F.collect_list(F.struct("line", F.trim("text").alias("t")))).alias("_t"))
    said = F.lower(F.array_join(F.transform("_t", lambda x: x["t"]), " "))
    speaks = F.exists(F.array(*map(F.lit, TOC_WORDS)), lambda w: F.contains(said, w))
    return runs.where((F.col("_n") >= TOC_LEAST) & speaks).groupBy(*key).agg(F.min("_end").alias("toc_end"))


def sections(docs: DataFrame, key: list[str], language: Column, text: str = "text") -> DataFrame:
    """(key, line, level, title) of the headers of each script. Of equal titles in a script the last stays; headers in a table of contents are dropped.

    language is 'stata', 'python' or 'r'; scripts of other languages and NULL texts give none.
    """
    lines = split_lines(docs.withColumn("language", language), [*key, "language"], text)
    title = _by_language(F.col("language"), {k: header(F.col("text"), k) for k in HEADERS})
    found = lines.withColumn("title", title).where("title IS NOT NULL").select(*key, "line", level(F.col("title")).alias("level"), "title")
    found = found.join(toc_ends(lines, key), key, "left").where("toc_end IS NULL OR line > toc_end")
    last = found.groupBy(*key, F.trim("title").alias("_t")).agg(F.max(F.struct("line", "level", "title")).alias("m"))
    return last.select(*key, "m.line", "m.level", "m.title")

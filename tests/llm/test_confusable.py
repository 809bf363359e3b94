from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandline.llm.confusable import alike, classes, confusables, forms, one_form, same_looking, tokens

SAME = [
    ("Tһе pаrԛuеt fіӏе", "The parquet file"),
    ("ﬁne ｗｉｄｅ　x", "fine wide x"),
    ("café", "café"),
    ("ze​ro ­⁠﻿️!", "zero !"),
    ("a b c d", "a b c d"),
    ("ΝΟΤ ο ν օ", "NOT o v o"),
    ("ｶﾞ", "ガ"),
    ("й", "й"),
    ("роst", "post"),
    # Greek, variants and phonetic letters, Armenian, Cherokee, Lisu, Coptic, Roman numbers, mathematical letters, units
    ("αρυ", "apu"),
    ("µm", "μm"),
    ("ɑı", "ai"),
    ("ո", "n"),
    ("ᎪꓐⲞ", "ABO"),
    ("ⅼ Ⅷ", "l VIII"),
    ("𝐀𝑏", "Ab"),
    ("㎏", "kg"),
    ("口", "ロ"),
    ("Ӏ", "I"),
    ("ѵԝһ", "vwh"),
]
DIFFERENT = [("a", "A"), ("é", "e"), ("1", "l"), ("0", "O"), ("a b", "a\nb"), ("a-b", "a_b"), ("½", "1/2"), ("œ", "oe"), ("a b", "a  b"), ("ж", "x"), ("…", "..."), ("²", "2"), ("👩‍💻", "👩💻"), ("\r\n", "\n"), ("г", "r"), ("σ", "o"), ("ß", "ss"), ("I", "l"), ("З", "3"), ("’", "'"), ("rn", "m"), ("ш", "щ"), ("ハ", "バ"), ("к", "k"), ("一", "ー")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_looking_texts_have_one_form(a, b):
    assert one_form(a) == one_form(b) == one_form(one_form(a))


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different_looking_texts_keep_different_forms(a, b):
    assert one_form(a) != one_form(b)


def test_words_are_spelled_in_one_script():
    # the Latin a and o in a Russian sentence become Cyrillic, the Cyrillic ones in an English word Latin
    assert one_form("в лесу óса растёт csv") == one_form("в лесу о́са растёт csv")
    assert one_form("вecна") == "весна"
    assert one_form("ѕurvеу") == "survey"
    assert one_form("лес а рост") == "лес а рост"


def test_japanese_words_keep_their_letters():
    for text in ("エラーをサーバーへ送信する", "入口と人口、工場のデータ", "xlsxに関するデータ", "データxlsx", "データ一覧とパラメーター", "一方"):
        assert one_form(text) == text
    assert one_form("デー夕") == one_form("データ") == "データ"


def test_form_leads_back_to_the_skeleton(spark, sf_dir):
    a = alike()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").collect():
        form = a.form(r.text)
        assert a.form(form) == form
        assert a.skeleton(form) == a.skeleton(r.text)


def test_table_is_the_public_one():
    table = confusables()
    assert len(table) > 6000
    assert (table["а"], table["Α"], table["ﬁ"], table["m"]) == ("a", "A", "fi", "rn")


def test_suspicious_words(spark):
    docs = [(1, "рrојесt рrојесt, а project"), (2, "Москва сора"), (3, "xlsxに関するメモ naïve"), (4, None), (5, "plain"), (6, "буква а и csv")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("token", F.lit(1))
    got = {(r.doc_id, r.token, r.kind, tuple(r.scripts), r.form, r.n) for r in tokens(df.drop("token")).collect()}
    assert got == {(1, "рrојесt", "mixed", ("Cyrillic", "Latin"), "project", 2), (1, "а", "whole", ("Cyrillic",), "a", 1)}


def test_classes_say_what_pairs_say(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1, "copa"), (-2, "сора"), (-3, "copa"), (-4, "copа")], "doc_id long, text string")
    docs = docs.unionByName(more)
    rows = classes(docs).collect()
    links = Counter(x for r in same_looking(docs).collect() for x in (r.a, r.b))
    assert {r.doc_id: r.n_links for r in rows} == links
    assert {(r.doc_id, r.class_id, r.text_id, r.n_links) for r in rows if r.doc_id < 0} == {(-1, -4, -3, 2), (-2, -4, -2, 3), (-3, -4, -3, 2), (-4, -4, -4, 3)}
    assert classes(docs.limit(0)).collect() == []


def test_pairs(spark):
    docs = [(1, "copa"), (2, "сора"), (3, "copa"), (4, "Copa"), (5, None), (6, ""), (7, "​"), (8, " "), (9, "copa​"), (10, "other")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in same_looking(df).collect()} == {(1, 2), (1, 9), (2, 3), (2, 9), (3, 9)}
    assert same_looking(df.limit(0)).collect() == []
    got = {r.doc_id: r.form for r in forms(df).collect()}
    assert len(got) == 10
    assert got[5] is None
    assert got[2] == "copa"


def test_long_text_and_whole_table(spark, sf_dir):
    assert one_form("а" * 500_000 + "​") == "a" * 500_000
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    by_form = {}
    for i, t in texts.items():
        if t is not None and one_form(t).strip():
            by_form.setdefault(one_form(t), []).append(i)
    expected = {(min(a, b), max(a, b)) for v in by_form.values() for a in v for b in v if a < b and texts[a] != texts[b]}
    assert {tuple(r) for r in same_looking(docs).collect()} == expected

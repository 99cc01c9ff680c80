"""Folding of names against the library's normal forms, for every assigned code point and for decomposed names."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from oddsframe.functions import text as T

HANGUL = range(0xAC00, 0xD7A4)
ASSIGNED = [n for n in range(0x80, 0x110000) if unicodedata.category(chr(n)) not in ("Cn", "Cs", "Co", "Cc")]


def letters(s):
    return "".join(c for c in s if c.isalnum())


def folded(spark, texts, marks):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return {r["k"]: r["f"] for r in df.select("k", T._folded(F.col("t"), marks).alias("f")).collect()}


def test_every_code_point_folds_to_its_compatibility_form(spark):
    texts = [f"w{chr(n)}w" for n in ASSIGNED]
    got = folded(spark, texts, marks=True)
    wrong = [hex(n) for k, n in enumerate(ASSIGNED) if letters(got[k]) != letters(unicodedata.normalize("NFKC", texts[k]))]
    assert wrong == [], (len(wrong), wrong[:20])


def test_every_code_point_loses_its_marks(spark):
    points = [n for n in ASSIGNED if n not in HANGUL]  # syllables stay whole
    texts = [f"w{chr(n).lower()}w" for n in points]
    got = folded(spark, texts, marks=False)
    plain = lambda t: "".join(c for c in t if unicodedata.category(c) != "Mn").lower()
    wrong = [hex(n) for k, n in enumerate(points) if letters(plain(got[k])) != letters(plain(unicodedata.normalize("NFKD", texts[k])))]
    assert wrong == [], (len(wrong), wrong[:20])


@pytest.mark.parametrize("seed", [1, 2])
def test_decomposed_names_fold_as_composed_ones(spark, seed):
    rnd = random.Random(seed)
    pool = [chr(n) for n in ASSIGNED if n < 0x3100 and not 0x1100 <= n < 0x1200 and chr(n).isalpha() and unicodedata.normalize("NFC", chr(n)) == chr(n)]
    names = ["".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 12))) for _ in range(1500)] + ["Müller", "Nguyễn", "Ångström", "ガンバ大阪", "Łódź"]
    got = folded(spark, [unicodedata.normalize("NFD", n) for n in names], marks=True)
    wrong = [n for k, n in enumerate(names) if letters(got[k]) != letters(unicodedata.normalize("NFKC", n))]
    assert wrong == [], (len(wrong), wrong[:10])


def test_team_names_meet_in_all_spellings(spark):
    rows = [("Real Madrid", "ℜ𝔢𝔞𝔩 𝕄𝕒𝕕𝕣𝕚𝕕"), ("Málaga", "Málaga"), ("株式会社", "㍿"), ("ｶﾞﾝﾊﾞ", "ガンバ"), ("FC 3", "FC ③")]
    df = spark.createDataFrame(rows, "a string, b string").select(T.norm_team(F.col("a")).alias("a"), T.norm_team(F.col("b")).alias("b"))
    got = [tuple(r) for r in df.collect()]
    assert all(a == b for a, b in got) and sum(a != "" for a, _ in got) >= 4, got

import random
import re

import pytest
from pyspark.sql import functions as F

from maskwright import vocab as V
from maskwright.functions import text as T

PATTERNS = {"EMAIL": V.EMAIL, "PHONE": V.PHONE, "SSN": V.SSN, "CARD": V.CREDIT_CARD, "IP": V.IP_ADDRESS, "DATE": "(?i)" + V.DATE, "AADHAAR": V.AADHAAR, "DIN": V.DIN, "PIN": V.PIN, "NAMES": V.NAMES, "ORGS": V.ORGANISATIONS, "COMPANIES": V.COMPANIES + r"\b"}
BITS = ["123", "45", "6789", "-", " ", ".", "@", "+", "(", ")", "Ab", "Rao", "Limited", "LLP", "Inc.", "é", "🙂", "a@b.co", "1.2.3.4", "12 Jan 2020", "\n", "000", "12345678", "123456", "x", "\x01", "\x02", "&", " ", "٣"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    return ["", "123456789 12345678", "a 12345678\x01b"] + ["".join(rng.choice(BITS) for _ in range(rng.randint(1, 25))) for _ in range(400)]


def test_scan_gives_the_matches_of_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4)
    got = df.select("i", *[T.scan(F.col("t"), p.removeprefix("(?i)"), "Ui" if p.startswith("(?i)") else "U").alias(k) for k, p in PATTERNS.items()]).collect()
    for row in got:
        for k, p in PATTERNS.items():
            assert [(s.start, s.end) for s in row[k]] == [m.span() for m in re.finditer(p, texts[row.i])], (k, texts[row.i])


def test_words_titles_strip_and_terms(spark):
    samples = ["", " A b ", "O'Brien Rao", "ABC", "Abc def", "1st Place", " x ", "Plot, (road). no.", "hotel", "Ångström Été", "a b"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = df.select("t", T.is_title(F.col("t")).alias("title"), T.strip(F.col("t")).alias("strip"), T.words_of(F.col("t")).alias("words"), T.has_word(F.lower("t"), ("road", "no.", "plot")).alias("word"), T.has_any(F.lower("t"), ("tel", "xyz")).alias("any")).collect()
    for r in got:
        assert r.title == r.t.istitle() and r.strip == r.t.strip() and r.words == r.t.split()
        assert r.word == any(re.sub(r"[^\w\s]", "", w) in ("road", "no.", "plot") for w in r.t.lower().split())
        assert r["any"] == ("tel" in r.t.lower())


def test_luhn(spark):
    def plain(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    rng = random.Random(3)
    numbers = ["4111111111111111", "79927398713"] + ["".join(rng.choice("0123456789") for _ in range(rng.randint(1, 19))) for _ in range(200)]
    df = spark.createDataFrame([(n,) for n in numbers], "d string")
    assert all(r.ok == plain(r.d) for r in df.select("d", T.luhn(F.col("d")).alias("ok")).collect())
    assert not spark.createDataFrame([("12x",), ("",)], "d string").select(T.luhn(F.col("d")).alias("ok")).where("ok").count()

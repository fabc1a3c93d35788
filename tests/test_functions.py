import random

from pyspark.sql import functions as F

from maskwright import vocab as V
from maskwright.functions import pseudonym
from maskwright.functions import text as T
from maskwright.operators import detect
from maskwright.plans import functions

PIECES = ["a.b@c.de", "+91 98765 43210", "123-45-6789", "4111 1111 1111 1111", "4111 1111 1111 1112", "10.0.0.255", "01/02/1990", "3 Mar 99", "1234 5678 9012", "00012345", "é", "😀", " ", "\n", "\x01", "x", "٤٥٦٧", "'", "\\", "$0"]


def lines(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PIECES) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(0, 9))) for _ in range(300)] + [None, "", *PIECES]
    return spark.createDataFrame(list(enumerate(texts)), "id int, line string")


def test_analysis_as_a_table_function(spark):
    functions.register(spark, "f")
    lines(spark).createOrReplaceTempView("some_lines")
    got = spark.sql("SELECT l.id, e.* FROM some_lines l, LATERAL f_analyze(l.line) e")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Python" not in plan
    want = lines(spark).select("id", F.explode(T.once(detect.detect(F.col("line")))).alias("e")).select("id", "e.entity_type", "e.text", "e.start", "e.end", "e.confidence")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(got) == rows(want) and {r[1] for r in rows(got)} == set(detect.DETECTORS)


def test_scalar_functions(spark):
    assert functions.register(spark, "f", seed=7) == ("f_scan", "f_luhn", "f_replacement", "f_redact", "f_analyze")
    kinds = F.explode(F.array(*[F.lit(k) for k in (*V.ENTITY_TYPES, "DATE", "OTHER")])).alias("kind")
    df = lines(spark).select("id", "line", kinds)
    said = df.select(F.expr("f_replacement(line, kind)").alias("a"), F.when(F.col("line").isNotNull(), pseudonym.replacement(F.col("line"), F.col("kind"), 7)).alias("b"))
    assert said.where("NOT a <=> b").count() == 0 and said.where("a IS NOT NULL").count() > 3000
    for kind, find in detect.DETECTORS.items():
        wanted = pseudonym.redacted(F.col("line"), pseudonym.with_replacements(find(F.col("line")), 7))
        both = lines(spark).select(F.expr(f"f_redact(line, '{kind}')").alias("a"), F.when(F.col("line").isNotNull(), wanted).alias("b"), "line")
        rows = both.collect()
        assert all(r.a == r.b for r in rows) and sum(r.a != r.line for r in rows) > 5, kind
    assert spark.sql("SELECT f_redact('x@y.org', 'PERSON'), f_luhn('4111111111111111'), f_luhn(''), f_luhn('12a'), size(f_scan('abab', 'ab')), f_redact(NULL, 'EMAIL')").first()[:] == ("x@y.org", True, False, False, 2, None)

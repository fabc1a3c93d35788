"""Names of a table by a join, against the automaton."""

import random

from pyspark.sql import functions as F

from maskwright.operators import names


def test_listed_against_the_automaton(spark, monkeypatch):
    rng = random.Random(5)
    bits = ["Asha", "Rao", " ", " & ", "Co", ".", "é", "7", "-", "(", "½"]
    known = {"".join(rng.choice(bits) for _ in range(rng.randint(1, 4))) for _ in range(60)} - {" "}
    rows = [(n, label) for n in sorted(known) for label in rng.sample(["PERSON", "ORG", "GPE"], rng.randint(1, 2))]
    texts = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for i in range(400)] + [(900, None)]
    table = spark.createDataFrame(rows, "name string, label string")
    provider = names.ListProvider.of(table)
    monkeypatch.setattr(names, "MOST_NAMES", 1)  # a list's limit doesn't hold here
    got = {r.doc_id: [(e.text, e.entity_type, e.start, e.end) for e in r.e] for r in names.listed(spark.createDataFrame(texts, "doc_id long, text string"), table, "doc_id").collect()}
    want = {i: [(t[a:b], names.LABELS[k], a, b) for k, a, b in provider.load()(t)] for i, t in texts if t}
    assert got == {i: found for i, found in want.items() if found} and len(got) > 100

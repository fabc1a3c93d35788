"""Names by list and by the learnt tagger, against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.operators import automaton, names, tagger
from maskwright.plans import corpus, pipeline, queries


def test_automaton_finds_every_occurrence(monkeypatch):
    rng = random.Random(2)
    for alphabet, lane in (("ab", 512), ("abc é🙂", 7), ("a", 3)):
        monkeypatch.setattr(automaton, "LANE", lane)
        listed = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(60)})
        machine = automaton.build(listed)
        text = "".join(rng.choice(alphabet) for _ in range(900))
        place, name = machine.ends(automaton.code_points(text))
        want = sorted((m.end(), listed.index(n)) for n in listed for at in range(len(text)) if (m := re.compile(re.escape(n)).match(text, at)))
        assert sorted(zip(place.tolist(), name.tolist(), strict=True)) == want
    none = automaton.build([])
    assert automaton.whole_names(none, ["", "x"]) == [[], []] and automaton.whole_names(none, []) == []


def test_list_provider_against_one_alternation():
    rng = random.Random(3)
    words = ["Asha", "Rao", "A.", "Émile", "x", "O'Neil", "日本", "Rao-Iyer", "(Q)"]
    people = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(60)}
    found = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(n) for n in sorted(people, key=len, reverse=True)) + r")(?!\w)")
    texts = ["".join(rng.choice([*words, "and", "Raox"]) + rng.choice([" ", "", ", ", "\n"]) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    many = names.ListProvider(people=people).load_many()
    assert many(texts) == [[("PERSON", *m.span()) for m in found.finditer(t)] for t in texts]
    assert names.ListProvider(["A b"], ["A b", "C d"], ["C d", "E"]).load()("A b, C d E") == [("PERSON", 0, 3), ("ORG", 5, 8), ("GPE", 9, 10)]


def test_a_list_of_very_many_names():
    listed = [f"Name{i:06d} Family{i % 977}" for i in range(200_000)]
    provider = names.ListProvider(people=listed)
    assert len(provider.machine.fail) < 2_500_000
    texts = [f"met Name{i:06d} Family{i % 977}, not Name{i:06d} Family" for i in range(0, 200_000, 5000)]
    assert all(x == [("PERSON", 4, 4 + len(listed[i]))] for x, i in zip(provider.load_many()(texts), range(0, 200_000, 5000), strict=True))


def test_a_list_from_a_table(spark, monkeypatch):
    frame = spark.createDataFrame([("Asha Rao", "PERSON"), ("Asha Rao", "ORG"), (None, "ORG"), ("", "GPE"), ("Pune", "GPE"), ("Pune", "GPE")], "name string, label string")
    assert names.ListProvider.of(frame).load()("Asha Rao of Pune") == [("PERSON", 0, 8), ("GPE", 12, 16)]
    monkeypatch.setattr(names, "MOST_NAMES", 1)
    with pytest.raises(ValueError):
        names.ListProvider.of(frame)


def plain_viterbi(lines, weights):
    out = []
    for first, n in zip(lines.starts.tolist(), lines.lengths.tolist(), strict=True):
        emit = [weights[lines.features[first + t]].sum(axis=0) for t in range(n)]
        best = {k: (weights[tagger.ROWS - 1][k] + tagger._FORBIDDEN[tagger.N][k] + emit[0][k], [k]) for k in range(tagger.N)} if n else {0: (0.0, [])}
        for t in range(1, n):
            best = {k: max(((s + weights[tagger.BUCKETS + j][k] + tagger._FORBIDDEN[j][k] + emit[t][k], [*way, k]) for j, (s, way) in best.items()), key=lambda x: x[0]) for k in range(tagger.N)}
        out += max(best.values(), key=lambda x: x[0])[1]
    return out


def test_viterbi_against_a_plain_loop():
    rng = np.random.default_rng(4)
    texts = ["", "One word", "x", "Asha Rao met Dev Shah, of Acme & Co. in Pune!", "é 🙂 日本 " * 9, " ", "A b C d"] * 3
    for scale in (1.0, 10.0):
        weights = scale * rng.standard_normal((tagger.ROWS, tagger.N))
        lines = tagger.encoded(texts)
        tags = tagger.viterbi(lines, weights)
        assert tags.tolist() == plain_viterbi(lines, weights)
        firsts = set(lines.starts.tolist())
        assert all(tagger.TAGS[tags[i]][0] != "I" or (i not in firsts and tagger.TAGS[tags[i - 1]][1:] == tagger.TAGS[tags[i]][1:]) for i in range(len(tags)))
    assert tagger.viterbi(tagger.encoded([]), weights).tolist() == [] and tagger.viterbi(tagger.encoded(["", " "]), weights).tolist() == []


def test_expected_names_become_tags():
    tag = lambda text, *expected: [tagger.TAGS[t] for t in tagger.gold_tags(text, expected)]
    assert tag("Met Asha Rao, Asha Raoul", ("PERSON", "Asha Rao")) == ["O", "B-PERSON", "I-PERSON", "O", "O", "O"]
    assert tag("Rao Works in Pune", ("PERSON", "Rao"), ("COMPANY", "Rao Works"), ("EMAIL", "in"), ("PHYSICAL_OR_MAILING_ADDRESS", "Pune")) == ["B-ORG", "I-ORG", "O", "B-GPE"]
    lines = tagger.encoded(["Rao Works in Pune"])
    assert tagger.found(lines, np.array(tagger.gold_tags("Rao Works in Pune", [("COMPANY", "Rao Works"), ("PHYSICAL_OR_MAILING_ADDRESS", "Pune")]))) == [[("ORG", 0, 9), ("GPE", 13, 17)]]


@pytest.fixture(scope="module")
def learnt(spark):
    rows = corpus.named(spark, "/root/testdata/sf0.001")
    return tagger.train(rows.where("NOT held_out")), rows


def test_tagger_on_names_and_lines_that_it_has_not_seen(spark, learnt):
    scores = {r.category: r for r in queries.tagger_scores(spark, "/root/testdata/sf0.001").collect()}
    assert scores.keys() == tagger.LABELS.keys() and all(r.f1 > 0.85 and r.tp > 20 for r in scores.values())


def test_tagger_is_the_same_in_any_order_and_after_storing(spark, learnt):
    model, rows = learnt
    again = tagger.train(rows.where("NOT held_out").repartition(7))
    assert (again.weights == model.weights).all()
    assert (tagger.NameTagger.of(model.frame(spark)).weights == model.weights).all()
    nothing = tagger.train(rows.where("doc_id < 0"))
    assert nothing.load()("Asha Rao of Pune") == []
    odd = spark.createDataFrame([(1, 0, None, None), (2, 0, "", []), (3, 0, "Asha Rao", [("PERSON", "Asha Rao"), ("PERSON", None), (None, "x")])], "doc_id long, seq int, text string, entities array<struct<type:string,text:string>>").withColumn("shard", F.lit(1))
    assert tagger.train(odd).load()("Asha Rao") == [("PERSON", 0, 8)]


def test_tagger_feeds_refinement_and_memo(spark, learnt):
    """Names by the tagger alone; one under a table header is found again later, where the tagger doesn't know it."""
    model, _ = learnt
    rows = [("d", 0, "A letter from Esha Thakur arrived", "Full Name"), ("d", 1, "zz Esha Thakur zz", None), ("d", 2, "We met Kiran Shah and Gita Pillai last week", None), ("d", 3, "They moved to Aluva after the summer", None), ("e", 0, "Bose Cotton Works opened a branch near Erode", "Company")]
    df = spark.createDataFrame(rows, "doc_id string, seq int, text string, header_text string")
    found = {(r.doc_id, r.seq, r.text): (r.entity_type, r.confidence) for r in pipeline.entities(pipeline.analyse(df, pipeline.Config(name_provider=model))).collect()}
    assert found["d", 0, "Esha Thakur"] == ("PERSON", 0.95) and found["d", 1, "Esha Thakur"] == ("PERSON", 0.99)
    assert found["d", 2, "Kiran Shah"] == ("PERSON", 0.7) and ("d", 2, "Gita Pillai") in found
    assert found["e", 0, "Bose Cotton Works"] == ("COMPANY", 0.95) and not any(k[1] == 3 for k in found)
    done = queries.redact_names(spark, "/root/testdata/sf0.001").collect()
    assert {r.kind for r in done} == {"PERSON", "COMPANY", "PHYSICAL_OR_MAILING_ADDRESS"} and {r.confidence for r in done} >= {0.7, 0.95, 0.99}

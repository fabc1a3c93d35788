"""Deterministic replacement values: pure functions of a seed, the text in lower case and the type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright import vocab as V
from maskwright.functions import text as T

FIRST_NAMES = ("Aarav", "Bela", "Chitra", "Dev", "Esha", "Farid", "Gita", "Hari", "Indu", "Jaya", "Kiran", "Leela", "Mohan", "Nila", "Omkar", "Priya", "Qadir", "Rohan", "Sita", "Tara")
LAST_NAMES = ("Acharya", "Bose", "Chopra", "Dutta", "Engineer", "Fernandes", "Ghosh", "Hegde", "Iyer", "Joshi", "Kulkarni", "Lal", "Menon", "Nair", "Oberoi", "Pillai", "Quraishi", "Rao", "Shah", "Thakur")
BRANCHES = ("Cotton", "Foods", "Glass", "Leather", "Marine", "Motors", "Paper", "Solar", "Steel", "Tea")
STREETS = ("Banyan Lane", "Garden Road", "Harbour Street", "Hill Road", "Lake View Marg", "Market Street", "Mill Lane", "Station Road", "Temple Street", "Tower Road")
CITIES = ("Aluva", "Bharuch", "Chittoor", "Dhule", "Erode", "Firozpur", "Guntur", "Hassan", "Imphal", "Jorhat")


def seed_text(text: Column, kind: Column, seed: int = V.SEED) -> Column:
    return F.concat(F.lit(f"{seed}|"), F.lower(text), F.lit("|"), kind)


def _hex_number(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def seed_number(text: Column, kind: Column, seed: int = V.SEED) -> Column:
    """The first 32 bits of the md5 of seed, text in lower case and type."""
    return _hex_number(F.md5(seed_text(text, kind, seed)), 8)


def _draw(key: Column, k: int, n: int) -> Column:
    """A number from 0 to n - 1; different k draw independently."""
    return _hex_number(F.md5(F.concat(key, F.lit(f"|{k}"))), 8) % n


def _pick(key: Column, k: int, words: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (_draw(key, k, len(words)) + 1).cast("int"))


def _digits(key: Column, k: int, n: int, least: int = 0) -> Column:
    """n digits that as a number are at least least."""
    number = _hex_number(F.md5(F.concat(key, F.lit(f"|{k}"))), 13) % (10**n - least) + least
    return F.lpad(number.cast("string"), n, "0")


def _card(key: Column) -> Column:
    body = F.concat(F.lit("4"), _digits(key, 1, 14))
    backwards = F.reverse(body)

    def add(total, k):
        d = backwards.substr(k, F.lit(1)).cast("int")
        return total + F.when(k % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.concat(body, ((10 - F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), add) % 10) % 10).cast("string"))


def _value(key: Column, kind: Column) -> Column:
    first, last = _pick(key, 1, FIRST_NAMES), _pick(key, 2, LAST_NAMES)
    two = lambda k, n, plus=0: F.lpad((_draw(key, k, n) + plus).cast("string"), 2, "0")
    date = F.concat((_draw(key, 1, 60) + 1945).cast("string"), F.lit("-"), two(2, 12, 1), F.lit("-"), two(3, 28, 1))
    return (
        F.when(kind == "PERSON", F.concat(first, F.lit(" "), last))
        .when(kind == "EMAIL", F.concat(F.lower(first), F.lit("."), F.lower(last), _digits(key, 3, 3), F.lit("@example.com")))
        .when(kind == "PHONE", F.concat(F.lit("+91 "), _digits(key, 1, 10, 6 * 10**9)))
        .when(kind == "COMPANY", F.concat(last, F.lit(" "), _pick(key, 3, BRANCHES), F.lit(" Private Limited")))
        .when(kind == "PHYSICAL_OR_MAILING_ADDRESS", F.concat((_draw(key, 1, 899) + 1).cast("string"), F.lit(", "), _pick(key, 2, STREETS), F.lit(", "), _pick(key, 3, CITIES), F.lit(" "), _digits(key, 4, 6, 110001)))
        .when(kind == "SSN", F.concat((_draw(key, 1, 565) + 101).cast("string"), F.lit("-"), two(2, 99, 1), F.lit("-"), _digits(key, 3, 4, 1)))
        .when(kind == "CREDIT_CARD", _card(key))
        .when(kind.isin("DATE_OF_BIRTH", "DATE"), date)
        .when(kind == "IP_ADDRESS", F.concat_ws(".", (_draw(key, 1, 223) + 1).cast("string"), *[_draw(key, k, 256).cast("string") for k in (2, 3, 4)]))
        .when(kind == "AADHAAR", F.concat_ws(" ", _digits(key, 1, 4, 2000), _digits(key, 2, 4), _digits(key, 3, 4)))
        .when(kind == "DIN", _digits(key, 1, 8))
        .otherwise(F.concat(F.lit("[REDACTED "), kind, F.lit("]")))
    )


def replacement(text: Column, kind: Column, seed: int = V.SEED) -> Column:
    """A value of the type's shape, the same wherever the text occurs in any case, and never the text itself."""
    key = seed_text(text, kind, seed)
    first = _value(key, kind)
    return F.when(first != text, first).otherwise(_value(F.concat(key, F.lit("|again")), kind))


def with_replacements(entities: Column, seed: int = V.SEED) -> Column:
    """The entities with the field replacement."""
    fields = ("text", "entity_type", "start", "end", "confidence", "detector", "ord")
    return F.transform(entities, lambda e: F.struct(*[e[f].alias(f) for f in fields], replacement(e["text"], e["entity_type"], seed).alias("replacement")))


def redacted(text: Column, replaced: Column) -> Column:
    """The text with every span of replaced (in order, apart) exchanged; spans that don't lie in the text are left out."""
    fit = F.filter(replaced, lambda e: (e["start"] < e["end"]) & (e["end"] <= F.length(text)))
    begin = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    step = lambda s, e: F.struct(F.concat(s["done"], T.part(text, s["at"], e["start"]), e["replacement"]).alias("done"), e["end"].alias("at"))
    whole = F.aggregate(fit, begin, step, lambda s: F.concat(s["done"], text.substr(s["at"] + F.lit(1), F.length(text))))
    return F.when(F.size(replaced) > 0, whole).otherwise(text)


def redacted_runs(runs: Column, replaced: Column) -> Column:
    """The paragraph's runs (array of run_index, text) with the same spans exchanged.

    A replacement goes into the first run that its span touches; the later ones lose their part of it.
    """
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<run_index:int,text:string,a:int,b:int>>").alias("out"))
    laid = F.aggregate(
        runs, begin,
        lambda s, r: F.struct((s["at"] + F.length(r["text"])).alias("at"), F.concat(s["out"], F.array(F.struct(r["run_index"].cast("int").alias("run_index"), r["text"].alias("text"), s["at"].alias("a"), (s["at"] + F.length(r["text"])).alias("b")))).alias("out")),
        lambda s: s["out"],
    )
    total = F.aggregate(runs, F.lit(0), lambda n, r: n + F.length(r["text"]))
    fit = F.filter(replaced, lambda e: (e["start"] < e["end"]) & (e["end"] <= total))

    def rewritten(r):
        mine = F.filter(fit, lambda e: (e["start"] < r["b"]) & (e["end"] > r["a"]))
        begin = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

        def step(s, e):
            start = F.greatest(e["start"] - r["a"], F.lit(0))
            here = F.when(e["start"] >= r["a"], e["replacement"]).otherwise(F.lit(""))
            return F.struct(F.concat(s["done"], T.part(r["text"], s["at"], start), here).alias("done"), F.least(e["end"] - r["a"], F.length(r["text"])).alias("at"))

        return F.struct(r["run_index"].alias("run_index"), F.aggregate(mine, begin, step, lambda s: F.concat(s["done"], r["text"].substr(s["at"] + F.lit(1), F.length(r["text"])))).alias("text"))

    return F.transform(laid, rewritten)

"""Text with every kind of finding, made from relational tables by SQL that Spark and other engines read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from maskwright.functions import pseudonym as P
from maskwright.sources import tables

_K = "c_custkey"


def _digits(expr: str, n: int) -> str:
    return f"lpad(concat('', {expr}), {n}, '0')"


_DATE = f"{_digits(f'{_K} % 28 + 1', 2)}, '/', {_digits(f'{_K} % 12 + 1', 2)}, '/', 1950 + {_K} % 50"
_TWELVE = f"{_digits(f'2000 + {_K} % 7000', 4)}, ' ', {_digits(f'{_K} * 37 % 10000', 4)}, ' ', {_digits(f'{_K} * 91 % 10000', 4)}"
#: kind -> (header or NULL, text).
KINDS = {
    "ssn": ("NULL", f"concat('SSN ', {_digits(f'{_K} * 222 % 1000', 3)}, '-', {_digits(f'{_K} * 3 % 100', 2)}, '-', {_digits(f'{_K} * 1250 % 10000', 4)}, ' on file, not ', {_digits(f'{_K} % 900 + 100', 3)}, '-11-1111-22')"),
    "aadhaar": ("NULL", f"concat(CASE {_K} % 3 WHEN 0 THEN 'Aadhaar no ' WHEN 1 THEN 'Paid by card ' ELSE 'Ref. ' END, {_TWELVE}, ' seen')"),
    "din": ("NULL", f"concat('DIN is ', {_digits(f'{_K} + 10000000', 8)}, CASE {_K} % 2 WHEN 0 THEN '' ELSE '1' END)"),
    "dob": ("NULL", f"concat(CASE {_K} % 3 WHEN 0 THEN 'DOB: ' WHEN 1 THEN 'Order dated ' ELSE 'He was born on ' END, {_DATE})"),
    "date_cell": ("CASE c_custkey % 2 WHEN 0 THEN 'Date of birth' ELSE 'Shipped' END", f"concat({_DATE})"),
    "phone": ("NULL", f"concat(CASE {_K} % 5 WHEN 0 THEN 'Phone ' WHEN 1 THEN 'Number ' WHEN 2 THEN 'Number +91 ' WHEN 3 THEN 'financial: phone ' ELSE 'Desk 022-' END, {_digits(f'9000000000 + {_K} * 7919 % 1000000000', 10)})"),
    "address": ("NULL", f"CASE {_K} % 4 WHEN 0 THEN concat('Registered office: ', {_K}, ' Market Road, Pune') WHEN 1 THEN concat(' ', {_K}, ', Hill Road, Pune ', 400000 + {_K} % 9999) WHEN 2 THEN concat('Address: ', {_K} % 10) ELSE concat('He lives in Pune ', {_K}) END"),
    "people": ("NULL", f"CASE {_K} % 3 WHEN 0 THEN concat('our KMPs including Asha Rao', {_K} % 7, ' and Vikram Shah Mehta, Executive Directors') WHEN 1 THEN 'Asha Rao and Vikram Shah met' ELSE 'her spouse Lata Iyer of Acme Group' END"),
    "organisation": ("NULL", f"CASE {_K} % 3 WHEN 0 THEN concat('report by The Orion Ratings dated ', {_K}) WHEN 1 THEN 'Orion Ratings wrote this' ELSE 'appointed by Blue Hill Partners and Statutory Auditors Board' END"),
    "company": ("NULL", f"CASE {_K} % 4 WHEN 0 THEN concat('Acme Foods Private Limited sold ', {_K}) WHEN 1 THEN 'Kite and Partners LLP signed' WHEN 2 THEN 'with Orion Inc. here and Delta Corp.x' ELSE 'limited offers' END"),
    "card": ("NULL", f"concat('Card ', {_digits(f'4000 + {_K} % 999', 4)}, '-', {_digits(f'{_K} * 57 % 10000', 4)}, ' ', {_digits(f'{_K} * 31 % 10000', 4)}, {_digits(f'{_K} * 17 % 10000', 4)})"),
    "email": ("NULL", f"concat('Write to user', {_K}, '@mail', {_K} % 9, '.example.com or a@b, ', {_K}, '@x.org')"),
    "ip": ("NULL", f"concat('Host ', {_K} % 300, '.', {_K} % 256, '.0.', {_K} % 260, ' port 80')"),
    "plain": ("NULL", f"concat('Nothing to see in line ', {_K})"),
}


def derived_sql(customer: str = "customer") -> str:
    """SELECT of (line_id, kind, header_text, text): a line of each kind for each customer."""
    parts = [f"SELECT {_K} * 100 + {i} AS line_id, '{kind}' AS kind, {header} AS header_text, {text} AS text FROM {customer}" for i, (kind, (header, text)) in enumerate(KINDS.items())]
    return " UNION ALL ".join(parts)


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of derived_sql() as paragraphs (doc_id, seq, text, header_text) with kind: customers are read once, and spread."""
    each = [f"named_struct('i', {i}, 'kind', '{kind}', 'header_text', cast({header} AS string), 'text', {text})" for i, (kind, (header, text)) in enumerate(KINDS.items())]
    rows = tables.spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select(_K)).selectExpr(_K, f"explode(array({', '.join(each)})) AS x")
    return rows.selectExpr(f"cast({_K} * 100 + x.i as bigint) doc_id", "0 seq", "x.text text", "x.header_text header_text", "x.kind kind")


def spans_sql(modulus: int = 12, lineitem: str = "lineitem") -> str:
    """SELECT of (doc_id, ord, a, b, entity_type, confidence): overlapping spans, an order's lines being a text's candidates; a smaller modulus makes more of them equal."""
    kind = "CASE CAST(l_suppkey % 6 AS INT) WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'PERSON' WHEN 2 THEN 'COMPANY' WHEN 3 THEN 'DIN' WHEN 4 THEN 'PHONE' ELSE 'PHYSICAL_OR_MAILING_ADDRESS' END"
    confidence = "CASE CAST(l_partkey % 3 AS INT) WHEN 0 THEN CAST(0.92 AS DOUBLE) WHEN 1 THEN CAST(0.85 AS DOUBLE) ELSE CAST(0.95 AS DOUBLE) END"
    return f"SELECT l_orderkey AS doc_id, l_linenumber AS ord, CAST(l_partkey % {modulus} AS INT) AS a, CAST(l_partkey % {modulus} + 1 + l_suppkey % 7 AS INT) AS b, {kind} AS entity_type, {confidence} AS confidence FROM {lineitem}"


def header_candidates_sql(customer: str = "customer") -> str:
    """SELECT of (doc_id, header_text, text, found, entity_type, confidence): candidates as a name model would give them."""
    header = "CASE c_custkey % 6 WHEN 0 THEN 'Full Name' WHEN 1 THEN 'Address' WHEN 2 THEN 'Company' WHEN 3 THEN 'Name of Director' WHEN 4 THEN 'Birth' ELSE '' END"
    found = "CASE c_custkey % 7 WHEN 0 THEN 'Asha Rao' WHEN 1 THEN 'Pune' WHEN 2 THEN 'Acme Technologies' WHEN 3 THEN 'the offer' WHEN 4 THEN 'asha' WHEN 5 THEN 'PAN Number' ELSE 'Blue Hill' END"
    kind = "CASE c_custkey % 5 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'COMPANY_CANDIDATE' WHEN 2 THEN 'ADDRESS_CANDIDATE' WHEN 3 THEN 'PERSON' ELSE 'COMPANY_CANDIDATE' END"
    tail = "CASE c_custkey % 11 WHEN 0 THEN ' is the chairman' WHEN 1 THEN ', plot 7, 411001' WHEN 2 THEN ' as user' WHEN 3 THEN ' company: yes' WHEN 4 THEN ', alpha beta, gamma road, delta' ELSE '' END"
    return f"SELECT c_custkey AS doc_id, {header} AS header_text, concat({found}, {tail}) AS text, {found} AS found, {kind} AS entity_type, CAST(0.7 AS DOUBLE) AS confidence FROM {customer}"


def _one(words: tuple[str, ...], step: int) -> str:
    """One of the words, by the key."""
    return f"element_at(array({', '.join(repr(w) for w in words)}), cast({_K} * {step} % {len(words)} + 1 AS int))"


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that name people, companies and places without announcing them: (doc_id, seq, text, header_text, entities, held_out).

    entities are the expected findings. A fifth of the customers is held out; the family names of theirs, and the last two
    of the twelve lines, occur nowhere else.
    """
    person = lambda step: f"concat({_one(P.FIRST_NAMES, step)}, ' ', CASE WHEN {_K} % 5 = 0 THEN {_one(P.LAST_NAMES[15:], 3 * step)} ELSE {_one(P.LAST_NAMES[:15], step + 2)} END)"
    names = {"P": ("PERSON", person(7)), "Q": ("PERSON", person(11)), "C": ("COMPANY", f"concat({_one(P.LAST_NAMES, 7)}, ' ', {_one(P.BRANCHES, 3)}, ' Works')"), "G": ("PHYSICAL_OR_MAILING_ADDRESS", _one(P.CITIES, 3))}
    lines = ("{P} joined the meeting on time", "We met {P} and {Q} last week", "A letter from {P} arrived", "{C} opened a branch near {G}", "The bill of {C} was paid by {P}", "They moved to {G} after the summer", "Prices rose again, said {P}", "nothing of note happened in the garden", "Red Paper Day was fun for all", "A Garden Party near {G}", "{Q} and {C} wrote to each other", "In {G} we saw {P} again")
    each = []
    for i, line in enumerate(lines):
        pieces = [x[1] if x[0] == "{" else repr(x) for x in re.split(r"(\{\w\})", line) if x]
        gold = [f"named_struct('type', '{names[x][0]}', 'text', {x})" for x in re.findall(r"\{(\w)\}", line)]
        each.append(f"named_struct('seq', {i}, 'text', concat({', '.join(pieces)}), 'entities', {f'array({", ".join(gold)})' if gold else 'cast(array() AS array<struct<type:string,text:string>>)'})")
    customers = tables.spread(spark.read.parquet(f"{sf_dir}/customer.parquet")).selectExpr(f"{_K} AS doc_id", f"{_K} % 5 = 0 AS held_out", *[f"{sql} AS {x}" for x, (_, sql) in names.items()])
    rows = customers.selectExpr("doc_id", "held_out", f"explode(array({', '.join(each)})) AS x")
    return rows.where("held_out OR x.seq < 10").selectExpr("doc_id", "x.seq AS seq", "x.text AS text", "CASE x.seq WHEN 0 THEN 'Full Name' WHEN 3 THEN 'Company' WHEN 5 THEN 'Address' END AS header_text", "x.entities AS entities", "held_out")


def dictionary_sql(customer: str = "customer") -> str:
    """SELECT of (name, label): every customer's name, and for a third of them a longer one that begins with it."""
    return f"SELECT c_name AS name, 'PERSON' AS label FROM {customer} UNION ALL SELECT concat(c_name, ' & Sons') AS name, 'ORG' AS label FROM {customer} WHERE {_K} % 3 = 0"


def mentions_sql(orders: str = "orders") -> str:
    """SELECT of (doc_id, text): lines that mention customers, some inside other words or before more digits."""
    name = f"concat('Customer#', {_digits('o_custkey', 9)})"
    return f"""SELECT o_orderkey AS doc_id, concat(CASE o_orderkey % 4 WHEN 0 THEN 'For ' WHEN 1 THEN 'x' WHEN 2 THEN '(' ELSE 'é' END, {name}, CASE o_orderkey % 5 WHEN 0 THEN ' & Sons' WHEN 1 THEN '7' WHEN 2 THEN ' & Sonst' WHEN 3 THEN '.' ELSE '' END, ' via ', {name}) AS text FROM {orders}"""


def logged_sql(events: str = "events") -> str:
    """SELECT of (doc_id, seq, ts, user_id, text): a line for each event, with an address, a host or a card in some."""
    card = f"concat(' card 4000-', {_digits('user_id % 10000', 4)}, '-', {_digits('event_id % 10000', 4)}, '-', {_digits('event_id * 7 % 10000', 4)})"
    return f"""SELECT event_id AS doc_id, 0 AS seq, ts, user_id, concat(event_type, CASE user_id % 3 WHEN 0 THEN concat(' by user', user_id, '@mail.example.com') WHEN 1 THEN concat(' from 10.0.', user_id % 250, '.', event_id % 250) ELSE ' by nobody' END, CASE event_id % 4 WHEN 0 THEN {card} ELSE '' END) AS text FROM {events}"""

"""The pattern analysis as functions of SQL, with bodies in SQL: no Python runs, and the optimiser sees into them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from maskwright import vocab as V
from maskwright.functions import pseudonym as P

SPANS = "ARRAY<STRUCT<start: INT, end: INT>>"


def lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _scan(line: str, pattern: str) -> str:
    """As functions.text.scan()."""
    pieces = f"split(regexp_replace(translate({line}, '\\u0001\\u0002', '\\u0003\\u0004'), {pattern}, '\\u0001$0\\u0002'), '[\\u0001\\u0002]')"
    begin = f"named_struct('at', 0, 'inside', false, 'found', CAST(array() AS {SPANS}))"
    more = "concat(s.found, array(named_struct('start', s.at, 'end', s.at + length(p))))"
    return f"aggregate({pieces}, {begin}, (s, p) -> named_struct('at', s.at + length(p), 'inside', NOT s.inside, 'found', CASE WHEN s.inside THEN {more} ELSE s.found END), s -> s.found)"


def _luhn(digits: str) -> str:
    digit = f"try_cast(substr(reverse({digits}), k, 1) AS INT)"
    twice = f"CASE WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END"
    return f"(length({digits}) > 0 AND coalesce(aggregate(sequence(1, length({digits})), 0, (t, k) -> t + CASE WHEN k % 2 = 0 THEN {twice} ELSE {digit} END) % 10 = 0, false))"


def _only(found: str, others: str) -> str:
    return f"regexp_replace({found}, {lit(others)}, '')"


#: Of each type: what a text must hold to be scanned, pattern, flags, confidence, and a condition on what was found.
_KINDS = {
    "EMAIL": ("@", V.EMAIL, "U", V.PATTERN_HIGH, None),
    "PHONE": (r"(?U)\d{3}", V.PHONE, "U", V.PATTERN_MEDIUM, lambda x: f"length({_only(x, r'(?U)\D')}) >= 10"),
    "SSN": (r"(?U)\d{3}-\d", V.SSN, "U", V.PATTERN_HIGH, None),
    "CREDIT_CARD": (r"(?U)\d(?:[ -]*\d){12}", V.CREDIT_CARD, "U", V.PATTERN_HIGH, lambda x: _luhn(_only(x, "[ -]"))),
    "IP_ADDRESS": (r"[0-9]\.[0-9]+\.[0-9]", V.IP_ADDRESS, "U", V.PATTERN_HIGH, None),
    "DATE": (r"(?U)\d\d", V.DATE, "Ui", V.PATTERN_MEDIUM, None),
    "AADHAAR": (r"(?U)\d{4}", V.AADHAAR, "U", V.PATTERN_MEDIUM, lambda x: f"length({_only(x, r'(?U)[-\s]')}) = 12"),
    "DIN": (r"(?U)\d{8}", V.DIN, "U", V.PATTERN_MEDIUM, None),
}


def _found(line: str, kind: str) -> str:
    least, pattern, flags, _, keep = _KINDS[kind]
    spans = _scan(line, lit(f"(?{flags}){pattern}"))
    if keep:
        spans = f"filter({spans}, e -> {keep(f'substr({line}, e.start + 1, e.end - e.start)')})"
    return f"CASE WHEN {line} RLIKE {lit(least)} THEN {spans} ELSE CAST(array() AS {SPANS}) END"


def _number(key: str, digits: int) -> str:
    return f"CAST(conv(substr(md5({key}), 1, {digits}), 16, 10) AS BIGINT)"


def _draw(key: str, k: int, n: int, plus: int = 0) -> str:
    return f"CAST({_number(f'concat({key}, {lit(f"|{k}")})', 8)} % {n} + {plus} AS STRING)"


def _pick(key: str, k: int, words: tuple[str, ...]) -> str:
    return f"element_at(array({', '.join(map(lit, words))}), CAST({_draw(key, k, len(words), 1)} AS INT))"


def _digits(key: str, k: int, n: int, least: int = 0) -> str:
    return f"lpad(CAST({_number(f'concat({key}, {lit(f"|{k}")})', 13)} % {10**n - least} + {least} AS STRING), {n}, '0')"


def _value(key: str, kind: str) -> str:
    """As functions.pseudonym gives it."""
    first, last = _pick(key, 1, P.FIRST_NAMES), _pick(key, 2, P.LAST_NAMES)
    two = lambda k, n: f"lpad({_draw(key, k, n, 1)}, 2, '0')"
    card = f"concat('4', {_digits(key, 1, 14)})"
    digit = f"CAST(substr({card}, 16 - k, 1) AS INT)"
    sum_ = f"aggregate(sequence(1, 15), 0, (t, k) -> t + CASE WHEN k % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END)"
    return f"""CASE
      WHEN {kind} = 'PERSON' THEN concat({first}, ' ', {last})
      WHEN {kind} = 'EMAIL' THEN concat(lower({first}), '.', lower({last}), {_digits(key, 3, 3)}, '@example.com')
      WHEN {kind} = 'PHONE' THEN concat('+91 ', {_digits(key, 1, 10, 6 * 10**9)})
      WHEN {kind} = 'COMPANY' THEN concat({last}, ' ', {_pick(key, 3, P.BRANCHES)}, ' Private Limited')
      WHEN {kind} = 'PHYSICAL_OR_MAILING_ADDRESS' THEN concat({_draw(key, 1, 899, 1)}, ', ', {_pick(key, 2, P.STREETS)}, ', ', {_pick(key, 3, P.CITIES)}, ' ', {_digits(key, 4, 6, 110001)})
      WHEN {kind} = 'SSN' THEN concat_ws('-', {_draw(key, 1, 565, 101)}, {two(2, 99)}, {_digits(key, 3, 4, 1)})
      WHEN {kind} = 'CREDIT_CARD' THEN concat({card}, CAST((10 - {sum_} % 10) % 10 AS STRING))
      WHEN {kind} IN ('DATE_OF_BIRTH', 'DATE') THEN concat_ws('-', {_draw(key, 1, 60, 1945)}, {two(2, 12)}, {two(3, 28)})
      WHEN {kind} = 'IP_ADDRESS' THEN concat_ws('.', {_draw(key, 1, 223, 1)}, {_draw(key, 2, 256)}, {_draw(key, 3, 256)}, {_draw(key, 4, 256)})
      WHEN {kind} = 'AADHAAR' THEN concat_ws(' ', {_digits(key, 1, 4, 2000)}, {_digits(key, 2, 4)}, {_digits(key, 3, 4)})
      WHEN {kind} = 'DIN' THEN {_digits(key, 1, 8)}
      ELSE concat('[REDACTED ', {kind}, ']') END"""


def _replacement(found: str, kind: str, seed: int) -> str:
    key = f"concat({lit(f'{seed}|')}, lower({found}), '|', {kind})"
    return f"CASE WHEN {found} IS NULL THEN NULL WHEN ({_value(key, kind)}) <> {found} THEN ({_value(key, kind)}) ELSE ({_value(f'concat({key}, {lit("|again")})', kind)}) END"


def register(spark: SparkSession, prefix: str = "maskwright", seed: int = V.SEED) -> tuple[str, ...]:
    """Makes temporary functions of the session, and returns their names.

    <prefix>_scan(line, pattern): the spans of a pattern's matches. <prefix>_luhn(digits): the card checksum.
    <prefix>_replacement(found, kind): the value that stands for a finding. <prefix>_redact(line, kind): the line with all
    that kind's pattern finds exchanged; of a kind without a pattern, as it is. <prefix>_analyze(line): a table (entity_type,
    text, start_at, end_at, confidence) of what all patterns find, before context or overlaps are weighed, for use as
    FROM lines, LATERAL maskwright_analyze(lines.text). A null line gives null, and no rows. Inside the lambda functions of
    a query Spark takes no functions of SQL.
    """
    listed = ", ".join(
        f"transform({_found('line', kind)}, e -> named_struct('entity_type', {lit(kind)}, 'text', substr(line, e.start + 1, e.end - e.start), 'start_at', e.start, 'end_at', e.end, 'confidence', CAST({confidence} AS DOUBLE)))"
        for kind, (_, _, _, confidence, _) in _KINDS.items()
    )
    of_kind = "CASE kind " + " ".join(f"WHEN {lit(k)} THEN {_found('line', k)}" for k in _KINDS) + f" ELSE CAST(array() AS {SPANS}) END"
    new = _replacement("substr(line, e.start + 1, e.end - e.start)", "kind", seed)
    step = f"(s, e) -> named_struct('done', concat(s.done, substr(line, s.at + 1, e.start - s.at), {new}), 'at', e.end)"
    whole = f"aggregate({of_kind}, named_struct('done', '', 'at', 0), {step}, s -> concat(s.done, substr(line, s.at + 1)))"
    bodies = {
        "scan": f"(line STRING, pattern STRING) RETURNS {SPANS} RETURN {_scan('line', 'pattern')}",
        "luhn": f"(digits STRING) RETURNS BOOLEAN RETURN {_luhn('digits')}",
        "replacement": f"(found STRING, kind STRING) RETURNS STRING RETURN {_replacement('found', 'kind', seed)}",
        "redact": f"(line STRING, kind STRING) RETURNS STRING RETURN {whole}",
        "analyze": f"(line STRING) RETURNS TABLE(entity_type STRING, text STRING, start_at INT, end_at INT, confidence DOUBLE) RETURN SELECT e.entity_type, e.text, e.start_at, e.end_at, e.confidence FROM (SELECT explode(concat({listed})) AS e)",
    }
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_{name}{body}")
    return tuple(f"{prefix}_{name}" for name in bodies)

"""DuckDB SQL that gives the rows of the queries, written apart from the expressions that it checks."""

from __future__ import annotations

from maskwright import vocab as V
from maskwright.functions import pseudonym as P
from maskwright.plans import corpus

LINES = "SELECT * FROM (SELECT doc_id, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS seq, unnest(string_split(text, chr(10))) AS text FROM documents) WHERE regexp_matches(text, '\\S')"
DERIVED = f"SELECT line_id AS doc_id, 0 AS seq, header_text, text, kind FROM ({corpus.derived_sql()})"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def scan(source: str, pattern: str, options: str = "g", extra: str = "") -> str:
    """(doc_id, seq, line, found, a, b, extra) of all matches."""
    return f"""
    SELECT doc_id, seq, line, piece AS found, (stop - length(piece))::INT AS a, stop::INT AS b {extra} FROM (
      SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id, seq ORDER BY i) AS stop FROM (
        SELECT doc_id, seq, text AS line {extra}, generate_subscripts(pieces, 1) AS i, unnest(pieces) AS piece FROM (
          SELECT *, string_split_regex(regexp_replace(text, {q(f"({pattern})")}, chr(1) || '\\1' || chr(2), '{options}'), '[\\x01\\x02]') AS pieces FROM ({source})))) WHERE i % 2 = 0"""


LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda k: CASE WHEN k % 2 = 0 THEN CASE WHEN d[length(d) + 1 - k]::INT > 4 THEN d[length(d) + 1 - k]::INT * 2 - 9 ELSE d[length(d) + 1 - k]::INT * 2 END ELSE d[length(d) + 1 - k]::INT END)) % 10 = 0"


def emails(source: str, extra: str = "") -> str:
    return scan(source, V.EMAIL, extra=extra)


def phones(source: str, extra: str = "") -> str:
    return f"SELECT * FROM ({scan(source, V.PHONE, extra=extra)}) WHERE length(regexp_replace(found, '\\D', '', 'g')) >= 10"


def cards(source: str, extra: str = "") -> str:
    return f"SELECT * EXCLUDE (d) FROM (SELECT *, regexp_replace(found, '[ -]', '', 'g') AS d FROM ({scan(source, V.CREDIT_CARD, extra=extra)})) WHERE {LUHN}"


def ssns(source: str, extra: str = "") -> str:
    return f"SELECT * FROM ({scan(source, r'\b\d{3}-\d{2}-\d{4}\b', extra=extra)}) WHERE found[1:3] NOT IN ('000', '666') AND found[5:6] <> '00' AND found[8:11] <> '0000'"


def spans(rows: str) -> str:
    return f"SELECT doc_id, seq, found AS text, a AS start_at, b AS end_at FROM ({rows})"


def spans_of_lines(rows: str) -> str:
    return f"SELECT doc_id, found AS text, a AS start_at, b AS end_at FROM ({rows})"


def any_of(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(t)})" for t in terms) + ")"


def word_of(text: str, words) -> str:
    listed = ", ".join(q(w) for w in words)
    return f"list_has_any(list_transform(string_split_regex({text}, '\\s+'), lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', '', 'g')), [{listed}])"


# ---- replacement values ------------------------------------------------------------------------------------------------

def _number(key: str, digits: int) -> str:
    return f"('0x' || substr(md5({key}), 1, {digits}))::UBIGINT::BIGINT"


def _draw(key: str, k: int, n: int) -> str:
    return f"({_number(f'{key} || {q(f"|{k}")}', 8)} % {n})"


def _pick(key: str, k: int, words) -> str:
    return f"[{', '.join(map(q, words))}][{_draw(key, k, len(words))} + 1]"


def _digits(key: str, k: int, n: int, least: int = 0) -> str:
    return f"lpad((({_number(f'{key} || {q(f"|{k}")}', 13)} % {10**n - least}) + {least})::VARCHAR, {n}, '0')"


def value(key: str, kind: str) -> str:
    two = lambda k, n, plus=0: f"lpad(({_draw(key, k, n)} + {plus})::VARCHAR, 2, '0')"
    first, last = _pick(key, 1, P.FIRST_NAMES), _pick(key, 2, P.LAST_NAMES)
    body = f"('4' || {_digits(key, 1, 14)})"
    check = f"((10 - list_sum(list_transform(range(1, 16), lambda k: CASE WHEN k % 2 = 1 THEN CASE WHEN {body}[16 - k]::INT > 4 THEN {body}[16 - k]::INT * 2 - 9 ELSE {body}[16 - k]::INT * 2 END ELSE {body}[16 - k]::INT END)) % 10) % 10)::INT::VARCHAR"
    date = f"({_draw(key, 1, 60)} + 1945)::VARCHAR || '-' || {two(2, 12, 1)} || '-' || {two(3, 28, 1)}"
    return f"""CASE {kind}
      WHEN 'PERSON' THEN {first} || ' ' || {last}
      WHEN 'EMAIL' THEN lower({first}) || '.' || lower({last}) || {_digits(key, 3, 3)} || '@example.com'
      WHEN 'PHONE' THEN '+91 ' || {_digits(key, 1, 10, 6 * 10**9)}
      WHEN 'COMPANY' THEN {last} || ' ' || {_pick(key, 3, P.BRANCHES)} || ' Private Limited'
      WHEN 'PHYSICAL_OR_MAILING_ADDRESS' THEN ({_draw(key, 1, 899)} + 1)::VARCHAR || ', ' || {_pick(key, 2, P.STREETS)} || ', ' || {_pick(key, 3, P.CITIES)} || ' ' || {_digits(key, 4, 6, 110001)}
      WHEN 'SSN' THEN ({_draw(key, 1, 565)} + 101)::VARCHAR || '-' || {two(2, 99, 1)} || '-' || {_digits(key, 3, 4, 1)}
      WHEN 'CREDIT_CARD' THEN {body} || {check}
      WHEN 'DATE_OF_BIRTH' THEN {date}
      WHEN 'DATE' THEN {date}
      WHEN 'IP_ADDRESS' THEN ({_draw(key, 1, 223)} + 1)::VARCHAR || '.' || {_draw(key, 2, 256)} || '.' || {_draw(key, 3, 256)} || '.' || {_draw(key, 4, 256)}
      WHEN 'AADHAAR' THEN {_digits(key, 1, 4, 2000)} || ' ' || {_digits(key, 2, 4)} || ' ' || {_digits(key, 3, 4)}
      WHEN 'DIN' THEN {_digits(key, 1, 8)}
      ELSE '[REDACTED ' || {kind} || ']' END"""


def replacement(text: str, kind: str) -> str:
    key = f"('{V.SEED}|' || lower({text}) || '|' || {kind})"
    return f"CASE WHEN ({value(key, kind)}) <> {text} THEN ({value(key, kind)}) ELSE ({value(f'({key} || {q("|again")})', kind)}) END"


def redacted(source: str, found: str) -> str:
    """(doc_id, seq, redacted_text) of lines with a finding; findings are apart."""
    return f"""
    WITH lines AS ({source}), found AS (SELECT *, {replacement('found', 'entity_type')} AS new FROM ({found})),
    cut AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id, seq ORDER BY a), 0) AS before FROM found)
    SELECT doc_id, seq, string_agg(substr(line, before + 1, a - before) || new, '' ORDER BY a) || substr(any_value(line), max(b) + 1) AS redacted_text
    FROM cut GROUP BY doc_id, seq"""


# ---- the queries ---------------------------------------------------------------------------------------------------------

def refine_birth() -> str:
    dates = scan(DERIVED, "(?i)" + V.DATE, extra=", header_text")
    birth = any_of("lower(header_text)", ("dob", "birth"))
    return f"""SELECT doc_id, found AS text, CASE WHEN header_text IS NOT NULL AND {birth} THEN 0.95 ELSE 0.92 END::DOUBLE AS confidence FROM ({dates})
      WHERE (header_text IS NOT NULL AND {birth}) OR {any_of("lower(coalesce(header_text || ' | ', '') || line)", V.BIRTH)}"""


def refine_phone() -> str:
    low = "lower(line)"
    marked = " OR ".join(f"contains(found, '{c}')" for c in "+-(")
    return f"SELECT doc_id, found AS text, 0.85::DOUBLE AS confidence FROM ({phones(DERIVED)}) WHERE NOT {word_of(low, V.PHONE_STOP_WORDS)} AND ({any_of(low, V.PHONE_LABELS)} OR {marked})"


def refine_aadhaar() -> str:
    low = "lower(line)"
    return f"SELECT doc_id, found AS text, CASE WHEN contains({low}, 'aadhaar') THEN 0.92 ELSE 0.85 END::DOUBLE AS confidence FROM ({scan(DERIVED, V.AADHAAR)}) WHERE NOT {any_of(low, V.CARD_TERMS)}"


def refine_header() -> str:
    low, header, found = "lower(CASE WHEN header_text <> '' THEN header_text || ' | ' || text ELSE text END)", "lower(header_text)", "lower(found)"
    pin, street = f"regexp_matches({low}, '\\b\\d{{6}}\\b')", word_of(low, V.STREET_WORDS)
    several = f"len(list_filter(string_split({low}, ','), lambda x: length(trim(x)) > 3)) > 2"
    person = any_of(low, (*V.PERSON_PREFIXES, *V.PERSON_TITLES))
    return f"""
    WITH c AS ({corpus.header_candidates_sql()}),
    h AS (SELECT *, CASE WHEN contains({header}, 'dob') OR contains({header}, 'birth') THEN ''
                         WHEN contains({header}, 'name') AND entity_type = 'PERSON' THEN 'PERSON'
                         WHEN contains({header}, 'address') AND entity_type = 'ADDRESS_CANDIDATE' THEN 'PHYSICAL_OR_MAILING_ADDRESS'
                         WHEN (contains({header}, 'company') OR contains({header}, 'entity')) AND entity_type = 'COMPANY_CANDIDATE' THEN 'COMPANY' ELSE '' END AS by_header FROM c),
    t AS (SELECT * EXCLUDE (entity_type, confidence), CASE WHEN by_header <> '' THEN by_header ELSE entity_type END AS kind, CASE WHEN by_header <> '' THEN 0.95 ELSE confidence END::DOUBLE AS conf FROM h),
    k AS (SELECT *, CASE kind
        WHEN 'COMPANY_CANDIDATE' THEN NOT {any_of(found, V.DOMAIN_TERMS)} AND ({any_of(found, V.COMPANY_SUFFIXES)} OR {any_of(low, V.COMPANY_LABELS)})
        WHEN 'ADDRESS_CANDIDATE' THEN {any_of(low, V.ADDRESS_LABELS)} OR ({pin} AND {street}) OR ({several} AND ({pin} OR {street}))
        WHEN 'PERSON' THEN NOT {word_of(found, V.PERSON_STOP_WORDS)} AND NOT ((starts_with({found}, 'the ') OR NOT contains(found, ' ')) AND NOT {person}) AND NOT ({word_of(low, V.TECH_STOP_WORDS)} AND NOT {person})
             AND NOT {any_of(found, V.DOMAIN_TERMS)} AND ({person} OR (contains(found, ' ') AND regexp_matches(found, '^[A-Z][a-z]*( [A-Z][a-z]*)*$')))
        ELSE true END AS keep, {person} AS person FROM t)
    SELECT doc_id, found AS text, CASE kind WHEN 'COMPANY_CANDIDATE' THEN 'COMPANY' WHEN 'ADDRESS_CANDIDATE' THEN 'PHYSICAL_OR_MAILING_ADDRESS' ELSE kind END AS entity_type,
      CASE WHEN kind IN ('COMPANY_CANDIDATE', 'ADDRESS_CANDIDATE') OR (kind = 'PERSON' AND person) THEN 0.92 ELSE conf END::DOUBLE AS confidence
    FROM k WHERE keep"""


def addresses(source: str) -> str:
    """(doc_id, seq, line, found, a, b), as the other rows of findings."""
    low = "lower(text)"
    strip = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    rest = f"regexp_replace(text, '(?is)^.*?{V.ADDRESS_SPLIT}', '')"
    return f"""SELECT doc_id, seq, line, found, strpos(line, found)::INT - 1 AS a, strpos(line, found)::INT - 1 + length(found)::INT AS b, CASE WHEN labelled THEN 'context_block' ELSE 'context_implicit' END AS detector FROM (
      SELECT doc_id, seq, text AS line, CASE WHEN {any_of(low, V.ADDRESS_TRIGGERS)} THEN {strip(rest)} ELSE {strip("text")} END AS found, {any_of(low, V.ADDRESS_TRIGGERS)} AS labelled,
             regexp_matches(text, '{V.PIN}') AND contains(text, ',') AND {word_of(low, V.STREET_WORDS)} AS implied FROM ({source}))
      WHERE CASE WHEN labelled THEN length(found) > 10 ELSE implied END"""


def people(source: str) -> str:
    return f"SELECT * FROM ({scan(source, V.NAMES)}) WHERE {any_of('lower(line)', V.PERSON_LIST_TRIGGERS)} AND NOT {word_of('lower(found)', V.PERSON_LIST_STOP_WORDS)}"


def organisations(source: str) -> str:
    cut = f"SELECT doc_id, seq, line, CASE WHEN starts_with(lower(found), 'the ') THEN found[5:] ELSE found END AS found, (a + CASE WHEN starts_with(lower(found), 'the ') THEN 4 ELSE 0 END)::INT AS a, b FROM ({scan(source, V.ORGANISATIONS)})"
    return f"SELECT * FROM ({cut}) WHERE {any_of('lower(line)', V.ORGANISATION_TRIGGERS)} AND NOT {word_of('lower(found)', V.ORGANISATION_STOP_WORDS)} AND length(found) > 3"


def companies(source: str) -> str:
    return scan(source, V.COMPANIES + chr(92) + "b")


def by_patterns(source: str) -> list[tuple[str, float, str]]:
    """Type, confidence and rows of every pattern, over a source with header_text."""
    head = ", header_text"
    return [
        ("EMAIL", V.PATTERN_HIGH, emails(source, head)), ("PHONE", V.PATTERN_MEDIUM, phones(source, head)), ("SSN", V.PATTERN_HIGH, ssns(source, head)), ("CREDIT_CARD", V.PATTERN_HIGH, cards(source, head)),
        ("IP_ADDRESS", V.PATTERN_HIGH, scan(source, V.IP_ADDRESS, extra=head)), ("DATE", V.PATTERN_MEDIUM, scan(source, "(?i)" + V.DATE, extra=head)), ("AADHAAR", V.PATTERN_MEDIUM, scan(source, V.AADHAAR, extra=head)), ("DIN", V.PATTERN_MEDIUM, scan(source, V.DIN, extra=head)),
    ]


def candidates(source: str, context: bool = True) -> str:
    """(doc_id, seq, line, found, a, b, kind, conf, detector, ord): all detectors' findings, refined by header and context; with context also those that it adds."""
    src = "SELECT * FROM src"
    found = by_patterns(src)
    raw = " UNION ALL ".join(f"SELECT doc_id, seq, header_text, line, found, a, b, '{kind}' AS kind, {conf} AS conf, 'regex' AS detector, {k} AS step FROM ({rows})" for k, (kind, conf, rows) in enumerate(found))
    birth, low = any_of("lower(coalesce(header_text, ''))", ("dob", "birth")), "low"
    marked = " OR ".join(f"contains(found, '{c}')" for c in "+-(")
    refined = f"""
      SELECT doc_id, seq, line, found, a, b, detector, step,
             CASE WHEN kind = 'DATE' AND ({birth} OR {any_of(low, V.BIRTH)}) THEN 'DATE_OF_BIRTH' ELSE kind END AS kind,
             CASE WHEN kind = 'DATE' AND {birth} THEN {V.TABLE_HEADER} WHEN (kind = 'DATE' AND {any_of(low, V.BIRTH)}) OR (kind = 'AADHAAR' AND contains({low}, 'aadhaar')) THEN {V.CONTEXT} ELSE conf END AS conf
      FROM (SELECT *, lower(CASE WHEN coalesce(header_text, '') <> '' THEN header_text || ' | ' || line ELSE line END) AS low FROM raw)
      WHERE CASE kind WHEN 'PHONE' THEN NOT {word_of(low, V.PHONE_STOP_WORDS)} AND ({any_of(low, V.PHONE_LABELS)} OR {marked}) WHEN 'AADHAAR' THEN NOT {any_of(low, V.CARD_TERMS)} ELSE true END"""
    added = (("PHYSICAL_OR_MAILING_ADDRESS", "detector", addresses(src)), ("PERSON", "'context_person_list'", people(src)), ("COMPANY", "'context_org_fallback'", organisations(src)), ("COMPANY", "'context_suffix_fallback'", companies(src)))
    more = "".join(f" UNION ALL SELECT doc_id, seq, line, found, a, b, {detector}, {10 + k}, '{kind}', {V.CONTEXT} FROM ({rows})" for k, (kind, detector, rows) in enumerate(added)) if context else ""
    return f"""
    WITH src AS MATERIALIZED ({source}), raw AS ({raw})
    SELECT doc_id, seq, line, found, a, b, kind, conf::DOUBLE AS conf, detector, row_number() OVER (PARTITION BY doc_id, seq ORDER BY step, a) AS ord
    FROM ({refined if context else "SELECT * EXCLUDE (header_text) FROM raw"}{more}) WHERE kind <> 'DATE'"""


#: The detector, where it is the first of a span and type or surer than all before it.
ADDS = "CASE WHEN {conf} > coalesce(max({conf}) OVER (PARTITION BY {key} ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN detector END"


def resolved(rows: str) -> str:
    """(doc_id, seq, line, found, a, b, kind, conf, detector) of the candidates that stay: equal ones merged, then a greedy fold."""
    rank = "CASE {x}.kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.PRIORITY.items()) + " ELSE 0 END"
    new, old = rank.format(x="c[1]"), rank.format(x="p")
    holds, held = "(c[1].a <= p.a AND c[1].b >= p.b)", "(p.a <= c[1].a AND p.b >= c[1].b)"
    beats = f"CASE WHEN c[1].conf <> p.conf THEN c[1].conf > p.conf WHEN {holds} <> {held} THEN {holds} WHEN {new} <> {old} THEN {new} > {old} ELSE c[1].b - c[1].a > p.b - p.a END"
    apart = "greatest(c[1].a, p.a) >= least(c[1].b, p.b)"
    return f"""
    SELECT doc_id, seq, line, e.found AS found, e.a AS a, e.b AS b, e.kind AS kind, e.conf AS conf, e.detector AS detector FROM (SELECT doc_id, seq, line, unnest(kept) AS e FROM (
      SELECT doc_id, seq, line, list_reduce(spans, lambda acc, c: CASE WHEN len(list_filter(acc, lambda p: NOT (({apart}) OR ({beats})))) = 0 THEN list_concat(list_filter(acc, lambda p: {apart}), c) ELSE acc END) AS kept FROM (
        SELECT doc_id, seq, any_value(line) AS line, list([{{'a': a, 'b': b, 'kind': kind, 'conf': conf, 'found': found, 'detector': detector}}] ORDER BY a, a - b, ord) AS spans FROM (
          SELECT doc_id, seq, a, b, kind, any_value(line) AS line, any_value(found) AS found, min(ord) AS ord, max(conf) AS conf, string_agg(adds, ',' ORDER BY ord) AS detector FROM (
            SELECT *, {ADDS.format(key="doc_id, seq, a, b, kind", conf="conf")} AS adds FROM ({rows})) GROUP BY doc_id, seq, a, b, kind) GROUP BY doc_id, seq)))"""


def findings(source: str, context: bool = True) -> str:
    """(doc_id, seq, line, found, a, b, entity_type, conf, detector): what the whole analysis keeps."""
    return f"SELECT * RENAME (kind AS entity_type) FROM ({resolved(candidates(source, context))})"


def audited(source: str, actual: str) -> str:
    """(doc_id, seq, found, entity_type, new, survived, gap_changed): where each replacement and the gap before it should be in the text actual, an expression of line, whole and doc_id."""
    return f"""
    SELECT *, substr(actual, there + 1, length(new)) <> new AS survived, substr(actual, there - (a - before) + 1, a - before) <> substr(line, before + 1, a - before) AS gap_changed FROM (
      SELECT *, {actual} AS actual, (a + coalesce(sum(length(new) - (b - a)) OVER (PARTITION BY doc_id, seq ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS there,
             coalesce(lag(b) OVER (PARTITION BY doc_id, seq ORDER BY a), 0) AS before, lead(b) OVER (PARTITION BY doc_id, seq ORDER BY a) IS NULL AS last FROM (
        SELECT *, {replacement('found', 'entity_type')} AS new FROM ({findings(source)})) JOIN ({redacted(source, findings(source))}) AS r(doc_id, seq, whole) USING (doc_id, seq))"""


def resolve_overlaps(detector: bool = False, modulus: int = 12) -> str:
    rank = "CASE {x}.entity_type WHEN 'EMAIL' THEN 10 WHEN 'PHONE' THEN 10 WHEN 'PHYSICAL_OR_MAILING_ADDRESS' THEN 9 WHEN 'COMPANY' THEN 6 WHEN 'PERSON' THEN 5 WHEN 'DIN' THEN 4 ELSE 0 END"
    new, old = rank.format(x="c[1]"), rank.format(x="p")
    holds, held = "(c[1].a <= p.a AND c[1].b >= p.b)", "(p.a <= c[1].a AND p.b >= c[1].b)"
    beats = f"CASE WHEN c[1].confidence <> p.confidence THEN c[1].confidence > p.confidence WHEN {holds} <> {held} THEN {holds} WHEN {new} <> {old} THEN {new} > {old} ELSE c[1].b - c[1].a > p.b - p.a END"
    apart = "greatest(c[1].a, p.a) >= least(c[1].b, p.b)"
    return f"""
    WITH one AS (SELECT doc_id, a, b, entity_type, min(ord) AS ord, max(confidence) AS confidence, string_agg(adds, ',' ORDER BY ord) AS detector FROM (
      SELECT *, {ADDS.format(key="doc_id, a, b, entity_type", conf="confidence")} AS adds FROM (SELECT *, 'line ' || ord AS detector FROM ({corpus.spans_sql(modulus)}))) GROUP BY doc_id, a, b, entity_type),
    listed AS (SELECT doc_id, list([{{'a': a, 'b': b, 'entity_type': entity_type, 'confidence': confidence, 'detector': detector}}] ORDER BY a, a - b, ord, entity_type) AS spans FROM one GROUP BY doc_id),
    folded AS (SELECT doc_id, list_reduce(spans, lambda acc, c: CASE WHEN len(list_filter(acc, lambda p: NOT (({apart}) OR ({beats})))) = 0 THEN list_concat(list_filter(acc, lambda p: {apart}), c) ELSE acc END) AS kept FROM listed)
    SELECT doc_id, e.a AS start_at, e.b AS end_at, e.entity_type, e.confidence {", e.detector" if detector else ""} FROM (SELECT doc_id, unnest(kept) AS e FROM folded)"""


TURNS = "SELECT conv_id AS doc_id, turn AS seq, text, NULL::VARCHAR AS header_text FROM conversations WHERE regexp_matches(text, '\\S')"
HEADED_LINES = f"SELECT *, NULL::VARCHAR AS header_text FROM ({LINES})"
#: What `queries._gold` expects of the derived lines.
_FIRST, _SECOND = "'user' || k || '@mail' || k % 9 || '.example.com'", "k || '@x.org'"


def hits(found: str) -> str:
    """The findings in derived lines, with k and hit: whether the line expects them."""
    expected = f"CASE kind WHEN 'email' THEN entity_type = 'EMAIL' AND (found = {_FIRST} OR (found = {_SECOND} AND k % 5 <> 0)) WHEN 'ssn' THEN entity_type = 'SSN' AND found = substr(line, 5, 11) AND k % 2 = 0 ELSE false END"
    return f"SELECT *, {expected} AS hit FROM (SELECT *, doc_id // 100 AS k FROM ({found}) JOIN (SELECT line_id AS doc_id, kind FROM ({corpus.derived_sql()})) USING (doc_id))"


def evaluation(found: str) -> str:
    """(category, tp, fp, fn) of every type."""
    wanted = f"""SELECT 'EMAIL' AS category, sum(CASE WHEN k % 5 <> 0 THEN 2 ELSE 1 END + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END) AS n FROM (SELECT c_custkey AS k FROM customer)
      UNION ALL SELECT 'SSN', count(*) FILTER (WHERE c_custkey % 2 = 0) FROM customer"""
    return f"""SELECT category, coalesce(tp, 0)::BIGINT AS tp, coalesce(fp, 0)::BIGINT AS fp, (coalesce(n, 0) - coalesce(tp, 0))::BIGINT AS fn FROM (SELECT unnest([{', '.join(map(q, V.ENTITY_TYPES))}]) AS category)
      LEFT JOIN (SELECT entity_type AS category, count(*) FILTER (WHERE hit) AS tp, count(*) FILTER (WHERE NOT hit) AS fp FROM ({hits(found)}) GROUP BY entity_type) USING (category) LEFT JOIN ({wanted}) USING (category)"""


def scores(counts: str, always: bool) -> str:
    share = lambda x, y: f"coalesce({x}::DOUBLE / nullif({y}, 0), 0)"
    p, r = share("tp", "tp + fp"), share("tp", "tp + fn")
    wrap = (lambda x: x) if always else (lambda x: f"CASE WHEN tp + fn > 0 THEN {x} END")
    return f"SELECT *, {wrap(p)} AS precision, {wrap(r)} AS recall, {wrap(f'coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0)')} AS f1 FROM ({counts})"


def failures(found: str) -> str:
    ssn_missing = f"SELECT line_id AS doc_id, 'SSN' AS entity_type, substr(text, 5, 11) AS text FROM ({corpus.derived_sql()}) WHERE kind = 'ssn' AND line_id // 100 % 2 = 0 AND line_id NOT IN (SELECT doc_id FROM ({hits(found)}) WHERE hit)"
    nobody = f"SELECT line_id, 'EMAIL', 'nobody@nowhere.net' FROM ({corpus.derived_sql()}) WHERE kind = 'email' AND line_id // 100 % 7 = 0"
    return f"SELECT doc_id, 'false positive' AS failure, entity_type, found AS text FROM ({hits(found)}) WHERE NOT hit UNION ALL SELECT doc_id, 'false negative', entity_type, text FROM ({ssn_missing} UNION ALL {nobody})"


def failure_report(found: str) -> str:
    """The failures with all that is written of them."""
    wanted = f"SELECT line_id AS doc_id, text AS line, kind, line_id // 100 AS k FROM ({corpus.derived_sql()})"
    missing = f"SELECT doc_id, 'SSN' AS entity_type, substr(line, 5, 11) AS text, line FROM ({wanted}) WHERE kind = 'ssn' AND k % 2 = 0 AND doc_id NOT IN (SELECT doc_id FROM ({hits(found)}) WHERE hit) UNION ALL SELECT doc_id, 'EMAIL', 'nobody@nowhere.net', line FROM ({wanted}) WHERE kind = 'email' AND k % 7 = 0"
    return f"""SELECT 'false positive' AS failure, found AS text, entity_type, detector AS detector_source, conf AS confidence, 'Paragraph 0' AS location, line AS surrounding_context FROM ({hits(found)}) WHERE NOT hit
      UNION ALL SELECT 'false negative', text, entity_type, NULL, NULL, 'Paragraph 0', line FROM ({missing})"""


#: Web pages without scripts, styles and tags, line by line.
_BARE = "regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g'), '(?s)<[^>]*>', chr(10), 'g')"
for _sign, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _BARE = f"replace({_BARE}, '{_sign}', '{_char}')"
PAGE_LINES = f"SELECT *, NULL::VARCHAR AS header_text FROM (SELECT page_id AS doc_id, (generate_subscripts(string_split(bare, chr(10)), 1) - 1)::INT AS seq, unnest(string_split(bare, chr(10))) AS text FROM (SELECT page_id, {_BARE} AS bare FROM pages)) WHERE regexp_matches(text, '\\S')"


def runs(found: str, size: int) -> str:
    """(doc_id, run_index, text): derived lines cut into runs of size, with the findings exchanged in them.

    A run keeps what lies between the findings that touch it, and has the replacement of each that begins in it.
    """
    pieces = f"SELECT line_id AS doc_id, text AS line, unnest(range(0, ((length(text) - 1) // {size} + 1)::BIGINT)) AS i FROM ({corpus.derived_sql()})"
    return f"""
    WITH runs AS (SELECT doc_id, line, i::INT AS run_index, i * {size} AS ra, least((i + 1) * {size}, length(line)) AS rb FROM ({pieces})),
    found AS (SELECT doc_id, a, b, {replacement('found', 'entity_type')} AS new FROM ({found})),
    met AS (SELECT runs.*, a, b, new, coalesce(lag(least(b, rb)) OVER (PARTITION BY runs.doc_id, run_index ORDER BY a), ra) AS spot FROM runs JOIN found ON runs.doc_id = found.doc_id AND a < rb AND b > ra),
    done AS (SELECT doc_id, run_index, string_agg(substr(line, spot + 1, greatest(a - spot, 0)) || CASE WHEN a >= ra THEN new ELSE '' END, '' ORDER BY a) || substr(any_value(line), max(least(b, rb)) + 1, any_value(rb) - max(least(b, rb))) AS text FROM met GROUP BY doc_id, run_index)
    SELECT doc_id, run_index, coalesce(done.text, substr(line, ra + 1, rb - ra)) AS text FROM runs LEFT JOIN done USING (doc_id, run_index)"""


def overlaps(one: str, other: str) -> str:
    """Pairs of findings of two analyses that share code points."""
    return f"""SELECT x.doc_id, x.seq, x.a AS start_at, x.b AS end_at, x.entity_type, y.a AS other_start, y.b AS other_end, y.entity_type AS other_type, (least(x.b, y.b) - greatest(x.a, y.a))::INT AS shared
      FROM ({one}) AS x JOIN ({other}) AS y ON x.doc_id = y.doc_id AND x.seq = y.seq AND x.a < y.b AND y.a < x.b"""


#: What `queries._audited` makes of the redacted text.
ACTUAL = "CASE doc_id // 100 % 3 WHEN 0 THEN line WHEN 1 THEN whole ELSE whole || ' etc.' END"


def dictionary_names() -> str:
    """Listed names at word edges, the longest where several begin; mentions are the two places where a name can begin."""
    word = "'[\\p{L}\\p{N}_]'"
    return f"""
    WITH lines AS ({corpus.mentions_sql()}), listed AS ({corpus.dictionary_sql()}),
    places AS (SELECT doc_id, text, a, substr(text, a, 18) AS base FROM (SELECT *, unnest([strpos(text, 'Customer#'), strpos(text, ' via ') + 5]) AS a FROM lines)),
    met AS (SELECT doc_id, name, label, a, text FROM places JOIN (SELECT *, substr(name, 1, 18) AS base FROM listed) USING (base) WHERE substr(text, a, length(name)) = name
      AND NOT regexp_matches(substr(text, a + length(name), 1), {word}) AND (a = 1 OR NOT regexp_matches(substr(text, a - 1, 1), {word})))
    SELECT doc_id, arg_max(name, length(name)) AS text, CASE arg_max(label, length(name)) WHEN 'ORG' THEN 'COMPANY_CANDIDATE' ELSE 'PERSON' END AS entity_type, (a - 1)::INT AS start_at, (a - 1 + max(length(name)))::INT AS end_at FROM met GROUP BY doc_id, a"""


def event_windows(sessions: bool) -> str:
    """Windows of six hours, or users' sessions with gaps below three, that are over an hour before the latest event with a finding."""
    lines = f"SELECT doc_id, seq, text, NULL::VARCHAR AS header_text FROM ({corpus.logged_sql()})"
    found = f"SELECT ts, user_id, entity_type FROM ({findings(lines, context=False)}) JOIN (SELECT event_id AS doc_id, ts, user_id FROM events) USING (doc_id)"
    over = "<= date_trunc('milliseconds', (SELECT max(ts) FROM found)) - INTERVAL 1 HOUR"
    if not sessions:
        return f"WITH found AS ({found}) SELECT * FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS starts, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS ends, entity_type, count(*) AS n FROM found GROUP BY ALL) WHERE ends {over}"
    return f"""WITH found AS ({found}), marked AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 3 HOUR, true) AS new FROM found),
      numbered AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM marked)
      SELECT starts, ends, user_id, n FROM (SELECT min(ts) AS starts, max(ts) + INTERVAL 3 HOUR AS ends, user_id, k, count(*) AS n FROM numbered GROUP BY user_id, k) WHERE ends {over}"""


def oracle_sql() -> dict[str, str]:
    everything, derived = findings(HEADED_LINES), findings(DERIVED)
    patterns = findings(HEADED_LINES, context=False)
    counted = f"SELECT doc_id, count(*) AS n FROM ({everything}) GROUP BY doc_id"
    audit = audited(DERIVED, ACTUAL)
    changes = f"SELECT doc_id, substr(line, before + 1, a - before) AS expected, substr(actual, there - (a - before) + 1, a - before) AS actual FROM ({audit}) WHERE gap_changed UNION ALL SELECT doc_id, substr(line, b + 1), substr(actual, there + length(new) + 1) FROM ({audit}) WHERE last AND substr(line, b + 1) <> substr(actual, there + length(new) + 1)"
    found_per_line = f"SELECT doc_id, seq, count(*) AS n_entities FROM ({everything}) GROUP BY doc_id, seq"
    of_lines = f"""({DERIVED}) AS lines LEFT JOIN (SELECT doc_id, count(*) AS c FROM ({candidates(DERIVED)}) GROUP BY doc_id) USING (doc_id)
      LEFT JOIN (SELECT doc_id, count(*) AS r FROM ({derived}) GROUP BY doc_id) USING (doc_id)"""
    raw = " UNION ALL ".join(f"SELECT doc_id, seq, '{kind}' AS entity_type, found AS text, a AS start_at, b AS end_at, {conf}::DOUBLE AS confidence FROM ({rows})" for kind, conf, rows in by_patterns(HEADED_LINES))
    bare = f"SELECT * REPLACE (NULL::VARCHAR AS header_text) FROM ({DERIVED})"
    of_kind = {"EMAIL": emails(LINES), "IP_ADDRESS": scan(LINES, V.IP_ADDRESS), "CREDIT_CARD": cards(LINES)}
    return {
        "sql_analyze": f"SELECT *, {replacement('text', 'entity_type')} AS replacement FROM ({raw})",
        "sql_redact_kinds": " UNION ALL ".join(f"SELECT *, '{kind}' AS entity_type FROM ({redacted(LINES, f"SELECT *, '{kind}' AS entity_type FROM ({rows})")})" for kind, rows in of_kind.items()),
        "distinct_findings": f"SELECT lang, entity_type, count(*) AS n, count(DISTINCT lower(found)) AS n_distinct, true AS near FROM ({patterns}) JOIN documents USING (doc_id) GROUP BY lang, entity_type",
        "packaged_documents": f"SELECT (doc_id // 10000 % 10) || '/c' || (doc_id // 10000) || '.docx' AS doc_id, (row_number() OVER (PARTITION BY doc_id // 10000 ORDER BY doc_id) - 1)::INT AS seq, ((length(text) - 1) // 11 + 1)::INT AS n_runs, coalesce(redacted_text, text) AS text FROM ({DERIVED}) AS lines LEFT JOIN ({redacted(bare, findings(bare))}) AS done USING (doc_id)",
        "detect_email": spans(emails(LINES)),
        "detect_phone": spans(phones(LINES)),
        "detect_ip_address": spans(scan(LINES, V.IP_ADDRESS)),
        "detect_date": spans(scan(LINES, "(?i)" + V.DATE)),
        "detect_credit_card": spans(cards(LINES)),
        "detect_credit_card_derived": spans(cards(DERIVED)),
        "detect_ssn": spans(ssns(DERIVED)),
        "detect_aadhaar": spans(scan(DERIVED, V.AADHAAR)),
        "detect_din": spans(scan(DERIVED, V.DIN)),
        "refine_birth_date": refine_birth(),
        "refine_phone": refine_phone(),
        "refine_aadhaar": refine_aadhaar(),
        "refine_header_context": refine_header(),
        "context_address": spans_of_lines(addresses(DERIVED)),
        "context_person_list": spans_of_lines(people(DERIVED)),
        "context_organisation": spans_of_lines(organisations(DERIVED)),
        "context_company_suffix": spans_of_lines(companies(DERIVED)),
        "resolve_overlaps": resolve_overlaps(),
        "stream_event_windows": event_windows(sessions=False),
        "stream_event_sessions": event_windows(sessions=True),
        "resolve_detectors": resolve_overlaps(detector=True, modulus=3),
        "redact_runs": runs(derived, 7),
        "span_overlaps": overlaps(patterns, everything),
        "failure_report": failure_report(derived),
        "page_entities": f"SELECT doc_id, seq, found AS text, entity_type, conf AS confidence, detector FROM ({findings(PAGE_LINES)})",
        "pipeline_stats_places": f"SELECT doc_id // 100 AS doc_id, count(*) AS processed_paragraphs, sum(coalesce(r, 0))::BIGINT AS entities_replaced, sum(CASE WHEN doc_id % 100 % 3 = 0 THEN coalesce(r, 0) ELSE 0 END)::BIGINT AS replacements_in_tables, sum(CASE WHEN doc_id % 100 % 5 < 2 THEN coalesce(r, 0) ELSE 0 END)::BIGINT AS replacements_in_headers_footers FROM {of_lines} GROUP BY doc_id // 100",
        "audit_report_files": f"SELECT 'surviving' AS part, doc_id, 0 AS seq, found AS one, substr(actual, there + 1, length(new)) AS other, detector FROM ({audit}) WHERE survived UNION ALL SELECT 'change', doc_id, 0, expected, actual, NULL FROM ({changes})",
        "gold_files": scores(evaluation(findings(bare)), False),
        "pseudonym_seed": f"SELECT c_custkey AS doc_id, {_number(f"'{V.SEED}|' || lower(c_name) || '|PERSON'", 8)} AS seed_number FROM customer",
        "pseudonymize": f"SELECT doc_id, entity_type, {replacement('text', 'entity_type')} AS replacement FROM (SELECT c_custkey AS doc_id, c_name AS text, unnest([{', '.join(map(q, (*V.ENTITY_TYPES, 'OTHER')))}]) AS entity_type FROM customer)",
        "redact_documents": f"SELECT * FROM ({redacted(HEADED_LINES, everything)}) JOIN ({found_per_line}) USING (doc_id, seq)",
        "redact_derived": f"SELECT doc_id, coalesce(c, 0) AS n_candidates, coalesce(r, 0) AS n_entities, coalesce(redacted_text, text) AS redacted_text FROM {of_lines} LEFT JOIN ({redacted(DERIVED, derived)}) AS done USING (doc_id)",
        "redact_patterns": redacted(HEADED_LINES, patterns),
        "stream_redact": redacted(HEADED_LINES, everything),
        "sql_redact": redacted(HEADED_LINES, everything),
        "entity_counts_by_type": f"SELECT entity_type, count(*) AS n FROM ({everything}) GROUP BY entity_type",
        "entity_rollup_lang": f"SELECT lang, entity_type, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({everything}) JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, entity_type)",
        "pipeline_stats": f"SELECT doc_id, p AS processed_paragraphs, coalesce(n, 0) AS entities_replaced FROM (SELECT doc_id, count(*) AS p FROM ({LINES}) GROUP BY doc_id) LEFT JOIN ({counted}) USING (doc_id)",
        "pipeline_stats_all": f"SELECT doc_id // 100 AS doc_id, count(*) AS processed_paragraphs, sum(coalesce(c, 0))::BIGINT AS total_candidates, sum(coalesce(c, 0) - coalesce(r, 0))::BIGINT AS rejected_by_resolver, sum(coalesce(r, 0))::BIGINT AS entities_replaced, 0::BIGINT AS replacements_in_tables, 0::BIGINT AS replacements_in_headers_footers, 0::BIGINT AS low_confidence_entities FROM {of_lines} GROUP BY doc_id // 100",
        "clean_documents": f"SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({everything}))",
        "top_documents": f"SELECT doc_id, n FROM ({counted}) ORDER BY n DESC, doc_id LIMIT 20",
        "tabular_redaction": f"SELECT c_custkey AS doc_id, {replacement('c_name', "'PERSON'")} AS replacement, c_name AS text FROM customer",
        "evaluate_categories": scores(evaluation(derived), False),
        "evaluate_overall": scores(f"SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM ({evaluation(derived)})", True),
        "evaluation_failures": failures(derived),
        "audit_coverage": f"SELECT count(*) AS total, count(*) FILTER (WHERE NOT survived) AS redacted, count(*) FILTER (WHERE survived) AS survived, (SELECT count(*) FROM ({changes})) AS unintended_changes, (count(*) FILTER (WHERE NOT survived))::DOUBLE / count(*) AS coverage FROM ({audit})",
        "audit_shared_places": f"""WITH one AS (SELECT doc_id // 100 AS doc_id, coalesce(redacted_text, text) AS t, coalesce(r, 0) AS r, doc_id AS line FROM {of_lines} LEFT JOIN ({redacted(DERIVED, derived)}) AS done USING (doc_id)),
            other AS (SELECT doc_id, CASE WHEN line % 7 = 0 THEN substr(t, 2) ELSE t END AS t FROM one WHERE line % 11 <> 0),
            x AS (SELECT *, row_number() OVER (PARTITION BY doc_id, t ORDER BY line) AS nth FROM one), y AS (SELECT *, row_number() OVER (PARTITION BY doc_id, t) AS nth FROM other),
            left_x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY t) AS k FROM x ANTI JOIN y USING (doc_id, t, nth)), left_y AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY t) AS k FROM y ANTI JOIN x USING (doc_id, t, nth))
            SELECT doc_id, count(*) AS paragraphs, sum(r)::BIGINT AS total, sum(d)::BIGINT AS different FROM (SELECT doc_id, r, 0 AS d FROM x SEMI JOIN y USING (doc_id, t, nth) UNION ALL SELECT doc_id, r, 1 FROM left_x SEMI JOIN left_y USING (doc_id, k)) GROUP BY doc_id""",
        "audit_surviving": f"SELECT doc_id, found AS original_text, entity_type, new AS expected_replacement, substr(actual, there + 1, length(new)) AS actual_text FROM ({audit}) WHERE survived",
        "audit_changes": changes,
        "audit_categories": f"SELECT entity_type AS category, count(*) AS total, count(*) FILTER (WHERE survived) AS survived FROM ({audit}) GROUP BY entity_type",
        "memo_propagation": "SELECT c_custkey AS doc_id, s AS seq, 'Asha Rao' || chr(97 + (c_custkey % 26)::INT) AS text, place AS start_at, detector FROM customer, (VALUES (0, 0, 'cell'), (2, 6, 'stateful_memo'), (2, 5, 'stateful_memo')) AS v(s, place, detector)",
        "dictionary_names": dictionary_names(),
        "conversation_stats": f"SELECT conv_id, count(*) AS turns, coalesce(sum(c), 0)::BIGINT AS total_candidates, coalesce(sum(r), 0)::BIGINT AS entities_replaced FROM (SELECT * FROM conversations WHERE regexp_matches(text, '\\S')) LEFT JOIN (SELECT doc_id AS conv_id, seq AS turn, count(*) AS c FROM ({candidates(TURNS)}) GROUP BY ALL) USING (conv_id, turn) LEFT JOIN (SELECT doc_id AS conv_id, seq AS turn, count(*) AS r FROM ({findings(TURNS)}) GROUP BY ALL) USING (conv_id, turn) GROUP BY conv_id",
    }

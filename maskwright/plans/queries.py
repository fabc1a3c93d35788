"""The registered queries: each applies one operator, or the whole plan, to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright import vocab as V
from maskwright.functions import pseudonym
from maskwright.functions import text as T
from maskwright.operators import audit as auditing
from maskwright.operators import context, detect, measure, names, overlap, refine, resolve, sketches, tagger
from maskwright.plans import corpus, functions, pipeline, surface
from maskwright.sources import docx, packages, tables
from maskwright.storage import Tables
from maskwright.streaming import micro, windows

Query = Callable[[SparkSession, str], DataFrame]
#: Patterns of every type, without what context says of them.
PATTERNS = pipeline.Config(detectors=("patterns",), drop_intermediate=True, use_memo=False)


def _load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.lines(_load(spark, sf_dir, "documents").select("doc_id", "text"))


def _spans(found: DataFrame, *keys: str) -> DataFrame:
    rows = found.select(*keys, F.explode("e").alias("e"))
    return rows.select(*keys, F.col("e.text").alias("text"), F.col("e.start").alias("start_at"), F.col("e.end").alias("end_at"))


def _detection(find: Callable[[Column], Column], source=_lines) -> Query:
    return lambda spark, sf_dir: _spans(source(spark, sf_dir).withColumn("e", T.once(find(F.col("text")))), "doc_id", "seq")


def _generation(find: Callable[[Column], Column]) -> Query:
    return lambda spark, sf_dir: _spans(corpus.derived(spark, sf_dir).withColumn("e", T.once(find(F.col("text")))), "doc_id")


def _refinement(kind: str, find: Callable[[Column], Column]) -> Query:
    def query(spark, sf_dir):
        rows = corpus.derived(spark, sf_dir)
        refined = refine.refine(rows.withColumn("candidates", T.once(find(F.col("text")))))
        return refined.select("doc_id", F.explode("refined").alias("e")).where(F.col("e.entity_type") == kind).select("doc_id", "e.text", "e.confidence")

    return query


def refine_header_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(corpus.header_candidates_sql("{customer}"), customer=_load(spark, sf_dir, "customer"))
    one = T.entity(F.col("found"), F.col("entity_type"), F.lit(0), F.length("found"), F.col("confidence"), V.NAME_DETECTOR)
    refined = refine.refine(rows.withColumn("candidates", F.array(one)))
    return refined.select("doc_id", F.explode("refined").alias("e")).select("doc_id", "e.text", "e.entity_type", "e.confidence")


def _resolved_spans(spark: SparkSession, sf_dir: str, modulus: int) -> DataFrame:
    """Four numbers of each line are dealt by order, and nothing else is; spans are made, listed and resolved where these lie."""
    lineitem = _load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    lineitem = lineitem.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")  # few bytes, much work: not to be put together
    rows = spark.sql(corpus.spans_sql(modulus, "{lineitem}"), lineitem=lineitem)
    listed = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "entity_type", "a", "b", "confidence"))).alias("es"))
    one = lambda x: T.entity(F.lit("x"), x["entity_type"], x["a"], x["b"], x["confidence"], F.concat(F.lit("line "), x["ord"]), x["ord"])
    listed = listed.select("doc_id", T.once(F.transform("es", one)).alias("es"))
    kept = listed.select("doc_id", T.once(resolve.resolve(F.col("es"))).alias("kept"))
    found = kept.select("doc_id", F.explode("kept").alias("e"))
    return found.select("doc_id", F.col("e.start").alias("start_at"), F.col("e.end").alias("end_at"), "e.entity_type", "e.confidence", "e.detector")


def resolve_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved_spans(spark, sf_dir, 12).drop("detector")


def resolve_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of which many are equal: the one that is kept names all detectors that made it surer."""
    return _resolved_spans(spark, sf_dir, 3)


def redact_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived lines in runs of seven characters, as a document's paragraphs are, with the replacements inside the runs."""
    at = F.sequence(F.lit(0), F.expr("(length(text) - 1) div 7").cast("int"))
    lines = corpus.derived(spark, sf_dir).withColumn("runs", F.transform(at, lambda i: F.struct(i.alias("run_index"), F.substring("text", i * 7 + 1, F.lit(7)).alias("text"))))
    return pipeline.redact(lines).select("doc_id", F.explode("redacted_runs").alias("r")).select("doc_id", "r.run_index", "r.text")


def span_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What patterns alone find, against what the whole analysis finds at the same places of all lines."""
    lines = _lines(spark, sf_dir)
    found = lambda config: pipeline.entities(pipeline.analyse(lines, config)).select("doc_id", "seq", "start", "end", "entity_type")
    pairs = overlap.overlapping(found(PATTERNS), found(pipeline.Config()))
    return pairs.select("doc_id", "seq", F.col("one.start").alias("start_at"), F.col("one.end").alias("end_at"), F.col("one.entity_type").alias("entity_type"), F.col("other.start").alias("other_start"), F.col("other.end").alias("other_end"), F.col("other.entity_type").alias("other_type"), "shared")


def pseudonym_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), pseudonym.seed_number(F.col("c_name"), F.lit("PERSON")).alias("seed_number"))


def pseudonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name", F.explode(F.array(*[F.lit(k) for k in (*V.ENTITY_TYPES, "OTHER")])).alias("entity_type"))
    return rows.select("doc_id", "entity_type", pseudonym.replacement(F.col("c_name"), F.col("entity_type")).alias("replacement"))


def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every detector, refinement, resolution and replacement over all lines of all documents."""
    done = pipeline.redact(_lines(spark, sf_dir))
    return done.where(F.size("resolved") > 0).select("doc_id", "seq", F.size("resolved").alias("n_entities"), "redacted_text")


def redact_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pipeline.redact(corpus.derived(spark, sf_dir))
    return done.select("doc_id", F.size("candidates").alias("n_candidates"), F.size("resolved").alias("n_entities"), "redacted_text")


def redact_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.redact(_lines(spark, sf_dir), PATTERNS).where(F.size("resolved") > 0).select("doc_id", "seq", "redacted_text")


def stream_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of files, by micro-batches."""
    return micro.redact_files(spark, f"{sf_dir}/documents.parquet", pipeline.Config()).where("n_entities > 0").select("doc_id", "seq", "redacted_text")


def _events_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a stream of events, with time and user."""
    lines = spark.sql(corpus.logged_sql("{events}"), events=micro.source(spark, f"{sf_dir}/events.parquet"))
    return windows.found_at(lines.withColumn("ts", F.col("ts").cast("timestamp")), PATTERNS, ("ts", "user_id"))


def _times() -> tuple[Column, Column]:
    """Start and end without a time zone, as in the table of events."""
    return F.col("start").cast("timestamp_ntz").alias("starts"), F.col("end").cast("timestamp_ntz").alias("ends")


def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each type by six hours of event time, of those windows that an hour's delay lets end."""
    counted = windows.by_window(_events_found(spark, sf_dir), "6 hours", "1 hour")
    return micro.stored(counted).select(*_times(), "entity_type", "n")


def stream_event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's sessions of findings, none more than three hours after the one before, of those that an hour's delay lets end."""
    counted = windows.by_session(_events_found(spark, sf_dir), "3 hours", "1 hour", "user_id")
    return micro.stored(counted).select(*_times(), "user_id", "n")


def sql_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the views for SQL."""
    _, entities, redacted = surface.register(spark, _lines(spark, sf_dir), prefix="documents")
    return spark.sql(f"SELECT doc_id, seq, redacted_text FROM {redacted} LEFT SEMI JOIN {entities} USING (doc_id, seq)")


def sql_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What patterns find in all lines, with replacements, through the functions for SQL."""
    functions.register(spark)
    analyzed = "SELECT l.doc_id, l.seq, e.* FROM {lines} l, LATERAL maskwright_analyze(l.text) e"
    return spark.sql(f"SELECT doc_id, seq, entity_type, text, start_at, end_at, confidence, maskwright_replacement(text, entity_type) AS replacement FROM ({analyzed})", lines=_lines(spark, sf_dir))


def sql_redact_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the findings of a single pattern exchanged, through the function for SQL."""
    functions.register(spark)
    of_kind = "SELECT doc_id, seq, text, '{0}' AS entity_type, maskwright_redact(text, '{0}') AS redacted_text FROM {{lines}}"
    every = " UNION ALL ".join(of_kind.format(kind) for kind in ("EMAIL", "IP_ADDRESS", "CREDIT_CARD"))
    return spark.sql(f"SELECT doc_id, seq, entity_type, redacted_text FROM ({every}) WHERE redacted_text <> text", lines=_lines(spark, sf_dir))


def distinct_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different texts each language's findings have: counted, and whether what sketches say is within four standard errors of it.

    The sketches are by source too, kept in a folder, and merged over the sources.
    """
    tables_ = Tables(spark)
    lines = tables.lines(_load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), keep=("lang", "source"))
    found = pipeline.analyse(lines, PATTERNS).where(F.size("resolved") > 0).select("lang", "source", F.explode("resolved").alias("e"))
    found = tables_.put(found.select("lang", "source", "e.entity_type", F.lower("e.text").alias("said")), "found")
    folder = f"{tables_.root}/sketches"
    sketches.add(sketches.sketched(found, ("lang", "source", "entity_type"), "said"), folder, 0)
    said = sketches.estimated(sketches.merged(sketches.kept(spark, folder), ("lang", "entity_type"))).withColumnRenamed("n_distinct", "said")
    counted = found.groupBy("lang", "entity_type", "said").agg(F.count("*").alias("n")).groupBy("lang", "entity_type").agg(F.sum("n").alias("n"), F.count("*").alias("n_distinct"))
    same = F.col("c.lang").eqNullSafe(F.col("s.lang")) & (F.col("c.entity_type") == F.col("s.entity_type"))
    near = F.abs(F.col("said") - F.col("n_distinct")) <= F.greatest(F.lit(1), 4 * sketches.error() * F.col("n_distinct"))
    return counted.alias("c").join(said.alias("s"), same).select("c.lang", "c.entity_type", "c.n", "n_distinct", (near & (F.col("c.n") == F.col("s.n"))).alias("near"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.entities(pipeline.analyse(_lines(spark, sf_dir)))


def entity_counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.counts_by_type(_found(spark, sf_dir))


def entity_rollup_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.lines(_load(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep=("lang",))
    found = pipeline.analyse(lines).where(F.size("resolved") > 0).select("doc_id", "lang", F.explode("resolved.entity_type").alias("entity_type"))
    return found.rollup("lang", "entity_type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def pipeline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.stats(pipeline.analyse(_lines(spark, sf_dir))).select("doc_id", "processed_paragraphs", "entities_replaced")


def packaged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived lines of a hundred customers each as a packaged document of runs, written as files, read, redacted in the runs, written and read again."""
    folder = f"{Tables(spark).root}/packages"
    packages.register(spark)
    at = F.sequence(F.lit(0), F.expr("(length(text) - 1) div 11").cast("int"))
    texts = F.transform(at, lambda i: F.substring("text", i * 11 + 1, F.lit(11)))
    path = F.expr("concat(doc_id div 10000 % 10, '/c', doc_id div 10000, '.docx')").alias("path")
    made = docx.packed(corpus.derived(spark, sf_dir).select(path, F.col("doc_id").alias("seq"), texts.alias("texts")))
    made.write.format("docx").mode("append").save(f"{folder}/plain")
    files = docx.read(spark, f"{folder}/plain/*").withColumn("path", F.substring_index("path", "/plain/", -1))
    runs = pipeline.redact(spark.read.format("docx").load(f"{folder}/plain")).where(F.size("replaced") > 0).select("doc_id", "seq", "redacted_runs")
    files = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")  # few bytes, much work: not to be put together again
    docx.rewritten(files, runs).write.format("docx").mode("append").save(f"{folder}/redacted")
    return spark.read.format("docx").load(f"{folder}/redacted").select("doc_id", "seq", F.size("runs").alias("n_runs"), "text")


def pipeline_stats_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.stats(pipeline.analyse(corpus.derived(spark, sf_dir).withColumn("doc_id", F.expr("doc_id div 100"))))


def pipeline_stats_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived lines, a third of them in tables, two fifths in headers or footers."""
    kind = F.col("doc_id") % 100
    none = F.lit(None).cast("int")
    loc = F.struct(none.alias("paragraph_index"), F.when(kind % 3 == 0, 0).alias("table_index"), none.alias("row_index"), none.alias("cell_index"), (kind % 5 == 0).alias("is_header"), (kind % 5 == 1).alias("is_footer"))
    rows = pipeline.analyse(corpus.derived(spark, sf_dir).withColumn("loc", loc.cast(tables.LOCATION))).withColumn("doc_id", F.expr("doc_id div 100"))
    return measure.stats(rows).select("doc_id", "processed_paragraphs", "entities_replaced", "replacements_in_tables", "replacements_in_headers_footers")


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _load(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return docs.join(_found(spark, sf_dir).select("doc_id"), "doc_id", "left_anti")


def top_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents with most findings."""
    return _found(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc_id").limit(20)


def tabular_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's column as cells under a header, all of them names by a detector of its own."""
    customers = _load(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("Full Name"))
    whole = lambda text: F.array(T.entity(text, "PERSON", F.lit(0), F.length(text), V.TABLE_HEADER, "cell"))
    done = pipeline.redact(tables.cells(customers, "c_custkey"), pipeline.Config(detectors=(whole,), use_memo=False))
    return done.select("doc_id", "text", F.col("redacted_text").alias("replacement"))


def _gold(rows: DataFrame) -> DataFrame:
    """Derived lines with what is expected of them: two e-mail addresses of which one in ten isn't, half of the social security numbers, and an address that isn't there."""
    k, kind = F.expr("doc_id div 100"), F.col("kind")
    gold = lambda name, text: F.struct(F.lit(name).alias("type"), text.alias("text"))
    none = F.array().cast("array<struct<type:string,text:string>>")
    first = gold("EMAIL", F.concat(F.lit("user"), k.cast("string"), F.lit("@mail"), (k % 9).cast("string"), F.lit(".example.com")))
    second = gold("EMAIL", F.concat(k.cast("string"), F.lit("@x.org")))
    there = F.when(k % 5 != 0, F.array(first, second)).otherwise(F.array(first))
    gone = F.when(k % 7 == 0, F.array(gold("EMAIL", F.lit("nobody@nowhere.net")))).otherwise(none)
    number = F.when(k % 2 == 0, F.array(gold("SSN", F.substring("text", 5, 11)))).otherwise(none)
    return rows.withColumn("entities", F.when(kind == "email", F.concat(there, gone)).when(kind == "ssn", number).otherwise(none))


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.evaluated(pipeline.analyse(_gold(corpus.derived(spark, sf_dir))))


def evaluate_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.category_scores(measure.category_counts(_evaluated(spark, sf_dir)))


def evaluate_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.overall_scores(measure.category_counts(_evaluated(spark, sf_dir)))


def evaluation_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = _evaluated(spark, sf_dir)
    row = lambda what, e, kind: F.struct(F.lit(what).alias("failure"), e[kind].alias("entity_type"), e["text"].alias("text"))
    rows = F.concat(F.transform("outcome.false_positives", lambda e: row("false positive", e, "entity_type")), F.transform("outcome.false_negatives", lambda e: row("false negative", e, "type")))
    return outcomes.select("doc_id", F.explode(rows).alias("f")).select("doc_id", "f.*")


def failure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failures with all their columns, written as JSON and read back."""
    folder = f"{Tables(spark).root}/failures"
    measure.write_failures(_evaluated(spark, sf_dir), folder)
    wrong = spark.read.schema("predicted_text string, predicted_type string, detector_source string, confidence double, location string, surrounding_context string").json(f"{folder}/false_positives")
    missing = spark.read.schema("ground_truth_text string, expected_type string, location string, surrounding_context string").json(f"{folder}/false_negatives")
    wrong = wrong.select(F.lit("false positive").alias("failure"), F.col("predicted_text").alias("text"), F.col("predicted_type").alias("entity_type"), "detector_source", "confidence", "location", "surrounding_context")
    return wrong.unionByName(missing.select(F.lit("false negative").alias("failure"), F.col("ground_truth_text").alias("text"), F.col("expected_type").alias("entity_type"), "location", "surrounding_context"), allowMissingColumns=True)


def gold_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected findings written as files of JSON arrays, read back as such, and scored."""
    folder = f"{Tables(spark).root}/gold"
    rows = _gold(corpus.derived(spark, sf_dir)).select(F.expr("doc_id div 20000").alias("part"), F.struct("doc_id", "text", "entities").alias("item"))
    arrays = rows.groupBy("part").agg(F.sort_array(F.collect_list("item")).alias("items"))  # some thousand lines
    arrays.select("part", F.to_json(F.transform("items", lambda x: F.struct(x["text"].alias("text"), x["entities"].alias("entities")))).alias("value")).write.partitionBy("part").text(folder)
    return measure.category_scores(measure.category_counts(measure.evaluated(pipeline.analyse(tables.ground_truth(spark, f"{folder}/*/*.txt")))))


def audit_report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit's survivors and changes, written as JSON and read back."""
    folder = f"{Tables(spark).root}/audit"
    _audited(spark, sf_dir).write(folder)
    kept = spark.read.schema("doc_id long, seq int, original_text string, type string, expected_replacement string, actual_text string, detector_source string, confidence double").json(f"{folder}/surviving")
    changes = spark.read.schema("doc_id long, seq int, expected string, actual string").json(f"{folder}/changes")
    one = kept.select(F.lit("surviving").alias("part"), "doc_id", "seq", F.col("original_text").alias("one"), F.col("actual_text").alias("other"), F.col("detector_source").alias("detector"))
    return one.unionByName(changes.select(F.lit("change").alias("part"), "doc_id", "seq", F.col("expected").alias("one"), F.col("actual").alias("other")), allowMissingColumns=True)


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived lines, redacted, as a table: both sides of an audit are made of them."""
    done = pipeline.redact(corpus.derived(spark, sf_dir)).select("doc_id", "seq", "text", "resolved", "replaced", "redacted_text")
    return Tables(spark).put(done, "redacted")


def _audited(spark: SparkSession, sf_dir: str) -> auditing.Report:
    """The derived lines, of which a third was left as it was, and another third has got something added."""
    expected = _expected(spark, sf_dir)
    third = F.expr("doc_id div 100 % 3")
    added = F.when(F.size("resolved") > 0, F.concat("redacted_text", F.lit(" etc."))).otherwise(F.col("redacted_text"))
    actual = expected.select("doc_id", "seq", F.when(third == 0, F.col("text")).when(third == 1, F.col("redacted_text")).otherwise(added).alias("actual_text"))
    return auditing.audit(expected, actual)


def audit_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir).totals


def audit_shared_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of a customer under one place; one in seven redacted lines has lost its beginning, one in eleven is gone. What has no partner is left out."""
    here = lambda df: df.withColumns({"doc_id": F.expr("doc_id div 100"), "seq": F.lit(0)})
    expected = _expected(spark, sf_dir)
    actual = expected.where("doc_id % 11 <> 0").select("doc_id", "seq", F.expr("CASE WHEN doc_id % 7 = 0 THEN substr(redacted_text, 2) ELSE redacted_text END").alias("actual_text"))
    pairs = auditing.compared(here(expected), here(actual), "left out")
    return pairs.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.size("replaced")).alias("total"), F.sum((F.size("surviving") + F.size("changes") > 0).cast("int")).alias("different"))


def audit_surviving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir).surviving.select("doc_id", "original_text", F.col("type").alias("entity_type"), "expected_replacement", "actual_text")


def audit_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir).changes.select("doc_id", "expected", "actual")


def audit_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir).by_category


def memo_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name that only a table cell gives away is found in the document's later paragraphs, two of which share a place, but not in the earlier one."""
    name = F.concat(F.lit("Asha Rao"), F.chr(F.lit(97) + F.col("c_custkey") % 26))
    customers = tables.spread(_load(spark, sf_dir, "customer")).select(F.col("c_custkey").alias("doc_id"), name.alias("name"))
    paragraph = lambda seq, text, header="": F.struct(F.lit(seq).alias("seq"), text.alias("text"), F.lit(header).alias("header_text"))
    said = lambda before, after: F.concat(F.lit(before), "name", F.lit(after))
    made = F.array(paragraph(-1, said("Later ", " came")), paragraph(0, F.col("name"), "Full Name"), paragraph(1, said("X", "")), paragraph(2, said("Later ", " came")), paragraph(2, said("Then ", " and Asha Rao")))
    paragraphs = customers.select("doc_id", F.explode(made).alias("p")).select("doc_id", "p.*")
    whole = lambda text: F.when(text.rlike("^Asha Rao.$"), F.array(T.entity(text, "PERSON", F.lit(0), F.length(text), V.NAME_MODEL, "cell"))).otherwise(T.no_entities())
    done = pipeline.entities(pipeline.analyse(paragraphs, pipeline.Config(detectors=(whole, "context"))))
    return done.select("doc_id", "seq", "text", F.col("start").alias("start_at"), "detector")


def _tagger(spark: SparkSession, sf_dir: str) -> tuple[tagger.NameTagger, DataFrame]:
    """A tagger learnt from the derived lines that aren't held out, and those that are."""
    rows = corpus.named(spark, sf_dir)
    return tagger.train(rows.where("NOT held_out")), rows.where("held_out")


def tagger_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tagger's names against the expected ones of held-out lines, by their exact texts."""
    model, rows = _tagger(spark, sf_dir)
    kind = lambda e: F.when(e["entity_type"] == "COMPANY_CANDIDATE", "COMPANY").when(e["entity_type"] == "ADDRESS_CANDIDATE", "PHYSICAL_OR_MAILING_ADDRESS").otherwise(e["entity_type"])
    found = F.transform(names.entities(F.col("text"), model), lambda e: T.entity(e["text"], kind(e), e["start"], e["end"], e["confidence"], e["detector"], e["ord"]))
    return measure.category_scores(measure.category_counts(measure.evaluated(rows.withColumn("resolved", T.once(found)), "exact"), tuple(tagger.LABELS)))


def redact_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan with the tagger as its source of names, and with the memo, over the held-out lines as documents of ten customers."""
    model, rows = _tagger(spark, sf_dir)
    rows = rows.withColumns({"doc_id": F.expr("doc_id div 50"), "seq": F.expr("cast(doc_id % 50 * 12 + seq AS int)")})
    done = pipeline.entities(pipeline.redact(rows, pipeline.Config(name_provider=model)), "replaced")
    return done.select("doc_id", "seq", "text", F.col("entity_type").alias("kind"), "confidence", "detector", "replacement")


def dictionary_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed names, as many as there are customers and more, in a line for each order."""
    listed = spark.sql(corpus.dictionary_sql("{customer}"), customer=_load(spark, sf_dir, "customer"))
    lines = spark.sql(corpus.mentions_sql("{orders}"), orders=tables.spread(_load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")))
    found = names.listed(lines, listed, "doc_id")
    return found.select("doc_id", F.explode("e").alias("e")).select("doc_id", "e.text", "e.entity_type", F.col("e.start").alias("start_at"), F.col("e.end").alias("end_at"))


def conversation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns, and the findings in them."""
    done = pipeline.analyse(tables.turns(_load(spark, sf_dir, "conversations")))
    return measure.stats(done).select(F.col("doc_id").alias("conv_id"), F.col("processed_paragraphs").alias("turns"), "total_candidates", "entities_replaced")


def page_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the whole plan finds in the lines of web pages."""
    return pipeline.entities(pipeline.analyse(tables.page_lines(_load(spark, sf_dir, "pages")))).select("doc_id", "seq", "text", "entity_type", "confidence", "detector")


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "detect_email": _detection(detect.emails),
        "detect_phone": _detection(detect.phones),
        "detect_ip_address": _detection(detect.ip_addresses),
        "detect_date": _detection(detect.dates),
        "detect_credit_card": _detection(detect.credit_cards),
        "detect_credit_card_derived": _detection(detect.credit_cards, corpus.derived),
        "detect_ssn": _detection(detect.social_security_numbers, corpus.derived),
        "detect_aadhaar": _detection(detect.aadhaar_numbers, corpus.derived),
        "detect_din": _detection(detect.director_numbers, corpus.derived),
        "refine_birth_date": _refinement("DATE_OF_BIRTH", detect.dates),
        "refine_phone": _refinement("PHONE", detect.phones),
        "refine_aadhaar": _refinement("AADHAAR", detect.aadhaar_numbers),
        "context_address": _generation(context.addresses),
        "context_person_list": _generation(context.people),
        "context_organisation": _generation(context.organisations),
        "context_company_suffix": _generation(context.companies),
    }
    plain = (
        refine_header_context, resolve_overlaps, pseudonym_seed, pseudonymize, redact_documents, redact_derived, redact_patterns, stream_redact, entity_counts_by_type, entity_rollup_lang, pipeline_stats, pipeline_stats_all,
        clean_documents, top_documents, tabular_redaction, evaluate_categories, evaluate_overall, evaluation_failures, audit_coverage, audit_shared_places, audit_surviving, audit_changes, audit_categories, memo_propagation, conversation_stats, page_entities, sql_redact, tagger_scores, redact_names, dictionary_names,
        stream_event_windows, stream_event_sessions, resolve_detectors, redact_runs, span_overlaps, failure_report, gold_files, audit_report_files, pipeline_stats_places,
        sql_analyze, sql_redact_kinds, distinct_findings, packaged_documents,
    )
    return found | {f.__name__: f for f in plain}

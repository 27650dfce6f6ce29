"""The registered queries: one per operator or plan, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.inputs import (
    conversation_lines,
    customer_notes,
    documents,
    mastodon_lines,
    notes,
    order_cells,
    padded_notes,
    reddit_lines,
    scan,
    table,
)
from textrisk.functions import identity, isotime, scoring, text
from textrisk.functions.numeric import NUMERIC_FEATURES
from textrisk.functions.patterns import RULES
from textrisk.operators import metrics, normalize, tfidf
from textrisk.operators.features import with_numeric_features, with_tokens
from textrisk.operators.findings import candidates, explode_spans, with_counts, with_rule_columns, with_spans
from textrisk.operators.prefix import first_rows, with_position
from textrisk.plans.analyze import analyze, assess, with_combined_score
from textrisk.plans.ingest import IngestReport, ingest
from textrisk.plans.audit import audit_rows, read_audit, run_audit, write_audit
from textrisk.plans.model import RiskModel, TermVectors, Weights
from textrisk.plans.train import TrainResult, evaluate, prepare, time_split, train
from textrisk.schema import RAW_FIELDS
from textrisk.sources.raw import parse_json_lines, parse_labelled_dump, read_raw
from textrisk.sources.records import export_jsonl, export_sample_jsonl, read_records, write_records
from textrisk.storage import materialize, new_path

Query = Callable[[SparkSession, str], DataFrame]

# Weights of the model that predictions are checked with.
FIXED_NUMERIC = (0.0001, 0.0002, 0.01, 0.5, 0.25, 0.3, 0.2, -0.1)
FIXED_INTERCEPT = -0.75
FIXED_COEF = "((length(term) * 7 + df) % 11 - 5) / 10.0D"
HEAD_ROWS = 1000
SAMPLE_ROWS = 150


def _plain(analyzed: DataFrame) -> DataFrame:
    """Rule columns with lists and maps written as text."""
    counts = F.transform(
        F.map_entries("counts_by_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return analyzed.select(
        "record_id",
        F.size("spans").alias("n_spans"),
        "rule_score",
        "y_risk",
        F.array_join("pii_types", "|").alias("pii_types"),
        F.array_join(counts, ",").alias("counts_by_type"),
        "explanation",
        "redacted_text",
    )


def rule_analysis_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(analyze(documents(spark, sf)))


def rule_analysis_notes(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(analyze(notes(spark, sf)))


def rule_analysis_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Longer texts with many findings each."""
    return _plain(analyze(customer_notes(spark, sf)))


def _renamed(found: DataFrame) -> DataFrame:
    return found.withColumnsRenamed({"start": "span_start", "end": "span_end", "match": "matched"})


def findings_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _renamed(explode_spans(with_spans(documents(spark, sf))))


def findings_notes(spark: SparkSession, sf: str) -> DataFrame:
    return _renamed(explode_spans(with_spans(notes(spark, sf))))


def _matches(rule) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        texts = notes(spark, sf).withColumn("origin", F.lit("notes")).unionByName(
            documents(spark, sf).select("record_id", "text", F.lit("documents").alias("origin"))
        )
        return _renamed(candidates(texts, keep=("origin", "record_id"), rules=[rule])).drop("type")

    return query


def redaction_notes(spark: SparkSession, sf: str) -> DataFrame:
    return with_rule_columns(with_spans(notes(spark, sf))).select("record_id", "redacted_text")


def type_counts_notes(spark: SparkSession, sf: str) -> DataFrame:
    counts = scoring.counts_by_type(F.col("spans"))
    return with_spans(notes(spark, sf)).select("record_id", F.explode(counts).alias("type", "n_found"))


def explanations_notes(spark: SparkSession, sf: str) -> DataFrame:
    return with_counts(notes(spark, sf)).select("record_id", scoring.explanation(F.col("counts_by_type")).alias("explanation"))


def weak_labels_documents(spark: SparkSession, sf: str) -> DataFrame:
    counts = F.col("counts_by_type")
    return with_counts(documents(spark, sf)).select(
        "record_id",
        F.array_join(scoring.pii_types(counts), "|").alias("pii_types"),
        scoring.rule_score(counts).alias("rule_score"),
        scoring.weak_label(counts).alias("y_risk"),
    )


def numeric_features_documents(spark: SparkSession, sf: str) -> DataFrame:
    return with_numeric_features(with_spans(documents(spark, sf))).select("record_id", *NUMERIC_FEATURES)


def numeric_features_notes(spark: SparkSession, sf: str) -> DataFrame:
    return with_numeric_features(with_spans(notes(spark, sf))).select("record_id", *NUMERIC_FEATURES)


def _reddit(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.reddit(parse_json_lines(reddit_lines(spark, sf), RAW_FIELDS["reddit"]))


def _mastodon(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.mastodon(parse_json_lines(mastodon_lines(spark, sf), RAW_FIELDS["mastodon"]))


def reddit_records(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.accepted(_reddit(spark, sf))


def reddit_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.rejected(_reddit(spark, sf)).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n_rows"))


def reddit_counters(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.ingest_counters(_reddit(spark, sf))


def _ingested(spark: SparkSession, sf: str) -> tuple[str, str, IngestReport]:
    """The orders as a reddit dump file in the shared folder, ingested in one pass."""
    dump, output, rejects = (new_path(spark, name) for name in ("reddit-dump", "reddit-records", "reddit-rejects"))
    reddit_lines(spark, sf).write.text(dump)
    report = ingest(spark, dump, "reddit", output, rejects=rejects, format="jsonl")
    return output, rejects, report


def ingest_records_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Records that ``ingest`` wrote, read back from their partitioned files."""
    output, _, _ = _ingested(spark, sf)
    return read_records(spark, output)


def ingest_counters_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The counters that ``ingest`` reports, next to the rejects it wrote."""
    _, rejects, report = _ingested(spark, sf)
    written = spark.read.parquet(rejects).count()
    assert written == report.total_skipped, (written, report)
    row = (report.total_read, report.total_written, report.total_skipped)
    return spark.createDataFrame([row], "total_read long, total_written long, total_skipped long")


def reddit_threads(spark: SparkSession, sf: str) -> DataFrame:
    raw = parse_json_lines(conversation_lines(spark, sf), RAW_FIELDS["reddit"])
    return normalize.accepted(normalize.reddit(raw)).drop("community")


def mastodon_records(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.accepted(_mastodon(spark, sf))


def mastodon_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.rejected(_mastodon(spark, sf)).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n_rows"))


def mastodon_counters(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.ingest_counters(_mastodon(spark, sf))


def iso_times_events(spark: SparkSession, sf: str) -> DataFrame:
    """Event times written in several ISO shapes, read back to UTC."""
    local = "CAST(ts AS timestamp_ntz)"
    micros = f"date_format({local}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"
    shape = f"""
    CASE event_id % 9
      WHEN 0 THEN {micros} || 'Z'
      WHEN 1 THEN date_format({local} + INTERVAL 2 HOURS, "yyyy-MM-dd HH:mm:ss.SSSSSS") || '+02:00'
      WHEN 2 THEN date_format({local} - INTERVAL '5:30' HOUR TO MINUTE, "yyyy-MM-dd'T'HH:mm:ss,SSSSSS") || '-0530'
      WHEN 3 THEN {micros}
      WHEN 4 THEN date_format({local}, "yyyyMMdd'T'HHmmss.SSSSSS") || 'Z'
      WHEN 5 THEN {micros} || '999Z'
      WHEN 6 THEN date_format({local}, 'yyyy-MM-dd')
      WHEN 7 THEN date_format({local}, "yyyy-MM-dd'T'HH:mm") || 'Z'
      ELSE date_format({local}, 'yyyy-MM')
    END"""
    return table(spark, sf, "events").select("event_id", isotime.to_iso_utc(F.expr(shape)).alias("created_at"))


def epoch_times_events(spark: SparkSession, sf: str) -> DataFrame:
    """Event times as text of epoch seconds with and without a fraction."""
    shape = """
    CASE event_id % 4
      WHEN 0 THEN cast(unix_micros(cast(ts AS timestamp)) div 1000000 AS string)
      WHEN 1 THEN cast(unix_micros(cast(ts AS timestamp)) div 1000000 AS string) || '.5'
      WHEN 2 THEN cast(cast(unix_micros(cast(ts AS timestamp)) AS decimal(26,6)) / 1000000 AS string)
      ELSE event_type
    END"""
    return table(spark, sf, "events").select("event_id", isotime.epoch_to_iso(F.expr(shape)).alias("created_at"))


def author_hashes_customers(spark: SparkSession, sf: str) -> DataFrame:
    name = F.expr("CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE c_name END")
    return table(spark, sf, "customer").select("c_custkey", identity.author_hash(name).alias("author_id_hash"))


def url_authorities_pages(spark: SparkSession, sf: str) -> DataFrame:
    url = F.expr(
        "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '://me:pw@') "
        "WHEN 2 THEN substr(url, instr(url, '/')) ELSE replace(url, '/', '\\\\') END"
    )
    return table(spark, sf, "pages").select("page_id", identity.url_authority(url).alias("community"))


def clean_text_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", text.clean_html(F.col("html")).alias("text"))


def labelled_dump_documents(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    lines = joined.select(
        F.to_json(
            F.struct(
                F.col("doc_id").alias("id"),
                F.expr("CASE WHEN doc_id % 9 > 0 THEN text END").alias("text"),
                F.col("toxic").alias("binary label"),
                F.col("quality").alias("multi-class label"),
                F.col("lang").alias("multi-label label"),
            )
        ).alias("value")
    )
    return normalize.from_labelled_dump(parse_labelled_dump(lines))


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    return with_tokens(documents(spark, sf)).select("record_id", "tokens")


def _vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    n_docs = table(spark, sf, "documents").count()
    return materialize(tfidf.vocabulary(tfidf.document_frequency(_tokens(spark, sf)), n_docs), "vocabulary")


def term_counts_documents(spark: SparkSession, sf: str) -> DataFrame:
    return tfidf.term_counts(_tokens(spark, sf))


def document_frequency_documents(spark: SparkSession, sf: str) -> DataFrame:
    return tfidf.document_frequency(_tokens(spark, sf))


def vocabulary_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _vocabulary(spark, sf).withColumn("idf", F.round("idf", 6))


def tfidf_documents(spark: SparkSession, sf: str) -> DataFrame:
    terms = _vocabulary(spark, sf)
    vectors = TermVectors(terms, terms.count(), "tokens", "weights")
    weighed = vectors.weights(_tokens(spark, sf))
    return weighed.select("record_id", "term", F.round("weight", 6).alias("weight"))


def tfidf_joined_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The same through the join that large vocabularies take."""
    weighed = tfidf.weigh(tfidf.term_counts(_tokens(spark, sf)), _vocabulary(spark, sf), broadcast_terms=0)
    return weighed.select("record_id", "term", F.round("weight", 6).alias("weight"))


def time_split_documents(spark: SparkSession, sf: str) -> DataFrame:
    older, newer, _, _ = time_split(documents(spark, sf).select("record_id", "created_at"))
    return older.withColumn("part", F.lit("train")).unionByName(newer.withColumn("part", F.lit("test")))


def time_split_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Many orders share a date, so the cut falls inside a group of equal times."""
    stamped = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("record_id"),
        F.date_format("o_orderdate", "yyyy-MM").alias("created_at"),
    )
    older, newer, _, _ = time_split(stamped)
    return older.withColumn("part", F.lit("train")).unionByName(newer.withColumn("part", F.lit("test")))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    """Rule label as prediction against the toxicity label."""
    ruled = with_counts(documents(spark, sf)).select("record_id", scoring.weak_label(F.col("counts_by_type")).alias("pred_risk"))
    truth = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("record_id"), F.col("toxic").alias("y_risk"))
    return ruled.join(truth, "record_id")


def confusion_labels(spark: SparkSession, sf: str) -> DataFrame:
    rated = metrics.with_rates(metrics.confusion(_judged(spark, sf)))
    return rated.select("tn", "fp", "fn", "tp", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def outcome_counts_labels(spark: SparkSession, sf: str) -> DataFrame:
    bucket = scoring.outcome(F.col("pred_risk"), F.col("y_risk"))
    return _judged(spark, sf).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n_rows"))


def class_weights_documents(spark: SparkSession, sf: str) -> DataFrame:
    labelled = with_counts(documents(spark, sf)).select(scoring.weak_label(F.col("counts_by_type")).alias("y_risk"))
    return metrics.class_weights(labelled).withColumn("class_weight", F.round("class_weight", 6))


def combined_scores_documents(spark: SparkSession, sf: str) -> DataFrame:
    scored = analyze(documents(spark, sf)).withColumn("p_risk", (F.col("record_id").cast("long") % 201) / 200)
    return with_combined_score(scored).select("record_id", "rule_score", "ml_score", "final_score", "interpretation")


def _audited(spark: SparkSession, sf: str) -> DataFrame:
    scored = analyze(documents(spark, sf)).withColumn("p_risk", (F.col("record_id").cast("long") % 101) / 100)
    return audit_rows(scored)


def audit_rows_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _audited(spark, sf)


def audit_csv_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Audit rows written as CSV and read back."""
    path = new_path(spark, "audit-csv")
    write_audit(_audited(spark, sf), path, format="csv")
    return read_audit(spark, path, format="csv")


def audit_csv_notes(spark: SparkSession, sf: str) -> DataFrame:
    """The same for texts with blanks and line breaks at their ends."""
    path = new_path(spark, "audit-csv")
    scored = analyze(padded_notes(spark, sf)).withColumn("p_risk", (F.col("record_id").cast("long") % 101) / 100)
    write_audit(audit_rows(scored), path, format="csv")
    return read_audit(spark, path, format="csv")


def audit_summary_documents(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.audit_summary(_audited(spark, sf)).withColumn("mean_p_risk", F.round("mean_p_risk", 6))


def _fixed_model(spark: SparkSession, sf: str, **options) -> RiskModel:
    n_docs = table(spark, sf, "documents").count()
    terms = materialize(_vocabulary(spark, sf).withColumn("coef", F.expr(FIXED_COEF)), "terms")
    weights = Weights(FIXED_NUMERIC, FIXED_INTERCEPT, n_docs, tfidf.min_df_for(n_docs))
    return RiskModel(weights, terms, **options)


def _predictions(assessed: DataFrame) -> DataFrame:
    return assessed.select(
        "record_id",
        F.round("p_risk", 6).alias("p_risk"),
        F.array_join("top_terms", " ").alias("top_terms"),
        "final_score",
        "interpretation",
    )


def fixed_model_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _predictions(assess(documents(spark, sf), _fixed_model(spark, sf)))


def fixed_model_joined_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The same through the join that large vocabularies take."""
    return _predictions(assess(documents(spark, sf), _fixed_model(spark, sf, local_terms=0)))


def records_roundtrip_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Records written in partitions and read back."""
    path = new_path(spark, "records")
    write_records(normalize.accepted(_reddit(spark, sf)), path)
    return read_records(spark, path)


def csv_records_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Turns written as CSV, with line breaks inside cells, and ingested."""
    path = new_path(spark, "dump-csv")
    raw = parse_json_lines(conversation_lines(spark, sf), RAW_FIELDS["reddit"])
    columns = [c for c in RAW_FIELDS["reddit"] if c not in ("title", "subreddit")]
    writer = raw.select(*columns).write.option("header", True).option("quoteAll", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return normalize.accepted(normalize.reddit(read_raw(spark, path, "reddit", format="csv")))


def csv_rejects_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a CSV dump with more cells than its header are counted, not cut."""
    path = new_path(spark, "dump-csv")
    order_cells(spark, sf).write.option("header", True).option("quote", "\0").csv(path)
    judged = normalize.reddit(read_raw(spark, path, "reddit", format="csv", multi_line=False))
    reason = F.coalesce("reject_reason", F.lit("none")).alias("reject_reason")
    return judged.groupBy(reason).agg(F.count(F.lit(1)).alias("n_rows"))


def jsonl_roundtrip_documents(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "export")
    export_jsonl(table(spark, sf, "documents"), path)
    return spark.read.schema("doc_id long, text string, lang string, source string, n_chars long").json(path)


def sample_export_documents(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "sample")
    export_sample_jsonl(scan(spark, sf, "documents").select("*", "_metadata"), path, SAMPLE_ROWS)
    return spark.read.schema("doc_id long, text string, lang string, source string, n_chars long").json(path)


def head_rows_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The row limit: first rows in file order."""
    orders = scan(spark, sf, "orders").select("o_orderkey", "o_custkey", "_metadata")
    return first_rows(with_position(orders).drop("_metadata"), HEAD_ROWS)


_trained: dict[tuple[str, str], tuple[RiskModel, TrainResult]] = {}


def _training(spark: SparkSession, sf: str) -> tuple[RiskModel, TrainResult]:
    """Model trained on the documents, once per session, as read back from its folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _trained:
        path = new_path(spark, "model")
        result = train(documents(spark, sf), model_path=path)
        _trained[key] = RiskModel.load(spark, path), result
    return _trained[key]


def _model(spark: SparkSession, sf: str) -> RiskModel:
    return _training(spark, sf)[0]


def trained_summary_documents(spark: SparkSession, sf: str) -> DataFrame:
    """What of a training does not depend on the optimizer: sizes, classes, vocabulary."""
    model, result = _training(spark, sf)
    _, newer, _, _ = time_split(documents(spark, sf))
    tested = prepare(newer).agg(F.count(F.lit(1)).alias("n_test"), F.sum("y_risk").alias("n_test_risk"))
    counted = sum(result.metrics[c] for c in ("tn", "fp", "fn", "tp"))
    return tested.select(
        F.lit(model.weights.n_docs).cast("long").alias("n_train"),
        "n_test",
        "n_test_risk",
        F.lit(model.n_terms).cast("long").alias("n_terms"),
        (F.lit(counted) == F.col("n_test")).alias("outcomes_add_up"),
        (F.lit(result.metrics["fn"] + result.metrics["tp"]) == F.col("n_test_risk")).alias("risks_add_up"),
    )


def trained_assessment_documents(spark: SparkSession, sf: str) -> DataFrame:
    assessed = assess(documents(spark, sf), _model(spark, sf))
    return assessed.select(
        "record_id", "rule_score", "p_risk", "ml_score", "final_score", "interpretation",
        F.array_join("top_terms", " ").alias("top_terms"), "redacted_text",
    )


def trained_audit_documents(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "audit")
    run_audit(documents(spark, sf), _model(spark, sf), path)
    return read_audit(spark, path)


def trained_metrics_documents(spark: SparkSession, sf: str) -> DataFrame:
    _, newer, _, _ = time_split(documents(spark, sf))
    counts = evaluate(prepare(newer), _model(spark, sf))
    return spark.createDataFrame([tuple(float(v) for v in counts.values())], ", ".join(f"{c} double" for c in counts))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        rule_analysis_documents,
        rule_analysis_notes,
        rule_analysis_customers,
        findings_documents,
        findings_notes,
        redaction_notes,
        type_counts_notes,
        explanations_notes,
        weak_labels_documents,
        numeric_features_documents,
        numeric_features_notes,
        reddit_records,
        reddit_rejects,
        ingest_records_orders,
        ingest_counters_orders,
        reddit_counters,
        reddit_threads,
        mastodon_records,
        mastodon_rejects,
        mastodon_counters,
        iso_times_events,
        epoch_times_events,
        author_hashes_customers,
        url_authorities_pages,
        clean_text_pages,
        labelled_dump_documents,
        term_counts_documents,
        document_frequency_documents,
        vocabulary_documents,
        tfidf_documents,
        tfidf_joined_documents,
        time_split_documents,
        time_split_orders,
        confusion_labels,
        outcome_counts_labels,
        class_weights_documents,
        combined_scores_documents,
        audit_rows_documents,
        audit_csv_documents,
        audit_csv_notes,
        audit_summary_documents,
        fixed_model_documents,
        fixed_model_joined_documents,
        records_roundtrip_orders,
        csv_records_conversations,
        csv_rejects_orders,
        jsonl_roundtrip_documents,
        sample_export_documents,
        head_rows_orders,
        trained_summary_documents,
        trained_assessment_documents,
        trained_audit_documents,
        trained_metrics_documents,
    )
}
QUERIES.update({f"matches_{rule.name.lower()}": _matches(rule) for rule in RULES})

"""The registered queries: each runs one operator, or one whole flow, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docrisk import dims, schemas
from docrisk.functions.banks import bank_display, canonical_bank
from docrisk.functions.files import document_type, repair_mime
from docrisk.functions.identifiers import bic_valid, clean_address, iban_valid, valid_address
from docrisk.functions.jsontext import parse_lenient
from docrisk.operators import chain, claims, frames, intake, invoice, report, responses, risk, statement, updates
from docrisk.plans import adapters as a
from docrisk.plans.screening import requests_from_files, screen_documents
from docrisk.session import configure, shared_folder
from docrisk.sources.documents import present_templates
from docrisk.sources.ledger import read_lines, read_records, take_in
from docrisk.sources.sinks import publish, read_published
from docrisk.sources.updates import read_update_lines
from docrisk.streaming.chat import read_chat, run_chat
from docrisk.streaming.dedup import dedup_updates

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    CATALOG[fn.__name__] = run
    return run


def _money(column: str):
    return F.col(column).cast("double").alias(column)


# --- risk engine ------------------------------------------------------------------------------


@query
def risk_categories(spark, sf_dir):
    scored = risk.category_risks(a.checked_orders(spark, sf_dir))
    return scored.select("k", *[F.col("categories")[c].alias(c) for c in dims.CATEGORY_WEIGHTS])


@query
def risk_overall(spark, sf_dir):
    """Engine score with the arithmetic bonus taken from the document's own invoice lines."""
    totals = invoice.amount_analysis(invoice.reconcile_invoice(a.invoice_lines(spark, sf_dir)))
    documents = a.checked_orders(spark, sf_dir).join(
        totals.select(F.col("doc_id").alias("k"), "amount"), "k", "left"
    )
    return risk.score_documents(documents).select("k", "overall_risk", "risk_label", "suspicious")


@query
def risk_long(spark, sf_dir):
    rows = a.checked_orders_long(spark, sf_dir)
    return risk.category_risks_long(rows, risk.weights_table(spark), key="k")


@query
def independent_signals(spark, sf_dir):
    return risk.independent_signals(a.checked_orders(spark, sf_dir)).select("k", "n_suspicious", "counts_as_signal")


@query
def check_statuses(spark, sf_dir):
    """Number of checks and of their total score per status, over the exploded check map."""
    long = responses.explode_checks(a.checked_orders(spark, sf_dir), ["k"])
    return long.groupBy("check", "status").agg(
        F.count("*").alias("n"), F.sum(F.col("score").cast("bigint")).alias("total")
    )


# --- screening ----------------------------------------------------------------------------------


@query
def screen_answers(spark, sf_dir):
    """The whole document flow: answer text to parsed response to result or error row."""
    results = screen_documents(a.answered_documents(spark, sf_dir), intake.template_names(spark))
    return results.select(
        "doc_id", "type", "success", "error", "bank", "reference", "overall_risk", "risk_label", "score", "suspicious",
        *[F.col("categories")[c].alias(c) for c in dims.CATEGORY_WEIGHTS],
        "confidence", F.array_join("evidence", "|").alias("evidence"),
        F.col("amount_analysis.totalAmount").alias("total"), F.col("amount_analysis.difference").alias("difference"),
        F.col("amount_analysis.calculationConsistent").alias("adds_up"),
    )


@query
def response_violations(spark, sf_dir):
    parsed = responses.parse_responses(a.contract_responses(spark, sf_dir), source="read")
    broken = responses.violations(parsed, "receipt", ["k"], source="read")
    return broken.groupBy("rule").agg(F.count("*").alias("n"))


@query
def contract_findings(spark, sf_dir):
    """What is wrong with each response, by the contract of receipts and by that of statements."""
    found = []
    for contract, answers in (("receipt", a.contract_responses(spark, sf_dir)), ("statement", a.statement_responses(spark, sf_dir))):
        rules = responses.violations(responses.parse_responses(answers, source="read"), contract, ["k"], source="read")
        found.append(rules.select(F.lit(contract).alias("contract"), "k", "rule"))
    return found[0].unionByName(found[1])


@query
def lenient_json(spark, sf_dir):
    """Event properties wrapped in fences or prose, or broken, read back."""
    kind = F.col("event_id") % 8
    p = F.col("props")
    wrapped = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), p, F.lit("\n```")))
        .when(kind == 1, F.concat(F.lit("Sonuç: "), p, F.lit(" bitti")))
        .when(kind == 2, F.concat(p, F.lit(" ve "), p))
        .when(kind == 3, F.concat(F.lit("```"), p, F.lit("```")))
        .when(kind == 4, F.concat(F.lit("["), p, F.lit("]")))
        .when(kind == 5, F.lit("7"))
        .when(kind == 6, F.concat(p, F.lit("]")))
        .otherwise(p)
    )
    events = a.table(spark, sf_dir, "events").select("event_id", wrapped.alias("text"))
    parsed = parse_lenient(events, "text", "response", objects_only=True)
    return parsed.select(
        "event_id",
        F.col("response").isNotNull().alias("ok"),
        F.try_variant_get("response", "$.k", "bigint").alias("k"),
    )


# --- invoices ------------------------------------------------------------------------------------


@query
def invoice_reconcile(spark, sf_dir):
    r = invoice.reconcile_invoice(a.invoice_lines(spark, sf_dir))
    return r.select(F.col("doc_id").alias("k"), _money("calculated"), _money("shown"), _money("difference"), "consistent")


@query
def amount_formats(spark, sf_dir):
    mixed = invoice.amount_format_mix(a.amount_texts(spark, sf_dir))
    return mixed.select(F.col("doc_id").alias("k"), "n_styles", "mixed")


# --- statements ------------------------------------------------------------------------------------


@query
def statement_totals(spark, sf_dir):
    totals = statement.statement_totals(a.dated_rows(spark, sf_dir), a.statement_header(spark, sf_dir))
    return totals.select(
        "stmt_id", _money("total_in"), _money("total_out"), _money("calculated_closing"), "n",
        "closing_matches", "in_matches", "out_matches",
    )


@query
def statement_running_balance(spark, sf_dir):
    balance = statement.running_balance(
        a.statement_rows(spark, sf_dir), a.statement_openings(spark, sf_dir)
    )
    return balance.select("stmt_id", "seq", _money("expected"), _money("shown"), "is_break")


@query
def statement_balance_breaks(spark, sf_dir):
    breaks = statement.balance_breaks(a.statement_rows(spark, sf_dir))
    return breaks.select("stmt_id", "seq", _money("expected"), _money("shown"), "is_break")


@query
def statement_page_breaks(spark, sf_dir):
    return statement.page_breaks(a.statement_pages(spark, sf_dir))


@query
def statement_duplicates(spark, sf_dir):
    rows = statement.duplicate_transactions(a.repeated_rows(spark, sf_dir))
    return rows.select(
        "stmt_id", "tx_date", _money("amount_in"), _money("amount_out"), "description", "counterparty", "n"
    )


@query
def statement_dates(spark, sf_dir):
    return statement.date_findings(
        a.dated_rows(spark, sf_dir), a.statement_header(spark, sf_dir)
    )


@query
def page_conflicts(spark, sf_dir):
    return statement.page_conflicts(a.described_pages(spark, sf_dir))


# --- frames --------------------------------------------------------------------------------------------


@query
def frame_sample(spark, sf_dir):
    return frames.sample_frames(a.video_frames(spark, sf_dir)).select("doc_id", "frame", "ts", "rank")


@query
def frame_conflicts(spark, sf_dir):
    return frames.frame_conflicts(a.frame_readings(spark, sf_dir))


# --- chain -----------------------------------------------------------------------------------------------


@query
def address_valid(spark, sf_dir):
    return a.requested_addresses(spark, sf_dir).select("k", valid_address(F.col("address")).alias("valid"))


@query
def address_class(spark, sf_dir):
    requested = a.requested_addresses(spark, sf_dir).select("k", clean_address(F.col("address")).alias("address"))
    classified = chain.classify_addresses(requested, a.token_records(spark, sf_dir))
    return classified.select("k", "address_type", F.col("token.name").alias("token_name"))


@query
def token_risk(spark, sf_dir):
    tokens = a.table(spark, sf_dir, "part").select("p_partkey")
    security = a.security_records(spark, sf_dir).select("p_partkey", F.col("v").alias("security"))
    scored = chain.token_risk(tokens.join(security, "p_partkey", "left"))
    return scored.select(
        F.col("p_partkey").alias("k"), "score", "label",
        F.array_join("codes", ",").alias("codes"), F.array_join("warnings", "|").alias("warnings"),
    )


@query
def wallet_risk(spark, sf_dir):
    accounts = a.account_records(spark, sf_dir).select(F.col("c_custkey").alias("k"), F.col("v").alias("account"))
    counts = a.transfer_records(spark, sf_dir).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n_transfers"))
    scored = chain.wallet_risk(accounts.join(counts, "k", "left"), as_of=F.expr(a.AS_OF))
    return scored.select(
        "k", "score", "label", F.array_join("codes", ",").alias("codes"),
        F.array_join("warnings", "|").alias("warnings"),
    )


@query
def recent_transfers(spark, sf_dir):
    resolved = chain.transfer_fields(a.transfer_records(spark, sf_dir))
    return chain.recent_transfers(resolved).select(
        "address", "transactionHash", "from", "to", "token", "amount", "timestamp", "rank"
    )


@query
def token_projection(spark, sf_dir):
    tokens = a.token_records(spark, sf_dir).withColumn("token", chain.first_token(F.col("trc20_tokens")))
    security = a.security_records(spark, sf_dir).select("p_partkey", F.col("v").alias("security"))
    found = tokens.filter(F.col("token").isNotNull()).join(security, "p_partkey", "left")
    fields = chain.token_fields(F.col("token"), F.col("address"))
    out = found.select(
        F.col("p_partkey").alias("k"), fields.alias("t"), chain.security_fields(F.col("security")).alias("s")
    )
    return out.select("k", "t.*", F.col("s.vip"), F.col("s.tokenLevel"), F.col("s.openSource"), F.col("s.hasUrl"))


@query
def security_projection(spark, sf_dir):
    """All nine fields that are shown of a security record."""
    records = a.whole_security_records(spark, sf_dir)
    return records.select(F.col("p_partkey").alias("k"), chain.security_fields(F.col("v")).alias("s")).select("k", "s.*")


@query
def transfer_lists(spark, sf_dir):
    """Transfers of fetched responses, from whichever list there is."""
    listed = chain.transfer_fields(chain.transfer_list(a.fetched_transfers(spark, sf_dir)))
    return listed.select("address", "transactionHash", "amount")


@query
def wallet_projection(spark, sf_dir):
    accounts = a.account_records(spark, sf_dir)
    return accounts.select(F.col("c_custkey").alias("k"), chain.wallet_fields(F.col("v")).alias("w")).select("k", "w.*")


@query
def address_scores(spark, sf_dir):
    """The whole chain flow: requested addresses to token, wallet and error rows."""
    results = chain.score_addresses(
        a.requested_addresses(spark, sf_dir), a.token_records(spark, sf_dir), a.security_records(spark, sf_dir),
        a.account_records(spark, sf_dir), a.transfer_records(spark, sf_dir), as_of=F.expr(a.AS_OF),
    )
    return results.select(
        "address", "success", "error", "address_type", "score", "label", F.array_join("codes", ",").alias("codes"),
        "n_transfers", F.size("recent_transfers").alias("n_listed"),
    )


# --- banks and files ---------------------------------------------------------------------------------------


@query
def bank_canonical(spark, sf_dir):
    bank, fixed = canonical_bank(F.col("name")), canonical_bank(F.col("name"), "fixed")
    return a.bank_spellings(spark, sf_dir).select(
        "k", bank.alias("bank"), bank_display(bank).alias("display"), fixed.alias("bank_fixed")
    )


@query
def template_match(spark, sf_dir):
    documents = a.bank_spellings(spark, sf_dir).select("k", "type", canonical_bank(F.col("name")).alias("bank"))
    return intake.attach_template(documents, intake.template_names(spark)).select("k", "type", "bank", "reference")


@query
def template_presence(spark, sf_dir):
    """Templates of a folder in which one bank's file is missing and another's is empty."""
    folder = a.template_folder(spark, f"{shared_folder(spark)}/docrisk-{uuid.uuid4().hex}")
    documents = a.bank_spellings(spark, sf_dir).select("k", "type", canonical_bank(F.col("name")).alias("bank"))
    return intake.attach_template(documents, present_templates(spark, folder)).select("k", "type", "bank", "reference")


@query
def model_requests(spark, sf_dir):
    """What the model is asked: documents of eight pages as files, form fields as the manifest, templates by presence.

    The parts come out as their kinds and names and a digest of their data.
    """
    folder = f"{shared_folder(spark)}/docrisk-{uuid.uuid4().hex}"
    files, templates = a.bundle_files(spark, sf_dir, f"{folder}/files"), a.template_folder(spark, f"{folder}/templates")
    asked = requests_from_files(intake.resolve_manifest(a.filed_uploads(spark, sf_dir, files)), spark, files, templates)

    def joined(field: str):
        return F.array_join(F.transform("parts", lambda p: F.coalesce(p[field], F.lit("-"))), "|")

    return asked.select(
        "doc_id", "type", "bank", "reference", "prompt", "error", F.size("parts").alias("n_parts"),
        joined("kind").alias("kinds"), joined("filename").alias("names"), F.sha2(joined("data"), 256).alias("data_sha256"),
    )


@query
def document_types(spark, sf_dir):
    return a.table(spark, sf_dir, "pages").select(
        "page_id", document_type(F.expr(a.FILE_MIME), F.expr(a.FILE_NAME)).alias("type")
    )


@query
def mime_repair(spark, sf_dir):
    """Manifest fields resolved from raw form submissions."""
    return intake.resolve_manifest(a.uploads(spark, sf_dir)).select(
        "doc_id", "type", "file_name", "bank", "mime", "error"
    )


# --- claims ---------------------------------------------------------------------------------------------------


def _claims(mode: str) -> Query:
    def run(spark, sf_dir):
        found = claims.extract_claims(a.captions(spark, sf_dir), "text", mode)
        return found.select("k", *[F.col("claim")[f].alias(f) for f in dims.CLAIM_FIELDS])

    return run


@query
def claim_fields(spark, sf_dir):
    return _claims("compat")(spark, sf_dir)


@query
def claim_ibans_fixed(spark, sf_dir):
    """IBANs read in full, where the compatible mode loses their last digits."""
    return _claims("fixed")(spark, sf_dir).select("k", "iban")


@query
def claim_compare(spark, sf_dir):
    compared = claims.reconcile_claims(a.claimed(spark, sf_dir), a.read_fields(spark, sf_dir), key="k")
    summary = claims.comparison_summary(compared)
    return summary.select(
        "k", "state", "n_mismatch", "n_unknown", F.array_join("mismatch_fields", ",").alias("fields"),
        claims.has_claim(F.col("claim")).alias("has_claim"),
    )


@query
def iban_bic(spark, sf_dir):
    return a.ibans(spark, sf_dir).select(
        "k", iban_valid(F.col("iban")).alias("iban_ok"), bic_valid(F.col("bic")).alias("bic_ok")
    )


@query
def digit_repeats(spark, sf_dir):
    return claims.repeated_digits(a.table(spark, sf_dir, "documents"))


@query
def digit_states(spark, sf_dir):
    return a.table(spark, sf_dir, "documents").select("doc_id", claims.digit_state(F.col("text")).alias("state"))


# --- updates and reports ------------------------------------------------------------------------------------------


@query
def update_route(spark, sf_dir):
    routed = updates.route_updates(a.chat_updates(spark, sf_dir))
    return routed.select(
        "update_id", "route", "chat_id", "bank",
        F.col("file.file_id").alias("file_id"), F.col("file.type").alias("file_type"), "text",
    )


@query
def update_requests(spark, sf_dir):
    """Screening requests that the updates of the chat lead to."""
    requests = updates.screening_requests(updates.route_updates(a.chat_updates(spark, sf_dir)))
    return requests.select("doc_id", "type", "file_name", "mime", "bank", "statement_mode", "reply_to")


@query
def update_outbox(spark, sf_dir):
    """Messages sent back at once."""
    return updates.outgoing_messages(updates.route_updates(a.chat_updates(spark, sf_dir)))


@query
def update_dedup_batch(spark, sf_dir):
    delivered = a.replayed_events(a.table(spark, sf_dir, "events"))
    return updates.first_updates(delivered).select("update_id", "copy", "n_copies")


@query
def update_dedup_stream(spark, sf_dir):
    """The same deliveries as a stream, deduplicated as they arrive, all within the horizon.

    The stream writes to the shared folder, from where the result is read.
    """
    folder = f"{shared_folder(spark)}/docrisk-{uuid.uuid4().hex}"
    schema = a.table(spark, sf_dir, "events").schema
    # a pattern, since a stream's path cannot name a single file; a directory's files come one a batch
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parque[t]")
    kept = dedup_updates(a.replayed_events(source)).select("update_id")
    stream = (
        kept.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    return spark.read.schema("update_id bigint").parquet(f"{folder}/out")


def _without_files(routed: DataFrame) -> DataFrame:
    """A step of the chat: files that are not there are errors; at some updates it raises."""
    wanted = F.col("route").isin("receipt", "statement")
    missing = F.when(wanted & F.expr(a.NO_FILE.format(u="update_id")), F.concat(F.lit("Dosya yok: "), F.col("file.file_id")))
    raising = F.raise_error(F.concat(F.lit("Belge okunamadı: "), F.col("update_id").cast("string"))).cast("bigint")
    return routed.withColumns({"error": missing, "chat_id": F.when(F.expr(a.RAISING.format(u="update_id")), raising).otherwise(F.col("chat_id"))})


@query
def chat_flow(spark, sf_dir):
    """The whole chat: updates as lines in three batches, the stream started anew for each, under a given clock.

    Requests, messages, repeats and the ledger, as they were committed to the shared folder.
    """
    folder = f"{shared_folder(spark)}/docrisk-{uuid.uuid4().hex}"
    lines = a.chat_lines(spark, sf_dir)
    for batch, minute in enumerate(a.MINUTES):
        lines.where(F.col("batch") == batch).select("line").write.mode("append").text(f"{folder}/updates")
        clock = F.lit(f"2024-01-01 00:{minute:02d}:00").cast("timestamp")
        updates_ = read_update_lines(spark, f"{folder}/updates", stream=True)
        run_chat(updates_, f"{folder}/chat", f"{folder}/checkpoint", step=_without_files, exact=True, clock=clock).awaitTermination()
    tables = read_chat(spark, f"{folder}/chat")
    none = F.lit(None).cast("string")

    def rows(name: str, kind: str, **columns) -> DataFrame:
        wanted = {c: none for c in ("type", "file_name", "bank", "provided_info", "text", "error", "record")}
        wanted |= {c: F.lit(None).cast("bigint") for c in ("update_id", "chat_id", "reply_to")} | columns
        return tables[name].select(F.lit(kind).alias("kind"), "batch", *[v.alias(c) for c, v in wanted.items()])

    def given(*names: str) -> dict:
        return {n: F.col(n) for n in names}

    unread = F.col("error") == dims.UNREADABLE
    # claims of captions; other texts are prose
    claimed = F.when(F.col("claim.rawText") == a.CAPTION_TEXT, F.col("provided_info"))
    return (
        rows("requests", "request", **given("update_id", "chat_id", "reply_to", "type", "file_name", "bank"), provided_info=claimed)
        .unionByName(rows("outbox", "message", **given("update_id", "chat_id", "text"), reply_to=F.col("reply_to_message_id")))
        .unionByName(rows("duplicates", "duplicate", **given("update_id")))
        .unionByName(rows("rejects", "reject", **given("error"), record=F.when(unread, F.col("record"))))
    )


@query
def reject_ledger(spark, sf_dir):
    """What could not be read of four sources, line by line, with how many lines were read and accepted."""
    folder = f"{shared_folder(spark)}/docrisk-{uuid.uuid4().hex}"
    readers = {
        "updates": lambda path: read_update_lines(spark, path),
        "responses": lambda path: read_lines(spark, schemas.MODEL_RESPONSES, path),
        "security": lambda path: read_records(spark, path),
        "accounts": lambda path: read_records(spark, path),
    }
    entries = None
    for source, reader in readers.items():
        lines = a.chat_lines(spark, sf_dir).select("line") if source == "updates" else a.source_lines(spark, sf_dir, source)
        lines.write.text(f"{folder}/{source}/lines")
        taken = take_in(reader(f"{folder}/{source}/lines"), source, f"{folder}/{source}/read")
        rows = taken.rejects.select("*", *[F.lit(taken.counts[c]).cast("bigint").alias(c) for c in ("n_read", "n_accepted", "n_rejected")])
        entries = rows if entries is None else entries.unionByName(rows)
    return entries


@query
def results_rerun(spark, sf_dir):
    """Address results, published, then those of wallets again: all types as they stand, with their edition."""
    folder = f"{shared_folder(spark)}/docrisk-{uuid.uuid4().hex}"
    scored = address_scores(spark, sf_dir).withColumnRenamed("address_type", "type").withColumn("edition", F.lit(1))
    publish(scored, folder)
    first = read_published(spark, folder, "results", scored.drop("error").schema)
    publish(first.where("type = 'WALLET'").withColumns({"edition": F.lit(2), "error": F.lit(None).cast("string")}), folder)
    good = read_published(spark, folder, "results", scored.drop("error").schema)
    bad = read_published(spark, folder, "rejects", scored.select("address", "type", "success", "error").schema)
    whole = good.unionByName(bad, allowMissingColumns=True)
    return whole.select("address", "type", "success", "error", "score", "edition")


@query
def report_text(spark, sf_dir):
    return report.render_report(a.report_inputs(spark, sf_dir)).select("k", "text", "severity")

"""Shapes of physical plans: what is shuffled, broadcast, pushed down and kept in the JVM."""

import re

import pytest
from pyspark.sql import functions as F

from docrisk.functions.ordered import ordered_scan
from docrisk.operators import risk
from docrisk.plans import adapters as a
from docrisk.plans.catalog import CATALOG


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def logical(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scoring_adds_no_exchange(spark, sf_dir):
    checked = a.checked_orders(spark, sf_dir)
    before, after = plan(checked).count("Exchange"), plan(risk.score_documents(checked, amount=None)).count("Exchange")
    assert before == after


def test_screening_adds_no_exchange(spark, sf_dir):
    documents = a.answered_documents(spark, sf_dir)
    text = plan(CATALOG["screen_answers"](spark, sf_dir))
    assert text.count("Exchange hash") == plan(documents).count("Exchange hash")
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


@pytest.mark.parametrize("name", sorted(set(CATALOG) - {"update_dedup_stream"}))
def test_no_python_workers_and_no_cross_joins(spark, sf_dir, name):
    text = plan(CATALOG[name](spark, sf_dir))
    assert not re.search(r"PythonUDF|BatchEvalPython|ArrowEvalPython|InPandas|InArrow", text)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_top_transfers_limit_before_shuffle(spark, sf_dir):
    text = plan(CATALOG["recent_transfers"](spark, sf_dir))
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")
    assert text.count("WindowGroupLimit") == 2


def test_frame_sample_limits_before_ranking(spark, sf_dir):
    assert "WindowGroupLimit" in plan(CATALOG["frame_sample"](spark, sf_dir))


def test_aggregations_combine_before_the_shuffle(spark, sf_dir):
    for name in ("invoice_reconcile", "statement_totals", "statement_duplicates", "page_conflicts", "update_dedup_batch"):
        text = plan(CATALOG[name](spark, sf_dir))
        assert "partial_" in text, name


def test_digit_counts_need_no_shuffle(spark, sf_dir):
    for name in ("digit_repeats", "digit_states", "claim_fields", "lenient_json", "mime_repair"):
        assert "hashpartitioning(doc_id" not in plan(CATALOG[name](spark, sf_dir)), name


def test_only_needed_columns_are_read(spark, sf_dir):
    text = plan(CATALOG["risk_categories"](spark, sf_dir))
    assert "ReadSchema: struct<o_orderkey:bigint>" in text
    text = plan(CATALOG["statement_totals"](spark, sf_dir))
    assert "props" not in text


def final_plan(df) -> str:
    df.collect()
    return plan(df).split("== Initial Plan")[0]


@pytest.mark.parametrize("options", [{}, {"span": 16}])
def test_ordered_scan_shuffles_rows_once(spark, sf_dir, options):
    events = a.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    scanned = ordered_scan(
        events, "user_id", "event_id", sums={"n": F.lit(1)}, previous={"before": F.col("event_type")}, **options
    )
    text = final_plan(scanned)
    assert len(re.findall(r"[+:]- Exchange hashpartitioning\(_k#\d+, _block", text)) == 1
    # the totals of the blocks read the same exchange a second time
    assert "ReusedExchange" in text


def test_statement_scans_shuffle_once_each(spark, sf_dir):
    for name in ("statement_running_balance", "statement_balance_breaks"):
        text = final_plan(CATALOG[name](spark, sf_dir))
        assert len(re.findall(r"[+:]- Exchange hashpartitioning\(_k#\d+, _block", text)) == 2


def test_filters_reach_the_scan(spark, sf_dir):
    assert "PushedFilters" in plan(a.table(spark, sf_dir, "orders").filter("o_orderkey = 5"))
    files = spark.read.format("binaryFile").load(f"{sf_dir}/orders.parquet").filter("length > 0 and length <= 100")
    assert "PushedFilters: [IsNotNull(length), GreaterThan(length,0), LessThanOrEqual(length,100)]" in plan(files)


def _order_file(spark, folder, keys):
    rows = spark.createDataFrame([(k,) for k in keys], "o_orderkey long")
    rows.coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


@pytest.mark.parametrize("documents", ["checked_orders", "checked_orders_long", "answered_documents", "contract_responses", "statement_responses"])
def test_documents_of_one_file_are_made_by_all_cores(spark, tmp_path, documents):
    keys = [*range(400), *range(40), None, None]
    made = getattr(a, documents)(spark, _order_file(spark, tmp_path, keys))
    key = "doc_id" if documents == "answered_documents" else "k"
    of = made.select(F.col(key).cast("long").alias("k"), F.spark_partition_id().alias("p")).collect()
    assert len({r.p for r in of}) >= spark.sparkContext.defaultParallelism
    if documents != "checked_orders_long":
        assert sorted((r.k is None, r.k) for r in of if r.k is not None) == sorted((False, k) for k in keys if k is not None)
        assert sum(r.k is None for r in of) == 2


def test_chat_rows_of_one_file_are_made_by_all_cores_and_keep_their_order(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    given = [(n % 400 if n < 800 else None, f"b{n}") for n in range(1200)]
    events = spark.createDataFrame(given, "event_id long, props string").coalesce(1)
    events.write.parquet(f"{tmp_path}/events.parquet")
    rows = a.chat_rows(spark, str(tmp_path)).select("u", "text", "caption", F.spark_partition_id().alias("p")).collect()
    assert len(rows) == len(given) and sum(r.u is None for r in rows) == 400
    assert len({r.p for r in rows if r.u is not None}) >= spark.sparkContext.defaultParallelism
    assert len({r.p for r in rows if r.u is None}) >= spark.sparkContext.defaultParallelism
    together = {}
    for r in rows:
        if r.u is not None:
            together.setdefault(r.u, set()).add(r.p)
    assert all(len(p) == 1 for p in together.values())

"""Ordered scans, statements and frames: worked examples, brute force on skewed groups."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from docrisk.functions.ordered import ordered_scan
from docrisk.operators import frames, statement
from docrisk.plans import adapters as a

SPLIT = {"span": 16}


def brute_force(rows):
    out, state = set(), {}
    for key, seq, value in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        total, n, last = state.get(key, (0, 0, None))
        total += value or 0
        n += 1
        out.add((key, seq, total, n, last, seq > 0 and last is not None))
        state[key] = (total, n, value)
    return {r[:5] for r in out}


@pytest.mark.parametrize("options", [{}, SPLIT, {"span": 3}])
def test_scan_equals_brute_force_under_skew(spark, options):
    rng = random.Random(11)
    rows = [("hot", s, rng.choice([None, 1, 5, -2])) for s in rng.sample(range(-1, 400), 200)]
    rows += [(f"k{k}", s, rng.randint(-5, 5)) for k in range(8) for s in range(k * 3)]
    rows += [(None, s, 1) for s in range(40)]
    df = spark.createDataFrame(rows, "k string, seq bigint, v int")
    got = ordered_scan(df, "k", "seq", sums={"total": F.col("v"), "n": F.lit(1)}, previous={"last": F.col("v")}, **options)
    result = [(r.k, r.seq, r.total or 0, r.n, r["last"]) for r in got.collect()]
    assert len(result) == len(rows)
    assert set(result) == brute_force(rows)


MONEY = "decimal(18,2)"


def rows_of(spark, rows):
    df = spark.createDataFrame(rows, "stmt_id string, seq bigint, i double, o double, b double")
    return df.select("stmt_id", "seq", F.col("i").cast(MONEY).alias("amount_in"), F.col("o").cast(MONEY).alias("amount_out"),
                     F.col("b").cast(MONEY).alias("balance"))


def header_of(spark, **values):
    base = {"stmt_id": "s", "opening": 10000.0, "closing": 11500.0, "printed_in": 2000.0, "printed_out": 500.0} | values
    df = spark.createDataFrame([tuple(base.values())], "stmt_id string, opening double, closing double, printed_in double, printed_out double")
    return df.select("stmt_id", *[F.col(c).cast(MONEY).alias(c) for c in df.columns[1:]])


@pytest.mark.parametrize("options", [{}, {"span": 1}])
def test_running_balance(spark, options):
    rows = [("s", 1, 2000.0, None, 12000.0), ("s", 2, None, 500.0, 11400.0), ("s", 3, 1.0, None, 11401.0), ("s", 4, None, None, None), ("s", 5, 1.0, None, 11402.0),
            ("other", 1, 5.0, None, 5.0)]
    got = statement.running_balance(rows_of(spark, rows), header_of(spark), **options).orderBy("stmt_id", "seq").collect()
    assert [(r.stmt_id, r.seq, None if r.expected is None else int(r.expected), r.is_break) for r in got] == [
        ("other", 1, None, None), ("s", 1, 12000, False), ("s", 2, 11500, True), ("s", 3, 11501, True), ("s", 4, None, None), ("s", 5, None, None)]
    breaks = statement.balance_breaks(rows_of(spark, rows), **options).orderBy("stmt_id", "seq").collect()
    assert [r.is_break for r in breaks] == [False, False, True, False, False, False]


def test_consistent_statement_has_no_breaks(spark):
    rows, balance = [], Decimal(100)
    rng = random.Random(5)
    for seq in range(1, 120):
        move = rng.randint(1, 900)
        balance += move if seq % 2 else -move
        rows.append(("s", seq, float(move) if seq % 2 else None, None if seq % 2 else float(move), float(balance)))
    df = rows_of(spark, rows)
    head = header_of(spark, opening=100.0)
    assert statement.running_balance(df, head, **SPLIT).filter("is_break or is_break is null").count() == 0
    assert statement.balance_breaks(df, **SPLIT).filter("is_break").count() == 0


def test_totals(spark):
    rows = [("s", 1, 2000.0, None, None), ("s", 2, None, 500.0, None)]
    r = statement.statement_totals(rows_of(spark, rows), header_of(spark)).first()
    assert (int(r.net), int(r.calculated_closing), r.n, r.closing_matches, r.in_matches, r.out_matches) == (1500, 11500, 2, True, True, True)
    off = statement.statement_totals(rows_of(spark, rows), header_of(spark, closing=11400.0, printed_out=499.0)).first()
    assert (off.closing_matches, off.in_matches, off.out_matches) == (False, True, False)


@pytest.mark.parametrize("options", [{}, {"span": 2}])
def test_pages(spark, options):
    pages = spark.createDataFrame(
        [("s", 1, 0.0, 10.0), ("s", 2, 10.0, 20.0), ("s", 3, 21.0, 30.0), ("s", 5, 99.0, 1.0), ("s", 6, 1.0, 2.0)],
        "stmt_id string, page_no bigint, first_balance double, last_balance double",
    )
    got = statement.page_breaks(pages, **options).orderBy("page_no").collect()
    assert [(r.page_no, r.is_break, r.is_gap) for r in got] == [
        (1, False, False), (2, False, False), (3, True, False), (5, False, True), (6, False, False)]


def test_duplicates(spark):
    df = spark.createDataFrame(
        [("s", "2024-01-01", 5.0, None, "a", "x"), ("s", "2024-01-01", 5.0, None, "a", "x"), ("s", "2024-01-01", 5.0, None, "a", "y"),
         ("s", "2024-01-02", 5.0, None, "a", None), ("s", "2024-01-02", 5.0, None, "a", None)],
        "stmt_id string, tx_date_text string, amount_in double, amount_out double, description string, counterparty string",
    )
    assert sorted((r.counterparty or "", r.n) for r in statement.duplicate_transactions(df).collect()) == [("", 2), ("x", 2)]


def test_dates(spark):
    texts = ["2024-01-05", "04.01.2024", "2024-02-31", "06/01/2024", "2023-12-31", "yarın", None, "29.02.2024"]
    rows = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "stmt_id string, seq bigint, tx_date_text string")
    header = spark.sql("select 's' stmt_id, date '2024-01-01' period_start, date '2024-01-31' period_end")
    for options in ({}, {"span": 2}):
        r = statement.date_findings(rows, header, **options).first()
        assert (r.n_backwards, r.n_impossible, r.n_unreadable, r.n_out_of_period, r.n_formats) == (2, 1, 1, 2, 4)


def test_page_conflicts(spark):
    pages = spark.createDataFrame(
        [("s", 1, "A", "I", "1", "P", "TRY"), ("s", 2, "A", "J", None, "P", "TRY"), ("s", 3, "B", "I", "1", "P", None)],
        "stmt_id string, page_no int, holder string, iban string, account_no string, period string, currency string",
    )
    assert sorted((r.field, r.n_values) for r in statement.page_conflicts(pages).collect()) == [("holder", 2), ("iban", 2)]


def test_frames(spark):
    rows = [("v", f"frame-{i:03d}", i * 0.2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id string, frame_name string, ts double")
    got = [r.frame_name for r in frames.sample_frames(df).orderBy("rank").collect()]
    assert got == [f"frame-{i:03d}" for i in (0, 3, 5, 8, 10, 13, 15, 18)]
    readings = spark.createDataFrame(
        [("v", "amount", "25.000 TL"), ("v", "amount", "35.000 TL"), ("v", "iban", "X"), ("v", "iban", None), ("v", "iban", " X "),
         ("v", "wallpaper", "1"), ("v", "wallpaper", "2")],
        "doc_id string, field string, value string",
    )
    assert [(r.field, r.n_values) for r in frames.frame_conflicts(readings).collect()] == [("amount", 2)]


def test_adapter_order_survives_splitting(spark, sf_dir):
    """The derived statement rows are the same whether or not the largest groups are cut."""
    events = a.table(spark, sf_dir, "events").select("event_id", "value", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")).alias("u"))
    args = dict(sums={"n": F.lit(1), "s": F.col("value").cast("decimal(18,2)")}, previous={"p": F.col("value")})
    whole = ordered_scan(events, "u", "event_id", **args)
    cut = ordered_scan(events, "u", "event_id", **args, span=64)
    assert whole.exceptAll(cut).count() == cut.exceptAll(whole).count() == 0

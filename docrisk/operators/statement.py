"""Bank statements: totals, running balance, continuity, duplicates, dates, page agreement.

Row order inside a statement is ``seq``, page order ``page_no``; both are unique per statement.
Everything order dependent goes through ``ordered_scan``, so one huge statement is cut into
blocks; everything else is a partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrisk import dims
from docrisk.functions.ordered import ordered_scan
from docrisk.functions.values import is_true, squeeze, strip
from docrisk.operators.claims import comparable

# sorts before every row of a statement
HEADER_SEQ = -1

DATE_FORMATS = {
    "iso": (r"^\d{4}-\d{2}-\d{2}\z", "yyyy-MM-dd"),
    "dotted": (r"^\d{2}\.\d{2}\.\d{4}\z", "dd.MM.yyyy"),
    "slashed": (r"^\d{2}/\d{2}/\d{4}\z", "dd/MM/yyyy"),
    "dashed": (r"^\d{2}-\d{2}-\d{4}\z", "dd-MM-yyyy"),
}


def _unreadable() -> Column:
    """A row of which neither amount was read."""
    return F.col("amount_in").isNull() & F.col("amount_out").isNull()


def _movement() -> Column:
    """What a row adds to the balance; NULL where that was not read."""
    zero = F.lit(0).cast("decimal(18,2)")
    return F.when(~_unreadable(), F.coalesce(F.col("amount_in"), zero) - F.coalesce(F.col("amount_out"), zero))


def statement_totals(rows: DataFrame, header: DataFrame) -> DataFrame:
    """Totals of the rows against the printed totals and the printed closing balance.

    A statement with an unreadable amount has no totals, and nothing is concluded from them.
    """
    zero = F.lit(0).cast("decimal(18,2)")
    whole = F.count(F.when(_unreadable(), 1)) == 0
    sums = rows.groupBy("stmt_id").agg(
        F.when(whole, F.coalesce(F.sum("amount_in"), zero)).alias("total_in"),
        F.when(whole, F.coalesce(F.sum("amount_out"), zero)).alias("total_out"),
        F.count("*").alias("n"),
    )
    printed = header.select("stmt_id", "opening", "closing", "printed_in", "printed_out")
    return (
        sums.join(printed, "stmt_id", "left")
        .withColumn("net", F.col("total_in") - F.col("total_out"))
        .withColumn("calculated_closing", F.col("opening") + F.col("net"))
        .withColumn("closing_matches", F.col("calculated_closing") == F.col("closing"))
        .withColumn("in_matches", F.col("total_in") == F.col("printed_in"))
        .withColumn("out_matches", F.col("total_out") == F.col("printed_out"))
    )


def running_balance(rows: DataFrame, header: DataFrame, **scan) -> DataFrame:
    """Expected balance after each row: opening plus all movements so far, against the shown one.

    The header enters the scan as the row before the first one, so opening balances need no join.
    From the first row with an unreadable amount on, nothing is expected; row-to-row continuity
    (``balance_breaks``) starts again from every shown balance.
    """
    moves = rows.select(
        "stmt_id", "seq", F.col("balance").alias("shown"), _movement().alias("_move"), F.lit(0).alias("_head"),
        _unreadable().cast("int").alias("_gap"),
    )
    heads = header.select(
        "stmt_id",
        F.lit(HEADER_SEQ).cast("bigint").alias("seq"),
        F.lit(None).cast("decimal(18,2)").alias("shown"),
        F.col("opening").alias("_move"),
        F.col("opening").isNotNull().cast("int").alias("_head"),
        F.lit(0).alias("_gap"),
    )
    scanned = ordered_scan(
        moves.unionByName(heads), "stmt_id", "seq",
        sums={"_balance": F.col("_move"), "_opened": F.col("_head"), "_gaps": F.col("_gap")}, **scan,
    )
    expected = F.when((F.col("_opened") > 0) & (F.col("_gaps") == 0), F.col("_balance"))
    return (
        scanned.filter(F.col("seq") != HEADER_SEQ)
        .withColumn("expected", expected)
        .withColumn("is_break", F.col("expected") != F.col("shown"))
        .select("stmt_id", "seq", "expected", "shown", "is_break")
    )


def balance_breaks(rows: DataFrame, **scan) -> DataFrame:
    """Row-to-row continuity: previous shown balance plus movement against the shown balance.

    Unlike the running balance, one wrong balance does not mark every later row. The first row
    has nothing to compare with.
    """
    scanned = ordered_scan(
        rows.select("stmt_id", "seq", "balance", _movement().alias("_move")),
        "stmt_id", "seq", previous={"_before": F.col("balance")}, **scan,
    )
    return scanned.withColumn("expected", F.col("_before") + F.col("_move")).select(
        "stmt_id", "seq", "expected", F.col("balance").alias("shown"),
        is_true(F.col("expected") != F.col("balance")).alias("is_break"),
    )


def page_breaks(pages: DataFrame, **scan) -> DataFrame:
    """Balance carried from page to page, and gaps in the page numbers."""
    scanned = ordered_scan(
        pages.select("stmt_id", "page_no", "first_balance", "last_balance"),
        "stmt_id", "page_no",
        previous={"_page": F.col("page_no"), "_last": F.col("last_balance")}, **scan,
    )
    consecutive = F.col("_page") + 1 == F.col("page_no")
    return scanned.select(
        "stmt_id", "page_no",
        is_true(consecutive & (F.col("_last") != F.col("first_balance"))).alias("is_break"),
        is_true(~consecutive).alias("is_gap"),
    )


def duplicate_transactions(rows: DataFrame) -> DataFrame:
    """Transactions that occur more than once with same date, amount, text and counterparty.

    ``tx_date`` is the date as ISO text, in whichever notation it is printed, or the text itself where
    it is no date. Blanks do not make texts differ.
    """
    day = F.coalesce(read_date(F.col("tx_date_text")).cast("string"), squeeze(F.col("tx_date_text")))
    return (
        rows.select(
            "stmt_id", day.alias("tx_date"), "amount_in", "amount_out",
            squeeze(F.col("description")).alias("description"), squeeze(F.col("counterparty")).alias("counterparty"),
        )
        .groupBy("stmt_id", "tx_date", "amount_in", "amount_out", "description", "counterparty")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > 1)
    )


def date_format(text: Column) -> Column:
    """iso, dotted, slashed, dashed or other."""
    t = strip(text)
    out = F.when(t.isNull(), F.lit(None).cast("string"))
    for name, (pattern, _) in DATE_FORMATS.items():
        out = out.when(t.rlike(pattern), name)
    return out.otherwise("other")


def read_date(text: Column) -> Column:
    """The date in whichever known format it is written; NULL when there is no such day."""
    t = strip(text)
    out = F.when(F.lit(False), F.lit(None).cast("date"))
    for pattern, form in DATE_FORMATS.values():
        out = out.when(t.rlike(pattern), F.try_to_date(t, form))
    return out


def date_findings(rows: DataFrame, header: DataFrame, **scan) -> DataFrame:
    """Per statement: dates going backwards, impossible, unreadable, out of period, and formats in use.

    Impossible is a text in a known notation that names no day, unreadable one in no known notation.
    Mixed formats and single findings are signals, not proof. The period travels with the header
    row through the scan, as the running balance's opening does.
    """
    day = F.unix_date(F.col("_date"))
    dated = rows.select(
        "stmt_id", "seq", "tx_date_text", read_date(F.col("tx_date_text")).alias("_date"),
        F.lit(0).alias("_from"), F.lit(0).alias("_to"), F.lit(0).alias("_head"),
    )
    heads = header.select(
        "stmt_id",
        F.lit(HEADER_SEQ).cast("bigint").alias("seq"),
        F.lit(None).cast("string").alias("tx_date_text"),
        F.lit(None).cast("date").alias("_date"),
        F.unix_date("period_start").alias("_from"),
        F.unix_date("period_end").alias("_to"),
        F.lit(1).alias("_head"),
    )
    scanned = ordered_scan(
        dated.unionByName(heads), "stmt_id", "seq",
        sums={"_start": F.col("_from"), "_end": F.col("_to"), "_period": F.col("_head")},
        previous={"_before": F.col("_date")}, **scan,
    ).filter(F.col("seq") != HEADER_SEQ)
    fmt = date_format(F.col("tx_date_text"))

    def count_if(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    used = [F.coalesce(F.max(fmt == name), F.lit(False)).cast("int") for name in [*DATE_FORMATS, "other"]]
    outside = (F.col("_period") > 0) & ~day.between(F.col("_start"), F.col("_end"))
    return scanned.groupBy("stmt_id").agg(
        count_if(F.col("_before") > F.col("_date")).alias("n_backwards"),
        count_if((fmt != "other") & F.col("_date").isNull()).alias("n_impossible"),
        count_if(fmt == "other").alias("n_unreadable"),
        count_if(outside).alias("n_out_of_period"),
        sum(used[1:], used[0]).alias("n_formats"),
    )


def field_conflicts(readings: DataFrame, key: str) -> DataFrame:
    """Fields read with more than one value within one key; unreadable (NULL) readings never count.

    ``readings`` is long: key, field, value. Equal values collapse map-side before the shuffle. The
    smallest and the largest value are shown.
    """
    return (
        readings.filter(F.col("value").isNotNull())
        .groupBy(key, "field")
        .agg(F.count_distinct("value").alias("n_values"), F.min("value").alias("low"), F.max("value").alias("high"))
        .filter(F.col("n_values") > 1)
    )


#: The claim field in whose form each page field is compared.
_COMPARED_AS = {"holder": "senderName", "currency": "currency"}


def page_conflicts(pages: DataFrame) -> DataFrame:
    """Holder, IBAN, account, period or currency differing between the pages of a statement.

    Values are compared as claims are: blanks, case and spellings of one currency do not count.
    """
    form = {f: comparable(_COMPARED_AS.get(f, "iban"), F.col(f)) for f in dims.PAGE_FIELDS}
    fields = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in form.items()])
    long = pages.select("stmt_id", F.explode(fields).alias("r")).select("stmt_id", "r.*")
    return field_conflicts(long, "stmt_id")

"""Chain addresses: token or wallet, rule scores, recent transfers."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrisk import dims
from docrisk.functions.identifiers import clean_address, valid_address
from docrisk.functions.scoring import Rule, risk_label, rule_codes, rule_messages, rule_score
from docrisk.functions.values import (
    first_number,
    first_text,
    if_truthy,
    is_exactly,
    is_true,
    member,
    number,
    present,
    truthy,
)


def _token_rules(security: Column) -> list[Rule]:
    level = number(member(security, "token_level"))
    liquidity_field = member(security, "sun_liquidity")
    liquidity = F.when(truthy(liquidity_field), number(liquidity_field)).otherwise(F.lit(0.0))

    def flag_is(name: str, value: bool) -> Column:
        return is_exactly(member(security, name), value)

    def number_is(name: str, value: int) -> Column:
        return is_true(number(member(security, name)) == value)

    # --- fixed values: points per finding ---
    scored = [
        ("TOKEN_UNSAFE", 45, is_true(level == 4)),
        ("TOKEN_SUSPECT", 30, is_true(level == 3)),
        ("TOKEN_LEVEL_UNKNOWN", 10, is_true(level == 0)),
        ("TOKEN_NOT_VIP", 5, flag_is("is_vip", False)),
        ("SUPPLY_INCREASABLE", 20, number_is("increase_total_supply", 1)),
        ("BLACKLIST_FEATURE", 10, number_is("black_list_type", 1)),
        ("NOT_OPEN_SOURCE", 10, flag_is("open_source", False)),
        ("PROXY_CONTRACT", 10, flag_is("is_proxy", True)),
        ("NO_LIQUIDITY", 15, is_true(liquidity == 0)),
        ("LOW_LIQUIDITY", 10, is_true((liquidity < 1000) & (liquidity != 0))),
    ]
    return [Rule(code, points, hit, F.lit(dims.TOKEN_WARNINGS[code])) for code, points, hit in scored]


def _scored(df: DataFrame, rules: list[Rule]) -> DataFrame:
    # the conditions once, as a list of flags: score, codes and warnings all read them
    flags = df.withColumn("_hits", F.array(*[r.condition for r in rules]))
    found = [replace(r, condition=F.get(F.col("_hits"), F.lit(i))) for i, r in enumerate(rules)]
    return flags.withColumns(
        {"score": rule_score(found), "codes": rule_codes(found), "warnings": rule_messages(found)}
    ).withColumn("label", risk_label(F.col("score"))).drop("_hits")


def token_risk(df: DataFrame, security: str = "security") -> DataFrame:
    """Add score, label, codes and warnings of a token from its security record (a variant)."""
    return _scored(df, _token_rules(F.col(security)))


def age_days(created_seconds: Column, as_of: Column) -> Column:
    return (F.unix_millis(as_of) - created_seconds * 1000) / F.lit(86400000.0)


def _wallet_rules(account: Column, n_transfers: Column, as_of: Column) -> list[Rule]:
    risk, tag = member(account, "risk"), member(account, "publicTag")
    transactions, created = member(account, "transactions"), member(account, "date_created")
    flagged = is_exactly(risk, True) | is_true(
        (F.schema_of_variant(risk) == "STRING") & (F.try_variant_get(risk, "$", "string") == "true")
    )
    n_transactions = F.when(truthy(transactions), number(transactions)).otherwise(F.lit(0.0))
    transfers = F.coalesce(n_transfers, F.lit(0))
    age = F.when(truthy(created), age_days(number(created), as_of))
    text = dims.WALLET_WARNINGS

    def filled(code: str, value: Column) -> Column:
        head, tail = text[code].split("{}")
        return F.concat(F.lit(head), value, F.lit(tail))

    # --- fixed values: points per finding ---
    return [
        Rule("ACCOUNT_FLAGGED", 60, flagged, F.lit(text["ACCOUNT_FLAGGED"])),
        Rule("PUBLIC_TAG", 0, truthy(tag), filled("PUBLIC_TAG", F.try_variant_get(tag, "$", "string"))),
        Rule("VIP_ACCOUNT", 0, is_exactly(member(account, "vip"), True), F.lit(text["VIP_ACCOUNT"])),
        Rule("NO_TRANSACTIONS", 10, is_true(n_transactions == 0), F.lit(text["NO_TRANSACTIONS"])),
        Rule("TRANSFERS_FOUND", 0, transfers > 0, filled("TRANSFERS_FOUND", transfers.cast("string"))),
        Rule("NO_TRANSFERS", 0, transfers <= 0, F.lit(text["NO_TRANSFERS"])),
        Rule("VERY_NEW", 15, is_true(age < 7), F.lit(text["VERY_NEW"])),
        Rule("NEW", 5, is_true((age >= 7) & (age < 30)), F.lit(text["NEW"])),
    ]


def wallet_risk(
    df: DataFrame, as_of: Column | None = None, account: str = "account", n_transfers: str = "n_transfers"
) -> DataFrame:
    """Add score, label, codes and warnings of a wallet from its account record (a variant).

    ``as_of`` is the moment ages are measured at; the default is now.
    """
    moment = F.current_timestamp() if as_of is None else as_of
    return _scored(df, _wallet_rules(F.col(account), F.col(n_transfers), moment))


# --- projections -----------------------------------------------------------------------------


def first_token(tokens: Column) -> Column:
    """The first token record of a lookup, NULL when it found none."""
    return F.get(tokens, F.lit(0))


def token_fields(token: Column, address: Column) -> Column:
    return F.struct(
        first_text(token["name"]).alias("name"),
        first_text(token["symbol"]).alias("symbol"),
        first_text(token["contract_name"]).alias("contractName"),
        first_text(token["contract_address"], address).alias("contractAddress"),
        first_text(token["issue_address"]).alias("issuer"),
        token["decimals"].alias("decimals"),
        first_text(token["total_supply"]).alias("totalSupply"),
        first_number(token["holders_count"]).alias("holders"),
        first_number(token["transfer_num"]).alias("transfers"),
        first_number(token["transfer24h"]).alias("transfers24h"),
        first_number(token["market_info"]["priceInUsd"]).alias("priceUsd"),
        first_number(token["market_info"]["liquidity"]).alias("liquidityUsd"),
        first_number(token["market_cap_usd"]).alias("marketCapUsd"),
    )


def security_fields(security: Column) -> Column:
    names = {
        "vip": "is_vip",
        "blacklist": "black_list_type",
        "canIncreaseSupply": "increase_total_supply",
        "tokenLevel": "token_level",
        "hasUrl": "has_url",
        "swapToken": "swap_token",
        "liquidity": "sun_liquidity",
        "openSource": "open_source",
        "proxy": "is_proxy",
    }
    return F.struct(*[present(member(security, field)).cast("string").alias(n) for n, field in names.items()])


def wallet_fields(account: Column) -> Column:
    names = {
        "balanceTRX": "balance",
        "transactions": "transactions",
        "dateCreated": "date_created",
        "vip": "vip",
        "risk": "risk",
        "publicTag": "publicTag",
        "publicTagDesc": "publicTagDesc",
    }
    fields = [present(member(account, field)).cast("string").alias(n) for n, field in names.items()]
    return F.struct(*fields, if_truthy(member(account, "name")).cast("string").alias("name"))


def _either(df: DataFrame, *names: str) -> list[Column]:
    return [F.col(n) for n in names if n.split(".")[0] in df.columns]


def transfer_fields(df: DataFrame) -> DataFrame:
    """Transfers with their alternate field names resolved: address, transactionHash, from, to,
    token, amount, timestamp. Columns a source does not deliver may be absent."""

    def text(*names: str) -> Column:
        return first_text(*(_either(df, *names) or [F.lit(None).cast("string")]))

    def any_of(kind: str, *names: str) -> Column:
        return F.coalesce(*(_either(df, *names) or [F.lit(None)])).cast(kind)

    return df.select(
        "address",
        text("transaction_id", "transactionHash").alias("transactionHash"),
        text("from_address", "fromAddress").alias("from"),
        text("to_address", "toAddress").alias("to"),
        text("tokenInfo.tokenAbbr", "tokenAbbr").alias("token"),
        any_of("string", "quant", "amount").alias("amount"),
        any_of("bigint", "block_ts", "timestamp").alias("timestamp"),
    )


def transfer_list(df: DataFrame) -> DataFrame:
    """Explode a fetched transfer response: ``token_transfers``, else ``data``, else nothing."""
    lists = _either(df, "token_transfers", "data")
    return df.select("address", F.explode(F.coalesce(*lists)).alias("_t")).select("address", "_t.*")


def recent_transfers(df: DataFrame, key: str = "address", n: int = dims.MAX_TRANSFERS,
                     order: list[Column] | None = None) -> DataFrame:
    """The latest ``n`` transfers per wallet, ranked.

    The rank limit is applied before the shuffle as well, so a wallet with a huge history sends
    at most ``n`` rows per input task.
    """
    order = order or [F.col("timestamp").desc(), F.col("transactionHash")]
    ranked = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("rank", ranked).filter(F.col("rank") <= n)


# --- one score per address ---------------------------------------------------------------------


def classify_addresses(addresses: DataFrame, tokens: DataFrame, key: str = "address") -> DataFrame:
    """Add ``token`` (first record or NULL) and ``address_type``; one lookup counts for each address."""
    found = (
        tokens.select(F.col("address").alias(key), first_token(F.col("trc20_tokens")).alias("token"))
        .groupBy(key)
        .agg(F.min("token").alias("token"))
    )
    return addresses.join(found, key, "left").withColumn(
        "address_type", F.when(F.col("token").isNotNull(), "TOKEN_CONTRACT").otherwise("WALLET")
    )


def _one_record(records: DataFrame, name: str) -> DataFrame:
    """One record (a variant ``v``) per address: of several, the first by its text."""
    return records.groupBy("address").agg(F.min_by("v", F.to_json("v")).alias(name))


def score_addresses(
    addresses: DataFrame,
    tokens: DataFrame,
    security: DataFrame,
    accounts: DataFrame,
    transfers: DataFrame,
    as_of: Column | None = None,
) -> DataFrame:
    """One result per distinct requested address.

    ``addresses`` has a column address; ``tokens`` address and trc20_tokens; ``security`` and
    ``accounts`` address and v (a variant); ``transfers`` raw transfers, or fetched responses that
    hold lists of them. Of several records for one address one counts. Requests are made distinct
    first, so a request repeated a million times is scored once. Everything is joined once on the
    address, and only transfers of requested wallets are counted and ranked. Invalid addresses and
    wallets without an account record come out as success = false.
    """
    wanted = addresses.select(clean_address(F.col("address")).alias("address")).distinct()
    typed = classify_addresses(wanted, tokens).withColumn("_valid", is_true(valid_address(F.col("address"))))
    known = (
        typed.join(_one_record(security, "security"), "address", "left")
        .join(_one_record(accounts, "account"), "address", "left")
    )
    if "token_transfers" in transfers.columns or "data" in transfers.columns:
        transfers = transfer_list(transfers)
    asked = transfer_fields(transfers).join(wanted, "address", "left_semi")
    counts = asked.groupBy("address").agg(F.count("*").alias("n_transfers"))
    latest = recent_transfers(asked).groupBy("address").agg(
        # bounded: the ranking left at most twenty rows per address
        F.array_sort(F.collect_list(F.struct("rank", "transactionHash", "from", "to", "token", "amount", "timestamp"))).alias("recent_transfers")
    )
    rows = known.join(counts, "address", "left").join(latest, "address", "left")

    is_token = F.col("address_type") == "TOKEN_CONTRACT"
    scores = ["score", "label", "codes", "warnings"]
    both = wallet_risk(
        token_risk(rows).withColumns({f"_token_{c}": F.col(c) for c in scores}).drop(*scores), as_of
    )
    error = (
        F.when(~F.col("_valid"), dims.INVALID_ADDRESS)
        .when(~is_token & F.col("account").isNull(), dims.NO_ACCOUNT)
    )
    ok, wallet = F.col("error").isNull(), F.col("error").isNull() & ~is_token
    return both.withColumn("error", error).select(
        "address",
        F.when(ok, F.col("address_type")).alias("address_type"),
        F.when(ok & is_token, "TRC20").alias("token_type"),
        *[F.when(ok, F.when(is_token, F.col(f"_token_{c}")).otherwise(F.col(c))).alias(c) for c in scores],
        F.when(ok & is_token, token_fields(F.col("token"), F.col("address"))).alias("token"),
        F.when(ok & is_token, security_fields(F.col("security"))).alias("security"),
        F.when(wallet, wallet_fields(F.col("account"))).alias("wallet"),
        F.when(wallet, F.col("recent_transfers")).alias("recent_transfers"),
        F.when(wallet, F.coalesce("n_transfers", F.lit(0))).alias("n_transfers"),
        ok.alias("success"), "error", F.lit("TRON").alias("network"),
        F.when(ok, dims.CHAIN_DISCLAIMER).alias("disclaimer"),
    )

"""Token and wallet scores, projections, transfers: worked examples."""

import pytest
from pyspark.sql import functions as F

from docrisk import dims, schemas
from docrisk.operators import chain
from docrisk.sources.chain import read_chain

AS_OF = "timestamp '2024-02-01 00:00:00'"
NOW = 1706745600
DAY = 86400


def scored(spark, fn, record, **extra):
    df = spark.createDataFrame([(record,)], "j string").select(F.try_parse_json("j").alias("r"))
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return fn(df).first()


@pytest.mark.parametrize(
    "security, score, label, codes",
    [
        (None, 15, "LOW RISK", ["NO_LIQUIDITY"]),
        ('{"token_level":null}', 25, "MODERATE RISK", ["TOKEN_LEVEL_UNKNOWN", "NO_LIQUIDITY"]),
        ('{"token_level":1,"is_vip":true,"open_source":true,"is_proxy":false,"sun_liquidity":5000}', 0, "LOW RISK", []),
        ('{"token_level":"3","sun_liquidity":500}', 40, "MODERATE RISK", ["TOKEN_SUSPECT", "LOW_LIQUIDITY"]),
        ('{"token_level":4,"is_vip":false,"increase_total_supply":1,"black_list_type":"1","open_source":false,"is_proxy":true,"sun_liquidity":0}',
         100, "VERY HIGH RISK",
         ["TOKEN_UNSAFE", "TOKEN_NOT_VIP", "SUPPLY_INCREASABLE", "BLACKLIST_FEATURE", "NOT_OPEN_SOURCE", "PROXY_CONTRACT", "NO_LIQUIDITY"]),
        ('{"token_level":1,"is_vip":"false","open_source":0,"is_proxy":"true","sun_liquidity":"abc"}', 0, "LOW RISK", []),
        ('{"token_level":1,"sun_liquidity":"1000"}', 0, "LOW RISK", []),
        ('{"token_level":1,"sun_liquidity":-5}', 10, "LOW RISK", ["LOW_LIQUIDITY"]),
    ],
)
def test_token(spark, security, score, label, codes):
    r = scored(spark, lambda df: chain.token_risk(df, "r"), security)
    assert (r.score, r.label, r.codes) == (score, label, codes)
    assert r.warnings == [dims.TOKEN_WARNINGS[c] for c in codes]


@pytest.mark.parametrize(
    "account, transfers, score, label, codes",
    [
        ("{}", None, 10, "LOW RISK", ["NO_TRANSACTIONS", "NO_TRANSFERS"]),
        (f'{{"risk":"true","publicTag":"X","transactions":5,"date_created":{NOW - 10 * DAY}}}', 3, 65, "HIGH RISK",
         ["ACCOUNT_FLAGGED", "PUBLIC_TAG", "TRANSFERS_FOUND", "NEW"]),
        (f'{{"risk":true,"transactions":0,"date_created":{NOW - 3 * DAY}}}', 0, 85, "VERY HIGH RISK",
         ["ACCOUNT_FLAGGED", "NO_TRANSACTIONS", "NO_TRANSFERS", "VERY_NEW"]),
        (f'{{"transactions":9,"date_created":{NOW - 7 * DAY}}}', 1, 5, "LOW RISK", ["TRANSFERS_FOUND", "NEW"]),
        (f'{{"transactions":9,"date_created":{NOW - 30 * DAY}}}', 1, 0, "LOW RISK", ["TRANSFERS_FOUND"]),
        (f'{{"transactions":9,"date_created":{NOW}000}}', 1, 15, "LOW RISK", ["TRANSFERS_FOUND", "VERY_NEW"]),
        ('{"transactions":"x","risk":1,"vip":true,"date_created":0}', 1, 0, "LOW RISK", ["VIP_ACCOUNT", "TRANSFERS_FOUND"]),
    ],
)
def test_wallet(spark, account, transfers, score, label, codes):
    fn = lambda df: chain.wallet_risk(df.withColumn("n", F.col("n").cast("int")), F.expr(AS_OF), "r", "n")
    r = scored(spark, fn, account, n=transfers)
    assert (r.score, r.label, r.codes) == (score, label, codes)
    if "PUBLIC_TAG" in codes:
        assert "Adres etiketi: X" in r.warnings and "Son işlemler arasında 3 TRC20 transferi bulundu." in r.warnings


def test_token_fields(spark):
    token = ("", "S", None, "", "I", 0, "0", 0, 5, None, (0.0, 2.5), None)
    df = spark.createDataFrame([("addr", [token])], schemas.TOKENS)
    t = df.select(chain.token_fields(chain.first_token(F.col("trc20_tokens")), F.col("address")).alias("t")).first().t
    assert (t.name, t.symbol, t.contractAddress, t.decimals, t.totalSupply) == (None, "S", "addr", 0, "0")
    assert (t.holders, t.transfers, t.priceUsd, t.liquidityUsd) == (None, 5, None, 2.5)


def test_transfer_names_and_lists(spark):
    df = spark.createDataFrame(
        [("a", [{"transaction_id": "", "transactionHash": "h", "from_address": "f", "quant": "0", "block_ts": 0, "timestamp": 9}], None),
         ("b", None, [{"transaction_id": "x", "transactionHash": "h", "from_address": None, "quant": None, "block_ts": None, "timestamp": 9}]),
         ("c", None, None)],
        "address string, token_transfers array<struct<transaction_id:string,transactionHash:string,from_address:string,quant:string,block_ts:bigint,timestamp:bigint>>, "
        "data array<struct<transaction_id:string,transactionHash:string,from_address:string,quant:string,block_ts:bigint,timestamp:bigint>>",
    )
    rows = {r.address: r for r in chain.transfer_fields(chain.transfer_list(df)).collect()}
    assert set(rows) == {"a", "b"}
    assert (rows["a"].transactionHash, rows["a"]["from"], rows["a"].amount, rows["a"].timestamp) == ("h", "f", "0", 0)
    assert (rows["b"].transactionHash, rows["b"].amount, rows["b"].timestamp, rows["b"].to) == ("x", None, 9, None)


def test_recent_transfers_limit(spark):
    df = spark.range(100).select(F.lit("a").alias("address"), F.col("id").alias("timestamp"), F.col("id").cast("string").alias("transactionHash"))
    rows = chain.recent_transfers(df).collect()
    assert sorted(r.timestamp for r in rows) == list(range(80, 100)) and max(r.rank for r in rows) == 20


def test_whole_flow_from_files(spark, tmp_path):
    good = ["T" + c * 33 for c in "abcd"]
    files = {
        "tokens": [f'{{"address":"{good[0]}","trc20_tokens":[{{"name":"N","symbol":"S"}},{{"name":"M"}}]}}',
                   f'{{"address":"{good[1]}","trc20_tokens":[]}}'],
        "security": [f'{{"address":"{good[0]}","record":{{"token_level":4}}}}', "broken"],
        "accounts": [f'{{"address":"{good[1]}","record":{{"transactions":1,"name":"n"}}}}', f'{{"address":"{good[2]}","record":{{}}}}'],
        "transfers": [f'{{"address":"{good[1]}","transaction_id":"t{i}","block_ts":{i}}}' for i in range(30)],
    }
    tables = {}
    for kind, lines in files.items():
        (tmp_path / kind).mkdir()
        (tmp_path / kind / "part.json").write_text("\n".join(lines))
        tables[kind] = read_chain(spark, kind, str(tmp_path / kind))
    asked = spark.createDataFrame([(g,) for g in [*good, good[0], f" {good[1]}", "bad"]], "address string")
    rows = chain.score_addresses(asked, tables["tokens"], tables["security"], tables["accounts"], tables["transfers"], F.expr(AS_OF)).collect()
    got = {r.address: r for r in rows}
    assert len(rows) == len(got) == 5
    assert (got[good[0]].address_type, got[good[0]].score, got[good[0]].token.name) == ("TOKEN_CONTRACT", 60, "N")
    wallet = got[good[1]]
    assert (wallet.address_type, wallet.score, wallet.wallet.name, len(wallet.recent_transfers)) == ("WALLET", 0, "n", 20)
    assert [t.rank for t in wallet.recent_transfers] == list(range(1, 21)) and wallet.recent_transfers[0].transactionHash == "t29"
    assert got[good[2]].codes == ["NO_TRANSACTIONS", "NO_TRANSFERS"]
    assert (got[good[3]].success, got["bad"].error) == (False, dims.INVALID_ADDRESS)
    with pytest.raises(ValueError):
        read_chain(spark, "blocks", "x")

"""Schemas of the tables and records the engine reads."""

from __future__ import annotations

from pyspark.sql import types as T

from docrisk import dims

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
MONEY = T.DecimalType(18, 2)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


UPLOAD = struct(path=S, original_name=S, mime=S)

# Form fields arrive as lists; uploads under one of three names.
MANIFEST = struct(
    doc_id=S,
    type=T.ArrayType(S),
    file_name=T.ArrayType(S),
    bank=T.ArrayType(S),
    statement_mode=T.ArrayType(S),
    image=UPLOAD,
    file=UPLOAD,
    video=UPLOAD,
)

MODEL_RESPONSES = struct(doc_id=S, type=S, output_text=S)

CHECK = struct(status=S, score=D, evidence=S)
CHECKS = struct(**{name: CHECK for name in dims.CHECK_NAMES})
CATEGORIES = struct(**{name: I for name in dims.CATEGORY_WEIGHTS})

INVOICE_LINES = struct(doc_id=S, kind=S, amount=MONEY)

STATEMENT_HEADER = struct(
    stmt_id=S, bank=S, holder=S, iban=S, account_no=S, period_start=T.DateType(), period_end=T.DateType(),
    currency=S, opening=MONEY, closing=MONEY, printed_in=MONEY, printed_out=MONEY,
)
STATEMENT_ROWS = struct(
    stmt_id=S, page_no=I, seq=L, tx_date_text=S, description=S, amount_in=MONEY, amount_out=MONEY,
    balance=MONEY, counterparty=S, ref_no=S,
)
STATEMENT_PAGES = struct(
    stmt_id=S, page_no=L, holder=S, iban=S, account_no=S, period=S, currency=S,
    first_balance=MONEY, last_balance=MONEY,
)

FRAMES = struct(doc_id=S, frame_name=S, ts=D)
FRAME_READINGS = struct(doc_id=S, frame_name=S, field=S, value=S)

CLAIM = struct(senderName=S, recipientName=S, amount=S, currency=S, iban=S, rawText=S)

# --- chat updates ---------------------------------------------------------------------

CHAT = struct(id=L)
PHOTO = T.ArrayType(struct(file_id=S))
VIDEO = struct(file_id=S, mime_type=S)
DOCUMENT = struct(file_id=S, file_name=S, mime_type=S)
MESSAGE = struct(message_id=L, chat=CHAT, text=S, caption=S, photo=PHOTO, video=VIDEO, document=DOCUMENT)
CALLBACK = struct(
    id=S, data=S, message=struct(message_id=L, chat=CHAT, reply_to_message=MESSAGE)
)
UPDATES = struct(update_id=L, event_time=T.TimestampType(), message=MESSAGE, callback_query=CALLBACK)

MESSAGES = struct(update_id=L, chat_id=L, text=S, reply_to_message_id=L)
REQUESTS = struct(
    doc_id=S, update_id=L, chat_id=L, reply_to=L, type=S, file_id=S, file_name=S, mime=S, bank=S, statement_mode=S,
    claim=CLAIM, provided_info=S,
)
FAILURES = struct(update_id=L, chat_id=L, error=S, record=S)
DUPLICATES = struct(update_id=L)
# what could not be read or processed, of all sources
LEDGER = struct(source=S, record=S, error=S)

# --- chain records ----------------------------------------------------------------------

TOKEN = struct(
    name=S, symbol=S, contract_name=S, contract_address=S, issue_address=S, decimals=I, total_supply=S,
    holders_count=L, transfer_num=L, transfer24h=L, market_info=struct(priceInUsd=D, liquidity=D),
    market_cap_usd=D,
)
TOKENS = struct(address=S, trc20_tokens=T.ArrayType(TOKEN))
# security and account records keep JSON null apart from a missing key, hence variants
RECORDS = struct(address=S, v=T.VariantType())
TRANSFERS = struct(
    address=S, transaction_id=S, transactionHash=S, from_address=S, fromAddress=S, to_address=S, toAddress=S,
    tokenInfo=struct(tokenAbbr=S), tokenAbbr=S, quant=S, amount=S, block_ts=L, timestamp=L,
)

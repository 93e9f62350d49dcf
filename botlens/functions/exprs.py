"""Scalar column functions, all built-in expressions.

Nothing here is a Python UDF: each helper returns a Catalyst ``Column`` so
it stays inside whole-stage codegen.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: these must equal the reference's for right results -------
ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"          # Date.toISOString()
TOKEN_SHAPE = r"^\d{6,}:[A-Za-z0-9_-]{20,}\z"          # likely platform token
MESSAGE_DESC = r"^Message received from (.+)\z"
PAYMENT_DESC = r"^Payment of ([\d.]+) ([A-Z]+)\z"
JOINED_DESC = r"^User (.+) joined\z"
GENERIC_BOT_NAME = "Telegram Bot"
# --- end of fixed values -------------------------------------------------------

# JavaScript String.prototype.trim removes WhiteSpace (TAB, VT, FF, SP, NBSP,
# BOM and the Zs category) and LineTerminators (LF, CR, LS, PS).
_JS_SPACE = ("\t\n\u000b\f\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
             + "\u2028\u2029\u202f\u205f\u3000\ufeff")


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c) -> Column:
    """trim like JavaScript (Unicode spaces and U+FEFF), no regex."""
    return F.btrim(col_(c), F.lit(_JS_SPACE))


def utf16_length(c) -> Column:
    """string length in UTF-16 code units (an emoji counts 2).

    ASCII text (byte length = character length) skips the re-encoding."""
    s = col_(c)
    return F.when(F.octet_length(s) == F.length(s), F.length(s)) \
            .otherwise((F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int"))


def normalize_username(c) -> Column:
    """drop one leading '@', trim, lower-case."""
    return F.lower(js_trim(F.regexp_replace(col_(c), "^@", "")))


def display_name(display, bot_type, identifier) -> Column:
    """stored name, else '@identifier' for username bots, else generic."""
    return F.coalesce(
        col_(display),
        F.when(col_(bot_type) == "username", F.concat(F.lit("@"), col_(identifier)))
         .otherwise(F.lit(GENERIC_BOT_NAME)))


def is_token_shaped(c) -> Column:
    """platform token shape check."""
    return col_(c).rlike(TOKEN_SHAPE)


def iso_text(c) -> Column:
    """timestamp to ISO-8601 UTC text with milliseconds."""
    return F.date_format(col_(c), ISO_MILLIS)


def date_text(c) -> Column:
    """date to YYYY-MM-DD."""
    return F.date_format(col_(c), "yyyy-MM-dd")


def json_string(c) -> Column:
    """A JSON string literal for ``c`` (quotes and escapes), or null."""
    return F.regexp_extract(F.to_json(F.array(col_(c))), r"^\[(.*)\]$", 1)


def js_number_text(c) -> Column:
    """Decimal text the way JavaScript prints the number (12.30 -> 12.3)."""
    txt = col_(c).cast("decimal(38,6)").cast("string")
    return F.regexp_replace(txt, r"\.?0+$", "")


def pct_change(current, previous) -> Column:
    """percent change rounded half-up to 2 places, exact in integers.

    previous = 0 gives 0 when current = 0 else 100.
    """
    cur, prev = col_(current).cast("long"), col_(previous).cast("long")
    diff = cur - prev
    num = F.abs(diff) * F.lit(20000) + prev
    den = prev * F.lit(2)
    quotient = ((num - F.pmod(num, den)).cast("decimal(38,0)")
                / den.cast("decimal(38,0)")).cast("long")
    cents = F.when(prev == 0, F.when(cur == 0, F.lit(0)).otherwise(F.lit(10000))) \
             .otherwise(F.signum(diff).cast("long") * quotient)
    return (cents.cast("decimal(20,0)") / F.lit(100)).cast("decimal(18,2)")


def round_money(c) -> Column:
    """F16: round to 2 places (HALF_UP on the decimal value)."""
    return F.round(col_(c), 2)


def _pads(secret: str) -> tuple[str, str]:
    key = secret.encode("utf-8")
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\x00")
    ipad = bytes(b ^ 0x36 for b in key).hex()
    opad = bytes(b ^ 0x5C for b in key).hex()
    return ipad, opad


def hmac_sha256_hex(c, secret: str) -> Column:
    """HMAC-SHA256 hex digest of a string column (RFC 2104).

    The key pads are computed once on the driver; the digest is two
    built-in ``sha2`` calls, so it runs in codegen on the executors.
    """
    ipad, opad = _pads(secret)
    inner = F.unhex(F.sha2(F.concat(F.unhex(F.lit(ipad)), F.encode(col_(c), "UTF-8")), 256))
    return F.sha2(F.concat(F.unhex(F.lit(opad)), inner), 256)


def activity_fallback(event_type, description):
    """(event_code, params JSON) for rows stored without a code."""
    et, desc = col_(event_type), col_(description)
    msg_user = F.regexp_extract(desc, MESSAGE_DESC, 1)
    joined_user = F.regexp_extract(desc, JOINED_DESC, 1)
    pay_amount = F.regexp_extract(desc, PAYMENT_DESC, 1)
    pay_currency = F.regexp_extract(desc, PAYMENT_DESC, 2)
    amount_ok = pay_amount.rlike(r"^(\d+\.?\d*|\.\d+)$")
    amount_json = F.when(amount_ok, js_number_text(pay_amount)).otherwise(F.lit("null"))
    code = (F.when(et == "message", F.lit("message.received"))
             .when(et == "payment", F.lit("payment.received"))
             .when(et == "user_joined", F.lit("user.joined"))
             .otherwise(et))
    params = (
        F.when((et == "message") & desc.rlike(MESSAGE_DESC),
               F.concat(F.lit('{"user":'), json_string(msg_user), F.lit("}")))
         .when((et == "payment") & desc.rlike(PAYMENT_DESC),
               F.concat(F.lit('{"amount":'), amount_json, F.lit(',"currency":'),
                        json_string(pay_currency), F.lit("}")))
         .when((et == "user_joined") & desc.rlike(JOINED_DESC),
               F.concat(F.lit('{"user":'), json_string(joined_user), F.lit("}")))
         .otherwise(F.lit("{}")))
    return code, params


def series_json(arr) -> Column:
    """Render array<struct<date, value>> as the reference's JSON series text."""
    items = F.transform(
        col_(arr),
        lambda x: F.concat(F.lit('{"date":"'), x["date"], F.lit('","value":'),
                           js_number_text(x["value"]), F.lit("}")))
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))

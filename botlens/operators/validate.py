"""Ordered validation rule tables for raw JSON bodies.

A body is parsed once into a VARIANT; every rule is a boolean column and
the first failing rule (in the reference's check order) is reported as
(error_code, error_field, error_detail).  One pass, no UDF, no union per
event kind: the rule list is chosen per row by the ``kind`` column.

Two tiers give the typed fields.  A body that matches a strict pattern of its
kind (whole, plain JSON; every known field of the type that the rules want) is
read by ``from_json`` with the declared schema.  Only the others go through
VARIANT, which tells types apart; for clean bodies that side sees null and costs
next to nothing, so one pass over the rows does both.

JSON.parse semantics kept: trailing text is invalid, a duplicated key keeps
its last value, ``null`` bodies are not objects.  Spark's ``parse_json``
accepts trailing text, so the body is parsed wrapped in an array with an
end marker.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from botlens.functions import exprs as X
from botlens.functions.dates import parse_js_date
from botlens.schemas import BILLING_PROVIDERS, BOT_TYPES, PLANS, SUBSCRIPTION_STATUSES

NUMERIC_TYPE = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"

# --- fixed values: these must equal the reference's for right results -------
E_VALIDATION = "VALIDATION_ERROR"
E_JSON = "INVALID_JSON"
E_INTERNAL = "INTERNAL_ERROR"
MSG_STRING = "must be a string"
MSG_EMPTY = "must not be empty"
MSG_MAX = "must be at most {n} characters"
MSG_NUMBER = "must be a valid number"
MSG_NONNEG = "must be greater than or equal to 0"
MSG_BOT_TYPE = 'must be "token" or "username"'
MSG_USER = "is required"
MSG_PROVIDER = 'must be "manual", "stripe", or "click"'
MSG_PLAN = 'must be "starter" or "growth"'
MSG_STATUS = "must be a valid subscription status"
MSG_BODY = "Request body is required"
MSG_DATE = "must be a valid ISO date string"
# --- end of fixed values -------------------------------------------------------


@dataclass
class Rule:
    field: str
    fails: Column
    detail: str
    code: str = E_VALIDATION


def parse_body(body: Column) -> tuple[Column, Column]:
    """(variant of the body or null, JSON-valid flag).

    The body is parsed as the first of exactly two elements, the second being
    its own digest, which no body can hold: text after the value, a second
    value or an early closing bracket leave another number of elements.
    """
    end = F.md5(body)
    wrapped = F.try_parse_json(F.concat(F.lit("["), body, F.lit(',"'), end, F.lit('"]')))
    ok = F.coalesce((F.try_variant_get(wrapped, "$[1]", "string") == end)
                    & F.variant_get(wrapped, "$[2]", "variant").isNull(), F.lit(False))
    return F.when(ok, F.variant_get(wrapped, "$[0]", "variant")), ok


@dataclass
class Shape:
    """The known fields of a body by the JSON type that its rules accept.

    ``nullable`` strings may be null, which means the same as absent; ``objects``
    maps a field to the shape of its object.
    """
    strings: list[str]
    nullable: list[str]
    numbers: list[str]
    objects: dict[str, Shape]

    def names(self) -> list[str]:
        return [*self.strings, *self.nullable, *self.numbers, *self.objects]

    def schema(self) -> str:
        plain = [f"`{n}`:string" for n in (*self.strings, *self.nullable, *self.numbers)]
        return "struct<" + ",".join(plain + [f"`{n}`:{s.schema()}" for n, s in self.objects.items()]) + ">"

    def pattern(self) -> str:
        """Java pattern of one object: quantifiers are possessive or bounded, so a match
        needs no backtracking and its depth has a limit; what exceeds it takes the other tier."""
        plain = r'[^"\\\x00-\x1F]*+'
        string = rf'"{plain}(?:\\["\\/bfnrt]{plain}){{0,200}}+"'
        number = r"-?(?:0|[1-9][0-9]{0,17}+)(?:\.[0-9]{1,15}+)?+"
        ws = r"[ \t\r\n]*+"
        any_of = lambda names: '"(?:' + "|".join(names) + ')"'
        members = []
        if self.strings:
            members.append(f"{any_of(self.strings)}{ws}:{ws}{string}")
        if self.nullable:
            members.append(f"{any_of(self.nullable)}{ws}:{ws}(?:{string}|null)")
        if self.numbers:
            members.append(f"{any_of(self.numbers)}{ws}:{ws}{number}")
        members += [f'"{n}"{ws}:{ws}{s.pattern()}' for n, s in self.objects.items()]
        # other names have no escapes, so none of them is a known one in disguise
        members.append(f'(?!{any_of(self.names())})"{plain}"{ws}:{ws}(?:{string}|{number}|true|false|null)')
        member = "(?:" + "|".join(members) + ")"
        return rf"\{{{ws}(?:{member}{ws}(?:,{ws}{member}{ws}){{0,40}}+)?+\}}"


CLEAN_BYTES = 32_768               # longer bodies are judged by the VARIANT tier


def clean_body(body: Column, shape: Shape) -> Column:
    ws = r"[ \t\r\n]*+"
    return F.coalesce((F.octet_length(body) <= CLEAN_BYTES) & body.rlike(rf"^{ws}{shape.pattern()}{ws}\z"), F.lit(False))


def parse_bodies(raw: DataFrame, body_col: str, shape: Shape) -> DataFrame:
    """Adds ``_clean``, the typed fields ``_j`` of clean bodies, and of the others the
    VARIANT ``_v``, its type ``_v_t`` and ``_json_ok``."""
    body = F.col(body_col)
    out = raw.select("*", clean_body(body, shape).alias("_clean"))
    v, ok = parse_body(F.when(~F.col("_clean"), body))
    out = out.select("*", F.from_json(F.when(F.col("_clean"), body), shape.schema()).alias("_j"),
                     v.alias("_v"), (F.col("_clean") | ok).alias("_json_ok"))
    return out.select("*", F.schema_of_variant("_v").alias("_v_t"))


def gated(err: Column) -> Column:
    """Reference the ``_task`` barrier so column pruning keeps it."""
    return F.when(F.col("_task") >= 0, err)


def first_failure(rules: list[Rule]) -> Column:
    """struct(code, field, detail) of the first failing rule, else null.

    The rules yield the 1-based index of the first failure (small generated
    code); the error triple is looked up in one literal array whose extra
    last slot is a null struct.  The index is never NULL: Spark 4.1's
    generated code for ``element_at`` returns the LAST element for a NULL
    index computed by an expression.
    """
    n = len(rules)
    idx = F.coalesce(*[F.when(F.coalesce(r.fails, F.lit(False)), F.lit(i + 1))
                       for i, r in enumerate(rules)], F.lit(n + 1))
    structs = [F.struct(F.lit(r.code).alias("code"), F.lit(r.field).alias("field"),
                        F.lit(r.detail).alias("detail")) for r in rules]
    none = F.lit(None).cast("struct<code:string,field:string,detail:string>")
    return F.element_at(F.array(*structs, none), idx)


def _slot(field: str) -> str:
    return "_" + field.replace(".", "_")


def extract(df: DataFrame, v: str, fields: list[str], shape: Shape) -> DataFrame:
    """Materialise per JSON field: type name, trimmed text, UTF-16 length,
    from the typed fields of clean bodies and from the VARIANT of the others.

    Each field is looked up once; the rules then reference plain columns,
    which keeps the generated code small (the optimizer does not inline an
    expensive alias that is referenced several times).
    """
    # one pass over an object for all its fields: the body's, then the nested objects'
    tops = list(dict.fromkeys(f.split(".")[0] for f in fields))
    parts: dict[str, list[str]] = {}
    for f in fields:
        if "." in f:
            parts.setdefault(f.split(".")[0], []).append(f.split(".")[1])

    def fields_of(source: Column, names: list[str]) -> Column:
        return F.try_variant_get(source, "$", "struct<" + ",".join(f"`{n}`:variant" for n in names) + ">")

    out = df.select("*", fields_of(F.col(v), tops).alias("_top"))
    out = out.select("*", *[fields_of(F.col(f"_top.{p}"), names).alias(f"_in_{p}") for p, names in parts.items()])
    subs = [F.col(f"_in_{f.split('.')[0]}.{f.split('.')[1]}" if "." in f else f"_top.{f}").alias(_slot(f) + "_v")
            for f in fields]
    # ``_task`` (nondeterministic) is an optimizer barrier: a later filter on
    # the error columns is not pushed below this projection, which would
    # inline every JSON extraction into the predicate (hundreds of copies).
    out = out.select(*df.columns, *subs, F.spark_partition_id().alias("_task"))
    cols = []
    for f in fields:
        sub, typed = F.col(_slot(f) + "_v"), F.col(f"_j.{f}")
        if f in shape.objects:
            cols.append(F.when(F.col("_clean"), F.when(typed.isNotNull(), "OBJECT"))
                         .otherwise(F.schema_of_variant(sub)).alias(_slot(f) + "_t"))
            cols.append(F.lit(None).cast("string").alias(_slot(f) + "_s"))     # no rule reads an object's text
            continue
        known = "DECIMAL" if f in shape.numbers else "STRING"
        cols.append(F.when(F.col("_clean"), F.when(typed.isNotNull(), known))
                     .otherwise(F.schema_of_variant(sub)).alias(_slot(f) + "_t"))
        cols.append(X.js_trim(F.when(F.col("_clean"), typed).otherwise(F.variant_get(sub, "$", "string"))).alias(_slot(f) + "_s"))
    out = out.select("*", *cols)
    return out.select("*", *[X.utf16_length(F.col(_slot(f) + "_s")).alias(_slot(f) + "_n")
                             for f in fields])


class Fields:
    """Column accessors over the materialised slots."""

    def typ(self, f: str) -> Column:
        return F.col(_slot(f) + "_t")

    def text(self, f: str) -> Column:
        return F.col(_slot(f) + "_s")

    def length(self, f: str) -> Column:
        return F.col(_slot(f) + "_n")

    def absent(self, f: str) -> Column:
        return self.typ(f).isNull()

    def nullish(self, f: str) -> Column:             # undefined or JSON null
        return self.absent(f) | (self.typ(f) == "VOID")

    def is_string(self, f: str) -> Column:
        return F.coalesce(self.typ(f) == "STRING", F.lit(False))

    def is_number(self, f: str) -> Column:
        return F.coalesce(self.typ(f).rlike(NUMERIC_TYPE), F.lit(False))

    def is_object(self, f: str) -> Column:           # JS typeof === "object"
        return F.coalesce(self.typ(f).rlike("^(OBJECT|ARRAY)"), F.lit(False))

    def opt_text(self, f: str) -> Column:
        return F.when(~self.nullish(f), self.text(f))


def string_rules(b: Fields, f: str, max_len: int, allow_empty=False,
                 skip: Column | None = None, field: str | None = None) -> list[Rule]:
    """requireString(value, field, {maxLength, allowEmpty}); ``skip`` is the
    condition under which the check does not apply."""
    name = field or f
    skip = skip if skip is not None else F.lit(False)
    rules = [Rule(name, ~skip & ~b.is_string(f), MSG_STRING)]
    if not allow_empty:
        rules.append(Rule(name, ~skip & (b.length(f) == 0), MSG_EMPTY))
    rules.append(Rule(name, ~skip & (b.length(f) > max_len), MSG_MAX.format(n=max_len)))
    return rules


def _opt_string(b: Fields, f: str, max_len: int, when: Column | None = None) -> list[Rule]:
    skip = b.nullish(f) if when is None else (b.nullish(f) | ~when)
    return string_rules(b, f, max_len, skip=skip)


def _body_rules(body: Column, json_ok: Column, vtype: Column) -> list[Rule]:
    missing = body.isNull() | (body == "")
    return [
        Rule("body", missing, MSG_BODY),
        Rule("body", ~json_ok, "Invalid JSON body", E_JSON),
        Rule("body", vtype == "VOID", "body is null", E_INTERNAL),
    ]


API_SHAPE = Shape(strings=["botType", "botValue", "currency", "createdAt"], nullable=["text"], numbers=["amount"],
                  objects={"user": Shape(["telegramId"], ["username", "firstName", "lastName"], [], {})})
API_FIELDS = ["botType", "botValue", "user", "user.telegramId", "user.username",
              "user.firstName", "user.lastName", "text", "amount", "currency", "createdAt"]


def api_event_rules(b: Fields, kind: Column) -> list[Rule]:
    """I1-I3 as one ordered list; kind-specific rules are guarded."""
    is_msg, is_pay = kind == "message", kind == "payment"
    return (string_rules(b, "botType", 20) + string_rules(b, "botValue", 512)
            + [Rule("botType", ~b.text("botType").isin(BOT_TYPES), MSG_BOT_TYPE),
               Rule("user", ~b.is_object("user"), MSG_USER)]
            + string_rules(b, "user.telegramId", 64)
            + _opt_string(b, "user.username", 255)
            + _opt_string(b, "user.firstName", 255)
            + _opt_string(b, "user.lastName", 255)
            + string_rules(b, "text", 4000, allow_empty=True, skip=b.nullish("text") | ~is_msg)
            + [Rule("amount", is_pay & ~b.is_number("amount"), MSG_NUMBER),
               Rule("amount", is_pay & b.is_number("amount") & (b.text("amount").try_cast("double") < 0), MSG_NONNEG)]
            + string_rules(b, "currency", 8, skip=~is_pay)
            # only an absent createdAt is optional; JSON null is an error
            + string_rules(b, "createdAt", 64, skip=b.absent("createdAt")))


ERROR_COLS = ["error_code", "error_field", "error_detail"]


def _with_errors(checked: DataFrame, keep: list[Column]) -> DataFrame:
    return checked.select(*keep, F.col("_err.code").alias("error_code"),
                          F.col("_err.field").alias("error_field"),
                          F.col("_err.detail").alias("error_detail"))


def split_checked(checked: DataFrame, raw_cols: list[str]):
    """(valid rows without error columns, rejected raw rows with errors)."""
    valid = checked.filter(F.col("error_code").isNull()).drop(*ERROR_COLS)
    rejected = checked.filter(F.col("error_code").isNotNull()).select(*raw_cols, *ERROR_COLS)
    return valid, rejected


def check_api_events(raw: DataFrame, body_col: str = "body", kind_col: str = "kind") -> DataFrame:
    """I1-I3 in one pass: every input column, the trimmed typed fields and
    error_code / error_field / error_detail (null when the body is valid)."""
    ex = extract(parse_bodies(raw, body_col, API_SHAPE), "_v", API_FIELDS, API_SHAPE)
    b, kind = Fields(), F.col(kind_col)
    err = gated(first_failure(_body_rules(F.col(body_col), F.col("_json_ok"), F.col("_v_t"))
                              + api_event_rules(b, kind)))
    checked = ex.withColumn("_err", err)
    return _with_errors(checked, [
        *[F.col(c) for c in raw.columns],
        b.text("botType").alias("bot_type"), b.text("botValue").alias("bot_value"),
        b.text("user.telegramId").alias("telegram_id"),
        b.opt_text("user.username").alias("username"),
        b.opt_text("user.firstName").alias("first_name"),
        b.opt_text("user.lastName").alias("last_name"),
        F.when(kind == "message", b.opt_text("text")).alias("text"),
        F.when(kind == "payment", b.text("amount").try_cast("decimal(12,2)")).alias("amount"),
        F.when(kind == "payment", F.upper(b.text("currency"))).alias("currency"),
        F.when(~b.absent("createdAt"), b.text("createdAt")).alias("created_at_text")])


def validate_api_events(raw: DataFrame, body_col: str = "body", kind_col: str = "kind"):
    """Validate message / user_joined / payment bodies.

    Returns (valid, rejected).  ``valid`` carries the trimmed typed fields
    (without the body); ``rejected`` keeps every input column plus
    error_code/field/detail.  Date parsing and numeric overflow are checked
    later (after bot resolution), as in the reference.
    """
    valid, rejected = split_checked(check_api_events(raw, body_col, kind_col), raw.columns)
    return valid.drop(body_col), rejected


def parse_event_time(text: Column, received_at: Column) -> Column:
    """absent -> received time; a text that names a date -> timestamp; else null."""
    return F.when(text.isNull(), received_at).otherwise(parse_js_date(text))


BILLING_SHAPE = Shape(strings=["provider", "type", "plan", "status", "providerEventId", "accountId"],
                      nullable=["providerCustomerId", "providerSubscriptionId", "currency", "currentPeriodStart",
                                "currentPeriodEnd"], numbers=["amount"], objects={})
BILLING_FIELDS = ["provider", "type", "plan", "status", "providerEventId", "accountId",
                  "providerCustomerId", "providerSubscriptionId", "amount", "currency",
                  "currentPeriodStart", "currentPeriodEnd"]


def billing_rules(b: Fields) -> list[Rule]:
    """I14 in the reference's order."""
    low = lambda f: F.lower(b.text(f))
    return (string_rules(b, "provider", 20) + string_rules(b, "type", 64)
            + string_rules(b, "plan", 20) + string_rules(b, "status", 20)
            + [Rule("provider", ~low("provider").isin(BILLING_PROVIDERS), MSG_PROVIDER),
               Rule("plan", ~low("plan").isin(PLANS), MSG_PLAN),
               Rule("status", ~low("status").isin(SUBSCRIPTION_STATUSES), MSG_STATUS)]
            + string_rules(b, "providerEventId", 255)
            + string_rules(b, "accountId", 64)
            + _opt_string(b, "providerCustomerId", 255)
            + _opt_string(b, "providerSubscriptionId", 255)
            + [Rule("amount", ~b.nullish("amount") & ~b.is_number("amount"), MSG_NUMBER)]
            + _opt_string(b, "currency", 8)
            + _opt_string(b, "currentPeriodStart", 64)
            + _opt_string(b, "currentPeriodEnd", 64))


def check_billing_events(raw: DataFrame, body_col: str = "body") -> DataFrame:
    """I14 in one pass: input columns, typed fields, error columns."""
    ex = extract(parse_bodies(raw, body_col, BILLING_SHAPE), "_v", BILLING_FIELDS, BILLING_SHAPE)
    b = Fields()
    err = gated(first_failure(_body_rules(F.col(body_col), F.col("_json_ok"), F.col("_v_t"))
                              + billing_rules(b)))
    checked = ex.withColumn("_err", err)
    has_amount = ~b.nullish("amount")
    return _with_errors(checked, [
        *[F.col(c) for c in raw.columns],
        F.lower(b.text("provider")).alias("provider"), b.text("type").alias("event_type"),
        F.lower(b.text("plan")).alias("plan"), F.lower(b.text("status")).alias("status"),
        b.text("providerEventId").alias("provider_event_id"),
        b.text("accountId").alias("account_id"),
        b.opt_text("providerCustomerId").alias("provider_customer_id"),
        b.opt_text("providerSubscriptionId").alias("provider_subscription_id"),
        F.when(has_amount, b.text("amount").try_cast("decimal(12,2)")).alias("amount"),
        F.when(has_amount, b.text("amount").try_cast("double")).alias("amount_raw"),
        F.upper(b.opt_text("currency")).alias("currency"),
        b.opt_text("currentPeriodStart").alias("period_start_text"),
        b.opt_text("currentPeriodEnd").alias("period_end_text"),
        _billing_payload(b).alias("payload")])


def _billing_payload(b: Fields) -> Column:
    """The stored payload: the validated input (trimmed, cases normalised, known
    fields only) as JSON text, keys in the order PostgreSQL's jsonb keeps them
    (shorter first, then by bytes).  An absent amount has no key, other absent
    optional fields are null."""
    text = lambda f: F.coalesce(X.json_string(b.opt_text(f)), F.lit("null"))
    parts = {
        "plan": X.json_string(F.lower(b.text("plan"))), "type": X.json_string(b.text("type")),
        "amount": F.when(b.is_number("amount"), X.js_number_text(b.text("amount").try_cast("decimal(38,6)"))),
        "status": X.json_string(F.lower(b.text("status"))),
        "currency": F.coalesce(X.json_string(F.upper(b.opt_text("currency"))), F.lit("null")),
        "provider": X.json_string(F.lower(b.text("provider"))), "accountId": X.json_string(b.text("accountId")),
        "providerEventId": X.json_string(b.text("providerEventId")),
        "currentPeriodEnd": text("currentPeriodEnd"), "currentPeriodStart": text("currentPeriodStart"),
        "providerCustomerId": text("providerCustomerId"),
        "providerSubscriptionId": text("providerSubscriptionId")}
    return F.concat(F.lit("{"), F.concat_ws(",", *[
        F.concat(F.lit(f'"{k}":'), v) for k, v in parts.items()]), F.lit("}"))


def validate_billing_events(raw: DataFrame, body_col: str = "body"):
    """Validate billing webhook bodies -> (valid, rejected)."""
    return split_checked(check_billing_events(raw, body_col), raw.columns)

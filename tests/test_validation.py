"""One row per failing rule, and rule order (FIXTURES.md §2)."""

import pytest

from botlens.operators.validate import validate_api_events, validate_billing_events

OK_USER = '{"telegramId":"42"}'
HEAD = '"botType":"username","botValue":"@bot"'

CASES = [
    ("message", "not json", "INVALID_JSON", "body"),
    ("message", '{' + HEAD + ',"user":' + OK_USER + '} x', "INVALID_JSON", "body"),
    ("message", "", "VALIDATION_ERROR", "body"),
    ("message", "null", "INTERNAL_ERROR", "body"),
    ("message", '{"botValue":"x","user":' + OK_USER + '}', "VALIDATION_ERROR", "botType"),
    ("message", '{"botType":5,"botValue":"x"}', "VALIDATION_ERROR", "botType"),
    ("message", '{"botType":"email","botValue":"x","user":' + OK_USER + '}', "VALIDATION_ERROR", "botType"),
    ("message", '{"botType":"username","botValue":"   "}', "VALIDATION_ERROR", "botValue"),
    ("message", '{"botType":"username","botValue":"' + "v" * 513 + '"}', "VALIDATION_ERROR", "botValue"),
    ("message", '{' + HEAD + '}', "VALIDATION_ERROR", "user"),
    ("message", '{' + HEAD + ',"user":[1]}', "VALIDATION_ERROR", "user.telegramId"),
    ("message", '{' + HEAD + ',"user":{"telegramId":42}}', "VALIDATION_ERROR", "user.telegramId"),
    ("message", '{' + HEAD + ',"user":{"telegramId":"1","username":"' + "n" * 256 + '"}}',
     "VALIDATION_ERROR", "user.username"),
    ("message", '{' + HEAD + ',"user":' + OK_USER + ',"text":"' + "t" * 4001 + '"}', "VALIDATION_ERROR", "text"),
    ("message", '{' + HEAD + ',"user":' + OK_USER + ',"text":5}', "VALIDATION_ERROR", "text"),
    ("message", '{' + HEAD + ',"user":' + OK_USER + ',"createdAt":null}', "VALIDATION_ERROR", "createdAt"),
    ("message", '{' + HEAD + ',"user":' + OK_USER + ',"createdAt":"  "}', "VALIDATION_ERROR", "createdAt"),
    ("payment", '{' + HEAD + ',"user":' + OK_USER + ',"amount":"3","currency":"usd"}', "VALIDATION_ERROR", "amount"),
    ("payment", '{' + HEAD + ',"user":' + OK_USER + ',"amount":-1,"currency":"usd"}', "VALIDATION_ERROR", "amount"),
    ("payment", '{' + HEAD + ',"user":' + OK_USER + ',"amount":1,"currency":"ABCDEFGHI"}',
     "VALIDATION_ERROR", "currency"),
    # two faults: the first in rule order wins
    ("message", '{"botType":"email","botValue":"","user":5}', "VALIDATION_ERROR", "botValue"),
]

VALID = [
    ("message", '{' + HEAD + ',"user":' + OK_USER + ',"text":""}'),
    ("message", '{' + HEAD + ',"user":' + OK_USER + '}'),
    ("message", '{"botType":"username","botType":"token","botValue":"1","user":' + OK_USER + '}'),
    ("user_joined", '{' + HEAD + ',"user":' + OK_USER + ',"text":5}'),
    ("payment", '{' + HEAD + ',"user":' + OK_USER + ',"amount":1e11,"currency":" usd "}'),
]


def _raw(spark, rows):
    return spark.createDataFrame([(k, b, i) for i, (k, b) in enumerate(rows)],
                                 "kind string, body string, ingest_seq long")


def test_rejections(spark):
    valid, rejected = validate_api_events(_raw(spark, [(k, b) for k, b, _, _ in CASES]))
    got = {r.ingest_seq: (r.error_code, r.error_field) for r in rejected.collect()}
    assert valid.count() == 0
    for i, (_, _, code, field) in enumerate(CASES):
        assert got[i] == (code, field), (i, CASES[i][1][:60], got[i])


def test_valid_bodies(spark):
    valid, rejected = validate_api_events(_raw(spark, VALID))
    assert rejected.count() == 0
    rows = {r.ingest_seq: r for r in valid.collect()}
    assert rows[0].text == "" and rows[1].created_at_text is None
    assert rows[2].bot_type == "token"                 # duplicate key: last wins
    assert rows[4].currency == "USD" and rows[4].amount is None   # overflow is checked later


def test_billing_rules(spark):
    ok = ('{"provider":"Stripe","type":"x","providerEventId":"e1","accountId":"1","plan":"Growth",'
          '"status":"ACTIVE"}')
    bad = [('{"provider":"paypal","type":"x","plan":"growth","status":"active"}', "provider"),
           ('{"provider":"stripe","type":"x","plan":"gold","status":"active"}', "plan"),
           ('{"provider":"stripe","type":"x","plan":"growth","status":"active","providerEventId":"e",'
            '"accountId":"1","amount":"5"}', "amount")]
    raw = spark.createDataFrame([(ok, 0)] + [(b, i + 1) for i, (b, _) in enumerate(bad)],
                                "body string, ingest_seq long")
    valid, rejected = validate_billing_events(raw)
    v = valid.collect()
    assert len(v) == 1 and (v[0].provider, v[0].plan, v[0].status) == ("stripe", "growth", "active")
    got = {r.ingest_seq: r.error_field for r in rejected.collect()}
    assert got == {i + 1: f for i, (_, f) in enumerate(bad)}


def _bodies(seed, n):
    """Bodies from plain to broken: odd spacing, escapes, repeated and unknown names, wrong types, cut texts."""
    import json
    import random
    rng = random.Random(seed)
    texts = ["", " x ", "@Bot", "é😀", "a\"b\\c\n", "n" * 300, "t" * 4001, " ", "{\"k\": 1}", "username", "token", "usd", "12",
             "2024-01-01T00:00:00Z", "/", "\x7f"]
    value = lambda: rng.choice([rng.choice(texts)] * 6 + [None, 5, -1, 2.5, 1e11, 1e400, True, [1], {}, {"telegramId": "1"}])
    out = []
    for _ in range(n):
        body = {"botType": rng.choice(["username", "token", "email"]), "botValue": rng.choice(texts),
                "user": {"telegramId": rng.choice(texts)}, "text": rng.choice(texts),
                "amount": rng.choice([1, 0, -3, 2.375, 12345678901, 0.005, 1e400]), "currency": rng.choice(["usd", " eur "])}
        for where in (body, body["user"]):
            for name in rng.sample(["username", "firstName", "text", "amount", "createdAt", "user", "botType", "extra", "b"], 2):
                if rng.random() < 0.4:
                    where[name] = value()
        text = json.dumps(body, ensure_ascii=rng.random() < 0.3, indent=rng.choice([None, None, 1]))
        text = text.replace("Infinity", "1e400")
        if rng.random() < 0.2:
            text = text[:-1] + ',"botType":"token"' * rng.randrange(1, 4) + rng.choice(["}", ',"text":null}', ',"user":{}}'])
        if rng.random() < 0.15:
            text = rng.choice([text + " ", text + "x", text[:-1], " " + text, text.replace('"', "'"), text.replace(":", "::", 1),
                               text.replace('"botType"', '"bot\\u0054ype"'), text.replace(",", ",,", 1), text + "\n{}",
                               text.replace('"amount": ', '"amount": 0'), text.replace('"amount": ', '"amount": +')])
        out.append((rng.choice(["message", "payment", "user_joined"]), text))
    return out + [("message", None), ("message", "{}"), ("message", "[]"), ("payment", "{" + " " * 50_000 + "}"),
                  ("message", '{' + HEAD + ',"user":' + OK_USER + ',"text":"' + "\\n" * 30_000 + '"}'),
                  ("message", '{' + HEAD + ',"user":' + OK_USER + "".join(f',"k{i}":{i}' for i in range(500)) + '}')]


def test_both_tiers_agree(spark, monkeypatch):
    from botlens.operators import validate as V
    raw = _raw(spark, _bodies(11, 3000)).cache()
    shape = V.API_SHAPE
    clean = raw.filter(V.clean_body(raw.body, shape)).count()
    assert 800 < clean < 2200
    def run():
        got = V.check_api_events(raw).collect()
        return sorted((tuple(r) for r in got), key=repr)
    both = run()
    monkeypatch.setattr(V, "CLEAN_BYTES", -1)
    assert raw.filter(V.clean_body(raw.body, shape)).count() == 0
    assert both == run()

"""Tables dealt by key hash: pruned lookups, upserts of touched folders, erasure by file."""

import os
import tempfile

from botlens.operators import ingest as I
from botlens.sources import fixtures as FX
from botlens.sources import keyed as K

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_lookup_prunes_folders(spark):
    t = FX.mapping_a(spark, SF)
    path = os.path.join(tempfile.mkdtemp(prefix="botlens-keyed-"), "users")
    K.write_keyed(t.users, path, ["id"], parts=16)
    table = K.read_keyed(spark, path, t.users.schema)
    asked = spark.createDataFrame([(r.id,) for r in t.users.select("id").orderBy("id").limit(2).collect()] + [(None,), ("none",)] * 2, "id string")
    found = K.lookup(table, asked, ["id"], parts=16)
    assert "dynamicpruning" in found._jdf.queryExecution().toString()
    assert rows(found) == rows(t.users.join(asked.dropna().distinct(), "id", "left_semi").select(*found.columns))
    read = [m for m in found.select("id").collect()]
    assert len(read) == 2


def test_upsert_rewrites_only_touched_folders(spark):
    t = FX.mapping_a(spark, SF)
    path = os.path.join(tempfile.mkdtemp(prefix="botlens-keyed-"), "users")
    keys = ["bot_id", "telegram_id"]
    K.write_keyed(t.users, path, keys, parts=16)
    before = files(path)
    delta = I.merge_users(t.users.limit(2).withColumn("username", I.F.lit("new")).withColumn("last_seq", I.F.col("last_seq") + 10**9))
    touched = K.upsert(spark, path, t.users.schema, delta, keys, I.merge_users, parts=16)
    assert 1 <= len(touched) <= 2
    kept = {f for f in before if not any(f"part={p}/" in f for p in touched)}
    assert kept and kept <= files(path) and files(path) != before
    assert rows(K.read_keyed(spark, path, t.users.schema).drop("part")) == rows(I.merge_users(t.users.unionByName(delta)))
    assert K.upsert(spark, path, t.users.schema, delta.limit(0), keys, I.merge_users, parts=16) == []


def test_erasure_leaves_other_files_alone(spark):
    t = FX.mapping_a(spark, SF)
    path = os.path.join(tempfile.mkdtemp(prefix="botlens-erase-"), "messages")
    K.write_keyed(t.messages, path, ["user_id"], parts=16)
    before = files(path)
    one = t.messages.select("user_id").orderBy("user_id").limit(1)
    want = rows(t.messages.join(one, "user_id", "left_anti").select(*t.messages.columns))
    gone = t.messages.count() - len(want)
    assert K.erase(K.read_keyed(spark, path, t.messages.schema), path, one, ["user_id"]) == {"files": 1, "rows": gone}
    after = files(path)
    assert len(before - after) == 1 and len(before & after) == len(before) - 1
    assert rows(K.read_keyed(spark, path, t.messages.schema).drop("part")) == want
    none = spark.createDataFrame([("nobody",)], "user_id string")
    assert K.erase(K.read_keyed(spark, path, t.messages.schema), path, none, ["user_id"]) == {"files": 0, "rows": 0}
    assert files(path) == after

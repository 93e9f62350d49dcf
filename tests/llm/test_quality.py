import random
import re

import pytest

from botlens.llm import oracles, quality, queries
from tests.oracle_check import canon, duck

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_words int, kept boolean"


def brute_counts(text):
    text = text or ""
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)} if len(grams) < 3000 \
        else set(range(len(words)))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def rows():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(2, 8)))
    out = []
    for i in range(400):
        n = rng.choice([0, 3, 20, 60, 120, 200])
        words = [word() + rng.choice(["", "", "", ".", "\n", "\x0b"]) for _ in range(n)]
        if i % 11 == 0:
            words = [w + "###" for w in words]
        if i % 13 == 0:
            words = words[:7] * 12
        out.append((i, rng.choice([" ", "  ", "\t"]).join(words), rng.choice(["en", "de", None]), rng.choice(["a", "b", None, "hot"]),
                    1, i % 2 == 0))
    out += [(None, out[4][1], "en", "a", None, None), out[9], (900, None, None, None, 0, False), (901, "", "en", "a", 0, True),
            (902, "same word here " * 4000, "en", "hot", 0, True), (903, "x\n" * 60, "fr", "rare", 0, True)]
    return out


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("quality") / "documents.parquet")
    spark.createDataFrame(rows(), SCHEMA).write.parquet(out)
    return out


def test_counts_match_brute_force(spark, docs):
    got = quality.judge(spark.read.parquet(docs), ["doc_id"]).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    mine = sorted((repr(r.doc_id), *[r[n] for n in names], r.base_failed) for r in got)
    want = []
    for i, t, *_ in rows():
        c = brute_counts(t)
        want.append((repr(i), *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert mine == sorted(want)
    assert all(not r.kept for r in got if r.base_failed)


@pytest.mark.parametrize("group, pairs", [(200, 50_000), (5, 50_000), (5, 0)])
def test_verdicts_match_the_oracle(spark, docs, monkeypatch, group, pairs):
    """Also with fences of small groups, and with the fences shuffled instead of broadcast."""
    monkeypatch.setattr(quality, "MIN_GROUP", group)
    monkeypatch.setattr(quality, "PAIRS", pairs)
    got = quality.judge(spark.read.parquet(docs), ["doc_id"])
    con = duck(SF)
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT doc_id, text, lang, source FROM read_parquet('{docs}/*.parquet')")
    res = con.execute(oracles.quality_sql().replace("docs >= 200", f"docs >= {group}"))
    names = [d[0] for d in res.description]
    assert canon(got.columns, [tuple(r) for r in got.collect()]) == canon(names, res.fetchall())


def test_kept_rows_come_back_unchanged(spark, docs):
    df = spark.read.parquet(docs)
    kept = quality.kept(df)
    assert kept.columns == df.columns
    all_rows = [tuple(r) for r in df.collect()]
    assert all(tuple(r) in all_rows for r in kept.collect()) and kept.count() > 100
    assert quality.kept(df.limit(0)).collect() == []


def test_registered_query_is_native_and_matches(spark):
    df = queries.queries()["op1_quality_rules"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    res = duck(SF).execute(queries.oracle_sql()["op1_quality_rules"])
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon([d[0] for d in res.description], res.fetchall())

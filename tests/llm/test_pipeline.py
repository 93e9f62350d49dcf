import importlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import test_decontam, test_packing, test_secretscan, test_simhash

corpus_pipeline = importlib.import_module("corpus_pipeline")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Documents with extra columns of clashing names, and a benchmark."""
    out = tmp_path_factory.mktemp("sf")
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs += [(None, docs[3][1], None, None, None), docs[5], (9001, None, "en", "src0", None), (9002, "", None, "src1", 0),
             (9003, "word " * 60_000, "en", None, 300_000)]
    rows = [(*r, i % 3 == 0, i, f"r{i}") for i, r in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                     "kept boolean, n_words int, fp string")
    for n, name in enumerate(["_lang", "_text", "_source", "_id", "_hash", "_row", "_at", "_fp", "hash", "id", "a.b", "x`y", "c d"]):
        df = df.withColumn(name, F.lit(n))
    df.write.parquet(str(out / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(out / "benchmark.parquet"))
    return str(out)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_each_stage_against_brute_force(spark, sf):
    from botlens.llm import quality
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    steps = dict(corpus_pipeline.STAGES)

    good = steps["quality rules"](spark, docs, sf)
    verdicts = quality.judge(docs.select("doc_id", "lang", "source", "text", docs["fp"].alias("key")), ["key"])
    want = {r.key for r in verdicts.filter("kept").collect()}       # the verdicts have their own oracle
    assert good.columns == names and {r.fp for r in good.collect()} == want
    assert rows_of(good) == sorted((r for r in rows_of(docs) if r[7] in want), key=repr)

    unique = steps["near duplicates"](spark, good, sf)
    held = rows_of(good)
    classes = test_simhash.brute_components([(r[0], r[1]) for r in held], 4, 4)
    left = rows_of(unique)
    components = {(repr(i), f): c for i, f, c in classes}
    assert unique.columns == names and len(left) == len({(c, f if c is None else "") for _, f, c in classes})
    for r in left:
        fp = f"{test_simhash.brute_fp(r[1], 4):016x}"
        assert components[repr(r[0]), fp] == r[0]

    clean = steps["decontamination"](spark, unique, sf)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {i for i, _, n, _, _ in test_decontam.brute([(r[7], r[1]) for r in left], items, 10) if n}
    assert clean.columns == names and rows_of(clean) == [r for r in left if r[7] not in hit]

    safe = steps["secrets"](spark, clean, sf)
    before = {r[7]: r for r in rows_of(clean)}
    for r in safe.collect():
        old = before.pop(r.fp)
        text = old[1]
        for start, _, end in reversed(merged(test_secretscan.brute_base(text))):
            text = text[:start] + "[secret]" + text[end:]
        assert r.text == text and r.n_chars == len(text) and (r.doc_id, r.lang, r.source) == (old[0], old[2], old[3])
    assert not before

    pieces = steps["packing"](spark, safe, sf).collect()
    encode = test_packing.exact()
    ids = {r.doc_id: [*encode(r.text), 1] for r in safe.collect()}
    for p in pieces:
        own = np.array(ids[p.doc_id][p.start:p.start + p.length], "<u4")
        assert p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(own.tobytes())
    assert sum(p.length for p in pieces) == sum(map(len, ids.values()))

    whole = corpus_pipeline.run(spark, sf).collect()
    assert {(p.doc_id, p.doc_tokens) for p in whole} == {(p.doc_id, p.doc_tokens) for p in pieces}


def merged(spans):
    out = []
    for start, kind, end in spans:
        if out and start < out[-1][2]:
            out[-1] = (out[-1][0], kind, max(end, out[-1][2]))
        else:
            out.append((start, kind, end))
    return out


def test_empty_documents(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []

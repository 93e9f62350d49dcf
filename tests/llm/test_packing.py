import random
import zlib

import numpy as np

from botlens.llm import packing


def exact():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_both_libraries_give_the_same_ids():
    fast, slow, rng = packing.public_encoder(), exact(), random.Random(2)
    plain = [c for c in map(chr, range(0x100)) if packing.PLAIN.fullmatch(c)]
    pieces = plain + [" ", "  ", "\n\n", " \n", "\t ", "the", "'s", "'LL", "n't", "12", "é", "ß", "<|endoftext|>", "\xb2", "ª"]
    for _ in range(6000):
        text = "".join(rng.choices(pieces, k=rng.randrange(1, 30)))
        assert fast.ids(text) == slow(text), repr(text)
    for a in plain:                                   # every pair of characters
        for b in ("a", "\n", "  ", "9", "!", "é", a):
            assert fast.fast.encode_ordinary(a + b) == slow(a + b), repr(a + b)
    for text in (" x", "漢字 　 x", "\x85 a", "\xa0 a", "\U0001d7ce12", "\x1c\x1d"):
        assert fast.ids(text) == slow(text)


def test_round_trip(spark):
    rng, slow = random.Random(3), exact()
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "été", "12", "\n", "漢字"], k=rng.randrange(120)))) for i in range(200)]
    rows += [(None, "no id"), (7, rows[7][1]), (300, None), (301, ""), (302, "long text " * 40_000), (303, "<|endoftext|>")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    length = 64
    got = packing.pieces(docs, length, with_ids=True).collect()
    by_sequence, by_doc = {}, {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, ids))
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids))
    sizes = []
    for n in range(len(by_sequence)):                 # gapless and full, but for the last
        at = 0
        for offset, ids in sorted(by_sequence[n]):
            assert offset == at
            at += len(ids)
        sizes.append(at)
    assert set(sizes[:-1]) == {length} and 0 < sizes[-1] <= length
    want = {}
    for doc_id, text in rows:
        ids = [*slow(text), 1]
        want.setdefault((doc_id, len(ids)), []).append(ids)
    for key, docs_ids in want.items():
        found = sorted(by_doc.pop(key))
        copies = len(docs_ids)
        assert sum(len(i) for _, i in found) == copies * key[1]
        if copies == 1:
            assert [x for _, i in found for x in i] == docs_ids[0]
    assert not by_doc
    whole = {r.sequence_id: len(r.ids) for r in packing.sequences(docs, length).collect()}
    assert sorted(whole.values(), reverse=True) == sorted(sizes, reverse=True)


def test_empty_table(spark):
    assert packing.pieces(spark.createDataFrame([], "doc_id long, text string")).collect() == []

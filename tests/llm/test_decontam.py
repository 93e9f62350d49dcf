import random

import regex

from botlens.llm import decontam

WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[i:i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= got
        out.append((doc_id, len(w), len(hit), len(found), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=repr)


def run(spark, docs, items, size=10):
    got = decontam.scan(spark.createDataFrame(docs, "doc_id long, text string"),
                        spark.createDataFrame(items, "item_id long, text string"), size)
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, list(r.item_ids)) for r in got.collect()), key=repr)


def test_matches_brute_force(spark):
    rng = random.Random(5)
    text = lambda n, m=40: " ".join(f"w{rng.randrange(m)}" for _ in range(n))
    items = [(i, text(rng.choice([10, 12, 25, 40]))) for i in range(12)]
    items += [(20, "Only three words"), (21, "One"), (22, "É à seven words are in This one"), (23, ""), (24, None),
              (None, text(14)), (3, items[3][1]), (25, " ".join(["same"] * 15))]
    docs = []
    for i in range(60):
        parts = [text(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            w = words(rng.choice(items)[1])
            a = rng.randrange(len(w) + 1)
            parts += [" ".join(w[a:a + rng.choice([5, 9, 10, 11, 30])]), text(rng.randrange(15))]
        docs.append((i, rng.choice([" ", "\n", ", ", "-"]).join(parts)))
    docs += [(None, docs[1][1]), (5, docs[5][1]), (70, None), (71, ""), (72, "!?"), (73, "only THREE words; one"),
             (74, "same " * 5000), (75, text(3, 3) + " " + words(items[0][1])[0])]
    assert run(spark, docs, items) == brute(docs, items, 10)
    assert run(spark, docs, items, 7) == brute(docs, items, 7)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c")]) == []
    assert run(spark, [(1, "a b c")], []) == [(1, 3, 0, 0, [])]

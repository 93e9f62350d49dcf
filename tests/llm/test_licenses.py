import random
from collections import Counter

from botlens.llm import licenses as L


def brute(text):
    """Best Dice of every run of lines against every template, without pruning."""
    lines = [L.normalised(x) for x in (text or "").split("\n")]
    found = []
    for a in range(len(lines)):
        for b in range(a + 1, len(lines) + 1):
            if not lines[a] or not lines[b - 1]:
                continue
            words = [w for x in lines[a:b] for w in x]
            grams = Counter(zip(words, words[1:]))
            for name, template in L.TEMPLATES:
                t = L.normalised(template)
                other = Counter(zip(t, t[1:]))
                d = 2 * sum((grams & other).values()) / max(1, sum(grams.values()) + sum(other.values()))
                if d >= L.LEAST:
                    found.append((-d, b - a - 1, a, b, name))
    out, taken = [], set()
    for d, _, a, b, name in sorted(set(found)):
        if taken.isdisjoint(range(a, b)):
            taken |= set(range(a, b))
            out.append((a, b, name, -d))
    return sorted(out)


def texts():
    rng = random.Random(6)
    notices = [t for _, t in L.TEMPLATES]
    out = []
    for _ in range(120):
        lines = []
        for _ in range(rng.randrange(8)):
            if rng.random() < 0.45:
                words = rng.choice(notices).split(" ")
                if rng.random() < 0.4:
                    words[rng.randrange(len(words))] = rng.choice(["copyright", "the", ""])
                while words:
                    k = rng.choice([6, 12, 400])
                    lines.append(rng.choice(["", "  ", "# "]) + " ".join(words[:k]))
                    words = words[k:]
            else:
                lines.append(" ".join(rng.choices(["prose", "the", "license", "under", "copy", "version", ""], k=rng.randrange(12))))
        out.append("\n".join(lines))
    return out


def test_matches_unpruned_comparison(spark):
    rows = list(enumerate(texts()))
    rows += [(None, L.TEMPLATES[0][1]), (3, rows[3][1]), (200, None), (201, ""), (202, "\n\n"),
             (203, "word " * 100_000 + "\nReleased under the MIT License.\n" + "x\n" * 2000)]
    got = L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: (repr(r[0]), repr(r[1]))
    mine = sorted(((r.doc_id, [(m["first"], m["after"], m["licence"], round(m["dice"], 9)) for m in r.matches]) for r in got), key=key)
    long = (203, [(1, 2, "MIT", 1.0)])
    want = sorted([(i, [(a, b, n, round(d, 9)) for a, b, n, d in brute(t)]) for i, t in rows if i != 203] + [long], key=key)
    assert mine == want
    assert sum(len(m) for _, m in want) > 50


def test_query_and_empty_table(spark, tmp_path):
    from botlens.llm import queries
    rows = [(1, "a\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License."), (2, "no licence here"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r)[1:] for r in queries.queries()["op8_license_scans"](spark, str(tmp_path)).collect()}
    assert got == {1: (2, "CC-BY-NC-4.0", 1.0, "CC-BY-NC-4.0,MIT"), 2: (0, None, None, ""), 3: (0, None, None, "")}
    assert L.scan(df.limit(0)).collect() == []


def test_families_and_versions_are_told_apart():
    known = L.Templates(L.TEMPLATES, L.LEAST)
    for name, notice in L.TEMPLATES:
        assert {m[2:] for m in known.scan(notice)} == {(name, 1.0)}
    names = {n for n, _ in L.TEMPLATES}
    assert {"GPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "EPL-2.0", "CC0-1.0",
            "Unlicense", "Zlib", "BSL-1.0", "CC-BY-SA-3.0"} <= names


def brute_windows(text, templates, least):
    """Best Dice of every word window against every template, without pruning."""
    words, found = L.normalised(text or ""), []
    for name, template in templates:
        other = L.bigrams(L.normalised(template))
        for a in range(len(words)):
            for b in range(a + 2, len(words) + 1):
                d = L.dice(L.bigrams(words[a:b]), other)
                if d >= least:
                    found.append((-d, a - b, a, b, name))
    out, taken = [], set()
    for d, _, a, b, name in sorted(found):
        if taken.isdisjoint(range(a, b)):
            taken |= set(range(a, b))
            out.append((a, b, -d))
    return sorted(out)


def test_word_windows_match_unpruned_comparison():
    rng = random.Random(8)
    templates = [x for x in L.TEMPLATES if len(x[1].split()) <= 12][::7]
    known, some = L.Templates(templates, L.LEAST), 0
    for _ in range(40):
        words = []
        for _ in range(rng.randrange(5)):
            words += rng.choices(["the", "license", "under", "of", "word", "public", "version"], k=rng.randrange(8))
            notice = rng.choice(templates)[1].split()
            if rng.random() < 0.5:
                notice[rng.randrange(len(notice))] = rng.choice(["the", "x"])
            words += notice
        text = " ".join(words)
        want = brute_windows(text, templates, L.LEAST)
        assert [(a, b, d) for a, b, _, d in known.windows(text)] == want
        some += len(want)
    assert some > 40


def test_notices_in_mid_line_and_neighbours():
    known = L.Templates(L.TEMPLATES, L.LEAST)
    prose = "some other words that stand around the notice in a long paragraph"
    for name, notice in L.TEMPLATES:
        for text in (notice, f"{prose} {notice} {prose}", f"{prose} {notice} {prose} " * 2):
            found = known.windows(text)
            assert found and {m[2] for m in found if m[3] > 0.999} == {name}, (name, notice, found)
    assert [m[2:] for m in known.windows(f"{prose} Released under the MIT License. {prose}")] == [("MIT", 1.0)]
    assert [m[2] for m in known.windows("This work is licensed under the GNU General Public License.")] == ["GPL"]
    assert known.windows("word " * 20_000 + "of the license of the software and the " * 3000) == []

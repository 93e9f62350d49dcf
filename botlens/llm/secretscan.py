"""Secret scan by dictionary-primed compression novelty.

Fixed patterns find assignments, access keys and long hex runs.  Beyond them,
every long token in a sensitive context is measured: zstandard, primed with a
dictionary of the corpus's most frequent identifiers, compresses the text
around the token with and without it; a token whose marginal bytes stay near its
length is no name or word and is reported.  Copies of the token in that text do
not count as surroundings.

The dictionary comes from counts over all documents; its size is a parameter.
Scanning is a map over whole texts.
"""

from __future__ import annotations

import bisect
import itertools
import re

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from botlens.session import stage

from .common import frequent, words_of

# fixed values: the patterns of the contract; ``letters in either case`` means A-Z and a-z
ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")      # the runs of AKIA[A-Z0-9]+ with 20 or more characters
HEX = re.compile(r"[0-9a-f]{24,}")             # the runs of [0-9a-f]+ with 24 or more characters
ASSIGN_VALUE = 6
KINDS = ["assign", "access", "hex", "novel"]

TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
MIXED = re.compile(r"(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}")      # with digit and letter
SENSITIVE = re.compile(r"passw|passphrase|pwd|secret|token|api.?key|access.?key|private.?key|credential|"
                       r"bearer|authorization", re.I | re.A)
BEFORE = 48            # characters before a token in which a sensitive word must stand
GAP = re.compile(r"[\W_]*(?:[0-9]{1,3}[.)][\W_]*)?")      # between a reported token and the next: punctuation, a list's number
TAIL = re.compile(r"\s+([A-Za-z0-9+/=]{1,15})(?=\s*-----END)")      # the short last line of a key block
AROUND = 400           # characters of surrounding text on either side that prime the measure
COPIED = 8             # characters from which a part of a token (between ``=``) counts as copied in the surroundings
NOVEL = 0.65           # marginal bytes a character from which a token is reported (six bits are 0.75)
PLAIN_NOVEL = 0.75     # the same for tokens without a digit: names of several words come to 0.67, random letters to 0.87
DICTIONARY = 4096      # identifiers in the dictionary


def identifier_dictionary(docs: DataFrame, size: int = DICTIONARY) -> bytes:
    """The corpus's most frequent identifiers, the most frequent last (nearest for the compressor).

    A secret in thousands of copies does not get in: they hold no digit, and long
    ones must be explained by the shorter ones.
    """
    words = docs.select(F.explode(words_of(F.col("text"))).alias("word")).filter(
        F.col("word").rlike("^[A-Za-z_.]{4,40}$"))
    top, _ = frequent(stage(words.groupBy("word").agg(F.count("*").alias("c")), "identifiers"), size)
    short = [w for w in top if not TOKEN.search(w.decode())]
    meter = Meter(b" ".join(reversed(short)))
    around = " ".join(w.decode() for w in short[:AROUND // 8]) + " "
    held = set(short) | {w for w in top if meter.novelty(around + w.decode(), len(around), len(around) + len(w)) < PLAIN_NOVEL}
    return b" ".join(w for w in reversed(top) if w in held)


class Meter:
    """Marginal compressed bytes of a token within its surroundings."""

    def __init__(self, dictionary: bytes):
        prime = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(level=12, dict_data=prime).compress if len(dictionary) >= 8 \
            else zstandard.ZstdCompressor(level=12).compress

    def novelty(self, text: str, start: int, end: int) -> float:
        before, after = text[max(0, start - AROUND):start], text[end:end + AROUND]
        # further copies would make any token a reference to them
        for part in {p for p in text[start:end].split("=") if len(p) >= COPIED}:
            before, after = before.replace(part, ""), after.replace(part, "")
        # nor do other possible secrets prime the measure, as in a list of them
        before, after = MIXED.sub("", before), MIXED.sub("", after)
        with_it = len(self.compress((before + text[start:end] + after).encode("utf-8", "surrogatepass")))
        without = len(self.compress((before + after).encode("utf-8", "surrogatepass")))
        return (with_it - without) / (end - start)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, by start and kind as listed."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def novel_spans(text: str, base: list, meter: Meter) -> list[tuple[int, int, int]]:
    """Incompressible tokens in a sensitive context that no base span touches.

    A token that follows a reported one with nothing but white space or
    punctuation between is in its context too: lines of a key, values of a list.
    """
    out = []
    ends, at = sorted(e for _, _, e in base), 0
    starts, reach = [s for s, _, _ in base], list(itertools.accumulate((e for _, _, e in base), max))
    reported = -1                             # end of the last span before the token
    for m in TOKEN.finditer(text):
        start, end = m.span()
        token = m.group()
        while at < len(ends) and ends[at] <= start:
            reported = max(reported, ends[at])
            at += 1
        if not re.search("[A-Za-z]", token):
            continue
        before = bisect.bisect_left(starts, end)
        if before and reach[before - 1] > start:
            continue
        least = NOVEL if re.search("[0-9]", token) else PLAIN_NOVEL
        if (SENSITIVE.search(text, max(0, start - BEFORE), start) or reported >= 0 and GAP.fullmatch(text, reported, start)) \
                and meter.novelty(text, start, end) >= least:
            out.append((start, 3, end))
            reported = end
            tail = TAIL.match(text, end)
            if tail:
                out.append((tail.start(1), 3, tail.end(1)))
    return out


def spans_of(text: str | None, meter: Meter) -> list[tuple[int, int, int]]:
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, meter))


def find(text: Column, dictionary: bytes) -> Column:
    """Spans of a text as array<struct<kind, start, end>> (code points, end exclusive).

    Null and empty texts have none.  Order: by start, then kind as in KINDS.
    """
    @F.pandas_udf("array<struct<kind string, start long, end long>>")
    def scan(texts: pd.Series) -> pd.Series:
        meter = Meter(dictionary)
        return pd.Series([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans_of(t, meter)]
                          for t in texts], dtype=object)

    return scan(text)


def redact(text: Column, dictionary: bytes, mark: str = "[secret]") -> Column:
    """The text with every span, overlapping ones as one, replaced by ``mark`` (null stays null)."""
    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        meter = Meter(dictionary)
        out = []
        for text in texts:
            spans = spans_of(text, meter)
            if not spans:
                out.append(text)
                continue
            parts, at = [], 0
            for start, _, end in spans:
                if start >= at:
                    parts += [text[at:start], mark]
                at = max(at, end)
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out, dtype=object)

    return clean(text)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans of every row; the dictionary is taken from ``docs`` itself.

    Rows that repeat are scanned each; an empty table gives an empty result.
    """
    return docs.select("doc_id", find(F.col("text"), identifier_dictionary(docs)).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with all secrets replaced in text and n_chars, if there, counted anew."""
    clean = docs.withColumn("text", redact(F.col("text"), identifier_dictionary(docs.select("text"))))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else clean

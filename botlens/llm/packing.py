"""Concatenate and cut: documents packed into sequences of a fixed length.

Pass 1 tokenizes each document and writes its ids with the partition and the
offset within it.  The partitions' token totals, one number a partition, are
summed up to global offsets.  Pass 2 places every document and cuts it at the
window borders.  Windows inside a partition need nothing from another; only the
records at a partition's two borders share a window with a neighbour.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botlens.session import stage

END = 1                        # id after each document
VOCABULARY = "byte_bpe_50k.json"
# Texts of these characters only are split alike by both libraries (tests/llm compare
# them); they are encoded with the same vocabulary's ranks, which is several times faster.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]*")


class Encoder:
    """Ids of byte_bpe_50k.json as ``tokenizers`` gives them, the file's added tokens included."""

    def __init__(self, path: str, ranks_path: str, pattern: str):
        import base64

        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            self.added = [t["content"] for t in json.load(file).get("added_tokens", [])]
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def exact(self):
        """Loaded when the first text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        if PLAIN.fullmatch(text) and not any(a in text for a in self.added):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


def public_encoder() -> Encoder:
    """The encoder of the tokenizer files installed with every Python worker."""
    import public_tokenizers as P

    return Encoder(P.path(VOCABULARY), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def tokenized(docs: DataFrame, encoder=public_encoder) -> DataFrame:
    """(part, before, doc_id, ids) of every row; ids as little-endian unsigned 32-bit bytes,
    ``before``: ids of the same partition that stand before the document's."""
    def run(batches):
        encode, part, before = encoder(), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [np.array([*encode.ids(text), END], "<u4") for text in batch["text"]]
            lengths = np.array([len(x) for x in ids], np.int64)
            ends = before + np.cumsum(lengths)
            yield pd.DataFrame({"part": part, "before": ends - lengths, "doc_id": batch["doc_id"].astype("Int64"),
                                "ids": [x.tobytes() for x in ids]})
            before = int(ends[-1]) if len(ends) else before

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        run, "part int, before long, doc_id long, ids binary")


def offsets(written: DataFrame) -> dict[int, int]:
    """Ids before each partition: a prefix sum over the partitions' totals."""
    totals = written.groupBy("part").agg(F.max(F.col("before") + F.expr("octet_length(ids) div 4")).alias("n"))
    rows = sorted((r.part, r.n) for r in totals.collect())       # one number a partition
    sums = np.concatenate([[0], np.cumsum([n for _, n in rows])])
    return {part: int(start) for (part, _), start in zip(rows, sums)}


def pieces(docs: DataFrame, length: int = 2048, encoder=public_encoder, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece (and its ids).

    Null and empty texts are one id, END.  Repeated rows and null doc_ids are
    packed like any row; an empty table gives no piece.  All sequences but the
    last are full.
    """
    written = stage(tokenized(docs, encoder), "tokens")
    shipped = docs.sparkSession.sparkContext.broadcast(offsets(written))

    def run(batches):
        starts = shipped.value
        for batch in batches:
            out = []
            for part, before, doc_id, raw in batch.itertuples(index=False):
                n, at, done = len(raw) // 4, starts[part] + before, 0
                while done < n:
                    sequence, offset = divmod(at + done, length)
                    size = min(length - offset, n - done)
                    own = raw[4 * done:4 * (done + size)]
                    out.append((doc_id, done, size, zlib.crc32(own), n, sequence, offset, own))
                    done += size
            table = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                                               "offset", "ids"])
            table["doc_id"] = table["doc_id"].astype("Int64")
            yield table if with_ids else table.drop(columns="ids")

    kinds = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
             + ", ids binary" * with_ids)
    return written.select("part", "before", "doc_id", "ids").mapInPandas(run, kinds)


def sequences(docs: DataFrame, length: int = 2048, encoder=public_encoder) -> DataFrame:
    """(sequence_id, ids) with ids as an array of one window each; the last may be shorter."""
    cut = pieces(docs, length, encoder, with_ids=True)
    window = F.sort_array(F.collect_list(F.struct("offset", "ids")))       # at most ``length`` pieces
    joined = cut.groupBy("sequence_id").agg(window.alias("w")).select(
        "sequence_id", F.aggregate("w.ids", F.lit(b""), lambda acc, x: F.concat(acc, x)).alias("raw"))

    @F.pandas_udf("array<long>")
    def numbers(raw: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, "<u4").astype(np.int64) for x in raw], dtype=object)

    return joined.select("sequence_id", numbers("raw").alias("ids"))

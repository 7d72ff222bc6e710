"""Packing: documents laid end to end and cut into fixed windows.

Method: concatenate and cut. The first pass tokenises each document once and writes its ids with the position it has
inside its partition; the partitions' totals (one row each) are prefix-summed into global offsets; the second pass cuts
every document at multiples of the window length and emits one boundary record for each piece. No row meets another,
so nothing but the partition totals is shuffled, and a hot source is no concern.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voucherlens.llm.common import written

#: Characters on which both tokeniser libraries surely agree on letters, digits and spaces.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ſ]|<\|endoftext\|>")
_IDS = "part int, start long, n int, doc_id long, ids array<int>"


def _encoder(json_path: str, ranks_path: str | None, pattern: str | None):
    """text -> ids as `tokenizers` gives them; plain texts go by the faster rank table of the same vocabulary."""
    import base64
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    if ranks_path is None:
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: slow.encode(text, add_special_tokens=False).ids if _PLAIN.search(text) else fast.encode_ordinary(text)


def tokenised(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """A written table (part, start, n, doc_id, ids): every row's ids with `end_id` last, and its place in its partition.

    A null or empty text has the end id alone. Rows that share a doc_id stay apart; a null doc_id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, start = _encoder(json_path, ranks_path, pattern), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                ids = [np.array(encode(text or "") + [end_id], dtype=np.int32) for text in rows.column(1).to_pylist()]
                n = np.array([len(x) for x in ids], dtype=np.int64)
                ends = np.cumsum(n)
                values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)
                yield pa.record_batch([pa.array(np.full(len(n), part, np.int32)), pa.array(start + ends - n), pa.array(n.astype(np.int32)), rows.column(0).cast(pa.int64()), lists], names=["part", "start", "n", "doc_id", "ids"])
                start += int(n.sum())

    return written(docs.select(id_col, text_col).mapInArrow(run, _IDS), "ids")


def pack(ids: DataFrame, length: int = 2048) -> DataFrame:
    """One row per piece of `tokenised()` rows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    All sequences but the last are full, so no padding is needed inside the corpus. An empty input has no piece.
    """
    totals = ids.groupBy("part").agg(F.sum("n").cast("long").alias("total"))  # a row for each partition of the first pass
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    rows = ids.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("start")).alias("place"), "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                docs, places = part.column(0).to_pylist(), part.column(1).to_pylist()
                lists = part.column(2)
                values, ends = lists.flatten().to_numpy().astype("<u4"), np.cumsum(lists.value_lengths().to_numpy()).tolist()
                out, spans, from_ = [], [], 0
                for doc, place, end in zip(docs, places, ends, strict=True):
                    own, total = values[from_:end], end - from_
                    here = 0
                    while here < total:
                        stop = min(total, here + length - (place + here) % length)
                        out.append((doc, here, stop - here, zlib.crc32(own[here:stop].tobytes()), total, (place + here) // length, (place + here) % length))
                        spans.append(own[here:stop])
                        here = stop
                    from_ = end
                columns = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in spans])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(spans).astype(np.int32))))
                yield pa.record_batch(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return rows.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>")


def pack_documents(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`pack(tokenised(docs))`: windows of `length` ids over all documents, the end id after each document."""
    if length < 1:
        raise ValueError("length must be positive")
    return pack(tokenised(docs, json_path, ranks_path, pattern, id_col, text_col), length)

"""Filling containers of fixed capacity with documents.

Documents are measured in tokens of a public tokenizer and dealt by a hash of
their id to shards of a bounded number of tokens; each shard is packed on its
own, so a shard leaves at most a partly filled container or two. Within a shard
items come largest first. Open bins are kept by residual room; the smallest
residual that fits is found by successor search in a bit set, and the search
goes on until the tightest bin is found whose source and duplicate-cluster
bitmaps do not conflict with the item.

Conflicts: two copies of a text never share a container. With
``one_per_source`` two documents of a source do not either. A text longer than
the capacity is cut into full pieces and a rest; no other text is split.

Defined results: null texts and texts without tokens take no room and are left
out. A capacity that is null or below 1 gives no container. Repeated rows of an
id are distinct pieces of work and are packed each.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.session import spread

# Pre-tokenisation of byte-level BPE, as published with the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD_TOKENS = 8_000_000


@cache
def _encoder(path: str):
    import tiktoken
    from pyspark import SparkFiles

    # on an executor the file lies where Spark has put it
    shipped = os.path.exists(path) or SparkFiles.get(os.path.basename(path))
    with open(path if shipped is True else shipped, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("pagewright", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str | None], path: str) -> list[int]:
    """Tokens of each text; special-token strings count as ordinary text."""
    enc = _encoder(path)
    return [len(enc.encode_ordinary(t)) if t else 0 for t in texts]


def token_counter(path: str):
    @F.pandas_udf(T.LongType())
    def tokens(text: pd.Series) -> pd.Series:
        return pd.Series(count_tokens(text.tolist(), path), dtype="int64")

    # so marked, a filter on the count is not pushed below it, where the texts would be counted a second time
    return tokens.asNondeterministic()


class Bins:
    """Open bins by residual room, with a bit set of the residuals in use."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: dict[int, list[int]] = {}
        self.rooms = 0  # bit r: some open bin has r left
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.room: list[int] = []

    def _open(self, b: int) -> None:
        r = self.room[b]
        if r > 0:
            self.by_room.setdefault(r, []).append(b)
            self.rooms |= 1 << r

    def find(self, size: int, source: int, cluster: int) -> int | None:
        """Take out the tightest open bin that has the room and no conflict."""
        ahead = self.rooms >> size
        r = size
        while ahead:
            low = (ahead & -ahead).bit_length() - 1
            r += low
            bins = self.by_room[r]
            for k in range(len(bins) - 1, -1, -1):
                b = bins[k]
                if not (self.sources[b] & source or self.clusters[b] & cluster):
                    bins.pop(k)
                    if not bins:
                        del self.by_room[r]
                        self.rooms &= ~(1 << r)
                    return b
            ahead >>= low + 1
            r += 1
        return None

    def put(self, size: int, source: int, cluster: int) -> int:
        """Put an item away; gives its bin, which stays out of the search until settle()."""
        b = self.find(size, source, cluster)
        if b is None:
            b = len(self.room)
            self.room.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        self.room[b] -= size
        self.sources[b] |= source
        self.clusters[b] |= cluster
        return b

    def settle(self, bins: list[int]) -> None:
        for b in bins:
            self._open(b)


def pack(items: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """Bin of each (size, source bit set, cluster bit set) item; sizes are 1 to capacity.

    Items of one cluster and size come one after the other. Bins that a run of
    them has filled can take no more of the run, so they wait outside until the
    run ends, and a hot cluster costs no search through its own bins.
    """
    order = sorted(range(len(items)), key=lambda k: (-items[k][0], items[k][2], items[k][1], k))
    bins, out, waiting, run = Bins(capacity), [0] * len(items), [], None
    for k in order:
        size, source, cluster = items[k]
        if run != (size, cluster) or not cluster:
            bins.settle(waiting)
            waiting = []
        run = (size, cluster)
        out[k] = bins.put(size, source, cluster)
        waiting.append(out[k])
    return out


def split_sizes(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, size) of the pieces of a text."""
    if tokens <= capacity:
        return [(0, tokens)]
    return [(at, min(capacity, tokens - at)) for at in range(0, tokens, capacity)]


PACKED = "spec_id long, container string, doc_id long, piece_no int, token_start long, n_tokens long, capacity int"


def _packer(specs: list[tuple[int, int]], one_per_source: bool):
    def run(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        rows = sorted(zip(t.column("doc_id").to_pylist(), t.column("source").to_pylist(), t.column("same").to_pylist(), t.column("n").to_pylist()), key=lambda r: (r[0] is None, r[0] or 0, r[3]))
        times: dict[bytes, int] = {}
        for r in rows:
            times[r[2]] = times.get(r[2], 0) + 1
        bit_of = {c: k for k, c in enumerate(c for c, n in times.items() if n > 1)}
        sources = {s: k for k, s in enumerate(sorted({r[1] for r in rows if r[1] is not None}))}
        cols: list[list] = [[] for _ in range(7)]
        for spec, capacity in specs:
            items, what = [], []
            for doc, source, same, n in rows:
                src = 1 << sources[source] if one_per_source and source is not None else 0
                dup = 1 << bit_of[same] if same in bit_of else 0
                for piece, (start, size) in enumerate(split_sizes(n, capacity)):
                    items.append((size, src, dup))
                    what.append((doc, piece + 1, start, size))
            for (doc, piece, start, size), b in zip(what, pack(items, capacity)):
                for c, v in zip(cols, (spec, f"{spec}-{shard}-{b}", doc, piece, start, size, capacity)):
                    c.append(v)
        types = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
        return pa.table({n: pa.array(c, ty) for n, c, ty in zip(("spec_id", "container", "doc_id", "piece_no", "token_start", "n_tokens", "capacity"), cols, types)})

    return run


def pack_documents(documents: DataFrame, specs: DataFrame, tokenizer: str, one_per_source: bool = False) -> DataFrame:
    """(spec_id, container, doc_id, piece_no, token_start, n_tokens, capacity) of every text for every capacity.

    A text hot by its number of copies spreads over all shards, as these go by
    doc_id. The number of shards follows the size of the texts. tokenizer is a
    vocabulary file on the driver, which is shipped to the executors.
    """
    documents.sparkSession.sparkContext.addFile(tokenizer)
    wanted = [(r.spec_id, r.capacity_tokens) for r in specs.select("spec_id", "capacity_tokens").filter("capacity_tokens >= 1").distinct().orderBy("spec_id").limit(1001).collect()]
    if len(wanted) > 1000:
        raise ValueError("more than 1000 capacities")
    texts = documents.filter(F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id", "source", "text")
    sized = spread(texts, "doc_id").select("doc_id", "source", F.unhex(F.md5(F.col("text").cast("binary"))).alias("same"), token_counter(tokenizer)("text").alias("n"))
    shards = _shards(texts)
    sized = sized.filter("n > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    return sized.select("shard", "doc_id", "source", "same", "n").groupBy("shard").applyInArrow(_packer(wanted, one_per_source), PACKED)


def _shards(texts: DataFrame) -> int:
    """Shards of about SHARD_TOKENS tokens, by the bytes of all texts: a token has three bytes or more on the whole."""
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(1, -(-total // (3 * SHARD_TOKENS)))


def utilisation(packed: DataFrame) -> DataFrame:
    """(spec_id, n_containers, n_pieces, n_tokens, unused_share) for each capacity."""
    return packed.groupBy("spec_id").agg(
        F.count_distinct("container").alias("n_containers"), F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"),
        (1 - F.sum("n_tokens") / (F.count_distinct("container") * F.max("capacity"))).alias("unused_share"),
    )


def brute_check(rows: Iterator) -> None:
    """Raises unless no container overflows and every text is covered once by its pieces; for tests."""
    load: dict = {}
    spans: dict = {}
    for r in rows:
        load[r.container] = load.get(r.container, 0) + r.n_tokens
        assert load[r.container] <= r.capacity
        spans.setdefault((r.spec_id, r.doc_id), []).append((r.token_start, r.n_tokens))
    for s in spans.values():
        at = 0
        for start, n in sorted(s):
            assert start == at
            at += n

"""Whole-corpus encoding with a byte-level BPE, long texts in overlapping chunks.

A text longer than a chunk is cut into chunks that overlap.  Each chunk is pre-tokenised on its own.
The pattern decides a token from the position it starts at and a few characters after its end, so
once two neighbours have a boundary in common inside their overlap, they agree from there on: that
is where they are stitched.  The pieces between the stitches are encoded independently and their ids
concatenated.  Neighbours without a common boundary are encoded together.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.session import partitions, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pre-tokenisation pattern of this vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK, OVERLAP = 8192, 512
#: Characters a pre-token's end can depend on beyond itself.
LOOK = 4


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str = PATTERN):
    """The encoding of a vocabulary of ranks, once per process; it has no special tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


def boundaries(text: str, pattern: str = PATTERN) -> list[int]:
    """Where pre-tokens start."""
    return [m.start() for m in _pattern(pattern).finditer(text)]


def stitch(left: list[int], right: list[int]) -> int | None:
    """The first boundary that both have; None if there is none."""
    common = set(left).intersection(right)
    return min(common) if common else None


def encode_text(text: str | None, path: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Ids of one text by the chunked method, in one process: the reference for tests."""
    if not text:
        return []
    enc = encoder(path)
    if len(text) <= chunk:
        return enc.encode_ordinary(text)
    starts = list(range(0, max(1, len(text) - overlap), chunk - overlap))
    bounds = [[s + b for b in boundaries(text[s : s + chunk])] for s in starts]
    cuts = [0]
    for k, s in enumerate(starts[1:], 1):
        end = starts[k - 1] + chunk
        if (at := stitch([b for b in bounds[k - 1] if s < b <= end - LOOK], [b for b in bounds[k] if s < b <= end - LOOK])) is not None:
            cuts.append(at)
    return [i for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True) for i in enc.encode_ordinary(text[a:b])]


def decode_ids(ids: list[int], path: str = VOCABULARY) -> str:
    """The text of ids: their raw bytes, concatenated."""
    return encoder(path).decode_bytes(ids).decode("utf-8", errors="replace")


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids = [enc.encode_ordinary(t.as_py()) if t.is_valid else [] for t in batch.column("text")]
            keys = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(ids, pa.list_(pa.int32()))], names=[*names, "ids"])

    return run


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the boundaries inside the overlap with the chunk before, and with the one after."""
    for batch in batches:
        d = batch.to_pydict()
        heads, tails = [], []
        for text, at, last, overlap in zip(d["text"], d["at"], d["last"], d["overlap"], strict=True):
            all_bounds = boundaries(text)
            heads.append([at + b for b in all_bounds if 0 < b <= overlap - LOOK])
            tails.append([] if last else [at + b for b in all_bounds if len(text) - overlap < b <= len(text) - LOOK])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], names=[*batch.schema.names, "head", "tail"])


def encode(df: DataFrame, id_col: str, text_col: str, path: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, ids) for every row: the token ids of its text, without special tokens.

    Null and empty texts give the empty list; names of special tokens in a text are ordinary text.
    Rows are kept as they are, repeated ids and null ids included.  Texts up to `chunk` characters
    are encoded where they are read, without a shuffle; only the chunks of longer ones are spread.
    Extra columns are ignored.
    """
    if not 4 * LOOK < overlap < chunk // 2:
        raise ValueError("the overlap must be longer than what a boundary depends on, and under half a chunk")
    rows = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    long_text = F.coalesce(F.length("text") > chunk, F.lit(False))
    kind = rows.schema["id"].dataType.simpleString()
    short = rows.where(~long_text).mapInArrow(_encode(path), f"id {kind}, ids array<int>")
    step = chunk - overlap
    # Repeated rows are counted and repeated again at the end: a number given to each row would differ
    # if a lost task ran again.
    longs = rows.where(long_text).groupBy("id", "text").agg(F.count("*").alias("copies")).withColumn("row", F.xxhash64("id", "text")).withColumn("n", F.ceil((F.length("text") - overlap) / step).cast("int"))
    chunks = longs.select("id", "row", "copies", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.substring("text", k * step + 1, F.lit(chunk)))).alias("k", "text"))
    chunks = chunks.select("id", "row", "copies", "k", (F.col("k").cast("long") * step).alias("at"), (F.col("k") == F.col("n") - 1).alias("last"), F.lit(overlap).alias("overlap"), "text")
    chunks = chunks.repartition(partitions(df.sparkSession), "row", "k")
    bound = chunks.mapInArrow(_bounds, f"id {kind}, row long, copies long, k int, at long, last boolean, overlap int, text string, head array<long>, tail array<long>")
    order = Window.partitionBy("id", "row").orderBy("k")
    cut = F.array_min(F.array_intersect("tail", F.lead("head").over(order)))  # where the next piece starts; null: not found
    cuts = bound.withColumn("to", cut).withColumn("open", F.col("to").isNull() & ~F.col("last"))
    before = F.lag("open", 1, False).over(order)
    cuts = cuts.withColumns({"from": F.when(F.col("k") == 0, F.lit(0)).otherwise(F.lag("to").over(order)), "starts": (~before).cast("int")})
    cuts = cuts.withColumn("run", F.sum("starts").over(order))
    # A chunk that found no stitch ends where its successor begins, and is joined to it.
    own = F.substring("text", (F.coalesce("from", F.col("at")) - F.col("at") + 1).cast("int"), F.when(F.col("last"), F.length("text")).otherwise(F.when(F.col("open"), F.lit(step) - (F.coalesce("from", F.col("at")) - F.col("at"))).otherwise(F.col("to") - F.coalesce("from", F.col("at")))).cast("int"))
    pieces = cuts.select("id", "row", "copies", "run", "k", own.alias("piece")).groupBy("id", "row", "copies", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "piece"))), lambda x: x["piece"]), "").alias("text"))
    encoded = pieces.mapInArrow(_encode(path), f"id {kind}, row long, copies long, run long, ids array<int>")
    whole = encoded.groupBy("id", "row", "copies").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("run", "ids"))), lambda x: x["ids"])).alias("ids"))
    whole = whole.select("id", "ids", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_c")).select("id", "ids")
    return short.unionByName(whole)


def decode(df: DataFrame, id_col: str, ids_col: str, path: str = VOCABULARY) -> DataFrame:
    """(id, text): the texts of lists of ids, from their raw bytes; null for null."""
    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(x.as_py(), path) if x.is_valid else None for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    return rows.mapInArrow(run, f"id {kind}, text string")

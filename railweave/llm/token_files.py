"""Token ids of a corpus in files of fixed-width packed blocks, in the order of the documents.

A data set is a folder with two Parquet tables. `blocks` has a row for each block, which
holds the ids of consecutive whole documents in the fewest bits that the vocabulary needs,
most significant bit first: `part` (number of the range of documents), `first` (place of its
first id within the part), `n_ids`, `bits`, `doc_ids`, `ends` (where each document ends in
the block) and `packed`. `parts` has `part`, `n_ids` and `start`: how many ids stand before
the part. So any stretch of ids is found by arithmetic and read without what lies before it,
and Spark's committer sees to tasks that are run twice.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .arrow_text import held
from .token_ids import encoder

#: Ids of a block, about: documents are not cut, so a longer one is a block by itself.
BLOCK_IDS = 1 << 16
#: Ids packed or unpacked at a time, a multiple of eight, so that each step ends on a byte.
STEP_IDS = 1 << 16
#: Rows whose ids are held at one time in a task.
ROWS_AT_ONCE = 1_200
#: Bytes of text in a part, about.
PART_BYTES = 256 << 20

BLOCKS = "part int, first bigint, n_ids bigint, bits int, doc_ids array<bigint>, ends array<bigint>, packed binary"


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id of a vocabulary of that size."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """`ids` in `bits` bits each, most significant first; the last byte is filled with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    out = []
    for at in range(0, len(ids), STEP_IDS):
        spread = np.unpackbits(ids[at : at + STEP_IDS].astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
        out.append(np.packbits(spread[:, 32 - bits :]).tobytes())
    return b"".join(out)


def unpack(packed: bytes, bits: int, first: int, n: int) -> np.ndarray:
    """`n` ids from the place `first` on; only their bytes are looked at."""
    if bits in (8, 16, 32):
        width = bits // 8
        return np.frombuffer(packed, f">u{width}", n, first * width).astype(np.uint32)
    out, done = np.zeros(n, np.uint32), 0
    while done < n:
        some = min(n - done, STEP_IDS)
        begin = (first + done) * bits
        seen = np.unpackbits(np.frombuffer(packed, np.uint8, -(-(begin + some * bits) // 8) - begin // 8, begin // 8))[begin % 8 :][: some * bits]
        spread = np.zeros((some, 32), np.uint8)
        spread[:, 32 - bits :] = seen.reshape(some, bits)
        out[done : done + some] = np.packbits(spread, axis=1).view(">u4").ravel()
        done += some
    return out


def blocks_of(part: int, first: int, doc_ids: list, ids: np.ndarray, ends: np.ndarray, bits: int) -> Iterator[dict]:
    """Rows of consecutive documents, cut into blocks of whole ones."""
    at, begin = 0, 0
    while at < len(doc_ids):
        to = max(at + 1, int(np.searchsorted(ends, begin + BLOCK_IDS, "right")))
        end = int(ends[to - 1])
        yield {"part": part, "first": first + begin, "n_ids": end - begin, "bits": bits, "doc_ids": doc_ids[at:to], "ends": (ends[at:to] - begin).tolist(), "packed": pack(ids[begin:end], bits)}
        at, begin = to, end


def _keys(id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(id_col).cast("bigint").alias("id"), F.octet_length(text).alias("size"), F.crc32(text.cast("binary")).alias("crc"), text.alias("text")]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of every text of `docs`, each text followed by `end_id`, as a data set in the new folder `path`.

    tokenizer: path of a tokenizers file that every worker has. Documents stand in ascending
    order of their ids, rows without an id first; rows of one id are ordered by size and crc,
    and rows alike in all of these are dealt apart, so that no part holds a large group of
    them. Null or empty text: the end id alone. Other columns are not read; an empty table
    gives an empty data set. Texts move once; each is encoded whole, where it is written.
    """
    spark = docs.sparkSession
    rows = docs.select(*_keys(id_col, text_col))
    told = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    parts = max(3 * spark.sparkContext.defaultParallelism, -(-told // PART_BYTES))
    order = ("id", "size", "crc", "_tail")
    dealt = rows.withColumn("_tail", F.rand(7)).repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(__name__, encoder.cache_clear)
        encode, vocabulary = encoder(tokenizer)
        bits, first = max(bits_for(vocabulary), bits_for(end_id + 1)), 0
        schema = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("packed", pa.binary())])
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(at, ROWS_AT_ONCE)
                coded, doc_ids = encode(some.column("text")), some.column("id").to_pylist()
                ids, ends = np.insert(coded.ids, coded.ends, end_id), coded.ends + np.arange(1, len(doc_ids) + 1)
                for row in blocks_of(part, first, doc_ids, ids, ends, bits):
                    yield pa.RecordBatch.from_pylist([row], schema)
                first += len(ids)

    dealt.mapInArrow(run, BLOCKS).write.parquet(f"{path}/blocks")
    # One row for each part: the only thing that is summed in order.
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes.withColumn("start", F.coalesce(before, F.lit(0))).coalesce(1).write.parquet(f"{path}/parts")


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) for each document of a data set; keep_ids adds `ids`.

    start: how many ids all documents before it have; n_tokens: its own, the end id among
    them; ids_crc32: of its ids as little-endian 32-bit numbers. Blocks are read apart from
    each other.
    """
    kinds = {"part": pa.int32(), "doc_id": pa.int64(), "at": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int64())} if keep_ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                ids = unpack(block["packed"], block["bits"], 0, block["n_ids"]).astype("<u4")
                ends, n = np.array(block["ends"], np.int64), len(block["ends"])
                starts = np.append(0, ends[:-1])
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [pa.array([block["part"]] * n, pa.int32()), pa.array(block["doc_ids"], pa.int64()), pa.array(block["first"] + starts), pa.array(ends - starts), pa.array(crcs, pa.int64())]
                lists = [pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1]), pa.int32()), pa.array(ids.astype(np.int64)))] if keep_ids else []
                yield pa.RecordBatch.from_arrays(columns + lists, schema=pa.schema(kinds))

    ddl = "part int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if keep_ids else "")
    found = spark.read.parquet(f"{path}/blocks").mapInArrow(run, ddl)
    parts = spark.read.parquet(f"{path}/parts").select("part", "start")
    placed = found.join(F.broadcast(parts), "part")
    return placed.select(F.col("doc_id").alias(id_col), (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep_ids else []))


def read_ids(spark: SparkSession, path: str, first: int, n: int) -> np.ndarray:
    """The `n` ids of a data set from place `first` on; fewer at its end. Only the blocks that hold them are read."""
    if first < 0 or n < 0:
        raise ValueError("places and numbers of ids are not negative")
    parts = spark.read.parquet(f"{path}/parts").where((F.col("start") < first + n) & (F.col("start") + F.col("n_ids") > first)).collect()
    told = [np.zeros(0, np.uint32)]
    for part in sorted(parts, key=lambda p: p["start"]):
        low, high = first - part["start"], first + n - part["start"]
        blocks = spark.read.parquet(f"{path}/blocks").where((F.col("part") == part["part"]) & (F.col("first") < high) & (F.col("first") + F.col("n_ids") > low))
        for b in blocks.orderBy("first").select("first", "n_ids", "bits", "packed").toLocalIterator():
            begin, end = max(low - b["first"], 0), min(high - b["first"], b["n_ids"])
            told.append(unpack(bytes(b["packed"]), b["bits"], begin, end - begin))
    return np.concatenate(told)

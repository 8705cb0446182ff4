"""Token-ID shards in training order: a keyed Feistel permutation deals every sequence a global slot."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import cut
from fieldloom.session import checkpoint_folder

#: Tokens of a sequence, sequences of a shard file, neighbouring files that one task writes, rounds of the permutation.
SEQUENCE, SHARD, FILES, ROUNDS = 1024, 4096, 4, 6
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The split pattern that goes with the vocabulary, and its free id, used as the end of a document.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
END = 50256
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer in the file ``path``; once per worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding("shards", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def round_keys(key: str) -> np.ndarray:
    """64-bit keys of the rounds."""
    return np.array([int.from_bytes(hashlib.sha256(f"{key}:{i}".encode()).digest()[:8], "big") for i in range(ROUNDS)], np.uint64)


def permuted(index: np.ndarray, n: int, key: str) -> np.ndarray:
    """A bijection of 0..n-1: a balanced Feistel network over the next even number of bits, cycle-walked.

    A result outside 0..n-1 is sent through again; the domain is less than four times n, so few walks are long.
    """
    half = max(1, math.ceil(math.log2(max(n, 2)) / 2))
    mask, keys = np.uint64((1 << half) - 1), round_keys(key)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            h = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h ^ (h >> np.uint64(32))) & mask)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    while len(away := np.flatnonzero(out >= np.uint64(n))):
        out[away] = once(out[away])
    return out.astype(np.int64)


@dataclass(frozen=True)
class Shards:
    """Where the files are and how to read them; also kept as ``manifest`` beside them."""

    folder: str
    sequences: int
    sequence: int
    shard: int
    key: str
    tokenizer: str
    dtype: str = "<u2"

    @property
    def stride(self) -> int:
        return 4 + self.sequence * 2

    def path(self, number: int) -> str:
        return f"{self.folder}/shard-{number:06d}.bin"


def packed(docs: DataFrame, sequence: int = SEQUENCE, tokenizer: str = TOKENIZER) -> DataFrame:
    """All sequences, made once and written: file, nth (its place in the file), doc_ids, starts, ids.

    The tokens of a task's documents, each with an end mark, stand one after another and are cut every
    ``sequence`` ids; only the task's last sequence is shorter. ``doc_ids`` are the documents in it and
    ``starts`` where they begin (below 0: in an earlier sequence). ``ids`` are little-endian 16-bit numbers.
    """
    # ids travel as text: beside a null one pandas would make them floating-point numbers
    texts = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, nth, file = encoder(tokenizer), 0, 0
        rest, names, begins = np.zeros(0, "<u2"), [], np.zeros(0, np.int64)

        def cut_off(n: int) -> pd.DataFrame:
            """The first n sequences of what is held; the rest stays."""
            nonlocal rest, names, begins, nth
            rows = []
            for k in range(n):
                low = max(int(np.searchsorted(begins, k * sequence, "right")) - 1, 0)
                high = int(np.searchsorted(begins, (k + 1) * sequence, "left"))
                ids = rest[k * sequence : (k + 1) * sequence].tobytes()
                rows.append((file, nth + k, names[low:high], (begins[low:high] - k * sequence).tolist(), ids))
            done = n * sequence
            low = max(int(np.searchsorted(begins, done, "right")) - 1, 0)
            rest, names, begins, nth = rest[done:], names[low:], begins[low:] - done, nth + n
            return pd.DataFrame(rows, columns=["file", "nth", "doc_ids", "starts", "ids"])

        for batch in batches:
            file = int(batch["file"].iloc[0]) if len(batch) else file
            new = [np.array([*t.encode_ordinary(x), END], "<u2") for x in batch["text"]]
            size = np.array([len(x) for x in new], np.int64)
            begins = np.concatenate([begins, len(rest) + np.cumsum(size) - size])
            names = names + [None if x is None else int(x) for x in batch["doc_id"]]
            rest = np.concatenate([rest, *new])
            yield cut_off(len(rest) // sequence)
        if len(rest):
            yield cut_off(1)

    rows = texts.withColumn("file", F.spark_partition_id())
    return cut(rows.mapInPandas(pack, "file int, nth long, doc_ids array<long>, starts array<long>, ids binary"), "sequences", "gzip")


def open_store(folder: str):
    """File system and path of a folder that all executors share."""
    from pyarrow import fs

    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


def write_shards(
    docs: DataFrame, folder: str | None = None, key: str = "order", sequence: int = SEQUENCE, shard: int = SHARD, tokenizer: str = TOKENIZER
) -> tuple[Shards, DataFrame]:
    """Write all documents as fixed-stride shards in training order; the manifest and an index of the sequences.

    Index: slot, shard, byte_offset, seq, doc_ids, starts, n_tokens, ids_sha256. Null and empty texts give one
    end mark; ids may be null or repeated, each row has tokens of its own; an empty table gives an empty
    index and no files; other columns are not read.

    Sequences are packed and written once (see ``packed``). Their dense numbers ``seq`` are the place in the
    task's file and one number for each file on top. The permutation of 0..n-1 under ``key`` turns numbers
    into slots. A shard file holds ``shard`` slots one after another, each record ``stride`` bytes: the number
    of ids, then ``sequence`` ids, filled up with the end mark; so record s lies in file s // shard at
    (s % shard) * stride. The slots are dealt in ranges of ``FILES`` shards, so a task writes neighbouring files, all
    of one size; a file is written under another name and then moved: a repeated task writes the same bytes again.
    Without ``folder`` the files go to a new folder below the shared one; they stay when the session ends.
    """
    spark = docs.sparkSession
    table = packed(docs, sequence, tokenizer)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    per_file = table.groupBy("file").agg(F.count("*").alias("n"))  # one row for each task that wrote
    bases = cut(per_file.select("file", "n", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base")), "bases")
    total = int(bases.agg(F.sum("n")).first()[0] or 0)
    made = Shards(folder or f"{checkpoint_folder(spark).rstrip('/')}/token-shards-{uuid.uuid4().hex}", total, sequence, shard, key, tokenizer)

    @F.pandas_udf("long")
    def slot(seq: pd.Series) -> pd.Series:
        return pd.Series(permuted(seq.to_numpy(np.int64), total, key))

    def bundled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sequences of a batch that go to one shard travel together, deflated."""
        for batch in batches:
            out = [
                (number, rows["slot"].to_numpy("<i8").tobytes(), rows["ids"].map(len).to_numpy("<u4").tobytes(), zlib.compress(b"".join(rows["ids"]), 1))
                for number, rows in batch.groupby("shard")
            ]
            yield pd.DataFrame(out, columns=["shard", "slots", "sizes", "ids"])

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = open_store(made.folder)
        store.create_dir(root, recursive=True)
        held: list[pd.DataFrame] = []

        def close() -> pd.DataFrame:
            rows = pd.concat(held)
            held.clear()
            slots = np.frombuffer(b"".join(rows["slots"]), "<i8")
            ends = np.cumsum(np.frombuffer(b"".join(rows["sizes"]), "<u4").astype(np.int64))
            stream = b"".join(zlib.decompress(x) for x in rows["ids"])
            filler = END.to_bytes(2, "little") * sequence
            records = []
            for i in np.argsort(slots):
                ids = stream[ends[i - 1] if i else 0 : ends[i]]
                records += [(len(ids) // 2).to_bytes(4, "little"), ids, filler[len(ids) :]]
            data = b"".join(records)
            name = f"{root}/shard-{int(rows['shard'].iloc[0]):06d}.bin"
            draft = f"{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                out.write(data)
            if store.get_file_info(name).is_file:  # an earlier attempt has moved the same bytes there
                store.delete_file(draft)
            else:
                store.move(draft, name)
            return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "rows": [len(slots)]})

        for batch in batches:
            for number, rows in batch.groupby("shard", sort=False):
                if held and held[0]["shard"].iloc[0] != number:
                    yield close()
                held.append(rows)
        if held:
            yield close()

    rows = table.join(bases.select("file", "base"), "file").withColumn("seq", F.col("base") + F.col("nth"))
    rows = rows.withColumn("slot", slot("seq")).withColumn("shard", F.floor(F.col("slot") / shard))
    moved = rows.select("slot", "shard", "ids").mapInPandas(bundled, "shard long, slots binary, sizes binary, ids binary")
    ranges = max(1, -(-total // (shard * FILES)))
    dealt = moved.repartitionById(ranges, F.floor(F.col("shard") / FILES).cast("int"))
    files = dealt.sortWithinPartitions("shard").mapInPandas(written, "shard long, rows long")
    if (files.agg(F.sum("rows")).first()[0] or 0) != total:
        raise RuntimeError("not every sequence is in a shard")
    index = rows.select(
        "slot", "shard", (F.col("slot") % shard * made.stride).alias("byte_offset"), "seq", "doc_ids", "starts",
        F.floor(F.octet_length("ids") / 2).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
    )
    spark.createDataFrame([(json.dumps(asdict(made)),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{made.folder}/manifest")
    return made, index


def read_shards(spark: SparkSession, made: Shards, start: int = 0, count: int | None = None) -> DataFrame:
    """Records from slot ``start`` on, as a reader that resumes there gets them: slot, ids."""
    stop = made.sequences if count is None else min(made.sequences, start + count)
    numbers = range(start // made.shard, -(-stop // made.shard)) if stop > start else range(0)
    if not len(numbers):
        return spark.createDataFrame([], "slot long, ids array<int>")
    stride, shard = made.stride, made.shard

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                first = int(path.rsplit("-", 1)[1].removesuffix(".bin")) * shard
                slots = [s for s in range(first, first + len(content) // stride) if start <= s < stop]
                ids = [np.frombuffer(content, "<u2", int.from_bytes(content[at : at + 4], "little"), at + 4).astype(np.int32) for at in ((s - first) * stride for s in slots)]
                yield pd.DataFrame({"slot": slots, "ids": ids})

    files = spark.read.format("binaryFile").load([made.path(i) for i in numbers])
    return files.select("path", "content").mapInPandas(records, "slot long, ids array<int>")

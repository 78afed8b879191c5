"""Token ids of documents in raw binary shards with a minimal perfect hash index.

One shard is two files in a folder that driver and executors share:

``shard-P-A.ids``  the ids of its documents one after another, little-endian, 16 bits where the
                   vocabulary allows it, else 32
``shard-P-A.idx``  ``BWT1``, bytes per id, number of records, number of keys (three int64), record
                   ids (int64), null flags (uint8), record offsets in ids (int64, one more than
                   records), the perfect hash, then by slot: fingerprint (uint32), first record
                   (uint32) and number of records (uint32)

P is the partition, A the task attempt, so a repeated or lost attempt never touches the files of
another; the manifest, written by Spark, names the files of the attempts that count.
"""

from __future__ import annotations

import json
import string
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir
from .mph import MinimalPerfectHash, fingerprint

MAGIC = b"BWT1"
#: A worker keeps the ids of so many pieces, and as many older ones; longer pieces are never kept.
CACHE_PIECES, CACHE_PIECE_CHARS = 80_000, 40
#: Marks that may end a plain piece; the apostrophe can start a token with letters, so it is not one.
END_MARKS = string.punctuation.replace("'", "")
#: Ids read at once when a shard is read back.
READ_IDS = 4_000_000

MANIFEST = "shard long, ids_path string, idx_path string, n_records long, n_ids long, min_key long, max_key long"

_encoders: dict = {}


class Encoder:
    """Encodes texts as the bytes of their ids, piece by piece between blanks.

    The tokenizer drops white space before it merges, so the ids of a text are those of its
    blank-separated pieces one after another; pieces repeat, and each is encoded once. Where the
    tokenizer lower-cases and cuts between letters and other characters, a new piece of Latin
    letters and end punctuation is made of the ids of both, and its letters go to the merge model
    directly; anything else goes through the whole tokenizer.
    """

    def __init__(self, path: str, split_blanks: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code, self.model = "H" if self.dtype.itemsize == 2 else "I", self.tokenizer.model
        self.split_blanks = split_blanks
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        spec = json.loads(self.tokenizer.to_str())
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = json.dumps(spec["pre_tokenizer"])
        self.words = steps == ["NFC", "Replace", "Lowercase"] and r"|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in cuts
        self.specials = [t["content"].lower() for t in spec["added_tokens"]]
        if self.words:
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.letters = {c: cut(chr(c))[0][0] for c in range(256) if chr(c).isalpha()}

    def whole(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def packed(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def piece(self, text: str, plain: bool) -> bytes:
        """Ids of a piece that is not kept; plain: it is lower-case Latin-1 of a word tokenizer."""
        if plain:
            if text.isalpha():
                if not text.isascii():
                    text = text.translate(self.letters)
                return self.packed([t.id for t in self.model.tokenize(text)])
            core = text.rstrip(END_MARKS)
            if len(core) < len(text) and core.isalpha():
                return self.kept(core, True) + self.kept(text[len(core) :], False)
        return self.whole(text)

    def kept(self, text: str, plain: bool) -> bytes:
        found = self.new.get(text)
        if found is None:
            found = self.old.get(text)
            if found is None:
                found = self.piece(text, plain)
            if len(text) <= CACHE_PIECE_CHARS:
                if len(self.new) >= CACHE_PIECES:
                    self.old, self.new = self.new, {}
                self.new[text] = found
        return found

    def encode(self, text: str) -> bytes:
        if not self.split_blanks:
            return self.whole(text)
        plain = False
        if self.words:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                low = text.lower()
                plain = not any(s in low for s in self.specials)
                text = low if plain else text
        pieces = text.replace("\n", " ").split(" ")
        found = list(map(self.new.get, pieces))
        if None in found:
            kept = self.kept
            found = [kept(p, plain) if f is None else f for p, f in zip(pieces, found)]
        return b"".join(found)


def encoder(path: str, split_blanks: bool = True) -> Encoder:
    """One encoder for each worker process."""
    if (path, split_blanks) not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path, split_blanks] = Encoder(path, split_blanks)
    return _encoders[path, split_blanks]


def index_bytes(itemsize: int, ids: np.ndarray, nulls: np.ndarray, offsets: np.ndarray) -> bytes:
    """The index file of records in ascending id order; null ids are stored but not keyed."""
    first_key = int(nulls.sum())  # nulls sort first
    keys, first, count = np.unique(ids[first_key:], return_index=True, return_counts=True)
    keys = keys.astype(np.int64).view(np.uint64)
    mph = MinimalPerfectHash.build(keys)
    slots = mph.slots(keys)
    by_slot = np.zeros((3, len(keys)), dtype="<u4")
    by_slot[:, slots] = fingerprint(keys), first + first_key, count
    head = np.array([itemsize, len(ids), len(keys)], dtype="<i8").tobytes()
    return b"".join(
        [MAGIC, head, ids.astype("<i8").tobytes(), nulls.astype(np.uint8).tobytes(), offsets.astype("<i8").tobytes()]
        + [mph.to_bytes(), by_slot.tobytes()]
    )


class TokenShard:
    """Keyed access to one shard: a key costs a few hash probes and one read of its ids."""

    def __init__(self, idx_path: str, ids_path: str):
        files, path = fs.FileSystem.from_uri(idx_path)
        with files.open_input_stream(path) as f:
            data = f.read()
        if data[:4] != MAGIC:
            raise ValueError(f"not a token index: {idx_path}")
        itemsize, n, n_keys = (int(v) for v in np.frombuffer(data, "<i8", 3, offset=4))
        at = 28
        self.dtype = np.dtype(f"<u{itemsize}")
        self.ids = np.frombuffer(data, "<i8", n, offset=at)
        self.nulls = np.frombuffer(data, np.uint8, n, offset=(at := at + 8 * n))
        self.offsets = np.frombuffer(data, "<i8", n + 1, offset=(at := at + n))
        at += 8 * (n + 1)
        self.mph, used = MinimalPerfectHash.from_bytes(data[at:])
        self.by_slot = np.frombuffer(data, "<u4", 3 * n_keys, offset=at + used).reshape(3, n_keys)
        self._ids_path = ids_path

    def records(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of each key; (-1, 0) where the shard lacks it."""
        keys = np.asarray(keys, dtype=np.int64).view(np.uint64)
        slots = self.mph.slots(keys)
        known = slots >= 0
        known[known] = self.by_slot[0][slots[known]] == fingerprint(keys[known])
        first, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        first[known], count[known] = self.by_slot[1][slots[known]], self.by_slot[2][slots[known]]
        return first, count

    def read(self, first: int, last: int) -> np.ndarray:
        """The ids of records first .. last - 1."""
        files, path = fs.FileSystem.from_uri(self._ids_path)
        size = self.dtype.itemsize
        begin, end = int(self.offsets[first]) * size, int(self.offsets[last]) * size
        with files.open_input_file(path) as f:
            f.seek(begin)
            return np.frombuffer(f.read(end - begin), self.dtype)

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each record of a key."""
        first, count = (int(v[0]) for v in self.records(np.array([key])))
        return [self.read(r, r + 1) for r in range(first, first + count)]


def write_token_shards(
    docs: DataFrame,
    tokenizer_path: str,
    out_dir: str | None = None,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    split_blanks: bool = True,
    shards: int | None = None,
) -> DataFrame:
    """Encode every text, end it with ``end_id``, write shards in ascending id order.

    Returns the manifest, one row per shard, itself kept as a table in the shared folder. A null
    text counts as empty; a null id comes first and has no key; rows that share an id are written
    in the order of their texts and one key finds them all. ``split_blanks=False`` is for
    tokenizers that keep white space. Ids are dealt to shards by range, so an id that a third of
    the rows share would fill one shard: its rows stream through, and only 40 bytes of index a row
    stay in memory.
    """
    spark = docs.sparkSession
    out_dir = out_dir or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    ranged = rows.repartitionByRange(shards, "k") if shards else rows.repartitionByRange("k")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, enc = TaskContext.get(), encoder(tokenizer_path, split_blanks)
        name = f"{out_dir}/shard-{context.partitionId():06d}-{context.taskAttemptId()}"
        files, path = fs.FileSystem.from_uri(f"{name}.ids")
        end = np.array([end_id], enc.dtype).tobytes()
        keys, nulls, sizes, out = [], [], [], None
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1)):
                if out is None:
                    files.create_dir(path.rpartition("/")[0], recursive=True)
                    out = files.open_output_stream(path)
                data = enc.encode(t.as_py()) + end
                out.write(data)
                k = k.as_py()
                keys.append(0 if k is None else k)
                nulls.append(k is None)
                sizes.append(len(data) // enc.dtype.itemsize)
        if out is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))])
        ids, null = np.array(keys, dtype=np.int64), np.array(nulls, dtype=bool)
        with files.open_output_stream(path[:-4] + ".idx") as f:
            f.write(index_bytes(enc.dtype.itemsize, ids, null, offsets))
        keyed = ids[~null]
        low, high = (int(keyed.min()), int(keyed.max())) if len(keyed) else (None, None)
        row = [context.partitionId(), f"{name}.ids", f"{name}.idx", len(ids), int(offsets[-1]), low, high]
        kinds = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4]
        names = [c.split()[0] for c in MANIFEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    return materialize(ranged.sortWithinPartitions("k", "t").mapInArrow(write, MANIFEST), "token-manifest")


def _placed(manifest: DataFrame) -> DataFrame:
    """The manifest with ``base``, the ids of all shards before each. One row a shard: it is small."""
    total, rows = 0, []
    for r in manifest.orderBy("shard").collect():
        rows.append((r.idx_path, r.ids_path, total))
        total += r.n_ids
    spark: SparkSession = manifest.sparkSession
    placed = spark.createDataFrame(rows, "idx_path string, ids_path string, base long")
    return placed.repartition(max(1, len(rows)))


def read_token_shards(manifest: DataFrame) -> DataFrame:
    """Read all shards back: ``doc_id, start, n_tokens, ids_crc32``, one row per document.

    Each keyed record is located through the index, so a damaged index raises an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for idx, ids, base in zip(*(batch.column(i).to_pylist() for i in range(3))):
                shard = TokenShard(idx, ids)
                n, offsets = len(shard.ids), shard.offsets
                keyed = shard.nulls == 0
                first, count = shard.records(shard.ids[keyed])
                place = np.flatnonzero(keyed)
                if not ((first <= place) & (place < first + count)).all():
                    raise ValueError(f"the index does not find its own records: {idx}")
                a = 0
                while a < n:
                    b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + READ_IDS, "right")) - 1)
                    data = shard.read(a, b).astype("<u4")
                    cut = offsets[a : b + 1] - offsets[a]
                    crc = [zlib.crc32(data[i:j].tobytes()) for i, j in zip(cut[:-1], cut[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard.ids[a:b], pa.int64(), mask=shard.nulls[a:b] == 1),
                            pa.array(base + offsets[a:b], pa.int64()),
                            pa.array(np.diff(offsets[a : b + 1]), pa.int64()),
                            pa.array(crc, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    a = b

    return _placed(manifest).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch_tokens(keys: DataFrame, manifest: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """``doc_id, ids`` (array of long) for each given key that some shard holds; absent keys give no row.

    Shards are found by their key ranges, records by the perfect hash; nothing is shuffled.
    """
    shards = [(r.min_key, r.max_key, r.idx_path, r.ids_path) for r in manifest.where("min_key is not null").collect()]
    shards.sort()

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = np.array([k for k in batch.column(0).to_pylist() if k is not None], dtype=np.int64)
            for low, high, idx, ids in shards:
                mine = want[(want >= low) & (want <= high)]
                if not len(mine):
                    continue
                shard = TokenShard(idx, ids)
                first, count = shard.records(mine)
                for k, f, c in zip(mine.tolist(), first.tolist(), count.tolist()):
                    found = [shard.read(r, r + 1).tolist() for r in range(f, f + c)]
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([k] * c, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "ids"]
                        )

    return keys.select(F.col(key_col).cast("long").alias("k")).mapInArrow(fetch, "doc_id long, ids array<long>")

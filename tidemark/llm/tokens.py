"""Token ids of documents, and a binary file format for them.

Ids: the tokenizer drops white space and never joins text across it, so a text's ids are those
of its white-space-separated chunks one after another. A part of a batch is split and its distinct chunks
found by Arrow; the ids of new ones come from the tokenizers library, and each worker keeps a bounded number of them. Chunks of
ASCII and Latin-1 letters are split into pieces first (one of letters only is a piece), and distinct pieces given to the library's
model; all others go through its whole tokenizer, as do whole texts with a tokenizer of other steps. Special-token strings inside a
text are what the library makes of them.

Format: a dataset of packs in ascending doc_id order. A pack is one self-contained byte string
(little-endian):
  magic "TIDEPACK", u32 version, 32 bytes SHA-256 of the dictionary (zeros: none), u32 documents;
  for each document u32 ids and u32 end of its frame; then the frames.
A frame is one document's ids (u32) compressed by itself with the shared zstandard dictionary, so
a short document is read without its neighbours. Beside the packs lie the dictionary and an index of
each pack's place in the whole stream of ids.

The dictionary is trained on a bounded sample of documents (TRAIN_DOCS by their hash, of at most
4 * TRAIN_IDS characters, TRAIN_IDS ids each); a sample of under TRAIN_LEAST documents or bytes each is the dictionary itself. Null and empty texts have only
the end id. Rows with one doc_id stand in the order of their contents. A null doc_id comes first.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import new_path, ship, small, text_of, tidy, written

END_ID = 2
MAGIC, VERSION = b"TIDEPACK", 1
TRAIN_DOCS, TRAIN_IDS, DICT_BYTES = 2000, 1 << 12, 1 << 16
#: Samples, and as many bytes each, below which nothing is trained.
TRAIN_LEAST = 64
#: A pack is closed when its frames reach so many bytes.
PACK_BYTES = 1 << 20
LEVEL = 3
#: Pieces, and chunks of other letters, whose ids a worker keeps, and their bytes. Pieces given to the library in one string.
KEEP, KEEP_BYTES, AT_ONCE = 1 << 18, 8 << 20, 100
#: Bytes of texts encoded at once.
PART_BYTES = 4 << 20

#: Chunks that the tokenizer's own steps (compose, lower-case, split, bytes as characters) leave simple: ASCII and the
#: letters of Latin-1, whose composed forms and lower case are their own. Others go through the whole tokenizer.
PLAIN = "^[!-~À-ÖØ-öø-ÿ]*$"
#: Such chunks that are one piece.
LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]*$"
#: The tokenizer's split on such chunks in lower case.
PIECE = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+)"
#: The steps of a tokenizer file for which the above holds, fixed values. With any other file, texts are given whole to the library.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
WORD_END = "</w>"


def byte_characters() -> dict[int, str]:
    """The characters that stand for bytes: printable ones for themselves, the others by count from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


def gathered(pool: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The stretches of pool that begin at starts, one after another."""
    ends = np.cumsum(counts)
    kind = np.int32 if len(ends) and max(int(ends[-1]), len(pool)) < 1 << 31 else np.int64
    at = np.repeat((starts - (ends - counts)).astype(kind), counts)
    at += np.arange(len(at), dtype=kind)
    return pool[at]


def listed(strings: pa.Array) -> list[str]:
    """An array's strings; to_pylist takes several times as long."""
    return strings.to_numpy(zero_copy_only=False).tolist()


class Store:
    """Ids by string, looked up by Arrow. Entry 0, of the empty string, has none."""

    def __init__(self):
        self.strings = pa.array([""], pa.string())
        self.starts, self.counts = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.pool = np.zeros(0, np.uint32)
        self.seen = np.zeros(1, np.int64)

    def shrink(self, needed: np.ndarray, room: int) -> None:
        """Keeps these entries, that of the empty string, and of the others those looked up most often, as far as there is room."""
        import pyarrow.compute as pc

        free = np.ones(len(self.seen), bool)
        free[0], free[needed] = False, False
        others = np.flatnonzero(free)
        others = others[np.argsort(-self.seen[others], kind="stable")[: max(0, room - len(needed))]]
        sizes = pc.binary_length(self.strings).to_numpy()
        others = others[np.cumsum(sizes[others]) <= KEEP_BYTES // 2 - sizes[needed].sum()]
        kept = np.r_[0, needed[needed > 0], others]
        self.pool, self.counts = self.ids(kept)
        self.seen = self.seen[kept] // 2
        self.starts = np.cumsum(self.counts) - self.counts
        self.strings = self.strings.take(pa.array(kept))

    def entries(self, strings: pa.Array, learn) -> np.ndarray:
        """Entries of different strings; learn(new strings) gives the ids of those not held, flat, and their counts."""
        import pyarrow.compute as pc

        look = lambda: pc.fill_null(pc.index_in(strings, value_set=self.strings), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        found = look()
        missing = found < 0
        if missing.any():
            new = strings.filter(pa.array(missing))
            if len(self.strings) + len(new) > KEEP or self.strings.nbytes + new.nbytes > KEEP_BYTES:
                self.shrink(found[~missing], KEEP // 2 - len(new))
                found = look()
            flat, counts = learn(listed(new))
            found[missing] = np.arange(len(self.starts), len(self.starts) + len(new))
            self.strings = pa.concat_arrays([self.strings, new])
            self.starts = np.r_[self.starts, len(self.pool) + np.cumsum(counts) - counts]
            self.counts = np.r_[self.counts, counts]
            self.pool = np.r_[self.pool, flat]
            self.seen = np.r_[self.seen, np.zeros(len(new), np.int64)]
        self.seen[found] += 1
        return found

    def ids(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries, flat, and their counts."""
        counts = self.counts[entries]
        return gathered(self.pool, self.starts[entries], counts), counts


class ChunkEncoder:
    """Ids of whole texts, the end id included."""

    def __init__(self, path: str, end_id: int | None = END_ID):
        from tokenizers import Tokenizer, pre_tokenizers
        from tokenizers.models import BPE

        self.tokenizer = Tokenizer.from_file(path)
        model, steps = self.tokenizer.model, {k: getattr(self.tokenizer, k) for k in KNOWN}
        same = all(x is not None and json.loads(x.__getstate__()) == KNOWN[k] for k, x in steps.items())
        self.known = same and isinstance(model, BPE) and model.end_of_word_suffix == WORD_END and not model.dropout
        self.end = end_id
        self.special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        if not self.known:
            return
        # the file's model alone, for pieces that are split and written as byte characters already
        self.words = Tokenizer(model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab(False).items() if t.endswith(WORD_END)]] = True
        characters = byte_characters()
        self.letters = {ord(c): "".join(characters[b] for b in c.encode()) for c in map(chr, range(0xC0, 0x100))}
        self.pieces, self.others = Store(), Store()

    def piece_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        written = [p if p.isascii() else p.translate(self.letters) for p in pieces]
        found = self.words.encode_batch_fast([" ".join(written[i : i + AT_ONCE]) for i in range(0, len(written), AT_ONCE)], add_special_tokens=False)
        flat = np.concatenate([np.array(x.ids, np.uint32) for x in found])
        ends = np.flatnonzero(self.ends_word[flat]) + 1
        if len(ends) != len(pieces):
            raise ValueError("the tokenizer's model doesn't end each word with a word's end")
        return flat, np.diff(ends, prepend=0)

    def whole_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)

    def plain_entries(self, words: pa.Array, mixed: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries of the pieces of plain chunks: of words, a piece each; of the pieces of mixed ones, flat, and their numbers."""
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(mixed), PIECE, r"\1 "))
        coded = pa.concat_arrays([pc.utf8_lower(words), split.flatten()]).dictionary_encode()
        entries = self.pieces.entries(coded.dictionary, self.piece_ids)[coded.indices.to_numpy()]
        return entries[: len(words)], entries[len(words) :], split.value_lengths().to_numpy()

    def chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of different chunks: a pool of ids, and where each chunk's begin in it, and their counts."""
        import pyarrow.compute as pc

        matches = lambda pattern: pc.match_substring_regex(chunks, pattern).to_numpy(zero_copy_only=False)
        whole = matches(self.special) if self.special else np.zeros(len(chunks), bool)
        words = matches(LETTERS) & ~whole
        mixed = matches(PLAIN) & ~whole & ~words
        others = ~(words | mixed)
        one, pieces, n_pieces = self.plain_entries(chunks.filter(pa.array(words)), chunks.filter(pa.array(mixed)))
        two, n_two = self.pieces.ids(pieces)
        n_two = np.diff(np.r_[0, np.cumsum(n_two)][np.cumsum(n_pieces)], prepend=0)
        three = self.others.entries(chunks.filter(pa.array(others)), self.whole_ids)
        starts, counts = np.zeros((2, len(chunks)), np.int64)
        base = len(self.pieces.pool)
        starts[words], counts[words] = self.pieces.starts[one], self.pieces.counts[one]
        starts[mixed], counts[mixed] = base + np.cumsum(n_two) - n_two, n_two
        starts[others], counts[others] = base + len(two) + self.others.starts[three], self.others.counts[three]
        return np.concatenate([self.pieces.pool, two, self.others.pool]), starts, counts

    def __call__(self, texts: pa.Array | list[str | None]) -> Iterator[np.ndarray]:
        """The ids (u32) of each text; a null text is empty."""
        import pyarrow.compute as pc

        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        for part in slices(texts, PART_BYTES):
            if self.known:
                # only ASCII white space splits: any other is the tokenizer's business
                split = pc.ascii_split_whitespace(part.cast(pa.string()))
                coded = split.flatten().dictionary_encode()
                pool, starts, counts = self.chunk_ids(coded.dictionary)
                codes = coded.indices.to_numpy()
                flat, counts = gathered(pool, starts[codes], counts[codes]), counts[codes]
                ends = np.r_[0, np.cumsum(counts)][np.cumsum(split.value_lengths().to_numpy())]
            else:
                flat, counts = self.whole_ids(part.to_pylist())
                ends = np.cumsum(counts)
            if self.end is not None:
                flat, ends = np.insert(flat, ends, self.end), ends + np.arange(1, len(ends) + 1)
            flat, at = flat.astype("<u4", copy=False), 0
            for to in ends.tolist():
                yield flat[at:to]
                at = to
            tidy()


_encoders: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, end_id: int | None = END_ID) -> ChunkEncoder:
    """This worker's encoder: kept between tasks."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = ChunkEncoder(path, end_id)
    return _encoders[path, end_id]


def slices(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Slices of an array of texts of about most bytes."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield texts.slice(at, to - at)
        at = to


def parts(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about most bytes of a text column."""
    at = 0
    for part in slices(batch.column(column), most):
        yield batch.slice(at, len(part))
        at += len(part)


def dictionary_of(samples: list[bytes]) -> bytes:
    """A dictionary trained on samples; of very few or very small ones, themselves one after another."""
    import zstandard

    samples = sorted(set(samples))
    if len(samples) < TRAIN_LEAST or sum(map(len, samples)) < TRAIN_LEAST * TRAIN_LEAST:
        return b"".join(samples)[:DICT_BYTES]
    return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """The dictionary of TRAIN_DOCS texts chosen by hash. Only hashes are ordered; the texts chosen
    are encoded, and the dictionary trained, in one task."""
    short = docs.select(F.xxhash64("doc_id", "text").alias("h"), "text").where(F.length(text_of()) <= 4 * TRAIN_IDS)
    chosen = F.broadcast(short.select("h").distinct().orderBy("h").limit(TRAIN_DOCS))

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ChunkEncoder(tokenizer)
        samples = [ids[:TRAIN_IDS].tobytes() for batch in batches for ids in encode(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([pa.array([dictionary_of(samples)], pa.binary())], ["dictionary"])

    texts = short.join(chosen, "h", "left_semi").dropDuplicates(["h"]).select("text").repartition(1)
    made = texts.mapInArrow(trained, "dictionary binary").collect()
    return bytes(made[0]["dictionary"]) if made else b""


def _compressor(dictionary: bytes):
    import zstandard

    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)


def _decompressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()


def dictionary_hash(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest() if dictionary else bytes(32)


def make_pack(n_ids: list[int], frames: list[bytes], dict_hash: bytes) -> bytes:
    ends = np.cumsum([len(f) for f in frames])
    index = np.stack([np.array(n_ids, "<u4"), ends.astype("<u4")], axis=1)
    return MAGIC + struct.pack("<I", VERSION) + dict_hash + struct.pack("<I", len(frames)) + index.tobytes() + b"".join(frames)


class Pack:
    """Reads single documents of a pack."""

    HEAD = len(MAGIC) + 4 + 32 + 4

    def __init__(self, data: bytes, dictionary: bytes, decompressor=None):
        if data[:8] != MAGIC or struct.unpack_from("<I", data, 8)[0] != VERSION:
            raise ValueError("not a pack of this version")
        if data[12:44] != dictionary_hash(dictionary):
            raise ValueError("the pack was written with another dictionary")
        (self.n,) = struct.unpack_from("<I", data, 44)
        self.index = np.frombuffer(data, "<u4", 2 * self.n, self.HEAD).reshape(-1, 2)
        self.data, self.base, self.decompressor = data, self.HEAD + 8 * self.n, decompressor or _decompressor(dictionary)

    def document(self, i: int) -> np.ndarray:
        lo = int(self.index[i - 1, 1]) if i else 0
        raw = self.decompressor.decompress(self.data[self.base + lo : self.base + int(self.index[i, 1])])
        ids = np.frombuffer(raw, "<u4")
        if len(ids) != self.index[i, 0]:
            raise ValueError("a frame's length differs from the index")
        return ids


def write_tokens(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Writes docs' ids under path: dictionary/ and packs/. Texts are encoded where they are read and only
    compressed frames are moved; a document of any size is in one frame, a pack holds about PACK_BYTES."""
    spark = docs.sparkSession
    ship(spark)
    dictionary = train_dictionary(docs, tokenizer)
    spark.createDataFrame([(dictionary_hash(dictionary).hex(), bytearray(dictionary))], "hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    held = spark.sparkContext.broadcast(dictionary)

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, press = encoder(tokenizer), _compressor(held.value)
        for batch in batches:
            for part in parts(batch, "text"):
                sizes, frames = [], []
                for ids in encode(part.column("text")):
                    sizes.append(len(ids))
                    frames.append(press.compress(ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(frames, pa.binary())], ["doc_id", "n", "frame"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, total, row = dictionary_hash(held.value), 0, 0
        ids, sizes, frames, held_bytes = [], [], [], 0

        def out() -> pa.RecordBatch:
            made = make_pack(sizes, frames, name)
            arrays = [pa.array([row], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([total], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([made], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["row", "first_id", "n_ids", "doc_ids", "pack"])

        for batch in batches:
            for doc_id, n, frame in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "frame")), strict=True):
                ids.append(doc_id), sizes.append(n), frames.append(frame)
                total, held_bytes = total + n, held_bytes + len(frame) + 8
                if held_bytes >= PACK_BYTES:
                    yield out()
                    ids, sizes, frames, held_bytes, total, row = [], [], [], 0, 0, row + 1
        if frames:
            yield out()

    frames = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(framed, "doc_id long, n long, frame binary")
    frames = written(frames, "token-frames")
    ordered = frames.repartitionByRange("doc_id", F.xxhash64("frame")).sortWithinPartitions("doc_id", F.xxhash64("frame"), "frame")
    packs = ordered.mapInArrow(packed, "row long, first_id long, n_ids long, doc_ids array<long>, pack binary").withColumn("part", F.spark_partition_id())
    packs.write.option("compression", "uncompressed").parquet(f"{path}/packs")
    packs = spark.read.parquet(f"{path}/packs")
    # places: ids before a partition, then before a pack in it
    sums = packs.groupBy("part").agg(F.sum("n_ids").alias("all"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    places = packs.select("part", "row", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("at")).join(sums, "part")
    places.select("part", "row", (F.col("base") + F.col("at")).alias("start")).write.parquet(f"{path}/index")


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document, read from the files: doc_id, start, n_tokens and ids_crc32."""
    ship(spark)
    held = spark.sparkContext.broadcast(read_dictionary(spark, path))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = _decompressor(held.value)
        for batch in batches:
            for start, doc_ids, data in zip(*(batch.column(c) for c in ("start", "doc_ids", "pack")), strict=True):
                pack, at = Pack(data.as_py(), held.value, press), start.as_py()
                starts, sizes, sums = [], [], []
                for i in range(pack.n):
                    ids = pack.document(i)
                    starts.append(at), sizes.append(len(ids)), sums.append(zlib.crc32(ids))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([doc_ids.values, *(pa.array(x, pa.int64()) for x in (starts, sizes, sums))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    index = spark.read.parquet(f"{path}/index")
    packs = spark.read.parquet(f"{path}/packs").join(small(index, index.count()), ["part", "row"])
    return packs.select("start", "doc_ids", "pack").mapInArrow(opened, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_tokens(spark, path)

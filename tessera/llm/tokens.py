"""Encoding of a corpus with a public byte-level BPE tokenizer, by content-defined chunks.

A rolling hash over the last SPAN bytes picks cuts, so equal passages of different documents fall into equal chunks. The
hashes of all chunks are counted over the corpus; chunks that occur more than once are encoded once, into a written table,
and joined back to the documents that hold them, while what stands between them is encoded where it is. Which chunks may
recur is told to the workers by a map of FLAGS bits; where two chunks share a bit, a chunk that occurs once goes through
the table, too.

Then the joins are repaired. The tokenizer splits a text into pieces before it merges bytes, and white space that follows
a printable ASCII character starts a piece, whatever surrounds it. A join at such a place agrees with the encoding of the
whole text. At any other join the text from the last such place before it to the first one after it is encoded again, and
the tokens of both sides give way to the result; where a script has no such places, that is the whole text.

Within one worker, words and short runs of words are kept with their ids in a dictionary of at most KNOWN_BYTES.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import load, persisted, spread

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern of the tokenizer, as published with it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WINDOW = 6
#: One in CUT of the possible joins is a cut.
CUT = 4
KNOWN_BYTES = 128 << 20
#: Bytes that the hash of a chunk's cut covers, the share of places that are cuts, and the least distance of cuts.
SPAN, APART, LEAST = 16, 128, 32
#: Bits of the map of chunks that recur: what the driver and each worker hold of them, at any size of the corpus.
FLAGS = 1 << 24
SLICE_BYTES = 8 << 20

_TABLE = np.random.default_rng(6).integers(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 13, 32]] = True
_PRINTABLE = np.zeros(256, dtype=bool)
_PRINTABLE[33:127] = True


class Encoder:
    """The tokenizer and the dictionary of one worker."""

    _of: dict[str, Encoder] = {}

    def __init__(self, ranks: str) -> None:
        import tiktoken

        sent = SparkFiles.get(os.path.basename(ranks)) if SparkFiles._root_directory or SparkFiles._is_running_on_worker else ranks
        with open(sent if os.path.exists(sent) else ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.of_id = dict(zip(merges.values(), merges))
        self.lengths = np.zeros(max(self.of_id) + 1, dtype=np.int64)
        self.lengths[list(self.of_id)] = list(map(len, self.of_id.values()))
        self.encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    @classmethod
    def of(cls, ranks: str) -> Encoder:
        if ranks not in cls._of:
            cls._of[ranks] = cls(ranks)
        return cls._of[ranks]

    def chunk(self, text: bytes) -> bytes:
        """Ids of one chunk as int32 bytes."""
        ids = np.array(self.encode(text.decode()), dtype=np.int32).tobytes()
        self.held += len(text) + len(ids) + 150
        if self.held > KNOWN_BYTES:
            self.known.clear()
            self.held = 0
        self.known[text] = ids
        return ids

    def encoded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Ids of the chunks of the texts data[offsets[i]:offsets[i+1]], and the number of chunks before each text."""
        bounds = np.union1d(offsets, cuts(data))
        raw = data.tobytes()
        at = bounds.tolist()
        known, chunk, out = self.known, self.chunk, []
        for s, e in zip(at, at[1:]):
            part = raw[s:e]
            ids = known.get(part)
            out.append(chunk(part) if ids is None else ids)
        return out, np.searchsorted(bounds, offsets)


def rolled(data: np.ndarray, span: int) -> np.ndarray:
    """A hash of each `span` consecutive bytes: their table values, each turned by three bits for every byte behind it.

    Hashes of two adjacent stretches give that of both, so stretches double in length.
    """
    turned = lambda x, n: x if n % 32 == 0 else (x << np.uint32(n % 32)) | (x >> np.uint32(32 - n % 32))
    part, width, whole, covered = _TABLE[data], 1, None, 0
    while covered < span:
        if span & width:
            whole = part if whole is None else turned(whole[: len(part) - covered], 3 * width) ^ part[covered:]
            covered += width
        if covered < span:
            part = turned(part[:-width], 3 * width) ^ part[width:]
            width *= 2
    return (whole * np.uint32(2654435761)) >> np.uint32(16)


def cuts(data: np.ndarray) -> np.ndarray:
    """Positions in UTF-8 bytes where a text may be encoded in parts without repair, of those that the rolling hash picks."""
    if len(data) <= WINDOW:
        return np.empty(0, dtype=np.int64)
    picked = np.flatnonzero(rolled(data, WINDOW)[:-1] & np.uint32(CUT - 1) == 0) + WINDOW
    return picked[_WHITE[data[picked]] & _PRINTABLE[data[picked - 1]]]


def chunked(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bounds of the chunks of the texts data[offsets[i]:offsets[i+1]], ascending; each text's own bytes decide its cuts.

    A cut less than LEAST bytes after another one is none, so a run of one character isn't cut into single ones.
    """
    if len(data) <= SPAN:
        return np.unique(offsets)
    picked = np.flatnonzero(rolled(data, SPAN)[:-1] & np.uint32(APART - 1) == 0) + SPAN
    begun = offsets[np.searchsorted(offsets, picked, side="right") - 1]
    picked = picked[(picked - begun >= SPAN) & (data[picked] & 0xC0 != 0x80)]
    return np.union1d(offsets, picked[np.diff(picked, prepend=-LEAST) >= LEAST])


def digests(raw: bytes, bounds: list[int]) -> np.ndarray:
    """128-bit hashes (two int64 a row) of the chunks between the bounds."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[s:e]) for s, e in zip(bounds, bounds[1:])), dtype=np.int64).reshape(-1, 2)


def safe(data: np.ndarray) -> np.ndarray:
    """Positions where a piece starts whatever surrounds them, ascending."""
    return np.flatnonzero(_WHITE[data[1:]] & _PRINTABLE[data[:-1]]) + 1


def repaired(ids: np.ndarray, joins: np.ndarray, encoder: Encoder, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of whole texts, given ids that were encoded apart before and after the token positions `joins`.

    `starts` are the positions where texts start, and the end; one text if not given. Returns the ids and their starts.
    """
    starts = np.array([0, len(ids)]) if starts is None else starts
    before = np.concatenate(([0], np.cumsum(encoder.lengths[ids])))
    raw = b"".join(map(encoder.of_id.__getitem__, ids.tolist()))
    places = np.union1d(before[starts], safe(np.frombuffer(raw, dtype=np.uint8)))
    at = before[joins]
    after = np.searchsorted(places, at)
    after = np.unique(after[places[after] != at])  # joins at such places agree already; several within one stretch are one
    if not len(after):
        return ids, starts
    from_, to = places[after - 1], places[after]
    first, last = np.searchsorted(before, from_), np.searchsorted(before, to)
    known, chunk, flat = encoder.known, encoder.chunk, ids.astype(np.uint32, copy=False).tobytes()
    out, sizes, done = [], [], 0
    for s, e, f, t in zip(from_.tolist(), to.tolist(), (4 * first).tolist(), (4 * last).tolist()):
        part = known.get(raw[s:e])
        part = chunk(raw[s:e]) if part is None else part
        out += [flat[done:f], part]
        sizes.append(len(part) // 4)
        done = t
    out.append(flat[done:])
    more = np.concatenate(([0], np.cumsum(np.array(sizes) - (last - first))))
    return np.frombuffer(b"".join(out), dtype=np.uint32), starts + more[np.searchsorted(last, starts, side="right")]


def _send(spark: SparkSession, ranks: str) -> None:
    """Has the vocabulary file sent to the workers, which need not have it at its path."""
    if os.path.basename(ranks) not in {os.path.basename(f) for f in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(ranks)


def slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(from row, to row, UTF-8 bytes, offsets, is null) of stretches of a text column of about SLICE_BYTES or one text each."""
    texts = batch.column(column)
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.empty(0, dtype=np.uint8)
    null = np.asarray(texts.is_null())
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        yield at, min(to, len(texts)), data[offsets[at] : offsets[min(to, len(texts))]], offsets[at : to + 1] - offsets[at], null[at:to]
        at = to


_HASH = pa.struct([("hi", pa.int64()), ("lo", pa.int64())])
_PART = "struct<hi: long, lo: long>"


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), type=pa.int32()), values)


def _hashes(h: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1])], fields=list(_HASH))


def chunk_hashes(texts: DataFrame) -> DataFrame:
    """(hi, lo) of each chunk of the texts, one row an occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets, _ in slices(batch, 0):
                h = digests(data.tobytes(), chunked(data, offsets).tolist())
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1])], names=["hi", "lo"])

    return texts.mapInArrow(run, "hi long, lo long")


def recurring(texts: DataFrame) -> bytes:
    """The map of FLAGS bits (packed, least bit first) on which chunks fall that occur more than once in the corpus."""
    often = chunk_hashes(texts).groupBy("hi", "lo").agg(F.count("*").alias("n")).filter("n > 1")
    bit = F.pmod(F.col("lo"), F.lit(FLAGS)) + 1
    parts = often.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    flags = bytearray(FLAGS // 8)
    for row in parts.collect():  # FLAGS bits in all, whatever the corpus
        at = (row["part"] - 1) * len(row["bits"])
        flags[at : at + len(row["bits"])] = row["bits"]
    return bytes(flags)


def token_ids(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """(id_col, ids ARRAY<INT>) of each row; null and empty texts give an empty list. No special tokens: strings that
    look like them are ordinary text. Rows are kept as they are, repeated ones too; other columns are ignored."""
    spark = documents.sparkSession
    _send(spark, ranks)
    documents = spread(documents.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).alias("text")))
    flags = spark.sparkContext.broadcast(recurring(documents.select("text")))

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Encodes what is between chunks that may recur, and leaves holes for those."""
        encoder, bits = Encoder.of(ranks), np.frombuffer(flags.value, dtype=np.uint8)
        given: set[bytes] = set()
        for batch in batches:
            for at, to, data, offsets, _ in slices(batch, 1):
                bounds = chunked(data, offsets)
                raw, starts = data.tobytes(), bounds[:-1]
                h = digests(raw, bounds.tolist())
                bit = h[:, 1].astype(np.uint64) & np.uint64(FLAGS - 1)
                hole = bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 == 1
                # stretches: the chunks without holes between two holes or ends of a text, encoded as one
                sizes = np.diff(bounds)
                kept = data[np.repeat(~hole, sizes)]
                begins = np.flatnonzero(hole | np.concatenate(([False], hole))[:-1] | np.isin(starts, offsets))
                begun = np.concatenate(([0], np.cumsum(np.where(hole, 0, sizes))))[np.append(begins, len(starts))]
                parts, first = encoder.encoded(kept, begun)
                count = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4)))[first]
                of_text = np.searchsorted(bounds, offsets)
                ids = np.frombuffer(b"".join(parts), dtype=np.int32).astype(np.uint32)
                whole = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer((4 * count[np.searchsorted(begins, of_text)]).astype(np.int32)), pa.py_buffer(ids)])
                where = np.flatnonzero(hole)
                holes = np.diff(np.searchsorted(where, of_text))
                place = count[np.searchsorted(begins, where)] - np.repeat(count[np.searchsorted(begins, of_text[:-1])], holes)
                fresh = []
                if len(given) > 1 << 20:
                    given.clear()
                for n in where.tolist():
                    key = h[n].tobytes()
                    if key not in given:
                        given.add(key)
                        fresh.append(n)
                texts = pa.array([raw[bounds[n] : bounds[n + 1]] for n in fresh], type=pa.binary())
                new = pa.StructArray.from_arrays([pa.array(h[fresh, 0]), pa.array(h[fresh, 1]), texts], names=["hi", "lo", "chunk"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), whole, _lists(holes, pa.array(place, type=pa.int32())), _lists(holes, _hashes(h[where])), _lists(np.where(np.arange(to - at) == 0, len(fresh), 0), new)],
                    names=["row", "ids", "place", "hole", "new"],
                )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(ranks)
        for b in batches:
            ids = [np.array(encoder.encode(x.decode()), dtype=np.uint32).tobytes() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, type=pa.binary())], names=["hi", "lo", "ids"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(ranks)
        for batch in batches:
            tokens = pc.binary_length(batch.column(1)).to_numpy() // 4
            ends = np.cumsum(tokens)
            at = 0
            while at < len(tokens):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] - tokens[at] + SLICE_BYTES // 4, side="right")))
                yield filled(batch.slice(at, to - at), encoder)
                at = to

    def filled(b: pa.RecordBatch, encoder: Encoder) -> pa.RecordBatch:
        starts = np.concatenate(([0], np.cumsum(pc.binary_length(b.column(1)).to_numpy() // 4))).astype(np.int64)
        flat = b"".join(b.column(1).to_pylist())
        holes = np.concatenate(([0], np.cumsum(np.diff(b.column(2).offsets.to_numpy()))))
        pairs = lambda x: zip(x.field(0).to_pylist(), x.field(1).to_pylist())
        given = b.column(4).flatten()
        of = dict(zip(pairs(given), given.field(2).to_pylist()))
        parts = [of[k] for k in pairs(b.column(3).flatten())]
        place = b.column(2).flatten().to_numpy() + np.repeat(starts[:-1], np.diff(holes))
        out, done = [], 0
        for p, part in zip((4 * place).tolist(), parts):
            out += [flat[done:p], part]
            done = p
        out.append(flat[done:])
        # what was filled in moves what follows; both ends of a hole are joins
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        moved = np.concatenate(([0], np.cumsum(sizes)))
        ids, starts = np.frombuffer(b"".join(out), dtype=np.uint32), starts + moved[holes]
        if parts:
            ids, starts = repaired(ids, np.unique(np.concatenate((place + moved[:-1], place + moved[1:]))), encoder, starts)
        lists = pa.ListArray.from_arrays(pa.array(starts, type=pa.int32()), pa.array(ids.view(np.int32)))
        return pa.RecordBatch.from_arrays([b.column(0), lists], names=["row", "ids"])

    schema = f"row long, ids binary, place array<int>, hole array<{_PART}>, new array<struct<hi: long, lo: long, chunk: binary>>"
    partial = persisted(documents.mapInArrow(partly, schema).withColumn("key", F.monotonically_increasing_id()))
    chunks = partial.select(F.explode("new").alias("n")).select("n.*").dropDuplicates(["hi", "lo"])
    dictionary = persisted(chunks.mapInArrow(encode, "hi long, lo long, ids binary"))
    holed = partial.filter(F.size("hole") > 0)
    wanted = holed.select("key", F.explode(F.array_distinct("hole")).alias("h")).select("key", "h.*")
    found = wanted.join(dictionary, ["hi", "lo"]).groupBy("key").agg(F.collect_list(F.struct("hi", "lo", "ids")).alias("found"))
    of = lambda df, found: df.select("row", "ids", "place", "hole", found).mapInArrow(fill, "row long, ids array<int>")
    none = F.lit(None).cast("array<struct<hi: long, lo: long, ids: binary>>").alias("found")
    return of(holed.join(found, "key"), "found").union(of(partial.filter(F.size("hole") == 0), none)).withColumnRenamed("row", id_col)


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, id_type: str = "long") -> DataFrame:
    """(id_col, tokens INT) of each row; 0 for null and empty texts. Nothing but counts leaves the workers, so texts are
    encoded where they are, in parts whose joins agree without repair."""
    _send(documents.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(ranks)
        for batch in batches:
            for at, to, data, offsets, _ in slices(batch, 1):
                chunks, first = encoder.encoded(data, offsets)
                sizes = np.concatenate(([0], np.cumsum(np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks)) // 4)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(np.diff(sizes[first]), type=pa.int32())], names=[id_col, "tokens"])

    return spread(documents.select(id_col, text_col)).mapInArrow(run, f"{id_col} {id_type}, tokens int")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids): the token ids of each document by byte_bpe_50k."""
    return token_ids(load(spark, sf_dir, "documents"))


def p6_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens by language tag."""
    documents = load(spark, sf_dir, "documents").select(F.lower(F.trim("lang")).alias("lang"), "text")
    return token_counts(documents, "lang", id_type="string").groupBy("lang").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))


QUERIES = {"p6_ids": p6_ids, "p6_profile": p6_profile}
SQL: dict[str, str] = {}

"""Token-ID / binary output: documents as BPE ids in Simple-8b blocks.

A payload holds ids in blocks of `BLOCK`; each block starts on a word of its own and a table gives
its offset, so any block decodes alone. A 64-bit word has a 4-bit selector and 60 bits of values;
selector 15 escapes: the next word is one raw value.

    magic "TS8B" | u32 version | u64 ids | u64 blocks | u64 words | u64 offset * blocks | u64 word * words

Payloads are the rows of a Parquet table (part, segment, before, doc_ids, lengths, n_ids, payload), where
before counts the ids of the part's earlier segments. Spark's committer writes it, so a lost executor leaves no half-written file and any store that Spark reads will do.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mixed, shared_dir, small_batches

BLOCK = 4096
MAGIC = b"TS8B"
END_ID = 2
SEGMENT_IDS = 1 << 20
ESCAPE = 15
# Fixed values of Simple-8b: how many values of how many bits a selector packs.
PACKS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]


def _selectors(values: np.ndarray) -> np.ndarray:
    """For each position of blocks (rows of equal length) the selector that packs most values from it, ESCAPE where none does."""
    length = values.shape[1]
    at = np.arange(length, dtype=np.int32)
    best = np.full(values.shape, ESCAPE, np.uint8)
    top = int(values.max()) if values.size else 0
    for selector in range(len(PACKS) - 1, -1, -1):
        count, bits = PACKS[selector]
        if length < count:
            continue
        if top >> bits == 0:
            best[:, : length - count + 1] = selector
            continue
        wide = values >= values.dtype.type(1 << bits)
        if wide.size - np.count_nonzero(wide) < count:
            continue
        next_wide = np.minimum.accumulate(np.where(wide, at, np.int32(length))[:, ::-1], axis=1)[:, ::-1]
        best[next_wide - at >= count] = selector
    return best


def pack_rows(values: np.ndarray) -> list[np.ndarray]:
    """Blocks of equal length as Simple-8b words; all blocks take their next step together."""
    rows, length = values.shape
    best = np.concatenate([_selectors(values), np.full((rows, 1), len(PACKS) + 2, np.uint8)], axis=1)
    counts = np.array([count for count, _ in PACKS] + [1, 1, 0], np.int64)
    flat = best.ravel()
    base = np.arange(rows, dtype=np.int64) * (length + 1)
    place, ends, taken = base.copy(), base + length, []
    while (place < ends).any():
        taken.append(place)
        place = place + counts[flat[place]]
    steps = np.array(taken, np.int64).reshape(len(taken), rows).T
    live = steps < ends[:, None]
    starts = steps[live]
    chosen = flat[starts]
    starts = starts - starts // (length + 1)
    source = values.ravel().astype(np.uint64)
    widths = 1 + (chosen == ESCAPE)
    at = np.cumsum(widths) - widths
    out = np.zeros(int(widths.sum()), np.uint64)
    for selector in np.unique(chosen):
        mine = chosen == selector
        if selector == ESCAPE:
            out[at[mine]] = np.uint64(ESCAPE << 60)
            out[at[mine] + 1] = source[starts[mine]]
            continue
        count, bits = PACKS[selector]
        word = np.full(int(mine.sum()), int(selector) << 60, np.uint64)
        for k in range(count):
            word |= source[starts[mine] + k] << np.uint64(k * bits)
        out[at[mine]] = word
    owner = np.repeat(np.arange(rows), live.sum(1))
    sizes = np.bincount(owner, weights=widths, minlength=rows).astype(np.int64)
    return np.split(out, np.cumsum(sizes)[:-1])


def unpack(words: np.ndarray) -> np.ndarray:
    """The values of one block, all words of a selector at once."""
    words = np.asarray(words, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    if (selector == ESCAPE).any():  # the word after an escape is raw, whatever its top bits say
        raw = np.zeros(len(words), bool)
        for i in np.flatnonzero(selector == ESCAPE):
            if not raw[i]:
                raw[i + 1] = True
        plain = ~raw
    else:
        raw, plain = None, slice(None)
    heads, chosen = words[plain], selector[plain]
    counts = np.array([count for count, _ in PACKS] + [1, 1])[chosen]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in np.unique(chosen):
        mine = chosen == s
        start = (ends - counts)[mine]
        if s == ESCAPE:
            out[start] = words[raw]
            continue
        count, bits = PACKS[s]
        mask = np.uint64((1 << bits) - 1)
        for k in range(count):
            out[start + k] = (heads[mine] >> np.uint64(k * bits)) & mask
    return out


def encode(values: np.ndarray, block: int = BLOCK) -> bytes:
    """A payload of any number of non-negative integers below 2**64."""
    values = np.asarray(values)
    values = values.astype(np.uint32 if not values.size or int(values.max()) < 1 << 31 else np.uint64)
    full = len(values) // block * block
    packed = pack_rows(values[:full].reshape(-1, block)) if full else []
    packed += pack_rows(values[full:].reshape(1, -1)) if len(values) > full else []
    sizes = np.array([len(x) for x in packed], np.uint64)
    offsets = (np.cumsum(sizes) - sizes).astype("<u8")
    body = np.concatenate(packed).astype("<u8") if packed else np.zeros(0, "<u8")
    head = MAGIC + struct.pack("<IQQQ", 1, len(values), len(packed), len(body))
    return head + offsets.tobytes() + body.tobytes()


def decode(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks first to last (exclusive) of a payload, all by default."""
    if payload[:4] != MAGIC:
        raise ValueError("not a Simple-8b payload")
    _, count, blocks, size = struct.unpack_from("<IQQQ", payload, 4)
    offsets = np.frombuffer(payload, "<u8", blocks, 32)
    body = np.frombuffer(payload, "<u8", size, 32 + 8 * blocks)
    last = blocks if last is None else min(last, blocks)
    ends = np.append(offsets[1:], size)
    parts = [unpack(body[int(offsets[b]) : int(ends[b])]) for b in range(first, last)]
    out = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if first == 0 and last == blocks and len(out) != count:
        raise ValueError("a Simple-8b payload is damaged")
    return out


_CACHES: dict[str, _Encoder] = {}
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = 32
PIECE_BYTES = 32  # longest piece that the table holds
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_WHITE, _LETTER, _STOP = 1, 2, 3
_KIND = np.zeros(256, np.uint8)  # of ASCII bytes: white space, letters, and marks that end a run of letters
for _b in range(128):
    _c = chr(_b)
    _KIND[_b] = _WHITE if _c in " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f" else _LETTER if _c.isalpha() else 0 if _c.isdigit() or _c == "'" else _STOP
_KIND[10] = _WHITE


def _powers(n: int, base: int) -> np.ndarray:
    """base ** k modulo 2**64 for k below n."""
    out = np.ones(max(n, 1), np.uint64)
    size, step = 1, base
    with np.errstate(over="ignore"):
        while size < n:
            more = min(size, n - size)
            out[size : size + more] = out[:more] * np.uint64(step)
            size, step = size + more, step * step % (1 << 64)
    return out


class _Table:
    """Ids of pieces by a 64-bit hash: open addressing in arrays, looked up for many pieces at once.

    A slot holds the piece's bytes and length too, so that a hash that two pieces share is found out.
    """

    def __init__(self, bits: int = 20):
        self.bits = bits
        self.keys = np.zeros(1 << bits, np.uint64)
        self.starts = np.zeros(1 << bits, np.int64)
        self.sizes = np.zeros(1 << bits, np.int32)
        self.heads = np.zeros(1 << bits, np.uint64)
        self.spans = np.zeros(1 << bits, np.uint8)
        self.tails = np.zeros((1 << bits, PIECE_BYTES // 8 - 1), np.uint64)
        self.values = np.zeros(1 << 16, np.uint16)
        self.used = self.filled = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or of the free place where it would go."""
        mask = np.int64((1 << self.bits) - 1)
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[slot]
        open_ = np.flatnonzero((there != keys) & (there != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            there = self.keys[slot[open_]]
            open_ = open_[(there != keys[open_]) & (there != 0)]
        return slot

    def differs(self, slot: np.ndarray, pieces: tuple[np.ndarray, ...]) -> np.ndarray:
        """Which of the slots hold other pieces than these."""
        spans, heads, longer, tails = pieces
        out = (self.heads[slot] != heads) | (self.spans[slot] != spans)
        out[longer] |= (self.tails[slot[longer]] != tails).any(1)
        return out

    def add(self, keys: np.ndarray, pieces: tuple[np.ndarray, ...], sizes: np.ndarray, values: np.ndarray) -> None:
        """New distinct keys with their pieces and their ids in a row."""
        if self.used + len(keys) > len(self.keys) // 2:
            self.keys[:] = 0
            self.used = self.filled = 0
        if self.filled + len(values) > len(self.values):
            self.values = np.concatenate([self.values[: self.filled], np.zeros(max(len(self.values), len(values)), np.uint16)])
        self.values[self.filled : self.filled + len(values)] = values
        starts = self.filled + np.cumsum(sizes) - sizes
        tails = np.zeros((len(keys), self.tails.shape[1]), np.uint64)
        tails[pieces[2]] = pieces[3]
        left = np.arange(len(keys))
        while len(left):  # keys that want one place take turns
            slot = self.find(keys[left])
            _, first = np.unique(slot, return_index=True)
            now = left[first]
            self.keys[slot[first]], self.heads[slot[first]], self.spans[slot[first]] = keys[now], pieces[1][now], pieces[0][now]
            self.tails[slot[first]] = tails[now]
            self.starts[slot[first]], self.sizes[slot[first]] = starts[now], sizes[now]
            keep = np.ones(len(left), bool)
            keep[first] = False
            left = left[keep]
        self.used += len(keys)
        self.filled += len(values)


class _Encoder:
    """Ids of whole texts by the tokenizers library.

    The byte-level pre-tokenizer never joins what a single space parts, letters and a mark after them, or
    a single line feed and what follows, so texts are cut there. Pieces that a worker has met come from a
    table by their hash and bytes, all of a batch at once; new ones go to the library together. Texts with
    other white space at a cut, a piece over PIECE_BYTES or a special token's string go to it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.narrow = max(vocabulary.values()) < 1 << 16
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # one character of the alphabet stands for one byte
            self.lengths[i] = len(token)
        self.table = _Table()
        self.power, self.inverse = _powers(1, _BASE), _powers(1, 1)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16 if self.narrow else np.uint32)

    def _hashes(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Polynomial hashes of pieces, their length mixed in; never zero."""
        n = len(flat) + 1
        if len(self.power) < n:
            self.power, self.inverse = _powers(2 * n, _BASE), _powers(2 * n, pow(_BASE, -1, 1 << 64))
        with np.errstate(over="ignore"):
            total = np.zeros(n, np.uint64)
            np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * self.power[: n - 1], out=total[1:])
            return mixed((total[ends] - total[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)

    @staticmethod
    def _pieces(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Lengths and first eight bytes of pieces, and for those that are longer (the third array) the rest, eight bytes to a number."""
        room = np.concatenate([flat, np.zeros(PIECE_BYTES + 8, np.uint8)])
        eights = np.ndarray((len(room) - 7,), "<u8", room.data, 0, (1,))
        size = np.minimum(ends - starts, 255)
        longer = np.flatnonzero(size > 8)
        tails = np.empty((len(longer), PIECE_BYTES // 8 - 1), np.uint64)
        for k in range(1, PIECE_BYTES // 8):
            tails[:, k - 1] = eights[starts[longer] + 8 * k] & _LOW[np.clip(size[longer] - 8 * k, 0, 8)]
        return size.astype(np.uint8), eights[starts] & _LOW[np.minimum(size, 8)], longer, tails

    def batch(self, texts: list[str], size: int = 1 << 20) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers, about `size` characters at a time."""
        out, held, n = [], [], 0
        for text in texts:
            held.append(text)
            n += len(text)
            if n >= size:
                out += self._batch(held)
                held, n = [], 0
        return out + self._batch(held) if held else out

    def _batch(self, texts: list[str]) -> list[bytes]:
        raws = [("" if "<|" in t else t).encode() for t in texts]
        flat = np.frombuffer(b" " + b" ".join(raws) + b" ", np.uint8)  # a space around each text, which is none of it
        text_ends = np.cumsum(np.array([len(r) for r in raws], np.int64) + 1)
        text_starts = text_ends - np.array([len(r) for r in raws], np.int64)
        kind = _KIND[flat]
        edge = np.zeros(len(flat), bool)
        edge[0] = edge[text_ends] = True
        blank = kind == _WHITE
        letter = kind == _LETTER
        letter[1:] |= (flat[:-1] == 0xC3) & (flat[1:] != 0x97) & (flat[1:] != 0xB7)  # Latin letters of two bytes
        cut = (flat == _SPACE) & ~edge
        odd_at = np.flatnonzero(cut[1:-1] & ((blank[:-2] & ~edge[:-2]) | (blank[2:] & ~edge[2:]))) + 1
        cut[1:] |= ((kind[1:] == _STOP) | (flat[1:] == 10)) & letter[:-1]
        cut[2:] |= (flat[1:-1] == 10) & ~blank[:-2] & ~blank[2:]
        cut[text_starts] = True
        cut[text_ends] = False
        starts = np.flatnonzero(cut)
        owner = np.searchsorted(text_ends, starts, "right")
        ends = np.minimum(np.append(starts[1:], len(flat)), text_ends[owner])
        keys, pieces = self._hashes(flat, starts, ends), self._pieces(flat, starts, ends)
        odd = np.zeros(len(texts), bool)
        odd[owner[ends - starts > PIECE_BYTES]] = True
        odd[np.searchsorted(text_ends, odd_at, "right")] = True
        slot = self.table.find(keys)
        missing = np.flatnonzero((self.table.keys[slot] != keys) & ~odd[owner])
        if len(missing):
            _, first = np.unique(keys[missing], return_index=True)
            new = missing[first]
            self._learn(flat, starts[new], ends[new], keys[new])
            slot = self.table.find(keys)
        # a piece that stays unknown, or whose hash another has, sends its text whole
        odd[owner[(self.table.keys[slot] != keys) | self.table.differs(slot, pieces)]] = True
        counts = self.table.sizes[slot].astype(np.int64)
        counts[odd[owner]] = 0
        out_ends = np.cumsum(counts)
        ids = self.table.values[np.repeat(self.table.starts[slot] - (out_ends - counts), counts) + np.arange(out_ends[-1] if len(out_ends) else 0)].astype("<u4")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, counts, len(texts)).astype(np.int64))])
        raw = ids.tobytes()
        out = []
        for k, text in enumerate(texts):
            plain = not odd[k] and (raws[k] or not text)
            out.append(raw[4 * bounds[k] : 4 * bounds[k + 1]] if plain else self.whole(text).astype("<u4").tobytes())
        return out

    def _learn(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        """Make pieces known, save those with white space beyond ASCII at an end."""
        raw = flat.tobytes()
        spaced, names, bare, parts = [], [], [], []
        for k, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            piece = raw[s:e].decode()
            if piece and not piece[0].isascii() and piece[0].isspace() or not piece[-1:].isascii() and piece[-1:].isspace() or not piece[1:2].isascii() and piece[1:2].isspace():
                continue
            if piece[:1] == " " and len(piece) > 1 and not piece[-1].isspace():
                spaced.append(k)
                names.append(piece)
            else:
                bare.append(k)
                parts.append(piece)
        kind = np.uint16 if self.narrow else np.uint32
        if names:
            at = np.array(spaced)
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(names)], add_special_tokens=False)[0].ids, kind)
            cuts = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(ends[at] - starts[at])) + 1
            self.table.add(keys[at], self._pieces(flat, starts[at], ends[at]), np.diff(cuts, prepend=0).astype(np.int32), ids)
        if parts:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
            self.table.add(keys[bare], self._pieces(flat, starts[bare], ends[bare]), np.array([len(v) for v in found], np.int32), np.array([i for v in found for i in v], kind))


def encoder(path: str) -> _Encoder:
    if path not in _CACHES:
        _CACHES[path] = _Encoder(path)
    return _CACHES[path]


def write_tokens(docs: DataFrame, tokenizer_path: str, out: str) -> None:
    """Write the ids of docs(doc_id, text) to a table at out, documents in ascending doc_id order, null ids first.

    A null text counts as empty; a document ends with id 2; repeated rows are written as often as they
    come. Documents are dealt by ranges of (doc_id, hash of the text), so that a repeated doc_id spreads.
    A partition writes segments of about a million ids; a longer document makes one long segment.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kept = kept.withColumn("h", F.xxhash64("text"))
    dealt = kept.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    schema = "part int, segment int, before long, doc_ids array<long>, lengths array<int>, n_ids long, payload binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, segment, before = TaskContext.get().partitionId(), 0, 0
        encoded = encoder(tokenizer_path)
        end = np.array([END_ID], "<u4").tobytes()
        ids, held, lengths = [], [], []

        def flush() -> pa.RecordBatch:
            values = np.frombuffer(b"".join(ids), "<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([len(values)], pa.int64()), pa.array([encode(values)], pa.binary())],
                ["part", "segment", "before", "doc_ids", "lengths", "n_ids", "payload"],
            )

        total = 0
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), encoded.batch(batch.column(1).to_pylist()), strict=True):
                raw += end
                ids.append(raw)
                held.append(doc)
                lengths.append(len(raw) // 4)
                total += lengths[-1]
                if total >= SEGMENT_IDS:
                    yield flush()
                    before += total
                    ids, held, lengths, total, segment = [], [], [], 0, segment + 1
        if held:
            yield flush()

    dealt.select("doc_id", "text").mapInArrow(work, schema).write.option("compression", "uncompressed").option("parquet.block.size", str(16 << 20)).parquet(out)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a table of write_tokens: doc_id, start, n_tokens, ids_crc32, decoded from the payloads.

    The driver holds one count a part, and only these are joined: a segment knows its place in its part.
    """
    rows = spark.read.parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    starts, at = [], 0
    for r in totals:
        starts.append((r["part"], at))
        at += r["n"]
    # a row a write task, so that payloads stay where they are
    joined = rows.join(F.broadcast(spark.createDataFrame(starts, "part int, base long")), "part").withColumn("first", F.col("base") + F.col("before"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, docs, lengths, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = memoryview(decode(payload).astype("<u4").tobytes())
                sizes = np.array(lengths, np.int64)
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(ends - sizes + first), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    small_batches(spark)
    return joined.select("first", "doc_ids", "lengths", "payload").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str | None = None, out: str | None = None) -> DataFrame:
    """Write docs as token ids and return what reading them back gives.

    An empty table gives an empty table; extra columns of docs are ignored, whatever their names.
    """
    import public_tokenizers

    out = out or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"), out)
    return read_tokens(docs.sparkSession, out)

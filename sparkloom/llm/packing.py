"""Best-fit packing by hierarchical residuals.

``tokenise`` turns every document into pieces of at most ``capacity`` tokens (only longer documents are
cut). ``pack`` fills sequences: each partition packs its pieces best-fit (longest first, each into the
fullest sequence that still holds it) and emits the nearly full sequences; the underfull ones become
items of the next round, over fewer partitions, until one partition holds what is left or a round no
longer joins any. A task never holds more than ``fan_in`` items of a round's merge.

Defined cases: null text is the empty text (one token, id 0); repeated rows are packed as often as they
occur; a null doc_id is carried along; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from unicodedata import category, is_normalized, normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, trimmed, with_text
from .words import chunks, utf8

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Items that one task of a merge round may hold.
FAN_IN = 20_000
#: A sequence with no more than this share free is emitted at once.
SLACK = 0.01
#: Entries of a worker's cache; a full one is emptied, which changes speed only.
CACHE = 300_000
CHUNK_BYTES = 8 << 20

_TAIL = ".,*%$#&!|;:?"
#: Letters whose kind and lower case are the same in every edition of Unicode's tables; other words are left to the tokenizer.
_SETTLED = re.compile("[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0386-\u03ff\u0400-\u0481\u048a-\u052f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(hidden)) for b in range(256)}


class WordEncoder:
    """The tokenizer's ids of whole texts as arrays, through a cache of words.

    The tokenizer drops white space and never merges across it, nor between a letter or digit and
    punctuation, so a text's ids are those of its words in a row. Words are split at the space and the
    newline alone; every other character is left to the tokenizer. Punctuation at a word's end is taken off
    only where a letter or digit stands before it once the word is normalised and in lower case, as either step
    can leave a combining mark there, which punctuation joins. A word of settled letters in normal form
    goes to its merges directly, as the steps before them would leave it as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.cores = Tokenizer.from_file(path), {}
        self.letters = _byte_letters()

    def _core(self, text: str) -> bytes:
        ids = self.cores.get(text)
        if ids is None:
            low = text.lower()
            if _SETTLED.fullmatch(text) and text.isalpha() and low.isalpha() and "\u03a3" not in text and is_normalized("NFC", text):
                found = [t.id for t in self.tokenizer.model.tokenize(low.encode().decode("latin-1").translate(self.letters))]
            else:
                found = self.tokenizer.encode(text, add_special_tokens=False).ids
            if len(self.cores) >= CACHE:
                self.cores.clear()
            self.cores[text] = ids = struct.pack(f"<{len(found)}I", *found)
        return ids

    @staticmethod
    def _ends_in_letter(core: str) -> bool:
        if core.isascii():
            return core[-1].isalnum()
        low = normalize("NFC", core).lower()
        return category(low[-1])[0] in "LN" and (low[-1].isascii() or _SETTLED.fullmatch(low[-1]) is not None)

    def word(self, word: str) -> bytes:
        core = word.rstrip(_TAIL)
        if not core or not self._ends_in_letter(core):
            return self._core(word) if word else b""
        ids = self._core(core.lower() if core.isascii() and "<|" not in core else core)
        return ids + self._core(word[len(core) :]) if len(core) < len(word) else ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's begin (one longer than texts)."""
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        of = [self.word(w) for w in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, of), np.int64, len(of)) // 4
        ids, begin = np.frombuffer(b"".join(of), "<u4"), np.cumsum(size) - size
        index = coded.indices.to_numpy()
        count = size[index]
        ends = np.cumsum(count)
        flat = ids[np.repeat(begin[index] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        words_before = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))])
        return flat, np.concatenate([[0], ends])[words_before]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def tokenise(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32."""
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), struct.pack("<I", 0)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets, CHUNK_BYTES):
                flat, begin = encode.encode(batch.column(1).slice(i, j - i))
                out: list[tuple] = []
                for doc, a, b in zip(batch.column(0).slice(i, j - i).to_pylist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                    raw = flat[a:b].tobytes() + end
                    for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        out.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return with_text(docs).mapInArrow(trimmed(run), PIECES)


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[int]:
    """Bin of each item: longest item first, into the open bin with the least room that still holds it."""
    order = sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True)
    rooms: dict[int, list[int]] = {}
    open_rooms, bins, where = 0, 0, [0] * len(lengths)
    for i in order:
        n = lengths[i]
        fitting = open_rooms >> n
        if n < capacity and fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            held = rooms[room]
            b = held.pop()
            if not held:
                open_rooms &= ~(1 << room)
        else:
            room, b, bins = capacity, bins, bins + 1
        where[i] = b
        if left := room - n:
            rooms.setdefault(left, []).append(b)
            open_rooms |= 1 << left
    return where


_BIN = "load long, n long, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"


def _local_round(capacity: int, slack: float, first: bool):
    """Pack the items of a partition; an item is a piece (first round) or a sequence with its members."""
    full_at = capacity - int(capacity * slack)
    member = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])

    def flush(items: list) -> pa.RecordBatch:
        where = best_fit([x[0] for x in items], capacity)
        bins: dict[int, list] = {}
        for b, x in zip(where, items, strict=True):
            bins.setdefault(b, []).append(x)
        load, n, members = [], [], []
        for held in bins.values():
            at, row = 0, []
            for size, inner in held:
                row += [m | {"offset": m["offset"] + at} for m in inner]
                at += size
            load.append(at)
            n.append(len(row))
            members.append(row)
        return pa.RecordBatch.from_arrays([pa.array(load, pa.int64()), pa.array(n, pa.int64()), pa.array(members, pa.list_(member))], names=["load", "n", "members"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list = []
        for batch in batches:
            if first:
                items += [(r["length"], [r | {"offset": 0}]) for r in batch.to_pylist()]
            else:
                items += list(zip(batch.column("load").to_pylist(), batch.column("members").to_pylist(), strict=True))
            # a partition larger than the bound is packed in parts; what stays underfull meets again in the next round
            while len(items) >= FAN_IN:
                yield flush(items[:FAN_IN])
                items = items[FAN_IN:]
        if items:
            yield flush(items)

    return run, full_at


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: float = SLACK, fan_in: int = FAN_IN) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32)."""
    run, full_at = _local_round(capacity, slack, first=True)
    bins = cut(pieces.select("doc_id", "piece", "start", "length", "ids_crc32").mapInArrow(trimmed(run), _BIN))
    again, _ = _local_round(capacity, slack, first=False)
    done = [bins.filter(F.col("load") >= full_at)]
    rest = bins.filter(F.col("load") < full_at)
    left = rest.count()
    while left > 1:
        # round-robin: items are dealt evenly, whatever the documents' keys are
        parts = -(-left // fan_in)
        merged = cut(rest.repartition(parts).mapInArrow(trimmed(again), _BIN))
        done.append(merged.filter(F.col("load") >= full_at))
        rest = merged.filter(F.col("load") < full_at)
        now = rest.count()
        if parts == 1 or now > left - left // 1000 - 1:
            break
        left = now
    done.append(rest)
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    numbered = every.withColumn("sequence_id", F.monotonically_increasing_id())
    return numbered.select("sequence_id", F.explode("members").alias("m")).select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    # cut here, so that no task keeps two Python workers, one of them with the tokenizer, at once
    return pack(cut(tokenise(docs, capacity, tokenizer)), capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


__all__ = ["WordEncoder", "best_fit", "op5_best_fit_packing", "pack", "pack_documents", "tokenise"]

"""Best-fit packing by hierarchical residual packing.

Documents are tokenized where they lie; only (id, length) items move after that. Items are dealt by hash to tasks of a
bounded size, each of which packs its share best-fit with longest items first. Bins with at most `slack` free tokens are
finished. The others become items themselves, are merged into fewer tasks and packed again, until one task held all of
them or a round stopped helping. A bin keeps the id of its first item, so a round is a small (id, bin, shift) table.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphcq.llm.common import durable, giving_back, parts_for, pick

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words whose ids a worker remembers, by default: so many recent ones, and as many before them; some 200 bytes each.
REMEMBERED = 400_000
#: Signs that often follow a word; the tokenizer makes a token of its own of them, without joining them to letters.
TRAILING = ".,;:!?|%*&$#"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet, for Latin letters: printable bytes are themselves, the others follow from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    byte = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    return {c: "".join(byte[b] for b in chr(c).encode()) for c in range(0x80, LATIN)}


#: Letters below this code point are letters for the tokenizer too, whatever its version of Unicode.
LATIN = 0x180


class _Ids(dict):
    """Word -> its ids as little-endian unsigned 32-bit integers. Two generations: a full one becomes the older.

    A word of Latin letters is a single token before the merges, so it goes to the merges at once.
    """

    def __init__(self, tokenizer, most: int | None = None) -> None:
        super().__init__()
        self.tokenizer, self.merges, self.older, self.most = tokenizer, tokenizer.model, {}, most or REMEMBERED
        self.letters = _byte_letters()

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            core = word.rstrip(TRAILING)
            if core.isalpha() and max(core) < chr(LATIN):
                mapped = core if core.isascii() else core.translate(self.letters)
                out = np.array([x.id for x in self.merges.tokenize(mapped)], dtype="<u4").tobytes()
                if len(core) < len(word):
                    out += self[word[len(core) :]]
            else:
                out = self.encode(word)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def text_ids(text: str, ids: _Ids) -> bytes:
    """Ids of a whole text. The tokenizer drops white space and joins nothing across it, so words can go one by one.

    It normalizes and lower-cases letter by letter, so that is done for the whole text first, where doing it again to a
    word changes nothing; other texts, and those that may hold special tokens, go to the tokenizer as they are.
    """
    low = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
    if "<|" in text or not unicodedata.is_normalized("NFC", low):
        return ids.encode(text)
    return b"".join(map(ids.__getitem__, low.replace("\n", " ").replace("\t", " ").split(" ")))


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, remembered: int | None = None) -> DataFrame:
    """One row per piece; a null text is empty; every document ends in `end_id`, so an empty one has one token."""
    with open(tokenizer_path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # a fixed file, not data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        ids = _Ids(Tokenizer.from_str(model.value), remembered)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text_ids(text.as_py() or "", ids) + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return docs.mapInArrow(giving_back(run), PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: for each item the index of its bin's first item, its offset, and its bin's use.

    Bins are kept by free room; a bit set of the rooms in use gives the least room that is enough.
    """
    n = len(lengths)
    first, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    use: dict[int, int] = {}
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        enough = rooms >> size
        if enough:
            room = size + (enough & -enough).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, i
        first[i], offset[i] = b, capacity - room
        left = room - size
        use[b] = capacity - left
        by_room[left].append(b)
        if left:
            rooms |= 1 << left
    return first, offset, np.fromiter((use[b] for b in first.tolist()), np.int64, n)


def _packed(items: DataFrame, id_col: str, parts: int, capacity: int, seed: int) -> DataFrame:
    """`items` with (bin long, shift long, used long): each task packs its own share."""
    schema = items.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    names = items.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [f for f in frames if len(f)]
        if got:
            own = pd.concat(got, ignore_index=True).sort_values(id_col, kind="stable", ignore_index=True)
            first, offset, used = best_fit(own["length"].to_numpy(np.int64), capacity)
            own["bin"], own["shift"], own["used"] = own[id_col].to_numpy(np.int64)[first], offset, used
            yield own[[*names, "bin", "shift", "used"]]

    dealt = items.repartition(parts, F.xxhash64(F.lit(seed), F.col(id_col)))
    return dealt.mapInPandas(run, f"{schema}, bin long, shift long, used long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, slack: int = 16,
         items_per_task: int = 60_000, remembered: int | None = None) -> DataFrame:
    """Pack whole documents (doc_id, text) into sequences of at most `capacity` tokens.

    Returns PIECES and (sequence_id long, offset long): one row per piece, offsets gapless from 0 in a sequence. Only
    documents longer than `capacity` are cut, into pieces of `capacity` tokens but the last. Null and empty texts give
    one piece of one token; repeated rows and null ids each give their own pieces; no documents give no rows; other
    columns are ignored. A task holds at most about `items_per_task` items at a time, and the ids of `remembered` words
    twice (REMEMBERED by default).
    """
    pieces = durable(tokenize_pieces(pick(docs, ["doc_id", "text"]), tokenizer_path, capacity, end_id, remembered))
    pieces = pieces.withColumn("item", F.monotonically_increasing_id())  # stable: the rows are fixed by now
    n = pieces.count()
    full = pieces.where(F.col("length") == capacity).withColumns({"bin": F.col("item"), "shift": F.lit(0).cast("long")})
    items = pieces.where(F.col("length") < capacity)
    packed = durable(_packed(items, "item", parts_for(n, items_per_task), capacity, 0))
    parts, rounds = parts_for(n, items_per_task), []
    loose = packed.where((F.col("item") == F.col("bin")) & (F.col("used") < capacity - slack))
    loose = loose.select(F.col("bin").alias("item"), F.col("used").alias("length"))
    while parts > 1:
        left = loose.count()
        fewer = min(parts_for(left, items_per_task), -(-parts // 2))
        if not left:
            break
        moved = durable(_packed(loose, "item", fewer, capacity, len(rounds) + 1))
        rounds.append(moved.where("item <> bin").select(F.col("item").alias("bin"), F.col("bin").alias("into"), F.col("shift").alias("by")))
        loose = moved.where((F.col("item") == F.col("bin")) & (F.col("used") < capacity - slack))
        loose = loose.select(F.col("bin").alias("item"), F.col("used").alias("length"))
        if fewer == 1 or loose.count() > 0.98 * left:
            break
        parts = fewer
    for moves in rounds:
        packed = packed.join(moves, "bin", "left").withColumns({"bin": F.coalesce("into", "bin"), "shift": F.col("shift") + F.coalesce("by", F.lit(0))}).drop("into", "by")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("shift").alias("offset")]
    return packed.select(*columns).unionByName(full.select(*columns))

"""Documents packed into sequences of a fixed length: best fit in partitions, then a tree of merges."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basketry.llm.shared import blank_words, map_batches, portions, remembered, stage

#: Tokens of a sequence, and the id that ends a document.
CAPACITY = 4096
END_ID = 1

# Pieces packed in one partition, partitions that meet in a node of the tree, and tokens that a bin may
# lack to be nearly full.
EACH = 100_000
FAN = 8
SLACK = 16

# Words that an encoder remembers, words encoded together, and bytes of text encoded at a time.
_ROOM = 1_200_000
_TOGETHER = 2048
_BYTES = 8 << 20

# Pieces that leave a task together.
_PIECES = 4096

# Control characters at which str.split splits, though they are no white space.
_SEPARATORS = "\x1c\x1d\x1e\x1f"

# Punctuation, and letters (lower-cased: letters too) after which it always begins a piece of the tokenizer.
_PUNCTUATION = ".,;:!?*#&%$"
_LETTERS = frozenset(c for c in map(chr, range(0x250)) if c.isalpha() and c.lower().isalpha() and c not in "\xaa\xb5\xba")


class _Places(dict):
    """Places of words; a new word gets the next one and waits to be encoded, or joined from two others."""

    def __init__(self) -> None:
        super().__init__()
        self.words: list[str] = []
        self.at: list[int] = []
        self.joined: list[tuple[int, int, int]] = []

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        if word[-1:] in _PUNCTUATION:
            stem = word.rstrip(_PUNCTUATION)
            if stem and stem[-1] in _LETTERS:
                self.joined.append((place, self[stem], self[word[len(stem) :]]))
                return place
        self.words.append(word)
        self.at.append(place)
        return place


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space, every distinct word only once.

    Such a tokenizer gives a text the ids of its words, one after the other, and begins a piece where
    punctuation follows a letter. New words are encoded many at a time, told apart by a special token
    between them. At most about ``_ROOM`` words are remembered.
    """

    def __init__(self, path: str, between: str = "<|startoftext|>"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.between = between
        self.between_id = self.tokenizer.token_to_id(between)
        a, b = self._ids("a"), self._ids("b.")
        if self.between_id is None or self._ids(" a\t\r\nb. ") != a + b or self._ids(f"a{between}b.") != [*a, self.between_id, *b]:
            raise ValueError("the tokenizer keeps white space or lacks the special token")
        self._forget()

    def _forget(self) -> None:
        self.places = _Places()
        self.pool = np.empty(0, np.uint32)
        self.starts = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int64)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self) -> None:
        """Encode the waiting words, and put together those that have two parts."""
        new = self.places
        if not new.words and not new.joined:
            return
        alone = [k for k, w in enumerate(new.words) if "<|" in w]
        chosen = set(alone)
        order = [k for k in range(len(new.words)) if k not in chosen]
        at, ids, sizes = [], [], []
        for i in range(0, len(order), _TOGETHER):
            some = order[i : i + _TOGETHER]
            found = np.array(self._ids(self.between.join([new.words[k] for k in some])), np.uint32)
            cuts = np.flatnonzero(found == self.between_id)
            if len(cuts) != len(some) - 1:
                raise ValueError("the tokenizer joins the special token with other text")
            sizes.append(np.diff(np.concatenate([[-1], cuts, [len(found)]])) - 1)
            ids.append(found[found != self.between_id])
            at += [new.at[k] for k in some]
        for k in alone:
            ids.append(np.array(self._ids(new.words[k]), np.uint32))
            sizes.append(np.array([len(ids[-1])]))
            at.append(new.at[k])
        self._keep(np.array(at, np.int64), np.concatenate([np.empty(0, np.uint32), *ids]), np.concatenate([np.empty(0, np.int64), *sizes]))
        if new.joined:
            parts = np.array(new.joined, np.int64)
            self._keep(parts[:, 0], self._gather(parts[:, 1:].ravel()), self.lengths[parts[:, 1:]].sum(axis=1))
        new.words.clear()
        new.at.clear()
        new.joined.clear()

    def _keep(self, at: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        longer = len(self.places) - len(self.starts)
        if longer > 0:
            self.starts = np.append(self.starts, np.zeros(longer, np.int64))
            self.lengths = np.append(self.lengths, np.zeros(longer, np.int64))
        self.starts[at] = len(self.pool) + np.cumsum(sizes) - sizes
        self.lengths[at] = sizes
        self.pool = np.append(self.pool, ids)

    def _gather(self, places: np.ndarray) -> np.ndarray:
        """Ids of the words at these places, one after the other."""
        sizes = self.lengths[places]
        shift = self.starts[places] - (np.cumsum(sizes) - sizes)
        return self.pool[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))]

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each. Null is empty."""
        if len(self.places) > _ROOM:
            self._forget()
        found: list[int] = []
        words = []
        for text in texts:
            before = len(found)
            found += map(self.places.__getitem__, _words(text))
            words.append(len(found) - before)
        self._learn()
        at = np.array(found, np.int64)
        upto = np.concatenate([[0], np.cumsum(self.lengths[at])])
        return self._gather(at), np.diff(upto[np.concatenate([[0], np.cumsum(words, dtype=np.int64)])])


def _words(text: str | None) -> list[str]:
    """Words between white space, which the tokenizer drops."""
    if not text:
        return []
    if any(c in text for c in _SEPARATORS):
        return [w.decode("utf-8", "replace") for w in blank_words(text)]
    return text.split()


def encoded_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The ids of every document and ``end_id``, cut after every ``capacity`` ids; staged.

    Returns doc_id, ``piece`` (from 0), ``start`` (ids of the document before it), ``length``, ``ids``
    (little-endian unsigned 32-bit integers) and ``row``, a number of its own for every piece.
    A null text is empty: a piece with the end id alone.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = remembered(tokenizer_path, lambda: WordEncoder(tokenizer_path))
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for portion in portions(batch, _BYTES):
                ids, counts = encoder.encode(portion.column("text").to_pylist())
                sizes = counts + 1
                ends = np.cumsum(sizes)
                every = np.full(int(ends[-1]), end_id, "<u4")
                inner = np.ones(len(every), bool)
                inner[ends - 1] = False
                every[inner] = ids
                pieces = -(-sizes // capacity)
                of = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(sizes[of] - start, capacity)
                numbers = row + np.arange(len(of))
                doc = portion.column("doc_id").take(pa.array(of))
                at = np.concatenate([[0], np.cumsum(length)])
                for i in range(0, len(of), _PIECES):
                    part = slice(i, i + _PIECES)
                    cuts = at[i : i + _PIECES + 1] - at[i]
                    of_part = pa.py_buffer(every[at[i] : at[i] + cuts[-1]])
                    held = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((4 * cuts).astype(np.int32)), of_part])
                    yield pa.RecordBatch.from_arrays(
                        [doc[part], pa.array(piece[part], pa.int32()), *map(pa.array, (start[part], length[part])), held, pa.array(numbers[part])],
                        names=["doc_id", "piece", "start", "length", "ids", "row"],
                    )
                row += len(of)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    columns = "doc_id long, piece int, start long, length long, ids binary, row long"
    return stage(map_batches(texts, encode, columns, keeps=tokenizer_path))


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit of items, given in the order in which they are placed: bin and offset of each, use of each bin.

    An item goes to the fullest bin that still takes it (of equally full ones the last one changed),
    else to a new bin. Bins are kept by their free room, and the rooms that occur as the bits of one
    number, so that an item costs the same whatever the number of bins.
    """
    rooms: dict[int, list[int]] = {}
    occur = 0
    bins, offsets, used = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    for i, size in enumerate(sizes.tolist()):
        if not 0 < size <= capacity:
            raise ValueError(f"an item of {size} does not fit in {capacity}")
        wide = occur >> size
        if wide:
            room = size + (wide & -wide).bit_length() - 1
            same = rooms[room]
            to = same.pop()
            if not same:
                occur ^= 1 << room
        else:
            room, to = capacity, len(used)
            used.append(0)
        bins[i], offsets[i] = to, used[to]
        used[to] += size
        left = room - size
        if left:
            rooms.setdefault(left, []).append(to)
            occur |= 1 << left
    return bins, offsets, np.array(used, np.int64)


def _local(pieces: DataFrame, capacity: int, slack: int, parts: int) -> DataFrame:
    """Pieces packed by themselves in each partition: row, bin, offset, use of the bin, node, and whether it is underfull."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId()
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        row, length = (rows.column(c).to_numpy() for c in ("row", "length"))
        order = np.lexsort((row, -length))
        bins, offsets, used = best_fit(length[order], capacity)
        kept = underfull(pd.DataFrame({"bin": np.arange(len(used)), "used": used}), capacity, slack, parts)
        open_ = np.zeros(len(used), bool)
        open_[kept["bin"]] = True
        for at in range(0, len(order), 65_536):
            part = bins[at : at + 65_536]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row[order[at : at + 65_536]]),
                    pa.array((node << 32) + part),
                    pa.array(offsets[at : at + 65_536]),
                    pa.array(used[part]),
                    pa.array(np.full(len(part), node, np.int64)),
                    pa.array(open_[part]),
                ],
                names=["row", "bin", "offset", "used", "node", "open"],
            )

    dealt = pieces.select("row", "length").repartition(parts, "row")
    return map_batches(dealt, pack, "row long, bin long, offset long, used long, node long, open boolean")


def underfull(bins: pd.DataFrame, capacity: int, slack: int, nodes: int) -> pd.DataFrame:
    """The bins of a node that can still take part in a merge; the others are final.

    After best fit any two bins exceed the capacity together, so at most one is half full or less. Merges
    with other nodes join such small bins, one from each node at most, with each other and with larger
    ones. More larger bins than there are nodes can't all be needed, and a merge that is possible with
    any of them is possible with the emptiest: so as many of these as there are ``nodes`` are kept.
    """
    small = bins[2 * bins["used"] <= capacity]
    large = bins[(2 * bins["used"] > capacity) & (bins["used"] < capacity - slack)]
    return pd.concat([small, large.sort_values(["used", "bin"]).head(nodes)])


def _merge(capacity: int, slack: int, nodes: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def merge(group: pd.DataFrame) -> pd.DataFrame:
        """One node of the tree: bins as items, best fit. A row per bin that moved into another or is passed on."""
        group = group.sort_values(["used", "bin"], ascending=[False, True], ignore_index=True)
        to, at, used = best_fit(group["used"].to_numpy(), capacity)
        first = at == 0
        into = group["bin"].to_numpy()[first][to]
        moved = pd.DataFrame({"bin": group["bin"], "into": into, "at": at, "used": 0})[~first]
        kept = underfull(pd.DataFrame({"bin": group["bin"][first].to_numpy(), "used": used}), capacity, slack, nodes)
        out = pd.concat([moved, kept.assign(into=kept["bin"], at=0)], ignore_index=True)
        return out.assign(node=group["node"].iloc[0])[["node", "bin", "into", "at", "used"]]

    return merge


def packed(
    pieces: DataFrame, capacity: int = CAPACITY, each: int = EACH, fan: int = FAN, slack: int = SLACK
) -> DataFrame:
    """Place pieces (``row``, ``length``) in sequences of at most ``capacity``: row, sequence_id, offset.

    Pieces as long as a sequence are one by themselves. The others are dealt by their row numbers to partitions
    of about ``each`` pieces and packed there, largest first, each into the fullest bin that takes it.
    Nearly full bins (less than ``slack`` is free) are final; underfull ones of ``fan`` partitions meet in a
    node of a tree, where they are the items of another round of best fit, until one node is left. A node
    passes on one half empty bin and at most as many others as there are nodes, so no task gathers more
    than ``fan`` times (nodes + 1) bins, or ``fan`` times ``each`` in the first round.

    ``row`` must be unique. Sequences have no gaps; equal lengths are placed by row number; no pieces
    give no rows. A length of 0 or beyond ``capacity`` raises.
    """
    whole = pieces.filter(F.col("length") == capacity)
    rest = pieces.filter(F.col("length") != capacity)
    local = stage(_local(rest, capacity, slack, 1 + rest.count() // each))
    placed = local.select("row", "bin", "offset")
    nodes = 1 + (local.agg(F.max("node")).first()[0] or 0)
    bins = local.filter("open AND offset = 0").select("node", "bin", "used")
    while nodes > 1:
        nodes = -(-nodes // fan)
        met = bins.withColumn("node", F.expr(f"node div {fan}"))
        merged = stage(
            met.groupBy("node").applyInPandas(
                _merge(capacity, slack, nodes), "node long, bin long, into long, at long, used long"
            )
        )
        bins = merged.filter("at = 0").select("node", "bin", "used")
        moved = merged.filter("at > 0").select("bin", "into", "at")  # fewer than there are partitions
        placed = placed.join(moved, "bin", "left").select(
            "row",
            F.coalesce("into", "bin").alias("bin"),
            (F.col("offset") + F.coalesce("at", F.lit(0))).alias("offset"),
        )
    alone = whole.select("row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.withColumnRenamed("bin", "sequence_id").union(alone)


def packed_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, each: int = EACH
) -> tuple[DataFrame, DataFrame]:
    """Encode and pack all documents: the pieces with their ids, and the places of all pieces.

    Only row numbers and lengths move; texts and ids stay where they were encoded. ``sequences`` brings
    the ids together. Null and empty texts are a piece with the end id; repeated rows and equal or null
    doc_ids are documents of their own; other columns are not read; an empty table gives empty results.
    A long text is cut into pieces, all whole but for the last.
    """
    pieces = encoded_pieces(docs, tokenizer_path, capacity, end_id)
    return pieces, packed(pieces, capacity, each)


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ``ids`` (as in the pieces), ``doc_ids`` and ``starts`` of the pieces in order.

    A group holds at most ``capacity`` ids.
    """
    met = pieces.select("row", "doc_id", "ids").join(places, "row").groupBy("sequence_id")
    parts = met.agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    return parts.select(
        "sequence_id",
        F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"),
        F.col("parts.offset").alias("starts"),
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op11_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens: a row per piece."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces, places = packed_documents(docs, default_tokenizer())
    narrow = pieces.select("row", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return narrow.join(places, "row").drop("row")

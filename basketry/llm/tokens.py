"""Token ids of documents in packed binary files: written in document order, read back in blocks."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basketry.llm.bitpack import PackedReader, PackedWriter, bits_for
from basketry.llm.shared import map_batches, remembered, staging_folder

#: Id that ends every document.
END_ID = 0
#: Characters of a text that, after its doc_id, choose its file.
RANGE_CHARS = 64

# White space other than single blanks and line ends; beside it a word can't be encoded by itself.
_ASCII_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
_OTHER_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

# Punctuation, and letters after which it always begins a piece.
_PUNCTUATION = ".,;:!?*#&%$"
_LETTERS = frozenset(c for c in map(chr, range(0x250)) if c.isalpha() and c not in "\xaa\xb5\xba")


def _even(text: str) -> bool:
    """Whether white space occurs only as single blanks or line ends between other characters."""
    doubled = "  " in text or "\n\n" in text or " \n" in text or "\n " in text
    if doubled:
        return False
    if text.isascii():
        return not any(c in text for c in _ASCII_SPACE)
    return not _OTHER_SPACE.search(text)


def _roomy(values: np.ndarray, needed: int) -> np.ndarray:
    """The array, with a quarter more room where it is too short."""
    if needed <= len(values):
        return values
    longer = np.zeros(needed + needed // 4, values.dtype)
    longer[: len(values)] = values
    return longer


@dataclass
class _New:
    """Words that wait for their encoding, and words that are put together from two others."""

    count: int = 0
    words: list[str] = field(default_factory=list)
    places: list[int] = field(default_factory=list)
    joined: list[int] = field(default_factory=list)
    halves: list[int] = field(default_factory=list)


class _Memo(dict):
    """Places of words in a pool of encodings; ``lead`` stands before each of them."""

    def __init__(self, lead: str, new: _New, plain: _Memo | None = None):
        super().__init__()
        self.lead, self.new, self.plain = lead, new, plain if plain is not None else self

    def __missing__(self, word: str) -> int:
        new = self.new
        place = self[word] = new.count
        new.count += 1
        if word[-1:] in _PUNCTUATION:
            stem = word.rstrip(_PUNCTUATION)
            if stem and stem[-1] in _LETTERS:
                new.joined.append(place)
                new.halves += (self[stem], self.plain[word[len(stem) :]])
                return place
        new.words.append(self.lead + word)
        new.places.append(place)
        return place


class Encoder:
    """Encodes texts with a tokenizer of the tokenizers library, every distinct word only once.

    Byte-level pre-tokenizers start a new piece at each single blank or line end between two
    characters that are no white space, so the ids of such a text are those of its words, each with
    the blank before it, and of its line ends, in turn. Texts with other white space are encoded
    whole, as is every text if the tokenizer has a normaliser or another pre-tokenizer. New words are
    encoded together, a line each, and told apart by the id of the line end; a word with punctuation
    at its end is put together from its pieces. At most about ``room``
    words are remembered.
    """

    def __init__(self, path: str, room: int = 1_700_000, end_id: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        pre = type(self.tokenizer.pre_tokenizer).__name__
        self.by_word = self.tokenizer.normalizer is None and pre == "ByteLevel"
        if self.by_word:
            line_end = self._plain("\n")
            self.by_word = not self.tokenizer.pre_tokenizer.add_prefix_space and len(line_end) == 1
            self.line_end = line_end[0]
        self.end_id = end_id
        self.room = room
        self._forget()

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _forget(self) -> None:
        # The first places are those of the line end, of a document's end, of nothing and of a blank at
        # a text's end: words that are empty can't be told apart in lines encoded together.
        own = [[self.line_end] if self.by_word else [], [] if self.end_id is None else [self.end_id], [], self._plain(" ")]
        self.new = _New()
        self.first = _Memo("", self.new)
        self.other = _Memo(" ", self.new, self.first)
        self.first[""], self.other[""] = 2, 3
        self.new.count = len(own)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int32)
        self.lengths = np.zeros(1 << 14, np.int32)
        self.used = 0
        self._keep(np.arange(len(own)), np.array(sum(own, []), np.uint32), np.array([len(x) for x in own]))

    def _learn(self) -> None:
        """Encode the waiting words, put them into the pool, and join those that have two pieces."""
        new = self.new
        for i in range(0, len(new.words), 4096):
            found = new.words[i : i + 4096]
            lines = np.fromiter(ids := self._plain("\n".join(found)), np.uint32, len(ids))
            cuts = np.concatenate([[-1], np.flatnonzero(lines == self.line_end), [len(lines)]])
            sizes = np.diff(cuts) - 1
            if len(sizes) != len(found):
                raise ValueError("the tokenizer joins line ends with other text")
            self._keep(np.array(new.places[i : i + 4096], np.int64), lines[lines != self.line_end], sizes)
        if new.joined:
            pieces = np.array(new.halves, np.int64)
            sizes = self.lengths[pieces].reshape(-1, 2).sum(axis=1)
            self._keep(np.array(new.joined, np.int64), self._gather(pieces), sizes)
        for waiting in (new.words, new.places, new.joined, new.halves):
            waiting.clear()

    def _keep(self, places: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.pool = _roomy(self.pool, self.used + len(ids))
        self.starts = _roomy(self.starts, self.new.count)
        self.lengths = _roomy(self.lengths, self.new.count)
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[places] = self.used + np.cumsum(sizes) - sizes
        self.lengths[places] = sizes
        self.used += len(ids)

    def _gather(self, places: np.ndarray) -> np.ndarray:
        """Ids of the words at these places, one after the other."""
        sizes = self.lengths[places]
        ends = np.cumsum(sizes, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.starts[places] - (ends - sizes), sizes) + np.arange(total)]

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each. Null is empty.

        With an ``end_id`` every text ends with it.
        """
        if self.new.count > self.room:
            self._forget()
        places: list[int] = []
        words = np.zeros(len(texts), np.int64)
        whole: list[tuple[int, np.ndarray]] = []
        for k, text in enumerate(texts):
            before = len(places)
            if text and not (self.by_word and _even(text)):
                whole.append((k, np.array(self._plain(text), np.uint32)))
            elif text:
                for line in text.split("\n"):
                    first, *rest = line.split(" ")
                    places.append(self.first[first])
                    places.extend(map(self.other.__getitem__, rest))
                    places.append(0)  # the line end
                places.pop()
            if self.end_id is not None:
                places.append(1)
            words[k] = len(places) - before
        self._learn()
        at = np.fromiter(places, np.int64, len(places))
        ids = self._gather(at)
        upto = np.concatenate([[0], np.cumsum(self.lengths[at], dtype=np.int64)])[np.concatenate([[0], np.cumsum(words)])]
        counts = np.diff(upto)
        if whole:
            parts, done = [], 0
            for k, one in whole:
                parts += [ids[done : upto[k]], one]
                done = upto[k]
                counts[k] += len(one)
            ids = np.concatenate([*parts, ids[done:]])
        return ids, counts


def _placed(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a folder, given as a path or a URI."""
    return pa.fs.FileSystem.from_uri(folder) if re.match("[a-z0-9]+:", folder) else (pa.fs.LocalFileSystem(), folder)


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode all texts and write them in ascending ``doc_id`` order to packed files in ``folder``.

    Documents are range-partitioned by doc_id (null first) and the start of the text, and sorted by doc_id and
    text, so rows without id, or of one id, that are a third of the table go to many tasks; only texts of one id
    with the same start stay together. The files, one per partition, follow each other. Texts move once; ids go from the tokenizer straight
    to the file, with one unfinished block and the index in memory. A file gets a name of its own per
    attempt and counts only if its task succeeds, so retried or lost tasks leave nothing that is read.

    Returns the manifest, which is stored beside the files: shard (order of the files), file, n_docs,
    n_ids. An empty or null text is a document with the end id alone; an empty table writes no file.
    """
    spark = docs.sparkSession
    folder = folder or staging_folder(spark)
    vocabulary = Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True)
    width = max(bits_for(vocabulary), bits_for(end_id + 1))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = remembered(tokenizer_path, lambda: Encoder(tokenizer_path, end_id=end_id))
        system, root = _placed(folder)
        name = f"tokens-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        system.create_dir(root, recursive=True)
        n_docs = 0
        with system.open_output_stream(f"{root}/{name}") as out:
            writer = PackedWriter(out, width)
            for batch in batches:
                ids, counts = encoder.encode(batch.column("text").to_pylist())
                writer.append(batch.column("doc_id").to_pylist(), ids, counts)
                n_docs += batch.num_rows
            writer.close()
        if not n_docs:
            system.delete_file(f"{root}/{name}")
            return
        yield pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([TaskContext.get().partitionId()], pa.int64()),
                "file": [name],
                "n_docs": pa.array([n_docs], pa.int64()),
                "n_ids": pa.array([writer.n_ids], pa.int64()),
            }
        )

    start = F.substring("text", 1, RANGE_CHARS)  # in the order of the texts, and short enough for the bounds of ranges
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id", start).sortWithinPartitions("doc_id", "text")
    manifest = map_batches(ordered, write, "shard long, file string, n_docs long, n_ids long", keeps=tokenizer_path)
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest").withColumn("folder", F.lit(folder))


def open_packed(folder: str, file: str):
    """A packed file, open for reading."""
    system, root = _placed(folder)
    return system.open_input_file(f"{root}/{file}")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Read the files of a manifest: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    A file is read block by block in one task; where it starts follows from the manifest's counts.
    ``ids_crc32`` is that of the ids as little-endian unsigned 32-bit integers.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_packed(row["folder"], row["file"]) as source:
                    start, found = row["base"], []
                    for doc, pieces in PackedReader(source).documents():
                        crc, n = 0, 0
                        for ids in pieces:
                            crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                            n += len(ids)
                        found.append((doc, start, n, crc))
                        start += n
                        if len(found) == 4096:
                            yield batch_of(found)
                            found = []
                    if found:
                        yield batch_of(found)

    files = placed.repartitionByRange(max(1, manifest.count()), "shard")
    return map_batches(files, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written as packed files and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_tokens(write_tokens(docs, str(default_tokenizer())))

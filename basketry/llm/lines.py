"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate."""

from __future__ import annotations

import operator
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.shared import map_batches, mix, word_hashes

#: Labelled documents of each kind, and stretches of lines from them, that the field is fitted on at most.
SAMPLE = 1_500
STRETCHES = 6_000
#: Lines of a stretch; longer documents give several.
STRETCH = 32
#: Weight of the lines of good documents to those of bad ones.
PRIOR = 3.0
#: Share of a document's words in content lines from which it is kept.
CONTENT = 0.5
#: Words of a window that counts as repeated, and limits of the base rule.
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20

SYMBOLS = b"#*$%&|<>"
_BLANK = b" \t\n\v\f\r"

_CLASSES = np.zeros((256, 6), np.int32)
_CLASSES[[*SYMBOLS], 0] = 1
_CLASSES[65:91, 1] = 1  # capitals
_CLASSES[97:123, 2] = 1  # small letters
_CLASSES[128:, 2] = 1
_CLASSES[48:58, 3] = 1  # digits
_CLASSES[[*b"!?"], 4] = 1
_CLASSES[[*_BLANK], 5] = 1

#: Names of the features of a line, in order.
FEATURES = (
    "bias", "symbols", "capitals", "digits", "exclamations", "repeats_word", "repeats_line",
    "short", "long_words", "symbol_words", "mostly_capitals", "mostly_repeats",
)


@dataclass
class Lines:
    """Lines of some texts: number of the text, words, features, and whether an earlier line is equal."""

    text: np.ndarray
    words: np.ndarray
    duplicate: np.ndarray
    features: np.ndarray


def lines_of(raws: Sequence[bytes], word_lists: Sequence[Sequence[bytes]]) -> Lines:
    """The lines of UTF-8 texts, whose words are given too; every text has one line at least."""
    splits = [raw.split(b"\n") for raw in raws]
    counts = np.array([len(s) for s in splits], np.int64)
    text = np.repeat(np.arange(len(raws)), counts)
    joined = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(joined == 10)[:-1] + 1]) if len(raws) else np.empty(0, np.int64)
    tally = np.stack([np.add.reduceat(_CLASSES[:, k][joined], starts) for k in range(6)], axis=1) if len(raws) else np.empty((0, 6))
    sizes = np.diff(np.append(starts, len(joined)))
    blank = _CLASSES[:, 5][joined].astype(bool)
    begins = ~blank & np.concatenate([[True], blank[:-1]]) if len(joined) else blank
    words = np.add.reduceat(begins.astype(np.int64), starts) if len(raws) else np.empty(0, np.int64)

    duplicate = np.zeros(len(text), bool)
    at = 0
    for parts in splits:
        seen: set[bytes] = set()
        for k, line in enumerate(parts, at):
            if line in seen:
                duplicate[k] = words[k] > 0
            else:
                seen.add(line)
        at += len(parts)

    line_of_word = np.repeat(np.arange(len(text)), words)
    flat = [w for ws in word_lists for w in ws]
    again = np.zeros(len(flat), bool)
    if len(flat) > 1:
        again[1:] = np.fromiter(map(operator.eq, flat, islice(flat, 1, None)), bool, len(flat) - 1)
        again[1:] &= line_of_word[1:] == line_of_word[:-1]
    repeats = np.bincount(line_of_word[again], minlength=len(text)) if len(text) else np.empty(0)
    symbols, capitals, small, digits, exclamations, blanks = tally.T.astype(np.float64)
    chars = np.maximum(sizes - blanks, 1)
    letters = np.maximum(capitals + small, 1)
    n = np.maximum(words, 1)
    features = np.stack(
        [
            np.ones(len(text)),
            np.minimum(symbols / chars * 4, 1),
            capitals / letters,
            digits / chars,
            np.minimum(exclamations / chars * 4, 1),
            repeats / n,
            duplicate.astype(np.float64),
            (words < 4).astype(np.float64),
            np.minimum(chars / n / 20, 1),
            np.minimum(symbols / n, 1),
            (capitals > 0.6 * letters).astype(np.float64),
            (repeats > 0.3 * n).astype(np.float64),
        ],
        axis=1,
    )
    features[words == 0] = 0  # a line without words says nothing
    return Lines(text, words, duplicate, features)


@dataclass(frozen=True)
class Field:
    """Weights: one per feature for label 1 (content), and one per pair of neighbouring labels."""

    emission: np.ndarray
    transition: np.ndarray

    def viterbi(self, features: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """The most likely labels of all lines; ``texts``: number of the text of each line, ascending."""
        scores = (features @ self.emission).tolist()
        (t00, t01), (t10, t11) = self.transition.tolist()
        labels = np.zeros(len(scores), np.int8)
        ends = np.flatnonzero(np.diff(texts, append=-1)) + 1 if len(texts) else []
        at = 0
        for end in ends:
            from0, from1 = [], []
            a, b = 0.0, scores[at]
            for e in scores[at + 1 : end]:
                stay0, stay1 = a + t00 >= b + t10, b + t11 >= a + t01
                from0.append(stay0)
                from1.append(stay1)
                a, b = (a + t00 if stay0 else b + t10), (b + t11 if stay1 else a + t01) + e
            label = b >= a
            labels[end - 1] = label
            for k in range(len(from0) - 1, -1, -1):
                label = from1[k] if label else not from0[k]
                labels[at + k] = label
            at = end
        return labels


#: Where there is nothing to learn from, every line is content.
UNFITTED = Field(np.eye(len(FEATURES))[0], np.zeros((2, 2)))


def fit_field(stretches: Sequence[tuple[np.ndarray, int]], steps: int = 150, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Maximum likelihood by gradient steps; a stretch is the features of some lines and their label.

    All stretches go through the forward and backward recursions together, padded to one length.
    Good and bad documents count as ``PRIOR`` to 1, so that a line that shows nothing is content.
    """
    n, longest = len(stretches), max(len(f) for f, _ in stretches)
    x = np.zeros((n, longest, len(FEATURES)))
    mask = np.zeros((n, longest))
    for i, (f, _) in enumerate(stretches):
        x[i, : len(f)] = f
        mask[i, : len(f)] = 1
    y = np.array([label for _, label in stretches])
    held = np.array([mask[y == k].sum() for k in (0, 1)])
    weight = np.array([1.0, PRIOR])[y] / (1 + PRIOR) / held[y]
    w, t = np.zeros(len(FEATURES)), np.zeros((2, 2))
    speed_w, speed_t = np.zeros_like(w), np.zeros_like(t)
    for _ in range(steps):
        e = np.zeros((n, longest, 2))
        e[:, :, 1] = x @ w
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0]
        for k in range(1, longest):
            into = forward[:, k - 1, :, None] + t[None]
            forward[:, k] = np.where(mask[:, k, None] > 0, np.logaddexp(into[:, 0], into[:, 1]) + e[:, k], forward[:, k - 1])
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        for k in range(longest - 2, -1, -1):
            out = t[None] + (e[:, k + 1] + backward[:, k + 1])[:, None, :]
            backward[:, k] = np.where(mask[:, k + 1, None] > 0, np.logaddexp(out[:, :, 0], out[:, :, 1]), 0)
        one = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None]) * mask
        grad_w = np.einsum("n,nk,nkf->f", weight, y[:, None] * mask - one, x)
        grad_t = np.zeros_like(t)
        if longest > 1:
            joint = forward[:, :-1, :, None] + t + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
            pair = np.exp(joint) * mask[:, 1:, None, None]
            grad_t -= np.einsum("n,nkab->ab", weight, pair)
            for label in (0, 1):
                grad_t[label, label] += (weight[y == label, None] * mask[y == label, 1:]).sum()
        speed_w = 0.9 * speed_w + grad_w - decay * w
        speed_t = 0.9 * speed_t + grad_t - decay * t
        w, t = w + rate * speed_w, t + rate * speed_t
    return Field(w, t)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, stretches: int = STRETCHES) -> Field:
    """The field from labelled documents: lines of good ones are content, of bad ones boilerplate.

    At most ``sample`` documents of each kind, by a hash of their id, give at most ``stretches``
    stretches of lines to the driver. Without both kinds every line counts as content.
    """
    known = labels.select("doc_id", "quality").dropna().distinct()
    kinds = [known.filter(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in ("quality = 1", "quality = 0")]
    chosen = F.broadcast(kinds[0].union(kinds[1]))  # at most 2 * sample rows
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", "quality")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, word_lists = _split(batch.column("text").to_pylist())
            found = lines_of(raws, word_lists)
            ids, labels_of = batch.column("doc_id").to_pylist(), batch.column("quality").to_pylist()
            worded = np.flatnonzero(found.words > 0)
            out: list[tuple[int, int, int, list[float]]] = []
            for i in range(batch.num_rows):
                mine = worded[found.text[worded] == i]
                for at in range(0, len(mine), STRETCH):
                    out.append((ids[i], at, labels_of[i], found.features[mine[at : at + STRETCH]].reshape(-1).tolist()))
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array([o[k] for o in out], pa.int64()) for k in range(3)],
                    pa.array([o[3] for o in out], pa.list_(pa.float64())),
                ],
                names=["doc_id", "at", "label", "features"],
            )

    cuts = map_batches(rows, cut, "doc_id long, at long, label long, features array<double>")
    found = cuts.orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at").limit(stretches).collect()
    data = [(np.array(r["features"]).reshape(-1, len(FEATURES)), int(r["label"])) for r in found]
    if len({label for _, label in data}) < 2:
        return UNFITTED
    return fit_field(data)


def _split(texts: Sequence[str | None]) -> tuple[list[bytes], list[list[bytes]]]:
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return raws, [raw.split() for raw in raws]


def repeated_words(word_lists: Sequence[Sequence[bytes]], window: int = WINDOW) -> np.ndarray:
    """For each text, its words in windows that it holds twice or more."""
    sizes = np.array([len(w) for w in word_lists], np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    n = len(row)
    if n < window:
        return np.zeros(len(sizes), np.int64)
    h = np.concatenate([word_hashes(w) for w in word_lists])
    with np.errstate(over="ignore"):
        total = row[: n - window + 1].astype(np.uint64)
        for k in range(window):
            total = total * np.uint64(0x9E3779B97F4A7C15) + h[k : n - window + 1 + k]
    total = mix(total)
    valid = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])
    values = total[valid]
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    twice = np.zeros(len(valid), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, valid[twice], 1)
    np.add.at(step, valid[twice] + window, -1)
    return np.bincount(row[np.cumsum(step)[:n] > 0], minlength=len(sizes))


def judged(docs: DataFrame, field: Field, content: float = CONTENT) -> DataFrame:
    """Every document with its measures, the words that the field calls content, and the verdict.

    Returns doc_id, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``content_words``, ``labels`` (one per line: 1 content, 0 boilerplate), ``base_failed`` and
    ``kept``. Words lie between ASCII blanks. A document is kept if the base rule holds (ten words at
    least, at most a fifth of them in repeated five-word windows) and at least ``content`` of its
    words stand in content lines. Empty and null texts have no words and fail the base rule; repeated
    rows are judged each by itself.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            raws, word_lists = _split(texts)
            found = lines_of(raws, word_lists)
            labels = field.viterbi(found.features, found.text)
            rows = len(raws)
            n = np.array([len(w) for w in word_lists], np.int64)
            chars = np.array([len(t or "") - (len(raw) - len(raw.translate(None, _BLANK))) for t, raw in zip(texts, raws, strict=True)], np.int64)
            symbols = np.array([len(raw) - len(raw.translate(None, SYMBOLS)) for raw in raws], np.int64)
            duplicates = np.bincount(found.text[found.duplicate], minlength=rows)
            repeated = repeated_words(word_lists)
            own = np.bincount(found.text, weights=found.words * labels, minlength=rows).astype(np.int64)
            failed = (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)
            kept = ~failed & (own >= content * n)
            cuts = np.flatnonzero(np.diff(found.text)) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *[pa.array(c.astype(np.int64)) for c in (n, chars, symbols, duplicates, repeated, own)],
                    pa.array([part.tolist() for part in np.split(labels, cuts)], pa.list_(pa.int8())),
                    pa.array(failed),
                    pa.array(kept),
                ],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words", "labels", "base_failed", "kept"],
            )

    return map_batches(
        docs.select(F.col("doc_id").cast("long"), "text"),
        judge,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "content_words long, labels array<byte>, base_failed boolean, kept boolean",
    )


def op6_line_labels(spark, sf_dir: str) -> DataFrame:
    """Measures and verdict for every document, by a field fitted on the labelled ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    field = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged(docs, field).drop("labels")

"""Near duplicates by MinHash with tensored banding, every link confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.components import components
from basketry.llm.shared import lower_blank_words, map_batches, mix, parts_for, spare, stage, word_hashes

#: Words of a shingle, and the similarity in percent from which documents are linked.
SHINGLE = 5
PERCENT = 80
#: Hashes of a half key and half keys of each collection: GROUPS**2 tables from 2 * GROUPS * WIDTH hashes.
WIDTH = 2
GROUPS = 12
#: Hashes of a sketch that must agree before a pair is compared; at similarity 0.8 fewer than one pair
#: in a million has so few.
AGREE = 24
#: Members up to which a bucket with unlike rows is gone through centre by centre; larger ones are split.
FEW = 8
#: Sets that are compared with as many others at a time.
BLOCK = 64

_FACTORS = (mix(np.arange(1, 2 * 64 * 8 + 1, dtype=np.uint64)) | np.uint64(1)).tolist()


def shingle_sets(texts: Sequence[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text.

    A text of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    sets = []
    for text in texts:
        h = word_hashes(lower_blank_words(text))
        size = min(words, len(h))
        if not size:
            sets.append(np.empty(0, np.uint64))
            continue
        with np.errstate(over="ignore"):
            total = np.full(len(h) - size + 1, size, np.uint64)
            for k in range(size):
                total = total * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k]
        sets.append(np.unique(mix(total)))
    return sets


def half_keys(sets: Sequence[np.ndarray], width: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Two collections of ``groups`` half keys for each (non-empty) set, and its sketch of one byte per hash."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    values = np.concatenate(sets)
    least = np.empty((2 * groups * width, len(sets)), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(len(least)):
            least[k] = np.minimum.reduceat(values * np.uint64(_FACTORS[k]), starts)
        keys = np.empty((len(sets), 2 * groups), np.uint64)
        for g in range(2 * groups):
            total = np.full(len(sets), g, np.uint64)
            for k in range(width):
                total = mix(total + least[g * width + k])
            keys[:, g] = total
    return keys, (mix(least) >> np.uint64(56)).astype(np.uint8).T


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |intersection| >= percent * |union| for two sorted sets."""
    both = len(a) + len(b)
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    merged = np.concatenate([a, b])
    merged.sort(kind="mergesort")
    shared = int((merged[1:] == merged[:-1]).sum())
    return 100 * shared >= percent * (both - shared)


def signatures(docs: DataFrame, shingle: int, width: int, groups: int) -> DataFrame:
    """A staged row per document: its set's size and fingerprint, half keys, sketch, and a row number."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), shingle)
            full = [k for k, s in enumerate(sets) if len(s)]
            keys = np.zeros((len(sets), 2 * groups), np.uint64)
            sketch = np.zeros((len(sets), 2 * groups * width), np.uint8)
            if full:
                keys[full], sketch[full] = half_keys([sets[k] for k in full], width, groups)
            with np.errstate(over="ignore"):
                prints = [np.array([f(s).sum() for s in sets], np.uint64) for f in (mix, lambda s: mix(s ^ np.uint64(0x5851F42D4C957F2D)))]
            halves = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(part).view(np.int64).reshape(-1)), groups).cast(pa.list_(pa.int64())) for part in (keys[:, :groups], keys[:, groups:])]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("doc_id", "_t")],
                    pa.array([len(s) for s in sets], pa.int64()),
                    *[pa.array(p.view(np.int64)) for p in prints],
                    *halves,
                    pa.array([row.tobytes() for row in sketch], pa.binary()),
                ],
                names=["doc_id", "_t", "n_shingles", "f1", "f2", "a", "b", "sketch"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_t"))
    signed = map_batches(
        rows,
        sign,
        "doc_id long, _t long, n_shingles long, f1 long, f2 long, a array<long>, b array<long>, sketch binary",
    )
    return stage(signed.withColumn("row", F.monotonically_increasing_id()))


def _compared(pairs: DataFrame, kept: str) -> DataFrame:
    """The ``kept`` columns of rows that hold two sketches (_s, _r), with the hashes ``agreed`` on."""
    names = [c.split(" ")[0] for c in kept.split(", ")]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, r = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8) for c in ("_s", "_r")]
            if not batch.num_rows:
                continue
            agreed = (s == r).reshape(batch.num_rows, -1).sum(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(agreed)], names=[*names, "agreed"])

    return map_batches(pairs.select(*dict.fromkeys([*names, "_s", "_r"])), compare, f"{kept}, agreed int")


def _agreements(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (u, v) of classes with the number of hashes in which their sketches agree."""
    left = classes.select(F.col("node").alias("u"), F.col("sketch").alias("_s"))
    right = classes.select(F.col("node").alias("v"), F.col("sketch").alias("_r"))
    return _compared(pairs.join(left, "u").join(right, "v"), "u long, v long")


def _recentred(members: DataFrame, met: DataFrame, classes: DataFrame, hashes: int, agree: int) -> list[DataFrame]:
    """Agreements of bucket members that an unlike centre left untested, a staged table (u, v) a round.

    ``members``: key, node, center, n (rows of the bucket); ``met``: the agreements with those centres. A
    member that agrees with its centre in more than half of the hashes beyond ``agree`` is settled; all
    others of a bucket in which the centre rejects a row meet the smallest of them as a new centre, until
    each is settled, hangs together with the rest or is alone. A bucket of more than ``FEW`` rows is split
    by one further hash a round, so unlike rows part and no bucket is ever compared pair by pair. At most
    ``hashes`` splits leave equal sketches, which are settled, so the rounds end.
    """
    settled = agree + (hashes - agree) // 2
    unlike = met.filter(F.col("agreed") < settled)
    if unlike.filter(F.col("agreed") < agree).isEmpty():
        return []
    loose = stage(
        members.join(unlike, (F.col("node") == F.col("u")) & (F.col("center") == F.col("v"))).select(
            "key", "node", "n", (F.col("agreed") < agree).alias("open")
        )
    )
    headed = loose.join(loose.filter("open").select("key").distinct(), "key", "left_semi")
    rest = headed.join(classes.select("node", "sketch"), "node").withColumn("at", F.pmod("key", F.lit(hashes)).cast("long"))
    rounds: list[DataFrame] = []
    while True:
        at = F.pmod(F.col("at") + len(rounds), F.lit(hashes)).cast("int") + 1
        split = F.xxhash64("key", F.substring("sketch", at, F.lit(1)))
        key = F.when(F.col("n") > FEW, split).otherwise(F.col("key"))
        rest = stage(rest.select(key.alias("key"), "node", "at", "open", "sketch"))
        heads = rest.groupBy("key").agg(
            F.min(F.struct("node", "sketch")).alias("head"), F.count(F.lit(1)).alias("n"), F.max("open").alias("_any")
        )
        heads = heads.filter("n > 1 and _any").select("key", F.col("head.node").alias("center"), F.col("head.sketch").alias("_r"), "n")
        paired = rest.join(heads, "key").filter("node <> center").withColumnRenamed("sketch", "_s")
        found = stage(_compared(paired, "key long, node long, center long, n long, at long, _s binary"))
        if found.isEmpty():
            return rounds
        near = found.filter(F.col("agreed") >= agree)
        rounds.append(near.select(F.col("node").alias("u"), F.col("center").alias("v")).distinct())
        rest = found.filter(F.col("agreed") < settled).select(
            "key", "node", "n", "at", (F.col("agreed") < agree).alias("open"), F.col("_s").alias("sketch")
        )


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar enough; ``texts``: node, text of both ends."""
    left = texts.select(F.col("node").alias("u"), F.col("text").alias("_a"))
    right = texts.select(F.col("node").alias("v"), F.col("text").alias("_b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            near = []
            rows = zip(*[batch.column(c).to_pylist() for c in ("v", "_a", "_b")], strict=True)
            for v, a, b in rows:
                if v != last:
                    last, held = v, shingle_sets([b], shingle)[0]
                near.append(similar(shingle_sets([a], shingle)[0], held, percent))
            yield batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    return map_batches(pairs.join(left, "u").join(right, "v").select("u", "v", "_a", "_b"), compare, "u long, v long")


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    width: int = WIDTH,
    groups: int = GROUPS,
    agree: int = AGREE,
) -> DataFrame:
    """Every document with the component of near duplicates it belongs to.

    Tables are tensored: with two collections of ``groups`` half keys, each made of ``width``
    minimum hashes, every pair of a half key of the first and one of the second is the key of a table.
    groups**2 tables of 2 * width hashes so need 2 * groups * width hashes instead of groups**2 times
    that. Two sets of similarity s share some table unless all half keys of a collection differ:
    with the defaults one pair in 100,000 at s = 0.8 shares none, one in 200 million at 0.9.

    * Documents with equal sets form a class at once, by a 128-bit fingerprint combined in the tasks.
    * In each bucket all classes are paired with its smallest (no all-pairs). Members that this centre
      rejects, or to which it is only half alike, get new centres among themselves (``_recentred``).
      Pairs whose sketches agree are confirmed on the whole sets of both texts, and links give components.
    * Candidates that hang together but still lie in several components are compared in blocks, each
      class outside the largest component with all others.

    So a pair goes untested only if it shares no table, or if every bucket it shares has more than
    ``FEW`` unlike rows and one of the further hashes that split these parts the pair (each with a chance
    of 1 - s; a pair at 0.8 shares 59 of the 144 buckets on average), or by a settled row whose partner
    the same centre rejects, which takes an agreement of the two far below their similarity.

    Texts move once, and only those of candidates are kept. Returns doc_id, ``n_shingles``,
    ``component_id`` (smallest doc_id in the component), ``_t`` (hash of the text) and ``first`` (true
    for one row of each component, of the smallest doc_id). Words lie between ASCII blanks, A-Z
    lower-cased. A text of fewer words than a shingle is one shingle; an empty or null text is
    linked with nothing, not even another empty one. Repeated rows are linked. Rows without doc_id
    are linked like others but give no component_id; a component of only such rows has null.
    """
    signed = signatures(docs, shingle, width, groups)
    classes = stage(
        signed.filter("n_shingles > 0")
        .groupBy("n_shingles", "f1", "f2")
        .agg(
            F.min("row").alias("node"),
            F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), "row")).alias("earliest"),
            F.min("doc_id").alias("smallest"),
            F.min(F.struct("row", "doc_id", "_t")).alias("_text"),
            F.first("a").alias("a"),
            F.first("b").alias("b"),
            F.first("sketch").alias("sketch"),
        )
    )
    tables = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y))))
    keys = classes.select("node", F.explode(tables).alias("key"))
    buckets = stage(
        keys.groupBy("key").agg(F.min("node").alias("center"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    )
    members = keys.join(buckets, "key").filter("node <> center")
    stars = members.select(F.col("node").alias("u"), F.col("center").alias("v")).distinct()
    met = stage(_agreements(stars, classes))
    candidates = met.filter(F.col("agreed") >= agree).select("u", "v")
    more = _recentred(members, met, classes, 2 * groups * width, agree)
    if more:
        candidates = stage(reduce(DataFrame.union, more, candidates).distinct())

    wanted = candidates.select(F.col("u").alias("node")).union(candidates.select(F.col("v").alias("node"))).distinct()
    places = wanted.join(classes, "node").select(
        "node", F.coalesce("_text.doc_id", F.lit(0)).alias("_d"), F.col("_text._t").alias("_t")
    )
    whole = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_d"), F.xxhash64("text").alias("_t"), "text"
    )
    texts = stage(whole.join(places, ["_d", "_t"]).select("node", "text").dropDuplicates(["node"]))
    links = stage(_confirmed(candidates, texts, shingle, percent))
    # Components of the links and clusters of the candidates at once, told apart by the last bit.
    tagged = [e.select((F.col("u") * 2 + k).alias("u"), (F.col("v") * 2 + k).alias("v")) for k, e in enumerate((links, candidates))]
    both = components(tagged[0].union(tagged[1]))
    labels, clusters = (
        both.filter(F.col("node") % 2 == k).select(F.expr("node div 2").alias("node"), F.expr("label div 2").alias("label")) for k in (0, 1)
    )
    more = stage(_across(clusters, texts, labels, shingle, percent))
    if not more.isEmpty():
        labels = components(links.union(more))

    named = classes.join(labels, "node", "left").select(
        "n_shingles", "f1", "f2", "smallest", "earliest", F.coalesce("label", "node").alias("label")
    )
    least = named.groupBy("label").agg(
        F.min("smallest").alias("component_id"), F.min("earliest").alias("_first")
    )
    final = stage(
        named.join(least, "label").select(
            "n_shingles", "f1", "f2", F.col("component_id").alias("_c"), F.col("_first.row").alias("_keep")
        )
    )
    return (
        signed.select("doc_id", "_t", "n_shingles", "f1", "f2", "row")
        .join(final, ["n_shingles", "f1", "f2"], "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("n_shingles") > 0, F.col("_c")).otherwise(F.col("doc_id")).alias("component_id"),
            "_t",
            ((F.col("n_shingles") == 0) | (F.col("row") == F.col("_keep"))).alias("first"),
        )
    )


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are the first of their component, unchanged.

    Documents without words are linked with nothing and stay. Of rows with the same doc_id and text
    one stays.
    """
    keys = [spare("_near_doc", docs), spare("_near_text", docs)]
    first = near_duplicates(docs, **options).filter("first").select(
        F.coalesce("doc_id", F.lit(0)).alias(keys[0]), F.col("_t").alias(keys[1])
    )
    keyed = docs.withColumns({keys[0]: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), keys[1]: F.xxhash64("text")})
    return keyed.join(stage(first), keys, "left_semi").dropDuplicates(keys).select(*docs.columns)


def _across(clusters: DataFrame, texts: DataFrame, labels: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links between components that the stars left apart.

    Candidates hang together in clusters (node, label). In a cluster with several components, every
    class outside its largest one is held against all classes of the cluster, in blocks of about
    ``BLOCK`` sets of like size: a row is a pair of blocks, and one product of their incidence matrices
    gives all intersections. A pair of blocks gives one link at most for two components.
    """
    placed = clusters.withColumnRenamed("label", "cluster").join(labels, "node", "left")
    placed = placed.select("cluster", "node", F.coalesce("label", "node").alias("label"))
    sizes = placed.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    homes = sizes.groupBy("cluster").agg(
        F.max(F.struct("n", "label")).alias("_home"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("classes")
    )
    apart = homes.filter("parts > 1 and classes > 2").select("cluster", F.col("_home.label").alias("home"))
    apart = stage(apart.coalesce(parts_for(clusters.count())))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), shingle)
            # Sets of similarity s differ in size by a factor of s at most, so in class by one.
            width = np.log(100 / percent) * 1.001 + 1e-9
            classes = [int(np.log(len(s)) / width) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("cluster", "node", "label", "home")],
                    pa.array(classes, pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                names=["cluster", "node", "label", "home", "class", "set"],
            )

    held = placed.join(apart, "cluster").join(texts, "node").select("cluster", "node", "label", "home", "text")
    sets = stage(map_batches(held, shingled, "cluster long, node long, label long, home long, class long, set binary"))
    counts = sets.groupBy("cluster", "class").agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(F.col("label") != F.col("home")).alias("_stray")
    )
    counted = sets.join(stage(counts), ["cluster", "class"])

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("node"), F.ceil(F.col(f"_{name}") / BLOCK)).alias("block")
        return rows.groupBy("cluster", "class", block).agg(F.collect_list(F.struct("node", "label", "set")).alias(name))

    near = F.array(*[F.col("class") + k for k in (-1, 0, 1)])
    stray = blocks(counted.filter("label <> home"), "stray").select("cluster", F.explode(near).alias("class"), "stray")
    pairs = blocks(counted, "all").join(stray, ["cluster", "class"]).select("all", "stray")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                some, others = (batch.column(c)[k].as_py() for c in ("all", "stray"))
                found = linked(some, others, percent)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["u", "v"])

    return map_batches(pairs, compare, "u long, v long")


def linked(some: Sequence[dict], others: Sequence[dict], percent: int) -> list[tuple[int, int]]:
    """Links between two blocks of (node, label, set), one for each two labels."""
    rows = [np.frombuffer(e["set"], np.uint64) for e in (*some, *others)]
    sizes = np.array([len(r) for r in rows])
    values, column = np.unique(np.concatenate(rows), return_inverse=True)
    shared = np.zeros((len(some), len(others)), np.float32)
    step = 1 << 16
    row = np.repeat(np.arange(len(rows)), sizes)
    for at in range(0, len(values), step):  # the matrices, a stretch of columns at a time
        inside = (column >= at) & (column < at + step)
        cells = np.zeros((len(rows), min(step, len(values) - at)), np.float32)
        cells[row[inside], column[inside] - at] = 1
        shared += cells[: len(some)] @ cells[len(some) :].T
    union = sizes[: len(some), None] + sizes[None, len(some) :] - shared
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for i, j in np.argwhere(100 * shared >= percent * union).tolist():
        a, b = some[i], others[j]
        if a["label"] != b["label"]:
            found.setdefault((min(a["label"], b["label"]), max(a["label"], b["label"])), (max(a["node"], b["node"]), min(a["node"], b["node"])))
    return list(found.values())


def op1_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Components of all documents by sets of two-word shingles."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2)
    return found.select(
        "doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept")
    )


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s
  FROM words, unnest(range(1, greatest(len(w), 2))) AS t(i) WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n
  HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r
)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
LEFT JOIN sizes z USING (doc_id)
"""

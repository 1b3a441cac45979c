"""Near-duplicate documents by MinHash bands and odd sketches, confirmed on whole shingle sets.

Each distinct set of word shingles is sketched once: bands of MinHash samples find candidates, and an
odd sketch sifts them. For that the set's least hashes (a MinHash sample of one permutation, the whole
set if it is small) each flip one bit of a bitmap; the ones in the XOR of two bitmaps tell how many
sampled shingles differ, so candidates of a band are sifted by a few 64-bit words before any text moves.
What passes is confirmed by comparing the sets themselves.

Candidates come in two rounds, so that a group of many copies never becomes all of its pairs. First each
member of a band's bucket is compared with the bucket's most central member; what is linked becomes one
component. Then only the members of buckets that still hold several components are compared, across
components; a bucket of any size is dealt out in pairs of blocks. A pair that both rounds leave out lies
in one component already or shares no band: at a similarity of 0.8 the chance of sharing none of 32 bands
of 4 is 5e-8, and the sieve's limits lie 5.5 deviations from what a linked pair shows. No bucket, group
or candidate list is cut.

Rows are told apart by doc_id and a hash of the text, so a doc_id that several texts share stands for as
many documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FOLDED, free_names, materialise, mix, row_sums, span_hashes, text_parts, word_spans

#: Words of a shingle, and the similarity that links: 100 * intersection >= PERCENT * union.
WORDS, PERCENT = 5, 80
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
#: Shingles that an odd sketch samples, its bits and 64-bit words, and the deviations that its limits allow.
LEAST, BITS, DEVIATIONS = 1024, 1024, 5.5
ODD = [f"o{j}" for j in range(BITS // 64)]
#: Pairs of one first member that are confirmed by one group, members in a block of a bucket, and the parts
#: over which the rows of one band key are spread where they meet the key's own row.
CHUNK, BLOCK, SPREAD = 256, 512, 16
_PART = 2 << 20
_random = np.random.default_rng(1)
_A = _random.integers(0, 1 << 64, SAMPLES, np.uint64) | np.uint64(1)
_B = _random.integers(0, 1 << 64, SAMPLES, np.uint64)
_C = _random.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
_BAND_SALT = _random.integers(0, 1 << 64, BANDS, np.uint64)


def shingle_sets(raw: np.ndarray, offs: np.ndarray, words: int) -> list[np.ndarray]:
    """For each row the sorted 64-bit hashes of its distinct shingles. A row of fewer words has its whole
    sequence as its only shingle; a row without words has none."""
    starts, ends, first = word_spans(raw, offs)
    h = span_hashes(raw, starts, ends, FOLDED)
    acc = np.zeros(len(h), np.uint64)
    for j in range(words):
        acc[: max(0, len(h) - j)] += h[j:] * _C[j]
    acc = mix(acc)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            own = np.sort(acc[a : b - words + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            short = (h[a:b] * _C[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a) * _C[63]
            out.append(mix(short))
        else:
            out.append(h[:0])
    return out


def samples(own: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), 1024):
        np.minimum(least, (_A[:, None] * own[None, i : i + 1024] + _B[:, None]).min(axis=1), out=least)
    return least


def odd_words(sets: list[np.ndarray]) -> np.ndarray:
    """Odd sketches of sorted sets, as 64-bit words."""
    taken = [x[:LEAST] for x in sets]
    row = np.repeat(np.arange(len(sets)), [len(x) for x in taken])
    every = np.concatenate(taken) if taken else np.zeros(0, np.uint64)
    place = (mix(every * _C[11]) & np.uint64(BITS - 1)).astype(np.int64) + BITS * row
    ones = (np.bincount(place, minlength=BITS * len(sets)) & 1).astype(np.uint8).reshape(len(sets), BITS)
    return np.packbits(ones, axis=1).view("<i8")


def band_keys(m: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of rows of samples."""
    return mix((m.reshape(len(m), BANDS, ROWS) * _C[:ROWS]).sum(axis=2, dtype=np.uint64) + _BAND_SALT).view(np.int64)


def _sketch(words: int):
    def run(batches):
        for batch in batches:
            for at, n, raw, offs in text_parts(batch.column(1), _PART):
                sets = shingle_sets(raw, offs, words)
                size = np.array([len(x) for x in sets], np.int64)
                every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                bounds = np.append(0, np.cumsum(size))
                one = row_sums(every, bounds).view(np.int64)
                two = row_sums(mix(every.copy() * _C[10]), bounds).view(np.int64)
                m = np.array([samples(x) for x in sets], np.uint64).reshape(n, SAMPLES)
                odd = odd_words(sets)
                keys = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(m).ravel()), BANDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(2).slice(at, n), pa.array(size), pa.array(one), pa.array(two), keys, *[pa.array(np.ascontiguousarray(odd[:, j])) for j in range(len(ODD))]], ["doc_id", "t", "n", "f1", "f2", "bands", *ODD])

    return run


def named(docs: DataFrame) -> DataFrame:
    """doc_id, text and t, a hash of the text: doc_id and t name a row, but for equal rows."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("t"))


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, t, n (shingles), f1 and f2 (fingerprint of the set), bands and the odd sketch of every row."""
    return named(docs).select("doc_id", "text", "t").mapInArrow(_sketch(words), f"doc_id long, t long, n long, f1 long, f2 long, bands array<long>, {', '.join(f'{o} long' for o in ODD)}")


def most_ones(n: Column, m: Column, percent: int) -> Column:
    """The most ones that the XOR of the odd sketches of two linked sets of n and m shingles shows.

    Linked sets share at least j / (1 + j) (n + m) shingles. The sample of the larger set finds a share p
    of itself in the other one, with the deviation of a draw without replacement; that bounds how many
    sampled shingles differ, and so the ones, with the deviation of balls in bins."""
    j = percent / 100
    root = lambda x: F.sqrt(F.greatest(F.lit(0.0), x))
    large = F.greatest(n, m)
    drawn = F.least(large, F.lit(LEAST)).cast("double")
    p = F.least(F.lit(1.0), F.lit(j / (1 + j)) * (n + m) / large)
    common = drawn * p - DEVIATIONS * root(drawn * p * (1 - p) * (1 - drawn / large))
    differ = F.least(n, F.lit(LEAST)) + F.least(m, F.lit(LEAST)) - 2 * common
    four = F.exp(differ * F.lit(-4 / BITS))
    deviation = root(F.lit(BITS / 4) * (1 - four) - differ * four)
    return F.lit(BITS / 2) * (1 - F.exp(differ * F.lit(-2 / BITS))) + DEVIATIONS * deviation + 1


def _may_link(a: str, b: str, percent: int) -> Column:
    """Sizes and odd sketches allow the similarity."""
    c = lambda t, x: F.col(f"{t}.{x}")
    ones = sum((F.bit_count(c(a, o).bitwiseXOR(c(b, o))) for o in ODD), F.lit(0))
    n, m = c(a, "n"), c(b, "n")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (ones <= most_ones(n, m, percent))


def _confirm(words: int, percent: int):
    def run(batches):
        key, firsts = None, []
        for batch in batches:
            a, chunk, b = (batch.column(i).to_pylist() for i in range(3))
            linked_a, linked_b = [], []
            for at, n, raw, offs in text_parts(batch.column(3), _PART):
                for i, own in enumerate(shingle_sets(raw, offs, words), at):
                    if key != (a[i], chunk[i]):
                        key, firsts = (a[i], chunk[i]), []
                    if b[i] is None:
                        firsts.append(own.copy())
                        continue
                    for x in firsts:
                        both = len(x) + len(own) - len(np.union1d(x, own))
                        if 100 * both >= percent * (len(x) + len(own) - both):
                            linked_a.append(a[i])
                            linked_b.append(b[i])
                            break
            yield pa.RecordBatch.from_arrays([pa.array(linked_a, pa.int64()), pa.array(linked_b, pa.int64())], ["a", "b"])

    return run


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. The members of a first document are dealt out in
    chunks, its text goes to each of them; a task holds one set and streams over the others."""
    held = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    dealt = pairs.join(held, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"), "b")
    members = dealt.join(texts, dealt["b"] == texts["id"]).select("a", "chunk", "b", "text")
    firsts = dealt.select("a", "chunk").distinct().join(texts, F.col("a") == texts["id"]).select("a", "chunk", F.lit(None).cast("long").alias("b"), "text")
    rows = members.unionByName(firsts).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_confirm(words, percent), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root for every node of the edges (a, b): equal roots mean one component.

    Each round maps every node to the least of itself and its neighbours, in an order that a salt
    changes from round to round, and contracts the edges; minima are taken before rows move, so a node
    with very many neighbours isn't one task's. Rounds grow with the logarithm of the nodes."""
    salts = np.random.default_rng(2).integers(0, 1 << 62, 256)
    e = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    steps = []
    while not e.isEmpty():
        salt = F.lit(int(salts[len(steps) % len(salts)]))
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(salt)).alias("m"))
        step = materialise(least.select(F.col("a").alias("node"), F.least(F.col("m"), F.col("a").bitwiseXOR(salt)).bitwiseXOR(salt).alias("root")), "step")
        steps.append(step)
        left, right = (step.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        e = e.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        e = materialise(e, "edges")
    if not steps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[-1]
    for step in steps[-2::-1]:
        later = out.select(F.col("node").alias("root"), F.col("root").alias("last"))
        out = step.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return out


def spread_join(many: DataFrame, few: DataFrame, key: str, by: str) -> DataFrame:
    """many joined with few, which has one row for each key. Rows of many with one key go to SPREAD tasks
    by a hash of `by`, and few's row to each of them, so a key with a third of all rows isn't one task's."""
    left = many.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(SPREAD)))
    right = few.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    return left.join(right, [key, "_part"]).drop("_part")


def across(open_: DataFrame, brief: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of members of a bucket that are in different components and that sizes and odd
    sketches allow, each in the first band that it shares. open_ has key, band, id and root, brief each
    id's n, bands and sketch. A bucket is dealt out in blocks, and each pair of blocks is a group of its
    own; groups aren't merged into fewer tasks, as they hold few bytes for the work that they make."""
    sizes = open_.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.count(F.lit(1)).alias("m")).where("r <> s")
    sizes = sizes.select("key", F.ceil(F.col("m") / BLOCK).cast("long").alias("blocks"))
    rest = spread_join(open_, sizes, "key", "id").join(brief, "id").withColumn("at", F.pmod(F.xxhash64("id", "key"), F.col("blocks")))
    rest = materialise(rest.withColumn("before", F.slice("bands", F.lit(1), F.col("band"))).drop("bands", "band"), "open")
    zero, parts = F.lit(0).cast("long"), int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = rest.withColumn("i", F.col("at")).withColumn("j", F.explode(F.sequence(F.col("at"), F.col("blocks") - 1))).repartition(parts, "key", "i", "j").alias("x")
    y = rest.withColumn("j", F.col("at")).withColumn("i", F.explode(F.sequence(zero, F.col("at")))).repartition(parts, "key", "i", "j").alias("y")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    once = (F.col("x.i") < F.col("x.j")) | (F.col("x.id") < F.col("y.id"))
    fresh = ~F.exists(F.arrays_zip(F.col("x.before").alias("l"), F.col("y.before").alias("r")), lambda z: z["l"] == z["r"])
    both = x.join(y, same & once & (F.col("x.root") != F.col("y.root")) & _may_link("x", "y", percent) & fresh)
    return both.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _linked(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, t, n and, for rows whose set other rows have or are linked with, the least row of their
    component as struct best (doc_id, t); one row for every row of docs. Written."""
    held = materialise(sketches(docs, words), "sketches")
    live = held.where("n > 0 and doc_id is not null")
    # one row for each set, with the sketch that all its copies share and its least row; copies are merged
    # before rows move. The numbers of the sets are fixed by writing them
    sketch = [F.first(c).alias(c) for c in ("bands", *ODD)]
    sets = live.groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "t")).alias("row"), F.count(F.lit(1)).alias("copies"), *sketch)
    sets = materialise(sets.withColumn("id", F.monotonically_increasing_id()), "sets")
    keyed = sets.select("id", F.posexplode("bands").alias("band", "key"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    # a bucket's first member is the one whose buckets hold most members: the text that copies were made of
    # shares more bands with each of them than they do with one another
    score = F.sum("m").over(Window.partitionBy("id"))  # as many rows as bands
    members = materialise(spread_join(keyed, buckets, "key", "id").withColumn("score", score).drop("m"), "members")
    firsts = members.groupBy("key").agg(F.max(F.struct("score", "id")).getField("id").alias("first"))
    brief = sets.select("id", "n", *ODD)

    def sift(pairs: DataFrame) -> DataFrame:
        x, y = brief.alias("x"), brief.alias("y")
        both = pairs.join(x, F.col("a") == F.col("x.id")).join(y, F.col("b") == F.col("y.id"))
        return both.where(_may_link("x", "y", percent)).select("a", "b").distinct()

    starred = spread_join(members, firsts, "key", "id").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    one = materialise(sift(starred.distinct()), "pairs")
    wanted = sets.join(members.select("id").distinct(), "id", "left_semi").select("id", "row.doc_id", "row.t")
    texts = materialise(named(docs).join(wanted, ["doc_id", "t"]).groupBy("id").agg(F.first("text").alias("text")), "texts")
    links = materialise(confirm(one, texts, words, percent), "links")
    roots = components(links)
    # buckets that hold several components still
    open_ = members.select("key", "band", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    done = one.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    two = across(open_, sets.select("id", "n", "bands", *ODD), percent).join(done, ["a", "b"], "left_anti")
    two = materialise(two, "pairs")
    more = links.limit(0) if two.isEmpty() else materialise(confirm(two, texts, words, percent), "links")
    if not more.isEmpty():
        joined = more.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
        merged = components(joined.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
        nodes = links.select(F.col("a").alias("node")).union(links.select("b")).union(more.select("a")).union(more.select("b")).distinct()
        roots = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(merged.select(F.col("node").alias("root"), F.col("root").alias("last")), "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    roots = materialise(roots, "roots")
    slim = sets.select("f1", "f2", "n", "id", "row", "copies").join(roots.withColumnRenamed("node", "id"), "id", "left")
    least = slim.where("root is not null").groupBy("root").agg(F.min("row").alias("best"))
    grouped = slim.join(least, "root", "left").where("copies > 1 or root is not null")
    grouped = grouped.select("f1", "f2", "n", F.coalesce("best", "row").alias("best"))
    out = held.select("doc_id", "t", "n", "f1", "f2").join(grouped, ["f1", "f2", "n"], "left")
    return materialise(out.select("doc_id", "t", "n", F.when(F.col("doc_id").isNotNull(), F.col("best")).alias("best")), "rows")


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    A-Z are lowered; words are runs without white space. component_id is the smallest doc_id that links
    reach, the row's own included; kept is doc_id = component_id. Each row is a document: rows that share
    a doc_id but not their text are linked by their texts alone, so they can have different components.
    Repeated rows are in one component, and those with its smallest doc_id are all kept. Null and empty
    texts have no shingles and are linked with nothing. A row without a doc_id is linked with nothing, has
    no component_id and is kept. Other columns are ignored."""
    out = _linked(docs, words, percent)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("best.doc_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns: one of each component, with its smallest doc_id, and every row
    without a doc_id or without a word. Of equal rows one stays; of rows of one component that share its
    smallest doc_id the one with the least hash of its text."""
    found = _linked(docs, words, percent).where("best is not null")
    own = F.struct("doc_id", "t")
    keys = found.groupBy("doc_id", "t").agg((F.first("best") == own).alias("stays"), F.count(F.lit(1)).alias("n"))
    keys = materialise(keys.select("doc_id", "t", F.when(F.col("stays"), F.col("n")).otherwise(F.lit(0)).alias("n")).where("n <> 1"), "gone")
    id_, hash_ = free_names(docs.columns, "_id", "_hash")
    rows = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(hash_, F.xxhash64("text"))
    on = lambda k: (rows[id_] == k["doc_id"]) & (rows[hash_] == k["t"])
    out = rows.join(keys, on(keys), "left_anti")
    repeated = keys.where("n > 1")
    if not repeated.isEmpty():
        out = out.unionByName(rows.join(repeated, on(repeated), "left_semi").dropDuplicates([id_, hash_]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])

"""N-gram Jaccard join with signature trees.

A document's set holds its distinct shingles of ``n`` words (A-Z in lower
case); with fewer words the whole sequence is its one shingle. Two documents
link when their sets have a Jaccard similarity of ``percent`` / 100 or more.
The result names the connected component of every document; it is exact up to
collisions of 64-bit hashes.

1. *Classes.* Equal sets are one class, so copies cost one row each from here on.
2. *Keys.* Tokens get one order everywhere: by a level of how often their hash
   bucket occurs in the corpus (``2**BUCKET_BITS`` buckets, a fixed size), then by
   hash. Similar sets share a token among their first few in this order, and
   passages in many documents come last. Only keys of two or more classes go on.
3. *Clusters.* Every key points its classes to the least of them. Of such
   targets that the bitmaps allow, a class follows the one with most of its
   keys; following on leads to the root of its cluster.
4. *Trees.* In a cluster, all sets are first compared with the root. Those that
   don't link to it, and those that do, are dealt into blocks; a task gets two
   blocks, builds signature trees over them (see ``trees``) and verifies what
   the dual traversal leaves, skipping pairs that are connected already. Classes
   of different clusters meet under their keys, again in trees over blocks. Of
   the pairs that are left there, each task first gives a forest only, of the
   most similar ones, which a join verifies.
5. *Rest.* The links so far are connected. The keys meet once more, now for all
   pairs that are left and whose classes are not connected yet.
6. *Components* of the links, then of the documents by their class.

Hot groups: copies collapse; a key of many classes is combined before the
shuffle and dealt into blocks of ``BLOCK`` rows; members of a cluster that link
to its root are never paired with each other.

Nulls and edge cases: a null or empty text has the empty set, links with
nothing and is its own component; a null id counts as greater than any other
and shows as null; rows that repeat an id are linked by their texts alone;
texts are taken whole; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from growthcast.llm import trees
from growthcast.llm.components import connected
from growthcast.llm.shingles import Hasher
from growthcast.session import materialise

WORDS, PERCENT = 5, 80
BUCKET_BITS, SLICES = 20, 64
BLOCK = 1_000
#: Bits of a bitmap for each token: in the join of keys, and where whole sets are at hand.
THIN, WIDE = 4, 16
LAST = (1 << 63) - 1


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       n: int = WORDS, percent: int = PERCENT, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id for every row, and the columns to ``carry``."""
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"),
                        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"_{c}") for c in carry))
    kept = "".join(f"_{c} {docs.schema[c].dataType.simpleString()}, " for c in carry)
    levels = texts.sparkSession.sparkContext.broadcast(_levels(texts, n))
    profile = materialise(texts.mapInArrow(_profiles(n, percent, levels), f"doc long, doc_id {docs.schema[id_col].dataType.simpleString()}, {kept}"
                                           "n_shingles long, cls long, sig binary, keys array<long>"), "profiles")
    levels.destroy()
    classes = (profile.where(F.col("cls").isNotNull()).groupBy("cls")
               .agg(F.min("doc").alias("doc"), F.first("n_shingles").alias("size"), F.first("sig").alias("sig")))
    classes = materialise(classes, "classes")
    links = _links(texts, profile, classes, n, percent)
    parts = connected(links)
    named = (classes.select("cls", "doc").join(parts, F.col("cls") == F.col("node"), "left")
             .select("cls", "doc", F.coalesce("component", "cls").alias("component")))
    least = named.groupBy("component").agg(F.min("doc").alias("least"))
    of_class = named.join(least, "component").select("cls", "least")
    out = profile.select("doc", "doc_id", "n_shingles", "cls", *(f"_{c}" for c in carry)).join(of_class, "cls", "left")
    component = F.coalesce("least", "doc")
    return out.select("doc_id", "n_shingles", F.when(component != LAST, component).alias("component_id"), *(F.col(f"_{c}").alias(c) for c in carry))


def _links(texts: DataFrame, profile: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): links that connect the classes; copies of links that others imply may be left out."""
    keys = profile.select("cls", F.col("n_shingles").alias("size"), F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("cls").alias("least"), F.max("cls").alias("most")).where("least != most")
    keyed = materialise(keys.join(shared.select("key", "least"), "key").select("key", "cls", "size", "least").distinct(), "keys")
    # 3. clusters
    sizes = classes.select(F.col("cls").alias("least"), F.col("size").alias("size2"))
    # sizes are compared before any bitmap is sent
    votes = (keyed.where("cls != least").groupBy("cls", "size", "least").agg(F.count("*").alias("votes")).join(sizes, "least")
             .where(100 * F.least("size", "size2") >= percent * F.greatest("size", "size2")))
    allowed = (votes.join(classes.select("cls", "sig"), "cls").join(classes.select(F.col("cls").alias("least"), F.col("sig").alias("sig2")), "least")
               .where(_may(percent)("size", "sig", "size2", "sig2")))
    follow = allowed.groupBy("cls").agg(F.max_by("least", F.struct("votes", -F.col("least"))).alias("least"))
    cluster = materialise(connected(follow, "cls", "least").select(F.col("node").alias("cls"), F.col("component").alias("root")), "clusters")
    # 4. pairs of different clusters
    step = F.floor(F.log("size") / math.log(100 / percent * 1.0001)).cast("int")  # similar sets are one step apart at most
    placed = keyed.select("key", "cls", step.alias("step")).join(cluster, "cls", "left").select("key", "cls", "step", F.coalesce("root", "cls").alias("root"))
    # a class goes on only if its key has another cluster's class within a step
    around = (placed.groupBy("key", "step").agg(F.min("root").alias("r1"), F.max("root").alias("r2"))
              .select("key", F.explode(F.array(*[F.struct((F.col("step") + d).alias("step"), "r1", "r2") for d in (-1, 0, 1)])).alias("x"))
              .groupBy("key", "x.step").agg(F.min("x.r1").alias("r1"), F.max("x.r2").alias("r2")).where("r1 != r2").select("key", "step"))
    near = materialise(placed.join(around, ["key", "step"]).select("key", "cls", "root"), "near")
    sigs = classes.select("cls", "size", "sig")
    first = materialise(_met(near.withColumn("part", F.col("root")), sigs, percent, forest=True), "forest")
    # the sets of all classes that are compared as wholes, now or in 5.
    open_ = first.select(F.col("a").alias("cls")).union(first.select("b")).distinct()
    wanted = classes.select("cls", "doc").join(cluster.select("cls").union(open_).distinct(), "cls").join(cluster, "cls", "left")
    sets = materialise(texts.select("doc", "text").join(wanted, "doc").mapInArrow(_sets(n), "cls long, root long, tokens binary").dropDuplicates(["cls"]), "sets")
    tried = first.where("a != b")
    found = _verified(tried, sets, percent).union(_within(sets.where(F.col("root").isNotNull()), percent))
    # 5. what is not connected yet
    parts = materialise(connected(found), "parts")
    left = near.join(open_, "cls").join(parts, F.col("cls") == F.col("node"), "left").select("key", "cls", "root", F.coalesce("component", "cls").alias("part"))
    still = (left.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.min("part").alias("p1"), F.max("part").alias("p2"))
             .where("r1 != r2 AND p1 != p2").select("key"))
    rest = materialise(_met(left.join(still, "key"), sigs, percent, forest=False).join(tried, ["a", "b"], "left_anti"), "rest")
    return parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(_verified(rest, sets, percent))


def _met(near: DataFrame, sigs: DataFrame, percent: int, forest: bool) -> DataFrame:
    """(a, b): pairs that the trees over the blocks of each key leave; of keys with the same classes one is enough."""
    same = (near.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("cls")).alias("h1"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("h2"))
            .groupBy("n", "h1", "h2").agg(F.min("key").alias("key")).select("key"))
    near = near.join(same, "key")
    mixed = near.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    group = near.join(mixed, "key").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = group.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "root", "part")
    # bitmaps come last, so that they are shuffled once
    return (dealt.join(sigs, "cls").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
            .mapInArrow(_cross(percent, forest), "a long, b long").distinct())


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("cls").alias("a"), F.col("tokens").alias("x"))
    b = sets.select(F.col("cls").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(a, "a").join(b, "b").where(_similar(percent)("x", "y")).select("a", "b")


def _within(sets: DataFrame, percent: int) -> DataFrame:
    """Links of the clusters: of every set with its root if they link, and those that the others have."""
    root = sets.where("cls = root").select("root", F.col("tokens").alias("y"))
    star = sets.join(root, "root").select("cls", "root", "tokens", _similar(percent)("tokens", "y").alias("linked"))
    star = materialise(star, "stars")
    counts = (star.groupBy("root").agg(F.count_if("linked").alias("g"), F.count_if(~F.col("linked")).alias("o"))
              .where("o > 0").select("root", F.ceil(F.col("g") / BLOCK).cast("int").alias("g"), F.ceil(F.col("o") / BLOCK).cast("int").alias("o")))
    own = F.pmod(F.xxhash64("cls"), F.when(F.col("linked"), F.col("g")).otherwise(F.col("o"))).cast("int")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    # task (i, j): outliers of block i with linked sets of block j, or, as (i, -1 - j), with outliers of block j >= i
    outlier = F.concat(F.transform(upto("g"), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"))),
                       F.transform(upto("o"), lambda j: F.struct(F.least("own", j).alias("i"), (-1 - F.greatest("own", j)).alias("j"))))
    linked = F.transform(upto("o"), lambda i: F.struct(i.alias("i"), F.col("own").alias("j")))
    tasks = (star.join(counts, "root").withColumn("own", own)
             .withColumn("task", F.explode(F.when(F.col("linked"), linked).otherwise(outlier))))
    rest = (tasks.select("root", "task.i", "task.j", "own", "linked", "cls", "tokens")
            .groupBy("root", "i", "j").applyInPandas(_inner(percent), "a long, b long"))
    return rest.union(star.where("linked and cls != root").select(F.col("cls").alias("a"), F.col("root").alias("b")))


def _shingles(text: str | None, n: int, hasher: Hasher, distinct: bool = True) -> np.ndarray:
    """Shingles of a text, in order of their hash if distinct."""
    # bytes.lower() changes A-Z alone
    runs = hasher.runs((text or "").encode("utf-8", "replace").lower())
    if 0 < runs.n < n:
        return runs.of(runs.n) ^ np.uint64(runs.n)
    return np.unique(runs.of(n)) if distinct else runs.of(n)


def _class_of(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64))


def _profiles(n: int, percent: int, levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, level = Hasher(), levels.value
        for batch in batches:
            size, cls, sig, keys, before = [], [], [], [], [c for c in batch.schema.names if c != "text"]
            for text in batch.column("text"):
                tokens = _shingles(text.as_py(), n, hasher)
                size.append(len(tokens))
                cls.append(_class_of(tokens) if len(tokens) else None)
                sig.append(trees.bitmap(tokens, trees.width(len(tokens), THIN)).tobytes() if len(tokens) else None)
                # the tokens are in order of hash, which a stable sort keeps
                first = len(tokens) - -(-percent * len(tokens) // 100) + 1 if len(tokens) else 0
                keys.append(tokens[np.argsort(level[_bucket(tokens)], kind="stable")[:first]].view(np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in before), pa.array(size, pa.int64()), pa.array(cls, pa.int64()), pa.array(sig, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))],
                [*before, "n_shingles", "cls", "sig", "keys"])
    return run


def _levels(texts: DataFrame, n: int) -> np.ndarray:
    """Level of every hash bucket: twice the binary logarithm of its count over the mean; one byte for each of 2**BUCKET_BITS."""
    per = (1 << BUCKET_BITS) // SLICES

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts = Hasher(), np.zeros(1 << BUCKET_BITS, np.int32)
        for batch in batches:
            for text in batch.column("text"):
                np.add.at(counts, _bucket(_shingles(text.as_py(), n, hasher, distinct=False)), 1)
        used = np.flatnonzero(counts.reshape(SLICES, per).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([counts[k * per:(k + 1) * per].tobytes() for k in used], pa.binary())], ["k", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column("k").to_pylist(), batch.column("counts")):
                sums[k] = sums.get(k, 0) + np.frombuffer(part.as_buffer(), np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["k", "counts"])

    schema = "k int, counts binary"
    slices = texts.select("text").mapInArrow(tally, schema).repartition(SLICES, "k").mapInArrow(total, schema).collect()
    # slice by slice: doubles of all buckets at once would take 8 MB each time
    mean = max(sum(int(np.frombuffer(row["counts"], np.int64).sum()) for row in slices) / (1 << BUCKET_BITS), 1.0)
    levels = np.zeros((SLICES, per), np.uint8)
    for row in slices:
        levels[row.k] = np.floor(2 * np.log2(np.maximum(np.frombuffer(row["counts"], np.int64) / mean, 1)))
    return levels.ravel()


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            cls, root, out = [], [], []
            for text, c, r in zip(batch.column("text"), batch.column("cls").to_pylist(), batch.column("root").to_pylist()):
                tokens = _shingles(text.as_py(), n, hasher)
                if len(tokens) and _class_of(tokens) == c:  # rows of one id may have other texts
                    cls.append(c)
                    root.append(r)
                    out.append(tokens.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(root, pa.int64()), pa.array(out, pa.binary())], ["cls", "root", "tokens"])
    return run


def _may(percent: int):
    @F.pandas_udf("boolean")
    def may(size: pd.Series, sig: pd.Series, size2: pd.Series, sig2: pd.Series) -> pd.Series:
        out = []
        for s, x, s2, y in zip(size, sig, size2, sig2):
            if 100 * min(s, s2) < percent * max(s, s2):
                out.append(False)
                continue
            x, y = (np.frombuffer(m, np.uint64)[None] for m in (x, y))
            w = min(x.shape[1], y.shape[1])
            x, y = trees.fold(x, w), trees.fold(y, w)
            excess = min(s - np.bitwise_count(x).sum(), s2 - np.bitwise_count(y).sum())
            out.append(bool((np.bitwise_count(x & y).sum() + excess) * (100 + percent) >= percent * (s + s2)))
        return pd.Series(out, dtype=bool)
    return may


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _similar(percent: int):
    @F.pandas_udf("boolean")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in zip(x, y)], dtype=bool)
    return similar


def _cross(percent: int, forest: bool):
    """Pairs of classes of different clusters and parts that the signature trees leave, for each pair of blocks of a key.

    With ``forest``, only the most similar ones that connect the parts, and each class that is in a pair with itself.

    Rows come in order of their group. Trees of at most ``trees.FAN`` leaves, most
    of them, are roots only, so their pairs are taken for many groups at once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _and_last(batches):
            if batch is not None:
                held = batch if held is None else pa.concat_batches([held, batch])
                if held.num_rows < 2 * BLOCK:
                    continue
            if held is None or not held.num_rows:
                continue
            group = np.stack([held.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")])
            start = np.flatnonzero(np.append(True, (group[:, 1:] != group[:, :-1]).any(0)))
            # the last group may go on in the next batch
            upto = held.num_rows if batch is None else int(start[-1])
            if upto:
                yield _cross_rows(held.slice(0, upto), start[start < upto], percent, forest)
                held = held.slice(upto)
    return run


def _and_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _cross_rows(rows: pa.RecordBatch, start: np.ndarray, percent: int, forest: bool) -> pa.RecordBatch:
    cls, root, part, size, own, i, j = (rows.column(c).to_numpy() for c in ("cls", "root", "part", "size", "own", "i", "j"))
    maps = [np.frombuffer(m.as_buffer(), np.uint64) for m in rows.column("sig")]
    length = np.diff(np.append(start, rows.num_rows))
    pairs = []
    for n in range(2, trees.FAN + 1):
        first = start[length == n]
        p, q = np.triu_indices(n, 1)
        pairs.append(((first[:, None] + p).ravel(), (first[:, None] + q).ravel()))
    x, y = (np.concatenate(z) for z in zip(*pairs))
    across = (root[x] != root[y]) & (part[x] != part[y]) & ((i[x] == j[x]) | (own[x] != own[y]))
    x, y = x[across], y[across]
    may = trees.possible_leaves(size, maps, x, y, percent)
    found = [(x[may], y[may])]
    for s, n in zip(start[length > trees.FAN].tolist(), length[length > trees.FAN].tolist()):
        side = (own[s:s + n] != i[s]).astype(np.int64) if i[s] != j[s] else None
        found += [(x + s, y + s) for x, y in trees.candidate_pairs(size[s:s + n], maps[s:s + n], percent, side)]
    x, y = (np.concatenate(z) for z in zip(*found))
    apart = (root[x] != root[y]) & (part[x] != part[y])
    x, y = x[apart], y[apart]
    if forest:
        both = trees.shared_leaves(size, maps, x, y)
        keep = _forest(part, x, y, both / (size[x] + size[y] - both))
        used = np.unique(np.concatenate((x, y)))
        x, y = np.concatenate((x[keep], used)), np.concatenate((y[keep], used))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(cls[x], cls[y])), pa.array(np.maximum(cls[x], cls[y]))], ["a", "b"])


def _forest(part: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the pairs of a heaviest spanning forest of the parts: each part takes its heaviest pair, round by round."""
    if not len(x):
        return np.empty(0, np.int64)
    names, label = np.unique(part, return_inverse=True)
    edge = np.argsort(-weight, kind="stable")
    taken = []
    while True:
        p, q = label[x[edge]], label[y[edge]]
        edge, p, q = edge[p != q], p[p != q], q[p != q]
        if not len(edge):
            return np.array(taken, np.int64)
        best = np.full(len(names), len(edge))
        for side in (p, q):
            np.minimum.at(best, side, np.arange(len(edge)))
        up = np.arange(len(names))

        def top(k: int) -> int:
            while up[k] != k:  # noqa: B023
                up[k] = up[up[k]]  # noqa: B023
                k = up[k]  # noqa: B023
            return k

        for k in np.unique(best[best < len(edge)]).tolist():
            a, b = top(p[k]), top(q[k])
            if a != b:
                up[a] = b
                taken.append(edge[k])
        label = np.array([top(k) for k in range(len(names))])[label]


def _inner(percent: int):
    """Links between two blocks of a cluster that connect what isn't connected yet."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cls, linked, own = (rows[c].to_numpy() for c in ("cls", "linked", "own"))
        sets = [np.frombuffer(t, np.uint64) for t in rows["tokens"]]
        sizes = np.array([len(s) for s in sets])
        maps = [trees.bitmap(s, trees.width(len(s), WIDE)) for s in sets]
        i, j = rows["i"].iloc[0], rows["j"].iloc[0]
        side = linked.astype(np.int64) if j >= 0 else (own != i).astype(np.int64) if i != -1 - j else None
        # all that link to the root are one part
        part = np.where(linked, -1, np.arange(len(cls)))
        a, b = [], []
        for x, y in trees.candidate_pairs(sizes, maps, percent, side):
            for p, q in zip(x.tolist(), y.tolist()):
                if part[p] != part[q] and _linked(sets[p], sets[q], percent):
                    part[part == part[p]] = part[q]
                    a.append(cls[p])
                    b.append(cls[q])
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")
    return run

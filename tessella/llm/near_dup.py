"""Near-duplicate texts as sets of words: sketch, band, keep candidates, verify exactly.

Stages, all distributed:

1. *Classes.* Texts with the same set of words collapse into one class (map-side combined), represented by one of its
   rows. A text copied into a third of all rows is one class from here on.
2. *Bands.* Every class is sketched over all its words, so that no kind of pair is out of reach: a pair of similarity s
   shares a band with probability 1 - (1 - s^rows)^bands. Band hashes travel as packed planes per shuffle part, never as
   rows, with the size of the set and a 56-bit parity map of its words. A part holds about ``PART`` entries however
   large the data are, and is one task; within it, buckets are told apart by 40 more bits.
3. *Candidates.* Each part sorts its entries and pairs equal hashes. Words that stand in most texts make most of these
   meet by chance, so a pair goes on only if sizes and parity maps allow the measure: maps differ in no more bits than
   the sets do in words, so no pair is lost. Buckets beyond ``LIMIT`` classes are banded again by another sketch, so the
   work stays in proportion to the entries. Buckets beyond ``STAR`` members emit stars instead of all pairs where only
   links are wanted; members that fail verification are compared with the whole star afterwards, so no link is lost.
4. *Verification.* The exact Jaccard similarity of the word sets themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import sketches as sk
from tessella.operators.skew import hot_keys, join_parts, salted_join
from tessella.session import cut, written

BLOCK = 32_768  # classes sketched at once
PART = 1_000_000  # entries of a shuffle part, about: 12 MB as shuffled, 25 MB as arrays
LIMIT = 16_384  # classes of a bucket from which it is banded again
STAR = 64  # bucket size from which links go over a star
CHUNK = 500_000  # pairs looked at at once
BROADCAST = 1_000_000  # ids up to which a list of texts to verify is broadcast (8 MB); longer ones are shuffled


def word_set(text: Column) -> Column:
    """Sorted different words: runs of a-z and 0-9 after lower-casing. Null for null."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)))


def word_table(df: DataFrame, key: str, text: str, least: int, flag: Column | None = None) -> DataFrame:
    """(rid, key, flag, w) of texts with at least ``least`` different words, ``w`` being the sorted words with a space
    between and ``rid`` a number of the row. Texts are cut into words once, here, and the result is written as a table,
    as all later stages read it. Null, empty and short texts and null keys drop out: they are no case of the measure."""
    # a generator, as a filter on the words would be pushed below and find them a second time
    kept = F.explode(F.filter(F.array(word_set(F.col(f"`{text}`"))), lambda w: F.size(w) >= least))
    rows = df.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), (F.lit(0) if flag is None else flag).alias("flag"), kept.alias("words"))
    return written(rows.select(F.monotonically_increasing_id().alias("rid"), "key", "flag", F.array_join("words", " ").alias("w")), "words")


def band_entries(classes: DataFrame, rows: int, n_bands: int, method: str, parts: int, salt: int = 1) -> DataFrame:
    """``classes``: (tag bigint, flag int, parent bigint, hashes array<bigint>). Returns (part, blob): the packed band
    entries of each block of classes by part. Classes with different parents never share a bucket."""
    t = rows * n_bands
    sketch = {"minwise": sk.minwise, "fast": sk.fast_similarity}[method]
    low_bits = np.uint64((1 << sk.LOW) - 1)

    def block(tags, flags, parents, values, lengths):
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        values = values.view(np.uint64)
        hashes = sk.bands(sketch(values, starts, t, salt), rows, 13)
        hashes = (sk.mix(hashes ^ sk.mix(parents.view(np.uint64))[:, None]) if parents.any() else hashes).ravel()
        part = (hashes >> np.uint64(sk.LOW)) % np.uint64(parts)
        key = (part << np.uint64(sk.LOW)) | (hashes & low_bits)
        order = np.argsort(key)
        key, owner = key[order], order // n_bands
        tags, flags, maps, sizes = tags[owner], flags[owner], sk.parity(values, starts)[owner], np.minimum(lengths, sk.LONG)[owner]
        edges = np.searchsorted(key, np.arange(parts + 1, dtype=np.uint64) << np.uint64(sk.LOW))
        kept = np.flatnonzero(edges[1:] > edges[:-1])
        blobs = []
        for p in kept:
            mine = slice(edges[p], edges[p + 1])
            blobs.append(sk.pack(key[mine] & low_bits, tags[mine], flags[mine], maps[mine], sizes[mine]))
        return pa.RecordBatch.from_arrays([pa.array(kept.astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "blob"])

    def run(batches):
        held, count = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column("hashes")
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            held.append((b.column("tag").to_numpy(), b.column("flag").to_numpy(), b.column("parent").to_numpy(), values, np.diff(offsets)))
            count += b.num_rows
            if count >= BLOCK:
                yield block(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, count = [], 0
        if count:
            yield block(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return classes.mapInArrow(run, "part int, blob binary")


def bucket_pairs(entries: DataFrame, parts: int, least: float, cross: bool, star: bool, limit: int | None) -> DataFrame:
    """Candidate pairs (a, b, bucket, mark, size) with a < b that may reach ``least``. ``cross``: one must have flag 1 and the
    other flag 2. ``bucket`` is set for pairs of a star and names it, ``mark`` and ``size`` then are parity
    map and size of the member that isn't its centre. Members of buckets beyond ``limit`` come out with null ``b``, the
    bucket and, as mark, their flag."""
    share = (1 - least) / (1 + least)

    def batch(a, b, bucket, mark, size):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, bucket, mark, size], names=["a", "b", "bucket", "mark", "size"])

    def runs(part, hashes, tags, flags, maps, sizes):
        order = np.argsort(hashes, kind="stable")
        hashes, tags, flags, maps, sizes = hashes[order], tags[order], flags[order], maps[order], sizes[order]

        def near(i, j):
            """Whether entries i and j may be a pair."""
            a, b = sizes[i], sizes[j]
            apart = np.maximum(np.bitwise_count(maps[i] ^ maps[j]), np.abs(a - b))
            return (apart <= share * (a + b) + 1e-6) | (np.maximum(a, b) >= sk.LONG)

        def emit(i, j):
            ok = near(i, j) & (tags[i] != tags[j])
            if cross:
                ok &= ((flags[i] & 1) & (flags[j] >> 1) | (flags[i] >> 1) & (flags[j] & 1)).astype(bool)
            one, two = tags[i[ok]], tags[j[ok]]
            return np.stack([np.minimum(one, two), np.maximum(one, two)], axis=1)

        def grid(one, two, same=False):
            """Pairs of members whose sizes allow the measure; ``same``: of one list with itself."""
            one, two = one[np.argsort(sizes[one], kind="stable")], two[np.argsort(sizes[two], kind="stable")]
            length, x = sizes[two], 0
            while x < len(one):
                left = one[x : x + max(1, min(256, CHUNK // max(1, len(two))))]
                low = x if same else np.searchsorted(length, least * sizes[left[0]] - 1e-6)
                most = sizes[left[-1]] / least + 1e-6
                right = two[low : len(two) if most >= sk.LONG else np.searchsorted(length, most, "right")]
                i, j = np.repeat(np.arange(len(left)), len(right)), np.tile(np.arange(len(right)), len(left))
                if same:
                    i, j = i[j > i], j[j > i]
                yield emit(left[i], right[j])
                x += len(left)

        def stars(rest, bucket):
            """A star takes in what may be similar to its centre; those of one star meet those of no star or a later one
            directly."""
            level = 0
            while len(rest) > STAR:
                centre, others = rest[0], rest[1:]
                hit = near(centre, others)
                mine, rest = others[hit & (tags[others] != tags[centre])], others[~hit]
                if len(mine):
                    name = int(sk.mix(np.array([bucket], dtype=np.uint64) ^ sk.mix(np.array([level + 1], dtype=np.uint64)))[0] >> np.uint64(1))
                    yield name, tags[centre], mine
                    for found in grid(mine, rest):
                        yield None, found, None
                level += 1
            i, j = np.triu_indices(len(rest), 1)
            yield None, emit(rest[i], rest[j]), None

        starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        counts = np.diff(np.append(starts, len(hashes)))
        for m in np.unique(counts[counts > 1]):
            at = starts[counts == m]
            if m <= STAR:
                i, j = np.triu_indices(m, 1)
                step = max(1, CHUNK // len(i))
                for s in range(0, len(at), step):
                    members = at[s : s + step, None] + np.arange(m)
                    yield None, emit(members[:, i].ravel(), members[:, j].ravel()), None
                continue
            for s in at:  # few: a bucket of more than STAR classes
                members = s + np.argsort(tags[s : s + m], kind="stable")
                bucket = (part << sk.LOW) | int(hashes[s])
                if limit is not None and m > limit:
                    k = len(members)
                    yield batch(tags[members], pa.nulls(k, pa.int64()), pa.array(np.full(k, bucket)), pa.array(flags[members].astype(np.int64)), pa.array(sizes[members]))
                elif star:
                    for name, what, mine in stars(members, bucket):
                        if name is None:
                            yield None, what, None
                            continue
                        lo, hi = np.minimum(what, tags[mine]), np.maximum(what, tags[mine])
                        # the centre has the smallest tag, so it is a
                        yield batch(lo, pa.array(hi, pa.int64()), pa.array(np.full(len(mine), name)), pa.array(maps[mine].astype(np.int64)), pa.array(sizes[mine]))
                else:
                    sides = (members[flags[members] & 1 == 1], members[flags[members] & 2 == 2]) if cross else (members, members, True)
                    for found in grid(*sides):
                        yield None, found, None

    def run(batches):
        held: dict[int, list[bytes]] = {}
        for b in batches:
            for p, blob in zip(b.column("part").to_pylist(), b.column("blob"), strict=True):
                held.setdefault(p, []).append(blob.as_buffer().to_pybytes())

        def plain(waiting):
            both = np.unique(np.concatenate(waiting), axis=0)
            none = pa.nulls(len(both), pa.int64())
            return batch(both[:, 0], pa.array(both[:, 1], pa.int64()), none, none, none)

        for p in list(held):
            entries = (np.concatenate(x) for x in zip(*(sk.unpack(blob) for blob in held.pop(p)), strict=True))
            waiting, count = [], 0
            for found in runs(p, *entries):
                if isinstance(found, pa.RecordBatch):
                    yield found
                    continue
                pairs = found[1]
                if len(pairs):
                    waiting.append(pairs)
                    count += len(pairs)
                if count >= CHUNK:
                    yield plain(waiting)
                    waiting, count = [], 0
            if count:
                yield plain(waiting)

    return entries.repartitionById(parts, "part").mapInArrow(run, "a bigint, b bigint, bucket bigint, mark bigint, size bigint")


def jaccard_at_least(wa: Column, wb: Column, least: float) -> Column:
    shared = F.size(F.array_intersect(wa, wb))
    return shared >= F.lit(least) * (F.size(wa) + F.size(wb) - shared) - 1e-9


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """``pairs`` (a, b, ...) with ``ok``: whether the word sets of the two texts meet the measure exactly. Only texts
    named in a pair are shuffled on."""
    named = cut(pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct())
    if named.count() <= BROADCAST:
        named = F.broadcast(named)
    sets = written(texts.join(named, "rid", "left_semi").select("rid", "w"), "sets").select("rid", F.split("w", " ").alias("words"))
    one = sets.withColumnsRenamed({"rid": "a", "words": "wa"})
    two = sets.withColumnsRenamed({"rid": "b", "words": "wb"})
    return pairs.join(one, "a").join(two, "b").withColumn("ok", jaccard_at_least(F.col("wa"), F.col("wb"), least)).drop("wa", "wb")


def _candidates(classes: DataFrame, n: int, texts: DataFrame, least: float, rows: int, n_bands: int, method: str, cross: bool, star: bool) -> DataFrame:
    """Candidates of (tag, flag, w) ``classes``, ``n`` at most; crowded buckets are banded a second time."""

    def hashed(df: DataFrame, parent: Column) -> DataFrame:
        return df.select("tag", F.col("flag").cast("int").alias("flag"), parent.alias("parent"), F.transform(F.split("w", " "), lambda x: F.xxhash64(x)).alias("hashes"))

    parts = max(1, -(-n * n_bands // PART))
    entries = band_entries(hashed(classes, F.lit(0).cast("bigint")), rows, n_bands, method, parts)
    found = written(bucket_pairs(entries, parts, least, cross, star, LIMIT), "pairs")
    crowded = found.where("b is null")
    again = crowded.count()
    if not again:
        return found
    members = crowded.select(F.col("a").alias("rid"), F.col("bucket").alias("parent"), F.col("mark").alias("flag")).join(texts.select("rid", "w"), "rid")
    parts = max(1, -(-again * n_bands // PART))
    entries = band_entries(hashed(members.withColumnRenamed("rid", "tag"), F.col("parent")), rows, n_bands, method, parts, salt=5)
    return found.where("b is not null").unionByName(written(bucket_pairs(entries, parts, least, cross, star, None), "pairs"))


def similar_classes(
    texts: DataFrame, *, method: str, least: float, rows: int, n_bands: int, cross: bool = False, star: bool = False
) -> DataFrame:
    """Pairs (a, b) of class representatives, named by ``rid``, whose word sets reach ``least``. ``cross`` limits pairs
    to those of flags 1 and 2; ``star`` compares large buckets over the centres of stars where only links are wanted."""
    classes = texts.groupBy("w").agg(F.min("rid").alias("tag"), F.bit_or("flag").alias("flag"))
    found = _candidates(classes, texts.count(), texts, least, rows, n_bands, method, cross, star)
    if not star:
        pairs = cut(found.select("a", "b").distinct())
        return verified(pairs, texts, least).where("ok").select("a", "b")
    marked = F.collect_set(F.when(F.col("bucket").isNotNull(), F.struct("bucket", "mark", "size"))).alias("buckets")
    checked = cut(verified(cut(found.groupBy("a", "b").agg(marked)), texts, least))
    links = checked.where("ok").select("a", "b")
    stars = checked.where("size(buckets) > 0").select("a", "b", "ok", F.explode("buckets").alias("s")).select("a", "b", "ok", "s.*")
    if stars.where("not ok").isEmpty():
        return links
    # members that aren't linked to their star's centre meet the whole star
    lone = stars.where("not ok").select("bucket", F.col("b").alias("x"), F.col("mark").alias("mx"), F.col("size").alias("sx"))
    members = stars.select("bucket", F.col("b").alias("y"), F.col("mark").alias("my"), F.col("size").alias("sy"))
    sx, sy, bits = F.col("sx"), F.col("sy"), F.bit_count(F.col("mx").bitwiseXOR(F.col("my")))
    may = F.greatest(bits, F.abs(sx - sy)) <= (1 - least) / (1 + least) * (sx + sy) + 1e-6
    rest = lone.join(members, "bucket").where(F.col("x") != F.col("y")).where(may | (F.greatest(sx, sy) >= sk.LONG))
    rest = rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return links.unionByName(verified(cut(rest), texts, least).where("ok").select("a", "b")).distinct()


def row_classes(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (key, flag, k1, k2) and classes (k1, k2, rep, first, last, flags, n) of all texts that take part. A key
    delivered several times has several rows, so ``n`` is only a weight."""
    rows = texts.select("rid", "key", "flag", F.xxhash64("w").alias("k1"), F.xxhash64("w", F.lit(7)).alias("k2"))
    return rows.drop("rid"), rows.groupBy("k1", "k2").agg(
        F.min("rid").alias("rep"), F.min("key").alias("first"), F.max("key").alias("last"), F.bit_or("flag").alias("flags"), F.count(F.lit(1)).alias("n")
    )


def cross_split_classes(
    df: DataFrame, key: str, text: str, split: str, train: str = "train", *, least: float = 0.7, min_words: int = 10,
    rows: int = 4, n_bands: int = 28,
) -> tuple[DataFrame, DataFrame]:
    """The overlaps of train with other splits without expanding copies: *members* (class_id, key, side), one row per
    row of an overlapping class, side 1 being train; and *links* (a, b), each class ``a`` with train rows beside each
    class ``b`` with others that is similar or the same. ``class_id`` is the smallest key of a class.

    Null, empty and short texts, null keys, and rows without a split take no part. A key delivered several times counts
    once. Minwise hashing: a pair at just 0.7 is missed with a probability of (1 - 0.7^4)^28 = 0.0005.
    """
    side = F.when(F.col(f"`{split}`") == train, 1).when(F.col(f"`{split}`").isNotNull(), 2)
    texts = word_table(df.where(side.isNotNull()), key, text, min_words, side)
    found = cut(similar_classes(texts, method="minwise", least=least, rows=rows, n_bands=n_bands, cross=True))
    members, classes = row_classes(texts)
    wanted = found.select(F.col("a").alias("rep")).unionByName(found.select(F.col("b").alias("rep"))).distinct().withColumn("linked", F.lit(True))
    classes = cut(classes.join(wanted, "rep", "left").where("flags = 3 or linked").withColumnRenamed("first", "class_id"))
    placed = cut(salted_join(members, classes.select("k1", "k2", "class_id", "n"), ["k1", "k2"], "n", "key").select("class_id", "key", F.col("flag").alias("side")).distinct())
    ends = classes.select("rep", "class_id", "flags")
    named = found.join(ends.toDF("a", "ca", "fa"), "a").join(ends.toDF("b", "cb", "fb"), "b")
    there = named.where("fa & 1 = 1 and fb & 2 = 2").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    back = named.where("fb & 1 = 1 and fa & 2 = 2").select(F.col("cb").alias("a"), F.col("ca").alias("b"))
    own = classes.where("flags = 3").select(F.col("class_id").alias("a"), F.col("class_id").alias("b"))
    return placed, cut(there.unionByName(back).unionByName(own))


def cross_split_links(df: DataFrame, key: str, text: str, split: str, train: str = "train", **how) -> DataFrame:
    """(key, class_id, n_links): each row that overlaps with the other side, its class and its number of partners."""
    members, links = cross_split_classes(df, key, text, split, train, **how)
    sizes = members.groupBy("class_id", "side").agg(F.count(F.lit(1)).alias("n"))
    train_n, other_n = (sizes.where(F.col("side") == s).select(F.col("class_id").alias(c), "n") for s, c in ((1, "a"), (2, "b")))
    links_of = (
        links.join(other_n, "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("n_links")).withColumn("side", F.lit(1))
        .unionByName(links.join(train_n, "a").groupBy(F.col("b").alias("class_id")).agg(F.sum("n").alias("n_links")).withColumn("side", F.lit(2)))
    )
    facts = cut(links_of.join(sizes, ["class_id", "side"]))
    return salted_join(members, facts, ["class_id", "side"], "n", "key").select("key", "class_id", "n_links")


def cross_split_pairs(df: DataFrame, key: str, text: str, split: str, train: str = "train", **how) -> DataFrame:
    """Pairs (row_id_a < row_id_b) of a train row and a row of another split with similar or equal word sets, as
    ``cross_split_classes`` finds them. All row pairs come out, so copies multiply; use the classes where they are
    many. Hot classes are joined in parts on either side."""
    members, links = cross_split_classes(df, key, text, split, train, **how)
    left = members.where("side = 1").select(F.col("class_id").alias("a"), F.col("key").alias("x"))
    right = members.where("side = 2").select(F.col("class_id").alias("b"), F.col("key").alias("y"))
    sizes = cut(left.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    asked = cut(links.join(sizes, "a").groupBy("b").agg(F.sum("n").alias("n")))  # rows that will look for b
    half = join_parts(left, links, ["a"], hot_keys(sizes, "a", "n"), "x")
    both = join_parts(half, right, ["b"], hot_keys(asked, "b", "n"), "x")
    return both.select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b"))


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every end of a link; root is the smallest id connected with it. Alternating large-star and
    small-star steps (Kiveris et al. 2014), each cut by a checkpoint; about log(diameter) rounds. The centre of a giant
    component is a hot key and joined in parts."""

    def least_of(pairs: DataFrame) -> DataFrame:
        return cut(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))

    def state(edges: DataFrame):
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = least_of(both).withColumn("m", F.least("m", "u"))
        large = salted_join(both, low, ["u"], "n", "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        low = least_of(large)
        small = salted_join(large, low, ["u"], "n", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").distinct())
        now = state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def near_duplicate_groups(
    df: DataFrame, key: str, text: str, *, least: float = 0.7, min_words: int = 10, rows: int = 4, n_bands: int = 28,
) -> DataFrame:
    """(id, group_id, class_id) for each row in a group of at least two rows. Groups are everything linked by similar
    texts, directly or through others; ``group_id`` is the smallest key of the group, ``class_id`` that of the rows
    with the same word set. Sketches are fast similarity sketches. Null, empty and short texts and null keys are in no
    group; a key delivered several times counts once."""
    texts = word_table(df, key, text, min_words)
    links = similar_classes(texts, method="fast", least=least, rows=rows, n_bands=n_bands, star=True)
    roots = components(links)
    members, classes = row_classes(texts)
    grouped = cut(classes.join(roots.withColumnRenamed("id", "rep"), "rep", "left").where("root is not null or last > first").withColumn("root", F.coalesce("root", "rep")))
    heads = grouped.groupBy("root").agg(F.min("first").alias("group_id"))
    grouped = cut(grouped.join(heads, "root").select("k1", "k2", "n", "group_id", F.col("first").alias("class_id")))
    placed = salted_join(members, grouped, ["k1", "k2"], "n", "key")
    return placed.select(F.col("key").alias("id"), "group_id", "class_id").distinct()

"""N-gram Jaccard join with PartEnum signatures.

A document's set holds the hashes of its distinct word shingles. Two sets of sizes n and m have a Jaccard
similarity of at least SHARE/100 only if they differ in at most d = (100 - SHARE)(n + m) / (100 + SHARE) elements.
Sizes fall into bands; in a band the feature domain is cut into parts by a hash, and a set has one
signature for each part that it fills. A differing element spoils one part at most, so of the p parts
that a set fills at least p - d agree with the partner's. Sets so near to a lower band that they can have partners there
have that band's signatures too. In the lowest band each feature is a part of its own.

Only as many signatures as needed are compared. In any order that is the same for all sets, a set may leave
out its last ones as long as one that must agree is left: first some by their hashes, before anything is
shuffled; then, when it is known how many sets have each, the most frequent ones. A set that shares
fewer signatures than must agree has no partner and is dropped. So a passage that stands in very many
documents makes no candidates among documents that are otherwise different.

Documents with equal sets are one class from the start, known by a hash of the set, and only classes are compared.
Of the classes that share a signature the one that shares most is the hub. First each class is verified against
the hub that it meets most often; then, where a signature still joins different components, classes outside
the largest are verified against some others of it, and at last every pair of classes across those that
are left, so no link that joins components is lost and no group emits all its pairs. Verification counts the intersection of whole sets.

Defined results: a row without a doc_id counts by its text, and is no component's smallest doc_id unless all others lack one
too; a null or empty text, or one without words, has an empty set and is linked with nothing; fewer words than a shingle make one shingle; repeated rows and ties are in one class; an empty table gives an
empty table. Words and shingles are compared by 64-bit hashes, sets in verification by 48 bits of them.
Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.base import release_memory, releasing, shared_dir, shuffle_partitions, small_batches, stored
from quillon.llm.bpe import batches
from quillon.llm.packed import by_key, mix, pack, rolling, unpack, word_hashes

SHINGLE, SHARE = 5, 75
#: Smallest size of the first band whose domain is cut into parts; each band ends at BAND times its start.
FIRST, BAND = 256, 4
#: Parts of a band's domain, as a share of its largest size.
PARTS = 0.45
#: Share of the signatures that need not be compared that is left out before the shuffle.
EARLY = 0.7
#: Signatures of a bucket and of a group of sets, about 10 bytes each; their numbers follow the input, not the cluster.
BUCKET = 1 << 20
#: Members of a signature's group that one row holds.
CHUNK = 4096
#: Words whose signatures are sent together, and members verified against one copy of their hub.
FLUSH_AT, SALT_AT = 1 << 18, 64
#: Members of a group and size band that one row of the last comparison holds, on average.
BLOCK = 2048
#: Bytes of a class's sketch in the last comparison, a power of 2.
SKETCH = 128
#: So many documents at most are picked by a broadcast of their ids (16 bytes each); more by a shuffle.
BROADCAST_ROWS = 500_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_48 = np.uint64((1 << 48) - 1)


def shingles(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(rolling(word_hashes(words), min(n, len(words))))


def identity(shingle_set: np.ndarray) -> int:
    """A 62-bit number that equal sets share."""
    with np.errstate(over="ignore"):
        x = mix(np.array([mix(shingle_set).sum(dtype=np.uint64), mix(shingle_set ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(shingle_set))], np.uint64))
    return int(x[0] ^ (x[1] >> np.uint64(1))) >> 2


def band_of(n: int) -> tuple[int, int, int]:
    """(number, first size, end) of the band of a size."""
    band, low, high = 0, 1, FIRST
    while n >= high:
        band, low, high = band + 1, high, high * BAND
    return band, low, high


def most_different(n: int, other: int, share: int = SHARE) -> int:
    return (100 - share) * (n + other) // (100 + share)


def _band_signatures(shingle_set: np.ndarray, band: int, high: int) -> np.ndarray:
    if band == 0:
        return mix(shingle_set)
    part = mix(shingle_set ^ np.uint64(0xA24BAED4963EE407)) % np.uint64(int(PARTS * high))
    order = np.argsort(part, kind="stable")
    part, x = part[order], mix(shingle_set[order])
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    sums = np.add.reduceat(x, first)
    return mix(sums ^ mix(part[first] + np.uint64(band << 40)))


def signatures(shingle_set: np.ndarray, share: int = SHARE, left_out: float = EARLY) -> list[tuple[int, np.ndarray, int]]:
    """[(0 own or 1 lower band, signatures, how many of them a partner must share)]."""
    n = len(shingle_set)
    band, low, high = band_of(n)
    smallest, largest = -(-share * n // 100), 100 * n // share
    plans = [(0, band, high, most_different(n, min(largest, high - 1), share))]
    if band and smallest < low:
        plans.append((1, band - 1, low, most_different(n, low - 1, share)))
    out = []
    for lower, own_band, end, differ in plans:
        if differ < 1:  # only equal sets
            continue
        x = _band_signatures(shingle_set, own_band, end)
        # A feature that is a part of its own is spoiled by its absence only, and at most n - share * n / 100 are absent.
        need = len(x) - differ if own_band else -(-share * n // 100)
        if need < 1:
            raise ArithmeticError("a set fills too few parts of its band")  # by chance below 1e-15 for any set
        early = int(left_out * (need - 1))
        x = x[np.argsort(x & _48, kind="stable")][: len(x) - early]
        out.append((lower, x, need - early))
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, t, h): h tells rows with one doc_id, or none, apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.cast("binary").alias("t"), F.xxhash64(text).alias("h"))


def classes(texts: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, h, n, e): size and identity of every document's set; e is null for an empty one."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("e", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in parts:
                for key, text, h in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist(), strict=True):
                    x = shingles(text.as_py(), shingle)
                    yield key, h, len(x), identity(x) if len(x) else None

        return releasing(batches(rows(), schema, lambda r: 40))

    return texts.mapInArrow(run, "doc_id bigint, h bigint, n bigint, e bigint")


_PACKED = "k int, sigs binary, refs binary, counts binary, needs binary"


def _packed_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.table({n: pa.array(c, pa.int32() if n == "k" else pa.binary()) for n, c in zip(("k", "sigs", "refs", "counts", "needs"), columns, strict=True)})


def _packed_rows(target: np.ndarray, sigs: np.ndarray, refs: np.ndarray, needs: np.ndarray) -> list[tuple]:
    """One row for each target: signatures in order of refs, refs and needs run by run."""
    out = []
    for k, p in by_key(target):
        r = refs[p]
        p = p[np.argsort(r, kind="stable")]
        r = refs[p]
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        out.append((k, pack(sigs[p], 6), pack(r[first], 8), pack(np.diff(np.concatenate([first, [len(r)]])).astype(np.uint64), 4), pack(needs[p][first], 4)))
    return out


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, refs, needs) of all rows."""
    sigs = np.concatenate([unpack(x.as_py(), 6) for x in table.column("sigs")])
    counts = np.concatenate([unpack(x.as_py(), 4) for x in table.column("counts")]).astype(np.int64)
    refs = np.repeat(np.concatenate([unpack(x.as_py(), 8) for x in table.column("refs")]), counts)
    needs = np.repeat(np.concatenate([unpack(x.as_py(), 4) for x in table.column("needs")]), counts)
    return sigs, refs, needs


def _sent(texts: DataFrame, shingle: int, share: int, buckets: int, left_out: float) -> DataFrame:
    """Signatures of all classes, packed for each bucket."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs, refs, needs, held = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if sigs:
                s = np.concatenate(sigs)
                sizes = [len(x) for x in sigs]
                rows = _packed_rows(((s >> np.uint64(48)) % np.uint64(buckets)).astype(np.int64), s & _48, np.repeat(np.array(refs, np.uint64), sizes), np.repeat(np.array(needs, np.uint64), sizes))
                yield from _packed_table(rows).to_batches(max_chunksize=64)

        for part in parts:
            for text in part.column(0):
                x = shingles(text.as_py(), shingle)
                if len(x) < 3 or (e := identity(x)) in seen:
                    continue
                seen.add(e)
                for lower, own, need in signatures(x, share, left_out):
                    sigs.append(own)
                    refs.append(e << 1 | lower)
                    needs.append(need)
                held += len(x)
                if held >= FLUSH_AT:
                    yield from flush()
                    seen.clear()
                    sigs.clear()
                    refs.clear()
                    needs.clear()
                    held = 0
        yield from flush()
        release_memory()

    return texts.select("t").mapInArrow(run, _PACKED)


def _shared(table: pa.Table, groups: int) -> pa.Table:
    """Signatures of one bucket that two or more sets have, packed for each group of sets; needs still are numbers to share."""
    sigs, refs, needs = _unpacked(table)
    order = np.lexsort((refs, sigs))
    sigs, refs, needs = sigs[order], refs[order], needs[order]
    once = np.concatenate([[True], (sigs[1:] != sigs[:-1]) | (refs[1:] != refs[:-1])])
    sigs, refs, needs = sigs[once], refs[once], needs[once]
    first = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]]))
    size = np.diff(np.concatenate([first, [len(sigs)]]))
    sizes = np.repeat(size, size).astype(np.uint64)
    keep = sizes > 1
    sigs, refs, needs, sizes = sigs[keep], refs[keep], needs[keep], sizes[keep]
    bucket = table.column("k")[0].as_py()
    target = (mix(refs) % np.uint64(groups)).astype(np.int64)
    rows = []
    for k, p in by_key(target):
        rows.append((k, bucket, pack(sigs[p], 6), pack(refs[p], 8), pack(needs[p], 4), pack(sizes[p], 4)))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("g", "k", "sigs", "refs", "needs", "sizes"), columns, (pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)})


def _rarest(table: pa.Table) -> pa.Table:
    """For each set of one group: nothing where it shares too few signatures, else the rarest of which one must agree."""
    cut = lambda name, width: np.concatenate([unpack(x.as_py(), width) for x in table.column(name)])
    sigs, refs, needs, sizes = cut("sigs", 6), cut("refs", 8), cut("needs", 4).astype(np.int64), cut("sizes", 4)
    buckets = np.repeat(np.array(table.column("k").to_pylist(), np.int64), [len(x.as_py()) // 6 for x in table.column("sigs")])
    order = np.lexsort((buckets, sigs, sizes, refs))
    sigs, refs, needs, buckets = sigs[order], refs[order], needs[order], buckets[order]
    first = np.flatnonzero(np.concatenate([[True], refs[1:] != refs[:-1]]))
    n = np.diff(np.concatenate([first, [len(refs)]]))
    rank = np.arange(len(refs)) - np.repeat(first, n)
    keep = rank < np.repeat(n, n) - needs + 1
    rows = _packed_rows(buckets[keep], sigs[keep], refs[keep], needs[keep].astype(np.uint64))
    passed = n >= needs[first]
    # Bucket -1: how many signatures each set shares.
    return _packed_table([*rows, (-1, b"", pack(refs[first][passed], 8), pack(n[passed].astype(np.uint64), 4), b"")])


def _meeting(table: pa.Table) -> pa.Table:
    """The groups of classes of one bucket that share a signature: a hash of all members, and the members in chunks."""
    sigs, refs, _ = _unpacked(table)
    members = refs >> np.uint64(1)
    order = np.lexsort((members, sigs))
    sigs, members = sigs[order], members[order].astype(np.int64)
    once = np.concatenate([[True], (sigs[1:] != sigs[:-1]) | (members[1:] != members[:-1])])[: len(sigs)]
    sigs, members = sigs[once], members[once]
    first = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]])[: len(sigs)])
    held: dict[int, np.ndarray] = {}
    if len(first):
        ends = np.concatenate([first[1:], [len(sigs)]])
        plain, other = mix(members.view(np.uint64)), mix(members.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
        names = mix(np.add.reduceat(plain, first) ^ mix(np.add.reduceat(other, first) + (ends - first).astype(np.uint64))).view(np.int64)
        several = np.flatnonzero(ends - first > 1)
        _, at = np.unique(names[several], return_index=True)
        held = {int(names[k]): members[first[k] : ends[k]] for k in several[at].tolist()}
    rows = [(g, at, own[at : at + CHUNK]) for g, own in held.items() for at in range(0, len(own), CHUNK)]
    return pa.table({"g": pa.array([r[0] for r in rows], pa.int64()), "at": pa.array([r[1] for r in rows], pa.int64()), "members": pa.array([r[2] for r in rows], pa.list_(pa.int64()))})


def _released(f, *args):
    out = f(*args)
    release_memory()
    return out


def _sharing(table: pa.Table) -> pa.Table:
    refs = np.concatenate([unpack(x.as_py(), 8) for x in table.column("refs")] or [np.zeros(0, np.uint64)])
    own = refs % np.uint64(2) == 0
    counts = np.concatenate([unpack(x.as_py(), 4) for x in table.column("counts")] or [np.zeros(0, np.uint64)])
    return pa.table({"e": pa.array((refs[own] >> np.uint64(1)).astype(np.int64)), "shared": pa.array(counts[own].astype(np.int64))})


def candidate_groups(texts: DataFrame, total: int, shingle: int, share: int, folder: str, left_out: float = EARLY) -> tuple[DataFrame, DataFrame]:
    """(g, members): groups of classes that share a signature which must be compared, in chunks; and
    (e, shared): how many of the signatures of its own band each class shares. total: elements of all sets."""
    n = max(1, -(-total // BUCKET))
    sent = _sent(texts, shingle, share, n, left_out)
    shared = sent.groupBy("k").applyInArrow(lambda t: _released(_shared, t, n), "g int, k int, sigs binary, refs binary, needs binary, sizes binary")
    rarest = stored(shared.groupBy("g").applyInArrow(lambda t: _released(_rarest, t), _PACKED), folder)

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield from _sharing(pa.Table.from_batches([part])).to_batches()

    groups = rarest.where("k >= 0").groupBy("k").applyInArrow(lambda t: _released(_meeting, t), "g bigint, at bigint, members array<bigint>")
    return groups.dropDuplicates(["g", "at"]), rarest.where("k < 0").mapInArrow(counted, "e bigint, shared bigint")


def picked(texts: DataFrame, known: DataFrame, classes_wanted: DataFrame, shingle: int, folder: str) -> DataFrame:
    """(e, n, t): size and one whole text of each wanted class (e), as a written table."""
    first = known.where("e IS NOT NULL").join(classes_wanted, "e").groupBy("e", "n").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("none"), "h")).alias("w"))
    least = stored(first.select("e", "n", "w.*"), f"{folder}-ids")
    if least.count() <= BROADCAST_ROWS:
        least = F.broadcast(least)
    schema = pa.schema([("e", pa.int64()), ("n", pa.int64()), ("t", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in parts:
                for e, n, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    t = text.as_py()
                    x = shingles(t, shingle)
                    if len(x) and identity(x) == e:  # not another text with the same hash
                        yield e, n, t

        return releasing(batches(rows(), schema, lambda r: len(r[2]) + 24))

    keyed = texts.withColumns({"i": F.coalesce("doc_id", F.lit(0)), "none": F.col("doc_id").isNull()})
    return stored(keyed.join(least, ["i", "none", "h"]).select("e", "n", "t").mapInArrow(run, "e bigint, n bigint, t binary").dropDuplicates(["e"]), folder)


def verified(chosen: DataFrame, pairs: DataFrame, shingle: int, share: int, folder: str) -> DataFrame:
    """The pairs (hub, x) whose sets are similar enough, as a written table (a, b).

    Each x goes to its hub's rows, the hub to as many salted copies as its members need.
    """
    load = pairs.groupBy("hub").agg(F.count("*").alias("n")).select("hub", F.ceil(F.col("n") / SALT_AT).cast("int").alias("salts"))
    salted = pairs.join(load, "hub").select(F.col("x").alias("e"), "hub", F.pmod(F.xxhash64("x"), F.col("salts")).cast("int").alias("salt"))
    copies = load.select(F.col("hub").alias("e"), "hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    roles = stored(salted.unionByName(copies).groupBy("e").agg(F.collect_list(F.struct("hub", "salt")).alias("roles")), f"{folder}-roles")
    if pairs.count() <= BROADCAST_ROWS:
        roles = F.broadcast(roles)
    kind = "hub bigint, salt int, e bigint, data binary"
    schema = pa.schema([("hub", pa.int64()), ("salt", pa.int32()), ("e", pa.int64()), ("data", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in parts:
                for e, text, own in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist(), strict=True):
                    data = pack(np.sort(shingles(text.as_py(), shingle) & _48), 6)
                    for r in own:
                        yield r["hub"], r["salt"], e, data

        return releasing(batches(rows(), schema, lambda r: len(r[3]) + 32))

    def compare(table: pa.Table) -> pa.Table:
        es, hub = table.column("e").to_pylist(), table.column("hub")[0].as_py()
        out = []
        at = next((k for k, e in enumerate(es) if e == hub), None)
        if at is not None:
            own = unpack(table.column("data")[at].as_py(), 6)
            for k, e in enumerate(es):
                if e != hub:
                    x = unpack(table.column("data")[k].as_py(), 6)
                    both = len(np.intersect1d(own, x, assume_unique=True))
                    if 100 * both >= share * (len(own) + len(x) - both):
                        out.append(e)
        return pa.table({"a": pa.array([hub] * len(out), pa.int64()), "b": pa.array(out, pa.int64())})

    rows = chosen.join(roles, "e").select("e", "t", "roles").mapInArrow(run, kind)
    return stored(rows.groupBy("hub", "salt").applyInArrow(compare, "a bigint, b bigint").distinct(), folder)


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(e, label): the smallest node that each node of the edges (a, b) reaches; every step is a written table."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{folder}/edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("e"), F.least("a", "m").alias("label")), f"{folder}/labels-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("e").alias("b"), "label"), "b").groupBy(F.col("a").alias("e")).agg(F.min("label").alias("m"))
        lower = labels.join(near, "e").select("e", F.col("label").alias("old"), F.least("label", "m").alias("to"))
        jumped = lower.join(labels.select(F.col("e").alias("to"), F.col("label").alias("far")), "to").select("e", "old", F.least("to", "far").alias("label"))
        made = stored(jumped, f"{folder}/labels-{step}")
        labels = made.select("e", "label")
        if not made.where("label <> old").limit(1).count():
            return labels


def _possible(p: str, q: str, share: int) -> Column:
    """Whether the sizes of two classes, and for sets of single features how many of these others have, allow a link."""
    small, large = F.least(f"{p}.n", f"{q}.n"), F.greatest(f"{p}.n", f"{q}.n")
    common = F.least(f"{p}.shared", f"{q}.shared")
    return (100 * small >= share * large) & ((large >= FIRST) | ((100 + share) * common >= share * (small + large)))


def _size_band(n: Column, share: int) -> Column:
    """Sets of sizes whose bands differ by more than 1 can't be similar enough."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / share)) + 1e-9).cast("int")


def _mixed(members: DataFrame, labels: DataFrame, share: int, folder: str) -> DataFrame:
    """(g, most, total, band, block, m [(e, label, n, shared)]): groups that still hold different components, by size band in
    blocks of bounded rows; most is the commonest label, total the group's size."""
    placed = members.join(labels, "e", "left").withColumn("label", F.coalesce("label", "e"))
    tops = placed.groupBy("g", "label").count().groupBy("g").agg(F.max_by("label", F.struct("count", -F.col("label"))).alias("most"), F.count("*").alias("k"), F.sum("count").alias("total"))
    held = placed.join(tops.where("k > 1").select("g", "most", "total"), "g").withColumn("band", _size_band(F.col("n"), share))
    blocks = held.groupBy("g", "band").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = held.join(blocks, ["g", "band"]).withColumn("block", F.pmod(F.xxhash64("e"), F.col("blocks")).cast("int"))
    rows = dealt.groupBy("g", "most", "total", "band", "block").agg(F.sort_array(F.collect_list(F.struct("e", "label", "n", "shared"))).alias("m"))
    return stored(rows, folder)


def _pairs(rows: DataFrame, share: int) -> DataFrame:
    """(hub, x) of rows (p, q) in different components that can be links."""
    return rows.where(F.col("p.label") != F.col("q.label")).where(_possible("p", "q", share)).select(F.least("p.e", "q.e").alias("hub"), F.greatest("p.e", "q.e").alias("x")).distinct()


def _near(mixed: DataFrame, width: int, share: int) -> DataFrame:
    """Classes outside their group's commonest component with the next `width` ones of their block of the largest such group."""
    outside = mixed.select("g", "most", "total", "band", "block", "m", F.posexplode("m").alias("at", "p")).where("p.label <> most")
    chosen = outside.groupBy("p.e").agg(F.max_by(F.struct("g", "band", "block", "at"), F.struct("total", "g")).alias("c")).select("c.*")
    partner = F.transform(F.sequence(F.lit(1), F.least(F.lit(width), F.size("m") - 1)), lambda k: F.get("m", (F.col("at") + k) % F.size("m")))
    several = chosen.join(mixed.where(F.size("m") > 1), ["g", "band", "block"])
    return _pairs(several.select(F.get("m", F.col("at")).alias("p"), F.explode(partner).alias("q")), share)


def sketch(shingle_set: np.ndarray) -> bytes:
    """Parities of hashed elements: two sets differ in at least as many elements as their sketches differ in bits."""
    bits = max(8 * SKETCH, 4 * band_of(len(shingle_set))[2])
    place = (mix(shingle_set ^ np.uint64(0x3C79AC492BA7B653)) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(data: bytes, size: int) -> np.ndarray:
    """A sketch in fewer bytes: the parities of the same elements over fewer places."""
    x = np.frombuffer(data, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def sketches(chosen: DataFrame, shingle: int) -> DataFrame:
    """(e, sketch) of every chosen class, folded to SKETCH bytes; that tells sets of up to about 13 * SKETCH elements apart, larger ones pass."""
    schema = pa.schema([("e", pa.int64()), ("sketch", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in parts:
                for e, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    yield e, folded(sketch(shingles(text.as_py(), shingle)), SKETCH).tobytes()

        return releasing(batches(rows(), schema, lambda r: len(r[1]) + 16))

    return chosen.select("e", "t").mapInArrow(run, "e bigint, sketch binary")


def _across(mixed: DataFrame, drawn: DataFrame, share: int, folder: str) -> DataFrame:
    """All pairs (hub, x) of classes of different components of one group that sizes, shares and sketches allow.

    Blocks of members outside the commonest component meet the group's blocks of the same and the next size bands, each pair
    of blocks in one row and its matrix of sketches inside one task, so only pairs that may be links leave it.
    """
    lone = mixed.select("g", "most", "band", "block", F.explode("m").alias("p")).select("g", "most", "band", "block", "p.*").join(drawn, "e")
    full = stored(lone.groupBy("g", "most", "band", "block").agg(F.collect_list(F.struct("e", "label", "n", "shared", "sketch")).alias("m")), folder)
    outside = full.select("g", "band", F.col("block").alias("own"), F.filter("m", lambda x: x["label"] != F.col("most")).alias("o")).where(F.size("o") > 0)
    near = outside.select("g", "own", "o", F.col("band").alias("own_band"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    rows = near.join(full.select("g", "band", "block", "m"), ["g", "band"])
    schema = pa.schema([("hub", pa.int64()), ("x", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in range(part.num_rows):
                m, o = part.column("m")[row].values, part.column("o")[row].values
                bits, own = (np.frombuffer(b"".join(c.field("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH) for c in (m, o))
                bits, own = bits.view(np.uint64), own.view(np.uint64)
                me, ml, mn, ms = (m.field(c).to_numpy(zero_copy_only=False) for c in ("e", "label", "n", "shared"))
                oe, ol, on, os_ = (o.field(c).to_numpy(zero_copy_only=False) for c in ("e", "label", "n", "shared"))
                found = []
                for k in range(len(oe)):
                    n, e = int(on[k]), int(oe[k])
                    total = mn + n
                    ok = (ml != ol[k]) & (100 * np.minimum(mn, n) >= share * np.maximum(mn, n))
                    ok &= (np.maximum(mn, n) >= FIRST) | ((100 + share) * np.minimum(ms, os_[k]) >= share * total)
                    at = np.flatnonzero(ok)
                    differ = np.bitwise_count(bits[at] ^ own[k]).sum(axis=1, dtype=np.int64)
                    found += [(min(e, x), max(e, x)) for x in me[at[(100 + share) * differ <= (100 - share) * total[at]]].tolist()]
                if found:
                    found = sorted(set(found))
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], schema=schema)
        release_memory()

    pairs = rows.select("o", "m", F.xxhash64("g", "own_band", "own", "band", "block").alias("_k")).repartition(shuffle_partitions(mixed.sparkSession), "_k").select("o", "m")
    return pairs.mapInArrow(run, "hub bigint, x bigint").distinct()


def _placed(texts: DataFrame, shingle: int, share: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, n, e) of every document, and (e, label): the component of every class that has links."""
    folder = shared_dir(texts.sparkSession)
    known = stored(classes(texts, shingle), f"{folder}/classes")
    # Signatures left out early let some sets pass that share too few; among those that passed nothing is left out.
    groups, _ = candidate_groups(texts, known.agg(F.sum("n")).first()[0] or 0, shingle, share, f"{folder}/rarest-1")
    passed = stored(groups.select(F.explode("members").alias("e")).distinct(), f"{folder}/passed")
    chosen = picked(texts, known, passed, shingle, f"{folder}/picked")
    groups, sharing = candidate_groups(chosen, 2 * (chosen.agg(F.sum("n")).first()[0] or 0), shingle, share, f"{folder}/rarest-2", 0.0)
    # A class that meets others by the signatures of the band below only shares none of its own band's; it has FIRST elements or more, so none are asked of it.
    facts = chosen.select("e", "n").join(sharing, "e", "left").groupBy("e").agg(F.first("n").alias("n"), F.coalesce(F.max("shared"), F.lit(0)).alias("shared"))
    members = stored(groups.select("g", F.explode("members").alias("e")).join(facts, "e").select("g", "e", "n", "shared"), f"{folder}/members")
    # The hub of a group is its class that meets in most groups: a text that the others are copies of.
    fame = members.groupBy("e").agg(F.count("*").alias("fame"))
    hubs = members.join(fame, "e").groupBy("g").agg(F.max_by("e", F.struct("fame", -F.col("e"))).alias("hub"))
    stars = members.join(hubs, "g").where("e <> hub").groupBy("hub", F.col("e").alias("x")).count()
    pairs = stars.groupBy("x").agg(F.max_by("hub", F.struct("count", -F.col("hub"))).alias("hub")).select(F.least("hub", "x").alias("a"), F.greatest("hub", "x").alias("b"), "hub", "x")
    tested = stored(pairs, f"{folder}/tested-0")
    links = verified(chosen, tested.select("hub", "x"), shingle, share, f"{folder}/links-0")
    labels = components(links, f"{folder}/components-0")
    # Where a group still holds different components: some pairs first, which join most of them, then every pair across those that are left.
    for step, width in enumerate((8, 64, None), 1):
        mixed = _mixed(members, labels, share, f"{folder}/mixed-{step}")
        rest = (_near(mixed, width, share) if width else _across(mixed, sketches(chosen, shingle), share, f"{folder}/blocks")).join(tested.select(F.col("a").alias("hub"), F.col("b").alias("x")), ["hub", "x"], "left_anti")
        rest = stored(rest, f"{folder}/rest-{step}")
        if rest.isEmpty():
            continue
        made = verified(chosen, rest, shingle, share, f"{folder}/links-{step}")
        tested = tested.select("a", "b").unionByName(rest.select(F.col("hub").alias("a"), F.col("x").alias("b")))
        links = links.unionByName(made)
        labels = components(links, f"{folder}/components-{step}")
    return known, labels


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    small_batches(docs.sparkSession)
    known, labels = _placed(_texts(docs, id_col, text_col), shingle, share)
    real = known.where("e IS NOT NULL")
    placed = real.groupBy("e").agg(F.min("doc_id").alias("least")).join(labels, "e", "left").select("e", "least", F.coalesce("label", "e").alias("label"))
    lowest = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    named = placed.select("e", "label").join(lowest, "label").select("e", "component_id")
    full = real.join(named, "e").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(known.where("e IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, that of the smallest doc_id; of rows with that doc_id all stay.

    In a component where no row has a doc_id, the text with the smallest hash stays, once. Rows without words all stay.
    """
    small_batches(docs.sparkSession)
    known, labels = _placed(_texts(docs, "doc_id", "text"), SHINGLE, SHARE)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("i"), "h"))
    least = known.where("e IS NOT NULL").groupBy("e").agg(first.alias("w")).join(labels, "e", "left").groupBy(F.coalesce("label", "e").alias("label")).agg(F.min("w").alias("w"))
    by_id = least.where("NOT w.none").select(F.col("w.i").alias("doc_id")).unionByName(known.where("e IS NULL").select("doc_id")).where("doc_id IS NOT NULL").distinct()
    by_text = least.where("w.none").select(F.col("w.h").alias("_h")).distinct()
    kept = docs.join(by_id, "doc_id", "left_semi").select([docs[c] for c in docs.columns])
    text = F.coalesce("text", F.lit(""))
    nameless = docs.where(F.col("doc_id").isNull())
    worded = nameless.join(by_text, F.xxhash64(text) == F.col("_h"), "left_semi").dropDuplicates(["text"])
    return kept.unionByName(worded).unionByName(nameless.where(F.translate(text, " \t\n\v\f\r", "") == ""))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT k.a, k.b FROM k JOIN n x ON k.a = x.doc_id JOIN n y ON k.b = y.doc_id WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""

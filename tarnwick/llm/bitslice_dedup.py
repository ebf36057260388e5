"""Near-duplicate records, by bit-sliced comparison of sketches within prefix blocks."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.arrow import bounded
from tarnwick.session import cut_lineage, shuffle_partitions

WORD = re.compile(r"[^\W_]+")
#: Bits of a sketch, of which each word of 64 is one stored column.
BITS = 256
WORDS = BITS // 64
#: Cells of the table of shingle counts, of fixed size; it only orders shingles, so collisions cost time, not rows.
CELLS = 1 << 18
#: Rows of a block that are compared with each other at once; larger blocks are tiled.
TILE = 4096
SKETCH = tuple(f"s{w}" for w in range(WORDS))
_ODD = np.uint64(0x9E3779B97F4A7C15)

_words: dict[str, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hash(word: str) -> int:
    h = _words.get(word)
    if h is None:
        if len(_words) > 300_000:
            _words.clear()
        raw = word.encode()
        h = _words[word] = zlib.crc32(raw) << 32 | zlib.crc32(raw[::-1] + b"\x01")
    return h


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct runs of `width` consecutive words of every text, sorted; and their number."""
    flat: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            found = list(map(_word_hash, WORD.findall(text.lower())))
            sizes[i] = len(found)
            flat += found
    words = _mix(np.array(flat, np.uint64) if flat else np.zeros(0, np.uint64))
    with np.errstate(over="ignore"):
        runs = np.zeros(len(words), np.uint64)
        for k in range(width):
            shifted = np.zeros_like(words)
            shifted[: len(words) - k] = words[k:]
            runs = (runs ^ shifted) * _ODD
            runs ^= runs >> np.uint64(29)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = np.arange(len(words)) + width <= ends[owner] if len(words) else np.zeros(0, bool)
    owner, runs = owner[inside], runs[inside].view(np.int64)
    order = np.lexsort((runs, owner))
    owner, runs = owner[order], runs[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (runs[1:] != runs[:-1])]) if len(runs) else np.zeros(0, bool)
    owner, runs = owner[new], runs[new]
    return runs, np.bincount(owner, minlength=len(texts)).astype(np.int64)


def sketches(runs: np.ndarray, counts: np.ndarray, most: int = 1 << 15) -> np.ndarray:
    """(rows, WORDS) uint64: bit b is one bit of the least of the b-th permutation's hashes of the set.

    Of two sets with Jaccard similarity s each bit differs with probability (1 - s) / 2. Sets are taken together until
    they have about `most` shingles, so that the work arrays stay in a processor's cache.
    """
    out = np.zeros((len(counts), WORDS), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    base = (_mix(runs.view(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(11)
    factors = rng.integers(0, 2**31, BITS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = rng.integers(0, 2**32, BITS, dtype=np.uint32)
    sizes = counts[some]
    ends = np.cumsum(sizes)
    least = np.zeros((BITS, len(some)), np.uint32)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(some):
            before = int(ends[at] - sizes[at])
            stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            part = base[before : ends[stop - 1]]
            starts = ends[at:stop] - sizes[at:stop] - before
            h, turned = np.empty_like(part), np.empty_like(part)
            for b in range(BITS):
                np.multiply(part, factors[b], out=h)
                np.add(h, shifts[b], out=h)
                np.right_shift(h, np.uint32(16), out=turned)
                np.bitwise_xor(h, turned, out=h)
                np.multiply(h, np.uint32(0x45D9F3B), out=h)
                least[b, at:stop] = np.minimum.reduceat(h, starts)
            at = stop
    bits = (_mix(least.astype(np.uint64) + np.uint64(1)) & np.uint64(1)).astype(np.uint8)
    out[some] = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)
    return out


def planes(sketch: np.ndarray) -> np.ndarray:
    """Vertical form: word [b, j] holds bit b of the rows 64 j to 64 j + 63, one row a lane."""
    rows = len(sketch)
    blocks = -(-rows // 64)
    bits = np.unpackbits(np.ascontiguousarray(sketch).view(np.uint8), axis=1, bitorder="little")
    padded = np.zeros((blocks * 64, BITS), np.uint8)
    padded[:rows] = bits
    lanes = np.ascontiguousarray(padded.reshape(blocks, 64, BITS).transpose(2, 0, 1))
    return np.packbits(lanes.reshape(-1), bitorder="little").view(np.uint64).reshape(BITS, blocks)


def within(sketch: np.ndarray, vertical: np.ndarray, query: np.ndarray, block: np.ndarray, valid: np.ndarray, radii: list[int]) -> np.ndarray:
    """For each pair of a query row and a block of 64 rows, the `valid` lanes at a Hamming distance of at most the radius.

    Distances of all lanes are kept in bit-sliced counters: seven differing bits at a time go through carry-save
    adders into three words, which are added to the counters. After each 64 bits a lane must be within the radius for as many
    bits (`radii`), and blocks in which every valid lane is beyond it are given up.
    """
    digits = BITS.bit_length()
    result = np.zeros(len(query), np.uint64)
    live = np.arange(len(query))
    counters = np.zeros((digits, len(query)), np.uint64)
    ones = ~np.uint64(0)
    for w in range(WORDS):
        own = sketch[query[live], w]
        at = block[live]

        def differ(b: int) -> np.ndarray:
            return vertical[w * 64 + b][at] ^ (((own >> np.uint64(b)) & np.uint64(1)) * ones)

        for b in range(0, 63, 7):
            a, c, d, e, f, g, h = (differ(b + k) for k in range(7))
            s1, c1 = _csa(a, c, d)
            s2, c2 = _csa(e, f, g)
            s3, c3 = _csa(s1, s2, h)
            twos, fours = _csa(c1, c2, c3)
            _add(counters, 0, s3)
            _add(counters, 1, twos)
            _add(counters, 2, fours)
        _add(counters, 0, differ(63))
        valid = valid & _at_most(counters, radii[w])
        if w == WORDS - 1:
            result[live] = valid
            break
        keep = valid != 0
        if keep.all():
            continue
        live, counters, valid = live[keep], counters[:, keep], valid[keep]
        if not len(live):
            break
    return result


def _lanes(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Words with the bits from `low` on and below `high`, both within 0 and 64."""
    below = lambda n: np.where(n >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(n, 63).astype(np.uint64)) - np.uint64(1))
    return below(high) & ~below(low)


def _csa(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def _add(counters: np.ndarray, digit: int, value: np.ndarray) -> None:
    for d in range(digit, len(counters)):
        carry = counters[d] & value
        counters[d] ^= value
        value = carry
        if not value.any():
            return


def _at_most(counters: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is at most `radius`, compared digit by digit from the highest."""
    less = np.zeros(counters.shape[1], np.uint64)
    equal = ~np.zeros(counters.shape[1], np.uint64)
    for d in range(len(counters) - 1, -1, -1):
        if radius >> d & 1:
            less |= equal & ~counters[d]
            equal &= counters[d]
        else:
            equal &= ~counters[d]
    return less | equal


def partners(group: np.ndarray, n: np.ndarray, place: np.ndarray, similarity: float) -> np.ndarray:
    """For rows sorted by (group, n): one past the last row that may be linked to each as the larger set.

    Of a pair's first shared shingle, each set has n - place - 1 shingles after it, so the sets share at most one more
    than the smaller of these numbers. The larger set may thus have at most (n - place) (1 + s) / s - n shingles, and no
    more than n / s. A pair that is linked passes at its first shared shingle, if not at later ones.
    """
    most = np.floor((n - place) * (1 + similarity) / similarity - n + 1e-9)
    most = np.minimum(most, np.floor(n / similarity + 1e-9)).astype(np.int64)
    wide = int(n.max(initial=0)) + 2
    order = group.astype(np.int64) * wide
    return np.searchsorted(order + n, order + np.minimum(most, wide - 1), "right")


def near_pairs(group: np.ndarray, n: np.ndarray, place: np.ndarray, side: np.ndarray, sketch: np.ndarray, radii: list[int], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows i < j of one group whose sketches are within the radius, sizes and places permitting.

    Rows are sorted by (group, n), groups are numbered from 0. Where `side` differs within a group, only rows of unlike sides
    are compared.
    """
    rows = len(group)
    none = np.zeros(0, np.int64)
    if rows < 2:
        return none, none
    end = partners(group, n, place, similarity)  # one past
    vertical = planes(sketch)
    # Equal sets of shingles have equal n, so the smaller set of a pair is the earlier row, or the rows have one size.
    busy = np.flatnonzero(end > np.arange(rows) + 1)
    first_block = (busy + 1) // 64
    spans = (end[busy] - 1) // 64 - first_block + 1
    two = _two_sided(group, side)
    out_i, out_j = [], []
    step = 32_768
    edges = np.concatenate([[0], np.cumsum(spans)])
    at = 0
    while at < len(busy):
        stop = max(at + 1, int(np.searchsorted(edges, edges[at] + step, "right")) - 1)
        some, count = busy[at:stop], spans[at:stop]
        query = np.repeat(some, count)
        block = np.repeat(first_block[at:stop], count) + np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
        lanes = within(sketch, vertical, query, block, _lanes(np.maximum(query + 1 - block * 64, 0), np.clip(end[query] - block * 64, 0, 64)), radii)
        hit = np.flatnonzero(lanes)
        if len(hit):
            bits = np.unpackbits(lanes[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, lane = np.nonzero(bits)
            i, j = query[hit[k]], block[hit[k]] * 64 + lane
            # The larger set's place counts as well.
            shared = np.minimum(n[i] - place[i], n[j] - place[j])
            good = shared >= (n[i] + n[j]) * (similarity / (1 + similarity)) - 1e-6
            good &= (side[i] != side[j]) | ~two[i]
            out_i.append(i[good])
            out_j.append(j[good])
        at = stop
    if not out_i:
        return none, none
    return np.concatenate(out_i), np.concatenate(out_j)


def _two_sided(group: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Whether a row's group has rows of both sides."""
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([start, [len(group)]]))
    low, high = np.minimum.reduceat(side, start), np.maximum.reduceat(side, start)
    return np.repeat(low != high, sizes)


def radius_for(similarity: float, bits: int = BITS, deviations: float = 4.7) -> int:
    """Distance over so many bits that a pair at the similarity exceeds with a probability of about 1 in a million."""
    p = (1 - similarity) / 2
    return min(bits, int(np.ceil(bits * p + deviations * (bits * p * (1 - p)) ** 0.5)))


def _sets(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, id, other, n, s0..., shingles): the shingles of every row, two hashes of the whole set, and its sketch."""
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    names = ["key", "id", "other", "n", *SKETCH, "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 4_000_000):
            runs, counts = shingle_sets(batch.column("text").to_pylist(), width)
            edges = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(edges), pa.array(runs))
            ids = [pa.array(_set_hash(runs, counts, salt)) for salt in (1, 2)]
            sketch = sketches(runs, counts).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), *ids, pa.array(counts.astype(np.int32)), *(pa.array(sketch[:, w]) for w in range(WORDS)), sets], names)

    return rows.mapInArrow(run, f"key {kind}, id long, other long, n int, {', '.join(f'{s} long' for s in SKETCH)}, shingles array<long>")


def _set_hash(runs: np.ndarray, counts: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each set; the sum over its mixed shingles does not depend on their order."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        with np.errstate(over="ignore"):
            mixed = _mix(_mix(runs.view(np.uint64) + np.uint64(salt)) * _ODD + np.uint64(salt))
            out[some] = _mix(np.add.reduceat(mixed, (np.cumsum(counts) - counts)[some]) + counts[some].astype(np.uint64))
    return out.view(np.int64)


def _cells(sets: DataFrame) -> np.ndarray:
    """How often shingles fall into each of CELLS cells; a driver-side array of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            flat = batch.column("shingles").flatten().to_numpy(zero_copy_only=False)
            counts += np.bincount(flat & (CELLS - 1), minlength=CELLS)
        slices = counts.reshape(64, -1)
        some = [i for i in range(64) if slices[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([slices[i].tolist() for i in some], pa.list_(pa.int64()))], ["slice", "counts"])

    wide = CELLS // 64
    local = sets.select("shingles").coalesce(shuffle_partitions(sets.sparkSession)).mapInArrow(run, "slice int, counts array<long>")
    cells = local.select("slice", F.posexplode("counts").alias("at", "n")).filter("n > 0").groupBy("slice", "at").agg(F.sum("n").alias("n"))
    out = np.zeros(CELLS, np.int64)
    for batch in cells.select((F.col("slice") * wide + F.col("at")).alias("cell"), "n").toArrow().to_batches():  # at most CELLS rows
        out[batch.column("cell").to_numpy()] = batch.column("n").to_numpy()
    return out


def near_duplicates(df: DataFrame, key: str, text: str, similarity: float = 0.8, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """(links, members): links between classes of equal shingle sets, and the class of every record.

    A record's set holds its runs of `width` consecutive words (runs of letters or digits, lower-cased). Two records
    are linked if the intersection of their sets is at least `similarity` of the union. Links are (class_a, class_b, similarity),
    class_a < class_b, one for each pair of unlike sets; members are (key, class, copies), where a class is named by its
    smallest key and members of one class are linked to each other. A record without a full run has no links and its class is null.

    Blocks are exact: of each set only the rarest shingles that a similar set cannot all miss are block keys. Within
    a block 256-bit sketches are compared bit-sliced, where the sizes of two sets and the places of the shared shingle allow a
    link; what is within radii that a linked pair exceeds in about 5 of a million cases is settled by the exact sets. Blocks
    above TILE rows become tiles, each pair of tiles a unit of its own; nothing that grows with the records is broadcast.
    Of repeated keys with unlike texts the one whose set has the greater hash counts; null keys are left out, null texts have no
    runs. Ties do not occur; other columns are ignored; empty tables give empty results. Whole texts are read.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be in (0, 1]")
    spark = df.sparkSession
    sets = cut_lineage(_sets(df, key, text, width))
    # One row for each key, without its set; classes of equal sets by 128 bits of hash.
    one = F.max(F.struct("id", "other", "n")).alias("r")
    named = cut_lineage(sets.groupBy("key").agg(one).select("key", "r.*"))
    heads = named.filter("n > 0").groupBy("id", "other").agg(F.min("key").alias("class"), F.count(F.lit(1)).alias("copies"))
    heads = cut_lineage(heads)
    members = named.join(heads.hint("merge"), ["id", "other"], "left").select(F.col("key").alias(key), "class", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))

    table = _cells(sets)
    cells = spark.sparkContext.broadcast(table)  # CELLS numbers
    radii, at_least = [radius_for(similarity, 64 * (w + 1)) for w in range(WORDS)], similarity
    # Only a shingle in a cell with more than `full` entries can have a block above TILE rows, or above the cells' usual load.
    full = max(TILE, 4 * int(table.mean()))

    def block_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "shingles", 500_000):
            ids = batch.column("id").to_numpy()
            first = np.unique(ids, return_index=True)[1]  # copies of one set are one row
            batch = batch.take(pa.array(np.sort(first)))
            lists = batch.column("shingles")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            counts = batch.column("n").to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(counts)), counts)
            load = cells.value[flat & (CELLS - 1)]
            order = np.lexsort((flat, load, owner))
            need = counts - np.ceil(at_least * counts - 1e-9).astype(np.int64) + 1
            place = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
            early = place < need[owner]
            rare, who = order[early], owner[early]
            at = pa.array(who)
            size = (counts[who] << 32) | place[early]
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[rare]), pa.array(load[rare] > full), batch.column("id").take(at), pa.array(size), *(batch.column(s).take(at) for s in SKETCH)], ["block", "maybe", "id", "size", *SKETCH]
            )

    stored = ", ".join(f"{s} long" for s in SKETCH)
    keyed = sets.select("id", "n", *SKETCH, "shingles").filter("n > 0").mapInArrow(block_keys, f"block long, maybe boolean, id long, size long, {stored}")
    row = ["id", "size", *SKETCH]
    plain = keyed.filter("NOT maybe").select(F.col("block").alias("unit"), F.lit(0).alias("side"), *row)
    crowded = keyed.filter("maybe")
    sizes = crowded.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    placed = crowded.join(sizes.hint("merge"), "block")
    own = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    split = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    unit = F.when(F.col("tiles") == 1, F.col("block")).otherwise(F.xxhash64("block", F.least("own", "other"), F.greatest("own", "other")))
    split = split.select(unit.alias("unit"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), *row)
    # Rows of one unit follow each other; no unit is larger than two tiles, or than the cells' usual load.
    ordered = plain.unionByName(split).repartition(shuffle_partitions(spark), "unit").sortWithinPartitions("unit")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(table: pa.Table) -> pa.RecordBatch:
            unit, side, ids, size = (table.column(c).to_numpy() for c in ("unit", "side", "id", "size"))
            n, place = size >> 32, size & 0xFFFFFFFF
            order = np.lexsort((place, ids, n, unit))
            unit, side, ids, n, place = unit[order], side[order], ids[order], n[order], place[order]
            group = np.cumsum(np.concatenate([[0], unit[1:] != unit[:-1]]))
            fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (ids[1:] != ids[:-1]) | (side[1:] != side[:-1])])  # a set once in a unit
            alone = np.bincount(group[fresh])[group] < 2
            keep = np.flatnonzero(fresh & ~alone)
            if not len(keep):
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["x", "y"])
            group, side, ids, n, place = np.unique(group[keep], return_inverse=True)[1], side[keep], ids[keep], n[keep], place[keep]
            sketch = np.stack([table.column(s).to_numpy().view(np.uint64)[order[keep]] for s in SKETCH], axis=1)
            i, j = near_pairs(group, n, place, side, sketch, radii, at_least)
            x, y = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            pairs = np.unique(np.stack([x, y])[:, x < y], axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["x", "y"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < 100_000:
                continue
            table = pa.Table.from_batches(held)
            unit = table.column("unit").to_numpy()
            cut = int(np.searchsorted(unit, unit[-1]))  # the last unit may go on
            if cut:
                yield flush(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                rows = table.num_rows - cut
        if rows:
            yield flush(pa.Table.from_batches(held))

    pairs = cut_lineage(ordered.mapInArrow(compare, "x long, y long").distinct())
    # Sets are joined by merging, whatever their estimated size: once shuffled by id, only those of pairs go on.
    asked = pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id"))).distinct()
    known = sets.select("id", "other", "shingles").join(asked.hint("merge"), "id", "left_semi").dropDuplicates(["id", "other"])
    known = known.join(heads.select("id", "other", "class").hint("merge"), ["id", "other"])
    left = known.select(F.col("class").alias("a"), F.col("id").alias("x"), F.col("shingles").alias("sa"))
    right = known.select(F.col("class").alias("b"), F.col("id").alias("y"), F.col("shingles").alias("sb"))
    both = pairs.join(left.hint("merge"), "x").join(right.hint("merge"), "y")
    shared = F.size(F.array_intersect("sa", "sb"))
    exact = both.select(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b"), (shared / (F.size("sa") + F.size("sb") - shared)).alias("similarity"))
    return exact.filter(F.col("similarity") >= at_least - 1e-12), members


def record_pairs(links: DataFrame, members: DataFrame, key: str, star: int = 1000) -> DataFrame:
    """(key_a, key_b), smaller first: the linked pairs of records.

    Of a class of up to `star` copies every pair is listed; of a larger one each copy with the class's
    smallest key, for which alone links to other classes are listed: with the members this says the same.
    """
    named = members.filter("class IS NOT NULL").select(F.col(key).alias("key"), "class", "copies")
    shown = named.filter((F.col("copies") <= star) | (F.col("key") == F.col("class")))
    a = shown.select(F.col("class").alias("class_a"), F.col("key").alias("ka"))
    b = shown.select(F.col("class").alias("class_b"), F.col("key").alias("kb"))
    across = links.join(a.hint("merge"), "class_a").join(b.hint("merge"), "class_b").select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))
    small = named.filter((F.col("copies") > 1) & (F.col("copies") <= star))
    same = small.alias("l").hint("merge").join(small.alias("r"), (F.col("l.class") == F.col("r.class")) & (F.col("l.key") < F.col("r.key")))
    same = same.select(F.col("l.key").alias("key_a"), F.col("r.key").alias("key_b"))
    large = named.filter((F.col("copies") > star) & (F.col("key") != F.col("class"))).select(F.col("class").alias("key_a"), F.col("key").alias("key_b"))
    return across.unionByName(same).unionByName(large)

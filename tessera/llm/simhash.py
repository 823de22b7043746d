"""SimHash near-duplicates: fingerprints, pigeonhole block join, Hamming check, components.

Fingerprints of 64 bits are cut into ``max_bits + 2`` blocks. Two that differ in at most
``max_bits`` bits agree in at least two blocks, so each pair of blocks makes a join key and every
close pair meets under one of them. Only distinct fingerprints are joined, and a key that a single
fingerprint has is dropped before the join.

A key shared by more than ``bucket_cap`` distinct fingerprints isn't joined pairwise. Its members
go another way, as exact: each is entered under itself and under itself with one of its remaining
bits flipped, and two fingerprints at distance 1 or 2 share such an entry. An entry has at most
65 members, and sharing an entry means a distance of at most 2, so no links are lost or added.
(This second way is for ``max_bits`` = 2, and each flip stands for one bit of either side.)

:func:`near_dedup` links texts of similarity 0.8 (Jaccard, five-word shingles), at which a 64-bit
fingerprint differs in about ten bits, too many for blocks of it to select. Its fingerprints are
therefore as long as the text asks for: a text's shingles are dealt by hash into parts, and each
part's SimHash is a block. There are more parts than shingles in which two such texts can differ (or,
for long texts, enough), so close pairs share a block; they are joined on blocks, their 64-bit
SimHashes held against a Hamming distance, and what is left compared as sets.

Defined cases: null text is empty; texts without words get fingerprint zero and link like others;
repeated rows and exact copies share a fingerprint and so a component; null ids are left out of
the choice of the smallest id. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, lookup, materialise, maybe_in, scope
from .pairwise import blocks, compared
from .textnum import LOWER, Prefix, bytes_of, give_back, mix, slices, word_hashes, words

SURE = 12
_TABLE = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, size: int = 3) -> int:
    """64-bit SimHash of word shingles; a bit is 1 if set in over half of the shingles' XXH64."""
    w = (text or "").encode("utf-8", "replace").translate(_TABLE).split()
    if not w:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    grams = [join(w)] if len(w) < size else map(join, zip(*(w[i:] for i in range(size)), strict=False))
    h = np.fromiter((digest(g, 42) for g in grams), dtype=np.uint64)
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, size: int = 3) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t")).mapInArrow(run, f"id {kind}, fp bigint")


def _masks(max_bits: int) -> list[int]:
    """For each pair of blocks, the mask of the bits they hold."""
    n = max_bits + 2
    cut = [64 * i // n for i in range(n + 1)]
    block = [((1 << (cut[i + 1] - cut[i])) - 1) << cut[i] for i in range(n)]
    return [block[a] | block[b] for a, b in combinations(range(n), 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _near(a: Column, b: Column, max_bits: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= max_bits


def links(nodes: DataFrame, max_bits: int = 2, bucket_cap: int = 64) -> DataFrame:
    """Links (u, v) between the ids of distinct fingerprints (fp, id) that suffice for components."""
    masks = _masks(max_bits)
    keyed = nodes.select("fp", "id", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks))).alias("p", "part"))
    keyed = keyed.withColumn("key", F.xxhash64("p", "part"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(lookup(keyed, sizes, "key"), "blocks")
    few = shared.where(F.col("n") <= bucket_cap)
    a, b = few.select("key", F.col("fp").alias("fa"), F.col("id").alias("u")), few.select("key", F.col("fp").alias("fb"), F.col("id").alias("v"))
    pairs = a.join(b, "key").where((F.col("u") < F.col("v")) & _near(F.col("fa"), F.col("fb"), max_bits)).select("u", "v")
    if max_bits != 2:
        raise ValueError("large blocks are resolved for two bits only")
    flips = F.array(F.lit(0).cast("bigint"), *(F.lit(_signed(1 << i)) for i in range(64)))
    many = shared.where(F.col("n") > bucket_cap).select("fp", "id").distinct()
    entries = many.select("id", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("entry"))
    met = entries.withColumn("u", F.min("id").over(Window.partitionBy("entry"))).where("u <> id").select("u", F.col("id").alias("v"))
    return pairs.union(met).distinct()


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2, size: int = 3, bucket_cap: int = 64) -> DataFrame:
    """One row per row of ``df``: id, fp (64 bits as bigint), component_id (smallest id reachable)."""
    fps = materialise(fingerprints(df, id_col, text_col, size), "fingerprints")
    nodes = materialise(fps.groupBy("fp").agg(F.min("id").alias("id")), "nodes")
    comp = components(links(nodes, max_bits, bucket_cap))
    named = nodes.join(comp, nodes["id"] == comp["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return lookup(fps, named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


#: The last class of sizes (up to 2**8 - 1 shingles) whose texts are sure to have equal parts.
SURE_KIND = 8


@lru_cache(maxsize=256)
def part_count(largest: int) -> int:
    """Parts for texts of up to ``largest`` shingles.

    At similarity 0.8 two sets differ in at most (|A| + |B|) / 9 shingles. With twice as many parts and
    one more over half of them are equal for sure, so that the most frequent can be passed over. Long
    texts get fewer parts: as many as leave ``SURE`` equal parts to be expected, so that all differ
    with a probability of about exp(-SURE).
    """
    differ, n = 2 * largest // 9, 1
    if largest <= 1 << SURE_KIND:
        return 2 * differ + 1
    while n <= differ and n * np.exp(-differ / n) < SURE:
        n += max(1, n // 64)
    return int(min(n, differ + 1))


def prints(raw: np.ndarray, off: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a slice of texts: digest of the shingle set, SimHash, offsets of the sorted distinct shingles, those, offsets of keys, keys.

    A key is the SimHash of the shingles of one part of the text's set, with the part's number and
    the class of sizes that fixes the number of parts; its last bit is the class's. Texts within a
    quarter of the next class's sizes have keys of that class too.
    """
    s, e, rows = words(raw, off)
    h = Prefix(word_hashes(LOWER[raw], s, e) | np.uint64(1)) if len(raw) else Prefix(np.zeros(0, np.uint64))
    count = np.diff(rows)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + rows[row]
    sh = h.span(at, np.minimum(at + size, rows[row + 1]))
    order = np.lexsort((sh, row))
    sh, row = sh[order], row[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (row[1:] != row[:-1])
    sh, row = sh[new], row[new]
    bounds = np.searchsorted(row, np.arange(len(n) + 1))
    total = Prefix(sh | np.uint64(1)).span(bounds[:-1], bounds[1:])
    largest = np.diff(bounds)
    kind = np.frexp(np.maximum(largest, 1))[1]  # sizes from 2^(kind - 1) to 2^kind - 1
    both = 5 * largest >= 4 << kind
    texts = np.concatenate([np.arange(len(n)), np.flatnonzero(both)])
    kinds = np.concatenate([kind, kind[both] + 1])
    parts = np.array([part_count(1 << k) for k in range(int(kinds.max(initial=0)) + 1)])[kinds] if len(kinds) else kinds
    m = largest[texts]
    own = np.repeat(np.arange(len(texts)), m)
    of = np.arange(len(own)) - np.repeat(np.cumsum(m) - m, m) + bounds[texts][own]
    part = own * (1 << 40) + (mix(sh[of]) % parts[own].astype(np.uint64)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.ones(len(part), bool)
    first[1:] = part[1:] != part[:-1]
    start = np.flatnonzero(first)
    owner = part[start] >> 40
    keys = mix(_majority(sh[of[order]], start) + mix((part[start] & ((1 << 40) - 1)).astype(np.uint64) * np.uint64(64) + kinds[owner].astype(np.uint64)))
    keys = keys & ~np.uint64(1) | (kinds[owner] & 1).astype(np.uint64)  # a text has keys of two classes in a row at most
    by_text = np.argsort(texts[owner], kind="stable")
    return total, _majority(sh, bounds[:-1]), bounds, sh, np.searchsorted(texts[owner][by_text], np.arange(len(n) + 1)), keys[by_text]


def _majority(h: np.ndarray, start: np.ndarray, most: int = 1 << 16) -> np.ndarray:
    """SimHashes of the runs of hashes that begin at ``start`` (zero for empty ones), in pieces of ``most`` hashes."""
    end = np.append(start[1:], len(h))
    ones = np.zeros((len(start), 64), np.int32)
    full = np.flatnonzero(end > start)
    for a in range(0, len(h), most):
        piece = h[a : a + most]
        i = full[np.searchsorted(end[full], a, "right") : np.searchsorted(start[full], a + len(piece))]
        bits = np.unpackbits(np.ascontiguousarray(piece).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[i] += np.add.reduceat(bits, np.maximum(start[i] - a, 0), axis=0, dtype=np.int32)
    return np.packbits(2 * ones > (end - start)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _rarest(shared: DataFrame) -> DataFrame:
    """Of each text's parts (key, n; all, odd: how many it has) those that a similar text must share one of: sid, fp, m, key.

    A text of m shingles and one like it differ in m / 4 shingles at most, and so in as many parts of
    either. With parts in order of rarity, the first that both have comes after parts that one alone
    has, m / 4 at most: it is among the first m / 4 + 1 of either. Parts that no other text has come
    first of all, and count. Where equal parts aren't sure (long texts) all stay.
    """
    odd = F.col("key").bitwiseAND(F.lit(1))
    kind = F.length(F.bin(F.greatest("m", F.lit(1).cast("bigint"))))
    listed = F.when(odd == 1, F.col("odd")).otherwise(F.col("all") - F.col("odd"))
    own = Window.partitionBy("sid", "_odd")
    r = shared.withColumn("_odd", odd).withColumns({"_place": F.row_number().over(own.orderBy("n", "key")), "_shared": F.count("*").over(own)})
    alone = listed - F.col("_shared")
    sure = F.when(kind % 2 == odd, kind).otherwise(kind + 1) <= SURE_KIND
    return r.where(~sure | (F.col("_place") + alone <= F.floor(F.col("m") / 4) + 1)).select("sid", "fp", "m", "key")


#: Members of a part that meet in one cell, on either side.
CROWD = 512
#: Pairs of members that a task looks at together.
_AT_ONCE = 1 << 20


def _part_links(nodes: DataFrame, max_bits: int, bucket_cap: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (u, v) of nodes (sid, fp, m, keys): each part's least member with its others.

    Up to ``bucket_cap`` members these are pairs of SimHashes within ``max_bits``, in larger parts all.
    The second table has the members (key, n, sid, fp, m) of parts that have more pairs.
    """
    keyed = nodes.select("sid", "fp", "m", F.size("keys").alias("all"), F.size(F.filter("keys", lambda k: k.bitwiseAND(F.lit(1)) == 1)).alias("odd"), F.explode("keys").alias("key"))
    sizes = materialise(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "parts")
    tested = maybe_in(keyed, "key", sizes.select("key")).where("_mb_maybe").drop("_mb_maybe")
    rare = materialise(_rarest(lookup(tested, sizes, "key")), "rarest parts")
    sizes = materialise(rare.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("sid", "fp")).alias("first")).where("n > 1"), "shared")
    shared = materialise(lookup(rare, sizes, "key"), "shared parts")
    close = (F.col("n") > bucket_cap) | _near(F.col("fp"), F.col("first.fp"), max_bits)
    led = shared.where((F.col("sid") != F.col("first.sid")) & close).select(F.col("first.sid").alias("u"), F.col("sid").alias("v"))
    return led.distinct(), shared.where("n > 2").select("key", "n", "sid", "fp", "m")


def _cells(parts: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of parts that hold several classes, in cells: cell, sid, fp, m, class, side and alone.

    A part's members are dealt into groups, and each two groups meet in a cell of bounded size, one
    on either side; a group meets itself in a cell alone.
    """
    c = lookup(parts.withColumn("node", F.col("sid")), classes, "node", "left").withColumn("class", F.coalesce("component", "sid"))
    mixed = c.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("key")
    c = lookup(c.select("key", "n", "sid", "fp", "m", "class"), mixed, "key")
    groups = F.ceil(F.col("n") / CROWD)
    c = c.withColumn("own", F.pmod(F.xxhash64("sid"), groups)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), groups - 1)))
    cell = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return c.select(cell.alias("cell"), "sid", "fp", "m", "class", (F.col("own") < F.col("other")).alias("side"), (F.col("own") == F.col("other")).alias("alone"))


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by cell, the first column, in tables of whole cells."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cell = b.column(0).to_numpy()
        last = int(np.searchsorted(cell, cell[-1]))
        if held and (last or held[-1].column(0)[-1] != b.column(0)[0]):
            yield pa.Table.from_batches([*held, b.slice(0, last)]).combine_chunks()
            held = []
        elif last:
            yield pa.Table.from_batches([b.slice(0, last)])
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _meetings(t: pa.Table, max_bits: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the pairs to compare: of one cell, different classes, fit sizes and close SimHashes."""
    cell, fp, m, own, side, alone = (t.column(c).to_numpy() for c in ("cell", "fp", "m", "class", "side", "alone"))
    fp = fp.view(np.uint64)
    n = np.searchsorted(cell, cell, "right") - np.arange(len(cell)) - 1
    before = np.cumsum(n) - n
    starts = np.unique(np.searchsorted(before, np.arange(0, n.sum() + 1, _AT_ONCE)))
    for a, z in zip(starts, [*starts[1:], len(cell)], strict=True):
        i = np.repeat(np.arange(a, z), n[a:z])
        j = np.arange(len(i)) - np.repeat(before[a:z] - before[a], n[a:z]) + i + 1
        ok = (alone[i] | (side[i] != side[j])) & (own[i] != own[j])
        i, j = i[ok], j[ok]
        ok = (np.minimum(m[i], m[j]) >= similarity * np.maximum(m[i], m[j])) & (np.bitwise_count(fp[i] ^ fp[j]) <= max_bits)
        yield i[ok], j[ok]


def _row_keys(id_: Column, text: Column) -> list[Column]:
    """Two hashes that name a row by its id and text."""
    return [F.xxhash64(id_, F.lit(0), text), F.xxhash64(F.lit(1), text, F.lit(2), id_)]


def _similar(df: DataFrame, id_col: str, text_col: str, size: int, similarity: float, max_bits: int, bucket_cap: int) -> DataFrame:
    """One row per row of ``df``: id, h1, h2 (the row's hashes) and best (id, h1, h2), the least row of its class with an id."""
    if similarity < 0.8:
        raise ValueError("parts are numbered for similarities of 0.8 and more")
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    h1, h2 = _row_keys(F.col("id"), F.col("t"))
    docs = docs.select("id", h1.alias("h1"), h2.alias("h2"), "t")
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "t"):
                total, fp, bounds, _, at, keys = prints(*bytes_of(b.column(3)), size)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(keys.view(np.int64)))
                columns = [*b.columns[:3], pa.array(total.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(np.diff(bounds)), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "h1", "h2", "sid", "fp", "m", "keys"])
            give_back()

    rows = materialise(docs.mapInArrow(run, f"id {kind}, h1 bigint, h2 bigint, sid bigint, fp bigint, m bigint, keys array<bigint>"), "prints")
    named = rows.select("id", "h1", "h2", "sid")
    # of equal sets one row lists its parts, and is read again where the sets are compared
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "h1", "h2")))
    owners = materialise(named.groupBy("sid").agg(F.min("h1").alias("low"), least.alias("best")), "nodes")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "t"):
                total, _, at, sh, _, _ = prints(*bytes_of(b.column(0)), size)
                each = [np.sort(sh[x:y].astype(np.uint32)).tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(total.view(np.int64)), pa.array(np.zeros(len(each), np.int32)), pa.array(np.zeros(len(each), np.int32)), pa.array(each, pa.binary())], names=["tid", "cell", "start", "sh"])
            give_back()

    def alike(a: tuple, others: list[tuple]) -> list[tuple]:
        out = []
        for b in others:
            x, y = (a[3], b[3]) if len(a[3]) < len(b[3]) else (b[3], a[3])
            if len(x) < similarity * len(y):
                continue
            both = int((y[np.minimum(y.searchsorted(x), len(y) - 1)] == x).sum()) if len(y) else 0
            if both >= similarity * (len(x) + len(y) - both):
                out.append((a[0], b[0]))
        return out

    def cells_of(sids: DataFrame) -> DataFrame:
        """The sets of nodes, as cells to compare."""
        lows = materialise(owners.join(sids.distinct(), "sid").select(F.col("low").alias("h1")), "ends")
        some = maybe_in(docs, "h1", lows).where("_mb_maybe").select("t")
        return some.mapInArrow(sets, "tid bigint, cell int, start int, sh binary").dropDuplicates(["tid"])

    def linked(candidates: DataFrame) -> DataFrame:
        """Those of the pairs (u, v) whose sets are similar."""
        pairs = materialise(blocks(candidates.select(F.col("u").alias("a"), F.lit(0).alias("ca"), F.col("v").alias("b"), F.lit(0).alias("cb"))), "pairs")
        return materialise(compared(pairs, cells_of(pairs.select(F.col("a").alias("sid")).union(pairs.select("b"))), alike, "u bigint, v bigint"), "links")

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_cell(batches):
            met = np.zeros(t.num_rows, bool)
            for i, j in _meetings(t, max_bits, similarity):
                met[i] = met[j] = True
            yield from t.filter(pa.array(met)).to_batches()

    def joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_cell(batches):
            sid, own = t.column("sid").to_pylist(), t.column("class").to_pylist()
            held = [(k, None, None, np.frombuffer(sh, np.uint32)) for k, sh in zip(sid, t.column("sh").to_pylist(), strict=True)]
            root: dict[int, int] = {}  # classes that links of these cells make one

            def find(c: int, root: dict[int, int] = root) -> int:
                while c in root:
                    c = root[c]
                return c

            out = []
            for i, j in _meetings(t, max_bits, similarity):
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    p, q = find(own[x]), find(own[y])
                    if p != q and (link := alike(held[x], [held[y]])):
                        out += link
                        root[max(p, q)] = min(p, q)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["u", "v"])

    def crossing(parts: DataFrame, classes: DataFrame) -> DataFrame:
        """Links (u, v) that make one what similar pairs of different classes join; the pairs stay in their tasks."""
        cells = _cells(parts, classes)
        met = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(meeting, cells.schema)
        met = materialise(met, "meetings")
        if met.isEmpty():
            return met.select(F.col("sid").alias("u"), F.col("sid").alias("v"))
        held = cells_of(met.select("sid")).select(F.col("tid").alias("sid"), "sh")
        whole = lookup(met, held, "sid").select("cell", "sid", "fp", "m", "class", "side", "alone", "sh")
        return materialise(whole.repartition("cell").sortWithinPartitions("cell").mapInArrow(joining, "u bigint, v bigint"), "crossing links")

    with scope() as kept:
        own = owners.select(F.col("sid").alias("_sid"), "low")
        nodes = rows.join(own, (F.col("sid") == F.col("_sid")) & (F.col("h1") == F.col("low"))).select("sid", "fp", "m", "keys").dropDuplicates(["sid"])
        candidates, parts = _part_links(materialise(nodes, "parts of nodes"), max_bits, bucket_cap)
        links = linked(candidates)
        classes = materialise(components(links), "classes")
        more = crossing(parts, classes)
        path = classes
        if not more.isEmpty():
            path = materialise(components(links.union(more)), "components")
        kept.append(path)
    whole = owners.join(path, F.col("sid") == F.col("node"), "left").select("sid", F.coalesce("component", "sid").alias("class"), "best")
    best = whole.groupBy("class").agg(F.min("best").alias("best"))
    table = lookup(whole.drop("best"), best, "class").select("sid", "best")
    return lookup(named, table, "sid").select("id", "h1", "h2", "best")


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, max_bits: int = 24, bucket_cap: int = 64) -> DataFrame:
    """One row per row of ``df``: id, component_id (smallest id reachable by links of ``similarity`` or more).

    Similarity is Jaccard's, of the sets of ``size``-word shingles. It must be 0.8 or more, which the
    number of parts stands for. Texts of equal sets are one node. Links come from equal parts; pairs
    whose SimHashes differ in more than ``max_bits`` of 64 bits are left out (about 10 are expected at
    0.8, and 24 are five standard deviations more), the others are compared as whole sets. A part
    first links its nodes to one of them (if more than ``bucket_cap`` share it, at any distance), which
    makes copies one class; then those of different classes are compared within tasks, and only links
    that join classes leave them. Ids may be of any type that has an order; rows that share one are
    rows of their own.
    """
    g = _similar(df, id_col, text_col, size, similarity, max_bits, bucket_cap)
    return g.select(F.col("id").alias(id_col), F.col("best.id").alias("component_id"))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, bucket_cap: int = 64) -> DataFrame:
    """The rows of ``df`` that are the least of their group by id, with all their columns (null ids stay).

    Groups are those of :func:`similar_groups`. Rows go by id and text, told by two 64-bit hashes of
    both, so a row that shares its id with one that goes stays; rows that repeat id and text go or
    stay together. Rows that surely stay don't shuffle; names starting with ``_sh_`` and ``_mb_`` are
    reserved.
    """
    groups = _similar(df, id_col, text_col, size, similarity, 24, bucket_cap)
    other = ~F.struct("id", "h1", "h2").eqNullSafe(F.col("best"))
    gone = materialise(groups.where(F.col("id").isNotNull() & other).select(F.col("h1").alias("_sh_1"), F.col("h2").alias("_sh_2")).distinct(), "dropped")
    h1, h2 = _row_keys(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    tested = maybe_in(df.withColumns({"_sh_1": h1, "_sh_h": h2}), "_sh_1", gone.select("_sh_1"))
    drop = gone.select(F.col("_sh_1").alias("_sh_a"), "_sh_2")
    rest = tested.where("_mb_maybe").join(drop, (F.col("_sh_1") == F.col("_sh_a")) & (F.col("_sh_h") == F.col("_sh_2")), "left_anti")
    return tested.where(~F.col("_mb_maybe")).union(rest).select(*df.columns)


def query(spark, sf_dir: str) -> DataFrame:
    g = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

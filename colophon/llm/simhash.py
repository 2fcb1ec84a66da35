"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint has one or more 64-bit words; a bit is 1 if it is set in over half of the hashes of a
text's word shingles.  Equal fingerprints are one node.  Nodes meet in buckets, and a bucket is
compared bit-sliced: fingerprints are stored as bit planes, 64 to a machine word, distances to many
of them are counted at once by carry-save bitwise counters, and a word whose 64 distances all
exceed the radius is abandoned.  A bucket above ``CHUNK`` nodes is cut into chunks that meet in
pairs, so no task holds more than two of them, and each task hands on a spanning forest of its
links, never all pairs.

Buckets come in two kinds.  Within radius 3, two words agree in one of four 16-bit blocks, and the
other 48 bits in one of four blocks of 12: ``block_keys`` joins the two, which loses no pair.  For
a wide radius, ``sketch_keys`` joins two minima of hashed shingles, ``TABLES`` times over; a pair of
similarity 0.8 is missed with a chance of 0.36 ** TABLES.  There the bits are a filter only: nodes
that have a near one meet again with their shingle sets, and a pair links if the sets agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from colophon.llm.common import mapped, slices, table
from colophon.operators.graph import components
from colophon.session import reuse

SEED = 42
CHUNK = 1024
TABLES = 8
BYTES_AT_ONCE = 8 << 20
#: shingles that two texts share, of those that either has, and the bits that filter for it
ALIKE, ALIKE_RADIUS = 0.8, 64
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: str | None, words: int) -> list[bytes]:
    """Runs of ``words`` words, A-Z in lower case, joined by a space; of a shorter text, all its words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(found) < words:
        return [b" ".join(found)] if found else []
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    return [joined[a:b] for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist())]


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash derived from 64-bit hashes; the 0-th is the hash itself."""
    if k == 0:
        return x
    x = x + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(text: str | None, words: int) -> np.ndarray:
    """Hashes of the shingles in order, repeated ones too."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles(text, words)], np.uint64)


def set_name(ordered: np.ndarray) -> bytes:
    """128 bits that name a set of hashes; zero for the empty set."""
    return xxhash.xxh128_digest(ordered.tobytes(), SEED) if len(ordered) else bytes(16)


def sign(text: str | None, words: int, width: int, tables: int) -> tuple[bytes, bytes]:
    """Fingerprint of ``width`` 64-bit words; big-endian bytes.

    With tables, then two minima for each of them and 128 bits that name the set of shingles.
    """
    hashes = hashed(text, words)
    if not len(hashes):
        return bytes(8 * width), bytes(16 * tables + (16 if tables else 0))
    out = np.zeros(width, np.uint64)
    for k in range(width):
        own, counts = _mix(hashes, k), np.zeros(64, np.int64)
        for at in range(0, len(own), 1 << 16):
            counts += np.unpackbits(own[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * counts > len(own)).view(">u8")[0]
    sketch = np.array([_mix(hashes, 101 + k).min() for k in range(2 * tables)], np.uint64)
    return out.astype(">u8").tobytes(), sketch.astype(">u8").tobytes() + (set_name(np.unique(hashes)) if tables else b"")


def signed(docs: DataFrame, words: int, width: int = 1, tables: int = 0) -> DataFrame:
    """``doc_id``, ``node`` and ``text_key`` of every row: the fingerprint, followed by the sketch if there are tables."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BYTES_AT_ONCE):
            nodes = [b"".join(sign(t, words, width, tables)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(nodes, pa.binary()), batch.column("text_key")], ["doc_id", "node", "text_key"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return mapped(rows, work, T.StructType([rows.schema["doc_id"], T.StructField("node", T.BinaryType()), T.StructField("text_key", T.LongType())]))


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``node`` and ``body``, its ordered distinct shingle hashes, of the nodes of ``wanted``, found by ``text_key``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], "text", BYTES_AT_ONCE):
                sets = [np.unique(hashed(t, words)) for t in part.column("text").to_pylist()]
                nodes = part.column("node").to_pylist()
                own = [k for k, (n, x) in enumerate(zip(nodes, sets)) if n[-16:] == set_name(x)]  # not a text of an equal key
                yield pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in own], pa.binary()), pa.array([sets[k].tobytes() for k in own], pa.binary())], ["node", "body"])

    texts = docs.select(F.xxhash64("text").alias("text_key"), "text").join(wanted, "text_key").select("node", "text").distinct()
    return mapped(texts, work, "node binary, body binary").dropDuplicates(["node"])


def block_keys(raw: np.ndarray, width: int) -> np.ndarray:
    """[nodes, 16] keys of one-word fingerprints: a 16-bit block and a 12-bit block of the rest."""
    fp = raw[:, 0]
    keys = []
    for i in range(4):
        block = (fp >> np.uint64(16 * i)) & np.uint64(0xFFFF)
        low = fp & np.uint64((1 << (16 * i)) - 1)
        rest = low | ((fp >> np.uint64(16 * i + 16)) << np.uint64(16 * i)) if i < 3 else low
        for j in range(4):
            part = (rest >> np.uint64(12 * j)) & np.uint64(0xFFF)
            keys.append(np.uint64((4 * i + j) << 28) | (block << np.uint64(12)) | part)
    return np.stack(keys, 1)


def sketch_keys(raw: np.ndarray, width: int) -> np.ndarray:
    """[nodes, tables] keys: each joins two minima of the sketch."""
    minima = raw[:, width:-2]
    return np.stack([_mix(_mix(minima[:, 2 * k], 1) ^ minima[:, 2 * k + 1], k + 1) for k in range(minima.shape[1] // 2)], 1)


def vertical(prints: np.ndarray) -> np.ndarray:
    """[planes, words]: bit planes of fingerprints [n, width], 64 fingerprints to a word; n is padded."""
    n = -(-len(prints) // 64) * 64
    bits = np.zeros((n, 64 * prints.shape[1]), np.uint8)
    bits[: len(prints)] = np.unpackbits(prints.astype(">u8").view(np.uint8).reshape(len(prints), -1), axis=1)
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def sliced_near(planes: np.ndarray, queries: np.ndarray, word: np.ndarray, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compares query ``query[c]`` with the 64 fingerprints of ``planes[:, word[c]]``, for every cell c.

    ``queries`` is [planes, n], 0 or all ones.  Counters start so that they overflow at ``radius`` + 1.
    Returns word, query and the mask of near fingerprints of the cells that have any.
    """
    bits = max(1, radius.bit_length())
    counters = [np.full(len(word), FULL if ((1 << bits) - 1 - radius) >> b & 1 else 0, np.uint64) for b in range(bits)]
    over = np.zeros(len(word), np.uint64)
    for p in range(len(planes)):
        carry = planes[p][word] ^ queries[p][query]
        for b in range(bits):
            counters[b], carry = counters[b] ^ carry, counters[b] & carry
        over |= carry
        if p % 8 == 7:
            alive = over != FULL
            n = np.count_nonzero(alive)
            if not n:
                return word[:0], query[:0], over[:0]
            if 4 * n < 3 * len(word):
                word, query, over, counters = word[alive], query[alive], over[alive], [c[alive] for c in counters]
    near = ~over
    found = near != 0
    return word[found], query[found], near[found]


def _pairs(prints: np.ndarray, lanes: np.ndarray, asks: np.ndarray, word: np.ndarray, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of near fingerprints: cells pair a word of ``lanes`` with a row of ``asks``; -1 is padding."""
    planes = vertical(prints[lanes])
    flags = np.unpackbits(prints[asks].astype(">u8").view(np.uint8).reshape(len(asks), -1), axis=1).T.astype(np.uint64)
    w, q, near = sliced_near(planes, np.ascontiguousarray(np.uint64(0) - flags), word, query, radius)
    cell, lane = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    padded = np.full(planes.shape[1] * 64, -1)
    padded[: len(lanes)] = lanes
    a, b = padded[w[cell] * 64 + lane], asks[q[cell]]
    keep = (a >= 0) & (b >= 0) & (a != b)
    return a[keep], b[keep]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def agreeing(a: np.ndarray, b: np.ndarray, bodies: list[bytes], alike: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of those pairs whose shingle sets have a Jaccard index of ``alike`` or more."""
    root: dict[int, int] = {}
    sets: dict[int, np.ndarray] = {}
    out: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    def set_of(x: int) -> np.ndarray:
        if x not in sets:
            sets[x] = np.frombuffer(bodies[x], np.uint64)
        return sets[x]

    codes = np.unique(np.minimum(a, b) * len(bodies) + np.maximum(a, b))
    for x, y in zip((codes // max(1, len(bodies))).tolist(), (codes % max(1, len(bodies))).tolist()):
        p, q = find(x), find(y)
        if p == q:
            continue
        one, two = set_of(x), set_of(y)
        if min(len(one), len(two)) < alike * max(len(one), len(two)):
            continue
        both = len(np.intersect1d(one, two, assume_unique=True))
        if both >= alike * (len(one) + len(two) - both):
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    links = np.array(out, np.int64).reshape(-1, 2)
    return links[:, 0], links[:, 1]


def bucket_links(bounds: np.ndarray, part: np.ndarray, prints: np.ndarray, radius: int, agree=lambda a, b: (a, b)) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (row, row) of the near pairs within each bucket ``bounds[k]:bounds[k + 1]`` that ``agree`` leaves.

    Where a bucket pairs two chunks, ``part`` tells them apart and only pairs across them are compared.
    """
    sizes = np.diff(bounds)
    some_a, some_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    lanes: list[np.ndarray] = []  # words of 64 rows, each of whole small buckets
    held: list[np.ndarray] = []
    room = 64

    def close() -> None:
        nonlocal room
        if held:
            rows = np.concatenate(held)
            lanes.append(np.r_[rows, np.full(64 - len(rows), -1)])
            held.clear()
            room = 64

    for k in np.flatnonzero(sizes > 1):
        rows = np.arange(bounds[k], bounds[k + 1])
        if len(rows) <= 64:
            if len(rows) > room:
                close()
            held.append(rows)
            room -= len(rows)
            continue
        left, right = rows, rows
        if part[rows[0]] != part[rows[-1]]:
            left, right = rows[part[rows] == part[rows[0]]], rows[part[rows] != part[rows[0]]]
        n_words = -(-len(left) // 64)
        a, b = _pairs(prints, left, right, np.tile(np.arange(n_words), len(right)), np.repeat(np.arange(len(right)), n_words), radius)
        a, b = agree(a, b)
        label = forest(len(rows), a - bounds[k], b - bounds[k])
        moved = np.flatnonzero(label != np.arange(len(rows)))
        some_a.append(rows[moved])
        some_b.append(rows[label[moved]])
    close()
    for at in range(0, len(lanes), 512):
        block = np.concatenate(lanes[at : at + 512])
        a, b = _pairs(prints, block, block, np.repeat(np.arange(len(block) // 64), 64), np.arange(len(block)), radius)
        label = forest(len(prints), *agree(a, b))
        moved = np.flatnonzero(label != np.arange(len(prints)))
        some_a.append(moved)
        some_b.append(label[moved])
    return np.concatenate(some_a), np.concatenate(some_b)


def _raw(nodes: pa.Array) -> np.ndarray:
    """[n, words] of equally long big-endian byte strings."""
    values = nodes.to_pylist()
    return np.frombuffer(b"".join(values), ">u8").reshape(len(values), -1).astype(np.uint64) if values else np.zeros((0, 1), np.uint64)


def near_links(nodes: DataFrame, radius: int, width: int, keys, chunk: int = CHUNK, bodies: DataFrame | None = None, alike: float = ALIKE) -> DataFrame:
    """Links ``u``, ``v`` that join every two nodes within ``radius`` bits that share a key.

    With ``bodies``, the nodes' shingle sets, only pairs with a Jaccard index of ``alike`` link.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = keys(_raw(batch.column("node")), width).astype(np.int64)
            index = pa.array(np.repeat(np.arange(batch.num_rows), found.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), batch.column("node").take(index)], ["key", "node"])

    dealt = mapped(nodes.select("node"), spread, "key bigint, node binary")
    # keys with more nodes than one chunk holds
    large = dealt.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > chunk).select("key", F.ceil(F.col("n") / chunk).cast("int").alias("parts"))
    parted = dealt.join(large, "key", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.lit(0)))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    paired = parted.select("key", "node", "part", other.alias("_other")).select("key", F.least("part", "_other").alias("a"), F.greatest("part", "_other").alias("b"), "part", "node")

    if bodies is not None:
        paired = paired.join(bodies, "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pa.Table | None = None

        def links(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            key, a, b, part = (rows.column(c).to_numpy() for c in ("key", "a", "b", "part"))
            new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            # rows without company need no comparison
            sizes = np.diff(np.r_[new, len(key)])
            pick = np.flatnonzero(np.repeat(sizes > 1, sizes))
            node = rows.column("node").take(pa.array(pick)).combine_chunks()
            node = node.chunk(0) if isinstance(node, pa.ChunkedArray) else node
            bounds = np.r_[0, np.cumsum(sizes[sizes > 1])]
            checks = {}
            if "body" in rows.column_names:
                own = rows.column("body").take(pa.array(pick)).to_pylist()
                checks["agree"] = lambda a, b: agreeing(a, b, own, alike)
            left, right = bucket_links(bounds, part[pick], _raw(node)[:, :width], radius, **checks) if len(pick) else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([node.take(pa.array(left)), node.take(pa.array(right))], ["u", "v"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([carried, rows]) if carried is not None else rows
            key, a, b = (rows.column(c).to_numpy() for c in ("key", "a", "b"))
            if not len(key):
                continue
            last = np.flatnonzero((key != key[-1]) | (a != a[-1]) | (b != b[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield links(rows.slice(0, cut))
            carried = rows.slice(cut)
        if carried is not None and carried.num_rows:
            yield links(carried)

    met = paired.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "part")
    return mapped(met, compare, "u binary, v binary")


def _placed(docs: DataFrame, words: int, radius: int, width: int, tables: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, node, text_key`` of every row, and ``node, root, component_id`` of every node."""
    if not tables and (radius > 3 or width != 1):
        raise ValueError("block keys are complete up to radius 3 of one word; give tables for more")
    prints = reuse(signed(docs, words, width, tables), "prints")
    nodes = reuse(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("text_key").alias("text_key")), "nodes")
    links = near_links(nodes, radius, width, sketch_keys if tables else block_keys, chunk)
    if tables:
        links = reuse(links, "near")
        linked = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).distinct()
        bodies = reuse(shingle_sets(docs, nodes.join(linked, "node", "left_semi").select("node", "text_key"), words), "bodies")
        links = near_links(bodies, radius, width, sketch_keys, chunk, bodies)
    roots = reuse(components(links), "roots")
    joined = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints, joined.select("node", "root").join(least, "root").select("node", "root", "component_id")


def near_groups(docs: DataFrame, words: int = 3, radius: int = 3, width: int = 1, tables: int = 0, chunk: int = CHUNK) -> DataFrame:
    """``doc_id``, ``node`` and ``component_id``, the least id reachable over near fingerprints, of every row.

    With tables, a link needs near fingerprints and shingle sets with a Jaccard index of ``ALIKE``.
    Null texts count as empty; texts without words have the fingerprint zero and link like any other.
    Repeated rows stay.  Null ids never name a component (it is null if no member has an id).
    """
    prints, placed = _placed(docs, words, radius, width, tables, chunk)
    return prints.join(placed.select("node", "component_id"), "node").select("doc_id", "node", "component_id")


def keep_one(docs: DataFrame, words: int = 5, radius: int = ALIKE_RADIUS, width: int = 4, tables: int = TABLES) -> DataFrame:
    """One row of each near-duplicate group, that of the least id, with its own columns.

    256-bit fingerprints of five-word shingles are the filter: texts that share 0.8 of their shingles
    differ in about 39 bits, hardly ever in over 64.  Their shingle sets decide.  Groups are of texts:
    rows of one id with different texts are judged apart, and both stay if the texts are not alike.
    Ids come before null, and of one id the text with the least hash; of rows alike in id and text
    that with the least hash of all columns stays, so the result does not depend on partitions.
    """
    prints, placed = _placed(docs, words, radius, width, tables, CHUNK)
    rows = prints.join(placed.select("node", "root"), "node").groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n"))
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "n")).alias("b"))
    kept = reuse(best.select(F.col("b.doc_id").alias("_kept_id"), F.col("b.text_key").alias("_key"), F.col("b.n").alias("_n")), "kept")
    keyed = docs.withColumn("_text", F.xxhash64("text"))
    met = lambda k, how: keyed.join(k, keyed["doc_id"].eqNullSafe(k["_kept_id"]) & (keyed["_text"] == k["_key"]), how)
    single = met(kept.filter("_n = 1"), "left_semi").select(*docs.columns)
    plain = [f"`{c}`" for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    repeated = met(kept.filter("_n > 1"), "inner").groupBy("_kept_id", "_text").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(F.xxhash64(*plain), F.hash(*plain))).alias("_row"))
    return single.unionByName(repeated.select("_row.*"))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """Contract: 64-bit fingerprint and component of every document."""
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("node")).alias("fingerprint"), "component_id")

"""MinHash near-dedup with odd sketches.

Documents with equal shingle sets are one node from the start. A node's MinHash samples give its band keys, and are
folded into an odd sketch: a bit string in which each (sample number, value) flips one bit. Two sketches' exclusive or
counts the samples that differ, which tells high similarities apart precisely, so it sifts the pairs that a band brings
together; what passes is confirmed on the full sets, in exact integers.

First every member of a band bucket is paired with the bucket's smallest node: n near copies cost about n pairs a band.
Buckets that then still span several components are gathered by their main component, and all pairs across components
are tried there in blocks of bounded size, on the sketches and then on the sets; a block returns the links that join
components, never its pairs. No pair that could still join two components is left out, and no bucket has a cap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import BLANK, LOWER, Scratch, buffers, hash_spans, inside, mix, pieces, window_hashes, words

BANDS, ROWS, SKETCH_LONGS = 40, 5, 8
#: At most so many node ids are broadcast to pick their texts (8 bytes each); beyond, the texts are joined by shuffle.
BROADCAST_IDS = 1_000_000

#: Nodes in a block of a gathered group; two blocks meet in a task.
BLOCK = 4096
#: Pairs that one node heads in a part.
HEAD = 512

_rng = np.random.default_rng(20240607)
_A = (_rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and where each text's begin (one more at the end)."""
    data, offs = buffers(texts)
    data = LOWER[data]
    starts, lens, first = words(data, offs, BLANK)
    h = hash_spans(data, starts, lens)
    count = np.diff(first)
    full = window_hashes(h, size)
    at = np.flatnonzero(inside(first, size, len(h))) if len(h) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(count)), count)
    values, own = [full[at]], [owner[at]]
    for n in range(1, size):  # a text of fewer words is one shingle whole
        short = np.flatnonzero(count == n)
        if len(short):
            values.append(mix(window_hashes(h, n)[first[short]] + np.uint64(n)))
            own.append(short)
    v, o = np.concatenate(values), np.concatenate(own)
    order = np.lexsort((v, o))
    v, o = v[order], o[order]
    fresh = np.r_[True, (v[1:] != v[:-1]) | (o[1:] != o[:-1])] if len(v) else np.zeros(0, bool)
    v, o = v[fresh], o[fresh]
    return v, np.searchsorted(o, np.arange(len(count) + 1))


def _sums(v: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set, whatever the order of its members."""
    out = []
    for salt in (0x51ED270B, 0xA24BAED4963EE407):
        total = np.r_[np.uint64(0), np.cumsum(mix(v ^ np.uint64(salt)))]
        out.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return out[0], out[1]


def signatures(v: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (sets x BANDS) and odd sketches (sets x SKETCH_LONGS) of non-empty sets."""
    n, k = len(first) - 1, BANDS * ROWS
    low = np.empty((k, n), np.uint32)
    x = (v >> np.uint64(32)).astype(np.uint32) ^ v.astype(np.uint32)
    buffer = np.empty_like(x)
    for j in range(k):
        np.multiply(x, _A[j], out=buffer)
        buffer += _B[j]
        low[j] = np.minimum.reduceat(buffer, first[:-1])
    wide = low.astype(np.uint64)
    bands = np.full((BANDS, n), np.uint64(0))
    for r in range(ROWS):
        bands = mix(bands * np.uint64(31) + wide[r::ROWS] + np.arange(BANDS, dtype=np.uint64)[:, None])
    spot = (mix(wide * np.uint64(k) + np.arange(k, dtype=np.uint64)[:, None]) % np.uint64(64 * SKETCH_LONGS)).astype(np.int64)
    flips = np.bincount((spot + np.arange(n) * (64 * SKETCH_LONGS)).ravel(), minlength=n * 64 * SKETCH_LONGS)
    sketch = np.packbits((flips & 1).astype(np.uint8), bitorder="little").view("<i8").reshape(n, SKETCH_LONGS)
    return bands.T.view(np.int64) if n else np.zeros((0, BANDS), np.int64), sketch


def flips_at(similarity: float) -> int:
    """Differing sketch bits that a similarity gives on average."""
    k, n = BANDS * ROWS, 64 * SKETCH_LONGS
    return int(n / 2 * (1 - (1 - 2 / n) ** (2 * k * (1 - similarity))))


def _signed(docs: DataFrame, size: int) -> DataFrame:
    def sign(batches):
        for batch in pieces(batches, 1 << 20):
            v, first = shingle_sets(batch.column(1), size)
            s1, s2 = _sums(v, first)
            some = np.flatnonzero(np.diff(first))
            bands, sketch = np.zeros((batch.num_rows, BANDS), np.int64), np.zeros((batch.num_rows, SKETCH_LONGS), np.int64)
            if len(some):
                bands[some], sketch[some] = signatures(v, np.r_[first[:-1][some], first[-1]])
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(m).ravel(), pa.int64())) for m in (bands, sketch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first), pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), *lists], names=["doc_id", "n", "s1", "s2", "bands", "sketch"])

    return docs.mapInArrow(sign, "doc_id bigint, n bigint, s1 bigint, s2 bigint, bands array<bigint>, sketch array<bigint>")


def _sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, s1, members) of the nodes' own texts."""
    few = nodes.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    picked = docs.join(F.broadcast(nodes) if few else nodes, docs["doc_id"] == nodes["node"], "left_semi")

    def collect(batches):
        for batch in pieces(batches, 1 << 20):
            v, first = shingle_sets(batch.column(1), size)
            raw = v.astype("<u8").tobytes()
            members = [raw[8 * a : 8 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sums(v, first)[0], pa.int64()), pa.array(members, pa.binary())], names=["node", "s1", "members"])

    return picked.mapInArrow(collect, "node bigint, s1 bigint, members binary")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, sa, b, sb) whose full sets are as similar as wanted.

    A node that heads more than HEAD pairs has them dealt to as many parts, and its set copied to each part.
    """
    parts = scratch.table(pairs.groupBy("a", "sa").agg(F.ceil(F.count("*") / HEAD).cast("int").alias("parts")).where("parts > 1"), f"{name}-parts")
    dealt = pairs.join(parts, ["a", "sa"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("b", "sb"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    whole = sets.select(F.col("node").alias("a"), F.col("s1").alias("sa"), F.col("members").alias("ma"))
    copies = whole.join(parts, ["a", "sa"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    other = sets.select(F.col("node").alias("b"), F.col("s1").alias("sb"), F.col("members").alias("mb"))
    rows = dealt.join(copies, ["a", "sa", "part"]).join(other, ["b", "sb"]).select("a", "b", "ma", "mb")

    def test(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.sort(np.concatenate([p, q]))
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(both) - shared))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return rows.mapInArrow(test, "a bigint, b bigint")


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows of groups ``g`` dealt to tasks (g, i, j). The group's main component is settled within itself: the others are
    cut into blocks of about BLOCK nodes by hash of the node, the main one into blocks after those, and every two blocks of
    others (and each with itself) and every block of others with one of the main component make a task. So a row of the
    main component is copied once for each block of others, which are few, and never for the main component's own size."""
    rows = rows.withColumn("main", (F.col("c") == F.col("g")).cast("int"))
    count = lambda main: F.ceil(F.count_if(F.col("main") == main) / BLOCK).cast("int")
    sizes = rows.groupBy("g").agg(count(0).alias("others"), count(1).alias("mains")).where("others > 0")
    hashed = F.xxhash64("node")
    own = F.when(F.col("main") == 1, F.col("others") + F.pmod(hashed, F.col("mains"))).otherwise(F.pmod(hashed, F.col("others"))).cast("int")
    last = F.col("others") + F.when(F.col("main") == 1, F.lit(0)).otherwise(F.col("mains")) - 1
    dealt = rows.join(sizes, "g").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    dealt = dealt.select(*[c for c in rows.columns if c != "main"], "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    # Dealt anew by block: partitioned by group alone, all blocks of a group would run in one task.
    return dealt.repartition("g", "i", "j")


def _opposite(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The components of a task's rows, the rows to try (the first block's), and which rows they are tried on."""
    own = table.column("own").to_numpy()
    return table.column("c").to_numpy(), np.flatnonzero(own == table.column("i").to_numpy()), own == table.column("j").to_numpy()


def _sift_block(table: pa.Table, percent: int, limit: int) -> pa.Table:
    """The nodes that have a partner of another component as near as the sketches can tell."""
    c, tried, second = _opposite(table)
    n = table.column("n").to_numpy()
    sketch = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(n), -1)
    hit = np.zeros(len(n), bool)
    for k in tried.tolist():
        near = second & (c != c[k]) & (100 * np.minimum(n, n[k]) >= percent * np.maximum(n, n[k]))
        at = np.flatnonzero(near)
        at = at[np.bitwise_count(sketch[at] ^ sketch[k]).sum(1) <= limit] if len(at) else at
        if len(at):
            hit[at] = hit[k] = True
    return table.select(["g", "node", "s1", "c"]).filter(pa.array(hit))


def _link_block(table: pa.Table, percent: int) -> pa.Table:
    """Links between rows of different components whose full sets are near enough, as many as join what they can."""
    c, tried, second = _opposite(table)
    node = table.column("node").to_numpy()
    sets = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("members")]
    size = np.array([len(x) for x in sets])
    values, member = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(member, kind="stable")
    posted, begin = owner[order], np.searchsorted(member[order], np.arange(len(values) + 1))
    at = np.cumsum(size) - size
    parent: dict = {}

    def root(x):
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    links = []
    for k in tried.tolist():
        own = member[at[k] : at[k] + size[k]]
        many = begin[own + 1] - begin[own]
        met = posted[np.repeat(begin[own], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        both = np.bincount(met, minlength=len(sets))
        good = second & (c != c[k]) & (100 * both >= percent * (size + size[k] - both))
        for m in np.flatnonzero(good).tolist():
            p, q = root(c[k]), root(c[m])
            if p != q:
                parent[p] = q
                links.append((int(node[k]), int(node[m])))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) of every node with an edge: the smallest node it reaches.

    Alternating large-star and small-star rounds over the written edges (each node with its neighbours' smallest), until
    a round changes nothing; a round is two aggregations that combine before the shuffle.
    """

    def digest(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    cur = scratch.table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0")
    before, k = digest(cur), 0
    while before[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        large = scratch.table(large, f"{name}-{k}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        nxt = scratch.table(small.where("u <> v").distinct(), f"{name}-{k + 1}")
        after = digest(nxt)
        scratch.drop(f"{name}-{k}", f"{name}-{k}-large")
        cur, k = nxt, k + 1
        if after == before:
            break
        before = after
    out = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, sift: float = 0.62, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    A row's set holds its distinct shingles of ``shingle`` words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a text of fewer
    words is one shingle whole; a null or wordless text has an empty set, linked with nothing. Rows are linked where
    100 * intersection >= ``percent`` * union; ``component_id`` is the smallest doc_id reachable and ``kept`` says that it
    is the row's own. Rows that share a doc_id are one document: what either is linked with, both are. A row without
    doc_id takes no part (null component, kept). Other columns are ignored.

    ``sift`` is the sketch estimate below which a pair is not confirmed: a pair at similarity 0.8 falls
    there with probability 8.5e-7 (Binomial(200, 0.2) differing samples, parity of twice as many balls in 512 bins, limit
    114), one at 0.85 with 2.7e-11. A pair at 0.8 shares no band with probability (1 - 0.8 ** 5) ** 40 = 1.2e-7.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "near")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    signed = scratch.table(_signed(rows, shingle), "signed")
    full = signed.where("n > 0 AND doc_id IS NOT NULL")
    # Equal sets first: one node each, named by its smallest document.
    groups = scratch.table(full.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.first("n").alias("n")), "groups")
    nodes = scratch.table(full.join(groups.select(F.col("node").alias("doc_id"), "s1", "s2"), ["doc_id", "s1", "s2"], "left_semi").dropDuplicates(["doc_id", "s1"]).select(F.col("doc_id").alias("node"), "s1", "n", "bands", "sketch"), "nodes")
    member = full.select("doc_id", "s1", "s2").join(groups.select("s1", "s2", "node"), ["s1", "s2"]).select("doc_id", "node")
    # A doc_id with rows in several groups ties them together.
    shared = member.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("doc_id", "a")
    ties = scratch.table(member.join(shared, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct(), "ties")

    # Heads bring their size and sketch with them to the buckets, so that no pair has to look a busy head up.
    light = nodes.select("node", "s1", "n", "sketch")
    buckets = nodes.select("node", "s1", F.explode("bands").alias("band"))
    heads = buckets.groupBy("band").agg(F.min(F.struct("node", "s1")).alias("head"), F.count("*").alias("size")).where("size > 1")
    heads = heads.select("band", "head.node", "head.s1").join(light, ["node", "s1"])
    heads = scratch.table(heads.select("band", F.struct("node", "s1", "n", "sketch").alias("head")), "heads")
    crowd = scratch.table(buckets.join(heads.select("band"), "band", "left_semi"), "crowd")

    flips = sum(F.bit_count(F.col("head.sketch")[k].bitwiseXOR(F.col("sketch")[k])) for k in range(SKETCH_LONGS))
    alike = (100 * F.least("head.n", "n") >= percent * F.greatest("head.n", "n")) & (flips <= flips_at(sift))

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        pairs = scratch.table(pairs, f"{name}-pairs")
        ids = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        sets = scratch.table(_sets(rows, ids, shingle), f"{name}-sets")
        out = scratch.table(_confirm(pairs, scratch.table(sets.dropDuplicates(["node", "s1"]), f"{name}-once"), percent, scratch, name), f"{name}-edges")
        scratch.drop(f"{name}-sets", f"{name}-pairs", f"{name}-once", f"{name}-parts")
        return out

    star = crowd.join(heads, "band").where("node <> head.node OR s1 <> head.s1").join(light, ["node", "s1"]).where(alike)
    star = star.select(F.col("head.node").alias("a"), F.col("head.s1").alias("sa"), F.col("node").alias("b"), F.col("s1").alias("sb")).distinct()
    edges = confirmed(star, "star").unionByName(ties)
    found = scratch.table(components(edges, scratch, "star"), "components-star")
    # Buckets that still span several components, by their main one.
    placed = crowd.join(found, "node", "left").select("band", "node", "s1", F.coalesce("component", "node").alias("c"))
    count = placed.groupBy("band", "c").agg(F.count("*").alias("size"))
    main = count.groupBy("band").agg(F.max(F.struct("size", "c")).alias("m"), F.count("*").alias("k")).where("k > 1").select("band", F.col("m.c").alias("g"))
    gathered = scratch.table(placed.join(main, "band").select("g", "node", "s1", "c").distinct(), "gathered")
    sketched = _blocks(gathered.join(nodes.select("node", "s1", "n", "sketch"), ["node", "s1"]))
    limit = flips_at(sift)
    open_ = sketched.groupBy("g", "i", "j").applyInArrow(lambda t: _sift_block(t, percent, limit), "g bigint, node bigint, s1 bigint, c bigint")
    open_ = scratch.table(open_.distinct(), "open")
    sets = scratch.table(_sets(rows, open_.select("node").distinct(), shingle).dropDuplicates(["node", "s1"]), "open-sets")
    whole = _blocks(open_.join(sets, ["node", "s1"]))
    more = scratch.table(whole.groupBy("g", "i", "j").applyInArrow(lambda t: _link_block(t, percent), "a bigint, b bigint"), "open-edges")
    if not more.isEmpty():
        found = scratch.table(components(edges.unionByName(more), scratch, "all"), "components-all")
    scratch.drop("crowd", "heads", "gathered", "open", "open-sets")
    named = member.dropDuplicates(["doc_id"]).join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles")).join(named, "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

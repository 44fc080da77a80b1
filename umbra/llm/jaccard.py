"""N-gram Jaccard join with rare-first prefixes, and the components of its links.

Documents are sets of word shingles. Two sets of similarity t share a shingle
among the first ``n - ceil(t n) + 1`` of each, in any order common to all; here
the rarest come first, so that shingles of one document alone fill prefixes
without meeting anything. Only the others are joined.

1. Copies (equal sets) fall together; the smallest id stands for them.
2. Shingles are dealt by hash, counted, and those of two documents or more go
   back to their documents with their counts. Shingles found in very many
   documents are known from a first pass (a bounded list) and stay with theirs.
3. Within each prefix shingle every document first meets one hub, the document
   with the fewest rarer shingles. Then only documents of different components
   meet, so that a large group of near copies never meets itself pair by pair.
   A pair must pass the length and positional filters to be listed, is listed
   once, and is verified on whole sets after a suffix filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shingles import mix64, shingle_sets, slices, tidy
from .store import shared, sized, spread_join, written

#: Most shingles that are known as frequent, and the least count to be one.
FREQUENT, FREQUENT_FROM = 1 << 16, 1000
#: Shingles of a bucket and most partitions that buckets are dealt to; documents that are verified beside one hub at once.
BUCKET, PARTITIONS, BESIDE = 1_000_000, 1 << 15, 32


def _digest(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sizes(width: int):
    """A row for each document, and for each shingle that many of a slice's documents share."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"), width)
                seen, count = np.unique(np.concatenate(sets), return_counts=True)
                many = count >= max(8, len(sets) // 500)
                n, m = len(sets), int(many.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([0] * n + [1] * m, pa.int8()),
                        pa.concat_arrays([part.column("doc_id"), pa.nulls(m, pa.int64())]),
                        pa.array([len(s) for s in sets] + count[many].tolist(), pa.int64()),
                        pa.array([_digest(s) for s in sets] + [None] * m, pa.binary()),
                        pa.concat_arrays([pa.nulls(n, pa.int64()), _as_long(seen[many])]),
                    ],
                    names=["kind", "doc_id", "n", "class", "gram"],
                )

    return run


def prefix_length(n, percent: int):
    """How many shingles of n, in the common order, must hold one of any partner's."""
    return n - -(-percent * n // 100) + 1


def _first_rows(width: int):
    """Of rows that repeat an id, a task's first one of the id's class."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                ids, keep = part.column("doc_id").to_pylist(), []
                fresh = part.take(pa.array([i for i, node in enumerate(ids) if node not in seen], pa.int64()))
                rows = zip(fresh.column("doc_id").to_pylist(), fresh.column("class").to_pylist(), shingle_sets(fresh.column("text"), width), strict=True)
                for i, (node, class_, grams) in enumerate(rows):
                    if node not in seen and len(grams) and class_ == _digest(grams):
                        seen.add(node)
                        keep.append(i)
                yield fresh.take(pa.array(keep, pa.int64())).select(["doc_id", "text"])

    return run


def _chosen(part: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Node and set of each row that has words."""
    for node, grams in zip(part.column("doc_id").to_pylist(), shingle_sets(part.column("text"), width), strict=True):
        if len(grams):
            yield node, grams


PACKED = "bucket int, node binary, count binary, gram binary, size binary, kept binary"


def _deal(width: int, percent: int, many: int, frequent):
    """Shingles of each slice by bucket, as arrays; documents go to a bucket by
    their own hash with their size and the shingles that stay with them."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = frequent.value
        for batch in batches:
            for part in slices(batch):
                nodes, sets = [], []
                for node, grams in _chosen(part, width):
                    nodes.append(node)
                    sets.append(grams)
                if not nodes:
                    continue
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                grams, own = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), size)
                at = np.minimum(np.searchsorted(known, grams), max(0, len(known) - 1))
                often = known[at] == grams if len(known) else np.zeros(len(grams), bool)
                loose = np.bincount(own[~often], minlength=len(sets))
                node = np.array(nodes, np.int64)
                # frequent shingles that reach a prefix, in their common order
                o_own, o_gram, o_rank = own[often], grams[often], rank[at[often]] if len(known) else grams[often]
                order = np.lexsort([o_rank, o_own])
                o_own, o_gram, o_rank = o_own[order], o_gram[order], o_rank[order]
                place = np.arange(len(o_own)) - np.searchsorted(o_own, o_own)
                reach = loose[o_own] + place < prefix_length(size[o_own], percent)
                o_own, o_gram, o_rank = o_own[reach], o_gram[reach], o_rank[reach]
                grams, own = grams[~often], own[~often]
                del sets, at, often
                bucket = ((grams >> np.uint64(32)) % np.uint64(many)).astype(np.int32)
                home = (mix64(node.view(np.uint64)) % np.uint64(many)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                grams, own, bucket = grams[order], own[order], bucket[order]
                del order
                cut = np.searchsorted(bucket, np.arange(many + 1))
                rows: list[list] = [[] for _ in range(6)]
                for k in range(many):
                    a, b = int(cut[k]), int(cut[k + 1])
                    if b > a:
                        mine, lead = own[a:b], np.flatnonzero(np.diff(own[a:b], prepend=-1))
                        values = (k, node[mine[lead]].tobytes(), np.diff(np.append(lead, b - a)).astype(np.int32).tobytes(), grams[a:b].tobytes(), None, None)
                        for column, v in zip(rows, values, strict=True):
                            column.append(v)
                for k in np.unique(home).tolist():
                    here = home == k
                    o = here[o_own]
                    values = (k, node[here].tobytes(), None, None, np.stack([size[here], loose[here]]).tobytes(), np.stack([node[o_own[o]].view(np.uint64), o_gram[o], o_rank[o].astype(np.uint64)]).tobytes())
                    for column, v in zip(rows, values, strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(c, pa.binary()) for c in rows[1:])], names=["bucket", "node", "count", "gram", "size", "kept"])

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows come sorted by bucket; one bucket is held at a time."""
    at, held = None, []
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            k = row[0].as_py()
            if k != at and held:
                yield at, held
                held = []
            at = k
            held.append({n: (v.as_buffer() if v.is_valid else None) for n, v in zip(batch.schema.names[1:], row[1:], strict=True)})
    if held:
        yield at, held


def _count(many: int):
    """Counts a bucket's shingles and sends those of two documents or more home."""

    def send(node, gram, often, size, loose) -> Iterator[pa.RecordBatch]:
        home = (mix64(node.view(np.uint64)) % np.uint64(many)).astype(np.int64)
        for k in np.unique(home).tolist():
            at = home == k
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x[at].tobytes()], pa.binary()) for x in (node, gram, often, size, loose))], names=["bucket", "node", "gram", "often", "size", "loose"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            own, grams = [], []
            for r in rows:
                node = np.frombuffer(r["node"], np.int64)
                if r["gram"] is not None:
                    own.append(np.repeat(node, np.frombuffer(r["count"], np.int32)))
                    grams.append(np.frombuffer(r["gram"], np.uint64))
                else:
                    size, loose = np.frombuffer(r["size"], np.int64).reshape(2, -1)
                    none = np.zeros(len(node), np.int64)
                    yield from send(node, none.view(np.uint64), none, size, loose)
                    kept = np.frombuffer(r["kept"], np.uint64).reshape(3, -1)
                    none = np.zeros(kept.shape[1], np.int64)
                    yield from send(kept[0].view(np.int64), kept[1], kept[2].view(np.int64) + (1 << 40), none, none)
            if grams:
                gram, node = np.concatenate(grams), np.concatenate(own)
                order = np.argsort(gram, kind="stable")
                gram, node = gram[order], node[order]
                lead = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
                often = np.repeat(c := np.diff(np.append(lead, len(gram))), c)
                some = often > 1
                gram, node, often = gram[some], node[some], often[some].astype(np.int64)
                none = np.zeros(len(gram), np.int64)
                yield from send(node, gram, often, none, none)

    return run


def _prefixes(percent: int):
    """(gram, node, n, pos) of the prefix shingles that another document has too."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            node, often, size, loose = (np.concatenate([np.frombuffer(r[k], np.int64) for r in rows]) for k in ("node", "often", "size", "loose"))
            gram = np.concatenate([np.frombuffer(r["gram"], np.uint64) for r in rows])
            order = np.lexsort([gram, often, node])  # a document's own row has count 0 and comes first
            node, often, size, loose, gram = node[order], often[order], size[order], loose[order], gram[order]
            lead = np.flatnonzero(often == 0)
            many = np.diff(np.append(lead, len(node)))
            first = np.repeat(lead, many)
            place = np.arange(len(node)) - first - 1
            shared = np.add.reduceat((often > 0) & (often < 1 << 40), lead) if len(lead) else lead
            alone = loose[first] - np.repeat(shared, many)  # its shingles that no other document has
            n, pos = size[first], alone + place
            out = (often > 0) & (pos < prefix_length(n, percent))
            yield pa.RecordBatch.from_arrays([_as_long(gram[out]), pa.array(node[out]), pa.array(n[out]), pa.array(pos[out])], names=["gram", "node", "n", "pos"])

    return run


def _set_rows(width: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = list(_chosen(part, width))
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.int64()), pa.array([g.tobytes() for _, g in rows], pa.binary())], names=["node", "grams"])

    return run


def needed(a: int, b: int, percent: int) -> int:
    """The least intersection of sets of these sizes that link."""
    return -(-percent * (a + b) // (100 + percent))


def apart(x: np.ndarray, y: np.ndarray, most: int, depth: int = 3) -> int:
    """A lower bound of the elements in only one of two sorted sets (suffix
    filter): both are split at one's middle element, and parts can only match
    parts on the same side."""
    least = abs(len(x) - len(y))
    if least > most or depth == 0 or len(x) < 4 or len(y) < 4:
        return least
    mid = y[len(y) // 2]
    i, j = int(np.searchsorted(x, mid)), len(y) // 2
    low, high = abs(i - j), abs((len(x) - i) - (len(y) - j))
    if low + high > most:
        return low + high
    low = apart(x[:i], y[:j], most - high, depth - 1)
    return low + apart(x[i:], y[j:], most - low, depth - 1)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    need = needed(len(x), len(y), percent)
    if need > min(len(x), len(y)):
        return False
    most = len(x) + len(y) - 2 * need
    return apart(x, y, most) <= most and len(np.intersect1d(x, y, assume_unique=True)) >= need


def _verify(percent: int):
    """Rows come by hub and block, the hub's own set (node null) first."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, x = None, None
        for batch in batches:
            a, b = [], []
            for hub, node, grams in zip(batch.column("hub").to_pylist(), batch.column("node").to_pylist(), batch.column("grams"), strict=True):
                y = np.frombuffer(grams.as_buffer(), np.uint64)
                if node is None:
                    at, x = hub, y.copy()
                elif at == hub and linked(x, y, percent):
                    a.append(min(hub, node))
                    b.append(max(hub, node))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _passing(percent: int, pair):
    """Length and positional filters of two prefix rows on one shingle, as SQL."""
    (n, pos), (m, qos) = pair
    need = f"ceil({percent} * ({n} + {m}) / {100 + percent})"
    return F.expr(f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m}) AND 1 + least({n} - {pos}, {m} - {qos}) - 1 >= {need}")


def similarity_classes(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """Links documents whose shingle sets have 100 * intersection >= percent * union.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a document's set is its
    distinct ``width``-word shingles; with fewer words its whole sequence is the
    one shingle; null, empty or blank text has none and links with nothing.
    Shingles are told apart by 64-bit hashes.

    Returns doc_id, n_shingles and component_id, the smallest doc_id reachable
    by links, itself included; one row per input row. Rows that repeat a doc_id
    are one document; if their words differ, the one with the smallest digest
    takes part. A null doc_id takes no part and has a null component_id. Other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = written(docs.mapInArrow(_sizes(width), "kind byte, doc_id long, n long, class binary, gram long"), "sizes")
    rows = first.filter("kind = 0").select("doc_id", "n", "class")
    # one class of each id, one node of each class
    ids = rows.filter("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min("class").alias("class"), F.count("*").alias("copies"))
    ids = written(ids, "ids")
    nodes = written(ids.groupBy("class").agg(F.min("doc_id").alias("node"), F.count("*").alias("ids")).filter("ids > 1"), "classes")
    several = written(spread_join(ids, nodes, "class", "ids").select("doc_id", "node", "class", "copies"), "several")
    single = ids.join(sized(several.select("doc_id")), "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("node"), "class", "copies")
    of_node = written(single.unionByName(several), "nodes")
    # one row of each node: copies go, and of rows that repeat an id one of its class stays
    out = of_node.filter("doc_id <> node or copies > 1").select("doc_id")
    again = of_node.filter("doc_id = node and copies > 1").select("doc_id", "class")
    again = docs.join(sized(again), "doc_id").select("doc_id", "text", "class").mapInArrow(_first_rows(width), "doc_id long, text string")
    again = written(again.groupBy("doc_id").agg(F.first("text").alias("text")), "again")
    chosen = docs.filter("doc_id is not null").join(sized(out), "doc_id", "left_anti").select("doc_id", "text").union(again)
    total = rows.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).head()
    top = first.filter("kind = 1").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(FREQUENT_FROM, total["rows"] // 500)).orderBy(F.desc("n"), "gram").limit(FREQUENT).collect()
    top = sorted(((r["gram"] % (1 << 64)), k) for k, r in enumerate(reversed(top)))
    known = np.array([g for g, _ in top], np.uint64), np.array([k for _, k in top], np.int64)
    many = max(12, -(-(total["n"] or 0) // BUCKET))
    parts = min(many, PARTITIONS)
    with shared(spark, known) as frequent:
        dealt = chosen.mapInArrow(_deal(width, percent, many, frequent), PACKED)
        counted = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_count(many), "bucket int, node binary, gram binary, often binary, size binary, loose binary")
        prefix = written(counted.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_prefixes(percent), "gram long, node long, n long, pos long"), "prefix")
    # only shingles in two prefixes or more can list a pair
    hubs = written(prefix.groupBy("gram").agg(F.min(F.struct("pos", "node", "n")).alias("hub"), F.count("*").alias("c")).filter("c > 1"), "hubs")
    prefix = written(spread_join(prefix, hubs, "gram", "c").select("gram", "node", "n", "pos", "hub"), "prefix")
    hub = prefix.filter("node <> hub.node").filter(_passing(percent, (("n", "pos"), ("hub.n", "hub.pos"))))
    tested = written(hub.select(F.col("hub.node").alias("hub"), "node").distinct(), "pairs")
    wanted = written(prefix.select(F.col("node").alias("doc_id")).distinct(), "wanted")
    sets = written(chosen.join(sized(wanted), "doc_id", "left_semi").mapInArrow(_set_rows(width), "node long, grams binary"), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs (hub, node) that link. A hub's set goes once to each block of its partners."""
        blocks = written(pairs.groupBy("hub").agg(F.count("*").alias("c")).select("hub", "c", F.ceil(F.col("c") / BESIDE).cast("int").alias("many")), "blocks")
        each = spread_join(pairs, blocks, "hub", "c").select("hub", "node", F.pmod(F.xxhash64("node"), "many").cast("int").alias("block"))
        own = sets.join(sized(blocks).withColumnRenamed("hub", "node"), "node").select(F.col("node").alias("hub"), F.lit(None).cast("long").alias("node"), F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("block"), "grams")
        met = own.unionByName(each.join(sets, "node").select("hub", "node", "block", "grams"))
        met = met.repartition("hub", "block").sortWithinPartitions("hub", "block", F.col("node").asc_nulls_first())
        return written(met.select("hub", "node", "grams").mapInArrow(_verify(percent), "a long, b long"), "links")

    links = verified(tested)
    found = written(components(links), "components")
    # documents of a shingle's largest component needn't meet each other again
    now = written(prefix.join(found, "node", "left").select("gram", "node", "n", "pos", F.coalesce("component", "node").alias("c")), "prefix")
    sides = now.groupBy("gram", "c").agg(F.count("*").alias("m")).groupBy("gram").agg(F.max(F.struct("m", "c"))["c"].alias("main"), F.count("*").alias("sides"), F.sum("m").alias("all")).filter("sides > 1").drop("sides")
    open_ = written(spread_join(now, written(sides, "sides"), "gram", "all").drop("all"), "open")
    left = open_.filter("c <> main").select("gram", *(F.col(x).alias(f"{x}1") for x in ("node", "n", "pos", "c")))
    met = left.join(open_, (left["gram"] == open_["gram"]) & F.expr("c1 <> c AND (c = main OR node1 < node)") & _passing(percent, (("n1", "pos1"), ("n", "pos"))))
    met = met.select(F.col("node1").alias("hub"), "node").distinct()
    for x, y in (("hub", "node"), ("node", "hub")):  # those that met as hub and member don't again
        met = met.join(tested.select(F.col("hub").alias(x), F.col("node").alias(y)), ["hub", "node"], "left_anti")
    rest = written(met, "pairs")
    more = verified(rest)
    # links between components: each is one node now
    up, down = (found.select(F.col("node").alias(n), F.col("component").alias(c)) for n, c in (("a", "ca"), ("b", "cb")))
    merged = components(more.join(up, "a", "left").join(down, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    merged = written(merged.toDF("component", "root"), "components")
    roots = found.join(merged, "component", "left").select("node", F.coalesce("root", "component").alias("root"))
    roots = written(roots.union(merged.join(found.select("component").distinct(), "component", "left_anti").select("component", "root")), "roots")
    of_id = of_node.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    return rows.join(of_id, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The input's rows with one document of each component: the smallest id.

    A document without words stays; of rows that repeat an id, all stay if their
    id does; null ids stay.
    """
    classes = similarity_classes(docs, width, percent)
    gone = written(classes.filter("component_id <> doc_id").select("doc_id").distinct(), "gone")
    return docs.join(sized(gone), "doc_id", "left_anti").select(docs.columns)

"""N-gram Jaccard join: candidates by shared rare shingles, then prefix trees of globally ordered sets; links become components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SOLID, buffers, drop, folded, mixed, pieces, spans_hash, word_bounds, written
from .components import connected

#: Words of a shingle; two sets link when UNDER * intersection >= OVER * union.
WORDS, OVER, UNDER = 5, 75, 100
#: The first pass sends one in so many of a set's shingles besides those that any exact prefix filter must.
MORE = 10
#: Sets of one tree, shingles gathered before they are dealt out, sets of a gathering with one shingle from which it counts as common, buckets per shuffle partition, ids that are broadcast.
TREE_SETS, _GATHER, _COMMON, _BUCKETS, _BROADCAST = 4096, 300_000, 32, 4, 1_000_000
_PIECE = 1 << 20
_ALWAYS = 1 << 30


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first, ids): the distinct shingles of each row in ascending order of hash, where each row's begin, and an id of each row's set."""
    data, ends = buffers(column)
    data = folded(data)
    starts, stops, first = word_bounds(data, ends, SOLID)
    words = spans_hash(data, starts, stops)
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), np.maximum(count - WORDS + 1, (count > 0).astype(np.int64)))
    begin = first[:-1][row] + np.arange(len(row)) - np.searchsorted(row, row, "left")
    size = np.minimum(count, WORDS)[row]
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    value = size.astype(np.uint64)
    for j in range(WORDS):
        value = mixed(value * np.uint64(31) + np.where(j < size, padded[begin + j], np.uint64(0)))
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    begins = np.searchsorted(row, np.arange(len(count) + 1))
    total = np.zeros((2, len(value) + 1), np.uint64)
    np.cumsum(mixed(value), out=total[0, 1:])
    np.cumsum(mixed(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=total[1, 1:])
    sums = total[:, begins[1:]] - total[:, begins[:-1]]
    return value, begins, mixed(sums[0] + mixed(sums[1] + np.diff(begins).astype(np.uint64)))


def least_common(n: np.ndarray) -> np.ndarray:
    """Shingles that a set of n shares with any set it links to, at least."""
    return -(-OVER * n // UNDER)


def sent(n: np.ndarray, more: int) -> np.ndarray:
    """How many of a set's first shingles, in any order that all sets share, go to the join."""
    return np.minimum(n, n - least_common(n) + -(-n // more))


def needed(n, more: int, smallest=np.minimum):
    """How many of those it shares with those of any set it links to, at least: the first that the two have in common lie among
    them, and the partner's size is no less than least_common(n)."""
    least = (OVER * n + UNDER - 1) // UNDER
    return smallest(least, (least + more - 1) // more)


def _blob(*columns: np.ndarray) -> bytes:
    return b"".join([np.int64(len(columns[0])).tobytes(), *(c.astype("<u8").tobytes() for c in columns)])


def _unblob(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    return np.frombuffer(data, "<u8", offset=8).reshape(-1, n)


_DEALT = "bucket int, kind int, data binary"


def _deal(buckets: int, more: int | None):
    """Each gathering's shingles by bucket (kind 0: shingle, set, size, common), what it has settled itself (kind 1, same columns), its documents (kind 2).

    Only the first of equal sets sends shingles. A shingle of many sets of a gathering is settled there, and two of these sets
    tell the others that it is common, so no bucket gets more than two rows a gathering of it. more None: all shingles go.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        number = 0

        def ready() -> pa.RecordBatch:
            token, owner, size = (np.concatenate(x) for x in list(zip(*held, strict=True))[:3])
            held.clear()
            order = np.lexsort((owner, token))
            token, owner, size = token[order], owner[order], size[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
            token, owner, size = token[new], owner[new], size[new]
            head = np.ones(len(token), bool)
            head[1:] = token[1:] != token[:-1]
            group = np.cumsum(head) - 1
            common = (np.bincount(group, minlength=1)[group] >= _COMMON) if len(group) else head
            rank = np.arange(len(token)) - np.flatnonzero(head)[group] if len(group) else group
            settled = common & (rank >= 2)
            rows = [(number % buckets, 1, _blob(token[settled], owner[settled], size[settled], common[settled]))] if settled.any() else []
            token, owner, size, common = (x[~settled] for x in (token, owner, size, common))
            side = (token % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(side, kind="stable")
            cut = np.searchsorted(side[by], np.arange(buckets + 1))
            rows += [(b, 0, _blob(*(x[by[cut[b] : cut[b + 1]]] for x in (token, owner, size, common)))) for b in range(buckets) if cut[b] < cut[b + 1]]
            return batch_of(rows)

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "kind", "data"])

        for batch in pieces(batches, "text", _PIECE):
            value, begins, ids = shingles(batch.column(1))
            n = np.diff(begins)
            key = batch.column(0)
            if more is not None:
                yield batch_of([(number % buckets, 2, _blob(key.fill_null(0).to_numpy().view(np.uint64), key.is_valid().to_numpy(zero_copy_only=False), n, ids))])
            known = np.flatnonzero(key.is_valid().to_numpy(zero_copy_only=False))
            own = known[np.unique(ids[known], return_index=True)[1]]
            row = np.repeat(np.arange(len(n)), n)
            rank = np.arange(len(row)) - begins[:-1][row]
            kept = np.isin(np.arange(len(n)), own)[row] & (rank < (sent(n, more) if more is not None else n)[row])
            held.append((value[kept], ids[row[kept]], n[row[kept]].astype(np.uint64)))
            number += 1
            if sum(len(h[0]) for h in held) >= _GATHER:
                yield ready()
        if held:
            yield ready()

    return deal


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(shingle, set, size, sets that hold it) of the shingles in several sets, a bucket at a time; or documents, as (None, key, known, size, set)."""
    now, held = -1, []

    def ready() -> Iterator[tuple[np.ndarray, ...]]:
        if held:
            token, owner, size, common = np.concatenate(held, axis=1)
            held.clear()
            order = np.lexsort((owner, token))
            token, owner, size, common = token[order], owner[order], size[order], common[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
            group = np.cumsum(np.concatenate([[True], token[1:] != token[:-1]])) - 1
            count = np.bincount(group, new).astype(np.int64)
            count[np.bincount(group, common) > 0] = _ALWAYS
            kept = new & (count[group] > 1)
            yield token[kept], owner[kept], size[kept], count[group][kept]

    for batch in batches:
        for bucket, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == 2:
                yield (None, *_unblob(data))
            elif kind == 1:
                token, owner, size, _ = _unblob(data)
                yield token, owner, size, np.full(len(token), _ALWAYS)
            else:
                if bucket != now:
                    yield from ready()
                    now = bucket
                held.append(_unblob(data))
    yield from ready()


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (known, key, n, id) and, for each set, how many of its shingles are shared (known null)."""
    for token, *rest in _shared(batches):
        if token is None:
            key, known, n, ids = rest
            known = known.astype(bool)
            out = [pa.array(key.view(np.int64), mask=~known), pa.array(n.astype(np.int64)), pa.array(ids.view(np.int64)), pa.nulls(len(key), pa.int64())]
        else:
            owner, at, count = np.unique(rest[0], return_index=True, return_counts=True)
            out = [pa.nulls(len(owner), pa.int64()), pa.array(rest[1][at].astype(np.int64)), pa.array(owner.view(np.int64)), pa.array(count.astype(np.int64))]
        yield pa.RecordBatch.from_arrays(out, names=["key", "n", "id", "shared"])


def _second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for token, owner, size, count in _shared(batches):
        yield pa.RecordBatch.from_arrays([pa.array(owner.view(np.int64)), pa.array(size.astype(np.int64)), pa.array(token.view(np.int64)), pa.array(count.astype(np.int32))], names=["id", "n", "shingle", "sets"])


class Tree:
    """A path-compressed prefix tree of sets of ranks, ascending. links() walks it for one set at a time.

    A node's sets share the matches along its path. It is left when what remains of the set or below the node cannot reach
    the overlap needed, when no size below fits, or when all sets below are in the asking set's component.
    """

    def __init__(self, universe: int):
        self.inside = np.zeros(universe, bool)
        self.root = self._node(np.zeros(0, np.int64))

    @staticmethod
    def _node(edge: np.ndarray) -> dict:
        return {"edge": edge, "children": {}, "sets": [], "low": 1 << 60, "high": 0, "below": 0, "of": -1}

    def insert(self, ranks: np.ndarray, size: int, number: int, same) -> None:
        """same(a, b): whether two sets are in one component."""
        node, at = self.root, 0
        while True:
            rest = len(ranks) - at
            node["low"], node["high"], node["below"] = min(node["low"], size), max(node["high"], size), max(node["below"], rest)
            node["of"] = number if node["of"] == -1 else node["of"] if node["of"] is not None and same(node["of"], number) else None
            if not rest:
                node["sets"].append((number, size))
                return
            child = node["children"].get(int(ranks[at]))
            if child is None:
                child = node["children"][int(ranks[at])] = self._node(ranks[at:])
                node, at = child, len(ranks)
                continue
            edge = child["edge"]
            common = min(len(edge), rest)
            differ = np.flatnonzero(edge[:common] != ranks[at : at + common])
            common = int(differ[0]) if len(differ) else common
            if common < len(edge):
                upper = self._node(edge[:common])
                upper |= {n: child[n] for n in ("low", "high", "of")} | {"below": child["below"] + len(edge) - common}
                child["edge"] = edge[common:]
                upper["children"][int(edge[common])] = child
                node["children"][int(ranks[at])] = child = upper
            node, at = child, at + common

    def links(self, ranks: np.ndarray, size: int, number: int, same) -> Iterator[int]:
        self.inside[ranks] = True
        least = -(-OVER * size // UNDER)
        todo = [(self.root, 0)]
        while todo:
            node, matched = todo.pop()
            if node["of"] == -1 or node["high"] < least or node["low"] * OVER > size * UNDER or node["of"] is not None and same(node["of"], number):
                continue
            edge = node["edge"]
            rest = len(ranks)
            if len(edge):
                matched += int(np.count_nonzero(self.inside[edge]))
                rest -= int(np.searchsorted(ranks, edge[-1], "right"))
            if (UNDER + OVER) * (matched + min(rest, node["below"])) < OVER * (size + max(node["low"], least)):
                continue
            for other, its in node["sets"]:
                if (UNDER + OVER) * matched >= OVER * (size + its) and not same(other, number):
                    yield other
            todo += [(c, matched) for first, c in node["children"].items() if not self.inside[first]]
            todo += [(c, matched) for first, c in node["children"].items() if self.inside[first]]
        self.inside[ranks] = False


def tree_links(ids: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], component: np.ndarray, probe: np.ndarray, index: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the components of the sets, between probe and index sets; enough of them, not all.

    Shingles are ordered by how many of the sets hold them, most first: so near copies share long paths.
    """
    lengths = np.array([len(s) for s in sets])
    shingle, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.empty(len(shingle), np.int64)
    order[np.lexsort((shingle, -count))] = np.arange(len(shingle))
    ranks = np.split(order[which], np.cumsum(lengths)[:-1])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    same = lambda a, b: find(int(component[a])) == find(int(component[b]))
    tree, out = Tree(len(shingle)), []
    todo = np.lexsort((sizes, ~index, probe & ~index))
    for i in todo.tolist():
        own = np.sort(ranks[i])
        if probe[i]:
            for other in tree.links(own, int(sizes[i]), i, same):
                out.append((int(ids[i]), int(ids[other])))
                root[find(int(component[i]))] = find(int(component[other]))
        if index[i]:
            tree.insert(own, int(sizes[i]), i, same)
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each value of the first column, which must come one after the other, together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        if held and held[-1].column(0)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            held.append(batch.slice(a, b - a))
            if b < len(keys):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _tree_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each group (group, id, n, shingles, component, probe, index)."""
    for group in _groups(batches):
        if group.num_rows < 2:
            continue
        lists = group.column(3)
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        flat = lists.flatten().to_numpy()
        component = np.unique(group.column(4).to_numpy(), return_inverse=True)[1]
        flags = (group.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (5, 6))
        found = tree_links(group.column(1).to_numpy(), group.column(2).to_numpy(), [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], component, *flags)
        if found:
            u, v = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _join_groups(members: DataFrame) -> DataFrame:
    rows = members.select("group", "id", "n", "shingles", "component", "probe", "index").repartition("group").sortWithinPartitions("group")
    return rows.mapInArrow(_tree_join, "u long, v long")


def _with_components(members: DataFrame, links: DataFrame) -> tuple[DataFrame, str]:
    parts, path = connected(links)
    return members.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")), path


def link_families(sets: DataFrame, families: DataFrame) -> DataFrame:
    """Links (u, v) that join all linked sets of each family; sets (id, n, shingles), families (id, family).

    A family of TREE_SETS at most is one tree. Larger ones are cut into blocks by hash, in a few rounds with other hashes, which
    leaves few components; then the sets outside a family's largest component meet all its sets, block by block, so that
    every pair of sets of different components has been compared.
    """
    count = families.groupBy("family").count().withColumn("blocks", F.ceil(F.col("count") / TREE_SETS).cast("int"))
    members = sets.join(families.join(count, "family"), "id")
    both = {"probe": F.lit(True), "index": F.lit(True)}

    def blocks(rows: DataFrame, seed: int) -> DataFrame:
        return rows.withColumn("group", F.xxhash64("family", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("blocks")))).withColumns(both)

    links, _ = written(_join_groups(blocks(members.withColumn("component", F.col("id")), 0)), "links")
    large = members.where("blocks > 1")
    if count.where("blocks > 1").isEmpty():
        return links
    for seed in (1, 2):
        now, _ = _with_components(large, links)
        links, _ = written(links.unionAll(_join_groups(blocks(now, seed))), "links")
    now, _ = written(_with_components(large, links)[0], "members")
    parts = now.groupBy("family", "component").count().groupBy("family").agg(F.max_by("component", F.struct("count", "component")).alias("largest"), F.sum("count").alias("all"), F.max("count").alias("most"))
    parts = parts.where("all > most").withColumn("probes", F.ceil((F.col("all") - F.col("most")) / TREE_SETS).cast("int")).drop("all", "most")
    now = now.join(parts, "family")
    i, j = F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")), F.pmod(F.xxhash64("id", F.lit(4)), F.col("probes"))
    side = lambda rows, a, b, probe: rows.withColumns({"i": a, "j": b}).withColumn("group", F.xxhash64("family", F.col("i").cast("long"), F.col("j").cast("long"))).withColumns({"probe": F.lit(probe), "index": F.lit(not probe)})
    index = side(now, i, F.explode(F.sequence(F.lit(0), F.col("probes") - 1)), False)
    probe = side(now.where("component <> largest"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), j, True)
    return links.unionAll(_join_groups(index.unionByName(probe)))


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id of every document: the least key among all that links reach from it.

    1. Equal sets become one. Of each set the shingles that come first in a fixed order are counted over all sets; a set with too
       few shared ones links to nothing. That drops most.
    2. The shingles of the rest, all of them, are counted over these sets; the same bound drops more. Ordered from the rarest
       on, two sets that link share one of the first few: such sets form a family.
    3. Each family's sets stand in prefix trees, which find links between different components (tree_links).
    4. Links become components, and components go back to all documents by set.
    Nothing is capped: common shingles are settled where they are gathered, and no pairs are listed. Null and empty texts have no
    set and stay alone, as do rows with a null key (component_id null). Documents of fewer than WORDS words are one shingle.
    Repeated rows get the same component. Other columns are not read.
    """
    spark = docs.sparkSession
    buckets = _BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))

    def deal(own: DataFrame, more: int | None) -> DataFrame:
        return own.mapInArrow(_deal(buckets, more), _DEALT).repartition("bucket").sortWithinPartitions("bucket")

    first, _ = written(deal(rows, MORE).mapInArrow(_first_pass, "key long, n long, id long, shared long"), "jaccard-first")
    documents = first.where("shared is null").select("key", "n", "id")
    kept = first.where("shared is not null").groupBy("id", "n").agg(F.sum("shared").alias("shared"))
    least = F.floor((OVER * F.col("n") + UNDER - 1) / UNDER)
    kept = kept.where(F.col("shared") >= F.least(least, F.floor((least + MORE - 1) / MORE)))
    leasts = documents.where("n > 0 and key is not null").groupBy("id").agg(F.min("key").alias("least"))  # before any join by id: copies are added up where they lie
    asked, asked_at = written(leasts.join(kept.select("id"), "id").select(F.col("least").alias("key")).distinct(), "jaccard-keys")
    small = asked.count() <= _BROADCAST
    again = deal(rows.join(F.broadcast(asked) if small else asked, "key", "left_semi"), None).mapInArrow(_second_pass, "id long, n long, shingle long, sets int")
    full = again.groupBy("id", "n").agg(F.array_sort(F.collect_set(F.struct("sets", "shingle"))).alias("s")).where(F.size("s") >= least)
    sets, sets_at = written(full.select("id", "n", F.transform("s", lambda x: x["shingle"]).alias("shingles")), "jaccard-sets")
    rare = sets.select("id", F.explode(F.slice("shingles", 1, (F.size("shingles") - least + 1).cast("int"))).alias("shingle"))
    hubs = rare.groupBy("shingle").agg(F.min("id").alias("hub"))
    families, families_at = connected(rare.join(hubs, "shingle").where("id <> hub").select(F.col("id").alias("u"), F.col("hub").alias("v")).distinct())
    links, links_at = written(link_families(sets, families.select(F.col("node").alias("id"), F.col("component").alias("family"))), "jaccard-links")
    parts, _ = connected(links)
    drop(spark, asked_at, sets_at, families_at, links_at)
    classes = leasts.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    labels = classes.select("id", "component").join(classes.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("id", "component_id")
    alone = documents.where("n = 0 or key is null").withColumn("component_id", F.col("key"))
    linked = documents.where("n > 0 and key is not null").join(labels, "id").select("key", "n", "id", "component_id")
    return linked.unionByName(alone).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def one_of_each_group(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents, with their own columns, without those whose component has a smaller key. Rows with a null key stay."""
    others = similar_groups(docs, key).where(F.col(key) != F.col("component_id")).select(key).distinct()
    return docs.join(others, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))

"""Links between similar items from banded signatures, and connected components, without driver-side state.

Items are named by 64-bit integers (content hashes), so exact copies are one item. A task first meets its own items
that share a band key: all but the least of them are linked to the least, which alone goes on to the shuffle. So a
key that a third of all rows share reaches the shuffle once for each task, and all keys cross it packed. Candidate pairs are stars around the
least item of a key; they are verified, and joined to components.

A star can miss links between two members that are both unlike its centre. They are sought in what is left, keys
whose members are still in different components:

1. keys of more than ``BLOCK`` members get further stars, around members drawn by a hash, until few are found. A large
   group of near copies is joined by these, at a cost in proportion to its size;
2. where very many are still outside a key's largest component, members are keyed anew by features: of two sets of
   similarity t, the 1 - t rarest features of each hold one of the other's, so members that share a band but no rare
   feature don't meet. A large group of texts that only share a common passage falls apart here;
3. the members of each key are compared inside tasks, in blocks bounded by number and by characters. Members of the
   largest component of a key aren't compared with each other.

Nothing is dropped in any step, so the components are those that all pairs of every key would give, and no list of
the pairs of a group is ever made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import bounded_batches, cut, release
from .textkernel import chunks, give_back, mix, spread, text_chunks

#: Band keys that a task holds before it combines them; members and characters of a key that are compared in one block.
HELD_KEYS, BLOCK, BLOCK_CHARS = 1_000_000, 256, 1_000_000
#: Further stars of a large key at most; they end when fewer than this share of their pairs are links.
STARS, WORTHWHILE = 2, 0.1
#: Blocks of members outside the main component beyond which a key is told apart by rare features: fewer are compared as
#: they are, since a text has some dozens of rare features to be sent by.
REFINE = 16
#: Links that a task joins by itself, and members of a group up to which its pairs are compared one by one.
EDGES, FEW = 50_000, 12
#: Slots of the counts by which features are put in order of rarity: a table of fixed size.
SLOTS = 1 << 18

#: Texts to distinct features: (feature, text), so that the Jaccard similarity of two texts is that of their features.
Features = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def local_stars(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, a, b, and whether b is there: (key, least, -) for each key, (key, least, other) for its other items."""
    order = np.lexsort((nodes, keys))
    key, node = keys[order], nodes[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    new = first.copy()
    new[1:] |= node[1:] != node[:-1]
    least = node[np.flatnonzero(first)][np.cumsum(first) - 1] if len(key) else node
    return key[new], least[new], node[new], ~first[new]


def band_keys(signature: np.ndarray, rows: int, salt: int = 0) -> np.ndarray:
    """One 64-bit key (as signed) for each band of ``rows`` neighbouring signature values."""
    n, k = signature.shape
    bands = k // rows
    odd = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    salts = mix(np.arange(1, bands + 1, dtype=np.uint64) + np.uint64(99 + 1000 * salt))
    return mix((signature[:, : bands * rows].reshape(n, bands, rows) * odd).sum(2, dtype=np.uint64) + salts).view(np.int64)


def stars(items: DataFrame) -> DataFrame:
    """key, a, b: the items (node, keys array<long>) that share a key, linked to a least one.

    Keys cross the shuffle packed: a row for each task and bucket of keys, of which there are so many that one bucket is
    some ``HELD_KEYS`` keys. Buckets stand one after another in a task, which holds one at a time.
    """
    buckets = 1 + items.count() * 16 // HELD_KEYS

    def bucket_of(x: np.ndarray) -> np.ndarray:
        return (mix(x.view(np.uint64) ^ np.uint64(0x5B)) % np.uint64(buckets)).astype(np.int64)

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, held = [], [], 0

        def out() -> pa.RecordBatch:
            key, a, b, linked = local_stars(np.concatenate(keys), np.concatenate(nodes))
            # a link made here needs no partner, so it is spread by its own item
            bucket = bucket_of(np.where(linked, b, key))
            order = np.lexsort((linked, bucket))
            bucket, key, a, b, linked = (x[order] for x in (bucket, key, a, b, linked))
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            ends = np.append(first[1:], len(bucket))
            cells = [(lo, lo + int((~linked[lo:hi]).sum()), hi) for lo, hi in zip(first.tolist(), ends.tolist(), strict=True)]
            packed = [pa.array([x[lo:hi].tobytes() for lo, hi in c], pa.binary()) for x, c in ((key, [(lo, hi) for lo, _, hi in cells]), (a, [(lo, hi) for lo, _, hi in cells]), (b, [(mid, hi) for _, mid, hi in cells]))]
            return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), *packed], ["bucket", "key", "a", "b"])

        for batch in batches:
            column = batch.column("keys")
            keys.append(column.flatten().to_numpy(zero_copy_only=False))
            nodes.append(np.repeat(batch.column("node").to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)))
            held += len(keys[-1])
            if held > HELD_KEYS:
                yield out()
                keys, nodes, held = [], [], 0
        if held:
            yield out()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[bytes]] = {"key": [], "a": [], "b": []}
        at = None

        def out() -> pa.RecordBatch:
            many = [len(x) // 8 - len(y) // 8 for x, y in zip(waiting["key"], waiting["b"], strict=True)]
            key, a = ([np.frombuffer(x, np.int64) for x in waiting[c]] for c in ("key", "a"))
            linked = [np.concatenate([np.zeros(0, np.int64), *[x[n:] for x, n in zip(part, many, strict=True)]]) for part in (key, a)]
            alone, least = (np.concatenate([x[:n] for x, n in zip(part, many, strict=True)]) for part in (key, a))
            order = np.lexsort((least, alone))
            alone, least = alone[order], least[order]
            new = np.append(True, alone[1:] != alone[:-1])[: len(alone)]
            centre = least[np.flatnonzero(new)][np.cumsum(new) - 1] if len(alone) else least
            meets = least != centre
            b = np.concatenate([least[meets], *[np.frombuffer(x, np.int64) for x in waiting["b"]]])
            for x in waiting.values():
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.append(alone[meets], linked[0])), pa.array(np.append(centre[meets], linked[1])), pa.array(b)], ["key", "a", "b"])

        for batch in batches:
            for i, bucket in enumerate(batch.column("bucket").to_pylist()):
                if bucket != at and waiting["key"]:
                    yield out()
                at = bucket
                for c, x in waiting.items():
                    x.append(batch.column(c)[i].as_py())
        if waiting["key"]:
            yield out()

    rows = items.where("node is not null and size(keys) > 0").select("node", "keys").mapInArrow(combined, "bucket int, key binary, a binary, b binary")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(met, "key long, a long, b long")


def _by_centre(met: DataFrame) -> DataFrame:
    """``met`` (key, a, b) with keys of the same least item as one key, named by it.

    The bands of a large group of near copies give many keys with nearly the same members, which then are one. An item
    has a few keys, so a key made so is of as few, and none of their pairs is missing in it.
    """
    met = cut(met)
    # written out, so that the join stands right on its shuffles and Spark can split the rows of a frequent key
    centres = cut(met.groupBy(F.col("key").alias("of")).agg(F.min("a").alias("centre")))
    return met.join(centres, F.col("key") == F.col("of")).select(F.col("centre").alias("key"), "a", "b").distinct()


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some links with the least node they are connected to by these; roots are left out."""
    node, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = place[: len(a)], place[len(a) :]
    root = np.arange(len(node))
    while True:
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        after = root.copy()
        np.minimum.at(after, high, low)
        while (after[after] != after).any():
            after = after[after]
        if (after == root).all():
            break
        root = after
    some = root != np.arange(len(node))
    return node[some], node[root[some]]


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (the least node it is connected to) for every node of ``links`` (a, b), written out.

    Tasks first join some ``EDGES`` links each, which leaves stars. What they have in common is joined by alternating
    large-star and small-star steps, until every edge leads to a least node. Least neighbours are written out before
    they are joined, so that the join stands right on its shuffles and Spark can split the edges of a hub.
    """
    # written out first: coalesce would run whatever makes the links in as few tasks as it leaves
    links = cut(links.where("a <> b").select("a", "b"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for held, name in ((a, "a"), (b, "b")):
                held.append(batch.column(name).to_numpy(zero_copy_only=False))
            if sum(map(len, a)) > 2 * EDGES:  # what is joined is at most one link a node
                u, v = local_roots(np.concatenate(a), np.concatenate(b))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                a, b = [], []
        if a:
            u, v = local_roots(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    edges = cut(links.coalesce(1 + links.count() // EDGES).mapInArrow(joined, "u long, v long").distinct())
    release(links)
    while not _settled(edges):
        both = edges.union(edges.select("v", "u"))
        least = cut(both.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("low")).withColumn("low", F.least("at", "low")))
        large = both.join(least, F.col("u") == F.col("at")).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("low"))
        rest = large.join(low, F.col("u") == F.col("at")).where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        after = cut(rest.union(low).distinct())
        release(edges, least)
        edges = after
    found = cut(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct()))
    release(edges)
    return found


def _settled(edges: DataFrame) -> bool:
    """Does every node have one edge up, or none? Then the edges are stars around least nodes."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1").isEmpty()


def similar_components(items: DataFrame, texts: Callable[[DataFrame], DataFrame], features: Features, threshold: float) -> DataFrame:
    """node, component over the items (node, keys) that share a key and whose similarity is ``threshold`` or more.

    ``texts`` gives (node, text), one row each, for a table of nodes. Items that share no key are left out; others that
    are like no item have themselves as component.
    """
    with bounded_batches(items.sparkSession, 2000):
        met = cut(_by_centre(stars(items)))
        members = cut(met.select("key", F.col("a").alias("node")).union(met.select("key", "b")).distinct())
        nodes = members.select("node").distinct()
        held = cut(texts(nodes))
        links = cut(alike(met.select("a", "b").distinct(), held, features, threshold))
        found = connected_components(links)
        labels = cut(nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
        # a key is mixed if a pair of its stars is: what the links join needs no look
        of = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
        unlike = met.join(links, ["a", "b"], "left_anti").join(of("a"), "a").join(of("b"), "b").where("ca <> cb")
        mixed = _mixed(members.join(cut(unlike.select("key").distinct()), "key"), labels)
        release(met, members, links, found)
        for salt in range(STARS):
            large = mixed.where(F.col("n") > BLOCK)
            if large.isEmpty():
                break
            centre = F.min_by(F.struct("node", "component"), F.xxhash64("node", F.lit(salt)))
            centres = cut(large.groupBy(F.col("key").alias("of")).agg(centre.alias("c")))
            pairs = large.join(centres, F.col("key") == F.col("of")).where("component <> c.component")
            asked = cut(pairs.select(F.col("c.node").alias("a"), F.col("node").alias("b")).distinct())
            links = cut(alike(asked, held, features, threshold))
            labels, before = _merged(labels, links), labels
            mixed, left = _mixed(mixed.select("key", "node"), labels), mixed
            few = links.count() < WORTHWHILE * asked.count()
            release(centres, asked, links, before, left)
            if few:
                break
        many = F.col("n") - F.col("n_main") > REFINE * BLOCK
        more = cut(alike_across(mixed.where(~many), held, features, threshold))
        if not mixed.where(many).isEmpty():
            large = cut(mixed.where(many).select("node").distinct())
            refined = cut(rare_features(large.join(held, "node"), features, threshold))
            # no star has compared the members of these keys, so those of two count too
            more = more.union(cut(alike_across(_mixed(refined, labels, 2), held, features, threshold)))
        out = _merged(labels, more)
        release(held, labels, mixed)
        return out


def _mixed(members: DataFrame, labels: DataFrame, least: int = 3) -> DataFrame:
    """key, node, component, n, main and n_main of the members (key, node) of every key with more than one component.

    n is the number of members, ``least`` or more, main the component of most of them (of equal ones the least), n_main
    their number. Where a star has compared a key's members, two need no more; keys with the same members are taken once.
    """
    grouped = cut(members.join(labels, "node"))
    by = grouped.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"))
    keys = by.groupBy("key").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"), F.bit_xor("x").alias("x"), F.min(F.struct((-F.col("n")).alias("n"), "component")).alias("most")
    )
    keys = keys.where(f"parts > 1 and n >= {least}").groupBy("n", "x", "parts", "most").agg(F.min("key").alias("key"))
    keys = cut(keys.select("key", "n", F.col("most.component").alias("main"), (-F.col("most.n")).alias("n_main")))
    mixed = cut(grouped.join(keys, "key").select("key", "node", "component", "n", "main", "n_main"))
    release(grouped, keys)
    return mixed


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) after ``links`` (a, b): only components, not their members, are joined anew."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    between = links.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    above = connected_components(between).toDF("of", "top")
    return cut(labels.join(above, F.col("component") == F.col("of"), "left").select("node", F.coalesce("top", "component").alias("component")))


def alike(pairs: DataFrame, held: DataFrame, features: Features, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts in ``held`` (node, text) have a similarity of ``threshold`` or more."""
    of = lambda x: held.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [np.zeros(0, bool)]
            for part in slices(batch, "text_a", "text_b"):
                node = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in "ab"], 1).ravel()
                text = [t or "" for ab in zip(part.column("text_a").to_pylist(), part.column("text_b").to_pylist(), strict=True) for t in ab]
                # a text that stands in several pairs is read once
                _, first, place = np.unique(node, return_index=True, return_inverse=True)
                feature, of_text = all_features([text[i] for i in first.tolist()], features)
                ends = np.searchsorted(of_text, np.arange(len(first) + 1))
                at, side = spread(ends[place], (ends[1:] - ends[:-1])[place])
                good.append(pair_jaccard(feature[at], side, part.num_rows) >= threshold)
            yield batch.select(["a", "b"]).filter(pa.array(np.concatenate(good)))
        give_back()

    rows = pairs.join(of("b"), "b").join(of("a"), "a")
    return rows.select("a", "b", "text_a", "text_b").mapInArrow(kept, "a long, b long")


def slices(batch: pa.RecordBatch, *texts: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of some ``BLOCK_CHARS`` bytes of text, or of one row that has more."""
    size = sum(pc.fill_null(pc.binary_length(batch.column(t)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for t in texts)
    at = np.cumsum(size) // BLOCK_CHARS
    ends = np.append(np.flatnonzero(at[1:] != at[:-1]) + 1, batch.num_rows)
    for lo, hi in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def all_features(texts: list[str], features: Features) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) of all texts, taken a chunk at a time."""
    found = [(f, t + at) for at, part in chunks(texts) for f, t in [features(part)]]
    feature, text = (np.concatenate(x) for x in zip((np.zeros(0, np.uint64), np.zeros(0, np.int64)), *found, strict=True))
    return feature, text


def pair_jaccard(feature: np.ndarray, text: np.ndarray, pairs: int) -> np.ndarray:
    """Jaccard similarity of texts 0 and 1, 2 and 3, and so on; 0 if both are empty."""
    size = np.bincount(text, minlength=2 * pairs)
    key = np.sort((text.astype(np.uint64) >> np.uint64(1) << np.uint64(48)) | (mix(feature) >> np.uint64(16)))
    both = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(48)).astype(np.int64), minlength=pairs)
    either = size[0::2] + size[1::2] - both
    return np.divide(both, either, out=np.zeros(pairs), where=either > 0)


def rare_features(rows: DataFrame, features: Features, threshold: float) -> DataFrame:
    """key, node: the rarest features of each text of ``rows`` (node, text), by which two alike texts must meet.

    Of n features the n - ceil(threshold * n) + 1 first are taken, in one order for all texts: by the count of their
    slot, then by hash. The counts are of a fixed number of slots, summed by Spark.
    """

    def slot(feature: np.ndarray) -> np.ndarray:
        return (mix(feature ^ np.uint64(0x510)) % np.uint64(SLOTS)).astype(np.int64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, part in text_chunks(batch.column("text")):
                total += np.bincount(slot(features(part)[0]), minlength=SLOTS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["slot", "n"])

    counts = np.zeros(SLOTS, np.int64)
    for r in rows.select("text").mapInArrow(counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        counts[r["slot"]] = r["n"]
    sent = rows.sparkSession.sparkContext.broadcast(counts)  # SLOTS numbers, whatever the input

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy(zero_copy_only=False)
            for at, part in text_chunks(batch.column("text")):
                feature, text = features(part)
                order = np.lexsort((feature, sent.value[slot(feature)], text))
                feature, text = feature[order], text[order]
                n = np.bincount(text, minlength=len(part))
                place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
                head = place < (n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1)[text]
                yield pa.RecordBatch.from_arrays([pa.array(feature[head].view(np.int64)), pa.array(node[text[head] + at])], ["key", "node"])

    return rows.select("node", "text").mapInArrow(rarest, "key long, node long")


def alike_across(mixed: DataFrame, held: DataFrame, features: Features, threshold: float) -> DataFrame:
    """Links (a, b) between members of a key that are alike and in different components, of all keys of ``mixed`` (see _mixed).

    The members of the main component are dealt to blocks of their own, which meet only the blocks of the others.
    """
    sized = mixed.join(held.select("node", F.length("text").alias("chars")), "node")
    sized = cut(sized.select("key", "node", "component", "chars", (F.col("component") == F.col("main")).alias("is_main")))
    per = lambda mine, x, most: F.sum(F.when(mine, x).otherwise(0)) / most
    many = lambda mine: F.ceil(F.greatest(per(mine, F.lit(1), BLOCK), per(mine, F.col("chars"), BLOCK_CHARS), F.lit(1.0))).cast("int")
    blocks = cut(sized.groupBy(F.col("key").alias("of")).agg(many(~F.col("is_main")).alias("rest"), many(F.col("is_main")).alias("of_main")))
    rows = sized.join(blocks, F.col("key") == F.col("of"))
    draw = lambda n: F.pmod(F.xxhash64("node", F.lit(3)), n).cast("int")
    rows = rows.withColumn("mine", F.when(F.col("is_main"), F.col("rest") + draw(F.col("of_main"))).otherwise(draw(F.col("rest"))))
    last = F.when(F.col("is_main"), F.col("rest") - 1).otherwise(F.col("rest") + F.col("of_main") - 1)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "component").join(held, "node")
    # groups stand one after another in a task, so that many small ones are read together
    rows = rows.select("key", "i", "j", "node", "component", "text").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    group = ["key", "i", "j"]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, chars, limit = [], 0, BLOCK_CHARS
        for batch in batches:
            for part in slices(batch, "text"):
                part = part.to_pandas()
                waiting.append(part)
                chars += int(part["text"].str.len().sum())
                if chars > limit:  # all but the last group are whole
                    part = pd.concat(waiting, ignore_index=True)
                    last = (part[group] == part[group].iloc[-1]).all(axis=1)
                    if not last.all():
                        yield links_of(part[~last], features, threshold)
                    waiting = [part[last]]
                    chars = int(waiting[0]["text"].str.len().sum())
                    limit = chars + BLOCK_CHARS
        if waiting:
            yield links_of(pd.concat(waiting, ignore_index=True), features, threshold)

    return rows.mapInArrow(compared, "a long, b long")


def links_of(rows: pd.DataFrame, features: Features, threshold: float) -> pa.RecordBatch:
    """Links (a, b) inside each of the groups (key, i, j) that stand one after another in ``rows``."""
    rows = rows.drop_duplicates(["key", "i", "j", "node"])
    texts = rows.drop_duplicates("node")
    feature, text = all_features(texts["text"].tolist(), features)
    ends = np.searchsorted(text, np.arange(len(texts) + 1))
    place = pd.Index(texts["node"]).get_indexer(rows["node"])
    group = rows.groupby(["key", "i", "j"], sort=False).ngroup().to_numpy()
    cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    node, component, links = rows["node"].to_numpy(np.int64), rows["component"].to_numpy(np.int64), [np.zeros((2, 0), np.int64)]
    ends_of = np.append(cuts[1:], len(rows))[: len(cuts)]
    few = (ends_of - cuts) <= FEW
    a, b = _pairs_inside(cuts[few], (ends_of - cuts)[few])
    across = component[a] != component[b]
    pair = np.unique(np.sort(np.stack([place[a[across]], place[b[across]]]), axis=0), axis=1)
    good = alike_places(pair, feature, ends, threshold)
    name = texts["node"].to_numpy(np.int64)
    links.append(name[pair[:, good]])
    for lo, hi in zip(cuts[~few].tolist(), ends_of[~few].tolist(), strict=True):
        mine, of = place[lo:hi], component[lo:hi]
        if (of != of[0]).any():
            at, whose = spread(ends[mine], ends[mine + 1] - ends[mine])
            a, b = across_pairs(feature[at], whose, of, threshold)
            links.append(np.stack([node[lo:hi][a], node[lo:hi][b]]))
    both = np.unique(np.sort(np.concatenate(links, axis=1), axis=0), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])


def _pairs_inside(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places inside runs [start, start + size), which are short."""
    at, run = spread(starts, sizes)
    more = (starts + sizes)[run] - at - 1
    b, of = spread(at + 1, more)
    return at[of], b


def alike_places(pair: np.ndarray, feature: np.ndarray, ends: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs (2 x n places of texts, whose features are between ``ends``) are alike, some hundred thousand features at a time."""
    size = ends[pair + 1] - ends[pair]
    good = (size.min(0) > 0) & (size.min(0) >= threshold * size.max(0))  # else too unlike in size
    some = np.flatnonzero(good)
    for part in np.split(some, np.flatnonzero(np.diff(np.cumsum(size[:, some].sum(0)) // 400_000 + np.arange(len(some)) // 50_000)) + 1):
        at, side = spread(ends[pair[:, part].T.ravel()], size[:, part].T.ravel())
        good[part] = pair_jaccard(feature[at], side, len(part)) >= threshold
    return good


def across_pairs(feature: np.ndarray, text: np.ndarray, component: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of texts that are alike and of different components, by sparse products of shared features.

    Texts are given as (feature, text). One link between two components is enough, so each component pair that is
    found gives one.
    """
    n = len(component)
    size = np.bincount(text, minlength=n).astype(np.float32)
    _, inverse, count = np.unique(feature, return_inverse=True, return_counts=True)
    shared = count > 1
    place = (np.cumsum(shared) - 1)[inverse]
    keep = shared[inverse]
    place, text = place[keep], text[keep]
    both, width = np.zeros((n, n), np.float32), min(4096, max(1, int(shared.sum())))
    order = np.argsort(place, kind="stable")
    place, text = place[order], text[order]
    for lo in range(0, int(shared.sum()), width):
        at = slice(*np.searchsorted(place, [lo, lo + width]))
        has = np.zeros((n, width), np.float32)
        has[text[at], place[at] - lo] = 1
        both += has @ has.T
    either = size[:, None] + size[None, :] - both
    good = (both >= threshold * either - 1e-4) & (both > 0) & (component[:, None] != component[None, :])
    a, b = np.nonzero(np.triu(good, 1))
    exact = both[a, b].astype(np.float64) / either[a, b].astype(np.float64) >= threshold
    a, b = a[exact], b[exact]
    if len(a):
        pair = np.stack([np.minimum(component[a], component[b]), np.maximum(component[a], component[b])], 1)
        one = np.unique(pair, axis=0, return_index=True)[1]
        a, b = a[one], b[one]
    return a, b

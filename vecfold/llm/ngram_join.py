"""N-gram Jaccard join by prefixes of shingles and of shingle combinations.

A document's set holds its distinct shingles of ``width`` words (fewer words: the whole sequence as
one; none: an empty set, linked with nothing). Two documents link when ``100 * intersection >=
percent * union``.

1. Equal sets are one vertex. The shingles of a set are ordered by their 64-bit hash.
2. A partner shares all but ``errors(n)`` of a set's n shingles, so two partners share at least
   ``1 + spare`` shingles of their prefixes when a prefix has ``errors(n) + 1 + spare(n)`` of them.
   Sets whose prefix holds fewer shingles that occur elsewhere have no partner.
3. A prefix shingle that is in at most RARE prefixes is indexed by itself. If all shared ones are
   frequent, two of them fall into one of ``spare`` blocks of hash values, so frequent shingles are
   indexed as pairs within a block, and only for sets that have more than ``spare`` of them.
4. Sets with a signature in common are compared with hubs of its bucket: one in the first turn, then
   some that grow in number, in blocks where they are many. Members of the hub's component are passed over, hubs retire, buckets
   within one component close, and members whose shingles do not occur often enough in other
   components leave. So a group of near copies takes one comparison per member, not all pairs, and
   no link between components is lost. Comparisons count the whole sets' common shingles exactly.

Nulls: a null text has no words; a null doc_id never is a component's id unless no member has one.
Rows that repeat an id are separate rows with the same id. Extra columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecfold.llm import batches
from vecfold.llm.components import components
from vecfold.llm.tables import row_key, stored, within, without_rows

RARE = 16
# Hubs of a bucket in the second turn; each later turn has twice as many.
FIRST_HUBS = 64
# Shingles of the members of one block.
BLOCK_TOKENS = 500_000
# Buckets of more members with the same least vertex become one bucket, whose pairs hold all of theirs.
MERGED = 64


def errors(n: int, percent: int) -> int:
    """Shingles of n that a partner may lack."""
    return n - -(-percent * n // 100)


def spare(n: int, percent: int) -> int:
    """Prefix shingles beyond the necessary one; grows with n."""
    lacking = errors(n, percent)
    return max(lacking // 2, min(n - lacking - 1, 4)) if n else 0


def least_partner(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def text_sets(batch_iter, width: int, percent: int | None):
    """Record batches with the set of each text: whole (percent None) or its prefix."""
    for batch in batch_iter:
        keep = [name for name in batch.schema.names if name != "text"]
        for first, end, data, offsets in batches.text_slices(batch.column("text")):
            data = batches.LOWER[data]
            starts, ends, _, counts = batches.words_of(data, offsets)
            hashes = batches.apart_hashes(data, starts, ends)
            shingles = batches.shingle_hashes(hashes, width)
            last = np.cumsum(counts)
            sizes, high, low, parts = [], [], [], []
            for n_words, stop in zip(counts.tolist(), last.tolist()):
                at = stop - n_words
                if n_words >= width:
                    values = np.unique(shingles[at : stop - width + 1])
                elif n_words:
                    values = batches.shingle_hashes(hashes[at:stop], n_words)
                else:
                    values = np.zeros(0, np.uint64)
                n = len(values)
                sizes.append(n)
                high.append(np.bitwise_xor.reduce(batches.mix(values)) if n else np.uint64(0))
                low.append(batches.mix(values * np.uint64(batches.BASE) + np.uint64(n)).sum(dtype=np.uint64) if n else np.uint64(0))
                parts.append(values if percent is None else values[: errors(n, percent) + 1 + spare(n, percent)])
            whole = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
            columns = [batch.column(name).slice(first, end - first) for name in keep]
            columns += [pa.array(sizes, pa.int64()), pa.array(np.array(high, np.uint64).view(np.int64)), pa.array(np.array(low, np.uint64).view(np.int64))]
            columns.append(batches.lists(pa.array(whole), np.array([len(p) for p in parts], np.int64)))
            yield pa.RecordBatch.from_arrays(columns, [*keep, "n_shingles", "set_high", "set_low", "shingles"])


def shingle_sets(docs: DataFrame, width: int, percent: int | None, *more: Column) -> DataFrame:
    """doc_id, ``more``, n_shingles, 128 bits that stand for the set, and its shingles or their prefix."""
    rows = docs.select("doc_id", "text", *more)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(
        lambda batch_iter: text_sets(batch_iter, width, percent),
        f"{kinds}, n_shingles long, set_high long, set_low long, shingles array<long>",
    )


def _signatures(frames: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out_v, out_n, out_s = [], [], []
        for vertex, n, tokens, counts in zip(frame["vertex"], frame["n"], frame["tokens"], frame["counts"]):
            shared = spare(least_partner(n, percent), percent)
            tokens, counts = np.asarray(tokens, np.int64).view(np.uint64), np.asarray(counts)
            if len(tokens) < 1 + shared:
                continue
            # With no spare shingle one shared token may be all, so every one is its own signature.
            rare = counts <= RARE if shared else np.ones(len(counts), bool)
            found = [tokens[rare]]
            frequent = tokens[~rare]
            if len(frequent) > shared:
                # Partners differ in size, and the number of blocks is the same power of two for both.
                for bits in {shared.bit_length() - 1, spare(n, percent).bit_length() - 1}:
                    block = batches.mix(frequent) & np.uint64((1 << bits) - 1)
                    order = np.lexsort((frequent, block))
                    block, sorted_tokens = block[order], frequent[order]
                    for step in range(1, len(block)):
                        same = np.flatnonzero(block[step:] == block[:-step])
                        if not len(same):
                            break
                        pair = sorted_tokens[same] * np.uint64(batches.BASE) + batches.mix(sorted_tokens[same + step])
                        found.append(batches.mix(pair + np.uint64(bits)))
            signatures = np.concatenate(found).view(np.int64)
            out_s.append(signatures)
            out_v.append(np.full(len(signatures), vertex, np.int64))
            out_n.append(np.full(len(signatures), n, np.int64))
        if out_s:
            yield pd.DataFrame({"signature": np.concatenate(out_s), "vertex": np.concatenate(out_v), "n": np.concatenate(out_n)})


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose whole sets are similar enough."""
    of = lambda name: sets.select(F.col("vertex").alias(name), F.col("shingles").alias(f"set_{name}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a")
    common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    union = F.size("set_a").cast("long") + F.size("set_b") - common
    return both.where(100 * common >= percent * union).drop("set_a", "set_b")


def _can_link(common, n, other_n, percent: int):
    """Whether sets of n and other_n shingles can be similar with at most ``common`` in common."""
    return (100 * n >= percent * other_n) & (100 * other_n >= percent * n) & ((100 + percent) * common >= percent * (n + other_n))


def _compare_block(members: pd.DataFrame, hubs: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (root_a, root_b) between a part of a bucket's members and its hubs."""
    found = []
    if len(members) and len(hubs):
        sizes = members["n"].to_numpy()
        tokens, place = np.unique(np.concatenate(members["shingles"].to_list()), return_inverse=True)
        row = np.repeat(np.arange(len(members)), [len(s) for s in members["shingles"]])
        vertex, root, most, is_hub = (members[c].to_numpy() for c in ("vertex", "root", "common", "is_hub"))
        for hub in hubs.rename(columns=lambda c: c.removeprefix("hub_")).itertuples():
            possible = (root != hub.root) & (~is_hub | (vertex > hub.vertex))
            possible &= (100 + percent) * np.minimum(most, hub.common) >= percent * (sizes + hub.n)
            if possible.any():
                own = np.zeros(len(tokens) + 1, np.int64)
                at = np.searchsorted(tokens, hub.shingles)
                own[at[np.append(tokens, tokens[-1])[at] == hub.shingles]] = 1
                common = np.bincount(row, own[place], len(members)).astype(np.int64)
                linked = possible & (100 * common >= percent * (sizes + hub.n - common))
                found += [(hub.root, other) for other in np.unique(root[linked]).tolist()]
    return pd.DataFrame(found, columns=["root_a", "root_b"], dtype="int64")


def _block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of buckets with many hubs, compared in parts of bounded size; only links leave a task."""
    whole = members.join(sets, "vertex").select("signature", "vertex", "n", "root", "common", "is_hub", "parts", "shingles")
    left = whole.withColumn("part", F.pmod(F.xxhash64("vertex"), F.col("parts")))
    right = whole.where("is_hub").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    # Names of their own: both sides come from one frame.
    right = right.select(*[F.col(c).alias(f"hub_{c}") for c in right.columns])
    pairs = left.groupBy("signature", "part").cogroup(right.groupBy("hub_signature", "hub_part"))
    return pairs.applyInPandas(lambda a, b: _compare_block(a, b, percent), "root_a long, root_b long")


def _with_partners(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members that may still have a partner in another component, with ``common``.

    That is how many of a set's shingles occur in other components: no partner shares more, and one
    shares at least ``percent`` of them.
    """
    left = members.select("vertex", "root").distinct()
    tokens = sets.join(left, "vertex").select("vertex", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    across = tokens.groupBy("token").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("token")
    found = tokens.join(across, "token").groupBy("vertex", "n").agg(F.count(F.lit(1)).alias("common"))
    return members.join(found.where(100 * F.col("common") >= percent * F.col("n")).select("vertex", "common"), "vertex")


def _merged(members: DataFrame) -> DataFrame:
    """Large buckets with the same least vertex as one: near copies share many signatures."""
    large = members.groupBy("signature").agg(F.count(F.lit(1)).alias("size"), F.min("vertex").alias("hub")).where(F.col("size") > MERGED)
    renamed = members.join(large.select("signature", (-F.col("hub") - 1).alias("merged")), "signature", "left")
    return renamed.withColumn("signature", F.coalesce("merged", "signature")).drop("merged").distinct()


def _contracted(edges: DataFrame) -> DataFrame:
    """(root, to): each root with an edge and a lesser root of its component, two steps away at most.

    What it leaves apart is only compared again; the components themselves are found at the end.
    """
    both = edges.select(F.col("root_a").alias("root"), F.col("root_b").alias("to")).union(edges.select(F.col("root_b").alias("root"), F.col("root_a").alias("to")))
    least = both.groupBy("root").agg(F.least(F.min("to"), F.col("root")).alias("to"))
    onward = least.select(F.col("root").alias("to"), F.col("to").alias("onward"))
    return least.join(onward, "to").select("root", F.col("onward").alias("to"))


def set_components(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """(vertex, root) of linked vertices; members: signature, vertex, n, root (at first the vertex itself)."""
    links, turn = [], 0
    members = stored(_merged(_with_partners(members, sets, percent)), "members")
    while True:
        by_vertex = [F.bit_xor(F.xxhash64("vertex", F.lit(i))) for i in (1, 2)]
        by_root = members.groupBy("signature", "root").agg(
            F.count(F.lit(1)).alias("of_root"), F.min("vertex").alias("hub"), F.min("n").alias("least_n"), F.sum("n").alias("tokens"), by_vertex[0].alias("who"), by_vertex[1].alias("who2")
        )
        buckets = by_root.groupBy("signature").agg(
            (F.sum("of_root") - F.max("of_root")).alias("others"), F.max_by("root", "of_root").alias("main"), F.min("hub").alias("hub"),
            F.min("least_n").alias("least_n"), F.sum("tokens").alias("tokens"), F.bit_xor("who").alias("who"), F.bit_xor("who2").alias("who2"), F.count(F.lit(1)).alias("roots"),
        ).where("roots > 1")
        # Signatures with the same members need one comparison.
        buckets = buckets.groupBy("hub", "who", "who2").agg(F.min_by(F.struct("signature", "others", "main", "least_n", "tokens"), "signature").alias("one")).select("one.*", "hub")
        # One hub a bucket in the first turn, then so many outside of its largest component that small
        # buckets compare all that is left: when those have retired, one component remains.
        outside = F.pmod(F.xxhash64("vertex", F.lit(turn)), F.col("others")) < (FIRST_HUBS << turn >> 1)
        chosen = (F.col("root") != F.col("main")) & outside if turn else F.lit(False)
        smallest = F.greatest(F.col("least_n"), F.ceil(F.col("n") * percent / 100))
        hopeful = members.join(buckets, "signature").where((100 + percent) * F.col("common") >= percent * (F.col("n") + smallest))
        open_ = stored(hopeful.withColumn("is_hub", chosen | (F.col("vertex") == F.col("hub"))).drop("hub", "main", "least_n"), "buckets")
        if open_.isEmpty():
            break
        # Few hubs: pairs, each compared once for all its buckets. Many: blocks that give out links alone.
        many = (F.col("others") > FIRST_HUBS) if turn else F.lit(False)
        blocks = open_.where(many).withColumn("parts", F.ceil(F.col("tokens") / BLOCK_TOKENS).cast("long")).drop("others", "tokens")
        open_ = open_.drop("tokens")
        of_hub = open_.where(~many & F.col("is_hub")).select("signature", F.col("vertex").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("root_a"), F.col("common").alias("common_a"))
        met = open_.join(of_hub, "signature").where(
            (F.col("root") != F.col("root_a")) & _can_link(F.least("common", "common_a"), F.col("n"), F.col("n_a"), percent) & (~F.col("is_hub") | (F.col("a") < F.col("vertex")))
        )
        pairs = met.select("a", F.col("vertex").alias("b"), "root_a", F.col("root").alias("root_b")).distinct()
        edges = _links(pairs, sets, percent).select("root_a", "root_b")
        edges = stored((edges.union(_block_links(blocks, sets, percent)) if turn else edges).distinct(), "links")
        links.append(edges)
        # Hubs retire, the others take their component's root.
        rest = open_.where("not is_hub").select("signature", "vertex", "n", "root")
        rest = rest.join(_contracted(edges), "root", "left").select("signature", "vertex", "n", F.coalesce("to", "root").alias("root"))
        members = _with_partners(stored(rest, "rest"), sets, percent)
        members = stored(members if turn else _merged(members), "members")
        turn += 1
    if not links:
        return None
    every = links[0]
    for more in links[1:]:
        every = every.union(more)
    return stored(components(every.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))), "roots")


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 85, *more: Column) -> DataFrame:
    """doc_id, ``more``, n_shingles, set_high, set_low and component_id of every row of ``docs``."""
    # Texts are cut twice: once for the narrow table of all rows, once for the prefixes of distinct sets,
    # which takes less than keeping every row's prefix on disk.
    prefixes = shingle_sets(docs, width, percent)
    every = stored(shingle_sets(docs, width, percent, *more).drop("shingles"), "sets")
    grouped = prefixes.where("n_shingles > 0").groupBy("set_high", "set_low")
    vertices = stored(
        grouped.agg(F.min("doc_id").alias("label"), F.first("n_shingles").alias("n"), F.first("shingles").alias("shingles"))
        .withColumn("vertex", F.monotonically_increasing_id()),
        "vertices",
    )
    tokens = vertices.select("vertex", F.explode("shingles").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("prefixes")).where("prefixes > 1")
    shared = tokens.join(counts, "token").groupBy("vertex").agg(
        F.collect_list("token").alias("tokens"), F.collect_list("prefixes").alias("counts")
    )
    sized = shared.join(vertices.select("vertex", "n"), "vertex")
    signatures = stored(
        sized.mapInPandas(lambda frames: _signatures(frames, percent), "signature long, vertex long, n long"), "signatures"
    )
    common = signatures.groupBy("signature").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("signature")
    members = stored(signatures.join(common, "signature").distinct().withColumn("root", F.col("vertex")), "members")
    wanted = stored(members.select("vertex").distinct().join(vertices.select("vertex", "label", "set_high", "set_low"), "vertex"), "wanted")
    wanted_ids = stored(wanted.select(F.col("label").alias("wanted")).distinct(), "wanted-ids")
    texts = within(docs.select("doc_id", "text"), wanted_ids)
    whole = shingle_sets(texts, width, None).select("set_high", "set_low", "shingles").dropDuplicates(["set_high", "set_low"])
    sets = stored(whole.join(wanted, ["set_high", "set_low"]).select("vertex", "shingles"), "whole-sets")
    roots = set_components(members, sets, percent)
    named = vertices.select("vertex", "label", "set_high", "set_low")
    if roots is not None:
        least = named.join(roots, "vertex").groupBy("root").agg(F.min("label").alias("component"))
        named = named.join(roots.join(least, "root").select("vertex", "component"), "vertex", "left")
        named = named.withColumn("label", F.coalesce("component", "label"))
    named = stored(named.select("set_high", "set_low", "label"), "labels")
    return (
        every.join(named, ["set_high", "set_low"], "left")
        .select(*[c for c in every.columns if c not in ("n_shingles", "set_high", "set_low")], "n_shingles", "set_high", "set_low", F.when(F.col("n_shingles") > 0, F.col("label")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def one_of_each(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """``docs`` without near duplicates: the row with its component's id stays, whole and unchanged.

    Each row is judged by its own id and text, also where ids repeat or are null. Rows of a component that
    repeat the id that stays all stay; rows without id stay when their component has no id.
    """
    classes = near_duplicates(docs, width, percent, row_key().alias("row_key"))
    copy = F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id"))
    return without_rows(docs, stored(classes.where(copy).select(F.col("row_key").alias("gone_key")).distinct(), "gone"))

"""Fingerprints, centroid clustering and hard negatives against plain Python, on odd tables and on whole ones."""

import hashlib
import math
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
from compare import compare, duck  # noqa: E402

from vecfold.llm import batches, centroids, fingerprints, hard_negatives, ngram_join, quality_rules, queries, sharding, toxicity  # noqa: E402

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Fingerprints


def terms(text):
    return set(WORD.findall((text or "").translate(LOW)))


def term_hash(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return int(batches.apart_hashes(data, np.array([0]), np.array([len(data)]))[0])


def mixed(value):
    """The finalizer in plain integers."""
    value %= 1 << 64
    for _ in range(2):
        value = (value ^ value >> 32) * 0xD6E8FEB86659FD93 % (1 << 64)
    return value ^ value >> 32


def list_hash(terms):
    return mixed(sum(mixed(t + mixed(place)) for place, t in enumerate(sorted(terms))))


def lexicon(texts):
    df = Counter(t for text in texts for t in terms(text))
    return {t for t, n in df.items() if fingerprints.LOWEST_IDF <= math.log(len(texts) / n) <= fingerprints.HIGHEST_IDF}


def fingerprint(text, known):
    """The whole lexicon's hash (8 bytes) and 2 bytes for each subset."""
    held = {term_hash(t) for t in (terms(text) & known or terms(text))}
    whole = list_hash(held) | 1 if held else 0
    out = [whole.to_bytes(8, "little")]
    for draw in range(fingerprints.DRAWS):
        number = {t: mixed(t + (draw + 1) * batches.BASE) for t in held}
        for level in range(fingerprints.LEVELS):
            kept = [t for t in held if number[t] < 1 << (63 - level)]
            out.append((max(1, list_hash(kept) >> 48) if kept else 0).to_bytes(2, "little"))
    return out


def like(a, b):
    either = [(a[0], b[0])] + [(x, y) for x, y in zip(a[1:], b[1:]) if x != b"\0\0" or y != b"\0\0"]
    return sum(x == y for x, y in either) / len(either)


def edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def brute(rows):
    """By position in the order of ids (null first) and md5."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest()))
    texts = [t or "" for _, t in rows]
    known, out = lexicon(texts), []
    for i, (doc_id, _) in enumerate(rows):
        text, following = texts[i], texts[(i + 1) % len(texts)]
        changed = edited(text, following)
        own, other, after = (fingerprint(t, known) for t in (text, changed, following))
        digest = hashlib.sha256(changed.encode()).hexdigest()
        out.append((doc_id, len(text), digest, b"".join(own).hex(), b"".join(other).hex(), round(like(own, other), 9), round(like(own, after), 9)))
    return out


def prose(rng, n, of=400):
    return " ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) % of)


def odd_documents():
    rng = np.random.default_rng(3)
    base = prose(rng, 150)
    texts = [None, "", " \n", "one", "One", "é\U0001f600é", "\U0001f600" * 7, base, base, base.replace("w1 ", "W1  "), prose(rng, 30_000, 5000)]
    texts += [prose(rng, int(rng.integers(1, 300))) for _ in range(60)]
    return list(enumerate(texts))


def got(frame):
    return [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in frame.collect()]


def by_repr(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("partitions", [1, 7])
def test_fingerprints_equal_brute_force(spark, partitions):
    rows = odd_documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    found = fingerprints.fingerprinted(docs)
    assert by_repr(got(found)) == by_repr(brute(rows))
    known, texts = lexicon([t for _, t in rows]), dict(rows)
    groups = defaultdict(set)
    for r in found.collect():
        groups[frozenset(terms(texts[r.doc_id]) & known or terms(texts[r.doc_id]))].add(r.fingerprint)
    assert all(len(prints) == 1 for prints in groups.values()) and len({p for g in groups.values() for p in g}) == len(groups)


def test_fingerprints_with_a_lexicon_too_large_to_send(spark):
    docs = spark.createDataFrame(odd_documents(), "doc_id long, text string").repartition(3)
    sent, joined = fingerprints.fingerprinted(docs), fingerprints.fingerprinted(docs, lexicon_terms=0)
    assert sent.columns == joined.columns and by_repr(sent.collect()) == by_repr(joined.collect())


def test_fingerprints_of_strange_tables(spark):
    rows = odd_documents()[3:30]
    rows += [(None, t) for _, t in rows[:6]] + [(7, "another text"), (7, rows[4][1]), (8, None)] + rows[:3]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    named = docs.select("*", *[F.lit("own").alias(n) for n in ("row", "digest", "fingerprint", "part", "edge", "term", "df", "n_chars")])
    assert by_repr(got(fingerprints.fingerprinted(named))) == by_repr(brute(rows))
    none = fingerprints.fingerprinted(docs.where("doc_id = -1"))
    assert none.count() == 0 and none.columns == fingerprints.fingerprinted(docs).columns
    alone = fingerprints.fingerprinted(docs.where("doc_id = 8")).collect()
    assert {r.near_next for r in alone} <= {0.0, 1.0} or alone
    single = fingerprints.fingerprinted(spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")).first()
    assert single.near_next == 1.0 and single.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest()


def test_fingerprints_tell_edited_texts_from_others(spark, sf_dir):
    """On the test documents half a text is more like the whole than the next text is."""
    found = queries.op11_fingerprints(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    assert sorted(found.doc_id) == sorted(docs.doc_id) and found.near_edited.between(0, 1).all() and found.near_next.between(0, 1).all()
    long = found[found.n_chars > 200]
    assert (long.near_edited > long.near_next).mean() > 0.9
    by_text = docs.merge(found, on="doc_id").groupby("text").fingerprint.nunique()
    assert (by_text == 1).all()


# Centroid clustering


def brute_clusters(rows, clusters=16, rounds=3):
    kept = [(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:clusters]
    means = [list(x) for _, x in start]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, m)), c) for c, m in enumerate(means))

    for _ in range(rounds):
        of = [nearest(x)[1] for _, x in kept]
        for c in range(len(means)):
            members = [x for (_, x), own in zip(kept, of) if own == c]
            if members:
                means[c] = [sum(d) // len(members) for d in zip(*members)]
    last = [nearest(x) for _, x in kept]
    inertia = Counter()
    for distance, c in last:
        inertia[c] += distance
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    return [(i, c, d, inertia[c], sum(inertia.values()), digest[c]) for (i, _), (d, c) in zip(kept, last)]


VECTORS = "vec_id long, embedding array<float>, label int"


def odd_vectors(n=300, labels=4):
    rng = np.random.default_rng(11)
    middles = rng.normal(size=(6, 64))
    rows = [(i, (middles[i % 6] + rng.normal(scale=0.4, size=64)).astype(np.float32).tolist(), int(rng.integers(labels))) for i in range(n)]
    rows += [(n + 1, None, 1), (n + 2, [1.0] * 63, 1), (n + 3, [float("nan")] + [1.0] * 63, 1), (n + 4, [None] + [1.0] * 63, 1), (n + 5, [float("inf")] * 64, 1), (n + 6, [], 0)]
    rows += [(None, rows[3][1], 2), (None, rows[4][1], None), (50, rows[50][1], 2), (50, rows[50][1], 2), (100, rows[7][1], 1), *rows[:5], (n + 7, rows[9][1], None), (n + 8, [0.0] * 64, 3)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(60)]
    return rows


def test_clusters_equal_brute_force(spark):
    rows = odd_vectors()
    frame = spark.createDataFrame(rows, VECTORS).repartition(5).select("*", *[F.lit("own").alias(n) for n in ("x", "dots", "cluster", "distance", "n")])
    found = [tuple(r) for r in centroids.summarised(*centroids.clustered(frame)).collect()]
    assert by_repr(found) == by_repr(brute_clusters([(i, v) for i, v, _ in rows]))


def test_few_or_no_vectors(spark):
    rows = odd_vectors()[:5]
    few = centroids.summarised(*centroids.clustered(spark.createDataFrame(rows, VECTORS)))
    assert by_repr([tuple(r) for r in few.collect()]) == by_repr(brute_clusters([(i, v) for i, v, _ in rows]))
    none = centroids.summarised(*centroids.clustered(spark.createDataFrame([], VECTORS)))
    assert none.count() == 0 and none.columns == few.columns
    nameless = centroids.summarised(*centroids.clustered(spark.createDataFrame([(None, v, label) for _, v, label in rows], VECTORS))).collect()
    assert len(nameless) == 5 and all(r.cluster is None and r.distance is None and r.inertia is None for r in nameless)


def test_products_change_only_where_centroids_do():
    rng = np.random.default_rng(1)
    x, old = rng.integers(-50, 50, (40, 8)), rng.integers(-50, 50, (3, 8))
    new = old.copy()
    new[1, 2] += 7
    new[1, 5] -= 3
    dots = centroids.changed_products(x, x @ old.T, new - old)
    assert (dots == x @ new.T).all()
    only_those = np.full_like(x, 10**6)
    only_those[:, [2, 5]] = x[:, [2, 5]]
    assert (centroids.changed_products(only_those, x @ old.T, new - old) == dots).all()


def test_too_large_components_are_refused(spark):
    frame = spark.createDataFrame([(1, [1e30] * 64, 1)], VECTORS)
    with pytest.raises(Exception, match="exceeds"):
        centroids.clustered(frame)


# Hard negatives


def brute_negatives(rows, scale=256):
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, x) for i, label, x in kept]
    place = lambda i: (i is None, i or 0)
    out = []
    for a, (anchor, own, q) in enumerate(kept):
        if anchor is None or anchor % 50:
            continue
        scored = sorted((-sum(s * t for s, t in zip(q, x)), place(i), b, i, label) for b, (i, label, x) in enumerate(kept) if b != a and len(x) == len(q))
        for score, _, _, positive, _ in [s for s in scored if s[4] == own][:5]:
            inside = [s for s in scored if s[4] != own and 50 * -score <= 100 * -s[0] <= 95 * -score][:3]
            out += [(anchor, positive, rank, s[3], -score, -s[0]) for rank, s in enumerate(inside, 1)]
    return out


def relabelled(frame):
    return frame.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


@pytest.mark.parametrize("slab_rows,leaf,at_once", [(20_000, 128, 512), (40, 5, 3)])
def test_negatives_equal_brute_force(spark, monkeypatch, slab_rows, leaf, at_once):
    for name, value in (("SLAB_ROWS", slab_rows), ("LEAF_ROWS", leaf), ("FANOUT", 3), ("BOUNDED_AT_ONCE", at_once), ("ANCHOR_ROWS", 4 if leaf < 10 else 1000), ("BOX_ROWS", 6 if leaf < 10 else 1000)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = odd_vectors()
    frame = relabelled(spark.createDataFrame(rows, VECTORS)).repartition(4).select("*", *[F.lit("own").alias(n) for n in ("x", "row", "slab", "is_anchor", "score", "w")])
    found = [tuple(r) for r in hard_negatives.mine(frame, F.col("vec_id") % 50 == 0).collect()]
    assert Counter(found) == Counter(brute_negatives(rows))


def test_negatives_of_empty_tables(spark):
    frame = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(frame, F.col("vec_id") % 50 == 0).count() == 0
    alone = spark.createDataFrame([(50, [1.0] * 8, 1), (51, [1.0] * 8, None)], VECTORS)
    assert hard_negatives.mine(alone, F.col("vec_id") % 50 == 0).count() == 0


def test_boxes_bound_products():
    rng = np.random.default_rng(2)
    x, labels = rng.integers(-300, 300, (500, 12)), rng.integers(0, 3, 500)
    tree = hard_negatives.Tree(x, np.arange(500), np.arange(500), labels)
    queries_ = rng.integers(-300, 300, (20, 12))
    upper, lower = hard_negatives.intervals(queries_, tree.lo, tree.hi)
    products = tree.x @ queries_.T

    def rows_below(node):
        if tree.leaf[node]:
            return list(range(tree.first[node], tree.end[node]))
        return [r for child in range(tree.first[node], tree.end[node]) for r in rows_below(child)]

    for node in range(len(tree.lo)):
        below = products[rows_below(node)]
        assert (below.max(axis=0) <= upper[:, node]).all() and (below.min(axis=0) >= lower[:, node]).all()
    assert sorted(r for root in tree.roots.values() for r in rows_below(root)) == list(range(500))
    assert max(tree.end[n] - tree.first[n] for n in range(len(tree.lo)) if tree.leaf[n]) <= hard_negatives.LEAF_ROWS


# Earlier operators


def thue_morse(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_strings_that_a_polynomial_confuses_stay_apart(spark):
    """Of 1,024 letters, with one hash modulo 2**64 whatever its base."""
    one, other = thue_morse(1024)
    data = np.frombuffer(f"{one} {other}".encode(), np.uint8)
    rough = batches.part_hashes(batches.prefix_sums(data), np.array([0, 1025]), np.array([1024, 2049]))
    sound = batches.apart_hashes(data, np.array([0, 1025]), np.array([1024, 2049]))
    assert rough[0] == rough[1] and sound[0] != sound[1]
    docs = spark.createDataFrame([(1, f"{one}\n{other}"), (2, f"{one}\n{one}"), (3, f"{other}\n{other}")], "doc_id long, text string")
    assert {r.doc_id: r.counts.n_dup_lines for r in quality_rules.with_counts(docs).collect()} == {1: 0, 2: 1, 3: 1}
    joined = ngram_join.near_duplicates(docs.select("doc_id", F.substring_index("text", "\n", 1).alias("text")), 4, 85)
    assert {r.doc_id: r.component_id for r in joined.collect()} == {1: 1, 2: 1, 3: 3}


def test_toxicity_takes_one_row_of_an_id(spark):
    ids = [i for i in range(1, 200) if zlib.crc32(str(i).encode()) % 5][:5]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids] + [(ids[0], f"copy {n % 7}") for n in range(3000)] + [(ids[1], None)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i == ids[0])) for i in ids], "doc_id long, toxic int")
    sample = toxicity.sampled(docs, labels, 100, 3).collect()
    assert len(sample) == 5 and sorted(r.doc_id for r in sample) == ids
    texts = [f"text {ids[0]}"] + [f"copy {n}" for n in range(7)]
    assert {r.doc_id: r.text for r in sample}[ids[0]] == min(texts, key=lambda t: hashlib.md5(t.encode()).hexdigest())


def test_lines_of_the_matrix_are_its_own(spark):
    rows = np.random.default_rng(4).integers(0, 40, 37).tolist()
    matrix, sizes = sharding.communication_matrix(rows, 5, 9)
    assert [sum(line) for line in matrix] == rows and [sum(c) for c in zip(*matrix)] == sizes
    alone = sharding.Matrix(np.concatenate([[0], np.cumsum(rows)]), 5, 9)
    assert all(list(alone.line(b)) == matrix[b] for b in (36, 0, 17))


def test_sharding_equals_its_columns(spark, sf_dir):
    """Sizes, checksums and slots of op1 against plain Python."""
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op1_sharding(spark, sf_dir).collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == {i: (len(t) + 1, zlib.crc32(t)) for i, t in docs.items()}
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


# Whole tables


@pytest.mark.parametrize("name", ["op2_mixing", "op12_centroid_clustering", "op13_hard_negatives"])
def test_queries_equal_sql(spark, sf_dir, name):
    assert compare(queries.QUERIES[name](spark, sf_dir), duck(sf_dir), queries.SQL[name]) is None

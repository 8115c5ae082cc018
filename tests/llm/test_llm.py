"""The training-data operators against plain Python, on tables with nulls, empty and long texts, copies and clashes."""

import hashlib
import time
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
import public_tokenizers  # noqa: E402
from compare import compare, duck  # noqa: E402

from vecfold.llm import decontamination, language, mixing, ngram_join, personal_data, quality_rules, queries, repeats, sharding, token_counts, toxicity  # noqa: E402

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(1, 6))) for _ in range(n))


def odd_texts():
    """Null, empty, blank, short, very long, repeated and nearly repeated texts."""
    rng = np.random.default_rng(5)
    base, passage = words(rng, 120), words(rng, 110)
    texts = [None, "", " \n\t ", "one", "one two three", "One Two three", base, base, base.upper(), words(rng, 20_000)]
    for i in range(30):
        tokens = base.split(" ")
        for p in rng.integers(0, len(tokens), rng.integers(1, 5)):
            tokens[p] = f"x{i}{p}"
        texts.append(" ".join(tokens))
    texts += [f"{words(rng, 15)} {passage} {words(rng, 15)}" for _ in range(12)]
    texts += ["la " * 400, "la " * 400, "na " * 90 + passage, "é\U0001f600" * 300, "é\U0001f600" * 120 + "end"]
    return texts


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", None) for i, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows, DOCUMENT).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCUMENT)


@pytest.fixture(scope="module")
def strange(odd):
    """Rows without id, whole rows twice, and columns named like the operators' own."""
    more = odd.where("doc_id in (1, 7, 12)").withColumn("doc_id", F.lit(None).cast("long"))
    rows = odd.union(more).union(odd.where("doc_id in (0, 6, 40)"))
    names = ["counts", "gone", "dirty", "copies", "rate", "key", "row", "size", "shard", "slot", "vertex", "n_shingles", "words", "doc", "position", "digest", "id"]
    return rows.select("*", *[F.lit(f"own {n}").alias(n) for n in names])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(40)] + [(None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    text = odd_texts()[45].split(" ")
    rows = [(1, " ".join(text[20:60])), (2, " ".join(text[90:99])), (3, None), (4, ""), (5, "never said " * 9), (6, "One, TWO three!")]
    return spark.createDataFrame(rows, "item_id long, text string")


# Near duplicates


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_components_equal_brute_force(odd, width, percent):
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in ngram_join.near_duplicates(odd, width, percent).collect()}
    assert got == brute.components(dict(enumerate(odd_texts())), width, percent)


def test_components_with_every_shingle_frequent(odd, monkeypatch):
    monkeypatch.setattr(ngram_join, "RARE", 1)
    monkeypatch.setattr(ngram_join, "FIRST_HUBS", 2)
    monkeypatch.setattr(ngram_join, "MERGED", 3)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in ngram_join.near_duplicates(odd, 4, 85).collect()}
    assert got == brute.components(dict(enumerate(odd_texts())), 4, 85)


def test_prefixes_lose_no_partner():
    """Two sets at the limit share enough of their prefixes, whatever their sizes."""
    rng = np.random.default_rng(2)
    for _ in range(400):
        n = int(rng.integers(2, 90))
        values = rng.permutation(1000)[: 2 * n]
        a, common = set(values[:n].tolist()), int(np.ceil(0.85 * n))
        b = set(values[:common].tolist()) | set(values[n : n + int(rng.integers(0, n - common + 1))].tolist())
        inside = len(a & b)
        if 100 * inside < 85 * len(a | b):
            continue
        prefix = lambda s: set(sorted(s)[: ngram_join.errors(len(s), 85) + 1 + ngram_join.spare(len(s), 85)])
        least = ngram_join.spare(ngram_join.least_partner(max(len(a), len(b)), 85), 85)
        assert len(prefix(a) & prefix(b)) >= 1 + least


def test_one_of_each_keeps_whole_rows(strange, empty):
    kept = ngram_join.one_of_each(strange)
    assert kept.columns == strange.columns
    roots = {root for root, _ in brute.components(dict(enumerate(odd_texts())), 4, 85).values()}
    rows = kept.collect()
    assert {r.doc_id for r in rows if r.doc_id is not None} == roots
    assert Counter(r.doc_id for r in rows)[0] == 2  # an empty text is linked with nothing, its rows stay
    assert ngram_join.near_duplicates(empty).count() == 0


def test_one_of_each_judges_rows_and_not_ids(spark):
    rng = np.random.default_rng(8)
    a, b, c = words(rng, 60), words(rng, 60), words(rng, 60)
    rows = [(5, a), (5, b), (3, b + " end"), (None, b + " more"), (None, c), (None, ""), (None, None), (9, a + " near")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(map(tuple, ngram_join.one_of_each(docs).collect()), key=str)
    assert kept == sorted([(5, a), (3, b + " end"), (None, c), (None, ""), (None, None)], key=str)


# Repeats


@pytest.mark.parametrize("hot", [1, 8192])
@pytest.mark.parametrize("length", [400, 48])
def test_repeats_equal_brute_force(odd, monkeypatch, hot, length):
    monkeypatch.setattr(repeats, "HOT", hot)
    got = {r.doc_id: tuple(r)[1:] for r in repeats.without_repeats(odd, length).collect()}
    assert [got[i] for i in range(len(got))] == brute.removed(odd_texts(), length)


def test_repeats_give_the_kept_bytes(odd, empty):
    for r in repeats.without_repeats(odd, with_text=True).collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed
    assert repeats.without_repeats(empty).count() == 0


def test_small_batches_of_buckets(odd, monkeypatch):
    monkeypatch.setattr(repeats, "BATCH_BYTES", 2_000)
    got = {r.doc_id: tuple(r)[1:] for r in repeats.without_repeats(odd).collect()}
    assert [got[i] for i in range(len(got))] == brute.removed(odd_texts(), 400)


def test_repeated_words_are_no_long_repeats(spark):
    """Words said many times put suffixes at unequal distances from equal anchors into one bucket."""
    said = [("Of", 28), ("are", 29), ("erernd", 26), ("erndble", 26), ("eresnd", 26), ("thertiin", 26), ("to", 19), ("thineation", 26)]
    texts = [" ".join(" ".join([word] * n) for word, n in said[i:]) + "\nWas ntonti theron thlyly." for i in range(3)]
    texts += [" ".join([word] * (3 * n)) for word, n in said] + [" ".join(" ".join([word] * n) for word, n in reversed(said))]
    for some in (texts[:1], texts):
        got = {r.doc_id: tuple(r)[1:] for r in repeats.without_repeats(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")).collect()}
        assert [got[i] for i in range(len(got))] == brute.removed(some, 400)


@pytest.mark.parametrize("hot,width", [(8192, 51), (8192, 12), (1, 51), (1, 5)])
def test_shared_passages_equal_brute_force(odd, empty, monkeypatch, hot, width):
    monkeypatch.setattr(repeats, "HOT", hot)
    got = {r.doc_id: r.n_shared_words for r in repeats.without_repeats(odd, passage_words=width).collect()}
    assert [got[i] for i in range(len(got))] == brute.shared_words(odd_texts(), width)
    assert repeats.without_repeats(empty, passage_words=width).count() == 0


@pytest.mark.parametrize("hot,places", [(8192, 256), (1, 256), (8192, 3), (1, 3)])
def test_words_said_over_and_over_are_few_rows_of_a_bucket(spark, monkeypatch, hot, places):
    """A run that repeats in its text meets others once, or a text of n equal words adds n rows to one bucket."""
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "PLACES", places, raising=False)
    kept, store = {}, repeats.stored
    monkeypatch.setattr(repeats, "stored", lambda frame, name: kept.setdefault(name, store(frame, name)))
    rng = np.random.default_rng(4)
    refrain = words(rng, 70)
    texts = [" ".join(["la"] * n) + f" {words(rng, 60)}" for n in (900, 700, 53)] + [" ".join(["di da"] * 400), f"{words(rng, 80)} " + " ".join(["di da"] * 300)]
    texts += [" ".join([refrain] * 9), f"{refrain} {words(rng, 40)} {refrain} {refrain}", " ".join([words(rng, 55)] * 8), words(rng, 200), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_shared_words for r in repeats.without_repeats(docs, passage_words=51).collect()}
    assert [got[i] for i in range(len(got))] == brute.shared_words(texts, 51)
    windows = kept["passage-windows"]
    assert windows.groupBy("id", "anchor", "windows").count().agg({"count": "max"}).first()[0] <= -(-900 // places)
    if places == 256:
        assert windows.count() < 200
        runs = kept["passage-anchors"].where("anchor is not null")
        assert runs.count() == runs.distinct().count()


def test_short_passages_of_over_50_words_are_reported(spark, tmp_path):
    """The contract's columns leave passages below 400 bytes; rows without id and copies have passages too."""
    rng = np.random.default_rng(8)
    passage, copy = words(rng, 60), words(rng, 51)
    texts = [f"{words(rng, 40)} {passage} {words(rng, 30)}", f"{words(rng, 9)}\n{passage.replace(' ', '  ')}", passage.rsplit(" ", 10)[0], words(rng, 300), copy, copy]
    texts += [f"{said} {words(rng, 20)} {said}" for said in [words(rng, 55)]]  # twice in one text alone
    rows = [(None if i == 1 else i, t, None, None, None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCUMENT).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op4_suffix_dedup"](spark, str(tmp_path)).collect()}
    assert len(passage.encode()) < 400 and not any(r.n_removed for r in got.values())
    assert [got[None if i == 1 else i].n_shared_words for i in range(7)] == brute.shared_words(texts, 51) == [60, 60, 0, 0, 51, 51, 0]
    assert [i for i, r in got.items() if r.shares_passage] and all(r.shares_passage == (r.n_shared_words > 0) for r in got.values())


# Quality, tokens


def test_quality_counts_equal_brute_force(odd, labels, empty):
    rows = quality_rules.judged(odd, labels).collect()
    for r in rows:
        want = brute.quality_counts(odd_texts()[r.doc_id])
        assert tuple(r)[1:6] == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
    assert quality_rules.judged(empty, labels).count() == 0
    assert quality_rules.judged(odd, labels.limit(0)).where("kept = base_failed").count() == 0


def test_rules_are_learned_and_become_one_expression(spark):
    rng = np.random.default_rng(1)
    values = rng.random((600, 2))
    bad = (values[:, 0] > 0.7) & (values[:, 1] <= 0.5) | (values[:, 1] > 0.9)
    rules = quality_rules.learn(values, bad, ["a", "b"])
    verdict = np.zeros(600, bool)
    for rule in rules:
        verdict |= quality_rules._covered(rule, values, ["a", "b"])
    assert (verdict == bad).mean() > 0.97 and rules


def test_quality_learns_from_real_labels(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir[:-3]}01/documents.parquet"), spark.read.parquet(f"{sf_dir[:-3]}01/labels.parquet")
    judged = quality_rules.judged(docs, labels).join(labels, "doc_id").where("not base_failed").collect()
    right = sum(r.kept == bool(r.quality) for r in judged)
    assert right >= 0.95 * len(judged) and sum(not r.kept for r in judged) > 10


def test_keeping_good_rows_changes_none(strange, labels):
    kept = quality_rules.keep_good(strange, labels)
    assert kept.columns == strange.columns and kept.exceptAll(strange).count() == 0


def test_token_counts_equal_the_library(odd, spark, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = odd_texts() + ["a<|endoftext|>b  <|endoftext|>", "don't 12３ ñ\n\n  x", " 　 \x1c\x85y"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    library = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    rows = sorted(token_counts.token_counts(docs, path).collect())
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in rows] == [(len((t or "").encode()), n, n > 512) for t, n in zip(texts, library)]
    assert token_counts.token_counts(empty, path).count() == 0


# Languages, toxicity, personal data


def test_viterbi_finds_the_best_path():
    import itertools

    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 6, 40)
    scores, starts = rng.normal(size=(lengths.sum(), 3)) * 2, np.cumsum(lengths) - lengths
    transitions = rng.normal(size=(3, 3))
    for table in (None, transitions):
        got = language.viterbi(scores, starts, lengths, 1.5, table)
        for s, n in zip(starts, lengths):
            def worth(path):
                step = (lambda a, b: -1.5 * (a != b)) if table is None else (lambda a, b: table[a, b])
                return sum(scores[s + i, p] for i, p in enumerate(path)) + sum(map(step, path, path[1:]))

            assert worth(got[s : s + n].tolist()) == pytest.approx(max(worth(p) for p in itertools.product(range(3), repeat=int(n))))


def test_languages_of_held_out_documents(spark, sf_dir, empty):
    docs = spark.read.parquet(f"{sf_dir[:-3]}01/documents.parquet")
    rows = language.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows) > 100
    assert language.identified(empty).count() == 0


def test_mixed_languages_scripts_and_texts_without_letters(spark):
    texts = ["the cat and the dog are in the house", "кот и собака в доме и на улице", "le chat et le chien dans la maison"] * 40
    rows = [(i, t, ["en", "ru", "fr"][i % 3]) for i, t in enumerate(texts)]
    asked = [(1000, "the dog and the cat кот и собака в доме и на улице", None), (1001, "12 !?", None), (1002, None, None), (1003, "", None), (1004, "собака", None)]
    docs = spark.createDataFrame(rows + asked, "doc_id long, text string, lang string")
    model = language.train(docs)
    got = {r.doc_id: r for r in language.predict(docs.where("doc_id >= 1000"), model).collect()}
    assert [got[i].lang_pred for i in range(1001, 1005)] == ["und", "und", "und", "ru"] and got[1001].score == 0
    spans = language.spans(docs.where("doc_id = 1000"), model).orderBy("start").collect()
    assert [s.lang for s in spans] == ["en", "ru"]
    assert language.predict(docs, language.train(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_toxic_sentences_are_found_from_document_labels(spark, empty, labels):
    rng = np.random.default_rng(4)
    rows, marks = [], []
    for i in range(400):
        sentences = [words(rng, 8) for _ in range(6)]
        if toxic := i % 4 == 0:
            sentences[i % 6] += f" you {['moron', 'scum'][i % 8 // 4]} {words(rng, 2)}"
        rows.append((i, ". ".join(sentences)))
        marks.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows + [(1000, None), (1001, "")], "doc_id long, text string")
    known = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    judged = {r.doc_id: r for r in toxicity.judged(docs, known).collect()}
    assert all(judged[i].predicted == t for i, _, t in marks) and judged[1000].score == judged[1001].score == 0
    found = toxicity.offending_sentences(docs, toxicity.train(docs, known)).collect()
    assert len(found) == 100 and all("moron" in r.sentence or "scum" in r.sentence for r in found)
    assert toxicity.judged(empty, labels).count() == 0
    assert toxicity.judged(docs, known.limit(0)).where("predicted <> 0").count() == 0


def test_base_spans_equal_the_patterns(spark, sf_dir, odd, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    more = ["call +1 (212) 555-0199 or a.b@c.example.org, 4111 1111 1111 1111!", "1.2.3.4.5 300.1.1.1 é +49 30 1234567", None, "", "x@y +1"]
    docs = docs.union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in personal_data.personal_data(docs).collect():
        base = brute.base_spans(texts[r.doc_id])
        joined = ",".join(f"{personal_data.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
    assert personal_data.personal_data(empty).count() == 0


def test_the_field_labels_held_out_sentences():
    field = personal_data.train(personal_data.labelled_rows())
    right = total = 0
    for text, names in personal_data.labelled_rows(4, seed=77):
        data = np.frombuffer(text.encode(), np.uint8)
        offsets = np.array([0, len(data)])
        starts, _, _, features, lengths = personal_data._features(data, offsets)
        gold = [personal_data.LABELS.index(names[i]) for i in np.searchsorted(personal_data.batches.words_of(data, offsets)[0], starts)]
        right += (personal_data.decode(field, features, lengths) == gold).sum()
        total += len(gold)
    assert right >= 0.97 * total > 500


def test_secrets_of_letters_only_are_found(spark):
    rng = np.random.default_rng(9)
    plain = "a " * 30 + "plain sentence about nothing in particular, without any figures"
    rows, want = [(0, plain)], {0: ""}
    for i in range(1, 41):
        secret = "AKIA" + "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), 16)) if i % 2 else "correcthorsebattery"
        text = f"{plain} {secret if i % 2 else 'password: ' + secret} and more words"
        rows.append((i, text))
        want[i] = f"secret:{text.index(secret)}:{text.index(secret) + len(secret)}"
    got = {r.doc_id: r.spans for r in personal_data.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == "" and sum(got[i] == want[i] for i in want) >= 40


# Decontamination


def test_contamination_equals_brute_force(odd, items, empty):
    rows = [(r.item_id, r.text) for r in items.collect()]
    for r in decontamination.contamination(odd, items).collect():
        n, hit, ids = brute.contamination(odd_texts()[r.doc_id], rows)
        assert tuple(r)[1:] == (n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0 and 20 * hit >= n)
    assert decontamination.contamination(empty, items).count() == 0
    assert decontamination.contamination(odd, items.limit(0)).where("n_hit > 0 or contaminated").count() == 0


def test_repetitive_texts_and_equal_items(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(["buy", "now"] * 100), " ".join(rng.choice(["a", "b", "c"], 200)), "buy " * 13, "a b", "", None, "now"]
    items = [(str(i), " ".join(["buy", "now"] * 20)) for i in range(5)] + [("5", "buy"), ("6", "a b"), ("7", texts[1]), (None, "now buy now"), ("9", "buy " * 20), ("1", "b c")]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in decontamination.contamination(docs, spark.createDataFrame(items, "item_id string, text string")).collect():
        n, hit, ids = brute.contamination(texts[r.doc_id], items)
        ids = sorted({i for i in ids if i not in (None, "None")})
        assert tuple(r)[1:4] == (n, hit, len(ids)) and r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()


def test_hits_of_equal_items_do_not_multiply(spark):
    text = " ".join(["buy", "now", "cheap"] * 70)
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    items = spark.range(50).select(F.col("id").alias("item_id"), F.lit(text).alias("text"))
    start = time.perf_counter()
    rows = decontamination.contamination(docs, items).groupBy("n_words", "n_hit", "n_items", "contaminated").count().collect()
    assert [tuple(r) for r in rows] == [(210, 210, 50, True, 2000)]
    assert time.perf_counter() - start < 60


def test_cleaning_keeps_whole_rows(strange, items):
    kept = decontamination.clean(strange, items)
    assert kept.columns == strange.columns
    dirty = {r.doc_id for r in decontamination.contamination(strange, items).where("contaminated").collect()}
    assert dirty and kept.count() == strange.count() - strange.where(F.col("doc_id").isin([d for d in dirty if d is not None])).count()


def test_cleaning_judges_rows_and_not_ids(spark, items):
    rows = [(None, "one two three"), (None, "clean words"), (None, None), (None, ""), (4, "one two three"), (4, "other words")]
    kept = decontamination.clean(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[i] for i in (1, 2, 3, 5)], key=str)


def test_proximity_allows_moved_words(spark):
    item = "a0 b1 c2 d3 e4 f5 g6 h7 i8 j9 k10 l11 m12"
    docs = spark.createDataFrame([(1, "x " + item.replace("d3 e4", "e4 new d3")), (2, " ".join(reversed(item.split()))), (3, item)], "doc_id long, text string")
    terms, placed = decontamination.item_terms(spark.createDataFrame([(1, item)], "item_id long, text string"))
    postings = decontamination.build_index(docs, terms)
    hits = decontamination.proximity_hits(postings.where("not is_end"), placed).join(postings.where("is_end").select("doc", "doc_id"), "doc")
    assert {r.doc_id for r in hits.collect()} == {1, 3}


# Sharding, mixing, pipeline


def test_hypergeometric_draws_have_the_right_mean():
    rng = np.random.default_rng(6)
    draws = [sharding.draw_hypergeometric(300, 700, 100, rng) for _ in range(3000)]
    assert np.mean(draws) == pytest.approx(30, abs=0.4) and np.var(draws) == pytest.approx(18.9, rel=0.15)
    assert sharding.draw_hypergeometric(0, 10, 5, rng) == 0 and sharding.draw_hypergeometric(10, 0, 5, rng) == 5
    big = sharding.draw_hypergeometric(10**11, 3 * 10**11, 10**6, rng)
    assert abs(big - 250_000) < 10_000
    matrix, sizes = sharding.communication_matrix([5, 0, 17, 3], 4, 1)
    assert [sum(r) for r in matrix] == [5, 0, 17, 3] and [sum(c) for c in zip(*matrix)] == sizes == [7, 6, 6, 6]


def test_shards_are_exact_and_repeatable(odd, strange, empty):
    placed = sharding.keyed_places(odd, 8, 1).collect()
    by_shard = {}
    for r in placed:
        text = (odd_texts()[r.doc_id] or "").encode()
        assert r.size == len(text) + 1 and r.law == "rows" and r.grown_shard is None
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    again = sharding.keyed_places(odd.repartition(7), 8, 1).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in again) == sorted((r.doc_id, r.shard, r.slot) for r in placed)
    rows = sharding.shard_rows(strange)
    assert rows.count() == strange.count() and rows.where("text is null").count() == 2 and len(set(rows.columns)) == len(rows.columns)
    assert sharding.shard_rows(empty).count() == 0


def test_copies_of_a_row_spread_over_shards_and_slots(spark):
    copies = spark.range(1600).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))
    docs = copies.union(spark.range(1600).select("id", F.lit("text").alias("text"))).repartition(3)
    rows = sharding.shard_rows(docs, 8).where("doc_id is null").collect()
    shards = Counter(r.shard for r in rows)
    assert len(rows) == 1600 and len(shards) == 8 and all(120 < n < 280 for n in shards.values())
    slots = sorted((r.shard, r.slot) for r in rows)
    following = sum(a[0] == b[0] and b[1] == a[1] + 1 for a, b in zip(slots, slots[1:]))
    assert 600 < following < 1000  # half of the rows are copies, so half of the copies are followed by one
    again = sharding.shard_rows(docs.repartition(7), 8).where("doc_id is null").collect()
    assert sorted((r.shard, r.slot) for r in again) == slots


def test_mixtures_reach_their_weights(spark, strange, empty):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("12345").alias("text"), F.when(F.col("id") % 6 == 0, "small").otherwise("large").alias("source"))
    mixed = mixing.mix(docs, {"small": 1.0, "large": 1.0, "none": 5.0}, copy="copy")
    counts = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    total = 6000 * 2 / 7  # a source that is not there leaves its share open
    assert counts["small"] / total == pytest.approx(0.5, rel=0.1) or counts["small"] == pytest.approx(counts["large"], rel=0.1)
    draws = [r["count"] for r in mixed.where("source = 'small'").groupBy("doc_id").count().collect()]
    rate = counts["small"] / 1000
    assert 1000 - len(draws) == pytest.approx(1000 * np.exp(-rate), abs=60)
    rows = mixing.mix(strange)
    assert rows.columns == strange.columns and rows.exceptAll(rows.intersect(strange)).count() >= 0
    assert mixing.mix(empty).count() == 0


def test_high_rates_are_not_cut(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("12345").alias("text"), F.when(F.col("id") < 100, "small").otherwise("large").alias("source"))
    mixed = mixing.mix(docs, {"small": 0.3, "large": 0.7}, copy="copy")
    small = [r["n"] for r in mixed.where("source = 'small'").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("last")).where("n = last").collect()]
    assert len(small) == 100 and np.mean(small) == pytest.approx(60, abs=3) and np.var(small) == pytest.approx(60, rel=0.6)
    assert mixed.count() == pytest.approx(20_000, rel=0.03)
    one = docs.where("doc_id between 99 and 20000")  # one document of rate 9950, beside all others
    assert mixing.mix(one, {"small": 0.5, "large": 0.5}).where("source = 'small'").count() == pytest.approx(9950, abs=500)


def test_rows_without_id_draw_for_themselves(spark):
    texts = F.when(F.col("id") % 2 == 0, "").otherwise(F.concat(F.lit("text "), F.col("id").cast("string")))
    docs = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), texts.alias("text"), F.lit("s").alias("source"))
    mixed = mixing.mix(docs, copy="copy")
    for some in (mixed.where("text = ''"), mixed.where("text <> ''")):
        assert some.count() == pytest.approx(1000, abs=150) and some.where("copy = 1").count() == pytest.approx(632, abs=70)
    assert mixing.mix(docs.repartition(5)).exceptAll(mixed.drop("copy")).count() == 0


def test_pipeline_keeps_columns_and_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "deduplicate", "decontaminate", "mix", "shard"]
    out = corpus_pipeline.run(spark, sf_dir)
    assert set(docs.columns) < set(out.columns)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(texts[r.doc_id] == r.text for r in out.collect())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(queries.QUERIES[name](spark, sf_dir), duck(sf_dir), queries.SQL[name]) is None

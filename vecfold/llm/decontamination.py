"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

``build_index`` stores one posting (term, document, position) for every word of the documents that
is a benchmark term, and one end mark per document. Windows of 13 item words are told apart by their words: a
window that many items hold, or one item many times, is looked for once. ``phrase_hits`` intersects the lists
of a window's two rarest terms, adjusted by their offsets; windows that share this pair share the intersection,
and only places that have both terms look at the other words. Frequent terms are never joined by
themselves. ``proximity_hits`` finds windows whose words stand near their places.

A word is a run of ASCII letters (lower-cased), digits and characters beyond ASCII. An item of fewer
than 13 words, but not none, is one window. Null texts have no words. Every row of documents is a
document of its own, also when ids repeat or are null; hits of items without id count, but are not
listed. Items that repeat an id are one item. Extra columns are ignored. Empty documents give no rows, an empty
benchmark no hits. Very long texts are rows like any other: they are unfolded to words before anything is joined.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecfold.llm.tables import row_key, small, stored, without_rows

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = "\u0000"  # no word: a separator
WINDOW = 13


def words(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    # lower() is fast, but only for texts in ASCII does it change nothing else.
    lowered = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def item_terms(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored tables: (term, word) with the end mark as a word, and (item, item_id, n, offset, term)."""
    spelled = stored(
        items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words")),
        "items",
    )
    placed = spelled.select("item", "item_id", F.size("words").alias("n"), F.posexplode("words").alias("offset", "word"))
    mark = items.sparkSession.range(1).select(F.lit(END).alias("word"))
    terms = placed.select("word").distinct().union(mark).select(F.monotonically_increasing_id().alias("term"), "word")
    terms = stored(terms, "terms")
    return terms, stored(placed.join(terms, "word").select("item", "item_id", "n", "offset", "term"), "item-terms")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Stored postings (term, word_is_end, doc, doc_id, position); end marks stand at the number of words."""
    # The id is given before the words are unfolded: one per row of documents.
    numbered = docs.select("doc_id", "text").withColumn("doc", F.monotonically_increasing_id())
    placed = numbered.select("doc", "doc_id", F.posexplode(F.concat(words(F.col("text")), F.array(F.lit(END)))).alias("position", "word"))
    return stored(
        placed.join(small(terms), "word").select("term", (F.col("word") == END).alias("is_end"), "doc", "doc_id", "position"), "postings"
    )


def windows(placed: DataFrame, frequencies: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Stored tables: (window, terms), each distinct window's words as (frequency, offset, term) rarest first,
    and (window, item, item_id).

    Windows with a term that no document has are left out.
    """
    starts = F.explode(F.sequence(F.greatest(F.lit(0), F.col("offset") - length + 1), F.least(F.col("offset"), F.greatest(F.lit(0), F.col("n") - length))))
    within = placed.select("item", "item_id", "offset", "term", starts.alias("start")).join(frequencies, "term", "left")
    content = F.sort_array(F.collect_list(F.struct("frequency", (F.col("offset") - F.col("start")).alias("offset"), "term")))
    grouped = within.groupBy("item", "item_id", "start").agg(content.alias("terms"), F.count(F.lit(1)).alias("of"), F.count("frequency").alias("known"))
    held = stored(grouped.where(F.col("of") == F.col("known")).select("item", "item_id", "terms").distinct(), "windows")
    spans = stored(held.select("terms").distinct().select(F.monotonically_increasing_id().alias("window"), "terms"), "distinct-windows")
    return spans, stored(held.join(small(spans), "terms").select("window", "item", "item_id"), "window-items")


def alignments(postings: DataFrame, spans: DataFrame) -> DataFrame:
    """(window, doc, shift): places where a window's two rarest terms stand as in the window; shift is its first word's."""
    first, second = F.col("terms")[0], F.try_element_at(F.col("terms"), F.lit(2))
    seeds = stored(
        spans.select(
            "window", first["term"].alias("term"), first["offset"].alias("offset"),
            second["term"].alias("term2"), (second["offset"] - first["offset"]).alias("apart"),
        ),
        "seeds",
    )
    pairs = stored(seeds.where("term2 is not null").select("term", "term2", "apart").distinct(), "pairs")
    found = postings.join(small(pairs), "term").select("term", "term2", "apart", "doc", "position", (F.col("position") + F.col("apart")).alias("position2"))
    seconds = small(stored(pairs.select("term2").distinct(), "second-terms"))
    others = postings.join(seconds, F.col("term") == F.col("term2"), "left_semi").select(F.col("term").alias("term2"), "doc", F.col("position").alias("position2"))
    both = stored(found.join(others, ["term2", "doc", "position2"], "left_semi").select("term", "term2", "apart", "doc", "position"), "pair-hits")
    shift = (F.col("position") - F.col("offset")).alias("shift")
    aligned = both.join(small(seeds), ["term", "term2", "apart"]).select("window", "doc", shift)
    alone = postings.join(small(seeds.where("term2 is null").select("window", "term", "offset")), "term").select("window", "doc", shift)
    return stored(aligned.union(alone), "alignments")


def phrase_hits(postings: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc, window, first, last): occurrences of windows."""
    size = F.size("terms")
    known = small(spans.select("window", size.alias("n"), F.slice("terms", 3, F.greatest(size, F.lit(1))).alias("rest")))
    aligned = alignments(postings, spans).join(known, "window")
    needed = aligned.where("n > 2").select("doc", "window", "shift", "n", F.explode("rest").alias("word"))
    needed = needed.select("doc", "window", "shift", "n", F.col("word.term").alias("term"), (F.col("shift") + F.col("word.offset")).alias("position"))
    needed = stored(needed, "needed")
    # Only documents with an alignment move their postings.
    looked_at = stored(needed.select("doc").distinct(), "documents-looked-at")
    open_postings = postings.join(small(looked_at), "doc", "left_semi").select("term", "doc", "position")
    matched = open_postings.join(needed.hint("merge"), ["term", "doc", "position"])
    whole = matched.groupBy("doc", "window", "shift", "n").agg(F.count(F.lit(1)).alias("there")).where("there = n - 2")
    hits = whole.select("doc", "window", "shift", "n").union(aligned.where("n <= 2").select("doc", "window", "shift", "n"))
    return hits.select("doc", "window", F.col("shift").alias("first"), (F.col("shift") + F.col("n") - 1).alias("last"))


def proximity_hits(postings: DataFrame, placed: DataFrame, length: int = WINDOW, slack: int = 3) -> DataFrame:
    """(doc, item, item_id, shift): windows all of whose words stand within ``slack`` words of their place.

    Places follow from the window's rarest term; the second rarest thins them out before all words are looked at.
    Positions meet in bins of slack + 1 words.
    """
    frequencies = stored(postings.groupBy("term").agg(F.count(F.lit(1)).alias("frequency")), "frequencies")
    spans, of_items = windows(placed, frequencies, length)
    first, step = F.col("terms")[0], slack + 1
    seeds = stored(spans.select("window", first["term"].alias("term"), first["offset"].alias("offset")), "seeds")
    found = postings.join(small(seeds), "term").select("window", "doc", (F.col("position") - F.col("offset")).alias("shift"))
    binned = postings.select("term", "doc", "position", F.floor(F.col("position") / step).alias("bin"))

    def near(places: DataFrame, words: Column, name: str) -> DataFrame:
        wanted = small(stored(spans.select("window", F.size(words).alias("of"), F.inline(words)), f"{name}-words"))
        places = places.join(wanted, "window").select("window", "doc", "shift", "of", "term", "offset", (F.col("shift") + F.col("offset")).alias("place"))
        places = places.withColumn("bin", F.explode(F.array(*[F.floor(F.col("place") / step) + d for d in (-1, 0, 1)])))
        close = places.join(binned, ["term", "doc", "bin"]).where(F.abs(F.col("position") - F.col("place")) <= slack)
        whole = close.groupBy("doc", "window", "shift", "of").agg(F.countDistinct("offset").alias("there"))
        return stored(whole.where("there = of").select("window", "doc", "shift"), name)

    thin = near(found, F.slice("terms", 2, 1), "near-pairs").union(found.join(small(spans.where(F.size("terms") == 1).select("window")), "window"))
    return near(thin, F.col("terms"), "near").join(small(of_items), "window").select("doc", "item", "item_id", "shift").distinct()


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``docs``.

    Contaminated: at least one word of twenty lies inside an occurrence of a window.
    """
    terms, placed = item_terms(items)
    index = build_index(docs, terms)
    postings = index.where("not is_end")
    frequencies = stored(postings.groupBy("term").agg(F.count(F.lit(1)).alias("frequency")), "frequencies")
    spans, of_items = windows(placed, frequencies, WINDOW)
    hits = stored(phrase_hits(postings, spans), "hits")
    # Words of an occurrence that no earlier one in the document holds.
    earlier = Window.partitionBy("doc").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.max("last").over(earlier), F.lit(-1))
    new = F.greatest(F.col("last") - F.greatest(upto, F.col("first") - 1), F.lit(0))
    counted = hits.select("doc", "first", "last").distinct().select("doc", new.alias("new")).groupBy("doc").agg(F.sum("new").cast("long").alias("n_hit"))
    named = hits.select("doc", "window").distinct().join(small(of_items), "window").groupBy("doc").agg(F.collect_set("item_id").alias("ids"))

    def digest(ids: Column) -> Column:
        return F.sha2(F.concat_ws(",", F.array_sort(ids)), 256)

    # Only counts and digests of lists go on.
    listed = named.select("doc", F.size("ids").cast("long").alias("n_items"), digest(F.col("ids")).alias("items_sha256"))
    found = stored(counted.join(listed, "doc"), "found")
    ends = index.where("is_end").select("doc", "doc_id", F.col("position").cast("long").alias("n_words"))
    n_hit, none = F.coalesce("n_hit", F.lit(0).cast("long")), F.lit(0).cast("long")
    return ends.join(small(found), "doc", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", none).alias("n_items"),
        F.coalesce("items_sha256", digest(F.array().cast("array<string>"))).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage; all other rows stay unchanged.

    Each row is judged by its own text, also where ids repeat or are null.
    """
    keyed = docs.select(row_key().alias("doc_id"), "text")
    dirty = contamination(keyed, items).where("contaminated").select(F.col("doc_id").alias("dirty_key")).distinct()
    return without_rows(docs, stored(dirty, "dirty"))

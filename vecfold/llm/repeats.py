"""Removal of long repeats by a suffix array built bucket by bucket.

Texts are UTF-8 bytes. A byte goes when a string of ``length`` bytes that covers it also starts
somewhere else, in the same text or another; strings are judged on the input.

Only suffixes that can share ``length`` bytes with another matter, and they are sorted by no more than
that. A suffix's bucket is the least hash among the GRAM-byte strings in its first ``length`` bytes
(its anchor), so equal suffixes meet in one bucket, and neighbouring suffixes mostly share theirs:
they travel as one run. Anchors that occur once rule their runs out. The others' bytes go to their
buckets, and one range of buckets after another is sorted: suffixes by their first and last STEP
bytes, and what ties there by the precomputed ranks of the cover sample. The sample holds every
STEP-th suffix counted from the anchor; suffixes can only tie at equal distances from their anchors,
so these residues are a difference cover of all pairs, and each suffix has a sampled one less than
STEP bytes on. Sample ranks come from doubling: 16, 32, 64 bytes and so on.

Equal texts are one text for all of this, and repeats inside a text are settled where it is read.
Buckets of more than HOT runs are not gathered: their suffixes are counted as hashed rows, which add
up before the exchange. A task holds one batch of runs, or one text.

A null text is empty. Rows that repeat are copies: at ``length`` bytes or more nothing of them stays.

Passages are counted in words instead, between white space, and nothing goes for them: a passage is a
window of so many words that another row has too. Windows meet by anchors in the same way, the least hash
of PASSAGE_GRAM words in them; a bucket holds the hashes of its windows, not their text. Equal runs of one
text, of which a text that says one word over and over has as many as words, are one row with all their places.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecfold.llm import batches
from vecfold.llm.tables import small, stored

GRAM = 128
STEP = 16
# Words of a string that can be the anchor of a window of words.
PASSAGE_GRAM = 8
# Runs of a bucket that a task may gather: some 6 MB of bytes.
HOT = 8192
BATCH_BYTES = 4_000_000
# Places of equal runs of a text in one row; more of them take more rows.
PLACES = 256


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, from running minima forwards and backwards in blocks."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def _twice(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur again, and which occurred before (stable order)."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    again, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[:-1][same]] = True
    before[order[1:][same]] = True
    return again | before, before


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def find_runs(data: np.ndarray, offsets: np.ndarray, length: int):
    """Runs of suffixes with one anchor: text, first suffix, number, anchor's distance, anchor's hash.

    Then the spans of bytes that repeat inside their text: text, start, end. Only the first of equal
    suffixes of a text is in a run.
    """
    gram = min(GRAM, length // 2)
    shift = np.uint64(max(24, int(len(data)).bit_length()))
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return (empty, empty, empty, empty, empty.astype(np.uint64)), (empty, empty, empty)
    sums = batches.prefix_sums(data)
    place = np.arange(len(data) - gram + 1)
    hashes = batches.part_hashes(sums, place, place + gram)
    least = sliding_least((hashes >> shift << shift) | place.astype(np.uint64), length - gram + 1)
    anchors = (least & np.uint64((1 << int(shift)) - 1)).astype(np.int64)
    # Suffixes shorter than ``length`` are none.
    ok = np.zeros(len(anchors) + 1, np.int64)
    long_enough = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(ok, offsets[long_enough], 1)
    np.add.at(ok, offsets[long_enough + 1] - length + 1, -1)
    ok = np.cumsum(ok[:-1]) > 0
    # Texts that use one anchor's string at two places may repeat in themselves.
    starts = np.flatnonzero(ok & np.concatenate([[True], (anchors[1:] != anchors[:-1]) | ~ok[:-1]]))
    text = np.searchsorted(offsets, starts, "right") - 1
    used = anchors[starts]
    new = np.concatenate([[True], used[1:] != used[:-1]]) if len(used) else np.zeros(0, bool)
    again, _ = _twice(hashes[used[new]] ^ batches.mix(text[new].astype(np.uint64) + np.uint64(1)))
    own = [[], [], []]
    for t in np.unique(text[new][again]):
        first = np.arange(offsets[t], offsets[t + 1] - length + 1)
        twice, before = _twice(batches.part_hashes(sums, first, first + length))
        s, e = _spans(twice)
        own[0].append(np.full(len(s), t))
        own[1].append(s)
        own[2].append(e - 1 + length)
        ok[first[before]] = False
    starts = np.flatnonzero(ok & np.concatenate([[True], (anchors[1:] != anchors[:-1]) | ~ok[:-1]]))
    ends = np.flatnonzero(ok & np.concatenate([(anchors[1:] != anchors[:-1]) | ~ok[1:], [True]])) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    found = text, starts - offsets[text], ends - starts, anchors[starts] - starts, hashes[anchors[starts]]
    return found, tuple(np.concatenate(x).astype(np.int64) if x else empty for x in own)


def _runs(batch_iter: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(id, start, n, distance, anchor) of runs; with n = 0, bytes from start to distance that repeat in their text."""
    for batch in batch_iter:
        ids = batch.column("id")
        for begin, _, data, offsets in batches.text_slices(batch.column("text")):
            (text, start, n, distance, anchor), (own, first, last) = find_runs(data, offsets, length)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(begin + np.concatenate([text, own]))), pa.array(np.concatenate([start, first])),
                    pa.array(np.concatenate([n, np.zeros(len(own), np.int64)]).astype(np.int32)), pa.array(np.concatenate([distance, last])),
                    pa.array(np.concatenate([anchor, np.zeros(len(own), np.uint64)]).view(np.int64)),
                ],
                ["id", "start", "n", "distance", "anchor"],
            )


def _cut(batch_iter: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Texts with their runs to one row a run, with the run's bytes."""
    for batch in batch_iter:
        texts, runs = batch.column("text"), batch.column("runs")
        out, size = [], 0
        for i in range(len(batch)):
            raw = texts[i].as_py().encode()
            for run in runs[i].as_py():
                part = raw[run["start"] : run["start"] + run["n"] - 1 + length]
                out.append((run["anchor"], batch.column("id")[i].as_py(), run["start"], run["n"], run["distance"], part))
                size += len(part)
                if size > BATCH_BYTES:
                    yield _rows(out)
                    out, size = [], 0
        if out:
            yield _rows(out)


CUT = pa.schema([("anchor", pa.int64()), ("id", pa.binary()), ("start", pa.int64()), ("n", pa.int32()), ("distance", pa.int64()), ("bytes", pa.binary())])


def _rows(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), CUT)], schema=CUT)


def _ranks(text: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the sampled suffixes (every STEP bytes) by their first length - STEP bytes, by doubling."""
    pairs = text[: len(text) // STEP * STEP].view(np.uint64).reshape(-1, 2)

    def name(high: np.ndarray, low: np.ndarray) -> np.ndarray:
        return np.unique(high.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64), return_inverse=True)[1].astype(np.uint64)

    def ahead(ranks: np.ndarray, n: int) -> np.ndarray:
        return np.concatenate([ranks[n:], np.zeros(min(n, len(ranks)), np.uint64)])

    halves = np.unique(pairs, return_inverse=True)[1].reshape(-1, 2)
    ranks, span = name(halves[:, 0], halves[:, 1]), 1
    total, covered, left = None, 0, (length - STEP) // STEP
    while left:
        if left & 1:
            total = ranks if total is None else name(total, ahead(ranks, covered))
            covered += span
        left >>= 1
        if left:
            ranks, span = name(ranks, ahead(ranks, span)), 2 * span
    return total


def repeated_suffixes(parts: list[bytes], n: np.ndarray, distance: np.ndarray, length: int) -> np.ndarray:
    """For all suffixes of the runs, one run after the other: whether another has the same ``length`` bytes."""
    shift = -distance % STEP  # anchors stand at multiples of STEP
    sizes = np.array([len(p) for p in parts])
    room = (shift + sizes + STEP - 1) // STEP * STEP
    at = np.cumsum(room) - room + shift
    text = np.zeros(int(room.sum()) + 2 * STEP, np.uint8)
    joined = np.frombuffer(b"".join(parts), np.uint8)
    text[np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(joined))] = joined
    ranks = _ranks(text, length)
    words = np.ndarray((len(text) - 7,), "<u8", text.data, strides=(1,))
    place = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
    # The sample covers whole steps from less than STEP bytes on; the last STEP bytes complete it. How many
    # bytes on is part of the key: at unequal distances equal ranks stand for different bytes of the suffix.
    keys = batches.mix((place % STEP).astype(np.uint64) + np.uint64(1)) ^ words[place]
    keys = batches.mix(keys) + words[place + 8]
    keys = batches.mix(keys) + ranks[(place + STEP - 1) // STEP]
    keys = batches.mix(keys) + words[place + length - STEP]
    keys = batches.mix(keys) + words[place + length - STEP + 8]
    return _twice(batches.mix(keys))[0]


def _sort_buckets(batch_iter: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of anchor to (id, start, end) of repeated bytes. Holds whole buckets, a few MB at a time."""

    for table in _whole_buckets(batch_iter):
        n = table["n"].to_numpy().astype(np.int64)
        yield _flagged(table, n, repeated_suffixes(table["bytes"].to_pylist(), n, table["distance"].to_numpy(), length), length)


def _flagged_spans(n: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run, first place in it and place after the last of each maximal span of flagged places."""
    last = np.cumsum(n)
    # Each run's flags apart from the next one's.
    apart = np.zeros(len(flags) + len(n), bool)
    row = np.repeat(np.arange(len(n)), n)
    apart[np.arange(len(flags)) + row] = flags
    s, e = _spans(apart)
    head = np.append(np.arange(len(n)), 0)[: len(n)] + last - n
    row = np.searchsorted(head, s, "right") - 1
    return row, s - head[row], e - head[row]


def _flagged(table: pa.Table, n: np.ndarray, flags: np.ndarray, length: int) -> pa.RecordBatch:
    """(id, start, end) of what strings of ``length`` cover that start at the flagged places of the runs."""
    row, s, e = _flagged_spans(n, flags)
    first = table["start"].to_numpy()[row] + s
    return pa.RecordBatch.from_arrays([table["id"].combine_chunks().take(pa.array(row)), pa.array(first), pa.array(first + (e - s) - 1 + length)], ["id", "start", "end"])


def _whole_buckets(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order of anchor to tables of whole buckets, a few MB each."""
    waiting, size = [], 0
    for batch in batch_iter:
        for begin in range(0, batch.num_rows, 2000):
            part = batch.slice(begin, 2000)
            waiting.append(part)
            size += part.get_total_buffer_size() if part.num_rows == batch.num_rows else part.nbytes
            if size >= BATCH_BYTES:
                table = pa.Table.from_batches(waiting)
                anchors = table["anchor"].to_numpy()
                cut = int(np.argmax(anchors == anchors[-1]))  # rows come in order of anchor
                if cut:
                    yield table.slice(0, cut)
                    rest = table.slice(cut)
                    waiting, size = rest.combine_chunks().to_batches(), rest.nbytes
    if waiting:
        table = pa.Table.from_batches(waiting)
        if table.num_rows:
            yield table


def _hashed(batch_iter: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Texts with their runs to (id, start, suffix): a hash of ``length`` bytes for every suffix."""
    for batch in batch_iter:
        for i in range(len(batch)):
            data = np.frombuffer(batch.column("text")[i].as_py().encode(), np.uint8)
            runs = batch.column("runs")[i].as_py()
            first = np.concatenate([np.arange(r["start"], r["start"] + r["n"]) for r in runs])
            for at in range(0, len(first), 200_000):
                part = first[at : at + 200_000]
                hashes = batches.part_hashes(batches.prefix_sums(data), part, part + length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("id")[i].as_py()] * len(part), pa.binary()), pa.array(part), pa.array(hashes.view(np.int64))], ["id", "start", "suffix"]
                )


def _removed(batch_iter: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batch_iter:
        rows = []
        for i in range(len(batch)):
            raw = batch.column("text")[i].as_py().encode()
            edges = np.zeros(len(raw) + 1, np.int32)
            for span in batch.column("spans")[i].as_py():
                edges[span["start"]] += 1
                edges[span["end"]] -= 1
            gone = np.cumsum(edges[:-1]) > 0
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            row = (batch.column("id")[i].as_py(), int(gone.sum()), len(_spans(gone)[0]), hashlib.sha256(kept).hexdigest())
            rows.append((*row, kept) if with_text else row)
        kinds = [("id", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * with_text
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for _, k in kinds], [name for name, _ in kinds])


def window_runs(data: np.ndarray, offsets: np.ndarray, words: int):
    """Runs of windows of ``words`` words with one anchor: text, first word, number, anchor's hash.

    Then the hashes of all their windows, one run after the other, and the number of words of each text.
    """
    starts, ends, text, counts = batches.words_of(data, offsets)
    hashes = batches.apart_hashes(data, starts, ends)
    gram = min(PASSAGE_GRAM, words)
    grams = batches.shingle_hashes(hashes, gram)
    shift = np.uint64(max(24, len(grams).bit_length()))
    least = sliding_least((grams >> shift << shift) | np.arange(len(grams), dtype=np.uint64), words - gram + 1)
    anchors = (least & np.uint64((1 << int(shift)) - 1)).astype(np.int64)
    ok = text[: len(anchors)] == text[len(text) - len(anchors) :]
    edge = anchors[1:] != anchors[:-1]
    first = np.flatnonzero(ok & np.concatenate([[True], edge | ~ok[:-1]])[: len(ok)])
    end = np.flatnonzero(ok & np.concatenate([edge | ~ok[1:], [True]])[: len(ok)]) + 1
    before = np.cumsum(counts) - counts
    return (text[first], first - before[text[first]], end - first, grams[anchors[first]]), batches.shingle_hashes(hashes, words)[ok], counts


def _alike(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows equal in all columns: the first of them, and how many of them come before the row."""
    n = len(columns[0])
    keys = np.zeros(n, np.uint64)
    for column in columns:
        keys = batches.mix(keys + column.astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    new = np.zeros(n, bool)
    new[:1] = True
    for column in columns:
        # Where two keys agree by chance, equal rows may stay apart; unequal ones never join.
        new[1:] |= column[order[1:]] != column[order[:-1]]
    heads = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    first, before = np.empty(n, np.int64), np.empty(n, np.int64)
    first[order] = order[heads[group]]
    before[order] = np.arange(n) - heads[group]
    return first, before


def _passage_anchors(batch_iter: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(id, anchor) of runs of windows, once each, and (id, n_words) of each text that has a window."""
    for batch in batch_iter:
        ids = batch.column("id")
        for begin, _, data, offsets in batches.text_slices(batch.column("text")):
            (text, _, _, anchor), _, counts = window_runs(data, offsets, words)
            _, same = _alike(text, anchor)
            text, anchor = text[same == 0], anchor[same == 0]
            long_enough = np.flatnonzero(counts >= words)
            at = np.concatenate([text, long_enough])
            is_count = np.arange(len(at)) >= len(text)
            anchors = np.concatenate([anchor.view(np.int64), np.zeros(len(long_enough), np.int64)])
            n_words = np.concatenate([np.zeros(len(text), np.int64), counts[long_enough]])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(begin + at)), pa.array(anchors, mask=is_count), pa.array(n_words, mask=~is_count)], ["id", "anchor", "n_words"])


def _passage_windows(batch_iter: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(anchor, id, starts, windows) of runs of windows: 8 bytes of hash for each window.

    Equal runs of a text are one row with the first word of each, or one for every PLACES of them.
    """
    for batch in batch_iter:
        ids = batch.column("id")
        for begin, _, data, offsets in batches.text_slices(batch.column("text")):
            (text, start, n, anchor), windows, _ = window_runs(data, offsets, words)
            head = np.cumsum(n) - n
            # A run has fewer than ``words`` windows, so its first and last one hold all its words.
            first, before = _alike(text, n, anchor, windows[head], windows[head + n - 1])
            order = np.lexsort((before, first))
            kept = np.flatnonzero(before[order] % PLACES == 0)
            places = batches.lists(pa.array(start[order]), np.diff(np.append(kept, len(order))))
            kept = order[kept]
            text, n, anchor, head = text[kept], n[kept], anchor[kept], head[kept]
            ends = np.concatenate([[0], np.cumsum(n)])
            windows = windows[np.repeat(head - ends[:-1], n) + np.arange(ends[-1])]
            parts = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends * 8).astype(np.int32).tobytes()), pa.py_buffer(windows.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), ids.take(pa.array(begin + text)), places, parts], ["anchor", "id", "starts", "windows"])


def _meet(batch_iter: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of anchor to (id, starts, first, last): from each start, words in windows that another text has."""
    for table in _whole_buckets(batch_iter):
        parts = table["windows"].to_pylist()
        n = np.array([len(p) // 8 for p in parts], np.int64)
        keys = np.frombuffer(b"".join(parts), np.uint64)
        text = np.repeat(table["id"].combine_chunks().dictionary_encode().indices.to_numpy(), n)
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], keys[order[1:]] != keys[order[:-1]]]))
        shared = np.minimum.reduceat(text[order], first) != np.maximum.reduceat(text[order], first)
        flags = np.zeros(len(keys), bool)
        flags[order] = np.repeat(shared, np.diff(np.append(first, len(keys))))
        row, s, e = _flagged_spans(n, flags)
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [table["id"].combine_chunks().take(at), table["starts"].combine_chunks().take(at), pa.array(s), pa.array(e - 1 + words)], ["id", "starts", "first", "last"]
        )


def _apart(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows to (id, starts, first, window), one row a window."""
    for batch in batch_iter:
        for begin in range(0, batch.num_rows, 200):
            part = batch.slice(begin, 200)
            windows = part.column("windows").to_pylist()
            n = np.array([len(w) // 8 for w in windows], np.int64)
            row = np.repeat(np.arange(len(n)), n)
            first = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(at), part.column("starts").take(at), pa.array(first), pa.array(np.frombuffer(b"".join(windows), np.int64))], ["id", "starts", "first", "window"]
            )


def shared_passages(texts: DataFrame, words: int) -> DataFrame:
    """id and n_shared_words of texts (id, text) of which another row has ``words`` consecutive words too.

    All words of such passages count, once each; a row that repeats shares all of its words.
    """
    able = texts.where(F.octet_length("text") >= 2 * words - 1).select("id", "text")
    runs = stored(able.mapInArrow(lambda it: _passage_anchors(it, words), "id binary, anchor long, n_words long"), "passage-anchors")
    anchored = runs.where("anchor is not null")
    key = F.xxhash64("id")
    anchors = anchored.groupBy("anchor").agg(F.min(key).alias("least"), F.max(key).alias("most")).where("least < most")
    anchors = stored(anchors.select("anchor"), "shared-anchors")
    suspects = stored(anchored.join(anchors, "anchor").select("id").distinct(), "passage-suspects")
    wanted = able.join(small(suspects), "id", "left_semi").dropDuplicates(["id"])
    windows = wanted.mapInArrow(lambda it: _passage_windows(it, words), "anchor long, id binary, starts array<long>, windows binary")
    windows = stored(windows.join(anchors, "anchor"), "passage-windows")
    # Counted once copies are one text, for only that is gathered.
    hot = stored(windows.groupBy("anchor").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > HOT).select("anchor"), "hot-anchors")
    met = windows.join(small(hot), "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
    found = met.mapInArrow(lambda it: _meet(it, words), "id binary, starts array<long>, first long, last long")
    if not hot.isEmpty():
        apart = stored(windows.join(small(hot), "anchor", "left_semi").mapInArrow(_apart, "id binary, starts array<long>, first long, window long"), "passage-hashes")
        twice = apart.groupBy("window").agg(F.min(key).alias("least"), F.max(key).alias("most")).where("least < most").select("window")
        found = found.union(apart.join(twice, "window").select("id", "starts", "first", (F.col("first") + words).alias("last")))
    found = found.select("id", F.explode("starts").alias("at"), "first", "last").selectExpr("id", "at + first AS start", "at + last AS end")
    covered = F.expr(
        "aggregate(array_sort(collect_list(struct(start, end))), named_struct('n', 0L, 'upto', 0L), "
        "(a, s) -> named_struct('n', a.n + greatest(0L, s.end - greatest(s.start, a.upto)), 'upto', greatest(a.upto, s.end)), a -> a.n)"
    )
    in_passages = found.groupBy("id").agg(covered.alias("n_shared_words"))
    copies = runs.where("anchor is null").groupBy("id").agg(F.count(F.lit(1)).alias("copies"), F.max("n_words").alias("n_shared_words")).where("copies > 1")
    both = in_passages.union(copies.select("id", "n_shared_words"))
    return stored(both.groupBy("id").agg(F.max("n_shared_words").alias("n_shared_words")), "passages")


def _identified(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(text.cast("binary"), 256)
    return docs.select("doc_id", text.alias("text"), digest.alias("digest"), F.unhex(F.substring(digest, 1, 32)).alias("id"))


def without_repeats(docs: DataFrame, length: int = 400, with_text: bool = False, passage_words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row, and on request the kept bytes.

    ``length`` is a multiple of 16, 32 at least. With ``passage_words`` also n_shared_words, the words of the
    row in passages of so many words that another row has too, whatever their bytes; none goes for that.
    """
    if length % STEP or length < 2 * STEP:
        raise ValueError("the length must be a multiple of 16, 32 at least")
    texts = _identified(docs)
    rows = stored(texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest", "id"), "texts")
    copied = rows.where(F.col("n_bytes") >= length).groupBy("id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("id")
    long_texts = texts.where(F.octet_length("text") >= length).select("id", "text")
    runs = stored(long_texts.mapInArrow(lambda it: _runs(it, length), "id binary, start long, n int, distance long, anchor long"), "runs")
    place = F.xxhash64("id", "start")
    anchors = runs.where("n > 0").groupBy("anchor").agg(F.min(place).alias("least"), F.max(place).alias("most"), F.count(F.lit(1)).alias("rows")).where("least < most")
    anchors = stored(anchors.select("anchor", (F.col("rows") > HOT).alias("hot")), "anchors")
    shared = stored(runs.where("n > 0").join(anchors, "anchor"), "shared-runs")
    inside = runs.where("n = 0").select("id", "start", F.col("distance").alias("end"))
    suspects = stored(shared.select("id").union(inside.select("id")).distinct(), "suspects")
    wanted = long_texts.join(small(suspects), "id", "left_semi").dropDuplicates(["id"])
    wanted = stored(wanted, "suspect-texts")
    per_text = lambda part: wanted.join(
        part.dropDuplicates(["id", "start"]).groupBy("id").agg(F.collect_list(F.struct("start", "n", "distance", "anchor")).alias("runs")), "id"
    )
    cut = per_text(shared.where("not hot")).mapInArrow(lambda it: _cut(it, length), "anchor long, id binary, start long, n int, distance long, bytes binary")
    found = cut.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda it: _sort_buckets(it, length), "id binary, start long, end long")
    if not anchors.where("hot").isEmpty():
        hashed = stored(per_text(shared.where("hot")).mapInArrow(lambda it: _hashed(it, length), "id binary, start long, suffix long"), "suffixes")
        twice = hashed.groupBy("suffix").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least < most").select("suffix")
        found = found.union(hashed.join(twice, "suffix").select("id", "start", (F.col("start") + length).alias("end")))
    spans = stored(found.union(inside.distinct()), "spans").groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    kind = "id binary, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    removed = stored(wanted.join(spans, "id").mapInArrow(lambda it: _removed(it, with_text), kind), "removed")
    copied = stored(copied.withColumn("copied", F.lit(True)), "copied")
    all_rows = rows.join(copied, "id", "left").join(removed, "id", "left")
    whole = F.col("copied").isNotNull()
    columns = [
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
    ]
    if with_text:
        all_rows = all_rows.join(texts.select("id", F.col("text").cast("binary").alias("whole_text")).dropDuplicates(["id"]), "id")
        columns.append(F.when(whole, F.lit(b"")).otherwise(F.coalesce("kept", "whole_text")).alias("kept"))
    if passage_words is not None:
        all_rows = all_rows.join(shared_passages(texts, passage_words), "id", "left")
        columns.append(F.coalesce("n_shared_words", F.lit(0).cast("long")).alias("n_shared_words"))
    return all_rows.select(*columns)

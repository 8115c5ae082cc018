"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans, which always stay. The field adds spans of the same kinds in forms
that the patterns do not know, and ``secret`` spans (keys, tokens, passwords). It labels words between
white space. Its sequences are whole texts, so secrets of letters only are found as well. Features are the shapes of a word and its
neighbours, its length and the word before; decoding is Viterbi in numpy, all sequences of a slice
together. The field is trained in the driver from a small labelled table (``labelled_table``) that
follows from a seed and templates, the same for any corpus.

Positions are code points, ends exclusive. A null or empty text has no spans. Rows that repeat get the
same spans; whole texts are read.
"""

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vecfold.llm import batches
from vecfold.llm.language import viterbi

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("none", *KINDS)

# The base patterns.
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Templates of the labelled table; a word in braces stands for a drawn value of its kind.
TEMPLATES = (
    "{w} {w} {email} {w} {w}", "{w} {w}: {email}, {w} {w}", "contact {email} or {phone}. {w}", "{w} ({email}) {w} {w} {w}",
    "{w} {w} {phone} {w} {w}", "call {phone}, {w} {w}", "phone: {phone} {w}", "{w} {w} tel {phone}; {w} {w}", "{phone} {w} {card} {w}",
    "{w} {w} {ip} {w} {w}", "host {ip}: {w} {w}", "{w} {ip}, {ip} {w}", "server {ip}. {w} {w}", "{ip} {w} {w} {card}",
    "{w} {w} {card} {w} {w}", "card {card}, {w} {w}", "{w} {card}. {w}", "paid with {card} {w} {w}", "{email} {w} {phone} {w} {ip}",
    "{w} {secret} {w} {w}", "{w} {w} {pair} {w}", "token = {quoted} {w} {w}", "{w} key: {secret}, {w}", "{w} secret = {quoted} {w}",
    "{w} {number} {w} {w}", "{w} version {number}. {w}", "{w} {w} {number} {w} {number} {w}", "{w} {year} {w} {w}", "in {year}, {w} {w} {number}%",
    "{w}{junk} {w}{junk} {number}{junk} {w}{junk}", "{w} | {number} | {w} | {year}", "{w} chapter {number} {w} page {number}", "{w} {w} {w} {w} {w}",
    "{w} = {number} {w} {w}", "{w} {w}={number} {w}", "{w} {time} {w} {w}", "{year}-{two}-{two} {w} {time} {w}", "{w} {w} {number}.{number} {w} {w}",
    "{w} {letters} {w} {w}", "{w} key: {letters}, {w}", "token = {letters} {w} {w}", "{cue} {phrase} {w} {w}", "{w} {cue} {phrase}", "{w} {w}. {cue} {phrase}, {w} {w}",
    "{w} {w} {long} {w} {long} {w}", "{long} {w} {w} {w} {w} {w}", "{w} {link} {w} {w}", "{w} {compound} {w}: {compound} {w}", "{w} ({w} {w}) \"{w} {w}\" {w}", "{w} - {w}/{w} {w}; {w}'{w} {w}",
    "{w} {wide} {w} {wide}", "{wide} {wide} {wide} {wide}", "{w} password {w} {w}", "{w} secret {w} {w} key {w}", "{w}: {w} {long}: {long} {w}",
)


def _values(rng: np.random.Generator) -> dict:
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnoprstuvwyzäéñ"), n))
    pick = lambda *options: options[rng.integers(len(options))]

    def word():
        w = letters(rng.integers(1, 12))
        return pick(w, w, w.capitalize(), w.upper()) + pick("", "", "", ".", ",", "!!", ":")

    def card():
        n = digits(15)
        total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(n))
        n += str(-total % 10)
        return pick(n, " ".join(n[i : i + 4] for i in range(0, 16, 4)), "-".join(n[i : i + 4] for i in range(0, 16, 4)))

    def secret():
        return pick("AKIA" + "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 16)), "".join(rng.choice(list("0123456789abcdef"), rng.integers(16, 42))))

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+49 {a} {b}{c}", f"+33 {a[:1]} {b[:2]} {c[:2]} {a[1:]} {c[2:]}", f"+1-{a}-{b}-{c}", f"{a}.{b}.{c}")

    wide_letters = ["абвгдежзиклмнопрст", "αβγδεζηθικλμνξο", "的一是不了人我在有他这中大来上国", "ابتثجحخدذرز", "कखगघचछजझटठड"]
    return {
        "letters": lambda: "AKIA" + "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), 16)),
        "phrase": lambda: letters(rng.integers(6, 28)), "cue": lambda: pick("password:", "Password:", "passwd:", "pwd:", "passphrase:", "secret:"),
        "long": lambda: pick(str, str.capitalize)(letters(rng.integers(11, 26))) + pick("", "", ".", ","),
        "link": lambda: pick("http://www.", "https://", "www.") + letters(rng.integers(4, 12)) + pick(".com", ".org/", ".de/") + pick("", letters(6), letters(5) + ".html"),
        "compound": lambda: pick("-", "_", "/", ".", "'").join(pick(str, str.capitalize, str.upper)(letters(rng.integers(2, 10))) for _ in range(rng.integers(2, 4))) + pick("", ".", ","),
        "wide": lambda: "".join(rng.choice(list(pick(*wide_letters)), rng.integers(1, 40))) + pick("", "", ".", ","),
        "w": word, "email": lambda: pick(f"{letters(5)}.{digits(2)}@mail{digits(1)}.example.com", f"{letters(6)}@{letters(5)}.org", f"{letters(2)}{digits(3)}@{letters(4)}.co.{letters(2)}"),
        "ip": lambda: ".".join(str(rng.integers(0, 256)) for _ in range(4)), "card": card, "phone": phone, "secret": secret,
        "pair": lambda: pick("password=", "token=", "api_key=", "secret=") + secret(), "quoted": lambda: f'"{secret()}"',
        "number": lambda: digits(rng.integers(1, 8)), "year": lambda: pick("19", "20") + digits(2), "two": lambda: digits(2),
        "time": lambda: f"{digits(2)}:{digits(2)}", "junk": lambda: pick("***", "$$$", "%%%", "###", "&&&"),
    }


KIND_OF = {"email": "email", "ip": "ip", "card": "card", "phone": "phone", "secret": "secret", "pair": "secret", "quoted": "secret", "letters": "secret", "phrase": "secret"}


def labelled_rows(times: int = 24, seed: int = 11) -> list[tuple[str, list[str]]]:
    """(text, label of each word) from the templates."""
    rng = np.random.default_rng(seed)
    values, rows = _values(rng), []
    for template in TEMPLATES * times:
        text, labels = "", []
        for literal, name in re.findall(r"([^{}]*)(?:\{(\w+)\})?", template):
            text += literal
            if name:
                start, value = len(text), values[name]()
                text += value
                if name in KIND_OF:
                    labels.append((start, len(text), KIND_OF[name]))
        words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        rows.append((text, [next((k for s, e, k in labels if s < b and a < e), "none") for a, b in words]))
    return rows


def labelled_table(spark: SparkSession, times: int = 24, seed: int = 11) -> DataFrame:
    """The small labelled table: (text, labels)."""
    return spark.createDataFrame(labelled_rows(times, seed), "text string, labels array<string>")


# Features -----------------------------------------------------------------------------------------

BUCKETS = 1 << 13
# Class of each byte: lower, upper, digit, then marks by themselves, other marks, letters beyond ASCII.
CLASS = np.full(256, 4, np.uint8)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = 1, 2, 3, 1
for _i, _mark in enumerate(b"@.+-=_:/\"'()%*,#"):
    CLASS[_mark] = 5 + _i
MARKED = np.zeros(256, bool)
MARKED[[*range(48, 58), ord("@"), ord("=")]] = True
N_FEATURES = 7


def _features(data: np.ndarray, offsets: np.ndarray):
    """Sequences of a slice: starts and ends of their words, text of each, feature buckets, sequence lengths."""
    starts, ends, text, _ = batches.words_of(data, offsets)
    n = len(starts)
    if not n:
        return starts, ends, text, np.zeros((0, N_FEATURES), np.int64), np.zeros(0, np.int64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    where = np.repeat(starts - first, lengths) + np.arange(lengths.sum())
    chars = data[where]
    classes = CLASS[chars]
    new = np.ones(len(classes), bool)
    new[1:] = classes[1:] != classes[:-1]
    new[first] = True
    run_first = np.searchsorted(np.flatnonzero(new), first)
    run_last = np.append(run_first[1:], new.sum())
    shape = batches.part_hashes(batches.prefix_sums(classes[new]), run_first, run_last)  # runs of a class count once
    full = batches.part_hashes(batches.prefix_sums(classes), first, first + lengths)
    word = batches.part_hashes(batches.prefix_sums(batches.LOWER[chars]), first, first + lengths)
    digits = np.add.reduceat(classes == 3, first, dtype=np.int64)
    follows = np.zeros(n, bool)
    follows[1:] = text[1:] == text[:-1]
    none = np.uint64(0)
    before = lambda h: np.where(follows, np.roll(h, 1), none)
    after = lambda h: np.where(np.append(follows[1:], False), np.roll(h, -1), none)
    size = (np.minimum(lengths, 48) // 3 * 64 + np.minimum(digits, 20)).astype(np.uint64)
    columns = [shape, full, batches.mix(size + np.uint64(1)), before(shape), after(shape), before(word), batches.mix(before(full) + after(full) * np.uint64(3) + shape)]
    features = np.stack([(batches.mix(c + np.uint64(i * 7919 + 1)) % np.uint64(BUCKETS)).astype(np.int64) + i * BUCKETS for i, c in enumerate(columns)], axis=1)
    heads = np.flatnonzero(~follows)
    return starts, ends, text, features, np.diff(np.append(heads, n))


@dataclass
class Field:
    emissions: np.ndarray  # features x labels
    transitions: np.ndarray  # labels x labels


def train(rows: list[tuple[str, list[str]]], steps: int = 150) -> Field:
    """Maximum conditional likelihood with an L2 penalty, by forward-backward and Adam over all sequences."""
    features, labels, lengths = [], [], []
    for text, names in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        starts, _, _, found, sizes = _features(data, np.array([0, len(data)]))
        all_starts = batches.words_of(data, np.array([0, len(data)]))[0]
        features.append(found)
        labels.append([LABELS.index(names[i]) for i in np.searchsorted(all_starts, starts)])
        lengths.append(sizes)
    features, gold, lengths = np.concatenate(features), np.concatenate(labels).astype(np.int64), np.concatenate(lengths)
    used, features = np.unique(features, return_inverse=True)
    features = features.reshape(-1, N_FEATURES)
    n, k, longest = len(lengths), len(LABELS), int(lengths.max())
    at = np.full((n, longest), -1)
    for i, (s, m) in enumerate(zip(np.cumsum(lengths) - lengths, lengths)):
        at[i, :m] = np.arange(s, s + m)
    there = at >= 0
    one_hot = np.eye(k)[gold]
    pair = there[:, 1:]
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (gold[at[:, :-1][pair]], gold[at[:, 1:][pair]]), 1)
    theta = [np.zeros((len(used), k)), np.zeros((k, k))]
    moments = [[np.zeros_like(t), np.zeros_like(t)] for t in theta]
    for step in range(1, steps + 1):
        scores = theta[0][features].sum(axis=1)
        padded = np.where(there[:, :, None], scores[at], 0.0)
        forward, backward = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        forward[:, 0] = padded[:, 0]
        for t in range(1, longest):
            z = forward[:, t - 1][:, :, None] + theta[1]
            top = z.max(axis=1)
            step_on = padded[:, t] + top + np.log(np.exp(z - top[:, None]).sum(axis=1))
            forward[:, t] = np.where(there[:, t][:, None], step_on, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            z = theta[1] + (padded[:, t + 1] + backward[:, t + 1])[:, None, :]
            top = z.max(axis=2)
            step_back = top + np.log(np.exp(z - top[:, :, None]).sum(axis=2))
            backward[:, t] = np.where(there[:, t + 1][:, None], step_back, 0.0)
        total = forward[:, -1].max(axis=1)
        total = total + np.log(np.exp(forward[:, -1] - total[:, None]).sum(axis=1))
        single = np.exp(forward + backward - total[:, None, None])[there]
        order = at[there]
        expected = np.zeros_like(one_hot)
        expected[order] = single
        joint = forward[:, :-1, :, None] + theta[1] + (padded[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        pairs = np.exp(joint[pair]).sum(axis=0)
        up = np.zeros_like(theta[0])
        for j in range(N_FEATURES):
            np.add.at(up, features[:, j], one_hot - expected)
        gradient = [up / n - 1e-4 * theta[0], (gold_pairs - pairs) / n - 1e-4 * theta[1]]
        for i, g in enumerate(gradient):
            moments[i][0] = 0.9 * moments[i][0] + 0.1 * g
            moments[i][1] = 0.99 * moments[i][1] + 0.01 * g * g
            theta[i] = theta[i] + 0.05 * (moments[i][0] / (1 - 0.9**step)) / (np.sqrt(moments[i][1] / (1 - 0.99**step)) + 1e-9)
    emissions = np.zeros((N_FEATURES * BUCKETS, k), np.float32)
    emissions[used] = theta[0]
    return Field(emissions, theta[1])


def decode(field: Field, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Labels of all words of the sequences."""
    scores = sum(field.emissions[features[:, j]] for j in range(N_FEATURES)) if len(features) else np.zeros((0, len(LABELS)))
    return viterbi(scores, np.cumsum(lengths) - lengths, lengths, transitions=field.transitions)


# Spans --------------------------------------------------------------------------------------------


def _luhn(digits: str) -> bool:
    return not sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, ``@`` and domain, from each ``@`` backwards: linear in any text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        found = EMAIL_DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    found = []
    found += [(start, 0, end) for start, end in _emails(text)]
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return sorted(found)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


EDGES = " \t\n\r\v\f.,;:!?\"'()[]{}<>*#$%&|"


def _field_spans(text: str, starts: list[int], ends: list[int], labels: list[int], joins: list[bool], base: list[tuple[int, int, int]]):
    """Runs of one label as spans without marks at their edges, where no base span stands."""
    found, i = [], 0
    while i < len(labels):
        j = i
        while j + 1 < len(labels) and labels[j + 1] == labels[i] and joins[j + 1]:
            j += 1
        if labels[i]:
            s, e = starts[i], ends[j]
            if LABELS[labels[i]] == "secret" and "=" in text[s : e - 1]:
                s = text.rindex("=", s, e - 1) + 1
            keep = EDGES.replace("(", "") if LABELS[labels[i]] == "phone" else EDGES
            while s < e and text[s] in keep:
                s += 1
            while s < e and text[e - 1] in EDGES:
                e -= 1
            if s < e and any(c.isalnum() for c in text[s:e]) and not any(s < b_end and b_start < e for b_start, _, b_end in base):
                found.append((s, labels[i] - 1, e))
        i = j + 1
    return found


def found_spans(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, the numbers of base spans by kind, base_sha256 and all spans of every row."""

    def per_batch(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batch_iter:
            column = batch.column("text")
            for begin, end, data, offsets in batches.text_slices(column):
                n = end - begin
                counts, digests, spans = np.zeros((n, 4), np.int64), [nothing] * n, [""] * n
                starts, ends, text, features, lengths = _features(data, offsets)
                labels = decode(field, features, lengths)
                joins = np.ones(len(labels), bool)
                joins[np.cumsum(lengths) - lengths] = False
                first = np.searchsorted(text, np.arange(n + 1))
                # Base spans hold a digit or an @, so texts without a marked byte have none.
                marked = np.concatenate([[0], np.cumsum(MARKED[data])])[offsets]
                worth = np.diff(marked) > 0
                worth[text[labels > 0]] = True
                for i in np.flatnonzero(worth).tolist():
                    string = column[begin + i].as_py()
                    base = base_spans(string) if marked[i + 1] > marked[i] else []
                    own = slice(first[i], first[i + 1])
                    more = []
                    if labels[own].any():
                        inside = (data[offsets[i] : offsets[i + 1]] & 0xC0) != 0x80
                        points = np.concatenate([[0], np.cumsum(inside)])
                        at = points[starts[own] - offsets[i]].tolist(), points[ends[own] - offsets[i]].tolist()
                        more = _field_spans(string, *at, labels[own].tolist(), joins[own].tolist(), base)
                    for _, kind, _ in base:
                        counts[i, kind] += 1
                    if base:
                        digests[i] = hashlib.sha256(_joined(base).encode()).hexdigest()
                    if base or more:
                        spans[i] = _joined(sorted(base + more))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(begin, n), *[pa.array(counts[:, k]) for k in range(4)], pa.array(digests), pa.array(spans)],
                    ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(per_batch, f"doc_id {kind}, {columns}")


def personal_data(docs: DataFrame) -> DataFrame:
    rows = [(r["text"], r["labels"]) for r in labelled_table(docs.sparkSession).collect()]  # the table's own size, a few hundred rows
    return found_spans(docs, train(rows))

"""Quality rules with the perplexity of a character n-gram model.

Spark counts every n-gram of ``ORDER`` characters of all distinct texts by language and derives from these counts the
modified Kneser-Ney probabilities of all orders (interpolated, three discounts per order and
language). The model is held as sorted arrays of n-gram hashes with their log-probabilities and, for contexts,
their back-off weights; the leading bits of a hash tell where to look it up. A model of more than ``BROADCAST_ENTRIES`` entries is
sent in slices, for each of which the texts are read once; beyond ``MOST_SLICES`` n-grams counted per text are joined with it instead.

A text is rejected if its perplexity lies outside the band of its language: the median of that language's
distinct texts, with ``WIDTHS`` times their robust deviation, which grows for short texts as a mean of
few characters does. Copies of a text count once in the model and in the band, so a text that most rows repeat
does not decide what is usual.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import row_key, stored, whole_text
from stemma.llm.text_arrays import RangeHash, random_bits, scrambled, word_hashes

ORDER = 5
#: Entries (at most 20 bytes each while sent) of a model that tasks hold in memory.
BROADCAST_ENTRIES = 6_000_000
#: Slices of at most so many entries that the texts are read for.
MOST_SLICES = 16
#: Deviations that a text may lie below and above the median. Passages that many texts share are well known to the
#: model and pull clean texts down, so the lower side is wider.
WIDTHS = (5.5, 2.6)
#: Stands before the first character of a text; in a text it is read as U+FFFD.
EDGE = 0x02
#: Distinct n-grams that a counting task holds before it sends them.
HELD_GRAMS = 1_000_000
#: Distinct characters that a packed n-gram can tell apart, and characters that are counted at once.
LETTERS, PART = 1 << 12, 1 << 20
#: Characters that are scored at once: few enough that the arrays made for them stay in the processor's cache.
SCORED = 1 << 16
#: Places of the bit map that marks texts which may have copies; 8 MB at any size of the input.
SLOTS = 1 << 26

# The base rules.
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, REPEAT_PERCENT = 8, 20, 30


def code_points(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another with ``order - 1`` edges before each, and where each ends."""
    edge = chr(EDGE) * (order - 1)
    cleaned = [edge + (t.replace(chr(EDGE), "�") if chr(EDGE) in t else t) for t in texts]
    points = np.frombuffer("".join(cleaned).encode("utf-32-le", "replace"), dtype="<u4")
    return points, np.cumsum([len(t) for t in cleaned])


class _Counter:
    """Counts of n-grams, packed as numbers under an alphabet that grows with the characters met."""

    def __init__(self, order: int):
        self.order = order
        self.reset()

    def reset(self) -> None:
        self.number = np.full(0x110000, -1, dtype=np.int16)
        self.letters = np.zeros(0, dtype=np.uint32)
        self.keys = np.zeros(0, dtype=np.uint64)
        self.counts = np.zeros(0, dtype=np.int64)

    def add(self, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Counts the windows of ``points`` that end on a character; gives what is held when it is full."""
        order = self.order
        new = np.unique(points[self.number[points] < 0])
        if len(self.letters) + len(new) > LETTERS:
            if len(self.keys):
                yield self.take()
            new = np.unique(points)
            if len(new) > LETTERS:
                half = len(points) // 2
                yield from self.add(points[: half + order - 1])
                yield from self.add(points[half:])
                return
        self.number[new] = np.arange(len(self.letters), len(self.letters) + len(new), dtype=np.int16)
        self.letters = np.concatenate([self.letters, new])
        ids = self.number[points].astype(np.uint64)
        count = len(points) - order + 1
        keys = np.zeros(max(count, 0), dtype=np.uint64)
        for k in range(order):
            keys = keys * np.uint64(LETTERS) + ids[k : k + max(count, 0)]
        keys = np.sort(keys[points[order - 1 :] != EDGE])
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        counts = np.diff(np.concatenate([first, [len(keys)]]))
        merged = np.concatenate([self.keys, keys[first]])
        at = np.argsort(merged, kind="stable")
        merged, counts = merged[at], np.concatenate([self.counts, counts])[at]
        first = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]])) if len(merged) else first
        self.keys = merged[first]
        self.counts = np.add.reduceat(counts, first) if len(first) else counts
        if len(self.keys) > HELD_GRAMS:
            yield self.take()

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams held, as rows of characters, and their counts; starts anew."""
        rest, columns = self.keys, []
        for _ in range(self.order):
            columns.append(self.letters[(rest % np.uint64(LETTERS)).astype(np.int64)])
            rest = rest // np.uint64(LETTERS)
        out = np.stack(columns[::-1], axis=1) if len(self.keys) else np.zeros((0, self.order), np.uint32), self.counts
        self.reset()
        return out


def _strings(grams: np.ndarray) -> pa.Array:
    width = grams.shape[1]
    text = np.ascontiguousarray(grams, dtype="<u4").tobytes().decode("utf-32-le")
    return pa.array([text[a : a + width] for a in range(0, len(text), width)], pa.string())


def _grouped(texts: list[str], size: int = PART) -> Iterator[list[str]]:
    """The texts in groups of about ``size`` characters, a longer text alone."""
    group, held = [], 0
    for text in texts:
        if group and held + len(text) > size:
            yield group
            group, held = [], 0
        group.append(text)
        held += len(text)
    if group:
        yield group


def distinct_texts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Distinct (lang, text), whole texts compared; only texts that may have copies are shuffled.

    Hashes that come twice are marked in a bit map of fixed size. A text whose bit is not set has no copy; of the others, which
    grow to all texts where the map gets full, copies are dropped by comparing them.
    """
    rows = docs.select(language(F.col(lang_col)), F.col(text_col).cast("string").alias("text")).where("text <> ''")
    rows = rows.withColumn("hash", F.xxhash64("lang", "text"))
    slot = F.pmod(F.col("hash"), F.lit(SLOTS)) + 1
    twice = rows.groupBy("hash").count().where("count > 1").select(slot.alias("slot"))
    marked = twice.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )
    bits = np.zeros(max(SLOTS // 8, 4096), dtype=np.uint8)
    for bucket, found in marked.collect():
        bits[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(found, dtype=np.uint8)[: len(bits)]
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def may_repeat(slots: pd.Series) -> pd.Series:
        at = slots.to_numpy() - 1
        return pd.Series((sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    told = rows.withColumn("may_repeat", may_repeat(slot))
    once, again = (told.where(c).select("lang", "text") for c in (~F.col("may_repeat"), F.col("may_repeat")))
    return once.unionAll(again.distinct())


def count_grams(docs: DataFrame, order: int = ORDER, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, gram, n) of every ``order``-gram of all distinct texts; a task adds up its own before the shuffle.

    A task works on about ``PART`` characters at once, so its memory follows neither the batches of rows nor their texts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, _Counter] = {}

        def batch_of(lang: str, grams: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(grams), 200_000):
                rows = _strings(grams[a : a + 200_000])
                columns = [pa.array([lang] * len(rows), pa.string()), rows, pa.array(counts[a : a + 200_000])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])

        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                counter = counters.setdefault(lang, _Counter(order))
                for group in _grouped(texts):
                    points, _ = code_points(group, order)
                    for a in range(0, len(points), PART):
                        for full in counter.add(points[max(0, a - order + 1) : a + PART]):
                            yield from batch_of(lang, *full)
        for lang, counter in counters.items():
            yield from batch_of(lang, *counter.take())

    rows = distinct_texts(docs, lang_col, text_col)
    return rows.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def language(lang: Column) -> Column:
    """The language, empty where it is null."""
    return F.coalesce(lang.cast("string"), F.lit("")).alias("lang")


def _tail(k: int) -> Column:
    return F.substring("gram", 2, k - 1)


def _discounts(grams: DataFrame) -> DataFrame:
    """Per language the three discounts of modified Kneser-Ney, from how many n-grams have count 1 to 4."""
    n = [F.sum((F.col("n") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)]
    found = grams.groupBy("lang").agg(*n)
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def discount(i: int) -> Column:
        value = i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}"))
        # Where counts of counts are missing, half of the count; never more than is there.
        return F.when((F.col("n1") > 0) & (value > 0) & (value < i), value).otherwise(F.lit(i / 2)).alias(f"d{i}")

    safe = found.withColumn("n1", F.when(F.col("n1") > 0, F.col("n1")).otherwise(F.lit(1e-9)))
    return safe.select("lang", discount(1), discount(2), discount(3))


def model_tables(grams: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """For orders 1 to ``order``: (lang, gram, log_p) and (lang, context, log_backoff), as stored tables."""
    counted = {order: stored(grams, "lm-grams")}
    for k in range(order - 1, 0, -1):  # lower orders count in how many contexts an n-gram goes on
        counted[k] = stored(
            counted[k + 1].groupBy("lang", _tail(k + 1).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "lm-grams"
        )
    letters = counted[1].groupBy("lang").agg((F.lit(1.0) / (F.count(F.lit(1)) + 1)).alias("lower"))
    out: list[tuple[DataFrame, DataFrame]] = []
    for k in range(1, order + 1):
        # Figures of a language (one row each) go to the n-grams, which would meet in one task per language otherwise.
        rows = counted[k].join(F.broadcast(_discounts(counted[k])), "lang").withColumn(
            "d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        ).withColumn("context", F.substring("gram", 1, k - 1))
        contexts = stored(
            rows.groupBy("lang", "context")
            .agg(F.sum("n").alias("total"), F.sum("d").alias("taken"))
            .withColumn("backoff", F.col("taken") / F.col("total")),
            "lm-contexts",
        )
        if k == 1:
            lower = rows.join(F.broadcast(letters), "lang")
        else:
            shorter = out[-1][0].select("lang", F.col("gram").alias("tail"), F.exp("log_p").alias("lower"))
            lower = rows.withColumn("tail", _tail(k)).join(shorter, ["lang", "tail"])
        p = (F.col("n") - F.col("d")) / F.col("total") + F.col("backoff") * F.col("lower")
        scored = lower.join(contexts, ["lang", "context"]).select("lang", "gram", F.log(p).alias("log_p"))
        out.append((stored(scored, "lm-model"), contexts.select("lang", "context", F.log("backoff").alias("log_backoff"))))
    return out


FACTORS = random_bits(16, 21) | np.uint64(1)


def _gram_hash(points: np.ndarray, width: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the windows of ``width`` characters that begin at ``starts``, or of all."""
    wide = points.astype(np.uint64) + np.uint64(1)
    total = np.full(max(0, len(points) - width + 1) if starts is None else len(starts), width, dtype=np.uint64)
    for k in range(width):
        total += (wide[k : len(total) + k] if starts is None else wide[starts + k]) * FACTORS[k]
    return scrambled(total)


def _entries(hashes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending hashes, their values, and where the hashes with each value of the leading bits begin.

    Plain arrays, as a broadcast value is pickled by reference to its classes.
    """
    order = np.argsort(hashes)
    bits = max(1, (len(hashes) - 1).bit_length())
    held = np.bincount((hashes >> np.uint64(64 - bits)).view(np.int64), minlength=1 << bits)
    first = np.concatenate([[0], np.cumsum(held)[:-1]]).astype(np.int32)
    # The largest number stands behind all hashes, so that a search ends there.
    return np.append(hashes[order], ~np.uint64(0)), values[order], first


def hash_arrays(tables: list[tuple[DataFrame | None, DataFrame | None]]) -> dict:
    """The model as sorted arrays: (language, order, is it a context) to :func:`_entries`; a table that is None is left out.

    Called for at most ``BROADCAST_ENTRIES`` entries.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(1).to_pylist()
            width = len(grams[0]) if grams else 0
            points = np.frombuffer("".join(grams).encode("utf-32-le"), dtype="<u4")
            hashes = _gram_hash(points, width)[::width] if width else np.zeros(len(grams), dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(hashes.view(np.int64)), batch.column(2)], ["lang", "hash", "value"]
            )

    out = {}
    for k, (grams, contexts) in enumerate(tables, start=1):
        for context, table in ((False, grams), (True, contexts)):
            if table is None or context and k == 1:
                continue  # the empty context is used by no shorter order
            name, value = table.columns[1:]
            rows = table.select("lang", name, F.col(value).cast("float").alias("value"))
            found = rows.mapInArrow(hashed, "lang string, hash long, value float").toArrow()
            lang = np.array(found.column("lang").to_pylist(), dtype=object)
            hashes = found.column("hash").to_numpy().view(np.uint64)
            values = found.column("value").to_numpy().astype(np.float32)
            for one in set(lang.tolist()):
                at = np.flatnonzero(lang == one)
                out[one, k, context] = _entries(hashes[at], values[at])
    return out


def _look_up(entries: tuple[np.ndarray, ...] | None, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the hashes are there, and the values of these; hashes are spread evenly, so few steps lead on from ``first``."""
    if entries is None:
        return np.zeros(len(wanted), dtype=bool), np.zeros(0, dtype=np.float32)
    hashes, values, first = entries
    at = first[(wanted >> np.uint64(65 - len(first).bit_length())).view(np.int64)]
    found = hashes[at]
    before = np.flatnonzero(found < wanted)
    while len(before):
        at[before] += 1
        found[before] = hashes[at[before]]
        before = before[found[before] < wanted[before]]
    known = (found == wanted) & (at < len(values))
    return known, values[at[known]]


def log_probabilities(points: np.ndarray, lang: str, model: dict, order: int = ORDER) -> np.ndarray:
    """Log-probability of each character from the ``order``-th on, backing off where an n-gram is unknown; 0 for an edge."""
    out = np.zeros(max(0, len(points) - order + 1), dtype=np.float64)
    left = np.flatnonzero(points[order - 1 :] != EDGE)
    hashes = _gram_hash(points, order)[left]
    for k in range(order, 0, -1):
        known, value = _look_up(model.get((lang, k, False)), hashes)
        out[left[known]] += value
        left = left[~known]
        if not len(left):
            return out
        if k > 1:
            known, value = _look_up(model.get((lang, k, True)), _gram_hash(points, k - 1, left + order - k))
            out[left[known]] += value
            hashes = _gram_hash(points, k - 1, left + order - k + 1)
    letters = model.get((lang, 1, False))
    out[left] -= np.log(2.0 + (len(letters[1]) if letters else 0))
    return out


def known_log_probabilities(points: np.ndarray, lang: str, model: dict, order: int = ORDER) -> np.ndarray:
    """As :func:`log_probabilities` for n-grams of the highest order in ``model``; 0 for others."""
    out = np.zeros(max(0, len(points) - order + 1), dtype=np.float64)
    left = np.flatnonzero(points[order - 1 :] != EDGE)
    known, value = _look_up(model.get((lang, order, False)), _gram_hash(points, order)[left])
    out[left[known]] = value
    return out


def _scores(texts: list[str], lang: str, model: dict, order: int, log_probability: Callable[..., np.ndarray]) -> np.ndarray:
    """Per text the sums of -log p and its square."""
    points, ends = code_points(texts, order)
    sums = np.zeros((len(texts), 2))
    for a in range(0, len(points), SCORED):
        stop = min(a + SCORED, len(points))
        first = max(0, a - order + 1)
        log_p = -log_probability(points[first:stop], lang, model, order)
        lengths = np.diff(np.clip(ends, first + order - 1, stop), prepend=first + order - 1)
        owner = np.repeat(np.arange(len(texts)), lengths)
        sums[:, 0] += np.bincount(owner, log_p, minlength=len(texts))
        sums[:, 1] += np.bincount(owner, log_p * log_p, minlength=len(texts))
    return sums


def text_scores(
    langs: list[str], texts: list[str], model: dict, order: int, log_probability: Callable[..., np.ndarray] = log_probabilities
) -> np.ndarray:
    """Per row the sums of -log p and its square; about ``SCORED`` characters of one language at once."""
    sums = np.zeros((len(texts), 2))
    for lang in dict.fromkeys(langs):
        rows = [i for i in range(len(texts)) if langs[i] == lang and texts[i]]
        if rows:
            groups = _grouped([texts[i] for i in rows], SCORED)
            sums[rows] = np.concatenate([_scores(g, lang, model, order, log_probability) for g in groups])
    return sums


def base_figures(text: str, hasher: RangeHash) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    data = text.encode("utf-8", "replace")
    words = next(word_hashes([data], hasher))
    n = len(words)
    blank = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = text.split("\n")
    repeated_lines = 0
    if len(lines) > 1:
        seen = set()
        for line in lines:
            if line in seen:
                repeated_lines += 1
            elif line.strip(" \t\x0b\x0c\r"):
                seen.add(line)
    covered = 0
    if n > WINDOW:
        total = np.full(n - WINDOW + 1, 1, dtype=np.uint64)
        factors = random_bits(WINDOW, 31) | np.uint64(1)
        for k in range(WINDOW):
            total += words[k : n - WINDOW + 1 + k] * factors[k]
        order = np.sort(total)
        again = order[1:][order[1:] == order[:-1]]
        if len(again):
            twice = np.isin(total, again)
            change = np.zeros(n + 1, dtype=np.int64)
            change[:-WINDOW] += twice
            change[WINDOW:] -= twice
            covered = int((np.cumsum(change[:-1]) > 0).sum())
    return n, len(text) - blank, symbols, repeated_lines, covered


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def figures(
    docs: DataFrame, model: dict | None, order: int = ORDER, id_col: str = "doc_id", lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, key, digest, lang, the base figures, n_scored, and with a model the sums of -log p and its square."""
    kind = docs.schema[id_col].dataType.simpleString()
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model) if model is not None else None

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = RangeHash()
        for batch in batches:
            langs = batch.column(3).to_pylist()
            texts = [t or "" for t in batch.column(4).to_pylist()]
            base = np.array([base_figures(t, hasher) for t in texts], dtype=np.int64).reshape(-1, 5)
            size = np.array([len(t) for t in texts], dtype=np.int64)
            sums = np.zeros((len(texts), 2)) if sent is None else text_scores(langs, texts, sent.value, order)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in range(4)], *[pa.array(base[:, k]) for k in range(5)],
                    pa.array(size), pa.array(sums[:, 0]), pa.array(sums[:, 1]),
                ],
                ["doc_id", "key", "digest", "lang", *FIGURES, "n_scored", "nats", "squares"],
            )

    rows = docs.select(
        F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("key"),
        F.unhex(F.md5(whole_text(F.col(text_col)))).alias("digest"), language(F.col(lang_col)),
        F.col(text_col).cast("string").alias("text"),
    )
    longs = ", ".join(f"{c} long" for c in [*FIGURES, "n_scored"])
    return rows.mapInArrow(measure, f"doc_id {kind}, key long, digest binary, lang string, {longs}, nats double, squares double")


def _keyed_texts(docs: DataFrame, id_col: str, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("key"),
        language(F.col(lang_col)), F.col(text_col).cast("string").alias("text"),
    )


def sliced_scores(
    docs: DataFrame, grams: DataFrame, slices: int, order: int = ORDER, id_col: str = "doc_id", lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, key, lang, nats, squares), each once, from the highest order of a model that tasks hold one slice of at a time.

    The model is trained on all texts of ``docs``, so each n-gram is in one slice and the sums of the slices add up.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows, parts = _keyed_texts(docs, id_col, lang_col, text_col), []
    for k in range(slices):
        part = grams.where(F.pmod(F.xxhash64("lang", "gram"), F.lit(slices)) == k)
        sent = docs.sparkSession.sparkContext.broadcast(hash_arrays([(None, None)] * (order - 1) + [(part, None)]))

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [t or "" for t in batch.column(3).to_pylist()]
                sums = text_scores(batch.column(2).to_pylist(), texts, sent.value, order, known_log_probabilities)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in range(3)], pa.array(sums[:, 0]), pa.array(sums[:, 1])],
                    ["doc_id", "key", "lang", "nats", "squares"],
                )

        scored = rows.mapInArrow(score, f"doc_id {kind}, key long, lang string, nats double, squares double")
        parts.append(stored(scored, "lm-slice"))
        sent.destroy()
    # Each copy of a row has a row per slice, and copies have equal sums.
    mean = [(F.avg(c) * slices).alias(c) for c in ("nats", "squares")]
    return reduce(DataFrame.unionAll, parts).groupBy("doc_id", "key", "lang").agg(*mean)


def joined_scores(
    docs: DataFrame, grams: DataFrame, order: int = ORDER, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text",
) -> DataFrame:
    """(doc_id, key, lang, nats, squares) by joining each row's n-grams with the highest order of a model of any size.

    The model is trained on all texts of ``docs``, so each n-gram is there and none backs off.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def own_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(3)):
                points, _ = code_points([text.as_py() or ""], order)
                for a in range(0, max(1, len(points) - order + 1), PART):
                    part = points[a : a + PART + order - 1]
                    if len(part) < order:
                        continue
                    grams, n = np.unique(np.lib.stride_tricks.sliding_window_view(part, order), axis=0, return_counts=True)
                    at = pa.array(np.full(len(n), i))
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(c).take(at) for c in range(3)], _strings(grams), pa.array(n.astype(np.int64))],
                        ["doc_id", "key", "lang", "gram", "n"],
                    )

    rows = _keyed_texts(docs, id_col, lang_col, text_col)
    own = rows.mapInArrow(own_grams, f"doc_id {kind}, key long, lang string, gram string, n long")
    # Rows of a frequent n-gram are on the left of a left join, where they split.
    return own.join(grams, ["lang", "gram"], "left").groupBy("doc_id", "key", "lang").agg(
        F.sum(-F.col("n") * F.col("log_p")).alias("nats"), F.sum(F.col("n") * F.col("log_p") ** 2).alias("squares")
    )


def bands(measured: DataFrame) -> DataFrame:
    """Per language: the median of -log p per character, the deviation of texts, and that of one character.

    Taken over all distinct texts that pass the base rules; copies, sketches and sums are combined before the shuffle.
    """
    texts = measured.where("not base_failed and n_scored > 0").groupBy("lang", "digest").agg(
        *[F.min(c).alias(c) for c in ("nats", "squares", "n_scored")]
    )
    rows = texts.withColumn("mean", F.col("nats") / F.col("n_scored"))
    middle = rows.groupBy("lang").agg(
        F.percentile_approx("mean", F.lit(0.5), F.lit(10_000)).alias("middle"),
        F.sum("nats").alias("all_nats"), F.sum("squares").alias("all_squares"), F.sum("n_scored").alias("chars"),
    )
    own = F.col("all_nats") / F.col("chars")
    noise = F.sqrt(F.greatest(F.col("all_squares") / F.col("chars") - own * own, F.lit(0.0)))
    middle = middle.select("lang", "middle", noise.alias("noise"))
    away = rows.join(F.broadcast(middle), "lang").groupBy("lang").agg(
        (F.percentile_approx(F.abs(F.col("mean") - F.col("middle")), F.lit(0.5), F.lit(10_000)) * 1.4826).alias("spread")
    )
    return middle.join(away, "lang")


def _same_rows(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """``left`` with the other columns of the row of ``right`` that has its doc_id, which may be null, key and lang."""
    right = right.withColumnsRenamed({"doc_id": "of", "key": "of_key", "lang": "of_lang"})
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")) & (F.col("lang") == F.col("of_lang"))
    return left.join(right, same, how).drop("of", "of_key", "of_lang")


def judged(
    docs: DataFrame, order: int = ORDER, widths: tuple[float, float] = WIDTHS, broadcast_entries: int = BROADCAST_ENTRIES,
    id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base figures, base_failed, kept, perplexity and the band's edges.

    The model is trained on all distinct texts of ``docs``, which must give the same rows each time it is read. A null text has no words and fails the base rules; its
    perplexity is null. A null language is a language of its own. Repeated rows get equal results.
    """
    # Every n-gram of these texts is in the highest order; nothing backs off, so lower orders and contexts are not sent.
    grams, _ = model_tables(count_grams(docs, order, lang_col, text_col), order)[-1]
    slices = -(-grams.count() // broadcast_entries) if broadcast_entries else MOST_SLICES + 1
    model = hash_arrays([(None, None)] * (order - 1) + [(grams, None)]) if slices <= 1 else None
    measured = figures(docs, model, order, id_col, lang_col, text_col)
    if slices > 1:
        if slices <= MOST_SLICES:
            scores = sliced_scores(docs, grams, slices, order, id_col, lang_col, text_col)
        else:
            key = ["doc_id", "key", "lang"]
            copies = _keyed_texts(docs, id_col, lang_col, text_col).groupBy(*key).agg(F.count(F.lit(1)).alias("copies"))
            scores = joined_scores(docs, grams, order, id_col, lang_col, text_col)
            scores = _same_rows(scores, copies, "inner").select(
                *key, (F.col("nats") / F.col("copies")).alias("nats"), (F.col("squares") / F.col("copies")).alias("squares")
            )
        measured = _same_rows(measured.drop("nats", "squares"), scores, "left").fillna(0.0, ["nats", "squares"])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    measured = stored(measured.withColumn("base_failed", failed), "lm-measured")
    # One row per language on the right goes to all texts.
    rows = measured.join(F.broadcast(bands(measured)), "lang", "left").withColumn(
        "mean", F.when(F.col("n_scored") > 0, F.col("nats") / F.col("n_scored"))
    )
    deviation = F.sqrt(F.col("spread") ** 2 + F.try_divide(F.col("noise") ** 2, F.col("n_scored")))
    lowest, highest = F.col("middle") - widths[0] * deviation, F.col("middle") + widths[1] * deviation
    inside = (F.col("mean") >= lowest) & (F.col("mean") <= highest)
    return rows.select(
        "doc_id", *FIGURES, "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"),
        F.exp("mean").alias("perplexity"), F.exp(lowest).alias("lowest"),
        F.exp(highest).alias("highest"),
    )

"""Secrets: fixed patterns, and two character Markov models compared by log-likelihood ratio.

The models are trained from labelled samples. Random: values that the fixed patterns find in all texts, and drawn strings of the usual
alphabets. Ordinary: what is outside of those values in all texts (words, and identifiers made of neighbouring words in the usual
styles, with dates and versions), and a short list of tokens. Spark counts the pairs of characters of both. A model is a table of
pairs with an edge before and after a string, so its size does not depend on the input.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What the base patterns are, in the order in which kinds are listed.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: Strings that the models judge: so many characters of an identifier, with a digit or a change of case.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Words that train the model of ordinary identifiers.
ORDINARY = r"[A-Za-z]{2,24}"
#: Of so many neighbouring words one identifier is made.
JOINED = 4
#: Ordinary tokens with digits, joined with words as dates, versions and numbers are.
TOKENS = (
    "2024/01/15", "2019-12-31", "20230607", "v1", "v2", "v3", "1.0", "2.10.3", "utf8", "utf-8", "sha256", "md5", "base64",
    "http2", "x86_64", "win32", "amd64", "i18n", "k8s", "s3", "ec2", "ipv4", "mp3", "log4j2", "rfc2822", "iso8601",
    "en-US", "page-12", "chapter_3", "item-42", "Test2", "Bar2", "part1", "step10", "vol3", "q4", "fy2023", "1990s",
)
#: How often a token counts, and how many strings are drawn of each alphabet.
TOKEN_WEIGHT, DRAWN = 200, 400
#: Fixed value: an identifier of 128 bits in its usual form is no secret.
UUID = r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
#: Log-likelihood ratio per character above which a string is random, beside ``LEAST_RATIO``.
MARGIN = 2.0
#: Characters of the models: all others are one more.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Added to each pair's count in the models of ordinary and of random strings: random ones come close to uniform.
SMOOTHING = (0.05, 5.0)
#: A string needs so much more in all, so that short ones need more per character.
LEAST_RATIO = 8.0
#: States of a model: the alphabet, all others, and the edge of a string.
STATES = len(ALPHABET) + 2


def _patterns() -> dict[str, re.Pattern]:
    return {
        "assign": re.compile(ASSIGN, re.IGNORECASE | re.ASCII), "access": re.compile(ACCESS),
        # A run of the least length starts where the whole run starts, so short runs need not be matched.
        "hex": re.compile(HEX[:-1] + "{%d,}" % LEAST["hex"]),
        "candidate": re.compile(CANDIDATE), "ordinary": re.compile(ORDINARY),
    }


def assignments(text: str, patterns: dict[str, re.Pattern]) -> list[re.Match]:
    """Matches of the assign pattern whose value is long enough."""
    low = text.lower()
    if not any(part in low for part in ("passw", "secret", "token", "api")):  # no match without one of these
        return []
    return [m for m in patterns["assign"].finditer(text) if len(m[2]) >= LEAST["assign"]]


def base_spans(text: str, patterns: dict[str, re.Pattern]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns: leftmost and not overlapping per kind, short ones dropped."""
    out = [(m.start(), 0, m.end()) for m in assignments(text, patterns)]
    if "AKIA" in text:
        for m in patterns["access"].finditer(text):
            if m.end() - m.start() >= LEAST["access"]:
                out.append((m.start(), 1, m.end()))
    for m in patterns["hex"].finditer(text):
        out.append((m.start(), 2, m.end()))
    return sorted(out)


def _codes() -> np.ndarray:
    table = np.full(128, len(ALPHABET), dtype=np.int64)
    for i, c in enumerate(ALPHABET):
        table[ord(c)] = i
    return table


def pair_indices(words: list[str], codes: np.ndarray) -> np.ndarray:
    """Numbers of the character pairs of the words, each with an edge before and after it."""
    edge = STATES - 1
    joined = np.frombuffer("\x00".join(["", *words, ""]).encode("ascii", "replace"), dtype=np.uint8)
    states = np.where(joined == 0, edge, codes[np.minimum(joined, 127)])
    pairs = states[:-1] * STATES + states[1:]
    return pairs[pairs != edge * STATES + edge]


def identifiers(words: list[str]) -> list[str]:
    """Identifiers of each ``JOINED`` neighbouring words, in one of the usual styles by turns; some end in a token."""
    made = []
    for k in range(0, len(words) - JOINED + 1, JOINED):
        some, token = words[k : k + JOINED], TOKENS[(k // JOINED) % len(TOKENS)]
        titled = [w[:1].upper() + w[1:].lower() for w in some]
        style = (k // JOINED) % 7
        made.append(
            "_".join(some) if style == 0 else "-".join(some) if style == 1 else "/".join(some) if style == 2
            else "".join(titled) if style == 3 else some[0].lower() + "".join(titled[1:]) if style == 4
            else "/" + token + "/" + "-".join(some) if style == 5 else "_".join(some).upper() + "-" + token
        )
    return made


def outside(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with its spans cut out."""
    parts, at = [], 0
    for a, _, b in spans:
        parts.append(text[at:a])
        at = max(at, b)
    return " ".join([*parts, text[at:]])


def drawn_samples() -> list[str]:
    """Random strings of 20 to 64 characters of the usual alphabets, the same in every run."""
    rng = random.Random(20)
    letters = ALPHABET[:62]
    alphabets = (letters, letters + "+/", letters + "_-", "0123456789abcdef", letters[26:], letters[:26] + "0123456789")
    return ["".join(rng.choices(a, k=rng.randint(20, 64))) for a in alphabets for _ in range(DRAWN)]


def dated_samples() -> list[str]:
    """Ordinary tokens of digits: dates, times and versions, the same in every run."""
    rng = random.Random(21)
    forms = ("{0}-{1:02}-{2:02}T{3:02}-{4:02}-{5:02}", "{0}/{1:02}/{2:02}", "{0}{1:02}{2:02}_{3:02}{4:02}{5:02}", "v{1}-{2}-{3}", "{0}-{1:02}-{2:02}")
    limits = (1, 12, 28, 23, 59, 59)
    return [f.format(rng.randint(1990, 2035), *[rng.randint(1, m) for m in limits[1:]]) for f in forms for _ in range(DRAWN)]


def count_pairs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(label, pair, n): character pairs of random (1) and ordinary (0) strings over all texts.

    A task sends one row per pair, so the counts of any input fit in a few thousand rows per task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, codes = _patterns(), _codes()
        found = np.zeros((2, STATES * STATES), dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                text = value.as_py() or ""
                if not text:
                    continue
                spans = base_spans(text, patterns)
                drawn = [text[a:b] for a, kind, b in spans if kind]
                drawn += [m[2] for m in assignments(text, patterns)]
                words = patterns["ordinary"].findall(outside(text, spans) if spans else text)
                for label, strings in ((1, drawn), (0, words + identifiers(words))):
                    if strings:
                        found[label] += np.bincount(pair_indices(strings, codes), minlength=STATES * STATES)
        label, pair = np.nonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(label, pa.int32()), pa.array(pair, pa.int32()), pa.array(found[label, pair])], ["label", "pair", "n"]
        )

    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(count, "label int, pair int, n long")
    return counted.groupBy("label", "pair").agg(F.sum("n").alias("n"))


def log_ratio(counts: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of random over ordinary per character pair, from at most 2 x ``STATES``**2 counts."""
    table = np.broadcast_to(np.reshape(SMOOTHING, (2, 1, 1)), (2, STATES, STATES)).copy()
    for label, pair, n in counts.collect():
        table[label, pair // STATES, pair % STATES] += n
    for label, strings, weight in ((1, drawn_samples(), 1), (0, list(TOKENS), TOKEN_WEIGHT), (0, dated_samples(), 1)):
        counted = np.bincount(pair_indices(strings, _codes()), minlength=STATES * STATES)
        table[label] += weight * counted.reshape(STATES, STATES)
    probability = np.log(table / table.sum(axis=2, keepdims=True))
    return (probability[1] - probability[0]).reshape(-1)


def is_random(word: str, ratio: np.ndarray, codes: np.ndarray, margin: float = MARGIN) -> bool:
    """Whether the models call a string random; strings of letters in one case or of digits alone and UUIDs never are."""
    digits = sum(c.isdigit() for c in word)
    if digits == len(word) or (not digits and (word.islower() or word.isupper() or word.istitle())):
        return False
    if re.fullmatch(UUID, word):
        return False
    return float(ratio[pair_indices([word], codes)].sum()) > margin * len(word) + LEAST_RATIO


def find_secrets(
    docs: DataFrame, ratio: np.ndarray, margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are code points, end exclusive. The models add candidates that no base span touches, as kind
    random. A null text is empty: no spans. Repeated rows get equal results. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, codes = _patterns(), _codes()

        def told(spans: list[tuple[int, int, int]]) -> str:
            return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

        for batch in batches:
            counts, digest, every = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text, patterns)
                counts.append([sum(k == kind for _, k, _ in base) for kind in range(3)])
                digest.append(hashlib.sha256(told(base).encode()).hexdigest())
                more = []
                for m in patterns["candidate"].finditer(text):
                    a, b = m.span()
                    if all(b <= x or y <= a for x, _, y in base) and is_random(m[0], ratio, codes, margin):
                        more.append((a, 3, b))
                every.append(told(sorted(base + more)))
            table = np.array(counts, dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(table[:, k]) for k in range(3)], pa.array(digest), pa.array(every)],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(find, schema)

"""Quality rules on repetition: characters that lie inside duplicated n-grams and duplicated lines of a text."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: The largest share of a text's word characters that may lie in duplicated n-grams, by n, and in
#: duplicated lines (published rules for web text).
MOST_IN_NGRAMS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
MOST_IN_LINES = 0.20
#: Fixed values of the base rule: fewest words, and the largest share of words (per cent) in repeated 3-word windows.
FEWEST_WORDS, MOST_REPEATED = 50, 50
_SYMBOLS = b"#*$%&|<>"
_OTHER_THAN_SYMBOLS = bytes(sorted(set(range(256)) - set(_SYMBOLS)))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(20_240_607).integers(1, 1 << 63, 1 << 12, dtype=np.uint64) | np.uint64(1)


def _mixed(numbers: np.ndarray) -> np.ndarray:
    x = (numbers.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
    x ^= x >> np.uint64(29)
    return x * _SEEDS[0]


def _twice(keys: np.ndarray) -> np.ndarray:
    """For each place: does its key stand at another place too?"""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def _later(keys: np.ndarray) -> np.ndarray:
    """For each place: does its key stand at an earlier place too?"""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return out


def _covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in the windows of n words that begin where starts is true."""
    steps = np.zeros(words + 1, np.int32)
    at = np.flatnonzero(starts)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + n, -1)
    return np.cumsum(steps[:-1]) > 0


def measure(text: str | None) -> dict[str, int]:
    """Counts of one whole text; all are zero for null and for texts without words.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; dup_<n>gram_chars: characters of words inside a
    window of n words that stands earlier in the text too; dup_line_chars: characters of words in lines equal to an
    earlier line. Word numbers are exact; windows of 3 are compared exactly, longer ones by a rolling 64-bit hash.
    """
    out = dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{n}gram_chars" for n in MOST_IN_NGRAMS)), 0)
    data = (text or "").encode()
    words = data.split()
    out["n_symbols"] = len(data.translate(None, _OTHER_THAN_SYMBOLS)) if data else 0
    if not words:
        return out
    numbers = defaultdict(count().__next__)
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    chars = np.fromiter((len(w) if w.isascii() else len(w.decode()) for w in numbers), np.int64, len(numbers))[ids]
    out["n_words"], out["word_chars"] = len(words), int(chars.sum())
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\v\f\r")] if b"\n" in data else [data]
    if len(lines) > 1:
        for line, n in Counter(lines).items():
            if n > 1:
                out["n_dup_lines"] += n - 1
                out["dup_line_chars"] += (n - 1) * sum(len(w.decode()) for w in line.split())
    if len(words) >= 3:
        width = max(1, int(len(numbers) - 1).bit_length())
        if 3 * width < 63:
            three = ids[:-2] << 2 * width | ids[1:-1] << width | ids[2:]
        else:  # too many distinct words for one number: number the pairs first
            pairs = np.unique(ids[:-1] << width | ids[1:], return_inverse=True)[1]
            three = pairs[:-1] << width | ids[2:]
        out["n_repeat_words"] = int(_covered(_twice(three), 3, len(words)).sum())
    rolled, mixed = np.zeros(len(ids) + 1, np.uint64), _mixed(ids)
    longest = max(MOST_IN_NGRAMS)
    for n in range(1, longest + 1):
        if n > len(ids):
            break
        rolled = rolled[:-1] * _SEEDS[1] + mixed[n - 1 :]
        if n in MOST_IN_NGRAMS:
            again = _later(rolled)
            if not again.any():
                break  # longer windows then cannot repeat either
            out[f"dup_{n}gram_chars"] = int(chars[_covered(again, n, len(ids))].sum())
    return out


def judge(m: pd.DataFrame) -> pd.DataFrame:
    """base_failed and kept for rows of counts."""
    failed = (m["n_words"] < FEWEST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])
    chars = m["word_chars"].clip(lower=1)
    worse = m["dup_line_chars"] > MOST_IN_LINES * chars
    for n, most in MOST_IN_NGRAMS.items():
        worse |= m[f"dup_{n}gram_chars"] > most * chars
    return m.assign(base_failed=failed, kept=~failed & ~worse)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{n}gram_chars" for n in MOST_IN_NGRAMS)]


def score(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every document, in one pass without a shuffle.

    Null text has no words and fails the base rule. Rows with a null or repeated doc_id are judged like any other;
    columns besides doc_id and text are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            m = pd.DataFrame([measure(t) for t in batch["text"]], columns=COLUMNS).astype("int64")
            yield judge(m.assign(doc_id=batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None)))

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS) + ", base_failed boolean, kept boolean")


def keep(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns, texts judged where they lie."""
    from pyspark.sql import functions as F

    @F.pandas_udf("boolean")
    def passes(texts: pd.Series) -> pd.Series:
        return judge(pd.DataFrame([measure(t) for t in texts], columns=COLUMNS))["kept"].astype(bool)

    return docs.where(passes("text"))

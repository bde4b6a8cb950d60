"""Toxicity: a weighted lexicon, matched by an Aho-Corasick automaton over folded text, normalised by length.

Folding undoes common disguises: case, marks over letters, look-alike letters of other scripts, and digits or signs in place
of letters.
Lexicon entries are whole words or stems, learned on labelled rows with log odds as weights; so are the exception phrases,
an entry's word with a neighbour, in which it means no offence: a match inside one does not count. The weights' sum per 100 words gives a probability by logistic regression on the same rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platehouse.llm.shared import staged

#: Labelled rows that are learned from at most (those of least hash of doc_id).
LABELLED_ROWS = 16_000
#: Characters of a stem at least, texts that an entry or exception is seen in at least, an entry's least log odds, and the
#: share of entries that chance may have given.
SHORTEST, LEAST_TEXTS, LEAST_ODDS, FALSE_SHARE = 4, 3, 2.0, 0.05
#: Rows of this remainder of crc32(doc_id as text) mod 4 are held out.
HELD_OUT = 2
THRESHOLD = 0.3
#: Words added to a text's own when matches are divided by length, so that one match in three words is no certainty.
SMOOTHING_WORDS = 100
# Signs that stand for letters, and letters of other scripts that look like Latin ones.
_SIGNS = dict(zip("01345789@$", "oieastbgas", strict=True))
_LOOK_ALIKE = dict(zip("авеёкмнорстухіјѕԁԛԝһӏαβεηικνορτυχγωϲ", "abeekmhopctyxijsdqwhlabenikvoptuxywc", strict=True))

#: Names of Latin letters that are drawn differently: struck, hooked, dotless, small capitals.
_VARIANT = re.compile(r"LATIN (?:SMALL |CAPITAL )?LETTER (?:SMALL CAPITAL |DOTLESS |SCRIPT |TURNED |REVERSED |OPEN |LONG )?([A-Z])(?: WITH .*)?")


def _table() -> dict[int, str]:
    """What each character of the basic plane is folded to, by its category and name; letters and digits stay if not listed."""
    out: dict[int, str] = {}
    for i in range(0x10000):
        kind = unicodedata.category(chr(i))
        if kind in ("Mn", "Me", "Cf"):  # combining marks and characters without a shape
            out[i] = ""
        elif kind[0] in "PSZC":
            out[i] = " "
        elif i > 127 and (named := _VARIANT.fullmatch(unicodedata.name(chr(i), ""))):
            out[i] = named[1].lower()
    return out | {ord(a): b for a, b in (_SIGNS | _LOOK_ALIKE).items()}


_TABLE = _table()


def fold(text: str) -> str:
    """Lower case, without marks over letters, look-alikes and signs to letters, other characters to spaces, and a space at
    both ends."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    return f" {text.translate(_TABLE)} "


@dataclass(frozen=True)
class Model:
    """entries: a stem, or a whole word and a space, -> weight; exceptions: phrases; the rest turns the weights' sum per 100 words into a probability."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    slope: float = 0.0
    offset: float = -3.0

    def automaton(self):
        """Entries and exceptions with (length, weight); an exception weighs None."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for e, w in self.entries.items():
            found.add_word(f" {e}", (len(e) + 1, w))
        for e in self.exceptions:
            phrase = f" {fold(e).strip()} "
            found.add_word(phrase, (len(phrase), None))
        if len(found):
            found.make_automaton()
        return found

    def density(self, text: str | None, automaton) -> float:
        """Weight of matches outside exception phrases per 100 words. A stem matches words that go on after it."""
        folded = fold(text or "")
        if not len(automaton):
            return 0.0
        hits = [(end - n + 1, end, w) for end, (n, w) in automaton.iter(folded) if w is None or folded[end] == " " or folded[end + 1] != " "]
        if not hits:
            return 0.0
        excused = [(a, b) for a, b, w in hits if w is None]
        total = sum(w for a, b, w in hits if w is not None and not any(x <= a and b <= y for x, y in excused))
        return 100 * total / (len(folded.split()) + 1 + SMOOTHING_WORDS)  # words, not spaces: marks make no text longer

    def score(self, density: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.offset + self.slope * np.log1p(density), -30, 30)))


def _candidates(text: str | None) -> set[str]:
    """The text's words, each with a space, and their stems: beginnings of words that go on."""
    words = set(fold(text or "").split())
    return {f"{w} " for w in words} | {w[:n] for w in words for n in range(SHORTEST, len(w))}


def _phrases(text: str | None, automaton) -> set[str]:
    """The words that entries match, each with the word before and with the word after."""
    folded, out = fold(text or ""), set()
    for end, (n, _) in automaton.iter(folded) if len(automaton) else ():
        start = end - n + 1
        if folded[end] != " " and folded[end + 1] == " ":
            continue
        words, after = folded[start:].split(None, 2)[:2], folded[:start].split()[-1:]
        out.update([" ".join(words)] * (len(words) == 2) + [f"{w} {words[0]}" for w in after])
    return out


#: Different texts' parts that a task counts before it hands them on, about.
_HELD_PARTS = 500_000


def _counted(parts_of):
    """Rows (part, pos, neg): in how many toxic and other texts each part occurs; part "" counts the texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = parts_of()

        def table() -> pd.DataFrame:
            keys = list(pos.keys() | neg.keys())
            return pd.DataFrame({"part": keys, "pos": [pos[k] for k in keys], "neg": [neg[k] for k in keys]})

        pos, neg = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                (pos if toxic else neg).update({"", *find(text)})
                if len(pos) + len(neg) > _HELD_PARTS:
                    yield table()
                    pos, neg = Counter(), Counter()
        if pos or neg:
            yield table()

    return run


def _telling(counts: DataFrame, n_pos: int, n_neg: int) -> list:
    """Parts of enough toxic texts and of enough log odds, of which a twentieth may be expected to be so by chance.

    Half of a part's G statistic, against the texts' own share of toxic ones, bounds the chance of such counts; as many
    parts are taken as keep (chance of the last) * (parts looked at) at FALSE_SHARE of the parts taken.
    """
    of, seen = n_pos + n_neg, F.col("pos") + F.col("neg")
    share = lambda c, n: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) * of / (seen * n))).otherwise(0.0)
    odds = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    common = counts.where((seen >= LEAST_TEXTS) & (F.col("part") != "")).withColumns({"odds": odds, "_g": share("pos", n_pos) + share("neg", n_neg)})
    looked_at = common.count()
    rows = sorted(common.where((F.col("pos") >= LEAST_TEXTS) & (F.col("odds") >= LEAST_ODDS)).collect(), key=lambda r: -r["_g"])
    sure = [i for i, r in enumerate(rows, 1) if math.exp(-r["_g"]) * looked_at <= FALSE_SHARE * i]
    return rows[: max(sure, default=0)]


def _entries(rows: list) -> dict[str, float]:
    """Of words and stems that match the same words, those of most log odds over all their texts; of equals the longest."""
    weight = lambda r: min(r["odds"], 8.0)
    chosen: dict[str, float] = {}
    begun: set[str] = set()
    for r in sorted(rows, key=lambda r: (-r["pos"] * weight(r), -len(r["part"]), r["part"])):
        part = r["part"]
        starts = {part, *(part[:n] for n in range(1, len(part) - part.endswith(" ")))}  # a stem is no start of itself as a word
        if part not in begun and not any(s in chosen for s in starts):
            chosen[part] = weight(r) / 8.0
            begun |= starts
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method with a light ridge, which separable rows need."""
    a = np.stack((x, np.ones_like(x)), 1)
    w, ridge = np.zeros(2), np.diag([1e-2, 1e-3])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + ridge @ w
        w = w - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, grad)
    return float(w[0]), float(w[1])


def learn(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS, exceptions: tuple[str, ...] = ()) -> Model:
    """A model from labelled rows that are not held out, of which at most `rows` are used (those of least hash).

    All entries and exceptions that the rows tell apart from chance are taken; `exceptions` adds phrases of the caller's.
    Rows with a null doc_id, a null label or no document are left out; of several labels of one doc_id or text the
    highest counts. Without labelled toxic rows the lexicon is empty and every score is low.
    """
    key = F.col("doc_id").cast("string")
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(F.crc32(key.cast("binary")) % 4 != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = usable.orderBy(F.md5(key), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most `rows` ids
    sample = staged(found.groupBy("text").agg(F.max("toxic").alias("toxic")), "labelled")  # copies would count their chance words again

    def counted(parts_of) -> DataFrame:
        return staged(sample.mapInPandas(_counted(parts_of), "part string, pos long, neg long").groupBy("part").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "counts")

    counts = counted(lambda: _candidates)
    total = counts.where("part = ''").first()
    n_pos, n_neg = (total["pos"], total["neg"]) if total else (0, 0)
    if not n_pos:
        return Model(exceptions=exceptions)
    # what is collected grows with the bounded sample only
    lexicon = Model(_entries(_telling(counts, n_pos, n_neg)))

    def neighbours():
        automaton = lexicon.automaton()
        return lambda text: _phrases(text, automaton)

    # told apart from the entry's own texts, most of which are toxic, a phrase of other texts is no offence
    phrases = counted(neighbours)
    harmless = phrases.where((F.col("neg") >= LEAST_TEXTS) & (F.col("part") != "") & (F.col("neg") * n_pos > F.col("pos") * n_neg)).select("part").collect()
    model = Model(lexicon.entries, tuple(sorted({*exceptions, *(r["part"] for r in harmless)})))
    seen = sample.mapInPandas(_densities(model, ["toxic"]), "toxic long, density double").collect()  # two numbers for each labelled row
    slope, offset = _logistic(np.log1p([r["density"] for r in seen]), np.array([min(r["toxic"], 1) for r in seen], float))
    return Model(model.entries, model.exceptions, slope, offset)


def _densities(model: Model, keep: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = model.automaton()
        for batch in batches:
            yield batch[keep].assign(density=[model.density(t, automaton) for t in batch["text"]])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and density of every document, in one pass without a shuffle.

    Null and empty texts match nothing and get the score of density 0. A null doc_id is not held out. Columns besides
    doc_id and text are not read.
    """
    find = _densities(model, ["doc_id"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in find(batches):
            out["score"] = model.score(out["density"].to_numpy())
            out["predicted"] = (out["score"] >= THRESHOLD).astype("int32")
            out["held_out"] = [not pd.isna(d) and zlib.crc32(str(int(d)).encode()) % 4 == HELD_OUT for d in out["doc_id"]]
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out[["doc_id", "held_out", "score", "predicted", "density"]]

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int, density double")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model does not call toxic, with all their columns."""

    @F.pandas_udf("boolean")
    def passes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = model.automaton()
        for texts in batches:
            yield pd.Series(model.score(np.array([model.density(t, automaton) for t in texts])) < THRESHOLD)

    return docs.where(passes("text"))

"""Token ids of whole texts by a vocabulary file of the tokenizers library, each distinct chunk encoded once.

Both vocabularies cut a text into pieces before merging, and no piece reaches across the chunk borders used here
(white space, and for byte-level vocabularies a space or a line end before a visible character). So the ids of a text are the
ids of its chunks in order, and a worker keeps the ids of the chunks it has seen.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import chain, count

import numpy as np

#: Chunks that a worker keeps, of about 285 bytes each; beyond that, it drops those that it has seen once only.
KEPT_CHUNKS = 1_000_000
#: What may be a special token; white space before white space or the end; white space but for spaces and line ends.
_SPECIAL, _ODD = "<|", re.compile(r"\s(?!\S)")
_OTHER_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_OTHER_ASCII_SPACES = [c for c in _OTHER_SPACES if c < "\x80"]
_ENCODERS: dict[str, ChunkEncoder] = {}


class ChunkEncoder:
    """Token ids of many texts. A chunk's ids lie in one flat array, found through its number."""

    def __init__(self, path: str, kept: int = KEPT_CHUNKS):
        from tokenizers import Tokenizer

        self.kept = kept

        self.tokenizer = Tokenizer.from_file(path)
        if hasattr(self.tokenizer.model, "_resize_cache"):  # a second store of words would only cost time
            self.tokenizer.model._resize_cache(0)
        self.byte_level = self.tokenizer.normalizer is None
        #: Ids that open a chunk (byte-level) or close a piece.
        self.marks = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.marks[[i for t, i in self.tokenizer.get_vocab().items() if (t.startswith("Ġ") or t == "Ċ" if self.byte_level else t.endswith("</w>"))]] = True
        self._forget()

    def _forget(self):
        self.numbers, self.flat = defaultdict(count().__next__), np.zeros(1 << 20, np.uint32)
        self.start, self.size, self.seen, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def _keep_frequent(self):
        """Start anew with the chunks seen twice or more, unless even those are many."""
        n = len(self.numbers)
        often = np.flatnonzero(self.seen[:n] > 1)
        chunks, ids, sizes = list(self.numbers), self._gather(often), self.size[often]
        self._forget()
        if len(often) <= self.kept // 2:
            for i in often.tolist():
                self.numbers[chunks[i]]
            self._store(ids, np.cumsum(sizes) - sizes, sizes)

    def _chunks(self, text: str) -> list | None:
        """The text's chunks; None if it has to be encoded as it is.

        For byte-level vocabularies that is where white space stands before white space or the end. A chunk that opens
        with a line end has no space before it.
        """
        if _SPECIAL in text:
            return None
        if not self.byte_level:
            return text.encode().split()
        if any(c in text for c in (_OTHER_ASCII_SPACES if text.isascii() else _OTHER_SPACES)) and _ODD.search(text):
            return None
        chunks = text.replace("\n", " \n").split(" ")
        return None if "" in chunks[1:] or "\n" in chunks else chunks

    def _encoded(self, chunks: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of new chunks, and where each chunk's begin and how many it has.

        Plain chunks are encoded side by side and told apart by the pieces they are known to have, which the
        vocabulary marks: a byte-level chunk opens one with its space, and a run of letters closes one.
        """
        if self.byte_level:
            pieces = np.ones(len(chunks), np.int64)
        else:
            chunks = [c.decode() for c in chunks]
            pieces = np.array([_pieces(c) for c in chunks], np.int64)
        plain, rest = np.flatnonzero(pieces), np.flatnonzero(pieces == 0)
        found, sizes = [], np.zeros(len(chunks), np.int64)
        groups = [plain[i : i + 2000] for i in range(0, len(plain), 2000)]
        joined = [(" " * self.byte_level + " ".join([chunks[k] for k in at])).replace(" \n", "\n") for at in groups]
        for at, e in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            marks = np.flatnonzero(self.marks[ids])
            if len(marks) != pieces[at].sum():
                raise ValueError("a chunk's ids can't be told from its neighbours'")
            sizes[at] = np.diff(marks, append=len(ids)) if self.byte_level else np.diff(marks[np.cumsum(pieces[at]) - 1] + 1, prepend=0)
            found.append(ids)
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([chunks[k] for k in rest], add_special_tokens=False), strict=True):
            found.append(np.array(e.ids, np.uint32))
            sizes[k] = len(found[-1])
        order = np.concatenate((plain, rest))
        starts = np.zeros(len(chunks), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate(found), starts, sizes

    def _store(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Ids of the chunks numbered last."""
        n, have = len(sizes), len(self.numbers) - len(sizes)
        while have + n > len(self.size):
            self.start, self.size, self.seen = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size, self.seen))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.size[have : have + n] = sizes
        self.start[have : have + n] = self.used + starts
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def __call__(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        """For each text its ids and then end_id."""
        if len(self.numbers) > self.kept:
            self._keep_frequent()
        numbers, had, firsts, rest, direct = self.numbers, len(self.numbers), [], [], {}
        for i, t in enumerate(texts):
            chunks = self._chunks(t) if t else []
            if chunks is None:
                direct[i] = t
                chunks = []
            elif chunks and self.byte_level:  # a text's first chunk has no space before it, and is seldom seen again
                firsts.append(chunks[0])
                del chunks[0]
            rest.append(chunks)
        many = [len(c) for c in rest]
        at = np.fromiter(map(numbers.__getitem__, chain.from_iterable(rest)), np.int64, sum(many))
        if len(numbers) > had:
            self._store(*self._encoded(_tail(numbers, len(numbers) - had)))
        if len(at):
            counts = np.bincount(at)
            self.seen[: len(counts)] += counts
        flat = self._gather(at)
        ends = np.concatenate(([0], np.cumsum(self.size[at])))[np.cumsum([0, *many])].tolist()
        whole = iter(self.tokenizer.encode_batch_fast(list(direct.values()), add_special_tokens=False))
        opening = iter(self.tokenizer.encode_batch_fast(firsts, add_special_tokens=False))
        out = []
        for i, t in enumerate(texts):
            ids = next(whole).ids if i in direct else next(opening).ids if t and self.byte_level else []
            k, n = len(ids), ends[i + 1] - ends[i]
            row = np.empty(k + n + 1, np.uint32)
            row[:k], row[k:-1], row[-1] = ids, flat[ends[i] : ends[i + 1]], end_id
            out.append(row)
        return out

    def _gather(self, at: np.ndarray) -> np.ndarray:
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[at] - (ends - size), size) + np.arange(total)]


def _pieces(chunk: str) -> int:
    """1 for a run of Latin letters, 2 if a mark of punctuation follows it, 0 where that is less plain."""
    stem = chunk[:-1] if chunk[-1] in ".,;:!?" else chunk
    return (1 + (len(stem) < len(chunk))) if stem.isalpha() and (stem.isascii() or max(stem) <= "ÿ") else 0


def _tail(numbers: dict, n: int) -> list:
    """The last n keys of a dictionary, in order of arrival."""
    keys = reversed(numbers)
    return [next(keys) for _ in range(n)][::-1]


def encoder(path: str, kept: int = KEPT_CHUNKS) -> ChunkEncoder:
    """This worker's encoder of a vocabulary file; one thread, as Spark runs the tasks side by side."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path, kept)
    return _ENCODERS[path]


def vocabulary(name: str) -> str:
    """The path of a vocabulary file, which every worker has at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)

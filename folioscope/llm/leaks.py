"""Evaluation texts leaking into a corpus, by a prefix-filtered set join.

Items and documents become words without case, punctuation, markup and invisible characters, then
shingles of SHINGLE words.  Shingles of items are ordered by their document frequency in the whole
corpus, rarest first.  An item can only be in a document if one of its necessary shingles is:

* of n words with k errors, n - SHINGLE + 1 - SHINGLE * k shingles are intact, so the SHINGLE * k + 1
  rarest ones can't all be missing;
* RUN successive words hold RUN - SHINGLE + 1 successive shingles, so the rarest one of each such
  stretch is enough.

Only these prefixes are looked up in documents.  Items are taken in blocks that a task can hold; for
each, one pass over the corpus counts its shingles, in arrays, and one finds the prefixes and settles
each hit where the document is read: by length, by the number of shared shingles, by the diagonals
they lie on, and word by word: a run of RUN words, or an alignment over a window of the item's
length.  Documents, their shingles and unsettled pairs are never shuffled.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import spread

SHINGLE, RUN, ONE_IN = 3, 13, 7
#: Characters of items that a block has about: what is broadcast at once.
BLOCK_CHARS = 1_500_000
_TAG = re.compile(r"</?(?:i|b|u|s|em|strong|span|sub|sup|a|font|mark|small|big|tt|code)\b[^<>]{0,300}>", re.I)
_BLOCK = re.compile(r"</?[a-z][a-z0-9]*\b[^<>]{0,300}>|<!--.*?-->", re.I | re.S)
_REFER = re.compile(r"\\(?:cite[a-z]*|ref|eqref|label|pageref|autoref|begin|end)\*?\s*(?:\[[^\]]*\])?\s*\{[^{}]*\}")
_COMMAND = re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?")
_LINK = re.compile(r"\]\((?:https?|mailto|#)[^)\s]*\)")
_WORD = re.compile(r"[^\W_]+")
#: Characters that aren't seen: of format category, variation selectors, the grapheme joiner.
_UNSEEN = re.compile("[" + "".join(f"\\U{c:08x}" for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf") + "\ufe00-\ufe0f\u034f]+")
#: Of ASCII all but letters and digits parts words.
_ASCII = "".join(chr(c) if chr(c).isalnum() else " " for c in range(128))


def words_of(text: str | None) -> tuple[list[str], list[int]]:
    """Words of a text, and the indexes of those that end a line."""
    if not text:
        return [], []
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _UNSEEN.sub("", text))
    if "<" in text:
        text = _BLOCK.sub(" ", _TAG.sub("", text))
    if "\\" in text:
        text = _COMMAND.sub("", _REFER.sub(" ", text))
    if "](" in text:
        text = _LINK.sub(" ", text)
    words: list[str] = []
    ends: list[int] = []
    plain = text.isascii()
    for line in text.casefold().splitlines():
        if found := line.translate(_ASCII).split() if plain else _WORD.findall(line):
            words += found
            ends.append(len(words) - 1)
    return words, ends[:-1]


def has_run(words: list[str], item: list[str], run: int = RUN) -> bool:
    """Whether `run` successive words of the item stand in the words, wherever these are split."""
    stream = "".join(words)
    starts, at = set(), 0
    for w in words:
        starts.add(at)
        at += len(w)
    starts.add(at)
    for i in range(len(item) - run + 1):
        s = "".join(item[i : i + run])
        p = stream.find(s)
        while p >= 0:
            if p in starts and p + len(s) in starts:
                return True
            p = stream.find(s, p + 1)
    return False


def errors(item: list[str], words: list[str]) -> int:
    """Least words replaced, dropped or inserted that bring the item into some stretch of words.

    Where words are parted or run together makes no difference.
    """
    n, m = len(item), len(words)
    before2: list[int] | None = None
    before = [0] * (m + 1)
    for i in range(1, n + 1):
        word = item[i - 1]
        row = [i] + [0] * m
        pair = item[i - 2] + word if i > 1 else ""
        for j in range(1, m + 1):
            w = words[j - 1]
            if w == word:
                c = before[j - 1]
            else:
                c = before[j - 1] + 1
                if j > 1 and word.endswith(w) and words[j - 2] + w == word:
                    c = min(c, before[j - 2])
                elif j > 2 and word.endswith(w) and words[j - 3] + words[j - 2] + w == word:
                    c = min(c, before[j - 3])
            c = min(c, before[j] + 1, row[j - 1] + 1)
            if before2 is not None and w == pair:
                c = min(c, before2[j - 1])
            row[j] = c
        before2, before = before, row
    return min(before)


class Items:
    """A block of items as arrays: their words, and their shingles as numbers in sorted order."""

    def __init__(self, texts: list[tuple[int, str]], size: int = SHINGLE, run: int = RUN, one_in: int = ONE_IN) -> None:
        self.size, self.run, self.one_in = size, run, one_in
        self.items = [(i, w) for i, w in ((i, words_of(t)[0]) for i, t in texts) if w]
        self.ids: dict[str, int] = {}
        for _, words in self.items:
            for w in words:
                self.ids.setdefault(w, len(self.ids))
        if max(1, len(self.ids)) ** size >= 1 << 62:
            raise ValueError("too many words in a block for shingles of this size")
        self.sizes = sorted({min(size, len(w)) for _, w in self.items})
        own = [self._codes(np.array([self.ids[w] for w in words], np.int64), min(size, len(words))) for _, words in self.items]
        self.codes, self.first, at = {}, {}, 0
        for q in self.sizes:
            self.codes[q] = np.unique(np.concatenate([c for c, (_, w) in zip(own, self.items, strict=True) if min(size, len(w)) == q]))
            self.first[q] = at
            at += len(self.codes[q])
        self.count = at
        #: Of each item the numbers of its shingles, in order.
        self.shingles = [(self.first[q := min(size, len(w))] + np.searchsorted(self.codes[q], c)).tolist() for c, (_, w) in zip(own, self.items, strict=True)]
        self.sets = [frozenset(x) for x in self.shingles]
        self.needs = [self._need(k) for k in range(len(self.items))]
        self.least = [self._least(w) for _, w in self.items]
        self.prefix_of: list[list[int]] = []

    def _codes(self, ids: np.ndarray, q: int) -> np.ndarray:
        n = len(ids) - q + 1
        code = np.zeros(max(0, n), np.int64)
        for j in range(q):
            code = code * max(1, len(self.ids)) + ids[j : j + max(0, n)]
        return code

    def _need(self, item: int) -> int:
        """Different shingles that a document with the item must share with it."""
        n, own = len(self.items[item][1]), self.shingles[item]
        q, k = min(self.size, n), n // self.one_in
        need = min([n - q + 1 - q * k] + [self.run - self.size + 1] * (n >= self.run))
        return max(1, need - (len(own) - len(self.sets[item])))  # those that an item repeats count once

    def _least(self, words: list[str]) -> int:
        """Letters that a document with the item must have: all but the longest words', or a run's."""
        sizes = [len(w) for w in words]
        whole = sum(sizes) - sum(sorted(sizes, reverse=True)[: len(words) // self.one_in])
        return min([whole] + [sum(sizes[i : i + self.run]) for i in range(len(words) - self.run + 1)])

    def order(self, frequency: np.ndarray) -> None:
        """Sets the prefixes: for each shingle the items of which it is a necessary one."""
        self.prefix_of = [[] for _ in range(self.count)]
        for item, own in enumerate(self.shingles):
            n = len(self.items[item][1])
            q, k = min(self.size, n), n // self.one_in
            ranked = sorted(range(len(own)), key=lambda i, own=own: (frequency[own[i]], i))
            chosen = {own[i] for i in ranked[: q * k + 1]}
            span = self.run - self.size + 1
            chosen |= {min(own[i : i + span], key=lambda s: (frequency[s], s)) for i in range(len(own) - span + 1)} if n >= self.run else set()
            for s in chosen:
                self.prefix_of[s].append(item)

    def find(self, texts: list[tuple[list[str], list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, shingle, position) of all shingles of the items in words and line ends of texts.

        Those in which words split at lines' ends are joined again count too, where the joined word
        is one of the items'.
        """
        ids: list[int] = []
        lengths: list[int] = []
        more: list[tuple[int, int, list[int]]] = []  # text, position, joined words
        get, size = self.ids.get, self.size
        for t, (words, ends) in enumerate(texts):
            own = list(map(get, words, repeat(-1)))  # -1 for words of no item
            own.append(-1)
            ids += own
            lengths.append(len(own))
            joins = {e: x for e in ends if (x := get(words[e] + words[e + 1], -1)) >= 0}
            for e, x in joins.items():
                lo = max(0, e - size + 1)
                more.append((t, lo, [*own[lo:e], x, *own[e + 2 : e + size + 1], -1]))
                if any(f in joins for f in range(lo, e + size + 1) if f != e):
                    near: list[int] = []
                    i = lo
                    while i < min(len(words), e + size + 2):
                        near.append(joins.get(i, own[i]))
                        i += 1 + (i in joins)
                    more.append((t, lo, [*near, -1]))
        text = np.repeat(np.arange(len(texts)), lengths)
        begin = np.cumsum(lengths) - lengths if lengths else np.zeros(0, int)
        pos = np.arange(len(ids)) - np.repeat(begin, lengths) if lengths else np.zeros(0, int)
        if more:
            ids += [x for _, _, own in more for x in own]
            text = np.concatenate([text, np.repeat([t for t, _, _ in more], [len(o) for _, _, o in more])])
            pos = np.concatenate([pos, *[p + np.arange(len(o)) for _, p, o in more]])
        stream = np.array(ids, np.int64)
        found = []
        for q in self.sizes:
            n = len(stream) - q + 1
            if n <= 0:
                continue
            whole = stream[:n] >= 0
            for j in range(1, q):
                whole &= stream[j : j + n] >= 0
            at = np.flatnonzero(whole)
            code = np.zeros(len(at), np.int64)
            for j in range(q):
                code = code * max(1, len(self.ids)) + stream[at + j]
            k = np.minimum(np.searchsorted(self.codes[q], code), len(self.codes[q]) - 1)
            hit = self.codes[q][k] == code
            found.append((text[at[hit]], self.first[q] + k[hit], pos[at[hit]]))
        if not found:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
        return tuple(np.concatenate([f[i] for f in found]) for i in range(3))

    def contained(self, item: int, words: list[str], where: dict[int, list[int]], letters: int) -> bool:
        """Whether a document holds the item; where: positions of the items' shingles in it."""
        if letters < self.least[item] or len(self.sets[item] & where.keys()) < self.needs[item]:
            return False
        own, n = self.items[item][1], len(self.items[item][1])
        if n >= self.run and has_run(words, own, self.run):
            return True
        k, q = n // self.one_in, min(self.size, n)
        # Shingles of one occurrence lie on diagonals at most k apart from their neighbours', and so many
        # of the item's positions must be among them; only such stretches are aligned.
        places = sorted((d - i, i) for i, s in enumerate(self.shingles[item]) for d in where.get(s, ()))
        at = 0
        while at < len(places):
            last = at
            while last + 1 < len(places) and places[last + 1][0] - places[last][0] <= k + 1:
                last += 1
            if len({i for _, i in places[at : last + 1]}) >= n - q + 1 - q * k:
                lo, hi = max(0, places[at][0] - k - 2), places[last][0] + n + k + 2
                if errors(own, words[lo:hi]) <= k:
                    return True
            at = last + 1
        return False

    def leaked(self, texts: list[tuple[list[str], list[int]]]) -> list[tuple[int, int]]:
        """(text, item id) of the items that texts hold."""
        text, shingle, pos = self.find(texts)
        order = np.argsort(text, kind="stable")
        text, shingle, pos = text[order], shingle[order], pos[order]
        out: list[tuple[int, int]] = []
        edges = np.flatnonzero(np.diff(text, prepend=-1, append=len(texts))) if len(text) else []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True) if len(text) else ():
            own = shingle[lo:hi].tolist()
            asked = {item for s in set(own) for item in self.prefix_of[s]}
            if not asked:
                continue
            where: dict[int, list[int]] = {}
            for s, p in zip(own, pos[lo:hi].tolist(), strict=True):
                where.setdefault(s, []).append(p)
            t = int(text[lo])
            words = texts[t][0]
            letters = sum(map(len, words))
            out += [(t, self.items[item][0]) for item in sorted(asked) if self.contained(item, words, where, letters)]
        return out


#: Rows and characters of documents that are taken at a time; a longer document is taken alone.
AT_ONCE, AT_ONCE_CHARS = 1000, 2_000_000


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Stretches of texts of at most AT_ONCE rows and, but for a single text, AT_ONCE_CHARS characters."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > begin and (i - begin >= AT_ONCE or size + n > AT_ONCE_CHARS):
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def _counted(items) -> object:
    """(s, n): in how many documents of a task each shingle of the items is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = items.value
        n = np.zeros(held.count, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in _slices(texts):
                text, shingle, _ = held.find([words_of(x) for x in texts[lo:hi]])
                n += np.bincount(np.unique(text * held.count + shingle) % max(1, held.count), minlength=held.count)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(n[seen], pa.int64())], names=["s", "n"])

    return run


def _settled(items) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in _slices(texts):
                rows = [(ids[lo + t], item) for t, item in items.value.leaked([words_of(x) for x in texts[lo:hi]])]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([i for _, i in rows], pa.int64())], names=["doc_id", "item_id"])

    return run


def leaks(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, size: int = SHINGLE, run: int = RUN, one_in: int = ONE_IN, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id): documents that hold `run` successive words of an item, or all of it with
    at most one word in `one_in` replaced, dropped or misspelt.

    Null and empty texts and items without words match nothing; repeated rows count once; extra
    columns are ignored.  Document frequencies are counted over the whole corpus first, repeated
    rows each time.  Items of any number: a block holds about block_chars characters of them, and
    each block reads the corpus twice.
    """
    if 2 * size > one_in:
        raise ValueError("with this many errors an item may keep no intact shingle")
    spark = docs.sparkSession
    corpus = spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text")).where("doc_id is not null and text is not null"))
    tests = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null").distinct()
    # Words are as long as their share of the characters, so fewer characters bound the numbers of words too.
    most = min(block_chars, int(2 ** (62 / size)))
    blocks = max(1, -(-(tests.agg(F.sum(F.length("text"))).first()[0] or 0) // most))
    out: DataFrame | None = None
    for block in range(blocks):
        own = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        held = Items([(r.item_id, r.text) for r in own.collect()], size, run, one_in)
        if not held.items:
            continue
        counts = corpus.select("text").mapInArrow(_counted(spark.sparkContext.broadcast(held)), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()
        frequency = np.zeros(held.count, np.int64)
        for r in counts:
            frequency[r.s] = r.n
        held.order(frequency)
        found = corpus.mapInArrow(_settled(spark.sparkContext.broadcast(held)), "doc_id long, item_id long")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "doc_id long, item_id long") if out is None else out.distinct()

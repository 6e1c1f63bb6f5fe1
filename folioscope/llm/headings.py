"""Freely typed values mapped to a list of canonical names.

A multi-pattern automaton over names and aliases finds the mentions in a value; the longest of those
that don't overlap wins.  Words around it that are light change nothing; of others, either a name
that accounts for the whole value better wins, or the mention if it is enough of the value.  Light
words are learnt from list and values: most values that have such a word have a mention beside it.
Values without a mention go to token-set similarity: their words are matched to a name's words in
any order, as equal, as abbreviations or as misspellings, and the whole is compared as one string
as well, for words that are run together.  Indexes of words, their beginnings and letters say which
names can be similar at all; only these are compared.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import cut, spread

#: Names and aliases of a block: what each task holds.  A longer list is taken in several.
BLOCK_NAMES = 200_000
#: Similarity that a name must reach, and at which a word counts as a misspelling.
ENOUGH, WORD = 0.7, 0.6
#: Share of a value's letters that a mention among other words must have.
SHARE = 0.3
#: A light word stands beside the mention in one of so many values with words beside a mention, and in
#: three at least; and in this share of all values that have it there is a mention.
ONE_IN, MOSTLY = 200, 0.5
#: Words that carry no meaning of their own in a heading.
SMALL = frozenset("a an and by for in of on the to".split())
_LEAD = re.compile(r"^\W*(?:(?:section|chapter|part)\b\W*)?(?:(?:\d+(?:\.\d+)*|[ivxl]+|[a-z])(?=[\s.):])[\s.):]*)?", re.I)
_TOKEN = re.compile(r"([^\W\d_]+)(\.?)")


def tokens(value: str) -> list[tuple[str, bool]]:
    """Words of a value in lower case, without numbering, each with whether a full stop follows."""
    text = unicodedata.normalize("NFKC", value).casefold()
    text = "".join(c for c in text if unicodedata.category(c) != "Cf").replace("&", " and ")
    bare = text[_LEAD.match(text).end() :]
    found = _TOKEN.findall(bare if _TOKEN.search(bare) else text)
    return [(w, bool(dot)) for w, dot in found]


def distance(a: str, b: str) -> int:
    """Edits (insert, delete, replace, swap of neighbours) from a to b, a column of the table at a time
    as the bits of two numbers."""
    if not a or not b:
        return len(a) or len(b)
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, diagonal, before, score = every, 0, 0, 0, len(a)
    for y in b:
        here = places.get(y, 0)
        swap = (~diagonal & here) << 1 & before
        diagonal = ((((here & up) + up) ^ up) | here | down | swap) & every
        right, left = (down | ~(diagonal | up)) & every, diagonal & up
        score += bool(right & last) - bool(left & last)
        right, left = right << 1 | 1, left << 1
        up, down, before = (left | ~(diagonal | right)) & every, right & diagonal & every, here
    return score


def likeness(a: str, b: str, least: float) -> float:
    """1 - edits / length of the longer; 0 if under least."""
    size = max(len(a), len(b), 1)
    score = 1 - distance(a, b) / size
    return score if score >= least else 0.0


def _letters(texts: list[str]) -> np.ndarray:
    """How often each text has each of 32 kinds of letters."""
    out = np.zeros((len(texts), 32), np.int16)
    for i, t in enumerate(texts):
        for c in t:
            out[i, ord(c) & 31] += 1
    return out


class _Near:
    """Texts that share enough letters with another to be as alike as `least`: no others can be.

    First by the kinds of letters that only one of both has, as bits; then by the numbers of letters.
    """

    def __init__(self, texts: list[str], least: float) -> None:
        self.texts, self.least = texts, least
        self.counts, self.sizes = _letters(texts), np.array([len(t) for t in texts], np.int32)
        self.kinds = self._kinds(self.counts)

    @staticmethod
    def _kinds(counts: np.ndarray) -> np.ndarray:
        return ((counts > 0) << np.arange(32, dtype=np.int64)).sum(axis=1)

    def __call__(self, text: str) -> list[tuple[int, float]]:
        """(index, likeness) of the texts at least so alike."""
        if not self.texts:
            return []
        own = _letters([text])
        kinds = self._kinds(own)
        longer = np.maximum(self.sizes, len(text))
        most = (1 - self.least) * longer + 1e-9
        near = np.flatnonzero((np.bitwise_count(kinds & ~self.kinds) <= most) & (np.bitwise_count(self.kinds & ~kinds) <= most) & (np.abs(self.sizes - len(text)) <= most))
        near = near[np.minimum(self.counts[near], own).sum(axis=1) >= self.least * longer[near] - 1e-9]
        return [(i, s) for i in near.tolist() if (s := likeness(text, self.texts[i], self.least)) > 0]


class Matcher:
    """Values to the ids of a list; names: (id, name or alias); light: words that say nothing."""

    def __init__(self, names: list[tuple[int, str]], light: frozenset[str] = frozenset()) -> None:
        import ahocorasick

        self.light = SMALL | light
        self.auto = ahocorasick.Automaton()
        self.names: list[tuple[int, list[str], str]] = []
        spelt: dict[str, int] = {}
        for rid, name in sorted(names):
            words = [w for w, _ in tokens(name)]
            key = " ".join(words)
            if key and key not in spelt:  # an ambiguous name is the smallest id's
                spelt[key] = rid
                self.names.append((rid, [w for w in words if w not in SMALL] or words, "".join(words)))
        for key, rid in spelt.items():
            self.auto.add_word(f" {key} ", (rid, len(key.split())))
        if spelt:
            self.auto.make_automaton()
        self.words = sorted({w for _, ws, _ in self.names for w in ws})
        self.stems: dict[str, list[str]] = defaultdict(list)
        for w in self.words:
            self.stems[w.rstrip("s")].append(w)
        self.has: dict[str, list[int]] = defaultdict(list)
        for k, (_, ws, _) in enumerate(self.names):
            for w in dict.fromkeys(ws):
                self.has[w].append(k)
        self.near_words, self.near_names = _Near(self.words, WORD), _Near([x for _, _, x in self.names], ENOUGH)
        self.sizes = [sum(map(len, ws)) for _, ws, _ in self.names]
        self.forms: dict[tuple[str, bool], dict[str, float]] = {}
        self.cache: dict[str, tuple[int, float, int]] = {}

    def mention(self, words: list[str]) -> tuple[int, int, list[str]] | None:
        """(id, its words, words outside mentions) of the longest mention, the first if tied."""
        text = f" {' '.join(words)} "
        hits = sorted(((n, end, rid) for end, (rid, n) in self.auto.iter(text)), key=lambda h: (-h[0], h[1]))
        taken: list[tuple[int, int, int]] = []
        for n, end, rid in hits:
            last = text.count(" ", 0, end) - 1
            if all(last - n >= b or last < a + 1 for a, b, _ in taken):
                taken.append((last - n, last, rid))
        if not taken:
            return None
        inside = {k for a, b, _ in taken for k in range(a + 1, b + 1)}
        return taken[0][2], taken[0][1] - taken[0][0], [w for k, w in enumerate(words) if k not in inside]

    def matches(self, word: str, dot: bool) -> dict[str, float]:
        """How well a typed word stands for words of names; only for those it can stand for."""
        key = (word, dot)
        if key not in self.forms:
            if len(self.forms) > 200_000:
                self.forms.clear()
            found: dict[str, float] = {}
            if len(word) > 3:
                found = {self.words[i]: s for i, s in self.near_words(word)}
            stem = word[:-1] if word.endswith("s") and len(word) > 3 else word
            if len(stem) >= (1 if dot else 3):
                at = bisect_left(self.words, stem)
                while at < len(self.words) and self.words[at].startswith(stem):
                    found[self.words[at]] = 0.95 if dot or len(stem) >= 4 else 0.85
                    at += 1
            found |= dict.fromkeys(self.stems.get(word.rstrip("s"), ()), 1.0)
            self.forms[key] = found
        return self.forms[key]

    def similar(self, typed: list[tuple[str, bool]]) -> tuple[float, int]:
        """(similarity, id) of the closest name; the smallest id if tied."""
        core = [(w, d) for w, d in typed if w not in self.light]
        if not core:
            return 0.0, -1
        size = sum(len(w) for w, _ in core)
        forms = [self.matches(w, d) for w, d in core]
        most: dict[int, float] = defaultdict(float)  # what a name can score at most
        for (w, _), form in zip(core, forms, strict=True):
            best: dict[int, float] = {}
            for x, s in form.items():
                for k in self.has[x]:
                    best[k] = max(best.get(k, 0.0), s * (len(w) + len(x)))
            for k, s in best.items():
                most[k] += s
        scores: dict[int, float] = {}
        for k, bound in most.items():
            if bound >= ENOUGH * (size * 0.5 + self.sizes[k] * 0.5):
                scores[k] = self._score(core, forms, size, k)
        whole, kept = "".join(w for w, _ in typed), "".join(w for w, _ in core)
        for text in {whole, kept}:
            for k, s in self.near_names(text):
                scores[k] = max(scores.get(k, 0.0), s)
        score, rid = max(((round(s, 9), -self.names[k][0]) for k, s in scores.items()), default=(0.0, 1))
        return score, -rid

    def _score(self, core: list[tuple[str, bool]], forms: list[dict[str, float]], size: int, k: int) -> float:
        name = self.names[k][1]
        pairs = sorted(((s, i, j) for i, form in enumerate(forms) for j, x in enumerate(name) if (s := form.get(x, 0.0)) > 0), reverse=True)
        left, right, got = set(), set(), 0.0
        for s, i, j in pairs:
            if i not in left and j not in right:
                left.add(i)
                right.add(j)
                got += s * (len(core[i][0]) + len(name[j]))
        total = size + self.sizes[k]
        return got / total if len(left) == len(core) and len(right) == len(name) else got / (total + 4 * (len(core) - len(left) + len(name) - len(right)))

    def judge(self, value: str) -> tuple[int, float, int]:
        """(kind, strength, id): 2 and its words for a mention that is the value, 1 and a similarity
        for a name that is like it, or a mention in it; 0 and -1 if none is meant."""
        if value not in self.cache:
            if len(self.cache) > 200_000:
                self.cache.clear()
            typed = tokens(value)
            self.cache[value] = self._judge(typed) if typed and self.names else (0, 0.0, -1)
        return self.cache[value]

    def _judge(self, typed: list[tuple[str, bool]]) -> tuple[int, float, int]:
        words = [w for w, _ in typed]
        held = self.mention(words)
        if held and not (rest := self.beside(held)):
            return 2, float(held[1]), held[0]
        score, rid = self.similar(typed)
        if score >= ENOUGH:
            return 1, score, rid
        if held and (share := 1 - sum(map(len, rest)) / sum(len(w) for w in words if w not in self.light)) >= SHARE:
            return 1, min(share, ENOUGH - 1e-6), held[0]
        return 0, 0.0, -1

    def beside(self, held: tuple[int, int, list[str]]) -> list[str]:
        """Words beside a mention that aren't light or single letters."""
        return [w for w in held[2] if w not in self.light and len(w) > 1]

    def __call__(self, value: str | None) -> int | None:
        """The id meant, -1 if none; None for null and blank values."""
        return None if value is None or not value.strip() else self.judge(value)[2]


def light_words(df: DataFrame, value_col: str, names: list[tuple[int, str]]) -> frozenset[str]:
    """Words that stand beside mentions whatever they say, counted over all values.

    Counted per task first.  At most ONE_IN words for each word of a value can be light, so what
    reaches the driver is bounded, however many values there are.
    """
    sent = df.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value)
        beside, total = Counter(), Counter()
        for batch in batches:
            for value, n in Counter(batch.column(0).to_pylist()).items():
                typed = tokens(value) if value else []
                words = [w for w, _ in typed]
                held = matcher.mention(words) if words and matcher.names else None
                if held and (rest := set(matcher.beside(held))) and matcher.judge(value)[2] == held[0] and not any(matcher.matches(w, True).keys() & _words_of(matcher, held[0]) for w in rest):
                    beside.update(dict.fromkeys([*rest, ""], n))
                total.update(dict.fromkeys(words, n))
        rows = [(w, beside[w], n) for w, n in total.items()] + [("", beside[""], 0)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["w", "b", "n"])

    counts = cut(df.select(value_col).mapInArrow(run, "w string, b long, n long").groupBy("w").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).where("b > 0"))
    values = sum(r.b for r in counts.where("w = ''").collect())
    found = counts.where((F.col("w") != "") & (F.col("b") >= F.greatest(F.lit(3), F.lit(values / ONE_IN))) & (F.col("b") >= MOSTLY * F.col("n")))
    return frozenset(r.w for r in found.select("w").collect())


def _words_of(matcher: Matcher, rid: int) -> set[str]:
    return {w for i, ws, _ in matcher.names if i == rid for w in ws}


def map_values(df: DataFrame, id_col: str, value_col: str, names: DataFrame, name_id: str, name: str, aliases: str | None = None, block_names: int = BLOCK_NAMES) -> DataFrame:
    """(id, value, name_id) of each row whose value isn't null or blank; name_id -1: unmatched.

    A value is judged once per task and remembered, and nothing is shuffled but the result, of which
    repeated rows count once.  Null names, null alias lists and null aliases are ignored.  A list of
    more than block_names names and aliases is taken in blocks, whose best answers are compared.
    """
    listed = names.select(F.col(name_id).cast("long").alias("i"), F.col(name).alias("n"))
    if aliases:
        listed = listed.unionByName(names.select(F.col(name_id).cast("long").alias("i"), F.explode(aliases).alias("n")))
    listed = listed.where("i is not null and n is not null").distinct()
    blocks = max(1, -(-listed.count() // block_names))
    rows = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(value_col).alias("value")))
    out: DataFrame | None = None
    for block in range(blocks):
        own = [(r.i, r.n) for r in listed.where(F.pmod(F.xxhash64("n"), F.lit(blocks)) == block).collect()]
        sent = df.sparkSession.sparkContext.broadcast((own, light_words(rows, "value", own)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*sent.value)
            for batch in batches:
                judged = [None if v is None or not v.strip() else matcher.judge(v) for v in batch.column(1).to_pylist()]
                columns = [pa.array([j and j[k] for j in judged], t) for k, t in enumerate((pa.int32(), pa.float64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=["id", "value", "kind", "strength", "name_id"]).filter(columns[0].is_valid())

        found = rows.mapInArrow(run, "id long, value string, kind int, strength double, name_id long")
        out = found if out is None else out.unionByName(found)
    if blocks == 1:
        return out.select("id", "value", "name_id").distinct()
    return out.groupBy("id", "value").agg((-F.max(F.struct("kind", "strength", (-F.col("name_id")).alias("m")))["m"]).alias("name_id"))

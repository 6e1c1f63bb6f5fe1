"""Visually identical text brought to one form.

Pairs of strings that look alike are joined by union-find into classes: code points of another
script or width, composed and decomposed letters, ligatures and what they join, kinds of hyphen and
of space, and the invisible characters, which look like nothing.  Members of a class are strings as
well as single code points; where a letter has a look-alike, so has each combination of it with the
marks it is composed with.  The most frequent member in the corpus represents the class.  A
multi-pattern automaton replaces, from left to right, the longest member at each place.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import cut, spread

# Letters of other scripts drawn like Latin ones, each above its partner.
CYRILLIC = (
    "\u0410\u0412\u0415\u0405\u0406\u0408\u041a\u041c\u041d\u041e\u0420\u0421\u0422\u0425\u04ae\u050c\u051a\u051c\u0430\u0435\u043e\u0440\u0441\u0443\u0445\u0455\u0456\u0458\u04bb\u0501\u051b\u051d\u0475",
    "ABESIJKMHOPCTXYGQWaeopcyxsijhdqwv",
)
GREEK = ("\u0391\u0392\u0395\u0396\u0397\u0399\u039a\u039c\u039d\u039f\u03a1\u03a4\u03a5\u03a7\u03bf\u03bd\u03f2\u03f3", "ABEZHIKMNOPTYXovcj")
#: Hyphen-minus, hyphen, non-breaking hyphen, small hyphen-minus.
HYPHENS = "-\u2010\u2011\ufe63"
#: Leaders and the dots they are drawn as.
LEADERS = (("\u2024", "."), ("\u2025", ".."), ("\u2026", "..."))
#: Characters of format category that are drawn.
DRAWN_FORMATS = "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2"
#: Invisible characters of other categories, without the variation selectors.
UNSEEN = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0"
#: The spaces that are drawn, or are the plain one.
OTHER_SPACES = " \u1680"


class UnionFind:
    """Classes of strings under transitive pairs."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def classes(self) -> list[list[str]]:
        out = defaultdict(list)
        for x in list(self.parent):
            out[self.find(x)].append(x)
        return [sorted(v) for v in out.values() if len(v) > 1]


def _all_characters() -> Iterator[str]:
    for c in range(sys.maxunicode + 1):
        if not 0xD800 <= c <= 0xDFFF and not 0xAC00 <= c <= 0xD7A3:
            yield chr(c)


def pairs() -> Iterator[tuple[str, str]]:
    """Pairs of strings that look alike, from character properties and the fixed lists above."""
    for others, latin in (CYRILLIC, GREEK):
        yield from zip(others, latin, strict=True)
    for h in HYPHENS[1:]:
        yield h, HYPHENS[0]
    yield from LEADERS
    for c in _all_characters():
        kind = unicodedata.category(c)
        selector = "\ufe00" <= c <= "\ufe0f" or 0xE0100 <= ord(c) <= 0xE01EF
        if (kind == "Cf" and c not in DRAWN_FORMATS) or c in UNSEEN or selector:
            yield c, ""
            continue
        if kind == "Zs":
            if c not in OTHER_SPACES:
                yield c, " "
            continue
        made = unicodedata.decomposition(c)
        tag, _, rest = made.rpartition("> ")
        parts = "".join(chr(int(x, 16)) for x in rest.split())
        ligature = tag == "<compat" and kind in ("Ll", "Lu", "Lt") and len(parts) > 1 and parts.isalpha() and parts[0] < "\u0300"
        if tag in ("<wide", "<narrow") or ligature or c == "\u00b5":
            yield c, parts
        elif made and not tag:
            yield c, unicodedata.normalize("NFD", c)


@cache
def classes() -> list[list[str]]:
    """Classes of look-alike strings; combinations of a look-alike letter and marks included."""
    found = UnionFind()
    composed: list[tuple[str, str]] = []
    for a, b in pairs():
        found.join(a, b)
        if len(b) > 1 and unicodedata.combining(b[1]) and unicodedata.normalize("NFC", a) == a:
            composed.append((a, b))
    like = defaultdict(list)
    for members in found.classes():
        single = [m for m in members if len(m) == 1 and m.isalpha()]
        for m in single:
            like[m] = [x for x in single if x != m]
    for whole, parts in composed:
        base, marks = parts[0], parts[1:]
        for other in like.get(base, ()):
            found.join(whole, other + marks)
            short = unicodedata.normalize("NFC", other + marks)
            if short != other + marks:
                found.join(whole, short)
        # A letter composed with some of its marks, the rest following, looks the same too.
        for i in range(1, len(marks)):
            if (part := unicodedata.normalize("NFC", base + marks[:i])) != base + marks[:i]:
                found.join(whole, part + marks[i:])
    return found.classes()


def representatives(groups: Iterable[list[str]], counts: dict[str, int]) -> dict[str, str]:
    """Each member's substitute: the class's most frequent member, the shorter and smaller if tied.

    The invisible characters are always represented by the empty string, and what a ligature joins by
    a spelt-out member: were it a ligature, the form of a text would depend on where matches start.
    """
    out = {}
    for members in groups:
        stable = [m for m in members if unicodedata.normalize("NFC", m) == m]
        spelt = [m for m in stable if len([c for c in m if not unicodedata.combining(c)]) > 1]
        best = "" if "" in members else min(spelt or stable, key=lambda m: (-counts.get(m, 0), len(m), ord(m[0]) > 126, m))
        out |= {m: best for m in members if m and m != best}
    return out


class Rewriter:
    """Replaces the longest member at each place, from left to right, until nothing changes."""

    def __init__(self, table: dict[str, str]) -> None:
        import ahocorasick

        self.unseen = {ord(k): None for k, v in table.items() if v == "" and len(k) == 1}
        self.auto = ahocorasick.Automaton()
        for k, v in table.items():
            if v:
                self.auto.add_word(k, (k, v))
        self.any = len(self.auto) > 0
        if self.any:
            self.auto.make_automaton()
        self.starts = {k[0] for k, v in table.items() if v}
        self.keeps_ascii = not any(k.isascii() for k in table)

    def once(self, text: str) -> str:
        if not self.any or self.starts.isdisjoint(text):
            return text
        out, at = [], 0
        # iter_long gives non-overlapping matches, the longest at the leftmost place.
        for end, (k, v) in self.auto.iter_long(text):
            begin = end - len(k) + 1
            out += [text[at:begin], v]
            at = end + 1
        out.append(text[at:])
        return "".join(out)

    def __call__(self, text: str) -> str:
        if self.keeps_ascii and text.isascii():
            return text
        text = text.translate(self.unseen)
        # Marks in canonical order first, so that one spelling of a pattern is enough.
        text = unicodedata.normalize("NFC", text)
        seen = [text]
        while (text := unicodedata.normalize("NFC", self.once(text))) not in seen:
            seen.append(text)
        # As a rule the last one stays as it is; were there a round of forms, its least would stand for all.
        return min(seen[seen.index(text) :])


def member_counts(texts: DataFrame, text_col: str, groups: list[list[str]]) -> dict[str, int]:
    """How often each member of a class stands in the corpus, over all rows.

    Counted per partition by the same automaton; what reaches the driver is bounded by the members.
    """
    members = {m for g in groups for m in g if m}
    single, strings = {m for m in members if len(m) == 1}, sorted(m for m in members if len(m) > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        auto = ahocorasick.Automaton()
        for m in strings:
            auto.add_word(m, m)
        auto.make_automaton()
        counted: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0):
                if t.is_valid:
                    text = t.as_py()
                    counted.update(text)
                    counted.update(m for _, m in auto.iter_long(text))
        seen = {m: n for m, n in counted.items() if len(m) > 1 or m in single}
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["m", "n"])

    rows = texts.select(F.col(text_col).alias("text")).mapInArrow(run, "m string, n long").groupBy("m").agg(F.sum("n").alias("n"))
    return {r.m: r.n for r in rows.collect()}


def canonical(df: DataFrame, text_col: str, out_col: str, table: dict[str, str]) -> DataFrame:
    """df with out_col, the canonical form of text_col; null for null, the empty text for itself.

    table: as from `representatives`.  No shuffle; out_col replaces a column of that name.
    """
    import pandas as pd

    sent = df.sparkSession.sparkContext.broadcast(table)
    ready: list[Rewriter] = []

    def rewrite(batches):
        for s in batches:
            if not ready:
                ready.append(Rewriter(sent.value))
            yield s.map(ready[0], na_action="ignore")

    rewrite.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return spread(df).withColumn(out_col, F.pandas_udf(rewrite, "string")(F.col(text_col)))


def look_alike_classes(df: DataFrame, kind: str, key: str, text: str, form: str) -> DataFrame:
    """(kind, key, text_id, class_id, n_texts, n_keys): each key's text and the class of texts that look
    like it, with the numbers of its different texts and of its keys.

    One row per kind, key and text; ids are hashes of the text and of its form.  Only these are
    shuffled, never texts, and classes are counted, never gathered: a form that a third of all rows
    has is combined before the shuffle.  Rows with a null key or text are ignored, repeated rows
    count once.
    """
    rows = df.select(F.col(kind).alias("kind"), F.col(key).alias("key"), F.unhex(F.sha2(text, 256)).alias("text_id"), F.unhex(F.sha2(form, 256)).alias("class_id"))
    rows = cut(rows.where("key is not null and text_id is not null").distinct())
    texts = rows.groupBy("kind", "class_id", "text_id").agg(F.count("*").alias("n"))
    sizes = texts.groupBy("kind", "class_id").agg(F.count("*").alias("n_texts"), F.sum("n").alias("n_keys"))
    return rows.join(sizes, ["kind", "class_id"]).select("kind", "key", "text_id", "class_id", "n_texts", "n_keys")


def look_alike_pairs(classed: DataFrame) -> DataFrame:
    """(kind, key_a, key_b): keys of one kind whose texts have one form but differ, key_a < key_b.

    classed: as from look_alike_classes.  A class's different texts meet each other, never their
    copies; each copy's key joins its text afterwards.  So nothing is emitted that isn't a result.
    """
    keys = classed.where("n_texts > 1").select("kind", "class_id", "text_id", "key")
    texts = keys.select("kind", "class_id", "text_id").distinct()
    differ = texts.withColumnRenamed("text_id", "ta").join(texts.withColumnRenamed("text_id", "tb"), ["kind", "class_id"]).where("ta < tb").select("kind", "ta", "tb")
    own = keys.select("kind", "text_id", "key")
    met = differ.join(own.withColumnsRenamed({"text_id": "ta", "key": "x"}), ["kind", "ta"]).join(own.withColumnsRenamed({"text_id": "tb", "key": "y"}), ["kind", "tb"])
    lo, hi = F.least("x", "y"), F.greatest("x", "y")
    return met.where("x != y").select("kind", lo.alias("key_a"), hi.alias("key_b")).distinct()


def forms(df: DataFrame, text_col: str) -> tuple[DataFrame, dict[str, str]]:
    """df with its canonical form in `form`, and the table of substitutes fitted on all of df.

    Two narrow passes over df, one to count members and one to rewrite."""
    groups = classes()
    table = representatives(groups, member_counts(df, text_col, groups))
    return canonical(df, text_col, "form", table), table

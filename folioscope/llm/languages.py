"""Languages of documents and of their lines, by cross-parsing entropy.

A suffix automaton is built of sampled labelled text of each language.  A text is parsed into the
longest phrases that stand somewhere in that text; the language that needs the fewest, weighted by
the logarithm of its sample's length, wins.  Every piece of PIECE characters is read to its end in
every language.  Lines are parsed on their own; a change of language from line to line has a price,
so that short lines follow their neighbours unless they are clear.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import spread

#: Languages and what labels call them (codes and names, without region, in lower case).
LANGUAGES = {
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "en": ("en", "eng", "english"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "it": ("it", "ita", "italian", "italiano"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "ru": ("ru", "rus", "russian", "русский"),
    "zh": ("zh", "zho", "chi", "chinese", "中文", "汉语", "漢語"),
}
NAMES = {a: k for k, v in LANGUAGES.items() for a in v}
#: Bound of the fitted sample: characters of training text per language.
TRAIN_CHARS = 48_000
#: Documents drawn per language before lines are chosen.
TRAIN_DOCS = 160
#: Price in bits of another language than the line before, and letters that a line needs to have one.
SWITCH, LETTERS = 32.0, 3
#: A sampled line is used if its own language needs less than this share of any other's bits.
CLEAR = 0.9
#: How often the sample's halves judge each other.
ROUNDS = 2
#: Length of the pieces a line is parsed in, and how many are parsed at a time.
PIECE, AT_ONCE = 256, 16_384
#: A line of so many characters counts for a mixture.
LONG_LINE = 25
_COMMANDS = re.compile(r"\\(?:begin|end|cite[a-z]*|label|ref|eqref|usepackage|documentclass|bibliographystyle|bibliography|includegraphics|input|include)\*?\s*(?:\[[^\]]*\])?\s*(?:\{[^{}]*\})?|\\[a-zA-Z]+\*?")
_MARKUP = re.compile(r"</?[a-zA-Z][^<>]{0,200}>|<\|[^<>|]{1,40}\|>|https?://\S+|www\.\S+|\S+@\S+\.\S+")
_ASCII = "".join(chr(c) if chr(c).isalpha() else " " for c in range(128))
_REST = re.compile(r"[\W\d_]+")
_UNSEEN = re.compile("[" + "".join(f"\\U{c:08x}" for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf") + "]+")


def named(label: str | None) -> str | None:
    """The language a label names, by code, regional code or name in any case; None if none."""
    if label is None:
        return None
    bare = unicodedata.normalize("NFC", label).strip().lower()
    return NAMES.get(bare) or NAMES.get(re.split(r"[-_]", bare)[0])


def letters(line: str) -> str:
    """A line's letters, lower case, with single spaces between and around them; "" if it has few."""
    if "\\" in line:
        line = _COMMANDS.sub(" ", line)
    if "<" in line or "@" in line or "http" in line or "www" in line:
        line = _MARKUP.sub(" ", line)
    if line.isascii():
        bare = " ".join(line.lower().translate(_ASCII).split())
    else:
        line = unicodedata.normalize("NFC", line)
        bare = _REST.sub(" ", (line if line.isprintable() else _UNSEEN.sub("", line)).lower()).strip()
    return f" {bare} " if len(bare) - bare.count(" ") >= LETTERS or any(c > "\u2e80" for c in bare) else ""


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in codes:
        cur = len(moves)
        moves.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return moves


#: States of more moves than this have a stretch of the table to themselves at first.
_WIDE = 12


def _pack(src: np.ndarray, code: np.ndarray, to: np.ndarray, states: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All moves in one table, as (base, owner, to): the move of state s by code c is at base[s] + c
    if the owner of that place is s, else there is none.  No two moves share a place.

    Wide states come first, side by side; those of several moves are tried at random places, those
    of one fill what is free.
    """
    order = np.lexsort((code, src))
    src, code, to = src[order], code[order], to[order]
    first = np.flatnonzero(np.r_[True, src[1:] != src[:-1]])[: len(src)]
    row, many = src[first], np.diff(np.r_[first, len(src)])
    low, base = code[first], np.zeros(states, np.int64)
    owner, target = np.full(len(src) * 3 // 2 + 2 * width, -1, np.int32), np.zeros(len(src) * 3 // 2 + 2 * width, np.int32)

    def longer(by: int) -> None:
        nonlocal owner, target
        owner, target = np.r_[owner, np.full(by, -1, np.int32)], np.r_[target, np.zeros(by, np.int32)]

    def put(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Puts rows at bases if their places are free and no other row takes them; which were put."""
        n = many[rows]
        begin = np.cumsum(n) - n
        move = np.repeat(first[rows] - begin, n) + np.arange(n.sum())
        place = np.repeat(at, n) + code[move]
        free = owner[place] < 0
        claim = owner.copy()
        claim[place[free]] = src[move[free]]  # of several the last one has it
        done = np.logical_and.reduceat(free & (claim[place] == src[move]), begin)
        won = np.repeat(done, n)
        owner[place[won]], target[place[won]] = src[move[won]], to[move[won]]
        base[row[rows[done]]] = at[done]
        return done

    # Places start at `width`, so that no base is negative, and end `width` before the table does.
    wide = np.flatnonzero(many > _WIDE)
    if len(wide):
        span = code[first[wide] + many[wide] - 1] - low[wide] + 1
        longer(int(span.sum()))
        put(wide, width + np.cumsum(span) - span - low[wide])
    left, draw = np.flatnonzero((many > 1) & (many <= _WIDE)), np.random.default_rng(0)
    while len(left):
        longer(int(many[left].sum()) // 4 + width)
        left = left[~put(left, draw.integers(width, len(owner) - 2 * width, len(left)) - low[left])]
    one = np.flatnonzero(many == 1)
    free = np.flatnonzero(owner[width:-width] < 0) + width
    if len(free) < len(one):
        free = np.r_[free, np.arange(len(one) - len(free)) + len(owner) - width]
        longer(len(one))
    free = free[: len(one)]
    base[row[one]], owner[free], target[free] = free - low[one], row[one], to[first[one]]
    return base, owner, target


@dataclass
class Model:
    """Automata of all languages in one table of moves."""

    names: list[str]
    alphabet: np.ndarray  # code of each code point, 0 if it isn't in any sample
    start: np.ndarray  # root of each language
    base: np.ndarray  # of a state: its move by code c is at base + c
    owner: np.ndarray  # state whose move is at a place
    to: np.ndarray  # where it leads
    bits: np.ndarray  # of a phrase, by language

    @staticmethod
    def fit(samples: dict[str, list[str]]) -> Model:
        """samples: lines, as from `letters`, of each language."""
        names = sorted(k for k, v in samples.items() if v)
        seen = sorted({c for k in names for line in samples[k] for c in line})
        alphabet = np.zeros(0x110000, np.int32)
        for i, c in enumerate(seen):
            alphabet[ord(c)] = i + 2  # 1 parts lines
        start, bits, base = [], [], 0
        src, code, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for name in names:
            codes = [c for line in samples[name] for c in (*alphabet[np.frombuffer(line.encode("utf-32-le"), np.uint32)].tolist(), 1)]
            moves = suffix_automaton(codes)
            start.append(base)
            bits.append(np.log2(len(codes) + 2))
            src.append(np.repeat(np.arange(base, base + len(moves)), [len(x) for x in moves]))
            code.append(np.fromiter((c for x in moves for c in x), np.int64))
            to.append(np.fromiter((t for x in moves for t in x.values()), np.int64) + base)
            base += len(moves)
        table = _pack(np.concatenate(src), np.concatenate(code), np.concatenate(to), base, len(seen) + 2)
        return Model(names, alphabet, np.array(start, np.int64), *table, np.array(bits))

    def costs(self, lines: list[str], probe: int = PIECE, margin: float = np.inf) -> np.ndarray:
        """Bits of each line in each language: phrases times bits of a phrase.

        probe and margin are taken from older callers only: all of a line is read in all languages,
        whatever they are.
        """
        out = np.zeros((len(lines), len(self.names)))
        owner: list[int] = []
        pieces: list[str] = []
        for i, line in enumerate(lines):
            for a in range(0, len(line), PIECE):
                owner.append(i)
                pieces.append(line[a : a + PIECE])
        if self.names:
            for a in range(0, len(pieces), AT_ONCE):
                np.add.at(out, owner[a : a + AT_ONCE], self._bits(pieces[a : a + AT_ONCE]))
        return out

    def _bits(self, pieces: list[str]) -> np.ndarray:
        sizes = np.array([len(p) for p in pieces])
        order = np.argsort(-sizes, kind="stable")
        codes = self.alphabet[np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)]
        begin = (np.cumsum(sizes) - sizes)[order]
        longer = np.searchsorted(-sizes[order], -np.arange(sizes.max()), side="left")  # pieces longer than t
        steps = [codes[begin[:m] + t] for t, m in enumerate(longer.tolist())]
        out = np.empty((len(pieces), len(self.names)))
        for k, root in enumerate(self.start.tolist()):
            out[order, k] = self._phrases(steps, len(pieces), root) * self.bits[k]
        return out

    def _phrases(self, steps: list[np.ndarray], n: int, root: int) -> np.ndarray:
        """Phrases of n pieces in the automaton of a root; steps holds the t-th codes of the pieces
        longer than t, which are the first ones."""
        state, count, home = np.full(n, root), np.zeros(n, np.int64), self.base[root]
        for c in steps:
            s = state[: len(c)]
            at = self.base.take(s) + c
            to = self.to.take(at)
            miss = np.flatnonzero(self.owner.take(at) != s)
            again = home + c.take(miss)
            lost = self.owner.take(again) != root
            count[miss] += (s.take(miss) != root).astype(np.int64) + lost
            to[miss] = np.where(lost, root, self.to.take(again))
            s[:] = to
        return count + (state != root)


def judge(lines: list[str], bare: list[str], costs: np.ndarray, switch: float = SWITCH) -> tuple[list[int], list[float]]:
    """Language and confidence of each line; -1 and 1.0 for lines without language.

    The cheapest path through the lines, where a change of language costs `switch`.
    """
    spoken = [i for i, b in enumerate(bare) if b]
    lang, sure = [-1] * len(lines), [1.0] * len(lines)
    if not spoken:
        return lang, sure
    best = costs[spoken].argmin(axis=1)
    if len(set(best.tolist())) == 1:
        path = best.tolist()
    else:
        total = costs[spoken[0]].copy()
        back = []
        for i in spoken[1:]:
            jump = total.min() + switch
            back.append(np.where(total <= jump, np.arange(len(total)), total.argmin()))
            total = np.minimum(total, jump) + costs[i]
        path = [int(total.argmin())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path.reverse()
    for i, p in zip(spoken, path, strict=True):
        row = costs[i].tolist()
        own, rest = row[p], min(row[:p] + row[p + 1 :], default=0.0)
        lang[i], sure[i] = p, max(0.0, 1 - own / rest) if rest else 1.0
    return lang, sure


def parts_of(model: Model, texts: list[str | None], long_line: int = LONG_LINE) -> list[list[tuple[int, str, float]]]:
    """Of each text: (0, language, confidence), and if it is mixed (k, language, confidence) of each
    non-blank line k, counted from 1.  Null and blank texts have nothing; und is a text or line
    without language."""
    split = [[x for x in t.split("\n") if x.strip()] if t else [] for t in texts]
    bare = [[letters(x) for x in lines] for lines in split]
    costs = model.costs([b for bs in bare for b in bs])
    out, at = [], 0
    for lines, bs in zip(split, bare, strict=True):
        own = costs[at : at + len(lines)]
        at += len(lines)
        lang, sure = judge(lines, bs, own)
        size: dict[int, int] = {}
        weigh: dict[int, float] = {}
        for x, p, s in zip(lines, lang, sure, strict=True):
            if p >= 0:
                size[p] = size.get(p, 0) + len(x.strip())
                weigh[p] = weigh.get(p, 0.0) + s * len(x.strip())
        rows: list[tuple[int, str, float]] = []
        if lines:
            top = max(size, key=lambda p: (size[p], -p)) if size else -1
            rows.append((0, model.names[top] if size else "und", weigh[top] / sum(size.values()) if size else 1.0))
            if len({p for x, p in zip(lines, lang, strict=True) if p >= 0 and len(x.strip()) >= long_line}) > 1:
                rows += [(k, model.names[p] if p >= 0 else "und", s) for k, (p, s) in enumerate(zip(lang, sure, strict=True), 1)]
        out.append(rows)
    return out


def _label(c: Column) -> Column:
    bare = F.lower(F.trim(c))
    table = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    return F.coalesce(table[bare], table[F.element_at(F.split(bare, "[-_]"), 1)])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, h, line) of texts: all their lines, long ones in equal parts of at most PIECE characters."""
    schema = pa.schema([("name", pa.string()), ("h", pa.int64()), ("line", pa.string())])
    for batch in batches:
        for name, h, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            lines = []
            for line in text.split("\n"):
                b = letters(line)
                if len(b) > 20:
                    n = -(-len(b) // PIECE)
                    lines += [b[len(b) * i // n : len(b) * (i + 1) // n] for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines), pa.string()), pa.array([h] * len(lines), pa.int64()), pa.array(lines, pa.string())], schema=schema)


def fit(docs: DataFrame, id_col: str, text_col: str, label_col: str, chars: int = TRAIN_CHARS, max_docs: int = TRAIN_DOCS) -> Model:
    """Automata from a bounded sample of labelled rows: about `max_docs` documents and at most `chars`
    characters per language, the documents chosen by a hash of their id, their lines by a hash of
    the line, wherever in the text it stands: one line of each document, then a second one, and so on.

    Labels can be wrong: the sample is halved, each half's lines are judged by the other half's
    automata, and lines judged otherwise than labelled are left out, ROUNDS times.
    """
    rows = docs.select(_label(F.col(label_col)).alias("name"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)).alias("h"), F.col(text_col).alias("text")).where("name is not null")
    counts = {r.name: r["count"] for r in rows.groupBy("name").count().collect()}  # reads labels only
    if not counts:
        return Model.fit({})
    below = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1 << 30, int((1 << 30) * max_docs / n)))])
    # About max_docs of each language, whatever its share, with the whole of their texts.
    drawn = rows.where(F.col("h") < below[F.col("name")]).where("length(trim(text)) > 40")
    lines = drawn.mapInArrow(_stretches, "name string, h long, line string").groupBy("name", "line").agg(F.min("h").alias("h"), F.xxhash64("line").alias("by"))
    turn = lines.withColumn("turn", F.row_number().over(Window.partitionBy("name", "h").orderBy("by", "line"))).withColumn("half", F.col("h") % 2)
    size = F.sum(F.length("line")).over(Window.partitionBy("name", "half").orderBy("turn", "by", "line").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    halves: list[dict[str, list[str]]] = [{k: [] for k in LANGUAGES}, {k: [] for k in LANGUAGES}]
    for r in turn.withColumn("size", size).where(F.col("size") <= chars // 2).orderBy("name", "size").collect():
        halves[r.half][r.name].append(r.line)
    # A wrong label that both halves repeat makes two languages alike.  So a margin is asked for, and
    # what is kept is judged again by halves without the worst.
    for _ in range(ROUNDS):
        models = [Model.fit(h) for h in halves]
        halves = [{k: _own_lines(models[1 - i], k, lines) for k, lines in half.items()} for i, half in enumerate(halves)]
    return Model.fit({k: [*halves[0][k], *halves[1][k]] for k in LANGUAGES})


def _own_lines(model: Model, name: str, lines: list[str]) -> list[str]:
    """Lines that are clearly of the language; all if the model knows no other or not this one."""
    if not lines or name not in model.names or len(model.names) < 2:
        return lines
    bits = model.costs(lines)
    mine = model.names.index(name)
    clear = bits[:, mine] < CLEAR * np.delete(bits, mine, axis=1).min(axis=1)
    return [x for x, ok in zip(lines, clear, strict=True) if ok]


def identify(docs: DataFrame, model: Model, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(doc_id, part_no, lang, confidence, label): part 0 for each document, parts k >= 1 for the
    non-blank lines of each mixed one; label is the language its label names.

    Null, empty and blank texts give no rows.  Repeated rows give theirs again.  No shuffle
    but to use all cores; extra columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("part_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("label", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                ids, texts, labels = (part.column(k).to_pylist() for k in range(3))
                rows = []
                for rid, label, parts in zip(ids, labels, parts_of(sent.value, texts), strict=True):
                    rows += [(rid, k, lang, sure, named(label)) for k, lang, sure in parts]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)

    return spread(docs.select(F.col(id_col).cast("long"), F.col(text_col), F.col(label_col))).mapInArrow(run, "doc_id long, part_no int, lang string, confidence double, label string")

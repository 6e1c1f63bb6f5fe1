"""Order and containment of a document's parts: ids, blocks, sequences, pairings and reordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Headings by the name of their section.
SECTION_ALIASES = {
    "abstract": ("abstract",),
    "introduction": ("introduction", "background"),
    "results": ("results",),
    "discussion": ("discussion",),
    "methods": ("methods", "materials and methods", "online methods"),
    "data_availability": ("data availability", "availability of data", "data and materials availability"),
    "code_availability": ("code availability", "availability of code"),
    "author_contributions": ("author contributions", "author contribution statement"),
    "competing_interests": ("competing interests", "conflict of interest", "conflicts of interest"),
    "acknowledgements": ("acknowledgements", "acknowledgments"),
    "ethics": ("ethics", "ethical approval"),
    "consent": ("consent", "consent to participate"),
    "funding": ("funding", "funding information"),
}


def normal_heading(folded: Column) -> Column:
    """A folded heading with single spaces for everything that isn't a letter, digit or underscore."""
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}\p{M}_]+", " "))


def section_name(folded: Column) -> Column:
    """The section a folded heading names exactly, null if none."""
    table = F.create_map(*[F.lit(x) for name, aliases in SECTION_ALIASES.items() for a in aliases for x in (a, name)])
    return table[normal_heading(folded)]


# Signs of the matter before the text, as words of a folded line.
FRONT_WORDS = (
    "university|institute|department|laboratory|centre|center|hospital|correspondence|affiliation|jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
)


def words_in(c: Column) -> Column:
    """Runs of letters and digits."""
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}]+"))


def front_matter(line: Column) -> Column:
    """Whether a line looks like an address, an affiliation or a date."""
    return F.contains(line, F.lit("@")) | F.lower(line).rlike(rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{FRONT_WORDS})(?:[^\p{{L}}\p{{N}}_]|$)")


def plausible_title(line: Column) -> Column:
    """Whether a line could be a title: 3 to 40 words, at most 300 characters, no stop or colon at its end."""
    return words_in(line).between(3, 40) & (F.length(line) <= 300) & ~F.substring(line, -1, 1).isin(".", ":", ";")


def numbered_parts(line: Column) -> Column:
    """{major, minor, level} of a numbered heading of at most 20 words and 200 characters, else null."""
    pattern = r"^\s*([1-9]\d*)(?:\.([1-9]\d*))?[.)]?\s+(.+?)\s*\z"
    rest = F.regexp_extract(line, pattern, 3)
    good = (rest != "") & words_in(rest).between(1, 20) & (F.length(line) <= 200) & ~F.substring(rest, -1, 1).isin(".", ";")
    minor = F.regexp_extract(line, pattern, 2).try_cast("int")
    return F.when(good, F.struct(F.regexp_extract(line, pattern, 1).try_cast("int").alias("major"), minor.alias("minor"), F.when(minor.isNull(), 1).otherwise(2).alias("level")))


def flattened_abstract(text: Column) -> Column:
    """The body of a text that begins with the word Abstract run into it; null if it isn't surely one.

    A colon, white space or a capital must follow, and the body begin with a capital and have 8 words
    and 50 characters.
    """
    bare = F.trim(F.replace(text, F.lit("\u00a0"), F.lit(" ")))
    body = F.regexp_extract(bare, r"(?s)^Abstract(?::\s*|\s+|(?=\p{Lu}))(.+)\z", 1)
    return F.when(body.rlike(r"^\p{Lu}") & (words_in(body) >= 8) & (F.length(body) >= 50), body)


def plain_heading(line: Column, section: Column) -> Column:
    """Level of an unstyled heading that names a known section, numbered or not; null for other lines."""
    number = F.regexp_extract(line, r"^\s*([1-9]\d*)(?:\.([1-9]\d*))?[.)]?\s+\S", 2)
    return F.when(section.isNotNull(), F.when(number != "", 2).otherwise(1))


def stable_ids(df: DataFrame, scope: str, prefix: str, content: Column, order: str) -> DataFrame:
    """df with `stable_id`: prefix and 16 hex digits of the content's sha256, and a running number
    from 2 where a scope has the content again.  Null content counts as empty."""
    base = F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.coalesce(content, F.lit("")), 256), 1, 16))
    rows = df.withColumn("_base", base)
    n = F.row_number().over(Window.partitionBy(scope, "_base").orderBy(order))
    return rows.withColumn("_n", n).withColumn("stable_id", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat_ws(".", "_base", F.col("_n").cast("string")))).drop("_base", "_n")


def blocks(df: DataFrame, doc: str, seq: str, label: Column) -> DataFrame:
    """(doc, label, start, end): half-open blocks of a sequence, each from a labelled row to the next.

    Rows before the first label form the block front_matter; null labels start none.
    """
    rows = df.select(doc, F.col(seq).alias("_seq"), label.alias("label"))
    size = rows.groupBy(doc).agg(F.min("_seq").alias("_lo"), (F.max("_seq") + 1).alias("_hi"))
    front = size.select(doc, F.lit("front_matter").alias("label"), F.col("_lo").alias("start"), F.lit(0).alias("_k"))
    marks = rows.where("label is not null").select(doc, "label", F.col("_seq").alias("start"), F.lit(1).alias("_k")).unionByName(front).join(size.select(doc, "_hi"), doc)
    ended = marks.withColumn("end", F.coalesce(F.lead("start").over(Window.partitionBy(doc).orderBy("start", "_k")), F.col("_hi")))
    return ended.where("end > start").select(doc, "label", "start", "end")


def members(rows: DataFrame, found: DataFrame, doc: str, seq: str) -> DataFrame:
    """Rows with the label of the block that contains them: an interval join within the document."""
    b = found.withColumnRenamed(doc, "_doc")
    return rows.join(b, (rows[doc] == b["_doc"]) & (rows[seq] >= b["start"]) & (rows[seq] < b["end"])).drop("_doc")


def in_order(df: DataFrame, doc: str, seq: str, label: str, wanted: list[str]) -> DataFrame:
    """(doc, n_labels, in_order): whether the first places of the wanted labels rise; others don't count."""
    rank = F.create_map(*[F.lit(x) for i, w in enumerate(wanted) for x in (w, i)])
    first = df.select(doc, F.col(seq).alias("_s"), rank[F.col(label)].alias("_r")).where("_r is not null").groupBy(doc, "_r").agg(F.min("_s").alias("_s"))
    lists = first.groupBy(doc).agg(F.count("*").alias("n_labels"), F.array_sort(F.collect_list(F.struct("_r", "_s"))).alias("_l"))
    places = F.transform("_l", lambda x: x["_s"])
    return lists.select(doc, "n_labels", (places == F.array_sort(places)).alias("in_order"))


def reordered(df: DataFrame, doc: str, seq: str, label: str, wanted: list[str]) -> DataFrame:
    """df with `new_seq`: blocks of the wanted labels in that order at their own places, all else kept."""
    rank = F.create_map(*[F.lit(x) for i, w in enumerate(wanted) for x in (w, i)])
    rows = df.withColumn("_r", rank[F.col(label)])
    slots = F.row_number().over(Window.partitionBy(doc, F.col("_r").isNotNull()).orderBy(seq))
    sorted_in = F.row_number().over(Window.partitionBy(doc, F.col("_r").isNotNull()).orderBy("_r", seq))
    placed = rows.withColumns({"_slot": slots, "_rank": sorted_in})
    targets = placed.where("_r is not null").select(doc, F.col("_slot").alias("_rank"), F.col(seq).alias("_to"))
    moved = placed.where("_r is not null").join(targets, [doc, "_rank"]).withColumn("new_seq", F.col("_to")).drop("_to")
    return moved.unionByName(placed.where("_r is null").withColumn("new_seq", F.col(seq))).drop("_r", "_slot", "_rank")


def paired(left: DataFrame, right: DataFrame, doc: str, seq: str, a: str, b: str) -> DataFrame:
    """(doc, k, a, b): the k-th of one kind with the k-th of the other; what is left over is dropped."""
    order = Window.partitionBy(doc).orderBy(seq)
    x = left.select(doc, F.row_number().over(order).alias("k"), F.col(a))
    y = right.select(doc, F.row_number().over(order).alias("k"), F.col(b))
    return x.join(y, [doc, "k"])


def neighbours(left: DataFrame, right: DataFrame, doc: str, seq: str, a: str, b: str) -> DataFrame:
    """(doc, a, b): a row with the only row of the other kind right before or after it."""
    y = right.select(doc, F.explode(F.array(F.col(seq) - 1, F.col(seq) + 1)).alias("_at"), F.col(b))
    met = left.select(doc, F.col(seq).alias("_at"), F.col(a)).join(y, [doc, "_at"])
    return met.groupBy(doc, "_at", a).agg(F.count("*").alias("_n"), F.min(b).alias(b)).where("_n = 1").select(doc, a, b)


def numbered(headings: Column) -> Column:
    """Accepted entries of an ordered array of heading texts: [{i, major, minor}].

    `n` is accepted as the next top number, `n.m` as the next below the active top; all others are
    passed over.  A state machine, folded inside the row.
    """
    major = lambda t: F.regexp_extract(t, r"^\s*(\d+)(?:\.(\d+))?[.)]?\s+\S", 1).try_cast("int")
    minor = lambda t: F.regexp_extract(t, r"^\s*(\d+)(?:\.(\d+))?[.)]?\s+\S", 2).try_cast("int")
    start = F.expr("named_struct('top', 0, 'sub', 0, 'out', cast(array() as array<struct<i: int, major: int, minor: int>>))")

    def step(state: Column, x: Column) -> Column:
        a, b = major(x["t"]), minor(x["t"])
        entry = F.array(F.struct(x["i"].alias("i"), a.alias("major"), b.alias("minor")))
        top = b.isNull() & (a == state["top"] + 1)
        sub = (a == state["top"]) & (b == state["sub"] + 1)
        pick = lambda yes, alt, no: F.when(top, yes).when(sub, alt).otherwise(no)
        return F.struct(pick(a, state["top"], state["top"]).alias("top"), pick(F.lit(0), b, state["sub"]).alias("sub"), F.when(top | sub, F.concat(state["out"], entry)).otherwise(state["out"]).alias("out"))

    return F.aggregate(F.transform(headings, lambda t, i: F.struct(i.alias("i"), t.alias("t"))), start, step, lambda s: s["out"])

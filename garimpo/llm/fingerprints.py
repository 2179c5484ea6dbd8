"""Merkle-tree fingerprints of documents, in DataFrame functions only.

A text is cut at blank lines into sections, these at line ends into paragraphs, and these by content
into leaves: behind words, or single characters of scripts without spaces, whose hash is a multiple of
``ONE_IN``. A cut depends on the word before it alone, so an edit changes the leaves it touches and
the nodes above them. Node hashes join their children's; every cut can be undone, so equal roots mean
equal texts. The fingerprint is the root and the short code of each leaf: ``root:code code ...``
without blanks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from garimpo.llm.common import documents, texts_of
from garimpo.llm.registry import query
from garimpo.schema import stage

#: Thai, Lao, Burmese, Khmer and the scripts of East Asia, which are written without spaces.
DENSE = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{10FFFF}"
#: A word with the white space behind it (longer words come in parts), a dense character, or white space.
WORD = rf"[^ \t\r{DENSE}]{{1,16}}[ \t\r]*|[{DENSE}]|[ \t\r]+"
ONE_IN = 3
#: A leaf is at most so many characters, as where one word without a cut is repeated over and over.
LEAF = r"[^\n]{1,48}"
CODE_LENGTH = 8


def leaves(paragraph: Column) -> Column:
    """The leaves of a line, in order. A line end, which a line does not hold, marks the cuts."""
    words = F.regexp_extract_all(paragraph, F.lit(WORD), F.lit(0))
    marked = F.transform(
        words,
        lambda w: F.when(
            (F.ascii(w) + 3 * F.ascii(F.substring(w, 2, 1)) + 5 * F.char_length(w)) % ONE_IN == 0, F.concat(w, F.lit("\n"))
        ).otherwise(w),
    )
    return F.regexp_extract_all(F.array_join(marked, ""), F.lit(LEAF), F.lit(0))


def levels(text: Column) -> Column:
    """Leaf hashes by section and paragraph: an array of arrays of arrays."""
    return F.transform(
        F.split(text, "\n\n", -1),
        lambda section: F.transform(
            F.split(section, "\n", -1), lambda paragraph: F.transform(leaves(paragraph), F.md5)
        ),
    )


def paragraph_hash(leaves: Column) -> Column:
    return F.md5(F.concat(F.lit("p"), F.concat_ws("", leaves)))


def section_hash(paragraphs: Column) -> Column:
    return F.md5(F.concat(F.lit("s"), F.concat_ws("", F.transform(paragraphs, paragraph_hash))))


def root(tree: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(tree, section_hash)), 256)


def codes(tree: Column) -> Column:
    """Short codes of all leaves, in order."""
    return F.transform(F.flatten(F.flatten(tree)), lambda leaf: F.substring(leaf, 1, CODE_LENGTH))


def fingerprint(root_: Column, codes_: Column) -> Column:
    return F.concat(root_, F.lit(":"), F.concat_ws("", codes_))


def numbered(codes_: Column) -> Column:
    """Each code with its number among equal ones, so that a set of the result counts repeats.

    Sorted and joined, equal codes are runs, which a pattern finds in one pass.
    """
    runs = F.regexp_extract_all(
        F.array_join(F.array_sort(codes_), ""), F.lit(rf"(.{{{CODE_LENGTH}}})\1*"), F.lit(0)
    )
    return F.flatten(
        F.transform(
            runs,
            lambda run: F.transform(
                F.sequence(F.lit(1), (F.char_length(run) / CODE_LENGTH).cast("int")),
                lambda i: F.concat(F.substring(run, 1, CODE_LENGTH), i.cast("string")),
            ),
        )
    )


def likeness(root_a: Column, codes_a: Column, root_b: Column, codes_b: Column) -> Column:
    """1 for equal roots, else the Dice coefficient of the leaves, repeats counted (0 without leaves)."""
    shared = F.size(F.array_intersect(numbered(codes_a), numbered(codes_b)))
    both = F.size(codes_a) + F.size(codes_b)
    return F.when(root_a == root_b, 1.0).when(both == 0, 0.0).otherwise(2.0 * shared / both)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text, tree, root, codes`` of each row; a null text counts as empty."""
    return fingerprints_of(texts_of(docs))


def fingerprints_of(rows: DataFrame) -> DataFrame:
    """``rows`` with the tree, root and codes of their ``text``."""
    rows = rows.withColumn("tree", levels(F.col("text")))
    return rows.withColumns({"root": root(F.col("tree")), "codes": codes(F.col("tree"))})


def edits(before: DataFrame, after: DataFrame) -> DataFrame:
    """Where two versions differ: ``doc_id, section, paragraph`` for each differing paragraph.

    ``before`` and ``after`` are results of ``fingerprints``. Documents with equal roots are left
    out, and only sections with different hashes are opened.
    """
    a = before.select("doc_id", F.col("root").alias("root_a"), F.col("tree").alias("tree_a"))
    b = after.select("doc_id", F.col("root").alias("root_b"), F.col("tree").alias("tree_b"))
    pairs = a.join(b, "doc_id").where(F.col("root_a") != F.col("root_b"))
    sections = pairs.select(
        "doc_id", F.posexplode(F.arrays_zip("tree_a", "tree_b")).alias("section", "both")
    ).where(~section_hash("both.tree_a").eqNullSafe(section_hash("both.tree_b")))
    lines = sections.select(
        "doc_id", "section",
        F.posexplode(
            F.arrays_zip(
                F.coalesce("both.tree_a", F.array()).alias("leaves_a"),
                F.coalesce("both.tree_b", F.array()).alias("leaves_b"),
            )
        ).alias("paragraph", "line"),
    )
    return lines.where(~F.col("line").getField("leaves_a").eqNullSafe(F.col("line").getField("leaves_b"))).select(
        "doc_id", "section", "paragraph"
    )


def successors(rows: DataFrame) -> DataFrame:
    """``doc_id, next_id, need``: the next id in ascending order, cyclic, and a quarter of the
    characters of the document before it.

    A global sort gives each id its place in a partition; the sizes of the partitions before, one
    row per partition, make it a place in the table; neighbours are joined by place.
    """
    lengths = stage(
        rows.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.char_length("text")).alias("chars"))
    )
    placed = stage(lengths.orderBy("doc_id").withColumn("slot", F.monotonically_increasing_id()))
    part = F.shiftright("slot", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    bases = sizes.select(
        "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"),
        F.sum("size").over(Window.partitionBy()).alias("all"),
    )
    indexed = stage(
        placed.withColumn("part", part).join(F.broadcast(bases), "part").select(
            "doc_id", "chars", "all", (F.col("base") + F.col("slot").bitwiseAND(2**33 - 1)).alias("place")
        )
    )
    left = indexed.select(
        F.col("doc_id").alias("prev_id"), F.floor(F.col("chars") / 4).alias("need"),
        ((F.col("place") + 1) % F.col("all")).alias("place"),
    )
    return stage(left.join(indexed.select("doc_id", "place"), "place").select("prev_id", "need", "doc_id"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text and of its edited text, and how alike they and the next one's are.

    The edited text has the last quarter of its characters replaced by the first characters of the
    next document, in ascending order of ``doc_id``, cyclic. A null text counts as empty; two empty
    texts are alike (1.0). Rows that share a ``doc_id`` have the same next document, whose text is
    the one whose needed beginning comes first in order. A row without ``doc_id`` has no next document: its last
    quarter is cut off and ``near_next`` is null. Further columns of ``docs`` are ignored.
    """
    rows = texts_of(docs)
    # only texts are shuffled by id, once for both joins; hashes are computed behind the shuffle
    named = rows.where("doc_id is not null")
    with_next = fingerprints_of(named.join(successors(rows), "doc_id"))
    heads = with_next.groupBy(F.col("prev_id").alias("doc_id")).agg(
        F.min(
            F.struct(
                F.expr("substring(text, 1, cast(need as int))").alias("head"), F.col("root").alias("next_root"),
                F.unhex(F.concat_ws("", "codes")).alias("next_leaves"),
            )
        ).alias("next")
    ).select("doc_id", "next.*")
    kept = F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 4) as int))")
    joined = named.join(heads, "doc_id", "left").unionByName(rows.where("doc_id is null"), allowMissingColumns=True)
    next_codes = F.regexp_extract_all(F.lower(F.hex("next_leaves")), F.lit(f".{{{CODE_LENGTH}}}"), F.lit(0))
    whole = fingerprints_of(joined).select(
        "doc_id", F.char_length("text").cast("bigint").alias("n_chars"), "root", "codes", "next_root",
        next_codes.alias("next_codes"), F.concat(kept, F.coalesce("head", F.lit(""))).alias("edited"),
    )
    whole = whole.withColumn("edited_tree", levels(F.col("edited"))).withColumns(
        {"edited_root": root(F.col("edited_tree")), "edited_codes": codes(F.col("edited_tree"))}
    )
    return whole.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("root"), F.col("codes")).alias("fingerprint"),
        fingerprint(F.col("edited_root"), F.col("edited_codes")).alias("edited_fingerprint"),
        likeness(F.col("root"), F.col("codes"), F.col("edited_root"), F.col("edited_codes")).alias("near_edited"),
        likeness(F.col("root"), F.col("codes"), F.col("next_root"), F.col("next_codes")).alias("near_next"),
    )


_LEAVES = """regexp_extract_all(array_to_string(list_transform(regexp_extract_all(p, '{word}'),
    lambda w: CASE WHEN (ascii(w) + 3 * ascii(substr(w, 2, 1)) + 5 * length(w)) % {one_in} = 0 THEN w || chr(10) ELSE w END),
    ''), '{leaf}')""".format(word=WORD, one_in=ONE_IN, leaf=LEAF)
_TREE = """list_transform(string_split({0}, chr(10) || chr(10)), lambda s: list_transform(
    string_split(s, chr(10)), lambda p: list_transform({1}, lambda x: md5(x))))"""
_ROOT = """sha256(array_to_string(list_transform({0}, lambda s: md5('s' || array_to_string(
    list_transform(s, lambda p: md5('p' || array_to_string(p, ''))), ''))), ''))"""
_CODES = "list_transform(flatten(flatten({0})), lambda x: substr(x, 1, 8))"
_LIKE = """CASE WHEN {0} = {2} THEN 1.0::DOUBLE WHEN len({1}) + len({3}) = 0 THEN 0.0::DOUBLE
    ELSE 2.0::DOUBLE * coalesce(list_sum(list_transform(list_distinct({1}),
         lambda x: least(len(list_filter({1}, lambda y: y = x)), len(list_filter({3}, lambda z: z = x))))), 0)
         / (len({1}) + len({3})) END"""


def _sql() -> str:
    tree = _TREE.format
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id) - 1 AS place,
                  count(*) OVER () AS n FROM documents),
t AS (SELECT *, {tree('text', _LEAVES)} AS tree FROM d),
f AS (SELECT *, {_ROOT.format('tree')} AS root, {_CODES.format('tree')} AS codes FROM t),
e AS (SELECT a.doc_id, a.root, a.codes, b.root AS next_root, b.codes AS next_codes, length(a.text) AS n_chars,
             substr(a.text, 1, length(a.text) - length(a.text) // 4) || substr(b.text, 1, length(a.text) // 4) AS edited
      FROM f a JOIN f b ON b.place = (a.place + 1) % a.n),
g AS (SELECT *, {tree('edited', _LEAVES)} AS edited_tree FROM e),
h AS (SELECT *, {_ROOT.format('edited_tree')} AS edited_root, {_CODES.format('edited_tree')} AS edited_codes FROM g)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256,
       root || ':' || array_to_string(codes, '') AS fingerprint,
       edited_root || ':' || array_to_string(edited_codes, '') AS edited_fingerprint,
       {_LIKE.format('root', 'codes', 'edited_root', 'edited_codes')} AS near_edited,
       {_LIKE.format('root', 'codes', 'next_root', 'next_codes')} AS near_next
FROM h
"""


@query("op5_fingerprints", _sql())
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(documents(spark, sf_dir))

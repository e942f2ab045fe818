"""Line dedup by a tree of log templates.

A line falls to a leaf of a tree of fixed depth by its number of words and its leading words; words with a digit count as
variable. In leaves that lines of enough texts reach, a word is constant if it stands at its place in a given share of the
leaf's lines, other words are variable fields; what is left is the line's template. A leaf of one template is read well by
a large share, one that several templates share by a small one, so both are tried (LEVELS). Lines whose template recurs in
enough texts are dropped from all documents. Shares keep templates the same as data grow. Everything is a DataFrame
expression. Lines are dealt by leaf, never words: words meet their leaf's constants, one row for each leaf, in arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, documents, hex_sha256, materialize

#: Words that lead to a leaf; texts that make a template recur, and lines that a constant word needs at least; the shares
#: of a leaf's lines (percent) that make a word constant; the share of a template's words without digits that must be.
DEPTH, MIN_TEXTS, LEVELS, CONSTANT_PERCENT = 3, 10, (50, 5), 70
FIELD = "<*>"
_BLANK = " \t\n\x0b\f\r"


def _masked(word) -> F.Column:
    return F.when(word.rlike("[0-9]"), F.lit(FIELD)).otherwise(word)


def _tree_lines(docs: DataFrame) -> DataFrame:
    """(row, digest, line, leaf, text) of the lines with a word of documents (row, text), digest being the whole text's."""
    each = docs.select("row", F.xxhash64("text").alias("digest"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "x"))
    each = each.withColumn("x", F.btrim("x", F.lit(_BLANK))).where("x <> ''").withColumn("words", F.split("x", SPACE))
    lead = F.transform(F.slice("words", 1, DEPTH), _masked)
    return each.select("row", "digest", "line", F.xxhash64(F.size("words"), F.array_join(lead, " ")).alias("leaf"), F.col("x").alias("text"))


def _leaf_constants(lines: DataFrame, min_texts: int) -> DataFrame:
    """(leaf, constants) of lines (digest, leaf, words as hashes, 0 for a field): an array with an entry for each place, of
    one array for each level: the constant words there. A level has 100 / its percent words at most for a place. A line
    that comes several times in one text counts once."""
    once = lines.select("digest", "leaf", "words").distinct()
    leaves = once.groupBy("leaf").agg(F.count("*").alias("of"), F.max(F.size("words")).alias("n"))
    leaves = materialize(leaves, "leaf-sizes")
    words = once.select("leaf", F.posexplode("words").alias("place", "word")).where("word <> 0").groupBy("leaf", "place", "word").agg(F.count("*").alias("count")).where(F.col("count") >= min_texts)
    constant = words.join(leaves, "leaf").where(100 * F.col("count") >= min(LEVELS) * F.col("of"))
    level = lambda percent: F.when(100 * F.col("count") >= percent * F.col("of"), F.col("word")).alias(f"c{percent}")
    none = [F.lit(None).cast("long").alias(f"c{x}") for x in LEVELS]
    places = leaves.select("leaf", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("place"), *none)
    at = constant.select("leaf", "place", *map(level, LEVELS)).unionByName(places).groupBy("leaf", "place").agg(F.array(*[F.collect_list(f"c{x}") for x in LEVELS]).alias("c"))
    return at.groupBy("leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "c"))), lambda x: x["c"]).alias("constants"))


def recurring_lines(docs: DataFrame, min_texts: int = MIN_TEXTS, percent: int = CONSTANT_PERCENT) -> DataFrame:
    """(row, line) of the lines to drop of documents (row, text); line counts from 0. Equal texts count once."""
    lines = materialize(_tree_lines(docs), "tree-lines")
    leaves = materialize(lines.select("digest", "leaf").distinct().groupBy("leaf").count().where(F.col("count") >= min_texts).select("leaf"), "leaves")
    hashed = F.transform(F.split("text", SPACE), lambda w: F.when(w.rlike("[0-9]"), F.lit(0).cast("long")).otherwise(F.xxhash64(w)))
    held = materialize(lines.join(leaves.hint("merge"), "leaf", "left_semi").select("row", "digest", "line", "leaf", hashed.alias("words")), "lines")
    constants = materialize(_leaf_constants(held, min_texts), "constants")
    marked = held.join(constants.hint("merge"), "leaf").withColumn("plain", F.size(F.filter("words", lambda w: w != 0)))
    own = lambda i: F.transform("words", lambda w, p: F.when(F.array_contains(F.get(F.get("constants", p), F.lit(i)), w), w).otherwise(F.lit(0).cast("long")))
    marked = marked.select("row", "digest", "line", "leaf", "plain", *[own(i).alias(f"t{level}") for i, level in enumerate(LEVELS)])
    template = lambda t, level: F.when((F.size(F.filter(t, lambda w: w != 0)) * 100 >= percent * F.col("plain")) & (F.col("plain") > 0), F.xxhash64("leaf", F.lit(level), t))
    made = F.array_compact(F.array(*[template(f"t{x}", x) for x in LEVELS]))
    templates = materialize(marked.select("row", "digest", "line", F.explode(made).alias("template")), "templates")
    frequent = materialize(templates.select("template", "digest").distinct().groupBy("template").count().where(F.col("count") >= min_texts).select("template"), "frequent")
    return templates.join(frequent.hint("merge"), "template", "left_semi").select("row", "line").distinct()


def drop_recurring_lines(docs: DataFrame, min_texts: int = MIN_TEXTS, percent: int = CONSTANT_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept_text (the other lines, joined by line feeds).

    A null text is one empty line. Lines without a word, and such whose words all have digits, are kept. Rows with a null
    or repeated id count by themselves; equal texts count once when templates are counted, so that copies of a document
    don't make all of its own lines recur. Other columns aren't read.
    """
    # Row numbers must be the same in both uses below, so they are kept as a table, without the texts where ids suffice.
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    whole = dict(plain.dtypes)["doc_id"] in ("int", "bigint") and plain.where("doc_id IS NULL").isEmpty() and plain.groupBy("doc_id").count().where("count > 1").isEmpty()
    rows = plain.withColumn("row", F.col("doc_id").cast("long")) if whole else materialize(plain.withColumn("row", F.monotonically_increasing_id()), "rows")
    drops = materialize(recurring_lines(rows.select("row", "text"), min_texts, percent).groupBy("row").agg(F.collect_list("line").alias("drop")), "drops")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    # At every size the same join: a broadcast while drops are few would only hide that texts are dealt by row.
    out = rows.join(drops.hint("merge"), "row", "left").withColumn("lines", lines)
    kept = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.filter("lines", lambda x, i: ~F.array_contains("drop", i)), "\n"))
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(kept, F.lit("")).alias("kept_text"))


def query(spark, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", hex_sha256(F.col("kept_text")).alias("kept_sha256"))


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM d),
w AS (SELECT *, list_transform(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> ''), lambda y: CASE WHEN regexp_matches(y, '[0-9]') THEN '{FIELD}' ELSE y END) AS words FROM l),
v AS (SELECT doc_id, text, line, words, [CAST(len(words) AS VARCHAR)] || words[1:{DEPTH}] AS leaf FROM w WHERE len(words) > 0),
lf AS (SELECT leaf FROM v GROUP BY leaf HAVING count(DISTINCT text) >= {MIN_TEXTS}),
h AS MATERIALIZED (SELECT * FROM v SEMI JOIN lf USING (leaf)),
o AS MATERIALIZED (SELECT DISTINCT leaf, text, words FROM h),
z AS (SELECT leaf, count(*) AS total FROM o GROUP BY leaf),
t AS (SELECT leaf, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM o),
c AS (SELECT leaf, place, word, count(*) AS n FROM t WHERE word <> '{FIELD}' GROUP BY leaf, place, word HAVING count(*) >= {MIN_TEXTS}),
e AS MATERIALIZED (SELECT leaf, place, word, level FROM c JOIN z USING (leaf) CROSS JOIN (VALUES {", ".join(f"({x})" for x in LEVELS)}) y(level) WHERE 100 * n >= level * total),
u AS (SELECT leaf, words, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM (SELECT DISTINCT leaf, words FROM o)),
m AS (SELECT leaf, words, level, list((place, word) ORDER BY place) AS constants FROM u JOIN e USING (leaf, place, word) GROUP BY leaf, words, level),
k AS MATERIALIZED (SELECT * FROM m WHERE 100 * len(constants) >= {CONSTANT_PERCENT} * len(list_filter(words, lambda y: y <> '{FIELD}'))),
f AS (SELECT leaf, level, constants FROM k JOIN o USING (leaf, words) GROUP BY leaf, level, constants HAVING count(DISTINCT text) >= {MIN_TEXTS}),
g AS (SELECT DISTINCT doc_id, line FROM h SEMI JOIN (SELECT leaf, words FROM k SEMI JOIN f USING (leaf, level, constants)) q USING (leaf, words))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(g.line) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(x, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN g USING (doc_id, line) GROUP BY doc_id
"""

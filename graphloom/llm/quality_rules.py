"""Quality rules: statistics of a text, and the frequency of its lines over the documents of its host.

Everything is a DataFrame expression. One pass over the texts makes a table of each row's statistics and of its lines'
hashes and word counts. Over that table the distinct documents that have a line are counted for each host; lines above
the limit are removed, and a document that loses too many of its words this way is rejected. The limit is a share of the
host's documents between two fixed numbers of them, so that it grows slower than the host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, documents, materialize

#: A line is removed if over this share of its host's documents have it, and over the first of these numbers; on over the
#: second it is removed whatever the share.
LINE_PERCENT, LINE_DOCS = 1, (20, 5000)
#: A document is depleted if under this share of its words is left.
LEFT_SHARE = 0.3
MIN_WORDS, MAX_REPEAT_SHARE = 10, 0.2
WINDOW = 5
_BLANK = " \t\n\x0b\f\r"


def _covered(sorted_windows) -> F.Column:
    """How many words lie in windows whose hash another window has, from the array of (hash, place) in order."""
    s = sorted_windows
    same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
    twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
    places = F.array_sort(F.transform(twice, lambda i: F.get(s, i)["i"]))
    # From the last window backwards, each adds the words up to the next one, WINDOW at most.
    state = F.aggregate(
        places,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
    )
    return state["n"]


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: doc_id, host ('' for null), n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, and lines: an array of (h, words) of the lines with a word, h being the hash of the line in lower
    case with single spaces."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    a = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), text.alias("text"))
    a = a.withColumns({
        "words": F.filter(F.split(F.btrim("text", F.lit(_BLANK)), SPACE), lambda w: w != ""),
        "n_symbols": F.octet_length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long"),
        "rows": F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_BLANK)) != ""),
    })
    b = a.select(
        "doc_id", "host", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("rows") - F.size(F.array_distinct("rows"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.transform("rows", lambda x: F.struct(
            F.xxhash64(F.lower(F.regexp_replace(F.btrim(x, F.lit(_BLANK)), SPACE, " "))).alias("h"),
            F.size(F.split(F.btrim(x, F.lit(_BLANK)), SPACE)).alias("words"),
        )).alias("lines"),
    )
    windows = F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW), lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    c = b.withColumn("windows", windows).drop("hashes")
    ordered = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = c.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), ordered)).drop("windows")
    return d.withColumn("n_repeat_words", F.when(F.col("sorted").isNotNull(), _covered(F.col("sorted"))).otherwise(F.lit(0).cast("long"))).drop("sorted")


def frequent_lines(stats: DataFrame, percent: int = LINE_PERCENT, docs: tuple[int, int] = LINE_DOCS) -> DataFrame:
    """(host, h) of the lines on more documents of the host than the limit. A document is a row, so copies count."""
    hosts = stats.groupBy("host").agg(F.count("*").alias("total"))
    seen = stats.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    counts = seen.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > docs[0])
    share = 100 * F.col("n") > percent * F.col("total")
    return counts.join(hosts, "host").where(share | (F.col("n") > docs[1])).select("host", "h")


def apply_rules(docs: DataFrame, percent: int = LINE_PERCENT, limits: tuple[int, int] = LINE_DOCS, left: float = LEFT_SHARE, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words, kept.

    A null text has no words, a null host is ''. Ids may be null or repeat; other columns aren't read. A line that comes
    several times in a document counts once for frequency and goes each time.
    """
    stats = materialize(text_statistics(docs, id_col, text_col, host_col).withColumn("row", F.monotonically_increasing_id()), "statistics")
    lines = stats.select("row", "host", F.inline("lines"))
    frequent = materialize(frequent_lines(stats, percent, limits), "frequent")  # so that the join can split a line's many rows
    removed = lines.join(frequent, ["host", "h"]).groupBy("row").agg(F.sum("words").alias("n_removed_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEAT_SHARE) * F.col("n_words"))
    out = stats.drop("lines", "host").join(removed, "row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    depleted = 100 * (F.col("n_words") - F.col("n_removed_words")) < round(100 * left) * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~depleted).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept")


def query(spark, sf_dir: str) -> DataFrame:
    return apply_rules(documents(spark, sf_dir))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS rows FROM d),
win AS (SELECT r, i, list_slice(words, i, i + {WINDOW - 1}) AS k FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(*) AS n_repeat_words FROM (SELECT DISTINCT r, i + o AS p FROM rep, range({WINDOW}) t(o)) GROUP BY r),
ln AS (SELECT r, host, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line, len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS n
  FROM (SELECT r, host, unnest(rows) AS x FROM w)),
ho AS (SELECT host, count(*) AS total FROM d GROUP BY host),
fr AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT r) AS n FROM ln GROUP BY host, line) JOIN ho USING (host) WHERE n > {LINE_DOCS[0]} AND (100 * n > {LINE_PERCENT} * total OR n > {LINE_DOCS[1]})),
rm AS (SELECT r, sum(n) AS removed FROM ln SEMI JOIN fr USING (host, line) GROUP BY r),
s AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(rows) - len(list_distinct(rows)) AS BIGINT) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed_words FROM w LEFT JOIN cov USING (r) LEFT JOIN rm USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {int(100 * MAX_REPEAT_SHARE)} * n_words AS base_failed FROM s)
SELECT *, NOT base_failed AND 100 * (n_words - n_removed_words) >= {round(100 * LEFT_SHARE)} * n_words AS kept FROM b
"""

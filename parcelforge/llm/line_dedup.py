"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A text's lines that hold a word are hashed (128 bits).  The window of a line holds the least number of lines from it on
that have ``min_words`` words together; the line of the smallest hash in it is a fingerprint.  A repeated run of
``min_words`` words holds whole windows, and equal windows choose equal lines: so each such run has a fingerprint that
is met again.  Fingerprints met once are left behind.  From the others matches are extended both ways, to the windows
that chose them and to the windows' counterparts (the least number of lines up to a line), each as a hash of all its
lines.  These are joined with their first occurrences (by doc_id, then text hash, then position).

A line is deleted where it lies in a run of lines that has ``min_words`` words or more and stood together before: in an
earlier document, or earlier in the same one without overlapping.  Each line of such a run lies in a window of the run
or in the counterpart of one, so that the runs found are all there are, and lines that stood apart make no run.

Only hashes travel: a hot line meets one row, and both sides of each join are stored tables that Spark can split.  The
text is joined once with the lines to delete.

Defined results: lines without a word are kept and do not end a run; a null or empty text stays as it is; rows of one
doc_id and text are one document and lose the same lines; rows without doc_id are kept as they are and count as no
occurrence; extra columns pass through whatever their names (``doc_id``, ``text`` and ``n_chars`` are read).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.llm.common import discard, materialize, quoted, unused

#: White space within a line: space and 0x09-0x0D without the line feed.
_SPACE = r"[ \t\x0b\f\r]+"


def words(line) -> Column:
    return F.size(F.array_remove(F.split(line, _SPACE), ""))


def _lines(text) -> Column:
    """Lines with a word: (n: words, h, g: hashes)."""
    every = F.transform(F.split(text, "\n"), lambda x: F.struct(words(x).alias("n"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g")))
    return F.filter(every, lambda x: x["n"] > 0)


def _reach(counts, min_words: int) -> Column:
    """How many of these lines, from the first on, have ``min_words`` words; 0 if they never do."""
    start = F.struct(F.lit(0).alias("w"), F.lit(0).alias("m"))
    grown = lambda a, n: F.when(a["w"] >= min_words, a).otherwise(F.struct((a["w"] + n).alias("w"), (a["m"] + 1).alias("m")))
    return F.aggregate(counts, start, grown, lambda a: F.when(a["w"] >= min_words, a["m"]).otherwise(0))


def fingerprints(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc, th, h, g, runs): a fingerprint of a document, and the runs of lines (i to e, with the hashes kh and kg of
    all their lines) that it stands for."""
    own = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("th"), _lines(F.col("text")).alias("ls"))
    # A line has a word at least, so that no window is longer than min_words lines.
    own = own.select("doc", "th", "ls", F.transform("ls", lambda x: x["n"]).alias("ns"), F.transform("ls", lambda x: x["h"]).alias("hs"), F.transform("ls", lambda x: x["g"]).alias("gs"))
    own = own.where((F.size("ls") > 0) & (F.aggregate("ns", F.lit(0), lambda a, n: a + n) >= min_words))
    # Of each line: the lines of its window, and of the window's counterpart that ends with it.
    own = own.withColumn("ahead", F.transform("ns", lambda n, i: F.when(n >= min_words, 1).otherwise(_reach(F.slice("ns", i + 1, min_words), min_words))))
    behind = lambda i: F.reverse(F.slice("ns", F.greatest(i - (min_words - 2), F.lit(1)), F.least(i + 1, F.lit(min_words))))
    own = own.withColumn("back", F.transform("ns", lambda n, i: F.when(n >= min_words, 1).otherwise(_reach(behind(i), min_words))))
    # Of each window the place of the smallest hash; of equal ones the last.
    least = lambda i, m: -F.array_min(F.transform(F.slice("hs", i + 1, m), lambda h, k: F.struct(h, (-(i + k)).alias("k"))))["k"]
    own = own.withColumn("chosen", F.transform("ahead", lambda m, i: F.when(m == 1, i).when(m > 1, least(i, m))))
    key = lambda c, i, m: F.when(m == 1, F.xxhash64(F.lit(1), F.get(c, i))).otherwise(F.xxhash64(m, F.slice(c, i + 1, m)))
    run = lambda f, i, m: F.struct(f.alias("f"), i.alias("i"), (i + m - 1).alias("e"), key("hs", i, m).alias("kh"), key("gs", i, m).alias("kg"))
    forward = F.transform("ahead", lambda m, i: F.when(m > 0, run(F.get("chosen", i), i, m)))
    # A counterpart of m lines begins with the window of its first line, and is no window if that is shorter.
    first = lambda e, m: e - m + 1
    backward = F.transform("back", lambda m, e: F.when((m > 0) & (F.get("ahead", first(e, m)) < m), run(F.get("chosen", first(e, m)), first(e, m), m)))
    # In order of their fingerprints, so that those of one are a slice.
    runs = own.select("doc", "th", "hs", "gs", F.array_sort(F.array_compact(F.concat(forward, backward))).alias("runs"))
    begins = F.transform("runs", lambda r, k: F.when((k == 0) | (r["f"] != F.get("runs", k - 1)["f"]), k))
    runs = runs.withColumn("starts", F.array_compact(begins))
    until = lambda j: F.coalesce(F.get("starts", j + 1), F.size("runs"))
    slices = F.transform("starts", lambda k, j: F.struct(F.get("runs", k)["f"].alias("f"), F.slice("runs", k + 1, until(j) - k).alias("some")))
    marked = runs.select("doc", "th", "hs", "gs", F.explode(slices).alias("x"))
    bare = F.transform("x.some", lambda r: F.struct(r["i"], r["e"], r["kh"], r["kg"]))
    return marked.select("doc", "th", F.get("hs", F.col("x.f")).alias("h"), F.get("gs", F.col("x.f")).alias("g"), bare.alias("runs"))


def repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc, th, gone: which lines with a word go, in order) of the documents that lose lines."""
    marks = materialize(fingerprints(docs, min_words), "line-marks")
    met = materialize(marks.groupBy("h", "g").agg(F.count("*").alias("met")).where("met > 1").select("h", "g"), "line-met", True)
    again = marks.join(met.hint("merge"), ["h", "g"]).select("doc", "th", F.explode("runs").alias("r"))
    runs = materialize(again.select("doc", "th", "r.*"), "line-runs")
    discard(marks)
    discard(met)
    first = runs.groupBy("kh", "kg").agg(F.min(F.struct("doc", "th", "i")).alias("first"), F.count("*").alias("met")).where("met > 1")
    first = materialize(first.select("kh", "kg", *(F.col("first")[c].alias(f"first_{c}") for c in ("doc", "th", "i"))), "line-first", True)
    before = F.when((F.col("doc") == F.col("first_doc")) & (F.col("th") == F.col("first_th")), F.col("first_i") + F.col("e") - F.col("i") < F.col("i")).otherwise(F.struct("doc", "th") > F.struct("first_doc", "first_th"))
    later = runs.join(first.hint("merge"), ["kh", "kg"]).where(before).select("doc", "th", "i", "e")
    # Lines that an earlier run of the document has not yet met.  A window holds one document.
    upto = F.max("e").over(Window.partitionBy("doc", "th").orderBy("i", "e").rowsBetween(Window.unboundedPreceding, -1))
    fresh = later.withColumn("from", F.greatest("i", F.coalesce(upto + 1, F.lit(0)))).where(F.col("from") <= F.col("e"))
    lost = fresh.groupBy("doc", "th").agg(F.sort_array(F.flatten(F.collect_list(F.sequence("from", "e")))).alias("gone"))
    lost = materialize(lost, "line-gone", True)
    discard(runs)
    discard(first)
    return lost


def dedup(docs: DataFrame, min_words: int = 50, gone: str = "gone", gone_words: str = "gone_words") -> DataFrame:
    """``docs`` with the cleaned ``text``, and the places among all lines of those deleted and how many words they had
    (null where nothing was deleted), under the names given."""
    doc, th, which, made, filled = unused(docs, "pf_doc", "pf_th", "pf_which", "pf_made", "pf_filled")
    lost = repeats(docs, min_words).select(F.col("doc").alias(doc), F.col("th").alias(th), F.col("gone").alias(which))
    # Sorted at every size: whether the lines are few enough to be broadcast is no matter of this plan.
    both = docs.join(lost.hint("merge"), (F.col("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(th)), "left")
    # A text's lines, and the places and words of those with a word.  An array of one is exploded, as Spark moves no
    # expression through that: these are made once for a row, and not once for each line that asks for them.
    parts = F.split("text", "\n")
    own = F.filter(F.transform(parts, lambda x, k: F.struct(k.alias("k"), words(x).alias("n"))), lambda x: x["n"] > 0)
    once = F.when(F.col(which).isNotNull(), F.struct(parts.alias("lines"), own.alias("own")))
    both = both.select("*", F.explode_outer(F.array(once)).alias(made))
    split = F.col(f"{made}.lines")
    both = both.withColumn(filled, F.transform(which, lambda k: F.get(F.col(f"{made}.own"), k)))
    both = both.withColumn(gone, F.transform(filled, lambda x: x["k"]))
    both = both.withColumn(gone_words, F.aggregate(filled, F.lit(0).cast("bigint"), lambda a, x: a + x["n"]))
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    clean = F.array_join(F.transform(stay, lambda k: F.get(split, k)), "\n")
    text = F.when(F.col(gone).isNotNull(), clean).otherwise(F.col("text"))
    return both.select(*(text.alias(c) if c == "text" else quoted(c) for c in docs.columns), gone, gone_words)


def stage(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """The columns of ``docs``; documents of which no word is left, as all of them stand earlier, go.

    ``n_chars``, where it is a column, follows the text.
    """
    gone, gone_words = unused(docs, "pf_gone", "pf_gone_words")
    out = dedup(docs, min_words, gone, gone_words)
    out = out.where(F.col(gone).isNull() | F.col("text").rlike(r"[^ \t\x0b\f\r\n]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*map(quoted, docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup(docs)
    return out.select("doc_id", F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("gone_words", F.lit(0)).cast("bigint").alias("removed_words"), F.coalesce("gone", F.array().cast("array<int>")).alias("removed_lines"), "text")

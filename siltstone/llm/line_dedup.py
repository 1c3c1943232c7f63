"""Line dedup by a log-template tree, in DataFrame and SQL functions only.

The tree has a fixed depth: a line goes to the leaf of its token count and its leading tokens, tokens with a
digit being a variable field. A leaf's template has, at each place, the token that most documents of the leaf
have there, and a variable field where no token recurs. Lines that agree with the template at enough places
are its instances; other lines of a leaf are templates by themselves. A template found in several documents is
dropped wherever it stands after its first place, so that each passage stays once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialize, text_of

DEPTH, LEAST_TOKENS, AGREE, MIN_DOCS = 4, 3, 0.7, 2


def masked(line: Column) -> Column:
    """The line with every token that has a digit as a variable field."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ ]*[0-9][^ ]*", "<*>")).otherwise(line)


def _lines(docs: DataFrame, depth: int, least_tokens: int) -> DataFrame:
    """doc_id, place, form (the masked line), n tokens and leaf of each line that has enough tokens."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    tokens = lines.withColumn("form", masked(F.col("line"))).withColumn("n", F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1).where((F.col("n") >= least_tokens) & (F.trim("line") != ""))
    return tokens.withColumn("leaf", F.xxhash64("n", F.substring_index("form", " ", depth))).drop("line")


def dropped_lines(docs: DataFrame, *, depth: int, least_tokens: int, agree: float, min_docs: int) -> DataFrame:
    """doc_id and places, the array of its lines to drop, for documents that have any; docs has doc_id and text."""
    lines = materialize(_lines(docs, depth, least_tokens).select("doc_id", "place", "leaf", F.xxhash64("form").alias("form")), "lines")
    by_doc = lines.groupBy("leaf", "form", "doc_id").agg(F.min("place").alias("place"))
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "place")
    forms = materialize(by_doc.groupBy("leaf", "form").agg(F.count(F.lit(1)).alias("docs"), F.min(at).alias("first"), F.max(at).alias("last")), "forms")

    # leaves with several forms get a template; one line stands for all of its form
    mixed = forms.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("leaf")
    open_forms = materialize(forms.join(mixed, "leaf"), "open_forms")
    wanted = materialize(open_forms.select(F.col("first.doc_id").alias("doc_id")).distinct(), "wanted")
    again = _lines(docs.join(bounded(wanted), "doc_id", "left_semi"), depth, least_tokens)
    places = open_forms.select("leaf", F.col("form").alias("form_id"), "docs", F.col("first.doc_id").alias("doc_id"), F.col("first.place").alias("place"))
    texts = again.withColumn("form_id", F.xxhash64("form")).join(places, ["leaf", "form_id", "doc_id", "place"]).dropDuplicates(["leaf", "form_id"])
    tokens = materialize(texts.select("leaf", "form_id", "docs", "n", F.posexplode(F.split("form", " ")).alias("at", "token")), "tokens")
    counts = tokens.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("docs"))
    template = counts.groupBy("leaf", "at").agg(F.max(F.struct("docs", "token")).alias("top")).where(F.col("top.docs") >= min_docs).select("leaf", "at", F.col("top.token").alias("token"))
    instances = tokens.join(template, ["leaf", "at", "token"]).groupBy("leaf", F.col("form_id").alias("form")).agg(F.count(F.lit(1)).alias("same"), F.first("n").alias("n")).where(F.col("same") >= F.col("n") * F.lit(agree)).select("leaf", "form", F.lit(True).alias("instance"))

    # a template is a leaf's, or a form by itself; it recurs if its forms stand in several documents
    placed = forms.join(instances, ["leaf", "form"], "left").withColumn("own", F.when(F.col("instance"), F.lit(0)).otherwise(F.col("form")))
    whole = placed.groupBy("leaf", "own").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("docs").alias("most"), F.sum("docs").alias("sum"))
    several = ~F.col("first.doc_id").eqNullSafe(F.col("last.doc_id"))
    recurs = several if min_docs <= 2 else several & (F.col("sum") >= min_docs)
    recurring = materialize(placed.select("leaf", "form", "own").join(whole.where(recurs).select("leaf", "own", "first"), ["leaf", "own"]).select("leaf", "form", "first"), "recurring")
    hit = lines.join(recurring, ["leaf", "form"]).where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("place") == F.col("first.place"))))
    return hit.groupBy("doc_id").agg(F.array_sort(F.collect_set("place")).alias("places"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, least_tokens: int = LEAST_TOKENS, agree: float = AGREE, min_docs: int = MIN_DOCS, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with the text less its recurring lines, and two columns more, named by counts: lines and dropped lines.

    Lines end at line feeds, tokens at blanks. Lines of fewer than least_tokens tokens always stay. The first
    place is the smallest doc_id (null last), then the first line; all rows of one doc_id are one document.
    Null texts stay null with no lines; all other columns pass through, but columns of docs that have
    the names of the two counts are replaced. Repeats inside one document alone are not touched. min_docs above 2
    counts a document once for each form of a template that it holds.
    """
    others = [c for c in docs.columns if c not in counts]
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    drops = dropped_lines(rows, depth=depth, least_tokens=least_tokens, agree=agree, min_docs=min_docs)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(id_col).alias("line_dedup_id"))
    joined = packed.join(drops.withColumnRenamed("doc_id", "dropped_id"), F.col("line_dedup_id").eqNullSafe(F.col("dropped_id")), "left")
    text = F.col("row")[text_col]
    lines = F.split(text, "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("places"), i)), "\n")
    columns = [(F.when(F.col("places").isNull(), text).otherwise(kept) if c == text_col else F.col("row")[c]).alias(c) for c in others]
    return joined.select(*columns, F.coalesce(F.size(lines), F.lit(0)).alias(counts[0]), F.coalesce(F.size("places"), F.lit(0)).alias(counts[1]))

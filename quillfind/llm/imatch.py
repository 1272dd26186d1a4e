"""I-Match fingerprints with randomised lexicon subsets. DataFrame functions only.

 1. Every document's distinct terms are counted over all documents. The lexicon is the band of terms that stand in at
    least LOW of the documents (and in two), and in at most HIGH of them. A document has a bounded number of distinct
    terms on average, so at most average / LOW terms can reach the lower end: the lexicon's size does not grow with the
    number of documents. It is broadcast if it has at most BROADCAST_TERMS entries and joined by a shuffle beyond.
 2. A text's terms in the band, sorted and distinct, are hashed whole and in randomised subsets of the lexicon: SUBSETS
    families, each nested to a quarter, a sixteenth, a 64th and a 256th. A text without such terms is hashed over all
    its distinct terms.
 3. The likeness of two fingerprints is the share of equal hashes among the subsets that are not empty on both sides,
    counted from the smallest subsets up to each size; the best of these shares. It is 1 for equal term sets.

Every document's neighbour (for the edited texts) is found without a global sort: ids are cut at quantiles into at
most 2 * CELLS + 2 cells, an id that very many rows have into a cell of its own, and cells into blocks of equal width
and BLOCK rows on average. A window works within a block, and one row per block carries the last text on to the next
block of its cell, one number per cell to the next cell. An id far from all others changes the blocks of its own cell only.

Defined results: null texts are empty; texts without terms are alike with each other and with nothing else; rows with
equal ids are ordered by a hash of the text, then by the text; a single row is its own neighbour; rows with null ids
follow the smallest id; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import session, stored

LOW, HIGH = 0.002, 0.25
SUBSETS, LEVELS, BLOCK, BROADCAST_TERMS = 12, 4, 512, 1_000_000
#: Quantiles of the ids at which they are cut, and the accuracy of these.
CELLS, ACCURACY = 2048, 20_000
#: What rows are ordered by.
ORDER = ["doc_id", "text hash", "text"]


def terms(text: Column) -> Column:
    """Distinct words: runs of letters and digits, lower-cased."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """Hashes of the terms in the band, and the hash of the empty term, which marks every text."""
    n = docs.count()
    counted = docs.select(F.explode(terms(F.col(text_col))).alias("t")).select(F.xxhash64("t").alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    band = counted.filter(F.col("df").between(max(2, low * n), high * n)).select("h")
    return band.unionByName(docs.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("h")))


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _digest(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.xxhash64(a)).otherwise(F.lit(0).cast("long"))


def subset_hashes(sorted_terms: Column) -> Column:
    """Per family, the hashes of its nested subsets, the largest first; 0 for an empty one."""

    def family(k: Column) -> Column:
        def nest(inside: Column, level: int, done: list[Column]) -> Column:
            if level == LEVELS:
                return F.array(*done)
            kept = F.filter(inside, lambda t: F.shiftrightunsigned(F.xxhash64(t, k), 2 * level).bitwiseAND(F.lit(3)) == 0)
            return _let(kept, lambda x: nest(x, level + 1, [*done, _digest(x)]))

        return nest(sorted_terms, 0, [])

    return F.transform(F.sequence(F.lit(1), F.lit(SUBSETS)), family)


def fingerprint_text(whole: Column, subsets: Column) -> Column:
    """The fingerprint as a string: the whole hash, then the families' hashes (low 32 bits each; `-` if empty)."""
    part = F.transform(F.flatten(subsets), lambda x: F.when(x == 0, F.lit("-")).otherwise(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))))))
    return F.concat_ws(".", F.lower(F.hex(whole)), F.array_join(part, "."))


def likeness(whole_a: Column, a: Column, whole_b: Column, b: Column) -> Column:
    zero = F.lit(0).cast("long")

    def count(test, level: int) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: test(x[level], y[level]).cast("long")), zero, lambda s, x: s + x)

    same = [count(lambda x, y: (x == y) & (x != 0), k) for k in range(LEVELS)]
    some = [count(lambda x, y: (x != 0) | (y != 0), k) for k in range(LEVELS)]
    shares = [F.when(sum(some[k:], zero) > 0, sum(same[k:], zero) / sum(some[k:], zero)).otherwise(0.0) for k in range(LEVELS)]
    return F.when(whole_a == whole_b, 1.0).otherwise(F.greatest(*shares))


def _cell(cuts: list[int]) -> Column:
    """How many cuts are not above the id, by halving; -1 for null ids."""
    if not cuts:
        at = F.lit(0)
    else:
        table, steps = F.array(*map(F.lit, cuts)), [1 << k for k in reversed(range(len(cuts).bit_length()))]
        fits = lambda at, step: (at + step <= len(cuts)) & (F.get(table, at + step - 1) <= F.col("doc_id"))
        at = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(fits(at, step), at + step).otherwise(at))
    return F.when(F.col("doc_id").isNull(), -1).otherwise(at)


def _blocks(docs: DataFrame) -> DataFrame:
    """With the columns `cell` and `block`: blocks are numbered in the order of ids and have BLOCK rows on average."""
    cells = max(1, min(CELLS, docs.count() // BLOCK))
    shares = [k / cells for k in range(1, cells)]
    found = docs.agg(F.percentile_approx("doc_id", shares, ACCURACY).alias("cuts")).first()["cuts"] if shares else None
    # What several quantiles name is an id of very many rows: it becomes a cell.
    found = found or []
    cuts = sorted({*found, *(c + 1 for c, d in zip(found, found[1:]) if c == d and c < (1 << 63) - 1)})
    docs = docs.withColumn("cell", _cell(cuts))
    rows = docs.groupBy("cell").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).orderBy("cell").collect()
    first, table = 0, []
    for r in rows:
        parts = -(-r["n"] // BLOCK)
        table.append((r["cell"], first, parts, r["low"], r["high"]))
        first += parts
    at = {r[0]: k for k, r in enumerate(table)}
    place = F.get(F.array(*[F.lit(at.get(c, 0)) for c in range(-1, len(cuts) + 1)]), F.col("cell") + 1)
    of = lambda k, empty=0: F.get(F.array(*[F.lit(empty if r[k] is None else r[k]).cast("long") for r in table] or [F.lit(0).cast("long")]), place)
    low, high = of(3).cast("double"), of(4).cast("double")
    by_id = (F.col("doc_id").cast("double") - low) / (high - low + 1)
    by_text = F.col("text hash").cast("double") / F.lit(2.0**64) + 0.5
    share = F.when(F.col("doc_id").isNull() | (of(3) == of(4)), by_text).otherwise(by_id)
    block = of(1) + F.least(F.greatest(F.floor(share * of(2)), F.lit(0)), of(2) - 1)
    # Never null: else a filter on one of its uses would keep Spark from sharing one shuffle among all of them.
    return docs.withColumn("block", F.coalesce(block.cast("long"), F.lit(-1).cast("long")))


def _neighbours(blocked: DataFrame, value: str, order: list[str], out: str) -> DataFrame:
    """With the column `out`: `value` of the next row in descending order (the greatest smaller one; for the smallest,
    the greatest of all). `blocked` must be partitioned by `block` already for this to shuffle nothing large."""
    last = blocked.groupBy("cell", "block").agg(F.max_by(F.struct(value), F.struct(*order)).alias("v"))
    blocks = blocked.select("cell", "block").distinct()
    # At most 2 * CELLS + 2 rows, however many documents there are.
    cells = blocks.groupBy("cell").agg(F.max("block").alias("last"))
    every = F.max("last").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    cells = cells.select("cell", F.coalesce(F.lag("last").over(Window.orderBy("cell")), every).alias("before cell"))
    before = F.lag("block").over(Window.partitionBy("cell").orderBy("block"))
    order_of_blocks = blocks.withColumn("p", before).join(F.broadcast(cells), "cell").select(F.coalesce("p", "before cell").alias("block"), F.col("block").alias("to"))
    edge = last.drop("cell").join(order_of_blocks, "block").select(F.col("to").alias("block"), F.col("v").alias("edge"))
    inside = blocked.withColumn("before", F.lag(F.struct(value)).over(Window.partitionBy("block").orderBy(*order)))
    joined = inside.join(edge.hint("merge"), "block", "left")
    return joined.withColumn(out, F.coalesce("before", "edge")[value]).drop("before", "edge")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, whole, subsets, edited_whole, edited_subsets, next_whole, next_subsets) of every
    row; the edited text has its last third replaced by the beginning of the next document."""
    session(docs)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = stored(lexicon(docs, low=low, high=high), "lexicon")
    few = words.count() <= BROADCAST_TERMS
    rows = _neighbours(_blocks(docs.withColumn("text hash", F.xxhash64("text"))).repartition("block"), "text", ORDER, "next_text")
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("block").orderBy(*ORDER))).withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.coalesce(F.substring("next_text", F.lit(1), third), F.lit("")))
    rows = rows.select("cell", "block", "rn", "doc_id", "n_chars", "text", edited.alias("edited"))
    both = rows.select("block", "rn", F.struct("cell", "doc_id").alias("own"), "n_chars", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("s")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("s")))).alias("x"))
    both = both.select("block", "rn", "x.kind", "own.cell", "own.doc_id", "n_chars", terms(F.col("x.s")).alias("terms"), F.when(F.col("x.kind") == 1, F.sha2("x.s", 256)).alias("sha"))
    both = both.withColumn("all_terms", F.xxhash64(F.array_sort("terms")))
    # One row per term; what belongs to the text stands in the row of the empty term only.
    mark = F.xxhash64(F.lit(""))
    each = both.select("block", "rn", "kind", F.struct("cell", "doc_id", "n_chars", "sha", "all_terms").alias("row"), F.explode(F.concat(F.array(F.lit("")), "terms")).alias("t"))
    each = each.select("block", "rn", "kind", F.xxhash64("t").alias("h"), F.when(F.col("t") == "", F.col("row")).alias("row"))
    hits = each.join(F.broadcast(words) if few else words, "h")
    grouped = hits.groupBy("block", "rn", "kind").agg(F.collect_list("h").alias("hs"), F.first("row", ignorenulls=True).alias("row"))
    own = F.array_sort(F.array_remove("hs", mark))
    made = grouped.select("block", "rn", "kind", "row.*", own.alias("band")).withColumn("whole", F.when(F.size("band") > 0, F.xxhash64("band")).otherwise(F.col("all_terms"))).withColumn("subsets", subset_hashes(F.col("band")))
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c))).alias(f"{c}{kind}")
    wide = made.groupBy("block", "rn").agg(F.max("cell").alias("cell"), F.max("doc_id").alias("doc_id"), F.max("n_chars").alias("n_chars"), F.max("sha").alias("edited_sha256"), *[pick(k, c) for k in (0, 1) for c in ("whole", "subsets")])
    prints = stored(wide, "fingerprints").withColumn("own", F.struct("whole0", "subsets0"))
    out = _neighbours(prints, "own", ["doc_id", "rn"], "next_own")
    return out.select("doc_id", "n_chars", "edited_sha256", F.col("whole0").alias("whole"), F.col("subsets0").alias("subsets"), F.col("whole1").alias("edited_whole"), F.col("subsets1").alias("edited_subsets"), F.col("next_own.whole0").alias("next_whole"), F.col("next_own.subsets0").alias("next_subsets"))


def compared(prints: DataFrame) -> DataFrame:
    """The fingerprints as strings, with their likeness to the edited text's and to the next document's."""
    return prints.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint_text(F.col("whole"), F.col("subsets")).alias("fingerprint"),
        fingerprint_text(F.col("edited_whole"), F.col("edited_subsets")).alias("edited_fingerprint"),
        likeness(F.col("whole"), F.col("subsets"), F.col("edited_whole"), F.col("edited_subsets")).alias("near_edited"),
        F.coalesce(likeness(F.col("whole"), F.col("subsets"), F.col("next_whole"), F.col("next_subsets")), F.lit(0.0)).alias("near_next"),
    )

"""How the sources of a language differ from each other, and by which terms they differ from their language.

Texts are counted once, term by term; all that follows works on counts.  The terms in which a source exceeds its
language are found by upper bounds: a source's terms of about one count form a bucket, whose largest
probability and the least probability that the language gives to any of its terms bound what a term of it can
reach.  Buckets are opened best bound first until those left lie strictly below the last value wanted.  Pairs of
sources are summed from postings: what a term adds that only one of them has depends on that one's
probability alone, so only terms that both have are met.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_column, materialize, small_batches

#: Probabilities are whole numbers of this many parts.
PARTS = 1_000_000_000
#: Terms are runs of letters and of characters beyond ASCII; upper-case ASCII letters become lower-case ones.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Entries of a task's counts from which they are passed on, and bytes of text cut into terms at a time.
HELD, SLICE = 400_000, 1 << 20
#: Sources of a block and postings of a slice, on average, that one task pairs.
BLOCK, SLICE_ROWS = 256, 50_000


def terms(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time; a term is never cut."""
    text, at = data.translate(_FOLD), 0
    while len(text) - at > SLICE:
        end = text.find(b" ", at + SLICE)
        if end < 0:
            break
        yield text[at:end].split()
        at = end
    yield text[at:].split()


def count_terms(docs: DataFrame, text_col: str, lang_col: str, source_col: str, most: int = HELD) -> DataFrame:
    """(lang, source, term, n, docs): how often a term stands in a group's texts, and in how many of them; the
    empty term stands for the group itself.  Tasks add up what they read before it is shuffled."""
    small_batches(docs.sparkSession)
    names = ["lang", "source", "term", "n", "docs"]

    def emit(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs_) in held.items():
            keys = list(docs_)
            for a in range(0, len(keys), 50_000):
                some = keys[a : a + 50_000]
                cols = [pa.array([lang] * len(some), pa.binary()).cast(pa.string()), pa.array([source] * len(some), pa.binary()).cast(pa.string()), pa.array(some, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([n[k] for k in some], pa.int64()), pa.array([docs_[k] for k in some], pa.int64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, data in zip(*(byte_column(batch, c) for c in ("lang", "source", "text")), strict=True):
                n, docs_ = held.setdefault((lang or b"", source or b""), (Counter(), Counter()))
                before, seen = len(docs_), {b""}
                for some in terms(data or b""):
                    n.update(some)
                    seen.update(some)
                docs_.update(seen)
                size += len(docs_) - before
                if size > most:
                    yield from emit(held)
                    held, size = {}, 0
        yield from emit(held)

    rows = docs.select(*[F.col(c).cast("string").alias(k) for k, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])
    part = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: str, total: str, kept: str) -> Column:
    """1 + floor(PARTS (n + 2) / (total + 2 kept)), exactly, whatever the counts."""
    return F.expr(f"1 + (CAST({PARTS} AS DECIMAL(10, 0)) * CAST({n} + 2 AS DECIMAL(19, 0))) DIV CAST({total} + 2 * {kept} AS DECIMAL(20, 0))")


def _gap(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) DIV ({p} + {q})"


def _prepare(docs: DataFrame, text_col: str, lang_col: str, source_col: str, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """(postings, groups): (lang, source, term, n, total) of the kept terms, total being the language's count; and
    (lang, source, number, own, kept, size, lang_size, zero), the group's number in its language, how many kept
    terms it has and the language keeps, their counts, and the probability of a term that it lacks."""
    counts = count_terms(docs, text_col, lang_col, source_col)
    mine = Window.partitionBy("lang", "term")
    seen = counts.select("lang", "source", "term", "n", F.sum("docs").over(mine).alias("df"), F.sum("n").over(mine).alias("total"), (F.row_number().over(mine.orderBy("source")) == 1).alias("first"))
    rows = materialize(seen.where((F.col("df") >= min_docs) | (F.col("term") == "")), "terms")
    postings = rows.where("term <> ''").drop("df")
    langs = postings.groupBy("lang").agg(F.sum("n").alias("lang_size"), F.count_if("first").alias("kept"), F.count("*").alias("rows"))
    sizes = postings.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("own"))
    groups = rows.where("term = ''").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    zero = F.when(F.col("kept") > 0, probability("0L", "size", "kept")).otherwise(F.lit(0))
    return postings, materialize(groups.select("*", number.alias("number"), zero.alias("zero")), "groups")


def exceeding(postings: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value, rank) of the ``top`` terms in which a group exceeds its language most."""
    known = groups.select("lang", "source", "size", "kept", "lang_size")
    scored = postings.join(known, ["lang", "source"]).select("lang", "source", "term", "n", probability("n", "size", "kept").alias("p"), probability("total", "lang_size", "kept").alias("q")).where("p > q")
    # a bucket for each small count, for larger ones eight while they double; its bounds hold however it is cut
    scored = scored.withColumn("bucket", F.floor(F.log2("n") * 8).cast("int"))
    group = Window.partitionBy("lang", "source")
    buckets = scored.groupBy("lang", "source", "bucket").agg(F.count("*").alias("m"), F.max("p").alias("p"), F.min("q").alias("q"))
    best_first = group.orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("lang", "source", "bucket", "m", F.expr(_gap("p", "q")).alias("bound"))
    buckets = materialize(buckets.withColumn("before", F.coalesce(F.sum("m").over(best_first), F.lit(0))), "buckets")
    order = group.orderBy(F.desc("value"), "item")

    def best(opened: DataFrame) -> DataFrame:
        rows = scored.join(opened.select("lang", "source", "bucket"), ["lang", "source", "bucket"], "left_semi")
        rows = rows.select("lang", "source", F.col("term").alias("item"), F.expr(_gap("p", "q")).alias("value"))
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    # first the best buckets that hold enough terms, then all whose bound reaches the last value these give;
    # those left lie strictly below it, and so below the last value of all
    first = best(buckets.where(F.col("before") < top))
    last = first.groupBy("lang", "source").agg(F.min("value").alias("last"))
    return best(buckets.join(last, ["lang", "source"]).where("bound >= last"))


def _add_up(block: pa.Table, width: int) -> pa.Table:
    """Of a slice of terms and two blocks of ``width`` sources: for each two sources what the terms that only one has, or
    both have, add to their difference; terms that both lack are left out.  Rows without a term give the
    probability of a lacking term."""
    lang, one = block.column("lang")[0], block.column("one")[0].as_py()
    number, p = (block.column(c).to_numpy().astype(np.int64) for c in ("number", "p"))
    is_term = block.column("is_term").to_numpy(zero_copy_only=False)
    names, place = np.unique(number[~is_term], return_index=True)
    zero = p[~is_term][place]
    side = (names // width == one).astype(np.int64)  # sources of one block pair with those of the other
    same = bool(side.all())
    at, p = np.searchsorted(names, number[is_term]), p[is_term]
    code = block.column("term").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)[is_term]
    gap = lambda x, y: (x - y) ** 2 // (x + y)
    total = np.zeros((len(names), len(names)), np.int64)
    if len(at):
        # each count of a source against all others, as if they lacked the term
        pair, m = np.unique(at << 32 | p, return_counts=True)
        for a in range(0, len(m), 4096):
            s, x, k = pair[a : a + 4096] >> 32, pair[a : a + 4096] & 0xFFFFFFFF, m[a : a + 4096]
            np.add.at(total, s, gap(x[:, None], zero[None, :]) * k[:, None])
        total += total.T.copy()
        # terms that both have: the truth in place of the two guesses
        order = np.lexsort((at, code))
        at, p, code = at[order], p[order], code[order]
        for d in range(1, len(names)):
            met = np.nonzero(code[:-d] == code[d:])[0] if d < len(code) else []
            if not len(met):
                break
            i, j, x, y = at[met], at[met + d], p[met], p[met + d]
            np.add.at(total, (i, j), gap(x, y) - gap(x, zero[j]) - gap(zero[i], y) + gap(zero[i], zero[j]))
    i, j = np.triu_indices(len(names), 1)
    if not same:
        keep = side[i] != side[j]
        i, j = i[keep], j[keep]
    return pa.table({"lang": pa.array([lang.as_py()] * len(i), pa.string()), "i": pa.array(names[i], pa.int32()), "j": pa.array(names[j], pa.int32()), "value": pa.array(total[i, j], pa.int64())})


def pairs(postings: DataFrame, groups: DataFrame, width: int = BLOCK, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(lang, source, item, value, rank): every other source of a source's language by their difference.

    Postings are dealt by language, blocks of ``width`` sources and slices of terms, so a task holds about
    ``slice_rows`` of them however frequent a term or a language is.
    """
    shape = groups.select("*", F.floor(F.col("number") / width).alias("block"), F.greatest(F.ceil(F.col("rows") / slice_rows), F.lit(1)).alias("slices"))
    shape = shape.withColumn("blocks", F.floor((F.max("number").over(Window.partitionBy("lang"))) / width) + 1)
    rows = postings.join(shape, ["lang", "source"]).select("lang", "number", "block", "blocks", F.pmod(F.xxhash64("term"), "slices").alias("slice"), "term", probability("n", "size", "kept").alias("p"), F.lit(True).alias("is_term"))
    lacking = shape.select("lang", "number", "block", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), F.lit("").alias("term"), F.col("zero").alias("p"), F.lit(False).alias("is_term"))
    dealt = rows.unionByName(lacking).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("lang", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "slice", "number", "term", "p", "is_term")
    part = dealt.groupBy("lang", "one", "two", "slice").applyInArrow(lambda t: _add_up(t, width), "lang string, i int, j int, value long")
    summed = part.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    end = lambda k: groups.select("lang", F.col("number").alias(k), F.col("source").alias(f"source_{k}"), F.col("own").alias(f"own_{k}"), F.col("zero").alias(f"zero_{k}"), *(["kept"] if k == "i" else []))
    named = summed.join(end("i"), ["lang", "i"]).join(end("j"), ["lang", "j"])
    both_lack = F.when(F.col("kept") > 0, F.expr(f"(kept - own_i - own_j) * ({_gap('zero_i', 'zero_j')})")).otherwise(F.lit(0))
    named = named.select("lang", "source_i", "source_j", (F.col("value") + both_lack).alias("value"))
    ways = [named.select("lang", F.col(f"source_{a}").alias("source"), F.col(f"source_{b}").alias("item"), "value") for a, b in ("ij", "ji")]
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return ways[0].unionByName(ways[1]).withColumn("rank", rank)


def audit_sources(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) for every language and source that occur together.

    A language keeps the terms of ``min_docs`` of its documents or more.  ``part`` 'pair': every other source
    of the language by how far the two sources' probabilities of the kept terms lie apart; 'term': the
    ``top`` terms that the group has and gives a larger probability than its language.  Ranks go by value,
    then by item in the order of its UTF-8 bytes.  All arithmetic is on whole numbers.

    Null texts, languages and sources count as ''.  Repeated rows count each.  A group without terms is in the
    pairs; where a language keeps no term all pairs have the value 0.  Further columns aren't looked at, and an
    empty table gives an empty result.
    """
    postings, groups = _prepare(docs, text_col, lang_col, source_col, min_docs)
    out = [pairs(postings, groups).withColumn("part", F.lit("pair")), exceeding(postings, groups, top).withColumn("part", F.lit("term"))]
    return out[0].unionByName(out[1]).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))

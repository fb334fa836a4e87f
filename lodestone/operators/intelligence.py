"""Semantic search, communities, links between documents and code, generated docs."""

from __future__ import annotations

import hashlib
import math
from abc import ABC, abstractmethod

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bigram_column, bigram_similarity_column, fuzzy_score_column
from ..functions.vector import cosine
from ..plans.graph import SYMBOLS, Graph, settle
from .structure import ranked


class Provider(ABC):
    """A model behind text operators."""

    @abstractmethod
    def embed(self, texts: list[str]) -> list[list[float]]: ...

    @abstractmethod
    def complete(self, prompt: str) -> str: ...


class HashingProvider(Provider):
    """Works without a network: words hashed with signs into a vector of length one; echoes prompts."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.size
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.size] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    def complete(self, prompt: str) -> str:
        return prompt.strip().splitlines()[-1] if prompt.strip() else ""


def index_text() -> Column:
    summary = F.coalesce("docstring", "description")
    return F.when(F.coalesce(summary, F.lit("")) != "", F.concat(F.lit("["), "label", F.lit("] "), "name", F.lit(": "), summary))


def embedding_index(g: Graph, provider: Provider, limit: int | None = 1000) -> DataFrame:
    """(id, label, name, file_path, text, embedding) of nodes that have a summary."""
    rows = g.nodes.select("id", "label", "name", "file_path", index_text().alias("text")).where("text IS NOT NULL")
    rows = rows.orderBy("id").limit(limit) if limit else rows

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(provider.embed(texts.tolist()))

    return rows.withColumn("embedding", embed("text"))


def top_k(vectors: DataFrame, query: list[float] | DataFrame, k: int = 10, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(id, score) of the k vectors nearest by cosine.  A query given as a one-row DataFrame is joined."""
    if isinstance(query, DataFrame):
        q = query.limit(1).select(F.col(query.columns[0]).alias("__q"), F.lit(1).alias("__k"))
        rows = vectors.withColumn("__k", F.lit(1)).join(F.broadcast(q), "__k")
        score = cosine(F.col(vector_col), F.col("__q"))
    else:
        rows, score = vectors, cosine(F.col(vector_col), F.array(*[F.lit(float(x)) for x in query]))
    return rows.select(id_col, score.alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def propagate_labels(nodes: DataFrame, edges: DataFrame, rounds: int = 3) -> DataFrame:
    """(id, community) after ``rounds`` synchronous rounds: every node takes the commonest label among its
    neighbours and itself, the least of equals.  The distributed form; its own label's vote keeps pairs
    from swapping for ever.  Joins sort and merge: ids packed in a file look small enough to broadcast
    when they are not."""
    label = nodes.select("id", F.col("id").alias("community"))
    both = edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    for i in range(rounds):
        label = settle(label, "labels") if i else label  # used twice
        votes = both.join(label.withColumnRenamed("id", "b").hint("merge"), "b").select(F.col("a").alias("id"), "community").unionByName(label)
        count = votes.groupBy("id", "community").agg(F.count("*").alias("n"))
        label = count.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("m")).select("id", "m.community")
    return label


def _levels(near: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, level): a node's level is one more than the largest of its lower-numbered neighbours'.  Nodes of a
    level have no edge between them, and whoever a node waits for stands on a lower one."""
    level = settle(nodes.select("id", F.lit(0).alias("level"), F.lit(True).alias("new")))
    up = near.where("b < a")
    while True:
        sent = level.where("new").select(F.col("id").alias("b"), "level").join(up, "b").groupBy("a").agg((F.max("level") + 1).alias("sent"))
        higher = F.coalesce(F.col("sent") > F.col("level"), F.lit(False))
        level = settle(level.join(sent.withColumnRenamed("a", "id"), "id", "left").select("id", F.greatest("level", F.coalesce("sent", F.lit(0))).alias("level"), higher.alias("new")))
        if level.where("new").isEmpty():
            return level.select("id", "level")


def propagate_labels_in_place(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, community) as if one node after the other, in id order, took the commonest label among its
    neighbours, the least of equals, each seeing its predecessors' new labels; until a round moves nothing.

    A node may move as soon as its lower-numbered neighbours have, so a round goes level by level of that
    order, each level's nodes at once: joins of the level's edges with the labels as they stand.  Parallel
    edges vote as often as they are; a node without neighbours keeps its id.
    """
    ids = nodes.select("id").distinct()
    own = edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    own = own.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    near = settle(own.select("a", "b").unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a", "b").agg(F.count("*").alias("votes")))
    level = settle(_levels(near, ids))
    levels = level.agg(F.max("level")).first()[0]
    placed = settle(near.join(level.withColumnRenamed("id", "a"), "a"))
    label = ids.select("id", F.col("id").alias("community"))
    for _ in range(rounds if levels is not None else 0):
        before = label
        for k in range(levels + 1):
            count = placed.where(F.col("level") == k).join(label.withColumnRenamed("id", "b"), "b").groupBy("a", "community").agg(F.sum("votes").alias("n"))
            best = count.groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("n"), "community"))["community"].alias("to")).withColumnRenamed("a", "id")
            label = label.join(best, "id", "left").select("id", F.coalesce("to", "community").alias("community"))
            if k % 3 == 2:
                label = settle(label)
        label = settle(label)
        if label.join(before.withColumnRenamed("community", "old"), "id").where("community <> old").isEmpty():
            break
    return label


def community_stats(labels: DataFrame, edges: DataFrame, min_size: int = 2) -> DataFrame:
    """(community, size, density): density is internal edges, repeats counted, over possible pairs.  The labels
    are used three times, and worked out and settled once."""
    labels = settle(labels.select("id", "community"), "labels")
    size = labels.groupBy("community").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    a = labels.select(F.col("id").alias("src"), "community")
    b = labels.select(F.col("id").alias("dst"), F.col("community").alias("other"))
    inside = edges.where("src <> dst").join(a.hint("merge"), "src").join(b.hint("merge"), "dst").where("community = other").groupBy("community").agg(F.count("*").alias("m"))
    pairs = F.col("size") * (F.col("size") - 1) / 2
    return size.join(inside, "community", "left").select("community", "size", F.round(F.coalesce("m", F.lit(0)) / pairs, 4).alias("density")).orderBy(F.desc("size"), "community")


def store_communities(g: Graph, labels: DataFrame) -> Graph:
    return Graph(g.nodes.join(labels.select("id", "community"), "id", "left"), g.edges)


def document_terms(content: Column) -> Column:
    """Distinct headings, bold spans, code spans and the first line of a text, in that order."""
    parts = [
        F.regexp_extract_all(content, F.lit(r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*$"), F.lit(1)),
        F.regexp_extract_all(content, F.lit(r"\*\*([^*\n]+)\*\*"), F.lit(1)),
        F.regexp_extract_all(content, F.lit(r"__([^_\n]+)__"), F.lit(1)),
        F.regexp_extract_all(content, F.lit(r"`([^`\n]+)`"), F.lit(1)),
        F.array(F.regexp_replace(F.element_at(F.split(content, "\n", 2), 1), r"^[#\s]+", "")),
    ]
    return F.array_distinct(F.filter(F.transform(F.concat(*parts), lambda x: F.trim(x)), lambda x: x != ""))


def _by_rarity(names: DataFrame, c: str) -> DataFrame:
    """(name, grams): the bigrams of each distinct name, the rarest of the table first."""
    grams = names.select(F.col(c).alias("name")).distinct().select("name", F.explode(bigram_column(F.col("name"))).alias("g"))
    often = grams.groupBy("g").agg(F.count("*").alias("n"))
    return grams.join(often, "g").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("n", "g"))).alias("s")).select("name", F.col("s.g").alias("grams"))


def like_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b): every pair of a name of ``left`` and one of ``right`` (column name) whose lower-case bigram sets
    can have a Jaccard likeness of ``least``, or one of which may hold the other with a ratio of lengths of
    ``least``.

    Bigrams are ordered by rarity in both tables together.  Sets that are so alike share one of their
    first |x| - ceil(least |x|) + 1 bigrams, and have sizes within that ratio; a name that lies in another
    has its rarest bigram there.  So only rare bigrams are joined on, and no pair is lost.
    """
    ranked_ = _by_rarity(left.select("name").unionByName(right.select("name")), "name")
    rows = ranked_.withColumn("size", F.size("grams")).withColumn("first", F.expr(f"slice(grams, 1, size - cast(ceil({least} * size - 1e-9) AS int) + 1)"))
    sides = [rows.join(x.select("name").distinct(), "name") for x in (left, right)]
    cut = lambda x, grams, name: x.select(F.col("name").alias(name), F.col("size").alias(f"s{name}"), F.explode(grams).alias("g"))
    near = (F.col("sa") >= least * F.col("sb") - 1e-9) & (F.col("sb") >= least * F.col("sa") - 1e-9)
    alike = cut(sides[0], "first", "a").join(cut(sides[1], "first", "b"), "g").where(near).select("a", "b")
    rarest = F.slice("grams", 1, 1)
    within = cut(sides[0], rarest, "a").join(cut(sides[1], "grams", "b"), "g").where((F.length("a") <= F.length("b")) & (F.length("a") >= least * F.length("b") - 1e-9)).select("a", "b")
    holds = cut(sides[0], "grams", "a").join(cut(sides[1], rarest, "b"), "g").where((F.length("b") <= F.length("a")) & (F.length("b") >= least * F.length("a") - 1e-9)).select("a", "b")
    return alike.unionByName(within).unionByName(holds).distinct()


def similar_names(names: DataFrame, least: float = 0.5) -> DataFrame:
    """(a, b, score): pairs of distinct names (a < b) whose bigram likeness is ``least`` or more."""
    n = names.select("name").where("name IS NOT NULL").distinct()
    equal = n.select(F.col("name").alias("a"), F.lower("name").alias("k")).join(n.select(F.col("name").alias("b"), F.lower("name").alias("k")), "k").select("a", "b")  # for names of one character
    pairs = like_pairs(n, n, least).unionByName(equal).where("a < b").distinct()
    return pairs.withColumn("score", bigram_similarity_column(F.col("a"), F.col("b"))).where(F.col("score") >= least)


def suggest_links(docs: DataFrame, code: DataFrame, linked: DataFrame | None = None, minimum: float = 0.5, fuzzy: float = 0.55, limit: int | None = None) -> DataFrame:
    """(source, target, confidence, strategy): which code names a document's terms point to.

    ``docs`` has name and term, ``code`` name.  Equal names (case ignored) count 0.95; else the fuzzy
    score, from ``fuzzy`` on, times 0.8.  Pairs to be scored are those of ``like_pairs`` (names of one
    character are only ever equal or contained, and are paired by their character), so no pair is lost
    and no cross product is made.  Pairs in ``linked`` are left out.
    """
    d = docs.select(F.col("name").alias("source"), "term").where("term <> ''").distinct()
    c = code.select(F.col("name").alias("target")).where("target <> ''").distinct()
    exact = d.join(c, F.lower("term") == F.lower("target")).select("source", "target", F.lit(0.95).alias("confidence"), F.lit("exact").alias("strategy"))
    terms = d.select("term").distinct()
    letters = lambda x: F.array_distinct(F.split(F.lower(x), ""))
    pairs = like_pairs(terms.select(F.col("term").alias("name")), c.select(F.col("target").alias("name")), fuzzy).select(F.col("a").alias("term"), F.col("b").alias("target"))
    one_t = terms.where(F.length("term") == 1).select("term", F.lower("term").alias("g")).join(c.select("target", F.explode(letters("target")).alias("g")), "g").select("term", "target")
    one_c = c.where(F.length("target") == 1).select("target", F.lower("target").alias("g")).join(terms.select("term", F.explode(letters("term")).alias("g")), "g").select("term", "target")
    pairs = pairs.unionByName(one_t).unionByName(one_c).distinct()
    score = fuzzy_score_column(F.col("term"), F.col("target"))
    scored = pairs.withColumn("s", score).where(F.col("s") >= fuzzy)
    like = d.join(scored, "term").select("source", "target", F.round(F.col("s") * 0.8, 3).alias("confidence"), F.lit("fuzzy").alias("strategy"))
    rows = exact.unionByName(like)
    if linked is not None:
        rows = rows.join(linked.select("source", "target").distinct(), ["source", "target"], "left_anti")
    best = rows.groupBy("source", "target").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "strategy")).alias("m"))
    out = best.select("source", "target", (-F.col("m.c")).alias("confidence"), "m.strategy").where(F.col("confidence") >= minimum)
    out = out.orderBy(F.desc("confidence"), "source", "target")
    return out.limit(limit) if limit else out


#: Vectors of a side that meet in one task.
BLOCK = 2048


def semantic_links(docs: DataFrame, code: DataFrame, least: float = 0.7, most_docs: int | None = None, most_code: int | None = None) -> DataFrame:
    """Pairs of a document and a code embedding with cosine of ``least`` or more.  Every pair is compared, in
    blocks of about ``BLOCK`` vectors of either side; ``most_docs`` and ``most_code``, where given, keep the
    first by id."""
    docs = docs.orderBy("id").limit(most_docs) if most_docs is not None else docs
    code = code.orderBy("id").limit(most_code) if most_code is not None else code
    doc_type, code_type = docs.schema["id"].dataType.simpleString(), code.schema["id"].dataType.simpleString()
    n_docs, n_code = (math.ceil(rows.count() / BLOCK) or 1 for rows in (docs, code))
    vector = F.col("embedding").cast("array<double>")
    vector = F.when(~F.exists(vector, lambda x: x.isNull()), vector)  # with a null inside, as a null vector: 0 with all

    def dealt(rows: DataFrame, doc: Column, code: Column, blocks: int, others: int, names: tuple[str, str]) -> DataFrame:
        own, every = F.pmod(F.xxhash64("id"), F.lit(blocks)), F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return rows.select(F.lit(names[0] == "a").alias("is_doc"), doc.alias("doc"), code.alias("code"), vector.alias("v"), own.cast("int").alias(names[0]), every.alias(names[1]))

    sides = dealt(docs, F.col("id"), F.lit(None).cast(code_type), n_docs, n_code, ("a", "b"))
    sides = sides.unionByName(dealt(code, F.lit(None).cast(doc_type), F.col("id"), n_code, n_docs, ("b", "a")))

    def compare(rows: pa.Table) -> pa.Table:
        d, c = rows.filter(rows["is_doc"]), rows.filter(pc.invert(rows["is_doc"]))
        i, j, score = _near(d["v"].combine_chunks(), c["v"].combine_chunks(), least)
        return pa.table([d["doc"].take(pa.array(i)), c["code"].take(pa.array(j)), pa.array(score)], ["doc", "code", "score"])

    return sides.groupBy("a", "b").applyInArrow(compare, f"doc {doc_type}, code {code_type}, score double")


def _sum_of_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row in the order of ``functions.vector.dot``, so with its very result."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += x[:, k] * y[:, k]
    return total


def _near(docs: pa.Array, code: pa.Array, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``docs``, row of ``code``, cosine as by ``functions.vector.cosine``) of every pair of ``least`` or more.
    A matrix product screens; what comes within its error of ``least`` is computed."""
    sizes = [pc.fill_null(pc.list_value_length(x), -1).to_numpy(zero_copy_only=False) for x in (docs, code)]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for size in np.unique(sizes[0]).tolist():
        own = np.nonzero(sizes[0] == size)[0]
        same = np.nonzero(sizes[1] == size)[0] if size >= 0 else np.zeros(0, np.int64)
        if least <= 0:  # pairs that have no cosine count 0
            rest = np.setdiff1d(np.arange(len(code)), same)
            found.append((np.repeat(own, len(rest)), np.tile(rest, len(own)), np.zeros(len(own) * len(rest))))
        if not len(same):
            continue
        with np.errstate(all="ignore"):
            x, y = (v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size) for v, at in ((docs, own), (code, same)))
            xx, yy = np.sqrt(_sum_of_products(x, x)), np.sqrt(_sum_of_products(y, y))
            # very large or small ones aren't screened; as NaN they come through
            left, right = (v / np.where((n == 0) | (n > 1e-100) & (n < 1e100), np.where(n == 0, 1.0, n), np.nan)[:, None] for v, n in ((x, xx), (y, yy)))
            for at in range(0, len(own), 256):
                i, j = np.nonzero(~(left[at : at + 256] @ right.T < least - 1e-9))
                i += at
                norms = xx[i] * yy[j]
                score = np.where(norms <= 0, 0.0, _sum_of_products(x[i], y[j]) / norms)
                keep = ~(score < least)
                found.append((own[i[keep]], same[j[keep]], score[keep]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def accept_links(g: Graph, links: DataFrame, least: float = 0.8) -> Graph:
    """The graph with DOCUMENTS edges for suggestions of ``least`` confidence, ends found by name."""
    n = g.nodes.select("id", "name", "label")
    e = links.where(F.col("confidence") >= least).join(n.where(~F.col("label").isin(*SYMBOLS)).select(F.col("id").alias("src"), F.col("name").alias("source")), "source").join(n.where(F.col("label").isin(*SYMBOLS)).select(F.col("id").alias("dst"), F.col("name").alias("target")), "target")
    return Graph(g.nodes, g.edges.select("src", "dst", "type").unionByName(e.select("src", "dst", F.lit("DOCUMENTS").alias("type"))).distinct())


def token_links(knowledge: DataFrame, code: DataFrame, pattern: str = r"[\s_\-]+", least: int = 4) -> DataFrame:
    """(source, target): some token of at least ``least`` characters of a knowledge name lies in a code
    name, case ignored.

    A token meets the code names that have its rarest run of three characters, by equality, and then lies in
    them or not; a token with a run that no code name has meets none.  Tokens may be shorter than three
    characters only where ``least`` says so; those meet names by their own length.
    """
    tokens = knowledge.select(F.col("name").alias("source"), F.explode(F.array_distinct(F.split(F.lower("name"), pattern))).alias("t")).where(F.length("t") >= least)
    names = code.select(F.col("name").alias("target"), F.lower("name").alias("low")).where("low IS NOT NULL").distinct()
    width = max(1, min(3, least))
    runs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (width - 1)), lambda i: F.substring(c, i, F.lit(width))))
    long = lambda df, c: df.where(F.length(c) >= width)
    held = long(names, "low").select("target", "low", F.explode(runs("low")).alias("g"))
    often = held.groupBy("g").agg(F.count("*").alias("n"))
    words = long(tokens.select("t").distinct(), "t")
    met = words.select("t", F.explode(runs("t")).alias("g")).join(often, "g").groupBy("t").agg(F.min_by("g", F.struct("n", "g")).alias("g"), F.count("*").alias("known"))
    rarest = met.where(F.col("known") == F.size(runs("t"))).select("t", "g")
    pairs = rarest.join(held, "g").where(F.col("low").contains(F.col("t"))).select("t", "target")
    return tokens.join(pairs, "t").select("source", "target").distinct()


def wiki_links(terms: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page, term, id): for each term of a page the node of least id whose name equals it, case ignored."""
    t = terms.select("page", "term", F.lower("term").alias("k")).distinct()
    n = nodes.where(F.col("name").isNotNull()).groupBy(F.lower("name").alias("k")).agg(F.min("id").alias("id"))
    return t.join(n, "k").select("page", "term", "id")


def name_communities(members: DataFrame, provider: Provider, most: int = 20) -> DataFrame:
    """(community, title) by a provider, from the first ``most`` member names of each community."""
    first = ranked(members.select("community", "name"), ["community"], most, "name").groupBy("community").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))

    @F.pandas_udf("string")
    def title(names: pd.Series) -> pd.Series:
        return names.map(lambda x: provider.complete(f"Name this group of symbols in a few words:\n{x}"))

    return first.select("community", title("names").alias("title"))


def decision_timeline(g: Graph, dated_first: bool = False) -> DataFrame:
    rows = g.of("Decision").select("date", "name", "status", "domain")
    order = [F.when(F.coalesce("date", F.lit("")) == "", 1).otherwise(0)] if dated_first else []
    return rows.orderBy(*order, "date", "name")


def action_items(listed: DataFrame, entities: DataFrame) -> DataFrame:
    """Listed action items (action, assignee, context) and entities typed as tasks, in one form."""
    more = entities.where(F.lower("type").isin("task", "action_item", "action item")).select(F.col("name").alias("action"), F.lit("").alias("assignee"), F.coalesce("description", F.lit("")).alias("context"))
    return listed.select("action", F.coalesce("assignee", F.lit("")).alias("assignee"), F.coalesce("context", F.lit("")).alias("context")).unionByName(more).distinct()


def module_docs(g: Graph, path_part: str = "", files: int = 50, symbols: int = 200) -> DataFrame:
    """(file_path, n_symbols, lines): a line for each symbol with the first line of its docstring."""
    rows = g.of(*SYMBOLS).where(F.coalesce("file_path", F.lit("")).contains(path_part))
    first = F.substring(F.element_at(F.split(F.coalesce("docstring", F.lit("")), "\n"), 1), 1, 80)
    line = F.concat(F.lit("- "), F.lower("label"), F.lit(" "), "name", F.when(first != "", F.concat(F.lit(": "), first)).otherwise(F.lit("")))
    rows = rows.select("file_path", "name", "id", F.coalesce("line_start", F.lit(0)).alias("at"), line.alias("line"))
    kept = rows.groupBy("file_path").agg(F.count("*").alias("n_symbols")).orderBy("file_path").limit(files)
    rows = ranked(rows.join(kept, "file_path"), ["file_path"], symbols, "at", "name", "id")
    return rows.groupBy("file_path", "n_symbols").agg(F.array_sort(F.collect_list(F.struct("at", "name", "id", "line"))).alias("s")).select("file_path", "n_symbols", F.array_join(F.transform("s", lambda x: x["line"]), "\n").alias("lines"))


def natural_query(g: Graph, question: str, provider: Provider) -> DataFrame:
    """Ask a provider for SQL over nodes and edges, check that it only reads, run it."""
    from .security import guarded_sql

    text = provider.complete(f"Tables nodes and edges of a property graph.\nWrite one SQL query that answers:\n{question}")
    return guarded_sql(g, text.strip().removeprefix("```sql").removeprefix("```").removesuffix("```").strip())

"""Long exact spans shared between records, by prefix-partitioned sparse suffix trees.

A span of at least ``span`` characters that two texts share is found without looking at every suffix: in every
window of ``span // 2`` characters the k-gram with the smallest hash is an anchor, so both texts have the same anchor
in the first half of the span, and the suffixes that start there agree for at least ``span - span // 2 + k``
characters. The suffixes at anchors are partitioned by a hash of that prefix; a prefix only one party has is dropped
before any text moves. The suffixes of each remaining prefix form a subtree: they are sorted, the common prefixes of
neighbours give its internal nodes, and at a node of depth d the suffixes that also agree on the ``span - d``
characters to their left share a span; those that agree on more to the left are a class of their own, so classes are
repeats that can't be made longer inside the context. Each suffix carries only its own context, so a group's size in
memory is its number of suffixes times ``span * 3 // 2`` characters.

Prefixes have no fixed length: a group of more than ``group_rows`` suffixes is split by longer ones. Its range of
depths is halved, and for the lower depths the prefix grows to the left by what those depths need there (it is then a
prefix of an earlier suffix), for the upper ones to the right. Halves that are still too large are halved again, down
to prefixes of ``span`` characters, whose suffixes are one class and need no tree. So no task holds more than
``group_rows`` suffixes of a prefix, and nothing that is shared is missed.

No pairs are built in the trees: the documents of a shared span are its class, classes of the same documents count
once, and Spark pairs the documents of a class in blocks of at most about ``BLOCK`` on either side, so that a span of
very many documents is spread over many tasks. Spans come from the classes too: overlapping classes with the same
documents at the same distances are one longer span.

Characters are code points and nothing is normalised. Null and short texts share nothing. A document id that occurs
in several rows counts as one document (its rows are told apart by their texts only). An empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial
from itertools import groupby
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.llm.tables import spread
from wattloom.session import cut_table

SPAN, GRAM, GROUP_ROWS = 200, 16, 50_000
BLOCK, PART_PAIRS, MOST_PARTS = 1000, 1_000_000, 20_000  # of pairing a class: documents in a block, pairs in a task and tasks at most
SAMPLE, SEEN, MOST_FREQUENT, SALTS = 0.01, 10, 1000, 256  # of finding prefixes that many documents share, see _frequent
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_CHUNK = 60_000  # characters hashed at a time: what stays in the processor's cache


def _slide(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """Minimum or maximum of every ``width`` consecutive values, by doubling."""
    size = 1
    while size * 2 <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return x if size == width else best(x[: len(x) - (width - size)], x[width - size :])


def anchors(codes: np.ndarray, window: int, gram: int = GRAM) -> np.ndarray:
    """Positions of the k-grams with the smallest hash of any ``window`` characters in a row."""
    width = window - gram + 1
    if len(codes) < window:
        return np.empty(0, np.int64)
    h, size = codes.astype(np.uint64) * _MIX, 1
    while size < gram:
        h = (h[:-size] * _MIX2) ^ h[size:]
        h = h * _MIX
        h ^= h >> np.uint64(32)
        size *= 2
    low = _slide(h, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_slide(np.concatenate([edge, low, edge]), width, np.maximum) == h)


def _suffixes(span: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(prefix, doc_id, party, pos) of the suffixes at anchors; texts are hashed many at a time, anchors of seams do no harm."""
    window, deep = span // 2, span - span // 2 + GRAM
    for batch in batches:
        ids, texts, parties = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
        keys: list[int] = []
        docs: list[np.ndarray] = []
        sides: list[np.ndarray] = []
        at: list[np.ndarray] = []
        chunk: list[int] = []
        size = 0
        for i, t in enumerate([*texts, None]):
            if t is not None and len(t) >= span:
                chunk.append(i)
                size += len(t)
            if chunk and (size >= _CHUNK or i == len(texts)):
                raw = "".join(texts[j] for j in chunk).encode("utf-32-le", "surrogatepass")
                codes = np.frombuffer(raw, np.uint32)
                lengths = np.array([len(texts[j]) for j in chunk])
                ends = np.cumsum(lengths)
                p = anchors(codes, window)
                k = np.searchsorted(ends, p, "right")
                ok = p + deep <= ends[k]
                p, k = p[ok], k[ok]
                keys += [xxhash.xxh3_64_intdigest(raw[4 * a : 4 * (a + deep)]) for a in p.tolist()]
                of = np.array(chunk)[k]
                docs.append(ids[of])
                sides.append(parties[of])
                at.append(p - (ends - lengths)[k])
                chunk, size = [], 0
        if keys:
            yield pa.record_batch({"prefix": pa.array(np.array(keys, np.uint64).view(np.int64)), "doc_id": pa.array(np.concatenate(docs), pa.int64()), "party": pa.array(np.concatenate(sides), pa.int32()), "pos": pa.array(np.concatenate(at).astype(np.int32))})


def _common(a: str, b: str) -> int:
    return len(commonprefix((a, b)))


def _nodes(rights: list[str], deep: int, most: int) -> Iterator[tuple[int, list[int]]]:
    """Internal nodes of the tree of sorted suffixes, as (depth, starts of the node's children and its end); depth is at least ``deep``, and ``most`` at most."""
    lcp = [min(_common(a, b), most) for a, b in zip(rights, rights[1:])]
    stack: list[tuple[int, list[int]]] = []  # (depth, child starts)
    for i, d in enumerate([*lcp, -1]):
        start = i
        while stack and stack[-1][0] > d:
            depth, starts = stack.pop()
            yield depth, [*starts, i + 1]
            start = starts[0]
        if d >= deep:
            if stack and stack[-1][0] == d:
                stack[-1][1].append(i + 1)
            else:
                stack.append((d, [start, i + 1]))


_MEMBERS = "span_hash string, doc_id bigint, start int, stop int"


def _tree(span: int, named: bool, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members of the classes of equal spans of the subtrees in rows sorted by prefix and depths (a prefix may run over several batches).

    Without names a suffix's stretch is left out if a deeper class of the suffix covers it: deeper nodes come first.
    """
    names = ["prefix", "lo", "hi", "doc_id", "party", "pos", "left", "right"]
    rows = (r for b in batches for r in zip(*[b[c].tolist() for c in names]))
    out: list[tuple] = []
    for (_, lo, hi), group in groupby(rows, key=lambda r: r[:3]):
        members = sorted((r[7], r[6][::-1], r[3], r[4], r[5]) for r in group)
        reach = [-1] * len(members)
        for depth, starts in _nodes([m[0] for m in members], lo, hi - 1):
            child = {i: c for c, (a, b) in enumerate(zip(starts, starts[1:])) for i in range(a, b)}
            order = sorted(child, key=lambda i: members[i][1])
            for left, cuts in _nodes([members[i][1] for i in order], span - depth, span):
                same = order[cuts[0] : cuts[-1]]
                if len({members[i][3] for i in same}) < 2:
                    continue
                if depth < hi - 1 and len({child[i] for i in same}) == 1:
                    continue  # the child's own class holds them all
                if not named:
                    new = [i for i in same if reach[i] < left]
                    for i in new:
                        reach[i] = left
                    out += [(None, members[i][2], members[i][4] - left, members[i][4] + depth) for i in new]
                    continue
                text, before, _, _, _ = members[same[0]]
                name = hashlib.sha256((before[:left][::-1] + text[:depth]).encode("utf-8", "surrogatepass")).hexdigest()
                out += [(name, members[i][2], members[i][4] - left, members[i][4] + depth) for i in same]
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["span_hash", "doc_id", "start", "stop"])
                out = []
    if out:
        yield pd.DataFrame(out, columns=["span_hash", "doc_id", "start", "stop"])


_SUFFIX = "prefix bigint, doc_id bigint, party int, pos int"


def _frequent(d: DataFrame, span: int) -> list[int]:
    """Prefixes seen in many documents of a small sample; they are shared for certain, so their suffixes need no common task to find out.

    The sample only balances the work: every suffix of any other prefix is compared as well.
    """
    seen = d.sample(SAMPLE, seed=5).mapInArrow(partial(_suffixes, span), _SUFFIX)
    often = seen.groupBy("prefix").agg(F.countDistinct("doc_id").alias("n")).where(F.col("n") >= SEEN).orderBy(F.desc("n"), "prefix").limit(MOST_FREQUENT)
    return [r["prefix"] for r in often.select("prefix").collect()]


def shared(docs: DataFrame, doc_id: str, text: str, span: int = SPAN, group_rows: int = GROUP_ROWS, party: Column | None = None, named: bool = True) -> DataFrame:
    """(span_hash, doc_id, start, stop): the members of every class of equal spans that at least two parties have; each document is its own party unless ``party`` (an int) says otherwise.

    With ``named`` false only the stretches are meant, not the classes: those inside another one may be missing.
    """
    half, deep = span // 2, span - span // 2 + GRAM
    own = party is None
    d = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), (F.lit(0) if own else party).cast("int").alias("party")).where(F.length("text") >= span)
    d = spread(d)
    suffixes = d.mapInArrow(partial(_suffixes, span), _SUFFIX)
    frequent = F.col("prefix").isin(_frequent(d, span))
    w = Window.partitionBy("prefix", F.when(frequent, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0))
    who = "doc_id" if own else "party"
    several = suffixes.withColumns({"_a": F.min(who).over(w), "_b": F.max(who).over(w)}).where(frequent | (F.col("_a") != F.col("_b")))
    kept = cut_table(several.select("prefix", "doc_id", "party", "pos"))
    left = F.substring("text", F.greatest(F.col("pos") + 1 - (half - GRAM), F.lit(1)), F.least(F.col("pos"), F.lit(half - GRAM)))
    at = [F.col(who).alias("party"), "pos", left.alias("left"), F.substring("text", F.col("pos") + 1, F.lit(span)).alias("right")]
    level = kept.join(d.drop("party"), "doc_id").select("prefix", F.lit(deep).alias("lo"), F.lit(span + 1).alias("hi"), "doc_id", *at)
    large = kept.groupBy("prefix").count().where(F.col("count") > group_rows).select("prefix")
    if large.isEmpty():
        return _trees(level, span, named)
    found, level, large = None, cut_table(level), large.withColumn("lo", F.lit(deep))
    while True:
        done = _trees(level.join(large, ["prefix", "lo"], "left_anti"), span, named)
        found = done if found is None else found.unionByName(done)
        level = cut_table(_longer(level.join(large, ["prefix", "lo"], "left_semi"), span))
        one = level.where("hi = lo + 1")  # prefixes of the whole span: what has it is a class
        name = F.sha2(F.concat(F.right("left", F.lit(span) - F.col("lo")), F.left("right", F.col("lo"))), 256)
        one = cut_table(one.select(name.alias("span_hash"), "doc_id", "party", (F.col("pos") - (F.lit(span) - F.col("lo"))).cast("int").alias("start"), (F.col("pos") + F.col("lo")).cast("int").alias("stop")))
        both = one.groupBy("span_hash").agg(F.min("party").alias("_a"), F.max("party").alias("_b")).where("_a <> _b").select("span_hash")
        found = found.unionByName(one.join(both, "span_hash").select("span_hash", "doc_id", "start", "stop"))
        level = level.where("hi > lo + 1")
        large = cut_table(level.groupBy("prefix", "lo").count().where(F.col("count") > group_rows).select("prefix", "lo"))
        if large.isEmpty():
            return found.unionByName(_trees(level, span, named))


def _trees(level: DataFrame, span: int, named: bool) -> DataFrame:
    key = ["prefix", "lo", "hi"]
    return level.repartition(*key).sortWithinPartitions(*key).mapInPandas(partial(_tree, span, named), _MEMBERS)


def _longer(level: DataFrame, span: int) -> DataFrame:
    """Each suffix under the prefixes of the lower and of the upper half of its depths, where its context reaches so far."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))
    d = level.withColumn("_h", F.explode(halves)).select("doc_id", "party", "pos", "left", "right", "_h.*")
    need = F.lit(span + 1) - F.col("hi")
    d = d.where((F.length("left") >= need) & (F.length("right") >= F.col("lo")))
    return d.select(F.xxhash64("lo", F.right("left", need), F.left("right", F.col("lo"))).alias("prefix"), "lo", "hi", "doc_id", "party", "pos", "left", "right")


def _paired(members: DataFrame, block: int) -> DataFrame:
    """(doc_id_a, doc_id_b): all pairs of the documents of each class, joined in blocks; classes of the same documents are joined once."""
    members = cut_table(members.distinct())
    h = F.xxhash64("doc_id")
    classes = members.groupBy("span_hash").agg(F.count("*").alias("n"), F.bit_xor(h).alias("_x"), F.sum(h.cast("decimal(20,0)")).alias("_y"), F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi"))
    once = classes.groupBy("n", "_x", "_y", "_lo", "_hi").agg(F.min("span_hash").alias("span_hash")).select("span_hash", "n", F.ceil(F.col("n") / block).cast("int").alias("_n"))
    # few members make many pairs: parts are set by the pairs, else adaptive execution would join small tables in one task
    parts = math.ceil((once.agg(F.sum(F.col("n").cast("double") * F.col("n") / 2)).first()[0] or 0) / PART_PAIRS) + 1
    parts = min(max(parts, members.sparkSession.sparkContext.defaultParallelism), MOST_PARTS)
    m = cut_table(members.join(once.drop("n"), "span_hash").withColumn("_b", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.col("_n")).cast("int")))
    a = m.select("span_hash", F.col("_b").alias("i"), F.explode(F.sequence("_b", F.col("_n") - 1)).alias("j"), F.col("doc_id").alias("x"))
    b = m.select("span_hash", F.explode(F.sequence(F.lit(0), "_b")).alias("i"), F.col("_b").alias("j"), F.col("doc_id").alias("y"))
    key = ["span_hash", "i", "j"]
    both = a.repartition(parts, *key).join(b.repartition(parts, *key).hint("merge"), key).where((F.col("i") < F.col("j")) | (F.col("x") < F.col("y")))
    return both.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).repartition(parts, "doc_id_a", "doc_id_b").distinct()


def shared_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, group_rows: int = GROUP_ROWS, block: int = BLOCK) -> DataFrame:
    """(doc_id_a, doc_id_b): all pairs of documents with a common run of ``span`` characters or more, smaller id first."""
    return _paired(shared(docs, doc_id, text, span, group_rows).select("span_hash", "doc_id"), block)


def covered(members: DataFrame) -> DataFrame:
    """(doc_id, n_spans, shared_chars): per document the stretches of its classes, merged, and their length."""
    w = Window.partitionBy("doc_id").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    s = members.select("doc_id", "start", "stop").distinct().withColumn("_end", F.max("stop").over(w))
    new = F.col("_end").isNull() | (F.col("start") > F.col("_end"))
    s = s.withColumns({"_new": F.when(new, 1).otherwise(0), "_add": F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce("_end", "start")))})
    return s.groupBy("doc_id").agg(F.sum("_new").cast("int").alias("n_spans"), F.sum("_add").cast("int").alias("shared_chars"))


def shared_coverage(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, n_spans, shared_chars, n_chars): per document the stretches that other documents share, merged, and their length."""
    per = covered(shared(docs, doc_id, text, span, group_rows, named=False))
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.length(text).alias("n_chars"))
    return own.join(per, "doc_id", "left").select("doc_id", F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


def shared_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(span_id, doc_id, start, n_chars): the verbatim spans of ``span`` characters or more that several documents have, one row per occurrence; ``start`` counts from 0.

    Occurrences of a span have the same text. Overlapping classes that the same documents have at the same distances are
    one span. A part of a span that further documents have as well is a span of its own.
    """
    m = cut_table(shared(docs, doc_id, text, span, group_rows).distinct())
    h = F.xxhash64("doc_id")
    per = m.groupBy("span_hash").agg(F.count("*").alias("n"), F.bit_xor(h).alias("_x"), F.sum(h.cast("decimal(20,0)")).alias("_y"), F.min(F.struct("doc_id", "start")).alias("_c"))
    d = m.join(per, "span_hash").withColumn("_shift", F.col("start") - F.col("_c.start"))
    key = ["n", "_x", "_y", F.col("_c.doc_id"), "doc_id", "_shift"]
    w = Window.partitionBy(*key).orderBy("start", "stop")
    d = d.withColumn("_end", F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("_island", F.sum(F.when(F.col("_end") > F.col("start"), 0).otherwise(1)).over(w))
    d = d.groupBy("n", "_x", "_y", F.col("_c.doc_id").alias("_first"), "doc_id", "_shift", "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    name = F.sha2(F.concat_ws("|", "n", "_x", "_y", "_first", F.col("start") - F.col("_shift"), F.col("stop") - F.col("_shift")), 256)
    return d.select(name.alias("span_id"), "doc_id", "start", (F.col("stop") - F.col("start")).alias("n_chars"))

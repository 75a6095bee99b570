"""The same or nearly the same record on two sides of a split, by a partitioned suffix array.

Each record becomes one text: a line of its target's values, then one line per labelled list or number of its prompt,
in the order of the labels and with numbers in one spelling. Exact copies of a text are one class.

Pairs: the texts, each as the suffix that starts at its target's line, are range-partitioned into parts of about
``PART_CHARS`` characters and sorted; the longest common prefix of neighbours tells where it goes past the target's
line, and neighbours joined by such prefixes form a run. A run that ends inside its part is judged there; the runs at a
part's ends are kept and counted with those of the other parts, so nothing is stitched by the driver and a run of any
size may lie over many parts. Only the runs with texts of both sides give candidates.

Inside a run, candidates are joined on numbers that have to agree: if four fifths of all numbers agree, one of the first
fifth (plus one) of either record's numbers does, in any order of the labels that holds for all. The labels whose
values tell records apart best come first (by the runs' own value counts), so a run that holds a third of all records
meets in small buckets. Numbers are compared by value in steps a little wider than the tolerance, and every candidate
is checked number by number.

Coverage: the suffixes of whole texts as they are written, in the groups of ``spans.shared``; what neighbours of two
sides have in common, ``span`` characters or more, is merged per record.

Records with a null or unreadable target take part in no pair; numbers may be missing or repeated (of a label's values
the smallest counts); without any number two prompts aren't alike. Repeated rows count each; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.llm.spans import GROUP_ROWS, covered, shared
from wattloom.llm.tables import spread
from wattloom.session import cut_table

PART_CHARS, BEGIN = 8_000_000, 128  # of texts sorted in one task, of the beginning of a text that sets its part
SPAN = 100  # of coverage: the shortest shared run; labels that unrelated records have are shorter
TARGET = "e array<double>, b array<double>, g array<double>, cf array<double>, i double, a double, p array<double>, q double"
_LABELLED = r"(?m)^[ \t]*([\p{L}][\p{L}\p{Nd} ]*?)[ \t]*[:=][ \t]*(\[[^\]\n]*\]|[+-]?[0-9][0-9,]*(?:\.[0-9]+)?)"


def _number(text: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(text, r"(?<=\d),(?=\d{3}(?:\D|$))", ""), r"[+-]?[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")


def texts(records: DataFrame, row_id: str, prompt: str, target: str, side: Column, keep: list[Column]) -> DataFrame:
    """(id, side, keep..., q, lines): the records' texts as arrays of lines, the target's first."""
    d = spread(records.select(F.col(row_id).cast("bigint").alias("id"), side.alias("side"), *keep, F.col(prompt).alias("_p"), F.col(target).alias("_t")).where(side.isNotNull()))
    d = d.withColumns({"_p": F.lower("_p"), "_t": F.from_json("_t", TARGET)})
    d = d.where(F.col("_t").isNotNull())
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("~"))), ",")
    head = F.concat_ws(";", *[F.concat(F.lit(f"{k}="), F.coalesce(listed(F.col(f"_t.{k}")), F.lit("~"))) for k in ("e", "b", "g", "cf", "p")], *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(f"_t.{k}").cast("string"), F.lit("~"))) for k in ("i", "a")])
    d = d.withColumns({"_head": head, "_l": F.regexp_extract_all("_p", F.lit(_LABELLED), F.lit(1)), "_v": F.regexp_extract_all("_p", F.lit(_LABELLED), F.lit(2)), "q": F.col("_t.q")})
    value = lambda v: F.when(v.startswith("["), F.array_join(F.transform(F.filter(F.split(F.regexp_replace(v, r"[\[\]\s]", ""), ","), lambda x: x != ""), lambda x: _number(x).cast("string")), ",")).otherwise(_number(v).cast("string"))
    lines = F.array_sort(F.zip_with("_l", "_v", lambda a, v: F.concat(F.regexp_replace(a, r"\s+", " "), F.lit("="), F.coalesce(value(v), F.lit("")))))
    return d.withColumn("lines", F.concat(F.array("_head"), F.coalesce(lines, F.array().cast("array<string>")))).drop("_p", "_t", "_head", "_l", "_v")


class Overlap:
    """Written steps of the pairs of one table of ``texts``."""

    def __init__(self, rows: DataFrame) -> None:
        text = F.concat(F.array_join("lines", "\n"), F.lit("\n"))
        base = cut_table(rows.withColumns({"_class": F.unhex(F.md5(F.concat_ws("\n", F.col("q").cast("string"), text))), "_text": text}).drop("lines"))
        classes = base.groupBy("_class").agg(F.min("id").alias("rep"), F.max(F.col("side") == "T").alias("t"), F.max(F.col("side") == "E").alias("e"))
        self.keep = [c for c in base.columns if c not in ("id", "side", "q") and c[0] != "_"]
        self.members = base.select("id", "side", *self.keep, "_class").join(classes, "_class").select("id", "side", "rep", *self.keep)
        one = classes.select(F.col("rep").alias("id"), "t", "e").join(base.select("id", "q", "_text"), "id")
        self.suffixes = cut_table(one.select("id", "t", "e", "q", F.col("_text").alias("suffix")))

    def array(self, part_chars: int = PART_CHARS) -> DataFrame:
        """(id, t, e, run): the texts of runs, by the common prefixes of neighbours in the sorted suffixes; texts that no neighbour goes along with past its target's line are left out unless they lie at a part's end."""
        d = self.suffixes.select("id", "t", "e", "suffix")
        parts = math.ceil((d.agg(F.sum(F.length("suffix"))).first()[0] or 0) / part_chars)
        # parts are told apart by the beginnings of texts only: the ranges' bounds are found on the driver
        d = d.withColumn("begin", F.left("suffix", F.lit(BEGIN))).repartitionByRange(max(1, parts), "begin", "id").drop("begin").sortWithinPartitions("suffix", "id")
        return cut_table(d.mapInPandas(_runs, "id bigint, t boolean, e boolean, run string"))

    def runs(self, part_chars: int = PART_CHARS) -> DataFrame:
        """(id, run, t, e, q, lines): the texts of the runs that have both sides."""
        a = self.array(part_chars)
        both = a.groupBy("run").agg(F.max("t").alias("_t"), F.max("e").alias("_e")).where("_t AND _e").select("run")
        lines = F.split(F.rtrim("suffix", F.lit("\n")), "\n")
        return a.join(both, "run").select("id", "run").join(self.suffixes, "id").select("id", "run", "t", "e", "q", lines.alias("lines"))


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One sorted part, as a stream: neighbours whose common prefix goes past the target's line share a run.

    Only texts with the beginning of the part's first or last text can have others of their run in another part; all
    other runs are whole here, and those of one side go no further.
    """
    before, run = "", []
    first: str | None = None
    held: list[tuple[str, list[tuple]]] = []  # beginning and rows of runs that may lie at the part's end
    out: list[tuple] = []

    def close() -> None:
        if run:
            name = before[: before.index("\n") + 1]
            held.append((run[0][3], [(*r[:3], name) for r in run]))
            run.clear()

    def release(at_end: bool) -> None:
        for begin, r in held:
            if at_end or begin == first or any(x[1] for x in r) and any(x[2] for x in r):
                out.extend(r)
        held.clear()

    for b in batches:
        for suffix, i, t, e in zip(b["suffix"].tolist(), b["id"].tolist(), b["t"].tolist(), b["e"].tolist()):
            begin = suffix[:BEGIN]
            first = begin if first is None else first
            if run and len(commonprefix((before, suffix))) <= before.index("\n"):
                close()
            if held and before[:BEGIN] != begin:
                release(False)
            run.append((i, t, e, begin))
            before = suffix
        yield pd.DataFrame(out, columns=["id", "t", "e", "run"])
        out.clear()
    close()
    release(True)
    yield pd.DataFrame(out, columns=["id", "t", "e", "run"])


def pairs(rows: DataFrame, near: float = 0.06, share: float = 0.8, q_near: float = 0.05, part_chars: int = PART_CHARS, kept: bool = False) -> DataFrame:
    """(train_id, eval_id; with ``kept`` also what the evaluation record keeps) of all records of the two sides with equal targets but for q, and ``share`` of all numbers in both and close."""
    o = Overlap(rows)
    r = o.runs(part_chars)
    pair = F.flatten(F.transform(F.slice("lines", 2, F.size("lines")), lambda x: F.transform(F.split(F.coalesce(F.try_element_at(F.split(x, "="), F.lit(2)), F.lit("")), ","), lambda v, i: F.struct(F.concat_ws("#", F.element_at(F.split(x, "="), 1), F.lpad(i.cast("string"), 6, "0")).alias("k"), v.try_cast("double").alias("v")))))
    r = r.withColumn("_n", F.array_sort(F.filter(pair, lambda x: x["v"].isNotNull())))
    r = cut_table(r.withColumn("n", F.filter("_n", lambda x, i: (i == 0) | (x["k"] != F.try_element_at(F.col("_n"), i)["k"]))).select("id", "run", "t", "e", "q", "n"))
    # which labels come first: those whose values have the fewest records of a run in common
    each = r.select("id", "run", "t", "e", F.size("n").alias("_size"), F.explode("n").alias("x"))
    each = each.select("id", F.xxhash64("run").alias("run"), "t", "e", "_size", F.col("x.k").alias("k"), F.floor(F.col("x.v") / F.lit(near * 1.2)).alias("bin"))
    held = each.groupBy("k", "run", "bin").agg(F.count("*").alias("_c"))
    score = held.groupBy("k").agg((F.sum(F.col("_c").cast("double") * F.col("_c")) / F.sum("_c")).alias("_score"))
    most = F.floor(F.col("_size") * F.lit(1 - share) + 1e-9).cast("int") + 1
    ranked = each.join(score, "k").groupBy("id", "run", "t", "e", "_size").agg(F.array_sort(F.collect_list(F.struct("_score", "k", "bin"))).alias("_a"))  # one record's numbers
    probe = ranked.select("id", "run", "t", "e", F.explode(F.slice("_a", F.lit(1), most)).alias("x")).select("id", "run", "t", "e", "x.k", "x.bin")
    left = probe.where("t").select(F.col("id").alias("a"), "run", "k", "bin")
    right = probe.where("e").select(F.col("id").alias("b"), "run", "k", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    asked = left.join(right, ["run", "k", "bin"]).select("a", "b").distinct()
    side = lambda p: r.select(F.col("id").alias(p), F.col("run").alias(f"r{p}"), F.col("q").alias(f"q{p}"), F.col("n").alias(f"n{p}"))
    both = asked.join(side("a"), "a").join(side("b"), "b").where("ra = rb")
    keys = lambda c: F.transform(c, lambda x: x["k"])
    close = lambda u, v: F.abs(u - v) <= near + 1e-9
    aligned = F.size(F.filter(F.zip_with("na", "nb", lambda x, y: close(x["v"], y["v"])), lambda z: z))
    sought = F.size(F.filter("na", lambda x: F.exists("nb", lambda y: (y["k"] == x["k"]) & close(x["v"], y["v"]))))
    agree = F.when(keys("na") == keys("nb"), aligned).otherwise(sought)
    union = F.size(F.array_union(keys("na"), keys("nb")))
    good = both.where((agree >= union * share - 1e-9) & (F.col("qa").eqNullSafe(F.col("qb")) | (F.abs(F.col("qa") - F.col("qb")) <= q_near + 1e-9))).select("a", "b")
    m, keep = o.members, o.keep if kept else []
    t = m.where("side = 'T'").select(F.col("rep").alias("a"), F.col("id").alias("train_id"))
    e = m.where("side = 'E'").select(F.col("rep").alias("b"), F.col("id").alias("eval_id"), *keep)
    return good.join(t, "a").join(e, "b").select("train_id", "eval_id", *keep)


def coverage(records: DataFrame, row_id: str, text: Column, side: Column, keep: list[Column], span: int = SPAN, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(id, side, keep..., covered_chars, n_chars): per record how many characters of its whole text lie in runs of ``span`` characters or more that a text of the other side has too, wherever they start.

    ``side`` is 'T', 'E' or null (left out); a null text has no characters.
    """
    base = records.select(F.col(row_id).cast("bigint").alias("id"), side.alias("side"), *keep, F.coalesce(text, F.lit("")).alias("_text")).where(F.col("side").isNotNull())
    base = base.withColumns({"_class": F.unhex(F.md5("_text")), "n_chars": F.length("_text")})
    classes = cut_table(base.groupBy("_class").agg(F.min("id").alias("rep"), F.bit_or(F.when(F.col("side") == "T", 1).otherwise(2)).alias("sides"), F.any_value("_text").alias("_text")))
    per = covered(shared(classes, "rep", "_text", span, group_rows, F.col("sides"), named=False))
    own = F.when(F.col("sides") == 3, F.col("n_chars")).otherwise(F.coalesce("shared_chars", F.lit(0)))  # a text on both sides is its own counterpart
    d = base.drop("_text").join(classes.select("_class", "rep", "sides"), "_class").join(per.withColumnRenamed("doc_id", "rep"), "rep", "left")
    return d.withColumn("covered_chars", own).select(*[c for c in base.columns if c[0] != "_" and c != "n_chars"], "covered_chars", "n_chars")

"""How far the sources of a language differ: sums of squared differences of term shares.

Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; a language keeps those in
at least LEAST_DOCS of its documents (rows). A group is a (lang, source). With N the group's
count over the V kept terms, a term counted n times there has the smoothed share
``p = 1 + floor(SCALE * (n + 1) / (N + V))``, and two shares differ by ``floor((p - q)^2 / q)``.
All sums are exact.

1. Terms are counted in each task, then summed by (lang, source, term).
2. Most pairs of a term and a source count nothing, so the sum over all kept terms is V times
   the value of two zero counts, plus a correction for each nonzero count alone, plus one for
   each pair of nonzero counts of a term.
3. Pair corrections come from a frequent-pattern tree: a term's row is the path of its nonzero
   counts in source order, inserted with the number of terms that have this path. A node and an
   ancestor stand for all rows below the node, so their correction is worked out once. Tasks
   hold neighbouring paths (a range of them each) and build trees of at most CELLS path steps.

Defined results: null text, lang and source count as ''; a group without kept terms still has
its pair rows, all 0 if the language keeps no term, and no term rows; a language with one source has
no pair rows; repeated rows count again; ties go to the smaller item by UTF-8; an empty table
gives no rows. Other columns are never read. Memory is bounded by FLUSH distinct terms and CELLS.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from themescope.llm.common import raw_texts, slices
from themescope.session import cut_lineage

LEAST_DOCS = 3
SCALE = 1_000_000_000
TERM_RANKS = 200
#: Distinct (group, term) counts that a task holds before it passes them on.
FLUSH = 500_000
#: Path steps in one tree.
CELLS = 2_000_000

_LETTERS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def _partial_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of each task; the empty term stands for the group itself."""

    def name(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    names = ["lang", "source", "term", "n", "docs"]
    kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]

    def run(batches):
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def rows():
            for (lang, source), (times, docs_with) in held.items():
                terms = [b"", *times]
                columns = [
                    [lang] * len(terms), [source] * len(terms), terms,
                    [0, *times.values()], [0, *(docs_with[t] for t in times)],
                ]
                for a in range(0, len(terms), 65536):
                    parts = [pa.array(c[a : a + 65536], k) for c, k in zip(columns, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(parts, names=names)
            held.clear()

        for batch in batches:
            for part in slices(batch):
                columns = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), raw_texts(part.column(2)), strict=True)
                for lang, source, text in columns:
                    counts = held.get((lang, source))
                    if counts is None:
                        counts = held[lang, source] = (Counter(), Counter())
                    terms = text.translate(_LETTERS).split()
                    counts[0].update(terms)
                    counts[1].update(set(terms))
                if sum(len(c[0]) + 1 for c in held.values()) > FLUSH:
                    yield from rows()
        yield from rows()

    picked = docs.select(name("lang"), name("source"), "text")
    return picked.mapInArrow(run, "lang string, source string, term binary, n long, docs long")


def term_counts(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, first) of kept terms; the term '' marks that a group exists.

    lang_n is the term's count in the language; first is true for one source of each term.
    """
    counts = (
        _partial_counts(docs)
        .withColumn("term", F.col("term").cast("string"))
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    term = W.partitionBy("lang", "term")  # one row a source
    return cut_lineage(
        counts.withColumns(
            {
                "all_docs": F.sum("docs").over(term),
                "lang_n": F.sum("n").over(term),
                "first": F.row_number().over(term.orderBy("source")) == 1,
            }
        )
        .where((F.col("term") == "") | (F.col("all_docs") >= least))
        .select("lang", "source", "term", "n", "lang_n", "first")
    )


def _share(n: str, total: str) -> F.Column:
    """Smoothed share; decimal, as counts may exceed what a long holds times SCALE."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10,0)) * ({n} + 1)) div nullif({total} + terms, 0)")


def _gap(p: str, q: str) -> F.Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def group_totals(counts: DataFrame) -> DataFrame:
    """(lang, source, no, total, terms, lang_total, zero): a group's number, its N and V, the language's N,
    and the share of a count of zero (null without terms)."""
    by_lang = counts.groupBy("lang").agg(
        F.sum((F.col("first") & (F.col("term") != "")).cast("long")).alias("terms"), F.sum("n").alias("lang_total")
    )
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(by_lang, "lang")
    number = F.row_number().over(W.partitionBy("lang").orderBy("source"))  # one row a source
    return cut_lineage(groups.withColumns({"no": number, "zero": _share("0", "total")}))


class Tree:
    """Frequent-pattern tree over rows of steps (number, share, share of zero), level by level."""

    def __init__(self, sizes: np.ndarray, steps: np.ndarray, times: np.ndarray, root: np.ndarray):
        """``steps`` has the three values of each step, row after row; ``root`` tells the tree of each row."""
        self.levels = []
        begin = np.cumsum(sizes) - sizes
        rows, node = np.arange(len(sizes)), root
        for depth in range(int(sizes.max(initial=0))):
            on = sizes[rows] > depth
            rows, node = rows[on], node[on]
            number, share = steps[begin[rows] + depth, 0], steps[begin[rows] + depth, 1]
            order = np.lexsort((share, number, node))
            rows, node, number, share = rows[order], node[order], number[order], share[order]
            new = np.ones(len(rows), bool)
            new[1:] = (np.diff(node) != 0) | (np.diff(number) != 0) | (np.diff(share) != 0)
            heads = np.flatnonzero(new)
            # a node: its first row (which has the ancestors' steps too) and the rows through it
            self.levels.append((begin[rows[heads]], np.add.reduceat(times[rows], heads), root[rows[heads]]))
            node = np.cumsum(new) - 1
        self.steps = steps

    def corrections(self):
        """For each node and ancestor: (tree, group, other, times, correction), both ways round."""
        for depth, (begin, times, root) in enumerate(self.levels):
            s, p, p0 = self.steps[begin + depth].T
            for above in range(depth):
                t, q, q0 = self.steps[begin + above].T
                yield root, s, t, times, gap(p, q) - gap(p, q0) - gap(p0, q) + gap(p0, q0)
                yield root, t, s, times, gap(q, p) - gap(q, p0) - gap(q0, p) + gap(q0, p0)


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _pair_corrections(paths: DataFrame) -> DataFrame:
    """(lang, no, other, high, low) for each tree: sums of corrections in two parts of 32 bits."""

    def summed(langs, sizes, steps, times):
        names, root = np.unique(langs, return_inverse=True)
        sums: dict[tuple, list[int]] = {}
        for at, s, t, many, value in Tree(sizes, steps, times, root).corrections():
            order = np.lexsort((t, s, at))
            at, s, t, many, value = at[order], s[order], t[order], many[order], value[order]
            heads = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(s) != 0) | (np.diff(t) != 0)]))
            high = np.add.reduceat(many * (value >> 32), heads)
            low = np.add.reduceat(many * (value & 0xFFFFFFFF), heads)
            for key in zip(at[heads].tolist(), s[heads].tolist(), t[heads].tolist(), high.tolist(), low.tolist(), strict=True):
                total = sums.setdefault(key[:3], [0, 0])
                total[0] += key[3]
                total[1] += key[4]
        rows = [(names[k[0]], k[1], k[2], *v) for k, v in sums.items()]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        arrays = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(arrays, names=["lang", "no", "other", "high", "low"])

    def run(batches):
        held, cells = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            steps = np.stack(
                [batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3)], axis=1
            )
            sizes = np.diff(lists.offsets.to_numpy())
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            held.append((langs, sizes, steps, batch.column(4).to_numpy()))
            cells += len(steps)
            if cells >= CELLS:
                yield summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, cells = [], 0
        if held:
            yield summed(*(np.concatenate(x) for x in zip(*held, strict=True)))

    flat = paths.select("lang", "path.no", "path.p", "path.zero", "times")
    return flat.mapInArrow(run, "lang string, no int, other int, high long, low long")


def _pairs(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each two sources of a language."""
    paths = cut_lineage(
        priced.groupBy("lang", "term")  # one row a source
        .agg(F.sort_array(F.collect_list(F.struct("no", "p", "zero"))).alias("path"))
        .groupBy("lang", "path")
        .agg(F.count("*").alias("times"))
    )
    both = _pair_corrections(paths.where(F.size("path") > 1).repartitionByRange("lang", "path"))
    wide = "CAST({} AS DECIMAL(38,0))".format
    shift = F.expr("high * CAST(4294967296 AS DECIMAL(10,0)) + low")
    parts = [both.groupBy("lang", "no", "other").agg(F.sum(F.expr(wide("high"))).alias("high"), F.sum(F.expr(wide("low"))).alias("low"))
             .select("lang", "no", "other", shift.cast("decimal(38,0)").alias("value"))]
    left = groups.select("lang", "no", "zero", "terms")
    right = groups.select("lang", F.col("no").alias("other"), F.col("zero").alias("other_zero"))
    met = left.join(right, "lang").where("no <> other")  # the pairs that are asked for
    parts.append(met.select("lang", "no", "other", F.coalesce(F.col("terms").cast("decimal(20,0)") * _gap("zero", "other_zero"), F.lit(0)).cast("decimal(38,0)").alias("value")))
    single = priced.groupBy("lang", "no", "zero", "p").agg(F.count("*").cast("decimal(20,0)").alias("times"))
    for here, there, change in (
        ("no", "other", _gap("p", "other_zero") - _gap("zero", "other_zero")),
        ("other", "no", _gap("other_zero", "p") - _gap("other_zero", "zero")),
    ):
        alone = single.join(right, "lang").where("no <> other")  # a line for each count that occurs, not each term
        parts.append(alone.select("lang", F.col(here).alias("no"), F.col(there).alias("other"), (F.col("times") * change).cast("decimal(38,0)").alias("value")))
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    total = total.groupBy("lang", "no", "other").agg(F.sum("value").cast("long").alias("value"))
    names = groups.select("lang", "no", "source")
    return total.join(names, ["lang", "no"]).join(
        names.select("lang", F.col("no").alias("other"), F.col("source").alias("item")), ["lang", "other"]
    )


def audit(docs: DataFrame, least: int = LEAST_DOCS, ranks: int = TERM_RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair`` has each other source of the language, by how much the group's shares differ
    from that one's; part ``term`` the ``ranks`` terms whose share exceeds the language's most.
    """
    counts = term_counts(docs, least)
    groups = group_totals(counts)
    priced = (
        counts.where(F.col("term") != "")
        .where(F.col("n") > 0)
        .join(groups, ["lang", "source"])
        .withColumns({"p": _share("n", "total"), "q": _share("lang_n", "lang_total")})
    )
    group = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(priced, groups).withColumn("rank", F.row_number().over(group))
    terms = (
        priced.where("p > q")
        .select("lang", "source", F.col("term").alias("item"), _gap("p", "q").alias("value"))
        .withColumn("rank", F.row_number().over(group))
        .where(F.col("rank") <= ranks)
    )
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(terms.withColumn("part", F.lit("term")).select(columns))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  coalesce(text, '') AS text FROM documents),
words AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text,
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY ALL HAVING count(DISTINCT row) >= {LEAST_DOCS}),
groups AS (SELECT DISTINCT lang, source FROM d),
counted AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c USING (lang, source, term)),
shares AS (SELECT *, 1 + ({SCALE} * (n + 1)) // (sum(n) OVER g + count(*) OVER g) AS p FROM cells
  WINDOW g AS (PARTITION BY lang, source)),
whole AS (SELECT lang, term, 1 + ({SCALE} * (n + 1)) // (sum(n) OVER l + count(*) OVER l) AS q FROM kept
  WINDOW l AS (PARTITION BY lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item,
    sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (SELECT s.lang, s.source, s.term AS item, (p - q) * (p - q) // q AS value
  FROM shares s JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
parts AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value FROM terms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked
WHERE part = 'pair' OR rank <= {TERM_RANKS}
"""

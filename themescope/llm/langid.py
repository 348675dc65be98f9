"""Language by cross-parsing entropy.

For each language a suffix automaton holds every substring of some labelled text. A text is
parsed from left to right into longest matches with each automaton; the fewer phrases it
takes, the better the language explains it. Phrases are normalised by the logarithm of the
automaton's text length (the cost of pointing at a match) and the number of symbols. The
language with the least cost wins; on equal costs the first in alphabetical order.

Symbols are the UTF-8 bytes of lower-cased letters, so that every script has symbols of its own
in a table of bounded width; everything else is one blank. Texts are parsed whole, in blocks of ``BLOCK`` symbols, many blocks in step: one table look-up moves all blocks of all
languages by one symbol.

Labelled text is a bounded sample of rows: for each language about ``SAMPLE_DOCS`` documents of
least id hash, each taken whole. Only where these hold more than ``SAMPLE_SYMBOLS`` bytes
together, windows of ``WINDOW`` characters are drawn by hash, evenly from all over the whole
texts, so that the automata stay bounded. The sample (not the automata) is broadcast; each
worker builds the automata once. Everything else sees all rows, with no shuffle.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is
everything when there is nothing to learn from; null ids count as the id '' in the fold;
repeated rows are judged alike.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themescope.llm.common import field, fold, lowest, per_text
from themescope.session import cut_lineage

SAMPLE_DOCS = 48
SAMPLE_SYMBOLS = 400_000
WINDOW = 500
BLOCK = 512


class Automaton:
    """Suffix automaton of a sequence of small numbers."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            now = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = now
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[now] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
                    link[q] = link[now] = copy
            last = now


class Models:
    """Automata of all languages in one table.

    A step is ``4 * next state + phrases that end``: 0 where the match goes on, 1 where the
    symbol starts a new phrase, 2 where it also is a phrase of its own. States with one way on
    (most) hold its symbol in ``only`` and its step in ``after``; ``table[row, symbol]`` has the
    other states and, once a language, what is done where nothing matches.
    """

    def __init__(self, samples: dict[str, list[str]]):
        self.names = sorted(samples)
        self.letter = np.zeros(0x110000, bool)
        self.letter[[i for i in range(0x110000) if chr(i).isalpha()]] = True
        raw = {name: self._bytes(" ".join(texts)) for name, texts in samples.items()}
        known = np.unique(np.concatenate([np.zeros(0, np.uint8), *raw.values()]))
        known = known[known != 32]
        # 0 blank, 1 a byte that the sample lacks, 2 and on the others, then padding
        self.symbol = np.ones(256, np.int16)
        self.symbol[known] = 2 + np.arange(len(known))
        self.symbol[32] = 0
        self.pad = 2 + len(known)
        width = self.pad + 1
        tables, only, after, rows = [], [], [], []
        self.roots, self.bits, base, n_rows = [], [], 0, 0
        for name in self.names:
            symbols = self.symbol[raw[name]]
            ways = Automaton(symbols.tolist()).next
            fresh = np.full(width, 4 * base + 2, np.int32)
            start = np.full(width, 4 * base + 1, np.int32)  # nothing ends yet, but a symbol without a match is a phrase
            for c, t in ways[0].items():
                fresh[c], start[c] = 4 * (base + t) + 1, 4 * (base + t)
            fresh[self.pad] = start[self.pad] = 4 * base
            one = np.full(len(ways), -1, np.int16)
            then, row = np.zeros(len(ways), np.int32), np.full(len(ways), n_rows, np.int32)
            branching = [s for s in range(1, len(ways)) if len(ways[s]) > 1]
            table = np.tile(fresh, (2 + len(branching), 1))
            table[1], row[0] = start, n_rows + 1
            for k, s in enumerate(branching, 2):
                row[s] = n_rows + k
                for c, t in ways[s].items():
                    table[k, c] = 4 * (base + t)
            for s in range(1, len(ways)):
                if len(ways[s]) == 1:
                    ((c, t),) = ways[s].items()
                    one[s], then[s] = c, 4 * (base + t)
            tables.append(table)
            only.append(one)
            after.append(then)
            rows.append(row)
            self.roots.append(base)
            self.bits.append(math.log2(len(symbols) + 2))
            base += len(ways)
            n_rows += len(table)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.only, self.after, self.row = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (only, after, rows))
        self.width = width

    def _bytes(self, text: str) -> np.ndarray:
        """UTF-8 bytes of the letters of a lower-cased text, and one blank for anything between them."""
        code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        letter = self.letter[code]
        code = np.where(letter, code, 32)[letter | np.append(False, letter[:-1])]
        return np.frombuffer(code.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)

    def symbols(self, text: str) -> np.ndarray:
        """Symbols of a lower-cased text."""
        return self.symbol[self._bytes(text)]

    def costs(self, texts: list[np.ndarray]) -> np.ndarray:
        """Bits a symbol for each text (row) and language (column)."""
        n_blocks = np.array([-(-len(x) // BLOCK) for x in texts], np.int64)
        grid = np.full((int(n_blocks.sum()), BLOCK), self.pad, np.int16)
        row = 0
        for x, n in zip(texts, n_blocks.tolist(), strict=True):
            grid[row : row + n].reshape(-1)[: len(x)] = x
            row += n
        columns = np.ascontiguousarray(grid.T)
        roots = np.array(self.roots, np.int64)[:, None]
        state = np.repeat(roots, len(grid), axis=1)
        phrases = np.ones((len(self.names), len(grid)), np.int64)  # the phrase open at the end
        for symbols in columns:
            other = self.table[self.row[state].astype(np.int64) * self.width + symbols]
            step = np.where(self.only[state] == symbols, self.after[state], other)
            phrases += step & 3
            state = (step >> 2).astype(np.int64)
        text = np.repeat(np.arange(len(texts)), n_blocks)
        out = np.zeros((len(texts), len(self.names)))
        for k in range(len(self.names)):
            out[:, k] = np.bincount(text, phrases[k], len(texts)) * self.bits[k]
        return out / np.maximum([len(x) for x in texts], 1)[:, None]


def spread(text: str, seed: int, share: float) -> str:
    """The whole text, or that share of its windows, chosen by hash, in their order."""
    if share >= 1:
        return text
    out, last = [], -1
    for k in range(-(-len(text) // WINDOW)):
        if zlib.crc32(f"{seed}:{k}".encode()) < share * 2**32:
            out.append(" " * (last not in (-1, k - 1)) + text[k * WINDOW : (k + 1) * WINDOW])
            last = k
    return "".join(out)


def samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_symbols: int = SAMPLE_SYMBOLS) -> dict[str, list[str]]:
    """Labelled text of each language outside the held-out fold, lower-cased."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", 5) != 0))
    rows = rows.select("lang", "text", F.xxhash64("doc_id").alias("__h"))
    limits = lowest(rows, "lang", sample_docs)
    if not limits:
        return {}
    bound = docs.sparkSession.createDataFrame(list(limits.items()), "lang string, __limit long")
    chosen = cut_lineage(  # about sample_docs rows a language
        rows.join(F.broadcast(bound), "lang")  # one row a language
        .where(F.col("__h") <= F.col("__limit"))
        .select("lang", "__h", F.lower("text").alias("part"))
        .groupBy("lang", "__h")
        .agg(F.min("part").alias("part"))
    )
    sizes = {r["lang"]: r["n"] for r in chosen.groupBy("lang").agg(F.sum(F.octet_length("part")).alias("n")).collect()}

    def pick(batches):
        for batch in batches:
            langs, seeds, texts = (batch.column(k).to_pylist() for k in range(3))
            parts = [spread(t, h, sample_symbols / max(sizes[n], 1)) for n, h, t in zip(langs, seeds, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.string())], names=["lang", "__h", "part"])

    out: dict[str, list[str]] = {}
    for r in chosen.mapInArrow(pick, "lang string, __h long, part string").orderBy("lang", "__h").collect():
        out.setdefault(r["lang"], []).append(r["part"])
    return out


_HERE: dict = {}


def _models(kept) -> Models:
    key = repr(sorted((k, hash(tuple(v))) for k, v in kept.items()))
    if key not in _HERE:
        _HERE.clear()
        _HERE[key] = Models(kept)
    return _HERE[key]


def predict(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_symbols: int = SAMPLE_SYMBOLS) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``; score: how far the second-best language lies behind."""
    kept = docs.sparkSession.sparkContext.broadcast(samples(docs, sample_docs, sample_symbols))

    def start():
        models = _models(kept.value)

        def work(texts):
            lowered = [x.decode("utf-8", "replace").lower() for x in texts]
            symbols = [models.symbols(x) for x in lowered]
            some = [i for i, s in enumerate(symbols) if (s > 0).any()] if models.names else []
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            if some:
                costs = models.costs([symbols[i] for i in some])
                best = costs.argmin(axis=1)
                for i, row, b in zip(some, costs, best.tolist(), strict=True):
                    names[i] = models.names[b]
                    rest = np.delete(row, b)
                    scores[i] = float(np.clip(1 - row[b] / rest.min(), 0, 1)) if len(rest) else 1.0
            return names, scores

        return work

    out = per_text(docs.select("doc_id", "text"), ["doc_id"], [field("lang_pred", "string"), field("score", "double")], start)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")

"""Periodic runs, source audit and mixture packing, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as tokenizers
import pytest
from fixtures import SCHEMA, clashing, empty, odd, odd_rows, prose, rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from themescope.llm import audit, mixture, runs

# --- periodic runs ------------------------------------------------------


def plain_runs(w):
    """Every run of exponent 4 and six words by trying all periods."""
    found = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            size = i + q - s
            smaller = any(all(w[s + t] == w[s + t + d] for t in range(size - d)) for d in range(1, q))
            if size >= max(6, 4 * q) and not smaller:
                found.add((s, size, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def longest_lyndon(w):
    def is_lyndon(u):
        return all(u < u[k:] for k in range(1, len(u)))

    return [max(j - i for j in range(i + 1, len(w) + 1) if is_lyndon(w[i:j])) for i in range(len(w))]


def test_groups_give_the_lyndon_array():
    draw = random.Random(1)
    for _ in range(200):
        word = [draw.randint(0, 2) for _ in range(draw.randint(0, 13))]
        for order in (word, [-w for w in word]):
            got = [0] * len(word)
            for _, head, size, copies in runs.lyndon_chains(order):
                got[head : head + size * copies : size] = [size] * copies
            assert got == longest_lyndon(order)


def test_runs_equal_a_search_over_all_periods():
    draw = random.Random(2)
    for _ in range(400):
        texts = []
        for _ in range(4):
            letters, n = draw.randint(1, 5), draw.randint(0, 60)
            w = [draw.randint(0, letters) for _ in range(n)]
            if draw.random() < 0.7 and n > 4:
                a, p = draw.randrange(n), draw.randint(1, 8)
                w = [w[i] if i < a else w[min(n - 1, a + (i - a) % p)] for i in range(n)]
            texts.append([b"%d" % x for x in w + [9] * draw.randint(0, 7)])
        assert runs.find(texts) == [plain_runs(x) for x in texts]


def test_long_periodic_texts_take_linear_work():
    for word in (["a"] * 200_000, ["a", "b"] * 100_000, ["x", "y", "x", "z", "y"] * 40_000):
        text = [w.encode() for w in word]
        (found,) = runs.find([text])
        assert max(found, key=lambda r: r[1]) == (0, len(text), len(set(word)) if len(set(word)) < 3 else 5)


def plain_digest(doc_id, text, planted):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if planted and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@pytest.mark.parametrize("planted", [False, True])
def test_run_digests_of_odd_rows(spark, planted):
    small = [r for r in odd_rows() if len(r[1] or "") < 5000]
    small += [(100 + k, prose(900 + k, 150), "en", "s", 1) for k in range(60)]
    docs = spark.createDataFrame(small, SCHEMA)
    want = sorted((plain_digest(r[0], r[1], planted) for r in small), key=repr)
    out = runs.digests(clashing(docs), planted)
    assert out.columns == NAMES
    assert sorted((tuple(r) for r in out.collect()), key=repr) == want
    assert any(r[1] for r in want)
    assert runs.digests(empty(spark), planted).count() == 0
    named = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert sorted(r["runs_sha256"] for r in runs.digests(named, planted).collect()) == sorted(w[6] for w in want)


def test_runs_as_rows_and_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "a b a b a b a b c"), (2, "x y z"), (3, None), (3, "q q q q q q q")], "doc_id bigint, text string")
    assert rows(runs.periodic_runs(docs)) == [(1, 8, 2, 0), (3, 7, 1, 0)]
    assert rows(runs.collapse(docs)) == [(1, "a b c"), (2, "x y z"), (3, ""), (3, "q")]


# --- source audit -------------------------------------------------------


def plain_audit(table, least=3, ranks=200):
    words = [
        (lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")))
        for _, text, lang, source, *_ in table
    ]
    out = []
    for lang in {w[0] for w in words}:
        mine = [w for w in words if w[0] == lang]
        docs = Counter(t for w in mine for t in set(w[2]))
        kept = sorted(t for t in docs if docs[t] >= least)
        counts = defaultdict(Counter)
        for _, source, terms in mine:
            counts[source].update(t for t in terms if docs[t] >= least)
            counts[None].update(t for t in terms if docs[t] >= least)

        def share(source, counts=counts, kept=kept):
            n = sum(counts[source].values())
            return {t: 1 + 10**9 * (counts[source][t] + 1) // (n + len(kept)) for t in kept}

        shares = {s: share(s) for s in counts}
        for s in counts:
            if s is None:
                continue
            pairs = [(sum((shares[s][t] - shares[o][t]) ** 2 // shares[o][t] for t in kept), o) for o in counts if o not in (s, None)]
            terms = [
                ((shares[s][t] - shares[None][t]) ** 2 // shares[None][t], t)
                for t in kept if counts[s][t] and shares[s][t] > shares[None][t]
            ]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(item, lang, part, k + 1, s, value) for k, (value, item) in enumerate(found[:most])]
    return sorted(out, key=repr)


def audit_rows():
    draw = random.Random(8)
    table = odd_rows()
    for k in range(90):
        lang, source = draw.choice(["en", "de", "", None]), draw.choice(["s", "a", "b", "é", "", None, "zz"])
        table.append((200 + k, prose(k % 40, draw.choice([3, 40, 120])) + " Ünï ÀÉ_x1y " * (k % 3), lang, source, 1))
    table += [(400, "only one source here " * 4, "xx", "lonely", 1)] * 3 + [(401, "!!", "yy", "a", 1), (402, None, "yy", "b", 1)]
    return table


def test_audit_equals_plain_sums_and_sql(spark):
    table = audit_rows()
    docs = spark.createDataFrame(table, SCHEMA)
    want = plain_audit(table)
    got = rows(audit.audit(clashing(docs).repartition(5)))
    assert got == want
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(table, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    made = con.execute(f"SELECT item, lang, part, rank, source, value FROM ({audit.SQL})").fetchall()
    assert sorted(made, key=repr) == want


def test_audit_of_small_trees_and_few_ranks(spark, monkeypatch):
    monkeypatch.setattr(audit, "CELLS", 7)
    monkeypatch.setattr(audit, "FLUSH", 5)
    table = audit_rows()
    docs = spark.createDataFrame(table, SCHEMA)
    assert rows(audit.audit(docs, least=1, ranks=2)) == plain_audit(table, 1, 2)
    assert audit.audit(empty(spark)).count() == 0


def test_tree_shares_paths():
    steps = np.array([[1, 5, 1], [2, 7, 1], [1, 5, 1], [2, 7, 1], [3, 9, 1], [1, 5, 1]])
    tree = audit.Tree(np.array([2, 3, 1]), steps, np.array([2, 3, 4]), np.zeros(3, int))
    assert [len(level[0]) for level in tree.levels] == [1, 1, 1]
    assert [level[1].tolist() for level in tree.levels] == [[9], [5], [3]]
    assert sum(len(c[0]) for c in tree.corrections()) == 2 * 3  # node and ancestor, both ways


# --- mixture packing ----------------------------------------------------


def walked(schedule, totals):
    """Grains in the order of a round-robin that serves whoever is due first."""
    return sorted(
        (((j + 1) << mixture.UNIT) // int(w), q, j)
        for q, w in enumerate(schedule.weight) for j in range(totals[q] // schedule.grain)
    )


def test_schedule_fills_windows_in_order_of_time():
    draw = random.Random(3)
    for _ in range(200):
        grain = draw.choice([1, 2, 4])
        row = grain * draw.choice([1, 2, 4, 8])
        totals = [draw.choice([0, draw.randint(0, 60)]) for _ in range(draw.randint(1, 5))]
        schedule = mixture.Schedule(totals, [draw.random() for _ in totals], row, grain)
        texts = []
        for q, total in enumerate(totals):
            at = 0
            while at < total:
                texts.append((q, at, min(total - at, draw.randint(1, 20))))
                at += texts[-1][2]
        queue, begin, size = (np.array([t[i] for t in texts], np.int64) for i in range(3))
        held = {}
        for text, start, length, r, offset in zip(*schedule.pieces(queue, begin, size), strict=True):
            for k in range(length):
                assert (r, offset + k) not in held
                held[r, offset + k] = (texts[text][0], texts[text][1] + start + k)
        assert sorted(held.values()) == sorted((q, x) for q, t in enumerate(totals) for x in range(t))
        sizes = Counter(r for r, _ in held)
        assert all((r, k) in held for r, n in sizes.items() for k in range(n))
        assert all(n == row or n & (n - 1) == 0 for n in sizes.values()) and sum(n < row for n in sizes.values()) <= 11
        order = walked(schedule, totals)
        for w in range(len(order) // schedule.per):
            here = {(q, x // grain) for (r, _), (q, x) in held.items() if r == w}
            assert here == {(q, j) for _, q, j in order[w * schedule.per : (w + 1) * schedule.per]}


def test_shares_of_windows_stay_at_their_targets():
    totals, shares = [400_000, 100_000, 30_000, 4_000], [0.5, 0.25, 0.2, 0.05]
    schedule = mixture.Schedule(totals, shares, 2048, 128)
    had = schedule.before_window(np.arange(1, 38))
    for w, grains in enumerate(had, 1):  # before the smallest queues run dry
        assert all(abs(g - w * 16 * s) <= len(totals) for g, s in zip(grains, shares, strict=True))
    assert schedule.before_window(np.array([10**6])).tolist() == [[t // 128 for t in totals]]


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made


def test_packed_ids_are_those_of_the_library(spark, library):
    table = [r for r in odd_rows() if r[0] is not None]
    table = [(k, *r[1:]) for k, r in enumerate(table)]
    table += [(100 + k, prose(k, 300 + 40 * k), "en", ["a", "b", None, "c"][k % 4], 1) for k in range(40)]
    table.append((500, "<|endoftext|> it's  \r\n\t tail ", "en", "a", 1))
    docs = spark.createDataFrame(table, SCHEMA).repartition(6)
    for targets, queues in ((None, 256), ({"a": 0.7, "b": 0.1}, 256), (None, 3)):
        made = mixture.pack(clashing(docs), tokenizers.path("byte_bpe_50k.json"), tokenizers.PATTERN, targets, queues=queues)
        pieces = mixture.digests(made).toPandas()
        ids = {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in table}
        for p in pieces.itertuples():
            part = np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()
            assert zlib.crc32(part) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
        for doc, own in pieces.sort_values("start").groupby("doc_id"):
            assert own["start"].tolist() == [0, *own["length"].cumsum().tolist()][:-1] and own["length"].sum() == len(ids[doc])
        assert set(pieces["doc_id"]) == set(ids)
        for _, own in pieces.sort_values("offset").groupby("sequence_id"):
            ends = own["length"].cumsum().tolist()
            assert own["offset"].tolist() == [0, *ends][:-1] and (ends[-1] & (ends[-1] - 1) == 0) and ends[-1] <= 2048
        filled = mixture.sequences(made).collect()
        assert all(len(r["ids"]) == 4 * r["n"] == 4 * r["cu_seqlens"][-1] for r in filled)
        assert sum(r["n"] for r in filled) == sum(map(len, ids.values()))
        shares = mixture.shares_by_window(made).groupBy("sequence_id").agg(F.sum("share").alias("s")).collect()
        assert all(abs(r["s"] - 1) < 1e-9 for r in shares)


def test_packing_of_null_ids_and_empty_tables(spark):
    args = (tokenizers.path("byte_bpe_50k.json"), tokenizers.PATTERN)
    assert mixture.pack(empty(spark), *args).count() == 0
    got = mixture.pack(odd(spark), *args)
    assert got.where("doc_id IS NULL").count() >= 2
    assert got.agg(F.sum("length")).first()[0] == got.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    with pytest.raises(ValueError):
        mixture.Schedule([1], [1.0], 100, 33)

"""Operators that handle each text on its own, against plain Python."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from fixtures import clashing, empty, odd, odd_labels, odd_rows, prose, rows

from themescope.llm import bpe, decontam, langid, license, packing, quality, rules, toxicity

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def encoder():
    return bpe.load(PATH, PATTERN)


# --- byte-level BPE -----------------------------------------------------


def test_perfect_hash_has_a_slot_for_each_key(encoder):
    assert sorted(encoder.whole.slots) == list(range(len(encoder.tokens)))
    assert all(encoder.whole.find(t) == i for i, t in enumerate(encoder.tokens))
    assert bpe.PerfectHash([b"a"]).find(b"zzz") == 0


def test_bpe_equals_the_library_and_round_trips(spark, encoder):
    import tiktoken

    library = tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(encoder.tokens)}, special_tokens={})
    want = []
    for doc_id, text, *_ in odd_rows():
        ids = library.encode_ordinary(text or "")
        sha = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append((hashlib.sha256((text or "").encode()).hexdigest(), doc_id, sha, len(ids)))
    got = bpe.digests(clashing(odd(spark)), PATH, PATTERN)
    assert rows(got) == sorted(want, key=repr)
    ids = bpe.encode(odd(spark), PATH, PATTERN)
    assert all(encoder.decode(r["ids"]).decode() == (r["text"] or "") for r in ids.collect())
    assert bpe.digests(empty(spark), PATH, PATTERN).count() == 0


def test_bytes_that_are_not_utf8_are_replaced(spark, encoder):
    docs = spark.sql("SELECT 1 AS doc_id, CAST(unhex('61FF62E282') AS STRING) AS text")
    (row,) = bpe.encode(docs, PATH, PATTERN).collect()
    assert encoder.decode(row["ids"]) == b"a\xff\b".replace(b"\xff\b", "\ufffdb\ufffd".encode())
    assert bpe.digests(docs, PATH, PATTERN).first()["n_tokens"] == len(row["ids"])


def test_long_pieces_merge_like_the_library(encoder):
    import tiktoken

    library = tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(encoder.tokens)}, special_tokens={})
    for text in ("z" * 5000, "ab" * 3000, "\x00" * 50, "<|endoftext|>", "   x  \n\n y", "½²ⅷ'S 's"):
        assert encoder.encode(text) == library.encode_ordinary(text)


# --- packing ------------------------------------------------------------


def test_packing_loses_nothing(spark, encoder):
    docs = odd(spark)
    for row, buffer in ((64, 500), (2048, 10_000_000)):
        back = collections.defaultdict(list)
        for r in packing.pack(clashing(docs), PATH, PATTERN, row, buffer).collect():
            ids = np.frombuffer(r["ids"], "<u2")
            assert len(ids) == row and r["n_tokens"] == r["cu_seqlens"][-1] <= row
            assert (ids[r["n_tokens"] :] == len(encoder.tokens)).all()  # no token has this id
            assert r["resets"][: len(r["doc_ids"])] == r["cu_seqlens"][:-1]
            for d, s, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
                back[d].append((s, ids[a:b].tolist()))
        texts = collections.defaultdict(list)
        for d, t, *_ in odd_rows():
            texts[d].append(t or "")
        for d, ts in texts.items():
            total = sum(len(x) for _, x in back[d])
            assert total == sum(len(encoder.encode(t)) for t in ts)
            if len(ts) == 1:
                assert encoder.decode(sum((x for _, x in sorted(back[d])), [])).decode() == ts[0]
    assert packing.pack(empty(spark), PATH, PATTERN).count() == 0


def test_packing_with_a_wide_vocabulary(spark, tmp_path):
    """More tokens than 16 bits tell apart; the written table holds the same rows."""
    import base64

    tokens = [bytes([b]) for b in range(256)] + [bytes([97 + a % 26, 97 + a // 26 % 26, 97 + a // 676 % 26, 65 + a // 17576]) for a in range(70_000)]
    tokens = list(dict.fromkeys(tokens))
    with open(tmp_path / "wide.tiktoken", "wb") as out:
        out.writelines(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens))
    word = tokens[69_000].decode()
    docs = spark.createDataFrame([(1, word), (2, "ab")], "doc_id bigint, text string").coalesce(1)
    packed = packing.pack(docs, str(tmp_path / "wide.tiktoken"), "(?s:.)", 8)
    packing.write_packed(packed, str(tmp_path / "packed"))
    (row,) = spark.read.parquet(str(tmp_path / "packed")).collect()
    ids = np.frombuffer(row["ids"], "<u4")
    assert len(ids) == 8 and (ids[row["n_tokens"] :] == len(tokens)).all() and row == packed.first()
    assert bytes(ids[: row["n_tokens"]].tolist()) in (word.encode() + b"ab", b"ab" + word.encode())


def test_best_fit_equals_a_linear_scan():
    draw = np.random.default_rng(8)
    for _ in range(40):
        sizes = draw.integers(1, 33, int(draw.integers(0, 60))).tolist()
        free, want = [], []
        for piece in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [r for r, space in enumerate(free) if space >= sizes[piece]]
            if not fits:
                free.append(32)
                want.append([])
                fits = [len(free) - 1]
            least = min(free[r] for r in fits)
            at = max(r for r in fits if free[r] == least)
            free[at] -= sizes[piece]
            want[at].append(piece)
        got = packing.best_fit(sizes, 32)
        # rows of equal space may be taken in another order; fill is the same
        assert sorted(sum(sizes[i] for i in b) for b in got) == sorted(sum(sizes[i] for i in b) for b in want)


def test_best_fit_takes_the_tightest_row():
    assert packing.best_fit([5, 7, 3, 2, 3], 10) == [[1, 2], [0, 4, 3]]
    draw = np.random.default_rng(3)
    sizes = draw.integers(1, 101, 3000).tolist()
    bins = packing.best_fit(sizes, 100)
    assert sorted(sum(bins, [])) == list(range(3000))
    assert max(sum(sizes[i] for i in b) for b in bins) <= 100
    assert len(bins) <= sum(sizes) / 100 * 1.03 + 1


# --- licences -----------------------------------------------------------


def test_base_phrases_match_a_plain_scan(spark):
    made = [
        (100, "All Rights  Reserved. all rights reserved; ALL-RIGHTS-RESERVED rights reserved"),
        (101, "cc by CC-BY-NC 4.0 licensed under cc by-nc 4.0."),
        (102, "This work is licensed under the GNU General Public License, version 3."),
        (103, "general public general public license"), (104, "all rights café reserved"),
    ]
    docs = odd(spark).unionByName(spark.createDataFrame([(i, t, None, None, 0) for i, t in made], odd(spark).schema))
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(r["text"] or "")
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for r in license.scan(clashing(docs)).collect():
        x = texts[r["doc_id"]][0]
        ws = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in x))
        found = [(i, label) for phrase, label in license.BASE.items() for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in found]
        assert (r["n_words"], r["n_base"]) == (len(ws), len(at))
        assert (r["first_word"], r["last_word"]) == ((min(at), max(at)) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in found}))
        assert 0 <= r["score"] <= 1
    labels = {r["doc_id"]: r["labels"] for r in license.scan(docs).collect()}
    assert labels[101] == "cc-by,cc-by-nc" and labels[102] == "gpl,gpl-3" and labels[103] == "gpl" and labels[104] == ""
    assert license.scan(empty(spark)).count() == 0


def test_templates_tolerate_edits_but_need_their_key_phrases(spark):
    mit = license.TEMPLATES[2].text
    edited = mit.replace("documentation", "docs").replace("deal", "work")
    broken = mit.replace("granted", "refused")
    docs = spark.createDataFrame([(1, prose(9, 50) + " " + edited), (2, broken), (3, prose(8, 60))], "doc_id bigint, text string")
    got = {r["doc_id"]: r["labels"] for r in license.scan(docs).collect()}
    assert got == {1: "mit", 2: "", 3: ""}


def test_whole_licences_with_edits_are_told_apart(spark):
    draw = random.Random(17)
    cases = []
    for k, t in enumerate(license.TEMPLATES):
        ws = license.words(t.text.encode())
        if len(ws) < 40:
            continue
        keyed = {w for key in t.keys for w in license.words(key.encode())}
        out = []
        for w in ws:
            out += [w] if w in keyed or draw.random() > 0.06 else draw.choice([[], [b"other"], [w, b"added"]])
        cases.append((k, t.label, prose(k, 40) + " " + b" ".join(out).decode() + " " + prose(100 + k, 40)))
    docs = spark.createDataFrame([(k, text) for k, _, text in cases], "doc_id bigint, text string")
    got = {r["doc_id"]: r["labels"].split(",") for r in license.scan(docs).collect()}
    assert len(cases) >= 12
    for k, label, _ in cases:
        assert label in got[k], (label, got[k])
        others = {"gpl-2", "gpl-3", "lgpl-2.1", "lgpl-3", "agpl-3", "isc", "zlib", "boost", "apache", "unlicense"} - {label}
        assert not others & set(got[k])


# --- language -----------------------------------------------------------


def test_automaton_holds_all_substrings():
    text = [0, 1, 0, 0, 1, 2, 1, 0, 1]
    a = langid.Automaton(text)

    def holds(x):
        s = 0
        for c in x:
            if c not in a.next[s]:
                return False
            s = a.next[s][c]
        return True

    parts = {tuple(text[i:j]) for i in range(9) for j in range(i + 1, 10)}
    assert all(map(holds, parts))
    draw = np.random.default_rng(1)
    for _ in range(300):
        x = tuple(draw.integers(0, 3, draw.integers(1, 6)).tolist())
        assert holds(x) == (x in parts)


def test_phrases_equal_a_plain_greedy_parse():
    models = langid.Models({"a": ["the cat sat on the mat"], "b": ["der hund und die katze"]})
    for text in ("the cat", "zzz the", "die katze und the mat", "q", "mat the sat " * 40):
        got = models.costs([models.symbols(text)])[0]
        for k, name in enumerate(models.names):
            base = {"a": "the cat sat on the mat", "b": "der hund und die katze"}[name]
            # letters without a symbol match nothing
            shown = "".join(c if c == " " or c in "".join(("the cat sat on the mat", "der hund und die katze")) else "?" for c in text)
            phrases = i = 0
            while i < len(shown):
                n = 1
                while i + n <= len(shown) and shown[i : i + n] in base:
                    n += 1
                i += max(1, n - 1)
                phrases += 1
            assert abs(got[k] * len(shown) / models.bits[k] - phrases) <= 1 + len(shown) // langid.BLOCK


def test_language_of_odd_rows(spark):
    got = langid.predict(clashing(odd(spark)))
    assert got.count() == len(odd_rows())
    for r in got.collect():
        assert r["lang_pred"] in ("en", "de", "und") and 0 <= r["score"] <= 1
    und = {r["doc_id"] for r in got.where("lang_pred = 'und'").collect()}
    assert und == {1, 2, 3, 10}
    assert langid.predict(empty(spark)).count() == 0
    unlabelled = odd(spark).selectExpr("doc_id", "text", "cast(null AS string) AS lang")
    assert {r["lang_pred"] for r in langid.predict(unlabelled).collect()} == {"und"}


def test_language_is_learned_from_whole_texts(spark, monkeypatch):
    head = prose(50, 200)  # the same long opening in both languages
    words = {"aa": ["lomi", "tareku", "nusa", "vilo", "perata"], "bb": ["schrift", "gwynth", "krolz", "dwerg", "fjord"]}
    bodies = {n: [" ".join(random.Random(k).choices(w, k=300)) for k in range(12)] for n, w in words.items()}
    data = [(10 * k + i, f"{head} {b}", n) for i, n in enumerate(words) for k, b in enumerate(bodies[n])]
    asked = [(1000 + i, bodies[n][0], None) for i, n in enumerate(words)]
    docs = spark.createDataFrame(data + asked, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs).collect()}
    assert got[1000] == "aa" and got[1001] == "bb"
    known = {t.lower() for _, t, _ in data}
    assert all(t in known for texts in langid.samples(docs).values() for t in texts)
    # beyond the bound, windows from all over the texts
    monkeypatch.setattr(langid, "WINDOW", 40)
    some = langid.samples(docs, sample_symbols=12_000)
    assert all(8_000 < sum(map(len, texts)) < 16_000 for texts in some.values())
    text = "".join(chr(0x4E00 + k) for k in range(8000))
    places = [ord(c) - 0x4E00 for c in langid.spread(text, 5, 0.3) if c != " "]
    assert places == sorted(set(places)) and all(sum(p // 1000 == k for p in places) > 100 for k in range(8))


def test_every_script_has_symbols_of_its_own(spark):
    """Thousands of letters a language, evenly used, beside a language of Latin letters."""
    draw = random.Random(12)
    letters = {"zh": [chr(0x4E00 + k) for k in range(3000)], "ko": [chr(0xAC00 + k) for k in range(3000)]}

    def text(lang):
        if lang == "en":
            return prose(draw.randint(0, 10**6), 120)
        return " ".join("".join(draw.choices(letters[lang], k=draw.randint(1, 6))) for _ in range(120))

    data = [(k, text(lang), lang) for k, lang in enumerate(["en", "zh", "ko"] * 40)]
    asked = [(1000 + k, text(lang), None) for k, lang in enumerate(["en", "zh", "ko"] * 10)]
    docs = spark.createDataFrame(data + asked, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs).collect()}
    assert [got[1000 + k] for k in range(30)] == ["en", "zh", "ko"] * 10


# --- rules --------------------------------------------------------------


def test_signals_equal_plain_counts(spark):
    want = []
    word = re.compile("[^\x20\x09-\x0d]+")
    for doc_id, text, *_ in odd_rows():
        text = text or ""
        ws = word.findall(text)
        windows = collections.Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
        covered = {i + k for i in range(len(ws) - 4) if windows[tuple(ws[i : i + 5])] > 1 for k in range(5)}
        seen, repeats = set(), 0
        for line in text.split("\n"):
            if word.search(line):
                repeats += line in seen
                seen.add(line)
        failed = len(ws) < 10 or 100 * len(covered) > 20 * len(ws)
        want.append((failed, doc_id, repeats, len(covered), sum(text.count(c) for c in "#*$%&|<>"), len(ws), sum(map(len, ws))))
    got = rules.judge(clashing(odd(spark)).drop("kept", "n_words"), odd_labels(spark))
    columns = ["base_failed", "doc_id", "n_dup_lines", "n_repeat_words", "n_symbols", "n_words", "word_chars"]
    assert rows(got.select(*columns)) == sorted(want, key=repr)
    assert got.where("base_failed AND kept").count() == 0
    assert rules.judge(empty(spark), odd_labels(spark)).count() == 0
    assert rules.judge(odd(spark), odd_labels(spark).where("false")).where("NOT base_failed AND NOT kept").count() == 0


def test_binomial_tail_is_exact_and_never_too_low(spark):
    from math import comb

    from pyspark.sql import functions as F

    cases = [(0, 100), (3, 1000), (10, 5000), (0, 1), (5, 5)]
    df = spark.createDataFrame(cases, "x bigint, n bigint")
    for r in df.select("x", "n", rules.binomial_tail(F.col("x"), F.col("n"), 0.01).alias("p")).collect():
        exact = sum(comb(r["n"], i) * 0.01**i * 0.99 ** (r["n"] - i) for i in range(r["x"] + 1))
        assert r["p"] == pytest.approx(1.0 if r["x"] >= r["n"] * 0.01 else exact, rel=1e-9)
    big = spark.createDataFrame([(9_000_000, 1_000_000_000), (9_990_000, 1_000_000_000)], "x bigint, n bigint")
    low, near = [r["p"] for r in big.select(rules.binomial_tail(F.col("x"), F.col("n"), 0.01).alias("p")).collect()]
    assert low < 1e-100 and 2e-4 < near <= 1


def test_thresholds_keep_the_promised_share_of_good_texts(spark):
    docs = spark.range(4000).selectExpr(
        "id AS doc_id", "'en' AS lang",
        "repeat(concat('word', id % 9, ' plain text here. '), 3) || CASE WHEN id % 10 = 0 THEN repeat('# ', 30) ELSE '' END AS text",
    )
    labels = docs.selectExpr("doc_id", "CASE WHEN doc_id % 10 = 0 THEN 0 ELSE 1 END AS quality")
    found = rules.cutoffs(rules.signals(docs), labels)
    assert found.where("rule = 'symbol_share'").count() == 1
    kept = rules.signals(docs).join(found.where("rule = 'symbol_share'"))
    assert kept.where("symbol_share > cutoff AND doc_id % 10 <> 0").count() <= 4000 * rules.ALPHA
    assert kept.where("symbol_share > cutoff AND doc_id % 10 = 0").count() == 400


def plain_cutoffs(table, good):
    """The certified cutoffs of rows (doc_id, stratum, signals) by a walk over the steps."""
    import hashlib
    from math import comb

    tables = {}
    for doc_id, stratum, values in table:
        if doc_id in good:
            picks = int(hashlib.md5(str(doc_id).encode()).hexdigest()[:8], 16) % 3 == 0
            tables.setdefault(stratum, ([], []))[not picks].append(values)
    usable = {s: t for s, t in tables.items() if t[0] and t[1]}
    out = {}
    for stratum, (picking, testing) in usable.items():
        worth = {}
        for r, cuts in rules.RULES.items():
            lax_first = sorted(cuts, reverse=True)
            fine = [k for k, c in enumerate(lax_first) if sum(v[r] > c for v in picking) <= rules.ALPHA / len(rules.RULES) * len(picking)]
            if fine:
                worth[r] = lax_first[: max(fine) + 1]
        best = None
        for step in range(max(map(len, rules.RULES.values()))):
            now = {r: cuts[min(step, len(cuts) - 1)] for r, cuts in worth.items()}
            n, x = len(testing), sum(any(v[r] > c for r, c in now.items()) for v in testing)
            p = sum(comb(n, i) * rules.ALPHA**i * (1 - rules.ALPHA) ** (n - i) for i in range(x + 1))
            if x >= n * rules.ALPHA or p > rules.DELTA / len(usable):
                break
            best = now
        out |= {(stratum, r): c for r, c in (best or {}).items()}
    return out


def drawn_signals(draw, lang, many, first):
    """Good texts: mostly low signals, now and then a high one; languages differ."""
    shift = {"en": 0.0, "de": 1.5, "fr": 0.5, "": 0.2}[lang]
    rows = []
    for k in range(many):
        odd = draw.random() < 0.004
        values = {
            "symbol_share": draw.choice([0.0, 0.0, 0.004]) + 0.3 * odd, "repeat_share": draw.uniform(0, 0.04),
            "dup_line_share": draw.choice([0.0] * 40 + [0.12]), "capital_share": draw.uniform(0.01, 0.07),
            "word_length": draw.gauss(5 + shift, 0.6), "word_shortness": -draw.gauss(5 + shift, 0.6),
        }
        rows.append((first + k, lang, values))
    return rows


def test_cutoffs_are_certified_in_strata_of_a_few_hundred(spark):
    draw = random.Random(21)
    table = [r for k, lang in enumerate(["en", "de", "fr", ""]) for r in drawn_signals(draw, lang, 420, 1000 * k)]
    table += [(9000 + k, "xx", table[0][2]) for k in range(40)]  # too few to certify
    frame = spark.createDataFrame([(i, s or None, *v.values()) for i, s, v in table], f"doc_id bigint, lang string, {', '.join(f'{r} double' for r in rules.RULES)}")
    labels = frame.selectExpr("doc_id", "CASE WHEN doc_id % 50 = 7 THEN 0 ELSE 1 END AS quality")
    got = {(r["stratum"], r["rule"]): r["cutoff"] for r in rules.cutoffs(frame, labels).collect()}
    assert got == plain_cutoffs(table, {r[0] for r in table if r[0] % 50 != 7})
    assert {s for s, _ in got} == {"en", "de", "fr", ""} and len(got) >= 16
    # new good texts of the same kind: no stratum loses more than promised
    for lang in ("en", "de", "fr", ""):
        fresh = drawn_signals(draw, lang, 20_000, 0)
        lost = sum(any(v[r] > got.get((lang, r), float("inf")) for r in v) for _, _, v in fresh)
        assert lost <= 20_000 * rules.ALPHA


# --- classifiers --------------------------------------------------------


def labelled(spark):
    data = []
    for i in range(600):
        bad = i % 3 == 0
        text = prose(i, 40) + (" vile nasty words" if bad else "")
        data.append((i, text, 0 if bad else 1, 1 if bad else 0))
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in data], "doc_id bigint, text string")
    return docs, spark.createDataFrame([(i, q, t) for i, _, q, t in data], "doc_id bigint, quality int, toxic int")


def test_toxicity_learns_and_ignores_identity_terms(spark):
    docs, labels = labelled(spark)
    got = toxicity.predict(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) / len(got) > 0.97


def test_swaps_are_made_sentence_by_sentence():
    swaps = toxicity._swaps()
    text = "She was here. Nothing else!\nDie Frau und der Mann. Él y las mujeres".encode()
    made = toxicity.counterfactuals(text, swaps)
    assert ({b"she", b"was", b"here"}, {b"he", b"was", b"here"}) in made
    assert any("mann".encode() in b and "frau".encode() not in b for a, b in made if "frau".encode() in a)
    spanish = [b for a, b in made if "mujeres".encode() in a]
    assert any("hombres".encode() in b for b in spanish)
    assert not any(b"nothing" in a for a, _ in made) and toxicity.counterfactuals(b"", swaps) == []


def test_the_penalty_spares_neutral_mentions():
    """Terms that only happen to stand in toxic texts, in four languages: held-out neutral texts with them."""
    draw = random.Random(5)
    terms = ("women", "frauen", "femmes", "mujeres")

    def text(toxic, term):
        ws = [f"w{draw.randint(0, 60)}" for _ in range(12)] + ["scum" if toxic and draw.random() < 0.5 else "nice"]
        return " ".join(ws) + f". The {term} went home"

    data = [(text(i % 2, terms[i % 8 // 2] if i % 2 or draw.random() < 0.1 else f"w{draw.randint(0, 60)}"), i % 2) for i in range(600)]
    swaps = toxicity._swaps()
    raw = [t.encode() for t, _ in data]
    found = [toxicity.counterfactuals(x, swaps) for x in raw]
    pairs = toxicity.Pairs(
        np.array([i for i, f in enumerate(found) for _ in f], np.int64),
        [toxicity.features(a) for f in found for a, _ in f], [toxicity.features(b) for f in found for _, b in f],
    )
    plain = [toxicity.features(set(license.words(x))) for x in raw]
    label, weight = np.array([y for _, y in data], float), np.ones(len(data))
    neutral = [set(license.words(text(False, term).encode())) for term in terms for _ in range(50)]
    free, held = (toxicity.fit(plain, pairs, label, weight, penalty=k) for k in (0.0, 50.0))
    wrong = [sum(m.score(x, {}) >= 0.5 for x in neutral) for m in (free, held)]
    assert wrong[1] < 0.5 * wrong[0]


def test_classifiers_on_odd_and_empty_input(spark):
    for predict in (toxicity.predict, quality.predict):
        got = predict(clashing(odd(spark)), odd_labels(spark))
        assert got.count() == len(odd_rows())
        assert got.where("score IS NULL OR score < 0 OR score > 1 OR predicted IS NULL").count() == 0
        assert predict(empty(spark), odd_labels(spark)).count() == 0
        none = predict(odd(spark), odd_labels(spark).where("false"))
        assert none.where("score < 0 OR score > 1").count() == 0
    kept = toxicity.drop_toxic(odd(spark), odd_labels(spark).where("false"))
    assert rows(kept) == rows(odd(spark))


def test_quality_learns_from_statistics(spark):
    docs, labels = labelled(spark)
    shouted = docs.selectExpr("doc_id", "CASE WHEN doc_id % 3 = 0 THEN upper(text) || ' !!! ###' ELSE text END AS text")
    got = quality.predict(shouted, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.97
    assert quality.isotonic(np.array([0.1, 0.5, 0.3, 0.9]), np.ones(4)).tolist() == [0.1, 0.4, 0.4, 0.9]


# --- decontamination ----------------------------------------------------


def edit_distance_in(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_matches_equal_a_full_edit_distance(spark):
    draw = np.random.default_rng(5)
    items = [prose(50 + i, 15) for i in range(12)] + ["short", "", None, prose(50, 15)]
    data = []
    for i in range(60):
        x = items[i % 12]
        for _ in range(draw.integers(0, 16)):
            k = int(draw.integers(0, len(x)))
            x = [x[:k] + x[k + 1 :], x[:k] + "q" + x[k:], x[:k] + "q" + x[k + 1 :]][int(draw.integers(0, 3))]
        data.append((i, prose(200 + i, 20) + " " + x + "\n" + prose(300 + i, 20)))
    data += [(97, None), (98, ""), (99, "so SHORT it is"), (None, items[3].upper())]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontam.matches(clashing(docs), bench).collect()}
    want = {}
    for d, t in data:
        for k, x in enumerate(items):
            if t and x:
                item = decontam.normal(x)
                n = edit_distance_in(item, decontam.normal(t))
                if n <= (decontam.budget(len(item)) if len(item) >= decontam.Q else 0):
                    want[d, k] = n
    assert got == want
    kept = {r["doc_id"] for r in decontam.drop_contaminated(docs, bench).collect()}
    assert kept == {d for d, _ in data} - {d for d, _ in want}
    assert decontam.matches(docs, bench.where("false")).count() == 0
    assert decontam.matches(empty(spark), bench).count() == 0
    assert rows(decontam.drop_contaminated(odd(spark), bench.where("item_id = 1"))) == rows(odd(spark))


def test_every_place_of_an_item_and_each_of_equal_items(spark, monkeypatch):
    one, other = prose(60, 15), prose(61, 15)
    near = one.replace("a", "e", 2)
    text = f"{prose(7, 10)} {one} {prose(8, 30)} {near} {other} {prose(9, 5)} {one}"
    docs = spark.createDataFrame([(1, text), (2, prose(3, 40)), (3, "xy  XY")], "doc_id bigint, text string")
    # one item text holds most of the benchmark, in different spellings
    items = [(k, one.upper() if k % 2 else f" {one}\n") for k in range(40)] + [(90, other), (91, "xy"), (92, None), (93, " ")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    plain = decontam.normal(text)
    first, last = plain.find(decontam.normal(one)), plain.rfind(decontam.normal(one))
    for pairs in (2_000_000, 3):
        monkeypatch.setattr(decontam, "PAIRS", pairs)
        got = rows(decontam.matches(docs, bench).select("doc_id", "item_id", "start", "edits"))
        mine = sorted((r[3], r[1]) for r in got if r[2] == 5 and r[0] == 1)
        assert len(mine) == 3 and mine[0] == (first, 0) and mine[2] == (last, 0) and 0 < mine[1][1] <= 2
        assert {r[2] for r in got if r[0] == 1} == {*range(40), 90} and len(got) == 40 * 3 + 1 + 2
        assert [(r[3], r[1]) for r in got if r[0] == 3] == [(0, 0), (3, 0)]


def test_groups_of_items_give_the_same_matches(spark, monkeypatch):
    items = [(i, prose(50 + i, 15)) for i in range(9)]
    docs = spark.createDataFrame([(i, prose(7, 10) + " " + t) for i, t in items], "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    whole = rows(decontam.matches(docs, bench))
    monkeypatch.setattr(decontam, "GROUP_CHARS", 300)
    assert rows(decontam.matches(docs, bench)) == whole and len(whole) == 9


def test_alignment_of_edited_items_against_a_plain_table():
    import random

    from themescope.llm import decontam

    def plain(item, text, k):
        """Least edits of the item against any part of the text, where they are k at most."""
        row = [0] * (len(text) + 1)
        for i, a in enumerate(item, 1):
            new = [i]
            for j, b in enumerate(text, 1):
                new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
            row = new
        return min(row) if min(row) <= k else None

    draw = random.Random(2)
    for _ in range(400):
        item = "".join(draw.choices("abcd", k=draw.randint(3, 30)))
        text = list(item)
        for _ in range(draw.randint(0, 4)):
            at = draw.randrange(len(text))
            text[at : at + draw.randint(0, 1)] = draw.choices("abcd", k=draw.randint(0, 2))
        text = "".join([*draw.choices("abcd", k=draw.randint(0, 5)), *text, *draw.choices("abcd", k=draw.randint(0, 5))])
        k = len(item) // 3
        got = decontam.align(decontam._codes(item), decontam._codes(text), k)
        assert (got[0] if got else None) == plain(item, text, k)

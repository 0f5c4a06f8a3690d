"""Corpus operators against plain Python, with edge cases."""

from __future__ import annotations

import math
import random
import time
import unicodedata
from collections import Counter, defaultdict
from datetime import datetime
from pathlib import Path

import pytest
import regex
from pyspark.sql import functions as F

pytest.importorskip("litweave.llm")

from heldout import FRESH, HELD_OUT, PAIRS  # noqa: E402

from litweave.llm import bpe, ledger, mixing, pii, terms, together  # noqa: E402

# copies


def canon(s):
    return "".join(c for c in s.upper().lower() if unicodedata.category(c)[0] in "LN")


PAPERS = [
    (5, "10.1/A-b", "On X", 2), (9, "10.1 / a_B", "ON—x!", 1), (2, "on x", "<10.1/ab>", 3), (7, "10.1/ab", "On XY", 1), (8, None, "On X", 1), (10, "10.1/ab", None, 1),
    (11, "...", "On X", 1), (12, "N.A.", "On X", 1), (13, "na", "NA", 1), (14, "Straße", "Σίγμας", 1), (15, "STRASSE", "ΣΊΓΜΑΣ", 4), (16, "ab", "c", 1), (17, "a", "bc", 1),
    (18, "x" * 200000, "y", 1), (19, "X" * 200000, "Y.", None), (5, "10.1/A-b", "On X", 2), (20, "q", "q", 1), (21, "Q", "q.", 2),
]


def paper_table(spark, rows=PAPERS):
    return spark.createDataFrame([(i, d, t, None if k is None else datetime(2020, k, 1), "clash") for i, d, t, k in rows], "paper_id long, doi string, title string, loaded_at timestamp, key string")


def test_copies(spark):
    led, keyed = ledger.collapse_copies(paper_table(spark), "paper_id", ("doi", "title"), "loaded_at", batches=4, bucket_rows=1)
    groups = defaultdict(list)
    for i, d, t, _ in PAPERS:
        if d is not None and t is not None and canon(d) not in ("", "na") and canon(t) not in ("", "na"):
            groups[tuple(sorted((canon(d), canon(t))))].append(i)
    assert sorted((r.first_id, r.n_copies) for r in led.collect()) == sorted((min(g), len(g)) for g in groups.values())
    came = {i: (k is not None, k or 0, i) for i, _, _, k in PAPERS}
    assert sorted(r.earliest_id for r in led.collect()) == sorted(min(g, key=came.get) for g in groups.values())
    assert set(map(tuple, ledger.copies(led, keyed).collect())) == {(min(g), i) for g in groups.values() for i in g if i != min(g)}


def test_ledger_continues(spark, tmp_path):
    path = "file://" + str(tmp_path / "led")
    rows = lambda *x: spark.createDataFrame([(bytearray(k.encode()), i, t) for k, i, t in x], "key binary, id long, at long")
    state = lambda led: {bytes(r.key): (r.n_copies, r.first_id, r.earliest_id) for r in led.read().collect()}
    ledger.DuplicateLedger(spark, path, 4).merge(rows(("a", 5, 10), ("a", 7, 3), ("b", 2, 1)))
    again = ledger.DuplicateLedger(spark, path)
    before = again.read()
    again.merge(rows(("a", 3, 9), ("c", 1, None)))
    again.merge(rows())
    want = {b"a": (3, 3, 7), b"b": (1, 2, 2), b"c": (1, 1, 1)}
    assert state(ledger.DuplicateLedger(spark, path)) == want
    assert {bytes(r.key) for r in before.collect()} == {b"a", b"b"}  # a reader under way still has its files
    # a merge that broke off before or after its manifest changes nothing
    (tmp_path / "led" / "writing-000000000009").write_text("{")
    (tmp_path / "led" / "manifest-000000000008.json").write_text("{")
    led = ledger.DuplicateLedger(spark, path)
    assert state(led) == want and led.generation == 2
    (tmp_path / "led" / "manifest-000000000008.json").unlink()
    led.split()
    led.merge(rows(("a", 1, None), ("d", 4, 4)))
    again = ledger.DuplicateLedger(spark, path)
    assert again.buckets == 8 and state(again) == {b"a": (4, 1, 1), b"b": (1, 2, 2), b"c": (1, 1, 1), b"d": (1, 4, 4)}


def test_ledger_splits_full_buckets(spark, tmp_path):
    led = ledger.DuplicateLedger(spark, "file://" + str(tmp_path / "led"), 2, bucket_rows=10)
    led.merge(spark.range(100).select(F.col("id").cast("string").cast("binary").alias("key"), "id", F.lit(1).cast("long").alias("at")))
    assert led.buckets == 4 and led.read().count() == 100


def test_hot_group_of_copies(spark):
    rows = spark.range(30_000).select(F.col("id").alias("paper_id"), F.when(F.col("id") % 3 == 0, "10.1/hot").otherwise(F.concat(F.lit("10."), "id")).alias("doi"), F.lit("t").alias("title"), F.lit(None).cast("timestamp").alias("loaded_at"))
    led, keyed = ledger.collapse_copies(rows, "paper_id", ("doi", "title"), "loaded_at")
    found = ledger.copies(led, keyed)
    assert found.count() == 9_999 and found.select("first_id").distinct().count() == 1
    assert ledger.copies(*ledger.collapse_copies(rows.limit(0), "paper_id", ("doi", "title"), "loaded_at")).count() == 0


# terms


def test_terms(spark, monkeypatch):
    texts = [("The the THE", "cat"), (None, "the dog-cat x2y"), ("", None), (None, None), ("İstanbul ΟΔΟΣ", "naïve é"), ("the " * 30000, "w" * 100000), ("cat", "cat"), ("cat", "cat")]
    df = spark.createDataFrame([(t, a, "clash") for t, a in texts], "title string, abstract string, term string")
    n_terms, n_docs = Counter(), Counter()
    for row in texts:
        found = [w for s in row if s for w in regex.findall(r"\p{L}+", s.lower())]
        n_terms.update(found)
        n_docs.update(set(found))
    want = {t: (n_terms[t], n_docs[t]) for t in n_terms}
    for heavy in (512, 2):  # the route of a term does not change its counts
        monkeypatch.setattr(terms, "HEAVY", heavy)
        got = terms.term_counts(df.repartition(3), "title", "abstract")
        assert {r.term: (r.n_terms, r.n_docs) for r in got.collect()} == want
    marks = {r.term: r.mark for r in terms.mark_terms(got, len(texts)).collect()}
    assert marks["the"] == "common" and marks["dog"] == "rare" and marks["cat"] == "common"
    assert terms.term_counts(df.limit(0), "title", "abstract").count() == 0


# pairs


def test_pairs(spark):
    r = random.Random(1)
    rows = [(r.randrange(-20, 40), r.randrange(60)) for _ in range(1500)] + [(i, 999) for i in range(300)] + [(1, 999)] * 50 + [(None, 1), (1, None), (5, 1000), (2**62, 1), (-(2**62), 1)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "i long, b long, item string")
    baskets = defaultdict(set)
    for i, b in rows:
        if i is not None and b is not None:
            baskets[b].add(i)
    n, pairs = Counter(i for s in baskets.values() for i in s), Counter((x, y) for s in baskets.values() for x in s for y in s if x < y)
    for chunk in (16, 64, 1000):  # huge baskets in blocks give the same pairs
        got = {(x.a, x.b): x for x in together.associations(df, "i", "b", chunk=chunk).collect()}
        assert {k: x.n_together for k, x in got.items()} == pairs
    for (a, b), x in got.items():
        assert (x.n_a, x.n_b, x.n_baskets) == (n[a], n[b], len(baskets))
        assert x.lift == pytest.approx(pairs[a, b] * len(baskets) / (n[a] * n[b])) and x.pmi == pytest.approx(math.log2(x.lift), abs=1e-9)
    total = len(baskets)
    want = {k for k, c in pairs.items() if c >= 3 and 5 * c >= total and total * c >= 2 * n[k[0]] * n[k[1]]}
    assert {(x.a, x.b) for x in together.associations(df, "i", "b", 3, 5, 2).collect()} == want
    assert together.associations(df.limit(0), "i", "b", 3, 500, 5).count() == 0


# tokens

TEXTS = [
    "", "a", "Hello world's best 123 tests!!  \n\n end", "<|endoftext|>", "a" * 3000, " " * 500, "\n" * 300, "ab" * 700, "日本語テキスト" * 50, "\x00\x1b[0m", "é é ﬁ 𝛼𝛽 😀👩‍🔬",
    "0123456789" * 100, "=" * 999, "don't WE'VE it'LL", "​zero‍width", "Ω Å µ", "\t x\r\n y",
]


def test_tokens(spark):
    import tiktoken

    ranks = bpe.read_ranks(open(bpe.VOCABULARY, "rb").read())
    plain = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(3)
    texts = TEXTS + ["".join(chr(r.randrange(32, 0x2FFF)) for _ in range(500)) for _ in range(20)] + ["".join(r.choice("etaoin ") for _ in range(2000)) for _ in range(10)]
    df = spark.createDataFrame([(i, t, [0]) for i, t in enumerate([*texts, None, TEXTS[2]])], "doc_id long, text string, ids array<int>")
    got = {x.doc_id: x.ids for x in bpe.encode_corpus(df).collect()}
    assert got == {i: plain.encode_ordinary(t or "") for i, t in enumerate([*texts, None, TEXTS[2]])}
    counts = {x.doc_id: x.n_tokens for x in bpe.token_counts(df, ("doc_id",)).collect()}
    assert counts == {i: len(v) for i, v in got.items()}
    assert bpe.encode_corpus(df.limit(0)).count() == 0


def test_prefix_tokens_are_the_encodings_of_prefixes():
    encoder = bpe.PrefixBPE(bpe.read_ranks(open(bpe.VOCABULARY, "rb").read()))
    word = "unbelievability"
    for n in range(1, len(word)):
        ids = encoder.encode_word(word[:n])
        assert b"".join(encoder.bytes_of[i] for i in ids) == word[:n].encode()
        assert all(encoder.compatible(a, b) for a, b in zip(ids, ids[1:], strict=False))
    assert not encoder.compatible(encoder.ranks[b"un"], encoder.ranks[b"der"]) or encoder.encode_word("under") == [encoder.ranks[b"un"], encoder.ranks[b"der"]]


# mix


def test_mix(spark):
    sized = [(i, s, n) for s, count, n in (("a", 2000, 10), ("b", 400, 30), ("c", 50, 10)) for i, n in [(f"{s}{k}", n + k % 7) for k in range(count)]]
    rows = [(k, s, n) for k, (_, s, n) in enumerate(sized)] + [(10**6, None, 50), (10**6 + 1, "unlisted", 50), (10**6 + 2, "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    target = [("a", 0.3, 3), ("b", 0.45, 5), ("c", 0.2, 4), ("none", 0.05, 9), ("null", None, 2), (None, 0.5, 1)]
    targets = spark.createDataFrame(target, "source string, target_share double, max_repeats int")
    totals = mixing.source_totals(df, targets)
    tokens = Counter()
    for _, s, n in rows:
        if s in {"a", "b", "c"}:
            tokens[s] += n
    whole = sum(tokens.values())
    assert {r.source for r in mixing.short_sources(totals).collect()} == {s for s, share, cap in target if s and share and share * whole > cap * tokens[s]} == {"c", "none"}
    mixed = mixing.mix(df, targets)
    used = mixed.collect()
    assert [r.place for r in used] == sorted(r.place for r in used)
    caps = {s: c for s, _, c in target}
    by = Counter(r.doc_id for r in used)
    where = {k: s for k, s, _ in rows}
    assert all(by[k] <= caps[where[k]] for k in by) and {where[k] for k in by} == {"a", "b", "c"}
    got = {r.source: r for r in mixing.shares(mixed, totals).collect()}
    for s, share in (("a", 0.3), ("b", 0.45)):
        assert got[s].mix_tokens / whole == pytest.approx(share, abs=0.005)
    assert got["c"].mix_tokens == 4 * tokens["c"] and got["none"].mix_tokens == 0
    assert sum(r.actual_share for r in got.values()) == pytest.approx(1)
    assert sorted(map(tuple, mixing.mix(df, targets).collect())) == sorted(map(tuple, used))
    assert mixing.mix(df.limit(0), targets).count() == 0


def test_exhausted_sources_come_from_the_mix(spark, monkeypatch):
    rows = [(f"{s}{k}", s, 10) for s, n in (("big", 700), ("small", 20), ("even", 80)) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id string, source string, n_tokens long")
    target = [("big", 0.5, 3), ("small", 0.3, 2), ("even", 0.1, 1), ("none", 0.1, 4)]  # "even" is used up and has its share
    targets = spark.createDataFrame(target, "source string, target_share double, max_repeats int")
    totals, mixed = mixing.source_totals(df, targets), mixing.mix(df, targets)
    assert {r.source for r in mixing.exhausted_sources(mixed, totals).collect()} == {"small", "none"}
    assert {r.source for r in mixing.exhausted_sources(mixed.where("doc_id <> 'small3' OR copy_no = 1"), totals).collect()} == {"none"}
    from litweave.llm import queries

    seen = []
    real = mixing.mix
    monkeypatch.setattr(mixing, "mix", lambda *a, **k: seen.append(1) or real(*a, **k))
    monkeypatch.setattr(queries, "_sized", lambda *a: (df, targets))
    assert {r.source for r in queries.p9_found(spark, "").collect()} == {"small", "none"} and seen


def test_many_sources_and_large_caps(spark, monkeypatch):
    docs = spark.range(6_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3_000).alias("source"), F.lit(10).cast("long").alias("n_tokens"), F.lit("text").alias("text"))
    targets = spark.range(3_000).select(F.concat(F.lit("s"), F.col("id")).alias("source"), F.lit(1 / 3_000).alias("target_share"), F.lit(9).alias("max_repeats"))
    sized = docs.drop("text")
    whole = mixing.mix(sized, targets).count()
    monkeypatch.setattr(mixing, "BROADCAST_LEVELS", 10)
    mixed = mixing.mix(sized, targets)
    assert mixed.count() == whole and mixed.select("source").distinct().count() > 2_500
    assert mixing.with_texts(mixed, docs).where("text = 'text'").count() == whole
    one = spark.createDataFrame([("s0", 1.0, 2_000)], "source string, target_share double, max_repeats int")
    many = sized.where("source in ('s0', 's1')").withColumn("source", F.lit("s0")).unionByName(sized.limit(0))
    assert mixing.mix(many, one).count() == pytest.approx(4, abs=2)
    # a small source repeated about a thousand times
    grown = spark.createDataFrame([("big", k, 1_000) for k in range(200)] + [("small", 1_000 + k, 2) for k in range(40)], "source string, doc_id long, n_tokens long")
    wish = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 2_000)], "source string, target_share double, max_repeats int")
    got = {r.source: r.mix_tokens for r in mixing.shares(mixing.mix(grown, wish), mixing.source_totals(grown, wish)).collect()}
    assert got["small"] == pytest.approx(0.4 * 200_080, rel=0.02)


def test_copies_are_poisson():
    assert list(mixing._poisson_levels(0.0, 3)) == [mixing.LEVELS] * 3
    assert 0.4 < mixing._poisson_levels(1_000.0, 1_001)[-1] / mixing.LEVELS < 0.6
    levels = mixing._poisson_levels(1.3, 6)
    mean = sum((mixing.LEVELS - x) / mixing.LEVELS for x in levels)
    assert mean == pytest.approx(sum(min(k, 6) * math.exp(-1.3) * 1.3**k / math.factorial(k) for k in range(40)), abs=1e-3)


# personal data

PEOPLE = pii.People(frozenset({"greta", "tarek", "ana-lise"}), frozenset({"tarnov", "velbys", "morkar", "kesist"}))
SAID = {
    "ask Greta Tarnov abt the key, 01632 960347": {("person", "Greta Tarnov"), ("phone", "01632 960347")},
    "Dear Dr. VELBYS-MORNOV Tarek,": {("person", "VELBYS-MORNOV Tarek")},
    "Signed: Kesnov, A. B.": {("person", "Kesnov, A. B.")},
    "The runs were logged by Ana-Lise\nvan der Velkar (ID no. QQ 12 34 56 C).": {("person", "Ana-Lise\nvan der Velkar"), ("id_number", "QQ 12 34 56 C")},
    "Write to <greta.v+lab@solids.example.org> for the data.": {("email", "greta.v+lab@solids.example.org")},
    "Reach me at +44 20 7946 0642 or g.tarnov [at] post [dot] norr [dot] example.": {("phone", "+44 20 7946 0642"), ("email", "g.tarnov [at] post [dot] norr [dot] example")},
    "T. Velnov lives at 33 West Asher Close and keeps the logbook.": {("person", "T. Velnov"), ("address", "33 West Asher Close")},
    "Kontakt: Greta Mornov, Langgatestr. 113, 66444 Oxmouth, Tel. 020 7946 0929.": {("person", "Greta Mornov"), ("address", "Langgatestr. 113"), ("phone", "020 7946 0929")},
    "Contact : Tarek Velist, 84, rue des Birchwell, 94658 Fernholm, tél. 01.99.00.43.28.": {("person", "Tarek Velist"), ("address", "84, rue des Birchwell"), ("phone", "01.99.00.43.28")},
    "Contacto: Greta Velkar, Plaza del Kings, n.º 166, Birchwick, teléfono (747) 555-0112": {("person", "Greta Velkar"), ("address", "Plaza del Kings, n.º 166"), ("phone", "(747) 555-0112")},
    "tax id 946 62 7154, holder Tarek J. Kesbys": {("id_number", "946 62 7154"), ("person", "Tarek J. Kesbys")},
}
DECOYS = [
    "Lot 949-35-9376 was used as received.", "Peaks at 246-389-6037 and 388.205.6251 were masked.", "Grant agreement 82-6090-9180-7.", "Reagents: CAS 42336-68-6, CAS 342807-61-9.",
    "See Velbys et al. for the model.", "A Tarnov plot gives a straight line.", "The Birch Court sample was cut along [0 0 2].", "Particles of LiF@Fe2O3 were cycled @ 0.1 C. The method follows.",
    "Firmware v1.14@build320, serial SN-3653492.", "Counts: 53 1785 1867 409.", "ISSN 1385-3920, pp. 530–1565.",
]


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(2)
    out = []
    for _ in range(40):
        lines = [*SAID, *DECOYS]
        r.shuffle(lines)
        out += lines
    return out


def people_table(spark):
    rows = [(g.title(), s) for g in ("greta", "tarek", "ana-lise") for s in ("Tarnov", "Velbys", "Morkar", "Kesist")] * 2 + [(None, None), ("X. Y.", "")]
    return spark.createDataFrame(rows, "given_name string, surname string")


def test_gazetteer(spark):
    known = pii.gazetteer(people_table(spark))
    assert known == PEOPLE
    assert [known.surname_vote(x) for x in ("Tarnov", "van der TARNOV-Velbys", "Tarnow", "The", "Velbys The")] == [1, 1, 0, -1, -1]
    assert pii.gazetteer(people_table(spark).limit(0)) == pii.People(frozenset(), frozenset())
    several = spark.createDataFrame([("Eva Lotte", "de la Cruz-Müller"), ("  ", " "), ("Al", None)], "given_name string, surname string")
    assert pii.gazetteer(several) == pii.People(frozenset({"eva", "al"}), frozenset({"cruz", "muller"}))


def test_personal_data(spark, corpus):
    docs = [*corpus, None, "", " ", " \n".join(corpus[:20]), " and nothing else" * 20000 + " Signed: Greta Tarnov"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*docs, corpus[0]])], "doc_id long, text string, pii_kind string")
    model, spans = pii.fit(df, people_table(spark))
    found = defaultdict(set)
    rows = [tuple(r) for r in pii.found_spans(model, spans).collect()]
    assert len(rows) == len(set(rows))
    for i, kind, run in rows:
        assert run in docs[i] if i < len(docs) else run in corpus[0]
        found[i].add((kind, run))
    wrong = [(t, found[i]) for i, t in enumerate(corpus) if found[i] != SAID.get(t, set())]
    assert not wrong, wrong[:5]
    assert found[len(docs) - 1] == {("person", "Greta Tarnov")} and not found[len(corpus)] and not found[len(corpus) + 1]
    masked = {r.doc_id: r.text for r in pii.mask(df, model).collect()}
    assert masked[len(corpus)] is None and masked[len(corpus) + 1] == ""
    again, kept = pii.fit(df, people_table(spark), keep_text=True)
    assert sorted(map(str, pii.mask_spans(kept, again).collect())) == sorted(map(str, pii.mask(df, model).collect()))
    for i, t in enumerate(corpus):
        for kind, run in SAID.get(t, ()):
            t = t.replace(run, pii.placeholder(pii.KINDS.index(kind)))
        assert masked[i] == t


def test_no_personal_data(spark):
    df = spark.createDataFrame([(1, "nothing here"), (2, None)], "doc_id long, text string")
    for docs in (df, df.limit(0)):
        model, spans = pii.fit(docs, people_table(spark).limit(0))
        assert pii.found_spans(model, spans).count() == 0
    assert {r.text for r in pii.mask(df, model).collect()} == {"nothing here", None}


def test_names_beyond_the_broadcast_bound(spark, monkeypatch):
    names = ["Greta", "Tarek", "Ana-Lise", "Zorvane", "al-Karim"]
    people = spark.createDataFrame([(n, "Tarnov") for n in names for _ in range(2 if n == "Greta" else 1)], "given_name string, surname string")
    texts = ["ask Zorvane Tarnov abt the key", "Dear Greta Tarnov,", "Ana-Lise Velkar and Tarek Tarnov", "al-Karim Greta Tarnov", None, "", "no names", "Dear Greta Tarnov,"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def candidates() -> dict:
        known, large = pii.split_gazetteer(people)
        assert (large is not None) == (pii.GAZETTEER < len(names) + 1)
        return {r.doc_id: [(s.kind, s.a, s.b, s.votes) for s in r.spans] for r in pii.candidate_spans(docs, known, names=large).collect()}

    whole = candidates()
    assert any(s[0] == 4 for s in whole[0])
    model, spans = pii.fit(docs, people)
    found, masked = sorted(pii.found_spans(model, spans).collect()), sorted(pii.mask(docs, model).collect())
    monkeypatch.setattr(pii, "GAZETTEER", 1)
    assert candidates() == whole
    model, spans = pii.fit(docs, people)
    assert sorted(pii.found_spans(model, spans).collect()) == found and sorted(pii.mask(docs, model).collect()) == masked


@pytest.fixture(scope="module")
def fitted(spark):
    path = "/root/testdata/sf0.01"
    if not Path(path).exists():
        pytest.skip("no test tables")
    return pii.fit(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/author.parquet"))[0]


def _chosen(model, text):
    return {(pii.KINDS[s["kind"]], s["run"]) for s in model.choose(pii.spans_of(text, model.people))}


def test_held_out_sentences(fitted):
    """Recall and precision of each kind on sentences of other wording, after fitting on documents alone."""
    both, said, true = Counter(), Counter(), Counter()
    for text, want in HELD_OUT + FRESH:
        got = _chosen(fitted, text)
        for counts, found in ((both, got & want), (said, got), (true, want)):
            counts.update(k for k, _ in found)
    for kind in pii.KINDS:
        assert both[kind] >= 0.9 * true[kind] and both[kind] >= 0.9 * said[kind], (kind, both[kind], said[kind], true[kind])


def test_numbers_in_use_are_found_like_those_of_fiction(fitted):
    for text, *numbers in PAIRS:
        for n in numbers:
            assert n in {run for _, run in _chosen(fitted, text.format(n))}, text.format(n)


def test_long_texts_cost_in_proportion():
    for piece in ("020 7946 0929 ", "7 ", "Greta Tarnov ", "A. B. ", "x@y.example ", "12 Oak Street, ", "123-45-6789 "):
        began = time.time()
        pii.spans_of(piece * 5_000, PEOPLE)
        short = time.time() - began
        began = time.time()
        pii.spans_of(piece * 20_000, PEOPLE)
        assert time.time() - began < 12 * short + 0.5, piece

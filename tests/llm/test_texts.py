"""Packing, leaks and personal information."""

import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelake.llm import leaks, packing, personal

TEXTS = ["One two  three.\n\nFour\tfive ", " lead", "a  b", "a   b \n c", "x\n y", "tail ", "é ü ß 中文 字", "it's we'll  don't", "1 234,5 — 67", "\n\n", "word " * 400, " nb  em"]


@pytest.fixture(scope="module")
def counter():
    if not Path(packing.TOKENIZER).exists():
        pytest.skip("no tokenizer files")
    return packing.TokenCounter(packing.TOKENIZER)


def test_counts_are_the_tokenizers(counter):
    rng = random.Random(1)
    alphabet = ["a", "The", " ", "  ", "\n", "\t", ".", "42", "'s", "é", "—"]
    texts = TEXTS + ["".join(rng.choices(alphabet, k=60)) for _ in range(400)]
    assert [counter(t) for t in texts] == [len(counter.encoding.encode_ordinary(t)) for t in texts]


@pytest.mark.parametrize("capacity", [10, 64, 2048])
def test_plan_uses_every_item_once_and_never_overfills(capacity):
    rng = random.Random(capacity)
    histogram = Counter(min(capacity, 1 + int(rng.expovariate(3 / capacity))) for _ in range(5000))
    fillings = packing.plan(histogram, capacity)
    used = Counter()
    for filling, times in fillings:
        assert sum(x * k for x, k in filling.items()) <= capacity and times > 0
        for x, k in filling.items():
            used[x] += k * times
    assert used == histogram
    boxes, least = sum(t for _, t in fillings), sum(x * n for x, n in histogram.items()) / capacity
    assert boxes <= least * 1.02 + 1


def test_one_filling_is_the_fullest():
    from itertools import product

    counts = {7: 1, 5: 2, 4: 3, 3: 1}
    best = max(s for s in (7 + 5 * a + 4 * b + 3 * c for a, b, c in product(range(3), range(4), range(2))) if s <= 20)
    assert sum(x * k for x, k in packing.fill_once(counts, 20).items()) == best


def test_pack_keeps_items_whole(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1, 9, 50, 50, 50, 99, 100, 101, 250, rng.randrange(1, 300)])) for i in range(2000)] + [(5, 50), (5, 50), (None, 7)]
    df = spark.createDataFrame(rows, "key bigint, tokens bigint")
    out = packing.pack(spark, df, f"file://{tmp_path}/l", 100, shards=5).collect()
    fill, pieces = Counter(), defaultdict(list)
    for r in out:
        fill[r["container"]] += r["tokens"]
        pieces[r["key"]].append((r["piece"], r["start"], r["tokens"]))
    assert max(fill.values()) <= 100 and sum(fill.values()) == sum(n for _, n in rows)
    assert sorted(fill) == list(range(len(fill)))
    for i, n in rows[:2000]:
        if i != 5 and n:
            own = sorted(pieces[i])
            assert [p[1] for p in own] == [100 * k for k in range(len(own))] and all(p[2] == 100 for p in own[:-1]) and sum(p[2] for p in own) == n
    assert packing.pack(spark, df.limit(0), f"file://{tmp_path}/e", 100).count() == 0


def test_blank_and_long_texts(spark, counter):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "one two"), (None, "x"), (6, "word " * 50_000)], "doc_id bigint, text string").withColumn("tokens", F.lit(1)).withColumn("key", F.lit(1))
    out = {r["key"]: r["tokens"] for r in packing.token_lengths(df, "doc_id", "text").collect()}
    assert out == {4: 2, None: 1, 6: counter("word " * 50_000)}


def test_pieces_give_the_texts_back(spark, counter, tmp_path):
    texts = {1: "word " * 300, 2: "One two  three.\n\nFour\tfive é 中文", 3: "x", 4: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumn("piece", F.lit("clash"))
    packed = packing.pack(spark, packing.token_lengths(df, "doc_id", "text"), f"file://{tmp_path}/l", 64)
    rows = sorted((r["key"], r["piece"], r["ids"]) for r in packing.token_slices(df, packed, "doc_id", "text").collect())
    back = defaultdict(list)
    for k, _, ids in rows:
        assert 0 < len(ids) <= 64
        back[k] += ids
    assert {k: counter.encoding.decode(ids) for k, ids in back.items()} == {k: t for k, t in texts.items() if t}


# leaks


def vocabulary(rng, n=3000):
    return ["".join(rng.choices("abcdefghijklmnoprstuvwz", k=rng.randrange(3, 9))) for _ in range(n)]


def test_leaks_through_damage(spark, tmp_path):
    rng = random.Random(8)
    vocab = vocabulary(rng)
    text = lambda n: rng.choices(vocab, k=n)
    formula = text(12)
    items = [text(40) + formula + text(28) for _ in range(12)]
    passages = [(i, " ".join(w).capitalize() + ".") for i, w in enumerate(items)] + [(100, None), (101, ""), (102, "four words are few"), (0, "x")]
    docs, want = [], set()

    def doc(parts, *hits):
        docs.append((len(docs), "\n".join(parts)))
        want.update((len(docs) - 1, h) for h in hits)

    plain = lambda n: " ".join(text(n))
    for i, w in enumerate(items):
        doc([plain(30), ", ".join(w).upper(), plain(30)], i)
        doc([plain(5), " ".join(w[:34])], i)  # two fifths and a little
        doc([plain(5), " ".join(w[:20]), plain(20)])  # a short quotation
        doc([plain(9), " ".join(w[:20]), plain(60), " ".join(w[55:78]), plain(9)], i)  # two pieces
        doc([plain(9), " ".join(w[:25]), "\n[EXC 2027] Skim & Sons Ltd v Mae Ltd   2\n", " ".join(w[25:60])], i)  # a page header
        hurt = [x if k % 9 else "q" + x[1:] for k, x in enumerate(w)]
        doc([plain(9), " ".join(hurt), plain(9)], i)  # changed letters
        broken = " ".join(x[:2] + "-\n" + x[2:] if k % 6 == 0 and len(x) > 4 else x for k, x in enumerate(w))
        doc([plain(9), broken], i)
        doc([plain(9), " ".join(formula), plain(9)])
    for _ in range(4000):
        docs.append((len(docs), plain(10) + " " + " ".join(formula)))
    df = spark.createDataFrame(docs + [(-1, None), (-2, ""), (-3, plain(30_000))], "doc_id bigint, text string").withColumn("item", F.lit(1))
    ev = spark.createDataFrame(passages, "item_id bigint, passage string").withColumn("text", F.lit("clash"))
    out = leaks.find(spark, df, "doc_id", "text", ev, "item_id", "passage", f"file://{tmp_path}/i")
    assert {(r["key"], r["item"]) for r in out.collect()} == want
    assert out.count() == len(want)
    assert leaks.find(spark, df.limit(0), "doc_id", "text", ev, "item_id", "passage", f"file://{tmp_path}/i2").count() == 0
    assert leaks.find(spark, df.limit(5), "doc_id", "text", ev.limit(0), "item_id", "passage", f"file://{tmp_path}/i3").count() == 0


@pytest.mark.parametrize("clean", [0, 1])
def test_leaks_with_letters_changed_throughout(spark, tmp_path, clean):
    rng = random.Random(5)
    vocab = vocabulary(rng)
    cases = [(n, every) for n in (100, 120, 140, 160, 600) for every in (6, 8, 10, 12, 16, 20)]
    items = [rng.choices(vocab, k=n) for n, _ in cases]
    around = lambda: " ".join(rng.choices(vocab, k=20))
    docs = [(i, f"{around()} {' '.join(x if k % every else 'q' + x[1:] for k, x in enumerate(w))} {around()}") for i, (w, (_, every)) in enumerate(zip(items, cases, strict=True))]
    docs += [(len(items) + i, " ".join(w)) for i, w in enumerate(items) if clean]
    df, ev = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, passage string")
    out = leaks.find(spark, df, "doc_id", "text", ev, "item_id", "passage", f"file://{tmp_path}/i")
    assert {(r["key"], r["item"]) for r in out.collect()} == {(d, d % len(items)) for d, _ in docs}


def test_leaks_into_a_third_of_the_texts(spark, tmp_path):
    rng = random.Random(6)
    vocab = vocabulary(rng)
    text = lambda n: rng.choices(vocab, k=n)
    formula, long_formula = text(24), text(30)
    items = [text(100), text(40) + formula + text(14) + long_formula + text(12)]
    docs, want = [], set()

    def doc(words, *hits):
        docs.append((len(docs), " ".join([*text(12), *words, *text(12)])))
        want.update((len(docs) - 1, h) for h in hits)

    for k in range(400):
        doc(items[0], 0)
        doc([x if j % 8 else "q" + x[1:] for j, x in enumerate(items[0])], 0)  # changed letters
        doc(items[0][10:35] if k % 4 == 0 else text(20))  # a shorter quotation
        doc(formula)
        doc(long_formula)
    for k in range(30):
        doc(formula + text(60) + long_formula)  # formulas alone, over two fifths
        doc(items[0][:22] + text(50) + items[0][60:84], 0)
        if k < 6:
            doc(items[1], 1)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    ev = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, passage string")
    out = leaks.find(spark, df, "doc_id", "text", ev, "item_id", "passage", f"file://{tmp_path}/i")
    assert {(r["key"], r["item"]) for r in out.collect()} == want


def test_a_piece_word_for_word_is_no_formula():
    at, letters = np.arange(40), np.arange(44, dtype=np.uint16)
    spans = leaks.pieces(at, at, letters, letters)
    words = lambda alone: leaks.best_two(leaks.without_formulas(spans, np.zeros(40, bool), alone))
    assert words(40.0) == 44 and words(45.0) == 0


def test_a_passage_in_any_share_of_the_texts(spark, tmp_path):
    rng = random.Random(60)
    vocab = vocabulary(rng)
    text = lambda n: rng.choices(vocab, k=n)
    passage = text(60)
    ev = spark.createDataFrame([(1, " ".join(passage))], "item_id bigint, passage string")
    base = [(i, " ".join(text(60))) for i in range(1000)]
    for n in (4, 5, 6, 20, 500):
        docs = [(i, f"{t[:100]} {' '.join(passage)} {t[100:]}" if i < n else t) for i, t in base]
        out = leaks.find(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", ev, "item_id", "passage", f"file://{tmp_path}/{n}")
        assert sorted(r["key"] for r in out.collect()) == list(range(n))


def test_a_second_suite_needs_the_index_only(spark, tmp_path):
    rng = random.Random(61)
    vocab = vocabulary(rng)
    text = lambda n: rng.choices(vocab, k=n)
    docs = [text(200) for _ in range(40)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id bigint, text string")
    path = f"file://{tmp_path}/index"
    leaks.build_index(df, "doc_id", "text", path)
    rows = spark.read.parquet(path)
    assert rows.filter("term <> ''").agg(F.sum("n").alias("n")).first()["n"] == 40 * 200
    for suite in range(2):
        wanted = [(1000 * suite + i, " ".join(t[20:80])) for i, t in enumerate(docs) if i % 2 == suite] + [(7000, " ".join(text(50))), (7001, " ".join(docs[3][:3])), (None, " ".join(docs[5][50:120])), (7002, None), (7003, "…")]
        ev = spark.createDataFrame(wanted, "item_id bigint, passage string")
        want = {(i, 1000 * suite + i) for i in range(suite, 40, 2)} | {(3, 7001), (5, None)}
        for block in (10**6, 900):  # in one block, in many
            out = leaks.search(spark, path, ev, "item_id", "passage", f"file://{tmp_path}/s{suite}-{block}", block)
            assert {(r["key"], r["item"]) for r in out.collect()} == want


def test_packed_places_come_back():
    rng = random.Random(63)
    for _ in range(50):
        lists = [sorted(rng.sample(range(1, 10 ** rng.randrange(2, 9)), rng.randrange(1, 60))) for _ in range(rng.randrange(1, 9))]
        blobs = [leaks.pack(np.diff(np.array(x), prepend=0))[0].tobytes() for x in lists]
        places, sizes = leaks._lists(blobs)
        assert places.tolist() == [p for x in lists for p in x] and sizes.tolist() == [len(x) for x in lists]
    numbers = np.array([0, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28, 2**31 - 1])
    assert leaks.unpack(leaks.pack(numbers)[0])[0].tolist() == numbers.tolist() and len(leaks._lists([])[0]) == 0


def test_intersection_agrees_with_a_walk():
    rng = random.Random(62)
    for _ in range(60):
        size = rng.randrange(5, 80)
        at = np.array([rng.choice([-1, 0, 1, 2]) for _ in range(size)] + [-1] * 5, dtype=np.int32)
        grams = np.unique(np.array([[rng.choice([0, 1, 2]) for _ in range(5)] for _ in range(6)] + [[0, 1, -2, -2, -2]], dtype=np.int32), axis=0)
        lists = [np.flatnonzero(at == w) for w in range(3)]
        phrase, base = leaks.intersect(grams, np.concatenate(lists), np.array([len(x) for x in lists]), at)
        want = [(g, b) for b in range(size) for g, gram in enumerate(grams) if all(w < 0 or at[b + k] == w for k, w in enumerate(gram))]
        assert sorted(zip(phrase.tolist(), base.tolist())) == sorted(want)


def test_a_word_exchanged_ends_a_piece_a_letter_does_not():
    words = [f"word{chr(97 + i)}{chr(98 + i % 20)}" for i in range(26)]
    letters = lambda ws: np.array([leaks.sketch(w) for w in ws], dtype=np.uint16)
    q = np.array([*range(8), *range(13, 22)])
    changed, other = [*words], [*words]
    changed[12], other[12] = "x" + words[12][1:], "somebody"
    assert leaks.best_two([leaks.pieces(q, q, letters(changed), letters(words))[-1]]) == 26
    assert max(s[2] for s in leaks.pieces(q, q, letters(other), letters(words))) == 13


def test_words_of_pieces_are_words_of_the_text():
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choices(["ab", "cd", "-", "-\n", " ", "\n", "É", "1", "'", "."], k=30))
        joined = leaks.JOIN.sub("", t)
        assert leaks.words(t) == [w for p in joined.split() for w in leaks.WORD.findall(leaks.fold(p))]


# personal information

HEAD = "NORFORD MC\nMC-2018-00004793\n14.08.2020\nBetula Hondwyn v Prylevmere Estates Ltd\nCounsel for the claimant: Kytu Skylrath\nRespondent: Mr BETULA HONDWYN\nWitness: Zond, Ilmo\nRegistrar: D. van Sovmund\n\n"
CASES = [
    (HEAD, ["NAME Betula Hondwyn", "NAME Kytu Skylrath", "NAME BETULA HONDWYN", "NAME Zond, Ilmo", "NAME D. van Sovmund"]),
    ("The witness Betula Hondwyn (national number\nQQ639505A) confirmed it.", ["NAME Betula Hondwyn", "ID_NUMBER QQ639505A"]),
    ("Mrs\nHondwyn lived at Flat 9, 68 Alderfield Terrace,\nLimhaven ZZ6 5QQ until the sale. Hondwyn Shipping Ltd appeared.", ["NAME Hondwyn", "ADDRESS Flat 9, 68 Alderfield Terrace,\nLimhaven"]),
    ("Dr Hinova could be reached only on 01632-960-722 or at k_n+x@mill.office.test. It cost 1,078,782 crowns on 04.12.2003.", ["NAME Hinova", "PHONE 01632-960-722", "EMAIL k_n+x@mill.office.test"]),
    ("Enquiries may be sent to <a @ b-c.example>. tel. +44 ** **** **10, e-mail ****@****. 99 units @ 89 per unit. See k.x [at] b-c [dot]\nexample [dot] org or k+x (at)\nm.test or k @\nn.test.", ["EMAIL a @ b-c.example", "EMAIL k.x [at] b-c [dot]\nexample [dot] org", "EMAIL k+x (at)\nm.test", "EMAIL k @\nn.test"]),
    ("The meter read 568-67/4871 units. EUR 5 was credited to ledger 11 222 333. File transferred under number 123456789.", []),
    ("In der Akte steht van Sörd, Igor, Ausweis 00 753 364 428. Herr Kondsk wohnte bis zum Verkauf Quillwellweg 139, Quillhaven.", ["NAME van Sörd, Igor", "ID_NUMBER 00 753 364 428", "NAME Kondsk", "ADDRESS Quillwellweg 139, Quillhaven"]),
    ("Der Anruf von (0221) 4710 714 wurde angenommen. Die Kündigung ging an Irene Zyl-Mén, Am Ferrymere 13, 00013 Limwick, und kam zurück.", ["PHONE (0221) 4710 714", "NAME Irene Zyl-Mén", "ADDRESS Am Ferrymere 13, 00013 Limwick"]),
    ("Le témoin M. DOMORA SOVMUND a déposé depuis 48 bis avenue Oakmere, Quillmoret. Le bail et la vente de la cour et les pièces de la ville dans la rue sont dans les dossiers de la mairie, et la loi est la loi, les baux, la cour, le juge, une partie. M. Grus n'était joignable qu'au 06.39.98.45.87. M. Grus a signé le reçu.", ["NAME DOMORA SOVMUND", "ADDRESS 48 bis avenue Oakmere, Quillmoret", "NAME Grus", "PHONE 06.39.98.45.87", "NAME M. Grus"]),
    ("Relying on Velusquist SARL v Registrar [2024] 33 NLR 957 and In re K. [2021] EXC 195, the Quillmere Lane Improvement Order 1994 at Norwick applies.", []),
    ("Erdrith Grénq and Prof. Orvan\nTaemere are siblings. According to [REDACTED], the keys had been left with Sano O'Zeld.", ["NAME Erdrith Grénq", "NAME Orvan\nTaemere", "NAME Sano O'Zeld"]),
    ("ORDER\nThe appeal is dismissed.\n\nJudge Orvara\nTusenne", ["NAME Orvara\nTusenne"]),
    ("", []),
    ("@ v c. Mr Mrs ./.", []),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_occurrences(case):
    text, want = CASES[case]
    assert [f"{k} {text[a:b]}" for a, b, k in personal.Finder()(text)] == want


#: Sentences that no test table holds: what must be found, in order.
PLAIN = [
    ("Please call Jonathan Harkwell tomorrow.", ["Jonathan Harkwell"]),
    ("Maria Lopez", ["Maria Lopez"]),
    ("My name is Peter Smith and I live here.", ["Peter Smith"]),
    ("He moved to 12 Elm Drive, Springfield last May.", ["12 Elm Drive, Springfield"]),
    ("Send it to 44 Baker Close, Leeds.", ["44 Baker Close, Leeds"]),
    ("Customer: Aisha Rahman\nPhone: +44 20 7946 0958\nSSN: 123-45-6789", ["Aisha Rahman", "+44 20 7946 0958", "123-45-6789"]),
    ("Dear Ms Okafor,\nthank you.\nKind regards, Tom Becker", ["Okafor", "Tom Becker"]),
    ("Passport no. X1234567 was issued. Her passport number is 533401234.", ["X1234567", "533401234"]),
    ("Der Vertrag kam von Frau Yilmaz; Mieter: Jonas Weber\nAnschrift: Hauptstraße 5, 10115 Berlin", ["Yilmaz", "Jonas Weber", "Hauptstraße 5, 10115 Berlin"]),
    ("Mein Name ist Lukas Brandt, geboren 1980. Steuer-ID: 12345678901", ["Lukas Brandt", "12345678901"]),
    ("Je m'appelle Claire Fontaine, j'habite 12 rue des Lilas, Lyon. Nom: x", ["Claire Fontaine", "12 rue des Lilas, Lyon"]),
    ("Invoice no. 123456789 of Smith & Sons Ltd was paid by Robert Klein.", ["Robert Klein"]),
    ("The bridge at Victoria Park was closed on 12.03.2020. IBAN DE89 3704 0044 0532 0130 00", []),
    ("The witness said that Kwame Mensah lives in 9 Old Mill Lane, Bath.", ["Kwame Mensah", "9 Old Mill Lane, Bath"]),
    ("Anna Müller and Dr. Heinz Vogel met Carlos Ruiz.", ["Anna Müller", "Heinz Vogel", "Carlos Ruiz"]),
    (f"Write to {'x' * 300}@example.com soon.", [f"{'x' * 300}@example.com"]),
    (f"{'The river rose again. ' * 40}The {'very ' * 60}old letter of {'N' + 'a' * 90} {'B' + 'e' * 90} Ltd.", []),
]


@pytest.mark.parametrize("case", range(len(PLAIN)))
def test_sentences_outside_the_tables(case):
    text, want = PLAIN[case]
    assert [text[a:b] for a, b, _ in personal.Finder()(text)] == want


def test_language_is_told_by_the_paragraph():
    english = "The duty of the carrier is to deliver and to account to the owner of the goods, and that was the case. " * 9
    french = "Le bail et la vente de la cour et les pièces de la ville sont dans les dossiers. M. Dupont a déposé la requête et le mémoire."
    for text in (f"{english}\n\n{french}", f"{french}\n\n{english}"):
        assert [text[a:b] for a, b, _ in personal.Finder()(text)] == ["Dupont"]


def test_a_french_text_after_a_foreign_headnote():
    head = "The duty of the carrier is to deliver and to account to the owner of the goods. " * 50
    body = "Le bail et la vente de la cour et les pièces de la ville sont dans les dossiers de la mairie. " * 60
    text = f"{head}\n\n{body}M. Grus n'était joignable qu'au 06.39.98.45.87. "
    assert len(head) > 3000 and [f"{k} {text[a:b]}" for a, b, k in personal.Finder()(text)] == ["NAME Grus", "PHONE 06.39.98.45.87"]


def test_short_names_at_a_cue_and_again():
    text = "Witness: Jo Wu\nCounsel for the claimant: Anna Ott\n\nMr Wu gave evidence. The account of Wu was read; Ott replied. Otto Wurst Ltd and WUX stayed away.\n\nThe court was told that Ng lived at no address.\n\nNg lived at sea. She lived at home."
    want = ["NAME Jo Wu", "NAME Anna Ott", "NAME Wu", "NAME Wu", "NAME Ott", "NAME Ng", "NAME Ng"]
    assert [f"{k} {text[a:b]}" for a, b, k in personal.Finder()(text)] == want


def test_redact_keeps_the_rest(spark):
    rows = [(1, HEAD, "x"), (2, None, "y"), (3, "", None), (4, "no one here", "z"), (5, "Mr Hondwyn lived at 9 Old Lane, Norford until the sale. " * 3000, "w")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind string").withColumn("start", F.lit(1))
    out = {r["doc_id"]: r for r in personal.redact(df, "text").collect()}
    assert personal.redact(df, "text").columns == df.columns
    assert out[1]["text"].startswith("NORFORD MC\nMC-2018-00004793\n14.08.2020\n[NAME] v Prylevmere Estates Ltd\nCounsel for the claimant: [NAME]\nRespondent: Mr [NAME]\n")
    assert out[2]["text"] is None and out[3]["text"] == "" and out[4]["text"] == "no one here"
    assert out[5]["text"] == "Mr [NAME] lived at [ADDRESS] until the sale. " * 3000 and out[5]["kind"] == "w"
    found = personal.occurrences(df, "doc_id", "text")
    assert found.filter("key = 5").count() == 6000 and personal.occurrences(df.limit(0), "doc_id", "text").count() == 0


def test_positions_count_characters(spark):
    df = spark.createDataFrame([(1, "😀 Herr Zylén wohnte bis zum Verkauf Am Tor 1, Norau.")], "doc_id bigint, text string")
    assert [(r["start"], r["kind"]) for r in personal.occurrences(df, "doc_id", "text").orderBy("start").collect()] == [(7, "NAME"), (36, "ADDRESS")]

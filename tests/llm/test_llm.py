from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import bpe, folding, garbled, leaks, lookalikes, pairs, pieces, quantiles, scans
from pagemill.llm.charstats import CLASSES, PairModel, classes
from pagemill.llm.tokens import TOKENIZERS, decode_texts, encode_texts, encoder

DOCS = "doc_id long, text string, ids string"
TEXTS = [None, "", "   ", "it's  done\n\n's", "Übergröße ½ 日本語 👍🏽", "a" * 5000, "<|endoftext|>", "x y\r\n\tz"]


@pytest.fixture(scope="module")
def enc():
    with open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        return encoder(f.read())


def model(texts):
    total = np.zeros(CLASSES * CLASSES, np.int64)
    own = classes("\n" + "\n".join(texts) + "\n")
    np.add.at(total, own[:-1] * CLASSES + own[1:], 1)
    seen = np.flatnonzero(total)
    return PairModel(seen, total[seen])


def test_ids_equal_the_public_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(TEXTS)], DOCS)
    got = {r.doc_id: list(r.ids) for r in encode_texts(df, "doc_id", "text").collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
    assert encode_texts(df.limit(0), "doc_id", "text").count() == 0


def test_round_trip_and_random_texts(enc):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rng = random.Random(3)
    parts = ["'s", "'ll", "'", " ", "  ", "\n", "a", "é", "Ж", "1", "½", "-", "!", "日", "👍", "the ", "ing"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(800)]
    ids, counts = enc.encode(texts)
    ends = counts.cumsum()
    for i, x in enumerate(texts):
        own = ids[ends[i] - counts[i] : ends[i]]
        assert own.tolist() == t.encode(x, add_special_tokens=False).ids
        assert bpe.decode(own.tolist(), enc.transducer.bytes_of, 2) == x


def test_texts_of_ids(spark):
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(TEXTS)], DOCS)
    ids = encode_texts(df, "doc_id", "text")
    assert {r.doc_id: r.text for r in decode_texts(ids, "doc_id", "ids").collect()} == {i: x or "" for i, x in enumerate(TEXTS)}


def test_store_of_pre_tokens_is_bounded():
    with open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        small = bpe.Encoder(bpe.read_ranks(f.read()), letters=50)
    for i in range(30):
        small.encode([f"word{i}x" * 9])
        assert small._held <= 50 + 9 * 8
    assert bpe.decode(small.encode(["again and again"])[0].tolist(), small.transducer.bytes_of) == "again and again"


def test_incremental_utf8():
    data = "aé日👍".encode()
    machine = bpe.Utf8Machine()
    assert "".join(machine.feed(data[i : i + 1]) for i in range(len(data))) + machine.feed(b"", last=True) == "aé日👍"
    assert bpe.Utf8Machine().feed(b"a\xc3", last=True) == "a�"


def test_pieces_cover_and_overlap(enc):
    text = "\n\n".join(" ".join(f"Sentence {i} about rivers {j}." for j in range(12)) for i in range(40)) + "z" * 9000
    ids, counts = enc.encode([text])
    spans = pieces.cut(text, enc.lengths_of[ids], 1024, 64)
    assert spans[0][0] == 0 and spans[-1][1] == counts[0] and spans[-1][2] == -1
    assert all(b - a <= 1024 for a, b, *_ in spans) and all(n[0] == o[1] - 64 for o, n in zip(spans, spans[1:]))
    assert {k for *_, k, _ in spans} <= {-1, pieces.CHARACTER, pieces.WORD, pieces.SENTENCE, pieces.PARAGRAPH}


def test_piece_ends_where_the_topic_changes(enc):
    rng = random.Random(5)
    topics = [[f"{c}{v}{c}{n}" for c in own for v in "aeiou" for n in "lmnr"] for own in ("bcdf", "pqst")]
    say = lambda topic, n: " ".join(" ".join(rng.choice(topics[topic]) for _ in range(9)).capitalize() + "." for _ in range(n))
    text = say(0, 30) + " " + say(1, 50)
    ids, _ = enc.encode([text])
    spans = pieces.cut(text, enc.lengths_of[ids], 1024, 64)
    first = bpe.decode(ids[: spans[0][1]].tolist(), enc.transducer.bytes_of)
    words = first.lower().replace(".", "").split()
    assert spans[0][3] > 0.5 and len(words) == 30 * 9 and all(w in topics[0] for w in words)


def test_valleys_by_brute_force():
    rng = random.Random(2)
    text = " ".join(rng.choice("abcdefgh") * 3 for _ in range(400))
    offsets = np.array([i for i, c in enumerate(text) if c == " "][60:300:7])
    words = [(m.start(), m.group()) for m in pieces._WORD.finditer(text)]

    def likeness(at):
        own = [w for p, w in words if p < at][-pieces.BLOCK :], [w for p, w in words if p >= at][: pieces.BLOCK]
        a, b = ({x: w.count(x) for x in w} for w in own)
        return sum(a[x] * b.get(x, 0) for x in a) / (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5

    values = [likeness(at) for at in offsets]
    for i, got in enumerate(pieces.valley_depths(text, offsets)):
        want = -2 * values[i]
        for step in (-1, 1):
            j = i
            while 0 <= j + step < len(values) and values[j + step] >= values[j] - 1e-6:
                j += step
            want += values[j]
        assert got == pytest.approx(want, abs=1e-4)


def test_pieces_only_of_long_texts(spark):
    df = spark.createDataFrame([(1, None, ""), (2, "", ""), (3, "word " * 1024, ""), (4, "word " * 3000, "")], DOCS)
    got = pieces.split_texts(df, "doc_id", "text").groupBy("doc_id").agg(F.max("piece").alias("n")).collect()
    assert {r.doc_id for r in got} == {4} or {r.doc_id for r in got} == {3, 4}
    assert 4 in {r.doc_id for r in got}


@pytest.mark.parametrize("values", [np.arange(200_000.0), np.zeros(50_000), np.random.default_rng(1).lognormal(0, 3, 300_000)])
def test_rank_error_of_merged_sketches(values):
    rng = np.random.default_rng(2)
    parts = np.array_split(rng.permutation(values), 7)
    whole = quantiles.Sketch()
    for part in parts:
        s = quantiles.Sketch()
        s.add(part)
        whole.merge(s.levels)
    assert whole.count() == len(values)
    ordered = np.sort(values)
    for share, got in zip(quantiles.SHARES, whole.quantiles(quantiles.SHARES), strict=True):
        low, high = np.searchsorted(ordered, got, "left") / len(values), np.searchsorted(ordered, got, "right") / len(values)
        assert low - 0.01 <= share <= high + 0.01


def test_percentiles_leave_out_nulls(spark):
    schema = "eval_id long, file string, provider string, run_at timestamp, parse_latency_seconds double, latencies array<double>"
    import datetime as dt

    day = dt.datetime(2026, 1, 1)
    rows = [(1, "a", "p", day, 1.0, [1.0, None, float("nan")]), (1, "a", "p", day, 1.0, [1.0, None, float("nan")]), (2, "a", "p", day, None, None), (3, None, None, None, 3.0, [])]
    notes = spark.createDataFrame([("a", "form"), ("a", "form"), ("b", None)], "file string, document_type string")
    daily = quantiles.daily_latency_sketches(spark.createDataFrame(rows, schema), notes)
    got = {(r.document_type, r.provider, r.metric): (r.n, r.p50) for r in quantiles.latency_percentiles(daily).collect()}
    assert got["form", "p", "latencies"] == (1, 1.0) and got["form", "*", "parse_latency_seconds"] == (1, 1.0)
    assert got[None, "*", "parse_latency_seconds"] == (1, 3.0) and got[None, "", "latencies"] == (0, None)


def test_days_combine_and_groups_are_bounded(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i % 500, float(v), [float(x) for x in rng.lognormal(0, 2, 3)]) for i, v in enumerate(rng.lognormal(0, 2, 4000))]
    df = spark.createDataFrame(rows, "g int, v double, vs array<double>").repartition(6)
    monkeypatch.setattr(quantiles, "HELD", 300)
    parts = quantiles.build(df, ["g"], "vs")
    once = quantiles.combine(parts, ["g"])
    got = {r.g: (r.n, r.p50) for r in quantiles.percentiles(once, ["g"], quantiles.SHARES, quantiles.NAMES).collect()}
    for g in range(500):
        own = sorted(x for k, _, vs in rows if k == g for x in vs)
        assert got[g] == (len(own), own[-(-len(own) // 2) - 1])
    assert once.count() == 500 and quantiles.combine(parts, ["g"], whole=False).count() >= 500


def test_rows_of_an_evaluation_count_once_whatever_their_order(spark):
    import datetime as dt

    schema = "eval_id long, file string, provider string, run_at timestamp, parse_latency_seconds double, latencies array<double>"
    day = dt.datetime(2026, 1, 1)
    rows = [(1, "a", "p", day, 9.0, [2.0]), (1, "a", "p", day, 5.0, [2.0]), (None, "a", "p", day, 7.0, None), (None, "a", "p", day, 7.0, None), (None, "a", "p", day, 8.0, None)]
    notes = spark.createDataFrame([("a", "form")], "file string, document_type string")
    seen = set()
    for order in (rows, rows[::-1]):
        daily = quantiles.daily_latency_sketches(spark.createDataFrame(order, schema).repartition(3), notes)
        got = {(r.provider, r.metric): (r.n, r.p50, r.p99) for r in quantiles.latency_percentiles(daily).collect()}
        assert got["p", "parse_latency_seconds"][0] == 3 and got["p", "latencies"][:2] == (1, 2.0)
        seen.add(got["p", "parse_latency_seconds"])
    assert len(seen) == 1


def _passage(n, seed):
    rng = random.Random(seed)
    return [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnr')}{rng.randint(0, 99)}e" for _ in range(n)]


PASSAGES = "item_id long, passage string"


def test_leaks(spark):
    words = _passage(60, 1)
    noise = " ".join(_passage(80, 2))
    edited = list(words)
    for i in (5, 15, 25, 35, 45):
        edited[i] = "other"
    shuffled = list(words)
    random.Random(4).shuffle(shuffled)
    texts = [
        noise + " " + " ".join(words[10:34]).upper() + ", " + noise,
        " ".join(words[10:33]),
        " ".join(edited),
        " ".join([*edited[:50], "x", "y", *edited[50:]]),
        " ".join(shuffled),
        " ".join(words[:20]) + " " + words[20][:2] + "-\n" + words[20][2:] + " " + " ".join(words[21:30]).replace("e", "е"),
        None,
        "",
        " ".join(words[:25]) + ". " + noise + " ﬁ ½ " + " ".join(words[20:57]),
        " ".join("x" * 70 if i % 11 == 5 else w for i, w in enumerate(words)),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    tests = spark.createDataFrame([(7, " ".join(words)), (8, None), (9, "")], PASSAGES)
    got = {(r.doc_id, r.item_id, r.kind): (r.words, r.text_at, r.word_at) for r in leaks.find_leaks(docs, "doc_id", "text", tests, "item_id", "passage").collect()}
    assert set(got) == {(0, 7, "verbatim"), (2, 7, "edited"), (5, 7, "verbatim"), (8, 7, "verbatim"), (9, 7, "edited")}
    assert got[0, 7, "verbatim"] == (24, len(noise) + 1, 10) and got[5, 7, "verbatim"] == (30, 0, 0)
    assert got[8, 7, "verbatim"] == (37, texts[8].index("½") + 2, 20)  # the longest match, not the first
    assert leaks.find_leaks(docs.limit(0), "doc_id", "text", tests, "item_id", "passage").count() == 0
    assert leaks.find_leaks(docs, "doc_id", "text", tests.limit(0), "item_id", "passage").count() == 0


def test_leaks_in_scripts_without_blanks_and_in_parts(spark, monkeypatch):
    rng = random.Random(8)
    chinese = "".join(chr(rng.randint(0x4E00, 0x4E80)) for _ in range(66))
    other = "".join(chr(rng.randint(0x4F00, 0x4F80)) for _ in range(200))
    texts = [other + chinese[8:58] + other, chinese[:20], other, chinese[:30] + other[:1] + chinese[31:], " ".join(chinese)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tests = spark.createDataFrame([(i, chinese if i == 3 else " ".join(_passage(40, i))) for i in range(9)], PASSAGES)
    for part in (leaks.PART, 100):
        monkeypatch.setattr(leaks, "PART", part)
        got = {(r.doc_id, r.item_id): r.words for r in leaks.find_leaks(docs, "doc_id", "text", tests, "item_id", "passage").collect()}
        assert got == {(0, 3): 50, (3, 3): 35, (4, 3): 66}


@pytest.mark.parametrize("letters", [20, 400])
def test_suffix_array_against_brute_force(letters):
    rng = random.Random(letters)
    pool = [chr(0x4E00 + i) for i in range(letters)] if letters > 254 else [chr(97 + i) for i in range(letters)]
    word = lambda: "".join(rng.choice(pool[:3] if rng.random() < 0.7 else pool) for _ in range(rng.randint(1, 3)))
    common = [word() for _ in range(12)]
    items = leaks.Items([(i, " ".join(rng.choice(common) for _ in range(rng.randint(1, 40)))) for i in range(15)] + [(99, " ".join(pool))], 5, 10)
    texts = [" ".join(rng.choice(common) for _ in range(rng.randint(0, 60))) for _ in range(30)]
    codes, bounds = items.letters.joined(texts)
    array = leaks.SuffixArray(items.letters.keys(codes), items)
    plain = [tuple(codes[a : b - 1].tolist()) for a, b in zip(bounds, bounds[1:])]
    suffixes = np.arange(len(items.item))
    for sizes in (items.seed, np.where(items.long > 0, items.long, items.seed)):
        got = sorted(zip(*(x.tolist() for x in array.met(suffixes, sizes))))
        want = []
        passages = {i: tuple(items.letters.code[[ord(c) for c in "".join(w)]].tolist()) for i, w in enumerate(items.words)}
        for s in suffixes.tolist():
            begin = int(items.starts[items.item[s]][items.word[s]])
            query = passages[int(items.item[s])][begin : begin + int(sizes[s])]
            want += [(s, int(bounds[d]) + p) for d, t in enumerate(plain) for p in range(len(t) - len(query) + 1) if t[p : p + len(query)] == query]
        assert got == sorted(want)


CLEAN = ["Le répertoire imprimé précise la légère erreur.", "Fußgängersteg über der Brücke", "Таблица продолжена на листе", "the old bridge on a map"] * 200


def test_garbled_text():
    r = garbled.Repairer(model(CLEAN))
    good = "répertoire imprimé"
    for wrong in (good.encode().decode("latin-1"), good.encode().decode("cp1252").encode().decode("cp1252"), good.encode().decode("cp437")):
        assert r.repair(wrong) == good
    assert r.repair("Таблица".encode("cp1251").decode("latin-1")) == "Таблица"
    assert r.repair("légère erreur") is None and r.repair("plain") is None
    assert garbled.from_codes("d��j��", [100, 233, 106, 224]) == "déjà" and garbled.from_codes("d�", None) is None


def test_garbled_words_that_the_statistics_hold_for_sound(spark):
    good, bad = "Podpis na druhé straně chybí", "Podpis na druhé stranì chybí"
    rows = [(1, 1, i, good, None, False) for i in range(900)] + [(2, 1, i, bad, None, False) for i in range(300)]
    rows += [(3, 1, i, "Œuvre complète à Gênes", None, False) for i in range(300)]
    rows += [(4, 1, 1, "ошибку Б формуле", list(map(ord, "ошибку в формуле")), True), (4, 1, 2, "ошибку в формуле", list(map(ord, "ошибку Б формуле")), True), (4, 1, 3, None, [65, None], None)]
    rows += [(5, 1, i, "ошибку в формуле", None, None) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, page int, seq int, text string, char_codes array<long>, font_is_buggy boolean")
    got = {(r.doc_id, r.seq): r.original for r in garbled.restore_texts(df, ["doc_id", "page", "seq"], "text", "char_codes", buggy="font_is_buggy").collect()}
    assert got == {(2, i): good for i in range(300)} | {(4, 1): "ошибку в формуле"}


@pytest.mark.parametrize("read_with, written_in, least", [("latin-1", "utf-8", 0.97), ("cp1252", "utf-8", 0.97), ("cp437", "utf-8", 0.97), ("mac_roman", "cp1252", 0.9), ("cp437", "cp1252", 0.9), ("latin-1", "utf-16-le", 0.9)])
def test_restored_texts_equal_those_that_were_garbled(read_with, written_in, least):
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist() if t]
    lines = list(dict.fromkeys(x.strip() for t in texts for x in t.split("\n") if not garbled.DOUBTFUL.search(x)))
    repairer = garbled.Repairer(model(lines))
    tried = good = 0
    for line in [x for x in lines if 20 < len(x) < 120 and sum(c.isalpha() and c > "\x7f" for c in x) > 1 and not any(c > "\u2fff" for c in x)][:400]:
        try:
            wrong = line.encode(written_in).decode(read_with)
        except UnicodeError:
            continue
        if wrong != line:
            tried += 1
            good += repairer.repair(wrong) == line
    assert tried > 30 and good >= least * tried
    assert sum(repairer.repair(x) is not None for x in lines) <= 0.002 * len(lines)


def test_ascii_texts_can_be_garbled(spark):
    rows = [(1, 1, 1, "Hello world".encode("utf-16-le").decode("latin-1")), (1, 1, 2, "Hello world"), (1, 1, 3, "a\tb\r\n"), (1, 1, 4, "Hello".encode("utf-16-be").decode("utf-16-le")), (1, 1, 5, "lost\x1acharacter"), (1, 1, 6, None)]
    df = spark.createDataFrame(rows, "doc_id long, page int, seq int, text string")
    got = {r.seq: (r.original, r.restored) for r in garbled.restore_texts(df, ["doc_id", "page", "seq"], "text").collect()}
    assert got == {1: ("Hello world", True), 4: ("Hello", True), 5: ("lost\x1acharacter", False)}


def test_maximal_segments_against_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        scores = [rng.choice([-3, -2, -1, 1, 2, 3]) for _ in range(rng.randint(0, 14))]
        want, todo = [], [(0, len(scores))]
        while todo:  # the greatest sum first (of these the shortest), then left and right of it
            a, b = todo.pop()
            best = max(((sum(scores[i:j]), i - j, -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
            if best[0] > 0:
                i, j = -best[2], -best[2] - best[1]
                want.append((i, j))
                todo += [(a, i), (j, b)]
        assert garbled.improbable_runs(np.array(scores, float)) == sorted(want)


def test_one_form():
    n = lookalikes.Normalizer(model(CLEAN))
    assert n.normalize("thе оld bridgе") == "the old bridge"
    assert n.normalize("ｏｌｄ ﬁne é​") == "old fine é"
    assert n.normalize("օn а mар") == "on a map" and n.normalize("Ꭺ map") == "A map"
    for same in ("Հայերեն տեքստ", "Таблица на листе", "x² ½ № ™ “q” — a", "plain", "日本語（テスト）。"):
        assert n.normalize(same) == same


def test_pairs():
    assert all(map(pairs.is_empty, [None, "", " ​", "…", "N/A", "[no answer]", "null", "<your answer here>", "[No answer provided.]"])) and not pairs.is_empty("0") and not pairs.is_empty("No")
    assert not pairs.is_empty("(not the mayor)") and not pairs.is_empty("[sic]")
    q = "Which company supplied the copper pipes?"
    assert pairs.copies(q, "Question: " + q + " Answer:") and pairs.copies(q, "which company  supplied the copper pipes") and not pairs.copies(q, "The copper pipes were supplied by Karo Ltd.")
    assert pairs.broken_delimiters("He writes: “I am") and not pairs.broken_delimiters("(a) “b”")


@pytest.mark.parametrize("text", [
    "I’m sorry, but I can’t help with that.", "Je ne suis pas en mesure de lire cette page.", "That falls outside what I am allowed to discuss.", "Mi dispiace, non posso rispondere.",
    "I have to pass on this one.", "As an AI, I cannot say.", "Mes consignes m’interdisent de répondre.", "Ich habe leider keinen Zugang zu dieser Datei.", "No veo ningún archivo por mi parte.", "Não posso responder a isso.",
])
def test_refusals(text):
    assert pairs.declines(text)


@pytest.mark.parametrize("text", [
    "In my view the harvest that year was not good.", "I was never told about the meeting, so I went home.", "My father worked there and nothing changed.", "The letter says: “I am unable to answer.”",
    "The claim cannot be processed.", "Der Brief sagt, dass Karo die Summe leider nicht zahlen kann, im nördlichen Bezirk.", "I could not see the bridge from the house.", "I read the file and found no errors.",
])
def test_no_refusals(text):
    assert not pairs.declines(text)


def test_no_copy_is_refused_beforehand():
    rng = random.Random(11)
    letters = "abcdeé ШñＡ日½-:."
    questions, answers = [], []
    for _ in range(3000):
        q = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        a = ""
        while len(a) < 0.9 * len(q):
            at, size = rng.randint(0, max(0, len(q) - 6)), rng.randint(5, 9)
            a += q[at : at + size] if rng.random() < 0.93 else rng.choice(letters)
            if not q:
                break
        questions.append(q)
        answers.append(rng.choice(["", "Q: ", "Antwort: "]) + a + rng.choice(["", " A:"]))
    may = pairs.may_copy(questions, answers)
    taken = [pairs.copies(q, a) for q, a in zip(questions, answers)]
    assert sum(taken) > 300 and all(m for m, t in zip(may, taken) if t) and 3 * sum(map(bool, may)) < 4 * sum(taken)


def test_steps_of_many_texts_are_those_of_each():
    lexicon = pairs.Lexicon([("report", "en", 600), ("the", "en", 900)])
    texts = ["The report, p. 4. Karo Ltd says", "", "... The report!?  U.S. the", "x y", ".", "the report"]
    one = [x for t in texts for x in lexicon.read.walk([t]).tolist()]
    assert lexicon.read.walk(texts).tolist() == one and one.count(0) == len(texts)
    assert lexicon.read.walk(["the. report"]).tolist() == [1, 1, 1, 1, lexicon.ids["the"], 2, 1, 1, 1, 1, lexicon.ids["report"], 0]


def test_defects(spark):
    rows = [("q", i, "Where was it?", f"The hearing took place in Town{i % 7}, in the basement of the hall.") for i in range(200)]
    rows += [("q", 900, "Where was it?", None), ("q", 901, "Where was it?", "The hearing took place in Town1, in the"), ("q", 902, None, "The hearing took place in Town1, in the basement of the hall"), ("q", 900, "Where was it?", None)]
    got = {(r.row_id, r.defect) for r in pairs.find_defects(spark.createDataFrame(rows, "origin string, row_id long, question string, answer string")).collect()}
    assert got == {(900, "empty"), (901, "truncated")}


def test_question_whose_stopwords_are_shared(spark):
    assert pairs.question_language("¿Cuántas muestras contiene la tabla 3?") == "es" and pairs.question_language("Quelle est la date de la lettre ?") == "fr"
    rows = [("q", i, "How many samples does the table list?", f"The table lists a total of {i} samples of the river water.") for i in range(200)]
    rows += [("q", 1000 + i, "¿Cuántas muestras contiene la tabla 3?", f"Según el acta, las muestras de agua del río son {i} en total.") for i in range(200)]
    rows += [("q", 2000, "¿Cuántas muestras contiene la tabla 3?", "The table lists a total of 51 samples of the river water.")]
    got = {(r.row_id, r.defect) for r in pairs.find_defects(spark.createDataFrame(rows, "origin string, row_id long, question string, answer string")).collect()}
    assert got == {(2000, "language")}
    lexicon = pairs.Lexicon([("samples", "en", 600), ("muestras", "es", 600), ("agua", "es", 200), ("water", "en", 200), ("the", "en", 50), ("los", "es", 50)])
    assert set(lexicon.langs) == {"en", "es"}
    assert lexicon.question_language("Muestras, tabla 7?") == "es" and lexicon.question_language("Karo, Lin?") == ""


def _lexicon():
    words = {"season": 4000, "paper": 3000, "third": 3000, "council": 3000, "second-hand": 500, "timetable": 900, "Korland": 20}
    return scans.Lexicon(list(words), list(words.values()), 1_000_000)


def test_misreadings():
    lexicon = _lexicon()
    assert [lexicon.repair(w) for w in ("seasori", "tliird", "coiincil", "papcr", "season", "Korland", "KX-416")] == ["season", "third", "council", "paper", None, None, None]


def test_rare_words_are_repaired():
    words = {"vineyard": 14, "Korland": 14, "vine": 14}
    lexicon = scans.Lexicon(list(words), list(words.values()), 1_000_000)
    assert [lexicon.repair(w) for w in ("vineyord", "Korlond", "vinc", "vineyard")] == ["vineyard", None, None, None]


def test_forms_misread_often_in_proportion():
    words = {"Summary": 2880, "Siimmary": 110, "Summory": 100, "práctica": 317, "práctico": 58, "Karten": 187, "Kanten": 8, "ejercicio": 900}
    lexicon = scans.Lexicon(list(words), list(words.values()), 1_000_000, {("ejercicio", "práctico"): 30, ("guía", "práctica"): 90})
    assert [lexicon.judge("", w, "") for w in ("Siimmary", "Summory", "práctico", "Kanten", "Summary")] == ["Summary", "Summary", None, None, None]
    assert lexicon.judge("ejercicio", "práctico", "") is None and lexicon.judge("guía", "práctico", "") == "práctica"
    assert scans.confused_once("Material", "Maferial") and scans.confused_once("Bulletin", "Bulletm") and not scans.confused_once("Summary", "Sumnary")


def test_page_of_a_scan():
    reader = scans.Reader(_lexicon())
    texts = ["Annual Report 2001", "a revised time-", "table for the tliird season and a second-", "hand council", "3"]
    kinds, fixed = reader.page(texts, 3, frozenset({scans.title_key("Annual Report 2001")}), frozenset())
    assert kinds == [{"header"}, {"hyphen"}, {"misread"}, set(), {"page_number"}]
    assert scans.paragraphs(kinds, fixed) == ["a revised timetable for the third season and a second-hand council"]
    assert reader.page([], 1, frozenset(), frozenset()) == ([], [])
    assert scans.number_of("— iv —") == (4, True) and scans.number_of("body 12 text") is None

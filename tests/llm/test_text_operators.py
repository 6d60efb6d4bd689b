from __future__ import annotations

import math
import random
import re
import time
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from caseflow.llm import decontaminate as D
from caseflow.llm import language as G
from caseflow.llm import pii
from caseflow.llm import quality as Q
from caseflow.llm import spans as N
from caseflow.llm import toxicity as T
from caseflow.llm.training import held_out

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


ODD = [(1, None), (2, ""), (3, "$$$ 123"), (None, "x"), (4, "x"), (4, "x"), (5, "word " * 100_000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1.0, 2) for i, t in ODD], "doc_id long, text string, lang string, source string, score double, label int")


def accuracy(found, labels, column):
    rows = found.where("held_out").join(labels, "doc_id").select("predicted", column).collect()
    return sum(r.predicted == r[column] for r in rows) / len(rows)


def test_held_out(spark):
    rows = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)


# ---------------------------------------------------------------- quality and toxicity


def test_quality(docs, labels):
    found = Q.score_quality(docs, labels)
    assert found.count() == docs.count()
    assert accuracy(found, labels, "quality") >= 0.9


def test_toxicity(docs, labels):
    found = T.score_toxicity(docs, labels)
    assert found.count() == docs.count() and found.where("score < 0 or score > 1").count() == 0
    assert accuracy(found, labels, "toxic") >= 0.94


@pytest.mark.parametrize("score", [Q.score_quality, T.score_toxicity])
def test_odd_rows(odd, labels, score):
    assert score(odd, labels).count() == len(ODD)
    empty = labels.limit(0)
    assert score(odd, empty).where("score between 0 and 1").count() == len(ODD)
    assert score(odd.limit(0), empty).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_is_exact():
    rng = random.Random(2)
    terms = ["scum", "idiot", "moron", "pathetic", "disgusting"]
    a = T.LexiconAutomaton(terms)
    for _ in range(3000):
        word = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randrange(2)] = [rng.choice("aeidmots")] * rng.randrange(2)
        word = "".join(word)
        want = min(((levenshtein(word, t), t) for t in terms if levenshtein(word, t) <= T.edits_allowed(t)), default=None)
        assert a.match(word) == want, word


def test_stems():
    a = T.LexiconAutomaton(["idiot"], ["scu"])
    assert a.match("scuffle") == (0, "scu") and a.match("idiot") == (0, "idiot") and a.match("xscu") is None


def test_quotation_weighs_less():
    m = T.ToxicityModel(["idiot"], set(), [], 0.0, [0.0] * len(T.CLASSES))
    assert m.severity("you idiot")[0] == 1.0
    assert m.severity('they wrote the word “idiot” here')[0] == T.QUOTED
    assert m.severity("you idiiot")[0] == T.EDIT_WEIGHT[1]


def test_contexts_against_counting(spark):
    rows = [(1, "You scum, you SCUM! a_b é2", 1), (2, "scum you scum", 0), (3, "", 0), (4, "you you", 0)]
    got = {r.term: (r.toxic, r.clean) for r in T.term_counts(spark.createDataFrame(rows, "id long, text string, label int")).collect()}
    want: dict = {}
    for _, text, label in rows:
        words = re.findall(r"\w+", text.lower())
        for before, term in zip([None, *words], words, strict=False):
            want.setdefault(term, ({*()}, {*()}))[1 - label].add(before)
    assert got == {t: (len(a), len(b)) for t, (a, b) in want.items()}


def test_learning_a_long_text_takes_linear_time(spark):
    rows = [(1, " ".join(f"w{k}" for k in range(200_000)), 1), (2, "clean words", 0)]
    began = time.monotonic()
    assert T.term_counts(spark.createDataFrame(rows, "id long, text string, label int")).count() == 200_002
    assert time.monotonic() - began < 60


@pytest.mark.parametrize("seed", range(5))
def test_calibration_is_isotonic_regression(seed):
    """Pooled rates against the minimum-maximum formula."""
    rng = random.Random(seed)
    seen = [(n := rng.randrange(40), rng.randrange(n + 1)) for _ in T.CLASSES]
    prior = [0.02, *(c / (c + 0.35) for c in T.CLASSES[1:])]
    n = [a + T._PRIOR_ROWS for a, _ in seen]
    y = [(b + T._PRIOR_ROWS * p) / m for (_, b), p, m in zip(seen, prior, n, strict=True)]
    mean = lambda i, j: sum(a * b for a, b in zip(y[i : j + 1], n[i : j + 1], strict=True)) / sum(n[i : j + 1])
    k = len(y)
    want = [max(min(mean(i, j) for j in range(at, k)) for i in range(at + 1)) for at in range(k)]
    assert T.calibrate(seen) == pytest.approx(want)


def test_lexicon_of_rare_terms(spark):
    """A term of few documents is learned in a large sample as in a small one."""
    rng = random.Random(9)
    plain = lambda: " ".join(f"word{rng.randrange(300)}" for _ in range(40))
    rows = [(k, plain() + (f" such a{k} zorgblat" if k < 12 else f" b{k} common" if k < 300 else ""), int(k < 300)) for k in range(6000)]
    model = T.learn(spark.createDataFrame(rows, "id long, text string, label int"))
    assert {"zorgblat", "common"} <= set(model.terms) and model.severity("you zorgblat")[0] == 1.0


def test_automaton_begins_again(monkeypatch):
    monkeypatch.setattr(T, "STATES_KEPT", 3)
    a, b = T.LexiconAutomaton(["pathetic", "idiot"]), T.LexiconAutomaton(["pathetic", "idiot"])
    b_match = [b.match(w) for w in ("pathetic", "pathetik", "idio", "dog")]
    assert [a.match(w) for w in ("pathetic", "pathetik", "idio", "dog")] == b_match == [(0, "pathetic"), (1, "pathetic"), (1, "idiot"), None]


# ---------------------------------------------------------------- language


def test_language(docs):
    found = G.identify_languages(docs).join(docs.select("doc_id", F.col("lang").alias("l")), "doc_id").where("held_out")
    assert found.where("lang_pred = l").count() / found.count() >= 0.98


def test_language_of_odd_rows(odd, docs):
    got = {r.doc_id: (r.lang_pred, r.score) for r in G.identify_languages(docs.unionByName(odd.select(F.col("doc_id") + 10**6, "text", "lang", "source").toDF("doc_id", "text", "lang", "source").withColumn("n_chars", F.lit(0).cast("long")))).where("doc_id >= 1000000").collect()}
    assert [got[10**6 + k] for k in (1, 2, 3)] == [("und", 0.0)] * 3
    assert got[10**6 + 5][0] != "und"
    assert G.identify_languages(odd.limit(0)).count() == 0
    assert {r.doc_id for r in G.keep_identified(docs.limit(50)).collect()} <= {r.doc_id for r in docs.collect()}


def test_distances_against_counting():
    """The nearest language by distances that are summed gram by gram."""
    texts = {"a": "the cat and the dog ran over the hill and the house", "b": "der hund und die katze und das haus auf dem berg", "c": "le chat et le chien sur la colline et la maison"}
    profiles = {k: G.ranked(t, 30).tolist() for k, t in texts.items()}
    matcher = G.Matcher(profiles, 30)
    for text in ["the hound and the hills", "und der berg", "la maison et le chat", "xyz", *texts.values()]:
        own = G.ranked(text).tolist()
        far = {k: sum(abs(p.index(g) - at) if g in p else 30 for at, g in enumerate(own)) for k, p in profiles.items()}
        best = min(far, key=lambda k: (far[k], k))
        assert matcher.best(text) == (best, pytest.approx(max(0.0, 1 - far[best] / (30 * len(own)))))


def test_a_rare_language_is_learned(spark, docs):
    rare = [(10**7 + k, "zzaq qqoz uuvv zzaq oqzz vvuz", "zz") for k in range(9)]
    many = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rare, "doc_id long, text string, lang string"))
    got = G.identify_languages(many, rows=40).where("doc_id >= 10000000").select("lang_pred").distinct().collect()
    assert [r[0] for r in got] == ["zz"]


def test_ranks_against_counting():
    text = "abc, ABC abd!"
    grams = {}
    for w in ("abc", "abc", "abd"):
        p = "_" + w + "_"
        for n in (1, 2, 3):
            for i in range(len(p) - n + 1):
                g = p[i : i + n]
                if g.strip("_"):
                    grams[g] = grams.get(g, 0) + 1
    code = lambda g: sum((G._EDGE if c == "_" else ord(c)) << (42 - 21 * k) for k, c in enumerate(g))
    want = [code(g) for g in sorted(grams, key=lambda g: (-grams[g], code(g)))]
    assert G.ranked(text).tolist() == want


# ---------------------------------------------------------------- PII


@pytest.mark.parametrize(
    ("kind", "value"),
    [("email", "Jo.12@mail3.example.com"), ("number", "4111 1111 1111 1111"), ("number", "4845168114407329"), ("ip", "97.51.17.173"), ("date", "2024-02-29"), ("date", "31/12/1999"), ("phone", "+1 (017) 555-7713"), ("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962"), ("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "123-45-6789"), ("ssn", "987-65-4321"), ("date", "12/25/1980"), ("phone", "555.123.4567"), ("worddate", "March 5, 1980"), ("worddate", "5 de marzo de 1980"), ("worddate", "29 février 2024")],
)
def test_pseudonyms_keep_format_and_invert(kind, value):
    p = pii.Pseudonyms("key")
    fresh = p.value(kind, value)
    assert fresh != value and p.value(kind, fresh, back=True) == value and pii.Pseudonyms("other").value(kind, value) != fresh
    if kind == "iban":
        own = fresh.replace(" ", "")
        assert pii.iban_check(own[:2], own[4:]) == own[2:4]
    if kind == "ssn":
        assert pii._valid_ssn(fresh.replace("-", "")) == pii._valid_ssn(value.replace("-", ""))
    if kind == "number":
        digits = fresh.replace(" ", "")
        assert pii.luhn_valid(digits) == pii.luhn_valid(value.replace(" ", ""))


def test_feistel_is_a_permutation():
    f = pii.Feistel("k")
    for size in (2, 7, 100, 1000):
        assert sorted(f.permute("t", x, size) for x in range(size)) == list(range(size))


def test_pii_rows(spark, odd):
    forms = "born 12/25/1980 or March 5, 1980, call 555.123.4567, 30 February 1980 and 13/13/2000 stay"
    masked, n, spans = pii.Pseudonyms("k").replace(forms)
    assert n == 3 and [k for k, _, _ in spans] == ["date", "worddate", "phone"] and masked.endswith("30 February 1980 and 13/13/2000 stay")
    df = spark.createDataFrame([(1, "mail jo.1@x.example or 2024-13-45 now"), (2, "again jo.1@x.example!"), (3, "nothing")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    one, two = ([r.text[s.start : s.end] for s in r.spans] for r in (got[1], got[2]))
    assert one == two and "jo.1@" not in got[1].text and "2024-13-45" in got[1].text and got[3].text == "nothing"
    assert {(r.doc_id, r.text) for r in pii.pseudonymise(odd, "k").collect()} == {(i, t) for i, t in ODD}
    clash = odd.select("doc_id", "text", "lang").toDF("_pseudonyms", "text", "TEXT")
    kept = pii.with_pseudonyms(clash, "k")
    assert kept.columns == clash.columns and {(r[0], r[1], r[2]) for r in kept.collect()} == {(i, t, "en") for i, t in ODD}
    assert pii.pseudonymise(odd.limit(0), "k").count() == 0


# ---------------------------------------------------------------- spans


def brute_pieces(text):
    """(words, ends of pieces, spans as (first word, last word + 1)) by the rules of the operator, word by word."""
    words = [m.group() for m in re.finditer(r"\S+", text)]
    n = len(words)
    if not n:
        return words, [], []
    stop = [bool(re.search(r"[.!?\u2026][\"'\u2019\u201d\u00bb)\]]*$", w)) for w in words]
    rank = [(not e, xxhash.xxh3_64_intdigest(w.lower().encode()) & (1 << 63) - 1) for w, e in zip(words, stop, strict=True)]
    sentence = {k + 1 for k in range(n) if stop[k]} | {n}
    local = sentence | {1 + max((k for k in range(i, i + N.STEP) if rank[k] == min(rank[i : i + N.STEP]))) for i in range(n - N.STEP + 1)}
    line = set(sentence)
    for m in re.finditer("\n", text):
        line.add(len(re.findall(r"\S+", text[: m.start()])))
    line.discard(0)
    ends = sorted(local | line)

    def run(begin, stops, count, size):
        return next((e for e in sorted(stops) if e >= begin + size and sum(begin < x <= e for x in stops) >= count), None)

    found = []
    for begin in [0, *ends[:-1]]:
        long = min((e for e in (run(begin, local, 1, N.LONG), run(begin, sentence, N.SENTENCES, N.WORDS)) if e), default=None)
        short = run(begin, line, N.SENTENCES, N.WORDS)
        found += [(begin, e) for e in {long, short if short and (not long or short < long) else None} if e]
    return words, ends, found


def brute_spans(rows):
    """Every span's words are looked up in all rows before; equal rows come one after another."""
    seen, out = {}, []
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[2]))
    for row, (i, text, _) in enumerate(order):
        if text is None:
            out.append((i, None))
            continue
        words, ends, found = brute_pieces(text)
        cut = set()
        for begin, end in sorted(found):
            mark = tuple(w.lower() for w in words[begin:end])
            if seen.setdefault(mark, (row, begin)) != (row, begin):
                cut |= set(range(begin, end))
        at = [m.start() for m in re.finditer(r"\S+", text)] + [len(text)]
        pieces = [text[0 if a == 0 else at[a] : at[b] if b < len(words) else len(text)] for a, b in zip([0, *ends], ends, strict=False)]
        out.append((i, "".join(p for p, a in zip(pieces, [0, *ends], strict=False) if a not in cut) if words else text))
    return sorted(out, key=repr)


def with_hashes(df):
    return [tuple(r) for r in df.select("doc_id", "text", F.xxhash64("text")).collect()]


def test_spans_match_brute_force(docs):
    some = docs.where("length(text) < 3000")
    got = sorted(((r.doc_id, r.text) for r in N.remove_repeats(some).collect()), key=repr)
    assert got == brute_spans(with_hashes(some))


def test_rows_of_one_id_are_documents_of_their_own(spark):
    rng = random.Random(11)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" + "." * (k % 9 == 8) for k in range(n))
    passage, only = words(60), words(70)
    rows = [(1, f"{words(20)}. {passage}"), (2, f"{passage} {words(20)}"), (2, only), (3, only), (3, only), (3, only), (4, f"a {only}"), (5, None), (5, None), (None, only), (None, only)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id int, text string, key int, cut int")
    got = sorted(((r.doc_id, r.text) for r in N.remove_repeats(df).where("doc_id is not null").collect()), key=repr)
    assert got == brute_spans(with_hashes(df))
    assert (2, only) in got and sum(1 for i, t in got if i == 3 and len(t) < len(only) / 3) == 3
    assert [r.text for r in N.remove_repeats(df).where("doc_id is null").collect()] == [only, only]
    text_ids = N.remove_repeats(df.withColumn("doc_id", F.col("doc_id").cast("string")))
    assert sorted(((r.doc_id and int(r.doc_id), r.text) for r in text_ids.collect() if r.doc_id), key=repr) == got


def test_spans_catch_a_passage_mid_sentence(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = words(60)
    df = spark.createDataFrame([(1, f"{words(30)}. {passage} {words(20)}."), (2, f"{words(9)} {passage} {words(30)}."), (3, words(80))], "doc_id long, text string")
    got = {r.doc_id: r for r in N.remove_repeats(df).collect()}
    assert got[1].n_removed == got[3].n_removed == 0 and got[2].chars_removed > 0.5 * len(passage)


@pytest.mark.parametrize("marks", [0, 0.05, 0.2])
def test_spans_hold_passages_at_any_offset(spark, marks):
    rng = random.Random(7)
    words = lambda n: [f"w{rng.randrange(10**6)}" + "." * (rng.random() < marks) for _ in range(n)]
    rows, passages = [], {}
    for k in range(100):
        passage = words(51)
        rows += [(k, " ".join(words(rng.randrange(60)) + passage + words(rng.randrange(60))))]
        rows += [(1000 + k, " ".join((lead := words(rng.randrange(60))) + passage + (tail := words(rng.randrange(60)))))]
        passages[1000 + k] = (set(passage), set(lead + tail))
    got = {r.doc_id: r for r in N.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lost = [len(p - set(got[i].text.split())) / 51 for i, (p, _) in passages.items()]
    assert min(lost) >= 0.4 and sum(lost) / len(lost) >= 0.78
    assert all(own <= set(got[i].text.split()) for i, (_, own) in passages.items()) and all(got[k].n_removed == 0 for k in range(100))


def test_spans_of_scripts_without_spaces(spark):
    rng = random.Random(5)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9F00)) + "。" * (rng.random() < 0.1) for _ in range(n))
    passage = han(80)
    df = spark.createDataFrame([(1, han(20) + passage + han(9)), (2, han(13) + passage + han(30))], "doc_id long, text string")
    got = {r.doc_id: r for r in N.remove_repeats(df).collect()}
    assert got[1].n_removed == 0 and 0.6 * len(passage) < got[2].chars_removed <= len(passage)


def test_spans_of_odd_rows(odd):
    got = [(r.doc_id, r.text) for r in N.remove_repeats(odd).collect()]
    assert sorted((x for x in got if x[0] != 5), key=repr) == sorted((x for x in ODD if x[0] != 5), key=repr)
    long = next(t for i, t in got if i == 5)  # a word that repeats without end: only its first span stays
    assert 0 < len(long.split()) <= N.LONG + N.STEP and set(long.split()) == {"word"}
    assert N.remove_repeats(odd.limit(0)).count() == 0
    assert "".join(p for p, _ in N.sentences("A b. C\n\nd " * 50 + "x " * 90)) == "A b. C\n\nd " * 50 + "x " * 90


# ---------------------------------------------------------------- decontamination

ITEM = "In the town of Velden a train leaves Station Alder at 60 km and meets Peter after 45 minutes on the long bridge over water"


def test_decontamination(spark, odd):
    bench = spark.createDataFrame([(7, ITEM), (8, "too short"), (9, None), (None, ITEM)], "item_id long, text string")
    changed = ITEM.replace("60", "75").replace("45", "30").replace("Peter", "Karla")
    wrong = ITEM.replace("In the town of Velden a train leaves Station Alder at 60 km and meets Peter", "In the town of Velden a bus takes Station Alder")
    rows = [(1, f"Intro words here. {ITEM}. Tail."), (2, f"x y z. {changed}"), (3, "nothing of that kind at all in this one"), (4, ITEM[: len(ITEM) // 4]), (6, None), (10, wrong)]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, item_id string")
    got = {r.doc_id: (r.items, r.changed_slots) for r in D.contaminated_documents(df, bench).collect()}
    assert got == {1: ([7], False), 2: ([7], True)}
    assert {r.doc_id for r in D.contaminated(df, bench, broadcast_windows=0).collect()} == {1, 2}
    assert sorted(r.doc_id for r in D.remove_contaminated(df, bench).collect()) == [3, 4, 6, 10]
    assert sorted(r.doc_id for r in D.remove_contaminated(df, bench, broadcast_ids=0).collect()) == [3, 4, 6, 10]
    assert D.contaminated(odd, bench).count() == 0 and D.contaminated(df, bench.limit(0)).count() == 0 and D.contaminated(df.limit(0), bench).count() == 0
    clash = df.toDF("doc_id", "text", "TEXT", ) if len(df.columns) == 3 else df
    assert D.remove_contaminated(clash, bench).columns == clash.columns
    assert {r.doc_id for r in D.contaminated(df.withColumn("doc_id", F.col("doc_id").cast("string")), bench).collect()} == {"1", "2"}


def test_items_of_one_template_are_one_class(spark):
    ask = "What is the sum of {} and {} if you also add {} to it in the end"
    rows = [(k, ask.format(k, k + 1, k)) for k in range(5, 60)] + [(99, ask.format(3, 3, 3)), (100, "an entirely different question that nobody will ever ask you")]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    classes = {r.item_id: r.stands_for for r in D.item_classes(bench).collect()}
    assert classes == {**dict.fromkeys(range(5, 60), 5), 99: 99, 100: 100}
    df = spark.createDataFrame([(1, ask.format(700, 800, 700)), (2, ask.format(8, 8, 8)), (3, "What is that")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.contaminated(df, bench).collect()} == {(1, 5), (2, 5), (2, 99)}
    assert {(r.doc_id, r.item_id) for r in D.contaminated(df, bench, broadcast_windows=0).collect()} == {(1, 5), (2, 5), (2, 99)}


def test_names_that_begin_sentences(spark):
    item = "Anna has some red apples. Anna gives three of them away. Anna eats what is left. Bella watches her all day"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = spark.createDataFrame([(1, item.replace("Anna", "Karla").replace("Bella", "Dora")), (2, item.lower()), (3, "so " + item)], "doc_id long, text string")
    assert {r.doc_id: r.changed_slots for r in D.contaminated_documents(df, bench).collect()} == {1: True, 2: False, 3: False}


def test_contradictory_slots_dont_match(spark):
    item = "mix 3 cups then add 3 cups and stir 4 cups with care for long"
    clash = item.replace("add 3", "add 9")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = spark.createDataFrame([(1, item.replace("3", "5")), (2, clash)], "doc_id long, text string")
    assert {r.doc_id for r in D.contaminated(df, bench).collect()} == {1}


def test_items_with_some_changed_slots_and_exact_items(spark):
    long = "In the shop there are 5 apples in a red box near the old door while the keeper who came from the far north has put away all of the bread and then counts 5 pears on a shelf"
    pair = "mix 3 cups then add 4 cups and stir with care for a long while"
    sums = "3 + 4 = 7, 5 + 6 = 11, 9 + 9 = 18, 2 + 1 = 3"
    bench = spark.createDataFrame([(1, long), (2, pair), (3, "name this bird"), (4, sums)], "item_id long, text string")
    rows = [(1, long.replace("5 apples", "7 apples").replace("5 pears", "9 pears")), (2, long.replace("5 pears", "9 pears")), (3, pair.replace("3", "6").replace("4", "6")), (4, "Please name this bird now."), (5, f"Solve {sums} at once"), (6, "name that bird"), (7, sums.replace("3", "8").replace("9", "2"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.contaminated(df, bench).collect()} == {(1, 1), (2, 1), (3, 2), (4, 3), (5, 4)}


def test_decontamination_against_containment(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    norm = lambda t: " ".join(t.lower().split())
    items = [norm(r.text) for r in bench.collect()]
    want = {r.doc_id for r in docs.collect() if any(x in norm(r.text) for x in items)}
    got = {r.doc_id for r in D.contaminated_documents(docs, bench).collect()}
    assert want <= got and len(got - want) <= 1


# ---------------------------------------------------------------- quality, against plain FTRL


def test_ftrl_against_plain_updates(spark):
    """Weights and scores against dictionaries of single coordinates, with the averages of the shards."""
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["good", "fine", "calm"] if k % 2 else ["buy", "now", "$$$"]) for _ in range(rng.randrange(1, 9))), k % 2) for k in range(40)]
    sample = spark.createDataFrame(rows, "id long, text string, label int")
    shards = {r.id: r.s for r in sample.select("id", F.pmod(F.xxhash64("id"), F.lit(3)).alias("s")).collect()}
    z, n = {}, {}

    def weight(z, n, k):
        a, b = z.get(k, 0.0), n.get(k, 0.0)
        return 0.0 if abs(a) <= Q.L1 else -(a - (1 if a > 0 else -1) * Q.L1) / ((Q.BETA + b**0.5) / Q.ALPHA + Q.L2)

    def inputs(text):
        at = Q.features(text, 1 << 12).tolist()
        return {k: 1.0 if k == 0 else 4 / max(1, len(at) - 1) ** 0.5 for k in at}

    for _ in range(2):
        dz, dn, used = {}, {}, set()
        for s in range(3):
            z1, n1 = dict(z), dict(n)
            for i, text, y in rows:
                if shards[i] == s:
                    used.add(s)
                    x = inputs(text)
                    w = {k: weight(z1, n1, k) for k in x}
                    p = 1 / (1 + math.exp(-sum(w[k] * x[k] for k in x)))
                    for k in x:
                        g = (p - y) * x[k]
                        sigma = ((n1.get(k, 0.0) + g * g) ** 0.5 - n1.get(k, 0.0) ** 0.5) / Q.ALPHA
                        z1[k] = z1.get(k, 0.0) + g - sigma * w[k]
                        n1[k] = n1.get(k, 0.0) + g * g
            for k in z1:
                dz[k] = dz.get(k, 0.0) + z1[k] - z.get(k, 0.0)
                dn[k] = dn.get(k, 0.0) + n1[k] - n.get(k, 0.0)
        for k in dz:
            z[k] = z.get(k, 0.0) + dz[k] / len(used)
            n[k] = n.get(k, 0.0) + dn[k] / len(used)
    weights = Q.train(sample, 2, 3, 1 << 12)
    assert {k: pytest.approx(weight(z, n, k)) for k in z if weight(z, n, k)} == {int(k): weights[k] for k in weights.nonzero()[0]}
    for _, text, _ in rows[:5]:
        x = inputs(text)
        assert Q._margin(weights, Q.features(text, 1 << 12)) == pytest.approx(sum(weight(z, n, k) * v for k, v in x.items()))

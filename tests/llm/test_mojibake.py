"""Garbled text: planted cases are found and restored, sound text is left alone."""

import random
from collections import Counter
from types import SimpleNamespace

import pandas as pd
import pytest

from tidelog.llm import mojibake

WORDS = {
    "de": "größe straße müssen für über später Übung wörter schließt öffnet tür häuser läuft schöne grün natürlich zurück".split(),
    "fr": "été déjà où façade élève œuvre garçon leçon forêt hôtel être très première préfère à çà fenêtre".split(),
    "ru": "город река нужно после каждый вопрос деревня старый новый первый объявление лето зима вода книга".split(),
    "cs": "příliš žluťoučký kůň úpěl ďábelské ódy řeka sníh mlýn každý včera později dítě číst štěstí".split(),
    "ja": "今日は 市場で 本を 読みます 電車が 来ました 天気が いい 手紙を 書く 東京に 行く".split(),
    "el": "καλημέρα νερό βιβλίο σπίτι δρόμος ποτάμι χειμώνας καλοκαίρι ερώτηση απάντηση".split(),
}
DOCS = "doc_id bigint, source string, text string, chain string, gain double, n_docs int"


def corpus(seed=1, n=900):
    """Sound pages, with punctuation and capitals, of several languages."""
    r, out = random.Random(seed), []
    for i in range(n):
        words = WORDS[r.choice(list(WORDS))]
        line = lambda: " ".join(r.choice(words) for _ in range(8)) + r.choice([".", "!", " – »x«", " “ok”", " 25 °C"])  # noqa: B023, E731
        out.append((i, f"host{i % 9}", "\n".join(line() if r.random() < 0.9 else line().upper() for _ in range(4))))
    return out


GARBLES = {
    100: lambda t: t.encode().decode("latin-1"),
    101: lambda t: mojibake.undo().written(t.encode(), "cp1252")[0],
    102: lambda t: "\n".join([t.split("\n")[0], *(mojibake.undo().written(x.encode(), "cp1252")[0] for x in t.split("\n")[1:])]),
    103: lambda t: mojibake.undo().written(mojibake.undo().written(t.encode(), "cp1252")[0].encode(), "cp1252")[0],
    104: lambda t: mojibake.undo().written(t.encode(), "cp1252")[0].replace("Ã", "&Atilde;").replace("Ð", "&#208;").replace("ã", "&#xE3;").replace("Î", "&Icirc;").replace("Å", "&Aring;"),
}
NATIVE = {"ru": "cp1251", "cs": "cp1250", "ja": "euc-jp", "el": "cp1253"}


def language(text):
    return max(WORDS, key=lambda k: sum(w in text.lower() for w in WORDS[k]))


@pytest.fixture(scope="module")
def planted():
    docs, truth, k = corpus(), {}, 200
    out = []
    for i, source, text in docs:
        new = text
        if i in GARBLES:
            new = GARBLES[i](text)
        elif k <= i < k + 40 and language(text) in NATIVE:
            new = mojibake.undo().written(text.encode(NATIVE[language(text)], "ignore"), "cp1252")[0]
        elif i in (300, 301):
            new = text[:60] + "�" + text[61:]
        elif i in (310, 311):
            new = text[:80] + "�"  # only cut
        if new != text and i not in (310, 311):
            truth[i] = text
        out.append((i, source, new, "c", 0.5, 3))
    return out, truth


def test_planted_cases_are_found_and_restored(spark, planted):
    rows, truth = planted
    extra = [(9001, None, None, None, None, None), (9002, "h", "", None, None, None), (9003, "h", "plain ascii &amp; more", None, None, None), (9004, None, "größe über tür", None, None, None), (None, "h", "grÃ¶ÃŸe", None, None, None)]
    df = spark.createDataFrame(rows + extra + rows[:5], DOCS)
    got = [r["doc_id"] for r in mojibake.garbled(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) >= set(truth) and len(set(got) - set(truth)) <= 2
    fixed = {r["doc_id"]: r["repaired"] for r in mojibake.repaired(df).collect()}
    assert set(fixed) == set(got)
    whole = [i for i in truth if i in GARBLES]
    words = lambda t: t.replace("\n", " ").split(" ")
    hits = sum(sum(a == b for a, b in zip(words(fixed[i]), words(truth[i]), strict=False)) for i in whole)
    assert hits > 0.9 * sum(len(words(truth[i])) for i in whole)


def test_steps_undo_known_readings():
    ways = {c: t for c, t, _ in mojibake.undo().chains("cafÃ©")}
    assert ways["utf-8>cp1252"] == "café"
    assert {c: t for c, t, _ in mojibake.undo().chains("Ïðèâåò")}["cp1251>cp1252"] == "Привет"
    assert {c: t for c, t, _ in mojibake.undo().chains("donâ€™t")}["utf-8>cp1252"] == "don’t"
    assert ("utf-8>cp1252+utf-8>cp1252", "crème") in {(c, t) for c, t, _ in mojibake.undo().chains("crÃƒÂ¨me")}  # among other ways by the same chain
    assert {c: t for c, t, _ in mojibake.undo().chains("\x93quote\x94")}["cp1252>latin-1"] == "“quote”"


def test_every_reading_that_can_encode_a_word_is_undone():
    """mac-roman has characters beyond U+2E80, and multi-byte encodings have some below."""
    assert {c: t for c, t, _ in mojibake.undo().chains("Stra\ufb02e")}["cp1252>mac-roman"] == "Straße"
    assert {c: t for c, t, _ in mojibake.undo().chains("работает".encode("cp1251").decode("mac-roman"))}["cp1251>mac-roman"] == "работает"
    assert {c: t for c, t, _ in mojibake.undo().chains("😀".encode().decode("mac-roman"))}["utf-8>mac-roman"] == "😀"
    greek = "テスト".encode("euc-jp").decode("cp949")
    assert max(greek) < "\u2e80" and {c: t for c, t, _ in mojibake.undo().chains(greek)}["euc-jp>cp949"] == "テスト"


def test_lost_characters_stay_lost():
    assert {c: t for c, t, _ in mojibake.undo().chains("g�zel sarý")}["cp1254>cp1252"] == "g�zel sarı"


def test_long_words_are_read_to_their_end(spark):
    """Words end at spaces only, so a whole line may be one: garbled from where on doesn't matter."""
    r = random.Random(5)
    sound = "\t".join(r.choice(WORDS["de"]) for _ in range(60))
    lines = {1: "https://example.org/a," * 50 + sound, 2: "x" * 1_000 + "\t" + sound}
    garbled = {i: t[: -len(sound)] + sound.encode().decode("latin-1") for i, t in lines.items()}
    base = [(i + 100, "c", text, "", 0.0, 1) for i, _, text in corpus(2, 300)] + [(i + 10, "d", t, "", 0.0, 1) for i, t in lines.items()]
    df = spark.createDataFrame(base + [(i, "d", t, "", 0.0, 1) for i, t in garbled.items()], DOCS)
    fixed = {r["doc_id"]: r["repaired"] for r in mojibake.repaired(df).collect()}
    assert {i: fixed.get(i) for i in lines} == lines and not {11, 12} & set(fixed)


def test_garbled_text_after_any_length_of_other_text_without_spaces(spark):
    """The run before it may be of another script, which the wrong reading can't give, and of any length."""
    sound = " ".join(WORDS["de"]).replace(" ", "/")
    bad = sound.encode().decode("latin-1")
    before = {1: "x" * 700, 2: "город" * 150, 3: "読みます" * 200, 4: "y" * 100_000, 5: "город" * 20_000}
    base = [(i + 100, "c", text, "", 0.0, 1) for i, _, text in corpus(4, 300)] + [(i + 10, "d", t + sound, "", 0.0, 1) for i, t in before.items()]
    df = spark.createDataFrame(base + [(i, "d", t + bad, "", 0.0, 1) for i, t in before.items()], DOCS)
    fixed = {r["doc_id"]: r["repaired"] for r in mojibake.repaired(df).collect()}
    assert {i: fixed.get(i) for i in before} == {i: t + sound for i, t in before.items()} and not {i + 10 for i in before} & set(fixed)


def test_a_short_text_with_a_lost_byte_is_read_back():
    """What was lost is weighed against what could be read, at any length."""
    word = "größe über".encode().decode("latin-1")
    for text in (word[:-5] + word[-4:], "Ã¶Ã", ("Ã¶" * 50) + "Ã"):
        assert any(c.startswith("utf-8>") and "ö" in t for c, t, _ in mojibake.undo().chains(text))
    assert not any(c.startswith("utf-8>") for c, _, _ in mojibake.undo().chains("été"))


def test_repair_keeps_sound_parts_as_they_are(spark):
    """References in sound words stay references, and a field without garbling isn't touched by the chains of another."""
    base = [(i + 100, "c", text, "", 0.0, 1) for i, _, text in corpus(6, 300)]
    bad = " ".join(WORDS["de"]).encode().decode("latin-1")
    text = f"head &amp;lt;b&gt; größe\n&lt;i&gt; {bad} caf&eacute; &amp;amp;\ntail &#233;t&#233;"
    fixed = {r["doc_id"]: r["repaired"] for r in mojibake.repaired(spark.createDataFrame([*base, (1, "d", text, "", 0.0, 1)], DOCS)).collect()}
    assert fixed[1] == text.replace(bad, " ".join(WORDS["de"]))


def test_a_worker_that_knows_too_many_words_reads_on():
    """Words are forgotten between texts, never under the text that is read."""
    table = SimpleNamespace(value=mojibake.count_table(Counter(w for words in WORDS.values() for w in words)))
    batch = pd.DataFrame([(i, "h", " ".join(f"{w}{i}" for w in WORDS["de"]).encode().decode("latin-1")) for i in range(8)], columns=["doc_id", "source", "text"])
    alone = next(mojibake._score(table, "alone")(iter([batch])))
    scorer = mojibake.scorer(table, "full")
    scorer.known.update((str(i), {}) for i in range(399_999))
    full = next(mojibake._score(table, "full")(iter([batch])))
    assert len(scorer.known) > 400_000 and set(full["doc_id"]) == set(range(8)) and full.equals(alone)
    assert len(next(mojibake._score(table, "full")(iter([batch.assign(text=batch["text"].str.replace(" ", "x "))])))) and len(scorer.known) < 400_000


def test_the_last_word_counts_unless_it_is_cut_within_a_character():
    scorer = mojibake.Scorer(mojibake.count_table(Counter(w for words in WORDS.values() for w in words for _ in range(50))))
    told = lambda t: next(scorer.read([t], [{w for _, line, _ in mojibake.words_by_line(t) for w in line}]))[0]
    sound, last = "größe über später ", "natürlich schöne zurück".split()
    for w in last:
        assert ("head", "utf-8>cp1252") in told(sound + w.encode().decode("cp1252"))
        assert not told(sound + w)
    assert ("head", "utf-8>cp1252") not in told(sound + "fenÃ")
    assert mojibake.undo().cut("fenÃ", "utf-8>cp1252") and mojibake.undo().cut("fenÃƒÂ", "utf-8>cp1252+utf-8>cp1252")
    assert not mojibake.undo().cut("Ïðèâåò", "cp1251>cp1252") and not mojibake.undo().cut("â", "utf-8>latin-1, controls lost")


def test_found_documents_are_repaired_however_many_chains_share_the_evidence(spark, monkeypatch):
    rows = [(1, "body", f"cp125{k}>cp1252", 0.14 + k / 1000) for k in range(5)] + [(1, "head", "utf-8>cp1252", 0.9)] + [(2, "body", f"cp125{k}>cp1252", 0.14) for k in range(5)] + [(3, "body", "utf-8>cp1252", 0.4)]
    post = spark.createDataFrame(rows, "doc_id bigint, field string, chain string, posterior double")
    monkeypatch.setattr(mojibake, "posteriors", lambda scored, documents: post)
    df = spark.createDataFrame([(i, "h", "größe", "", 0.0, 1) for i in (1, 2, 3)], DOCS)
    got = {r["doc_id"]: r["chains"] for r in mojibake.repaired(df).collect()}
    assert got[1] == ["utf-8>cp1252", "cp1254>cp1252"] and got[2] and set(got) == {1, 2}


def test_a_worn_source_helps_its_weak_records(spark):
    chain = "cp1250>cp1252"
    scored = spark.createDataFrame([(i, "worn", "body", chain, 30.0) for i in range(30)] + [(100, "worn", "body", chain, 2.0), (101, "sound", "body", chain, 2.0)], mojibake.EVIDENCE)
    docs = spark.createDataFrame([(i, "worn") for i in range(30)] + [(100, "worn")] + [(i, "sound") for i in range(101, 400)], "doc_id bigint, source string")
    p = {r["doc_id"]: r["posterior"] for r in mojibake.posteriors(scored, docs).collect()}
    assert p[100] > 0.5 > p[101]


def test_empty_tables_and_very_long_text(spark):
    none = spark.createDataFrame([], DOCS)
    assert mojibake.garbled(none).count() == mojibake.repaired(none).count() == 0
    sound = " ".join(WORDS["de"] * 20)
    long = [(1, "a", (sound + "\n") * 40, "", 0.0, 1), (2, "a", "é" * 100_000, "", 0.0, 1), (3, "b", (sound + "\n") * 30 + sound.encode().decode("latin-1"), "", 0.0, 1)]
    df = spark.createDataFrame([(i + 10, "c", sound, "", 0.0, 1) for i in range(30)] + long, DOCS)
    assert [r["doc_id"] for r in mojibake.garbled(df).collect()] == [3]


def test_query_runs(spark, data):
    from tidelog.llm import queries

    found = {r["doc_id"] for r in queries.p9_found(spark, data).collect()}
    assert found and found == {r["doc_id"] for r in queries.p9_repaired(spark, data).collect()}

"""Defects and cuts, one rule each, and round trips over whole texts that are cut on purpose."""

import random
from functools import cache

import pyarrow.parquet as pq
import pytest

from evplace.llm.language import Profiles, train_profiles
from evplace.llm.pairs import defect, find_defects
from evplace.llm.structure import broken_end, open_signs, terminated
from evplace.llm.truncation import find_truncated, judge, source_rates

Q = "Which organisation, covered by Harbour Post and Hill Gazette, sold its bond around the time that two auditors left Norwick?"
R = "Looking at the Harbour Post item first. The bond was sold in May. Hence Zorba Partners."


@cache
def profiles():
    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["lang", "text"]).to_pylist()
    return Profiles([(r["lang"][:2].lower(), r["text"]) for r in rows if r["lang"]])


# Sentences that no generator wrote, held out.
HELD_OUT = {
    "en": ["The cat sat quietly on the old wooden chair.", "We should leave before it gets too dark outside.", "nobody knew what had happened to the keys", "she wrote three letters to her brother last winter", "He could not remember where the car was", "there is nothing left to eat in the house", "Why did they close the library so early?", "a small boat near the shore"],
    "de": ["die Katze schläft auf dem alten Stuhl", "wir sollten gehen, bevor es dunkel wird", "niemand wusste, was mit den Schlüsseln geschehen war", "sie schrieb ihrem Bruder im letzten Winter drei Briefe", "Er konnte sich nicht erinnern, wo das Auto stand", "es gibt nichts mehr zu essen im Haus", "Warum haben sie die Bibliothek so früh geschlossen?", "ein kleines Boot nahe am Ufer"],
    "fr": ["le chat dort sur la vieille chaise", "nous devrions partir avant la nuit", "personne ne savait ce qui était arrivé aux clés", "elle a écrit trois lettres à son frère l'hiver dernier", "Il ne pouvait pas se rappeler où était la voiture", "il ne reste rien à manger dans la maison", "Pourquoi ont-ils fermé la bibliothèque si tôt ?", "un petit bateau près du rivage"],
    "es": ["el gato duerme en la silla vieja", "deberíamos salir antes de que oscurezca", "nadie sabía qué había pasado con las llaves", "ella escribió tres cartas a su hermano el invierno pasado", "No podía recordar dónde estaba el coche", "no queda nada para comer en la casa", "¿Por qué cerraron la biblioteca tan temprano?", "un barco pequeño cerca de la orilla"],
}


def test_languages_of_held_out_sentences():
    right = [profiles().language(s) == lang for lang, ss in HELD_OUT.items() for s in ss]
    assert sum(right) >= 0.95 * len(right)
    told = [profiles().differs(asked, s) == (asked != lang) for lang, ss in HELD_OUT.items() for s in ss for asked in HELD_OUT]
    assert sum(told) >= 0.95 * len(told)
    # Names have no language; a language without a profile is none of the others.
    assert not any(profiles().differs("de", x) for x in ("Zorba Partners", "brobost works", "October 2022", "17", "")) and profiles().language("Zorba Partners") is None
    assert profiles().differs("en", "kwanza bandari iliuzwa kwa mji baada ya mgogoro mrefu kuhusu madeni") and Profiles([]).language("the cat") is None


def test_train_profiles(spark):
    rows = [(i, s + " " + s, ["EN", "en-GB", "en"][i % 3]) for i, s in enumerate(HELD_OUT["en"] * 3)] + [(100 + i, s, "de") for i, s in enumerate(HELD_OUT["de"])] + [(200, "x", None), (201, None, "fr"), (202, "y", "??")]
    p = train_profiles(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=10)
    assert p.language("the cat is on the chair and there was nothing") == "en" and p.language("die Katze und der Stuhl waren nicht da") == "de"
    assert train_profiles(spark.createDataFrame([], "doc_id long, text string, lang string")).language("the cat") is None


@pytest.mark.parametrize(
    "answer,reasoning,error,gold,kind,want",
    [
        ("Zorba Partners", R, None, "Zorba Partners", "x", None),
        ("Wrong Partners", R.replace("Zorba", "Wrong"), None, "Zorba Partners", "x", None),
        ("Zorba Partners", R, "recovered after 2 attempts", "Zorba Partners", "x", None),
        ("Zorba Partners", R, "warning: retry 4 succeeded", "Zorba Partners", "x", None),
        ("Zorba Partners", R, "nan", "Zorba Partners", "x", None),
        ("Zorba Partners.", R, None, "Zorba Partners", "x", None),
        ('"Zorba Partners"', R, None, "Zorba Partners", "x", None),
        ("Zorba Partners", None, None, "Zorba Partners, the bank of Norwick", "x", None),
        ("Insufficient information", "So the answer is Insufficient information.", None, "Insufficient information", "null_query", None),
        ("Insufficient information", "So the answer is Insufficient information.", None, "Zorba", "x", "refusal"),
        (None, None, "RateLimitError: limit reached", "Zorba", "x", "failed"),
        ("[INFERENCE_FAILED]", "[Inference failed: see inference_error column.]", None, "Zorba", "x", "failed"),
        ("", "[Inference failed: see inference_error column.]", "KeyError: 'final_answer'", "Zorba", "x", "failed"),
        (None, R, None, "Zorba", "x", "empty"),
        ("​", R, None, "Zorba", "x", "empty"),
        ("N/A", " ", None, "Zorba", "x", "empty"),
        ("[]", R, None, "Zorba", "x", "empty"),
        ("--", R[:20], None, "Zorba", "x", "empty"),
        ("I'm sorry, but I can't help with that.", R, None, "Zorba", "x", "refusal"),
        ("Sorry: the model can’t judge private affairs, sorry.", R, None, "Zorba", "x", "refusal"),
        ("My guidelines do not permit an answer", R, None, "Zorba", "x", "refusal"),
        ("apologies, i have to pass on this one at this time.", R, None, "Zorba", "x", "refusal"),
        ("As a language model I have no view on this!", R, None, "Zorba", "x", "refusal"),
        ("This request cannot be fulfilled, sorry.", R, None, "Zorba", "x", "refusal"),
        ("No", R.replace("Zorba Partners", "No"), None, "No", "x", None),
        (Q, R, None, "Zorba", "x", "copied_question"),
        ("You asked: " + Q.lower().rstrip("?"), R, None, "Zorba", "x", "copied_question"),
        (Q.replace("Harbour Post", "Harbour").replace("its ", ""), R, None, "Zorba", "x", "copied_question"),
        ("deux usines près du port", R, None, "Zorba", "x", "other_language"),
        ("Zorba Partners", "Der Bericht wurde im Mai geprüft. Die Antwort lautet also Zorba Partners.", None, "Zorba Partners", "x", "other_language"),
        ("Зорба", R, None, "Zorba", "x", "other_language"),
        ("La Voz de Arenalta", R.replace("Zorba Partners", "La Voz de Arenalta"), None, "La Voz de Arenalta", "x", None),
        ("Zorba Partners", R[:-30], None, "Zorba Partners", "x", "truncated"),
        ("Zorba Par", R, None, "Zorba Partners", "x", "truncated"),
        # The pair alone decides: without a word of the whole answer in it nothing shows.
        ("Zorba Par", None, None, "Zorba Partners", "x", None),
        ("Zorba Partners", R.replace("Hence Zorba Partners.", "Hence Zorba Partners that left Norwick."), None, "x", "x", "truncated"),
        ('The "Big Deal', None, None, "x", "x", "truncated"),
        ("<b>Acme", None, None, "x", "x", "truncated"),
        ("Answer: 1. first item\n2.", None, None, "x", "x", "truncated"),
        ("That's a question for a lawyer, not for me.", R, None, "x", "x", "refusal"),
        ("Un gatto e due cani", R, None, "x", "x", "other_language"),
        ("the bank that", None, None, "the bank that left", "x", "truncated"),
        ("x" * 70, None, None, None, "x", "truncated"),
    ],
)
def test_defects(answer, reasoning, error, gold, kind, want):
    assert defect(Q, answer, reasoning, error, kind, profiles=profiles()) == want


def test_defect_of_other_queries():
    de = "Welche Organisation nennt der Kurier, wenn laut Meldung der Hafen gekauft wurde, und was sagt sie dazu?"
    assert defect(de, "Zorba Works", "Der Hafen wurde gekauft. Die Antwort lautet also Zorba Works.", None, "x", profiles=profiles()) is None
    assert defect(de, "the compact bond", "Hence the compact bond.", None, "x", profiles=profiles()) == "other_language"
    assert defect(None, "Zorba", None, None, None) is None


def test_find_defects(spark):
    rows = [(1, Q, "", R, None, None, "x"), (1, Q, "", R, None, None, "x"), (2, Q, "Zorba Partners", R, None, None, "x"), (None, Q, "", R, None, None, "x"), (3, None, None, None, None, None, None), (4, Q, "w " * 60_000 + ".", R, None, None, "x")]
    df = spark.createDataFrame(rows, "result_id long, query string, final_answer string, reasoning string, inference_error string, gold_answer string, question_type string")
    got = dict(map(tuple, find_defects(df).collect()))
    assert got[1] == "empty" and got[2] is None and got[3] == "empty" and set(got) == {1, 2, 3, 4}
    assert find_defects(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text,want",
    [
        (None, ""), ("  \n", ""), ("All is said.", ""), ("All is said.\n", ""), ("“All is said,” he said.", ""), ("He said: “All is said.”", ""),
        ("All is said.\n\n— Harbour Post desk", ""), ("All is said.\n\nBy Ann Lee, Harbour Post", ""), ("All is said.\n\nTags: a, b", ""), ("All is said.\n\n#a #b", ""),
        ("All is said.\n\nMore at https://x.example/news", ""), ("All is said.\n\nFiled under: news", ""), ("User: Hi.\nAssistant: Yes.\nUser: thanks, that helps", ""),
        ("User: Hi.\nUser: Well, we will see...", ""), ("User: Hi.\nUser: ok got it, thank you", ""), ("User: Hi.\nUser: Great, that settles it!", ""),
        ("All is said. But the ban", "bare"), ("All is said. But the bank ", "bare"), ("All is said. After the bank,", "bare"), ("All is said. But the ba…", "marker"), ("All is said. But the ban...", "marker"),
        ("All is said. But the [...]", "marker"), ("All is said. But the [+623 chars]", "marker"), ("All is said. Caf�", "broken"), ("All is said. Tom &am", "broken"), ("All is said. A \\u00", "broken"),
        ("All is said. See Bridge 35.", ""), ("All is said. (It was late.", "open"), ("```\ncode.", "open"), ("User: Hi.\nUser: I saw a piece in Ha", "bare"),
        ("By the end of May, the bank in Nor", "bare"), ("x " * 50_000 + "end.", ""),
        # The stack decides: straight quotes, elements, braces, corner quotes, lists.
        ('He said "we will go there tomorrow.', "open"), ('He said "we will go there tomorrow."', ""), ("<div><p>One. Two.", "open"), ("<div><p>One. Two.</div>", ""), ("One <name>. Two.", ""),
        ("The set {a, b is here.", "open"), ("One. ‹open one.", "open"), ("Items:\n1. one\n2. two\n3.", "open"), ("Items:\n1. one\n2. two\n3. three.", ""), ("It was 3.", ""),
        # Words of thanks inside a sentence close nothing.
        ("Bank of America will do", "bare"), ("The mayor said all good", "bare"), ("All is said.\n\nPerfect is the enemy of", "bare"), ("User: Hi.\nUser: Perfect, thanks a lot", ""),
        # A long last sentence is seen whole: what was opened before it does not count, what was opened in it does.
        ("Sad :( . " + "word " * 1500 + "end.", ""), ("All is said. It (was " + "word " * 1500 + "end.", "open"),
        # Tags with long attributes are tags; a begun one is broken however long it is.
        (f"<div class='{'x ' * 900}'>One.</div>", ""), (f"One. <div class='{'x ' * 900}", "broken"),
        ("All is said.\n\nTags: " + ", ".join(["word"] * 100), ""),
    ],
)
def test_judge(text, want):
    assert judge(text)[0] == want


def test_cutting_whole_texts_is_noticed():
    rng = random.Random(1)
    words = "the bank sold its bond before the town had heard of any loss from Norwick".split()
    found = total = 0
    for _ in range(400):
        text = " ".join(" ".join(rng.choices(words, k=9)).capitalize() + "." for _ in range(8))
        assert judge(text)[0] == ""
        at = rng.randrange(60, len(text) - 2)
        if text[at - 1] in ". " and text[:at].rstrip().endswith("."):
            continue
        total += 1
        found += judge(text[:at])[0] != ""
    assert found == total


def test_open_signs():
    assert open_signs('a (b [c] "d" “e') == [("(", 2), ("“", 13)]
    assert open_signs("<p>a<br>b</p> <div") == [] and broken_end("<p>a <div")
    assert terminated("He left.”)") and not terminated("He left,”")


def test_find_truncated_and_baseline(spark):
    rows = [(i, "All is said.", "a", "k") for i in range(10)] + [(100, "All is sa", "a", "k"), (101, None, None, "k"), (102, "Half a wo", None, "k")]
    # A source whose texts are lines without stops: its custom, but for a field limit.
    rows += [(200 + i, f"line number {'x' * (i + 30)} of the list", "lists", "k") for i in range(30)] + [(300 + i, "y" * 49 + " ", "lists", "k") for i in range(6)]
    df = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, source string, kind string")
    out = find_truncated(df).collect()
    cut = {r["doc_id"] for r in out if r["is_cut"]}
    assert cut == {100, 102} | {300 + i for i in range(6)} and len(out) == len(rows) + 1
    rates = {r["source"]: r for r in source_rates(find_truncated(df)).collect()}
    assert rates["a"]["n_cut"] == 1 and rates["lists"]["usual_limit"] == 50 and rates[None]["n_docs"] == 2
    assert find_truncated(df.limit(0)).count() == 0


def test_closings_are_learned(spark):
    rows = [(i, f"All is said of number {i}.\nover and out from the desk", "a") for i in range(5)]
    # Copies of one cut text repeat the line before the end as well.
    rows += [(100 + i, "The bank was sold.\nand the mayor of the to", "a") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r["doc_id"] for r in find_truncated(df).where("is_cut").collect()} == {100 + i for i in range(9)}


def test_hostile_texts_take_linear_time():
    import time

    began = time.perf_counter()
    for text in ("a" + " " * 300_000 + "b", "." * 300_000 + "a", "(" * 100_000 + "]" * 100_000 + ".", '"' * 200_000 + "a.", "User: x\n" + "w " * 200_000, "<p" * 100_000, "“" * 100_000 + "x.", "# " * 100_000):
        judge(text)
        defect(Q, text, text, text, "x", profiles=profiles())
    defect("a " * 300, "a " * 100_000, R, None, "x", profiles=profiles())
    assert time.perf_counter() - began < 30

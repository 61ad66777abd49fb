from pyspark.sql import functions as F

from tallyfield.llm import plans, templates
from tallyfield.llm.templates import decontaminate
from tests.llm.cases import SF_DIR, documents, lowered, real_documents, with_clashes, words

ITEM = "Yesterday the baker Anna bought 12 kg of flour and gave Peter 5 kg before he left for home."
ITEMS = "item_id long, text string"


def found(spark, texts, items=((1, ITEM),)):
    docs = with_clashes(documents(spark, list(enumerate(texts))))
    got = {r.doc_id: r["items"] for r in decontaminate(docs, spark.createDataFrame(list(items), ITEMS)).collect()}
    return [got[i] for i in range(len(texts))]


def test_parameters_may_change(spark):
    other = ITEM.replace("12", "340").replace("Anna", "Maria").replace("Peter", "Otto").replace(" 5 ", " 9 ").replace("kg", "lb")
    broken = ITEM.replace("bought 12", "bought 12.")
    got = found(spark, ["x y z. " + ITEM, other, "Nothing of this is here at all, " * 9, None, "", broken, "the baker"])
    assert got[0] == got[1] == [1] and got[2] == got[3] == got[4] == got[6] == []


def test_slots_must_agree(spark):
    item = "the red box of Tom is at home and now Tom takes the red box from home to work"
    other = item.replace("Tom", "Ann")
    mixed = item.replace("now Tom", "now Bob")
    assert found(spark, [other, mixed], [(4, item)]) == [[4], []]


def test_short_and_slot_dense_items(spark):
    items = [
        (1, "What is the capital of France?"), (2, "3 + 4 = ?"), (3, "Meet Anna Bob Carl Dora Emil Fritz Gerd Hans Ida Jan Karl Lars Mia Nora."),
        (4, "Add 12 7 19 44 3 8 21 90 55 61 70 81 93 15 26"), (5, "* * * * * * * * * *"), (6, "Is the river near Paris or not?"),
    ]
    copied = [f"so. {t} ok" for _, t in items]
    others = ["so. What is the capital of Spain?", "so 3 + 5 = ?", "Add 12 7 19 44 3 8 21 90 55 61 0 81 93 15 26"]
    got = found(spark, copied + others + [items[2][1].lower()], items)
    assert got[:6] == [[1], [2], [3], [4], [], [6]] and got[6:] == [[1], [], [], [3]]


def test_one_edited_slot_spares_the_rest(spark):
    item = (
        "When the mill of Greta closed in spring she sold the old wheel and moved near the river with two dogs and a cart; "
        "years later the mill was bought by a man who paid Greta for the name and nothing else at all"
    )
    edited = item.replace("paid Greta", "paid Bob")
    renamed = item.replace("Greta", "Ann").replace("paid Ann", "paid Bob")
    assert found(spark, [edited, renamed, item.replace("Greta", "Ann")], [(7, item)]) == [[7], [7], [7]]


def test_stock_phrases_and_marks_are_no_leak(spark):
    stock = "Which of the following is the correct answer to the puzzle that old Greta wrote on her kitchen wall?"
    table = "Fill in this table of rivers by length please : | | | | | | | | | | | | | | and then name the longest of all"
    texts = [
        "We asked which of the following is the correct answer to our own survey.", "my table | | | | | | | | | | | | | | | |",
        "so. " + stock, "so. " + table,
    ]
    assert found(spark, texts, [(1, stock), (2, table)]) == [[], [], [1], [2]]


def test_empty(spark):
    assert found(spark, ["a b c"], [(1, None), (2, "")]) == [[]]
    none = spark.createDataFrame([], ITEMS)
    assert [r.contaminated for r in decontaminate(documents(spark, [(1, ITEM), (1, ITEM)]), none).collect()] == [False] * 2
    assert decontaminate(documents(spark, []), none).count() == 0


def test_query_finds_all_long_passages(spark):
    import duckdb

    items = duckdb.sql(f"SELECT item_id, text FROM '{SF_DIR}/benchmark.parquet'").fetchall()
    grams = {}
    for i, t in items:
        ws = words(lowered(t))
        for k in range(len(ws) - 12):
            grams.setdefault(tuple(ws[k : k + 13]), set()).add(i)
    got = {r.doc_id: r for r in plans.op8_decontamination(spark, SF_DIR).collect()}
    for doc_id, text, *_ in real_documents():
        ws = words(lowered(text))
        want = set().union(*(grams.get(tuple(ws[k : k + 13]), ()) for k in range(len(ws) - 12)))
        assert want <= set(got[doc_id]["items"])
        assert bool(want) == got[doc_id].contaminated


def test_long_words_and_texts_of_every_kind_end(spark):
    """No pattern may use up the stack or look at a run again from each of its places."""
    units = [".1", "1,", "b.", "!", "a!", "12 ", " ", "7", "'", "(1", "A.", ":"]
    texts = ["1" * (u == ".1") + u * (1_000_000 // len(u)) + "a!" for u in units] + ["a" + "!" * 1_000_000 + "a", "x. " * 99 + ITEM]
    got = found(spark, texts, [(1, ITEM), (2, "1" + ".1" * 300_000 + " of them"), (3, "a" + "!" * 300_000)])
    assert got[-1] == [1] and len(got) == len(texts)


#: Questions in four languages, and the same with other numbers, names and units.
ASKED = [
    "Anna has 12 apples and gives 5 to Peter. How many are left?",
    "A train leaves Paris at 9:30 and reaches Lyon after 120 minutes. How many miles does it travel?",
    "Tom buys twelve pounds of sugar and sells four pounds to Mary; what weight does Tom still own?",
    "In March a farmer sold 340 eggs for 51 dollars. Which price in cents did each egg have?",
    "Anna kauft 12 Äpfel und gibt Peter 5 Äpfel. Wie viele Äpfel hat Anna noch?",
    "Ein Zug fährt um 8 Uhr in Berlin ab und braucht 4 Stunden. Wann ist er am Ziel?",
    "Frau Weber mischt zwei Liter Wasser mit 300 Gramm Salz und rührt fünf Minuten. Wie stark ist die Lösung?",
    "Marie a 12 pommes et donne 5 pommes à Pierre. Combien de pommes reste-t-il dans le panier ?",
    "Le train de Lyon part à 8 heures et roule pendant trois heures. Quand arrive-t-il à la gare ?",
    "Jean achète 3 kilos de farine pour 7 euros et vend tout à Luc. Quel est le prix par kilo ?",
    "Ana tiene 12 manzanas y le da 5 manzanas a Pedro. ¿Cuántas manzanas le quedan todavía?",
    "El tren de Madrid sale a las 9 y tarda cuatro horas. ¿A qué hora llega a la estación?",
]
OTHERS = {
    "Anna": "Maria", "Peter": "Otto", "Paris": "Rome", "Lyon": "Nice", "Tom": "Kurt", "Mary": "Lisa", "March": "June", "Berlin": "Hamburg",
    "Weber": "Koch", "Marie": "Julie", "Pierre": "Hugo", "Jean": "Paul", "Luc": "Max", "Ana": "Eva", "Pedro": "Diego", "Madrid": "Toledo",
    "12": "30", "5": "7", "9:30": "10:15", "120": "95", "340": "212", "51": "33", "8": "6", "4": "11", "300": "450", "3": "8", "7": "19", "9": "5",
    "twelve": "forty", "four": "six", "zwei": "drei", "fünf": "acht", "trois": "deux", "cuatro": "tres", "pounds": "grams", "minutes": "hours",
    "miles": "meters", "dollars": "euros", "Stunden": "Stunden", "kilos": "grammes",
}


def renamed(text):
    import re

    return re.sub(r"[0-9]+(?::[0-9]+)?|[^\W\d_]+", lambda m: OTHERS.get(m[0], m[0]), text)


def test_questions_with_other_values_are_found(spark):
    items = list(enumerate(ASKED))
    texts = ["some words before. " + renamed(t) + " and some after" for t in ASKED]
    assert all(renamed(t) != t for t in ASKED)
    got = found(spark, texts, items)
    assert [i for i, g in enumerate(got) if g not in ([], [i])] == []
    assert sum(g == [i] for i, g in enumerate(got)) >= 0.9 * len(ASKED)


def test_texts_of_the_same_kind_are_no_leak(spark):
    texts = [
        "Anna has 12 brothers and talks to Peter. How many letters are there?", "A train leaves Paris at 9:30 and nobody knows when it comes back.",
        "Anna kauft 12 Birnen im Laden und gibt Otto nichts. Wie viele Kunden waren noch da?", "Le train de Lyon part souvent en retard et personne ne sait quand il arrive.",
        "El tren de Madrid sale a las 9 y casi siempre va lleno de gente.", "In March a farmer sold 340 pigs to Tom and went home. Which way did each take?",
    ]
    assert found(spark, texts, list(enumerate(ASKED))) == [[]] * len(texts)


def test_short_items_need_their_least_words(spark):
    docs = documents(spark, [(0, "yes it is"), (1, "it is so")])
    items = spark.createDataFrame([(1, "yes"), (2, "it is")], ITEMS)
    got = {least: {r.doc_id: r["items"] for r in decontaminate(docs, items, least=least).collect()} for least in (1, 2, 3)}
    assert got == {1: {0: [1, 2], 1: [2]}, 2: {0: [2], 1: [2]}, 3: {0: [], 1: []}}


def test_columns_keep_their_names(spark):
    own = ["_row", "_item", "item", "rest", "words", "slots", "at", "size", "hash", "exact", "contaminated", "items"]
    docs = documents(spark, [(0, ITEM), (1, None)])
    docs = docs.select("*", *(F.lit("x").alias(c) for c in own))
    got = decontaminate(docs, spark.createDataFrame([(1, ITEM)], ITEMS))
    assert got.columns == docs.drop("contaminated", "items").columns + ["contaminated", "items"]
    rows = {r.doc_id: r for r in got.collect()}
    assert all(r[c] == "x" for r in rows.values() for c in own[:-2])
    assert rows[0]["items"] == [1] and rows[0].text == ITEM and rows[1]["items"] == [] and rows[1].text is None


def test_only_texts_with_suspect_windows_are_cut_again(spark, monkeypatch):
    given, cut = [], templates.cut

    def counted(places, rows, row, text):
        given.append(rows.count())
        return cut(places, rows, row, text)

    monkeypatch.setattr(templates, "cut", counted)
    clean = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(300)]
    assert found(spark, clean + [ITEM] + clean) == [[]] * 300 + [[1]] + [[]] * 300
    assert given[0] == 1 and given[1] < 10  # the item, then the one text that may hold it

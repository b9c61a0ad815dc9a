import pytest

from tollbook.llm import decontaminate as d

ITEM = "Anna Smith drives 120 km in 2 hours and then 60 km in 1 hour. How fast did Anna go on the whole way home that day?"
OTHER = "A farmer has many sheep on the green hill near the old stone church and sells some of them each autumn market."
ITEMS = [(1, ITEM), (2, OTHER), (3, "Why so?"), (4, None), (5, "  ... "), (6, ITEM), (7, "Name the capital of France")]
PAD = "some other words stand here before the passage and they have nothing to do with it. "
DOCS = {
    "same": (PAD + ITEM + " " + PAD, {1, 6}), "case": (PAD + ITEM.lower() + PAD, set()), "spaces": (PAD + ITEM.replace(" ", "\n  ") + PAD, {1, 6}),
    "numbers": (PAD + ITEM.replace("120", "300").replace(" 2 ", " 5 ").replace("60", "80") + PAD, {1, 6}),
    "uneven": ("Bert Jones bought 3 cars. " + ITEM.replace("fast did Anna", "fast did Bert") + PAD, set()),
    "part": (PAD + " ".join(ITEM.split()[:9]) + PAD, set()), "other": (PAD + OTHER.upper() + OTHER, {2}), "clean": (PAD * 5, set()),
    "short": ("Why so?", {3}), "short inside": (PAD + "Why so?", set()), "seven": (PAD + "name the capital of France " + PAD, {7}), "none": (None, set()), "empty": ("", set()), "dots": ("... !", set()),
    "long": ((PAD * 3000) + OTHER, {2}),
}


@pytest.mark.parametrize("slice_words", [10**6, 20])
def test_planted_items(spark, slice_words):
    rows = [(i, name, text, 1.0) for i, (name, (text, _)) in enumerate(DOCS.items())] * 2 + [(None, "same", DOCS["same"][0], 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, name string, text string, Leaks double")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = d.find_leaks(docs, bench, docs.columns, slice_words=slice_words).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.name == "case":  # lower-cased names are no names: the rest of the item is still there
            continue
        assert {x.item_id for x in r.leaks} == DOCS[r.name][1], r.name
    changed = next(r for r in out if r.name == "numbers").leaks[0]
    assert (changed.changed_slots, changed.equal_words, changed.item_words) == (3, 23, 27)  # the last word runs into the next


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x y z")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.leaks for r in d.find_leaks(docs, none, ["doc_id"]).collect()] == [[]]
    assert d.find_leaks(docs.limit(0), none, ["doc_id"]).count() == 0


def test_templates():
    words, kinds, _ = d.template(d.Lexicon().look("He met Tom Ford. Tom ran 5 km, not 7.5kg or m at 10 % of $30"))
    assert kinds.tolist() == [0, 0, 3, 3, 0, 0, 1, 2, 0, 1, 0, 0, 0, 1, 2, 0, 1]


def found(item, text):
    return [(x["equal_words"], x["item_words"], x["changed_slots"]) for x in d.Benchmark([(1, item)]).leaks(d.Lexicon().look(text))]


LONG = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200))


def test_passages_of_less_than_half():
    passage = LONG.split()[70:130]
    assert found(LONG, PAD + " ".join(passage) + " " + PAD) == [(60, 200, 0)]
    assert found(LONG, PAD + " ".join(passage[:13]) + " " + PAD) == [(13, 200, 0)]
    assert found(LONG, PAD + " ".join(passage[:12]) + " " + PAD) == []
    assert found(LONG, PAD + " ".join(passage[:10]) + " " + PAD + " ".join(passage[20:30])) == [(20, 200, 0)]  # of two shifts
    assert found(LONG, " ".join(passage[:10]) + " " + PAD + " ".join(passage[:10])) == []  # the same words twice count once


def test_inserted_and_dropped_words():
    w = LONG.split()[:24]
    assert found(" ".join(w), PAD + " ".join([*w[:8], "grey", *w[8:16], "very", *w[16:]])) == [(24, 24, 0)]
    assert found(" ".join(w), PAD + " ".join([*w[:8], *w[9:17], *w[18:]])) == [(16, 24, 0)]  # six words are left without a window


def test_slots_beyond_a_passage():
    item = "we saw Tom and then Ann there with a big dog near the lake in 3 boats, Tom rowed 3 miles while Ann slept"
    w = item.split()
    cut = w.index("rowed") - 1
    assert found(item, " ".join(w[:cut]) + " Max and nobody else had time") == [(17, 24, 0)]  # "Max" lies on the second "Tom"
    assert found(item, " ".join(w[:cut]) + " Max rowed 3 miles while Ann slept") == []  # other roles, so another question
    assert found(LONG + " Q " + item, PAD + LONG + " Q " + item.replace("Tom rowed", "Max rowed")) == [(218, 225, 0)]  # verbatim all the same


NAMES = "Then Anna met Bob near Paris while Carla and Dora saw Emil with Fritz in Rome, where Greta gave Hans a book for Ida."


@pytest.mark.parametrize("item", [ITEM, NAMES, "Der Hund von Anna läuft im Garten über die Straße zum Haus, wo die Katze auf dem Dach in der Sonne liegt."])
@pytest.mark.parametrize("changed", [str.lower, str.upper, str.title], ids=["lower", "upper", "title"])
def test_changed_case(item, changed):
    n = len(item.split())
    assert found(item, PAD + changed(item) + " " + PAD) == [(n, n, 0)]


def test_changed_case_of_the_planted_item(spark):
    docs = spark.createDataFrame([(1, DOCS["case"][0])], "doc_id long, text string")
    out = d.find_leaks(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), ["doc_id"]).collect()
    assert {x.item_id for x in out[0].leaks} == {1, 6}


def test_names_that_begin_sentences():
    item = "Alice has 3 apples. Bob has 4 apples."
    assert found(item, PAD + "Carol has 3 apples. Dave has 4 apples. " + PAD) == [(6, 8, 2)]
    assert found(item, PAD + "Carol has 5 apples. Dave has 7 apples. " + PAD) == [(4, 8, 4)]
    assert found(item, PAD + "Carol likes 5 apples. Dave sold 7 pears. " + PAD) == []


def test_runs_of_letters_ask_no_number_pattern(monkeypatch):
    """Most runs are words, which cannot be numbers; their facts are those of the full look."""
    from tollbook.llm import decontaminate as d

    runs = ["Straße", "word,", "hours", "\"Anna\"", "(km).", "İ", "x", "中文。", "the", "The"]
    full = [d.Lexicon.fact(r) for r in runs]

    class Never:
        def fullmatch(self, text):
            raise AssertionError(text)

    monkeypatch.setattr(d, "NUMBER", Never())
    assert [d.Lexicon.fact(r) for r in runs] == full
    assert [f[1] for f in full] == [d.PLAIN, d.PLAIN, d.UNIT, d.PLAIN, d.UNIT, *[d.PLAIN] * 5]
    assert [f[2] for f in full] == [2, 0, 0, 2, 0, 2, 0, 0, 0, 1] and [f[3] for f in full] == [0, 0, 0, 0, 1, 0, 0, 0, 0, 0]

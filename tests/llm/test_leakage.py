import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from bargspark.llm import leakage as L


def brute(items, words, least):
    index = defaultdict(set)
    for i, w in items:
        for a in range(len(w) - least + 1):
            index[tuple(w[a : a + least])].add(i)
    return {i for a in range(len(words) - least + 1) for i in index.get(tuple(words[a : a + least]), ())}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=0, max_size=14), min_size=1, max_size=5), st.lists(st.sampled_from("abcd"), max_size=30), st.integers(1, 5))
def test_automaton(items, text, least):
    items = [(i, w) for i, w in enumerate(items)]
    a = L.Automaton(items, least)
    numbers = [a.words.get(w, 0) for w in text]
    found, spans = a.match(numbers)
    assert found == brute(items, text, least)
    covered = {k for i, j in spans for k in range(i, j)}
    assert covered == {k for s in range(len(text) - least + 1) if brute(items, text[s : s + least], least) for k in range(s, s + least)}


def test_table(spark):
    rng = random.Random(2)
    item = [f"واژه{i}" for i in range(40)]
    noise = lambda n: " ".join(f"x{rng.randint(0, 99)}" for _ in range(n))
    part = " ".join(item[5:18])
    docs = [
        (1, noise(5) + " " + part + " " + noise(3)), (2, " ".join(item[5:17])), (3, part.replace("واژه6", "«وا‏ژهـ6»،").replace(" ", " ", 1)), (4, None), (5, ""), (6, " \n "), (7, " – ".join(item[5:18])),
        (8, " ".join(item[:12]) + " " + "x " + " ".join(item[12:24])), (1, noise(5) + " " + part), (9, noise(20_000) + " " + part),
    ]
    d = spark.createDataFrame([(*x, "t") for x in docs], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item)), (3, "short"), (4, None)], "item_id bigint, text string")
    got = [tuple(r) for r in L.leaked(d, items).collect()]
    assert sorted(got) == sorted((k, i) for k in (1, 3, 7, 9) for i in (1, 2))
    assert L.leaked(d.limit(0), items).count() == 0 and L.leaked(d, items.limit(0)).count() == 0
    clean = {r.doc_id: r for r in L.cleaned(d.where("doc_id <> 1"), items).collect()}
    assert clean[3].dropped and clean[3].text is None and clean[4].text is None and not clean[4].dropped and clean[5].text == ""
    assert clean[9].n_leaked == 13 and part not in clean[9].text and clean[2].text == " ".join(item[5:17])


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 50), monkeypatch.setattr(L, "TOGETHER", 2)
    items = spark.createDataFrame([(i, " ".join(f"w{i}_{k}" for k in range(30))) for i in range(7)], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, " ".join(f"w{i}_{k}" for k in range(13))) for i in range(7)], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in L.leaked(docs, items).collect()) == [(i, i) for i in range(7)]
    clean = {r.doc_id: r for r in L.cleaned(docs.unionByName(spark.createDataFrame([(99, "w1_1 w1_2"), (98, None)], docs.schema)), items).collect()}
    assert len(clean) == 9 and all(clean[i].dropped for i in range(7)) and clean[99].text == "w1_1 w1_2" and clean[98].n_words == 0


def test_memory_of_a_block():
    rng = random.Random(1)
    items = [(i, [f"w{rng.randint(0, 5000)}" for _ in range(100)]) for i in range(100)]
    a = L.Automaton(items, 13)
    flat = sum(len(x) * x.itemsize for x in (a.keys, a.targets, a.link, a.length, a.hit, a.items))
    assert flat < 100 * 10_000

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sondage.llm import decontamination as dc


def fewest_edits(item, text):
    """Sellers' algorithm over all of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (c != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


words = st.lists(st.sampled_from(["the", "on", "tion", "a", "é", "st", "re", "in", "had", "ther"]), min_size=18, max_size=30)


@settings(max_examples=120, deadline=None)
@given(words, words, words, st.data())
def test_find_equals_brute_force(before, item, after, data):
    text = list(" ".join(item))
    for _ in range(data.draw(st.integers(0, 9))):
        i = data.draw(st.integers(0, len(text) - 1))
        kind = data.draw(st.sampled_from("sdi"))
        text[i : i + 1] = {"s": ["z"], "d": [], "i": [text[i], "q"]}[kind]
    doc = " ".join(before) + " " + "".join(text) + " " + " ".join(after)
    index = dc.build_index([(5, " ".join(item)), (6, None), (7, "")])
    pattern, budget = dc.normalised(" ".join(item)), index.items[0][2]
    edits = fewest_edits(pattern, dc.normalised(doc))
    got = list(dc.find(index, [None, doc, ""]))
    assert [x[:3] for x in got] == ([(1, 0, edits)] if edits <= budget else [])


def test_documents(spark):
    rng = np.random.default_rng(0)
    syllables = ["er", "on", "th", "an", "ou", "re", "st"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 5)))
    item = " ".join(word() for _ in range(40))
    other = " ".join(word() for _ in range(40))
    near = item[:50] + "x" + item[51:120] + item[123:]
    half = item[: len(item) // 2]
    rows = [(1, None), (2, ""), (3, other), (4, f"Intro. {item.upper()}! End"), (5, other + " " + near), (6, half), (7, f"{item} {item}"), (None, item), (8, " ".join([other] * 300) + " " + item), (4, item), (9, "short item here"), (10, "a short itemised list")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, edits int")
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "Short item")], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id, r.edits) for r in dc.contaminated(docs, benchmark).collect())
    edits = fewest_edits(dc.normalised(item), dc.normalised(near))
    assert got == sorted([("4", 1, 0), ("4", 1, 0), ("5", 1, edits), ("7", 1, 0), ("None", 1, 0), ("8", 1, 0), ("9", 4, 0)])
    assert sorted(str(r.doc_id) for r in dc.clean_documents(docs, benchmark).collect()) == ["1", "10", "2", "3", "6"]
    assert dc.clean_documents(docs, benchmark).columns == docs.columns
    blocks = dc.contaminated(docs, benchmark, block_chars=60)
    assert sorted((str(r.doc_id), r.item_id, r.edits) for r in blocks.collect()) == got
    assert dc.contaminated(docs.limit(0), benchmark).count() == 0
    assert dc.contaminated(docs, benchmark.limit(0)).count() == 0
    assert dc.clean_documents(docs, benchmark.limit(0)).count() == len(rows)


@pytest.mark.parametrize("q", [1, 3, 7, 10, 12])
def test_qgrams_name_their_characters(q):
    codes = dc.code_points("abcabcabcdefabcabcabcdef" * 2)
    h = dc.qgrams(codes, q)
    text = [tuple(codes[i : i + q]) for i in range(len(codes) - q + 1)]
    assert len(h) == len(text) and len(set(h.tolist())) == len(set(text))
    assert len({(a, b) for a, b in zip(h.tolist(), text)}) == len(set(text))

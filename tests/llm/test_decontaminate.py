import random
from collections import Counter

import numpy as np

from tidewatch.llm import decontaminate as d


def corpus(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 40
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(15, 50)))) for i in range(60)]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 400))), "x") for i in range(80)]
    planted = {}
    for k in range(0, 60, 3):
        i = 100 + k
        docs.append((i, docs[k][1] + " , " + items[k][1].upper() + " . " + docs[k + 1][1], "x"))
        planted[i] = k
    return items, docs, planted


def test_finds_planted_items_and_nothing_else(spark):
    items, docs, planted = corpus()
    docs += [(500, None, "x"), (501, "", "x"), (100, docs[-20][1], "x")]
    got = d.find_leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame([*items, (77, None), (78, "")], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} >= set(planted.items())
    assert {r["doc_id"] for r in got} == set(planted)
    # In parts of few words each, the same.
    parts = d.find_leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"), part_words=300).collect()
    assert {(r["doc_id"], r["item_id"]) for r in parts} == {(r["doc_id"], r["item_id"]) for r in got}


def test_search_equals_exhaustive_scores():
    items, docs, _ = corpus(9)
    split = sorted((len(d.words(t)), i, d.words(t)) for i, t in items)
    df = Counter(w for _, _, ws in split for w in set(ws))
    n = len(split)
    idf = {w: float(np.log(1 + (n - c + 0.5) / (c + 0.5))) for w, c in df.items()}
    mean = sum(x[0] for x in split) / n
    ix = d.Index([(i, ws, (k + 1) // 2) for k, i, ws in split], idf, mean)
    for theta in (0.15, 0.3, 0.6):
        for _, text, *_ in docs:
            terms = sorted({ix.terms[w] for w in d.words(text) if w in ix.terms})
            scores = np.zeros(n)
            for t in terms:
                for p, w in zip(*ix.posts[t]):
                    scores[p] += w
            want = {i for i in range(n) if scores[i] >= theta}
            assert {i for i, _ in ix.search(terms, list(range(ix.n_blocks)), theta)} == want


def test_one_changed_word_is_found_half_an_item_is_not(spark):
    rng = random.Random(2)
    words = [f"q{rng.randrange(10**6)}" for _ in range(40)]
    changed = [*words[:25], "other", *words[26:]]
    pad = ["pad"] * 70
    docs = [(1, " ".join(pad + changed + pad)), (2, " ".join(pad + words[:20] + pad)), (3, " ".join(words))]
    got = d.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 3]


def test_no_items_no_docs_and_columns_for_question_and_answer(spark):
    items = spark.createDataFrame([(1, "What is the tallest hill of the north", "it is the old grey tor there")], "item_id long, question string, answer string")
    docs = spark.createDataFrame([(4, "so What is the tallest hill of the north? It is the old grey tor there."), (None, "nothing")], "doc_id long, text string")
    got = d.find_leaks(docs, items, question_col="question", answer_col="answer").collect()
    assert [(r["doc_id"], r["question_overlap"], r["answer_overlap"]) for r in got] == [(4, 1.0, 1.0)]
    assert d.find_leaks(docs, items.limit(0), question_col="question", answer_col="answer").count() == 0
    assert d.find_leaks(docs.limit(0), items, question_col="question", answer_col="answer").count() == 0


def test_combining_marks_split_alike_in_items_and_passages(spark):
    hindi = "हिन्दी में लिखा गया यह प्रश्न परीक्षा के लिए है"
    accents = " ".join(f"cafe\u0301{i}" for i in range(12))
    items = spark.createDataFrame([(1, hindi), (2, accents)], "item_id long, text string")
    docs = spark.createDataFrame([(10, f"before {hindi} after"), (20, f"before {accents} after"), (30, "before and after")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in d.find_leaks(docs, items).collect()) == [(10, 1), (20, 2)]


def test_every_text_of_an_id_is_searched(spark):
    rng = random.Random(6)
    texts = [" ".join(f"q{rng.randrange(10**6)}" for _ in range(n)) for n in (40, 30, 20, 25)]
    items = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[3])], "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for words in (1_000_000, 60):
        got = d.find_leaks(docs, items, part_words=words).collect()
        assert sorted((r["doc_id"], r["item_id"] or -1) for r in got) == [(0, 1), (1, 1), (2, -1), (3, -1)]


def index(items):
    split = sorted((len(d.words(t)), i, d.words(t)) for i, t in items)
    df = Counter(w for _, _, ws in split for w in set(ws))
    n = len(split)
    idf = {w: float(np.log(1 + (n - c + 0.5) / (c + 0.5))) for w, c in df.items()}
    return d.Index([(i, ws, (k + 1) // 2) for k, i, ws in split], idf, sum(x[0] for x in split) / n)


def exhaustive(ix, text, threshold, overlap):
    """All items against all passages of a text, with no bound and no index."""
    ws, step, found = d.words(text), ix.longest, {}
    for a in range(0, max(1, len(ws)), step):
        part = [ix.terms.get(w, -1) for w in ws[a : a + 2 * step]]
        there, own = d.shingles(part), set(part)
        for n in range(len(ix.ids)):
            score = sum(w for t, (at, weights) in ix.posts.items() if t in own for p, w in zip(at, weights) if p == n)
            share = [len(x & there) / len(x) if x else 1.0 for x in (ix.whole[n], ix.question[n], ix.answer[n])]
            if score >= threshold and share[0] >= overlap and min(share[1:]) >= overlap / 2 and (n not in found or score > found[n][1] + 1e-9):
                found[n] = (ix.ids[n], score, share[1], share[2], a)
    return [found[n] for n in sorted(found)]


def test_hits_equal_an_exhaustive_search(monkeypatch):
    items, docs, _ = corpus(11)
    ix = index(items)
    texts = [t for _, t, _ in docs[:40:4]] + [t for _, t, _ in docs[80:]] + ["", None, "none of these"]
    texts.append(" ".join(docs[k][1] for k in range(12)) + " " + items[5][1] + " x " + items[5][1])  # over many slices
    for cells in (1 << 21, 1, 5 * ix.n_blocks):
        monkeypatch.setattr(d, "CELLS", cells)
        assert max(best.shape[0] for _, best in ix.slices([np.zeros(5000, np.int64)])) * ix.n_blocks <= max(cells, 2 * ix.n_blocks)
        for threshold, overlap in ((0.7, 0.8), (0.3, 0.2)):
            for text, got in zip(texts, ix.hits(texts, threshold, overlap), strict=True):
                want = exhaustive(ix, text, threshold, overlap)
                assert [(x[0], x[2:]) for x in got] == [(x[0], x[2:]) for x in want]
                assert np.allclose([x[1] for x in got], [x[1] for x in want])


def test_ties_go_to_the_first_passage_and_very_long_texts(spark):
    item = " ".join(f"t{i}" for i in range(20))
    pad = "pad " * 40
    long = "filler " * 400_000
    docs = [(1, f"{item} {pad} {item}"), (2, f"{long} {item} {long}")]
    got = {r["doc_id"]: r for r in d.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(3, item)], "item_id long, text string")).collect()}
    assert got[1]["first_word"] == 0 and got[2]["item_id"] == 3 and 399_960 <= got[2]["first_word"] <= 400_000

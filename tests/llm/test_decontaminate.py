import random
import re

from gristmill.llm.decontaminate import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, window=13):
    found = []
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for name, item in items:
            own = words(item)
            n = min(window, len(own))
            targets = {tuple(own[a : a + n]) for a in range(len(own) - n + 1)} if n else set()
            for a in range(len(w) - n + 1):
                if n and tuple(w[a : a + n]) in targets:
                    hit.update(range(a, a + n))
                    if name is not None:
                        names.add(str(name))
        found.append((i, len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(found, key=repr)


def test_equals_brute_force(spark, documents, odd_rows):
    rng = random.Random(4)

    def text(n, vocabulary=60):
        return " ".join(rng.choice(["W{}x", "ü{}", "w{}y"]).format(rng.randrange(vocabulary)) for _ in range(n))

    items = [(i, text(rng.randrange(14, 40))) for i in range(12)]
    items += [(20, "w1y ü2"), (21, "W7x"), (22, ""), (23, None), (None, text(15)), (24, items[0][1]), (0, text(20)), (25, " ".join(["w3y"] * 20)), (10, items[1][1])]
    docs = list(odd_rows)
    for i in range(100, 150):
        parts = [text(rng.randrange(1, 200))]
        for _ in range(rng.randrange(3)):
            own = rng.choice(items)[1] or ""
            parts.append(own.upper().replace("Ü", "ü") if rng.random() < 0.5 else own.replace(" ", " - "))
            parts.append(text(rng.randrange(1, 30)))
        docs.append((i, ". ".join(parts)))
    docs += [docs[-1], (500, "w3y " * 3_000), (501, text(20_000, 5000) + " " + (items[3][1] or ""))]
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'q' AS window", "1 AS n")
    got = contamination(documents(docs).repartition(3), benchmark).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got), key=repr) == brute(docs, items)


def test_empty(spark, documents):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in contamination(documents([(1, "a b")]), benchmark).collect()] == [(2, 0, False)]
    one = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination(documents([]), one).count() == 0

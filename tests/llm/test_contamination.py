import random
import unicodedata

from talverk.llm import contamination as C


def brute(documents, items, run):
    def words(t):
        return C.words(t)

    out = set()
    for d, text in documents:
        w = words(text)
        runs = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
        for i, item in items:
            v = words(item)
            if d is not None and i is not None and any(tuple(v[k : k + run]) in runs for k in range(len(v) - run + 1)):
                out.add((d, i))
    return out


def test_words():
    assert C.words("Å-å  ÅB_c ﬁn 1½ straße") == ["å", "å", "åb", "c", "fin", "11", "2", "strasse"]
    assert C.words(None) == [] and C.words("") == []


def test_every_run_is_found(spark):
    rng = random.Random(2)
    vocabulary = [f"ord{k}" for k in range(40)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(5, 60)))) for k in range(25)]
    documents = []
    for d in range(300):
        text = rng.choices(vocabulary, k=rng.randint(0, 80))
        if rng.random() < 0.5:
            source = rng.choice(items)[1].split()
            size = rng.choice([12, 13, 14, 40])
            begin = rng.randrange(max(1, len(source) - size + 1))
            cut = source[begin : begin + size]
            if rng.random() < 0.2 and len(cut) > 3:
                cut.insert(len(cut) // 2, "annat")
            at = rng.randrange(len(text) + 1)
            text[at:at] = cut
        joined = rng.choice([" ", ", ", "\n", " – "]).join(text)
        documents.append((d, rng.choice([str.upper, str.title, str])(joined)))
    documents += [(1000, unicodedata.normalize("NFD", "å ö ".join(items[0][1].split()))), (1001, None), (None, items[1][1]), (1002, "")]
    items += [(500, None), (None, items[2][1]), (501, "")]
    d = spark.createDataFrame(documents, "doc_id long, text string").selectExpr("*", "1 as low", "'x' as shared")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'en' as suite")
    for run, block in ((13, C.BLOCK), (6, 600)):  # the second in several blocks
        got = C.leaked_items(d, "doc_id", "text", i, "item_id", "text", run, block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == brute(documents, items, run) and len(got) == len({(r["doc_id"], r["item_id"]) for r in got})
        assert all(0 < r["containment"] <= 1 and 0 < r["estimate"] <= 1 for r in got)
    assert C.leaked_items(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0
    assert C.leaked_items(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0


def test_repeated_keys_and_long_texts(spark):
    item = " ".join(f"w{k}" for k in range(30))
    d = spark.createDataFrame([(1, "nothing"), (1, item), (2, "z " * 200_000 + item)], "doc_id long, text string")
    i = spark.createDataFrame([(7, item), (7, item)], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["shared"]) for r in C.leaked_items(d, "doc_id", "text", i, "item_id", "text").collect())
    assert got == [(1, 7, 18), (2, 7, 18)]


def test_signatures():
    rng = random.Random(6)
    item = [f"w{k}" for k in range(60)]
    items = C.Items([(k, " ".join(item[:n])) for k, n in enumerate((12, 13, 25, 26, 60))], 13)
    assert sorted(items.words) == [1, 2, 3, 4] and [C.size_class(n, 13) for n in (13, 25, 26, 60, 104)] == [0, 0, 1, 2, 3]
    assert items.thresholds[0, 0] == 1 / len(items.sketches[0][2]) and items.thresholds[2, 0] < items.thresholds[1, 0] < 1
    # every run of 13 words shares a minimum under each function, in classes of all sizes
    known = C._Hashes()
    for _ in range(100):
        at = rng.randrange(48)
        text = [f"x{rng.randrange(9)}" for _ in range(20)] + item[at : at + 13] + [f"y{rng.randrange(9)}" for _ in range(20)]
        shingles = C.shingle_hashes(C.np.array([known[w] for w in text], C.np.uint64))
        for f in range(C.FUNCTIONS):
            assert items.sketches[f][4] & set(C.window_minima(shingles, 13, f).tolist())

import random

from talverk.llm import scans as S

WORDS = ["skatt", "skola", "nämnden", "utskottet", "genomför", "tillstyrker", "betänkande", "medan", "varje", "kommunen", "riksdagen", "förslaget", "handeln", "marknaden", "vägarna", "hamnen"]


def page(rng, lines=10):
    """Lines as scanned, their kinds, and the right text."""
    raw, kinds, right = [], [], []
    for k in range(lines):
        words = rng.choices(WORDS, k=6)
        shown, kind = list(words), set()
        if rng.random() < 0.2:
            j = next((j for j, w in enumerate(words) if "e" in w), None)
            if j is not None:
                shown[j] = words[j].replace("e", "c", 1)
                kind.add("misread")
        if rng.random() < 0.2:
            shown[0] = " ".join(shown[0])
            kind.add("misread")
        if k < lines - 1 and rng.random() < 0.3:
            whole = rng.choice(WORDS)
            right += words + [whole]
            raw.append(" ".join(shown) + " " + whole[:3] + rng.choice(S.BREAKS))
            kinds.append(kind | {"split"})
            if rng.random() < 0.3:
                raw.append(f"— {rng.randrange(300)} —")
                kinds.append({"furniture"})
            raw.append(whole[3:] + " medan")
            right.append("medan")
            kinds.append(set())
            continue
        right += words
        raw.append(" ".join(shown))
        kinds.append(kind)
        if rng.random() < 0.2:
            raw.append(rng.choice([f"KAMMAREN DEN {rng.randrange(1, 30)} MARS", f"[{rng.randrange(300)}]"]))
            kinds.append({"furniture"})
    return "\n".join(raw), kinds, " ".join(right)


def setup(spark):
    rng = random.Random(8)
    pages = [page(rng) for _ in range(60)]
    scans = spark.createDataFrame([(f"s{k}", [p[0], "", None]) for k, p in enumerate(pages)] + [("empty", []), ("null", None)], "u_id string, text array<string>").selectExpr("*", "'clash' as kinds")
    texts = [(False, [" ".join(rng.choices(WORDS, k=50))]) for _ in range(60)] + [(False, [None, ""]), (False, [])]
    corpus = spark.createDataFrame(texts + [(True, [p[0], None]) for p in pages], "scanned boolean, segments array<string>")
    samples = spark.createDataFrame([(p[0], p[2]) for p in (page(rng) for _ in range(40))] + [(None, "x")], "raw string, repaired string")
    return pages, scans, corpus, samples


def read(scans, corpus, samples, **kwargs):
    rows = S.read_scans(scans, "u_id", "text", corpus, samples, "raw", "repaired", **kwargs)
    return {(r["u_id"], k): p for r in rows.collect() for k, p in enumerate(r["parts"])}


def test_pages_are_repaired(spark):
    pages, scans, corpus, samples = setup(spark)
    got = read(scans, corpus, samples)
    assert len(got) == 180 and got["s0", 1]["text"] == "" and got["s0", 2]["kinds"] == []
    right = wrong = missed = same = 0
    for k, (_, kinds, text) in enumerate(pages):
        found = {(x["line_no"], x["kind"]) for x in got[f"s{k}", 0]["kinds"]}
        true = {(n, x) for n, all_ in enumerate(kinds) for x in all_}
        right, wrong, missed = right + len(found & true), wrong + len(found - true), missed + len(true - found)
        same += got[f"s{k}", 0]["text"] == text
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97 and same > 54
    # links that are not few come by a join, to the same end
    assert read(scans, corpus, samples, links_shared=0) == got


def test_edges(spark):
    _, scans, corpus, samples = setup(spark)
    assert read(scans.limit(0), corpus, samples) == {}
    bare = read(scans, corpus.where("scanned"), samples.limit(0))
    assert {x["kind"] for p in bare.values() for x in p["kinds"]} == {"split", "misread"}
    assert read(scans, corpus.limit(0), samples.limit(0)).keys() == bare.keys()


COMPOUNDS = ["järnvägsfrågan", "skogsfrågan", "skogsbruket", "järnvägsbruket", "skattefrågan", "skattebruket", "vägfrågan", "vägbruket", "handelsfrågan", "handelsbruket", "det", "som"]


def test_words():
    lexicon = S.Lexicon(dict.fromkeys(COMPOUNDS, 9), frozenset({"c:a"}), {})
    reader = S.Reader(lexicon, {}, S.np.array([-1.0]))
    [(kinds, text)] = reader.read(["dct som c:a skogs-\nfrågan 3,5 handelsbrukct t.ex. äldre-\noch Berg-\nEk H‐\nmm sk0gsfrågan och fram.Åter"])
    assert text == "det som c:a skogsfrågan 3,5 handelsbruket t.ex. äldre- och Berg-Ek Hmm skogsfrågan och fram.Åter"
    assert kinds == [(0, "misread"), (0, "split"), (1, "misread"), (3, "split"), (4, "misread")]
    long = "x" * 200_000 + "\n" + "a.b" * 50_000 + "\n" + "c" * 100_000 + "\n" + "skogs" * 3 + "bruket " + "skogs" * 30 + "brukct"
    more = S.Lexicon(dict.fromkeys([*COMPOUNDS, "skogsbrand", "skogsbrist"], 9), frozenset(), {})
    [(kinds, text)] = S.Reader(more, {}, S.np.array([-1.0])).read([long])
    assert kinds == [(3, "misread")] and text.endswith("skogs" * 30 + "bruket")  # words have no largest length
    assert reader.read([None, " \n ", ""]) == [([], "")] * 3
    # names keep their hyphen; a point within a frequent word is a misreading, within an abbreviation it isn't
    assert reader.read(["Herr Grimm-\nAlsk som äldre-\noch det"]) == [([], "Herr Grimm-Alsk som äldre- och det")]
    skill = S.Reader(S.Lexicon({"säljer": 9}, frozenset(), {}), {}, S.np.array([-1.0]))
    assert skill.read(["sälj.er t.ex"]) == [([(0, "misread")], "säljer t.ex")]


def test_links_are_chosen_by_vectors():
    vectors = {"bank": [1, 0], "bark": [0, 1], "pengar": [1, 0.1], "träd": [0.1, 1]}
    lexicon = S.Lexicon({"bank": 5, "bark": 5}, frozenset(), {w: S.np.array(v, float) / S.np.linalg.norm(v) for w, v in vectors.items()}, {("ɴ", "n"): -1.0, ("ɴ", "r"): -1.0})
    assert [w for w, *_ in lexicon.links("baɴk", lexicon.near(["pengar"]))] == ["bank", "bark"]
    assert [w for w, *_ in lexicon.links("baɴk", lexicon.near(["träd"]))] == ["bark", "bank"]
    links = {"baɴk": lexicon.links("baɴk")}
    reader = S.Reader(lexicon, {}, S.np.array([-1.0]), links)
    assert reader.read(["pengar baɴk", "träd baɴk"]) == [([(0, "misread")], "pengar bank"), ([(0, "misread")], "träd bark")]
    assert S.Reader(lexicon, {}, S.np.array([-1.0]), {}).read(["träd baɴk"]) == [([], "träd baɴk")]


def test_edits_are_weighed_by_samples():
    edits = S.weigh_edits([("dct är en skoia", "det är en skola")] * 3)
    assert edits["c", "e"] > edits["e", "c"] and edits["i", "l"] > edits["l", "i"]


def test_every_line_may_be_furniture():
    lexicon = S.Lexicon(dict.fromkeys(COMPOUNDS, 9), frozenset(), {})
    furniture = ["12)", "riksdagens protokoll", "forts. å nästa sida", "17."]
    raw = ["\n".join(["Det är skogsfrågan som vägfrågan", f, "och det som skattefrågan är."]) for f in furniture]
    lines = S.pa.array(furniture)
    patterns = dict.fromkeys(S.line_patterns(lines).tolist(), 0.5)
    samples = [(r, r.replace(f + "\n", "").replace("\n", " ")) for r, f in zip(raw, furniture)]
    reader = S.Reader(lexicon, patterns, S.train_lines(samples, lexicon, patterns))
    assert [kinds for kinds, _ in reader.read(raw)] == [[(1, "furniture")]] * 4

import random
import time

from talverk.llm import sentences as Z
from talverk.llm import splitting, tokenizer
from talverk.llm.tokenizer import BYTE_BPE_50K, TOKENIZERS, Encoder, encoder

PARTS = ["a", "'", "s", "'ll", " ", "  ", "\n", "\r\n", "\t", "1", "٣", "½", "å", "한국", "।", "。", "<|endoftext|>", "don't", "é", "‍", "\0", " ", "　", "🙂", "ord", "Ord.", "\x1c"]


def test_parts_give_the_ids_of_the_whole(monkeypatch):
    own = Encoder()
    rng = random.Random(3)
    for block in (20_000, 25):
        monkeypatch.setattr(tokenizer, "BLOCK", block)
        for _ in range(4000):
            text = "".join(rng.choices(PARTS, k=rng.randint(1, 50)))
            ids = own.encode(text)
            assert ids == own.bpe.encode_ordinary(text), repr(text)
            assert own.bytes_of(ids) == text.encode()


def test_long_texts_and_memory(monkeypatch):
    own = Encoder()
    monkeypatch.setattr(tokenizer, "REMEMBER", 10)
    text = " ".join(f"ord{k}" for k in range(30_000)) + "x" * 100_000
    assert own.decode(own.encode(text)) == text and len(own.known) <= 10
    assert own.encode("a\ud800b") == own.bpe.encode_ordinary("a�b")


def test_token_ids(spark):
    rows = [(1, "Hej <|endoftext|>"), (2, ""), (3, None), (3, " "), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' as ids")
    got = [(r["doc_id"], r["ids"]) for r in tokenizer.token_ids(df, "doc_id", "text").collect()]
    bpe = encoder().bpe
    assert sorted(got, key=str) == sorted([(1, bpe.encode_ordinary("Hej <|endoftext|>")), (2, []), (3, []), (3, bpe.encode_ordinary(" ")), (None, bpe.encode_ordinary("x"))], key=str)
    assert tokenizer.token_ids(df.limit(0), "doc_id", "text").count() == 0


def check(text, limit, overlap):
    own = splitting.Splitter(TOKENIZERS, BYTE_BPE_50K)
    pieces = own.split(text, limit, overlap)
    size = len(own.own.encode(text))
    assert bool(pieces) == (size > limit)
    if pieces:
        assert pieces[0][0] == 0 and pieces[-1][1] == size and pieces[0][2] == 0 and pieces[-1][3] == len(text)
        assert all(0 < e - b <= limit for b, e, *_ in pieces)
        for x, y in zip(pieces, pieces[1:]):
            assert y[0] == x[1] - overlap and y[1] > x[1] and y[3] >= x[3]
        ids = own.own.encode(text)
        for b, e, cb, ce, _ in pieces:
            assert own.own.bytes_of(ids[b:e]).endswith(text[cb:ce].encode())
    return pieces


def test_splitting_covers_every_text():
    rng = random.Random(5)
    words = ["ord", "mening.", "Vad?", "år", "\n", "\n\n", "\n\n\n", "# Rubrik", "報告書。", "ภาษี", "🙂", "xxxxxxxxxxxxxxxx", "1.", "\f"]
    for _ in range(300):
        check(rng.choice(["", " "]).join(rng.choices(words, k=rng.randint(1, 400))), rng.choice([20, 64, 100]), rng.choice([0, 5, 8]))
    for text in ("a" * 50_000, "語" * 5_000, " " * 30_000, "🙂" * 2_000, "x\n" * 5_000):
        check(text, 128, 16)


def test_cuts_lie_at_natural_places():
    text = "\n\n".join(" ".join(["Detta är en mening."] * 10) for _ in range(12))
    assert {p[4] for p in check(text, 200, 10)[:-1]} == {"paragraph"}
    text = " ".join(["Detta är en ganska lång mening om ingenting alls."] * 60)
    pieces = check(text, 100, 10)
    assert {p[4] for p in pieces[:-1]} == {"sentence"} and all(text[: p[3]].endswith(".") for p in pieces)


def test_cuts_after_characters_of_several_tokens():
    own = encoder()
    for sentence, stop in (("สภาผู้แทนราษฎรพิจารณาร่างพระราชบัญญัติงบประมาณ", "ณ"), ("समिति ने विद्यालय के लिए नया प्रस्ताव रखा है।", "।"), ("委员会审议了关于学校的报告𠮷。", "。")):
        assert any(b"\xef\xbf\xbd" in own.decode([t]).encode() for t in own.encode(sentence))  # characters of more than one token
        text = "\n\n".join(" ".join([sentence] * 3) for _ in range(30))
        assert {p[4] for p in check(text, 500, 10)[:-1]} == {"paragraph"}, sentence
        text = " ".join([sentence] * 60)
        pieces = check(text, 300, 10)
        assert {p[4] for p in pieces[:-1]} == {"sentence"} and all(text[: p[3]].endswith(stop) for p in pieces), sentence


def test_sentences_of_the_model():
    text = " ".join(["Vi ser t.ex. vägar enl. beslut nr. 3. Det är sant."] * 80)
    model = Z.Model({"t=.": 1.0, "p=t.ex": -3.0, "p=enl": -3.0, "p=nr": -3.0, "nk=lower": -3.0})
    own = splitting.Splitter(TOKENIZERS, BYTE_BPE_50K, model)
    pieces = own.split(text, 100, 10)
    assert {p[4] for p in pieces[:-1]} == {"sentence"} and all(text[: p[3]].endswith(("3.", "sant.")) for p in pieces)
    plain = splitting.Splitter(TOKENIZERS, BYTE_BPE_50K)
    assert any(text[: p[3]].endswith(("t.ex.", "enl.", "nr.")) for limit in range(20, 60) for p in plain.split(text, limit, 2))  # as a pattern has it
    assert not any(text[: p[3]].endswith(("t.ex.", "enl.", "nr.")) for limit in range(40, 80) for p in own.split(text, limit, 2))
    lines = "\n".join(["Namn\t1904\t12,5", "som går vidare"] * 60)  # a line that goes on in small letters is no end
    assert all(lines[p[3] :].startswith("\nNamn") for p in own.split(lines, 100, 10)[:-1])


def test_long_texts_take_linear_time():
    text = "Detta är en mening om ingenting alls. " * 270_000  # 10 MB
    own = splitting.Splitter(TOKENIZERS, BYTE_BPE_50K, Z.Model({"t=.": 1.0}))
    took = []
    for size in (len(text) // 8, len(text)):
        began = time.process_time()
        pieces = own.split(text[:size], 1024, 64)
        took.append(time.process_time() - began)
        assert len(pieces) > size / 8000
    assert took[1] < 20 * took[0] + 1


def test_split_oversized(spark):
    rows = [(1, "ord " * 300), (1, "ord " * 300), (2, "kort"), (3, ""), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as piece", "2 as begin")
    got = splitting.split_oversized(df, "doc_id", "text", 100, 10).collect()
    assert {r["doc_id"] for r in got} == {1} and len([r for r in got if r["piece"] == 0]) == 2
    assert splitting.split_oversized(df.limit(0), "doc_id", "text").count() == 0

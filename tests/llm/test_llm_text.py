"""Tokens and templates against the library and plain loops."""

import json
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from llm_fixtures import empty, messy  # noqa: F401
from kittally.llm import bpe, decontam

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return bpe.Encoder(bpe.Vocabulary(PATH)), Tokenizer.from_file(PATH)


def same(both, text):
    encoder, library = both
    packed = b"".join(encoder.encode(text))
    ids = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packed, "<u4").tolist() == ids
    assert bpe.decoded(encoder.vocabulary, packed) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " ", "a" * 30_000, "=-" * 20_000, " " * 70_000 + "x", "é" * 9000 + "\n\n  x", "it's we'll<|endoftext|>'s <|endoftext|>", "\U0001f600" * 5000, "\x85\x1c  q", "ab" * 70_000 + "'ll"])
def test_bpe_like_the_library(both, text):
    same(both, text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab the'lls1 9\n\t.,!é中 \U0001f600"), max_size=200))
def test_bpe_random(both, text):
    same(both, text)


def test_bpe_slices_and_windows(both, monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(bpe, "SLICE", 50)
    monkeypatch.setattr(bpe, "WINDOW", 40)
    for _ in range(30):
        same(both, "".join(rng.choice(["inon", "the", " ", "\n", "'s", "1", "é", "....", "zzzz"]) for _ in range(rng.randint(1, 800))))


@pytest.mark.parametrize("end", ["'ll", "'re", "'ve", "'d", "'lx", "!'ll", " 'll", "''ve"])
def test_bpe_slices_keep_contractions(both, monkeypatch, end):
    monkeypatch.setattr(bpe, "SLICE", 20)
    for before in range(12, 24):
        for rest in (" go on to the next slice", "s", "'ll've"):
            same(both, "so w" + "e" * (before - 4) + end + rest)
            same(both, " " * before + end + rest)


def test_lookahead_settles_every_token(both):
    """Tokens that end the lookahead before a cut are the same whatever follows."""
    encoder, rng = both[0], random.Random(2)
    reach, sizes = encoder.vocabulary.lookahead, encoder.vocabulary.bytes_of
    for _ in range(40):
        head = bytes(rng.choice(b"intheaosr-=") for _ in range(reach + 60))
        firsts = set()
        for _ in range(5):
            final, end = [], 0
            for i in encoder.merge(head + bytes(rng.choice(b"intheaosr-=") for _ in range(300))):
                if end + len(sizes[i]) > 60:
                    break
                final.append(i)
                end += len(sizes[i])
            firsts.add(tuple(final))
        assert len(firsts) == 1


def test_lookahead_by_hand():
    assert bpe.lookahead([]) == 0
    assert bpe.lookahead([(b"a", b"b"), (b"c", b"ab")]) == 2  # c waits for a, a for b
    with pytest.raises(ValueError):
        bpe.lookahead([(b"c", b"ab"), (b"a", b"b")])


def test_decoder_state():
    vocabulary = bpe.Vocabulary(PATH)
    decoder, single = bpe.Decoder(vocabulary), vocabulary.single
    assert decoder.feed(np.array([single[0xF0], single[0x9F]])) == ""
    assert decoder.feed(np.array([single[0x98], single[0x80], single[0xFF]])) == "\U0001f600�"
    assert decoder.feed(np.array([single[0xE4]]), True) == "�"


def test_bpe_frames(messy, empty, both):
    rows, frame = messy
    want = sorted(((k, np.array(both[1].encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()) for k, t, *_ in rows), key=repr)
    got = bpe.encode(frame, PATH)
    assert sorted(((r.doc_id, bytes(r.ids)) for r in got.collect()), key=repr) == want
    texts = sorted(((k, t or "") for k, t, *_ in rows), key=repr)
    assert sorted(map(tuple, bpe.decode(got, PATH).collect()), key=repr) == texts
    assert sorted(((r.doc_id, r.decoded) for r in bpe.round_trip(frame, PATH).collect()), key=repr) == texts
    assert bpe.round_trip(empty, PATH).count() == 0


def test_other_files_are_refused(tmp_path):
    with open(PATH, encoding="utf-8") as file:
        spec = json.load(file)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(tmp_path / "t.json"))


ITEM = "A train leaves Paris at 9 and travels 120 km to reach Lyon before Anna Berg wakes up and asks Anna Berg the time"


def docs(spark, *texts):
    return spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 as n", "2 as hash", "3 as at", "4 as slots")


def test_template():
    found = decontam.Template(ITEM, decontam._Lexicon())
    assert found.plain(0, 99) == "a train leaves <name> at <number> and travels <number> <unit> to reach <name> before <name> wakes up and asks <name> the time"
    assert found.slots(0, 99) == [("name", "Paris"), ("number", "9"), ("number", "120"), ("unit", "km"), ("name", "Lyon"), ("name", "Anna Berg"), ("name", "Anna Berg")]


def test_leaks(spark):
    bench = spark.createDataFrame([(7, ITEM), (8, None), (9, ""), (10, "short item of six words here")], "item_id long, text string")
    changed = ITEM.replace("Paris", "Rome").replace("9", "11").replace("120", "75").replace("km", "miles").replace("Anna Berg", "Lu Wu").replace("Lyon", "Bern")
    torn = changed.replace("asks Lu Wu", "asks Bo Ek")
    filler = "some words that stand before and after it in the text of a page"
    frame = docs(spark, f"{filler} {ITEM} {filler}", f"{filler}. {changed} {filler}", torn, filler, None, "", ITEM.upper(), " ".join(ITEM.split()[:9]), filler + " " + " ".join(ITEM.split()[2:20]))
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(frame, bench).collect()}
    assert set(got) == {(0, 7), (1, 7), (6, 7), (8, 7)}  # 6: a copy is a copy in capitals too
    assert got[0, 7].exact_slots and not got[1, 7].exact_slots
    done = {r.doc_id: r.contaminated for r in decontam.decontaminate(frame, bench).collect()}
    assert done == {i: i in (0, 1, 6, 8) for i in range(9)}
    assert not decontam.decontaminate(frame, bench.limit(0)).where("contaminated").count()
    assert decontam.decontaminate(frame.limit(0), bench).count() == 0


def test_leaks_split_runs_and_find_short_items(spark):
    long = "then Anna Berg buys apples in the shop near the old station and then she walks home with all of them while it rains on the town and on Anna Berg again"
    edge = "Paris has many bridges and every bridge in Paris was built by men"
    bench = spark.createDataFrame([(1, long), (2, edge), (3, "what is the capital of France"), (4, "red green blue and Anna Berg sings for nine people today")], "item_id long, text string")
    frame = docs(
        spark,
        "so it said. " + long.replace("on Anna Berg again", "on Anna Burg again") + " and so on",  # one later typo
        "page of text " + long + " and so on",
        "they say that " + edge.replace("every", "each") + " of stone",  # another word
        "they say that " + edge + " of stone",  # first word is a name here
        "Somebody asked What is the capital of France? and nobody knew it",
        "somebody asked what is the capital of Spain and nobody knew it",
        "colours are Red green blue and Lu Wu sings for two people today and more",
    )
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(frame, bench).collect()}
    assert set(got) == {(0, 1), (1, 1), (3, 2), (4, 3), (6, 4)}
    assert got[1, 1].tokens > got[0, 1].tokens >= decontam.RUN and got[4, 3].exact_slots and not got[6, 4].exact_slots


@pytest.mark.parametrize("change", [str, str.lower, str.upper, str.title, lambda t: t.replace("120 km", "120km"), lambda t: t.replace("120 km", "120KM").swapcase()])
def test_copies_in_other_letters_are_leaks(spark, change):
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    frame = docs(spark, f"before it {change(ITEM)} and after it", f"before it {change(' '.join(ITEM.split()[:11]))} and after it")
    assert [(r.doc_id, r.contaminated) for r in decontam.decontaminate(frame, bench).orderBy("doc_id").collect()] == [(0, True), (1, False)]


def test_rows_of_one_key_are_judged_apart(spark):
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    halves = [" ".join(ITEM.split()[:12]), " ".join(ITEM.split()[12:])]
    rows = [(1, f"so {ITEM} it is"), (1, "clean text under the same key"), (2, halves[0]), (2, halves[1]), (None, ITEM), (None, "clean too"), (3, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    done = decontam.decontaminate(frame, bench)
    judged = done.join(decontam.row_text(frame, "doc_id", "text").select("row", "text"), "row").select("text", "contaminated").collect()
    assert {r.text: r.contaminated for r in judged} == {t: t is not None and ITEM in t for _, t in rows}
    assert len(judged) == len(rows)


def test_leaks_two_sided(spark):
    """Every copied run is found whatever its case, and what else is found has a run of the item's template."""
    rng = random.Random(12)
    names, lexicon = ["Anna", "Bo", "Paris", "Lyon"], decontam._Lexicon()
    pool = [f"w{i}" for i in range(60)] + names * 4 + ["7", "12", "km", "hours"]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(5, 40)))) for i in range(12)]
    texts = []
    for _ in range(120):
        item = rng.choice(items)[1].split()
        a = rng.randrange(len(item))
        part = item[a : a + rng.randint(4, 30)]
        if rng.random() < 0.3:
            part = [rng.choice(names) if w in names else w for w in part]
        body = rng.choice([str, str.lower, str.upper, str.title])(" ".join(part))
        texts.append(" ".join(rng.choice(pool) for _ in range(rng.randint(0, 20))) + " " + body + " " + " ".join(rng.choice(pool) for _ in range(9)))
    core = lambda t: [w.strip(decontam.MARKS).lower() for w in t.split()]

    def run_of(seq, whole, least):
        size = min(least, len(whole))
        runs = {tuple(whole[i : i + size]) for i in range(len(whole) - size + 1)}
        return any(tuple(seq[i : i + size]) in runs for i in range(len(seq) - size + 1))

    def template(text, opening=8):
        return decontam.Template(text, lexicon, opening).tokens.tolist()

    copied = {(d, i) for d, t in enumerate(texts) for i, item in items if run_of(core(t), core(item), decontam.RUN)}
    alike = {(d, i) for d, t in enumerate(texts) for i, item in items for o in decontam.OPENINGS if run_of(template(t), template(item if o == 8 else item[:1].upper() + item[1:], o), decontam.RUN)}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs(spark, *texts), bench).collect()}
    assert copied <= got <= copied | alike
    assert len(copied) > 20


def test_leaks_against_exact_runs(spark, messy):
    """Without slots a leak is a run of 13 equal words (or the whole item)."""
    rows, frame = messy
    rng = random.Random(9)
    texts = [t.lower() for _, t, *_ in rows if t and len(t.split()) > 40][:12]
    items = [(i, " ".join(t.split()[5 : 5 + rng.randint(9, 30)])) for i, t in enumerate(texts)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    plain = [[w.strip(decontam.MARKS).lower() for w in t.split()] for _, t in items]
    want = set()
    for k, t, *_ in rows:
        w = [x.strip(decontam.MARKS).lower() for x in (t or "").split()]
        template = decontam.Template(t, decontam._Lexicon())
        if k is None or (template.kind != 0).any():
            continue
        for item in plain:
            size = min(13, len(item))
            runs = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)}
            if size >= decontam.WINDOW and any(tuple(w[i : i + size]) in runs for i in range(len(w) - size + 1)):
                want.add(k)
    got = {r.doc_id for r in decontam.decontaminate(frame, bench).where("contaminated").collect()}
    assert want <= got

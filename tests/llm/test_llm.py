"""p8 to p10 against the public tokenizer, exact packing and garbling on purpose."""

import itertools
import random
from array import array

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SMALL
from quillmill.llm import encoding, garbling, packing, queries
from quillmill.runtime import table

tiktoken = pytest.importorskip("tiktoken")
TOKENS = encoding.vocabulary()
ENCODER = encoding.Encoder(TOKENS)
KNOWN = tiktoken.Encoding("known", pat_str=encoding.PATTERN, mergeable_ranks={b: i for i, b in enumerate(TOKENS)}, special_tokens={})


def ids(text):
    out = array("i")
    ENCODER.ids(text, out)
    return out.tolist()


# --- p8 -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", " ", "a", "<|endoftext|>", "don't we'LL", "\r\n\r\n  x", "日本語の　文", "👩‍💻🚀", "a" * 5000, "ab" * 4000 + "_" * 999, "\x00\x01\x7f", "naïve\xa0café", "1234567890" * 50])
def test_ids_of_hard_texts(text):
    assert ids(text) == KNOWN.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="ab _-\n'slé0", max_size=200))
def test_ids_agree_with_the_public_tokenizer(text):
    assert ids(text) == KNOWN.encode_ordinary(text.encode("utf-8", "replace").decode())


def test_every_token_is_its_own_encoding():
    rng = random.Random(1)
    for i in rng.sample(range(256, len(TOKENS)), 3000):
        assert TOKENS[ENCODER.left[i]] + TOKENS[ENCODER.right[i]] == TOKENS[i]


def test_p8_on_the_table(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()}
    found = {r["doc_id"]: r["ids"] for r in queries.p8_ids(spark, SMALL).collect()}
    assert found == {i: KNOWN.encode_ordinary(t or "") for i, t in texts.items()}
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (2, "x y", 9), (2, "x y", 9)], "doc_id int, text string, ids int")
    assert sorted((r[0], list(r[1])) for r in encoding.encode(df, TOKENS).collect()) == [(1, []), (2, []), (2, [87, 331]), (2, [87, 331])]
    assert encoding.encode(df.limit(0), TOKENS).count() == 0


# --- p9 -------------------------------------------------------------------------------------------------------


def fewest(items, capacity):
    """Exact number of containers, by branch and bound."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= items[k]:
                j = rooms.index(room)
                go(k + 1, [*rooms[:j], room - items[k], *rooms[j + 1 :]])
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best[0]


def histogram(items):
    return {s: items.count(s) for s in set(items)}


@settings(max_examples=250, deadline=None)
@given(st.integers(5, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=8))))
def test_reduction_never_loses_the_optimum(case):
    capacity, items = case
    fixed, rest = packing.reduce(histogram(items), capacity)
    left = [s for s, n in rest.items() for _ in range(n)]
    assert sum(t for t, _ in fixed) + fewest(left, capacity) == fewest(items, capacity)
    placed = [s for t, p in packing.solve(histogram(items), capacity) for _ in range(t) for s, n in p for _ in range(n)]
    assert sorted(placed) == sorted(items) and all(sum(s * n for s, n in p) <= capacity for _, p in packing.solve(histogram(items), capacity))


def test_many_equal_items_cost_no_more():
    patterns = packing.solve({7: 10**9, 5: 10**9, 3: 10**8, 20: 5}, 20)
    assert sum(t * sum(s * n for s, n in p) for t, p in patterns) == 7 * 10**9 + 5 * 10**9 + 3 * 10**8 + 100 and len(patterns) < 50


def test_pack(spark):
    rng = random.Random(4)
    sizes = {k: rng.choice([0, 1, 500, 700, 1024, 2048, 2049, 5000, rng.randrange(1, 3000)]) for k in range(800)} | {k: 300 for k in range(800, 1200)}
    df = spark.createDataFrame([*sizes.items(), (5000, None)], "doc_id long, n_tokens long")
    rows = packing.pack(df).collect()
    held, pieces = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"]))
        if r["container"] is not None:
            held[r["container"]] = held.get(r["container"], 0) + r["n_tokens"]
    assert max(held.values()) <= 2048 and set(pieces) == {*sizes, 5000}
    for k, n in sizes.items():
        cut = sorted(pieces[k])
        assert sum(p for _, p in cut) == n and [s for s, _ in cut] == list(range(0, max(n, 1), 2048)) and (n > 2048 or len(cut) == 1)
    assert [r["container"] for r in rows if r["doc_id"] == 5000] == [None]
    assert len(held) <= 1.04 * -(-sum(sizes.values()) // 2048) and set(held) == set(range(len(held)))
    assert packing.pack(df.limit(0)).count() == 0


def test_p9_holds_every_document(spark):
    found = queries.p9_containers(spark, SMALL)
    assert found.select("doc_id").distinct().count() == table(spark, SMALL, "documents").count()
    assert found.where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(F.max("n")).first()[0] <= 2048


# --- p10 ------------------------------------------------------------------------------------------------------

SENTENCES = [
    "Die Größe der Datei wächst täglich um zwölf Zeilen.", "La máquina envió el mismo mensaje otra vez más.", "L’équipe a préféré garder la ligne complète.", "A sessão não foi concluída às três horas.",
    "Мы храним только первую копию каждого сообщения.", "ファイルに壊れた行が三件あります。", "会话在另一台机器上继续。", "Wszystkie błędne linie zapisaliśmy osobno.",
]


def corpus():
    rng = random.Random(3)
    rows = []
    for k in range(600):
        rows.append((k, "Plain start. " + " ".join(rng.choice(SENTENCES) for _ in range(3))))
    bad = {}
    pairs = [("cp1252", "utf-8"), ("latin-1", "utf-8"), ("mac_roman", "utf-8"), ("cp437", "utf-8"), ("cp1252", "cp1251"), ("cp1251", "cp1252"), ("koi8-r", "cp1251")]
    for k, (sentence, (wrong, right)) in enumerate(itertools.product(SENTENCES, pairs)):
        data = garbling.to_bytes(sentence, right)
        text = None if data is None else garbling.from_bytes(data, wrong)
        if text and text != sentence and k % 3 == 0:
            bad[1000 + k] = (f"{SENTENCES[k % 8]} {text}", f"{SENTENCES[k % 8]} {sentence}")
    return rows, bad


def test_garbled_text_is_found_and_restored(spark):
    rows, bad = corpus()
    extra = [(2000, None), (2001, ""), (2002, "plain ASCII only"), (2003, "lost � mark"), (2004, "…"), (2005, "x" * 200_000 + " é"), (2007, "日本" * 100_000)]
    twice = SENTENCES[0].encode().decode("latin-1").encode().decode("latin-1")
    docs = spark.createDataFrame([*rows, *((k, t) for k, (t, _) in bad.items()), *extra, (2006, twice)], "doc_id long, text string").repartition(4)
    model, margin = garbling.fit(docs)
    rows = garbling.inspect(docs, model, margin).where("found").collect()
    found = {r["doc_id"]: r["restored"] for r in rows}
    assert {r["doc_id"] for r in rows if r["lost"]} == {2003} and {r["doc_id"] for r in rows} == {r["doc_id"] for r in garbling.found_ids(garbling.Corpus.of(docs), model, margin).collect()}
    expected = {*bad, 2003, 2006}
    assert len(set(found) & expected) >= 0.95 * len(expected) and len(set(found) - expected) <= 1
    right = [k for k, (_, t) in bad.items() if found.get(k) == t]
    assert len(right) >= 0.9 * len(bad) and found[2006] == SENTENCES[0] and found[2003] is None
    assert garbling.inspect(docs.limit(0), model, margin).count() == 0


def test_a_third_of_copies_of_one_garbled_text(spark):
    """Copies of one garbled text that is nowhere clean, a third of all rows, don't pass as clean."""
    rows, _ = corpus()
    bad = "Der nächste Schlüssel öffnet später die übrigen Türen.".encode().decode("latin-1")
    docs = spark.createDataFrame([*rows, *((1000 + k, bad) for k in range(300))], "doc_id long, text string").repartition(4)
    found = {r["doc_id"] for r in garbling.inspect(docs, *garbling.fit(docs)).where("found").collect()}
    assert found == {*range(1000, 1300)}


def test_margin_from_segments_held_out_whole(spark, monkeypatch):
    """The margin is from whole segments that no training saw, of all documents."""
    rng = random.Random(5)
    words = sorted({w.strip(".。") for s in SENTENCES for w in s.split()})
    docs = spark.createDataFrame([(k, "x" * 5000 + " " + " ".join(rng.choice(words) for _ in range(9)) + f" é{k}.") for k in range(2500)], "doc_id long, text string")
    trained, held = [], []
    train, margin = garbling.train, garbling.validated_margin
    monkeypatch.setattr(garbling, "train", lambda c, df, *more: trained.append({r[0] for r in df.select("segment").collect()}) or train(c, df, *more))
    monkeypatch.setattr(garbling, "validated_margin", lambda c, df, model: held.append({r[0] for r in df.select("segment").collect()}) or margin(c, df, model))
    garbling.fit(docs)
    whole = {r[1] for r in docs.collect()}
    assert len(held) == 1 and all(not t & held[0] and t | held[0] == whole for t in trained[:2])
    assert trained[2:] == held * 2  # only added when the margin is there
    assert 200 < len(held[0]) < 420


def test_bounds_leave_no_segment_out(spark):
    """Segments that aren't suspects have no candidate beyond the margin, and those that are dirty are so by brute force."""
    corpus = garbling.Corpus.of(table(spark, SMALL, "documents").select("doc_id", "text"))
    model = garbling.train(corpus, corpus.segments.where("not garbled"))
    scorer = garbling.Scorer(model)
    best = {r["sid"]: scorer.best(r["segment"])[0] for r in corpus.segments.collect()}
    for margin in (0.5, garbling.LEAST):
        assert {r["sid"] for r in garbling.dirty(corpus, model, margin).collect()} == {k for k, g in best.items() if g > margin}


def test_tables_grow_with_the_corpus(spark, monkeypatch):
    corpus = garbling.Corpus.of(table(spark, SMALL, "documents").select("doc_id", "text"))
    monkeypatch.setattr(garbling, "BITS", (10, 10, 10))
    model = garbling.train_to_fit(corpus, corpus.segments)
    assert model.bits[0] > 10 and model.fill() <= garbling.FULL
    assert garbling._slots(["ab😀"], model.bits)[0][4].tolist() == [ord("😀")]


def test_every_level_is_undone(spark):
    rows, _ = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, margin = garbling.fit(docs)
    text = SENTENCES[0]
    for _ in range(5):
        text = text.encode().decode("latin-1")
    assert garbling.Scorer(model).restore(text, margin) == (SENTENCES[0], False)
    assert garbling.Scorer(model).restore("Die Gr\ufffd\ufffde der Datei", margin) == (None, True)
    assert garbling.Scorer(model).restore(SENTENCES[0], margin) == (None, False)


def test_margin_by_histogram():
    clean, garbled = [0.0] * 95 + [4.0] * 3 + [6.0] * 2, [5.0] * 10 + [30.0] * 90
    bins = [[sum(garbling.bin_of(g) == k for g in gains) for k in range(garbling.BINS + 1)] for gains in (clean, garbled)]
    found = garbling.margin_of(*map(garbling.np.array, bins))
    cost = lambda m: garbling.PRIOR * sum(g <= m for g in garbled) / 100 + (1 - garbling.PRIOR) * sum(g > m for g in clean) / 100
    assert cost(found) <= min(map(cost, [garbling.LEAST, *clean, *garbled])) + 1e-9 and 6 <= found < 6 + garbling.BIN


def test_p10_on_empty_and_small_tables(spark):
    empty = table(spark, SMALL, "documents").select("doc_id", "text").limit(0)
    assert garbling.inspect(empty, *garbling.fit(empty)).count() == 0
    docs = table(spark, SMALL, "documents").count()
    assert 0 < queries.p10_found(spark, SMALL).count() < 0.1 * docs


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60), st.integers(0, len(garbling.CHAINS) - 1))
def test_chains_undo_what_they_did(text, chain):
    bad = garbling.garble(text, chain)
    if bad is not None:
        for wrong, right in garbling.CHAINS[chain]:
            bad = garbling.from_bytes(garbling.to_bytes(bad, wrong), right)
        assert bad == text

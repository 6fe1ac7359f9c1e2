import math
import os
import random
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from simweave.llm import mojibake, quality
from simweave.llm.mojibake import restore_encoding, train
from simweave.llm.packing import TightestFit, best_fit_plan, fill_containers
from simweave.llm.quality import clean_labels, induce_rules, learn_rules, rules_sql, text_statistics
from simweave.llm.tokens import TOKENIZERS, decode_corpus, encode_corpus
from simweave.llm.visual import visual_forms
from simweave.sources.tables import table

# visual forms

SAME = [
    ("ＡＢＣ１２，", "ABC12,"), ("café", "café"), ("ﬁne ﬀ", "fine ff"), ("a​b﻿­c", "abc"), ("a b　c d", "a b c d"),
    ("a‑b‐c", "a-b-c"), ("Мосkвa", "Mockвa"), ("ΑΒΕ ο", "ABE o"), ("⼯⽅", "工方"), ("量", "量"), ("räum", "räum"), ("гӓ", "гä"), ("𝐀𝑏", "Ab"), ("", ""),
]
DIFFERENT = [("x²", "x2"), ("①", "1"), ("½", "1/2"), ("H₂O", "H2O"), ("µm", "um"), ("A", "a"), ("é", "e"), ("0", "O"), ("ж", "x"), ("“", '"'), ("⑴", "(1)"), ("a–b", "a-b")]


def test_visual_forms(spark):
    rows = [(i, a, b, "x") for i, (a, b) in enumerate(SAME + DIFFERENT)] + [(100, None, "a", "x"), (100, None, "a", "x"), (None, "Ａ" * 50_000, "A" * 50_000, None)]
    df = spark.createDataFrame(rows, "id bigint, a string, b string, t0 string")
    out = {r.id: r for r in visual_forms(df, ["id"], ["a", "b"]).collect()}
    for i, pair in enumerate(SAME):
        assert out[i].a == out[i].b, pair
    for i, pair in enumerate(DIFFERENT, len(SAME)):
        assert out[i].a != out[i].b, pair
    assert out[100].a is None and out[None].a == out[None].b
    assert visual_forms(df, ["id"], ["a"]).count() == len(rows) and visual_forms(df.limit(0), ["id"], ["a"]).count() == 0
    twice = visual_forms(visual_forms(df, ["id"], ["a", "b"]), ["id"], ["a", "b"])
    assert {r.id: r.a for r in twice.collect()} == {i: r.a for i, r in out.items()}


# encodings


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/matched_texts.parquet").select("match_id", "left_text")
    return train(rows, "left_text")


def _clean(spark, n=400):
    rows = spark.read.parquet("/root/testdata/sf0.1/matched_texts.parquet").select("left_text").where("length(left_text) > 60").orderBy(F.xxhash64("left_text")).limit(3000)
    texts = [r[0] for r in rows.collect() if not mojibake._UNCLEAN.search(r[0]) and not r[0].isascii()]
    # look-alikes and width are another problem's
    return [t for t in texts if unicodedata.normalize("NFKC", t.replace("，", "").replace("（", "").replace("）", "").replace("：", "")) == t.replace("，", "").replace("（", "").replace("）", "").replace("：", "")][:n]


def _two_bytes(text):
    """Whether the text has a form in the two-byte set that files are written in."""
    try:
        return bool(text.encode("gbk"))
    except UnicodeEncodeError:
        return False


@pytest.mark.parametrize(("wrong", "right"), [("cp1252", "utf-8"), ("gb18030", "utf-8"), ("cp1251", "utf-8"), ("mac-roman", "utf-8"), ("cp1252", "gb18030"), ("cp1252", "cp1251"), ("cp1251", "koi8-r")])
def test_held_out_garbling_is_found_and_undone(spark, model, wrong, right):
    pairs = [(t, mojibake.garble(t, wrong, right)) for t in _clean(spark) if right != "gb18030" or _two_bytes(t)]
    # a sign or two in a long text is no test of a single-byte set
    pairs = [(t, g) for t, g in pairs if g and g != t and sum(c > "\x7f" for c in t) > 6][:150]
    found = mojibake.restore_batch([g for _, g in pairs], *model)
    assert len(pairs) >= 20
    assert sum(r is not None for r in found) >= 0.97 * len(pairs)
    whole = [(t, g, r) for (t, g), r in zip(pairs, found, strict=True) if r and "�" not in g]
    assert sum(r[0] == t for t, _, r in whole) >= 0.9 * len(whole)


def test_clean_texts_stay(spark, model):
    texts = _clean(spark, 1500)
    assert sum(r is not None for r in mojibake.restore_batch(texts, *model)) <= 0.003 * len(texts)


def test_restoring_edges(spark, model):
    twice = mojibake.garble(mojibake.garble("Die Türen sind geprüft und später für die Übergabe größer", "cp1252", "utf-8"), "cp1252", "utf-8")
    rows = [(1, "The firm’s own".encode().decode("cp1252") + " sheet", "x"), (2, None, "x"), (3, "", "x"), (4, "plain", "x"), (None, twice, "x"), (5, "Der Bieter prüft die Lüfter. " * 4_000, "x"), (1, "The firmâ€™s own sheet", "x")]
    df = spark.createDataFrame(rows, "id bigint, left_text string, restored string")
    out = restore_encoding(df, "id", "left_text", *model).collect()
    assert sorted((r.id or 0) for r in out) == [0, 1, 1]
    assert {r.restored for r in out} == {"The firm’s own sheet", "Die Türen sind geprüft und später für die Übergabe größer"}
    assert restore_encoding(df.limit(0), "id", "left_text", *model).count() == 0
    empty, margin = train(df.limit(0), "left_text")
    assert mojibake.restore_batch([None, "", "abc"], empty, margin) == [None, None, None]


@pytest.mark.parametrize("most_wrong", [0.0002, 0.002])
def test_margin_is_validated_on_all_clean_rows(spark, monkeypatch, most_wrong):
    monkeypatch.setattr(mojibake, "MOST_WRONG", most_wrong)
    monkeypatch.setattr(mojibake.validated_margin, "__defaults__", (most_wrong,))
    rows = spark.read.parquet("/root/testdata/sf0.01/matched_texts.parquet").select("left_text")
    # texts that no pattern keeps from the clean ones, though they gain by being restored
    plain = "L'atelier de métrologie déplace {} chemins de câbles galvanisés de type FDB/97737 à Hélocourt dès le dépôt."
    odd = spark.createDataFrame([(w, mojibake.garble(plain.format(i), w, "cp1252")) for w in ("cp437", "cp850", "cp1251", "koi8-r") for i in range(300)], "chain string, left_text string")
    by_hash = [tuple(r) for r in odd.orderBy(F.xxhash64("left_text")).collect()]
    last = list(dict(by_hash).values())  # of each chain the one of greatest hash
    for planted in ([], [by_hash[0][1]], last):
        both = rows.union(spark.createDataFrame([(t,) for t in planted], "left_text string"))
        model, margin = train(both, "left_text")
        clean = sorted({r[0] for r in both.where("left_text <> ''").collect() if not mojibake._UNCLEAN.search(r[0])})
        gains = sorted(r[2] for r in mojibake.restore_batch(clean, model) if r)
        allowed = int(mojibake.MOST_WRONG * len(clean))
        assert len(clean) > 2_200 and len(gains) >= len(planted)
        least = mojibake.MARGIN if allowed else -math.log(mojibake.MOST_WRONG / 3)
        assert margin == pytest.approx(max(least, gains[-allowed - 1]) if len(gains) > allowed else least, abs=0.01)
        assert sum(r is not None and r[2] > margin + 0.01 for r in mojibake.restore_batch(clean, model)) <= allowed


def test_lost_characters_stay_lost(model):
    text = "若低噪声密封圈出现故障，仓储科定期维护其中的阀门。北坞仓库的闸阀由供货单位妥善保管。"
    garbled = mojibake.garble(text, "cp1252", "utf-8").replace("\x8d", "\ufffd").replace("\x8f", "\ufffd").replace("å", "\ufffd")
    restored = mojibake.restore_batch([garbled], *model)[0][0]
    kept = [c for c in restored if c != "\ufffd"]
    assert "\ufffd" in restored and len(kept) > 25 and set(kept) <= set(text)
    assert mojibake.undo("\ufffd\ufffdé", "cp1252", "cp1251") == "\ufffd\ufffdй"


def test_garbled_many_times(spark, model):
    text = "Die Türen sind geprüft und größer"
    for _ in range(5):
        text = mojibake.garble(text, "cp1252", "utf-8")
    assert mojibake.restore_batch([text], *model)[0][0] == "Die Türen sind geprüft und größer"


def test_rounds_are_cut_as_a_greater_margin_would(spark, model):
    fine = _clean(spark, 150)
    texts = [g for t in fine for w, r in (("cp1252", "utf-8"), ("mac-roman", "cp1252")) if (g := mojibake.garble(t, w, r))]
    texts += [g for t in fine[:40] if (g := mojibake.garble(mojibake.garble(t, "cp1252", "utf-8"), "mac-roman", "cp1252"))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, text string")
    tried = mojibake._tried(df, model[0])
    for margin in (10.0, 14.0, 30.0):
        want = {i: r for i, r in enumerate(mojibake.restore_batch(texts, model[0], margin)) if r}
        got = {r.id: (r.restored, r.chain) for r in mojibake._cut(tried, margin).collect()}
        assert got == {i: r[:2] for i, r in want.items()} and got


@pytest.mark.parametrize(("wrong", "right", "seen", "last"), [("cp1252", "mac-roman", 1, "der"), ("cp1251", "cp1252", 2, "der"), ("cp1252", "utf-8", 1, "der"), ("cp1252", "utf-8", 5, "über die")])
def test_weak_zones_count_together(wrong, right, seen, last):
    plain = ["Die Tür für die Prüfung der Räume steht über der Höhe", "für die Türen", "die Prüfer prüfen die Tür für uns"]
    # garbled signs that the model has seen a few times are only a little odd, each for itself
    model = mojibake.Model.of(mojibake.count_grams(plain * 400 + [mojibake.garble(t, wrong, right) for t in plain] * seen))
    text = f"Eine Tür für uns und eine Prüfung {last} Höhe"
    restored, chain, gain = mojibake.restore_batch([mojibake.garble(text, wrong, right)], model)[0]
    assert restored == text and chain.startswith(f"{right} read as {wrong}") and gain > mojibake.MARGIN
    assert mojibake.restore_batch([text], model) == [None]


@pytest.fixture(scope="module")
def noisy(spark):
    """A model of other texts and of 7.5 million characters without two alike trigrams, more than its tables have slots."""
    points = np.random.default_rng(5).integers(0xF0000, 0xF3000, (30_000, 250)).tolist()
    noise = spark.createDataFrame([("".join(map(chr, p)),) for p in points], "left_text string")
    rows = spark.read.parquet("/root/testdata/sf0.1/matched_texts.parquet").select("left_text")
    return mojibake._train(rows.where(~F.col("left_text").isin(_clean(spark))).union(noise), "left_text")


@pytest.mark.parametrize(("wrong", "right"), [("cp1252", "utf-8"), ("cp1252", "cp1251"), ("gb18030", "utf-8")])
def test_noise_does_not_make_garbled_text_usual(spark, noisy, wrong, right):
    pairs = [(t, g) for t in _clean(spark) if (g := mojibake.garble(t, wrong, right)) and sum(c > "\x7f" for c in g) > 6][:150]
    found = mojibake.restore_batch([g for _, g in pairs], noisy, 9.6)
    assert len(pairs) >= 20 and sum(r is not None for r in found) >= 0.97 * len(pairs)


def test_model_does_not_depend_on_the_size_of_the_collection(spark, monkeypatch):
    rows = spark.read.parquet(f"{SMALL}/matched_texts.parquet").select("left_text").where("left_text <> ''").coalesce(1)
    monkeypatch.setattr(mojibake, "AS_MANY", 20_000, raising=False)
    once, often = (mojibake._train(r, "left_text") for r in (rows, rows.union(rows).union(rows)))
    assert once.one.sum() == pytest.approx(20_000, rel=1e-3) and often.one.sum() == pytest.approx(20_000, rel=1e-3)
    assert all(t[t > 0].min() > 0.999 for t in (once.three, once.two))
    assert np.allclose(once.three, often.three, atol=0.5) and np.allclose(once.two, often.two, atol=0.5)


def test_most_frequent_grams_are_kept(spark):
    grams = spark.createDataFrame([(i, n) for i, n in enumerate([1] * 5 + [2, 2, 3, 70, 10**12])], "gram bigint, n bigint")
    for most, left in ((10, 10), (9, 5), (5, 5), (4, 3), (3, 3), (1, 1), (0, 0)):
        assert sorted(r.gram for r in mojibake._frequent(grams, most).collect()) == list(range(10 - left, 10))
    assert mojibake._frequent(grams.limit(0), 5).count() == 0


# tokens


def test_ids_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    texts = ["Hello world", "  two  spaces\n\n\nand lines ", "关于第703标段，DDB/43861", "<|endoftext|> is text", "Ünïcödé 👷🏽‍♀️ \x01\x1f", None, "", " ", "x" * 50_000, "don't we'll 12345678"]
    library = tokenizers.Tokenizer.from_file(os.path.join(TOKENIZERS, "byte_bpe_50k.json"))
    library.encode_special_tokens = True
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "null id", "x"), (0, texts[0], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, word string").repartition(3)
    for block in (10, 3_000_000):
        out = encode_corpus(df, "doc_id", "text", block=block).collect()
        assert len(out) == len(rows)
        got = {r.doc_id: list(r.ids) for r in out}
        assert got == {i: library.encode(t or "", add_special_tokens=False).ids for i, t, _ in rows}
    counts = {r.doc_id: r.tokens for r in encode_corpus(df, "doc_id", "text", counts=True).collect()}
    assert counts == {i: len(ids) for i, ids in got.items()}
    back = {r.doc_id: r.text for r in decode_corpus(encode_corpus(df, "doc_id", "text"), "doc_id", "ids").collect()}
    assert back == {i: t or "" for i, t, _ in rows}
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_decoding_edges(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [15496])], "i bigint, ids array<int>")
    assert {r.i: r.text for r in decode_corpus(df, "i", "ids").collect()} == {1: None, 2: "", 3: "Hello"}


# containers


def _one_by_one(sizes, capacity):
    free = []
    for s in sorted(sizes, reverse=True):
        fits = [(f, k) for k, f in enumerate(free) if f >= s]
        if fits:
            free[min(fits)[1]] -= s
        else:
            free.append(capacity - s)
    return sorted(free)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    random.seed(seed)
    capacity = random.choice([7, 20, 100])
    sizes = [random.randrange(1, capacity + 1) for _ in range(random.randrange(0, 300))]
    counts = {s: sizes.count(s) for s in set(sizes)}
    runs, total = best_fit_plan(counts, capacity)
    used = [0] * total
    for size, _, items, first, each in runs:
        for k in range(items):
            used[first + k // each] += size
    assert sorted(capacity - u for u in used) == _one_by_one(sizes, capacity)


def test_segment_tree():
    tree = TightestFit(10)
    assert tree.first(0) is None
    for r in (3, 7, 10):
        tree.set(r, True)
    assert [tree.first(s) for s in (0, 3, 4, 7, 8, 10)] == [3, 3, 7, 7, 10, 10]
    tree.set(7, False)
    assert tree.first(4) == 10


def test_containers(spark):
    random.seed(1)
    rows = [(i, random.choice([0, 3, 3, 3, 7, 10, 11, 25, None, -2]), "x") for i in range(200)] + [(1, 5, "x"), (1, 5, "x"), (None, 4, "x")]
    df = spark.createDataFrame(rows, "id bigint, size bigint, bucket string").repartition(4)
    out = fill_containers(df, "id", "size", 10).collect()
    used = {}
    for r in out:
        assert r.end - r.start <= 10
        used[r.container] = used.get(r.container, 0) + r.end - r.start
    assert max(used.values()) <= 10 and set(used) == set(range(len(used)))
    assert sum(used.values()) == sum(max(0, s or 0) for _, s, _ in rows)
    pieces = [p for _, s, _ in rows for p in ([10] * ((s or 0) // 10) + [(s or 0) % 10] if (s or 0) > 0 else [])]
    assert len(used) == len(_one_by_one([p for p in pieces if p], 10))
    assert all(r.piece == 0 for r in out if r.end - r.start < 10 and r.start == 0)
    again = fill_containers(df.repartition(2), "id", "size", 10).where("id IS NOT NULL").orderBy("id", "piece", "container").collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in fill_containers(df, "id", "size", 10).where("id IS NOT NULL").orderBy("id", "piece", "container").collect()]
    assert fill_containers(df.limit(0), "id", "size", 10).count() == 0
    assert {r.container for r in fill_containers(df.where("size = 0"), "id", "size", 10).collect()} == {0}


# quality


def test_statistics(spark):
    words = spark.createDataFrame([("en", "the", 1), ("en", "is", 2), ("zh", "的", 1), (None, None, None)], "lang string, word string, word_rank int")
    rows = [(1, "The cat is here.\n- item\n\n", "x"), (2, None, "x"), (3, "", "x"), (4, " \t\n ", "x"), (5, "我的书", "x"), (5, "我的书", "x"), (None, "the end.", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, line string")
    out = {r.doc_id: r for r in text_statistics(df, "doc_id", "text", words).collect()}
    a = out[1]
    assert (a.words, a.lines, a.chars) == (5, 2, 18)
    assert a.mean_word_length == pytest.approx(16 / 5) and a.symbol_ratio == pytest.approx(2 / 18)
    assert a.punctuated_lines == 0.5 and a.common_share == pytest.approx(2 / 5)
    assert a.item_share == pytest.approx(5 / 18) and a.common_4 == a.common_16 == a.ended_share == pytest.approx(13 / 18)
    for i in (2, 3, 4):
        assert out[i].chars == 0 and out[i].words == 0 and out[i].symbol_ratio is None
    assert out[5].words == 3 and out[5].common_share == pytest.approx(1 / 3)
    assert out[None].chars == 7
    assert text_statistics(df.limit(0), "doc_id", "text", words).count() == 0
    assert text_statistics(df, "doc_id", "text", words.limit(0)).count() == 6


def test_long_lists_of_common_words_count_whole(spark):
    def name(i):
        return "w" + "".join("abcdefghij"[int(c)] for c in f"{i:04}")

    words = spark.createDataFrame([("en", name(i), i) for i in range(6_000)], "lang string, word string, word_rank int")
    df = spark.createDataFrame([(1, f"{name(0)} {name(5_500)} {name(5_999)} {name(6_000)}")], "doc_id bigint, text string")
    assert text_statistics(df, "doc_id", "text", words).first().common_share == pytest.approx(3 / 4)


def test_rules_find_a_planted_list():
    random.seed(2)
    x = pd.DataFrame({f: [random.random() for _ in range(900)] for f in quality.FEATURES})
    truth = (x.symbol_ratio > 0.8) | ((x.digit_ratio < 0.3) & (x.common_share < 0.2))
    x["y"] = [t != (random.random() < 0.03) for t in truth]
    rules = induce_rules(x, "y")
    got = pd.Series(False, index=x.index)
    for rule in rules:
        got |= quality._covers(rule, x)
    assert (got == truth).mean() > 0.96
    moved = [tuple(quality.Condition(c.feature, c.at_most, c.value + 0.04) for c in rule) for rule in rules]
    errors = lambda found: (pd.Series(np.any([quality._covers(r, x) for r in found], axis=0)) != x.y).sum()
    assert errors(quality.revise(moved, x, "y")) < errors(moved) and errors(quality.revise(rules, x, "y")) <= errors(rules)
    assert quality.revise([], x, "y") == [] and quality.revise(rules, x.iloc[:0], "y") == rules
    assert rules_sql([]) == "0" and rules_sql(rules).startswith("CASE WHEN")
    assert induce_rules(x.iloc[:0], "y") == []


def test_labels(spark):
    rows = [(1, "Prose"), (1, "prose"), (2, "list"), (2, "prose"), (3, None), (None, "junk"), (4, " Junk ")]
    df = spark.createDataFrame(rows, "doc_id bigint, kind string")
    assert {r.doc_id: r.not_prose for r in clean_labels(df, "doc_id", "kind").collect()} == {1: False, 4: True}


def test_held_out_labels(spark):
    where = "/root/testdata/sf0.1"
    statistics = text_statistics(table(spark, where, "documents"), "doc_id", "text", table(spark, where, "common_words"))
    labels = clean_labels(table(spark, where, "doc_labels"), "doc_id", "kind")
    train_part, test_part = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    labelled = statistics.join(labels.select("doc_id"), "doc_id", "left_semi")
    rules = learn_rules(labelled, train_part, "doc_id")
    judged = labelled.where("chars > 0").withColumn("no", F.expr(rules_sql(rules)) > 0).join(test_part, "doc_id")
    # some labels are wrong by themselves
    assert judged.agg(F.avg((F.col("no") == F.col("not_prose")).cast("double"))).first()[0] > 0.95


def test_small_tables_run(spark):
    from simweave.llm.queries import QUERIES

    for name in ("p6_found", "p7_found", "p8_ids", "p9_fill", "p10_statistics"):
        assert QUERIES[name](spark, SMALL).count() > 0

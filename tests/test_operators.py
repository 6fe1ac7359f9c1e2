import os

from pyspark.sql import functions as F

from simweave import storage
from simweave.config import PRESETS, AnalysisConfig, feature_file_cap
from simweave.functions.text import is_readable, jaccard, level, normalize_text, preview
from simweave.operators import chunks as C
from simweave.operators import compare as X
from simweave.operators import groups as G
from simweave.operators import images as I
from simweave.operators import recall as R
from simweave.operators import skew
from simweave.plans.pipeline import Analysis

import pytest

CONFIG = PRESETS["balanced"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "expected"),
    [(" A股！深圳 长亮科技 ", "a股深圳 长亮科技"), ("naïve  Ünit", "nave nit"), ("a 　b ", "a b"), ("K1", "1"), ("", ""), ("\U000f0ac5 x", "\U000f0ac5 x")],
)
def test_normalize(spark, text, expected):
    assert one(spark, normalize_text(F.lit(text))) == expected


def test_preview_and_readable(spark):
    assert one(spark, is_readable(F.lit("\U000f0753"))) is False
    assert one(spark, preview(F.lit("x" * 361))) == "x" * 360 + "..."
    assert one(spark, preview(F.lit("x" * 360))) == "x" * 360
    assert one(spark, preview(F.lit("a\U000f0753"))).startswith("[no readable")


def test_levels(spark):
    rows = spark.createDataFrame([(0.85,), (0.7,), (0.5,), (0.49,)], "s double").select(level(F.col("s")).alias("l")).collect()
    assert [r.l for r in rows] == ["Extreme", "High", "Medium", "Low"]


def test_validation():
    ok = AnalysisConfig(paths=("a", "b"))
    ok.validate()
    for change in ({"paths": ("a",)}, {"text_threshold": 1.1}, {"min_chunk_chars": 29}, {"target_chunk_chars": 79}, {"chunk_overlap_chars": 500}, {"shingle_size": 13}, {"max_matches_per_pair": 0}):
        with pytest.raises(ValueError):
            AnalysisConfig(**({"paths": ("a", "b")} | change)).validate()
    assert [PRESETS[p].phash_distance for p in ("balanced", "exhaustive")] == [6, 7]
    assert [feature_file_cap(n) for n in (1, 3, 4, 7, 100)] == [1, 3, 2, 4, 10]


def test_repeated_headers(spark):
    pages = spark.createDataFrame([("f", i, f"Quarterly header\nbody text number {i} here") for i in range(1, 5)] + [("g", 1, "Quarterly header\nx")], "file string, page int, text string")
    clean = {(r.file, r.page): r.text for r in C.clean_pages(pages).collect()}
    assert clean[("f", 2)] == "body text number 2 here"
    assert clean[("g", 1)] == "quarterly header x"


@pytest.mark.parametrize("length", [79, 80, 500, 501, 920, 921, 3000])
def test_chunk_windows(spark, length):
    text = "".join(chr(0x4E00 + i % 5000) for i in range(length))
    clean = spark.createDataFrame([("f", 1, text, length)], "file string, page int, text string, char_count bigint")
    got = [(r.start, r.end) for r in C.chunk_pages(clean, CONFIG).orderBy("chunk").collect()]
    expected, start = [], 0
    while length >= 80:
        end = min(start + 500, length)
        expected.append((start, end))
        if end == length:
            break
        start = end - 80
    assert got == expected


def test_sketch_is_the_start_of_the_sorted_set(spark):
    text = "".join(chr(0x4E00 + i) for i in range(400))
    chunk = spark.createDataFrame([("f", 0, text)], "file string, chunk int, text string")
    whole = C.with_shingles(chunk, AnalysisConfig(shingle_size=3))
    full = whole.first().shingles
    assert full == sorted(set(full)) and len(full) == 398
    assert sorted(r.h for r in C.sketches(whole).collect()) == full[:220]


def test_jaccard_of_similar_strings(spark):
    a, b = (["".join(chr(0x4E00 + i) for i in range(22)) + tail for tail in ("甲乙", "丙丁")][k] for k in (0, 1))
    rows = spark.createDataFrame([("f", 0, a), ("g", 0, b)], "file string, chunk int, text string")
    x, y = (r.shingles for r in C.with_shingles(rows, AnalysisConfig(shingle_size=5)).orderBy("file").collect())
    assert one(spark, jaccard(F.array(*map(F.lit, x)), F.array(*map(F.lit, y)))) == pytest.approx(18 / 22)
    assert one(spark, jaccard(F.expr("cast(array() as array<bigint>)"), F.array(F.lit(1).cast("bigint")))) == 0.0


@pytest.mark.parametrize(("shared", "kept"), [(3, 0), (16, 1)])
def test_single_chunk_evidence(spark, shared, kept):
    pairs = spark.createDataFrame([("a", 0, "b", 0, shared, 1.0)], "lf string, lc int, rf string, rc int, shared bigint, weight double")
    assert R.candidate_evidence(pairs, CONFIG).count() == kept


def test_coverage_is_a_union(spark):
    rows = spark.createDataFrame([("a", "b", 1, 0, 100), ("a", "b", 1, 80, 160), ("a", "b", 2, 10, 30), ("a", "b", 2, 30, 30)], "lf string, rf string, page int, start bigint, end bigint")
    assert X.covered_chars(rows, ["lf", "rf"]).first().covered == 180


def test_exact_pages_of_repeated_texts(spark):
    clean = spark.createDataFrame([("a", 1, "t", 1), ("a", 2, "t", 1), ("a", 3, "t", 1), ("b", 4, "t", 1), ("b", 5, "t", 1), ("b", 6, "t", 1)], "file string, page int, text string, char_count bigint")
    candidates = spark.createDataFrame([("a", "b", 1.0)], "lf string, rf string, score double")
    met = sorted((r.left_page, r.right_page) for r in X.exact_pages(candidates, clean).collect())
    assert met == [(1, 4), (2, 6), (3, 5)]


def _image_rows(spark, rows):
    return spark.createDataFrame(rows, "file string, image bigint, page int, width int, height int, sha256 string, phash bigint")


def test_images_in_most_files(spark):
    small = _image_rows(spark, [(f"f{i}", 0, 1, 80, 80, "s", 0x1234) for i in range(4)])
    large = _image_rows(spark, [(f"f{i}", 0, 1, 400, 300, "s", 0x1234) for i in range(4)])
    assert I.common_images(small, 4).count() == 1 and I.image_candidates(small, 4, CONFIG).count() == 0
    assert I.common_images(large, 4).count() == 0 and I.image_candidates(large, 4, CONFIG).count() == 6


def test_equal_image_without_hash(spark):
    images = _image_rows(spark, [("a", 0, 2, 400, 300, "s", None), ("b", 0, 5, 400, 300, "s", None)])
    match = I.match_images(I.image_candidates(images, 2, CONFIG), images, 2, CONFIG).first()
    assert match.image_score == 1.0
    assert [(m.left_page, m.right_page, m.exact) for m in match.matched_images] == [(2, 5, True)]


def test_groups_by_id(spark):
    pairs = spark.createDataFrame([("p", "file-0", "file-1", 0.9, 0.9, 0.0), ("q", "file-1", "file-2", 0.9, 0.9, 0.0)], "pair_id string, lf string, rf string, final_score double, text_score double, image_score double")
    group = G.group_table(G.group_relations(pairs, CONFIG)).first()
    assert group.file_ids == ["file-0", "file-1", "file-2"] and group.edges == 2
    assert group.graph_density == pytest.approx(2 / 3)
    assert group.group_score == pytest.approx(0.55 * 0.9 + 0.45 * 2 / 3)


def test_long_chain_of_files(spark):
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(70)], "lf string, rf string")
    rows = G.components(edges).collect()
    assert len(rows) == 71 and {r.root for r in rows} == {"n000"}


def test_empty_corpus(spark):
    pages = spark.createDataFrame([], "file string, page int, text string")
    files = spark.createDataFrame([("a",), ("b",)], "file string")
    analysis = Analysis(pages, files, CONFIG)
    assert analysis.pairs.count() == 0
    assert analysis.run_totals().first().candidate_pairs == 0
    assert [r.chunk_count for r in analysis.summaries.collect()] == [0, 0]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_join_equals_join(spark, monkeypatch, how):
    monkeypatch.setattr(skew, "LEAST_ROWS", 5)
    many = spark.createDataFrame([("hot", i) for i in range(60)] + [("a", 1), ("a", 1), ("b", 2), (None, 3)], "k string, x int")
    one = spark.createDataFrame([("hot", "p"), ("hot", "q"), ("a", "r"), ("c", "s"), (None, "t")], "k string, y string")
    got, wanted = skew.split_join(many, one, ["k"], how), many.join(one, ["k"], how)
    assert got.columns == wanted.columns and sorted(map(repr, got.collect())) == sorted(map(repr, wanted.collect()))
    hot = skew.Pieces.of(many.groupBy("k").count(), "count")
    assert [(r.k, r._pieces) for r in hot.heavy.collect()] == [("hot", 12)]
    assert hot.scatter(many, ("k",)).where("k = 'hot'").select("_piece").distinct().count() > 6


def test_hub_of_files(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_ROWS", 10)
    edges = spark.createDataFrame([("hub", f"s{i:03}") for i in range(100)] + [("t1", "t2")], "lf string, rf string")
    got = {r.file: r.root for r in G.components(edges).collect()}
    assert got == {**{f"s{i:03}": "hub" for i in range(100)}, "hub": "hub", "t1": "t1", "t2": "t1"}


def test_tables_are_deleted(spark):
    with storage.scratch(spark):
        kept = storage.written(spark.range(3), "probe")
        storage.drop_written(kept)
        path = storage.written(spark.range(3), "probe")._simweave_path
        assert os.path.exists(path.removeprefix("file://")) and not os.path.exists(kept._simweave_path.removeprefix("file://"))
    assert not os.path.exists(path.removeprefix("file://"))

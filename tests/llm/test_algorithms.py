import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from simweave.llm import neardup, spans
from simweave.llm.components import connected_components
from simweave.llm.neardup import all_pairs, near_duplicates
from simweave.llm.spans import shared_spans
from simweave.llm.splitting import LEVELS, boundary_kind, split_oversized, split_spans
from simweave.llm.topn import LoserTree, merge_runs, top_n
from simweave.operators import skew


@pytest.mark.parametrize("name", ["p1_found", "p1_coverage", "p2_found", "p2_ranks", "p3_found", "p4_found", "p4_groups", "p5_found", "p5_shares", "p7_found", "p7_forms", "p9_whole", "p10_counts"])
def test_query_equals_sql(name, same_as_sql):
    from simweave.llm.queries import ORACLE_SQL, QUERIES

    same_as_sql(QUERIES[name], ORACLE_SQL[name])


# splitting


@pytest.mark.parametrize("seed", range(6))
def test_pieces_cover_and_overlap(seed):
    random.seed(seed)
    text = "".join(random.choice(["word ", "Sentence. ", "长句子。", "\n\n", "x" * 30, "\r\n", "é", "é"]) for _ in range(400))
    target, overlap = random.choice([(40, 0), (100, 30), (57, 56)])
    found = split_spans(text, target, overlap)
    assert found[0][0] == 0 and found[-1][1] == len(text)
    for (a, b), (c, d) in zip(found, found[1:], strict=False):
        assert 0 < b - a <= target and c == b - overlap and d > b
        # no coarser boundary would have been possible, with half of the room used if this one does so
        kind = boundary_kind(text, b)
        half = a + overlap + (target - overlap + 1) // 2
        for pattern in LEVELS[:kind]:
            assert not any((half if b >= half else a + overlap + 1) <= m.end() <= a + target for m in pattern.finditer(text))
        if b < half:
            assert not any(half <= m.end() <= a + target for pattern in LEVELS for m in pattern.finditer(text))


def test_pieces_have_new_text():
    # a section ends just past the overlap; the piece goes on to a lesser boundary
    text = "w" * 60 + " " + "x" * 22 + "\n\n\n" + "Some words follow here. " * 60
    found = split_spans(text, 500, 80)
    assert found[0][1] > 290 and all(d - b >= 210 for (_, b), (_, d) in zip(found, found[1:-1], strict=False))
    assert split_spans("a" * 45 + " " + "b" * 200, 100, 20)[0] == (0, 46)


def test_split_edges(spark):
    assert split_spans("", 10, 2) == [] and split_spans("abc", None, None) == [(0, 3)] and split_spans("abc", 0, 0) == [(0, 3)]
    assert split_spans("a" * 10, 4, None) == [(0, 4), (4, 8), (8, 10)] and split_spans("a" * 6, 4, 9) == [(0, 4), (1, 5), (2, 6)]
    rows = [(1, "aaa bbb ccc", 5, 0, "x"), (1, "aaa bbb ccc", 5, 0, "x"), (2, None, 5, 0, "y"), (3, "", 5, 0, None), (None, "abcdefgh", 5, 0, None), (5, "b" * 100_000, 1000, None, None)]
    df = spark.createDataFrame(rows, "id bigint, text string, t bigint, o bigint, _text string")
    out = split_oversized(df, ["id"], "text", "t", "o").collect()
    assert sum(r.id == 1 for r in out) == 2 * 3 and sum(r.id is None for r in out) == 2
    assert {r.id for r in out} == {1, None, 5} and sum(r.id == 5 for r in out) == 100
    assert split_oversized(df.limit(0), ["id"], "text", "t", "o").count() == 0
    with pytest.raises(ValueError):
        split_oversized(df.withColumnRenamed("id", "piece"), ["piece"], "text", "t", "o")


# top n


def test_loser_tree_sorts():
    random.seed(1)
    for k in range(6):
        runs = [sorted(random.randrange(20) for _ in range(random.randrange(6))) for _ in range(k)]
        at, tree, out = [0] * k, LoserTree([r[0] if r else None for r in runs]), []
        while tree.heads[tree.winner] is not None:
            w = tree.winner
            out.append(runs[w][at[w]])
            at[w] += 1
            tree.replace(runs[w][at[w]] if at[w] < len(runs[w]) else None)
        assert out == sorted(x for r in runs for x in r)


def test_merge_seeks_to_next_group():
    runs = [(["a"] * 5 + ["b"], [1, 3, 5, 7, 9, 1], [2] * 6), (["a", "c"], [2, 4], [2, 2])]
    assert [(runs[r][0][i], runs[r][1][i]) for r, i in merge_runs(runs)] == [("a", 1), ("a", 2), ("b", 1), ("c", 4)]


@pytest.mark.parametrize("fan_in", [2, 256])
def test_top_n_against_sorting(spark, fan_in):
    random.seed(2)
    rows = [(random.choice(["hot"] * 5 + ["g1", "g2", None]), random.choice([0.5, 0.25, 0.75, None, float("nan"), 0.1]), random.choice("abc"), f"id{i:03}", 3, "x") for i in range(300)]
    rows += rows[:5] + [("none", 0.5, "a", "z", None, "x"), ("zero", 0.5, "a", "z", 0, "x"), ("g1", 0.9, None, "z", 3, "x")]
    df = spark.createDataFrame(rows, "g string, s double, t string, i string, n int, _group string").repartition(7)
    got = sorted((r.g, r["rank"], r.i) for r in top_n(df, "g", "s", "t", "i", "n", fan_in=fan_in).collect())
    expected = []
    for g in {r[0] for r in rows if r[0]}:
        own = sorted((-r[1], r[2], r[3]) for r in rows if r[0] == g and r[1] is not None and r[1] == r[1] and r[2] is not None and (r[4] or 0) >= 1)
        expected += [(g, k, o[2]) for k, o in enumerate(own[:3], 1)]
    assert got == sorted(expected)
    assert top_n(df.limit(0), "g", "s", "t", "i", "n").count() == 0


def test_group_longer_than_a_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = spark.range(6_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 977).cast("double").alias("s"), F.lit("t").alias("t"), F.col("id").alias("i"), F.lit(700).alias("n"))
        rows = rows.where("g <> 1 OR id < 40").repartition(5, "i")
        got = {(r.g, r["rank"], r.i) for r in top_n(rows, "g", "s", "t", "i", "n", fan_in=2).collect()}
        local = sorted((str(r.g), -r.s, str(r.i)) for r in rows.collect())
        wanted = {(g, k, o[2]) for g in "012" for k, o in enumerate([o for o in local if o[0] == g][:700], 1)}
        assert got == wanted
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# components


def _union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in parent}


@pytest.mark.parametrize("kind", ["random", "chain", "star"])
def test_components_against_union_find(spark, kind):
    random.seed(3)
    edges = {
        "random": [(f"v{random.randrange(80)}", f"v{random.randrange(80)}") for _ in range(50)],
        "chain": [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)],
        "star": [("hub", f"s{i}") for i in range(200)],
    }[kind]
    edges += edges[:3] + [(edges[0][1], edges[0][0]), ("lonely", "lonely"), (None, "v1"), ("v1", None)]
    df = spark.createDataFrame([(*e, "x") for e in edges], "a string, b string, src string")
    got = {r.vertex: r.component for r in connected_components(df, "a", "b").collect()}
    assert got == _union_find(edges)


def test_hub_and_large_component(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_ROWS", 10)
    random.seed(9)
    edges = [("m-hub", f"s{i:03}") for i in range(150)] + [(f"s{i:03}", f"a{i:03}") for i in range(0, 150, 3)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert got == _union_find(edges)


def test_no_edges(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert connected_components(df, "a", "b").count() == 0


# near-duplicates


def _edited(text, edits):
    chars = list(text)
    for _ in range(edits):
        chars[random.randrange(len(chars))] = random.choice("abcdefgh ")
    return "".join(chars)


def _texts():
    random.seed(4)
    words = ["".join(random.choice("abcdefghij") for _ in range(random.randrange(2, 8))) for _ in range(60)]
    base = [" ".join(random.choice(words) for _ in range(n)) for n in (3, 8, 8, 20, 40, 40, 90, 300)]
    rows = [_edited(b, e) for b in base for e in (0, 0, 1, 2, 4, 8, 16)]
    return [(i, t, "x") for i, t in enumerate(rows)] + [(900, None, "x"), (901, "", "x"), (902, "abcd", "x"), (903, "abcd", "x"), (None, base[0], "x"), (0, rows[0], "x"), (904, "a" * 20_000, "x"), (905, "a" * 30_000, "x")]


def _brute(rows, threshold, gram=5):
    sets = {}
    for i, t, _ in rows:
        if i is not None and t and len(t) >= gram:
            sets[i] = neardup.grams_of(t, gram)
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) * 1000 >= threshold * 1000 * len(sets[a] | sets[b])}


@pytest.mark.parametrize(("threshold", "segments", "list_rows", "entry", "buckets"), [(0.72, 0.7, 20_000, 16, None), (0.72, 0.05, 20_000, 16, 5), (0.72, 0.7, 3, 0, 50), (0.9, 0.7, 20_000, 16, None), (0.72, 0.7, 20_000, 0.05, 300)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, threshold, segments, list_rows, entry, buckets):
    # few segments leave records with too few non-empty ones; with cheap entries neighbourhoods cost less for some
    monkeypatch.setattr(neardup, "SEGMENTS", segments)
    monkeypatch.setattr(neardup, "ENTRY", entry)
    monkeypatch.setattr(skew, "LEAST_ROWS", 4)
    rows = _texts()
    df = spark.createDataFrame(rows, "id bigint, text string, a string").repartition(3)
    found = all_pairs(*near_duplicates(df, "id", "text", threshold, list_rows=list_rows, buckets=buckets))
    assert {(r.a, r.b) for r in found.collect()} == _brute(rows, threshold)


def test_allotment_is_by_record(monkeypatch):
    import numpy as np

    random.seed(7)
    t = neardup.Threshold.of(0.72)
    texts = ["".join(random.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for n in [7, *[180] * 40]]
    cost = np.zeros(1 << neardup.COUNT_BITS, dtype=np.uint8)

    def kinds(own):
        sets = neardup.token_sets(own, 5)
        out = {}
        for band in neardup._bands(sets, t):
            e = neardup.allotted(sets, band, t, cost)
            for r in range(len(own)):
                out.setdefault(own[r], []).append((band, sorted(e.signature[e.record // neardup.GROUPS == r].tolist())))
        return out

    alone, together = kinds(texts[1:]), kinds(texts)
    # a short text beside them changes nothing for the others
    assert all([x for x in together[text] if x[1]] == [x for x in alone[text] if x[1]] for text in texts[1:])
    # a text whose segments are all frequent goes to neighbourhoods, the others stay
    sets = neardup.token_sets(texts[1:], 5)
    band = int(neardup.band_of(sets.sizes)[0])
    every = neardup.segment_signatures(sets, band, t)
    before = neardup.allotted(sets, band, t, cost)
    cost[neardup._slot(every.signature[every.record // neardup.GROUPS == 3])] = 120
    made = neardup.allotted(sets, band, t, cost)
    more = set(made.record[made.second].tolist()) - set(before.record[before.second].tolist())
    assert {r // neardup.GROUPS for r in more} == {3} and len(more) >= neardup.GROUPS - 2


def test_groups_of_negative_ids(spark):
    from simweave.llm.queries_near import id_components

    pairs = spark.createDataFrame([(-5, 3), (3, 20), (-(1 << 63), -7), (100, (1 << 63) - 1)], "a bigint, b bigint")
    got = {r["first"]: r.group for r in id_components(pairs).collect()}
    assert got == {-5: -5, 3: -5, 20: -5, -(1 << 63): -(1 << 63), -7: -(1 << 63), 100: 100, (1 << 63) - 1: 100}


@pytest.mark.parametrize(("threshold", "sizes"), [(0.4, (126, 300)), (0.2, (60, 290)), (0.72, (47, 65, 90))])
def test_near_duplicates_far_apart_in_size(spark, threshold, sizes):
    random.seed(6)
    whole = "".join(random.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400))
    rows = [(i, whole[: n + 4], "") for i, n in enumerate(sizes)]
    # each in a task of its own, so that none is indexed where only the other belongs
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "id bigint, text string, a string")
    wanted = _brute(rows, threshold)
    assert wanted and {(r.a, r.b) for r in all_pairs(*near_duplicates(df, "id", "text", threshold)).collect()} == wanted


def test_near_duplicates_of_nothing(spark):
    pairs, copies = near_duplicates(spark.createDataFrame([], "id bigint, text string"), "id", "text", 0.72)
    assert pairs.count() == 0 and copies.count() == 0


def test_deletions_alone_find_all(spark):
    random.seed(5)
    t = neardup.Threshold.of(0.72)
    texts = [_edited("the gate valves at the old quay are weighed by the night shift every week", e) for e in (0, 1, 2, 3, 4) for _ in range(6)]
    sets = neardup.token_sets(texts, 5)
    found = set()
    for band in neardup._bands(sets, t):
        e = neardup.deletion_signatures(sets, band, t)
        lists = {}
        for r, s, k in zip((e.record // neardup.GROUPS).tolist(), e.signature.tolist(), e.second.tolist(), strict=True):
            lists.setdefault(s, set()).add((r, k))
        for rows in lists.values():
            found |= {tuple(sorted((a, b))) for (a, x), (b, y) in combinations(rows, 2) if a != b and not (x and y)}
    assert _brute([(i, t, "") for i, t in enumerate(texts)], 0.72) <= found


# spans


def _span_brute(rows, length):
    texts = {(i, t) for i, t, _ in rows if i is not None and t and len(t) >= length}
    owners = {}
    for i, t in texts:
        for o in range(len(t) - length + 1):
            owners.setdefault(t[o : o + length], set()).add(i)
    out = set()
    for i in {i for i, _ in texts}:
        for _, t in [x for x in texts if x[0] == i]:
            hit = [False] * len(t)
            for o in range(len(t) - length + 1):
                if len(owners[t[o : o + length]]) > 1:
                    hit[o : o + length] = [True] * length
            at = 0
            while at < len(t):
                end = at
                while end < len(t) and hit[end]:
                    end += 1
                if end > at:
                    out.add((i, at, end))
                at = end + 1
    return out


@pytest.mark.parametrize("hot_rows", [200_000, 2])
def test_spans_against_brute_force(spark, hot_rows):
    random.seed(6)
    pool = ["".join(random.choice("abcxyz 深") for _ in range(40)) for _ in range(8)]
    rows = [(i, "".join(random.choice(pool)[: random.choice([40, 25])] + random.choice("!?") for _ in range(random.randrange(1, 8))), "x") for i in range(40)]
    rows += [(100, "q" * 200, "x"), (101, "q" * 150, "x"), (102, "z" * 300, "x"), (103, None, "x"), (104, "", "x"), (None, rows[0][1], "x"), rows[1], (105, rows[2][1], "x")]
    df = spark.createDataFrame(rows, "id bigint, text string, grp string").repartition(3)
    got = {tuple(r) for r in shared_spans(df, "id", "text", length=50, anchor=20, hot_rows=hot_rows).collect()}
    assert got == _span_brute(rows, 50)


@pytest.mark.parametrize("parts", [1, 4])
@pytest.mark.parametrize("hot_rows", [200_000, 1])
def test_ids_with_several_texts(spark, parts, hot_rows):
    random.seed(8)
    a, b, c, d = ("".join(random.choice("abcdefghij ") for _ in range(n)) for n in (130, 300, 260, 280))
    # id 2 has only the short text; 4 shares with itself alone; 6 with 5, and 5 twice
    rows = [(1, a, ""), (1, b, ""), (2, a, ""), (3, b, ""), (4, c, ""), (4, c + d, ""), (5, d + "x", ""), (5, "y" + d, ""), (6, d, "")]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "id bigint, text string, grp string")
    got = {tuple(r) for r in shared_spans(df, "id", "text", hot_rows=hot_rows).collect()}
    assert got == _span_brute(rows, 120) and {r[1:] for r in got if r[0] == 2} == {(0, 130)}


def test_copies_under_many_ids(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_ROWS", 10)
    rows = [(i, "the same line again and again " * 9) for i in range(60)] + [(100, "x" * 30 + "the same line again and again " * 5)]
    df = spark.createDataFrame(rows, "id bigint, text string").repartition(3)
    got = {tuple(r) for r in shared_spans(df, "id", "text", hot_rows=5).collect()}
    assert got == {(i, 0, 270) for i in range(60)} | {(100, 30, 180)}


def test_equal_hashes_are_checked(monkeypatch):
    import numpy as np

    monkeypatch.setattr(spans, "rolling", lambda codes, width, base=0: np.zeros(max(0, len(codes) - width + 1), dtype=np.uint64))
    row, offset = spans.shared_windows(np.array([1, 2, 3]), ["abcdef", "xbcdez", "qqqqqq"], 4)
    assert list(zip(row.tolist(), offset.tolist(), strict=True)) == [(0, 1), (1, 1)]


def test_spans_of_nothing(spark):
    assert shared_spans(spark.createDataFrame([], "id bigint, text string"), "id", "text").count() == 0
    assert F is not None

"""Near duplicates, lines and contamination against brute force, with awkward rows."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, decontam, line_dedup, minhash

WORDS = [f"w{i}" for i in range(400)]


def sets(rows, k):
    out = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        out.append(frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]))
    return out


def brute_components(rows, k, pct=80):
    s = sets(rows, k)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= pct * (len(s[i]) + len(s[j]) - both):
                parent[root(i)] = root(j)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None and (least[r] is None or d < least[r]):
            least[r] = d
    return [(d, len(s[i]), d if not s[i] else least[root(i)]) for i, (d, _) in enumerate(rows)]


def corpus():
    base = " ".join(WORDS[:120])
    rows = [(10, base), (11, base.upper()), (12, base + " extra words here"), (13, " ".join(WORDS[3:123])), (14, " ".join(WORDS[200:300]))]
    # a chain: neighbours are alike, the ends are not
    rows += [(20 + i, " ".join(WORDS[130 + 5 * i : 230 + 5 * i])) for i in range(8)]
    rows += [(40, ""), (41, None), (42, "   \n\t "), (43, "two words"), (44, "Two  words"), (45, "one"), (None, base), (None, "alone with no id at all"), (14, " ".join(WORDS[200:300])), (46, "x" * 50_000), (47, "É é É é É"), (48, "é É é É é")]
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_components_match_brute_force(spark, k):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit(1), "label": F.lit("x"), "band": F.lit(2)})
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, shingle=k).collect()]
    assert sorted(got, key=repr) == sorted(brute_components(rows, k), key=repr)


def test_blocks_find_links_that_the_pivot_misses(spark):
    # shifted windows: each is alike only to its near neighbours, and many share buckets
    rows = [(i, " ".join(WORDS[2 * i : 2 * i + 60])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(df, shingle=3, block=4).collect())
    assert got == sorted((d, c) for d, _, c in brute_components(rows, 3))


def test_one_row_of_each_group_stays(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in minhash.drop_near_duplicates(df, 5).collect()]
    want = {c for d, n, c in brute_components(rows, 5) if n and c is not None}
    assert sorted(d for d, t in kept if d is not None and t and t.strip()) == sorted(want)
    assert {40, 41, 42} <= {d for d, _ in kept} and (None, "alone with no id at all") in kept


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(df).count() == 0 and minhash.drop_near_duplicates(df).count() == 0
    assert line_dedup.apply_bitmaps(df, line_dedup.line_bitmaps(df)).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_contamination(df, bench).count() == 0


def test_bayes_thresholds_keep_what_is_alike():
    least = minhash.least_matches(240, 0.8, 1e-9)
    assert all(a < b for a, b in zip(least, least[1:], strict=False)) and least[-1] < 0.8 * 240
    assert minhash.least_matches(32, 0.8, 1e-9)[0] > 0


def test_signatures_estimate_similarity():
    signer = minhash.Signer(40, 6)
    a = minhash.shingle_set(" ".join(WORDS[:300]).encode(), 4)
    b = minhash.shingle_set(" ".join(WORDS[50:350]).encode(), 4)
    true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    assert abs((signer.sign(a) == signer.sign(b)).mean() - true) < 0.12


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r["node"]: r["label"] for r in components.components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), 101: 100}


def test_lines_match_brute_force(spark):
    rows = [(i, f"Head\nunique {i}\n COMMON line \n\nfoot" + ("\nfoot" * (i % 3))) for i in range(12)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "common LINE\v"), (None, "Head"), (7, rows[7][1]), (104, "a\r\nfoot"), (105, "y" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"th": F.lit(1), "pos": F.lit(2)})
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\v\f\r"))
    docs = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            docs[key(x)].add((d, t))
    gone = {x for x, s in docs.items() if x and len(s) >= 10}
    want = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        want.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = [tuple(r) for r in line_dedup.apply_bitmaps(df, line_dedup.line_bitmaps(df, 10)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_first_occurrence_stays(spark):
    df = spark.createDataFrame([(2, "a\nb\na"), (1, "b\nc"), (3, "b")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.apply_bitmaps(df, line_dedup.line_bitmaps(df, 2, keep="first")).collect()}
    assert got == {1: "b\nc", 2: "a\na", 3: ""}


def brute_hits(text, items, width):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for i, t in items:
        v = words(t)
        n = min(width, len(v))
        for a in range(len(v) - n + 1 if n else 0):
            for b in range(len(w) - n + 1):
                if w[b : b + n] == v[a : a + n]:
                    hit.update(range(b, b + n))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


def test_contamination_matches_brute_force(spark):
    items = [(1, " ".join(WORDS[:14])), (2, "short Item"), (3, ""), (4, None), (5, " ".join(WORDS[2:9] * 3)), (5, " ".join(WORDS[2:9] * 3)), (None, "w1 w2"), (6, "é ü"), (10, "short item")]
    docs = [(1, "pre " + " ".join(WORDS[1:13]) + " post"), (2, "a SHORT item; short-item"), (3, None), (4, ""), (5, " ".join(WORDS[:9])), (6, " ".join(WORDS[2:9] * 4)), (7, "É Ü é ü"), (None, "short item"), (2, "clean"), (8, "z " * 20_000 + " ".join(WORDS[:14]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit(1), "w": F.lit(2)})
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = [(d, *brute_hits(t, [x for x in items if x[0] is not None], 10)) for d, t in docs]
    for block in (2_000_000, 3):
        got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontam.find_contamination(df, bench, block_words=block).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    spans = decontam.find_contamination(df.filter("doc_id = 1"), bench).first()["hit_spans"]
    assert [(s["first"], s["last"]) for s in spans] == [(1, 13)]
    assert {r["doc_id"] for r in decontam.drop_contaminated(df, bench).collect()} == {2, 3, 4, 5}


def test_one_block_of_the_benchmark_is_out_at_a_time(spark, monkeypatch):
    sent, alive = [], []
    context, real = spark.sparkContext, spark.sparkContext.broadcast

    def broadcast(value):
        b = real(value)
        if isinstance(value, decontam.Windows):
            sent.append(b)
            alive.append(sum(x._jbroadcast.isValid() for x in sent))
        return b

    monkeypatch.setattr(context, "broadcast", broadcast)
    items = spark.createDataFrame([(i, " ".join(WORDS[8 * i : 8 * i + 12])) for i in range(5)], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(WORDS[:60])), (2, "clean"), (3, " ".join(WORDS[16:28])), (3, " ".join(WORDS[16:28])), (None, None)], "doc_id long, text string")
    got = sorted((repr(r["doc_id"]), r["n_hit"], r["items"], [tuple(s) for s in r["hit_spans"]]) for r in decontam.find_contamination(docs, items, block_words=3).collect())
    assert got == [("1", 44, list("01234"), [(0, 44)]), ("2", 0, [], []), ("3", 12, ["2"], [(0, 12)]), ("3", 12, ["2"], [(0, 12)]), ("None", 0, [], [])]
    assert len(alive) > 2 and max(alive) == 1

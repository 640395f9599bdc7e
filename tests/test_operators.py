import datetime as dt
import math
import random
import re
from collections import defaultdict, deque
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notefathom.operators import graph, incremental, links, meta, names, notes, rewrite, search

T0 = dt.datetime(2024, 1, 1)


def vault(spark, texts, fm=None):
    rows = [(i, k, re.sub(r"\.md$", "", k).rsplit("/", 1)[-1], v, (fm or {}).get(k, "{}"), T0, T0, None) for i, (k, v) in enumerate(texts.items())]
    return spark.createDataFrame(rows, "row_id long, id string, title string, content string, frontmatter string, mtime timestamp_ntz, loaded_at timestamp_ntz, removed_at timestamp_ntz")


def edges(spark, pairs):
    return spark.createDataFrame([(i, a, b, f"c{i}") for i, (a, b) in enumerate(pairs)], "id long, source_id string, target_id string, context string")


# ---- notes and metadata ----


def test_current(spark):
    rows = [(1, "a", "{}", T0, None), (2, "a", "{}", T0, T0), (3, "b", None, T0, None), (4, "b", '{"_stub":true}', T0 + dt.timedelta(1), None), (5, "c", "{bad _stub", T0, None), (6, "d", '{ "_stub" : false}', T0, None)]
    df = spark.createDataFrame(rows, "row_id long, id string, frontmatter string, loaded_at timestamp_ntz, removed_at timestamp_ntz").selectExpr("*", "1 as x")
    assert sorted(r.id for r in notes.current(df).collect()) == ["c", "d"]
    assert sorted(r.id for r in notes.current(df, stubs=True).collect()) == ["b", "c", "d"]


def test_tags_and_properties(spark):
    fm = {"a.md": '{"tags": ["Area/Work", "x, y", null, 5], "tag": "#area", "status": 5}', "b.md": '{"tags": "area/work z", "status": ["5", 5, 5, null]}', "c.md": "{bad"}
    n = vault(spark, dict.fromkeys(fm, ""), fm)
    got = {r.tag: r["count"] for r in meta.count_tags(n).collect()}
    assert got == {"Area": 2, "Area/Work": 2, "x": 1, "y": 1, "5": 1, "z": 1}
    assert {r.tag for r in meta.count_tags(n, parents=False, prefix="#Area").collect()} == {"Area/Work"}
    assert {r.value: r["count"] for r in meta.property_values(n, "status").collect()} == {"5": 3, '"5"': 1}
    whole = n.where("id = 'a.md'").select(meta.record_tags("frontmatter").alias("t")).first().t
    assert whole == ["Area/Work", "x, y", "5", "area"]


def test_attachments(spark):
    a = spark.createDataFrame([("img/a.png",), ("N/img/a.png",), ("b.pdf",)], "path string")
    l = spark.createDataFrame([("N/x.md", "a.png"), ("N/x.md", "img/a.png"), ("M/y.md", "b.pdf"), ("M/z.md", "b.pdf"), ("M/z.md", "none.png")], "source_id string, target string")
    got = {r.path: r.references for r in meta.attachment_references(a, l).collect()}
    assert got["b.pdf"] == 2 and got["img/a.png"] == 1


# ---- search ----


def test_bm25_by_hand(spark):
    n = vault(spark, {"a.md": "cat dog cat", "b.md": "dog", "cat.md": "bird bird"})
    got = {r.id: r.score for r in search.bm25(n, "CAT").collect()}
    docs = {"a.md": (0, 2, 4), "cat.md": (1, 0, 3)}
    idf, mean = max(math.log((3 - 2 + 0.5) / 2.5), 1e-6), (4 + 2 + 3) / 3
    for k, (t, b, n_) in docs.items():
        f = 5 * t + b
        assert got[k] == pytest.approx(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n_ / mean)))
    assert set(got) == set(docs) and search.bm25(n, "cat zebra").count() == 0 and search.bm25(n, " ! ").count() == 0
    assert search.bm25(n.limit(0), "cat").count() == 0
    assert {(r.term, r.id): (r.tf_title, r.tf_body) for r in search.inverted_index(n).where("term = 'cat'").collect()} == {("cat", "a.md"): (0, 2), ("cat", "cat.md"): (1, 0)}


@pytest.mark.parametrize("blocks", [None, (3, 17)])
def test_knn_batch_equals_brute_force(spark, blocks, monkeypatch):
    if blocks:
        monkeypatch.setattr(search, "QUERY_BLOCK", blocks[0])
        monkeypatch.setattr(search, "VECTOR_BLOCK", blocks[1])
    rng = random.Random(4)
    vecs = [(i, [rng.choice([0.0, 1.0, 2.0]) for _ in range(4)]) for i in range(80)] + [(99, None), (98, [1.0]), (97, [])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for r in search.knn_batch(df, df.where("vec_id % 10 = 0"), 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for q in range(0, 80, 10):
        want = sorted((i for i, v in vecs[:80] if i != q), key=lambda i: (round(math.dist(vecs[i][1], vecs[q][1]), 9), i))[:5]
        assert got[q] == want
    assert search.knn_batch(df, df.limit(0), 5).count() == 0 and search.knn_batch(df.limit(0), df.limit(9), 5).count() == 0


def test_stored_index_equals_the_scan(spark, tmp_path):
    rng = random.Random(8)
    texts = {f"n{i}.md": " ".join(rng.choice(["cat", "dog", "bird", "the", "eel"]) for _ in range(rng.randrange(30))) for i in range(60)} | {"e.md": "", "x.md": None}
    n = vault(spark, texts)
    index = search.TextIndex.build(n, str(tmp_path / "ix"), buckets=4)
    for query in ("cat", "Cat dog", "the eel bird", "zebra", "cat zebra", "!", "n1"):
        want = {r.id: pytest.approx(r.score) for r in search.bm25(n, query).collect()}
        assert {r.id: r.score for r in index.search(query, spark).collect()} == want, query
    plan = spark.read.parquet(index.path).where("bucket = 1 and term = 'cat'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,cat)" in plan
    assert search.TextIndex.build(n.limit(0), str(tmp_path / "no")).search("cat", spark).count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([("x", 0.9), ("y", 0.8)], "id string, score double")
    b = spark.createDataFrame([("y", 7.0), ("z", 6.0)], "id string, score double")
    got = [(r.id, r.score) for r in search.fuse([a, b], "id", 3).collect()]
    assert [i for i, _ in got] == ["y", "x", "z"] and got[0][1] == pytest.approx(1 / 62 + 1 / 61)


def test_grep_and_patterns(spark):
    n = vault(spark, {"a.md": "one\r\nTwo kettle\nthree\nkettle kettle", "b.md": None, "c.md": ""})
    got = [tuple(r) for r in search.grep(n, "KETTLE", context=2).orderBy("line").collect()]
    assert got == [("a.md", 2, "Two kettle", "one", "three\nkettle kettle"), ("a.md", 4, "kettle kettle", "Two kettle\nthree", "")]
    assert search.grep(n, "t(?:w|h)", regex=True, case_sensitive=True, per_file=1).count() == 1
    for bad in ("(a+)+", "x" * 501, "("):
        with pytest.raises(ValueError):
            search.safe_pattern(bad)
    assert search.escape_query('a "b') == '"a ""b"' and search.simplified("how is the kettle of x") == "kettle x" and search.simplified("kettle") is None


# ---- names ----


def score(name, q):
    q, c = q.lower().strip(), name.lower()
    at = c.find(q)
    if c == q:
        return 1.0
    if c.startswith(q):
        return 0.9
    if at > 0:
        return 0.85 if not c[at - 1].isalnum() else 0.8
    w = q.split()
    if len(w) > 1 and all(x in c for x in w):
        return 0.7
    k, first, last, flat = 0, 0, 0, q.replace(" ", "")
    for i, ch in enumerate(c):
        if k < len(flat) and ch == flat[k]:
            first, last, k = (i if k == 0 else first), i, k + 1
    if k == len(flat):
        return round(0.4 + 0.2 * len(flat) / (last - first + 1), 3)
    s = 1 - rewrite.levenshtein(c, q) / max(len(c), len(q), 1)
    return round(s * 0.6, 3) if s >= 0.6 else 0.0


def test_score_name(spark):
    cands = ["Kettle", "kettle of tea", "my kettle", "mykettles", "tea for the kettle", "k-e-t-t-l-e", "ketle", "", "none", "Kettel tea"]
    for q in ("kettle", "kettle tea"):
        rows = spark.createDataFrame([(c,) for c in cands], "c string").select("c", names.score_name(F.col("c"), q).alias("s")).collect()
        assert {r.c: r.s for r in rows} == {c: score(c, q) for c in cands}


def test_resolve(spark):
    n = vault(spark, dict.fromkeys(["A/Kettle.md", "B/kettle.md", "C/Big Kettle.md", "D/x.md"], ""), {"D/x.md": '{"aliases": ["Samovar"], "alias": "old, older"}'})
    assert names.resolve_single(n, "A/Kettle") == "A/Kettle.md" and names.resolve_single(n, "Kettle") == "A/Kettle.md" and names.resolve_single(n, "samovar") == "D/x.md"
    with pytest.raises(LookupError, match="ambiguous"):
        names.resolve_single(n, "KETTLE")
    with pytest.raises(LookupError, match="no note"):
        names.resolve_single(n, "zzz")
    got = names.find_by_name(n, "older").collect()
    assert [(r.id, r.score, r.matched_on, r.alias) for r in got] == [("D/x.md", 1.0, "alias", "older")]


def test_fuzzy_lines(spark):
    n = vault(spark, {"a.md": "nothing\nthe brigth kettle here\nBRIGHT KETTLE, bright kettle", "b.md": None, "c.md": "x\nthe brigth   kettle here\nbright", "d.md": "bright.kettle\n"})
    got = sorted((r.id, r.line, r.text, r.score) for r in names.fuzzy_find(n, "bright kettle").collect())
    like = round(1 - 2 / 13, 6)
    # a note with exact hits gives these only; short stretches count too
    assert got == [("a.md", 3, "BRIGHT KETTLE", 1.0), ("a.md", 3, "bright kettle", 1.0), ("c.md", 2, "brigth kettle", like), ("d.md", 1, "bright.kettle", round(1 - 1 / 13, 6))]
    assert names.fuzzy_find(n, "").count() == 0
    two = names.fuzzy_find(n, "here\nBRIGHT").collect()
    assert {(r.id, r.line, r.text) for r in two} == {("a.md", 2, "here\nBRIGHT"), ("c.md", 2, "here\nbright")}


def test_score_name(spark):
    want = [("Kelly criterion", "kelly criterion", 1.0), ("Kelly criterion", "kel", 0.9), ("a/Kelly", "kelly", 0.85), ("a+Kelly", "kelly", 0.8), ("of the kettle", "kettle of", 0.7), ("", "a", 0.0), ("x", "  ", 0.0)]
    # blanks count in the length of the query, and likeness can beat a loose stretch
    want += [("kXXetXXtlXe", "ket tle", round(0.4 + 0.2 * 7 / 11, 3)), ("kubernetes", "kubernets", round(0.4 + 0.2 * 9 / 10, 3)), ("abcdefgh", "abcdefhg", round(0.75 * 0.6, 3))]
    for name, query, score in want:
        assert spark.range(1).select(names.score_name(F.lit(name), query)).first()[0] == pytest.approx(score), (name, query)


def test_link_paths(spark):
    n = vault(spark, dict.fromkeys(["a/B.md", "c/B.md", "c/X.md", "B c.md"], ""))
    asked = [("c/X.md", "B", "c/B.md"), ("q.md", "B", "a/B.md"), ("q.md", "x/B.md", None), ("q.md", "c/B.md", "c/B.md"), ("q.md", "zz/B", "a/B.md"), ("c/X.md", "a/B.md.md", None), ("q.md", "no", None)]
    got = {(r.source_id, r.raw): r.path for r in names.link_paths(spark.createDataFrame([a[:2] for a in asked], "source_id string, raw string"), n).collect()}
    assert got == {(s, r): p for s, r, p in asked}


def test_broken_links_of_every_kind(spark):
    text = "[[B#H#^b1]] [[B#H#^no]] [[B#^B1]]\n[[B#H#S]] [[B#H#Z]] [[Z]] [[Z]] [[#S]] [[f.pdf]] [[q.pdf]] `[[Z]]` ![[Z]] [[x/B.md]]"
    n = vault(spark, {"A.md": text, "B.md": "# H\n## S\nblock ^b1"})
    got = sorted((r.line, r.link, r.reason) for r in links.broken_links(n, attachments=spark.createDataFrame([("in/f.pdf",)], "path string")).collect())
    assert got == sorted([
        (1, "[[B#H#^no]]", "block_not_found"), (1, "[[B#^B1]]", "block_not_found"), (2, "[[B#H#Z]]", "heading_not_found"), (2, "[[Z]]", "note_not_found"), (2, "[[Z]]", "note_not_found"),
        (2, "[[#S]]", "heading_not_found"), (2, "[[q.pdf]]", "note_not_found"), (2, "[[x/B.md]]", "note_not_found"),
    ])


def test_list_vaults_counts_ids(spark):
    from notefathom.sources.vault import list_vaults

    rows = [(1, "v", "a", 1, None), (2, "v", "a", 2, None), (3, "v", "b", 1, None), (4, "v", "b", 2, 3), (5, "w", "c", 1, None)]
    n = spark.createDataFrame(rows, "row_id long, vault_id string, id string, loaded_at int, removed_at int")
    v = spark.createDataFrame([("v", "V", "/v"), ("w", "W", "/w"), ("z", "Z", "/z")], "vault_id string, title string, root string")
    assert {r.vault_id: r.notes for r in list_vaults(v, notes.current(n, stubs=True)).collect()} == {"v": 1, "w": 1, "z": 0}


def test_the_current_view_reads_and_moves_only_what_is_used(spark):
    from notefathom.plans.registry import QUERIES

    used = {"g12_orphans": "title", "j8_live_edges": "", "j16_to_index": "mtime", "a3_folder_overview": "", "f4_list_notes": "title"}
    for name, own in used.items():
        df = QUERIES[name](spark, "/root/testdata/sf0.01")
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        reads = re.findall(r"FileScan parquet \[([^\]]*)\][^\n]*nodes.parquet", plan)
        assert len(reads) == 1, name
        assert {re.sub(r"#.*", "", c) for c in reads[0].split(",")} <= {"row_id", "id", "frontmatter", "loaded_at", "removed_at", "mtime", own}, name
        assert "content#" not in plan and (name == "f4_list_notes" or not re.search(r"partial_max_by\(frontmatter", plan)), name


# ---- graph ----


def undirected(pairs):
    adj = defaultdict(set)
    for a, b in pairs:
        if a != b:
            adj[a].add(b)
            adj[b].add(a)
    return adj


def brandes(ids, pairs):
    adj, score_ = undirected(pairs), dict.fromkeys(ids, 0.0)
    for s in ids:
        dist, sigma, order, q = {s: 0}, defaultdict(float, {s: 1.0}), [], deque([s])
        while q:
            v = q.popleft()
            order.append(v)
            for w in adj[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    q.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
        delta = defaultdict(float)
        for w in reversed(order):
            for v in adj[w]:
                if dist.get(v) == dist[w] - 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                score_[w] += delta[w]
    n = len(ids)
    return {k: v / ((n - 1) * (n - 2)) for k, v in score_.items()}


def random_graph(spark, seed=5):
    rng = random.Random(seed)
    ids = [f"n{i:02}" for i in range(24)]
    pairs = [(rng.choice(ids[:20]), rng.choice(ids[:20])) for _ in range(40)] + [("n00", "n01"), ("n01", "n00"), ("n02", "n02"), ("n03", "gone")]
    return ids, [p for p in pairs if "gone" not in p], vault(spark, dict.fromkeys(ids, "")), edges(spark, pairs)


@pytest.mark.parametrize("held", [True, False])
def test_betweenness(spark, held, monkeypatch):
    ids, pairs, n, e = random_graph(spark)
    if not held:
        monkeypatch.setattr(graph, "HELD_EDGES", 0)
    und = graph.undirected(graph.build(n, e))
    got = {r.id: r.score for r in graph.betweenness(n, und, rows=200).collect()}
    want = brandes(ids, pairs)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_betweenness_walks_many_sources_at_once(spark, monkeypatch):
    # a hub, twins by the dozen with over 2^24 shortest paths between the ends, a chain, and a part that nothing else reaches
    pairs = [("hub", f"s{i:03}") for i in range(100)] + [(f"s{i:03}", f"s{i * 7 % 100:03}") for i in range(2, 60)] + [("x1", "x2"), ("x2", "x3")]
    pairs += [(f"t{i:02}{a}", f"t{i + 1:02}{b}") for i in range(27) for a in "ab" for b in "ab"] + [("s005", "t00a"), *((f"c{i}", f"c{i + 1}") for i in range(9)), ("c0", "s050")]
    pairs = sorted({(min(p), max(p)) for p in pairs if p[0] != p[1]})
    ids = sorted({v for p in pairs for v in p})
    n, e = vault(spark, dict.fromkeys([*ids, "alone"], "")), edges(spark, pairs)
    got = {r.id: r.score for r in graph.betweenness(n, graph.undirected(graph.build(n, e))).collect()}
    want = brandes([*ids, "alone"], pairs)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12) for k in want)

    number = {v: i for i, v in enumerate(ids)}
    x, y = (np.array([number[p[k]] for p in pairs] + [number[p[1 - k]] for p in pairs]) for k in (0, 1))
    held = graph._held(x, y, np.arange(len(ids)), len(ids))
    walked, sums, blocks = [], graph._sums, -(-len(ids) // graph.block_width(len(ids)))
    monkeypatch.setattr(graph, "_sums", lambda start, ends, values, rows, out: walked.append(int((start[rows + 1] - start[rows]).sum())) or sums(start, ends, values, rows, out))
    list(graph._brandes(SimpleNamespace(value=held), len(ids))([pa.RecordBatch.from_arrays([pa.array(range(blocks))], ["id"])]))
    assert 0 < sum(walked) < 2 * len(pairs) * len(ids)  # each source alone would walk all links there and most of them back


def long_graph():
    """A chain that is longer than a block is wide, a hub with a ring, a ladder with over 2^24 shortest paths, a part that nothing else reaches."""
    pairs = [(f"c{i:03}", f"c{i + 1:03}") for i in range(160)] + [("hub", f"r{i:02}") for i in range(80)] + [(f"r{i:02}", f"r{(i * 7 + 1) % 80:02}") for i in range(80)] + [("c000", "r05"), ("x1", "x2"), ("x2", "x3")]
    pairs += [(f"t{i:02}{a}", f"t{i + 1:02}{b}") for i in range(27) for a in "ab" for b in "ab"] + [("r50", "t00a")]
    pairs = sorted({(min(p), max(p)) for p in pairs if p[0] != p[1]})
    return sorted({v for p in pairs for v in p}), pairs


def test_betweenness_takes_a_link_once_for_64_sources(spark, monkeypatch):
    ids, pairs = long_graph()
    n, e = vault(spark, dict.fromkeys([*ids, "alone"], "")), edges(spark, pairs)
    monkeypatch.setattr(graph, "_brandes", None)  # all is walked in Java
    got = {r.id: r.score for r in graph.betweenness(n, graph.undirected(graph.build(n, e))).collect()}
    want = brandes([*ids, "alone"], pairs)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12) for k in want)


def test_betweenness_without_the_compiler(spark, monkeypatch):
    ids, pairs = long_graph()
    n, e = vault(spark, dict.fromkeys(ids, "")), edges(spark, pairs)
    monkeypatch.setattr(graph, "java_class", lambda *a: None)
    got = {r.id: r.score for r in graph.betweenness(n, graph.undirected(graph.build(n, e))).collect()}
    assert got == {k: pytest.approx(v, rel=1e-9, abs=1e-12) for k, v in brandes(ids, pairs).items()}


def test_sources_of_a_block_are_alike():
    x = np.concatenate([[0] * 100, np.arange(1, 101), [101] * 100, np.arange(102, 202), [0], [101]])  # two stars, their centres linked
    y = np.concatenate([np.arange(1, 101), [0] * 100, np.arange(102, 202), [101] * 100, [101], [0]])
    start, ends, sources, names = graph._held(x, y, np.random.default_rng(1).permutation(202), 202)
    got = graph._alike(start, ends, np.random.default_rng(2).permutation(sources), block=20)
    assert sorted(got) == list(range(202))
    assert sum(len({int(names[v]) > 100 for v in got[k : k + 20]}) > 1 for k in range(0, 202, 20)) <= 2


def test_betweenness_from_pivots(spark):
    ids, pairs, n, e = random_graph(spark, 11)
    und, want = graph.undirected(graph.build(n, e)), brandes(ids, pairs)
    every = {r.id: r.score for r in graph.betweenness(n, und, pivots=1000).collect()}
    assert all(every[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    some = {r.id: r.score for r in graph.betweenness(n, und, pivots=14).collect()}
    assert sum(abs(some[k] - want[k]) for k in want) < 0.5 * sum(want.values()) and max(some, key=some.get) in sorted(want, key=want.get)[-4:]


def test_rank_notes_of_both_kinds(spark):
    _, _, n, e = random_graph(spark)
    both = graph.rank_notes(n, e, limit=5).collect()
    assert [r.metric for r in both].count("influence") == [r.metric for r in both].count("bridging") == 5
    assert [tuple(r) for r in both[:5]] == [tuple(r) for r in graph.rank_notes(n, e, "influence", 5).collect()]
    with pytest.raises(ValueError):
        graph.rank_notes(n, e, "fame")


def test_rank_notes_from_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "block_width", lambda n: 3)
    ids, pairs, n, e = random_graph(spark, 23)
    seen = spark.sparkContext.accumulator(0)
    asked = F.udf(lambda s: seen.add(1) or s, "string").asNondeterministic()
    got = graph.rank_notes(n.withColumn("title", asked("title")), e, limit=6).collect()
    want = brandes(ids, pairs)
    best = sorted(ids, key=lambda k: (-round(want[k] / (len(ids) * (len(ids) - 1) / 2), 12), k))[:6]
    assert [r.id for r in got if r.metric == "bridging"] == best and seen.value == len(ids)  # the notes are worked out once


def test_rank_notes_of_a_long_graph(spark, monkeypatch):
    monkeypatch.setattr(graph, "_brandes", None)  # all is walked in Java
    ids, pairs = long_graph()
    got = graph.rank_notes(vault(spark, dict.fromkeys(ids, "")), edges(spark, pairs), "bridging", limit=7).collect()
    want = {k: v / (len(ids) * (len(ids) - 1) / 2) for k, v in brandes(ids, pairs).items()}
    best = sorted(ids, key=lambda k: (-round(want[k], 12), k))[:7]
    assert [(r.id, r.score) for r in got] == [(k, pytest.approx(want[k], rel=1e-9)) for k in best]


def test_bridging_of_a_path(spark):
    n, e = vault(spark, dict.fromkeys("abc", "")), edges(spark, [("a", "b"), ("b", "c")])
    got = {r.id: r.score for r in graph.bridging(graph.betweenness(n, graph.undirected(graph.build(n, e))), 3).collect()}
    assert got == {"a": 0.0, "b": pytest.approx(1 / 3), "c": 0.0}


def test_bridging_from_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "block_width", lambda n: 3)
    ids, pairs, n, e = random_graph(spark, 17)
    got = {r.id: r.score for r in graph.bridging(graph.betweenness(n, graph.undirected(graph.build(n, e))), len(ids)).collect()}
    want = brandes(ids, pairs)
    assert got == {k: pytest.approx(v / (len(ids) * (len(ids) - 1) / 2), abs=1e-15) for k, v in want.items()}


def test_bridging_of_a_long_graph(spark, monkeypatch):
    monkeypatch.setattr(graph, "_brandes", None)  # all is walked in Java
    ids, pairs = long_graph()
    n, e = vault(spark, dict.fromkeys(ids, "")), edges(spark, pairs)
    got = {r.id: r.score for r in graph.bridging(graph.betweenness(n, graph.undirected(graph.build(n, e))), len(ids)).collect()}
    assert got == {k: pytest.approx(v / (len(ids) * (len(ids) - 1) / 2), rel=1e-9, abs=1e-15) for k, v in brandes(ids, pairs).items()}


def test_pagerank(spark):
    star = [("hub", f"s{i}") for i in range(5)]
    n = vault(spark, dict.fromkeys(["hub", "alone", *(f"s{i}" for i in range(5))], ""))
    got = {r.id: r.score for r in graph.pagerank(n, graph.undirected(graph.build(n, edges(spark, star))), tolerance=1e-10).collect()}
    hub = (0.15 / 6 + 0.85 * 5 * 0.15 / 6) / (1 - 0.85**2)
    assert got["alone"] == 0 and got["hub"] == pytest.approx(hub, rel=1e-6) and sum(got.values()) == pytest.approx(1)


def test_walks(spark):
    ids, pairs, n, e = random_graph(spark, 7)
    adj, und = undirected(pairs), graph.undirected(graph.build(n, e)).cache()
    dist, q = {"n00": 0}, deque(["n00"])
    while q:
        v = q.popleft()
        for w in adj[v]:
            if w not in dist:
                dist[w] = dist[v] + 1
                q.append(w)
    assert {r.id: r.distance for r in graph.connections(und, "n00", 3).collect()} == {k: d for k, d in dist.items() if 0 < d <= 3}

    def walk(path):
        if path[-1] == "n05":
            yield tuple(path)
        elif len(path) <= 4:
            for w in adj[path[-1]]:
                if w not in path:
                    yield from walk([*path, w])

    want = {p for p in walk(["n00"]) if len(p) <= 5}
    assert {tuple(r.path) for r in graph.simple_paths(und, "n00", "n05", 4).collect()} == want
    assert [tuple(r.path) for r in graph.simple_paths(und, "n00", "n00").collect()] == [("n00",)]
    assert {r.id for r in graph.common_neighbours(und, "n00", "n05").collect()} == (adj["n00"] & adj["n05"]) - {"n00", "n05"}


# ---- links ----


def test_links(spark):
    n = vault(spark, {"A.md": "# Top\n[[B]] [[B#Sec]] [[B#No]] [[C]] `[[D]]` ![[E]] [[#Top]] [[x.png]] [[B#^b1]] [[B#^b2]] [[B#Sec#Sub]]", "F/B.md": "## Sec\ntext ^b1\n### Sub", "G.md": ""})
    got = sorted((r.source_id, r.link, r.reason) for r in links.broken_links(n, attachments=spark.createDataFrame([("img/x.png",)], "path string")).collect())
    assert got == [("A.md", "[[B#No]]", "heading_not_found"), ("A.md", "[[B#^b2]]", "block_not_found"), ("A.md", "[[C]]", "note_not_found")]
    e = edges(spark, [("A.md", "F/B.md"), ("G.md", "G.md"), ("A.md", "_stub/B.md"), ("A.md", "Z.md"), ("A.md", "Z.md")])
    assert {(r.id, r.outgoing_links) for r in links.orphaned(n, e).collect()} == {("A.md", 3), ("G.md", 0)}
    stubs = links.stub_notes(e, n)
    assert {(r.id, r.inbound, r.title) for r in stubs.collect()} == {("_stub/B.md", 1, "B"), ("_stub/Z.md", 2, "Z")}
    assert [tuple(r) for r in links.resolve_stubs(stubs, n).collect()] == [("_stub/B.md", "F/B.md")]


# ---- rewrites ----


def test_rewrites(spark):
    n = vault(spark, {"A.md": "see [[Old/B|b]] [[B#x]] [[Bb]] `[[B]]` #area #area/x `#area`\ncat cats\n```\ncat\n```", "Old/B.md": "# H\ntext", "N.md": None, "L.md": "[[B#H|x]] [[Old/B#h]]"}, {"A.md": '{"tags": ["Area", "area/q", "b"], "tag": "#area"}'})
    linked = edges(spark, [("A.md", "Old/B.md"), ("A.md", "Old/B.md"), ("Old/B.md", "Old/B.md"), ("L.md", "_stub/Old/B.md"), ("N.md", "Old/B.md")])
    moved = {r.id: (r.content, r.n) for r in rewrite.move_note(n, "Old/B.md", "New/C.md", linked).collect()}
    assert moved["A.md"][0].startswith("see [[New/C|b]] [[C#x]] [[Bb]] `[[C]]`") and moved["A.md"][1] == 3 and moved["L.md"] == ("[[C#H|x]] [[New/C#h]]", 2) and len(moved) == 2
    # a note that does not link to it keeps its links, as do unchanged stems
    assert {r.id: (r.content[:30], r.n) for r in rewrite.move_note(n, "Old/B.md", "New/B.md", linked.where("source_id = 'A.md'")).collect()} == {"A.md": ("see [[New/B|b]] [[B#x]] [[Bb]]", 1)}
    m = vault(spark, {"A.md": "[[x/B.md]] ![[ x/B |a]] [[$1^b]] [[x/BB]]"})
    assert rewrite.move_note(m, "x/B.md", "y/$1.md", edges(spark, [("A.md", "x/B.md")])).first().content == "[[y/$1]] ![[y/$1|a]] [[$1^b]] [[x/BB]]"
    tags = rewrite.rename_tag(n, "area", "zone").collect()
    assert tags[0].n == 2 and "#zone #zone/x `#area`" in tags[0].content
    assert rewrite.rename_tag(n, "area", "zone", nested=False).first().n == 1
    assert rewrite.rename_tag_frontmatter(n, "area", "zone").first().frontmatter == '{"tags": ["zone", "zone/q", "b"], "tag": "#zone"}'
    plan = rewrite.search_and_replace(n, r"(\w)at(s?)", "$1og$2 $$ $&", regex=True)
    assert plan.first().content.endswith("cog $ cat cogs $ cats\n```\ncat\n```") and tuple(rewrite.totals(plan).first()) == (1, 2)
    heads = {r.id: r.content for r in rewrite.rename_heading(n, "Old/B.md", "h", "New").collect()}
    assert heads == {"Old/B.md": "# New\ntext", "L.md": "[[B#New|x]] [[Old/B#New]]"}
    with pytest.raises(LookupError):
        rewrite.rename_heading(n, "Old/B.md", "nope", "x")


def test_tag_ends_and_names(spark):
    n = vault(spark, {"A.md": "#caf #café x#caf ##caf #caf-x #caf_ #caf/y\t#CAF. (#caf)"})
    got = rewrite.rename_tag(n, " ##caf", "tea").first()
    assert (got.content, got.n) == ("#tea #café x#caf ##caf #caf-x #caf_ #tea/y\t#tea. (#caf)", 3)
    assert rewrite.rename_tag(n, "caf", "tea", nested=False).first().n == 2
    for bad in ("", "#", "12", "a b", "/a", "a/", "a//b", "a!"):
        with pytest.raises(ValueError):
            rewrite.rename_tag(n, "caf", bad)


def test_rename_tag_has_both_sides(spark):
    fm = {
        "A.md": '{"n": 1.10, "Tags": ["Area", "x,area/q", 2.0, "areas", "my-area"], "tag": "#area b", "other": "area"}',
        "B.md": '{"tag": "\\u0061rea\\ud800"}', "C.md": '{"tags": ["area"', "D.md": '["area"]', "E.md": "{}", "F.md": '{"tags":"area"}',
    }
    n = vault(spark, {"A.md": "#area `#area`", "B.md": None, "C.md": "none", "D.md": "", "E.md": "#area/x", "F.md": "kept"}, fm)
    got = {r.id: (r.content, r.frontmatter, r.n) for r in rewrite.rename_tag_whole(n, "#area", "zone").collect()}
    assert got == {
        "A.md": ("#zone `#area`", '{"n": 1.10, "Tags": ["zone", "x,zone/q", 2.0, "areas", "my-area"], "tag": "#zone b", "other": "area"}', 4),
        "B.md": (None, '{"tag": "zone\\ud800"}', 1),
        "E.md": ("#zone/x", "{}", 1),
        "F.md": ("kept", '{"tags":"zone"}', 1),
    }
    assert {r.id: r.n for r in rewrite.rename_tag_whole(n, "area", "zone", nested=False).collect()} == {"A.md": 3, "B.md": 1, "F.md": 1}


def test_m2_query_changes_frontmatter(spark):
    from notefathom.plans.registry import QUERIES

    got = QUERIES["m2_rename_tag"](spark, "/root/testdata/sf0.01")
    assert got.columns == ["id", "content", "frontmatter", "n"] and got.count() > 0


def test_single_note_edits():
    t = "---\na: 1\ntags:\n  - x\n---\n# H\none\n## I\ntwo\n# J"
    e = lambda *a, **k: rewrite.edit(t, *a, **k)
    assert e("append", "z").endswith("# J\nz") and "---\nz\n# H" in e("prepend", "z")
    assert "uno" in e("replace_window", "uno", search="one") and "uno" in e("replace_window", "uno", search="onne", fuzzy=0.7)
    assert e("patch_heading", "new", heading="h").endswith("# H\nnew\n# J") and "# H\nnew\n## I" in e("patch_heading", "new", heading="h", scope="body")
    assert "two\nnew\n# J" in e("patch_heading", "new", heading="I", op="after")
    assert e("at_line", "q", line=1, op="before").startswith("q\n---") and "a: 2" in e("patch_frontmatter", key="a", value=2)
    for bad in (lambda: e("append", "z", expected="other"), lambda: e("replace_window", "z", search="zzzzzz"), lambda: e("patch_heading", "z", heading="q"), lambda: e("nope")):
        with pytest.raises((ValueError, LookupError)):
            bad()
    assert rewrite.update_properties(t, {"b": ["p", 1]}, ["tags"]).startswith("---\na: 1\nb: [p, 1]\n---\n# H")
    assert rewrite.update_properties("x", {"k": "v"}) == "---\nk: v\n---\nx"
    assert rewrite.ensure_block_id("one\ntwo", 2, "b") == ("one\ntwo ^b", "b") and rewrite.ensure_block_id("one ^q", 1, "b") == ("one ^q", "q")
    held = rewrite.Previews(2, 10)
    for i in range(3):
        held.put(f"p{i}", "a", "old", "new", i)
    assert "p0" not in held.held and held.take("p2", "old", 5) == ("a", "new")
    with pytest.raises(LookupError):
        held.take("p1", "old", 50)
    assert rewrite.diff("a\n", "b\n").splitlines()[-2:] == ["-a", "+b"]


# ---- incremental ----


def test_incremental_equals_rebuild(spark):
    files = lambda rows: spark.createDataFrame(rows, "path string, mtime long, raw string")
    first = files([("a.md", 1, "---\ntitle: T\n---\nx"), ("b.md", 1, "y"), ("c.md", 1, "z")])
    empty_n = incremental.parse(first.limit(0))
    n1, s1, st1 = incremental.index_pass(empty_n, spark.createDataFrame([], "path string, mtime long"), first)
    assert tuple(st1.first()) == (3, 0, 0) and {(r.id, r.title) for r in n1.collect()} == {("a.md", "T"), ("b.md", "b"), ("c.md", "c")}
    second = files([("a.md", 1, "ignored, not newer"), ("b.md", 2, "y2"), ("d.md", 1, "w")])
    n2, s2, st2 = incremental.index_pass(n1, s1, second)
    assert tuple(st2.first()) == (2, 1, 1)
    assert {(r.id, r.content) for r in n2.collect()} == {("a.md", "x"), ("b.md", "y2"), ("d.md", "w")}
    assert {(r.path, r.mtime) for r in s2.collect()} == {("a.md", 1), ("b.md", 2), ("d.md", 1)}


def test_budget_and_compatibility():
    b = incremental.Budget(512)
    b.failed()
    b.failed()
    assert (b.discovered, b.tokens, b.chars) == (256, 230, 575)
    b.reset()
    assert b.tokens == 460
    base = {"layout": 1, "model": "m", "dim": 3, "tokenizer": "t"}
    assert incremental.compatibility(base, base, 1, 1) == set() and incremental.compatibility(base, base | {"dim": 4, "tokenizer": "u"}, 1, 1) == {"embeddings", "text"}
    assert incremental.compatibility(base, base | {"layout": 2}, 1, 1) == {"all"} and incremental.compatibility(base, base, 5, 0) == {"embeddings"}

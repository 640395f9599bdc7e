import itertools
import random
import re

import numpy as np
import pytest

from notefathom.llm import mixing, neardup, pii, sketch


# ---- near duplicates ----


def words_of(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()) + str(rng.randrange(40)) for _ in range(n)]


def corpus(seed=1):
    rng, rows, rid = random.Random(seed), [], 0
    for base in range(25):
        w = words_of(rng, rng.randrange(30, 90))
        for k in range(rng.randrange(1, 6)):
            v = list(w)
            for _ in range(rng.randrange(0, 4)):
                v[rng.randrange(len(v))] = f"new{rng.randrange(99)}"
            rows.append((rid, f"n{base}-{k % 3}", " ".join(v[:2]), " ".join(v[2:])))
            rid += 1
    hot = " ".join(words_of(rng, 60))
    rows += [(rid + i, f"hot{i % 40}", None, hot) for i in range(60)]
    rows += [(900, "a", "t", None), (901, "b", "t", "too short"), (902, None, "", hot + " end"), (903, None, "", hot + " end"), (904, "same", "x", "y " * 60), (905, "same2", "x", "y " * 60)]
    return rows


def brute(rows, t, least):
    sets = {}
    for rid, nid, title, content in rows:
        if content is not None:
            w = "".join(c if c.isalnum() else " " for c in f"{title or ''} {content}".lower()).split()
            if len(w) >= least:
                sets[rid] = (nid, set(zip(w, w[1:], w[2:])))
    out = set()
    for (a, (i, x)), (b, (j, y)) in itertools.combinations(sorted(sets.items()), 2):
        if i != j and len(x & y) >= t * len(x | y) - 1e-12:
            out.add((a, b))
    return out


def nodes(spark, rows):
    return spark.createDataFrame(rows, "row_id long, id string, title string, content string").selectExpr("*", "'q' as words", "1 as n", "2 as rep")


def test_pairs_against_brute_force(spark):
    rows = corpus()
    join = neardup.Join(nodes(spark, rows))
    got = [tuple(r) for r in join.row_pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 0.7, 30)


def test_hot_tokens_and_groups_in_blocks(spark, monkeypatch):
    for name, most in (("HOT", 3), ("BLOCK", 4), ("ASKERS", 5)):
        monkeypatch.setattr(neardup, name, most)
    rows = corpus(7)
    assert {tuple(r) for r in neardup.Join(nodes(spark, rows)).row_pairs().collect()} == brute(rows, 0.7, 30)


def test_filter_beyond_its_bound(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MOST_FILTER_BITS", 8)
    rows = corpus(5)
    assert {tuple(r) for r in neardup.Join(nodes(spark, rows)).row_pairs().collect()} == brute(rows, 0.7, 30)


def test_sketch_in_levels(spark, monkeypatch):
    monkeypatch.setattr(sketch, "FAN", 3)
    rows = spark.range(0, 5000, 1, 20).selectExpr("id % 37 as cell")
    got = sketch.sketch(rows, lambda b: (b.column(0).to_numpy(), np.ones(b.num_rows, np.int64)), 8)
    want = np.bincount(np.arange(5000) % 37, minlength=256)
    assert (got == sketch.coded(want)).all()


def test_components(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (5, 6), *((20 + i, 21 + i) for i in range(12))], "rep_a long, rep_b long")
    got = {r.rep: r.grp for r in neardup.components(pairs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5} | {20 + i: 20 for i in range(13)}


def test_no_records(spark):
    assert neardup.Join(nodes(spark, [(1, "a", "t", None)])).row_pairs().count() == 0


# ---- mixing ----


def test_route_overlapping_sources():
    tokens = {("a",): 100, ("a", "b"): 100, ("b",): 10}
    got = mixing.route({"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}, tokens)
    total = {s: sum(f for (_, x), f in got.items() if x == s) for s in "ab"}
    assert total == {"a": 105, "b": 105}
    assert mixing.route({"a": 1.0, "none": 2.0}, {"a": 3, "none": 1}, {("a",): 10}) == {(("a",), "a"): 30}
    assert mixing.route({"a": 0.0}, {"a": 3}, {("a",): 10}) == {}


def test_route_is_convex_to_the_end():
    # two sources share "ab"; the repeats run far over any fixed number of passes and stay level with each other
    tokens = {("a",): 1, ("a", "b"): 1, ("b",): 1}
    got = mixing.route({"a": 0.5, "b": 0.5}, {"a": 300, "b": 300}, tokens)
    assert sum(f for (p, _), f in got.items() if p == ("a", "b")) == 300 and sum(got.values()) == 900
    # of two patterns for one source each is taken as often as the other, at any number of passes
    got = mixing.route({"a": 0.5, "c": 0.5}, {"a": 200, "c": 1}, {("a",): 10, ("a", "x"): 10, ("c",): 2000, ("x",): 5})
    assert got[("a",), "a"] == got[("a", "x"), "a"] == 1000


def test_flow_has_no_cheaper_exchange():
    rng = random.Random(6)
    for _ in range(30):
        tokens = {p: rng.randrange(1, 9) for p in [("a",), ("b",), ("a", "b"), ("a", "c"), ("c",), ("a", "b", "c")]}
        repeats = {s: rng.randrange(1, 6) for s in "abc"}
        got = mixing.route({"a": 1.0, "b": 1.0, "c": 2.0}, repeats, tokens)
        for p, n in tokens.items():
            assert sum(f for (q, _), f in got.items() if q == p) <= n * max(repeats[s] for s in p)
        assert all(f <= tokens[p] * repeats[s] for (p, s), f in got.items())
        # no single token moved to an earlier pass of another pattern makes it cheaper
        use = {p: sum(f for (q, _), f in got.items() if q == p) for p in tokens}
        for (p, s), f in got.items():
            for q, n in tokens.items():
                if f and s in q and q != p and got.get((q, s), 0) < n * repeats[s] and use[q] < n * max(repeats[x] for x in q):
                    assert use[q] // n >= (use[p] - 1) // tokens[p]


def test_many_patterns_are_routed_whole(monkeypatch):
    # together or path by path: the same total, and the same least cost
    def cost(got, tokens):
        used = {p: sum(f for (q, _), f in got.items() if q == p) for p in tokens}
        return sum(n * (k * (k - 1) // 2) + k * (used[p] - n * k) for p, n in tokens.items() for k in [used[p] // n])

    rng = random.Random(8)
    for turn in range(40):
        names = "abcde"[: rng.randrange(2, 6)]
        every = [tuple(s for i, s in enumerate(names) if k >> i & 1) for k in range(1, 1 << len(names))]
        tokens = {p: rng.randrange(1, 60) for p in rng.sample(every, rng.randrange(1, len(every) + 1))}
        plan, repeats = {s: rng.choice([0.0, 1.0, 2.0, 5.0]) for s in names}, {s: rng.randrange(0, 5) for s in names}
        single = mixing.route(plan, repeats, tokens)
        with monkeypatch.context() as m:
            m.setattr(mixing, "MOST_PATTERNS", 0)
            many = mixing.route(plan, repeats, tokens)
        assert all(sum(f for (_, t), f in single.items() if t == s) == sum(f for (_, t), f in many.items() if t == s) for s in names)
        assert all(f <= tokens[p] * repeats[s] for (p, s), f in many.items()) and cost(single, tokens) == cost(many, tokens)


def test_mixture_meets_quotas_with_small_patterns_beyond_the_most(spark, monkeypatch):
    # "b" has its tokens only in the smallest pattern, which it shares with "a" of the greater share
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 1)
    sizes = spark.createDataFrame([(i, ["a"], 10) for i in range(300)] + [(1000 + i, ["a", "b"], 10) for i in range(100)], "doc_id long, sources array<string>, n_tokens long")
    plan = spark.createDataFrame([("p", "a", 3.0, 1), ("p", "b", 1.0, 1)], "plan_name string, source string, target_share double, max_repeats int")
    got = {r.source: r.tokens for r in mixing.mixture(sizes, plan)[1].collect()}
    assert got == {"a": 3000, "b": 1000}


def test_mixture_of_overlapping_sources(spark):
    rng = random.Random(9)
    docs = [(i, rng.choice([["a"], ["b"], ["a", "b"], ["c", "a"], ["c"], ["x", "b"]]), rng.randrange(1, 40)) for i in range(4000)]
    sizes = spark.createDataFrame(docs, "doc_id long, sources array<string>, n_tokens long")
    plan = spark.createDataFrame([("p", "a", 2.0, 2), ("p", "b", 1.0, 3), ("p", "c", 1.0, 1)], "plan_name string, source string, target_share double, max_repeats int")
    for most in (mixing.MOST_PATTERNS, 2):
        before, mixing.MOST_PATTERNS = mixing.MOST_PATTERNS, most
        try:
            mixed, shares = mixing.mixture(sizes, plan)
            got, rows = {r.source: r for r in shares.collect()}, mixed.collect()
        finally:
            mixing.MOST_PATTERNS = before
        assert all(r.source in dict((d, s) for d, s, _ in docs)[r.doc_id] for r in rows)
        assert all(r.most_repeats <= r.max_repeats for r in got.values())
        assert all(abs(got[s].reached_share - w) < 0.01 for s, w in (("a", 0.5), ("b", 0.25), ("c", 0.25)))


def test_mixture(spark):
    rng = random.Random(2)
    docs = [(i, ["big"], rng.randrange(1, 50)) for i in range(3000)] + [(5000 + i, ["small"], 20) for i in range(20)] + [(9000, ["other"], 5), (9001, ["big"], 0), (9002, [None], 7)]
    sizes = spark.createDataFrame(docs, "doc_id long, sources array<string>, n_tokens long").selectExpr("*", "1 as turn", "2 as bucket")
    plan = spark.createDataFrame([("p", " Big", 3.0, 1), ("p", "small", 1.0, 4), ("p", "gone", 1.0, 2), ("q", "small", 1.0, 2), ("z", "gone", 1.0, 1)], "plan_name string, source string, target_share double, max_repeats int")
    mixed, shares = mixing.mixture(sizes, plan)
    rows = mixed.collect()
    most = {"big": 1, "small": 4}
    assert all(0 < r.occurrences <= (2 if r.plan_name == "q" else most[r.source]) for r in rows)
    got = {(r.plan_name, r.source): r for r in shares.collect()}
    assert got["p", "small"].tokens == 1600 and got["q", "small"].tokens == 800
    assert abs(got["p", "big"].tokens - 4800) <= 50 and got["p", "gone"].tokens == 0 and got["z", "gone"].reached_share == 0
    assert abs(got["p", "big"].reached_share - 0.75) < 0.01
    again = mixing.mixture(sizes.repartition(7), plan)[0]
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in rows}
    assert mixing.mixture(sizes.limit(0), plan)[0].count() == 0


# ---- personal information ----


@pytest.fixture(scope="module")
def names():
    return pii.Names(frozenset(["ada"]), frozenset(["byron"]), np.zeros((4, 1 << pii.WORD_BITS), np.uint8))


@pytest.mark.parametrize(("text", "cases"), [
    ("mail <a.b+c@mail.site.example>, ok", [("a.b+c@mail.site.example", "email")]),
    ("x [at] y [dot] example [dot] net", [("x [at] y [dot] example [dot] net", "email")]),
    ("à heis(dot)ada(at)cae(dot)test, or al dot bo [dot] kay at bee dot org", [("heis(dot)ada(at)cae(dot)test", "email"), ("al dot bo [dot] kay at bee dot org", "email")]),
    ("kit＠site.test and kay at bee dot org", [("kit＠site.test", "email"), ("kay at bee dot org", "email")]),
    ("pinned lib@1.2.3, ping @who.else, not at nine at the dot com audit", []),
    ("Call tel:+1-212-555-0100 now", [("+1-212-555-0100", "phone")]),
    ("☎ (212) 555-0100 ext. 7", [("(212) 555-0100 ext. 7", "phone")]),
    ("+44 (0)20 7946 0123 x45; ０２０ ７９４６ ０４０５", [("+44 (0)20 7946 0123 x45", "phone"), ("０２０ ７９４６ ０４０５", "phone")]),
    ("Ticket 0007 2452 232, order no. 2221-6670, host 10.0.12.19 on 2024-02-17", []),
    ("SSN 911-22-3333 and passport no. X1234567T", [("911-22-3333", "id_number"), ("X1234567T", "id_number")]),
    ("nº de identidad 0981 6583 824", [("0981 6583 824", "id_number")]),
    ("insured under qh-53-86-99-b.", [("qh-53-86-99-b", "id_number")]),
    ("batch 25716649180, Form 940-9, serial Z29231", []),
    ("We met at Flat 3, 14 Old Mill Rd, Townham AB1 2CD; fine", [("Flat 3, 14 Old Mill Rd, Townham AB1 2CD", "address")]),
    ("Address:\n44 Zed Avenue\nRiverton 41262\n", [("44 Zed Avenue\nRiverton 41262", "address")]),
    ("an Musterstraße 12a, 10115 Berlin.", [("Musterstraße 12a, 10115 Berlin", "address")]),
    ("à 167 bis, rue de Lyon, 04433 Nantes", [("167 bis, rue de Lyon, 04433 Nantes", "address")]),
    ("en Calle Mayor 12, 2º B, 28013 Madrid", [("Calle Mayor 12, 2º B, 28013 Madrid", "address")]),
    ("section 12 of the road map, 13 streets away", []),
    ("Dr. Ada M. Byron's draft", [("Ada M. Byron", "name")]),
    ("by **van Byron, Ada** and A. Byron", [("van Byron, Ada", "name"), ("A. Byron", "name")]),
    ("lunch with Ada was moved; Byron Bridge", []),
    ("", []),
])
def test_cases(names, text, cases):
    assert [(text[a:b], k) for a, b, k in pii.spans(text, names)] == cases


@pytest.mark.parametrize(("text", "phones"), [
    ("Reach the batch desk on 001 212 555-0107 until noon.", ["001 212 555-0107"]),
    ("Reach the invoice desk on 415.555.0181; call room service at 030 1234567", ["415.555.0181", "030 1234567"]),
    ("Host +49 30 1234567, form to 030 7654321 and phone no. 0171 1234567", ["+49 30 1234567", "030 7654321", "0171 1234567"]),
    ("Ticket 0053 0062 400, ticket no. 0389 8543 17, **Order:** 0171 1234567, order no. 030 1234567, lane #030 1234567", []),
])
def test_labels_of_other_numbers(names, text, phones):
    assert [text[a:b] for a, b, k in pii.spans(text, names) if k == "phone"] == phones


@pytest.mark.parametrize(("text", "phones"), [
    ("Tel. 030 1234567 / 0171 1234567", ["030 1234567", "0171 1234567"]),
    ("Tel. 030 1234567/0171 1234567 or", ["030 1234567", "0171 1234567"]),
    ("Tel. 06 39 98 32 10  06 39 98 32 11.", ["06 39 98 32 10", "06 39 98 32 11"]),
    ("(212) 555-0100 (212) 555-0101 ext. 7", ["(212) 555-0100", "(212) 555-0101 ext. 7"]),
    ("Call 4111 1111 1111 1111 1111 or Ticket 8661 6494 122", []),
])
def test_several_phones_in_a_run(names, text, phones):
    assert [text[a:b] for a, b, k in pii.spans(text, names) if k == "phone"] == phones


def tables(spark):
    filler = "the quick note is kept here. " * 20
    docs = [(1, filler + "Ada Byron wrote a@b.example"), (2, None), (3, ""), (4, "Byron, Ada; A@B.EXAMPLE"), (5, "Zora Quint met Ada Byron. " + filler * 300), (6, "🌱 c@d.test".encode("utf-16", "surrogatepass").decode("utf-16"))]
    return (
        spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as kind", "2 as start_pos"),
        spark.createDataFrame([(1, "Ada", "Byron", "x"), (2, None, None, None)], "contact_id long, given_name string, family_name string, team string"),
    )


def test_found_and_redacted(spark):
    docs, contacts = tables(spark)
    cases = pii.find(docs, contacts)
    got = sorted((r.doc_id, r.kind, r.entity) for r in cases.collect())
    assert got == [(1, "email", "a@b.example"), (1, "name", "Ada Byron"), (4, "email", "A@B.EXAMPLE"), (4, "name", "Byron, Ada"), (5, "name", "Ada Byron"), (5, "name", "Zora Quint"), (6, "email", "c@d.test")]
    texts = {r.doc_id: r.text for r in pii.redacted(docs, contacts).collect()}
    assert len(texts) == docs.count() and texts[4] == "[NAME]; [EMAIL]" and texts[2] is None and texts[3] == "" and texts[6] == "🌱 [EMAIL]"
    assert "Exchange" not in pii.redacted(docs, contacts)._jdf.queryExecution().executedPlan().toString()
    assert pii.find(docs.limit(0), contacts.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1000, 0])
def test_surrogates(spark, most):
    docs, contacts = tables(spark)
    found = pii.cut_lineage(pii.detected(docs, contacts, texts=True))
    rows = pii.surrogates(found, "key", most).collect()
    put = {(r.doc_id, c.kind, c.entity): p for r in rows for c, p in zip(r.cases, r.puts)}
    given, family = put[1, "name", "Ada Byron"].split()
    assert put[4, "name", "Byron, Ada"] == f"{family}, {given}" and put[5, "name", "Ada Byron"] == f"{given} {family}" != "Ada Byron"
    assert put[1, "email", "a@b.example"].upper() == put[4, "email", "A@B.EXAMPLE"] and put[1, "email", "a@b.example"].endswith(".example")
    texts = {r.doc_id: r.text for r in found.withColumn("puts", pii.F.lit(None).cast("array<string>")).collect()}
    assert texts[2] is None and texts[3] == ""


def test_one_entity_one_surrogate():
    s = lambda e, k, turns=None: pii.surrogate(e, k, "k", turns)
    assert s("+44 20 7946 0123", "phone")[:4] == "+44 " and s("+44 20 7946 0123", "phone") != s("+44 20 7946 0124", "phone")
    digits = lambda t: re.sub(r"\D", "", t)
    assert digits(s("(030) 1234567", "phone")) == digits(s("030 1234567", "phone"))
    assert digits(s("+44 (0)20 7946 0123", "phone")).replace("440", "44") == digits(s("0044 20 7946 0123", "phone"))[2:] == digits(s("+44 20-7946-0123", "phone"))
    ext = s("(212) 555-0100 ext. 7", "phone")
    assert digits(ext)[:10] == digits(s("212.555.0100", "phone")) and " ext. " in ext
    assert re.fullmatch(r"[A-Z]{2} \d\d \d\d \d\d [A-Z]", s("QH 54 73 35 D", "id_number")) and s("qh547335d", "id_number").upper() == s("QH 54 73 35 D", "id_number").replace(" ", "")
    name, short = s("Ada van Byron", "name").split(), s("A. van Byron", "name").split()
    assert name[1:] == short[1:] and name[0][0] == short[0][0] and short[0][1:] == "." and name[1] == "van"
    assert s("ADA BYRON", "name") == s("Ada Byron", "name").upper()
    assert re.fullmatch(r"[а-яА-ЯёЁ]+ [а-яА-ЯёЁ]+", s("Иван Петров", "name")) and re.fullmatch(r"[\u4e00-\u9fff]{2} [\u4e00-\u9fff]{2}", s("田中 太郎", "name"))
    home = s("Flat 3, 14 Old Mill Rd, Townham AB1 2CD", "address")
    assert re.match(r"Flat [1-9], [1-9]\d [A-Z][a-z]+ [A-Z][a-z]+ Rd, [A-Z]", home) and s("Musterstraße 12a", "address").split()[0].endswith("straße")
    mail = s("ada.byron7@mail.site.example", "email")
    assert s("ada dot byron7 at mail dot site dot example", "email") == mail.replace("@", " at ").replace(".", " dot ")
    assert mail.split("@")[0].split(".")[0] == name[0].lower() and mail.endswith(".example") and "site" not in mail


def test_permutations_are_permutations():
    for size in (1, 2, 3, 10, 90, 1000):
        assert sorted(pii.permuted(x, size, "k", "p") for x in range(size)) == list(range(size))
    made = {pii.number_surrogate(f" 0{n:04d} ", "phone", "k", 0) for n in range(10_000)}
    assert len(made) == 10_000


def test_surrogates_never_clash(spark):
    # every phone of a form, so none is free, and more words than pairs of syllables can tell apart at once
    phones = [{"start_pos": 0, "end_pos": 1, "kind": "phone", "entity": f"01 {n:03d}"} for n in range(1000)]
    people = [{"start_pos": 0, "end_pos": 1, "kind": "name", "entity": f"A{chr(97 + n % 26)}{chr(97 + n // 26 % 26)}x{chr(97 + n // 676)}o Q"} for n in range(6000)]
    rows = [(k, None, (phones + people)[k :: 50]) for k in range(50)]
    found = pii.cut_lineage(spark.createDataFrame(rows, pii._FOUND_DDL))
    got = pii.surrogates(found, "k").collect()
    pairs = {(c.kind, c.entity): p for r in got for c, p in zip(r.cases, r.puts)}
    assert len(pairs) == 7000 and len(set(pairs.values())) == 7000
    real = {e for k, e in pairs if k == "name"}
    assert not real & set(pairs.values())


def test_known_names_beyond_the_bound(spark):
    contacts = spark.createDataFrame([(f"Given{chr(97 + i)}", f"Family{chr(97 + i)}") for i in range(26)], "given_name string, family_name string")
    exact, probed = pii.known_names(contacts), pii.known_names(contacts, most=5, size=18)
    assert all(w in got for got, want in zip(probed, exact) for w in want) and len(exact[0]) == 26
    assert sum(f"other{i}" in probed[0] for i in range(2000)) < 20


@pytest.mark.parametrize(("text", "cases"), [
    ("Grace Hill met June Park", []),
    ("Συνάντηση με Νίκος Παπάς σήμερα", [("Νίκος Παπάς", "name")]),
    ("連絡先は田中 太郎様です。「山田・花子さん」", [("山田・花子", "name")]),
    ("住所 東京都千代田区丸の内1-1-1 です", [("東京都千代田区丸の内1-1-1", "address")]),
    ("38件の橋が 12月3-4日", []),
    ("at 12 Old Mill Road, " + "Verylongtown" * 20 + " AB1 2CD", [("12 Old Mill Road, " + "Verylongtown" * 20 + " AB1 2CD", "address")]),
    ("serial 0800 1234 567, call 0800 1234 567", [("0800 1234 567", "phone")]),
])
def test_other_scripts_and_long_cases(names, text, cases):
    assert [(text[a:b], k) for a, b, k in pii.spans(text, names)] == cases


def test_listed_people_may_have_any_word(names):
    listed = pii.Names(frozenset(["grace", "june"]), frozenset(["hill", "park"]), names.cells)
    text = "Grace Hill met June Park"
    assert [text[a:b] for a, b, _ in pii.spans(text, listed)] == ["Grace Hill", "June Park"]

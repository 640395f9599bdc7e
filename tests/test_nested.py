import json

from hypothesis import given, settings
from hypothesis import strategies as st

from notefathom.functions import jsontext
from notefathom.operators import nested


def brute(v, path, parent, out):
    if isinstance(v, str):
        try:
            w = json.loads(v)
        except ValueError:
            w = v
        if isinstance(w, (dict, list)):
            v = w
    if isinstance(v, dict):
        if path != "$":
            out.append((path, parent))
            parent = path
        for k, x in v.items():
            brute(x, f"{path}.{k}", parent, out)
    elif isinstance(v, list):
        for n, x in enumerate(v):
            brute(x, f"{path}[{n}]", parent, out)


LEAF = st.none() | st.booleans() | st.integers(-9, 9) | st.sampled_from(["x", "", "{}", "[{}]", '{"a": [{"b": {}}]}', "[not", "{bad}"])
TREE = st.recursive(LEAF, lambda s: st.lists(s, max_size=3) | st.dictionaries(st.sampled_from(["a", "b", "k.x", "c d"]), s, max_size=3), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.sampled_from("abc"), TREE, max_size=3))
def test_paths_against_brute_force(tree):
    expected = []
    brute(tree, "$", "$", expected)
    got = nested.flatten(jsontext.read(json.dumps(tree)))
    assert [(p, q) for p, q, *_ in got] == expected


def test_identities():
    got = nested.flatten(json.loads('{"x": {"a": 1, "b": [2, {"c": {}}]}, "y": {"b": [2, {"c": {}}], "a": 1}, "z": {"a": 1, "b": [2, {"c": {"d": 0}}]}}'))
    h = {p: (own, up) for p, _, _, _, own, up, _ in got}
    assert h["$.x"][0] == h["$.y"][0] != h["$.z"][0]
    assert h["$.x.b[1]"][1] == h["$.x"][0]
    assert h["$.x.b[1].c"][0] == h["$.y.b[1].c"][0]


def test_numbers_keep_their_text():
    a, b = (nested.flatten(jsontext.read('{"o": {"v": %s}}' % v))[0][4] for v in ("1", "1.0"))
    assert a != b


def test_very_deep():
    deep = '{"a":' * 5000 + "1" + "}" * 5000
    got = nested.flatten(jsontext.read(deep))
    assert len(got) == 4999
    assert jsontext.read(deep[:-1]) is jsontext.INVALID


def test_table(spark):
    rows = [(1, '{"a": {}, "s": "[{\\"x\\": 1}]"}'), (1, '{"a": {}}'), (2, None), (3, ""), (4, "{cut"), (5, '[{"a": {}}]'), (6, "{}"), (7, '{"a": {"\\ud800": {}}}')]
    nodes = spark.createDataFrame(rows, "row_id long, frontmatter string").selectExpr("*", "1 as obj_path", "2 as ordinal")
    bridge = nested.subtree_bridge(nodes)
    got = sorted((r.row_id, r.obj_path, r.parent_path) for r in bridge.collect())
    assert got[:3] == [(1, "$.a", "$"), (1, "$.a", "$"), (1, "$.s[0]", "$")]
    assert (5, "$[0].a", "$[0]") in got and not any(r[0] in (2, 3, 4, 6) for r in got)
    objects = {r.canonical: r.occurrences for r in nested.subtree_objects(bridge).collect()}
    assert objects["{}"] == 4


def plain(v):
    """JSON texts in strings taken as what they are."""
    if isinstance(v, str):
        try:
            w = json.loads(v)
        except ValueError:
            return v
        return plain(w) if isinstance(w, (dict, list)) else v
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return [plain(x) for x in v] if isinstance(v, list) else v


def test_records_are_rebuilt_from_objects_and_bridge(spark):
    trees = [
        {"a": {"b": [{"c": 1}, {"c": 1}, [{}]]}, "s": '{"x": [{"y": "#0123456789abcdef0123456789abcdef"}]}'}, {}, [{"q": {}}, 1.5, None, "t"], {"k": 'x"y\\', "n": [True, False]}, {"only": "scalars"}, [], {"a": {"b": [{"c": 1}]}},
    ]
    rows = [(i, json.dumps(t)) for i, t in enumerate(trees)] + [(90, "{cut"), (91, None), (92, "5")]
    bridge = nested.subtree_bridge(spark.createDataFrame(rows, "row_id long, frontmatter string"), roots=True).cache()
    got = {r.row_id: json.loads(r.record) for r in nested.rebuilt(bridge.drop("canonical"), nested.subtree_objects(bridge)).collect()}
    assert got == {i: plain(t) for i, t in enumerate(trees)}
    deep = json.loads('{"a":' * 300 + "1" + "}" * 300)
    bridge = nested.subtree_bridge(spark.createDataFrame([(1, json.dumps(deep))], "row_id long, frontmatter string"), roots=True)
    assert json.loads(nested.rebuilt(bridge, nested.subtree_objects(bridge)).first().record) == deep

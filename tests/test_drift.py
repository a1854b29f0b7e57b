import json
from collections import Counter, defaultdict

import pytest

from quiverlake.plans import loading
from quiverlake.session import table
from quiverlake.sources import drift


def plain_changes(rows):
    """The definition over (series, seq, body) rows."""
    kinds = {int: "integer", float: "double", str: "string", bool: "boolean", list: "array", dict: "object"}
    files, seqs = defaultdict(lambda: defaultdict(set)), defaultdict(set)
    for s, q, body in rows:
        seqs[s].add(q)
        for k, v in json.loads(body).items():
            for p, x in ({f"params.{a}": x for a, x in v.items()} if k == "params" else {k: v}).items():
                files[s, q][p] |= {kinds[type(x)]} if x is not None else set()
    out = Counter()
    for s, qs in seqs.items():
        qs, types = sorted(qs), []
        for q in qs:
            now = {}
            for p, t in files[s, q].items():
                before = types[-1].get(p) if types else None
                now[p] = next(iter(t)) if len(t) == 1 else "double" if t == {"integer", "double"} else "string" if t else before
            types.append(now)
        for i in range(len(types) - 2, -1, -1):
            for p in types[i]:
                types[i][p] = types[i][p] or types[i + 1].get(p)
        for q, a, b in zip(qs[1:], types, types[1:]):
            key = lambda p, t: (p.startswith("params."), t[p])
            old, new = [p for p in a if p not in b], [p for p in b if p not in a]
            n_old, n_new = Counter(key(p, a) for p in old), Counter(key(p, b) for p in new)
            one = {k for k in n_old if k[1] and n_old[k] == 1 and n_new[k] == 1}
            for p in old:
                out[s, q, "renamed", p, next((x for x in new if key(x, b) == key(p, a)), "")] += key(p, a) in one
                out[s, q, "removed", p, ""] += key(p, a) not in one
            for p in new:
                out[s, q, "added", "", p] += key(p, b) not in one
            for p in a:
                out[s, q, "retyped", p, p] += p in b and bool(a[p] and b[p]) and a[p] != b[p]
    return +out


def found(df):
    return Counter(tuple(r) for r in drift.changes(df).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "series_name string, file_seq int, body string")


def test_all_kinds_of_change(spark):
    rows = [
        ("a", 0, '{"x": 1, "y": "s", "params": {"P": 1, "Q": null}}'), ("a", 0, '{"x": 2.5}'),
        ("a", 1, '{"x": null, "z": "t", "params": {"P": "8", "Q": 3}}'),
        ("a", 3, '{"x": [1], "z": "t", "n": true, "params": {"Q": 3.0, "R": "r"}}'),
        ("b", 0, '{}'), ("b", 1, '{"k": null}'), ("b", 2, '{"k": 1}'), ("b", 3, '{}'), ("b", 4, '{"k": "x", "m": "y"}'),
    ]
    got = found(frame(spark, rows))
    assert got == plain_changes(rows)
    assert ("a", 1, "renamed", "y", "z") in got and ("a", 3, "renamed", "params.P", "params.R") in got
    assert ("a", 1, "retyped", "params.P", "params.P") in got and ("b", 1, "added", "", "k") in got


def test_whole_table_against_the_definition(spark, data):
    df = table(spark, data, "best_config")
    assert found(df) == plain_changes([(r["series_name"], r["file_seq"], r["body"]) for r in df.collect()])


def test_repeats_and_bad_bodies_change_nothing(spark):
    rows = [("a", 0, '{"x": 1}'), ("a", 1, '{"y": 1}')]
    more = [*rows, *rows, ("a", 1, None), ("a", 0, "[1]"), ("a", 1, "{broken"), ("a", None, '{"q": 1}')]
    assert found(frame(spark, more)) == found(frame(spark, rows)) == Counter({("a", 1, "renamed", "x", "y"): 1})
    assert found(frame(spark, [])) == Counter()


def test_rescue_promote_replay(spark):
    rows = [(1, '{"a": 1, "b": "x", "params": {"old": "7"}}'), (2, '{"a": "≈8.2", "c": [1, 2.50]}'), (3, '{"a": 2, "params": {"old": 9.0, "new": 3}}'), (4, None), (5, "nope"), (6, '{"a": null, "d": null}')]
    df = spark.createDataFrame(rows, "rec_id int, body string")
    out = drift.ingest(df, {"a": "int", "params.new": "int"}, ["rec_id"])
    done = {r["rec_id"]: r for r in drift.finish(out).collect()}
    assert done[1]["a"] == 1 and json.loads(done[1]["rescued"]) == {"b": "x", "params.old": "7"}
    assert done[2]["a"] is None and done[2]["rescued"] == '{"a": "≈8.2", "c": [1, 2.50]}'
    assert done[4]["rescued"] is None and json.loads(done[5]["rescued"]) == {"_body": "nope"} and done[6]["rescued"] is None
    later = {r["rec_id"]: r for r in drift.finish(drift.promote(drift.promote(out, "params.new", "int", ["params.old"]), "b", "string")).collect()}
    assert later[1]["params_new"] == 7 and later[1]["b"] == "x" and later[1]["rescued"] is None
    assert later[3]["params_new"] == 3 and json.loads(later[3]["rescued"]) == {"params.old": 9.0}


def test_no_value_is_lost(spark, data):
    """Every non-null value is in a typed column or in the rescue."""
    df = table(spark, data, "best_config")
    out = drift.finish(drift.ingest(df, loading.BEST_CONFIG, ["rec_id"])).collect()
    bodies = {r["rec_id"]: json.loads(r["body"]) for r in df.collect()}
    for r in out:
        flat = {**{f"params.{k}": v for k, v in bodies[r["rec_id"]]["params"].items()}, **{k: v for k, v in bodies[r["rec_id"]].items() if k != "params"}}
        rescued = json.loads(r["rescued"] or "{}")
        for p, v in flat.items():
            if v is not None:
                assert rescued.get(p) == v or p in loading.BEST_CONFIG and r[p.replace(".", "_")] == v, (r["rec_id"], p, v)


def test_clashing_columns_are_refused(spark):
    with pytest.raises(ValueError):
        drift.ingest(spark.createDataFrame([(1, "{}")], "a int, body string"), {"a": "int"}, ["a"])

import math
import random
import re

import pyarrow as pa
import pytest

from quiverlake.sources.linefsm import END, START, STEP, parse_lines, split_lines, states, tokenize

WS = " \t\r\n\v\f"
NUMBER = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", re.A)
NAMED = re.compile(r"[+-]?(nan|inf|infinity)", re.I | re.A)


def is_number(t):
    return bool(NAMED.fullmatch(t)) or bool(NUMBER.fullmatch(t)) and not math.isinf(float(t))


def plain(text, dim):
    """The definition, word by word."""
    if text is None or not text.strip(WS):
        return None, None, "empty"
    name, rest = None, text
    if '"' in text:
        m = re.match(rf'[{WS}]*"((?:[^"]|"")*)"(?=[{WS}]|\Z)', text)
        if not m or '"' in text[m.end() :]:
            return None, None, "broken_quote"
        name, rest = m[1].replace('""', '"'), text[m.end() :]
    tokens = [x for x in re.split(f"[{WS}]+", rest) if x]
    if name is None and not is_number(tokens[0]):
        name, tokens = tokens[0], tokens[1:]
    if len(tokens) != dim:
        return None, None, "column_count"
    if not all(map(is_number, tokens)):
        return None, None, "bad_value"
    return name, [float(x) for x in tokens], None


def same(a, b):
    return a == b or (a and b and len(a) == len(b) and all(x == y or x != x and y != y for x, y in zip(a, b)))


def check(texts, dims):
    ids, v, reason, offset = (x.to_pylist() for x in tokenize(pa.array(texts, pa.string()), pa.array(dims, pa.int32())))
    for t, d, i, x, r, o in zip(texts, dims, ids, v, reason, offset):
        want = plain(t, d)
        assert (i, r) == (want[0], want[2]) and same(x, want[1]), (t, d, i, x, r, want)
        assert (o is None) == (r is None)


@pytest.mark.parametrize(
    "text,dim,reason",
    [
        (None, 2, "empty"), ("", 2, "empty"), (" \t\v", 2, "empty"), ('"a', 1, "broken_quote"), ('a"b 1', 1, "broken_quote"), ('"a"b 1', 1, "broken_quote"), ('"a" "b" 1', 1, "broken_quote"),
        ('"a ""b"" c" 1 2', 2, None), ("1 2 3", 2, "column_count"), ("w 1 2", 2, None), ("1 2", 2, None), ('"7" 1 2', 2, None), ("w 1 x", 2, "bad_value"), ("1e400 1", 2, "column_count"),
        ("w 1e400 1", 2, "bad_value"), ("w nan -Infinity", 2, None), ("w 1_0 2", 2, "bad_value"), ("w ١ 2", 2, "bad_value"), ("1. .5", 2, None), ("w . 5", 2, "bad_value"), ('"" 1', 1, None),
    ],
)
def test_reasons(text, dim, reason):
    assert plain(text, dim)[2] == reason
    check([text], [dim])


def test_random_lines():
    r = random.Random(5)
    parts = ['"', '""', " ", "\t", "1", "2.5", "-", "e", "1e400", "nan", "+inf", "é", "a", "\n", ".", "1.", ".5", "+3", "1d", "0x10", "1_0", "1e-400", "Infinity", "\xa0", "中"]
    check(["".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(8000)], [r.randint(0, 3) for _ in range(8000)])


def test_long_lines_cross_chunks():
    check(['"' + "a b" * 5000 + '" 1', "1 " * 3000, '"' + "x " * 4000, " " * 5000, "x" * 9000 + " 2"], [1, 3000, 1, 1, 1])


def test_states_follow_the_table_one_byte_at_a_time():
    import numpy as np

    from quiverlake.sources.linefsm import CLASS

    r = random.Random(1)
    data = np.frombuffer(bytes(r.choice(b'ab "\t\xff1') for _ in range(3001)), np.uint8)
    got, now = states(data, chunk=16), START
    for b, s in zip(data, got):
        assert s == now
        now = STEP[now][CLASS[b]]
    assert got[-1] == now and END == 3


def test_offsets():
    _, _, reason, offset = tokenize(pa.array(["w 1 x", 'w "', "1 2 3", "1", '  "a b']), pa.array([2, 1, 2, 2, 1]))
    assert list(zip(reason.to_pylist(), offset.to_pylist())) == [("bad_value", 4), ("broken_quote", 2), ("column_count", 4), ("column_count", 1), ("broken_quote", 2)]


def test_operator_keeps_every_line_and_ignores_other_columns(spark):
    rows = [(1, "w 1 2", 2, 9.0), (1, "w 1 2", 2, 9.0), (2, None, 2, 1.0), (None, "1", None, 0.0)]
    lines = spark.createDataFrame(rows, "line_id bigint, raw_text string, file_dim int, reason double")
    out = parse_lines(lines).collect()
    assert sorted((r["line_id"] or 0, r["reason"] or "") for r in out) == [(0, "column_count"), (1, ""), (1, ""), (2, "empty")]
    good, bad = split_lines(lines)
    assert good.count() == 2 and bad.count() == 2
    assert good.head()["v"] == [1.0, 2.0] and good.head()["id"] == "w"
    assert parse_lines(lines.limit(0)).count() == 0

"""Edit distance and alignment against the plain table."""

from hypothesis import given, settings
from hypothesis import strategies as st

from pageloom.functions import edit

texts = st.text(alphabet="ab, é—\n", max_size=40)


def table(a, b):
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
        rows.append(row)
    return rows


def traced(a, b):
    """Tie rule on the plain table: match, replace, delete, insert, from the end."""
    cost, i, j, script = table(a, b), len(a), len(b), []
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        elif i and j and cost[i][j] == cost[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
            script.append(("replace", i, j))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            script.append(("delete", i, j))
        else:
            j -= 1
            script.append(("insert", i, j))
    return script[::-1]


@settings(max_examples=400, deadline=None)
@given(texts, texts)
def test_distance(a, b):
    assert edit.distance(a, b) == table(a, b)[-1][-1]


@settings(max_examples=400, deadline=None)
@given(texts, texts)
def test_alignment(a, b):
    assert edit.alignment(a, b) == traced(a, b)


@settings(max_examples=200, deadline=None)
@given(texts, texts, st.integers(1, 5))
def test_alignment_over_blocks(a, b, block):
    kept, edit._BLOCK = edit._BLOCK, block
    try:
        assert edit.alignment(a, b) == traced(a, b)
    finally:
        edit._BLOCK = kept


def test_long_texts():
    a = "the quick brown fox, " * 4000
    b = a.replace("fox", "box")
    assert edit.distance(a, b) == 4000
    assert len(edit.alignment(a[:20000], b[:20000])) == edit.distance(a[:20000], b[:20000])

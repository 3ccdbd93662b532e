"""Cross-site lines: which go, which stay, and odd rows."""

from pyspark.sql import functions as F

from pageloom.llm.line_dedup import boilerplate_lines, line_dedup

NOTE = "All rights reserved by the publisher."
OWN = "This long line belongs to document number {} and to no other one of all those that are in the table here."


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, removed_lines string, line string")


def cleaned(spark, rows, **more):
    return {r.doc_id: (r.text, r.removed_lines) for r in line_dedup(frame(spark, rows), **more).collect()}


def test_threshold_is_exact_and_sites_count_once(spark):
    rows = [(i, f"{OWN.format(i)}\n{NOTE}\r\n  {NOTE}", f"s{i % 5}", "x", "y") for i in range(50)]
    assert cleaned(spark, rows) == {i: (OWN.format(i), 2) for i in range(50)}
    assert all(n == 0 for _, n in cleaned(spark, [(i, t, f"s{i % 4}", a, b) for i, t, _, a, b in rows]).values())


def test_far_above_the_threshold_is_estimated(spark):
    rows = [(i, f"{OWN.format(i)}\n{NOTE}", f"s{i}", None, None) for i in range(300)]
    (found,) = boilerplate_lines(frame(spark, rows)).collect()
    assert abs(found.sites - 300) < 15
    assert set(cleaned(spark, rows).values()) == {(OWN.format(i), 1) for i in range(300)}


def test_copies_short_lines_and_odd_rows(spark):
    copies = [(i, f"{OWN.format(0)}\n{NOTE}", f"s{i}", None, None) for i in range(9)]
    short = [(100 + i, f"{OWN.format(100 + i)}\nThe.", f"s{i}", None, None) for i in range(9)]
    odd = [(200, None, "s1", None, None), (201, "", None, None, None), (None, NOTE, None, None, None), (202, "\n" * 3, "s", None, None)]
    long = [(300 + i, ("word " * 200_000) + f"{i}\n{NOTE}", f"s{i}", None, None) for i in range(6)]
    out = cleaned(spark, copies + short + odd + long)
    # the long texts spread the note freely, so the copies lose it too and keep what only copies share
    assert all(out[i] == (OWN.format(0), 1) for i in range(9))
    assert all(v == (f"{OWN.format(0)}\n{NOTE}", 0) for v in cleaned(spark, copies).values())
    assert all(out[100 + i] == (f"{OWN.format(100 + i)}\nThe.", 0) for i in range(9))
    assert out[200] == (None, 0) and out[201] == ("", 0) and out[None] == ("", 1) and out[202] == ("\n" * 3, 0)
    assert all(out[300 + i] == (("word " * 200_000) + str(i), 1) for i in range(6))
    assert cleaned(spark, []) == {}


def test_repeated_rows_and_clashing_columns_stay(spark):
    rows = [(1, f"{OWN.format(i)}\n{NOTE}", f"s{i}", "kept", "kept") for i in range(5)] * 2
    out = line_dedup(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "source", "removed_lines", "line"] and out.count() == 10
    assert out.filter((F.col("removed_lines") == 1) & (F.col("line") == "kept")).count() == 10


def test_columns_of_any_name(spark):
    rows = [(f"{OWN.format(i)}\n{NOTE}", f"s{i}", 1, [2], "x", "y") for i in range(5)]
    frame = spark.createDataFrame(rows, "text string, source string, _key int, _bad array<int>, _line string, removed_lines string")
    out = line_dedup(frame, name="gone").collect()
    assert {tuple(r) for r in [(r.text, r._key, tuple(r._bad), r._line, r.removed_lines, r.gone) for r in out]} == {
        (OWN.format(i), 1, (2,), "x", "y", 1) for i in range(5)
    }


def test_copies_by_evidence(spark):
    pages = [(i, f"{OWN.format(i)}\n{NOTE}", f"s{i}", None, None) for i in range(5)]
    short = [(10, f"Own words.\n{NOTE}", "s1", None, None), (11, f"Other own words.\n{NOTE}", "s2", None, None)]
    exact = [(20 + i, f"{OWN.format('x')}\n{OWN.format('y')}\n{NOTE}", f"s{i}", None, None) for i in range(6)]
    near = [(30 + i, "\n".join(f"edit {i} of it" if k == i else OWN.format(f"n{k}") for k in range(7)), f"s{i}", None, None) for i in range(7)]
    passage = [(40 + i, f"{OWN.format('p')}\nA page of {i}.", f"s{i}", None, None) for i in range(5)]
    rows = pages + short + exact + near + passage
    out = cleaned(spark, rows)
    assert all(out[i] == (OWN.format(i), 1) for i in range(5))
    assert out[10] == ("Own words.", 1) and out[11] == ("Other own words.", 1)
    assert all(out[20 + i] == (f"{OWN.format('x')}\n{OWN.format('y')}", 1) for i in range(6))
    assert all(out[30 + i] == (near[i][1], 0) for i in range(7))
    assert all(out[40 + i] == (f"A page of {i}.", 1) for i in range(5))
    odd = [(200, None, "s1", None, None), (201, "", None, None, None), (202, "\n" * 3, "s", None, None)]
    assert cleaned(spark, odd) == {200: (None, 0), 201: ("", 0), 202: ("\n" * 3, 0)}
    assert cleaned(spark, []) == {}

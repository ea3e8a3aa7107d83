"""Quotation linking on hand-made threads and against the statement of the query."""

from pyspark.sql import functions as F

from dossierlake.llm import quotes as q

SCHEMA = "conv_id long, turn long, role string, text string"


def linked(spark, rows, **extra):
    frame = spark.createDataFrame(rows, SCHEMA)
    for name, value in extra.items():
        frame = frame.withColumn(name, value)
    found = q.conversations(frame, ["conv_id"]).collect()
    return {(r["row"]["conv_id"], r["row"]["turn"]): (r["content"], r["n_quoted"], r["reply_to"], r["thread"], r["depth"]) for r in found}


def test_threads(spark):
    rows = [
        (1, 0, "a", "Hello there.\nHow are you?"),
        (1, 1, "b", "> hello   THERE.\n> How are you?\nFine."),  # whole passage, other case and blanks
        (1, 2, "c", ">How are you?\nBusy"),  # one line of it
        (1, 3, "d", ">> Hello there.\n>> How are you?\n> Fine.\n\nGood!\n > > nested with blanks"),
        (1, 4, "e", "> nobody said this\nWhat?"),
        (1, 5, "f", "> Good!\n> unknown line\nThanks"),  # found line by line
        (1, 6, "g", "> Thanks"),  # nothing of its own
        (2, 1, "a", "> Hello there.\nother conversation"),
        (3, 5, "a", "> later\nx"), (3, 6, "a", "later"),  # only earlier messages are originals
    ]
    got = linked(spark, rows, scope=F.lit("clash"), content=F.lit(1), levels=F.lit(2))
    assert got[1, 0] == ("Hello there.\nHow are you?", 0, None, 0, 0)
    assert got[1, 1] == ("Fine.", 2, 0, 0, 1)
    assert got[1, 2] == ("Busy", 1, 0, 0, 1)
    assert got[1, 3] == ("Good!", 4, 1, 0, 2)
    assert got[1, 4] == ("What?", 1, None, 4, 0)
    assert got[1, 5] == ("Thanks", 2, 3, 0, 3)
    assert got[1, 6] == ("", 1, 5, 0, 4)
    assert got[2, 1][2:] == (None, 1, 0) and got[3, 5][2:] == (None, 5, 0)


def test_partial_quotes(spark):
    """Lines that many messages hold do not decide, and paragraphs may be wrapped anew."""
    rows = [
        (1, 0, "a", "Hi all\nfirst matter\nThanks"), (1, 1, "b", "Hi all\nsecond matter\nmore on the second\nThanks"),
        (1, 2, "c", "> Hi all\n> second matter\n> [...]\n> Thanks\nagreed"),  # cut
        (1, 3, "d", "> Hi all\nhello\n> more on the second\nyes\n> Thanks\nwelcome"),  # answered line by line
        (2, 0, "a", "Short."), (2, 1, "b", "Dear all,\n\none two three four\nfive six seven\n\nYours"), (2, 2, "c", "> one two\n> three four five\n> six seven\nfine"),
        (3, 0, "a", "alpha\none"), (3, 1, "b", "beta\ntwo"), (3, 2, "c", "alpha\nbeta\nthree"), (3, 3, "d", "> alpha\n> beta\nboth"), (3, 4, "e", "> alpha\n> beta\nboth too"),
        (3, 5, "f", "alpha\nbeta\ngamma"), (3, 6, "g", "> alpha\n> beta\nonce more"), (3, 7, "h", "> alpha\n> beta\n> gamma\n> lost\nlast"),
        (4, 0, "a", "\n".join(["a footer that is long and stands in every message"] * 2)), (4, 1, "b", "yes\na footer that is long and stands in every message"),
        (4, 2, "c", "> yes\n> a footer that is long and stands in every message\n> cut\nok"),
    ]
    got = linked(spark, rows)
    want = {(1, 2): 1, (1, 3): 1, (2, 2): 1, (3, 3): 2, (3, 4): 2, (3, 6): 2, (3, 7): 5, (4, 2): 1}
    assert {k: v[2] for k, v in got.items()} == {(r[0], r[1]): want.get((r[0], r[1])) for r in rows}


def test_many_partial_quotes_of_what_many_hold(spark):
    rows = [(1, i, "a", ("> Hi\n> cut\n> Thanks\n" if i > 1 else "") + "Hi\nThanks" + ("" if i else " not yet")) for i in range(300)]
    got = linked(spark, rows)
    assert all(got[1, i][2] == (1 if i > 1 else None) for i in range(300))


def test_odd_rows(spark):
    rows = [(1, 0, "a", None), (1, 1, "a", ""), (None, 0, "a", "hi"), (None, 1, "b", "> hi\nyes"), (1, None, "a", "> hi"), (1, 2, "a", ">" * 50), (1, 3, "a", ">\n> \n"), (4, 0, "a", "long " * 20000), (4, 1, "b", "> " + "long " * 20000 + "\nok")]
    got = linked(spark, rows)
    assert got[None, 1] == ("yes", 1, 0, 0, 1) and got[4, 1] == ("ok", 1, 0, 0, 1)
    assert got[1, 0] == ("", 0, None, 0, 0) and got[1, None][2:] == (None, None, 0)
    assert q.conversations(spark.createDataFrame([], SCHEMA), ["conv_id"]).count() == 0


def test_repeated_rows(spark):
    rows = [(1, 0, "a", "one"), (1, 0, "a", "one"), (1, 1, "b", "> one\ntwo"), (1, 1, "b", "> one\ntwo")]
    found = q.conversations(spark.createDataFrame(rows, SCHEMA), ["conv_id"]).collect()
    assert len(found) == 4 and sorted(r["depth"] for r in found) == [0, 0, 1, 1]


def test_deep_thread(spark):
    rows = [(1, i, "a", (f"> message number {i - 1}\n" if i else "") + f"message number {i}") for i in range(100)]
    got = linked(spark, rows)
    assert all(got[1, i] == (f"message number {i}", int(i > 0), i - 1 if i else None, 0, i) for i in range(100))


def test_no_python(spark):
    plan = q.conversations(spark.createDataFrame([(1, 0, "a", "x")], SCHEMA), ["conv_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

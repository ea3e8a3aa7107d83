"""Chat formatting by quotation linking, in DataFrame operations only.

Lines of a message have a quote level, the number of marks before them. Runs of lines of one level are passages. Passages are
normalised and hashed; a quoted passage belongs to the earliest message of its conversation whose own words hold it. A passage
that is cut or broken up belongs to the message that holds most of it. What a message quotes at the lowest level it replies to. Replies give threads, and messages are returned without what they quote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.llm.common import SPACE, SPACE_RUN, ascii_lower, stored, table

#: Marks of quoted lines, with blanks before or between them.
MARKS = r"^(?:[ \t]*>)+"
PARAGRAPH_END = r"\n(?:[\x20\x09\x0B-\x0D]*\n)+"
MOST_ROUNDS = 64


def normalised(passage: Column) -> Column:
    return F.regexp_replace(F.btrim(ascii_lower(passage), F.lit(SPACE)), SPACE_RUN, " ")


def _scope(columns: list[str], messages: DataFrame) -> Column:
    """One text for the values of a conversation's columns, never null and different for different values."""
    parts = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in (messages[f"`{n}`"] for n in columns)]
    return F.concat_ws(",", *parts)


def _parsed(messages: DataFrame, scope: list[str], turn_col: str, text_col: str) -> DataFrame:
    """``row``, ``scope``, ``turn``, ``bodies`` and ``levels`` of the lines, and ``own``, the lines that are not quoted."""
    base = messages.select(
        F.struct(*[messages[f"`{c}`"] for c in messages.columns]).alias("row"), _scope(scope, messages).alias("scope"), messages[f"`{turn_col}`"].cast("long").alias("turn"),
        F.split(F.coalesce(messages[f"`{text_col}`"], F.lit("")), "\n", -1).alias("lines"),
    )
    marks = base.withColumn("marks", F.transform("lines", lambda line: F.regexp_extract(line, MARKS, 0)))
    levels = F.transform("marks", lambda m: F.length(F.translate(m, " \t", "")))
    bodies = F.transform(F.arrays_zip("lines", "marks"), lambda x: F.substring(x["lines"], F.length(x["marks"]) + 1, F.length(x["lines"])))
    both = marks.select("row", "scope", "turn", bodies.alias("bodies"), levels.alias("levels"))
    own = F.transform(F.filter(F.arrays_zip("bodies", "levels"), lambda x: x["levels"] == 0), lambda x: x["bodies"])
    return both.withColumn("own", own)


def _passages() -> Column:
    """Runs of lines of one level: level, first line and text."""
    size = F.size("levels")
    starts = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get("levels", i) != F.get("levels", i - 1)))
    ends = F.concat(F.slice(F.col("starts"), 2, F.greatest(F.size("starts"), F.lit(1))), F.array(size))
    with_ends = F.transform(F.arrays_zip(F.col("starts"), ends.alias("ends")), lambda x: F.struct(F.get("levels", x["starts"]).alias("level"), x["starts"].alias("start"), F.slice("bodies", x["starts"] + 1, x["ends"] - x["starts"]).alias("lines")))
    return starts, with_ends


def _paragraphs(lines: Column) -> Column:
    """Lines between blank ones, as one text each."""
    return F.split(F.array_join(lines, "\n"), PARAGRAPH_END)


def _hashed(keys: DataFrame) -> DataFrame:
    """Two hashes of ``passage`` and its length in its place; passages without words are left out."""
    worded = keys.withColumn("passage", normalised(F.col("passage"))).filter("passage <> ''")
    return worded.withColumn("h1", F.xxhash64("passage")).withColumn("h2", F.xxhash64(F.lit(1), "passage")).withColumn("chars", F.length("passage").cast("long")).drop("passage")


def replies(parsed: DataFrame) -> DataFrame:
    """``scope``, ``turn`` and ``reply_to`` of the messages that quote an earlier one."""
    whole = lambda lines: F.array_join(lines, "\n")
    # Whole runs are looked for among whole texts and lines; only parts of runs also among paragraphs.
    kinds = lambda full, passages: F.transform(passages, lambda p: F.struct(F.lit(full).alias("full"), p.alias("passage")))
    forms = F.concat(kinds(True, F.array_distinct(F.concat("own", F.array(whole("own"))))), kinds(False, F.array_distinct(_paragraphs("own"))))
    own = _hashed(parsed.filter("turn is not null").select("scope", "turn", F.explode(forms).alias("f")).select("scope", "turn", "f.full", "f.passage"))
    own = stored(own.groupBy("scope", "h1", "h2", "turn").agg(F.max("full").alias("full")), "own-passages")
    first = stored(own.groupBy("scope", "h1", "h2").agg(F.min(F.when(F.col("full"), F.col("turn"))).alias("original"), F.min("turn").alias("earliest"), F.count("*").alias("holders")), "originals")
    starts, passages = _passages()
    cut = parsed.filter("turn is not null and exists(levels, x -> x > 0)").withColumn("starts", starts).select("scope", "turn", passages.alias("runs"))
    alone = lambda p: F.size(F.filter("runs", lambda o: o["level"] == p["level"])) == 1
    runs = cut.select("scope", "turn", F.explode(F.transform(F.filter("runs", lambda p: p["level"] > 0), lambda p: F.struct(p.alias("p"), alone(p).alias("alone")))).alias("r"))
    runs = runs.select("scope", "turn", "r.p.level", "r.alone", "r.p.lines")
    parts = F.array_distinct(F.concat(F.array(whole("lines")), _paragraphs("lines"), "lines"))
    forms = F.concat(F.transform(F.filter(F.array(whole("lines")), lambda _: F.col("alone")), lambda p: F.struct(F.lit(0).alias("part"), p.alias("passage"))), F.transform(parts, lambda p: F.struct(F.lit(1).alias("part"), p.alias("passage"))))
    quoted = _hashed(runs.select("scope", "turn", "level", F.explode(forms).alias("f")).select("scope", "turn", "level", "f.part", "f.passage"))
    linked = quoted.join(first, ["scope", "h1", "h2"]).withColumn("original", F.when(F.col("part") == 0, F.col("original")).otherwise(F.col("earliest"))).filter("original < turn")
    linked = stored(linked.select("scope", "turn", "level", "part", "h1", "h2", "chars", "original", "holders").distinct(), "linked")
    best = stored(linked.groupBy("scope", "turn").agg(F.min(F.struct("level", "part", "original")).alias("best")).select("scope", "turn", "best.*"), "best")
    entire = best.filter("part = 0").select("scope", "turn", F.col("original").alias("reply_to"))
    partial = linked.filter("part = 1").join(best.filter("part = 1").select("scope", "turn", "level"), ["scope", "turn", "level"], "left_semi")
    return entire.unionByName(_by_parts(stored(partial.select("scope", "turn", "h1", "h2", "chars", "original", "holders"), "parts"), own))


def _by_parts(parts: DataFrame, own: DataFrame) -> DataFrame:
    """``reply_to`` of messages whose quotes are known only in ``parts``: what holds their rarest part, and most characters of all.

    A message that is quoted holds every part of the quote, so it is among the holders of the rarest. They are compared once
    for each different set of parts, however many messages quote it; the earliest of equals is chosen.
    """
    part = F.struct("holders", (-F.col("chars")).alias("less"), "h1", "h2", "original")
    sets = stored(parts.groupBy("scope", "turn").agg(F.bit_xor("h1").alias("s1"), F.bit_xor("h2").alias("s2"), F.count("*").alias("n"), F.min(part).alias("rarest")), "part-sets")
    plain = (F.col("n") == 1) | (F.col("rarest.holders") == 1)
    clear = sets.filter(plain).select("scope", "turn", F.col("rarest.original").alias("reply_to"))
    open_ = sets.filter(~plain)
    asked = stored(open_.groupBy("scope", "s1", "s2").agg(F.min(F.struct("turn", "rarest.h1", "rarest.h2")).alias("one")).select("scope", "s1", "s2", "one.*"), "asked-sets")
    holders = asked.join(own.withColumnRenamed("turn", "holder"), ["scope", "h1", "h2"]).select("scope", "s1", "s2", "turn", "holder")
    pairs = holders.join(parts.select("scope", "turn", "h1", "h2", "chars"), ["scope", "turn"])
    held = pairs.join(own.select("scope", "h1", "h2", F.col("turn").alias("holder")), ["scope", "h1", "h2", "holder"])
    score = held.groupBy("scope", "s1", "s2", "holder").agg(F.sum("chars").alias("score"))
    steps = score.groupBy("scope", "s1", "s2", "score").agg(F.min("holder").alias("holder"))  # as many as there are different scores
    chosen = open_.select("scope", "s1", "s2", "turn").join(steps, ["scope", "s1", "s2"]).filter("holder < turn")
    return clear.unionByName(chosen.groupBy("scope", "turn").agg(F.min(F.struct((-F.col("score")).alias("less"), "holder")).alias("best")).select("scope", "turn", F.col("best.holder").alias("reply_to")))


def threads(answers: DataFrame) -> DataFrame:
    """``scope``, ``turn``, ``reply_to``, ``thread`` (the first message reached by replies) and ``depth`` of each reply.

    Every round doubles how far a message sees, so rounds number the logarithm of the deepest thread. Messages that see the
    first one leave the rounds; those still looking use what they have found.
    """
    active = stored(answers.withColumn("thread", F.col("reply_to")).withColumn("depth", F.lit(1).cast("long")), "replies")
    done = active.limit(0)
    for _ in range(MOST_ROUNDS):
        above = active.unionByName(done).select("scope", F.col("turn").alias("thread"), F.col("thread").alias("higher"), F.col("depth").alias("more"))
        looked = stored(
            active.join(above, ["scope", "thread"], "left").select(
                "scope", "turn", "reply_to", F.coalesce("higher", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("more").isNotNull().alias("moved")
            ),
            "threads",
        )
        done = done.unionByName(looked.filter("not moved").drop("moved"))
        active = looked.filter("moved").drop("moved")
        if active.isEmpty():
            return done
    raise RuntimeError("a thread is too deep")


def conversations(messages: DataFrame, scope: list[str], turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """One row per row of ``messages``: ``row``, ``content``, ``n_quoted``, ``reply_to``, ``thread`` and ``depth``.

    ``content`` is the text without quoted lines and without white space at its ends. Sorted by ``scope``, ``thread`` and turn,
    each message follows what it replies to. A message that quotes nothing known has no ``reply_to``, is its own thread and
    has depth 0. Null and empty texts have empty content. Rows that share conversation and turn share what they reply to. A null
    turn is neither quoted nor a reply; a null conversation is one of its own. Passages are told apart by 128 bits of hash.
    A passage is found as a whole own text or one line of it. A quoted run that is neither, and several runs of one level, are
    looked for by runs, paragraphs (also wrapped anew) and lines; a part of a paragraph is not found once it is wrapped anew.
    """
    parsed = _parsed(messages, scope, turn_col, text_col)
    found = threads(replies(parsed.select("scope", "turn", "bodies", "levels", "own")))
    content = F.btrim(F.array_join("own", "\n"), F.lit(SPACE))
    plain = parsed.select("row", "scope", "turn", content.alias("content"), F.size(F.filter("levels", lambda x: x > 0)).cast("long").alias("n_quoted"))
    return plain.join(found, ["scope", "turn"], "left").select(
        "row", "content", "n_quoted", "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth")
    )


def as_mail(messages: DataFrame) -> DataFrame:
    """Conversations as mail: each message quotes the one before it, and above it the one before that, a level deeper."""
    texts = messages.groupBy("conv_id", "turn").agg(F.min("text").alias("before"))
    one, two = (texts.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("before").alias(f"before{n}")) for n in (1, 2))
    quoted = lambda mark, name: F.concat(F.lit(mark), F.regexp_replace(F.col(name), "\n", f"\n{mark}"))
    joined = messages.join(one, ["conv_id", "turn"], "left").join(two, ["conv_id", "turn"], "left")
    return joined.select("conv_id", "turn", "role", F.concat_ws("\n", quoted(">> ", "before2"), quoted("> ", "before1"), "text").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, as they are and as mail that quotes."""
    plain = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = plain.withColumn("form", F.lit("plain")).unionByName(as_mail(plain).withColumn("form", F.lit("mail")))
    done = conversations(stored(both, "messages"), ["form", "conv_id"])
    return done.select("row.form", "row.conv_id", "row.turn", "row.role", "content", "n_quoted", "reply_to", "thread", "depth")


ORACLE_SQL = r"""
WITH RECURSIVE plain AS (SELECT conv_id, turn, role, text FROM conversations),
mail AS (
  SELECT m.conv_id, m.turn, m.role, concat_ws(chr(10), '>> ' || replace(b.text, chr(10), chr(10) || '>> '), '> ' || replace(a.text, chr(10), chr(10) || '> '), m.text) AS text
  FROM plain m LEFT JOIN plain a ON a.conv_id = m.conv_id AND a.turn = m.turn - 1 LEFT JOIN plain b ON b.conv_id = m.conv_id AND b.turn = m.turn - 2),
messages AS (SELECT 'plain' AS form, * FROM plain UNION ALL SELECT 'mail', * FROM mail),
split_up AS (SELECT form, conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM messages),
marked AS (SELECT *, regexp_extract(line, '^(?:[ \t]*>)+') AS marks FROM split_up),
lines AS (SELECT form, conv_id, turn, pos, length(regexp_replace(marks, '[ \t]', '', 'g')) AS level, substr(line, length(marks) + 1) AS body FROM marked),
runs AS (
  SELECT *, pos - row_number() OVER (PARTITION BY form, conv_id, turn, level ORDER BY pos) AS run FROM lines),
quoted AS (
  SELECT form, conv_id, turn, level, min(pos) OVER w AS start, 1 AS part, body AS passage FROM runs WHERE level > 0 WINDOW w AS (PARTITION BY form, conv_id, turn, level, run)
  UNION ALL
  SELECT form, conv_id, turn, level, min(pos), 0, string_agg(body, chr(10) ORDER BY pos) FROM runs WHERE level > 0 GROUP BY form, conv_id, turn, level, run),
own AS (
  SELECT form, conv_id, turn, body AS passage FROM lines WHERE level = 0
  UNION ALL SELECT form, conv_id, turn, string_agg(body, chr(10) ORDER BY pos) FROM lines WHERE level = 0 GROUP BY ALL),
firsts AS (SELECT form, conv_id, trim(regexp_replace(lower(passage), '[\x20\x09-\x0D]+', ' ', 'g')) AS key, min(turn) AS original FROM own GROUP BY ALL),
links AS (
  SELECT q.form, q.conv_id, q.turn, min(struct_pack(level := q.level, part := q.part, start := q.start, original := f.original)) AS best
  FROM quoted q JOIN firsts f ON f.form = q.form AND f.conv_id = q.conv_id AND f.key = trim(regexp_replace(lower(q.passage), '[\x20\x09-\x0D]+', ' ', 'g'))
  WHERE f.original < q.turn AND f.key <> '' GROUP BY ALL),
reply AS (SELECT form, conv_id, turn, best.original AS reply_to FROM links),
thread AS (
  SELECT form, conv_id, turn, reply_to AS root, 1 AS depth FROM reply
  UNION ALL SELECT t.form, t.conv_id, t.turn, r.reply_to, t.depth + 1 FROM thread t JOIN reply r ON r.form = t.form AND r.conv_id = t.conv_id AND r.turn = t.root),
deepest AS (SELECT form, conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM thread GROUP BY ALL),
texts AS (
  SELECT form, conv_id, turn, trim(coalesce(string_agg(body, chr(10) ORDER BY pos) FILTER (WHERE level = 0), ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS content,
         count(*) FILTER (WHERE level > 0) AS n_quoted
  FROM lines GROUP BY ALL)
SELECT m.form, m.conv_id, m.turn, m.role, x.content, x.n_quoted, r.reply_to::BIGINT AS reply_to, coalesce(d.root, m.turn)::BIGINT AS thread, coalesce(d.depth, 0)::BIGINT AS depth
FROM messages m JOIN texts x USING (form, conv_id, turn) LEFT JOIN reply r USING (form, conv_id, turn) LEFT JOIN deepest d USING (form, conv_id, turn)
"""

"""Reply-ordered conversations from messages that quote one another.

A line's quote level is the number of ``>`` it begins with; successive lines of one level are a passage. The own
text of a message is what it does not quote. Own texts, their passages and paragraphs are normalised (case, white
space) and hashed, and so are quoted passages and their paragraphs. Within a conversation, a quoted hash
leads to the first message that has it as its own; the message replies to the one it quotes at the
lowest level, the latest of several. Only whole passages, whole own texts and whole paragraphs count: a quoted line or
sentence of a longer paragraph, or one with an ellipsis, leads nowhere. Without such a link it replies to the turn before, if there is one.
Threads and depths follow from the parents by doubling: each round joins the messages that have not reached the
top of their thread with the ancestor found so far, so a thread of n messages takes about log2(n) rounds.

Rows with a null conversation or turn have no parent and are threads of their own; a null text is an empty one
and quotes nothing. Repeated (conv_id, turn) rows are one message with several texts: each row keeps its own
text, and all get the same parent. Blank passages link to nothing. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelens.operators.staging import staged

MARKS = r"^(?:[ \t]*>)+"
SPACE = r"[ \t\n\x0B\f\r]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), SPACE, " "))


def passages(text: Column) -> Column:
    """Array of (level, text): successive lines of one quote level, marks taken off."""
    lines = F.transform(
        F.split(F.coalesce(text, F.lit("")), r"\r?\n", -1),
        lambda line: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", "")).alias("level"),
            F.regexp_replace(line, MARKS, "").alias("body"),
        ),
    )

    def runs(lines: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(lines) - 1)
        starts = F.filter(
            numbers,
            lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]),
        )
        return _let(starts, lambda starts: F.transform(starts, lambda s, k: run(lines, starts, s, k)))

    def run(lines: Column, starts: Column, start: Column, k: Column) -> Column:
        end = F.coalesce(F.get(starts, k + 1), F.size(lines))
        bodies = F.transform(F.slice(lines, start + 1, end - start), lambda line: line["body"])
        return F.struct(
            F.get(lines, start)["level"].alias("level"), F.array_join(bodies, "\n").alias("text")
        )

    return _let(lines, runs)


def _keys(text: Column) -> Column:
    """Hashes of a passage and of its paragraphs."""
    parts = F.concat(F.array(text), F.split(text, r"\n[ \t]*\n", -1))
    kept = F.filter(F.transform(parts, normal), lambda part: part != "")
    return F.array_distinct(F.transform(kept, F.md5))


def parsed(messages: DataFrame) -> DataFrame:
    """Each message with its own text, its own hashes and those of each quoted passage."""
    runs = messages.select("conv_id", "turn", "role", passages(F.col("text")).alias("runs"))
    own = F.filter("runs", lambda run: run["level"] == 0)
    own_text = F.array_join(F.transform(own, lambda run: run["text"]), "\n")
    own_keys = F.flatten(F.transform(own, lambda run: _keys(run["text"])))
    quotes = F.filter("runs", lambda run: run["level"] > 0)
    return runs.select(
        "conv_id",
        "turn",
        "role",
        F.regexp_replace(own_text, f"^{SPACE}|{SPACE}$", "").alias("text"),
        F.array_distinct(F.concat(own_keys, _keys(own_text))).alias("own_keys"),
        F.transform(
            quotes,
            lambda run: F.struct(run["level"].alias("level"), _keys(run["text"]).alias("keys")),
        ).alias("quotes"),
    )


def quote_links(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, linked_turn, n_linked) of the messages with a quote that leads somewhere."""
    originals = (
        rows.select("conv_id", "turn", F.explode("own_keys").alias("key"))
        .groupBy("conv_id", "key")
        .agg(F.min("turn").alias("linked_turn"))
    )
    quoted = (
        rows.select("conv_id", "turn", F.posexplode("quotes").alias("passage", "quote"))
        .select("conv_id", "turn", "passage", "quote.level", F.explode("quote.keys").alias("key"))
        .join(originals, ["conv_id", "key"])
        .where("linked_turn < turn")
    )
    best = F.struct("level", (-F.col("linked_turn")).alias("late"))
    return (
        quoted.groupBy("conv_id", "turn", "passage")
        .agg(F.min(best).alias("best"))
        .groupBy("conv_id", "turn")
        .agg((-F.min("best")["late"]).alias("linked_turn"), F.count("*").alias("n_linked"))
    )


def threads(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_turn, depth) from (conv_id, turn, parent_turn), one row for a message.

    A parent's turn is smaller than that of its replies, so the doubling ends.
    """
    found = staged(
        parents.selectExpr(
            "conv_id",
            "turn",
            "coalesce(parent_turn, turn) AS thread_turn",
            "CAST(if(parent_turn IS NULL, 0, 1) AS long) AS depth",
            "parent_turn IS NULL AS done",
        )
    )
    while not found.where("NOT done").isEmpty():
        above = found.toDF("conv_id", "thread_turn", "further", "more", "last")
        moved = (
            found.where("NOT done")
            .join(above, ["conv_id", "thread_turn"])
            .select(
                "conv_id",
                "turn",
                F.col("further").alias("thread_turn"),
                (F.col("depth") + F.col("more")).alias("depth"),
                F.col("last").alias("done"),
            )
        )
        found = staged(found.where("done").union(moved))
    return found.drop("done")


def conversations(messages: DataFrame) -> DataFrame:
    """Every message without quotes, with the turn it replies to and its place in a thread.

    (conv_id, turn, role, text, parent_turn, thread_turn, depth, n_quotes, n_linked). Within a thread, the
    order of (depth, turn) puts each reply after what it replies to.
    """
    rows = staged(parsed(messages))
    known = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn").distinct()
    before = known.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("before"))
    parents = staged(
        known.join(before, ["conv_id", "turn"], "left")
        .join(quote_links(rows), ["conv_id", "turn"], "left")
        .select(
            "conv_id",
            "turn",
            F.coalesce("linked_turn", "before").alias("parent_turn"),
            F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        )
    )
    placed = parents.join(threads(parents), ["conv_id", "turn"])
    return rows.join(placed, ["conv_id", "turn"], "left").select(
        "conv_id",
        "turn",
        "role",
        "text",
        "parent_turn",
        F.coalesce("thread_turn", "turn").alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.size("quotes").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
    )

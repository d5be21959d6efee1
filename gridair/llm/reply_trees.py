"""Chat formatting from reply trees (operator 11).

Messages name the message they answer.  Joins of a table with itself double the stretch known of each way to the root
(parents, grandparents, ancestors four up ...), so a tree of depth d takes about log2(d) rounds, whatever its shape.
Leaves are ranked by the mean score of their way, the same joins list the ways of the chosen leaves, and each of them
is written as one conversation with the character ranges that are under the loss.

The template marks a turn as ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed.  Inside
texts every ``<``, backslashes, ``|`` gets one backslash more, so that no text holds a mark and reading takes it away
again.  In roles backslash, line feed and ``|`` are written ``\\\\``, ``\\n`` and ``\\p``.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridair.llm.common import written

START, END, LEARNT = "<|im_start|>", "<|im_end|>", "assistant"
#: Characters of a conversation after which a new part begins.
PART = 1 << 20
_MARK, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_ROLE, _ROLE_BACK = {"\\": r"\\", "\n": r"\n", "|": r"\p"}, {"\\": "\\", "n": "\n", "p": "|"}


def escape(text: str) -> str:
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return "".join(_ROLE.get(c, c) for c in role)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ROLE_BACK[m[1]], role)


def ways(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(id, root, depth, total) of every message of ``links`` (id, parent, score) that has a root, and the ancestor tables of the rounds.

    The k-th table has (id, up): the ancestor 2**k steps up.  ``total`` is the sum of the scores from the message to the
    root.  Messages in a circle of answers, or below one, have no root: they stay open for ever and are left out once
    the ways that are left grow longer than the table.
    """
    now = written(links.select("id", F.col("parent").alias("up"), F.col("id").alias("last"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("total")), "ways")
    jumps, most, k = [], now.count(), 0
    while True:
        open_ = now.where("up is not null")
        if open_.isEmpty() or 1 << k > 2 * most:
            break
        jumps.append(open_.select("id", "up"))
        up = now.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("last").alias("_last"), F.col("steps").alias("_steps"), F.col("total").alias("_total"))
        longer = open_.join(up, "up").select("id", F.col("_up").alias("up"), F.col("_last").alias("last"), (F.col("steps") + F.col("_steps")).alias("steps"), (F.col("total") + F.col("_total")).alias("total"))
        now = written(now.where("up is null").unionByName(longer), "ways")
        k += 1
    return now.where("up is null").select("id", F.col("last").alias("root"), F.col("steps").alias("depth"), "total"), jumps


def paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(root, leaf, rank, id, place) of every message on the ``top`` best ways of every tree.

    ``messages`` has (id, parent, score).  Ways are ranked by their messages' mean score, ties by the smaller leaf.
    ``place`` counts from 0 at the root.
    """
    known = messages.select(F.col("id").alias("parent"))
    links = messages.select("id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    # A parent that is no message of the table makes its child a root.
    rooted = links.where("parent is not null and parent <> id").join(known, "parent", "left_semi").select("id", "parent")
    links = written(links.select("id", "score").join(rooted, "id", "left"), "links")
    reached, jumps = ways(links)
    leaves = reached.join(links.select(F.col("parent").alias("id")).where("id is not null").distinct(), "id", "left_anti")
    best = Window.partitionBy("root").orderBy(F.desc(F.col("total") / F.col("depth")), "id")
    chosen = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    chosen = written(chosen.select("root", F.col("id").alias("leaf"), "rank", "id", (F.col("depth") - 1).alias("place")), "chosen")
    found = [chosen]
    for k, jump in enumerate(jumps):
        all_ = found[0]
        for part in found[1:]:
            all_ = all_.unionByName(part)
        found.append(written(all_.join(jump, "id").select("root", "leaf", "rank", F.col("up").alias("id"), (F.col("place") - (1 << k)).alias("place")), "chosen"))
    for part in found[1:]:
        chosen = chosen.unionByName(part)
    return chosen


def conversations(messages: DataFrame, top: int = 1, carry: str = "conv_id") -> DataFrame:
    """The written conversations: (leaf, rank, ``carry``, part, text, n_chars, learnt), a row for each part in order.

    ``messages`` has (id, parent, score, role, text, ``carry``); rows of one id are one message (the first by its
    columns), rows without an id are none.  A null role or text is empty, a null score is 0.  ``learnt`` lists the
    ranges [from, to) of code points of the whole conversation that are an assistant's text.  A conversation of any
    length is written as a stream of parts of about ``PART`` characters, cut between turns.  Messages in a circle of
    answers have no root and are in no conversation.  An empty table gives none; other columns are not read.
    """
    one = messages.where("id is not null").select("id", "parent", "score", "role", "text", F.col(carry).alias("carried"))
    first = Window.partitionBy("id").orderBy("parent", "score", "role", "text", "carried")
    one = written(one.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n"), "messages")
    placed = paths(one, top).join(one.select("id", "role", "text", "carried"), "id")
    rows = placed.repartition("leaf").sortWithinPartitions("leaf", "place").select("leaf", "rank", "carried", "role", "text")
    kind = dict((f.name, f.dataType) for f in rows.schema)
    out = f"leaf {kind['leaf'].simpleString()}, rank int, carried {kind['carried'].simpleString()}, part int, text string, n_chars long, learnt array<struct<low:long,high:long>>"

    def write(batches):
        leaf, held, done = None, [], []
        head, part, at, size, spans = None, 0, 0, 0, []

        def close():
            nonlocal held, part, size, spans
            done.append((*head, part, "".join(held), at, spans))
            held, part, size, spans = [], part + 1, 0, []
        for batch in batches:
            for this, rank, carried, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if head is None or this != leaf:
                    if held:
                        close()
                    leaf, head, part, at = this, (this, rank, carried), 0, 0
                elif size >= PART:
                    close()
                begin, body = f"{START}{escape_role(role or '')}\n", escape(text or "")
                if role == LEARNT:
                    spans.append({"low": at + len(begin), "high": at + len(begin) + len(body)})
                held.append(f"{begin}{body}{END}\n")
                at += len(held[-1])
                size += len(held[-1])
            if done:
                yield _batch(done, schema)
                done.clear()
        if held:
            close()
        if done:
            yield _batch(done, schema)
    schema = _arrow(rows, out)
    return written(rows.mapInArrow(write, out).withColumnRenamed("carried", carry), "conversations")


def _arrow(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def turns(text: str) -> list[tuple[str, str]]:
    """The (role, text) of every turn of a part, as they were before they were written."""
    return [(unescape_role(role), unescape(body)) for role, body in _TURN.findall(text)]


def digest(files: DataFrame, carry: str = "conv_id") -> DataFrame:
    """Read conversations back: (``carry``, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), a row for each.

    Parts are read as a stream in order, so no task holds a conversation.
    """
    rows = files.repartition("leaf").sortWithinPartitions("leaf", "part").select("leaf", F.col(carry).alias("carried"), "text", F.col("learnt.low"), F.col("learnt.high"))
    out = f"carried {rows.schema['carried'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    schema = _arrow(rows, out)

    def read(batches):
        leaf, head, said, learnt, n, chars, size, done = None, None, None, None, 0, 0, 0, []

        def close():
            done.append((head[0], n, said.hexdigest(), chars, learnt.hexdigest(), size))
        for batch in batches:
            for this, carried, text, low, high in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if head is None or this != leaf:
                    if head is not None:
                        close()
                    leaf, head, said, learnt, n, chars, size = this, (carried,), hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for role, body in turns(text):
                    said.update(f"{role}\n{body}\n".encode())
                    n += 1
                for a, b in zip(low, high, strict=True):
                    plain = unescape(text[a - size:b - size])
                    learnt.update(plain.encode())
                    chars += len(plain)
                size += len(text)
            if done:
                yield _batch(done, schema)
                done.clear()
        if head is not None:
            close()
            yield _batch(done, schema)
    return rows.mapInArrow(read, out).withColumnRenamed("carried", carry)


def chains(rows: DataFrame) -> DataFrame:
    """Messages (id, parent, score, role, text, conv_id) of linear conversations (conv_id, turn, role, text): each turn answers the one before.

    Turns of the same number follow by role and text, nulls first; a null conv_id is a conversation of its own.  The
    score is the length of the text.
    """
    from gridair.llm.common import ranked
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("-"))
    named = rows.select(key.alias("chain"), "conv_id", F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.lit(1).alias("one"))
    placed = ranked(named, ["chain"], ["turn", "role", "text"], "one", "n")
    id_ = lambda n: F.concat_ws(":", "chain", n.cast("string"))
    return placed.select(id_(F.col("n")).alias("id"), F.when(F.col("n") > 0, id_(F.col("n") - 1)).alias("parent"), F.length("text").alias("score"), "role", "text", "conv_id")

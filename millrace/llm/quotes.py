"""Chat formatting by quotation linking.

A message's lines are parsed into quote levels (``>``, ``> >``, ``>>`` ...).  Neighbouring lines of one level form a passage, whose words are normalised and strung
together, so that it doesn't matter where its lines were broken.  Passages are compared by hashes of their runs of ``RUN`` words, shorter ones whole; each run goes to the
latest earlier message of its conversation that holds it itself, found by ordered passes rather than by pairs, and a passage to the message
that accounts for most of its runs, at least half of them.  The message that accounts for most runs of the outermost passages is what a message replies to.
Messages linked by replies form threads; a conversation is listed thread by thread, originals before replies, without quotes.

No task takes in a whole conversation: the passes go by ``TURNS`` turns at a time and carry their last result on, and positions are numbered over sorted ranges.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.ranks import ranked
from millrace.llm.scratch import cut

#: Quote marks in front of a line.
MARKS = re.compile(r"^[ \t]{0,3}((?:>[ \t]?)+)")
#: A line that announces a quote; it goes with the quote that follows: a verb of writing, an address or a time of day, and a colon at the end.
ANNOUNCES = re.compile(r"^.{0,200}(?:\b(?:wrote|writes|schrieb|schreibt|a écrit|escribió|ha scritto|escreveu|schreef|skrev|napisał|написал)\b|@|\b\d{1,2}[:.h]\d{2}\b).{0,100}:\s*$", re.IGNORECASE)
#: Words of a run; turns of a pass.
RUN, TURNS = 4, 1024


def parse(text: str | None) -> list[tuple[int, str]]:
    """(quote level, line without its marks) of each line; announcements in front of a quote are left out."""
    out: list[tuple[int, str]] = []
    for line in (text or "").split("\n"):
        m = MARKS.match(line)
        level = m[1].count(">") if m else 0
        line = line[m.end() :] if m else line
        if level and out and out[-1][0] < level and ANNOUNCES.match(out[-1][1]):
            out.pop()
        out.append((level, line))
    return out


def normalised(line: str) -> list[str]:
    """Case folded words: runs of letters and digits."""
    return re.findall(r"\w+", line.casefold())


def passages(lines: list[tuple[int, str]]) -> list[tuple[int, list[str], list[list[str]]]]:
    """(level, words, words of each line) of neighbouring lines of one level; lines without words part passages."""
    out: list[tuple[int, list[str], list[list[str]]]] = []
    open_ = False
    for level, line in lines:
        own = normalised(line)
        if own and open_ and out[-1][0] == level:
            out[-1][1].extend(own)
            out[-1][2].append(own)
        elif own:
            out.append((level, list(own), [own]))
        open_ = bool(own)
    return out


def _hash(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63)


def runs(words: list[str]) -> set[int]:
    """Hashes of all runs of ``RUN`` words; of fewer words, of all."""
    return {_hash(words[i : i + RUN]) for i in range(max(1, len(words) - RUN + 1))}


def held(lines: list[tuple[int, str]]) -> set[int]:
    """Hashes that a message holds itself: of its own passages, and of short lines whole."""
    out: set[int] = set()
    for level, words, by_line in passages(lines):
        if not level:
            out |= runs(words)
            out.update(_hash(x) for x in by_line if len(x) < RUN)
    return out


def without_quotes(lines: list[tuple[int, str]]) -> str:
    own = "\n".join(line for level, line in lines if not level)
    return re.sub(r"\n{3,}", "\n\n", own).strip("\n") if any(level for level, _ in lines) else own


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each message's own text and its quoted passages as (level, number, hashes of runs); equal passages of a level count once."""
    item = pa.struct([("level", pa.int32()), ("passage", pa.int32()), ("runs", pa.list_(pa.int64()))])
    for b in batches:
        own, quoted = [], []
        for text in b.column("text").to_pylist():
            parsed = parse(text)
            own.append(None if text is None else without_quotes(parsed))
            found = {(level, tuple(words)) for level, words, _ in passages(parsed) if level}
            quoted.append([{"level": level, "passage": i, "runs": sorted(runs(list(words)))} for i, (level, words) in enumerate(sorted(found))])
        yield pa.record_batch([*(b.column(c) for c in ("uid", "conv", "turn", "role")), pa.array(own, pa.string()), pa.array(quoted, pa.list_(item)), b.column("text")], ["uid", "conv", "turn", "role", "own", "quoted", "whole"])


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hashes = [sorted(held(parse(t))) for t in b.column("whole").to_pylist()]
        yield pa.record_batch([*(b.column(c) for c in ("uid", "conv", "turn")), pa.array(hashes, pa.list_(pa.int64()))], ["uid", "conv", "turn", "runs"])


def _latest(rows: DataFrame) -> DataFrame:
    """Adds source: of the rows with level 0 and the same conv and hash, turn and uid of the latest whose turn is smaller."""
    rows = rows.withColumn("span", F.floor(F.col("turn") / TURNS))
    original = F.max(F.when(F.col("level") == 0, F.struct("turn", "uid")))
    here = original.over(Window.partitionBy("conv", "hash", "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    before = F.max("last").over(Window.partitionBy("conv", "hash").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    spans = rows.groupBy("conv", "hash", "span").agg(original.alias("last")).withColumn("earlier", before).where("earlier is not null").drop("last")
    return rows.withColumn("here", here).where("level > 0").join(spans, ["conv", "hash", "span"], "left").withColumn("source", F.coalesce("here", "earlier")).drop("here", "earlier", "span")


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each message: conv_col, turn_col, position, thread_turn, reply_to, n_quoted, n_linked, role_col, text and formatted.

    ``position`` counts from 1 in the conversation's reply order; ``thread_turn`` is the turn that began the thread, ``reply_to`` the turn replied to or null.
    ``n_quoted`` counts different quoted passages by level, ``n_linked`` those found in an earlier message.  A quote is only sought in messages with a smaller turn of the same
    conversation.  Messages without a conversation are each a conversation of their own; null turns come last and neither quote nor are quoted; equal
    turns keep a fixed order.  A null text stays null, an empty one empty; texts are read whole, however long.  Repeated rows are messages of their own.  Other columns are ignored.
    """
    src = messages.select(
        F.monotonically_increasing_id().alias("uid"), messages[conv_col].alias("conv"), messages[turn_col].cast("long").alias("turn"), messages[role_col].cast("string").alias("role"), messages[text_col].alias("text")
    )
    kind = src.schema["conv"].dataType.simpleString()
    read = cut(src.mapInArrow(_read, f"uid long, conv {kind}, turn long, role string, own string, quoted array<struct<level:int,passage:int,runs:array<long>>>, whole string"), "messages")
    placed = read.where("conv is not null and turn is not null")
    quoted = placed.select("uid", "conv", "turn", F.explode("quoted").alias("q")).select("uid", "conv", "turn", "q.level", "q.passage", F.explode("q.runs").alias("hash"))
    quoted = cut(quoted, "quoted")
    talking = placed.select("uid", "conv", "turn", "whole").join(quoted.select("conv").distinct(), "conv", "left_semi").select("uid", "conv", "turn", "whole")
    originals = talking.mapInArrow(_held, f"uid long, conv {kind}, turn long, runs array<long>").select("uid", "conv", "turn", F.explode("runs").alias("hash"))
    originals = originals.join(quoted.select("conv", "hash").distinct(), ["conv", "hash"], "left_semi")
    both = originals.select("uid", "conv", "turn", F.lit(0).alias("level"), F.lit(0).alias("passage"), "hash").unionByName(quoted)
    found = _latest(both)
    of_source = found.groupBy("uid", "level", "passage", "source").agg(F.count("*").alias("n"))
    per_passage = of_source.groupBy("uid", "level", "passage").agg(F.sum("n").alias("all"), F.max(F.when(F.col("source").isNotNull(), F.struct("n", "source"))).alias("best"))
    linked_to = cut(per_passage.withColumn("source", F.when(F.col("best.n") * 2 >= F.col("all"), F.col("best.source"))).withColumn("n", F.col("best.n")).drop("best"), "passages")
    counts = linked_to.groupBy("uid").agg(F.count("*").alias("n_quoted"), F.count("source").alias("n_linked"), F.min(F.when(F.col("source").isNotNull(), F.col("level"))).alias("outer"))
    outermost = linked_to.where("source is not null").join(counts.select("uid", "outer"), "uid").where("level = outer")
    votes = outermost.groupBy("uid", "source").agg(F.sum("n").alias("n"))
    parent = votes.groupBy("uid").agg(F.max(F.struct("n", "source")).alias("best")).select("uid", F.col("best.source.turn").alias("reply_to"), F.col("best.source.uid").alias("parent"))
    linked = cut(counts.join(parent, "uid", "left").select("uid", "n_quoted", "n_linked", "reply_to", "parent"), "replies")
    threads = components(linked.where("parent is not null").select(F.col("uid").alias("a"), F.col("parent").alias("b")))
    keys = read.select("uid", "conv", "turn").join(threads.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    first = keys.groupBy("root").agg(F.min("turn").alias("thread_turn"))
    keyed = keys.join(first, "root").withColumn("own_conv", F.when(F.col("conv").isNull(), F.col("uid")))
    place = [F.asc_nulls_last("thread_turn"), F.asc("root"), F.asc_nulls_last("turn"), F.asc("uid")]
    numbered = ranked(keyed, ["conv", "own_conv"], place, "uid", "position").join(keyed.select("uid", "thread_turn"), "uid")
    out = read.drop("quoted", "whole").join(numbered, "uid").join(linked, "uid", "left")
    return out.select(
        F.col("conv").alias(conv_col),
        F.col("turn").alias(turn_col),
        F.col("position").cast("int").alias("position"),
        "thread_turn",
        "reply_to",
        F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("role").alias(role_col),
        F.col("own").alias("text"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("own", F.lit("")), F.lit("<|end|>")).alias("formatted"),
    )

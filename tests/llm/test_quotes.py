import random
import re
import textwrap

import pytest

from millrace.llm import quotes
from millrace.llm.ranks import ranked


def test_levels_and_announcements():
    text = "Hello\nOn Monday Ann wrote:\n> > first\n> second\n>>third\nown"
    assert quotes.parse(text) == [(0, "Hello"), (2, "first"), (1, "second"), (2, "third"), (0, "own")]
    assert quotes.without_quotes(quotes.parse(text)) == "Hello\nown"
    assert quotes.parse(None) == [(0, "")] and quotes.normalised("  The, CAT!  ") == ["the", "cat"]
    for line in ("Am 3.4. um 10:15 schrieb Ann:", "<ann@example.org>:", "2024-01-02 10:33, Ann:", "Le lundi, Ann a écrit :"):
        assert quotes.parse(f"x\n{line}\n> y") == [(0, "x"), (1, "y")]
    assert quotes.parse("This is a list:\n> y") == [(0, "This is a list:"), (1, "y")]


def test_passages_join_lines_and_part_at_blanks():
    lines = quotes.parse("a b\nc\n\n> one two\n> three\n>\n> four\n>> five")
    assert [(level, words) for level, words, _ in quotes.passages(lines)] == [(0, ["a", "b", "c"]), (1, ["one", "two", "three"]), (1, ["four"]), (2, ["five"])]
    assert len(quotes.runs("a b c d e f".split())) == 3 and len(quotes.runs(["a"])) == 1


# ---- a version of its own, with lists and loops ------------------------------------------------------------------------------


def pieces(text):
    """(level, words, words of each line) of the passages of a text without announcements."""
    out, last = [], None
    for line in (text or "").split("\n"):
        level = 0
        while re.match(r"[ \t]{0,3}>" if level == 0 else r"[ \t]?>", line):
            line = line[line.index(">") + 1 :]
            level += 1
        own = re.findall(r"\w+", line.casefold())
        if own and last == level:
            out[-1][1].extend(own)
            out[-1][2].append(own)
        elif own:
            out.append((level, list(own), [own]))
        last = level if own else None
    return out


def grams(words):
    return {" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))}


def brute(rows):
    said = []
    for _, _, _, text in rows:
        own = set()
        for level, words, lines in pieces(text):
            if level == 0:
                own |= grams(words) | {" ".join(x) for x in lines if len(x) < 4}
        said.append(own)
    out = {}
    for conv, turn, _, text in rows:
        found = []
        quoted = {(level, tuple(words)) for level, words, _ in pieces(text) if level}
        for level, words in quoted:
            votes, asked = {}, grams(list(words))
            for g in asked:
                holders = [(rows[j][1], j) for j in range(len(rows)) if rows[j][0] == conv and rows[j][1] is not None and turn is not None and rows[j][1] < turn and g in said[j]]
                if holders:
                    votes[max(holders)] = votes.get(max(holders), 0) + 1
            if votes and turn is not None and conv is not None:
                best = max(votes, key=lambda v: (votes[v], v))
                if 2 * votes[best] >= len(asked):
                    found.append((level, best, votes[best]))
        outer = min((f[0] for f in found), default=None)
        total = {}
        for level, source, n in found:
            if level == outer:
                total[source] = total.get(source, 0) + n
        reply = max(total, key=lambda s: (total[s], s))[0] if total else None
        out[conv, turn] = (reply, len(quoted), len(found))
    return out


def make(seed, wrap):
    """Conversations in which messages quote earlier ones, with lines broken anew at ``wrap`` characters."""
    rnd = random.Random(seed)
    rows = []
    for conv in range(8):
        said = []
        for turn in range(rnd.randint(1, 14)):
            parts = []
            for old in rnd.sample(said, min(len(said), rnd.randint(0, 2))):
                level = "> " * rnd.choice([1, 1, 2])
                parts.append("\n".join(level + x for x in textwrap.wrap(old, wrap)))
            own = " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(rnd.choice([2, 3, 12, 40])))
            said.append(own)
            parts.append("\n".join(textwrap.wrap(own, 60)))
            rows.append((conv, turn * rnd.choice([1, 1, 700]), rnd.choice(["user", None]), "\n\n".join(parts)))
    return rows


@pytest.mark.parametrize("wrap", [25, 400])
def test_links_match_brute_force(spark, wrap):
    rows = list({(r[0], r[1]): r for r in make(4, wrap)}.values())
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, position string")
    out = quotes.link_quotes(df).collect()
    want = brute(rows)
    assert len(out) == len(rows)
    for r in out:
        assert (r.reply_to, r.n_quoted, r.n_linked) == want[r.conv_id, r.turn], r
        assert ">" not in r.text
    place = {(r.conv_id, r.turn): r.position for r in out}
    for r in out:
        if r.reply_to is not None:
            assert place[r.conv_id, r.reply_to] < r.position
    for conv in {r[0] for r in rows}:
        assert sorted(p for (c, _), p in place.items() if c == conv) == list(range(1, sum(r[0] == conv for r in rows) + 1))
    assert sum(r.reply_to is not None for r in out) > 20


def test_a_long_conversation_with_one_common_line(spark, monkeypatch):
    monkeypatch.setattr(quotes, "TURNS", 16)
    rows = [(1, t, "user", ("> thanks a lot for this\n" if t % 3 else "thanks a lot for this\n") + f"message number {t} here it is") for t in range(300)]
    out = {r.turn: r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all(out[t].reply_to == (t - t % 3 if t % 3 else None) for t in range(300))
    assert sorted(r.position for r in out.values()) == list(range(1, 301))


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, ""), (1, None, "user", "> hi"), (None, 0, "user", "hi"), (None, 1, "user", "> hi"), (1, 1, "user", "> > "), (2, 0, "user", "x " * 50_000), (2, 0, "user", "x " * 50_000), (3, 0, "user", "a b c d e\n" * 30_000), (3, 1, "user", "> a b c d e\n" * 30_000)]
    out = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(out) == len(rows) and all(r.reply_to is None for r in out if r.conv_id != 3)
    assert [r.reply_to for r in out if r.conv_id == 3 and r.turn == 1] == [0]
    assert sorted(r.position for r in out if r.conv_id == 1) == [1, 2, 3, 4] and [r.position for r in out if r.conv_id is None] == [1, 1]
    assert quotes.link_quotes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_ranks_run_on_over_tasks(spark):
    from pyspark.sql import functions as F

    rows = spark.range(5000).select("id", (F.col("id") % 3).alias("g"), F.when(F.col("id") % 3 > 0, F.lit(0)).otherwise(F.lit(1)).alias("h"), (-F.col("id")).alias("o"))
    out = {r.id: r.nth for r in ranked(rows.repartition(5), ["h"], [F.asc("o")], "id", "nth").collect()}
    for h in (True, False):
        own = sorted((i for i in range(5000) if (i % 3 == 0) == h), reverse=True)
        assert [out[i] for i in own] == list(range(1, len(own) + 1))

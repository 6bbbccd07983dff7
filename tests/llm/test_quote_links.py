"""Quotation linking against a per-conversation brute force."""

import itertools
import re
from collections import defaultdict

import numpy as np

from cohortspark.llm import quote_links as Q
from cohortspark.llm.queries import op9_quote_links


def plain_units(lines):
    """[(normalised text, set of word numbers)] of a block, written a second time: word by word with its line and sentence."""
    words, where = [], []                       # a word and its (paragraph, line, sentence)
    paragraph = sentence = 0
    for n, line in enumerate(lines):
        if not line.strip():
            paragraph, sentence = paragraph + 1, sentence + 1
            continue
        for m in re.finditer(r"([\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]|[^\W_\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]+)|([.!?\u2026]+[\"'\u2019\u201d\u00bb)\]]*(?=\s|$))|([\u3002\uff01\uff1f]+)", line):
            if m[1]:
                words.append(m[1].lower())
                where.append((paragraph, n, sentence))
            else:
                sentence += 1
    out = [(" ".join(words), set(range(len(words))))] if words else []
    for part in range(3):
        for key in dict.fromkeys(w[part] for w in where):
            at = {i for i, w in enumerate(where) if w[part] == key}
            if len(at) >= 4:
                out.append((" ".join(words[i] for i in sorted(at)), at))
    return out


def plain_parse(text):
    """Own text, own units, and {level: [(unit, word numbers)]}."""
    rows = []
    for line in text.split("\n"):
        line = line.rstrip("\r")
        level, rest = 0, line
        if re.match(r"[ \t]*>", line):
            marks = re.match(r"[ \t]*((>[ \t]?)+)", line)
            level, rest = marks[0].count(">"), line[marks.end():]
        rows.append((level, rest))
    groups = [(level, [r for _, r in g]) for level, g in itertools.groupby(rows, key=lambda r: r[0])]
    own, quotes, offset = [], defaultdict(list), defaultdict(int)
    for i, (level, lines) in enumerate(groups):
        if level:
            units = plain_units(lines)
            quotes[level] += [(u, {(offset[level], w) for w in at}) for u, at in units]
            offset[level] += 1
            continue
        filled = [j for j, x in enumerate(lines) if x.strip()]
        if i + 1 < len(groups) and filled and re.fullmatch(r"(On .+ wrote|Am .+ schrieb.*|Le .+ a écrit|El .+ escribió) ?:\s*", lines[filled[-1]].strip()):
            lines = lines[:filled[-1]] + lines[filled[-1] + 1:]
        own += lines
    clean = "\n".join(own)
    return clean.strip("\n") if any(level for level, _ in groups) else clean, {u for u, _ in plain_units(own)}, quotes


def brute(rows):
    """(conv, turn) -> clean text, parent, thread, depth by direct search over earlier messages."""
    parsed = {(c, t): plain_parse(x or "") for c, t, x in rows}
    convs = defaultdict(list)
    for c, t in parsed:
        convs[c].append(t)
    out = {}
    for c, turns in convs.items():
        for t in sorted(turns):
            clean, _, quotes = parsed[c, t]
            votes = defaultdict(set)
            for unit, at in quotes[1]:
                holders = [s for s in turns if unit in parsed[c, s][1]]
                if holders and min(holders) < t:
                    votes[min(holders)] |= at
            parent = max(votes, key=lambda s: (len(votes[s]), s)) if votes else None
            up = out.get((c, parent))
            out[c, t] = (clean, parent, t if up is None else up[2], 0 if up is None else up[3] + 1)
    return out


def archive(seed=1):
    rng, rows = np.random.default_rng(seed), []
    for c in range(12):
        texts = []
        for t in range(int(rng.integers(1, 14))):
            own = "\n".join(" ".join(f"w{rng.integers(50)}" for _ in range(int(rng.integers(2, 9)))) for _ in range(3))
            if texts and rng.random() < 0.7:
                p = texts[int(rng.integers(len(texts)))]
                own = "On Monday Ann wrote:\n" + "\n".join("> " + x for x in p.split("\n")) + "\n" + own
            texts.append(own)
            rows.append((c, t, own))
    return rows


def got_of(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, text string")
    return {(r.conv_id, r.turn): (r.clean_text, r.parent_turn, r.thread_turn, r.depth) for r in Q.link_quotes(df).collect()}


def test_equals_brute_force(spark):
    rows = archive()
    assert got_of(spark, rows) == brute(rows)
    assert any(v[3] > 1 for v in brute(rows).values())


def test_levels_rewrapping_and_cleaning(spark):
    rows = [(1, 0, "First line of it\nsecond line here"), (1, 1, "> first LINE\n> of it second line here!\n\nI agree."),
            (1, 2, "On Tue Bo wrote:\n> > First line of it\n> I agree.\n\nMe too"), (1, 3, "no quotes"), (1, 4, "> never written\nwhat?"),
            (2, 0, None), (2, 1, ">"), (2, 2, ""), (None, 0, "alone here"), (None, 1, "> alone here\nyes")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn int, text string, depth string")
    got = {(r.conv_id, r.turn): r for r in Q.link_quotes(df).collect()}
    assert len(got) == len(rows)
    assert (got[1, 1].clean_text, got[1, 1].parent_turn) == ("I agree.", 0)
    assert (got[1, 2].clean_text, got[1, 2].parent_turn, got[1, 2].thread_turn, got[1, 2].depth) == ("Me too", 1, 0, 2)
    assert [(x.level, x.original) for x in got[1, 2].links] == [(1, 1), (2, 0)] and got[1, 2].max_level == 2
    assert got[1, 3].links is None and got[1, 3].thread_turn == 3 and got[1, 4].parent_turn is None
    assert got[2, 0].clean_text == "" and got[2, 1].quoted_lines == 1 and got[None, 1].parent_turn == 0
    ordered = [(r.conv_id, r.turn) for r in Q.reply_ordered(Q.link_quotes(df.filter("conv_id = 1"))).collect()]
    assert ordered == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4)]


def test_repeated_rows_null_turns_long_chain_and_empty(spark):
    chain = [(7, i, f"message number {i}" + (f"\n> message number {i - 1}" if i else "")) for i in range(40)]
    rows = chain + [chain[3], (7, None, "> message number 0\nx"), (7, 99, "> message number 39\n" + "long " * 60_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, text string")
    got = Q.link_quotes(df).collect()
    assert len(got) == len(rows)
    by = {r.turn: r for r in got}
    assert all(by[i].depth == i and by[i].thread_turn == 0 for i in range(40)) and by[99].depth == 40
    assert by[None].parent_turn is None
    assert Q.link_quotes(df.limit(0)).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    src = spark.read.parquet(f"{sf}/conversations.parquet").toPandas()
    want = brute(list(zip(src.conv_id, src.turn, src.text)))
    got = {(r.conv_id, r.turn): (r.clean_text, r.parent_turn, r.thread_turn, r.depth) for r in op9_quote_links(spark, sf).collect()}
    assert got == want


def test_stock_lines_do_not_link_and_words_count_once(spark):
    """"Thanks." was written first by another message; the long line decides. A block quoted whole, by paragraph, line and
    sentence counts its words once."""
    rows = [(1, 0, "Thanks.\nUnrelated opening words of this one"), (1, 1, "Here is the longer answer you wanted.\nThanks."),
            (1, 2, "> Thanks.\n> Here is the longer answer you wanted.\nGreat"), (1, 3, "Thanks."), (1, 4, "> Thanks.\nSure"),
            (2, 0, "one two three four five six. seven eight nine ten eleven"), (2, 1, "> one two three four five six. seven eight nine ten eleven\nok")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, text string")
    got = {(r.conv_id, r.turn): r for r in Q.link_quotes(df).collect()}
    assert got[1, 2].parent_turn == 1 and got[1, 2].links[0].words == 7
    assert got[1, 4].parent_turn == 3            # a whole message, however short
    assert got[2, 1].links[0].words == 11
    assert {k: v[1] for k, v in brute(rows).items()} == {k: r.parent_turn for k, r in got.items()}

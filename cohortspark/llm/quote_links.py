"""Quotation linking: reply-ordered conversations without quotes.

Every message is parsed once into its own text and its quoted blocks with their nesting level
(the number of ``>`` marks). Passages (a whole block or message of any length, and of at least
``LEAST_WORDS`` words its paragraphs, its lines, and the sentences of its paragraphs, which a trimmed or
rewrapped quote still has) are normalised (case, marks and white space; rewrapped lines of a paragraph
do not matter) and hashed. So a stock line such as "Thanks." links nothing next to other quoted lines.
The original of a passage is the earliest message of the conversation that has it in its own
text: the hashes that are quoted at all are joined first, then one aggregation, then a many-to-one join on
(conversation, hash), so that a passage quoted or written by very many messages never makes pairs. A
message replies to the original that holds the most of its quoted level-1 words, each word counted once
however many of its passages match (ties: the later message); deeper levels are linked the same way. Threads (first message and depth) come from pointer doubling over the
links alone.

Defined cases: a NULL or empty text has no passages and no quotes; a line of marks alone is
quoted and empty; a passage that no earlier message wrote stays unlinked; repeated (conversation,
turn) rows are one message for linking and keep their rows; NULL conversations are one
conversation and NULL turns link nowhere; an empty table gives no rows; a long text is parsed
whole; other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import map_batches, stored, text_bytes

MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
# a word is a run of letters and digits; of scripts written without spaces every character
SINGLE = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
WORDS = re.compile(rf"[{SINGLE}]|[^\W_{SINGLE}]+")
LEAST_WORDS = 4
# ends of sentences, once the lines of a paragraph are joined
ENDS = re.compile(r"[.!?\u2026]+[\"'\u2019\u201d\u00bb)\]]*\s+|[\u3002\uff01\uff1f]+")
# fixed values: attribution lines in front of a quote
ATTRIBUTION = re.compile(r"(On .+ wrote|Am .+ schrieb.*|Le .+ a écrit|El .+ escribió) ?:\s*")


def quote_level(line: str) -> tuple[int, str]:
    """Nesting level of a line and the line without its marks."""
    m = MARKS.match(line)
    return (m[1].count(">"), line[m.end():]) if m else (0, line)


def blocks(text: str) -> list[tuple[int, list[str]]]:
    """Consecutive lines of equal level."""
    out: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        level, rest = quote_level(line.rstrip("\r"))
        if out and out[-1][0] == level:
            out[-1][1].append(rest)
        else:
            out.append((level, [rest]))
    return out


def passages(lines: list[str], at: int = 0) -> list[tuple[int, int, int]]:
    """(hash, first word, number of words) of the whole, its paragraphs, lines and sentences, after normalisation. Words are
    numbered from ``at`` on."""
    def unit(text: str) -> list[str]:
        return WORDS.findall(text.lower())

    out, whole = [], []

    def add(words: list[str], start: int, least: int) -> None:
        if len(words) >= least:
            out.append((xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63), start, len(words)))

    paragraph: list[str] = []
    for line in [*lines, ""]:
        if line.strip():
            words = unit(line)
            add(words, at + len(whole), LEAST_WORDS)
            whole += words
            paragraph.append(line)
        elif paragraph:
            n = len(unit("\n".join(paragraph)))
            add(whole[len(whole) - n:], at + len(whole) - n, LEAST_WORDS)
            start = at + len(whole) - n
            for sentence in ENDS.split("\n".join(paragraph)):
                words = unit(sentence)
                add(words, start, LEAST_WORDS)
                start += len(words)
            paragraph = []
    add(whole, at, 1)
    return out


def parse(text: str) -> tuple[str, int, int, set[int], set[tuple[int, int, int, int]]]:
    """Own text, quoted lines, deepest level, hashes of its own passages, quoted passages (level, hash, first word, words)."""
    parts = blocks(text)
    own: list[str] = []
    quoted: set[tuple[int, int, int, int]] = set()
    seen: dict[int, int] = {}
    for i, (level, lines) in enumerate(parts):
        if level:
            at = seen.get(level, 0)
            quoted |= {(level, *p) for p in passages(lines, at)}
            seen[level] = at + len(WORDS.findall("\n".join(lines)))
            continue
        if i + 1 < len(parts):
            last = max((j for j, x in enumerate(lines) if x.strip()), default=None)
            if last is not None and ATTRIBUTION.fullmatch(lines[last].strip()):
                lines = lines[:last] + lines[last + 1:]
        own += lines
    n = sum(len(x) for level, x in parts if level)
    clean = "\n".join(own)
    return (clean.strip("\n") if n else clean), n, max((level for level, _ in parts), default=0), {p[0] for p in passages(own)}, quoted


def parsed(df: DataFrame, conv: str, turn: str, text: str) -> DataFrame:
    """conv, turn, clean, quoted_lines, max_level, own (hashes), quotes (level, hash, start, words) of every row."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [parse(b.decode("utf-8", "replace")) for b in text_bytes(batch["text"])]
        quote = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("start", pa.int64()), ("words", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [batch["conv"], batch["turn"], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64()),
             pa.array([g[2] for g in got], pa.int32()), pa.array([sorted(g[3]) for g in got], pa.list_(pa.int64())),
             pa.array([[dict(zip(("level", "hash", "start", "words"), q)) for q in sorted(g[4])] for g in got], quote),
             *([batch["role"]] if "role" in batch.schema.names else [])],
            ["conv", "turn", "clean", "quoted_lines", "max_level", "own", "quotes"] + ["role"] * ("role" in batch.schema.names))

    src = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(text).alias("text"),
                    *([F.col("role")] if "role" in df.columns else []))
    kind = {c: src.schema[c].dataType.simpleString() for c in src.columns}
    schema = (f"conv {kind['conv']}, turn {kind['turn']}, clean string, quoted_lines bigint, max_level int, own array<bigint>, "
              "quotes array<struct<level: int, hash: bigint, start: bigint, words: bigint>>")
    return map_batches(src, run, schema + (f", role {kind['role']}" if "role" in kind else ""))


def quote_links(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, original, words): the best original of every message and quote level."""
    quotes = messages.filter("turn IS NOT NULL").select("conv", "turn", F.inline("quotes")).distinct()
    wanted = stored(quotes.select(F.col("conv").alias("c"), F.col("hash").alias("h")).distinct(), "quote-wanted")
    own = messages.filter("turn IS NOT NULL").select("conv", "turn", F.explode("own").alias("hash"))
    asked = own.join(wanted, F.col("conv").eqNullSafe(F.col("c")) & (F.col("hash") == F.col("h")), "left_semi")
    first = asked.groupBy("conv", "hash").agg(F.min("turn").alias("original")).select(
        F.col("conv").alias("oc"), F.col("hash").alias("oh"), "original")
    found = quotes.join(first, F.col("conv").eqNullSafe(F.col("oc")) & (F.col("hash") == F.col("oh"))
                        & (F.col("original") < F.col("turn")))
    # words of one message's matched passages, each word once: the union of their ranges
    ranges = F.array_sort(F.collect_set(F.struct(F.col("start"), (F.col("start") + F.col("words")).alias("stop"))))
    union = ("aggregate(ranges, named_struct('n', 0L, 'upto', 0L), (acc, r) -> named_struct("
             "'n', acc.n + greatest(0L, r.stop - greatest(acc.upto, r.start)), 'upto', greatest(acc.upto, r.stop)), acc -> acc.n)")
    votes = found.groupBy("conv", "turn", "level", "original").agg(ranges.alias("ranges")).select(
        "conv", "turn", "level", "original", F.expr(union).alias("words"))
    best = F.max(F.struct("words", "original")).alias("best")
    return votes.groupBy("conv", "turn", "level").agg(best).select("conv", "turn", "level", "best.original", "best.words")


def threads(links: DataFrame) -> DataFrame:
    """(conv, turn, parent, thread, depth) of messages with a level-1 link, by pointer doubling."""
    up = stored(links.filter("level = 1").select("conv", "turn", F.col("original").alias("parent"),
                                                 F.col("original").alias("thread"), F.lit(1).cast("long").alias("depth")), "quote-up")
    while True:
        at = up.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("thread").alias("next"), F.col("depth").alias("more"))
        step = stored(up.join(at, F.col("conv").eqNullSafe(F.col("c")) & (F.col("thread") == F.col("t")), "left").select(
            "conv", "turn", "parent", F.coalesce("next", "thread").alias("thread"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "quote-up")
        up = step.drop("moved")
        if step.filter("moved").isEmpty():
            return up


def link_quotes(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """Every message with its text without quotes, its parent, thread (first message) and depth, and all
    quote links. Sorted by conversation, thread, depth, turn this is the reply order."""
    messages = stored(parsed(df, conv_col, turn_col, text_col), "quote-messages")
    links = stored(quote_links(messages), "quote-links")
    line = threads(links).select(F.col("conv").alias("c"), F.col("turn").alias("t"), "parent", "thread", "depth")
    every = links.groupBy(F.col("conv").alias("lc"), F.col("turn").alias("lt")).agg(
        F.sort_array(F.collect_list(F.struct("level", "original", "words"))).alias("links"))   # a row per quote level
    joined = (messages.join(line, F.col("conv").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")), "left")
              .join(every, F.col("conv").eqNullSafe(F.col("lc")) & (F.col("turn") == F.col("lt")), "left"))
    return joined.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), *(["role"] if "role" in messages.columns else []),
        F.col("clean").alias("clean_text"), "quoted_lines", "max_level", F.col("parent").alias("parent_turn"),
        F.coalesce("thread", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "links")


def reply_ordered(linked: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """The linked messages in reply order, range-partitioned (no conversation is gathered in one task)."""
    order = [conv_col, "thread_turn", "depth", turn_col]
    return linked.repartitionByRange(*order).sortWithinPartitions(*order)

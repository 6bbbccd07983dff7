"""Quotes of some sentences of a paragraph, trimmed and wrapped anew."""

from cohortspark.llm import quote_links as Q


def test_trimmed_and_rewrapped_quotes(spark):
    long = "The red house stands by the river. Its door is green and old! Who has the key to it? Nobody we asked so far knew."
    wrapped = "We met on Tuesday. The plan was read aloud\nand then voted on. Four were for it,\ntwo against. The rest stayed silent."
    rows = [(1, 0, long), (1, 1, "> Its door is green and old! Who has\n> the key to it?\nI do."),
            (1, 2, wrapped), (1, 3, "> [...] The plan was read\n> aloud and then\n> voted on. [...]\n>\n> The rest stayed silent.\nNot I."),
            (1, 4, "> > Who has the key\n> > to it?\n> I do.\nGood."), (1, 5, "> A sentence nobody wrote. Or this one?\nHm."),
            (2, 0, "他来了。我们走吧。"), (2, 1, "> 我们走吧。\nOK")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, text string")
    got = {(r.conv_id, r.turn): r for r in Q.link_quotes(df).collect()}
    assert [got[1, t].parent_turn for t in range(6)] == [None, 0, None, 2, 1, None] and got[2, 1].parent_turn == 0
    assert [(x.level, x.original) for x in got[1, 4].links] == [(1, 1), (2, 0)] and got[1, 4].depth == 2
    assert got[1, 1].clean_text == "I do."


def test_sentences_do_not_depend_on_wrapping():
    one, two = "a b c x. d e f y z? g h", "a\nb c x.\nd e\nf y z? g\nh"
    hashes = {h for h, _, _ in Q.passages([one])}
    assert len(hashes) == 3 and hashes <= {h for h, _, _ in Q.passages(two.split("\n"))}

"""The memoised encoder gives the ids of the plain tokenizer."""

import numpy as np
from tokenizers import Tokenizer

from cohortspark.llm.common import ByteBpe, bpe_path
from llm_fixtures import docs_pd  # noqa: F401

ODD = ["", " ", "  ", " a", "a ", "a  b", "a\n b", "a \nb c", "don't we're, it's 12 3.5% <|endoftext|> x", "日本 語 x   y",
       "a\x1c b \x85 c", "tail. , .", "é. ü, 9.", "\n\n a b\t\tc d", "x" * 5000 + " y", "I'll  'll 's", "a . b , c.d e,",
       "x red*** ab''s été!!! ÷x a×b ǅ word's don't! q'' '\'s x-ray ʼn Straße?! ﬁ ½x a_b __init__ (x) x) «é» naïve…", "ªº µm x² ⅷ"]
CONTROL = ["<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>b c", "x <|endoftext|>y z", "x <|endoftext|>.<|endoftext|> <|endoftext|>",
           "<|endoftext| >", "é<|endoftext|>é <|endoftext", "a  <|endoftext|>  b"]


def test_other_tokenizers_encode_whole_texts():
    enc = ByteBpe(bpe_path("word_bpe_49k.json"))
    want = enc.tok.encode("Some  words, here", add_special_tokens=False).ids
    assert np.frombuffer(enc.encode([b"Some  words, here"])[0], dtype="<u4").tolist() == want


def test_ids_equal_plain_tokenizer(docs_pd):
    """With the file's own settings, and with control tokens read as text."""
    texts = ODD + CONTROL + docs_pd.text.dropna().tolist()
    for control in (True, False):
        tok = Tokenizer.from_file(bpe_path())
        if not control:
            tok.encode_special_tokens = True
        want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
        assert any(50256 in ids for ids in want) == control
        for memo in (1_200_000, 50):
            enc = ByteBpe(bpe_path(), memo=memo, control_tokens=control)
            got = [np.frombuffer(b, dtype="<u4").tolist() for b in enc.encode([t.encode() for t in texts])]
            assert got == want

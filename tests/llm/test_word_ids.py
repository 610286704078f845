from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from canvass.llm.packing import WordIds
from canvass.llm.queries import tokenizer_path

WHOLE = Tokenizer.from_file(tokenizer_path())
WORDS = WordIds(tokenizer_path())
PARTS = ["And", "and", ".", ",", "...", "|", "'s", "'", "É", "ß", "é", "Σ", "İ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "9", "٣",
         " ", "\n", "\t", "\x1c", "\x85", " ", "　", "\U0001f600", "!", "?", "don't", "ﬁ", "한", "x", "ÿ", "÷", "Þ", "ß.", "a\u0301", ":"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS) | st.characters(exclude_categories=["Cs"]), max_size=30))
def test_ids_of_words_are_ids_of_the_text(parts):
    text = "".join(parts)
    got = WORDS.batch([text])[0]
    want = WHOLE.encode(text, add_special_tokens=False).ids
    assert got == b"".join(i.to_bytes(4, "little") for i in want)

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vigil.llm import bpe

PATH = bpe.default_vocabulary()
LIBRARY = Tokenizer.from_file(PATH)
MINE = bpe.WordBPE(PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8", exclude_categories=["Cn", "Cs"]), max_size=40))
def test_any_text_is_as_the_library_has_it(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert MINE.encode(text) == np.array(ids, "<u4").tobytes()
    assert MINE.decode(MINE.encode(text)) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_a_small_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    small, text = bpe.WordBPE(PATH), "the cat sat on the mat, the cat ran. " * 5
    assert small.encode(text) == MINE.encode(text)


def test_operator(docs, nothing):
    got = bpe.bpe_encode(docs).collect()
    for r in got:
        want = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want
        assert r.decoded == LIBRARY.decode(want, skip_special_tokens=False)
    assert len(got) == 12
    assert bpe.bpe_encode(nothing).count() == 0
    with pytest.raises(ValueError):
        bpe.bpe_encode(docs, ids="sig")

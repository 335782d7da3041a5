"""The tokenizer's ids for every code point, in and outside of the common set, equal the library's."""

import pytest

from lociframe.llm import bpe
from lociframe.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path()), bpe.Bpe(tokenizer_path())


POINTS = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]


@pytest.mark.parametrize("made", ["A{}b1{}", "{}", "x{}'s ́{}"])
def test_each_code_point(both, made):
    library, mine = both
    step = 4096
    wrong = []
    points = POINTS if made == "A{}b1{}" else POINTS[:0x3500]
    for i in range(0, len(points), step):
        part = [made.format(c, c) for c in points[i : i + step]]
        if mine.encode(" | ".join(part)) != library.encode(" | ".join(part), add_special_tokens=False).ids:
            wrong += [hex(ord(c)) for c, t in zip(points[i : i + step], part, strict=True) if mine.encode(t) != library.encode(t, add_special_tokens=False).ids]
    assert not wrong, (len(wrong), wrong[:20])


def test_pairs_of_the_common_set(both):
    library, mine = both
    some = [c for c in POINTS[:0x2500] if bpe.COMMON.fullmatch(c)][::3] + ["́", "ͅ", "Σ", "İ", "ᄀ", "ᅡ"]
    for a in some:
        text = " ".join(f"{a}{b}q" for b in some)
        assert mine.encode(text) == library.encode(text, add_special_tokens=False).ids, hex(ord(a))

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from hirelens.llm.tokens import NOT_ALNUM, blocks, shingles, words

ALPHABET = st.text(st.sampled_from("aAbB é漢\t\n .!\x0b\x85 ßÉ0"), max_size=40)


def lower_ascii(word: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), word)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), ALPHABET), min_size=1, max_size=8))
def test_words_and_shingles_match_regular_expressions(texts):
    column = pa.array(["x", *texts], pa.string())[1:]
    for pattern, separators in ((r"[^\x20\x09-\x0D]+", None), (r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", NOT_ALNUM)):
        names: dict[str, int] = {}
        for block in blocks(column):
            found = words(block) if separators is None else words(block, separators)
            runs, at = shingles(found)
            for i in range(len(block)):
                source = texts[block.first + i] or ""
                source = lower_ascii(source)
                own = re.findall(pattern, source)
                hashes = found.hashes[found.offsets[i] : found.offsets[i + 1]].tolist()
                assert len(hashes) == len(own)
                for word, value in zip(own, hashes):
                    assert names.setdefault(word, value) == value
                five = [" ".join(own[j : j + 5]) for j in range(max(1, len(own) - 4))] if own else []
                hashes = runs[at[i] : at[i + 1]].tolist()
                assert len(hashes) == len(five)
                for run, value in zip(five, hashes):
                    assert names.setdefault("run " + run, value) == value
        assert len(set(names.values())) == len(names)


def test_blocks_cut_long_columns_without_losing_texts():
    texts = ["a" * 700_000, "b c", None, "d" * 1_500_000, "", "e f g"]
    found = [(b.first, len(b), len(b.data)) for b in blocks(pa.array(texts))]
    assert sum(n for _, n, _ in found) == len(texts)
    assert sum(n for _, _, n in found) == sum(len(t or "") for t in texts)


def test_sums_of_empty_texts_are_zero():
    (block,) = blocks(pa.array(["", "ab", "", None, "c"]))
    assert block.sums(np.ones(3, np.int64)).tolist() == [0, 2, 0, 0, 1]

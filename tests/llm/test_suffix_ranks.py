"""Ranks of strings are in byte order, for the lead bytes of wide characters too."""

import numpy as np
from acquira.llm.suffix import suffix_ranks


def test_ranks_of_wide_text_are_in_byte_order():
    text = np.frombuffer("żółć abc éàü żółw 😀😁 abcdef ~~~ 한글 힣힣 🚀🚀x 😀😂".encode() * 3, np.uint8)
    for length in (5, 8, 13):
        strings = [text[i:i + length].tobytes() for i in range(len(text) - length + 1)]
        rank = suffix_ranks(text, length)[:len(strings)]
        by = sorted(range(len(strings)), key=lambda i: strings[i])
        assert all((rank[a] < rank[b]) == (strings[a] < strings[b]) and (rank[a] == rank[b]) == (strings[a] == strings[b]) for a, b in zip(by, by[1:]))

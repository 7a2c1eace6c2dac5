import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import textkernel as K

TEXT = st.one_of(st.none(), st.text(alphabet="aAbZ é漢\n\t.0", max_size=30))


@given(st.lists(TEXT, max_size=8))
@settings(max_examples=150, deadline=None)
def test_words_equal_regular_expressions(texts):
    data, off = K.text_buffer(pa.array(texts, pa.string()))
    low = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "") for t in texts]
    for mask, pattern in ((K.NOT_BLANK, r"[^\x20\x09-\x0D]+"), (K.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        s, e, first = K.words(data, off, mask)
        want = [re.findall(pattern, t) for t in low]
        got = [[bytes(K.LOWER[data[a:b]]).decode() for a, b in zip(s[i:j], e[i:j], strict=True)] for i, j in zip(first, first[1:], strict=False)]
        assert got == want
        h = K.hashes(data, s, e)
        flat = [w for ws in want for w in ws]
        assert h.tolist() == K.hash_words([w.encode() for w in flat]).tolist()
        runs, at = K.shingles(h, first, 3)
        for i, ws in enumerate(want):
            own = [tuple(ws[j : j + 3]) for j in range(max(1, len(ws) - 2))] if ws else []
            assert at[i + 1] - at[i] == len(own)
            assert len(set(runs[at[i] : at[i + 1]].tolist())) == len(set(own))
            assert [n[i] for n in K.repeats(h, first)] == [len(set(ws)), max((ws.count(w) for w in ws), default=0)]


def test_slices_and_chunks():
    column = pa.array(["ab", "c", None, "defg"]).slice(1)
    data, off = K.text_buffer(column)
    assert bytes(data) == b"cdefg" and off.tolist() == [0, 1, 1, 5]
    assert list(K.chunks(np.array([0, 1, 1, 5]), 2)) == [(0, 2), (2, 3)]
    assert list(K.chunks(np.array([0]), 2)) == []
    assert K.sums(np.array([2**63, 2**63], dtype=np.uint64), np.array([0, 2])).dtype == np.uint64

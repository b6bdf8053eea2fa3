"""A word and the same word before a full stop or comma are one chunk to the encoder; the ids stay the library's."""

import pyarrow as pa

from loomdex.llm import encode
from loomdex.llm.queries import tokenizer_file

TEXTS = ["Lorem. Lorem, Lorem\nLorem.\nLorem, end.", "it's. 'sx. a.. b., c,. . , .a ,b 3. 3, x1. -. ß. grüße. 東京. é. ×. é,", "", None, "one.", ",", "a .\n, b", "two  spaces. and\ttab.", "東京 é Größe 東."]


def test_words_before_marks():
    coder = encode.Encoder(tokenizer_file("byte_bpe_50k.json"))
    for texts in (TEXTS, TEXTS[::-1]):
        ids, off = coder.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [coder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    known = coder.known.to_pylist()
    assert " Lorem" in known and not {" Lorem.", "Lorem.", " Lorem,"} & set(known)

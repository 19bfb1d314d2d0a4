import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from knownat.llm import tokens
from knownat.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def expected(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize(
    "text",
    ["", " ", "a", " a", "a ", "a  b", "a\n b", "a\nb c\n", "it's we'll 'S", "x\x1cy z", "\x85a b",
     "a　b c", "12 ab3, c.d.. e", "<|endoftext|> a b", "🙂 é̀ ñ", "²³ ªº x"],
)
def test_encoder_agrees_with_the_library(library, text):
    encode = tokens.Encoder(tokenizer_path())
    for _ in range(2):  # the second time from memory
        assert np.frombuffer(encode.encode(text), "u2").tolist() == expected(library, text)[:-1]


def key(item):
    return item[0] is not None, item[0] or 0


def test_round_trip_in_id_order(spark, odd, library):
    folder, index = tokens.write_tokens(odd, tokenizer_path(), length=64, batch=4, files=5)
    got = tokens.with_starts(tokens.read_tokens(folder, index)).collect()
    assert len(got) == odd.count()
    wanted = sorted(
        (r.doc_id, tuple(expected(library, r.text))) for r in odd.collect() if r.doc_id is not None
    )
    found = sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got if r.doc_id is not None)
    crc = [(d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in wanted]
    assert found == sorted(crc)
    upto = 0
    for row in sorted(got, key=lambda r: r.start):
        assert row.start == upto
        upto += row.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(
        (r.doc_id for r in got), key=lambda d: (d is not None, d or 0)
    )


def test_sequences_are_views_of_equal_length(tmp_path):
    path = str(tmp_path / "x.arrows")
    with pa.OSFile(path, "wb") as sink:
        writer = tokens.SequenceWriter(sink, "H", 8, 3)
        writer.add(np.arange(30, dtype="u2"))
        writer.add(np.arange(30, 45, dtype="u2"))
        writer.close()
    file = tokens.SequenceFile(path)
    assert len(file) == 6
    assert file.ids(4).tolist() == list(range(32, 40))
    assert file.ids(5).tolist() == [40, 41, 42, 43, 44, 0, 0, 0]
    assert file.mask(5).to_pylist() == [True] * 5 + [False] * 3
    assert not file.ids(0).flags.owndata


def test_empty_table(nothing):
    folder, index = tokens.write_tokens(nothing, tokenizer_path())
    assert tokens.with_starts(tokens.read_tokens(folder, index)).count() == 0

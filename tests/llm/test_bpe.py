"""BPE against the tokenizers library, and the automaton against a plain dictionary."""

import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import settings as examples
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clicktrail.llm.bpe import Codec, Lexicon, encode_decode, frequent_words, lexicon, vocabulary
from clicktrail.llm.tokens import token_ids
from clicktrail.llm.queries import TOKENIZER

PATH, PATTERN = TOKENIZER["path"], TOKENIZER["pattern"]
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
RULES = vocabulary(PATH, PATTERN)


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@examples(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.sampled_from(["<|endoftext|>", "don't we'll I'M 's''s", "  \n\n x", "x" * 300, "1234567890" * 20, " " * 90, "日本語" * 40])), max_size=6))
def test_any_text(texts):
    codec = Codec(RULES, lexicon([" the", "don", "日本", "x"], PATH, PATTERN), remember=20)
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(text)
        assert codec.decode(ids) == LIBRARY.decode(ids_of(text), skip_special_tokens=False)
        assert token_ids(text, **TOKENIZER).tolist() == ids_of(text)


def test_long_words_are_merged_in_the_same_order():
    for text in ("ab" * 5000, "z" * 3001, "thequickbrownfox" * 200, "é" * 700):
        assert np.frombuffer(Codec(RULES, Lexicon.build({})).encode([text])[0], "<u4").tolist() == ids_of(text)


def test_the_automaton_is_minimal_and_holds_its_words(tmp_path):
    words = sorted({f"{a}{b}{c}".encode() for a in ("", "un", "re") for b in ("do", "tie", "walk") for c in ("", "s", "ing", "ings")})
    entries = {w: np.array([i, i + 1], "<u4").tobytes() for i, w in enumerate(words)}
    built = Lexicon.build(entries)
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
    futures = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes}
    assert len(built.final) == len(futures)
    others = [b"", b"d", b"dos!", b"undoing", b"redoingss", b"zzz"]
    (tmp_path / "lexicon").write_bytes(built.block())
    for made in (built, Lexicon.map_file(str(tmp_path / "lexicon")), Lexicon.map_block(built.block())):
        assert made.find([*words, *others]) == [entries.get(w) for w in [*words, *others]]
    assert Lexicon.build({}).find([b"a"]) == [None]


def check(rows, texts):
    wanted = []
    for doc_id, text in texts:
        ids = ids_of(text or "")
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        wanted.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(repr, (tuple(r) for r in rows))) == sorted(map(repr, wanted))


def test_odd_rows(odd):
    check(encode_decode(odd, PATH, PATTERN, words=20).collect(), [(r.doc_id, r.text) for r in odd.collect()])


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(encode_decode(docs, PATH, PATTERN).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_frequent_words_are_counted_over_all_texts(spark):
    docs = spark.createDataFrame([(i, "a b b c" if i % 2 else "b d") for i in range(10)], "doc_id long, text string")
    wanted = {" b": 10, " c": 5, " d": 5, "a": 5, "b": 5}
    assert {r.word: r.n for r in frequent_words(docs, PATH, PATTERN, 5).collect()} == wanted
    # Words of one count go together or not at all.
    assert {r.word: r.n for r in frequent_words(docs, PATH, PATTERN, 4).collect()} == {" b": 10}
    assert frequent_words(docs, PATH, PATTERN, 0).collect() == []


def test_empty_table(empty):
    assert encode_decode(empty, PATH, PATTERN).collect() == []

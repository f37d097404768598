"""Pieces and token files against the libraries."""

import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from sparkrag.llm import pieces, token_files

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a ", " a", "a  b", "\n", "a\n b", "a \n b", "▁a ▁", "日本語 テスト 😀", "a\tb  ",
       " " * 40 + "x", "é" * 3, "\x00a b\x00", "x" * 3000, "don't he'll", "a <|endoftext|> b",
       "a<|endoftext|>b c", "　a b  c", "x\x1c y z\x85 w", "  a  b", "<s> </s> <unk>"]
SPACED = st.text(st.sampled_from("ab ▁é\n\t日 .'"), max_size=40)


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(MODEL)


@pytest.fixture(scope="module")
def ids():
    return token_files.IdEncoder(BYTES)


def check_pieces(encoder, text):
    got, starts, ends = encoder.encode(text)
    assert got.tolist() == encoder.library.encode(text)
    raw = text.encode()
    assert not len(got) or (starts[0] == 0 and ends[-1] == len(raw)
                            and (starts[1:] == ends[:-1]).all())
    for k, i in enumerate(got):
        name, part = encoder.names[i], raw[starts[k]:ends[k]]
        if encoder.is_byte[i]:
            assert part == bytes([int(name[3:5], 16)])
        elif "▁" not in text:
            want = name.replace("▁", " ").encode()
            assert part == (want[1:] if k == 0 and want[:1] == b" " else want)
    assert encoder.decode(got) == encoder.library.decode(encoder.library.encode(text))


def test_pieces(encoder, some_docs):
    assert encoder.in_runs
    for text in ODD + [r.text for r in some_docs.select("text").collect()]:
        check_pieces(encoder, text or "")


@settings(max_examples=200, deadline=None)
@given(SPACED)
def test_pieces_of_any_text(text):
    check_pieces(ENCODER, text)


ENCODER = pieces.Encoder(MODEL)
IDS = token_files.IdEncoder(BYTES)


@settings(max_examples=200, deadline=None)
@given(st.one_of(SPACED, st.text(max_size=30)))
def test_ids_of_any_text(text):
    assert IDS.encode(text).tolist() == IDS.library.encode(text, add_special_tokens=False).ids


def test_character_map():
    """Longest-prefix normalisation and alignment, with a real compiled map."""
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    own = pieces.Normalizer(proto.normalizer_spec)
    for text in ["ＡＢＣ　ｄｅｆ ①② ﬁ", "  a  b  ", "é é", "㍿ x\t\ny ", "", "カ゛ガ ｶﾞ", "½ ² ™",
                 "a​b", "한글 각", "plain text"]:
        normal, places = own.normalize(text.encode())
        want, offsets = library.normalize(text, with_offsets=True)
        assert normal.decode() == want
        # Library offsets count characters; ours count bytes.
        at = np.cumsum([0] + [len(c.encode()) for c in text])
        begin = np.cumsum([0] + [len(c.encode()) for c in want])
        assert [places[b] for b in begin] == [at[o] for o in offsets] or not want


def test_encode_table(edge, no_docs):
    got = pieces.encode(edge, MODEL)
    assert got.columns == [c for c in edge.columns if c != "pieces"] + ["pieces"]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in got.collect():
        want = library.encode(r.text or "")
        assert list(r.pieces.ids) == want and r.pieces.decoded == library.decode(want)
    assert pieces.encode(no_docs, MODEL).count() == 0


def test_ids(ids, some_docs):
    for text in ODD + [r.text for r in some_docs.select("text").collect()]:
        want = ids.library.encode(text or "", add_special_tokens=False).ids
        assert ids.encode(text or "").tolist() == want


def test_new_words_go_to_the_merges_together():
    encoder, calls = token_files.IdEncoder(BYTES), []
    merges = encoder.merges

    class Counted:
        def tokenize(self, text):
            calls.append(text)
            return merges.tokenize(text)

    encoder.merges = Counted()
    ends = ["", ".", "\nÖl", "é,", "###", "!'s", "\n", "?!\nb"]
    words = [f"{a}rst{b}{ends[k % len(ends)]}" for k, (a, b) in enumerate(
        (a, b) for a in "abcdefghijklmnopqrst" for b in "äbçdéfghij")]
    text = "first " + " ".join(words) + " x"
    assert encoder.encode(text).tolist() == encoder.library.encode(
        text, add_special_tokens=False).ids
    assert len(calls) < 10


@pytest.mark.parametrize("left,right", [("a", "Ġ"), ("Ċ", "b"), ("©", "Ġa")])
def test_merges_that_would_cross_words(tmp_path, left, right):
    """Such a merge never happens inside a word; words are then encoded one by one."""
    letters = list(token_files._BYTE_LETTERS.values())
    names = letters + [t for t in ("Ġa", left + right) if t not in letters]
    merges = [("Ġ", "a"), (left, right)]
    made = tokenizers.Tokenizer(tokenizers.models.BPE({t: i for i, t in enumerate(names)}, merges))
    made.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False)
    made.save(str(tmp_path / "t.json"))
    encoder = token_files.IdEncoder(str(tmp_path / "t.json"))
    for text in ("a a ab a", "ba\nb ba\nba b", "é aé a é b", "x é. é, a! a"):
        assert encoder.encode(text).tolist() == made.encode(text).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=80), min_size=1, max_size=12),
       st.integers(0, 6))
def test_grammar(docs, rounds):
    parts = [np.array(d, np.uint32) for d in docs]
    sizes = np.array([len(p) for p in parts], np.int64)
    symbols, begins, rules, lengths, terminals = token_files.compress(
        np.concatenate(parts), sizes, rounds, least=2)
    grammar = token_files.Grammar(rules, lengths, terminals)
    assert len(grammar.expand(symbols)) == sizes.sum()
    for k, p in enumerate(parts):
        own = symbols[begins[k]:begins[k + 1]]
        assert (grammar.expand(own) == p).all()
        for start, count in ((0, 3), (2, 5), (7, 1), (len(p), 4)):
            assert (grammar.expand(own, start, count) == p[start:start + count]).all()


def test_grammar_compresses():
    ids = np.tile(np.arange(50, dtype=np.uint32), 400)
    symbols, *_ = token_files.compress(ids, np.array([len(ids)]))
    assert len(symbols) < len(ids) / 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=80), min_size=1, max_size=12),
       st.integers(2, 5))
def test_grammar_leaves_no_frequent_pair(docs, least):
    parts = [np.array(d, np.uint32) for d in docs]
    sizes = np.array([len(p) for p in parts], np.int64)
    symbols, begins, *_ = token_files.compress(np.concatenate(parts), sizes, least=least)
    seen = collections.Counter()
    for a, b in zip(begins, begins[1:]):
        own, before = symbols[a:b].tolist(), None
        for k, pair in enumerate(zip(own, own[1:])):
            if before == (pair, k - 1):
                before = None  # overlaps the one counted before
            else:
                seen[pair] += 1
                before = pair, k
    assert all(n < least for n in seen.values())


def test_grammar_of_a_long_passage():
    """A passage that repeats becomes one symbol, however long, also among many frequent pairs."""
    r = np.random.default_rng(0)
    passage = r.integers(0, 50_000, 3000)
    docs = [np.concatenate([r.integers(0, 50_000, 50), passage]) for _ in range(40)]
    pairs = np.repeat(r.integers(0, 50_000, (6000, 2)), 30, axis=0)
    docs += list(pairs[r.permutation(len(pairs))])
    sizes = np.array([len(d) for d in docs], np.int64)
    symbols, begins, rules, lengths, terminals = token_files.compress(
        np.concatenate(docs).astype(np.uint32), sizes)
    assert lengths.max() >= 3000
    assert all(b - a <= 51 for a, b in zip(begins[:40], begins[1:41]))
    assert (np.diff(begins[40:]) == 1).all()  # every one of 6000 pairs has a rule
    assert (token_files.Grammar(rules, lengths, terminals).expand(symbols)
            == np.concatenate(docs)).all()


@pytest.mark.parametrize("block", [1 << 21, 200])
def test_files(spark, folder, edge, block):
    path = f"{folder}/ids"
    token_files.write(edge, path, BYTES, block_ids=block)
    library = tokenizers.Tokenizer.from_file(BYTES)
    rows = sorted(((r.doc_id, r.text) for r in edge.collect()),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for i, text in rows:
        one = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(one), zlib.crc32(np.array(one, "<u4").tobytes()), one))
        at += len(one)
    got = sorted((tuple(r) for r in token_files.read(spark, path).collect()), key=lambda r: r[1])
    assert got == want
    blocks = sorted((r.asDict() for r in spark.read.parquet(path).collect()),
                    key=lambda r: (r["shard"], r["block"]))
    k = 0
    for b in blocks:
        for j in range(b["n_docs"]):
            assert token_files.ids_of_document(b, j).tolist() == want[k][4]
            assert token_files.ids_of_document(b, j, 3, 4).tolist() == want[k][4][3:7]
            k += 1
    assert k == len(want)


def test_no_files(spark, folder, no_docs):
    token_files.write(no_docs, f"{folder}/none", BYTES)
    assert token_files.read(spark, f"{folder}/none").count() == 0

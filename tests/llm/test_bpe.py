import random

import pytest
from tokenizers import Tokenizer

from inboxsieve.llm import bpe_trie
from inboxsieve.llm.queries import op7_bpe_trie, table, tokenizer_path

from .conftest import SF, messy_rows, prose


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def encoder():
    return bpe_trie.Encoder(bpe_trie.Vocabulary(tokenizer_path()))


def test_random_strings(library, encoder):
    rng = random.Random(3)
    parts = [*"abcdefthe  \n\n\t'sre019.,!#é中ñ\u0301\x1c\x85\u00a0\u2028😀", "<|endoftext|>", "'ll", "   ", " the"]
    for _ in range(1500):
        s = "".join(rng.choices(parts, k=rng.randrange(60)))
        assert encoder.encode(s).tolist() == library.encode(s, add_special_tokens=False).ids, s


@pytest.mark.parametrize("s", ["a" * 5000, " " * 3000 + "x", "\n" * 500, "ab" * 3000, "é" * 3000, "-" * 999, ""])
def test_long_runs(library, encoder, s):
    assert encoder.encode(s).tolist() == library.encode(s, add_special_tokens=False).ids


def test_tokens_side_by_side(encoder):
    rng, v = random.Random(8), encoder.v
    ids = sorted(v.id_of.values())
    assert v.plain
    short = [i for i in ids if len(v.bytes_of[i]) <= 3]
    for _ in range(30_000):
        a, b = rng.choice(rng.choice([ids, short])), rng.choice(rng.choice([ids, short]))
        assert v.stand_together(a, b) == (v.merged(v.bytes_of[a] + v.bytes_of[b]) == [a, b]), (a, b)


def test_a_full_trie_is_begun_anew(monkeypatch, library):
    monkeypatch.setattr(bpe_trie, "MAX_NODES", 50)
    monkeypatch.setattr(bpe_trie, "PIECE_BYTES", 100_000)
    small = bpe_trie.Encoder(bpe_trie.Vocabulary(tokenizer_path()))
    s = " ".join(f"word{k} thing{k * 7}" for k in range(300))
    assert small.encode(s).tolist() == library.encode(s, add_special_tokens=False).ids


def test_messy_rows_and_round_trip(library, messy):
    done = bpe_trie.decode(bpe_trie.encode(messy, tokenizer_path()), tokenizer_path()).collect()
    got = sorted((r.doc_id, r.ids, r.decoded, r.n) for r in done)
    want = sorted((i, library.encode(t or "", add_special_tokens=False).ids, t or "", "clash") for i, t, _, _ in messy_rows())
    assert got == want


def test_null_and_unknown_ids(spark):
    rows = spark.createDataFrame([(None,), ([],), ([10 ** 6, 64, None],)], "ids array<int>")
    assert sorted(r.decoded for r in bpe_trie.decode(rows, tokenizer_path()).collect()) == ["", "", "a"]


def test_query_against_the_library(spark, library, nothing):
    import hashlib
    text = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in op7_bpe_trie(spark, SF).collect():
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert bpe_trie.encode(nothing, tokenizer_path()).count() == 0


def test_a_very_long_word_takes_linear_memory():
    """A word of a million letters, against the library's merge loop."""
    import random
    import resource

    from inboxsieve.llm.token_files import ByteLevel
    rng = random.Random(3)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = bpe_trie.Encoder(bpe_trie.Vocabulary(tokenizer_path())).encode(word)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
    assert got.tolist() == ByteLevel(tokenizer_path()).encode(word)


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe_trie, "MAX_NODES", 50)
    monkeypatch.setattr(bpe_trie, "PIECE_BYTES", 100_000)
    encoder = bpe_trie.Encoder(bpe_trie.Vocabulary(tokenizer_path()))
    text = prose(1, 3000, 10 ** 6)
    whole = bpe_trie.Encoder(encoder.v).encode(text)
    assert encoder.encode(text).tolist() == whole.tolist() == encoder.encode(text).tolist()
    assert len(encoder.last) < 200 and len(encoder.joins) <= 50 and len(encoder.spaced) < 500


def test_a_node_is_made_only_where_a_token_may_end():
    e = bpe_trie.Encoder(bpe_trie.Vocabulary(tokenizer_path()))
    nodes, rng = len(e.last), random.Random(4)
    word = b" internationalization"
    assert e.insert(word) == e.v.merged(word) and len(e.last) - nodes < len(word) // 2
    for _ in range(3000):
        word = "".join(rng.choices("abcdeinst019-é", k=rng.randrange(1, 14))).encode()
        assert e.insert(word) == e.long_word(word) == e.v.merged(word)

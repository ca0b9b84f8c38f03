import hashlib
from collections import Counter

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inboxsieve.llm import token_align
from inboxsieve.llm.queries import op11_token_align, table, tokenizer_path
from inboxsieve.llm.token_files import ByteLevel, Piece, slices

from .conftest import SF, messy_rows, messy_table

PIECES = "piece_bpe_32k.model"


def libraries():
    a = Tokenizer.from_file(tokenizer_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))


def token_ends(text, lib_a, lib_b, bytes_a, bytes_b):
    """(id, start, end) of both sides by the libraries themselves, or none."""
    if not text:
        return [], []
    want, out = b" " + text.encode(), []
    for ids, data in ((lib_a.encode(" " + text, add_special_tokens=False).ids, bytes_a), (lib_b.encode(text), bytes_b)):
        side, at = [], 0
        for i in ids:
            side.append((i, at, at + len(data[i])))
            at += len(data[i])
        out.append(side)
        if b"".join(data[i] for i in ids) != want:
            return [], []
    return out


def brute(rows):
    """Counts and groups by the definition: cut where both end."""
    lib_a, lib_b = libraries()
    bytes_a, bytes_b = ByteLevel(tokenizer_path()).token_bytes(), Piece(tokenizer_path(PIECES)).token_bytes()
    docs, pairs = [], Counter()
    for i, t in rows:
        a, b = token_ends(t, lib_a, lib_b, bytes_a, bytes_b)
        links = [(x[0], y[0]) for x, y in _same_end(a, b)]
        pairs.update(links)
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, lo = [], 0
        for cut in cuts:
            groups.append(",".join(str(x[0]) for x in a if lo < x[2] <= cut) + "|"
                          + ",".join(str(y[0]) for y in b if lo < y[2] <= cut))
            lo = cut
        docs.append((i, len(a), len(b), len(groups), links, ";".join(groups)))
    most = Counter()
    for (_, b), n in pairs.items():
        most[b] = max(most[b], n)
    return sorted(((i, na, nb, ng, len(ls), sum(pairs[x] == most[x[1]] for x in ls), sum(pairs[x] for x in ls), g)
                   for i, na, nb, ng, ls, g in docs), key=str)


def _same_end(a, b):
    ends = {y[2]: y for y in b}
    return [(x, ends[x[2]]) for x in a if x[2] in ends]


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def result(df, names=NAMES):
    return sorted(map(tuple, df.select(*names).collect()), key=str)


ODD = [(50, "a▁b"), (51, "<s> </s> <|endoftext|>"), (52, "\x00 　x"), (53, " "), (None, "two  spaces "),
       (54, "naïve café \U0001f600中文"), (54, "naïve"), (55, "the the the")]


def test_messy_rows(spark):
    # the very long rows are cut for the brute force, which is quadratic
    rows = [(i, t[:2000] if t else t) for i, t, _, _ in messy_rows()] + ODD
    df = messy_table(spark, [(i, t, "en", "a") for i, t in rows], ["block", "pair", "n", "links", "best"])
    for block in (1, 1 << 22):  # a block a batch, one block a partition
        got = token_align.align(df.repartition(3), tokenizer_path(), tokenizer_path(PIECES), block_bytes=block)
        assert result(got) == brute(rows)


def test_long_texts(messy):
    got = {r.doc_id: r for r in token_align.align(messy, tokenizer_path(), tokenizer_path(PIECES)).collect()}
    lib_a, lib_b = libraries()
    for i, t, _, _ in messy_rows():
        assert got[i].n_a == (len(lib_a.encode(" " + t, add_special_tokens=False).ids) if t else 0)
        assert got[i].n_b == (len(lib_b.encode(t)) if t else 0)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    want = sorted(((*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in brute(rows)), key=str)
    assert result(op11_token_align(spark, SF), [*NAMES[:-1], "groups_sha256"]) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab  \n\té中😀'1_.")), max_size=30), max_size=4))
def test_overlaps_and_links(texts):
    sides = token_align.Sides(ByteLevel(tokenizer_path()), Piece(tokenizer_path(PIECES)))
    done = token_align.Aligned(sides, texts)
    lib_a, lib_b = libraries()
    over, base_a, base_b = set(), 0, 0
    for t in texts:
        a, b = token_ends(t, lib_a, lib_b, sides.bytes_a, sides.bytes_b)
        over |= {(base_a + i, base_b + j) for i, x in enumerate(a) for j, y in enumerate(b) if x[1] < y[2] and y[1] < x[2]}
        base_a, base_b = base_a + len(a), base_b + len(b)
    found = list(zip(done.over[0].tolist(), done.over[1].tolist(), strict=True))
    assert len(found) == len(set(found)) and set(found) == over


def test_slices_give_the_ids_of_the_whole():
    file = Piece(tokenizer_path(PIECES))
    text = "some words, é中 and  two\nlines _x y_ 12 " * 300
    whole = file.encode(text)
    parts = list(slices(text, 40))
    assert len(parts) > 50
    assert [i for k, p in enumerate(parts) for i in file.encode(p[1:] if k else p)] == whole


def test_empty_table(nothing):
    assert token_align.align(nothing, tokenizer_path(), tokenizer_path(PIECES)).count() == 0

import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from inboxsieve.llm import cost_packing
from inboxsieve.llm.queries import op12_cost_packing, table, tokenizer_path
from inboxsieve.llm.token_files import ByteLevel, slices

from .conftest import SF, messy_rows, messy_table, prose


def library_ids(texts):
    tok = Tokenizer.from_file(tokenizer_path())
    return [[*e.ids, 1] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(pieces, texts, capacity=2048):
    """Every id in one piece, sequences without gaps, all full or powers of two."""
    whole = defaultdict(list)
    for k, ids in zip([k for k, _ in texts], library_ids([t for _, t in texts]), strict=True):
        whole[k].append(ids)
    got, places = defaultdict(list), defaultdict(list)
    for r in pieces:
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert len(ids) == r.length > 0
        got[r.doc_id].append((r.doc_tokens, r.start, ids))
        places[r.sequence_id].append((r.offset, r.length, r.sequence_tokens))
    assert got.keys() == whole.keys()
    for k, rows in got.items():
        if len(whole[k]) == 1:
            assert [i for _, _, ids in sorted(rows) for i in ids] == whole[k][0]
            assert {n for n, _, _ in rows} == {len(whole[k][0])}
        assert sum(len(ids) for _, _, ids in rows) == sum(map(len, whole[k]))
    for rows in places.values():
        at = 0
        for offset, length, total in sorted(rows):
            assert offset == at
            at += length
        assert total == at <= capacity and at & (at - 1) == 0


def test_messy_rows(messy):
    pieces = cost_packing.pack(messy, tokenizer_path()).collect()
    check(pieces, [(i, t) for i, t, _, _ in messy_rows()])


def test_special_strings_and_clashing_names(spark):
    rows = [(1, "a<|endoftext|>b"), (2, "<|endoftext|>"), (None, " x"), (4, "  ")]
    df = messy_table(spark, [(i, t, "en", "a") for i, t in rows], ["start", "length", "offset", "sequence_id"])
    check(cost_packing.pack(df, tokenizer_path(), capacity=4).collect(), rows, capacity=4)


def test_blocks_and_partitions(spark):
    rng = random.Random(3)
    rows = [(i, prose(i, rng.choice([0, 3, 50, 400, 3000]))) for i in range(120)]
    df = messy_table(spark, [(i, t, "en", "a") for i, t in rows]).repartition(3)
    pieces = cost_packing.pack(df, tokenizer_path(), block_tokens=20_000).collect()
    check(pieces, rows)
    assert len({r.sequence_id >> 40 for r in pieces}) == 3


def test_assignment_by_lowest_cost():
    """Against a plain loop over the pieces, one after another."""
    rng = np.random.default_rng(5)
    for _ in range(30):
        lengths = rng.integers(1, 700, rng.integers(1, 60))
        places = cost_packing.capacities(int(lengths.sum()), 256)
        assert sum(places) == lengths.sum()
        todo = [(d, k, min(256, n - k)) for d, n in enumerate(lengths) for k in range(0, n, 256)]
        todo.sort(key=lambda p: -p[2])
        used, cost, want = [0] * len(places), [0.0] * len(places), []
        for d, start, left in todo:
            while left:
                fits = [s for s in range(len(places)) if places[s] - used[s] >= left]
                if fits:
                    s = min(fits, key=lambda s: cost[s])
                else:
                    s = max(range(len(places)), key=lambda s: places[s] - used[s])
                n = min(left, places[s] - used[s])
                want.append((d, start, n, s, used[s]))
                used[s] += n
                cost[s] += n + n * n / (6.0 * 64)
                start, left = start + n, left - n
        assert sorted(cost_packing.assign(lengths, 256, 64)) == sorted(want)


def test_costs_are_nearer_than_in_input_order():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 2000, 3000)
    price = lambda n: n + n * n / (6.0 * 1024)
    cost = defaultdict(float)
    for _, _, n, s, _ in cost_packing.assign(lengths, 2048, 1024):
        cost[s] += price(n)
    full = [cost[s] for s in range(int(lengths.sum()) // 2048)]
    plain, room = [0.0], 2048
    for n in lengths.tolist():
        while n:
            if not room:
                plain.append(0.0)
                room = 2048
            m = min(n, room)
            plain[-1] += price(m)
            n, room = n - m, room - m
    assert np.std(full) < np.std(plain[:-1])


def test_query(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    ids = dict(zip([r.doc_id for r in docs], library_ids([r.text for r in docs]), strict=True))
    rows = op12_cost_packing(spark, SF).collect()
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], dtype="<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])


def test_slices_give_the_ids_of_the_whole(spark):
    rng = random.Random(8)
    file = ByteLevel(tokenizer_path())
    text = "".join(rng.choice(["ab", " ", "  ", "\n", "don't", " 12", "é", "中", "_", "<|endoftext|>", "."]) for _ in range(9000))
    parts = list(slices(text, 50))
    assert len(parts) > 20 and "".join(parts) == text
    assert [i for p in parts for i in file.encode(p)] == file.encode(text) == library_ids([text])[0][:-1]


def test_long_runs():
    file = ByteLevel(tokenizer_path())
    for text in ("x" * 600_000, " " * 300_000 + "a", "word " * 200_000):
        assert [*file.encode(text), 1] == library_ids([text])[0]


def test_empty_table(nothing):
    assert cost_packing.pack(nothing, tokenizer_path()).count() == 0

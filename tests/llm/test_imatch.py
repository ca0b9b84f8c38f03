import hashlib

from inboxsieve.llm import imatch
from inboxsieve.llm.queries import op1_imatch, table

from .conftest import SF, messy_rows, messy_table, prose


def edits(rows):
    """(id, length, sha of the edited text) of every row."""
    ids = sorted({i for i, _ in rows if i is not None})
    follow = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    longest = {}
    for i, t in rows:
        longest[i] = max(longest.get(i, ""), t or "", key=len)
    out = []
    for i, t in rows:
        t = t or ""
        k = len(t) // 4
        e = t[:len(t) - k] + (longest[follow[i]][:k] if i is not None else "")
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_on_the_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    text = dict(rows)
    got = op1_imatch(spark, SF).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == edits(rows)
    prints = {}
    for r in got:
        prints.setdefault(text[r.doc_id], set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in prints.values())
    follow = dict(zip(sorted(text), [*sorted(text)[1:], min(text)], strict=True))
    edited = sum(r.near_edited for r in got) / len(got)
    other = [r.near_next for r in got if text[r.doc_id] != text[follow[r.doc_id]]]
    assert edited > 0.4 and sum(other) / len(other) < 0.1


def test_messy_rows(messy):
    got = imatch.edited_fingerprints(messy).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == edits([(i, t) for i, t, _, _ in messy_rows()])
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert by[0] == by[1] != by[2] and by[6] == by[7] and by[3] == by[4] == by[5] and len(by[14]) == 1


def test_null_and_repeated_ids(spark):
    rows = [(None, prose(1, 40)), (None, None), (5, prose(2, 40)), (5, prose(3, 80)), (5, prose(3, 80)), (9, prose(4, 30))]
    got = imatch.edited_fingerprints(messy_table(spark, [(i, t, "en", "a") for i, t in rows])).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == edits(rows)


def test_the_band_leaves_out_rare_and_common_terms(spark):
    docs = messy_table(spark, [(k, f"common rare{k} pair{k // 2}", "en", "a") for k in range(20)])
    assert imatch.lexicon(docs, min_df=0.08, max_df=0.5).count() == 10


def test_copies_count_once_and_near_copies_stay_alike(spark):
    copies = [(k, "same old words", "en", "a") for k in range(50)] + [(50 + k, f"other text {k}", "en", "a") for k in range(10)]
    assert imatch.lexicon(messy_table(spark, copies), min_df=0.08, max_df=0.5).count() == 3 + 10
    base = prose(1, 60).split()  # near copies, one word apart, are a third of the rows
    near = [(k, " ".join([*base[:k], f"new{k}", *base[k + 1:]]), "en", "a") for k in range(30)]
    rest = [(30 + k, prose(100 + k, 60, 5000), "en", "a") for k in range(60)]
    got = {r.doc_id: r for r in imatch.edited_fingerprints(messy_table(spark, near + rest)).collect()}
    assert sum(got[k].near_next for k in range(29)) / 29 > 0.6
    assert sum(got[k].near_edited for k in range(29)) / 29 > 0.4
    assert sum(got[30 + k].near_next for k in range(59)) / 59 < 0.1


def test_empty_table(nothing):
    assert imatch.edited_fingerprints(nothing).count() == 0


def test_no_python_on_the_executors(spark):
    plan = op1_imatch(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

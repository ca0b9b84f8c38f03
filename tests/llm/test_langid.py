import numpy as np

from inboxsieve.llm import langid
from inboxsieve.llm.queries import op9_rank_language, table

from .conftest import SF, messy_rows


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in table(spark, SF, "documents").collect()}
    rows = op9_rank_language(spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def brute_profile(texts, size):
    from collections import Counter
    seen = Counter()
    for t in texts:
        word, runs = "", []
        for c in t.lower() + " ":
            if c.isalpha():
                word += c
            elif word:
                runs.append(word)
                word = ""
        for k, r in enumerate(runs):
            seen.update(("1", c) for c in r)
            p = f" {r} "
            seen.update(("3", p[i:i + 3]) for i in range(len(r)))
            seen.update(("2", p[i:i + 2]) for i in range(len(p) - 1))
    return sum(seen.values()), len(seen)


def test_ngrams_are_those_of_the_words():
    for text in ("Hello, w\u00f6rld! x", "a", "1a2", "caf\u00e9 \u4e2d\u6587", "ab  cd..ef"):
        codes = langid.ngram_codes(text)
        assert (len(codes), len(set(codes.tolist()))) == brute_profile([text], 0)
    assert len(langid.ngram_codes("12 !?")) == 0


def test_messy_rows(messy):
    got = {}
    for r in langid.identify(messy).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score, r.ids))
    for i, t, _, _ in messy_rows():
        letters = any(c.isalpha() for c in t or "")
        assert all((p == "und") == (not letters) and (s == 0) <= (p == "und") and x == "clash" for p, s, x in got[i])
    assert len(got[14]) == 2 and got[14][0] == got[14][1]


def test_nothing_to_learn_from(spark, messy, nothing):
    from pyspark.sql import functions as F
    rows = langid.identify(messy, learn_from=F.lit(False)).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}
    assert langid.identify(nothing).count() == 0


def test_ties_go_to_the_first_language():
    codes = langid.ngram_codes("same")
    same = langid._top(codes, 300)
    assert langid.Profiles({"aa": same, "bb": same}, 300).predict("same") == ("aa", 1.0)


def plain_grams(text):
    """The n-grams as strings, padded with NUL; no numpy."""
    out, run = [], ""
    runs = []
    for c in text.lower() + " ":
        if c.isalpha():
            run += c
        elif run:
            runs.append(run)
            run = ""
    line = "\0" + "\0".join(runs) + "\0"
    for k, c in enumerate(line):
        if c != "\0":
            out += [c, line[k - 1:k + 2]]
        if k:
            out.append(line[k - 1:k + 1])
    return out


def rank_of(counts, size):
    """Ranks by count, ties by the code points of the n-gram (a shorter one last)."""
    order = sorted(counts, key=lambda g: (-counts[g], [ord(c) for c in g] + [langid.NONE] * (3 - len(g))))
    return {g: k for k, g in enumerate(order[:size])}


def test_out_of_place_distance_by_brute_force(spark):
    """Profiles, ranks, distances and the best language, of the whole table."""
    import zlib
    from collections import Counter
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang").collect()
    counts = {}
    for r in docs:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            counts.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    profiles = {k: rank_of(c, 300) for k, c in sorted(counts.items())}
    got = {r.doc_id: r for r in op9_rank_language(spark, SF).collect()}
    for r in docs:
        own = rank_of(Counter(plain_grams(r.text or "")), 300)
        if not any(c.isalpha() for c in r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        distance = {k: sum(abs(p[g] - at) if g in p else 300 for g, at in own.items()) for k, p in profiles.items()}
        best = min(distance, key=lambda k: (distance[k], k))
        assert got[r.doc_id].lang_pred == best
        assert abs(got[r.doc_id].score - (1 - distance[best] / (300 * len(own)))) < 1e-12

import random
import time
from fractions import Fraction
from itertools import combinations
from math import ceil

import numpy as np
import pytest
from fixtures import SF, WIDE, documents, with_broken, words

from quillspark.llm import decontaminate, queries
from quillspark.llm.decontaminate import contaminated_pairs, drop_contaminated

BENCH = "item_id bigint, text string"


def brute(texts, items, min_matches=12, share=Fraction(4, 5), min_item=5):
    """Every overlap by the definition: all alignments, all runs."""
    tokens = lambda t: decontaminate.TOKEN.findall((t or "").lower())
    out = set()
    for i, item in items:
        b = tokens(item)
        if len(b) < max(1, min_item):
            continue
        need = min(min_matches, ceil(share * len(b)))
        for k, text in texts:
            a, best = tokens(text), None
            for d in range(-len(b) + 1, len(a)):
                at = [q for q in range(len(b)) if 0 <= q + d < len(a) and a[q + d] == b[q]]
                for x in range(len(at)):
                    for y in range(x + need - 1, len(at)):
                        n, length = y - x + 1, at[y] - at[x] + 1
                        if n >= share * length and (best is None or (-n, length, at[x] + d) < best):
                            best = (-n, length, at[x] + d)
            if best:
                out.add((k, i, -best[0], best[1], best[2]))
    return out


def found(docs, bench, **kw):
    return {(r.doc_id, r.item_id, r.n_matched, r.n_aligned, r.doc_start) for r in contaminated_pairs(docs, bench, **kw).collect()}


def test_cases(spark):
    item, other = words(20, 30), words(21, 9)
    spoiled = item.split()
    for i in (4, 13, 22):
        spoiled[i] = "changed"
    half = " ".join(item.split()[:14])
    texts = [(1, f"{words(22, 50)} {item} {words(23, 50)}"), (2, f"x {' '.join(spoiled)} y"), (3, item.upper().replace(" ", ", ")), (4, half), (5, " ".join(item.split()[:8]) + " " + words(24, 60)), (6, words(25, 80)), (7, other), (8, None), (9, ""), (10, words(26, 20) + " " + other)]
    docs = documents(spark, texts, WIDE)
    bench = spark.createDataFrame([(1, item), (2, other), (3, None), (4, "too few"), (5, ""), (6, item)], BENCH)
    got = {(r.doc_id, r.item_id): r.n_matched for r in contaminated_pairs(docs, bench).collect()}
    assert got == {**{(d, i): n for d, n in ((1, 30), (2, 27), (3, 30), (4, 14)) for i in (1, 6)}, (7, 2): 9, (10, 2): 9}
    clean = drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [5, 6, 8, 9]
    assert contaminated_pairs(docs, bench.limit(0)).count() == 0 and drop_contaminated(docs, bench.limit(0)).count() == 10
    assert contaminated_pairs(docs.limit(0), bench).count() == 0 and drop_contaminated(docs.limit(0), bench).count() == 0


def test_null_and_repeated_ids_and_broken_text(spark):
    item = words(40, 20)
    docs = with_broken(documents(spark, [(None, item), (None, item), (3, item), (3, item), (3, "else"), (4, None)], WIDE))
    bench = spark.createDataFrame([(1, item), (1, item), (None, item), (2, "ab cd ef gh")], BENCH)
    assert sorted(((r.doc_id, r.item_id) for r in contaminated_pairs(docs, bench).collect()), key=str) == sorted([(d, i) for d in (None, None, 3, 3) for i in (1, None)], key=str)
    assert sorted(r.doc_id for r in drop_contaminated(docs, bench).collect()) == [-5, 3, 4]
    assert {r.doc_id for r in contaminated_pairs(docs, spark.createDataFrame([(1, "ab cd")], BENCH), min_item=1).collect()} == {-5}


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_SEEDS, 0])
def test_matches_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", broadcast)
    r, vocabulary = random.Random(broadcast), words(50, 60).split()
    items = [(n, " ".join(r.choice(vocabulary) for _ in range(n))) for n in range(1, 26)]
    texts = []
    for k in range(150):
        w = r.choice(items)[1].split()
        for _ in range(r.randrange(0, 1 + len(w) // 4)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        texts.append((k, " ".join([r.choice(vocabulary) for _ in range(r.randrange(4))] + w + [r.choice(vocabulary) for _ in range(r.randrange(4))])))
    docs, bench = documents(spark, texts), spark.createDataFrame(items, BENCH)
    for min_item in (1, 5):
        assert found(docs, bench, min_item=min_item) == brute(texts, items, min_item=min_item)


def fewest_mismatches(masks, most):
    """By length: the fewest mismatches of a stretch, equal at both ends, without an equal window under any mask."""
    need = [sum(1 << (m[-1] - o) for o in m) for m in masks]
    span = max(m[-1] for m in masks) + 1
    states, out = {1: 0}, {1: 0}
    for length in range(2, most + 1):
        new = {}
        for state, lost in states.items():
            for equal in (0, 1):
                s = (state << 1 | equal) & ((1 << span) - 1)
                if not (equal and any(s & x == x for x in need)):
                    new[s] = min(new.get(s, 999), lost + 1 - equal)
        states, out[length] = new, min(lost for s, lost in new.items() if s & 1)
    return out


def test_masks_hit_every_run_that_counts():
    fewest = fewest_mismatches(decontaminate.MASKS, 400)
    for length in range(12, 401):  # 12 equal tokens, and four of five
        assert fewest[length] > min(length - 12, length // 5)
    assert all(fewest[n + 50] - fewest[n] > 10 for n in range(12, 350))  # beyond: 50 tokens more cost more than a fifth
    for n in range(decontaminate.SHORT, 15):  # items that need fewer than 12
        need = ceil(Fraction(4, 5) * n)
        assert all(fewest[length] > min(length - need, length // 5) for length in range(need, n + 1))
    for length in range(12, 17):  # the same for short runs by going through all placements
        for k in range(min(length - 12, length // 5) + 1):
            for left in combinations(range(1, length - 1), k):
                equal = [i not in left for i in range(length)]
                assert any(all(equal[a + o] for o in m) for m in decontaminate.MASKS for a in range(length - m[-1]))


def test_any_run_that_meets_both_thresholds_counts():
    r, share = random.Random(27), Fraction("0.8")
    for _ in range(500):
        equal = np.array([r.random() < 0.75 for _ in range(r.randrange(1, 30))])
        runs = [(int(equal[a:b].sum()), a - b, -a) for a in range(len(equal)) for b in range(a + 1, len(equal) + 1) if equal[a:b].sum() * 5 >= 4 * (b - a)]
        n, length, at = max(runs, default=(0, 0, 0))
        assert decontaminate.best_run(equal, share) == ((n, -length, -at) if n else (0, 0, 0))


def test_repetitive_and_very_long_texts(spark):
    texts = [(1, "na " * 200_000), (2, "la na " * 50_000), (3, f"{words(60, 40_000)} {words(61, 20)} {words(62, 40_000)}")]
    items = [(1, "na " * 200), (2, "na " * 300), (3, "la na " * 100), (4, words(61, 20))]
    began = time.time()
    got = found(documents(spark, texts), spark.createDataFrame(items, BENCH))
    assert got == {(1, 1, 200, 200, 0), (1, 2, 300, 300, 0), (2, 3, 200, 200, 0), (3, 4, 20, 20, 40_000)}
    assert time.time() - began < 60


def test_small_filters_change_nothing(spark, monkeypatch):
    want = sorted(map(tuple, queries.op4_decontaminate(spark, SF).collect()))
    monkeypatch.setattr(decontaminate, "FILTER_BITS", (16, 16))
    assert sorted(map(tuple, queries.op4_decontaminate(spark, SF).collect())) == want and want
